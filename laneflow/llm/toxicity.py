"""Toxicity by weak supervision.

Voters are words and word beginnings: a small fixed lexicon, and the most telling terms of a bounded
sample of labelled rows. A voter fires on a document that has its term and abstains otherwise; one
more votes clean where no other fires. A generative model of the votes (an EM over the hidden class)
estimates how often each voter fires in either class; voters that fire together beyond what the class
explains share their weight. Its posterior labels train a logistic regression, which scores every
document from the counts of the terms.

Everything that learns uses labelled rows whose ``crc32(doc_id) mod 5`` isn't 0, ``SAMPLE`` of them
at most; the driver receives the voters and one small row of counts per sampled document.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from laneflow.llm import arrays, containment, shared
from laneflow.llm.shared import F

#: Labelled rows to learn from at most: those with the least hashes of their id.
SAMPLE = 10_000
#: Sampled rows of one file of the written sample, about: as few files as the tasks that read them need.
ROWS_OF_A_FILE = 1_250
#: Mined voters at most, and the documents that a term must have to become one.
VOTERS = 256
SUPPORT = 4
#: A term is telling if it is at least so many times as frequent in toxic documents, and if chance is
#: ruled out by so large a likelihood-ratio statistic (many thousands of terms are tried).
TELLING = 25.0
CERTAIN = 24.0
#: Labelled documents that the label model's starting rates count for.
TRUST = 20
#: Lengths in bytes of the word beginnings that are terms beside whole words.
BEGINNINGS = (4, 5, 6)
#: Words that mark an insult in any corpus.
LEXICON = (
    "idiot", "idiots", "moron", "morons", "stupid", "scum", "loser", "losers", "trash", "worthless", "pathetic",
    "disgusting", "clown", "imbecile", "dumbass", "asshole", "bastard", "bitch", "fucking", "fuck", "shit",
    "retard", "dummkopf", "arschloch", "scheiße", "abschaum", "connard", "salaud", "merde", "imbécile",
    "gilipollas", "imbécil", "mierda", "pendejo", "estúpido",
)
FOLD, FOLDS = 0, 5
ROUNDS = 12
#: Correlation, given the class, from which two voters depend on each other.
TIED = 0.2
RIDGE = 1.0


def is_held_out():
    text = F.coalesce(F.col("doc_id").cast("string"), F.lit(""))
    return F.crc32(text) % FOLDS == FOLD


def terms(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and term hash of every word and word beginning, and words per row."""
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = containment.LETTERS[data]
    before = inside.copy()
    before[offsets] = False
    starts = np.flatnonzero(inside[1:] & ~before[:-1])
    after = np.append(inside[1:], False)
    after[offsets] = False
    ends = np.flatnonzero(inside[1:] & ~after[1:]) + 1
    upper = (data >= 65) & (data <= 90)
    runs = arrays.Runs(arrays.BYTE_CODES[data | (upper.astype(np.uint8) << 5)])
    row = np.searchsorted(offsets, starts, side="right") - 1
    rows, hashes = [row], [runs.hashes(starts, ends)]
    for n in BEGINNINGS:
        long = ends - starts > n
        rows.append(row[long])
        hashes.append(arrays.mix(runs.hashes(starts[long], starts[long] + n) + np.uint64(n)))
    return np.concatenate(rows), np.concatenate(hashes), np.bincount(row, minlength=len(offsets) - 1)


def lexicon() -> np.ndarray:
    data = "\n".join(LEXICON).encode()
    codes = np.frombuffer(data, np.uint8)
    row, hashes, words = terms(codes, np.array([0, len(codes)]))
    return hashes[: int(words.sum())]


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``text, toxic`` of at most ``sample`` labelled rows outside the held-out fold."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("toxic").cast("int").alias("toxic"))
        .filter(F.col("toxic").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
        .groupBy("doc_id")
        .agg(F.max("toxic").alias("toxic"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = shared.id_and_text(docs).join(F.broadcast(known), "doc_id").select("text", "toxic")
    # Near copies start from the same shingles: one of each counts, or their words would all be telling.
    sketched = shared.per_batch(rows, sketch_batch, "text string, toxic int, sketch long")
    return sketched.groupBy("sketch").agg(F.min(F.struct("text", "toxic")).alias("x")).select("x.*")


def sketch_batch(part: pa.RecordBatch) -> pa.RecordBatch:
    out = []
    for _, data, offsets in arrays.pieces(part):
        codes, before = containment.word_codes(data, offsets)
        hashes = arrays.Runs(codes).windows(3) if len(codes) > 2 else codes
        for lo, hi in zip(before[:-1], before[1:], strict=True):
            some = hashes[lo : max(lo + 1, hi - 2)] if hi > lo else np.zeros(0, np.uint64)
            out.append(int(some.min().view(np.int64)) if len(some) else 0)
    return pa.RecordBatch.from_arrays(
        [part.column("text"), part.column("toxic"), pa.array(out, pa.int64())], ["text", "toxic", "sketch"]
    )


def counted_terms(part: pa.RecordBatch) -> pa.RecordBatch:
    """Toxic and clean documents of a batch that have each term."""
    toxic = part.column("toxic").to_numpy()
    found = []
    for rows, data, offsets in arrays.pieces(part):
        row, hashes, _ = terms(data, offsets)
        order = np.lexsort((hashes, row))
        row, hashes = row[order], hashes[order]
        new = np.ones(len(row), bool)
        new[1:] = (row[1:] != row[:-1]) | (hashes[1:] != hashes[:-1])
        found.append((hashes[new], toxic[rows][row[new]]))
    hashes = np.concatenate([h for h, _ in found])
    flags = np.concatenate([t for _, t in found])
    values, at = np.unique(hashes, return_inverse=True)
    bad = np.bincount(at, flags, len(values)).astype(np.int64)
    return pa.RecordBatch.from_arrays(
        [pa.array(values.view(np.int64)), pa.array(bad), pa.array(np.bincount(at, minlength=len(values)) - bad)],
        ["term", "bad", "good"],
    )


@dataclass(frozen=True)
class Model:
    """Voters' terms in ascending order, and the weights of the score."""

    terms: np.ndarray
    strength: np.ndarray  # log-odds of a vote in the label model
    weights: np.ndarray
    bias: float


def vote_counts(part: pa.RecordBatch, voters: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How often each row has each voter's term (rows x voters), and its words."""
    counts, words = [], []
    for _, data, offsets in arrays.pieces(part):
        row, hashes, n = terms(data, offsets)
        at = np.minimum(np.searchsorted(voters, hashes), max(len(voters) - 1, 0))
        hit = voters[at] == hashes if len(voters) else np.zeros(len(hashes), bool)
        cells = np.bincount(row[hit] * len(voters) + at[hit], minlength=len(n) * len(voters))
        counts.append(cells.reshape(len(n), len(voters)))
        words.append(n)
    return np.concatenate(counts), np.concatenate(words)


def features(counts: np.ndarray, words: np.ndarray, strength: np.ndarray) -> np.ndarray:
    """Evidence of all votes, kinds of voters that fired, hits per word, and hits of each voter."""
    fired = counts > 0
    hits = counts.sum(axis=1)
    return np.column_stack(
        [
            np.log1p(fired @ np.maximum(strength, 0)),
            np.log1p(fired.sum(axis=1)),
            np.log1p(100 * hits / np.maximum(words, 1)),
            np.log1p(counts),
        ]
    )


def label_model(counts: np.ndarray, rates: tuple[np.ndarray, np.ndarray], prior: float) -> tuple[np.ndarray, np.ndarray]:
    """Posterior of toxic per row, and the log-odds of each vote.

    The last voter of ``counts`` votes clean: it fires where no other does. ``rates`` start the EM:
    how often each voter fires in toxic and in clean rows.
    """
    votes = (counts > 0).astype(float)
    votes = np.column_stack([votes, votes.sum(axis=1) == 0])
    quiet = 0.1, 0.95
    start = high, low = tuple(np.append(r, q) for r, q in zip(rates, quiet, strict=True))
    tied = np.eye(votes.shape[1])
    n = len(votes)
    for _ in range(ROUNDS):
        strength = np.log(high / low)
        # Votes that come together beyond what the class explains count as one.
        logit = np.log(prior / (1 - prior)) + (votes / np.maximum(votes @ tied, 1)) @ strength
        posterior = 1 / (1 + np.exp(-np.clip(logit, -30, 30)))
        bad = posterior.sum()
        # The starting rates go on counting, which holds voters in place that hardly ever fire.
        high = (votes.T @ posterior + TRUST * start[0]) / (bad + TRUST)
        low = (votes.T @ (1 - posterior) + TRUST * start[1]) / (n - bad + TRUST)
        rest = votes - (posterior[:, None] * high + (1 - posterior)[:, None] * low)
        spread = np.sqrt((rest**2).mean(axis=0)) + 1e-6
        tied = (rest.T @ rest) / n / np.outer(spread, spread)
        tied = np.where(tied > TIED, np.minimum(tied, 1), 0)
        np.fill_diagonal(tied, 1)
    return posterior, strength[:-1]


def logistic(x: np.ndarray, target: np.ndarray) -> tuple[np.ndarray, float]:
    """Weights and bias of a ridge logistic regression on soft labels, by Newton steps."""
    x = np.column_stack([x, np.ones(len(x))])
    weights = np.zeros(x.shape[1])
    ridge = np.append(np.full(x.shape[1] - 1, RIDGE), 1e-3)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ weights, -30, 30)))
        slope = x.T @ (p - target) + ridge * weights
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(ridge)
        step = np.linalg.solve(curve, slope)
        weights -= step
        if np.abs(step).max() < 1e-6:
            break
    return weights[:-1], float(weights[-1])


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE, voters: int = VOTERS) -> Model:
    """Mine the voters, fit the label model and the classifier.

    Without labelled rows only the lexicon votes and its score is a fixed one.
    """
    few = sampled(docs, labels, sample).coalesce(max(1, sample // ROWS_OF_A_FILE))
    known = shared.materialize(few, "toxic-sample")
    bad, good = known.agg(F.coalesce(F.sum("toxic"), F.lit(0)), F.coalesce(F.sum(1 - F.col("toxic")), F.lit(0))).first()
    high, low = (F.col("bad") + 0.5) / F.lit(bad + 1.0), (F.col("good") + 0.5) / F.lit(good + 1.0)
    seen, share = F.col("bad") + F.col("good"), bad / max(bad + good, 1)
    parts = [(F.col("bad"), seen * F.lit(share)), (F.col("good"), seen * F.lit(1 - share))]
    certain = 2 * sum(F.when(n > 0, n * F.log(n / expected)).otherwise(0) for n, expected in parts)
    mined = (
        shared.per_batch(known, counted_terms, "term long, bad long, good long")
        .groupBy("term")
        .agg(F.sum("bad").alias("bad"), F.sum("good").alias("good"))
        .filter((F.col("bad") >= SUPPORT) & (high >= TELLING * low) & (certain >= CERTAIN))
        .orderBy((F.col("bad") * F.log(high / low)).desc(), "term")
        .limit(voters)
        .collect()
    )
    rate = {r.term & (2**64 - 1): ((r.bad + 0.5) / (bad + 1), (r.good + 0.5) / (good + 1)) for r in mined}
    rate = {int(t): (0.02, 0.0005) for t in lexicon()} | rate
    table = np.array(sorted(rate), np.uint64)
    rates = tuple(np.array([rate[int(t)][k] for t in table]) for k in (0, 1))

    def count(part: pa.RecordBatch) -> pa.RecordBatch:
        counts, words = vote_counts(part, table)
        return pa.RecordBatch.from_arrays(
            [pa.array([c.tobytes() for c in counts.astype(np.int32)], pa.binary()), pa.array(words), part.column("toxic")],
            ["counts", "words", "toxic"],
        )

    rows = shared.per_batch(known, count, "counts binary, words long, toxic int").collect()
    if not rows or not bad:
        strength = np.log(rates[0] / rates[1])
        return Model(table, strength, np.concatenate([[2.0, 0.0, 0.0], np.zeros(len(table))]), -2.0)
    counts = np.array([np.frombuffer(r.counts, np.int32) for r in rows])
    words, toxic = np.array([r.words for r in rows]), np.array([r.toxic for r in rows], float)
    order = np.lexsort([toxic, words, *counts.T])  # the same sums whatever order the rows come in
    counts, words, toxic = counts[order], words[order], toxic[order]
    posterior, strength = label_model(counts, rates, (bad + 1) / (bad + good + 2))
    x = features(counts, words, strength)
    weights, bias = logistic(x, posterior)
    # The same line, moved and stretched to fit the sample's labels: 0.5 is then where the odds are even.
    (scale,), shift = logistic((x @ weights + bias)[:, None], toxic)
    return Model(table, strength, scale * weights, scale * bias + shift)


def scores(part: pa.RecordBatch, model: Model) -> np.ndarray:
    """Score of every row; a row without words has that of a text without votes."""
    counts, words = vote_counts(part, model.terms)
    logit = features(counts, words, model.strength) @ model.weights + model.bias
    return 1 / (1 + np.exp(-np.clip(logit, -30, 30)))


def scored(docs: DataFrame, model: Model) -> DataFrame:
    """``doc_id, score`` of every row; null text is empty. Extra columns are ignored."""

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([part.column("doc_id"), pa.array(scores(part, model))], ["doc_id", "score"])

    return shared.per_batch(shared.id_and_text(docs), score, "doc_id long, score double")


def clean(docs: DataFrame, model: Model) -> DataFrame:
    """The rows of ``docs``, all columns, that score below 0.5."""

    def keep(part: pa.RecordBatch) -> pa.RecordBatch:
        return part.filter(pa.array(scores(part, model) < 0.5))

    return shared.per_batch(docs, keep, docs.schema)


def op9_weak_supervision(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents``, learnt from ``labels`` outside the held-out fold."""
    docs = shared.table(spark, sf_dir, "documents")
    model = trained(docs, shared.table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted")
    )
