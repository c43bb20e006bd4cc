"""Quality classifier: histogram gradient-boosted trees over statistics of a document.

A document is a row of numbers (``STATISTICS``) on its characters, words and lines, computed for whole
Arrow batches. A bounded sample of labelled rows is reduced to such rows in Spark and these are fitted on
the driver: every statistic is cut into bins at its quantiles, a tree grows level by level, and a level's
sums of gradients by node, statistic and bin are one ``bincount``. Trees are complete binary ones of a
fixed depth and lie flattened in three arrays (statistic, threshold, value), so that a batch walks all
trees at once: one array step a level.

Everything that learns uses labelled rows whose ``crc32(doc_id) mod 4`` isn't 2, ``SAMPLE`` of them at
most: those with the least hashes of their id.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from laneflow.llm import arrays, shared
from laneflow.llm.shared import F

#: Labelled rows to learn from at most.
SAMPLE = 20_000
FOLD, FOLDS = 2, 4
GOOD = 0.7
TREES, DEPTH, BINS = 80, 4, 64
RATE = 0.15
#: L2 penalty of a leaf, and the least sum of second derivatives in one.
PENALTY, LEAST_CURVE = 1.0, 2.0
#: Rows times trees that a walk holds at once.
AT_ONCE = 1 << 20

STATISTICS = (
    "chars", "words", "lines", "word_length", "longest_word", "short_words", "long_words", "distinct_words",
    "top_word", "repeated_pairs", "repeated_fives", "capital_words", "capitals", "digits", "spaces",
    "stops", "commas", "symbols", "other_marks", "beyond_ascii", "marked_words", "ended_words", "bare_words",
    "words_a_line", "short_lines", "repeated_lines", "ended_lines", "byte_entropy", "word_entropy", "lone_marks",
)


def chars(text: str) -> np.ndarray:
    out = np.zeros(256, bool)
    out[[*text.encode()]] = True
    return out


UPPER, LOWER, DIGIT = (np.arange(256) >= a for a in (65, 97, 48))
UPPER[91:], LOWER[123:], DIGIT[58:] = False, False, False
STOPS, COMMAS, SYMBOLS, OTHER = chars(".!?"), chars(",;:"), chars("#*$%&|<>"), chars("@{}[]()~^_=+-/\\\"'`")
HIGH = np.arange(256) >= 128
LETTERS = UPPER | LOWER | HIGH
MARKS = STOPS | COMMAS | SYMBOLS | OTHER
STARTS = (np.arange(256) & 0xC0) != 0x80  # first bytes of characters


def is_held_out() -> Column:
    return F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))) % FOLDS == FOLD


def per_row(values: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Sums of runs ``offsets[i] .. offsets[i + 1]``."""
    total = np.concatenate([[0], np.cumsum(values, dtype=np.int64)])
    return (total[offsets[1:]] - total[offsets[:-1]]).astype(float)


def repeats(row: np.ndarray, key: np.ndarray, rows: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Keys of a row: how many, how many distinct ones, the most frequent one's count, and their entropy."""
    order = np.lexsort((key, row))
    row, key = row[order], key[order]
    new = np.flatnonzero(np.r_[True, (row[1:] != row[:-1]) | (key[1:] != key[:-1])]) if len(row) else np.zeros(0, np.int64)
    count, of = np.diff(np.r_[new, len(row)]).astype(float), row[new]
    total = np.bincount(row, minlength=rows).astype(float)
    most = np.zeros(rows)
    np.maximum.at(most, of, count)
    share = count / np.maximum(total[of], 1)
    return total, np.bincount(of, minlength=rows).astype(float), most, np.bincount(of, -share * np.log2(share), rows)


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """Rows x ``STATISTICS``; all of an empty text's are 0."""
    rows = len(offsets) - 1
    starts, ends, before = arrays.words(data, offsets)
    words, n_chars = np.diff(before).astype(float), per_row(STARTS[data], offsets)
    row = np.repeat(np.arange(rows), np.diff(before))
    at = np.concatenate([[0], np.cumsum(STARTS[data])])
    length = (at[ends] - at[starts]).astype(float)
    longest = np.zeros(rows)
    np.maximum.at(longest, row, length)
    codes = arrays.Runs(arrays.BYTE_CODES[data | ((UPPER[data]).astype(np.uint8) << 5)])
    word = codes.hashes(starts, ends)
    _, kinds, most, entropy = repeats(row, word, rows)
    runs = arrays.Runs(word)

    def repeated(k: int) -> np.ndarray:
        first = np.flatnonzero(row[: len(row) - k + 1] == row[k - 1 :]) if len(row) >= k else np.zeros(0, np.int64)
        total, distinct, _, _ = repeats(row[first], runs.hashes(first, first + k), rows)
        return (total - distinct) / np.maximum(total, 1)

    def of_words(flag: np.ndarray) -> np.ndarray:
        return np.bincount(row, flag, rows) / np.maximum(words, 1)

    def of_chars(table: np.ndarray) -> np.ndarray:
        return per_row(table[data], offsets) / np.maximum(n_chars, 1)

    lettered = np.concatenate([[0], np.cumsum(LETTERS[data])])
    marked = np.concatenate([[0], np.cumsum(SYMBOLS[data])])
    bare = (lettered[ends] - lettered[starts]) == 0
    last = data[ends - 1] if len(ends) else np.zeros(0, np.uint8)
    first = data[starts] if len(starts) else np.zeros(0, np.uint8)

    breaks = np.flatnonzero(data == 0x0A)
    line_row = np.concatenate([np.repeat(np.arange(rows), 1), np.searchsorted(offsets, breaks, side="right") - 1])
    line_start = np.concatenate([offsets[:-1], breaks + 1])
    order = np.lexsort((line_start, line_row))
    line_row, line_start = line_row[order], line_start[order]
    line_end = np.r_[line_start[1:] - 1, offsets[-1]] if rows else line_start
    tail = np.r_[line_row[1:] != line_row[:-1], True] if rows else np.zeros(0, bool)
    line_end[tail] = offsets[1:][line_row[tail]]
    line_words = np.searchsorted(starts, line_end) - np.searchsorted(starts, line_start)
    full = line_words > 0
    line_row, line_words = line_row[full], line_words[full]
    final = last[np.searchsorted(starts, line_end[full]) - 1]
    n_lines, line_kinds, _, _ = repeats(line_row, codes.hashes(line_start[full], line_end[full]), rows)
    lines = np.maximum(n_lines, 1)

    by_byte = np.bincount(np.repeat(np.arange(rows), np.diff(offsets)) * 256 + data, minlength=rows * 256).reshape(rows, 256)
    share = by_byte / np.maximum(by_byte.sum(axis=1, keepdims=True), 1)
    byte_entropy = -(share * np.log2(np.where(share > 0, share, 1))).sum(axis=1)
    columns = (
        n_chars, words, n_lines, of_words(length), longest, of_words(length <= 3), of_words(length >= 12),
        kinds / np.maximum(words, 1), most / np.maximum(words, 1), repeated(2), repeated(5), of_words(UPPER[first]),
        per_row(UPPER[data], offsets) / np.maximum(per_row(LETTERS[data], offsets), 1), of_chars(DIGIT),
        of_chars(arrays.SPACES), of_chars(STOPS), of_chars(COMMAS), of_chars(SYMBOLS), of_chars(OTHER),
        of_chars(HIGH & STARTS), of_words((marked[ends] - marked[starts]) > 0), of_words(STOPS[last]), of_words(bare),
        words / lines, np.bincount(line_row, line_words <= 5, rows) / lines, (n_lines - line_kinds) / lines,
        np.bincount(line_row, STOPS[final], rows) / lines, byte_entropy, entropy, of_words(bare & MARKS[last]),
    )
    return np.column_stack(columns)


def statistics_of(part: pa.RecordBatch) -> np.ndarray:
    found = [statistics(data, offsets) for _, data, offsets in arrays.pieces(part)]
    return np.concatenate(found) if found else np.zeros((0, len(STATISTICS)))


@dataclass(frozen=True)
class Trees:
    """Complete trees, one a row: inner nodes in heap order, then the leaves' values."""

    statistic: np.ndarray  # trees x inner nodes
    threshold: np.ndarray  # a greater value goes right
    value: np.ndarray  # trees x leaves
    start: float

    def logit(self, x: np.ndarray) -> np.ndarray:
        trees, inner = self.statistic.shape
        out = np.full(len(x), self.start)
        if not trees:
            return out
        step, tree = max(1, AT_ONCE // trees), np.arange(trees)
        for lo in range(0, len(x), step):
            some = x[lo : lo + step]
            row, at = np.arange(len(some))[:, None], np.zeros((len(some), trees), np.int64)
            for _ in range((inner + 1).bit_length() - 1):
                at = 2 * at + 1 + (some[row, self.statistic[tree, at]] > self.threshold[tree, at])
            out[lo : lo + step] += self.value[tree, at - inner].sum(axis=1)
        return out

    def score(self, x: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(x), -30, 30)))


def edges_of(column: np.ndarray, bins: int) -> np.ndarray:
    """Thresholds between ``bins`` bins at most: midpoints of neighbouring values at the quantiles."""
    values = np.unique(column)
    if len(values) > bins:
        values = np.unique(np.quantile(column, np.linspace(0, 1, bins), method="nearest"))
    return (values[1:] + values[:-1]) / 2


def boosted(
    x: np.ndarray, y: np.ndarray, trees: int = TREES, depth: int = DEPTH, bins: int = BINS, rate: float = RATE
) -> Trees:
    """Trees that fit the log-odds of ``y``. Without rows of both labels there are none."""
    n, wide = x.shape if x.ndim == 2 else (0, len(STATISTICS))
    start = float(np.log((y.sum() + 1) / (n - y.sum() + 1)))
    inner = (1 << depth) - 1
    if n == 0 or y.min() == y.max():
        trees = 0
    edges = [edges_of(x[:, f], bins) for f in range(wide)] if trees else []
    binned = np.column_stack([np.searchsorted(e, x[:, f], side="left") for f, e in enumerate(edges)]) if trees else None
    statistic = np.zeros((trees, inner), np.int64)
    threshold = np.full((trees, inner), np.inf)
    value = np.zeros((trees, inner + 1))
    logit = np.full(n, start)
    for t in range(trees):
        p = 1 / (1 + np.exp(-logit))
        slope, curve = y - p, p * (1 - p)
        node = np.zeros(n, np.int64)
        for level in range(depth):
            nodes, first = 1 << level, (1 << level) - 1
            cell = ((node[:, None] * wide + np.arange(wide)) * bins + binned).ravel()
            size = nodes * wide * bins
            g = np.bincount(cell, np.repeat(slope, wide), size).reshape(nodes, wide, bins)
            h = np.bincount(cell, np.repeat(curve, wide), size).reshape(nodes, wide, bins)
            left_g, left_h = g.cumsum(axis=2)[:, :, :-1], h.cumsum(axis=2)[:, :, :-1]
            all_g, all_h = g.sum(axis=2, keepdims=True), h.sum(axis=2, keepdims=True)
            gain = left_g**2 / (left_h + PENALTY) + (all_g - left_g) ** 2 / (all_h - left_h + PENALTY)
            gain = gain - all_g**2 / (all_h + PENALTY)
            gain[(left_h < LEAST_CURVE) | (all_h - left_h < LEAST_CURVE)] = 0
            best = gain.reshape(nodes, -1).argmax(axis=1)
            split = gain.reshape(nodes, -1)[np.arange(nodes), best] > 1e-9
            f, cut = np.divmod(best, bins - 1)
            # A bin beyond a statistic's last edge is empty, so no split with a gain lies there.
            threshold[t, first : first + nodes] = [edges[a][b] if s else np.inf for a, b, s in zip(f, cut, split, strict=True)]
            statistic[t, first : first + nodes] = np.where(split, f, 0)
            node = 2 * node + (split[node] & (binned[np.arange(n), f[node]] > cut[node]))
        g, h = np.bincount(node, slope, inner + 1), np.bincount(node, curve, inner + 1)
        value[t] = rate * g / (h + PENALTY)
        logit = logit + value[t][node]
    return Trees(statistic, threshold, value, start)


def sampled(docs: DataFrame, labels: DataFrame, sample: int) -> DataFrame:
    """``good, x`` of at most ``sample`` labelled rows outside the held-out fold; of several labels the greater."""
    known = (
        labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("good"))
        .filter(F.col("good").isin(0, 1) & F.col("doc_id").isNotNull() & ~is_held_out())
        .groupBy("doc_id")
        .agg(F.max("good").alias("good"))
        .orderBy(F.xxhash64("doc_id"), "doc_id")
        .limit(sample)
    )
    rows = shared.id_and_text(docs).join(F.broadcast(known), "doc_id").select("text", "good")

    def reduce(part: pa.RecordBatch) -> pa.RecordBatch:
        x = pa.array([r.tobytes() for r in statistics_of(part)], pa.binary())
        return pa.RecordBatch.from_arrays([part.column("good"), x], ["good", "x"])

    return shared.per_batch(rows, reduce, "good int, x binary")


def trained(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> Trees:
    """Trees from ``sample`` labelled rows at most; equal rows of statistics and label count once.

    Without labelled rows, or with one label only, every row has the same score: the smoothed share of
    good rows.
    """
    rows = sampled(docs, labels, sample).distinct().collect()
    rows = sorted((r.good, bytes(r.x)) for r in rows)  # the same sums whatever order the rows come in
    x = np.frombuffer(b"".join(b for _, b in rows), float).reshape(-1, len(STATISTICS))
    return boosted(x, np.array([g for g, _ in rows], float))


def scored(docs: DataFrame, model: Trees) -> DataFrame:
    """``doc_id, score`` of every row; null text is empty. Repeated rows stay, extra columns are ignored."""

    def score(part: pa.RecordBatch) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), pa.array(model.score(statistics_of(part)))], ["doc_id", "score"]
        )

    return shared.per_batch(shared.id_and_text(docs), score, "doc_id long, score double")


def op13_boosted_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of every whole text of ``documents``, learnt from ``labels`` outside the held-out fold."""
    docs = shared.table(spark, sf_dir, "documents")
    model = trained(docs, shared.table(spark, sf_dir, "labels"))
    return scored(docs, model).select(
        "doc_id", is_held_out().alias("held_out"), "score", (F.col("score") >= GOOD).cast("int").alias("predicted")
    )
