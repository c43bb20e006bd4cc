"""Resampling, whitening and the quality classifier against plain versions, and their edge cases."""

import hashlib
import math
import re
import zlib
from collections import Counter

import numpy as np
import pytest

from laneflow.llm import quality, queries, resampling, shared, whitening
from tests.llm import brute
from tests.llm.test_queries import SF_DIR

DOCS = "doc_id long, text string, n_words string, score int, rank int, vector double"
TERM = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def grams(text):
    w = TERM.findall((text or "").translate(brute.LOWER))
    return len(w), [" ".join(w[i : i + k]) for k in (1, 2, 3) for i in range(len(w) - k + 1)]


def bucket(gram, buckets):
    return zlib.crc32(gram.encode()) % buckets


def plain_resampling(rows, target, buckets=10_000, percent=5, least=20):
    s, t = (Counter(bucket(g, buckets) for x in texts for g in grams(x)[1]) for texts in ([x for _, x in rows], target))
    ss, tt = sum(s.values()), sum(t.values())
    gain = lambda b: math.floor(1000 * math.log((t[b] + 1) * (ss + buckets) / ((s[b] + 1) * (tt + buckets))))
    out = []
    for i, text in rows:
        n, found = grams(text)
        weight = sum(gain(bucket(g, buckets)) for g in found)
        h = int(hashlib.sha256(f"42:{'' if i is None else i}".encode()).hexdigest()[:8], 16)
        score = weight + math.floor(-1000 * math.log(-math.log((h + 0.5) / 4294967296)))
        out.append((i, n, len(found), weight, score))
    able = sorted((r for r in out if r[1] >= least), key=lambda r: (-r[4], r[0] is not None, r[0]))
    drawn = Counter({})
    ranks = {}
    for k, r in enumerate(able[: percent * len(able) // 100]):
        ranks.setdefault(r, []).append(k + 1)
        drawn[r] += 1
    want = []
    for r in out:
        want.append((*r, ranks[r].pop() if ranks.get(r) else None))
    return sorted(want, key=repr)


def test_crcs_equal_zlib():
    rng = np.random.default_rng(3)
    data = rng.integers(0, 256, 40_000).astype(np.uint8)
    lengths = np.r_[1:200, 511:515, 20_000]
    starts = rng.integers(0, 20_000, len(lengths))
    found = resampling.crcs(data, starts, starts + lengths)
    assert found.tolist() == [zlib.crc32(data[a : a + n].tobytes()) for a, n in zip(starts, lengths, strict=True)]


def test_resampling_equals_plain_code(spark):
    rng = np.random.default_rng(7)
    word = lambda: f"{'ÄbC'[rng.integers(3)]}{rng.integers(60)}"
    rows = [(i, " ".join(word() for _ in range(rng.integers(1, 80)))) for i in range(300)]
    rows += [(900, None), (901, ""), (902, "-- \n"), (None, " ".join("xyz" for _ in range(30))), (4, rows[4][1]), (4, rows[4][1])]
    rows += [(903, "語" * 9000 + " " + " ".join(word() for _ in range(40))), (904, " ".join(word() for _ in range(30_000)))]
    target = [" ".join(word() for _ in range(50)) for _ in range(20)] + [None, ""]
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3.0) for r in rows], DOCS).repartition(7)
    bench = spark.createDataFrame([(k, x) for k, x in enumerate(target)], "item_id long, text string")
    for percent, buckets in ((5, 10_000), (100, 97)):
        out = resampling.resampled(docs, bench, percent=percent, buckets=buckets).collect()
        assert sorted(map(tuple, out), key=repr) == plain_resampling(rows, target, buckets, percent)


def test_resampling_of_empty_tables(spark):
    docs = spark.createDataFrame([], "doc_id long, text string")
    bench = spark.createDataFrame([], "item_id long, text string")
    assert resampling.resampled(docs, bench).count() == 0
    some = spark.createDataFrame([(1, "a b c " * 20)], "doc_id long, text string")
    (row,) = resampling.resampled(some, bench, percent=100).collect()
    assert row["rank"] == 1 and row.n_features == 60 + 59 + 58


def plain_whitening(x):
    fit = np.unique(x, axis=0)
    n, s = len(fit), fit.sum(axis=0)
    covariance = np.cov(fit.T, bias=True)
    values, vectors = np.linalg.eigh(covariance)
    values, vectors = values[::-1], vectors[:, ::-1]
    return n, ((n * x - s) ** 2).sum(axis=1), (x - s / n) @ vectors / np.sqrt(np.maximum(values, 1e-300)), values / values.sum()


@pytest.mark.parametrize("rows_a_block", [5, whitening.ROWS])
def test_whitening_equals_plain_code(spark, monkeypatch, rows_a_block):
    monkeypatch.setattr(whitening, "ROWS", rows_a_block)
    monkeypatch.setattr(whitening, "TOGETHER", 3)
    rng = np.random.default_rng(2)
    vectors = (rng.normal(size=(90, 7)) * np.arange(1, 8)).astype(np.float32)
    vectors[60:] = vectors[11]  # a third of the rows are copies of one
    good = [(int(i), v.tolist()) for i, v in enumerate(vectors)] + [(None, vectors[0].tolist()), (3, vectors[3].tolist())]
    bad = [(200, None), (201, []), (202, [None] * 7), (203, [math.nan] * 7), (204, [math.inf] + [0.0] * 6), (205, [1.0, 2.0])]
    rows = spark.createDataFrame([(*r, 1, 2, "x") for r in good + bad], "vec_id long, embedding array<float>, number int, n int, x string")
    out = whitening.whitened(rows.repartition(5), "vec_id", "embedding").collect()
    assert Counter(r.vec_id for r in out) == Counter({i: 4 * n for i, n in Counter(i for i, _ in good).items()})
    x = np.floor(256 * np.array([v for _, v in good])).astype(np.int64)
    n, deviation, z, explained = plain_whitening(x)
    at = {i: k for k, (i, _) in enumerate(good)}
    signs = {}
    for r in out:
        k, c = at[r.vec_id], r.component - 1
        assert (r.n, r.deviation) == (n, deviation[k])
        assert r.explained == pytest.approx(explained[c], rel=1e-9) and r.identity_error < 1e-9
        assert abs(r.whitened) == pytest.approx(abs(z[k, c]), abs=1e-8)
        if abs(z[k, c]) > 1e-6:
            signs.setdefault(c, set()).add(r.whitened * z[k, c] > 0)
    assert all(len(s) == 1 for s in signs.values())


def test_whitening_without_variance(spark):
    schema = "vec_id long, embedding array<float>"
    assert whitening.whitened(spark.createDataFrame([], schema), "vec_id", "embedding").count() == 0
    same = spark.createDataFrame([(1, [0.5, 1.0]), (2, [0.5, 1.0])], schema)
    assert whitening.whitened(same, "vec_id", "embedding").count() == 0
    flat = spark.createDataFrame([(1, [0.5, 1.0]), (2, [1.5, 1.0]), (3, [2.0, 1.0])], schema)
    out = whitening.whitened(flat, "vec_id", "embedding").collect()
    assert {r.component for r in out} == {1} and out[0].explained == pytest.approx(1)
    huge = spark.createDataFrame([(1, [3e38, 1.0]), (2, [-3e38, 2.0]), (3, [0.0, 1.5])], schema)
    assert {r.vec_id for r in whitening.whitened(huge, "vec_id", "embedding").collect() if r.deviation is None} == {1, 2}


def walked(model, row):
    """One row through each tree, node by node."""
    total = model.start
    inner = model.statistic.shape[1]
    for statistic, threshold, value in zip(model.statistic, model.threshold, model.value, strict=True):
        at = 0
        while at < inner:
            at = 2 * at + (2 if row[statistic[at]] > threshold[at] else 1)
        total += value[at - inner]
    return total


def test_trees_learn_and_walk():
    rng = np.random.default_rng(4)
    x = rng.normal(size=(3000, 6))
    x[:, 2] = np.round(x[:, 2])  # ties
    y = ((x[:, 0] > 0) ^ (x[:, 2] > 0)).astype(float)
    model = quality.boosted(x[:2000], y[:2000], trees=40)
    assert ((model.score(x[2000:]) > 0.5) == (y[2000:] == 1)).mean() > 0.97
    assert model.logit(x[2000:2050]) == pytest.approx([walked(model, r) for r in x[2000:2050]])


def test_statistics_of_a_text():
    text = "AB cd!\nAB cd!\n\n## é 12,"
    data = np.frombuffer(text.encode(), np.uint8)
    ((*row,),) = quality.statistics(data, np.array([0, len(data)]))
    found = dict(zip(quality.STATISTICS, row, strict=True))
    n = len(text)
    assert (found["chars"], found["words"], found["lines"]) == (n, 7, 3)
    assert found["word_length"] == pytest.approx((2 + 3 + 2 + 3 + 2 + 1 + 3) / 7) and found["longest_word"] == 3
    assert found["distinct_words"] == pytest.approx(5 / 7) and found["top_word"] == pytest.approx(2 / 7)
    assert found["repeated_pairs"] == pytest.approx(1 / 6) and found["repeated_lines"] == pytest.approx(1 / 3)
    assert found["digits"] == pytest.approx(2 / n) and found["symbols"] == pytest.approx(2 / n)
    assert found["stops"] == pytest.approx(2 / n) and found["beyond_ascii"] == pytest.approx(1 / n)
    assert found["ended_lines"] == pytest.approx(2 / 3) and found["bare_words"] == pytest.approx(2 / 7)
    # Rows of one batch don't see each other.
    many = np.frombuffer((text + text).encode(), np.uint8)
    size = len(data)
    both = quality.statistics(many, np.array([0, size, size, 2 * size]))
    assert both[0].tolist() == both[2].tolist() == list(row) and not both[1].any()


def test_quality_edge_cases(spark):
    rows = [(1, "A good text. It ends.", 5), (1, "A good text. It ends.", 5), (2, None, 6), (None, "", 7), (3, "x" * 200_000, 8)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, score int")
    for labels in ([], [(1, 1)], [(1, None), (None, 1), (7, 5)]):
        known = spark.createDataFrame(labels, "doc_id long, quality int")
        out = quality.scored(docs, quality.trained(docs, known)).collect()
        assert len(out) == 5 and all(0 <= r.score <= 1 for r in out)
    assert quality.scored(docs.limit(0), quality.trained(docs.limit(0), known)).count() == 0


def test_quality_held_out(spark):
    """Accuracy on rows that no tree has seen."""
    out = {r.doc_id: r for r in queries.REGISTRY["op13_boosted_quality"](spark, SF_DIR).collect()}
    labels = shared.table(spark, SF_DIR, "labels").collect()
    held = [r for r in labels if out[r.doc_id].held_out]
    assert all(out[r.doc_id].held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in labels)
    assert held and sum(out[r.doc_id].predicted == r.quality for r in held) >= 0.9 * len(held)


def test_whitening_query(spark):
    out = queries.REGISTRY["op12_whitening"](spark, SF_DIR).collect()
    rows = shared.table(spark, SF_DIR, "embeddings").collect()
    n, deviation, z, explained = plain_whitening(np.floor(256 * np.array([r.embedding for r in rows], float)).astype(np.int64))
    want = {r.vec_id: k for k, r in enumerate(rows)}
    assert len(out) == 4 * len(rows)
    for r in out:
        k, c = want[r.vec_id], r.component - 1
        assert (r.n, r.deviation) == (n, deviation[k]) and abs(r.whitened) == pytest.approx(abs(z[k, c]), abs=1e-6)
        assert r.explained == pytest.approx(explained[c], rel=1e-6) and r.identity_error < 1e-4
