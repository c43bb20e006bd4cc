"""Near copies of the pipeline against all pairs of shingle sets."""

import random

import numpy as np
import pyarrow as pa
import pytest

import corpus_pipeline
from laneflow.llm import copies, shared
from tests.llm import brute


def sets(rows):
    out = []
    for _, text in rows:
        w = brute.WORD.findall((text or "").translate(brute.LOWER))
        k = min(5, len(w))
        out.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if k else set())
    return out


def kept(rows):
    """Least id of each component."""
    found, label = sets(rows), list(range(len(rows)))
    for i in range(len(rows)):
        for j in range(i):
            either = len(found[i] | found[j])
            if label[i] != label[j] and (not either or len(found[i] & found[j]) >= 0.8 * either):
                lo, hi = sorted((label[i], label[j]))
                label = [lo if x == hi else x for x in label]
    return [rows[k][0] for k in sorted(set(label))]


def corpus():
    rng = random.Random(5)
    word = lambda: f"w{rng.randrange(4000)}"
    rows = []
    for _ in range(40):
        base = [word() for _ in range(rng.choice([30, 120, 500]))]
        rows.append(base)
        for changes in (1, 2, 4, 8):
            copy = list(base)
            for _ in range(max(1, changes * len(base) // 400)):
                copy[rng.randrange(len(copy))] = word()
            rows.append(copy)
    return [(i, " ".join(w)) for i, w in enumerate(rows)] + [(900, ""), (901, None), (902, "Two words"), (903, "two  WORDS")]


@pytest.mark.parametrize("block", [5, copies.BLOCK])
def test_near_copies_equal_all_pairs(spark, block):
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in copies.one_of_each(docs, block=block).collect()) == kept(rows)


def test_stage_links_near_copies_of_many_bits(spark):
    """Five places of 320 words differ: a Jaccard of 0.85, more than four bits of op8's fingerprints."""
    rng = random.Random(1)
    base = [f"w{rng.randrange(10**6)}" for _ in range(320)]
    other = [f"x{k}" if k % 64 == 32 else w for k, w in enumerate(base)]
    rows = [(7, " ".join(base)), (3, " ".join(other))]
    a, b = (brute.fingerprint(x) for _, x in rows)
    assert (a ^ b).bit_count() > 4
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert [r.doc_id for r in corpus_pipeline.drop_near_copies(spark, docs, "").collect()] == [3]


@pytest.mark.parametrize("words", [(1, 8), (9, 14), (15, 55)])
def test_no_link_is_lost_in_any_size_class(spark, words):
    """Sets of 1 to 4, 5 to 10, and 11 to 51 shingles, changed at an end or inside; frequent words among them."""
    rng = random.Random(words[0])
    word = lambda: f"w{int(rng.paretovariate(0.4)) % 900}"
    rows = []
    for _ in range(60):
        base = [word() for _ in range(rng.randint(*words))]
        rows += [base, [*base, word()], [word(), *base[1:]], base[: max(1, len(base) - 2)]]
    rows = [(i, " ".join(w)) for i, w in enumerate(rows)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    assert sorted(r.doc_id for r in copies.one_of_each(docs).collect()) == kept(rows)


def test_a_large_group_hardly_alike(spark, monkeypatch):
    """Copies of one text with up to eight changed words each, and many unlike texts that share a passage."""
    monkeypatch.setattr(copies, "OFTEN", 4)
    rng = random.Random(3)
    base, passage = [f"b{k}" for k in range(150)], [f"p{k}" for k in range(60)]
    rows = []
    for i in range(300):
        copy = list(base)
        for at in rng.sample(range(150), rng.randrange(1, 9)):
            copy[at] = f"x{i}y{at}"
        rows.append((i, " ".join(copy)))
    rows += [(i, " ".join([f"u{i}v{k}" for k in range(60)] + passage)) for i in range(300, 500)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(6)
    assert sorted(r.doc_id for r in copies.one_of_each(docs, block=40).collect()) == kept(rows)


def test_edges(spark):
    """Nulls, empty and very long texts, repeated rows, and columns with the operator's own names."""
    long = " ".join(f"l{k}" for k in range(60_000))
    rows = [(4, "a b c d e f"), (4, "a b c d e f"), (None, "a b  c d e F"), (5, None), (6, ""), (7, long), (3, long + " end"), (None, None)]
    schema = "doc_id long, text string, _doc string, _row int, _nth int, node long, root long"
    docs = spark.createDataFrame([(*r, "x", 1, 2, 3, 4) for r in rows], schema)
    out = copies.one_of_each(docs)
    assert out.columns == docs.columns
    assert sorted(((r.doc_id, r.text) for r in out.collect()), key=repr) == sorted([(None, "a b  c d e F"), (None, None), (3, long + " end")], key=repr)
    assert copies.one_of_each(docs.limit(0)).count() == 0


@pytest.mark.parametrize("words", [60, 2_600])
def test_a_block_tells_pairs_that_may_be_alike_only(words):
    """Unlike sets that share their first shingle, and one near copy: one pair, once for all shingles it shares."""
    rng = np.random.default_rng(words)
    shared_one, found = np.array([3], np.uint64), []
    for _ in range(40):
        found.append(np.unique(np.r_[shared_one, rng.integers(9, 1 << 63, words, dtype=np.uint64)]))
    found.append(np.unique(np.r_[found[0][: -words // 20], rng.integers(9, 1 << 63, words // 20, dtype=np.uint64)]))
    rows = [(k, i, len(h), int(np.searchsorted(h, t)), i) for k, t in ((3, 3), (5, found[0][1])) for i, h in enumerate(found) if t in h]
    columns = [pa.array([r[c] for r in rows], pa.int64()) for c in range(5)]
    table = pa.table(columns, ["token", "node", "n", "pos", "root"])
    for name, words64, least_n in (("parity", copies.WORDS, 0), ("wide", copies.WIDE, copies.LARGE)):
        known = [copies.parity_of(found[r[1]], words64) if r[2] >= least_n else [] for r in rows]
        table = table.append_column(name, pa.array(known, pa.list_(pa.int64())))
    assert copies.candidates(table, 0.8).to_pylist() == [{"a": 0, "b": 40}]


def test_large_sets_equal_all_pairs(spark):
    """Sets on both sides of the size from which they have second parities, alike and hardly unlike."""
    rng = random.Random(17)
    rows = []
    for words in (1_700, 1_830, 3_000, 9_500):
        base = [f"w{rng.randrange(10**6)}" for _ in range(words)]
        for share in (0, 0.015, 0.021, 0.023, 0.03):
            copy = list(base)
            for at in rng.sample(range(words), int(share * words)):
                copy[at] = f"x{rng.randrange(10**6)}"
            rows.append((len(rows), " ".join(copy)))
        rows.append((len(rows), " ".join(base[: int(words * 0.82)])))
        rows.append((len(rows), " ".join(f"w{rng.randrange(10**6)}" for _ in range(words))))
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    out = sorted(r.doc_id for r in copies.one_of_each(docs, block=8).collect())
    assert out == kept(rows) and 4 < len(out) < len(rows)


def test_only_texts_that_may_be_asked_for_meet_the_chosen(spark):
    """Texts of other bits are left out by a broadcast table; one row each that is chosen, repeats included."""
    # The second row has the bit of the first, the last has its word and another bit.
    rows = [(1, 7, "a"), (1, 7 + copies.MARKS, "b"), (2, -1, "c"), (2, -1, "c"), (3, 9, "d"), (4, 8, "e")]
    keyed = spark.createDataFrame(rows, "_doc long, _row long, text string")
    chosen = spark.createDataFrame([(70, 1, 7), (80, 2, -1)], "node long, doc_id long, row long")
    out = copies.asked_texts(keyed, chosen)
    assert sorted(map(tuple, out.collect())) == [(70, "a"), (80, "c"), (80, "c")]
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert "getbit" in plan and "strategy=broadcast" in plan


def test_tables_that_are_read_no_more_are_emptied(spark, monkeypatch):
    written, write = {}, shared.materialize

    def noted(df, name):
        written.setdefault(name, []).append(write(df, name))
        return written[name][-1]

    monkeypatch.setattr(shared, "materialize", noted)
    rows = corpus()
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert sorted(r.doc_id for r in copies.one_of_each(docs).collect()) == kept(rows)
    for name, tables in (("copies-prefixes", written["copies-prefixes"]), ("copies-met", written["copies-met"]), ("copies-sets", written["copies-sets"])):
        for table in tables:
            folder = table.inputFiles()[0].rsplit("/", 1)[0]
            assert spark.read.schema(table.schema).parquet(folder).count() == 0, name
