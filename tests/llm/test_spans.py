"""Substring de-duplication, SimHash and containment against plain versions."""

import random

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st

from laneflow.llm import arrays, bytespans, components, containment, simhash, suffixes, winnow, wordspans
from tests.llm import brute


@given(st.lists(st.integers(1, 4), max_size=60))
@settings(max_examples=200, deadline=None)
def test_suffix_array(codes):
    order = suffixes.suffix_array(codes)
    assert order == sorted(range(len(codes)), key=lambda i: codes[i:])
    for r, n in enumerate(suffixes.common_prefixes(codes, order)):
        if r:
            a, b = codes[order[r - 1] :], codes[order[r] :]
            assert a[:n] == b[:n] and a[n : n + 1] != b[n : n + 1]


@given(st.lists(st.binary(max_size=80), max_size=6), st.integers(2, 12))
@settings(max_examples=100, deadline=None)
def test_segments_cover_each_window_once(texts, width):
    data = np.frombuffer(b"".join(texts), np.uint8)
    bounds = np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)
    s = winnow.segments(arrays.BYTE_CODES[data], bounds, width, min(3, width))
    found = sorted((int(r), int(f) + k) for r, f, n in zip(s.row, s.first, s.count, strict=True) for k in range(n))
    assert found == [(r, k) for r, t in enumerate(texts) for k in range(len(t) - width + 1)]


def corpus(seed, words=30, docs=60):
    """Documents with exact copies, near copies, shared passages and repeated rows."""
    r = random.Random(seed)
    letters = [f"w{k}" for k in range(words)] + ["é", "ñandú"]
    base = [" ".join(r.choices(letters, k=r.randrange(0, 120))) for _ in range(docs // 3)]
    rows = []
    for i in range(docs):
        text = r.choice(base)
        kind = r.randrange(6)
        if kind == 0:
            w = text.split(" ")
            w[r.randrange(len(w))] = "changed"
            text = " ".join(w)
        elif kind == 1:
            text = f"{r.choice(base)[:150]}\n{text[40:]} tail{i}"
        elif kind == 2:
            text = "ab" * r.randrange(0, 90)
        elif kind == 3 and i % 2:
            text = None
        rows.append((None if i == 7 else i, text))
    rows += [rows[3], rows[3], (5, "another text under an id that is taken " + base[0]), (900, ""), (901, " \n\t ")]
    return rows


def frame(spark, rows, parts=3):
    # Columns that an operator might use for itself.
    wide = [(i, x, 1, 2, "k", 3, "p") for i, x in rows]
    schema = "doc_id long, text string, doc int, tag int, key string, place int, piece string"
    return spark.createDataFrame(wide, schema).repartition(parts)


@pytest.mark.parametrize("seed", range(3))
@pytest.mark.parametrize("group", [3, 1024])
def test_bytespans(spark, seed, group):
    rows = corpus(seed)
    out = bytespans.deduplicated(frame(spark, rows), length=40, group=group).collect()
    assert sorted(map(tuple, out), key=repr) == brute.bytespans(rows, 40)


@pytest.mark.parametrize("seed", range(3))
def test_wordspans(spark, seed):
    rows = corpus(seed, words=8)
    out = wordspans.deduplicated(frame(spark, rows), window=10).collect()
    assert sorted(map(tuple, out), key=repr) == brute.wordspans(rows, 10)


def test_many_different_neighbours_of_one_line(spark):
    line = " ".join(f"shared{k}" for k in range(40))
    rows = [(i, f"{'x' * (i % 7)} head{i * 7919} {line} tail{i * 104729}") for i in range(300)]
    out = bytespans.deduplicated(frame(spark, rows), length=60, group=50).collect()
    assert sorted(map(tuple, out), key=repr) == brute.bytespans(rows, 60)


def test_empty_tables(spark):
    none = spark.createDataFrame([], "doc_id long, text string, lang string")
    assert bytespans.deduplicated(none).count() == 0
    assert wordspans.deduplicated(none).count() == 0
    assert simhash.near_duplicates(none).count() == 0
    items = spark.createDataFrame([], "item_id long, text string")
    assert containment.pairs(none, items).count() == 0


def test_lengths_out_of_range(spark):
    with pytest.raises(ValueError):
        bytespans.deduplicated(frame(spark, [(1, "x")]), length=5)
    with pytest.raises(ValueError):
        wordspans.deduplicated(frame(spark, [(1, "x")]), window=900)


@pytest.mark.parametrize("block", [5, 10_000])
def test_simhash(spark, block):
    rows = corpus(4)
    out = simhash.near_duplicates(frame(spark, rows), block=block).select("doc_id", "fp", "component_id").collect()
    prints = [brute.fingerprint(x) for _, x in rows]
    label = brute.components(prints)
    least = {}
    for (i, _), k in zip(rows, label, strict=True):
        if i is not None:
            least[k] = min(least.get(k, i), i)
    want = sorted(((i, p, least.get(k)) for (i, _), p, k in zip(rows, prints, label, strict=True)), key=repr)
    assert sorted(((r.doc_id, r.fp & (2**64 - 1), r.component_id) for r in out), key=repr) == want


@given(st.lists(st.integers(0, 2**64 - 1), min_size=1, max_size=12, unique=True), st.sampled_from([5, 6, 7, 8]), st.data())
@settings(max_examples=100, deadline=None)
def test_grid_loses_no_link(prints, groups, data):
    """Every link shares a cell in some grid, and places are a lower bound of distances."""
    fp = np.array(prints + [p ^ (1 << data.draw(st.integers(0, 63))) ^ (1 << data.draw(st.integers(0, 63))) for p in prints], np.uint64)
    places = simhash.unary(fp)
    masks = [np.uint64(m & (2**64 - 1)) for m in simhash.grid_masks(4, groups)]
    for i in range(len(fp)):
        away = np.bitwise_count(fp ^ fp[i])
        assert (np.bitwise_count(places ^ places[i]) <= away).all()
        for j in np.flatnonzero(away <= 4):
            assert any(places[i] & m == places[j] & m for m in masks)
    assert np.bitwise_or.reduce(masks) == np.uint64(2**64 - 1)


def test_comparisons_do_not_grow_with_the_fingerprints():
    """Fingerprints that one is compared to in all grids: 64 times as many give hardly more."""

    def compared(n):
        groups = simhash.groups_for(n, 4)
        places = simhash.unary(np.random.default_rng(1).integers(0, 2**63, n).astype(np.uint64))
        some = places[:50]
        return sum(
            float((((some[:, None] ^ places[None, :]) & np.uint64(m & (2**64 - 1))) == 0).sum()) / len(some)
            for m in simhash.grid_masks(4, groups)
        )

    assert compared(1 << 20) < 8 * compared(1 << 14)
    assert [simhash.groups_for(10**k, 4) for k in (3, 5, 9)] == sorted(simhash.groups_for(10**k, 4) for k in (3, 5, 9))


@given(st.lists(st.tuples(st.integers(0, 12), st.integers(0, 12)), max_size=15))
@settings(max_examples=8, deadline=None)
def test_components(spark, pairs):
    edges = spark.createDataFrame(pairs or [(1, 1)], "a long, b long")
    root = {r.node: r.root for r in components.components(edges).collect()}
    label = {n: n for p in pairs for n in p}
    for _ in label:
        for a, b in pairs:
            label[a] = label[b] = min(label[a], label[b])
    assert root == {n: k for n, k in label.items() if n != k}


def test_containment(spark):
    r = random.Random(2)
    words = [f"t{k}" for k in range(400)]
    items = [(k, " ".join(r.choices(words, k=r.randrange(0, 60)))) for k in range(30)]
    items += [(30, "Tiny item"), (31, None), (32, " .,; "), (0, items[0][1])]
    rows = []
    for i in range(60):
        text = " ".join(r.choices(words, k=r.randrange(0, 900)))
        if i % 2:
            part = r.choice(items)[1] or ""
            w = part.split(" ")
            if i % 4 == 1:
                w[r.randrange(len(w))] = "other"
            text = f"{text[:1000]}. {' '.join(w).upper()}! {text[1000:]}"
        rows.append((i, text))
    rows += [(60, None), (61, ""), (62, "a tiny ITEM, here"), rows[1]]
    want = sorted(
        (k, i, *n) for i, x in rows for k, q in items if (n := brute.contained(x, q)) is not None
    )
    bench = spark.createDataFrame(items, "item_id long, text string")
    for block_words in (100, 1 << 21):
        out = containment.pairs(frame(spark, rows), bench, block_words=block_words).collect()
        assert sorted(map(tuple, out)) == want
    clean = containment.clean(frame(spark, rows), bench)
    assert sorted(x.doc_id for x in clean.collect()) == sorted(i for i, _ in rows if i not in {w[1] for w in want})
    assert len(want) > 20
