"""The registered queries of the folder on the smallest tables, and the pipeline against plain code."""

import os
from collections import defaultdict
from pathlib import Path

import numpy as np
import pytest
from tokenizers import Tokenizer

import corpus_pipeline
from laneflow.llm import bpe, pii, queries, shared, toxicity
from tests import compare
from tests.llm import brute
from tests.llm import test_copies as near

SF_DIR = os.environ.get("TEST_SF_DIR", "/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not Path(SF_DIR).is_dir(), reason="test tables are not here")


@pytest.mark.parametrize("name", sorted(queries.SQL))
def test_query_equals_sql(spark, name):
    con = compare.connect(SF_DIR)
    assert compare.difference(queries.REGISTRY[name](spark, SF_DIR), con, queries.SQL[name]) is None


@pytest.fixture(scope="module")
def rows(spark):
    return [(r.doc_id, r.text) for r in shared.table(spark, SF_DIR, "documents").collect()]


def test_bytespans(spark, rows):
    out = queries.REGISTRY["op2_suffixes"](spark, SF_DIR).collect()
    assert sorted(map(tuple, out), key=repr) == brute.bytespans(rows, 200)


def test_simhash(spark, rows):
    out = queries.REGISTRY["op8_simhash"](spark, SF_DIR).collect()
    rows = sorted(rows)
    prints = [brute.fingerprint(x) for _, x in rows]
    want = [(i, f"{p:016x}", rows[k][0]) for (i, _), p, k in zip(rows, prints, brute.components(prints), strict=True)]
    assert sorted(map(tuple, out)) == want


def test_personal_data(spark, rows):
    out = {r.doc_id: r for r in queries.REGISTRY["op6_bilstm"](spark, SF_DIR).collect()}
    assert len(out) == len(rows)
    for i, text in rows:
        base = [f"{k}:{a}:{b}" for k, a, b in brute.base_spans(text)]
        assert out[i].base_sha256 == brute.sha(",".join(base).encode())
        assert set(base) <= set(out[i].spans.split(","))


def test_tokens(spark, rows):
    library = Tokenizer.from_file(bpe.public_path())
    library.no_truncation()
    library.no_padding()
    out = {r.doc_id: r for r in queries.REGISTRY["op10_bpe"](spark, SF_DIR).collect()}
    for i, text in rows:
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert (out[i].n_tokens, out[i].ids_sha256) == (len(ids), brute.sha(np.array(ids, "<u4").tobytes()))
        assert out[i].decoded_sha256 == brute.sha(library.decode(ids, skip_special_tokens=False).encode())


def test_toxicity_held_out(spark):
    out = {r.doc_id: r for r in queries.REGISTRY["op9_weak_supervision"](spark, SF_DIR).collect()}
    held = [r for r in shared.table(spark, SF_DIR, "labels").collect() if out[r.doc_id].held_out]
    assert held and sum(out[r.doc_id].predicted == r.toxic for r in held) >= 0.9 * len(held)


def test_pages(spark):
    out = queries.REGISTRY["op1_template"](spark, SF_DIR).collect()
    assert len(out) == shared.table(spark, SF_DIR, "pages").count()
    assert all(r.n_chars == len(r.text) for r in out)


def test_pipeline_equals_plain_code(spark):
    docs = shared.table(spark, SF_DIR, "documents")
    model = toxicity.trained(docs, shared.table(spark, SF_DIR, "labels"))
    score = {r.doc_id: r.score for r in toxicity.scored(docs, model).collect()}
    rows = sorted(((r.doc_id, r.text) for r in docs.collect() if score[r.doc_id] < 0.5))
    best = set(near.kept(rows))  # all pairs of five-word shingle sets
    rows = [row for row in rows if row[0] in best]
    items = [r.text for r in shared.table(spark, SF_DIR, "benchmark").collect()]
    rows = [(i, x) for i, x in rows if not any(brute.contained(x, q) for q in items)]
    kept = spark.createDataFrame(rows, "doc_id long, text string")
    net = pii.trained(kept)
    codec = bpe.Codec(bpe.Vocabulary.read(bpe.public_path()))
    want = {}
    for i, x in rows:
        ((_, spans),) = pii.spans_of([x], net)
        want[i] = list(memoryview(codec.encode(pii.redact(x, spans))).cast("I"))
    got = defaultdict(list)
    for r in corpus_pipeline.run(spark, SF_DIR).collect():
        got[r.doc_id].append(r.ids)
    assert {i: [x] for i, x in want.items()} == got


def test_stages_keep_the_columns(spark):
    docs = shared.table(spark, SF_DIR, "documents")
    for _, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, docs, SF_DIR)
        assert out.schema.simpleString() == docs.schema.simpleString()
        assert stage(spark, docs.limit(0), SF_DIR).count() == 0
