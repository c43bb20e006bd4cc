"""Chat, quality lines, byte-pair encoding, personal data, toxicity, web pages."""

import pickle

import numpy as np
import public_tokenizers
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from tokenizers import Tokenizer

from laneflow.llm import bilstm, bpe, chat, lines, pii, shared, templates, toxicity
from tests.llm import brute

CONTROLS = st.sampled_from([*chat.CONTROL, "<", "|", ">", "\\", "[INST", "a", "\n", "é", "<|end|>\n", "<|turn|>"])
NASTY = st.lists(CONTROLS, max_size=12).map("".join)


@given(st.lists(st.tuples(NASTY, NASTY), max_size=5))
@settings(max_examples=300, deadline=None)
def test_turns_read_back(turns):
    text = "".join(chat.write_turn(r, chat.Visitor().visit(chat.parts_of(t, False))) for r, t in turns)
    assert list(chat.read_turns(text)) == turns
    for _, t in turns:
        assert not any(c in chat.escape(t) for c in chat.CONTROL)


def test_typed_parts(spark):
    parts = '[{"type":"text","text":"see [INST]"},{"type":"image","ref":"a.png"},{"type":"audio","ref":"b","tokens":7},{"type":"document"}]'
    rows = spark.createDataFrame([(1, 0, "user", parts), (1, 1, "user", '[{"type":"image","ref":"c"}]')], "conv_id int, turn int, role string, text string")
    first, second = chat.format_turns(rows, typed=True).orderBy("place").collect()
    assert "<|image:0:256|><|audio:1:7|><|document:2:512|>" in first.formatted
    assert [tuple(a) for a in first.attachments] == [("image", "a.png", 256), ("audio", "b", 7), ("document", "", 512)]
    assert first.tokens == 775 and "<|image:3:256|>" in second.formatted
    with pytest.raises(ValueError):
        chat.Visitor().visit([{"type": "smell"}])


def test_chat_edges(spark):
    schema = "conv_id long, turn long, role string, text string, place int, formatted string"
    rows = [(None, 1, None, None, 1, "x"), (3, None, "assistant", "b", 1, "x"), (3, 0, "assistant", "a", 1, "x"), (3, 0, "assistant", "a", 1, "x")]
    out = {r.conv_id: r for r in chat.digests(spark.createDataFrame(rows, schema)).collect()}
    assert out[None].n_turns == 1 and out[None].turns_sha256 == brute.sha(b"\n\n")
    assert (out[3].n_turns, out[3].loss_chars, out[3].loss_sha256) == (3, 3, brute.sha(b"baa"))
    assert chat.digests(spark.createDataFrame([], schema)).count() == 0


def test_lines(spark):
    line, body = "All rights are reserved here by us", " ".join(f"own{k}" for k in range(60))
    rows = [(i, f"{line}\n{body} {i}", "h") for i in range(12)]
    rows += [(20, f"{line.upper()} \n {line}\nshort", "h"), (21, f"{line}\n{body} x", "other"), (22, None, None), (23, "", "h")]
    rows += [(24, "a b c " * 40, "h"), (25, "\n".join([body] * 3), "h"), rows[0]]
    df = spark.createDataFrame([(*r, 5, "z") for r in rows], "doc_id long, text string, source string, line int, host string")
    out = {r.doc_id: r for r in lines.quality(df).collect()}
    assert lines.quality(df).count() == len(rows)
    assert all(out[i].kept and out[i].lines_removed == 1 for i in range(12))
    assert out[20].lines_removed == 2 and not out[20].kept
    assert out[21].lines_removed == 0 and out[21].kept
    assert out[22].n_words == out[23].n_words == 0 and out[22].base_failed and not out[23].kept
    assert out[24].n_repeat_words == 120 and out[24].base_failed
    assert out[25].n_dup_lines == 2
    assert lines.quality(df.limit(0)).count() == 0


def test_copies_are_documents_of_their_own(spark):
    """Twenty copies of one page: its lines are frequent. Rows of one id and text are one document."""
    page = "\n".join(" ".join(f"w{k}x{j}" for j in range(12)) for k in range(6))
    other = page.replace("w", "v")
    rows = [(i, page, "h") for i in range(20)] + [(50, other, "h")] * 20 + [(70 + i, other, f"h{i}") for i in range(20)]
    rows += [(None, page.replace("w", "z"), None)] * 20
    out = lines.quality(spark.createDataFrame(rows, "doc_id long, text string, source string")).collect()
    assert len(out) == len(rows)
    assert all(not r.kept and r.lines_removed == 6 for r in out if r.doc_id is not None and r.doc_id < 20)
    assert all(r.kept and not r.lines_removed for r in out if r.doc_id is None or r.doc_id >= 50)


@pytest.fixture(scope="module")
def codec():
    return bpe.Codec(bpe.Vocabulary.read(bpe.public_path()))


@pytest.fixture(scope="module")
def library():
    found = Tokenizer.from_file(str(public_tokenizers.path("word_bpe_49k.json")))
    found.no_truncation()
    found.no_padding()
    return found


@given(st.text(max_size=60) | NASTY | st.lists(st.sampled_from(["<|endoftext|>", "it's", "We'LL ", "Σ", "ΑΣ ", "İ", "ẞ", "́", "a", "12", "\xa0", "\x1c"]), max_size=8).map("".join))
@settings(max_examples=400, deadline=None)
def test_bpe_equals_the_library(codec, library, text):
    ids = codec.encode(text)
    want = library.encode(text, add_special_tokens=False).ids
    assert list(memoryview(ids).cast("I")) == want
    assert codec.decode(ids) == library.decode(want, skip_special_tokens=False)


def test_bpe_rows(spark, codec):
    rows = [(1, None), (2, ""), (3, "Plain words, here"), (3, "Plain words, here")]
    df = spark.createDataFrame([(*r, 1, "x") for r in rows], "doc_id long, text string, ids int, decoded string")
    vocabulary = bpe.Vocabulary.read(bpe.public_path())
    out = sorted((r.doc_id, r.n_tokens, r.decoded) for r in bpe.encode_decode(df, vocabulary).collect())
    assert out[:2] == [(1, 0, ""), (2, 0, "")] and out[2] == out[3]
    assert codec.plain(codec.encode("Plain words, here")) == "plain words , here"
    assert bpe.digests(df.limit(0), vocabulary).count() == 0


@given(st.lists(st.sampled_from(["a@b.c", "x.y+z@mail-1.co.uk", "@", "1.2.3.4", "256.1.1.1", "4111 1111 1111 1111", "4111-1111-1111-1112", "+1 (555) 123-4567", "+", "12", ".", " ", "é", "٣", "word"]), max_size=9).map("".join))
@settings(max_examples=400, deadline=None)
def test_base_spans(text):
    assert [(pii.KINDS[k], a, b) for k, a, b in pii.base_spans(text)] == brute.base_spans(text)


@pytest.fixture(scope="module")
def network():
    words = np.random.default_rng(3)
    texts = [" ".join("".join(chr(97 + c) for c in words.integers(0, 26, words.integers(1, 9))) for _ in range(60)) for _ in range(500)]
    return bilstm.train(*pii.training_set(texts), pii.CLASSES, pii.HIDDEN, len(pii.KINDS) + 1, pii.STEPS, pii.BATCH, pii.SEED)


def test_gradients_are_right():
    net = bilstm.Network(*(a.astype(np.float64) for a in bilstm.fresh(6, 3, 4, 1).arrays()))
    random = np.random.default_rng(0)
    chars, tags = random.integers(1, 6, (7, 4)), random.integers(0, 4, (7, 4))
    chars[5:, 1] = bilstm.PAD
    _, grads = bilstm.gradients(net, chars, tags)
    for array, grad in zip(net.arrays(), grads, strict=True):
        at = np.unravel_index(np.abs(grad).argmax(), grad.shape)
        old, losses = array[at], []
        for step in (1e-3, -1e-3):
            array[at] = old + step
            losses.append(bilstm.gradients(net, chars, tags)[0])
        array[at] = old
        assert abs((losses[0] - losses[1]) / 2e-3 - grad[at]) < 1e-2 * max(1, abs(grad[at]))


def test_skipped_rows_are_outside(network):
    random = np.random.default_rng(5)
    chars = random.integers(1, pii.CLASSES, (70, 200)).astype(np.uint8)
    chars[np.arange(70)[:, None] >= random.integers(1, 71, 200)] = bilstm.PAD
    score = bilstm.emissions(network, *bilstm.states(network, chars))
    score[chars == bilstm.PAD] = [0, *[-1e4] * 5]
    assert (bilstm.viterbi(network, score) == bilstm.decode(network, chars)).all()


def test_network_finds_what_patterns_miss(network):
    random, found, all_spans, false = np.random.default_rng(11), 0, 0, 0
    plain = "many plain words stand here and none of them is anything but a word"
    for _ in range(200):
        kind, inner = pii.invented(random)
        text = f"{plain} {inner} {plain}"
        ((_, spans),) = pii.spans_of([text], network)
        at = len(plain) + 1
        overlap = [k for k, a, b in spans if a < at + len(inner) and at < b]
        if kind != 2:  # invented cards mostly fail the checksum that a card must pass
            all_spans += 1
            found += kind in overlap
        false += sum(b <= at or a >= at + len(inner) for _, a, b in spans)
    assert found >= 0.8 * all_spans and false <= 2


def test_long_texts_and_borders(network):
    inner = "token=" + "0123456789abcdef" * 2
    texts = ["", "x", *(("word " * 400)[: 300 + k] + " " + inner + " tail" * 50 for k in range(0, 200, 13))]
    for text, (_, spans) in zip(texts, pii.spans_of(texts, network), strict=True):
        assert [text[a:b] for k, a, b in spans if k == pii.SECRET] == ([inner] if inner in text else [])


def test_redaction(spark, network):
    text = "Write to a.b@mail.example.com or +1 (555) 123-4567 now"
    rows = [(1, text, len(text)), (2, None, None), (3, "", 0), (4, "nothing here", 12)]
    df = spark.createDataFrame(rows, "doc_id long, text string, n_chars long")
    out = {r.doc_id: r for r in pii.redacted(df, network).collect()}
    assert out[1].text == "Write to [EMAIL] or [PHONE] now" and out[1].n_chars == len(out[1].text)
    assert (out[2].text, out[3].text, out[4].text) == (None, "", "nothing here")
    assert pii.redacted(df.limit(0), network).count() == 0
    assert pii.redact("abcdef", [(0, 1, 3), (4, 2, 5)]) == "a[EMAIL]f"
    assert pickle.loads(pickle.dumps(network)).hidden == pii.HIDDEN


def toxic_rows(n, seed):
    random = np.random.default_rng(seed)
    words = [f"{a}{b}{c}" for a in "bdglmnprst" for b in "aeiou" for c in ("n", "r", "th", "ck", "le")]
    docs, labels = [], []
    for i in range(n):
        w = list(random.choice(words, random.integers(20, 90)))
        bad = random.random() < 0.15
        if bad:
            for _ in range(random.integers(1, 5)):
                w.insert(int(random.integers(0, len(w))), random.choice(["idiot", "zworf" + random.choice(words), "Zworfel!"]))
        docs.append((i, " ".join(w)))
        labels.append((i, int(random.random() < 0.9), int(bad)))
    return docs, labels


def test_toxicity(spark):
    docs, labels = toxic_rows(1500, 8)
    df = spark.createDataFrame([(*d, 1.0, "x") for d in docs] + [(9000, None, 1.0, ""), (9001, "", 1.0, "")], "doc_id long, text string, score double, counts string")
    known = spark.createDataFrame(labels + [(None, 1, 1), (7, 1, None)], "doc_id long, quality int, toxic int")
    model = toxicity.trained(df, known)
    score = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    wrong = [i for i, _, bad in labels if (score[i] >= 0.5) != bad]
    assert len(wrong) <= 0.02 * len(labels) and score[9000] == score[9001] < 0.5
    again = toxicity.trained(df.repartition(7), known.repartition(3))
    assert np.allclose(again.weights, model.weights, atol=1e-6)
    kept = {r.doc_id for r in toxicity.clean(df, model).collect()}
    assert kept == {i for i, s in score.items() if s < 0.5}


def test_toxicity_without_labels(spark):
    df = spark.createDataFrame([(1, "you idiot, you moron"), (2, "kind words")], "doc_id long, text string")
    model = toxicity.trained(df, spark.createDataFrame([], "doc_id long, toxic int"))
    score = {r.doc_id: r.score for r in toxicity.scored(df, model).collect()}
    assert score[1] >= 0.5 > score[2]
    assert toxicity.scored(df.limit(0), model).count() == 0


PAGE = (
    "<!doctype html><html><head><title>t</title><script>var a='<p>x</p>';</script></head><body class='no-sidebar'>"
    "<header><h2>Site</h2></header><nav><ul><li><a href='/'>Home</a></ul></nav><div class=\"cookie-notice\">We use cookies</div>"
    "<article><h1>Title &amp; %d</h1><p>First <b>bold</b>\n  text.<p>Second&nbsp;one<br>next %d<aside>box</aside></p>"
    "<form><input value='>'><label>Mail</label></form></article>"
    "<section id='comments'><article class='comment'>I disagree</article></section><div class=sidebar><p>Popular</p></div>"
    "<footer>&copy; site</footer></body></html>"
)
BARE = "<body><div>Welcome to the same shop on each page</div><div class=x><p>Own words of page %d, all of them.</p></div><div><a href=1>One</a> <a href=2>Two</a></div>"


def test_pages(spark):
    rows = [(k, f"http://A.example.com/{k}", PAGE % (k, k)) for k in range(5)]
    rows += [(10 + k, "https://b.example.com:80/?q", BARE % k) for k in range(6)]
    rows += [(20, None, None), (21, "odd", ""), (22, "http://c.example/x", "just <i>text"), (23, "http://c.example/x", "<article>cut &am"), rows[0]]
    df = spark.createDataFrame([(*r, "x", 1) for r in rows], "page_id long, url string, html string, text string, host int")
    out = {r.page_id: r for r in templates.extracted(df).collect()}
    assert templates.extracted(df).count() == len(rows)
    for k in range(5):
        assert out[k].text == f"Title & {k}\n\nFirst bold text.\n\nSecond one next {k}"
        assert out[k].n_chars == len(out[k].text)
    for k in range(6):
        assert out[10 + k].text == f"Own words of page {k}, all of them."
    assert (out[20].text, out[21].text, out[22].text, out[23].text) == ("", "", "just text", "cut &am")
    assert templates.extracted(df.limit(0)).count() == 0


def test_main_text_of_unbalanced_pages():
    for source in ("<p", "<a href='x>y", "</div></article>", "<script>never ends", "<!-- nor this", "<" * 2000, "<p>" * 3000):
        assert isinstance(templates.main_text(source, None, {}), str)


def test_forgetting_changes_no_ids():
    codec = bpe.Codec(bpe.Vocabulary.read(bpe.public_path()))
    text = "Some words, some wordsΣ 12\n again"
    ids = codec.encode(text)
    assert codec.known and codec.runs
    codec.forget()
    assert not codec.known and not codec.runs and codec.encode(text) == ids


def test_the_sample_is_few_files_whatever_the_shuffle_has(spark, monkeypatch):
    """At most a file for each ``ROWS_OF_A_FILE`` of the sample, on sessions of many partitions too."""
    written, write = [], shared.materialize
    monkeypatch.setattr(shared, "materialize", lambda df, name: written.append(write(df, name)) or written[-1])
    monkeypatch.setattr(toxicity, "ROWS_OF_A_FILE", 30)
    chosen = {"spark.sql.shuffle.partitions": "40", "spark.sql.adaptive.coalescePartitions.enabled": "false"}
    before = {key: spark.conf.get(key) for key in chosen}
    try:
        for key, value in chosen.items():
            spark.conf.set(key, value)
        docs = spark.createDataFrame([(i, f"w{i} x{i} y{i} z{i}") for i in range(200)], "doc_id long, text string")
        toxicity.trained(docs, spark.createDataFrame([(i, i % 2) for i in range(200)], "doc_id long, toxic int"), sample=90)
    finally:
        for key, value in before.items():
            spark.conf.set(key, value)
    assert 0 < written[0].count() <= 90 and len(written[0].inputFiles()) <= 3
