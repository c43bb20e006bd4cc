"""Byte-pair encoding by a priority queue of merge ranks, and decoding.

Each piece of a text starts as a doubly linked list of symbols. A heap holds every adjacent pair
that a merge rule names, by (rank, place). The least entry is merged if its two symbols still stand
as they did when it was pushed (stale entries are skipped), and the pairs with its new neighbours
are pushed. Decoding concatenates the vocabulary's strings and maps them back to bytes.

The vocabulary file is a parameter; it is read on the driver (a few megabytes at any corpus size)
and shipped to the tasks. Supported are files of byte-level BPE with a normalizer and a splitting
pattern, with or without an end-of-word suffix.
"""

from __future__ import annotations

import heapq
import json
import re
import sys
import unicodedata
from array import array
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import chain

import numpy as np
import public_tokenizers
import pyarrow as pa
import regex
from pyspark.sql import DataFrame, SparkSession

from laneflow.llm import shared

#: Pieces, and runs between spaces, whose ids a Python worker remembers at most (some 200 bytes each).
#: The memory is emptied when it is full and at the end of a task, so that later stages of the same worker
#: don't pay for it; results don't depend on it.
REMEMBERED = 500_000
#: Letters and numbers of Unicode 16 that this Python's tables (15.1) lack; the library has them.
NEWER = (
    (0x1C89, 0x1C8A), (0xA7CB, 0xA7CD), (0xA7DA, 0xA7DC), (0x105C0, 0x105F3), (0x10D40, 0x10D65),
    (0x10D6F, 0x10D85), (0x10EC2, 0x10EC4), (0x11380, 0x11389), (0x1138B, 0x1138B), (0x1138E, 0x1138E),
    (0x11390, 0x113B5), (0x113B7, 0x113B7), (0x113D1, 0x113D1), (0x113D3, 0x113D3), (0x116D0, 0x116E3),
    (0x11BC0, 0x11BE0), (0x11BF0, 0x11BF9), (0x13460, 0x143FA), (0x16100, 0x1611D), (0x16130, 0x16139),
    (0x16D40, 0x16D6C), (0x16D70, 0x16D79), (0x18CFF, 0x18CFF), (0x1CCF0, 0x1CCF9), (0x1E5D0, 0x1E5ED),
    (0x1E5F0, 0x1E5FA),
)
#: Lower case of capitals that this Python's tables lack, as (first, last, first's lower case).
NEWER_LOWER = (
    (0x1C89, 0x1C89, 0x1C8A), (0xA7CB, 0xA7CB, 0x264), (0xA7CC, 0xA7CC, 0xA7CD), (0xA7CE, 0xA7CE, 0xA7CF),
    (0xA7D2, 0xA7D2, 0xA7D3), (0xA7D4, 0xA7D4, 0xA7D5), (0xA7DA, 0xA7DA, 0xA7DB), (0xA7DC, 0xA7DC, 0x19B),
    (0x10D50, 0x10D65, 0x10D70), (0x16EA0, 0x16EB8, 0x16EBB),
)
LOWER = {i: x + i - a for a, b, x in NEWER_LOWER for i in range(a, b + 1) if chr(i).lower() == chr(i)}
SCHEMA = "doc_id long, n_tokens long, ids array<int>, decoded string"


def byte_letters() -> list[str]:
    """The printable letter that byte-level vocabularies write for each byte.

    Printable Latin-1 bytes stand for themselves, the others follow from U+0100 on in order.
    """
    plain = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    rest = iter(range(0x100, 0x200))
    return [chr(b) if b in plain else chr(next(rest)) for b in range(256)]


def unassigned() -> str:
    """Ranges of code points that ``regex`` takes for letters or numbers and the library doesn't."""
    letter = regex.compile(r"[\p{L}\p{N}]")
    newer = {i for a, b in NEWER for i in range(a, b + 1)}
    found = [
        i
        for i in range(sys.maxunicode + 1)
        if i not in newer and unicodedata.category(chr(i)) == "Cn" and letter.match(chr(i))
    ]
    out: list[list[int]] = []
    for i in found:
        if out and out[-1][1] == i - 1:
            out[-1][1] = i
        else:
            out.append([i, i])
    return "".join(f"{chr(a)}-{chr(b)}" for a, b in out)


@dataclass(frozen=True)
class Vocabulary:
    ids: dict[str, int]
    ranks: dict[tuple[str, str], int]
    special: dict[str, int]
    suffix: str
    unknown: str | None
    pattern: str
    steps: tuple[tuple[str, ...], ...]
    unassigned: str
    key: str

    @classmethod
    def read(cls, path: str) -> Vocabulary:
        with open(path, encoding="utf-8") as file:
            told = json.load(file)
        model = told["model"]
        if model["type"] != "BPE" or model.get("continuing_subword_prefix") or model.get("byte_fallback"):
            raise ValueError("only byte-level BPE without prefixes or byte fallback is supported")
        normalizer = told.get("normalizer") or {"type": "Sequence", "normalizers": []}
        steps = []
        for step in normalizer.get("normalizers", [normalizer]):
            if step["type"] == "Replace":
                steps.append(("Replace", step["pattern"]["Regex"], step["content"]))
            elif step["type"] in ("NFC", "NFD", "NFKC", "NFKD", "Lowercase"):
                steps.append((step["type"],))
            else:
                raise ValueError(f"unknown normalizer {step['type']}")
        splits = [x for x in told["pre_tokenizer"]["pretokenizers"] if x["type"] == "Split"]
        if [x["behavior"] for x in splits] != ["Removed"] or not splits[0]["invert"]:
            raise ValueError("one splitting pattern that keeps its matches is supported")
        merges = (tuple(m) if isinstance(m, list) else tuple(m.split(" ")) for m in model["merges"])
        return cls(
            ids=model["vocab"],
            ranks={pair: rank for rank, pair in enumerate(merges)},
            special={x["content"]: x["id"] for x in told["added_tokens"]},
            suffix=model.get("end_of_word_suffix") or "",
            unknown=model.get("unk_token"),
            pattern=splits[0]["pattern"]["Regex"],
            steps=tuple(steps),
            unassigned=unassigned(),
            key=path,
        )


def merged(symbols: list[str], ranks: dict[tuple[str, str], int]) -> list[str]:
    """Apply the merge rules, least rank first and leftmost among equals."""
    n = len(symbols)
    before, after = list(range(-1, n - 1)), [*range(1, n), -1]
    queue = [
        (rank, i, symbols[i], symbols[i + 1])
        for i in range(n - 1)
        if (rank := ranks.get((symbols[i], symbols[i + 1]))) is not None
    ]
    heapq.heapify(queue)
    while queue:
        _, i, left, right = heapq.heappop(queue)
        j = after[i]
        if j < 0 or symbols[i] != left or symbols[j] != right:
            continue
        symbols[i], symbols[j] = left + right, ""
        after[i] = k = after[j]
        if k >= 0:
            before[k] = i
        for a, b in ((before[i], i), (i, k)):
            if a >= 0 and b >= 0 and (rank := ranks.get((symbols[a], symbols[b]))) is not None:
                heapq.heappush(queue, (rank, a, symbols[a], symbols[b]))
    return [s for s in symbols if s]


class Codec:
    """Encodes and decodes single texts; made once per task."""

    def __init__(self, vocabulary: Vocabulary):
        self.v = vocabulary
        self.letters = byte_letters()
        self.split = regex.compile(vocabulary.pattern)
        self.odd = regex.compile(f"[{vocabulary.unassigned}]")
        classes = {f"\\p{{{c}}}": f"[\\p{{{c}}}--[{vocabulary.unassigned}]]" for c in "LN"}
        strict = regex.sub(r"\\p\{[LN]\}", lambda m: classes[m.group()], vocabulary.pattern)
        self.split_odd = regex.compile(strict, regex.V1)
        special = sorted(vocabulary.special, key=len, reverse=True)
        self.special = re.compile("|".join(map(re.escape, special))) if special else None
        self.steps = [(s[0], regex.compile(s[1]), s[2]) if s[0] == "Replace" else s for s in vocabulary.steps]
        self.known: dict[str, tuple[int, ...]] = {}
        self.runs: dict[str, bytes] = {}
        bytes_of = {letter: bytes([b]) for b, letter in enumerate(self.letters)}
        named = vocabulary.ids | vocabulary.special
        self.strings = [""] * (max(named.values()) + 1)
        for string, i in named.items():
            self.strings[i] = string
        self.bytes_of = bytes_of

    def forget(self) -> None:
        """Drop the ids of pieces and runs seen so far."""
        self.known, self.runs = {}, {}

    def normal(self, text: str) -> str:
        for kind, *more in self.steps:
            if kind == "Replace":
                text = more[0].sub(more[1], text)
            elif kind == "Lowercase":
                text = lower(text)
            else:
                text = unicodedata.normalize(kind, text)
        return text

    def piece(self, piece: str) -> tuple[int, ...]:
        ids = self.known.get(piece)
        if ids is None:
            symbols = [self.letters[b] for b in piece.encode()]
            symbols[-1] += self.v.suffix
            unknown = self.v.ids.get(self.v.unknown) if self.v.unknown else None
            found = (self.v.ids.get(s, unknown) for s in merged(symbols, self.v.ranks))
            ids = tuple(x for x in found if x is not None)
            if len(self.known) >= REMEMBERED:
                self.known.clear()
            self.known[piece] = ids
        return ids

    def chunk(self, chunk: str) -> bytes:
        """Ids of a run without spaces or special tokens, as 32-bit integers."""
        text = self.normal(chunk)
        split = self.split if text.isascii() or not self.odd.search(text) else self.split_odd
        ids = array("I", chain.from_iterable(self.piece(p) for p in split.findall(text))).tobytes()
        if len(self.runs) >= REMEMBERED:
            self.runs.clear()
        self.runs[chunk] = ids
        return ids

    def ordinary(self, text: str) -> bytes:
        """Ids of a text without special tokens. No piece and no step of the normalizer reaches over
        a space or line feed, so the runs between them are encoded one by one and remembered."""
        known, chunk = self.runs.get, self.chunk
        return b"".join([known(c) or chunk(c) for c in text.replace("\n", " ").split(" ") if c])

    def encode(self, text: str) -> bytes:
        """Ids of the text, four bytes each; strings of special tokens inside it become those tokens."""
        if not self.special or not self.special.search(text):
            return self.ordinary(text)
        out, start = [], 0
        for m in self.special.finditer(text):
            out += [self.ordinary(text[start : m.start()]), array("I", [self.v.special[m.group()]]).tobytes()]
            start = m.end()
        return b"".join([*out, self.ordinary(text[start:])])

    def decode(self, ids: bytes) -> str:
        """Vocabulary strings one after another, special tokens included.

        Without a decoder in the file the strings are joined by one space, as they stand.
        """
        return " ".join(map(self.strings.__getitem__, memoryview(ids).cast("I")))

    def plain(self, ids: bytes) -> str:
        """The text that the ids spell: letters back to bytes, word ends as spaces."""
        out = "".join(map(self.strings.__getitem__, memoryview(ids).cast("I")))
        words = out.split(self.v.suffix) if self.v.suffix else [out]
        spelled = (b"".join([self.bytes_of.get(c, c.encode()) for c in w]) for w in words)
        return b" ".join(spelled).decode("utf-8", "replace").strip()


def lower(text: str) -> str:
    """Lower case letter by letter, without the final form of sigma."""
    if text.isascii():
        return text.lower()
    return ("".join([c.lower() for c in text]) if "Σ" in text else text.lower()).translate(LOWER)


_CODECS: dict[int, Codec] = {}


def codec_of(shipped) -> Codec:
    """The codec of a Python worker, made once from the broadcast vocabulary and kept over tasks."""
    if shipped.value.key not in _CODECS:
        _CODECS.clear()
        _CODECS[shipped.value.key] = Codec(shipped.value)
    return _CODECS[shipped.value.key]


def encode_decode(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_tokens, ids, decoded`` for every document.

    Null and empty texts have no ids and decode to the empty text. Nothing is truncated, rows
    repeat as they are repeated in the input, and extra columns are ignored.
    """
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shipped)
        try:
            for batch in batches:
                for part in shared.parts(batch):
                    ids = [codec.encode(t) for t in shared.texts(part)]
                    sizes = np.array([len(x) // 4 for x in ids], np.int64)
                    flat = pa.array(np.frombuffer(b"".join(ids), np.uint32).astype(np.int32))
                    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), flat)
                    decoded = pa.array([codec.decode(x) for x in ids], pa.string())
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(sizes), lists, decoded], ["doc_id", "n_tokens", "ids", "decoded"]
                    )
        finally:
            codec.forget()

    return shared.id_and_text(docs).mapInArrow(run, SCHEMA)


def digests(docs: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """``doc_id, n_tokens, ids_sha256, decoded_sha256`` of every document, by ``encode_decode``'s rules."""
    shipped = docs.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = codec_of(shipped)
        try:
            for batch in batches:
                for part in shared.parts(batch):
                    counts, ids_hex, text_hex = [], [], []
                    for text in shared.texts(part):
                        ids = codec.encode(text)
                        counts.append(len(ids) // 4)
                        text_hex.append(shared.hex_digest(codec.decode(ids).encode()))
                        ids_hex.append(shared.hex_digest(np.frombuffer(ids, np.uint32).astype("<u4").tobytes()))
                    yield pa.RecordBatch.from_arrays(
                        [part.column("doc_id"), pa.array(counts, pa.int64()), pa.array(ids_hex), pa.array(text_hex)],
                        ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"],
                    )
        finally:
            codec.forget()

    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string"
    return shared.id_and_text(docs).mapInArrow(run, schema)


def public_path(name: str = "word_bpe_49k.json") -> str:
    """Where the public vocabulary lies on the driver."""
    return str(public_tokenizers.path(name))


def op10_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every whole text of ``documents`` encoded and decoded."""
    return digests(shared.table(spark, sf_dir, "documents"), Vocabulary.read(public_path()))
