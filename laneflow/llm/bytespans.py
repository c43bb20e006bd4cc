"""Substring de-duplication by bytes, on suffix arrays.

Repeated strings of ``length`` bytes have equal anchors (``winnow``); segments of windows around one
anchor meet by its hash. Equal segments are repeated as a whole. Different segments of one anchor are
laid over each other at the anchor, parts of them whose cores stand alone are left out, runs of
columns in which the same segments agree become one symbol, and the suffix array of all symbols
(``suffixes``) with its common prefixes tells for every start how far it is repeated elsewhere.

Anchors with more than ``group`` different segments (a line that a third of the corpus has, with
different neighbours everywhere) are not brought together: their windows meet one by one by hash,
equal ones collapsed per batch before the shuffle.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from laneflow.llm import arrays, repeats, shared, suffixes, winnow
from laneflow.llm.shared import F

LENGTH = 200
GRAM = 16
#: Different segments of one anchor that come together in one task at most (some 300 bytes each).
GROUP = 65_536
#: Windows told apart by the place of their anchor, so many places at a time.
CORE = 24
#: Bytes of segments that are worked on at once, about.
AT_ONCE = 4 << 20
#: Symbols per suffix array, about.
SYMBOLS = 20_000
SCHEMA = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string"


def sighted(part: pa.RecordBatch, length: int):
    found = []
    doc, tag = part.column("doc").to_numpy(), part.column("tag").to_numpy()
    for rows, data, offsets in arrays.pieces(part):
        codes = arrays.BYTE_CODES[data]
        runs = arrays.Runs(codes)
        s = winnow.segments(codes, offsets, length, min(GRAM, length), runs)
        at = offsets[s.row] + s.first
        digest = runs.hashes(at, at + s.count + length - 1) ^ arrays.mix(s.lead.astype(np.uint64))
        place = repeats.pack(s.first, s.count, s.lead, tag[rows][s.row])
        found.append((s.anchor.view(np.int64), digest.view(np.int64), doc[rows][s.row], place))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 4


def cut_out(part: pa.RecordBatch, length: int) -> pa.RecordBatch:
    """The bytes of the segments that have to be compared."""
    places, bounds = repeats.runs_of_lists(part.column("found"), "place")
    keys, _ = repeats.runs_of_lists(part.column("found"), "key")
    doc = np.repeat(part.column("doc").to_numpy(), np.diff(bounds))
    first = repeats.first_of(places)
    stop = first + repeats.count_of(places) + length - 1
    out, texts = [], part.column("text").cast(pa.large_binary()).to_pylist()
    for i, text in enumerate(texts):
        lo, hi = bounds[i], bounds[i + 1]
        out += [text[a:b] for a, b in zip(first[lo:hi].tolist(), stop[lo:hi].tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(keys, pa.int64()), pa.array(doc, pa.int64()), pa.array(places, pa.int64()), pa.array(out, pa.binary())],
        ["key", "doc", "place", "piece"],
    )


def windows(part: pa.RecordBatch, length: int):
    """A sighting for each window of the segments of crowded anchors."""
    found = []
    doc, tag = part.column("doc").to_numpy(), part.column("tag").to_numpy()
    places, bounds = repeats.runs_of_lists(part.column("found"), "place")
    for rows, data, offsets in arrays.pieces(part):
        mine = places[bounds[rows.start] : bounds[rows.stop]]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds[rows.start : rows.stop + 1]))
        first, count = repeats.first_of(mine), repeats.count_of(mine)
        starts = arrays.ranges(offsets[row] + first, count)
        row = np.repeat(row, count)
        hashes = arrays.Runs(arrays.BYTE_CODES[data]).hashes(starts, starts + length)
        found.append(repeats.single(hashes, doc[rows][row], starts - offsets[row], tag[rows][row]))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 4


def laid_over(pieces: list[bytes], leads: np.ndarray) -> tuple[np.ndarray, np.ndarray, int]:
    """Which earlier piece each piece agrees with per column, and where that changes.

    Columns count from the widest lead; a piece agrees with none outside its bytes.
    """
    m, most = len(pieces), int(leads.max())
    shift = most - leads
    lengths = np.array([len(p) for p in pieces])
    width = int((shift + lengths).max())
    flat = np.frombuffer(b"".join(pieces), np.uint8)
    at = arrays.ranges(np.arange(m) * width + shift, lengths)
    grid = np.full(m * width, 256, np.int64)
    grid[at] = flat
    slot = grid.reshape(m, width) + np.arange(width) * 257
    # Written from the last piece to the first, so the first piece with a byte remains.
    table = np.empty(width * 257, np.int64)
    table[slot[::-1]] = np.arange(m)[::-1, None]
    agree = table[slot]
    alone = grid.reshape(m, width) == 256
    agree[alone] = np.broadcast_to(np.arange(m)[:, None], (m, width))[alone]
    change = np.ones(width, bool)
    change[1:] = (agree[:, 1:] != agree[:, :-1]).any(axis=0) | (alone[:, 1:] != alone[:, :-1]).any(axis=0)
    return agree, np.flatnonzero(change), most


class Sorter:
    """Symbols of groups of aligned strings, sorted in suffix arrays of some ``SYMBOLS`` each.

    A string's symbols stand for runs of its columns; equal symbols are equal runs of one group.
    """

    def __init__(self, length: int):
        self.length = length
        self.parts: list[tuple[np.ndarray, ...]] = []
        self.next, self.groups = 2, 0  # 1 ends a string

    def add(self, group: np.ndarray, string: np.ndarray, symbol: np.ndarray, begin: np.ndarray, end: np.ndarray) -> None:
        """Symbols in order of groups and their strings; groups and symbols count from 0 in each call."""
        if len(symbol):
            self.parts.append((group + self.groups, string, symbol + self.next, begin, end))
            self.next += int(symbol.max()) + 1
            self.groups += int(group[-1]) + 1

    def repeated(self) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """String, first and one past the last column at which a repeated window starts."""
        if not self.parts:
            return (np.zeros(0, np.int64),) * 3
        group, string, symbol, begin, end = map(np.concatenate, zip(*self.parts, strict=True))
        n = len(symbol)
        edges = np.append(np.flatnonzero(group[1:] != group[:-1]) + 1, n)
        cuts = [0]
        while cuts[-1] < n:
            cuts.append(int(edges[min(np.searchsorted(edges, cuts[-1] + SYMBOLS), len(edges) - 1)]))
        best = np.concatenate([longest(string[a:b], symbol[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)])
        closes = np.append(np.flatnonzero(string[1:] != string[:-1]) + 1, n)
        left = closes[np.searchsorted(closes, np.arange(n), side="right")] - np.arange(n)
        reach = np.minimum(best, left)
        upto = np.minimum(end, end[np.arange(n) + np.maximum(reach, 1) - 1] - self.length + 1)
        good = (reach > 0) & (upto > begin)
        return string[good], begin[good], upto[good]


def longest(string: np.ndarray, symbol: np.ndarray) -> np.ndarray:
    """Symbols that each place has in common with the same place of another string, at most."""
    closes = np.flatnonzero(np.append(string[1:] != string[:-1], True))
    at = np.arange(len(symbol)) + np.searchsorted(closes, np.arange(len(symbol)))
    codes = np.ones(len(symbol) + len(closes), np.int64)
    codes[at] = symbol
    codes = codes.tolist()
    order = suffixes.suffix_array(codes)
    prefix = np.array([*suffixes.common_prefixes(codes, order), 0])
    best = np.empty(len(codes), np.int64)
    best[np.array(order)] = np.maximum(prefix[:-1], prefix[1:])
    return best[at]


def runs_of_equal(*columns: np.ndarray) -> np.ndarray:
    """Starts of the runs of equal rows of sorted columns, and the number of rows."""
    new = np.ones(len(columns[0]), bool)
    new[1:] = np.any([c[1:] != c[:-1] for c in columns], axis=0)
    return np.append(np.flatnonzero(new), len(new))


def compare(rows: pa.Table, length: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, first window and number of windows of every repeated range; all rows of a key are here.

    Windows of a key are told apart by the place of the anchor in them, ``CORE`` places at a time.
    All windows of such a part contain its core of ``length - CORE + 1`` bytes, so only parts with
    equal cores can have equal windows; a core that stands alone is done with. Parts that are equal
    as a whole are repeated as a whole, different ones are sorted as suffixes.
    """
    key = rows.column("key").to_numpy()
    place = rows.column("place").to_numpy()
    piece = rows.column("piece").combine_chunks().cast(pa.large_binary())
    offsets = np.frombuffer(piece.buffers()[1], np.int64)[piece.offset : piece.offset + len(piece) + 1]
    data = np.frombuffer(piece.buffers()[2], np.uint8)[offsets[0] : offsets[-1]]
    offsets = offsets - offsets[0]
    lead, count = repeats.lead_of(place), repeats.count_of(place)
    low, high = (lead - count + 1) // CORE, lead // CORE
    row = np.repeat(np.arange(len(key)), high - low + 1)
    part = arrays.ranges(low, high - low + 1)
    least = np.maximum(part * CORE, (lead - count + 1)[row])
    most = np.minimum(part * CORE + CORE - 1, lead[row])
    anchor = offsets[row] + lead[row]
    begin, end = anchor - most, anchor - least + length
    hashes = arrays.Runs(arrays.BYTE_CODES[data])
    core = hashes.hashes(anchor - part * CORE, anchor - part * CORE - CORE + 1 + length)
    core = arrays.mix(core ^ arrays.mix(key.view(np.uint64)[row] + part.astype(np.uint64)))
    whole = hashes.hashes(begin, end) ^ arrays.mix(most.astype(np.uint64))
    order = np.lexsort((row, whole, core))
    row, begin, end, most, core, whole = (x[order] for x in (row, begin, end, most, core, whole))
    bounds = runs_of_equal(core)
    keep = np.repeat(np.diff(bounds) > 1, np.diff(bounds))
    row, begin, end, most, core, whole = (x[keep] for x in (row, begin, end, most, core, whole))
    if not len(row):
        return (np.zeros(0, np.int64),) * 3
    equal = runs_of_equal(core, whole)
    twice = np.repeat(np.diff(equal) > 1, np.diff(equal))
    first = begin - offsets[row]
    out = [(row[twice], first[twice], (end - begin - length + 1)[twice])]
    one = equal[:-1]  # one of each kind is sorted
    row, begin, end, most, core, first = (x[one] for x in (row, begin, end, most, core, first))
    bounds = runs_of_equal(core)
    sizes = np.diff(bounds)
    inner = CORE - 1
    middle = begin + (most % CORE)  # where the core begins
    sorter = Sorter(length)
    two = bounds[:-1][sizes == 2]
    sorter.add(*pairs(data, begin, middle, middle + length - inner, end, two))
    for a, b in zip(bounds[:-1][sizes > 2].tolist(), bounds[1:][sizes > 2].tolist(), strict=True):
        strings = [data[x:y].tobytes() for x, y in zip(begin[a:b].tolist(), end[a:b].tolist(), strict=True)]
        sorter.add(*several(strings, middle[a:b] - begin[a:b], a))
    string, c0, c1 = sorter.repeated()
    out.append((row[string], first[string] + c0, c1 - c0))
    return tuple(map(np.concatenate, zip(*out, strict=True)))


def pairs(data: np.ndarray, begin: np.ndarray, core: np.ndarray, core_end: np.ndarray, end: np.ndarray, at: np.ndarray):
    """Symbols of groups of two strings, ``at`` and the next: what is equal around the core, the rest."""
    x, y = at, at + 1
    grown = []
    for side, room in (
        (-1, np.minimum(core[x] - begin[x], core[y] - begin[y])),
        (1, np.minimum(end[x] - core_end[x], end[y] - core_end[y])),
    ):
        same, k = np.zeros(len(at), np.int64), np.ones(len(at), bool)
        for step in range(int(room.max(initial=0))):
            k &= room > step
            i = np.flatnonzero(k)
            p, q = (core[x] - 1 - step, core[y] - 1 - step) if side < 0 else (core_end[x] + step, core_end[y] + step)
            k[i] = data[p[i]] == data[q[i]]
            same[k] += 1
        grown.append(same)
    string = np.stack([x, y], axis=1).ravel()
    left, right = (np.repeat(g, 2) for g in grown)
    a, b = core[string] - left - begin[string], core_end[string] + right - begin[string]
    size = end[string] - begin[string]
    group = np.repeat(np.arange(len(at)), 2)
    own = np.arange(len(string))
    symbol = np.stack([3 * own, np.repeat(3 * own[::2] + 1, 2), 3 * own + 2], axis=1)
    first = np.stack([0 * a, a, b], axis=1)
    last = np.stack([a, b, size], axis=1)
    used = (last > first).ravel()
    spread = [np.repeat(v, 3)[used] for v in (group, string)]
    return *spread, symbol.ravel()[used], first.ravel()[used], last.ravel()[used]


def several(strings: list[bytes], leads: np.ndarray, number: int):
    """Symbols of one group of strings: runs of columns in which the same strings agree."""
    agree, cuts, most = laid_over(strings, leads)
    ends = np.append(cuts[1:], agree.shape[1])
    m = len(strings)
    shift = most - leads
    sizes = np.array([len(s) for s in strings])
    inside = (cuts >= shift[:, None]) & (ends <= (shift + sizes)[:, None])
    symbol = (agree[:, cuts] + np.arange(len(cuts)) * m)[inside]
    string = np.broadcast_to(np.arange(m)[:, None], inside.shape)[inside]
    begin = (cuts[None, :] - shift[:, None])[inside]
    end = (ends[None, :] - shift[:, None])[inside]
    return np.zeros(len(symbol), np.int64), string + number, symbol, begin, end


def compared(batches: Iterator[pa.RecordBatch], length: int) -> Iterator[pa.RecordBatch]:
    """Repeated ranges of the segments of each key; rows arrive sorted by key.

    Rows are worked on some megabytes at a time; those of one key stay together, ``GROUP`` at most.
    """

    def ready(rows: pa.Table) -> pa.RecordBatch:
        row, first, count = compare(rows, length)
        tag = rows.column("place").to_numpy()[row] >> repeats.TAG << repeats.TAG
        start = repeats.first_of(rows.column("place").to_numpy()[row]) + first
        return pa.RecordBatch.from_arrays(
            [rows.column("doc").combine_chunks().take(pa.array(row)), pa.array(start | (count << repeats.COUNT) | tag)],
            ["doc", "place"],
        )

    held: list[pa.RecordBatch] = []
    for batch in batches:
        for some in shared.parts(batch):
            held.append(some)
            if sum(b.nbytes for b in held) < AT_ONCE:
                continue
            rows = pa.Table.from_batches(held)
            key = rows.column("key").to_numpy()
            cut = int(np.searchsorted(key, key[-1])) if (key[:-1] <= key[1:]).all() else len(key)
            if cut:
                yield ready(rows.slice(0, cut))
                held = rows.slice(cut).to_batches()
    if held:
        yield ready(pa.Table.from_batches(held))


def removed(part: pa.RecordBatch, length: int) -> pa.RecordBatch:
    places, bounds = repeats.runs_of_lists(part.column("found"), "place")
    sizes, gone, spans, digests = [], [], [], []
    for rows, data, offsets in arrays.pieces(part):
        mine = places[bounds[rows.start] : bounds[rows.stop]]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds[rows.start : rows.stop + 1]))
        begin = offsets[row] + repeats.first_of(mine)
        cover = arrays.covered(begin, begin + repeats.count_of(mine) + length - 1, len(data))
        opens = cover.copy()
        before = np.append(False, cover)[:-1] if len(cover) else cover
        inner = np.zeros(len(data) + 1, bool)
        inner[offsets] = True
        opens &= ~before | inner[:-1]
        covered_before = np.concatenate([[0], np.cumsum(cover)])[offsets]
        spans.append(np.diff(np.concatenate([[0], np.cumsum(opens)])[offsets]))
        kept = data[~cover].tobytes()
        cuts = (offsets - covered_before).tolist()
        digests += [shared.hex_digest(kept[a:b]) for a, b in zip(cuts[:-1], cuts[1:], strict=True)]
        sizes.append(np.diff(offsets))
        gone.append(np.diff(covered_before))
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            *(pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for x in (sizes, gone, spans)),
            pa.array(digests, pa.string()),
        ],
        ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"],
    )


def covered_ranges(rows: DataFrame, length: int, group: int) -> DataFrame:
    """``doc, tag, found``: ranges of windows of each row that also start elsewhere."""
    first = repeats.judged(repeats.sightings(rows, lambda part: sighted(part, length), False), False)
    first = shared.materialize(repeats.by_row(first, "key", "covered", "others"), "byte-segments")

    def asking(condition) -> DataFrame:
        some = first.select("doc", "tag", F.filter("found", condition).alias("found")).filter("size(found) > 0")
        return repeats.with_texts(rows, some, "inner")

    pieces = shared.per_batch(
        asking(lambda x: (x["others"] > 0) & (x["others"] <= group)),
        lambda part: cut_out(part, length),
        "key long, doc long, place long, piece binary",
    )
    ranges = (
        pieces.repartition("key")
        .sortWithinPartitions("key", "doc", "place")
        .mapInArrow(lambda batches: compared(batches, length), "doc long, place long")
    )
    crowded = repeats.sightings(asking(lambda x: x["others"] > group), lambda part: windows(part, length), False)
    single = repeats.judged(crowded, False).filter("covered").select("doc", "place")
    known = first.select("doc", F.explode(F.filter("found", lambda x: x["covered"])).alias("x")).select("doc", "x.place")
    return repeats.by_row(known.unionByName(ranges).unionByName(single))


def deduplicated(docs: DataFrame, length: int = LENGTH, group: int = GROUP) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` for every row.

    A byte goes if a string of ``length`` bytes over it also starts anywhere else, in the same row
    or another; a row that is repeated counts as often as it stands. Null text is empty. Extra
    columns are ignored.
    """
    if not CORE <= length < 255 + GRAM:
        raise ValueError("a segment has 255 windows at most, and a window the bytes of a core")
    rows = repeats.named(docs)
    texts = repeats.with_texts(rows, covered_ranges(rows, length, group), "left").select(
        F.when(F.col("doc") != repeats.NO_ID, F.col("doc")).alias("doc_id"), "text", "found"
    )
    return shared.per_batch(texts, lambda part: removed(part, length), SCHEMA)


def op2_suffixes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated strings of 200 bytes over every whole text of ``documents``."""
    return deduplicated(shared.table(spark, sf_dir, "documents"))
