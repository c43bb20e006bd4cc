"""Benchmark decontamination: containment search with MinHash in size partitions.

Items fall into partitions by their number of distinct five-word shingles: up to 1, 2, 4, 8 and so on.
For the partition of up to ``u`` shingles a document is cut into windows of ``2 u`` shingles that
begin every ``u``, so an item always meets windows of its own size, however long the document is.
Item and window are sketched by the least hash in each of ``BINS * u`` bins. They are candidates if
they agree in one bin; with that many bins nearly every shingle is the least of its own, so an item of
which 0.8 stand in a document is found practically always (missing one takes a smaller hash in the
bin of each of its shared shingles). Sketches of up to ``DIRECT`` shingles are too small for that: their
hashes are looked up in the whole document. Candidates are verified by exact containment.

Items are handled in blocks of a bounded number of shingles, hence each broadcast is bounded; a
document is read once per block. Documents are neither shuffled nor collected.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from laneflow.llm import arrays, shared
from laneflow.llm.shared import F

SHINGLE = 5
LEAST = 0.8
#: Bins for each shingle of a partition's largest item.
BINS = 4
#: Largest partition whose sketch hashes make a candidate wherever they stand, without a bin's rivals.
DIRECT = 8
#: Words of the items of a block, about; 8 bytes of a broadcast each.
BLOCK_WORDS = 1 << 21
#: Bytes of words: letters and digits, and all of other alphabets.
LETTERS = np.zeros(256, bool)
LETTERS[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
PAIRS = "item_id long, doc_id long, n_shared long, n_shingles long"


def word_codes(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the words (runs of letters and digits, A-Z lower-cased) and words before each row."""
    inside = np.zeros(len(data) + 1, bool)
    inside[1:] = LETTERS[data]
    before = inside.copy()
    before[offsets] = False
    starts = np.flatnonzero(inside[1:] & ~before[:-1])
    after = np.append(inside[1:], False)
    after[offsets] = False
    ends = np.flatnonzero(inside[1:] & ~after[1:]) + 1
    upper = (data >= 65) & (data <= 90)
    codes = arrays.Runs(arrays.BYTE_CODES[data | (upper.astype(np.uint8) << 5)]).hashes(starts, ends)
    return codes, np.searchsorted(starts, offsets, side="left")


@dataclass(frozen=True)
class Items:
    """A block of items. Shingles and sketches are sorted hashes with the items that have them."""

    ids: np.ndarray
    sizes: np.ndarray  # distinct shingles
    classes: np.ndarray  # largest size of the item's partition
    widths: np.ndarray  # words of a shingle: five, or all of a shorter item
    shingles: np.ndarray
    of_shingle: np.ndarray
    sketch: np.ndarray
    of_sketch: np.ndarray


def bin_of(hashes: np.ndarray, size: int) -> np.ndarray:
    return (hashes >> np.uint64(32)) * np.uint64(BINS * size) >> np.uint64(32)


def least_per_bin(hashes: np.ndarray, size: int) -> np.ndarray:
    """The sketch of a set of distinct hashes: the least of each bin that has any."""
    hashes = np.sort(hashes)
    _, at = np.unique(bin_of(hashes, size), return_index=True)
    return hashes[at]


def items_of(ids: list, texts: list[str]) -> Items:
    batch = pa.RecordBatch.from_arrays([pa.array(texts, pa.string())], ["text"])
    found = []
    for rows_, data, offsets in arrays.pieces(batch):
        codes, before = word_codes(data, offsets)
        runs = arrays.Runs(codes)
        for i in range(len(offsets) - 1):
            lo, hi = int(before[i]), int(before[i + 1])
            if hi > lo:
                width = min(SHINGLE, hi - lo)
                starts = np.arange(lo, hi - width + 1)
                found.append((ids[rows_.start + i], width, np.unique(runs.hashes(starts, starts + width))))
    sizes = np.array([len(h) for _, _, h in found], np.int64)
    classes = np.array([1 << int(n - 1).bit_length() for n in sizes], np.int64)
    sketches = [least_per_bin(h, int(u)) for (_, _, h), u in zip(found, classes, strict=True)]

    def table(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
        values = np.concatenate([*sets, np.zeros(0, np.uint64)])
        owner = np.repeat(np.arange(len(sets)), [len(s) for s in sets])
        order = np.argsort(values, kind="stable")
        return values[order], owner[order]

    return Items(
        np.array([i for i, _, _ in found], object), sizes, classes, np.array([w for _, w, _ in found], np.int64),
        *table([h for _, _, h in found]), *table(sketches),
    )


def members(values: np.ndarray, table: np.ndarray, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place in ``values`` and owner, for every owner of every value that the table has."""
    lo = np.searchsorted(table, values, side="left")
    n = np.searchsorted(table, values, side="right") - lo
    return np.repeat(np.arange(len(values)), n), owner[arrays.ranges(lo, n)]


def candidates(hashes: np.ndarray, begin: np.ndarray, width: int, items: Items) -> np.ndarray:
    """(row, item) pairs that agree in a bin of one of the row's windows, or in a hash if small; sorted, each once.

    ``hashes[begin[r]:begin[r + 1]]`` are the shingles of row ``r``. Only shingles that stand in some
    item's sketch can agree, so only the windows around those are sketched.
    """
    hit = np.flatnonzero(np.isin(hashes, items.sketch)) if len(items.sketch) else np.zeros(0, np.int64)
    at, item = members(hashes[hit], items.sketch, items.of_sketch)
    keep = items.widths[item] == width
    at, item = hit[at[keep]], item[keep]
    row = np.searchsorted(begin, at, side="right") - 1
    agreed = items.classes[item] <= DIRECT
    rest = np.flatnonzero(~agreed)
    for k, p, i, r in zip(rest.tolist(), at[rest].tolist(), item[rest].tolist(), row[rest].tolist(), strict=True):
        u, lo, hi = int(items.classes[i]), int(begin[r]), int(begin[r + 1])
        w = (p - lo) // u
        for first in {max(0, w - 1), w}:
            window = hashes[lo + first * u : min(hi, lo + (first + 2) * u)]
            rivals = window[bin_of(window, u) == bin_of(hashes[p : p + 1], u)]
            if rivals.min() == hashes[p]:
                agreed[k] = True
                break
    return np.unique(np.stack([row[agreed], item[agreed]], axis=1), axis=0)


def found_in(part: pa.RecordBatch, items: Items, least: float) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row, item and number of shared shingles of every verified pair of a batch."""
    out = []
    for rows, data, offsets in arrays.pieces(part):
        codes, before = word_codes(data, offsets)
        runs = arrays.Runs(codes)
        for width in np.unique(items.widths).tolist():
            n = np.maximum(np.diff(before) - width + 1, 0)
            starts = arrays.ranges(before[:-1], n)[: int(n.sum())]
            hashes = runs.hashes(starts, starts + width)
            begin = np.concatenate([[0], np.cumsum(n)])
            pairs = candidates(hashes, begin, width, items)
            for r in np.unique(pairs[:, 0]):
                _, owner = members(np.unique(hashes[begin[r] : begin[r + 1]]), items.shingles, items.of_shingle)
                both = np.bincount(owner, minlength=len(items.sizes))
                asked = pairs[pairs[:, 0] == r, 1]
                good = asked[(both[asked] >= least * items.sizes[asked]) & (items.widths[asked] == width)]
                out.append(np.stack([np.full(len(good), rows.start + r), good, both[good]], axis=1))
    found = np.concatenate([*out, np.zeros((0, 3), np.int64)])
    return found[:, 0], found[:, 1], found[:, 2]


def blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[Items]:
    """The items, block by block; a row is dealt to its block by hash."""
    rows = items.select(
        F.col("item_id").cast("long").alias("item_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text")
    )
    words = rows.agg(F.sum(F.length("text") - F.length(F.translate("text", " \n\t", "")) + 1)).first()[0] or 0
    n = int(words // block_words) + 1
    for b in range(n):
        some = rows.filter(F.pmod(F.xxhash64("item_id", "text"), F.lit(n)) == b).orderBy("item_id", "text").collect()
        yield items_of([r.item_id for r in some], [r.text for r in some])


def pairs(docs: DataFrame, items: DataFrame, least: float = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """``item_id, doc_id, n_shared, n_shingles`` where ``n_shared >= least * n_shingles``.

    Shingles are distinct. An item of fewer than five words is one shingle of all its words; items
    and documents without words match nothing, nor do null texts. Repeated rows give repeated pairs;
    extra columns are ignored.
    """
    spark, rows = docs.sparkSession, shared.id_and_text(docs)
    out = spark.createDataFrame([], PAIRS)
    for block in blocks(items, block_words):
        out = out.unionByName(shared.per_batch(rows, _pair_finder(spark.sparkContext.broadcast(block), least), PAIRS))
    return out


def _pair_finder(shipped, least: float) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def find(part: pa.RecordBatch) -> pa.RecordBatch:
        items = shipped.value
        row, item, n = found_in(part, items, least)
        return pa.RecordBatch.from_arrays(
            [
                pa.array(items.ids[item].tolist(), pa.int64()),
                part.column("doc_id").take(pa.array(row)),
                pa.array(n),
                pa.array(items.sizes[item]),
            ],
            ["item_id", "doc_id", "n_shared", "n_shingles"],
        )

    return find


def clean(docs: DataFrame, items: DataFrame, least: float = LEAST, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of ``docs``, all columns, that hold no item."""
    for block in blocks(items, block_words):
        docs = shared.per_batch(docs, _cleaner(docs.sparkSession.sparkContext.broadcast(block), least), docs.schema)
    return docs


def _cleaner(shipped, least: float) -> Callable[[pa.RecordBatch], pa.RecordBatch]:
    def keep(part: pa.RecordBatch) -> pa.RecordBatch:
        mask = np.ones(part.num_rows, bool)
        mask[found_in(part, shipped.value, least)[0]] = False
        return part.filter(pa.array(mask))

    return keep


def op5_containment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every item of ``benchmark`` in every whole text of ``documents``."""
    return pairs(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[0-9a-z\\x{{80}}-\\x{{10FFFF}}]+')"


def _shingles(table: str, key: str) -> str:
    return f"""
  SELECT DISTINCT {key}, k, array_to_string(w[i : i + k - 1], ' ') AS shingle
  FROM (SELECT {key}, w, k, unnest(range(1, len(w) - k + 2)) AS i FROM
    (SELECT {key}, {_WORDS} AS w FROM {table}), widths WHERE len(w) >= k)"""


SQL = f"""
WITH widths AS (SELECT unnest(range(1, {SHINGLE + 1})) AS k),
asked AS (SELECT item_id, least({SHINGLE}, len({_WORDS})) AS k FROM benchmark),
q AS (SELECT s.* FROM ({_shingles("benchmark", "item_id")}) s JOIN asked USING (item_id, k)),
d AS ({_shingles("documents", "doc_id")}),
sizes AS (SELECT item_id, count(*) AS n_shingles FROM q GROUP BY item_id)
SELECT item_id, doc_id, count(*) AS n_shared, any_value(n_shingles) AS n_shingles
FROM q JOIN d USING (k, shingle) JOIN sizes USING (item_id)
GROUP BY item_id, doc_id HAVING count(*) >= {LEAST} * any_value(n_shingles)
"""
