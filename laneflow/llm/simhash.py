"""SimHash near-duplicates by a grid over segment bit counts.

A fingerprint of 64 bits is cut into segments of two bits; the vector of their bit counts is its
place. Distances between places (Manhattan) never exceed the number of differing bits. A count in
0..2 written in unary (00, 01, 11) keeps its segment's two bits, so a place is 64 bits again and a
Manhattan distance is the number of differing unary bits.

Grids: the segments fall into ``g`` groups, more than ``bits``. Two places at a distance of ``bits`` or
less agree in all counts of at least ``g - bits`` groups, so they share a cell of the grid over those
groups; there is one grid for each choice of them. More groups make more copies of a fingerprint and
far fewer fingerprints a cell, so ``groups_for`` takes the number of groups that costs least for the
number of fingerprints at hand; the links found are the same with any. Fingerprints of one
cell are compared by Manhattan distance first and, within the bound, exactly. Cells of more than
``block`` fingerprints are cut into blocks and each pair of blocks is a group of its own. A group
reports its components as stars, never all pairs; the stars meet in ``components``.
"""

from __future__ import annotations

import math
from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame, SparkSession

from laneflow.llm import arrays, components, shared
from laneflow.llm.shared import F

BITS = 4
SHINGLE = 4
SEED = 42
#: Fingerprints of a cell that are compared in one task at most; a larger cell is cut.
BLOCK = 32_768
#: Comparisons that a fingerprint's copy in one more grid counts for.
COPY = 1_000
#: Chance that two unlike segments have one count: 1/16 + 1/4 + 1/16.
SAME = 0.375
#: Comparisons made at once.
AT_ONCE = 1 << 20
LOW = 0x5555555555555555
#: Stands for a null id, smaller than all others.
NO_ID = -(1 << 63)


def fingerprints(docs: DataFrame, shingle: int = SHINGLE) -> DataFrame:
    """``doc_id, fp``: one signed 64-bit fingerprint per row; no words: zero."""
    return shared.per_batch(shared.id_and_text(docs), lambda part: fingerprint_batch(part, shingle), "doc_id long, fp long")


def fingerprint_batch(part: pa.RecordBatch, shingle: int) -> pa.RecordBatch:
    out = [fingerprint_rows(data, offsets, shingle) for _, data, offsets in arrays.pieces(part)]
    values = np.concatenate(out) if out else np.zeros(0, np.int64)
    kept = [name for name in part.schema.names if name != "text"]
    return pa.RecordBatch.from_arrays([*map(part.column, kept), pa.array(values)], [*kept, "fp"])


def fingerprint_rows(data: np.ndarray, offsets: np.ndarray, shingle: int) -> np.ndarray:
    starts, ends, before = arrays.words(data, offsets)
    upper = (data >= 65) & (data <= 90)
    small = data | (upper.astype(np.uint8) << 5)
    # The words with one space after each, in one run of bytes.
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths + 1)])
    plain = np.full(int(at[-1]), 0x20, np.uint8)
    plain[arrays.ranges(at[:-1], lengths)] = small[arrays.ranges(starts, lengths)]
    plain, begin, stop = plain.tobytes(), at[:-1], at[1:] - 1
    out = np.zeros(len(offsets) - 1, np.uint64)
    weights = np.uint64(1) << np.arange(64, dtype=np.uint64)
    hashed = xxhash.xxh64_intdigest
    for row in np.flatnonzero(np.diff(before)):
        lo, hi = int(before[row]), int(before[row + 1])
        width = min(shingle, hi - lo)
        first, last = begin[lo : hi - width + 1].tolist(), stop[lo + width - 1 : hi].tolist()
        h = np.array([hashed(plain[a:b], SEED) for a, b in zip(first, last, strict=True)], np.uint64)
        ones = np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
        out[row] = weights[2 * ones > len(h)].sum()
    return out.view(np.int64)


def place(fp: Column) -> Column:
    """Counts of the 2-bit segments in unary: the lower bit is set if any is, the higher if both are."""
    other = F.shiftrightunsigned(fp, 1)
    either = fp.bitwiseOR(other).bitwiseAND(F.lit(LOW))
    both = fp.bitwiseAND(other).bitwiseAND(F.lit(LOW))
    return either.bitwiseOR(F.shiftleft(both, 1))


def grid_masks(bits: int, groups: int) -> list[int]:
    """Masks over the unary counts, one per choice of ``groups - bits`` groups; as signed 64-bit values."""
    masks = [0] * groups
    for segment in range(32):
        masks[segment * groups // 32] |= 3 << (2 * segment)
    chosen = [sum(c) for c in combinations(masks, groups - bits)]
    return [m - (1 << 64) if m >> 63 else m for m in chosen]


def groups_for(count: int, bits: int) -> int:
    """Groups with the least cost a fingerprint: its copies, and its comparisons in all grids."""

    def cost(groups: int) -> float:
        apart = (groups - bits) * 32 // groups
        return math.comb(groups, bits) * (COPY + count * SAME**apart)

    return min(range(bits + 1, max(bits + 2, min(2 * bits, 32) + 1)), key=cost)


def cells(prints: DataFrame, bits: int, block: int, groups: int) -> DataFrame:
    """``grid, cell, i, j, own, fp``: each fingerprint in its cell of every grid, cut into blocks."""
    placed = prints.withColumn("place", place(F.col("fp")))
    masks = grid_masks(bits, groups)
    grids = F.array(*(F.struct(F.lit(g).alias("grid"), F.col("place").bitwiseAND(F.lit(m)).alias("cell")) for g, m in enumerate(masks)))
    dealt = placed.select("fp", F.explode(grids).alias("x")).select("x.grid", "x.cell", "fp")
    sizes = dealt.groupBy("grid", "cell").agg(F.count("*").alias("n")).filter("n > 1")
    own = F.pmod(F.xxhash64("fp"), "blocks")
    return (
        dealt.join(sizes, ["grid", "cell"])
        .withColumn("blocks", F.ceil(F.col("n") / block).cast("long"))
        .withColumn("own", own)
        .withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
        .select("grid", "cell", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", "fp")
    )


def links(prints: DataFrame, bits: int, block: int, groups: int) -> DataFrame:
    """``a, b``: links that join all distinct fingerprints ``fp`` at a distance of ``bits`` or less."""
    grouped = cells(prints, bits, block, groups).groupBy("grid", "cell", "i", "j")
    return grouped.applyInArrow(lambda table: stars(table, bits), "a long, b long")


def stars(table: pa.Table, bits: int) -> pa.Table:
    """Components of the fingerprints of one cell (or pair of blocks), as edges to their least member."""
    fp = np.sort(table.column("fp").to_numpy()).view(np.uint64)
    label = linked(fp, bits)
    moved = label != np.arange(len(fp))
    return pa.table({"a": fp[moved].view(np.int64), "b": fp[label[moved]].view(np.int64)})


def unary(fp: np.ndarray) -> np.ndarray:
    low = np.uint64(LOW)
    other = fp >> np.uint64(1)
    return ((fp | other) & low) | ((fp & other & low) << np.uint64(1))


def linked(fp: np.ndarray, bits: int) -> np.ndarray:
    """Least index that each fingerprint reaches through links among those given."""
    n = len(fp)
    label, places = np.arange(n), unary(fp)
    rows = max(1, AT_ONCE // max(n, 1))
    for lo in range(0, n, rows):
        hi = min(n, lo + rows)
        near = np.bitwise_count(places[lo:hi, None] ^ places[None, lo:]) <= bits
        i, j = np.nonzero(near)
        keep = (j > i) & (np.bitwise_count(fp[lo + i] ^ fp[lo + j]) <= bits)
        i, j = i[keep] + lo, j[keep] + lo
        cuts = np.flatnonzero(np.diff(i)) + 1
        for a, b in zip([0, *cuts], [*cuts, len(i)], strict=True):
            if a == b:
                continue
            met = np.unique(np.append(label[j[a:b]], label[i[a]]))
            if len(met) > 1:
                label[np.isin(label, met)] = met[0]
    return label


def near_duplicates(docs: DataFrame, bits: int = BITS, shingle: int = SHINGLE, block: int = BLOCK) -> DataFrame:
    """``doc_id, fp, component_id`` for every row.

    Null and empty texts have the fingerprint zero and are linked like any other. Repeated rows stay
    repeated. The component is named by its least ``doc_id`` (null ids name none). Extra columns are
    ignored.
    """
    rows = shared.materialize(fingerprints(docs, shingle), "simhash")
    named = rooted(rows, bits, block)
    names = named.groupBy("root").agg(F.min("least").alias("component_id"))
    return rows.join(named.join(names, "root").select("fp", "component_id"), "fp")


def rooted(rows: DataFrame, bits: int, block: int) -> DataFrame:
    """``fp, least, root``: each fingerprint with its least ``doc_id`` and its component's least fingerprint."""
    prints = shared.materialize(rows.groupBy("fp").agg(F.min("doc_id").alias("least")), "simhash-prints")
    edges = links(prints.select("fp"), bits, block, groups_for(prints.count(), bits))
    roots = components.components(edges)
    return prints.join(roots, F.col("fp") == F.col("node"), "left").select(
        "fp", "least", F.coalesce("root", "fp").alias("root")
    )


def op8_simhash(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fingerprints and components over every whole text of ``documents``."""
    found = near_duplicates(shared.table(spark, sf_dir, "documents"))
    return found.select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
