"""Windows that stand in a corpus more than once: what the two substring operators share.

A *sighting* is a segment of a row (``winnow``): consecutive windows with one anchor, named by the
hash of the anchor (``key``) and of the whole segment (``digest``). Sightings meet by key. Equal
segments decide about all their windows at once; only where segments of one key differ are their
windows compared.

Rows are named by ``doc`` (``doc_id``, the least number for null) and a tag of the text, so repeated
ids with different texts keep apart; a row that is repeated as a whole counts as often as it stands.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window

from laneflow.llm import arrays, shared
from laneflow.llm.shared import F

SIGHTING = "key long, digest long, doc long, place long, state int"
NO_ID = -(1 << 63)
#: State of a sighting: alone in its batch, one of several equal ones of a batch, decided.
ALONE, SEVERAL, DECIDED = 0, 1, 2
FIRST, COUNT, LEAD, TAG = 0, 32, 40, 48


def named(docs: DataFrame) -> DataFrame:
    """``doc, tag, text`` of every row; null text is empty."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(
        F.coalesce(F.col("doc_id").cast("long"), F.lit(NO_ID)).alias("doc"),
        F.xxhash64(text).bitwiseAND(0x7FFF).alias("tag"),
        text.alias("text"),
    )


def pack(first: np.ndarray, count: np.ndarray, lead: np.ndarray, tag: np.ndarray) -> np.ndarray:
    """First window, number of windows (255 at most), lead and tag in one number."""
    return first | (count << COUNT) | (lead << LEAD) | (tag << TAG)


def first_of(place: np.ndarray) -> np.ndarray:
    return place & 0xFFFFFFFF


def count_of(place: np.ndarray) -> np.ndarray:
    return (place >> COUNT) & 0xFF


def lead_of(place: np.ndarray) -> np.ndarray:
    return (place >> LEAD) & 0xFF


def tag_of(place: Column) -> Column:
    return F.shiftrightunsigned(place, TAG)


def collapsed(key: np.ndarray, digest: np.ndarray, doc: np.ndarray, place: np.ndarray, keep_least: bool) -> pa.RecordBatch:
    """Sightings of one batch, equal ones decided where the batch alone tells.

    Of equal sightings one stays to meet the others of the corpus; the rest only carry their
    decision on, dealt out evenly. ``keep_least``: those of the least ``doc`` all stay.
    """
    order = np.lexsort((place, doc, digest, key))
    key, digest, doc, place = key[order], digest[order], doc[order], place[order]
    new = np.ones(len(key), bool)
    new[1:] = (key[1:] != key[:-1]) | (digest[1:] != digest[:-1])
    run = np.cumsum(new) - 1
    starts = np.flatnonzero(new)
    size = np.diff(np.append(starts, len(key)))
    state = np.where(size[run] > 1, SEVERAL, ALONE)
    known = ~new & ((doc > doc[starts][run]) if keep_least else True)
    state[known] = DECIDED
    key = np.where(known, arrays.mix((place ^ (doc << 20)).view(np.uint64)).view(np.int64), key)
    return pa.RecordBatch.from_arrays(
        [pa.array(key), pa.array(digest), pa.array(doc), pa.array(place), pa.array(state.astype(np.int32))],
        ["key", "digest", "doc", "place", "state"],
    )


def sightings(
    rows: DataFrame,
    find: Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]],
    keep_least: bool,
) -> DataFrame:
    """``find`` gives key, digest, doc and place of all sightings of a batch."""
    return shared.per_batch(rows, lambda part: collapsed(*find(part), keep_least), SIGHTING)


def judged(seen: DataFrame, keep_least: bool) -> DataFrame:
    """``doc, place, key, covered, others``: what meeting by key tells about each sighting.

    ``covered``: every window of the segment also stands elsewhere (``keep_least``: in a smaller
    ``doc``). ``others``: 0, or the number of different segments of the key where those have to be
    compared with this one. Rows that need neither are left out.

    One shuffle by key; a key's rows pass through a task in sorted order and spill beyond a few
    thousand, and equal ones are one row per batch of the input.
    """
    by_key = Window.partitionBy("key")
    by_run = Window.partitionBy("key", "digest")
    whole = Window.unboundedPreceding, Window.unboundedFollowing
    seen = (
        seen.withColumn("nth", F.row_number().over(by_run.orderBy("doc", "place")))
        .withColumn("least", F.min("doc").over(by_run))
        .withColumn("size", F.sum(F.when(F.col("state") == SEVERAL, 2).otherwise(1)).over(by_run))
        .withColumn("kinds", F.sum((F.col("nth") == 1).cast("long")).over(by_key.rowsBetween(*whole)))
    )
    decided = F.col("state") == DECIDED
    if keep_least:
        covered = decided | (F.col("doc") > F.col("least"))
        asks = ~covered & (F.col("kinds") > 1)
    else:
        covered = decided | (F.col("size") > 1)
        asks = ~decided & (F.col("nth") == 1) & (F.col("kinds") > 1)
    others = F.when(asks, F.col("kinds")).otherwise(0)
    return seen.select("doc", "place", "key", covered.alias("covered"), others.alias("others")).filter(
        "covered or others > 0"
    )


def by_row(found: DataFrame, *columns: str) -> DataFrame:
    """All ``columns`` of the sightings of each row of the input; as many as its text is long at most."""
    return found.groupBy("doc", tag_of(F.col("place")).alias("tag")).agg(
        F.collect_list(F.struct("place", *columns)).alias("found")
    )


def with_texts(rows: DataFrame, found: DataFrame, how: str) -> DataFrame:
    return rows.join(found, ["doc", "tag"], how)


def single(hashes: np.ndarray, doc: np.ndarray, first: np.ndarray, tag: np.ndarray) -> tuple:
    """Sightings of one window each, for ``collapsed``: key and digest are the window's hash."""
    one = np.ones(len(first), np.int64)
    key = hashes.view(np.int64)
    return key, key, doc, pack(first, one, one * 0, tag)


def runs_of_lists(column: pa.Array, field: str) -> tuple[np.ndarray, np.ndarray]:
    """Values of ``field`` of a list-of-structs column, and where each row's begin (rows + 1)."""
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    lengths = np.array(column.value_lengths().fill_null(0).to_numpy(zero_copy_only=False), np.int64)
    values = column.flatten()
    return (
        values.field(field).to_numpy(zero_copy_only=False) if len(values) else np.zeros(0, np.int64),
        np.concatenate([[0], np.cumsum(lengths)]),
    )
