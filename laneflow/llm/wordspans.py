"""Substring de-duplication by words: level-wise doubling.

Level 1 looks at windows of half the length (25 words for 50). Of those inside each window of full
length one is picked (``winnow``), so that equal full windows pick equal halves. Halves that stand in
one document alone end here; windows repeated at this length are extended to twice the length, where
those are compared that lie around a repeated half. The windows of full length that also start in a
smaller document decide; no longer window can cover more, so nothing is left to extend.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from laneflow.llm import arrays, repeats, shared, winnow
from laneflow.llm.shared import F

WINDOW = 50
SCHEMA = "doc_id long, n_words long, n_removed long, kept_sha256 string"


def word_codes(data: np.ndarray, offsets: np.ndarray):
    starts, ends, before = arrays.words(data, offsets)
    return arrays.Runs(arrays.BYTE_CODES[data]).hashes(starts, ends), starts, ends, before


def sighted(part: pa.RecordBatch, window: int):
    """Level 1: a sighting for each segment of windows around a picked half."""
    found = []
    doc, tag = part.column("doc").to_numpy(), part.column("tag").to_numpy()
    for rows, data, offsets in arrays.pieces(part):
        codes, _, _, before = word_codes(data, offsets)
        runs = arrays.Runs(codes)
        s = winnow.segments(codes, before, window, window // 2, runs)
        at = before[s.row] + s.first
        digest = runs.hashes(at, at + s.count + window - 1) ^ arrays.mix(s.lead.astype(np.uint64))
        place = repeats.pack(s.first, s.count, s.lead, tag[rows][s.row])
        found.append((s.anchor.view(np.int64), digest.view(np.int64), doc[rows][s.row], place))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 4


def extended(part: pa.RecordBatch, window: int):
    """Level 2: a sighting for each full window of the segments that have to be compared."""
    found = []
    doc, tag = part.column("doc").to_numpy(), part.column("tag").to_numpy()
    places, bounds = repeats.runs_of_lists(part.column("found"), "place")
    for rows, data, offsets in arrays.pieces(part):
        codes, _, _, before = word_codes(data, offsets)
        mine = places[bounds[rows.start] : bounds[rows.stop]]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds[rows.start : rows.stop + 1]))
        first, count = repeats.first_of(mine), repeats.count_of(mine)
        starts = arrays.ranges(before[row] + first, count)
        row = np.repeat(row, count)
        hashes = arrays.Runs(codes).hashes(starts, starts + window)
        found.append(repeats.single(hashes, doc[rows][row], starts - before[row], tag[rows][row]))
    return tuple(map(np.concatenate, zip(*found, strict=True))) if found else (np.zeros(0, np.int64),) * 4


def removed(part: pa.RecordBatch, window: int) -> pa.RecordBatch:
    """Counts and the digest of the words that are left, for every row."""
    places, bounds = repeats.runs_of_lists(part.column("found"), "place")
    counts, gone, digests = [], [], []
    for rows, data, offsets in arrays.pieces(part):
        starts, ends, before = arrays.words(data, offsets)
        mine = places[bounds[rows.start] : bounds[rows.stop]]
        row = np.repeat(np.arange(len(offsets) - 1), np.diff(bounds[rows.start : rows.stop + 1]))
        begin = before[row] + repeats.first_of(mine)
        cover = arrays.covered(begin, begin + repeats.count_of(mine) + window - 1, len(starts))
        keep = np.flatnonzero(~cover)
        kept_before = np.searchsorted(keep, before)
        lengths = (ends - starts)[keep]
        at = np.concatenate([[0], np.cumsum(lengths + 1)])
        plain = np.full(int(at[-1]), 0x20, np.uint8)
        plain[arrays.ranges(at[:-1], lengths)] = data[arrays.ranges(starts[keep], lengths)]
        plain = plain.tobytes()
        for a, b in zip(at[kept_before[:-1]].tolist(), at[kept_before[1:]].tolist(), strict=True):
            digests.append(shared.hex_digest(plain[a : max(a, b - 1)]))
        counts.append(np.diff(before))
        gone.append(np.diff(before) - np.diff(kept_before))
    none = np.zeros(0, np.int64)
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            pa.array(np.concatenate(counts) if counts else none),
            pa.array(np.concatenate(gone) if gone else none),
            pa.array(digests, pa.string()),
        ],
        ["doc_id", "n_words", "n_removed", "kept_sha256"],
    )


def covered_windows(rows: DataFrame, window: int) -> DataFrame:
    """``doc, tag, found``: segments and windows of each row that also start in a smaller document."""
    first = repeats.judged(repeats.sightings(rows, lambda part: sighted(part, window), True), True)
    first = shared.materialize(repeats.by_row(first, "covered", "others"), "word-halves")
    asking = first.select("doc", "tag", F.filter("found", lambda x: x["others"] > 0).alias("found"))
    texts = repeats.with_texts(rows, asking.filter("size(found) > 0"), "inner")
    second = repeats.judged(repeats.sightings(texts, lambda part: extended(part, window), True), True)
    known = first.select(F.explode(F.filter("found", lambda x: x["covered"])).alias("x"), "doc").select("doc", "x.place")
    return repeats.by_row(known.unionByName(second.filter("covered").select("doc", "place")))


def deduplicated(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """``doc_id, n_words, n_removed, kept_sha256`` for every row.

    A word goes if a window of ``window`` words over it also starts in a document with a smaller
    ``doc_id``. Null text has no words; null ids count as one id smaller than all others. Rows with
    equal ids never remove from each other. Repeated rows stay repeated; extra columns are ignored.
    """
    if not 2 <= window < 255 + window // 2:
        raise ValueError("a segment has 255 windows at most")
    rows = repeats.named(docs)
    texts = repeats.with_texts(rows, covered_windows(rows, window), "left").select(
        F.when(F.col("doc") != repeats.NO_ID, F.col("doc")).alias("doc_id"), "text", "found"
    )
    return shared.per_batch(texts, lambda part: removed(part, window), SCHEMA)


def op7_doubling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Repeated windows of 50 words over every whole text of ``documents``."""
    return deduplicated(shared.table(spark, sf_dir, "documents"))


SQL = f"""
WITH w AS (
  SELECT doc_id,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), h AS (
  SELECT doc_id, words,
    list_transform(range(1, len(words) - {WINDOW} + 2), lambda i: md5(array_to_string(words[i : i + {WINDOW} - 1], ' '))) AS hs
  FROM w
), starts AS (SELECT doc_id, unnest(hs) AS hash, unnest(range(1, len(hs) + 1)) AS i FROM h),
least AS (SELECT hash, min(doc_id) AS least FROM starts GROUP BY hash),
gone AS (
  SELECT doc_id, list(DISTINCT i + k) AS gone
  FROM starts JOIN least USING (hash), range(0, {WINDOW}) AS r(k) WHERE least < doc_id GROUP BY doc_id
), kept AS (
  SELECT doc_id, len(words) AS n_words, coalesce(len(gone), 0) AS n_removed,
    CASE WHEN gone IS NULL THEN words
      ELSE list_transform(list_filter(range(1, len(words) + 1), lambda k: NOT list_contains(gone, k)), lambda k: words[k])
    END AS kept
  FROM h LEFT JOIN gone USING (doc_id)
)
SELECT doc_id, n_words, n_removed, sha256(array_to_string(kept, ' ')) AS kept_sha256 FROM kept
"""
