"""Importance resampling toward a target distribution: hashed word runs, Gumbel top share.

Features are all runs of one to three words, repeats counted; a feature's bucket is the CRC-32 of its
bytes modulo ``BUCKETS``. A bucket's gain is the log ratio of its share in the target to that in the
corpus, a document's weight the sum of its features' gains, and the documents drawn are those with the
largest weight plus Gumbel noise, which is a draw without replacement in proportion to ``exp(weight)``.

Length-bucketed CRC matrices: the distinct features of a batch are grouped by their length in bytes, a
group is a two-dimensional array of bytes, and the CRCs of all its features are updated together,
column by column. Features of more than ``WIDTH`` bytes are padded in front with zeros to a power of two
of blocks, every block is a row of one matrix, and the CRCs of neighbouring blocks are joined pairwise
(a CRC is linear; zeros in front don't change one that starts at zero). The buckets of distinct
features are then scattered back to where they occur.

Documents are read twice, for the counts and for the weights. Only the ``BUCKETS`` counts reach the
driver. Ranks come from a sort by ranges, numbered per partition: no task sees all rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession

from laneflow.llm import arrays, containment, shared
from laneflow.llm.shared import F

BUCKETS = 10_000
LONGEST_RUN = 3
LEAST_WORDS = 20
PERCENT = 5
SEED = 42
#: Bytes up to which features are grouped by their exact length.
WIDTH = 64
#: Bytes of a matrix, about.
AT_ONCE = 1 << 20
OTHER = ~containment.LETTERS
ALL = np.uint32(0xFFFFFFFF)


def crc_table() -> np.ndarray:
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = (table >> np.uint32(1)) ^ (table & np.uint32(1)) * np.uint32(0xEDB88320)
    return table


TABLE = crc_table()


def updated(crc: np.ndarray, matrix: np.ndarray) -> np.ndarray:
    """CRCs after the bytes of ``matrix``: a row holds one byte of every feature."""
    for column in matrix:
        crc = TABLE[(crc ^ column).astype(np.uint8)] ^ (crc >> np.uint32(8))
    return crc


@lru_cache
def shift(level: int) -> np.ndarray:
    """Tables (4 x 256) that take a CRC over ``WIDTH * 2 ** level`` bytes of zero."""
    if level:
        half = shift(level - 1)
        images = shifted(half, shifted(half, np.uint32(1) << np.arange(32, dtype=np.uint32)))
    else:
        images = updated(np.uint32(1) << np.arange(32, dtype=np.uint32), np.zeros((WIDTH, 32), np.uint8))
    bits = (np.arange(256)[:, None] >> np.arange(8)) & 1
    return np.stack([np.bitwise_xor.reduce(bits.astype(np.uint32) * images[8 * j : 8 * j + 8], axis=1) for j in range(4)])


def shifted(tables: np.ndarray, crc: np.ndarray) -> np.ndarray:
    out = np.zeros_like(crc)
    for j in range(4):
        out ^= tables[j][(crc >> np.uint32(8 * j)).astype(np.uint8)]
    return out


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """CRC-32 of each run of bytes; none is empty."""
    lengths = ends - starts
    # Exact lengths, or the power of two of blocks that a longer run is padded to.
    blocks = np.where(lengths > WIDTH, -(-lengths // WIDTH), 1)
    whole = np.exp2(np.ceil(np.log2(np.maximum(blocks, 1)))).astype(np.int64) * WIDTH
    size = np.where(lengths > WIDTH, whole, lengths)
    out = np.empty(len(starts), np.uint32)
    order = np.argsort(size, kind="stable")
    for group in np.split(order, np.flatnonzero(np.diff(size[order])) + 1):
        if not len(group):
            continue
        n = int(size[group[0]])
        rows = max(1, AT_ONCE // n)
        for lo in range(0, len(group), rows):
            some = group[lo : lo + rows]
            if n <= WIDTH:
                matrix = data[np.arange(n)[:, None] + starts[some]]
                out[some] = updated(np.full(len(some), ALL), matrix)
            else:
                out[some] = padded(data, starts[some], lengths[some], n)
    return ~out


def padded(data: np.ndarray, starts: np.ndarray, lengths: np.ndarray, size: int) -> np.ndarray:
    """CRCs, not yet inverted, of runs padded in front to ``size`` bytes."""
    flat = np.zeros(len(starts) * size, np.uint8)
    first = np.arange(1, len(starts) + 1) * size - lengths
    flat[arrays.ranges(first, lengths)] = data[arrays.ranges(starts, lengths)]
    # To begin with all ones is the same as to flip the first four bytes.
    flat[(first[:, None] + np.arange(4)).ravel()] ^= 0xFF
    matrix = np.ascontiguousarray(flat.reshape(-1, WIDTH).T)
    crc, level = updated(np.zeros(matrix.shape[1], np.uint32), matrix), 0
    while len(crc) > len(starts):
        crc = shifted(shift(level), crc[0::2]) ^ crc[1::2]
        level += 1
    return crc


def features(data: np.ndarray, offsets: np.ndarray, buckets: int, longest: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Row and bucket of every feature, and words per row."""
    starts, ends, before = arrays.words(data, offsets, OTHER)
    upper = (data >= 65) & (data <= 90)
    small = data | (upper.astype(np.uint8) << 5)
    # The words with one space after each, in one run of bytes; a feature is a slice of it.
    lengths = ends - starts
    at = np.concatenate([[0], np.cumsum(lengths + 1)]).astype(np.int64)
    plain = np.full(int(at[-1]), 0x20, np.uint8)
    plain[arrays.ranges(at[:-1], lengths)] = small[arrays.ranges(starts, lengths)]
    n, words = len(starts), np.diff(before)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), words
    spaced = pa.Array.from_buffers(pa.large_binary(), n, [None, pa.py_buffer(at), pa.py_buffer(plain)])
    coded = spaced.dictionary_encode()
    word, kinds = coded.indices.to_numpy().astype(np.int64), len(coded.dictionary)
    row = np.repeat(np.arange(len(words)), words)
    place, run = np.arange(n), np.zeros(n, np.int64)  # run: number of the run of k - 1 words from each place
    rows, begin, stop, back, seen = [], [], [], [], 0
    for k in range(1, longest + 1):
        place = place[: len(place)][place + k - 1 < n]
        place = place[row[place] == row[place + k - 1]]
        # Numbers of shorter runs and words are both below n, so the product is one number a run.
        found, first, inverse = np.unique(run[place] * kinds + word[place + k - 1], return_index=True, return_inverse=True)
        run[place] = inverse
        rows.append(row[place])
        begin.append(at[:-1][place[first]])
        stop.append(at[1:][place[first] + k - 1] - 1)
        back.append(inverse + seen)
        seen += len(found)
    bucket = crcs(plain, np.concatenate(begin), np.concatenate(stop)).astype(np.int64) % buckets
    return np.concatenate(rows), bucket[np.concatenate(back)], words


def bucket_counts(texts: DataFrame, buckets: int, longest: int) -> np.ndarray:
    """Features of all texts in each bucket: one row a task and bucket, summed up by Spark."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for part in shared.parts(batch):
                for _, data, offsets in arrays.pieces(part):
                    total += np.bincount(features(data, offsets, buckets, longest)[1], minlength=buckets)
        held = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(held, pa.int64()), pa.array(total[held])], ["bucket", "n"])

    rows = texts.select(F.col("text").cast("string").alias("text")).mapInArrow(count, "bucket long, n long")
    out = np.zeros(buckets, np.int64)
    for r in rows.groupBy("bucket").agg(F.sum("n").alias("n")).collect():  # ``buckets`` rows at most
        out[r.bucket] = r.n
    return out


def gains_of(source: np.ndarray, target: np.ndarray) -> np.ndarray:
    """Thousandths of the log ratio of the smoothed shares, rounded down."""
    n = float(len(source))
    s, t = source.astype(float), target.astype(float)
    return np.floor(1000 * np.log((t + 1) * (s.sum() + n) / ((s + 1) * (t.sum() + n)))).astype(np.int64)


def gains(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, longest: int = LONGEST_RUN) -> np.ndarray:
    """Gain of every bucket, from all rows of both tables."""
    return gains_of(bucket_counts(docs, buckets, longest), bucket_counts(target, buckets, longest))


def weighted(docs: DataFrame, gain: np.ndarray, longest: int = LONGEST_RUN) -> DataFrame:
    """``doc_id, n_words, n_features, weight`` of every row."""

    def weigh(part: pa.RecordBatch) -> pa.RecordBatch:
        words, counts, weights = [], [], []
        for _, data, offsets in arrays.pieces(part):
            row, bucket, n = features(data, offsets, len(gain), longest)
            total = np.zeros(len(n), np.int64)
            np.add.at(total, row, gain[bucket])
            words.append(n)
            counts.append(np.bincount(row, minlength=len(n)))
            weights.append(total)
        columns = [pa.array(np.concatenate(c).astype(np.int64)) for c in (words, counts, weights)]
        return pa.RecordBatch.from_arrays(
            [part.column("doc_id"), *columns], ["doc_id", "n_words", "n_features", "weight"]
        )

    schema = "doc_id long, n_words long, n_features long, weight long"
    return shared.per_batch(shared.id_and_text(docs), weigh, schema)


def noise(seed: int) -> Column:
    """Thousandths of standard Gumbel noise from the id, rounded down."""
    key = F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit("")))
    h = F.conv(F.substring(F.sha2(key, 256), 1, 8), 16, 10).cast("long")
    return F.floor(-1000 * F.log(-F.log((h + 0.5) / F.lit(4294967296.0))))


def resampled(
    docs: DataFrame,
    target: DataFrame,
    percent: int = PERCENT,
    least_words: int = LEAST_WORDS,
    seed: int = SEED,
    buckets: int = BUCKETS,
    longest: int = LONGEST_RUN,
) -> DataFrame:
    """``doc_id, n_words, n_features, weight, score, rank`` of every row; rows not drawn have no rank.

    Null and empty texts have no features and a weight of 0. A null id takes the noise of an empty one.
    Repeated rows are drawn one by one; ties go to the smaller id (null first). Empty tables give no
    rows, and an empty target the same target share for all buckets. Extra columns are ignored.
    """
    gain = gains(docs, target, buckets, longest)
    scored = weighted(docs, gain, longest).withColumn("score", F.col("weight") + noise(seed))
    scored = shared.materialize(scored.withColumn("able", F.col("n_words") >= least_words), "resampling-scores")
    drawn = scored.filter("able").count() * percent // 100
    order = [F.col("able").desc(), F.col("score").desc(), F.col("doc_id").asc_nulls_first()]
    placed = shared.numbered(scored, order, "resampling-order")
    rank = F.when(F.col("able") & (F.col("number") < drawn), F.col("number") + 1)
    return placed.select("doc_id", "n_words", "n_features", "weight", "score", rank.alias("rank"))


def op11_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Draw 5 % of ``documents`` by their likeness to ``benchmark``."""
    out = resampled(shared.table(spark, sf_dir, "documents"), shared.table(spark, sf_dir, "benchmark"))
    return out.select("doc_id", "n_features", "weight", "score", "rank")


_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = f"regexp_extract_all({_LOWER}, '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"


def _grams(table: str, key: str) -> str:
    return f"""
  SELECT {key}, array_to_string(w[i : i + k - 1], ' ') AS f
  FROM (SELECT {key}, w, k, unnest(range(1, len(w) - k + 2)) AS i
        FROM (SELECT {key}, {_WORDS} AS w FROM {table}), widths WHERE len(w) >= k)"""


SQL = f"""
WITH RECURSIVE widths AS (SELECT unnest(range(1, {LONGEST_RUN + 1})) AS k),
steps AS (
  SELECT i, i AS c, 0 AS n FROM (SELECT unnest(range(0, 256)) AS i)
  UNION ALL
  SELECT i, CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, n + 1 FROM steps WHERE n < 8),
tab AS MATERIALIZED (SELECT list(c ORDER BY i) AS t FROM steps WHERE n = 8),
d AS MATERIALIZED ({_grams("documents", "doc_id")}),
q AS MATERIALIZED ({_grams("benchmark", "item_id")}),
kinds AS (SELECT f, hex(encode(f)) AS h FROM (SELECT f FROM d UNION SELECT f FROM q)),
coded AS MATERIALIZED (
  SELECT f, xor(list_reduce(
    list_prepend(4294967295::BIGINT, list_transform(range(1, len(h), 2),
      lambda i: (strpos('0123456789ABCDEF', h[i]) * 16 + strpos('0123456789ABCDEF', h[i + 1]) - 17)::BIGINT)),
    lambda c, b: xor(t[(xor(c, b) & 255) + 1], c >> 8)), 4294967295::BIGINT) % {BUCKETS} AS bucket
  FROM kinds, tab),
s AS (SELECT bucket, count(*) AS n FROM d JOIN coded USING (f) GROUP BY bucket),
t AS (SELECT bucket, count(*) AS n FROM q JOIN coded USING (f) GROUP BY bucket),
gain AS (
  SELECT bucket, floor(1000 * ln(
    (coalesce(t.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM s) + {BUCKETS})::DOUBLE
    / ((coalesce(s.n, 0) + 1)::DOUBLE * ((SELECT coalesce(sum(n), 0) FROM t) + {BUCKETS})::DOUBLE)))::BIGINT AS gain
  FROM s FULL JOIN t USING (bucket)),
w AS (SELECT doc_id, count(*) AS n_features, sum(gain)::BIGINT AS weight
      FROM d JOIN coded USING (f) JOIN gain USING (bucket) GROUP BY doc_id),
scored AS (
  SELECT doc_id, len({_WORDS}) >= {LEAST_WORDS} AS able, coalesce(n_features, 0)::BIGINT AS n_features,
    coalesce(weight, 0)::BIGINT AS weight,
    coalesce(weight, 0)::BIGINT + floor(-1000 * ln(-ln(
      (('0x' || substr(sha256('{SEED}:' || doc_id), 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296)))::BIGINT AS score
  FROM documents LEFT JOIN w USING (doc_id)),
placed AS (
  SELECT *, row_number() OVER (PARTITION BY able ORDER BY score DESC, doc_id) AS place,
    {PERCENT} * (SELECT count(*) FROM scored WHERE able) // 100 AS drawn FROM scored)
SELECT doc_id, n_features, weight, score, CASE WHEN able AND place <= drawn THEN place END AS rank FROM placed
"""
