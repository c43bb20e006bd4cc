"""Quality rules with cross-document line frequency.

Lines are normalised (A-Z lower-cased, white space inside turned into one space, trimmed) and hashed.
Per host the distinct documents that have a line are counted: copies of a text under different ids are
different documents, rows equal in id and text are one. Lines of more than ``limit`` documents of their
host are removed, and a document of which less than ``least`` of the letters are left is rejected. The
base rules look at one document alone.

Copies are counted before lines are unfolded: each distinct text of a host brings its number of
documents along, and a line's count is the sum over the texts that have it.
"""

from __future__ import annotations

import re

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession

from laneflow.llm import arrays, shared
from laneflow.llm.shared import F

LIMIT = 10
LEAST = 0.5
#: Fixed values of the base rules.
SYMBOLS = "#*$%&|<>"
LEAST_WORDS = 50
MOST_REPEATED = 50

LOWER = str.maketrans({chr(c): chr(c + 32) for c in range(65, 91)})
BLANKS = re.compile("[\x20\x09-\x0d]+")
BASE = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
SCHEMA = (
    "doc_id long, host string, digest string, n_words long, word_chars long, n_symbols long, "
    "n_dup_lines long, n_repeat_words long, lines array<struct<line: long, chars: long>>"
)


def normal(line: str) -> str:
    return BLANKS.sub(" ", line.translate(LOWER)).strip(" ")


def repeated_words(row: np.ndarray, hashes: np.ndarray, rows: int) -> np.ndarray:
    """Words per row that lie in a window of three words which the row has twice or more."""
    n = len(hashes) - 2
    if n <= 0:
        return np.zeros(rows, np.int64)
    whole = row[2:] == row[:-2]
    keys = arrays.Runs(hashes).windows(3)
    keys = arrays.mix(keys + row[:-2].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))[whole]
    at = np.flatnonzero(whole)
    ordered = np.sort(keys)
    twice = np.unique(ordered[1:][ordered[1:] == ordered[:-1]])
    if not len(twice):
        return np.zeros(rows, np.int64)
    place = np.minimum(np.searchsorted(twice, keys), len(twice) - 1)
    start = at[twice[place] == keys]
    inside = np.zeros(n + 2, bool)
    for k in range(3):
        inside[start + k] = True
    return np.bincount(row[inside], minlength=rows)


def measure(part: pa.RecordBatch) -> pa.RecordBatch:
    """Base values and normalised lines of every row of a batch."""
    symbol = np.isin(np.arange(256), [ord(c) for c in SYMBOLS])
    columns: list[list] = [[] for _ in BASE]
    for _, data, offsets in arrays.pieces(part):
        rows = len(offsets) - 1
        starts, ends, before = arrays.words(data, offsets)
        row = np.repeat(np.arange(rows), np.diff(before))
        hashes = arrays.Runs(arrays.BYTE_CODES[data]).hashes(starts, ends)

        def per_row(flags: np.ndarray, offsets: np.ndarray = offsets) -> np.ndarray:
            return np.diff(np.concatenate([[0], np.cumsum(flags)])[offsets])

        letters = ~arrays.SPACES[data] & ((data & 0xC0) != 0x80)
        for column, values in zip(
            columns, (np.diff(before), per_row(letters), per_row(symbol[data]), None, repeated_words(row, hashes, rows)), strict=True
        ):
            column.append(values)
    texts = shared.texts(part)
    repeats, found, digests = [], [], []
    for text in texts:
        lines = [x for x in text.split("\n") if BLANKS.sub("", x)]
        repeats.append(len(lines) - len(set(lines)))
        digests.append(xxhash.xxh3_128_hexdigest(text.encode()))
        plain = [normal(x) for x in lines]
        found.append(
            [{"line": xxhash.xxh64_intdigest(x) - (1 << 63), "chars": len(x) - x.count(" ")} for x in plain]
        )
    values = [np.concatenate(c) if c and c[0] is not None else repeats for c in columns]
    return pa.RecordBatch.from_arrays(
        [
            part.column("doc_id"),
            part.column("host"),
            pa.array(digests, pa.string()),
            *(pa.array(v, pa.int64()) for v in values),
            pa.array(found, pa.list_(pa.struct([("line", pa.int64()), ("chars", pa.int64())]))),
        ],
        ["doc_id", "host", "digest", *BASE, "lines"],
    )


def quality(docs: DataFrame, host: str = "source", limit: int = LIMIT, least: float = LEAST) -> DataFrame:
    """One row per document: the base values, ``base_failed``, ``kept``, letters and lines removed.

    Null text has no words and no lines; a null host is a host of its own. Rows repeat as in the
    input. A document without words fails the base rules. Extra columns are ignored.
    """
    rows = docs.select(
        F.col("doc_id").cast("long").alias("doc_id"),
        F.col(host).cast("string").alias("host"),
        F.col("text").cast("string").alias("text"),
    )
    measured = shared.materialize(shared.per_batch(rows, measure, SCHEMA), "quality-lines")
    # Copies inside a host are unfolded once; what is removed from one of them is removed from all.
    contents = measured.dropDuplicates(["host", "digest"])
    named = measured.select("host", "digest", "doc_id").distinct()
    copies = named.groupBy(F.col("host").alias("at"), F.col("digest").alias("of")).agg(F.count("*").alias("copies"))
    frequent = (
        contents.join(copies, F.col("host").eqNullSafe(F.col("at")) & (F.col("digest") == F.col("of")))
        .select("host", "copies", F.explode(F.array_distinct("lines.line")).alias("line"))
        .groupBy("host", "line")
        .agg(F.sum("copies").alias("documents"))
        .filter(F.col("documents") > limit)
        .select(F.col("host").alias("at"), F.col("line").alias("frequent"))
    )
    removed = (
        contents.select("host", "digest", F.explode("lines").alias("x"))
        .select("host", "digest", "x.*")
        .join(frequent, F.col("host").eqNullSafe(F.col("at")) & (F.col("line") == F.col("frequent")))
        .groupBy("host", "digest")
        .agg(F.sum("chars").alias("chars_removed"), F.count("*").alias("lines_removed"))
        .select(F.col("host").alias("at"), F.col("digest").alias("of"), "chars_removed", "lines_removed")
    )
    n, repeats = F.col("n_words"), F.col("n_repeat_words")
    failed = (n < LEAST_WORDS) | (100 * repeats > MOST_REPEATED * n)
    left = F.col("word_chars") - F.col("chars_removed")
    return (
        measured.join(removed, F.col("host").eqNullSafe(F.col("at")) & (F.col("digest") == F.col("of")), "left")
        .fillna(0, ["chars_removed", "lines_removed"])
        .select(
            "doc_id",
            *BASE,
            failed.alias("base_failed"),
            (~failed & (left >= least * F.col("word_chars"))).alias("kept"),
            "chars_removed",
            "lines_removed",
        )
    )


def op4_line_frequency(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rules over every whole text of ``documents``; a document's host is its source."""
    return quality(shared.table(spark, sf_dir, "documents"))


SQL = f"""
WITH w AS (
  SELECT doc_id, source, coalesce(text, '') AS text, md5(coalesce(text, '')) AS digest,
    list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS words
  FROM documents
), grams AS (
  SELECT doc_id, i, words[i] || ' ' || words[i + 1] || ' ' || words[i + 2] AS gram
  FROM (SELECT doc_id, words, unnest(range(1, len(words) - 1)) AS i FROM w)
), repeats AS (
  SELECT doc_id, count(DISTINCT i + k) AS n_repeat_words
  FROM (SELECT doc_id, i, count(*) OVER (PARTITION BY doc_id, gram) AS c FROM grams), range(0, 3) AS r(k)
  WHERE c > 1 GROUP BY doc_id
), lines AS (
  SELECT doc_id, source, digest, unnest(string_split(text, chr(10))) AS line FROM w
), plain AS (
  SELECT *, trim(regexp_replace(translate(line, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
    '[\x20\x09-\x0D]+', ' ', 'g'), ' ') AS norm
  FROM lines WHERE regexp_matches(line, '[^\x20\x09-\x0D]')
), frequent AS (
  SELECT source, norm FROM plain GROUP BY ALL HAVING count(DISTINCT coalesce(doc_id::VARCHAR, '') || ':' || digest) > {LIMIT}
), removed AS (
  SELECT doc_id, sum(length(replace(p.norm, ' ', '')))::BIGINT AS chars_removed, count(*) AS lines_removed
  FROM plain p JOIN frequent f ON p.norm = f.norm AND p.source IS NOT DISTINCT FROM f.source GROUP BY doc_id
), base AS (
  SELECT w.doc_id, len(words) AS n_words,
    length(regexp_replace(text, '[\x20\x09-\x0D]+', '', 'g')) AS word_chars,
    length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) AS n_symbols,
    coalesce((SELECT count(*) - count(DISTINCT line) FROM plain p WHERE p.doc_id = w.doc_id), 0) AS n_dup_lines,
    coalesce(n_repeat_words, 0) AS n_repeat_words,
    coalesce(chars_removed, 0) AS chars_removed, coalesce(lines_removed, 0) AS lines_removed
  FROM w LEFT JOIN repeats USING (doc_id) LEFT JOIN removed USING (doc_id)
)
SELECT doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words,
  n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words AS base_failed,
  NOT (n_words < {LEAST_WORDS} OR 100 * n_repeat_words > {MOST_REPEATED} * n_words)
    AND word_chars - chars_removed >= {LEAST} * word_chars AS kept,
  chars_removed, lines_removed
FROM base
"""
