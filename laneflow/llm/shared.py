"""What the operators of this folder share: reading tables, null-safe texts, Arrow batches."""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from laneflow.session import discard, materialize, pin


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return pin(spark).read.parquet(f"{sf_dir}/{name}.parquet")


def id_and_text(docs: DataFrame) -> DataFrame:
    """``doc_id`` and ``text`` alone: extra columns never clash with an operator's own."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))


def per_batch(
    df: DataFrame, convert: Callable[[pa.RecordBatch], pa.RecordBatch | None], schema: str
) -> DataFrame:
    """Map every Arrow batch by ``convert``; a batch is worked on in parts of few megabytes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in parts(batch):
                out = convert(part)
                if out is not None:
                    yield out

    return df.mapInArrow(run, schema)


def parts(batch: pa.RecordBatch, most_bytes: int = 4 << 20) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``most_bytes``, or one row where that is larger."""
    if batch.num_rows <= 1 or batch.nbytes <= most_bytes:
        if batch.num_rows:
            yield batch
        return
    half = batch.num_rows // 2
    yield from parts(batch.slice(0, half), most_bytes)
    yield from parts(batch.slice(half), most_bytes)


def texts(batch: pa.RecordBatch, column: str = "text") -> list[str]:
    """The texts of a batch; null is the empty text."""
    return [x or "" for x in batch.column(column).to_pylist()]


def numbered(df: DataFrame, order: list[Column], name: str) -> DataFrame:
    """``df``, written, with ``number``: 0, 1, 2... by ``order``, or in any order without one.

    Ranges of the order are dealt to tasks, each of which numbers its own rows; what a partition
    starts at follows from the counts of those before it, a table of one row a partition. ``df`` must be
    a written table: ranges are found by reading it once more.
    """
    if order:
        df = df.repartitionByRange(*order).sortWithinPartitions(*order)
    # The upper 31 bits are the partition's number, the others count its rows.
    written = materialize(df.withColumn("_at", F.monotonically_increasing_id()), name)
    part, place = F.shiftright("_at", 33), F.col("_at").bitwiseAND(F.lit((1 << 33) - 1))
    counts = written.groupBy(part.alias("_part")).agg(F.count("*").alias("_n"))
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    starts = counts.select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_start"))
    joined = written.withColumn("_part", part).join(starts, "_part")
    return joined.withColumn("number", F.col("_start") + place).drop("_at", "_part", "_start")


def hex_digest(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


__all__ = ["F", "discard", "hex_digest", "id_and_text", "materialize", "numbered", "parts", "per_batch", "table", "texts"]
