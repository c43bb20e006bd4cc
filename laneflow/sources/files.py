"""File sources and sinks of the batch side."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DateType, StructField, StructType

from laneflow import schemas
from laneflow.config import SiteConfig


def read_table(
    spark: SparkSession, path: str, schema: StructType, fmt: str = "parquet", **options: str
) -> DataFrame:
    return spark.read.format(fmt).schema(schema).options(**options).load(path)


def read_trajectories(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    """Raw trajectory points; CSV files carry a header line, each with the columns in schema order.

    A file whose header says otherwise fails the read.
    """
    options = {"header": "true", "enforceSchema": "false"} if fmt == "csv" else {}
    return read_table(spark, path, schemas.TRAJECTORY, fmt, **options)


def read_replay_points(spark: SparkSession, path: str) -> DataFrame:
    """Points to replay, from CSV files with a header; columns go by name, in any order.

    All files have the header of the first one; a file with another fails the read.
    """
    text = spark.read.csv(path, header=True, enforceSchema=False)
    fields = schemas.frame_point()
    return text.select(*[F.col(f.name).cast(f.dataType).alias(f.name.lower()) for f in fields])


def as_trajectory(df: DataFrame) -> DataFrame:
    """Project to the raw trajectory schema, NULL for the columns ``df`` lacks."""
    present = {c.lower() for c in df.columns}
    return df.select(
        *[
            (F.col(f.name) if f.name.lower() in present else F.lit(None))
            .cast(f.dataType)
            .alias(f.name)
            for f in schemas.TRAJECTORY
        ]
    )


def write_table(df: DataFrame, path: str, fmt: str = "parquet", **options: str) -> None:
    df.write.mode("overwrite").format(fmt).options(**options).save(path)


def section_path(root: str, site: SiteConfig, source: str, hours: tuple[int, ...] = ()) -> str:
    """Folder of a persisted section aggregate, named after everything its content depends on."""
    parts = [site.location, source, f"splits{site.splits}", f"max{site.max_dist:g}"]
    parts += [f"h{h}" for h in hours]
    return f"{root}/section_agg/" + "_".join(parts)


def _finished(spark: SparkSession, path: str) -> bool:
    """Whether the table at ``path`` was written to its end: its mark is written last."""
    try:
        return bool(spark.read.text(f"{path}.done").head())
    except AnalysisException:
        return False


def write_once(df: DataFrame, path: str, fmt: str = "parquet") -> None:
    """Write ``df`` unless a finished table lies at ``path``; it isn't evaluated then."""
    spark = df.sparkSession
    if not _finished(spark, path):
        write_table(df, path, fmt)
        done = spark.createDataFrame([("done",)], "value string")
        done.coalesce(1).write.mode("overwrite").text(f"{path}.done")


def written_once(df: DataFrame, path: str) -> DataFrame:
    """:func:`write_once`, read back."""
    write_once(df, path)
    return read_table(df.sparkSession, path, df.schema)


def write_points(points: DataFrame, path: str) -> None:
    """Store raw points by site and UTC day, so that a range of hours reads its own days only."""
    day = F.to_date(F.timestamp_millis("Global_Time")).alias("day")
    stored = points.select("*", day).repartition("Location", "day", F.floor(F.col("Global_Time") / 600_000))
    stored.write.mode("overwrite").partitionBy("Location", "day").parquet(path)


def read_points(spark: SparkSession, path: str) -> DataFrame:
    """Points written by :func:`write_points`, the partition column ``day`` included."""
    fields = [f for f in schemas.TRAJECTORY if f.name != "Location"]
    stored = StructType([*fields, schemas.TRAJECTORY["Location"], StructField("day", DateType())])
    return read_table(spark, path, stored)


def section_table(df: DataFrame, path: str, fmt: str = "parquet") -> DataFrame:
    """Persist a section aggregate unless a finished one lies at ``path``, and read it back.

    ``df`` is only evaluated when the folder is missing. The rows are stored in order of time: a
    range of time then skips files, and the frames of a window meet in one task, so that the window
    aggregate combines nearly all of them before its shuffle, in every experiment that reads them.
    """
    fields = [F.col(f.name).cast(f.dataType) for f in schemas.SECTION_AGG]
    order = ("location", "elapsed_time")
    stored = df.select(*fields).repartitionByRange(*order).sortWithinPartitions(*order)
    write_once(stored, path, fmt)
    return read_table(df.sparkSession, path, schemas.SECTION_AGG, fmt)


def append_metrics(metrics: DataFrame, path: str, fmt: str = "csv") -> None:
    """Append rows of error metrics to a log without a header."""
    fields = [F.col(f.name).cast(f.dataType) for f in schemas.METRICS]
    metrics.select(*fields).write.mode("append").format(fmt).save(path)


def read_metrics(spark: SparkSession, path: str, fmt: str = "csv") -> DataFrame:
    return read_table(spark, path, schemas.METRICS, fmt)
