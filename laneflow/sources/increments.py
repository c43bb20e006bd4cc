"""A section table that absorbs batches of raw points.

``sums`` holds what each batch adds to a cell of a frame, by batch and day; ``sections`` the means of
all batches, by day. A new batch rewrites the days it touches and no others. Sums are decimals, so
the table doesn't depend on how the points were dealt to batches.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType, IntegerType, LongType, StringType, StructField, StructType

from laneflow import schemas
from laneflow.config import SiteConfig
from laneflow.operators.aggregate import CELL, SITE, add_section

DAY_MS = 86_400_000
FRAME = (*SITE, "elapsed_time", *CELL)
SPEED, TOTAL, MEAN = DecimalType(18, 6), DecimalType(28, 6), DecimalType(22, 10)
ADDED = (("vel_sum", TOTAL), ("vel_n", LongType()), ("acc_sum", TOTAL), ("acc_n", LongType()), ("n", LongType()))
SUMS = StructType(
    [
        StructField("location", StringType()),
        StructField("elapsed_time", LongType()),
        *[StructField(c, IntegerType()) for c in CELL],
        *[StructField(c, kind) for c, kind in ADDED],
    ]
)
DAY = StructField("day", IntegerType())


def section_sums(points: DataFrame, site: SiteConfig) -> DataFrame:
    """What ``points`` add to each cell of a frame; missing speeds count as points only."""
    vel, acc = (F.col(c).cast(SPEED) for c in ("v_vel", "v_acc"))
    sums = (F.sum(vel), F.count(vel), F.sum(acc), F.count(acc), F.count(F.lit(1)))
    named = [value.cast(kind).alias(c) for value, (c, kind) in zip(sums, ADDED, strict=True)]
    return add_section(points, site).groupBy(*FRAME).agg(*named)


def section_means(sums: DataFrame) -> DataFrame:
    """The section aggregate from the sums of any number of batches."""
    totals = sums.groupBy(*FRAME).agg(*[F.sum(c).cast(kind).alias(c) for c, kind in ADDED])

    def mean(name: str, digits: int) -> Column:
        share = F.col(f"{name}_sum") / F.nullif(F.col(f"{name}_n"), F.lit(0))
        return F.round(share.cast(MEAN), digits).alias(f"avg_{name}")

    return totals.select(*FRAME, mean("vel", 1), mean("acc", 2), "n")


def _days(spark: SparkSession, path: str, column: StructField = DAY) -> set[int | None]:
    """The days a folder of sums holds, none where there is no folder; as many as a batch has."""
    try:
        found = spark.read.schema(StructType([*SUMS.fields, column])).parquet(path)
        return {row.day for row in found.select("day").distinct().collect()}
    except AnalysisException:
        return set()


def _among(days: set[int | None]) -> Column:
    known = F.col("day").isin(sorted(d for d in days if d is not None))
    return known | F.col("day").isNull() if None in days else known


def _by_day(df: DataFrame) -> DataFrame:
    """Rows of a day in order of time, dealt by ten minutes, so that no task takes a whole day."""
    spans = df.repartition("day", F.floor(F.col("elapsed_time") / F.lit(600_000)))
    return spans.sortWithinPartitions("day", *SITE, "elapsed_time")


def absorb(points: DataFrame, root: str, batch: str, site: SiteConfig) -> DataFrame:
    """Add a batch of clean points to the table at ``root`` and return the table.

    A batch that is run again replaces what it added before, its days of then included: run a batch
    again if it failed, or with corrected files. Late points of old days are a matter of course.
    One batch at a time; only the days of a batch (not its rows) reach the driver.
    """
    spark = points.sparkSession
    part, noted = f"{root}/sums/batch={batch}", f"{root}/noted/{batch}"
    days = _days(spark, part) | _noted(spark, noted)
    _note(spark, noted, days)  # a run that fails below leaves its old days to the next one
    day = F.floor(F.col("elapsed_time") / F.lit(DAY_MS)).cast("int").alias("day")
    sums = _by_day(section_sums(points, site).select("*", day))
    sums.write.mode("overwrite").partitionBy("day").parquet(part)
    days |= _days(spark, part)
    if days:
        touched = _all_sums(spark, root).filter(_among(days))
        left = {row.day for row in touched.select("day").distinct().collect()}
        means = section_means(touched).select(
            *[F.col(f.name).cast(f.dataType) for f in schemas.SECTION_AGG],
            F.floor(F.col("elapsed_time") / F.lit(DAY_MS)).cast("int").alias("day"),
        )
        table = f"{root}/sections"
        writer = _by_day(means).write.mode("overwrite").option("partitionOverwriteMode", "dynamic")
        writer.partitionBy("day").parquet(table)
        for gone in days - left:
            folder = "__HIVE_DEFAULT_PARTITION__" if gone is None else gone
            empty = spark.createDataFrame([], schemas.SECTION_AGG).coalesce(1)
            empty.write.mode("overwrite").parquet(f"{table}/day={folder}")
    _note(spark, noted, set())
    return read(spark, root)


def _all_sums(spark: SparkSession, root: str) -> DataFrame:
    stored = StructType([*SUMS.fields, StructField("batch", StringType()), DAY])
    return spark.read.schema(stored).option("basePath", f"{root}/sums").parquet(f"{root}/sums")


def _note(spark: SparkSession, path: str, days: set[int | None]) -> None:
    rows = [(d,) for d in days]
    spark.createDataFrame(rows, StructType([DAY])).coalesce(1).write.mode("overwrite").parquet(path)


def _noted(spark: SparkSession, path: str) -> set[int | None]:
    try:
        return {row.day for row in spark.read.schema(StructType([DAY])).parquet(path).collect()}
    except AnalysisException:
        return set()


def read(spark: SparkSession, root: str) -> DataFrame:
    """The section aggregate of all batches absorbed so far."""
    stored = StructType([*schemas.SECTION_AGG.fields, DAY])
    return spark.read.schema(stored).parquet(f"{root}/sections").drop("day")
