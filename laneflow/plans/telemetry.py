"""Trajectory-like points over the ``events`` table.

Event types stand for sites and users for vehicles; lane and position follow from the ids. Speeds
are decimals, so every mean is exact and does not depend on the order rows are added in.
"""

from __future__ import annotations

from datetime import UTC, datetime

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from laneflow.config import SiteConfig, WindowConfig
from laneflow.functions import scalar
from laneflow.operators import clean
from laneflow.session import pin

HOUR_MS = 3_600_000
DAY_S = 86_400
SITE = SiteConfig(location="click", tz="UTC", data_origin_ms=0, site_offset_ms=0)
DAILY = WindowConfig(seconds=DAY_S)
SPEED = "decimal(8,2)"


Span = tuple[int, int]  # epoch milliseconds, end excluded


def _in_span(events: DataFrame, span: Span) -> DataFrame:
    """Bounds on the stored timestamp itself, which the scan can skip row groups by."""
    first, end = (
        F.lit(datetime.fromtimestamp(ms / 1000, UTC).replace(tzinfo=None)).cast("timestamp_ntz")
        for ms in span
    )
    return events.filter((F.col("ts") >= first) & (F.col("ts") < end))


def telemetry(spark: SparkSession, sf_dir: str, span: Span | None = None) -> DataFrame:
    """Raw points, of a time span if given; only the columns a query uses are read."""
    events = pin(spark).read.parquet(f"{sf_dir}/events.parquet")
    events = _in_span(events, span) if span else events
    event, user = F.col("event_id"), F.col("user_id")
    return events.select(
        event,
        user.alias("vehicle_id"),
        F.unix_millis(F.col("ts").cast("timestamp")).alias("global_time"),
        (user % 8 + 1).cast("int").alias("lane_id"),
        (event % 60).cast("double").alias("local_x"),
        (event * 7919 % 2224).cast("double").alias("local_y"),
        (event % 60 + 6_042_000).cast("double").alias("global_x"),
        (event * 7919 % 2224 + 2_133_000).cast("double").alias("global_y"),
        F.col("value").cast(SPEED).alias("v_vel"),
        (event % 21 - 10).cast(SPEED).alias("v_acc"),
        F.col("event_type").alias("location"),
    )


def points(spark: SparkSession, sf_dir: str, span: Span | None = None) -> DataFrame:
    """Points with merged lanes, distance and elapsed time."""
    merged = clean.merge_ramp_lanes(telemetry(spark, sf_dir, span), SITE)
    return clean.add_elapsed(clean.add_distance(merged), SITE.origin_ms)


def frames(spark: SparkSession, sf_dir: str, span: Span | None = None) -> DataFrame:
    """The same points, their times floored to hourly frames."""
    floored = scalar.frame_floor(F.col("global_time"), HOUR_MS)
    merged = clean.merge_ramp_lanes(telemetry(spark, sf_dir, span), SITE)
    merged = merged.withColumn("global_time", floored)
    return clean.add_elapsed(clean.add_distance(merged), SITE.origin_ms)
