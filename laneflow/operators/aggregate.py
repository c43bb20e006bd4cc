"""Two-level speed aggregates, extents, counts and histograms.

All of them aggregate map-side first, so a cell, lane or site that holds a large share of the rows
sends one partial row per task through the shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneflow.config import SiteConfig, WindowConfig
from laneflow.functions import scalar
from laneflow.operators.joins import join_by

CELL = ("section_id", "lane_id")
SITE = ("location",)


def _mean(column: str, digits: int, rounded: bool = True) -> Column:
    mean = F.avg(column)
    return F.round(mean, digits) if rounded else mean


def add_section(df: DataFrame, site: SiteConfig) -> DataFrame:
    return df.withColumn("section_id", scalar.section_bin(F.col("distance"), site.section_width))


def section_agg(
    df: DataFrame, site: SiteConfig, round_frame: bool = True, keys: tuple[str, ...] = SITE
) -> DataFrame:
    """Mean speed and acceleration, and number of vehicles, per frame x section x lane."""
    return (
        add_section(df, site)
        .groupBy(*keys, "elapsed_time", *CELL)
        .agg(
            _mean("v_vel", 1, round_frame).alias("avg_vel"),
            _mean("v_acc", 2, round_frame).alias("avg_acc"),
            F.count(F.lit(1)).alias("n"),
        )
    )


def add_time_window(df: DataFrame, window: WindowConfig, trim: bool = False) -> DataFrame:
    """Restrict to the configured range and number its time windows."""
    keep = scalar.in_range(
        F.col("elapsed_time"), window.start, window.end, window.trim_ms if trim else 0
    )
    return df.filter(keep).withColumn(
        "time_window", scalar.window_bin(F.col("elapsed_time"), window.millis)
    )


def timewindow_agg(
    sections: DataFrame, window: WindowConfig, keys: tuple[str, ...] = SITE
) -> DataFrame:
    """Unweighted mean of the frame means per time window x section x lane.

    ``n`` counts frames that saw the cell occupied; ``vehicles`` counts points.
    """
    return (
        add_time_window(sections, window, trim=True)
        .groupBy(*keys, "time_window", *CELL)
        .agg(
            _mean("avg_vel", 1).alias("avg_vel"),
            _mean("avg_acc", 2).alias("avg_acc"),
            F.count(F.lit(1)).alias("n"),
            F.sum("n").alias("vehicles"),
        )
    )


def extent(df: DataFrame, keys: tuple[str, ...] = SITE) -> DataFrame:
    """Largest elapsed time and distance: one aggregate instead of two sorts."""
    return df.groupBy(*keys).agg(
        F.max("elapsed_time").alias("max_elapsed"), F.max("distance").alias("max_dist")
    )


def first_last(df: DataFrame, order: str, keys: tuple[str, ...] = SITE) -> DataFrame:
    """First and last row of each group by ``order``, without sorting the group.

    Of several first rows the one with the least remaining columns, in their order, is taken; of
    several last rows the one with the greatest. One hash aggregate finds the ends, and only rows at
    an end are compared as a whole. Rows without ``order`` are never an end.
    """
    rest = [c for c in df.columns if c not in keys and c != order]
    whole = F.struct(order, *rest)
    ends = df.groupBy(*keys).agg(F.min(order).alias("_low"), F.max(order).alias("_high"))
    ends = ends.select(F.struct(*keys).alias("_at"), "_low", "_high")
    at_end = df.withColumn("_at", F.struct(*keys)).join(ends, "_at")
    at_end = at_end.filter((F.col(order) == F.col("_low")) | (F.col(order) == F.col("_high")))
    picked = at_end.groupBy("_at").agg(
        F.min(F.when(F.col(order) == F.col("_low"), whole)).alias("first"),
        F.max(F.when(F.col(order) == F.col("_high"), whole)).alias("last"),
    )
    columns = [c for c in df.columns if c not in keys]
    return picked.select(
        *[F.col(f"_at.{k}").alias(k) for k in keys],
        *[F.col(f"{end}.{c}").alias(f"{end}_{c}") for end in ("first", "last") for c in columns],
    )


def calendar_counts(df: DataFrame) -> DataFrame:
    return df.groupBy("day", "month", "hour", "year", "location").agg(
        F.count(F.lit(1)).alias("n")
    )


def speed_histogram(df: DataFrame, location: str, lane_id: int) -> DataFrame:
    """Points per rounded speed of one lane, in order of speed (a few hundred rows)."""
    return (
        df.filter((F.col("location") == location) & (F.col("lane_id") == lane_id))
        .groupBy(F.round("v_vel").alias("speed"))
        .agg(F.count(F.lit(1)).alias("n"))
        .orderBy("speed")
    )


def scale_stats(windows: DataFrame, keys: tuple[str, ...] = SITE) -> DataFrame:
    """Bounds for min-max scaling; the lower bound of the count is 0 by definition."""
    return windows.groupBy(*keys).agg(
        F.min("avg_vel").alias("min_vel"),
        F.max("avg_vel").alias("max_vel"),
        F.min("avg_acc").alias("min_acc"),
        F.max("avg_acc").alias("max_acc"),
        F.lit(0).cast("bigint").alias("min_n"),
        F.max("n").alias("max_n"),
    )


def min_max_scaled(
    windows: DataFrame, stats: DataFrame, keys: tuple[str, ...] = SITE
) -> DataFrame:
    """Speed, acceleration and count scaled to [0, 1] with the bounds in ``stats``.

    ``stats`` has one row per site. Read it from a written table, so that Spark knows its size and
    joins it without shuffling the windows.
    """
    pairs = {"avg_vel": "vel", "avg_acc": "acc", "n": "n"}
    scaled = {
        column: scalar.min_max(F.col(column), F.col(f"min_{s}"), F.col(f"max_{s}")).cast("double")
        for column, s in pairs.items()
    }
    bounds = [f"{side}_{s}" for s in pairs.values() for side in ("min", "max")]
    return join_by(windows, stats, keys).withColumns(scaled).drop(*bounds)
