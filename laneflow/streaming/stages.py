"""Stateful stages of the real-time pipeline, all in append mode.

frame -> tumbling window -> matrix -> sliding history. The watermark is set at ingest, before the
first aggregate, so every state is dropped once final and each window is emitted exactly once.
Every aggregate combines map-side before its shuffle.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneflow.config import SiteConfig
from laneflow.functions import cells
from laneflow.operators.aggregate import add_section
from laneflow.operators.clean import add_distance


def window_alignment(origin_ms: int, window_ms: int) -> str:
    """``startTime`` that makes event-time windows begin where elapsed-time windows do."""
    return f"{origin_ms % window_ms} milliseconds"


def add_event_time(points: DataFrame, site: SiteConfig, delay: str) -> DataFrame:
    """Event time with its watermark.

    An instant, not the site's wall clock: that one repeats an hour each autumn, and a whole hour
    would come late. Results are labelled with the wall clock.
    """
    instant = F.timestamp_millis(F.col("global_time") - F.lit(site.offset_ms))
    return points.withColumn("datetime", instant).withWatermark("datetime", delay)


def wall_clock(window: str, tz: str) -> Column:
    """A window of instants on the wall clock of ``tz``."""
    ends = [F.from_utc_timestamp(f"{window}.{end}", tz).alias(end) for end in ("start", "end")]
    return F.struct(*ends)


def dedup_points(points: DataFrame) -> DataFrame:
    """One point per site, vehicle and frame: of several the one with the least values.

    For at-least-once sources. Written as an aggregate rather than a de-duplication: copies are
    dropped map-side, so a message sent a million times does not meet in one task.
    """
    keys = ("location", "vehicle_id", "datetime")
    rest = [c for c in points.columns if c not in keys]
    return points.groupBy(*keys).agg(F.min(F.struct(*rest)).alias("_kept")).select(*keys, "_kept.*")


def frame_sections(points: DataFrame, site: SiteConfig) -> DataFrame:
    """Mean speed per frame x section x lane, not rounded."""
    placed = add_section(add_distance(points), site)
    return placed.groupBy("location", "datetime", "section_id", "lane_id").agg(
        F.avg("v_vel").alias("avg_vel")
    )


def tumbling_sections(frames: DataFrame, window: str, start_time: str) -> DataFrame:
    """Mean of the frame means per tumbling window x section x lane."""
    timewindow = F.window("datetime", window, startTime=start_time).alias("timewindow")
    return frames.groupBy("location", timewindow, "section_id", "lane_id").agg(
        F.round(F.avg("avg_vel"), 1).alias("avg_vel")
    )


def window_matrices(windows: DataFrame, site: SiteConfig, with_ramp: bool) -> DataFrame:
    """``(lanes, sections, 1)`` integer speeds per window."""
    lanes, sections = site.lanes(with_ramp), site.sections
    entry = cells.cell_entry(
        F.col("lane_id"), F.col("section_id"), F.col("avg_vel").cast("int"), lanes, sections
    )
    grid = cells.grid(F.col("entries"), F.lit(site.default_speed), lanes, sections)
    matrix = F.transform(grid, lambda row: F.transform(row, lambda cell: F.array(cell)))
    return (
        windows.groupBy("location", "timewindow")
        .agg(F.collect_list(entry).alias("entries"))
        .select("location", "timewindow", matrix.alias("matrix"))
    )


def histories(
    matrices: DataFrame, by: str | Column, length: str, slide: str, start_time: str
) -> DataFrame:
    """Matrices of each sliding window in order of time.

    The names of the windows are fixed values of the message contract. ``by`` is the window column inside one query, or the event-time column of a second one.
    """
    based = F.window(by, length, slide, start_time).alias("based_timewindow")
    collected = F.sort_array(F.collect_list(F.struct("timewindow", "matrix")))
    return (
        matrices.groupBy("location", based)
        .agg(collected.alias("steps"))
        .select(
            "location",
            "based_timewindow",
            F.col("steps.timewindow").alias("timewindows"),
            F.col("steps.matrix").alias("history"),
        )
    )


def received_matrices(matrices: DataFrame, delay: str) -> DataFrame:
    """Matrices read back from a topic: watermark on the window start, re-sent windows dropped."""
    return (
        matrices.withColumn("datetime", F.col("timewindow.start"))
        .withWatermark("datetime", delay)
        .dropDuplicatesWithinWatermark(["location", "datetime"])
    )
