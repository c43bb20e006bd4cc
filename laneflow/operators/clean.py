"""Cleaning, unit conversion and derived columns of raw trajectory points."""

from __future__ import annotations

from collections.abc import Iterable
from datetime import date, datetime, timedelta
from functools import reduce
from operator import or_
from zoneinfo import ZoneInfo

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneflow.config import SiteConfig
from laneflow.functions import geo, scalar
from laneflow.operators.joins import join_by
from laneflow.session import materialize


def at_location(df: DataFrame, location: str) -> DataFrame:
    return df.filter(F.col("location") == F.lit(location))


def merge_ramp_lanes(df: DataFrame, site: SiteConfig) -> DataFrame:
    lane = scalar.merge_lanes(F.col("lane_id"), site.merged_lanes, site.ramp_lane)
    return df.withColumn("lane_id", lane)


def site_filter(df: DataFrame, site: SiteConfig) -> DataFrame:
    """Points of one site, its side lanes counted as the ramp lane."""
    return merge_ramp_lanes(at_location(df, site.location), site)


def convert_units(df: DataFrame) -> DataFrame:
    """Speed and acceleration from ft/s to mph; skip it for input already in mph."""
    return df.withColumns({c: scalar.to_mph(F.col(c)) for c in ("v_vel", "v_acc")})


def reproject(df: DataFrame, crs: str, shift: geo.DatumShift | None = None) -> DataFrame:
    """Planar ``global_x``/``global_y`` become ``lat``/``lon``, moved to another datum if ``shift`` is given."""
    lat, lon = geo.lat_lon(F.col("global_x"), F.col("global_y"), crs)
    out = df.withColumns({"lat": lat, "lon": lon}).drop("global_x", "global_y")
    if shift is None:
        return out
    lat, lon = geo.shifted(F.col("lat"), F.col("lon"), shift)
    return out.withColumns({"lat": lat, "lon": lon})


def add_local_time(df: DataFrame, site: SiteConfig) -> DataFrame:
    return df.withColumn(
        "datetime", scalar.local_time(F.col("global_time"), site.tz, site.offset_ms)
    )


def add_distance(df: DataFrame) -> DataFrame:
    return df.withColumn("distance", scalar.distance(F.col("local_x"), F.col("local_y")))


def add_elapsed(df: DataFrame, origin_ms: int) -> DataFrame:
    return df.withColumn("elapsed_time", F.col("global_time") - F.lit(origin_ms))


def rebase_elapsed(df: DataFrame, offset_ms: int | None = None) -> DataFrame:
    """Count elapsed time from the site's first frame.

    With no known offset it is looked up per location (points without one are a site). The lookup is written first: Spark then
    knows its size, and joins it without shuffling the points unless it is too large to broadcast.
    """
    if offset_ms is not None:
        return df.withColumn("elapsed_time", F.col("elapsed_time") - F.lit(offset_ms))
    first = df.groupBy("location").agg(F.min("elapsed_time").alias("_first"))
    first = materialize(first, "first-frames")
    return (
        join_by(df, first, ["location"])
        .withColumn("elapsed_time", F.col("elapsed_time") - F.col("_first"))
        .drop("_first")
    )


def add_calendar(df: DataFrame) -> DataFrame:
    parts = {"day": F.dayofmonth, "month": F.month, "hour": F.hour, "year": F.year}
    return df.withColumns({name: part("datetime") for name, part in parts.items()})


def hour_filter(
    df: DataFrame, hours: int | Iterable[int], offset_ms: int = 0, ordered: bool = False
) -> DataFrame:
    """Points within the given local hours, re-based by ``offset_ms``, pruned to ten columns.

    ``ordered`` range-shuffles every point by time; leave it off in front of an aggregate.
    """
    hours = [hours] if isinstance(hours, int) else list(hours)
    # The ten columns of the output contract.
    columns = ["location", "elapsed_time", "hour", "distance", "vehicle_id", "lane_id"]
    columns += ["v_vel", "v_acc", "lat", "lon"]
    out = df.filter(F.col("hour").isin(hours)).select(*columns)
    out = rebase_elapsed(out, offset_ms)
    return out.orderBy("elapsed_time") if ordered else out


def lane_filter(df: DataFrame, lane_id: int, ordered: bool = False) -> DataFrame:
    columns = ["location", "elapsed_time", "hour", "distance", "vehicle_id", "lane_id"]
    out = df.filter(F.col("lane_id") == lane_id).select(*columns, "v_vel", "v_acc")
    return out.orderBy("elapsed_time") if ordered else out


def on_days(df: DataFrame, days: Iterable[date], tz: str, offset_ms: int = 0) -> DataFrame:
    """Points of the given local days, as ranges of the stored ``global_time``: the scan can skip
    by them, which it can't by an hour or day that is derived from it."""
    zone = ZoneInfo(tz)

    def start(day: date) -> int:
        return round(datetime(day.year, day.month, day.day, tzinfo=zone).timestamp() * 1000) + offset_ms

    spans = [(start(d), start(d + timedelta(days=1))) for d in sorted(set(days))]
    inside = [(F.col("global_time") >= a) & (F.col("global_time") < b) for a, b in spans]
    return df.filter(reduce(or_, inside, F.lit(False)))


def snapshot(df: DataFrame, elapsed_ms: int, origin_ms: int | None = None) -> DataFrame:
    """Every vehicle at one instant, with its position on the globe.

    With the ``origin_ms`` of the elapsed time the instant is a literal of the stored
    ``global_time`` and reaches the scan.
    """
    columns = ["location", "elapsed_time", "distance", "vehicle_id", "lane_id"]
    out = df.filter(F.col("elapsed_time") == elapsed_ms)
    if origin_ms is not None:
        out = out.filter(F.col("global_time") == F.lit(origin_ms + elapsed_ms))
    return out.select(*columns, "v_vel", "v_acc", "lat", "lon")


def clean_points(df: DataFrame, site: SiteConfig, in_mph: bool = False) -> DataFrame:
    """Raw trajectory rows of a site with every derived column; narrow, no shuffle."""
    out = site_filter(df.toDF(*[c.lower() for c in df.columns]), site)
    out = out if in_mph else convert_units(out)
    out = add_local_time(reproject(out, site.crs), site)
    out = add_elapsed(add_distance(out), site.data_origin_ms)
    return add_calendar(out)
