"""Units, clocks, bins and rounding as column expressions."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

MPH_PER_FTPS_DIVISOR = 1.46666667  # fixed value: ft/s per mph, as rounded in the study


def to_mph(feet_per_second: Column) -> Column:
    return feet_per_second / F.lit(MPH_PER_FTPS_DIVISOR)


def distance(x: Column, y: Column) -> Column:
    """Straight-line distance from the origin of the local coordinates."""
    return F.sqrt(F.pow(x, F.lit(2)) + F.pow(y, F.lit(2)))


def local_time(epoch_ms: Column, tz: str, offset_ms: int = 0) -> Column:
    """Wall clock of ``tz`` at an epoch-millisecond instant (session in UTC)."""
    return F.from_utc_timestamp(F.timestamp_millis(epoch_ms - F.lit(offset_ms)), tz)


def epoch_of_local(wall_clock: Column, tz: str) -> Column:
    """Epoch milliseconds of a wall clock of ``tz``; the inverse of :func:`local_time`."""
    return F.unix_millis(F.to_utc_timestamp(wall_clock, tz))


def merge_lanes(lane: Column, merged: tuple[int, ...], into: int) -> Column:
    return F.when(lane.isin(*merged), F.lit(into)).otherwise(lane)


def section_bin(dist: Column, width: float) -> Column:
    """Section of a distance: truncated towards zero, NULL where no int can hold it."""
    return (dist / F.lit(width)).try_cast("int")


def window_bin(elapsed_ms: Column, window_ms: int) -> Column:
    """Time window of an elapsed time: truncated towards zero.

    A bigint, as epoch-based times in sub-second windows do not fit an int.
    """
    return (elapsed_ms / F.lit(float(window_ms))).cast("bigint")


def in_range(elapsed_ms: Column, start: float, end: float | None, trim_ms: int = 0) -> Column:
    """``[start, end)`` seconds, the upper bound moved down by ``trim_ms``.

    Whole milliseconds are compared with whole numbers: the bounds reach a table scan.
    """
    cond = elapsed_ms >= F.lit(math.ceil(start * 1000)).cast("bigint")
    if end is None:
        return cond
    return cond & (elapsed_ms < F.lit(math.ceil(end * 1000 - trim_ms)).cast("bigint"))


def frame_floor(epoch_ms: Column, frame_ms: int) -> Column:
    """Start of the frame an instant falls into, for sources without a fixed sampling rate."""
    return epoch_ms - F.pmod(epoch_ms, F.lit(frame_ms))


def min_max(value: Column, low: Column, high: Column) -> Column:
    """Scaled to [0, 1]; NULL where the bounds coincide."""
    return F.try_divide(value - low, high - low)
