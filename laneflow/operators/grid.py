"""Dense lane x section grids, one per time window."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneflow.config import SiteConfig
from laneflow.functions import cells

WINDOW = ("location", "time_window")


def dense_grid(
    windows: DataFrame,
    site: SiteConfig,
    with_ramp: bool = True,
    velocity_type: str = "int",
    keys: tuple[str, ...] = WINDOW,
) -> DataFrame:
    """One ``lanes x sections`` matrix of (vel, dens, acc) per window.

    Expects one row per window x section x lane, so a group holds at most ``lanes * (sections+1)``
    entries. Integer velocities drop the fraction of the mean. A window whose rows all lie outside
    the grid still yields a matrix of defaults.
    """
    lanes, sections = site.lanes(with_ramp), site.sections
    payload = F.struct(
        F.col("avg_vel").cast(velocity_type).alias("vel"),
        F.col("n").cast("double").alias("dens"),
        F.col("avg_acc").cast("double").alias("acc"),
    )
    default = F.struct(
        F.lit(site.default_speed).cast(velocity_type).alias("vel"),
        F.lit(0.0).alias("dens"),
        F.lit(0.0).alias("acc"),
    )
    entry = cells.cell_entry(F.col("lane_id"), F.col("section_id"), payload, lanes, sections)
    return (
        windows.groupBy(*keys)
        .agg(F.collect_list(entry).alias("entries"))
        .select(*keys, cells.grid(F.col("entries"), default, lanes, sections).alias("matrix"))
    )


def empty_matrix(site: SiteConfig, with_ramp: bool = True, velocity_type: str = "int") -> Column:
    """The matrix of a window without data: defaults in all cells."""
    cell = F.struct(
        F.lit(site.default_speed).cast(velocity_type).alias("vel"),
        F.lit(0.0).alias("dens"),
        F.lit(0.0).alias("acc"),
    )
    return F.array_repeat(F.array_repeat(cell, site.sections), site.lanes(with_ramp))


def grid_cells(grids: DataFrame, sections: int, keys: tuple[str, ...] = WINDOW) -> DataFrame:
    """The same grid in long form, one row per window x lane x section; no join, no shuffle."""
    pos = F.col("pos")
    return grids.select(*keys, F.posexplode(F.flatten("matrix")).alias("pos", "cell")).select(
        *keys,
        cells.lane_of(pos, sections).alias("lane_id"),
        cells.section_of(pos, sections).alias("section_id"),
        "cell.vel",
        "cell.dens",
        "cell.acc",
    )


def channel_cells(grids: DataFrame, keys: tuple[str, ...] = WINDOW) -> DataFrame:
    """Each feature flattened to an array of ``lanes * sections`` values."""
    return grids.select(*keys, *[cells.channel(F.col("matrix"), c).alias(c) for c in cells.CHANNELS])
