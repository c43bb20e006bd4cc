"""Time-ordered series of windows, sliding samples, chronological split.

One site may own most of the windows, so nothing here sorts a site in one task: ranks are counted
per block of windows and shifted by the (tiny) running total of the blocks before, and sliding
frames run per chunk of the series with the few rows that reach over the boundary duplicated.
"""

from __future__ import annotations

from collections.abc import Iterable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from laneflow.config import SampleConfig
from laneflow.operators.joins import join_by

SITE = ("location",)


def gap_filled(
    grids: DataFrame,
    default: Column,
    keys: tuple[str, ...] = SITE,
    order: str = "time_window",
    payload: str = "matrix",
) -> DataFrame:
    """The series with a row for every missing window between a site's windows, ``payload`` default.

    The gap behind a window is as long as the next one is away: one window per site over
    (``order``) of the narrow keys, and one ``explode``; nothing is joined.
    """
    # Ends of the series are found like any other, per block, so that no site is sorted in one task.
    block = F.floor(F.col(order) / F.lit(4096))
    placed = grids.select(*keys, order, payload).withColumn("_block", block)
    heads = placed.groupBy(*keys, "_block").agg(F.min(order).alias("_head")).select(
        F.struct(*keys).alias("_at"),
        F.col("_block"),
        F.lead("_head").over(Window.partitionBy(*keys).orderBy("_block")).alias("_next_head"),
    )
    inside = F.lead(order).over(Window.partitionBy(*keys, "_block").orderBy(order))
    ahead = (
        placed.withColumn("_next", inside)
        .withColumn("_at", F.struct(*keys))
        .join(heads, ["_at", "_block"])
        .withColumn("_next", F.coalesce("_next", "_next_head", F.col(order) + 1))
    )
    filled = ahead.select(
        *keys,
        F.col(order).alias("_own"),
        F.explode(F.sequence(F.col(order), F.col("_next") - 1)).alias(order),
        payload,
    )
    own = F.col(order) == F.col("_own")
    return filled.select(*keys, order, F.when(own, F.col(payload)).otherwise(default).alias(payload))


def series_index(
    grids: DataFrame, keys: tuple[str, ...] = SITE, order: str = "time_window", block: int = 4096
) -> DataFrame:
    """Add ``idx`` (0-based rank of the window within its site) and ``series_len``.

    Windows without data have no rank, as in the series the samples are cut from. ``grids`` is
    read twice; materialize it first when it is expensive.
    """
    with_block = grids.withColumn("_block", F.floor(F.col(order) / F.lit(block)))
    site = Window.partitionBy(*keys)
    before = site.orderBy("_block").rowsBetween(Window.unboundedPreceding, -1)
    offsets = (
        with_block.groupBy(*keys, "_block")
        .agg(F.count(F.lit(1)).alias("_n"))
        .select(
            *keys,
            "_block",
            F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_offset"),
            F.sum("_n").over(site).alias("series_len"),
        )
    )
    rank = F.row_number().over(Window.partitionBy(*keys, "_block").orderBy(order))
    return (
        join_by(with_block, offsets, [*keys, "_block"])
        .withColumn("idx", F.col("_offset") + rank - F.lit(1))
        .drop("_block", "_offset")
    )


def samples(
    series: DataFrame,
    config: SampleConfig,
    num_windows: int | None = None,
    keys: tuple[str, ...] = SITE,
    order: str = "time_window",
    payload: str = "matrix",
    chunk: int = 1024,
    drop_last: bool = True,
) -> DataFrame:
    """Sliding samples: ``history`` windows, a gap of ``skip``, then ``predict`` target windows.

    Sample ``i`` starts at window ``i``. Steps carry ``order`` and ``payload``; choose a narrow
    payload where one feature is enough, as every window is repeated in ``history`` samples.
    ``num_windows`` bounds the series (its length by default);
    ``drop_last`` leaves out the last possible sample, as the study's loop bound does.
    """
    return samples_by_skip(
        series, config, [config.skip], num_windows, keys, order, payload, chunk, drop_last
    ).drop("skip")


def samples_by_skip(
    series: DataFrame,
    config: SampleConfig,
    skips: Iterable[int],
    num_windows: int | None = None,
    keys: tuple[str, ...] = SITE,
    order: str = "time_window",
    payload: str = "matrix",
    chunk: int = 1024,
    drop_last: bool = True,
) -> DataFrame:
    """The samples of several gaps in one pass, told apart by ``skip``: they share their histories."""
    h, predict, skips = config.history, config.predict, sorted(set(skips))
    widest = h + skips[-1] + predict
    chunk = max(chunk, widest)
    idx = F.col("idx")
    home = F.floor(idx / F.lit(chunk))
    reaches_back = (F.pmod(idx, F.lit(chunk)) < widest - 1) & (home > 0)
    copies = F.when(reaches_back, F.array(home, home - 1)).otherwise(F.array(home))

    usable = F.col("series_len")
    if num_windows is not None:
        usable = F.least(usable, F.lit(num_windows).cast("bigint"))

    ahead = Window.partitionBy(*keys, "_chunk").orderBy("idx")
    step = F.collect_list(F.struct(order, payload))

    def gap(skip: int) -> Column:
        span = h + skip + predict
        total = F.greatest(usable - F.lit(span if drop_last else span - 1), F.lit(0))
        target = step.over(ahead.rowsBetween(h + skip, span - 1))
        return F.struct(F.lit(skip).alias("skip"), total.alias("num_samples"), target.alias("target"))

    framed = series.withColumn("_chunk", F.explode(copies)).select(
        *keys,
        "idx",
        "_chunk",
        step.over(ahead.rowsBetween(0, h - 1)).alias("history"),
        F.array(*[gap(skip) for skip in skips]).alias("_gaps"),
    )
    own = framed.filter(home == F.col("_chunk")).select(
        *keys, idx.alias("sample_id"), "history", F.explode("_gaps").alias("_gap")
    )
    return own.filter(F.col("sample_id") < F.col("_gap.num_samples")).select(
        *keys, "sample_id", "_gap.num_samples", "_gap.skip", "history", "_gap.target"
    )


def chrono_split(
    df: DataFrame, test: float = 0.2, validation: float = 0.1, realtime: bool = False
) -> DataFrame:
    """Label samples train / validation / test in order of time; no test part in real-time mode."""
    n, i = F.col("num_samples"), F.col("sample_id")
    if realtime:
        split = F.when(i < F.floor(F.lit(1 - 0.125) * n), "train").otherwise("validation")
    else:
        first_cut = F.floor(F.lit(1 - (validation + test)) * n)
        second_cut = F.floor(F.lit(1 - test) * n)
        split = (
            F.when(i < first_cut, "train").when(i < second_cut, "validation").otherwise("test")
        )
    return df.withColumn("split", split)


def sample_steps(df: DataFrame, keys: tuple[str, ...] = SITE) -> DataFrame:
    """Long form of samples: one row per sample x role x step, with that window's matrix."""

    def role(name: str) -> Column:
        return F.transform(
            name,
            lambda window, step: F.struct(
                F.lit(name).alias("role"), step.cast("int").alias("step"), window.alias("window")
            ),
        )

    steps = F.explode(F.concat(role("history"), role("target"))).alias("_s")
    return df.select(*keys, "sample_id", steps).select(
        *keys, "sample_id", "_s.role", "_s.step", "_s.window.time_window", "_s.window.matrix"
    )
