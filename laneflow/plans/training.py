"""Batch jobs: from cleaned points to samples, and a sweep over parameter sets."""

from __future__ import annotations

from collections.abc import Iterable, Sequence
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from laneflow.config import ExperimentConfig, SampleConfig, SiteConfig, WindowConfig
from laneflow.functions import cells
from laneflow.operators import aggregate, forecast, grid, regression, series
from laneflow.session import materialize

REGRESSION = "regression"


def window_grids(
    sections: DataFrame, site: SiteConfig, window: WindowConfig, with_ramp: bool = True
) -> DataFrame:
    """Section aggregate to one dense matrix per time window."""
    return grid.dense_grid(aggregate.timewindow_agg(sections, window), site, with_ramp)


def sample_set(
    grids: DataFrame, sample: SampleConfig, num_windows: int | None = None, realtime: bool = False
) -> DataFrame:
    """Labelled samples of whole matrices, from a table of them (read twice, so a written one)."""
    samples = series.samples(series.series_index(grids), sample, num_windows=num_windows)
    return series.chrono_split(samples, realtime=realtime)


def feature_cells(grids: DataFrame, features: Sequence[str] = ("vel",)) -> DataFrame:
    """Windows with their features as one flat array, channel after channel."""
    channels = [cells.channel(F.col("matrix"), f).cast("array<double>") for f in features]
    flat = cells.channel(F.col("matrix"), features[0]) if len(features) == 1 else F.concat(*channels)
    return grids.select(*grid.WINDOW, flat.alias("cells"))


def sample_inputs(
    grids: DataFrame,
    sample: SampleConfig,
    num_windows: int | None = None,
    realtime: bool = False,
    features: Sequence[str] = ("vel",),
) -> DataFrame:
    """Labelled model inputs: features of the samples as flat arrays; the target is the first one.

    Other features are left out before the windows are repeated in overlapping samples.
    """
    ordered = series.series_index(feature_cells(grids, features))
    samples = series.samples(ordered, sample, num_windows=num_windows, payload="cells")
    if len(features) > 1:
        target = F.transform(
            "target",
            lambda step: F.struct(
                step["time_window"].alias("time_window"),
                F.slice(step["cells"], F.lit(1), F.floor(F.size(step["cells"]) / F.lit(len(features))).cast("int")).alias("cells"),
            ),
        )
        samples = samples.withColumn("target", target)
    return series.chrono_split(forecast.model_input(samples, "cells"), realtime=realtime)


def skip_inputs(
    flat: DataFrame, sample: SampleConfig, skips: Iterable[int], num_windows: int | None = None
) -> DataFrame:
    """Labelled model inputs of several gaps, from a ranked series of flat ``cells``."""
    samples = series.samples_by_skip(flat, sample, skips, num_windows=num_windows, payload="cells")
    return series.chrono_split(forecast.model_input(samples, "cells"))


def baseline_cells(
    inputs: DataFrame, models: Iterable[str], lanes: int, sections: int, predict: int = 1
) -> DataFrame:
    """Test samples forecast by each baseline, cell by cell; one pass for all of them."""
    guesses = [
        F.struct(
            F.lit(m).alias("model"), forecast.BASELINES[m](F.col("history"), predict).alias("guess")
        )
        for m in models
    ]
    keys = ("location", "sample_id", *(["skip"] if "skip" in inputs.columns else []))
    guess = F.explode(F.array(*guesses)).alias("g")
    test = inputs.filter(F.col("split") == "test").select(*keys, "actual", guess)
    flat = test.select(*keys, "g.model", F.col("g.guess").alias("prediction"), "actual")
    return forecast.forecast_cells(flat, lanes, sections, (*keys, "model"))


def evaluate(
    inputs: DataFrame, models: Iterable[str], lanes: int, sections: int, predict: int = 1
) -> DataFrame:
    """Error metrics on the test samples, one row per ``model`` and, where inputs have it, ``skip``."""
    models = list(models)
    unknown = set(models) - set(forecast.BASELINES) - {REGRESSION}
    if unknown:
        raise ValueError(f"unknown models {sorted(unknown)}")
    gap = ("skip",) if "skip" in inputs.columns else ()
    scored = []
    baselines = [m for m in models if m in forecast.BASELINES]
    if baselines:
        scored.append(baseline_cells(inputs, baselines, lanes, sections, predict))
    if REGRESSION in models:
        keys = (*gap, *regression.MODEL)
        rows = materialize(regression.lag_rows(inputs, lanes * sections), "lag-rows")
        weights = materialize(regression.fitted(rows, lanes * sections, keys=keys), "weights")
        best = regression.chosen(rows, weights, keys)
        test = regression.predictions(rows.filter(F.col("split") == "test"), best, keys)
        scored.append(test.withColumn("model", F.lit(REGRESSION)))
    columns = (*gap, "model", "prediction", "actual")
    together = reduce(DataFrame.unionByName, [df.select(*columns) for df in scored])
    return forecast.error_metrics(together, (*gap, "model"))


def run_experiments(
    sections: DataFrame,
    site: SiteConfig,
    experiments: Iterable[ExperimentConfig],
    models: Iterable[str] = (REGRESSION,),
    window: WindowConfig | None = None,
) -> DataFrame:
    """Error metrics of every model under every parameter set, one row each.

    Window aggregates depend on the window length only and ranked series of flat grids on the ramp
    lane as well, so each is built and written once. Parameter sets that differ in the gap alone
    share their series, histories and one pass over the samples.
    """
    window = window or WindowConfig()
    models, experiments = list(models), list(experiments)
    windows: dict[float, DataFrame] = {}
    flats: dict[tuple[float, bool], DataFrame] = {}
    groups: dict[tuple, list[ExperimentConfig]] = {}
    for exp in experiments:
        config = WindowConfig(exp.window_seconds, window.start, window.end, window.trim_ms)
        if config.num_windows is not None:
            exp.sample.num_samples(config.num_windows)
        s = exp.sample
        groups.setdefault((exp.window_seconds, exp.with_ramp, s.history, s.predict), []).append(exp)
    scored = []
    for (seconds, with_ramp, _, predict), members in groups.items():
        config = WindowConfig(seconds, window.start, window.end, window.trim_ms)
        if seconds not in windows:
            windows[seconds] = materialize(aggregate.timewindow_agg(sections, config), "windows")
        if (seconds, with_ramp) not in flats:
            dense = grid.dense_grid(windows[seconds], site, with_ramp)
            ranked = series.series_index(materialize(feature_cells(dense), "grids"))
            flats[seconds, with_ramp] = materialize(ranked, "ranked-grids")
        skips = [e.sample.skip for e in members]
        inputs = skip_inputs(flats[seconds, with_ramp], members[0].sample, skips, config.num_windows)
        metrics = evaluate(inputs, models, site.lanes(with_ramp), site.sections, predict)
        names = {
            f"{m} {e.sample.skip}": e.model_name(m, site.sections) for m in models for e in members
        }
        named = F.concat_ws(" ", "model", "skip").alias("model_name")
        rest = [c for c in metrics.columns if c not in ("model", "skip")]
        scored.append(metrics.select(named, *rest).replace(names, subset=["model_name"]))
    return reduce(DataFrame.unionByName, scored)
