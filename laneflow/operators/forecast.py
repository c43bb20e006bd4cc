"""Forecasts from histories, alignment with the truth, error metrics."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneflow.functions import cells
from laneflow.operators.joins import join_by

# A predictor maps a batch of histories (rows, history, cells) to forecasts (rows, outputs).
# It is made by a factory on the executor, once per task, so weights are loaded once.
Predictor = Callable[[np.ndarray], np.ndarray]
PredictorFactory = Callable[[], Predictor]

EPSILON = 2.220446049250313e-16  # fixed value: float64 machine epsilon, floor of |y| in MAPE


def model_input(samples: DataFrame, payload: str) -> DataFrame:
    """Samples of flat ``payload`` arrays as ``history`` (steps x cells) and one flat ``actual``."""

    def steps(name: str) -> Column:
        return F.transform(name, lambda step: step[payload])

    return samples.withColumns(
        {"history": steps("history"), "actual": F.flatten(steps("target"))}
    ).drop("target")


def persistence(history: Column, predict: int = 1) -> Column:
    """The last window of the history, repeated for every target window."""
    last = F.transform(F.element_at(history, -1), lambda v: v.cast("double"))
    return F.flatten(F.array_repeat(last, predict))


def history_mean(history: Column, predict: int = 1) -> Column:
    """Mean of each cell over the history, repeated for every target window."""

    def add(total: Column, step: Column) -> Column:
        return F.zip_with(total, step, lambda a, b: a + b)

    zero = F.transform(F.element_at(history, 1), lambda v: F.lit(0.0))
    mean = F.aggregate(
        history, zero, add, lambda total: F.transform(total, lambda v: v / F.size(history))
    )
    return F.flatten(F.array_repeat(mean, predict))


BASELINES: dict[str, Callable[[Column, int], Column]] = {
    "persistence": persistence,
    "history_mean": history_mean,
}


def _predict_batch(flat: pa.Array, predictor: Predictor, steps: int, outputs: int | None) -> pa.Array:
    """Forecasts of one Arrow batch; the list values are one array, so rows need no loop."""
    known = flat.is_valid().to_numpy(zero_copy_only=False)
    n = int(known.sum())
    lengths = np.zeros(len(flat), np.int64)
    values = np.zeros(0)
    if n:
        history = flat.flatten().to_numpy(zero_copy_only=False).reshape(n, steps, -1)
        result = np.asarray(predictor(history), dtype="float64").reshape(n, -1)
        if outputs is not None and result.shape[1] != outputs:
            raise ValueError(f"the predictor gives {result.shape[1]} values a row, not {outputs}")
        lengths[known] = result.shape[1]
        values = result.ravel()
    offsets = np.concatenate([[0], np.cumsum(lengths)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values), mask=pa.array(~known))


def predicted(
    history: Column, factory: PredictorFactory, steps: int, outputs: int | None = None
) -> Column:
    """Apply a predictor to ``history`` (steps x cells) in Arrow batches; NULL stays NULL.

    A predictor that doesn't give ``outputs`` values a row, where that is set, fails the job.
    """

    @F.arrow_udf("array<double>")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        predictor = factory()
        for flat in batches:
            yield _predict_batch(flat, predictor, steps, outputs)

    return run(F.transform(F.flatten(history), lambda v: v.cast("double")))


def forecast_matrix(
    df: DataFrame,
    factory: PredictorFactory,
    steps: int,
    lanes: int,
    sections: int,
    unready: str = "zeros",
    predict: int = 1,
) -> DataFrame:
    """Rounded forecasts per history, one row per target ``step`` with a ``lanes x sections`` matrix.

    Batch or stream. ``history`` is steps x lanes x sections x 1. One shorter than ``steps`` gives
    matrices of zeros, or no row with ``unready="drop"``; the model never sees it. The predictor must
    give ``predict * lanes * sections`` values.
    """
    ready = F.size("history") == steps
    if unready == "drop":
        df = df.filter(ready)
    per_step = lanes * sections
    flat = F.transform(F.col("history"), lambda m: F.flatten(F.flatten(m)))
    raw = predicted(F.when(ready, flat), factory, steps, predict * per_step)
    cells_int = F.transform(raw, lambda v: F.bround(v).cast("int"))
    zeros = F.array_repeat(F.lit(0), predict * per_step)
    whole = df.withColumn("_cells", cells_int).withColumn("_cells", F.coalesce("_cells", zeros))
    by_step = F.transform(
        F.sequence(F.lit(0), F.lit(predict - 1)),
        lambda k: F.slice("_cells", k * F.lit(per_step) + F.lit(1), F.lit(per_step)),
    )
    return whole.select(*df.columns, F.posexplode(by_step).alias("step", "_flat")).withColumn(
        "prediction", cells.unflatten(F.col("_flat"), lanes, sections)
    ).drop("_flat")


def site_models(weights: DataFrame) -> DataFrame:
    """``location, model``: the weights of each site, one entry per target step in order of steps."""
    entry = F.struct("step", "per_lag", "per_cell")
    return weights.groupBy("location").agg(F.sort_array(F.collect_list(entry)).alias("model"))


def forecast_by_site(
    df: DataFrame, models: DataFrame, steps: int, lanes: int, sections: int, predict: int = 1
) -> DataFrame:
    """Rounded forecasts per history by the model of its own site, one row per target ``step``.

    ``models`` is a table of :func:`site_models`; a site's forecast of a cell is the cell's offset plus the
    weighted sum of its history, all column math. A history of a site without a model (or without a site)
    has a ``prediction`` of NULL in a single row with ``step`` NULL; one shorter than ``steps`` gives
    matrices of zeros. A model that has not ``predict`` target steps or weights for ``steps`` windows
    fails the query.
    """
    per_step = lanes * sections
    known = models.select(F.struct("location").alias("_at"), "model")
    joined = df.withColumn("_at", F.struct("location")).join(known, "_at", "left").drop("_at")
    flat = F.transform("history", lambda m: F.transform(F.flatten(F.flatten(m)), lambda v: v.cast("double")))

    def of_step(entry: Column) -> Column:
        def of_cell(offset: Column, i: Column) -> Column:
            terms = F.zip_with(entry["per_lag"], "_flat", lambda weight, seen: weight * F.get(seen, i))
            return F.aggregate(terms, offset, lambda total, term: total + term)

        fits = (F.size(entry["per_lag"]) == steps) & (F.size(entry["per_cell"]) == per_step)
        cells_out = F.transform(entry["per_cell"], lambda offset, i: F.bround(of_cell(offset, i)).cast("int"))
        return F.when(fits, cells_out).otherwise(F.raise_error(F.lit("the model has weights for another grid or history")))

    zeros = F.array_repeat(F.array_repeat(F.lit(0), per_step), predict)
    made = F.when(F.size("model") != predict, F.raise_error(F.lit(f"the model has not {predict} target steps")))
    made = made.when(F.size("history") != steps, zeros).otherwise(F.transform("model", of_step))
    by_step = F.when(F.col("model").isNotNull(), made)
    out = joined.withColumn("_flat", flat).withColumn("_steps", by_step)
    return out.select(*df.columns, F.posexplode_outer("_steps").alias("step", "_cells")).withColumn(
        "prediction", F.when(F.col("_cells").isNotNull(), cells.unflatten(F.col("_cells"), lanes, sections))
    ).drop("_cells")


def with_truth(
    predictions: DataFrame, truth: DataFrame, keys: tuple[str, ...] = ("location", "sample_id")
) -> DataFrame:
    """Join forecasts to the flat truth that became known later, one row per sample."""
    return join_by(predictions, truth.select(*keys, "actual"), keys)


def forecast_cells(
    df: DataFrame, lanes: int, sections: int, keys: tuple[str, ...] = ("location", "sample_id")
) -> DataFrame:
    """Flat ``prediction`` and ``actual`` side by side, one row per target step, lane, section.

    A missing array, or two of different lengths, fail the query: a mean over what is there would
    look better than the forecast is.
    """
    fits = F.size("prediction") == F.size("actual")
    told = F.concat(F.lit("forecast and truth differ in length or are missing: "), F.to_json(F.struct(*keys)))
    pairs = F.when(fits, F.arrays_zip("prediction", "actual")).otherwise(F.raise_error(told))
    exploded = df.select(*keys, F.posexplode(pairs).alias("pos", "pair"))
    per_step = lanes * sections
    in_grid = F.pmod(F.col("pos"), F.lit(per_step))
    return exploded.select(
        *keys,
        F.floor(F.col("pos") / F.lit(per_step)).cast("int").alias("step"),
        cells.lane_of(in_grid, sections).alias("lane_id"),
        cells.section_of(in_grid, sections).alias("section_id"),
        F.col("pair.prediction").cast("double").alias("prediction"),
        F.col("pair.actual").cast("double").alias("actual"),
    )


def error_metrics(df: DataFrame, keys: tuple[str, ...] = ()) -> DataFrame:
    """MSE, MAE, MAPE, MAAPE and RMSE over all samples and cells, in one pass.

    The arctangent error is pi/2 where only the truth is 0, and 0 where both are. A NULL forecast or
    truth fails the query.
    """
    y = F.abs("actual")
    known = F.col("actual").isNotNull() & F.col("prediction").isNotNull()
    error = F.when(known, F.abs(F.col("actual") - F.col("prediction"))).otherwise(
        F.raise_error(F.lit("a forecast or its truth is missing")).cast("double")
    )
    arctan = F.when(y != 0, F.atan(F.try_divide(error, y))).when(error == 0, 0.0)
    mse = F.avg(error * error)
    return df.groupBy(*keys).agg(
        mse.alias("mse"),
        F.avg(error).alias("mae"),
        F.avg(error / F.greatest(y, F.lit(EPSILON))).alias("mape"),
        F.avg(arctan.otherwise(math.pi / 2)).alias("maape"),
        F.sqrt(mse).alias("rmse"),
    )
