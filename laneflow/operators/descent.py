"""Speed regression under a smooth absolute error, fitted in epochs with an early stop.

The model is that of :mod:`regression`, ``y = offset[cell] + sum(weight[j] * lag[j])``, but its error
``sqrt(1 + r^2) - 1`` counts large residuals by their size and not by its square, so single odd
windows don't pull the weights. It has no closed form. Each epoch is one look at all samples: batches
add up gradients and errors where they lie, the sums are shuffled (their size depends on the model),
and all models step forward in column math. A model stops once its validation error hasn't improved
for ``patience`` epochs; its best weights are kept.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from laneflow.operators.aggregate import SITE
from laneflow.operators.joins import join_by
from laneflow.operators.regression import Lags, LagModel
from laneflow.session import fresh_path, materialize

# Decay of the mean and of the largest gradient, and what keeps 0 / 0 away.
BETA_MEAN, BETA_MAX, EPSILON = 0.9, 0.999, 1e-8


@dataclass(frozen=True)
class Descent:
    """Settings of a fit; ``centres`` and ``units`` scale the channels, the target is the first one.

    Residuals well below one unit count by their square, residuals well above it by their size.
    """

    rate: float = 0.01
    epochs: int = 500
    patience: int = 2
    centres: tuple[float, ...] = (60.0,)
    units: tuple[float, ...] = (10.0,)

    def __post_init__(self) -> None:
        if self.epochs < 0 or self.patience < 1 or self.rate <= 0:
            raise ValueError("epochs must be >= 0, patience >= 1 and rate > 0")
        if len(self.centres) != len(self.units) or min(self.units) <= 0:
            raise ValueError("every channel needs a centre and a unit above 0")

    def per_lag(self, lags: Lags, steps: int) -> tuple[np.ndarray, np.ndarray]:
        """Centre and unit of each lag."""
        places = 1 if lags.sections is None else 3
        return tuple(np.tile(np.repeat(v, places), steps) for v in (self.centres, self.units))


@dataclass
class Descended:
    """A fit: ``weights`` as :class:`regression.LagModel` takes them, ``log`` with the epochs' errors.

    ``log`` has a row per site and epoch: ``epoch`` (0: before the first step), ``loss``, ``val_loss``
    (NULL without validation samples), ``best_epoch`` so far and ``running``.
    """

    weights: DataFrame
    log: DataFrame
    lags: Lags

    @property
    def model(self) -> LagModel:
        return LagModel(self.weights, self.lags)


def _numbers(column: pa.Array, depth: int) -> np.ndarray:
    for _ in range(depth):
        column = column.flatten()
    values = column.to_numpy(zero_copy_only=False)
    if np.isnan(values).any():
        raise ValueError("a sample to fit on has missing speeds")
    return values


def _sums(samples: DataFrame, lags: Lags, steps: int, config: Descent, keys: tuple[str, ...]) -> DataFrame:
    """Per model its gradient's sums, then error and count of the train and of the validation cells.

    ``samples`` carry the weights ``w`` of their model. One row per batch, model and sum before the shuffle.
    """
    names = [f.simpleString().replace(":", " ", 1) for f in samples.select(*keys).schema.fields]
    centre, unit = config.per_lag(lags, steps)

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = batch.num_rows
            if not rows:
                continue
            history = _numbers(batch.column("history"), 2).reshape(rows, steps, -1)
            x = (lags.stacked(history) - centre[:, None]) / unit[:, None]
            y = _numbers(batch.column("actual"), 1).reshape(rows, -1, lags.per_step)
            y = (y - config.centres[0]) / config.units[0]
            train = batch.column("train").to_numpy(zero_copy_only=False)
            frame = pd.DataFrame({k: batch.column(k).to_pylist() for k in keys})
            for at in frame.groupby(list(keys), dropna=False, sort=False).indices.values():
                first = int(at[0])
                w = np.array(batch.column("w")[first].as_py()).reshape(y.shape[1], -1)
                lag, offset = w[:, : len(centre)], w[:, len(centre) :]
                own, mine = x[at], train[at]
                r = y[at] - np.einsum("sl,nlc->nsc", lag, own) - offset
                root = np.sqrt(1 + r * r)
                loss, cells = (root - 1).sum(axis=(1, 2)), r[0].size
                push = np.where(mine[:, None, None], r / root, 0.0)
                gradient = np.concatenate([np.einsum("nsc,nlc->sl", push, own), push.sum(axis=0)], axis=1)
                ends = [loss[mine].sum(), mine.sum() * cells, loss[~mine].sum(), (~mine).sum() * cells]
                values = np.concatenate([-gradient.ravel(), ends]).astype(float)
                arrays = [
                    pa.array([batch.column(k)[first].as_py()] * len(values), batch.schema.field(k).type) for k in keys
                ]
                arrays += [pa.array(np.arange(len(values), dtype=np.int32)), pa.array(values)]
                yield pa.RecordBatch.from_arrays(arrays, [*keys, "i", "value"])

    parts = samples.mapInArrow(add_up, ", ".join([*names, "i int, value double"]))
    totals = parts.groupBy(*keys, "i").agg(F.sum("value").alias("value"))
    ordered = F.sort_array(F.collect_list(F.struct("i", "value")))  # as many as the model has weights
    return totals.groupBy(*keys).agg(F.transform(ordered, lambda e: e["value"]).alias("sums"))


def _stepped(state: DataFrame, sums: DataFrame, epoch: int, config: Descent, keys: tuple[str, ...]) -> DataFrame:
    """Errors of this epoch's weights, the best ones so far, and the weights of the next epoch.

    Steps follow the mean gradient over the largest one (Adam under the maximum norm).
    """

    def end(place: int) -> Column:
        return F.element_at("sums", place)

    val_loss = end(-2) / F.nullif(end(-1), F.lit(0.0))
    better = F.col("val_loss").isNull() | F.col("best_loss").isNull() | (F.col("val_loss") < F.col("best_loss"))
    rate = config.rate / (1 - BETA_MEAN ** (epoch + 1))
    gradient = F.transform(F.slice("sums", F.lit(1), F.size("sums") - 4), lambda g: g / F.col("_n"))
    seen = (
        join_by(state, sums, keys)
        .withColumns({"_n": end(-3), "loss": end(-4) / end(-3), "val_loss": val_loss})
        .withColumns({"_better": better, "_g": gradient})
        .withColumns(
            {
                "best_w": F.when(F.col("_better"), F.col("w")).otherwise(F.col("best_w")),
                "best_loss": F.when(F.col("_better"), F.col("val_loss")).otherwise(F.col("best_loss")),
                "best_epoch": F.when(F.col("_better"), F.lit(epoch)).otherwise(F.col("best_epoch")),
                "m": F.zip_with("m", "_g", lambda m, g: BETA_MEAN * m + (1 - BETA_MEAN) * g),
                "u": F.zip_with("u", "_g", lambda u, g: F.greatest(BETA_MAX * u, F.abs(g))),
            }
        )
    )
    move = F.zip_with("m", "u", lambda m, u: rate * m / (u + EPSILON))
    running = (F.lit(epoch) - F.col("best_epoch") < config.patience) & F.lit(epoch < config.epochs)
    return seen.select(
        *keys,
        F.zip_with("w", move, lambda w, d: w - d).alias("w"),
        *("m", "u", "best_w", "best_loss", "best_epoch", "loss", "val_loss"),
        running.alias("running"),
    )


def fit(
    inputs: DataFrame,
    lags: Lags | int,
    config: Descent | None = None,
    keys: tuple[str, ...] = SITE,
    path: str | None = None,
) -> Descended:
    """Fit one model per site on ``inputs`` (``history``, ``actual``, ``split``).

    Epochs lie in folders of ``path`` (a fresh one of the shared folder), so a lost executor costs a
    re-read of the models and of the samples, which are written once. A site that has stopped reads
    its samples no more. Sites without train samples get no model; without validation samples a model
    takes all epochs and keeps its last weights. All target steps of a site stop together. Samples
    of unequal length and missing speeds fail the fit.
    """
    config = config or Descent()
    lags = Lags(lags) if isinstance(lags, int) else lags
    if len(config.centres) != lags.features:
        raise ValueError(f"{lags.features} channels need as many centres and units")
    spark = inputs.sparkSession
    path = path or fresh_path(spark, "descent")
    used = inputs.filter(F.col("split").isin("train", "validation")).select(
        *keys,
        (F.col("split") == "train").alias("train"),
        F.col("history").cast("array<array<double>>").alias("history"),
        F.col("actual").cast("array<double>").alias("actual"),
    )
    samples = materialize(used, "descent-samples")
    shape = samples.select(F.size("history"), F.size("actual")).head() or (0, lags.per_step)
    steps, ahead = shape[0], shape[1] // lags.per_step
    centre, unit = config.per_lag(lags, steps)
    zeros = F.array_repeat(F.lit(0.0), ahead * (len(centre) + lags.per_step))
    state = samples.filter("train").select(*keys).distinct().select(
        *keys,
        *[zeros.alias(c) for c in ("w", "m", "u", "best_w")],
        F.lit(None).cast("double").alias("best_loss"),
        F.lit(-1).alias("best_epoch"),
    )
    state = materialize(state, "descent-start")
    epoch = 0
    while True:
        sums = _sums(join_by(samples, state.select(*keys, "w"), keys), lags, steps, config, keys)
        looked = materialize(_stepped(state, sums, epoch, config, keys), "", f"{path}/epoch={epoch}")
        state = looked.filter("running").drop("loss", "val_loss", "running")
        if state.isEmpty():
            break
        epoch += 1
    every = spark.read.schema(f"{looked._jdf.schema().toDDL()}, epoch int").parquet(path)
    every = every.filter(F.col("epoch") <= epoch)  # a used folder may hold more
    log = every.select(*keys, "epoch", "loss", "val_loss", "best_epoch", "running")
    return Descended(_weights(every.filter(~F.col("running")), centre, unit, ahead, lags, keys), log, lags)


def _weights(
    ended: DataFrame, centre: np.ndarray, unit: np.ndarray, ahead: int, lags: Lags, keys: tuple[str, ...]
) -> DataFrame:
    """The best weights of each model in speeds instead of units: one row per target step."""
    width = len(centre) + lags.per_step
    first_centre, first_unit = (float(v[0]) if len(v) else 0.0 for v in (centre, unit))
    ratios, centres = (F.lit([float(v) for v in values]).cast("array<double>") for values in (first_unit / unit, centre))

    def at(step: Column, start: int, length: int) -> Column:
        return F.slice("best_w", step * F.lit(width) + F.lit(start + 1), F.lit(length))

    steps = ended.select(*keys, "best_w", F.explode(F.sequence(F.lit(0), F.lit(ahead - 1))).alias("step"))
    per_lag = F.zip_with(at(F.col("step"), 0, len(centre)), ratios, lambda w, r: w * r)
    taken = F.zip_with("per_lag", centres, lambda w, c: w * c)
    shift = F.aggregate(taken, F.lit(0.0), lambda a, b: a + b)
    offsets = at(F.col("step"), len(centre), lags.per_step)
    return (
        steps.withColumn("per_lag", per_lag)
        .withColumn("_shift", F.lit(first_centre) - shift)
        .withColumn("per_cell", F.transform(offsets, lambda b: b * F.lit(first_unit) + F.col("_shift")))
        .select(*keys, "step", F.lit(0.0).alias("reg_param"), "per_lag", "per_cell")
    )
