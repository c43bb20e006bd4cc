"""Speed regression on the lags of the history: one ridge per site and target step.

For each site, target step and shrinkage the model has a weight per lag and an offset per cell:
``y = offset[cell] + sum(weight[j] * lag[j])``. Only the weights are shrunk. Every solution follows
from sums over the train rows, which one pass adds up per batch before the shuffle; their size
depends on the model and not on the data.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from laneflow.operators import forecast
from laneflow.operators.joins import join_by

REG_PARAMS = (0.0, 0.01, 0.1)
MODEL = ("location", "step")
SUMS = "i int, j int, cell int, value double"
WEIGHTS = (
    "location string, step int, reg_param double, per_lag array<double>, per_cell array<double>, "
    "features int, sections int"
)
WEIGHTS_BY_SITE = "location string, step int, per_lag array<double>, per_cell array<double>"
#: Name of the folders of a model's versions.
VERSION = "version"


@dataclass(frozen=True)
class Lags:
    """What a cell's forecast looks at in each step of the history.

    ``features`` channels of ``per_step`` cells stand one after another in a step. With ``sections``
    the cells before and behind in the same lane count as well; at an end of the road the cell stands
    for its missing neighbour.
    """

    per_step: int
    features: int = 1
    sections: int | None = None

    def cells_of(self, cell: Column) -> list[Column]:
        if self.sections is None:
            return [cell]
        section = F.pmod(cell, F.lit(self.sections))
        before = F.when(section > 0, cell - 1).otherwise(cell)
        behind = F.when(section < self.sections - 1, cell + 1).otherwise(cell)
        return [cell, before, behind]

    def column(self, history: Column, cell: Column) -> Column:
        """The lags of one cell as a flat array: by step, channel, then own cell and neighbours."""
        at = [c + F.lit(f * self.per_step) for f in range(self.features) for c in self.cells_of(cell)]
        return F.flatten(
            F.transform(history, lambda step: F.array(*[F.get(step, c).cast("double") for c in at]))
        )

    def stacked(self, batch: np.ndarray) -> np.ndarray:
        """The same for all cells of a batch (rows, steps, channels x cells): (rows, lags, cells)."""
        rows, steps, _ = batch.shape
        cell = np.arange(self.per_step)
        places = [cell]
        if self.sections is not None:
            section = cell % self.sections
            places += [cell - (section > 0), cell + (section < self.sections - 1)]
        channels = batch.reshape(rows, steps, self.features, self.per_step)
        return np.stack([channels[..., p] for p in places], axis=3).reshape(rows, -1, self.per_step)


def lag_rows(inputs: DataFrame, lags: Lags | int) -> DataFrame:
    """One row per sample, target step and cell: what the cell's history shows, and its true value.

    Columns of ``inputs`` other than ``history`` and ``actual`` are kept.
    """
    lags = Lags(lags) if isinstance(lags, int) else lags
    positions = F.sequence(F.lit(0), F.size("actual") - 1)

    def row(pos: Column) -> Column:
        cell = F.pmod(pos, F.lit(lags.per_step)).cast("int")
        step = F.floor(pos / F.lit(lags.per_step)).cast("int")
        seen = lags.column(F.col("history"), cell)
        actual = F.get("actual", pos).cast("double")
        return F.struct(step.alias("step"), cell.alias("cell"), seen.alias("lags"), actual.alias("actual"))

    kept = [c for c in inputs.columns if c not in ("history", "actual")]
    exploded = inputs.select(*kept, F.explode(F.transform(positions, row)).alias("_row"))
    return exploded.select(*kept, "_row.*")


def _moments(rows: DataFrame, keys: tuple[str, ...]) -> DataFrame:
    """Sums of products of all pairs of (lags, y), and per cell of each of them with 1.

    ``cell`` is -1 for the products; per cell ``i`` is the column and ``j`` -1, and ``i = j = -1``
    counts. Each Arrow batch is summed up by matrix products before anything is shuffled.
    """
    names = [f.simpleString().replace(":", " ", 1) for f in rows.select(*keys).schema.fields]

    def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lags = batch.column("lags")
            x = lags.flatten().to_numpy(zero_copy_only=False).reshape(batch.num_rows, -1)
            x = np.column_stack([x, batch.column("actual").to_numpy(zero_copy_only=False)])
            cell = batch.column("cell").to_numpy(zero_copy_only=False)
            frame = pd.DataFrame({k: batch.column(k).to_pylist() for k in keys})
            for key, at in frame.groupby(list(keys), dropna=False, sort=False).indices.items():
                own, cells = x[at], cell[at]
                width = own.shape[1]
                product = own.T @ own
                found, place = np.unique(cells, return_inverse=True)
                sums = np.zeros((len(found), width + 1))
                np.add.at(sums, place, np.column_stack([own, np.ones(len(own))]))
                i, j = np.divmod(np.arange(width * width), width)
                per_cell = np.tile([*range(width), -1], len(found))
                columns = {
                    "i": np.concatenate([i, per_cell]),
                    "j": np.concatenate([j, np.full(len(per_cell), -1)]),
                    "cell": np.concatenate([np.full(len(i), -1), np.repeat(found, width + 1)]),
                    "value": np.concatenate([product.ravel(), sums.ravel()]),
                }
                n = len(columns["i"])
                key = key if isinstance(key, tuple) else (key,)
                arrays = [pa.array([k] * n, batch.schema.field(c).type) for c, k in zip(keys, key, strict=True)]
                arrays += [pa.array(columns[c], pa.int32()) for c in ("i", "j", "cell")]
                yield pa.RecordBatch.from_arrays([*arrays, pa.array(columns["value"])], [*keys, *columns])

    moments = rows.select(*keys, "lags", "cell", "actual").mapInArrow(add_up, ", ".join([*names, SUMS]))
    return moments.groupBy(*keys, "i", "j", "cell").agg(F.sum("value").alias("value"))


def solve(sums: pd.DataFrame, per_step: int, reg_params: Iterable[float]) -> pd.DataFrame:
    """Weights for each shrinkage from the sums of one site and step; cells without rows have none."""
    product = sums[sums.cell == -1]
    width = int(product.i.max()) + 1
    gram = np.zeros((width, width))
    gram[product.i, product.j] = product.value
    per_cell = sums[sums.cell != -1]
    totals = np.zeros((per_step, width + 1))
    totals[per_cell.cell, per_cell.i] = per_cell.value  # i = -1, the count, is the last column
    count = totals[:, -1]
    mean = totals[:, :-1] / np.maximum(count, 1)[:, None]
    within = gram - (mean * count[:, None]).T @ mean
    rows = []
    for reg_param in reg_params:
        left = within[:-1, :-1] + reg_param * count.sum() * np.eye(width - 1)
        weights = np.linalg.lstsq(left, within[:-1, -1], rcond=None)[0]
        offsets = np.where(count > 0, mean[:, -1] - mean[:, :-1] @ weights, np.nan)
        rows.append((reg_param, weights.tolist(), offsets.tolist()))
    return pd.DataFrame(rows, columns=["reg_param", "per_lag", "per_cell"])


def fitted(
    rows: DataFrame, per_step: int, reg_params: Iterable[float] = REG_PARAMS, keys: tuple[str, ...] = MODEL
) -> DataFrame:
    """Weights of every model and shrinkage: ``keys``, ``reg_param``, ``per_lag``, ``per_cell``."""
    reg_params = tuple(reg_params)
    names = [f.simpleString().replace(":", " ", 1) for f in rows.select(*keys).schema.fields]
    moments = _moments(rows.filter(F.col("split") == "train"), keys)

    def run(key: tuple, sums: pd.DataFrame) -> pd.DataFrame:
        out = solve(sums, per_step, reg_params)
        for name, value in zip(keys, key, strict=True):
            out[name] = value
        return out[[*keys, "reg_param", "per_lag", "per_cell"]]

    schema = ", ".join([*names, "reg_param double, per_lag array<double>, per_cell array<double>"])
    return moments.groupBy(*keys).applyInPandas(run, schema)


def predictions(rows: DataFrame, weights: DataFrame, keys: tuple[str, ...] = MODEL) -> DataFrame:
    """``rows`` of :func:`lag_rows` with ``prediction`` by each of their models; column math."""
    products = F.zip_with("lags", "per_lag", lambda lag, weight: lag * weight)
    total = F.aggregate(products, F.lit(0.0), lambda a, b: a + b)
    return (
        join_by(rows, weights, keys)
        .withColumn("prediction", total + F.get("per_cell", F.col("cell")))
        .drop("per_lag", "per_cell")
    )


def chosen(rows: DataFrame, weights: DataFrame, keys: tuple[str, ...] = MODEL) -> DataFrame:
    """Of each model the weights with the least validation error; of equal ones the least shrinkage.

    A model without validation rows keeps its least shrinkage.
    """
    validation = predictions(rows.filter(F.col("split") == "validation"), weights, keys)
    square = (F.col("actual") - F.col("prediction")) ** 2
    loss = validation.groupBy(*keys, "reg_param").agg(F.avg(square).alias("_loss"))
    ranked = join_by(weights, loss, [*keys, "reg_param"], "left")
    order = F.struct(F.coalesce("_loss", F.lit(float("inf"))).alias("loss"), "reg_param")
    best = ranked.groupBy(*keys).agg(F.min(order)["reg_param"].alias("reg_param"))
    return join_by(weights, best, [*keys, "reg_param"])


@dataclass
class LagModel:
    """Fitted weights: one row for each site and target step."""

    weights: DataFrame
    lags: Lags

    def transform(self, rows: DataFrame) -> DataFrame:
        """Add ``prediction`` to rows of :func:`lag_rows`."""
        return predictions(rows, self.weights).drop("reg_param")

    def predictor(self, location: str) -> forecast.PredictorFactory:
        """One site's model for :func:`forecast.predicted`, e.g. on a stream of histories."""
        return site_predictor(self.weights, location, self.lags)

    def save(self, path: str) -> None:
        told = self.weights.select(
            "location",
            "step",
            "reg_param",
            "per_lag",
            "per_cell",
            F.lit(self.lags.features).alias("features"),
            F.lit(self.lags.sections).cast("int").alias("sections"),
        )
        told.coalesce(1).write.mode("overwrite").json(path)


def fit(
    rows: DataFrame, lags: Lags | int, reg_params: Iterable[float] = REG_PARAMS
) -> LagModel:
    """Fit on the train samples, keep per model the shrinkage with the least validation error."""
    lags = Lags(lags) if isinstance(lags, int) else lags
    weights = fitted(rows, lags.per_step, reg_params)
    return LagModel(chosen(rows, weights), lags)


def site_predictor(weights: DataFrame, location: str, lags: Lags) -> forecast.PredictorFactory:
    """Predictor from the weights of one site: one row per target step."""
    rows = weights.filter(F.col("location") == location).orderBy("step").collect()
    if not rows or [r.step for r in rows] != list(range(len(rows))):
        raise ValueError(f"no complete model for {location!r}")
    per_lag = np.array([r.per_lag for r in rows])
    per_cell = np.array([r.per_cell for r in rows])

    def predict(batch: np.ndarray) -> np.ndarray:
        out = np.einsum("nlc,sl->nsc", lags.stacked(batch), per_lag) + per_cell
        return out.reshape(len(batch), -1)

    return lambda: predict


def save_version(weights: DataFrame, root: str, version: int) -> None:
    """Add ``location, step, per_lag, per_cell`` of all sites to a folder of versions.

    One file, so that a reader sees the whole version or none of it.
    """
    told = weights.select("location", "step", "per_lag", "per_cell")
    told.coalesce(1).write.mode("errorifexists").json(f"{root}/{VERSION}={version}")


def newest_weights(spark: SparkSession, root: str) -> DataFrame:
    """Weights of the latest version of a model: one read of the folder as it is now.

    A folder without versions, as :meth:`LagModel.save` writes it, is the only version of itself. Models with
    channels or neighbours fail the query: their forecasts need a predictor.
    """
    found = spark.read.schema(f"{WEIGHTS}, {VERSION} long").json(root)
    latest = found.agg(F.max(VERSION).alias("latest")).head().latest
    mine = found if latest is None else found.filter(F.col(VERSION) == latest)
    plain = F.coalesce("features", F.lit(1)).eqNullSafe(1) & F.col("sections").isNull()
    told = F.raise_error(F.lit("a model with channels or neighbours has no forecast by site"))
    return mine.select("location", F.when(plain, F.col("step")).otherwise(told.cast("int")).alias("step"), "per_lag", "per_cell")


def load_predictor(spark: SparkSession, path: str, location: str) -> forecast.PredictorFactory:
    """Predictor of one site of a model written with :meth:`LagModel.save`."""
    weights = spark.read.schema(WEIGHTS).json(path)
    row = weights.filter(F.col("location") == location).select(F.size("per_cell"), "features", "sections").head()
    if row is None:
        raise ValueError(f"no complete model for {location!r}")
    return site_predictor(weights, location, Lags(*row))
