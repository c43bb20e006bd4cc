import math

import numpy as np
import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laneflow.config import ExperimentConfig, SampleConfig, SiteConfig, WindowConfig
from laneflow.operators import aggregate, forecast, regression, series
from laneflow.plans import training
from laneflow.sources import files

PAIRS = "actual double, prediction double"


def test_error_metrics(spark):
    pairs = [(10.0, 12.0), (20.0, 20.0), (40.0, 30.0)]
    m = forecast.error_metrics(spark.createDataFrame(pairs, PAIRS)).head()
    y, p = np.array(pairs).T
    assert m.mse == pytest.approx(np.mean((y - p) ** 2))
    assert m.rmse == pytest.approx(math.sqrt(m.mse))
    assert m.mae == pytest.approx(4.0)
    assert m.mape == pytest.approx(np.mean(np.abs(y - p) / y))
    assert m.maape == pytest.approx(np.mean(np.arctan(np.abs(y - p) / y)))


def test_metrics_where_the_truth_is_zero(spark):
    m = forecast.error_metrics(spark.createDataFrame([(0.0, 0.0), (0.0, 3.0)], PAIRS)).head()
    assert m.maape == pytest.approx(math.pi / 4)
    assert m.mape == pytest.approx(1.5 / np.finfo(np.float64).eps)


@settings(max_examples=10, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.lists(st.tuples(st.floats(-100, 100), st.floats(-100, 100)), min_size=1, max_size=20))
def test_arctan_error_is_bounded(spark, pairs):
    m = forecast.error_metrics(spark.createDataFrame(pairs, PAIRS)).head()
    assert 0 <= m.maape <= math.pi / 2


def sample_inputs(spark, n=60, cells=4, seed=1):
    """Samples of a series where a cell's next value is a fixed mix of its last two."""
    rng = np.random.default_rng(seed)
    values = [rng.uniform(20, 60, cells), rng.uniform(20, 60, cells)]
    for _ in range(n):
        values.append(0.5 * values[-1] + 0.3 * values[-2] + np.arange(cells) + rng.normal(0, 3, cells))
    rows = []
    for i in range(n - 1):
        history = [v.tolist() for v in values[i : i + 2]]
        rows.append(("a", i, n - 1, history, values[i + 2].tolist()))
    schema = "location string, sample_id long, num_samples long, history array<array<double>>, actual array<double>"
    return series.chrono_split(spark.createDataFrame(rows, schema)), values


def test_baselines(spark):
    df = spark.createDataFrame([([[1, 2], [3, 5]],)], "history array<array<int>>")
    guess = df.select(
        forecast.persistence(F.col("history"), 2).alias("p"),
        forecast.history_mean(F.col("history")).alias("m"),
    ).head()
    assert guess.p == [3.0, 5.0, 3.0, 5.0]
    assert guess.m == [2.0, 3.5]


def test_regression_matches_least_squares_and_its_predictor(spark):
    inputs, values = sample_inputs(spark)
    rows = regression.lag_rows(inputs, 4)
    model = regression.fit(rows, 4, reg_params=(0.0,))
    got = {
        (r.sample_id, int(r.cell)): r.prediction
        for r in model.transform(rows.filter("split = 'test'")).collect()
    }
    train, test = [], []
    for r in inputs.collect():
        if r.split != "validation":
            (train if r.split == "train" else test).append(r)

    def design(sample, cell):
        return [sample.history[0][cell], sample.history[1][cell], *np.eye(4)[cell]]

    x = np.array([design(s, c) for s in train for c in range(4)])
    y = np.array([s.actual[c] for s in train for c in range(4)])
    weights = np.linalg.lstsq(x, y, rcond=None)[0]
    for s in test:
        for c in range(4):
            assert got[s.sample_id, c] == pytest.approx(np.dot(design(s, c), weights), abs=1e-4)

    by_udf = inputs.filter("split = 'test'").select(
        "sample_id", forecast.predicted(F.col("history"), model.predictor("a"), 2).alias("p")
    )
    for r in by_udf.collect():
        assert r.p == pytest.approx([got[r.sample_id, c] for c in range(4)], abs=1e-9)


def test_saved_model_predicts_the_same(spark, tmp_path):
    inputs, _ = sample_inputs(spark)
    model = regression.fit(regression.lag_rows(inputs, 4), 4, reg_params=(0.01,))
    model.save(str(tmp_path / "model"))
    batch = np.array([[[1.0, 2, 3, 4], [5, 6, 7, 8]]])
    loaded = regression.load_predictor(spark, str(tmp_path / "model"), "a")
    assert np.allclose(model.predictor("a")()(batch), loaded()(batch))
    with pytest.raises(ValueError):
        regression.load_predictor(spark, str(tmp_path / "model"), "b")


def test_each_target_step_has_its_own_model(spark):
    inputs, values = sample_inputs(spark)
    ahead = {i: values[i + 3].tolist() for i in range(len(values) - 3)}
    rows = [(*r[:4], r.actual + ahead[r.sample_id], r.split) for r in inputs.collect() if r.sample_id in ahead]
    two = spark.createDataFrame(rows, inputs.schema)
    model = regression.fit(regression.lag_rows(two, 4), 4, reg_params=(0.0,))
    batch = np.array([[[1.0, 2, 3, 4], [5, 6, 7, 8]]])
    out = model.predictor("a")()(batch)
    assert out.shape == (1, 8)
    one = regression.fit(regression.lag_rows(two.withColumn("actual", F.slice("actual", 5, 4)), 4), 4, reg_params=(0.0,))
    assert np.allclose(out[:, 4:], one.predictor("a")()(batch))


def test_neighbours_and_features(spark, tmp_path):
    """What the rows show is what the predictor looks at."""
    lags = regression.Lags(4, features=2, sections=2)
    rng = np.random.default_rng(4)
    rows = [("a", i, 80, rng.uniform(0, 9, (3, 8)).tolist(), rng.uniform(0, 9, 4).tolist()) for i in range(80)]
    schema = "location string, sample_id long, num_samples long, history array<array<double>>, actual array<double>"
    inputs = series.chrono_split(spark.createDataFrame(rows, schema))
    made = regression.lag_rows(inputs, lags)
    one = made.filter("sample_id = 0 and cell = 1").head().lags
    step = rows[0][3][0]
    assert one[:6] == [step[1], step[0], step[1], step[5], step[4], step[5]]
    model = regression.fit(made, lags, reg_params=(0.01,))
    model.save(str(tmp_path / "model"))
    batch = np.array([r[3] for r in rows])
    by_udf = regression.load_predictor(spark, str(tmp_path / "model"), "a")()(batch)
    for r in model.transform(made).collect():
        assert by_udf[r.sample_id, r.cell] == pytest.approx(r.prediction, abs=1e-9)


def test_lengths_that_do_not_fit_fail(spark):
    bad = spark.createDataFrame([("a", 0, [1.0], [1, 50])], "location string, sample_id long, prediction array<double>, actual array<int>")
    none = spark.createDataFrame([("a", 0, None, [1, 50])], bad.schema)
    for df in (bad, none):
        with pytest.raises(Exception, match="differ in length"):
            forecast.forecast_cells(df, 1, 2).collect()
    with pytest.raises(Exception, match="is missing"):
        forecast.error_metrics(spark.createDataFrame([(None, 2.0)], PAIRS)).collect()
    history = spark.createDataFrame([(1, [[[[1], [2]]]])], "id int, history array<array<array<array<int>>>>")

    def too_long():
        return lambda batch: np.zeros((len(batch), 5))

    with pytest.raises(Exception, match="not 2"):
        forecast.forecast_matrix(history, too_long, 1, 1, 2).collect()
    two = forecast.forecast_matrix(history, lambda: lambda b: np.concatenate([b[:, 0], 2 * b[:, 0]], axis=1), 1, 1, 2, predict=2)
    assert [(r.step, r.prediction) for r in two.orderBy("step").collect()] == [(0, [[1, 2]]), (1, [[2, 4]])]


def test_forecast_matrix_gates_short_histories(spark):
    step = [[[1], [2], [3]], [[4], [5], [6]]]
    other = [[[2], [3], [4]], [[5], [6], [7]]]
    rows = [(1, [step, other]), (2, [step])]
    df = spark.createDataFrame(rows, "id int, history array<array<array<array<int>>>>")

    def half_of_the_sum():
        return lambda batch: batch.sum(axis=1) / 2

    out = forecast.forecast_matrix(df, half_of_the_sum, 2, 2, 3)
    got = {r.id: r.prediction for r in out.collect()}
    assert got[1] == [[2, 2, 4], [4, 6, 6]]  # halves go to the even neighbour
    assert got[2] == [[0, 0, 0], [0, 0, 0]]
    dropped = forecast.forecast_matrix(df, half_of_the_sum, 2, 2, 3, unready="drop")
    assert [r.id for r in dropped.collect()] == [1]


def test_alignment_with_later_truth(spark):
    predictions = spark.createDataFrame([("a", 0, [1.0, 2.0, 3.0, 4.0])], "location string, sample_id long, prediction array<double>")
    truth = spark.createDataFrame([("a", 0, [9, 8, 7, 6]), ("a", 1, [0, 0, 0, 0])], "location string, sample_id long, actual array<int>")
    cells = forecast.forecast_cells(forecast.with_truth(predictions, truth), 2, 2)
    got = {(r.step, r.lane_id, r.section_id): (r.prediction, r.actual) for r in cells.collect()}
    assert got == {(0, 1, 0): (1.0, 9.0), (0, 1, 1): (2.0, 8.0), (0, 2, 0): (3.0, 7.0), (0, 2, 1): (4.0, 6.0)}


def test_metrics_log_appends(spark, tmp_path):
    pairs = spark.createDataFrame([(10.0, 12.0)], PAIRS)
    for name in ("m1", "m2"):
        row = forecast.error_metrics(pairs).withColumn("model_name", F.lit(name))
        files.append_metrics(row, str(tmp_path / "log"))
    log = files.read_metrics(spark, str(tmp_path / "log")).collect()
    assert sorted(r.model_name for r in log) == ["m1", "m2"]
    assert all(r.mae == 2.0 for r in log)


def test_experiments_on_dense_frames(spark):
    site = SiteConfig(location="a")
    points = spark.range(20_000).select(
        F.lit("a").alias("location"),
        (F.expr("id div 40") * 100).alias("elapsed_time"),
        ((F.col("id") % 10) * 247.0 + 3).alias("distance"),
        ((F.col("id") % 4) + 1).cast("int").alias("lane_id"),
        (30 + F.expr("id div 40") % 17 + F.col("id") % 5).cast("double").alias("v_vel"),
        F.lit(0.25).alias("v_acc"),
    )
    sections = aggregate.section_agg(points, site)
    experiments = [
        ExperimentConfig(1, SampleConfig(6, 1), True),
        ExperimentConfig(0.5, SampleConfig(12, 2), False),
    ]
    models = ("persistence", "regression")
    window = WindowConfig(1, 0, 50)
    out = training.run_experiments(sections, site, experiments, models, window).collect()
    assert [r.model_name for r in out] == [
        e.model_name(m, site.sections) for e in experiments for m in models
    ]
    assert all(r.rmse >= r.mae >= 0 for r in out)
    with pytest.raises(ValueError):
        training.run_experiments(sections, site, experiments, models, WindowConfig(1, 0, 5))


def test_forecast_by_site(spark):
    """Two sites by their own models; no model, no site, a short history; a model of another shape fails."""
    weights = spark.createDataFrame(
        [("a", 0, [0.0, 1.0], [0.0] * 4), ("a", 1, [1.0, 0.0], [0.0] * 4), ("b", 0, [0.5, 0.5], [1.0] * 4), ("b", 1, [0.0, 0.0], [7.5] * 4)],
        "location string, step int, per_lag array<double>, per_cell array<double>",
    )
    history = [[[[1], [2]], [[3], [4]]], [[[2], [4]], [[6], [9]]]]
    rows = [("a", history), ("b", history), ("b", history[:1]), ("c", history), (None, history)]
    df = spark.createDataFrame(rows, "location string, history array<array<array<array<int>>>>")
    out = forecast.forecast_by_site(df, forecast.site_models(weights), 2, 2, 2, predict=2)
    found = sorted(((r.location, r.step, r.prediction) for r in out.collect()), key=repr)
    zeros = [[0, 0], [0, 0]]
    want = [
        ("a", 0, [[2, 4], [6, 9]]), ("a", 1, [[1, 2], [3, 4]]), ("b", 0, [[2, 4], [6, 8]]), ("b", 1, [[8, 8], [8, 8]]),
        ("b", 0, zeros), ("b", 1, zeros), ("c", None, None), (None, None, None),
    ]
    assert found == sorted(want, key=repr)
    with pytest.raises(Exception, match="target steps"):
        forecast.forecast_by_site(df, forecast.site_models(weights), 2, 2, 2, predict=1).collect()
    with pytest.raises(Exception, match="another grid or history"):
        forecast.forecast_by_site(df.limit(1), forecast.site_models(weights.withColumn("per_lag", F.array(F.lit(1.0)))), 2, 2, 2, 2).collect()


def test_newest_weights(spark, tmp_path):
    rows = lambda w: spark.createDataFrame([("a", 0, [w], [0.0])], regression.WEIGHTS_BY_SITE)
    root = str(tmp_path / "versions")
    for version in (1, 2, 10):
        regression.save_version(rows(float(version)), root, version)
        assert regression.newest_weights(spark, root).head().per_lag == [version]
    with pytest.raises(Exception, match="already exists|ALREADY_EXISTS"):
        regression.save_version(rows(3.0), root, 10)
    regression.LagModel(rows(4.0).withColumn("reg_param", F.lit(0.0)), regression.Lags(1)).save(str(tmp_path / "one"))
    assert regression.newest_weights(spark, str(tmp_path / "one")).head().per_lag == [4.0]
    regression.LagModel(rows(4.0).withColumn("reg_param", F.lit(0.0)), regression.Lags(1, features=3)).save(str(tmp_path / "three"))
    with pytest.raises(Exception, match="channels or neighbours"):
        regression.newest_weights(spark, str(tmp_path / "three")).collect()
