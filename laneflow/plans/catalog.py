"""Registered queries over the driver's tables: name -> (spark, table folder) -> DataFrame."""

from __future__ import annotations

import time
from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from laneflow.config import ExperimentConfig, SampleConfig, WindowConfig
from laneflow.functions import cells, geo, scalar
from laneflow.operators import aggregate, clean, descent, forecast, grid, regression, segments, series
from laneflow.plans import telemetry as tel
from laneflow.plans import training
from laneflow.plans.replay import Replay, publish
from laneflow.session import fresh_path, materialize, state_width
from laneflow.sources import files, increments, topics
from laneflow.streaming import realtime, stages
from laneflow.streaming.late import LateRows
from laneflow.streaming.publish import OrderedPublisher, Slices

Query = Callable[[SparkSession, str], DataFrame]
REGISTRY: dict[str, Query] = {}

SITE = tel.SITE
DAILY = tel.DAILY
SAMPLE = SampleConfig(history=6, skip=1, predict=1)
SAMPLE_SKIP2 = replace(SAMPLE, skip=2)
SAMPLE_PREDICT2 = replace(SAMPLE, predict=2)
# A range of 20 whole days inside the events, for operators that are bounded by it.
BOUNDED = WindowConfig(seconds=tel.DAY_S, start=1_704_412_800, end=1_704_412_800 + 20 * tel.DAY_S)
PACIFIC = "America/Los_Angeles"
NOON = 1_705_320_000_000  # 2024-01-15 12:00 UTC
NOON_SPAN = (NOON, NOON + tel.HOUR_MS)

# The six parameter sets of a sweep, scaled from seconds to the sparse event times.
SWEEP = (
    ExperimentConfig(tel.DAY_S, SAMPLE, True),
    ExperimentConfig(tel.DAY_S, SAMPLE_SKIP2, True),
    ExperimentConfig(tel.DAY_S, SAMPLE, False),
    ExperimentConfig(tel.DAY_S, SAMPLE_SKIP2, False),
    ExperimentConfig(tel.DAY_S / 2, SampleConfig(12, 2), True),
    ExperimentConfig(tel.DAY_S / 2, SampleConfig(12, 2), False),
)

REALTIME = realtime.RealtimeConfig(
    site=SITE, window_ms=tel.DAY_S * 1000, with_ramp=True, speed=DecimalType(8, 2)
)


FILLED = replace(REALTIME, fill=True)


def query(fn: Query) -> Query:
    REGISTRY[fn.__name__] = fn
    return fn


def _doubles(df: DataFrame, *columns: str) -> DataFrame:
    return df.withColumns({c: F.col(c).cast("double") for c in columns})


def _significant(column: str) -> Column:
    """Nine significant digits: what two engines adding doubles in any order agree on."""
    return F.format_string("%.8e", F.col(column)).cast("double")


def _significant_metrics(df: DataFrame) -> DataFrame:
    return df.withColumns({m: _significant(m) for m in ("mse", "mae", "mape", "maape", "rmse")})


def _sections(spark: SparkSession, sf_dir: str, span: tel.Span | None = None) -> DataFrame:
    return aggregate.section_agg(tel.frames(spark, sf_dir, span), SITE)


def _windows(spark: SparkSession, sf_dir: str, span: tel.Span | None = None) -> DataFrame:
    return aggregate.timewindow_agg(_sections(spark, sf_dir, span), DAILY)


def _grids(spark: SparkSession, sf_dir: str, with_ramp: bool = True) -> DataFrame:
    return grid.dense_grid(_windows(spark, sf_dir), SITE, with_ramp)


def _samples(spark: SparkSession, sf_dir: str, config: SampleConfig = SAMPLE) -> DataFrame:
    return training.sample_set(materialize(_grids(spark, sf_dir), "grids"), config)


def _local_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Points with every derived column, on Pacific wall clocks."""
    out = clean.reproject(tel.points(spark, sf_dir), SITE.crs)
    return clean.add_calendar(clean.add_local_time(out, replace(SITE, tz=PACIFIC)))


# --- points -------------------------------------------------------------------------------------


@query
def clean_units(spark, sf_dir):
    df = tel.telemetry(spark, sf_dir).select("event_id", "v_vel", "v_acc")
    return clean.convert_units(_doubles(df, "v_vel", "v_acc"))


@query
def lane_merge(spark, sf_dir):
    df = clean.site_filter(tel.telemetry(spark, sf_dir), SITE)
    return df.select("event_id", "location", "lane_id")


@query
def distance_elapsed(spark, sf_dir):
    df = tel.points(spark, sf_dir).select("event_id", "location", "distance", "elapsed_time")
    rebased = clean.rebase_elapsed(df)
    return rebased.withColumn("distance", F.round("distance", 6))


@query
def local_time(spark, sf_dir):
    df = clean.add_local_time(tel.telemetry(spark, sf_dir), replace(SITE, tz=PACIFIC))
    back = scalar.epoch_of_local(F.col("datetime"), PACIFIC)
    wall = F.date_format("datetime", "yyyy-MM-dd HH:mm:ss.SSS")
    return df.select("event_id", wall.alias("wall_clock"), back.alias("global_time"))


@query
def calendar_parts(spark, sf_dir):
    return _local_points(spark, sf_dir).select("event_id", "day", "month", "hour", "year")


@query
def reproject(spark, sf_dir):
    df = clean.reproject(tel.telemetry(spark, sf_dir), SITE.crs)
    return df.select("event_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


#: Parameters of about the size of those between NAD83 and the ITRF frames.
SHIFT = geo.DatumShift(-0.9956, 1.9013, 0.5215, 0.025915, 0.009426, 0.011599, -0.00062)


@query
def reproject_datum(spark, sf_dir):
    """Planar points to another datum, by seven parameters."""
    df = clean.reproject(tel.telemetry(spark, sf_dir), SITE.crs, SHIFT)
    return df.select("event_id", F.round("lat", 7).alias("lat"), F.round("lon", 7).alias("lon"))


@query
def hour_filter(spark, sf_dir):
    df = clean.hour_filter(_local_points(spark, sf_dir), [7, 8], offset_ms=1000)
    rounded = {c: F.round(c, 6) for c in ("distance", "lat", "lon")}
    return _doubles(df.withColumns(rounded), "v_vel", "v_acc")


@query
def lane_filter(spark, sf_dir):
    df = clean.lane_filter(_local_points(spark, sf_dir), 6, ordered=True)
    return _doubles(df.withColumn("distance", F.round("distance", 6)), "v_vel", "v_acc")


@query
def snapshot(spark, sf_dir):
    df = tel.frames(spark, sf_dir, NOON_SPAN)
    out = clean.snapshot(clean.reproject(df, SITE.crs), NOON)
    rounded = {c: F.round(c, 6) for c in ("distance", "lat", "lon")}
    return _doubles(out.withColumns(rounded), "v_vel", "v_acc")


@query
def elapsed_range(spark, sf_dir):
    window = WindowConfig(seconds=tel.DAY_S, start=1_704_499_200, end=1_705_968_000)
    span = (window.start * 1000, window.end * 1000)
    out = aggregate.add_time_window(tel.points(spark, sf_dir, span), window)
    return out.select("event_id", "elapsed_time", "time_window")


@query
def sql_view(spark, sf_dir):
    tel.points(spark, sf_dir).createOrReplaceTempView("laneflow_points")
    return spark.sql(
        "SELECT location, lane_id, count(*) AS n, max(elapsed_time) AS last_seen "
        "FROM laneflow_points WHERE location = 'click' AND lane_id = 6 GROUP BY ALL"
    )


@query
def csv_roundtrip(spark, sf_dir):
    path = fresh_path(spark, "trajectory-csv")
    df = files.as_trajectory(tel.telemetry(spark, sf_dir))
    files.write_table(df, path, "csv", header="true")
    return files.read_trajectories(spark, path).select(
        F.col("Vehicle_ID").alias("vehicle_id"),
        F.col("Global_Time").alias("global_time"),
        F.col("Local_X").alias("local_x"),
        F.col("Local_Y").alias("local_y"),
        F.col("v_Vel").alias("v_vel"),
        F.col("v_Acc").alias("v_acc"),
        F.col("Lane_ID").alias("lane_id"),
        F.col("Location").alias("location"),
    )


@query
def trajectory_segments(spark, sf_dir):
    out = segments.trajectory_segments(tel.points(spark, sf_dir), bucket_ms=tel.HOUR_MS)
    return _doubles(out.withColumns({d: F.round(d, 6) for d in ("d0", "d1")}), "v_vel")


# --- aggregates ---------------------------------------------------------------------------------


@query
def section_agg(spark, sf_dir):
    return _doubles(_sections(spark, sf_dir), "avg_vel", "avg_acc")


@query
def section_table(spark, sf_dir):
    path = files.section_path(fresh_path(spark, "sections"), SITE, "events")
    return files.section_table(_sections(spark, sf_dir), path, "csv")


@query
def section_increments(spark, sf_dir):
    """The section table absorbed in two batches, late points of the first days in the second, which is run twice."""
    root = fresh_path(spark, "increments")
    points = tel.frames(spark, sf_dir)
    second = (F.col("event_id") % 3 == 0) | (F.col("global_time") >= NOON)
    increments.absorb(points.filter(~second), root, "first", SITE)
    for _ in range(2):
        table = increments.absorb(points.filter(second), root, "second", SITE)
    return table


@query
def timewindow_agg(spark, sf_dir):
    return _doubles(_windows(spark, sf_dir), "avg_vel", "avg_acc")


@query
def timewindow_agg_range(spark, sf_dir):
    window = WindowConfig(seconds=tel.DAY_S / 2, start=1_704_499_245, end=1_705_968_000.5)
    out = aggregate.timewindow_agg(_sections(spark, sf_dir), window)
    return _doubles(out, "avg_vel", "avg_acc")


@query
def window_range(spark, sf_dir):
    day_ms = DAILY.millis
    windows = _windows(spark, sf_dir, (19_727 * day_ms, 19_739 * day_ms))
    out = windows.filter(F.col("time_window").between(19_727, 19_738))
    return _doubles(out, "avg_vel", "avg_acc")


@query
def section_snapshot(spark, sf_dir):
    out = _sections(spark, sf_dir, NOON_SPAN).filter(F.col("elapsed_time") == NOON)
    return _doubles(out, "avg_vel", "avg_acc")


@query
def snapshot_grid(spark, sf_dir):
    """Dense grid of one frame, straight from the section aggregate."""
    keys = ("location", "elapsed_time")
    frame = _sections(spark, sf_dir, NOON_SPAN).filter(F.col("elapsed_time") == NOON)
    return grid.grid_cells(grid.dense_grid(frame, SITE, keys=keys), SITE.sections, keys)


@query
def speed_histogram(spark, sf_dir):
    return _doubles(aggregate.speed_histogram(tel.points(spark, sf_dir), "click", 1), "speed")


@query
def hourly_counts(spark, sf_dir):
    return aggregate.calendar_counts(_local_points(spark, sf_dir))


@query
def extent(spark, sf_dir):
    out = aggregate.extent(tel.points(spark, sf_dir))
    return out.withColumn("max_dist", F.round("max_dist", 6))


@query
def first_last_row(spark, sf_dir):
    """Ends of each site by hourly frame: many points share one."""
    rows = tel.frames(spark, sf_dir).select("location", "elapsed_time", "lane_id", "vehicle_id", "event_id")
    return aggregate.first_last(rows, "elapsed_time")


@query
def scale_stats(spark, sf_dir):
    bounds = ("min_vel", "max_vel", "min_acc", "max_acc")
    return _doubles(aggregate.scale_stats(_windows(spark, sf_dir)), *bounds)


@query
def min_max_scaled(spark, sf_dir):
    windows = materialize(_windows(spark, sf_dir), "windows")
    stats = materialize(aggregate.scale_stats(windows), "scale-stats")
    out = aggregate.min_max_scaled(windows, stats)
    return out.withColumns({c: F.round(c, 6) for c in ("avg_vel", "avg_acc", "n")})


# --- grids and samples --------------------------------------------------------------------------


@query
def dense_grid_long(spark, sf_dir):
    return grid.grid_cells(_grids(spark, sf_dir), SITE.sections)


@query
def dense_grid_no_ramp(spark, sf_dir):
    return grid.grid_cells(_grids(spark, sf_dir, with_ramp=False), SITE.sections)


@query
def dense_grid_array(spark, sf_dir):
    matrix = cells.channels_last(F.col("matrix"))
    values = F.transform(F.flatten(F.flatten(matrix)), lambda v: F.round(v * 100).cast("bigint"))
    text = F.array_join(F.transform(values, lambda v: v.cast("string")), ",")
    return _grids(spark, sf_dir).select(*grid.WINDOW, text.alias("hundredths"))


@query
def flat_cells(spark, sf_dir):
    flat = grid.channel_cells(_grids(spark, sf_dir))

    def text(name: str, factor: int) -> Column:
        number = F.transform(name, lambda v: F.round(v * factor).cast("bigint").cast("string"))
        return F.array_join(number, ",").alias(name)

    return flat.select(*grid.WINDOW, text("vel", 1), text("dens", 1), text("acc", 100))


@query
def series_rank(spark, sf_dir):
    grids = materialize(_grids(spark, sf_dir), "grids")
    return series.series_index(grids, block=8).select(*grid.WINDOW, "idx", "series_len")


def _long_samples(spark, sf_dir, config):
    steps = series.sample_steps(_samples(spark, sf_dir, config))
    keys = ("location", "sample_id", "role", "step", "time_window")
    return grid.grid_cells(steps, SITE.sections, keys)


@query
def samples_long(spark, sf_dir):
    return _long_samples(spark, sf_dir, SAMPLE)


@query
def samples_skip2(spark, sf_dir):
    return _long_samples(spark, sf_dir, SAMPLE_SKIP2)


@query
def samples_predict2(spark, sf_dir):
    """Samples with two target windows."""
    return _long_samples(spark, sf_dir, SAMPLE_PREDICT2)


@query
def series_gap_fill(spark, sf_dir):
    """The series with a grid of defaults for every window that a site has no data for."""
    windows = _windows(spark, sf_dir).filter(F.col("time_window") % 7 < 5)
    grids = materialize(grid.dense_grid(windows, SITE), "grids")
    filled = series.gap_filled(grids, grid.empty_matrix(SITE))
    ranked = series.series_index(materialize(filled, "filled"), block=8)
    return grid.grid_cells(ranked, SITE.sections, (*grid.WINDOW, "idx", "series_len"))


def _split_rows(samples):
    return samples.select(
        "location",
        "sample_id",
        "num_samples",
        F.col("history")[0]["time_window"].alias("history_start"),
        F.col("target")[0]["time_window"].alias("target_window"),
        "split",
    )


@query
def chrono_split(spark, sf_dir):
    return _split_rows(_samples(spark, sf_dir))


@query
def chrono_split_bounded(spark, sf_dir):
    """The split of a bounded range: its number of windows limits the samples."""
    grids = training.window_grids(_sections(spark, sf_dir), SITE, BOUNDED)
    bounded = replace(BOUNDED, end=BOUNDED.end - 5 * tel.DAY_S)
    samples = training.sample_set(materialize(grids, "grids"), SAMPLE, bounded.num_windows)
    return _split_rows(samples)


@query
def realtime_split(spark, sf_dir):
    labelled = series.chrono_split(_samples(spark, sf_dir), realtime=True)
    return labelled.select("location", "sample_id", "split")


# --- forecasts ----------------------------------------------------------------------------------


def _inputs(spark, sf_dir, config=SAMPLE):
    return training.sample_inputs(materialize(_grids(spark, sf_dir), "grids"), config)


def _baseline_cells(spark, sf_dir, *models):
    return training.baseline_cells(_inputs(spark, sf_dir), models, SITE.lanes(), SITE.sections)


@query
def forecast_persistence(spark, sf_dir):
    return _baseline_cells(spark, sf_dir, "persistence").drop("model")


@query
def forecast_history_mean(spark, sf_dir):
    out = _baseline_cells(spark, sf_dir, "history_mean").drop("model")
    return out.withColumn("prediction", F.round("prediction", 6))


@query
def forecast_udf(spark, sf_dir):
    """The persistence forecast made by a loaded predictor instead of column math."""
    test = _inputs(spark, sf_dir).filter(F.col("split") == "test")
    per_step = SITE.lanes() * SITE.sections
    guess = forecast.predicted(F.col("history"), last_window_predictor, SAMPLE.history, per_step)
    scored = test.select("location", "sample_id", guess.alias("prediction"), "actual")
    return forecast.forecast_cells(scored, SITE.lanes(), SITE.sections)


@query
def forecast_with_truth(spark, sf_dir):
    """Written forecasts joined to the truth that became known after them."""
    inputs = materialize(_inputs(spark, sf_dir).filter(F.col("split") == "test"), "inputs")
    guess = forecast.persistence(F.col("history"))
    made = materialize(inputs.select("location", "sample_id", guess.alias("prediction")), "forecasts")
    return forecast.forecast_cells(forecast.with_truth(made, inputs), SITE.lanes(), SITE.sections)


def last_window_predictor() -> forecast.Predictor:
    """A predictor without weights: the last window of the history."""
    return lambda batch: batch[:, -1, :]


def mean_of_two_predictor() -> forecast.Predictor:
    """Halves of whole numbers, so that rounding has ties."""
    return lambda batch: batch[:, -2:, :].mean(axis=1)


@query
def forecast_metrics_predict2(spark, sf_dir):
    """Baselines over two target windows."""
    scored = training.baseline_cells(
        _inputs(spark, sf_dir, SAMPLE_PREDICT2), forecast.BASELINES, SITE.lanes(), SITE.sections, 2
    )
    metrics = forecast.error_metrics(scored, ("location", "model", "step"))
    return _significant_metrics(metrics.withColumnRenamed("model", "model_name"))


@query
def forecast_metrics(spark, sf_dir):
    scored = _baseline_cells(spark, sf_dir, *forecast.BASELINES)
    metrics = forecast.error_metrics(scored, ("location", "model"))
    return _significant_metrics(metrics.withColumnRenamed("model", "model_name"))


@query
def experiment_sweep(spark, sf_dir):
    sections = materialize(_sections(spark, sf_dir), "sections")
    return _significant_metrics(
        training.run_experiments(sections, SITE, SWEEP, models=forecast.BASELINES)
    )


@query
def metrics_log(spark, sf_dir):
    """Two appends to one log, read back."""
    path = fresh_path(spark, "metrics-log")
    inputs = materialize(_inputs(spark, sf_dir), "inputs")
    for model in forecast.BASELINES:
        scored = training.baseline_cells(inputs, [model], SITE.lanes(), SITE.sections)
        row = forecast.error_metrics(scored, ("model",)).withColumnRenamed("model", "model_name")
        files.append_metrics(row, path)
    log = files.read_metrics(spark, path)
    return log.withColumns({m: _significant(m) for m in ("mae", "mape", "maape", "rmse")})


@query
def forecast_regression(spark, sf_dir):
    """The regression with its choice of shrinkage under all parameter sets."""
    sections = materialize(_sections(spark, sf_dir), "sections")
    return _significant_metrics(training.run_experiments(sections, SITE, SWEEP))


@query
def forecast_regression_lag1(spark, sf_dir):
    """Least squares on one lag and the cell's offset for each site, test samples only."""
    return _least_squares(spark, sf_dir, SampleConfig(history=1, skip=1, predict=1))


@query
def forecast_regression_lags(spark, sf_dir):
    """Least squares on all six lags and the cell's offset for each site, test samples only."""
    return _least_squares(spark, sf_dir, SAMPLE)


def _least_squares(spark, sf_dir, config, *more):
    lags = regression.Lags(SITE.lanes() * SITE.sections)
    return _test_predictions(_inputs(spark, sf_dir, config), lags, *more)


def _test_predictions(inputs, lags, *more):
    rows = materialize(regression.lag_rows(inputs, lags), "lag-rows")
    model = regression.fit(rows, lags, reg_params=(0.0,))
    return _predicted_cells(model.transform(rows.filter(F.col("split") == "test")), *more)


def _predicted_cells(scored, *more):
    cell = F.col("cell")
    return scored.select(
        "location",
        "sample_id",
        *more,
        cells.lane_of(cell, SITE.sections).alias("lane_id"),
        cells.section_of(cell, SITE.sections).alias("section_id"),
        F.round("prediction", 5).alias("prediction"),
        "actual",
    )


@query
def forecast_regression_features(spark, sf_dir):
    """Least squares on the last speed, density and acceleration of each cell."""
    config = SampleConfig(history=1, skip=1, predict=1)
    grids = materialize(_grids(spark, sf_dir), "grids")
    inputs = training.sample_inputs(grids, config, features=("vel", "dens", "acc"))
    lags = regression.Lags(SITE.lanes() * SITE.sections, features=3)
    return _test_predictions(inputs, lags)


@query
def forecast_regression_predict2(spark, sf_dir):
    """Least squares with a model of its own for each of two target windows."""
    return _least_squares(spark, sf_dir, SampleConfig(history=1, skip=1, predict=2), "step")


DESCENT = descent.Descent(rate=0.05, epochs=10, patience=2)


def _descended(spark, sf_dir):
    inputs = materialize(_inputs(spark, sf_dir), "inputs")
    return inputs, descent.fit(inputs, SITE.lanes() * SITE.sections, DESCENT)


@query
def descent_epochs(spark, sf_dir):
    """Errors of each epoch of the iterative fit, until each site stops."""
    log = _descended(spark, sf_dir)[1].log
    return log.withColumns({c: F.round(c, 6) for c in ("loss", "val_loss")})


@query
def descent_forecast(spark, sf_dir):
    """Test samples by the best weights of the iterative fit."""
    inputs, fitted = _descended(spark, sf_dir)
    rows = regression.lag_rows(inputs.filter(F.col("split") == "test"), fitted.lags)
    return _predicted_cells(fitted.model.transform(rows))


# --- messages and streams -----------------------------------------------------------------------


def _messages(spark, sf_dir) -> DataFrame:
    return topics.frames_to_messages(tel.frames(spark, sf_dir))


def _bounds(df: DataFrame) -> tuple[int, int]:
    """First and last frame time: one row from one aggregate."""
    row = df.agg(F.min("global_time"), F.max("global_time")).head()
    return row[0], row[1]


@query
def frames_roundtrip(spark, sf_dir):
    """Encode every frame, silent ones too, and unfold the messages again."""
    points = tel.frames(spark, sf_dir)
    first, last = _bounds(points)
    clock = topics.frame_clock(spark, first, last, tel.HOUR_MS)
    messages = topics.frames_to_messages(points, clock)
    path = fresh_path(spark, "frames-topic")
    files.write_table(messages.select("key", "value"), path)
    decoded = topics.parse_frames(spark.read.parquet(path), DecimalType(8, 2))
    return _doubles(
        decoded.select(
            "global_time", "vehicle_id", "local_x", "local_y", "v_vel", "v_acc", "lane_id",
            "location",
        ),
        "v_vel",
        "v_acc",
    )


@query
def frame_messages(spark, sf_dir):
    """Points per frame message, zero for the frames sent as an empty array."""
    points = tel.frames(spark, sf_dir)
    first, last = _bounds(points)
    clock = topics.frame_clock(spark, first, last, tel.HOUR_MS)
    messages = topics.frames_to_messages(points, clock)
    return messages.groupBy("global_time").agg(
        F.sum(F.json_array_length("value")).cast("bigint").alias("points")
    )


def _ms(column: str) -> Column:
    return F.unix_millis(F.col(column))


@query
def stream_section_agg(spark, sf_dir):
    replay = Replay(spark, "sections", lambda m: realtime.section_stream(m, REALTIME))
    out = replay.run(_messages(spark, sf_dir)).result()
    out = out.select("location", _ms("datetime").alias("frame"), "section_id", "lane_id", "avg_vel")
    return _doubles(out, "avg_vel")


def _window_rows(out: DataFrame) -> DataFrame:
    start = _ms("timewindow.start").alias("window_start")
    return _doubles(out.select("location", start, "section_id", "lane_id", "avg_vel"), "avg_vel")


@query
def stream_timewindow(spark, sf_dir):
    replay = Replay(spark, "windows", lambda m: realtime.window_stream(m, REALTIME))
    return _window_rows(replay.run(_messages(spark, sf_dir)).result())


@query
def stream_dedup(spark, sf_dir):
    """Every message delivered twice; each point comes out once."""

    def build(messages):
        points = topics.parse_frames(messages, DecimalType(8, 2))
        points = stages.add_event_time(points, SITE, REALTIME.delay)
        return stages.dedup_points(points)

    messages = topics.frames_to_messages(tel.points(spark, sf_dir))
    out = Replay(spark, "dedup", build).run(messages.unionAll(messages)).result()
    return _doubles(out.select("location", "vehicle_id", "global_time", "v_vel"), "v_vel")


@query
def stream_late_data(spark, sf_dir):
    """The later half of the frames arrives first: the earlier half is late and dropped."""
    points = tel.frames(spark, sf_dir)
    first, last = _bounds(points)
    middle = (first + last) // 2
    late = F.col("global_time") < middle
    replay = Replay(spark, "late", lambda m: realtime.window_stream(m, REALTIME))
    replay.run(topics.frames_to_messages(points.filter(~late)))
    replay.run(topics.frames_to_messages(points.filter(late)))
    return _window_rows(replay.result())


@query
def stream_late_count(spark, sf_dir):
    """Messages of windows that came late, over the life of a job that is restarted for every ten days."""
    windows = _windows(spark, sf_dir).select("location", "time_window").distinct()
    start = F.timestamp_seconds(F.col("time_window") * F.lit(tel.DAY_S))
    window = F.struct(start.alias("start"), F.timestamp_seconds((F.col("time_window") + 1) * F.lit(tel.DAY_S)).alias("end"))
    matrix = F.array(F.array(F.array(F.lit(0))))
    arrived = materialize(windows.withColumns({"timewindow": window, "matrix": matrix}), "windows")
    first, last = arrived.agg(F.min("time_window"), F.max("time_window")).head()

    def build(messages):
        return stages.received_matrices(topics.parse_matrices(messages), REALTIME.length)

    replay = Replay(spark, "late-count", build)
    listener = LateRows(spark, fresh_path(spark, "late-rows"))
    with listener:
        for newest in range(last, first - 1, -10):  # the newest days come first
            days = F.col("time_window").between(newest - 9, newest)
            replay.run(topics.encode_matrices(arrived.filter(days)))
            listener.settled(replay.query)
    return listener.dropped().select("dropped")


def _matrix_cells(df: DataFrame, keys: tuple[str, ...], column: str = "matrix") -> DataFrame:
    pos = F.col("pos")
    flat = F.flatten(F.flatten(column))
    return df.select(*keys, F.posexplode(flat).alias("pos", "vel")).select(
        *keys,
        cells.lane_of(pos, SITE.sections).alias("lane_id"),
        cells.section_of(pos, SITE.sections).alias("section_id"),
        "vel",
    )


@query
def stream_matrix(spark, sf_dir):
    replay = Replay(spark, "matrices", lambda m: realtime.matrix_stream(m, REALTIME))
    out = replay.run(_messages(spark, sf_dir)).result()
    out = out.withColumn("window_start", _ms("timewindow.start"))
    return _matrix_cells(out, ("location", "window_start"))


def _history_cells(out: DataFrame) -> DataFrame:
    start = _ms("based_timewindow.start").alias("based_start")
    steps = out.select(
        "location", start, F.posexplode(F.arrays_zip("timewindows", "history")).alias("step", "s")
    )
    keys = ("location", "based_start", "step", "window_start")
    steps = steps.select(
        "location",
        "based_start",
        "step",
        F.unix_millis("s.timewindows.start").alias("window_start"),
        F.col("s.history").alias("matrix"),
    )
    return _matrix_cells(steps, keys)


@query
def stream_history(spark, sf_dir):
    replay = Replay(spark, "histories", lambda m: realtime.history_stream(m, REALTIME))
    return _history_cells(replay.run(_messages(spark, sf_dir)).result())


@query
def stream_forecast(spark, sf_dir):
    def build(messages):
        history = realtime.history_stream(messages, REALTIME)
        return realtime.forecast_stream(history, REALTIME, last_window_predictor)

    out = Replay(spark, "forecasts", build).run(_messages(spark, sf_dir)).result()
    flat = out.withColumn("prediction", F.array("prediction"))
    cells_out = _matrix_cells(flat, ("location", "global_time", "target_start"), "prediction")
    return cells_out.withColumnRenamed("vel", "prediction")


@query
def stream_json_forecast(spark, sf_dir):
    """The second job on its own: window messages in, a processing-time trigger, JSON files out."""
    points = tel.frames(spark, sf_dir)
    producer = Replay(
        spark, "producer", lambda m: topics.encode_matrices(realtime.matrix_stream(m, REALTIME))
    )
    producer.run(topics.frames_to_messages(points))
    path, checkpoint = fresh_path(spark, "forecast-json"), fresh_path(spark, "forecast-checkpoint")
    with state_width(spark, spark.sparkContext.defaultParallelism):
        job = realtime.start_second_job(
            topics.read_stream(spark, "parquet", producer.sink), REALTIME, mean_of_two_predictor,
            path, checkpoint, {"processingTime": "1 second"},
        )
    job.processAllAvailable()
    job.stop()
    schema = (
        "location string, global_time long, target_start long, step int, prediction array<array<int>>"
    )
    out = spark.read.schema(schema).json(path).withColumn("prediction", F.array("prediction"))
    cells_out = _matrix_cells(out, ("location", "global_time", "target_start", "step"), "prediction")
    return cells_out.withColumnRenamed("vel", "prediction")


def _weights(spark, sites: dict[str, tuple[list[float], float]]) -> DataFrame:
    """One target step: the same weight of each lag and the same offset for all cells of a site."""
    per_step = SITE.lanes() * SITE.sections
    rows = [(site, 0, lags, [offset] * per_step) for site, (lags, offset) in sites.items()]
    return spark.createDataFrame(rows, regression.WEIGHTS_BY_SITE)


LAST, HALVES = [0.0] * 5 + [1.0], [0.0] * 4 + [0.5, 0.5]


def _site_cells(out: DataFrame) -> DataFrame:
    flat = out.withColumn("prediction", F.array("prediction"))
    cells_out = _matrix_cells(flat, ("location", "global_time", "target_start", "step"), "prediction")
    return cells_out.withColumnRenamed("vel", "prediction")


def _site_job(spark, topic: str, model: str, path: str):
    """The site job over frame messages, both stages in one query."""
    with state_width(spark, spark.sparkContext.defaultParallelism):
        return realtime.start_site_job(
            topics.read_stream(spark, "parquet", topic), REALTIME, model, path, fresh_path(spark, "site-checkpoint"),
            {"processingTime": "1 second"}, realtime.history_stream,
        )


def _site_run(spark, sf_dir) -> str:
    topic, model, path = (fresh_path(spark, f"site-{x}") for x in ("topic", "model", "out"))
    regression.save_version(_weights(spark, {"click": (LAST, 0.0), "view": (HALVES, 3.0)}), model, 1)
    publish(_messages(spark, sf_dir), topic)
    job = _site_job(spark, topic, model, path)
    job.processAllAvailable()
    job.stop()
    return path


@query
def stream_site_forecast(spark, sf_dir):
    """Every site of a topic by its own model; sites without one have no forecast."""
    return _site_cells(realtime.read_forecasts(spark, _site_run(spark, sf_dir)))


@query
def stream_unmodelled(spark, sf_dir):
    """Histories of the sites that have no model, counted over the job's batches."""
    return realtime.read_unmodelled(spark, _site_run(spark, sf_dir))


@query
def stream_model_refresh(spark, sf_dir):
    """A version of the weights that is saved while the job runs: later batches use it."""
    topic, model, path = (fresh_path(spark, f"refresh-{x}") for x in ("topic", "model", "out"))
    points = tel.frames(spark, sf_dir)
    first, last = _bounds(points)
    early = F.col("global_time") < (first + last) // 2
    regression.save_version(_weights(spark, {"click": (LAST, 0.0), "view": (LAST, 1.0)}), model, 1)
    publish(topics.frames_to_messages(points.filter(early)), topic)
    job = _site_job(spark, topic, model, path)
    job.processAllAvailable()
    regression.save_version(_weights(spark, {"click": (LAST, 5.0), "view": (HALVES, 0.0)}), model, 2)
    publish(topics.frames_to_messages(points.filter(~early)), topic)
    job.processAllAvailable()
    job.stop()
    return _site_cells(realtime.read_forecasts(spark, path))


@query
def stream_two_stage(spark, sf_dir):
    """Two checkpointed jobs joined by a topic, each stopped and restarted half-way."""
    points = tel.frames(spark, sf_dir)
    first, last = _bounds(points)
    early = F.col("global_time") < (first + last) // 2

    def first_job(messages):
        return topics.encode_matrices(realtime.matrix_stream(messages, REALTIME))

    producer = Replay(spark, "producer", first_job)
    consumer = Replay(
        spark, "consumer", lambda m: realtime.history_from_topic(m, REALTIME), producer.sink
    )
    for half in (early, ~early):
        producer.run(topics.frames_to_messages(points.filter(half)))
        consumer.run()
    return _history_cells(consumer.result())


def _with_silence(spark, sf_dir) -> DataFrame:
    """Frames of sites that are silent two days a week, each on days of its own."""
    day = F.floor(F.col("global_time") / F.lit(tel.DAY_S * 1000))
    return tel.frames(spark, sf_dir).filter((day + F.length("location")) % 7 < 5)


def _filled(spark, sf_dir, build) -> Replay:
    replay = Replay(spark, "filled", lambda m: build(realtime.matrix_stream(m, FILLED)), timers=True)
    return replay.run(topics.frames_to_messages(_with_silence(spark, sf_dir)))


@query
def stream_gap_fill(spark, sf_dir):
    """Windows that a site is silent in come out as defaults, from its first one up to the watermark."""
    out = _filled(spark, sf_dir, lambda matrices: matrices).result()
    return _matrix_cells(out.withColumn("window_start", _ms("timewindow.start")), ("location", "window_start"))


@query
def stream_gap_history(spark, sf_dir):
    """Histories over silent windows: the filled windows of the first job, read from its topic."""
    producer = _filled(spark, sf_dir, topics.encode_matrices)
    consumer = Replay(spark, "consumer", lambda m: realtime.history_from_topic(m, FILLED), producer.sink)
    return _history_cells(consumer.run().result())


@query
def stream_ordered_publish(spark, sf_dir):
    """Windows of frames that one query has published day after day, stopped and started again on its way.

    The consumer reads the topic in order of arrival, a few files at a time, and would drop late frames.
    """
    by_time = _messages(spark, sf_dir).repartitionByRange("global_time").sortWithinPartitions("global_time")
    messages = materialize(by_time, "messages")
    first, last = _bounds(messages)
    topic, checkpoint = fresh_path(spark, "ordered-topic"), fresh_path(spark, "ordered-checkpoint")
    slices = Slices(first, last, tel.DAY_S * 1000)
    publisher = OrderedPublisher(messages, slices, "parquet", checkpoint, topic)
    job = publisher.start({"processingTime": "200 milliseconds"})
    while job.isActive and (job.lastProgress is None or job.lastProgress.batchId < 3):
        time.sleep(0.1)
    job.stop()
    publisher.run()
    replay = Replay(
        spark, "ordered", lambda m: realtime.window_stream(m, REALTIME), topic, maxFilesPerTrigger="8"
    )
    return _window_rows(replay.run().result())
