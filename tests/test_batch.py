import random
from collections import defaultdict
from datetime import datetime

import pytest
from hypothesis import HealthCheck, given, settings
from hypothesis import strategies as st
from pyspark.sql import functions as F

from laneflow import schemas
from laneflow.config import SampleConfig, SiteConfig, WindowConfig
from laneflow.operators import aggregate, clean, copies, forecast, grid, segments, series
from laneflow.sources import files, topics

SITE = SiteConfig()
POINT = (
    "location string, elapsed_time long, distance double, lane_id int, v_vel double, v_acc double"
)
CELLS = "location string, time_window long, section_id int, lane_id int, avg_vel double, avg_acc double, n long"


def raw(**values):
    row = {f.name: None for f in schemas.TRAJECTORY}
    row.update(values)
    return tuple(row[f.name] for f in schemas.TRAJECTORY)


def test_clean_points(spark):
    rows = [
        raw(Vehicle_ID=1, Global_Time=SITE.origin_ms, Local_X=3.0, Local_Y=4.0, Global_X=6451137.0,
            Global_Y=1873344.0, v_Vel=44.0, v_Acc=-2.2, Lane_ID=8, Location="us-101"),
        raw(Vehicle_ID=2, Global_Time=SITE.origin_ms, Local_X=0.0, Local_Y=1.0, Lane_ID=1,
            Location="i-80"),
    ]
    df = spark.createDataFrame(rows, schemas.TRAJECTORY)
    out = clean.clean_points(df, SITE).collect()
    assert len(out) == 1
    r = out[0]
    assert (r.distance, r.lane_id, r.elapsed_time) == (5.0, 6, SITE.site_offset_ms)
    assert (r.year, r.month, r.day, r.hour) == (2005, 6, 15, 7)
    assert r.v_vel == 44.0 / 1.46666667
    assert r.datetime == datetime(2005, 6, 15, 7, 49, 39, 700000)
    kept = clean.hour_filter(clean.clean_points(df, SITE), [7, 8], SITE.site_offset_ms).collect()
    assert kept[0].elapsed_time == 0
    assert clean.hour_filter(clean.clean_points(df, SITE), 9).count() == 0
    assert clean.clean_points(df, SITE, in_mph=True).head()["v_vel"] == 44.0


def test_means_of_means_and_frame_counts(spark):
    rows = [
        ("a", 0, 10.0, 1, 10.0, 0.5), ("a", 0, 20.0, 1, 20.0, -0.5), ("a", 0, 30.0, 1, 20.0, 1.0),
        ("a", 100, 40.0, 1, 60.0, -3.0), ("a", 100, 250.0, 1, 5.0, 0.0), ("a", 9_999, 40.0, 2, 1.0, 0.0),
    ]
    sections = aggregate.section_agg(spark.createDataFrame(rows, POINT), SITE)
    frame = {(r.elapsed_time, r.section_id, r.lane_id): r for r in sections.collect()}
    assert frame[0, 0, 1].avg_vel == 16.7
    assert frame[0, 0, 1].avg_acc == 0.33
    assert frame[0, 0, 1].n == 3
    windows = aggregate.timewindow_agg(sections, WindowConfig(10, 0, 10))
    cell = {(r.time_window, r.section_id, r.lane_id): r for r in windows.collect()}
    assert (cell[0, 0, 1].avg_vel, cell[0, 0, 1].n, cell[0, 0, 1].vehicles) == (38.4, 2, 4)
    assert cell[0, 1, 1].n == 1
    assert (0, 0, 2) not in cell  # trimmed away 45 ms before the end


def test_unrounded_frame_means(spark):
    rows = [("a", 0, 1.0, 1, v, 0.0) for v in (10.0, 20.0, 20.0)]
    out = aggregate.section_agg(spark.createDataFrame(rows, POINT), SITE, round_frame=False)
    assert out.head()["avg_vel"] == pytest.approx(50 / 3)


def test_scaling(spark):
    rows = [("a", 0, 0, 1, 10.0, -1.0, 2), ("a", 0, 1, 1, 30.0, 1.0, 4), ("b", 0, 0, 1, 5.0, 0.0, 3)]
    windows = spark.createDataFrame(rows, CELLS)
    stats = aggregate.scale_stats(windows)
    out = {(r.location, r.section_id): r for r in aggregate.min_max_scaled(windows, stats).collect()}
    assert (out["a", 0].avg_vel, out["a", 0].avg_acc, out["a", 0].n) == (0.0, 0.0, 0.5)
    assert (out["a", 1].avg_vel, out["a", 1].n) == (1.0, 1.0)
    assert out["b", 0].avg_vel is None and out["b", 0].n == 1.0


def test_grid_defaults_truncation_and_overflow(spark):
    rows = [
        ("a", 0, 0, 1, 45.7, 0.25, 7), ("a", 0, 9, 2, 10.0, 0.0, 1), ("a", 0, 10, 2, 20.0, 0.0, 2),
        ("a", 0, 10, 3, 33.3, 0.0, 3), ("a", 0, 11, 1, 1.0, 0.0, 1), ("a", 0, 0, 7, 1.0, 0.0, 1),
        ("a", 0, 0, 0, 1.0, 0.0, 1), ("a", 0, 4, 6, 12.9, 0.0, 1), ("a", 1, 3, 6, 12.9, 0.0, 1),
    ]
    windows = spark.createDataFrame(rows, CELLS)
    grids = {r.time_window: r.matrix for r in grid.dense_grid(windows, SITE).collect()}
    first = grids[0]
    assert len(first) == 6 and all(len(row) == 10 for row in first)
    assert tuple(first[0][0]) == (45, 7.0, 0.25)
    assert first[1][9].vel == 20  # the row past the last section wins
    assert first[2][9].vel == 33
    assert first[5][4].vel == 12
    assert tuple(first[3][3]) == (60, 0.0, 0.0)
    touched = sum(tuple(c) != (60, 0.0, 0.0) for row in first for c in row)
    assert touched == 4
    ramp_off = {r.time_window: r.matrix for r in grid.dense_grid(windows, SITE, False).collect()}
    assert len(ramp_off[0]) == 5
    assert all(c.vel == 60 for row in ramp_off[1] for c in row)  # a window of ramp rows only
    exact = grid.dense_grid(windows, SITE, velocity_type="double").filter("time_window = 0").head()
    assert exact.matrix[0][0].vel == 45.7
    assert grid.grid_cells(grid.dense_grid(windows, SITE), SITE.sections).count() == 2 * 60


@settings(max_examples=12, deadline=None, suppress_health_check=list(HealthCheck))
@given(
    st.dictionaries(
        st.tuples(st.integers(0, 2), st.integers(-1, 12), st.integers(0, 8)),
        st.tuples(st.floats(-5, 90), st.integers(1, 100)),
        min_size=1,
        max_size=60,
    ),
    st.booleans(),
)
def test_grid_equals_filling_a_matrix(spark, occupied, with_ramp):
    rows = [("a", t, s, lane, v, v / 8, n) for (t, s, lane), (v, n) in occupied.items()]
    lanes = 6 if with_ramp else 5
    want = {t: [[(60, 0.0, 0.0)] * 10 for _ in range(lanes)] for t, _, _ in occupied}
    for (t, s, lane), (v, n) in sorted(occupied.items()):
        if 1 <= lane <= lanes and 0 <= s <= 10:
            want[t][lane - 1][min(s, 9)] = (int(v), float(n), v / 8)
    out = grid.dense_grid(spark.createDataFrame(rows, CELLS), SITE, with_ramp).collect()
    assert {r.time_window: [[tuple(c) for c in row] for row in r.matrix] for r in out} == want


@settings(max_examples=8, deadline=None, suppress_health_check=list(HealthCheck))
@given(st.integers(1, 40), st.integers(1, 6), st.integers(0, 3), st.integers(1, 3))
def test_sample_counts(spark, total, history, skip, predict):
    config = SampleConfig(history, skip, predict)
    indexed = series.series_index(series_frame(spark, {"a": total}), block=5)
    assert series.samples(indexed, config, chunk=7).count() == max(0, total - config.span)
    every = series.samples(indexed, config, chunk=7, drop_last=False)
    assert every.count() == max(0, total - config.span + 1)


def series_frame(spark, lengths):
    rows = [(site, 3 * t + 1) for site, n in lengths.items() for t in range(n)]
    random.Random(5).shuffle(rows)
    df = spark.createDataFrame(rows, "location string, time_window long")
    cell = F.struct(F.col("time_window").cast("int").alias("vel"))
    return df.withColumn("matrix", F.array(F.array(cell)))


def test_series_index_counts_windows_across_blocks(spark):
    indexed = series.series_index(series_frame(spark, {"a": 100, "b": 7}), block=16)
    for r in indexed.collect():
        assert r.idx == (r.time_window - 1) // 3
        assert r.series_len == {"a": 100, "b": 7}[r.location]


@pytest.mark.parametrize("config", [SampleConfig(6, 1, 1), SampleConfig(3, 0, 2), SampleConfig(1, 4, 3)])
@pytest.mark.parametrize("chunk", [9, 16, 1024])
def test_samples_match_slices(spark, config, chunk):
    lengths = {"a": 60, "b": 12, "c": 3}
    indexed = series.series_index(series_frame(spark, lengths), block=8)
    got = defaultdict(dict)
    for r in series.samples(indexed, config, chunk=chunk).collect():
        history = [w.time_window for w in r.history]
        got[r.location][r.sample_id] = (history, [w.time_window for w in r.target])
    h, k, p = config.history, config.skip, config.predict
    for site, total in lengths.items():
        windows = [3 * t + 1 for t in range(total)]
        want = {
            e - h - k - p: (windows[e - h - k - p : e - k - p], windows[e - p : e])
            for e in range(h + k + p, total)
        }
        assert got[site] == want
    every = series.samples(indexed, config, chunk=chunk, drop_last=False)
    assert every.count() == sum(max(0, n - config.span + 1) for n in lengths.values())
    bounded = series.samples(indexed, config, num_windows=20, chunk=chunk)
    assert bounded.filter("location = 'a'").count() == 20 - config.span


def test_chrono_split(spark):
    df = spark.range(264).select(F.col("id").alias("sample_id"), F.lit(264).alias("num_samples"))
    sizes = {r.split: r.n for r in series.chrono_split(df).groupBy("split").agg(F.count("*").alias("n")).collect()}
    assert sizes == {"train": 184, "validation": 27, "test": 53}
    online = series.chrono_split(df, realtime=True).groupBy("split").agg(F.count("*").alias("n"))
    assert {r.split: r.n for r in online.collect()} == {"train": 231, "validation": 33}


@pytest.mark.parametrize("bucket_ms", [1_000, 50_000])
def test_segments_across_buckets_and_copies(spark, bucket_ms):
    rng = random.Random(3)
    rows = []
    for vehicle in range(4):
        time = 0
        for _ in range(60):
            time += rng.choice((100, 100, 700, 9_000))
            row = (vehicle, time, float(rng.randrange(500)), float(rng.randrange(60)))
            rows += [row] * rng.choice((1, 1, 1, 3))
    rows += [(9, 5, 1.0, 1.0), (None, 5, 1.0, 1.0), (None, 6, 1.0, 1.0)]
    rng.shuffle(rows)
    df = spark.createDataFrame(rows, "vehicle_id int, elapsed_time long, distance double, v_vel double")
    want = []
    for vehicle in (*range(4), None):  # points without a vehicle are one vehicle's
        points = sorted(r[1:] for r in rows if r[0] == vehicle)
        want += [
            (vehicle, a[0], a[1], b[0], b[1], a[2]) for a, b in zip(points, points[1:], strict=False)
        ]
    out = segments.trajectory_segments(df, ("vehicle_id",), bucket_ms=bucket_ms)
    assert sorted(map(tuple, out.collect()), key=repr) == sorted(want, key=repr)


def test_expand_copies(spark):
    df = spark.createDataFrame([("x", 1), ("y", 7), ("z", 3)], "k string, c long")
    out = copies.expand_copies(df, "c", block=3)
    assert {r.k: r["count"] for r in out.groupBy("k").count().collect()} == {"x": 1, "y": 7, "z": 3}


def frame_points(spark):
    rows = [(t, v, 1.0 * v, 2.0, 30.0 + v, 0.5, 1, "a") for t in (0, 100, 300) for v in range(t // 100 + 2)]
    rows += [(300, 77, 1.0, 2.0, 9.0, 0.0, 2, "b")] * 11
    schema = "global_time long, vehicle_id int, local_x double, local_y double, v_vel double, v_acc double, lane_id int, location string"
    return spark.createDataFrame(rows, schema), rows


@pytest.mark.parametrize("parts", [1, 4, 50])
def test_frames_round_trip_with_silent_and_off_grid_frames(spark, parts):
    points, rows = frame_points(spark)
    clock = topics.frame_clock(spark, 50, 450)
    messages = topics.frames_to_messages(points, clock, parts)
    collected = messages.collect()
    assert {m.global_time for m in collected} == {0, 100, 300, 50, 150, 250, 350, 450}
    assert all(m.value == "[]" for m in collected if m.global_time % 100)
    frames = {(r[7], r[0]) for r in rows}
    sent = len(collected) - 5
    assert sent == len(frames) if parts == 1 else len(frames) < sent <= len(rows)
    assert len({m.key for m in collected}) == len(collected)
    decoded = topics.parse_frames(messages).select(*points.columns)
    assert sorted(map(tuple, decoded.collect())) == sorted(rows)


def test_bad_payloads_yield_no_rows(spark):
    good = '[{"Global_Time":1,"Vehicle_ID":2,"Local_X":1.0,"Local_Y":2.0,"v_Vel":3.0,"Lane_ID":1}]'
    rows = [("k", good), ("k", "[]"), ("k", "not json"), ("k", None)]
    out = topics.parse_frames(spark.createDataFrame(rows, schemas.TOPIC)).collect()
    assert len(out) == 1 and out[0].global_time == 1 and out[0].location is None


def test_section_table_is_written_once(spark, tmp_path):
    rows = [("a", 0, 10.0, 1, 10.0, 0.5)]
    sections = aggregate.section_agg(spark.createDataFrame(rows, POINT), SITE)
    for fmt in ("csv", "parquet"):
        path = files.section_path(str(tmp_path / fmt), SITE, "raw", (7, 8))
        first = files.section_table(sections, path, fmt).collect()
        boom = sections.withColumn("avg_vel", F.raise_error(F.lit("read again")).cast("double"))
        assert files.section_table(boom, path, fmt).collect() == first
    wide = spark.range(5_000).select(
        F.lit("a").alias("location"),
        (F.pmod(F.xxhash64("id"), F.lit(5_000)) * 100).alias("elapsed_time"),
        F.lit(1.0).alias("distance"), F.lit(1).alias("lane_id"), F.lit(1.0).alias("v_vel"),
        F.lit(0.0).alias("v_acc"),
    )
    spread = files.section_table(aggregate.section_agg(wide, SITE), str(tmp_path / "wide"))
    spans = spread.groupBy(F.input_file_name()).agg(
        F.min("elapsed_time").alias("a"), F.max("elapsed_time").alias("b")
    )
    ordered = sorted((r.a, r.b) for r in spans.collect())
    assert all(x[1] < y[0] for x, y in zip(ordered, ordered[1:], strict=False))
    other = files.section_path(str(tmp_path), SITE, "realtime", (7, 8))
    assert other != files.section_path(str(tmp_path), SITE, "raw", (7, 8))


def test_first_last_histogram_extent(spark):
    rows = [("a", t, float(t), 1, 10.0 + t / 4, 0.0) for t in range(8)]
    df = spark.createDataFrame(rows, POINT)
    ends = aggregate.first_last(df, "elapsed_time").head()
    assert (ends.first_elapsed_time, ends.last_elapsed_time, ends.last_v_vel) == (0, 7, 11.75)
    ties = spark.createDataFrame([(s, k % 3, k, None) for s in ("a", None) for k in range(30)], "location string, t long, id long, x int")
    for n in (1, 3, 7):
        out = aggregate.first_last(ties.repartition(n), "t").collect()
        assert sorted((r.first_id, r.last_id) for r in out) == [(0, 29), (0, 29)]
    bars = [tuple(r) for r in aggregate.speed_histogram(df, "a", 1).collect()]
    assert bars == [(10.0, 2), (11.0, 4), (12.0, 2)]
    assert tuple(aggregate.extent(df).head()) == ("a", 7, 7.0)


def test_rows_without_a_site_are_kept(spark):
    """NULL is a site of its own in every step that joins a table per site."""
    points = spark.createDataFrame([("a", 5), ("a", 9), (None, 7), (None, 8)], "location string, elapsed_time long")
    assert sorted(map(tuple, clean.rebase_elapsed(points).collect()), key=repr) == sorted([("a", 0), ("a", 4), (None, 0), (None, 1)], key=repr)
    schema = "location string, time_window long, avg_vel double, avg_acc double, n long"
    windows = spark.createDataFrame([(s, w, float(w), 1.0, w + 1) for s in ("a", None) for w in range(20)], schema)
    scaled = aggregate.min_max_scaled(windows, aggregate.scale_stats(windows))
    assert scaled.count() == 40 and scaled.filter("location is null and avg_vel = 1").count() == 1
    ranked = series.series_index(windows, block=7)
    assert {(r.location, r.idx, r.series_len) for r in ranked.collect()} == {(s, i, 20) for s in ("a", None) for i in range(20)}
    truth = spark.createDataFrame([("a", 1, [1]), (None, 1, [2])], "location string, sample_id long, actual array<int>")
    made = truth.select("location", "sample_id", F.array(F.lit(0)).alias("prediction"))
    assert {r.location for r in forecast.with_truth(made, truth).collect()} == {"a", None}
