"""Properties of physical plans that must hold at any scale."""

from datetime import date

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as entry
from laneflow.config import SiteConfig, WindowConfig
from laneflow.operators import aggregate, clean, segments
from laneflow.plans import catalog, jobs, training
from laneflow.plans import telemetry as tel
from laneflow.sources import files, topics

SF_DIR = "/root/testdata/sf0.001"
UDF_QUERIES = {"forecast_udf", "stream_forecast"}


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def final_plan(df) -> str:
    df.collect()
    text = plan(df)
    return text[: text.index("== Initial Plan ==")]


def jobs_run(spark) -> int:
    return len(spark.sparkContext.statusTracker().getJobIdsForGroup(None))


BATCH = sorted(n for n in catalog.REGISTRY if not n.startswith("stream_") and n not in UDF_QUERIES)
CHEAP = [n for n in BATCH if n not in {"experiment_sweep", "forecast_regression", "metrics_log"} and not n.startswith("forecast_regression")]


@pytest.mark.parametrize("name", CHEAP)
def test_no_python_and_no_cross_join(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    for node in ("Python", "ArrowEval", "CartesianProduct", "BroadcastNestedLoopJoin"):
        assert node not in text


def test_flagship_reads_five_columns_and_combines_before_both_shuffles(spark):
    text = plan(entry.entry(spark))
    assert "ReadSchema: struct<event_id:bigint,ts:timestamp_ntz,user_id:bigint,event_type:string,value:double>" in text
    assert text.count("Exchange hashpartitioning") == 2
    assert text.count("partial_avg") == 4  # speed and acceleration, both levels
    assert "Sort" not in text


def test_location_filter_reaches_the_scan(spark):
    text = plan(entry.queries()["lane_merge"](spark, SF_DIR))
    assert "PushedFilters: [IsNotNull(event_type), EqualTo(event_type,click)]" in text


@pytest.mark.parametrize("name", ["window_range", "snapshot", "elapsed_range", "snapshot_grid"])
def test_time_span_reaches_the_scan(spark, name):
    text = plan(entry.queries()[name](spark, SF_DIR))
    assert "GreaterThanOrEqual(ts," in text and "LessThan(ts," in text


def test_time_range_of_windows_reaches_the_section_table(spark, tmp_path):
    table = files.section_table(catalog.section_agg(spark, SF_DIR), str(tmp_path / "sections"))
    text = plan(aggregate.timewindow_agg(table, WindowConfig(10, 45, 2772.5)))
    assert "GreaterThanOrEqual(elapsed_time,45000)" in text
    assert "LessThan(elapsed_time,2772455)" in text


def test_segments_scan_the_points_once(spark):
    points = tel.points(spark, SF_DIR)
    jobs_before = jobs_run(spark)
    df = segments.trajectory_segments(points)
    assert jobs_run(spark) == jobs_before  # declaring it runs nothing
    text = final_plan(df)
    assert text.count("/events.parquet") == 1
    assert "ReusedExchange" in text


def test_frame_encoder_scans_the_points_once(spark):
    points = tel.frames(spark, SF_DIR)
    jobs_before = jobs_run(spark)
    df = topics.frames_to_messages(points)
    assert jobs_run(spark) == jobs_before
    text = final_plan(df)
    assert text.count("/events.parquet") == 1
    assert text.count("Exchange hashpartitioning") == 2  # equal points are counted first


def test_lookup_per_site_does_not_shuffle_the_points(spark):
    text = plan(entry.queries()["distance_elapsed"](spark, SF_DIR))
    assert "BroadcastHashJoin" in text and "Exchange hashpartitioning" not in text


def test_sections_of_raw_files_leave_out_unused_math_and_columns(spark, tmp_path):
    path = str(tmp_path / "raw")
    files.write_table(files.as_trajectory(tel.telemetry(spark, SF_DIR)), path, "csv", header="true")
    points = jobs.site_points(files.read_trajectories(spark, path), SiteConfig(), [7, 8])
    text = plan(aggregate.section_agg(points, SiteConfig()))
    assert "ATAN" not in text.upper() and "Sort" not in text
    assert "EqualTo(Location,us-101)" in text
    read = text[text.index("ReadSchema"):]
    assert "v_Vel" in read and "Global_X" not in read and "Space_Headway" not in read


def test_days_and_instants_reach_the_scan_of_stored_points(spark, tmp_path):
    path = str(tmp_path / "points")
    raw = files.as_trajectory(tel.telemetry(spark, SF_DIR)).withColumn("Location", F.lit("us-101"))
    files.write_points(raw, path)
    stored = files.read_points(spark, path)
    assert stored.count() == raw.count()
    day = stored.filter("day = '2024-01-15'").filter("Location = 'us-101'")
    text = plan(day)
    assert "PartitionFilters: [isnotnull(" in text and "PartitionFilters: []" not in text
    site = SiteConfig()
    points = clean.clean_points(stored, site)
    text = plan(clean.snapshot(points, 1000, site.data_origin_ms))
    assert f"EqualTo(Global_Time,{site.data_origin_ms + 1000})" in text
    some = clean.on_days(points, [date(2024, 1, 15)], "UTC")
    assert "GreaterThanOrEqual(Global_Time,1705276800000)" in plan(some)
    assert some.count() == stored.filter("day = '2024-01-15'").count() > 0


def test_sweep_shares_its_series_and_samples(spark):
    text = plan(entry.queries()["experiment_sweep"](spark, SF_DIR))
    assert text.count("Exchange hashpartitioning") <= 12


def test_long_grid_needs_no_join(spark):
    assert "Join" not in plan(entry.queries()["dense_grid_long"](spark, SF_DIR))


def test_training_reads_only_needed_columns_of_the_section_table(spark, tmp_path):
    sections = catalog.section_agg(spark, SF_DIR)
    table = files.section_table(sections, str(tmp_path / "sections"))
    text = plan(training.window_grids(table, SiteConfig(), tel.DAILY))
    assert "location" in text and text.count("FileScan") == 1
    assert "n:bigint" not in text  # the vehicle total is not part of the grid
