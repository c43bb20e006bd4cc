import json
from dataclasses import replace

import pytest
from pyspark.sql import functions as F

from laneflow import schemas
from laneflow.config import SiteConfig
from laneflow.operators import grid, series
from laneflow.plans.replay import Replay
from laneflow.sources import topics
from laneflow.streaming import realtime
from laneflow.streaming.silence import empty_speeds

SITE = SiteConfig(location="a", tz="UTC", data_origin_ms=0, site_offset_ms=0)
WINDOW = 10_000
CONFIG = realtime.RealtimeConfig(site=SITE, window_ms=WINDOW, history=3, fill=True)


def message(site, window, speed=30.0):
    """One car in the middle of a window."""
    at = window * WINDOW + 5_000
    car = {"Global_Time": at, "ElapsedTime": at, "Vehicle_ID": 1, "Local_X": 0.0, "Local_Y": 0.0}
    return "k", json.dumps([car | {"v_Vel": speed, "v_Acc": 0.0, "Lane_ID": 1, "Location": site}])


def run(spark, slices, config=CONFIG):
    replay = Replay(spark, "silence", lambda m: realtime.matrix_stream(m, config), timers=True)
    for rows in slices:
        replay.run(spark.createDataFrame(rows, schemas.TOPIC))
    out = replay.result().select(
        "location", (F.unix_millis("timewindow.start") / WINDOW).cast("int").alias("w"),
        (F.unix_millis("timewindow.end") / WINDOW).cast("int").alias("e"), "matrix",
    )
    rows = out.collect()
    assert all(r.e == r.w + 1 for r in rows)
    assert len({(r.location, r.w) for r in rows}) == len(rows)
    return {(r.location, r.w): r.matrix for r in rows}


def windows(out, site):
    return sorted(w for at, w in out if at == site)


# "a" is silent in 3 and 4 and from 7 on, None in 2 to 6; "b" moves the clock on to window 20.
HEARD = [("a", 1), ("a", 2), ("a", 5), ("a", 6), (None, 1), (None, 7), *[("b", w) for w in range(0, 21)]]


@pytest.fixture(scope="module")
def heard():
    return [message(*x) for x in HEARD]


def test_silent_windows_are_filled_up_to_the_watermark(spark, heard):
    out = run(spark, [heard])
    final = 18  # the clock stands in window 20, the watermark a window behind it
    assert windows(out, "a") == list(range(1, final + 1))
    assert windows(out, None) == list(range(1, final + 1))
    assert windows(out, "b") == list(range(0, final + 1))
    empty = [[[60]] * SITE.sections] * SITE.lanes(False)
    assert [w for w in windows(out, "a") if out["a", w] != empty] == [1, 2, 5, 6]
    assert out["a", 5][0][0] == [30]


def test_batches_and_restarts_change_nothing(spark, heard):
    by_time = [[message(s, w) for s, w in HEARD if a <= w < b] for a, b in ((0, 3), (3, 6), (6, 15), (15, 21))]
    assert run(spark, by_time) == run(spark, [heard])


@pytest.mark.parametrize("slices", [1, 4])
def test_patience_ends_and_begins_again(spark, slices):
    rows = HEARD + [("a", 15)]
    bounds = [(0, 21)] if slices == 1 else [(0, 3), (3, 9), (9, 15), (15, 21)]
    parts = [[message(s, w) for s, w in rows if a <= w < b] for a, b in bounds]
    out = run(spark, parts, replace(CONFIG, patience=2))
    # 3 and 4 are two; of 7 to 14 only two, then nothing until 15; two more after it
    assert windows(out, "a") == [1, 2, 3, 4, 5, 6, 7, 8, 15, 16, 17]
    assert windows(out, None) == [1, 2, 3, 7, 8, 9]


def test_no_patience_is_no_fill(spark, heard):
    plain = run(spark, [heard], replace(CONFIG, fill=False))
    assert run(spark, [heard], replace(CONFIG, patience=0)) == plain


def test_between_a_sites_windows_it_equals_the_batch_series(spark, heard):
    seen = spark.createDataFrame([(s, w, 1) for s, w in HEARD], "location string, time_window long, matrix int")
    filled = series.gap_filled(seen, F.lit(0)).collect()
    out = run(spark, [heard])
    want = {(r.location, r.time_window) for r in filled if r.time_window <= 18}
    last = {s: max(w for at, w in HEARD if at == s) for s in ("a", "b", None)}
    assert {k for k in out if k[1] <= last[k[0]]} == want


def test_the_empty_matrix_is_that_of_the_grid(spark):
    row = spark.range(1).select(empty_speeds(SITE, True).alias("a"), grid.empty_matrix(SITE).alias("b")).head()
    assert row.a == [[[cell.vel] for cell in lane] for lane in row.b]


def test_one_query_for_both_jobs_is_refused(spark, tmp_path):
    messages = topics.read_stream(spark, "parquet", str(tmp_path))
    with pytest.raises(ValueError, match="topic"):
        realtime.history_stream(messages, CONFIG)
