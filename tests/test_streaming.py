import json
import random
from datetime import datetime
from zoneinfo import ZoneInfo

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import DecimalType

from laneflow import schemas, session
from laneflow.config import SiteConfig, WindowConfig
from laneflow.operators import aggregate, clean, grid
from laneflow.plans.replay import Replay, publish, run_to_end
from laneflow.sources import topics
from laneflow.streaming import realtime, stages

SITE = SiteConfig()
SPEED = DecimalType(8, 2)
CONFIG = realtime.RealtimeConfig(site=SITE, history=3, speed=SPEED)
WINDOW = WindowConfig(10)
START = SITE.origin_ms


@pytest.fixture(scope="module")
def frames():
    """90 seconds of frames, a few cars in each; seconds 40 to 50 are silent."""
    rng = random.Random(11)
    out = []
    for tick in range(900):
        cars = [
            {
                "Global_Time": START + tick * 100,
                "ElapsedTime": tick * 100,
                "Vehicle_ID": vehicle,
                "Local_X": 0.0,
                "Local_Y": rng.choice([0.0, 246.9, 247.0, 2222.9, 2224.66, 2475.0, 1300.0]),
                "v_Vel": rng.randrange(0, 7000) / 100,
                "v_Acc": 0.5,
                "Lane_ID": rng.choice([1, 2, 5, 6]),
                "Location": "us-101",
            }
            for vehicle in range(rng.randrange(1, 6))
        ]
        out.append([] if 400 <= tick < 500 else cars)
    return out


def messages(spark, frames, rows=None):
    values = [("k", json.dumps(f)) for f in frames] if rows is None else rows
    return spark.createDataFrame(values, schemas.TOPIC)


def batch_points(spark, frames):
    points = topics.parse_frames(messages(spark, frames), SPEED)
    return clean.add_elapsed(clean.add_distance(points), START)


def closed_at(frames):
    return max(c["Global_Time"] for f in frames for c in f) - CONFIG.window_ms


def batch_windows(spark, frames, config=CONFIG):
    """The batch result on the stream's terms: unrounded frame means, closed windows only."""
    sections = aggregate.section_agg(batch_points(spark, frames), SITE, round_frame=False)
    windows = aggregate.timewindow_agg(sections, WINDOW)
    end = F.lit(START) + (F.col("time_window") + 1) * F.lit(config.window_ms)
    return windows.filter(end <= closed_at(frames))


def start_ms(column):
    return F.unix_millis(F.col(column))


def stream(spark, path, **options):
    return topics.read_stream(spark, "parquet", path, **options)


def in_slices(spark, frames, path, sizes):
    """Publish consecutive frames one file after the other."""
    at = 0
    for size in sizes:
        publish(messages(spark, frames[at : at + size]).coalesce(1), path)
        at += size
    assert at == len(frames)


def window_rows(df):
    columns = (start_ms("timewindow.start"), "section_id", "lane_id", "avg_vel")
    return sorted(tuple(r) for r in df.select(*columns).collect())


def test_stream_equals_batch_over_many_micro_batches(spark, frames, tmp_path):
    path = str(tmp_path / "topic")
    in_slices(spark, frames, path, [70, 230, 150, 300, 150])
    source = stream(spark, path, maxFilesPerTrigger="1")
    out = realtime.window_stream(source, CONFIG)
    query = topics.write_stream(
        out, "parquet", str(tmp_path / "cp"), path=str(tmp_path / "out"), trigger={"availableNow": True}
    )
    query.awaitTermination()
    assert len(query.recentProgress) >= 5
    got = window_rows(spark.read.parquet(str(tmp_path / "out")))
    want = batch_windows(spark, frames).select(
        F.lit(START) + F.col("time_window") * F.lit(10_000), "section_id", "lane_id", "avg_vel"
    )
    assert got == sorted(tuple(r) for r in want.collect())
    assert len(got) > 100
    kept = query.lastProgress["stateOperators"]
    assert sum(op["numRowsTotal"] for op in kept) < 4_000  # frames of closed windows are gone


def test_matrices_equal_the_batch_grid(spark, frames, tmp_path):
    replay = Replay(spark, "matrices", lambda m: realtime.matrix_stream(m, CONFIG))
    out = replay.run(messages(spark, frames)).result()
    got = {r[0]: r[1] for r in out.select(start_ms("timewindow.start"), "matrix").collect()}
    grids = grid.dense_grid(batch_windows(spark, frames), SITE, with_ramp=False).collect()
    want = {START + g.time_window * 10_000: [[[c.vel] for c in row] for row in g.matrix] for g in grids}
    assert got == want
    assert START + 40_000 not in got


def expected_histories(windows, last_end):
    """Per sliding window the windows in it, in order."""
    out = {}
    for base in {w - j * 10_000 for w in windows for j in range(CONFIG.history)}:
        if base + CONFIG.history * 10_000 <= last_end:
            out[base] = [w for w in sorted(windows) if base <= w < base + CONFIG.history * 10_000]
    return out


def test_chained_history_and_forecast(spark, frames):
    def last_step():
        return lambda batch: batch[:, -1, :] + 0.5

    def build(m):
        return realtime.forecast_stream(realtime.history_stream(m, CONFIG), CONFIG, last_step)

    out = Replay(spark, "forecast", build).run(messages(spark, frames)).result().collect()
    matrices = Replay(spark, "mat", lambda m: realtime.matrix_stream(m, CONFIG))
    matrices = matrices.run(messages(spark, frames)).result()
    by_start = {r[0]: r[1] for r in matrices.select(start_ms("timewindow.start"), "matrix").collect()}
    histories = expected_histories(by_start, closed_at(frames))
    assert {r.global_time for r in out} == set(histories)
    for r in out:
        steps = histories[r.global_time]
        local = datetime.fromtimestamp(r.global_time / 1000, ZoneInfo(SITE.tz)).replace(tzinfo=None)
        assert r.based_timewindow.start == local
        assert r.target_start == r.global_time + (CONFIG.history + CONFIG.skip) * 10_000
        if len(steps) < CONFIG.history:
            assert r.prediction == [[0] * 10 for _ in range(5)]
        else:
            # a half is rounded to the even neighbour
            last = by_start[steps[-1]]
            assert r.prediction == [[round(c[0] + 0.5) for c in row] for row in last]
    assert any(len(s) == 3 for s in histories.values()) and any(len(s) < 3 for s in histories.values())


def test_two_jobs_restarted_half_way(spark, frames):
    producer = Replay(
        spark, "p", lambda m: topics.encode_matrices(realtime.matrix_stream(m, CONFIG))
    )
    consumer = Replay(spark, "c", lambda m: realtime.history_from_topic(m, CONFIG), producer.sink)
    for part in (frames[:350], frames[350:]):
        producer.run(messages(spark, part))
        consumer.run()
    one_query = Replay(spark, "h", lambda m: realtime.history_stream(m, CONFIG))
    one_query.run(messages(spark, frames))

    def rows(df):
        picked = df.select(start_ms("based_timewindow.start").alias("base"), "history", F.size("history"))
        return {r.base: r.history for r in picked.collect()}

    mine, reference = rows(consumer.result()), rows(one_query.result())
    received = spark.read.schema(schemas.TOPIC).parquet(producer.sink)
    starts = topics.parse_matrices(received).select(start_ms("timewindow.start")).collect()
    watermark = max(r[0] for r in starts) - CONFIG.history * 10_000
    assert mine == {b: h for b, h in reference.items() if b + CONFIG.history * 10_000 <= watermark}
    assert len(mine) > 2


def test_repeated_malformed_and_late_messages(spark, frames, tmp_path):
    config = realtime.RealtimeConfig(site=SITE, history=3, speed=SPEED, dedup=True)
    path = str(tmp_path / "topic")
    noise = [("k", "[]"), ("k", "{broken"), ("k", None)]
    replay = Replay(spark, "noisy", lambda m: realtime.window_stream(m, config), path)
    half = messages(spark, frames[:600])
    replay.run(half.unionAll(half).unionAll(messages(spark, None, noise)))
    assert replay.late_rows == 0
    # Frames far behind the watermark arrive with wrong speeds: they must not change anything.
    stale = [[{**c, "v_Vel": 99.0} for c in f] for f in frames[:100]]
    replay.run(messages(spark, stale))
    assert replay.late_rows > 0
    again = messages(spark, frames[550:])
    replay.run(again)
    got = window_rows(replay.result())
    want = batch_windows(spark, frames).select(
        F.lit(START) + F.col("time_window") * F.lit(10_000), "section_id", "lane_id", "avg_vel"
    )
    assert got == sorted(tuple(r) for r in want.collect())


def test_cluster_settings_survive_a_restart(spark, frames):
    conf = session.cluster_conf(executors=2, cores=2)
    assert conf["spark.sql.shuffle.partitions"] == "8"
    streaming = {k: v for k, v in conf.items() if "stateStore" in k}
    before = {k: spark.conf.get(k, None) for k in streaming}
    for key, value in streaming.items():
        spark.conf.set(key, value)
    try:
        replay = Replay(spark, "rocks", lambda m: realtime.window_stream(m, CONFIG))
        replay.run(messages(spark, frames[:450]))
        replay.run(messages(spark, frames[450:]))
    finally:
        for key, value in before.items():
            spark.conf.unset(key) if value is None else spark.conf.set(key, value)
    assert replay.result().count() == batch_windows(spark, frames).count()


def test_state_width(spark):
    key, chosen = session.SHUFFLE_WIDTH, spark.conf.get(session.SHUFFLE_WIDTH)
    for before in (chosen, "200"):
        spark.conf.set(key, before)
        with session.state_width(spark, None):
            assert spark.conf.get(key) == before
        with session.state_width(spark, 3):
            assert spark.conf.get(key) == "3"
        assert spark.conf.get(key) == before
    spark.conf.set(key, chosen)


def test_release_empties_what_was_written(spark, tmp_path):
    kept = session.materialize(spark.range(5), "kept", str(tmp_path / "kept"))
    gone = session.materialize(spark.range(7), "gone")
    path = gone.inputFiles()[0].rsplit("/", 1)[0]
    assert session.release(spark) >= 1
    assert kept.count() == 5 and spark.read.parquet(path).count() == 0
    assert session.release(spark) == 0


def test_windows_follow_the_epoch_without_alignment(spark, frames):
    config = realtime.RealtimeConfig(site=SITE, align_to_origin=False)
    assert config.start_time == "0 milliseconds"
    assert CONFIG.start_time == "9700 milliseconds"
    replay = Replay(spark, "epoch", lambda m: realtime.window_stream(m, config))
    out = replay.run(messages(spark, frames)).result()
    assert {r[0] % 10_000 for r in out.select(start_ms("timewindow.start")).collect()} == {0}


def test_second_job_writes_json_files(spark, frames, tmp_path):
    topic, sink = str(tmp_path / "matrices"), str(tmp_path / "forecasts")
    matrices = Replay(spark, "m", lambda m: realtime.matrix_stream(m, CONFIG))
    done = matrices.run(messages(spark, frames)).result()
    publish(topics.encode_matrices(done), topic)
    publish(topics.encode_matrices(done), topic)  # re-sent windows are dropped
    query = realtime.start_second_job(
        stream(spark, topic), CONFIG, lambda: lambda batch: batch.mean(axis=1), sink,
        str(tmp_path / "cp"), trigger={"availableNow": True},
    )
    query.awaitTermination()
    out = spark.read.json(sink).select("global_time", "prediction").collect()
    assert len(out) == len({r.global_time for r in out}) > 0
    assert all(len(r.prediction) == 5 and len(r.prediction[0]) == 10 for r in out)


def test_first_job_to_a_file_topic(spark, frames, tmp_path):
    source, sink = str(tmp_path / "in"), str(tmp_path / "out")
    publish(messages(spark, frames), source)
    query = realtime.start_first_job(
        stream(spark, source), CONFIG, "parquet", str(tmp_path / "cp"), path=sink,
        name="first_job", trigger={"availableNow": True},
    )
    query.awaitTermination()
    out = topics.parse_matrices(spark.read.schema(schemas.TOPIC).parquet(sink))
    assert out.filter(F.col("location") != "us-101").count() == 0
    assert out.count() == batch_windows(spark, frames).select("time_window").distinct().count()


def test_dedup_keeps_one_point_per_vehicle_and_frame(spark, frames):
    def build(m):
        points = stages.add_event_time(topics.parse_frames(m), SITE, "0 seconds")
        return stages.dedup_points(points)

    batch = messages(spark, frames)
    replay = Replay(spark, "dedup", build).run(batch.unionAll(batch))
    replay.run(batch)
    out = replay.result()
    assert out.count() == out.select("vehicle_id", "global_time").distinct().count()
    last = max(c["Global_Time"] for f in frames for c in f)
    assert out.count() == sum(c["Global_Time"] <= last for f in frames for c in f)


def test_kafka_is_a_matter_of_options():
    assert topics.kafka_source_options("host:1", "frames") == {
        "kafka.bootstrap.servers": "host:1", "subscribe": "frames", "startingOffsets": "earliest",
    }
    assert topics.kafka_sink_options("host:1", "out") == {
        "kafka.bootstrap.servers": "host:1", "topic": "out",
    }


def test_run_to_end_twice_reads_nothing_new(spark, frames, tmp_path):
    path = str(tmp_path / "t")
    publish(messages(spark, frames[:20]), path)
    for _ in range(2):
        run_to_end(topics.parse_frames(stream(spark, path)), str(tmp_path / "cp"), str(tmp_path / "o"))
    assert spark.read.parquet(str(tmp_path / "o")).count() == sum(len(f) for f in frames[:20])
