import random

import pytest
from pyspark.sql import functions as F

from laneflow import schemas
from laneflow.config import EXPERIMENTS, SiteConfig
from laneflow.plans import jobs
from laneflow.sources import files, increments, topics
from laneflow.streaming.late import LateRows

SITE = SiteConfig()
SECONDS = 130


@pytest.fixture(scope="module")
def raw(spark, tmp_path_factory):
    """130 seconds of raw points of the site, and a few of another one, as CSV with a header."""
    rng = random.Random(2)
    rows = []
    for tick in range(SECONDS * 10):
        for vehicle in range(8):
            row = {f.name: None for f in schemas.TRAJECTORY}
            row.update(
                Vehicle_ID=vehicle, Global_Time=SITE.origin_ms + tick * 100, Local_X=3.0,
                Local_Y=float((vehicle * 290 + tick) % 2224), Global_X=6451137.0 + vehicle,
                Global_Y=1873344.0, v_Vel=round(40 + 10 * rng.random(), 2), v_Acc=0.1,
                Lane_ID=vehicle + 1, Location="us-101" if vehicle else "i-80",
            )
            rows.append(tuple(row[f.name] for f in schemas.TRAJECTORY))
    path = str(tmp_path_factory.mktemp("raw") / "csv")
    files.write_table(spark.createDataFrame(rows, schemas.TRAJECTORY), path, "csv", header="true")
    return path


def test_measured_site(spark, raw):
    points = jobs.site_points(files.read_trajectories(spark, raw), SITE, [7, 8])
    site, end = jobs.measured(points, SITE)
    assert end == SECONDS - 1
    assert 2200 < site.max_dist < 2224
    assert points.filter("location != 'us-101'").count() == 0


def test_train_from_raw_files(spark, raw, tmp_path):
    out, log = str(tmp_path / "out"), str(tmp_path / "log")
    window = ["--start", "0", "--end", str(SECONDS), "--max-dist", str(SITE.max_dist)]
    jobs.main(["sections", "--raw", raw, "--out", out, *window])
    sections = spark.read.parquet(files.section_path(out, SITE, "raw", (7, 8)))
    assert sections.agg(F.sum("n")).head()[0] == 7 * SECONDS * 10
    assert sections.agg(F.max("lane_id")).head()[0] == 6
    jobs.main(["train", "--raw", raw, "--out", out, "--log", log, *window])
    rows = files.read_metrics(spark, log).collect()
    assert {r.model_name for r in rows} == {
        e.model_name("regression", SITE.sections) for e in EXPERIMENTS
    }
    assert all(r.rmse is not None and r.rmse < 60 for r in rows)


def test_real_time_jobs_end_to_end(spark, raw, tmp_path):
    d = {n: str(tmp_path / n) for n in ("out", "model", "replay", "in", "mid", "cp1", "cp2", "json")}
    jobs.main([
        "fit", "--raw", raw, "--out", d["out"], "--model", d["model"], "--start", "0",
        "--end", str(SECONDS), "--splits", "8", "--predict", "2",
    ])
    config = jobs.saved_config(spark, d["model"])  # the distance is measured
    assert config.site.max_dist < SITE.max_dist and config.site.splits == 8 and config.predict == 2
    points = files.read_trajectories(spark, raw).withColumn(
        "ElapsedTime", F.col("Global_Time") - SITE.origin_ms
    )
    names = [f.name for f in schemas.frame_point()]
    points = points.filter("Location = 'us-101'").select(*reversed(names))
    files.write_table(points, d["replay"], "csv", header="true")

    local = ["--format", "parquet", "--available-now"]
    end_ms = SITE.origin_ms + SECONDS * 1000
    jobs.main([
        "transmit", "--raw", d["replay"], "--topic", d["in"], "--start-ms", str(SITE.origin_ms),
        "--end-ms", str(end_ms), "--slice-ms", "40000", "--parts", "2", *local,
    ])
    sent = spark.read.parquet(d["in"])
    assert sent.filter("value = '[]'").count() == 1  # the last frame is silent
    assert SECONDS * 10 < sent.count() <= SECONDS * 20 + 1
    jobs.main([
        "aggregate", "--source", d["in"], "--topic", d["mid"], "--checkpoint", d["cp1"],
        "--model", d["model"], *local,
    ])
    windows = topics.parse_matrices(spark.read.schema(schemas.TOPIC).parquet(d["mid"]))
    assert windows.count() == SECONDS // 10 - 2
    jobs.main([
        "forecast", "--topic", d["mid"], "--out", d["json"], "--checkpoint", d["cp2"],
        "--model", d["model"], *local,
    ])
    with pytest.raises(ValueError, match="splits"):
        jobs.main([
            "forecast", "--topic", d["mid"], "--out", d["json"], "--checkpoint", d["cp2"],
            "--model", d["model"], "--splits", "9", *local,
        ])
    out = spark.read.json(d["json"]).select("global_time", "step", "prediction").collect()
    assert {r.step for r in out} == {0, 1}
    assert all(len(lane) == 9 for r in out for lane in r.prediction)
    speeds = [v for r in out for row in r.prediction for v in row]
    assert len(out) > 0 and all(len(r.prediction) == 5 for r in out)
    assert max(speeds) <= 70


def test_sections_absorbed_in_batches_equal_one_run(spark, raw, tmp_path):
    out = str(tmp_path / "out")
    window = ["--start", "0", "--end", str(SECONDS), "--max-dist", str(SITE.max_dist)]
    everything = files.read_trajectories(spark, raw)
    early = F.col("Global_Time") < SITE.origin_ms + 60_000
    for batch, part in (("late", everything.filter(~early)), ("early", everything.filter(early))):
        path = str(tmp_path / batch)
        files.write_table(part, path, "csv", header="true")
        for _ in range(2 if batch == "early" else 1):  # a batch that is run again counts once
            jobs.main(["sections", "--raw", path, "--out", out, "--absorb", batch, *window])
    jobs.main(["sections", "--raw", raw, "--out", out, *window])
    whole = spark.read.parquet(files.section_path(out, SITE, "raw", (7, 8)))
    absorbed = increments.read(spark, jobs.absorbed_path(out, SITE)).select(*whole.columns)
    assert whole.count() > 0
    assert whole.exceptAll(absorbed).isEmpty() and absorbed.exceptAll(whole).isEmpty()


def test_jobs_over_silent_windows(spark, raw, tmp_path):
    """A model fitted in epochs on the filled series, silence filled in the stream, late rows counted."""
    d = {n: str(tmp_path / n) for n in ("raw", "out", "model", "in", "mid", "cp0", "cp1", "late")}
    tick = (F.col("Global_Time") - SITE.origin_ms) / 1000
    gappy = files.read_trajectories(spark, raw).filter("Location = 'us-101'").filter(~tick.between(40, 69.95))
    files.write_table(gappy, d["raw"], "csv", header="true")
    jobs.main([
        "fit", "--raw", d["raw"], "--out", d["out"], "--model", d["model"], "--start", "0", "--end", str(SECONDS),
        "--max-dist", str(SITE.max_dist), "--fill", "--epochs", "3",
    ])
    assert jobs.saved_config(spark, d["model"]).fill
    weights = spark.read.json(d["model"]).collect()
    assert len(weights) == 1 and len(weights[0].per_cell) == 50

    points = gappy.withColumn("ElapsedTime", F.col("Global_Time") - SITE.origin_ms)
    points = points.select(*[F.col(f.name).alias(f.name.lower()) for f in schemas.frame_point()])
    points = points.withColumnRenamed("elapsedtime", "elapsed_time")
    local = ["--format", "parquet", "--available-now"]

    def aggregated():
        jobs.main([
            "aggregate", "--source", d["in"], "--topic", d["mid"], "--checkpoint", d["cp1"],
            "--model", d["model"], "--late", d["late"], *local,
        ])
        found = topics.parse_matrices(spark.read.schema(schemas.TOPIC).parquet(d["mid"]))
        start = F.unix_millis("timewindow.start")
        rows = found.select(((start - SITE.origin_ms) / 10_000).cast("int").alias("w"), "matrix").collect()
        return {r.w: r.matrix for r in rows}

    end_ms = SITE.origin_ms + SECONDS * 1000 - 1
    jobs.transmit(points, SITE.origin_ms, end_ms, "parquet", d["in"], 40_000, 2, d["cp0"])
    out = aggregated()
    silent = [[[60]] * SITE.sections] * 5
    assert sorted(out) == list(range(SECONDS // 10 - 2))
    assert [w for w in sorted(out) if out[w] == silent] == [4, 5, 6]
    assert LateRows(spark, d["late"]).dropped().count() == 0

    late = topics.frames_to_messages(points.filter(F.col("global_time") < SITE.origin_ms + 1_000))
    late.select("key", "value").write.mode("append").parquet(d["in"])
    assert aggregated() == out
    assert LateRows(spark, d["late"]).dropped().head().dropped > 0
