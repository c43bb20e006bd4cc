import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from laneflow import schemas
from laneflow.config import SiteConfig
from laneflow.operators import aggregate
from laneflow.sources import increments

SITE = SiteConfig()
DAY = increments.DAY_MS
POINTS = (
    "location string, distance double, lane_id int, elapsed_time long, v_vel decimal(18,6), v_acc decimal(18,6)"
)


def points(days, n, seed):
    rng = random.Random(seed)
    return [
        (
            rng.choice(["us-101", "us-101", "i-80", None, ""]),
            rng.uniform(0, 500),
            rng.choice([1, 2]),
            None if rng.random() < 0.05 else rng.choice(days) * DAY + rng.randrange(3) * 100,
            None if rng.random() < 0.1 else round(rng.uniform(0, 80), 2),
            round(rng.uniform(-5, 5), 2),
        )
        for _ in range(n)
    ]


def frame(spark, rows):
    text = POINTS.replace("decimal(18,6)", "double")
    exact = {c: F.col(c).cast("decimal(18,6)") for c in ("v_vel", "v_acc")}
    return spark.createDataFrame(rows, text).withColumns(exact)


def counted(df):
    fields = [F.col(f.name).cast(f.dataType) for f in schemas.SECTION_AGG]
    return Counter(tuple(r) for r in df.select(*fields).collect())


@pytest.fixture
def batches():
    return points([0, 1, 2], 300, 1), points([1, 2, 3], 200, 2)  # late points of days 1 and 2


def full(spark, rows):
    return counted(aggregate.section_agg(frame(spark, rows), SITE))


def test_batches_give_what_a_full_run_gives(spark, tmp_path, batches):
    first, second = batches
    root = str(tmp_path / "table")
    assert counted(increments.absorb(frame(spark, first), root, "1", SITE)) == full(spark, first)
    assert counted(increments.absorb(frame(spark, second), root, "2", SITE)) == full(spark, first + second)
    assert counted(increments.absorb(frame(spark, second), root, "2", SITE)) == full(spark, first + second)


def test_a_corrected_batch_replaces_its_days(spark, tmp_path, batches):
    first, second = batches
    root = str(tmp_path / "table")
    increments.absorb(frame(spark, first), root, "1", SITE)
    increments.absorb(frame(spark, second), root, "2", SITE)
    corrected = [p for p in second if p[3] is not None and p[3] < 2 * DAY]  # day 3 is gone altogether
    out = increments.absorb(frame(spark, corrected), root, "2", SITE)
    assert counted(out) == full(spark, first + corrected)
    assert counted(increments.absorb(frame(spark, []), root, "2", SITE)) == full(spark, first)


def test_other_days_are_not_rewritten(spark, tmp_path, batches):
    root = tmp_path / "table"
    increments.absorb(frame(spark, batches[0]), str(root), "1", SITE)
    before = {f: f.stat().st_mtime_ns for f in (root / "sections" / "day=0").iterdir()}
    increments.absorb(frame(spark, [p for p in batches[1] if p[3] is not None]), str(root), "2", SITE)
    assert before == {f: f.stat().st_mtime_ns for f in (root / "sections" / "day=0").iterdir()}


def test_a_run_that_failed_half_way_leaves_its_days_to_the_next(spark, tmp_path, batches, monkeypatch):
    first, second = batches
    root = str(tmp_path / "table")
    increments.absorb(frame(spark, first), root, "1", SITE)
    increments.absorb(frame(spark, second), root, "2", SITE)
    corrected = [p for p in second if p[3] is not None and p[3] < 2 * DAY]
    with monkeypatch.context() as broken:
        broken.setattr(increments, "section_means", lambda sums: 1 / 0)
        with pytest.raises(ZeroDivisionError):
            increments.absorb(frame(spark, corrected), root, "2", SITE)
    out = increments.absorb(frame(spark, corrected), root, "2", SITE)
    assert counted(out) == full(spark, first + corrected)
