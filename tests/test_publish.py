import time

import pytest
from pyspark.sql import functions as F

from laneflow.streaming.publish import OrderedPublisher, Slices

SCHEMA = "global_time long, key string, value string"


@pytest.fixture(scope="module")
def messages(spark, tmp_path_factory):
    """A message per 100 ms over 20 seconds, each twice, some without a time."""
    path = str(tmp_path_factory.mktemp("messages") / "table")
    rows = [(1_000 + t * 100, str(t), f"v{t}-{n}") for t in range(200) for n in range(2)] + [(None, "x", "x")]
    df = spark.createDataFrame(rows, SCHEMA).repartitionByRange("global_time").sortWithinPartitions("global_time")
    df.write.parquet(path)
    return spark.read.schema(SCHEMA).parquet(path)


def topic(spark, path):
    rows = spark.read.parquet(path).select("*", "_metadata.file_modification_time").collect()
    return [(r.slice, int(r.key), r.value, r.file_modification_time) for r in rows]


def assert_whole(rows, first=0, last=199, per=20):
    assert sorted((k, v) for _, k, v, _ in rows) == sorted((t, f"v{t}-{n}") for t in range(first, last + 1) for n in range(2))
    assert all(s == (k - first) // per for s, k, _, _ in rows)
    by_slice = {}
    for s, _, _, at in rows:
        by_slice.setdefault(s, []).append(at)
    order = sorted(by_slice)
    assert all(max(by_slice[a]) <= min(by_slice[b]) for a, b in zip(order, order[1:]))


def test_slices():
    slices = Slices(1_000, 5_499, 2_000)
    assert [slices.bounds(n) for n in range(len(slices))] == [(1_000, 2_999), (3_000, 4_999), (5_000, 5_499)]
    assert len(Slices(7, 7, 10)) == 1 and len(Slices(0, 19, 10)) == 2 and len(Slices(0, 20, 10)) == 3
    for wrong in ((5, 4, 10), (0, 10, 0)):
        with pytest.raises(ValueError):
            Slices(*wrong)


def test_slices_arrive_in_order(spark, messages, tmp_path):
    out = str(tmp_path / "topic")
    OrderedPublisher(messages, Slices(1_000, 20_999, 2_000), "parquet", str(tmp_path / "cp"), out).run()
    assert_whole(topic(spark, out))


def test_a_stopped_query_goes_on(spark, messages, tmp_path):
    out, checkpoint = str(tmp_path / "topic"), str(tmp_path / "cp")
    publisher = OrderedPublisher(messages, Slices(1_000, 20_999, 2_000), "parquet", checkpoint, out)
    query = publisher.start({"processingTime": "500 milliseconds"})
    while query.lastProgress is None or query.lastProgress.batchId < 2:
        time.sleep(0.05)
    query.stop()
    before = {(s, at) for s, _, _, at in topic(spark, out)}
    assert {s for s, _ in before} < set(range(10))
    # Another process: the table and the range are given anew.
    OrderedPublisher(messages, Slices(1_000, 20_999, 2_000), "parquet", checkpoint, out).run()
    rows = topic(spark, out)
    assert_whole(rows)
    first_three = {(s, at) for s, at in before if s < 3}
    assert first_three <= {(s, at) for s, _, _, at in rows}  # committed slices aren't sent again


def test_a_finished_one_publishes_nothing_more(spark, messages, tmp_path):
    out, checkpoint = str(tmp_path / "topic"), str(tmp_path / "cp")
    publisher = OrderedPublisher(messages, Slices(1_000, 20_999, 5_000), "parquet", checkpoint, out)
    publisher.run()
    before = sorted(topic(spark, out))
    publisher.run()
    assert sorted(topic(spark, out)) == before


def test_an_error_reaches_the_caller(spark, messages, tmp_path):
    publisher = OrderedPublisher(messages, Slices(1_000, 2_000, 500), "no-such-format", str(tmp_path / "cp"), "x")
    with pytest.raises(Exception, match="no-such-format"):
        publisher.run()


def test_a_slice_reads_its_own_range(spark, messages):
    part = messages.filter(F.col("global_time").between(*Slices(1_000, 20_999, 2_000).bounds(3)))
    plan = part._jdf.queryExecution().executedPlan().toString()
    assert "GreaterThanOrEqual(global_time,7000)" in plan and "LessThanOrEqual(global_time,8999)" in plan
