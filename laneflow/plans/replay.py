"""Replays of a bounded table through the streaming jobs."""

from __future__ import annotations

from contextlib import nullcontext

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from laneflow.session import fresh_path, state_width, timer_state
from laneflow.sources import topics

UNTIL_DONE = {"availableNow": True}


def publish(messages: DataFrame, path: str) -> None:
    """Append messages to a file topic."""
    messages.select("key", "value").write.mode("append").parquet(path)


def run_to_end(
    stream: DataFrame, checkpoint: str, path: str, fmt: str = "parquet", timers: bool = False
) -> StreamingQuery:
    """Process everything that has arrived, then stop; state stays in the checkpoint."""
    spark = stream.sparkSession
    with timer_state(spark) if timers else nullcontext(), state_width(spark, spark.sparkContext.defaultParallelism):
        query = topics.write_stream(stream, fmt, checkpoint, path=path, trigger=UNTIL_DONE)
    query.awaitTermination()
    return query


class Replay:
    """One streaming query over one file topic, run once per published slice.

    ``options`` are the topic's source options; ``timers``: the query has timers.
    """

    def __init__(
        self, spark: SparkSession, name: str, build, topic: str | None = None, timers: bool = False, **options: str
    ):
        self.spark = spark
        self.build = build
        self.timers, self.options = timers, options
        self.topic = topic or fresh_path(spark, f"{name}-topic")
        self.checkpoint = fresh_path(spark, f"{name}-checkpoint")
        self.sink = fresh_path(spark, f"{name}-sink")

    def run(self, messages: DataFrame | None = None) -> Replay:
        if messages is not None:
            publish(messages, self.topic)
        stream = self.build(topics.read_stream(self.spark, "parquet", self.topic, **self.options))
        self.schema = stream.schema
        self.query = run_to_end(stream, self.checkpoint, self.sink, timers=self.timers)
        self.late_rows = topics.late_rows(self.query)
        return self

    def result(self) -> DataFrame:
        return self.spark.read.schema(self.schema).parquet(self.sink)
