"""Messages published in order of time by one query."""

from __future__ import annotations

import threading
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


@dataclass(frozen=True)
class Slices:
    """``[start_ms, end_ms]`` cut into pieces of ``millis``; the last one may be shorter."""

    start_ms: int
    end_ms: int
    millis: int = 10_000

    def __post_init__(self) -> None:
        if self.millis < 1 or self.end_ms < self.start_ms:
            raise ValueError("a slice must be at least 1 ms long and the range must not be empty")

    def __len__(self) -> int:
        return -(-(self.end_ms + 1 - self.start_ms) // self.millis)

    def bounds(self, number: int) -> tuple[int, int]:
        """First and last millisecond of a slice."""
        first = self.start_ms + number * self.millis
        return first, min(first + self.millis - 1, self.end_ms)


class OrderedPublisher:
    """Publishes slice after slice of a table of messages, one per micro-batch.

    A clock source gives a row per batch, so the number of a batch is the number of its slice, and a
    restart from the checkpoint goes on with the slice that wasn't committed. ``messages`` should lie in
    order of time: each batch reads its own range of them by the statistics of the files.

    ``trigger`` paces the replay (``{"processingTime": "10 seconds"}`` with slices of 10 s is real
    time), without one slices follow each other at once. A slice whose batch failed is published
    again, to a broker a second time; in a folder it replaces its former ``slice=N``. The range
    belongs to the checkpoint: publish another one from a checkpoint of its own.
    """

    def __init__(
        self, messages: DataFrame, slices: Slices, fmt: str, checkpoint: str, path: str | None = None, **options: str
    ):
        self.messages, self.slices, self.fmt, self.checkpoint = messages, slices, fmt, checkpoint
        self.path, self.options = path, options
        self._done = threading.Event()

    def start(self, trigger: dict | None = None) -> StreamingQuery:
        spark = self.messages.sparkSession
        clock = spark.readStream.format("rate-micro-batch").option("rowsPerBatch", 1).option("numPartitions", 1).load()
        writer = clock.writeStream.foreachBatch(self._publish).option("checkpointLocation", self.checkpoint)
        self._done.clear()
        return (writer.trigger(**trigger) if trigger else writer).start()

    def run(self, trigger: dict | None = None) -> None:
        """Publish everything that is left, then stop."""
        query = self.start(trigger)
        while not self._done.wait(0.1):
            if not query.isActive:
                raise query.exception() or RuntimeError("stopped before the last slice was published")
        query.stop()

    def _publish(self, _: DataFrame, number: int) -> None:
        if number >= len(self.slices):  # the batch of the last slice is committed
            self._done.set()
            return
        part = self.messages.filter(F.col("global_time").between(*self.slices.bounds(number)))
        writer = part.select("key", "value").write.format(self.fmt).options(**self.options)
        if self.path:
            writer.mode("overwrite").save(f"{self.path}/slice={number}")
        else:
            writer.mode("append").save()
