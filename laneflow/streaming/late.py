"""Rows that streams drop behind their watermark, counted over the streams' whole lives."""

from __future__ import annotations

import threading
from collections import defaultdict

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery, StreamingQueryListener

DROPS = "query string, batch long, dropped long"


class LateRows(StreamingQueryListener):
    """Keeps a table of dropped rows by query and micro-batch.

    A query's recent progress forgets all but its last reports, and a restart begins a new one. This
    listener hears every report and appends those with drops to ``path``, under the id that a query
    keeps in its checkpoint. A micro-batch that is run again after a failure counts once.

    Spark counts rows as they reach a stateful operator: behind an aggregate's map-side part, so
    partial rows; in front of a de-duplication the messages themselves.
    """

    def __init__(self, spark: SparkSession, path: str):
        self.spark, self.path = spark, path
        self._ended: dict[str, threading.Event] = defaultdict(threading.Event)

    def __enter__(self) -> LateRows:
        self.spark.streams.addListener(self)
        return self

    def __exit__(self, *_) -> None:
        self.spark.streams.removeListener(self)

    def onQueryStarted(self, event) -> None:
        pass

    def onQueryProgress(self, event) -> None:
        told = event.progress
        dropped = sum(o.numRowsDroppedByWatermark for o in told.stateOperators)
        if dropped:
            row = self.spark.createDataFrame([(str(told.id), told.batchId, dropped)], DROPS)
            row.coalesce(1).write.mode("append").json(self.path)

    def onQueryIdle(self, event) -> None:
        pass

    def onQueryTerminated(self, event) -> None:
        self._ended[str(event.runId)].set()

    def settled(self, query: StreamingQuery, seconds: float = 60) -> None:
        """Wait until the reports of a run that has ended are all in: they come in order, but later."""
        if not self._ended[str(query.runId)].wait(seconds):
            raise TimeoutError(f"no report of the end of {query.runId}")

    def dropped(self) -> DataFrame:
        """Dropped rows of each query that has dropped any: ``query``, ``batches``, ``dropped``."""
        try:
            found = self.spark.read.schema(DROPS).json(self.path)
        except AnalysisException:
            found = self.spark.createDataFrame([], DROPS)
        once = found.groupBy("query", "batch").agg(F.max("dropped").alias("dropped"))
        return once.groupBy("query").agg(
            F.count(F.lit(1)).alias("batches"), F.sum("dropped").alias("dropped")
        )
