"""Session settings the operators rely on, and the shared folder for written intermediates."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Iterator
from contextlib import contextmanager
from functools import lru_cache

from pyspark.sql import DataFrame, SparkSession

CHECKPOINT_DIR = "spark.checkpoint.dir"
SHUFFLE_WIDTH = "spark.sql.shuffle.partitions"
BATCH_WIDTH = "spark.sql.adaptive.coalescePartitions.initialPartitionNum"
PARTITION_BYTES = 128 << 20
STATE_STORE = "spark.sql.streaming.stateStore.providerClass"
#: State on local disk; batches upload what they have changed instead of whole snapshots.
ROCKSDB = {
    STATE_STORE: "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider",
    "spark.sql.streaming.stateStore.rocksdb.changelogCheckpointing.enabled": "true",
}


def pin(spark: SparkSession) -> SparkSession:
    """Run the session in UTC: local wall clocks are always derived with an explicit zone."""
    spark.conf.set("spark.sql.session.timeZone", "UTC")
    return spark


def cluster_conf(executors: int, cores: int, largest_shuffle: int = 0) -> dict[str, str]:
    """Settings to start a session of ``executors`` x ``cores`` with.

    Stateful streaming operators fix their partition count on the first batch and AQE leaves it
    alone, so their width fits the cluster from the start. Batch stages begin with as many
    partitions as the ``largest_shuffle`` in bytes needs at the advisory size (AQE merges
    partitions, but doesn't split those of an aggregate), and with the streams' width at least.
    """
    width = 2 * executors * cores
    return {
        "spark.sql.session.timeZone": "UTC",
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.advisoryPartitionSizeInBytes": str(PARTITION_BYTES),
        SHUFFLE_WIDTH: str(width),
        BATCH_WIDTH: str(max(width, -(-largest_shuffle // PARTITION_BYTES))),
        "spark.sql.files.maxPartitionBytes": "256m",
        **ROCKSDB,
    }


def shared_folder(spark: SparkSession) -> str:
    """The cluster's shared folder; a temporary one only in local mode with none configured."""
    root = spark.conf.get(CHECKPOINT_DIR, None) or spark.sparkContext.getConf().get(CHECKPOINT_DIR)
    if root:
        return root.rstrip("/")
    if not spark.sparkContext.master.startswith("local"):
        raise ValueError(f"set {CHECKPOINT_DIR} to a folder every executor can reach")
    return _local_folder(spark.sparkContext.applicationId)


@lru_cache
def _local_folder(application_id: str) -> str:
    return tempfile.mkdtemp(prefix=f"laneflow-{application_id}-")


def fresh_path(spark: SparkSession, name: str) -> str:
    """A path in the shared folder that no earlier run has written."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


_written: list[tuple[str, DataFrame]] = []


def materialize(df: DataFrame, name: str, path: str | None = None) -> DataFrame:
    """Write ``df`` once and go on from the written table.

    Cuts the lineage before a plan reads ``df`` several times: a lost executor costs a re-read of
    the table, not a second scan of the raw points. ``release`` frees what was written without a
    ``path`` of its own.
    """
    spark = df.sparkSession
    target = path or fresh_path(spark, name)
    df.write.mode("overwrite").parquet(target)
    out = spark.read.schema(df.schema).parquet(target)
    if path is None:
        _written.append((target, out))
    return out


def release(spark: SparkSession) -> int:
    """Empty the intermediates written so far; call it when no result that reads them is needed."""
    return discard(*[df for _, df in _written if df.sparkSession is spark])


def discard(*tables: DataFrame) -> int:
    """Empty these intermediates, as ``materialize`` returned them, once what was made of them is written too.

    Replaces each by a table without rows, which any store that Spark can write to supports.
    """
    mine = [x for x in _written if any(x[1] is df for df in tables)]
    for path, df in mine:
        df.sparkSession.createDataFrame([], df.schema).coalesce(1).write.mode("overwrite").parquet(path)
        _written[:] = [x for x in _written if x[1] is not df]
    return len(mine)


@contextmanager
def state_width(spark: SparkSession, width: int | None) -> Iterator[None]:
    """Start a streaming query in here to give its state ``width`` partitions; None: as it is.

    AQE does not coalesce stateful stages.
    """
    chosen = spark.conf.get(SHUFFLE_WIDTH)
    if width is not None:
        spark.conf.set(SHUFFLE_WIDTH, str(width))
    try:
        yield
    finally:
        spark.conf.set(SHUFFLE_WIDTH, chosen)


@contextmanager
def timer_state(spark: SparkSession) -> Iterator[None]:
    """Start a streaming query with timers in here: they need the RocksDB state store."""
    chosen = {name: spark.conf.get(name, None) for name in ROCKSDB}
    for name, value in ROCKSDB.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in chosen.items():
            spark.conf.unset(name) if value is None else spark.conf.set(name, value)
