"""Topics of key/value messages: encoding, decoding, stream sources and sinks.

``fmt`` is always a parameter. With ``kafka`` the options name brokers and topic; file formats
stand in for a broker elsewhere, one folder per topic.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import ArrayType, DataType

from laneflow import schemas


def kafka_source_options(servers: str, topic: str) -> dict[str, str]:
    return {
        "kafka.bootstrap.servers": servers,
        "subscribe": topic,
        "startingOffsets": "earliest",
    }


def kafka_sink_options(servers: str, topic: str) -> dict[str, str]:
    return {"kafka.bootstrap.servers": servers, "topic": topic}


def read_stream(
    spark: SparkSession, fmt: str, path: str | None = None, **options: str
) -> DataFrame:
    """Messages of a topic as they arrive; file formats get the declared schema.

    A folder topic may hold folders, as an ordered publisher writes them, beside files.
    """
    reader = spark.readStream.format(fmt)
    if fmt != "kafka":
        reader = reader.schema(schemas.TOPIC).option("recursiveFileLookup", "true")
    reader = reader.options(**options)
    return reader.load(path) if path else reader.load()


def write_stream(
    df: DataFrame,
    fmt: str,
    checkpoint: str,
    path: str | None = None,
    name: str | None = None,
    trigger: dict | None = None,
    mode: str = "append",
    **options: str,
) -> StreamingQuery:
    """Start a checkpointed query; ``trigger`` takes the keywords of ``DataStreamWriter.trigger``."""
    writer = (
        df.writeStream.format(fmt)
        .outputMode(mode)
        .option("checkpointLocation", checkpoint)
        .options(**options)
    )
    if name:
        writer = writer.queryName(name)
    if trigger:
        writer = writer.trigger(**trigger)
    return writer.start(path) if path else writer.start()


def late_rows(query: StreamingQuery) -> int:
    """Rows the query has dropped because they came behind the watermark."""
    return sum(
        operator["numRowsDroppedByWatermark"]
        for progress in query.recentProgress
        for operator in progress["stateOperators"]
    )


def frames_to_messages(
    points: DataFrame, frames: DataFrame | None = None, parts: int = 1
) -> DataFrame:
    """Encode points as frame messages: a JSON array of the points of one site and ``global_time``.

    Every frame is dealt to ``parts`` messages by the hash of its points (fewer if it has fewer), a
    choice of the job and not of the data; a consumer unfolds them to the same rows. Equal points are
    counted before the shuffle and their copies dealt out evenly, so copies cost one row per task.
    ``frames`` (see :func:`frame_clock`) adds an empty array for each silent frame; frames off that
    grid are sent as well. Points without a ``global_time`` belong to no frame and aren't sent.
    """
    wire = [f.name for f in schemas.frame_point()]
    present = {c.lower() for c in points.columns}
    columns = [(F.col(c) if c.lower() in present else F.lit(None)).alias(c) for c in wire]
    sent = points.select(F.struct(*columns).alias("_point")).filter("_point.Global_Time is not null")
    counted = sent.groupBy("_point").agg(F.count(F.lit(1)).alias("_copies"))
    dealt = counted.select(
        "_point",
        "_copies",
        F.explode(F.sequence(F.lit(0), F.least("_copies", F.lit(parts)).cast("int") - 1)).alias("_turn"),
    )
    each = F.floor(F.col("_copies") / F.lit(parts)) + (
        F.col("_turn") < F.col("_copies") % F.lit(parts)
    ).cast("int")
    own = F.pmod(F.xxhash64("_point"), F.lit(parts))
    part = ((own + F.col("_turn")) % F.lit(parts)).cast("int")
    messages = (
        dealt.groupBy(
            F.col("_point.Location").alias("location"),
            F.col("_point.Global_Time").alias("global_time"),
            part.alias("part"),
        )
        .agg(F.flatten(F.collect_list(F.array_repeat("_point", each.cast("int")))).alias("points"))
        .select("location", "global_time", "part", F.to_json("points").alias("value"))
    )
    if frames is not None:
        messages = frames.select("global_time").join(messages, "global_time", "full")
    key = F.struct("location", "global_time", F.coalesce("part", F.lit(0)).alias("part"))
    return messages.select(
        "global_time", F.to_json(key).alias("key"), F.coalesce("value", F.lit("[]")).alias("value")
    )


def frame_clock(spark: SparkSession, start_ms: int, end_ms: int, step_ms: int = 100) -> DataFrame:
    """Every frame time from ``start_ms`` to ``end_ms``, both included."""
    return spark.range(start_ms, end_ms + 1, step_ms).select(F.col("id").alias("global_time"))


def parse_frames(messages: DataFrame, speed: DataType | None = None) -> DataFrame:
    """Unfold frame messages to points; malformed, empty and NULL payloads yield no rows."""
    schema = schemas.frame_point(speed)
    points = messages.select(
        F.inline(F.from_json(F.col("value").cast("string"), ArrayType(schema)))
    )
    return points.select(*[F.col(f.name).alias(f.name.lower()) for f in schema]).withColumnRenamed(
        "elapsedtime", "elapsed_time"
    )


def encode_matrices(matrices: DataFrame) -> DataFrame:
    """Window matrices as messages: the window (and its site) as key, the matrix as value."""
    return matrices.select(
        F.to_json(F.struct("location", "timewindow")).alias("key"),
        F.to_json("matrix").alias("value"),
    )


def parse_matrices(messages: DataFrame) -> DataFrame:
    key: Column = F.from_json(F.col("key").cast("string"), schemas.WINDOW_KEY)
    value: Column = F.from_json(F.col("value").cast("string"), schemas.VELOCITY_MATRIX)
    return messages.select(key.alias("key"), value.alias("matrix")).select(
        "key.location", "key.timewindow", "matrix"
    )
