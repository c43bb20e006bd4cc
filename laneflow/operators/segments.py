"""Vehicle trajectories as line segments."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from laneflow.operators.copies import expand_copies

POINT = ("elapsed_time", "distance", "v_vel")


def trajectory_segments(
    df: DataFrame, keys: tuple[str, ...] = ("location", "vehicle_id"), bucket_ms: int = 600_000
) -> DataFrame:
    """Consecutive points of a vehicle joined to segments (t0, d0) -> (t1, d1) with the first speed.

    No vehicle is sorted in one task: points are ordered per time bucket, and the last point of a
    bucket takes the first point of the vehicle's next one from a table of bucket heads. Equal
    points are counted before the shuffle and come back as segments of no length.

    NULL keys are keys of their own; points without a time come first. The heads and the points
    read one repartitioning, so Spark scans the points once and reuses that exchange.
    """
    # A struct is never NULL, and structs with NULL fields are equal: no point drops out of the join.
    bucket = F.floor(F.col("elapsed_time") / F.lit(bucket_ms)).alias("bucket")
    points = (
        df.select(F.struct(*keys, bucket).alias("_at"), *POINT)
        .groupBy("_at", *POINT)
        .agg(F.count(F.lit(1)).alias("_copies"))
        .repartition("_at")
    )
    point = F.struct(*POINT)
    within = Window.partitionBy("_at").orderBy(*POINT)
    vehicle = Window.partitionBy(*[f"_at.{k}" for k in keys]).orderBy("_at.bucket")
    heads = (
        points.withColumn("_rank", F.row_number().over(within))
        .filter(F.col("_rank") == 1)
        .select("_at", F.lead(point).over(vehicle).alias("_next_head"))
    )
    onward = (
        points.withColumn("_next", F.lead(point).over(within))
        .join(heads, "_at")
        .select("_at", *POINT, F.coalesce("_next", "_next_head").alias("_end"))
        .filter(F.col("_end").isNotNull())
    )
    extra = points.withColumn("_copies", F.col("_copies") - 1).filter(F.col("_copies") > 0)
    again = expand_copies(extra, "_copies").withColumn("_end", point)

    columns = (
        *[F.col(f"_at.{k}").alias(k) for k in keys],
        F.col("elapsed_time").alias("t0"),
        F.col("distance").alias("d0"),
        F.col("_end.elapsed_time").alias("t1"),
        F.col("_end.distance").alias("d1"),
        F.col("v_vel"),
    )
    return onward.select(*columns).unionByName(again.select(*columns))
