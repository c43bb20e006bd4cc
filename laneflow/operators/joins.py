"""Joins by keys that may be NULL: rows without a site are a site of their own."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def join_by(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str = "inner") -> DataFrame:
    """Equi-join in which NULL equals NULL: a struct of NULLs isn't NULL. The keys are those of ``left``."""
    rest = [c for c in right.columns if c not in keys]
    other = right.select(F.struct(*keys).alias("_keys"), *rest)
    return left.withColumn("_keys", F.struct(*keys)).join(other, "_keys", how).drop("_keys")
