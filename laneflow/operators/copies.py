"""Counts of equal rows: split them into blocks and unfold them."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def copy_blocks(df: DataFrame, copies: str, block: int) -> DataFrame:
    """Split a count of equal rows into rows of at most ``block`` copies (``_block`` numbers them)."""
    last = F.floor((F.col(copies) - 1) / F.lit(block))
    out = df.withColumn("_block", F.explode(F.sequence(F.lit(0).cast("bigint"), last)))
    left = F.col(copies) - F.col("_block") * F.lit(block)
    return out.withColumn(copies, F.least(left, F.lit(block).cast("bigint")))


def expand_copies(df: DataFrame, copies: str, block: int = 1 << 16) -> DataFrame:
    """Every row ``copies`` times. Blocks of copies are spread over tasks before they unfold."""
    blocks = copy_blocks(df, copies, block)
    spread = blocks.repartition(*[c for c in blocks.columns if c != copies])
    repeats = F.sequence(F.lit(1).cast("bigint"), F.col(copies))
    return spread.withColumn("_repeat", F.explode(repeats)).drop("_repeat", "_block", copies)
