"""Embedding whitening on distributed block matrices.

Vectors are taken as whole multiples of 1 / ``scale``. The distinct ones are the fit list; its count and
sums are exact. The centred rows of the fit list are dealt to blocks of a ``BlockMatrix``, whose transpose
times itself is the scatter matrix: blocks of one middle range meet in a task and the products are added
up. The scatter is as large as the dimension only, so its eigenvectors are found on the driver; divided by
the roots of the eigenvalues they are the whitening matrix, by which a second product multiplies the
centred blocks of all rows. Rows keep their number throughout, so results are joined by a unique key.
"""

from __future__ import annotations

from decimal import Decimal

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import Column, DataFrame, SparkSession

from laneflow.llm import shared
from laneflow.llm.shared import F

SCALE = 256
COMPONENTS = 4
#: Rows and columns of a block at most.
ROWS, COLUMNS = 4096, 1024
#: Blocks of the fit list that meet in one task of the scatter's product.
TOGETHER = 16
#: Share of the trace that a component has at least; those below have no variance beyond rounding.
FLAT = 1e-12


def whole(vector: str, scale: int) -> Column:
    """Entries as whole multiples of 1 / ``scale``, rounded down."""
    return F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))


def usable(rows: DataFrame, vector: str) -> DataFrame:
    """Rows whose vector has entries, none of them null or not finite, and the most frequent length."""
    finite = F.forall(vector, lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) != F.lit(float("inf"))))
    whole_rows = rows.filter(F.col(vector).isNotNull() & (F.size(vector) > 0)).filter(finite)
    lengths = whole_rows.groupBy(F.size(vector).alias("size")).agg(F.count("*").alias("n"))
    most = lengths.orderBy(F.desc("n"), F.desc("size")).first()
    return whole_rows.filter(F.size(vector) == (most.size if most else 0))


def dimension_sums(fit: DataFrame) -> list[int]:
    """Exact sums of the entries of ``x``, added up per batch first; halves of 32 bits never overflow."""

    def add_up(part: pa.RecordBatch) -> pa.RecordBatch:
        x = part.column("x").flatten().to_numpy().reshape(part.num_rows, -1)
        high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
        return pa.RecordBatch.from_arrays(
            [pa.array(range(len(high)), pa.int32()), pa.array(high), pa.array(low)], ["at", "high", "low"]
        )

    sums = shared.per_batch(fit.select("x"), add_up, "at int, high long, low long")
    exact = [F.sum(F.col(c).cast("decimal(38,0)")).alias(c) for c in ("high", "low")]
    found = sums.groupBy("at").agg(*exact).collect()  # a row a dimension
    return [(int(r.high) << 32) + int(r.low) for r in sorted(found)]


def blocks(rows: DataFrame, height: int, width: int, n: int) -> BlockMatrix:
    """``number, vector`` (an array) as a matrix of ``n`` rows in blocks."""
    vectors = rows.select(F.col("number").alias("index"), array_to_vector("vector").alias("vector"))
    old = MLUtils.convertVectorColumnsFromML(vectors, "vector")
    return IndexedRowMatrix(old, numRows=n).toBlockMatrix(height, width)


def product(left: BlockMatrix, right: BlockMatrix, splits: int) -> BlockMatrix:
    """``left`` times ``right``, the blocks between them dealt to ``splits`` tasks for each block of the result."""
    found = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, splits)
    return BlockMatrix(found, left.rowsPerBlock, right.colsPerBlock)


def row_arrays(matrix: BlockMatrix) -> DataFrame:
    """``number, vector`` of every row."""
    indexed = matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model
    return callMLlibFunc("getIndexedRows", indexed).select(
        F.col("index").alias("number"), vector_to_array("vector").alias("vector")
    )


def centred(rows: DataFrame, mean: list[float]) -> DataFrame:
    vector = F.zip_with("x", F.array(*map(F.lit, mean)), lambda x, m: x - m)
    return rows.select("number", vector.alias("vector"))


def scatter(fit: DataFrame, n: int, mean: list[float]) -> np.ndarray:
    """Sums of products of the centred entries over the fit list; ``number`` counts it without gaps."""
    matrix = blocks(centred(fit, mean), ROWS, min(COLUMNS, len(mean)), n)
    return product(matrix.transpose(), matrix, -(-n // (ROWS * TOGETHER))).toLocalMatrix().toArray()


def components_of(covariance: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray]:
    """Largest eigenvalues and their unit eigenvectors (columns), those without variance left out."""
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    order = order[values[order] > FLAT * max(np.trace(covariance), 0)]
    return values[order], vectors[:, order]


def whitened(
    rows: DataFrame, key: str, vector: str, components: int = COMPONENTS, scale: int = SCALE
) -> DataFrame:
    """``key, component, n, deviation, whitened, explained, identity_error`` of every usable row.

    Left out are rows whose vector is null or empty or has null or non-finite entries, and those of another
    length than most rows have (of equally many the longest). Repeated rows and equal or null keys stay;
    each distinct vector counts once in the fit. Components without variance, all of them where there
    are less than two distinct vectors, give no rows. An empty table gives none. ``deviation`` is null
    where it doesn't fit a long. Extra columns are ignored.
    """
    spark = rows.sparkSession
    named = rows.select(F.col(key).alias("key"), F.col(vector).alias("v"))
    kept = usable(named, "v").select("key", whole("v", scale).alias("x"))
    held = shared.materialize(shared.numbered(kept, [], "whitening-order"), "whitening-rows")
    # Copies of one vector are collapsed per task before the shuffle; its first row stands for all.
    fit = shared.numbered(held.groupBy("x").agg(F.min("number").alias("first")), [], "whitening-fit")
    n, total = fit.count(), held.count()
    schema = f"{key} {named.schema['key'].dataType.simpleString()}, component int, n long, deviation long, "
    schema += "whitened double, explained double, identity_error double"
    if not n:
        return spark.createDataFrame([], schema)
    sums = dimension_sums(fit)
    mean = [s / n for s in sums]
    covariance = scatter(fit, n, mean) / n
    values, vectors = components_of(covariance, components)
    if not len(values):
        return spark.createDataFrame([], schema)
    matrix = vectors / np.sqrt(values)
    width = min(COLUMNS, len(mean))
    turned = spark.createDataFrame([(i, row.tolist()) for i, row in enumerate(matrix)], "number long, vector array<double>")
    projector = blocks(turned, width, len(values), len(mean))
    projected = product(blocks(centred(held, mean), ROWS, width, total), projector, 1)
    placed = shared.materialize(row_arrays(projected), "whitening-projected")
    # The covariance of what came out, over the fit list.
    of_fit = placed.join(fit.select(F.col("first").alias("number")), "number", "left_semi")
    pairs = [(i, j) for i in range(len(values)) for j in range(i + 1)]
    found = of_fit.agg(*(F.covar_pop(F.col("vector")[i], F.col("vector")[j]).alias(f"c{i}_{j}") for i, j in pairs)).first()
    error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    totals = F.array(*(F.lit(Decimal(s)).try_cast("long") for s in sums))
    steps = F.zip_with("x", totals, lambda x, s: F.try_subtract(F.try_multiply(F.lit(n).cast("long"), x), s))
    deviation = F.aggregate(steps, F.lit(0).cast("long"), lambda a, d: F.try_add(a, F.try_multiply(d, d)))
    explained = F.array(*map(F.lit, (values / np.trace(covariance)).tolist()))
    return (
        held.join(placed, "number")
        .select("key", deviation.alias("deviation"), F.posexplode("vector").alias("at", "whitened"))
        .select(
            F.col("key").alias(key),
            (F.col("at") + 1).alias("component"),
            F.lit(n).cast("long").alias("n"),
            "deviation",
            "whitened",
            F.get(explained, "at").alias("explained"),
            F.lit(float(error)).alias("identity_error"),
        )
    )


def op12_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first four whitened components of all ``embeddings``."""
    return whitened(shared.table(spark, sf_dir, "embeddings"), "vec_id", "embedding")
