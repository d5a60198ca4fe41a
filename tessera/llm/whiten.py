"""Embedding whitening on MLlib's distributed block matrices.

Each vector component c becomes the integer x = floor(64 c) + 1,000,000.
Centred rows, indexed, form a BlockMatrix X; X^T X / n is the covariance V,
added up block by block on the executors.  Its eigenvectors (a dimension by
dimension matrix, solved on the driver) over the roots of their eigenvalues
are the whitening matrix W, and the BlockMatrix product X W projects the rows.
The covariance of the projected rows, a BlockMatrix product again, is held
against the identity.

On Spark: rows are numbered where they lie (offsets of partitions, no
exchange) and written; sums are exact integers; centring is (n x - S) / n with
an exact numerator, so large offsets cost no digits.  A product adds up
``mid_splits`` parts of its inner dimension apart, so no task takes all
blocks of X though the result is a single block.  What the driver gets are
sums and matrices of the vectors' dimension, not of their number.

Edge cases: vectors that are NULL, empty or hold NULL, NaN or infinite
components take no part; other rows all do, rows without an id and repeated
ones too; vectors of each dimension are fitted apart (n and the figures are
those of their dimension); a component without variance (eigenvalue not above
1e-12 of the largest) has whitened NULL and does not count in the identity; if
there is none with variance, explained and identity_error are NULL; a
deviation beyond a long is NULL; fewer dimensions than components give as many
as there are; no vectors give no rows; other columns are ignored.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
from pyspark import StorageLevel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from tessera.llm.common import written

ROWS_PER_BLOCK = 1024
COLS_PER_BLOCK = 1024
SCALE, OFFSET = 64, 1_000_000
COMPONENTS = 32
FLAT = 1e-12            # share of the largest eigenvalue at or below which a component has no variance
LONG = 2 ** 63 - 1

OUT = ("vec_id long, component int, n long, deviation long, whitened double, explained double, identity_error double")


def integer_rows(df: DataFrame, vec_id: str, vector: str, scale: int, offset: int) -> DataFrame:
    """vec_id, dim and ``x`` (integers) of the vectors that take part."""
    v = F.transform(F.col(vector), lambda c: c.cast("double"))
    odd = F.exists("v", lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf")))
    rows = df.select(F.col(vec_id).cast("long").alias("vec_id"), v.alias("v"))
    rows = rows.where(F.col("v").isNotNull()).where(~odd & (F.size("v") > 0))
    x = F.transform("v", lambda c: F.floor(c * scale).cast("long") + offset)
    return rows.select("vec_id", F.size("v").alias("dim"), x.alias("x"))


def numbered(df: DataFrame) -> DataFrame:
    """``df`` with ``idx``, 0..rows-1 inside each ``dim``: rows stay where they are, offsets come from counts."""
    order = Window.partitionBy("dim", "part").orderBy("row")
    rows = written(df.withColumns({"part": F.spark_partition_id(), "row": F.monotonically_increasing_id()}), "whiten-rows")
    counts = rows.groupBy("dim", "part").agg(F.count(F.lit(1)).alias("c"), F.min("row").alias("low"), F.max("row").alias("high"))
    before = Window.partitionBy("dim").orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    counts = counts.select("dim", "part", "c", "low", "high", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("off"))
    counts = written(counts, "whiten-offsets")
    # with one dimension a partition's rows are numbered without gaps already
    if counts.where("high - low + 1 <> c").isEmpty():
        local = F.col("row") - F.col("low")
    else:
        local = F.row_number().over(order) - 1
    # a row a partition and dimension
    joined = rows.join(F.broadcast(counts), ["dim", "part"])
    return joined.withColumn("idx", (F.col("off") + local).cast("long")).drop("part", "row", "c", "low", "high", "off")


def block_matrix(rows: DataFrame, n: int, dim: int, vector: str = "vector") -> BlockMatrix:
    """BlockMatrix of (idx, array of doubles), made in the JVM."""
    vectors = MLUtils.convertVectorColumnsFromML(rows.select("idx", array_to_vector(vector).alias("vector")), "vector")
    blocks = IndexedRowMatrix(vectors, n, dim).toBlockMatrix(ROWS_PER_BLOCK, min(dim, COLS_PER_BLOCK))
    # a product reads both of its sides, and X is in two products: blocks are put together once
    return blocks.persist(StorageLevel.MEMORY_AND_DISK)


def release(matrix: BlockMatrix) -> None:
    """Give up a matrix's kept blocks."""
    matrix._java_matrix_wrapper._java_model.blocks().unpersist(False)


def product(left: BlockMatrix, right: BlockMatrix, mid_splits: int = 1) -> BlockMatrix:
    """left x right; ``mid_splits``: parts of the inner dimension that are added up apart."""
    # the Python method has no such parameter; the JVM's has
    java = left._java_matrix_wrapper.call("multiply", right._java_matrix_wrapper._java_model, int(mid_splits))
    return BlockMatrix(java, left.rowsPerBlock, right.colsPerBlock)


def scatter(x: BlockMatrix, n: int) -> np.ndarray:
    """x^T x / n, local (dimension by dimension)."""
    blocks = -(-n // ROWS_PER_BLOCK)
    return product(x.transpose(), x, max(1, min(blocks, 256))).toLocalMatrix().toArray() / n


def local_blocks(spark, m: np.ndarray, rows_per_block: int, cols_per_block: int) -> BlockMatrix:
    """A small local matrix as blocks that fit to another's."""
    parts = [((i // rows_per_block, j // cols_per_block),
              DenseMatrix(*(b := m[i:i + rows_per_block, j:j + cols_per_block]).shape, b.ravel(order="F").tolist()))
             for i in range(0, m.shape[0], rows_per_block) for j in range(0, m.shape[1], cols_per_block)]
    return BlockMatrix(spark.sparkContext.parallelize(parts, 1), rows_per_block, cols_per_block, *m.shape)


def indexed_rows(matrix: BlockMatrix) -> DataFrame:
    """(idx, vector array) of a BlockMatrix, in the JVM."""
    java = matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model
    rows = callMLlibFunc("getIndexedRows", java)
    return rows.select(F.col("index").cast("long").alias("idx"), vector_to_array("vector").alias("vector"))


def whitening_matrix(v: np.ndarray, components: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(W, explained, whether a component has variance); columns by falling eigenvalue."""
    values, vectors = np.linalg.eigh((v + v.T) / 2)
    order = np.argsort(-values, kind="stable")[:components]
    values, vectors = values[order], vectors[:, order]
    alive = values > max(FLAT * float(values.max(initial=0.0)), 0)
    w = vectors / np.sqrt(np.where(alive, values, 1))
    trace = float(np.trace(v))
    return w, values / trace if trace > 0 else np.full(len(values), np.nan), alive


def whiten_rows(rows: DataFrame, dim: int, components: int) -> DataFrame:
    """The result for the vectors of one dimension (``vec_id``, ``idx``, ``x``)."""
    spark = rows.sparkSession
    facts = rows.select(F.posexplode("x").alias("i", "x")).groupBy("i").agg(
        F.sum("x").alias("s"), F.count(F.lit(1)).alias("n"), F.min("x").alias("low"), F.max("x").alias("high"))
    facts = sorted(facts.collect())              # one row a dimension of the vectors
    n, sums = int(facts[0]["n"]), [int(f["s"]) for f in facts]
    # largest |n x - S| of each dimension, to tell whether squares fit a long
    far = [max(abs(n * int(f["low"]) - s), abs(n * int(f["high"]) - s)) for f, s in zip(facts, sums)]
    s_col = F.array(*[F.lit(s).cast("long") for s in sums]) if dim <= 4096 else F.lit(sums).cast("array<long>")
    shifted = F.zip_with("x", s_col, lambda x, s: x * F.lit(n).cast("long") - s)
    if sum(f * f for f in far) <= LONG:
        deviation = F.aggregate("d", F.lit(0).cast("long"), lambda a, d: a + d * d)
    else:
        wide = F.aggregate("d", F.lit(0).cast("decimal(38,0)"),
                           lambda a, d: (a + d.cast("decimal(19,0)") * d.cast("decimal(19,0)")).cast("decimal(38,0)"))
        deviation = F.when(wide <= F.lit(LONG).cast("decimal(38,0)"), wide).cast("long")
    centred = rows.select("idx", "vec_id", shifted.alias("d")).select(
        "idx", "vec_id", deviation.alias("deviation"), F.transform("d", lambda d: d.cast("double") / n).alias("vector"))
    centred = written(centred, "whiten-centred")

    x = block_matrix(centred, n, dim)
    w, explained, alive = whitening_matrix(scatter(x, n), components)
    k = w.shape[1]
    z = product(x, local_blocks(spark, w, x.colsPerBlock, k), max(1, -(-dim // x.colsPerBlock)))
    projected = written(indexed_rows(z), "whiten-projected")

    means = projected.select(F.posexplode("vector").alias("i", "z")).groupBy("i").agg(F.avg("z").alias("m")).collect()
    m_col = F.array(*[F.lit(float(r["m"])) for r in sorted(means)])
    moved = projected.select("idx", F.zip_with("vector", m_col, lambda a, b: a - b).alias("vector"))
    moved_blocks = block_matrix(moved, n, k)
    covariance = scatter(moved_blocks, n)[np.ix_(alive, alive)]
    release(x)
    release(moved_blocks)
    error = float(np.abs(covariance - np.eye(len(covariance))).max()) if alive.any() else None

    ids = centred.select("idx", "vec_id", "deviation")
    lines = ids.join(projected, "idx").select("vec_id", "deviation", F.posexplode("vector").alias("i", "z"))
    has = F.array(*[F.lit(bool(a)) for a in alive])
    share = F.array(*[F.lit(float(e) if np.isfinite(e) else None).cast("double") for e in explained])
    return lines.select(
        "vec_id", (F.col("i") + 1).cast("int").alias("component"), F.lit(n).cast("long").alias("n"), "deviation",
        F.when(has[F.col("i")], F.col("z")).alias("whitened"), share[F.col("i")].alias("explained"),
        F.lit(error).cast("double").alias("identity_error"))


def whiten_embeddings(embeddings: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", scale: int = SCALE,
                      offset: int = OFFSET, components: int = COMPONENTS) -> DataFrame:
    """Every vector's first ``components`` whitened coordinates and the fit's figures."""
    rows = numbered(integer_rows(embeddings, vec_id, vector, scale, offset))
    dims = [r["dim"] for r in rows.select("dim").distinct().collect()]   # dimensions in use, usually one
    if not dims:
        return embeddings.sparkSession.createDataFrame([], OUT)
    return reduce(DataFrame.unionByName,
                  [whiten_rows(rows.where(F.col("dim") == d).drop("dim"), d, components) for d in sorted(dims)])
