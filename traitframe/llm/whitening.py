"""Whitened embeddings: distributed block matrices give the scatter and the projection, the driver the eigenvectors."""

from __future__ import annotations

from collections.abc import Iterator
from decimal import Decimal
from functools import partial

import numpy as np
import pyarrow as pa
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.mllib.common import callMLlibFunc
from pyspark.mllib.linalg import DenseMatrix
from pyspark.mllib.linalg.distributed import BlockMatrix, IndexedRowMatrix
from pyspark.mllib.util import MLUtils
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitframe.llm.common import map_arrow, save
from traitframe.operators.positions import hash_positions

SCALE = 256
BLOCK_BYTES = 2 << 20  # of doubles in a block of the matrices
BLOCKS_A_TASK = 16  # blocks of the scatter that one task multiplies and adds up
_FIELDS = "vec_id long, component int, n long, deviation decimal(38,0), whitened double, explained double, identity_error double"


def _cells(batch: pa.RecordBatch, name: str, dims: int) -> np.ndarray:
    """The rows of an array column as a matrix."""
    return batch.column(name).flatten().to_numpy(zero_copy_only=False).reshape(-1, dims)


def _sums(dims: int, batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of high and low halves of the cells: neither overflows below 2**31 rows a batch."""
    for batch in batches:
        x = _cells(batch, "x", dims)
        if len(x):
            high, low = (x >> 32).sum(axis=0), (x & 0xFFFFFFFF).sum(axis=0)
            yield pa.RecordBatch.from_arrays([pa.array(np.arange(dims, dtype=np.int32)), pa.array(high), pa.array(low), pa.array(np.full(dims, len(x)))], ["dim", "high", "low", "n"])


def _deviations(n: int, sums: list[int], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows with the exact sum of ``(n x - S)**2``: in 64 bits where they hold it, otherwise in Python's integers."""
    for batch in batches:
        x = _cells(batch, "x", len(sums))
        bound = n * max(abs(int(x.max(initial=0))), abs(int(x.min(initial=0)))) + max(map(abs, sums))
        if len(sums) * bound * bound < 1 << 63:
            found = pa.array(((n * x - np.array(sums, np.int64)) ** 2).sum(axis=1)).cast(pa.decimal128(38, 0))
        else:
            exact = (((n * x.astype(object) - np.array(sums, object)) ** 2).sum(axis=1)).tolist()
            found = pa.array([Decimal(v) if v < 10**38 else None for v in exact], pa.decimal128(38, 0))
        yield pa.RecordBatch.from_arrays([batch.column("i"), batch.column("vec_id"), found], ["i", "vec_id", "deviation"])


def _matrix(rows: DataFrame, means: list[float], block_rows: int, last: int) -> BlockMatrix:
    """Block matrix of the centred rows ``(i, x)``; indices without a row are zero rows, which change no product."""
    centred = F.zip_with("x", F.array(*[F.lit(m) for m in means]), lambda a, m: a.cast("double") - m)
    indexed = MLUtils.convertVectorColumnsFromML(rows.select(F.col("i").alias("index"), array_to_vector(centred).alias("vector")), "vector")
    return IndexedRowMatrix(indexed, last + 1, len(means)).toBlockMatrix(block_rows, len(means))


def _scatter(matrix: BlockMatrix, blocks: int) -> np.ndarray:
    """Transposed matrix times matrix; blocks are added up in many tasks before the one result block is."""
    wrapped = matrix.transpose()._java_matrix_wrapper.call("multiply", matrix._java_matrix_wrapper._java_model, max(1, blocks // BLOCKS_A_TASK))
    return BlockMatrix(wrapped, matrix.colsPerBlock, matrix.colsPerBlock).toLocalMatrix().toArray()


def _rows_of(matrix: BlockMatrix) -> DataFrame:
    rows = callMLlibFunc("getIndexedRows", matrix.toIndexedRowMatrix()._java_matrix_wrapper._java_model)
    return rows.select(F.col("index").alias("i"), vector_to_array("vector").alias("w"))


def integer_vectors(table: DataFrame, key: str, vector: str, scale: int = SCALE) -> DataFrame:
    """``(vec_id, x)`` of the rows whose vector has finite entries only; x is the floor of ``scale`` times each entry, as long.

    Vectors that are null, hold null, NaN or infinite entries, or entries that no
    long can hold once scaled, are left out.
    """
    cell = F.transform(vector, lambda c: F.floor(c.cast("double") * scale).cast("long"))
    # NaN counts as the largest value, so this refuses NaN and both infinities
    fine = F.forall(vector, lambda c: c.isNotNull() & (F.abs(c.cast("double")) * scale < 9.2e18))
    return table.filter(F.col(vector).isNotNull()).filter(F.coalesce(fine, F.lit(False))).select(F.col(key).cast("long").alias("vec_id"), cell.alias("x"))


def whiten(table: DataFrame, key: str = "vec_id", vector: str = "embedding", components: int | None = None, scale: int = SCALE, block_bytes: int = BLOCK_BYTES) -> DataFrame:
    """``(vec_id, component, n, deviation, whitened, explained, identity_error)`` for every usable row and component.

    Rows are the integer vectors of :func:`integer_vectors`. The fit list holds
    each different x once: ``n`` vectors with sums S by dimension. Components are
    the unit eigenvectors of the fit list's covariance (divisor n, rows centred
    before they are multiplied), numbered from 1 by falling eigenvalue; all, or
    the first ``components``. ``whitened`` is the centred row projected on the
    component over the root of its eigenvalue, ``explained`` the eigenvalue's
    share of the trace, ``deviation`` the exact sum of ``(n x - S)**2`` (null
    beyond 38 digits), and ``identity_error`` the largest absolute entry of the
    covariance of ``whitened`` over the fit list less the identity.

    Vectors must have one length: those of another length than most rows have
    (ties: the longer) are left out, and so are empty ones. Repeated rows each get
    their own result. A component whose eigenvalue is zero to double precision
    has a null ``whitened`` and takes no part in ``identity_error``, which is null
    if no other is left; without any variance ``explained`` is null too. Null keys
    stay null. A table without usable rows gives none. Other columns are not read.

    Rows are numbered without a global order. Two IndexedRowMatrix tables, of
    all rows and of the fit list, become block matrices of about ``block_bytes`` a
    block; the transpose times the fit list's is the scatter, summed in stages,
    and all rows times the whitening matrix the projection. Only d x d numbers
    and one index for each block reach the driver. Copies meet in an aggregate
    that keeps one number for each vector, never in a list.
    """
    spark = table.sparkSession
    usable = integer_vectors(table, key, vector, scale).withColumn("dims", F.size("x")).filter("dims > 0")
    fixed = save(usable.select(F.monotonically_increasing_id().alias("rid"), "vec_id", "x", "dims"), "whiten-rows")
    lengths = fixed.groupBy("dims").agg(F.count(F.lit(1)).alias("rows")).orderBy(F.desc("rows"), F.desc("dims")).limit(1).collect()
    if not lengths:
        return spark.createDataFrame([], _FIELDS)
    dims = lengths[0]["dims"]
    fixed = fixed.filter(F.col("dims") == dims).drop("dims")
    places = hash_positions(fixed.select("rid"), ["rid"], 0, out="i")
    rows = save(fixed.join(places, "rid").select("i", "vec_id", "x"), "whiten-numbered")
    fit = save(rows.groupBy("x").agg(F.min("i").alias("i")), "whiten-fit")

    halves = map_arrow(fit.select("x"), partial(_sums, dims), "dim int, high long, low long, n long").groupBy("dim")
    totals = halves.agg(F.sum(F.col("high").cast("decimal(38,0)")).alias("high"), F.sum(F.col("low").cast("decimal(38,0)")).alias("low"), F.sum("n").alias("n")).collect()
    n = totals[0]["n"]
    by_dim = {t["dim"]: (int(t["high"]) << 32) + int(t["low"]) for t in totals}
    sums = [by_dim[k] for k in range(dims)]
    means = [s / n for s in sums]  # integers divided: rounded once
    last = rows.agg(F.max("i")).first()[0]
    block_rows = max(1, block_bytes // (8 * dims))
    covariance = _scatter(_matrix(fit, means, block_rows, last), last // block_rows + 1) / n
    values, vectors = np.linalg.eigh((covariance + covariance.T) / 2)
    take = dims if components is None else min(components, dims)
    values, vectors = values[::-1][:take], vectors[:, ::-1][:, :take]
    trace = float(np.trace(covariance))
    alive = int((values > max(trace, 0.0) * 1e-14).sum())

    if alive:
        weights = vectors[:, :alive] / np.sqrt(values[:alive])
        entries = spark.sparkContext.parallelize([((0, 0), DenseMatrix(dims, alive, weights.ravel(order="F").tolist()))], 1)
        projected = _matrix(rows, means, block_rows, last).multiply(BlockMatrix(entries, dims, alive, dims, alive))
        white = save(_rows_of(projected), "whitened")
        pairs = [(i, j) for i in range(alive) for j in range(i, alive)]
        entry = [F.covar_pop(F.col("w")[i], F.col("w")[j]).alias(f"c{i}_{j}") for i, j in pairs]
        found = white.join(fit.select("i"), "i").agg(*entry).first()
        error = max(abs(found[f"c{i}_{j}"] - (i == j)) for i, j in pairs)
    else:
        white, error = None, None

    out = map_arrow(rows, partial(_deviations, n, sums), "i long, vec_id long, deviation decimal(38,0)")
    out = out.join(white, "i", "left") if alive else out.withColumn("w", F.lit(None).cast("array<double>"))
    share = F.array(*[F.lit(float(v) / trace if trace > 0 else None).cast("double") for v in values])
    place = F.explode(F.sequence(F.lit(1), F.lit(take))).alias("component")
    return out.select("vec_id", "deviation", "w", place).select(
        "vec_id", "component", F.lit(n).cast("long").alias("n"), "deviation", F.get("w", F.col("component") - 1).alias("whitened"),
        F.get(share, F.col("component") - 1).alias("explained"), F.lit(error).cast("double").alias("identity_error"),
    )
