"""Tables, staging and connected components shared by the text operators."""

from __future__ import annotations

import ctypes
import os
import tempfile
import zipfile
from collections.abc import Callable, Iterator
from contextlib import contextmanager
from pathlib import Path

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

import traitframe
from traitframe.operators.joins import shuffled
from traitframe.session import new_path

# A word is a run of characters other than these
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"
SPACE = r"[\x20\x09-\x0D]+"

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


_BATCH_BYTES = "spark.sql.execution.arrow.maxBytesPerBatch"
_shipped: set[str] = set()


def ship_package(spark: SparkSession) -> None:
    """Send this package to the executors once, so that their Python workers can import it wherever it lies on the driver."""
    context = spark.sparkContext
    if context.applicationId not in _shipped:
        root = Path(traitframe.__file__).resolve().parent
        archive = os.path.realpath(tempfile.mkdtemp()) + "/traitframe.zip"
        with zipfile.ZipFile(archive, "w") as out:
            for file in sorted(root.rglob("*.py")):
                out.write(file, file.relative_to(root.parent))
        context.addPyFile(archive)
        _shipped.add(context.applicationId)


def release_memory() -> None:
    """Give freed memory back to the system: a Python worker outlives its tasks, and would hold the most that any of them took."""
    pa.default_memory_pool().release_unused()
    trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # glibc only
    if trim is not None:
        trim(0)


def map_arrow(df: DataFrame, run: Callable, schema: str) -> DataFrame:
    """``mapInArrow`` with this package on the executors, memory released at the end of each task, and Arrow batches bounded by bytes unless the session sets a bound."""

    def released(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        yield from run(batches)
        release_memory()

    ship_package(df.sparkSession)
    if df.sparkSession.conf.get(_BATCH_BYTES, None) is None:
        df.sparkSession.conf.set(_BATCH_BYTES, str(4 << 20))
    return df.mapInArrow(released, schema)


@contextmanager
def shuffle_files_dropped(spark: SparkSession) -> Iterator[None]:
    """Within this block a write removes its shuffle files when it has ended."""
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        yield
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)


def save(df: DataFrame, name: str) -> DataFrame:
    """``df`` written to the folder all executors share, and read back.

    This cuts the lineage: a lost executor costs tasks of the running step only.
    The step's shuffle files go when the table is complete.
    """
    spark = df.sparkSession
    path = new_path(spark, name)
    with shuffle_files_dropped(spark):
        df.write.option("compression", "zstd").parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    out.saved_path = path
    return out


def drop_saved(*tables: DataFrame) -> None:
    """Delete tables of :func:`save` that nothing reads any more."""
    for df in tables:
        jvm = df.sparkSession._jvm
        path = jvm.org.apache.hadoop.fs.Path(df.saved_path)
        path.getFileSystem(df.sparkSession.sparkContext._jsc.hadoopConfiguration()).delete(path, True)


def boxed(docs: DataFrame, **keys: Column) -> DataFrame:
    """Whole rows as one column ``row`` beside keys, so that no column name of a table meets a name used here; ``row.*`` gives them back."""
    return docs.select(F.struct("*").alias("row"), *[column.alias(name) for name, column in keys.items()])


def crc_mod(doc_id: Column | str, n: int) -> Column:
    """crc32 of the id as text, modulo ``n``; null for a null id."""
    return F.crc32(F.col(doc_id).cast("string") if isinstance(doc_id, str) else doc_id.cast("string")) % n


def _all_stars(edges: DataFrame) -> bool:
    """Whether every node of distinct ``edges(a, b)``, a > b, has one lesser neighbour at most and is the lesser one of no other node if it has one."""
    ends = edges.select(F.col("a").alias("node"), F.lit(1).alias("up"), F.lit(0).alias("down"))
    ends = ends.union(edges.select(F.col("b").alias("node"), F.lit(0).alias("up"), F.lit(1).alias("down")))
    return ends.groupBy("node").agg(F.sum("up").alias("up"), F.max("down").alias("down")).filter("up + down > 1").isEmpty()


def connected_components(edges: DataFrame) -> DataFrame:
    """``(node, root)`` for every node of ``edges(a, b)``; the root is the smallest node of its component.

    Large-star and small-star steps by turns: each round joins every node to the
    least neighbour known, so long chains halve and dense groups become stars.
    Only minima are aggregated, never neighbour lists; a node with very many
    neighbours is split by the skew handling of the join. Every round is a saved
    table; rounds end when all that is left are stars. No edges give no rows.
    """
    edges = edges.select(F.col("a").cast("long"), F.col("b").cast("long")).filter("a <> b")
    now = save(edges.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), "edges")
    while not _all_stars(now):
        both = now.union(now.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        large = both.filter("b > a").join(shuffled(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = save(large.filter("a <> b").distinct(), "large-star")
        least = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(shuffled(least), "a").select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
        after = save(small.union(least.select("a", F.col("m").alias("b"))).distinct(), "small-star")
        drop_saved(large, now)
        now = after
    roots = now.select(F.col("a").alias("node"), F.col("b").alias("root"))
    return roots.union(now.select(F.col("b").alias("node"), F.col("b").alias("root")).distinct())
