"""Tables split by fold: partitioned directories and fold-tagged files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitframe.constants import FILE_BYTES, SPLITS
from traitframe.functions.tags import fold_tag

FOLD_COLUMNS = ["x_outer", "x_inner", "split"]


def write_folds(df: DataFrame, path: str, mode: str = "error") -> None:
    """Parquet, zstd, partitioned by fold and split.

    The rebalance hint lets AQE split the large training partitions and merge
    the small ones towards the advisory size, so neither one task nor one file
    holds a whole split, and small folds do not shatter into tiny files.
    """
    spark = df.sparkSession
    key = "spark.sql.adaptive.advisoryPartitionSizeInBytes"
    before = spark.conf.get(key, None)
    spark.conf.set(key, FILE_BYTES)
    try:
        even = df.hint("rebalance", *[F.col(c) for c in FOLD_COLUMNS])
        even.write.mode(mode).option("compression", "zstd").partitionBy(*FOLD_COLUMNS).parquet(path)
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def read_folds(
    spark: SparkSession, path: str, x_outer: int | None = None, x_inner: int | None = None, split: str | None = None
) -> DataFrame:
    """The rows of a fold; conditions prune directories."""
    if split is not None and split not in SPLITS:
        raise ValueError(f"split must be one of {SPLITS}")
    rows = spark.read.parquet(path)
    for name, wanted in (("x_outer", x_outer), ("x_inner", x_inner), ("split", split)):
        if wanted is not None:
            rows = rows.where(F.col(name) == wanted)
    return rows


def read_fold_tagged(
    spark: SparkSession,
    path: str,
    x_outer: int | None = None,
    x_inner: int | None = None,
    split: str | None = None,
    prefix: str | None = None,
) -> DataFrame:
    """Parquet files or directories anywhere below ``path`` named ``*_{outer}_{inner}_{split}``.

    Fold columns come from the path; conditions on it skip whole files. An error
    when nothing matches.
    """
    rows = spark.read.option("recursiveFileLookup", True).parquet(path)
    where = F.col("_metadata.file_path")
    tagged = rows.select(
        "*",
        fold_tag(where, 1).cast("int").alias("x_outer"),
        fold_tag(where, 2).cast("int").alias("x_inner"),
        fold_tag(where, 3).alias("split"),
        where.alias("_file"),
    ).where(F.col("split").isNotNull())
    if prefix is not None:
        tagged = tagged.where(F.col("_file").rlike(rf"/(tag=)?\Q{prefix}\E[^/]*_\d+_\d+_(trn|val|tst)[^/]*(/[^/]*)?$"))
    for name, wanted in (("x_outer", x_outer), ("x_inner", x_inner), ("split", split)):
        if wanted is not None:
            tagged = tagged.where(F.col(name) == wanted)
    if tagged.isEmpty():
        raise ValueError(f"no file of the wanted fold below {path}")
    return tagged.drop("_file")


def write_fold_tagged(df: DataFrame, path: str, prefix: str) -> None:
    """One directory ``tag=<prefix>_<outer>_<inner>_<split>`` per fold and split, in one job."""
    tag = F.concat_ws("_", F.lit(prefix), "x_outer", "x_inner", "split")
    even = df.withColumn("tag", tag).drop(*FOLD_COLUMNS).hint("rebalance", F.col("tag"))
    even.write.option("compression", "zstd").partitionBy("tag").parquet(path)


def omics_names(spark: SparkSession, path: str) -> DataFrame:
    """Sorted names of the omics tables of a written dataset."""
    return spark.read.parquet(path).select("omics").distinct().orderBy("omics")
