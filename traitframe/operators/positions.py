"""Global positions (row numbers) without a global window.

A plain ``row_number() over (order by ...)`` moves all rows into one task. Here
rows are cut into ordered buckets, numbered inside each bucket, and shifted by
the size of the buckets before. Only the bucket sizes (a fixed, small number of
rows) are ever summed in one place.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitframe.functions.folds import seeded_hash
from traitframe.operators.joins import sized_join

HASH_DIGITS = 3  # 16**3 = 4096 buckets
HASH_BUCKETS = 16**HASH_DIGITS
SORT_BUCKETS = 256
MAX_BUCKETS = 4096
BUCKET_ROWS = 100_000
SAMPLE_STEP = 64
GROUP_CUTS = 2_000  # groups whose cut points (about 4 kB each) may be broadcast
_STEP = 16


def _number_rows(rows: DataFrame, group: Sequence[str], order: Sequence[Column | str], out: str, total: str | None) -> DataFrame:
    """Number rows that carry an ordered ``_bucket``, per ``group``, from 0."""
    group = list(group)
    sizes = rows.groupBy(*group, "_bucket").agg(F.count(F.lit(1)).alias("_size"))
    # one row per bucket: at most HASH_BUCKETS or MAX_BUCKETS rows per group
    over = Window.partitionBy(*group)
    before = over.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    shifts = sizes.select(
        *group,
        "_bucket",
        F.coalesce(F.sum("_size").over(before), F.lit(0)).alias("_before"),
        F.sum("_size").over(over).alias("_total"),
    )
    inside = F.row_number().over(Window.partitionBy(*group, "_bucket").orderBy(*order)) - 1
    # without groups the bucket table has a fixed bound, so it may be broadcast;
    # with groups Spark decides, and the keys are even because buckets are
    side = shifts if group else F.broadcast(shifts)
    numbered = rows.withColumn("_inside", inside).join(side, [*group, "_bucket"])
    numbered = numbered.withColumn(out, (F.col("_before") + F.col("_inside")).cast("bigint"))
    if total:
        numbered = numbered.withColumn(total, F.col("_total").cast("bigint"))
    return numbered.drop("_bucket", "_inside", "_before", "_total")


def hash_positions(
    df: DataFrame,
    keys: Sequence[str],
    seed: Column | int,
    out: str = "position",
    total: str | None = None,
    group: Sequence[str] = (),
) -> DataFrame:
    """0-based position of each unique key in a seeded random order.

    The order is md5 of ``seed|key``, ties by key. md5 is uniform, so its leading
    digits give even buckets whatever the keys look like.
    """
    rows = df.withColumn("_hash", seeded_hash(seed, *[F.col(k).cast("string") for k in keys]))
    lead = F.conv(F.substring("_hash", 1, HASH_DIGITS), 16, 10).cast("int")
    rows = rows.withColumn("_bucket", lead)
    return _number_rows(rows, group, ["_hash", *keys], out, total).drop("_hash")


def cut_points(df: DataFrame, key: str, buckets: int = SORT_BUCKETS) -> DataFrame:
    """One row with a struct of two sorted arrays: at most ``buckets - 1`` keys, and every 16th of them.

    The keys of lowest md5 are a uniform sample of the distinct keys that does
    not depend on partitioning; ``limit`` keeps them a fixed-size top-k. Every
    ``SAMPLE_STEP``-th of them cuts, so that buckets are even.
    """
    lowest = df.select(F.col(key).alias("_key")).distinct().orderBy(F.md5(F.col("_key").cast("string")), "_key")
    sample = lowest.limit(buckets * SAMPLE_STEP).agg(F.array_sort(F.collect_list("_key")).alias("all"))
    # fewer keys than that: cut at as many as there may be buckets
    step = F.greatest(F.ceil(F.size("all") / buckets), F.lit(1)).cast("int")
    cuts = sample.select(F.filter("all", lambda _, i: (i > 0) & (i % step == 0)).alias("fine"))
    return _with_coarse(cuts)


def _with_coarse(cuts: DataFrame) -> DataFrame:
    kept = [c for c in cuts.columns if c != "fine"]
    coarse = F.filter("fine", lambda _, i: i % _STEP == 0)
    return cuts.select(*kept, F.struct("fine", coarse.alias("coarse")).alias("cuts"))


def group_cut_points(df: DataFrame, key: str, group: Sequence[str], buckets: int = SORT_BUCKETS) -> DataFrame:
    """Cut points of a numeric key for each group, as ``(group..., cuts)``: approximate quantiles, so that every group has even buckets."""
    places = [i / buckets for i in range(1, buckets)]
    return _with_coarse(df.groupBy(*group).agg(F.array_sort(F.array_distinct(F.percentile_approx(key, places, 20 * buckets))).alias("fine")))


def sort_buckets(df: DataFrame, key: str, cuts: DataFrame, group: Sequence[str] = ()) -> DataFrame:
    """Adds ``_bucket``, the number of cut points at or below ``key``, by two short scans."""
    # columns of their own: subqueries may not stand inside a higher-order
    # function, and the first scan is used twice
    if group:
        placed = sized_join(df, cuts.withColumnRenamed("cuts", "_cuts"), list(group), salt_by=[key], max_rows=GROUP_CUTS)
    else:
        placed = df.withColumn("_cuts", cuts.scalar())
    placed = placed.withColumn("_blocks", F.size(F.filter("_cuts.coarse", lambda c: c <= F.col(key))))
    start = (F.col("_blocks") - 1) * _STEP
    block = F.slice("_cuts.fine", F.greatest(start, F.lit(0)) + 1, F.lit(_STEP))
    inside = F.size(F.filter(block, lambda c: c <= F.col(key)))
    bucket = F.when(F.col("_blocks") == 0, F.lit(0)).otherwise(start + inside)
    return placed.withColumn("_bucket", bucket).drop("_cuts", "_blocks")


def sorted_positions(df: DataFrame, key: str, out: str = "position", total: str | None = None, buckets: int | None = None) -> DataFrame:
    """0-based position of each unique key in ascending order; the number of buckets follows the rows unless it is given."""
    if buckets is None:
        buckets = min(MAX_BUCKETS, max(SORT_BUCKETS, df.count() // BUCKET_ROWS))
    rows = sort_buckets(df, key, cut_points(df, key, buckets))
    return _number_rows(rows, [], [key], out, total)
