"""Nested cross-validation folds on a thin table of sample IDs."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitframe.constants import SEED_SPLIT
from traitframe.functions.folds import even_part, fold_role
from traitframe.operators.positions import hash_positions


def fold_grid(spark: SparkSession, k_outer: int, k_inner: int, only: tuple[int, int] | None = None) -> DataFrame:
    """All (x_outer, x_inner) pairs, or the one asked for. A range, not a cross join."""
    grid = spark.range(k_outer * k_inner).select(
        F.floor(F.col("id") / k_inner).cast("int").alias("x_outer"),
        (F.col("id") % k_inner).cast("int").alias("x_inner"),
    )
    if only is None:
        return grid
    outer, inner = only
    if not (0 <= outer < k_outer and 0 <= inner < k_inner):
        raise ValueError(f"fold {only} is outside {k_outer} x {k_inner}")
    return grid.where((F.col("x_outer") == outer) & (F.col("x_inner") == inner))


def random_fragments(samples: DataFrame, n_fragments: int, seed: int = SEED_SPLIT, keys: Sequence[str] = ("ID",)) -> DataFrame:
    """Cut samples, in a seeded random order, into even fragments.

    Adds ``position`` and ``fragment``. ``keys`` identify a row (``ID`` and
    ``copy_no`` after padding).
    """
    placed = hash_positions(samples, keys, seed, out="position", total="_n")
    return placed.withColumn("fragment", even_part(F.col("position"), F.col("_n"), n_fragments)).drop("_n")


def given_fragments(samples: DataFrame, fragments: DataFrame, n_fragments: int) -> DataFrame:
    """Use fragments chosen by the user, a table (ID, fragment).

    The fragment numbers must be exactly 0..n_fragments-1.
    """
    span = fragments.agg(
        F.countDistinct("fragment").alias("n"), F.min("fragment").alias("lo"), F.max("fragment").alias("hi")
    ).first()
    if (span["n"], span["lo"], span["hi"]) != (n_fragments, 0, n_fragments - 1):
        raise ValueError(f"expected fragments 0..{n_fragments - 1}, found {span['n']} from {span['lo']} to {span['hi']}")
    return samples.join(fragments.select("ID", F.col("fragment").cast("int").alias("fragment")), "ID")


def with_folds(df: DataFrame, k_outer: int, k_inner: int, only: tuple[int, int] | None = None) -> DataFrame:
    """Repeat every row once per fold with its ``split`` there.

    The role follows from the fragment number alone, so no join is needed.
    """
    if only is None:
        numbers = F.explode(F.sequence(F.lit(0), F.lit(k_outer * k_inner - 1)))
    else:
        fold_grid(df.sparkSession, k_outer, k_inner, only)  # checks the range
        # not a literal: joins on the fold would lose their keys to constant folding
        numbers = F.explode(F.array(F.lit(only[0] * k_inner + only[1])))
    rows = df.withColumn("_fold", numbers)
    outer = F.floor(F.col("_fold") / k_inner).cast("int")
    inner = (F.col("_fold") % k_inner).cast("int")
    rows = rows.withColumn("x_outer", outer).withColumn("x_inner", inner).drop("_fold")
    return rows.withColumn("split", fold_role(F.col("fragment"), F.col("x_outer"), F.col("x_inner"), k_outer, k_inner))


def fold_roles(spark: SparkSession, k_outer: int, k_inner: int, only: tuple[int, int] | None = None) -> DataFrame:
    """Table (x_outer, x_inner, fragment, split): the layout itself."""
    fragments = spark.range(k_outer * k_inner).select(F.col("id").cast("int").alias("fragment"))
    return with_folds(fragments, k_outer, k_inner, only).select("x_outer", "x_inner", "fragment", "split")


def fragments_outside(spark: SparkSession, k_outer: int, k_inner: int, split: str) -> DataFrame:
    """Per fold, the fragments that do not have role ``split``."""
    roles = fold_roles(spark, k_outer, k_inner)
    keys = ["x_outer", "x_inner", "fragment"]
    return roles.select(*keys).exceptAll(roles.where(F.col("split") == split).select(*keys))
