"""Permutation importance and ranking merges."""

from __future__ import annotations

from collections.abc import Callable, Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitframe.operators.positions import hash_positions

KEYS = ["omics", "feature"]


def permutation_pairs(samples: DataFrame, seeds: Sequence[int]) -> DataFrame:
    """(seed, ID, source_ID): which sample's value a sample receives under a seed.

    One permutation per seed serves every feature, as a seeded permutation of a
    column depends on its length only. So the sort runs over samples x seeds IDs
    instead of samples x features x seeds values.
    """
    ids = samples.select("ID").distinct()
    seeded = ids.withColumn("seed", F.explode(F.array(*[F.lit(int(s)) for s in seeds])))
    shuffled = hash_positions(seeded, ["ID"], F.col("seed"), group=["seed"])
    fixed = hash_positions(ids, ["ID"], "fixed")
    return shuffled.withColumnRenamed("ID", "source_ID").join(fixed, "position").select("seed", "ID", "source_ID")


def permute_features(long: DataFrame, pairs: DataFrame) -> DataFrame:
    """(seed, ID, omics, feature, value): every feature shuffled across samples, per seed."""
    source = long.withColumnRenamed("ID", "source_ID")
    return pairs.join(source, "source_ID").drop("source_ID")


def _paired_rows(samples: DataFrame, pairs: DataFrame) -> DataFrame:
    source = samples.select(F.col("ID").alias("source_ID"), F.col("x").alias("x_source"))
    return samples.join(pairs, "ID").join(source, "source_ID").drop("source_ID")


def linear_importance_trials(samples: DataFrame, weights: Column, pairs: DataFrame) -> DataFrame:
    """Loss per (j, seed) for a linear scorer, exactly: ``y_pred + w_j (x_source_j - x_j)``.

    ``samples`` is (ID, x array, y, y_pred), ``weights`` the coefficients as an
    array column. The rows x features blow-up stays inside a task and is reduced
    by the partial aggregate before any shuffle.
    """
    rows = _paired_rows(samples, pairs).withColumn("_w", weights)
    cells = rows.select("seed", "y", "y_pred", F.posexplode(F.arrays_zip("x", "x_source", "_w")).alias("j", "_c"))
    moved = F.col("y_pred") + F.col("_c._w") * (F.col("_c.x_source") - F.col("_c.x"))
    error = moved - F.col("y")
    return cells.groupBy("j", "seed").agg(F.avg(error * error).alias("loss"))


def importance_trials(
    samples: DataFrame,
    score: Callable[[DataFrame], DataFrame],
    pairs: DataFrame,
    n_features: int,
    loss: Column | None = None,
) -> DataFrame:
    """Loss per (j, seed) for any scorer.

    ``samples`` is (ID, x array, y); ``score`` adds ``y_pred`` (and whatever
    ``loss`` reads, squared error by default) to rows holding ``x``. Each row is repeated once per feature with that feature swapped,
    scored and reduced in the same stage, so the repeats are never stored.
    """
    rows = _paired_rows(samples, pairs).withColumn("j", F.explode(F.sequence(F.lit(0), F.lit(n_features - 1))))
    swapped = F.transform("x", lambda v, i: F.when(i == F.col("j"), F.get("x_source", i)).otherwise(v))
    scored = score(rows.withColumn("x", swapped).drop("x_source"))
    return scored.groupBy("j", "seed").agg(F.avg(squared_error() if loss is None else loss).alias("loss"))


def squared_error() -> Column:
    error = F.col("y_pred") - F.col("y")
    return error * error


def baseline_loss(scored: DataFrame, loss: Column | None = None) -> DataFrame:
    return scored.agg(F.avg(squared_error() if loss is None else loss).alias("loss"))


def importance_scores(trials: DataFrame, baseline: DataFrame, by: Sequence[str] = ("j",)) -> DataFrame:
    """Mean over seeds of ``|loss - baseline|``, relative to the baseline (one row)."""
    rows = trials.withColumn("_base", baseline.select("loss").scalar())
    change = F.avg(F.abs(F.col("loss") - F.col("_base")))
    return rows.groupBy(*by).agg(F.try_divide(change, F.first("_base")).alias("importance"))


def name_features(scores: DataFrame, features: DataFrame) -> DataFrame:
    """Scores by number ``j`` to scores by (omics, feature), best first."""
    named = scores.join(features, "j").select(*KEYS, "importance")
    return sort_ranking(named)


def sort_ranking(ranking: DataFrame, column: str = "importance") -> DataFrame:
    return ranking.orderBy(F.desc_nulls_last(column), *KEYS)


def shared_features(rankings: DataFrame, outers: Sequence[int]) -> DataFrame:
    """Features present in all rankings, one column ``importance_<i>`` per outer fold, 1-based."""
    columns = [F.max(F.when(F.col("x_outer") == o, F.col("importance"))).alias(f"importance_{i + 1}") for i, o in enumerate(outers)]
    present = [F.max((F.col("x_outer") == o).cast("int")) for o in outers]
    wide = rankings.groupBy(*KEYS).agg(*columns, reduce(lambda a, b: a + b, present).alias("_n"))
    return wide.where(F.col("_n") == len(outers)).drop("_n")


def merge_rankings(rankings: DataFrame, outers: Sequence[int] | None = None) -> DataFrame:
    """(omics, feature, average, test_1..k): min-max per ranking over shared features, then the mean.

    A ranking whose scores are all equal gives null, and so does its average.
    """
    if outers is None:
        outers = [r["x_outer"] for r in rankings.select("x_outer").distinct().orderBy("x_outer").collect()]
    shared = shared_features(rankings, outers)
    names = [f"importance_{i + 1}" for i in range(len(outers))]
    ends = shared.agg(F.struct(*[F.struct(F.min(n).alias("lo"), F.max(n).alias("hi")).alias(n) for n in names]))
    rows = shared.withColumn("_e", ends.scalar())
    scaled = rows.select(
        *KEYS,
        *[
            F.try_divide(F.col(n) - F.col(f"_e.{n}.lo"), F.col(f"_e.{n}.hi") - F.col(f"_e.{n}.lo")).alias(f"test_{i + 1}")
            for i, n in enumerate(names)
        ],
    )
    tests = [f"test_{i + 1}" for i in range(len(outers))]
    average = reduce(lambda a, b: a + b, [F.col(t) for t in tests]) / len(tests)
    return sort_ranking(scaled.select(*KEYS, average.alias("average"), *tests), "average")
