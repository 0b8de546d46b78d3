"""Feature ranking of fitted models by permutation, per outer fold and merged."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitframe.constants import TEST
from traitframe.operators.importance import (
    baseline_loss,
    importance_scores,
    importance_trials,
    merge_rankings,
    name_features,
    permutation_pairs,
)
from traitframe.operators.trials import best_inner, best_trials
from traitframe.plans.models import DualExtraction, row_loss
from traitframe.session import stage
from traitframe.sources.sinks import write_ranking


def rank_features(
    data: DataFrame, model: DualExtraction, features: Sequence[tuple[str, str]], seeds: Sequence[int], path: str | None = None
) -> DataFrame:
    """(omics, feature, importance), best first, on the rows given.

    ``data`` holds ``x_<omics>`` vectors and ``y``; ``features`` names their
    entries in vector order (:func:`traitframe.plans.vectors.feature_order`).
    With ``path`` the ranking and the losses behind it are written.
    """
    spark = data.sparkSession
    widths = {o: sum(1 for name, _ in features if name == o) for o in model.omics}
    joined = F.concat(*[vector_to_array(f"x_{o}") for o in model.omics])
    rows = stage(data.select(F.concat_ws("#", "ID", "copy_no").alias("ID"), joined.alias("x"), "y"), "test-rows")

    def score(wide: DataFrame) -> DataFrame:
        start, columns = 1, {}
        for omics, width in widths.items():
            columns[f"x_{omics}"] = array_to_vector(F.slice("x", start, width))
            start += width
        return model.transform(wide.withColumns(columns))

    loss = row_loss(model)
    trials = importance_trials(rows, score, permutation_pairs(rows, seeds), len(features), loss)
    ordered = [(j, o, f) for j, (o, f) in enumerate(pair for m in model.omics for pair in features if pair[0] == m)]
    names = spark.createDataFrame(ordered, "j int, omics string, feature string")
    if path is not None:
        trials = stage(trials, "perm-trials")
    ranking = name_features(importance_scores(trials, baseline_loss(score(rows), loss)), names)
    if path is not None:
        write_ranking(ranking, path, trials.join(F.broadcast(names), "j").select("omics", "feature", "seed", "loss"))
    return ranking


def rank_outer_fold(
    vectors: DataFrame,
    trials: DataFrame,
    models: dict[str, DualExtraction],
    features: Sequence[tuple[str, str]],
    x_outer: int,
    seeds: Sequence[int],
    path: str | None = None,
) -> DataFrame:
    """Rank on the test rows of an outer fold with the model of its best inner fold."""
    chosen = best_inner(best_trials(trials)).where(F.col("x_outer") == x_outer).orderBy("trial_tag").limit(1).collect()
    if not chosen:
        raise ValueError(f"no trial for outer fold {x_outer}")
    inner = chosen[0]["x_inner"]
    here = (F.col("x_outer") == x_outer) & (F.col("x_inner") == inner) & (F.col("split") == TEST)
    ranking = rank_features(vectors.where(here), models[chosen[0]["trial_tag"]], features, seeds, path)
    return ranking.select(F.lit(x_outer).alias("x_outer"), "*")


def collect_ranks(spark: SparkSession, paths: dict[int, str], path: str | None = None, overwrite: bool = True) -> DataFrame:
    """Merge written rankings, given by outer fold, and write the result."""
    found = None
    for outer in sorted(paths):
        ranking = spark.read.parquet(f"{paths[outer]}/ranking").select(F.lit(outer).alias("x_outer"), "omics", "feature", "importance")
        found = ranking if found is None else found.unionByName(ranking)
    merged = merge_rankings(found, sorted(paths))
    if path is not None:
        write_ranking(merged, path, mode="overwrite" if overwrite else "ignore")
    return merged
