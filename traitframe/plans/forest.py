"""Random-forest feature selection.

Same purpose, inputs and outputs as fitting one regression forest per seed on
the scaled training rows and averaging importances; the numbers differ (binned
splits, a depth limit, one forest per label).
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from traitframe.constants import FOREST_FEATURES, FOREST_SEEDS, FOREST_TREES, TRAIN
from traitframe.plans.vectors import feature_order, sample_vectors

IMPORTANCES = "x_outer int, x_inner int, omics string, label string, seed int, feature string, importance double"


def forest_importances(
    train: DataFrame, labels: DataFrame, n_trees: int, seeds: Sequence[int], max_depth: int = 10, fold: tuple[int, int] = (0, 0)
) -> DataFrame:
    """Importance of every feature per omics table, label and seed in one fold.

    ``train`` is the long scaled training table with (ID, copy_no), ``labels`` its
    (ID, copy_no, label, y). The trees grow distributed; the driver holds one
    number per feature.
    """
    spark = train.sparkSession
    keys = ["ID", "copy_no"]
    traits = sorted(r["label"] for r in labels.select("label").distinct().collect())
    wide = labels.groupBy(*keys).agg(*[F.max(F.when(F.col("label") == t, F.col("y"))).alias(f"y_{i}") for i, t in enumerate(traits)])
    rows = []
    for omics in sorted(r["omics"] for r in train.select("omics").distinct().collect()):
        part = train.where(F.col("omics") == omics)
        names = [f for _, f in feature_order(part)]
        data = sample_vectors(part, keys, [omics]).join(wide, keys).cache()
        for i, trait in enumerate(traits):
            for seed in seeds:
                forest = RandomForestRegressor(
                    featuresCol=f"x_{omics}", labelCol=f"y_{i}", numTrees=n_trees, maxDepth=max_depth,
                    featureSubsetStrategy="all", subsamplingRate=1.0, seed=seed,
                )
                found = forest.fit(data).featureImportances.toArray()
                rows += [(*fold, omics, trait, int(seed), n, float(v)) for n, v in zip(names, found, strict=True)]
        data.unpersist()
    return spark.createDataFrame(rows, IMPORTANCES)


def mean_importance(importances: DataFrame) -> DataFrame:
    """Average over seeds (and labels) per fold and feature."""
    return importances.groupBy("x_outer", "x_inner", "omics", "feature").agg(F.avg("importance").alias("importance"))


def top_features(mean: DataFrame, n: int) -> DataFrame:
    """Features with their rank from 1 by importance; ``keep`` marks the first ``n``."""
    order = Window.partitionBy("x_outer", "x_inner", "omics").orderBy(F.desc("importance"), "feature")
    # a group holds the features of one table in one fold, which the driver held before
    return mean.withColumn("rank", F.row_number().over(order)).withColumn("keep", F.col("rank") <= n)


def forest_steps(
    omics: DataFrame,
    labels: DataFrame,
    n_features: int = FOREST_FEATURES,
    n_trees: int = FOREST_TREES,
    seeds: Sequence[int] = FOREST_SEEDS,
    max_depth: int = 10,
) -> DataFrame:
    """Parameter rows of the selection step, for every fold in ``omics``."""
    folds = [(r["x_outer"], r["x_inner"]) for r in omics.select("x_outer", "x_inner").distinct().orderBy("x_outer", "x_inner").collect()]
    found = None
    for outer, inner in folds:
        here = (F.col("x_outer") == outer) & (F.col("x_inner") == inner)
        part = forest_importances(
            omics.where(here & (F.col("split") == TRAIN)), labels.where(here), n_trees, seeds, max_depth, (outer, inner)
        )
        found = part if found is None else found.unionByName(part)
    chosen = top_features(mean_importance(found), n_features)
    return chosen.select(
        "x_outer", "x_inner", "omics", "feature", F.lit(3).alias("step"), F.lit("forest").alias("kind"),
        F.col("importance").alias("p1"), F.col("rank").cast("double").alias("p2"), "keep",
    )
