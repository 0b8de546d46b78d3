"""Dual extraction: one learner per omics table, one on all tables, one on their outputs.

A stacked ensemble in Spark ML with the purpose, inputs and outputs of the
neural network it stands for; the numbers are its own. Training vectors are
(ID, copy_no, fragment, split, x_<omics>..., y).
"""

from __future__ import annotations

import itertools
import json
import random
from collections.abc import Sequence
from dataclasses import dataclass, field
from functools import reduce

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel, RandomForestClassificationModel, RandomForestClassifier
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.ml.regression import LinearRegression, LinearRegressionModel, RandomForestRegressionModel, RandomForestRegressor
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from traitframe.constants import TEST, TRAIN, TRIALS_PER_FOLD, VALID
from traitframe.functions.scoring import argmax, cross_entropy
from traitframe.operators.importance import squared_error
from traitframe.operators.trials import best_inner, best_overall, best_trials, model_of_fold

DEFAULT_GRID: dict[str, list[float]] = {"l2": [0.001, 0.01, 0.1, 1.0], "elastic": [0.0, 0.5], "l2_integrated": [0.01, 0.1]}
TRIALS = "x_outer int, x_inner int, trial_tag string, study_tag string, l2 double, elastic double, l2_integrated double, val_loss double, test_loss double, path string"


def _scores(regression: bool, name: str) -> Column:
    """Model output as an array: one number, or one raw score per class."""
    return F.array(F.col(f"_prediction_{name}")) if regression else vector_to_array(F.col(f"_raw_{name}"))


LEARNERS = ("linear", "trees")


def _learner(name: str, features: str, regression: bool, l2: float, elastic: float, kind: str = "linear"):
    if kind == "trees":
        settings = {"featuresCol": features, "labelCol": "y", "predictionCol": f"_prediction_{name}", "numTrees": 30, "maxDepth": 6, "seed": 42}
        if regression:
            return RandomForestRegressor(**settings)
        return RandomForestClassifier(rawPredictionCol=f"_raw_{name}", probabilityCol=f"_probability_{name}", **settings)
    if regression:
        return LinearRegression(
            featuresCol=features, labelCol="y", predictionCol=f"_prediction_{name}", regParam=l2, elasticNetParam=elastic
        )
    return LogisticRegression(
        featuresCol=features, labelCol="y", predictionCol=f"_prediction_{name}", rawPredictionCol=f"_raw_{name}",
        probabilityCol=f"_probability_{name}", regParam=l2, elasticNetParam=elastic, family="multinomial",
    )


@dataclass
class DualExtraction:
    """Fitted models and combination weights."""

    omics: list[str]
    regression: bool
    extractors: dict[str, object] = field(default_factory=dict)
    integrator: object = None
    weights: dict[str, float] = field(default_factory=dict)
    learner: str = "linear"

    def save(self, path: str) -> None:
        """Write the models and weights below ``path``; :meth:`load` reads them in any session."""
        names = [*self.omics, "concatenated"]
        for k, model in enumerate([*(self.extractors[n] for n in names), self.integrator]):
            model.write().overwrite().save(f"{path}/model-{k}")
        about = json.dumps({"omics": self.omics, "regression": self.regression, "weights": self.weights, "learner": self.learner})
        SparkSession.active().createDataFrame([(about,)], "about string").coalesce(1).write.mode("overwrite").text(f"{path}/about")

    @staticmethod
    def load(spark: SparkSession, path: str) -> DualExtraction:
        about = json.loads(spark.read.text(f"{path}/about").first()[0])
        kind = LinearRegressionModel if about["regression"] else LogisticRegressionModel
        names = [*about["omics"], "concatenated"]
        learner = about.get("learner", "linear")
        forest = RandomForestRegressionModel if about["regression"] else RandomForestClassificationModel
        extractors = {n: (forest if learner == "trees" else kind).load(f"{path}/model-{k}") for k, n in enumerate(names)}
        integrator = kind.load(f"{path}/model-{len(names)}")
        return DualExtraction(about["omics"], about["regression"], extractors, integrator, about["weights"], learner)

    def outputs(self, data: DataFrame) -> DataFrame:
        """Score arrays ``s_<omics>``, ``s_concatenated`` and ``s_integrated``."""
        rows = _extract(self.extractors, concatenate(data, self.omics), self.regression)
        rows = self.integrator.transform(_hidden(rows, [*self.omics, "concatenated"]))
        scored = rows.withColumn("s_integrated", _scores(self.regression, "integrated"))
        return scored.drop(*[c for c in scored.columns if c.startswith("_")])

    def transform(self, data: DataFrame) -> DataFrame:
        """Adds ``scores`` (weighted sum) and ``y_pred`` (the number, or the class)."""
        return combine(self.outputs(data), self.weights, self.regression)


def concatenate(data: DataFrame, omics: Sequence[str]) -> DataFrame:
    return VectorAssembler(inputCols=[f"x_{o}" for o in omics], outputCol="x_concatenated").transform(data)


def _extract(models: dict[str, object], data: DataFrame, regression: bool) -> DataFrame:
    rows = data
    for name, model in models.items():
        rows = model.transform(rows).withColumn(f"s_{name}", _scores(regression, name))
    return rows.drop(*[c for c in rows.columns if c.startswith("_")])


def _hidden(rows: DataFrame, names: Sequence[str]) -> DataFrame:
    return rows.withColumn("x_hidden", array_to_vector(F.flatten(F.array(*[F.col(f"s_{n}") for n in names]))))


def combine(outputs: DataFrame, weights: dict[str, float], regression: bool) -> DataFrame:
    """Weighted sum of the outputs, class by class."""

    def weighed(name: str, weight: float) -> Column:
        return F.transform(f"s_{name}", lambda v: v * F.lit(float(weight)))

    terms = [weighed(n, w) for n, w in weights.items()]
    total = reduce(lambda a, b: F.zip_with(a, b, lambda p, q: p + q), terms)
    rows = outputs.withColumn("scores", total)
    return rows.withColumn("y_pred", F.get("scores", F.lit(0)) if regression else argmax(F.col("scores")).cast("double"))


def start_weights(omics: Sequence[str]) -> dict[str, float]:
    """1 for the concatenated and the integrated output, 1/K for each omics table."""
    return {**{o: 1.0 / len(omics) for o in omics}, "concatenated": 1.0, "integrated": 1.0}


def least_squares_weights(outputs: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Weights that fit ``y`` best; a touch of ridge because outputs are alike."""
    rows = _hidden(outputs, names)
    model = LinearRegression(featuresCol="x_hidden", labelCol="y", fitIntercept=False, regParam=1e-3, standardization=False).fit(rows)
    return dict(zip(names, model.coefficients.toArray().tolist(), strict=True))


def class_weights(outputs: DataFrame, names: Sequence[str]) -> dict[str, float]:
    """Weights of the outputs that best tell a row's class from its others: one logistic fit over (row, class)."""
    scores = F.arrays_zip(*[F.col(f"s_{n}").alias(n) for n in names])
    rows = outputs.select(F.col("y").cast("int").alias("_class"), F.posexplode(scores).alias("_k", "_s"))
    rows = rows.select((F.col("_class") == F.col("_k")).cast("double").alias("y"), array_to_vector(F.array(*[F.col("_s")[n] for n in names])).alias("x_hidden"))
    model = LogisticRegression(featuresCol="x_hidden", labelCol="y", regParam=1e-3).fit(rows)
    return dict(zip(names, model.coefficients.toArray().tolist(), strict=True))


def fit_dual_extraction(
    data: DataFrame,
    omics: Sequence[str],
    regression: bool = True,
    l2: float = 0.1,
    elastic: float = 0.0,
    l2_integrated: float = 0.1,
    parts: int = 2,
    weights: str = "fit",
    learner: str = "linear",
) -> DualExtraction:
    """Fit on the training rows of one fold; its validation rows are left for choosing among trials.

    ``learner`` is the kind of the extractors: ``linear``, or ``trees`` (random
    forests). The integrator is linear. :mod:`traitframe.plans.hidden` fits all folds and trials at once.

    The integrator and the combination weights learn from out-of-fold outputs: fragments are dealt into
    ``parts``, and each part is scored by extractors that did not see it.
    """
    if weights not in ("fit", "start"):
        raise ValueError("weights must be 'fit' or 'start'")
    if learner not in LEARNERS:
        raise ValueError(f"learner must be one of {LEARNERS}")
    names = [*omics, "concatenated"]
    train = concatenate(data.where(F.col("split") == TRAIN), omics).cache()

    def fit_extractors(rows: DataFrame) -> dict[str, object]:
        return {n: _learner(n, f"x_{n}", regression, l2, elastic, learner).fit(rows) for n in names}

    part = F.pmod(F.floor(F.col("fragment")), F.lit(parts))
    held_out = [
        _extract(fit_extractors(train.where(part != p)), train.where(part == p), regression) for p in range(parts)
    ]
    stacked = _hidden(reduce(lambda a, b: a.unionByName(b), held_out), names)
    integrator = _learner("integrated", "x_hidden", regression, l2_integrated, 0.0).fit(stacked)
    model = DualExtraction(list(omics), regression, fit_extractors(train), integrator, start_weights(omics), learner)
    if weights == "fit":
        seen = integrator.transform(stacked).withColumn("s_integrated", _scores(regression, "integrated"))
        model.weights = (least_squares_weights if regression else class_weights)(seen.drop("x_hidden"), [*names, "integrated"])
    train.unpersist()
    return model


def row_loss(model: DualExtraction) -> Column:
    """Squared error, or cross-entropy of the class scores."""
    return squared_error() if model.regression else cross_entropy(F.col("scores"), F.col("y").cast("int"))


def split_losses(model: DualExtraction, data: DataFrame) -> dict[str, float]:
    """Mean loss per split: squared error, or cross-entropy."""
    scored = model.transform(data)
    loss = row_loss(model)
    return {r["split"]: r["loss"] for r in scored.groupBy("split").agg(F.avg(loss).alias("loss")).collect()}


def sample_trials(grid: dict[str, list[float]], n_trials: int, seed: int) -> list[dict[str, float]]:
    """Distinct settings drawn from the grid; more trials than it has settings are an error."""
    settings = [dict(zip(grid, values, strict=True)) for values in itertools.product(*grid.values())]
    if n_trials > len(settings):
        raise ValueError(f"{n_trials} trials asked for, the grid has {len(settings)} settings")
    return random.Random(seed).sample(settings, n_trials)


def sweep(
    vectors: DataFrame,
    omics: Sequence[str],
    folds: Sequence[tuple[int, int]],
    regression: bool = True,
    n_trials: int = TRIALS_PER_FOLD,
    grid: dict[str, list[float]] | None = None,
    seed: int = 42,
    study_tag: str = "sweep",
    path: str | None = None,
) -> tuple[DataFrame, dict[str, DualExtraction]]:
    """Trial log and fitted models by ``trial_tag``; each trial is a distributed fit.

    With ``path`` every model is saved below it, and the log's ``path`` says where.
    """
    spark = vectors.sparkSession
    rows, models = [], {}
    for outer, inner in folds:
        data = vectors.where((F.col("x_outer") == outer) & (F.col("x_inner") == inner)).cache()
        for i, setting in enumerate(sample_trials(grid or DEFAULT_GRID, n_trials, seed + 1000 * outer + inner)):
            model = fit_dual_extraction(data, omics, regression, **setting)
            loss = split_losses(model, data)
            tag = f"t{outer}_{inner}_{i}"
            models[tag] = model
            saved = None if path is None else f"{path}/{tag}"
            if saved:
                model.save(saved)
            rows.append((outer, inner, tag, study_tag, setting["l2"], setting["elastic"], setting["l2_integrated"], loss.get(VALID), loss.get(TEST), saved))
        data.unpersist()
    return spark.createDataFrame(rows, TRIALS), models


def _predict(vectors: DataFrame, chosen, models: dict[str, DualExtraction] | None) -> DataFrame:
    model = models[chosen["trial_tag"]] if models else DualExtraction.load(vectors.sparkSession, chosen["path"])
    scored = model.transform(vectors)
    keys = ("x_outer", "x_inner", "split", "ID", "copy_no", "y")
    return scored.select(*[k for k in keys if k in scored.columns], "y_pred")


def predict_fold(vectors: DataFrame, trials: DataFrame, models: dict[str, DualExtraction] | None, x_outer: int, x_inner: int) -> DataFrame:
    """Predictions of the fold's best model for its three splits; ``ID`` is carried along.

    Without ``models`` the model is read from the path in the trial log. Vectors
    without fold columns, such as those of new samples, are predicted as a whole.
    """
    chosen = model_of_fold(best_trials(trials), x_outer, x_inner).collect()
    if not chosen:
        raise ValueError(f"no trial for fold ({x_outer}, {x_inner})")
    data = vectors.where((F.col("x_outer") == x_outer) & (F.col("x_inner") == x_inner)) if "x_outer" in vectors.columns else vectors
    return _predict(data, chosen[0], models)


def predict_overall(vectors: DataFrame, trials: DataFrame, models: dict[str, DualExtraction] | None = None) -> DataFrame:
    """Predictions of all given vectors by the best model of all folds."""
    chosen = best_overall(best_inner(best_trials(trials))).first()
    if chosen is None:
        raise ValueError("no trial")
    return _predict(vectors, chosen, models)
