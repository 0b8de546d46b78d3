"""Dual extraction with hidden features: all folds, traits and trials from one set of Gram matrices.

An extractor turns the features of one table into hidden ones: the features
themselves and seeded random cosine features of them. Another extractor does so
for all tables at once, and an integrator learns from the hidden outputs of all
extractors. Every learner is a ridge regression on some columns of one wide
row ``z = (1, hidden..., targets...)``, so all of them follow from sums of
``z'z``. Those sums add up over fragments: one pass over the rows serves every
fold, learner, trait and penalty, and losses are read off the sums too.
"""

from __future__ import annotations

import json
import math
import random
from collections.abc import Iterator, Sequence
from dataclasses import asdict, dataclass
from functools import partial

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitframe.constants import TEST, TRAIN, TRIALS_PER_FOLD, VALID
from traitframe.operators.trials import best_inner, best_overall, best_trials
from traitframe.session import ship_package, stage

FOLD = ["x_outer", "x_inner"]
ROWS_A_SUM = 50_000
PARTS = 2  # out-of-fold parts that the weights of the outputs are fitted on
# a list is drawn from, a pair of numbers is a range drawn from log-uniformly
DEFAULT_SPACE: dict[str, list[float] | tuple[float, float]] = {"l2": (1e-4, 1.0), "l2_integrated": (1e-4, 1.0), "width": [0.5, 1.0]}
_SUMS = "width double, x_outer int, x_inner int, fragment int, split string, sizes array<int>, gram binary"
_MODELS = (
    "x_outer int, x_inner int, trial_tag string, study_tag string, l2 double, elastic double, l2_integrated double, width double, "
    "val_loss double, test_loss double, sizes array<int>, weights array<array<double>>, components binary, total binary"
)


@dataclass(frozen=True)
class Layout:
    """Which hidden features there are: ``hidden`` cosines for each table, ``hidden_all`` for all tables together."""

    omics: tuple[str, ...]
    traits: tuple[str, ...]
    classes: int = 0  # 0 for numbers; otherwise the one trait holds classes 0, 1, ...
    hidden: int = 64
    hidden_all: int = 128
    seed: int = 42

    @property
    def targets(self) -> int:
        return self.classes or len(self.traits)

    @property
    def names(self) -> list[str]:
        return [*self.omics, "concatenated", "integrated"]

    def _cosines(self, x: np.ndarray, number: int, table: int, width: float) -> np.ndarray:
        draw = np.random.default_rng([self.seed, table, x.shape[1]])
        slopes = draw.normal(size=(x.shape[1], number)) / (width * math.sqrt(max(x.shape[1], 1)))
        return math.sqrt(2 / max(number, 1)) * np.cos(x @ slopes * 2 + draw.uniform(0, 2 * math.pi, number))

    def features(self, tables: Sequence[np.ndarray], width: float) -> np.ndarray:
        """Rows ``(1, table by table: features and cosines, cosines of all)``."""
        blocks = [np.ones((len(tables[0]), 1))]
        for k, x in enumerate(tables):
            blocks += [x, self._cosines(x, self.hidden, k, width)]
        return np.hstack([*blocks, self._cosines(np.hstack(tables), self.hidden_all, len(tables), width)])

    def columns(self, sizes: Sequence[int]) -> list[np.ndarray]:
        """The columns of :meth:`features` that each of :attr:`names` learns from."""
        at, own, plain = 1, [], []
        for size in sizes:
            own.append(np.arange(at, at + size + self.hidden))
            plain.append(np.arange(at, at + size))
            at += size + self.hidden
        end = at + self.hidden_all
        return [*own, np.concatenate([*plain, np.arange(at, end)]), np.arange(1, end)]


def _matrix(column: pa.Array) -> np.ndarray:
    """Rows of an array column that have one length."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)


def _groups(batch: pa.RecordBatch, keys: Sequence[str]) -> Iterator[tuple[tuple, pa.RecordBatch]]:
    frame = batch.select(list(keys)).to_pandas()
    for key, rows in frame.groupby(list(keys), sort=False, dropna=False).indices.items():
        yield key if isinstance(key, tuple) else (key,), batch.take(pa.array(rows))


def _gram_sums(layout: Layout, widths: Sequence[float], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Sums of ``z'z`` by width, fold and fragment of a partition, which holds few of them."""
    sums: dict[tuple, list] = {}
    for batch in batches:
        for key, rows in _groups(batch, [*FOLD, "fragment", "split"]):
            tables = [_matrix(rows.column(f"x_{o}")) for o in layout.omics]
            y = _matrix(rows.column("targets"))
            if layout.classes:
                y = np.eye(layout.classes)[y[:, 0].astype(int)]
            sizes = [t.shape[1] for t in tables]
            for width in widths:
                z = np.hstack([layout.features(tables, width), y])
                entry = sums.setdefault((width, *key), [sizes, 0.0])
                entry[1] = entry[1] + z.T @ z
    names = [f.split()[0] for f in _SUMS.split(", ")]
    for key, (sizes, gram) in sums.items():
        values = [*key, sizes, gram.tobytes()]
        types = [pa.float64(), pa.int32(), pa.int32(), pa.int32(), pa.string(), pa.list_(pa.int32()), pa.binary()]
        yield pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in zip(values, types, strict=True)], names)


class _Ridge:
    """Ridge models of some columns for every penalty from one factorisation; the intercept is free, columns have unit variance."""

    def __init__(self, gram: np.ndarray, columns: np.ndarray, targets: int):
        n, width = gram[0, 0], len(gram) - targets
        mean = gram[0] / n
        covariance = gram / n - np.outer(mean, mean)
        inner = covariance[np.ix_(columns, columns)]
        spread = np.sqrt(np.maximum(np.diag(inner), 0))
        self.scale = np.where(spread > 1e-9, spread, np.inf)  # a constant column takes no part
        self.values, self.vectors = np.linalg.eigh(inner / np.outer(self.scale, self.scale))
        self.toward = self.vectors.T @ (covariance[np.ix_(columns, np.arange(width, len(gram)))] / self.scale[:, None])
        self.columns, self.width, self.mean = columns, width, mean

    def coefficients(self, l2: float) -> np.ndarray:
        """One row for each column of z before the targets, one column for each target."""
        out = np.zeros((self.width, self.toward.shape[1]))
        out[self.columns] = self.vectors @ (self.toward / (np.maximum(self.values, 0) + l2)[:, None]) / self.scale[:, None]
        out[0] = self.mean[self.width :] - self.mean[self.columns] @ out[self.columns]
        return out


def _output_weights(parts: list[tuple[np.ndarray, np.ndarray]], layout: Layout) -> np.ndarray:
    """Weights (component, target) by least squares of outputs that did not see the rows; one set for all classes."""
    count = len(layout.names)
    left, right = np.zeros((layout.targets, count, count)), np.zeros((layout.targets, count))
    rows = 0.0
    for gram, coefficients in parts:  # coefficients: component, column, target
        width = coefficients.shape[1]
        for t in range(layout.targets):
            out = coefficients[:, :, t]
            left[t] += out @ gram[:width, :width] @ out.T
            right[t] += out @ gram[:width, width + t]
        rows += gram[0, 0]
    if layout.classes:
        left, right = left.sum(axis=0, keepdims=True), right.sum(axis=0, keepdims=True)
    # a touch of ridge because outputs are alike
    solved = np.array([np.linalg.solve(a + 1e-3 * rows * np.eye(count), b) for a, b in zip(left, right, strict=True)]).T
    return np.repeat(solved, layout.targets, axis=1) if layout.classes else solved


def _start_weights(layout: Layout) -> np.ndarray:
    each = np.array([*[1 / len(layout.omics)] * len(layout.omics), 1.0, 1.0])
    return np.repeat(each[:, None], layout.targets, axis=1)


def _loss(gram: np.ndarray | None, total: np.ndarray) -> float | None:
    """Mean squared error over the rows behind a sum, added up over the targets."""
    if gram is None or not gram[0, 0]:
        return None
    width = len(total)
    error = np.diag(gram[width:, width:]) - 2 * (total * gram[:width, width:]).sum(axis=0) + (total * (gram[:width, :width] @ total)).sum(axis=0)
    return float(np.maximum(error, 0).sum() / gram[0, 0])


def _fit_fold(layout: Layout, settings: list[dict], study_tag: str, weights: str, sums: pd.DataFrame) -> pd.DataFrame:
    """All trials of one width and fold."""
    first = sums.iloc[0]
    sizes = list(first["sizes"])
    side = int(math.isqrt(len(first["gram"]) // 8))
    made = [np.frombuffer(g, float).reshape(side, side) for g in sums["gram"]]
    by_split = {s: sum(m for m, x in zip(made, sums["split"], strict=True) if x == s) for s in set(sums["split"])}
    if TRAIN not in by_split:
        return pd.DataFrame(columns=[f.split()[0] for f in _MODELS.split(", ")])
    train, columns = by_split[TRAIN], layout.columns(sizes)
    fragments = sorted(set(sums.loc[sums["split"] == TRAIN, "fragment"]))
    left_out = []
    for p in range(PARTS if len(fragments) > 1 else 0):
        own = set(fragments[p::PARTS])
        left_out.append(sum(m for m, s, f in zip(made, sums["split"], sums["fragment"], strict=True) if s == TRAIN and f in own))
    ridges = [[_Ridge(g, c, layout.targets) for c in columns] for g in (train, *(train - part for part in left_out))]

    def coefficients(fits: list[_Ridge], setting: dict) -> np.ndarray:
        return np.array([r.coefficients(setting["l2_integrated"] if n == "integrated" else setting["l2"]) for r, n in zip(fits, layout.names, strict=True)])

    rows = []
    for number, setting in enumerate(settings):
        if setting["width"] != first["width"]:
            continue
        whole = coefficients(ridges[0], setting)
        parts = [(g, coefficients(fits, setting)) for g, fits in zip(left_out, ridges[1:], strict=True)]
        mix = _output_weights(parts, layout) if weights == "fit" and parts else _start_weights(layout)
        total = np.einsum("ckt,ct->kt", whole, mix)
        rows.append((
            int(first["x_outer"]), int(first["x_inner"]), f"t{first['x_outer']}_{first['x_inner']}_{number}", study_tag, setting["l2"], 0.0, setting["l2_integrated"],
            setting["width"], _loss(by_split.get(VALID), total), _loss(by_split.get(TEST), total), sizes, mix.tolist(), whole.tobytes(), total.tobytes(),
        ))
    return pd.DataFrame(rows, columns=[f.split()[0] for f in _MODELS.split(", ")])


def draw_settings(space: dict, n_trials: int, seed: int) -> list[dict[str, float]]:
    """``n_trials`` settings; ranges make their number unlimited, lists alone are drawn from with repeats once they are used up."""
    rng = random.Random(seed)
    out: list[dict[str, float]] = []
    while len(out) < n_trials:
        one = {name: math.exp(rng.uniform(math.log(v[0]), math.log(v[1]))) if isinstance(v, tuple) else rng.choice(list(v)) for name, v in space.items()}
        options = math.prod(math.inf if isinstance(v, tuple) else len(set(v)) for v in space.values())
        if one not in out or len(out) >= options:
            out.append(one)
    return out


def gram_sums(vectors: DataFrame, layout: Layout, widths: Sequence[float]) -> DataFrame:
    """Sums of ``z'z`` by width, fold, fragment and split, from one pass over ``vectors`` (fold columns, split, fragment, ``x_<omics>``, traits).

    Rows without a value of some trait take no part. Large groups are dealt over several tasks, each of which sends one sum.
    """
    ship_package(vectors.sparkSession)
    tables = [vector_to_array(f"x_{o}").alias(f"x_{o}") for o in layout.omics]
    targets = F.array(*[F.col(t).cast("double") for t in layout.traits]).alias("targets")
    labelled = vectors.dropna(subset=list(layout.traits)).select(*FOLD, "fragment", "split", *tables, targets)
    groups = labelled.groupBy(*FOLD, "fragment").agg(F.count(F.lit(1)).alias("n"))
    shape = groups.agg(F.count(F.lit(1)).alias("groups"), F.coalesce(F.max("n"), F.lit(0)).alias("largest")).first()
    salts = max(1, -(-shape["largest"] // ROWS_A_SUM))
    dealt = labelled.withColumn("_salt", F.pmod(F.xxhash64(*[f"x_{o}" for o in layout.omics]), F.lit(salts)))
    dealt = dealt.repartition(max(1, min(shape["groups"] * salts, 100_000)), *FOLD, "fragment", "_salt").drop("_salt")
    return dealt.mapInArrow(partial(_gram_sums, layout, list(widths)), _SUMS)


def _add_up(rows: pd.DataFrame) -> pd.DataFrame:
    total = sum(np.frombuffer(g, float) for g in rows["gram"])
    return rows.iloc[:1].assign(gram=[total.tobytes()])


def sweep_hidden(
    vectors: DataFrame,
    layout: Layout,
    n_trials: int = TRIALS_PER_FOLD,
    space: dict | None = None,
    seed: int = 42,
    study_tag: str = "hidden",
    weights: str = "fit",
    path: str | None = None,
) -> DataFrame:
    """Models and losses of ``n_trials`` settings in every fold of ``vectors``: a trial log whose rows hold their models.

    Settings are penalties of the extractors and the integrator and the width of
    the cosines. The number of jobs and of passes over the rows does not depend
    on folds or trials: each fold's penalties share one factorisation, and its
    losses (mean squared error, added up over traits; for classes of the class
    indicators) follow from the sums of its validation and test fragments. The
    weights of the outputs are fitted on training rows, each scored by learners that did not see
    its fragment; ``weights="start"`` takes the fixed ones. Validation rows serve for choosing among trials only.
    With ``path`` the table is written there, otherwise to the shared folder.
    """
    if weights not in ("fit", "start"):
        raise ValueError("weights must be 'fit' or 'start'")
    if layout.classes and len(layout.traits) != 1:
        raise ValueError("classes come from one trait")
    settings = draw_settings({**DEFAULT_SPACE, **(space or {})}, n_trials, seed)
    sums = gram_sums(vectors, layout, sorted({s["width"] for s in settings}))
    added = sums.groupBy("width", *FOLD, "fragment", "split").applyInPandas(_add_up, _SUMS)

    def fit(rows: pd.DataFrame) -> pd.DataFrame:
        return _fit_fold(layout, settings, study_tag, weights, rows)

    fitted = added.groupBy("width", *FOLD).applyInPandas(fit, _MODELS)
    if path is None:
        return stage(fitted, "hidden-models")
    about = json.dumps(asdict(layout))
    fitted.write.parquet(f"{path}/models")
    vectors.sparkSession.createDataFrame([(about,)], "about string").coalesce(1).write.text(f"{path}/layout")
    return vectors.sparkSession.read.parquet(f"{path}/models")


def load_hidden(spark, path: str) -> tuple[DataFrame, Layout]:
    """Models and layout as written by :func:`sweep_hidden`."""
    about = json.loads(spark.read.text(f"{path}/layout").first()[0])
    return spark.read.parquet(f"{path}/models"), Layout(**{k: tuple(v) if isinstance(v, list) else v for k, v in about.items()})


def _score(layout: Layout, models, keys: list[str], batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    fold_wise = set(FOLD) <= set(keys)
    for batch in batches:
        for key, rows in _groups(batch, FOLD) if fold_wise else [((), batch)]:
            model = models.value.get(key)
            if model is None or not rows.num_rows:
                continue
            width, components, total = model
            z = layout.features([_matrix(rows.column(f"x_{o}")) for o in layout.omics], width)
            scores, each = z @ total, np.einsum("nk,ckt->nct", z, components)
            made = [pa.array(list(scores)), pa.array([list(r) for r in each], pa.list_(pa.list_(pa.float64())))]
            yield pa.RecordBatch.from_arrays([*(rows.column(k) for k in keys), *made], [*keys, "scores", "outputs"])


def predict_hidden(vectors: DataFrame, chosen: DataFrame, layout: Layout) -> DataFrame:
    """Predictions of all given vectors, each fold by its model in ``chosen`` (one row a fold; a single row for vectors without fold columns).

    Adds ``scores`` (one number a trait or class), ``outputs`` (the same for each
    of the layout's names, before they are weighed) and ``y_pred``: the first
    score, or the class; with several traits ``y_pred_<trait>`` as well. Other columns are kept. Rows of folds without a model are left out.
    """
    spark = vectors.sparkSession
    ship_package(spark)
    fold_wise = set(FOLD) <= set(vectors.columns)
    rows = chosen.collect()  # folds x hidden features
    if not fold_wise and len(rows) != 1:
        raise ValueError("vectors without fold columns need a single model")
    models = {}
    for r in rows:
        total = np.frombuffer(r["total"], float).reshape(-1, layout.targets)
        models[(r["x_outer"], r["x_inner"]) if fold_wise else ()] = (r["width"], np.frombuffer(r["components"], float).reshape(len(layout.names), len(total), -1), total)
    tables = [f"x_{o}" for o in layout.omics]
    keys = [c for c in vectors.columns if c not in tables]
    given = vectors.select(*keys, *[vector_to_array(t).alias(t) for t in tables])
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in vectors.select(*keys).schema) + ", scores array<double>, outputs array<array<double>>"
    scored = given.mapInArrow(partial(_score, layout, spark.sparkContext.broadcast(models), keys), schema)
    if layout.classes:
        return scored.withColumn("y_pred", (F.array_position("scores", F.array_max("scores")) - 1).cast("double"))
    several = {f"y_pred_{t}": F.col("scores")[k] for k, t in enumerate(layout.traits)} if len(layout.traits) > 1 else {}
    return scored.withColumns({"y_pred": F.col("scores")[0], **several})


def best_models(log: DataFrame, overall: bool = False) -> DataFrame:
    """The row of the least validation loss of each fold, ties by tag; or the one row that is best of all folds."""
    best = best_trials(log)
    tags = best_overall(best_inner(best)).select("trial_tag") if overall else best.groupBy(*FOLD).agg(F.min("trial_tag").alias("trial_tag")).select("trial_tag")
    return log.join(F.broadcast(tags), "trial_tag", "left_semi")  # one tag a fold
