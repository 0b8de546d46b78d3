from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from traitframe.functions.scoring import argmax
from traitframe.operators import metrics


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(3)
    y = rng.normal(size=200)
    return y, y * 0.5 + rng.normal(size=200)


def test_regression(spark, data):
    y, p = data
    df = spark.createDataFrame([(i % 2, float(a), float(b)) for i, (a, b) in enumerate(zip(y, p))], "g int, y double, y_pred double")
    r = metrics.regression_metrics(df).first()
    assert r["mse"] == pytest.approx(((p - y) ** 2).mean()) and r["mae"] == pytest.approx(np.abs(p - y).mean())
    assert r["pearson"] == pytest.approx(np.corrcoef(y, p)[0, 1])
    assert r["r2"] == pytest.approx(1 - ((p - y) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert metrics.regression_metrics(df, ["g"]).count() == 2


def test_regression_of_one_row_and_of_a_constant(spark):
    df = spark.createDataFrame([("one", 1.0, 2.0), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)], "g string, y double, y_pred double")
    got = {r["g"]: r for r in metrics.regression_metrics(df, ["g"]).collect()}
    assert got["one"]["mse"] == 1.0 and got["one"]["pearson"] is None and got["one"]["r2"] is None
    assert got["flat"]["pearson"] is None and got["flat"]["r2"] is None


def test_classification_against_definitions(spark):
    rng = np.random.default_rng(5)
    y, p = rng.integers(0, 4, 300), rng.integers(0, 4, 300)
    y[y == 3] = 2  # class 3 is predicted but never true
    df = spark.createDataFrame([(int(a), int(b)) for a, b in zip(y, p)], "y int, y_pred int")
    r = metrics.classification_metrics(df).first()
    tp = np.array([((y == c) & (p == c)).sum() for c in range(4)], float)
    t, q = np.array([(y == c).sum() for c in range(4)], float), np.array([(p == c).sum() for c in range(4)], float)
    recall = np.divide(tp, t, out=np.zeros(4), where=t > 0)
    precision, f1 = tp / q, 2 * tp / (t + q)
    assert r["recall_macro"] == pytest.approx(recall.mean()) and r["precision_macro"] == pytest.approx(precision.mean())
    assert r["f1_macro"] == pytest.approx(f1.mean()) and r["accuracy_micro"] == pytest.approx((y == p).mean())
    assert r["f1_weighted"] == pytest.approx((f1 * t).sum() / t.sum())
    s = t.sum()
    mcc = (tp.sum() * s - (t * q).sum()) / np.sqrt((s**2 - (q**2).sum()) * (s**2 - (t**2).sum()))
    assert r["mcc"] == pytest.approx(mcc)


def test_one_class_only_has_no_correlation(spark):
    df = spark.createDataFrame([(1, 1), (1, 1)], "y int, y_pred int")
    r = metrics.classification_metrics(df).first()
    assert r["mcc"] == 0.0 and r["f1_macro"] == 1.0


def brute_auroc(score, positive):
    p, n = score[positive], score[~positive]
    return (p[:, None] > n[None, :]).mean() + (p[:, None] == n[None, :]).mean() / 2


def test_auroc_against_pair_counting(spark):
    rng = np.random.default_rng(7)
    score = np.concatenate([rng.normal(size=900), np.full(450, 0.25)])  # one score holds a third of the rows
    positive = rng.random(1350) < 0.3
    other = rng.integers(0, 3, 1350).astype(float)
    data = [(0, float(s), bool(b)) for s, b in zip(score, positive)] + [(1, float(s), bool(b)) for s, b in zip(other, positive)]
    data += [(2, float(s), False) for s in other]
    df = spark.createDataFrame(data, "cls int, score double, positive boolean")
    got = {r["cls"]: r["auroc"] for r in metrics.auroc_by_class(df).collect()}
    assert got[0] == pytest.approx(brute_auroc(score, positive)) and got[1] == pytest.approx(brute_auroc(other, positive))
    assert got[2] is None
    both = metrics.auroc(df).first()
    assert both["auroc_macro"] == pytest.approx((got[0] + got[1]) / 2) and both["auroc_weighted"] == pytest.approx((got[0] + got[1]) / 2)


def test_cross_entropy_is_stable(spark):
    df = spark.createDataFrame([([1000.0, 999.0], 0), ([0.0, 0.0], 1)], "scores array<double>, y int")
    want = (np.log(1 + np.exp(-1)) + np.log(2)) / 2
    assert metrics.cross_entropy_loss(df).first()["loss"] == pytest.approx(want)


def test_argmax_takes_the_first(spark):
    df = spark.createDataFrame([([0.0, 1.0, 1.0],), ([2.0, 1.0],)], "y array<double>")
    assert [r[0] for r in df.select(argmax(F.col("y"))).collect()] == [1, 0]


def test_losses(spark):
    df = spark.createDataFrame([("a", 1.0, 2.0), ("a", 1.0, 1.0), ("b", 0.0, 3.0)], "label string, y double, y_pred double")
    assert rows(metrics.multi_label_loss(df)) == [(9.5,)]
    unlabelled = df.unionByName(df.limit(1).select(*[F.lit("none").alias(c) if c == "label" else F.lit(None).cast("double").alias(c) if c == "y" else F.col(c) for c in df.columns]))
    assert rows(metrics.multi_label_loss(unlabelled)) == [(None,)]
    batches = spark.createDataFrame([(1.0, 3), (2.0, 1)], "loss double, batch_size int")
    assert rows(metrics.weighted_mean_loss(batches)) == [(1.25,)]
