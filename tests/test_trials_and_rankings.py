from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from traitframe.functions.tags import fold_tag, model_path_fields
from traitframe.operators import importance as imp
from traitframe.operators import trials
from traitframe.sources import sinks

LOG = [
    (0, 0, 0.5, 0.9, "t1"), (0, 0, 0.3, 0.8, "t2"), (0, 0, 0.3, 0.7, "t3"),
    (0, 1, 0.2, 0.75, "t4"), (1, 0, 0.6, 0.1, "t5"), (1, 1, 0.1, 0.1, "t6"),
]


@pytest.fixture()
def log(spark):
    return spark.createDataFrame(LOG, "x_outer int, x_inner int, val_loss double, test_loss double, trial_tag string")


def test_leaderboard_keeps_ties(log):
    best, inner = trials.leaderboard(log)
    assert [r["trial_tag"] for r in best.collect()] == ["t2", "t3", "t4", "t5", "t6"]
    assert [r["trial_tag"] for r in inner.collect()] == ["t3", "t5", "t6"]
    assert trials.best_overall(inner).first()["trial_tag"] == "t6"
    assert trials.model_of_fold(best, 0, 0).first()["trial_tag"] == "t2"
    by_val = trials.best_inner(trials.best_trials(log), "val_loss")
    assert {r["trial_tag"] for r in by_val.collect()} == {"t4", "t6"}


def test_study_minimum_replaces_the_logged_loss(spark, log):
    studies = spark.createDataFrame([(0, 0, 0.25, "S"), (7, 0, 0.4, "T")], "x_outer int, x_inner int, min_loss double, study_name string")
    got = {(r["x_outer"], r["trial_tag"]): r["val_loss"] for r in trials.best_trials(log, studies).collect()}
    assert got == {(0, "t2"): 0.25, (0, "t3"): 0.25, (7, None): 0.4}


def test_inferior(log):
    assert {r["trial_tag"] for r in trials.inferior_trials(log).collect()} == {"t1"}


def test_report_is_reused_unless_overwritten(spark, log, tmp_path):
    best, inner = trials.leaderboard(log)
    sinks.write_trial_report(spark, best, inner, str(tmp_path))
    worse = best.withColumn("test_loss", F.lit(9.0))
    kept, _ = sinks.write_trial_report(spark, worse, inner, str(tmp_path))
    assert 9.0 not in {r["test_loss"] for r in kept.collect()}
    fresh, _ = sinks.write_trial_report(spark, worse, inner, str(tmp_path), overwrite=True)
    assert {r["test_loss"] for r in fresh.collect()} == {9.0}


def test_path_fields(spark):
    path = "/logs/run_20240101/log_dem_3_2/abc/best-model-epoch=0011-val_loss=0.1250.ckpt"
    df = spark.createDataFrame([(path,), ("x.ckpt",)], "p string")
    got = df.select(*[c.alias(n) for n, c in model_path_fields(F.col("p")).items()]).collect()
    assert tuple(got[0]) == (3, 2, 0.125, "abc", "20240101") and tuple(got[1]) == (None,) * 5
    tags = spark.createDataFrame([("/a/omics_10_2_val.parquet",), ("/a/tag=x_y_0_1_trn/part-0.parquet",), ("/a/x_0_trn.parquet",)], "p string")
    assert [tuple(r) for r in tags.select(*[fold_tag(F.col("p"), k) for k in (1, 2, 3)]).collect()] == [
        ("10", "2", "val"), ("0", "1", "trn"), (None, None, None)
    ]


def test_permutation_keeps_values_and_is_shared_by_features(spark):
    long = spark.createDataFrame([(f"s{i}", "o", f, float(i + 100 * (f == "b"))) for i in range(40) for f in "ab"], "ID string, omics string, feature string, value double")
    got = imp.permute_features(long, imp.permutation_pairs(long, [1, 2])).collect()
    by = {}
    for r in got:
        by.setdefault((r["seed"], r["feature"]), {})[r["ID"]] = r["value"]
    assert len(by) == 4 and all(sorted(v.values()) == sorted(float(i + 100 * (f == "b")) for i in range(40)) for (_, f), v in by.items())
    assert {k: v + 100 for k, v in by[1, "a"].items()} == by[1, "b"] and by[1, "a"] != by[2, "a"]


def test_importance_of_linear_and_general_scorer(spark):
    rng = np.random.default_rng(2)
    x, w = rng.normal(size=(50, 3)), [2.0, 0.0, -0.5]
    data = [(f"s{i}", row.tolist(), float(row @ w + 0.1), float(row @ w)) for i, row in enumerate(x)]
    df = spark.createDataFrame(data, "ID string, x array<double>, y double, y_pred double")
    pairs = imp.permutation_pairs(df, [5, 6])
    weights = F.array(*[F.lit(v) for v in w])

    def score(rows_):
        return rows_.withColumn("y_pred", F.aggregate(F.zip_with("x", weights, lambda a, b: a * b), F.lit(0.0), lambda a, b: a + b))

    fast = imp.linear_importance_trials(df, weights, pairs)
    slow = imp.importance_trials(df.drop("y_pred"), score, pairs, 3)
    a, b = ({(r["j"], r["seed"]): r["loss"] for r in t.collect()} for t in (fast, slow))
    assert a == pytest.approx(b) and len(a) == 6
    # by hand for one feature and seed
    source = {r["ID"]: int(r["source_ID"][1:]) for r in pairs.where("seed = 5").collect()}
    want = np.mean([(w[0] * (x[source[f"s{i}"], 0] - x[i, 0]) - 0.1) ** 2 for i in range(50)])
    assert a[0, 5] == pytest.approx(want)
    scores = imp.importance_scores(fast, imp.baseline_loss(df))
    names = spark.createDataFrame([(j, "o", f"f{j}") for j in range(3)], "j int, omics string, feature string")
    ranked = [r["feature"] for r in imp.name_features(scores, names).collect()]
    assert ranked == ["f0", "f2", "f1"]


def test_merged_rankings(spark):
    data = [(0, "o", "a", 4.0), (0, "o", "b", 2.0), (0, "o", "c", 9.0), (2, "o", "a", 1.0), (2, "o", "b", 3.0)]
    df = spark.createDataFrame(data, "x_outer int, omics string, feature string, importance double")
    merged = [tuple(r) for r in imp.merge_rankings(df).collect()]
    assert merged == [("o", "a", 0.5, 1.0, 0.0), ("o", "b", 0.5, 0.0, 1.0)]
    flat = imp.merge_rankings(df.withColumn("importance", F.when(F.col("x_outer") == 2, 1.0).otherwise(F.col("importance"))))
    assert rows(flat, "feature", "average", "test_2") == [("a", None, None), ("b", None, None)]
