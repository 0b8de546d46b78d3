from __future__ import annotations

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from traitframe.operators import preprocess as pre

K_OUTER, K_INNER = 3, 2
SCHEMA = "ID string, fragment int, omics string, feature_idx int, feature string, value double"


@pytest.fixture(scope="module")
def matrix():
    rng = np.random.default_rng(0)
    x = rng.normal(1e6, 1.0, size=(60, 5))  # a mean that dwarfs the spread
    x[:, 1] = 3.0  # constant
    x[:, 2] = np.nan  # never seen
    x[rng.random(60) < 0.3, 3] = np.nan
    return x


@pytest.fixture(scope="module")
def long(spark, matrix):
    cells = []
    for i, row in enumerate(matrix):
        for j, v in enumerate(row):
            value = None if math.isnan(v) and i % 2 else float(v)  # missing as null and as NaN
            cells.append((f"s{i}", i % 6, "o", j, f"f{j}", value))
    return spark.createDataFrame(cells, SCHEMA)


def train_rows(outer, inner):
    test = set(range(outer * K_INNER, (outer + 1) * K_INNER))
    rest = [f for f in range(6) if f not in test]
    valid = set(np.array_split(rest, K_INNER)[inner].tolist())
    return [i for i in range(60) if i % 6 in set(rest) - valid]


def test_statistics_use_training_rows_only(long, matrix):
    got = {(r["x_outer"], r["x_inner"], r["feature"]): r for r in pre.fold_statistics(long, K_OUTER, K_INNER).collect()}
    for outer in range(K_OUTER):
        for inner in range(K_INNER):
            part = matrix[train_rows(outer, inner)]
            for j in (0, 1, 3, 4):
                seen = part[~np.isnan(part[:, j]), j]
                filled = np.where(np.isnan(part[:, j]), seen.mean(), part[:, j])
                r = got[outer, inner, f"f{j}"]
                assert r["n"] == len(seen) and r["rows"] == len(part)
                assert r["mean"] == pytest.approx(seen.mean(), rel=1e-12)
                assert r["variance"] == pytest.approx(filled.var(), rel=1e-6, abs=1e-9)
                assert (r["lo"], r["hi"]) == (seen.min(), seen.max())
            assert got[outer, inner, "f2"]["n"] == 0 and got[outer, inner, "f2"]["mean"] is None


def test_fit_and_apply(long, matrix):
    params = pre.fit_omics(long, K_OUTER, K_INNER)
    assert rows(pre.kept_features(params).select("feature").distinct()) == [("f0",), ("f3",), ("f4",)]
    got = {(r["ID"], r["feature"]): r["value"] for r in pre.apply_steps(long, params).where("x_outer = 1 and x_inner = 0").collect()}
    part = matrix[train_rows(1, 0)]
    for j in (0, 3, 4):
        mean, lo, hi = np.nanmean(part[:, j]), np.nanmin(part[:, j]), np.nanmax(part[:, j])
        for i in range(60):
            v = mean if np.isnan(matrix[i, j]) else matrix[i, j]
            assert got[f"s{i}", f"f{j}"] == pytest.approx((v - lo) / (hi - lo), abs=1e-6)


def test_constant_feature_scales_to_zero(long):
    steps = pre.steps_from_statistics(pre.table_statistics(long), ["impute", "minmax"])
    values = pre.apply_steps(long, steps).where("feature = 'f1'").select("value").distinct()
    assert rows(values) == [(0.0,)]
    z = pre.steps_from_statistics(pre.table_statistics(long), ["impute", "zscore"])
    assert rows(pre.apply_steps(long, z).where("feature = 'f1'").select("value").distinct()) == [(0.0,)]


def test_steps_follow_their_order(long):
    stats = pre.table_statistics(long.where("feature = 'f4'"))
    one = pre.steps_from_statistics(stats, ["impute", "minmax"])
    last = one.where("kind = 'minmax'").select(
        "x_outer", "x_inner", "omics", "feature", F.lit(5).alias("step"), F.lit("zscore").alias("kind"), F.lit(0.25).alias("p1"), F.lit(0.5).alias("p2"), "keep"
    )
    a = {r["ID"]: r["value"] for r in pre.apply_steps(long, one).collect()}
    b = {r["ID"]: r["value"] for r in pre.apply_steps(long, one.unionByName(last)).collect()}
    assert all(b[k] == pytest.approx((a[k] - 0.25) / 0.5, abs=1e-6) for k in a)


def test_salted_and_broadcast_application_agree(long):
    params = pre.fit_omics(long, K_OUTER, K_INNER)
    cols = ["ID", "x_outer", "x_inner", "feature", F.round("value", 9).alias("v")]
    want = rows(pre.apply_steps(long, params).select(*cols))
    assert rows(pre.apply_steps(long, params, salts=3, max_rows=0).select(*cols)) == want


def test_one_fold_equals_that_fold_of_all(long):
    cols = ["x_outer", "x_inner", "feature", "step", "keep", F.round("p1", 6).alias("p1")]
    every = pre.fit_omics(long, K_OUTER, K_INNER).where("x_outer = 2 and x_inner = 1").select(*cols)
    assert rows(pre.fit_omics(long, K_OUTER, K_INNER, only=(2, 1)).select(*cols)) == rows(every)
