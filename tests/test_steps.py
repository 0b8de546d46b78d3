"""Steps that users define, through the whole workflow, and repeated samples in sparse tables."""

from __future__ import annotations

import numpy as np
import pytest
from conftest import rows
from pyspark.sql import functions as F

from traitframe.functions.folds import fragments_of
from traitframe.operators import preprocess as pre
from traitframe.operators.samples import first_occurrences
from traitframe.operators.steps import MaxAbsScale, RobustScale, SeenFilter, Step
from traitframe.plans import ncv

K_OUTER, K_INNER, N = 3, 2, 66


class MiddleFill(Step):
    """Half way between the extremes: a step defined outside the library."""

    name, effect = "middle", "fill"

    def update(self, value):
        return F.struct(F.min(value).alias("lo"), F.max(value).alias("hi"))

    def merge(self, left, right):
        return F.struct(F.least(left["lo"], right["lo"]).alias("lo"), F.greatest(left["hi"], right["hi"]).alias("hi"))

    def finish(self, state, seen):
        return (state["lo"] + state["hi"]) / 2, None, None


@pytest.fixture(scope="module")
def data(spark):
    rng = np.random.default_rng(3)
    x = rng.normal(size=(N, 3)) * [1, 20, 0] + [0, 5, 2]
    x[rng.random((N, 3)) < 0.15] = np.nan
    cells = [(f"s{i:02d}", "a", j, f"f{j}", None if np.isnan(v) else float(v)) for i, row in enumerate(x) for j, v in enumerate(row)]
    cells += [(f"s{i:02d}", "a", 3, "rare", 1.0 if i % 9 == 0 else None) for i in range(N)]
    omics = spark.createDataFrame(cells, "ID string, omics string, feature_idx int, feature string, value double")
    fragments = spark.createDataFrame([(f"s{i:02d}", i % 6) for i in range(N)], "ID string, fragment int")
    return x, omics, fragments


def quantile(v, q):
    """The least value with at least this share of values at or below it."""
    return float(np.quantile(v, q, method="inverted_cdf"))


def test_user_steps_through_the_workflow(spark, data, tmp_path):
    x, omics, fragments = data
    steps = [MiddleFill(), SeenFilter(0.5), RobustScale()]
    done = ncv.prepare_ncv(omics, None, K_OUTER, K_INNER, fragments=fragments, pad="none", steps=steps)
    assert {r["kind"] for r in done.params.select("kind").distinct().collect()} == {"fill:middle", "filter:seen", "scale:robust"}
    got = {(r["x_outer"], r["x_inner"], r["feature"], r["ID"]): r["value"] for r in done.omics.collect()}
    want = {}
    for o in range(K_OUTER):
        for i in range(K_INNER):
            train = np.isin(np.arange(N) % 6, fragments_of("trn", o, i, K_OUTER, K_INNER))
            for j in range(3):
                seen = x[train, j][~np.isnan(x[train, j])]
                fill = (seen.min() + seen.max()) / 2
                width = quantile(seen, 0.75) - quantile(seen, 0.25) or 1.0
                for k in range(N):
                    want[o, i, f"f{j}", f"s{k:02d}"] = ((fill if np.isnan(x[k, j]) else x[k, j]) - quantile(seen, 0.5)) / width
    assert got == pytest.approx(want, abs=1e-9)
    ncv.write_once(done, f"{tmp_path}/d")
    once = ncv.read_once(spark, f"{tmp_path}/d", K_OUTER, K_INNER, 1, 0, "val")
    key = ("feature", "ID", "value")
    assert rows(once, *key) == rows(done.omics.where("x_outer = 1 and x_inner = 0 and split = 'val'"), *key)
    again, _ = ncv.apply_preprocessors(omics, None, done.params)
    assert rows(again.where("x_outer = 1 and x_inner = 0"), *key) == rows(done.omics.where("x_outer = 1 and x_inner = 0"), *key)


def test_scaling_steps_in_a_row(spark, data):
    """A step after another one works on what that one leaves: the last location and width win."""
    _, omics, fragments = data
    both = ncv.prepare_ncv(omics, None, K_OUTER, K_INNER, fragments=fragments, pad="none", steps=["impute", "minmax", RobustScale()])
    one = ncv.prepare_ncv(omics, None, K_OUTER, K_INNER, fragments=fragments, pad="none", steps=["impute", RobustScale()])
    key = ("x_outer", "x_inner", "feature", "ID", "value")
    a, b = ({tuple(r)[:4]: r["value"] for r in d.omics.select(*key).collect()} for d in (both, one))
    assert a == pytest.approx(b, abs=1e-9)


def test_other_steps(spark, data):
    x, omics, fragments = data
    steps = ["impute", MaxAbsScale()]
    params = pre.fit_omics(pre.attach(omics, fragments), K_OUTER, K_INNER, only=(0, 0), steps=steps)
    train = np.isin(np.arange(N) % 6, fragments_of("trn", 0, 0, K_OUTER, K_INNER))
    found = {r["feature"]: r["p2"] for r in params.where("kind = 'scale:maxabs'").collect()}
    assert found.pop("rare") is None  # no training row of this fold has a value
    assert found == pytest.approx({f"f{j}": np.nanmax(np.abs(x[train, j])) for j in range(3)})
    with pytest.raises(ValueError):
        pre.fit_omics(pre.attach(omics, fragments), K_OUTER, K_INNER, steps=[RobustScale(), RobustScale(0.1, 0.9)])
    wrong = MaxAbsScale(effect="other")
    with pytest.raises(ValueError):
        pre.fit_omics(pre.attach(omics, fragments), K_OUTER, K_INNER, steps=[wrong])


def test_repeats_in_a_sparse_table(spark):
    """A sample given twice with one of three features is repeated, however few rows it has."""
    cells = [("s1", "a", 0, "f0", 1.0), ("s1", "a", 0, "f0", 9.0), ("s2", "a", 0, "f0", 2.0), ("s2", "a", 1, "f1", 3.0), ("s2", "a", 2, "f2", 4.0)]
    long = spark.createDataFrame(cells, "ID string, omics string, feature_idx int, feature string, value double").coalesce(1)
    assert rows(first_occurrences(long), "ID", "feature", "value") == [("s1", "f0", 1.0), ("s2", "f0", 2.0), ("s2", "f1", 3.0), ("s2", "f2", 4.0)]
