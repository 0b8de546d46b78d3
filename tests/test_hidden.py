"""Hidden-feature models against plain least squares on rows."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.ml.linalg import Vectors
from pyspark.sql import functions as F

from traitframe.functions.folds import fragments_of
from traitframe.operators.folds import with_folds
from traitframe.plans import hidden, models

K_OUTER, K_INNER = 3, 2
FRAGMENTS = K_OUTER * K_INNER


def make(spark, n=480, seed=5):
    rng = np.random.default_rng(seed)
    a, b = rng.uniform(size=(n, 3)), rng.uniform(size=(n, 2))
    product = 8 * (a[:, 0] - 0.5) * (b[:, 1] - 0.5)
    linear = 2 * a[:, 1] - b[:, 0] + rng.normal(scale=0.05, size=n)
    grade = (a[:, 0] > 0.5).astype(int) + 2 * (b[:, 1] > 0.5)
    rows = [(f"s{i}", i % FRAGMENTS, Vectors.dense(a[i]), Vectors.dense(b[i]), float(product[i]), float(linear[i]), float(grade[i])) for i in range(n)]
    rows.append(("none", 0, Vectors.dense(a[0]), Vectors.dense(b[0]), None, None, None))
    table = spark.createDataFrame(rows, ["ID", "fragment", "x_a", "x_b", "product", "linear", "grade"])
    return with_folds(table, K_OUTER, K_INNER).withColumn("fragment", F.col("fragment").cast("int")), (a, b, product, linear, grade)


@pytest.fixture(scope="module")
def data(spark):
    table, arrays = make(spark)
    return table.cache(), arrays


def r2(predicted, y):
    return 1 - ((predicted - y) ** 2).sum() / ((y - y.mean()) ** 2).sum()


def test_product_of_two_tables(spark, data):
    vectors, _ = data
    scores = {}
    for name, layout in (("linear", hidden.Layout(("a", "b"), ("product",), hidden=0, hidden_all=0)), ("hidden", hidden.Layout(("a", "b"), ("product",)))):
        log = hidden.sweep_hidden(vectors, layout, n_trials=4)
        found = hidden.predict_hidden(vectors.where("product is not null"), hidden.best_models(log), layout).where("split = 'tst'").toPandas()
        scores[name] = [r2(rows["y_pred"].to_numpy(), rows["product"].to_numpy()) for _, rows in found.groupby(["x_outer", "x_inner"])]
    assert len(scores["hidden"]) == FRAGMENTS
    assert max(scores["linear"]) < 0.3 and min(scores["hidden"]) > 0.7


def test_learners_equal_least_squares_on_rows(spark, data):
    """Each output and each loss, for one setting, from the training rows of one fold."""
    vectors, (a, b, product, linear, _) = data
    layout = hidden.Layout(("a", "b"), ("product", "linear"), hidden=5, hidden_all=4)
    space = {"l2": [0.02], "l2_integrated": [0.3], "width": [0.7]}
    log = hidden.sweep_hidden(vectors, layout, n_trials=1, space=space)
    model = log.where("x_outer = 1 and x_inner = 0").first()
    z = layout.features([a, b], 0.7)
    y = np.column_stack([product, linear])
    split = {s: np.isin(np.arange(len(a)) % FRAGMENTS, fragments_of(s, 1, 0, K_OUTER, K_INNER)) for s in ("trn", "val", "tst")}

    def ridge(rows, columns, l2):
        x = z[rows][:, columns]
        mean, spread = x.mean(axis=0), x.std(axis=0)
        x = (x - mean) / spread
        w = np.linalg.solve(x.T @ x / len(x) + l2 * np.eye(len(columns)), x.T @ (y[rows] - y[rows].mean(axis=0)) / len(x)) / spread[:, None]
        return lambda q: (q[:, columns] - mean) @ w + y[rows].mean(axis=0)

    columns = layout.columns([3, 2])
    assert [len(c) for c in columns] == [8, 7, 9, 19]
    penalties = [0.02, 0.02, 0.02, 0.3]
    fits = [ridge(split["trn"], c, l2) for c, l2 in zip(columns, penalties, strict=True)]
    outputs = np.stack([f(z) for f in fits], axis=1)
    trained = sorted(fragments_of("trn", 1, 0, K_OUTER, K_INNER))
    left, right, n = np.zeros((2, 4, 4)), np.zeros((2, 4)), 0
    for p in range(2):
        out = np.isin(np.arange(len(a)) % FRAGMENTS, trained[p::2])
        others = [ridge(split["trn"] & ~out, c, l2) for c, l2 in zip(columns, penalties, strict=True)]
        held = np.stack([f(z[out]) for f in others], axis=1)
        left += np.einsum("nct,ndt->tcd", held, held)
        right += np.einsum("nct,nt->tc", held, y[out])
        n += out.sum()
    weights = np.array([np.linalg.solve(m + 1e-3 * n * np.eye(4), v) for m, v in zip(left, right, strict=True)]).T
    assert np.array(model["weights"]) == pytest.approx(weights, rel=1e-6)
    scores = np.einsum("nct,ct->nt", outputs, weights)
    for name, s in (("val_loss", "val"), ("test_loss", "tst")):
        assert model[name] == pytest.approx(((scores - y) ** 2)[split[s]].mean(axis=0).sum(), rel=1e-8)
    found = hidden.predict_hidden(vectors.where("x_outer = 1 and x_inner = 0 and ID <> 'none'"), log, layout).toPandas()
    at = found["ID"].str[1:].astype(int).to_numpy()
    assert np.stack(found["scores"].to_numpy()) == pytest.approx(scores[at], rel=1e-7)
    assert np.array(found["outputs"].map(list).tolist())[0] == pytest.approx(outputs[at[0]], rel=1e-7)
    assert found["y_pred_linear"].to_numpy() == pytest.approx(scores[at, 1], rel=1e-7)


def test_classes(spark, data):
    vectors, _ = data
    layout = hidden.Layout(("a", "b"), ("grade",), classes=4)
    log = hidden.sweep_hidden(vectors, layout, n_trials=3)
    found = hidden.predict_hidden(vectors.where("grade is not null"), hidden.best_models(log), layout).where("split = 'tst'")
    assert found.agg(F.avg((F.col("y_pred") == F.col("grade")).cast("double"))).first()[0] > 0.85


def test_jobs_do_not_follow_trials_or_folds(spark, data):
    vectors, _ = data
    layout = hidden.Layout(("a", "b"), ("linear",), hidden=4, hidden_all=4)
    counts = []
    for n, rows in ((1, vectors.where("x_outer = 0 and x_inner = 0")), (20, vectors)):
        spark.sparkContext.setJobGroup(f"trials-{n}", "")
        log = hidden.sweep_hidden(rows, layout, n_trials=n, space={"width": [1.0]})
        assert log.count() == (1 if n == 1 else 20 * FRAGMENTS)
        counts.append(len(spark.sparkContext.statusTracker().getJobIdsForGroup(f"trials-{n}")))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert counts[0] == counts[1]


def test_saved_models_and_errors(spark, data, tmp_path):
    vectors, _ = data
    layout = hidden.Layout(("a", "b"), ("linear",), hidden=4, hidden_all=4)
    log = hidden.sweep_hidden(vectors, layout, n_trials=2, path=f"{tmp_path}/m")
    again, same = hidden.load_hidden(spark, f"{tmp_path}/m")
    assert same == layout and again.count() == 2 * FRAGMENTS
    best = hidden.best_models(log, overall=True)
    assert best.count() == 1
    plain = vectors.where("x_outer = 0 and x_inner = 0").select("ID", "x_a", "x_b")
    assert hidden.predict_hidden(plain, best, layout).where("y_pred is null").count() == 0
    with pytest.raises(ValueError):
        hidden.predict_hidden(plain, log, layout)
    with pytest.raises(ValueError):
        hidden.sweep_hidden(vectors, layout, weights="none")
    assert hidden.predict_hidden(vectors.limit(0), best, layout).count() == 0
    assert len(hidden.draw_settings({"l2": [0.1, 0.2]}, 5, 1)) == 5
    assert hidden.sweep_hidden(vectors.limit(0), layout, n_trials=2).count() == 0


def test_large_groups_are_dealt_over_tasks(spark, data, monkeypatch):
    vectors, _ = data
    layout = hidden.Layout(("a", "b"), ("linear",), hidden=3, hidden_all=2)
    once = {tuple(r)[:5]: np.frombuffer(r["gram"], float) for r in hidden.gram_sums(vectors, layout, [1.0]).collect()}
    monkeypatch.setattr(hidden, "ROWS_A_SUM", 10)
    parts = hidden.gram_sums(vectors, layout, [1.0]).collect()
    assert len(parts) > 2 * len(once)
    for key, gram in once.items():
        assert sum(np.frombuffer(r["gram"], float) for r in parts if tuple(r)[:5] == key) == pytest.approx(gram, rel=1e-9)


def test_trees_as_extractors(spark, data, tmp_path):
    """Forests learn a product that linear extractors can't, and come back from their path."""
    vectors, _ = data
    fold = vectors.where("x_outer = 0 and x_inner = 0 and product is not null").withColumn("y", F.col("product")).withColumn("copy_no", F.lit(0)).cache()
    found = {}
    for kind in models.LEARNERS:
        model = models.fit_dual_extraction(fold, ["a", "b"], learner=kind)
        rows = model.transform(fold.where("split = 'tst'")).toPandas()
        found[kind] = r2(rows["y_pred"].to_numpy(), rows["y"].to_numpy())
    assert found["linear"] < 0.3 and found["trees"] > 0.5
    model.save(f"{tmp_path}/m")
    again = models.DualExtraction.load(spark, f"{tmp_path}/m")
    both = [sorted((r["ID"], r["y_pred"]) for r in m.transform(fold).select("ID", "y_pred").collect()) for m in (model, again)]
    assert both[0] == both[1]
    with pytest.raises(ValueError):
        models.fit_dual_extraction(fold, ["a", "b"], learner="none")
