"""Metrics, trial log, importance, rankings and models."""

from __future__ import annotations

from pyspark.sql import Window
from pyspark.sql import functions as F

from catalog import inputs as i
from catalog.inputs import K_INNER, K_OUTER, N_FRAGMENTS, with_
from catalog.registry import query, r6
from traitframe.functions.scoring import argmax
from traitframe.operators import importance as imp
from traitframe.operators import metrics, samples, trials
from traitframe.operators.folds import random_fragments
from traitframe.plans import hidden, models, ncv, ranking, vectors
from traitframe.session import new_path, stage
from traitframe.sources import folds as fold_files
from traitframe.sources import sinks

# --- metrics ---------------------------------------------------------------------

BY = ["x_outer", "x_inner", "split"]
REGRESSION = """count(*) AS n, round(avg((y_pred - y) * (y_pred - y)), 4) + 0e0 AS mse, round(avg(abs(y_pred - y)), 6) + 0e0 AS mae,
  round(corr(y, y_pred), 6) + 0e0 AS pearson, round(1 - sum((y_pred - y) * (y_pred - y)) / (count(*) * var_pop(y)), 6) + 0e0 AS r2"""


def _rounded(rows):
    return rows.select(
        *[c for c in rows.columns if c not in ("mse", "mae", "pearson", "r2")],
        (F.round("mse", 4) + F.lit(0.0)).alias("mse"), r6("mae").alias("mae"), r6("pearson").alias("pearson"), r6("r2").alias("r2"),
    )


@query("a15_regression", with_(i.PREDICTIONS) + f"SELECT {REGRESSION} FROM predictions")
def a15(spark, sf):
    return _rounded(metrics.regression_metrics(i.predictions(spark, sf)))


@query("a15_missing_labels", with_(i.PREDICTIONS) + f"SELECT {REGRESSION} FROM (SELECT * FROM predictions WHERE length(ID) % 2 = 0)")
def a15_missing(spark, sf):
    rows = i.predictions(spark, sf)
    return _rounded(metrics.regression_metrics(rows.withColumn("y", F.when(F.length("ID") % 2 == 0, F.col("y")))))


@query("m11_fold_evaluation", with_(i.PREDICTIONS) + f"SELECT x_outer, x_inner, split, {REGRESSION} FROM predictions GROUP BY ALL")
def m11(spark, sf):
    return _rounded(metrics.evaluate_folds(i.predictions(spark, sf)))


@query(
    "a15_multi_label_loss",
    with_(i.PREDICTIONS)
    + """SELECT x_outer, round(sum(mse), 4) + 0e0 AS loss FROM (
      SELECT x_outer, l, avg((y_pred * l - y) * (y_pred * l - y)) AS mse FROM predictions, (VALUES (1), (2)) v(l) GROUP BY ALL) GROUP BY ALL""",
)
def a15_multi(spark, sf):
    rows = i.predictions(spark, sf).withColumn("label", F.explode(F.array(F.lit(1), F.lit(2))))
    losses = metrics.multi_label_loss(rows.withColumn("y_pred", F.col("y_pred") * F.col("label")), ["x_outer"])
    return losses.select("x_outer", (F.round("loss", 4) + F.lit(0.0)).alias("loss"))


def _classes(metric):
    return f"""sum(CASE WHEN tp + fp + fn > 0 THEN {metric} END) / count(*) FILTER (tp + fp + fn > 0)"""


CLASSES = """matrix AS (SELECT x_outer, y, y_pred, count(*) AS n FROM class_predictions GROUP BY ALL),
per_class AS (
  SELECT o AS x_outer, c,
    (SELECT coalesce(sum(n), 0) FROM matrix m WHERE m.x_outer = o AND y = c AND y_pred = c)::DOUBLE AS tp,
    (SELECT coalesce(sum(n), 0) FROM matrix m WHERE m.x_outer = o AND y <> c AND y_pred = c)::DOUBLE AS fp,
    (SELECT coalesce(sum(n), 0) FROM matrix m WHERE m.x_outer = o AND y = c AND y_pred <> c)::DOUBLE AS fn
  FROM range(4) a(o), range(3) b(c)),
rates AS (
  SELECT *, tp + fn AS support, CASE WHEN tp + fn > 0 THEN tp / (tp + fn) ELSE 0 END AS recall, CASE WHEN tp + fp > 0 THEN tp / (tp + fp) ELSE 0 END AS prec,
    CASE WHEN 2 * tp + fp + fn > 0 THEN 2 * tp / (2 * tp + fp + fn) ELSE 0 END AS f1 FROM per_class)"""


@query(
    "a16_classification",
    with_(i.CLASS_PREDICTIONS, CLASSES)
    + f"""SELECT CAST(x_outer AS INT) AS x_outer, CAST(sum(support) AS BIGINT) AS n,
    {", ".join(f"round(sum(tp) / sum(support), 6) + 0e0 AS {m}_micro" for m in ("recall", "precision", "f1", "accuracy"))},
    round({_classes("recall")}, 6) + 0e0 AS recall_macro, round({_classes("prec")}, 6) + 0e0 AS precision_macro, round({_classes("f1")}, 6) + 0e0 AS f1_macro,
    round({_classes("recall")}, 6) + 0e0 AS accuracy_macro, round(sum(recall * support) / sum(support), 6) + 0e0 AS recall_weighted,
    round(sum(prec * support) / sum(support), 6) + 0e0 AS precision_weighted, round(sum(f1 * support) / sum(support), 6) + 0e0 AS f1_weighted,
    round(sum(recall * support) / sum(support), 6) + 0e0 AS accuracy_weighted,
    round((sum(tp) * sum(support) - sum((tp + fp) * support)) / sqrt((sum(support) ** 2 - sum((tp + fp) ** 2)) * (sum(support) ** 2 - sum(support ** 2))), 6) + 0e0 AS mcc
    FROM rates GROUP BY x_outer""",
)
def a16(spark, sf):
    rows = metrics.classification_metrics(i.class_predictions(spark, sf).drop("scores"), ["x_outer"])
    return rows.select("x_outer", "n", *[r6(c).alias(c) for c in rows.columns if c not in ("x_outer", "n")])


ONE_VS_REST = """ovr AS (SELECT x_outer, c AS cls, scores[c + 1] AS score, y = c AS positive FROM class_predictions, range(3) t(c)),
ranked AS (
  SELECT *, rank() OVER (PARTITION BY x_outer, cls ORDER BY score) + (count(*) OVER (PARTITION BY x_outer, cls, score) - 1) / 2.0e0 AS r FROM ovr),
areas AS (
  SELECT x_outer, cls, count(*) FILTER (positive) AS support,
    (sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0e0)
      / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)) AS auroc
  FROM ranked GROUP BY ALL)"""


def _one_vs_rest(spark, sf):
    return metrics.one_vs_rest(i.class_predictions(spark, sf), ["x_outer"])


@query("a17_auroc_by_class", with_(i.CLASS_PREDICTIONS, ONE_VS_REST) + "SELECT x_outer, CAST(cls AS INT) AS cls, support, round(auroc, 6) + 0e0 AS auroc FROM areas")
def a17_class(spark, sf):
    return metrics.auroc_by_class(_one_vs_rest(spark, sf), ["x_outer"]).select("x_outer", "cls", "support", r6("auroc").alias("auroc"))


@query(
    "a17_auroc",
    with_(i.CLASS_PREDICTIONS, ONE_VS_REST)
    + "SELECT x_outer, round(avg(auroc), 6) + 0e0 AS auroc_macro, round(sum(auroc * support) / sum(support), 6) + 0e0 AS auroc_weighted FROM areas GROUP BY ALL",
)
def a17(spark, sf):
    return metrics.auroc(_one_vs_rest(spark, sf), ["x_outer"]).select("x_outer", r6("auroc_macro").alias("auroc_macro"), r6("auroc_weighted").alias("auroc_weighted"))


@query(
    "a17_auroc_continuous",
    """WITH ovr AS (SELECT CAST(0 AS INT) AS cls, l_extendedprice * (1 - l_discount) AS score, l_returnflag = 'R' AS positive FROM lineitem),
    ranked AS (SELECT *, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2.0e0 AS r FROM ovr)
    SELECT cls, count(*) FILTER (positive) AS support, round((sum(r) FILTER (positive) - count(*) FILTER (positive) * (count(*) FILTER (positive) + 1) / 2.0e0)
      / (count(*) FILTER (positive) * count(*) FILTER (NOT positive)), 6) + 0e0 AS auroc FROM ranked GROUP BY cls""",
)
def a17_continuous(spark, sf):
    rows = i.table(spark, sf, "lineitem").select(
        F.lit(0).alias("cls"), (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("score"), (F.col("l_returnflag") == "R").alias("positive")
    )
    return metrics.auroc_by_class(rows).select("cls", "support", r6("auroc").alias("auroc"))


@query(
    "a18_cross_entropy",
    with_(i.CLASS_PREDICTIONS)
    + "SELECT x_outer, round(avg(ln(exp(scores[1]) + exp(scores[2]) + exp(scores[3])) - scores[y + 1]), 6) + 0e0 AS loss FROM class_predictions GROUP BY ALL",
)
def a18(spark, sf):
    return metrics.cross_entropy_loss(i.class_predictions(spark, sf), ["x_outer"]).select("x_outer", r6("loss").alias("loss"))


@query(
    "a8_weighted_loss",
    with_(i.PREDICTIONS) + """SELECT x_outer, round(avg(abs(y_pred - y)), 6) + 0e0 AS loss, round(avg(abs(y_pred - y)), 6) + 0e0 AS from_batches FROM predictions GROUP BY ALL""",
)
def a8(spark, sf):
    rows = i.predictions(spark, sf).withColumn("loss", F.abs(F.col("y_pred") - F.col("y")))
    batches = rows.groupBy("x_outer", "x_inner", "split").agg(F.avg("loss").alias("loss"), F.count(F.lit(1)).alias("batch_size"))
    whole = metrics.mean_loss(rows, ["x_outer"]).select("x_outer", r6("loss").alias("loss"))
    parts = metrics.weighted_mean_loss(batches, ["x_outer"]).select("x_outer", r6("loss").alias("from_batches"))
    return whole.join(parts, "x_outer")


# --- trial log -------------------------------------------------------------------

BEST = """best AS (SELECT * FROM trials QUALIFY rank() OVER (PARTITION BY x_outer, x_inner ORDER BY val_loss) = 1),
inner_best AS (SELECT * FROM best QUALIFY rank() OVER (PARTITION BY x_outer ORDER BY test_loss) = 1)"""
TRIAL_COLUMNS = "x_outer, x_inner, val_loss, test_loss, trial_tag, study_tag"
LOG = (i.TRIALS, BEST)


def _columns(rows):
    return rows.select(*TRIAL_COLUMNS.split(", "))


@query("a5_group_minimum", with_(i.TRIALS) + "SELECT x_outer, x_inner, min(val_loss) AS min_loss FROM trials GROUP BY ALL")
def a5(spark, sf):
    return trials.group_minimum(i.trial_log(spark, sf), ["x_outer", "x_inner"], "val_loss")


@query("j6_rows_at_minimum", with_(*LOG) + f"SELECT {TRIAL_COLUMNS} FROM best")
def j6(spark, sf):
    return _columns(trials.rows_at_minimum(i.trial_log(spark, sf), ["x_outer", "x_inner"], "val_loss"))


@query(
    "j5_study_join",
    with_(*LOG) + f"""SELECT s.x_outer, s.x_inner, s.min_loss AS val_loss, b.test_loss, b.trial_tag, b.study_tag FROM (
      SELECT x_outer, x_inner, min(val_loss) AS min_loss FROM trials GROUP BY ALL
      UNION ALL SELECT CAST(x_outer + 100 AS INT), x_inner, max(val_loss) FROM trials GROUP BY ALL) s LEFT JOIN best b USING (x_outer, x_inner)""",
)
def j5(spark, sf):
    log = i.trial_log(spark, sf)
    # studies of folds without any trial stay, with empty trial columns
    extra = log.groupBy((F.col("x_outer") + 100).cast("int").alias("x_outer"), "x_inner").agg(F.max("val_loss").alias("min_loss"))
    studies = trials.group_minimum(log, ["x_outer", "x_inner"], "val_loss").unionByName(extra)
    return _columns(trials.best_trials(log, studies))


@query("j8_inferior", with_(*LOG) + f"SELECT {TRIAL_COLUMNS} FROM trials WHERE trial_tag NOT IN (SELECT trial_tag FROM best)")
def j8(spark, sf):
    return _columns(trials.inferior_trials(i.trial_log(spark, sf)))


@query("m7_leaderboard", with_(*LOG) + f"SELECT 'fold' AS kind, {TRIAL_COLUMNS} FROM best UNION ALL SELECT 'outer', {TRIAL_COLUMNS} FROM inner_best")
def m7(spark, sf):
    best, inner = trials.leaderboard(i.trial_log(spark, sf))
    named = [_columns(rows).select(F.lit(kind).alias("kind"), "*") for kind, rows in (("fold", best), ("outer", inner))]
    return named[0].unionByName(named[1])


@query("t4_log_sort", with_(*LOG) + f"SELECT {TRIAL_COLUMNS} FROM inner_best ORDER BY x_outer, test_loss, trial_tag")
def t4(spark, sf):
    return _columns(trials.leaderboard(i.trial_log(spark, sf))[1])


@query("t5_best_overall", with_(*LOG) + f"SELECT {TRIAL_COLUMNS} FROM inner_best ORDER BY val_loss, trial_tag LIMIT 1")
def t5(spark, sf):
    return _columns(trials.best_overall(trials.best_inner(trials.best_trials(i.trial_log(spark, sf)))))


@query("p12_fold_lookup", with_(*LOG) + f"SELECT {TRIAL_COLUMNS} FROM best WHERE x_outer = 3 AND x_inner = 2 ORDER BY trial_tag LIMIT 1")
def p12(spark, sf):
    return _columns(trials.model_of_fold(trials.best_trials(i.trial_log(spark, sf)), 3, 2))


@query("s16_trial_report", with_(*LOG) + f"SELECT {TRIAL_COLUMNS} FROM inner_best")
def s16(spark, sf):
    best, inner = trials.leaderboard(i.trial_log(spark, sf))
    path = new_path(spark, "s16")
    sinks.write_trial_report(spark, best, inner, path)
    return _columns(sinks.write_trial_report(spark, best, inner, path, overwrite=False)[1])


# --- permutation and rankings -----------------------------------------------------

SEEDS = (55, 66, 77)
PAIRS = f"""pairs AS (
  SELECT a.seed, b.ID, a.ID AS source_ID FROM (
    SELECT seed, ID, row_number() OVER (PARTITION BY seed ORDER BY md5(seed || '|' || ID), ID) AS p FROM samples, (VALUES (55), (66), (77)) v(seed)) a
  JOIN (SELECT ID, row_number() OVER (ORDER BY md5('fixed|' || ID), ID) AS p FROM samples) b USING (p))"""
# linear scorer: weight of dimension j is (j % 7 - 3) / 5
SCORED = """cells AS (SELECT CAST(vec_id AS VARCHAR) AS ID, CAST(j AS INT) AS j, CAST(embedding[j + 1] AS DOUBLE) AS x, (j % 7 - 3) / 5.0e0 AS w, label / 4.0e0 AS y FROM embeddings, range(64) t(j)),
scored AS (SELECT ID, any_value(y) AS y, sum(x * w) AS y_pred FROM cells GROUP BY ID)"""
PERMUTED = """perm_trials AS (
  SELECT c.j, p.seed, avg((s.y_pred + c.w * (o.x - c.x) - s.y) ** 2) AS loss
  FROM cells c JOIN scored s ON s.ID = c.ID JOIN pairs p ON p.ID = c.ID JOIN cells o ON o.ID = p.source_ID AND o.j = c.j GROUP BY ALL),
base AS (SELECT avg((y_pred - y) ** 2) AS loss FROM scored),
scores AS (SELECT j, avg(abs(t.loss - b.loss)) / any_value(b.loss) AS importance FROM perm_trials t, base b GROUP BY j)"""
PERM = (i.SAMPLES, PAIRS, SCORED, PERMUTED)


def _weights():
    return F.array(*[F.lit((j % 7 - 3) / 5.0) for j in range(64)])


def _score(rows):
    terms = F.zip_with("x", _weights(), lambda a, b: a * b)
    return rows.withColumn("y_pred", F.aggregate(terms, F.lit(0.0), lambda a, b: a + b))


def _scored(spark, sf):
    rows = i.table(spark, sf, "embeddings").select(
        F.col("vec_id").cast("string").alias("ID"), F.col("embedding").cast("array<double>").alias("x"), (F.col("label") / 4).alias("y")
    )
    return _score(rows)


def _perm_trials(spark, sf):
    scored = _scored(spark, sf)
    return imp.linear_importance_trials(scored, _weights(), imp.permutation_pairs(scored, SEEDS))


def _importance(spark, sf):
    return imp.importance_scores(_perm_trials(spark, sf), imp.baseline_loss(_scored(spark, sf)))


@query(
    "w4_permute",
    with_(i.OMICS, i.SAMPLES, PAIRS) + "SELECT p.seed, p.ID, o.omics, o.feature, round(o.value, 6) + 0e0 AS value FROM pairs p JOIN omics o ON o.ID = p.source_ID",
)
def w4(spark, sf):
    long = i.omics_long(spark, sf).drop("feature_idx")
    return imp.permute_features(long, imp.permutation_pairs(i.samples(spark, sf), SEEDS)).select("seed", "ID", "omics", "feature", r6("value").alias("value"))


@query("m9_perm_trials", with_(*PERM) + "SELECT j, seed, round(loss, 6) + 0e0 AS loss FROM perm_trials")
def m9_trials(spark, sf):
    return _perm_trials(spark, sf).select("j", "seed", r6("loss").alias("loss"))


@query("m9_perm_importance", with_(*PERM) + "SELECT j, round(importance, 6) + 0e0 AS importance FROM scores")
def m9(spark, sf):
    return _importance(spark, sf).select("j", r6("importance").alias("importance"))


@query("m9_perm_importance_any_model", with_(*PERM) + "SELECT j, round(importance, 6) + 0e0 AS importance FROM scores")
def m9_any(spark, sf):
    scored = _scored(spark, sf)
    runs = imp.importance_trials(scored.drop("y_pred"), _score, imp.permutation_pairs(scored, SEEDS), 64)
    return imp.importance_scores(runs, imp.baseline_loss(scored)).select("j", r6("importance").alias("importance"))


@query(
    "a9_importance_score",
    with_(i.PREDICTIONS)
    + """, t AS (SELECT x_outer, x_inner, avg(abs(y_pred - y)) AS loss FROM predictions GROUP BY ALL), b AS (SELECT avg(abs(y_pred - y)) AS loss FROM predictions)
    SELECT x_outer, round(avg(abs(t.loss - b.loss)) / any_value(b.loss), 6) + 0e0 AS importance FROM t, b GROUP BY x_outer""",
)
def a9(spark, sf):
    rows = i.predictions(spark, sf).withColumn("loss", F.abs(F.col("y_pred") - F.col("y")))
    runs = metrics.mean_loss(rows, ["x_outer", "x_inner"])
    return imp.importance_scores(runs, metrics.mean_loss(rows), ["x_outer"]).select("x_outer", r6("importance").alias("importance"))


@query("t3_ranking_sort", with_(i.RANKINGS) + "SELECT omics, feature, importance FROM rankings ORDER BY importance DESC, omics, feature")
def t3(spark, sf):
    return imp.sort_ranking(i.rankings(spark, sf)).select("omics", "feature", "importance")


MERGED = """shared AS (
  SELECT omics, feature, max(importance) FILTER (x_outer = 0) AS i1, max(importance) FILTER (x_outer = 1) AS i2, max(importance) FILTER (x_outer = 2) AS i3
  FROM rankings GROUP BY ALL HAVING count(DISTINCT x_outer) = 3),
merged AS (
  SELECT omics, feature, (i1 - min(i1) OVER ()) / (max(i1) OVER () - min(i1) OVER ()) AS test_1,
    (i2 - min(i2) OVER ()) / (max(i2) OVER () - min(i2) OVER ()) AS test_2, (i3 - min(i3) OVER ()) / (max(i3) OVER () - min(i3) OVER ()) AS test_3 FROM shared)"""


@query("j7_shared_features", with_(i.RANKINGS, MERGED) + "SELECT omics, feature, i1 AS importance_1, i2 AS importance_2, i3 AS importance_3 FROM shared")
def j7(spark, sf):
    return imp.shared_features(i.rankings(spark, sf), [0, 1, 2])


def _merged(rows):
    return rows.select("omics", "feature", *[r6(c).alias(c) for c in rows.columns[2:]])


MERGED_ROWS = """SELECT omics, feature, round((test_1 + test_2 + test_3) / 3, 6) + 0e0 AS average, round(test_1, 6) + 0e0 AS test_1,
  round(test_2, 6) + 0e0 AS test_2, round(test_3, 6) + 0e0 AS test_3 FROM merged"""


@query("a19_rank_normalise", with_(i.RANKINGS, MERGED) + "SELECT omics, feature, round(test_1, 6) + 0e0 AS test_1 FROM merged")
def a19(spark, sf):
    return _merged(imp.merge_rankings(i.rankings(spark, sf), [0, 1, 2]).select("omics", "feature", "test_1"))


@query("m10_rank_merge", with_(i.RANKINGS, MERGED) + MERGED_ROWS)
def m10(spark, sf):
    return _merged(imp.merge_rankings(i.rankings(spark, sf)))


@query("s13_ranking_writer", with_(i.RANKINGS, MERGED) + MERGED_ROWS)
def s13(spark, sf):
    path = new_path(spark, "s13")
    sinks.write_ranking(imp.merge_rankings(i.rankings(spark, sf)), path)
    return _merged(spark.read.parquet(f"{path}/ranking"))


# --- models ----------------------------------------------------------------------
# Numbers of a fit are not SQL's to tell. What is known of them is: which rows come out, and, as height is
# made of dimensions 0, 40 and 10, that a model beats the mean by far and which features lead.

KEYS = ["x_outer", "x_inner", "split", "ID", "copy_no"]
UNPADDED = with_(i.SAMPLES, i.FRAGMENTS, i.ROLES).replace("md5('42|' || ID)", "md5('42|' || ID || '|0')")
ALL_FOLDS = "FROM fragments f JOIN roles r USING (fragment)"
PREDICTED = UNPADDED + f"SELECT r.x_outer, r.x_inner, r.split, f.ID, CAST(0 AS INT) AS copy_no, true AS predicted {ALL_FOLDS}"


def _prepared(spark, sf, only=None, label="height"):
    labels = samples.melt_labels(i.wide_labels(spark, sf)).where(F.col("label") == label)
    return ncv.prepare_ncv(i.omics_long(spark, sf), labels, K_OUTER, K_INNER, only=only, pad="none", prepare_labels=label == "height")


def _vectors(spark, sf, done=None, **settings):
    """Prepared vectors of every fold; every sample is in each."""
    done = done or _prepared(spark, sf, **settings)
    keys = [*KEYS, "fragment"]
    return stage(vectors.sample_vectors(done.omics, keys, ["a", "b"]).join(done.labels.select(*keys, "y"), keys), "vectors")


HEIGHT = hidden.Layout(("a", "b"), ("y",), hidden=32, hidden_all=64)
GRADE = hidden.Layout(("a", "b"), ("y",), classes=10, hidden=32, hidden_all=64)


@query("m4_dual_extraction", UNPADDED + f"SELECT r.x_outer, r.x_inner, r.split, count(*) AS n, true AS beats_mean {ALL_FOLDS} GROUP BY ALL")
def m4(spark, sf):
    data = _vectors(spark, sf)
    model = hidden.best_models(hidden.sweep_hidden(data, HEIGHT, n_trials=2))
    scored = metrics.regression_metrics(hidden.predict_hidden(data, model, HEIGHT), ["x_outer", "x_inner", "split"])
    return scored.select("x_outer", "x_inner", "split", "n", (F.col("r2") > 0.5).alias("beats_mean"))


@query("m4_dual_extraction_classes", UNPADDED + f"SELECT r.x_outer, r.x_inner, r.split, count(*) AS n, true AS all_in_classes {ALL_FOLDS} GROUP BY ALL")
def m4_classes(spark, sf):
    data = _vectors(spark, sf, label="grade")
    model = hidden.best_models(hidden.sweep_hidden(data, GRADE, n_trials=2))
    inside = F.bool_and(F.col("y_pred").between(0, F.size("scores") - 1) & (F.col("y_pred") == F.floor("y_pred")))
    scored = hidden.predict_hidden(data, model, GRADE).groupBy("x_outer", "x_inner", "split")
    return scored.agg(F.count(F.lit(1)).alias("n"), inside.alias("all_in_classes"))


@query("m4_dual_extraction_traits", UNPADDED + f"SELECT r.x_outer, r.x_inner, r.split, count(*) AS n, true AS height_beats_mean, true AS grade_predicted {ALL_FOLDS} GROUP BY ALL")
def m4_traits(spark, sf):
    """Two traits in one fit, each a label column."""
    done = ncv.prepare_ncv(i.omics_long(spark, sf), samples.melt_labels(i.wide_labels(spark, sf)), K_OUTER, K_INNER, pad="none")
    keys = [*KEYS, "fragment"]
    traits = done.labels.groupBy(*keys).pivot("label", ["height", "grade"]).agg(F.first("y"))
    data = stage(vectors.sample_vectors(done.omics, keys, ["a", "b"]).join(traits, keys), "vectors")
    layout = hidden.Layout(("a", "b"), ("height", "grade"), hidden=32, hidden_all=64)
    found = hidden.predict_hidden(data, hidden.best_models(hidden.sweep_hidden(data, layout, n_trials=2)), layout)
    folds = ["x_outer", "x_inner", "split"]
    scored = metrics.regression_metrics(found.select(*folds, F.col("height").alias("y"), F.col("y_pred_height").alias("y_pred")), folds)
    told = found.groupBy(*folds).agg(F.bool_and(F.col("y_pred_grade").isNotNull()).alias("grade_predicted"))
    return scored.join(told, folds).select(*folds, "n", (F.col("r2") > 0.5).alias("height_beats_mean"), "grade_predicted")


COMBINED = """SELECT vec_id, round(0.25e0 * (embedding[1] + 0e0) + 0.25e0 * (embedding[2] + 0e0) + 1.5e0 * (embedding[3] + 0e0) + 0.5e0 * (embedding[4] + 0e0), 6) + 0e0 AS y_pred FROM embeddings"""


@query("m5_combination", COMBINED)
def m5(spark, sf):
    names = {"a": 0.25, "b": 0.25, "concatenated": 1.5, "integrated": 0.5}
    rows = i.table(spark, sf, "embeddings")
    outputs = rows.select("vec_id", *[F.array(F.col("embedding")[k].cast("double")).alias(f"s_{n}") for k, n in enumerate(names)])
    return models.combine(outputs, names, regression=True).select("vec_id", r6("y_pred").alias("y_pred"))


@query(
    "m6_sweep",
    f"""SELECT CAST(o AS INT) AS x_outer, CAST(n AS INT) AS x_inner, 't' || o || '_' || n || '_' || k AS trial_tag, true AS has_losses, true AS winner_is_least
    FROM range({K_OUTER}) a(o), range({K_INNER}) b(n), range(10) c(k)""",
)
def m6(spark, sf):
    """Ten trials in every fold: one pass over the rows, one factorisation for all penalties of a fold."""
    log = hidden.sweep_hidden(_vectors(spark, sf), HEIGHT, n_trials=10)
    best = trials.best_trials(log).select("x_outer", "x_inner", F.col("val_loss").alias("least"))
    rows = log.join(best, ["x_outer", "x_inner"])
    return rows.select("x_outer", "x_inner", "trial_tag", (F.col("val_loss").isNotNull() & F.col("test_loss").isNotNull()).alias("has_losses"), (F.col("least") <= F.col("val_loss")).alias("winner_is_least"))


@query("m8_predict_fold", PREDICTED)
def m8(spark, sf):
    """Every fold by the best of its three models."""
    data = _vectors(spark, sf)
    log = hidden.sweep_hidden(data, HEIGHT, n_trials=3)
    return hidden.predict_hidden(data, hidden.best_models(log), HEIGHT).select(*KEYS, F.col("y_pred").isNotNull().alias("predicted"))


@query("m8_predict_saved", PREDICTED)
def m8_saved(spark, sf):
    """The models as read from their path predict what the fitted ones do."""
    data, path = _vectors(spark, sf), new_path(spark, "models")
    log = hidden.sweep_hidden(data, HEIGHT, n_trials=2, path=path)
    ours = hidden.predict_hidden(data, hidden.best_models(log), HEIGHT).select(*KEYS, "y_pred")
    read, layout = hidden.load_hidden(spark, path)
    again = hidden.predict_hidden(data, hidden.best_models(read), layout).select(*KEYS, F.col("y_pred").alias("again"))
    return ours.join(again, KEYS).select(*KEYS, (F.col("y_pred") == F.col("again")).alias("predicted"))


@query("m8_predict_overall", "SELECT CAST(vec_id AS VARCHAR) AS ID, true AS predicted FROM embeddings")
def m8_overall(spark, sf):
    """Samples without folds, by the best of the models of all folds."""
    data = _vectors(spark, sf)
    best = hidden.best_models(hidden.sweep_hidden(data, HEIGHT, n_trials=2), overall=True)
    # every sample is in every fold; one fold's scaling stands for that of new samples
    new = data.join(best.select("x_outer", "x_inner"), ["x_outer", "x_inner"], "left_semi").select("ID", "x_a", "x_b")
    return hidden.predict_hidden(new, best, HEIGHT).select("ID", F.col("y_pred").isNotNull().alias("predicted"))


@query(
    "m9_rank_outer_fold",
    "SELECT CAST(0 AS INT) AS place, 'a' AS omics, 'f00' AS feature UNION ALL SELECT 1, 'b', 'f40' UNION ALL SELECT 2, 'a', 'f10'",
)
def m9_rank(spark, sf):
    done = _prepared(spark, sf, (0, 0))
    data = _vectors(spark, sf, done)
    log, fitted = models.sweep(data, ["a", "b"], [(0, 0)], n_trials=1)
    ranked = ranking.rank_outer_fold(data, log, fitted, vectors.feature_order(done.omics), 0, SEEDS)
    best = ranked.orderBy(F.desc("importance"), "omics", "feature").limit(3)  # a report of the three that lead
    place = F.row_number().over(Window.orderBy(F.desc("importance"), "omics", "feature")) - 1
    return best.select(place.cast("int").alias("place"), "omics", "feature")


@query(
    "s11_prediction_writer",
    with_(i.PREDICTIONS) + "SELECT x_outer, x_inner, split, ID, y, y_pred FROM predictions",
)
def s11(spark, sf):
    path = new_path(spark, "s11")
    sinks.write_predictions(i.predictions(spark, sf), path)
    return fold_files.read_folds(spark, path).select("x_outer", "x_inner", "split", "ID", "y", "y_pred")


@query(
    "j10_keys_carried",
    """SELECT CAST(vec_id AS VARCHAR) AS ID, CAST(list_position(embedding, list_max(embedding)) - 1 AS INT) AS cls,
    CAST(ntile(12) OVER (ORDER BY md5('42|' || vec_id), vec_id) - 1 AS INT) AS fragment FROM embeddings""",
)
def j10(spark, sf):
    rows = i.table(spark, sf, "embeddings").select(F.col("vec_id").cast("string").alias("ID"), argmax(F.col("embedding")).alias("cls"))
    cut = random_fragments(i.samples(spark, sf), N_FRAGMENTS).select("ID", "fragment")
    return rows.join(cut, "ID").select("ID", "cls", "fragment")
