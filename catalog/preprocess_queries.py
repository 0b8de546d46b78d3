"""Imputation, variance filter, scaling, feature selection; fitted on training rows of every fold."""

from __future__ import annotations

from pyspark.sql import functions as F

from catalog import inputs as i
from catalog.inputs import K_INNER, K_OUTER, N_FRAGMENTS, with_
from catalog.registry import query, r6
from traitframe.operators import folds, samples
from traitframe.operators import preprocess as pre
from traitframe.operators.steps import MaxAbsScale, SeenFilter
from traitframe.plans import forest, ncv
from traitframe.session import new_path, stage
from traitframe.sources import sinks

FOLD_FEATURE = ["x_outer", "x_inner", "omics", "feature"]


def _cut(spark, sf):
    return folds.random_fragments(i.samples(spark, sf), N_FRAGMENTS).select("ID", "fragment")


def placed(spark, sf):
    """Omics rows with their fragment."""
    return pre.attach(i.omics_long(spark, sf), _cut(spark, sf))


def placed_labels(spark, sf):
    return pre.attach(samples.labels_as_omics(samples.melt_labels(i.wide_labels(spark, sf))), _cut(spark, sf))


def statistics(spark, sf):
    return pre.fold_statistics(placed(spark, sf), K_OUTER, K_INNER)


LABEL_STATS = """label_trained AS (
  SELECT r.x_outer, r.x_inner, t.label, t.y FROM labels_long t JOIN fragments f ON f.ID = t.ID JOIN roles r ON r.fragment = f.fragment WHERE r.split = 'trn'),
label_stats AS (
  SELECT x_outer, x_inner, label, avg(y) AS mean, sqrt(var_pop(y) * count(y) / count(*)) AS deviation FROM label_trained GROUP BY ALL)"""
LABELLED = (i.WIDE_LABELS, i.LABELS, i.SAMPLES, i.FRAGMENTS, i.ROLES, LABEL_STATS)

IMPUTED = "SELECT t.ID, s.x_outer, s.x_inner, s.omics, s.feature, round(coalesce(t.value, s.mean), 6) + 0e0 AS value FROM omics t JOIN stats s USING (omics, feature)"
SCALED = """SELECT t.ID, s.x_outer, s.x_inner, s.omics, s.feature,
  round((coalesce(t.value, s.mean) - s.lo) / CASE WHEN s.hi = s.lo THEN 1 ELSE s.hi - s.lo END, 6) + 0e0 AS value
  FROM omics t JOIN stats s USING (omics, feature)"""
ZSCORED = """SELECT t.ID, s.x_outer, s.x_inner, 'label' AS omics, t.label AS feature,
  round((coalesce(t.y, s.mean) - s.mean) / CASE WHEN s.deviation = 0 THEN 1 ELSE s.deviation END, 6) + 0e0 AS value
  FROM labels_long t JOIN label_stats s USING (label)"""


def _shown(rows):
    return rows.select("ID", *FOLD_FEATURE, r6("value").alias("value"))


@query("a1_train_mean", with_(*i.PREPARED) + "SELECT x_outer, x_inner, omics, feature, n, round(mean, 6) + 0e0 AS mean FROM stats")
def a1(spark, sf):
    return statistics(spark, sf).select(*FOLD_FEATURE, "n", r6("mean").alias("mean"))


@query("a2_train_variance", with_(*i.PREPARED) + "SELECT x_outer, x_inner, omics, feature, round(variance, 6) + 0e0 AS variance FROM stats")
def a2(spark, sf):
    return statistics(spark, sf).select(*FOLD_FEATURE, r6("variance").alias("variance"))


@query("a3_train_min_max", with_(*i.PREPARED) + "SELECT x_outer, x_inner, omics, feature, round(lo, 6) + 0e0 AS lo, round(hi, 6) + 0e0 AS hi FROM stats")
def a3(spark, sf):
    return statistics(spark, sf).select(*FOLD_FEATURE, r6("lo").alias("lo"), r6("hi").alias("hi"))


@query("a4_label_mean_std", with_(*LABELLED) + "SELECT x_outer, x_inner, label, round(mean, 6) + 0e0 AS mean, round(deviation, 6) + 0e0 AS deviation FROM label_stats")
def a4(spark, sf):
    stats = pre.fold_statistics(placed_labels(spark, sf), K_OUTER, K_INNER)
    return stats.select("x_outer", "x_inner", F.col("feature").alias("label"), r6("mean").alias("mean"), r6(F.sqrt("variance")).alias("deviation"))


@query("n1_mean_imputation", with_(*i.PREPARED) + IMPUTED)
def n1(spark, sf):
    rows = placed(spark, sf)
    return _shown(pre.impute(rows, pre.fit_omics(rows, K_OUTER, K_INNER)))


@query("n2_variance_filter", with_(*i.PREPARED) + "SELECT x_outer, x_inner, omics, feature FROM stats WHERE variance > 0.016e0")
def n2(spark, sf):
    params = pre.fit_omics(placed(spark, sf), K_OUTER, K_INNER, threshold=0.016)
    return pre.kept_features(params.where(F.col("kind") == "variance"))


@query("n3_minmax_by_fold", with_(*i.PREPARED) + SCALED)
def n3(spark, sf):
    rows = placed(spark, sf)
    stats = pre.fold_statistics(rows, K_OUTER, K_INNER)
    return _shown(pre.apply_steps(rows, pre.steps_from_statistics(stats, ["impute", "minmax"])))


@query("n4_zscore", with_(*LABELLED) + ZSCORED)
def n4(spark, sf):
    rows = placed_labels(spark, sf)
    return _shown(pre.apply_steps(rows, pre.fit_labels(rows, K_OUTER, K_INNER)))


@query(
    "n5_pipeline",
    # rows are identified by ID and copy number here
    with_(*i.PREPARED, i.WIDE_LABELS, i.LABELS, LABEL_STATS).replace("md5('42|' || ID)", "md5('42|' || ID || '|0')") + SCALED + " WHERE s.variance > 0.01e0 UNION ALL " + ZSCORED,
)
def n5(spark, sf):
    done = ncv.prepare_ncv(i.omics_long(spark, sf), samples.melt_labels(i.wide_labels(spark, sf)), K_OUTER, K_INNER, pad="none")
    labels = done.labels.select("ID", "x_outer", "x_inner", F.lit("label").alias("omics"), F.col("label").alias("feature"), F.col("y").alias("value"))
    return _shown(done.omics.select("ID", *FOLD_FEATURE, "value").unionByName(labels))


@query(
    "n5_user_steps",
    with_(*i.PREPARED).replace("md5('42|' || ID)", "md5('42|' || ID || '|0')")
    + """SELECT t.ID, s.x_outer, s.x_inner, s.omics, s.feature, round(coalesce(t.value, s.mean) / CASE WHEN greatest(abs(s.lo), abs(s.hi)) = 0 THEN 1
      ELSE greatest(abs(s.lo), abs(s.hi)) END, 6) + 0e0 AS value FROM omics t JOIN stats s USING (omics, feature) WHERE s.n >= 0.9e0 * s.n_rows""",
)
def n5_user(spark, sf):
    """Steps of the user's own, written with the samples and applied when a fold is read."""
    mine = ["impute", SeenFilter(0.9), MaxAbsScale()]
    done = ncv.prepare_ncv(i.omics_long(spark, sf), None, K_OUTER, K_INNER, pad="none", steps=mine)
    path = new_path(spark, "n5-user")
    ncv.write_once(done, path)
    saved = spark.read.parquet(f"{path}/steps")
    return _shown(ncv.apply_preprocessors(i.omics_long(spark, sf), None, saved)[0])


@query("j1_sparse_repeats", "SELECT l_orderkey, l_linenumber FROM (SELECT l_orderkey, l_linenumber, l_linestatus, l_partkey FROM lineitem) GROUP BY ALL")
def j1_sparse(spark, sf):
    """Orders as samples, line numbers as features, sparse; every third order comes twice and is told once."""
    cells = i.table(spark, sf, "lineitem").select(
        F.col("l_orderkey").cast("string").alias("ID"), F.lit("o").alias("omics"), F.col("l_linenumber").alias("feature_idx"),
        F.concat(F.lit("f"), "l_linenumber").alias("feature"), F.col("l_quantity").alias("value"),
    )
    twice = cells.unionByName(cells.where(F.col("ID").cast("bigint") % 3 == 0).withColumn("value", F.col("value") + 1000))
    once = samples.first_occurrences(twice).where("value < 1000")
    return once.select(F.col("ID").cast("bigint").alias("l_orderkey"), F.col("feature_idx").alias("l_linenumber"))


@query(
    "s8_written_once",
    with_(*i.PREPARED).replace("md5('42|' || ID)", "md5('42|' || ID || '|0')")
    + SCALED.replace("JOIN stats s USING (omics, feature)", "JOIN stats s USING (omics, feature) JOIN fragments f ON f.ID = t.ID JOIN roles r ON r.fragment = f.fragment AND r.x_outer = s.x_outer AND r.x_inner = s.x_inner")
    + " WHERE s.variance > 0.01e0 AND s.x_outer = 1 AND s.x_inner = 2 AND r.split = 'tst'",
)
def s8_once(spark, sf):
    path = new_path(spark, "s8-once")
    ncv.write_once(ncv.prepare_ncv(i.omics_long(spark, sf), None, K_OUTER, K_INNER, pad="none"), path)
    return _shown(ncv.read_once(spark, path, K_OUTER, K_INNER, 1, 2, "tst"))


@query("n9_saved_steps", with_(*i.PREPARED) + SCALED + " WHERE s.variance > 0.01e0")
def n9(spark, sf):
    saved = stage(pre.fit_omics(placed(spark, sf), K_OUTER, K_INNER), "steps")
    return _shown(ncv.apply_preprocessors(i.omics_long(spark, sf), None, saved)[0])


@query("s9_external_writer", with_(*i.PREPARED) + SCALED + " WHERE s.variance > 0.01e0")
def s9(spark, sf):
    path = new_path(spark, "s9")
    sinks.write_table(pre.fit_omics(placed(spark, sf), K_OUTER, K_INNER), f"{path}/steps")
    ncv.apply_preprocessors(i.omics_long(spark, sf), None, spark.read.parquet(f"{path}/steps"), f"{path}/data")
    return _shown(spark.read.parquet(f"{path}/data/omics"))


IMPORTANCES = """importances AS (
  SELECT CAST(l_orderkey % 4 AS INT) AS x_outer, CAST(l_orderkey % 3 AS INT) AS x_inner, l_linestatus AS omics, 's' || l_suppkey AS feature,
         l_linenumber AS seed, max(l_extendedprice) AS importance FROM lineitem GROUP BY ALL),
means AS (SELECT x_outer, x_inner, omics, feature, avg(importance) AS importance FROM importances GROUP BY ALL)"""


def _importances(spark, sf):
    rows = i.table(spark, sf, "lineitem").groupBy(
        (F.col("l_orderkey") % 4).cast("int").alias("x_outer"), (F.col("l_orderkey") % 3).cast("int").alias("x_inner"),
        F.col("l_linestatus").alias("omics"), F.concat(F.lit("s"), "l_suppkey").alias("feature"), F.col("l_linenumber").alias("seed"),
    )
    return rows.agg(F.max("l_extendedprice").alias("importance"))


@query("a7_mean_importance", with_(IMPORTANCES) + "SELECT x_outer, x_inner, omics, feature, round(importance, 4) + 0e0 AS importance FROM means")
def a7(spark, sf):
    return forest.mean_importance(_importances(spark, sf)).select(*FOLD_FEATURE, (F.round("importance", 4) + F.lit(0.0)).alias("importance"))


@query(
    "t2_top_features",
    with_(IMPORTANCES)
    + """SELECT x_outer, x_inner, omics, feature, rn FROM (
      SELECT *, CAST(row_number() OVER (PARTITION BY x_outer, x_inner, omics ORDER BY round(importance, 4) DESC, feature) AS INT) AS rn FROM means) WHERE rn <= 10""",
)
def t2(spark, sf):
    mean = forest.mean_importance(_importances(spark, sf)).withColumn("importance", F.round("importance", 4))
    return forest.top_features(mean, 10).where("keep").select(*FOLD_FEATURE, F.col("rank").alias("rn"))


# height is 20 x0 - 10 x40 + 5 x10: the first of table a is f00, that of table b f40
@query("m1_forest_selection", "SELECT CAST(0 AS INT) AS x_outer, CAST(0 AS INT) AS x_inner, o AS omics, CAST(10 AS BIGINT) AS kept, f AS leading FROM (VALUES ('a', 'f00'), ('b', 'f40')) t(o, f)")
def m1(spark, sf):
    done = ncv.prepare_ncv(
        i.omics_long(spark, sf), samples.melt_labels(i.wide_labels(spark, sf)).where("label = 'height'"), K_OUTER, K_INNER, only=(0, 0),
        forest=ncv.ForestSettings(n_features=10, n_trees=10, seeds=(42, 43), max_depth=5),
    )
    chosen = done.params.where("kind = 'forest' and keep")
    return chosen.groupBy("x_outer", "x_inner", "omics").agg(F.count(F.lit(1)).alias("kept"), F.max_by("feature", "p1").alias("leading"))


@query(
    "s9_external_metadata",
    f"""SELECT CAST(o AS INT) AS x_outer, CAST(k AS INT) AS x_inner, omics, n AS omics_dim
    FROM range({K_OUTER}) x(o), range({K_INNER}) y(k), (VALUES ('a', CAST(31 AS BIGINT)), ('b', CAST(32 AS BIGINT))) t(omics, n)""",
)
def s9_metadata(spark, sf):
    """The metadata of an external dataset describes what was written: f31, a constant that every fold dropped, is not in it."""
    path = new_path(spark, "s9-metadata")
    steps = stage(pre.fit_omics(placed(spark, sf), K_OUTER, K_INNER, threshold=0.0), "steps")
    ncv.apply_preprocessors(i.omics_long(spark, sf), None, steps, path)
    return spark.read.parquet(f"{path}/metadata/omics_dims").select("x_outer", "x_inner", "omics", "omics_dim")
