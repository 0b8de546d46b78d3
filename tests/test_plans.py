from __future__ import annotations

import numpy as np
import pytest
from pyspark.errors import StreamingQueryException
from pyspark.sql import functions as F

from conftest import rows
from traitframe.functions.folds import fragments_of
from traitframe.operators import metrics, samples
from traitframe.operators.folds import fold_roles
from traitframe.operators.preprocess import apply_steps
from traitframe.operators.trials import best_trials
from traitframe.plans import models, ncv, ranking, vectors
from traitframe.sources import folds as fold_files
from traitframe.streaming import apply_steps_stream

N = 50


@pytest.fixture(scope="module")
def tables(spark):
    rng = np.random.default_rng(11)
    x = rng.normal(size=(N, 6))
    y = 3 * x[:, 1] - 2 * x[:, 4] + rng.normal(scale=0.1, size=N)
    wide = [(f"s{i:02d}", *map(float, row)) for i, row in enumerate(x)]
    a = samples.melt_omics(spark.createDataFrame([w[:4] for w in wide], "ID string, a0 double, a1 double, a2 double"), "a")
    b = samples.melt_omics(spark.createDataFrame([(w[0], *w[4:]) for w in wide[2:]], "ID string, b0 double, b1 double, b2 double"), "b")
    labels = spark.createDataFrame([(f"s{i:02d}", "t", float(v)) for i, v in enumerate(y)] + [("zz", "t", 0.0)], "ID string, label string, y double")
    return a.unionByName(b), labels


@pytest.fixture(scope="module")
def prepared(tables):
    return ncv.prepare_ncv(*tables, 4, 3, forest=ncv.ForestSettings(n_features=2, n_trees=8, seeds=(42, 43), max_depth=4), only=(0, 0))


@pytest.fixture(scope="module")
def vecs(prepared):
    keys = ["x_outer", "x_inner", "split", "ID", "copy_no", "fragment"]
    return vectors.sample_vectors(prepared.omics, keys).join(prepared.labels.select(*keys, "y"), keys).cache()


def test_prepared_rows(prepared):
    # 48 shared samples fill 12 fragments without padding
    assert prepared.samples.groupBy("split").count().orderBy("split").collect() == [("trn", 24), ("tst", 12), ("val", 12)]
    assert prepared.omics.select("ID").distinct().count() == 48
    # the informative feature of each table is among the two kept
    kept = {r["feature"] for r in prepared.params.where("kind = 'forest' and keep").collect()}
    assert len(kept) == 4 and {"a1", "b1"} <= kept
    assert {r["feature"] for r in prepared.omics.select("feature").distinct().collect()} == kept
    train = prepared.omics.where("split = 'trn'").groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    assert {tuple(r)[1:] for r in train.collect()} == {(0.0, 1.0)}
    z = prepared.labels.where("split = 'trn'").agg(F.avg("y"), F.stddev_pop("y")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)


def test_written_dataset_and_external_data(spark, tables, tmp_path):
    done = ncv.prepare_ncv(*tables, 4, 3, only=(1, 2))
    ncv.write_prepared(done, f"{tmp_path}/d")
    back = fold_files.read_folds(spark, f"{tmp_path}/d/omics", 1, 2, "tst")
    assert rows(back, "ID", "feature") == rows(done.omics.where("split = 'tst'"), "ID", "feature")
    assert spark.read.parquet(f"{tmp_path}/d/metadata/output_dim").first()[0] == 1
    saved = spark.read.parquet(f"{tmp_path}/d/steps")
    omics, labels = tables
    again, again_labels = ncv.apply_preprocessors(omics, labels, saved, f"{tmp_path}/e")
    shared = again.join(done.omics.select("ID").distinct(), "ID")
    cols = ["ID", "feature", F.round("value", 9).alias("v")]
    assert rows(shared.select(*cols)) == rows(done.omics.select(*cols))
    assert spark.read.parquet(f"{tmp_path}/e/labels").count() == again_labels.count() == N + 1
    with pytest.raises(ValueError):
        ncv.apply_preprocessors(omics.withColumn("omics", F.lit("new")), None, saved)


def test_saved_steps_on_a_stream(spark, tables, tmp_path):
    done = ncv.prepare_ncv(*tables, 4, 3, only=(0, 0))
    omics = tables[0].where("omics = 'a'")
    omics.write.parquet(f"{tmp_path}/in")
    done.params.write.parquet(f"{tmp_path}/steps")
    params = spark.read.parquet(f"{tmp_path}/steps")
    out = apply_steps_stream(spark.readStream.schema(omics.schema).parquet(f"{tmp_path}/in"), params)
    run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/cp").trigger(availableNow=True).start()
    run.awaitTermination(120)
    cols = ["ID", "feature", F.round("value", 9).alias("v")]
    assert rows(spark.read.parquet(f"{tmp_path}/out").select(*cols)) == rows(ncv.apply_preprocessors(omics, None, params)[0].select(*cols))


def test_streams_match_folds_and_refuse_unknown_features(spark, tables, tmp_path):
    done = ncv.prepare_ncv(*tables, 4, 3)
    done.params.write.parquet(f"{tmp_path}/steps")
    params = spark.read.parquet(f"{tmp_path}/steps")
    omics = tables[0].where("omics = 'a'")
    folds = F.explode(F.array(*[F.struct(F.lit(o).alias("x_outer"), F.lit(1).alias("x_inner")) for o in (0, 2)])).alias("fold")
    omics.select("*", folds).select("*", "fold.*").drop("fold").write.parquet(f"{tmp_path}/in")
    omics.withColumn("feature", F.lit("new")).write.parquet(f"{tmp_path}/other")

    def run(name):
        rows_in = spark.read.parquet(f"{tmp_path}/{name}")
        out = apply_steps_stream(spark.readStream.schema(rows_in.schema).parquet(f"{tmp_path}/{name}"), params)
        query = out.writeStream.format("parquet").option("path", f"{tmp_path}/out-{name}").option("checkpointLocation", f"{tmp_path}/cp-{name}").trigger(availableNow=True).start()
        query.awaitTermination(120)
        return spark.read.parquet(f"{tmp_path}/out-{name}")

    cols = ["x_outer", "x_inner", "ID", "feature", F.round("value", 9).alias("v")]
    assert rows(run("in").select(*cols)) == rows(apply_steps(omics, params.where("x_outer in (0, 2) and x_inner = 1")).select(*cols))
    with pytest.raises(StreamingQueryException, match="no fitted steps"):
        run("other")


def test_padding_and_raw_codes(tables):
    omics, labels = tables
    coded = omics.withColumn("value", F.when(F.col("omics") == "b", 7.0).otherwise(F.col("value")))
    done = ncv.prepare_ncv(coded, labels, 5, 2, codes=["b"], only=(0, 0))
    assert done.samples.count() == 50 and done.samples.where("copy_no > 0").count() == 2
    assert rows(done.omics.where("omics = 'b'").select("value").distinct()) == [(7.0,)]
    none = ncv.prepare_ncv(omics, labels, 5, 2, pad="none", prepare_omics=False, prepare_labels=False)
    assert none.samples.count() == 48 * 10 and none.omics.count() == 48 * 10 * 6
    assert none.params.count() == 0 and none.labels.count() == 480


def test_no_shared_sample(spark, tables):
    with pytest.raises(ValueError):
        ncv.prepare_ncv(tables[0], spark.createDataFrame([("x", "t", 1.0)], "ID string, label string, y double"), 4, 3)


def test_dual_extraction_beats_the_mean(vecs):
    model = models.fit_dual_extraction(vecs, ["a", "b"], l2=0.01, l2_integrated=0.01)
    scored = {r["split"]: r for r in metrics.regression_metrics(model.transform(vecs), ["split"]).collect()}
    assert scored["tst"]["r2"] > 0.6 and set(model.weights) == {"a", "b", "concatenated", "integrated"}
    start = models.fit_dual_extraction(vecs, ["a", "b"], weights="start")
    assert start.weights == {"a": 0.5, "b": 0.5, "concatenated": 1.0, "integrated": 1.0}


def test_sweep_and_prediction(vecs):
    log, fitted = models.sweep(vecs, ["a", "b"], [(0, 0)], n_trials=2)
    assert log.count() == 2 and set(fitted) == {"t0_0_0", "t0_0_1"}
    best = best_trials(log).first()
    assert best["val_loss"] == min(r["val_loss"] for r in log.collect())
    predicted = models.predict_fold(vecs, log, fitted, 0, 0)
    assert rows(predicted, "ID", "split") == rows(vecs, "ID", "split")
    val = predicted.where("split = 'val'").agg(F.avg((F.col("y") - F.col("y_pred")) ** 2)).first()[0]
    assert val == pytest.approx(best["val_loss"])
    with pytest.raises(ValueError):
        models.predict_fold(vecs, log, fitted, 3, 0)


def test_classes(vecs):
    data = vecs.withColumn("y", F.when(F.col("y") > 0.3, 2.0).when(F.col("y") < -0.3, 0.0).otherwise(1.0))
    model = models.fit_dual_extraction(data, ["a", "b"], regression=False, l2=0.01, l2_integrated=0.01)
    scored = model.transform(data)
    train = scored.where("split = 'trn'").agg(F.avg((F.col("y") == F.col("y_pred")).cast("double"))).first()[0]
    assert train > 0.7
    assert set(models.split_losses(model, data)) == {"trn", "val", "tst"}


def test_ranking_finds_the_informative_features(spark, vecs, prepared, tmp_path):
    log, fitted = models.sweep(vecs, ["a", "b"], [(0, 0)], n_trials=1)
    names = vectors.feature_order(prepared.omics)
    ranked = ranking.rank_outer_fold(vecs, log, fitted, names, 0, [55, 66], f"{tmp_path}/r0")
    got = [(r["omics"], r["feature"]) for r in ranked.collect()]
    assert len(got) == 4 and set(got[:2]) == {("a", "a1"), ("b", "b1")}
    assert spark.read.parquet(f"{tmp_path}/r0/perm_trials").count() == 8
    merged = ranking.collect_ranks(spark, {0: f"{tmp_path}/r0", 3: f"{tmp_path}/r0"}, f"{tmp_path}/m")
    assert merged.columns == ["omics", "feature", "average", "test_1", "test_2"]
    assert [r["feature"] for r in spark.read.parquet(f"{tmp_path}/m/ranking").orderBy(F.desc("average")).collect()][0] == got[0][1]
    with pytest.raises(ValueError):
        ranking.rank_outer_fold(vecs, log, fitted, names, 2, [55])


def test_written_once_reads_like_every_fold(spark, tables, tmp_path):
    omics, labels = tables
    done = ncv.prepare_ncv(omics, labels, 4, 3, codes=["b"])
    ncv.write_once(done, f"{tmp_path}/d")
    cols = ["ID", "copy_no", "omics", "feature", F.round("value", 9).alias("v")]
    for outer, inner, split in ((0, 0, "trn"), (3, 2, "val"), (1, 1, "tst")):
        here = (F.col("x_outer") == outer) & (F.col("x_inner") == inner) & (F.col("split") == split)
        got = ncv.read_once(spark, f"{tmp_path}/d", 4, 3, outer, inner, split)
        assert rows(got.select(*cols)) == rows(done.omics.where(here).select(*cols))
        y = ncv.read_once(spark, f"{tmp_path}/d", 4, 3, outer, inner, split, "labels")
        assert rows(y.select("ID", F.round("value", 9))) == rows(done.labels.where(here).select("ID", F.round("y", 9)))


def test_fragments_of_agrees_with_roles(spark):
    for r in fold_roles(spark, 5, 3).groupBy("x_outer", "x_inner", "split").agg(F.sort_array(F.collect_list("fragment")).alias("f")).collect():
        assert fragments_of(r["split"], r["x_outer"], r["x_inner"], 5, 3) == r["f"]


def test_steps_of_a_whole_table(tables):
    omics, labels = tables
    steps = ncv.fit_whole(omics, labels)
    ready, ready_labels = ncv.apply_preprocessors(omics, labels, steps)
    ends = ready.groupBy("feature").agg(F.min("value").alias("lo"), F.max("value").alias("hi"))
    assert {(r["lo"], r["hi"]) for r in ends.collect()} == {(0.0, 1.0)}
    z = ready_labels.agg(F.avg("y"), F.stddev_pop("y")).first()
    assert z[0] == pytest.approx(0, abs=1e-9) and z[1] == pytest.approx(1)


def test_first_occurrence_of_a_repeated_sample(tables):
    omics, _ = tables
    again = omics.where("ID = 's05' and omics = 'a'").withColumn("value", F.lit(99.0))
    kept, _ = ncv.assemble(omics.unionByName(again), None)
    assert rows(kept) == rows(ncv.assemble(omics, None)[0])
    done = ncv.prepare_ncv(omics.unionByName(again), None, 4, 3, only=(0, 0), prepare_omics=False, pad="none")
    assert done.omics.where("ID = 's05'").count() == 6 and done.omics.agg(F.max("value")).first()[0] < 99


def test_a_fold_that_was_not_fitted_is_an_error(spark, tables, tmp_path):
    omics, labels = tables
    ncv.write_once(ncv.prepare_ncv(omics, labels, 4, 3, only=(0, 0), pad="none"), f"{tmp_path}/d")
    assert ncv.read_once(spark, f"{tmp_path}/d", 4, 3, 0, 0, "val").count() > 0
    with pytest.raises(ValueError, match="not prepared"):
        ncv.read_once(spark, f"{tmp_path}/d", 4, 3, 2, 1, "val")


def test_external_data_with_other_features_is_an_error(tables):
    omics, _ = tables
    steps = ncv.fit_whole(omics)
    with pytest.raises(ValueError, match="missing in the data: b.b1"):
        ncv.apply_preprocessors(omics.where("feature <> 'b1'"), None, steps)
    with pytest.raises(ValueError, match="without saved steps: a.new"):
        ncv.apply_preprocessors(omics.unionByName(omics.where("feature = 'a0'").withColumn("feature", F.lit("new"))), None, steps)
    # a table that isn't given is not missed
    assert ncv.apply_preprocessors(omics.where("omics = 'a'"), None, steps)[0].count() > 0


def test_more_trials_than_settings_are_an_error():
    grid = {"l2": [0.1, 1.0], "elastic": [0.0]}
    assert len(models.sample_trials(grid, 2, 1)) == 2
    with pytest.raises(ValueError, match="3 trials"):
        models.sample_trials(grid, 3, 1)


@pytest.mark.parametrize("regression", [True, False])
def test_saved_models_predict_the_same(spark, vecs, tmp_path, regression):
    data = vecs if regression else vecs.withColumn("y", (F.col("y") > 0).cast("double"))
    log, fitted = models.sweep(data, ["a", "b"], [(0, 0)], regression=regression, n_trials=1, path=str(tmp_path / "m"))
    ours = models.predict_fold(data, log, fitted, 0, 0)
    assert rows(models.predict_fold(data, log, None, 0, 0)) == rows(ours)
    new = data.select("ID", "x_a", "x_b")
    overall = models.predict_overall(new, log)
    assert overall.columns == ["ID", "y_pred"] and overall.count() == data.count()


def test_unlabelled_rows_do_not_count(spark):
    full = [(1.0, 1.1), (2.0, 1.9), (4.0, 4.2)]
    data = spark.createDataFrame([*full, (None, 50.0), (None, -3.0), (7.0, None)], "y double, y_pred double")
    got, want = metrics.regression_metrics(data).first(), metrics.regression_metrics(spark.createDataFrame(full, "y double, y_pred double")).first()
    assert got["n"] == 3 and tuple(got) == pytest.approx(tuple(want))
