from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from traitframe import session
from traitframe.sources import folds as fold_files
from traitframe.sources import sinks, tables


def test_csv_with_unnamed_id(spark, tmp_path):
    path = tmp_path / "x.CSV"
    path.write_text(",g1,g2\n007,1.5,2\n8,,3\n")
    table = tables.read_omics(spark, str(path))
    assert rows(table) == [("007", 1.5, 2), ("8", None, 3)]
    other = tmp_path / "y.csv"
    other.write_text("sample,t1,t2\n007,1.5,2\n")
    labels, n = tables.read_labels(spark, str(other), [2])
    assert n == 1 and rows(labels) == [("007", 2)]
    long = tables.read_omics_long(spark, {"b": str(path), "a": str(other)})
    assert rows(long.where("ID = '007'"), "omics", "feature", "value") == [("a", "t1", 1.5), ("a", "t2", 2.0), ("b", "g1", 1.5), ("b", "g2", 2.0)]
    assert rows(tables.read_labels_long(spark, str(other))) == [("007", "t1", 1.5), ("007", "t2", 2.0)]
    assert tables.read_omics(spark, str(other), "sample string, t1 double, t2 double").schema["t2"].dataType.simpleString() == "double"


@pytest.mark.parametrize("name", ["x.txt", "x"])
def test_unknown_formats(spark, name):
    with pytest.raises(ValueError):
        tables.read_omics(spark, name)


@pytest.fixture()
def split(spark):
    cells = [(o, i, s, f"{o}{i}{s}{k}") for o in range(2) for i in range(2) for s in ("trn", "val", "tst") for k in range(3)]
    return spark.createDataFrame(cells, "x_outer int, x_inner int, split string, ID string")


def test_fold_directories(spark, split, tmp_path):
    path = f"{tmp_path}/d"
    fold_files.write_folds(split, path)
    assert rows(fold_files.read_folds(spark, path), "x_outer", "x_inner", "split", "ID") == rows(split)
    part = fold_files.read_folds(spark, path, 1, 0, "val")
    assert rows(part, "ID") == [("10val0",), ("10val1",), ("10val2",)]
    assert len(part.inputFiles()) >= 1 and "PartitionFilters: [isnotnull(x_outer" in part._jdf.queryExecution().toString()
    with pytest.raises(ValueError):
        fold_files.read_folds(spark, path, split="train")


def test_fold_tagged_files(spark, split, tmp_path):
    path = f"{tmp_path}/d"
    fold_files.write_fold_tagged(split, f"{path}/a", "genes")
    fold_files.write_fold_tagged(split.withColumn("ID", F.concat(F.lit("x"), "ID")), f"{path}/b", "other")
    got = fold_files.read_fold_tagged(spark, path, prefix="genes")
    assert rows(got, "x_outer", "x_inner", "split", "ID") == rows(split)
    one = fold_files.read_fold_tagged(spark, path, 0, 1, "tst", "other")
    assert rows(one, "ID") == [("x01tst0",), ("x01tst1",), ("x01tst2",)]
    with pytest.raises(ValueError):
        fold_files.read_fold_tagged(spark, path, 9, 9)


def test_ranking_files_and_score_log(spark, tmp_path):
    ranking = spark.createDataFrame([("o", "a", 0.1), ("o", "b", 0.7)], "omics string, feature string, importance double")
    losses = spark.createDataFrame([("o", "a", 1, 0.5)], "omics string, feature string, seed int, loss double")
    sinks.write_ranking(ranking, f"{tmp_path}/r", losses)
    assert [r["feature"] for r in spark.read.option("header", True).csv(f"{tmp_path}/r/ranking_csv").collect()] == ["b", "a"]
    assert rows(spark.read.parquet(f"{tmp_path}/r/perm_trials")) == rows(losses)
    for _ in range(2):
        sinks.append_scores(ranking, f"{tmp_path}/log")
    assert spark.read.parquet(f"{tmp_path}/log").count() == 4


def test_shared_folder_comes_from_the_session(spark, tmp_path, monkeypatch):
    class Conf:
        def __init__(self, values):
            self.values = values

        def get(self, key, default=None):
            return self.values.get(key, default)

    class Fake:
        pass

    fake = Fake()
    fake.conf = Conf({"spark.checkpoint.dir": "hdfs:///shared/", "spark.master": "yarn"})
    assert session.shared_dir(fake) == "hdfs:///shared"
    fake.conf = Conf({"spark.master": "yarn"})
    with pytest.raises(RuntimeError):
        session.shared_dir(fake)
    assert rows(session.stage(spark.range(3), "t")) == [(0,), (1,), (2,)]
