from __future__ import annotations

import pytest
from pyspark.sql import functions as F

from conftest import rows
from traitframe.operators import joins, samples


def test_shared_ids_with_repeats(spark):
    a = spark.createDataFrame([("1",), ("2",), ("2",), ("3",)], "ID string")
    b = spark.createDataFrame([("2",), ("3",), ("3",), ("4",)], "ID string")
    assert rows(samples.shared_ids(a, b)) == [("2",), ("3",)]
    assert rows(samples.intersect_ids(a, b)) == [("2",), ("3",)]
    assert rows(samples.shared_ids(a)) == [("1",), ("2",), ("3",)]


def test_first_and_last_row_per_key(spark):
    df = spark.createDataFrame([("a", 2, "x"), ("a", 1, "y"), ("b", 3, None)], "ID string, n int, v string")
    assert rows(joins.one_per_key(df, ["ID"], F.col("n"))) == [("a", 1, "y"), ("b", 3, None)]
    assert rows(joins.one_per_key(df, ["ID"], F.col("n"), last=True)) == [("a", 2, "x"), ("b", 3, None)]


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_sized_join_ways_agree(spark, how):
    # key 0 holds half of the rows
    big = spark.range(400).select(F.when(F.col("id") % 2 == 0, 0).otherwise(F.col("id") % 7).alias("k"), F.col("id").alias("r"))
    small = spark.createDataFrame([(0, "z"), (3, "t"), (9, "n")], "k int, w string")
    want = rows(big.join(small, "k", how))
    assert rows(joins.sized_join(big, small, ["k"], how)) == want
    assert rows(joins.sized_join(big, small, ["k"], how, salt_by=["r"], max_rows=0, salts=5)) == want
    assert rows(joins.sized_join(big, small, ["k"], how, max_rows=1)) == want


def test_columns_by_name_and_number(spark):
    df = spark.createDataFrame([("s", 1.0, 2.0, 3.0)], "sample string, a double, b double, c double")
    assert samples.choose_columns(df, [1, 3]).columns == ["sample", "a", "c"]
    assert samples.choose_columns(df, ["b"]).columns == ["sample", "b"]
    for bad in ([0], [4], ["a", 1]):
        with pytest.raises(ValueError):
            samples.choose_columns(df, bad)


def test_melt_wide_table(spark):
    width = 3000
    df = spark.range(2).select(F.concat(F.lit("s"), "id").alias("ID"), *[(F.col("id") + i).alias(f"gene.{i}") for i in range(width)])
    long = samples.melt_omics(df, "expression")
    assert long.count() == 2 * width
    assert rows(long.where("feature_idx = 2999")) == [("s0", "expression", 2999, "gene.2999", 2999.0), ("s1", "expression", 2999, "gene.2999", 3000.0)]


def test_records_and_omics_choice(spark):
    long = spark.createDataFrame(
        [("s", "b", 0, "f", 1.0), ("s", "a", 1, "h", 3.0), ("s", "a", 0, "g", None)], "ID string, omics string, feature_idx int, feature string, value double"
    )
    labels = spark.createDataFrame([("s", "t", 2.0)], "ID string, label string, y double")
    record = samples.sample_records(long, labels).first()
    assert record["omics"] == {"a": [None, 3.0], "b": [1.0]} and record["label"] == {"t": 2.0}
    assert rows(samples.choose_omics(long, 1), "feature") == [("f",)]
    assert rows(samples.omics_index(long)) == [(0, "a"), (1, "b")]
    with pytest.raises(ValueError):
        samples.choose_omics(long, 2)


def test_fold_alignment(spark):
    cols = "ID string, x_outer int, x_inner int, split string, omics string"
    existing = spark.createDataFrame(
        [("1", 0, 0, "trn", "g"), ("1", 0, 0, "trn", "h"), ("2", 0, 0, "trn", "g"), ("2", 0, 0, "val", "h"), ("3", 0, 0, "tst", "g"), ("3", 0, 0, "tst", "h")], cols
    )
    raw = spark.createDataFrame([("1",), ("2",)], "ID string")
    assert rows(samples.align_with_folds(existing, raw)) == [("1", 0, 0, "trn")]
    assert rows(samples.align_with_folds(existing)) == [("1", 0, 0, "trn"), ("3", 0, 0, "tst")]
