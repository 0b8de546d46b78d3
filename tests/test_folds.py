from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from conftest import rows
from traitframe.functions.folds import even_part
from traitframe.operators import folds, positions, samples


@pytest.mark.parametrize(("n", "k"), [(1, 1), (5, 2), (7, 12), (100, 12), (503, 50)])
def test_even_part_cuts_like_array_split(spark, n, k):
    got = spark.range(n).select("id", even_part(F.col("id"), F.lit(n), k).alias("part"))
    want = {int(i): p for p, part in enumerate(np.array_split(np.arange(n), k)) for i in part}
    assert {r["id"]: r["part"] for r in got.collect()} == want


@pytest.mark.parametrize(("k_outer", "k_inner"), [(2, 1), (4, 3), (5, 2), (10, 5)])
def test_roles_against_explicit_layout(spark, k_outer, k_inner):
    got = {(r["x_outer"], r["x_inner"], r["fragment"]): r["split"] for r in folds.fold_roles(spark, k_outer, k_inner).collect()}
    n = k_outer * k_inner
    for outer in range(k_outer):
        test = set(range(outer * k_inner, (outer + 1) * k_inner))
        parts = np.array_split([f for f in range(n) if f not in test], k_inner)
        for inner in range(k_inner):
            valid = set(parts[inner].tolist())
            for f in range(n):
                assert got[outer, inner, f] == ("tst" if f in test else "val" if f in valid else "trn")


def test_every_sample_is_tested_once_per_inner_fold(spark):
    ids = spark.range(101).select(F.concat(F.lit("s"), "id").alias("ID"))
    placed = folds.with_folds(folds.random_fragments(ids, 12), 4, 3)
    tested = Counter((r["ID"], r["x_inner"]) for r in placed.where("split = 'tst'").collect())
    assert len(tested) == 101 * 3 and set(tested.values()) == {1}
    assert placed.count() == 101 * 12


def test_random_order_is_the_md5_order(spark):
    ids = [f"s{i}" for i in range(300)]
    df = spark.createDataFrame([(i,) for i in ids], "ID string")
    got = {r["ID"]: r["position"] for r in positions.hash_positions(df, ["ID"], 7).collect()}
    order = sorted(ids, key=lambda i: (hashlib.md5(f"7|{i}".encode()).hexdigest(), i))
    assert got == {i: p for p, i in enumerate(order)}
    # independent of the partitioning
    again = positions.hash_positions(df.repartition(5), ["ID"], 7)
    assert {r["ID"]: r["position"] for r in again.collect()} == got


@pytest.mark.parametrize("n", [1, 3, 40, 2000])
def test_sorted_positions(spark, n):
    # long common prefixes: most keys fall between few leading letters
    keys = [f"1-{i}" if i % 3 else f"chromosome-{i}" for i in range(n)]
    df = spark.createDataFrame([(k,) for k in keys], "k string")
    got = {r["k"]: (r["position"], r["n"]) for r in positions.sorted_positions(df, "k", total="n").collect()}
    assert got == {k: (p, n) for p, k in enumerate(sorted(keys))}


def test_single_fold_and_bad_fold(spark):
    assert rows(folds.fold_grid(spark, 4, 3, (2, 1))) == [(2, 1)]
    with pytest.raises(ValueError):
        folds.fold_grid(spark, 4, 3, (4, 0))
    with pytest.raises(ValueError):
        folds.fold_roles(spark, 1, 3)


def test_given_fragments_are_checked(spark):
    ids = spark.createDataFrame([("a",), ("b",), ("c",)], "ID string")
    good = spark.createDataFrame([("a", 0), ("b", 1), ("c", 1)], "ID string, fragment int")
    assert rows(folds.given_fragments(ids, good, 2)) == [("a", 0), ("b", 1), ("c", 1)]
    for n in (1, 3):
        with pytest.raises(ValueError):
            folds.given_fragments(ids, good, n)


def test_padding(spark):
    ids = spark.range(50).select(F.col("id").cast("string").alias("ID"))
    padded = samples.pad_samples(ids, multiple_of=12)
    assert padded.count() == 60 and padded.distinct().count() == 60
    assert padded.where("copy_no = 0").count() == 50
    assert samples.pad_samples(ids, multiple_of=10).count() == 50
    big = samples.pad_samples(ids, target=500)
    assert big.count() == 500 and big.distinct().count() == 500
    # copies of one sample count from 1 without gaps
    gaps = big.groupBy("ID").agg(F.count("*").alias("n"), F.max("copy_no").alias("top")).where("n <> top + 1")
    assert gaps.count() == 0
    with pytest.raises(ValueError):
        samples.pad_samples(ids, target=50)


def test_buckets_are_even(spark):
    df = spark.range(40_000).select(F.format_string("k%07d", F.col("id") * 7).alias("k"))
    sizes = [r["count"] for r in positions.sort_buckets(df, "k", positions.cut_points(df, "k", 64)).groupBy("_bucket").count().collect()]
    assert len(sizes) == 64 and max(sizes) < 2 * 40_000 / 64


def test_buckets_are_even_in_every_group(spark):
    # one group's keys lie close together: cut points of all keys would put them into few buckets
    df = spark.range(20_000).select((F.col("id") % 2).alias("g"), F.when(F.col("id") % 2 == 0, F.col("id") * 1e-9).otherwise(F.col("id") * 1.0).alias("k"))
    cuts = positions.group_cut_points(df, "k", ["g"], 32)
    sizes = positions.sort_buckets(df, "k", cuts, ["g"]).groupBy("g", "_bucket").count().collect()
    assert max(r["count"] for r in sizes) < 2 * 10_000 / 32
