"""Long feature tables and the samples they share.

Canonical tables: ``omics_long(ID, omics, feature_idx, feature, value)`` and
``labels(ID, label, y)``.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitframe.constants import SEED_RESAMPLE
from traitframe.operators.joins import one_per_key, sized_join
from traitframe.operators.positions import hash_positions
from traitframe.session import stage


def name_id_column(df: DataFrame) -> DataFrame:
    """Call the first column ``ID`` and make it a string."""
    first = df.columns[0]
    named = df if first == "ID" else df.withColumnRenamed(first, "ID")
    return named.withColumn("ID", F.col("ID").cast("string"))


def choose_columns(df: DataFrame, columns: Sequence[str] | Sequence[int] | None) -> DataFrame:
    """``ID`` and the chosen columns, by name or by 1-based number after ``ID``."""
    if columns is None:
        return df
    others = df.columns[1:]
    if all(isinstance(c, str) for c in columns):
        names = list(columns)
    elif all(isinstance(c, int) for c in columns):
        if any(not 1 <= c <= len(others) for c in columns):
            raise ValueError(f"column numbers must be 1..{len(others)}")
        names = [others[c - 1] for c in columns]
    else:
        raise ValueError("columns must all be names or all be 1-based numbers")
    return df.select(df.columns[0], *[F.col(f"`{n}`") for n in names])


def melt_omics(df: DataFrame, omics: str) -> DataFrame:
    """Wide table (ID, one column per feature) to long form."""
    features = df.columns[1:]
    values = F.array(*[F.col(f"`{c}`").cast("double") for c in features])
    cells = df.select("ID", F.posexplode(values).alias("feature_idx", "value"))
    name = F.get(F.array(*[F.lit(c) for c in features]), F.col("feature_idx"))
    return cells.select("ID", F.lit(omics).alias("omics"), "feature_idx", name.alias("feature"), "value")


def melt_labels(df: DataFrame) -> DataFrame:
    """Wide labels (ID, one column per trait) to (ID, label, y)."""
    long = melt_omics(df, "label")
    return long.select("ID", F.col("feature").alias("label"), F.col("value").alias("y"))


def labels_as_omics(labels: DataFrame) -> DataFrame:
    """Labels in the long feature form, so that the same preprocessing applies."""
    return labels.select("ID", F.lit("label").alias("omics"), F.col("label").alias("feature"), F.col("y").alias("value"))


def first_rows(df: DataFrame, order: Column) -> DataFrame:
    """First row of every ID of a wide table, in ``order``."""
    return one_per_key(df, ["ID"], order)


def first_occurrences(long: DataFrame) -> DataFrame:
    """Long rows of the first occurrence, in file order, of every sample in every omics table.

    A sample with more rows than different features came more than once, be its
    rows dense or sparse. Only rows of such samples are reduced; of the others
    eight bytes a cell are compared. Features whose hashes meet merely take the longer way.
    """
    rows = long.groupBy("ID", "omics").agg(F.count(F.lit(1)).alias("_rows"), F.size(F.collect_set(F.xxhash64("feature"))).alias("_features"))
    repeated = stage(rows.where("_rows > _features").select("ID", "omics"), "repeated-ids")
    if repeated.isEmpty():
        return long
    keys = ["ID", "omics"]
    several = sized_join(long.withColumn("_row", F.monotonically_increasing_id()), repeated, keys, "left_semi", staged=True)
    first = one_per_key(several, [*keys, "feature"], F.col("_row")).select(*long.columns)
    return sized_join(long, repeated, keys, "left_anti", staged=True).unionByName(first)


def shared_ids(*tables: DataFrame) -> DataFrame:
    """IDs present in every table, once each.

    Each table is reduced to its distinct IDs before any join, so a repeated ID
    costs one row per map task; the semi joins reuse that partitioning.
    """
    if not tables:
        raise ValueError("no tables given")
    distinct = [t.select("ID").distinct() for t in tables]
    return reduce(lambda left, right: left.join(right, "ID", "left_semi"), distinct)


def intersect_ids(*tables: DataFrame) -> DataFrame:
    """The same as a chain of set intersections."""
    return reduce(lambda left, right: left.intersect(right), [t.select("ID") for t in tables])


def shared_omics_ids(long: DataFrame, n_omics: int) -> DataFrame:
    """IDs that occur in all ``n_omics`` tables of a long frame, in one aggregate."""
    seen = long.select("ID", "omics").distinct().groupBy("ID").agg(F.count(F.lit(1)).alias("n"))
    return seen.where(F.col("n") == n_omics).select("ID")


def join_on_id(*tables: DataFrame) -> DataFrame:
    """Inner join of wide tables on ``ID``; each must hold an ID once (see :func:`first_rows`)."""
    return reduce(lambda left, right: left.join(right, "ID", "inner"), tables)


def align_with_folds(existing: DataFrame, *tables: DataFrame) -> DataFrame:
    """Samples shared by tables that are already split and by raw tables.

    ``existing`` holds (ID, x_outer, x_inner, split, omics) rows of every
    pre-split table; a sample stays in a fold when all of them put it into the
    same split and every raw table knows it. The split is carried over.
    """
    keys = ["ID", "x_outer", "x_inner", "split"]
    n_omics = existing.select("omics").distinct().count()
    agreed = existing.select(*keys, "omics").distinct().groupBy(*keys).agg(F.count(F.lit(1)).alias("n"))
    agreed = agreed.where(F.col("n") == n_omics).select(*keys)
    return reduce(lambda left, right: left.join(right.select("ID"), "ID", "left_semi"), tables, agreed)


def stack(*tables: DataFrame) -> DataFrame:
    """Row union by column name."""
    return reduce(lambda a, b: a.unionByName(b), tables)


def pad_samples(
    samples: DataFrame,
    multiple_of: int | None = None,
    target: int | None = None,
    seed: int = SEED_RESAMPLE,
) -> DataFrame:
    """Add resampled copies until the row count is a multiple, or a target.

    Copies are drawn with replacement; originals have ``copy_no`` 0, copies count
    from 1. Draw ``d`` takes the sample at position ``md5(seed|d) mod n`` of the
    seeded order.
    """
    spark = samples.sparkSession
    ids = samples.select("ID")
    n = ids.count()
    if target is not None:
        if target <= n:
            raise ValueError("the target must be larger than the number of samples")
        missing = target - n
    else:
        missing = -n % multiple_of if multiple_of and multiple_of > 1 else 0
    originals = ids.withColumn("copy_no", F.lit(0))
    if missing == 0 or n == 0:
        return originals
    draws = spark.range(missing).select(
        F.col("id").alias("draw"),
        (F.conv(F.substring(F.md5(F.concat_ws("|", F.lit(str(seed)), F.col("id").cast("string"))), 1, 12), 16, 10).cast("bigint") % n).alias("position"),
    )
    # draws of one sample are numbered by counting, not by collecting them
    numbered = draws.groupBy("position").agg(F.count(F.lit(1)).alias("_times"))
    numbered = numbered.select("position", F.explode(F.sequence(F.lit(1), F.col("_times").cast("int"))).alias("copy_no"))
    copies = hash_positions(ids, ["ID"], seed).join(numbered, "position").select("ID", "copy_no")
    return originals.unionByName(copies)


def sample_arrays(long: DataFrame, keys: Sequence[str] = ("ID",)) -> DataFrame:
    """One row per key and omics table with its feature values in order.

    A group holds one sample's features, never more.
    """
    cells = F.sort_array(F.collect_list(F.struct("feature_idx", "feature", "value")))
    rows = long.groupBy(*keys, "omics").agg(cells.alias("_cells"))
    return rows.select(*keys, "omics", F.col("_cells.feature").alias("features"), F.col("_cells.value").alias("x"))


def sample_records(long: DataFrame, labels: DataFrame | None, keys: Sequence[str] = ("ID",)) -> DataFrame:
    """Record per sample: map omics name -> float array, and map label name -> float."""
    keys = list(keys)
    arrays = sample_arrays(long, keys)
    record = arrays.groupBy(*keys).agg(
        F.map_from_entries(F.collect_list(F.struct("omics", F.col("x").cast("array<float>")))).alias("omics")
    )
    if labels is None:
        return record
    extra = [k for k in keys if k in labels.columns]
    traits = labels.groupBy(*extra).agg(
        F.map_from_entries(F.collect_list(F.struct("label", F.col("y").cast("float")))).alias("label")
    )
    return record.join(traits, extra, "left")


def omics_dims(long: DataFrame) -> DataFrame:
    """Number of features per omics table, with its index in name order."""
    dims = long.select("omics", "feature").distinct().groupBy("omics").agg(F.count(F.lit(1)).alias("omics_dim"))
    return dims


def omics_index(long: DataFrame) -> DataFrame:
    """Modality index = position of the name among the sorted names.

    The names are column-set names given by the user; as an array they are one
    small row.
    """
    names = long.select("omics").distinct().agg(F.array_sort(F.collect_list("omics")).alias("names"))
    return names.select(F.posexplode("names").alias("omics_idx", "omics"))


def choose_omics(long: DataFrame, which: str | int) -> DataFrame:
    """Rows of one omics table, by name or by index among the sorted names."""
    if isinstance(which, str):
        return long.where(F.col("omics") == which)
    names = [r["omics"] for r in long.select("omics").distinct().orderBy("omics").limit(which + 1).collect()]
    if which < 0 or which >= len(names):
        raise ValueError("the omics index is out of range")
    return long.where(F.col("omics") == names[which])
