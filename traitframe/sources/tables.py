"""Feature and label tables in CSV or Parquet."""

from __future__ import annotations

import os
from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from traitframe.operators.samples import choose_columns, melt_labels, melt_omics, name_id_column


def read_omics(spark: SparkSession, path: str, schema: str | None = None) -> DataFrame:
    """Wide table: ``ID`` as string first, then one column per feature.

    The format follows the extension in any case. CSV types are inferred unless
    a schema is given, which saves the extra pass over a large file. A first
    column without a name is the ID.
    """
    kind = os.path.splitext(path.rstrip("/"))[1].lower()
    if kind == ".csv":
        reader = spark.read.option("header", True)
        table = reader.schema(schema).csv(path) if schema else reader.schema(_inferred(spark, path)).csv(path)
    elif kind == ".parquet":
        table = spark.read.parquet(path)
    elif not kind:
        raise ValueError(f"no file extension: {path}")
    else:
        raise ValueError(f"unsupported extension {kind}: {path}")
    first = table.columns[0]
    if first in ("", "_c0"):
        table = table.withColumnRenamed(first, "ID")
    return table.withColumn(table.columns[0], F.col(f"`{table.columns[0]}`").cast("string"))


def _inferred(spark: SparkSession, path: str) -> StructType:
    """Types of a CSV file; the first column stays text, so that an ID like ``007`` keeps its zeros."""
    found = spark.read.option("header", True).option("inferSchema", True).csv(path).schema
    return StructType([StructField(found[0].name, StringType()), *found.fields[1:]])


def read_omics_long(spark: SparkSession, paths: dict[str, str]) -> DataFrame:
    """Several omics tables in one long frame."""
    tables = [melt_omics(name_id_column(read_omics(spark, paths[name])), name) for name in sorted(paths)]
    long = tables[0]
    for table in tables[1:]:
        long = long.unionByName(table)
    return long


def read_labels(spark: SparkSession, path: str, columns: Sequence[str] | Sequence[int] | None = None) -> tuple[DataFrame, int]:
    """Wide label table with the chosen traits, and their number."""
    table = choose_columns(name_id_column(read_omics(spark, path)), columns)
    return table, len(table.columns) - 1


def read_labels_long(spark: SparkSession, path: str, columns: Sequence[str] | Sequence[int] | None = None) -> DataFrame:
    return melt_labels(read_labels(spark, path, columns)[0])


def read_genotypes(spark: SparkSession, path: str) -> dict[str, DataFrame]:
    """Tables written by :func:`traitframe.sources.sinks.write_genotypes`."""
    return {name: spark.read.parquet(f"{path}/{name}") for name in ("genotypes", "snp_block")}


def genotype_matrix(calls: DataFrame, snps: Sequence[str]) -> DataFrame:
    """Wide export of chosen SNPs: ``ID`` and one code column per SNP name given."""
    codes = [F.max(F.when(F.col("snp_id") == s, F.col("code"))).alias(s) for s in snps]
    return calls.groupBy("ID").agg(*codes)
