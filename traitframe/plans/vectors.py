"""Long features to one vector per sample."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.ml.functions import array_to_vector
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def feature_order(long: DataFrame) -> list[tuple[str, str]]:
    """(omics, feature) pairs of a scaled table, in vector order.

    Column names of the model, i.e. its metadata, not data.
    """
    rows = long.select("omics", "feature_idx", "feature").distinct().orderBy("omics", "feature_idx", "feature").collect()
    return [(r["omics"], r["feature"]) for r in rows]


def sample_vectors(long: DataFrame, keys: Sequence[str], omics: Sequence[str] | None = None) -> DataFrame:
    """``keys`` plus one dense vector column ``x_<omics>`` per omics table.

    Without ``omics`` the table names are looked up, which costs a pass.
    """
    names = sorted(omics or [r["omics"] for r in long.select("omics").distinct().collect()])
    cells = F.struct("feature_idx", "feature", "value")
    columns = [
        array_to_vector(F.sort_array(F.collect_list(F.when(F.col("omics") == n, cells)))["value"]).alias(f"x_{n}") for n in names
    ]
    return long.groupBy(*keys).agg(*columns)
