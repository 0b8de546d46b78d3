"""Fields hidden in path and study names."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# .../<name>_<outer>_<inner>_<split>[.parquet][/part-...]
FOLD_TAG = r"_(\d+)_(\d+)_(trn|val|tst)(?:\.[A-Za-z]+)?(?:/[^/]*)?$"


def fold_tag(path: Column, part: int) -> Column:
    """Group of :data:`FOLD_TAG` in a path (1 outer, 2 inner, 3 split), or null."""
    found = F.regexp_extract(path, FOLD_TAG, part)
    return F.when(found != "", found)


def path_part(path: Column, back: int) -> Column:
    """``back``-th path component from the end, 1 = file name; null if too short."""
    parts = F.split(path, "/")
    return F.get(parts, F.size(parts) - back)


def name_part(name: Column, back: int) -> Column:
    """``back``-th ``_``-separated part from the end; null if too short."""
    parts = F.split(name, "_")
    return F.get(parts, F.size(parts) - back)


def model_path_fields(path: Column) -> dict[str, Column]:
    """Fields of ``.../<study>_<tag>/<name>_<outer>_<inner>/<trial>/x-y-epoch=n-val_loss=v.ckpt``."""
    fold = path_part(path, 3)
    return {
        "x_outer": name_part(fold, 2).try_cast("int"),
        "x_inner": name_part(fold, 1).try_cast("int"),
        "val_loss": F.nullif(F.regexp_extract(path, r"val_loss=([0-9.eE+-]*[0-9])", 1), F.lit("")).try_cast("double"),
        "trial_tag": path_part(path, 2),
        "study_tag": name_part(path_part(path, 4), 1),
    }


def study_name_fields(name: Column) -> dict[str, Column]:
    """Fields of ``<a>_<b>_<outer>_<inner>_<time>...``."""
    parts = F.split(name, "_")
    return {
        "x_outer": F.get(parts, F.lit(2)).try_cast("int"),
        "x_inner": F.get(parts, F.lit(3)).try_cast("int"),
        "x_time": F.get(parts, F.lit(4)),
    }


def time_tag(ts: Column) -> Column:
    """``yyyyMMddHHmmss``."""
    return F.date_format(ts, "yyyyMMddHHmmss")
