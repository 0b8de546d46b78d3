"""Joins whose small side is counted before it is broadcast, and reductions that keep one row per key."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitframe.constants import BROADCAST_ROWS, SALTS
from traitframe.session import stage


def shuffled(side: DataFrame) -> DataFrame:
    """A join side whose size is not known, marked so that Spark shuffles it.

    Unmarked, Spark broadcasts what it takes for small, and it takes a saved
    table for as large as its compressed files, and exploded rows for as large
    as the rows before. Many times that would then go through the driver.
    """
    return side.hint("merge")


def sized_join(
    big: DataFrame,
    small: DataFrame,
    on: Sequence[str],
    how: str = "inner",
    salt_by: Sequence[str] = (),
    max_rows: int = BROADCAST_ROWS,
    salts: int = SALTS,
    staged: bool = False,
) -> DataFrame:
    """Join a large table with a fitted table of unknown size.

    ``small`` is written to the shared folder once and counted there (``staged``
    skips the writing: the table is saved already, or cheap to derive from one). Up to ``max_rows`` rows it is broadcast, so ``big`` does not
    move. Beyond that both sides are shuffled on the keys plus a salt taken from
    ``salt_by`` columns of ``big``, with ``small`` repeated once per salt: a key
    that holds a third of ``big`` is spread over ``salts`` tasks.
    """
    if how not in ("inner", "left", "left_semi", "left_anti"):
        raise ValueError("how must be inner, left, left_semi or left_anti")
    on = list(on)
    if not staged:
        small = stage(small, "small-side")
    if small.count() <= max_rows:
        joined = big.join(F.broadcast(small), on, how)
    elif not salt_by:
        joined = big.join(shuffled(small), on, how)
    else:
        salted_big = big.withColumn("_salt", F.pmod(F.xxhash64(*salt_by), F.lit(salts)).cast("int"))
        salted_small = small.withColumn("_salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1))))
        joined = salted_big.join(shuffled(salted_small), [*on, "_salt"], how).drop("_salt")
    return joined.select(*big.columns, *[c for c in joined.columns if c not in big.columns])


def one_per_key(df: DataFrame, keys: Sequence[str], order: Column, last: bool = False) -> DataFrame:
    """One row per key: the first by ``order``, or the last.

    An aggregate rather than a window, so repeated rows of a hot key are dropped
    before the shuffle and no task ever holds a whole group.
    """
    keys = list(keys)
    rest = [c for c in df.columns if c not in keys]
    pick = F.max_by if last else F.min_by
    picked = df.groupBy(*keys).agg(pick(F.struct(*rest), order).alias("_row"))
    return picked.select(*keys, *[F.col("_row")[c].alias(c) for c in rest]).select(*df.columns)


def require_rows(df: DataFrame, message: str) -> DataFrame:
    """``df`` itself, or ``ValueError`` when it has no row."""
    if df.isEmpty():
        raise ValueError(message)
    return df
