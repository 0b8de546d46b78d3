"""Closed forms of the nested cross-validation layout."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from traitframe.constants import TEST, TRAIN, VALID


def even_part(position: Column, n: Column, k: int) -> Column:
    """Part 0..k-1 of a 0-based position when n rows are cut into k even runs.

    The first ``n mod k`` parts are one row longer.
    """
    short = F.floor(n / k)
    extra = n - short * k
    head = extra * (short + 1)
    in_head = F.floor(position / (short + 1))
    # short is 0 only when every row is in the head, so the guard never shows
    in_tail = extra + F.floor((position - head) / F.greatest(short, F.lit(1)))
    return F.when(position < head, in_head).otherwise(in_tail).cast("int")


def fold_role(fragment: Column, x_outer: Column, x_inner: Column, k_outer: int, k_inner: int) -> Column:
    """Split of a fragment within one (outer, inner) fold.

    ``k_inner`` consecutive fragments are the outer test set; the others, in
    order, fall into ``k_inner`` even parts of ``k_outer - 1`` fragments, one of
    which validates.
    """
    if k_outer < 2 or k_inner < 1:
        raise ValueError("k_outer must be at least 2 and k_inner at least 1")
    is_test = F.floor(fragment / k_inner) == x_outer
    rest = fragment - F.when(fragment < x_outer * k_inner, 0).otherwise(k_inner)
    is_valid = F.floor(rest / (k_outer - 1)) == x_inner
    return F.when(is_test, TEST).when(is_valid, VALID).otherwise(TRAIN)


def fragments_of(split: str, x_outer: int, x_inner: int, k_outer: int, k_inner: int) -> list[int]:
    """Fragment numbers with a role in one fold, for pruning partitions."""
    test = range(x_outer * k_inner, (x_outer + 1) * k_inner)
    rest = [f for f in range(k_outer * k_inner) if f not in test]
    valid = rest[x_inner * (k_outer - 1) : (x_inner + 1) * (k_outer - 1)]
    return {TEST: list(test), VALID: valid, TRAIN: [f for f in rest if f not in valid]}[split]


def seeded_hash(seed: Column | int, *keys: Column | str) -> Column:
    """Order key of every seeded random order: md5 of ``seed|key|...``.

    Does not depend on partitioning and can be computed by any SQL engine.
    """
    first = seed.cast("string") if isinstance(seed, Column) else F.lit(str(seed))
    return F.md5(F.concat_ws("|", first, *keys))
