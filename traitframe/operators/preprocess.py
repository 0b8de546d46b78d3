"""Imputation, variance filter, scaling: fitted on training rows of every fold, in one scan.

Statistics are taken per *fragment* first. Count, mean, squared deviations,
minimum and maximum of fragments combine exactly, so all ``k_outer * k_inner``
folds cost one pass over the data plus a join of a small statistics table.

Parameter table: ``(x_outer, x_inner, omics, feature, step, kind, p1, p2, keep)``

========== ============ =============== ==========================
kind       p1           p2              keep
========== ============ =============== ==========================
impute     mean         --              false if nothing was seen
variance   variance     --              variance > threshold
minmax     minimum      maximum         true
zscore     mean         deviation       true
forest     importance   rank from 1     among the chosen features
fill:x     fill         --              as the step says
scale:x    shift        divisor         as the step says
filter:x   any          any             as the step says
========== ============ =============== ==========================

Steps are numbered in the order in which they apply. The last three are steps
that a user defines (:mod:`traitframe.operators.steps`), x their name.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from traitframe.constants import BROADCAST_ROWS, SALTS, TRAIN, VARIANCE_THRESHOLD
from traitframe.functions.folds import fragments_of
from traitframe.functions.scoring import or_missing
from traitframe.operators.joins import sized_join
from traitframe.operators.steps import Step

FOLD = ["x_outer", "x_inner"]
FEATURE = ["omics", "feature"]
OMICS_STEPS = ("impute", "variance", "minmax")
LABEL_STEPS = ("impute", "zscore")


def attach(long: DataFrame, samples: DataFrame, staged: bool = False) -> DataFrame:
    """Long rows with the columns of a thin sample table; padded copies repeat their rows."""
    return sized_join(long, samples, ["ID"], staged=staged)


def _defined(steps: Sequence[str | Step]) -> list[Step]:
    own = [s for s in steps if isinstance(s, Step)]
    if len({s.name for s in own}) < len(own):
        raise ValueError("steps need different names")
    return own


def fragment_statistics(long: DataFrame, steps: Sequence[str | Step] = ()) -> DataFrame:
    """Per (omics, feature, fragment): rows, values seen, mean, squared deviations, min, max, and the states of user steps."""
    value = or_missing(F.col("value"))
    return long.groupBy(*FEATURE, "fragment").agg(
        F.count(F.lit(1)).alias("rows"),
        F.count(value).alias("n"),
        F.avg(value).alias("mean"),
        (F.var_pop(value) * F.count(value)).alias("dev"),
        F.min(value).alias("lo"),
        F.max(value).alias("hi"),
        *[s.update(value).alias(s.column) for s in _defined(steps)],
    )


def combine_statistics(parts: DataFrame, by: Sequence[str]) -> DataFrame:
    """Statistics of the union of fragments, per ``by``.

    Deviations are re-centred on the common mean of the group, so nothing
    cancels when the mean is large against the spread. Missing values count as
    the mean, as after imputation.
    """
    total = parts.groupBy(*by).agg(
        F.sum("rows").alias("rows"),
        F.sum("n").alias("n"),
        F.try_divide(F.sum(F.col("n") * F.col("mean")), F.sum("n")).alias("mean"),
        F.sum("dev").alias("_within"),
        F.min("lo").alias("lo"),
        F.max("hi").alias("hi"),
        F.collect_list(F.struct("n", "mean")).alias("_parts"),
    )
    # at most one entry per fragment, i.e. k_outer * k_inner
    between = F.aggregate(
        "_parts",
        F.lit(0.0),
        lambda acc, p: acc + F.coalesce(p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")), F.lit(0.0)),
    )
    return total.select(*by, "rows", "n", "mean", F.try_divide(F.col("_within") + between, F.col("rows")).alias("variance"), "lo", "hi")


def _merged(step: Step) -> Column:
    """The state of all fragments in ``_parts``; null if none has one."""
    states = F.filter(F.transform("_parts", lambda p: p[step.column]), lambda x: x.isNotNull())
    rest = F.slice(states, F.lit(2), F.greatest(F.size(states) - 1, F.lit(0)))
    return F.aggregate(rest, F.get(states, F.lit(0)), step.merge)


def fold_statistics(
    long: DataFrame, k_outer: int, k_inner: int, only: tuple[int, int] | None = None, steps: Sequence[str | Step] = ()
) -> DataFrame:
    """Training-row statistics of every feature in every fold.

    The fragments of a feature, at most ``k_outer * k_inner``, are gathered in one
    row, and each fold picks its own from that row: nothing is repeated per fold before the shuffle.
    """
    own = _defined(steps)
    parts = fragment_statistics(long, steps)
    columns = ["fragment", "rows", "n", "mean", "dev", "lo", "hi", *[s.column for s in own]]
    gathered = parts.groupBy(*FEATURE).agg(F.collect_list(F.struct(*columns)).alias("_all"))
    folds = [(o, i) for o in range(k_outer) for i in range(k_inner) if only in (None, (o, i))]
    grid = F.array(*[
        F.struct(F.lit(o).alias("x_outer"), F.lit(i).alias("x_inner"), F.array(*[F.lit(f) for f in fragments_of(TRAIN, o, i, k_outer, k_inner)]).alias("_own"))
        for o, i in folds
    ])
    rows = gathered.select("*", F.inline(grid))
    rows = rows.withColumn("_parts", F.filter("_all", lambda p: F.array_contains(F.col("_own"), p["fragment"])))

    def added(value, kind: str = "double") -> Column:
        zero = F.lit(0).cast(kind)
        return F.aggregate("_parts", zero, lambda acc, p: acc + F.coalesce(value(p).cast(kind), zero))

    rows = rows.withColumns({"rows": added(lambda p: p["rows"], "bigint"), "n": added(lambda p: p["n"], "bigint")}).where("rows > 0")
    rows = rows.withColumn("mean", F.try_divide(added(lambda p: p["n"] * p["mean"]), F.col("n")))
    around = added(lambda p: p["dev"] + p["n"] * (p["mean"] - F.col("mean")) * (p["mean"] - F.col("mean")))
    return rows.select(
        *FOLD, *FEATURE, "rows", "n", "mean",
        F.when(F.col("n") > 0, F.try_divide(around, F.col("rows"))).alias("variance"),
        F.array_min(F.transform("_parts", lambda p: p["lo"])).alias("lo"),
        F.array_max(F.transform("_parts", lambda p: p["hi"])).alias("hi"),
        *[_merged(s).alias(s.column) for s in own],
    )


def table_statistics(long: DataFrame) -> DataFrame:
    """Statistics over all rows, as one fold without number."""
    parts = fragment_statistics(long.withColumn("fragment", F.lit(0)))
    whole = parts.withColumn("x_outer", F.lit(None).cast("int")).withColumn("x_inner", F.lit(None).cast("int"))
    return combine_statistics(whole, [*FOLD, *FEATURE])


def steps_from_statistics(stats: DataFrame, steps: Sequence[str | Step], threshold: float = VARIANCE_THRESHOLD) -> DataFrame:
    """Parameter table of the steps, in order: names of built-in ones, or steps that a user defined.

    Statistics are those of raw values. Locations and widths of a scaling step
    that follows another one are told in the units that the earlier one leaves.
    """
    none = F.lit(None).cast("double")
    seen = F.col("n") > 0
    known = {c: F.col(c) for c in ("rows", "n", "mean", "variance", "lo", "hi")}
    shapes: dict[str, tuple[Column, Column, Column]] = {
        "impute": (F.col("mean"), none, seen),
        "variance": (F.col("variance"), none, seen & (F.col("variance") > threshold)),
        "minmax": (F.col("lo"), F.col("hi"), seen),
        "zscore": (F.col("mean"), F.sqrt("variance"), seen),
    }
    rows = []
    before: tuple[Column, Column] | None = None  # shift and divisor of the raw values so far
    for number, step in enumerate(steps):
        if isinstance(step, Step):
            kind, effect = step.kind, step.effect
            p1, p2, keep = step.finish(F.col(step.column), known)
            p1, p2, keep = p1.cast("double"), none if p2 is None else p2.cast("double"), F.lit(True) if keep is None else keep
        else:
            kind, effect = step, {"impute": "fill", "variance": "filter"}.get(step, "scale")
            p1, p2, keep = shapes[step]
        after = before
        if effect == "scale":
            width = p2 - p1 if kind == "minmax" else p2
            after = p1, F.when(width == 0, 1.0).otherwise(width)
        if before is not None and effect != "filter":
            shift, divisor = before
            p1, p2 = (p1 - shift) / divisor, (p2 - shift) / divisor if kind == "minmax" else p2 / divisor
        before = after
        rows.append(F.struct(F.lit(number).alias("step"), F.lit(kind).alias("kind"), p1.alias("p1"), p2.alias("p2"), F.coalesce(keep, F.lit(False)).alias("keep")))
    return stats.select(*FOLD, *FEATURE, F.inline(F.array(*rows)))


def fit_omics(
    long: DataFrame,
    k_outer: int,
    k_inner: int,
    threshold: float = VARIANCE_THRESHOLD,
    only: tuple[int, int] | None = None,
    steps: Sequence[str | Step] = OMICS_STEPS,
) -> DataFrame:
    """Parameters of the steps, by default impute, variance filter and min-max; ``long`` carries ``fragment``."""
    return steps_from_statistics(fold_statistics(long, k_outer, k_inner, only, steps), steps, threshold)


def fit_labels(labels: DataFrame, k_outer: int, k_inner: int, only: tuple[int, int] | None = None) -> DataFrame:
    """Impute and z-score parameters; ``labels`` is in the long feature form and carries ``fragment``."""
    return steps_from_statistics(fold_statistics(labels, k_outer, k_inner, only), LABEL_STEPS)


def compile_steps(params: DataFrame) -> DataFrame:
    """One row per fold and feature: ``(v or fill) -> (v - shift) / divisor``, and ``keep``.

    Every scaling step is affine, so the ordered steps of a feature collapse on
    the small parameter table and the large table sees plain arithmetic. A range
    or deviation of zero divides by one.
    """
    begin = F.struct(
        F.lit(None).cast("double").alias("fill"), F.lit(0.0).alias("shift"), F.lit(1.0).alias("divisor")
    )

    def follow(acc: Column, step: Column) -> Column:
        kind = step["kind"]
        width = F.when(kind == "minmax", step["p2"] - step["p1"]).otherwise(step["p2"])
        width = F.when(width == 0, 1.0).otherwise(width)
        scales = kind.isin("minmax", "zscore") | kind.startswith("scale:")
        fills = (kind == "impute") | kind.startswith("fill:")
        return F.struct(
            F.coalesce(acc["fill"], F.when(fills, step["p1"] * acc["divisor"] + acc["shift"])).alias("fill"),
            F.when(scales, acc["shift"] + acc["divisor"] * step["p1"]).otherwise(acc["shift"]).alias("shift"),
            F.when(scales, acc["divisor"] * width).otherwise(acc["divisor"]).alias("divisor"),
        )

    steps = F.sort_array(F.collect_list(F.struct("step", "kind", "p1", "p2")))
    folded = params.groupBy(*FOLD, *FEATURE).agg(F.bool_and("keep").alias("keep"), steps.alias("_steps"))
    return folded.withColumn("_f", F.aggregate("_steps", begin, follow)).select(*FOLD, *FEATURE, "keep", "_f.*")


def apply_steps(
    long: DataFrame, params: DataFrame, salts: int = SALTS, max_rows: int = BROADCAST_ROWS, saved: bool = False
) -> DataFrame:
    """Apply fitted steps: one output row per fold and kept feature.

    ``long`` may be any data, seen before or not. Rows that already carry fold
    columns are matched to their own fold. ``saved`` tells that ``params`` is read
    from storage, so that counting it does not fit it again.
    """
    ready = compile_steps(params).where("keep").drop("keep")
    if set(FOLD) <= set(long.columns):
        rows = sized_join(long, ready, [*FOLD, *FEATURE], salt_by=["ID"], salts=salts, max_rows=max_rows, staged=saved)
    else:
        # one row per feature with the steps of all its folds: the small side does not grow with the folds
        folds = ready.groupBy(*FEATURE).agg(F.collect_list(F.struct(*FOLD, "fill", "shift", "divisor")).alias("_folds"))
        rows = sized_join(long, folds, FEATURE, salt_by=["ID"], salts=salts, max_rows=max_rows, staged=saved)
        rows = rows.select(*long.columns, F.inline("_folds"))
    value = F.coalesce(or_missing(F.col("value")), F.col("fill"))
    return rows.withColumn("value", (value - F.col("shift")) / F.col("divisor")).drop("fill", "shift", "divisor")


def impute(long: DataFrame, params: DataFrame) -> DataFrame:
    return apply_steps(long, params.where(F.col("kind") == "impute"))


def kept_features(params: DataFrame) -> DataFrame:
    """Features that pass every step, per fold."""
    return params.groupBy(*FOLD, *FEATURE).agg(F.bool_and("keep").alias("keep")).where("keep").drop("keep")
