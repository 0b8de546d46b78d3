"""Prepare nested cross-validation data: join, pad, split, preprocess, write."""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from traitframe.constants import (
    FOREST_FEATURES,
    FOREST_SEEDS,
    FOREST_TREES,
    SEED_RESAMPLE,
    SEED_SPLIT,
    VARIANCE_THRESHOLD,
)
from traitframe.functions.folds import fold_role, fragments_of
from traitframe.operators.folds import given_fragments, random_fragments, with_folds
from traitframe.operators.joins import require_rows, sized_join
from traitframe.operators.preprocess import (
    FOLD,
    LABEL_STEPS,
    OMICS_STEPS,
    apply_steps,
    attach,
    fit_labels,
    fit_omics,
    kept_features,
    steps_from_statistics,
    table_statistics,
)
from traitframe.operators.samples import first_occurrences, labels_as_omics, pad_samples, shared_omics_ids
from traitframe.operators.steps import Step
from traitframe.plans.forest import forest_steps
from traitframe.session import new_path, stage
from traitframe.sources.folds import read_folds, write_folds
from traitframe.sources.sinks import write_metadata, write_table


@dataclass(frozen=True)
class ForestSettings:
    """Random-forest feature selection of every omics table."""

    n_features: int = FOREST_FEATURES
    n_trees: int = FOREST_TREES
    seeds: tuple[int, ...] = FOREST_SEEDS
    max_depth: int = 10


@dataclass
class Prepared:
    """What :func:`prepare_ncv` made; every frame covers all prepared folds."""

    samples: DataFrame  # x_outer, x_inner, split, ID, copy_no, fragment
    omics: DataFrame  # ... omics, feature_idx, feature, value
    labels: DataFrame | None  # ... label, y
    params: DataFrame  # fitted steps of omics and labels
    base: DataFrame  # ID, copy_no, fragment, omics, feature_idx, feature, value: before any step
    base_labels: DataFrame | None


def shared_sample_ids(omics: DataFrame, labels: DataFrame | None) -> DataFrame:
    """IDs present in every omics table and in the labels, written once.

    The large table is read once, for its distinct (ID, omics) pairs; everything
    after that runs on thin tables.
    """
    present = stage(omics.select("ID", "omics").distinct(), "presence")
    ids = shared_omics_ids(present, present.select("omics").distinct().count())
    if labels is not None:
        ids = ids.join(labels.select("ID").distinct(), "ID", "left_semi")
    return require_rows(stage(ids, "shared-ids"), "no sample is present in every table")


def assemble(omics: DataFrame, labels: DataFrame | None) -> tuple[DataFrame, DataFrame | None]:
    """Restrict a long omics frame and labels to the samples all of them share; of a repeated sample the first occurrence counts."""
    omics = first_occurrences(omics)
    ids = shared_sample_ids(omics, labels)
    kept = sized_join(omics, ids, ["ID"], "left_semi", staged=True)
    return kept, None if labels is None else sized_join(labels, ids, ["ID"], "left_semi", staged=True)


def prepare_ncv(
    omics: DataFrame,
    labels: DataFrame | None,
    k_outer: int,
    k_inner: int,
    *,
    fragments: DataFrame | None = None,
    only: tuple[int, int] | None = None,
    pad: str = "duplicate",
    prepare_labels: bool = True,
    prepare_omics: bool = True,
    codes: Sequence[str] = (),
    seed_split: int = SEED_SPLIT,
    seed_resample: int = SEED_RESAMPLE,
    threshold: float = VARIANCE_THRESHOLD,
    forest: ForestSettings | None = None,
    steps: Sequence[str | Step] = OMICS_STEPS,
) -> Prepared:
    """All folds in one plan.

    ``steps`` are applied to feature tables in order: names of built-in steps or
    steps of your own (:class:`traitframe.operators.steps.Step`), fitted in the same scan.

    ``codes`` names omics tables that hold genotype codes; they are not
    preprocessed. Of a sample that a table holds twice the first occurrence
    counts. ``pad='duplicate'`` adds resampled copies until the fragments
    are even; copies of a sample may then land in different splits, which
    ``pad='none'`` avoids.
    """
    if pad not in ("duplicate", "none"):
        raise ValueError("pad must be 'duplicate' or 'none'")
    n_fragments = k_outer * k_inner
    omics = first_occurrences(omics)
    ids = shared_sample_ids(omics, labels)
    if pad == "duplicate" and fragments is None:
        samples = pad_samples(ids, multiple_of=n_fragments, seed=seed_resample)
    else:
        samples = ids.withColumn("copy_no", F.lit(0))
    if fragments is None:
        cut = random_fragments(samples, n_fragments, seed_split, ["ID", "copy_no"]).drop("position")
    else:
        cut = given_fragments(samples, fragments, n_fragments)
    # one thin row per sample: written once, read by every later step. Joining it
    # also drops the samples that are not shared.
    cut = stage(cut, "fragments")
    plan = with_folds(cut, k_outer, k_inner, only)

    params = None
    placed_labels = as_omics = None
    if labels is not None:
        as_omics = attach(labels_as_omics(labels), cut, staged=True)
        if prepare_labels:
            params = stage(fit_labels(as_omics, k_outer, k_inner, only), "label-steps")
            ready = apply_steps(as_omics, params, saved=True)
        else:
            ready = with_folds(as_omics, k_outer, k_inner, only).drop("split")
        placed_labels = ready.select(*FOLD, "ID", "copy_no", "fragment", F.col("feature").alias("label"), F.col("value").alias("y"))

    placed = attach(omics, cut, staged=True)
    treated = placed.where(~F.col("omics").isin(*codes)) if codes else placed
    if prepare_omics:
        fitted = stage(fit_omics(treated, k_outer, k_inner, threshold, only, steps), "omics-steps")
        ready_omics = apply_steps(treated, fitted, saved=True)
        if forest is not None:
            if placed_labels is None:
                raise ValueError("feature selection needs labels")
            # written by fold, so that each forest reads its own partition only
            path = new_path(omics.sparkSession, "scaled")
            write_folds(_split(ready_omics, k_outer, k_inner), path)
            chosen = forest_steps(
                read_folds(omics.sparkSession, path), placed_labels, forest.n_features, forest.n_trees, forest.seeds, forest.max_depth
            )
            fitted = stage(fitted.unionByName(chosen.withColumn("step", F.lit(len(steps)))), "omics-steps")
            ready_omics = apply_steps(treated, fitted, saved=True)
        params = fitted if params is None else params.unionByName(fitted)
    else:
        ready_omics = with_folds(treated, k_outer, k_inner, only).drop("split")
    if codes:
        coded = with_folds(placed.where(F.col("omics").isin(*codes)), k_outer, k_inner, only).drop("split")
        ready_omics = ready_omics.unionByName(coded.withColumn("value", F.col("value").cast("double")))

    if params is None:
        params = fit_omics(treated, k_outer, k_inner, threshold, only).limit(0)
    return Prepared(
        samples=plan,
        omics=_split(ready_omics, k_outer, k_inner),
        labels=None if placed_labels is None else _split(placed_labels, k_outer, k_inner),
        params=params,
        base=placed,
        base_labels=as_omics,
    )


def _split(rows: DataFrame, k_outer: int, k_inner: int) -> DataFrame:
    """Add ``split`` to rows that carry fold and fragment."""
    return rows.withColumn("split", fold_role(F.col("fragment"), F.col("x_outer"), F.col("x_inner"), k_outer, k_inner))


def write_prepared(prepared: Prepared, path: str) -> None:
    """Write datasets, fitted steps and metadata below ``path``."""
    write_folds(prepared.omics, f"{path}/omics")
    if prepared.labels is not None:
        write_folds(prepared.labels, f"{path}/labels")
    write_table(prepared.params, f"{path}/steps")
    # from the written columns, rather than preparing everything once more
    spark = prepared.samples.sparkSession
    labels = None if prepared.labels is None else read_folds(spark, f"{path}/labels")
    write_metadata(read_folds(spark, f"{path}/omics"), labels, prepared.samples, f"{path}/metadata")


def write_once(prepared: Prepared, path: str) -> None:
    """Write the samples once, by fragment, with the fitted steps, instead of once per fold.

    A dataset of 10 x 5 folds then takes the room of one, and :func:`read_once`
    applies the steps of the fold it is asked for.
    """
    for name, rows in (("omics", prepared.base), ("labels", prepared.base_labels)):
        if rows is not None:
            even = rows.hint("rebalance", F.col("fragment"))
            even.write.option("compression", "zstd").partitionBy("fragment").parquet(f"{path}/{name}")
    write_table(prepared.params, f"{path}/steps")


def read_once(
    spark: SparkSession, path: str, k_outer: int, k_inner: int, x_outer: int, x_inner: int, split: str, table: str = "omics"
) -> DataFrame:
    """One split of one fold from :func:`write_once`: its fragments only, with its steps applied.

    A table without fitted steps in any fold comes back as it was written; a
    fold that was not fitted is an error.
    """
    wanted = fragments_of(split, x_outer, x_inner, k_outer, k_inner)
    rows = spark.read.parquet(f"{path}/{table}").where(F.col("fragment").isin(wanted))
    rows = rows.withColumn("x_outer", F.lit(x_outer)).withColumn("x_inner", F.lit(x_inner)).withColumn("split", F.lit(split))
    saved = spark.read.parquet(f"{path}/steps")
    folds = saved.select("x_outer", "x_inner", "omics").distinct().collect()  # one row per fold and table
    fitted = sorted({r["omics"] for r in folds if (r["x_outer"], r["x_inner"]) == (x_outer, x_inner)})
    if folds and not fitted:
        raise ValueError(f"fold ({x_outer}, {x_inner}) was not prepared")
    steps = saved.where((F.col("x_outer") == x_outer) & (F.col("x_inner") == x_inner))
    raw = rows.where(~F.col("omics").isin(fitted))
    return apply_steps(rows, steps, saved=True).select(*rows.columns).unionByName(raw)


def fit_whole(omics: DataFrame, labels: DataFrame | None = None, threshold: float = VARIANCE_THRESHOLD) -> DataFrame:
    """Steps fitted on every row of a dataset that is not split into folds."""
    steps = steps_from_statistics(table_statistics(omics), OMICS_STEPS, threshold)
    if labels is None:
        return steps
    return steps.unionByName(steps_from_statistics(table_statistics(labels_as_omics(labels)), LABEL_STEPS))


def apply_preprocessors(omics: DataFrame, labels: DataFrame | None, params: DataFrame, path: str | None = None):
    """Apply saved steps to external data without fitting; optionally write it.

    Fails when a table or a feature has no saved steps, or the data lacks a feature
    that a fold kept: vectors made of it would be shorter than the model's.
    """
    given = omics.select("omics", "feature").distinct()
    if labels is not None:
        given = given.unionByName(labels_as_omics(labels).select("omics", "feature").distinct())
    given = stage(given, "given-features")
    known = params.groupBy("omics").agg(F.count(F.lit(1))).select("omics")
    unknown = sorted(r["omics"] for r in given.select("omics").distinct().join(known, "omics", "left_anti").collect())
    if unknown:
        raise ValueError(f"no saved steps for {unknown}")
    tables = given.select("omics").distinct()
    for message, lack in (
        ("features without saved steps", given.join(params.select("omics", "feature").distinct(), ["omics", "feature"], "left_anti")),
        ("features missing in the data", kept_features(params).select("omics", "feature").distinct().join(tables, "omics", "left_semi").join(given, ["omics", "feature"], "left_anti")),
    ):
        some = [f"{r['omics']}.{r['feature']}" for r in lack.orderBy("omics", "feature").limit(5).collect()]
        if some:
            raise ValueError(f"{message}: {', '.join(some)}")
    ready = apply_steps(omics, params, saved=True)
    ready_labels = None
    if labels is not None:
        ready_labels = apply_steps(labels_as_omics(labels), params, saved=True).select(
            *FOLD, "ID", F.col("feature").alias("label"), F.col("value").alias("y")
        )
    if path is not None:
        write_table(ready, f"{path}/omics")
        if ready_labels is not None:
            write_table(ready_labels, f"{path}/labels")
        # of what was written, not of what was given
        spark = omics.sparkSession
        written = spark.read.parquet(f"{path}/omics")
        written_labels = None if ready_labels is None else spark.read.parquet(f"{path}/labels")
        write_metadata(written, written_labels, written.select("ID").distinct(), f"{path}/metadata")
    return ready, ready_labels
