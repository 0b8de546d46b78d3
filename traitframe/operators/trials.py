"""Trial log: leaderboard, best models, inferior trials.

Trial log: ``(x_outer, x_inner, val_loss, test_loss, trial_tag, ...)``.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitframe.operators.joins import sized_join

FOLD = ["x_outer", "x_inner"]


def rows_at_minimum(trials: DataFrame, by: Sequence[str], loss: str) -> DataFrame:
    """Rows equal to their group's minimum, ties kept.

    Minima come from a partial aggregate, one row per group; joining them back
    does not move the log while there are few groups, and is salted beyond.
    """
    least = trials.groupBy(*by).agg(F.min(loss).alias(loss))
    return sized_join(trials, least, [*by, loss], "left_semi", salt_by=["trial_tag"])


def group_minimum(trials: DataFrame, by: Sequence[str], loss: str, out: str = "min_loss") -> DataFrame:
    return trials.groupBy(*by).agg(F.min(loss).alias(out))


def best_trials(trials: DataFrame, studies: DataFrame | None = None) -> DataFrame:
    """Best trial of each fold by ``val_loss``, left-joined to the study minima.

    ``studies`` is (x_outer, x_inner, min_loss, ...); without it the minima of
    the log itself are taken. The study's minimum becomes ``val_loss``.
    """
    best = rows_at_minimum(trials, FOLD, "val_loss")
    if studies is None:
        studies = group_minimum(trials, FOLD, "val_loss")
    joined = studies.join(best, FOLD, "left").drop("val_loss")
    return joined.withColumnRenamed("min_loss", "val_loss")


def best_inner(best: DataFrame, select_on: str = "test_loss") -> DataFrame:
    """Per outer fold, the best-trial rows of least ``test_loss`` (or ``val_loss``)."""
    return rows_at_minimum(best.where(F.col(select_on).isNotNull()), ["x_outer"], select_on)


def best_overall(inner: DataFrame) -> DataFrame:
    """The row of least ``val_loss``, ties by ``trial_tag``: a top-1, not a sort."""
    return inner.orderBy("val_loss", "trial_tag").limit(1)


def model_of_fold(best: DataFrame, x_outer: int, x_inner: int) -> DataFrame:
    """The best-trial row of one fold, ties by ``trial_tag``."""
    fold = best.where((F.col("x_outer") == x_outer) & (F.col("x_inner") == x_inner))
    return fold.orderBy("trial_tag").limit(1)


def inferior_trials(trials: DataFrame) -> DataFrame:
    """Trials whose tag is not the tag of a best trial."""
    best = rows_at_minimum(trials, FOLD, "val_loss").select("trial_tag").distinct()
    return sized_join(trials, best, ["trial_tag"], "left_anti", salt_by=["val_loss", "test_loss"])


def leaderboard(trials: DataFrame, studies: DataFrame | None = None, select_on: str = "test_loss") -> tuple[DataFrame, DataFrame]:
    """(best trials sorted by fold, best inner folds sorted by outer fold and test loss)."""
    best = best_trials(trials, studies)
    return best.orderBy(*FOLD, "trial_tag"), best_inner(best, select_on).orderBy("x_outer", "test_loss", "trial_tag")
