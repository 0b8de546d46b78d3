"""Evaluation as grouped aggregates: one pass per metric family, any number of groups."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from traitframe.functions.scoring import cross_entropy
from traitframe.operators.positions import group_cut_points, sort_buckets
from traitframe.session import stage


def regression_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """MSE, MAE, Pearson correlation and R2 of ``y_pred`` against ``y`` per group.

    Rows without a label or prediction don't count, in ``n`` neither. Correlation
    and R2 need two rows and a label that varies; null otherwise.
    """
    both = F.col("y").isNotNull() & F.col("y_pred").isNotNull()
    y, y_pred = F.when(both, F.col("y")), F.when(both, F.col("y_pred"))
    error = y_pred - y
    n = F.count(error)
    many = n > 1
    # corr() itself fails on a constant column in ANSI mode
    pearson = F.try_divide(F.covar_pop(y, y_pred), F.sqrt(F.var_pop(y) * F.var_pop(y_pred)))
    return predictions.groupBy(*by).agg(
        n.alias("n"),
        F.avg(error * error).alias("mse"),
        F.avg(F.abs(error)).alias("mae"),
        F.when(many, pearson).alias("pearson"),
        F.when(many, 1 - F.try_divide(F.sum(error * error), F.var_pop(y) * n)).alias("r2"),
    )


def multi_label_loss(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Squared error averaged over rows per label, then summed over labels.

    A label of which no row has a value and a prediction has no error, and the sum is null.
    """
    error = F.col("y_pred") - F.col("y")
    per_label = predictions.groupBy(*by, "label").agg(F.avg(error * error).alias("_mse"))
    return per_label.groupBy(*by).agg(F.when(F.count("_mse") == F.count(F.lit(1)), F.sum("_mse")).alias("loss"))


def mean_loss(losses: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean loss over rows."""
    return losses.groupBy(*by).agg(F.avg("loss").alias("loss"))


def weighted_mean_loss(batches: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Batch losses (``loss``, ``batch_size``) to the mean over rows."""
    size = F.col("batch_size")
    return batches.groupBy(*by).agg((F.sum(F.col("loss") * size) / F.sum(size)).alias("loss"))


def cross_entropy_loss(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Mean softmax cross-entropy of ``scores`` (array by class) against class ``y``."""
    return predictions.groupBy(*by).agg(F.avg(cross_entropy(F.col("scores"), F.col("y"))).alias("loss"))


def confusion(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Rows per (true class ``y``, predicted class ``y_pred``): classes squared, not samples."""
    return predictions.groupBy(*by, "y", "y_pred").agg(F.count(F.lit(1)).alias("n"))


def class_counts(matrix: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Per class: tp, support (true rows) and predicted rows."""
    zero = F.lit(0).cast("bigint")
    hit = F.col("y") == F.col("y_pred")
    sides = F.array(
        F.struct(F.col("y").alias("cls"), F.when(hit, F.col("n")).otherwise(zero).alias("tp"), F.col("n").alias("support"), zero.alias("predicted")),
        F.struct(F.col("y_pred").alias("cls"), zero.alias("tp"), zero.alias("support"), F.col("n").alias("predicted")),
    )
    return matrix.select(*by, F.inline(sides)).groupBy(*by, "cls").agg(
        F.sum("tp").alias("tp"), F.sum("support").alias("support"), F.sum("predicted").alias("predicted")
    )


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def classification_metrics(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Recall, precision, F1 and accuracy (micro, macro, weighted) and Matthews correlation.

    Macro averages run over classes that occur as truth or prediction, weighted
    ones weigh by truth; an undefined ratio counts as 0. Multi-class accuracy per
    class is its recall.
    """
    by = list(by)
    per_class = class_counts(confusion(predictions, by), by)
    tp, support, predicted = F.col("tp").cast("double"), F.col("support").cast("double"), F.col("predicted").cast("double")
    scored = per_class.select(
        *by, tp.alias("tp"), support.alias("support"), predicted.alias("predicted"),
        _safe(tp, support).alias("recall"), _safe(tp, predicted).alias("precision"), _safe(2 * tp, support + predicted).alias("f1"),
    )
    hits, rows = F.sum("tp"), F.sum("support")

    def weighted(name: str) -> Column:
        return _safe(F.sum(F.col(name) * F.col("support")), rows)

    cross = F.sum(F.col("predicted") * F.col("support"))
    pred_sq, true_sq = F.sum(F.col("predicted") * F.col("predicted")), F.sum(F.col("support") * F.col("support"))
    mcc = _safe(hits * rows - cross, F.sqrt((rows * rows - pred_sq) * (rows * rows - true_sq)))
    micro = _safe(hits, rows)
    named = {
        **{f"{m}_micro": micro for m in ("recall", "precision", "f1", "accuracy")},
        **{f"{m}_macro": F.avg(m) for m in ("recall", "precision", "f1")},
        "accuracy_macro": F.avg("recall"),
        **{f"{m}_weighted": weighted(m) for m in ("recall", "precision", "f1")},
        "accuracy_weighted": weighted("recall"),
        "mcc": mcc,
    }
    return scored.groupBy(*by).agg(rows.cast("bigint").alias("n"), *[c.alias(name) for name, c in named.items()])


def auroc_by_class(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """One-vs-rest area under the ROC curve per class, ties counted half.

    ``scores`` is (by..., cls, score, positive). Equal scores collapse into one
    row first; the distinct scores of a class are cut into ordered, even buckets, each bucket is
    ranked on its own, and only bucket totals meet per class. Null when a class
    has no positive or no negative row.
    """
    group = [*by, "cls"]
    positive = F.col("positive").cast("bigint")
    # read twice, for cut points and for ranks; as columns of a table the groups join by key even if they were literals
    levels = stage(scores.groupBy(*group, "score").agg(F.sum(positive).alias("p"), F.sum(1 - positive).alias("n")), "score-levels")
    levels = sort_buckets(levels, "score", group_cut_points(levels, "score", group), group)
    below = Window.partitionBy(*group, "_bucket").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    ranked = levels.withColumn("_below", F.coalesce(F.sum("n").over(below), F.lit(0)))
    buckets = ranked.groupBy(*group, "_bucket").agg(
        F.sum("p").cast("double").alias("p"),
        F.sum("n").cast("double").alias("n"),
        F.sum(F.col("p") * (F.col("_below") + F.col("n") / 2)).alias("u"),
    )
    # a class has at most SORT_BUCKETS bucket rows
    earlier = Window.partitionBy(*group).orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    placed = buckets.withColumn("_before", F.coalesce(F.sum("n").over(earlier), F.lit(0.0)))
    return placed.groupBy(*group).agg(
        F.sum("p").cast("bigint").alias("support"),
        F.try_divide(F.sum(F.col("u") + F.col("p") * F.col("_before")), F.sum("p") * F.sum("n")).alias("auroc"),
    )


def auroc(scores: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """Macro and support-weighted averages over the classes that have an AUROC."""
    per_class = auroc_by_class(scores, by)
    known = F.when(F.col("auroc").isNotNull(), F.col("support"))
    return per_class.groupBy(*by).agg(
        F.avg("auroc").alias("auroc_macro"),
        F.try_divide(F.sum(F.col("auroc") * F.col("support")), F.sum(known)).alias("auroc_weighted"),
    )


def one_vs_rest(predictions: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """(by..., cls, score, positive) rows from ``scores`` arrays and class ``y``."""
    return predictions.select(*by, "y", F.posexplode("scores").alias("cls", "score")).withColumn(
        "positive", F.col("y") == F.col("cls")
    ).drop("y")


def evaluate_folds(predictions: DataFrame) -> DataFrame:
    """Regression metrics of every fold and split, over all rows of the split."""
    return regression_metrics(predictions, ["x_outer", "x_inner", "split"])
