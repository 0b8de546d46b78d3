"""Saved preprocessing on a stream of new rows: a join with static fitted tables, without state."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from traitframe.functions.scoring import or_missing
from traitframe.operators.preprocess import FEATURE, FOLD, compile_steps


def apply_steps_stream(long: DataFrame, params: DataFrame) -> DataFrame:
    """:func:`traitframe.operators.preprocess.apply_steps` for a streaming long table.

    A stream-static join; the static side is read per micro-batch, and Spark
    chooses its strategy from the size of the saved table. Rows that carry fold
    columns meet the steps of their own fold. A feature, or a fold, without
    fitted steps ends the stream with an error.
    """
    on = [*FOLD, *FEATURE] if set(FOLD) <= set(long.columns) else FEATURE
    unknown = F.raise_error(F.concat_ws(" ", F.lit("no fitted steps for"), *on)).cast("boolean")
    joined = long.join(compile_steps(params), on, "left").where(F.coalesce("keep", unknown)).drop("keep")
    value = F.coalesce(or_missing(F.col("value")), F.col("fill"))
    return joined.withColumn("value", (value - F.col("shift")) / F.col("divisor")).drop("fill", "shift", "divisor")
