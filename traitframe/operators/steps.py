"""Preprocessing steps that users define: mergeable statistics as column expressions.

A step states how rows of a fragment make a state (``update``), how two states
make one (``merge``) and what a state tells (``finish``). States are gathered
per fragment next to the built-in statistics, so a user's step is fitted for all
folds in the same scan. What is fitted is rows of the parameter table; applying
saved rows needs no step object, only its ``effect``:

``fill``    ``p1`` takes the place of missing values, unless an earlier step filled them
``scale``   ``(value - p1) / p2``, a ``p2`` of zero counts as one
``filter``  features without ``keep`` are dropped
"""

from __future__ import annotations

from abc import ABC, abstractmethod
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

EFFECTS = ("fill", "scale", "filter")


class Step(ABC):
    """One step; ``name`` tells it apart in the parameter table. All numbers are in the units of the raw values."""

    name: str
    effect: str

    @abstractmethod
    def update(self, value: Column) -> Column:
        """Aggregate over rows: the state of a fragment; ``value`` is null where it is missing."""

    @abstractmethod
    def merge(self, left: Column, right: Column) -> Column:
        """State of two fragments together; neither is null."""

    @abstractmethod
    def finish(self, state: Column, seen: Mapping[str, Column]) -> tuple[Column, Column | None, Column | None]:
        """``(p1, p2, keep)`` from the state of a fold's training rows; ``seen`` has the built-in statistics (rows, n, mean, variance, lo, hi)."""

    @property
    def kind(self) -> str:
        if self.effect not in EFFECTS:
            raise ValueError(f"effect must be one of {EFFECTS}")
        return f"{self.effect}:{self.name}"

    @property
    def column(self) -> str:
        return f"state_{self.name}"


@dataclass(frozen=True)
class RobustScale(Step):
    """Median and distance of two quantiles, from quantile sketches that merge."""

    low: float = 0.25
    high: float = 0.75
    name: str = "robust"
    effect: str = "scale"

    def update(self, value: Column) -> Column:
        return F.kll_sketch_agg_double(value)

    def merge(self, left: Column, right: Column) -> Column:
        return F.kll_sketch_merge_double(left, right)

    def finish(self, state, seen):
        # a sketch of no values has no quantiles
        low, middle, high = (F.when(seen["n"] > 0, F.kll_sketch_get_quantile_double(state, F.lit(q))) for q in (self.low, 0.5, self.high))
        return middle, high - low, seen["n"] > 0


@dataclass(frozen=True)
class MaxAbsScale(Step):
    """Division by the largest absolute value."""

    name: str = "maxabs"
    effect: str = "scale"

    def update(self, value: Column) -> Column:
        return F.max(F.abs(value))

    def merge(self, left: Column, right: Column) -> Column:
        return F.greatest(left, right)

    def finish(self, state, seen):
        return F.lit(0.0), state, seen["n"] > 0


@dataclass(frozen=True)
class SeenFilter(Step):
    """Features with a value in at least a share of the training rows."""

    share: float = 0.5
    name: str = "seen"
    effect: str = "filter"

    def update(self, value: Column) -> Column:
        return F.count(value)

    def merge(self, left: Column, right: Column) -> Column:
        return left + right

    def finish(self, state, seen):
        part = state / seen["rows"]
        return part, None, part >= self.share
