"""Screening rules: whether the exact oracle is worth calling. A trigger never sets an inventory."""

from __future__ import annotations

from abc import ABC, abstractmethod

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


class RiskTrigger(ABC):
    """A rule as a column expression; ``True`` means that the oracle is to be called."""

    @abstractmethod
    def should_invoke_oracle(self) -> Column:
        """Boolean expression over the fields of a decision state."""

    def apply(self, states: DataFrame, to: str = "invoke_oracle") -> DataFrame:
        """Add the decision, never null: where the rule can't tell, the oracle isn't called."""
        return states.withColumn(to, F.coalesce(self.should_invoke_oracle().cast("boolean"), F.lit(False)))


class ThresholdTrigger(RiskTrigger):
    """Calls the oracle where a control or feature (``group.name``) reaches a threshold, or falls to it."""

    def __init__(self, field: str, threshold: float, above: bool = True):
        self.field, self.threshold, self.above = field, threshold, above

    def should_invoke_oracle(self) -> Column:
        group, dot, key = self.field.partition(".")
        value = F.col(group)[key] if dot else F.col(self.field)
        return value >= self.threshold if self.above else value <= self.threshold


class AnyTrigger(RiskTrigger):
    """Calls the oracle where one of several rules does."""

    def __init__(self, *triggers: RiskTrigger):
        self.triggers = triggers

    def should_invoke_oracle(self) -> Column:
        votes = [F.coalesce(t.should_invoke_oracle().cast("boolean"), F.lit(False)) for t in self.triggers]
        return F.array_contains(F.array(*votes), True) if votes else F.lit(False)
