"""The loop from state to decision to score: retain the incumbent, or call the exact oracle."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .metrics import evaluate
from .oracle import ExactOracle, NoOracle
from .trigger import RiskTrigger


def decide(states: DataFrame, trigger: RiskTrigger) -> DataFrame:
    """Add ``invoke_oracle`` and ``decision`` (``invoke_oracle`` or ``retain_incumbent``)."""
    d = trigger.apply(states)
    return d.withColumn("decision", F.when(F.col("invoke_oracle"), "invoke_oracle").otherwise("retain_incumbent"))


def solve_picked(states: DataFrame, trigger: RiskTrigger, oracle: ExactOracle | None = None) -> DataFrame:
    """Hand the picked states to the oracle; without one this raises."""
    return (oracle or NoOracle()).solve(decide(states, trigger).where("invoke_oracle"))


def compare(labelled: DataFrame, triggers: Mapping[str, RiskTrigger], truth: str, by: Sequence[str] = ()) -> DataFrame:
    """One row per policy (and group): its rates against the labels, from one scan of the states."""
    votes = F.array(*[F.struct(F.lit(name).alias("policy"), F.coalesce(t.should_invoke_oracle().cast("boolean"), F.lit(False)).alias("invoke_oracle")) for name, t in triggers.items()])
    long = labelled.select(*by, truth, F.explode(votes).alias("v")).select(*by, truth, "v.policy", "v.invoke_oracle")
    return evaluate(long, truth, "invoke_oracle", [*by, "policy"])
