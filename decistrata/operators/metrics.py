"""Evaluation of screening rules, as aggregate expressions.

A missing truth or prediction counts as false; numbers count by their truth, NaN being true; other
types are refused. All rates of a call come from one aggregation: partial sums before the one shuffle,
so a group that holds a third of all rows is no hot spot. An empty table gives 0.0 for the global
rates and no rows by group.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def truth(df: DataFrame, column: str) -> Column:
    kind = dict(df.dtypes)[column]
    if kind == "boolean":
        return F.coalesce(F.col(column), F.lit(False))
    if kind in ("tinyint", "smallint", "int", "bigint", "float", "double") or kind.startswith("decimal"):
        return F.coalesce(F.col(column) != 0, F.lit(False))
    raise TypeError(f"{column} is {kind}; a boolean or number is needed")


def balanced_accuracy(y: Column, p: Column) -> Column:
    """Mean recall over the classes that occur; 0.0 if none does."""
    negative, positive = F.avg(F.when(~y, (~p).cast("int"))), F.avg(F.when(y, p.cast("int")))
    return F.coalesce((negative + positive) / 2, negative, positive, F.lit(0.0))


def false_negative_rate(y: Column, p: Column) -> Column:
    """Share of true cases that were missed; 0.0 without true cases."""
    return F.coalesce(F.avg(F.when(y, (~p).cast("int"))), F.lit(0.0))


def exact_solve_reduction_rate(p: Column) -> Column:
    """Share of states for which no exact solve is called; 0.0 for no states."""
    return F.coalesce(F.lit(1.0) - F.avg(p.cast("int")), F.lit(0.0))


def decision_loss(policy_cost: Column | str, exact_cost: Column | str) -> Column:
    """Policy cost less exact cost, per row; positive where the policy costs more."""
    as_column = lambda c: F.col(c) if isinstance(c, str) else c
    return as_column(policy_cost) - as_column(exact_cost)


def evaluate(df: DataFrame, truth_column: str, prediction_column: str, by: Sequence[str] = ()) -> DataFrame:
    """``by, balanced_accuracy, false_negative_rate, exact_solve_reduction_rate, n``."""
    y, p = truth(df, truth_column), truth(df, prediction_column)
    d = df.select(*by, y.alias("_y"), p.alias("_p"))
    y, p = F.col("_y"), F.col("_p")
    aggs = [balanced_accuracy(y, p).alias("balanced_accuracy"), false_negative_rate(y, p).alias("false_negative_rate"), exact_solve_reduction_rate(p).alias("exact_solve_reduction_rate"), F.count(F.lit(1)).alias("n")]
    return d.groupBy(*by).agg(*aggs) if by else d.agg(*aggs)


def pair_strictly(truths: DataFrame, predictions: DataFrame, key: str, truth_column: str, prediction_column: str) -> DataFrame:
    """``key, truth_column, prediction_column`` of two tables that must match one to one; a key that is
    null, repeated or in one table only raises an error when anything of the result is computed, a
    metric included. Two empty tables match. Both columns may have the same name in their tables but not
    here; the prediction is then called ``<name>_predicted``."""
    named = prediction_column if prediction_column not in (key, truth_column) else f"{prediction_column}_predicted"
    a = truths.groupBy(key).agg(F.count(F.lit(1)).alias("_na"), F.first(truth_column).alias("_y"))
    b = predictions.groupBy(key).agg(F.count(F.lit(1)).alias("_nb"), F.first(prediction_column).alias("_p"))
    j = a.join(b, key, "full_outer")
    fine = F.col(key).isNotNull() & (F.coalesce("_na", F.lit(0)) == 1) & (F.coalesce("_nb", F.lit(0)) == 1)
    message = F.concat(F.lit("not matched one to one: "), F.coalesce(F.col(key).cast("string"), F.lit("null")))
    # a filter and not a column, which a metric that doesn't read it would drop
    j = j.where(F.when(fine, F.lit(True)).otherwise(F.raise_error(message).cast("boolean")))
    return j.select(key, F.col("_y").alias(truth_column), F.col("_p").alias(named))
