"""The queries of the general data-processing problems (2, 4 and 5) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import fill, profile, widen
from ..sources import scratch, table
from . import problem_sql

NUMERIC = ["beta", "Gamma", "lambda_R"]


def _profile(spark: SparkSession, d: str) -> DataFrame:
    states = profile.value_counts(table(spark, d, "decision_states"), "load_id", NUMERIC, [])
    labels = profile.value_counts(table(spark, d, "oracle_labels"), "load_id", [], ["oracle_status"])
    return profile.profile(states.unionByName(labels))


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    return profile.issues(_profile(spark, d))


def _rounded(df: DataFrame) -> DataFrame:
    """Sums of logarithms and quotients without the digits that depend on the order of their parts."""
    places = {"psi": 6, "psi_before": 6, "chi_square": 3}
    return df.select(*[F.round(c, places[c]).alias(c) if c in places else F.col(c) for c in df.columns])


def p2_profile(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(_profile(spark, d))


def p2_exact(spark: SparkSession, d: str) -> DataFrame:
    """The figures of the profile that are exact counts and values."""
    p = _profile(spark, d)
    return p.select("load_id", "column_name", p["rows"].alias("n_rows"), "nulls", p["distinct"].alias("n_distinct"), "least", "most")


def p2_drift(spark: SparkSession, d: str) -> DataFrame:
    return _rounded(profile.drift(_profile(spark, d)))


def _fill(spark: SparkSession, d: str) -> DataFrame:
    return fill.fill(table(spark, d, "decision_states"), table(spark, d, "feature_catalog"), table(spark, d, "domains"))


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return _fill(spark, d).select("state_id", "field")


def p4_fills(spark: SparkSession, d: str) -> DataFrame:
    return _fill(spark, d)


def p4_check(spark: SparkSession, d: str) -> DataFrame:
    """By field: how many states lack it, how many of these got a value or a label, and what is marked so."""
    f = _fill(spark, d)
    return f.groupBy("field").agg(F.count_distinct("state_id").alias("missing"), F.count("value").alias("values"), F.count("label").alias("labels"), F.count(F.when(F.col("filled"), 1)).alias("marked"))


def _runs(spark: SparkSession, d: str) -> DataFrame:
    """Deltas of all batches, written as a sorted run that compaction reads."""
    log = scratch(spark)
    widen.write_run(widen.deltas(table(spark, d, "feature_rows"), table(spark, d, "feature_catalog"), table(spark, d, "domains")), log)
    return widen.read_runs(spark, log)


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    return widen.unclear_cells(_runs(spark, d), widen.feature_types(table(spark, d, "feature_catalog")))


def p5_wide(spark: SparkSession, d: str) -> DataFrame:
    return widen.wide(widen.compact(_runs(spark, d)), widen.feature_types(table(spark, d, "feature_catalog")), table(spark, d, "domains"))


def p5_latest(spark: SparkSession, d: str) -> DataFrame:
    """The wide table in which the latest version of a cell wins where its rows contradict each other."""
    return widen.wide(widen.compact(_runs(spark, d)), widen.feature_types(table(spark, d, "feature_catalog")), table(spark, d, "domains"), "latest")


QUERIES = {f.__name__: f for f in (p2_found, p2_profile, p2_exact, p2_drift, p4_found, p4_fills, p4_check, p5_found, p5_wide, p5_latest)}
SQL = {"p2_profile": problem_sql.P2_PROFILE, "p2_drift": problem_sql.P2_DRIFT, "p2_found": problem_sql.P2_FOUND, "p2_exact": problem_sql.P2_EXACT, "p4_found": problem_sql.P4_FOUND, "p4_check": problem_sql.P4_CHECK, "p5_found": problem_sql.P5_FOUND, "p5_wide": problem_sql.P5_WIDE, "p5_latest": problem_sql.P5_LATEST}
