"""The queries of decision states, features, triggers and their evaluation, and their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import with_domain
from ..operators import features, metrics, oracle, policy, validation
from ..operators.trigger import AnyTrigger, RiskTrigger, ThresholdTrigger
from ..schemas import FEATURE_GROUPS
from ..sources import table

#: Example policies; the thresholds are parameters without a source.
POLICIES: dict[str, RiskTrigger] = {
    "gamma_at_least_7": ThresholdTrigger("Gamma", 7.0),
    "beta_at_most_0_3": ThresholdTrigger("beta", 0.3, above=False),
    "short_cover_or_gamma": AnyTrigger(ThresholdTrigger("Gamma", 8.0), ThresholdTrigger("inventory_features.days_cover", 7.0, above=False)),
}


def _number(domain: str) -> Column:
    return F.when(F.col(domain).isNotNull(), F.xxhash64(domain))


def _named(result: DataFrame, spark: SparkSession, d: str) -> DataFrame:
    names = table(spark, d, "domains").select(F.xxhash64("domain_id").alias("domain"), F.col("domain_id").alias("name")).distinct()
    return result.join(names, "domain", "left").drop("domain").withColumnRenamed("name", "domain")


def _labelled(spark: SparkSession, d: str) -> DataFrame:
    """States with their label, one row per ``state_id``: repeated deliveries have the same content, and
    of repeated labels the one that has the outcome counts. The domain travels as a number, so that
    states are hashed and not sorted; :func:`_named` gives its name back to the few rows of a result."""
    s = with_domain(features.decision_states(table(spark, d, "decision_states"), ["state_id"]), table(spark, d, "domains"))
    s = s.groupBy("state_id").agg(F.max(_number("domain")).alias("domain"), *[F.max(c).alias(c) for c in ("beta", "Gamma", "lambda_R")], F.max(F.col("inventory_features")["days_cover"]).alias("days_cover"))
    y = oracle.oracle_labels(table(spark, d, "oracle_labels"), ("state_id",)).groupBy("state_id").agg(F.max("material_reconfiguration").alias("material_reconfiguration"))
    cover = F.create_map(F.lit("days_cover"), F.col("days_cover")).alias("inventory_features")
    return s.join(y, "state_id").select("state_id", "domain", "beta", "Gamma", "lambda_R", cover, "material_reconfiguration")


_LABELLED_SQL = """
WITH dom AS (SELECT domain_id AS domain, regexp_replace(lower(domain_id), '[^a-z0-9]+', '', 'g') AS k FROM domains),
s AS (SELECT state_id, max(domain) AS domain, max(beta) AS beta, max("Gamma") AS g, max(list_extract(map_extract(inventory_features, 'days_cover'), 1)) AS days_cover
      FROM decision_states LEFT JOIN dom ON k = regexp_replace(lower(domain_id), '[^a-z0-9]+', '', 'g') GROUP BY state_id),
y AS (SELECT state_id, coalesce(bool_or(material_reconfiguration), false) AS y FROM oracle_labels GROUP BY state_id),
l AS (SELECT s.*, y.y, coalesce(g >= 7.0, false) AS p FROM s JOIN y USING (state_id))
"""
_BA = "coalesce((avg(CASE WHEN NOT y THEN (NOT p)::INT END) + avg(CASE WHEN y THEN p::INT END)) / 2, avg(CASE WHEN NOT y THEN (NOT p)::INT END), avg(CASE WHEN y THEN p::INT END), 0.0)"
_FNR = "coalesce(avg(CASE WHEN y THEN (NOT p)::INT END), 0.0)"
_RED = "coalesce(1.0 - avg(p::INT), 0.0)"


def _rate(name: str):
    def query(spark: SparkSession, d: str) -> DataFrame:
        decided = POLICIES["gamma_at_least_7"].apply(_labelled(spark, d), "p")
        return _named(metrics.evaluate(decided, "material_reconfiguration", "p", ["domain"]).select("domain", name), spark, d)

    query.__name__ = name
    return query


def policy_evaluation(spark: SparkSession, d: str) -> DataFrame:
    return policy.compare(_labelled(spark, d), POLICIES, "material_reconfiguration")


def paired_evaluation(spark: SparkSession, d: str) -> DataFrame:
    """Truths and decisions as two tables that must match one to one; any other pairing raises."""
    labelled = _labelled(spark, d)
    decided = policy.decide(labelled.select("state_id", "Gamma"), POLICIES["gamma_at_least_7"]).select("state_id", "invoke_oracle")
    pairs = metrics.pair_strictly(labelled.select("state_id", "material_reconfiguration"), decided, "state_id", "material_reconfiguration", "invoke_oracle")
    return metrics.evaluate(pairs, "material_reconfiguration", "invoke_oracle")


def decision_loss(spark: SparkSession, d: str) -> DataFrame:
    """Stand-in costs: a line's full price as the policy's cost, its discounted price as the exact one."""
    li = table(spark, d, "lineitem")
    return li.select("l_orderkey", "l_linenumber", metrics.decision_loss("l_extendedprice", F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("loss"))


def decision_states(spark: SparkSession, d: str) -> DataFrame:
    s = features.decision_states(table(spark, d, "decision_states"), ["state_id", "load_id"])
    return s.select("state_id", "load_id", "domain_id", "network_id", "time_id", "beta", "Gamma", "lambda_R", *[F.size(g).cast("bigint").alias(f"n_{g}") for g in FEATURE_GROUPS])


def flatten_features(spark: SparkSession, d: str) -> DataFrame:
    s = features.decision_states(table(spark, d, "decision_states"), ["state_id", "load_id"])
    return features.flatten_long(s, ["state_id", "load_id"], position=False)


def feature_columns(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "decision_states")
    return features.flatten_wide(s, ["beta", "Gamma", "demand_features.cv", "cost_features.penalty_unit"], ["state_id", "load_id"])


def field_names(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(n,) for n in sorted(validation.field_names())], "field_name string")


def leakage_check(spark: SparkSession, d: str) -> DataFrame:
    return spark.createDataFrame([(validation.has_post_solve_leakage(),)], "has_post_solve_leakage boolean")


def strict_leakage(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "decision_states").agg(F.count(F.when(validation.leaking_key(), 1)).alias("leaking_rows"), F.count(F.lit(1)).alias("n_rows"))


def risk_trigger(spark: SparkSession, d: str) -> DataFrame:
    s = table(spark, d, "decision_states").select("state_id", "load_id", "Gamma")
    return policy.decide(s, POLICIES["gamma_at_least_7"]).select("state_id", "load_id", "invoke_oracle", "decision")


def oracle_label(spark: SparkSession, d: str) -> DataFrame:
    return oracle.oracle_labels(table(spark, d, "oracle_labels"), ("state_id", "load_id"))


def oracle_provenance(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "oracle_provenance").select("provenance_id", "repository", "commit_sha", "model_name", "algorithm_name", "frozen")


def pinned_oracle(spark: SparkSession, d: str) -> DataFrame:
    return oracle.OracleProvenance().to_df(spark).select("commit_sha", "model_name", "algorithm_name", "frozen")


QUERIES = {
    **{n: _rate(n) for n in ("balanced_accuracy", "false_negative_rate", "exact_solve_reduction_rate")},
    **{f.__name__: f for f in (policy_evaluation, paired_evaluation, decision_loss, decision_states, flatten_features, feature_columns, field_names, leakage_check, strict_leakage, risk_trigger, oracle_label, oracle_provenance, pinned_oracle)},
}

_NAMES = sorted(validation.field_names())
_GROUP_ROWS = "\nUNION ALL\n".join(
    f"SELECT state_id, load_id, '{g}.' || e.key AS feature_name, e.value AS feature_value FROM (SELECT state_id, load_id, unnest(map_entries({g})) AS e FROM decision_states)" for g in FEATURE_GROUPS
)
_CONTROL_ROWS = "\nUNION ALL\n".join(f"""SELECT state_id, load_id, '{c}' AS feature_name, "{c}" AS feature_value FROM decision_states""" for c in ("beta", "Gamma", "lambda_R"))
_KEYS = " OR ".join(f"list_has_any(coalesce(map_keys({g}), []), ['RI', 'iterations', 'material_reconfiguration', 'objective', 'optimization_value', 'oracle_status', 'runtime'])" for g in FEATURE_GROUPS)
_POLICY_ROWS = """, v AS (
SELECT 'gamma_at_least_7' AS policy, y, coalesce(g >= 7.0, false) AS p FROM l
UNION ALL SELECT 'beta_at_most_0_3', y, coalesce(beta <= 0.3, false) FROM l
UNION ALL SELECT 'short_cover_or_gamma', y, coalesce(g >= 8.0, false) OR coalesce(days_cover <= 7.0, false) FROM l)
"""
SQL = {
    "balanced_accuracy": f"{_LABELLED_SQL} SELECT domain, {_BA} AS balanced_accuracy FROM l GROUP BY domain",
    "false_negative_rate": f"{_LABELLED_SQL} SELECT domain, {_FNR} AS false_negative_rate FROM l GROUP BY domain",
    "exact_solve_reduction_rate": f"{_LABELLED_SQL} SELECT domain, {_RED} AS exact_solve_reduction_rate FROM l GROUP BY domain",
    "policy_evaluation": f"{_LABELLED_SQL} {_POLICY_ROWS} SELECT policy, {_BA} AS balanced_accuracy, {_FNR} AS false_negative_rate, {_RED} AS exact_solve_reduction_rate, count(*) AS n FROM v GROUP BY policy",
    "paired_evaluation": f"{_LABELLED_SQL} SELECT {_BA} AS balanced_accuracy, {_FNR} AS false_negative_rate, {_RED} AS exact_solve_reduction_rate, count(*) AS n FROM l",
    "decision_loss": "SELECT l_orderkey, l_linenumber, l_extendedprice - l_extendedprice * (1 - l_discount) AS loss FROM lineitem",
    "decision_states": "SELECT state_id, load_id, domain_id, network_id, time_id, beta, \"Gamma\", lambda_R, " + ", ".join(f"coalesce(cardinality({g}), 0)::BIGINT AS n_{g}" for g in FEATURE_GROUPS) + " FROM decision_states",
    "flatten_features": f"{_CONTROL_ROWS}\nUNION ALL\n{_GROUP_ROWS}",
    "feature_columns": """SELECT state_id, load_id, beta, "Gamma", list_extract(map_extract(demand_features, 'cv'), 1) AS demand_features__cv, list_extract(map_extract(cost_features, 'penalty_unit'), 1) AS cost_features__penalty_unit FROM decision_states""",
    "field_names": "SELECT field_name FROM (VALUES " + ", ".join(f"('{n}')" for n in _NAMES) + ") t(field_name)",
    "leakage_check": "SELECT false AS has_post_solve_leakage",
    "strict_leakage": f"SELECT count(*) FILTER (WHERE {_KEYS}) AS leaking_rows, count(*) AS n_rows FROM decision_states",
    "risk_trigger": """SELECT state_id, load_id, coalesce("Gamma" >= 7.0, false) AS invoke_oracle, CASE WHEN coalesce("Gamma" >= 7.0, false) THEN 'invoke_oracle' ELSE 'retain_incumbent' END AS decision FROM decision_states""",
    "oracle_label": "SELECT state_id, load_id, material_reconfiguration, optimization_value, oracle_status FROM oracle_labels",
    "oracle_provenance": "SELECT provenance_id, repository, commit_sha, model_name, algorithm_name, frozen FROM oracle_provenance",
    "pinned_oracle": f"SELECT '{oracle.PINNED_COMMIT}' AS commit_sha, 'robust inventory reconfiguration model' AS model_name, 'PRB-Benders' AS algorithm_name, true AS frozen",
}
