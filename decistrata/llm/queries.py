"""The queries of the problems tagged llm (1, 3, 6, 7 and 8) and their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..plans.problem_sql import DOMAINS, domain_key, network_key
from ..sources import table
from . import leakage, reading, sampling, splits, tokens


def _networks(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame, DataFrame]:
    return table(spark, d, "decision_states"), table(spark, d, "network_links"), table(spark, d, "domains")


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    return splits.bound_pairs(*_networks(spark, d))


def p1_splits(spark: SparkSession, d: str) -> DataFrame:
    return splits.split(*_networks(spark, d))


def p1_check(spark: SparkSession, d: str) -> DataFrame:
    """What a split must keep: every state once, no entity in two splits, the shares in hundredths."""
    s = p1_splits(spark, d)
    part = lambda name: F.round(F.avg((F.col("split") == name).cast("int")), 2).alias(f"{name}_share")
    entities = F.count_distinct("entity")
    torn = (F.count_distinct("entity", "split") - entities).alias("torn_entities")
    return s.agg(F.count(F.lit(1)).alias("assigned"), F.count_distinct("state_id").alias("states"), *[part(x) for x in ("test", "validation", "train")], entities.alias("entities"), torn)


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return sampling.shortfalls(_report(spark, d))


def _report(spark: SparkSession, d: str) -> DataFrame:
    domains = table(spark, d, "domains")
    pool = sampling.labelled(table(spark, d, "decision_states"), table(spark, d, "oracle_labels"), domains)
    return sampling.allocation(pool, table(spark, d, "sample_requests"), table(spark, d, "sample_targets"), domains)


def p3_report(spark: SparkSession, d: str) -> DataFrame:
    """What each target needs, has and lacks."""
    r = _report(spark, d)
    return r.select("request_id", "domain_id", "material_reconfiguration", "target_share", "min_rows", "needed", "available", F.round("shortfall", 6).alias("shortfall"))


def p3_check(spark: SparkSession, d: str) -> DataFrame:
    """The sample drawn, by request: rows, distinct states, and rows of states not labelled so or beyond a target's rows."""
    drawn = p3_sample(spark, d).groupBy("request_id", "domain_id", "material_reconfiguration").agg(F.count(F.lit(1)).alias("rows"), F.count_distinct("state_id").alias("states"))
    r = _report(spark, d).join(drawn, ["request_id", "domain_id", "material_reconfiguration"], "left").fillna(0, ["rows", "states"])
    short = F.greatest(F.least("min_rows", "available") - F.col("rows"), F.lit(0))
    return r.groupBy("request_id").agg(F.sum("rows").alias("drawn"), F.sum("states").alias("states"), F.sum(F.greatest(F.col("rows") - F.col("available"), F.lit(0))).alias("beyond_available"), F.sum(short).alias("below_minimum"))


def p3_sample(spark: SparkSession, d: str) -> DataFrame:
    return sampling.sample(*[table(spark, d, t) for t in ("decision_states", "oracle_labels", "sample_requests", "sample_targets", "domains")])


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return leakage.held_passages(table(spark, d, "documents"), table(spark, d, "eval_items")).select("doc_id", "item_id")


def p6_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.token_ids(table(spark, d, "documents"))


def p8_found(spark: SparkSession, d: str) -> DataFrame:
    return reading.reading_levels(table(spark, d, "documents"), table(spark, d, "doc_levels"))


def p8_profile(spark: SparkSession, d: str) -> DataFrame:
    """Documents by source and level; a null level is a document without enough running prose."""
    documents = table(spark, d, "documents")
    model = reading.fit(reading.grades(documents, table(spark, d, "doc_levels")))
    rated = reading.rate(documents, model, ["source", "n_chars"])
    return rated.groupBy("source", "reading_level").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("chars"))


QUERIES = {f.__name__: f for f in (p1_found, p1_splits, p1_check, p3_found, p3_report, p3_sample, p3_check, p6_ids, p7_found, p8_found, p8_profile)}
_P1_NODES = f"""WITH RECURSIVE {DOMAINS},
w AS (SELECT DISTINCT domain, network_id, domain || '|' || {network_key('network_id')} AS node FROM decision_states JOIN dom ON dk = {domain_key('domain_id')} WHERE {network_key('network_id')} IS NOT NULL),
l AS (SELECT domain || '|' || {network_key('network_id')} AS a, domain || '|' || {network_key('related_network_id')} AS b FROM network_links JOIN dom ON dk = {domain_key('domain_id')}
      WHERE lower(trim(relation)) IN ('derived_from', 'renamed_to', 'merged_into', 'split_from')),
e AS (SELECT a, b FROM l WHERE a <> b UNION SELECT b, a FROM l WHERE a <> b),
reach(a, b) AS (SELECT a, a FROM e UNION SELECT reach.a, e.b FROM reach JOIN e ON reach.b = e.a),
root AS (SELECT a, min(b) AS root FROM reach GROUP BY a)"""

_P1 = f"""{_P1_NODES},
n AS (SELECT domain, network_id, coalesce(root, node) AS entity FROM w LEFT JOIN root ON a = node)
SELECT x.domain AS domain_id, x.network_id AS network_id_a, y.network_id AS network_id_b FROM n x JOIN n y ON x.entity = y.entity AND x.network_id < y.network_id"""

_P1_CHECK = f"""{_P1_NODES},
s AS (SELECT state_id, coalesce(max(CASE WHEN {network_key('network_id')} IS NOT NULL THEN domain || '|' || {network_key('network_id')} END), 'state|' || state_id) AS node
      FROM decision_states LEFT JOIN dom ON dk = {domain_key('domain_id')} WHERE state_id IS NOT NULL GROUP BY state_id)
SELECT count(*) AS assigned, count(DISTINCT state_id) AS states, 0.1::DOUBLE AS test_share, 0.1::DOUBLE AS validation_share, 0.8::DOUBLE AS train_share,
       count(DISTINCT coalesce(root, node)) AS entities, 0::BIGINT AS torn_entities FROM s LEFT JOIN root ON a = node"""

_P3_COUNTS = f"""WITH {DOMAINS},
s AS (SELECT DISTINCT state_id, domain FROM decision_states JOIN dom ON dk = {domain_key('domain_id')}),
y AS (SELECT DISTINCT state_id, material_reconfiguration AS m FROM oracle_labels WHERE material_reconfiguration IS NOT NULL),
n AS (SELECT domain, m, count(*) AS available FROM s JOIN y USING (state_id) GROUP BY ALL),
t AS (SELECT request_id, t.domain_id, t.material_reconfiguration, target_share, min_rows, sample_rows, greatest(round(target_share * sample_rows, 6), min_rows) AS needed, coalesce(available, 0) AS available
      FROM sample_targets t JOIN sample_requests r USING (request_id) LEFT JOIN n ON n.domain = t.domain_id AND n.m = t.material_reconfiguration)
"""
_P3 = f"""{_P3_COUNTS}SELECT request_id, domain_id, material_reconfiguration::VARCHAR AS material_reconfiguration FROM t WHERE available < needed"""

_P3_REPORT = f"""{_P3_COUNTS}SELECT request_id, domain_id, material_reconfiguration, target_share, min_rows, needed, available, round(greatest(needed - available, 0.0), 6) AS shortfall FROM t"""

#: Where floors and caps allow it, a request gets all its rows.
_P3_CHECK = f"""{_P3_COUNTS}SELECT request_id, least(greatest(max(sample_rows), sum(least(min_rows, available))), sum(available))::BIGINT AS drawn,
       least(greatest(max(sample_rows), sum(least(min_rows, available))), sum(available))::BIGINT AS states, 0::BIGINT AS beyond_available, 0::BIGINT AS below_minimum FROM t GROUP BY request_id"""

SQL = {"p1_found": _P1, "p1_check": _P1_CHECK, "p3_found": _P3, "p3_report": _P3_REPORT, "p3_check": _P3_CHECK}
