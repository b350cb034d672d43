"""Plans: what is read, and how often rows are shuffled."""

import re

from compare import DATA

from decistrata.operators import widen
from decistrata.plans import problems, screening
from decistrata.sources import bounded, table


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def schemas(df) -> list[str]:
    return re.findall(r"ReadSchema: struct<([^\n]*)>", plan(df))


def test_columns_are_pruned(spark):
    (read,) = schemas(screening.feature_columns(spark, DATA))
    assert "demand_features" in read and "cost_features" in read
    assert not any(x in read for x in ("inventory_features", "network_features", "lambda_R", "loaded_at"))
    (read,) = schemas(screening.risk_trigger(spark, DATA))
    assert read == "state_id:bigint,Gamma:double,load_id:bigint"


def test_row_wise_queries_do_not_shuffle(spark):
    for name in ("decision_states", "flatten_features", "feature_columns", "risk_trigger", "oracle_label", "decision_loss"):
        assert "Exchange" not in plan(screening.QUERIES[name](spark, DATA)), name


def test_rows_are_shuffled_once(spark):
    """By entity, for deltas and compaction alike; hot entities are aggregated before."""
    args = (table(spark, DATA, "feature_rows"), table(spark, DATA, "feature_catalog"), table(spark, DATA, "domains"))
    text = plan(widen.compact(widen.deltas(*args)))
    assert text.count("Exchange hashpartitioning(entity_id") == 1
    text = plan(widen.deltas(*args, hot=5))
    assert len(re.findall(r"Exchange hashpartitioning\(entity_id#\d+L, batch#\d+, feature#\d+L", text)) == 1


def test_wide_queries_compact_sorted_runs(spark):
    for name in ("p5_found", "p5_wide"):
        files = [f for f in problems.QUERIES[name](spark, DATA).inputFiles() if "/tables/" in f]
        assert files and not any("feature_rows" in f for f in problems.QUERIES[name](spark, DATA).inputFiles()), name
        for f in files:
            rows = [tuple(r) for r in spark.read.parquet(f).coalesce(1).select("entity_id", "batch").collect()]
            assert rows == sorted(rows), name


def test_profile_has_no_cartesian(spark):
    assert "Cartesian" not in plan(problems.p2_found(spark, DATA)) and "NestedLoop" not in plan(problems.p2_found(spark, DATA))


def test_bounded(spark):
    df = spark.range(50)
    assert "BROADCAST" in bounded(df)._jdf.queryExecution().logical().toString().upper()
    assert bounded(df, 10) is df
