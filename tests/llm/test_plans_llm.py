"""Documents are scanned once and never shuffled."""

from compare import DATA

from decistrata.llm import queries


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def test_documents_are_not_shuffled(spark):
    assert "Exchange" not in plan(queries.p6_ids(spark, DATA))
    assert "Exchange" not in plan(queries.p8_found(spark, DATA))
    found = plan(queries.p7_found(spark, DATA))  # only found pairs are
    assert found.count("Exchange") == 1 and "text" not in found[: found.index("MapInArrow")]


def test_pairs_meet_by_entity_alone(spark):
    assert "Cartesian" not in plan(queries.p1_found(spark, DATA)) and "NestedLoop" not in plan(queries.p1_found(spark, DATA))
