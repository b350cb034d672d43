import random

from pyspark.sql import functions as F

from decistrata.llm import sampling


def test_quotas():
    assert sampling.quotas([0.5, 0.3, 0.2], [0, 0, 0], [99, 99, 99], 10) == [5, 3, 2]
    assert sampling.quotas([1 / 3, 1 / 3, 1 / 3], [0, 0, 0], [99, 99, 99], 10) == [4, 3, 3]
    assert sampling.quotas([0.9, 0.1], [0, 5], [99, 99], 20) == [15, 5]
    assert sampling.quotas([0.9, 0.1], [0, 0], [4, 99], 20) == [4, 16]
    assert sampling.quotas([0.9, 0.1], [0, 0], [4, 3], 20) == [4, 3]
    assert sampling.quotas([0.0, 1.0], [3, 0], [9, 9], 5) == [3, 2]
    assert sampling.quotas([], [], [], 5) == []


def test_quotas_keep_bounds():
    rng = random.Random(1)
    for _ in range(300):
        n = rng.randint(1, 8)
        want = [rng.random() for _ in range(n)]
        least, there, total = [rng.randint(0, 10) for _ in range(n)], [rng.randint(0, 60) for _ in range(n)], rng.randint(0, 200)
        q = sampling.quotas([w / sum(want) for w in want], least, there, total)
        low = [min(a, b) for a, b in zip(least, there, strict=True)]
        assert all(a <= x <= b for a, x, b in zip(low, q, there, strict=True))
        assert sum(q) == max(sum(low), min(total, sum(there)))


def tables(spark):
    domains = spark.createDataFrame([("toy_outlet",), ("book_postal",)], "domain_id string")
    states = spark.range(600).select(F.col("id").alias("state_id"), F.when(F.col("id") % 10 == 0, "Book Postal").otherwise("toy_outlet").alias("domain_id"))
    states = states.unionByName(states.limit(50)).unionByName(spark.createDataFrame([(None, "toy_outlet"), (9001, None)], "state_id bigint, domain_id string"))
    labels = spark.range(500).select(F.col("id").alias("state_id"), (F.col("id") % 4 == 0).alias("material_reconfiguration"))
    labels = labels.unionByName(labels.limit(30)).unionByName(spark.createDataFrame([(1, None), (7777, True)], "state_id bigint, material_reconfiguration boolean"))
    requests = spark.createDataFrame([("r", 100), ("small", 10)], "request_id string, sample_rows bigint")
    t = [("toy_outlet", True, 0.4, 2), ("toy_outlet", False, 0.3, 2), ("book_postal", True, 0.28, 2), ("book_postal", False, 0.02, 5)]
    targets = spark.createDataFrame([(r, *x) for r in ("r", "small") for x in t], "request_id string, domain_id string, material_reconfiguration boolean, target_share double, min_rows bigint")
    return states, labels, requests, targets, domains


def test_sample(spark):
    states, labels, requests, targets, domains = tables(spark)
    states, targets = (t.selectExpr("*", "'x' as domain", "1 as available", "2 as sample_rows", "3 as rank") for t in (states, targets))
    labels = labels.selectExpr("*", "'x' as domain", "true as outcome")
    report = sampling.allocation(sampling.labelled(states, labels, domains), requests, targets, domains)
    got = {(r["request_id"], r["domain_id"], r["material_reconfiguration"]): r for r in report.collect()}
    assert got["r", "book_postal", True]["available"] == 25 and got["r", "book_postal", True]["quota"] == 25 and got["r", "book_postal", True]["shortfall"] == 3.0
    assert sum(r["quota"] for k, r in got.items() if k[0] == "r") == 100
    assert got["small", "book_postal", False]["quota"] == 5
    assert [tuple(r) for r in sampling.shortfalls(report).collect()] == [("r", "book_postal", "true")]
    drawn = sampling.sample(states, labels, requests, targets, domains)
    n = {(r[0], r[1], r[2]): r[3] for r in drawn.groupBy("request_id", "domain_id", "material_reconfiguration").count().collect()}
    assert n == {k: r["quota"] for k, r in got.items() if r["quota"]}
    assert drawn.count() == drawn.select("request_id", "state_id").distinct().count()
    assert sorted(map(tuple, drawn.collect())) == sorted(map(tuple, sampling.sample(states.repartition(5), labels, requests, targets, domains).collect()))


def test_nulls_in_targets(spark):
    states, labels, requests, _, domains = tables(spark)
    rows = [("r", None, True, 0.5, 1), ("r", "toy_outlet", None, None, None), (None, "toy_outlet", True, 0.5, 3), ("unknown", "toy_outlet", True, 0.5, 4)]
    targets = spark.createDataFrame(rows, "request_id string, domain_id string, material_reconfiguration boolean, target_share double, min_rows bigint")
    report = sampling.allocation(sampling.labelled(states, labels, domains), requests, targets, domains)
    got = {(r["request_id"], r["domain_id"]): (r["needed"], r["available"] > 0, r["quota"]) for r in report.collect()}
    assert got == {("r", None): (50.0, False, 0), ("r", "toy_outlet"): (0.0, False, 0), (None, "toy_outlet"): (3.0, True, 3), ("unknown", "toy_outlet"): (4.0, True, 4)}
    assert [tuple(r) for r in sampling.shortfalls(report).collect()] == [("r", None, "true")]


def test_empty(spark):
    states, labels, requests, targets, domains = tables(spark)
    report = sampling.allocation(sampling.labelled(states.limit(0), labels, domains), requests, targets, domains)
    assert {r["available"] for r in report.collect()} == {0} and sampling.shortfalls(report).count() == 8
    assert sampling.sample(states.limit(0), labels, requests, targets, domains).count() == 0
    assert sampling.sample(states, labels, requests, targets.limit(0), domains).count() == 0
