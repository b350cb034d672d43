import itertools
import random

import pytest
from pyspark.sql import functions as F

from decistrata.llm import splits


def brute(edges):
    up = {}
    def find(x):
        up.setdefault(x, x)
        while up[x] != x:
            x = up[x]
        return x
    for a, b in edges:
        if a is not None and b is not None:
            ra, rb = find(a), find(b)
            up[max(ra, rb)] = min(ra, rb)
    return {x: find(x) for x in up}


def parents(spark, edges):
    return {r["node"]: r["root"] for r in splits.components(spark.createDataFrame(edges, "a string, b string")).collect()}


@pytest.mark.parametrize("seed", range(3))
def test_components(spark, seed):
    rng = random.Random(seed)
    edges = [(f"n{rng.randint(0, 60):03d}", f"n{rng.randint(0, 60):03d}") for _ in range(45)] + [(None, "n001"), ("n002", "n002")]
    assert parents(spark, edges) == brute(edges)


def test_chain_star_and_empty(spark):
    chain = [(f"c{k:03d}", f"c{k + 1:03d}") for k in range(60)]
    star = [("hub", f"s{k:03d}") for k in range(60)] * 2
    assert parents(spark, chain + star) == brute(chain + star)
    assert parents(spark, []) == {}


@pytest.mark.parametrize("seed", range(20))
def test_choose_is_closest(seed):
    rng = random.Random(seed)
    h = {}
    for _ in range(rng.randint(1, 4)):
        h[rng.randint(1, 30)] = rng.randint(1, 3)
    target = rng.randint(0, 80)
    took = splits.choose(h, target)
    assert all(k <= h[s] for s, k in took.items())
    sums = {sum(s * k for s, k in zip(h, ks, strict=True)) for ks in itertools.product(*[range(m + 1) for m in h.values()])}
    assert abs(sum(s * k for s, k in took.items()) - target) == min(abs(s - target) for s in sums)


def test_plan_uses_every_component():
    h = {1: 500, 7: 40, 300: 1, 1000: 1}
    p = splits.plan(h, {"test": 0.1, "validation": 0.1, "train": 0.8})
    assert {s: sum(x.get(s, 0) for x in p.values()) for s in h} == h
    total = sum(s * m for s, m in h.items())
    assert sum(s * m for s, m in p["test"].items()) == round(total * 0.1)


@pytest.mark.parametrize("h", [{1: 4_194_304}, {1: 4_194_305}, {1: 10_000_000}, {1: 100_000_000}, {1: 8_400_000}, {5: 60_000_000}, {1: 200_000_000, 3: 5_000_000, 500: 20_000, 9_000_000: 1}])
def test_plan_keeps_proportions_of_large_totals(h):
    p = splits.plan(h, {"test": 0.1, "validation": 0.1, "train": 0.8})
    assert {s: sum(x.get(s, 0) for x in p.values()) for s in h} == h
    total = sum(s * m for s, m in h.items())
    assert [sum(s * m for s, m in p[k].items()) for k in ("test", "validation")] == [round(total * 0.1)] * 2


def test_every_split_has_components_of_all_sizes():
    h = {1: 30_000, 40: 500, 9_000: 20}
    p = splits.plan(h, {"test": 0.1, "validation": 0.1, "train": 0.8})
    total = sum(s * m for s, m in h.items())
    for name, share in (("test", 0.1), ("validation", 0.1), ("train", 0.8)):
        assert sum(s * k for s, k in p[name].items()) == round(share * total)
        assert all(abs(p[name].get(s, 0) - share * m) <= max(0.02 * m, 2) for s, m in h.items())


@pytest.mark.parametrize("seed", range(40))
def test_choose_is_closest_in_parts(seed, monkeypatch):
    """Where only the end of the total is searched at first, with and without a common divisor."""
    monkeypatch.setattr(splits, "UNITS", 5)
    rng = random.Random(seed)
    g = 1 + seed % 4
    h = {g * rng.randint(1, 30): rng.randint(1, 3) for _ in range(rng.randint(1, 4))}
    target = rng.randint(1, 80 * g)
    took = splits.choose(h, target)
    assert all(k <= h[s] for s, k in took.items())
    sums = {sum(s * k for s, k in zip(h, ks, strict=True)) for ks in itertools.product(*[range(m + 1) for m in h.values()])}
    assert sum(s * k for s, k in took.items()) == min(sums, key=lambda s: (abs(s - target), s))


STATES = "state_id bigint, domain_id string, network_id string"
LINKS = "domain_id string, network_id string, related_network_id string, relation string"


def test_pairs_and_split(spark):
    domains = spark.createDataFrame([("toy_outlet",), ("book_postal",)], "domain_id string")
    states = [(1, "toy_outlet", "NW-1-AA"), (2, "Toy Outlet", "nw_0001_aa"), (3, "toy_outlet", "NW-2-BB"), (4, "book_postal", "NW-1-AA"), (5, "toy_outlet", "NW-9-ZZ"), (6, "toy_outlet", None), (6, "toy_outlet", None), (7, "nowhere", "NW-1-AA"), (None, "toy_outlet", "NW-1-AA"), (8, None, "unknown")]
    links = [("toy_outlet", "NW-1-AA", "NW-5-CC", "derived_from"), ("TOY_OUTLET", "NW-5-CC", "NW-2-BB", "merged_into"), ("toy_outlet", "NW-9-ZZ", "NW-1-AA", "near"), ("toy_outlet", "NW-9-ZZ", None, "split_from"), (None, "NW-9-ZZ", "NW-1-AA", "split_from")]
    s = spark.createDataFrame(states, STATES).selectExpr("*", "1 as entity", "'x' as node", "'y' as domain", "2 as _salt")
    links_df = spark.createDataFrame(links, LINKS).selectExpr("*", "'z' as domain", "1 as a", "2 as b")
    assert sorted(map(tuple, splits.bound_pairs(s, links_df, domains).collect())) == [("toy_outlet", "NW-1-AA", "NW-2-BB"), ("toy_outlet", "NW-1-AA", "nw_0001_aa"), ("toy_outlet", "NW-2-BB", "nw_0001_aa")]
    got = {r["state_id"]: r for r in splits.split(s, links_df, domains, {"test": 0.4, "train": 0.6}).collect()}
    assert set(got) == {1, 2, 3, 4, 5, 6, 7, 8}
    assert len({got[k]["split"] for k in (1, 2, 3)}) == 1 and len({got[k]["entity"] for k in (1, 2, 3)}) == 1
    assert sum(r["split"] == "test" for r in got.values()) == 3
    assert splits.split(s.limit(0), links_df.limit(0), domains).count() == 0
    assert splits.bound_pairs(s.limit(0), links_df.limit(0), domains).count() == 0


def test_split_proportions(spark):
    domains = spark.createDataFrame([("toy_outlet",)], "domain_id string")
    s = spark.range(3000).select(F.col("id").alias("state_id"), F.lit("toy_outlet").alias("domain_id"), F.concat(F.lit("NW-"), F.when(F.col("id") < 1000, 1).otherwise(F.col("id") % 150 + 2).cast("string"), F.lit("-AA")).alias("network_id"))
    got = splits.split(s, spark.createDataFrame([], LINKS), domains)
    assert got.groupBy("entity").agg(F.countDistinct("split").alias("n")).where("n > 1").count() == 0
    counts = {r["split"]: r["count"] for r in got.groupBy("split").count().collect()}
    assert sum(counts.values()) == 3000 and abs(counts["test"] - 300) <= 7 and abs(counts["validation"] - 300) <= 7
    again = splits.split(s, spark.createDataFrame([], LINKS), domains, hot=15)
    assert sorted(map(tuple, again.collect())) == sorted(map(tuple, got.collect()))
