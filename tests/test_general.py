"""Column profile, filling and wide upserts on small tables."""

import datetime as dt
from pathlib import Path

import pytest
from compare import DATA
from pyspark.sql import functions as F

from decistrata import streaming
from decistrata.functions import ids, ranking, values
from decistrata.operators import fill, profile, widen
from decistrata.sources import shared_dir, table

T0 = dt.datetime(2011, 1, 1)


@pytest.mark.parametrize(
    ("written", "meant"),
    [("NW-0000007-KV", "7-KV"), (" nw_7_kv\t", "7-KV"), ("NW０００７KV", "7-KV"), ("network NW–0007–KV", "7-KV"), ("toy_outlet/NW-OOO5O9-OD", "509-OD"), ("Nw 70 Kv", "70-KV"), ("NW-000-AA", "0-AA"), ("unknown", None), ("", None), (None, None), ("NW-12", None), ("XNW-12-AB", None), ("NW-1-ABC", None)],
)
def test_network_key(spark, written, meant):
    assert spark.createDataFrame([(written,)], "x string").select(ids.network_key(F.col("x"))).first()[0] == meant


@pytest.mark.parametrize(("written", "meant"), [("2011-W06", "2011-W06"), ("2011w6", "2011-W06"), ("W06/2011", "2011-W06"), ("?", None), (None, None)])
def test_time_key(spark, written, meant):
    assert spark.createDataFrame([(written,)], "x string").select(ids.time_key(F.col("x"))).first()[0] == meant


@pytest.mark.parametrize(
    ("raw", "kind", "unit", "value"),
    [
        ("1,306.89", "double", None, 1306.89), ("15,10", "double", None, 15.1), ("0,1937", "double", None, 0.1937), ("1.234,5", "double", None, 1234.5), ("1,966", "long", None, 1966.0), ("61.0", "long", None, 61.0),
        ("61.5", "long", None, None), ("0061", "long", None, 61.0), ("76.73%", "double", None, 0.7673), ("-3.5e-1", "double", None, -0.35), ("  34.61 crowns", "double", "crowns", 34.61), ("34.61 crowns", "double", "days", None),
        ("+7", "double", None, 7.0), ("nan", "double", None, None), ("1e", "double", None, None), ("12..5", "double", None, None), ("1.2.3", "double", None, None), ("see note 4", "double", None, None), ("1e999", "double", None, None),
        ("", "double", None, None), (None, "double", None, None), ("Y", "boolean", None, 1.0), (" off ", "boolean", None, 0.0), ("2", "boolean", None, None), ("５", "long", None, 5.0),
    ],
)
def test_read_typed(spark, raw, kind, unit, value):
    df = spark.createDataFrame([(raw, kind, unit)], "r string, k string, u string")
    assert df.select(values.read_typed(F.col("r"), F.col("k"), F.col("u"))["value"]).first()[0] == value


@pytest.mark.parametrize(("raw", "whole"), [("9007199254740993", 2**53 + 1), (" 9,007,199,254,740,993 days", 2**53 + 1), ("-9223372036854775808", -(2**63)), ("9223372036854775807.0", 2**63 - 1), ("9223372036854775808", None), ("1200%", 12), ("1250%", None), ("7.00000000000001", None), ("1e3", 1000), ("9" * 60, None)])
def test_read_whole(spark, raw, whole):
    df = spark.createDataFrame([(raw, "long", "days")], "r string, k string, u string")
    r = df.select(values.read_typed(F.col("r"), F.col("k"), F.col("u")).alias("c")).select("c.*").first()
    assert r["whole"] == whole and r["value"] == (None if whole is None else float(whole))


def test_large_whole_numbers_stay_exact(spark, catalog, domains):
    rows = rows_of(spark, [(1, "toy_outlet", "inventory.stockout_days", "9007199254740993", 0), (2, "toy_outlet", "inventory.stockout_days", "9007199254740993", 0), (2, "toy_outlet", "inventory.stockout_days", "9007199254740992", 0)])
    d = widen.deltas(rows, catalog, domains)
    assert [tuple(r) for r in widen.unclear_cells(d, widen.feature_types(catalog)).collect()] == [(2, "inventory_features.stockout_days", "conflict")]
    got = {r["entity_id"]: r["inventory_features__stockout_days"] for r in widen.wide(widen.compact(d), widen.feature_types(catalog), domains).collect()}
    assert got == {1: 2**53 + 1, 2: None}


def test_latest_of_one_version_is_the_greatest(spark, catalog, domains):
    for order in (1, -1):
        rows = rows_of(spark, [(1, "toy_outlet", "demand.cv", v, 0) for v in ("0.5", "-3", "1e12", "1000000000001", "7")][::order])
        got = widen.wide(widen.compact(widen.deltas(rows, catalog, domains)), widen.feature_types(catalog), domains, "latest").first()
        assert got["demand_features__cv"] == 1000000000001.0


def test_rank_within(spark):
    df = spark.range(5000).select((F.col("id") % 3 == 0).alias("g"), "id").unionByName(spark.createDataFrame([(None, 7000), (None, 7001)], "g boolean, id bigint"))
    got = ranking.rank_within(df, ["g"], ["id"]).groupBy("g").agg(F.count("*").alias("n"), F.countDistinct("rank").alias("d"), F.min("rank").alias("a"), F.max("rank").alias("b")).collect()
    assert {r["g"] for r in got} == {True, False, None}
    assert all(r["a"] == 1 and r["b"] == r["n"] == r["d"] for r in got)
    a, b = (ranking.rank_within(df.repartition(n), ["g"], ["id"]).orderBy("id").collect() for n in (1, 7))
    assert a == b


def loads(spark, per_load):
    return spark.createDataFrame([(k, v, t) for k, rows in per_load.items() for v, t in rows], "load int, v double, t string")


def ordinary(k, n=60):
    return [((7 * i + k) % 50 / 10 + 1, "AB"[i % 2]) for i in range(n)]


def test_profile_exact(spark):
    df = loads(spark, {1: [(1.0, "A"), (None, None), (float("nan"), ""), (2.0, "A"), (2.0, "A")], None: [(1.5, "A")]})
    got = {(r["load_id"], r["column_name"]): r for r in profile.profile(profile.value_counts(df, "load", ["v"], ["t"])).collect()}
    v, t = got[1, "v"], got[1, "t"]
    assert (v["rows"], v["nulls"], v["distinct"], v["least"], v["most"], v["ill_formed"], v["null_rate"]) == (5, 1, 3, 1.0, 2.0, 1, 0.2)
    assert (t["rows"], t["nulls"], t["distinct"]) == (5, 1, 2)
    assert got[None, "v"]["rows"] == 1


def test_profile_issues(spark):
    data = {k: ordinary(k) for k in range(9)}
    data[2] = [(None if i % 2 else v, t) for i, (v, t) in enumerate(data[2])]
    data[3] = [(v * 40 if i % 3 == 0 else v, t) for i, (v, t) in enumerate(data[3])]
    data[4] = [(1.2, t) for v, t in data[4]]
    data[5] = [(v, f"{t};x" if i % 2 else t) for i, (v, t) in enumerate(data[5])]
    data[6] = [(v, "A" if i % 20 else "B") for i, (v, t) in enumerate(data[6])]
    p = profile.profile(profile.value_counts(loads(spark, data), "load", ["v"], ["t"]))
    got = sorted((r["load_id"], r["column_name"], r["issue"]) for r in profile.issues(p).collect())
    assert (2, "v", "null_rate") in got and (3, "v", "range") in got and (4, "v", "distribution") in got and (6, "t", "distribution") in got and (5, "t", "written_form") in got
    assert {(k, c) for k, c, _ in got} == {(2, "v"), (3, "v"), (4, "v"), (5, "t"), (6, "t")}


def test_profile_clashing_columns(spark):
    df = loads(spark, {1: [(1.0, "A")]}).selectExpr("*", "9 as load_id", "'x' as column_name", "7 as number", "'y' as text", "3 as n")
    got = {r["column_name"]: r for r in profile.profile(profile.value_counts(df, "load", ["v"], ["t"])).collect()}
    assert set(got) == {"v", "t"} and got["v"]["load_id"] == 1 and got["v"]["most"] == 1.0


def test_profile_empty_and_single(spark):
    assert profile.profile(profile.value_counts(loads(spark, {}), "load", ["v"], ["t"])).count() == 0
    p = profile.profile(profile.value_counts(loads(spark, {1: [(None, None)] * 3}), "load", ["v"], ["t"]))
    assert profile.issues(p).count() == 0 and {r["null_rate"] for r in p.collect()} == {1.0}


CATALOG = [("toy_outlet", "demand_features", "cv", "double", None), ("toy_outlet", "demand_features", "mean_weekly", "double", "units"), ("toy_outlet", "inventory_features", "stockout_days", "long", "days"), ("toy_outlet", "cost_features", "fx_hedged", "boolean", None)]


@pytest.fixture(scope="module")
def catalog(spark):
    return spark.createDataFrame(CATALOG, "domain_id string, feature_group string, feature_name string, value_type string, unit string")


@pytest.fixture(scope="module")
def domains(spark):
    return spark.createDataFrame([("toy_outlet", "Toys", dt.date(2020, 1, 1))], "domain_id string, title string, opened_on date")


ROWS = "entity_id bigint, domain_id string, network_id string, time_id string, attr_name string, raw_value string, loaded_at timestamp"


def rows_of(spark, cells):
    return spark.createDataFrame([(e, d, None, None, a, v, T0 + dt.timedelta(days=k)) for e, d, a, v, k in cells], ROWS)


CELLS = [
    (1, "Toy Outlet", "demandFeatures.cv", "0,5", 0), (1, "toy_outlet", "DEMAND_FEATURES.CV", "0.5", 1), (1, "toy_outlet", "demand.mean_weekly", "12.0 units", 0), (1, "toy_outlet", "demand_features.mean_weekly", "13", 3),
    (1, "toy_outlet", "cost_features/fx_hedged", "yes", 0), (1, "toy_outlet", "cost.fx_hedged", "?", 9), (2, "toy_outlet", "inventory_features__stockout_days", "n/a", 0), (2, "toy_outlet", "note", "keep", 0),
    (3, "toy_outlet", "x1", "1", 0), (3, "toy_outlet", None, None, 0), (None, "toy_outlet", "demand_features.cv", "1", 0), (4, "nowhere", "demand_features.cv", "1", 0),
]


def test_widen(spark, catalog, domains):
    c = widen.compact(widen.deltas(rows_of(spark, CELLS * 3), catalog, domains))
    assert sorted(map(tuple, widen.unclear_cells(c, widen.feature_types(catalog)).collect())) == [(1, "demand_features.mean_weekly", "conflict"), (2, "inventory_features.stockout_days", "no_value")]
    types = widen.feature_types(catalog)
    got = {r["entity_id"]: r for r in widen.wide(c, types, domains).collect()}
    assert set(got) == {1, 2, 3, 4}
    assert (got[1]["demand_features__cv"], got[1]["demand_features__mean_weekly"], got[1]["cost_features__fx_hedged"]) == (0.5, None, True)
    assert all(got[k][c] is None for k in (2, 3, 4) for c in got[k].asDict() if "__" in c)
    last = {r["entity_id"]: r for r in widen.wide(c, types, domains, "latest").collect()}
    assert last[1]["demand_features__mean_weekly"] == 13.0
    kinds = dict(widen.wide(c, types, domains).dtypes)
    assert (kinds["inventory_features__stockout_days"], kinds["cost_features__fx_hedged"]) == ("bigint", "boolean")


def test_widen_in_batches(spark, catalog, domains):
    whole = widen.compact(widen.deltas(rows_of(spark, CELLS), catalog, domains))
    parts = [widen.compact(widen.deltas(rows_of(spark, CELLS[k::3]), catalog, domains)) for k in range(3)]
    merged = widen.merge_deltas(*parts)
    types = widen.feature_types(catalog)
    for how in ("empty", "latest"):
        a, b = (sorted(map(str, widen.wide(x, types, domains, how).collect())) for x in (whole, merged))
        assert a == b


def test_hot_entities(spark, catalog, domains, monkeypatch):
    rows = rows_of(spark, CELLS * 3)
    types = widen.feature_types(catalog)

    def result(**how):
        d = widen.deltas(rows, catalog, domains, **how)
        return sorted(map(str, widen.wide(widen.compact(d), types, domains, "latest").collect())), sorted(map(tuple, widen.unclear_cells(d, types).collect()))

    cold = result()
    assert result(hot=10) == cold and result(hot=0) == cold
    monkeypatch.setattr(widen, "HOT_LIST", 1)
    assert result(hot=0) == cold


def test_runs(spark, catalog, domains, tmp_path):
    whole = widen.compact(widen.deltas(rows_of(spark, CELLS), catalog, domains))
    for k in range(3):
        widen.write_run(widen.deltas(rows_of(spark, CELLS[k::3]), catalog, domains), str(tmp_path / "log"))
    types = widen.feature_types(catalog)
    a, b = (sorted(map(str, widen.wide(x, types, domains, "latest").collect())) for x in (whole, widen.compact(widen.read_runs(spark, str(tmp_path / "log")))))
    assert a == b


def test_upsert_stream(spark, catalog, domains, tmp_path):
    source, log = str(tmp_path / "in"), str(tmp_path / "log")
    for k in range(10):
        rows_of(spark, CELLS[k::10]).coalesce(1).write.mode("append").parquet(source)
    tables = Path(shared_dir(spark).removeprefix("file:").replace("//", "/")) / "tables" / spark.sparkContext.applicationId
    before = len(list(tables.glob("*"))) if tables.exists() else 0
    stream = spark.readStream.schema(ROWS).option("maxFilesPerTrigger", 1).parquet(source)
    q = streaming.upserts(stream, catalog, domains, log).option("checkpointLocation", str(tmp_path / "c")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    assert q.exception() is None and len(list((tmp_path / "log").iterdir())) == 10
    assert len(list(tables.glob("*"))) == before  # no table of a batch is left
    types = widen.feature_types(catalog)
    whole = widen.compact(widen.deltas(rows_of(spark, CELLS), catalog, domains))
    a, b = (sorted(map(str, widen.wide(x, types, domains, "latest").collect())) for x in (whole, widen.compact(widen.read_runs(spark, f"{log}/*"))))
    assert a == b


def test_widen_empty_and_extra_columns(spark, catalog, domains):
    none = rows_of(spark, []).withColumn("domain", F.lit("clash")).withColumn("value", F.lit(1)).withColumn("cells", F.lit(1))
    assert widen.compact(widen.deltas(none, catalog, domains)).count() == 0
    some = rows_of(spark, CELLS).withColumn("domain", F.lit("clash")).withColumn("value", F.lit(1)).withColumn("feature", F.lit("f")).withColumn("unit", F.lit("u"))
    assert widen.unclear_cells(widen.deltas(some, catalog, domains), widen.feature_types(catalog)).count() == 2


STATES = "state_id bigint, domain_id string, network_id string, time_id string, demand_features map<string,double>, inventory_features map<string,double>, network_features map<string,double>"
SHAPE = {"nodes": 5.0, "arcs": 9.0, "hub_share": 0.25}
OTHER = {"nodes": 6.0, "arcs": 8.0, "hub_share": 0.5}


def test_fill(spark, catalog, domains):
    rows = [
        (1, "toy_outlet", "NW-1-AA", "2011-W01", {"cv": 0.4, "mean_weekly": 10.0}, {"stockout_days": 1.0}, SHAPE),
        (2, "TOY_OUTLET", "NW-0001-AA", "2011-W02", {"cv": float("nan"), "mean_weekly": 12.0}, {"stockout_days": -1.0}, SHAPE),
        (3, "toy_outlet", "unknown", "2011-W02", {"cv": -999.0, "mean_weekly": 1e20}, None, SHAPE),
        (4, "toy_outlet", "NW-2-BB", "2011-W02", {"cv": 0.9, "mean_weekly": 90000.0}, {"stockout_days": 3.0}, OTHER),
        (4, "toy_outlet", "NW-2-BB", "2011-W02", {"cv": 0.9, "mean_weekly": None}, {}, OTHER),
        (5, "nowhere", None, None, None, None, None),
        (None, "toy_outlet", None, None, None, None, None),
    ]
    df = spark.createDataFrame(rows, STATES).withColumn("domain", F.lit("clash")).withColumn("missing", F.lit(1))
    got = {(r["state_id"], r["field"]): r for r in fill.fill(df, catalog, domains).collect()}
    assert set(got) == {(2, "demand_features.cv"), (2, "inventory_features.stockout_days"), (3, "network_id"), (3, "demand_features.cv"), (3, "demand_features.mean_weekly"), (3, "inventory_features.stockout_days"), (5, "network_id")}
    assert got[3, "network_id"]["label"] == "1-AA" and got[3, "network_id"]["score"] == 1.0
    assert not got[5, "network_id"]["filled"]
    assert all(r["filled"] for k, r in got.items() if k[0] != 5)
    # three parts of the network's mean (0.4 and the fills near it), one of the week's
    assert 0.4 < got[2, "demand_features.cv"]["value"] < 0.65
    assert got[3, "demand_features.mean_weekly"]["value"] > 11


def test_fill_networks_without_likeness(spark, catalog, domains):
    """A state of a known domain gets a network from its week and domain where its structure tells none."""
    far = "NW-1234567890123456-ZZ"  # too long a number to be supplied
    rows = [(k, "toy_outlet", "NW-1-AA", "2011-W01", None, None, SHAPE) for k in range(3)] + [(k, "toy_outlet", "NW-2-BB", "2011-W02", None, None, OTHER) for k in (3, 4)]
    rows += [(k, "toy_outlet", far, "2011-W02", None, None, {"nodes": 7.0, "arcs": 7.0}) for k in range(5, 12)]
    rows += [(20, "toy_outlet", None, "2011-W02", None, None, None), (21, "toy_outlet", None, "2011-W09", None, None, {}), (22, "toy_outlet", None, None, None, None, {"nodes": 6.0}), (23, "nowhere", None, "2011-W02", None, None, None), (24, "toy_outlet", None, "2011-W01", None, None, OTHER), (25, "toy_outlet", "?", "2011-W01", None, None, {"nodes": 7.0, "arcs": 7.0})]
    got = {r["state_id"]: r for r in fill.fill(spark.createDataFrame(rows, STATES), catalog, domains).where("field = 'network_id'").collect()}
    assert {k: r["label"] for k, r in got.items()} == {20: "2-BB", 21: "1-AA", 22: "1-AA", 23: None, 24: "2-BB", 25: "1-AA"}
    assert all(r["filled"] == (k != 23) for k, r in got.items())
    # the week has only NW-2-BB; the domain, at half the week's weight, has it twice in five
    assert got[20]["score"] == pytest.approx((1 + 0.5 * 0.4) / 1.5) and got[21]["score"] == pytest.approx(0.6) and got[24]["score"] == 1.0


def test_fill_converges(spark, catalog, domains):
    """Filled numbers are near the propagation's limit, also where a network has none of its own."""
    rows = [(1, "toy_outlet", "NW-1-AA", "2011-W01", {"cv": 1.0}, None, SHAPE), (2, "toy_outlet", "NW-2-BB", "2011-W02", {"cv": 9.0}, None, OTHER)]
    rows += [(10 + k, "toy_outlet", "NW-3-CC", f"2011-W0{1 + k % 2}", None, None, None) for k in range(6)] + [(20 + k, "toy_outlet", "NW-2-BB", "2011-W01", None, None, OTHER) for k in range(3)]
    df = spark.createDataFrame(rows, STATES)

    def cv(spread):
        got = fill.fill(df, catalog, domains, spread=spread).where("field = 'demand_features.cv'").collect()
        return {r["state_id"]: r["value"] for r in got}

    limit, got = cv(fill.Spread(rounds=20, tolerance=0.0)), cv(fill.Spread())
    assert cv(fill.Spread(sent=0)) == pytest.approx(got)
    assert set(got) == set(limit) == {*range(10, 16), 20, 21, 22}
    assert all(abs(got[k] / limit[k] - 1) < 0.02 for k in got)


def test_empty_catalog(spark, catalog, domains):
    states = spark.createDataFrame([(1, "toy_outlet", "NW-1-AA", "2011-W01", {"cv": 0.4}, None, SHAPE), (2, "toy_outlet", "?", None, None, None, SHAPE)], STATES)
    got = [(r["state_id"], r["field"], r["label"], r["filled"]) for r in fill.fill(states, catalog.limit(0), domains).collect()]
    assert got == [(2, "network_id", "1-AA", True)]
    c = widen.compact(widen.deltas(rows_of(spark, CELLS), catalog.limit(0), domains))
    assert widen.wide(c, widen.feature_types(catalog.limit(0)), domains).count() == 4
    assert widen.unclear_cells(c, widen.feature_types(catalog.limit(0))).count() == 0


def test_fill_empty(spark, catalog, domains):
    assert fill.fill(spark.createDataFrame([], STATES), catalog, domains).count() == 0


def test_what_cannot_be_a_measurement(spark, catalog, domains):
    """Codes recur in several features, peaks don't; no number is too large by itself."""
    rows = [(k, "toy_outlet", "NW-1-AA", "2011-W01", {"cv": 0.1 + k % 7 / 10, "mean_weekly": 100.0 + k}, {"stockout_days": float(k % 5)}, SHAPE) for k in range(400)]
    odd = [(1000, 12e6, 0.4, 1.0), (1001, 99999999.0, 99999999.0, 1.0), (1002, 90.0, 1e20, -1.0), (1003, -5.0, -999.0, 99999999.0), (1004, float("inf"), float("nan"), 0.0)]
    rows += [(k, "toy_outlet", "NW-1-AA", "2011-W01", {"cv": c, "mean_weekly": m}, {"stockout_days": d}, SHAPE) for k, m, c, d in odd]
    got = {(r["state_id"], r["field"].split(".")[1]) for r in fill.fill(spark.createDataFrame(rows, STATES), catalog, domains).collect()}
    assert got == {(1001, "cv"), (1001, "mean_weekly"), (1002, "cv"), (1002, "stockout_days"), (1003, "cv"), (1003, "mean_weekly"), (1003, "stockout_days"), (1004, "cv"), (1004, "mean_weekly")}


def test_signed_features(spark, catalog, domains):
    """A feature with many different numbers below zero may be negative, however few they are."""
    rows = [(k, "toy_outlet", "NW-1-AA", "2011-W01", {"cv": (k + 1) / 100 * (-1 if k % 20 == 0 else 1), "mean_weekly": -1.0 if k % 20 == 0 else 5.0}, {"stockout_days": 1.0}, SHAPE) for k in range(400)]
    got = [r["field"] for r in fill.fill(spark.createDataFrame(rows, STATES), catalog, domains).collect()]
    assert got == ["demand_features.mean_weekly"] * 20


def test_held_out_values(spark):
    """Values that are there, hidden and filled again: networks nearly all right, numbers far nearer than the mean."""
    states = table(spark, DATA.replace("sf0.001", "sf0.01"), "decision_states")
    d = DATA.replace("sf0.001", "sf0.01")
    hide = F.pmod(F.xxhash64("state_id"), F.lit(20))
    cv = F.col("demand_features")["cv"]
    hidden = states.withColumn("network_id", F.when(hide != 0, F.col("network_id"))).withColumn("demand_features", F.when(hide != 1, F.col("demand_features")).otherwise(F.map_filter("demand_features", lambda k, v: k != "cv")))
    got = fill.fill(hidden, table(spark, d, "feature_catalog"), table(spark, d, "domains"))
    truth = states.groupBy("state_id").agg(F.max(ids.network_key(F.col("network_id"))).alias("net"), F.max(F.when((cv >= 0) & (cv < 10), cv)).alias("cv"))
    both = got.join(truth, "state_id")
    nets = both.where((hide == 0) & (F.col("field") == "network_id") & F.col("net").isNotNull()).agg(F.count("*").alias("n"), F.avg((F.coalesce("label", F.lit("")) == F.col("net")).cast("int")).alias("right")).first()
    assert nets["n"] > 150 and nets["right"] > 0.95
    mean = truth.agg(F.avg("cv")).first()[0]
    cvs = both.where((hide == 1) & (F.col("field") == "demand_features.cv") & F.col("cv").isNotNull()).agg(F.count("*").alias("n"), F.avg(F.abs(F.col("value") - F.col("cv"))).alias("off"), F.avg(F.abs(mean - F.col("cv"))).alias("base")).first()
    assert cvs["n"] > 150 and cvs["off"] < 0.45 * cvs["base"]


def test_hot_cases(spark):
    """Cases with too many states for a task give the same values by the other way."""
    missing = spark.range(60).selectExpr("id as state_id", "cast(id % 3 as string) as field", "id % 6 as case")
    known = spark.range(6).selectExpr("id as case", "id * 10.0D as m", "if(id = 5, null, id * 1.5D) as value")
    results = [sorted((r["state_id"], r["field"], r["value"] or -1.0) for r in fill._with_cases(missing, known, hot).collect()) for hot in (1000, 25, 0)]
    assert len(results[0]) == 60 and results[0] == results[1] == results[2]
