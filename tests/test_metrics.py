import math
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from decistrata.operators import metrics

GOLDEN = [
    ("mixed", [True, True, False, False], [True, False, False, False], 0.75, 0.5, 0.75),
    ("positives", [True, True], [True, False], 0.5, 0.5, 0.5),
    ("negatives", [False, False], [True, False], 0.5, 0.0, 0.5),
    ("missing truth", [None, True], [False, True], 1.0, 0.0, 0.5),
]


def frame(spark, rows, kind="boolean"):
    return spark.createDataFrame(rows, f"g string, y {kind}, p {kind}")


def test_goldens(spark):
    rows = [(n, y, p) for n, ys, ps, *_ in GOLDEN for y, p in zip(ys, ps, strict=True)]
    got = {r["g"]: r for r in metrics.evaluate(frame(spark, rows), "y", "p", ["g"]).collect()}
    for n, ys, _, ba, fnr, red in GOLDEN:
        r = got[n]
        assert (r["balanced_accuracy"], r["false_negative_rate"], r["exact_solve_reduction_rate"], r["n"]) == (ba, fnr, red, len(ys))


def test_empty(spark):
    r = metrics.evaluate(frame(spark, []), "y", "p").first()
    assert (r["balanced_accuracy"], r["false_negative_rate"], r["exact_solve_reduction_rate"], r["n"]) == (0.0, 0.0, 0.0, 0)
    assert metrics.evaluate(frame(spark, []), "y", "p", ["g"]).count() == 0


@pytest.mark.parametrize(("tp", "fn", "tn", "fp", "ba", "fnr", "red"), [(47, 18, 51, 20, 0.7206933911, 0.2769230769, 0.5073529412), (63, 2, 30, 41, 0.6958829902, 0.0307692308, 0.2352941176)])
def test_counts(spark, tp, fn, tn, fp, ba, fnr, red):
    rows = [("a", True, True)] * tp + [("a", True, False)] * fn + [("a", False, False)] * tn + [("a", False, True)] * fp
    r = metrics.evaluate(frame(spark, rows), "y", "p").first()
    assert r["balanced_accuracy"] == pytest.approx(ba, abs=1e-9)
    assert r["false_negative_rate"] == pytest.approx(fnr, abs=1e-9)
    assert r["exact_solve_reduction_rate"] == pytest.approx(red, abs=1e-9)


def plain(ys, ps):
    """The rates from the four counts of a confusion table."""
    table = Counter((bool(y), bool(p)) for y, p in zip(ys, ps, strict=True))
    tp, fn, tn, fp = (table[c] for c in ((True, True), (True, False), (False, False), (False, True)))
    if tp + fn and tn + fp:
        balanced = (tp / (tp + fn) + tn / (tn + fp)) / 2
    else:
        balanced = (tp + tn) / max(tp + fn + tn + fp, 1)
    return balanced, fn / max(tp + fn, 1), (tn + fn) / max(tp + fn + tn + fp, 1)


def test_random_groups(spark):
    rng = random.Random(3)
    data = {f"g{k}": [(rng.choice([True, False, None]), rng.choice([True, False, None])) for _ in range(rng.randint(1, 30))] for k in range(120)}
    got = metrics.evaluate(frame(spark, [(g, y, p) for g, v in data.items() for y, p in v]), "y", "p", ["g"]).collect()
    assert len(got) == len(data)
    for r in got:
        assert (r["balanced_accuracy"], r["false_negative_rate"], r["exact_solve_reduction_rate"]) == pytest.approx(plain(*zip(*data[r["g"]], strict=True)))


def test_numbers_and_nan(spark):
    r = metrics.evaluate(frame(spark, [("a", 1.0, math.nan), ("a", 0.0, 0.0)], "double"), "y", "p").first()
    assert r["balanced_accuracy"] == 1.0
    with pytest.raises(TypeError):
        metrics.evaluate(frame(spark, [("a", "x", "y")], "string"), "y", "p")


def test_decision_loss(spark):
    df = spark.createDataFrame([(113.5, 100.0), (1.0, None)], "policy double, exact double")
    assert [r[0] for r in df.select(metrics.decision_loss("policy", "exact")).collect()] == [13.5, None]


def test_strict_pairs(spark):
    t = spark.createDataFrame([(1, True), (2, False)], "k int, y boolean")
    p = spark.createDataFrame([(2, True), (1, True)], "k int, p boolean")
    assert sorted(map(tuple, metrics.pair_strictly(t, p, "k", "y", "p").collect())) == [(1, True, True), (2, False, True)]
    for bad in ([(1, True)], [(1, True), (2, True), (2, True)], [(1, True), (2, True), (None, True)], [(1, True), (1, True), (9, True)]):
        pairs = metrics.pair_strictly(t, spark.createDataFrame(bad, "k int, p boolean"), "k", "y", "p")
        for use in (pairs, pairs.select("y"), metrics.evaluate(pairs, "y", "p"), pairs.agg(F.count("*"))):
            with pytest.raises(Exception, match="one to one"):
                use.collect()
    same = metrics.pair_strictly(t, p.withColumnRenamed("p", "y"), "k", "y", "y")
    assert same.columns == ["k", "y", "y_predicted"] and metrics.evaluate(same, "y", "y_predicted").first()["n"] == 2
    assert metrics.evaluate(metrics.pair_strictly(t.limit(0), p.limit(0), "k", "y", "p"), "y", "p").first()["n"] == 0


def test_one_shuffle(spark):
    plan = metrics.evaluate(spark.range(10).select(F.lit("g").alias("g"), (F.col("id") > 3).alias("y"), (F.col("id") > 5).alias("p")), "y", "p", ["g"])._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange") == 1
