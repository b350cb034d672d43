"""Samples whose categories match target proportions.

Categories are counted over all rows; integer quotas come from the largest remainder with floors
and availability caps; the rows with the smallest random keys of each category are taken by an
exact distributed rank; what can't be met is reported.
"""

from __future__ import annotations

import math
from typing import TYPE_CHECKING

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ids import with_domain
from ..functions.ranking import key_range, rank_within
from ..sources import durable, ship

if TYPE_CHECKING:  # the driver needs no pandas of its own
    import pandas as pd


def labelled(states: DataFrame, labels: DataFrame, domains: DataFrame) -> DataFrame:
    """Distinct ``state_id, domain, outcome`` of states that have a label row with the outcome.
    Rows without state, domain or outcome are no part of any category."""
    s = with_domain(states.select("state_id", "domain_id"), domains).where(F.col("state_id").isNotNull() & F.col("domain").isNotNull()).select("state_id", "domain").distinct()
    y = labels.where(F.col("material_reconfiguration").isNotNull()).select("state_id", F.col("material_reconfiguration").alias("outcome")).distinct()
    return s.join(y, "state_id")


def quotas(want: list[float], least: list[int], there: list[int], total: int) -> list[int]:
    """Rows to take of each category.

    The total is shared out in proportion to ``want`` by largest remainder, each category getting
    no less than its minimum and no more than it has. What a cap or a floor changes is shared out
    again among the free categories until nothing changes. The sum is ``total`` wherever floors and
    caps allow. Ties in the remainder go to the earlier category.
    """
    n = len(want)
    low = [min(a, b) for a, b in zip(least, there, strict=True)]
    fixed: dict[int, int] = {}
    while True:
        free = [i for i in range(n) if i not in fixed]
        rest = max(0, total - sum(fixed.values()))
        weight = sum(max(want[i], 0.0) for i in free)
        if not free or weight <= 0:
            out = [fixed.get(i, low[i]) for i in range(n)]
            return out
        exact = {i: rest * max(want[i], 0.0) / weight for i in free}
        # bind the side whose breaches weigh more, as in water filling
        over = {i: exact[i] - there[i] for i in free if exact[i] > there[i]}
        under = {i: low[i] - exact[i] for i in free if exact[i] < low[i]}
        if not over and not under:
            base = {i: math.floor(exact[i] + 1e-9) for i in free}
            more = round(rest) - sum(base.values())
            order = sorted(free, key=lambda i: (-(round(exact[i] - base[i], 9)), i))
            for i in order:
                if more <= 0:
                    break
                if base[i] < there[i]:
                    base[i] += 1
                    more -= 1
            return [fixed.get(i, base.get(i, 0)) for i in range(n)]
        if sum(over.values()) >= sum(under.values()):
            fixed |= {i: there[i] for i in over}
        else:
            fixed |= {i: low[i] for i in under}


REPORT = "request_id string, domain_id string, material_reconfiguration boolean, target_share double, min_rows bigint, needed double, available bigint, quota bigint, shortfall double"


def _allocate(pdf: pd.DataFrame) -> pd.DataFrame:
    pdf = pdf.sort_values(["domain_id", "material_reconfiguration"], na_position="first", ignore_index=True)
    share = pdf.target_share.fillna(0.0).tolist()
    least = pdf.min_rows.fillna(0).astype("int64").tolist()
    there = pdf.available.astype("int64").tolist()
    total = int(pdf.sample_rows.fillna(0).iloc[0])
    pdf["quota"] = quotas(share, least, there, total)
    pdf["needed"] = [max(round(s * total, 6), float(m)) for s, m in zip(share, least, strict=True)]
    pdf["shortfall"] = (pdf.needed - pdf.available).clip(lower=0.0)
    return pdf[["request_id", "domain_id", "material_reconfiguration", "target_share", "min_rows", "needed", "available", "quota", "shortfall"]]


def allocation(pool: DataFrame, requests: DataFrame, targets: DataFrame, domains: DataFrame) -> DataFrame:
    """One row per target: what is needed (the greater of share x rows and the minimum), available and
    allotted, and the shortfall. A target of a request without ``sample_rows`` asks for its minimum."""
    counts = pool.groupBy("domain", "outcome").agg(F.count(F.lit(1)).alias("available"))
    t = with_domain(targets.select("request_id", "domain_id", "material_reconfiguration", "target_share", "min_rows"), domains).join(requests.groupBy("request_id").agg(F.max("sample_rows").alias("sample_rows")), "request_id", "left")
    t = t.join(counts.withColumnRenamed("outcome", "material_reconfiguration"), ["domain", "material_reconfiguration"], "left")
    t = t.select("request_id", F.coalesce("domain", "domain_id").alias("domain_id"), "material_reconfiguration", "target_share", "min_rows", "sample_rows", F.coalesce("available", F.lit(0)).alias("available"))
    ship(targets.sparkSession)
    return t.groupBy("request_id").applyInPandas(_allocate, REPORT)  # a group is one request's targets


def shortfalls(report: DataFrame) -> DataFrame:
    """``request_id, domain_id, material_reconfiguration`` (as text) of targets that can't be met."""
    return report.where(F.col("available") < F.col("needed")).select("request_id", "domain_id", F.col("material_reconfiguration").cast("string").alias("material_reconfiguration"))


def sample(states: DataFrame, labels: DataFrame, requests: DataFrame, targets: DataFrame, domains: DataFrame, seed: int = 23) -> DataFrame:
    """``request_id, state_id, domain_id, material_reconfiguration``: the rows drawn. A category's rows
    have one random order; a request takes its first ones, so the draw repeats with the same seed."""
    pool = durable(labelled(states, labels, domains))
    report = allocation(pool, requests, targets, domains).select("request_id", F.col("domain_id").alias("domain"), F.col("material_reconfiguration").alias("outcome"), "quota")
    most = report.groupBy("domain", "outcome").agg(F.max("quota").alias("most"), F.collect_list(F.struct("request_id", "quota")).alias("q"))
    most = durable(most.where(F.col("most") > 0))
    few = rank_within(_likely(pool, most, seed), ["domain", "outcome"], ["state_id"], seed).join(most, ["domain", "outcome"]).where(F.col("rank") <= F.col("most"))
    out = few.select("state_id", "domain", "outcome", "rank", F.explode("q").alias("q")).where(F.col("rank") <= F.col("q.quota"))
    return out.select(F.col("q.request_id").alias("request_id"), "state_id", F.col("domain").alias("domain_id"), F.col("outcome").alias("material_reconfiguration"))


def _likely(pool: DataFrame, most: DataFrame, seed: int) -> DataFrame:
    """Rows of a category whose random key is small enough to be among its first ``most``, and hardly more,
    so that a small sample of a large category sorts few rows.

    Keys are those of the rank. They are cut into ranges; all ranges up to the one that completes
    ``most`` are kept, by exact counts, so no row of the sample is lost.
    """
    keyed = pool.withColumn("_p", key_range(["state_id"], seed))
    sizes = keyed.groupBy("domain", "outcome", "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = F.coalesce(F.sum("_n").over(Window.partitionBy("domain", "outcome").orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))  # PARTS rows a category at most
    last = sizes.withColumn("_before", before).join(most.select("domain", "outcome", "most"), ["domain", "outcome"]).where(F.col("_before") < F.col("most"))
    last = last.groupBy("domain", "outcome").agg(F.max("_p").alias("_last"))
    return keyed.join(last, ["domain", "outcome"]).where(F.col("_p") <= F.col("_last")).drop("_p", "_last")
