"""Column-level data quality profile, per load, and the loads that differ from the rest.

The columns are unpivoted into value counts per (load, column, value), exact and pre-aggregated
before the shuffle, so one value that holds a third of all rows arrives as one row per task. All
figures come from the counts: frequencies, distincts, ranges, ill-formed values, and the
population stability index and chi-square of each load against all other loads.

Nulls count as nulls; NaN and infinities count as ill-formed and not as numbers; an empty text is a
value. A row without load belongs to the load null, which is profiled like any other. An empty
table gives an empty profile.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..sources import durable


@dataclass(frozen=True)
class Limits:
    """What counts as standing out. All are shares or indices, none depends on the table's size."""

    null_margin: float = 0.08  #: share of nulls beyond that of the median load
    form_margin: float = 0.08  #: the same for values not in a usual form
    sigmas: float = 4.0  #: and beyond this many standard errors of a share in a load of its size
    outside: float = 0.03  #: share of numbers clearly outside the limits that nearly all loads keep
    psi: float = 0.2  #: population stability index, beyond what chance gives at this load's size
    slack: float = 0.25  #: further off than this part of the range is clearly outside; such extremes don't widen the limits
    keep: float = 0.9  #: part of the other loads whose extremes lie within the limits
    least_psi: float = 0.1  #: a smaller index stands out too, from this one on,
    times: float = 5.0  #: if it is so many times that of the column's median load
    usual: float = 0.005  #: share of a load's texts that a usual form has in more than half of the loads
    bins: int = 20


def value_counts(df: DataFrame, load: str, numeric: list[str], text: list[str]) -> DataFrame:
    """``load_id, column_name, number, text, n``: how often each value of each column occurs in a load."""
    parts = [F.struct(F.lit(c).alias("column_name"), F.col(f"`{c}`").cast("double").alias("number"), F.lit(None).cast("string").alias("text")) for c in numeric]
    parts += [F.struct(F.lit(c).alias("column_name"), F.lit(None).cast("double").alias("number"), F.col(f"`{c}`").cast("string").alias("text")) for c in text]
    long = df.select(F.col(f"`{load}`").alias("load_id"), F.explode(F.array(*parts)).alias("c")).select("load_id", "c.*")
    return long.groupBy("load_id", "column_name", "number", "text").agg(F.count(F.lit(1)).alias("n"))


def _same(a: str, b: str) -> Column:
    return F.col(a).eqNullSafe(F.col(b))


def profile(counts: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """One row per load and column from value counts (written once; they are read several times).

    ``rows, nulls, null_rate, distinct, least, most`` (numbers), ``ill_formed``: numbers that are NaN
    or infinite, texts not in a usual form; ``low, high``: the limits that nearly all loads keep
    (the extremes of all but a tenth of the loads); ``outside``: numbers beyond them, ``far_outside``: clearly beyond; ``psi, chi_square``: spread of values in range and usual form
    against that in the other loads, over equal bins of the range, or the texts themselves.
    """
    counts = durable(counts)
    number, text = F.col("number"), F.col("text")
    finite = number.isNotNull() & ~F.isnan("number") & (F.abs(number) < float("inf"))

    # usual forms: those that have their share in more than half of the loads
    texts = counts.where(text.isNotNull())
    sizes = texts.groupBy("column_name", F.col("load_id").alias("_l")).agg(F.sum("n").alias("size"))
    loads = sizes.groupBy("column_name").agg(F.count(F.lit(1)).alias("loads"))
    t = texts.withColumnRenamed("column_name", "_c").join(sizes, (F.col("_c") == F.col("column_name")) & _same("load_id", "_l")).where(F.col("n") >= limits.usual * F.col("size"))
    usual = t.groupBy("column_name", "text").agg(F.count(F.lit(1)).alias("in_loads")).join(loads, "column_name")
    usual = usual.where(2 * F.col("in_loads") > F.col("loads")).select("column_name", "text", F.lit(True).alias("usual"))

    # limits: the extremes of the loads, without those far off the median load's
    good = counts.where(finite)
    ends = good.groupBy("column_name", "load_id").agg(F.min("number").alias("lo"), F.max("number").alias("hi"))
    mid = ends.groupBy("column_name").agg(F.median("lo").alias("mlo"), F.median("hi").alias("mhi"))
    reach = limits.slack * (F.col("mhi") - F.col("mlo"))
    kept = ends.join(mid, "column_name").groupBy("column_name").agg(
        F.percentile(F.when(F.col("lo") >= F.col("mlo") - reach, F.col("lo")), 1 - limits.keep).alias("low"), F.percentile(F.when(F.col("hi") <= F.col("mhi") + reach, F.col("hi")), limits.keep).alias("high")
    )

    # usual forms, at most 2 / limits.usual a column, and limits, one row a column, go to the counts; texts
    # and numbers apart, so that no key stands for all numbers
    kept = F.broadcast(kept)
    unknown = F.lit(None).cast("boolean").alias("usual")
    c = counts.where(text.isNull()).select("*", unknown).unionByName(texts.join(F.broadcast(usual), ["column_name", "text"], "left")).join(kept, "column_name", "left")
    width = F.col("high") - F.col("low")
    far_off = finite & ((number < F.col("low") - limits.slack * width) | (number > F.col("high") + limits.slack * width))
    inside = finite & number.between(F.col("low"), F.col("high"))
    bin_no = F.least(F.floor((number - F.col("low")) / F.greatest(width, F.lit(1e-300)) * limits.bins), F.lit(limits.bins - 1)).cast("string")
    c = c.withColumn("inside", inside).withColumn("cell", F.when(inside, bin_no).when(F.col("usual"), text))
    n = F.col("n")
    summary = c.groupBy("load_id", "column_name").agg(
        F.sum("n").alias("rows"),
        F.sum(F.when(number.isNull() & text.isNull(), n).otherwise(0)).alias("nulls"),
        F.count(F.when(number.isNotNull() | text.isNotNull(), 1)).alias("distinct"),
        F.min(F.when(finite, number)).alias("least"),
        F.max(F.when(finite, number)).alias("most"),
        F.sum(F.when((number.isNotNull() & ~finite) | (text.isNotNull() & F.col("usual").isNull()), n).otherwise(0)).alias("ill_formed"),
        F.max("low").alias("low"),
        F.max("high").alias("high"),
        F.sum(F.when(finite & ~F.col("inside"), n).otherwise(0)).alias("outside"),
        F.sum(F.when(far_off, n).otherwise(0)).alias("far_outside"),
    )
    cells = c.where(F.col("cell").isNotNull()).groupBy("load_id", "column_name", "cell").agg(F.sum("n").alias("own"))
    every = cells.groupBy("column_name", "cell").agg(F.sum("own").alias("all"))
    own_n = cells.groupBy("load_id", "column_name").agg(F.sum("own").alias("own_n"))
    all_n = every.groupBy("column_name").agg(F.sum("all").alias("all_n"), F.count(F.lit(1)).alias("cells"))
    grid = own_n.join(all_n, "column_name").join(every, "column_name")  # loads x cells of a column, both few
    own = cells.select(F.col("load_id").alias("_l"), F.col("column_name").alias("_c"), F.col("cell").alias("_k"), "own")
    grid = grid.join(own, _same("load_id", "_l") & (F.col("column_name") == F.col("_c")) & (F.col("cell") == F.col("_k")), "left").drop("_l", "_c", "_k").fillna(0, ["own"])
    rest_n = F.col("all_n") - F.col("own_n")
    p = (F.col("own") + 0.5) / (F.col("own_n") + 0.5 * F.col("cells"))
    q = (F.col("all") - F.col("own") + 0.5) / (rest_n + 0.5 * F.col("cells"))
    expected = q * F.col("own_n")
    spread = grid.groupBy("load_id", "column_name").agg(
        F.when(F.max(rest_n) > 0, F.sum((p - q) * F.log(p / q))).alias("psi"),
        F.when(F.max(rest_n) > 0, F.sum((F.col("own") - expected) ** 2 / expected)).alias("chi_square"),
        F.max("cells").alias("cells"),
        F.max("own_n").alias("comparable"),
    )
    s2 = spread.select(F.col("load_id").alias("_l"), F.col("column_name").alias("_c"), "psi", "chi_square", "cells", "comparable")
    out = summary.join(s2, _same("load_id", "_l") & _same("column_name", "_c"), "left").drop("_l", "_c")
    return out.withColumn("null_rate", F.col("nulls") / F.col("rows"))


def issues(profiled: DataFrame, limits: Limits = Limits()) -> DataFrame:
    """``load_id, column_name, issue`` for columns that in one load stand out from its other loads."""
    given = F.col("rows") - F.col("nulls")
    textual = F.col("low").isNull()
    p = profiled.withColumn("given", given).withColumn("form_rate", F.when(textual & (given > 0), F.col("ill_formed") / given)).withColumn("out_rate", F.when(given > 0, F.col("far_outside") / given)).withColumn("edge_rate", F.when(given > 0, F.col("outside") / given))
    mid = p.groupBy("column_name").agg(F.median("null_rate").alias("mid_null"), F.median("form_rate").alias("mid_form"), F.median("out_rate").alias("mid_out"), F.median("edge_rate").alias("mid_edge"), F.median("psi").alias("mid_psi"), F.count(F.lit(1)).alias("loads"))
    p = p.join(mid, "column_name")

    def far(rate: str, middle: str, size: Column, margin: float) -> Column:
        m = F.col(middle)
        error = F.sqrt(F.greatest((m + 1 / (size + 1)) * (1 - m), F.lit(0.0)) / F.greatest(size, F.lit(1)))
        return F.coalesce(F.abs(F.col(rate) - m) > margin + limits.sigmas * error, F.lit(False))

    chance = limits.sigmas * (F.col("cells") - 1) / F.greatest(F.col("comparable"), F.lit(1))
    spread = (F.col("psi") > limits.psi + chance) | ((F.col("psi") > limits.least_psi + chance) & (F.col("psi") > limits.times * F.col("mid_psi")))
    spread = F.coalesce(spread, F.lit(False))
    # numbers just beyond the limits are a matter of range only where the rest is spread as ever
    beyond = far("out_rate", "mid_out", given, limits.outside) | (far("edge_rate", "mid_edge", given, limits.outside) & ~spread)
    found = F.array_compact(
        F.array(
            F.when(far("null_rate", "mid_null", F.col("rows"), limits.null_margin), F.lit("null_rate")),
            F.when(far("form_rate", "mid_form", given, limits.form_margin), F.lit("written_form")),
            F.when(beyond, F.lit("range")),
            F.when(spread, F.lit("distribution")),
        )
    )
    return p.where(F.col("loads") > 1).select("load_id", "column_name", F.explode(found).alias("issue"))


def drift(profiled: DataFrame) -> DataFrame:
    """Each figure next to that of the load before: ``null_rate``, ``distinct``, ``least``, ``most``, ``psi``."""
    w = Window.partitionBy("column_name").orderBy("load_id")  # as many rows as loads
    return profiled.select("load_id", "column_name", *[c for k in ("null_rate", "distinct", "least", "most", "psi") for c in (F.col(k), F.lag(k).over(w).alias(f"{k}_before"))])
