"""Exact ranks within groups of any size, without one task per group."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Parts of the key space of a group. A part holds about 1/PARTS of a group, whatever its size.
PARTS = 4096


def key_range(ident: list[str], seed: int) -> Column:
    """Number of the range, 0 to PARTS - 1 in the order of ranks, that a row's random key lies in."""
    return (F.shiftright(F.xxhash64(*ident, F.lit(seed)), 52) + PARTS // 2).cast("int")


def rank_within(df: DataFrame, keys: list[str], ident: list[str], seed: int = 17, to: str = "rank") -> DataFrame:
    """Add the 1-based rank of each row by a random but repeatable key within its group.

    The key is a 64-bit hash of ``ident`` and ``seed``; ties go by ``ident``. Its leading bits cut
    each group into PARTS ranges; a row's rank is the size of the earlier ranges plus its place in
    its own range, so the sort works on (group, range) and a hot group is spread over all tasks.
    ``keys`` may hold nulls (null is a group); ``ident`` should be unique in a group.
    """
    tagged = df.withColumn("_h", F.xxhash64(*ident, F.lit(seed))).withColumn("_p", key_range(ident, seed))
    sizes = tagged.groupBy(*keys, "_p").agg(F.count(F.lit(1)).alias("_n"))
    before = Window.partitionBy(*keys).orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)  # PARTS rows a group at most
    offsets = sizes.withColumn("_before", F.coalesce(F.sum("_n").over(before), F.lit(0))).drop("_n")
    own = Window.partitionBy(*keys, "_p").orderBy("_h", *ident)
    placed = tagged.withColumn("_rn", F.row_number().over(own))
    o = offsets.select(*[F.col(k).alias(f"_o_{k}") for k in keys], F.col("_p").alias("_o_p"), "_before")
    cond = F.col("_p") == F.col("_o_p")
    for k in keys:
        cond = cond & F.col(k).eqNullSafe(F.col(f"_o_{k}"))
    return placed.join(o, cond).withColumn(to, F.col("_before") + F.col("_rn")).drop("_h", "_p", "_rn", "_before", "_o_p", *[f"_o_{k}" for k in keys])
