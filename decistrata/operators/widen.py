"""Attribute-value rows into one typed row per entity: log-structured upserts.

A batch of rows becomes sparse wide deltas, one per entity and batch, whose cells carry the
version and value of their latest readable row and what is needed to see contradictions.
Compaction merges an entity's deltas cell by cell, the latest version winning. Deltas merge
associatively, so those of an earlier run can be compacted with new ones (``compact`` of a union). Of
values with the same version the greatest is the latest. Values of ``long`` features are kept as whole
numbers beside the double, exact over the range of bigint.

One shuffle by entity serves both deltas and compaction. Only the rows of hot entities, if there are
any, are pre-aggregated per (entity, batch, attribute) before it, so they arrive as a few rows.
"""

from __future__ import annotations

from collections.abc import Iterable
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.ids import name_key, with_domain
from ..functions.values import read_typed
from ..schemas import FEATURE_GROUPS
from ..sources import bounded, durable

GROUPS = FEATURE_GROUPS
#: Rows of one entity that a task may get. A third of all rows may have one entity.
HOT = 100_000
#: Hot entities that may be broadcast; each has more than HOT rows, so 2 billion rows come first.
HOT_LIST = 20_000
FIELDS = ("version", "value", "least", "most", "readable", "whole", "whole_least", "whole_most")
CELL = "struct<version timestamp, value double, least double, most double, readable bigint, whole bigint, whole_least bigint, whole_most bigint>"


def feature_key(name: Column) -> Column:
    """What a feature is shuffled and stored by: a number that doesn't change with the catalog."""
    return F.xxhash64(name)


def _catalog(catalog: DataFrame, domains: DataFrame) -> DataFrame:
    full = F.concat_ws(".", "feature_group", "feature_name")
    short = F.concat_ws(".", F.regexp_replace("feature_group", "_features$", ""), "feature_name")
    c = with_domain(catalog.select("domain_id", "feature_group", "feature_name", "value_type", "unit"), domains).where(F.col("domain").isNotNull())
    c = c.select("domain", F.explode(F.array(name_key(full), name_key(short))).alias("attr_key"), full.alias("name"), "value_type", "unit")
    c = c.groupBy("domain", "attr_key").agg(*[F.min(x).alias(x) for x in ("name", "value_type", "unit")])
    return c.withColumn("feature", feature_key(F.col("name"))).drop("name")


def read_rows(rows: DataFrame, catalog: DataFrame, domains: DataFrame, batch: Column | None = None) -> DataFrame:
    """``entity_id, batch, feature, domain, version, value, whole`` of each row, numbers all. Rows of attributes
    that belong to no feature of the entity's domain have a null feature, so their entity isn't lost;
    rows without ``entity_id`` name no entity and are left out. ``batch`` defaults to the day of ``loaded_at``."""
    batch = F.to_date("loaded_at") if batch is None else batch
    r = rows.where(F.col("entity_id").isNotNull()).select("entity_id", "domain_id", "attr_name", "raw_value", F.col("loaded_at").cast("timestamp").alias("version"), batch.alias("batch"))
    r = with_domain(r, domains).select("entity_id", "domain", name_key(F.col("attr_name")).alias("attr_key"), "raw_value", "version", "batch")
    r = r.join(bounded(_catalog(catalog, domains)), ["domain", "attr_key"], "left")
    r = r.withColumn("cell", F.when(F.col("feature").isNotNull(), read_typed(F.col("raw_value"), F.col("value_type"), F.col("unit"))))
    r = r.select("entity_id", "batch", "feature", "domain", "version", "cell.value", "cell.whole")
    number = F.when(F.col("domain").isNotNull(), F.xxhash64("domain"))
    return r.select("entity_id", "batch", "feature", number.alias("domain"), F.when(F.col("value").isNotNull(), F.col("version")).alias("version"), "value", "whole")


def _cells(read: DataFrame) -> DataFrame:
    """One row per entity, batch and feature."""
    return read.groupBy("entity_id", "batch", "feature").agg(F.max("domain").alias("domain"), *_merged("value", "value", "whole", "whole", F.count("value")))


def _merged(least: str, most: str, whole_least: str, whole_most: str, readable: Column) -> list[Column]:
    """Aggregates of a cell, numbers all, so they are hashed and not sorted. A value without version is
    older than any with one. A value's place among those of its version is its logarithm, by sign."""
    version, value = F.col("version"), F.col("value")
    place = (500 + F.signum(value) * F.log1p(F.abs(value)) / 2).cast("decimal(18,15)")
    order = F.when(value.isNotNull(), F.coalesce(F.unix_micros(version), F.lit(-(1 << 60))).cast("decimal(19,0)") * F.lit(1000).cast("decimal(4,0)") + place)
    ends = [F.min(least).alias("least"), F.max(most).alias("most"), F.min(whole_least).alias("whole_least"), F.max(whole_most).alias("whole_most")]
    return [F.max(version).alias("version"), F.max_by(value, order).alias("value"), F.max_by("whole", order).alias("whole"), *ends, readable.alias("readable")]


def _as_map() -> Column:
    own = F.when(F.col("feature").isNotNull(), F.struct(F.col("feature"), F.struct(*FIELDS).cast(CELL)))
    return F.map_from_entries(F.collect_list(own)).alias("cells")  # at most one entry for each catalog feature


def deltas(rows: DataFrame, catalog: DataFrame, domains: DataFrame, batch: Column | None = None, hot: int = HOT) -> DataFrame:
    """Sparse wide deltas ``entity_id, batch, domain, cells`` (map of feature key to versioned cell).

    Rows go to their entity's task in one shuffle, which serves compaction too. Entities of more than
    ``hot`` rows, found by a count over the id alone, are first aggregated where they are, so that a
    task never gets more than ``hot`` rows of one entity. The result doesn't depend on ``hot``.
    """

    def wide_deltas(cells: DataFrame) -> DataFrame:
        return cells.groupBy("entity_id", "batch").agg(F.max("domain").alias("domain"), _as_map())

    def gathered(part: DataFrame) -> DataFrame:
        return wide_deltas(_cells(read_rows(part, catalog, domains, batch).repartition("entity_id")))

    def aggregated_first(part: DataFrame) -> DataFrame:
        return wide_deltas(_cells(read_rows(part, catalog, domains, batch)).repartition("entity_id"))

    many = durable(rows.where(F.col("entity_id").isNotNull()).groupBy("entity_id").agg(F.count(F.lit(1)).alias("n")).where(F.col("n") > hot).select("entity_id"))
    found = many.limit(HOT_LIST + 1).count()
    if not found:
        return gathered(rows)
    if found > HOT_LIST:  # too many to be sent to every task
        return aggregated_first(rows)
    cold, warm = (rows.join(F.broadcast(many), "entity_id", how) for how in ("left_anti", "left_semi"))
    return gathered(cold).unionByName(aggregated_first(warm))


def compact_cells(parts: DataFrame) -> DataFrame:
    """Deltas merged cell by cell: ``entity_id, feature, domain`` and the fields of a cell. Whole deltas go
    to their entity's task, one per batch at most, and are taken apart there."""
    long = parts.select("entity_id", "domain", "cells").repartition("entity_id").select("entity_id", "domain", F.explode_outer("cells").alias("feature", "cell")).select("entity_id", "domain", "feature", "cell.*")
    return long.groupBy("entity_id", "feature").agg(F.max("domain").alias("domain"), *_merged("least", "most", "whole_least", "whole_most", F.sum("readable")))


def compact(parts: DataFrame) -> DataFrame:
    """One row per entity: ``entity_id, domain, cells``. Takes deltas or earlier results."""
    return compact_cells(parts).groupBy("entity_id").agg(F.max("domain").alias("domain"), _as_map())


def _clear(cell) -> Column:
    """Whether all readable rows of the cell give one value: whole numbers exactly, others up to rounding
    of notations. ``cell`` gives a field's column by its name."""
    near = cell("most") - cell("least") <= F.lit(1e-9) * F.greatest(F.lit(1.0), F.abs(cell("most")))
    return (cell("readable") > 0) & F.coalesce(cell("whole_least") == cell("whole_most"), near)


def unclear_cells(parts: DataFrame, names: Iterable[str]) -> DataFrame:
    """``entity_id, feature_name, outcome`` of cells that have rows but not one clear value:
    ``no_value`` if no row can be read as the feature's type, ``conflict`` if readable rows differ.
    ``names`` are the full names of the catalog's features, a list that the driver holds."""
    c = compact_cells(parts).where(F.col("feature").isNotNull() & ~_clear(F.col))
    known = parts.sparkSession.createDataFrame([(n,) for n in names], "feature_name string").withColumn("feature", feature_key(F.col("feature_name")))
    return c.join(F.broadcast(known), "feature").select("entity_id", "feature_name", F.when(F.col("readable") == 0, "no_value").otherwise("conflict").alias("outcome"))


def feature_types(catalog: DataFrame) -> dict[str, str]:
    """Full feature name to Spark type, in name order. The catalog decides the columns, so it is
    read here; where domains differ in a feature's type, double wins over long over boolean."""
    order = {"boolean": 0, "long": 1, "double": 2}
    rows = catalog.where(F.col("feature_group").isin(*GROUPS)).select("feature_group", "feature_name", "value_type").distinct().collect()
    types: dict[str, str] = {}
    for g, n, t in rows:
        name = f"{g}.{n}"
        types[name] = max(types.get(name, "boolean"), t if t in order else "double", key=order.__getitem__)
    return {k: "bigint" if types[k] == "long" else types[k] for k in sorted(types)}


def wide(compacted: DataFrame, types: dict[str, str], domains: DataFrame, on_conflict: str = "empty") -> DataFrame:
    """One row per entity, a column ``<group>__<name>`` per feature, typed.

    A cell without a clear value is null; with ``on_conflict="latest"`` the latest version wins.
    """

    def column(name: str, kind: str) -> Column:
        cell = F.col("cells")[feature_key(F.lit(name))]
        clear = cell["readable"] > 0 if on_conflict == "latest" else _clear(cell.getField)
        value = F.when(clear, F.coalesce(cell["whole"], cell["value"].cast("bigint")) if kind == "bigint" else cell["value"])
        return (value != 0 if kind == "boolean" else value).alias(name.replace(".", "__"))

    named = domains.select(F.xxhash64("domain_id").alias("domain"), "domain_id").distinct()
    return compacted.join(named, "domain", "left").select("entity_id", "domain_id", *[column(n, t) for n, t in types.items()])


def write_run(parts: DataFrame, folder: str, replace: bool = False) -> None:
    """Write deltas as a sorted run: a file holds whole entities, by entity and batch. A run is added to
    what the folder holds, or takes its place."""
    parts.select("entity_id", "batch", "domain", "cells").repartition("entity_id").sortWithinPartitions("entity_id", "batch").write.mode("overwrite" if replace else "append").parquet(folder)


def read_runs(spark: SparkSession, *folders: str) -> DataFrame:
    return spark.read.parquet(*folders)


def merge_deltas(*parts: DataFrame) -> DataFrame:
    """Compaction of several runs, such as yesterday's result and today's deltas."""
    return compact(reduce(DataFrame.unionByName, [p.select("entity_id", "domain", "cells") for p in parts]))
