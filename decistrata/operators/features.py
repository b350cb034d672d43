"""Decision states with their dataclass-like defaults, and their features as map, rows or columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schemas import CONTROLS, FEATURE_GROUPS, FEATURE_MAP, IDS


def _group(name: str) -> Column:
    return F.coalesce(F.col(name).cast(FEATURE_MAP), F.create_map().cast(FEATURE_MAP))


def decision_states(df: DataFrame, keep: Sequence[str] = ()) -> DataFrame:
    """Project onto the state's fields: ids as text, controls as double, a missing group as empty map.

    Other columns are dropped but for ``keep``. Null ids and controls stay null.
    """
    return df.select(*keep, *[F.col(c).cast("string").alias(c) for c in IDS], *[F.col(c).cast("double").alias(c) for c in CONTROLS], *[_group(g).alias(g) for g in FEATURE_GROUPS])


def structural_features() -> Column:
    """Map of full feature name to value: the controls, then each group's entries under ``group.name``.

    Ids are left out; nothing is cast, filled or scaled. Names can't collide: controls carry no dot
    and the groups' prefixes differ.
    """
    controls = F.create_map(*[x for c in CONTROLS for x in (F.lit(c), F.col(c).cast("double"))])

    def prefixed(group: str) -> Column:
        return F.transform_keys(_group(group), lambda k, v: F.concat(F.lit(f"{group}."), k))

    return F.map_concat(controls, *[prefixed(g) for g in FEATURE_GROUPS])


def flatten_map(df: DataFrame, to: str = "features") -> DataFrame:
    return df.withColumn(to, structural_features())


def flatten_long(df: DataFrame, ids: Sequence[str] = IDS, position: bool = True) -> DataFrame:
    """``ids, [pos,] feature_name, feature_value``: one row per feature, in the map's order."""
    if position:
        return df.select(*ids, F.posexplode(structural_features()).alias("pos", "feature_name", "feature_value"))
    return df.select(*ids, F.explode(structural_features()).alias("feature_name", "feature_value"))


def flatten_wide(df: DataFrame, features: Sequence[str], ids: Sequence[str] = IDS) -> DataFrame:
    """A column per listed full name (dot written ``__``). Values come straight from the groups, so no
    merged map is built and unused groups aren't read."""

    def value(name: str) -> Column:
        group, dot, key = name.partition(".")
        return (F.col(group)[key] if dot else F.col(name)).cast("double").alias(name.replace(".", "__"))

    return df.select(*ids, *[value(f) for f in features])
