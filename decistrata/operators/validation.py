"""Checks that no outcome of the optimizer is among the inputs of a decision."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from ..schemas import DECISION_STATE, FEATURE_GROUPS, FORBIDDEN_INPUT_FIELDS, ORACLE_LABEL


def field_names(schema: T.StructType | DataFrame = DECISION_STATE) -> frozenset[str]:
    """Names of the fields of a schema or DataFrame; no job runs."""
    return frozenset((schema.schema if isinstance(schema, DataFrame) else schema).fieldNames())


def has_post_solve_leakage(schema: T.StructType | DataFrame = DECISION_STATE) -> bool:
    """Whether a field has a forbidden name. Exact and case-sensitive; map keys aren't looked at."""
    return bool(field_names(schema) & FORBIDDEN_INPUT_FIELDS)


def leaking_key(groups: tuple[str, ...] = FEATURE_GROUPS) -> Column:
    """Whether a row's maps hold a forbidden name or one of an outcome as key (the strict check)."""
    names = F.array(*[F.lit(n) for n in sorted(FORBIDDEN_INPUT_FIELDS | set(ORACLE_LABEL.fieldNames()))])
    keys = [F.coalesce(F.map_keys(F.col(g)), F.array().cast("array<string>")) for g in groups]
    return F.arrays_overlap(F.concat(*keys), names)


def strict_leakage(df: DataFrame) -> DataFrame:
    """Rows whose feature maps leak, besides :func:`has_post_solve_leakage` for the columns."""
    return df.where(leaking_key())
