"""Schemas of decision states, oracle outcomes, provenance and flattened features."""

from __future__ import annotations

from pyspark.sql import types as T

FEATURE_GROUPS = ("demand_features", "inventory_features", "network_features", "cost_features")
CONTROLS = ("beta", "Gamma", "lambda_R")
IDS = ("domain_id", "network_id", "time_id")

FEATURE_MAP = T.MapType(T.StringType(), T.DoubleType(), True)

#: What is known before deciding whether to call the oracle.
DECISION_STATE = T.StructType(
    [T.StructField(c, T.StringType(), False) for c in IDS]
    + [T.StructField(c, T.DoubleType(), False) for c in CONTROLS]
    + [T.StructField(c, FEATURE_MAP, False) for c in FEATURE_GROUPS]
)

#: Outcomes of the optimizer, never inputs of a decision.
ORACLE_LABEL = T.StructType(
    [
        T.StructField("material_reconfiguration", T.BooleanType(), False),
        T.StructField("optimization_value", T.DoubleType(), False),
        T.StructField("oracle_status", T.StringType(), False),
    ]
)

#: Pinned identity of the external oracle.
PROVENANCE = T.StructType([T.StructField(c, T.StringType(), True) for c in ("repository", "commit_sha", "model_name", "algorithm_name")] + [T.StructField("frozen", T.BooleanType(), False)])

#: Names that no input of a decision may have. Fixed values.
FORBIDDEN_INPUT_FIELDS = frozenset({"objective", "RI", "runtime", "iterations"})
