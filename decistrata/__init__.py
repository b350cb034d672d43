"""Decision-state screening and data processing as Spark DataFrame plans."""

from .operators.features import decision_states, flatten_long, flatten_map, flatten_wide
from .operators.metrics import balanced_accuracy, decision_loss, evaluate, exact_solve_reduction_rate, false_negative_rate, pair_strictly
from .operators.oracle import ExactOracle, OracleProvenance, oracle_labels
from .operators.policy import compare, decide, solve_picked
from .operators.trigger import AnyTrigger, RiskTrigger, ThresholdTrigger
from .operators.validation import field_names, has_post_solve_leakage, leaking_key

__version__ = "0.2.0"
__all__ = [
    "AnyTrigger", "ExactOracle", "OracleProvenance", "RiskTrigger", "ThresholdTrigger", "balanced_accuracy", "compare", "decide", "decision_loss", "decision_states",
    "evaluate", "exact_solve_reduction_rate", "false_negative_rate", "field_names", "flatten_long", "flatten_map", "flatten_wide", "has_post_solve_leakage", "leaking_key",
    "oracle_labels", "pair_strictly", "solve_picked",
]
