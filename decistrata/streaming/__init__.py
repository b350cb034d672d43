"""Operators over streams.

Decisions and flattening are row-wise: they keep no state and need no watermark. Upserts append each
micro-batch to a log of deltas; the state is the log, and late rows are rows like any other.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import DataStreamWriter

from ..operators import features, policy, widen
from ..operators.trigger import RiskTrigger
from ..schemas import IDS
from ..sources import temporary


def decisions(states: DataFrame, trigger: RiskTrigger) -> DataFrame:
    """The decision for each arriving state."""
    return policy.decide(states, trigger)


def flattened(states: DataFrame, ids: Sequence[str] = IDS) -> DataFrame:
    """The features of each arriving state, as rows."""
    return features.flatten_long(states, ids)


def upserts(rows: DataFrame, catalog: DataFrame, domains: DataFrame, log: str) -> DataStreamWriter:
    """A writer that turns each micro-batch of attribute rows into a sorted run of deltas below ``log``.

    A batch that is replayed after a failure writes to the same folder again and replaces its run, so
    rows count once. ``widen.compact(widen.read_runs(spark, f"{log}/*"))`` gives the entities so far.
    """

    def append(batch: DataFrame, number: int) -> None:
        with temporary(batch.sparkSession):  # a stream that never ends leaves no tables behind
            run = widen.deltas(batch, catalog, domains, F.lit(number))
            widen.write_run(run, f"{log}/{number:012d}", replace=True)

    return rows.writeStream.foreachBatch(append)
