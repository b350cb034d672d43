"""The external exact optimizer: its pinned identity and an interface. No solve is done here."""

from __future__ import annotations

from abc import ABC, abstractmethod
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schemas import ORACLE_LABEL, PROVENANCE

#: The pinned revision of the oracle. Fixed value.
PINNED_COMMIT = "51aebd06edf8f5d6d124d0f3eebdbb901e63274f"


@dataclass(frozen=True)
class OracleProvenance:
    """Which oracle gave a label. The repository is the caller's to give. The other defaults are fixed values."""

    repository: str | None = None
    commit_sha: str = PINNED_COMMIT
    model_name: str | None = "robust inventory reconfiguration model"
    algorithm_name: str | None = "PRB-Benders"
    frozen: bool = True

    def to_df(self, spark: SparkSession) -> DataFrame:
        return spark.createDataFrame([tuple(asdict(self).values())], PROVENANCE)


def oracle_labels(df: DataFrame, keep: tuple[str, ...] = ()) -> DataFrame:
    """Project onto a label's fields, typed; other columns are dropped but for ``keep``."""
    return df.select(*keep, *[F.col(f.name).cast(f.dataType).alias(f.name) for f in ORACLE_LABEL.fields])


class ExactOracle(ABC):
    """What a caller plugs in to solve states that a trigger picked."""

    @abstractmethod
    def solve(self, states: DataFrame) -> DataFrame:
        """States with label columns."""


class NoOracle(ExactOracle):
    def solve(self, states: DataFrame) -> DataFrame:
        raise NotImplementedError("no oracle is configured; plug in an ExactOracle")
