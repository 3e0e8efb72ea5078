"""A resolution run: normalize, block, compare, decide, cluster. Each stage is a frame; a run's tables can be kept."""

from __future__ import annotations

from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.config import BlockingConfig, ScoringConfig
from kinmesh.operators import blocking, components, scoring
from kinmesh.operators.normalize import normalize
from kinmesh.sources.staging import records_from_customer
from kinmesh.storage import Scratch, table


def planned_mode(new: Column, total: Column, delta_share: float = 0.2) -> Column:
    """config.plan_mode() over columns."""
    return F.when((total > 0) & (new / total < delta_share), "DELTA").otherwise("FULL")


@dataclass
class Run:
    """One run over raw records. keep: stages that several readers use are written to the shared folder once."""

    raw: DataFrame
    blocking: BlockingConfig
    scoring: ScoringConfig
    keep: bool = True

    def _kept(self, df: DataFrame, name: str) -> DataFrame:
        return Scratch(self.raw.sparkSession, f"run-{name}").put(df) if self.keep else df

    @cached_property
    def norm(self) -> DataFrame:
        return self._kept(normalize(self.raw), "norm")

    @cached_property
    def keys(self) -> DataFrame:
        return self._kept(blocking.blocking_keys(self.norm, self.blocking), "keys")

    @cached_property
    def pairs(self) -> DataFrame:
        return self._kept(blocking.candidate_pairs(self.keys, self.norm, self.blocking), "pairs")

    @cached_property
    def decided(self) -> DataFrame:
        return self._kept(scoring.decisions(self.pairs, self.norm, self.scoring), "decided")

    @cached_property
    def blocks(self) -> DataFrame:
        return self._kept(blocking.in_blocks(self.norm, self.blocking, scoring.NEEDED), "blocks")

    def streamed(self, cfg: ScoringConfig | None = None) -> DataFrame:
        """The rows of decided, made anew from the blocks for each reader and never written; blocking's reasons are left out."""
        return scoring.decided(blocking.meetings(self.blocks, scoring.NEEDED), cfg or self.scoring)

    @cached_property
    def links(self) -> DataFrame:
        return self.decided.where("decision = 'AUTO_LINK'").select(F.col("a_key").alias("x"), F.col("b_key").alias("y"))

    @cached_property
    def members(self) -> DataFrame:
        return self._kept(components.clusters(self.norm, self.links), "members")

    @cached_property
    def golden(self) -> DataFrame:
        return self._kept(components.golden(self.members, self.norm), "golden")


_RUNS: dict[tuple, Run] = {}


def _state(spark: SparkSession, path: str) -> tuple:
    """Length and time of a table's files, which change with its content."""
    p = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    status = p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getFileStatus(p)
    return status.getLen(), status.getModificationTime()


def customer_run(spark: SparkSession, d: str) -> Run:
    """The run over records derived from the customer table; its tables are kept for the session, as long as that is the same."""
    key = (spark.sparkContext.applicationId, d, _state(spark, f"{d}/customer.parquet"))
    if key not in _RUNS:
        _RUNS[key] = Run(records_from_customer(table(spark, d, "customer")), BlockingConfig(), ScoringConfig())
    return _RUNS[key]
