"""All core queries with their SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from kinmesh.plans import queries_read, queries_run, timeline
from kinmesh.plans.pipeline import customer_run
from kinmesh.plans.registry import ORACLES, QUERIES

_LOADED = (queries_run, queries_read)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return QUERIES | timeline.QUERIES


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)


def flagship(spark: SparkSession, d: str) -> DataFrame:
    """The whole pipeline; pairs and mean score per decision."""
    from pyspark.sql import functions as F

    return customer_run(spark, d).decided.groupBy("decision").agg(F.count(F.lit(1)).alias("pairs"), F.round(F.avg("score"), 6).alias("mean_score"))
