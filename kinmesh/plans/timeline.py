"""Queries of problem 1: dates and times of the staging rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.operators.timestamps import normalise
from kinmesh.storage import table


def resolved(spark: SparkSession, d: str, keep_open: bool = False) -> DataFrame:
    branches = table(spark, d, "branches").select(F.col("branch").alias("source"), "tz", "date_order")
    return normalise(table(spark, d, "challenging_er_200"), "ingest_seq", "BRANCH", {"CUSDOB": True, "TIMSTAMP": False}, branches, keep_open)


def p1_found(spark: SparkSession, d: str) -> DataFrame:
    """Values of CUSDOB and TIMSTAMP that denote a date or instant and aren't already written in normal form."""
    return resolved(spark, d).where(F.col("raw") != F.col("norm_value")).select(F.col("seq").alias("ingest_seq"), "field_name", "norm_value")


def p1_resolved(spark: SparkSession, d: str) -> DataFrame:
    """Every readable value, two-way dates of rows without a source included, which the Viterbi pass decides."""
    return resolved(spark, d, keep_open=True).select(F.col("seq").alias("ingest_seq"), "field_name", "raw", "norm_value")


QUERIES = {"p1_found": p1_found, "p1_resolved": p1_resolved}
