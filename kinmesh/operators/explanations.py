"""Kept explanations of pairs: read from JSON lines, appended to, and shown beside rule-made ones."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.config import ScoringConfig
from kinmesh.operators import referee, scoring

SCHEMA = (
    "explanation_id string, pair_id string, run_id string, explanation_text string, judgement string, model_name string, model_version string, created_at string, "
    "evidence_summary struct<score:double, signals_hit:array<string>, hard_conflicts:array<string>, field_comparisons:array<struct<field:string, type:string, similarity:double>>, automated:boolean>"
)
NEEDED = ["explanation_id", "pair_id", "run_id", "explanation_text", "evidence_summary", "model_name", "model_version", "created_at"]


#: Two SHA-256 keys in hex, as pairs of normalized records have.
_TWO_KEYS = "^[0-9a-f]{64}:[0-9a-f]{64}$"


def packed(pair_id: Column) -> Column:
    """A pair_id as bytes, half as long where it is two keys in hex; the first byte tells which, so no two ids get one form."""
    return F.when(pair_id.rlike(_TWO_KEYS), F.concat(F.lit(b"\x00"), F.unhex(F.replace(pair_id, F.lit(":"), F.lit(""))))).otherwise(F.concat(F.lit(b"\x01"), F.encode(pair_id, "utf-8")))


def unpacked(pair: Column) -> Column:
    key = lambda at: F.lower(F.hex(F.substring(pair, at, 32)))
    return F.when(F.substring(pair, 1, 1) == F.lit(b"\x00"), F.concat(key(2), F.lit(":"), key(34))).otherwise(F.decode(F.substring(pair, 2, 2**31 - 1), "utf-8"))


def read(spark: SparkSession, path: str) -> DataFrame:
    """The last line of each pair, with the pair_id packed() as `pair`; lines that are no explanation are passed over, a missing judgement is UNSURE.

    Each column is picked on its own, so that those nobody asks for are not shuffled; every one is of the same line, as `at` is unique.
    """
    lines = spark.read.text(path).select("value", F.struct(F.col("_metadata.file_modification_time").alias("t"), F.col("_metadata.file_block_start").alias("b"), F.monotonically_increasing_id().alias("n")).alias("at"))
    whole = lambda r: reduce(lambda x, y: x & y, [r[c].isNotNull() for c in NEEDED])
    rows = lines.select("at", F.inline(F.filter(F.array(F.from_json("value", SCHEMA)), whole)))
    names = [c for c in rows.columns if c not in ("at", "pair_id")]
    last = rows.withColumn("pair", packed(F.col("pair_id"))).groupBy("pair").agg(*[F.max_by(c, "at").alias(c) for c in names])
    return last.withColumns({"pair_id": unpacked(F.col("pair")), "judgement": F.coalesce("judgement", F.lit("UNSURE"))})


def append(explanations: DataFrame, path: str) -> None:
    """Adds explanations as JSON lines, compressed, one file for each task; of a pair that is there twice at once either line may count."""
    explanations.select([c.split()[0] for c in SCHEMA.split(", evidence_summary")[0].split(", ")] + ["evidence_summary"]).write.mode("append").option("compression", "gzip").json(path)


def made(decided: DataFrame, cfg: ScoringConfig, run_id: str = "") -> DataFrame:
    """Explanations by rule: the verdict where rules decide, else the template; decided as scoring.decisions()."""
    s, c = F.round("score", 9), F.col("hard_conflicts")
    ruled = referee.judgement(s, c, cfg)
    return decided.select(
        F.sha2("pair_id", 256).alias("explanation_id"), "pair_id", F.lit(run_id).alias("run_id"), F.coalesce(referee.explanation(s, c, cfg), referee.template(F.col("score"), scoring.evidence())).alias("explanation_text"), F.coalesce(ruled, F.lit("UNSURE")).alias("judgement"),
        F.lit("rules").alias("model_name"), F.lit("1").alias("model_version"), F.date_format(F.current_timestamp(), "yyyy-MM-dd'T'HH:mm:ss").alias("created_at"), _summary(ruled).alias("evidence_summary"),
    )


def _summary(ruled: Column) -> Column:
    compared = F.transform(scoring.evidence(), lambda e: F.struct(e["field"].alias("field"), e["type"].alias("type"), e["similarity"].cast("double").alias("similarity")))
    return F.struct(F.col("score").alias("score"), F.col("signals_hit").alias("signals_hit"), F.col("hard_conflicts").alias("hard_conflicts"), compared.alias("field_comparisons"), ruled.isNotNull().alias("automated"))


def view(decided: DataFrame, kept: DataFrame, cfg: ScoringConfig) -> DataFrame:
    """(pair_id, judgement, explanation, model): the kept explanation of each pair, else the one made by rule; nothing is written."""
    pair = F.col("pair") if "pair" in kept.columns else packed(F.col("pair_id"))
    own = kept.select(pair.alias("pair"), F.col("judgement").alias("__j"), F.col("explanation_text").alias("__t"), F.col("model_name").alias("__m"))
    both = made(decided, cfg).withColumn("pair", packed(F.col("pair_id"))).drop("pair_id").join(own, "pair", "left")
    return both.select(unpacked(F.col("pair")).alias("pair_id"), F.coalesce("__j", "judgement").alias("judgement"), F.coalesce("__t", "explanation_text").alias("explanation"), F.coalesce("__m", "model_name").alias("model"))
