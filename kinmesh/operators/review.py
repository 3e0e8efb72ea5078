"""Review queue, its decisions and statistics. Decisions are appended; the state of an item is its latest one."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

PENDING, APPROVED, REJECTED = "PENDING", "APPROVED", "REJECTED"
LEAST_REASON = 5


GRAY = (0.45, 0.85)


def enqueue(decided: DataFrame, run_id: str | None = None) -> DataFrame:
    """One pending item per pair that is to be reviewed, with its ends, evidence and signals where decided has them.

    has_ai_explanation tells whether the score is in the gray zone; no text is made here.
    """
    have = set(decided.columns)
    held = lambda c: F.col(c) if c in have else F.lit(None).cast("string").alias(c)
    ai = F.coalesce(F.col("score").between(*GRAY), F.lit(False)).alias("has_ai_explanation")
    run = F.col("run_id") if "run_id" in have else F.lit(run_id).cast("string").alias("run_id")
    return decided.where("decision = 'REVIEW'").select(F.sha2("pair_id", 256).alias("review_id"), "pair_id", run, *map(held, ("a_key", "b_key", "evidence", "signals")), "score", F.lit(PENDING).alias("status"), ai)


def lookup(items: DataFrame, review_id: str | None = None, pair_id: str | None = None) -> DataFrame:
    """The item of a review id, or of a pair."""
    return items.where(F.col("review_id") == review_id if review_id is not None else F.col("pair_id") == pair_id)


def queue(items: DataFrame, status: str | None = None, run_id: str | None = None, by: str = "score", ascending: bool = False) -> DataFrame:
    """Items of a status and run, in order of score or created_at, ties by pair."""
    for column, value in (("status", status), ("run_id", run_id)):
        items = items if value is None else items.where(F.col(column) == value)
    return items.orderBy(F.col(by).asc() if ascending else F.col(by).desc(), "pair_id")


def valid_reason(reason: Column) -> Column:
    return F.coalesce(F.length(F.trim(reason)) >= LEAST_REASON, F.lit(False))


def latest(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The last row of each key; combined before the shuffle, so a key with many rows is no hot spot."""
    packed = rows.groupBy(key).agg(F.max_by(F.struct(*rows.columns), F.struct(*order)).alias("r"))
    return packed.select("r.*")


def apply(items: DataFrame, decisions: DataFrame) -> DataFrame:
    """Items with the first valid decision (pair_id, decision, reason, at; reviewer if there is one): a decided item is not pending."""
    valid = decisions.where(valid_reason(F.col("reason")) & F.col("decision").isin(APPROVED, REJECTED))
    who = F.col("reviewer") if "reviewer" in decisions.columns else F.lit(None).cast("string")
    first = valid.withColumn("__who", who).groupBy("pair_id").agg(F.min_by(F.struct("decision", "reason", "at", "__who"), F.struct("at", "decision")).alias("d"))
    both = items.join(first.select("pair_id", F.col("d.decision").alias("__new"), F.col("d.reason").alias("review_reason"), F.col("d.at").alias("reviewed_at"), F.col("d.__who").alias("reviewer")), "pair_id", "left")
    return both.withColumn("status", F.coalesce("__new", "status")).drop("__new")


def approved_links(items: DataFrame) -> DataFrame:
    """(x, y): what approved items link; clusters are made of these beside the automatic links."""
    return items.where(F.col("status") == APPROVED).select(F.col("a_key").alias("x"), F.col("b_key").alias("y"))


def events(items: DataFrame) -> DataFrame:
    """(pair_id, event_type, payload, actor) of the audit log: one for queueing an item, one for deciding it."""
    text = lambda *cols: F.to_json(F.struct(*cols))
    queued = items.select("pair_id", F.lit("DECISION_REVIEW").alias("event_type"), text("pair_id", "review_id", "score", "signals").alias("payload"), F.lit("SYSTEM").alias("actor"))
    kind = F.when(F.col("status") == APPROVED, "REVIEW_APPROVED").otherwise("REVIEW_REJECTED")
    decided = items.where(F.col("status") != PENDING).select("pair_id", kind.alias("event_type"), text("pair_id", F.col("review_reason").alias("reason"), "review_id", "reviewer").alias("payload"), F.coalesce("reviewer", F.lit("SYSTEM")).alias("actor"))
    return queued.unionByName(decided)


def stats(items: DataFrame) -> DataFrame:
    """One row: items by status and in all, mean seconds from created_at to reviewed_at, items with an explanation."""
    seconds = (F.unix_micros("reviewed_at") - F.unix_micros("created_at")) / 1e6
    return items.agg(
        *[F.count_if(F.col("status") == s).alias(s.lower()) for s in (PENDING, APPROVED, REJECTED)], F.count(F.lit(1)).alias("total"),
        F.round(F.coalesce(F.avg(seconds), F.lit(0.0)), 3).alias("avg_review_time_seconds"), F.count_if("has_ai_explanation").alias("with_ai_explanation"),
    )
