"""Tamper-evident event log: a chain of SHA-256 hashes per log, and its verification.

Hashed is prev|type|payload|time, the payload as JSON with sorted keys, the time in ISO form with microseconds.

Building a chain is sequential by nature, so a log is the unit of parallelism: logs are sorted within partitions and read
once as a stream of Arrow batches, so that no log is held in memory. Verifying isn't: every event names the hash before it,
so events are range-partitioned by log and place, however long one log is; each partition is read once, and the first event
of a partition is compared with the last of the one before it (two rows a partition are joined). Events without a log are
left out; null parts are left out of the hashed text; payloads that are no JSON are hashed as they are written.
"""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import sha256

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_type

GENESIS = "0" * 64


# The kinds of events a log may hold.
EVENT_TYPES = [
    "RUN_STARTED", "RUN_COMPLETED", "RUN_FAILED", "DECISION_AUTO_LINK", "DECISION_REVIEW", "DECISION_REJECT", "REVIEW_APPROVED", "REVIEW_REJECTED", "CLUSTER_CREATED", "CLUSTER_MERGED",
    "POLICY_CREATED", "POLICY_APPROVED", "REFEREE_EXPLANATION", "PLANNER_DECISION", "SYSTEM_GENESIS",
]


def known_type(kind: Column) -> Column:
    return kind.isin(*EVENT_TYPES)


def iso(at: Column) -> Column:
    """A timestamp in ISO form, microseconds only where there are any."""
    return F.regexp_replace(F.date_format(at, "yyyy-MM-dd'T'HH:mm:ss.SSSSSS"), r"\.000000$", "")


def canonical(payload: str | None) -> str | None:
    """JSON with sorted keys; what is no JSON stays."""
    try:
        return None if payload is None else json.dumps(json.loads(payload), sort_keys=True)
    except ValueError:
        return payload


def event_hash(prev: Column, kind: Column, payload: Column, at: Column) -> Column:
    """Hash of an event whose payload is in canonical form."""
    return F.sha2(F.concat_ws("|", prev, kind, payload, at), 256)


def database_hash(prev: Column, kind: Column, payload: Column, at: Column) -> Column:
    """The hash that the database function makes: the parts without anything between them, so it differs from event_hash()."""
    return F.sha2(F.concat(F.coalesce(prev, F.lit("")), kind, payload, at), 256)


def _link(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of events sorted by log and place; only the last hash is carried from batch to batch."""
    log, prev = None, GENESIS
    for b in batches:
        payloads, prevs, hashes = [], [], []
        for own, *parts in zip(*(b.column(c).to_pylist() for c in ("log", "event_type", "payload", "at"))):
            if own != log:
                log, prev = own, GENESIS
            parts[1] = canonical(parts[1])
            payloads.append(parts[1])
            prevs.append(prev)
            prev = sha256("|".join([prev, *[p for p in parts if p is not None]]).encode()).hexdigest()
            hashes.append(prev)
        columns = [pa.array(payloads, pa.string()) if n == "payload" else c for n, c in zip(b.schema.names, b.columns)]
        yield pa.RecordBatch.from_arrays([*columns, pa.array(prevs, pa.string()), pa.array(hashes, pa.string())], names=[*b.schema.names, "prev_hash", "this_hash"])


def chain(events: DataFrame) -> DataFrame:
    """events (log, seq, event_type, payload, at string) with prev_hash and this_hash; the payload comes out in canonical form."""
    rows = events.where("log is not null").select("log", "seq", "event_type", "payload", "at")
    schema = T.StructType([*rows.schema.fields, T.StructField("prev_hash", T.StringType()), T.StructField("this_hash", T.StringType())])
    return rows.repartition("log").sortWithinPartitions("log", "seq").mapInArrow(_link, schema)


def _scanner(log_type: pa.DataType):
    schema = pa.schema([("log", log_type), ("from_seq", pa.int64()), ("events", pa.int64()), ("bad", pa.int64()), ("first_prev", pa.string()), ("last_hash", pa.string())])

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Counts a sorted partition's events log by log: events, place of the first bad one, and the hashes at both ends."""
        log, part = None, []
        row = lambda: pa.RecordBatch.from_pylist([dict(zip(schema.names, (log, *part)))], schema=schema)
        for b in batches:
            for own, seq, prev, this, want in zip(*(b.column(c).to_pylist() for c in ("log", "seq", "prev_hash", "this_hash", "want"))):
                if own != log:
                    if part:
                        yield row()
                    log, part = own, [seq, 0, None, prev, None]
                elif prev != part[4] and part[2] is None:
                    part[2] = part[1]
                if this != want and part[2] is None:
                    part[2] = part[1]
                part[1] += 1
                part[4] = this
        if part:
            yield row()

    return scan


def verify(chained: DataFrame) -> DataFrame:
    """(log, events, valid, first_bad): first_bad is the place of the first event whose link or hash is wrong, null if none."""
    rows = chained.where("log is not null").withColumn("want", event_hash(F.col("prev_hash"), F.col("event_type"), F.col("payload"), F.col("at"))).select("log", "seq", "prev_hash", "this_hash", "want")
    parts = rows.repartitionByRange("log", "seq").sortWithinPartitions("log", "seq").mapInArrow(_scanner(to_arrow_type(chained.schema["log"].dataType)), f"log {chained.schema['log'].dataType.simpleString()}, from_seq bigint, events bigint, bad bigint, first_prev string, last_hash string")
    # a log has as many rows here as partitions it reaches into
    w = W.partitionBy("log").orderBy("from_seq")
    joined = parts.withColumns({"before": F.lag("last_hash", 1, GENESIS).over(w), "offset": F.coalesce(F.sum("events").over(w.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))})
    first = F.when(F.col("first_prev") != F.col("before"), F.lit(0).cast("bigint")).otherwise(F.col("bad")) + F.col("offset")
    return joined.groupBy("log").agg(F.sum("events").alias("events"), F.min(first).isNull().alias("valid"), F.min(first).alias("first_bad"))


def compliance(chained: DataFrame) -> DataFrame:
    """Counts and first and last time per event type, with whether every log of the type's events is intact."""
    good = verify(chained).select("log", "valid")
    return chained.join(good, "log").groupBy("event_type").agg(F.count(F.lit(1)).alias("events"), F.min("at").alias("first_at"), F.max("at").alias("last_at"), F.min("valid").alias("chain_valid"))


def export(events: DataFrame, path: str, log=None, limit: int = 10_000) -> None:
    """The first `limit` events, of one log if one is named, as JSON lines."""
    rows = events if log is None else events.where(F.col("log") == log)
    rows.orderBy("log", "seq").limit(limit).coalesce(1).write.mode("overwrite").json(path)
