"""Clusters of linked records: connected components by alternating large and small stars, golden records, memberships.

Each round is a written table in the shared folder, so that lost executors cost one round at most.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinmesh.storage import Scratch

GOLDEN_FIELDS = ["name_norm", "phone_norm", "email_norm", "dob_norm", "address_norm", "city_norm", "natid_norm"]


def connected_components(edges: DataFrame, rounds: int = 50) -> DataFrame:
    """(customer_key, cluster_id): cluster_id is the smallest key of the component; edges: (x, y)."""
    scratch = Scratch(edges.sparkSession, "components")
    state = scratch.put(edges.where("x != y").select(F.greatest("x", "y").alias("x"), F.least("x", "y").alias("y")).distinct())
    mark = None
    for _ in range(rounds):
        both = state.unionByName(state.select(F.col("y").alias("x"), F.col("x").alias("y")))
        least = both.groupBy("x").agg(F.min("y").alias("m")).select("x", F.least("x", "m").alias("m"))
        large = both.join(least, "x").where("y > x").select(F.col("y").alias("x"), F.col("m").alias("y")).distinct()
        low = large.groupBy("x").agg(F.min("y").alias("m"))
        small = large.join(low, "x").select(F.inline(F.array(F.struct(F.col("y").alias("x"), F.col("m").alias("y")), F.struct(F.col("x").alias("x"), F.col("m").alias("y"))))).where("x != y").distinct()
        seen = Observation()
        after = scratch.put(small.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("x", "y").cast("decimal(20,0)")).alias("h")))
        scratch.drop(state)
        state = after
        if seen.get == mark:
            break
        mark = seen.get
    else:
        raise RuntimeError(f"no fixed point after {rounds} rounds")
    roots = state.select(F.col("y").alias("customer_key"), F.col("y").alias("cluster_id")).distinct()
    return state.select(F.col("x").alias("customer_key"), F.col("y").alias("cluster_id")).unionByName(roots)


def _forests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch a spanning forest of its automatic links and, as one row without ends, the number of its reviews."""
    for b in batches:
        root: dict[int, int] = {}
        kept: list[tuple[int | None, int | None, int]] = []
        reviews = 0
        for x, y, decision in zip(*(c.to_pylist() for c in b.columns)):
            if decision != "AUTO_LINK":
                reviews += 1
                continue
            p, q = x, y
            while (up := root.get(p, p)) != p:
                root[p] = root.get(up, up)
                p = up
            while (up := root.get(q, q)) != q:
                root[q] = root.get(up, up)
                q = up
            if p != q:
                root[p] = q
                kept.append((x, y, 0))
        kept.append((None, None, reviews))
        yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*kept)], names=["x", "y", "reviews"])


def thinned(decided: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links (x, y) over the pairs' rid that connect what their automatic links connect, and one row with the number of reviews.

    Each Arrow batch gives a spanning forest, so of a block of n records with n * (n - 1) / 2 links hardly more than n stay.
    """
    open_ = decided.where("decision != 'REJECT'").select("a_rid", "b_rid", "decision")
    found = Scratch(decided.sparkSession, "thinned").put(open_.mapInArrow(_forests, "x bigint, y bigint, reviews bigint"))
    return found.where("x is not null").select("x", "y"), found.agg(F.coalesce(F.sum("reviews"), F.lit(0)).alias("reviews"))


def clusters(norm: DataFrame, edges: DataFrame) -> DataFrame:
    """(customer_key, cluster_id) of every record; a record without links is its own cluster."""
    found = connected_components(edges)
    return norm.select("customer_key").join(found, "customer_key", "left").select("customer_key", F.coalesce("cluster_id", "customer_key").alias("cluster_id"))


def sizes(members: DataFrame) -> DataFrame:
    return members.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size"))


def golden(members: DataFrame, norm: DataFrame) -> DataFrame:
    """Per cluster the last non-empty value of each field in ingest order, member count and the first LISTED source ids.

    Members beyond LISTED stay rows (golden_sources()), so no cluster is ever collected into one row.
    """
    both = members.join(norm, "customer_key")
    latest = [F.max_by(f, F.when(F.col(f) != "", F.col("ingest_seq"))).alias(f) for f in GOLDEN_FIELDS]
    one = both.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("member_count"), *latest)
    return one.join(_listed(golden_sources(members, norm), "source_customer_id", "source_ids"), "cluster_id", "left").withColumn("source_ids", F.coalesce("source_ids", F.lit("")))


#: Members that a list in one row names; the rest is in the tables of members.
LISTED = 1000


def golden_sources(members: DataFrame, norm: DataFrame) -> DataFrame:
    """(cluster_id, k, source_customer_id): the records a golden record is made of, in ingest order."""
    both = members.join(norm.select("customer_key", "ingest_seq", "source_customer_id"), "customer_key").where("source_customer_id != ''")
    return both.withColumn("k", F.row_number().over(W.partitionBy("cluster_id").orderBy("ingest_seq"))).select("cluster_id", "k", "source_customer_id")


def _listed(rows: DataFrame, column: str, name: str) -> DataFrame:
    """The values of rows (cluster_id, k, column) up to k = LISTED as one text."""
    few = rows.where(F.col("k") <= LISTED).groupBy("cluster_id").agg(F.array_sort(F.collect_list(F.struct("k", column))).alias("list"))
    return few.select("cluster_id", F.array_join(F.col("list")[column], ",").alias(name))


def listed_members(members: DataFrame) -> DataFrame:
    """(cluster_id, size, members): members by key, the first LISTED of each cluster."""
    ranked = members.withColumn("k", F.row_number().over(W.partitionBy("cluster_id").orderBy("customer_key")))
    return sizes(members).join(_listed(ranked, "customer_key", "members"), "cluster_id")


def consensus_name(members: DataFrame, norm: DataFrame, first: int = 20) -> DataFrame:
    """Most frequent name among the first members, ties to the one seen first."""
    order = W.partitionBy("cluster_id").orderBy("ingest_seq")
    few = members.join(norm.select("customer_key", "ingest_seq", "name_norm"), "customer_key").withColumn("k", F.row_number().over(order)).where(F.col("k") <= first)
    counted = few.where("name_norm is not null").groupBy("cluster_id", "name_norm").agg(F.count(F.lit(1)).alias("c"), F.min("k").alias("k"))
    return counted.groupBy("cluster_id").agg(F.max_by("name_norm", F.struct(F.col("c"), (-F.col("k")).alias("k"))).alias("consensus_name"))


def membership_changes(before: DataFrame, now: DataFrame, at) -> DataFrame:
    """SCD2: memberships after replacing the open ones of `before` (customer_key, cluster_id, valid_from, valid_to) by `now`."""
    open_, closed = before.where("valid_to is null"), before.where("valid_to is not null")
    both = open_.join(now.select("customer_key", F.col("cluster_id").alias("new_id")), "customer_key", "full_outer")
    kept = both.where("cluster_id = new_id").select("customer_key", "cluster_id", "valid_from", "valid_to")
    ended = both.where("cluster_id is not null and (new_id is null or cluster_id != new_id)").select("customer_key", "cluster_id", "valid_from", F.lit(at).cast("timestamp").alias("valid_to"))
    begun = both.where("new_id is not null and (cluster_id is null or cluster_id != new_id)").select("customer_key", F.col("new_id").alias("cluster_id"), F.lit(at).cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return closed.select("customer_key", "cluster_id", "valid_from", "valid_to").unionByName(kept).unionByName(ended).unionByName(begun)
