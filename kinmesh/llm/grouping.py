"""Problem 4: one group key for everything that pairwise matches connect.

Hash-to-min in row form: the cluster set of a vertex v is the set of rows (v, u), never an array. Each round a vertex sends
its set to its smallest member and that member to the rest. The sets stay rows, so a component that holds a third of all
vertices is spread over tasks: the minimum and the removal of repeats combine before the shuffle, and the join of a hot
vertex's rows with its one minimum is left to the skew join of adaptive execution. Each round is a written table in the
shared folder; the one before it is deleted.

Defined edge cases: null ends and self pairs link nothing; repeated and exchanged pairs count once; no pairs, no rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, Observation
from pyspark.sql import functions as F

from kinmesh.storage import Scratch

#: Rounds grow with the logarithm of the longest chain; this many would need a chain of more than 2 ** 60 links.
ROUNDS = 64


def hash_to_min(pairs: DataFrame, a: str, b: str) -> DataFrame:
    """(group_key, key): for each vertex of `pairs` the smallest vertex of its component, the smallest itself included."""
    ends = pairs.select(F.col(a).alias("v"), F.col(b).alias("u")).where("v is not null and u is not null and v != u")
    state = ends.unionByName(ends.select(F.col("u").alias("v"), F.col("v").alias("u"))).distinct()
    scratch = Scratch(pairs.sparkSession, "groups")
    mark, last = None, None
    for _ in range(ROUNDS):
        seen = Observation()
        written = scratch.put(state.observe(seen, F.count(F.lit(1)).alias("n"), F.sum(F.xxhash64("v", "u").cast("decimal(20,0)")).alias("h")))
        if last is not None:
            scratch.drop(last)
        last = written
        if seen.get == mark:
            break
        mark = seen.get
        least = last.groupBy("v").agg(F.min("u").alias("m")).select("v", F.least("v", "m").alias("m"))
        sent = last.join(least, "v").select(F.inline(F.array(
            F.struct(F.col("m").alias("v"), F.col("u").alias("u")), F.struct(F.col("u").alias("v"), F.col("m").alias("u")),
            F.struct(F.col("m").alias("v"), F.col("v").alias("u")), F.struct(F.col("v").alias("v"), F.col("m").alias("u")),
        )))
        state = sent.where("v != u").distinct()
    else:
        raise RuntimeError(f"no fixed point after {ROUNDS} rounds")
    return last.groupBy("v").agg(F.min("u").alias("m")).select(F.least("v", "m").alias("group_key"), F.col("v").alias("key"))
