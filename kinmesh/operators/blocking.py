"""Blocking keys, their statistics and guards, and candidate pairs.

All keys of a record are made in one pass and exploded; blocks are never collected. Keys on too many records are dropped
by the policy's guards before the self-join, which is also what bounds a block's pairs.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinmesh.config import BlockingConfig
from kinmesh.functions import text as t
from kinmesh.storage import Scratch

LSH_HASHES, LSH_BAND = 16, 4


def lsh_keys(name: Column) -> Column:
    """Four band keys of the 3-gram minwise hashes of a name without blanks; none below three characters."""
    bare = F.lower(F.replace(name, F.lit(" "), F.lit("")))
    grams = F.transform(F.sequence(F.lit(1), F.length(bare) - 2), lambda i: F.substring(bare, i, F.lit(3)))
    seeds = [int(s) for s in np.random.default_rng(1).integers(1, 2**31, LSH_HASHES)]
    bands = []
    for b in range(0, LSH_HASHES, LSH_BAND):
        least = [F.array_min(F.transform(grams, _hashed(k))) for k in seeds[b : b + LSH_BAND]]
        bands.append(F.concat(F.lit(f"{b}:"), F.md5(F.concat_ws(",", *[x.cast("string") for x in least]))))
    return F.when(F.length(bare) >= 3, F.array(*bands)).otherwise(F.array().cast("array<string>"))


def _hashed(seed: int):
    return lambda g: F.xxhash64(g, F.lit(seed))


def blocking_keys(norm: DataFrame, cfg: BlockingConfig) -> DataFrame:
    """(customer_key, method, block_key), distinct; a key is the MD5 of method and value."""
    return norm.select("customer_key", F.inline(_listed_keys(cfg)))


def _listed_keys(cfg: BlockingConfig) -> Column:
    name, tokens = F.col("name_norm"), t.tokens(F.col("name_norm"), cfg.min_token)
    one = lambda c: F.array(c)
    values = {
        "phone_last10": one(F.col("phone_norm")), "email_exact": one(F.col("email_norm")), "email_domain": one(t.email_domain(F.col("email_norm"))), "natid_exact": one(F.col("natid_norm")), "dob_exact": one(F.col("dob_norm")),
        "soundex_full": one(t.soundex(name)), "soundex_first": one(t.soundex(F.get(tokens, 0))), "name_token": F.slice(tokens, 1, cfg.max_tokens), "city_exact": one(F.col("city_norm")),
        "dob_initial": one(F.concat(F.col("dob_norm"), F.lit(":"), F.left(name, F.lit(1)))), "lsh_minhash": lsh_keys(name),
    }
    return F.concat(*[F.transform(F.array_distinct(F.array_compact(F.coalesce(values[m], F.array().cast("array<string>")))), _keyed(m)) for m in cfg.methods])


def _keyed(method: str):
    return lambda v: F.struct(F.lit(method).alias("method"), F.md5(F.concat(F.lit(method + ":"), v)).alias("block_key"))


def key_stats(keys: DataFrame) -> DataFrame:
    return keys.groupBy("method", "block_key").agg(F.count(F.lit(1)).alias("n"))


def suppressed(stats: DataFrame, norm: DataFrame, cfg: BlockingConfig) -> DataFrame:
    """Keys that stand on more than the allowed share of all records."""
    total = norm.agg(F.count(F.lit(1)).alias("total"))  # one row
    return stats.crossJoin(F.broadcast(total)).where(100.0 * cfg.frequency_factor * F.col("n") / F.col("total") > cfg.suppress_pct).drop("total")


def kept(keys: DataFrame, norm: DataFrame, cfg: BlockingConfig) -> DataFrame:
    """Keys whose block passes both guards."""
    stats = key_stats(keys)
    total = norm.agg(F.count(F.lit(1)).alias("total"))  # one row
    good = stats.crossJoin(F.broadcast(total)).where((100.0 * cfg.frequency_factor * F.col("n") / F.col("total") <= cfg.suppress_pct) & F.col("n").between(2, cfg.max_block))
    return keys.join(good.select("block_key"), "block_key", "left_semi")


def candidate_pairs(keys: DataFrame, norm: DataFrame, cfg: BlockingConfig) -> DataFrame:
    """(a_key, b_key, pair_id, blocking_reasons, block_key_sample), a_key < b_key."""
    good = kept(keys, norm, cfg)
    a = good.select("block_key", "method", F.col("customer_key").alias("a_key"))
    b = good.select("block_key", F.col("customer_key").alias("b_key"))
    met = a.join(b, "block_key").where("a_key < b_key")
    pairs = met.groupBy("a_key", "b_key").agg(F.array_sort(F.collect_set("method")).alias("blocking_reasons"), F.min("block_key").alias("block_key_sample"))
    pairs = pairs.withColumn("pair_id", F.concat_ws(":", "a_key", "b_key"))
    return pairs.orderBy("a_key", "b_key").limit(cfg.max_pairs) if cfg.max_pairs else pairs


def in_blocks(norm: DataFrame, cfg: BlockingConfig, carried: list[str]) -> DataFrame:
    """(rid, customer_key, carried, good): the records that hold keys passing both guards, with the list of these keys as bytes.

    A key on one record only stays listed, as it meets nothing. Only the keys that fail are written and joined, which are few:
    each stands on more than max_block records or on a large share of all. rid numbers the rows of norm, a written table.
    """
    keys = F.transform(_listed_keys(cfg), lambda k: F.unhex(k["block_key"]))
    total = norm.agg(F.count(F.lit(1)).alias("total"))  # one row
    counted = norm.select(F.explode(keys).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    fails = (100.0 * cfg.frequency_factor * F.col("n") / F.col("total") > cfg.suppress_pct) | (F.col("n") > cfg.max_block)
    failed = Scratch(norm.sparkSession, "failed-keys").put(counted.crossJoin(F.broadcast(total)).where(fails).select("k"))
    numbered = norm.select(F.monotonically_increasing_id().alias("rid"), "customer_key", *carried, keys.alias("keys"))  # before explode, else its rows are numbered
    held = numbered.withColumn("k", F.explode("keys")).drop("keys").join(failed, "k", "left_anti")
    return held.groupBy("rid").agg(*[F.first(c).alias(c) for c in ["customer_key", *carried]], F.collect_list("k").alias("good"))


def meetings(blocks: DataFrame, carried: list[str]) -> DataFrame:
    """The pairs of candidate_pairs() with both records' rid and carried columns, from in_blocks(); customer_key is unique.

    A pair that meets in several blocks is taken from the least key both hold, so pairs are neither written nor shuffled.
    """
    rows = blocks.select("rid", "customer_key", *carried, "good", F.explode("good").alias("k"))
    named = {"customer_key": "key"}
    side = lambda p: rows.select(F.col("k").alias(f"{p}_k"), *[F.col(c).alias(f"{p}_{named.get(c, c)}") for c in ["rid", "customer_key", *carried, "good"]])
    earlier = F.exists("a_good", lambda x: (x < F.col("a_k")) & F.array_contains("b_good", x))
    met = side("a").join(side("b"), (F.col("a_k") == F.col("b_k")) & (F.col("a_key") < F.col("b_key"))).where(~earlier)
    return met.drop("a_k", "b_k", "a_good", "b_good").withColumn("pair_id", F.concat_ws(":", "a_key", "b_key"))


def preview_pairs(norm: DataFrame, stored: DataFrame | None = None, most: int = 500) -> DataFrame:
    """Pairs a preview scores: all of a set under `most` records, else the stored candidates, else all of the first `most`."""
    small = norm.limit(most).count() < most
    return all_pairs(norm, most) if small or stored is None else stored.select("a_key", "b_key", F.concat_ws(":", "a_key", "b_key").alias("pair_id"))


def all_pairs(norm: DataFrame, most: int = 500) -> DataFrame:
    """Every pair of the first `most` records; a preview of small sets only."""
    few = norm.orderBy("ingest_seq").limit(most).select("customer_key")
    a, b = few.withColumnRenamed("customer_key", "a_key"), few.withColumnRenamed("customer_key", "b_key")
    return a.join(F.broadcast(b), F.col("a_key") < F.col("b_key")).withColumn("pair_id", F.concat_ws(":", "a_key", "b_key"))


def recall(pairs: DataFrame, norm: DataFrame, truth: str) -> DataFrame:
    """(found, true): how many pairs of equal `truth` the candidates hold, of how many there are."""
    n = F.col("count")
    true = norm.where(F.col(truth).isNotNull()).groupBy(truth).count().agg(F.sum((n * (n - 1) / 2).cast("bigint")).alias("true"))
    side = lambda p: norm.select(F.col("customer_key").alias(f"{p}_key"), F.col(truth).alias(f"{p}_truth"))
    found = pairs.join(side("a"), "a_key").join(side("b"), "b_key").where("a_truth = b_truth").agg(F.count(F.lit(1)).alias("found"))
    return found.crossJoin(true)


def stats(keys: DataFrame, norm: DataFrame) -> DataFrame:
    """One row: records, distinct keys, keys per record."""
    total = norm.agg(F.count(F.lit(1)).alias("total_records"))
    k = keys.agg(F.count_distinct("block_key").alias("distinct_keys"), F.count(F.lit(1)).alias("keys"))
    return total.crossJoin(k).select("total_records", "distinct_keys", F.round(F.try_divide("keys", "total_records"), 6).alias("avg_keys"))
