"""Queries of the operators of this package, by problem number."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinmesh.llm import copies, grouping, increments, matching, oracles, packing, person, places, survivor, tokens, truncation
from kinmesh.llm.common import label, words
from kinmesh.storage import Scratch, table

# ---- 4: groups


def clean_key(c):
    """A customer_key as written in customers_norm: lower case, nothing around it."""
    return F.regexp_replace(F.lower(c), r"^[^0-9a-z]+|[^0-9a-z]+$", "")


def links(spark: SparkSession, d: str) -> DataFrame:
    """(a, b): ends of the pairs with at least one AUTO_LINK decision."""
    linked = table(spark, d, "match_decisions").where(label(F.col("decision")) == "AUTOLINK").select("pair_id")
    pairs = table(spark, d, "candidate_pairs").select("pair_id", clean_key(F.col("a_key")).alias("a"), clean_key(F.col("b_key")).alias("b")).where("a != b")
    return pairs.join(linked, "pair_id", "left_semi").select("a", "b")


def p4_found(spark: SparkSession, d: str) -> DataFrame:
    return grouping.hash_to_min(links(spark, d), "a", "b").where("group_key != key").select("group_key", F.col("key").alias("customer_key"))


def p4_sizes(spark: SparkSession, d: str) -> DataFrame:
    """Every group with its number of members."""
    return grouping.hash_to_min(links(spark, d), "a", "b").groupBy("group_key").agg(F.count(F.lit(1)).alias("members"))


# ---- 5: survivors


def members(spark: SparkSession, d: str) -> DataFrame:
    """(grp, member, fields, rank, weight): current members of clusters with at least two, ranked by the rules of p5_found."""
    current = table(spark, d, "clusters").where("valid_to is null").select("cluster_id", "customer_key").distinct()
    several = current.groupBy("cluster_id").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("cluster_id")
    current = current.join(several, "cluster_id", "left_semi")
    started = table(spark, d, "runs").groupBy("run_id").agg(F.max("started_at").alias("started_at"))
    trust = table(spark, d, "source_systems").groupBy(label(F.col("source_system")).alias("src")).agg(F.min("trust_rank").alias("trust"))
    people = table(spark, d, "customers_norm").withColumn("src", label(F.col("source_system")))
    people = people.join(started, "run_id", "left").join(trust, "src", "left")
    believed = F.when(~F.coalesce(F.col("updated_at") > F.col("started_at"), F.lit(False)), F.unix_micros("updated_at"))
    late, least = F.lit(2**63 - 1), F.coalesce("trust", F.lit(2**31 - 1))
    rank = F.struct(F.coalesce(-believed, late).alias("age"), least.alias("trust"), F.col("customer_key").alias("tie"))
    weight = 1.0 / (1.0 + F.coalesce("trust", F.lit(9)))
    fields = ["name_norm", "phone_norm", "email_norm", "dob_norm", "address_norm", "city_norm", "natid_norm"]
    return people.select("customer_key", *fields, rank.alias("rank"), weight.alias("weight")).join(current, "customer_key").withColumnRenamed("cluster_id", "grp")


def p5_found(spark: SparkSession, d: str) -> DataFrame:
    """The member whose phone survives: dominance vote by recency, trust and key."""
    phone = survivor.usable_phone(F.col("phone_norm"))
    values = members(spark, d).select("grp", "customer_key", "rank", "weight", "phone_norm", phone.alias("digits")).where("digits is not null")
    # each member's number is a value of its own, so that the one member can be named
    values = values.select("grp", F.lit("phone_norm").alias("field"), F.col("digits").alias("value"), F.array("digits").alias("tokens"), "weight", "rank", F.col("customer_key").alias("member"))
    return survivor.consensus(values, "dominance").select(F.col("grp").alias("cluster_id"), F.col("member").alias("customer_key"))


def p5_record(spark: SparkSession, d: str) -> DataFrame:
    """One surviving record per cluster, each field by consensus with trust as weight."""
    m = members(spark, d)
    bare = lambda c: F.regexp_replace(F.upper(c), r"[^\p{L}\p{N}]", "")
    code = {"phone_norm": survivor.usable_phone(F.col("phone_norm")), "dob_norm": F.regexp_replace("dob_norm", r"\D", ""), "natid_norm": bare(F.col("natid_norm"))}
    text = {c: words(F.col(c)) for c in ("name_norm", "email_norm", "address_norm", "city_norm")}
    tokens = {c: F.array(v) for c, v in code.items()} | text
    long = F.array(*[F.struct(F.lit(c).alias("field"), F.trim(F.col(c)).alias("value"), t.alias("tokens")) for c, t in tokens.items()])
    values = m.select("grp", F.inline(long), "weight", "rank", F.col("customer_key").alias("member")).where("value != '' and tokens[0] is not null and lower(tokens[0]) not in ('', 'na', 'unknown')")
    out = survivor.consensus(values, "sum")
    by_field = [F.max(F.when(F.col("field") == c, F.col("value"))).alias(c) for c in [*text, *code]]
    return out.groupBy(F.col("grp").alias("cluster_id")).agg(*by_field)


# ---- 7: copies

def customer_key():
    return copies.canonical(["phone_norm", "email_norm", "dob_norm", "address_norm", "city_norm", "natid_norm"], ["name_norm"])


def staging_key():
    return copies.canonical(["CUSDOB", "MOBLNO", "TELENO", "MAILID", "CITYNM", "POSTCODE", "NATLID"], ["CUSNMF", "CUSNML"], ["ADDRS1", "ADDRS2", "ADDRS3", "ADDRS4"])


def _every(spark: SparkSession, d: str) -> DataFrame:
    """Both tables in one sort; the table's letter leads the key, so no run spans both."""
    a = table(spark, d, "customers_norm").select("ingest_seq", F.concat(F.lit("c\x1e"), customer_key()).alias("key"))
    b = table(spark, d, "challenging_er_200").select("ingest_seq", F.concat(F.lit("s\x1e"), staging_key()).alias("key"))
    return copies.runs(a.unionByName(b), "ingest_seq", F.col("key"))


def p7_found(spark: SparkSession, d: str) -> DataFrame:
    return copies.pairs(_every(spark, d))


def p7_collapsed(spark: SparkSession, d: str) -> DataFrame:
    """One row per distinct record with the exact number of its copies."""
    return _every(spark, d).groupBy(F.col("rep").alias("ingest_seq")).agg(F.count(F.lit(1)).alias("copies"))


# ---- 8: token ids


def p8_ids(spark: SparkSession, d: str) -> DataFrame:
    return tokens.encode(table(spark, d, "documents"), "doc_id", "text").withColumnRenamed("key", "doc_id")


def p8_text(spark: SparkSession, d: str) -> DataFrame:
    """Texts made from the ids again; null and empty texts are empty."""
    return tokens.decode(tokens.encode(table(spark, d, "documents"), "doc_id", "text")).select(F.col("key").alias("doc_id"), "text")


# ---- 2: increments


#: The history is replayed in so many deliveries, each a range of runs; in production every run is one.
DELIVERIES = 3


def p2_found(spark: SparkSession, d: str) -> DataFrame:
    """Records of DELTA runs that an earlier run has delivered for the same person and source.

    Runs are delivered to the index in order of time, DELIVERIES ranges of about equal numbers of records.
    """
    runs = table(spark, d, "runs").groupBy("run_id").agg(F.max("started_at").alias("at"), F.max(label(F.col("mode")) == "DELTA").alias("asks"))
    customers = table(spark, d, "customers_norm").withColumn("id", F.coalesce("ingest_seq", F.xxhash64("customer_key")))
    at = F.unix_micros("at")
    said = customers.select("run_id").join(runs, "run_id").agg(F.count(F.lit(1)), F.percentile_approx(at, [i / DELIVERIES for i in range(1, DELIVERIES)], 10_000)).first()
    scratch = Scratch(spark, "deliveries")
    first = scratch.put(person.profile(customers, "id", "run_id"))
    batch = sum((F.when(at > edge, 1).otherwise(0) for edge in said[1] or []), F.lit(0))
    people = person.without_shared(first).join(runs, "run_id").where("at is not null")
    people = people.select("id", F.coalesce("src", F.lit("")).alias("scope"), "at", F.coalesce("asks", F.lit(False)).alias("asks"), *increments.FIELDS, batch.alias("batch"))
    people = scratch.put(people, by="batch")
    scratch.drop(first)
    buckets = max(int(spark.conf.get("spark.sql.shuffle.partitions")), said[0] * increments.BANDS // 4_000_000)
    place = Scratch(spark, "history")
    history = increments.History(spark, place.root, buckets)
    found = []
    for k in range(DELIVERIES):
        found.append(history.deliver(people.where(F.col("batch") == k).drop("batch")).select("id"))
    history.forget()
    place.sweep()
    scratch.sweep()
    return customers.join(reduce(DataFrame.unionByName, found), "id", "left_semi").select("customer_key")


# ---- 3: places


def addresses(spark: SparkSession, d: str) -> DataFrame:
    a = table(spark, d, "customers_norm").select(F.col("ingest_seq").alias("seq"), F.array("address_norm").alias("parts"), F.col("city_norm").alias("city"), F.lit(None).cast("string").alias("post"))
    b = table(spark, d, "challenging_er_200").select(F.col("ingest_seq").alias("seq"), F.array("ADDRS1", "ADDRS2", "ADDRS3", "ADDRS4").alias("parts"), F.col("CITYNM").alias("city"), F.col("POSTCODE").alias("post"))
    return a.unionByName(b).where("seq is not null and exists(parts, p -> trim(p) != '')")


def p3_found(spark: SparkSession, d: str) -> DataFrame:
    return places.Places(addresses(spark, d)).pairs()


def p3_classes(spark: SparkSession, d: str) -> DataFrame:
    """Every row with the smallest row of its class of addresses written alike, and that class's number of links to others."""
    found = places.Places(addresses(spark, d))
    first = found.members.groupBy("id").agg(F.min("seq").alias("rep"))
    linked = found.links().select(F.explode(F.array("a", "b")).alias("id")).groupBy("id").agg(F.count(F.lit(1)).alias("links"))
    return found.members.join(first.join(linked, "id", "left"), "id").select("seq", "rep", F.coalesce("links", F.lit(0)).alias("links"))


# ---- 6: people across sources


def p6_pairs(spark: SparkSession, d: str) -> DataFrame:
    """(a_key, b_key, confidence) of records of one person in different sources."""
    customers = table(spark, d, "customers_norm").withColumn("id", F.coalesce("ingest_seq", F.xxhash64("customer_key")))
    people = person.prepared(customers, "id")
    found = matching.matches(people)
    Scratch(spark, "people").drop(people)  # matches() has written what it needs of them
    name = lambda p: customers.select(F.col("id").alias(p), F.col("customer_key").alias(f"{p}_key"))
    named = found.join(name("a"), "a").join(name("b"), "b")
    return named.select(F.least("a_key", "b_key").alias("a_key"), F.greatest("a_key", "b_key").alias("b_key"), F.round("confidence", 6).alias("confidence"))


def p6_found(spark: SparkSession, d: str) -> DataFrame:
    return p6_pairs(spark, d).select("a_key", "b_key")


# ---- 9: containers


def p9_packed(spark: SparkSession, d: str) -> DataFrame:
    """(doc_id, part, tokens, container): every document in containers of 2,048 tokens."""
    sized = Scratch(spark, "lengths").put(tokens.lengths(table(spark, d, "documents"), "doc_id", "text"))
    return packing.pack(sized).withColumnRenamed("key", "doc_id")


# ---- 10: lost ends


def ends(spark: SparkSession, d: str) -> DataFrame:
    # "en", "EN" and "eng" are one language, and what names none is one group
    lang = F.left(F.lower(F.coalesce("lang", F.lit("un"))), F.lit(2))
    return truncation.cut(table(spark, d, "documents").select(F.col("doc_id").alias("key"), "text", "source", lang.alias("lang")))


def p10_found(spark: SparkSession, d: str) -> DataFrame:
    return ends(spark, d).where("cut").select(F.col("key").alias("doc_id"))


def p10_share(spark: SparkSession, d: str) -> DataFrame:
    """How often each source cuts its texts."""
    every = table(spark, d, "documents").select(F.col("doc_id").alias("key"), "source")
    cut = ends(spark, d).select("key", "cut")
    return every.join(cut, "key", "left").groupBy("source").agg(F.count(F.lit(1)).alias("documents"), F.count_if(F.coalesce("cut", F.lit(False))).alias("cut")).withColumn("share", F.round(F.col("cut") / F.col("documents"), 6))


QUERIES = {
    "p4_found": p4_found, "p4_sizes": p4_sizes, "p5_found": p5_found, "p5_record": p5_record,
    "p2_found": p2_found, "p3_found": p3_found, "p3_classes": p3_classes, "p6_found": p6_found, "p6_pairs": p6_pairs, "p9_packed": p9_packed, "p10_found": p10_found, "p10_share": p10_share,
    "p7_found": p7_found, "p7_collapsed": p7_collapsed, "p8_ids": p8_ids, "p8_text": p8_text,
}
ORACLE = oracles.ORACLE
