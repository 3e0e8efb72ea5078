"""Graph tables of a run: nodes, edges, properties, views with caps, one cluster, and the preview of another configuration."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinmesh.operators import components

PROPS = ["name_norm", "email_norm", "phone_norm", "dob_norm", "natid_norm"]
#: Clusters a view shows unless asked otherwise, the most it may, and how many nodes it returns per cluster.
LIMIT, MOST, NODES = 500, 2000, 10


def risk(*columns: str) -> Column:
    """High if any property speaks of suspension, Medium if of inactivity, else Low."""
    every = F.concat_ws(" ", *columns)
    return F.when(every.contains("SUSP"), "High").when(every.contains("INACT"), "Medium").otherwise("Low")


def properties(norm: DataFrame) -> Column:
    """What a record's node carries: its fields and metadata, without nulls and empty texts."""
    meta = norm.schema["metadata"].dataType.names if "metadata" in norm.columns else []
    pairs = [x for p in PROPS for x in (F.lit(p), F.col(p))] + [x for m in meta for x in (F.lit(f"meta_{m}"), F.col(f"metadata.{m}"))]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != ""))


def projection(members: DataFrame, norm: DataFrame, golden: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the property graph: an entity per cluster, a record per source and source id, BELONGS_TO between them."""
    entity = golden.select(F.col("cluster_id").alias("id"), F.lit("Entity").alias("type"), F.map_filter(F.create_map(*[x for p in ("name_norm", "email_norm", "phone_norm", "city_norm") for x in (F.lit(p), F.col(p))]), lambda k, v: v.isNotNull() & (v != "")).alias("properties"))
    key = F.concat_ws(":", F.coalesce("source_system", F.lit("UNKNOWN")), F.coalesce("source_customer_id", F.lit("UNKNOWN")))
    records = norm.withColumns({"id": key, "properties": properties(norm)})
    # later records of one source id overwrite what they have
    record = records.groupBy("id").agg(F.max_by("properties", "ingest_seq").alias("properties")).select("id", F.lit("Record").alias("type"), "properties")
    edges = members.join(records.select("customer_key", "id"), "customer_key").select(F.col("id").alias("source"), F.col("cluster_id").alias("target"), F.lit("BELONGS_TO").alias("type")).distinct()
    return entity.unionByName(record), edges


def view(members: DataFrame, norm: DataFrame, limit: int = LIMIT, singletons: bool = True) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of the first `limit` clusters: the cluster and its first members (50, of large clusters 20).

    Nodes end at NODES times the limit, clusters before their members.
    """
    if not 0 < limit <= MOST:
        raise ValueError(f"limit must lie between 1 and {MOST}")
    sized = components.sizes(members)
    sized = sized if singletons else sized.where("size > 1")
    shown = sized.orderBy("cluster_id").limit(limit)
    both = members.join(F.broadcast(shown), "cluster_id").join(norm.select("customer_key", "ingest_seq", "name_norm"), "customer_key")  # at most MOST rows
    both = both.withColumn("k", F.row_number().over(W.partitionBy("cluster_id").orderBy("ingest_seq")))
    both = both.where(F.col("k") <= F.when(F.col("size") < 100, 50).otherwise(20))
    name = F.coalesce("name_norm", F.lit("Unknown"))
    heads = both.where("k = 1").select(F.concat(F.lit("c_"), "cluster_id").alias("id"), F.concat(name, F.when(F.col("size") > 1, " (Composite)").otherwise(" (Singleton)")).alias("label"), F.lit("cluster").alias("type"), "cluster_id", F.lit(0).alias("k"))
    tails = both.select(F.concat(F.lit("r_"), "customer_key").alias("id"), name.alias("label"), F.lit("record").alias("type"), "cluster_id", "k")
    nodes = heads.unionByName(tails).orderBy("cluster_id", "k").limit(limit * NODES).select("id", "label", "type")
    edges = both.select(F.concat(F.lit("r_"), "customer_key").alias("source"), F.concat(F.lit("c_"), "cluster_id").alias("target"), F.lit("MEMBER_OF").alias("type"), F.lit(1.0).alias("weight"))
    return nodes, edges


def one_cluster(members: DataFrame, norm: DataFrame, golden: DataFrame, cluster_id: str) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of one cluster with all members and its golden record."""
    own = members.where(F.col("cluster_id") == cluster_id).join(norm.select("customer_key", "name_norm"), "customer_key")
    best = golden.where(F.col("cluster_id") == cluster_id)
    label = F.concat(F.lit("Cluster-"), F.left("cluster_id", F.lit(8)))
    nodes = own.select("cluster_id").distinct().select(F.col("cluster_id").alias("id"), label.alias("label"), F.lit("cluster").alias("type"))
    nodes = nodes.unionByName(own.select(F.col("customer_key").alias("id"), F.coalesce("name_norm", F.lit("Unknown")).alias("label"), F.lit("record").alias("type")))
    nodes = nodes.unionByName(best.select(F.concat(F.lit("golden_"), "cluster_id").alias("id"), F.concat(F.lit("Golden: "), F.coalesce("name_norm", F.lit("Record"))).alias("label"), F.lit("golden_record").alias("type")))
    edges = own.select(F.col("customer_key").alias("source"), F.col("cluster_id").alias("target"), F.lit("MEMBER_OF").alias("type"))
    return nodes, edges.unionByName(best.select(F.concat(F.lit("golden_"), "cluster_id").alias("source"), F.concat(F.lit("c_"), "cluster_id").alias("target"), F.lit("REPRESENTS").alias("type")))


def preview(norm: DataFrame, decided: DataFrame, members: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(nodes, edges) of a run that isn't kept: clusters of several records, review pairs, and every other record on its own."""
    sized = components.sizes(members)
    both = members.join(sized, "cluster_id").join(norm.select("customer_key", "ingest_seq", "name_norm"), "customer_key")
    name = F.coalesce("name_norm", F.lit("Unknown"))
    many = both.where("size > 1")
    reviewed = decided.where("decision = 'REVIEW'").select(F.explode(F.array("a_key", "b_key")).alias("customer_key")).distinct()
    alone = both.where("size = 1").join(reviewed, "customer_key", "left_anti")
    first = many.groupBy("cluster_id").agg(F.min_by(name, "ingest_seq").alias("name"))
    nodes = first.select(F.col("cluster_id").alias("id"), F.concat("name", F.lit(" (Preview)")).alias("label"), F.lit("cluster").alias("type"))
    nodes = nodes.unionByName(both.select(F.col("customer_key").alias("id"), name.alias("label"), F.lit("record").alias("type")))
    single = F.concat(F.lit("singleton_"), "customer_key")
    nodes = nodes.unionByName(alone.select(single.alias("id"), F.concat(name, F.lit(" (Singleton)")).alias("label"), F.lit("cluster").alias("type")))
    edges = many.select(F.col("customer_key").alias("source"), F.col("cluster_id").alias("target"), F.lit("MEMBER_OF").alias("type"), F.lit(1.0).alias("weight"))
    edges = edges.unionByName(alone.select(F.col("customer_key").alias("source"), single.alias("target"), F.lit("MEMBER_OF").alias("type"), F.lit(1.0).alias("weight")))
    kind = F.when(F.col("decision") == "AUTO_LINK", "MATCHES").otherwise("REVIEW")
    pairs = decided.where("decision != 'REJECT'").select(F.col("a_key").alias("source"), F.col("b_key").alias("target"), kind.alias("type"), F.round("score", 6).alias("weight"))
    return nodes, edges.unionByName(pairs)
