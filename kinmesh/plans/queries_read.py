"""Queries over kept tables: runs, candidate pairs, decisions, clusters, events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinmesh.operators import audit, graph, review
from kinmesh.plans.registry import query
from kinmesh.storage import Scratch, table

#: One spelling of a code word, in SQL for both engines' dialects.
LABEL = "regexp_replace(upper(trim({c})), '[^A-Z]+', '_', 'g')"


def label(c: str):
    return F.regexp_replace(F.upper(F.trim(c)), "[^A-Z]+", "_")


def r6(c):
    return F.round(c, 6)


def latest_decisions(spark: SparkSession, d: str) -> DataFrame:
    """One row per pair and run: repeated and late rows leave the last one."""
    m = table(spark, d, "match_decisions")
    m = m.select("pair_id", label("decision").alias("decision"), "score", F.array_join("signals_hit", ",").alias("signals"), "decided_at")
    return review.latest(m, "pair_id", ["decided_at", "score", "decision", "signals"])


LATEST = f"m AS (SELECT pair_id, {LABEL.format(c='decision')} AS decision, score, array_to_string(signals_hit, ',') AS signals, decided_at FROM match_decisions QUALIFY row_number() OVER (PARTITION BY pair_id ORDER BY decided_at DESC, score DESC, {LABEL.format(c='decision')} DESC, array_to_string(signals_hit, ',') DESC) = 1)"


# ---- scores and decisions


@query(f"WITH {LATEST} SELECT pair_id, round(score, 6) AS score FROM m WHERE score BETWEEN 0.5 AND 0.8")
def scores_range(spark, d):
    return latest_decisions(spark, d).where(F.col("score").between(0.5, 0.8)).select("pair_id", r6("score").alias("score"))


@query(f"WITH {LATEST} SELECT pair_id, round(score, 6) AS score FROM m ORDER BY m.score DESC, pair_id LIMIT 50 OFFSET 50")
def scores_page(spark, d):
    return latest_decisions(spark, d).orderBy(F.desc("score"), "pair_id").offset(50).limit(50).select("pair_id", r6("score").alias("score"))


@query(f"WITH {LATEST} SELECT pair_id, round(score, 6) AS score, signals FROM m WHERE decision = 'REVIEW'")
def decisions_by_type(spark, d):
    wanted = "review".upper()
    found = latest_decisions(spark, d)
    if wanted in ("AUTO_LINK", "REVIEW", "REJECT"):  # any other word filters nothing
        found = found.where(F.col("decision") == wanted)
    return found.select("pair_id", r6("score").alias("score"), "signals")


@query(f"WITH {LATEST} SELECT count(*) AS total, count(*) FILTER (WHERE decision = 'AUTO_LINK') AS auto_links, count(*) FILTER (WHERE decision = 'REVIEW') AS reviews, count(*) FILTER (WHERE decision = 'REJECT') AS rejects, round(100.0 * count(*) FILTER (WHERE decision = 'AUTO_LINK') / count(*), 6) AS auto_pct FROM m")
def decision_summary(spark, d):
    counts = {n: F.count_if(F.col("decision") == k) for n, k in (("auto_links", "AUTO_LINK"), ("reviews", "REVIEW"), ("rejects", "REJECT"))}
    one = latest_decisions(spark, d).agg(F.count(F.lit(1)).alias("total"), *[c.alias(n) for n, c in counts.items()])
    return one.withColumn("auto_pct", r6(F.try_divide(100.0 * F.col("auto_links"), "total")))


_BINS = "(VALUES (0, '0.0-0.2', -1e9, 0.2), (1, '0.2-0.4', 0.2, 0.4), (2, '0.4-0.6', 0.4, 0.6), (3, '0.6-0.8', 0.6, 0.8), (4, '0.8-1.0', 0.8, 1e9)) b(bin, label, lo, hi)"


@query(f"WITH {LATEST} SELECT label, count(score) AS pairs FROM {_BINS} LEFT JOIN m ON score >= lo AND score < hi GROUP BY label")
def score_histogram(spark, d):
    """Always five bins, open at their upper end but the last; a bin without pairs has 0."""
    labels = [f"{i / 5:.1f}-{(i + 1) / 5:.1f}" for i in range(5)]
    s = F.col("score")
    counts = latest_decisions(spark, d).agg(*[F.count_if((s >= i / 5 if i else s.isNotNull()) & (s < (i + 1) / 5 if i < 4 else F.lit(True))).alias(n) for i, n in enumerate(labels)])
    return counts.select(F.inline(F.array(*[F.struct(F.lit(n).alias("label"), F.col(f"`{n}`").alias("pairs")) for n in labels])))


@query(f"WITH {LATEST} SELECT round(avg(score), 6) AS mean_score, count(*) FILTER (WHERE score >= 0.92) AS above_auto, count(*) FILTER (WHERE score >= 0.55 AND score < 0.92) AS gray, count(*) FILTER (WHERE score < 0.55) AS below_review FROM m")
def scoring_metrics(spark, d):
    s = F.col("score")
    return latest_decisions(spark, d).agg(r6(F.avg(s)).alias("mean_score"), F.count_if(s >= 0.92).alias("above_auto"), F.count_if((s >= 0.55) & (s < 0.92)).alias("gray"), F.count_if(s < 0.55).alias("below_review"))


@query(f"WITH {LATEST} SELECT decision, unnest(string_split(signals, ',')) AS signal, count(*) AS pairs FROM m WHERE signals <> '' GROUP BY 1, 2")
def signal_counts(spark, d):
    return latest_decisions(spark, d).where("signals != ''").select("decision", F.explode(F.split("signals", ",")).alias("signal")).groupBy("decision", "signal").agg(F.count(F.lit(1)).alias("pairs"))


@query("SELECT pair_id, a_key, b_key FROM candidate_pairs WHERE list_contains(blocking_reasons, 'email_exact')")
def candidates_by_method(spark, d):
    return table(spark, d, "candidate_pairs").where(F.array_contains("blocking_reasons", "email_exact")).select("pair_id", "a_key", "b_key")


@query("WITH e AS (SELECT unnest([a_key, b_key]) AS k FROM candidate_pairs) SELECT (SELECT count(*) FROM candidate_pairs) AS pairs, count(DISTINCT lower(trim(k))) AS records FROM e")
def candidate_endpoints(spark, d):
    c = table(spark, d, "candidate_pairs")
    ends = c.select(F.explode(F.array("a_key", "b_key")).alias("k")).agg(F.count_distinct(F.lower(F.trim("k"))).alias("records"))
    return c.agg(F.count(F.lit(1)).alias("pairs")).crossJoin(ends)


# ---- review


def items(spark: SparkSession, d: str) -> DataFrame:
    """The queue of all pairs whose last decision is REVIEW, with run, ends and time of the decision."""
    pairs = table(spark, d, "candidate_pairs").select("pair_id", "run_id", "a_key", "b_key")
    last = latest_decisions(spark, d)
    return review.enqueue(last.join(pairs, "pair_id")).join(last.select("pair_id", F.col("decided_at").alias("created_at")), "pair_id")


_ITEMS = f"{LATEST}, i AS (SELECT sha256(pair_id) AS review_id, m.pair_id, p.run_id, p.a_key, p.b_key, m.signals, m.score, m.decided_at AS created_at, coalesce(score BETWEEN 0.45 AND 0.85, false) AS has_ai_explanation FROM m JOIN candidate_pairs p USING (pair_id) WHERE decision = 'REVIEW')"


@query(f"WITH {_ITEMS} SELECT review_id, pair_id, run_id, a_key, b_key, signals, round(score, 6) AS score, 'PENDING' AS status, has_ai_explanation FROM i")
def review_queue(spark, d):
    return review.queue(items(spark, d), status="PENDING").withColumn("score", r6("score")).drop("evidence", "created_at")


@query(f"WITH {_ITEMS} SELECT pair_id, epoch_us(created_at) AS created_us FROM i WHERE run_id = (SELECT min(run_id) FROM candidate_pairs) ORDER BY created_at, pair_id")
def review_queue_of_run(spark, d):
    """The items of one run, oldest first."""
    run = table(spark, d, "candidate_pairs").agg(F.min("run_id")).first()[0]
    return review.queue(items(spark, d), run_id=run, by="created_at", ascending=True).select("pair_id", F.unix_micros("created_at").alias("created_us"))


@query(f"WITH {_ITEMS} SELECT review_id, pair_id, round(score, 6) AS score FROM i WHERE pair_id = (SELECT min(pair_id) FROM i)")
def review_lookup(spark, d):
    """The item of one pair, looked up by its review id and by the pair."""
    found = items(spark, d)
    pair = found.agg(F.min("pair_id")).first()[0]
    by_pair = review.lookup(found, pair_id=pair)
    ids = [r.review_id for r in by_pair.select("review_id").collect()]  # one row
    return review.lookup(found, review_id=ids[0] if ids else "").select("review_id", "pair_id", r6("score").alias("score"))


def _judged(spark: SparkSession, d: str) -> DataFrame:
    """Decisions on queue items derived from their scores an hour later: high ones approved, low and missing ones rejected, some
    without a reason; each is contradicted a day later, which comes too late."""
    q = items(spark, d)
    s = F.col("score")
    one = q.select("pair_id", F.when(s >= 0.75, review.APPROVED).otherwise(review.REJECTED).alias("decision"), F.when(s < 0.6, "no").otherwise("checked by hand").alias("reason"), (F.col("created_at") + F.expr("INTERVAL 1 HOUR")).alias("at"), F.lit("reviewer_1").alias("reviewer"))
    late = one.withColumns({"decision": F.when(F.col("decision") == review.APPROVED, review.REJECTED).otherwise(review.APPROVED), "at": F.col("at") + F.expr("INTERVAL 1 DAY")})
    return one.unionByName(late)


def judged_items(spark: SparkSession, d: str) -> DataFrame:
    return review.apply(items(spark, d), _judged(spark, d))


_STATUS = "CASE WHEN score < 0.6 THEN 'PENDING' WHEN score >= 0.75 THEN 'APPROVED' ELSE 'REJECTED' END"


@query(f"WITH {_ITEMS} SELECT pair_id, {_STATUS} AS status, CASE WHEN {_STATUS} <> 'PENDING' THEN 'checked by hand' END AS review_reason FROM i")
def review_apply(spark, d):
    return judged_items(spark, d).select("pair_id", "status", "review_reason")


@query(f"WITH {_ITEMS}, s AS (SELECT *, {_STATUS} AS status FROM i) SELECT count(*) FILTER (WHERE status = 'PENDING') AS pending, count(*) FILTER (WHERE status = 'APPROVED') AS approved, count(*) FILTER (WHERE status = 'REJECTED') AS rejected, count(*) AS total, CASE WHEN count(*) FILTER (WHERE status <> 'PENDING') > 0 THEN 3600.0::DOUBLE ELSE 0.0::DOUBLE END AS avg_review_time_seconds, count(*) FILTER (WHERE has_ai_explanation) AS with_ai_explanation FROM s")
def review_stats(spark, d):
    return review.stats(judged_items(spark, d))


@query(f"WITH {_ITEMS}, s AS (SELECT *, {_STATUS} AS status FROM i), n AS (SELECT lower(trim(a_key)) AS x, lower(trim(b_key)) AS y FROM s WHERE status = 'APPROVED') SELECT x, y, count(*) AS links FROM n GROUP BY x, y")
def approved_links(spark, d):
    """What approvals link, over all runs."""
    links = review.approved_links(judged_items(spark, d)).select(F.lower(F.trim("x")).alias("x"), F.lower(F.trim("y")).alias("y"))
    return links.groupBy("x", "y").agg(F.count(F.lit(1)).alias("links"))


@query(f"WITH {_ITEMS}, s AS (SELECT *, {_STATUS} AS status FROM i) SELECT pair_id, 'DECISION_REVIEW' AS event_type, 'SYSTEM' AS actor FROM s WHERE pair_id = (SELECT max(pair_id) FROM s WHERE status <> 'PENDING') UNION ALL SELECT pair_id, 'REVIEW_' || status, 'reviewer_1' FROM s WHERE pair_id = (SELECT max(pair_id) FROM s WHERE status <> 'PENDING')")
def audit_pair_trail(spark, d):
    """All events whose payload names one pair."""
    done = judged_items(spark, d)
    pair = done.where("status != 'PENDING'").agg(F.max("pair_id")).first()[0]
    return review.events(done).where(F.get_json_object("payload", "$.pair_id") == pair).select(F.get_json_object("payload", "$.pair_id").alias("pair_id"), "event_type", "actor")


@query(f"WITH {_ITEMS}, s AS (SELECT *, {_STATUS} AS status FROM i) SELECT event_type, count(*) AS events, true AS known FROM (SELECT 'DECISION_REVIEW' AS event_type FROM s UNION ALL SELECT 'REVIEW_' || status FROM s WHERE status <> 'PENDING') GROUP BY event_type")
def audit_event_types(spark, d):
    """The kinds of events that reviews write, and whether a log may hold them."""
    return review.events(judged_items(spark, d)).groupBy("event_type").agg(F.count(F.lit(1)).alias("events")).withColumn("known", audit.known_type(F.col("event_type")))


# ---- runs


@query("SELECT run_id, upper(trim(mode)) AS mode, status, coalesce(records_in, 0) AS records_in, coalesce(auto_links, 0) AS auto_links, epoch_us(started_at) AS started_us FROM runs QUALIFY row_number() OVER (PARTITION BY run_id ORDER BY started_at DESC) = 1")
def runs_latest(spark, d):
    last = review.latest(table(spark, d, "runs"), "run_id", ["started_at"])
    return last.select("run_id", F.upper(F.trim("mode")).alias("mode"), "status", F.coalesce("records_in", F.lit(0)).alias("records_in"), F.coalesce("auto_links", F.lit(0)).alias("auto_links"), F.unix_micros("started_at").alias("started_us")).orderBy(F.desc("started_us"))


@query("WITH x AS (SELECT max(started_at) AS t FROM runs), days AS (SELECT CAST(unnest(generate_series(CAST(t AS DATE) - INTERVAL 364 DAY, CAST(t AS DATE), INTERVAL 1 DAY)) AS DATE) AS day FROM (SELECT CAST(timezone('UTC', t) AS DATE) AS t FROM x)) SELECT strftime(day, '%Y-%m-%d') AS day, count(run_id) AS runs, CAST(coalesce(sum(records_in), 0) AS BIGINT) AS records, CAST(coalesce(sum(auto_links + review_items), 0) AS BIGINT) AS duplicates FROM days LEFT JOIN runs ON CAST(timezone('UTC', started_at) AS DATE) = day GROUP BY day")
def daily_trends(spark, d):
    """A zero-filled calendar of the year up to the last run."""
    runs = table(spark, d, "runs").withColumn("day", F.to_date("started_at"))
    last = runs.agg(F.max("day").alias("t"))
    days = last.select(F.explode(F.sequence(F.date_sub("t", 364), "t")).alias("day"))
    found = runs.groupBy("day").agg(F.count("run_id").alias("runs"), F.sum("records_in").alias("records"), F.sum(F.col("auto_links") + F.col("review_items")).alias("duplicates"))
    zero = lambda c: F.coalesce(c, F.lit(0)).alias(c)
    return days.join(found, "day", "left").select(F.date_format("day", "yyyy-MM-dd").alias("day"), zero("runs"), zero("records"), zero("duplicates"))


@query("SELECT run_id, round(CASE WHEN records_in > 0 THEN 100.0 * records_normalized / records_in ELSE 0 END, 6) AS normalized_pct, round(CASE WHEN pairs_scored > 0 THEN 100.0 * auto_links / pairs_scored ELSE 0 END, 6) AS auto_pct, round(CASE WHEN pairs_scored > 0 THEN 100.0 * review_items / pairs_scored ELSE 0 END, 6) AS review_pct, round(CASE WHEN records_in > 0 THEN 100.0 * (records_in - records_normalized) / records_in ELSE 0 END, 6) AS loss_pct FROM runs")
def run_metrics(spark, d):
    share = lambda a, b: r6(F.when(F.col(b) > 0, F.try_divide(100.0 * a, F.col(b))).otherwise(0.0))
    c = F.col
    return table(spark, d, "runs").select("run_id", share(c("records_normalized"), "records_in").alias("normalized_pct"), share(c("auto_links"), "pairs_scored").alias("auto_pct"), share(c("review_items"), "pairs_scored").alias("review_pct"), share(c("records_in") - c("records_normalized"), "records_in").alias("loss_pct"))


@query("SELECT CAST(sum(records_in) AS BIGINT) AS total_records, CAST(sum(auto_links + review_items) AS BIGINT) AS duplicates, round(100.0 * sum(auto_links + review_items) / sum(records_in), 6) AS duplicate_pct, round(100.0 * sum(auto_links) / sum(auto_links + review_items), 6) AS auto_link_pct, round(avg(nullif(epoch(ended_at) - epoch(started_at), 0)), 3) AS avg_seconds, (SELECT epoch_us(max(started_at)) FROM runs) AS last_run_us FROM runs WHERE status = 'COMPLETED'")
def dashboard_kpis(spark, d):
    runs = table(spark, d, "runs")
    both = F.col("auto_links") + F.col("review_items")
    seconds = F.nullif(F.unix_micros("ended_at") / 1e6 - F.unix_micros("started_at") / 1e6, F.lit(0.0))
    done = runs.where("status = 'COMPLETED'").agg(F.sum("records_in").alias("total_records"), F.sum(both).alias("duplicates"), F.sum("auto_links").alias("a"), F.round(F.avg(seconds), 3).alias("avg_seconds"))
    last = runs.agg(F.unix_micros(F.max("started_at")).alias("last_run_us"))
    return done.crossJoin(last).select("total_records", "duplicates", r6(F.try_divide(100.0 * F.col("duplicates"), "total_records")).alias("duplicate_pct"), r6(F.try_divide(100.0 * F.col("a"), "duplicates")).alias("auto_link_pct"), "avg_seconds", "last_run_us")


# ---- memberships


@query("SELECT DISTINCT cluster_id, customer_key FROM clusters WHERE valid_to IS NULL")
def current_members(spark, d):
    return table(spark, d, "clusters").where("valid_to is null").select("cluster_id", "customer_key").distinct()


@query("SELECT cluster_id, count(DISTINCT customer_key) AS size FROM clusters WHERE valid_to IS NULL GROUP BY cluster_id HAVING count(DISTINCT customer_key) >= 2")
def clusters_min_size(spark, d):
    return current_members(spark, d).groupBy("cluster_id").agg(F.count(F.lit(1)).alias("size")).where("size >= 2")


@query("SELECT customer_key, customer_key AS cluster_id FROM customers_norm WHERE customer_key NOT IN (SELECT customer_key FROM clusters WHERE valid_to IS NULL)")
def singleton_synthesis(spark, d):
    """Records in no current cluster, each a cluster of its own."""
    return table(spark, d, "customers_norm").join(current_members(spark, d), "customer_key", "left_anti").select("customer_key", F.col("customer_key").alias("cluster_id"))


_GOLD = "g AS (SELECT cluster_id, c.run_id, max(name_norm) AS name, count(*) AS members, min(r.started_at) AS \"at\" FROM (SELECT DISTINCT cluster_id, customer_key FROM clusters WHERE valid_to IS NULL) k JOIN customers_norm c USING (customer_key) JOIN runs r ON r.run_id = c.run_id GROUP BY 1, 2)"


def _golden_history(spark: SparkSession, d: str) -> DataFrame:
    """One golden state per cluster and run that delivered a member."""
    runs = table(spark, d, "runs").select("run_id", "started_at")
    both = current_members(spark, d).join(table(spark, d, "customers_norm").select("customer_key", "run_id", "name_norm"), "customer_key").join(runs, "run_id")
    return both.groupBy("cluster_id", "run_id").agg(F.max("name_norm").alias("name"), F.count(F.lit(1)).alias("members"), F.min("started_at").alias("at"))


@query(f"WITH {_GOLD} SELECT cluster_id, run_id, name, members, row_number() OVER (PARTITION BY cluster_id ORDER BY \"at\", run_id) AS version FROM g")
def golden_versions(spark, d):
    version = F.row_number().over(W.partitionBy("cluster_id").orderBy("at", "run_id"))
    return _golden_history(spark, d).withColumn("version", version).drop("at")


@query(f"WITH {_GOLD} SELECT cluster_id, run_id, name, members FROM g QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY \"at\" DESC, run_id DESC) = 1")
def golden_latest(spark, d):
    return review.latest(_golden_history(spark, d), "cluster_id", ["at", "run_id"]).select("cluster_id", "run_id", "name", "members")


_PROPS = ["CUSCOD", "CUSNMF", "CUSNML", "CUSDOB", "MOBLNO", "TELENO", "MAILID", "ADDRS1", "ADDRS2", "ADDRS3", "ADDRS4", "CITYNM", "NATLID", "TIMSTAMP", "COUNTRY", "POSTCODE", "GENDER", "BRANCH", "ACC_TYPE", "BALANCE", "STATUS"]


@query(f"SELECT ingest_seq, CASE WHEN contains(concat_ws(' ', {', '.join(_PROPS)}), 'SUSP') THEN 'High' WHEN contains(concat_ws(' ', {', '.join(_PROPS)}), 'INACT') THEN 'Medium' ELSE 'Low' END AS risk FROM challenging_er_200")
def risk_level(spark, d):
    """Risk by words that stand in any property of a record."""
    return table(spark, d, "challenging_er_200").select("ingest_seq", graph.risk(*_PROPS).alias("risk"))


# ---- audit


def _events(spark: SparkSession, d: str) -> DataFrame:
    """The event stream as one audit log per user."""
    return table(spark, d, "events").select(F.col("user_id").alias("log"), F.col("event_id").alias("seq"), "event_type", F.coalesce("props", F.lit("{}")).alias("payload"), audit.iso(F.col("ts")).alias("at"))


_EV = "e AS (SELECT user_id AS log, event_id AS seq, event_type, coalesce(props, '{}') AS payload, regexp_replace(strftime(ts, '%Y-%m-%dT%H:%M:%S.%f'), '\\.000000$', '') AS \"at\", row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS k FROM events)"


@query(f"WITH RECURSIVE {_EV}, c AS (SELECT log, seq, k, repeat('0', 64) AS prev_hash, sha256(concat_ws('|', repeat('0', 64), event_type, payload, \"at\")) AS this_hash FROM e WHERE k = 1 UNION ALL SELECT e.log, e.seq, e.k, c.this_hash, sha256(concat_ws('|', c.this_hash, e.event_type, e.payload, e.\"at\")) FROM c JOIN e ON e.log = c.log AND e.k = c.k + 1) SELECT log, seq, prev_hash, this_hash FROM c")
def audit_chain(spark, d):
    return audit.chain(_events(spark, d)).select("log", "seq", "prev_hash", "this_hash")


@query(f"WITH {_EV} SELECT log, count(*) AS events, log % 7 <> 0 OR count(*) < 2 AS valid, CASE WHEN log % 7 = 0 AND count(*) >= 2 THEN 1 END AS first_bad FROM e GROUP BY log")
def audit_verify(spark, d):
    """Chains of which every seventh has its second payload altered."""
    c = audit.chain(_events(spark, d))
    k = F.row_number().over(W.partitionBy("log").orderBy("seq"))
    forged = c.withColumn("payload", F.when((F.col("log") % 7 == 0) & (k == 2), F.concat("payload", F.lit("!"))).otherwise(F.col("payload")))
    return audit.verify(forged)


@query(f"WITH {_EV} SELECT event_type, count(*) AS events, min(\"at\") AS first_at, max(\"at\") AS last_at, true AS chain_valid FROM e GROUP BY event_type")
def audit_event_counts(spark, d):
    """The compliance report: counts and times per kind of event, and whether the chains are intact."""
    return audit.compliance(audit.chain(_events(spark, d)))


@query(f"WITH {_EV} SELECT seq, event_type, left(sha256(payload), 16) || '...' AS payload_hash FROM e WHERE event_type = (SELECT min(event_type) FROM e) ORDER BY seq LIMIT 100")
def audit_list(spark, d):
    e = _events(spark, d)
    first = e.agg(F.min("event_type").alias("event_type"))
    return e.join(F.broadcast(first), "event_type").orderBy("seq").limit(100).select("seq", "event_type", F.concat(F.left(F.sha2("payload", 256), F.lit(16)), F.lit("...")).alias("payload_hash"))


@query("SELECT doc_id, json_extract_string(text, '$.event') AS event, json_extract_string(text, '$.actor') AS actor FROM documents WHERE source = 'audit_log' AND json_valid(text) AND json_extract_string(text, '$.actor') = 'system'")
def audit_pair_trail(spark, d):
    """Events whose payload names one actor; texts that are no JSON have none."""
    docs = table(spark, d, "documents").where("source = 'audit_log' and try_parse_json(text) is not null")
    return docs.select("doc_id", F.get_json_object("text", "$.event").alias("event"), F.get_json_object("text", "$.actor").alias("actor")).where("actor = 'system'")


@query(f"WITH {_EV} SELECT log, seq, event_type, \"at\" FROM e WHERE log = (SELECT min(log) FROM e) ORDER BY seq LIMIT 10000")
def audit_export(spark, d):
    """The events of one log, written as JSON and read back."""
    e = _events(spark, d)
    out = Scratch(spark, "export").path()
    audit.export(e, out, log=e.agg(F.min("log")).first()[0])
    return spark.read.schema("log bigint, seq bigint, event_type string, at string").json(out)


@query(f"WITH {_EV} SELECT log, seq, sha256(repeat('0', 64) || event_type || payload || \"at\") AS this_hash FROM e WHERE k = 1")
def audit_database_hash(spark, d):
    """The first hash of each log as the database function makes it."""
    e = _events(spark, d)
    first = e.groupBy("log").agg(F.min_by(F.struct(*e.columns), "seq").alias("r")).select("r.*")
    return first.select("log", "seq", audit.database_hash(F.lit(audit.GENESIS), F.col("event_type"), F.col("payload"), F.col("at")).alias("this_hash"))
