"""Queries over a resolution run of the customer records, one per operator."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F
from pyspark.sql import Window as W

from kinmesh.config import BlockingConfig, ScoringConfig
from kinmesh.functions import text as t
from kinmesh.functions.similarity import jaro_winkler
from kinmesh.operators import blocking, components, explanations, graph, lifecycle, referee, review, scoring
from kinmesh.plans import sql
from kinmesh.plans.pipeline import Run, customer_run, planned_mode
from kinmesh.plans.registry import query
from kinmesh.sources import staging
from kinmesh.storage import Scratch, table

CFG = ScoringConfig()


def r6(c):
    return F.round(c, 6)


def csv_of(c):
    return F.array_join(F.array_sort(c), ",")


# ---- sources and normalizers


@query(sql.chain("src", "SELECT source_system, count(*) AS records, count(phone) AS phones, min(source_customer_id) AS first_id FROM src GROUP BY source_system"))
def src_scan(spark, d):
    raw = staging.records_from_customer(table(spark, d, "customer"))
    return raw.groupBy("source_system").agg(F.count(F.lit(1)).alias("records"), F.count("phone").alias("phones"), F.min("source_customer_id").alias("first_id"))


def _field(name, raw, norm, expr):
    """Registers the query of one normalizer."""

    def f(spark, d):
        src = staging.records_from_customer(table(spark, d, "customer"))
        return src.select("ingest_seq", expr().alias("value"))

    f.__name__ = name
    query(sql.chain("norm", f"SELECT ingest_seq, {norm} AS value FROM norm"))(f)


_field("normalize_phone", "phone", "phone_norm", lambda: t.normalize_phone(t.some(F.col("phone"))))
_field("normalize_email", "email", "email_norm", lambda: t.normalize_email(t.some(F.col("email"))))
_field("normalize_dob", "dob", "dob_norm", lambda: t.normalize_dob(t.some(F.col("dob"))))
_field("normalize_address", "address", "address_norm", lambda: t.normalize_address(t.some(F.col("address"))))
_field("normalize_natid", "natid", "natid_norm", lambda: t.normalize_natid(t.some(F.col("natid"))))
_field("email_domain", "email", "split_part(email_norm, '@', -1)", lambda: t.email_domain(t.normalize_email(t.some(F.col("email")))))


@query("SELECT ingest_seq, " + sql.name("concat_ws(' ', CUSNMF, CUSNML)") + " AS value FROM challenging_er_200")
def normalize_name(spark, d):
    return table(spark, d, "challenging_er_200").select("ingest_seq", t.normalize_name(F.concat_ws(" ", "CUSNMF", "CUSNML")).alias("value"))


@query("SELECT ingest_seq, " + sql.FULL_NAME.replace("first_name", "CUSNMF").replace("last_name", "CUSNML") + " AS name FROM challenging_er_200")
def name_assemble(spark, d):
    null = F.lit(None).cast("string")
    return table(spark, d, "challenging_er_200").select("ingest_seq", staging.name_of(F.col("CUSNMF"), F.col("CUSNML"), null, null).alias("name"))


@query("SELECT ingest_seq, nullif(concat_ws(' ', " + ", ".join(sql.some(f"ADDRS{i}") for i in (1, 2, 3, 4)) + "), '') AS address FROM challenging_er_200")
def address_concat(spark, d):
    parts = [t.some(F.col(f"ADDRS{i}")) for i in (1, 2, 3, 4)]
    return table(spark, d, "challenging_er_200").select("ingest_seq", F.nullif(F.concat_ws(" ", *parts), F.lit("")).alias("address"))


_FULL = sql.FULL_NAME.replace("first_name", "CUSNMF").replace("last_name", "CUSNML")
_PHONE = f"coalesce({sql.some('MOBLNO')}, {sql.some('TELENO')})"
_ADDRESS = "nullif(concat_ws(' ', " + ", ".join(sql.some(f"ADDRS{i}") for i in (1, 2, 3, 4)) + "), '')"
_RAW = ["CUSCOD", "CUSNMF", "CUSNML", "CUSDOB", "MOBLNO", "TELENO", "MAILID", "ADDRS1", "ADDRS2", "ADDRS3", "ADDRS4", "CITYNM", "NATLID", "TIMSTAMP", "COUNTRY", "POSTCODE", "GENDER", "BRANCH", "ACC_TYPE", "BALANCE", "STATUS"]
_LAST = ", ".join(f"CASE WHEN length({x}) > 2 THEN {x} END" for x in (sql.some("CUSDOB"), _ADDRESS, *(sql.some(c) for c in ("CITYNM", *_RAW))))
_FALLBACK = f"coalesce({_FULL}, split_part({sql.some('MAILID')}, '@', 1), 'Phone: ' || {_PHONE}, 'ID: ' || {sql.some('CUSCOD')}, 'NID: ' || {sql.some('NATLID')}, {_LAST})"


@query(f"SELECT ingest_seq, {_FALLBACK} AS name FROM challenging_er_200 WHERE {_FALLBACK} IS NOT NULL")
def name_fallback(spark, d):
    return staging.mapped(table(spark, d, "challenging_er_200")).select("ingest_seq", "name")


@query(f"SELECT ingest_seq, coalesce(split_part({sql.some('MAILID')}, '@', 1), 'Phone: ' || {_PHONE}, 'ID: ' || {sql.some('CUSCOD')}, 'NID: ' || {sql.some('NATLID')}, {_LAST.replace(sql.some('CUSNMF'), 'NULL::VARCHAR').replace(sql.some('CUSNML'), 'NULL::VARCHAR')}) AS name FROM challenging_er_200")
def name_stand_ins(spark, d):
    """What stands for the name where the name columns are empty."""
    null = F.lit(None).cast("string")
    return staging.mapped(table(spark, d, "challenging_er_200").withColumns({"CUSNMF": null, "CUSNML": null})).select("ingest_seq", "name")


_HDR = {"CUSCOD": "source_customer_id", "CUSNMF": "first_name", "CUSNML": "last_name", "CUSDOB": "dob", "MOBLNO": "phone", "TELENO": "phone", "MAILID": "email", "ADDRS1": "address", "ADDRS2": "address", "ADDRS3": "address", "ADDRS4": "address", "CITYNM": "city", "NATLID": "natid", "TIMSTAMP": "timestamp"}


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v}')" for k, v in _HDR.items()) + ", ('ingest_seq', 'ingest_seq'), ('COUNTRY', 'country'), ('POSTCODE', 'postcode'), ('GENDER', 'gender'), ('BRANCH', 'branch'), ('ACC_TYPE', 'acc_type'), ('BALANCE', 'balance'), ('STATUS', 'status')) v(header, target)")
def hdr_map(spark, d):
    return spark.createDataFrame(list(staging.route(table(spark, d, "challenging_er_200").columns).items()), "header string, target string")


@query(f"SELECT ingest_seq, {sql.name(_FALLBACK)} AS name_norm, {sql.phone(_PHONE)} AS phone_norm, {sql.email(sql.some('MAILID'))} AS email_norm, {sql.natid(sql.some('NATLID'))} AS natid_norm, {sql.name(sql.some('CITYNM'))} AS city_norm, {sql.some('GENDER')} AS gender, {sql.some('TIMSTAMP')} AS stamp, {sql.some('MOBLNO')} AS mobile, {sql.some('TELENO')} AS landline FROM challenging_er_200 WHERE {_FALLBACK} IS NOT NULL")
def staging_normalized(spark, d):
    """The staging rows through header routing, name fallback and normalization, with their metadata."""
    from kinmesh.operators.normalize import normalize

    norm = normalize(staging.mapped(table(spark, d, "challenging_er_200")))
    return norm.select("ingest_seq", "name_norm", "phone_norm", "email_norm", "natid_norm", "city_norm", "metadata.gender", F.col("metadata.timestamp").alias("stamp"), "metadata.mobile", "metadata.landline")


@query("SELECT count(*) AS new_records, count(*) + (SELECT count(*) FROM customers_norm) AS total_records FROM challenging_er_200")
def staging_stats(spark, d):
    return staging.stats(table(spark, d, "challenging_er_200"), table(spark, d, "customers_norm"))


@query(sql.chain("norm", "SELECT customer_key, ingest_seq, source_customer_id, source_system, name_norm, phone_norm, email_norm, dob_norm, address_norm, city_norm, natid_norm, record_hash FROM norm"))
def normalize_record(spark, d):
    return customer_run(spark, d).norm.drop("true_ident", "metadata")


@query(sql.chain("norm", "SELECT record_hash, count(*) AS records FROM norm GROUP BY record_hash"))
def record_hash(spark, d):
    return customer_run(spark, d).norm.groupBy("record_hash").agg(F.count(F.lit(1)).alias("records"))


@query("SELECT ingest_seq, " + sql.some("MAILID") + " IS NULL AS mail_empty, " + sql.some("ADDRS2") + " IS NULL AS addr_empty FROM challenging_er_200")
def empty_predicate(spark, d):
    return table(spark, d, "challenging_er_200").select("ingest_seq", t.is_empty(F.col("MAILID")).alias("mail_empty"), t.is_empty(F.col("ADDRS2")).alias("addr_empty"))


# ---- blocking


@query(sql.chain("norm", f"SELECT ingest_seq, {sql.soundex('name_norm')} AS full_code, {sql.soundex(sql._TOKENS + '[1]')} AS first_code FROM norm"))
def soundex_keys(spark, d):
    tokens = t.tokens(F.col("name_norm"))
    return customer_run(spark, d).norm.select("ingest_seq", t.soundex(F.col("name_norm")).alias("full_code"), t.soundex(F.get(tokens, 0)).alias("first_code"))


@query(sql.chain("norm", f"SELECT ingest_seq, unnest({sql._TOKENS}[1:5]) AS token FROM norm"))
def name_tokens(spark, d):
    return customer_run(spark, d).norm.select("ingest_seq", F.explode(F.slice(t.tokens(F.col("name_norm")), 1, 5)).alias("token"))


@query(sql.chain("keys", "SELECT customer_key, method, block_key FROM keys"))
def blocking_keys(spark, d):
    return customer_run(spark, d).keys


@query()
def lsh_keys(spark, d):
    cfg = replace(BlockingConfig(), methods=("lsh_minhash",))
    return blocking.blocking_keys(customer_run(spark, d).norm, cfg).select("customer_key", "block_key")


@query(sql.chain("keys", "SELECT method, block_key, n FROM key_stats"))
def block_sizes(spark, d):
    return blocking.key_stats(customer_run(spark, d).keys)


@query(sql.chain("keys", "SELECT method, block_key, n FROM key_stats, total WHERE 100.0 * n / total > 5.0"))
def suppressed_keys(spark, d):
    run = customer_run(spark, d)
    return blocking.suppressed(blocking.key_stats(run.keys), run.norm, run.blocking)


@query(sql.chain("keys", "SELECT method, count(DISTINCT block_key) AS blocks, count(*) AS memberships FROM kept GROUP BY method"))
def block_guard(spark, d):
    run = customer_run(spark, d)
    return blocking.kept(run.keys, run.norm, run.blocking).groupBy("method").agg(F.count_distinct("block_key").alias("blocks"), F.count(F.lit(1)).alias("memberships"))


@query(sql.chain("keys", "SELECT (SELECT total FROM total) AS total_records, count(DISTINCT block_key) AS distinct_keys, round(count(*) / (SELECT total FROM total), 6) AS avg_keys FROM keys"))
def blocking_stats(spark, d):
    run = customer_run(spark, d)
    return blocking.stats(run.keys, run.norm)


@query(sql.chain("keys", "SELECT method, count(*) AS blocks, sum(n) AS memberships, max(n) AS largest, sum(n * (n - 1) // 2) AS possible_pairs FROM key_stats GROUP BY method"))
def blocking_method_breakdown(spark, d):
    n = F.col("n")
    return blocking.key_stats(customer_run(spark, d).keys).groupBy("method").agg(F.count(F.lit(1)).alias("blocks"), F.sum(n).alias("memberships"), F.max(n).alias("largest"), F.sum((n * (n - 1) / 2).cast("bigint")).alias("possible_pairs"))


@query(sql.chain("pairs", "SELECT a_key, b_key, reasons, block_key_sample FROM pairs"))
def candidate_pairs(spark, d):
    return customer_run(spark, d).pairs.select("a_key", "b_key", csv_of("blocking_reasons").alias("reasons"), "block_key_sample")


@query(sql.chain("pairs", "SELECT unnest(string_split(reasons, ',')) AS method, count(*) AS pairs FROM pairs GROUP BY 1"))
def candidate_stats(spark, d):
    return customer_run(spark, d).pairs.select(F.explode("blocking_reasons").alias("method")).groupBy("method").agg(F.count(F.lit(1)).alias("pairs"))


@query(sql.chain("pairs", "SELECT round(100.0 * (m - c) / m, 6) AS reduction_pct, c AS candidates FROM (SELECT (SELECT count(*) FROM pairs) AS c, (SELECT count(*) * (count(*) - 1) / 2 FROM norm) AS m)"))
def reduction_ratio(spark, d):
    run = customer_run(spark, d)
    n, c = run.norm.agg(F.count(F.lit(1)).alias("n")), run.pairs.agg(F.count(F.lit(1)).alias("candidates"))
    most = F.col("n") * (F.col("n") - 1) / 2
    return n.crossJoin(c).select(r6(F.try_divide(100.0 * (most - F.col("candidates")), most)).alias("reduction_pct"), "candidates")


@query(sql.chain("pairs", "SELECT a_key, b_key FROM pairs ORDER BY a_key, b_key LIMIT 50 OFFSET 50"))
def candidates_page(spark, d):
    return customer_run(spark, d).pairs.select("a_key", "b_key").orderBy("a_key", "b_key").offset(50).limit(50)


@query(sql.chain("norm", "few AS (SELECT customer_key FROM norm ORDER BY ingest_seq LIMIT 500) SELECT a.customer_key AS a_key, b.customer_key AS b_key FROM few a JOIN few b ON a.customer_key < b.customer_key").replace(")\nfew AS", "),\nfew AS"))
def preview_all_pairs(spark, d):
    return blocking.all_pairs(customer_run(spark, d).norm).select("a_key", "b_key")


# ---- comparison and decision


@query(sql.chain("pairs", "SELECT p.pair_id, round(coalesce(jaro_winkler_similarity(a.name_norm, b.name_norm), 0), 6) AS name_sim FROM pairs p JOIN norm a ON a.customer_key = a_key JOIN norm b ON b.customer_key = b_key"))
def jaro_winkler_names(spark, d):
    run = customer_run(spark, d)
    return scoring.with_records(run.pairs, run.norm).select("pair_id", r6(jaro_winkler("a_name_norm", "b_name_norm")).alias("name_sim"))


@query(sql.chain("decided", "SELECT pair_id, phone_kind, email_kind, dob_kind, natid_kind FROM decided"))
def evidence_exact(spark, d):
    return customer_run(spark, d).decided.select("pair_id", "phone_kind", "email_kind", "dob_kind", "natid_kind")


@query(sql.chain("decided", "SELECT pair_id, name_kind, round(name_sim, 6) AS name_sim, address_kind, round(address_sim, 6) AS address_sim FROM decided"))
def evidence_fuzzy(spark, d):
    return customer_run(spark, d).decided.select("pair_id", "name_kind", r6("name_sim").alias("name_sim"), "address_kind", r6("address_sim").alias("address_sim"))


@query(sql.chain("decided", "SELECT pair_id, round(s3, 8) AS score FROM decided"))
def score_rules(spark, d):
    return customer_run(spark, d).decided.select("pair_id", F.round(scoring.rules(CFG), 8).alias("score"))


@query(sql.chain("decided", "SELECT pair_id, round(score, 6) AS score FROM decided"))
def score_pairs(spark, d):
    return customer_run(spark, d).decided.select("pair_id", r6("score").alias("score"))


@query(sql.chain("decided", "SELECT pair_id, conflicts FROM decided WHERE conflicts <> ''"))
def hard_conflicts(spark, d):
    return customer_run(spark, d).decided.where(F.size("hard_conflicts") > 0).select("pair_id", F.array_join("hard_conflicts", ",").alias("conflicts"))


@query(sql.chain("decided", "SELECT pair_id, signals FROM decided"))
def signals(spark, d):
    return customer_run(spark, d).decided.select("pair_id", F.array_join("signals_hit", ",").alias("signals"))


@query(sql.chain("decided", "SELECT pair_id, decision FROM decided"))
def decisions(spark, d):
    return customer_run(spark, d).decided.select("pair_id", "decision")


@query(sql.chain("decided", "SELECT decision, count(*) AS pairs FROM decided GROUP BY decision"))
def decision_counts(spark, d):
    return customer_run(spark, d).decided.groupBy("decision").agg(F.count(F.lit(1)).alias("pairs"))


@query(sql.chain("decided", "SELECT pair_id, CASE WHEN conflicts <> '' THEN 'conflict' WHEN same_hash THEN 'hash' ELSE name_kind END AS kind, printf('%.1f%%', round(100 * score, 1)) AS score_text FROM decided"))
def evidence_text(spark, d):
    kind = F.when(F.size("hard_conflicts") > 0, "conflict").when(F.col("same_hash"), "hash").otherwise(F.col("name_kind"))
    return customer_run(spark, d).decided.select("pair_id", kind.alias("kind"), F.format_string("%.1f%%", F.round(100 * F.col("score"), 1)).alias("score_text"))


def _evidence_sql() -> str:
    """One SELECT per field with the seven keys of its evidence."""
    parts = []
    for f, w in sql.WEIGHTS.items():
        fuzzy = f in sql.FUZZY
        sim = f"{f}_sim" if fuzzy else f"CASE WHEN {f}_kind = 'exact_match' THEN 1.0 ELSE 0.0 END"
        gain = f"CASE {f}_kind WHEN 'exact_match' THEN {w} WHEN 'fuzzy_match' THEN {w} * ({sim}) WHEN 'low_similarity' THEN 0.5 * {w} * ({sim}) WHEN 'mismatch' THEN {-0.3 * w if fuzzy else -0.5 * w} ELSE 0 END"
        share = f"' similarity (' || printf('%.1f%%', round(100 * ({sim}), 1)) || ') on {f}_norm'"
        said = f"CASE {f}_kind WHEN 'both_null' THEN 'Both values are null - no evidence' WHEN 'one_null' THEN 'One value is null ({f}_norm)' WHEN 'exact_match' THEN 'Exact match on {f}_norm' WHEN 'fuzzy_match' THEN 'High' || {share} WHEN 'low_similarity' THEN 'Moderate' || {share} ELSE " + (f"'Low' || {share}" if fuzzy else f"'Values differ for {f}_norm'") + " END"
        parts.append(f"SELECT pair_id, '{f}_norm' AS field, a.{f}_norm AS value_a, b.{f}_norm AS value_b, {f}_kind AS type, round({sim}, 6) AS similarity, round({gain}, 6) AS weight, {said} AS explanation FROM decided d JOIN norm a ON a.customer_key = a_key JOIN norm b ON b.customer_key = b_key WHERE NOT same_hash")
    parts.append("SELECT pair_id, 'record_hash', a.record_hash, b.record_hash, 'exact_match', 1.0, 1.0, 'Exact match on record_hash' FROM decided d JOIN norm a ON a.customer_key = a_key JOIN norm b ON b.customer_key = b_key WHERE same_hash")
    return " UNION ALL ".join(parts)


_KEYS = ["field", "value_a", "value_b", "type", "similarity", "weight", "explanation"]


@query(sql.chain("decided", _evidence_sql()))
def evidence_json(spark, d):
    """The evidence of every pair written as JSON and read again, one row per field."""
    written = customer_run(spark, d).decided.select("pair_id", F.to_json(scoring.evidence()).alias("evidence"))
    kinds = "array<struct<field:string,value_a:string,value_b:string,type:string,similarity:double,weight:double,explanation:string>>"
    return written.select("pair_id", F.explode(F.from_json("evidence", kinds)).alias("e")).select("pair_id", *[F.col(f"e.{k}").alias(k) for k in _KEYS])


@query(sql.chain("decided", "SELECT pair_id, round(score, 6) AS score, decision FROM decided ORDER BY round(score, 9) DESC, pair_id LIMIT 100"))
def decisions_list(spark, d):
    return customer_run(spark, d).decided.orderBy(F.round("score", 9).desc(), "pair_id").limit(100).select("pair_id", r6("score").alias("score"), "decision")


_SIDES = ["name", "phone", "email", "dob", "address"]


@query(sql.chain("decided", "SELECT p.pair_id, round(score, 6) AS score, decision, " + ", ".join(f"{x}.{f}_norm AS {x}_{f}" for f in _SIDES for x in "ab") + " FROM decided p JOIN norm a ON a.customer_key = a_key JOIN norm b ON b.customer_key = b_key"))
def match_detail(spark, d):
    return customer_run(spark, d).decided.select("pair_id", r6("score").alias("score"), "decision", *[F.col(f"{x}_{f}_norm").alias(f"{x}_{f}") for f in _SIDES for x in "ab"])


@query(sql.chain("pairs", "SELECT pair_id, split_part(pair_id, ':', 1) AS a_key, split_part(pair_id, ':', 2) AS b_key, a.name_norm AS a_name, b.name_norm AS b_name FROM (SELECT pair_id FROM pairs) p JOIN norm a ON a.customer_key = split_part(pair_id, ':', 1) JOIN norm b ON b.customer_key = split_part(pair_id, ':', 2)"))
def candidate_detail(spark, d):
    run = customer_run(spark, d)
    parts = F.split("pair_id", ":")
    side = lambda p: run.norm.select(F.col("customer_key").alias(f"{p}_key"), F.col("name_norm").alias(f"{p}_name"))
    return run.pairs.select("pair_id", parts[0].alias("a_key"), parts[1].alias("b_key")).join(side("a"), "a_key").join(side("b"), "b_key")


@query(sql.chain("decided", "ends AS (SELECT pair_id, a_key AS k FROM decided UNION ALL SELECT pair_id, b_key FROM decided) SELECT x.pair_id, count(DISTINCT y.pair_id) AS related FROM ends x JOIN ends y ON x.k = y.k AND x.pair_id <> y.pair_id GROUP BY x.pair_id").replace(")\nends AS", "),\nends AS"))
def related_matches(spark, d):
    """How many pairs share an end with each pair. Two pairs share one end at most, so the degrees of the ends say it."""
    decided = customer_run(spark, d).decided.select("pair_id", "a_key", "b_key")
    degree = decided.select(F.explode(F.array("a_key", "b_key")).alias("k")).groupBy("k").agg(F.count(F.lit(1)).alias("n"))
    side = lambda p: degree.select(F.col("k").alias(f"{p}_key"), F.col("n").alias(p))
    both = decided.join(side("a"), "a_key").join(side("b"), "b_key")
    return both.select("pair_id", (F.col("a") + F.col("b") - 2).alias("related")).where("related > 0")


# ---- referee and planner


@query(sql.chain("decided", "SELECT pair_id FROM decided WHERE round(score, 9) BETWEEN 0.45 AND 0.85 AND conflicts = ''"))
def referee_gate(spark, d):
    return customer_run(spark, d).decided.where(referee.in_gray_zone(F.round("score", 9), F.col("hard_conflicts"), CFG)).select("pair_id")


@query(sql.chain("decided", "SELECT pair_id, CASE WHEN conflicts <> '' THEN 'NO_MATCH' WHEN round(score, 9) > 0.85 THEN 'MATCH' ELSE 'NO_MATCH' END AS judgement, CASE WHEN conflicts <> '' THEN 'Automated Rejection: Critical conflicts detected (' || replace(conflicts, ',', ', ') || ').' WHEN round(score, 9) > 0.85 THEN 'Automated Confirmation: Match score (' || printf('%.2f', round(round(score, 9), 2)) || ') is very high and exceeds the verification threshold.' ELSE 'Automated Rejection: Match score (' || printf('%.2f', round(round(score, 9), 2)) || ') is too low to be considered a potential match.' END AS explanation FROM decided WHERE conflicts <> '' OR round(score, 9) > 0.85 OR round(score, 9) < 0.45"))
def referee_auto(spark, d):
    s, c = F.round("score", 9), F.col("hard_conflicts")
    return customer_run(spark, d).decided.select("pair_id", referee.judgement(s, c, CFG).alias("judgement"), referee.explanation(s, c, CFG).alias("explanation")).where("judgement is not null")


@query("SELECT doc_id, CASE WHEN doc_id % 3 = 0 THEN 'NO_MATCH' WHEN doc_id % 3 = 1 THEN 'MATCH' ELSE 'UNSURE' END AS judgement, 'note ' || source AS analysis FROM documents")
def referee_parse(spark, d):
    """Written judgements in three shapes, made from the documents' sources."""
    head = F.when(F.col("doc_id") % 3 == 0, "Judgement: no match\n").when(F.col("doc_id") % 3 == 1, "JUDGEMENT: MATCH\n").otherwise("judgement: perhaps\n")
    docs = table(spark, d, "documents").select("doc_id", F.concat(head, F.lit("ANALYSIS: note "), "source").alias("said"))
    return docs.select("doc_id", *[c.alias(n) for n, c in referee.parse(F.col("said")).items()])


def _template_sql() -> str:
    line = lambda f: f"'- **{f}_norm**: ' || {f}_kind || ' (' || printf('%.0f%%', round(100 * round(" + (f"{f}_sim" if f in sql.FUZZY else f"CASE WHEN {f}_kind = 'exact_match' THEN 1.0 ELSE 0.0 END") + ", 6), 0)) || ')' || chr(10)"
    lines = f"CASE WHEN same_hash THEN '- **record_hash**: exact_match (100%)' || chr(10) ELSE {' || '.join(line(f) for f in sql.WEIGHTS)} END"
    return f"SELECT pair_id, '## Match Analysis (Template Fallback)' || chr(10) || '**Match Score:** ' || printf('%.1f%%', round(100 * score, 1)) || chr(10) || chr(10) || '### Evidence:' || chr(10) || {lines} || chr(10) || '### Guidance:' || chr(10) || 'Please review the fields manually.' AS text FROM decided"


@query(sql.chain("decided", _template_sql()))
def referee_template(spark, d):
    return customer_run(spark, d).decided.select("pair_id", referee.template(F.col("score"), scoring.evidence()).alias("text"))


@query(sql.chain("decided", "SELECT pair_id, CASE WHEN pair_id < '8' THEN 'UNSURE' WHEN conflicts <> '' THEN 'NO_MATCH' WHEN round(score, 9) > 0.85 THEN 'MATCH' WHEN round(score, 9) < 0.45 THEN 'NO_MATCH' ELSE 'UNSURE' END AS judgement, CASE WHEN pair_id < '8' THEN 'written model' ELSE 'rules' END AS model FROM decided"))
def explain_view(spark, d):
    """Explanations kept as JSON lines (here of the pairs before '8', written twice) go before those made by rule."""
    pairs = customer_run(spark, d).streamed()
    path = Scratch(spark, "explanations").path()
    some = explanations.made(pairs.where("pair_id < '8'"), CFG)
    explanations.append(some.withColumn("model_name", F.lit("first model")), path)
    explanations.append(some.withColumns({"model_name": F.lit("written model"), "judgement": F.lit(None).cast("string")}), path)
    return explanations.view(pairs, explanations.read(spark, path), CFG).select("pair_id", "judgement", "model")


@query("SELECT r.run_id, CASE WHEN coalesce(records_in, 0) * 1.0 / t < 0.2 THEN 'DELTA' ELSE 'FULL' END AS mode FROM runs r, (SELECT sum(records_in) AS t FROM runs)")
def planner_decision(spark, d):
    """The mode the planner gives each run, its records being new beside those of all runs."""
    runs = table(spark, d, "runs")
    total = runs.agg(F.sum("records_in").alias("t"))
    return runs.crossJoin(F.broadcast(total)).select("run_id", planned_mode(F.coalesce("records_in", F.lit(0)), F.col("t")).alias("mode"))


@query("SELECT run_id, coalesce(status IN ('FAILED', 'CANCELLED'), false) AS can_retry, coalesce(status = 'RUNNING', false) AS can_cancel FROM runs")
def run_actions(spark, d):
    no = lambda c: F.coalesce(c, F.lit(False))
    return table(spark, d, "runs").select("run_id", no(lifecycle.can_retry(F.col("status"))).alias("can_retry"), no(lifecycle.can_cancel(F.col("status"))).alias("can_cancel"))


@query("SELECT run_id, CASE WHEN status = 'RUNNING' THEN 'COMPLETED' ELSE status END AS status, CASE WHEN status = 'RUNNING' THEN 7 ELSE coalesce(auto_links, 0) END AS auto_links, coalesce(records_in, 0) AS records_in FROM runs UNION ALL SELECT 'new-run', 'PENDING', 0, 0")
def runs_upsert(spark, d):
    """Running runs completed and one run added: what is there is replaced, what isn't is inserted."""
    runs = table(spark, d, "runs")
    done = runs.where("status = 'RUNNING'").withColumns({"status": F.lit("COMPLETED"), "auto_links": F.lit(7).cast("bigint")})
    new = runs.limit(0).unionByName(spark.createDataFrame([("new-run", "PENDING")], "run_id string, status string"), allowMissingColumns=True)
    return lifecycle.upsert(runs, done.unionByName(new)).select("run_id", "status", "auto_links", "records_in")


# ---- clusters and graph


@query(sql.chain("clusters", "SELECT customer_key, cluster_id FROM components"))
def connected_components(spark, d):
    return customer_run(spark, d).members


@query(sql.chain("clusters", "SELECT cluster_id, count(*) AS size, string_agg(customer_key, ',' ORDER BY customer_key) AS members FROM components GROUP BY cluster_id"))
def clusters(spark, d):
    return components.listed_members(customer_run(spark, d).members)


@query(sql.chain("clusters", "held AS (SELECT min(cluster_id) AS c FROM sizes WHERE size > 1) SELECT customer_key, name_norm, size FROM components JOIN norm USING (customer_key) JOIN sizes USING (cluster_id) WHERE cluster_id = (SELECT c FROM held)").replace(")\nheld AS", "),\nheld AS"))
def cluster_detail(spark, d):
    """The members of one cluster, every one a row."""
    run = customer_run(spark, d)
    sized = components.sizes(run.members)
    own = sized.where("size > 1").orderBy("cluster_id").limit(1)
    return run.members.join(F.broadcast(own), "cluster_id").join(run.norm.select("customer_key", "name_norm"), "customer_key").select("customer_key", "name_norm", "size")


_BOTH = "both_links AS (SELECT a_key AS x, b_key AS y FROM decided WHERE decision = 'AUTO_LINK' OR decision = 'REVIEW' AND round(score, 9) >= 0.8), two AS (SELECT x, y FROM both_links UNION SELECT y, x FROM both_links), seen(customer_key, label) AS (SELECT customer_key, customer_key FROM norm UNION SELECT l.y, r.label FROM seen r JOIN two l ON l.x = r.customer_key WHERE r.label < l.y)"


@query(sql.chain("decided", f"{_BOTH} SELECT customer_key, min(label) AS cluster_id FROM seen GROUP BY customer_key").replace(")\nboth_links AS", "),\nboth_links AS").replace("WITH ", "WITH RECURSIVE ", 1))
def clusters_with_approvals(spark, d):
    """Clusters of automatic links and approved reviews together."""
    run = customer_run(spark, d)
    waiting = review.enqueue(run.decided)
    s = F.round("score", 9)
    said = waiting.select("pair_id", F.when(s >= 0.8, review.APPROVED).otherwise(review.REJECTED).alias("decision"), F.lit("looked at").alias("reason"), F.lit("2024-01-01").cast("timestamp").alias("at"))
    approved = review.approved_links(review.apply(waiting, said))
    return components.clusters(run.norm, run.links.unionByName(approved))


@query(sql.chain("golden", "SELECT * FROM golden"))
def golden_records(spark, d):
    return customer_run(spark, d).golden


@query(sql.chain("clusters", "tied AS (SELECT a_key AS k FROM decided WHERE decision <> 'REJECT' UNION SELECT b_key FROM decided WHERE decision <> 'REJECT') SELECT customer_key, name_norm FROM norm WHERE customer_key NOT IN (SELECT k FROM tied)").replace(")\ntied AS", "),\ntied AS"))
def uniques(spark, d):
    run = customer_run(spark, d)
    linked = run.decided.where("decision != 'REJECT'").select(F.explode(F.array("a_key", "b_key")).alias("customer_key"))
    return run.norm.join(linked, "customer_key", "left_anti").select("customer_key", "name_norm").orderBy(F.asc_nulls_last("name_norm"), "customer_key")


@query(sql.chain("golden", "SELECT cluster_id, size, g.name_norm AS representative, size = 1 AS is_singleton FROM sizes JOIN golden g USING (cluster_id)"))
def result_clusters(spark, d):
    run = customer_run(spark, d)
    first = run.members.join(run.norm, "customer_key").groupBy("cluster_id").agg(F.min_by("name_norm", "ingest_seq").alias("first_name"))
    touched = run.members.join(run.norm.select("customer_key"), "customer_key", "left_semi").select("cluster_id").distinct()
    sized = components.sizes(run.members).join(touched, "cluster_id", "left_semi")
    both = sized.join(run.golden.select("cluster_id", "name_norm"), "cluster_id", "left").join(first, "cluster_id", "left")
    return both.select("cluster_id", "size", F.coalesce("name_norm", "first_name").alias("representative"), (F.col("size") == 1).alias("is_singleton"))


@query(sql.chain("clusters", "SELECT count(*) AS clusters, CAST(sum(size) AS BIGINT) AS members, round(avg(size), 6) AS avg_size, max(size) AS max_size, count(*) FILTER (WHERE size = 1) AS singletons, count(*) FILTER (WHERE size BETWEEN 2 AND 5) AS s2_5, count(*) FILTER (WHERE size BETWEEN 6 AND 10) AS s6_10, count(*) FILTER (WHERE size > 10) AS s10_up FROM sizes"))
def cluster_stats(spark, d):
    s = F.col("size")
    return components.sizes(customer_run(spark, d).members).agg(F.count(F.lit(1)).alias("clusters"), F.sum(s).alias("members"), r6(F.avg(s)).alias("avg_size"), F.max(s).alias("max_size"), F.count_if(s == 1).alias("singletons"), F.count_if(s.between(2, 5)).alias("s2_5"), F.count_if(s.between(6, 10)).alias("s6_10"), F.count_if(s > 10).alias("s10_up"))


@query(sql.chain("clusters", "SELECT CASE WHEN size >= 6 THEN '6+' ELSE CAST(size AS VARCHAR) END AS bucket, count(*) AS clusters FROM sizes GROUP BY 1"))
def cluster_size_dist(spark, d):
    bucket = F.when(F.col("size") >= 6, "6+").otherwise(F.col("size").cast("string"))
    return components.sizes(customer_run(spark, d).members).groupBy(bucket.alias("bucket")).agg(F.count(F.lit(1)).alias("clusters"))


@query(sql.chain("clusters", "SELECT cluster_id, size FROM sizes WHERE size > 1 ORDER BY size DESC, cluster_id LIMIT 50"))
def top_clusters(spark, d):
    return components.sizes(customer_run(spark, d).members).where("size > 1").orderBy(F.desc("size"), "cluster_id").limit(50)


@query(sql.chain("clusters", "ranked AS (SELECT cluster_id, name_norm, ingest_seq, row_number() OVER (PARTITION BY cluster_id ORDER BY ingest_seq) AS k FROM components JOIN norm USING (customer_key)), counted AS (SELECT cluster_id, name_norm, count(*) AS c, min(k) AS f FROM ranked WHERE k <= 20 AND name_norm IS NOT NULL GROUP BY 1, 2) SELECT cluster_id, name_norm AS consensus_name FROM counted QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY c DESC, f) = 1").replace(")\nranked AS", "),\nranked AS"))
def name_consensus(spark, d):
    run = customer_run(spark, d)
    return components.consensus_name(run.members, run.norm)


@query(sql.chain("clusters", "SELECT cluster_id, customer_key FROM components JOIN norm USING (customer_key) JOIN sizes USING (cluster_id) QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY ingest_seq) <= CASE WHEN size < 100 THEN 50 ELSE 20 END"))
def cluster_preview_members(spark, d):
    run = customer_run(spark, d)
    both = run.members.join(run.norm.select("customer_key", "ingest_seq"), "customer_key").join(components.sizes(run.members), "cluster_id")
    k = F.row_number().over(W.partitionBy("cluster_id").orderBy("ingest_seq"))
    return both.withColumn("k", k).where(F.col("k") <= F.when(F.col("size") < 100, 50).otherwise(20)).select("cluster_id", "customer_key")


@query(sql.chain("golden", "SELECT 'r_' || customer_key AS id, name_norm AS label, 'record' AS type FROM norm UNION ALL SELECT 'c_' || cluster_id, name_norm || CASE WHEN member_count > 1 THEN ' (Composite)' ELSE ' (Singleton)' END, 'cluster' FROM golden UNION ALL SELECT 'golden_' || cluster_id, 'Golden: ' || name_norm, 'golden_record' FROM golden WHERE member_count > 1"))
def graph_nodes(spark, d):
    run = customer_run(spark, d)
    records = run.norm.select(F.concat(F.lit("r_"), "customer_key").alias("id"), F.col("name_norm").alias("label"), F.lit("record").alias("type"))
    label = F.concat("name_norm", F.when(F.col("member_count") > 1, " (Composite)").otherwise(" (Singleton)"))
    groups = run.golden.select(F.concat(F.lit("c_"), "cluster_id").alias("id"), label.alias("label"), F.lit("cluster").alias("type"))
    gold = run.golden.where("member_count > 1").select(F.concat(F.lit("golden_"), "cluster_id").alias("id"), F.concat(F.lit("Golden: "), "name_norm").alias("label"), F.lit("golden_record").alias("type"))
    return staging.union_all([records, groups, gold])


@query(sql.chain("golden", "SELECT 'r_' || customer_key AS source, 'c_' || cluster_id AS target, 'MEMBER_OF' AS type, 1.0::DOUBLE AS weight FROM components UNION ALL SELECT 'golden_' || cluster_id, 'c_' || cluster_id, 'REPRESENTS', 1.0 FROM golden WHERE member_count > 1 UNION ALL SELECT 'r_' || a_key, 'r_' || b_key, CASE decision WHEN 'AUTO_LINK' THEN 'MATCHES' ELSE 'REVIEW' END, round(score, 6) FROM decided WHERE decision <> 'REJECT'"))
def graph_edges(spark, d):
    run = customer_run(spark, d)
    member = run.members.select(F.concat(F.lit("r_"), "customer_key").alias("source"), F.concat(F.lit("c_"), "cluster_id").alias("target"), F.lit("MEMBER_OF").alias("type"), F.lit(1.0).alias("weight"))
    gold = run.golden.where("member_count > 1").select(F.concat(F.lit("golden_"), "cluster_id").alias("source"), F.concat(F.lit("c_"), "cluster_id").alias("target"), F.lit("REPRESENTS").alias("type"), F.lit(1.0).alias("weight"))
    kind = F.when(F.col("decision") == "AUTO_LINK", "MATCHES").otherwise("REVIEW")
    match = run.decided.where("decision != 'REJECT'").select(F.concat(F.lit("r_"), "a_key").alias("source"), F.concat(F.lit("r_"), "b_key").alias("target"), kind.alias("type"), r6("score").alias("weight"))
    return staging.union_all([member, gold, match])


@query(sql.chain("clusters", "largest AS (SELECT cluster_id FROM sizes ORDER BY size DESC, cluster_id LIMIT 2) SELECT customer_key, CASE WHEN cluster_id IN (SELECT cluster_id FROM largest) THEN (SELECT min(cluster_id) FROM largest) ELSE cluster_id END AS cluster_id FROM components").replace(")\nlargest AS", "),\nlargest AS"))
def merge_clusters(spark, d):
    """The two largest clusters merged by hand: one more link, components anew."""
    run = customer_run(spark, d)
    two = components.sizes(run.members).orderBy(F.desc("size"), "cluster_id").limit(2)
    extra = two.agg(F.max("cluster_id").alias("x"), F.min("cluster_id").alias("y"))
    return components.clusters(run.norm, run.links.unionByName(extra))


@query(sql.chain("decided", "links AS (SELECT a_key AS x, b_key AS y FROM decided WHERE decision = 'AUTO_LINK'), gone AS (SELECT min(x) AS k FROM links), l2 AS (SELECT x, y FROM links, gone WHERE x <> k AND y <> k UNION SELECT y, x FROM links, gone WHERE x <> k AND y <> k), reach(customer_key, label) AS (SELECT customer_key, customer_key FROM norm UNION SELECT l.y, r.label FROM reach r JOIN l2 l ON l.x = r.customer_key WHERE r.label < l.y) SELECT customer_key, min(label) AS cluster_id FROM reach GROUP BY customer_key").replace(")\nlinks AS", "),\nlinks AS").replace("WITH ", "WITH RECURSIVE ", 1))
def split_record(spark, d):
    """One record taken out of its cluster: its links dropped, components anew."""
    run = customer_run(spark, d)
    gone = run.links.agg(F.min("x").alias("k"))
    left = run.links.crossJoin(F.broadcast(gone)).where("x != k and y != k").select("x", "y")
    return components.clusters(run.norm, left)


_STRICT = ("round(score, 9) >= 0.90", "round(score, 9) >= 0.95")


def _strict(spark, d) -> Run:
    """The same run decided with a stricter threshold, nothing kept."""
    run = customer_run(spark, d)
    strict = Run(run.raw, run.blocking, replace(CFG, auto=0.95), keep=False)
    strict.__dict__["norm"] = run.norm
    strict.__dict__["decided"] = run.decided.withColumn("decision", scoring.decide(strict.scoring))
    return strict


_SEEN = "m AS (SELECT customer_key, cluster_id, size, ingest_seq, coalesce(name_norm, 'Unknown') AS name FROM components JOIN sizes USING (cluster_id) JOIN norm USING (customer_key)), tied AS (SELECT a_key AS k FROM decided WHERE decision = 'REVIEW' UNION SELECT b_key FROM decided WHERE decision = 'REVIEW'), alone AS (SELECT * FROM m WHERE size = 1 AND customer_key NOT IN (SELECT k FROM tied))"


@query(sql.chain("clusters", f"{_SEEN} SELECT cluster_id AS id, arg_min(name, ingest_seq) || ' (Preview)' AS label, 'cluster' AS type FROM m WHERE size > 1 GROUP BY cluster_id UNION ALL SELECT customer_key, name, 'record' FROM m UNION ALL SELECT 'singleton_' || customer_key, name || ' (Singleton)', 'cluster' FROM alone").replace(")\nm AS", "),\nm AS").replace(*_STRICT))
def preview_nodes(spark, d):
    """What-if: the nodes of the graph a stricter threshold would give."""
    run = _strict(spark, d)
    return graph.preview(run.norm, run.decided, run.members)[0]


@query(sql.chain("clusters", f"{_SEEN} SELECT customer_key AS source, cluster_id AS target, 'MEMBER_OF' AS type, 1.0::DOUBLE AS weight FROM m WHERE size > 1 UNION ALL SELECT customer_key, 'singleton_' || customer_key, 'MEMBER_OF', 1.0 FROM alone UNION ALL SELECT a_key, b_key, CASE decision WHEN 'AUTO_LINK' THEN 'MATCHES' ELSE 'REVIEW' END, round(score, 6) FROM decided WHERE decision <> 'REJECT'").replace(")\nm AS", "),\nm AS").replace(*_STRICT))
def preview_edges(spark, d):
    """What-if: the edges of the graph a stricter threshold would give."""
    run = _strict(spark, d)
    return graph.preview(run.norm, run.decided, run.members)[1]


@query(sql.chain("clusters", "SELECT count(*) FILTER (WHERE size > 1) AS clusters, (SELECT count(*) FROM norm) AS records, (SELECT count(*) FROM decided WHERE decision = 'REVIEW') AS reviews FROM sizes").replace("round(score, 9) >= 0.90", "round(score, 9) >= 0.95"))
def preview_clusters(spark, d):
    """What-if: the counters of the same run decided with a stricter threshold."""
    run = customer_run(spark, d)
    links, reviews = components.thinned(run.streamed(replace(CFG, auto=0.95)))
    sized = components.sizes(components.connected_components(links)).agg(F.count_if(F.col("size") > 1).alias("clusters"))
    return sized.crossJoin(run.norm.agg(F.count(F.lit(1)).alias("records"))).crossJoin(reviews)


@query(sql.chain("clusters", "before AS (SELECT customer_key, customer_key AS cluster_id FROM norm) SELECT b.customer_key, b.cluster_id, b.cluster_id = c.cluster_id AS is_open FROM before b JOIN components c USING (customer_key) UNION ALL SELECT c.customer_key, c.cluster_id, true FROM components c WHERE c.customer_key <> c.cluster_id").replace(")\nbefore AS", "),\nbefore AS"))
def membership_scd2(spark, d):
    """Singleton memberships replaced by the run's clusters: old rows closed, new ones opened, unchanged ones kept."""
    run = customer_run(spark, d)
    before = run.norm.select("customer_key", F.col("customer_key").alias("cluster_id"), F.lit("2024-01-01").cast("timestamp").alias("valid_from"), F.lit(None).cast("timestamp").alias("valid_to"))
    return components.membership_changes(before, run.members, "2024-06-01").select("customer_key", "cluster_id", F.col("valid_to").isNull().alias("is_open"))


@query(sql.chain("golden", "SELECT cluster_id, member_count AS size, name_norm AS name FROM golden ORDER BY member_count DESC, cluster_id LIMIT 20 OFFSET 20"))
def entity_list(spark, d):
    return customer_run(spark, d).golden.orderBy(F.desc("member_count"), "cluster_id").offset(20).limit(20).select("cluster_id", F.col("member_count").alias("size"), F.col("name_norm").alias("name"))


_EMPTY = ", ".join(f"coalesce({f}_norm, '') AS {f}_norm" for f in ("name", "email", "phone", "dob", "address"))


@query(sql.chain("norm", f"SELECT customer_key, source_customer_id, coalesce(name_norm, 'Unknown') AS name, 'Unknown' AS product, 'Low' AS risk_level, '0.00' AS balance, coalesce(email_norm, 'N/A') AS email, coalesce(phone_norm, 'N/A') AS phone, {_EMPTY}, coalesce(city_norm, '') AS city, 'ACT' AS status, 'VERIFIED' AS kyc_status, '{{}}' AS metadata FROM norm UNION ALL SELECT 'missing-record', 'missing-record', 'Unknown (missing-...)', NULL, NULL, NULL, NULL, NULL, 'UNKNOWN (missing-...)', NULL, NULL, NULL, NULL, NULL, 'Incomplete', 'PENDING', NULL"))
def record_profile(spark, d):
    """Fixed view of each record with its defaults, and of one key that no record has."""
    norm = customer_run(spark, d).norm
    wanted = norm.select("customer_key").unionByName(spark.createDataFrame([("missing-record",)], "customer_key string"))
    both = wanted.join(norm.withColumn("known", F.lit(True)), "customer_key", "left")
    lost = F.col("known").isNull()
    stand_in = F.concat(F.lit(" ("), F.left("customer_key", F.lit(8)), F.lit("...)"))
    status = F.when(lost, "Incomplete").otherwise(F.coalesce("metadata.status", F.lit("ACT")))
    or_ = lambda c, default: F.when(~lost, F.coalesce(c, F.lit(default)))
    cols = {
        "source_customer_id": F.coalesce("source_customer_id", "customer_key"), "name": F.when(lost, F.concat(F.lit("Unknown"), stand_in)).otherwise(F.coalesce("name_norm", F.lit("Unknown"))), "product": F.when(~lost, "Unknown"),
        "risk_level": F.when(~lost, graph.risk("name_norm", "email_norm", "phone_norm", "dob_norm", "natid_norm", "metadata.status")), "balance": F.when(~lost, "0.00"), "email": or_("email_norm", "N/A"), "phone": or_("phone_norm", "N/A"),
        "name_norm": F.when(lost, F.concat(F.lit("UNKNOWN"), stand_in)).otherwise(F.coalesce("name_norm", F.lit(""))), "email_norm": or_("email_norm", ""), "phone_norm": or_("phone_norm", ""), "dob_norm": or_("dob_norm", ""), "address_norm": or_("address_norm", ""),
        "city": or_("city_norm", ""), "status": status, "kyc_status": F.when(status == "ACT", "VERIFIED").otherwise("PENDING"), "metadata": F.to_json("metadata"),
    }
    return both.select("customer_key", *[c.alias(n) for n, c in cols.items()])


@query(sql.chain("clusters", "tied AS (SELECT a_key AS k FROM decided WHERE decision <> 'REJECT' UNION SELECT b_key FROM decided WHERE decision <> 'REJECT'), many AS (SELECT count(*) AS c, coalesce(sum(size), 0) AS m FROM sizes WHERE size > 1), u AS (SELECT count(*) AS u FROM norm WHERE customer_key NOT IN (SELECT k FROM tied)), p AS (SELECT count(*) FILTER (WHERE round(score, 9) >= 0.85) AS auto_links, count(*) FILTER (WHERE round(score, 9) >= 0.6 AND round(score, 9) < 0.85) AS review_items, count(*) FILTER (WHERE round(score, 9) < 0.6) AS reject_items, count(*) AS total_pairs FROM decided) SELECT CAST(m + u AS BIGINT) AS total_records, u AS total_uniques, round(100.0 * (m - c) / (m + u), 1) AS dedup_rate, auto_links, review_items, reject_items, total_pairs FROM many, u, p").replace(")\ntied AS", "),\ntied AS"))
def exec_report(spark, d):
    run = customer_run(spark, d)
    s = F.round("score", 9)
    many = components.sizes(run.members).where("size > 1").agg(F.count(F.lit(1)).alias("c"), F.coalesce(F.sum("size"), F.lit(0)).alias("m"))
    linked = run.decided.where("decision != 'REJECT'").select(F.explode(F.array("a_key", "b_key")).alias("customer_key"))
    alone = run.norm.join(linked, "customer_key", "left_anti").agg(F.count(F.lit(1)).alias("u"))
    tiers = run.decided.agg(F.count_if(s >= 0.85).alias("auto_links"), F.count_if((s >= 0.6) & (s < 0.85)).alias("review_items"), F.count_if(s < 0.6).alias("reject_items"), F.count(F.lit(1)).alias("total_pairs"))
    total = F.col("m") + F.col("u")
    return many.crossJoin(alone).crossJoin(tiers).select(total.alias("total_records"), F.col("u").alias("total_uniques"), F.round(F.try_divide(100.0 * (F.col("m") - F.col("c")), total), 1).alias("dedup_rate"), "auto_links", "review_items", "reject_items", "total_pairs")


@query(sql.chain("golden", "SELECT cluster_id, member_count AS size, name_norm AS name FROM golden WHERE member_count > 1 ORDER BY member_count DESC, cluster_id LIMIT 5"))
def report_top_clusters(spark, d):
    return report_sheets(spark, d)["top entities"]


@query(sql.chain("decided", "tied AS (SELECT a_key AS k FROM decided WHERE decision <> 'REJECT' UNION SELECT b_key FROM decided WHERE decision <> 'REJECT') SELECT coalesce(name_norm, email_norm, source_customer_id, 'Unknown') AS name, coalesce(source_customer_id, customer_key, 'N/A') AS id FROM norm WHERE customer_key NOT IN (SELECT k FROM tied) ORDER BY name_norm NULLS LAST, customer_key LIMIT 10").replace(")\ntied AS", "),\ntied AS"))
def report_first_uniques(spark, d):
    return report_sheets(spark, d)["uniques"]


def report_sheets(spark, d) -> dict:
    """The sheets of the executive report; sources.workbook.write() makes a file of them."""
    run = customer_run(spark, d)
    top = run.golden.where("member_count > 1").orderBy(F.desc("member_count"), "cluster_id").limit(5).select("cluster_id", F.col("member_count").alias("size"), F.col("name_norm").alias("name"))
    linked = run.decided.where("decision != 'REJECT'").select(F.explode(F.array("a_key", "b_key")).alias("customer_key"))
    alone = run.norm.join(linked, "customer_key", "left_anti").orderBy(F.asc_nulls_last("name_norm"), "customer_key").limit(10)
    first = alone.select(F.coalesce("name_norm", "email_norm", "source_customer_id", F.lit("Unknown")).alias("name"), F.coalesce("source_customer_id", "customer_key", F.lit("N/A")).alias("id"))
    return {"summary": exec_report(spark, d), "top entities": top, "uniques": first}


_VIEW = "shown AS (SELECT cluster_id, size FROM sizes ORDER BY cluster_id LIMIT 500), v AS (SELECT customer_key, cluster_id, size, coalesce(name_norm, 'Unknown') AS name, row_number() OVER (PARTITION BY cluster_id ORDER BY ingest_seq) AS k FROM components JOIN shown USING (cluster_id) JOIN norm USING (customer_key))"


@query(sql.chain("clusters", f"{_VIEW} SELECT id, label, type FROM (SELECT 'c_' || cluster_id AS id, name || CASE WHEN size > 1 THEN ' (Composite)' ELSE ' (Singleton)' END AS label, 'cluster' AS type, cluster_id, 0 AS k FROM v WHERE k = 1 UNION ALL SELECT 'r_' || customer_key, name, 'record', cluster_id, k FROM v WHERE k <= CASE WHEN size < 100 THEN 50 ELSE 20 END) ORDER BY cluster_id, k LIMIT 5000").replace(")\nshown AS", "),\nshown AS"))
def graph_view_nodes(spark, d):
    run = customer_run(spark, d)
    return graph.view(run.members, run.norm)[0]


@query(sql.chain("clusters", f"{_VIEW} SELECT 'r_' || customer_key AS source, 'c_' || cluster_id AS target, 'MEMBER_OF' AS type, 1.0::DOUBLE AS weight FROM v WHERE k <= CASE WHEN size < 100 THEN 50 ELSE 20 END").replace(")\nshown AS", "),\nshown AS"))
def graph_view_edges(spark, d):
    run = customer_run(spark, d)
    return graph.view(run.members, run.norm)[1]


@query(sql.chain("golden", "held AS (SELECT min(cluster_id) AS c FROM sizes WHERE size > 1) SELECT cluster_id AS id, 'Cluster-' || left(cluster_id, 8) AS label, 'cluster' AS type FROM sizes WHERE cluster_id = (SELECT c FROM held) UNION ALL SELECT customer_key, coalesce(name_norm, 'Unknown'), 'record' FROM components JOIN norm USING (customer_key) WHERE cluster_id = (SELECT c FROM held) UNION ALL SELECT 'golden_' || cluster_id, 'Golden: ' || coalesce(name_norm, 'Record'), 'golden_record' FROM golden WHERE cluster_id = (SELECT c FROM held)").replace(")\nheld AS", "),\nheld AS"))
def graph_one_cluster(spark, d):
    """The nodes of one cluster, with its golden record."""
    run = customer_run(spark, d)
    wanted = components.sizes(run.members).where("size > 1").agg(F.min("cluster_id")).first()[0]
    return graph.one_cluster(run.members, run.norm, run.golden, wanted or "")[0]


_MAP = lambda fields: "concat_ws('|', " + ", ".join(f"'{f}=' || {f}" for f in fields) + ")"


@query(sql.chain("golden", f"SELECT cluster_id AS id, 'Entity' AS type, {_MAP(['city_norm', 'email_norm', 'name_norm', 'phone_norm'])} AS properties FROM golden UNION ALL SELECT source_system || ':' || source_customer_id, 'Record', {_MAP(['dob_norm', 'email_norm', 'name_norm', 'natid_norm', 'phone_norm'])} FROM norm"))
def graph_properties(spark, d):
    """The nodes of the property graph with what they carry, nulls left out."""
    run = customer_run(spark, d)
    nodes, _ = graph.projection(run.members, run.norm, run.golden)
    pairs = F.transform(F.array_sort(F.map_entries("properties")), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return nodes.select("id", "type", F.array_join(pairs, "|").alias("properties"))


@query(sql.chain("clusters", "SELECT (SELECT count(*) FROM sizes) AS clusters, (SELECT count(*) FROM components) AS members, (SELECT count(*) FROM decided WHERE decision = 'AUTO_LINK') AS matches, (SELECT count(*) FROM decided WHERE decision = 'REVIEW') AS reviews, (SELECT count(*) FROM components) AS member_of"))
def graph_stats(spark, d):
    """Nodes and edges of each kind."""
    run = customer_run(spark, d)
    n = run.members.agg(F.count_distinct("cluster_id").alias("clusters"), F.count(F.lit(1)).alias("members"), F.count(F.lit(1)).alias("member_of"))
    return n.crossJoin(run.decided.agg(F.count_if(F.col("decision") == "AUTO_LINK").alias("matches"), F.count_if(F.col("decision") == "REVIEW").alias("reviews")))


@query(sql.chain("pairs", "SELECT (SELECT count(*) FROM pairs p JOIN norm a ON a.customer_key = a_key JOIN norm b ON b.customer_key = b_key WHERE a.true_ident = b.true_ident) AS found, (SELECT CAST(sum(n * (n - 1) // 2) AS BIGINT) FROM (SELECT count(*) AS n FROM norm GROUP BY true_ident)) AS true_pairs"))
def blocking_recall(spark, d):
    """Pairs of one identity that blocking finds, of how many there are."""
    run = customer_run(spark, d)
    return blocking.recall(run.pairs, run.norm, "true_ident").withColumnRenamed("true", "true_pairs")


@query("SELECT * FROM (VALUES (66, 21, 2, 2, 17, 8, 6, 2)) v(keys, candidates, auto_links, reviews, rejects, clusters, singletons, uniques)")
def demo_pipeline_counts(spark, d):
    """The ten demo customers through the whole pipeline."""
    from kinmesh.config import OPEN_BLOCKING

    run = Run(staging.demo(spark), OPEN_BLOCKING, CFG)
    one = lambda df, c: df.agg(c)
    linked = run.decided.where("decision != 'REJECT'").select(F.explode(F.array("a_key", "b_key")).alias("customer_key"))
    parts = [
        one(run.keys, F.count_distinct("block_key").cast("int").alias("keys")), one(run.pairs, F.count(F.lit(1)).cast("int").alias("candidates")),
        run.decided.agg(*[F.count_if(F.col("decision") == k).cast("int").alias(n) for k, n in (("AUTO_LINK", "auto_links"), ("REVIEW", "reviews"), ("REJECT", "rejects"))]),
        components.sizes(run.members).agg(F.count(F.lit(1)).cast("int").alias("clusters"), F.count_if(F.col("size") == 1).cast("int").alias("singletons")),
        run.norm.join(linked, "customer_key", "left_anti").agg(F.count(F.lit(1)).cast("int").alias("uniques")),
    ]
    out = parts[0]
    for p in parts[1:]:
        out = out.crossJoin(p)
    return out

