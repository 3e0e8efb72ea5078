"""The resolution chain as portable SQL, one common table expression per stage; the check of what the operators compute."""

from __future__ import annotations

from kinmesh.config import ScoringConfig
from kinmesh.functions.text import ADDRESS_WORDS

# The test relation, records in three spellings for every three customers.
SOURCE = """
b AS (
  SELECT c_custkey AS rid, c_nationkey AS nk,
         CAST((c_custkey - c_custkey % 3) / 3 AS BIGINT) AS ident, CAST(c_custkey % 3 AS INT) AS v
  FROM customer),
n AS (
  SELECT rid, nk, ident, v,
    split_part('James,Mary,Robert,Patricia,John,Jennifer,Michael,Linda,David,Elizabeth,William,Barbara,Richard,Susan,Joseph,Jessica,Thomas,Sarah,Charles,Karen,Nadia,Lisa,Daniel,Nancy,Matthew,Betty,Anthony,Sandra,Mark,Ashley,Rahim,Kimberly,Steven,Emily,Paul,Donna,Andrew,Michelle,Joshua,Carol', ',', CAST(ident * 7 % 40 AS INT) + 1) AS fn,
    split_part('Smith,Johnson,Williams,Brown,Jones,Garcia,Miller,Davis,Rodriguez,Martinez,Hernandez,Lopez,Gonzalez,Wilson,Anderson,Thomas,Taylor,Moore,Jackson,Martin,Lee,Perez,Thompson,White,Harris,Sanchez,Clark,Ramirez,Lewis,Robinson,Walker,Young,Allen,King,Wright,Scott,Torres,Nguyen,Hill,Flores,Green,Adams,Nelson,Baker,Hall,Rivera,Campbell,Mitchell,Carter,Roberts', ',', CAST(ident * 11 % 50 AS INT) + 1) AS ln,
    lpad(CAST(ident * 7919 % 10000000 AS STRING), 7, '0') AS p7,
    CAST(1950 + ident % 50 AS STRING) AS yy, lpad(CAST(1 + ident % 12 AS STRING), 2, '0') AS mm, lpad(CAST(1 + ident % 28 AS STRING), 2, '0') AS dd
  FROM b),
src AS (SELECT rid AS ingest_seq, concat('C', lpad(CAST(rid AS STRING), 8, '0')) AS source_customer_id, ident AS true_ident,
  CASE v WHEN 0 THEN 'CORE_BANKING' WHEN 1 THEN 'LOANS' ELSE 'CARDS' END AS source_system,
  CASE v WHEN 0 THEN fn WHEN 1 THEN upper(fn) ELSE CASE WHEN ident % 6 = 0 THEN concat(substr(fn, 1, 1), '.') ELSE fn END END AS first_name,
  CASE v WHEN 1 THEN CASE WHEN ident % 4 = 0 THEN concat(substr(ln, 1, 3), substr(ln, 5)) ELSE concat(ln, ' ') END ELSE ln END AS last_name,
  CASE v WHEN 0 THEN concat('555-', substr(p7, 1, 3), '-', substr(p7, 4, 4)) WHEN 1 THEN concat('+1 (555) ', p7, '') ELSE CASE WHEN ident % 5 = 0 THEN NULL ELSE concat('555', p7) END END AS phone,
  CASE v WHEN 2 THEN CASE WHEN ident % 3 = 0 THEN 'N/A' ELSE lower(concat(substr(fn, 1, 1), ln, '@mail', CAST(ident % 9 AS STRING), '.com')) END ELSE lower(concat(fn, '.', ln, CAST(ident AS STRING), '@mail', CAST(ident % 9 AS STRING), '.com')) END AS email,
  CASE v WHEN 0 THEN concat(yy, '-', mm, '-', dd) WHEN 1 THEN concat(dd, '/', mm, '/', yy) ELSE CASE WHEN ident % 4 = 1 THEN NULL WHEN ident % 13 = 0 THEN concat('1930-', mm, '-', dd) ELSE concat(dd, '.', mm, '.', yy) END END AS dob,
  CASE v WHEN 1 THEN concat(CAST(100 + ident % 900 AS STRING), ' ', ln, ' Street, Apartment ', CAST(ident % 40 AS STRING)) ELSE concat(CAST(100 + ident % 900 AS STRING), ' ', ln, ' St Apt ', CAST(ident % 40 AS STRING)) END AS address,
  concat('City ', CAST(nk AS STRING)) AS city,
  CASE WHEN ident % 7 = 0 THEN NULL WHEN v = 1 AND ident % 11 = 0 THEN concat('id', CAST(ident * 17 + 1 AS STRING)) WHEN v = 2 THEN concat('ID-', CAST(ident * 17 AS STRING)) ELSE concat('ID', CAST(ident * 17 AS STRING)) END AS natid
FROM n)
"""

# Letters with a Soundex digit, and their digits.
_CODES = "BFPVCGJKQSXZDTLMNR"
_DIGITS = "111122222222334556"
_WORDS = ADDRESS_WORDS
# The date patterns of functions.text in the notation of SQL.
_DATES = ["%Y-%m-%d", "%d-%m-%Y", "%m-%d-%Y", "%Y/%m/%d", "%d/%m/%Y", "%m/%d/%Y", "%d.%m.%Y", "%Y%m%d", "%d %b %Y", "%d %B %Y"]


def strip(x: str) -> str:
    return f"regexp_replace({x}, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')"


def some(x: str) -> str:
    return f"CASE WHEN upper({strip(x)}) NOT IN ('', 'N/A', 'NA', 'NULL', 'NONE', '-', '—') THEN {strip(x)} END"


def squeeze(x: str) -> str:
    return f"nullif(trim(regexp_replace({x}, '[\\s\\p{{Z}}]+', ' ', 'g')), '')"


def name(x: str) -> str:
    bare = f"regexp_replace(strip_accents(upper({strip(x)})), '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}-]', '', 'g')"
    return squeeze(f"replace({bare}, '-', ' ')")


def phone(x: str) -> str:
    d = f"regexp_replace({x}, '\\D', '', 'g')"
    return f"CASE WHEN length({d}) >= 7 THEN right({d}, 10) END"


def email(x: str) -> str:
    e = f"lower({strip(x)})"
    return f"CASE WHEN contains({e}, '@') AND contains(split_part({e}, '@', -1), '.') THEN {e} END"


def dob(x: str) -> str:
    tries = ", ".join(f"CASE WHEN year(try_strptime(trim({x}), '{p}')) BETWEEN 1900 AND 2030 THEN try_strptime(trim({x}), '{p}') END" for p in _DATES)
    return f"strftime(coalesce({tries}), '%Y-%m-%d')"


def address(x: str) -> str:
    t = f"strip_accents(upper({strip(x)}))"
    for w, s in _WORDS:
        t = f"regexp_replace({t}, '\\b{w}\\b', '{s}', 'g')"
    return squeeze(f"regexp_replace({t}, '[^\\p{{L}}\\p{{N}}_\\s\\p{{Z}}]', ' ', 'g')")


def natid(x: str) -> str:
    return f"nullif(regexp_replace(upper({x}), '[^A-Z0-9]', '', 'g'), '')"


def soundex(n: str) -> str:
    t = f"translate(regexp_replace(substr({n}, 1, 1) || regexp_replace(substr({n}, 2), '[HW]', '', 'g'), '[^{_CODES}]', '0', 'g'), '{_CODES}', '{_DIGITS}')"
    for k in "0123456":
        t = f"regexp_replace({t}, '{k}+', '{k}', 'g')"
    return f"CASE WHEN regexp_matches({n}, '^[A-Z]') THEN substr({n}, 1, 1) || rpad(left(replace(substr({t}, 2), '0', ''), 3), 3, '0') END"


FULL_NAME = f"nullif(concat_ws(' ', {some('first_name')}, {some('last_name')}), '')"
NORM = f"""
norm AS (
  SELECT *, sha256(coalesce(name_norm, '') || '|' || coalesce(phone_norm, '') || '|' || coalesce(email_norm, '') || '|' || coalesce(dob_norm, '') || '|' || coalesce(address_norm, '') || '|' || coalesce(natid_norm, '')) AS record_hash
  FROM (
    SELECT sha256(source_system || '|' || source_customer_id || '|' || CAST(ingest_seq AS VARCHAR)) AS customer_key, ingest_seq, source_customer_id, source_system, true_ident,
      {name(FULL_NAME)} AS name_norm, {phone(some('phone'))} AS phone_norm, {email(some('email'))} AS email_norm, {dob(some('dob'))} AS dob_norm,
      {address(some('address'))} AS address_norm, {name(some('city'))} AS city_norm, {natid(some('natid'))} AS natid_norm
    FROM src))"""

_TOKENS = "list_filter(string_split(name_norm, ' '), lambda t: length(t) >= 2)"
RAW_KEYS = f"""
raw_keys AS (
  SELECT customer_key, 'phone_last10' AS method, phone_norm AS value FROM norm
  UNION ALL SELECT customer_key, 'email_exact', email_norm FROM norm
  UNION ALL SELECT customer_key, 'email_domain', split_part(email_norm, '@', -1) FROM norm
  UNION ALL SELECT customer_key, 'natid_exact', natid_norm FROM norm
  UNION ALL SELECT customer_key, 'dob_exact', dob_norm FROM norm
  UNION ALL SELECT customer_key, 'soundex_full', {soundex('name_norm')} FROM norm
  UNION ALL SELECT customer_key, 'soundex_first', {soundex(f'{_TOKENS}[1]')} FROM norm
  UNION ALL SELECT customer_key, 'name_token', unnest({_TOKENS}[1:5]) FROM norm
  UNION ALL SELECT customer_key, 'city_exact', city_norm FROM norm
  UNION ALL SELECT customer_key, 'dob_initial', dob_norm || ':' || left(name_norm, 1) FROM norm)"""
KEYS = RAW_KEYS + """,
keys AS (SELECT DISTINCT customer_key, method, md5(method || ':' || value) AS block_key FROM raw_keys WHERE value IS NOT NULL),
key_stats AS (SELECT method, block_key, count(*) AS n FROM keys GROUP BY ALL),
total AS (SELECT count(*) AS total FROM norm),
kept AS (SELECT k.* FROM keys k JOIN key_stats s USING (method, block_key), total WHERE 100.0 * n / total <= 5.0 AND n BETWEEN 2 AND 200)"""
PAIRS = """
pairs AS (
  SELECT a.customer_key AS a_key, b.customer_key AS b_key, string_agg(DISTINCT a.method, ',' ORDER BY a.method) AS reasons, min(a.block_key) AS block_key_sample, a.customer_key || ':' || b.customer_key AS pair_id
  FROM kept a JOIN kept b ON a.block_key = b.block_key AND a.customer_key < b.customer_key GROUP BY 1, 2)"""

WEIGHTS = ScoringConfig().weights
FUZZY = {"name": ScoringConfig().name_fuzzy, "address": ScoringConfig().address_fuzzy}


def _kind(f: str) -> str:
    a, b = f"a.{f}_norm", f"b.{f}_norm"
    head = f"CASE WHEN {a} IS NULL AND {b} IS NULL THEN 'both_null' WHEN {a} IS NULL OR {b} IS NULL THEN 'one_null'"
    if f in FUZZY:
        j = f"jaro_winkler_similarity({a}, {b})"
        return f"{head} WHEN {j} >= 0.99 THEN 'exact_match' WHEN {j} >= {FUZZY[f]} THEN 'fuzzy_match' WHEN {j} >= 0.7 THEN 'low_similarity' ELSE 'mismatch' END"
    return f"{head} WHEN {a} = {b} THEN 'exact_match' ELSE 'mismatch' END"


def _gain(f: str) -> str:
    w = WEIGHTS[f]
    return f"CASE {f}_kind WHEN 'exact_match' THEN {w} WHEN 'fuzzy_match' THEN {w} * {f}_sim WHEN 'low_similarity' THEN 0.5 * {w} * {f}_sim ELSE 0 END" if f in FUZZY else f"CASE {f}_kind WHEN 'exact_match' THEN {w} ELSE 0 END"


_SIMS = ", ".join(f"coalesce(jaro_winkler_similarity(a.{f}_norm, b.{f}_norm), 0) AS {f}_sim" for f in FUZZY)
_SEEN = " + ".join(f"CASE WHEN {f}_kind NOT IN ('both_null', 'one_null') THEN {w} ELSE 0 END" for f, w in WEIGHTS.items())
_OTHERS = " OR ".join(f"({_gain(f)}) > 0" for f in WEIGHTS if f != "name")
_SIGNALS = [("phone", "exact_phone"), ("email", "exact_email"), ("natid", "exact_natid"), ("dob", "exact_dob")]
SCORES = f"""
compared AS (
  SELECT p.*, a.name_norm AS name_a, length(a.name_norm) AS len_a, a.record_hash = b.record_hash AND coalesce(a.name_norm, a.phone_norm, a.email_norm, a.dob_norm, a.address_norm, a.natid_norm) IS NOT NULL AS same_hash,
    {", ".join(f"{_kind(f)} AS {f}_kind" for f in WEIGHTS)}, {_SIMS}, abs(year(CAST(a.dob_norm AS DATE)) - year(CAST(b.dob_norm AS DATE))) AS years
  FROM pairs p JOIN norm a ON a.customer_key = p.a_key JOIN norm b ON b.customer_key = p.b_key),
summed AS (SELECT *, {" + ".join(_gain(f) for f in WEIGHTS)} AS gained, {_SEEN} AS seen, {_OTHERS} AS others,
    natid_kind = 'mismatch' AND NOT (name_sim >= 0.85 AND (email_kind = 'exact_match' OR phone_kind = 'exact_match' OR address_sim >= 0.85)) AS natid_clash, coalesce(years > 2, false) AS dob_clash FROM compared),
averaged AS (SELECT *, CASE WHEN seen < 0.1 THEN 0 ELSE gained / seen END AS s0 FROM summed),
capped AS (SELECT *, CASE WHEN seen < 0.4 AND s0 > 0.8 AND NOT (name_kind = 'exact_match' OR (name_kind = 'fuzzy_match' AND name_sim > 0.88 AND len_a > 10)) THEN 0.8 ELSE s0 END AS s1 FROM averaged),
boosted AS (SELECT *, CASE WHEN name_sim >= 0.90 THEN CASE WHEN len_a > 8 THEN greatest(s1, 0.93) ELSE s1 END WHEN name_sim >= 0.85 AND len_a > 10 THEN greatest(s1, 0.90) ELSE s1 END AS s2 FROM capped),
linked AS (SELECT *, CASE WHEN name_kind = 'exact_match' AND others THEN greatest(s2, 0.98) ELSE s2 END AS s3 FROM boosted),
scored AS (
  SELECT *, CASE WHEN same_hash THEN 1.0 WHEN natid_clash OR dob_clash THEN 0.1 ELSE least(1.0, greatest(0.0, s3)) END AS score,
    CASE WHEN same_hash THEN '' ELSE concat_ws(',', CASE WHEN natid_clash THEN 'natid_mismatch' END, CASE WHEN dob_clash THEN 'dob_major_mismatch' END) END AS conflicts,
    CASE WHEN same_hash THEN 'exact_hash_match,auto_link_forced' ELSE concat_ws(',', CASE WHEN name_kind = 'exact_match' THEN 'exact_name' WHEN name_sim >= 0.85 THEN 'fuzzy_name_high' END,
      {", ".join(f"CASE WHEN {f}_kind = 'exact_match' THEN '{s}' END" for f, s in _SIGNALS)}, CASE WHEN address_kind = 'exact_match' THEN 'exact_address' WHEN address_sim >= 0.80 THEN 'address_high' END) END AS signals
  FROM linked),
decided AS (
  SELECT *, CASE WHEN conflicts <> '' THEN 'REJECT' WHEN round(score, 9) >= 0.90 AND (len(string_split(nullif(signals, ''), ',')) >= 2 OR round(score, 9) >= 0.98) THEN 'AUTO_LINK' WHEN round(score, 9) >= 0.55 THEN 'REVIEW' ELSE 'REJECT' END AS decision
  FROM scored)"""
CLUSTERS = """
links AS (SELECT a_key AS x, b_key AS y FROM decided WHERE decision = 'AUTO_LINK' UNION SELECT b_key, a_key FROM decided WHERE decision = 'AUTO_LINK'),
reach(customer_key, label) AS (SELECT customer_key, customer_key FROM norm UNION SELECT l.y, r.label FROM reach r JOIN links l ON l.x = r.customer_key WHERE r.label < l.y),
components AS (SELECT customer_key, min(label) AS cluster_id FROM reach GROUP BY customer_key),
sizes AS (SELECT cluster_id, count(*) AS size FROM components GROUP BY cluster_id)"""
GOLDEN = """
golden AS (
  SELECT cluster_id, count(*) AS member_count, """ + ", ".join(f"arg_max({f}_norm, ingest_seq) FILTER (WHERE {f}_norm IS NOT NULL) AS {f}_norm" for f in ("name", "phone", "email", "dob", "address", "city", "natid")) + """,
    string_agg(source_customer_id, ',' ORDER BY ingest_seq) AS source_ids
  FROM components JOIN norm USING (customer_key) GROUP BY cluster_id)"""

STAGES = [("src", SOURCE), ("norm", NORM), ("keys", KEYS), ("pairs", PAIRS), ("decided", SCORES), ("clusters", CLUSTERS), ("golden", GOLDEN)]


def chain(upto: str, query: str) -> str:
    """The stages up to one of src, norm, keys, pairs, decided, clusters, golden, followed by a query over them."""
    parts = []
    for stage, text in STAGES:
        parts.append(text.strip())
        if stage == upto:
            break
    return ("WITH RECURSIVE " if upto in ("clusters", "golden") else "WITH ") + ",\n".join(parts) + "\n" + query
