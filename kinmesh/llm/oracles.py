"""SQL for the problems that SQL can state on whole tables."""

from __future__ import annotations


def squeezed(x: str) -> str:
    return f"regexp_replace(replace(lower(upper(coalesce({x}, ''))), 'ß', 'ss'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', '', 'g')"


def sorted_words(x: str) -> str:
    bare = f"regexp_replace(regexp_replace(replace(lower(upper(coalesce({x}, ''))), 'ß', 'ss'), '[''’`´ʼ]', '', 'g'), '[^\\p{{L}}\\p{{N}}\\p{{M}}]+', ' ', 'g')"
    return f"array_to_string(list_sort(list_filter(string_split({bare}, ' '), lambda w: w <> '')), '')"


def _key(plain: list[str], name: str, anywhere: list[str] = ()) -> str:
    parts = [squeezed(c) for c in plain] + [sorted_words(name)]
    if anywhere:
        parts.append(f"array_to_string(list_sort(list_filter([{', '.join(squeezed(c) for c in anywhere)}], lambda w: w <> '')), '/')")
    return " || '|' || ".join(parts)


_CUSTOMER = _key(["phone_norm", "email_norm", "dob_norm", "address_norm", "city_norm", "natid_norm"], "name_norm")
_STAGING = _key(["CUSDOB", "MOBLNO", "TELENO", "MAILID", "CITYNM", "POSTCODE", "NATLID"], "concat_ws(' ', CUSNMF, CUSNML)", ["ADDRS1", "ADDRS2", "ADDRS3", "ADDRS4"])
_COPIES = f"k AS (SELECT ingest_seq AS seq, 'c' || {_CUSTOMER} AS key FROM customers_norm UNION ALL SELECT ingest_seq, 's' || {_STAGING} FROM challenging_er_200)"

_CLEAN = "regexp_replace(lower({c}), '^[^0-9a-z]+|[^0-9a-z]+$', '', 'g')"
_LABEL = "regexp_replace(upper({c}), '[^A-Z0-9]', '', 'g')"
_GROUPS = f"""
p AS (SELECT {_CLEAN.format(c='a_key')} AS x, {_CLEAN.format(c='b_key')} AS y FROM candidate_pairs WHERE pair_id IN (SELECT pair_id FROM match_decisions WHERE {_LABEL.format(c='decision')} = 'AUTOLINK')),
e AS (SELECT x, y FROM p WHERE x <> y UNION SELECT y, x FROM p WHERE x <> y),
r(k, label) AS (SELECT x, x FROM e UNION SELECT e.y, r.label FROM r JOIN e ON e.x = r.k WHERE r.label < e.y),
g AS (SELECT k, min(label) AS group_key FROM r GROUP BY k)"""

_SURVIVOR = f"""
WITH cur AS (SELECT DISTINCT cluster_id, customer_key FROM clusters WHERE valid_to IS NULL),
many AS (SELECT cluster_id FROM cur GROUP BY 1 HAVING count(*) > 1),
x AS (
  SELECT cluster_id, c.customer_key, regexp_replace(phone_norm, '\\D', '', 'g') AS p, CASE WHEN updated_at > started_at THEN NULL ELSE updated_at END AS u, trust_rank
  FROM cur JOIN many USING (cluster_id) JOIN customers_norm c USING (customer_key) LEFT JOIN runs r ON r.run_id = c.run_id
  LEFT JOIN source_systems s ON {_LABEL.format(c='s.source_system')} = {_LABEL.format(c='c.source_system')}),
y AS (SELECT *, list_distinct(list_transform(range(1, length(p)), lambda i: (ascii(p[i + 1]) - ascii(p[i]) + 10) % 10)) AS steps FROM x WHERE length(p) >= 7)
SELECT cluster_id, customer_key FROM y WHERE NOT (len(steps) = 1 AND steps[1] IN (0, 1, 9))
QUALIFY row_number() OVER (PARTITION BY cluster_id ORDER BY u DESC NULLS LAST, trust_rank, customer_key) = 1"""

ORACLE = {
    "p4_found": f"WITH RECURSIVE {_GROUPS} SELECT group_key, k AS customer_key FROM g WHERE group_key <> k",
    "p4_sizes": f"WITH RECURSIVE {_GROUPS} SELECT group_key, count(*) AS members FROM g GROUP BY group_key",
    "p5_found": _SURVIVOR,
    "p7_found": f"WITH {_COPIES} SELECT a.seq AS a_seq, b.seq AS b_seq FROM k a JOIN k b ON a.key = b.key AND a.seq < b.seq",
    "p7_collapsed": f"WITH {_COPIES} SELECT min(seq) AS ingest_seq, count(*) AS copies FROM k GROUP BY key",
    "p8_text": "SELECT doc_id, coalesce(text, '') AS text FROM documents",
}
