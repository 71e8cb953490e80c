"""DuckDB SQL for those of the queries that SQL can express."""

from __future__ import annotations

from proofline.llm import secrets as _s

_NO_QUOTE = lambda x: x.replace("'", "''")

OP1 = """
WITH d AS (SELECT doc_id, hex(encode(coalesce(text, ''))) AS x, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
w AS (SELECT doc_id, i AS start, substr(x, 2 * i + 1, 200) AS win FROM d, unnest(range(0, n - 99)) AS t(i) WHERE n >= 100),
late AS (SELECT doc_id, start FROM (SELECT doc_id, start, row_number() OVER (PARTITION BY win ORDER BY doc_id, start) AS k FROM w) WHERE k > 1),
gone AS (SELECT DISTINCT doc_id, p FROM late, unnest(range(start, start + 100)) AS t(p)),
runs AS (SELECT doc_id, count(*) AS n_removed, sum(CASE WHEN q IS NULL OR q < p - 1 THEN 1 ELSE 0 END) AS n_spans
  FROM (SELECT doc_id, p, lag(p) OVER (PARTITION BY doc_id ORDER BY p) AS q FROM gone) GROUP BY doc_id),
bytes AS (SELECT d.doc_id, i, substr(x, 2 * i + 1, 2) AS b FROM d, unnest(range(0, n)) AS t(i)),
kept AS (SELECT b.doc_id, string_agg(b.b, '' ORDER BY b.i) AS x FROM bytes b LEFT JOIN gone g ON g.doc_id = b.doc_id AND g.p = b.i WHERE g.p IS NULL GROUP BY b.doc_id)
SELECT d.doc_id, d.n AS n_bytes, coalesce(r.n_removed, 0) AS n_removed, coalesce(r.n_spans, 0)::BIGINT AS n_spans, sha256(unhex(coalesce(k.x, ''))) AS kept_sha256
FROM d LEFT JOIN runs r USING (doc_id) LEFT JOIN kept k USING (doc_id)
"""

_LOWER = "translate(coalesce({0}, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = "regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP10 = f"""
WITH d AS (SELECT doc_id, {_WORDS.format("text")} AS w FROM documents),
b AS (SELECT item_id, {_WORDS.format("text")} AS w FROM benchmark),
win AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 12], ' ') AS p, len(w[i : i + 12]) AS size FROM b, unnest(range(1, greatest(1, len(w) - 12) + 1)) AS t(i) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
runs AS (SELECT doc_id, i, size, array_to_string(w[i : i + size - 1], ' ') AS p FROM d, sizes, unnest(range(1, len(w) - size + 2)) AS t(i) WHERE len(w) >= size),
hit AS (SELECT r.doc_id, r.i, r.size, win.item_id FROM runs r JOIN win ON win.p = r.p AND win.size = r.size),
covered AS (SELECT doc_id, count(DISTINCT j) AS n_hit FROM hit, unnest(range(i, i + size)) AS t(j) GROUP BY doc_id),
items AS (SELECT doc_id, count(*) AS n_items, string_agg(x, ',' ORDER BY x) AS s FROM (SELECT DISTINCT doc_id, item_id::VARCHAR AS x FROM hit) GROUP BY doc_id)
SELECT d.doc_id, len(d.w)::BIGINT AS n_words, coalesce(c.n_hit, 0) AS n_hit, coalesce(i.n_items, 0) AS n_items, sha256(coalesce(i.s, '')) AS items_sha256,
  coalesce(c.n_hit, 0) > 0 AND 20 * coalesce(c.n_hit, 0) >= len(d.w) AS contaminated
FROM d LEFT JOIN covered c USING (doc_id) LEFT JOIN items i USING (doc_id)
"""


def _kind(kind: str, pattern: str, keep: str) -> str:
    p = _NO_QUOTE(pattern)
    return f"""{kind}_m AS (SELECT k, regexp_extract_all(t, '{p}') AS m, regexp_split_to_array(t, '{p}') AS g FROM d),
{kind}_s AS (SELECT k, '{kind}' AS kind, m[i] AS m, (list_sum(list_transform(g[1 : i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1 : i - 1], lambda x: length(x))), 0))::BIGINT AS start
  FROM {kind}_m, unnest(range(1, len(m) + 1)) AS t(i) WHERE {keep})"""


def _entropy(name: str) -> str:
    import math

    alphabet, bits = _s.CLASSES[name]
    most = math.floor((math.log2(_s.WINDOW) - bits) * _s.WINDOW * _s.UNIT)
    table = "[" + ", ".join(str(round(c * math.log2(c) * _s.UNIT) if c else 0) for c in range(_s.WINDOW + 1)) + "]"
    inside = "[" + alphabet.replace("-", "") + ("-" if "-" in alphabet else "") + "]"
    return f"""SELECT k, start FROM (SELECT k, start, j, list_sum(list_transform(map_values(histogram(c)), lambda n: ({table})[n::INT + 1])) AS s FROM (
    SELECT k, start, j, unnest(string_split(substr(m, j, {_s.WINDOW}), '')) AS c FROM entropy_s, unnest(range(1, length(m) - {_s.WINDOW} + 2)) AS t(j)
    WHERE regexp_full_match(substr(m, j, {_s.WINDOW}), '{inside}+')) GROUP BY k, start, j) WHERE s <= {most}"""


OP8 = f"""
WITH d AS (SELECT row_number() OVER () AS k, doc_id, coalesce(text, '') AS t FROM documents),
{_kind("assign", _s.ASSIGN, f"length(regexp_extract(m[i], '{_NO_QUOTE(_s.ASSIGN)}', 2)) >= 8")},
{_kind("access", _s.ACCESS, "true")},
{_kind("hex", _s.HEX, "true")},
{_kind("entropy", _s.CANDIDATE, f"NOT regexp_matches(m[i], '{_NO_QUOTE(_s.ALLOWED)}')")},
strong AS ({_entropy("hex")} UNION {_entropy("alnum")}),
base AS (SELECT k, kind, 0 AS r, start, m FROM assign_s UNION ALL SELECT k, kind, 1, start, m FROM access_s UNION ALL SELECT k, kind, 2, start, m FROM hex_s),
every AS (SELECT * FROM base UNION ALL SELECT k, kind, 3, start, m FROM entropy_s JOIN strong USING (k, start)),
of_base AS (SELECT k, count(*) FILTER (kind = 'assign') AS a, count(*) FILTER (kind = 'access') AS c, count(*) FILTER (kind = 'hex') AS h, string_agg(kind || ':' || start || ':' || (start + length(m)), ',' ORDER BY start, r) AS s FROM base GROUP BY k),
of_every AS (SELECT k, string_agg(kind || ':' || start || ':' || (start + length(m)), ',' ORDER BY start, r) AS s FROM every GROUP BY k)
SELECT doc_id, coalesce(a, 0) AS n_assign, coalesce(c, 0) AS n_access, coalesce(h, 0) AS n_hex, sha256(coalesce(b.s, '')) AS base_sha256, coalesce(e.s, '') AS spans
FROM d LEFT JOIN of_base b USING (k) LEFT JOIN of_every e USING (k)
"""

ORACLES = {"op1_suffix_dedup": OP1, "op8_secrets": OP8, "op10_decontaminate": OP10}
