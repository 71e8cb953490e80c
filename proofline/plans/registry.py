"""Named queries over the audited relations, each with the DuckDB SQL that checks it where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from proofline.operators import assigned as A, copied as C, free_text as T, metrics as M, ranking as K, runs as R
from proofline.plans.projections import relation, with_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def _add(name: str, names: str, build: Callable[..., DataFrame], sql: str | None = None) -> None:
    """build takes the named relations; sql reads them by their names with _r behind."""
    used = names.split()
    QUERIES[name] = lambda spark, sf_dir: build(*(relation(spark, sf_dir, n) for n in used))
    if sql:
        ORACLES[name] = with_sql(*used) + (", " + sql if not sql.lstrip().upper().startswith("SELECT") else sql)


DECLINES = "(value IS NULL OR value = 'abstain')"

_add("a01_label_in_taxonomy", "outputs taxonomy", A.label_in_taxonomy, f"SELECT item_id, value, CASE WHEN path IS NULL THEN 'fail' ELSE 'pass' END AS status FROM outputs_r LEFT JOIN taxonomy_r ON path = value WHERE NOT {DECLINES}")
# The one label that the outputs invent, and the three labels of the tree that difflib holds for closest.
_add("a01b_nearest_labels", "outputs taxonomy", A.nearest_labels, "SELECT DISTINCT value, 'romance,romance.fr,romance.es' AS nearest FROM outputs_r WHERE value NOT IN (SELECT path FROM taxonomy_r) AND value <> 'abstain'")
_add("a02_valid_leaf", "outputs taxonomy", A.valid_leaf, "SELECT item_id, value, CASE WHEN c.k IS NULL THEN 'pass' ELSE 'fail' END AS status, coalesce(c.k, '') AS children FROM outputs_r JOIN taxonomy_r t ON t.path = value LEFT JOIN (SELECT parent, string_agg(path, ',' ORDER BY path) AS k FROM taxonomy_r GROUP BY parent) c ON c.parent = t.path")
_add("a03_abstention_allowed", "outputs", A.abstention_allowed, f"SELECT item_id, 'fail' AS status FROM outputs_r WHERE {DECLINES}")
_add("a04_abstention_rate", "outputs", A.abstention_rate, f"g AS (SELECT count(*) AS n, count(*) FILTER ({DECLINES}) AS abstained FROM outputs_r) SELECT n, abstained, round(abstained / n, 6) AS rate, CASE WHEN n = 0 THEN 'unscored' WHEN abstained / n > 0.2 THEN 'fail' WHEN abstained / n >= 0.01 THEN 'pass' WHEN 1 / n > 0.01 THEN 'unscored' ELSE 'fail' END AS status FROM g")
_SHARES = f"s AS (SELECT value AS label, count(*) AS n, count(*) / sum(count(*)) OVER () AS share FROM outputs_r WHERE NOT {DECLINES} GROUP BY value)"
_add("a05_label_shares", "outputs", lambda o: A.label_shares(o).withColumn("share", F.round("share", 6)), _SHARES + " SELECT label, n, round(share, 6) AS share FROM s")
_add("a06_label_collapse", "outputs", A.label_collapse, _SHARES + " SELECT label, round_even(share, 4) AS share, (SELECT count(*) FROM s) AS labels, CASE WHEN share <= 0.5 THEN 'pass' ELSE 'fail' END AS status FROM s ORDER BY n DESC, label LIMIT 1")
_DRIFT = "a AS (SELECT label, count(*) / sum(count(*)) OVER () AS s FROM before_r GROUP BY label), b AS (SELECT label, count(*) / sum(count(*)) OVER () AS s FROM after_r GROUP BY label), d AS (SELECT coalesce(a.label, b.label) AS label, round_even(coalesce(b.s, 0) - coalesce(a.s, 0), 4) AS delta FROM a FULL JOIN b ON a.label = b.label)"
_add("a07_drift", "before after", A.drift, _DRIFT + " SELECT label, delta, CASE WHEN abs(delta) <= 0.1 THEN 'pass' ELSE 'fail' END AS status FROM d ORDER BY abs(delta) DESC, label LIMIT 1")
_STOP = ", ".join(f"'{w}'" for w in A.STOPLIST)
_VOCAB = f"n AS (SELECT path, parent, regexp_extract_all(lower(name || ' ' || replace(path, '.', ' ') || ' ' || definition), '[a-z0-9]+') AS w FROM taxonomy_r), v AS (SELECT DISTINCT path, word FROM (SELECT path, unnest(w) AS word FROM n UNION ALL SELECT n.path, unnest(p.w) FROM n JOIN n p ON p.path = n.parent) WHERE length(word) >= 3 AND word NOT IN ({_STOP}))"
_add("i01_vocabulary", "taxonomy", A.vocabulary, _VOCAB + " SELECT path, word FROM v")
_add("i02_cross_field_agreement", "outputs items taxonomy", A.cross_field_agreement, _VOCAB + f", l AS (SELECT path, list(word) AS vocab FROM v GROUP BY path), j AS (SELECT o.item_id, CASE WHEN trim(i.text) <> '' AND l.vocab IS NOT NULL AND NOT {DECLINES} THEN len(list_intersect(list_distinct(regexp_extract_all(lower(i.text), '[a-z0-9]+')), l.vocab))::DOUBLE END AS score FROM outputs_r o JOIN items_r i USING (item_id) LEFT JOIN l ON l.path = o.value) SELECT item_id, CASE WHEN score IS NULL THEN 'unscored' WHEN score > 0 THEN 'pass' ELSE 'fail' END AS status, score FROM j")

_W = "regexp_extract_all(lower({0}), '[a-z0-9][a-z0-9''’\\-]*')"
_add("f01_length_in_bounds", "items", lambda i: T.length_in_bounds(i, 5, 400), f"w AS (SELECT item_id, text, len({_W.format('text')}) AS n FROM items_r) SELECT item_id, n AS n_words, CASE WHEN trim(text) <> '' AND n BETWEEN 5 AND 400 THEN 'pass' ELSE 'fail' END AS status FROM w")
_RARE = "c AS (SELECT token, count(*) AS n FROM (SELECT unnest(list_distinct({0})) AS token FROM {1}) GROUP BY token), rare AS (SELECT token, n FROM c WHERE n <= (SELECT greatest(1, floor(count(*) * 0.05)) FROM {1}))"
_add("f02_rare_tokens", "items", T.rare_tokens, _RARE.format(_W.format("text"), "items_r") + " SELECT token, n FROM rare")
_add("f03_specificity", "pairs", T.specificity, _RARE.format(_W.format("source"), "pairs_r") + f", h AS (SELECT item_id, unnest(list_distinct({_W.format('source')})) AS token FROM pairs_r), s AS (SELECT item_id, unnest(list_distinct({_W.format('written')})) AS token, 1 AS said FROM pairs_r), g AS (SELECT h.item_id, count(*) AS available, count(said) AS used FROM h JOIN rare USING (token) LEFT JOIN s ON s.item_id = h.item_id AND s.token = h.token GROUP BY h.item_id) SELECT item_id, coalesce(available, 0) AS available, coalesce(used, 0) AS used, CASE WHEN coalesce(available, 0) = 0 THEN 'unscored' WHEN used > 0 THEN 'pass' ELSE 'fail' END AS status FROM pairs_r LEFT JOIN g USING (item_id)")
_RUN = f"a AS (SELECT item_id, unnest({_W.format('source')}) AS token, generate_subscripts({_W.format('source')}, 1) AS i FROM pairs_r), b AS (SELECT item_id, unnest({_W.format('written')}) AS token, generate_subscripts({_W.format('written')}, 1) AS j FROM pairs_r), m AS (SELECT item_id, i - j AS d, i, i - row_number() OVER (PARTITION BY item_id, i - j ORDER BY i) AS g FROM a JOIN b USING (item_id, token)), r AS (SELECT item_id, max(n) AS run FROM (SELECT item_id, d, g, count(*) AS n FROM m GROUP BY ALL) GROUP BY item_id), runs AS (SELECT item_id, coalesce(run, 0) AS run, len({_W.format('written')}) AS n FROM pairs_r LEFT JOIN r USING (item_id))"
_add("f04_longest_shared_run", "pairs", T.longest_shared_run, _RUN + " SELECT item_id, run FROM runs")
_add("f05_copy_ratio", "pairs", T.copy_ratio, _RUN + " SELECT item_id, round(run / n, 6) AS ratio, CASE WHEN run / n > 0.5 THEN 'fail' ELSE 'pass' END AS status FROM runs WHERE n > 0")
_SHINGLES = f"w AS (SELECT item_id, {_W.format('text')} AS w FROM items_r), s AS (SELECT DISTINCT item_id, array_to_string(w[i : i + 4], ' ') AS x FROM w, unnest(range(1, greatest(1, len(w) - 4) + 1)) AS t(i) WHERE len(w) > 0)"
_add("f06_shingles", "items", lambda i: T.shingles(i).groupBy("item_id").agg(F.count("*").alias("n")), _SHINGLES + " SELECT item_id, count(*) AS n FROM s GROUP BY item_id")
_add("f07_boilerplate", "items", T.boilerplate, _SHINGLES + ", p AS (SELECT x FROM s GROUP BY x HAVING count(*) BETWEEN 2 AND 200), u AS (SELECT s.* FROM s JOIN p USING (x)), c AS (SELECT DISTINCT a.item_id AS l, b.item_id AS r FROM u a JOIN u b ON a.x = b.x AND a.item_id < b.item_id), n AS (SELECT item_id, count(*) AS n FROM s GROUP BY item_id), k AS (SELECT c.l, c.r, count(*) AS k FROM c JOIN s a ON a.item_id = c.l JOIN s b ON b.item_id = c.r AND b.x = a.x GROUP BY c.l, c.r) SELECT l AS left, r AS right, round(k / (x.n + y.n - k), 6) AS similarity FROM k JOIN n x ON x.item_id = l JOIN n y ON y.item_id = r WHERE k / (x.n + y.n - k) >= 0.8")

_NUM = lambda c: f"CASE WHEN regexp_full_match(regexp_replace(regexp_replace(replace({c}, ',', ''), '[^0-9.+-]', '', 'g'), '\\.$', ''), '[+-]?([0-9]+(\\.[0-9]*)?|\\.[0-9]+)') THEN TRY_CAST(regexp_replace(regexp_replace(replace({c}, ',', ''), '[^0-9.+-]', '', 'g'), '\\.$', '') AS DOUBLE) END"
_MASK = "regexp_replace(regexp_replace(regexp_replace(source, '\\b([0-9]{4})-([0-9]{2})-([0-9]{2})\\b', ' # ', 'g'), '\\b([A-Z][a-z]+)\\.? ([0-9]{1,2}),? ([0-9]{4})\\b', ' # ', 'g'), '\\b([0-9]{1,2})(?:st|nd|rd|th)? ([A-Z][a-z]+)\\.? ([0-9]{4})\\b', ' # ', 'g')"
_CAND = f"regexp_extract_all({_MASK}, '[0-9][0-9,. ]*')"
_add("c01_normalise", "items", lambda i: i.select("item_id", F.sha2(C.normalise(F.col("text")), 256).alias("digest")), "SELECT item_id, sha256(lower(trim(regexp_replace(text, '[ \\t\\n\\r\\f\\v]+', ' ', 'g')))) AS digest FROM items_r")
_add("c02_parse_number", "copied", lambda c: c.select("item_id", C.parse_number(F.col("number")).alias("number")), f"SELECT item_id, {_NUM('number')} AS number FROM copied_r")
_add("c03_parse_date", "copied", lambda c: c.select("item_id", C.parse_date(F.col("date")).cast("string").alias("date")), "SELECT item_id, CASE WHEN regexp_matches(date, '^[0-9]{4}-[0-9]{2}-[0-9]{2}$') THEN TRY_CAST(date AS DATE)::VARCHAR WHEN regexp_matches(date, '^[A-Z][a-z]+ [0-9]{1,2}, [0-9]{4}$') THEN try_strptime(date, '%B %d, %Y')::DATE::VARCHAR END AS date FROM copied_r")
_add("c04_candidates", "copied", lambda c: c.select("item_id", F.array_join(C.candidates(F.col("source"), "number"), "|").alias("spans")), f"SELECT item_id, array_to_string({_CAND}, '|') AS spans FROM copied_r")
_add("c08_value_shape", "copied", lambda c: C.value_shape(c, "number", "number"), f"SELECT item_id, CASE WHEN {_NUM('number')} IS NULL THEN 'fail' ELSE 'pass' END AS status FROM copied_r WHERE trim(number) <> ''")
_HELD = f"x AS (SELECT item_id, {_NUM('number')} AS v, {_CAND} AS c FROM copied_r), y AS (SELECT item_id, v, len(c) AS candidates, list_bool_or(list_transform(c, lambda z: coalesce({_NUM('z')} = v, false))) AS hit FROM x), z AS (SELECT item_id, CASE WHEN v IS NULL THEN 'unscored' WHEN hit THEN 'pass' ELSE 'fail' END AS status, candidates FROM y)"
_add("c09_value_in_source", "copied", lambda c: C.value_in_source(c, "number", "number"), _HELD + " SELECT * FROM z")
_add("c10_ambiguous", "copied", lambda c: C.ambiguous(c, "number", 2), f"SELECT item_id, len({_CAND}) AS candidates FROM copied_r WHERE len({_CAND}) > 2")
_add("c11_grounding_rate", "copied", lambda c: C.grounding_rate(c, "number", "number"), _HELD + ", g AS (SELECT count(*) FILTER (status = 'pass') AS grounded, count(*) FILTER (status <> 'unscored') AS checkable FROM z) SELECT grounded, checkable, round(grounded / checkable, 6) AS rate, CASE WHEN checkable = 0 THEN 'unscored' WHEN grounded / checkable >= 0.95 THEN 'pass' ELSE 'fail' END AS status FROM g")
_add("c12_value_matches_human", "copied", lambda c: C.value_matches_human(c, "number", "human", "number"), f"SELECT item_id, CASE WHEN {_NUM('number')} IS NULL THEN 'unscored' WHEN {_NUM('number')} = {_NUM('human')} THEN 'pass' ELSE 'fail' END AS status FROM copied_r")

_add("s06_items", "items", lambda i: i.select("item_id", F.length("text").cast("long").alias("length")), "SELECT item_id, length(text) AS length FROM items_r")
_add("s07_outputs_long", "outputs", lambda o: o.select("item_id", F.lit("lang").alias("field"), "value"), "SELECT item_id, 'lang' AS field, value FROM outputs_r")
_add("s08_labels", "labels", lambda x: x, "SELECT * FROM labels_r")
_add("s09_duplicate_ids", "generations", R.duplicate_ids, "SELECT item_id, count(*) AS n FROM generations_r GROUP BY item_id HAVING count(*) > 1")
_add("s10_load_log", "items second_run", R.load_log, "SELECT 'empty text' AS reason, count(*) AS n FROM items_r WHERE trim(coalesce(text, '')) = '' UNION ALL SELECT 'output without item', count(*) FROM second_run_r s ANTI JOIN items_r i USING (item_id) UNION ALL SELECT 'item without output', count(*) FROM items_r i ANTI JOIN second_run_r s USING (item_id) WHERE trim(i.text) <> '' UNION ALL SELECT 'kept', count(*) FROM items_r i SEMI JOIN second_run_r s USING (item_id) WHERE trim(i.text) <> ''")
_add("s10b_last_outputs", "outputs", R.last_outputs, "SELECT item_id, arg_max(value, ord) AS value FROM outputs_r GROUP BY item_id")
_add("p02_judgeable", "outputs", lambda o: o.filter(A.is_judgeable(F.col("value"))).select("item_id"), f"SELECT item_id FROM outputs_r WHERE NOT {DECLINES} AND trim(value) <> ''")
_add("p05_flagged", "outputs taxonomy", lambda o, t: A.label_in_taxonomy(o, t).filter("status = 'fail'").select("item_id").union(A.valid_leaf(o, t).filter("status = 'fail'").select("item_id")).distinct(), f"SELECT DISTINCT item_id FROM outputs_r LEFT JOIN taxonomy_r ON path = value WHERE NOT {DECLINES} AND (path IS NULL OR NOT is_leaf)")
_add("p07_modes", "labels", R.modes, "g AS (SELECT item_id, count(DISTINCT annotator) AS k FROM labels_r GROUP BY item_id) SELECT CASE WHEN count(*) = 0 THEN 0 WHEN count(*) FILTER (k > 1) > 0 THEN 2 ELSE 1 END::BIGINT AS mode, count(*) AS labelled, count(*) FILTER (k > 1) AS twice FROM g")
_add("p09_scope", "items", lambda i: i.orderBy("ord").limit(100).select("item_id"), "SELECT item_id FROM items_r ORDER BY ord LIMIT 100")

_PRIMARY = "p AS (SELECT item_id, arg_min(label, annotator) AS label FROM labels_r GROUP BY item_id)"
_BUCKET = _PRIMARY + f", b AS (SELECT o.item_id, o.value AS predicted, p.label AS truth, CASE WHEN {DECLINES} THEN 'abstained' WHEN x.path IS NULL OR y.path IS NULL THEN 'unknown' WHEN value = label THEN 'exact' WHEN starts_with(label, value || '.') THEN 'too_shallow' WHEN x.parent = y.parent THEN 'right_parent' ELSE 'wrong' END AS bucket FROM outputs_r o JOIN p USING (item_id) LEFT JOIN taxonomy_r x ON x.path = o.value LEFT JOIN taxonomy_r y ON y.path = p.label)"
_CONF = _BUCKET + ", c AS (SELECT truth, predicted, count(*) AS n FROM b WHERE bucket NOT IN ('exact', 'abstained') GROUP BY truth, predicted ORDER BY n DESC, truth, predicted LIMIT 10)"
_PER = _BUCKET + ", l AS (SELECT coalesce(s.label, d.label) AS label, coalesce(support, 0) AS support, coalesce(predicted, 0) AS predicted, coalesce(correct, 0) AS correct FROM (SELECT truth AS label, count(*) AS support, count(*) FILTER (bucket = 'exact') AS correct FROM b GROUP BY truth) s FULL JOIN (SELECT predicted AS label, count(*) AS predicted FROM b WHERE bucket <> 'abstained' GROUP BY predicted) d ON s.label = d.label), q AS (SELECT *, correct / nullif(predicted, 0) AS p, correct / nullif(support, 0) AS r FROM l), f AS (SELECT label, support, predicted, correct, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p > 0 AND r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support < 30 AS under_floor, coalesce(r < 0.5, false) AS weak FROM q)"
_OLT = "outputs labels taxonomy"
_with = lambda f: lambda o, l, t: f(M.buckets(o, l, t))
_add("m01_primary_labels", "labels", M.primary_labels, _PRIMARY + " SELECT * FROM p")
_add("m02_buckets", _OLT, M.buckets, _BUCKET + " SELECT * FROM b")
_add("m03_confusion", _OLT, _with(M.confusion), _CONF + " SELECT * FROM c")
_add("m04_precision_recall_f1", _OLT, _with(M.per_label), _PER + " SELECT * FROM f")
_add("m05_accuracy_macro_f1", _OLT, _with(M.accuracy), _PER + ", g AS (SELECT count(*) AS n, count(*) FILTER (bucket = 'exact') AS exact FROM b), h AS (SELECT max(support) AS most, avg(f1) AS m FROM f WHERE support > 0) SELECT n, exact, round(exact / n, 6) AS accuracy, round(most / n, 6) AS majority, exact / n > most / n AS beats_majority, round(m, 6) AS macro_f1 FROM g, h")
_add("m07_confusion_direction", _OLT, _with(M.confusion_direction), _CONF + ", d AS (SELECT least(truth, predicted) AS one, greatest(truth, predicted) AS other, sum(n)::BIGINT AS n, sum(CASE WHEN truth < predicted THEN n ELSE 0 END)::BIGINT AS f FROM c GROUP BY 1, 2) SELECT one, other, n, round(greatest(f, n - f) / n, 6) AS heavier, CASE WHEN n < 10 THEN 'too few to tell' WHEN greatest(f, n - f) / n >= 0.8 THEN 'asymmetric' ELSE 'symmetric' END AS reading FROM d ORDER BY n DESC, one, other LIMIT 5")
_add("m08_label_findings", _OLT, _with(M.label_findings), _BUCKET + " SELECT item_id, CASE bucket WHEN 'exact' THEN 'pass' WHEN 'abstained' THEN 'unscored' ELSE 'fail' END AS status, bucket FROM b")
_add("m09_screen", "verdicts", M.screen, "g AS (SELECT judge, count(*) AS calls, count(*) FILTER (status = 'pass') AS approvals, count(*) FILTER (status = 'fail') AS rejections, count(*) FILTER (status = 'cannot_decide') AS cannot_decide, count(*) FILTER (status = 'unparseable') AS unparseable, count(*) FILTER (status = 'error') AS errors FROM verdicts_r GROUP BY judge), r AS (SELECT *, approvals / nullif(approvals + rejections, 0) AS a, unparseable / calls AS u FROM g) SELECT * EXCLUDE (a, u), round(a, 6) AS approval, round(u, 6) AS unreadable, CASE WHEN a IS NULL OR a NOT BETWEEN 0.02 AND 0.98 OR u > 0.05 THEN 'stop' WHEN a NOT BETWEEN 0.15 AND 0.85 OR u > 0.02 THEN 'warn' ELSE 'ok' END AS flag FROM r")
_add("m11_unreadable_items", "verdicts", M.unreadable_items, "SELECT count(*) FILTER (status = 'unparseable') AS n, round_even(avg(words) FILTER (status = 'unparseable'), 1) AS mean_failed, round_even(avg(words), 1) AS mean_all FROM verdicts_r")
_add("m12_sample_items", "items", lambda i: M.sample_items(i, 300), "SELECT item_id FROM items_r ORDER BY sha256(concat('panel', chr(0), item_id)) LIMIT 300")
_MAJ = "mj AS (SELECT item_id, count(*) FILTER (status = 'pass') AS approvals, count(*) FILTER (status IN ('pass', 'fail')) AS votes FROM verdicts_r GROUP BY item_id)"
_add("m13_majority", "verdicts", M.majority, _MAJ + " SELECT *, CASE WHEN approvals * 2 > votes THEN 'pass' WHEN approvals * 2 < votes THEN 'fail' ELSE 'unscored' END AS status FROM mj")
_JP = "d AS (SELECT item_id, judge, (status = 'pass')::INT AS v FROM verdicts_r WHERE status IN ('pass', 'fail')), jp AS (SELECT l.item_id, l.judge AS left, r.judge AS right, l.v AS a, r.v AS b FROM d l JOIN d r ON l.item_id = r.item_id AND l.judge < r.judge)"
_PHI = _JP + ", ph AS (SELECT \"left\", \"right\", count(*) AS n, round(avg((a = b)::INT), 6) AS agreement, round(CASE WHEN var_pop(a) > 0 AND var_pop(b) > 0 THEN covar_pop(a, b) / sqrt(var_pop(a) * var_pop(b)) END, 6) AS phi FROM jp GROUP BY ALL)"
_add("m15_pairwise_agreement", "verdicts", M.pairwise_agreement, _PHI + " SELECT * FROM ph")
_add("m17_effective_votes", "verdicts", M.effective_votes, _PHI + ", e AS (SELECT (SELECT count(DISTINCT judge) FROM verdicts_r) AS m, avg(phi) AS rho FROM ph) SELECT m AS judges, round(rho, 6) AS rho, round(CASE WHEN 1 + (m - 1) * rho <= 0 THEN m ELSE least(m, m / (1 + (m - 1) * rho)) END, 6) AS votes, least(m, m / (1 + (m - 1) * rho)) < 0.5 * m AS warn FROM e")
_add("m18_leniency", "verdicts", M.leniency, _JP + " SELECT \"left\", \"right\", count(*) AS splits, count(*) FILTER (a = 1) AS left_approved FROM jp WHERE a <> b GROUP BY ALL")
_add("m19_fuzzy_pairs", "verdicts outputs taxonomy", M.fuzzy_pairs, _MAJ + ", s AS (SELECT DISTINCT v.item_id, value, instead FROM verdicts_r v JOIN mj USING (item_id) JOIN outputs_r USING (item_id) JOIN taxonomy_r ON path = instead WHERE status = 'fail' AND instead <> value AND approvals > 0 AND approvals < votes) SELECT least(value, instead) AS one, greatest(value, instead) AS other, count(*) AS n FROM s GROUP BY 1, 2 ORDER BY n DESC, 1, 2 LIMIT 5")
_add("m20_annotator_agreement", "labels", M.annotator_agreement, "x AS (SELECT least(a.label, b.label) AS one, greatest(a.label, b.label) AS other, count(*) AS n FROM labels_r a JOIN labels_r b ON a.item_id = b.item_id AND a.annotator < b.annotator GROUP BY 1, 2), y AS (SELECT sum(n)::BIGINT AS pairs, sum(n) FILTER (one = other)::BIGINT AS agreed, max(n) FILTER (one <> other) AS top FROM x) SELECT pairs, agreed, round(agreed / pairs, 6) AS agreement, round(top / nullif(pairs - agreed, 0), 6) AS concentration FROM y")
_RIGHT = _PRIMARY + ", jr AS (SELECT v.item_id, judge, confidence, status = 'pass' AS approved, coalesce(value = label, false) AS ok FROM verdicts_r v JOIN outputs_r USING (item_id) JOIN p USING (item_id) WHERE status IN ('pass', 'fail')), jc AS (SELECT judge, confidence, approved = ok AS ok FROM jr)"
_VOL = "verdicts outputs labels"
_add("m22_judge_direction", _VOL, M.judge_direction, _RIGHT + ", g AS (SELECT judge, count(*) AS n, count(*) FILTER (approved AND NOT ok) AS approves_wrong, count(*) FILTER (NOT approved AND ok) AS rejects_right, round(avg((approved = ok)::INT), 6) AS accuracy, round(avg(ok::INT), 6) AS always_approve FROM jr GROUP BY judge) SELECT *, CASE WHEN approves_wrong > 1.5 * rejects_right THEN 'lenient' WHEN rejects_right > 1.5 * approves_wrong THEN 'strict' ELSE 'balanced' END AS direction FROM g")
_REL = _RIGHT + ", r AS (SELECT CASE " + " ".join(f"WHEN confidence < {(k + 1) / 10!r} THEN {k}" for k in range(9)) + " ELSE 9 END::BIGINT AS bin, count(*) AS n, round(avg(confidence), 6) AS stated, round(avg(ok::INT), 6) AS observed, count(*) >= 20 AS reportable FROM jc WHERE confidence IS NOT NULL GROUP BY 1)"
_pairs = lambda f: lambda v, o, l: f(K.judged_pairs(v, o, l))
_add("m23_confidence_pairs", _VOL, lambda v, o, l: K.judged_pairs(v, o, l).groupBy("judge", "right").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("mean")), _RIGHT + " SELECT judge, ok AS right, count(*) AS n, round(avg(confidence), 6) AS mean FROM jc GROUP BY 1, 2")
_add("m24_reliability", _VOL, _pairs(K.reliability), _REL + " SELECT * FROM r")
_add("m25_calibration_quality", _VOL, _pairs(K.calibration_quality), _REL + ", q AS (SELECT count(*) AS n, avg((confidence - ok::INT) ** 2) AS b, avg(ok::INT) AS m FROM jc WHERE confidence IS NOT NULL) SELECT n, round((SELECT sum(n * abs(stated - observed)) FROM r) / n, 5) AS ece, round(b, 6) AS brier, round(m * (1 - m), 6) AS brier_base_rate, b < m * (1 - m) AS beats_base_rate FROM q")

_RAW = "rc AS (SELECT item_id, round(max(CASE status WHEN 'fail' THEN confidence WHEN 'pass' THEN 1 - confidence END), 6) AS score FROM verdicts_r GROUP BY item_id)"
_TARGET = _PRIMARY + ", tg AS (SELECT item_id, NOT coalesce(value = label, false) AS error FROM p JOIN outputs_r USING (item_id))"
_add("t01_raw_confidence", "verdicts", K.raw_confidence, _RAW + " SELECT * FROM rc")
_add("t03_random", "items", K.hash_uniform, "SELECT item_id, ('0x' || substr(sha256(concat('random', chr(0), item_id)), 1, 8))::BIGINT / 4294967296.0::DOUBLE AS score FROM items_r")
_add("t04_output_length", "items", K.output_length, "SELECT item_id, CASE WHEN trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ')) END::DOUBLE AS score FROM items_r")
_add("t05_majority_label", "outputs", K.majority_label, "m AS (SELECT value AS top FROM outputs_r WHERE value IS NOT NULL GROUP BY value ORDER BY count(*) DESC, value LIMIT 1) SELECT item_id, coalesce((value <> top)::INT, 1)::DOUBLE AS score FROM outputs_r, m")
_add("t06_panel_disagreement", "verdicts", K.panel_disagreement, _MAJ + " SELECT item_id, CASE WHEN votes >= 2 THEN round(1 - abs(2 * (approvals / votes) - 1), 6) END AS score FROM mj")
_add("t08_risk_rows", "verdicts", lambda v: K.risk_rows(K.raw_confidence(v), v), _RAW + ", c AS (SELECT item_id, round(avg(confidence), 6) AS raw_confidence_mean FROM verdicts_r GROUP BY item_id) SELECT * FROM rc LEFT JOIN c USING (item_id) ORDER BY score DESC NULLS LAST, item_id LIMIT 100")
_add("t10_build_target", "outputs labels", K.build_target, _TARGET + " SELECT * FROM tg")
_add("t11_degenerate_target", "outputs labels", lambda o, l: K.degenerate_target(K.build_target(o, l)), _TARGET + ", g AS (SELECT count(*) AS n, count(*) FILTER (error) AS errors FROM tg) SELECT n, errors, least(errors, n - errors) AS minority, least(errors, n - errors) < 30 OR least(errors, n - errors) < 0.05 * n AS degenerate FROM g")
_add("t12_auc", "ratings", K.auc, "k AS (SELECT error, rank() OVER (ORDER BY score) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM ratings_r), g AS (SELECT count(*) AS n, count(*) FILTER (error) AS errors, sum(r) FILTER (error) AS s FROM k) SELECT n, errors, round((s - errors * (errors + 1) / 2) / (errors * (n - errors)), 6) AS auc FROM g")
_add("t16_recall_at_budget", "ratings", K.recall_at_budget, "c AS (SELECT score, count(*) AS n, count(*) FILTER (error) AS pos FROM ratings_r GROUP BY score), a AS (SELECT *, coalesce(sum(n) OVER (ORDER BY score DESC ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before FROM c), t AS (SELECT sum(n) AS total, sum(pos) AS errors FROM c), b AS (SELECT unnest([0.005, 0.01, 0.02, 0.05, 0.1, 0.2]::DOUBLE[]) AS budget), k AS (SELECT budget, least(greatest(1, round_even(budget * total, 0)::BIGINT), total)::BIGINT AS k, errors FROM b, t), s AS (SELECT budget, k, errors, sum(pos * (greatest(0, least(n, k - before)) / n)) AS caught FROM a, k GROUP BY ALL) SELECT budget, k, round(caught / errors, 6) AS recall, round(caught / k, 6) AS precision FROM s")
_FIND = lambda o, t: A.label_in_taxonomy(o, t).select("item_id", F.lit("label_in_taxonomy").alias("check"), "status").union(A.valid_leaf(o, t).select("item_id", F.lit("valid_leaf").alias("check"), "status"))
_FINDINGS = f"fi AS (SELECT item_id, CASE WHEN path IS NULL THEN 'fail' ELSE 'pass' END AS status FROM outputs_r LEFT JOIN taxonomy_r ON path = value WHERE NOT {DECLINES} UNION ALL SELECT item_id, CASE WHEN is_leaf THEN 'pass' ELSE 'fail' END FROM outputs_r JOIN taxonomy_r ON path = value)"
_add("r01_grain_rates", "outputs taxonomy", lambda o, t: M.grain_rates(_FIND(o, t)), _FINDINGS + ", i AS (SELECT item_id, bool_and(status = 'pass') AS ok FROM fi GROUP BY item_id) SELECT (SELECT count(*) FROM fi) AS findings, (SELECT count(*) FROM i) AS items, (SELECT round(avg((status = 'pass')::INT), 6) FROM fi) AS field_rate, (SELECT round(avg(ok::INT), 6) FROM i) AS item_rate")
_add("r02_unjudged", "outputs verdicts", K.unjudged, f"v AS (SELECT item_id, arg_min(status, judge) AS said FROM verdicts_r GROUP BY item_id) SELECT item_id, CASE WHEN {DECLINES} OR coalesce(said NOT IN ('pass', 'fail'), true) THEN 'unscored' ELSE said END AS status FROM outputs_r LEFT JOIN v USING (item_id)")
_FLAG = f"fl AS (SELECT DISTINCT item_id FROM outputs_r LEFT JOIN taxonomy_r ON path = value WHERE NOT {DECLINES} AND path IS NULL), rest AS (SELECT item_id FROM items_r ANTI JOIN fl USING (item_id)), gp AS (SELECT item_id, 'flagged' AS reason FROM fl UNION ALL SELECT * FROM (SELECT item_id, 'audit' FROM rest ORDER BY sha256(concat('audit:value', chr(0), item_id)) LIMIT (SELECT greatest(1, round_even(count(*) * 0.1, 0))::BIGINT FROM rest)))"
_bad = lambda o, t: A.label_in_taxonomy(o, t).filter("status = 'fail'")
_add("r06_gated_plan", "outputs taxonomy items", lambda o, t, i: K.gated_plan(_bad(o, t), i), _FLAG + " SELECT * FROM gp")
_add("r07_gate_quality", "outputs taxonomy items labels", lambda o, t, i, l: K.gate_quality(K.gated_plan(_bad(o, t), i), K.build_target(o, l)), _FLAG + ", " + _TARGET + ", g AS (SELECT count(*) FILTER (reason = 'flagged') AS flagged, count(*) FILTER (reason = 'flagged' AND error) AS flagged_wrong, count(*) FILTER (reason = 'audit') AS audited, count(*) FILTER (reason = 'audit' AND error) AS audited_wrong FROM gp JOIN tg USING (item_id)) SELECT *, round(flagged_wrong / nullif(flagged, 0), 6) AS precision, round(audited_wrong / nullif(audited, 0), 6) AS miss_rate FROM g")
_add("x06_merged_labels", "migration", R.merged_labels, "SELECT new, count(*) AS n, string_agg(old, ',' ORDER BY old) AS olds FROM migration_r WHERE new IS NOT NULL GROUP BY new HAVING count(*) > 1")
_add("k02_outcome_by_item", "outputs taxonomy", lambda o, t: R.outcome_by_item(_FIND(o, t)), _FINDINGS + " SELECT item_id, bool_and(status = 'pass') AS ok FROM fi GROUP BY item_id")
_add("k05_changes", "outputs second_run taxonomy", lambda o, s, t: R.changes(R.outcome_by_item(A.label_in_taxonomy(o, t)), R.outcome_by_item(A.label_in_taxonomy(s, t))), f"a AS (SELECT item_id, path IS NOT NULL AS ok FROM outputs_r LEFT JOIN taxonomy_r ON path = value WHERE NOT {DECLINES}), b AS (SELECT item_id, path IS NOT NULL AS ok FROM second_run_r LEFT JOIN taxonomy_r ON path = value WHERE NOT {DECLINES}) SELECT CASE WHEN a.ok IS NULL THEN 'only_in_b' WHEN b.ok IS NULL THEN 'only_in_a' WHEN a.ok = b.ok THEN 'unchanged' WHEN b.ok THEN 'improved' ELSE 'regressed' END AS change, count(*) AS n FROM a FULL JOIN b USING (item_id) GROUP BY 1")
_add("k06_distribution_shift", "outputs second_run migration", R.distribution_shift, "a AS (SELECT new AS label, count(*) / sum(count(*)) OVER () AS s FROM outputs_r JOIN migration_r ON old = value WHERE new IS NOT NULL GROUP BY new), b AS (SELECT new AS label, count(*) / sum(count(*)) OVER () AS s FROM second_run_r JOIN migration_r ON old = value WHERE new IS NOT NULL GROUP BY new) SELECT coalesce(a.label, b.label) AS label, round(coalesce(a.s, 0), 6) AS before, round(coalesce(b.s, 0), 6) AS after, round_even(coalesce(b.s, 0) - coalesce(a.s, 0), 4) AS delta FROM a FULL JOIN b ON a.label = b.label")
_add("z01_stability", "generations", R.stability, "g AS (SELECT item_id, count(DISTINCT value) AS v FROM generations_r GROUP BY item_id HAVING count(*) > 1), s AS (SELECT count(*) AS items, count(*) FILTER (v = 1) AS agreed FROM g) SELECT items, agreed, round(agreed / items, 6) AS stability, CASE WHEN items = 0 THEN 'unscored' WHEN agreed >= 0.9 * items THEN 'pass' ELSE 'fail' END AS status FROM s")
_add("q01_parse_replies", "replies", R.parse_replies, "e AS (SELECT item_id, TRY_CAST(nullif(regexp_extract(reply, '(?s)\\{.*\\}'), '') AS JSON) AS j FROM replies_r), v AS (SELECT item_id, CASE WHEN json_type(j, '$.correct') = 'BOOLEAN' THEN (j->>'$.correct')::BOOLEAN END AS ok, (j->>'$.confidence')::DOUBLE AS c, j->>'$.instead' AS i, coalesce(j->>'$.correct' = 'cannot_decide', false) AS d FROM e) SELECT item_id, CASE WHEN d THEN 'cannot_decide' WHEN ok IS NULL THEN 'unparseable' WHEN ok THEN 'pass' ELSE 'fail' END AS status, CASE WHEN ok IS NOT NULL AND c BETWEEN 0 AND 1 THEN round(c, 6) END AS confidence, CASE WHEN ok = false THEN i END AS instead FROM v")
_add("q07_scripted_collection", "items", lambda i: R.collect(i.select("item_id", F.col("text").alias("prompt")), R.scripted_provider("judge-a")))
_add("b01_cache_keys", "outputs", lambda o: R.cache_keys(o, "judge-a", "scripted", "v1", "lang"), "SELECT item_id, sha256(concat_ws(chr(0), 'judge-a', 'scripted', 'v1', item_id, 'lang', coalesce(value, ''))) AS key FROM outputs_r")
_add("b02_budget", "spend", lambda s: R.budget(s, 1_000_000), "w AS (SELECT seq, cents, coalesce(sum(cents) OVER (ORDER BY seq ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS spent FROM spend_r) SELECT seq, cents, CASE WHEN spent < 1000000 THEN 'called' ELSE 'unscored' END AS status FROM w")
_add("b03_plan", "items", R.plan, "SELECT count(*) AS calls, sum(length(text) // 4)::BIGINT AS tokens, round(sum(length(text) // 4) / 1e6, 6) AS dollars FROM items_r")

from proofline.plans import audit_queries, contract_queries, evidence_queries, fitted_queries  # noqa: E402, F401  their queries add themselves
