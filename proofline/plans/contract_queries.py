"""Named queries on readers and writers, predicates, joins, gates, judges, trees and reports, with their SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from proofline.functions import gates, settings, taxonomy as trees
from proofline.operators import assigned as A, copied as C, guardrails as U, joins as J, judging as Q, metrics as M, ranking as K, runs as R
from proofline.plans import registry as G
from proofline.plans.projections import with_sql
from proofline.sources import readers, writers
from proofline.sources.scratch import scratch

_add = G._add
_few = lambda df, rows, schema: df.sparkSession.createDataFrame(rows, schema)
_head = lambda sql, *names: sql.removeprefix(with_sql(*names)).removeprefix(", ")


# Readers: the table is written in the format and read again.
def _sum(df: DataFrame, kind: str) -> DataFrame:
    return df.agg(F.count("*").alias("rows"), F.sum(F.col("key").cast("long")).alias("keys")).select(F.lit(kind).alias("source"), "rows", "keys")


def _written(df: DataFrame, ending: str) -> str:
    path = scratch(df.sparkSession, "read") + ending
    if ending == ".csv":
        df.write.option("header", True).csv(path)
    elif ending == ".jsonl":
        writers.write_lines(df, path)
    else:
        df.write.parquet(path)
    return path


def read_rows(rows: DataFrame) -> DataFrame:
    """Every source that the dispatcher knows. The table has 25 rows, so it may pass through the driver."""
    spark, out = rows.sparkSession, None
    held = rows.collect()
    sources = {e: _written(rows, e) for e in (".csv", ".jsonl", ".parquet")} | {"frame": rows, "mappings": [r.asDict() for r in held], "pandas": rows.toPandas()}
    for kind, source in sources.items():
        part = _sum(readers.read_source(spark, source), kind)
        out = part if out is None else out.union(part)
    return out


def jsonl_scan(items: DataFrame) -> DataFrame:
    path = scratch(items.sparkSession, "read") + ".jsonl"
    lines = items.select(F.to_json(F.struct("item_id", "text", "ord")).alias("value"))
    lines.select(F.explode(F.array("value", F.lit("  "))).alias("value")).write.text(path)  # a blank line behind each
    return readers.read_source(items.sparkSession, path).select("item_id", "ord", F.length("text").cast("long").alias("length"))


def csv_scan(customers: DataFrame) -> DataFrame:
    got = readers.read_source(customers.sparkSession, _written(customers, ".csv"))
    return got.select(F.col("item_id").cast("string").alias("item_id"), "name", "segment", F.col("nation").cast("long").alias("nation"))


def in_memory(rows: DataFrame) -> DataFrame:
    held, spark = rows.toPandas(), rows.sparkSession
    kinds = {"mappings": held.to_dict("records"), "pandas": held, "arrow": rows.toArrow()}
    out = None
    for kind, source in kinds.items():
        part = readers.read_source(spark, source).select(F.lit(kind).alias("source"), F.col("key").cast("long").alias("key"), "name")
        out = part if out is None else out.union(part)
    return out


_add("s01_read_rows", "nation_rows", read_rows, " UNION ALL ".join(f"SELECT '{k}' AS source, count(*) AS rows, sum(key)::BIGINT AS keys FROM nation_rows_r" for k in (".csv", ".jsonl", ".parquet", "frame", "mappings", "pandas")))
_add("s02_jsonl_scan", "items", jsonl_scan, "SELECT item_id, ord, length(text) AS length FROM items_r")
_add("s03_csv_scan", "customers", csv_scan, "SELECT item_id, name, segment, nation::BIGINT AS nation FROM customers_r")
_add("s04_parquet_scan", "customers", lambda c: readers.read_source(c.sparkSession, _written(c, ".parquet")).select("item_id", "segment"), "SELECT item_id, segment FROM customers_r")
_add("s05_in_memory", "nation_rows", in_memory, " UNION ALL ".join(f"SELECT '{k}' AS source, key, name FROM nation_rows_r" for k in ("mappings", "pandas", "arrow")))


def logs(verdicts: DataFrame) -> DataFrame:
    """Two appends to the log, read as one."""
    path = scratch(verdicts.sparkSession, "log")
    for part in ("judge = 'judge-a'", "judge <> 'judge-a'"):
        writers.append_verdicts(verdicts.filter(part), path)
    held = verdicts.sparkSession.read.parquet(path)
    return held.groupBy("judge", "status").agg(F.count("*").alias("n"), F.round(F.avg("confidence"), 6).alias("confidence"))


def settings_of(layers: DataFrame) -> DataFrame:
    rows = layers.collect()  # a handful of settings
    block = lambda s: {r.name: r.value for r in rows if r.source == s}
    import yaml

    project = settings.load(yaml.safe_dump(block("settings")))
    return _few(layers, settings.resolved({"field": block("field"), "settings": project}, sorted({r.name for r in rows})), "name string, value double, source string")


_add("s11_verdict_log", "verdicts", logs, "SELECT judge, status, count(*) AS n, round(avg(confidence), 6) AS confidence FROM verdicts_r GROUP BY ALL")
_add("s12_run_names", "run_index", lambda i: writers.run_names(i.withColumnRenamed("ended", "at")), "n AS (SELECT project, run_id, strftime(ended, '%Y-%m-%d_%H%M_') || project AS name FROM run_index_r), k AS (SELECT *, row_number() OVER (PARTITION BY name ORDER BY run_id) AS k FROM n) SELECT project, run_id, CASE WHEN k = 1 THEN name ELSE name || '-' || k END AS name FROM k")
_add("s14_settings", "layers", settings_of, "SELECT name, arg_min(value, p) AS value, arg_min(source, p) AS source FROM (SELECT *, CASE source WHEN 'field' THEN 0 WHEN 'settings' THEN 1 ELSE 2 END AS p FROM layers_r) GROUP BY name")

# Predicates.
_TEXT = lambda c: f"coalesce(regexp_replace({c}, '[ \\t\\n\\r\\f\\v]+', '', 'g') <> '', false)"
_add("p01_is_abstain", "outputs", lambda o: o.select("item_id", A.is_abstain(F.col("value")).alias("abstains")), f"SELECT item_id, {G.DECLINES} AS abstains FROM outputs_r")
_add("p03_free_text_judgeable", "pairs", lambda p: p.select("item_id", Q.has_text(F.col("written")).alias("judgeable")), f"SELECT item_id, {_TEXT('written')} AS judgeable FROM pairs_r")
_add("p04_copied_judgeable", "copied", lambda c: c.select("item_id", Q.has_text(F.col("number")).alias("judgeable")), f"SELECT item_id, {_TEXT('number')} AS judgeable FROM copied_r")
_add("p06_fields_by_kind", "schema_fields", lambda s: s.select("field", F.when(F.col("kind") == "free_text", "defect_rated").otherwise("gold_valued").alias("reads_as")), "SELECT field, CASE kind WHEN 'free_text' THEN 'defect_rated' ELSE 'gold_valued' END AS reads_as FROM schema_fields_r")
_add("p08_label_counts", "labels", lambda x: x.groupBy("item_id").agg(F.countDistinct("annotator").alias("k")).groupBy("k").agg(F.count("*").alias("items")), "SELECT k, count(*) AS items FROM (SELECT item_id, count(DISTINCT annotator) AS k FROM labels_r GROUP BY item_id) GROUP BY k")
_NUMBER, _HUMAN = G._NUM("number"), G._NUM("human")
_add("c05_readable", "copied", lambda c: c.select("item_id", C.parsed(F.col("number"), "number").isNotNull().alias("number"), C.parsed(F.col("date"), "date").isNotNull().alias("date")), f"d AS ({_head(G.ORACLES['c03_parse_date'], 'copied')}) SELECT item_id, {_NUMBER} IS NOT NULL AS number, d.date IS NOT NULL AS date FROM copied_r JOIN d USING (item_id)")
_add(
    "c06_same_value", "copied", lambda c: c.select("item_id", C.same_value(F.col("number"), F.col("human"), "number").alias("as_number"), C.same_value(F.col("number"), F.col("human"), "text").alias("as_text"), C.same_value(F.col("number"), F.col("human"), "number", True).alias("verbatim")),
    f"SELECT item_id, {_NUMBER} = {_HUMAN} AS as_number, lower(trim(regexp_replace(number, '\\s+', ' ', 'g'))) = lower(trim(regexp_replace(human, '\\s+', ' ', 'g'))) AS as_text, trim(number) = trim(human) AS verbatim FROM copied_r",
)
_add(
    "c07_found", "copied", lambda c: c.select("item_id", C.found(F.col("number"), F.col("source"), "number").alias("as_number"), C.found(F.col("number"), F.col("source"), "text").alias("as_text"), C.found(F.col("number"), F.col("source"), "number", True).alias("verbatim")),
    G._HELD + ", t AS (SELECT item_id, contains(lower(trim(regexp_replace(source, '\\s+', ' ', 'g'))), lower(trim(regexp_replace(number, '\\s+', ' ', 'g')))) AS as_text, contains(source, trim(number)) AS verbatim FROM copied_r) SELECT item_id, CASE status WHEN 'pass' THEN true WHEN 'fail' THEN false END AS as_number, as_text, verbatim FROM z JOIN t USING (item_id)",
)

# Joins.
_add("j01_outputs_with_items", "second_run items", lambda o, i: J.outputs_with_items(o, i).select("item_id", "value", F.length("text").cast("long").alias("length")), "SELECT item_id, value, length(text) AS length FROM second_run_r JOIN items_r USING (item_id)")
_add("j02_items_without_outputs", "items second_run", lambda i, o: J.items_without_outputs(i, o).select("item_id"), "SELECT item_id FROM items_r ANTI JOIN second_run_r USING (item_id)")
_add("j03_values_in_tree", "outputs taxonomy", J.values_in_tree, "SELECT item_id, value, path IS NOT NULL AS known, is_leaf FROM outputs_r LEFT JOIN taxonomy_r ON path = value")
_add("j04_answers_with_truth", "outputs labels", J.answers_with_truth, G._PRIMARY + " SELECT item_id, value, label FROM outputs_r JOIN p USING (item_id)")
_add("j05_verdicts_with_truth", "verdicts outputs labels", J.verdicts_with_truth, G._PRIMARY + " SELECT item_id, judge, status, value, label FROM verdicts_r JOIN outputs_r USING (item_id) JOIN p USING (item_id)")
_add("j06_findings_with_ratings", "outputs taxonomy ratings_boxes", lambda o, t, r: J.findings_with_ratings(G._FIND(o, t).filter("check = 'valid_leaf'"), r), "h AS (SELECT item_id, string_agg(DISTINCT label, ',' ORDER BY label) AS boxes FROM ratings_boxes_r GROUP BY item_id) SELECT item_id, 'valid_leaf' AS \"check\", CASE WHEN is_leaf THEN 'pass' ELSE 'fail' END AS status, boxes FROM outputs_r JOIN taxonomy_r ON path = value JOIN h USING (item_id)")
_add("j07_judge_by_judge", "verdicts", J.judge_by_judge, G._JP + " SELECT * FROM jp")
_add("j08_annotator_by_annotator", "labels", J.annotator_by_annotator, "SELECT a.item_id, a.annotator AS \"left\", b.annotator AS \"right\", a.label AS a, b.label AS b FROM labels_r a JOIN labels_r b ON a.item_id = b.item_id AND a.annotator < b.annotator")
_add("j09_texts_by_shingle", "items", J.texts_by_shingle, G._SHINGLES + ", p AS (SELECT x FROM s GROUP BY x HAVING count(*) BETWEEN 2 AND 200) SELECT item_id, count(*) AS shared FROM s JOIN p USING (x) GROUP BY item_id")
_add("j10_definitions_by_definition", "taxonomy", J.definitions_by_definition, "w AS (SELECT path, list_distinct(string_split(lower(definition), ' ')) AS w FROM taxonomy_r) SELECT a.path AS \"left\", b.path AS \"right\", len(list_intersect(a.w, b.w)) AS shared FROM w a JOIN w b ON a.path < b.path")
_keys = lambda o: R.cache_keys(o, "judge-a", "scripted", "v1", "lang")
_KEYS = _head(G.ORACLES["b01_cache_keys"], "outputs")
_add("j11_cache_probe", "outputs", lambda o: J.cache_probe(_keys(o), _keys(o.filter("ord % 3 = 0"))).groupBy("hit").agg(F.count("*").alias("n")), f"q AS ({_KEYS}), c AS ({_KEYS} WHERE ord % 3 = 0) SELECT c.key IS NOT NULL AS hit, count(*) AS n FROM (SELECT DISTINCT key FROM q) q LEFT JOIN (SELECT DISTINCT key FROM c) c USING (key) GROUP BY 1")
_add("j12_share_vectors", "outputs second_run", J.share_vectors, f"a AS (SELECT value AS label, count(*) AS n FROM outputs_r WHERE NOT {G.DECLINES} GROUP BY value), b AS (SELECT value AS label, count(*) AS n FROM second_run_r WHERE NOT {G.DECLINES} GROUP BY value) SELECT label, coalesce(a.n, 0) AS before, coalesce(b.n, 0) AS after FROM a FULL JOIN b USING (label)")
_OK = lambda t: f"(SELECT item_id, path IS NOT NULL AS ok FROM {t} LEFT JOIN taxonomy_r ON path = value WHERE NOT {G.DECLINES})"
_ok = lambda o, t: R.outcome_by_item(A.label_in_taxonomy(o, t))
_add("j13_outcome_pairs", "outputs second_run taxonomy", lambda o, s, t: J.outcome_pairs(_ok(o, t), _ok(s, t)), f"a AS {_OK('outputs_r')}, b AS {_OK('second_run_r')} SELECT item_id, a.ok AS before, b.ok AS after FROM a FULL JOIN b USING (item_id)")
_add("j14_above_truth", "outputs labels", J.above_truth, G._PRIMARY + " SELECT item_id, value, label FROM outputs_r JOIN p USING (item_id) WHERE starts_with(label, value || '.')")

# Metrics and gates.
_M5 = _head(G.ORACLES["m05_accuracy_macro_f1"], "outputs", "labels", "taxonomy")
_add("m06_macro_f1", "outputs labels taxonomy", lambda o, l, t: M.accuracy(M.buckets(o, l, t)).select("macro_f1"), _M5.replace(_M5[_M5.rindex(" SELECT n, exact") :], " SELECT round(m, 6) AS macro_f1 FROM h"))
_SCREEN = _head(G.ORACLES["m09_screen"], "verdicts")
_FLAGS = f"sc AS (WITH {_SCREEN}), hf AS (SELECT judge, CASE WHEN approval IS NULL OR approval NOT BETWEEN 0.02 AND 0.98 THEN 'stop' ELSE 'warn' END AS severity, CASE WHEN approval IS NULL THEN 'scored nothing' WHEN approval NOT BETWEEN 0.02 AND 0.98 THEN 'one-sided' ELSE 'leaning' END AS reason FROM sc WHERE approval IS NULL OR approval NOT BETWEEN 0.15 AND 0.85 UNION ALL SELECT judge, CASE WHEN unreadable > 0.05 THEN 'stop' ELSE 'warn' END, 'unreadable' FROM sc WHERE unreadable > 0.02)"
# A judge that approves of nearly all stands beside the others, so that both kinds of flag are seen.
_rubber = lambda v: v.select("item_id", "judge", "status").union(v.filter("judge = 'judge-a'").select("item_id", F.lit("judge-r"), F.when(F.col("words") % 97 == 0, "unparseable").otherwise("pass")))
_RUBBER = "verdicts_all AS (SELECT item_id, judge, status FROM verdicts_r UNION ALL SELECT item_id, 'judge-r', CASE WHEN words % 97 = 0 THEN 'unparseable' ELSE 'pass' END FROM verdicts_r WHERE judge = 'judge-a'), "
_add("m10_health_flags", "verdicts", lambda v: U.health_flags(M.screen(_rubber(v))), _RUBBER + _FLAGS.replace("FROM verdicts_r", "FROM verdicts_all") + " SELECT * FROM hf")
_add("m16_phi", "verdicts", lambda v: M.pairwise_agreement(v).select("left", "right", "phi"), G._PHI + " SELECT \"left\", \"right\", phi FROM ph")
_add("m26_brier", "verdicts outputs labels", lambda v, o, l: K.calibration_quality(K.judged_pairs(v, o, l)).select("brier", "brier_base_rate", "beats_base_rate"), G._RIGHT + ", q AS (SELECT avg((confidence - ok::INT) ** 2) AS b, avg(ok::INT) AS m FROM jc WHERE confidence IS NOT NULL) SELECT round(b, 6) AS brier, round(m * (1 - m), 6) AS brier_base_rate, b < m * (1 - m) AS beats_base_rate FROM q")
_print = lambda c, prompt: U.fingerprint(F.col("judge"), F.col("model"), F.col(prompt), F.col("check_id"), F.col("tree"))
_PRINT = lambda p: f"substr(sha256(judge || chr(0) || model || chr(0) || {p} || chr(0) || check_id || chr(0) || coalesce(tree, '')), 1, 16)"
_add("m31_fingerprints", "calibrations", lambda c: c.select("judge", _print(c, "prompt").alias("fingerprint")).join(U.stale(c.select("judge", _print(c, "was").alias("fingerprint")), c.select("judge", _print(c, "prompt").alias("fingerprint"))), "judge"), f"SELECT judge, {_PRINT('prompt')} AS fingerprint, {_PRINT('was')} <> {_PRINT('prompt')} AS stale FROM calibrations_r")


def strategies(index: DataFrame) -> DataFrame:
    """What each wish resolves to, with and without a fitted calibration."""

    def one(wanted, fitted):
        try:
            return gates.resolve_strategy(wanted, fitted)
        except ValueError:
            return "refused"

    return _few(index, [(w, f, one(w, f)) for w in ("auto", "calibrated_risk", "raw_confidence", "random") for f in (True, False)], "wanted string, fitted boolean, strategy string")


_add("t07_resolve_strategy", "run_index", strategies, "SELECT wanted, fitted, CASE WHEN wanted = 'auto' THEN CASE WHEN fitted THEN 'calibrated_risk' ELSE 'raw_confidence' END WHEN wanted = 'calibrated_risk' AND NOT fitted THEN 'refused' ELSE wanted END AS strategy FROM (VALUES ('auto'), ('calibrated_risk'), ('raw_confidence'), ('random')) AS w(wanted), (VALUES (true), (false)) AS f(fitted)")


def leaks(*frames: DataFrame) -> DataFrame:
    def one(df):
        try:
            gates.assert_no_labels(df)
        except gates.LabelLeak:
            return True
        return False

    return _few(frames[0], [(n, one(df)) for n, df in zip(("verdicts", "outputs", "labels", "ratings", "items"), frames)], "relation string, refused boolean")


_add("t09_no_labels", "verdicts outputs labels ratings items", leaks, "SELECT * FROM (VALUES ('verdicts', false), ('outputs', false), ('labels', true), ('ratings', true), ('items', false)) AS t(relation, refused)")
_half = "1.96e0 * sqrt(v * (1 - v) / n)"
_add(
    "t15_estimates", "outputs labels taxonomy",
    lambda o, l, t: U.estimates(M.per_label(M.buckets(o, l, t)).filter("predicted > 0").select(F.col("label").alias("name"), (F.col("correct") / F.col("predicted")).alias("v"), F.col("predicted").alias("n")).selectExpr("name", "v AS value", f"v - {_half} AS low", f"v + {_half} AS high", "n")).select("name", F.round("value", 6).alias("value"), F.round("width", 6).alias("width"), "under_floor", "beats"),
    G._PER + f", e AS (SELECT label AS name, correct / predicted AS v, predicted AS n FROM l WHERE predicted > 0), i AS (SELECT *, v - {_half} AS low FROM e), t AS (SELECT max(struct_pack(v := v, name := name)) AS one FROM i), s AS (SELECT max(v) AS next FROM i, t WHERE name <> one.name) SELECT name, round(v, 6) AS value, round(2 * {_half}, 6) AS width, n < 30 AS under_floor, coalesce(low > CASE WHEN name = one.name THEN next ELSE one.v END, false) AS beats FROM i, t, s",
)
_gate_one = lambda v, i: U.gate_one_rows(M.screen(_rubber(v)), M.effective_votes(_rubber(v)), i, v.filter("judge = 'judge-c'").select("judge"))
_VOTES = _head(G.ORACLES["m17_effective_votes"], "verdicts").replace("FROM verdicts_r", "FROM verdicts_all")
_ONE = _RUBBER + _FLAGS.replace("FROM verdicts_r", "FROM verdicts_all") + f", ev AS (WITH {_VOTES}), g1 AS (SELECT 'scripted_judge' AS id, 'stop' AS severity, 'judge-c' AS about WHERE EXISTS (SELECT 1 FROM verdicts_r WHERE judge = 'judge-c') UNION ALL SELECT 'judge_health', severity, judge || ': ' || reason FROM hf UNION ALL SELECT 'sample_size', 'warn', count(*)::VARCHAR FROM items_r HAVING count(*) < 200 UNION ALL SELECT 'effective_votes', 'warn', round(votes, 1)::VARCHAR FROM ev WHERE votes < 0.5 * judges UNION ALL SELECT 'no_label_leakage', 'note', 'ok')"
_add("t19_gate_one", "verdicts items", _gate_one, _ONE + " SELECT * FROM g1")
_RANKED = {"raw_confidence": "SELECT * FROM rc", "majority_label": _head(G.ORACLES["t05_majority_label"], "outputs"), "output_length": _head(G.ORACLES["t04_output_length"], "items"), "panel_disagreement": "SELECT item_id, CASE WHEN votes >= 2 THEN round(1 - abs(2 * (approvals / votes) - 1), 6) END AS score FROM mj"}
_scored = lambda v, o, l, i: U.scored_strategies({"raw_confidence": K.raw_confidence(v), "majority_label": K.majority_label(o), "output_length": K.output_length(i), "panel_disagreement": K.panel_disagreement(v)}, K.build_target(o, l))
_AREA = lambda name, sql: f"SELECT '{name}' AS strategy, count(score) AS n, count(score) FILTER (error) AS errors, round((sum(r) FILTER (error AND score IS NOT NULL) - (count(score) FILTER (error)) * (count(score) FILTER (error) + 1) / 2) / ((count(score) FILTER (error)) * (count(score) FILTER (NOT error))), 6) AS auc, count(*) FILTER (score IS NULL) AS unranked, count(*) FILTER (score IS NULL AND error) AS unranked_errors FROM (SELECT score, error, rank() OVER (ORDER BY score NULLS LAST) + (count(*) OVER (PARTITION BY score) - 1) / 2 AS r FROM tg LEFT JOIN ({'WITH ' if not sql.startswith('SELECT') else ''}{sql}) s USING (item_id))"
_VOLI = "verdicts outputs labels items"
_AREAS = f"{G._TARGET}, {G._RAW}, {G._MAJ}, sa AS ({' UNION ALL '.join(_AREA(k, s) for k, s in _RANKED.items())})"
_GATE2 = _AREAS + ", mine AS (SELECT *, auc / (2 - auc) AS q1, 2 * auc * auc / (1 + auc) AS q2, errors::DOUBLE AS p, (n - errors)::DOUBLE AS m FROM sa WHERE strategy = 'raw_confidence'), lo AS (SELECT *, auc - 1.96 * sqrt((auc * (1 - auc) + (p - 1) * (q1 - auc * auc) + (m - 1) * (q2 - auc * auc)) / (p * m)) AS low FROM mine), be AS (SELECT max(struct_pack(auc := auc, strategy := strategy)) AS best FROM sa WHERE strategy <> 'raw_confidence' AND auc IS NOT NULL), dt AS (SELECT least(e, n - e) AS minority, least(e, n - e) < 30 OR least(e, n - e) < 0.05 * n AS few FROM (SELECT count(*) AS n, count(*) FILTER (error) AS e FROM tg)), g2 AS (SELECT 'degenerate_target' AS id, 'stop' AS severity, minority::VARCHAR AS about FROM dt WHERE few UNION ALL SELECT 'loses_to_baseline', 'stop', best.strategy FROM lo, be, dt WHERE NOT few AND coalesce(low <= best.auc, true) UNION ALL SELECT 'unranked_errors', 'warn', unranked_errors::VARCHAR FROM lo, dt WHERE NOT few AND unranked_errors > 0)"


def _gate_two(v: DataFrame, o: DataFrame, l: DataFrame, i: DataFrame) -> DataFrame:
    s = _scored(v, o, l, i)
    return U.gate_two_rows(s, "raw_confidence", U.normal_low(s, "raw_confidence"), K.build_target(o, l))


_add("t20_gate_two", _VOLI, _gate_two, _GATE2 + " SELECT * FROM g2")
_add("t20b_scored_strategies", _VOLI, _scored, _AREAS + " SELECT * FROM sa")
_HELD = ", wh AS (SELECT * FROM (VALUES " + ", ".join(f"('{i}', '{m}')" for i, ms in U.WITHHOLDS.items() for m in ms) + ") AS t(id, metric)), su AS (SELECT DISTINCT metric, id || ' ' || about AS reason FROM g1 JOIN wh USING (id) WHERE severity = 'stop')"
_add("t21_suppressions", "verdicts items", lambda v, i: gates.withheld(U.suppressions(_gate_one(v, i))), _ONE + _HELD + " SELECT metric, string_agg(reason, '; ' ORDER BY reason) AS reasons FROM su GROUP BY metric")
_add("t22_queue_verdicts", "verdicts", lambda v: K.raw_confidence(U.queue_verdicts(v, "judge-b")).join(K.raw_confidence(v).withColumnRenamed("score", "every_judge"), "item_id"), G._RAW + ", qs AS (" + G._RAW.removeprefix("rc AS (").removesuffix(")").replace("GROUP BY", "WHERE judge = 'judge-b' GROUP BY") + ") SELECT item_id, qs.score, rc.score AS every_judge FROM qs JOIN rc USING (item_id)")
_add("r08_cannot_tell", "schema_fields verdicts items", lambda s, v, i: U.cannot_tell(s, s, gates.withheld(U.suppressions(_gate_one(v, i))), v.filter("judge = 'judge-a'").select("judge")), _ONE + _HELD + ", ct AS (SELECT 'withheld figures' AS what, string_agg(DISTINCT metric, ',' ORDER BY metric) AS why FROM su UNION ALL SELECT 'whether a text invents', string_agg(field, ',' ORDER BY field) FROM schema_fields_r WHERE kind = 'free_text' UNION ALL SELECT 'accuracy', string_agg(field, ',' ORDER BY field) FROM schema_fields_r WHERE mode = 0 UNION ALL SELECT 'whether labels can be told apart', string_agg(field, ',' ORDER BY field) FROM schema_fields_r WHERE mode = 1 UNION ALL SELECT 'which labels are confused', 'no panel') SELECT * FROM ct WHERE why IS NOT NULL")

# Trees.
_tree = lambda t, v=1: trees.from_table(t, "langs", v)
_DIGEST = "dg AS (SELECT 'langs@v1' AS ref, sha256('[\"langs\", {' || string_agg('\"' || path || '\": [\"' || definition || '\", [], []]', ', ' ORDER BY path) || '}]') AS digest FROM taxonomy_r)"


def recorded(tree: DataFrame) -> DataFrame:
    """A tree against three records: its own, an older one under the same version, and one of another version."""
    t = _tree(tree)

    def verdict(record):
        try:
            trees.check_digest(t, record)
        except trees.BadTaxonomy:
            return "refused"
        return "allowed"

    records = {"same": {t.ref: t.digest()}, "edited": {t.ref: "0" * 64}, "other version": {"langs@v2": "0" * 64}}
    return _few(tree, [(k, verdict(r)) for k, r in records.items()], "record string, verdict string")


_add("x01_tree_problems", "drafts", trees.problems, "SELECT path, problem FROM (SELECT d.path, CASE WHEN NOT regexp_full_match(string_split(d.path, '.')[-1], '[a-z][a-z0-9_]*') OR string_split(d.path, '.')[-1] = 'abstain' THEN 'not a name for a label' WHEN trim(coalesce(d.definition, '')) = '' THEN 'no definition' WHEN d.parent IS NOT NULL AND u.path IS NULL THEN 'no node above' END AS problem FROM drafts_r d LEFT JOIN drafts_r u ON u.path = d.parent) WHERE problem IS NOT NULL")
_add("x03_content_digest", "taxonomy", lambda t: _few(t, [(_tree(t).ref, _tree(t).digest())], "ref string, digest string"), _DIGEST + " SELECT * FROM dg")
_add("x04_recorded_digest", "taxonomy", recorded, _DIGEST + ", rc AS (SELECT 'same' AS record, ref, digest FROM dg UNION ALL SELECT 'edited', ref, repeat('0', 64) FROM dg UNION ALL SELECT 'other version', 'langs@v2', repeat('0', 64)) SELECT record, CASE WHEN rc.ref = dg.ref AND rc.digest <> dg.digest THEN 'refused' ELSE 'allowed' END AS verdict FROM rc, dg")
_LEAVES = "SELECT path, parent FROM taxonomy_r WHERE path NOT IN (SELECT parent FROM taxonomy_r WHERE parent IS NOT NULL)"
_add("x05_health", "taxonomy", lambda t: _few(t, [x for x in trees.health(_tree(t)) if not x[1].startswith("defined like")], "path string, problem string"), f"lv AS ({_LEAVES}) SELECT path, 'no examples' AS problem FROM lv UNION ALL SELECT path, 'no boundary to its siblings' FROM lv WHERE (SELECT count(*) FROM taxonomy_r s WHERE s.parent IS NOT DISTINCT FROM lv.parent) > 1 UNION ALL SELECT path, 'name used twice' FROM taxonomy_r WHERE name IN (SELECT name FROM taxonomy_r GROUP BY name HAVING count(*) > 1) UNION ALL SELECT '', 'leaves of uneven depth' FROM lv HAVING count(DISTINCT len(string_split(path, '.'))) > 1")
_add("x05b_alike_definitions", "taxonomy", lambda t: _few(t, [x for x in trees.health(_tree(t)) if x[1].startswith("defined like")], "path string, problem string"), "SELECT 'germanic' AS path, 'defined like romance' AS problem")  # 40 of 44 characters match


# Comparison of runs.
def loaded_run(outputs: DataFrame, tree: DataFrame) -> DataFrame:
    """A run's tables, written as a run writes them and read as a comparison reads them."""
    import json

    from proofline.plans import project

    spark, path = outputs.sparkSession, scratch(outputs.sparkSession, "run")
    writers.write_table(project.findings(outputs, tree), f"{path}/findings")
    writers.write_table(outputs.select("item_id", "value"), f"{path}/outputs")
    writers.append_verdicts(outputs.filter("ord % 10 = 0").select("item_id", F.lit("pass").alias("status")), f"{path}/verdicts")
    _few(outputs, [(json.dumps({"project": "audit", "taxonomy": "langs@v1"}),)], "value string").coalesce(1).write.text(f"{path}/run")
    held, out = project.loaded(spark, path), None
    for k in ("findings", "outputs", "verdicts"):
        part = held[k].agg(F.count("*").alias("rows")).select(F.lit(held["project"]).alias("project"), F.lit(held["taxonomy"]).alias("taxonomy"), F.lit(k).alias("part"), "rows")
        out = part if out is None else out.union(part)
    return out


_add("k01_load_run", "outputs taxonomy", loaded_run, G._FINDINGS + ", n AS (SELECT 'findings' AS part, count(*) AS rows FROM fi UNION ALL SELECT 'outputs', count(*) FROM outputs_r UNION ALL SELECT 'verdicts', count(*) FROM outputs_r WHERE ord % 10 = 0) SELECT 'audit' AS project, 'langs@v1' AS taxonomy, part, rows FROM n")
_add("k03_version_check", "trees_a trees_b moves", U.version_check, "SELECT a.id, CASE WHEN b.id IS NULL THEN 'not used' WHEN a.version = b.version AND a.digest = b.digest THEN 'same' WHEN a.version = b.version THEN 'edited' WHEN m.id IS NULL THEN 'unmapped' WHEN m.source <> a.version OR m.target <> b.version THEN 'wrong mapping' ELSE 'mapped' END AS verdict FROM trees_a_r a LEFT JOIN trees_b_r b USING (id) LEFT JOIN moves_r m USING (id)")
_changes = lambda o, s, t: R.changes(_ok(o, t), _ok(s, t))
_CHANGES = _head(G.ORACLES["k05_changes"], "outputs", "second_run", "taxonomy")
_COUNTS = f"ch AS (WITH {_CHANGES}), cn AS (SELECT coalesce(sum(n) FILTER (change = 'improved'), 0)::BIGINT AS u, coalesce(sum(n) FILTER (change = 'regressed'), 0)::BIGINT AS d, coalesce(sum(n) FILTER (change = 'unchanged'), 0)::BIGINT AS s FROM ch)"
_add("k06b_untranslated", "outputs migration", R.untranslated, f"SELECT value, CASE WHEN old IS NULL THEN 'unknown' ELSE 'dropped' END AS why, count(*) AS n FROM outputs_r LEFT JOIN migration_r ON old = value WHERE NOT {G.DECLINES} AND new IS NULL GROUP BY ALL")
_add("k07_withheld_verdict", "outputs second_run taxonomy", lambda o, s, t: U.withheld_verdict(_changes(o, s, t)), _COUNTS + " SELECT u || ' improved and ' || d || ' regressed of ' || (u + d + s) || ' shared, net ' || (u - d) || ': no result without a test over the items that differ' AS line FROM cn WHERE u + d + s > 0")


# Judges.
def _said(value: str | None) -> str:
    return '{"lang": "' + (value or "") + '"}'


_add("z03_regenerate", "second_run", lambda s: R.stability(Q.regenerate(s.select("item_id", F.col("value").alias("text")), _said, "lang")), "SELECT count(*) AS items, count(*) AS agreed, round(count(*) / count(*), 6) AS stability, 'pass' AS status FROM second_run_r")
_add("q03_groundedness", "replies", lambda r: Q.verdicts(r.select("item_id", F.lit("judge-a").alias("judge"), F.lit("total").alias("field"), "reply", F.lit("answered").alias("outcome")), "copied").select("item_id", "check", "status"), f"SELECT item_id, 'value_grounded' AS \"check\", status FROM ({G.ORACLES['q01_parse_replies']})")
_add("q04_tasks", "schema_fields", lambda s: s.join(_few(s, [(k, t.check, t.gated) for k, t in Q.TASKS.items()], "kind string, check string, gated boolean"), "kind").select("field", "check", "gated"), "SELECT field, CASE kind WHEN 'assigned' THEN 'label_correct' WHEN 'copied' THEN 'value_grounded' ELSE 'claims_supported' END AS \"check\", kind <> 'assigned' AS gated FROM schema_fields_r")
#: What a scripted judge says, by what stands in the prompt.
_RULES = [("lang: romance.pt", '{"correct": false, "confidence": 0.9, "instead": "romance.es"}'), ("lang: romance.es", None), ("lang: germanic.de", "no idea")]
_asked = lambda o, i: Q.questions(o.select("item_id", "value").join(i.select("item_id", F.lit("").alias("text")), "item_id"), "assigned", "lang", ["judge-a"])
_scripted = {"judge-a": Q.by_rules(_RULES, '{"correct": true, "confidence": 0.8}')}
_JUDGED = f"o AS (SELECT item_id, value FROM outputs_r JOIN items_r USING (item_id) WHERE NOT {G.DECLINES} AND trim(value) <> '')"
_add("q05_verdicts", "outputs items", lambda o, i: Q.verdicts(Q.ask(_asked(o, i), _scripted), "assigned"), _JUDGED + " SELECT item_id, 'judge-a' AS judge, 'lang' AS field, 'label_correct' AS \"check\", CASE value WHEN 'romance.pt' THEN 'fail' WHEN 'romance.es' THEN 'error' WHEN 'germanic.de' THEN 'unparseable' ELSE 'pass' END AS status, CASE value WHEN 'romance.pt' THEN 0.9 WHEN 'romance.es' THEN NULL WHEN 'germanic.de' THEN NULL ELSE 0.8 END::DOUBLE AS confidence FROM o")


def flaky(items: DataFrame) -> DataFrame:
    """A transport that is busy at first, and refuses every seventh item for good."""

    def replies(batches):
        import pandas as pd

        for pdf in batches:
            seen: dict[str, int] = {}

            def send(body):
                k = seen[body["prompt"]] = seen.get(body["prompt"], 0) + 1
                return (400, "") if int(body["prompt"]) % 7 == 0 else (429, "") if k == 1 else (503, "") if k == 2 else (200, f"{body['prompt']} after {k}")

            ask = Q.over_http(send, "m", sleep=lambda s: None)
            yield pd.DataFrame({"item_id": pdf.item_id, "reply": [_or_none(ask, p) for p in pdf.item_id]})

    return items.select("item_id").mapInPandas(replies, "item_id string, reply string")


def _or_none(ask, prompt):
    try:
        return ask(prompt)
    except Q.ProviderFailed:
        return None


_add("q06_http_retries", "items", flaky, "SELECT item_id, CASE WHEN item_id::BIGINT % 7 <> 0 THEN item_id || ' after 3' END AS reply FROM items_r")
_add("q08_scripted_replies", "outputs items", lambda o, i: Q.ask(_asked(o, i), _scripted).select("item_id", "outcome", "reply"), _JUDGED + """ SELECT item_id, CASE value WHEN 'romance.es' THEN 'error' ELSE 'answered' END AS outcome, CASE value WHEN 'romance.pt' THEN '{"correct": false, "confidence": 0.9, "instead": "romance.es"}' WHEN 'germanic.de' THEN 'no idea' WHEN 'romance.es' THEN NULL ELSE '{"correct": true, "confidence": 0.8}' END AS reply FROM o""")


def passes(outputs: DataFrame, items: DataFrame, tree: DataFrame) -> DataFrame:
    """What triage, a panel over a sample and the gate would ask, less what a cache answers."""
    rows = outputs.select("item_id", "value", "ord").join(items.select("item_id", F.col("item_id").alias("text")), "item_id")
    sampled = rows.join(M.sample_items(items, 300), "item_id", "left_semi")
    flagged = rows.join(A.valid_leaf(outputs, tree).filter("status = 'fail'").select("item_id"), "item_id", "left_semi")
    q = lambda df, judges: Q.questions(df, "assigned", "lang", judges)
    todo = Q.collect_run(q(rows, ["judge-a"]), q(sampled, ["judge-a", "judge-b"]), q(flagged, ["judge-b", "judge-c"]), q(rows.filter("ord % 5 = 0"), ["judge-a"]))
    return todo.groupBy("selected_by", "judge").agg(F.count("*").alias("n"), F.countDistinct("item_id").alias("items"))


_add("b04_collect", "outputs items taxonomy", passes, f"o AS (SELECT item_id, ord, value FROM outputs_r WHERE NOT {G.DECLINES} AND trim(value) <> ''), sampled AS (SELECT item_id FROM items_r ORDER BY sha256(concat('panel', chr(0), item_id)) LIMIT 300), q AS (SELECT item_id, 'judge-a' AS judge, 0 AS k FROM o UNION ALL SELECT item_id, j, 1 FROM o SEMI JOIN sampled USING (item_id), (VALUES ('judge-a'), ('judge-b')) AS j(j) UNION ALL SELECT item_id, j, 2 FROM o JOIN taxonomy_r ON path = value AND NOT is_leaf, (VALUES ('judge-b'), ('judge-c')) AS j(j)), f AS (SELECT item_id, judge, min(k) AS k FROM q GROUP BY ALL), t AS (SELECT f.* FROM f ANTI JOIN (SELECT item_id, 'judge-a' AS judge FROM o WHERE ord % 5 = 0) c USING (item_id, judge)) SELECT CASE k WHEN 0 THEN 'triage' WHEN 1 THEN 'panel' ELSE 'gated' END AS selected_by, judge, count(*) AS n, count(DISTINCT item_id) AS items FROM t GROUP BY ALL")


# Reports.
def lines(df: DataFrame, title: str, rows) -> DataFrame:
    return _few(df, list(enumerate(gates.render(title, rows).split("\n"))), "ord long, line string")


def report(o: DataFrame, l: DataFrame, t: DataFrame) -> DataFrame:
    r = M.accuracy(M.buckets(o, l, t)).first()
    return lines(o, "Accuracy", [("items", r.n), ("exact", r.exact), ("accuracy", r.accuracy), ("majority", r.majority), ("calibration", None)])


def comparison(o: DataFrame, s: DataFrame, t: DataFrame) -> DataFrame:
    n = {r.change: r.n for r in _changes(o, s, t).collect()}  # five kinds
    return lines(o, "Second run", [(c, n.get(c, 0)) for c in ("improved", "regressed", "unchanged", "only_in_a", "only_in_b")])


_LINE = lambda name, shown: f"rpad('{name}', (79 - length({shown}))::INT, ' ') || ' ' || {shown}"
_add("v01_report", "outputs labels taxonomy", report, f"a AS (WITH {_M5}) SELECT 0::BIGINT AS ord, 'Accuracy' AS line UNION ALL SELECT 1, '========' UNION ALL SELECT 2, {_LINE('items', 'n::VARCHAR')} FROM a UNION ALL SELECT 3, {_LINE('exact', 'exact::VARCHAR')} FROM a UNION ALL SELECT 4, {_LINE('accuracy', "printf('%.3f', accuracy)")} FROM a UNION ALL SELECT 5, {_LINE('majority', "printf('%.3f', majority)")} FROM a UNION ALL SELECT 6, {_LINE('calibration', "'not measured'")}")
_add("v02_comparison_report", "outputs second_run taxonomy", comparison, _COUNTS + ", k AS (SELECT * FROM (VALUES (2, 'improved'), (3, 'regressed'), (4, 'unchanged'), (5, 'only_in_a'), (6, 'only_in_b')) AS t(ord, change)), l AS (SELECT k.ord, k.change, coalesce(ch.n, 0)::VARCHAR AS shown FROM k LEFT JOIN ch USING (change)) SELECT 0::BIGINT AS ord, 'Second run' AS line UNION ALL SELECT 1, '==========' UNION ALL SELECT ord, rpad(change, (79 - length(shown))::INT, ' ') || ' ' || shown FROM l")


def commands(index: DataFrame) -> DataFrame:
    from proofline.__main__ import COMMANDS

    return _few(index, [(c, ",".join(a)) for c, a in COMMANDS.items()], "command string, arguments string")


def api(index: DataFrame) -> DataFrame:
    from proofline import api as public

    return _few(index, [(n, callable(getattr(public, n))) for n in public.__all__], "name string, callable boolean")


_add("v03_commands", "run_index", commands, "SELECT * FROM (VALUES ('run', 'config'), ('plan', 'config'), ('analyse', 'directory'), ('triage-eval', 'directory,config'), ('compare', 'a,b'), ('check', 'taxonomy'), ('list', ''), ('query', 'name,tables')) AS t(command, arguments)")
#: The public names that callers may rely on.
_NAMES = """
BadInput BadSetting BadTaxonomy Field TASKS Taxonomy abstention_rate accuracy ambiguous analyse annotator_agreement append_verdicts ask assert_no_labels auc audit boilerplate bootstrap_auc
bootstrap_ci buckets budget build_target by_rules cache_keys calibrated_risk calibration_quality cannot_tell changes check_digest collect_run compare compare_strategies confusion
copy_ratio cross_field_agreement cross_fitted defect_agreement distribution_shift drift effective_votes estimates fingerprint gate_one gate_one_rows gate_two gate_two_rows
gated_plan grain_rates grounding_rate health health_flags judge_direction label_collapse label_in_taxonomy label_shares latest_run length_in_bounds load longest_shared_run majority
metric_deltas migration nearest_labels over_http pairwise_agreement parse parse_claims parse_date parse_number per_label plan platt questions rare_tokens raw_confidence read_items
read_labels read_outputs read_source recall_at_budget regenerate reliability render resolve resolve_strategy risk_rows run run_name screen specificity stability suspicious triage_eval
valid_leaf value_in_source value_matches_human value_shape verdicts version_check vocabulary withheld
"""
_add("v04_api", "run_index", api, "SELECT name, name <> 'TASKS' AS callable FROM (SELECT unnest([" + ", ".join(f"'{n}'" for n in _NAMES.split()) + "]) AS name)")
