"""Named queries on claims, defect boxes, panels, strategies, intervals and deltas, with their SQL."""

from __future__ import annotations

from pyspark.sql import functions as F

from proofline.operators import evidence as E, metrics as M, ranking as K, runs as R
from proofline.plans import registry as G
from proofline.plans.projections import with_sql
from proofline.sources.writers import latest_run

_add = G._add

_CLAIMS = "e AS (SELECT item_id, TRY_CAST(nullif(regexp_extract(reply, '(?s)\\{.*\\}'), '') AS JSON) AS j FROM claim_replies_r), c AS (SELECT item_id, nullif(len(json_extract(j, '$.claims[*].supported')), 0)::BIGINT AS n, len(list_filter(json_extract(j, '$.claims[*].supported'), lambda x: x::VARCHAR <> 'true'))::BIGINT AS u, nullif(trim(j->>'$.missing'), '') AS m FROM e), pc AS (SELECT item_id, n AS claims, CASE WHEN n > 0 THEN u END AS unsupported, round(1 - u / n, 6) AS rate, CASE WHEN n IS NULL THEN 'unparseable' WHEN u = 0 THEN 'pass' ELSE 'fail' END AS status, round(CASE WHEN u = 0 THEN 1 - u / n ELSE u / n END, 6) AS confidence, CASE WHEN n > 0 THEN m END AS missing FROM c)"
_add("q02_parse_claims", "claim_replies", E.parse_claims, _CLAIMS + " SELECT * FROM pc")
_add("r03_claim_findings", "claim_replies", lambda c: E.claim_findings(E.parse_claims(c)), _CLAIMS + " SELECT item_id, CASE WHEN rate IS NULL THEN 'unscored' WHEN rate >= 0.95 THEN 'pass' ELSE 'fail' END AS status, rate AS score FROM pc")
_add("r04_grounding_findings", "replies", lambda r: E.grounding_findings(R.parse_replies(r)), f"SELECT item_id, CASE WHEN status IN ('pass', 'fail') THEN status ELSE 'unscored' END AS status, CASE WHEN status IN ('pass', 'fail') THEN confidence END AS score, instead FROM ({G.ORACLES['q01_parse_replies']})")
_add(
    "r05_defect_agreement", "ratings_boxes claim_replies", lambda r, c: E.defect_agreement(r, E.claim_flags(E.parse_claims(c))),
    _CLAIMS + ", f AS (SELECT item_id, 'claims_supported' AS \"check\", 'made_up' AS defect, rate < 0.95 AS flagged FROM pc WHERE rate IS NOT NULL UNION ALL SELECT item_id, 'claims_missing', 'missing', missing IS NOT NULL FROM pc WHERE rate IS NOT NULL), h AS (SELECT item_id, list(label) AS ticked FROM ratings_boxes_r GROUP BY item_id), b AS (SELECT defect, \"check\", flagged, list_contains(ticked, defect) AS t FROM f JOIN h USING (item_id)), g AS (SELECT defect, \"check\", count(*) AS compared, count(*) FILTER (flagged = t) AS agreed, count(*) FILTER (flagged AND NOT t) AS tool_only, count(*) FILTER (NOT flagged AND t) AS human_only FROM b GROUP BY ALL) SELECT *, round(agreed / compared, 6) AS agreement, CASE WHEN tool_only > human_only THEN 'over-flags' WHEN tool_only < human_only THEN 'under-flags' END AS leaning FROM g",
)

_add("m14_decisions", "verdicts", M.decisions, "SELECT item_id, judge, (status = 'pass')::INT AS vote FROM verdicts_r WHERE status IN ('pass', 'fail')")
_HEALTH = G.ORACLES["m09_screen"].removeprefix(with_sql("verdicts")).removeprefix(", ").replace("FROM verdicts_r", "FROM all_r")
_SAMPLED = with_sql("verdicts", "items").replace("verdicts_r AS (", "all_r AS (", 1) + f", health AS (SELECT * FROM (WITH {_HEALTH}) WHERE flag <> 'stop'), sampled AS (SELECT item_id FROM items_r ORDER BY sha256(concat('panel', chr(0), item_id)) LIMIT 300), verdicts_r AS (SELECT * FROM all_r WHERE judge IN (SELECT judge FROM health) AND item_id IN (SELECT item_id FROM sampled))"
_add("m21_panel", "verdicts items", lambda v, i: M.pairwise_agreement(E.panel(v, i)))
G.ORACLES["m21_panel"] = f"{_SAMPLED}, {G._PHI} SELECT * FROM ph"
_add("m27_identity_risk", "verdicts", lambda v: v.select("item_id", "judge", F.round(K.identity_risk(F.col("status"), F.col("confidence")), 6).alias("risk")), "SELECT item_id, judge, round(CASE status WHEN 'fail' THEN confidence WHEN 'pass' THEN 1 - confidence END, 6) AS risk FROM verdicts_r")

_BUDGETS = G.ORACLES["t16_recall_at_budget"].removeprefix(with_sql("ratings")).removeprefix(", ")
_LENGTH = "SELECT item_id, CASE WHEN trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')) = '' THEN 0 ELSE len(string_split(trim(regexp_replace(text, '[ \\t\\n\\r]+', ' ', 'g')), ' ')) END::DOUBLE AS score FROM items_r"
_SCORES = {"raw_confidence": "SELECT * FROM rc", "output_length": _LENGTH, "panel_disagreement": "SELECT item_id, CASE WHEN votes >= 2 THEN round(1 - abs(2 * (approvals / votes) - 1), 6) END AS score FROM mj"}
_BASE = with_sql("verdicts", "outputs", "labels", "items") + f", {G._TARGET}, {G._RAW}, {G._MAJ}"
_add("t18_compare_strategies", "verdicts outputs labels items", lambda v, o, l, i: E.compare_strategies({"raw_confidence": K.raw_confidence(v), "output_length": K.output_length(i), "panel_disagreement": K.panel_disagreement(v)}, K.build_target(o, l)))
# Unranked errors count in the recall, but take no part of the budget.
_STRATEGY = _BUDGETS.replace("a AS (SELECT *, ", "a AS (SELECT *, ", 1).replace("FROM c), t AS (SELECT sum(n) AS total, sum(pos) AS errors FROM c)", "FROM c WHERE score IS NOT NULL), t AS (SELECT sum(n) AS total, sum(pos) AS errors, sum(n) FILTER (score IS NOT NULL) AS ranked FROM c)").replace("::BIGINT), total)::BIGINT", "::BIGINT), ranked)::BIGINT")
G.ORACLES["t18_compare_strategies"] = " UNION ALL ".join(f"SELECT '{k}' AS strategy, budget, k, recall, precision FROM ({_BASE}, ratings_r AS (SELECT item_id, score, error FROM tg LEFT JOIN ({s}) s USING (item_id)), {_STRATEGY})" for k, s in _SCORES.items())

_PER = G.ORACLES["m05_accuracy_macro_f1"]
_LATER = with_sql("second_run", "labels", "taxonomy").replace("second_run_r AS (", "outputs_r AS (", 1) + _PER.removeprefix(with_sql("outputs", "labels", "taxonomy"))
_add("k04_metric_deltas", "outputs second_run labels taxonomy", E.metric_deltas)
G.ORACLES["k04_metric_deltas"] = f"SELECT round(b.accuracy - a.accuracy, 6) AS accuracy, round(b.majority - a.majority, 6) AS majority, round(b.macro_f1 - a.macro_f1, 6) AS macro_f1 FROM ({_PER}) a, ({_LATER}) b"
_add("z02_reads_as_broken", "generations", lambda g: E.reads_as_broken(R.stability(g)))
G.ORACLES["z02_reads_as_broken"] = f"SELECT stability, coalesce(stability < 0.99, false) AS broken, 'serving' AS suspect FROM ({G.ORACLES['z01_stability']})"
_add("x02_tree", "taxonomy", E.tree, "SELECT t.path, len(string_split(t.path, '.')) AS depth, (SELECT count(*) FROM taxonomy_r s WHERE s.parent IS NOT DISTINCT FROM t.parent) - 1 AS siblings, (SELECT count(*) FROM taxonomy_r s WHERE s.parent = t.path) AS children FROM taxonomy_r t")
_add("s13_latest_run", "run_index", lambda i: latest_run(i.withColumnRenamed("ended", "at"), "audit"), "SELECT arg_max(run_id, (ended, run_id)) AS run_id FROM run_index_r WHERE project = 'audit'")
