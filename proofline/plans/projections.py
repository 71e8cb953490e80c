"""The audited relations, as projections of the given tables: one text that both engines read."""

from __future__ import annotations

import re

from pyspark.sql import DataFrame, SparkSession

from proofline.sources.readers import spread

TRUTH = "CASE WHEN lang IN ('en', 'de') THEN concat('germanic.', lang) ELSE concat('romance.', lang) END"

PROJECTIONS = {
    "taxonomy": """SELECT * FROM (VALUES ('germanic', 'germanic', 'languages of the north', CAST(NULL AS STRING), false), ('romance', 'romance', 'languages of the south', NULL, false),
      ('germanic.en', 'en', 'english prose with the and of', 'germanic', true), ('germanic.de', 'de', 'german prose with und der', 'germanic', true),
      ('romance.fr', 'fr', 'french prose with les des', 'romance', true), ('romance.es', 'es', 'spanish prose with los que', 'romance', true)) AS t(path, name, definition, parent, is_leaf)""",
    "items": "SELECT CAST(doc_id AS STRING) AS item_id, text, doc_id AS ord FROM {documents}",
    "outputs": f"""SELECT CAST(doc_id AS STRING) AS item_id, doc_id AS ord, CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 31 = 0 THEN 'abstain' WHEN doc_id % 23 = 0 THEN 'romance.pt'
      WHEN doc_id % 19 = 0 THEN 'germanic' WHEN doc_id % 17 = 0 THEN 'germanic.en' WHEN doc_id % 13 = 0 THEN 'romance.es' ELSE {TRUTH} END AS value FROM {{documents}}""",
    "labels": f"""SELECT CAST(doc_id AS STRING) AS item_id, 'ann-1' AS annotator, {TRUTH} AS label FROM {{documents}} WHERE doc_id % 3 <> 0
      UNION ALL SELECT CAST(doc_id AS STRING), 'ann-2', CASE WHEN doc_id % 14 = 0 THEN 'germanic.de' ELSE {TRUTH} END FROM {{documents}} WHERE doc_id % 7 = 0""",
    "verdicts": f"""SELECT CAST(doc_id AS STRING) AS item_id, judge, status, CASE WHEN status IN ('pass', 'fail') THEN 0.5 + (roll % 50) / 100.0e0 END AS confidence, CASE WHEN status = 'fail' THEN CASE WHEN roll % 3 = 0 THEN 'germanic.de' ELSE truth END END AS instead, words FROM (
      SELECT doc_id, judge, roll, truth, words, CASE WHEN roll < 30 THEN 'cannot_decide' WHEN roll < 50 THEN 'unparseable' WHEN roll < 60 THEN 'error' WHEN (ok AND roll < 900) OR (NOT ok AND roll < 300) THEN 'pass' ELSE 'fail' END AS status FROM (
      SELECT doc_id, judge, (doc_id * 7919 + k * 104729) % 1000 AS roll, {TRUTH} AS truth, n_chars AS words, NOT (doc_id % 23 = 0 OR doc_id % 19 = 0 OR doc_id % 13 = 0) AS ok FROM {{documents}} CROSS JOIN (VALUES ('judge-a', 1), ('judge-b', 2), ('judge-c', 3)) AS j(judge, k)) AS x) AS y""",
    "pairs": """SELECT concat(CAST(u.conv_id AS STRING), '-', CAST(u.turn AS STRING)) AS item_id, u.text AS source, a.text AS written FROM {conversations} u JOIN {conversations} a ON a.conv_id = u.conv_id AND a.turn = u.turn + 1 WHERE u.role = 'user' AND a.role = 'assistant'""",
    "copied": """SELECT CAST(o_orderkey AS STRING) AS item_id, concat('Order ', CAST(o_orderkey AS STRING), ' placed on ', CAST(CAST(o_orderdate AS DATE) AS STRING), ' comes to $', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '.50', CASE WHEN o_orderkey % 4 = 0 THEN ' and carriage 12.00' ELSE '' END) AS source,
      CASE WHEN o_orderkey % 37 = 0 THEN 'unknown' WHEN o_orderkey % 11 = 0 THEN '99999999' WHEN o_orderkey % 5 = 0 THEN concat('$ ', CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '.5') ELSE concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '.50') END AS number,
      CASE WHEN o_orderkey % 41 = 0 THEN '2024-02-30' WHEN o_orderkey % 7 = 0 THEN 'March 3, 1996' WHEN o_orderkey % 6 = 0 THEN '04/05/1996' ELSE CAST(CAST(o_orderdate AS DATE) AS STRING) END AS date,
      concat(CAST(CAST(floor(o_totalprice) AS BIGINT) AS STRING), '.50') AS human FROM {orders}""",
    "wide": f"""SELECT CAST(doc_id AS STRING) AS item_id, CASE WHEN doc_id % 29 = 0 THEN NULL WHEN doc_id % 19 = 0 THEN 'germanic' WHEN doc_id % 23 = 0 THEN 'romance.pt' ELSE {TRUTH} END AS lang,
      CASE WHEN doc_id % 7 = 0 THEN '' WHEN doc_id % 5 = 0 THEN 'one and the same words for many documents of all kinds' ELSE substr(text, 20, 240) END AS summary, CASE WHEN doc_id % 3 = 0 THEN 'unknown' WHEN doc_id % 2 = 0 THEN regexp_extract(text, '([0-9]+)', 1) ELSE '17' END AS total FROM {{documents}}""",
    "before": "SELECT event_type AS label FROM {events} WHERE ts < TIMESTAMP '2024-01-16 00:00:00'",
    "after": "SELECT event_type AS label FROM {events} WHERE ts >= TIMESTAMP '2024-01-16 00:00:00'",
    "generations": "SELECT CAST(l_orderkey AS STRING) AS item_id, CAST(l_linenumber AS BIGINT) AS generation, l_returnflag AS value FROM {lineitem}",
    "second_run": f"""SELECT CAST(doc_id AS STRING) AS item_id, CASE WHEN doc_id % 37 = 0 THEN 'romance.pt' WHEN doc_id % 13 = 0 THEN 'romance.es' ELSE {TRUTH} END AS value FROM {{documents}} WHERE doc_id % 43 <> 0""",
    "ratings": """SELECT CAST(d.doc_id AS STRING) AS item_id, CAST(length(d.text) AS DOUBLE) AS score, l.quality = 0 AS error FROM {documents} d JOIN {labels} l ON l.doc_id = d.doc_id""",
    "spend": "SELECT event_id AS seq, CAST(round(value * 100) AS BIGINT) AS cents FROM {events}",
    "claim_replies": """SELECT CAST(doc_id AS STRING) AS item_id, CASE WHEN doc_id % 13 = 0 THEN 'none of it' WHEN doc_id % 17 = 0 THEN '{{"claims": []}}' ELSE concat('So: {{"claims": [{{"claim": "one", "supported": ', CASE WHEN doc_id % 3 = 0 THEN 'false' ELSE 'true' END,
      '}}, {{"claim": "two", "supported": true}}, {{"claim": "three", "supported": ', CASE WHEN doc_id % 5 = 0 THEN 'false' ELSE 'true' END, '}}], "missing": "', CASE WHEN doc_id % 4 = 0 THEN 'the date' ELSE '' END, '"}}') END AS reply FROM {documents}""",
    "ratings_boxes": """SELECT CAST(doc_id AS STRING) AS item_id, CASE WHEN doc_id % 6 = 0 THEN 'made_up' WHEN doc_id % 8 = 0 THEN 'missing' ELSE 'none' END AS label FROM {documents} WHERE doc_id % 2 = 0""",
    "run_index": """SELECT * FROM (VALUES ('audit', 'r1', TIMESTAMP '2024-01-01 00:00:00'), ('audit', 'r3', TIMESTAMP '2024-02-01 00:00:00'), ('audit', 'r2', TIMESTAMP '2024-02-01 00:00:00'), ('other', 'r9', TIMESTAMP '2024-03-01 00:00:00')) AS t(project, run_id, ended)""",
    "nation_rows": "SELECT CAST(n_nationkey AS BIGINT) AS key, n_name AS name FROM {nation}",
    "customers": "SELECT CAST(c_custkey AS STRING) AS item_id, c_name AS name, c_mktsegment AS segment, CASE WHEN c_custkey % 9 = 0 THEN NULL ELSE c_nationkey END AS nation FROM {customer}",
    "drafts": """SELECT * FROM (VALUES ('root', 'a first label', CAST(NULL AS STRING)), ('root.leaf', 'one below', 'root'), ('root.Leaf', 'a capital', 'root'), ('root.9', 'a digit first', 'root'), ('abstain', 'is taken', NULL), ('root.bare', ' ', 'root'), ('lost.child', 'no node above', 'lost'),
      ('other', NULL, NULL)) AS t(path, definition, parent)""",
    "schema_fields": "SELECT * FROM (VALUES ('lang', 'assigned', 2), ('topic', 'assigned', 0), ('total', 'copied', 1), ('summary', 'free_text', 1), ('note', 'free_text', 0)) AS t(field, kind, mode)",
    "layers": """SELECT * FROM (VALUES ('field', 'max_copy_ratio', 0.6e0), ('settings', 'max_copy_ratio', 0.7e0), ('settings', 'min_grounding', 0.9e0), ('default', 'max_copy_ratio', 0.5e0), ('default', 'min_grounding', 0.95e0), ('default', 'audit_rate', 0.1e0), ('default', 'min_stability', 0.9e0)) AS t(source, name, value)""",
    "trees_a": "SELECT * FROM (VALUES ('lang', 1, 'aa'), ('topic', 1, 'bb'), ('tone', 2, 'cc'), ('mood', 1, 'dd'), ('form', 3, 'ee'), ('size', 1, 'ff')) AS t(id, version, digest)",
    "trees_b": "SELECT * FROM (VALUES ('lang', 1, 'aa'), ('topic', 1, 'b2'), ('tone', 3, 'cc'), ('form', 4, 'e2'), ('size', 2, 'f2')) AS t(id, version, digest)",
    "moves": "SELECT * FROM (VALUES ('form', 3, 4), ('size', 2, 3)) AS t(id, source, target)",
    "calibrations": "SELECT * FROM (VALUES ('judge-a', 'm1', 'p7', 'label_correct', 'langs@v1', 'p7'), ('judge-b', 'm1', 'p7', 'label_correct', 'langs@v1', 'p6'), ('judge-c', 'm2', 'p7', 'label_correct', CAST(NULL AS STRING), 'p7')) AS t(judge, model, prompt, check_id, tree, was)",
    "migration": "SELECT * FROM (VALUES ('germanic.en', 'west.en'), ('germanic.de', 'west.de'), ('romance.fr', 'south'), ('romance.es', 'south'), ('germanic', CAST(NULL AS STRING))) AS t(old, new)",
    "replies": """SELECT CAST(doc_id AS STRING) AS item_id, CASE WHEN doc_id % 11 = 0 THEN 'no idea' WHEN doc_id % 9 = 0 THEN '{{"correct": "true", "confidence": 2.5}}' WHEN doc_id % 2 = 0 THEN '{{"correct": false, "confidence": 0.75, "instead": "romance.fr"}}' ELSE 'So: {{"correct": true, "confidence": 0.9}} done' END AS reply FROM {documents}""",
}


def relation(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    text = PROJECTIONS[name]
    tables = {t: spark.read.parquet(f"{sf_dir}/{t}.parquet") for t in set(re.findall(r"(?<!\{)\{(\w+)\}(?!\})", text))}
    if "documents" in tables:
        tables["documents"] = spread(tables["documents"], "doc_id")  # long texts: the work is in the rows
    return spark.sql(text, **tables)


def with_sql(*names: str) -> str:
    """WITH clause for DuckDB; names that hide a table end in _r."""

    class Same(dict):
        def __missing__(self, key):
            return key

    return "WITH " + ", ".join(f"{n}_r AS ({PROJECTIONS[n].format_map(Same())})" for n in names) + " "
