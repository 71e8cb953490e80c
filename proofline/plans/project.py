"""A whole audit of one assigned field: run, plan, analyse, evaluate the ranking, compare two runs."""

from __future__ import annotations

import json
from collections.abc import Mapping
from datetime import datetime, timezone

import yaml
from pyspark.sql import DataFrame, SparkSession, functions as F

from proofline.functions import gates, settings, taxonomy as trees
from proofline.operators import assigned, evidence, guardrails, metrics, ranking, runs
from proofline.sources.readers import BadInput, read_items, read_labels, read_outputs
from proofline.sources.writers import append_index, append_verdicts, run_name, write_table

NEEDED, ALLOWED = ("project", "items", "outputs", "taxonomy", "field"), {"labels", "judges", "settings", "max_calls"}


def load(text: str) -> dict:
    """A project's file: paths of its tables, the audited field, judges and settings."""
    body = yaml.safe_load(text) or {}
    if missing := [k for k in NEEDED if k not in body]:
        raise BadInput(f"the project has no {', '.join(missing)}")
    if unknown := set(body) - set(NEEDED) - ALLOWED:
        raise BadInput(f"the project has unknown keys {sorted(unknown)}")
    settings.check(body.get("settings") or {})
    return body | {"judges": list(body.get("judges") or ["judge-a"])}


def relations(spark: SparkSession, config: Mapping, tree: trees.Taxonomy) -> dict[str, DataFrame]:
    """items, outputs (item_id, value) of the field without orphans, labels or None, and the taxonomy."""
    items = runs.index_items(read_items(spark, config["items"])).filter(F.trim("text") != "")
    outputs = read_outputs(spark, config["outputs"])
    if config["field"] not in outputs.columns:
        raise BadInput(f"the outputs have no column {config['field']}")
    answers = outputs.select("item_id", F.col(config["field"]).cast("string").alias("value")).join(items.select("item_id"), "item_id", "left_semi")
    labels = read_labels(spark, config["labels"]).filter(F.col("field") == config["field"]) if config.get("labels") else None
    return {"items": items, "outputs": answers, "labels": labels, "taxonomy": tree.table(spark)}


def findings(outputs: DataFrame, tree: DataFrame) -> DataFrame:
    """(item_id, check, status) of the free checks on rows."""
    part = lambda df, name: df.select("item_id", F.lit(name).alias("check"), "status")
    return part(assigned.label_in_taxonomy(outputs, tree), "label_in_taxonomy").unionByName(part(assigned.valid_leaf(outputs, tree), "valid_leaf"))


def questions(rel: Mapping[str, DataFrame], config: Mapping) -> DataFrame:
    """(item_id, judge, prompt, key): one question for each judge and answer that does not decline."""
    rows = rel["outputs"].filter(assigned.is_judgeable(F.col("value"))).join(rel["items"].select("item_id", "text"), "item_id")
    prompt = F.concat(F.lit("ITEM:\n"), "text", F.lit(f"\n\n{config['field']}: "), "value")
    asked = rows.select("item_id", prompt.alias("prompt"), F.explode(F.array(*map(F.lit, config["judges"]))).alias("judge"))
    return asked.withColumn("key", F.sha2(F.concat_ws("\0", "judge", "prompt"), 256))


def plan(spark: SparkSession, config: Mapping, tree: trees.Taxonomy) -> DataFrame:
    """One row: the calls a run would make, and their tokens; nothing is asked."""
    return runs.plan(questions(relations(spark, config, tree), config).select(F.col("prompt").alias("text")), None)


def run(spark: SparkSession, config: Mapping, tree: trees.Taxonomy, out: str, providers: Mapping, when: datetime | None = None, reuse: DataFrame | None = None) -> str:
    """Findings, verdicts, risk rows and the index of one run under out; returns its folder. providers: judge -> callable.

    Answered questions of `reuse` (key, ...) are not asked again.
    """
    rel = relations(spark, config, tree)
    path = f"{out}/{run_name(config['project'], when or datetime.now(timezone.utc))}"
    found = findings(rel["outputs"], rel["taxonomy"])
    write_table(found, f"{path}/findings")
    write_table(rel["outputs"], f"{path}/outputs")
    asked = questions(rel, config)
    new = asked if reuse is None else runs.to_ask(asked, reuse)
    parts = [runs.parse_replies(runs.collect(new.filter(F.col("judge") == j).select("item_id", "prompt"), providers[j])).withColumn("judge", F.lit(j)) for j in config["judges"]]
    verdicts = parts[0]
    for p in parts[1:]:
        verdicts = verdicts.unionByName(p)
    keyed = verdicts.join(new.select("item_id", "judge", "key"), ["item_id", "judge"])
    append_verdicts(keyed if reuse is None else keyed.unionByName(reuse.join(asked.select("key"), "key", "left_semi")), f"{path}/verdicts")
    held = spark.read.parquet(f"{path}/verdicts")
    scores = ranking.raw_confidence(held)
    gates.assert_no_labels(scores)
    write_table(ranking.risk_rows(scores, held), f"{path}/risk")
    spark.createDataFrame([(json.dumps({"project": config["project"], "field": config["field"], "taxonomy": tree.ref, "digest": tree.digest()}),)], "value string").coalesce(1).write.text(f"{path}/run")
    append_index(spark, f"{out}/index", {"project": config["project"], "run_id": path.rpartition("/")[2], "at": when or datetime.now(timezone.utc), "items": rel["items"].count(), "calls": new.count()})
    return path


def loaded(spark: SparkSession, path: str) -> dict:
    """A finished run: its header and its tables."""
    return json.loads(spark.read.text(f"{path}/run").first().value) | {k: spark.read.parquet(f"{path}/{k}") for k in ("findings", "outputs", "verdicts")}


def strategies(held: Mapping[str, DataFrame], items: DataFrame | None = None) -> dict[str, DataFrame]:
    """Rankings (item_id, score) of a finished run: the judge's, and what it has to beat."""
    out = {"raw_confidence": ranking.raw_confidence(held["verdicts"]), "panel_disagreement": ranking.panel_disagreement(held["verdicts"]), "majority_label": ranking.majority_label(held["outputs"])}
    return out if items is None else out | {"output_length": ranking.output_length(items), "random": ranking.hash_uniform(items)}


def analyse(spark: SparkSession, path: str, config: Mapping | None = None, tree: trees.Taxonomy | None = None) -> list[tuple[str, object]]:
    """(name, value) of a finished run, without a call; what needs human labels is None without them.

    What a gate says is listed as `gate: ...`, and what it withholds as `withheld: ...`. All tables that come to the driver
    have a row for each check, judge, strategy or gate.
    """
    held = loaded(spark, path)
    health, panel = metrics.screen(held["verdicts"]), metrics.effective_votes(held["verdicts"])
    rates, votes = metrics.grain_rates(held["findings"]).first(), panel.first()
    out = [("findings", rates.findings), ("field rate", rates.field_rate), ("item rate", rates.item_rate), ("effective votes", votes.votes)]
    passed = held["findings"].filter(F.col("status").isin("pass", "fail")).groupBy("check").agg(F.avg((F.col("status") == "pass").cast("int")).alias("share"))
    out += [(f"passed {r.check}", r.share) for r in passed.orderBy("check").collect()]
    out += [(f"health of {r.judge}", r.flag) for r in health.orderBy("judge").collect()]
    rel = relations(spark, config, tree) if config and tree and config.get("labels") else None
    gate = guardrails.gate_one_rows(health, panel, held["outputs"], health.select("judge").limit(0))
    acc = pairs = quality = None
    if rel:
        acc = metrics.accuracy(metrics.buckets(held["outputs"], rel["labels"], rel["taxonomy"])).first()
        pairs = metrics.annotator_agreement(rel["labels"]).first()
        quality = ranking.calibration_quality(ranking.judged_pairs(held["verdicts"], held["outputs"], rel["labels"])).first()
        target = ranking.build_target(held["outputs"], rel["labels"])
        scored = guardrails.scored_strategies(strategies(held, rel["items"]), target)
        gate = gate.union(guardrails.gate_two_rows(scored, "raw_confidence", guardrails.normal_low(scored, "raw_confidence"), target))
    out += [("accuracy", acc and acc.accuracy), ("macro F1", acc and acc.macro_f1), ("annotators agree", pairs and pairs.agreement), ("calibration gap", quality and quality.ece)]
    if rel:
        out += [(f"area of {r.strategy}", r.auc) for r in scored.orderBy("strategy").collect()]
    out += [(f"gate: {r.id}", f"{r.severity}, {r.about}") for r in gate.orderBy("id", "about").collect()]
    return out + [(f"withheld: {r.metric}", r.reasons) for r in gates.withheld(guardrails.suppressions(gate)).orderBy("metric").collect()]


def triage_eval(spark: SparkSession, path: str, config: Mapping, tree: trees.Taxonomy) -> DataFrame:
    """(strategy, budget, k, recall, precision) of a finished run against the human labels."""
    held, rel = loaded(spark, path), relations(spark, config, tree)
    if rel["labels"] is None:
        raise BadInput("a ranking can only be evaluated against labels")
    ranked = strategies(held, rel["items"])
    del ranked["majority_label"]
    return evidence.compare_strategies(ranked, ranking.build_target(held["outputs"], rel["labels"]))


def compare(spark: SparkSession, a: str, b: str, mapping: DataFrame | None = None) -> tuple[DataFrame, DataFrame]:
    """(changes, shift of the labels) from one run to another; other versions of the tree need a mapping (old, new)."""
    x, y = loaded(spark, a), loaded(spark, b)
    if x["taxonomy"] != y["taxonomy"] and mapping is None:
        raise BadInput(f"{x['taxonomy']} and {y['taxonomy']} need a migration")
    if x["taxonomy"] == y["taxonomy"] and x["digest"] != y["digest"]:
        raise BadInput(f"{x['taxonomy']} has changed under the same version")
    before = runs.migrated(x["outputs"], mapping) if mapping is not None else x["outputs"]
    shift = assigned.share_shift(assigned.label_shares(before), assigned.label_shares(y["outputs"]))
    return runs.changes(runs.outcome_by_item(x["findings"]), runs.outcome_by_item(y["findings"])), shift
