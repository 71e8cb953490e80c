"""An audit of many fields of several kinds: every free check as one table of findings, and the questions that they lead to."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from dataclasses import dataclass, field as _field
from typing import Any

from pyspark.sql import Column, DataFrame, functions as F

from proofline.functions import settings
from proofline.operators import assigned as A, copied as C, free_text as T, judging as Q, ranking as K
from proofline.sources.readers import BadInput
from proofline.sources.scratch import stored

COLUMNS = ("field", "check", "grain", "item_id", "status", "score")


@dataclass(frozen=True)
class Field:
    """A column of the outputs: its kind (assigned, free_text or copied) and what its checks need to know."""

    name: str
    kind: str
    taxonomy: DataFrame | None = None
    value_type: str = "text"
    agrees_with: str | None = None  # of a free text: the assigned field whose vocabulary it should use
    settings: Mapping[str, Any] = _field(default_factory=dict)

    def __post_init__(self):
        if self.kind not in Q.TASKS:
            raise BadInput(f"{self.name}: expected a kind of {', '.join(Q.TASKS)}")
        if self.kind == "assigned" and self.taxonomy is None:
            raise BadInput(f"{self.name}: an assigned field needs a taxonomy")
        settings.check(self.settings)

    def setting(self, name: str, project: Mapping[str, Any] | None) -> Any:
        return settings.resolve(name, self.settings, project).value


def _part(df: DataFrame, field: Field, check: str, grain: str = "field", score: Column | None = None) -> DataFrame:
    item = F.col("item_id") if grain == "field" else F.lit(None).cast("string")
    return df.select(F.lit(field.name).alias("field"), F.lit(check).alias("check"), F.lit(grain).alias("grain"), item.alias("item_id"), F.col("status"), (F.lit(None) if score is None else score).cast("double").alias("score"))


def _assigned(field: Field, rows: DataFrame, project) -> list[DataFrame]:
    answers = rows.select("item_id", "value")
    out = [_part(A.label_in_taxonomy(answers, field.taxonomy), field, "label_in_taxonomy")]
    if field.setting("require_leaf", project):
        out.append(_part(A.valid_leaf(answers, field.taxonomy), field, "valid_leaf"))
    if not field.setting("allow_abstain", project):
        out.append(_part(A.abstention_allowed(answers), field, "abstention_allowed"))
    low, high = field.setting("abstain_rate", project)
    out.append(_part(A.abstention_rate(answers, low, high), field, "abstention_rate", "corpus", F.col("rate")))
    out.append(_part(A.label_collapse(answers, field.setting("max_label_share", project)), field, "label_collapse", "corpus", F.col("share")))
    return out


def _free_text(field: Field, rows: DataFrame, project, others: Mapping[str, Field], outputs: DataFrame, postings: int | None) -> list[DataFrame]:
    written = rows.filter(Q.has_text(F.col("value")))
    texts = rows.select("item_id", F.col("value").alias("text"))
    pairs = written.select("item_id", F.coalesce("text", F.lit("")).alias("source"), F.col("value").alias("written"))
    low, high = field.setting("min_words", project), field.setting("max_words", project)
    out = []
    if low is not None or high is not None:
        out.append(_part(T.length_in_bounds(texts, low, high), field, "length_in_bounds", score=F.col("n_words")))
    out.append(_part(T.specificity(pairs), field, "specificity", score=F.col("used")))
    out.append(_part(T.copy_ratio(pairs, field.setting("max_copy_ratio", project)), field, "copy_ratio", score=F.col("ratio")))
    said = written.select("item_id", F.col("value").alias("text"))
    out.append(_part(T.alike(said, postings=postings).withColumn("status", F.lit("fail")), field, "boilerplate", score=F.col("score")))
    if field.agrees_with:
        other = others.get(field.agrees_with)
        if other is None or other.kind != "assigned":
            raise BadInput(f"{field.name}: {field.agrees_with} is no assigned field")
        answers = outputs.select("item_id", F.col(other.name).cast("string").alias("value"))
        out.append(_part(A.cross_field_agreement(answers, texts.withColumn("text", F.coalesce("text", F.lit(""))), other.taxonomy), field, "cross_field_agreement", score=F.col("score")))
    return out


def _copied(field: Field, rows: DataFrame, project) -> list[DataFrame]:
    values = rows.select("item_id", F.coalesce("text", F.lit("")).alias("source"), "value")
    kind, verbatim = field.value_type, field.setting("require_verbatim", project)
    out = []
    if kind != "text":
        out.append(_part(C.value_shape(values, "value", kind), field, "value_shape"))
        many = C.ambiguous(values.filter(Q.has_text(F.col("value"))), kind, field.setting("ambiguous_above", project))
        out.append(_part(many.withColumn("status", F.lit("unscored")), field, "ambiguous", score=F.col("candidates")))
    out.append(_part(C.value_in_source(values, "value", kind, verbatim), field, "value_in_source"))
    out.append(_part(C.grounding_rate(values, "value", kind, field.setting("min_grounding", project)), field, "grounding_rate", "corpus", F.col("rate")))
    return out


def audit(items: DataFrame, outputs: DataFrame, fields: Sequence[Field], project: Mapping[str, Any] | None = None, postings: int | None = None) -> DataFrame:
    """Findings (field, check, grain, item_id, status, score) of items (item_id, text) and outputs (item_id, a column a field).

    Outputs without an item are left out. A corpus finding has no item. `ambiguous` rows are unscored: they say that the
    source holds several values of the kind, so that a found one may be another. A missing column raises. With `postings`, texts
    only count as boilerplate if they share a shingle with no more texts than that.
    """
    known = {f.name: f for f in fields}
    if missing := [n for n in known if n not in outputs.columns]:
        raise BadInput(f"the outputs have no column {', '.join(missing)}")
    # Every check reads the outputs, and what they come from may be long. The size of their files is no measure for a broadcast.
    outputs = stored(outputs.select("item_id", *known), "outputs").hint("merge")
    joined = outputs.join(items.select("item_id", "text"), "item_id")
    parts: list[DataFrame] = []
    for f in fields:
        rows = joined.select("item_id", "text", F.col(f.name).cast("string").alias("value"))
        parts += _assigned(f, rows, project) if f.kind == "assigned" else _free_text(f, rows, project, known, joined.drop("text"), postings) if f.kind == "free_text" else _copied(f, rows, project)
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out.select(*COLUMNS)


def _bad() -> Column:
    return (F.col("status") == "fail") | (F.col("check") == "ambiguous")


def suspicious(findings: DataFrame, field: str) -> DataFrame:
    """(item_id) that a check of the field failed, or whose value could be another of the source's."""
    return findings.filter((F.col("field") == field) & F.col("item_id").isNotNull() & _bad()).select("item_id").distinct()


def questions(items: DataFrame, outputs: DataFrame, findings: DataFrame, fields: Sequence[Field], judges: Sequence[str], project: Mapping[str, Any] | None = None) -> DataFrame:
    """(item_id, judge, field, prompt, key, selected_by): every row of an assigned field; of the other kinds what is suspicious,
    and an audited sample of the rest.
    """
    joined, out = outputs.join(items.select("item_id", "text"), "item_id"), None
    gated = [f.name for f in fields if Q.TASKS[f.kind].gated]
    found = stored(findings.filter(F.col("field").isin(gated) & F.col("item_id").isNotNull() & _bad()).select("field", "item_id").distinct(), "suspicious") if gated else None
    for f in fields:
        rows = joined.select("item_id", "text", F.col(f.name).cast("string").alias("value"))
        if Q.TASKS[f.kind].gated:
            can = rows.filter(Q.TASKS[f.kind].judgeable(F.col("value")))
            plan = K.gated_plan(found.filter(F.col("field") == f.name).select("item_id").join(can.select("item_id"), "item_id", "left_semi"), can, f.setting("audit_rate", project), f"audit:{f.name}")
            asked = Q.questions(rows, f.kind, f.name, judges).join(plan.withColumnRenamed("reason", "selected_by"), "item_id")
        else:
            asked = Q.questions(rows, f.kind, f.name, judges).withColumn("selected_by", F.lit("triage"))
        asked = asked.select("item_id", "judge", "field", "prompt", "key", "selected_by")
        out = asked if out is None else out.union(asked)
    return out
