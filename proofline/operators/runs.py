"""Runs: loading, indexes, comparison, migration, stability, budgets, caches, plans and replies of judges."""

from __future__ import annotations

import hashlib
import json
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from proofline.functions.sizes import small_side
from proofline.operators.assigned import is_abstain, label_shares, share_shift

SLICE = 64  # prompts that a task holds at once as Python's


def duplicate_ids(items: DataFrame) -> DataFrame:
    return items.groupBy("item_id").agg(F.count("*").alias("n")).filter("n > 1")


def index_items(items: DataFrame) -> DataFrame:
    """items; raises if an id repeats."""
    bad = duplicate_ids(items).limit(5).collect()
    if bad:
        raise ValueError("duplicate item ids: " + ", ".join(r.item_id for r in bad))
    return items


def load_log(items: DataFrame, outputs: DataFrame) -> DataFrame:
    """(reason, n): what a run leaves out, and what it keeps."""
    full = items.filter((F.trim(F.coalesce("text", F.lit(""))) != "")).select("item_id")
    part = lambda df, r: df.agg(F.count("*").alias("n")).select(F.lit(r).alias("reason"), "n")
    empty = items.filter(F.trim(F.coalesce("text", F.lit(""))) == "")
    return part(empty, "empty text").union(part(outputs.join(items, "item_id", "left_anti"), "output without item")).union(part(full.join(outputs, "item_id", "left_anti"), "item without output")).union(part(full.join(outputs, "item_id", "left_semi"), "kept"))


def last_outputs(outputs: DataFrame) -> DataFrame:
    """The last row of each item by ord."""
    return outputs.groupBy("item_id").agg(F.max_by("value", "ord").alias("value"))


def modes(labels: DataFrame) -> DataFrame:
    """One row: mode 0 without labels, 2 if any item has two annotators, else 1; items labelled, and labelled twice."""
    g = labels.groupBy("item_id").agg(F.countDistinct("annotator").alias("k")).agg(F.count("*").alias("labelled"), F.count_if(F.col("k") > 1).alias("twice"))
    return g.select(F.when(F.col("labelled") == 0, 0).when(F.col("twice") > 0, 2).otherwise(1).cast("long").alias("mode"), "labelled", "twice")


def outcome_by_item(findings: DataFrame) -> DataFrame:
    return findings.filter(F.col("status").isin("pass", "fail")).groupBy("item_id").agg(F.bool_and(F.col("status") == "pass").alias("ok"))


def changes(a: DataFrame, b: DataFrame) -> DataFrame:
    """(change, n) of two outcome tables (item_id, ok)."""
    j = a.select("item_id", F.col("ok").alias("x")).join(b.select("item_id", F.col("ok").alias("y")), "item_id", "full_outer")
    change = F.when(F.col("x").isNull(), "only_in_b").when(F.col("y").isNull(), "only_in_a").when(F.col("x") == F.col("y"), "unchanged").when(F.col("y"), "improved").otherwise("regressed")
    return j.groupBy(change.alias("change")).agg(F.count("*").alias("n"))


def migrated(outputs: DataFrame, mapping: DataFrame) -> DataFrame:
    """outputs with each label as the mapping (old, new) has it; dropped and unknown labels are null."""
    return outputs.join(small_side(mapping), outputs.value == mapping.old, "left").select("item_id", F.col("new").alias("value"))


def distribution_shift(a: DataFrame, b: DataFrame, mapping: DataFrame) -> DataFrame:
    return share_shift(label_shares(migrated(a, mapping)), label_shares(migrated(b, mapping)))


def untranslated(outputs: DataFrame, mapping: DataFrame) -> DataFrame:
    """(value, why, n): answers that a mapping (old, new) leaves out of a comparison, because it drops the label or does not know it."""
    known = small_side(mapping.select(F.col("old").alias("value"), "new", F.lit(True).alias("known")))
    lost = outputs.filter(~is_abstain(F.col("value"))).join(known, "value", "left").filter("new IS NULL")
    return lost.groupBy("value", F.when(F.col("known"), "dropped").otherwise("unknown").alias("why")).agg(F.count("*").alias("n"))


def merged_labels(mapping: DataFrame) -> DataFrame:
    return mapping.filter("new IS NOT NULL").groupBy("new").agg(F.count("*").alias("n"), F.concat_ws(",", F.sort_array(F.collect_list("old"))).alias("olds")).filter("n > 1")


def stability(generations: DataFrame, least: float = 0.90) -> DataFrame:
    """One row: items answered more than once, and the share of those with one answer throughout."""
    g = generations.groupBy("item_id").agg(F.count("*").alias("k"), F.countDistinct("value").alias("v")).filter("k > 1")
    s = g.agg(F.count("*").alias("items"), F.count_if(F.col("v") == 1).alias("agreed"))
    return s.select("items", "agreed", F.round(F.try_divide("agreed", "items"), 6).alias("stability"), F.when(F.col("items") == 0, "unscored").when(F.col("agreed") >= least * F.col("items"), "pass").otherwise("fail").alias("status"))


def budget(calls: DataFrame, cap: int, span: int = 100_000) -> DataFrame:
    """(seq, cents, status): a call is made while what was spent before it is under the cap. Spending is summed in spans of seq, then over the spans."""
    part = calls.withColumn("part", F.floor(F.col("seq") / span))
    sums = part.groupBy("part").agg(F.sum("cents").alias("c")).withColumn("before", F.coalesce(F.sum("c").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inside = F.coalesce(F.sum("cents").over(Window.partitionBy("part").orderBy("seq").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    spent = part.withColumn("inside", inside).join(sums, "part").withColumn("spent", F.col("before") + F.col("inside"))
    return spent.select("seq", "cents", F.when(F.col("spent") < cap, "called").otherwise("unscored").alias("status"))


def cache_keys(outputs: DataFrame, judge: str, model: str, prompt: str, field: str) -> DataFrame:
    """(item_id, key): what names a question to a judge."""
    return outputs.select("item_id", F.sha2(F.concat_ws("\0", F.lit(judge), F.lit(model), F.lit(prompt), "item_id", F.lit(field), F.coalesce("value", F.lit(""))), 256).alias("key"))


def to_ask(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """Questions (key) that the cache does not answer, once each."""
    return questions.dropDuplicates(["key"]).join(cache.select("key"), "key", "left_anti")


def plan(prompts: DataFrame, dollars_per_million: float | None = 1.0) -> DataFrame:
    """One row: calls, tokens (four characters each) and their price; an unknown price is null."""
    g = prompts.agg(F.count("*").alias("calls"), F.sum(F.floor(F.length("text") / 4)).alias("tokens"))
    return g.select("calls", "tokens", F.round(F.col("tokens") * F.lit(dollars_per_million).cast("double") / 1e6, 6).alias("dollars"))


def parse_replies(replies: DataFrame) -> DataFrame:
    """(item_id, status, confidence, instead): a verdict from the text between the first { and the last }; a string is no boolean, and a confidence outside 0..1 is dropped."""
    body = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    v = F.try_parse_json(F.when(body != "", body))
    is_bool = F.schema_of_variant(F.try_variant_get(v, "$.correct", "variant")) == "BOOLEAN"
    right = F.when(is_bool, F.try_variant_get(v, "$.correct", "boolean"))
    c = F.try_variant_get(v, "$.confidence", "double")
    unsure = F.coalesce(F.try_variant_get(v, "$.correct", "string") == "cannot_decide", F.lit(False))
    status = F.when(unsure, "cannot_decide").when(right.isNull(), "unparseable").when(right, "pass").otherwise("fail")
    return replies.select("item_id", status.alias("status"), F.when(right.isNotNull() & c.between(0, 1), F.round(c, 6)).alias("confidence"), F.when(right == F.lit(False), F.try_variant_get(v, "$.instead", "string")).alias("instead"))


def scripted_provider(judge: str, approve: float = 0.75) -> Callable[[str], str]:
    """A provider without a network: answers by a digest of the question."""

    def ask(prompt: str) -> str:
        roll = int.from_bytes(hashlib.blake2b(f"{judge}\0{prompt}".encode(), digest_size=8).digest(), "big") / 2**64
        return json.dumps({"correct": roll < approve, "confidence": round(0.55 + 0.44 * ((roll * 997) % 1), 4)})

    return ask


def sliced(batches: Iterator[pa.RecordBatch], rows: int = SLICE) -> Iterator[list[pa.Array]]:
    """The columns of a few rows at a time: a batch may hold 10,000 prompts, of which only these become Python's."""
    for batch in batches:
        for at in range(0, batch.num_rows, rows):
            yield batch.slice(at, rows).columns


def collect(questions: DataFrame, provider: Callable[[str], str], retries: int = 3) -> DataFrame:
    """(item_id, reply): a provider's answers, asked in the tasks; a question that fails after all retries has a null reply."""

    def one(prompt: str) -> str | None:
        for _ in range(retries):
            try:
                return provider(prompt)
            except (TimeoutError, ConnectionError):
                continue
        return None

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, prompts in sliced(batches):
            yield pa.RecordBatch.from_arrays([ids, pa.array(map(one, prompts.to_pylist()), pa.string())], ["item_id", "reply"])

    return questions.select(F.col("item_id").cast("string"), "prompt").mapInArrow(ask, "item_id string, reply string")
