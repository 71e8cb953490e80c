"""How the relations of a run meet: each join with its keys, its side and what it leaves out."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofline.functions.sizes import small_side
from proofline.operators.assigned import label_shares
from proofline.operators.free_text import POSTINGS
from proofline.operators.metrics import decisions, primary_labels
from proofline.operators.shingles import shared_counts


def outputs_with_items(outputs: DataFrame, items: DataFrame) -> DataFrame:
    """Outputs whose item is known, with its text."""
    return outputs.join(items.select("item_id", "text"), "item_id")


def items_without_outputs(items: DataFrame, outputs: DataFrame) -> DataFrame:
    return items.join(outputs.select("item_id"), "item_id", "left_anti")


def values_in_tree(outputs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(item_id, value, known, is_leaf): every output, whether or not the tree has its value."""
    nodes = small_side(taxonomy.select(F.col("path").alias("value"), F.lit(True).alias("known"), "is_leaf"))
    return outputs.join(nodes, "value", "left").select("item_id", "value", F.coalesce("known", F.lit(False)).alias("known"), "is_leaf")


def answers_with_truth(outputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(item_id, value, label): outputs that have a primary label."""
    return outputs.select("item_id", "value").join(primary_labels(labels), "item_id")


def verdicts_with_truth(verdicts: DataFrame, outputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(item_id, judge, status, value, label): verdicts on outputs that have a primary label."""
    return verdicts.select("item_id", "judge", "status").join(answers_with_truth(outputs, labels), "item_id")


def findings_with_ratings(findings: DataFrame, ratings: DataFrame) -> DataFrame:
    """(item_id, check, status, boxes): findings of items that a human rated, with the boxes ticked."""
    boxes = ratings.groupBy("item_id").agg(F.array_join(F.sort_array(F.collect_set("label")), ",").alias("boxes"))
    return findings.join(boxes, "item_id").select("item_id", "check", "status", "boxes")


def judge_by_judge(verdicts: DataFrame) -> DataFrame:
    """(item_id, left, right, a, b): decided votes of every two judges on one item, left before right by name."""
    d = decisions(verdicts)
    one, other = d.select("item_id", F.col("judge").alias("left"), F.col("vote").alias("a")), d.select("item_id", F.col("judge").alias("right"), F.col("vote").alias("b"))
    return one.join(other, "item_id").filter("left < right").select("item_id", "left", "right", "a", "b")


def annotator_by_annotator(labels: DataFrame) -> DataFrame:
    """(item_id, left, right, a, b): labels of every two annotators of one item, left before right by name."""
    side = lambda n, v: labels.select("item_id", F.col("annotator").alias(n), F.col("label").alias(v))
    return side("left", "a").join(side("right", "b"), "item_id").filter("left < right").select("item_id", "left", "right", "a", "b")


def texts_by_shingle(texts: DataFrame, postings: int = POSTINGS) -> DataFrame:
    """(item_id, shared): how many of a text's shingles stand in 2 to `postings` texts, so how many lists it is compared over."""
    return shared_counts(texts, postings)


def definitions_by_definition(taxonomy: DataFrame) -> DataFrame:
    """(left, right, shared): words that the definitions of every two nodes share, left before right by path; the tree is a
    small side twice over.
    """
    w = taxonomy.select("path", F.array_distinct(F.split(F.lower("definition"), " ")).alias("words"))
    a, b = w.select(F.col("path").alias("left"), F.col("words").alias("x")), w.select(F.col("path").alias("right"), F.col("words").alias("y"))
    return a.join(small_side(b), F.col("left") < F.col("right")).select("left", "right", F.size(F.array_intersect("x", "y")).cast("long").alias("shared"))


def cache_probe(questions: DataFrame, cache: DataFrame) -> DataFrame:
    """(key, hit): every distinct question, and whether the cache answers it."""
    held = cache.select("key", F.lit(True).alias("hit")).distinct()
    return questions.select("key").distinct().join(held, "key", "left").select("key", F.coalesce("hit", F.lit(False)).alias("hit"))


def share_vectors(a: DataFrame, b: DataFrame) -> DataFrame:
    """(label, before, after): counts of each label in two runs, zero where one has none."""
    part = lambda o, n: label_shares(o).select("label", F.col("n").alias(n))
    none = lambda c: F.coalesce(c, F.lit(0)).cast("long").alias(c)
    return part(a, "before").join(part(b, "after"), "label", "full_outer").select("label", none("before"), none("after"))


def outcome_pairs(a: DataFrame, b: DataFrame) -> DataFrame:
    """(item_id, before, after) of two outcome tables (item_id, ok); null where a run has none."""
    return a.select("item_id", F.col("ok").alias("before")).join(b.select("item_id", F.col("ok").alias("after")), "item_id", "full_outer")


def ancestors(path: Column) -> Column:
    """Paths of the nodes above a label, from the root on."""
    parts = F.split(path, r"\.")
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda k: F.array_join(F.slice(parts, 1, k - 1), "."))


def above_truth(outputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(item_id, value, label): answers that name a node above the true one."""
    return answers_with_truth(outputs, labels).filter(F.array_contains(F.filter(ancestors(F.col("label")), lambda p: p != ""), F.col("value")))
