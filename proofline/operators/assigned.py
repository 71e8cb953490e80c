"""Checks of assigned labels, item by item and over the corpus."""

from __future__ import annotations

import difflib

import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from proofline.functions.sizes import SMALL_ROWS, small_side

ABSTAIN = "abstain"
STOPLIST = ("and", "the", "of", "with", "that", "for", "from", "this", "are", "was")


def is_abstain(value: Column) -> Column:
    return value.isNull() | (value == ABSTAIN)


def is_judgeable(value: Column) -> Column:
    return ~is_abstain(value) & (F.trim(value) != "")


def label_in_taxonomy(outputs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(item_id, value, status) of every output that does not abstain."""
    known = small_side(taxonomy.select(F.col("path").alias("value"), F.lit(True).alias("known")))
    return outputs.filter(~is_abstain(F.col("value"))).join(known, "value", "left").select("item_id", "value", F.when(F.col("known"), "pass").otherwise("fail").alias("status"))


def nearest_labels(outputs: DataFrame, taxonomy: DataFrame, n: int = 3, cutoff: float = 0.5) -> DataFrame:
    """(value, nearest) of every invented label: its close matches by difflib, one row for each distinct label."""
    paths = [r.path for r in taxonomy.select("path").orderBy("path").limit(SMALL_ROWS + 1).collect()]
    if len(paths) > SMALL_ROWS:
        raise ValueError(f"a taxonomy of more than {SMALL_ROWS} labels")

    @F.pandas_udf("array<string>")
    def close(value: pd.Series) -> pd.Series:
        return value.map(lambda v: difflib.get_close_matches(v, paths, n, cutoff))

    bad = label_in_taxonomy(outputs, taxonomy).filter("status = 'fail'").select("value").distinct()
    return bad.select("value", F.concat_ws(",", close("value")).alias("nearest"))


def valid_leaf(outputs: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(item_id, value, status, children) of known labels: fail where the node has children."""
    child = taxonomy.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.concat_ws(",", F.sort_array(F.collect_list("path"))).alias("children"))
    nodes = small_side(taxonomy.select("path").join(child, "path", "left"))
    return outputs.join(nodes, outputs.value == nodes.path).select("item_id", "value", F.when(F.col("children").isNull(), "pass").otherwise("fail").alias("status"), F.coalesce("children", F.lit("")).alias("children"))


def abstention_allowed(outputs: DataFrame) -> DataFrame:
    return outputs.filter(is_abstain(F.col("value"))).select("item_id", F.lit("fail").alias("status"))


def abstention_rate(outputs: DataFrame, low: float = 0.01, high: float = 0.20) -> DataFrame:
    """One row: rate over all outputs and its status; too few rows to reach the lower bound leave it unscored."""
    r = outputs.agg(F.count("*").alias("n"), F.count_if(is_abstain(F.col("value"))).alias("abstained")).withColumn("rate", F.try_divide("abstained", "n"))
    status = F.when(F.col("n") == 0, "unscored").when(F.col("rate") > high, "fail").when(F.col("rate") >= low, "pass").when(1 / F.col("n") > low, "unscored").otherwise("fail")
    return r.select("n", "abstained", F.round("rate", 6).alias("rate"), status.alias("status"))


def label_shares(outputs: DataFrame, value: str = "value") -> DataFrame:
    """(label, n, share) over outputs that do not abstain. Labels are few: the total is a window over them."""
    counts = outputs.filter(~is_abstain(F.col(value))).groupBy(F.col(value).alias("label")).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    return counts.crossJoin(F.broadcast(total)).select("label", "n", (F.col("n") / F.col("total")).alias("share"))  # one row by few labels


def label_collapse(outputs: DataFrame, most: float = 0.5) -> DataFrame:
    """One row: the commonest label (ties: the first by name), its share, the number of labels, and whether it is within bounds."""
    top = label_shares(outputs).agg(F.min_by("label", F.struct(-F.col("n"), "label")).alias("label"), F.max("share").alias("share"), F.count("*").alias("labels"))
    return top.select("label", F.bround("share", 4).alias("share"), "labels", F.when(F.col("share") <= most, "pass").otherwise("fail").alias("status"))


def share_shift(old: DataFrame, new: DataFrame) -> DataFrame:
    """(label, before, after, delta) of two share tables."""
    a, b = old.select("label", F.col("share").alias("a")), new.select("label", F.col("share").alias("b"))
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    return a.join(b, "label", "full_outer").select("label", F.round(zero("a"), 6).alias("before"), F.round(zero("b"), 6).alias("after"), F.bround(zero("b") - zero("a"), 4).alias("delta"))


def drift(previous: DataFrame, current: DataFrame, most: float = 0.10, value: str = "label") -> DataFrame:
    """One row: the label whose share moved most since the previous run, and whether that is within bounds."""
    shift = share_shift(label_shares(previous, value), label_shares(current, value))
    worst = shift.agg(F.min_by(F.struct("label", "delta"), F.struct(-F.abs("delta"), "label")).alias("w"))
    return worst.select("w.label", "w.delta", F.when(F.abs("w.delta") <= most, "pass").otherwise("fail").alias("status"))


def vocabulary(taxonomy: DataFrame, least: int = 3) -> DataFrame:
    """(path, word): words of a node's name, path and definition and of its ancestors', without stop words."""
    own = taxonomy.select("path", "parent", F.explode(F.regexp_extract_all(F.lower(F.concat_ws(" ", "name", F.translate("path", ".", " "), "definition")), F.lit("[a-z0-9]+"), F.lit(0))).alias("word"))
    own = own.filter((F.length("word") >= least) & ~F.col("word").isin(*STOPLIST))
    above = taxonomy.select("path", F.explode(F.transform(F.sequence(F.lit(1), F.size(F.split("path", r"\."))), lambda k: F.array_join(F.slice(F.split("path", r"\."), 1, k), "."))).alias("node"))
    return above.join(own.select(F.col("path").alias("node"), "word"), "node").select("path", "word").distinct()


def cross_field_agreement(outputs: DataFrame, texts: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(item_id, status, score): words that the text (item_id, text) shares with its label's vocabulary; unscored without text or a known label."""
    vocab = vocabulary(taxonomy).groupBy(F.col("path").alias("value")).agg(F.collect_set("word").alias("vocab"))
    joined = outputs.join(texts, "item_id").join(small_side(vocab), "value", "left")
    said = F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit("[a-z0-9]+"), F.lit(0)))
    score = F.size(F.array_intersect(said, "vocab"))
    scored = joined.withColumn("score", F.when((F.trim("text") != "") & F.col("vocab").isNotNull() & ~is_abstain(F.col("value")), score).cast("double"))
    return scored.select("item_id", F.when(F.col("score").isNull(), "unscored").when(F.col("score") > 0, "pass").otherwise("fail").alias("status"), "score")
