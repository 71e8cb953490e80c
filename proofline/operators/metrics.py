"""Accuracy against human labels, and agreement of judges and annotators."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from proofline.functions.sizes import small_side
from proofline.operators.assigned import is_abstain

LONG = lambda c: F.coalesce(c, F.lit(0)).cast("long")


def primary_labels(labels: DataFrame) -> DataFrame:
    """(item_id, label): the answer of the first annotator by name."""
    return labels.groupBy("item_id").agg(F.min_by("label", "annotator").alias("label"))


def buckets(outputs: DataFrame, labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """(item_id, predicted, truth, bucket): how far each answer is from the primary label."""
    t = taxonomy.select("path", "parent")
    joined = outputs.join(primary_labels(labels), "item_id")
    joined = joined.join(small_side(t.select(F.col("path").alias("value"), F.col("parent").alias("p_parent"), F.lit(True).alias("p_known"))), "value", "left")
    joined = joined.join(small_side(t.select(F.col("path").alias("label"), F.col("parent").alias("t_parent"), F.lit(True).alias("t_known"))), "label", "left")
    bucket = F.when(is_abstain(F.col("value")), "abstained").when(F.col("p_known").isNull() | F.col("t_known").isNull(), "unknown").when(F.col("value") == F.col("label"), "exact").when(F.startswith("label", F.concat("value", F.lit("."))), "too_shallow").when(F.col("p_parent") == F.col("t_parent"), "right_parent").otherwise("wrong")
    return joined.select("item_id", F.col("value").alias("predicted"), F.col("label").alias("truth"), bucket.alias("bucket"))


def confusion(b: DataFrame, top: int = 10) -> DataFrame:
    wrong = b.filter((F.col("bucket") != "exact") & ~is_abstain(F.col("predicted")))
    return wrong.groupBy("truth", "predicted").agg(F.count("*").alias("n")).orderBy(F.desc("n"), "truth", "predicted").limit(top)


def per_label(b: DataFrame, floor: int = 30, weak: float = 0.5) -> DataFrame:
    """(label, support, predicted, correct, precision, recall, f1, under_floor, weak)."""
    support = b.groupBy(F.col("truth").alias("label")).agg(F.count("*").alias("support"), F.count_if(F.col("bucket") == "exact").alias("correct"))
    said = b.filter(~is_abstain(F.col("predicted"))).groupBy(F.col("predicted").alias("label")).agg(F.count("*").alias("predicted"))
    all_ = support.join(said, "label", "full_outer").select("label", *(LONG(F.col(c)).alias(c) for c in ("support", "predicted", "correct")))
    p, r = F.try_divide("correct", "predicted"), F.try_divide("correct", "support")
    f1 = F.when((F.coalesce(p, F.lit(0.0)) > 0) & (F.coalesce(r, F.lit(0.0)) > 0), 2 * p * r / (p + r)).otherwise(0.0)
    return all_.select("label", "support", "predicted", "correct", F.round(p, 6).alias("precision"), F.round(r, 6).alias("recall"), F.round(f1, 6).alias("f1"), (F.col("support") < floor).alias("under_floor"), F.coalesce(r < weak, F.lit(False)).alias("weak"))


def accuracy(b: DataFrame) -> DataFrame:
    """One row: n, exact, accuracy, majority (share of the commonest truth), beats_majority, macro_f1."""
    n = b.agg(F.count("*").alias("n"), F.count_if(F.col("bucket") == "exact").alias("exact"))
    by = per_label(b).filter("support > 0").agg(F.max("support").alias("most"), F.avg("f1").alias("f1"))
    acc, maj = F.try_divide("exact", "n"), F.try_divide("most", "n")
    return n.crossJoin(by).select("n", "exact", F.round(acc, 6).alias("accuracy"), F.round(maj, 6).alias("majority"), (acc > maj).alias("beats_majority"), F.round("f1", 6).alias("macro_f1"))  # one row by one


def confusion_direction(b: DataFrame, top: int = 10, report: int = 5, least: int = 10, share: float = 0.8) -> DataFrame:
    """(one, other, n, heavier, reading): which way each confused pair leans."""
    c = confusion(b, top).select(F.least("truth", "predicted").alias("one"), F.greatest("truth", "predicted").alias("other"), (F.col("truth") < F.col("predicted")).alias("forth"), "n")
    pair = c.groupBy("one", "other").agg(F.sum("n").alias("n"), F.sum(F.when(F.col("forth"), F.col("n")).otherwise(0)).alias("forth"))
    heavier = F.greatest("forth", F.col("n") - F.col("forth")) / F.col("n")
    reading = F.when(F.col("n") < least, "too few to tell").when(heavier >= share, "asymmetric").otherwise("symmetric")
    return pair.select("one", "other", "n", F.round(heavier, 6).alias("heavier"), reading.alias("reading")).orderBy(F.desc("n"), "one", "other").limit(report)


def label_findings(b: DataFrame) -> DataFrame:
    return b.select("item_id", F.when(F.col("bucket") == "exact", "pass").when(F.col("bucket") == "abstained", "unscored").otherwise("fail").alias("status"), "bucket")


def screen(verdicts: DataFrame) -> DataFrame:
    """(judge, calls, ..., approval, unreadable, flag): a judge's health. Approval is of scored calls, other rates of all."""
    n = lambda s: F.count_if(F.col("status") == s).alias(s)
    g = verdicts.groupBy("judge").agg(F.count("*").alias("calls"), *(n(s) for s in ("pass", "fail", "cannot_decide", "unparseable", "error")))
    approval, unreadable = F.try_divide("pass", F.col("pass") + F.col("fail")), F.col("unparseable") / F.col("calls")
    flag = F.when(approval.isNull() | ~approval.between(0.02, 0.98) | (unreadable > 0.05), "stop").when(~approval.between(0.15, 0.85) | (unreadable > 0.02), "warn").otherwise("ok")
    return g.select("judge", "calls", F.col("pass").alias("approvals"), F.col("fail").alias("rejections"), "cannot_decide", "unparseable", F.col("error").alias("errors"), F.round(approval, 6).alias("approval"), F.round(unreadable, 6).alias("unreadable"), flag.alias("flag"))


def unreadable_items(verdicts: DataFrame) -> DataFrame:
    """One row: how many replies could not be read, and their mean length against all."""
    bad = F.col("status") == "unparseable"
    return verdicts.agg(F.count_if(bad).alias("n"), F.bround(F.avg(F.when(bad, F.col("words"))), 1).alias("mean_failed"), F.bround(F.avg("words"), 1).alias("mean_all"))


def sample_items(items: DataFrame, n: int, seed: str = "panel") -> DataFrame:
    """n items in the order of a salted digest: the same ones wherever it runs."""
    return items.select("item_id").orderBy(F.sha2(F.concat(F.lit(seed + "\0"), "item_id"), 256)).limit(n)


def majority(verdicts: DataFrame) -> DataFrame:
    """(item_id, approvals, votes, status): strictly more than half decides; a tie or no votes is unscored."""
    g = verdicts.groupBy("item_id").agg(F.count_if(F.col("status") == "pass").alias("approvals"), F.count_if(F.col("status").isin("pass", "fail")).alias("votes"))
    return g.withColumn("status", F.when(F.col("approvals") * 2 > F.col("votes"), "pass").when(F.col("approvals") * 2 < F.col("votes"), "fail").otherwise("unscored"))


def decisions(verdicts: DataFrame) -> DataFrame:
    return verdicts.filter(F.col("status").isin("pass", "fail")).select("item_id", "judge", (F.col("status") == "pass").cast("int").alias("vote"))


def _judge_pairs(verdicts: DataFrame) -> DataFrame:
    d = decisions(verdicts)
    l, r = d.select("item_id", F.col("judge").alias("left"), F.col("vote").alias("a")), d.select("item_id", F.col("judge").alias("right"), F.col("vote").alias("b"))
    return l.join(r, "item_id").filter("left < right")


def pairwise_agreement(verdicts: DataFrame) -> DataFrame:
    """(left, right, n, agreement, phi): phi is null where a judge never varies."""
    g = _judge_pairs(verdicts).groupBy("left", "right").agg(F.count("*").alias("n"), F.avg((F.col("a") == F.col("b")).cast("int")).alias("agreement"), F.covar_pop("a", "b").alias("c"), F.var_pop("a").alias("va"), F.var_pop("b").alias("vb"))
    return g.select("left", "right", "n", F.round("agreement", 6).alias("agreement"), F.round(F.when((F.col("n") > 1) & (F.col("va") > 0) & (F.col("vb") > 0), F.col("c") / F.sqrt(F.col("va") * F.col("vb"))), 6).alias("phi"))


def effective_votes(verdicts: DataFrame) -> DataFrame:
    """One row: judges, mean correlation, and how many independent votes they amount to."""
    m = verdicts.agg(F.countDistinct("judge").alias("judges"))
    rho = pairwise_agreement(verdicts).agg(F.avg("phi").alias("rho"))
    below = 1 + (F.col("judges") - 1) * F.coalesce("rho", F.lit(0.0))
    votes = F.when(below <= 0, F.col("judges").cast("double")).otherwise(F.least(F.col("judges").cast("double"), F.col("judges") / below))
    return m.crossJoin(rho).select("judges", F.round("rho", 6).alias("rho"), F.round(votes, 6).alias("votes"), (votes < 0.5 * F.col("judges")).alias("warn"))  # one row by one


def leniency(verdicts: DataFrame) -> DataFrame:
    """(left, right, splits, left_approved): of the rows on which two judges split, how many the first approved."""
    return _judge_pairs(verdicts).filter("a <> b").groupBy("left", "right").agg(F.count("*").alias("splits"), F.count_if(F.col("a") == 1).alias("left_approved"))


def fuzzy_pairs(verdicts: DataFrame, outputs: DataFrame, taxonomy: DataFrame, top: int = 5) -> DataFrame:
    """(one, other, n): labels that judges confuse, from what rejecting judges would say instead on rows they split."""
    split = majority(verdicts).filter("approvals > 0 AND approvals < votes").select("item_id")
    said = verdicts.filter("status = 'fail' AND instead IS NOT NULL").join(split, "item_id").join(outputs.select("item_id", "value"), "item_id").filter("instead <> value")
    usable = said.join(small_side(taxonomy.select(F.col("path").alias("instead"))), "instead").select("item_id", "value", "instead").distinct()
    pair = usable.groupBy(F.least("value", "instead").alias("one"), F.greatest("value", "instead").alias("other")).agg(F.count("*").alias("n"))
    return pair.orderBy(F.desc("n"), "one", "other").limit(top)


def annotator_agreement(labels: DataFrame) -> DataFrame:
    """One row: doubly labelled pairs, how many agree, and the share of the commonest disagreement."""
    l, r = labels.select("item_id", F.col("annotator").alias("x"), F.col("label").alias("a")), labels.select("item_id", F.col("annotator").alias("y"), F.col("label").alias("b"))
    both = l.join(r, "item_id").filter("x < y").groupBy(F.least("a", "b").alias("one"), F.greatest("a", "b").alias("other")).agg(F.count("*").alias("n"))
    g = both.agg(LONG(F.sum("n")).alias("pairs"), LONG(F.sum(F.when(F.col("one") == F.col("other"), F.col("n")))).alias("agreed"), LONG(F.max(F.when(F.col("one") != F.col("other"), F.col("n")))).alias("top"))
    return g.select("pairs", "agreed", F.round(F.try_divide("agreed", "pairs"), 6).alias("agreement"), F.round(F.try_divide("top", F.col("pairs") - F.col("agreed")), 6).alias("concentration"))


def judged_right(verdicts: DataFrame, outputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(item_id, judge, confidence, approved, right): decided verdicts with whether the judged answer is the primary label."""
    truth = outputs.select("item_id", "value").join(primary_labels(labels), "item_id").select("item_id", F.coalesce(F.col("value") == F.col("label"), F.lit(False)).alias("right"))
    return verdicts.filter(F.col("status").isin("pass", "fail")).join(truth, "item_id").select("item_id", "judge", "confidence", (F.col("status") == "pass").alias("approved"), "right")


def judge_direction(verdicts: DataFrame, outputs: DataFrame, labels: DataFrame, ratio: float = 1.5) -> DataFrame:
    """(judge, n, approves_wrong, rejects_right, accuracy, always_approve, direction)."""
    g = judged_right(verdicts, outputs, labels).groupBy("judge").agg(F.count("*").alias("n"), F.count_if(F.expr("approved AND NOT right")).alias("approves_wrong"), F.count_if(F.expr("NOT approved AND right")).alias("rejects_right"), F.avg((F.col("approved") == F.col("right")).cast("int")).alias("accuracy"), F.avg(F.col("right").cast("int")).alias("always"))
    way = F.when(F.col("approves_wrong") > ratio * F.col("rejects_right"), "lenient").when(F.col("rejects_right") > ratio * F.col("approves_wrong"), "strict").otherwise("balanced")
    return g.select("judge", "n", "approves_wrong", "rejects_right", F.round("accuracy", 6).alias("accuracy"), F.round("always", 6).alias("always_approve"), way.alias("direction"))


def grain_rates(findings: DataFrame) -> DataFrame:
    """One row from findings (item_id, check, status): share of scored findings that pass, and of items all of whose scored findings pass."""
    scored = findings.filter(F.col("status").isin("pass", "fail"))
    field = scored.agg(F.count("*").alias("findings"), F.avg((F.col("status") == "pass").cast("int")).alias("f"))
    item = scored.groupBy("item_id").agg(F.min((F.col("status") == "pass").cast("int")).alias("ok")).agg(F.count("*").alias("items"), F.avg("ok").alias("i"))
    return field.crossJoin(item).select("findings", "items", F.round("f", 6).alias("field_rate"), F.round("i", 6).alias("item_rate"))  # one row by one
