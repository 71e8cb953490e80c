"""Risk scores, their ranking quality, calibration, review queues and gates."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from proofline.functions.sizes import small_side
from proofline.operators.assigned import is_abstain
from proofline.operators.metrics import judged_right, majority, primary_labels, sample_items
from proofline.operators.resampling import auc_draws

RANGES = 256
BUDGETS = (0.005, 0.01, 0.02, 0.05, 0.10, 0.20)


def identity_risk(status: Column, confidence: Column) -> Column:
    return F.when(status == "fail", confidence).when(status == "pass", 1 - confidence)


def raw_confidence(verdicts: DataFrame) -> DataFrame:
    return verdicts.groupBy("item_id").agg(F.round(F.max(identity_risk(F.col("status"), F.col("confidence"))), 6).alias("score"))


def hash_uniform(items: DataFrame, seed: str = "random") -> DataFrame:
    return items.select("item_id", (F.conv(F.substring(F.sha2(F.concat(F.lit(seed + "\0"), "item_id"), 256), 1, 8), 16, 10).cast("double") / 4294967296.0).alias("score"))


def output_length(texts: DataFrame) -> DataFrame:
    t = F.trim(F.regexp_replace(F.coalesce("text", F.lit("")), r"[ \t\n\r]+", " "))
    return texts.select("item_id", F.when(t == "", 0).otherwise(F.size(F.split(t, " "))).cast("double").alias("score"))


def majority_label(outputs: DataFrame) -> DataFrame:
    """1 where an answer differs from the commonest one."""
    top = outputs.filter("value IS NOT NULL").groupBy("value").count().agg(F.min_by("value", F.struct(-F.col("count"), "value")).alias("top"))
    return outputs.crossJoin(F.broadcast(top)).select("item_id", F.coalesce((F.col("value") != F.col("top")).cast("double"), F.lit(1.0)).alias("score"))  # by one row


def panel_disagreement(verdicts: DataFrame) -> DataFrame:
    share = F.col("approvals") / F.col("votes")
    return majority(verdicts).select("item_id", F.when(F.col("votes") >= 2, F.round(1 - F.abs(2 * share - 1), 6)).alias("score"))


def risk_rows(scores: DataFrame, verdicts: DataFrame, limit: int = 100) -> DataFrame:
    """The first of the review queue: greatest score first, missing scores last, ties by item."""
    mean = verdicts.groupBy("item_id").agg(F.round(F.avg("confidence"), 6).alias("raw_confidence_mean"))
    return scores.join(mean, "item_id", "left").orderBy(F.desc_nulls_last("score"), "item_id").limit(limit)


def build_target(outputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(item_id, error): whether an answer differs from the primary label; a missing one does."""
    return primary_labels(labels).join(outputs, "item_id").select("item_id", (~F.coalesce(F.col("value") == F.col("label"), F.lit(False))).alias("error"))


def degenerate_target(target: DataFrame, least: int = 30, share: float = 0.05) -> DataFrame:
    g = target.agg(F.count("*").alias("n"), F.count_if("error").alias("errors")).withColumn("minority", F.least("errors", F.col("n") - F.col("errors")))
    return g.select("n", "errors", "minority", ((F.col("minority") < least) | (F.col("minority") < share * F.col("n"))).alias("degenerate"))


def _with_lower(counts: DataFrame, ranges: int = RANGES) -> DataFrame:
    """counts (score, n, ...) with lower: how many rows have a lesser score. Summed within ranges that hold about equally many
    scores, and over the ranges, so no task holds all of them.
    """
    cuts = counts.agg(F.percentile_approx("score", [k / ranges for k in range(1, ranges)], 10_000)).first()[0] or []
    part = F.size(F.filter(F.array(*map(F.lit, cuts)), lambda c: c < F.col("score"))) if cuts else F.lit(0)
    ranged = counts.withColumn("part", part)
    sums = ranged.groupBy("part").agg(F.sum("n").alias("total")).withColumn("before", F.coalesce(F.sum("total").over(Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).select("part", "before")
    inside = F.coalesce(F.sum("n").over(Window.partitionBy("part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return ranged.withColumn("inside", inside).join(F.broadcast(sums), "part").withColumn("lower", F.col("before") + F.col("inside")).drop("part", "inside", "before")  # RANGES rows


def auc(scored: DataFrame) -> DataFrame:
    """One row from (score, error): n, errors and the area under the curve, ties at their mean rank.

    Scores are counted first, so ranks come from running sums over distinct scores.
    """
    d = scored.filter("score IS NOT NULL").groupBy("score").agg(F.count("*").alias("n"), F.count_if("error").alias("pos"))
    ranked = _with_lower(d).withColumn("rank", F.col("lower") + (F.col("n") + 1) / 2)
    g = ranked.agg(F.sum("n").alias("n"), F.sum("pos").alias("errors"), F.sum(F.col("rank") * F.col("pos")).alias("ranks"))
    neg = F.col("n") - F.col("errors")
    value = F.when((F.col("errors") > 0) & (neg > 0), (F.col("ranks") - F.col("errors") * (F.col("errors") + 1) / 2) / (F.col("errors") * neg))
    return g.select(F.coalesce("n", F.lit(0)).alias("n"), F.coalesce("errors", F.lit(0)).alias("errors"), F.round(value, 6).alias("auc"))


def recall_at_budget(scored: DataFrame, budgets: tuple[float, ...] = BUDGETS) -> DataFrame:
    """(budget, k, recall, precision) from (item_id, score, error): ties at the cut share what is left of the budget."""
    counts = scored.groupBy("score").agg(F.count("*").alias("n"), F.count_if("error").alias("pos"))
    total = counts.agg(F.sum("n").alias("all"), F.sum("pos").alias("errors"), F.sum(F.when(F.col("score").isNotNull(), F.col("n"))).alias("ranked"))
    above = _with_lower(counts.filter("score IS NOT NULL")).crossJoin(F.broadcast(total.select("ranked"))).withColumn("before", F.col("ranked") - F.col("lower") - F.col("n")).drop("ranked")  # by one row
    b = scored.sparkSession.createDataFrame([(x,) for x in budgets], "budget double").crossJoin(total).withColumn("k", F.least(F.greatest(F.lit(1), F.bround(F.col("budget") * F.col("all")).cast("long")), "ranked"))
    taken = above.crossJoin(F.broadcast(b)).withColumn("part", F.greatest(F.lit(0), F.least(F.col("n"), F.col("k") - F.col("before"))) / F.col("n"))  # by six budgets
    g = taken.groupBy("budget", "k", "errors").agg(F.sum(F.col("pos") * F.col("part")).alias("caught"))
    return g.select("budget", "k", F.round(F.try_divide("caught", "errors"), 6).alias("recall"), F.round(F.col("caught") / F.col("k"), 6).alias("precision"))


def bootstrap_auc(scored: DataFrame, resamples: int = 1000, seed: int = 7, most: int = 100_000) -> DataFrame:
    """One row: mean and 95 % interval of the AUC over resamples of items of scored (item_id, score, error), however many.

    Rows without an item_id can only be counted: their scores go to the tasks as counts of at most `most` distinct values,
    beyond which this raises.
    """
    if "item_id" in scored.columns:
        draws = auc_draws(scored, resamples, seed)
        return draws.agg(F.count("*").alias("resamples"), F.avg("value").alias("mean"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high"))
    d = scored.filter("score IS NOT NULL").groupBy("score").agg(F.count("*").alias("n"), F.count_if("error").alias("pos"))
    rows = d.limit(most + 1).toPandas().sort_values("score")
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct scores: round them first")
    pos, neg = rows.pos.to_numpy(), (rows.n - rows.pos).to_numpy()

    def draw(batches):
        for pdf in batches:
            out = []
            for i in pdf.id:
                rng = np.random.default_rng((seed, int(i)))
                total = int(pos.sum() + neg.sum())
                x = rng.multinomial(total, np.concatenate((pos, neg)) / max(total, 1)) if total else np.zeros(0, int)
                p, n = x[: len(pos)], x[len(pos) :]
                below = np.cumsum(n) - n
                out.append(float((p * (below + n / 2)).sum() / (p.sum() * n.sum())) if total and p.sum() and n.sum() else None)
            yield pd.DataFrame({"auc": out})

    draws = scored.sparkSession.range(resamples).mapInPandas(draw, "auc double").filter("auc IS NOT NULL")
    return draws.agg(F.count("*").alias("resamples"), F.avg("auc").alias("mean"), F.percentile("auc", 0.025).alias("low"), F.percentile("auc", 0.975).alias("high"))


def reliability(pairs: DataFrame, bins: int = 10) -> DataFrame:
    """(bin, n, stated, observed, reportable) from (confidence, right): equal bins, closed below, the last on both sides."""
    edge = F.coalesce(*(F.when(F.col("confidence") < (k + 1) / bins, F.lit(k)) for k in range(bins - 1)), F.lit(bins - 1))
    g = pairs.filter("confidence IS NOT NULL").groupBy(edge.cast("long").alias("bin")).agg(F.count("*").alias("n"), F.avg("confidence").alias("stated"), F.avg(F.col("right").cast("int")).alias("observed"))
    return g.select("bin", "n", F.round("stated", 6).alias("stated"), F.round("observed", 6).alias("observed"), (F.col("n") >= 20).alias("reportable"))


def calibration_quality(pairs: DataFrame) -> DataFrame:
    """One row: n, ece, brier, that of the base rate, and whether it beats it."""
    p = pairs.filter("confidence IS NOT NULL").withColumn("y", F.col("right").cast("double"))
    g = p.agg(F.count("*").alias("n"), F.avg(F.pow(F.col("confidence") - F.col("y"), 2)).alias("brier"), F.avg("y").alias("base"))
    e = reliability(pairs).agg(F.sum(F.col("n") * F.abs(F.col("stated") - F.col("observed"))).alias("gap"))
    base = F.col("base") * (1 - F.col("base"))
    return g.crossJoin(e).select("n", F.round(F.try_divide("gap", "n"), 5).alias("ece"), F.round("brier", 6).alias("brier"), F.round(base, 6).alias("brier_base_rate"), (F.col("brier") < base).alias("beats_base_rate"))  # one row by one


def fit_sigmoid(scores: np.ndarray, outcomes: np.ndarray, rounds: int = 100, tol: float = 1e-7) -> tuple[float, float]:
    """Platt's two parameters by Newton steps on smoothed targets: P(outcome) = 1 / (1 + exp(a s + b))."""
    good = int(outcomes.sum())
    bad = len(outcomes) - good
    t = np.where(outcomes, (good + 1) / (good + 2), 1 / (bad + 2))
    a, b = 0.0, float(np.log((bad + 1) / (good + 1)))
    for _ in range(rounds):
        p = 1 / (1 + np.exp(np.clip(a * scores + b, -500, 500)))
        w, d = p * (1 - p), t - p
        h11, h12, h22 = (w * scores**2).sum() + 1e-10, (w * scores).sum(), w.sum() + 1e-10
        g1, g2 = (d * scores).sum(), d.sum()
        det = h11 * h22 - h12 * h12
        if abs(det) < 1e-12:
            break
        da, db = -(h22 * g1 - h12 * g2) / det, -(h11 * g2 - h12 * g1) / det
        a, b = a + da, b + db
        if max(abs(da), abs(db)) < tol:
            break
    return a, b


def platt(pairs: DataFrame, least: int = 100) -> DataFrame:
    """(judge, n, a, b) of pairs (judge, confidence, right): fitted on counts of each confidence; null without enough rows of both classes."""
    counts = pairs.filter("confidence IS NOT NULL").groupBy("judge", F.round("confidence", 4).alias("confidence"), "right").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        s, y = np.repeat(pdf.confidence.to_numpy(), pdf.n), np.repeat(pdf.right.to_numpy(bool), pdf.n)
        a, b = fit_sigmoid(s, y) if len(y) >= least and y.any() and not y.all() else (None, None)
        return pd.DataFrame({"judge": [pdf.judge.iloc[0]], "n": [len(y)], "a": [a], "b": [b]})

    return counts.groupBy("judge").applyInPandas(fit, "judge string, n long, a double, b double")


def apply_platt(scored: DataFrame, curves: DataFrame) -> DataFrame:
    """scored (judge, confidence, ...) with the calibrated probability."""
    return scored.join(small_side(curves.select("judge", "a", "b")), "judge").withColumn("probability", 1 / (1 + F.exp(F.col("a") * F.col("confidence") + F.col("b")))).drop("a", "b")


def gated_plan(flagged: DataFrame, items: DataFrame, rate: float = 0.10, seed: str = "audit:value") -> DataFrame:
    """(item_id, reason): all flagged items, and a sample of max(1, round(rate * rest)) of the others by digest."""
    rest = items.select("item_id").join(flagged.select("item_id"), "item_id", "left_anti")
    n = rest.count()
    audit = sample_items(rest, max(1, round(rate * n)) if n else 0, seed)
    return flagged.select("item_id").distinct().withColumn("reason", F.lit("flagged")).union(audit.withColumn("reason", F.lit("audit")))


def gate_quality(plan: DataFrame, target: DataFrame) -> DataFrame:
    """One row: how many flagged items are wrong, how many audited ones are, as counts and rates."""
    j = plan.join(target, "item_id")
    at = lambda r: F.count_if(F.col("reason") == r)
    bad = lambda r: F.count_if((F.col("reason") == r) & F.col("error"))
    g = j.agg(at("flagged").alias("flagged"), bad("flagged").alias("flagged_wrong"), at("audit").alias("audited"), bad("audit").alias("audited_wrong"))
    return g.select("*", F.round(F.try_divide("flagged_wrong", "flagged"), 6).alias("precision"), F.round(F.try_divide("audited_wrong", "audited"), 6).alias("miss_rate"))


def unjudged(outputs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """(item_id, status) of every answer: a judge's verdict, or unscored where none was given or the answer declines."""
    v = verdicts.groupBy("item_id").agg(F.min_by("status", "judge").alias("said"))
    s = F.when(is_abstain(F.col("value")) | ~F.coalesce(F.col("said").isin("pass", "fail"), F.lit(False)), "unscored").otherwise(F.col("said"))
    return outputs.join(v, "item_id", "left").select("item_id", s.alias("status"))


def judged_pairs(verdicts: DataFrame, outputs: DataFrame, labels: DataFrame) -> DataFrame:
    """(judge, confidence, right): stated confidence, and whether the verdict itself turned out right."""
    return judged_right(verdicts, outputs, labels).select("judge", "confidence", (F.col("approved") == F.col("right")).alias("right"))
