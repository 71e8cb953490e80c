"""Claims and defect boxes, panels, strategies side by side, intervals by resampling items, and deltas between runs."""

from __future__ import annotations

from collections.abc import Callable, Mapping

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F

from proofline.functions.sizes import small_side
from proofline.operators.metrics import accuracy, buckets, sample_items, screen
from proofline.operators.resampling import mean_draws, recall_draws
from proofline.operators.ranking import BUDGETS, fit_sigmoid, identity_risk, recall_at_budget

#: The boxes that a human may tick, and the check each is compared with.
DEFECTS = {"made_up": "claims_supported", "too_generic": "specificity", "contradicts": "cross_field_agreement", "missing": "claims_missing"}
CLEAN = "none"
MOST_PROFILES = 100_000  # distinct items that a resampling may hold


def _truthy(v: Column) -> Column:
    """Whether a variant is true, a number other than zero, or a string that is not empty."""
    kind = F.schema_of_variant(v)
    as_ = lambda t: F.try_variant_get(v, "$", t)
    return F.when(kind == "BOOLEAN", as_("boolean")).when(kind == "VOID", False).when(kind == "STRING", as_("string") != "").otherwise(F.coalesce(as_("double") != 0, F.lit(True)))


def parse_claims(replies: DataFrame) -> DataFrame:
    """(item_id, claims, unsupported, rate, status, confidence, missing) of replies (item_id, reply).

    The status says whether anything was unsupported; confidence is the rate on a pass and the rest on a fail. A reply
    without a list of claims that carry `supported` is unparseable, with nulls.
    """
    body = F.regexp_extract("reply", r"(?s)\{.*\}", 0)
    v = F.try_parse_json(F.when(body != "", body))
    got = F.filter(F.try_variant_get(v, "$.claims", "array<variant>"), lambda x: F.try_variant_get(x, "$.supported", "variant").isNotNull())
    held = replies.select("item_id", F.transform(got, lambda x: _truthy(F.try_variant_get(x, "$.supported", "variant"))).alias("held"), F.trim(F.try_variant_get(v, "$.missing", "string")).alias("missing"))
    n = F.when(F.size("held") > 0, F.size("held").cast("long"))
    counted = held.select("item_id", n.alias("claims"), F.when(n > 0, F.size(F.filter("held", lambda x: ~x)).cast("long")).alias("unsupported"), F.when((n > 0) & (F.col("missing") != ""), F.col("missing")).alias("missing"))
    rate = 1 - F.col("unsupported") / F.col("claims")
    status = F.when(F.col("claims").isNull(), "unparseable").when(F.col("unsupported") == 0, "pass").otherwise("fail")
    return counted.select("item_id", "claims", "unsupported", F.round(rate, 6).alias("rate"), status.alias("status"), F.round(F.when(F.col("unsupported") == 0, rate).otherwise(1 - rate), 6).alias("confidence"), "missing")


def claim_findings(parsed: DataFrame, least: float = 0.95) -> DataFrame:
    """(item_id, status, score): the threshold decides here, so it can be moved without asking again."""
    return parsed.select("item_id", F.when(F.col("rate").isNull(), "unscored").when(F.col("rate") >= least, "pass").otherwise("fail").alias("status"), F.col("rate").alias("score"))


def grounding_findings(parsed: DataFrame) -> DataFrame:
    """(item_id, status, score, instead) of parsed verdicts: the judge's word stands; without one the value is unscored."""
    decided = F.col("status").isin("pass", "fail")
    return parsed.select("item_id", F.when(decided, F.col("status")).otherwise("unscored").alias("status"), F.when(decided, F.col("confidence")).alias("score"), "instead")


def claim_flags(parsed: DataFrame, least: float = 0.95) -> DataFrame:
    """(item_id, check, flagged): unsupported claims, and what a judge says was left out."""
    scored = parsed.filter("rate IS NOT NULL")
    return scored.select("item_id", F.lit("claims_supported").alias("check"), (F.col("rate") < least).alias("flagged")).union(scored.select("item_id", F.lit("claims_missing"), F.col("missing").isNotNull()))


def defect_agreement(ratings: DataFrame, flags: DataFrame) -> DataFrame:
    """(defect, check, compared, agreed, tool_only, human_only, agreement, leaning) of ratings (item_id, label) and flags
    (item_id, check, flagged): only items that a human rated count.
    """
    boxes = ratings.sparkSession.createDataFrame(list(DEFECTS.items()), "defect string, check string")
    human = ratings.groupBy("item_id").agg(F.collect_set("label").alias("ticked"))
    both = flags.join(F.broadcast(boxes), "check").join(human, "item_id").withColumn("ticked", F.array_contains("ticked", F.col("defect")))  # four boxes
    g = both.groupBy("defect", "check").agg(
        F.count("*").alias("compared"), F.count_if(F.col("flagged") == F.col("ticked")).alias("agreed"), F.count_if(F.col("flagged") & ~F.col("ticked")).alias("tool_only"), F.count_if(~F.col("flagged") & F.col("ticked")).alias("human_only")
    )
    leaning = F.when(F.col("tool_only") > F.col("human_only"), "over-flags").when(F.col("tool_only") < F.col("human_only"), "under-flags")
    return g.select("*", F.round(F.col("agreed") / F.col("compared"), 6).alias("agreement"), leaning.alias("leaning"))


def panel(verdicts: DataFrame, items: DataFrame, n: int = 300) -> DataFrame:
    """The verdicts that a panel's figures are made of: on the sampled items, of judges whose health is no stop."""
    alive = screen(verdicts).filter("flag <> 'stop'").select("judge")
    return verdicts.join(small_side(alive), "judge", "left_semi").join(small_side(sample_items(items, n)), "item_id", "left_semi")


def calibrated_risk(verdicts: DataFrame, curves: DataFrame) -> DataFrame:
    """(item_id, score): the largest risk after each judge's curve (judge, a, b); judges without one give none."""
    fitted = verdicts.join(small_side(curves.filter("a IS NOT NULL").select("judge", "a", "b")), "judge")
    right = 1 / (1 + F.exp(F.col("a") * F.col("confidence") + F.col("b")))
    return fitted.groupBy("item_id").agg(F.round(F.max(identity_risk(F.col("status"), right)), 6).alias("score"))


def compare_strategies(strategies: Mapping[str, DataFrame], target: DataFrame, budgets: tuple[float, ...] = BUDGETS) -> DataFrame:
    """(strategy, budget, k, recall, precision): every strategy (item_id, score) on one target (item_id, error)."""
    out = None
    for name, scores in strategies.items():
        part = recall_at_budget(target.join(scores, "item_id", "left").select("item_id", "score", "error"), budgets).withColumn("strategy", F.lit(name))
        out = part if out is None else out.union(part)
    return out.select("strategy", "budget", "k", "recall", "precision")


def metric_deltas(before: DataFrame, after: DataFrame, labels: DataFrame, taxonomy: DataFrame) -> DataFrame:
    """One row: accuracy, majority and macro_f1 of the later answers less those of the earlier."""
    names = ("accuracy", "majority", "macro_f1")
    a, b = (accuracy(buckets(o.select("item_id", "value"), labels, taxonomy)).select(*(F.col(c).alias(f"{p}_{c}") for c in names)) for p, o in (("a", before), ("b", after)))
    return a.crossJoin(b).select(*(F.round(F.col(f"b_{c}") - F.col(f"a_{c}"), 6).alias(c) for c in names))  # one row by one


def reads_as_broken(stability: DataFrame, temperature: float = 0.0, least: float = 0.99) -> DataFrame:
    """stability with broken and where to look: at temperature 0 the serving, else the decision itself."""
    return stability.select("stability", F.coalesce(F.col("stability") < least, F.lit(False)).alias("broken"), F.lit("serving" if temperature == 0 else "decision").alias("suspect"))


def tree(taxonomy: DataFrame) -> DataFrame:
    """(path, depth, siblings, children) of every label."""
    kids = taxonomy.filter("parent IS NOT NULL").groupBy(F.col("parent").alias("path")).agg(F.count("*").alias("children"))
    peers = taxonomy.groupBy(F.coalesce("parent", F.lit("")).alias("above")).agg((F.count("*") - 1).alias("siblings"))
    held = taxonomy.select("path", F.coalesce("parent", F.lit("")).alias("above")).join(small_side(peers), "above").join(small_side(kids), "path", "left")
    return held.select("path", F.size(F.split("path", "\\.")).cast("long").alias("depth"), "siblings", F.coalesce("children", F.lit(0)).cast("long").alias("children"))


def _interval(draws: DataFrame) -> list[Column]:
    return [F.count("*").alias("resamples"), F.percentile("value", 0.025).alias("low"), F.percentile("value", 0.975).alias("high")]


def bootstrap_ci(values: DataFrame, statistic: Callable[[np.ndarray, np.ndarray], float | None], resamples: int = 1000, seed: int = 7, most: int = MOST_PROFILES) -> DataFrame:
    """One row (resamples, low, high): a statistic of (values, weights) over resamples of whole items of values (item_id, value).

    An item comes with all of its values or not at all. The mean is a sum over tasks, for any number of items. Another
    statistic needs all values at once: items with equal ones are one profile, drawn by a multinomial, and more than `most`
    profiles raise. A draw whose statistic is None is left out.
    """
    if statistic is weighted_mean:
        draws = mean_draws(values, resamples, seed)
        return draws.agg(*_interval(draws))
    profiles = values.groupBy("item_id").agg(F.sort_array(F.collect_list("value")).alias("v")).filter("size(v) > 0").groupBy("v").agg(F.count("*").alias("n"))
    rows = profiles.limit(most + 1).collect()
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct items: round their values first")
    rows = sorted(rows, key=lambda r: list(r.v))
    sizes, n = np.array([len(r.v) for r in rows], int), np.array([r.n for r in rows], int)
    flat = np.array([x for r in rows for x in r.v], float)

    def draw(batches):
        for pdf in batches:
            out = []
            for i in pdf.id if len(n) else ():
                w = np.random.default_rng((seed, int(i))).multinomial(n.sum(), n / n.sum())
                out.append(statistic(flat, np.repeat(w, sizes)))
            yield pd.DataFrame({"value": pd.Series(out, dtype=float)})

    draws = values.sparkSession.range(resamples).mapInPandas(draw, "value double").filter("value IS NOT NULL AND NOT isnan(value)")
    return draws.agg(*_interval(draws))


def weighted_mean(values: np.ndarray, weights: np.ndarray) -> float | None:
    return float((values * weights).sum() / weights.sum()) if weights.sum() else None


def recall_interval(scored: DataFrame, budget: float = 0.1, resamples: int = 1000, seed: int = 7, least: int = 200, most: int = MOST_PROFILES) -> DataFrame:
    """One row (n, resamples, low, high) of the recall at a budget, over resamples of items (item_id, score, error), however
    many; under `least` items no interval. Rows without an item_id are counted, and more than `most` distinct scores raise.
    """
    if "item_id" in scored.columns:
        total = scored.filter("score IS NOT NULL").count()
        draws = recall_draws(scored if total >= least else scored.limit(0), budget, resamples, seed)
        return draws.agg(*_interval(draws)).select(F.lit(total).cast("long").alias("n"), "resamples", "low", "high")
    counts = scored.filter("score IS NOT NULL").groupBy("score").agg(F.count("*").alias("n"), F.count_if("error").alias("pos"))
    rows = counts.limit(most + 1).toPandas().sort_values("score", ascending=False)
    if len(rows) > most:
        raise ValueError(f"more than {most} distinct scores: round them first")
    pos, neg = rows.pos.to_numpy(), (rows.n - rows.pos).to_numpy()
    total = int(rows.n.sum())

    def draw(batches):
        for pdf in batches:
            out = []
            for i in pdf.id if total >= least else ():
                x = np.random.default_rng((seed, int(i))).multinomial(total, np.concatenate((pos, neg)) / total)
                p, n = x[: len(pos)], x[: len(pos)] + x[len(pos) :]
                before = np.cumsum(n) - n
                k = min(max(1, round(budget * total)), total)
                share = np.clip(k - before, 0, n) / np.maximum(n, 1)
                out.append(float((p * share).sum() / p.sum()) if p.sum() else None)
            yield pd.DataFrame({"value": pd.Series(out, dtype=float)})

    draws = scored.sparkSession.range(resamples).mapInPandas(draw, "value double").filter("value IS NOT NULL AND NOT isnan(value)")
    return draws.agg(*_interval(draws)).select(F.lit(total).cast("long").alias("n"), "resamples", "low", "high")


def cross_fitted(rows: DataFrame, folds: int = 5, least: int = 100) -> DataFrame:
    """(judge, n, ece, brier, brier_base_rate) of rows (item_id, judge, confidence, right): each fold is scored by a curve
    that was fitted on the others. Folds go by a hash of the item; only counts of each confidence reach the fit.
    """
    counts = rows.filter("confidence IS NOT NULL").groupBy("judge", F.pmod(F.conv(F.substring(F.sha2("item_id", 256), 1, 8), 16, 10).cast("long"), F.lit(folds)).alias("fold"), F.round("confidence", 4).alias("confidence"), "right").agg(F.count("*").alias("n"))

    def fit(pdf: pd.DataFrame) -> pd.DataFrame:
        s, y, n, fold = pdf.confidence.to_numpy(), pdf.right.to_numpy(bool), pdf.n.to_numpy(), pdf.fold.to_numpy()
        total, good = n.sum(), n[y].sum()
        blank = {"judge": [pdf.judge.iloc[0]], "n": [int(total)], "ece": [None], "brier": [None], "brier_base_rate": [None]}
        if total < least or good in (0, total):
            return pd.DataFrame(blank)
        p = np.zeros(len(s))
        for k in range(folds):
            kept = fold != k
            g = n[kept & y].sum()
            if g in (0, n[kept].sum()):
                p[~kept] = g / max(n[kept].sum(), 1)
                continue
            a, b = fit_sigmoid(np.repeat(s[kept], n[kept]), np.repeat(y[kept], n[kept]))
            p[~kept] = 1 / (1 + np.exp(np.clip(a * s[~kept] + b, -500, 500)))
        bins = np.minimum((p * 10).astype(int), 9)
        mass = np.bincount(bins, n, 10)
        gap = np.abs(np.bincount(bins, n * p, 10) - np.bincount(bins, n * y, 10)).sum() / mass.sum()
        base = good / total
        return pd.DataFrame(blank | {"ece": [gap], "brier": [(n * (p - y) ** 2).sum() / total], "brier_base_rate": [base * (1 - base)]})

    return counts.groupBy("judge").applyInPandas(fit, "judge string, n long, ece double, brier double, brier_base_rate double")
