"""What a run may say: health flags, estimates, the two gates, what is withheld, and the refusals that protect a comparison."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofline.operators.ranking import auc, degenerate_target

#: The figures that a finding of each gate withholds.
WITHHOLDS = {"scripted_judge": ("judge.approval_rate", "panel.agreement", "panel.effective_votes", "triage.validated", "gate2.auc"), "judge_health": ("panel.agreement", "panel.effective_votes"), "degenerate_target": ("gate2.auc", "triage.auc"), "no_ranker": ("gate2.auc",), "loses_to_baseline": ("triage.validated",)}
GATE = "id string, severity string, about string"


def health_flags(health: DataFrame) -> DataFrame:
    """(judge, severity, reason): a row for each thing that is wrong with a judge of screen(). Approval and readability are
    judged apart, so a judge can have both.
    """
    a, u = F.col("approval"), F.col("unreadable")
    say = lambda severity, reason: F.struct(F.lit(severity).alias("severity"), F.lit(reason).alias("reason"))
    approval = F.when(a.isNull(), say("stop", "scored nothing")).when(~a.between(0.02, 0.98), say("stop", "one-sided")).when(~a.between(0.15, 0.85), say("warn", "leaning"))
    reading = F.when(u > 0.05, say("stop", "unreadable")).when(u > 0.02, say("warn", "unreadable"))
    return health.select("judge", F.explode(F.array_compact(F.array(approval, reading))).alias("f")).select("judge", "f.severity", "f.reason")


def estimates(points: DataFrame, floor: int = 30) -> DataFrame:
    """points (name, value, low, high, n) with width, under_floor, and beats: whether the interval is above every other value."""
    top = points.agg(F.max(F.struct("value", "name")).alias("one"))
    second = points.join(F.broadcast(top), F.col("name") != F.col("one.name"), "left_semi").agg(F.max("value").alias("next"))  # one row
    joined = points.crossJoin(F.broadcast(top)).crossJoin(F.broadcast(second))  # by one row each
    rival = F.when(F.col("name") == F.col("one.name"), F.col("next")).otherwise(F.col("one.value"))
    return joined.select("name", "value", (F.col("high") - F.col("low")).alias("width"), (F.col("n") < floor).alias("under_floor"), F.coalesce(F.col("low") > rival, F.lit(False)).alias("beats"))


def gate_one_rows(health: DataFrame, votes: DataFrame, items: DataFrame, scripted: DataFrame, least: int = 200, share: float = 0.5) -> DataFrame:
    """(id, severity, about): scripted judges (judge), sick judges, too few items, a panel that votes alike, and the note that no
    ranker sees labels. Each part is a few rows.
    """
    row = lambda df, i, s, about: df.select(F.lit(i).alias("id"), F.lit(s).alias("severity"), about.cast("string").alias("about"))
    names = scripted.agg(F.array_join(F.sort_array(F.collect_set("judge")), ",").alias("about")).filter("about <> ''")
    flags = health_flags(health)
    few = items.agg(F.count("*").alias("n")).filter(F.col("n") < least)
    alike = votes.filter(F.col("votes") < share * F.col("judges"))
    note = scripted.sparkSession.range(1)
    return (
        row(names, "scripted_judge", "stop", F.col("about")).union(flags.select(F.lit("judge_health"), "severity", F.concat_ws(": ", "judge", "reason")))
        .union(row(few, "sample_size", "warn", F.col("n"))).union(row(alike, "effective_votes", "warn", F.round("votes", 1))).union(row(note, "no_label_leakage", "note", F.lit("ok")))
    )


def scored_strategies(strategies: dict[str, DataFrame], target: DataFrame) -> DataFrame:
    """(strategy, n, errors, auc, unranked, unranked_errors): each ranking (item_id, score) against one target (item_id, error)."""
    out = None
    for name, scores in strategies.items():
        joined = target.join(scores.select("item_id", "score"), "item_id", "left")
        missing = joined.filter("score IS NULL").agg(F.count("*").alias("unranked"), F.count_if("error").alias("unranked_errors"))
        part = auc(joined.select("score", "error")).crossJoin(missing).select(F.lit(name).alias("strategy"), "n", "errors", "auc", "unranked", "unranked_errors")  # one row by one
        out = part if out is None else out.union(part)
    return out


def gate_two_rows(scored: DataFrame, ranker: str, low: DataFrame, target: DataFrame) -> DataFrame:
    """(id, severity, about) of scored_strategies() on target (item_id, error): low (low) is the lower end of the ranker's
    interval, which has to clear the best other area. A target with too few of either kind says nothing else. Nothing said
    means that the ranker is better; no target at all gives no row either, as there was nothing to measure.
    """
    mine = scored.filter(F.col("strategy") == ranker).select("auc", "unranked", "unranked_errors")
    best = scored.filter((F.col("strategy") != ranker) & F.col("auc").isNotNull()).agg(F.max(F.struct("auc", "strategy")).alias("best"))
    kinds = degenerate_target(target).filter("n > 0").select("minority", "degenerate")
    all_ = mine.crossJoin(best).crossJoin(low.select("low")).crossJoin(kinds)  # one row by one by one by one
    s = lambda i, severity, about: F.struct(F.lit(i).alias("id"), F.lit(severity).alias("severity"), about.cast("string").alias("about"))
    few = F.col("degenerate")
    first = F.when(few, s("degenerate_target", "stop", F.col("minority"))).when(F.col("auc").isNull(), s("no_ranker", "stop", F.lit(ranker))).when(F.col("best").isNull(), s("no_baseline", "warn", F.lit(ranker))).when(F.coalesce(F.col("low") <= F.col("best.auc"), F.lit(True)), s("loses_to_baseline", "stop", F.col("best.strategy")))
    second = F.when(~few & (F.col("unranked_errors") > 0), s("unranked_errors", "warn", F.col("unranked_errors")))
    return all_.select(F.explode(F.array_compact(F.array(first, second))).alias("g")).select("g.*")


def normal_low(scored: DataFrame, ranker: str, z: float = 1.96) -> DataFrame:
    """(low): the lower end of the ranker's area by its standard error under no tie structure, from areas and counts alone."""
    a, p = F.col("auc"), F.col("errors").cast("double")
    n = F.col("n") - p
    q1, q2 = a / (2 - a), 2 * a * a / (1 + a)
    se = F.sqrt((a * (1 - a) + (p - 1) * (q1 - a * a) + (n - 1) * (q2 - a * a)) / (p * n))
    return scored.filter(F.col("strategy") == ranker).select((a - z * se).alias("low"))


def suppressions(gate: DataFrame) -> DataFrame:
    """(metric, reason) of gate rows (id, severity, about): what each stop withholds."""
    pairs = [(i, m) for i, ms in WITHHOLDS.items() for m in ms]
    table = gate.sparkSession.createDataFrame(pairs, "id string, metric string")  # a dozen rows
    return gate.filter("severity = 'stop'").join(F.broadcast(table), "id").select("metric", F.concat_ws(" ", "id", "about").alias("reason"))


def queue_verdicts(verdicts: DataFrame, ranker: str) -> DataFrame:
    """Verdicts that the review queue may see: the ranking judge's alone, so a panel never steers what is reviewed."""
    return verdicts.filter(F.col("judge") == ranker)


def cannot_tell(modes: DataFrame, fields: DataFrame, withheld: DataFrame, judges: DataFrame) -> DataFrame:
    """(what, why) that a run leaves open, of modes (field, mode), fields (field, kind), withheld (metric) and judges (judge)."""
    line = lambda df, what, why: df.select(F.lit(what).alias("what"), why.alias("why"))
    names = lambda df, c: df.agg(F.array_join(F.sort_array(F.collect_set(c)), ",").alias("why")).filter("why <> ''")
    one = judges.agg(F.countDistinct("judge").alias("n")).filter("n < 2")
    return (
        line(names(withheld, "metric"), "withheld figures", F.col("why")).union(line(names(fields.filter("kind = 'free_text'"), "field"), "whether a text invents", F.col("why")))
        .union(line(names(modes.filter("mode = 0"), "field"), "accuracy", F.col("why"))).union(line(names(modes.filter("mode = 1"), "field"), "whether labels can be told apart", F.col("why"))).union(line(one, "which labels are confused", F.lit("no panel")))
    )


def fingerprint(judge: Column, model: Column, prompt: Column, check: Column, taxonomy: Column) -> Column:
    """What a calibration is valid for: 16 hex digits of a digest of judge, model, prompt, check and tree, a null tree as none."""
    z = F.lit("\0")
    return F.substring(F.sha2(F.concat(judge, z, model, z, prompt, z, check, z, F.coalesce(taxonomy, F.lit(""))), 256), 1, 16)


def stale(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(judge, stale): whether a stored calibration (judge, fingerprint) was fitted for something else than the current one."""
    return stored.select("judge", F.col("fingerprint").alias("was")).join(current, "judge").select("judge", (F.col("was").isNotNull() & (F.col("was") != F.col("fingerprint"))).alias("stale"))


def version_check(a: DataFrame, b: DataFrame, moves: DataFrame) -> DataFrame:
    """(id, verdict) of the trees (id, version, digest) of two runs and known migrations (id, source, target).

    not used: the later run has no such tree. same: one version, one content. edited: one version, two contents; refused.
    unmapped: two versions and no migration; refused. wrong mapping: one between other versions; refused. mapped: allowed.
    """
    x, y = a.select("id", F.col("version").alias("va"), F.col("digest").alias("da")), b.select("id", F.col("version").alias("vb"), F.col("digest").alias("db"))
    j = x.join(y, "id", "left").join(moves, "id", "left")
    verdict = F.when(F.col("vb").isNull(), "not used").when((F.col("va") == F.col("vb")) & (F.col("da") == F.col("db")), "same").when(F.col("va") == F.col("vb"), "edited").when(F.col("source").isNull(), "unmapped").when((F.col("source") != F.col("va")) | (F.col("target") != F.col("vb")), "wrong mapping").otherwise("mapped")
    return j.select("id", verdict.alias("verdict"))


def withheld_verdict(changes: DataFrame) -> DataFrame:
    """One line from changes (change, n): what a comparison counts, and that it draws no winner from it."""
    n = lambda c: F.coalesce(F.sum(F.when(F.col("change") == c, F.col("n"))), F.lit(0)).cast("long")
    g = changes.agg(n("improved").alias("up"), n("regressed").alias("down"), n("unchanged").alias("same"))
    text = F.format_string("%d improved and %d regressed of %d shared, net %d: no result without a test over the items that differ", F.col("up"), F.col("down"), F.col("up") + F.col("down") + F.col("same"), F.col("up") - F.col("down"))
    return g.filter(F.col("up") + F.col("down") + F.col("same") > 0).select(text.alias("line"))
