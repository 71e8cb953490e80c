"""What a run may claim: judges' health, the ranker against baselines, and what is withheld; the report's words."""

from __future__ import annotations

from collections.abc import Iterable, Mapping

from pyspark.sql import DataFrame, functions as F

FORBIDDEN = {"label", "annotator", "truth", "error"}


class LabelLeak(ValueError):
    """A ranker was given human answers."""


def assert_no_labels(*frames: DataFrame) -> None:
    """No ranker sees a column that holds a human answer."""
    for df in frames:
        if found := FORBIDDEN & set(df.columns):
            raise LabelLeak(f"columns {sorted(found)} must not reach a ranker")


def resolve_strategy(wanted: str, fitted: bool) -> str:
    if wanted == "auto":
        return "calibrated_risk" if fitted else "raw_confidence"
    if wanted == "calibrated_risk" and not fitted:
        raise ValueError("calibrated_risk needs a fitted calibration")
    return wanted


def gate_one(health: DataFrame, votes: DataFrame, sampled: int, least: int = 300) -> list[tuple[str, str]]:
    """(severity, reason) of the judges' health (one row for each judge) and the panel's size."""
    out = [("stop" if r.flag == "stop" else "warn", f"{r.judge}: {r.flag}") for r in health.filter("flag <> 'ok'").orderBy("judge").collect()]
    v = votes.first()
    out += [("warn", "judges vote alike")] if v and v.warn else []
    return out + ([("warn", f"only {sampled} items sampled")] if sampled < least else [])


def gate_two(ranker: Mapping[str, float], baselines: Mapping[str, float | None]) -> tuple[str, str]:
    """ranker: low and high of its interval. It must beat every baseline's point."""
    known = {k: v for k, v in baselines.items() if v is not None}
    if not known:
        return "unscored", "no baseline could be measured"
    name, best = max(known.items(), key=lambda x: (x[1], x[0]))
    if ranker["low"] is None or ranker["low"] <= best:
        return "stop", f"not better than {name} ({best:.2f})"
    return "pass", f"better than {name} ({best:.2f})"


def withheld(pairs: DataFrame) -> DataFrame:
    """(metric, reasons) of (metric, reason): one row for each metric that is not shown."""
    return pairs.groupBy("metric").agg(F.concat_ws("; ", F.sort_array(F.collect_set("reason"))).alias("reasons"))


def render(title: str, rows: Iterable[tuple[str, object]], width: int = 80) -> str:
    """A plain report: names on the left, values on the right, missing ones said to be so."""
    lines = [title, "=" * min(len(title), width)]
    for name, value in rows:
        shown = "not measured" if value is None else f"{value:.3f}" if isinstance(value, float) else str(value)
        lines.append(f"{name[: width - len(shown) - 2]:<{width - len(shown) - 1}} {shown}")
    return "\n".join(lines)
