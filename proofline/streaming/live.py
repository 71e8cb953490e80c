"""The audit's counts over a stream: label shares by window, and verdict health as replies come in."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def windowed_shares(outputs: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """(start, label, n) of a stream (ts, label): counts that close once rows can be no later than `late`."""
    return outputs.withWatermark("ts", late).groupBy(F.window("ts", window), "label").agg(F.count("*").alias("n")).select(F.col("window.start").alias("start"), "label", "n")


def live_health(verdicts: DataFrame, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    g = verdicts.withWatermark("ts", late).groupBy(F.window("ts", window), "judge").agg(F.count("*").alias("calls"), F.count_if(F.col("status") == "pass").alias("approvals"), F.count_if(F.col("status") == "unparseable").alias("unparseable"))
    return g.select(F.col("window.start").alias("start"), "judge", "calls", "approvals", "unparseable")
