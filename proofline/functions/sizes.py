"""Sides of a join that are small by nature, and what happens where one is not."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

SMALL_ROWS = 100_000  # of a tree, a mapping or a table of judges; more are joined by a shuffle


def small_side(df: DataFrame, most: int = SMALL_ROWS) -> DataFrame:
    """df, marked for broadcast if a count finds at most `most` rows in it."""
    return F.broadcast(df) if df.limit(most + 1).count() <= most else df
