"""Checks of values copied from a source: numbers and dates, their shape, and whether the source holds them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

ISO = r"\b([0-9]{4})-([0-9]{2})-([0-9]{2})\b"
NAMED = r"\b([A-Z][a-z]+)\.? ([0-9]{1,2}),? ([0-9]{4})\b"
DAY_FIRST = r"\b([0-9]{1,2})(?:st|nd|rd|th)? ([A-Z][a-z]+)\.? ([0-9]{4})\b"
NUMBER = r"[0-9][0-9,. ]*"
MONTHS = ("january", "february", "march", "april", "may", "june", "july", "august", "september", "october", "november", "december")


def normalise(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def parse_number(text: Column) -> Column:
    """Commas go, then all but digits, points and signs; null if that is no number."""
    bare = F.regexp_replace(F.replace(text, F.lit(","), F.lit("")), "[^0-9.+-]", "")
    bare = F.regexp_replace(bare, r"\.$", "")
    return F.when(F.rlike(bare, F.lit(r"^[+-]?([0-9]+(\.[0-9]*)?|\.[0-9]+)$")), bare.try_cast("double"))


def _month(name: Column) -> Column:
    low = F.substring(F.lower(name), 1, 3)
    return F.coalesce(*(F.when(low == m[:3], F.lit(f"{k:02d}")) for k, m in enumerate(MONTHS, 1)))


def parse_date(text: Column) -> Column:
    """The first of three shapes that matches decides; an impossible date is null and no later shape is tried."""
    part = lambda p, k: F.regexp_extract(text, p, k)
    stamp = lambda y, m, d: F.try_to_timestamp(F.concat_ws("-", y, m, F.lpad(d, 2, "0")), F.lit("yyyy-MM-dd")).cast("date")
    named = F.when(_month(part(NAMED, 1)).isNotNull(), stamp(part(NAMED, 3), _month(part(NAMED, 1)), part(NAMED, 2)))
    first = F.when(_month(part(DAY_FIRST, 2)).isNotNull(), stamp(part(DAY_FIRST, 3), _month(part(DAY_FIRST, 2)), part(DAY_FIRST, 1)))
    return F.when(F.rlike(text, F.lit(ISO)), stamp(part(ISO, 1), part(ISO, 2), part(ISO, 3))).when(F.rlike(text, F.lit(NAMED)), named).when(F.rlike(text, F.lit(DAY_FIRST)), first)


def candidates(source: Column, kind: str) -> Column:
    """Spans of the source that may hold a value of the kind."""
    if kind == "text":
        return F.array().cast("array<string>")
    if kind == "date":
        return F.concat(*(F.regexp_extract_all(source, F.lit(p), F.lit(0)) for p in (ISO, NAMED, DAY_FIRST)))
    masked = source
    for p in (ISO, NAMED, DAY_FIRST):
        masked = F.regexp_replace(masked, p, " # ")
    return F.regexp_extract_all(masked, F.lit(NUMBER), F.lit(0))


def parsed(text: Column, kind: str) -> Column:
    return parse_number(text) if kind == "number" else parse_date(text) if kind == "date" else normalise(text)


def same_value(got: Column, wanted: Column, kind: str, verbatim: bool = False) -> Column:
    return F.trim(got) == F.trim(wanted) if verbatim else parsed(got, kind) == parsed(wanted, kind)


def found(value: Column, source: Column, kind: str, verbatim: bool = False) -> Column:
    """Whether the source holds the value; null where the value cannot be read."""
    if verbatim:
        return F.contains(source, F.trim(value))
    if kind == "text":
        return F.contains(normalise(source), normalise(value))
    v = parsed(value, kind)
    return F.when(v.isNotNull(), F.exists(candidates(source, kind), lambda c: F.coalesce(parsed(c, kind) == v, F.lit(False))))


def value_shape(values: DataFrame, column: str, kind: str) -> DataFrame:
    v = F.col(column)
    return values.filter(v.isNotNull() & (F.trim(v) != "")).select("item_id", F.when(parsed(v, kind).isNotNull(), "pass").otherwise("fail").alias("status"))


def value_in_source(values: DataFrame, column: str, kind: str, verbatim: bool = False) -> DataFrame:
    """(item_id, status, candidates) of values (item_id, source, <column>)."""
    v = F.col(column)
    # Columns of their own, so that a source is searched once and the value is not read anew for every candidate.
    read = values.filter(v.isNotNull() & (F.trim(v) != "")).select("item_id", "source", v.alias("value"), parsed(v, kind).alias("read"), candidates(F.col("source"), kind).alias("held"))
    hit = found(F.col("value"), F.col("source"), kind, verbatim)
    if kind != "text" and not verbatim:
        hit = F.when(F.col("read").isNotNull(), F.exists("held", lambda c: F.coalesce(parsed(c, kind) == F.col("read"), F.lit(False))))
    status = F.when(hit.isNull(), "unscored").when(hit, "pass").otherwise("fail")
    return read.select("item_id", status.alias("status"), F.size("held").cast("long").alias("candidates"))


def ambiguous(values: DataFrame, kind: str, above: int = 1) -> DataFrame:
    n = F.size(candidates(F.col("source"), kind)).cast("long")
    return values.select("item_id", n.alias("candidates")).filter(F.col("candidates") > above)


def grounding_rate(values: DataFrame, column: str, kind: str, least: float = 0.95) -> DataFrame:
    s = value_in_source(values, column, kind).agg(F.count_if(F.col("status") == "pass").alias("grounded"), F.count_if(F.col("status") != "unscored").alias("checkable"))
    rate = F.try_divide("grounded", "checkable")
    return s.select("grounded", "checkable", F.round(rate, 6).alias("rate"), F.when(rate.isNull(), "unscored").when(rate >= least, "pass").otherwise("fail").alias("status"))


def value_matches_human(values: DataFrame, column: str, human: str, kind: str, verbatim: bool = False) -> DataFrame:
    ok = same_value(F.col(column), F.col(human), kind, verbatim)
    readable = F.lit(True) if verbatim else parsed(F.col(column), kind).isNotNull()
    return values.select("item_id", F.when(~readable, "unscored").when(F.coalesce(ok, F.lit(False)), "pass").otherwise("fail").alias("status"))
