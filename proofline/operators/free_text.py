"""Checks of free text: length, specificity, copying, boilerplate."""

from __future__ import annotations

from bisect import bisect_right
from itertools import accumulate

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from proofline.functions.sizes import small_side
from proofline.operators.shingles import SLICE, TOKEN as BYTES, digests, keyed, sets, shared
from proofline.sources.scratch import stored

TOKEN = r"[a-z0-9][a-z0-9'’\-]*"
POSTINGS = 200


def words(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(text), F.lit(TOKEN), F.lit(0))


def length_in_bounds(texts: DataFrame, low: int | None, high: int | None) -> DataFrame:
    """(item_id, n_words, status) of texts (item_id, text); blank texts fail."""
    n = F.size(words(F.coalesce("text", F.lit(""))))
    ok = (F.trim(F.coalesce("text", F.lit(""))) != "") & (n >= (low or 0)) & (n <= (high if high is not None else 1 << 30))
    return texts.select("item_id", n.cast("long").alias("n_words"), F.when(ok, "pass").otherwise("fail").alias("status"))


def rare_tokens(items: DataFrame, share: float = 0.05) -> DataFrame:
    """(token, n): tokens in at most max(1, int(share * items)) of items (item_id, text)."""
    most = items.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("most"))
    counts = items.select(F.explode(F.array_distinct(words(F.col("text")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    return counts.crossJoin(F.broadcast(most)).filter("n <= most").select("token", "n")  # by one row


def specificity(pairs: DataFrame, share: float = 0.05) -> DataFrame:
    """(item_id, available, used, status): rare words of the source that the written text takes up; unscored where the source has none.

    A token that is not rare stands in over `share` of the sources, so there are at most 1 / share times as many of them as
    an average source has tokens. They go to every task, and each row is decided where it is.
    """
    common = pairs.select(F.explode(F.array_distinct(words(F.col("source")))).alias("token")).groupBy("token").agg(F.count("*").alias("n"))
    most = pairs.agg(F.greatest(F.lit(1), F.floor(F.count("*") * share)).alias("most"))
    common = common.crossJoin(F.broadcast(most)).filter("n > most").agg(F.collect_list("token").alias("common"))  # by one row
    rows = pairs.select("item_id", F.coalesce(F.array_distinct(words(F.col("source"))), F.array().cast("array<string>")).alias("has"), F.coalesce(words(F.col("written")), F.array().cast("array<string>")).alias("says"))
    rare = rows.crossJoin(F.broadcast(common)).select("item_id", F.when(F.col("item_id").isNotNull(), F.array_except("has", "common")).otherwise(F.array().cast("array<string>")).alias("rare"), "says")  # by one row
    full = rare.select("item_id", F.size("rare").cast("long").alias("available"), F.size(F.array_intersect("rare", "says")).cast("long").alias("used"))
    return full.withColumn("status", F.when(F.col("available") == 0, "unscored").when(F.col("used") > 0, "pass").otherwise("fail"))


def _run(source: bytes, said: list[bytes]) -> int:
    """The longest run of the tokens said that stands in the source: a longer one is sought from every token on, and one that
    is found is read on to its end.
    """
    if not said:
        return 0
    s, w = b" ".join([b"", *BYTES.findall(source), b""]), b" ".join([b"", *said, b""])
    starts = [0, *accumulate(len(t) + 1 for t in said)]
    best = at = 0
    while at + best < len(said):
        found = s.find(w[starts[at] : starts[at + best + 1] + 1])
        if found < 0:
            at += 1
            continue
        low, high = starts[at + best + 1] + 1 - starts[at], min(len(w) - starts[at], len(s) - found)
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if s[found : found + mid] == w[starts[at] : starts[at] + mid] else (low, mid - 1)
        best = bisect_right(starts, starts[at] + low - 1) - 1 - at
    return best


def _runs(pairs: DataFrame) -> DataFrame:
    """(item_id, run, n): the longest run of tokens that source and written share, and the tokens written; a row is read where it is."""

    def run(batches):
        for batch in batches:
            for at in range(0, batch.num_rows, SLICE):
                part = batch.slice(at, SLICE)
                said = [BYTES.findall(t or b"") for t in part.column(2).to_pylist()]
                got = [_run(t or b"", w) for t, w in zip(part.column(1).to_pylist(), said)]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(got, pa.int64()), pa.array(map(len, said), pa.int64())], ["item_id", "run", "n"])

    low = lambda c: F.lower(c).cast("binary")
    return pairs.select("item_id", low("source"), low("written")).mapInArrow(run, f"item_id {pairs.schema['item_id'].dataType.simpleString()}, run long, n long")


def longest_shared_run(pairs: DataFrame) -> DataFrame:
    """(item_id, run): the longest run of tokens that source and written share."""
    return _runs(pairs).select("item_id", F.when(F.col("item_id").isNotNull(), F.col("run")).otherwise(0).alias("run"))


def copy_ratio(pairs: DataFrame, most: float = 0.5) -> DataFrame:
    """(item_id, ratio, status): the longest shared run by the written tokens; texts without tokens give no row."""
    out = _runs(pairs).filter("item_id IS NOT NULL AND n > 0").withColumn("ratio", F.col("run") / F.col("n"))
    return out.select("item_id", F.round("ratio", 6).alias("ratio"), F.when(F.col("ratio") > most, "fail").otherwise("pass").alias("status"))


def shingle_sets(texts: DataFrame, size: int = 5) -> DataFrame:
    """(item_id, shingles): the distinct runs of five tokens, hashed; a shorter text is one, one without tokens is left out."""
    runs = lambda w: F.transform(F.sequence(F.lit(0), F.greatest(F.lit(0), F.size(w) - size)), lambda i: F.xxhash64(*(F.get(w, i + k) for k in range(size))))
    # Words are bound by a lambda of their own: named in an inner one, they would be split anew for every run.
    bound = F.element_at(F.transform(F.array(words(F.col("text"))), lambda w: F.when(F.size(w) > 0, F.array_distinct(runs(w)))), 1)
    return texts.select("item_id", bound.alias("shingles")).filter("shingles IS NOT NULL")


def shingles(texts: DataFrame, size: int = 5) -> DataFrame:
    """(item_id, shingle), a row for each."""
    return shingle_sets(texts, size).select("item_id", F.explode("shingles").alias("shingle"))


def boilerplate(texts: DataFrame, similarity: float = 0.8, postings: int | None = POSTINGS) -> DataFrame:
    """(left, right, similarity): pairs of texts whose five-word shingles have that Jaccard similarity.

    Candidates share a shingle that 2 to `postings` texts have, or any number of texts if that is None; the similarity is
    that of the full sets. Each text is looked up by its rarest shingles alone: of sets so alike, the rarest shared shingle
    is among the first (1 - similarity) * size + 1 of both, in the order of how many texts have them. Shingles of one text
    count for that order and are never joined. Equal sets are compared once, and sets are read only where a pair needs them.
    """
    texts = texts.select("item_id", "text")
    return _pairs(texts, stored(digests(texts), "digests"), similarity, postings)


def _pairs(texts: DataFrame, keys: DataFrame, similarity: float, postings: int | None) -> DataFrame:
    """`boilerplate` of texts (item_id, text) with their `digests`; a column `copies` says how many texts one stands for."""
    of = Window.partitionBy("item_id")
    held = F.count("shingle").over(of) + F.coalesce(F.sum(F.when(F.col("shingle").isNull(), F.col("n"))).over(of), F.lit(0))
    common = shared(texts, postings).withColumn("held", held).filter(F.col("held") >= similarity * F.col("size") - 1e-9).filter("shingle IS NOT NULL")
    first = F.col("held") - F.ceil(similarity * F.col("size") - 1e-9) + 1
    usable = common.withColumn("place", F.row_number().over(of.orderBy("n", "shingle"))).filter(F.col("place") <= first).select("shingle", "item_id", "size")
    met = usable.alias("a").join(usable.alias("b"), "shingle").filter("a.item_id < b.item_id")
    met = met.filter(F.least("a.size", "b.size") >= similarity * F.greatest("a.size", "b.size"))  # no pair of less alike sizes can reach it
    near = met.select(F.col("a.item_id").alias("left"), F.col("b.item_id").alias("right")).distinct()
    key = lambda side: keys.select(F.col("item_id").alias(side), F.col("key").alias(f"{side}_key"))
    near = stored(near.join(key("left"), "left").join(key("right"), "right"), "near")
    a, b = F.col("left_key"), F.col("right_key")
    unlike = near.filter(a != b).select(F.least(a, b).alias("a"), F.greatest(a, b).alias("b")).distinct()
    one = keys.join(unlike.select(F.explode(F.array("a", "b")).alias("key")).distinct(), "key", "left_semi").groupBy("key").agg(F.min("item_id").alias("item_id"))
    read = sets(texts.join(small_side(one), "item_id", "left_semi")).join(one, "item_id")
    both = unlike.join(read.select(F.col("key").alias("a"), F.col("shingles").alias("x")), "a").join(read.select(F.col("key").alias("b"), F.col("shingles").alias("y")), "b")
    both_have = F.size(F.array_intersect("x", "y"))
    scored = both.select("a", "b", (both_have / (F.size("x") + F.size("y") - both_have)).alias("j")).filter(F.col("j") >= similarity)
    met = near.join(scored, (F.least(a, b) == F.col("a")) & (F.greatest(a, b) == F.col("b"))).select("left", "right", F.round("j", 6).alias("similarity"))
    return near.filter(a == b).select("left", "right", F.lit(1.0).alias("similarity")).union(met)


def alike(texts: DataFrame, similarity: float = 0.8, postings: int | None = None) -> DataFrame:
    """(item_id, score): texts that another one is so similar to, and the highest similarity. Candidates are those of
    `boilerplate`, but of texts with the same shingles two stand for all, so the pairs don't grow with the square of the copies.
    """
    texts = stored(keyed(texts), "keyed")
    many = texts.groupBy("key").agg(F.min("item_id").alias("low"), F.max("item_id").alias("high"), F.count("*").alias("n")).filter("n > 2")
    two = texts.join(small_side(many), "key", "left").filter("n IS NULL OR item_id = low OR item_id = high")
    two = two.select("item_id", "text", "key", F.when(F.col("item_id") == F.col("low"), F.col("n") - 1).otherwise(1).cast("int").alias("copies"))
    pairs = _pairs(two.drop("key"), two.select("item_id", "key"), similarity, postings)
    best = pairs.select(F.explode(F.array("left", "right")).alias("item_id"), "similarity").groupBy("item_id").agg(F.max("similarity").alias("best"))
    scored = two.select("item_id", "key").join(best, "item_id").groupBy("key").agg(F.max("best").alias("score"))
    return texts.select("item_id", "key").join(scored, "key").select("item_id", "score")
