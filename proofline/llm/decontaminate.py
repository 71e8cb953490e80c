"""Benchmark decontamination with a positional inverted index, in DataFrame operations only.

Postings (term, document, position) are kept for the rarest terms of each benchmark window. Lists of one window are shifted
by the term's offset and intersected from the rarest on; what remains names a document and a start, where the whole
phrase is compared. Terms are counted over all documents, and windows with a term that no document has are left out.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from proofline.llm.common import cut, keyed, marked, small

WINDOW = 13
LISTS = 3  # posting lists that are intersected
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_GAP = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words(text: Column) -> Column:
    """Words of a text with A-Z in lower case; null, empty and word-free texts have none."""
    text = F.coalesce(text.cast("string"), F.lit(""))
    small = F.when(F.octet_length(text) == F.length(text), F.lower(text)).otherwise(F.translate(text, _UPPER, _LOWER))
    return F.array_remove(F.split(small, _GAP), "")


def _small_terms(df: DataFrame) -> DataFrame:
    return small(df, F.octet_length("term") + 16)


def windows(benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """(item_id, phrase, size): every run of `window` words of each item; a shorter item is one run, one without words none."""
    items = benchmark.select("item_id", words(F.col("text")).alias("w")).filter("size(w) > 0")
    starts = F.sequence(F.lit(1), F.greatest(F.lit(1), F.size("w") - window + 1))
    runs = items.select("item_id", F.explode(F.transform(starts, lambda s: F.slice("w", s, window))).alias("run"))
    return runs.select("item_id", F.array_join("run", " ").alias("phrase"), F.size("run").alias("size")).distinct()


def postings(docs: DataFrame, terms: DataFrame) -> DataFrame:
    """(rid, d, pos, term) of the given terms (term) in docs (rid, d, text)."""
    return docs.select("rid", "d", F.posexplode(words(F.col("text"))).alias("pos", "term")).join(terms, "term")


def candidates(docs: DataFrame, phrases: DataFrame, lists: int = LISTS) -> DataFrame:
    """(rid, d, start, size): where the rarest terms of a phrase (phrase, size) all stand at their offsets."""
    offsets = phrases.select("phrase", "size", F.posexplode(F.split("phrase", " ")).alias("offset", "term"))
    offsets = cut(offsets)
    vocabulary = _small_terms(offsets.select("term").distinct())
    counts = docs.select(F.explode(words(F.col("text"))).alias("term")).join(vocabulary, "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    counts = cut(counts)
    scored = offsets.join(counts, "term", "left").groupBy("phrase", "size").agg(F.sort_array(F.collect_list(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "offset", "term"))).alias("t"))
    scored = scored.filter("t[0].n > 0").select("phrase", "size", F.slice("t", 1, lists).alias("t"))
    lead = scored.select("phrase", "size", F.size("t").alias("lists"), F.posexplode("t").alias("k", "t")).select("phrase", "size", "lists", "k", "t.term", "t.offset")
    lead = cut(lead.groupBy("term").agg(F.collect_list(F.struct(F.xxhash64("phrase").alias("id"), "size", "lists", "offset")).alias("uses")))
    found = postings(docs, small(lead, F.octet_length("term") + 16 + 40 * F.size("uses"))).select("rid", "d", "pos", F.explode("uses").alias("u"))
    found = found.select("rid", "d", (F.col("pos") - F.col("u.offset")).alias("start"), "u.id", "u.size", "u.lists").filter("start >= 0")
    full = found.groupBy("rid", "d", "start", "id", "size", "lists").count().filter("count = lists")
    return full.select("rid", "d", "start", "size").distinct()


def matches(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> tuple[DataFrame, DataFrame]:
    """(hits, counts): hits (rid, d, start, size, phrase) of exact windows, counts (doc_id, rid, d, n_words) of every row."""
    rows = keyed(docs)
    phrases = cut(windows(benchmark, window))
    distinct = phrases.select("phrase", "size").distinct()
    found = candidates(rows.select("rid", "d", "text"), distinct)
    places = cut(found.groupBy("rid", "d").agg(F.collect_set(F.struct("start", "size")).alias("places")))
    split = rows.join(small(places, 32 + 24 * F.size("places")), ["rid", "d"], "left").select("doc_id", "rid", "d", words(F.col("text")).alias("w"), "places")
    taken = split.select("doc_id", "rid", "d", F.size("w").alias("n_words"), F.transform("places", lambda p: F.struct(p["start"].alias("start"), p["size"].alias("size"), F.array_join(F.slice("w", p["start"] + 1, p["size"]), " ").alias("phrase"))).alias("p"))
    taken = cut(taken)
    hits = taken.filter("p is not null").select("rid", "d", F.explode("p").alias("p")).select("rid", "d", "p.start", "p.size", "p.phrase").distinct()
    return hits.join(phrases, ["phrase", "size"]), taken.select("doc_id", "rid", "d", "n_words")


def _report(docs: DataFrame, benchmark: DataFrame, window: int) -> DataFrame:
    """contamination() with rid and d of each row, and the words of the longest window that it holds."""
    hits, counts = matches(docs, benchmark, window)
    spans = hits.groupBy("rid", "d").agg(F.sort_array(F.collect_set(F.struct("start", (F.col("start") + F.col("size")).alias("stop")))).alias("s"), F.sort_array(F.collect_set(F.col("item_id").cast("string"))).alias("items"), F.max("size").alias("longest"))
    zero = F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).cast("long").alias("end"))
    covered = F.aggregate(
        "s",
        zero,
        lambda a, s: F.struct((a["n"] + F.greatest(F.lit(0).cast("long"), s["stop"].cast("long") - F.greatest(s["start"].cast("long"), a["end"]))).alias("n"), F.greatest(a["end"], s["stop"].cast("long")).alias("end")),
        lambda a: a["n"],
    )
    spans = spans.select("rid", "d", covered.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.array_join("items", ",").alias("items"), "longest")
    out = counts.join(spans, ["rid", "d"], "left").select("rid", "d", "doc_id", F.col("n_words").cast("long").alias("n_words"), F.coalesce("n_hit", F.lit(0).cast("long")).alias("n_hit"), F.coalesce("n_items", F.lit(0).cast("long")).alias("n_items"), F.sha2(F.coalesce("items", F.lit("")), 256).alias("items_sha256"), F.coalesce("longest", F.lit(0)).alias("longest"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (20 * F.col("n_hit") >= F.col("n_words")))


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated.

    A document word within an occurrence of a benchmark window is hit; contaminated: n_hit > 0 and 20 * n_hit >= n_words.
    Null, empty and word-free texts have no words and no hits; so have null and word-free items. Rows that repeat both
    doc_id and text are one document, each returned with its result. An empty benchmark leaves every document clean, an
    empty table gives no rows; other columns are not read.
    """
    return _report(docs, benchmark, window).drop("rid", "d", "longest")


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """The rows of docs without a benchmark passage, each judged by its own text; all columns stay.

    A whole window of `window` words is a passage, however long the document around it. A shorter item is one only where
    contamination() says so, as a few common words stand in clean documents too.
    """
    bad = _report(docs, benchmark, window).filter(F.col("contaminated") | (F.col("longest") >= window)).select(F.col("d").alias("__d"), F.col("rid").alias("__rid"))
    return marked(docs).join(bad, ["__d", "__rid"], "left_anti").select(docs.columns)


def proximity(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, reach: int = 26, share: float = 0.8) -> DataFrame:
    """(doc_id, item_id, start, shared): document spans of `reach` words that hold at least `share` of the distinct words of a
    benchmark window, in any order; of each document and item the best span, and of equally good ones the first.

    A window that may miss k words is looked up by its k + 1 rarest, one of which every such span holds; words that no
    document has are missed already. Each place of one is judged by all spans over it, so every span is found. Null and
    word-free texts match nothing.
    """
    rows = keyed(docs)
    phrases = cut(windows(benchmark, window))
    vocabulary = phrases.select("item_id", "phrase", F.explode(F.array_distinct(F.split("phrase", " "))).alias("term"))
    counts = rows.select(F.explode(F.array_distinct(words(F.col("text")))).alias("term")).join(_small_terms(vocabulary.select("term").distinct()), "term", "left_semi").groupBy("term").agg(F.count("*").alias("n"))
    wanted = F.array_distinct(F.split("phrase", " "))
    need = F.greatest(F.lit(1), F.ceil(F.size(wanted) * share - 1e-9).cast("int"))
    rare = vocabulary.join(counts, "term").groupBy("item_id", "phrase").agg(F.sort_array(F.collect_list(F.struct("n", "term"))).alias("t")).withColumn("need", need).filter(F.size("t") >= F.col("need"))
    rare = cut(rare.select("item_id", "phrase", "need", F.explode(F.slice("t", F.lit(1), F.size("t") - F.col("need") + 1)).alias("t")).select("item_id", "phrase", "need", "t.term"))
    posts = postings(rows, _small_terms(rare.select("term").distinct())).groupBy("rid", "d").agg(F.collect_set(F.struct("pos", "term")).alias("places"))
    near = rows.join(posts, ["rid", "d"]).select("doc_id", words(F.col("text")).alias("w"), "places")
    first = lambda p: F.greatest(p["pos"] - reach + 1, F.lit(0))
    around = near.select("doc_id", F.explode(F.transform("places", lambda p: F.struct(p["term"].alias("term"), p["pos"].alias("pos"), first(p).alias("first"), F.slice("w", first(p) + 1, p["pos"] - first(p) + reach).alias("wide")))).alias("p")).select("doc_id", "p.*")
    held = lambda span: F.size(F.array_intersect(span, wanted))
    close = around.join(small(rare, F.octet_length("term") + F.octet_length("phrase") + 40), "term").filter(held("wide") >= F.col("need"))
    spans = F.transform(F.sequence(F.col("first"), F.col("pos")), lambda s: F.struct(held(F.slice("wide", s - F.col("first") + 1, reach)).alias("n"), (-s).alias("back")))
    best = close.withColumn("best", F.array_max(spans)).filter(F.col("best.n") >= F.col("need")).withColumn("shared", F.col("best.n") / F.size(wanted)).withColumn("start", -F.col("best.back"))
    return best.groupBy("doc_id", "item_id").agg(F.min_by("start", F.struct(-F.col("shared"), "start")).alias("start"), F.max("shared").alias("shared"))
