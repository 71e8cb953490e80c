"""Helpers that several operators share: tables, lineage cuts, row ids, hashed words."""

from __future__ import annotations

import tempfile
import uuid

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where it is unset, a local master gets a temporary
    one; any other raises, since its executors could not read what another one wrote there.
    """
    sc = spark.sparkContext
    set_dir = sc._jsc.sc().getCheckpointDir()
    if set_dir.isEmpty():
        wanted = spark.conf.get("spark.checkpoint.dir", None)
        if not wanted and not sc.master.startswith("local"):
            raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
        sc.setCheckpointDir(wanted or tempfile.mkdtemp(prefix="checkpoint-"))
        set_dir = sc._jsc.sc().getCheckpointDir()
    return set_dir.get()


def cut(df: DataFrame) -> DataFrame:
    """Reliable checkpoint: lineage ends in files that outlive a lost executor."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def cut_table(df: DataFrame) -> DataFrame:
    """As cut(), as a compressed columnar table: for wide or many rows."""
    path = f"{shared_dir(df.sparkSession)}/table-{uuid.uuid4().hex}"
    df.write.option("compression", "zstd").parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


BROADCAST_BYTES = 32 << 20  # that a broadcast may hold, by a count before it; beyond it joins shuffle


def small(df: DataFrame, size: Column, limit: int = BROADCAST_BYTES) -> DataFrame:
    """df, marked for broadcast if its rows, of `size` bytes each, are no more than limit bytes."""
    return F.broadcast(df) if (df.agg(F.sum(size.cast("long"))).first()[0] or 0) <= limit else df


def keyed(docs: DataFrame) -> DataFrame:
    """(doc_id, d, rid, text): d is doc_id with null as the least long, and (d, rid) names a document.

    Both come from the row itself, so they stay the same when a lost executor's work is done again. Rows that share doc_id
    and text are one document. rid is a hash of both columns.
    """
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), d.alias("d"), F.col("text").cast("string").alias("text")).withColumn("rid", F.xxhash64("d", "text"))


def marked(docs: DataFrame) -> DataFrame:
    """docs with __d and __rid, which are d and rid of keyed()."""
    d = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63)))
    return docs.withColumn("__d", d).withColumn("__rid", F.xxhash64("__d", F.col("text").cast("string")))


_ODD = np.uint64(0x9E3779B97F4A7C15)
_INV = np.uint64(pow(0x9E3779B97F4A7C15, -1, 1 << 64))


def powers(base: np.uint64, n: int) -> np.ndarray:
    out = np.full(n, base, np.uint64)
    out[:1] = 1
    with np.errstate(over="ignore"):
        return np.multiply.accumulate(out)


def mix(h: np.ndarray) -> np.ndarray:
    with np.errstate(over="ignore"):
        h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
        h = (h ^ (h >> np.uint64(29))) * np.uint64(0x94D049BB133111EB)
    return h ^ (h >> np.uint64(32))


def span_hashes(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of data[start:end] for many spans at once, from one running sum."""
    if not len(starts):
        return np.zeros(0, np.uint64)
    with np.errstate(over="ignore"):
        total = np.zeros(len(data) + 1, np.uint64)
        np.cumsum((data.astype(np.uint64) + np.uint64(1)) * powers(_ODD, len(data)), out=total[1:])
        return mix((total[ends] - total[starts]) * powers(_INV, len(data) + 1)[starts] + (ends - starts).astype(np.uint64))


def byte_set(inside) -> np.ndarray:
    """Table of 256 flags."""
    return np.array([bool(inside(b)) for b in range(256)])


#: Bytes that separate tokens, and bytes that separate bare words.
SPACES = byte_set(lambda b: b in (9, 10, 11, 12, 13, 32))
NO_WORD = byte_set(lambda b: b < 128 and not chr(b).isalnum())
BLOCK_BYTES = 500_000  # of text that is hashed at once: 50 times as many bytes of arrays


def blocks(texts: list[str | None], size: int = BLOCK_BYTES):
    """(rows, bytes, offsets): runs of whole texts of about so many bytes; a longer text comes in pieces that end at white space."""
    rows, parts, held = [], [], 0
    for i, text in enumerate(texts):
        raw, at = (text or "").encode("utf-8", "replace"), 0
        while len(raw) - at > size:
            ends = [e for e in (raw.find(b" ", at + size), raw.find(b"\n", at + size)) if e >= 0]
            end = min(ends) + 1 if ends else len(raw)
            yield np.array([i]), [raw[at:end]], np.array([at])
            at = end
        if held + len(raw) - at > size and rows:
            yield np.array(rows), parts, np.array(offsets)
            rows, parts, held = [], [], 0
        if not rows:
            offsets: list[int] = []
        rows.append(i)
        parts.append(raw[at:])
        offsets.append(at)
        held += len(raw) - at + 1
    if rows:
        yield np.array(rows), parts, np.array(offsets)


def spans_of(parts: list[bytes], separators: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(part, start, end) of every run of other bytes in the parts, the joined bytes, and where each part begins."""
    data = np.frombuffer(b"\n".join(parts) + b"\n", np.uint8)
    edge = np.flatnonzero(np.diff(np.concatenate(([True], separators[data])).astype(np.int8)))
    starts, ends = edge[0::2], edge[1::2]
    begins = np.concatenate(([0], np.cumsum([len(p) + 1 for p in parts])[:-1]))
    return np.searchsorted(begins, starts, "right") - 1, starts, ends, data, begins


MOST_GRADES = 64


def labelled(docs: DataFrame, labels: DataFrame, column: str, limit: int) -> DataFrame:
    """(doc_id, text, y double, share) of at most `limit` labelled documents of each value y, those first by a hash of doc_id.

    share: rows of that value for each row that was taken. Rows without a label or id are left out; of several labels of a
    document the largest counts. More than MOST_GRADES values are no grades and raise.
    """
    known = labels.filter(F.col(column).isNotNull() & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.max(F.col(column).cast("double")).alias("y"))
    known = cut(known)
    sizes = known.groupBy("y").count().orderBy("y").limit(MOST_GRADES + 1).collect()
    if len(sizes) > MOST_GRADES:
        raise ValueError(f"{column} has more than {MOST_GRADES} values")
    picked = None
    for r in sizes:
        part = known.filter(F.col("y") == r["y"]).orderBy(F.xxhash64("doc_id"), "doc_id").limit(limit).withColumn("share", F.lit(r["count"] / min(limit, r["count"])))
        picked = part if picked is None else picked.union(part)
    picked = cut((known.limit(0).withColumn("share", F.lit(1.0)) if picked is None else picked))
    rows = docs.select("doc_id", F.col("text").cast("string").alias("text")).join(F.broadcast(picked), "doc_id")  # MOST_GRADES * limit rows at most
    return rows.groupBy("doc_id").agg(F.min("text").alias("text"), F.min("y").alias("y"), F.min("share").alias("share"))
