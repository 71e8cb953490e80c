"""Sharding along a Hilbert curve over several metadata dimensions."""

from __future__ import annotations

import os

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from proofline.llm.common import cut, cut_table

SHARDS, BITS = 16, 5
DIMENSIONS = ("lang", "source", "n_chars", "doc_id")


def hilbert_index(points: np.ndarray, bits: int = BITS) -> np.ndarray:
    """Distance along the Hilbert curve of rows of integer coordinates below 2**bits (Skilling's transposed form)."""
    x = points.astype(np.int64).T.copy()
    n, top = len(x), 1 << (bits - 1)
    q = top
    while q > 1:
        p = q - 1
        for i in range(n):
            high = (x[i] & q) != 0
            swap = np.where(high, 0, (x[0] ^ x[i]) & p)
            x[0] = np.where(high, x[0] ^ p, x[0] ^ swap)
            x[i] ^= swap
        q >>= 1
    for i in range(1, n):
        x[i] ^= x[i - 1]
    t, q = np.zeros_like(x[0]), top
    while q > 1:
        t = np.where((x[n - 1] & q) != 0, t ^ (q - 1), t)
        q >>= 1
    x ^= t
    out = np.zeros(points.shape[0], np.int64)
    for b in range(bits - 1, -1, -1):
        for i in range(n):
            out = (out << 1) | ((x[i] >> b) & 1)
    return out


def _common(docs: DataFrame, names: list[str]) -> dict[str, int]:
    """Bytes that all values of a string dimension begin with: those that the least and the greatest share."""
    if not names:
        return {}
    ends = docs.agg(*(f(_bytes(n)).alias(f"{k}{i}") for i, n in enumerate(names) for k, f in (("low", F.min), ("high", F.max)))).first()
    return {n: len(os.path.commonprefix([bytes(ends[f"low{i}"] or b""), bytes(ends[f"high{i}"] or b"")])) for i, n in enumerate(names)}


def _bytes(name: str) -> Column:
    return F.col(name).cast("binary")


def _number(docs: DataFrame, name: str, skip: int = 0) -> Column:
    """A dimension as a number in the order of its values; strings by their six bytes behind the `skip` ones that all share, a missing column or null as the least."""
    if name not in docs.columns:
        return F.lit(float("-inf"))
    if dict(docs.dtypes)[name] in ("string", "binary"):
        head = F.conv(F.rpad(F.hex(F.substring(_bytes(name), skip + 1, 6)), 12, "0"), 16, 10).cast("double")  # 48 bits, which a double holds
        return F.coalesce(head, F.lit(float("-inf")))
    return F.coalesce(F.col(name).cast("double"), F.lit(float("-inf")))


def shards(docs: DataFrame, n_shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, bits: int = BITS) -> DataFrame:
    """One row per document: doc_id, size, text_crc32, law (`rows`), shard, slot, grown_shard (null), hilbert.

    Every dimension is cut at quantiles over all rows, rows are sorted by curve index (ties: doc_id, checksum, size) and the
    order is cut into n_shards runs whose row counts differ by one at most; slot counts from 0 in each run. Size is UTF-8
    bytes plus 1; a null text has size 1 and checksum 0. A null or missing dimension comes first. With fewer rows than
    shards, some shards have none. Repeated rows each take a slot; an empty table gives none.
    """
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    names = [f"k{i}" for i in range(len(dimensions))]
    skip = _common(docs, [d for d in dimensions if dict(docs.dtypes).get(d) in ("string", "binary")])
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), (F.octet_length(body) + 1).cast("long").alias("size"), F.crc32(body.cast("binary")).alias("text_crc32"), *(_number(docs, d, skip.get(d, 0)).alias(k) for d, k in zip(dimensions, names)))
    rows = cut_table(rows)
    steps = [i / (1 << bits) for i in range(1, 1 << bits)]
    cuts = rows.agg(F.count("*").alias("n"), *(F.percentile_approx(k, steps, 10_000).alias(k) for k in names)).first()
    edges = [np.array(cuts[k] if cuts[k] is not None else [0.0] * len(steps)) for k in names]

    @F.pandas_udf("long")
    def curve(*columns: pd.Series) -> pd.Series:
        return pd.Series(hilbert_index(np.stack([np.searchsorted(e, c.to_numpy(), "right") for e, c in zip(edges, columns)], axis=1), bits))

    order = ["hilbert", "doc_id", "text_crc32", "size"]
    n = max(1, int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    placed = rows.select("doc_id", "size", "text_crc32", curve(*names).alias("hilbert"))
    dealt = cut(placed.repartitionByRange(n, *order).withColumn("part", F.spark_partition_id()))
    before, starts = 0, []
    for r in dealt.groupBy("part").count().orderBy("part").collect():  # a row for each range
        starts.append((r["part"], before))
        before += r["count"]
    total = before
    offsets = docs.sparkSession.createDataFrame(starts, "part int, before long")
    rank = F.row_number().over(Window.partitionBy("part").orderBy(*order)) - 1 + F.col("before")
    ranked = dealt.join(F.broadcast(offsets), "part").withColumn("rank", rank)
    shard = F.expr(f"(rank * {n_shards}L) div {max(total, 1)}L")
    first = F.expr(f"(shard * {total}L + {n_shards - 1}L) div {n_shards}L")
    out = ranked.withColumn("shard", shard.cast("int")).withColumn("slot", (F.col("rank") - first).cast("long"))
    return out.select("doc_id", "size", "text_crc32", F.lit("rows").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"), "hilbert")


def write_shards(docs: DataFrame, path: str, n_shards: int = SHARDS, dimensions: tuple[str, ...] = DIMENSIONS, rows_per_file: int = 1_000_000) -> None:
    """docs as Parquet under path, a folder for each shard, in curve order, so that files can be skipped by every dimension's least and greatest value."""
    body = F.coalesce(F.col("text").cast("string"), F.lit(""))
    keyed = docs.withColumn("__crc", F.crc32(body.cast("binary")))
    place = shards(docs, n_shards, dimensions).groupBy("doc_id", "text_crc32").agg(F.min("shard").alias("shard"), F.min("slot").alias("__slot"))
    joined = keyed.join(place.withColumnsRenamed({"doc_id": "__id", "text_crc32": "__code"}), F.col("doc_id").eqNullSafe(F.col("__id")) & (F.col("__crc") == F.col("__code")))
    ordered = joined.repartitionByRange("shard", "__slot").sortWithinPartitions("shard", "__slot").drop("__id", "__code", "__crc", "__slot")
    ordered.write.option("maxRecordsPerFile", rows_per_file).partitionBy("shard").parquet(path)
