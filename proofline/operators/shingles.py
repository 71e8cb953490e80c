"""Five-word shingles of whole tables: hashed in the tasks, and dealt in packs by ranges of the hash."""

from __future__ import annotations

import re
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

#: Of UTF-8 in lower case: free_text.TOKEN in bytes.
TOKEN = re.compile("[a-z0-9](?:[a-z0-9'\\-]+|’)*".encode())
SLICE = 256  # texts that a task holds at once as Python's
PACK = 1 << 20  # shingles that a task deals at once
BUCKET = 6_000_000  # characters, so about a million shingles, that meet in one bucket
FEWEST = 64
_STEP, _MIX = np.uint64(0x9E3779B97F4A7C15), np.uint64(0xBF58476D1CE4E5B9)


class _Words(dict):
    """Word to number, kept while there are not too many."""

    def __missing__(self, word: bytes) -> int:
        if len(self) > 100_000:
            self.clear()
        self[word] = number = int.from_bytes(blake2b(word, digest_size=8).digest(), "little")
        return number


def hashed(text: bytes | None, known: _Words, size: int = 5) -> np.ndarray:
    """The distinct runs of five tokens, hashed and sorted; a shorter text is one, one without tokens has none."""
    tokens = TOKEN.findall(text or b"")
    if not tokens:
        return np.empty(0, np.uint64)
    w = np.fromiter(map(known.__getitem__, tokens), np.uint64, len(tokens))
    k = min(size, len(w))
    n = len(w) - k + 1
    h = np.full(n, k, np.uint64)
    for i in range(k):
        h = h * _STEP + w[i : i + n]
    h ^= h >> np.uint64(32)
    h *= _MIX
    return np.unique(h ^ (h >> np.uint64(29)))


def _each(batches) -> Iterator[tuple[pa.RecordBatch, list[np.ndarray]]]:
    known = _Words()
    for batch in batches:
        for at in range(0, batch.num_rows, SLICE):
            part = batch.slice(at, SLICE)
            yield part, [hashed(t, known) for t in part.column(1).to_pylist()]


def _lowered(texts: DataFrame, *more: str) -> tuple[DataFrame, str]:
    return texts.select("item_id", F.lower("text").cast("binary").alias("text"), *more), texts.schema["item_id"].dataType.simpleString()


def sets(texts: DataFrame) -> DataFrame:
    """(item_id, shingles), without texts that have none."""

    def run(batches):
        for part, got in _each(batches):
            keep = [k for k, g in enumerate(got) if len(g)]
            yield pa.RecordBatch.from_arrays([part.column(0).take(pa.array(keep, pa.int64())), pa.array([got[k].view(np.int64) for k in keep], pa.list_(pa.int64()))], ["item_id", "shingles"])

    rows, kind = _lowered(texts)
    return rows.mapInArrow(run, f"item_id {kind}, shingles array<long>")


def keyed(texts: DataFrame) -> DataFrame:
    """(item_id, text, key) of texts in lower case: keys are equal where the shingles are; without texts that have none."""

    def run(batches):
        for part, got in _each(batches):
            keep = [k for k, g in enumerate(got) if len(g)]
            keys = [int.from_bytes(blake2b(got[k].tobytes(), digest_size=8).digest(), "little", signed=True) for k in keep]
            yield pa.RecordBatch.from_arrays([*part.take(pa.array(keep, pa.int64())).columns, pa.array(keys, pa.int64())], ["item_id", "text", "key"])

    rows, kind = _lowered(texts)
    return rows.mapInArrow(run, f"item_id {kind}, text binary, key long").withColumn("text", F.col("text").cast("string"))


def digests(texts: DataFrame) -> DataFrame:
    """(item_id, key), as `keyed` has them."""
    return keyed(texts).select("item_id", "key")


def _pack(ids: list[pa.Array], copies: list[np.ndarray], got: list[np.ndarray], buckets: int) -> pa.RecordBatch:
    """A row for each bucket: its texts, how many copies each stands for, how many shingles it has in all and in here, and those
    shingles.
    """
    every, sizes = pa.concat_arrays(ids), np.array([len(g) for g in got], np.int64)
    h, owner = np.concatenate(got), np.repeat(np.arange(len(got)), sizes)
    cell = ((h >> np.uint64(32)) * np.uint64(buckets) >> np.uint64(32)).astype(np.int64) * len(got) + owner
    order = np.argsort(cell, kind="stable")
    cell, h = cell[order], h[order]
    at = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    bucket, owner, n = cell[at] // len(got), cell[at] % len(got), np.diff(np.r_[at, len(cell)]).astype(np.int32)
    low = np.flatnonzero(np.r_[True, bucket[1:] != bucket[:-1]])
    high, sizes, copies = np.r_[low[1:], len(bucket)], sizes[owner].astype(np.int32), np.concatenate(copies)[owner]
    cut = lambda a, lo, hi: pa.array([a[i:j].tobytes() for i, j in zip(lo, hi)], pa.binary())
    ends = np.r_[at, len(cell)]
    texts = pa.ListArray.from_arrays(pa.array(np.r_[low, len(bucket)], pa.int32()), every.take(pa.array(owner)))
    return pa.RecordBatch.from_arrays([pa.array(bucket[low], pa.int32()), texts, cut(copies, low, high), cut(sizes, low, high), cut(n, low, high), cut(h, ends[low], ends[high])], ["bucket", "ids", "copies", "sizes", "n", "shingles"])


def packs(texts: DataFrame) -> DataFrame:
    """(bucket, ids, copies, sizes, n, shingles): the shingles of every text, a bucket holding all that lie in its range. A text
    counts as often as its column `copies` says, or once without that column.
    """
    more = [c for c in texts.columns if c == "copies"]
    chars = texts.agg(F.sum(F.length("text")).alias("n")).first().n or 0
    buckets = max(FEWEST, chars // BUCKET)

    def run(batches):
        ids, copies, got, held = [], [], [], 0
        for part, many in _each(batches):
            ids.append(part.column(0))
            copies.append(part.column(2).to_numpy().astype(np.int32) if more else np.ones(len(many), np.int32))
            got += many
            held += sum(map(len, many))
            if held >= PACK:
                yield _pack(ids, copies, got, buckets)
                ids, copies, got, held = [], [], [], 0
        if held:
            yield _pack(ids, copies, got, buckets)

    rows, kind = _lowered(texts, *more)
    return rows.mapInArrow(run, f"bucket int, ids array<{kind}>, copies binary, sizes binary, n binary, shingles binary")


def _opened(table: pa.Table) -> tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """ids and sizes of a bucket's texts; and of its shingles, in their order, the text, the shingle and how many texts have it."""
    joined = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
    ids = pa.concat_arrays([c.flatten() for c in table.column("ids").chunks])
    owner, h = np.repeat(np.arange(len(ids)), joined("n", np.int32)), joined("shingles", np.uint64)
    order = np.argsort(h, kind="stable")
    owner, h = owner[order], h[order]
    at = np.flatnonzero(np.r_[True, h[1:] != h[:-1]])
    n = np.add.reduceat(joined("copies", np.int32).astype(np.int64)[owner], at)
    return ids, joined("sizes", np.int32), owner, h, np.repeat(n, np.diff(np.r_[at, len(h)]))


def shared_counts(texts: DataFrame, most: int) -> DataFrame:
    """(item_id, shared): how many of a text's shingles stand in 2 to `most` texts; without texts that have none of these."""

    def run(table):
        ids, _, owner, _, n = _opened(table)
        k = np.bincount(owner[(n > 1) & (n <= most)], minlength=len(ids))
        some = np.flatnonzero(k)
        return pa.table([ids.take(pa.array(some)), pa.array(k[some], pa.int64())], ["item_id", "shared"])

    kind = texts.schema["item_id"].dataType.simpleString()
    return packs(texts).groupBy("bucket").applyInArrow(run, f"item_id {kind}, shared long").groupBy("item_id").agg(F.sum("shared").alias("shared"))


def shared(texts: DataFrame, most: int | None) -> DataFrame:
    """(item_id, size, shingle, n): the shingles of a text that stand in n texts, 2 to `most`; and, without a shingle, how
    many of them stand in more.
    """

    def run(table):
        ids, sizes, owner, h, n = _opened(table)
        top = most or n.max()
        low, high = (n > 1) & (n <= top), n > top
        k = np.bincount(owner[high], minlength=len(ids))
        some = np.flatnonzero(k)
        of = np.r_[owner[low], some]
        shingle = pa.array(np.r_[h[low].view(np.int64), np.zeros(len(some), np.int64)], mask=np.r_[np.zeros(low.sum(), bool), np.ones(len(some), bool)])
        return pa.table([ids.take(pa.array(of)), pa.array(sizes[of], pa.int32()), shingle, pa.array(np.r_[n[low], k[some]].astype(np.int32))], ["item_id", "size", "shingle", "n"])

    kind = texts.schema["item_id"].dataType.simpleString()
    return packs(texts).groupBy("bucket").applyInArrow(run, f"item_id {kind}, size int, shingle long, n int")
