"""SimHash near-duplicates: fingerprints, exact banding, bit-sliced comparison, components."""

from __future__ import annotations

from itertools import combinations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, functions as F

from proofline.llm.common import cut, keyed, marked
from proofline.llm.components import components

SHINGLE, RADIUS, SEED = 4, 4, 42
MOST_RADIUS = 7  # that near() counts to
BLOCK_ROWS = 4096


def fingerprint(text: str | None, shingle: int = SHINGLE) -> int:
    """64-bit SimHash of a text; null, empty or blank: 0."""
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined, n = b" ".join(words), max(1, len(words) - shingle + 1)
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.concatenate(([0], ends[:-1]))[:n].tolist()
    stops = (ends[min(shingle, len(words)) - 1 :] - 1).tolist()
    digest, total = xxhash.xxh64_intdigest, np.zeros(64, np.int64)
    for k in range(0, n, 65_536):
        h = np.array([digest(joined[s:e], SEED) for s, e in zip(starts[k : k + 65_536], stops[k : k + 65_536])], "<u8")
        total += np.unpackbits(h.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    return int(np.packbits(2 * total > n, bitorder="little").view("<u8")[0])


def fingerprints(docs: DataFrame, keys: tuple[str, ...] = ("doc_id",)) -> DataFrame:
    """(keys, fp long) of every row; keys are columns of longs."""

    def run(batches):
        for b in batches:
            fp = np.array([fingerprint(t) for t in b.column("text").to_pylist()], np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([*(b.column(k) for k in keys), pa.array(fp)], [*keys, "fp"])

    return docs.select(*(F.col(k).cast("long").alias(k) for k in keys), F.col("text").cast("string").alias("text")).mapInArrow(run, ", ".join(f"{k} long" for k in (*keys, "fp")))


def _planes(fp: np.ndarray) -> np.ndarray:
    """64 vertical bit planes of fingerprints, 64 of them to a word; lanes that are left over are zero."""
    width = -(-len(fp) // 64)
    bits = np.zeros((64, width * 64), np.uint8)
    bits[:, : len(fp)] = np.unpackbits(np.ascontiguousarray(fp, np.uint64).view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").T
    return np.packbits(bits, axis=1, bitorder="little").view(np.uint64)


def _within(differ, shape: tuple, radius: int) -> np.ndarray | None:
    """Lanes that differ in at most radius (up to 7) bits, as bytes; differ(b): the lanes that differ in bit b, as words.

    Carry-save adders count the differing bits of all lanes at once, four planes a step; None as soon as every lane has
    passed the radius.
    """
    one = np.zeros(shape, np.uint64)
    two, four, over, full = one.copy(), one.copy(), one.copy(), ~np.uint64(0)
    for b in range(0, 64, 4):
        x, y, z, w = (differ(b + j) for j in range(4))
        a = one ^ x
        carry_a, one = (one & x) | (a & y), a ^ y
        a = one ^ z
        carry_b, one = (one & z) | (a & w), a ^ w
        a = two ^ carry_a
        carry, two = (two & carry_a) | (a & carry_b), a ^ carry_b
        over |= four & carry
        four = four ^ carry
        past = over | _greater(four, two, one, radius)
        if (past == full).all():
            return None
    return np.unpackbits((~past).view(np.uint8), axis=-1, bitorder="little").astype(bool)


def near(left: np.ndarray, right: np.ndarray, radius: int = RADIUS) -> np.ndarray:
    """Boolean matrix: which of left lie within radius (up to 7) bits of which of right."""
    planes, full = _planes(right), ~np.uint64(0)
    out = np.zeros((len(left), planes.shape[1] * 64), bool)
    for at in range(0, len(left), 512):
        q = np.ascontiguousarray(left[at : at + 512], np.uint64)
        flip = np.where((q[:, None] >> np.arange(64, dtype=np.uint64)) & np.uint64(1), full, np.uint64(0))
        got = _within(lambda b: planes[b][None, :] ^ flip[:, b, None], (len(q), planes.shape[1]), radius)
        if got is not None:
            out[at : at + 512] = got
    return out[:, : len(right)]


def near_pairs(left: np.ndarray, right: np.ndarray, radius: int = RADIUS, block: int = 4096) -> np.ndarray:
    """Which left[i] lie within radius (up to 7) bits of right[i]; a block whose pairs are all past the radius ends at once."""
    out = np.zeros(len(left), bool)
    for at in range(0, len(left), block):
        planes = _planes(left[at : at + block] ^ right[at : at + block])
        got = _within(lambda b: planes[b], (planes.shape[1],), radius)
        if got is not None:
            out[at : at + block] = got[: len(out[at : at + block])]
    return out


def _greater(four: np.ndarray, two: np.ndarray, one: np.ndarray, radius: int) -> np.ndarray:
    """Lanes whose three-bit count is over radius."""
    more, same = np.zeros_like(one), ~np.zeros_like(one)
    for plane, bit in ((four, radius & 4), (two, radius & 2), (one, radius & 1)):
        if bit:
            same = same & plane
        else:
            more, same = more | (same & plane), same & ~plane
    return more


def _spanning(left: np.ndarray, right: np.ndarray, radius: int) -> list[tuple[int, int]]:
    """Links that connect what all links within radius connect."""
    nodes = np.unique(np.concatenate((left, right)))
    if left is right:
        linked = near(nodes, nodes, radius)
    else:
        linked = np.zeros((len(nodes), len(nodes)), bool)
        i, j = np.searchsorted(nodes, left), np.searchsorted(nodes, right)
        linked[np.ix_(i, j)] = near(left, right, radius)
        linked |= linked.T
    out, free = [], np.ones(len(nodes), bool)
    for seed in range(len(nodes)):
        if not free[seed]:
            continue
        free[seed] = False
        front = np.array([seed])
        while len(front):
            new = np.flatnonzero(linked[front].any(axis=0) & free)
            free[new] = False
            out += [(int(nodes[seed]), int(nodes[x])) for x in new]
            front = new
    return out


def _links(batches, radius: int):
    """Rows come sorted by (cell): links within each cell, of the i side with the j side."""
    held: list[np.ndarray] = []

    def solve(cell, fp, side):
        a, b = [], []
        # Cells of a few rows: neighbours in the order, one shift at a time.
        starts = np.flatnonzero(np.concatenate(([True], cell[1:] != cell[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(cell)])))
        small = np.repeat(sizes <= 32, sizes)
        for shift in range(1, int(min(32, sizes.max(initial=1)))):
            i = np.flatnonzero(small[:-shift] & (cell[shift:] == cell[:-shift]) & ((side[shift:] != side[:-shift]) | (side[shift:] == 2)))
            if not len(i):
                continue
            i = i[near_pairs(fp[i], fp[i + shift], radius)]
            a.append(fp[i])
            b.append(fp[i + shift])
        for s, n in zip(starts[sizes > 32].tolist(), sizes[sizes > 32].tolist()):
            f, w = fp[s : s + n], side[s : s + n]
            left, right = (f, f) if w[0] == 2 else (f[w == 0], f[w == 1])
            if len(left) and len(right):
                pairs = np.array(_spanning(left, left if w[0] == 2 else right, radius), np.uint64).reshape(-1, 2)
                a.append(pairs[:, 0])
                b.append(pairs[:, 1])
        a, b = (np.concatenate(x) if x else np.zeros(0, np.uint64) for x in (a, b))
        return pa.RecordBatch.from_arrays([pa.array(a.view(np.int64)), pa.array(b.view(np.int64))], ["u", "v"])

    for batch in batches:
        rows = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("cell", "fp", "side")]
        if held:
            rows = [np.concatenate(x) for x in zip(held, rows)]
        last = int(np.searchsorted(rows[0], rows[0][-1], "left")) if len(rows[0]) else 0
        if last:
            yield solve(rows[0][:last], rows[1][:last].view(np.uint64), rows[2][:last])
        held = [x[last:] for x in rows]
    if held and len(held[0]):
        yield solve(held[0], held[1].view(np.uint64), held[2])


def blocks_for(radius: int) -> list[int]:
    """Sizes of blocks of the 64 bits, of which two are alike where at most `radius` bits differ."""
    if not 0 <= radius <= MOST_RADIUS:
        raise ValueError(f"a radius of 0 to {MOST_RADIUS} bits is needed, not {radius}")
    n = radius + 2
    return [64 // n + (k < 64 % n) for k in range(n)]


def links(distinct: DataFrame, radius: int = RADIUS, block_rows: int = BLOCK_ROWS) -> DataFrame:
    """(u, v): links that connect all distinct fingerprints (fp) within radius bits of each other.

    Fingerprints within r bits agree on 2 of r + 2 blocks of bits, so each pair of blocks (15 for 4 bits) is a table, and
    the buckets of all tables hold every such pair. A bucket of over block_rows fingerprints is dealt into blocks, and each pair of blocks is a
    cell of its own: no task holds more than two blocks, and no pair is lost.
    """
    masks, at = [], 0
    for n in blocks_for(radius):
        masks.append(((1 << n) - 1) << at)
        at += n
    signed = lambda x: x - (1 << 64) if x >> 63 else x
    keys = F.array(*[F.xxhash64(F.lit(k), F.col("fp").bitwiseAND(F.lit(signed(masks[i] | masks[j])))) for k, (i, j) in enumerate(combinations(range(len(masks)), 2))])
    rows = distinct.select("fp", F.explode(keys).alias("key"))
    large = rows.groupBy("key").count().filter(F.col("count") > block_rows).select("key", F.ceil(F.col("count") / block_rows).cast("int").alias("n"))
    rows = rows.join(large, "key", "left").select("fp", "key", F.coalesce("n", F.lit(1)).alias("n"))
    rows = rows.withColumn("own", F.pmod(F.xxhash64("fp", F.lit(7)), "n").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("n") - 1)))
    cell = F.when(F.col("n") == 1, F.col("key")).otherwise(F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")))
    side = F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1)
    cells = rows.select(cell.alias("cell"), "fp", side.cast("int").alias("side"))
    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return cells.repartition(n, "cell").sortWithinPartitions("cell", "fp").mapInArrow(lambda it: _links(it, radius), "u long, v long")


def near_duplicates(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row per document: doc_id, fingerprint (16 hex digits), component_id (smallest doc_id reachable, itself included).

    A null, empty or blank text has fingerprint zero and is linked like any other. Rows that share a doc_id are each
    returned; a null doc_id is passed over for component_id unless all of a component are null. An empty table gives none.
    """
    fp = cut(fingerprints(docs))
    classes = fp.groupBy("fp").agg(F.min("doc_id").alias("low"))
    groups = components(links(classes.select("fp"), radius))
    joined = classes.join(groups, classes.fp == groups.node, "left").select("fp", "low", F.coalesce("component", "fp").alias("component"))
    roots = joined.groupBy("component").agg(F.min("low").alias("component_id"))
    return (
        fp.join(joined.join(roots, "component").select("fp", "component_id"), "fp")
        .select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
    )


def distinct(docs: DataFrame, radius: int = RADIUS) -> DataFrame:
    """One row of docs for each group of near duplicates: that of the smallest doc_id (null last), then of the smallest hash
    of its text. Rows that repeat doc_id and text are one. All columns stay; an empty table gives none.
    """
    fp = cut(fingerprints(keyed(docs), ("doc_id", "d", "rid")))
    firsts = fp.groupBy("fp").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "d", "rid")).alias("first"))
    groups = components(links(firsts.select("fp"), radius))
    joined = firsts.join(groups, firsts.fp == groups.node, "left").groupBy(F.coalesce("component", "fp").alias("component")).agg(F.min("first").alias("first"))
    kept = joined.select(F.col("first.d").alias("__d"), F.col("first.rid").alias("__rid"))
    return marked(docs).join(kept, ["__d", "__rid"], "left_semi").dropDuplicates(["__d", "__rid"]).select(docs.columns)
