"""Passages that repeat across documents, wherever they stand: winnowed blocks, one MinHash band, exact Jaccard, components.

A paragraph is too coarse a unit for a passage that stands inside a longer one or runs over several. So every text is also
cut into overlapping blocks of `BLOCK` words, whose starts its own words choose: a block begins at each five-word shingle
whose hash is the least of some `REACH` shingles in a row. Any `REACH + BLOCK - 1` equal words hold a whole block, and the
same one in every document, so no such passage is missed, however it is placed.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from proofline.llm.common import SPACES, blocks, cut, cut_table, keyed, mix, powers, small, span_hashes, spans_of
from proofline.llm.components import components
from proofline.llm.paragraph_dedup import CELL_ROWS, SHINGLE, SIMILARITY, duplicates, lower_bytes, verified

BLOCK, REACH = 24, 24  # every 47 equal words in a row hold a block
TAIL = BLOCK + REACH + SHINGLE  # words that a piece of a long text takes over from the one before
BANDS, ROWS = 11, 3  # of paragraphs: a pair at 0.8 collides with probability 1 - (1 - 0.8**3)**11 = 0.9996
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_ODD, _TOP = np.uint64(0xD1342543DE82EF95), ~np.uint64(0)
_INV = np.uint64(pow(0xD1342543DE82EF95, -1, 1 << 64))


def _least(x: np.ndarray, width: int, take=np.minimum) -> np.ndarray:
    """take over x[i : i + width] for every i, by doubling; runs over the end are cut short."""
    out, have = x.copy(), 1
    while have < width:
        step = min(have, width - have)
        out[:-step] = take(out[:-step], out[step:])
        have += step
    return out


def starts(word: np.ndarray, part: np.ndarray, offset: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(positions in word of block starts, shingle hash at every position) of hashed words that belong to parts in order,
    of which each begins at word `offset` of its text."""
    n = len(word)
    with np.errstate(over="ignore"):
        h = np.zeros(n, np.uint64)
        for k in range(SHINGLE):
            h[: n - k] += mix(word[k:] + _C[k]) * _C[k]
        h = mix(h)
    first = np.searchsorted(part, part, "left")
    last = np.searchsorted(part, part, "right")
    at = np.arange(n)
    # Around parts stand REACH positions that no window takes, so each part is judged on its own.
    place = at + (part + 1) * REACH
    padded = np.full(n + (int(part[-1]) + 2) * REACH, _TOP, np.uint64)
    inside = at + SHINGLE <= last
    padded[place[inside]] = h[inside]
    low = _least(padded, REACH)
    best = _least(low[::-1], REACH, np.maximum)[::-1][place]
    fresh = np.concatenate(([True], h[1:] != h[:-1]))[:n] | ((at - first + offset[part]) % 16 == 0)  # a run of one word is no chain of blocks
    return np.flatnonzero(inside & (best == h) & fresh & (at + BLOCK <= last)), h


def winnowed(texts: list[str | None]):
    """Runs of (row, first word, id of the block's words, band key, its shingle hashes as a matrix) over whole texts."""
    tail: dict[int, tuple[np.ndarray, int]] = {}
    for rows, parts, _ in blocks(texts):
        part, start, end, data, _ = spans_of(parts, SPACES)
        word = span_hashes(lower_bytes(data), start, end)
        offset = np.zeros(len(rows), np.int64)
        for k, r in enumerate(rows.tolist()):
            if r in tail:  # a text that came in pieces goes on: the words before come along
                before, seen = tail.pop(r)
                i = int(np.searchsorted(part, k))
                word, part, offset[k] = np.insert(word, i, before), np.insert(part, i, np.full(len(before), k)), seen - len(before)
        if len(rows) == 1:
            tail[int(rows[0])] = (word[-TAIL:], int(offset[0]) + len(word))
        if len(word) < BLOCK:
            continue
        at, h = starts(word, part, offset)
        if not len(at):
            continue
        with np.errstate(over="ignore"):
            total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(mix(word) * powers(_ODD, len(word)))))
            whole = mix((total[at + BLOCK] - total[at]) * powers(_INV, len(word) + 1)[at])
            other = _least(mix(h ^ _C[3]), BLOCK - SHINGLE + 1)[at]
            key = mix(h[at] * _C[0] + other * _C[1])
        first = np.searchsorted(part, part[at], "left")
        yield rows[part[at]], at - first + offset[part[at]], whole, key, h, at


def _emit(docs: DataFrame) -> DataFrame:
    """(key, id, d, rid, start) of every block of docs (d, rid, text)."""

    def run(batches):
        for b in batches:
            d, rid = b.column("d").to_numpy(), b.column("rid").to_numpy()
            for row, start, whole, key, _, _ in winnowed(b.column("text").to_pylist()):
                yield pa.RecordBatch.from_arrays([pa.array(key.view(np.int64)), pa.array(whole.view(np.int64)), pa.array(d[row]), pa.array(rid[row]), pa.array(start.astype(np.int32))], ["key", "id", "d", "rid", "start"])

    return docs.select("d", "rid", "text").mapInArrow(run, "key long, id long, d long, rid long, start int")


def _sets(docs: DataFrame) -> DataFrame:
    """(id, shingles as bytes) of the blocks that start at `starts` of docs (text, starts)."""

    def run(batches):
        for b in batches:
            wanted = [set(x) for x in b.column("starts").to_pylist()]
            for row, start, whole, _, h, at in winnowed(b.column("text").to_pylist()):
                keep = [k for k, (r, s) in enumerate(zip(row.tolist(), start.tolist())) if s in wanted[r]]
                if keep:
                    sets = [np.unique(h[at[k] : at[k] + BLOCK - SHINGLE + 1]).tobytes() for k in keep]
                    yield pa.RecordBatch.from_arrays([pa.array(whole[keep].view(np.int64)), pa.array(sets, pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles binary")


def passages(docs: DataFrame, similarity: float = SIMILARITY, cell_rows: int = CELL_ROWS) -> DataFrame:
    """Maximal runs of words that stand in another document too: doc_id, start (word, from 0), n_words, keep_doc_id, keep_start, removed.

    Two blocks are alike if the sets of their five-word shingles (white-space words, A-Z in lower case) have a Jaccard
    similarity of `similarity` or more; classes are the components of that relation among blocks that share a band of two
    MinHash values: where the block begins, and the least of its shingles in another order. Equal blocks always do. A class
    in one document only is none. The first document of a class by doc_id keeps it, in the others it is removed; a run's
    keep_* is the first place that any of its blocks has. Null, empty and blank texts, and those of under 24 words, have no block; a null doc_id counts as the
    least. Rows that repeat doc_id and text are one document. An empty table gives none; other columns are not read.
    """
    base = keyed(docs).select("d", "rid", "text")
    found = cut_table(_emit(base))
    repeated = cut(found.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1").select("key"))
    met = cut_table(found.join(small(repeated, F.lit(16)), "key", "left_semi"))
    doc = F.struct("d", "rid")
    classes = cut(met.groupBy("key", "id").agg(F.min(F.struct("d", "start", "rid")).alias("first"), F.min(doc).alias("one"), F.max(doc).alias("other")))
    several = classes.groupBy("key").agg(F.count("*").alias("n")).filter("n > 1")
    meeting = cut(classes.join(several, "key").select("id", "key", "n", "first"))
    places = cut(meeting.groupBy("first.d", "first.rid").agg(F.collect_set("first.start").alias("starts")))
    sets = cut_table(_sets(base.join(small(places, 32 + 4 * F.size("starts")), ["d", "rid"]).select("text", "starts")))
    groups = components(verified(meeting.select("id", "key", "n"), sets, similarity, cell_rows))
    own = classes.join(groups, F.col("id") == F.col("node"), "left").select("key", "id", "first", "one", "other", F.coalesce("component", "id").alias("component"))
    heads = own.groupBy("component").agg(F.min("first").alias("first"), F.min("one").alias("one"), F.max("other").alias("other")).filter("one <> other").select("component", "first")
    wanted = cut(own.join(heads.withColumnRenamed("first", "keep"), "component").select("key", "id", "keep"))
    blocks_of = met.join(wanted, ["key", "id"]).select("d", "rid", "start", "keep").groupBy("d", "rid", "start").agg(F.min("keep").alias("keep"))
    over = Window.partitionBy("d", "rid").orderBy("start")
    ran = blocks_of.withColumn("new", F.when(F.col("start") <= F.lag("start").over(over) + BLOCK, 0).otherwise(1)).withColumn("run", F.sum("new").over(over))
    gone = (F.col("d") != F.col("keep.d")) | (F.col("rid") != F.col("keep.rid"))
    out = ran.groupBy("d", "rid", "run").agg(F.min("start").alias("start"), (F.max("start") - F.min("start") + BLOCK).alias("n_words"), F.min("keep").alias("keep"), F.bool_or(gone).alias("removed"))
    undo = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c))
    return out.select(undo("d").alias("doc_id"), "start", "n_words", undo("keep.d").alias("keep_doc_id"), F.col("keep.start").alias("keep_start"), "removed")


def substrings(docs: DataFrame, least: int, similarity: float = SIMILARITY) -> DataFrame:
    """Paragraphs of at least `least` words that have a like one, and passages that stand in several documents: doc_id, kind,
    place, n_words, keep_doc_id, keep_place, removed.

    kind `paragraph`: a row of duplicates(), place is its line. kind `passage`: a row of passages(), place is its first word.
    """
    lines = duplicates(docs, least, similarity, bands=BANDS, rows=ROWS).select("doc_id", F.lit("paragraph").alias("kind"), F.col("line").alias("place"), "n_words", "keep_doc_id", F.col("keep_line").alias("keep_place"), "removed")
    runs = passages(docs, similarity).select("doc_id", F.lit("passage").alias("kind"), F.col("start").alias("place"), "n_words", "keep_doc_id", F.col("keep_start").alias("keep_place"), "removed")
    return lines.union(runs)
