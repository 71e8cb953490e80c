"""Near-duplicate paragraphs: MinHash bands for candidates, exact Jaccard over word shingles, components for removals."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from proofline.llm.common import SPACES, blocks, cut, cut_table, keyed, mix, span_hashes, spans_of
from proofline.llm.components import components

SHINGLE, SIMILARITY = 5, 0.8
BANDS, ROWS = 16, 4  # a pair at 0.8 collides with probability 1 - (1 - 0.8**4)**16 = 0.9998
LEAST_WORDS = 20  # the default of duplicates(); shorter paragraphs stay
CELL_ROWS = 2048
PIECE_BYTES = 500_000
BROADCAST_LINES = 300_000  # of documents to read again; beyond it they are joined by a shuffle
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_C = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xFF51AFD7ED558CCD], np.uint64)
_SEEDS = np.random.default_rng(42).integers(1, 1 << 63, (2, BANDS * ROWS), dtype=np.int64).astype(np.uint64) | np.uint64(1)


def shingled(texts: list[str | None], least: int):
    """Blocks of (row, line, words, id of the whole, shingle hashes, start of each paragraph's shingles) of paragraphs of at least so many words."""
    carried: dict[int, int] = {}
    for rows, parts, _ in _line_blocks(texts):
        part, start, end, data, begins = spans_of(parts, SPACES)
        if not len(start):
            for r, p in zip(rows.tolist(), parts):
                carried[r] = carried.get(r, 0) + p.count(b"\n")
            continue
        word = span_hashes(_LOWER[data], start, end)
        breaks = np.concatenate(([0], np.cumsum(data == 10)))
        first_break = breaks[begins]
        line = breaks[start] - first_break[part] + np.array([carried.get(r, 0) for r in rows.tolist()])[part]
        for r, p in zip(rows.tolist(), parts):
            carried[r] = carried.get(r, 0) + p.count(b"\n")
        edge = np.flatnonzero(np.concatenate(([True], (line[1:] != line[:-1]) | (part[1:] != part[:-1]))))
        size = np.diff(np.concatenate((edge, [len(word)])))
        keep = size >= max(least, 1)
        edge, size = edge[keep], size[keep]
        if not len(edge):
            continue
        n = np.maximum(size - SHINGLE + 1, 1)
        offsets = np.concatenate(([0], np.cumsum(n)))
        at = np.repeat(edge - offsets[:-1], n) + np.arange(offsets[-1])
        with np.errstate(over="ignore"):
            h = np.zeros(len(at), np.uint64)
            stop = np.repeat(edge + size, n)
            for k in range(SHINGLE):
                i = at + k
                h += np.where(i < stop, mix(word[np.minimum(i, len(word) - 1)] + _C[k]) * _C[k], np.uint64(0))
            h = mix(h)
            place = (np.arange(offsets[-1]) - np.repeat(offsets[:-1], n)).astype(np.uint64)
            whole = mix(np.add.reduceat(mix(h + place * _C[1]), offsets[:-1]) + size.astype(np.uint64))
        yield rows[part[edge]], line[edge], size, whole, h, offsets


def _line_blocks(texts):
    """As blocks(), but texts are only cut behind a line: no paragraph is in two pieces, and only a single giant one is a large piece."""
    long = {i for i, t in enumerate(texts) if t is not None and len(t) > PIECE_BYTES}
    yield from blocks([None if i in long else t for i, t in enumerate(texts)], 2 * PIECE_BYTES)
    for i in long:
        raw, at = texts[i].encode("utf-8", "replace"), 0
        while at < len(raw):
            end = raw.find(b"\n", at + PIECE_BYTES) + 1 or len(raw)
            yield np.array([i]), [raw[at:end]], np.array([at])
            at = end


def lower_bytes(data: np.ndarray) -> np.ndarray:
    return _LOWER[data]


def signatures(h: np.ndarray, offsets: np.ndarray, bands: int = BANDS, rows: int = ROWS) -> np.ndarray:
    """A key for each band of each paragraph."""
    out = np.empty((len(offsets) - 1, bands), np.uint64)
    with np.errstate(over="ignore"):
        for b in range(bands):
            key = np.full(len(offsets) - 1, b + 1, np.uint64)
            for k in range(b * rows, (b + 1) * rows):
                x = h * _SEEDS[0, k] + _SEEDS[1, k]
                key = mix(key * _C[0] + np.minimum.reduceat(x ^ (x >> np.uint64(32)), offsets[:-1]))
            out[:, b] = key
    return out


def bands_of(words: np.ndarray, similarity: float, bands: int = BANDS) -> np.ndarray:
    """Bands that a paragraph of so many words needs, so that none it is like is missed for want of the others.

    Under SHINGLE words its one shingle is that of equal paragraphs only, which have one id: no band. Sets of n shingles
    whose n / (n + 1) is under the similarity are like equal sets only, which share every band: the first.
    """
    n = words - SHINGLE + 1
    return np.where(n < 1, 0, np.where(n < similarity * (n + 1) - 1e-9, 1, bands))


def paragraphs(docs: DataFrame, least: int = LEAST_WORDS, similarity: float = SIMILARITY, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """(d, rid, line, n_words, id, bands) of docs (d, rid, text)."""

    def run(batches):
        for b in batches:
            d, rid, texts = b.column("d").to_numpy(), b.column("rid").to_numpy(), b.column("text").to_pylist()
            for row, line, size, whole, h, offsets in shingled(texts, least):
                keys = signatures(h, offsets, bands, rows).view(np.int64)
                need = bands_of(size, similarity, bands)
                held = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(need))).astype(np.int32)), pa.array(keys[np.arange(bands) < need[:, None]]))
                yield pa.RecordBatch.from_arrays([pa.array(d[row]), pa.array(rid[row]), pa.array(line.astype(np.int32)), pa.array(size.astype(np.int32)), pa.array(whole.view(np.int64)), held], ["d", "rid", "line", "n_words", "id", "bands"])

    return docs.select("d", "rid", "text").mapInArrow(run, "d long, rid long, line int, n_words int, id long, bands array<long>")


def _sets(docs: DataFrame) -> DataFrame:
    """(id, shingles as bytes) of the paragraphs at `lines` of docs (d, rid, text, lines)."""

    def run(batches):
        for b in batches:
            texts, lines = b.column("text").to_pylist(), b.column("lines").to_pylist()
            wanted = [set(x) for x in lines]
            for row, line, _, whole, h, offsets in shingled(texts, 1):
                keep = [k for k, (r, x) in enumerate(zip(row.tolist(), line.tolist())) if x in wanted[r]]
                if keep:
                    yield pa.RecordBatch.from_arrays([pa.array(whole[keep].view(np.int64)), pa.array([np.unique(h[offsets[k] : offsets[k + 1]]).tobytes() for k in keep], pa.binary())], ["id", "shingles"])

    return docs.mapInArrow(run, "id long, shingles binary")


def linked(sets: list[np.ndarray], sides: np.ndarray, similarity: float) -> list[tuple[int, int]]:
    """Links (positions) that join everything that pairs of at least this Jaccard similarity join.

    Each member is compared with those not yet reached, all at once, so a group of copies costs one pass.
    """
    size = np.array([len(s) for s in sets])
    flat, owner = np.concatenate(sets), np.repeat(np.arange(len(sets)), size)
    out, free = [], np.ones(len(sets), bool)
    for seed in range(len(sets)):
        if not free[seed]:
            continue
        free[seed] = False
        front = [seed]
        live, who = flat[free[owner]], owner[free[owner]]
        while front and len(live):
            i = front.pop()
            s = sets[i]
            at = np.minimum(np.searchsorted(s, live), len(s) - 1)
            shared = np.bincount(who[s[at] == live], minlength=len(sets))
            new = np.flatnonzero(free & (shared >= similarity * (size[i] + size - shared)) & (shared > 0) & ((sides != sides[i]) | (sides == 2)))
            if len(new):
                free[new] = False
                out += [(i, int(j)) for j in new]
                front += new.tolist()
                keep = free[who]
                live, who = live[keep], who[keep]
    return out


def _verified(batches, similarity: float):
    """Rows come sorted by cell, then id."""
    held: list = []

    def solve(rows):
        ids, sets, sides = [], [], []
        for i, s, w in rows:
            if not ids or ids[-1] != i or sides[-1] != w:
                ids.append(i)
                sets.append(np.frombuffer(s, np.uint64))
                sides.append(w)
        pairs = linked(sets, np.array(sides), similarity) if len(ids) > 1 else []
        return [(ids[a], ids[b]) for a, b in pairs]

    links: list = []
    cell = None
    for b in batches:
        for c, i, s, w in zip(*(b.column(k).to_pylist() for k in ("cell", "id", "shingles", "side"))):
            if c != cell and held:
                links += solve(held)
                held = []
            cell = c
            held.append((i, s, w))
        if len(links) > 10_000:
            yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])
            links = []
    links += solve(held) if held else []
    yield pa.RecordBatch.from_arrays([pa.array([x[0] for x in links], pa.int64()), pa.array([x[1] for x in links], pa.int64())], ["u", "v"])


def verified(meeting: DataFrame, sets: DataFrame, similarity: float, cell_rows: int) -> DataFrame:
    """(u, v) links among the ids of meeting (id, key, n ids of that key), by the exact similarity of their sets (id, shingles)."""
    rows = meeting.withColumn("blocks", F.ceil(F.col("n") / cell_rows).cast("int")).withColumn("own", F.pmod(F.xxhash64("id", F.lit(3)), "blocks").cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    cells = rows.select("id", F.xxhash64("key", F.least("own", "other"), F.greatest("own", "other")).alias("cell"), F.when(F.col("own") == F.col("other"), 2).when(F.col("own") < F.col("other"), 0).otherwise(1).cast("int").alias("side"))
    n = int(meeting.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = cells.join(sets.dropDuplicates(["id"]), "id").repartition(n, "cell").sortWithinPartitions("cell", "id")
    return dealt.mapInArrow(lambda it: _verified(it, similarity), "u long, v long")


def duplicates(docs: DataFrame, least: int = LEAST_WORDS, similarity: float = SIMILARITY, cell_rows: int = CELL_ROWS, bands: int = BANDS, rows: int = ROWS) -> DataFrame:
    """Every paragraph (line) that has a duplicate: doc_id, line (from 0), n_words, keep_doc_id, keep_line, removed.

    Paragraphs of at least `least` words are alike if the sets of their five-word shingles (white-space words, A-Z in lower
    case) have a Jaccard similarity of `similarity` or more; classes are the components of that relation. The first of a
    class by doc_id, then line stays, the others are removed. Candidates share one of 16 bands of four MinHash values. Equal
    paragraphs are one candidate, and a bucket of over cell_rows different ones is dealt into blocks that are compared in
    pairs. A paragraph of under five words is one shingle. Null and empty texts have no paragraph; a null doc_id counts as the least. Rows that repeat doc_id
    and text are one document. An empty table gives none; other columns are not read.
    """
    base = keyed(docs).select("d", "rid", "text")
    found = cut_table(paragraphs(base, least, similarity, bands, rows))
    classes = found.groupBy("id").agg(F.min(F.struct("d", "line", "rid")).alias("first"), F.first("bands").alias("bands"))
    keys = classes.select("id", F.explode("bands").alias("key"))
    over = Window.partitionBy("key")
    meeting = cut(keys.withColumn("n", F.count("*").over(over)).filter("n > 1"))
    places = classes.select("id", "first").join(meeting.select("id").distinct(), "id", "left_semi")
    places = cut(places.groupBy("first.d", "first.rid").agg(F.collect_set("first.line").alias("lines")))
    few = (places.agg(F.sum(F.size("lines") + 2)).first()[0] or 0) <= BROADCAST_LINES
    sets = cut_table(_sets(base.join(F.broadcast(places) if few else places, ["d", "rid"]).select("text", "lines")))
    groups = components(verified(meeting, sets, similarity, cell_rows))
    own = classes.select("id", F.struct("first.d", "first.line").alias("first")).join(groups, F.col("id") == F.col("node"), "left").select("id", "first", F.coalesce("component", "id").alias("component"))
    counted = found.groupBy("id").agg(F.countDistinct("d", "rid", "line").alias("n"))
    heads = own.join(counted, "id").groupBy("component").agg(F.min("first").alias("keep"), F.sum("n").alias("n")).filter("n > 1")
    wanted = own.join(heads, "component").select("id", "keep")
    undo = lambda c: F.when(F.col(c) != -(1 << 63), F.col(c))
    out = found.select("id", "d", "line", "n_words").join(wanted, "id")
    return out.select(undo("d").alias("doc_id"), "line", "n_words", undo("keep.d").alias("keep_doc_id"), F.col("keep.line").alias("keep_line"), ((F.col("d") != F.col("keep.d")) | (F.col("line") != F.col("keep.line"))).alias("removed"))
