"""Exact substring dedup over a sparse suffix array.

A byte is removed when a string of WINDOW bytes that covers it also starts earlier. Sorting every suffix of a corpus with
WINDOW bytes of context would shuffle a hundred times the input, so only anchored suffixes are sorted: each window has one
anchor, the position of its smallest GRAM hash (leftmost), which depends on the window's bytes alone. Equal windows have
equal anchors, so a window repeats only where the gram at its anchor repeats, and everything else is left out by one count.

The suffixes at repeated anchors are dealt into ranges by sampled splitters, sorted in their range by multikey quicksort,
and compared: those that share enough bytes to the right (a run in suffix order) and to the left (a run in the order of
reversed prefixes) hold the same window. A window whose run may reach over a splitter is settled between ranges by one row
per range. Hot strings cost one row for each batch and distinct context before the shuffle.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right

import numpy as np
import pandas as pd
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window, functions as F

from proofline.llm.common import _INV, _ODD, cut, cut_table, keyed, marked, mix, powers

WINDOW, GRAM = 100, 32
RANGE_ROWS = 100_000  # suffixes that are solved at once
LEAST_ROWS = 2_000  # suffixes that a range is worth
MAX_RANGES = 65_536  # splitters that a broadcast may hold; beyond it ranges grow and each is solved in runs of RANGE_ROWS
SAMPLE, SAMPLE_ROWS = 64, 262_144  # sampled suffixes for each splitter, and in all
PIECE = 1_000_000


def anchors(data: bytes, window: int = WINDOW, gram: int = GRAM) -> tuple[np.ndarray, ...]:
    """(position, bytes before it, bytes from it on, gram hash) of the anchors of one run of bytes; the bytes are those of all windows that it stands for."""
    parts: list[list] = []
    for s in range(0, max(1, len(data) - window + 1), PIECE):
        piece = np.frombuffer(data[s : s + PIECE + window - 1], np.uint8)
        if len(piece) < window:
            break
        p, back, fore, h = _anchors(piece, np.ones(len(piece) - window + 1, bool), window, gram)
        p = p + s
        if parts and parts[-1][0][-1] == p[0]:  # its windows go on in this piece
            parts[-1][2][-1] = fore[0]
            p, back, fore, h = p[1:], back[1:], fore[1:], h[1:]
        if len(p):
            parts.append([p, back, fore, h])
    return tuple(np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)


def _anchors(piece: np.ndarray, inside: np.ndarray, window: int, gram: int) -> tuple[np.ndarray, ...]:
    with np.errstate(over="ignore"):
        total = np.zeros(len(piece) + 1, np.uint64)
        np.cumsum((piece.astype(np.uint64) + np.uint64(1)) * powers(_ODD, len(piece)), out=total[1:])
        h = mix((total[gram:] - total[:-gram]) * powers(_INV, len(piece) + 1 - gram))
    low, where, span, width = h, np.arange(len(h), dtype=np.int32), 1, window - gram + 1
    while span < width:
        step = min(span, width - span)
        keep = low[:-step] <= low[step:]
        low, where = np.where(keep, low[:-step], low[step:]), np.where(keep, where[:-step], where[step:])
        span += step
    starts = np.flatnonzero(inside)
    if not len(starts):
        return (np.zeros(0, np.int64),) * 3 + (np.zeros(0, np.uint64),)
    own = where[starts]
    first = np.flatnonzero(np.concatenate(([True], own[1:] != own[:-1])))  # the windows of one anchor follow each other
    last = np.concatenate((first[1:], [len(own)])) - 1
    p = own[first].astype(np.int64)
    return p, p - starts[first], starts[last] + window - p, h[p]


def _batch_anchors(batches, window: int, gram: int):
    """Anchors of every row, as (k, place, h, spread): place holds the position and the bytes on both sides.

    spread is 0 for a gram that a batch has once; of several, one has -1 and the others have various numbers.
    """
    for b in batches:
        rids, texts = b.column("k").to_numpy(), b.column("text").to_pylist()
        rid, pos, h = [], [], []
        rows, held, size = [], [], 0

        def flush():
            if not rows:
                return
            piece = np.frombuffer(b"".join(held), np.uint8)
            ends = np.cumsum([len(x) for x in held])
            inside = np.ones(len(piece) - window + 1, bool)
            for e in ends[:-1].tolist():
                inside[e - window + 1 : e] = False
            p, back, fore, g = _anchors(piece, inside, window, gram)
            k = np.searchsorted(ends, p, "right")
            rid.append(rids[np.array(rows)[k]])
            pos.append((p - np.concatenate(([0], ends[:-1]))[k] << 16) | (back << 8) | fore)
            h.append(g)

        for i, text in enumerate(texts):
            raw = (text or "").encode("utf-8", "replace")
            if len(raw) < window:
                continue
            if len(raw) > PIECE:
                p, back, fore, g = anchors(raw, window, gram)
                rid.append(np.full(len(p), rids[i]))
                pos.append((p << 16) | (back << 8) | fore)
                h.append(g)
                continue
            rows.append(i)
            held.append(raw)
            size += len(raw)
            if size > PIECE:
                flush()
                rows, held, size = [], [], 0
        flush()
        if not h:
            continue
        h, rid, pos = np.concatenate(h), np.concatenate(rid), np.concatenate(pos)
        order = np.argsort(h, kind="stable")
        again = np.zeros(len(h), bool)
        again[order[1:]] = h[order[1:]] == h[order[:-1]]
        spread = np.where(again, (np.arange(len(h)) % 4093) + 1, 0).astype(np.int32)
        spread[order[:-1][(h[order[1:]] == h[order[:-1]]) & ~again[order[:-1]]]] = -1
        for s in range(0, len(h), 100_000):
            e = slice(s, s + 100_000)
            yield pa.RecordBatch.from_arrays([pa.array(rid[e]), pa.array(pos[e]), pa.array(h[e].view(np.int64)), pa.array(spread[e])], ["k", "place", "h", "spread"])


def _packed(batches):
    """Texts compressed for the shuffle."""
    for b in batches:
        z = zstandard.ZstdCompressor(level=1)
        texts = b.column("text")
        yield pa.RecordBatch.from_arrays([*(b.column(c) for c in ("d", "rid", "k")), pa.array([z.compress((texts[i].as_py() or "").encode("utf-8", "replace")) for i in range(b.num_rows)], pa.binary())], ["d", "rid", "k", "z"])


def _order(doc_id, rid, pos) -> np.ndarray:
    return np.lexsort((pos, rid, doc_id))


def _contexts(batches, window: int, gram: int, splitters: list):
    """The bytes around each repeated anchor and the range they belong to; those that equal an earlier one of the batch are settled at once."""
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        rows: list = []
        settled: list = []
        seen: set = set()
        docs = sorted(zip(b.column("d").to_pylist(), b.column("rid").to_pylist(), range(b.num_rows)))
        packs, places = b.column("z"), b.column("places")
        for d, r, i in docs:
            raw = unpack.decompress(packs[i].as_py())
            for place in sorted(set(places[i].as_py())):
                p, before, fore = place >> 16, place >> 8 & 255, place & 255
                back, ahead = raw[max(0, p - before) : p][::-1], raw[p : p + fore]
                if (ahead, back) in seen:
                    if len(back) + len(ahead) >= window:
                        settled.append((d, r, p - len(back), p + len(ahead)))
                    continue
                seen.add((ahead, back))
                rows.append((bisect_right(splitters, (ahead, d, r, p)), d, r, p, ahead, back))
            if len(rows) + len(settled) > 20_000:
                yield _context_batch(rows, settled)
                rows, settled = [], []
        yield _context_batch(rows, settled)


def _context_batch(x: list, y: list) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays(
        [pa.array([*(t[0] for t in x), *([None] * len(y))], pa.int32()), pa.array([*(t[1] for t in x), *(t[0] for t in y)], pa.int64()), pa.array([*(t[2] for t in x), *(t[1] for t in y)], pa.int64()),
         pa.array([*(t[3] for t in x), *(t[2] for t in y)], pa.int32()), pa.array([*([None] * len(x)), *(t[3] for t in y)], pa.int32()),
         pa.array([*(t[4] for t in x), *([None] * len(y))], pa.binary()), pa.array([*(t[5] for t in x), *([None] * len(y))], pa.binary())],
        ["bucket", "d", "rid", "pos", "stop", "ahead", "back"],
    )


def words_of(strings: list[bytes], width: int) -> np.ndarray:
    """Strings as rows of big-endian 64-bit words, the length last: rows order as the strings do."""
    cells = -(-width // 8) * 8
    raw = b"".join(x.ljust(cells, b"\0") for x in strings)
    words = np.frombuffer(raw, ">u8").reshape(len(strings), cells // 8).astype(np.uint64)
    return np.concatenate((words, np.array([[len(x)] for x in strings], np.uint64).reshape(-1, 1)), axis=1)


def multikey_quicksort(words: np.ndarray, small: int = 1024) -> np.ndarray:
    """Order of rows of words: three-way partitions on one word at a time; equal parts go on with the next word."""
    order = np.arange(len(words))
    stack = [(0, len(words), 0)]
    while stack:
        lo, hi, d = stack.pop()
        if hi - lo < 2 or d == words.shape[1]:
            continue
        part = order[lo:hi]
        if hi - lo <= small:
            order[lo:hi] = part[np.lexsort(words[part, d:].T[::-1])]
            continue
        key = words[part, d]
        pivot = np.sort(key[:: max(1, len(key) // 31)])[len(key[:: max(1, len(key) // 31)]) // 2]
        less, same = key < pivot, key == pivot
        a, e = int(less.sum()), int(same.sum())
        order[lo:hi] = np.concatenate((part[less], part[same], part[~(less | same)]))
        stack += [(lo, lo + a, d), (lo + a, lo + a + e, d + 1), (lo + a + e, hi, d)]
    return order


def _shared(words: np.ndarray, order: np.ndarray) -> np.ndarray:
    """Bytes that each row of the order shares with the row before it; the first: -1."""
    raw = words[:, :-1].astype(">u8").view(np.uint8)
    out = np.full(len(order), -1, np.int64)
    for s in range(1, len(order), 50_000):
        i, j = order[s - 1 : s + 49_999][: len(order[s : s + 50_000])], order[s : s + 50_000]
        differ = raw[i] != raw[j]
        first = np.where(differ.any(axis=1), differ.argmax(axis=1), raw.shape[1])
        out[s : s + 50_000] = np.minimum(first, np.minimum(words[i, -1], words[j, -1]).astype(np.int64))
    return out


def _common(a: bytes, b: bytes) -> int:
    n = min(len(a), len(b))
    return next((i for i in range(n) if a[i] != b[i]), n)


def repeats(doc_id, rid, pos, ahead: list[bytes], back: list[bytes], edges: list[bytes], window: int, gram: int):
    """In one range: (rid, start, stop) that repeat, and (row, start) of first windows that another range may hold too."""
    order = _order(doc_id, rid, pos)
    doc_id, rid, pos = doc_id[order], rid[order], pos[order]
    ahead, back = [ahead[i] for i in order], [back[i] for i in order]
    m, left = len(pos), window - gram
    a, b = words_of(ahead, window), words_of(back, left)
    right_order, left_order = multikey_quicksort(a), multikey_quicksort(b)
    right_shared, left_shared = _shared(a, right_order), _shared(b, left_order)
    right_len, left_len = a[:, -1].astype(np.int64), b[:, -1].astype(np.int64)
    reach = np.zeros(m, np.int64)
    for e in edges:
        near = [i for i in range(m) if ahead[i][:gram] == e[:gram]]
        for i in near:
            reach[i] = max(reach[i], _common(ahead[i], e))
    most, least = np.full(m, -1, np.int64), np.full(m, window, np.int64)
    run_r, run_l = np.empty(m, np.int64), np.empty(m, np.int64)
    open_rows, open_starts = [], []
    for o in range(left + 1):
        run_r[right_order] = np.cumsum(right_shared < window - o)
        run_l[left_order] = np.cumsum(left_shared < o)
        held = np.flatnonzero((left_len >= o) & (right_len >= window - o))
        if not len(held):
            continue
        crowd = np.bincount(run_r[held], minlength=m + 2)
        lone = held[(crowd[run_r[held]] < 2) & (reach[held] >= window - o)]
        held = held[crowd[run_r[held]] > 1]
        key = run_r[held] * (m + 2) + run_l[held]
        _, first = np.unique(key, return_index=True)
        later = np.ones(len(held), bool)
        later[first] = False
        i = held[later]
        most[i] = np.maximum(most[i], o)
        least[i] = np.minimum(least[i], o)
        i = np.concatenate((held[~later][reach[held[~later]] >= window - o], lone))
        open_rows.append(i)
        open_starts.append(pos[i] - o)
    hit = np.flatnonzero(most >= 0)
    rows, starts = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (open_rows, open_starts))
    digests = [hashlib.blake2b((back[i][:: -1] + ahead[i])[len(back[i]) + s - pos[i] :][:window], digest_size=16).digest() for i, s in zip(rows.tolist(), starts.tolist())]
    return (doc_id[hit], rid[hit], pos[hit] - most[hit], pos[hit] - least[hit] + window), (doc_id[rows], rid[rows], starts, digests)


def _range(batches, splitters: list, window: int, gram: int, range_rows: int):
    """One range, as Arrow batches that come together; a large one in runs, which meet at edges as ranges do."""
    parts = [b for b in batches if b.num_rows]
    if not parts:
        return
    t = pa.Table.from_batches(parts)
    k = t.column("bucket")[0].as_py()
    low, high = splitters[k - 1][0] if k else None, splitters[k][0] if k < len(splitters) else None
    if t.num_rows <= 2 * range_rows:
        yield _solved(t, [e for e in (low, high) if e is not None], window, gram)
        return
    t = t.sort_by([(c, "ascending") for c in ("ahead", "d", "rid", "pos")])
    for s in range(0, t.num_rows, range_rows):
        e = s + range_rows
        edges = (low if s == 0 else t.column("ahead")[s].as_py(), high if e >= t.num_rows else t.column("ahead")[e].as_py())
        yield _solved(t.slice(s, range_rows), [x for x in edges if x is not None], window, gram)


def _solved(t: pa.Table, edges: list[bytes], window: int, gram: int) -> pa.RecordBatch:
    num = lambda c: t.column(c).to_numpy().astype(np.int64)
    (d0, rid, start, stop), (d, r, s, digest) = repeats(num("d"), num("rid"), num("pos"), t.column("ahead").to_pylist(), t.column("back").to_pylist(), edges, window, gram)
    n, m = len(rid), len(r)
    return pa.RecordBatch.from_arrays(
        [pa.array(np.concatenate((d0, d))), pa.array(np.concatenate((rid, r))), pa.array(np.concatenate((start, s)).astype(np.int32)), pa.array(np.concatenate((stop, s + window)).astype(np.int32)), pa.array([None] * n + digest, pa.binary())],
        ["d", "rid", "start", "stop", "digest"],
    )


def repeated_spans(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, range_rows: int = RANGE_ROWS) -> DataFrame:
    """(rid, d, start, stop) of docs (rid, d, k, text): byte ranges covered by windows that also start earlier; ranges may overlap."""
    spark = docs.sparkSession
    n = int(spark.conf.get("spark.sql.shuffle.partitions"))
    found = docs.select("k", "text").mapInArrow(lambda it: _batch_anchors(it, window, gram), "k long, place long, h long, spread int")
    counted = found.withColumn("n", F.count("*").over(Window.partitionBy("h", F.greatest("spread", F.lit(0))))).filter("spread <> 0 or n > 1")
    places = cut_table(counted.groupBy("k").agg(F.collect_set("place").alias("places")))
    total = places.agg(F.sum(F.size("places"))).first()[0] or 0
    # As many ranges as tasks, if each has enough rows, so that none waits for one that has many.
    ranges = min(MAX_RANGES, max(1, -(-total // range_rows), min(n, total // LEAST_ROWS)))
    packed = docs.select("d", "rid", "k", "text").mapInArrow(_packed, "d long, rid long, k long, z binary")
    splitters: list = []
    if ranges > 1:
        size = min(ranges * SAMPLE, SAMPLE_ROWS)
        some = places.select("k", F.explode("places").alias("p")).filter(F.pmod(F.xxhash64("k", "p"), F.lit(1 << 30)) < int(min(1.0, size / total) * (1 << 30)))
        # SAMPLE_ROWS places, give or take, so the broadcast and the driver's list have a bound
        some = cut(some.groupBy("k").agg(F.collect_list("p").alias("places")))
        sampled = packed.join(F.broadcast(some), "k").select("d", "rid", "z", "places").mapInArrow(lambda it: _contexts(it, window, gram, []), _CONTEXT)
        got = sorted((bytes(r.ahead), r.d, r.rid, r.pos) for r in sampled.filter("ahead is not null").select("ahead", "d", "rid", "pos").collect())
        splitters = [got[i * len(got) // ranges] for i in range(1, ranges)] if got else []
    shared = spark.sparkContext.broadcast(splitters)
    once = packed.join(places, "k").groupBy("k", "rid", "d").agg(F.first("z").alias("z"), F.first("places").alias("places"))
    around = once.mapInArrow(lambda it: _contexts(it, window, gram, shared.value), _CONTEXT)
    dealt = around.withColumn("dealt", F.coalesce(F.col("bucket"), -F.pmod(F.col("rid"), F.lit(997)).cast("int") - 1))
    solved = dealt.repartition(max(n, min(ranges, 4 * n)), "dealt").sortWithinPartitions("dealt").mapInArrow(lambda it: _ranges(it, shared.value, window, gram, range_rows), "d long, rid long, start int, stop int, digest binary")
    solved = cut_table(solved)
    first = F.min(F.struct("d", "rid", "start")).over(Window.partitionBy("digest"))
    crossing = solved.filter("digest is not null").distinct().withColumn("first", first).filter("first.d <> d or first.rid <> rid or first.start <> start")
    return solved.filter("digest is null").select("rid", "d", "start", "stop").union(crossing.select("rid", "d", "start", "stop"))


_CONTEXT = "bucket int, d long, rid long, pos int, stop int, ahead binary, back binary"


def _ranges(batches, splitters, window: int, gram: int, range_rows: int):
    """Rows sorted by range: each range is solved once its rows are complete; settled rows pass through."""
    held: list = []

    def flush():
        yield from _range(held, splitters, window, gram, range_rows)

    for b in batches:
        if not b.num_rows:
            continue
        dealt = b.column("dealt").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(dealt)) + 1).tolist(), len(dealt)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            part = b.slice(s, e - s)
            if dealt[s] < 0:
                k = e - s
                yield pa.RecordBatch.from_arrays([part.column("d"), part.column("rid"), part.column("pos"), part.column("stop"), pa.nulls(k, pa.binary())], ["d", "rid", "start", "stop", "digest"])
                continue
            if held and held[0].column("bucket")[0].as_py() != int(dealt[s]):
                yield from flush()
                held = []
            held.append(part)
    yield from flush()


def _cleaned(batches):
    unpack = zstandard.ZstdDecompressor()
    for b in batches:
        out: list[list] = [[], [], [], []]
        packs, spans = b.column("z"), b.column("spans")
        for i in range(b.num_rows):
            raw = unpack.decompress(packs[i].as_py())
            kept, removed, runs, end = hashlib.sha256(), 0, 0, 0
            merged: list[list[int]] = []
            for s in sorted((x["start"], x["stop"]) for x in spans[i].as_py() or ()):
                if merged and s[0] <= merged[-1][1]:
                    merged[-1][1] = max(merged[-1][1], s[1])
                else:
                    merged.append([*s])
            for s, e in merged:
                kept.update(raw[end:s])
                removed, runs, end = removed + e - s, runs + 1, e
            kept.update(raw[end:])
            for k, v in enumerate((len(raw), removed, runs, kept.hexdigest())):
                out[k].append(v)
        yield pa.RecordBatch.from_arrays([b.column("d"), *(pa.array(x, pa.int64()) for x in out[:3]), pa.array(out[3], pa.string())], ["d", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def removal_report(docs: DataFrame, window: int = WINDOW, gram: int = GRAM, range_rows: int = RANGE_ROWS) -> DataFrame:
    """One row per document: doc_id, n_bytes, n_removed, n_spans (maximal removed runs), kept_sha256.

    "Earlier" is by doc_id (null first), then by a hash of the row for rows that share a doc_id, then by start. Null and
    empty texts have no bytes; texts shorter than the window keep all of them. Rows that repeat both doc_id and text are
    one document, and each is returned with its result. An empty table gives none; other columns are not read.
    """
    rows = _rows(docs)
    spans = repeated_spans(rows, window, gram, range_rows).groupBy("rid", "d").agg(F.collect_list(F.struct("start", "stop")).alias("spans"))
    packed = rows.select("d", "rid", "k", "text").mapInArrow(_packed, "d long, rid long, k long, z binary")
    out = packed.join(spans, ["rid", "d"], "left").select("d", "z", "spans").mapInArrow(_cleaned, "d long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
    return out.select(F.when(F.col("d") != -(1 << 63), F.col("d")).alias("doc_id"), "n_bytes", "n_removed", "n_spans", "kept_sha256")


def _rows(docs: DataFrame) -> DataFrame:
    """(doc_id, d, rid, text, k): k names a document to the anchors, by doc_id, which compresses well, where there is one. Documents that share k share extra places to compare, no more."""
    return keyed(docs).withColumn("k", F.coalesce("doc_id", "rid"))


def remove_repeats(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """docs with `text` less its repeated bytes; a character cut in part goes whole. All other columns stay."""
    spans = repeated_spans(_rows(docs), window).groupBy("rid", "d").agg(F.collect_list(F.struct("start", "stop")).alias("__spans"))

    @F.pandas_udf("string")
    def kept(text: pd.Series, spans: pd.Series) -> pd.Series:
        def one(t, s):
            if s is None or not len(s):
                return t
            raw = (t or "").encode("utf-8", "replace")
            keep = np.ones(len(raw), bool)
            for x in s:
                keep[x["start"] : x["stop"]] = False
            return np.frombuffer(raw, np.uint8)[keep].tobytes().decode("utf-8", "ignore")

        return pd.Series([one(t, s) for t, s in zip(text, spans)])

    joined = marked(docs).join(spans.withColumnsRenamed({"rid": "__rid", "d": "__d"}), ["__rid", "__d"], "left")
    return joined.withColumn("text", kept("text", "__spans")).select(docs.columns)
