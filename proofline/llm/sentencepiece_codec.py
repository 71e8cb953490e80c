"""SentencePiece encoding and decoding of whole texts, giant ones by a max-plus scan over chunks.

The model at hand merges byte pairs. Its result is the one sequence of pieces in which each two neighbours, merged on their
own, stay as they are: a merge over the border of two pieces would take place in the pair just as in the whole text, since
merges follow score and place alone. So encoding is a path through a lattice of pieces whose steps have weight 0 or minus
infinity; piece counts are added as -1, so that the best weight also tells the number of pieces. A chunk's paths from each
state at its left border to each state at its right border form a transfer matrix over (max, +). Matrices are combined
associatively, which fixes the state at every border, and every chunk is traced back on its own. No text is cut before it is
encoded: a state is a piece that reaches up to or over the border.
"""

from __future__ import annotations

import zlib

import numpy as np
import pandas as pd
import pyarrow as pa
import sentencepiece
from pyspark.sql import DataFrame, SparkSession, functions as F

from proofline.llm.common import keyed

MODEL = "/opt/tokenizers/piece_bpe_32k.model"
CHUNK = 65_536  # characters; longer texts are encoded in chunks
SPACE = "▁"


class Lattice:
    """Pieces of a model, and which of them may follow each other."""

    def __init__(self, proto: bytes):
        self.sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        plain = [i for i in range(self.sp.vocab_size()) if not (self.sp.is_control(i) or self.sp.is_unknown(i) or self.sp.is_byte(i) or self.sp.is_unused(i))]
        self.ids = {self.sp.id_to_piece(i): i for i in plain}
        self.scores = {self.sp.id_to_piece(i): self.sp.get_score(i) for i in plain}
        self.width = max(map(len, self.ids), default=1)
        self.heads = {p[:k] for p in self.ids for k in range(2, len(p) + 1)}  # what a longer piece can begin with
        self.known: dict[tuple[str, str], bool] = {}

    def merged(self, text: str) -> list[str]:
        """Pieces of a short text: the best merge first, of equal ones the leftmost."""
        parts = list(text)
        while True:
            best = max(((self.scores[a + b], -i) for i, (a, b) in enumerate(zip(parts, parts[1:])) if a + b in self.scores), default=None)
            if best is None:
                return parts
            i = -best[1]
            parts[i : i + 2] = [parts[i] + parts[i + 1]]

    def follows(self, a: str, b: str) -> bool:
        got = self.known.get((a, b))
        if got is None:
            if len(self.known) > 250_000:
                self.known.clear()
            got = self.known[a, b] = self.merged(a + b) == [a, b]
        return got

    def pieces_at(self, text: str, i: int) -> list[int]:
        """Ends of the pieces of text that begin at i; a single character is always one."""
        out = [i + 1]
        for j in range(i + 2, min(len(text), i + self.width) + 1):
            head = text[i:j]
            if head not in self.heads:
                break
            if head in self.ids:
                out.append(j)
        return out

    def numbers(self, piece: str) -> list[int]:
        i = self.ids.get(piece)
        return [i] if i is not None else [self.sp.piece_to_id(f"<0x{b:02X}>") for b in piece.encode("utf-8")]

    def borders(self, text: str, at: int) -> list[tuple[int, int]]:
        """States at a border: pieces that begin before it and end at it or after it; at 0, the start of the text."""
        if at <= 0:
            return [(0, 0)]
        return [(i, j) for i in range(max(0, at - self.width), at) for j in self.pieces_at(text, i) if j >= at]

    def paths(self, text: str, start: int, stop: int, states: list[tuple[int, int]]) -> dict[tuple[int, int], np.ndarray]:
        """Best weight from each state at start to every piece that begins before stop and that a path reaches."""
        minus = np.full(len(states), -np.inf)
        by_end: dict[int, dict[tuple[int, int], np.ndarray]] = {}
        out: dict[tuple[int, int], np.ndarray] = {}
        for k, s in enumerate(states):
            w = minus.copy()
            w[k] = 0.0
            by_end.setdefault(s[1], {})[s] = w
            if s[1] >= stop:
                out[s] = w
        for i in range(start, stop):
            before = by_end.pop(i, None)
            if not before:
                continue
            for j in self.pieces_at(text, i):
                best = None
                for p, w in before.items():
                    if p[1] == p[0] or self.follows(text[p[0] : p[1]], text[i:j]):
                        best = w - 1 if best is None else np.maximum(best, w - 1)
                if best is not None:
                    by_end.setdefault(j, {})[i, j] = best
                    if j >= stop:
                        out[i, j] = best
        return out

    def transfer(self, text: str, start: int, stop: int) -> np.ndarray:
        """Matrix of best weights between the states at start and at stop."""
        a, b = self.borders(text, start), self.borders(text, stop)
        got = self.paths(text, start, stop, a)
        return np.stack([got.get(s, np.full(len(a), -np.inf)) for s in b], axis=1) if b else np.zeros((len(a), 0))

    def trace(self, text: str, start: int, stop: int, enter: tuple[int, int], leave: tuple[int, int]) -> list[str]:
        """The pieces after enter up to leave."""
        back: dict[tuple[int, int], tuple[int, int] | None] = {enter: None}
        by_end = {enter[1]: [enter]}
        for i in range(start, stop):
            for j in self.pieces_at(text, i) if i in by_end else ():
                for p in by_end[i]:
                    if p[1] == p[0] or self.follows(text[p[0] : p[1]], text[i:j]):
                        back[i, j] = p
                        by_end.setdefault(j, []).append((i, j))
                        break
            by_end.pop(i, None)
        out, at = [], leave
        while at != enter:
            out.append(text[at[0] : at[1]])
            at = back[at]
        return out[::-1]


def combine(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Product over (max, +)."""
    return (a[:, :, None] + b[None, :, :]).max(axis=1)


def border_states(matrices: list[np.ndarray]) -> list[int]:
    """State at the right border of each chunk: the one on the path of the whole text."""
    ahead = [matrices[0]]
    for m in matrices[1:]:
        ahead.append(combine(ahead[-1], m))
    behind = [np.zeros((matrices[-1].shape[1], 1))]
    for m in matrices[:0:-1]:
        behind.append(combine(m, behind[-1]))
    # The last border is the end of the text, where only a piece that ends there remains.
    return [int(np.argmax(a[0] + b[:, 0])) for a, b in zip(ahead, behind[::-1])]


def escaped(text: str) -> str:
    """As the model reads it: a leading space, and every space as its mark."""
    return SPACE + text.replace(" ", SPACE) if text else ""


def chunk_edges(n: int, chunk: int) -> list[int]:
    return [*range(0, n, chunk), n] if n else [0, 0]


def scan_encode(lattice: Lattice, text: str, chunk: int = CHUNK) -> list[int]:
    """ids of a text, chunk by chunk: what encode() spreads over tasks."""
    whole = escaped(text)
    if not whole:
        return []
    edges = chunk_edges(len(whole), chunk)
    spans = list(zip(edges, edges[1:]))
    at = border_states([lattice.transfer(whole, s, e) for s, e in spans])
    states = [(0, 0)] + [lattice.borders(whole, e)[k] for (_, e), k in zip(spans, at)]
    return [n for (s, e), a, b in zip(spans, states, states[1:]) for piece in lattice.trace(whole, s, e, a, b) for n in lattice.numbers(piece)]


def model_bytes(path: str = MODEL) -> bytes:
    with open(path, "rb") as f:
        return f.read()


def encode(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK, checked: bool = False) -> DataFrame:
    """(doc_id, d, rid, ids): the ids of every text as the model's own library gives them.

    Texts of up to `chunk` characters are encoded in place. Longer ones are cut into chunk rows; their transfer matrices are
    combined for each text (a few hundred numbers for each chunk), and each chunk is traced back in a task of its own. A
    null text has null ids, an empty one none. checked: with text_crc32, the checksum of the text that the ids decode to. Rows that repeat doc_id and text each come out; an empty table gives none.
    """
    spark: SparkSession = docs.sparkSession
    proto = model_bytes(model)  # the driver reads the file, functions carry it
    rows = keyed(docs)

    def plain(batches):
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        for b in batches:
            texts = b.column("text").to_pylist()
            for s in range(0, len(texts), 200):
                part = texts[s : s + 200]
                ids = sp.encode([t or "" for t in part], num_threads=1)
                flat = np.fromiter((i for x in ids for i in x), np.int32, sum(map(len, ids)))
                offsets = np.concatenate(([0], np.cumsum([len(x) for x in ids]))).astype(np.int32)
                lists = pa.ListArray.from_arrays(pa.array(offsets), pa.array(flat), mask=pa.array([t is None for t in part]))
                sums = pa.array([zlib.crc32(t.encode("utf-8")) for t in sp.decode(ids)] if checked else [None] * len(part), pa.int64())
                yield pa.RecordBatch.from_arrays([*(b.column(c).slice(s, len(part)) for c in ("doc_id", "d", "rid")), lists, sums], ["doc_id", "d", "rid", "ids", "text_crc32"])

    small = rows.filter(F.col("text").isNull() | (F.length("text") <= chunk)).mapInArrow(plain, "doc_id long, d long, rid long, ids array<int>, text_crc32 long")
    giant = rows.filter(F.length("text") > chunk)
    width = Lattice(proto).width
    whole = F.concat(F.lit(SPACE), F.translate("text", " ", SPACE))
    cut = giant.select("d", "rid", whole.alias("whole")).distinct().withColumn("n", F.length("whole"))
    cut = cut.withColumn("start", F.explode(F.sequence(F.lit(0), F.col("n") - 1, F.lit(chunk)))).withColumn("stop", F.least(F.col("start") + chunk, "n"))
    left = F.greatest(F.lit(0), F.col("start") - width)
    pieces = cut.select("d", "rid", "n", "start", "stop", left.alias("left"), F.col("whole").substr(left + 1, F.col("stop") - left + width).alias("part"))
    tasks = int(spark.conf.get("spark.sql.shuffle.partitions"))  # by number: a chunk is few bytes and much work
    pieces = pieces.repartition(tasks, "d", "rid", "start")

    def matrices(batches):
        lattice = Lattice(proto)
        for pdf in batches:
            out = [lattice.transfer(r.part, r.start - r.left, r.stop - r.left) for r in pdf.itertuples()]
            yield pd.DataFrame({"d": pdf.d, "rid": pdf.rid, "start": pdf.start, "rows": [m.shape[0] for m in out], "matrix": [m.ravel().tolist() for m in out]})

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values("start").drop_duplicates("start")
        at = border_states([np.array(m, float).reshape(n, -1) for m, n in zip(pdf.matrix, pdf["rows"])])
        return pd.DataFrame({"d": pdf.d, "rid": pdf.rid, "start": pdf.start, "enter": [0, *at[:-1]], "leave": at})

    def traced(batches):
        lattice = Lattice(proto)
        for pdf in batches:
            out = []
            for r in pdf.itertuples():
                s, e = r.start - r.left, r.stop - r.left
                a, b = lattice.borders(r.part, s)[r.enter], lattice.borders(r.part, e)[r.leave]
                out.append([n for p in lattice.trace(r.part, s, e, a, b) for n in lattice.numbers(p)])
            yield pd.DataFrame({"d": pdf.d, "rid": pdf.rid, "start": pdf.start, "ids": out})

    transfer = pieces.mapInPandas(matrices, "d long, rid long, start int, rows int, matrix array<double>")
    states = transfer.groupBy("d", "rid").applyInPandas(settle, "d long, rid long, start int, enter int, leave int")
    done = pieces.join(states, ["d", "rid", "start"]).repartition(tasks, "d", "rid", "start").mapInPandas(traced, "d long, rid long, start int, ids array<int>")
    joined = done.groupBy("d", "rid").agg(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("start", "ids"))), lambda x: x["ids"])).alias("ids"))
    large = giant.select("doc_id", "d", "rid").join(joined, ["d", "rid"]).select("doc_id", "d", "rid", "ids")
    if not checked:
        return small.drop("text_crc32").union(large)
    decoded = decode(large, model).withColumn("text_crc32", F.crc32(F.col("text").cast("binary"))).drop("text")
    return small.union(decoded)


def decode(encoded: DataFrame, model: str = MODEL, column: str = "ids") -> DataFrame:
    """encoded with `text`, the decoded ids; null ids give a null text. A U+2581 of the text comes back as a space."""
    proto = model_bytes(model)

    @F.pandas_udf("string")
    def text(ids: pd.Series) -> pd.Series:
        sp = sentencepiece.SentencePieceProcessor(model_proto=proto)
        return pd.Series([None if x is None else sp.decode(x.tolist()) for x in ids])

    return encoded.withColumn("text", text(column))


def token_report(docs: DataFrame, model: str = MODEL, chunk: int = CHUNK) -> DataFrame:
    """One row per document: doc_id, n_tokens, ids, text_crc32 (of the text that the ids decode to)."""
    out = encode(docs, model, chunk, checked=True)
    return out.select("doc_id", F.coalesce(F.size("ids"), F.lit(0)).cast("long").alias("n_tokens"), "ids", "text_crc32")
