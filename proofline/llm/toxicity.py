"""Toxicity by multiple-instance learning: sentence scores, combined by noisy-or, learnt from document labels."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from proofline.llm.common import NO_WORD, blocks, byte_set, labelled, mix, span_hashes, spans_of

BITS = 18
SAMPLE_ROWS = 1_500  # labelled documents of each label that a fit may hold
LEAST_DOCS = 3  # documents of the sample that a feature must be in
ROUNDS, RATE, RIDGE = 150, 0.1, 1e-5
LEAST_WEIGHT, LAST_ROUNDS = 0.7, 120  # features below that weight are dropped, and the rest fitted anew
THRESHOLD = 0.7
STEMS = (4, 5, 6)  # bytes
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_STOP = byte_set(lambda b: b in b".!?\n")


@dataclass(frozen=True)
class Model:
    """A document is toxic if any sentence is: 1 - prod(1 - p), with p the logistic of bias plus the features' weights.

    Features are words and their first bytes, by a 64-bit hash: its upper bits name a cell, its lower 32 are compared with
    the cell's tag, so that words never seen do not share a weight.
    """

    weights: np.ndarray
    tags: np.ndarray
    bias: float


def instances(texts: list[str | None]):
    """Blocks of (row of each sentence, sentence of each feature, hash of each feature, byte span of each sentence)."""
    for rows, parts, offsets in blocks(texts):
        part, start, end, data, begins = spans_of(parts, NO_WORD)
        if not len(start):
            continue
        low = _LOWER[data]
        h = np.concatenate([span_hashes(low, start, end), *(span_hashes(low, start, np.minimum(end, start + n)) ^ np.uint64(n * 0x9E3779B97F4A7C15 % (1 << 64)) for n in STEMS)])
        stops = np.cumsum(_STOP[data])
        _, first, sentence = np.unique(stops[start], return_index=True, return_inverse=True)
        last = np.concatenate((first[1:], [len(start)])) - 1
        shift = (offsets - begins)[part[first]]
        yield rows[part[first]], np.tile(sentence, 1 + len(STEMS)), h, start[first] + shift, end[last] + shift


def _softplus(z: np.ndarray) -> np.ndarray:
    return np.maximum(z, 0) + np.log1p(np.exp(-np.abs(z)))


def _logits(model: Model, n: int, sentence: np.ndarray, h: np.ndarray) -> np.ndarray:
    """Of each of n sentences; a feature counts once however often it stands in the sentence."""
    cell = (h >> np.uint64(64 - BITS)).astype(np.int64)
    hit = np.flatnonzero((model.tags[cell] == h.astype(np.uint32)) & (model.weights[cell] != 0))
    one = np.unique((sentence[hit].astype(np.int64) << BITS) | cell[hit])
    return model.bias + np.bincount(one >> BITS, model.weights[one & ((1 << BITS) - 1)], n)


def fit(texts: list[str | None], toxic: list[int], shares: list[float] | None = None) -> Model:
    """Adam on the noisy-or likelihood, rows weighted by shares. Without both labels the score is the share of toxic texts."""
    y, n = np.array(toxic, bool), len(toxic)
    mass = np.ones(n) if shares is None else np.array(shares, float)
    mass = mass / max(mass.sum(), 1e-9)
    none = np.zeros(1 << BITS, np.float32), np.zeros(1 << BITS, np.uint32)
    if n == 0 or y.all() or not y.any():
        rate = (y.sum() + 0.5) / (n + 1)
        return Model(*none, float(np.log(rate / (1 - rate))))
    seen = []
    for row, sentence, h, _, _ in instances(texts):
        _, one = np.unique(mix(h ^ (row[sentence].astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))), return_index=True)
        seen.append(h[one])
    known, docs = np.unique(np.concatenate(seen), return_counts=True)
    del seen
    known = known[docs >= LEAST_DOCS]
    parts, base = [], 0
    for row, sentence, h, _, _ in instances(texts):
        at = np.minimum(np.searchsorted(known, h), max(len(known) - 1, 0))
        hit = known[at] == h if len(known) else np.zeros(len(h), bool)
        one = np.unique(sentence[hit] * (len(known) + 1) + at[hit])
        parts.append((row, one // (len(known) + 1) + base, one % (len(known) + 1)))
        base += len(row)
    row, sentence, feature = (np.concatenate(x) for x in zip(*parts))
    w, b = np.zeros(len(known)), -5.0

    def improve(w: np.ndarray, b: float, feature: np.ndarray, sentence: np.ndarray, rounds: int) -> tuple[np.ndarray, float]:
        m, v, mb, vb = np.zeros_like(w), np.zeros_like(w), 0.0, 0.0
        for t in range(1, rounds + 1):
            z = b + np.bincount(sentence, w[feature], base)
            total = np.maximum(np.bincount(row, _softplus(z), n), 1e-9)
            slope = np.where(y, -1 / np.expm1(np.minimum(total, 700)), 1.0) * mass
            g = slope[row] / (1 + np.exp(-np.clip(z, -50, 50)))
            gw, gb = np.bincount(feature, g[sentence], len(w)) + RIDGE * w, g.sum()
            m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
            mb, vb = 0.9 * mb + 0.1 * gb, 0.999 * vb + 0.001 * gb**2
            scale = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
            w = w - RATE * scale * m / (np.sqrt(v) + 1e-5)
            b = b - RATE * scale * mb / (np.sqrt(vb) + 1e-5)
        return w, b

    w, b = improve(w, b, feature, sentence, ROUNDS)
    order = np.lexsort((known, -np.abs(w)))
    _, one = np.unique(known[order] >> np.uint64(64 - BITS), return_index=True)  # of features of one cell the heaviest
    heavy = np.zeros(len(known), bool)
    heavy[order[one]] = np.abs(w[order[one]]) >= LEAST_WEIGHT
    kept = heavy[feature]
    known, w, feature, sentence = known[heavy], w[heavy], (np.cumsum(heavy) - 1)[feature[kept]], sentence[kept]
    w, b = improve(w, b, feature, sentence, LAST_ROUNDS)
    weights, tags = none
    cell = (known >> np.uint64(64 - BITS)).astype(np.int64)
    weights[cell], tags[cell] = w.astype(np.float32), known.astype(np.uint32)
    return Model(weights, tags, float(b))


def train(docs: DataFrame, labels: DataFrame, limit: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `limit` documents of each label whose crc32(doc_id as text) leaves no remainder 1 by 3."""
    own = labels.filter(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 != 1)
    rows = sorted(labelled(docs, own, "toxic", limit).collect(), key=lambda r: r.doc_id)
    return fit([r.text for r in rows], [r.y for r in rows], [r.share for r in rows])


def score_texts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(score of each text, byte span of its worst sentence or -1); a text without words scores as one empty sentence."""
    n = len(texts)
    mass, worst, at, to = np.zeros(n), np.full(n, -np.inf), np.full(n, -1), np.full(n, -1)
    for row, sentence, h, start, end in instances(texts):
        z = _logits(model, len(row), sentence, h)
        mass += np.bincount(row, _softplus(z), n)
        order = np.lexsort((-start, z, row))
        top = order[np.concatenate((row[order][1:] != row[order][:-1], [True]))]
        top = top[z[top] > worst[row[top]]]
        worst[row[top]], at[row[top]], to[row[top]] = z[top], start[top], end[top]
    mass[at < 0] = _softplus(np.array(model.bias))
    return -np.expm1(-mass), at, to


def score(docs: DataFrame, model: Model, threshold: float = THRESHOLD) -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted, and the byte span [worst_start, worst_stop) of its worst sentence.

    Null, empty and word-free texts score as one empty sentence, with no span. Long texts are read whole. Repeated rows are
    each scored; a null doc_id is not held out. An empty table gives none; no other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        for b in batches:
            p, at, to = score_texts(Model(**shared.value), b.column("text").to_pylist())
            none = at < 0
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(p), pa.array(at, pa.int64(), mask=none), pa.array(to, pa.int64(), mask=none)], ["doc_id", "score", "worst_start", "worst_stop"])

    scored = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, score double, worst_start long, worst_stop long")
    held = F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1, F.lit(False))
    return scored.select("doc_id", held.alias("held_out"), "score", (F.col("score") >= threshold).cast("int").alias("predicted"), "worst_start", "worst_stop")


def sentences(docs: DataFrame, model: Model, least: float = 0.5) -> DataFrame:
    """(doc_id, start, stop, score): every sentence, as a byte span, that alone scores at least `least`."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        for b in batches:
            ids, held = b.column("doc_id"), Model(**shared.value)
            for row, sentence, h, start, end in instances(b.column("text").to_pylist()):
                p = 1 / (1 + np.exp(-_logits(held, len(row), sentence, h)))
                k = p >= least
                yield pa.RecordBatch.from_arrays([ids.take(pa.array(row[k])), pa.array(start[k]), pa.array(end[k]), pa.array(p[k])], ["doc_id", "start", "stop", "score"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, start long, stop long, score double")
