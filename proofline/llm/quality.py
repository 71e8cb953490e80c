"""Quality classifier: ordinal cumulative-link regression on graded ratings over hashed text."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from proofline.llm.common import SPACES, blocks, labelled, span_hashes, spans_of

BITS = 15
SAMPLE_ROWS = 1_200  # rated documents of each grade that a fit may hold
ROUNDS, RATE, RIDGE = 150, 0.1, 1e-6
TAIL = 0.5
PRIOR = 30  # features that a text has besides its own, of no weight: few words say little


@dataclass(frozen=True)
class Model:
    """P(grade > k) = logistic(eta - thresholds[k]): one eta for all grades, thresholds in order."""

    weights: np.ndarray
    thresholds: np.ndarray
    grades: np.ndarray


def buckets(texts: list[str | None], bits: int = BITS):
    """Blocks of (row, bucket) of each feature: a token as it stands, its last three bytes, and its shape by case and sign."""
    for rows, parts, _ in blocks(texts):
        part, start, end, data, _ = spans_of(parts, SPACES)
        if not len(start):
            continue
        shift = np.uint64(64 - bits)
        word = span_hashes(data, start, end) >> shift
        tail = span_hashes(data, np.maximum(start, end - 3), end)
        kinds = np.select([(data >= 65) & (data <= 90), (data >= 97) | (data >= 128), (data >= 48) & (data <= 57)], [1, 2, 3], 4).astype(np.uint64)
        a, b, c = kinds[start], kinds[np.minimum(start + 1, end - 1)], kinds[end - 1]
        shape = (a * np.uint64(25) + b * np.uint64(5) + c + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        again = np.zeros(len(start), bool)  # a token that stands right after itself
        again[1:] = (word[1:] == word[:-1]) & (part[1:] == part[:-1])
        shape = np.where(again, np.uint64(0x5851F42D4C957F2D), shape)
        tail = (tail ^ np.uint64(0xA5A5A5A5A5A5A5A5)) * np.uint64(0xD6E8FEB86659FD93)
        yield rows[np.tile(part, 3)].astype(np.int32), np.concatenate((word, tail >> shift, shape >> shift)).astype(np.int32)


def _eta(weights: np.ndarray, texts: list[str | None]) -> np.ndarray:
    total, n = np.zeros(len(texts)), np.zeros(len(texts))
    for row, bucket in buckets(texts, int(np.log2(len(weights)))):
        total += np.bincount(row, weights[bucket], len(texts))
        n += np.bincount(row, minlength=len(texts))
    return 3 * total / (n + PRIOR)


def fit(texts: list[str | None], ratings: list[int], shares: list[float] | None = None, bits: int = BITS) -> Model:
    """Adam on the likelihood of a proportional-odds model. With fewer than two grades, every text gets the one there is."""
    grades = np.unique(ratings)
    if len(grades) < 2:
        return Model(np.zeros(1 << bits, np.float32), np.zeros(0), grades.astype(float) if len(grades) else np.zeros(1))
    y = np.searchsorted(grades, ratings)
    part = np.ones(len(y)) if shares is None else np.array(shares, float)
    part = part / part.sum()
    parts = list(buckets(texts, bits))
    row, bucket = (np.concatenate([p[i] for p in parts] + [np.zeros(0, np.int64)]) for i in (0, 1))
    share = 3 / (np.bincount(row, minlength=len(y)) + PRIOR)
    w, k = np.zeros(1 << bits), len(grades) - 1
    above = np.array([part[y > j].sum() for j in range(k)])
    theta = -np.log((above + 1e-3) / (1 - above + 1e-3))
    p = np.concatenate((theta[:1], np.log(np.maximum(np.diff(theta), 1e-3))))  # a threshold, and logs of the steps between
    m, v, mp, vp = np.zeros_like(w), np.zeros_like(w), np.zeros_like(p), np.zeros_like(p)
    for t in range(1, ROUNDS + 1):
        theta = np.cumsum(np.concatenate((p[:1], np.exp(p[1:]))))
        eta = share * np.bincount(row, w[bucket], len(y))
        up = 1 / (1 + np.exp(-(eta[:, None] - theta)))
        tails = np.concatenate((np.ones((len(y), 1)), up, np.zeros((len(y), 1))), axis=1)
        mass = np.maximum(tails[np.arange(len(y)), y] - tails[np.arange(len(y)), y + 1], 1e-9)
        slope = up * (1 - up)
        # d log P(y) / d tail: + at the threshold below the grade, - at the one above it
        sign = (y[:, None] - 1 == np.arange(k)).astype(float) - (y[:, None] == np.arange(k))
        g = -sign * slope / mass[:, None] * part[:, None]
        gw = np.bincount(bucket, (g.sum(axis=1) * share)[row], len(w)) + RIDGE * w
        gt = -g.sum(axis=0)
        gp = np.concatenate((gt.sum()[None], np.cumsum(gt[::-1])[::-1][1:] * np.exp(p[1:])))
        scale = np.sqrt(1 - 0.999**t) / (1 - 0.9**t)
        m, v = 0.9 * m + 0.1 * gw, 0.999 * v + 0.001 * gw**2
        mp, vp = 0.9 * mp + 0.1 * gp, 0.999 * vp + 0.001 * gp**2
        w -= RATE * scale * m / (np.sqrt(v) + 1e-9)
        p -= RATE * scale * mp / (np.sqrt(vp) + 1e-9)
    return Model(w.astype(np.float32), np.cumsum(np.concatenate((p[:1], np.exp(p[1:])))), grades.astype(float))


def train(docs: DataFrame, labels: DataFrame, column: str = "quality", limit: int = SAMPLE_ROWS) -> Model:
    """Fit on at most `limit` documents of each grade; the grades are the values of the column."""
    rows = sorted(labelled(docs, labels, column, limit).collect(), key=lambda r: r.doc_id)
    return fit([r.text for r in rows], [r.y for r in rows], [r.share for r in rows])


def grade_texts(model: Model, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """(expected grade, probability of more than the lowest grade) of each text; a text without words has eta 0."""
    up = 1 / (1 + np.exp(-(_eta(model.weights, texts)[:, None] - model.thresholds)))
    expected = model.grades[0] + (up * np.diff(model.grades)).sum(axis=1)
    return expected, up[:, 0] if len(model.thresholds) else np.ones(len(texts))


def grade(docs: DataFrame, model: Model, tail: float = TAIL) -> DataFrame:
    """One row per document: doc_id, expected_grade, tail_probability (of more than the lowest grade), keep.

    Null, empty and blank texts are judged by the thresholds alone. Long texts are read whole; repeated rows and null ids
    are each graded; an empty table gives none. No other column is read.
    """
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    def run(batches):
        for b in batches:
            expected, up = grade_texts(Model(**shared.value), b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(expected), pa.array(up)], ["doc_id", "expected_grade", "tail_probability"])

    out = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(run, "doc_id long, expected_grade double, tail_probability double")
    return out.withColumn("keep", F.col("tail_probability") >= tail)


def select(docs: DataFrame, model: Model, tail: float = TAIL) -> DataFrame:
    """The rows of docs that grade() keeps, with all their columns."""
    shared = docs.sparkSession.sparkContext.broadcast(vars(model))

    @F.pandas_udf("double")
    def probability(text: pd.Series) -> pd.Series:
        return pd.Series(grade_texts(Model(**shared.value), [None if t is None else t for t in text])[1])

    return docs.filter(probability(F.col("text").cast("string")) >= tail)
