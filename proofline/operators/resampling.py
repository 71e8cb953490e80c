"""Bootstrap over items of any number: every item has a Poisson weight in every resample, drawn from a digest of its id.

Weights follow from the id and not from a place or a generator, so a lost task draws the same ones again, and any engine
can. Rows are dealt by ranges of the score; a task gives its totals for each resample and what stands inside its range, and
the ranges are put together over a few rows for each task. No row reaches the driver, and no number of scores is too great.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

PER_DIGEST = 16  # resamples that one digest serves, with 16 bits each
#: Of 65,536: weights of less than 1, 2, ... of a Poisson distribution of mean 1.
CUTS = [int(65536 * sum(math.exp(-1) / math.factorial(j) for j in range(k + 1))) for k in range(8)]
ROWS = 2048  # whose weights are held at once
SEGMENT = "low double, high double, single boolean, p array<long>, n array<long>, a array<double>"


def weights(ids: list[str], resamples: int, seed: int) -> np.ndarray:
    """A row for each id, a column for each resample."""
    blocks = [f"{seed}\0{b}\0".encode() for b in range(-(-resamples // PER_DIGEST))]
    raw = b"".join(hashlib.sha256(b + i.encode()).digest() for i in ids for b in blocks)
    return np.searchsorted(CUTS, np.frombuffer(raw, ">u2").reshape(len(ids), -1)[:, :resamples], "right").astype(np.int64)


def _groups(batches: Iterator[pa.RecordBatch], resamples: int, seed: int):
    """(score, weights of errors, of others) of each score of rows that come sorted by it."""
    score, p, n = None, None, None
    for b in batches:
        for s in range(0, b.num_rows, ROWS):
            part = b.slice(s, ROWS)
            w = weights(part.column("item_id").to_pylist(), resamples, seed)
            x, bad = part.column("score").to_numpy(), np.array(part.column("error").to_pylist(), bool)[:, None]
            edge = np.flatnonzero(np.concatenate(([True], x[1:] != x[:-1])))
            ps, ns = np.add.reduceat(w * bad, edge, axis=0), np.add.reduceat(w * ~bad, edge, axis=0)
            for k, at in enumerate(edge.tolist()):
                if score is not None and x[at] == score:
                    p, n = p + ps[k], n + ns[k]
                    continue
                if score is not None:
                    yield score, p, n
                score, p, n = x[at], ps[k], ns[k]
    if score is not None:
        yield score, p, n


def _segments(batches, resamples: int, seed: int):
    """The first score of a task, the last, and all between as one: only the outer two can stand in another task too."""
    out: list = []
    inner, held = None, None
    for score, p, n in _groups(batches, resamples, seed):
        if not out:
            out.append((score, score, True, p, n, np.zeros(resamples)))
            continue
        if held is not None:
            s, hp, hn = held
            low, _, _, ip, in_, ia = inner or (s, s, False, 0 * hp, 0 * hn, np.zeros(resamples))
            inner = (low, s, False, ip + hp, in_ + hn, ia + hp * (in_ + hn / 2))
        held = (score, p, n)
    out += [inner] if inner else []
    out += [(held[0], held[0], True, held[1], held[2], np.zeros(resamples))] if held is not None else []
    if out:
        cols = list(zip(*out))
        yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.float64()), pa.array(cols[1], pa.float64()), pa.array(cols[2]), *(pa.array([x.tolist() for x in c], pa.list_(t)) for c, t in zip(cols[3:], (pa.int64(), pa.int64(), pa.float64())))], ["low", "high", "single", "p", "n", "a"])


def _segmented(scored: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(low, high, single, r, p, n, a): for each resample r the weights of errors and others in each range of the score, and
    a, the pairs inside it in which the error stands higher, ties by half. A score that fills many tasks is one range.
    """
    n = int(scored.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    rows = scored.filter("score IS NOT NULL AND item_id IS NOT NULL").select("item_id", F.col("score").cast("double").alias("score"), "error")
    dealt = rows.repartitionByRange(n, "score", F.xxhash64("item_id")).sortWithinPartitions("score")
    parts = dealt.mapInArrow(lambda it: _segments(it, resamples, seed), SEGMENT)
    flat = parts.select("low", "high", "single", F.posexplode(F.arrays_zip("p", "n", "a")).alias("r", "x"))
    g = flat.groupBy("low", "high", "single", "r").agg(F.sum("x.p").alias("p"), F.sum("x.n").alias("n"), F.sum("x.a").alias("a"))
    return g.withColumn("a", F.when(F.col("single"), F.col("p") * F.col("n") / 2).otherwise(F.col("a")))


def _before(order: Column, of: str) -> Column:
    return F.coalesce(F.sum(of).over(Window.partitionBy("r").orderBy(order).rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))


def auc_draws(scored: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(r, value): the area under the curve of each resample of scored (item_id, score, error) that has both kinds."""
    s = _segmented(scored, resamples, seed).withColumn("below", _before(F.col("low").asc(), "n"))
    g = s.groupBy("r").agg(F.sum(F.col("a") + F.col("p") * F.col("below")).alias("pairs"), F.sum("p").alias("p"), F.sum("n").alias("n"))
    return g.filter("p > 0 AND n > 0").select("r", (F.col("pairs") / (F.col("p") * F.col("n"))).alias("value"))


def recall_draws(scored: DataFrame, budget: float, resamples: int, seed: int) -> DataFrame:
    """(r, value): of each resample the share of errors among the first round(budget * weight), ties at the cut in part.

    Ranges above the cut count whole. The one range in which a resample's cut falls is read again, by itself.
    """
    s = _segmented(scored, resamples, seed).withColumn("m", F.col("p") + F.col("n"))
    total = F.sum("m").over(Window.partitionBy("r"))
    k = F.least(F.greatest(F.lit(1), F.bround(F.lit(budget) * total).cast("long")), total)
    placed = s.withColumn("rest", k - _before(F.col("low").desc(), "m"))
    share = F.when(F.col("m") == 0, 0.0).otherwise(F.greatest(F.lit(0), F.least("m", "rest")) / F.col("m"))
    inside = ~F.col("single") & (F.col("rest") > 0) & (F.col("rest") < F.col("m"))
    whole = placed.groupBy("r").agg(F.sum(F.when(inside, 0.0).otherwise(F.col("p") * share)).alias("caught"), F.sum("p").alias("errors"))
    cut_at = placed.filter(inside).groupBy("low", "high").agg(F.map_from_entries(F.collect_list(F.struct("r", "rest"))).alias("rests"))  # a resample is cut once: at most as many rows
    held = scored.filter("score IS NOT NULL AND item_id IS NOT NULL").select("item_id", F.col("score").cast("double").alias("score"), "error")
    again = held.join(F.broadcast(cut_at.select("low", "high")), F.col("score").between(F.col("low"), F.col("high")))

    def run(batches):
        yield from _inside(batches, resamples, seed)

    part = again.repartition("low").sortWithinPartitions("low", F.desc("score")).mapInArrow(run, "low double, above array<long>, p array<long>, m array<long>")
    flat = part.select("low", F.posexplode(F.arrays_zip("above", "p", "m")).alias("r", "x"))
    rests = cut_at.select("low", F.explode("rests").alias("r", "rest"))
    some = flat.join(rests, ["low", "r"]).select("r", (F.col("x.p") * F.greatest(F.lit(0), F.least(F.col("x.m"), F.col("rest") - F.col("x.above"))) / F.when(F.col("x.m") > 0, F.col("x.m"))).alias("c"))
    both = whole.join(some.groupBy("r").agg(F.sum("c").alias("more")), "r", "left").filter("errors > 0")
    return both.select("r", ((F.col("caught") + F.coalesce("more", F.lit(0.0))) / F.col("errors")).alias("value"))


def _inside(batches, resamples: int, seed: int):
    """(low, weight above, of errors, in all) of each score of a range, from the greatest on; rows come sorted by range and score."""
    runs: list = []
    for b in batches:
        low = b.column("low").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(low)) + 1).tolist(), len(low)]
        for s, e in zip(cuts[:-1], cuts[1:]):
            if e > s:
                if runs and runs[0].column("low")[0].as_py() != low[s]:
                    yield from _flush(runs, resamples, seed)
                    runs = []
                runs.append(b.slice(s, e - s))
    yield from _flush(runs, resamples, seed)


def _flush(runs: list, resamples: int, seed: int):
    above = np.zeros(resamples, np.int64)
    for _, p, n in _groups(iter(runs), resamples, seed):
        yield pa.RecordBatch.from_arrays([runs[0].column("low").slice(0, 1), *(pa.array([x.tolist()], pa.list_(pa.int64())) for x in (above, p, p + n))], ["low", "above", "p", "m"])
        above = above + p + n


def mean_draws(values: DataFrame, resamples: int, seed: int) -> DataFrame:
    """(r, value): the mean of each resample of whole items of values (item_id, value); an item comes with all its values."""
    items = values.filter("value IS NOT NULL AND item_id IS NOT NULL").groupBy("item_id").agg(F.sum("value").alias("s"), F.count("*").alias("k"))

    def run(batches):
        top, bottom = np.zeros(resamples), np.zeros(resamples, np.int64)
        for b in batches:
            for at in range(0, b.num_rows, ROWS):
                part = b.slice(at, ROWS)
                w = weights(part.column("item_id").to_pylist(), resamples, seed)
                top += part.column("s").to_numpy() @ w
                bottom += part.column("k").to_numpy() @ w
        yield pa.RecordBatch.from_arrays([pa.array([top.tolist()], pa.list_(pa.float64())), pa.array([bottom.tolist()], pa.list_(pa.int64()))], ["top", "bottom"])

    parts = items.mapInArrow(run, "top array<double>, bottom array<long>").select(F.posexplode(F.arrays_zip("top", "bottom")).alias("r", "x"))
    return parts.groupBy("r").agg(F.sum("x.top").alias("t"), F.sum("x.bottom").alias("b")).filter("b > 0").select("r", (F.col("t") / F.col("b")).alias("value"))
