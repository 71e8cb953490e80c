"""Approximate nearest neighbours: coarse lists, product-quantised residuals, asymmetric distances, exact reranking."""

from __future__ import annotations

from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from proofline.llm.common import cut, cut_table

SAMPLE_ROWS = 20_000  # vectors that the index is fitted on
PARTS, CODES = 16, 256
MOST_LISTS = 4096
BLOCK_ROWS = 8192  # rows of a list that one task holds
QUERY_ROWS = 8192  # queries of a list that one task holds
RERANK = 32  # rows of a block that are compared exactly first, for each query; they set how far the others are compared
TOP = 5
REACH = 0.96  # share of the sample's true neighbours that must lie in the probed lists
TUNED_QUERIES = 256


@dataclass(frozen=True)
class Index:
    centroids: np.ndarray  # lists x dimensions, of unit vectors
    codebooks: np.ndarray  # parts x codes x dimensions of a part
    probes: int


def _kmeans(x: np.ndarray, k: int, rounds: int = 8, seed: int = 42) -> np.ndarray:
    rng = np.random.default_rng(seed)
    k = min(k, len(x))
    c = x[rng.choice(len(x), k, replace=False)].copy()
    for _ in range(rounds):
        own = _nearest(x, c)
        n = np.bincount(own, minlength=k)
        total = np.zeros_like(c)
        np.add.at(total, own, x)
        c[n > 0] = total[n > 0] / n[n > 0, None]
        c[n == 0] = x[rng.choice(len(x), int((n == 0).sum()))]
    return c


def _nearest(x: np.ndarray, c: np.ndarray) -> np.ndarray:
    half = 0.5 * (c * c).sum(axis=1)
    return np.concatenate([np.argmax(x[i : i + 4096] @ c.T - half, axis=1) for i in range(0, len(x), 4096)]) if len(x) else np.zeros(0, np.int64)


def _split(x: np.ndarray, parts: int) -> np.ndarray:
    """Rows as parts x rows x dimensions of a part, zeros behind."""
    width = -(-x.shape[1] // parts)
    return np.pad(x, ((0, 0), (0, parts * width - x.shape[1]))).reshape(len(x), parts, width).transpose(1, 0, 2)


def fit(vectors: np.ndarray, lists: int, probes: int, parts: int = PARTS) -> Index:
    x = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    centroids = _kmeans(x, lists)
    rest = _split(x - centroids[_nearest(x, centroids)], parts)
    books = np.stack([np.pad(b, ((0, CODES - len(b)), (0, 0)), mode="edge") for b in (_kmeans(r, CODES) for r in rest)])
    return Index(centroids, books, probes)


def probes_for(index: Index, vectors: np.ndarray, top: int = TOP, reach: float = REACH) -> int:
    """Lists to probe: the fewest that hold a share `reach` of the true neighbours, by brute force within the sample.

    Neighbours in all rows are nearer than those in a sample of them, so more rows need no more lists. Vectors of one
    direction count as one, or a large group of copies would stand for the others.
    """
    x = (vectors / np.linalg.norm(vectors, axis=1, keepdims=True)).astype(np.float32)
    x = x[np.sort(np.unique(np.round(x, 6) + np.float32(0), axis=0, return_index=True)[1])]
    if len(x) < 2:
        return 1
    asked = np.arange(len(x))[:: max(1, len(x) // TUNED_QUERIES)]
    own, ranks = _nearest(x, index.centroids), []
    for s in range(0, len(asked), 64):
        q = asked[s : s + 64]
        near = x[q] @ x.T
        near[np.arange(len(q)), q] = -np.inf
        best = np.argsort(-near, axis=1, kind="stable")[:, : min(top, len(x) - 1)]
        order = np.argsort(-(x[q] @ index.centroids.T), axis=1, kind="stable")
        place = np.argsort(order, axis=1)
        ranks.append(np.take_along_axis(place, own[best], axis=1).ravel())
    ranks = np.sort(np.concatenate(ranks))
    return int(ranks[max(0, int(np.ceil(reach * len(ranks))) - 1)]) + 1


def usable(vectors: DataFrame) -> DataFrame:
    """(vec_id, v) of vectors that take part: no null or non-finite component, not all zero, of the commonest length; one row for each vec_id."""
    v = F.col("embedding").cast("array<double>")
    ok = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("v")).filter(F.col("v").isNotNull() & F.col("vec_id").isNotNull()).filter(F.forall("v", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf"))) & F.exists("v", lambda x: x != 0))
    size = ok.groupBy(F.size("v").alias("n")).count().orderBy(F.desc("count"), "n").first()
    ok = ok.filter(F.size("v") == (size["n"] if size else 0))
    return ok.groupBy("vec_id").agg(F.min("v").alias("v"))


def _matrix(column) -> np.ndarray:
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else np.zeros((0, 1))


def search(vectors: DataFrame, every: int = 50, top: int = TOP, lists: int | None = None, probes: int | None = None, query_rows: int = QUERY_ROWS) -> DataFrame:
    """The `top` nearest by cosine of each query (vec_id divisible by `every`): query_id, rank, vec_id, score.

    The index is fitted on at most SAMPLE_ROWS vectors, the first by a hash of vec_id; every vector is indexed. There are
    about four lists for each square root of the rows, MOST_LISTS at most; as many of them (16 at least) are probed as hold
    a share REACH of the true neighbours within the sample, so clustered vectors need few and scattered ones many. A list is dealt into blocks of BLOCK_ROWS, so equal vectors that fill one list are spread over tasks, and its queries into sheets of query_rows that each
    meet every block; each block ranks
    its codes by asymmetric distances, compares the best RERANK in double precision, then every row that the quantisation
    error, known part by part, would let reach the best of these, and passes on its best: within the probed lists the result
    is exact. Ties go to the smaller vec_id throughout. Vectors null, zero, of another length than most, or with null or non-finite
    components take no part, and neither do null ids; of rows that share a vec_id one counts. No vector but the query's own,
    or an empty table: no rows. Other columns are not read.
    """
    spark = vectors.sparkSession
    rows = cut_table(usable(vectors))
    n = rows.count()
    if n < 2:
        return spark.createDataFrame([], "query_id long, rank int, vec_id long, score double")
    lists = lists or max(1, min(MOST_LISTS, int(4 * n**0.5)))
    sample = sorted(rows.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE_ROWS).collect(), key=lambda r: r.vec_id)
    points = np.array([r.v for r in sample])
    del sample
    index = fit(points, lists, 0)
    index = replace(index, probes=min(len(index.centroids), probes or max(16, probes_for(index, points, top))))
    shared = spark.sparkContext.broadcast(vars(index))

    def coded(batches):
        ix = Index(**shared.value)
        for b in batches:
            x = _matrix(b.column("v"))
            x = (x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32)
            own = _nearest(x, ix.centroids)
            rest = _split(x - ix.centroids[own], len(ix.codebooks))
            codes = np.stack([_nearest(r, c) for r, c in zip(rest, ix.codebooks)], axis=1).astype(np.uint8) if len(x) else np.zeros((0, len(ix.codebooks)), np.uint8)
            yield pa.RecordBatch.from_arrays([pa.array(own.astype(np.int32)), b.column("vec_id"), pa.array([c.tobytes() for c in codes], pa.binary()), b.column("v")], ["list", "vec_id", "codes", "v"])

    def probed(batches):
        ix = Index(**shared.value)
        for b in batches:
            x = _matrix(b.column("v"))
            near = np.argsort(-((x / np.linalg.norm(x, axis=1, keepdims=True)).astype(np.float32) @ ix.centroids.T), axis=1, kind="stable")[:, : ix.probes] if len(x) else np.zeros((0, 1), int)
            at = pa.array(np.repeat(np.arange(len(x)), near.shape[1]))
            yield pa.RecordBatch.from_arrays([pa.array(near.ravel().astype(np.int32)), b.column("vec_id").take(at), b.column("v").take(at)], ["list", "query_id", "v"])

    indexed = cut_table(rows.mapInArrow(coded, "list int, vec_id long, codes binary, v array<double>"))
    aimed = rows.filter(F.col("vec_id") % every == 0).mapInArrow(probed, "list int, query_id long, v array<double>")
    many = lambda df, size, name: df.groupBy("list").agg(F.ceil(F.count("*") / size).cast("int").alias(name))
    sizes = F.broadcast(cut(many(indexed, BLOCK_ROWS, "blocks").join(many(aimed, query_rows, "sheets"), "list")))  # MOST_LISTS rows at most
    span = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    dealt = indexed.join(sizes, "list").withColumn("block", F.pmod(F.xxhash64("vec_id"), "blocks").cast("int")).withColumn("sheet", span("sheets"))
    asked = aimed.join(sizes, "list").withColumn("sheet", F.pmod(F.xxhash64("query_id"), "sheets").cast("int")).withColumn("block", span("blocks"))

    def nearest(left: pa.Table, right: pa.Table) -> pa.Table:
        names = ["query_id", "vec_id", "score"]
        if not left.num_rows or not right.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        left = left.sort_by("vec_id")
        ids, qids = left.column("vec_id").to_numpy(), right.column("query_id").to_numpy()
        codes = np.frombuffer(b"".join(left.column("codes").to_pylist()), np.uint8).reshape(len(ids), -1)
        x, q = _matrix(left.column("v").combine_chunks()), _matrix(right.column("v").combine_chunks())
        norm, qnorm = np.sqrt((x * x).sum(axis=1)), np.sqrt((q * q).sum(axis=1))
        ix = Index(**shared.value)
        centre, parts = ix.centroids[left.column("list")[0].as_py()], np.arange(codes.shape[1])[:, None]
        error = np.linalg.norm(_split(x / norm[:, None] - centre, len(parts)) - ix.codebooks[parts, codes.T], axis=2).astype(np.float32)
        slack = 4 * np.finfo(np.float32).eps * (x.shape[1] + len(parts))  # rounding of the asymmetric scores
        first = min(len(ids), max(RERANK, top) + 1)
        out: list[list] = [[], [], []]
        for s in range(0, len(q), 64):
            unit = (q[s : s + 64] / qnorm[s : s + 64, None]).astype(np.float32)
            tables = np.einsum("pqd,pcd->qpc", _split(unit, len(ix.codebooks)), ix.codebooks)
            near = sum(tables[:, p, codes[:, p]] for p in range(codes.shape[1]))
            near += (unit @ centre)[:, None]
            near[ids[None, :] == qids[s : s + 64, None]] = -np.inf
            best = np.argpartition(-near, first - 1, axis=1)[:, :first]
            reach = near + np.linalg.norm(_split(unit, len(ix.codebooks)), axis=2).T @ error + slack
            for k in range(len(unit)):
                at = best[k]
                for last in (False, True):
                    at = at[ids[at] != qids[s + k]]
                    score = x[at] @ q[s + k] / (norm[at] * qnorm[s + k])
                    least = np.partition(score, len(at) - top)[len(at) - top] if len(at) >= top else -np.inf
                    at = at[score >= least - 1e-9] if last else np.flatnonzero(reach[k] >= least)
                score = (x[at] * q[s + k]).sum(axis=1) / (norm[at] * qnorm[s + k])
                keep = np.lexsort((ids[at], -score))[:top]
                out[0].append(np.full(len(keep), qids[s + k]))
                out[1].append(ids[at][keep])
                out[2].append(score[keep])
        return pa.table(dict(zip(names, (np.concatenate(o) for o in out))))

    close = dealt.select("list", "block", "sheet", "vec_id", "codes", "v").groupBy("list", "block", "sheet").cogroup(asked.select("list", "block", "sheet", "query_id", "v").groupBy("list", "block", "sheet")).applyInArrow(nearest, "query_id long, vec_id long, score double")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return close.withColumn("rank", rank.cast("int")).filter(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")
