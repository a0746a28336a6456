"""Exact top-k by inner product: branch and bound over vertical blocks of dimensions."""

from __future__ import annotations

import math
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, release, written

#: Dimensions that are accumulated between two looks at the bounds.
BLOCK_DIMS = 8
#: Bytes of queries that are sent to each task at once, and queries that are scored together.
QUERY_BYTES, QUERY_CHUNK = 16 << 20, 256
#: The first part of the rows to be scored: one in SEED_SHARE, and so many at least. Its k-th best scores are what the others have to reach.
SEED_SHARE, SEED_ROWS = 64, 4096
#: Below this share of survivors they are compacted to pairs.
COMPACT = 0.25
#: Sums of products up to this are exact in doubles.
EXACT = 2.0**52
_LONG = 2**63 - 1
SCHEMA = "query_id bigint, vec_id bigint, score bigint, key array<bigint>"


def quantised(vector: Column, scale: float = 256.0) -> Column:
    """floor(scale * x) of each component as long; null where the vector is null or holds null, NaN or an infinity."""
    good = vector.isNotNull() & F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) != float("inf")))
    return F.when(good, F.transform(vector, lambda x: F.floor(F.lit(scale) * x.cast("double")).cast("long")))


def tails(x: np.ndarray) -> np.ndarray:
    """For a vertical array (dimension, row), the norm of each row's components from each block on, and 0 past the last."""
    sums = np.add.reduceat(x * x, np.arange(0, len(x), BLOCK_DIMS), axis=0)
    return np.sqrt(np.vstack((np.cumsum(sums[::-1], axis=0)[::-1], np.zeros((1, x.shape[1])))))


def survivors(q: np.ndarray, q_tail: np.ndarray, x: np.ndarray, x_tail: np.ndarray, other: np.ndarray, floor: np.ndarray, k: int, counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(query, row, score) of all pairs that may be among the k best of their query: those that reach floor, its k-th best score known.

    q and x are vertical. Scores are accumulated block by block; a pair survives while its sum so far plus the product
    of the norms of what remains (Cauchy-Schwarz) reaches the floor. Halfway the k best sums so far are scored whole,
    which raises the floor; once few pairs survive they are compacted and only they are carried on. Ties at the floor
    survive. counts gets the number of survivors after each block."""
    dims, half = len(x), (len(x) + 1) // 2
    total = np.zeros(other.shape)
    alive, floor, raised = other, floor.copy(), False
    pairs = None
    for j, at in enumerate(range(0, dims, BLOCK_DIMS)):
        qb, xb = q[at : at + BLOCK_DIMS], x[at : at + BLOCK_DIMS]
        slack = 1e-6 + 1e-9 * float(q_tail[0].max(initial=0.0)) * float(x_tail[0].max(initial=0.0))
        if pairs is None:
            total += qb.T @ xb
            if not raised and at + BLOCK_DIMS >= half and total.shape[1] > k:
                best = np.argpartition(np.where(other, total, -np.inf), -k, axis=1)[:, -k:]
                whole = np.einsum("dq,dqk->qk", q, x[:, best])
                enough = np.take_along_axis(other, best, 1).all(1)
                floor, raised = np.where(enough, np.maximum(floor, whole.min(1)), floor), True
            alive = alive & (total + q_tail[j + 1][:, None] * x_tail[j + 1] + slack >= floor[:, None])
            n = int(np.count_nonzero(alive))
            if n < COMPACT * alive.size:
                qi, ri = np.nonzero(alive)
                pairs = qi, ri, total[qi, ri]
        else:
            qi, ri, t = pairs
            t = t + np.einsum("dp,dp->p", qb[:, qi], xb[:, ri])
            stay = t + q_tail[j + 1][qi] * x_tail[j + 1][ri] + slack >= floor[qi]
            pairs = qi[stay], ri[stay], t[stay]
            n = len(pairs[0])
        if counts is not None:
            counts.append(n)
    if pairs is None:
        qi, ri = np.nonzero(alive)
        pairs = qi, ri, total[qi, ri]
    stay = pairs[2] >= floor[pairs[0]]
    return pairs[0][stay], pairs[1][stay], pairs[2][stay]


class Best:
    """The k best (score, id) of each query of a task so far, which raise the floors for the rows to come."""

    def __init__(self, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int) -> None:
        self.ids, self.q, self.tail, self.floor, self.k = ids, q, tails(q), floor.astype(np.float64).copy(), k
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        x_tail, parts = tails(x), [self.found]
        for at in range(0, len(self.ids), QUERY_CHUNK):
            own = slice(at, at + QUERY_CHUNK)
            qi, ri, s = survivors(self.q[:, own], self.tail[:, own], x, x_tail, self.ids[own][:, None] != ids[None, :], self.floor[own], self.k)
            parts.append((qi + at, ids[ri], s))
        query, vec, score = (np.concatenate(c) for c in zip(*parts, strict=True))
        order = np.lexsort((vec, -score, query))
        query, vec, score = query[order], vec[order], score[order]
        place = np.arange(len(query)) - np.searchsorted(query, query)
        kept = place < self.k
        last = place == self.k - 1
        self.floor[query[last]] = np.maximum(self.floor[query[last]], score[last])
        self.found = query[kept], vec[kept], score[kept]


def digits(score: int) -> list[int]:
    """A score of any size as three longs that sort as it does."""
    high, rest = divmod(score, 1 << 124)
    return [high, *divmod(rest, 1 << 62)]


def vertical(vectors: pa.Array, dims: int) -> np.ndarray:
    """Lists of longs as (dimension, row), short ones padded with zeros."""
    out = np.zeros((dims, len(vectors)), np.int64)
    n = vectors.value_lengths().to_numpy()
    row = np.repeat(np.arange(len(n)), n)
    out[np.arange(len(row)) - np.repeat(np.cumsum(n) - n, n), row] = vectors.flatten().to_numpy()
    return out


def _scored(rows: DataFrame, ids: np.ndarray, q: np.ndarray, floor: np.ndarray, k: int, doubles: bool) -> DataFrame:
    """The k best of each query among each task's rows, as far as they reach the floor."""
    known = rows.sparkSession.sparkContext.broadcast((ids, q, floor))

    def make():
        ids, q, floor = known.value
        dims = len(q)
        if doubles:
            best = Best(ids, q.astype(np.float64), floor, k)

            def step(batch: pa.RecordBatch):
                best.add(batch.column(0).to_numpy(), vertical(batch.column(1), dims).astype(np.float64))
                yield from ()

            def finish():
                at, vec, score = best.found
                yield {"query_id": pa.array(ids[at]), "vec_id": pa.array(vec), "score": pa.array(score.astype(np.int64)), "key": pa.nulls(len(at), pa.list_(pa.int64()))}

        else:  # products beyond doubles: Python's integers
            found: list[list[tuple[int, int]]] = [[] for _ in ids]

            def step(batch: pa.RecordBatch):
                x = vertical(batch.column(1), dims)
                own = batch.column(0).to_pylist()
                for i, q_id in enumerate(ids.tolist()):
                    a = q[:, i].tolist()
                    found[i] = sorted(found[i] + [(-sum(s * t for s, t in zip(a, x[:, r].tolist(), strict=True)), v) for r, v in enumerate(own) if v != q_id])[:k]
                yield from ()

            def finish():
                flat = [(q_id, v, -s) for q_id, own in zip(ids.tolist(), found, strict=True) for s, v in own]
                yield {"query_id": pa.array([r[0] for r in flat], pa.int64()), "vec_id": pa.array([r[1] for r in flat], pa.int64()), "score": pa.array([max(-_LONG - 1, min(_LONG, r[2])) for r in flat], pa.int64()), "key": pa.array([digits(r[2]) for r in flat], pa.list_(pa.int64()))}

        step.finish = finish
        return step

    return arrow_pass(rows, make, SCHEMA)


def _merged(found: DataFrame, k: int) -> DataFrame:
    """(query_id, best): the k best of what tasks found, by exact score and then id."""
    key = F.coalesce("key", F.array("score"))
    row = F.struct(F.transform(key, F.bitwise_not).alias("s"), "vec_id", "score")
    return found.distinct().groupBy("query_id").agg(F.slice(F.array_sort(F.collect_list(row)), 1, k).alias("best"))


def exact_top_k(vectors: DataFrame, id_col: str, vector_col: str, is_query: Column, k: int = 5, scale: float = 256.0) -> DataFrame:
    """(query_id, rank, vec_id, score): of each query's rows, the k with the highest integer inner product, ties to the smaller id.

    Rows stay where they are; queries go to them in waves of at most QUERY_BYTES. Each wave scores a first part of the
    rows, and the k-th best scores found there are the floors for the others, so that what tasks return for a query
    doesn't grow with the number of rows; in a task each batch of rows raises the floors for the next. A third of all
    rows may be the same vector: work and rows returned don't depend on values' frequency. Defined results: a vector
    that is null or holds null, NaN or an infinity takes no part, nor does a row without an id; rows repeated with the
    same id and vector count once, and a query never meets rows of its own id; shorter vectors count as padded with
    zeros; scores beyond long are ranked exactly and shown as the end of long; fewer than k candidates give fewer rows;
    an empty table gives none. Other columns are ignored."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_query, F.lit(False)).alias("asks")).where("id is not null and v is not null")
    rows = written(v, "topk-rows")
    if not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        once = written(rows.groupBy("id", "v").agg(F.max("asks").alias("asks")), "topk-rows")
        release(rows)
        rows = once
    n, asks, dims, most = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))), F.lit(0.0))).first()
    if not asks:
        return rows.where(F.lit(False)).select(F.col("id").alias("query_id"), F.lit(1).alias("rank"), F.col("id").alias("vec_id"), F.col("id").alias("score"))
    dims = max(dims, 1)
    doubles = dims * most * most < EXACT
    waves = math.ceil(asks * dims * 8 / QUERY_BYTES)
    share = max(1, min(SEED_SHARE, n // SEED_ROWS))
    h = F.xxhash64("id", "v")
    first = F.pmod(F.shiftright(h, 20), F.lit(share)) == 0
    seed = rows.where(first).select("id", "v").repartition(math.ceil(n / share / (1 << 16)))
    parts = []
    for wave in range(waves):
        own = rows.where("asks").where(F.pmod(h, F.lit(waves)) == wave).select("id", "v").toArrow()  # QUERY_BYTES, about
        if not own.num_rows:
            continue
        ids, q = own.column("id").to_numpy(), vertical(own.column("v").combine_chunks(), dims)
        begun = written(_merged(_scored(seed, ids, q, np.full(len(ids), -np.inf), k, doubles), k), "topk-first")
        floors = {r.query_id: r.least for r in begun.where(F.size("best") >= k).select("query_id", F.element_at("best", -1)["score"].alias("least")).collect()}  # a number a query
        floor = np.array([floors.get(i, -np.inf) for i in ids.tolist()], float)
        rest = _scored(rows.where(~first).select("id", "v"), ids, q, floor, k, doubles)
        before = begun.select("query_id", F.explode("best").alias("b")).select("query_id", "b.vec_id", "b.score", F.when(F.size("b.s") > 1, F.transform("b.s", F.bitwise_not)).alias("key"))
        parts.append(written(_merged(rest.unionByName(before), k), "topk-best"))
        release(begun)
    best = reduce(DataFrame.unionByName, parts)
    return best.select("query_id", F.posexplode("best").alias("p", "b")).select("query_id", (F.col("p") + 1).alias("rank"), "b.vec_id", "b.score")
