"""Hard negatives by inner product: rows and anchors are rotated onto principal axes, so that few leading products and the norms of what remains tell most pairs apart; survivors are verified in integers."""

from __future__ import annotations

import math
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_pass, release, scratch_folder, written
from .topk import digits, quantised, vertical

#: Leading components that are accumulated between two looks at the bounds.
BLOCK = 8
#: Bytes and number of the anchors that are sent to each task at once, and how many are scored together.
ANCHOR_BYTES, ANCHORS, ANCHOR_CHUNK = 8 << 20, 1 << 15, 128
#: One row in SEED_SHARE is scored first, and SEED_ROWS at least: what is found there is what the others have to reach.
SEED_SHARE, SEED_ROWS = 64, 4096
#: Below this share of survivors they are compacted to pairs.
COMPACT = 0.25
#: Products of integers up to this are added up as longs, larger ones as Python's integers.
EXACT = 2.0**62
#: Rounding of a rotated sum of products, in products of norms, at most: far above dimensions times the unit of doubles.
ROUNDING = 1e-9
_LONG = 2**63 - 1
FOUND = "slot bigint, vec_id bigint, score bigint, key array<bigint>"


def principal_axes(rows: DataFrame, dims: int) -> np.ndarray:
    """An orthogonal matrix whose rows are the principal axes of all rows' vectors about zero, the longest first.

    Tasks add up their own products; dims * dims sums are shuffled and come to the driver. Inner products don't depend
    on the axes, so rounding in these sums touches no result."""

    def make():
        held = [np.zeros((dims, dims))]

        def step(batch: pa.RecordBatch):
            x = vertical(batch.column(0), dims).astype(np.float64)
            held[0] += x @ x.T
            yield from ()

        def finish():
            at, to = np.nonzero(np.triu(np.ones((dims, dims), bool)))
            yield {"i": pa.array(at), "j": pa.array(to), "s": pa.array(held[0][at, to])}

        step.finish = finish
        return step

    sums = arrow_pass(rows.select("v"), make, "i bigint, j bigint, s double").groupBy("i", "j").agg(F.sum("s").alias("s")).toArrow()
    moments = np.zeros((dims, dims))
    i, j = sums.column("i").to_numpy(), sums.column("j").to_numpy()
    moments[i, j] = moments[j, i] = sums.column("s").to_numpy()
    if not np.isfinite(moments).all():
        return np.eye(dims)
    _, axes = np.linalg.eigh(moments)
    return axes[:, ::-1].T.copy()


def remainders(x: np.ndarray) -> np.ndarray:
    """For a vertical array (component, row), the norm of each row's components from each block on, and 0 past the last."""
    sums = np.add.reduceat(x * x, np.arange(0, len(x), BLOCK), axis=0)
    return np.sqrt(np.vstack((np.cumsum(sums[::-1], axis=0)[::-1], np.zeros((1, x.shape[1])))))


def candidates(q: np.ndarray, q_rest: np.ndarray, x: np.ndarray, x_rest: np.ndarray, allowed: np.ndarray, low: np.ndarray, high: np.ndarray, counts: list[int] | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(anchor, row) of all allowed pairs whose product may lie from low to high of its anchor.

    q and x are vertical and rotated. After each block of components the rest of a product is at most the product of
    the norms of what remains, either way; that and ROUNDING are the bound's slack. counts gets the survivors of each block."""
    slack = ROUNDING * q_rest[0][:, None] * x_rest[0] + ROUNDING
    total, alive, pairs = np.zeros(allowed.shape), allowed, None
    for j, at in enumerate(range(0, len(x), BLOCK)):
        qb, xb = q[at : at + BLOCK], x[at : at + BLOCK]
        if pairs is None:
            total += qb.T @ xb
            rest = q_rest[j + 1][:, None] * x_rest[j + 1] + slack
            alive = alive & (total + rest >= low[:, None]) & (total - rest <= high[:, None])
            n = int(np.count_nonzero(alive))
            if n < COMPACT * alive.size:
                qi, ri = np.nonzero(alive)
                pairs = qi, ri, total[qi, ri]
        else:
            qi, ri, t = pairs
            t = t + np.einsum("dp,dp->p", qb[:, qi], xb[:, ri])
            rest = q_rest[j + 1][qi] * x_rest[j + 1][ri] + slack[qi, ri]
            stay = (t + rest >= low[qi]) & (t - rest <= high[qi])
            pairs = qi[stay], ri[stay], t[stay]
            n = len(pairs[0])
        if counts is not None:
            counts.append(n)
    return (pairs if pairs is not None else np.nonzero(alive))[:2]


class Slots:
    """What a task has found for the slots of a wave's anchors: the k best rows of each slot whose exact score lies from its floor to its ceiling.

    An anchor has `width` slots, which may be unused (floor above ceiling). Floors rise with what is found."""

    def __init__(self, wave: dict, axes: np.ndarray, k: int, same: bool) -> None:
        self.ids, self.labels, self.whole, self.k, self.same = wave["ids"], wave["labels"], wave["v"], k, same
        self.floor, self.ceiling = wave["floor"].copy(), wave["ceiling"]  # (anchor, slot), objects where longs don't do
        self.exact = self.floor.dtype != object
        self.axes = axes
        self.q = axes @ self.whole.astype(np.float64)
        self.rest = remainders(self.q)
        self.found = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, self.floor.dtype)

    def add(self, ids: np.ndarray, labels: np.ndarray, whole: np.ndarray) -> None:
        x = self.axes @ whole.astype(np.float64)
        x_rest, parts = remainders(x), []
        width = self.floor.shape[1]
        for at in range(0, len(self.ids), ANCHOR_CHUNK):
            own = slice(at, at + ANCHOR_CHUNK)
            used = self.floor[own] <= self.ceiling[own]
            low = np.where(used, self.floor[own].astype(np.float64), np.inf).min(1)
            high = np.where(used, self.ceiling[own].astype(np.float64), -np.inf).max(1)
            low, high = np.nextafter(low, -np.inf), np.nextafter(high, np.inf)  # longs may have been rounded
            allowed = (self.labels[own][:, None] == labels) == self.same
            allowed &= self.ids[own][:, None] != ids
            allowed &= used.any(1)[:, None]
            qi, ri = candidates(self.q[:, own], self.rest[:, own], x, x_rest, allowed, low, high)
            qi = qi + at
            if self.exact:
                score = np.einsum("dp,dp->p", self.whole[:, qi], whole[:, ri])
            else:
                score = np.array([sum(a * b for a, b in zip(self.whole[:, i].tolist(), whole[:, r].tolist(), strict=True)) for i, r in zip(qi.tolist(), ri.tolist(), strict=True)], object)
            for j in range(width):
                fits = ((score >= self.floor[qi, j]) & (score <= self.ceiling[qi, j])).astype(bool)
                parts.append((qi[fits] * width + j, ids[ri[fits]], score[fits]))
        touched = np.zeros(self.floor.size, bool)
        for slot, *_ in parts:
            touched[slot] = True
        again = touched[self.found[0]]
        as_before = [c[~again] for c in self.found]
        slot, vec, score = (np.concatenate(c) for c in zip(*parts, [c[again] for c in self.found], strict=True))
        order = np.lexsort((vec, -score, slot)) if self.exact else np.array(sorted(range(len(slot)), key=lambda i: (slot[i], -score[i], vec[i])), np.int64)
        slot, vec, score = slot[order], vec[order], score[order]
        place = np.arange(len(slot)) - np.searchsorted(slot, slot)
        last = place == self.k - 1
        self.floor[np.divmod(slot[last], width)] = score[last]
        kept = place < self.k
        self.found = tuple(np.concatenate((c, d[kept])) for c, d in zip(as_before, (slot, vec, score), strict=True))

    def rows(self) -> dict:
        slot, vec, score = self.found
        plain = [max(-_LONG - 1, min(_LONG, s)) for s in score.tolist()]
        key = pa.nulls(len(slot), pa.list_(pa.int64())) if self.exact else pa.array([digits(s) for s in score.tolist()], pa.list_(pa.int64()))
        return {"slot": pa.array(slot), "vec_id": pa.array(vec), "score": pa.array(plain, pa.int64()), "key": key}


def _found(rows: DataFrame, wave: dict, axes: np.ndarray, k: int, same: bool) -> DataFrame:
    known = rows.sparkSession.sparkContext.broadcast((wave, axes))

    def make():
        slots = Slots(*known.value, k, same)
        dims = len(slots.axes)

        def step(batch: pa.RecordBatch):
            slots.add(batch.column(0).to_numpy(), batch.column(1).to_numpy(), vertical(batch.column(2), dims))
            yield from ()

        def finish():
            yield slots.rows()

        step.finish = finish
        return step

    return arrow_pass(rows.select("id", "label", "v"), make, FOUND)


def _best(found: DataFrame, k: int) -> DataFrame:
    """(slot, best): the k best of what tasks found, by exact score and then id; score is put back from the key."""
    row = F.struct(F.transform(F.coalesce("key", F.array("score")), F.bitwise_not).alias("s"), "vec_id", "score")
    return found.distinct().groupBy("slot").agg(F.slice(F.array_sort(F.collect_list(row)), 1, k).alias("best"))


def _number(s: list[int]) -> int:
    s = [~x for x in s]
    return s[0] if len(s) == 1 else (s[0] << 124) + (s[1] << 62) + s[2]


def _searched(rows: DataFrame, first: Column, parts: int, wave: dict, axes: np.ndarray, k: int, same: bool) -> DataFrame:
    """(slot, best), written: a first part of the rows raises the floors for the others. All numbers that pass the driver are k a slot of one wave."""
    begun = written(_best(_found(rows.where(first).repartition(parts), wave, axes, k, same), k), "negatives-first")
    raised = dict(wave, floor=wave["floor"].copy())
    width = wave["floor"].shape[1]
    for r in begun.where(F.size("best") >= k).select("slot", F.element_at("best", -1)["s"].alias("s")).collect():
        raised["floor"][divmod(r.slot, width)] = _number(r.s)
    before = begun.select("slot", F.explode("best").alias("b")).select("slot", "b.vec_id", "b.score", F.when(F.size("b.s") > 1, F.transform("b.s", F.bitwise_not)).alias("key"))
    out = written(_best(_found(rows.where(~first), raised, axes, k, same).unionByName(before), k), "negatives-best")
    release(begun)
    return out


def hard_negatives(vectors: DataFrame, id_col: str, vector_col: str, label_col: str, is_anchor: Column, *, positives: int = 5, negatives: int = 10, low: int = 30, high: int = 90, scale: float = 256.0) -> DataFrame:
    """(anchor_id, positive_id, rank, negative_id, positive_score, negative_score): for each anchor and each of its best rows of the same label, the best rows of another label whose score is from low to high per cent of the positive's.

    label_col may be any column of integers. Scores are integer inner products of floor(scale * x). Rows stay where
    they are; anchors go to them in waves of ANCHOR_BYTES, whose results are added to one written table. What a task
    holds and returns is k rows a slot, whatever the number of rows; no group is gathered by label or vector, so a
    third of all rows may share either. Defined results: a row without an id, label or vector, or whose vector holds
    null, NaN or an infinity, takes no part; rows repeated with the same id, label and vector count once; an anchor
    never meets rows of its own id, and rows that share an anchor's id are anchors each; shorter vectors count as
    padded with zeros; ties go to the smaller id; an anchor without positives, and a positive without negatives, has no
    rows; scores beyond long are ranked exactly and shown as the end of long; an empty table gives none. Other columns
    are ignored."""
    spark = vectors.sparkSession
    v = vectors.select(F.col(id_col).cast("long").alias("id"), F.col(label_col).cast("long").alias("label"), quantised(F.col(vector_col), scale).alias("v"), F.coalesce(is_anchor, F.lit(False)).alias("asks")).where("id is not null and label is not null and v is not null")
    rows = written(v, "negatives-rows")
    if not rows.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").isEmpty():
        once = written(rows.groupBy("id", "label", "v").agg(F.max("asks").alias("asks")), "negatives-rows")
        release(rows)
        rows = once
    n, asks, dims, most = rows.agg(F.count("*"), F.count_if("asks"), F.coalesce(F.max(F.size("v")), F.lit(0)), F.coalesce(F.max(F.array_max(F.transform("v", lambda x: F.abs(x.cast("double"))))), F.lit(0.0))).first()
    if not asks:
        return rows.where(F.lit(False)).select(F.col("id").alias("anchor_id"), F.col("id").alias("positive_id"), F.lit(1).alias("rank"), F.col("id").alias("negative_id"), F.col("id").alias("positive_score"), F.col("id").alias("negative_score"))
    dims = max(dims, 1)
    exact = 100 * dims * most * most < EXACT
    axes = principal_axes(rows, dims)
    waves = max(math.ceil(asks * dims * 8 / ANCHOR_BYTES), math.ceil(asks / ANCHORS))
    share = max(1, min(SEED_SHARE, n // SEED_ROWS))
    h = F.xxhash64("id", "v")
    first, parts = F.pmod(F.shiftright(h, 20), F.lit(share)) == 0, math.ceil(n / share / (1 << 16))
    path = f"{scratch_folder(spark)}/negatives-{uuid.uuid4().hex}"
    for wave in range(waves):
        own = rows.where("asks").where(F.pmod(h, F.lit(waves)) == wave).select("id", "label", "v").toArrow()  # ANCHOR_BYTES, about
        if own.num_rows:
            _wave(spark, rows, first, parts, own, dims, axes, exact, positives, negatives, low, high).write.mode("append").parquet(path)
    return spark.read.schema(OUT).parquet(path)


OUT = "anchor_id bigint, positive_id bigint, rank int, negative_id bigint, positive_score bigint, negative_score bigint"


def _wave(spark: SparkSession, rows: DataFrame, first: Column, parts: int, own: pa.Table, dims: int, axes: np.ndarray, exact: bool, positives: int, negatives: int, low: int, high: int) -> DataFrame:
    """The result's rows of one wave of anchors."""
    ids, labels = own.column("id").to_numpy(), own.column("label").to_numpy()
    kind = np.int64 if exact else object
    least, most = (-_LONG, _LONG) if exact else (-(1 << 200), 1 << 200)
    wave = {"ids": ids, "labels": labels, "v": vertical(own.column("v").combine_chunks(), dims)}
    wave |= {"floor": np.full((len(ids), 1), least, kind), "ceiling": np.full((len(ids), 1), most, kind)}
    near = _searched(rows, first, parts, wave, axes, positives, True)
    floor, ceiling = np.full((len(ids), positives), 1, kind), np.full((len(ids), positives), 0, kind)
    for r in near.select("slot", F.col("best.s").alias("s")).collect():  # numbers, ANCHORS times positives at most
        for j, s in enumerate(map(_number, r.s)):
            floor[r.slot, j], ceiling[r.slot, j] = -(-low * s // 100), high * s // 100
    far = _searched(rows, first, parts, dict(wave, floor=floor, ceiling=ceiling), axes, negatives, False)
    known = spark.createDataFrame(pa.table({"anchor": pa.array(np.arange(len(ids))), "anchor_id": pa.array(ids)}))
    pairs = near.select(F.col("slot").alias("anchor"), F.posexplode("best").alias("j", "b")).select("anchor", (F.col("anchor") * positives + F.col("j")).alias("slot"), F.col("b.vec_id").alias("positive_id"), F.col("b.score").alias("positive_score"))
    told = far.select("slot", F.posexplode("best").alias("p", "b")).select("slot", (F.col("p") + 1).alias("rank"), F.col("b.vec_id").alias("negative_id"), F.col("b.score").alias("negative_score"))
    return pairs.join(told, "slot").join(known, "anchor").select("anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score")
