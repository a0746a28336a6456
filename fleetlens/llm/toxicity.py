"""Toxicity by a convolutional text classifier: numpy in tasks, averaged over tasks after each round over all labelled rows."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import _LOWER, arrow_pass, arrow_rows, column_bytes, give_back, keep_ids, mix, release, sent, slices, word_hashes, word_starts, written

#: Hashed vocabulary, embedding size, filters of each width.
BUCKETS, DIMS, FILTERS, WIDTHS = 1 << 15, 16, 12, (1, 2, 3)
#: A word's embedding is the sum of those of itself and of its first so many bytes, so that inflected forms share one.
PREFIXES = (4, 5)
#: Labelled rows that the weights are started on, at most, and bytes of their texts. What fewer of all labelled rows hold than RARE is not learnt.
TRAIN_ROWS, TRAIN_BYTES, RARE = 7500, 16 << 20, 8
#: Rounds over all labelled rows, and rows that a model of a round goes over, about, before it is averaged with the others.
ROUNDS, SHARD_ROWS = 3, 4096
#: Weights are averaged as whole numbers of this fraction, so that sums agree in any order.
UNIT = 1 << 24
#: One in so many of all labelled rows is left out of the fit, and the thresholds are calibrated by them, by scores in steps of 1 / STEPS.
CALIBRATE_SHARE, STEPS = 5, 4096
#: Words that are embedded at once.
SCORE_WORDS = 1 << 15
EPOCHS, BATCH, RATE, DECAY = 8, 64, 0.01, 1e-4
#: Rows of each language that its threshold needs; others use the threshold of all.
CALIBRATE_ROWS = 50
#: Thresholds stay within these.
LEAST, MOST = 0.35, 0.65
_STOP = np.ones(256, bool)
_STOP[48:58] = _STOP[65:91] = _STOP[97:123] = False
_STOP[128:] = False


def tokens(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets (feature, word) of each text's words and n+1 offsets; bucket 0 pads. Words are runs of letters, digits and non-ASCII bytes, A-Z lowered."""
    h, at = word_hashes(data, offsets, lower=True, stop=_STOP)
    starts = word_starts(data, offsets, _STOP)
    features = [h]
    longest = max(PREFIXES)
    low = np.concatenate((_LOWER[data], np.full(longest, 32, np.uint8)))
    prefix, live = np.zeros(len(starts), np.uint64), np.ones(len(starts), bool)
    end = offsets[np.searchsorted(offsets, starts, side="right")] if len(starts) else starts
    for i in range(longest):
        byte = low[starts + i]
        if i:
            live = live & ~_STOP[byte] & (starts + i < end)
        prefix = np.where(live, prefix * np.uint64(1099511628211) + byte.astype(np.uint64) + np.uint64(1), prefix)
        if i + 1 in PREFIXES:
            features.append(mix(prefix + np.uint64((i + 1) << 56)))
    return np.stack([(f % np.uint64(BUCKETS - 1)).astype(np.int32) + 1 for f in features]), at


@dataclass
class Model:
    """Embeddings, filters by width (width, DIMS, FILTERS), their biases, and the last layer."""

    embedding: np.ndarray
    filters: list[np.ndarray]
    bias: list[np.ndarray]
    out: np.ndarray
    out_bias: float


def padded(tok: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Texts one after the other, each followed by as many pads as the widest filter has. Windows may start at a text's words and its first pad: those cross into no other text, and there is always one."""
    pad = max(WIDTHS)
    n = np.diff(at)
    out = np.zeros((len(tok), tok.shape[1] + pad * len(n)), np.int32)
    out[:, np.arange(tok.shape[1]) + pad * np.repeat(np.arange(len(n)), n)] = tok
    return out, at[:-1] + pad * np.arange(len(n))


def embedded(embedding: np.ndarray, tok: np.ndarray) -> np.ndarray:
    x = embedding[tok[0]]
    for t in tok[1:]:
        x += embedding[t]
    return x


def convolved(x: np.ndarray, f: np.ndarray) -> np.ndarray:
    """The value of each filter at each word; what would reach over the end is left out of the sum, and pads stand there."""
    y = x @ f[0]
    for j in range(1, len(f)):
        y[:-j] += x[j:] @ f[j]
    return y


def scores(model: Model, tok: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A score for each text, SCORE_WORDS words at a time: a filter's greatest value over a text is the greatest of those over its parts."""
    flat, starts = padded(tok, at)
    n, reach = flat.shape[1], max(WIDTHS) - 1
    ends = (starts[1:, None] - np.arange(1, reach + 1)).ravel()
    top = np.full((len(starts), FILTERS * len(WIDTHS)), -np.inf, np.float32)
    for p in range(0, n, SCORE_WORDS):
        m = min(SCORE_WORDS, n - p)
        x = embedded(model.embedding, flat[:, p : p + m + reach])
        y = np.concatenate([convolved(x, f)[:m] for f in model.filters], axis=1)
        y[ends[(ends >= p) & (ends < p + m)] - p] = -np.inf
        first = int(np.searchsorted(starts, p, side="right")) - 1
        last = int(np.searchsorted(starts, p + m))
        part = np.maximum.reduceat(y, np.maximum(starts[first:last] - p, 0), axis=0)
        top[first:last] = np.maximum(top[first:last], part)
    hidden = np.maximum(top + np.concatenate(model.bias), 0)
    return 1 / (1 + np.exp(-np.clip(hidden @ model.out + model.out_bias, -30, 30)))


class Trainer:
    """Adam on the cross entropy, a batch of texts at a time; max pooling sends a gradient to one window of each filter."""

    def __init__(self, p: dict[str, np.ndarray]) -> None:
        self.p = p
        self.m, self.v = ({k: np.zeros_like(x) for k, x in p.items()} for _ in range(2))
        self.steps = 0

    @staticmethod
    def start(known: np.ndarray, rng: np.random.Generator) -> dict[str, np.ndarray]:
        p = {"e": rng.normal(0, 0.1, (BUCKETS, DIMS)).astype(np.float32), "o": rng.normal(0, 0.3, len(WIDTHS) * FILTERS).astype(np.float32), "c": np.full(1, -1, np.float32)}
        for w in WIDTHS:
            p[f"f{w}"] = rng.normal(0, 0.5 / np.sqrt(w), (w, DIMS, FILTERS)).astype(np.float32)
            p[f"b{w}"] = np.zeros(FILTERS, np.float32)
        p["e"][~known] = 0
        return p

    def model(self) -> Model:
        p = self.p
        return Model(p["e"], [p[f"f{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["o"], float(p["c"][0]))

    def best(self, tok: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """For each width where in each text a filter has its greatest value, and that; SCORE_WORDS words at a time."""
        n, reach, each = len(starts), max(WIDTHS) - 1, np.arange(FILTERS)
        at = [np.zeros((n, FILTERS), np.int64) for _ in WIDTHS]
        top = [np.full((n, FILTERS), -np.inf, np.float32) for _ in WIDTHS]
        for q in range(0, tok.shape[1], SCORE_WORDS):
            m = min(SCORE_WORDS, tok.shape[1] - q)
            x = embedded(self.p["e"], tok[:, q : q + m + reach])
            some = range(int(np.searchsorted(starts, q, side="right")) - 1, int(np.searchsorted(starts, q + m)))
            for k, w in enumerate(WIDTHS):
                y = convolved(x, self.p[f"f{w}"])[:m]
                for i in some:
                    low, high = max(int(starts[i]) - q, 0), min(int(ends[i]) - q, m)
                    if low < high:
                        place = low + y[low:high].argmax(0)
                        more = y[place, each] > top[k][i]
                        at[k][i][more], top[k][i][more] = q + place[more], y[place, each][more]
        return at, top

    def update(self, own: list[np.ndarray], y: np.ndarray, rate: float) -> np.ndarray:
        """A step on a batch of texts; the rows of the embedding that it changed."""
        p, m, v = self.p, self.m, self.v
        tok, starts = padded(np.concatenate(own, axis=1), np.concatenate(([0], np.cumsum([t.shape[1] for t in own]))))
        best, top = self.best(tok, starts, np.append(starts[1:], tok.shape[1]) - max(WIDTHS) + 1)
        hidden = np.concatenate([x + p[f"b{w}"] for x, w in zip(top, WIDTHS, strict=True)], axis=1)
        live = hidden > 0
        act = hidden * live
        guess = 1 / (1 + np.exp(-np.clip(act @ p["o"] + p["c"], -30, 30)))
        d = ((guess - y) / len(own)).astype(np.float32)
        g = {"o": act.T @ d, "c": np.array([d.sum()], np.float32)}
        dh = (d[:, None] * p["o"]) * live
        where, vals = [], []
        for k, w in enumerate(WIDTHS):
            part, f = dh[:, k * FILTERS : (k + 1) * FILTERS], p[f"f{w}"]
            g[f"b{w}"], g[f"f{w}"] = part.sum(0), np.zeros_like(f)
            for j in range(w):
                place = np.minimum(best[k] + j, tok.shape[1] - 1)
                g[f"f{w}"][j] = np.einsum("nfd,nf->df", embedded(p["e"], tok[:, place]), part)
                where.append(tok[:, place].reshape(len(tok), -1))
                vals.append((part[:, :, None] * f[j].T[None]).reshape(-1, DIMS))
        vals = np.tile(np.concatenate(vals), (len(tok), 1))
        at, back = np.unique(np.concatenate(where, axis=1).ravel(), return_inverse=True)
        ge = np.zeros((len(at), DIMS), np.float32)
        np.add.at(ge, back.ravel(), vals)
        ge[at == 0] = 0
        self.steps += 1
        fix = np.sqrt(1 - 0.999**self.steps) / (1 - 0.9**self.steps)
        for k, x in g.items():
            m[k] += 0.1 * (x - m[k])
            v[k] += 0.001 * (x * x - v[k])
            p[k] -= rate * (fix * m[k] / (np.sqrt(v[k]) + 1e-8) + DECAY * p[k])
        # of the embeddings only rows that a window used
        m["e"][at] += 0.1 * (ge - m["e"][at])
        v["e"][at] += 0.001 * (ge * ge - v["e"][at])
        p["e"][at] -= rate * (fix * m["e"][at] / (np.sqrt(v["e"][at]) + 1e-8) + DECAY * p["e"][at])
        return at


def holding(texts: list[np.ndarray]) -> np.ndarray:
    """For each bucket how many texts hold it."""
    held = np.zeros(BUCKETS, np.int64)
    for t in texts:
        held[np.unique(t)] += 1
    return held


def train(texts: list[np.ndarray], y: np.ndarray, seed: int = 7, known: np.ndarray | None = None) -> Model:
    """A model of texts that are held whole; known buckets are those that RARE of them hold, unless they are given."""
    rng = np.random.Generator(np.random.PCG64(seed))
    if known is None:
        known = holding(texts) >= RARE
        known[0] = False
    trainer = Trainer(Trainer.start(known, rng))
    texts = [np.where(known[t], t, 0) for t in texts]
    for epoch in range(EPOCHS):
        order = rng.permutation(len(texts))
        for b in range(0, len(order), BATCH):
            rows = order[b : b + BATCH]
            trainer.update([texts[i] for i in rows], y[rows], RATE * (1 - epoch / EPOCHS))
    return trainer.model()


def calibrated(score: np.ndarray, y: np.ndarray, lang: list[str | None], n: np.ndarray | None = None, step: float = 0.0) -> dict[str | None, float]:
    """For each language the threshold with the best F1 on rows that weren't fitted, midway between scores; None for the rest.

    With n, an item stands for n rows of scores from its own to less than a step above, y of which are toxic."""
    n = np.ones(len(y), np.int64) if n is None else n

    def best(s: np.ndarray, t: np.ndarray, n: np.ndarray) -> float:
        order = np.argsort(-s)
        hit = np.cumsum(t[order])
        f1 = 2 * hit / (np.cumsum(n[order]) + max(1, t.sum()))
        i = int(f1.argmax())
        below = s[order[i + 1]] + step if i + 1 < len(s) else 0.0
        return float(np.clip((s[order[i]] + below) / 2, LEAST, MOST))

    out: dict[str | None, float] = {None: best(score, y, n) if len(y) and 0 < y.sum() < n.sum() else 0.5}
    names = np.array([x or "" for x in lang])
    for name in sorted(set(names)):
        own = names == name
        if n[own].sum() >= CALIBRATE_ROWS and 0 < y[own].sum() < n[own].sum():
            out[name] = best(score[own], y[own], n[own])
    return out


def held_out(doc_id: Column) -> Column:
    """crc32 of the id as text, mod 5, is 0."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 5 == 0, F.lit(False))


def fitted() -> Column:
    """Whether a row is fitted and not calibrated by."""
    return F.pmod(F.xxhash64(F.lit("fit"), "doc_id"), F.lit(CALIBRATE_SHARE)) != 0


def usable_labels(labels: DataFrame, label_col: str) -> DataFrame:
    """(doc_id, _y) of labels of 0 or 1 outside the held-out fold, the greatest of an id."""
    return labels.where(labels["doc_id"].isNotNull() & labels[label_col].isin(0, 1) & ~held_out(labels["doc_id"])).groupBy("doc_id").agg(F.max(label_col).alias("_y"))


def labelled_rows(docs: DataFrame, labels: DataFrame, label_col: str) -> DataFrame:
    """A written table (_shard, doc_id, _y, lang, text, _fit) of all labelled rows outside the held-out fold that have a text, dealt to shards of about SHARD_ROWS by their ids, in order of a hash.

    Of an id with several texts the least counts, so that reruns fit the same model."""
    known = written(usable_labels(labels, label_col), "toxicity-labels")
    own = docs.select("doc_id", "text", "lang").where(~held_out(docs["doc_id"]))
    again = written(own.groupBy("doc_id").agg(F.count("*").alias("rows")).where("rows > 1 and doc_id is not null").select("doc_id"), "toxicity-again")
    mine = own.where("text is not null").join(sent(known), "doc_id")
    if not again.isEmpty():
        least = F.min(F.struct(F.octet_length("text").alias("n"), "text", "lang"))
        once = keep_ids(mine, again, "doc_id").groupBy("doc_id").agg(F.first("_y").alias("_y"), least.alias("t")).select("doc_id", "t.text", "t.lang", "_y")
        mine = keep_ids(mine, again, "doc_id", "left_anti").unionByName(once)
    shards = max(1, math.ceil(known.count() / SHARD_ROWS))
    dealt = mine.withColumn("_o", F.xxhash64("doc_id")).repartition(shards, "doc_id").sortWithinPartitions("_o", "doc_id")
    rows = written(dealt.select(F.spark_partition_id().alias("_shard"), "doc_id", F.col("_y").cast("int").alias("_y"), "lang", "text", fitted().alias("_fit")), "toxicity-rows")
    release(known, again)
    return rows


def known_buckets(rows: DataFrame) -> np.ndarray:
    """Whether RARE of all fitted rows hold a bucket."""

    def make():
        held = np.zeros(BUCKETS, np.int64)

        def step(batch: pa.RecordBatch):
            tok, at = tokens(*column_bytes(batch.column(0)))
            held[:] += holding([tok[:, at[i] : at[i + 1]] for i in range(batch.num_rows)])
            yield from ()

        def finish():
            full = np.flatnonzero(held)
            yield {"bucket": pa.array(full), "n": pa.array(held[full])}

        step.finish = finish
        return step

    known = np.zeros(BUCKETS, bool)
    counts = arrow_pass(rows.where("_fit").select("text"), make, "bucket bigint, n bigint").groupBy("bucket").agg(F.sum("n").alias("n"))
    known[[r.bucket for r in counts.where(F.col("n") >= RARE).select("bucket").collect()]] = True  # BUCKETS at most
    known[0] = False
    return known


def averaged(rows: DataFrame, model: Model, known: np.ndarray, rate: float) -> Model:
    """The mean of models that go on from one: one a shard, over all its fitted rows. A row of the embedding counts as often as a shard changed it, other weights as often as the shard has rows.

    A text is read once a round and kept no longer than its batch; a task holds one model, its moments and its sums."""
    names = [k for w in WIDTHS for k in (f"f{w}", f"b{w}")] + ["o", "c"]
    first = {"e": model.embedding, "o": model.out, "c": np.full(1, model.out_bias, np.float32)} | {f"f{w}": f for w, f in zip(WIDTHS, model.filters, strict=True)} | {f"b{w}": b for w, b in zip(WIDTHS, model.bias, strict=True)}
    sizes = [first[k].size for k in names]
    lines = -(-sum(sizes) // DIMS)
    shared = rows.sparkSession.sparkContext.broadcast((first, known))

    def make():
        begin, live = shared.value
        sums, times = np.zeros((BUCKETS + lines, DIMS), np.int64), np.zeros(BUCKETS + lines, np.int64)
        state: dict = {"shard": None}

        def hand_in() -> None:
            p, n, changed = state["trainer"].p, state["rows"], state["changed"]
            flat = np.zeros(lines * DIMS)
            flat[: sum(sizes)] = np.concatenate([p[k].ravel() for k in names])
            dense = np.rint(flat.reshape(-1, DIMS) * UNIT).astype(np.int64)
            at = np.flatnonzero(changed)
            sums[at] += np.rint(p["e"][at].astype(np.float64) * UNIT).astype(np.int64) * changed[at, None]
            times[at] += changed[at]
            sums[BUCKETS:] += dense * n
            times[BUCKETS:] += n

        def step(batch: pa.RecordBatch):
            shard, y = batch.column(0).to_numpy(), batch.column(1).to_numpy().astype(np.float32)
            tok, at = tokens(*column_bytes(batch.column(2)))
            tok = np.where(live[tok], tok, 0)
            edges = [0, *(np.flatnonzero(shard[1:] != shard[:-1]) + 1).tolist(), len(shard)]
            for low, high in zip(edges[:-1], edges[1:], strict=True):
                if shard[low] != state["shard"]:
                    if state["shard"] is not None:
                        hand_in()
                    state.update(shard=shard[low], trainer=Trainer({k: x.copy() for k, x in begin.items()}), rows=0, changed=np.zeros(BUCKETS, np.int64))
                for b in range(low, high, BATCH):
                    some = range(b, min(b + BATCH, high))
                    state["changed"][state["trainer"].update([tok[:, at[i] : at[i + 1]] for i in some], y[b : some.stop], rate)] += 1
                state["rows"] += high - low
            yield from ()

        def finish():
            if state["shard"] is not None:
                hand_in()
            full = np.flatnonzero(times)
            yield {"line": pa.array(full), "n": pa.array(times[full])} | {f"v{i}": pa.array(np.ascontiguousarray(sums[full, i])) for i in range(DIMS)}

        step.finish = finish
        return step

    values = [f"v{i}" for i in range(DIMS)]
    parts = arrow_pass(rows.where("_fit").select("_shard", "_y", "text"), make, "line bigint, n bigint, " + ", ".join(f"{v} bigint" for v in values))
    total = parts.groupBy("line").agg(*[F.sum(c).alias(c) for c in ("n", *values)]).toArrow()  # a row a bucket at most, and the few other weights
    shared.unpersist()
    if not total.num_rows:
        return model
    line, n = total.column("line").to_numpy(), total.column("n").to_numpy()
    mean = (np.stack([total.column(v).to_numpy() for v in values], axis=1) / (n[:, None] * float(UNIT))).astype(np.float32)
    embedding, dense = model.embedding.copy(), np.zeros((lines, DIMS), np.float32)
    own = line < BUCKETS
    embedding[line[own]], dense[line[~own] - BUCKETS] = mean[own], mean[~own]
    cut = np.split(dense.ravel()[: sum(sizes)], np.cumsum(sizes)[:-1])
    p = {k: x.reshape(first[k].shape) for k, x in zip(names, cut, strict=True)}
    return Model(embedding, [p[f"f{w}"] for w in WIDTHS], [p[f"b{w}"] for w in WIDTHS], p["o"], float(p["c"][0]))


def limits_of(rows: DataFrame, model: Model) -> tuple[float, DataFrame]:
    """The threshold of all rows left out of the fit, and a written table (_lang, _limit) of those of languages with enough of them."""
    shared = rows.sparkSession.sparkContext.broadcast(model)

    def make():
        own = shared.value

        def step(batch: pa.RecordBatch):
            tok, at = tokens(*column_bytes(batch.column(2)))
            yield {"lang": batch.column(0), "y": batch.column(1), "bin": pa.array((scores(own, tok, at).astype(np.float64) * STEPS).astype(np.int64))}

        return step

    scored = arrow_pass(rows.where("not _fit").select(F.coalesce("lang", F.lit("")).alias("lang"), "_y", "text"), make, "lang string, y int, bin bigint")
    counts = written(scored.groupBy("lang", "bin").agg(F.count("*").alias("n"), F.sum("y").alias("y")), "toxicity-scores")

    def best(part: pa.Table) -> dict[str | None, float]:
        return calibrated(part["bin"].to_numpy() / STEPS, part["y"].to_numpy(), part["lang"].to_pylist(), part["n"].to_numpy(), 1 / STEPS)

    def of_language(part: pa.Table) -> pa.Table:  # STEPS + 1 rows at most
        own = [(name, x) for name, x in best(part).items() if name is not None]
        return pa.table({"_lang": pa.array([name for name, _ in own], pa.string()), "_limit": pa.array([x for _, x in own], pa.float64())})

    every = counts.groupBy("bin").agg(F.sum("n").alias("n"), F.sum("y").alias("y")).withColumn("lang", F.lit("")).toArrow()  # STEPS + 1 rows at most
    table = written(counts.groupBy("lang").applyInArrow(of_language, "_lang string, _limit double"), "toxicity-limits")
    release(counts)
    return best(every)[None], table


def training_rows(docs: DataFrame, labels: DataFrame, label_col: str) -> pd.DataFrame:
    """(_y, lang, text, _fit) of the rows that the weights are started on: at most TRAIN_ROWS labelled rows outside the held-out fold, by a hash of their ids, and of at most TRAIN_BYTES.

    What is learnt in the end comes from labelled_rows(), all of them.

    Rows are taken whole in that order; one that would go over the bytes is passed over. Of an id with several texts
    the least counts, so that reruns fit the same model."""
    chosen = usable_labels(labels, label_col).withColumn("_o", F.xxhash64("doc_id")).orderBy("_o", "doc_id").limit(TRAIN_ROWS)
    mine = docs.select("doc_id", "text", "lang").where("text is not null").join(F.broadcast(chosen), "doc_id")
    sizes = mine.groupBy("_o", "doc_id").agg(F.min(F.octet_length("text")).alias("n")).orderBy("_o", "doc_id").collect()
    ids, total = [], 0
    for r in sizes:
        if total + r.n <= TRAIN_BYTES:
            ids.append(r.doc_id)
            total += r.n
    taken = docs.sparkSession.createDataFrame(pa.table({"doc_id": pa.array(ids, pa.int64())}))
    least = F.min(F.struct(F.octet_length("text").alias("n"), "text", "lang"))
    rows = mine.join(F.broadcast(taken), "doc_id").groupBy("doc_id").agg(F.first("_y").alias("_y"), F.first("_o").alias("_o"), least.alias("t"))
    return rows.select("_o", "doc_id", "_y", "t.lang", "t.text", fitted().alias("_fit")).toPandas().sort_values(["_o", "doc_id"], ignore_index=True)


def fit(docs: DataFrame, labels: DataFrame, label_col: str = "toxic") -> tuple[Model, float, DataFrame]:
    """A model of all labelled rows outside the held-out fold but those left out of the fit, the threshold by all of these, and those by language.

    Weights start on the rows that training_rows gives; then each shard of all rows goes on from them, and the mean of what the shards come to is the start of the next round."""
    every = labelled_rows(docs, labels, label_col)
    known = known_buckets(every)
    rows = training_rows(every, labels, label_col)
    texts: list[np.ndarray] = []
    for piece in slices(pa.RecordBatch.from_arrays([pa.array(rows["text"], pa.string())], ["text"])):
        tok, at = tokens(*column_bytes(piece.column(0)))
        texts += [tok[:, at[i] : at[i + 1]] for i in range(piece.num_rows)]
    y, own = rows["_y"].to_numpy(np.float32), rows["_fit"].to_numpy(bool)
    del rows
    model = train([t for t, f in zip(texts, own, strict=True) if f], y[own], known=known)
    del texts
    give_back()
    for turn in range(ROUNDS):
        model = averaged(every, model, known, RATE * (1 - turn / ROUNDS) / 2)
    limit, by_language = limits_of(every, model)
    release(every)
    return model, limit, by_language


def score_documents(docs: DataFrame, labels: DataFrame, keep: list[str], label_col: str = "toxic") -> DataFrame:
    """The columns `keep` of every row with held_out, score, predicted (score >= 0.5), threshold and flagged (score >= threshold of the row's language).

    The score depends on the text alone; the language only picks the threshold that flags. Scoring is one pass
    without a shuffle, with the model (about 2 MB) sent to each task. Defined results: a null or empty text scores as
    one without words; repeated rows score alike; labels with null or other values are left out, and the
    greater of two for one id counts; very long texts are scored whole; without usable labels the scores are those of an untrained model; columns outside keep are dropped; an empty table gives none."""
    from pyspark.sql.pandas.types import to_arrow_schema

    model, limit, by_language = fit(docs, labels, label_col)
    known = docs.sparkSession.sparkContext.broadcast(model)
    schema = T.StructType([docs.schema[c] for c in keep] + [T.StructField("_score", T.DoubleType())])

    def make():
        own = known.value

        def step(batch: pa.RecordBatch):
            tok, at = tokens(*column_bytes(batch.column("_text")))
            yield {c: batch.column(c) for c in keep} | {"_score": pa.array(scores(own, tok, at).astype(np.float64))}

        return step

    scored = arrow_rows(docs.select(*[docs[c] for c in keep], docs["text"].alias("_text")), make, to_arrow_schema(schema), schema)
    scored = scored.join(sent(by_language), F.coalesce("lang", F.lit("")) == F.col("_lang"), "left")
    table = F.coalesce("_limit", F.lit(limit))
    return scored.withColumns({"held_out": held_out(F.col("doc_id")), "score": F.col("_score"), "predicted": (F.col("_score") >= 0.5).cast("int"), "threshold": table}).withColumn("flagged", F.col("score") >= F.col("threshold")).drop("_score", "_lang", "_limit")
