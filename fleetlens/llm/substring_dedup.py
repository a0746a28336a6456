"""Substring dedup: fixed-block anchors, probed by rolling windows, extended to maximal exact repeats."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_pass, column_bytes, keep_ids, mix, rolling, signed, text_of, word_hashes, written

#: Words of a window that counts as a repeat, and of a block of the index.
WINDOW, BLOCK = 50, 7
_VERSION_BITS = 20


def blocks_inside(window: int, block: int) -> int:
    """Aligned blocks that lie whole in any window, wherever it starts."""
    return (window - block + 1) // block


def anchors(h: np.ndarray, at: np.ndarray, window: int, block: int) -> tuple[np.ndarray, np.ndarray]:
    """Places of the blocks that are indexed or probed, and their hashes.

    Every rolling window of `block` words is hashed. A repeat of `window` words holds, in whichever alignment it has to
    the other document's fixed blocks, a run of blocks_inside() of them; both documents see that run and pick its
    least hash, so blocks that no run picks need neither be indexed nor probed. Places are in all words of the chunk."""
    n = blocks_inside(window, block)
    r, doc = rolling(h, block), text_of(at)
    m = len(r) - (n - 1) * block
    if m <= 0:
        return np.zeros(0, np.int64), r[:0]
    best = np.stack([r[j * block : j * block + m] for j in range(n)]).argmin(0)
    whole = (doc[:m] == doc[n * block - 1 : n * block - 1 + m]) & (np.diff(at)[doc[:m]] >= window)
    picked = np.zeros(len(r), bool)
    picked[(np.arange(m) + best * block)[whole]] = True
    places = np.flatnonzero(picked)
    return places, r[places]


def _runs(key: np.ndarray) -> np.ndarray:
    """Offsets of the runs of equal keys."""
    return np.concatenate(([0], np.flatnonzero(key[1:] != key[:-1]) + 1, [len(key)])) if len(key) else np.zeros(1, np.int64)


# Rows that meet by hash: (h, doc, info); info is place << 2 | reference << 1 | summary. A summary stands for rows that
# have met already where they were made, so that a hash which a third of all documents share moves a row or two a chunk.


def _meet(h: np.ndarray, doc: np.ndarray, info: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For rows sorted by h: the offsets of runs, and for each run whether two documents meet in it and one has it as a reference block, and its least document."""
    at = _runs(h)
    if len(at) == 1:
        return at, np.zeros(0, bool), np.zeros(0, np.int64)
    low, high = np.minimum.reduceat(doc, at[:-1]), np.maximum.reduceat(doc, at[:-1])
    flags = np.bitwise_or.reduceat(info & 3, at[:-1])
    return at, ((flags & 1) > 0) | ((low != high) & ((flags & 2) > 0)), low


def _hits(text_docs: DataFrame, window: int, block: int) -> DataFrame:
    """(doc_id, places): blocks that also occur in another document."""

    def make():
        def step(batch: pa.RecordBatch):
            ids = batch.column(0).to_numpy()
            h, at = word_hashes(*column_bytes(batch.column(1)))
            places, r = anchors(h, at, window, block)
            owner = text_of(at)[places]
            inside = places - at[owner]
            info = (inside << 2) | ((inside % block == 0).astype(np.int64) << 1)
            doc = ids[owner]
            order = np.lexsort((doc, r))
            key, doc, info = signed(r)[order], doc[order], info[order]
            runs, met, low = _meet(key, doc, info)
            own = np.repeat(met, np.diff(runs))
            # what has met goes to its document's hits, with one summary for rows elsewhere; the rest goes by its hash
            first = runs[:-1][met]
            yield {
                "deal": pa.array(np.concatenate((signed(mix(doc[own].view(np.uint64))), key[first], key[~own]))),
                "h": pa.array(np.concatenate((key[own], key[first], key[~own]))),
                "doc_id": pa.array(np.concatenate((doc[own], low[met], doc[~own]))),
                "info": pa.array(np.concatenate((-1 - (info[own] >> 2), np.full(len(first), 3), info[~own]))),
            }

        return step

    rows = arrow_pass(text_docs, make, "deal bigint, h bigint, doc_id bigint, info bigint")

    def make_reduce():
        held: list[np.ndarray] = [np.zeros(0, np.int64)] * 3

        def settle(h, doc, info):
            at, met, _ = _meet(h, doc, info)
            hit = np.repeat(met, np.diff(at)) & (info & 1 == 0)
            return {"doc_id": pa.array(doc[hit]), "place": pa.array(info[hit] >> 2)}

        def step(batch: pa.RecordBatch):
            h, doc, info = (batch.column(i).to_numpy() for i in range(3))
            done = info < 0
            if done.any():
                yield {"doc_id": pa.array(doc[done]), "place": pa.array(-1 - info[done])}
                h, doc, info = h[~done], doc[~done], info[~done]
            h, doc, info = (np.concatenate((a, b)) for a, b in zip(held, (h, doc, info), strict=True))
            if not len(h):
                return
            cut = int(np.searchsorted(h, h[-1]))
            if cut:
                yield settle(h[:cut], doc[:cut], info[:cut])
            last = h[cut:], doc[cut:], info[cut:]
            _, met, low = _meet(*last)
            if met[0]:
                yield settle(*last)
                last = last[0][:1], low[:1], np.array([3])
            held[:] = last

        def finish():
            yield settle(*held)

        step.finish = finish
        return step

    dealt = rows.repartition("deal").select("h", "doc_id", "info").sortWithinPartitions("h")
    return arrow_pass(dealt, make_reduce, "doc_id bigint, place bigint").groupBy("doc_id").agg(F.collect_list("place").alias("places"))


def _version(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """A few bits of each text, so that rows which share an id but not a text don't mix."""
    s = np.zeros(len(h) + 1, np.uint64)
    np.add.accumulate(h, out=s[1:])
    return (mix(s[at[1:]] - s[at[:-1]]) >> np.uint64(64 - _VERSION_BITS)).astype(np.int64)


def _starts(places: pa.Array, at: np.ndarray, window: int, block: int) -> np.ndarray:
    """Places, in all words of the chunk, where a window starts that holds a hit block whole."""
    n = np.diff(at)
    total = int(at[-1])
    open_, flat = np.zeros(total + 1, np.int64), places.flatten().to_numpy()
    owner = np.repeat(np.arange(len(n)), np.asarray(pa.compute.list_value_length(places)))
    last = n[owner] - window
    low, high = np.maximum(flat + block - window, 0), np.minimum(flat, last)
    fine = (high >= low) & (last >= 0)
    base = at[:-1][owner][fine]
    np.add.at(open_, base + low[fine], 1)
    np.add.at(open_, base + high[fine] + 1, -1)
    return np.flatnonzero(np.cumsum(open_[:-1]) > 0)


def _removed(hit_docs: DataFrame, window: int, block: int) -> DataFrame:
    """(doc_id, starts): windows whose words also start in a document with a smaller id. Hits extend to maximal repeats, as every window over them is compared whole."""

    def make():
        def step(batch: pa.RecordBatch):
            ids = batch.column(0).to_numpy()
            h, at = word_hashes(*column_bytes(batch.column(1)))
            starts = _starts(batch.column(2), at, window, block)
            r = rolling(h, window)
            owner = text_of(at)[starts]
            place = ((starts - at[owner]) << _VERSION_BITS) | _version(h, at)[owner]
            order = np.lexsort((ids[owner], r[starts]))
            key, doc, place = signed(r[starts])[order], ids[owner][order], place[order]
            runs = _runs(key)
            low = np.repeat(doc[runs[:-1]], np.diff(runs))
            gone = doc > low
            keep = ~gone
            yield {
                "deal": pa.array(np.concatenate((signed(mix(doc[gone].view(np.uint64))), key[keep]))),
                "h": pa.array(np.concatenate((key[gone], key[keep]))),
                "doc_id": pa.array(np.concatenate((doc[gone], doc[keep]))),
                "place": pa.array(np.concatenate((-1 - place[gone], place[keep]))),
            }

        return step

    rows = arrow_pass(hit_docs, make, "deal bigint, h bigint, doc_id bigint, place bigint")

    def make_reduce():
        last: list = [None, None]  # the hash that is open, and its least document

        def step(batch: pa.RecordBatch):
            h, doc, place = (batch.column(i).to_numpy() for i in range(3))
            done = place < 0
            if done.any():
                yield {"doc_id": pa.array(doc[done]), "start": pa.array(-1 - place[done])}
                h, doc, place = h[~done], doc[~done], place[~done]
            if not len(h):
                return
            runs = _runs(h)
            low = doc[runs[:-1]]  # rows are sorted by document too
            if last[0] is not None and h[0] == last[0]:
                low = low.copy()
                low[0] = last[1]
            gone = doc > np.repeat(low, np.diff(runs))
            last[:] = h[-1], low[-1]
            yield {"doc_id": pa.array(doc[gone]), "start": pa.array(place[gone])}

        return step

    dealt = rows.repartition("deal").select("h", "doc_id", "place").sortWithinPartitions("h", "doc_id")
    return arrow_pass(dealt, make_reduce, "doc_id bigint, start bigint").groupBy("doc_id").agg(F.collect_list("start").alias("starts"))


def _kept(docs: DataFrame, window: int) -> DataFrame:
    """The result's rows; docs has doc_id, text and starts (null: nothing goes)."""

    def make():
        def step(batch: pa.RecordBatch):
            texts = [t.split() for t in batch.column(1).cast(pa.binary()).fill_null(b"").to_pylist()]
            counts, gone, digests = [], [], []
            starts = batch.column(2)
            h, at = word_hashes(*column_bytes(batch.column(1)))
            versions = _version(h, at) if starts.null_count < len(starts) else None
            for i, words in enumerate(texts):
                n, drop = len(words), 0
                if starts[i].is_valid:
                    s = starts.slice(i, 1).flatten().to_numpy()
                    s = s[(s & ((1 << _VERSION_BITS) - 1)) == versions[i]] >> _VERSION_BITS
                    cover = np.zeros(n + 1, np.int64)
                    np.add.at(cover, s, 1)
                    np.add.at(cover, s + window, -1)
                    gap = np.cumsum(cover[:-1]) > 0
                    drop = int(gap.sum())
                    words = [words[j] for j in np.flatnonzero(~gap)]
                counts.append(n)
                gone.append(drop)
                digests.append(hashlib.sha256(b" ".join(words)).hexdigest())
            yield {"doc_id": batch.column(0), "n_words": pa.array(counts, pa.int64()), "n_removed": pa.array(gone, pa.int64()), "kept_sha256": pa.array(digests)}

        return step

    return arrow_pass(docs, make, "doc_id bigint, n_words bigint, n_removed bigint, kept_sha256 string")


def substring_dedup(docs: DataFrame, window: int = WINDOW, block: int = BLOCK, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_words, n_removed, kept_sha256) of every row: words go that lie in a window of `window` words whose words also start in a document with a smaller id.

    Non-overlapping blocks are indexed by hash and probed by rolling windows, cut to those that a repeat must pick
    (see anchors); documents with hits are read again and every window over a hit is compared by a 64-bit hash of all
    its words. Rows that meet within a chunk are settled there, so a passage or a group of copies that a third of all
    rows share moves little and gathers in no task. Only ids are broadcast, behind a count. Defined results: a null or
    empty text has no words; a text shorter than the window keeps all; rows that share an id never remove each other's
    words; a row without an id keeps all and is no reference; other columns are ignored; an empty table gives none."""
    own = docs.select(docs[id_col].cast("long").alias("doc_id"), docs[text_col].alias("text"))
    known = own.where("doc_id is not null and text is not null")
    hits = written(_hits(known, window, block), "substring-hits")
    hit_docs = keep_ids(known, hits.select("doc_id"), "doc_id").join(hits, "doc_id")
    removed = written(_removed(hit_docs.select("doc_id", "text", "places"), window, block), "substring-removed")
    ids = removed.select("doc_id")
    rest = keep_ids(own, ids, "doc_id", "left_anti").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("starts"))
    cut = keep_ids(known, ids, "doc_id").join(removed, "doc_id").select("doc_id", "text", "starts")
    return _kept(rest, window).unionByName(_kept(cut, window)).unionByName(_kept(keep_ids(own.where("doc_id is not null and text is null"), ids, "doc_id").select("doc_id", "text", F.lit(None).cast("array<bigint>").alias("starts")), window))
