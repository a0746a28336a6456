"""Benchmark decontamination: one automaton over normalised items, which scans each normalised text once; places are mapped back to the text."""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _LOWER, arrow_pass, column_bytes, release, written

#: Bytes of windows and item ids that one automaton is built from. More are dealt to further ones, each with a pass of its own.
AUTOMATON_BYTES = 8 << 20
#: What ends a word, as a class that Java and RE2 share: ASCII but for digits and letters.
WORDS = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORD = np.zeros(256, bool)
_WORD[[*range(48, 58), *range(65, 91), *range(97, 123), *range(128, 256)]] = True
#: Stands between texts and is in no window.
_BETWEEN = 10


def item_windows(items: DataFrame, id_col: str, text_cols: list[str], width: int) -> DataFrame:
    """(window, item_id): each run of `width` words of an item's texts, or all words of a text that has fewer, joined and enclosed by spaces."""
    texts = F.explode(F.array(*[items[c] for c in text_cols]))
    words = items.select(items[id_col].cast("long").alias("item_id"), texts.alias("text")).select("item_id", F.regexp_extract_all(F.translate("text", UPPER, LOWER), F.lit(WORDS), F.lit(0)).alias("words")).where("size(words) > 0")
    at = F.explode(F.sequence(F.lit(1), F.greatest(F.size("words") - width + 1, F.lit(1))))
    runs = words.select("item_id", "words", at.alias("at"))
    return runs.select(F.concat(F.lit(" "), F.array_join(F.slice("words", F.col("at"), width), " "), F.lit(" ")).alias("window"), "item_id").distinct()


def normalised(texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Texts as one run of bytes: words in lower case, each with one space before and after it, and a mark before each text.

    Also, for each byte, its place in the texts' own bytes; the n+1 offsets of texts in the run; and where words start in it."""
    data, offsets = column_bytes(texts)
    n, texts_n = len(data), len(offsets) - 1
    place = np.arange(n) + 2 + 3 * np.repeat(np.arange(texts_n), np.diff(offsets))
    run, origin = np.full(n + 3 * texts_n, 32, np.uint8), np.zeros(n + 3 * texts_n, np.int64)
    run[place], origin[place] = np.where(_WORD[data], _LOWER[data], 32), np.arange(n)
    heads = offsets[:-1] + 3 * np.arange(texts_n)
    run[heads] = _BETWEEN
    blank = run == 32
    kept = np.ones(len(run), bool)
    kept[1:] = ~(blank[1:] & blank[:-1])
    run, origin = run[kept], origin[kept]
    starts = np.flatnonzero(run == _BETWEEN)
    word = _WORD[run]
    return run, origin, np.append(starts, len(run)), np.flatnonzero(word[1:] & ~word[:-1]) + 1


class Scanner:
    """An automaton over windows; called with texts it gives each one's hit words and the items whose windows occur."""

    def __init__(self, windows: list[bytes], items: list[list[int]]) -> None:
        import ahocorasick

        self.automaton = ahocorasick.Automaton()
        self.items = items
        for i, w in enumerate(windows):
            self.automaton.add_word(w.decode("latin-1"), (i, len(w)))
        self.automaton.make_automaton()
        self.any = bool(windows)

    def __call__(self, texts: pa.Array) -> tuple[np.ndarray, list[list[tuple[int, int, int]]], list[set[int]]]:
        """Numbers of words; stretches of hit words (start, end, words), in code points of the text; items."""
        run, origin, offsets, starts = normalised(texts)
        words = np.searchsorted(starts, offsets)
        n = len(offsets) - 1
        items: list[set[int]] = [set() for _ in range(n)]
        spans: list[list[tuple[int, int, int]]] = [[] for _ in range(n)]
        hits = list(self.automaton.iter(run.tobytes().decode("latin-1"))) if self.any else []
        if not hits:
            return np.diff(words), spans, items
        end = np.array([e for e, _ in hits], np.int64)
        size = np.array([v[1] for _, v in hits], np.int64)
        doc = np.searchsorted(offsets, end, side="right") - 1
        which = np.array([v[0] for _, v in hits], np.int64)
        for i, w in set(zip(doc.tolist(), which.tolist(), strict=True)):
            items[i].update(self.items[w])
        change = np.zeros(len(starts) + 1, np.int64)
        np.add.at(change, np.searchsorted(starts, end - size + 2), 1)  # the window's first byte is a space
        np.add.at(change, np.searchsorted(starts, end), -1)
        hit = np.cumsum(change[:-1]) > 0
        owner = np.repeat(np.arange(n), np.diff(words))
        edge = np.ones(len(hit), bool)
        edge[1:] = (hit[1:] != hit[:-1]) | (owner[1:] != owner[:-1])
        first = np.flatnonzero(edge & hit)
        every = np.append(np.flatnonzero(edge), len(hit))
        last = every[np.searchsorted(every, first) + 1] - 1
        data, own = column_bytes(texts)
        chars = np.cumsum((data & 0xC0) != 0x80)  # code points up to and with each byte
        blank = np.flatnonzero(run == 32)
        stop = origin[blank[np.searchsorted(blank, starts[last])] - 1]  # the last byte of the last word
        for i, a, b, k in zip(owner[first].tolist(), origin[starts[first]].tolist(), stop.tolist(), (last - first + 1).tolist(), strict=True):
            base = int(chars[own[i] - 1]) if own[i] else 0
            spans[i].append((int(chars[a]) - 1 - base, int(chars[b]) - base, k))
        return np.diff(words), spans, items


def _united(spans: list[tuple[int, int, int]], more: list[tuple[int, int, int]], text: str) -> list[tuple[int, int, int]]:
    """Two lists of stretches as one: those that meet, with no word between them, are joined and their words counted anew."""
    if not spans or not more:
        return spans or more
    out: list[list[int]] = []
    for a, b, _ in sorted([*spans, *more]):
        if out and (a <= out[-1][1] or not _words(text[out[-1][1] : a])):
            out[-1][1] = max(out[-1][1], b)
        else:
            out.append([a, b])
    return [(a, b, _words(text[a:b])) for a, b in out]


def _words(text: str) -> int:
    return len(normalised(pa.array([text]))[3])


def decontaminate(docs: DataFrame, items: DataFrame, *, width: int = 10, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_texts: tuple[str, ...] = ("text",)) -> DataFrame:
    """(doc_id, n_words, n_hit, items, spans) of every row: the words that stand in an occurrence of a window of a benchmark item, the ids of those items in ascending order, and the stretches of hit words (start, end in code points, words) of the text as it is.

    Windows are runs of `width` words of an item's texts; a text of fewer words is one window. They go to every task as
    one automaton, which scans each normalised text once; windows of more than AUTOMATON_BYTES are dealt to several
    automata, by window and item, with a pass and a written table for each. No row is shuffled. Defined results: a null
    or empty text has no words; an item without words has no window; an item without an id has its words hit and is
    not listed; items that share an id count as one; rows are judged each; other columns are ignored; an empty table
    gives none, and without items nothing is hit."""
    spark = docs.sparkSession
    windows = written(item_windows(items, item_col, list(item_texts), width), "windows")
    total = windows.agg(F.coalesce(F.sum(F.octet_length("window") + 16), F.lit(0))).first()[0]
    shards = max(1, math.ceil(total / AUTOMATON_BYTES))
    id_type = docs.schema[id_col].dataType.simpleString()
    found = "n_words bigint, items array<bigint>, spans array<struct<start:int,end:int,words:int>>"
    rows = docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text"))
    for shard in range(shards):
        own = windows.where(F.pmod(F.xxhash64("window", "item_id"), F.lit(shards)) == shard).toArrow()  # at most about AUTOMATON_BYTES
        known = spark.sparkContext.broadcast(_gathered(own))
        last = shard == shards - 1
        after = arrow_pass(rows, _scan(known, shard == 0, last), f"doc_id {id_type}, {'' if last else 'text string, '}{found}")
        rows = after if last else written(after, "scanned")
    release(windows)
    hit = F.aggregate("spans", F.lit(0).cast("long"), lambda a, s: a + s["words"])
    return rows.select("doc_id", "n_words", hit.alias("n_hit"), "items", "spans")


def _gathered(own: pa.Table) -> tuple[list[bytes], list[list[int]]]:
    by: dict[str, list[int]] = {}
    for w, i in zip(own.column("window").to_pylist(), own.column("item_id").to_pylist(), strict=True):
        by.setdefault(w, []).extend([] if i is None else [i])
    return [w.encode() for w in by], list(by.values())


def _scan(known, first: bool, last: bool):
    def make():
        scan = Scanner(*known.value)

        def step(batch: pa.RecordBatch):
            texts = batch.column("text")
            n_words, spans, items = scan(texts)
            if not first:
                before = [[tuple(s.values()) for s in own] for own in batch.column("spans").to_pylist()]
                spans = [_united(a, b, t or "") for a, b, t in zip(before, spans, texts.to_pylist(), strict=True)]
                items = [a | set(b) for a, b in zip(items, batch.column("items").to_pylist(), strict=True)]
            kind = pa.list_(pa.struct([("start", pa.int32()), ("end", pa.int32()), ("words", pa.int32())]))
            yield {"doc_id": batch.column("doc_id")} | ({} if last else {"text": texts}) | {"n_words": pa.array(n_words), "items": pa.array([sorted(i) for i in items], pa.list_(pa.int64())), "spans": pa.array([[dict(zip(("start", "end", "words"), s, strict=True)) for s in own] for own in spans], kind)}

        return step

    return make


def items_digest(items: Column) -> Column:
    """The hash of ids in the order of their decimal strings, comma-joined."""
    return F.sha2(F.array_join(F.array_sort(F.transform(items, lambda i: i.cast("string"))), ",").cast("binary"), 256)
