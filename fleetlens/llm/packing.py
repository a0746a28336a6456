"""Best-fit packing planned over a histogram of lengths."""

from __future__ import annotations

import bisect
import os
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import _SPACE, arrow_pass, column_bytes, sent, word_starts, written

#: Bytes of words and their ids that a task keeps, about, and of the texts that it looks up at once: a look-up goes over what is kept.
CACHE_BYTES, TEXT_BYTES = 24 << 20, 2 << 20
_MARKS = bytes(chr(i) in ".,;:!?#*$%&|<>" for i in range(256))


class WordIds:
    """The ids of a text, put together from those of its words; a word's ids don't depend on its neighbours.

    That holds for tokenizers whose pieces never cross white space and that drop it and the case; checked() holds a
    tokenizer against that. Ids are little-endian unsigned 32-bit bytes. What is kept is bounded in bytes and goes with
    the object, which is one task's. Words and their ids are Arrow arrays, and only words that are met for the first
    time become Python objects."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.tokenizer = Tokenizer.from_file(path)
        #: Words and their ids, and those before them: when the first half is full, it takes the place of the second.
        self.words, self.codes = self.older = pa.array([], pa.binary()), pa.array([], pa.large_binary())
        vocabulary = self.tokenizer.get_vocab()
        self.last = np.zeros(max(vocabulary.values()) + 1, bool)
        self.last[[i for t, i in vocabulary.items() if t.endswith("</w>")]] = True

    @property
    def cache(self) -> list[bytes]:
        return self.words.to_pylist()

    @property
    def held(self) -> int:
        return self.words.nbytes + self.codes.nbytes

    def encoded(self, texts: list[str], few: int) -> Iterator[np.ndarray]:
        """The ids of each text, a few texts at a time: what the tokenizer returns is much larger than its ids."""
        for i in range(0, len(texts), few):
            for e in self.tokenizer.encode_batch_fast(texts[i : i + few], add_special_tokens=False):
                yield np.array(e.ids, "<u4")

    def learn(self, words: pa.Array) -> tuple[np.ndarray, pa.Array]:
        """The ids of words that the store lacks, and the order they come in. Words of letters are one piece each, so many go in one text and are told apart by the ids that end a word."""
        texts = [w.decode("utf-8", "replace") for w in words.to_pylist()]
        letters = np.array([t.isalpha() for t in texts], bool)
        plain, single = np.flatnonzero(letters).tolist(), np.flatnonzero(~letters).tolist()
        lines = [plain[i : i + 256] for i in range(0, len(plain), 256)]
        order, ids, sizes = [], [], [np.zeros(1, np.int64)]
        for own, code in zip(lines, self.encoded([" ".join([texts[i] for i in own]) for own in lines], 16), strict=True):
            ends = np.flatnonzero(self.last[code]) + 1
            if len(ends) != len(own):
                single += own
                continue
            order += own
            ids.append(code)
            sizes.append(np.diff(ends, prepend=0))
        order += single
        alone = list(self.encoded([texts[i] for i in single], 1024))
        sizes.append(np.array([len(x) for x in alone], np.int64))
        code = np.concatenate([np.zeros(0, "<u4"), *ids, *alone])
        at = 4 * np.cumsum(np.concatenate(sizes))
        return np.array(order, np.int64), pa.Array.from_buffers(pa.large_binary(), len(order), [None, pa.py_buffer(at), pa.py_buffer(code)])

    def places(self, words: pa.Array) -> np.ndarray:
        """Where different words are in the store, which takes in those that it lacks."""
        at = _found(words, self.words)
        new = np.flatnonzero(at < 0)
        if len(new):
            old = _found(words.take(pa.array(new)), self.older[0])
            fresh = new[old < 0]
            order, codes = self.learn(words.take(pa.array(fresh)))
            new = np.concatenate((new[old >= 0], fresh[order]))
            at[new] = len(self.words) + np.arange(len(new))
            self.words = pa.concat_arrays([self.words, words.take(pa.array(new))])
            self.codes = pa.concat_arrays([self.codes, self.older[1].take(pa.array(old[old >= 0])), codes])
        pa.default_memory_pool().release_unused()  # a look-up's table is as large as the store
        return at

    def __call__(self, data: np.ndarray, offsets: np.ndarray) -> list[bytes]:
        """The ids of each of the texts that lie one after the other in data."""
        if self.held > CACHE_BYTES // 2:
            self.older = self.words, self.codes
            self.words, self.codes = self.words[:0], self.codes[:0]
        words, at = words_of(*parted(data, offsets))
        words = words.dictionary_encode()
        places = self.places(words.dictionary)
        codes = self.codes.take(pa.array(places[words.indices.to_numpy()]))
        ends = np.frombuffer(codes.buffers()[1], np.int64)[at].tolist()
        code = pa.py_buffer(b"") if codes.buffers()[2] is None else codes.buffers()[2]
        return [code[a:b].to_pybytes() for a, b in zip(ends[:-1], ends[1:], strict=True)]


def _found(words: pa.Array, among: pa.Array) -> np.ndarray:
    """Where each word is in an array, or -1."""
    return np.array(pc.index_in(words, among).fill_null(-1))


def words_of(data: np.ndarray, offsets: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    """The words of texts that lie one after the other, without the white space between them, and n+1 offsets of each text's words."""
    word, starts = ~_SPACE[data], word_starts(data, offsets)
    ends = np.zeros(len(starts) + 1, np.int32)
    np.cumsum(np.add.reduceat(word, starts, dtype=np.int32), out=ends[1:])
    return pa.Array.from_buffers(pa.binary(), len(starts), [None, pa.py_buffer(ends), pa.py_buffer(data[word])]), np.searchsorted(starts, offsets)


#: Texts that tell whether a tokenizer drops case and white space and lets no piece cross it.
PROBES = ("Hello  World", " lead and trail ", "a\nb\tc", "It's 12,3 x.y. End!", "MiXeD\r\ncase", "\u00c9t\u00e9 \u00df \u0130 \u03a3", "one two three four five six")


def checked(path: str) -> None:
    """Fails for a tokenizer whose ids of a text aren't those of its words."""
    own = WordIds(path)
    got = own(*column_bytes(pa.array(PROBES)))
    for text, ids in zip(PROBES, got, strict=True):
        if np.frombuffer(ids, "<u4").tolist() != own.tokenizer.encode(text, add_special_tokens=False).ids:
            raise ValueError(f"{path}: the ids of {text!r} aren't those of its words; such a tokenizer can't be used here")


def parted(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The texts with A-Z lowered and a space before marks that follow a letter (a-z, U+00C0 to U+00FF) and end its word: pieces stay as they are, and there are fewer different words. Texts that may spell a special token stay as they are."""
    code = data.tobytes()
    if b"<|" in code or not code:
        return data, offsets
    code = code.lower()
    data, marks = np.frombuffer(code, np.uint8), np.flatnonzero(np.frombuffer(code.translate(_MARKS), bool))
    before = data[marks - 1]
    letter = (before >= 97) & (before <= 122) | (marks > 1) & (data[np.maximum(marks - 2, 0)] == 0xC3) & (before != 0x97) & (before != 0xB7)
    split = marks[letter]
    split = split[~np.isin(split, offsets)]
    # marks go on to the end of the word: what follows them is white space, or their text ends there
    over = marks[np.diff(marks, append=len(data) + 1) > 1] + 1
    stop = np.minimum(over[np.searchsorted(over, split, side="right")], offsets[np.searchsorted(offsets, split, side="right")])
    split = split[np.isin(stop, offsets) | _SPACE[data[np.minimum(stop, len(data) - 1)]]]
    return np.insert(data, split, 32), offsets + np.searchsorted(split, offsets)


def tokenised(docs: DataFrame, tokenizer: str, room: int, end_id: int, id_col: str, text_col: str) -> DataFrame:
    """A row for each piece: doc_id, piece, start, length, ids_crc32, and pid and nth, its place among the pieces of its length in its partition."""
    end = np.array([end_id], "<u4").tobytes()

    def make():
        ids, seen, pid = WordIds(tokenizer), np.zeros(room + 1, np.int64), TaskContext.get().partitionId()

        def step(batch: pa.RecordBatch):
            rows: list[tuple] = []
            doc: list[int] = []
            for i, code in enumerate(ids(*column_bytes(batch.column(1)))):
                code += end
                for piece, at in enumerate(range(0, len(code), 4 * room)):
                    part = code[at : at + 4 * room]
                    n = len(part) // 4
                    rows.append((piece, at // 4, n, zlib.crc32(part), pid, seen[n]))
                    seen[n] += 1
                    doc.append(i)
            yield {"doc_id": batch.column(0).take(pa.array(doc))} | {c: pa.array(v) for c, v in zip(("piece", "start", "length", "ids_crc32", "pid", "nth"), (np.array(x, np.int64) for x in zip(*rows, strict=True)), strict=True)} | {"piece": pa.array([r[0] for r in rows], pa.int32())}

        return step

    id_type = docs.schema[id_col].dataType.simpleString()
    return arrow_pass(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), make, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, pid bigint, nth bigint", TEXT_BYTES)


def plan_bins(counts: dict[int, int], room: int) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: (length, first rank, first bin, items a bin, offset) of each stretch of slots.

    Bins alike, in number and room, are held as one group, so the work depends on the number of lengths and not on
    that of documents. The longest goes first; each takes the fullest bin it fits in, and stays there while it fits."""
    open_bins: dict[int, list[tuple[int, int]]] = {}  # room left -> groups (first bin, bins)
    sizes: list[int] = []
    plan, bins = [], 0

    def put(left: int, first: int, n: int) -> None:
        if n and left:
            if left not in open_bins:
                open_bins[left] = []
                bisect.insort(sizes, left)
            open_bins[left].append((first, n))

    for length in sorted(counts, reverse=True):
        todo, rank = counts[length], 0
        while todo:
            i = bisect.bisect_left(sizes, length)
            if i < len(sizes):
                left = sizes[i]
                first, n = open_bins[left].pop()
                if not open_bins[left]:
                    del open_bins[left], sizes[i]
            else:
                left, first, n = room, bins, -1
            each = left // length
            full, rest = divmod(todo, each)
            if n < 0:
                n = full + (rest > 0)
                bins += n
            full = min(full, n)
            rest = rest if full < n else 0
            if full:
                plan.append((length, rank, first, each, room - left))
                put(left - each * length, first, full)
                rank += full * each
            if rest:
                plan.append((length, rank, first + full, rest, room - left))
                put(left - rest * length, first + full, 1)
                rank += rest
            put(left, first + full + (rest > 0), n - full - (rest > 0))
            todo -= full * each + rest
    return plan


def pack(docs: DataFrame, tokenizer: str, room: int = 4096, end_id: int = 1, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32, sequence_id, offset) of each piece of every row.

    Texts are tokenised once, into a written table of lengths. The plan is made on the driver from how many pieces
    have each length, `room` numbers at most. A tokenizer whose ids can't be put together from words is refused. Pieces take its slots by their rank within their length, which is the
    place in their partition plus the pieces in partitions before, so no length is gathered or sorted in one task.
    Defined results: a null or empty text is one piece of the end id; repeated rows are packed each; a text longer
    than room is cut, and only such; other columns are ignored; without rows there are none."""
    checked(tokenizer)
    pieces = written(tokenised(docs, tokenizer, room, end_id, id_col, text_col), "pack-pieces")
    by_part = pieces.groupBy("pid", "length").agg(F.count("*").alias("n"))
    by_part = written(by_part, "pack-counts")
    counts = {r["length"]: r.n for r in by_part.groupBy("length").agg(F.sum("n").alias("n")).collect()}  # room rows at most
    before = by_part.select("pid", "length", (F.sum("n").over(Window.partitionBy("length").orderBy("pid")) - F.col("n")).alias("before"))
    plan = np.array(sorted(plan_bins(counts, room)), np.int64).reshape(-1, 5)
    placed = pieces.join(sent(before), ["pid", "length"]).select("doc_id", "piece", "start", "length", "ids_crc32", (F.col("before") + F.col("nth")).alias("rank"))

    def make():
        keys = plan[:, 0] * (1 << 48) + plan[:, 1]

        def step(batch: pa.RecordBatch):
            length, rank = batch.column("length").to_numpy(), batch.column("rank").to_numpy()
            at = plan[np.searchsorted(keys, length * (1 << 48) + rank, side="right") - 1]
            k = rank - at[:, 1]
            out = {c: batch.column(c) for c in ("doc_id", "piece", "start", "length", "ids_crc32")}
            yield out | {"sequence_id": pa.array(at[:, 2] + k // at[:, 3]), "offset": pa.array(at[:, 4] + k % at[:, 3] * length)}

        return step

    id_type = docs.schema[id_col].dataType.simpleString()
    return arrow_pass(placed, make, f"doc_id {id_type}, piece int, start bigint, length bigint, ids_crc32 bigint, sequence_id bigint, offset bigint")
