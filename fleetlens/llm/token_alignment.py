"""Alignment of two tokenizers: token ends as packed bitsets, shared cuts by AND, token ranges by rank and select, links by expansion."""

from __future__ import annotations

import math
import os
import re
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, arrow_pass, column_bytes, release, written

#: Bytes of units and what is known of them that a task keeps, about, and what a unit takes besides its characters, groups and pairs.
STORE_BYTES, UNIT_BYTES = 48 << 20, 80
#: Pairs that are expanded at once, and pairs that a task counts before it hands on what it has.
PAIRS_AT_ONCE = 1 << 20
#: Bytes that a pair's count takes in a task.
PAIR_BYTES = 24
#: Non-ASCII white space and marks without width: a text with one of them isn't cut into units.
_UNSURE = re.compile("[\u0085\u00a0\u1680\u180e\u2000-\u200f\u2028-\u202f\u205f-\u206f\u2581\u3000\ufeff]")
_BLANK = np.zeros(256, bool)
_BLANK[[9, 10, 11, 12, 13, 32]] = True
_CUT = np.zeros(256, bool)
_CUT[[10, 32]] = True
#: Units that are encoded as one text where that is sure to give the ids of each.
LINE_UNITS = 256


def byte_level() -> dict[str, int]:
    """The byte that each character of a byte-level vocabulary stands for: printable ones for themselves, the others by their order from U+0100 on."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in plain]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(other)}


class Tokenizers:
    """A byte-level tokenizer (A, tokenizers' JSON) and a piece tokenizer (B, a sentencepiece model that adds a space), with the bytes of each id."""

    def __init__(self, path_a: str, path_b: str) -> None:
        import sentencepiece
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        self.a = Tokenizer.from_file(path_a)
        self.a.encode_special_tokens = True
        self.b = sentencepiece.SentencePieceProcessor(model_file=path_b)
        decode, vocabulary = byte_level(), self.a.get_vocab()
        self.bytes_a = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            self.bytes_a[i] = bytes(decode[c] for c in token) if all(c in decode for c in token) else token.encode()
        pieces = [self.b.id_to_piece(i) for i in range(self.b.get_piece_size())]
        self.bytes_b = [bytes([int(p[3:5], 16)]) if self.b.is_byte(i) else p.replace("\u2581", " ").encode() for i, p in enumerate(pieces)]
        self.space = self.b.piece_to_id("\u2581")
        #: No piece goes on from another character into a space, nor holds a line end: then B's ids before one don't depend on what follows.
        self.cuts = not any(re.search("[^\u2581]\u2581|\n", p) for p in pieces)

    def encode(self, units: list[str]) -> tuple[list[list[int]], list[list[int]]]:
        """Ids of units, each of which starts with white space; B adds a space to what it is given, unless that is empty."""
        a = [e.ids for e in self.a.encode_batch_fast(units, add_special_tokens=False)]
        b = self.b.encode([u[1:] if u[0] == " " else u for u in units], num_threads=1)
        return a, [[self.space] if u == " " else ids if u[0] == " " else ids[1:] if ids[:1] == [self.space] else [] for u, ids in zip(units, b, strict=True)]


def bitset(ends: np.ndarray, size: int) -> np.ndarray:
    """Positions as a packed set of 64-bit words."""
    bits = np.zeros((size // 64 + 1) * 64, bool)
    bits[ends] = True
    return np.packbits(bits, bitorder="little").view("<u8")


def selected(bits: np.ndarray) -> np.ndarray:
    """The positions of a packed set."""
    return np.flatnonzero(np.unpackbits(bits.view(np.uint8), bitorder="little"))


def ranks(bits: np.ndarray, at: np.ndarray) -> np.ndarray:
    """How many positions of the set are at or before each of `at`."""
    ones = np.bitwise_count(bits).astype(np.int64)
    word, shift = at >> 6, (63 - (at & 63)).astype(np.uint64)
    return (np.cumsum(ones) - ones)[word] + np.bitwise_count(bits[word] << shift)


def _counted(keys: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, and the sums of n."""
    if not len(keys):
        return keys, n
    order = np.argsort(keys, kind="stable")
    keys = keys[order]
    first = np.flatnonzero(np.concatenate(([True], keys[1:] != keys[:-1])))
    return keys[first], np.add.reduceat(n[order], first)


def merged(own: np.ndarray, key: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Distinct (own, key) in order, and the sums of n."""
    if not len(own):
        return own, key, n
    span = int(key.max()) + 1
    order = np.argsort(own * span + key) if (int(own.max()) + 1) * span < 1 << 62 else np.lexsort((key, own))
    own, key = own[order], key[order]
    first = np.flatnonzero(np.concatenate(([True], (own[1:] != own[:-1]) | (key[1:] != key[:-1]))))
    return own[first], key[first], np.add.reduceat(n[order], first)


def stretches(starts: np.ndarray, n: np.ndarray) -> np.ndarray:
    """The positions of stretches of n from each start, one after the other."""
    return np.arange(int(n.sum())) + np.repeat(starts - (np.cumsum(n) - n), n)


def _strings(offsets: np.ndarray, data, kind: pa.DataType | None = None) -> pa.Array:
    """An Arrow array of the bytes between offsets, without a copy."""
    data = pa.py_buffer(b"") if data is None else data
    return pa.Array.from_buffers(kind or pa.large_binary(), len(offsets) - 1, [None, pa.py_buffer(np.ascontiguousarray(offsets, np.int64)), data])


def _offsets(strings: pa.Array) -> np.ndarray:
    return np.frombuffer(strings.buffers()[1], np.int64)[strings.offset : strings.offset + len(strings) + 1]


def expanded(group: np.ndarray, ids: np.ndarray, group_b: np.ndarray, ids_b: np.ndarray, n_b: int, owner: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, pair, links): the links of ids that share a group, summed up by the group's owner. pair is a * n_b + b.

    Ids repeated in a group are met once, with their numbers; groups of very many ids are expanded in slices."""
    (ka, na), (kb, nb) = (_counted(g.astype(np.int64) << 32 | i, np.ones(len(i), np.int64)) for g, i in ((group, ids), (group_b, ids_b)))
    ga, gb = ka >> 32, kb >> 32
    low, high = np.searchsorted(gb, ga), np.searchsorted(gb, ga, side="right")
    width = high - low
    ends, parts, at = np.cumsum(width), [], 0
    while at < len(ka):
        stop = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PAIRS_AT_ONCE, side="right")))
        w = width[at:stop]
        row = np.repeat(np.arange(at, stop), w)
        other = np.arange(len(row)) - np.repeat(np.cumsum(w) - w, w) + low[row]
        parts.append(merged(owner[ga[row]], (ka[row] & 0xFFFFFFFF) * n_b + (kb[other] & 0xFFFFFFFF), na[row] * nb[other]))
        at = stop
    if not parts:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    return tuple(np.concatenate(c) for c in zip(*parts, strict=True))


class Units:
    """What is known of units of text. A unit is a stretch before which both tokenizers are sure to cut; its tokens, groups and links don't depend on its neighbours.

    What is kept is bounded in bytes and goes with the object, which is one task's. Beyond the bound, the units that the most batches had stay, within half of it."""

    def __init__(self, path_a: str, path_b: str) -> None:
        self.tokenizers = Tokenizers(path_a, path_b)
        self.n_a, self.n_b = len(self.tokenizers.bytes_a), len(self.tokenizers.bytes_b)
        self.len_a, self.len_b = (np.array([len(x) for x in own], np.int64) for own in (self.tokenizers.bytes_a, self.tokenizers.bytes_b))
        #: An id of A before another and at its group's end, then those of B.
        self.said = pa.array([f"{i}{c}".encode() for n, ends in ((self.n_a, ",|"), (self.n_b, ",;")) for i in range(n) for c in ends], pa.large_binary())
        self.clear()

    def clear(self) -> None:
        self.known = pa.array([], pa.large_binary())
        #: A unit's groups, each followed by a semicolon.
        self.groups = pa.array([], pa.large_binary())
        #: A row a unit: tokens of A and B, groups, links, whether both tokenizers give its bytes back, pairs.
        self.numbers = np.zeros((0, 6), np.int64)
        #: How many batches had a unit; halved whenever units are dropped.
        self.met = np.zeros(0, np.int64)
        self.pairs, self.links, self.held = np.zeros(0, np.int64), np.zeros(0, np.int64), 0

    def sizes(self) -> np.ndarray:
        return UNIT_BYTES + np.diff(_offsets(self.known)) + np.diff(_offsets(self.groups)) + 16 * self.numbers[:, 5]

    def of_units(self, ids: np.ndarray) -> np.ndarray:
        """Where the pairs of units are."""
        return stretches((np.cumsum(self.numbers[:, 5]) - self.numbers[:, 5])[ids], self.numbers[ids, 5])

    def shrink(self) -> None:
        """Drops the units that the fewest batches had, of equal ones the oldest."""
        order = np.lexsort((-np.arange(len(self.met)), -self.met))
        size = self.sizes()
        keep = np.sort(order[np.cumsum(size[order]) <= STORE_BYTES // 2])
        place = self.of_units(keep)
        self.pairs, self.links = self.pairs[place], self.links[place]
        self.known, self.groups = self.known.take(pa.array(keep)), self.groups.take(pa.array(keep))
        self.numbers, self.met, self.held = self.numbers[keep], self.met[keep] // 2, int(size[keep].sum())

    def encoded(self, units: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """Of units: whether both tokenizers give their bytes back; the numbers of those that do, in the order in which they were encoded, and in that order the ids of A and of B.

        Units between which both are sure to cut are encoded many at a time. Where the tokens of such a line end with each unit and give its bytes back, they are those of its units; any other line is encoded unit by unit."""
        t, lengths = self.tokenizers, (self.len_a, self.len_b)
        sure = [i for i, u in enumerate(units) if t.cuts and u[0] == 32 and u[-1] not in b" \t\n\v\f\r"]
        lines = [sure[i : i + LINE_UNITS] for i in range(0, len(sure), LINE_UNITS)]
        texts = [b"".join([units[i] for i in line]).decode() for line in lines]
        sound = [x.isascii() or not _UNSURE.search(x) for x in texts]
        lines, texts = list(compress(lines, sound)), list(compress(texts, sound))
        codes = [x.encode() for x in texts]
        both = t.encode(texts) if lines else ([], [])
        good, single = np.ones(len(units), bool), set(range(len(units))).difference(*lines)
        order: list[int] = []
        ids: tuple[list, list] = ([], [])
        for line, code, *own in zip(lines, codes, *both, strict=True):
            ends, fit = np.cumsum([*map(len, map(units.__getitem__, line))]), True
            for x, table, length in zip(own, (t.bytes_a, t.bytes_b), lengths, strict=True):
                to = np.cumsum(length[x])
                fit = fit and b"".join(map(table.__getitem__, x)) == code and bool((to[np.searchsorted(to, ends)] == ends).all())
            if not fit:
                single.update(line)
                continue
            order += line
            for k in (0, 1):
                ids[k].append(np.array(own[k], np.int64))
        rest = sorted(single)
        kept = []
        for i, *own in zip(rest, *(t.encode([units[i].decode() for i in rest]) if rest else ([], [])), strict=True):
            good[i] = b"".join(map(t.bytes_a.__getitem__, own[0])) == units[i] == b"".join(map(t.bytes_b.__getitem__, own[1]))
            if good[i]:
                kept.append(own)
                order.append(i)
        for k in (0, 1):
            ids[k].append(np.array(list(chain.from_iterable(own[k] for own in kept)), np.int64))
        return good, np.array(order, np.int64), *[np.concatenate(x) for x in ids]

    def learn(self, units: list[bytes]) -> None:
        good, use, flat_a, flat_b = self.encoded(units)
        size = np.cumsum([len(units[i]) for i in use.tolist()], dtype=np.int64)
        n, numbers, groups, data = len(units), np.zeros((len(units), 6), np.int64), np.zeros(1, np.int64), None
        if len(use):
            ends_a, ends_b = (bitset(np.cumsum(length[ids]), int(size[-1]) + 1) for length, ids in ((self.len_a, flat_a), (self.len_b, flat_b)))
            cuts = selected(ends_a & ends_b)
            to_a, to_b = ranks(ends_a, cuts), ranks(ends_b, cuts)
            in_a, in_b = np.diff(to_a, prepend=0), np.diff(to_b, prepend=0)
            stop = np.searchsorted(cuts, size, side="right")
            first = np.concatenate(([0], stop[:-1]))
            owner = np.repeat(use, stop - first)
            group = np.arange(len(cuts))
            group_a, group_b = np.repeat(group, in_a), np.repeat(group, in_b)
            own, pair, links = merged(*expanded(group_a, flat_a, group_b, flat_b, self.n_b, owner))
            for c, v in enumerate((in_a, in_b, np.ones_like(in_a), in_a * in_b)):
                numbers[use, c] = np.add.reduceat(v, first)
            numbers[:, 5] = np.bincount(own, minlength=n)
            self.pairs, self.links = np.concatenate((self.pairs, pair)), np.concatenate((self.links, links))
            code = np.zeros(len(flat_a) + len(flat_b), np.int64)  # of each group the ids of A, then those of B
            in_order = np.arange(len(flat_a))
            code[in_order + (to_b - in_b)[group_a]] = 2 * flat_a + (in_order == to_a[group_a] - 1)
            in_order = np.arange(len(flat_b))
            code[in_order + to_a[group_b]] = 2 * (self.n_a + flat_b) + (in_order == to_b[group_b] - 1)
            said = self.said.take(pa.array(code))
            groups, data = _offsets(said)[np.concatenate(([0], (to_a + to_b)[stop - 1]))], said.buffers()[2]
        numbers[:, 4] = good
        place = np.full(n, len(use))
        place[use] = np.arange(len(use))
        own = _strings(np.append(groups, groups[-1]), data).take(pa.array(place))
        new = pa.array(units, pa.large_binary())
        self.known, self.groups = pa.concat_arrays([self.known, new]), pa.concat_arrays([self.groups, own])
        self.numbers, self.met = np.concatenate((self.numbers, numbers)), np.concatenate((self.met, np.zeros(n, np.int64)))
        self.held += UNIT_BYTES * n + sum(map(len, units)) + int(_offsets(own)[-1]) + 16 * int(numbers[:, 5].sum())

    def cut(self, texts: pa.Array) -> tuple[pa.Array, np.ndarray]:
        """The units of texts, a space put before each, and the n+1 offsets of each text's units; null and empty texts have none."""
        data, offsets = column_bytes(texts)
        if not len(data):
            return self.known[:0], np.zeros(len(offsets), np.int64)
        inner = _CUT[data]
        inner[1:] &= ~_BLANK[data[:-1]]
        starts = offsets[:-1][np.diff(offsets) > 0]
        inner[starts] = False  # the space put before a text may be the head of a longer run
        if not self.tokenizers.cuts:
            inner[:] = False
        elif not data.tobytes().isascii():
            for i, t in enumerate(texts.to_pylist()):
                if t and _UNSURE.search(t):
                    inner[offsets[i] : offsets[i + 1]] = False
        heads = np.sort(np.concatenate((np.flatnonzero(inner), starts)))
        ends = np.append(heads + np.searchsorted(starts, heads), len(data) + len(starts))
        return _strings(ends, pa.py_buffer(np.insert(data, starts, 32))), np.searchsorted(heads, offsets)

    def __call__(self, texts: pa.Array) -> dict:
        """Columns of alignments() for texts."""
        if self.held > STORE_BYTES:
            self.shrink()
        units, at = self.cut(texts)
        coded = units.dictionary_encode()
        found = pc.index_in(coded.dictionary, value_set=self.known)
        place = found.fill_null(-1).to_numpy().astype(np.int64)
        fresh = coded.dictionary.filter(found.is_null()).to_pylist()
        place[place < 0] = len(self.known) + np.arange(len(fresh))
        size, lo = 0, 0
        for hi, u in enumerate(fresh, 1):  # in parts, so that what is built at once is bounded
            size += len(u)
            if size > PAIRS_AT_ONCE or hi == len(fresh):
                self.learn(fresh[lo:hi])
                size, lo = 0, hi
        self.met[place] += 1
        ids = place[coded.indices.to_numpy()]
        doc = np.repeat(np.arange(len(texts)), np.diff(at))
        bad = np.zeros(len(texts), bool)
        bad[doc[self.numbers[ids, 4] == 0]] = True
        run = np.zeros((len(ids) + 1, 4), np.int64)
        np.cumsum(self.numbers[ids, :4], axis=0, out=run[1:])
        sums = run[at[1:]] - run[at[:-1]]
        sums[bad] = 0
        kept = ~bad[doc]
        ids, doc = ids[kept], doc[kept]
        said = self.groups.take(pa.array(ids))
        ends = _offsets(said)[np.searchsorted(doc, np.arange(len(texts) + 1))]
        groups = pc.ascii_rtrim(_strings(ends, said.buffers()[2], pa.large_string()), characters=";").cast(pa.string())
        doc, ids, times = merged(doc, ids, np.ones(len(ids), np.int64))
        n, place = self.numbers[ids, 5], self.of_units(ids)
        own, pair, links = merged(np.repeat(doc, n), self.pairs[place], self.links[place] * np.repeat(times, n))
        ends = np.searchsorted(own, np.arange(len(texts) + 1)).tolist()
        packed = [planes(pair[i:j], links[i:j]) for i, j in zip(ends[:-1], ends[1:], strict=True)]
        return {"n_a": pa.array(sums[:, 0]), "n_b": pa.array(sums[:, 1]), "n_groups": pa.array(sums[:, 2]), "n_links": pa.array(sums[:, 3]), "groups": groups, "links": pa.array(packed, pa.binary())}


def planes(pair: np.ndarray, links: np.ndarray) -> bytes:
    """Pairs and their links, byte by byte of all of them: high bytes are alike, so that they take little when written."""
    both = np.stack((pair, links)).astype(">i8").view(np.uint8).reshape(2, len(pair), 8)
    return np.ascontiguousarray(both.transpose(0, 2, 1)).tobytes()


def from_planes(code: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    both = np.ascontiguousarray(code.reshape(2, 8, -1).transpose(0, 2, 1)).view(">i8").reshape(2, -1).astype(np.int64)
    return both[0], both[1]


def unpacked(column: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(row, pair, links) of a column of planes."""
    offsets = np.frombuffer(column.buffers()[1], np.int32)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(column.buffers()[2], np.uint8) if column.buffers()[2] is not None else np.zeros(0, np.uint8)
    own = [from_planes(data[i:j]) for i, j in zip(offsets[:-1].tolist(), offsets[1:].tolist(), strict=True)]
    row = np.repeat(np.arange(len(own)), [len(p) for p, _ in own])
    pair, links = (np.concatenate([x[c] for x in own]) if own else np.zeros(0, np.int64) for c in (0, 1))
    return row, pair, links


def alignments(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """(doc_id, n_a, n_b, n_groups, n_links, groups, links) of every row's text, with a space before it, by two tokenizers.

    Token ends are packed bitsets over the bytes; their AND has the shared cuts, and the ranks of a cut in both sets are
    the token ranges of the groups between. groups lists them as a1,a2|b1;a3|b2,b3; links holds each pair of ids of the
    text with its number of links (unpacked() reads it). Units of text that both tokenizers are sure to cut before are
    aligned once and kept, within bounded bytes; a text with white space outside ASCII is a unit of its own. One pass
    without a shuffle. Defined results: a text that is null or empty, or whose bytes the tokens don't give back, has no
    tokens: zeros and empty columns; rows are aligned each; other columns are ignored; an empty table gives none."""

    def make():
        units = Units(tokenizer_a, tokenizer_b)

        def step(batch: pa.RecordBatch):
            yield {"doc_id": batch.column(0)} | units(batch.column(1))

        return step

    id_type = docs.schema[id_col].dataType.simpleString()
    return arrow_pass(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), make, f"doc_id {id_type}, n_a bigint, n_b bigint, n_groups bigint, n_links bigint, groups string, links binary")


def pair_counts(rows: DataFrame) -> DataFrame:
    """(pair, n): how many rows hold a pair linked. Tasks sum up before anything moves, and hand on what they have at PAIRS_AT_ONCE pairs."""

    def make():
        held = [np.zeros(0, np.int64), np.zeros(0, np.int64)]

        def handed():
            out = {"pair": pa.array(held[0]), "n": pa.array(held[1])}
            held[:] = np.zeros(0, np.int64), np.zeros(0, np.int64)
            return out

        def step(batch: pa.RecordBatch):
            _, pair, _ = unpacked(batch.column(0))
            held[:] = _counted(np.concatenate((held[0], pair)), np.concatenate((held[1], np.ones(len(pair), np.int64))))
            if len(held[0]) > PAIRS_AT_ONCE:
                yield handed()

        def finish():
            yield handed()

        step.finish = finish
        return step

    return arrow_pass(rows.select("links"), make, "pair bigint, n bigint").groupBy("pair").agg(F.sum("n").alias("n"))


def with_counts(aligned: DataFrame, n_b: int) -> DataFrame:
    """The rows of alignments() without links and with n_best and count_sum: links whose pair is in as many rows as any pair of its A id, and the sum over links of the rows that hold their pair.

    Pairs of two vocabularies are far fewer than links, and what a row holds of them is looked up where the row is:
    counts go to the tasks in shards of at most BROADCAST_BYTES, dealt by A id, one pass of the rows for each shard."""
    rows = written(aligned, "align-rows")
    counts = written(pair_counts(rows), "align-pairs")
    shards = max(1, math.ceil(counts.count() * PAIR_BYTES / BROADCAST_BYTES))
    keep = [c for c in rows.columns if c != "links"]
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema if f.name != "links")
    now = rows.withColumns({"n_best": F.lit(0).cast("long"), "count_sum": F.lit(0).cast("long")})
    for shard in range(shards):
        own = counts.where(F.pmod(F.xxhash64(F.floor(F.col("pair") / n_b)), F.lit(shards)) == shard).toArrow()  # at most about BROADCAST_BYTES
        pair, n = own.column("pair").to_numpy(), own.column("n").to_numpy()
        order = np.argsort(pair)
        last = shard == shards - 1
        after = arrow_pass(now, _looked_up(rows.sparkSession.sparkContext.broadcast((pair[order], n[order])), n_b, keep, last), f"{schema}{'' if last else ', links binary'}, n_best bigint, count_sum bigint")
        now = after if last else written(after, "align-sums")
    release(counts)
    return now


def _looked_up(known, n_b: int, keep: list[str], last: bool):
    def make():
        pair, n = known.value
        if len(pair):
            first = np.flatnonzero(np.concatenate(([True], pair[1:] // n_b != pair[:-1] // n_b)))
            best = n == np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(n)))

        def step(batch: pa.RecordBatch):
            own = {c: batch.column(c) for c in keep} | ({} if last else {"links": batch.column("links")})
            out = [batch.column(c).to_numpy().copy() for c in ("n_best", "count_sum")]
            row, p, links = unpacked(batch.column("links"))
            if len(p) and len(pair):
                at = np.minimum(np.searchsorted(pair, p), len(pair) - 1)
                hit = pair[at] == p
                row, at, links = row[hit], at[hit], links[hit]
                np.add.at(out[0], row, links * best[at])
                np.add.at(out[1], row, links * n[at])
            yield own | {"n_best": pa.array(out[0]), "count_sum": pa.array(out[1])}

        return step

    return make


def align_tokenizers(docs: DataFrame, tokenizer_a: str, tokenizer_b: str, *, id_col: str = "doc_id", text_col: str = "text", groups: str = "text") -> DataFrame:
    """alignments() with the counts of with_counts(). groups="sha256" gives the groups' hash in their place (empty without tokens), so that they are never written.

    Defined results as in both; rows that repeat count each."""
    aligned = alignments(docs, tokenizer_a, tokenizer_b, id_col=id_col, text_col=text_col)
    if groups == "sha256":
        aligned = aligned.withColumn("groups_sha256", F.when(F.col("n_a") > 0, F.sha2(F.col("groups").cast("binary"), 256)).otherwise("")).drop("groups")
    import sentencepiece

    return with_counts(aligned, sentencepiece.SentencePieceProcessor(model_file=tokenizer_b).get_piece_size())
