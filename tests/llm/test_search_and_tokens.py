"""Hard negatives, decontamination and token alignment against brute force: ties, repeats, nulls, empty and long texts, clashing columns, empty tables."""

from __future__ import annotations

import hashlib
import random
from collections import Counter

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from fleetlens.llm import decontamination, hard_negatives, queries, token_alignment

from . import brute

A, B = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
SMALL = "/root/testdata/sf0.001"
VECTORS = "vec_id long, embedding array<double>, label int, id long, v string, slot int, asks string"


def vectors(spark, rows):
    return spark.createDataFrame([(i, v, label, 7, "x", 3, "y") for i, v, label in rows], VECTORS).repartition(3)


def mined(spark, rows, **kw):
    got = hard_negatives.hard_negatives(vectors(spark, rows), "vec_id", "embedding", "label", F.col("vec_id") % 10 == 0, **kw)
    return sorted(map(tuple, got.collect()))


def test_hard_negatives(spark, monkeypatch):
    rng = np.random.default_rng(4)
    rows = [(i, [round(float(x), 2) for x in rng.normal(0.05, 0.1, 19)], int(rng.integers(0, 4))) for i in range(260)]
    rows += [(300 + i, rows[10][1], i % 2) for i in range(90)]  # one vector, two labels: ties
    rows += [(400, None, 1), (410, [None] * 19, 1), (420, [float("nan")] * 19, 1), (430, [float("inf")] * 19, 1), (440, rows[1][1], None), (None, rows[2][1], 1), (450, [0.5], 2), (460, [], 2), (470, rows[3][1], 9)]
    rows += [rows[20], rows[20], (20, rows[21][1], 3)]
    want = sorted(brute.hard_negatives(rows, 5, 10, 30, 90, 10))
    assert len(want) > 500 and mined(spark, rows) == want
    monkeypatch.setattr(hard_negatives, "ANCHORS", 9)  # several waves
    monkeypatch.setattr(hard_negatives, "SEED_ROWS", 20)
    assert mined(spark, rows) == want
    assert mined(spark, rows, positives=2, negatives=3, low=-20, high=70) == sorted(brute.hard_negatives(rows, 2, 3, -20, 70, 10))
    assert mined(spark, rows[:0]) == [] and mined(spark, [(1, [1.0], 0), (2, [1.0], 1)]) == []


def test_hard_negatives_of_huge_components(spark):
    rows = [(0, [2e9, 1.0], 0), (1, [2e9, 2.0], 0), (2, [1e9, 5.0], 1), (3, [1e9, 5.001], 1), (4, [3e9, 0.0], 1), (5, [-1e9, 0.0], 1)]
    got = mined(spark, rows)
    assert [(r[0], r[1], r[2], r[3]) for r in got] == [(r[0], r[1], r[2], r[3]) for r in sorted(brute.hard_negatives(rows, 5, 10, 30, 90, 10))] and {r[4] for r in got} == {2**63 - 1}


def test_principal_axes_lead_and_bounds_lose_no_pair(spark):
    rng = np.random.default_rng(0)
    x = (np.diag([40.0, 20, 5] + [1] * 29) @ rng.normal(size=(32, 500))).round().astype(np.int64)
    x = (np.linalg.qr(rng.normal(size=(32, 32)))[0] @ x).round().astype(np.int64)
    rows = spark.createDataFrame([(c.tolist(),) for c in x.T], "v array<long>").repartition(3)
    axes = hard_negatives.principal_axes(rows, 32)
    assert np.allclose(axes @ axes.T, np.eye(32))
    turned = axes @ x.astype(float)
    assert np.sum(turned[:3] ** 2) > 0.95 * np.sum(turned**2)
    whole = x[:, :50].T @ x
    low, high = np.percentile(whole, 97, axis=1), np.percentile(whole, 99, axis=1)
    counts: list[int] = []
    rest = hard_negatives.remainders(turned)
    qi, ri = hard_negatives.candidates(turned[:, :50], rest[:, :50], turned, rest, np.ones((50, 500), bool), low, high, counts)
    inside = {tuple(p) for p in np.argwhere((whole >= low[:, None]) & (whole <= high[:, None])).tolist()}
    assert inside <= set(zip(qi.tolist(), ri.tolist(), strict=True)) and counts[0] < 0.3 * whole.size and len(qi) < 1.2 * len(inside)


BENCH = [(1, "The quick, brown FOX jumps over the lazy dog and then some more words follow it"), (2, "short item"), (3, None), (4, ""), (5, "..."), (None, "nameless thing here"), (2, "Été à la plage n'est pas une question de goût mais bien de temps passé dehors"), (12, "short item"), (100, "a b c d e f g h i j")]
ITEMS = "item_id long, text string, words string, window string"


def bench(spark, rows):
    return spark.createDataFrame([(i, t, "w", "v") for i, t in rows], ITEMS)


def texts():
    rng = random.Random(2)
    rows = [(0, "the QUICK brown fox; jumps/over the lazy dog and nothing"), (1, "the quick brown fox jumps over the lazy dog"), (2, "a short\nitem, shortitem; Short--ITEM"), (3, None), (4, ""), (5, " .. "), (6, "nameless thing here"), (7, "été à la plage n'est pas une question de goût mais bien de temps passé dehors été à la plage"), (8, "ÉTÉ à la plage n'est pas une question de goût"), (9, "a b c d e f g h i j a b c d e f g h i j x j"), (None, "short item"), (9, "short item short item"), (10, "x " * 40_000 + "short item " * 3000 + "y"), (11, "short"), (12, "item short")]
    return rows + [(20 + k, " ".join(rng.choice(["a", "b", "short", "item", "c", "d e f g h i j", "The quick brown fox jumps over the lazy dog and"]) for _ in range(rng.randrange(60)))) for k in range(60)]


@pytest.mark.parametrize("shard_bytes", [8 << 20, 100])
def test_decontamination(spark, monkeypatch, shard_bytes):
    monkeypatch.setattr(decontamination, "AUTOMATON_BYTES", shard_bytes)
    rows = texts()
    docs = spark.createDataFrame([(i, t, "c", "s", 0) for i, t in rows], "doc_id long, text string, items string, spans string, n_words int").repartition(3)
    got = decontamination.decontaminate(docs, bench(spark, BENCH)).collect()
    want = brute.contaminated(rows, BENCH, 10)
    assert sorted(((r.doc_id, r.n_words, r.n_hit, tuple(r["items"])) for r in got), key=repr) == sorted((w[:4] for w in want), key=repr)
    assert sorted(((r.doc_id, tuple(tuple(s) for s in r.spans)) for r in got), key=repr) == sorted(((w[0], w[4]) for w in want), key=repr)
    if shard_bytes > 100:
        assert decontamination.decontaminate(docs.limit(0), bench(spark, BENCH)).count() == 0
        none = decontamination.decontaminate(docs, bench(spark, BENCH).limit(0)).collect()
        assert all(r.n_hit == 0 and r["items"] == [] and r.spans == [] for r in none) and len(none) == len(rows)
        digest = decontamination.decontaminate(docs, bench(spark, [(i, f"short item {i}") for i in (2, 12, 100)] + [(i, "short item") for i in (2, 12, 100)])).where("doc_id = 2").select(decontamination.items_digest(F.col("items"))).first()[0]
        assert digest == hashlib.sha256(b"100,12,2").hexdigest()


def odd_texts():
    rng = random.Random(6)
    out = ["", "a", " ", "  ", "\n", "Hello  world\n\n next\tline \r\n end;\r", "it's the cat's <|endoftext|> </s> <0x41> <unk>", "été ﬁn 日本語 😀😀 zero​width", "nb space", "piece▁mark", "a\u0000b\u001fc", "x" * 5000, "-" * 3000, " " * 700 + "z", "\n" * 301, "1234567890 " * 300, "é combining", "don't stop", "﻿bom"]
    pieces = ["the", "ing", " ", "  ", "\n", "\r\n", "\t", "é", "日本", "😀", "'s", "1", "99", "...", "--", "A", "word", ";\r", " ", "ß", "{", "}"]
    return out + ["".join(rng.choice(pieces) for _ in range(rng.randrange(1, 60))) for _ in range(150)]


@pytest.mark.parametrize("pair_bytes", [24, 24 << 14])
def test_token_alignment(spark, monkeypatch, pair_bytes):
    monkeypatch.setattr(token_alignment, "PAIR_BYTES", pair_bytes)  # many shards of counts
    small = [(r.doc_id, r.text) for r in spark.read.parquet(f"{SMALL}/documents.parquet").select("doc_id", "text").collect()]
    rows = small + [(5000 + i, t) for i, t in enumerate(odd_texts())] + [(1, small[3][1]), (None, "same again"), (7000, "same again"), (7001, None)]
    docs = spark.createDataFrame([(i, t, "l", 1) for i, t in rows], "doc_id long, text string, links string, n_a int").repartition(3)
    got = token_alignment.align_tokenizers(docs, A, B, groups="sha256").collect()
    columns = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"]
    assert sorted((tuple(r[c] for c in columns) for r in got), key=repr) == sorted(brute.aligned(rows, A, B), key=repr)
    assert token_alignment.align_tokenizers(docs.limit(0), A, B).count() == 0


def test_alignment_without_units_and_with_a_small_store(monkeypatch):
    """Texts cut into units, whole texts, and a store that is emptied all the time give the same."""
    texts = pa.array([*odd_texts(), None])
    units = token_alignment.Units(A, B)
    with_units = units(texts)
    again = units(texts)
    monkeypatch.setattr(token_alignment, "STORE_BYTES", 0)
    monkeypatch.setattr(token_alignment, "PAIRS_AT_ONCE", 3)
    small = token_alignment.Units(A, B)
    small.tokenizers.cuts = False
    whole = small(texts)
    for c in with_units:
        assert with_units[c].equals(again[c]) and with_units[c].equals(whole[c]), c


def test_links_of_a_group_of_many_tokens():
    """A long stretch without a shared cut: links are numbers of pairs of ids, not rows."""
    n = 20_000
    own, pair, links = token_alignment.expanded(np.zeros(n, int), np.arange(n) % 7, np.zeros(n, int), np.arange(n) % 5, 100, np.array([3]))
    sevens, fives = Counter((np.arange(n) % 7).tolist()), Counter((np.arange(n) % 5).tolist())
    assert set(own.tolist()) == {3}
    assert dict(zip(pair.tolist(), links.tolist(), strict=True)) == {100 * a + b: x * y for a, x in sevens.items() for b, y in fives.items()}


def test_rank_and_select():
    rng = random.Random(1)
    at = np.array(sorted(rng.sample(range(1000), 300)))
    bits = token_alignment.bitset(at, 1000)
    assert token_alignment.selected(bits).tolist() == at.tolist()
    asked = np.arange(1000)
    assert token_alignment.ranks(bits, asked).tolist() == [int((at <= x).sum()) for x in asked]


def test_registered_queries(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").count()
    for name in ("op12_decontamination", "op13_token_alignment"):
        assert queries.QUERIES[name](spark, SMALL).count() == docs


def test_units_are_encoded_by_lines():
    """Many units at a time give each the ids that it has alone, and few calls of the tokenizers are made."""
    import public_tokenizers

    rng = random.Random(12)
    paths = public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("piece_bpe_32k.model")
    odd = [" ", "  x", " a ", "\nline", " \n", " \u00a0z", " 's", " <|endoftext|>", " \u00e9\u0301", " \ufb01n", " \U0001f600", " x\u2581y"]
    units = list(dict.fromkeys([u.encode() for u in odd] + [(" " + "".join(rng.choices("abcdest\u00e9\u00fc.,'0", k=rng.randrange(1, 9)))).encode() for _ in range(900)]))
    rng.shuffle(units)
    many, calls = token_alignment.Units(*paths), []
    encode = many.tokenizers.encode
    many.tokenizers.encode = lambda texts: (calls.append(len(texts)), encode(texts))[1]
    many.learn(units)
    assert sum(calls) < len(units)
    alone = token_alignment.Units(*paths)
    for i, u in enumerate(units):
        alone.clear()
        alone.learn([u])
        assert alone.groups[0] == many.groups[i] and (alone.numbers[0] == many.numbers[i]).all(), u


def test_a_full_store_keeps_what_many_batches_have(monkeypatch):
    """Units of every batch are encoded once, however many others pass; what is kept stays bounded, and rows are those of a store that holds all."""
    monkeypatch.setattr(token_alignment, "STORE_BYTES", 60_000)
    units, whole, asked = token_alignment.Units(A, B), token_alignment.Units(A, B), []
    encoded = units.encoded
    units.encoded = lambda fresh: (asked.extend(fresh), encoded(fresh))[1]
    common = [f"often{chr(97 + i)}" for i in range(20)]
    for batch in range(12):
        texts = pa.array([" ".join([*common, *(f"x{batch}y{i}é" for i in range(150))]), None, "", " ".join(common)])
        got = units(texts)
        monkeypatch.setattr(token_alignment, "STORE_BYTES", 1 << 30)
        want = whole(texts)
        monkeypatch.setattr(token_alignment, "STORE_BYTES", 60_000)
        assert all(got[c].equals(want[c]) for c in want)
        assert units.held == units.sizes().sum() < 150_000
    assert {Counter(asked)[f" {w}".encode()] for w in common} == {1} and len(units.known) < len(whole.known)
    nothing = units(pa.array([None, ""], pa.string()))
    assert nothing["groups"].to_pylist() == ["", ""] and nothing["n_a"].to_pylist() == [0, 0]
