"""The pipeline: each stage on the output of the one before, against brute force."""

from __future__ import annotations

import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from . import brute

pipeline = pytest.importorskip("corpus_pipeline")
public_tokenizers = pytest.importorskip("public_tokenizers")
SMALL = "/root/testdata/sf0.001"
CLASH = ("size", "h", "row", "copies", "component_id", "n_shingles", "_text", "score", "flagged", "piece", "spans")


def odd_tables(spark, folder):
    """The smallest tables, with rows that are null, empty, very long, repeated or tied, and columns of names that stages use."""
    docs = spark.read.parquet(f"{SMALL}/documents.parquet").select(*pipeline.COLUMNS)
    long, shared = "river stone meadow " * 4000, "one two three four five six seven eight nine ten"
    odd = [(9000, None, "en", "s1", 0), (9001, "", None, "s1", 0), (9002, long, "en", None, 5), (9003, shared, "de", "s2", 1), (9003, shared, "de", "s2", 1), (9004, shared.upper(), "en", "s2", 1), (9005, " \t\n", "xx", "s3", 3), (9006, f"token=abcdef0123 {shared} eleven", "en", "s1", 2)]
    rows = docs.unionByName(spark.createDataFrame(odd, docs.schema))
    rows.withColumns({c: F.lit("x") for c in CLASH}).write.parquet(f"{folder}/documents.parquet")
    spark.read.parquet(f"{SMALL}/labels.parquet").withColumn("text", F.lit("y")).write.parquet(f"{folder}/labels.parquet")
    return rows.collect()


def test_run_over_odd_rows(spark, tmp_path):
    every = odd_tables(spark, str(tmp_path))
    docs, rows = spark.read.parquet(f"{tmp_path}/documents.parquet"), {}
    for name, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, str(tmp_path))
        assert docs.columns == pipeline.COLUMNS
        rows[name] = docs.collect()
        docs = spark.createDataFrame(rows[name], docs.schema)
    pair = lambda name: [(r.doc_id, r.text) for r in rows[name]]
    kept = Counter(map(tuple, rows["toxicity"]))
    assert not kept - Counter(map(tuple, every)) and {9000, 9001, 9002, 9003, 9005} <= {r.doc_id for r in rows["toxicity"]}
    alone = {i for i, _, c in brute.components(pair("toxicity")) if i == c}
    assert Counter(pair("jaccard_join")) == Counter({x for x in pair("toxicity") if x[0] in alone})
    assert all(not brute.spans(t, brute.SECRETS) for _, t in pair("secrets")) and [i for i, _ in sorted(pair("secrets"), key=str)] == [i for i, _ in sorted(pair("jaccard_join"), key=str)]
    before = dict(pair("jaccard_join"))
    assert all(t == before[i] for i, t in pair("secrets") if not brute.spans(before[i], brute.SECRETS) and "[SECRET]" not in (t or ""))
    mixed = [(r.doc_id, r.text, r.source) for r in rows["secrets"]]
    assert Counter(r.doc_id for r in rows["mixing"]) == Counter({r[0]: n for r, n in zip(mixed, brute.copies_by_mix(mixed), strict=True) if n})
    packed = pipeline.STAGES[4][1](spark, docs, str(tmp_path)).collect()
    assert pieces(packed) == plain_pieces(pair("mixing"))
    assert pieces(pipeline.run(spark, str(tmp_path)).collect()) == plain_pieces(pair("mixing"))
    for slots in brute.by_sequence(packed).values():
        end = 0
        for offset, length in sorted(slots):
            assert offset == end
            end += length
        assert end <= 4096


def pieces(packed):
    return Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in packed)


def plain_pieces(rows):
    from tokenizers import Tokenizer

    plain, out = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json")), Counter()
    for i, text in rows:
        ids = plain.encode(text or "", add_special_tokens=False).ids + [1]
        out.update((i, k, at, len(part := ids[at : at + 4096]), zlib.crc32(np.array(part, "<u4").tobytes())) for k, at in enumerate(range(0, len(ids), 4096)))
    return out


def test_run_over_nothing(spark, tmp_path):
    for name in ("documents", "labels"):
        spark.read.parquet(f"{SMALL}/{name}.parquet").limit(0).write.parquet(f"{tmp_path}/{name}.parquet")
    assert pipeline.run(spark, str(tmp_path)).count() == 0


def test_stages(spark):
    docs = spark.read.parquet(f"{SMALL}/documents.parquet")
    rows = {}
    for name, stage in pipeline.STAGES[:4]:
        docs = stage(spark, docs, SMALL)
        assert docs.columns == ["doc_id", "text", "lang", "source", "n_chars"]
        rows[name] = [(r.doc_id, r.text) for r in docs.collect()]
        docs = spark.createDataFrame(docs.collect(), docs.schema)
    before = rows["toxicity"]
    assert sorted(rows["jaccard_join"]) == sorted((i, t) for (i, t), (_, _, c) in zip(before, brute.components(before), strict=True) if i == c)
    assert all(not brute.spans(t, brute.SECRETS) for _, t in rows["secrets"]) and len(rows["secrets"]) == len(rows["jaccard_join"])
    assert {i for i, _ in rows["mixing"]} <= {i for i, _ in rows["secrets"]}
    packed = pipeline.STAGES[4][1](spark, docs, SMALL).collect()
    assert {r.doc_id for r in packed} == {i for i, _ in rows["mixing"]}
