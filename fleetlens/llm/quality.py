"""Quality rules as weak supervision: votes, expectation-maximisation over vote patterns, posterior quality."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import _SPACE, arrow_pass, column_bytes, rolling, text_of, word_hashes, word_starts, written

#: Words of a window whose repeats count.
WINDOW = 8
ROUNDS, TOLERANCE = 200, 1e-9
KEEP_FROM = 0.5
_LINE = np.zeros(256, bool)
_LINE[10] = True
_SYMBOL = np.zeros(256, bool)
_SYMBOL[[ord(c) for c in "#*$%&|<>"]] = True
_LETTER = np.zeros(256, bool)
_LETTER[65:91] = _LETTER[97:123] = True
_LETTER[128:] = True
METRICS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_letters", "n_sentences")
_END = np.zeros(256, bool)
_END[[ord(c) for c in ".!?"]] = True


def text_metrics(data: np.ndarray, offsets: np.ndarray) -> dict[str, np.ndarray]:
    """The METRICS of each of the texts that lie one after the other in data."""

    def summed(mask: np.ndarray, at: np.ndarray) -> np.ndarray:
        c = np.zeros(len(mask) + 1, np.int64)
        np.cumsum(mask, out=c[1:])
        return c[at[1:]] - c[at[:-1]]

    n = len(offsets) - 1
    head = (data & 0xC0) != 0x80
    inside = ~_SPACE[data]
    h, at = word_hashes(data, offsets)
    out = {"n_words": np.diff(at), "word_chars": summed(head & inside, offsets), "n_symbols": summed(_SYMBOL[data], offsets), "n_letters": summed(head & _LETTER[data], offsets), "n_sentences": summed(_END[data], offsets)}
    lines, line_at = word_hashes(data, offsets, stop=_LINE)
    # lines with a word: their number of word bytes is positive
    full = np.add.reduceat(inside.astype(np.int64), word_starts(data, offsets, _LINE)) > 0 if len(lines) else np.zeros(0, bool)
    doc = text_of(line_at)[full]
    own = lines[full]
    order = np.lexsort((own, doc))
    same = np.zeros(len(own), bool)
    same[1:] = (own[order][1:] == own[order][:-1]) & (doc[order][1:] == doc[order][:-1])
    out["n_lines"] = np.bincount(doc, minlength=n)
    out["n_dup_lines"] = np.bincount(doc[order][same], minlength=n)
    r, word_doc = rolling(h, WINDOW), text_of(at)
    m = len(r)
    inner = np.flatnonzero(word_doc[:m] == word_doc[WINDOW - 1 :]) if m else np.zeros(0, np.int64)
    d, r = word_doc[inner], r[inner]
    order = np.lexsort((r, d))
    same = (r[order][1:] == r[order][:-1]) & (d[order][1:] == d[order][:-1])
    twice = np.zeros(len(r), bool)
    twice[order[1:][same]] = True
    twice[order[:-1][same]] = True
    cover = np.zeros(len(h) + 1, np.int64)
    np.add.at(cover, inner[twice], 1)
    np.add.at(cover, inner[twice] + WINDOW, -1)
    out["n_repeat_words"] = summed(np.cumsum(cover[:-1]) > 0, at)
    return {k: out[k].astype(np.int64) for k in METRICS}


def measured(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    def make():
        def step(batch: pa.RecordBatch):
            yield {"doc_id": batch.column(0)} | text_metrics(*column_bytes(batch.column(1)))

        return step

    id_type = docs.schema[id_col].dataType.simpleString()
    return arrow_pass(docs.select(docs[id_col].alias("doc_id"), docs[text_col].alias("text")), make, f"doc_id {id_type}, " + ", ".join(f"{m} bigint" for m in METRICS))


def rules() -> dict[str, Column]:
    """Each rule votes good (1) or bad (-1) or abstains (0)."""
    c = F.col

    def vote(bad: Column, good: Column) -> Column:
        return F.when(c("n_words") == 0, F.lit(-1)).when(bad, F.lit(-1)).when(good, F.lit(1)).otherwise(F.lit(0))

    return {
        "enough_words": vote(c("n_words") < 10, c("n_words") >= 40),
        "word_length": vote((c("word_chars") < 2 * c("n_words")) | (c("word_chars") > 14 * c("n_words")), c("word_chars").between(3 * c("n_words"), 10 * c("n_words"))),
        "few_symbols": vote(4 * c("n_symbols") > c("n_words"), 50 * c("n_symbols") <= c("n_words")),
        "no_repeats": vote((3 * c("n_dup_lines") > c("n_lines")) | (5 * c("n_repeat_words") > c("n_words")), (5 * c("n_dup_lines") <= c("n_lines")) & (10 * c("n_repeat_words") <= c("n_words"))),
        "letters": vote(4 * c("n_letters") < 3 * c("word_chars"), 100 * c("n_letters") >= 93 * c("word_chars")),
        "sentences": vote((c("n_sentences") == 0) & (c("n_words") > 60), (c("n_sentences") > 0) & (50 * c("n_sentences") >= c("n_words"))),
    }


def label_model(patterns: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The posterior probability of good for each pattern of votes: expectation-maximisation with a prior, and for each rule that votes the chance of either vote given good and given bad. Abstaining tells nothing. It starts from all rules being better than chance: a pattern with a bad vote is likely bad."""
    votes = np.stack([patterns == v for v in (-1, 1)], axis=-1).astype(float)
    good = np.where((patterns < 0).any(1), 0.1, 0.95)
    weight = counts.astype(float)
    for _ in range(ROUNDS):
        chance = np.stack([np.einsum("p,pjv->jv", weight * q, votes) + [[1.0, 1.0]] for q in (1 - good, good)])
        chance /= chance.sum(-1, keepdims=True)
        prior = np.clip((weight * good).sum() / weight.sum(), 1e-6, 1 - 1e-6)
        like = np.einsum("pjv,cjv->pc", votes, np.log(chance)) + np.log([1 - prior, prior])
        new = 1 / (1 + np.exp(np.clip(like[:, 0] - like[:, 1], -700, 700)))
        done = np.abs(new - good).max() < TOLERANCE
        good = new
        if done:
            break
    return good


def quality_filter(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row for each row: the METRICS, base_failed, the posterior probability p_good, and kept.

    The texts are read once; what is measured is written, counted by pattern of votes over all rows (3 to the number
    of rules at most, however many documents), and the posterior of each pattern joined back by a broadcast of that
    bound. Defined results: a null text has no words and fails; empty and very long texts are measured whole; repeated
    rows are judged each and alike; other columns are ignored; an empty table gives none."""
    rows = written(measured(docs, id_col, text_col), "quality")
    base_failed = (F.col("n_words") < 20) | (100 * F.col("n_repeat_words") > 30 * F.col("n_words"))
    voted = rows.select("*", base_failed.alias("base_failed"), F.array(*rules().values()).alias("votes"))
    counted = sorted((tuple(r.votes), r.n) for r in voted.groupBy("votes").agg(F.count("*").alias("n")).collect())
    spark = docs.sparkSession
    posterior = label_model(np.array([p for p, _ in counted]), np.array([n for _, n in counted])) if counted else []
    table = spark.createDataFrame(pa.table({"votes": pa.array([list(p) for p, _ in counted], pa.list_(pa.int32())), "p_good": pa.array(list(map(float, posterior)), pa.float64())}))
    kept = ~F.col("base_failed") & (F.col("p_good") >= KEEP_FROM)
    return voted.join(F.broadcast(table), "votes", "left").select("doc_id", *METRICS, "base_failed", "p_good", kept.alias("kept"))
