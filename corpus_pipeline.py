"""A corpus pipeline: toxic documents go, one of each group of near copies stays, secrets are replaced, sources are mixed, and what is left is packed.

Each stage reads all that the one before kept. Defined results: an empty table passes through; repeated rows of one
id are one document from the Jaccard join on, and the mix may repeat a document again, which is then packed each time;
columns of documents other than the five named ones are dropped at the first stage."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from fleetlens.llm.common import load, release, written
from fleetlens.llm.jaccard_join import one_of_each
from fleetlens.llm.mixing import mixed_documents
from fleetlens.llm.packing import pack
from fleetlens.llm.secret_scan import scan_secrets
from fleetlens.llm.toxicity import score_documents

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't flagged as toxic.

    Null and empty texts score as texts without words; repeated rows go or stay alike; columns other than COLUMNS are
    dropped, whatever their names."""
    scored = score_documents(docs, load(spark, sf_dir, "labels"), COLUMNS)
    return scored.where((F.col("predicted") == 0) & ~F.col("flagged")).select(*COLUMNS)


def jaccard_join(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that 5-word shingles with a similarity of 0.8 link.

    Null, empty and blank texts link with nothing and stay; rows of one id and text stay once; rows without an id stay."""
    return one_of_each(docs).select(*COLUMNS)


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with their secrets replaced and n_chars counted anew; a null text stays null, and so does its n_chars."""
    return scan_secrets(docs, ["doc_id", "text", "lang", "source"], redact=True).select("doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars"))


def mixing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the mix takes them; null and empty texts have no words and go with the whole turns of their source; a null source is the last one."""
    return mixed_documents(docs, (3, 1, 2), 1.5, 2.0).select(*COLUMNS)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document lies in sequences of 4096 tokens; a null or empty text is one piece of the end id, and each row is packed."""
    return pack(docs, public_tokenizers.path("word_bpe_49k.json"), room=4096, end_id=1)


STAGES = [("toxicity", toxicity), ("jaccard_join", jaccard_join), ("secrets", secrets), ("mixing", mixing), ("packing", packing)]

#: A trained classifier and an iterative join are not SQL; the tests hold each stage against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The rows of the last stage over all documents; what a stage returns is written before the next one, and deleted once that has been."""
    docs, before = load(spark, sf_dir, "documents"), None
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), f"pipeline-{name}")
        if before:
            release(before)
        before = docs
    return STAGES[-1][1](spark, docs, sf_dir)
