"""Mixing sources to target weights by hash-threshold histograms."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from .common import release, sent, written

#: The hash has 60 bits; each level of histograms resolves 10 of them, so a source has 1024 buckets at most in a window.
HASH_BITS, LEVEL_BITS = 60, 10
#: Sources up to this number travel by broadcast (a name, two doubles and three longs each).
BROADCAST_SOURCES = 100_000


def n_words(text: Column) -> Column:
    return F.coalesce(F.size(F.filter(F.split(text, r"[\x20\x09-\x0D]+", -1), lambda w: w != "")), F.lit(0)).cast("long")


def doc_hash(doc_id: Column) -> Column:
    """60 bits of the id's MD5: the same in every run and in other engines."""
    return F.conv(F.substring(F.md5(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")), 1, 15), 16, 10).cast("long")


def ranked(sources: DataFrame) -> DataFrame:
    """source, source_size and position by code point, null last: a range sort, then offsets of its partitions."""
    placed = written(sources.orderBy(F.col("source").asc_nulls_last()).withColumn("m", F.monotonically_increasing_id()), "mix-sources")
    placed = placed.select("*", F.shiftright("m", 33).alias("p"), F.col("m").bitwiseAND(F.lit((1 << 33) - 1)).alias("i"))
    before = placed.groupBy("p").agg(F.count("*").alias("n")).select("p", (F.sum("n").over(Window.orderBy("p")) - F.col("n")).alias("before"))
    return placed.join(sent(before), "p").select("source", "source_size", (F.col("before") + F.col("i")).alias("position"))


def with_targets(sources: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """Adds target: share of all sizes by weight, at most cap times a source's size, the excess shared anew by weight until none is above.

    That ends at min(cap * size, level * weight); the level is found by rounds of one sum over the sources."""
    w = F.element_at(F.array(*[F.lit(float(x)) for x in weights]), (F.col("position") % len(weights) + 1).cast("int"))
    table = written(ranked(sources).select("*", w.alias("weight"), (cap * F.col("source_size")).alias("most")), "mix-weights")
    total, all_weight = table.agg(F.coalesce(F.sum("source_size"), F.lit(0)), F.coalesce(F.sum("weight"), F.lit(0.0))).first()
    level, held = (share * total / all_weight if all_weight else 0.0), -1
    while True:
        full = F.col("most") < level * F.col("weight")
        n, given, free = table.agg(F.count_if(full), F.coalesce(F.sum(F.when(full, F.col("most"))), F.lit(0.0)), F.coalesce(F.sum(F.when(~full, F.col("weight"))), F.lit(0.0))).first()
        if n == held or not free:
            break
        level, held = (share * total - given) / free, n
    return table.select("source", "source_size", F.least(F.col("most"), level * F.col("weight")).alias("target"))


def joined(rows: DataFrame, small: DataFrame, right: list[str]) -> DataFrame:
    """rows with the columns `right` of their source: by broadcast up to a bound, else a shuffle join whose hot sources AQE splits."""
    s = small.select(F.col("source").alias("_source"), *right)
    return rows.join(sent(s, BROADCAST_SOURCES), F.col("source").eqNullSafe(F.col("_source"))).drop("_source")


def thresholds(sized: DataFrame, weights: tuple[float, ...], share: float, cap: float) -> DataFrame:
    """source, source_size, target, epochs and limit: a document is taken `epochs` times, and once more if its hash is below limit.

    sized has source, size and h. Each level sums sizes by source and bucket (combined before they move), finds the
    bucket in which a source's budget ends, and only that bucket is split further; no row is sorted. The document on
    the boundary is in if that brings the sum nearer to the budget."""
    sources = with_targets(sized.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, cap)
    epochs = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(F.lit(0)).cast("long")
    state = sources.select("*", epochs.alias("epochs")).select("*", (F.col("target") - F.col("epochs") * F.col("source_size")).alias("left"), F.lit(0).cast("long").alias("prefix"))
    state = written(state, "mix-budget")
    first = state
    for level in range(HASH_BITS // LEVEL_BITS):
        shift = HASH_BITS - LEVEL_BITS * level
        inside = joined(sized.where("size > 0"), state, ["left", "prefix"]).where(F.shiftright("h", shift) == F.col("prefix"))
        sums = inside.groupBy("source", F.shiftright("h", shift - LEVEL_BITS).alias("bucket")).agg(F.sum("size").alias("s"), F.first("left").alias("left"))
        run = F.sum("s").over(Window.partitionBy("source").orderBy("bucket"))
        state = sums.withColumn("run", run).where("run > left and run - s <= left").select("source", (F.col("left") - (F.col("run") - F.col("s"))).alias("left"), F.col("bucket").alias("prefix"), "s")
        state = written(state, "mix-level")
    limit = state.select(F.col("source").alias("_s"), (F.col("prefix") + F.when(F.col("s") < 2 * F.col("left"), 1).otherwise(0)).alias("limit"))
    return first.join(limit, F.col("source").eqNullSafe(F.col("_s")), "left").select("source", "source_size", "target", "epochs", F.coalesce("limit", F.lit(0).cast("long")).alias("limit"))


def copies() -> Column:
    return F.col("epochs") + F.when((F.col("h") < F.col("limit")) & (F.col("size") > 0), 1).otherwise(0)


def mix_sources(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0, *, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source") -> DataFrame:
    """(doc_id, size, source_size, target, taken) of every row.

    Sizes are words; a null text has none. Defined results: sources are in order of code points with null as the last
    one; a source without words has target 0; rows that share an id are taken together; without rows there are none.
    Other columns are ignored. Reruns agree, and a larger budget takes all that a smaller one takes."""
    sized = written(docs.select(docs[id_col].alias("doc_id"), docs[source_col].cast("string").alias("source"), n_words(docs[text_col]).alias("size"), doc_hash(docs[id_col]).alias("h")), "mix-sizes")
    table = written(thresholds(sized, tuple(weights), share, cap), "mix-thresholds")
    return joined(sized, table, ["source_size", "target", "epochs", "limit"]).select("doc_id", "size", "source_size", "target", (copies() * F.col("size")).alias("taken"))


def mixed_documents(docs: DataFrame, weights: tuple[float, ...] = (3, 1, 2), share: float = 1.5, cap: float = 2.0) -> DataFrame:
    """The rows of documents that the mix takes, with all their columns, as often as it takes them.

    Defined results: as those of mix_sources; a document without words goes as often as its source is taken whole;
    columns of any name stay as they are; rows that share an id are taken together; an empty table gives none."""
    row = docs.select(F.struct(*[docs[c] for c in docs.columns]).alias("row"), docs["source"].cast("string").alias("source"), n_words(docs["text"]).alias("size"), doc_hash(docs["doc_id"]).alias("h"))
    sized = written(row.select("source", "size", "h"), "mix-sizes")
    table = written(thresholds(sized, tuple(weights), share, cap), "mix-thresholds")
    release(sized)
    times = F.sequence(F.lit(1), copies().cast("int"))
    return joined(row, table, ["epochs", "limit"]).where(copies() > 0).select("row", F.explode(times).alias("copy")).select("row.*")
