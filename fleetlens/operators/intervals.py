"""Half-open intervals in integer ticks: clipping, splitting into bins, overlap joins, adjacency, islands."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.operators.sizes import small


def overlaps(start: Column, end: Column, low: Column, high: Column) -> Column:
    """Half-open overlap: touching intervals don't."""
    return (end > low) & (start < high)


def clip(df: DataFrame, start: str, end: str, low, high) -> DataFrame:
    """Cuts intervals to [low, high) and drops what is empty then."""
    return df.withColumns({start: F.greatest(F.col(start), F.lit(low)), end: F.least(F.col(end), F.lit(high))}).where(F.col(end) > F.col(start))


def split_bins(df: DataFrame, start: str, end: str, width: int, origin: int = 0) -> DataFrame:
    """A row for each uniform bin that an interval overlaps, with `bin` and `duration`.

    An explode over the bins' numbers instead of a range join: no join at all, and its output is what the answer needs."""
    first, last = F.floor((F.col(start) - origin) / width), F.floor((F.col(end) - 1 - origin) / width)
    rows = df.where(F.col(end) > F.col(start)).withColumn("bin", F.explode(F.sequence(first, last)))
    low = F.col("bin") * width + origin
    return rows.withColumn("duration", F.least(F.col(end), low + width) - F.greatest(F.col(start), low))


def join_bins(df: DataFrame, bins: DataFrame, start: str, end: str) -> DataFrame:
    """Intervals against bins (bin, bin_start, bin_end) of any widths and number, with the `duration` of each overlap.

    Both sides are dealt to slots as wide as the mean bin and meet in an equi-join; a pair that shares several slots is
    kept in the first. A short axis is broadcast."""
    low, width = bins.agg(F.min("bin_start").cast("double"), ((F.max("bin_end") - F.min("bin_start")) / F.count("*")).cast("double")).first()
    slot = lambda c: F.floor((c.cast("double") - F.lit(low or 0.0)) / F.lit(width or 1.0))
    axis = bins.where("bin_end > bin_start").withColumn("_first", slot(F.col("bin_start")))
    axis = axis.withColumn("_slot", F.explode(F.sequence("_first", slot(F.col("bin_end")))))
    top = axis.agg(F.max("_slot")).first()[0]
    rows = df.where(F.col(end) > F.col(start)).withColumns({"_own": F.greatest(slot(F.col(start)), F.lit(0)), "_last": F.least(slot(F.col(end)), F.lit(top or 0))}).where("_own <= _last")
    rows = rows.withColumn("_slot", F.explode(F.sequence("_own", "_last")))
    met = rows.join(small(axis), "_slot").where(overlaps(F.col(start), F.col(end), F.col("bin_start"), F.col("bin_end")) & (F.col("_slot") == F.greatest("_own", "_first")))
    return met.drop("_slot", "_own", "_last", "_first").withColumn("duration", F.least(end, "bin_end") - F.greatest(start, "bin_start"))


def fractional_clip(df: DataFrame, start: str, end: str, f0: str, f1: str, low, high) -> DataFrame:
    """Clips linear motion along an edge: the fractions move with the times."""
    t0, t1 = F.greatest(F.col(start), F.lit(low)), F.least(F.col(end), F.lit(high))
    span = F.col(end) - F.col(start)
    at = lambda t: F.col(f0) + (F.col(f1) - F.col(f0)) * (t - F.col(start)) / span
    rows = df.where(overlaps(F.col(start), F.col(end), F.lit(low), F.lit(high)))
    return rows.select("*", t0.alias("_s"), t1.alias("_e"), at(t0).alias("_f0"), at(t1).alias("_f1")).drop(start, end, f0, f1).withColumnsRenamed({"_s": start, "_e": end, "_f0": f0, "_f1": f1})


def overlap_violations(df: DataFrame, keys: list[str], start: str, end: str, order: list[str]) -> DataFrame:
    """Rows that start before the row ahead of them, in the same key, has ended."""
    w = Window.partitionBy(*keys).orderBy(*order)
    return df.withColumn("previous_end", F.lag(end).over(w)).where(F.col("previous_end") > F.col(start))


def reindex(df: DataFrame, keys: list[str], order: list[str], name: str) -> DataFrame:
    """Contiguous positions from 0 within each key."""
    return df.withColumn(name, (F.row_number().over(Window.partitionBy(*keys).orderBy(*order)) - 1).cast("long"))


def islands(df: DataFrame, keys: list[str], start: str, end: str) -> DataFrame:
    """Unions of intervals of a key that overlap or touch: (keys, start, end, pieces)."""
    w = Window.partitionBy(*keys).orderBy(start, end)
    reach = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", F.when(F.col(start) <= reach, 0).otherwise(1)).withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return marked.groupBy(*keys, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("pieces")).drop("_island")


def running_stock(df: DataFrame, keys: list[str], order: list[str], delta: str, reset: str) -> DataFrame:
    """The sum of deltas since the last reset (a row that resets starts from 0), and the least of it so far."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    grouped = df.withColumn("_reset", F.sum(F.col(reset).cast("int")).over(w))
    own = Window.partitionBy(*keys, "_reset").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return grouped.withColumn("stock", F.sum(F.when(F.col(reset), 0).otherwise(F.col(delta))).over(own)).drop("_reset")


def required_capacity(df: DataFrame, keys: list[str], order: list[str], delta: str) -> DataFrame:
    """The stock that a sequence of deltas needs at its start: minus its least prefix sum, or 0."""
    w = Window.partitionBy(*keys).orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    return df.withColumn("_p", F.sum(delta).over(w)).groupBy(*keys).agg(F.greatest(-F.min("_p"), F.lit(0)).alias("required"))
