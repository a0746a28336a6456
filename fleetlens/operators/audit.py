"""Checks and axes: joins that hold their keys to account, completeness, diagnostics, closures, ranges."""

from __future__ import annotations

from decimal import Decimal

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions.scalar import utility
from fleetlens.operators.sizes import small
from fleetlens.sources.scratch import written


def unique(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with a repeated key failing the query where it is met."""
    n = F.count("*").over(Window.partitionBy(*keys))
    return rows.withColumn("_n", n).where(F.assert_true(F.col("_n") == 1, F.lit(f"{', '.join(keys)} aren't unique")).isNull()).drop("_n")


def one_to_one(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """A join of which each key has at most one row on either side."""
    return unique(left, keys).join(unique(right, keys), keys, how)


def many_to_one(left: DataFrame, right: DataFrame, keys: list[str]) -> DataFrame:
    """All rows of left, with those of right where it has the key, which it has once at most."""
    return left.join(small(unique(right, keys)), keys, "left")


def completeness(status: DataFrame, wanted: DataFrame, key: str = "replication_id") -> DataFrame:
    """(key, state) of wanted keys: complete, incomplete, or missing from status (key, complete)."""
    held = status.groupBy(key).agg(F.min(F.col("complete").cast("int")).alias("_c"))
    return wanted.select(key).distinct().join(held, key, "left").select(key, F.when(F.col("_c").isNull(), "missing").when(F.col("_c") == 1, "complete").otherwise("incomplete").alias("state"))


def required_complete(status: DataFrame, wanted: DataFrame, key: str = "replication_id") -> DataFrame:
    """The wanted keys, or a failing query where one of them isn't complete."""
    return completeness(status, wanted, key).where(F.assert_true(F.col("state") == "complete", F.concat(F.col(key).cast("string"), F.lit(" is "), "state")).isNull()).select(key)


def axis(rows: DataFrame, column: str) -> DataFrame:
    """(column, canonical_index) of the distinct values in order: values are range-sorted, and partitions' offsets added, so no task holds the whole axis."""
    placed = rows.select(column).where(F.col(column).isNotNull()).distinct().orderBy(column).withColumn("_m", F.monotonically_increasing_id())
    placed = placed.select(column, F.shiftright("_m", 33).alias("_p"), F.col("_m").bitwiseAND(F.lit((1 << 33) - 1)).alias("_i"))
    before = placed.groupBy("_p").agg(F.count("*").alias("_n")).select("_p", (F.sum("_n").over(Window.orderBy("_p")) - F.col("_n")).alias("_before"))
    return placed.join(F.broadcast(before), "_p").select(column, (F.col("_before") + F.col("_i")).alias("canonical_index"))


def read_sparse(exposure: DataFrame, replications: DataFrame, vehicles: DataFrame, bins: int, value: str = "duration") -> DataFrame:
    """Sparse rows of chosen replications and vehicles (fleet_id, vehicle_id); a row with a value that isn't positive and finite, or a bin off the axis, fails the query."""
    rows = exposure.join(small(replications.select("replication_id").distinct()), "replication_id", "left_semi").join(small(vehicles.select("fleet_id", "vehicle_id").distinct()), ["fleet_id", "vehicle_id"], "left_semi")
    x = F.col(value).cast("double")
    sound = F.coalesce((x > 0) & (x < float("inf")) & F.col("bin").between(0, bins - 1) & F.col("cell_id").isNotNull(), F.lit(False))
    return rows.where(F.assert_true(sound, F.lit("an exposure row is out of bounds")).isNull())


def replication_diagnostics(allocated: DataFrame, value: str = "duration") -> DataFrame:
    """By replication: time in the grid and outside it, in all, rows, vehicles and cells."""
    inside = F.col("cell_id").isNotNull()
    return allocated.groupBy("replication_id").agg(F.sum(F.when(inside, F.col(value)).otherwise(0)).alias("inside"), F.sum(F.when(inside, 0).otherwise(F.col(value))).alias("outside"), F.sum(value).alias("total"), F.count("*").alias("rows"), F.count_distinct("vehicle_id").alias("vehicles"), F.count_distinct("cell_id").alias("cells"))


def matrix_totals(rows: DataFrame, keys: list[str], cell: str, interval: Column, kind: str, saturation: float, value: str = "duration", scale: float = 1e6) -> DataFrame:
    """(keys, total, nonzero, utility) of each matrix: the sum of its values, its non-zero entries, and the utility of the sums by cell and interval, summed."""
    sums = rows.withColumn("_u", interval).groupBy(*keys, cell, "_u").agg(F.sum(value).alias("_d"), F.count("*").alias("_n"))
    return sums.groupBy(*keys).agg(F.sum("_d").alias("total"), F.sum("_n").alias("nonzero"), F.sum(utility(F.col("_d") / scale, kind, saturation)).alias("utility"))


def interval_index(start: Column, origin: float, length: float) -> Column:
    """The utility interval that a bin starts in; a bin a hair below a border belongs above it."""
    return F.floor((start - origin) / length + 1e-12)


def misaligned_bins(bins: DataFrame, origin: float, length: float) -> DataFrame:
    """Bins (bin, bin_start, bin_end) that reach over the end of the interval they start in."""
    end = (interval_index(F.col("bin_start"), origin, length) + 1) * length + origin
    return bins.where(F.col("bin_end") > end + 1e-9)


def expanded_range(low: str, high: str, step: str, *, with_high: bool = False, limit: int = 10_000) -> list[Decimal]:
    """low, low + step and on up to high, exact in decimals; with_high adds high itself where no step meets it."""
    a, b, d = Decimal(low), Decimal(high), Decimal(step)
    if not (d > 0 and a <= b):
        raise ValueError("a range needs a positive step and low <= high")
    n = int((b - a) // d) + 1
    if n + with_high > limit:
        raise ValueError(f"{n} values; at most {limit} are allowed")
    out = [a + d * i for i in range(n)]
    return out + ([b] if with_high and out[-1] != b else [])


def unused_name(base: Column, taken: DataFrame, name: str = "name") -> Column:
    """base, or base with the least number from 2 on that isn't taken, of a bounded table of names; names compare without case and outer white space."""
    clean = lambda c: F.lower(F.trim(F.regexp_replace(c, r"\s+", " ")))
    held = F.array(*[F.lit(r[0]) for r in taken.select(clean(F.col(name))).distinct().limit(1000).collect()]) if taken.limit(1001).count() <= 1000 else None
    if held is None:
        raise ValueError("more than 1000 names")
    tries = F.concat(F.array(base), F.transform(F.sequence(F.lit(2), F.size(held) + 2), lambda i: F.concat(base, F.lit(" "), i.cast("string"))))
    return F.element_at(F.filter(tries, lambda t: ~F.array_contains(held, clean(t))), 1)


def closure(edges: DataFrame, roots: DataFrame) -> DataFrame:
    """(root, node) of all nodes that a root reaches along edges (a, b), itself included: one join of the newest pairs a round, until none is new. A round writes its new pairs only."""
    new, e = written(roots.select(F.col("node").alias("root"), "node").distinct()), edges.select("a", "b").distinct()
    paths = [new.scratch_path]
    seen = lambda: new.sparkSession.read.schema(new.schema).parquet(*paths)
    while not new.isEmpty():
        onward = new.join(e, F.col("node") == F.col("a")).select("root", F.col("b").alias("node")).distinct()
        new = written(onward.join(seen(), ["root", "node"], "left_anti"))
        paths.append(new.scratch_path)
    return seen()


def first_service(services: DataFrame, keys: list[str], start: str, scheduled: str) -> DataFrame:
    """(keys, first_service, lateness): the earliest service of each execution, and how long after its own schedule it is, at least 0."""
    first = services.groupBy(*keys).agg(F.min(start).alias("first_service"), F.min_by(scheduled, F.struct(start, "step_index")).alias("_s"))
    return first.select(*keys, "first_service", F.greatest(F.col("first_service") - F.col("_s"), F.lit(0)).alias("lateness"))


def trajectory(movements: DataFrame, replication: str, vehicle, order: list[str]) -> DataFrame:
    """One vehicle's movements of a replication in order, with their number and the pause before each."""
    w = Window.partitionBy("replication_id", "vehicle_id").orderBy(*order)
    own = movements.where((F.col("replication_id") == replication) & (F.col("vehicle_id") == vehicle))
    return own.withColumns({"n": F.row_number().over(w) - 1, "pause": F.col("start") - F.lag("end").over(w)})


def sampled(rows: DataFrame, key: str, n: int, seed: str) -> DataFrame:
    """n rows, the first by a hash of seed and key: a display subset that is the same in every run."""
    return rows.orderBy(F.md5(F.concat_ws("|", F.lit(seed), F.col(key).cast("string")).cast("binary")), key).limit(n)


def latest_covering(candidates: DataFrame, low: float, high: float) -> DataFrame:
    """The candidate (id, low, high, made) made last of those that cover [low, high)."""
    return candidates.where((F.col("low") <= low) & (F.col("high") >= high)).orderBy(F.desc("made"), "id").limit(1)


def weights_of(spark: SparkSession, cells: DataFrame, features: DataFrame | None, bins: DataFrame) -> DataFrame:
    """(cell_id, bin, weight): cells weigh by a feature, or alike, and bins by their length; all weights sum to 1."""
    own = cells.select("cell_id").withColumn("_w", F.lit(1.0)) if features is None else cells.select("cell_id").join(features.groupBy("cell_id").agg(F.sum("value").alias("_w")), "cell_id").where("_w > 0")
    rows = own.crossJoin(small(bins.select("bin", (F.col("bin_end") - F.col("bin_start")).cast("double").alias("_l")))).withColumn("_x", F.col("_w") * F.col("_l"))
    return rows.crossJoin(F.broadcast(rows.agg(F.sum("_x").alias("_all")))).select("cell_id", "bin", (F.col("_x") / F.col("_all")).alias("weight"))
