"""Draws of demand and supply, as columns: each number comes from a hash of what it is for, so it is the same in every run and partition."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.operators.running import run_up
from fleetlens.operators.sizes import small
from fleetlens.sources.scratch import written

#: Poisson numbers are drawn as sums of draws with a mean of at most this, by inversion over MOST_K terms.
PART, MOST_K = 8.0, 64
#: Shares of [0, 1) by which draws meet the weights they fall on.
SLOTS = 4096


def uniform(*labels: Column | str) -> Column:
    """A number in [0, 1) with 52 bits, of the labels' text joined by |."""
    text = F.concat_ws("|", *[x if isinstance(x, Column) else F.lit(x) for x in labels])
    return F.conv(F.substring(F.md5(text.cast("binary")), 1, 13), 16, 10).cast("long") / F.lit(float(1 << 52))


def poisson(mean: Column, u: Column) -> Column:
    """The Poisson number for u, by inversion; means are at most PART."""
    start = F.struct(F.exp(-mean).alias("p"), F.lit(0.0).alias("c"), F.lit(0).cast("long").alias("n"))

    def step(a: Column, k: Column) -> Column:
        c = a["c"] + a["p"]
        return F.struct((a["p"] * mean / (k + 1)).alias("p"), c.alias("c"), (a["n"] + (c <= u).cast("long")).alias("n"))

    return F.aggregate(F.sequence(F.lit(0), F.lit(MOST_K - 1)), start, step)["n"]


def poisson_counts(rows: DataFrame, keys: list[str], mean: str, stream: str) -> DataFrame:
    """(keys, n): a Poisson number for each row. Means above PART are dealt to parts and summed up, which has the same law and no long row."""
    parts = F.greatest(F.ceil(F.col(mean) / PART), F.lit(1)).cast("int")
    dealt = rows.where(F.col(mean) > 0).select(*keys, (F.col(mean) / parts).alias("_m"), F.explode(F.sequence(F.lit(1), parts)).alias("_part"))
    drawn = dealt.withColumn("_n", poisson(F.col("_m"), uniform(stream, *[F.col(k).cast("string") for k in keys], F.col("_part").cast("string"))))
    return drawn.groupBy(*keys).agg(F.sum("_n").alias("n"))


def chosen(rows: DataFrame, u: str, weights: DataFrame, item: str, group: list[str] | None = None) -> DataFrame:
    """rows with the `item` that their u falls on: weights (group, item, weight) laid side by side on [0, 1) in order of item.

    Both sides meet on the slot of u, an equi-join, and the share inside the slot decides; no draw looks through all weights."""
    group = group or []
    own = run_up(weights.where("weight > 0"), group, [item], "weight", "_c0")
    whole = own.groupBy(*group).agg(F.sum("weight").alias("_all"), F.max(item).alias("_last"))
    own = own.join(small(whole), group) if group else own.crossJoin(F.broadcast(whole))  # one row without groups
    own = own.withColumns({"_c1": (F.col("_c0") + F.col("weight")) / F.col("_all"), "_c0": F.col("_c0") / F.col("_all"), "_end": F.col(item) == F.col("_last")})
    own = own.withColumn("_slot", F.explode(F.sequence(F.floor(F.col("_c0") * SLOTS).cast("int"), F.when(F.col("_end"), F.lit(SLOTS - 1)).otherwise(F.floor(F.col("_c1") * SLOTS).cast("int")))))
    met = rows.withColumn("_slot", F.floor(F.col(u) * SLOTS).cast("int")).join(small(own.select(*group, "_slot", "_c0", "_c1", "_end", item)), [*group, "_slot"])
    return met.where((F.col(u) >= F.col("_c0")) & ((F.col(u) < F.col("_c1")) | F.col("_end"))).drop("_slot", "_c0", "_c1", "_end")


def arrivals(intervals: DataFrame, stream: str = "arrivals") -> DataFrame:
    """Tasks of intervals (replication_id, fleet_id, interval_id, start_s, end_s, rate): with release_s and rank, from 0 in order of release.

    The number in an interval is Poisson with rate times length, and releases are uniform in it."""
    keys = ["replication_id", "fleet_id", "interval_id"]
    n = poisson_counts(intervals.withColumn("_mean", F.col("rate") * (F.col("end_s") - F.col("start_s"))), keys, "_mean", stream)
    each = intervals.join(n, keys).where("n > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    u = uniform(f"{stream}.release", *[F.col(k).cast("string") for k in keys], F.col("_i").cast("string"))
    timed = each.withColumn("release_s", F.col("start_s") + (F.col("end_s") - F.col("start_s")) * u)
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy("release_s", "_i")) - 1
    return timed.select(*keys, rank.cast("long").alias("rank"), "release_s")


def located(tasks: DataFrame, weights: DataFrame, keys: list[str], stream: str = "locations") -> DataFrame:
    """Tasks with a location_id each, drawn by weights (location_id, weight)."""
    return chosen(tasks.withColumn("_u", uniform(stream, *[F.col(k).cast("string") for k in keys])), "_u", weights, "location_id").drop("_u")


def fixed_total(totals: DataFrame, keys: list[str], weights: DataFrame, item: str, stream: str) -> DataFrame:
    """(keys, item, n): exactly `total` units of each row dealt to items by weight, a multinomial draw; items without units have no row."""
    units = totals.where("total > 0").withColumn("_i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("total").cast("long"))))
    drawn = chosen(units.withColumn("_u", uniform(stream, *[F.col(k).cast("string") for k in keys], F.col("_i").cast("string"))), "_u", weights, item)
    return drawn.groupBy(*keys, item).agg(F.count("*").alias("n"))


def od_pairs(tasks: DataFrame, keys: list[str], origins: DataFrame, destinations: DataFrame, reachable: DataFrame | None = None, *, attempts: int = 32, stream: str = "od") -> tuple[DataFrame, DataFrame]:
    """Tasks with an origin and a destination drawn apart, and those for which no two places will do.

    An attempt is refused if both are the same place or, given pairs (origin, destination) that can be reached, not one
    of them; a task's first attempt that stands is taken. Attempts are drawn in waves, each for the tasks that are left.
    A task without a pair after all of them is drawn from what is left of the weights once refused pairs are taken out,
    which is the same law, as attempt `attempts` + 1: none is lost while any pair has weight."""
    left, found, at = tasks, [], 0
    while at < attempts:
        n = min(attempts - at, max(4, 2 * at))
        tries = left.select(*keys, F.explode(F.sequence(F.lit(at + 1), F.lit(at + n))).alias("attempt"))
        label = [*[F.col(k).cast("string") for k in keys], F.col("attempt").cast("string")]
        tries = tries.withColumns({"_uo": uniform(f"{stream}.origin", *label), "_ud": uniform(f"{stream}.destination", *label)})
        rows = chosen(chosen(tries, "_uo", origins.withColumnRenamed("location_id", "origin"), "origin"), "_ud", destinations.withColumnRenamed("location_id", "destination"), "destination").where("origin <> destination")
        if reachable is not None:
            rows = rows.join(small(reachable.select("origin", "destination").distinct()), ["origin", "destination"], "left_semi")
        found.append(written(rows.groupBy(*keys).agg(F.min(F.struct("attempt", "origin", "destination")).alias("f")).select(*keys, "f.attempt", "f.origin", "f.destination")))
        left, at = written(left.join(found[-1].select(*keys), keys, "left_anti")), at + n
        if left.isEmpty():
            break
    else:
        label = [*[F.col(k).cast("string") for k in keys], F.lit(str(attempts + 1))]
        rest = left.withColumns({"_uo": uniform(f"{stream}.origin", *label), "_ud": uniform(f"{stream}.destination", *label)})
        drawn = _apart(rest, origins, destinations) if reachable is None else chosen(rest, "_uo", _joint(origins, destinations, reachable), "pair").select("*", "pair.origin", "pair.destination")
        found.append(drawn.select(*keys, F.lit(attempts + 1).alias("attempt"), "origin", "destination"))
    first = written(reduce(DataFrame.unionByName, found))
    return tasks.join(first, keys), tasks.join(first.select(*keys), keys, "left_anti")


def _joint(origins: DataFrame, destinations: DataFrame, reachable: DataFrame) -> DataFrame:
    """(pair, weight) of the pairs that can be reached, of different places with weight."""
    a, b = origins.where("weight > 0").withColumnsRenamed({"location_id": "origin", "weight": "_wo"}), destinations.where("weight > 0").withColumnsRenamed({"location_id": "destination", "weight": "_wd"})
    met = reachable.where("origin <> destination").select("origin", "destination").distinct().join(a, "origin").join(b, "destination")
    return met.select(F.struct("origin", "destination").alias("pair"), (F.col("_wo") * F.col("_wd")).alias("weight"))


def _apart(rows: DataFrame, origins: DataFrame, destinations: DataFrame) -> DataFrame:
    """rows with an origin and a destination by weight, given that they differ: an origin counts by what the others weigh as destinations, and its own stretch is left out of the destinations' scale."""
    scale = run_up(destinations.where("weight > 0"), [], ["location_id"], "weight", "_c").select(F.col("location_id").alias("origin"), F.col("weight").alias("_wd"), "_c")
    whole = destinations.where("weight > 0").agg(F.coalesce(F.sum("weight"), F.lit(0.0)).alias("_all"))
    own = origins.where("weight > 0").select(F.col("location_id").alias("origin"), F.col("weight").alias("_wo")).join(scale, "origin", "left").crossJoin(F.broadcast(whole))  # one row
    own = written(own.select("origin", (F.col("_wo") * (F.col("_all") - F.coalesce("_wd", F.lit(0.0)))).alias("weight"), (F.coalesce("_wd", F.lit(0.0)) / F.col("_all")).alias("_share"), (F.col("_c") / F.col("_all")).alias("_from")))
    placed = chosen(rows, "_uo", own.select("origin", "weight"), "origin").join(small(own.drop("weight")), "origin")
    x = F.col("_ud") * (1 - F.col("_share"))
    placed = placed.withColumn("_x", F.when(x >= F.col("_from"), x + F.col("_share")).otherwise(x))
    return chosen(placed, "_x", destinations.withColumnRenamed("location_id", "destination"), "destination").where("origin <> destination")


def expanded(rows: DataFrame, count: str, name: str = "instance") -> DataFrame:
    """Each row as often as its count says, with a number from 1; counts of zero or null give none."""
    return rows.where(F.col(count) > 0).withColumn(name, F.explode(F.sequence(F.lit(1).cast("long"), F.col(count).cast("long"))))


def availability(vehicles: DataFrame, stream: str = "availability") -> DataFrame:
    """Vehicles (replication_id, vehicle_id, first_s, latest_s, duration_s) with start_s and end_s: together at first_s if that is latest_s, else uniform between."""
    start = F.col("first_s") + (F.col("latest_s") - F.col("first_s")) * uniform(stream, F.col("replication_id").cast("string"), F.col("vehicle_id").cast("string"))
    return vehicles.withColumn("start_s", start).withColumn("end_s", F.col("start_s") + F.col("duration_s"))


def replication_ids(spark: SparkSession, n: int, seed: str) -> DataFrame:
    """(replication_id, key): names from replication_001 on, and the hash that all draws of one name start from, whatever the scenario."""
    name = F.format_string("replication_%03d", F.col("id") + 1)
    return spark.range(n).select(name.alias("replication_id"), F.sha2(F.concat_ws("|", F.lit(seed), name).cast("binary"), 256).alias("key"))


def hourly_preview(windows: DataFrame, keys: list[str], hours: int) -> DataFrame:
    """(keys, hour, active): the number of windows [start_h, end_h) active in each hour of a dense axis, as hours of overlap; hours without any are 0."""
    axis = windows.select(*keys).distinct().withColumn("hour", F.explode(F.sequence(F.lit(0), F.lit(hours - 1))))
    last = F.least(F.ceil("end_h") - 1, F.lit(hours - 1)).cast("int")
    first = F.greatest(F.floor("start_h"), F.lit(0)).cast("int")
    held = windows.where("end_h > start_h").withColumns({"_f": first, "_l": last}).where("_f <= _l").withColumn("hour", F.explode(F.sequence("_f", "_l")))
    part = F.least(F.col("end_h"), F.col("hour") + 1.0) - F.greatest(F.col("start_h"), F.col("hour").cast("double"))
    sums = held.groupBy(*keys, "hour").agg(F.sum(part).alias("active"))
    return axis.join(sums, [*keys, "hour"], "left").na.fill(0.0, ["active"])
