"""Sensor-count portfolios: enumeration, sampling, utility, statistics, frontiers."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions.scalar import quantised, utility
from fleetlens.operators.sizes import small

#: More portfolios than this are refused, never cut.
MOST_PORTFOLIOS = 10_000


def count_portfolios(spark: SparkSession, levels: dict[int, list[int]], costs: dict[int, int], most_cost: int) -> DataFrame:
    """(portfolio_id, counts map, cost) of each choice of one level a fleet that costs at most most_cost. The product of levels is bounded by MOST_PORTFOLIOS."""
    size = reduce(lambda a, b: a * len(b), levels.values(), 1)
    if size > MOST_PORTFOLIOS:
        raise ValueError(f"{size} portfolios; at most {MOST_PORTFOLIOS} are allowed")
    parts = [spark.createDataFrame([(x,) for x in sorted(set(own))], f"n{f} bigint") for f, own in sorted(levels.items())]
    rows = reduce(lambda a, b: a.crossJoin(F.broadcast(b)), parts)
    cost = reduce(lambda a, b: a + b, [F.col(f"n{f}") * costs[f] for f in sorted(levels)])
    counts = F.create_map(*[x for f in sorted(levels) for x in (F.lit(f).cast("bigint"), F.col(f"n{f}"))])
    name = F.concat_ws("-", *[F.col(f"n{f}").cast("string") for f in sorted(levels)])
    return rows.select(name.alias("portfolio_id"), counts.alias("counts"), cost.cast("bigint").alias("cost")).where(F.col("cost") <= most_cost)


def orderings(vehicles: DataFrame, rounds: DataFrame) -> DataFrame:
    """(round_id, fleet_id, rank, vehicle_id): a permutation of each fleet for each round, by hash of round and vehicle, so it doesn't depend on partitions."""
    key = F.md5(F.concat_ws("|", "round_id", "vehicle_id").cast("binary"))
    rows = vehicles.crossJoin(small(rounds))
    w = Window.partitionBy("round_id", "fleet_id").orderBy("_k", "vehicle_id")
    return rows.withColumn("_k", key).withColumn("rank", F.row_number().over(w) - 1).select("round_id", "fleet_id", F.col("rank").cast("bigint").alias("rank"), "vehicle_id")


def chosen_replications(rounds: DataFrame, replications: DataFrame) -> DataFrame:
    """(round_id, replication_id): one of all replications for each round, the same for every fleet and portfolio."""
    n = replications.count()
    ranked = replications.select("replication_id", (F.row_number().over(Window.orderBy("replication_id")) - 1).alias("_r"))
    pick = F.conv(F.substring(F.md5(F.concat(F.lit("round|"), F.col("round_id").cast("string")).cast("binary")), 1, 8), 16, 10).cast("bigint") % max(n, 1)
    return rounds.withColumn("_r", pick).join(small(ranked), "_r").drop("_r")


def selections(portfolios: DataFrame, ordered: DataFrame) -> DataFrame:
    """(portfolio_id, round_id, fleet_id, vehicle_id): the first n of each fleet's permutation."""
    counts = portfolios.select("portfolio_id", F.explode("counts").alias("fleet_id", "n")).where("n > 0")
    return ordered.join(small(counts), "fleet_id").where("rank < n").select("portfolio_id", "round_id", "fleet_id", "vehicle_id")


def level_sums(portfolios: DataFrame, chosen: DataFrame, ordered: DataFrame, exposure: DataFrame) -> DataFrame:
    """(round_id, fleet_id, n, cell_id, d): the exposure of the first n vehicles of each permutation, for each n that a portfolio asks of the fleet.

    A vehicle's rows are read once a round, summed up by the least level that takes it, and run up over the levels
    above, so that portfolios with a level in common share its sum."""
    levels = portfolios.select(F.explode("counts").alias("fleet_id", "n")).where("n > 0").groupBy("fleet_id").agg(F.sort_array(F.collect_set("n")).alias("levels"))
    taken = ordered.join(F.broadcast(levels), "fleet_id").withColumn("above", F.filter("levels", lambda n: n > F.col("rank"))).where("size(above) > 0")
    met = taken.join(small(chosen), "round_id").join(exposure, ["replication_id", "fleet_id", "vehicle_id"])
    by_level = met.groupBy("round_id", "fleet_id", "cell_id", "above").agg(F.sum("duration_us").alias("d"))
    return by_level.select("round_id", "fleet_id", "cell_id", "d", F.explode("above").alias("n")).groupBy("round_id", "fleet_id", "n", "cell_id").agg(F.sum("d").alias("d"))


def sample_matrices(portfolios: DataFrame, chosen: DataFrame, ordered: DataFrame, exposure: DataFrame) -> DataFrame:
    """(portfolio_id, round_id, cell_id, d) of each sample's non-zero cells, put together from the sums of its fleets' levels."""
    counts = portfolios.select("portfolio_id", F.explode("counts").alias("fleet_id", "n")).where("n > 0")
    return level_sums(portfolios, chosen, ordered, exposure).join(small(counts), ["fleet_id", "n"]).groupBy("portfolio_id", "round_id", "cell_id").agg(F.sum("d").alias("d"))


def sample_utilities(portfolios: DataFrame, chosen: DataFrame, ordered: DataFrame, exposure: DataFrame, kind: str, saturation: float, cells: int) -> DataFrame:
    """(portfolio_id, round_id, utility, total) of each sample, an empty one too.

    Durations (seconds, exact decimals or integers times 1e-6 by the caller) are summed in a cell before the curve;
    cells weigh alike."""
    summed = sample_matrices(portfolios, chosen, ordered, exposure)
    scored = summed.groupBy("portfolio_id", "round_id").agg((F.sum(utility(F.col("d") / 1e6, kind, saturation)) / cells).alias("u"), F.sum("d").alias("d"))
    skeleton = portfolios.select("portfolio_id").crossJoin(small(chosen.select("round_id")))
    return skeleton.join(scored, ["portfolio_id", "round_id"], "left").select("portfolio_id", "round_id", F.coalesce("u", F.lit(0.0)).alias("utility"), F.coalesce("d", F.lit(0)).alias("total_us"))


def risk_order(risk: Column, more_risk_is_better: bool = False) -> Column:
    """A column to sort by, the better risk first; an unknown risk is the worst."""
    return F.struct(risk.isNull().alias("unknown"), (-risk if more_risk_is_better else risk).alias("risk"))


def frontier(statistics: DataFrame, budgets: DataFrame, mean: str, risk: str, *, more_risk_is_better: bool = False, places: int = 12, rounds: int = 2) -> DataFrame:
    """(budget, portfolio_id, cost, unspent, mean, risk, nondominated, tie_group) of the portfolios that a budget affords.

    One stands if its mean is the best of its risk and better than that of every strictly better risk: a running
    maximum over risks in order, after a sum-up by (budget, risk), so no pair of portfolios is made. Means and risks
    are compared as integers, rounded half to even at so many places. A null risk is infinite, so such a portfolio
    stands only by a mean above all others. One sampling round has no spread: with fewer than two rounds nondominated
    and tie_group are null."""
    rows = statistics.join(small(budgets), F.col("cost") <= F.col("budget")).withColumns({"_m": quantised(F.col(mean), places), "_r": risk_order(quantised(F.col(risk), places), more_risk_is_better)})
    out = ["budget", "portfolio_id", "cost", (F.col("budget") - F.col("cost")).alias("unspent"), mean, risk]
    if rounds < 2:
        return rows.select(*out, F.lit(None).cast("boolean").alias("nondominated"), F.lit(None).cast("bigint").alias("tie_group"))
    best = rows.groupBy("budget", "_r").agg(F.max("_m").alias("_best"))
    order = Window.partitionBy("budget").orderBy("_r")
    best = best.withColumn("_before", F.max("_best").over(order.rowsBetween(Window.unboundedPreceding, -1)))
    best = best.withColumn("_stands", F.col("_before").isNull() | (F.col("_best") > F.col("_before"))).withColumn("_group", F.sum(F.col("_stands").cast("bigint")).over(order))
    joined = rows.alias("p").join(best.alias("b"), (F.col("p.budget") == F.col("b.budget")) & F.col("p._r").eqNullSafe(F.col("b._r")))
    stands = F.col("b._stands") & (F.col("p._m") == F.col("b._best"))
    p = [F.col(f"p.{c}") for c in rows.columns] + [stands.alias("nondominated"), F.when(stands, F.col("b._group")).alias("tie_group")]
    return joined.select(*p).select(*out, "nondominated", "tie_group")


def best_by_mean(points: DataFrame, mean: str, risk: str, *, more_risk_is_better: bool = False) -> DataFrame:
    """For each budget the point with the highest mean, ties to the better risk, an unknown one last, and then the smaller id."""
    w = Window.partitionBy("budget").orderBy(F.col(mean).desc(), risk_order(F.col(risk), more_risk_is_better), "portfolio_id")
    return points.withColumn("_n", F.row_number().over(w)).where("_n = 1").drop("_n")


def affordable(portfolios: DataFrame, fleets: list[int]) -> DataFrame:
    """Portfolios that have no vehicle of another fleet."""
    others = F.map_filter("counts", lambda k, n: ~k.isin(fleets) & (n > 0))
    return portfolios.where(F.size(others) == 0)


def missing_samples(needed: DataFrame, sampled: DataFrame) -> DataFrame:
    """Portfolios that a new price list asks for and no sample covers; a re-pricing needs this to be empty."""
    return needed.join(sampled.select("portfolio_id").distinct(), "portfolio_id", "left_anti")


def normalised(weights: DataFrame, value: str, group: list[str] | None = None) -> Column:
    """Shares of a weight within its group or of all."""
    return F.col(value) / F.sum(value).over(Window.partitionBy(*(group or [F.lit(1)])))
