"""Exposure of fleets over cells and time bins: allocation, roll-up, coarsening, checks."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import clip, join_bins, overlaps
from .sizes import small

KEYS = ["replication_id", "fleet_id", "vehicle_id", "cell_id", "bin"]


def roll_up(rows: DataFrame, keys: list[str] = KEYS, value: str = "duration") -> DataFrame:
    """Sums by key; only positive sums stay, as absent rows are zeros."""
    return rows.groupBy(*keys).agg(F.sum(value).alias(value)).where(F.col(value) > 0)


def allocate_movements(movements: DataFrame, pieces: DataFrame, bins: DataFrame, low: float, high: float, kinds: dict[str, list[str]] | list[str] | None = None) -> DataFrame:
    """Pieces of movements by cell (null: outside the grid) and bin, with `duration`.

    Motion along an edge is linear. kinds keeps movement kinds, for all fleets or by fleet. Pieces meet movements on
    the edge, with the overlap of their fractions as a residual condition of that equi-join. A movement on an edge
    without pieces fails the query."""
    m = movements
    if isinstance(kinds, dict):
        m = m.where(F.coalesce(*[F.when((F.col("fleet_id") == f) & F.col("movement_kind").isin(k), True) for f, k in sorted(kinds.items())], F.lit(False)))
    elif kinds is not None:
        m = m.where(F.col("movement_kind").isin(kinds))
    known = pieces.select("edge_id").distinct().withColumn("_known", F.lit(True))
    m = m.join(small(known), "edge_id", "left").where(F.assert_true("_known", F.concat(F.lit("no geometry of edge "), F.col("edge_id").cast("string"))).isNull()).drop("_known")
    p = pieces.select(F.col("edge_id").alias("_edge"), "cell_id", "start_fraction", "end_fraction")
    met = m.join(p, (F.col("edge_id") == F.col("_edge")) & overlaps(F.col("start_fraction"), F.col("end_fraction"), F.col("edge_start_fraction"), F.col("edge_end_fraction")))
    f0, f1 = F.greatest("start_fraction", "edge_start_fraction"), F.least("end_fraction", "edge_end_fraction")
    at = lambda f: F.col("start_s") + (F.col("end_s") - F.col("start_s")) * (f - F.col("edge_start_fraction")) / (F.col("edge_end_fraction") - F.col("edge_start_fraction"))
    timed = met.select("replication_id", "fleet_id", "vehicle_id", "cell_id", at(f0).alias("start"), at(f1).alias("end"))
    return join_bins(clip(timed, "start", "end", low, high), bins, "start", "end").where("duration > 0")


def allocate_stationary(activities: DataFrame, locations: DataFrame, depots: DataFrame, bins: DataFrame, low: float, high: float, idle_break: float) -> DataFrame:
    """Service, wait and idle time by cell and bin, with `excluded`: depot before offduty, else null.

    locations has location_id, node_id and cell_id; depots has fleet_id, vehicle_id and depot_node_id. Idle time of
    idle_break and more, before it is clipped, is off duty."""
    rows = activities.where(F.col("activity_kind").isin("service", "wait", "idle")).withColumn("whole", F.col("end_s") - F.col("start_s"))
    rows = clip(rows, "start_s", "end_s", low, high).join(locations, "location_id", "left").join(depots, ["fleet_id", "vehicle_id"], "left")
    excluded = F.when(F.col("node_id") == F.col("depot_node_id"), "depot").when((F.col("activity_kind") == "idle") & (F.col("whole") >= idle_break), "offduty")
    return join_bins(rows.withColumn("excluded", excluded), bins, "start_s", "end_s").where("duration > 0")


def combined(moving: DataFrame, stationary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, duration): time on the move and stationary time that nothing excludes, added up by key; a null cell is outside the grid."""
    parts = moving.select(*keys, "duration").unionByName(stationary.where(F.col("excluded").isNull()).select(*keys, "duration"))
    return parts.groupBy(*keys).agg(F.sum("duration").alias("duration"))


def balance(moving: DataFrame, stationary: DataFrame, keys: list[str]) -> DataFrame:
    """(keys, moving, counted, depot, offduty, total): where all time went, stationary time by what excludes it."""
    rows = moving.select(*keys, "duration", F.lit("moving").alias("_w")).unionByName(stationary.select(*keys, "duration", F.coalesce("excluded", F.lit("counted")).alias("_w")))
    part = lambda w: F.sum(F.when(F.col("_w") == w, F.col("duration")).otherwise(0)).alias(w)
    return rows.groupBy(*keys).agg(*[part(w) for w in ("moving", "counted", "depot", "offduty")], F.sum("duration").alias("total"))


def coarsen(rows: DataFrame, cells: DataFrame, bins: DataFrame, value: str = "duration") -> DataFrame:
    """Sums under a mapping of cells (cell_id, coarse_cell) and of bins (bin, coarse_bin); a row without a mapping fails the query."""
    mapped = rows.join(cells, "cell_id", "left").join(bins, "bin", "left")
    good = F.assert_true(F.col("coarse_cell").isNotNull() & F.col("coarse_bin").isNotNull(), F.lit("a cell or bin has no coarse one"))
    mapped = mapped.withColumn("_ok", good.isNull()).where("_ok")
    return mapped.groupBy("replication_id", "fleet_id", "vehicle_id", "coarse_cell", "coarse_bin").agg(F.sum(value).alias(value))


def conservation(allocated: DataFrame, active: DataFrame, keys: list[str], relative: float = 1e-10, absolute: float = 1e-6) -> DataFrame:
    """Per key: active time, time in the grid and outside, the residual, and whether it is within tolerance."""
    sums = allocated.groupBy(*keys).agg(F.sum(F.when(F.col("cell_id").isNotNull(), F.col("duration")).otherwise(0)).alias("inside"), F.sum(F.when(F.col("cell_id").isNull(), F.col("duration")).otherwise(0)).alias("outside"))
    rows = active.groupBy(*keys).agg(F.sum("active").alias("active")).join(sums, keys, "left").na.fill(0, ["inside", "outside"])
    residual = F.col("active") - F.col("inside") - F.col("outside")
    return rows.withColumn("residual", residual).withColumn("conserved", F.abs("residual") <= F.greatest(F.lit(absolute), F.lit(relative) * F.abs("active")))
