"""Vehicles and their areas: catalogues, windows, assignments, service areas of equal demand."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.operators.running import run_up
from fleetlens.operators.sizes import small
from fleetlens.sources.scratch import written


def supply_issues(vehicles: DataFrame) -> DataFrame:
    """(source_row, vehicle_id, code) of a raw catalogue (source_row, vehicle_id, start_s, end_s, capacity): missing or repeated ids, windows that don't begin before they end, capacities that aren't positive numbers."""
    w = Window.partitionBy("vehicle_id").orderBy("source_row")
    rows = vehicles.withColumn("_again", F.row_number().over(w) > 1)
    finite = lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) < float("inf"))
    start, end, room = (F.col(c).cast("double") for c in ("start_s", "end_s", "capacity"))
    checks = {"MISSING_ID": F.col("vehicle_id").isNull() | (F.trim("vehicle_id") == ""), "REPEATED_ID": F.col("vehicle_id").isNotNull() & F.col("_again"), "INVALID_WINDOW": ~(finite(start) & finite(end) & (start < end)), "INVALID_CAPACITY": F.col("capacity").isNotNull() & ~(finite(room) & (room > 0))}
    codes = F.filter(F.array(*[F.when(F.coalesce(bad, F.lit(True)), F.lit(c)) for c, bad in sorted(checks.items())]), lambda c: c.isNotNull())
    return rows.select("source_row", "vehicle_id", F.explode(codes).alias("code"))


def catalogue_hash(rows: DataFrame, columns: list[str]) -> DataFrame:
    """(rows, hash): a hash of a catalogue that doesn't depend on the order of its rows, and does on how often each is there: of the number of rows and two sums of their hashes, whatever the size."""
    own = F.to_json(F.struct(*columns), {"ignoreNullFields": "false"})
    sums = [F.coalesce(F.sum(F.xxhash64(own, F.lit(i)).cast("decimal(38,0)")), F.lit(0)).cast("string") for i in (1, 2)]
    return rows.agg(F.count("*").alias("rows"), F.sha2(F.concat_ws(",", F.count("*").cast("string"), *sums).cast("binary"), 256).alias("hash"))


def area_assignments(assignments: DataFrame, vehicles: DataFrame, areas: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(vehicle_id, area_ids) of sound assignments (vehicle_id, area_id), and (vehicle_id, area_id, code) of the others: unknown vehicle, unknown area, or a pair given twice."""
    counted = assignments.groupBy("vehicle_id", "area_id").agg(F.count("*").alias("_n"))
    rows = counted.join(vehicles.select("vehicle_id").distinct().withColumn("_v", F.lit(True)), "vehicle_id", "left").join(small(areas.select("area_id").distinct().withColumn("_a", F.lit(True))), "area_id", "left")
    code = F.when(F.col("_v").isNull(), "UNKNOWN_VEHICLE").when(F.col("_a").isNull(), "UNKNOWN_AREA").when(F.col("_n") > 1, "REPEATED_PAIR")
    rows = rows.withColumn("code", code)
    return rows.where("code is null").groupBy("vehicle_id").agg(F.array_sort(F.collect_list("area_id")).alias("area_ids")), rows.where("code is not null").select("vehicle_id", "area_id", "code")


def area_allowed(task_areas: Column, vehicle_areas: Column) -> Column:
    """Whether a vehicle may take a task by area: one without assigned areas may take any."""
    return vehicle_areas.isNull() | F.arrays_overlap(task_areas, vehicle_areas)


def eligible_pairs(vehicles: DataFrame, tasks: DataFrame, *, speed: float, reach: float) -> DataFrame:
    """(task_id, vehicle_id, pickup_s) that may be matched at a time: same fleet, areas that meet, room for the quantity, and a pickup of at most reach seconds on a line.

    Vehicles and tasks meet in squares as wide as the reach, so the join follows how many are near each other."""
    width = speed * reach
    slot = lambda c: F.floor(F.col(c) / width)
    v = vehicles.select(F.col("fleet_id"), "vehicle_id", F.col("place").alias("_vp"), "area_ids", "room", F.explode(F.array(slot("place") - 1, slot("place"), slot("place") + 1)).alias("_s"))
    t = tasks.select("fleet_id", "task_id", F.col("place").alias("_tp"), F.col("areas"), "quantity", slot("place").alias("_s"))
    rows = t.join(v, ["fleet_id", "_s"]).withColumn("pickup_s", F.abs(F.col("_vp") - F.col("_tp")) / speed)
    return rows.where((F.col("pickup_s") <= reach) & (F.col("quantity") <= F.col("room")) & area_allowed(F.col("areas"), F.col("area_ids"))).select("fleet_id", "task_id", "vehicle_id", "pickup_s")


def plan_faults(plans: DataFrame, tasks: DataFrame) -> DataFrame:
    """(vehicle_id, task_id, code) of imported plans (vehicle_id, sequence, task_id): tasks unknown or given twice, and sequences that don't run 1, 2, 3 and on."""
    w = Window.partitionBy("vehicle_id").orderBy("sequence", "task_id")
    twice = F.count("*").over(Window.partitionBy("task_id")) > 1
    rows = plans.withColumns({"_k": F.row_number().over(w), "_twice": twice}).join(tasks.select("task_id").distinct().withColumn("_t", F.lit(True)), "task_id", "left")
    codes = F.filter(F.array(F.when(F.col("_t").isNull(), "UNKNOWN_TASK"), F.when(F.col("_twice"), "REPEATED_TASK"), F.when(F.col("_k") != F.col("sequence"), "GAP_IN_SEQUENCE")), lambda c: c.isNotNull())
    return rows.select("vehicle_id", "task_id", F.explode(codes).alias("code"))


def bisected_areas(places: DataFrame, levels: int) -> DataFrame:
    """(location_id, area): places (location_id, x, y, mass) cut in two `levels` times, each part along its wider axis where half its mass is reached.

    A cut is a running sum in each part, over a range sort, so that no task holds a part; what a level needs of the
    parts themselves is one row each. A part of one place stays whole. Ties go by id."""
    rows = places.withColumn("area", F.lit(0).cast("long"))
    for _ in range(levels):
        part = rows.groupBy("area").agg(((F.max("x") - F.min("x")) >= (F.max("y") - F.min("y"))).alias("_wide"), F.sum("mass").alias("_all"))
        placed = rows.join(small(part), "area").withColumn("_at", F.when(F.col("_wide"), F.col("x")).otherwise(F.col("y")))
        placed = run_up(placed, ["area"], ["_at", "location_id"], "mass", "_before")
        first = placed.groupBy("area").agg(F.min(F.struct("_at", "location_id")).alias("_f")).select("area", F.col("_f.location_id").alias("_first"))
        low = (F.col("location_id") == F.col("_first")) | (2 * F.col("_before") < F.col("_all"))
        rows = written(placed.join(small(first), "area").select(*places.columns, (2 * F.col("area") + F.when(low, 0).otherwise(1)).alias("area")))
    return rows.select("location_id", "area", "mass")
