"""Operational figures: cohorts, waits, utilisation, fleet summaries, arrivals, edge use."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .intervals import clip, islands, split_bins

#: Movement kinds that aren't service.
OPERATIONAL = ("cruise", "depot_return", "reposition")


def status_histogram(tasks: DataFrame, keys: list[str]) -> DataFrame:
    return tasks.groupBy(*keys, "status").agg(F.count("*").alias("n"))


def cohort_summary(tasks: DataFrame, keys: list[str], low: int, high: int) -> DataFrame:
    """Tasks released in [low, high): how many, by status, and mean waits over those that have one."""
    rows = tasks.where((F.col("release") >= low) & (F.col("release") < high))
    return rows.groupBy(*keys).agg(F.count("*").alias("released"), F.count_if(F.col("status") == "completed").alias("completed"), F.count("wait").alias("waits"), (F.sum("wait") / F.count("wait")).alias("mean_wait"))


def activity_summary(activities: DataFrame, keys: list[str], low: int, high: int, idle: str = "idle") -> DataFrame:
    """Clipped active and busy time, and their ratio (null without activity)."""
    d = F.col("end") - F.col("start")
    sums = clip(activities, "start", "end", low, high).groupBy(*keys).agg(F.sum(d).alias("active"), F.sum(F.when(F.col("kind") != idle, d).otherwise(0)).alias("busy"), F.sum(F.when(F.col("kind").isin(*OPERATIONAL), d).otherwise(0)).alias("operational"))
    return sums.withColumn("utilisation", F.col("busy") / F.nullif(F.col("active"), F.lit(0)))


def carry_in(tasks: DataFrame, activities: DataFrame, low: int, high: int) -> DataFrame:
    """Tasks released before the window and active in it."""
    inside = activities.where((F.col("end") > low) & (F.col("start") < high)).select("task_id").distinct()
    return tasks.where(F.col("release") < low).join(inside, "task_id", "left_semi")


def fleet_summary(tasks: DataFrame, fleets: DataFrame, replications: int) -> DataFrame:
    """By fleet over all replications: mean released and completed, and the mean of each replication's completion rate, without empty cohorts."""
    per = tasks.groupBy("replication_id", "fleet_id").agg(F.count("*").alias("released"), F.count_if(F.col("status") == "completed").alias("completed"))
    r = F.lit(float(replications))
    sums = per.groupBy("fleet_id").agg((F.sum("released") / r).alias("mean_released"), (F.sum("completed") / r).alias("mean_completed"), F.avg(F.col("completed") / F.col("released")).alias("completion_rate"))
    return fleets.join(sums, "fleet_id", "left").na.fill(0.0, ["mean_released", "mean_completed"])


def arrivals_by_bin(tasks: DataFrame, keys: list[str], origin: int, width: int, bins: int, replications: int) -> DataFrame:
    """Mean releases in each bin; those outside the axis don't count."""
    b = F.floor((F.col("release") - origin) / width)
    return tasks.withColumn("bin", b).where(F.col("bin").between(0, bins - 1)).groupBy(*keys, "bin").agg((F.count("*") / F.lit(float(replications))).alias("arrivals"))


def active_by_bin(activities: DataFrame, keys: list[str], width: int, replications: int) -> DataFrame:
    """Mean active vehicles in each bin: overlaps over replications and bin width."""
    return split_bins(activities, "start", "end", width).groupBy(*keys, "bin").agg((F.sum("duration") / F.lit(float(replications)) / F.lit(float(width))).alias("active_vehicles"))


def edge_usage(movements: DataFrame, replications: int = 1) -> DataFrame:
    """By edge: time, traversals and the covered share as a union of fractions, the first two over replications."""
    r = F.lit(float(replications))
    sums = movements.groupBy("edge_id").agg((F.sum("duration") / r).alias("duration"), (F.count("*") / r).alias("traversals"))
    union = islands(movements.select("edge_id", "f0", "f1"), ["edge_id"], "f0", "f1").groupBy("edge_id").agg(F.sum(F.col("f1") - F.col("f0")).alias("covered"), F.count("*").alias("stretches"))
    return sums.join(union, "edge_id")
