"""Imports: demand with issues and quarantine, rates, catalogues, calendars, duties."""

from __future__ import annotations

from bisect import bisect_left, insort

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window


def demand_issues(rows: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """(source_row, task_id, code): one row for each check that a source row fails; a check that is null fails."""
    failed = F.filter(F.array(*[F.when(~F.coalesce(ok, F.lit(False)), F.lit(code)) for code, ok in sorted(checks.items())]), lambda c: c.isNotNull())
    return rows.select("source_row", "task_id", F.explode(failed).alias("code"))


def quarantine(rows: DataFrame, issues: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Rows of tasks without any issue, and those of the others: a task goes whole."""
    bad = issues.select("task_id").distinct()
    return rows.join(bad, "task_id", "left_anti"), rows.join(bad, "task_id", "left_semi")


def rate_overlaps(rates: DataFrame, keys: list[str]) -> DataFrame:
    """Rate intervals of a key that start before an earlier one ends."""
    w = Window.partitionBy(*keys).orderBy("start", "end").rowsBetween(Window.unboundedPreceding, -1)
    return rates.withColumn("reach", F.max("end").over(w)).where("start < reach")


def duplicates(rows: DataFrame, keys: list[str]) -> DataFrame:
    return rows.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_keys(rows: DataFrame, known: DataFrame, key: str) -> DataFrame:
    return rows.join(known.select(key), key, "left_anti")


def generated_ids(rows: DataFrame, namespace: str, order: list[str]) -> DataFrame:
    """Ids ns_000001 and on, within each fleet, in order."""
    n = F.row_number().over(Window.partitionBy("fleet_id").orderBy(*order))
    return rows.withColumn("vehicle_name", F.format_string(f"{namespace}_%06d", n))


def active_services(calendar: DataFrame, exceptions: DataFrame, days: DataFrame) -> DataFrame:
    """(day, service_id): services whose range and weekday hold, plus added ones, less removed ones. calendar.weekdays is a string of seven 0 and 1 from Monday."""
    base = days.join(F.broadcast(calendar), (F.col("day") >= F.col("start_day")) & (F.col("day") <= F.col("end_day"))).where(F.substr("weekdays", F.weekday("day") + 1, F.lit(1)) == "1").select("day", "service_id")
    added = exceptions.where("type = 1").join(days, "day", "left_semi").select("day", "service_id")
    return base.unionByName(added).distinct().join(exceptions.where("type = 2"), ["day", "service_id"], "left_anti")


def representative_day(services: DataFrame) -> DataFrame:
    """The day whose set of services is the most frequent, ties to the earliest: (day, days)."""
    signed = services.groupBy("day").agg(F.concat_ws(",", F.array_sort(F.collect_set("service_id"))).alias("signature"))
    return signed.groupBy("signature").agg(F.count("*").alias("days"), F.min("day").alias("day")).orderBy(F.desc("days"), "day").limit(1).select("day", "days")


def largest_remainder(shares: DataFrame, total: int, key: str = "area") -> DataFrame:
    """Whole units of total by weight; what is left goes to the largest fractions, ties to the smaller key. Weights are integers, so it is exact."""
    all_ = shares.agg(F.sum("weight").alias("_all"))
    rows = shares.crossJoin(F.broadcast(all_)).withColumn("_base", F.expr(f"(weight * {total}) div _all")).withColumn("_rest", F.expr(f"(weight * {total}) % _all"))
    left = F.lit(total) - F.sum("_base").over(Window.partitionBy(F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(F.lit(1)).orderBy(F.desc("_rest"), key))
    return rows.select(key, (F.col("_base") + (rank <= left).cast("bigint")).alias("units"))


def task_timing(steps: DataFrame) -> DataFrame:
    """Arrival recursion of each task over its steps in order: service begins at max(arrival, target), ends a duration later, and travel follows.

    steps has task_id, release and an array `steps` of (step_index, target, duration, travel); a fold, no UDF."""
    ordered = F.array_sort("steps")
    walked = F.aggregate(ordered, F.struct(F.col("release").alias("at"), F.lit(0).cast("bigint").alias("late")), lambda a, s: F.struct((F.greatest(a["at"], s["target"]) + s["duration"] + s["travel"]).alias("at"), (a["late"] + F.greatest(F.lit(0), a["at"] - s["target"])).alias("late")))
    return steps.select("task_id", walked["at"].alias("end"), walked["late"].alias("lateness"))


def chain_duties(trips: DataFrame, turnaround: int, keys: list[str]) -> DataFrame:
    """Duties by greedy chaining within a group: each trip in order joins the duty that ended where it starts (deadhead 0) or anywhere, with least (deadhead, slack, duty), else it opens one.

    Sequential by nature, so it runs as one pandas function a group; a group is one depot's day. Open duties are held
    by place in order of their end, so a trip looks at one of each place."""

    def run(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["start", "trip_id"], ignore_index=True)
        ends: dict = {}  # place -> (end, -duty) in order
        duties, n = [], 0
        for r in pdf.itertuples():
            best = None
            for place, held in ends.items():
                away = int(place != r.origin)
                i = bisect_left(held, (r.start - turnaround * (1 + away), 1)) - 1
                if i >= 0 and (best is None or (away, r.start - held[i][0], -held[i][1]) < best[0]):
                    best = (away, r.start - held[i][0], -held[i][1]), place, i
            if best:
                duty = best[0][2]
                del ends[best[1]][best[2]]
            else:
                duty, n = n, n + 1
            insort(ends.setdefault(r.destination, []), (r.end, -duty))
            duties.append(duty)
        return pdf.assign(duty=duties)[[*keys, "trip_id", "duty"]]

    kinds = {f.name: f.dataType.simpleString() for f in trips.schema}
    return trips.groupBy(*keys).applyInPandas(run, ", ".join(f"{k} {kinds[k]}" for k in [*keys, "trip_id"]) + ", duty bigint")
