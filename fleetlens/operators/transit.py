"""Transit feeds: tables of a folder, service days, trips with their stops and faults, blocks, days carried into a window."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from fleetlens.functions.scalar import service_seconds
from fleetlens.operators.sizes import small
from fleetlens.sources.artifacts import read_text_table

#: The tables of a feed, those it must have, and the endings their files may have.
TABLES = ("agency", "stops", "routes", "trips", "stop_times", "calendar", "calendar_dates")
REQUIRED = ("stops", "routes", "trips", "stop_times")
ENDINGS = (".txt", ".csv")
#: A feed with more files or bytes than this is refused.
MOST_FILES, MOST_BYTES = 64, 8 << 30


def feed(spark: SparkSession, folder: str) -> tuple[dict[str, DataFrame], str]:
    """A feed's tables, all columns as text, and a hash of their files' names and contents.

    A table may have either ending, but only one of them; a required one that is missing, no calendar at all, or a
    folder above the bounds is an error."""
    p = spark._jvm.org.apache.hadoop.fs.Path(folder)
    files = [f for f in p.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listStatus(p) if f.isFile()]
    if len(files) > MOST_FILES or sum(f.getLen() for f in files) > MOST_BYTES:
        raise ValueError(f"{folder}: {len(files)} files; at most {MOST_FILES} and {MOST_BYTES} bytes are allowed")
    found: dict[str, str] = {}
    for name in sorted(f.getPath().getName() for f in files):
        stem, dot, end = name.rpartition(".")
        if stem in TABLES and dot + end in ENDINGS:
            if stem in found:
                raise ValueError(f"{folder}: two files for {stem}")
            found[stem] = name
    lacking = [t for t in REQUIRED if t not in found]
    if lacking or not {"calendar", "calendar_dates"} & set(found):
        raise ValueError(f"{folder} lacks {', '.join(lacking or ['a calendar'])}")
    lines = [(t, r.n, r.h) for t, name in sorted(found.items()) for r in spark.read.text(f"{folder}/{name}").agg(F.count("*").alias("n"), F.sum(F.xxhash64("value").cast("decimal(38,0)")).alias("h")).collect()]
    return {t: read_text_table(spark, f"{folder}/{name}") for t, name in found.items()}, hashlib.sha256(repr(lines).encode()).hexdigest()


def service_origin(day: Column, zone: str) -> Column:
    """The instant from which a service day's times count: its local noon less twelve hours, which isn't midnight where clocks change."""
    noon = day.cast("timestamp_ntz") + F.expr("interval 12 hours")
    return F.to_utc_timestamp(noon.cast("timestamp"), zone) - F.expr("interval 12 hours")


def selected_trips(trips: DataFrame, services: DataFrame, routes: list[str] | None = None) -> DataFrame:
    """(day, trip) rows of the trips whose service is active on a day; services has day and service_id."""
    rows = trips if routes is None else trips.where(F.col("route_id").isin(routes))
    return rows.join(small(services), "service_id")


def stop_faults(stop_times: DataFrame, stops: DataFrame, *, copy_missing: bool = False) -> DataFrame:
    """Stop times in order of their sequence with arrival_s, departure_s, step_index and `fault`, null for a sound row.

    Times are texts of HH:MM:SS past midnight, hours past 24 included. With copy_missing a row with one of its two
    times takes it for both. A row is at fault by the first of: unknown stop, sequence that isn't an integer, sequence
    that isn't above the one before, missing time, malformed time, departure before arrival, arrival before the
    departure before."""
    known = stops.select(F.col("stop_id").alias("_stop")).distinct()
    rows = stop_times.join(known, F.col("stop_id") == F.col("_stop"), "left")
    blank = lambda c: F.nullif(F.trim(c), F.lit(""))
    a, d = blank(F.col("arrival_time")), blank(F.col("departure_time"))
    rows = rows.withColumns({"_q": F.col("stop_sequence").try_cast("int"), "_a": F.coalesce(a, d) if copy_missing else a, "_d": F.coalesce(d, a) if copy_missing else d})
    rows = rows.withColumns({"arrival_s": service_seconds(F.col("_a")), "departure_s": service_seconds(F.col("_d"))})
    w = Window.partitionBy("trip_id").orderBy(F.col("_q").asc_nulls_first(), "stop_id", "arrival_s")
    fault = (
        F.when(F.col("_stop").isNull(), "unknown stop")
        .when(F.col("_q").isNull(), "sequence isn't an integer")
        .when(F.lag("_q").over(w) == F.col("_q"), "sequence isn't increasing")
        .when(F.col("_a").isNull() | F.col("_d").isNull(), "missing time")
        .when(F.col("arrival_s").isNull() | F.col("departure_s").isNull(), "malformed time")
        .when(F.col("arrival_s") > F.col("departure_s"), "departure before arrival")
        .when(F.col("arrival_s") < F.lag("departure_s").over(w), "arrival before the last departure")
    )
    return rows.withColumns({"step_index": F.row_number().over(w), "fault": fault}).drop("_stop", "_q", "_a", "_d")


def trip_diagnostics(selected: DataFrame, checked: DataFrame) -> DataFrame:
    """(day, trip_id, route_id, status, stop_count, start_s, end_s, reason): a trip goes whole by its first stop at fault, or without any stop."""
    per = checked.groupBy("trip_id").agg(F.count("*").alias("stops"), F.min_by("fault", F.when(F.col("fault").isNotNull(), F.col("step_index"))).alias("reason"), F.min("arrival_s").alias("start_s"), F.max("departure_s").alias("end_s"))
    rows = selected.join(per, "trip_id", "left").withColumn("reason", F.when(F.col("stops").isNull(), "no stop times").otherwise(F.col("reason")))
    good = F.col("reason").isNull()
    return rows.select("day", "trip_id", "route_id", F.when(good, "accepted").otherwise("rejected").alias("status"), F.when(good, F.col("stops")).otherwise(0).alias("stop_count"), F.when(good, F.col("start_s")).alias("start_s"), F.when(good, F.col("end_s")).alias("end_s"), "reason")


def block_duties(trips: DataFrame, turnaround: int) -> DataFrame:
    """Trips of a day and block in order of start and id, with duty_index, slack to the trip before and whether that is at least the turnaround.

    trips has day, block_id, trip_id, start_s, end_s. Trips without a block aren't in any of these duties."""
    w = Window.partitionBy("day", "block_id").orderBy("start_s", "trip_id")
    slack = F.col("start_s") - F.lag("end_s").over(w)
    return trips.where("block_id <> ''").select("day", "block_id", "trip_id", (F.row_number().over(w) - 1).alias("duty_index"), slack.alias("slack_s"), F.coalesce(slack >= turnaround, F.lit(True)).alias("feasible"))


def carried_trips(trips: DataFrame, origins: DataFrame, low: Column, high: Column) -> DataFrame:
    """Trips of all service days by instants, those that overlap [low, high), with day, start_us, end_us and `carried`, true if it starts before low.

    Each day's times count from its own origin (day, origin_us), so a trip of the day before that runs past midnight is in."""
    at = lambda c: F.col("origin_us") + F.col(c).cast("long") * 1_000_000
    rows = trips.join(small(origins), "day").select("day", "trip_id", at("start_s").alias("start_us"), at("end_s").alias("end_us"))
    return rows.where((F.col("end_us") > low) & (F.col("start_us") < high)).withColumn("carried", F.col("start_us") < low)


def common_days(services: DataFrame) -> DataFrame:
    """Days on which every feed of (feed_id, day, service_id) has a service, with how many services they have in all."""
    feeds = services.select("feed_id").distinct().count()
    return services.groupBy("day").agg(F.count_distinct("feed_id").alias("_f"), F.count_distinct("feed_id", "service_id").alias("services")).where(F.col("_f") == feeds).drop("_f")


def chained(trips: DataFrame, duties: DataFrame) -> DataFrame:
    """Deadheads of given duties (trip_id, vehicle_id): for each trip after the first, from where the vehicle is to where it has to be; duties have to cover exactly the trips."""
    rows = trips.join(duties, "trip_id", "full")
    sound = F.assert_true(F.col("vehicle_id").isNotNull() & F.col("start_s").isNotNull(), F.lit("duties don't cover exactly the trips"))
    rows = rows.where(sound.isNull())
    w = Window.partitionBy("vehicle_id").orderBy("start_s", "trip_id")
    return rows.select("vehicle_id", "trip_id", F.lag("last_stop").over(w).alias("from_stop"), F.col("first_stop").alias("to_stop"), (F.col("start_s") - F.lag("end_s").over(w)).alias("slack_s")).where("from_stop is not null and from_stop <> to_stop")
