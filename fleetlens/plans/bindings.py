"""Domain relations over the driver's tables, and the same as SQL for the oracles.

A replication is a day of `events`, a vehicle a user, a fleet the user's number modulo 3, a movement the `value`
seconds from an event on, a cell the key in `props`; times are integer microseconds after midnight, so sums are exact
in any order. Tasks are `orders` with their first and last shipment; their steps are `lineitem`."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

DAY = 86_400_000_000
HOUR = 3_600_000_000
CELLS, BINS = 100, 24


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def movements(spark: SparkSession, sf_dir: str) -> DataFrame:
    ts = F.col("ts")
    start = F.expr("timestampdiff(MICROSECOND, date_trunc('DAY', ts), cast(ts as timestamp))")
    rows = table(spark, sf_dir, "events").select(F.date_format(ts, "yyyy-MM-dd").alias("replication_id"), (F.col("user_id") % 3).alias("fleet_id"), F.col("user_id").alias("vehicle_id"), F.col("event_type").alias("kind"), F.get_json_object("props", "$.k").cast("bigint").alias("cell_id"), start.alias("start"), F.round(F.col("value") * 1_000_000).cast("bigint").alias("length"), "event_id")
    return rows.select("replication_id", "fleet_id", "vehicle_id", "kind", "cell_id", "start", F.least(F.col("start") + F.col("length"), F.lit(DAY)).alias("end"), "event_id").where(F.col("end") > F.col("start"))


def replications(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(F.date_format("ts", "yyyy-MM-dd").alias("replication_id")).distinct()


def tasks(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as tasks: release day, status, fleet, first and last shipment, and the days waited for the first one."""
    served = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.min("l_shipdate").alias("first_service"), F.max("l_shipdate").alias("completion"))
    o = table(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("task_id"), F.date_format("o_orderdate", "yyyy").alias("replication_id"), F.col("o_orderpriority").alias("fleet_id"), F.unix_date(F.col("o_orderdate").cast("date")).cast("bigint").alias("release"), F.when(F.col("o_orderstatus") == "F", "completed").when(F.col("o_orderstatus") == "O", "waiting").otherwise("assigned").alias("status"), "o_orderdate")
    return o.join(served, "task_id", "left").withColumn("wait", F.datediff("first_service", "o_orderdate").cast("bigint")).select("task_id", "replication_id", "fleet_id", "release", "status", "wait", "first_service", "completion")


MOVEMENTS = f"""e AS (SELECT strftime(ts, '%Y-%m-%d') AS replication_id, user_id % 3 AS fleet_id, user_id AS vehicle_id, event_type AS kind,
        CAST(json_extract_string(props, '$.k') AS BIGINT) AS cell_id, epoch_us(ts) - epoch_us(date_trunc('day', ts)) AS s, CAST(round(value * 1000000) AS BIGINT) AS l, event_id FROM events),
    movements AS (SELECT replication_id, fleet_id, vehicle_id, kind, cell_id, s AS "start", least(s + l, {DAY}) AS "end", event_id FROM e WHERE least(s + l, {DAY}) > s)"""
SPLIT = f"""{MOVEMENTS},
    x AS (SELECT *, unnest(generate_series("start" // {HOUR}, ("end" - 1) // {HOUR})) AS bin FROM movements),
    split AS (SELECT *, least("end", (bin + 1) * {HOUR}) - greatest("start", bin * {HOUR}) AS duration FROM x)"""
EXPOSURE = f"""{SPLIT},
    exposure AS (SELECT replication_id, fleet_id, vehicle_id, cell_id, CAST(bin AS BIGINT) AS bin, CAST(sum(duration) AS BIGINT) AS duration FROM split GROUP BY ALL HAVING sum(duration) > 0),
    replications AS (SELECT DISTINCT replication_id FROM e)"""
TASKS = """served AS (SELECT l_orderkey AS task_id, min(l_shipdate) AS first_service, max(l_shipdate) AS completion FROM lineitem GROUP BY 1),
    tasks AS (SELECT o_orderkey AS task_id, strftime(o_orderdate, '%Y') AS replication_id, o_orderpriority AS fleet_id, CAST(date_diff('day', DATE '1970-01-01', CAST(o_orderdate AS DATE)) AS BIGINT) AS release,
        CASE o_orderstatus WHEN 'F' THEN 'completed' WHEN 'O' THEN 'waiting' ELSE 'assigned' END AS status,
        CAST(date_diff('day', CAST(o_orderdate AS DATE), CAST(first_service AS DATE)) AS BIGINT) AS wait, first_service, completion FROM orders LEFT JOIN served ON o_orderkey = task_id)"""
