"""Queries over routing, simulation, duties, streams and stored tables."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.functions import scalar as K
from fleetlens.operators import exposure as X
from fleetlens.operators import graph, kernel, normalize, routing
from fleetlens.operators import stats as S
from fleetlens.sources import artifacts
from fleetlens.sources.scratch import shared_folder
from fleetlens.streaming import exposure_stream

from .bindings import HOUR, MOVEMENTS, movements, table

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def _roads(spark, d):
    n = F.col("n_nationkey")
    own = F.array(F.struct(((n + 1) % 25).alias("v"), (10 + n % 7).alias("s")), F.struct(((n * 3 + 1) % 25).alias("v"), (25 + n % 5).alias("s")))
    rows = table(spark, d, "nation").select(n.alias("u"), F.posexplode(own).alias("k", "e")).where("u <> e.v")
    return rows.select(F.format_string("e%02d_%d", "u", "k").alias("edge_id"), F.format_string("n%02d", "u").alias("u"), F.format_string("n%02d", "e.v").alias("v"), F.col("e.s").cast("double").alias("seconds"))


_TRAVEL = """WITH RECURSIVE e AS (SELECT n_nationkey AS u, (n_nationkey + 1) % 25 AS v, 10 + n_nationkey % 7 AS s FROM nation UNION ALL SELECT n_nationkey, (n_nationkey * 3 + 1) % 25, 25 + n_nationkey % 5 FROM nation WHERE n_nationkey <> (n_nationkey * 3 + 1) % 25),
    p AS (SELECT n_nationkey AS source, n_nationkey AS node, 0 AS s FROM nation UNION SELECT source, v, p.s + e.s FROM p JOIN e ON u = node WHERE p.s + e.s <= 330)
    SELECT 'n' || lpad(CAST(source AS VARCHAR), 2, '0') AS source, 'n' || lpad(CAST(node AS VARCHAR), 2, '0') AS target, CAST(min(s) AS DOUBLE) AS seconds FROM p GROUP BY ALL"""


@query(_TRAVEL)
def od_travel_times(spark, d):
    nodes = table(spark, d, "nation").select(F.format_string("n%02d", "n_nationkey").alias("node"))
    pairs = nodes.select(F.col("node").alias("source")).crossJoin(F.broadcast(nodes.select(F.col("node").alias("target"))))
    places = table(spark, d, "nation").select(F.format_string("n%02d", "n_nationkey").alias("node_id"), F.floor(F.col("n_nationkey") / 7).cast("string").alias("region"))
    return routing.od_costs(pairs, _roads(spark, d), places).select("source", "target", "seconds")


@query(_TRAVEL)
def od_travel_times_all(spark, d):
    return od_travel_times(spark, d)


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, n_nationkey - n_nationkey % 5 FROM nation), c AS (SELECT n_nationkey AS a, n_nationkey AS b FROM nation UNION SELECT c.a, e.b FROM c JOIN e ON e.a = c.b)
    SELECT 'n' || lpad(CAST(x.a AS VARCHAR), 2, '0') AS node_id, 'n' || lpad(CAST(min(x.b) AS VARCHAR), 2, '0') AS component FROM c x JOIN c y ON x.a = y.b AND x.b = y.a GROUP BY x.a""")
def strong_components(spark, d):
    n = F.col("n_nationkey")
    ways = F.explode(F.array((n * 3 + 1) % 25, n - n % 5))
    rows = table(spark, d, "nation").select(n.alias("u"), ways.alias("v"))
    return graph.strong_components(rows.select(F.format_string("n%02d", "u").alias("a"), F.format_string("n%02d", "v").alias("b"))).withColumnRenamed("node", "node_id")


def _simulation(spark, d, what):
    """All orders, a replication for each day, and all suppliers in each; shifts start within the first half of the horizon and end after it."""
    tasks = table(spark, d, "orders").select(F.date_format("o_orderdate", "yyyy-MM-dd").alias("replication_id"), F.format_string("t%06d", "o_orderkey").alias("task_id"), (F.col("o_orderkey") % 3600).cast("double").alias("release"), (F.col("o_custkey") % 500).cast("double").alias("place"), (60 + F.col("o_orderkey") % 60).cast("double").alias("duration"), F.lit(1.0).alias("quantity"))
    shift = F.col("s_suppkey") % 180 * 10
    s = table(spark, d, "supplier").select(F.format_string("v%03d", "s_suppkey").alias("vehicle_id"), shift.cast("double").alias("start_s"), (F.lit(4000) - shift).cast("double").alias("end_s"), (F.col("s_suppkey") * 37 % 500).cast("double").alias("place"), F.lit(30.0).alias("capacity"))
    return kernel.simulate(tasks, s, 3600.0, what)


@query()
def kernel_events(spark, d):
    return _simulation(spark, d, "events")


@query()
def kernel_outcomes(spark, d):
    return _simulation(spark, d, "outcomes")


@query()
def duty_chains(spark, d):
    start = F.unix_date(F.col("o_orderdate").cast("date")) * 10 + F.col("o_orderkey") % 10
    trips = table(spark, d, "orders").select("o_orderpriority", F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderkey").alias("trip_id"), start.cast("bigint").alias("start"), (start + 5 + F.col("o_orderkey") % 30).cast("bigint").alias("end"), (F.col("o_custkey") % 8).alias("origin"), (F.col("o_custkey") % 5).alias("destination"))
    return normalize.chain_duties(trips, 2, ["o_orderpriority", "month"])


@query("""WITH x AS (SELECT l_orderkey AS task_id, l_orderkey % 100 AS release, row_number() OVER w AS k, l_linenumber * 40 - l_partkey % 50 AS target, sum(10 + CAST(l_quantity AS BIGINT)) OVER w AS after, 10 + CAST(l_quantity AS BIGINT) AS own FROM lineitem
        WINDOW w AS (PARTITION BY l_orderkey ORDER BY l_linenumber, l_linenumber * 40 - l_partkey % 50, CAST(l_quantity AS BIGINT) ROWS UNBOUNDED PRECEDING)),
    y AS (SELECT *, max(target - (after - own)) OVER (PARTITION BY task_id ORDER BY k ROWS UNBOUNDED PRECEDING) AS held, max(target - (after - own)) OVER (PARTITION BY task_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS ahead FROM x)
    SELECT task_id, CAST(max(after + greatest(release, held)) AS BIGINT) AS "end", CAST(sum(greatest(after - own + greatest(release, coalesce(ahead, release)) - target, 0)) AS BIGINT) AS lateness FROM y GROUP BY 1""")
def task_timing(spark, d):
    target = F.col("l_linenumber") * 40 - F.col("l_partkey") % 50
    s = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("task_id")).agg(F.collect_list(F.struct(F.col("l_linenumber").alias("step_index"), target.cast("bigint").alias("target"), F.col("l_quantity").cast("bigint").alias("duration"), F.lit(10).cast("bigint").alias("travel"))).alias("steps"))
    return normalize.task_timing(s.withColumn("release", (F.col("task_id") % 100).cast("bigint"))).select("task_id", "end", "lateness")


@query("SELECT strftime(date_trunc('hour', ts), '%Y-%m-%d %H') AS hour, event_type, count(*) AS n, CAST(sum(CAST(round(value * 1000000) AS BIGINT)) AS BIGINT) AS duration_us FROM events GROUP BY ALL")
def stream_windowed_activity(spark, d):
    schema = table(spark, d, "events").schema
    stream = exposure_stream.event_stream(spark, f"{d}/events.parquet", schema)
    out = exposure_stream.run_to_table(exposure_stream.windowed_activity(stream), ["window_start", "event_type"], shared_folder(spark))
    return out.select(F.date_format("window_start", "yyyy-MM-dd HH").alias("hour"), "event_type", "n", "duration_us")


@query(f"WITH {MOVEMENTS} SELECT event_id, replication_id, cell_id FROM movements WHERE replication_id = '2024-01-05'")
def artifact_scan(spark, d):
    root = shared_folder(spark)
    rows = movements(spark, d).select("event_id", "cell_id", "replication_id")
    name = artifacts.publish(rows, root, "movements", {"source": d}, keys=["event_id"], partition_by=["replication_id"])
    return artifacts.open_verified(spark, root, artifacts.located(spark, root, name), name, only={"replication_id": "2024-01-05"}).select("event_id", "replication_id", "cell_id")


@query("""SELECT s_suppkey AS edge_id, round(s_suppkey * 10.0 / CASE s_nationkey % 3 WHEN 0 THEN 20.0 WHEN 1 THEN 10.0 ELSE 5.0 END, 9) AS seconds, CASE s_nationkey % 3 WHEN 0 THEN 'speed' WHEN 1 THEN 'class' ELSE 'constant' END AS provenance FROM supplier""")
def edge_weights(spark, d):
    kind = F.col("s_nationkey") % 3
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("edge_id"), F.lit("a").alias("u"), F.lit("b").alias("v"), (F.col("s_suppkey") * 10.0).alias("length_m"), F.lit(None).cast("double").alias("travel_time_s"), F.when(kind == 0, 20.0).alias("speed_mps"), F.when(kind == 1, "primary").otherwise("lane").alias("road_class"))
    return routing.edge_seconds(e, {"primary": 10.0}, 5.0).select("edge_id", F.round("seconds", 9).alias("seconds"), "provenance")


@query("SELECT x AS duration_s, round(1 - exp(-ln(100.0) * x / 300.0), 9) AS utility FROM (SELECT CAST(range * 15 AS DOUBLE) AS x FROM range(41))")
def utility_curve(spark, d):
    x = (F.col("id") * 15).cast("double")
    return spark.range(41).select(x.alias("duration_s"), F.round(K.utility(x, "exponential", 300.0), 9).alias("utility"))


@query("SELECT user_id, CAST('0x' || substr(sha256('seed|' || user_id), 1, 12) AS BIGINT) AS seed FROM (SELECT DISTINCT user_id FROM events)")
def semantic_seeds(spark, d):
    u = table(spark, d, "events").select("user_id").distinct()
    seed = K.semantic_seed(F.concat(F.lit("seed|"), F.col("user_id").cast("string")))
    return u.select("user_id", F.floor(seed / F.lit(65536)).cast("bigint").alias("seed"))


@query(f"""WITH {MOVEMENTS}, p AS (SELECT range AS piece, range / 4.0 AS f0, (range + 1) / 4.0 AS f1 FROM range(4)), t AS (SELECT replication_id, vehicle_id, piece, "start" + ("end" - "start") * f0 AS s, "start" + ("end" - "start") * f1 AS e FROM movements, p),
    b AS (SELECT range AS bin, range * {6.0 * HOUR} AS lo, (range + 1) * {6.0 * HOUR} AS hi FROM range(4)) SELECT bin, CASE WHEN piece < 3 THEN piece END AS cell_id, round(sum(least(e, hi) - greatest(s, lo)) / 1e6, 3) AS duration FROM t JOIN b ON e > lo AND s < hi GROUP BY ALL""")
def movement_allocation(spark, d):
    m = movements(spark, d).select("replication_id", "fleet_id", "vehicle_id", F.col("kind").alias("movement_kind"), F.lit("e").alias("edge_id"), F.col("start").cast("double").alias("start_s"), F.col("end").cast("double").alias("end_s"), F.lit(0.0).alias("edge_start_fraction"), F.lit(1.0).alias("edge_end_fraction"))
    pieces = spark.range(4).select(F.lit("e").alias("edge_id"), F.when(F.col("id") < 3, F.col("id")).alias("cell_id"), (F.col("id") / 4.0).alias("start_fraction"), ((F.col("id") + 1) / 4.0).alias("end_fraction"))
    bins = spark.range(4).select(F.col("id").alias("bin"), (F.col("id") * 6.0 * HOUR).alias("bin_start"), ((F.col("id") + 1) * 6.0 * HOUR).alias("bin_end"))
    return X.allocate_movements(m, F.broadcast(pieces), bins, 0.0, 24.0 * HOUR).groupBy("bin", "cell_id").agg(F.round(F.sum("duration") / 1e6, 3).alias("duration"))


@query("SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_samp(value), 6) AS std, round(quantile_cont(value, 0.05), 6) AS p05, round(quantile_cont(value, 0.95), 6) AS p95 FROM events GROUP BY 1")
def scalar_summary(spark, d):
    s = S.scalar_summary(table(spark, d, "events"), ["event_type"], "value")
    return s.select("event_type", "n", *[F.round(c, 6).alias(c) for c in ("mean", "std", "p05", "p95")])
