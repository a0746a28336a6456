"""Queries over exposure: sparse rows, statistics, coverage, filters, pages, operations."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import exposure as X
from fleetlens.operators import intervals as I
from fleetlens.operators import operations as O
from fleetlens.operators import stats as S
from fleetlens.sources.paging import beyond, filtered, table_page

from .bindings import BINS, CELLS, DAY, EXPOSURE, HOUR, MOVEMENTS, SPLIT, TASKS, movements, replications, tasks

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def sparse(spark, d):
    return X.roll_up(I.split_bins(movements(spark, d), "start", "end", HOUR))


@query(f"WITH {EXPOSURE} SELECT * FROM exposure")
def exposure_sparse(spark, d):
    return sparse(spark, d)


def _moments(spark, d, keys):
    r = replications(spark, d).count()
    sums = S.observed_sums(sparse(spark, d), ["replication_id"], keys, "duration").withColumn("seconds", F.col("duration") / 1e6)
    return S.sparse_moments(sums, keys, "seconds", r), r


_MOMENTS = """, o AS (SELECT replication_id, {keys}, sum(duration) / 1e6 AS x FROM exposure GROUP BY ALL), n AS (SELECT count(*) AS r FROM replications),
    m AS (SELECT {keys}, count(*) AS nonzero, sum(x) AS s, sum(x * x) AS q, (SELECT r FROM n) AS r FROM o GROUP BY ALL)"""


@query(f"WITH {EXPOSURE} {_MOMENTS.format(keys='cell_id, bin')} SELECT cell_id, bin, nonzero, round(s / r, 6) AS mean FROM m")
def exposure_mean(spark, d):
    rows, _ = _moments(spark, d, ["cell_id", "bin"])
    return rows.select("cell_id", "bin", "nonzero", F.round("mean", 6).alias("mean"))


@query(f"WITH {EXPOSURE} {_MOMENTS.format(keys='cell_id, bin')}, v AS (SELECT cell_id, bin, count(*) AS n, avg(x) AS a, var_pop(x) AS p, max(r) AS r FROM o, n GROUP BY ALL) SELECT cell_id, bin, round((p * n + a * a * n * (r - n) / r) / (r - 1), 3) AS variance FROM v")
def exposure_variance(spark, d):
    rows, _ = _moments(spark, d, ["cell_id", "bin"])
    return rows.select("cell_id", "bin", F.round("variance", 3).alias("variance"))


@query(f"WITH {EXPOSURE} {_MOMENTS.format(keys='cell_id')} SELECT cell_id, round(s / r, 5) AS mean, round(sqrt((q - s * s / r) / (r - 1)), 5) AS std FROM m")
def window_matrix_cell(spark, d):
    rows, _ = _moments(spark, d, ["cell_id"])
    return rows.select("cell_id", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query(f"WITH {EXPOSURE} {_MOMENTS.format(keys='bin')} SELECT bin, round(s / r, 5) AS mean, round(sqrt((q - s * s / r) / (r - 1)), 5) AS std FROM m")
def time_summary(spark, d):
    rows, _ = _moments(spark, d, ["bin"])
    return rows.select("bin", F.round("mean", 5).alias("mean"), F.round("std", 5).alias("std"))


@query(f"WITH {EXPOSURE} SELECT replication_id, cell_id, bin, CASE WHEN cell_id IS NOT NULL THEN 'cell' WHEN bin IS NOT NULL THEN 'bin' ELSE 'total' END AS level, CAST(sum(duration) AS BIGINT) AS duration FROM exposure GROUP BY GROUPING SETS ((replication_id, cell_id), (replication_id, bin), (replication_id))")
def window_matrix_levels(spark, d):
    return S.grouped_levels(sparse(spark, d), "replication_id", "duration")


@query(f"""WITH {EXPOSURE}, k AS (SELECT DISTINCT fleet_id, bin FROM exposure), c AS (SELECT replication_id, fleet_id, bin, count(DISTINCT cell_id) / {CELLS}.0 AS coverage FROM exposure GROUP BY ALL),
    a AS (SELECT fleet_id, bin, coalesce(coverage, 0) AS coverage FROM (SELECT * FROM k, replications) LEFT JOIN c USING (replication_id, fleet_id, bin))
    SELECT fleet_id, bin, round(avg(coverage), 9) AS mean, round(quantile_cont(coverage, 0.05), 9) AS p05, round(quantile_cont(coverage, 0.5), 9) AS p50, round(quantile_cont(coverage, 0.95), 9) AS p95 FROM a GROUP BY ALL""")
def coverage_quantiles(spark, d):
    keys = ["replication_id", "fleet_id", "bin"]
    sums = S.observed_sums(sparse(spark, d), keys, ["cell_id"], "duration")
    axis = sums.select("fleet_id", "bin").distinct().crossJoin(F.broadcast(replications(spark, d)))
    c = S.coverage(sums, keys, axis, CELLS, "duration")
    return c.groupBy("fleet_id", "bin").agg(F.avg("coverage").alias("mean"), *S.quantiles(F.col("coverage"))).select("fleet_id", "bin", *[F.round(x, 9).alias(x) for x in ("mean", "p05", "p50", "p95")])


@query(f"WITH {EXPOSURE} SELECT replication_id, fleet_id, vehicle_id, (cell_id % 10) // 5 + 2 * (cell_id // 50) AS coarse_cell, bin // 6 AS coarse_bin, CAST(sum(duration) AS BIGINT) AS duration FROM exposure GROUP BY ALL")
def exposure_coarsened(spark, d):
    c, b = F.col("id"), F.col("id")
    cells = spark.range(CELLS).select(c.alias("cell_id"), (F.expr("(id % 10) div 5 + 2 * (id div 50)")).alias("coarse_cell"))
    bins = spark.range(BINS).select(b.alias("bin"), F.expr("id div 6").alias("coarse_bin"))
    return X.coarsen(sparse(spark, d), F.broadcast(cells), F.broadcast(bins))


@query(f"""WITH {SPLIT} SELECT replication_id, vehicle_id, CAST(sum(duration) AS BIGINT) AS active, CAST(sum(CASE WHEN cell_id < 90 THEN duration ELSE 0 END) AS BIGINT) AS inside,
    CAST(sum(CASE WHEN cell_id >= 90 THEN duration ELSE 0 END) AS BIGINT) AS outside, CAST(0 AS BIGINT) AS residual, true AS conserved FROM split GROUP BY ALL""")
def conservation_check(spark, d):
    m = movements(spark, d)
    inside = F.when(F.col("cell_id") < 90, F.col("cell_id"))
    allocated = I.split_bins(m, "start", "end", HOUR).withColumn("cell_id", inside)
    return X.conservation(allocated, m.withColumn("active", F.col("end") - F.col("start")), ["replication_id", "vehicle_id"])


@query(f"WITH {MOVEMENTS} SELECT kind, CAST(count(*) AS BIGINT) AS n, CAST(sum(least(\"end\", {10 * HOUR}) - greatest(\"start\", {9 * HOUR})) AS BIGINT) AS duration FROM movements WHERE \"end\" > {9 * HOUR} AND \"start\" < {10 * HOUR} GROUP BY 1")
def time_filter_interval(spark, d):
    rows = I.clip(movements(spark, d), "start", "end", 9 * HOUR, 10 * HOUR)
    return rows.groupBy("kind").agg(F.count("*").alias("n"), F.sum(F.col("end") - F.col("start")).alias("duration"))


@query(f"WITH {MOVEMENTS} SELECT event_id, vehicle_id, \"start\" FROM movements WHERE \"start\" >= {6 * HOUR} AND \"start\" < {6 * HOUR + HOUR // 4}")
def time_filter_point(spark, d):
    return movements(spark, d).where((F.col("start") >= 6 * HOUR) & (F.col("start") < 6 * HOUR + HOUR // 4)).select("event_id", "vehicle_id", "start")


@query(f"""WITH {MOVEMENTS} SELECT event_id, vehicle_id, kind, "start", "end", (SELECT count(*) FROM movements WHERE kind = 'click' AND "end" > {8 * HOUR} AND "start" < {20 * HOUR}) AS total
    FROM movements WHERE kind = 'click' AND "end" > {8 * HOUR} AND "start" < {20 * HOUR} ORDER BY event_id LIMIT 100 OFFSET 200""")
def table_page_query(spark, d):
    rows = movements(spark, d).select("event_id", "vehicle_id", "kind", "start", "end")
    return table_page(rows, key=["event_id"], filters={"kind": "click"}, window=("start", "end", 8 * HOUR, 20 * HOUR), offset=200, size=100)


@query(f"""WITH {MOVEMENTS} SELECT vehicle_id, event_id, kind FROM movements WHERE kind = 'click' AND (vehicle_id > 7 OR (vehicle_id = 7 AND event_id > 300)) ORDER BY vehicle_id, event_id LIMIT 100""")
def keyset_page(spark, d):
    rows = filtered(movements(spark, d).select("vehicle_id", "event_id", "kind"), {"kind": "click"})
    return beyond(rows, ["vehicle_id", "event_id"], ["7", "300"]).orderBy("vehicle_id", "event_id").limit(100)


@query(f"""WITH {MOVEMENTS}, b AS (SELECT range AS bin, range * {3 * HOUR} AS lo, CASE range WHEN 7 THEN {DAY} ELSE (range + 1) * {3 * HOUR} END AS hi FROM range(8))
    SELECT bin, fleet_id, CAST(sum(least("end", hi) - greatest("start", lo)) AS BIGINT) AS duration FROM movements JOIN b ON "end" > lo AND "start" < hi GROUP BY ALL""")
def range_join_bins(spark, d):
    bins = spark.range(8).select(F.col("id").alias("bin"), (F.col("id") * 3 * HOUR).alias("bin_start"), ((F.col("id") + 1) * 3 * HOUR).alias("bin_end"))
    return I.join_bins(movements(spark, d), bins, "start", "end").groupBy("bin", "fleet_id").agg(F.sum("duration").alias("duration"))


@query(f"""WITH {MOVEMENTS}, w AS (SELECT *, lag("end") OVER (PARTITION BY replication_id, vehicle_id ORDER BY "start", event_id) AS previous_end FROM movements)
    SELECT event_id, previous_end, "start" FROM w WHERE previous_end > "start" """)
def overlap_violations(spark, d):
    return I.overlap_violations(movements(spark, d), ["replication_id", "vehicle_id"], "start", "end", ["start", "event_id"]).select("event_id", "previous_end", "start")


@query(f"WITH {MOVEMENTS} SELECT event_id, CAST(row_number() OVER (PARTITION BY replication_id, vehicle_id ORDER BY \"start\", \"end\", event_id) - 1 AS BIGINT) AS movement_index FROM movements")
def movement_reindex(spark, d):
    return I.reindex(movements(spark, d), ["replication_id", "vehicle_id"], ["start", "end", "event_id"], "movement_index").select("event_id", "movement_index")


@query(f"""WITH {MOVEMENTS}, a AS (SELECT cell_id, "start", "end", max("end") OVER (PARTITION BY cell_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM movements),
    b AS (SELECT *, sum(CASE WHEN "start" <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY cell_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM a)
    SELECT cell_id, min("start") AS "start", max("end") AS "end", count(*) AS pieces FROM b GROUP BY cell_id, island""")
def edge_usage_islands(spark, d):
    return I.islands(movements(spark, d), ["cell_id"], "start", "end")


@query(f"""WITH {MOVEMENTS}, n AS (SELECT count(DISTINCT replication_id) AS r FROM e),
    a AS (SELECT cell_id, "start", "end", max("end") OVER (PARTITION BY cell_id ORDER BY "start", "end" ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS reach FROM movements),
    b AS (SELECT *, sum(CASE WHEN "start" <= reach THEN 0 ELSE 1 END) OVER (PARTITION BY cell_id ORDER BY "start", "end" ROWS UNBOUNDED PRECEDING) AS island FROM a),
    u AS (SELECT cell_id, island, max("end") - min("start") AS len FROM b GROUP BY ALL), c AS (SELECT cell_id AS edge_id, CAST(sum(len) AS BIGINT) AS covered, count(*) AS stretches FROM u GROUP BY 1)
    SELECT edge_id, round(sum("end" - "start") / max(r), 6) AS duration, round(count(*) / max(r), 6) AS traversals, any_value(covered) AS covered, any_value(stretches) AS stretches FROM movements m JOIN c ON m.cell_id = edge_id, n GROUP BY edge_id""")
def mean_edge_usage(spark, d):
    m = movements(spark, d).select(F.col("cell_id").alias("edge_id"), F.col("start").alias("f0"), F.col("end").alias("f1"), (F.col("end") - F.col("start")).alias("duration"))
    return O.edge_usage(m, replications(spark, d).count()).select("edge_id", F.round("duration", 6).alias("duration"), F.round("traversals", 6).alias("traversals"), "covered", "stretches")


@query(f"WITH {TASKS} SELECT replication_id, fleet_id, status, count(*) AS n FROM tasks GROUP BY ALL")
def status_histogram(spark, d):
    return O.status_histogram(tasks(spark, d), ["replication_id", "fleet_id"])


@query(f"""WITH {TASKS} SELECT fleet_id, count(*) AS released, count(*) FILTER (WHERE status = 'completed') AS completed, count(wait) AS waits, round(CAST(sum(wait) AS DOUBLE) / count(wait), 9) AS mean_wait
    FROM tasks WHERE release >= 9500 AND release < 10500 GROUP BY 1""")
def operation_summary(spark, d):
    return O.cohort_summary(tasks(spark, d), ["fleet_id"], 9500, 10500).withColumn("mean_wait", F.round("mean_wait", 9))


@query(f"""WITH {MOVEMENTS}, c AS (SELECT fleet_id, kind, least("end", {18 * HOUR}) - greatest("start", {6 * HOUR}) AS d FROM movements WHERE "end" > {6 * HOUR} AND "start" < {18 * HOUR})
    SELECT fleet_id, CAST(sum(d) AS BIGINT) AS active, CAST(sum(CASE WHEN kind <> 'error' THEN d ELSE 0 END) AS BIGINT) AS busy, CAST(0 AS BIGINT) AS operational,
    round(CAST(sum(CASE WHEN kind <> 'error' THEN d ELSE 0 END) AS DOUBLE) / sum(d), 9) AS utilisation FROM c GROUP BY 1""")
def activity_utilisation(spark, d):
    return O.activity_summary(movements(spark, d), ["fleet_id"], 6 * HOUR, 18 * HOUR, idle="error").withColumn("utilisation", F.round("utilisation", 9))


@query(f"""WITH {TASKS}, p AS (SELECT replication_id, fleet_id, count(*) AS released, count(*) FILTER (WHERE status = 'completed') AS completed FROM tasks GROUP BY ALL), n AS (SELECT count(DISTINCT replication_id) AS r FROM tasks)
    SELECT fleet_id, round(sum(released) / max(r), 9) AS mean_released, round(sum(completed) / max(r), 9) AS mean_completed, round(avg(completed / released), 9) AS completion_rate FROM p, n GROUP BY 1""")
def fleet_summary(spark, d):
    t = tasks(spark, d)
    out = O.fleet_summary(t, t.select("fleet_id").distinct(), t.select("replication_id").distinct().count())
    return out.select("fleet_id", *[F.round(c, 9).alias(c) for c in ("mean_released", "mean_completed", "completion_rate")])


@query(f"WITH {TASKS}, n AS (SELECT count(DISTINCT replication_id) AS r FROM tasks) SELECT fleet_id, CAST((release - 9131) // 30 AS BIGINT) AS bin, round(count(*) / max(r), 9) AS arrivals FROM tasks, n WHERE release >= 9131 AND (release - 9131) // 30 <= 59 GROUP BY ALL")
def arrivals_by_bin(spark, d):
    t = tasks(spark, d)
    return O.arrivals_by_bin(t, ["fleet_id"], 9131, 30, 60, t.select("replication_id").distinct().count()).withColumn("arrivals", F.round("arrivals", 9))


@query(f"WITH {EXPOSURE}, n AS (SELECT count(*) AS r FROM replications) SELECT fleet_id, bin, round(sum(duration) / max(r) / {HOUR}.0, 9) AS active_vehicles FROM exposure, n GROUP BY ALL")
def active_vehicles_by_bin(spark, d):
    return O.active_by_bin(movements(spark, d), ["fleet_id"], HOUR, replications(spark, d).count()).withColumn("active_vehicles", F.round("active_vehicles", 9))


@query(f"""WITH {TASKS} SELECT task_id, status FROM tasks WHERE release < 9700 AND task_id IN (SELECT l_orderkey FROM lineitem
    WHERE date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) + 1 > 9700 AND date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) < 9800)""")
def carry_in_tasks(spark, d):
    from .bindings import table

    day = F.unix_date(F.col("l_shipdate").cast("date"))
    work = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), day.alias("start"), (day + 1).alias("end"))
    return O.carry_in(tasks(spark, d), work, 9700, 9800).select("task_id", "status")


@query(f"WITH {EXPOSURE}, c AS (SELECT cell_id, CAST(sum(duration) AS DOUBLE) AS x FROM exposure GROUP BY 1) SELECT round(quantile_cont(x, 0.95), 3) AS p95, max(x) AS most, count(x) AS n FROM c WHERE x > 0")
def color_scale(spark, d):
    cells = sparse(spark, d).groupBy("cell_id").agg(F.sum("duration").alias("x"))
    return S.color_scale(cells, "x").withColumn("p95", F.round("p95", 3))
