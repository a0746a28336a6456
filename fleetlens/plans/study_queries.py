"""Queries over transit feeds, draws, polygons, supply, checks and matrices."""

from __future__ import annotations

from pyspark.sql import functions as F

from fleetlens.operators import audit as A
from fleetlens.operators import intervals as I
from fleetlens.operators import planar as L
from fleetlens.operators import portfolio as P
from fleetlens.operators import realise as R
from fleetlens.operators import stats as S
from fleetlens.operators import supply as V
from fleetlens.operators import transit as T

from .bindings import DAY, EXPOSURE, HOUR, MOVEMENTS, SPLIT, movements, replications, table
from .exposure_queries import sparse
from .portfolio_queries import _CALENDAR, _budgets, _portfolios, _rounds, _samples_sql, _services, _statistics, _STATISTICS, _vehicles

QUERIES: dict = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


# Transit: orders are trips, their lines are stops, suppliers are stop places.
_FEED = f"""{_CALENDAR}, places AS (SELECT CAST(s_suppkey AS VARCHAR) AS stop_id FROM supplier WHERE s_suppkey % 20 <> 0),
    trips AS (SELECT o_orderkey AS trip_id, o_orderpriority AS route_id, CASE o_orderkey % 3 WHEN 0 THEN 'weekday' WHEN 1 THEN 'weekend' ELSE 'market' END AS service_id, CASE WHEN o_custkey % 4 = 0 THEN '' ELSE 'b' || (o_custkey % 50) END AS block_id FROM orders),
    raw AS (SELECT l_orderkey AS trip_id, CAST(l_suppkey AS VARCHAR) AS stop_id, CASE WHEN l_partkey % 97 <> 0 THEN l_linenumber END AS q, (l_orderkey % 30) * 3600 + l_linenumber * 300 + CAST(l_quantity AS BIGINT) * 10 AS a, CASE WHEN l_partkey % 53 <> 0 THEN (l_orderkey % 30) * 3600 + l_linenumber * 300 + CAST(l_quantity AS BIGINT) * 10 + l_suppkey % 60 END AS d FROM lineitem),
    k AS (SELECT raw.*, p.stop_id IS NULL AS unknown, row_number() OVER w AS step_index, lag(q) OVER w AS pq, lag(d) OVER w AS pd FROM raw LEFT JOIN places p USING (stop_id) WINDOW w AS (PARTITION BY trip_id ORDER BY q NULLS FIRST, stop_id COLLATE C, a)),
    checked AS (SELECT *, CASE WHEN unknown THEN 'unknown stop' WHEN q IS NULL THEN 'sequence isn''t an integer' WHEN pq = q THEN 'sequence isn''t increasing' WHEN d IS NULL THEN 'missing time' WHEN a > d THEN 'departure before arrival' WHEN a < pd THEN 'arrival before the last departure' END AS fault FROM k),
    per AS (SELECT trip_id, count(*) AS stops, arg_min(fault, CASE WHEN fault IS NOT NULL THEN step_index END) AS reason, min(a) AS s, max(d) AS e FROM checked GROUP BY 1),
    diagnosed AS (SELECT strftime(day, '%Y-%m-%d') AS day, t.trip_id, t.route_id, t.block_id, stops, CASE WHEN stops IS NULL THEN 'no stop times' ELSE reason END AS reason, s, e FROM trips t JOIN active USING (service_id) LEFT JOIN per USING (trip_id))"""


def _clock(s):
    return F.format_string("%02d:%02d:%02d", F.floor(s / 3600).cast("int"), F.floor(s % 3600 / 60).cast("int"), (s % 60).cast("int"))


def _trips(spark, d):
    service = F.when(F.col("o_orderkey") % 3 == 0, "weekday").when(F.col("o_orderkey") % 3 == 1, "weekend").otherwise("market")
    block = F.when(F.col("o_custkey") % 4 == 0, "").otherwise(F.concat(F.lit("b"), (F.col("o_custkey") % 50).cast("string")))
    trips = table(spark, d, "orders").select(F.col("o_orderkey").alias("trip_id"), F.col("o_orderpriority").alias("route_id"), service.alias("service_id"), block.alias("block_id"))
    return T.selected_trips(trips, _services(spark))


def _checked(spark, d):
    at = (F.col("l_orderkey") % 30) * 3600 + F.col("l_linenumber") * 300 + F.col("l_quantity").cast("bigint") * 10
    times = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("trip_id"), F.col("l_suppkey").cast("string").alias("stop_id"), F.when(F.col("l_partkey") % 97 != 0, F.col("l_linenumber").cast("string")).otherwise("x").alias("stop_sequence"), _clock(at).alias("arrival_time"), F.when(F.col("l_partkey") % 53 != 0, _clock(at + F.col("l_suppkey") % 60)).otherwise("").alias("departure_time"))
    stops = table(spark, d, "supplier").where("s_suppkey % 20 <> 0").select(F.col("s_suppkey").cast("string").alias("stop_id"))
    return T.stop_faults(times, stops)


def _diagnosed(spark, d):
    return T.trip_diagnostics(_trips(spark, d), _checked(spark, d))


@query(f"WITH {_FEED} SELECT day, CASE WHEN reason IS NULL THEN 'accepted' ELSE 'rejected' END AS status, reason, count(*) AS n, CAST(sum(CASE WHEN reason IS NULL THEN stops ELSE 0 END) AS BIGINT) AS stops, CAST(sum(CASE WHEN reason IS NULL THEN e - s END) AS BIGINT) AS seconds FROM diagnosed GROUP BY ALL")
def gtfs_trip_diagnostics(spark, d):
    rows = _diagnosed(spark, d).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    return rows.groupBy("day", "status", "reason").agg(F.count("*").alias("n"), F.sum("stop_count").alias("stops"), F.sum(F.col("end_s") - F.col("start_s")).cast("bigint").alias("seconds"))


@query(f"WITH {_FEED}, good AS (SELECT trip_id FROM per WHERE reason IS NULL) SELECT trip_id, CAST(step_index AS INTEGER) AS step_index, stop_id, CAST(a AS INTEGER) AS arrival_s, CAST(d AS INTEGER) AS departure_s FROM checked WHERE trip_id IN (SELECT trip_id FROM good)")
def gtfs_trip_stops(spark, d):
    rows = _checked(spark, d)
    bad = rows.where("fault is not null").select("trip_id").distinct()
    return rows.join(bad, "trip_id", "left_anti").select("trip_id", "step_index", "stop_id", "arrival_s", "departure_s")


@query(f"""WITH {_FEED}, g AS (SELECT *, lag(e) OVER (PARTITION BY day, block_id ORDER BY s, trip_id) AS pe FROM diagnosed WHERE reason IS NULL AND block_id <> '')
    SELECT day, block_id, count(*) AS trips, count(*) FILTER (WHERE s - pe < 300) AS infeasible, CAST(max(s - pe) AS INTEGER) AS longest_slack FROM g GROUP BY ALL""")
def gtfs_block_duties(spark, d):
    trips = _diagnosed(spark, d).where("status = 'accepted'").join(_trips(spark, d).select("day", "trip_id", "block_id"), ["day", "trip_id"]).withColumn("day", F.date_format("day", "yyyy-MM-dd"))
    duties = T.block_duties(trips, 300)
    return duties.groupBy("day", "block_id").agg(F.count("*").alias("trips"), F.count_if(~F.col("feasible")).alias("infeasible"), F.max("slack_s").alias("longest_slack"))


@query(f"""WITH {_FEED}, t AS (SELECT day, trip_id, epoch_us(CAST(day AS TIMESTAMP)) + s * 1000000 AS a, epoch_us(CAST(day AS TIMESTAMP)) + e * 1000000 AS b FROM diagnosed WHERE reason IS NULL)
    SELECT day, a < epoch_us(TIMESTAMP '2024-01-14') AS carried, count(*) AS n, CAST(sum(b - a) AS BIGINT) AS length_us FROM t WHERE b > epoch_us(TIMESTAMP '2024-01-14') AND a < epoch_us(TIMESTAMP '2024-01-15') GROUP BY ALL""")
def gtfs_carried_trips(spark, d):
    origins = _services(spark).select("day").distinct().withColumn("origin_us", F.unix_micros(T.service_origin(F.col("day"), "UTC")))
    low = F.unix_micros(F.lit("2024-01-14").cast("timestamp"))
    rows = T.carried_trips(_diagnosed(spark, d).where("status = 'accepted'"), origins, low, low + DAY)
    return rows.groupBy(F.date_format("day", "yyyy-MM-dd").alias("day"), "carried").agg(F.count("*").alias("n"), F.sum(F.col("end_us") - F.col("start_us")).alias("length_us"))


@query(f"WITH {_CALENDAR}, f AS (SELECT 'a' AS feed, day, service_id FROM active UNION ALL SELECT 'b', day, service_id FROM active WHERE service_id <> 'weekend') SELECT strftime(day, '%Y-%m-%d') AS day, count(DISTINCT feed || service_id) AS services FROM f GROUP BY 1 HAVING count(DISTINCT feed) = 2")
def gtfs_common_days(spark, d):
    s = _services(spark)
    both = s.withColumn("feed_id", F.lit("a")).unionByName(s.where("service_id <> 'weekend'").withColumn("feed_id", F.lit("b")))
    return T.common_days(both).select(F.date_format("day", "yyyy-MM-dd").alias("day"), "services")


# Draws: nations are fleets, their customers give the rates.
def _u(text: str) -> str:
    return f"CAST('0x' || substr(md5({text}), 1, 13) AS BIGINT) / 4503599627370496.0"


_ARRIVALS = f"""i AS (SELECT 'replication_00' || r AS replication_id, c_nationkey AS fleet_id, h AS interval_id, h * 3600.0 AS s, (h + 1) * 3600.0 AS e, k * (1 + h % 3) / 72000.0 AS rate FROM (SELECT c_nationkey, count(*) AS k FROM customer GROUP BY 1), range(1, 3) x(r), range(24) y(h)),
    m AS (SELECT *, greatest(ceil(rate * (e - s) / 8), 1) AS parts FROM i), p AS (SELECT *, rate * (e - s) / parts AS mean, unnest(range(1, CAST(parts AS BIGINT) + 1)) AS part FROM m),
    q AS (SELECT *, {_u("'arrivals|' || replication_id || '|' || fleet_id || '|' || interval_id || '|' || part")} AS u FROM p),
    c AS (SELECT q.*, k, sum(exp(-mean) * mean ** k / gamma(k + 1)) OVER (PARTITION BY replication_id, fleet_id, interval_id, part ORDER BY k) AS cdf FROM q, range(64) z(k)),
    n AS (SELECT replication_id, fleet_id, interval_id, CAST(count(*) FILTER (WHERE cdf <= u) AS BIGINT) AS n FROM c GROUP BY ALL),
    x AS (SELECT i.*, n, unnest(range(1, n + 1)) AS k FROM i JOIN n USING (replication_id, fleet_id, interval_id)),
    a AS (SELECT *, s + (e - s) * {_u("'arrivals.release|' || replication_id || '|' || fleet_id || '|' || interval_id || '|' || k")} AS release_s FROM x),
    arrivals AS (SELECT replication_id, fleet_id, interval_id, row_number() OVER (PARTITION BY replication_id, fleet_id, interval_id ORDER BY release_s, k) - 1 AS rank, release_s FROM a)"""


def _intervals(spark, d):
    rows = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("fleet_id")).agg(F.count("*").alias("c")).withColumn("interval_id", F.explode(F.sequence(F.lit(0).cast("bigint"), F.lit(23).cast("bigint"))))
    rows = rows.withColumn("r", F.explode(F.sequence(F.lit(1), F.lit(2))))
    start = F.col("interval_id") * 3600.0
    return rows.select(F.format_string("replication_%03d", "r").alias("replication_id"), "fleet_id", "interval_id", start.alias("start_s"), (start + 3600.0).alias("end_s"), (F.col("c") * (1 + F.col("interval_id") % 3) / 72000.0).alias("rate"))


def _places(spark, d):
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("location_id"), (1 + F.col("s_suppkey") % 5).cast("double").alias("weight"))


_CUT = """w AS (SELECT location_id, sum(weight) OVER (ORDER BY location_id) AS c1, weight, sum(weight) OVER () AS whole FROM {source}), cuts AS (SELECT location_id, (c1 - weight) / whole AS c0, c1 / whole AS c1 FROM w)"""


@query(f"""WITH {_ARRIVALS}, places AS (SELECT s_suppkey AS location_id, CAST(1 + s_suppkey % 5 AS DOUBLE) AS weight FROM supplier), {_CUT.format(source='places')},
    d AS (SELECT *, {_u("'locations|' || replication_id || '|' || fleet_id || '|' || interval_id || '|' || rank")} AS u FROM arrivals)
    SELECT replication_id, fleet_id, interval_id, rank, round(release_s, 6) AS release_s, location_id FROM d JOIN cuts ON u >= c0 AND u < c1""")
def poisson_arrivals(spark, d):
    rows = R.located(R.arrivals(_intervals(spark, d)), _places(spark, d), ["replication_id", "fleet_id", "interval_id", "rank"])
    return rows.select("replication_id", "fleet_id", "interval_id", "rank", F.round("release_s", 6).alias("release_s"), "location_id")


@query(f"""WITH h AS (SELECT range AS location_id, CAST(1 + range % 6 AS DOUBLE) AS weight FROM range(24)), {_CUT.format(source='h')}, t AS (SELECT c_nationkey AS fleet_id, count(*) AS total FROM customer GROUP BY 1),
    x AS (SELECT fleet_id, unnest(range(1, total + 1)) AS k FROM t), d AS (SELECT *, {_u("'profile|' || fleet_id || '|' || k")} AS u FROM x) SELECT fleet_id, location_id AS hour, count(*) AS n FROM d JOIN cuts ON u >= c0 AND u < c1 GROUP BY ALL""")
def profile_fixed_draws(spark, d):
    totals = table(spark, d, "customer").groupBy(F.col("c_nationkey").alias("fleet_id")).agg(F.count("*").alias("total"))
    hours = spark.range(24).select(F.col("id").alias("hour"), (1 + F.col("id") % 6).cast("double").alias("weight"))
    return R.fixed_total(totals, ["fleet_id"], hours, "hour", "profile")


@query(f"""WITH t AS (SELECT c_custkey AS task_id, unnest(range(1, 33)) AS attempt FROM customer), n AS (SELECT n_nationkey AS location_id, CAST(1 + n_nationkey % 4 AS DOUBLE) AS weight FROM nation), {_CUT.format(source='n')},
    u AS (SELECT *, {_u("'od.origin|' || task_id || '|' || attempt")} AS uo, {_u("'od.destination|' || task_id || '|' || attempt")} AS ud FROM t),
    p AS (SELECT task_id, attempt, o.location_id AS origin, e.location_id AS destination FROM u JOIN cuts o ON uo >= o.c0 AND uo < o.c1 JOIN cuts e ON ud >= e.c0 AND ud < e.c1),
    g AS (SELECT *, row_number() OVER (PARTITION BY task_id ORDER BY attempt) AS r FROM p WHERE origin <> destination AND (origin + destination) % 3 <> 0) SELECT task_id, CAST(attempt AS INTEGER) AS attempt, origin, destination FROM g WHERE r = 1""")
def od_draws(spark, d):
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("location_id"), (1 + F.col("n_nationkey") % 4).cast("double").alias("weight"))
    a = n.select(F.col("location_id").alias("origin"))
    pairs = a.crossJoin(F.broadcast(a.withColumnRenamed("origin", "destination"))).where("(origin + destination) % 3 <> 0")
    tasks = table(spark, d, "customer").select(F.col("c_custkey").alias("task_id"))
    return R.od_pairs(tasks, ["task_id"], n, n, pairs)[0]


@query("SELECT l_orderkey AS order_id, count(*) AS n, CAST(sum(k) AS BIGINT) AS places FROM (SELECT l_orderkey, unnest(range(1, CAST(l_quantity AS BIGINT) % 4 + 1)) AS k FROM lineitem) GROUP BY 1")
def expanded_instances(spark, d):
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("order_id"), (F.col("l_quantity").cast("bigint") % 4).alias("c"))
    return R.expanded(rows, "c").groupBy("order_id").agg(F.count("*").alias("n"), F.sum("instance").alias("places"))


@query(f"SELECT c_custkey AS vehicle_id, round(c_custkey % 12 + c_custkey % 4 * {_u("'availability|replication_001|' || c_custkey")}, 9) AS start_s, round(c_custkey % 12 + c_custkey % 4 * {_u("'availability|replication_001|' || c_custkey")} + 6, 9) AS end_s FROM customer")
def availability_draws(spark, d):
    first = (F.col("c_custkey") % 12).cast("double")
    v = table(spark, d, "customer").select(F.lit("replication_001").alias("replication_id"), F.col("c_custkey").alias("vehicle_id"), first.alias("first_s"), (first + F.col("c_custkey") % 4).alias("latest_s"), F.lit(6.0).alias("duration_s"))
    return R.availability(v).select("vehicle_id", *[F.round(c, 9).alias(c) for c in ("start_s", "end_s")])


@query("SELECT 'replication_' || lpad(CAST(range + 1 AS VARCHAR), 3, '0') AS replication_id, sha256('study|replication_' || lpad(CAST(range + 1 AS VARCHAR), 3, '0')) AS key FROM range(200)")
def replication_names(spark, d):
    return R.replication_ids(spark, 200, "study")


@query("""WITH w AS (SELECT c_nationkey AS fleet_id, c_custkey % 22 + c_custkey % 3 * 0.25 AS a, c_custkey % 22 + c_custkey % 3 * 0.25 + c_custkey % 5 * 1.5 AS b FROM customer), x AS (SELECT f.fleet_id, h AS hour FROM (SELECT DISTINCT fleet_id FROM w) f, range(24) t(h))
    SELECT x.fleet_id, CAST(hour AS INTEGER) AS hour, round(sum(greatest(least(b, hour + 1) - greatest(a, hour), 0)), 6) AS active FROM x JOIN w USING (fleet_id) GROUP BY ALL""")
def hourly_preview(spark, d):
    a = F.col("c_custkey") % 22 + F.col("c_custkey") % 3 * 0.25
    w = table(spark, d, "customer").select(F.col("c_nationkey").alias("fleet_id"), a.alias("start_h"), (a + F.col("c_custkey") % 5 * 1.5).alias("end_h"))
    return R.hourly_preview(w, ["fleet_id"], 24).withColumn("active", F.round("active", 6))


# Polygons: regions are concave pentagons, suppliers are rectangles.
_RING = "[{'x': r * 2200 - 1000, 'y': 0}, {'x': r * 2200 + 800, 'y': 0}, {'x': r * 2200 + 800, 'y': 800}, {'x': r * 2200, 'y': 400}, {'x': r * 2200 - 1000, 'y': 800}]"


@query(f"""WITH g AS (SELECT r AS polygon_id, {_RING} AS p FROM (SELECT r_regionkey AS r FROM region)), e AS (SELECT polygon_id, p[i].x AS x1, p[i].y AS y1, p[i % 5 + 1].x AS x2, p[i % 5 + 1].y AS y2 FROM g, range(1, 6) t(i)),
    q AS (SELECT c_custkey AS point_id, CAST(floor(c_acctbal) AS BIGINT) AS x, c_nationkey * 40 AS y FROM customer),
    c AS (SELECT point_id, polygon_id, count(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < x1 + (y - y1) * (x2 - x1) / CASE WHEN y2 = y1 THEN 1.0 ELSE CAST(y2 - y1 AS DOUBLE) END) AS n,
        bool_or((x2 - x1) * (y - y1) = (y2 - y1) * (x - x1) AND x BETWEEN least(x1, x2) AND greatest(x1, x2) AND y BETWEEN least(y1, y2) AND greatest(y1, y2)) AS edge FROM q, e GROUP BY ALL)
    SELECT point_id, min(polygon_id) FILTER (WHERE edge OR n % 2 = 1) AS polygon_id FROM c GROUP BY 1""")
def point_in_polygon(spark, d):
    r = F.col("r_regionkey").cast("bigint") * 2200
    corner = lambda dx, y: F.struct((r + dx).alias("x"), F.lit(y).cast("bigint").alias("y"))
    polygons = table(spark, d, "region").select(F.col("r_regionkey").alias("polygon_id"), F.array(corner(-1000, 0), corner(800, 0), corner(800, 800), corner(0, 400), corner(-1000, 800)).alias("ring"))
    points = table(spark, d, "customer").select(F.col("c_custkey").alias("point_id"), F.floor("c_acctbal").alias("x"), (F.col("c_nationkey").cast("bigint") * 40).alias("y"))
    return L.point_owner(points, L.ring_edges(polygons), 100.0)


def _rectangles(spark, d):
    x, y = F.floor("s_acctbal").cast("double"), F.col("s_nationkey") * 40.0
    corner = lambda dx, dy: F.struct((x + dx).alias("x"), (y + dy).alias("y"))
    return table(spark, d, "supplier").select(F.col("s_suppkey").alias("polygon_id"), F.array(corner(0, 0), corner(431, 0), corner(431, 137), corner(0, 137), corner(0, 0)).alias("ring"))


_SHARES = """s AS (SELECT s_suppkey AS polygon_id, floor(s_acctbal) AS x, s_nationkey * 40.0 AS y FROM supplier), c AS (SELECT *, unnest(generate_series(CAST(floor(x / 100) AS BIGINT), CAST(ceil((x + 431) / 100) AS BIGINT) - 1)) AS i FROM s),
    b AS (SELECT *, unnest(generate_series(CAST(floor(y / 100) AS BIGINT), CAST(ceil((y + 137) / 100) AS BIGINT) - 1)) AS j FROM c), a AS (SELECT polygon_id, i, j, (least(x + 431, (i + 1) * 100) - greatest(x, i * 100)) * (least(y + 137, (j + 1) * 100) - greatest(y, j * 100)) AS area FROM b)"""


@query(f"WITH {_SHARES} SELECT polygon_id, i, j, round(area, 6) AS area FROM a WHERE area > 0")
def polygon_cell_areas(spark, d):
    return L.cell_areas(L.ring_edges(_rectangles(spark, d)), 100.0).withColumn("area", F.round("area", 6))


@query(f"WITH {_SHARES} SELECT i, j, round(sum(area / (431 * 137.0) * (1 + polygon_id % 7)), 6) AS total FROM a WHERE area > 0 GROUP BY ALL")
def feature_values_by_cell(spark, d):
    values = table(spark, d, "supplier").select(F.col("s_suppkey").alias("polygon_id"), (1 + F.col("s_suppkey") % 7).cast("double").alias("value"))
    return L.polygon_totals(L.ring_edges(_rectangles(spark, d)), 100.0, values).withColumn("total", F.round("total", 6))


@query("SELECT CAST(ceil(floor(c_acctbal) / 100) - 1 AS BIGINT) AS i, CAST(ceil(c_nationkey * 40 / 100) - 1 AS BIGINT) AS j, CAST(count(*) AS DOUBLE) AS total FROM customer GROUP BY ALL")
def feature_points_by_cell(spark, d):
    points = table(spark, d, "customer").select(F.floor("c_acctbal").cast("double").alias("x"), (F.col("c_nationkey") * 40.0).alias("y"))
    return L.point_counts(points, 100.0)


@query("""WITH s AS (SELECT s_suppkey AS k, s_acctbal AS x1, s_acctbal + 731 AS x2 FROM supplier), c AS (SELECT *, unnest(generate_series(CAST(floor(x1 / 100) AS BIGINT), CAST(ceil(x2 / 100) AS BIGINT) - 1)) AS i FROM s) SELECT i, CAST(0 AS BIGINT) AS j, round(sum(least(x2, (i + 1) * 100) - greatest(x1, i * 100)), 4) AS total FROM c GROUP BY 1""")
def feature_lines_by_cell(spark, d):
    e = table(spark, d, "supplier").select(F.col("s_suppkey").alias("edge_id"), F.col("s_acctbal").alias("x1"), F.lit(50.0).alias("y1"), (F.col("s_acctbal") + 731).alias("x2"), F.lit(50.0).alias("y2"))
    return L.line_lengths(e, 100.0).withColumn("total", F.round("total", 4))


@query("SELECT CAST(sum(floor(c_acctbal)) AS BIGINT) AS total, CAST(sum(CASE WHEN c_nationkey IN (SELECT s_nationkey FROM supplier) THEN floor(c_acctbal) ELSE 0 END) AS BIGINT) AS resolved, count(*) FILTER (WHERE c_nationkey NOT IN (SELECT s_nationkey FROM supplier)) AS unresolved_rows FROM customer")
def feature_mass(spark, d):
    c = table(spark, d, "customer").select(F.col("c_nationkey").alias("k"), F.floor("c_acctbal").alias("m"))
    return L.mass_report(c, table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")), "k", "m")


@query("SELECT c_mktsegment AS segment, count(*) AS n FROM customer WHERE c_mktsegment IN ('BUILDING', 'MACHINERY') OR nullif(c_nationkey % 5, 0) IS NULL GROUP BY 1")
def feature_categories(spark, d):
    c = table(spark, d, "customer").select("c_mktsegment", F.when(F.col("c_nationkey") % 5 == 0, "yes").alias("landmark"))
    return L.tagged(c, {"c_mktsegment": ["BUILDING", "MACHINERY"], "landmark": True}).groupBy(F.col("c_mktsegment").alias("segment")).agg(F.count("*").alias("n"))


@query("SELECT count(*) AS n, CAST(sum(c_custkey) AS BIGINT) AS ids FROM customer WHERE c_acctbal BETWEEN 100 AND 5000 AND c_nationkey BETWEEN 3 AND 12")
def bbox_filter(spark, d):
    return table(spark, d, "customer").where(L.in_bbox(F.col("c_acctbal"), F.col("c_nationkey"), 100, 3, 5000, 12)).agg(F.count("*").alias("n"), F.sum("c_custkey").alias("ids"))


# Supply: orders are a raw catalogue, customers its vehicles, nations their areas.
@query("""WITH r AS (SELECT o_orderkey AS source_row, CASE WHEN o_orderkey % 41 = 0 THEN '' ELSE 'v' || o_custkey END AS v, o_orderkey % 24 AS a, o_orderkey % 24 + o_custkey % 9 - 1 AS b, CASE WHEN o_custkey % 7 = 0 THEN NULL ELSE o_custkey % 11 - 1 END AS c FROM orders),
    n AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY source_row) > 1 AS again FROM r)
    SELECT code, count(*) AS n, CAST(sum(source_row) AS BIGINT) AS rows FROM (SELECT source_row, unnest([CASE WHEN v = '' THEN 'MISSING_ID' END, CASE WHEN again THEN 'REPEATED_ID' END, CASE WHEN NOT a < b THEN 'INVALID_WINDOW' END, CASE WHEN c IS NOT NULL AND NOT c > 0 THEN 'INVALID_CAPACITY' END]) AS code FROM n) WHERE code IS NOT NULL GROUP BY 1""")
def supply_issues(spark, d):
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    rows = table(spark, d, "orders").select(k.alias("source_row"), F.when(k % 41 == 0, "").otherwise(F.concat(F.lit("v"), c.cast("string"))).alias("vehicle_id"), (k % 24).alias("start_s"), (k % 24 + c % 9 - 1).alias("end_s"), F.when(c % 7 != 0, c % 11 - 1).alias("capacity"))
    return V.supply_issues(rows).groupBy("code").agg(F.count("*").alias("n"), F.sum("source_row").alias("rows"))


@query("""WITH p AS (SELECT o_custkey AS v, o_orderkey % 27 AS a, count(*) AS n FROM orders GROUP BY ALL) SELECT CASE WHEN v NOT IN (SELECT c_custkey FROM customer WHERE c_custkey % 10 <> 0) THEN 'UNKNOWN_VEHICLE' WHEN a NOT IN (SELECT n_nationkey FROM nation) THEN 'UNKNOWN_AREA' WHEN n > 1 THEN 'REPEATED_PAIR' END AS code, count(*) AS n, CAST(sum(a) AS BIGINT) AS areas FROM p GROUP BY 1""")
def area_assignments(spark, d):
    given = table(spark, d, "orders").select(F.col("o_custkey").alias("vehicle_id"), (F.col("o_orderkey") % 27).alias("area_id"))
    good, bad = V.area_assignments(given, table(spark, d, "customer").where("c_custkey % 10 <> 0").select(F.col("c_custkey").alias("vehicle_id")), table(spark, d, "nation").select(F.col("n_nationkey").alias("area_id")))
    both = good.select(F.explode("area_ids").alias("area_id"), F.lit(None).cast("string").alias("code")).unionByName(bad.select("area_id", "code"))
    return both.groupBy("code").agg(F.count("*").alias("n"), F.sum("area_id").alias("areas"))


@query("""WITH v AS (SELECT s_suppkey AS vehicle_id, s_nationkey % 3 AS fleet, s_acctbal AS p, [s_nationkey % 4, s_nationkey % 5] AS a, s_suppkey % 6 AS room FROM supplier), t AS (SELECT c_custkey AS task_id, c_nationkey % 3 AS fleet, c_acctbal AS p, [c_nationkey % 4] AS a, c_custkey % 4 AS q FROM customer)
    SELECT t.fleet AS fleet_id, task_id, vehicle_id, round(abs(v.p - t.p) / 10, 6) AS pickup_s FROM t JOIN v ON t.fleet = v.fleet AND abs(v.p - t.p) / 10 <= 6 AND q <= room AND list_has_any(t.a, v.a)""")
def eligible_pairs(spark, d):
    v = table(spark, d, "supplier").select((F.col("s_nationkey") % 3).alias("fleet_id"), F.col("s_suppkey").alias("vehicle_id"), F.col("s_acctbal").alias("place"), F.array(F.col("s_nationkey") % 4, F.col("s_nationkey") % 5).alias("area_ids"), (F.col("s_suppkey") % 6).alias("room"))
    t = table(spark, d, "customer").select((F.col("c_nationkey") % 3).alias("fleet_id"), F.col("c_custkey").alias("task_id"), F.col("c_acctbal").alias("place"), F.array(F.col("c_nationkey") % 4).alias("areas"), (F.col("c_custkey") % 4).alias("quantity"))
    return V.eligible_pairs(v, t, speed=10.0, reach=6.0).withColumn("pickup_s", F.round("pickup_s", 6))


@query("""WITH p AS (SELECT l_suppkey AS v, l_linenumber AS s, l_orderkey AS t FROM lineitem), k AS (SELECT *, row_number() OVER (PARTITION BY v ORDER BY s, t) AS k, count(*) OVER (PARTITION BY t) > 1 AS twice FROM p)
    SELECT code, count(*) AS n FROM (SELECT unnest([CASE WHEN t NOT IN (SELECT o_orderkey FROM orders WHERE o_orderkey % 9 <> 0) THEN 'UNKNOWN_TASK' END, CASE WHEN twice THEN 'REPEATED_TASK' END, CASE WHEN k <> s THEN 'GAP_IN_SEQUENCE' END]) AS code FROM k) WHERE code IS NOT NULL GROUP BY 1""")
def assignment_plan_faults(spark, d):
    plans = table(spark, d, "lineitem").select(F.col("l_suppkey").alias("vehicle_id"), F.col("l_linenumber").alias("sequence"), F.col("l_orderkey").alias("task_id"))
    return V.plan_faults(plans, table(spark, d, "orders").where("o_orderkey % 9 <> 0").select(F.col("o_orderkey").alias("task_id"))).groupBy("code").agg(F.count("*").alias("n"))


def _cut_sql(levels: int) -> str:
    out = "a0 AS (SELECT c_custkey AS id, floor(c_acctbal) AS x, c_nationkey * 400.0 AS y, 1 + c_custkey % 4 AS m, CAST(0 AS BIGINT) AS area FROM customer)"
    for k in range(levels):
        out += f""", w{k} AS (SELECT *, CASE WHEN max(x) OVER p - min(x) OVER p >= max(y) OVER p - min(y) OVER p THEN x ELSE y END AS place, sum(m) OVER p AS whole FROM a{k} WINDOW p AS (PARTITION BY area)),
        a{k + 1} AS (SELECT id, x, y, m, 2 * area + CASE WHEN row_number() OVER o = 1 OR 2 * (sum(m) OVER o - m) < whole THEN 0 ELSE 1 END AS area FROM w{k} WINDOW o AS (PARTITION BY area ORDER BY place, id ROWS UNBOUNDED PRECEDING))"""
    return out


@query(f"WITH {_cut_sql(4)} SELECT id AS location_id, area, m AS mass FROM a4")
def service_areas_bisected(spark, d):
    places = table(spark, d, "customer").select(F.col("c_custkey").alias("location_id"), F.floor("c_acctbal").alias("x"), (F.col("c_nationkey") * 400.0).alias("y"), (1 + F.col("c_custkey") % 4).alias("mass"))
    return V.bisected_areas(places, 4)


# Checks and axes.
@query("""SELECT 'r' || (o_orderkey % 40) AS replication_id, CASE WHEN min(CASE WHEN o_orderkey % 997 <> 0 THEN 1 ELSE 0 END) = 1 THEN 'complete' ELSE 'incomplete' END AS state FROM orders GROUP BY 1 UNION ALL SELECT 'r' || range, 'missing' FROM range(40, 43)""")
def replication_completeness(spark, d):
    status = table(spark, d, "orders").select(F.concat(F.lit("r"), (F.col("o_orderkey") % 40).cast("string")).alias("replication_id"), (F.col("o_orderkey") % 997 != 0).alias("complete"))
    return A.completeness(status, spark.range(43).select(F.concat(F.lit("r"), F.col("id").cast("string")).alias("replication_id")))


@query("SELECT user_id, row_number() OVER (ORDER BY user_id) - 1 AS canonical_index FROM (SELECT DISTINCT user_id FROM events WHERE user_id IS NOT NULL)")
def vehicle_axis(spark, d):
    return A.axis(table(spark, d, "events"), "user_id")


@query(f"""WITH {SPLIT} SELECT replication_id, CAST(sum(CASE WHEN cell_id < 90 THEN duration ELSE 0 END) AS BIGINT) AS inside, CAST(sum(CASE WHEN cell_id < 90 THEN 0 ELSE duration END) AS BIGINT) AS outside, CAST(sum(duration) AS BIGINT) AS total,
    count(*) AS rows, count(DISTINCT vehicle_id) AS vehicles, count(DISTINCT cell_id) FILTER (WHERE cell_id < 90) AS cells FROM split GROUP BY 1""")
def replication_diagnostics(spark, d):
    rows = I.split_bins(movements(spark, d), "start", "end", HOUR).withColumn("cell_id", F.when(F.col("cell_id") < 90, F.col("cell_id")))
    return A.replication_diagnostics(rows)


@query(f"""WITH {EXPOSURE}, u AS (SELECT replication_id, fleet_id, cell_id, bin // 3 AS u, sum(duration) AS d, count(*) AS n FROM exposure GROUP BY ALL)
    SELECT replication_id, fleet_id, CAST(sum(d) AS BIGINT) AS total, CAST(sum(n) AS BIGINT) AS nonzero, round(sum(1 - exp(-ln(100.0) * d / 1e6 / 600.0)), 6) AS utility FROM u GROUP BY ALL""")
def matrix_totals(spark, d):
    index = A.interval_index(F.col("bin").cast("double"), 0.0, 3.0)
    return A.matrix_totals(sparse(spark, d), ["replication_id", "fleet_id"], "cell_id", index, "exponential", 600.0).withColumn("utility", F.round("utility", 6))


@query(f"WITH {EXPOSURE} SELECT replication_id, count(*) AS rows, CAST(sum(duration) AS BIGINT) AS duration FROM exposure WHERE replication_id IN ('2024-01-03', '2024-01-09') AND (fleet_id, vehicle_id) IN (SELECT user_id % 3, user_id FROM events WHERE user_id % 4 = 1) GROUP BY 1")
def sparse_reader(spark, d):
    chosen = spark.sql("SELECT explode(array('2024-01-03', '2024-01-09')) AS replication_id")
    rows = A.read_sparse(sparse(spark, d), chosen, _vehicles(spark, d).where("vehicle_id % 4 = 1"), 24)
    return rows.groupBy("replication_id").agg(F.count("*").alias("rows"), F.sum("duration").alias("duration"))


@query("""WITH RECURSIVE e AS (SELECT n_nationkey AS a, (n_nationkey * 3 + 1) % 25 AS b FROM nation UNION SELECT n_nationkey, (n_nationkey + 5) % 25 FROM nation WHERE n_nationkey % 2 = 0), c AS (SELECT n_nationkey AS root, n_nationkey AS node FROM nation UNION SELECT root, b FROM c JOIN e ON node = a) SELECT root, node FROM c""")
def lineage_closure(spark, d):
    n = F.col("n_nationkey")
    nation = table(spark, d, "nation")
    edges = nation.select(n.alias("a"), ((n * 3 + 1) % 25).alias("b")).unionByName(nation.where("n_nationkey % 2 = 0").select(n.alias("a"), ((n + 5) % 25).alias("b")))
    return A.closure(edges, nation.select(n.alias("node")))


@query("SELECT l_orderkey AS task_id, CAST(min(s) AS BIGINT) AS first_service, CAST(greatest(min(s) - arg_min(c, s * 100 + l_linenumber), 0) AS BIGINT) AS lateness FROM (SELECT l_orderkey, l_linenumber, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) AS s, date_diff('day', DATE '1970-01-01', CAST(l_shipdate AS DATE)) - 20 + l_linenumber * 5 AS c FROM lineitem) GROUP BY 1")
def first_service_lateness(spark, d):
    s = F.unix_date(F.col("l_shipdate").cast("date")).cast("bigint")
    rows = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("task_id"), F.col("l_linenumber").alias("step_index"), s.alias("s"), (s - 20 + F.col("l_linenumber") * 5).cast("bigint").alias("c"))
    return A.first_service(rows, ["task_id"], "s", "c")


@query(f"""WITH {MOVEMENTS} SELECT event_id, row_number() OVER w - 1 AS n, "start" - lag("end") OVER w AS pause FROM movements WHERE replication_id = '2024-01-05' AND vehicle_id = (SELECT min(vehicle_id) FROM movements WHERE replication_id = '2024-01-05') WINDOW w AS (ORDER BY "start", "end", event_id)""")
def vehicle_trajectory(spark, d):
    m = movements(spark, d)
    first = m.where("replication_id = '2024-01-05'").agg(F.min("vehicle_id")).first()[0]
    return A.trajectory(m, "2024-01-05", first, ["start", "end", "event_id"]).select("event_id", F.col("n").cast("bigint").alias("n"), "pause")


@query(f"""WITH {EXPOSURE}, v AS (SELECT DISTINCT user_id FROM events), s AS (SELECT user_id FROM v ORDER BY md5('display|' || user_id), user_id LIMIT 25) SELECT vehicle_id, CAST(sum(duration) AS BIGINT) AS duration FROM exposure WHERE vehicle_id IN (SELECT user_id FROM s) GROUP BY 1""")
def sampled_vehicle_sensing(spark, d):
    some = A.sampled(_vehicles(spark, d), "vehicle_id", 25, "display")
    return sparse(spark, d).join(F.broadcast(some.select("vehicle_id")), "vehicle_id", "left_semi").groupBy("vehicle_id").agg(F.sum("duration").alias("duration"))


@query("SELECT ps.s_suppkey AS supplier, n.n_name AS nation, r.r_name AS region FROM supplier ps JOIN nation n ON s_nationkey = n_nationkey JOIN region r ON n_regionkey = r_regionkey")
def validated_joins(spark, d):
    s = table(spark, d, "supplier").select(F.col("s_suppkey").alias("supplier"), F.col("s_nationkey").alias("n"))
    n = table(spark, d, "nation").select(F.col("n_nationkey").alias("n"), F.col("n_name").alias("nation"), F.col("n_regionkey").alias("r"))
    return A.many_to_one(A.many_to_one(s, n, ["n"]), table(spark, d, "region").select(F.col("r_regionkey").alias("r"), F.col("r_name").alias("region")), ["r"]).select("supplier", "nation", "region")


@query("""WITH b AS (SELECT s_nationkey AS cell_id, count(*) AS v FROM supplier GROUP BY 1), x AS (SELECT cell_id, bin, v * (bin + 1) AS w FROM b, range(4) t(bin)) SELECT cell_id, bin, round(w / (SELECT sum(w) FROM x), 12) AS weight FROM x""")
def spatial_weights(spark, d):
    features = table(spark, d, "supplier").select(F.col("s_nationkey").alias("cell_id"), F.lit(1.0).alias("value"))
    bins = spark.range(4).select(F.col("id").alias("bin"), F.lit(0.0).alias("bin_start"), (F.col("id") + 1.0).alias("bin_end"))
    return A.weights_of(spark, table(spark, d, "nation").select(F.col("n_nationkey").alias("cell_id")), features, bins).select("cell_id", "bin", F.round("weight", 12).alias("weight"))


# Matrices of all kinds, by bins or summed over them.
@query(f"WITH {EXPOSURE} SELECT replication_id, vehicle_id, cell_id, bin, duration / 1e6 AS seconds FROM exposure WHERE replication_id = '2024-01-05'")
def matrix_vehicle_exposure(spark, d):
    return sparse(spark, d).where("replication_id = '2024-01-05'").select("replication_id", "vehicle_id", "cell_id", "bin", (F.col("duration") / 1e6).alias("seconds"))


@query(f"""WITH {EXPOSURE}, o AS (SELECT replication_id, fleet_id, cell_id, sum(duration) / 1e6 AS x FROM exposure GROUP BY ALL), n AS (SELECT count(*) AS r FROM replications), v AS (SELECT fleet_id, cell_id, count(*) AS n, avg(x) AS a, var_pop(x) AS p, max(r) AS r FROM o, n GROUP BY ALL)
    SELECT fleet_id, cell_id, round(a * n / r, 4) AS mean, round(sqrt((p * n + a * a * n * (r - n) / r) / (r - 1)), 4) AS std FROM v""")
def matrix_fleet_window(spark, d):
    sums = S.observed_sums(sparse(spark, d), ["replication_id"], ["fleet_id", "cell_id"], "duration").withColumn("x", F.col("duration") / 1e6)
    return S.sparse_moments(sums, ["fleet_id", "cell_id"], "x", replications(spark, d).count()).select("fleet_id", "cell_id", F.round("mean", 4).alias("mean"), F.round("std", 4).alias("std"))


def _matrices(spark, d):
    chosen = P.chosen_replications(_rounds(spark), replications(spark, d))
    return P.sample_matrices(_portfolios(spark), chosen, P.orderings(_vehicles(spark, d), _rounds(spark)), sparse(spark, d).withColumnRenamed("duration", "duration_us"))


@query(f"WITH {_samples_sql('binary')} SELECT portfolio_id, round_id, cell_id, CAST(d AS BIGINT) AS duration_us FROM z")
def matrix_portfolio_samples(spark, d):
    return _matrices(spark, d).withColumnRenamed("d", "duration_us")


@query(f"""WITH {_samples_sql('binary')}, c AS (SELECT portfolio_id, round_id, count(*) / 100.0 AS coverage FROM z GROUP BY ALL), a AS (SELECT portfolio_id, coalesce(coverage, 0) AS coverage FROM (SELECT portfolio_id, round_id FROM portfolios, rounds) LEFT JOIN c USING (portfolio_id, round_id))
    SELECT portfolio_id, round(avg(coverage), 9) AS mean, round(quantile_cont(coverage, 0.05), 9) AS p05, round(quantile_cont(coverage, 0.5), 9) AS p50, round(quantile_cont(coverage, 0.95), 9) AS p95 FROM a GROUP BY 1""")
def portfolio_coverage(spark, d):
    axis = _portfolios(spark).select("portfolio_id").crossJoin(F.broadcast(_rounds(spark)))
    c = S.coverage(_matrices(spark, d), ["portfolio_id", "round_id"], axis, 100, "d")
    return c.groupBy("portfolio_id").agg(F.avg("coverage").alias("mean"), *S.quantiles(F.col("coverage"))).select("portfolio_id", *[F.round(x, 9).alias(x) for x in ("mean", "p05", "p50", "p95")])


@query(f"""WITH {_STATISTICS}, f AS (SELECT budget, s.*, row_number() OVER (PARTITION BY budget ORDER BY std NULLS LAST, mean DESC, portfolio_id) AS place FROM statistics s JOIN (SELECT unnest([10, 20, 30, 40, 50, 60]) AS budget) ON cost <= budget)
    SELECT CAST(budget AS BIGINT) AS budget, portfolio_id, CAST(place AS BIGINT) AS place, first_value(portfolio_id) OVER (PARTITION BY budget ORDER BY mean DESC, std, portfolio_id) AS best FROM f""")
def frontier_view_order(spark, d):
    from pyspark.sql.window import Window

    rows = _statistics(spark, d).join(F.broadcast(_budgets(spark)), F.col("cost") <= F.col("budget"))
    place = F.row_number().over(Window.partitionBy("budget").orderBy(P.risk_order(F.col("std")), F.desc("mean"), "portfolio_id"))
    best = F.first("portfolio_id").over(Window.partitionBy("budget").orderBy(F.desc("mean"), P.risk_order(F.col("std")), "portfolio_id"))
    return rows.select("budget", "portfolio_id", place.cast("bigint").alias("place"), best.alias("best"))
