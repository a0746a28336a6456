"""Transit, draws, polygons, supply and checks against numbers worked out by hand."""

from __future__ import annotations

import math
import random
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from fleetlens.operators import audit, planar, realise, supply, transit


def write_feed(folder, tables, ending=".txt"):
    folder.mkdir(exist_ok=True)
    for name, lines in tables.items():
        (folder / f"{name}{ending}").write_text("\n".join(lines) + "\n")
    return str(folder)


FEED = {
    "stops": ["stop_id,stop_lat,stop_lon", "007,46.5,6.6", "A,46.6,6.7"],
    "routes": ["route_id", "r1"],
    "trips": ["trip_id,route_id,service_id", "t1,r1,s"],
    "stop_times": ["trip_id,arrival_time,departure_time,stop_id,stop_sequence", "t1,23:50:00,23:51:00,007,1", "t1,24:10:00,24:10:00,A,2"],
    "calendar": ["service_id,monday", "s,1"],
}


def test_a_feed_keeps_ids_and_hashes_its_contents(spark, tmp_path):
    tables, mark = transit.feed(spark, write_feed(tmp_path / "a", FEED))
    assert {r.stop_id for r in tables["stops"].collect()} == {"007", "A"} and set(tables) == set(FEED)
    assert transit.feed(spark, write_feed(tmp_path / "b", FEED))[1] == mark != transit.feed(spark, write_feed(tmp_path / "c", FEED | {"routes": ["route_id", "r2"]}))[1]
    with pytest.raises(ValueError, match="lacks trips"):
        transit.feed(spark, write_feed(tmp_path / "d", {k: v for k, v in FEED.items() if k != "trips"}))
    with pytest.raises(ValueError, match="two files"):
        write_feed(tmp_path / "a", {"stops": FEED["stops"]}, ".csv")
        transit.feed(spark, str(tmp_path / "a"))


def test_stop_faults_in_order_of_precedence(spark):
    rows = [("t", "08:00:00", "08:01:00", "A", "1"), ("t", "08:05:00", "08:05:00", "A", "3"), ("t", "25:00:00", "25:00:30", "A", "10")]
    rows += [("late", "08:00:00", "08:09:00", "A", "1"), ("late", "08:08:59", "08:10:00", "A", "2")]
    rows += [("back", "08:01:00", "08:00:00", "A", "1"), ("gone", "08:00:00", "08:00:00", "Z", "1"), ("word", "08:00:00", "08:00:00", "A", "one"), ("bad", "8.30", "08:40:00", "A", "1")]
    rows += [("twin", "08:00:00", "08:00:00", "A", "1"), ("twin", "08:02:00", "08:02:00", "A", "1"), ("blank", "", "08:00:00", "A", "1")]
    times = spark.createDataFrame(rows, "trip_id string, arrival_time string, departure_time string, stop_id string, stop_sequence string")
    stops = spark.createDataFrame([("A",), ("A",)], "stop_id string")
    checked = transit.stop_faults(times, stops)
    trips = spark.createDataFrame([(k, "r", "s") for k in {r[0] for r in rows} | {"none"}], "trip_id string, route_id string, service_id string")
    days = spark.createDataFrame([("2024-01-01", "s")], "day string, service_id string")
    got = {r.trip_id: (r.status, r.reason, r.stop_count, r.start_s, r.end_s) for r in transit.trip_diagnostics(transit.selected_trips(trips, days, ["r"]), checked).collect()}
    assert got.pop("t") == ("accepted", None, 3, 8 * 3600, 25 * 3600 + 30)
    assert {k: v[1] for k, v in got.items()} == {"late": "arrival before the last departure", "back": "departure before arrival", "gone": "unknown stop", "word": "sequence isn't an integer", "bad": "malformed time", "twin": "sequence isn't increasing", "blank": "missing time", "none": "no stop times"}
    assert all(v[0] == "rejected" and v[2:] == (0, None, None) for v in got.values())
    copied = transit.stop_faults(times, stops, copy_missing=True).where("trip_id = 'blank'").first()
    assert copied.fault is None and copied.arrival_s == copied.departure_s == 8 * 3600


def test_service_origins_on_days_when_clocks_change(spark):
    days = spark.createDataFrame([("2024-03-30",), ("2024-03-31",), ("2024-10-27",)], "day string").withColumn("day", F.col("day").cast("date"))
    got = {str(r.day): str(r.o) for r in days.select("day", transit.service_origin(F.col("day"), "Europe/Zurich").cast("string").alias("o")).collect()}
    assert got == {"2024-03-30": "2024-03-29 23:00:00", "2024-03-31": "2024-03-30 22:00:00", "2024-10-27": "2024-10-26 23:00:00"}


def test_trips_of_the_day_before_are_carried_in(spark):
    trips = spark.createDataFrame([("d1", "late", 80_000, 90_000), ("d1", "early", 100, 200), ("d2", "own", 0, 50)], "day string, trip_id string, start_s int, end_s int")
    origins = spark.createDataFrame([("d1", 0), ("d2", 86_400_000_000)], "day string, origin_us long")
    got = {r.trip_id: (r.start_us, r.carried) for r in transit.carried_trips(trips, origins, F.lit(86_400_000_000), F.lit(2 * 86_400_000_000)).collect()}
    assert got == {"late": (80_000_000_000, True), "own": (86_400_000_000, False)}


def test_given_duties_have_deadheads_and_cover_the_trips(spark):
    trips = spark.createDataFrame([("a", 0, 10, "x", "y"), ("b", 20, 30, "z", "x"), ("c", 40, 50, "x", "x")], "trip_id string, start_s int, end_s int, first_stop string, last_stop string")
    duties = spark.createDataFrame([("a", "v"), ("b", "v"), ("c", "v")], "trip_id string, vehicle_id string")
    assert [tuple(r) for r in transit.chained(trips, duties).collect()] == [("v", "b", "y", "z", 10)]
    with pytest.raises(Exception, match="cover exactly"):
        transit.chained(trips, duties.where("trip_id <> 'c'")).collect()


def test_poisson_numbers_follow_their_law(spark):
    rows = spark.range(4000).select(F.col("id").alias("k"), F.lit(2.5).alias("m")).unionByName(spark.range(4000, 4400).select(F.col("id").alias("k"), F.lit(100.0).alias("m")))
    n = {r.k: r.n for r in realise.poisson_counts(rows, ["k"], "m", "s").collect()}
    for ids, mean in ((range(4000), 2.5), (range(4000, 4400), 100.0)):
        x = [n[k] for k in ids]
        a = sum(x) / len(x)
        v = sum((y - a) ** 2 for y in x) / len(x)
        assert abs(a - mean) < 4 * math.sqrt(mean / len(x)) and abs(v / mean - 1) < 0.3
    zero = sum(n[k] == 0 for k in range(4000)) / 4000
    assert abs(zero - math.exp(-2.5)) < 0.02
    assert n == {r.k: r.n for r in realise.poisson_counts(rows.repartition(7), ["k"], "m", "s").collect()}


def test_choices_by_weight_lay_items_side_by_side(spark):
    weights = spark.createDataFrame([("a", 1.0), ("b", 0.0), ("c", 3.0), ("d", 1e-9)], "item string, weight double")
    rows = spark.createDataFrame([(0.0,), (0.2499,), (0.2501,), (0.9999,), (1 - 2**-52,)], "u double")
    assert [r.item for r in realise.chosen(rows, "u", weights, "item").orderBy("u").collect()][:4] == ["a", "a", "c", "c"]
    rng = random.Random(1)
    many = spark.createDataFrame([(rng.random(),) for _ in range(500)], "u double")
    w = [(i, rng.random()) for i in range(300)]
    got = {r.u: r.item for r in realise.chosen(many, "u", spark.createDataFrame(w, "item int, weight double"), "item").collect()}
    total, cuts, at = sum(x for _, x in w), [], 0.0
    for i, x in w:
        cuts.append((i, at / total, (at + x) / total))
        at += x
    assert len(got) == 500 and all(next(i for i, a, b in cuts if a <= u < b) == item for u, item in got.items())


def test_fixed_totals_and_od_draws(spark):
    totals = spark.createDataFrame([("f", 1000), ("g", 0)], "fleet string, total long")
    weights = spark.createDataFrame([(1, 1.0), (2, 3.0)], "hour int, weight double")
    got = {(r.fleet, r.hour): r.n for r in realise.fixed_total(totals, ["fleet"], weights, "hour", "x").collect()}
    assert sum(got.values()) == 1000 and set(got) == {("f", 1), ("f", 2)} and abs(got["f", 2] - 750) < 60
    tasks = spark.createDataFrame([(i,) for i in range(200)], "task int")
    one = spark.createDataFrame([("p", 1.0), ("q", 1.0)], "location_id string, weight double")
    good, none = realise.od_pairs(tasks, ["task"], one, one, spark.createDataFrame([("p", "q")], "origin string, destination string"))
    assert {(r.origin, r.destination) for r in good.collect()} == {("p", "q")} and good.count() == 200 and none.count() == 0
    heavy = spark.createDataFrame([("p", 1e9), ("q", 1.0), ("r", 3.0)], "location_id string, weight double")
    for pairs in (None, spark.createDataFrame([("q", "r"), ("r", "q"), ("q", "q")], "origin string, destination string")):
        good, none = realise.od_pairs(tasks, ["task"], heavy, heavy, pairs)
        drawn = [(r.origin, r.destination) for r in good.collect()]
        assert len(drawn) == 200 and none.count() == 0 and all(a != b for a, b in drawn)
        assert pairs is None or (60 < drawn.count(("q", "r")) < 140 and set(drawn) == {("q", "r"), ("r", "q")})
        assert pairs is not None or 0.6 < sum("r" in d for d in drawn) / 200 < 0.9
    assert realise.od_pairs(tasks, ["task"], one.where("location_id = 'p'"), one.where("location_id = 'p'"))[1].count() == 200


def test_releases_lie_in_their_interval_in_order(spark):
    rows = spark.createDataFrame([("r", 1, 0, 100.0, 200.0, 0.3), ("r", 1, 1, 200.0, 300.0, 0.0)], "replication_id string, fleet_id int, interval_id int, start_s double, end_s double, rate double")
    got = realise.arrivals(rows).orderBy("rank").collect()
    assert 10 < len(got) < 55 and [r["rank"] for r in got] == list(range(len(got)))
    assert [r.release_s for r in got] == sorted(r.release_s for r in got) and all(100 <= r.release_s < 200 for r in got)


def test_points_in_concave_polygons_and_on_borders(spark):
    ring = [(0, 0), (10, 0), (10, 10), (5, 5), (0, 10)]
    other = [(10, 0), (20, 0), (20, 10), (10, 10), (10, 0)]
    polygons = spark.createDataFrame([("b", [{"x": float(x), "y": float(y)} for x, y in ring]), ("a", [{"x": float(x), "y": float(y)} for x, y in other])], "polygon_id string, ring array<struct<x:double,y:double>>")
    points = [("in", 1.0, 1.0), ("notch", 5.0, 8.0), ("tip", 5.0, 5.0), ("shared", 10.0, 5.0), ("corner", 0.0, 0.0), ("right", 15.0, 5.0), ("out", 25.0, 5.0), ("vertex_level", -1.0, 5.0), ("top", 0.0, 10.0)]
    edges = planar.ring_edges(polygons)
    for stripe in (3.0, 100.0):
        got = {r.point_id: r.polygon_id for r in planar.point_owner(spark.createDataFrame(points, "point_id string, x double, y double"), edges, stripe).collect()}
        assert got == {"in": "b", "notch": None, "tip": "b", "shared": "a", "corner": "b", "right": "a", "out": None, "vertex_level": None, "top": "b"}
    assert {r.polygon_id: r.area for r in planar.polygon_areas(edges).collect()} == {"a": 100.0, "b": 75.0}


def test_areas_by_cell_of_triangles_and_holes(spark):
    shapes = {"triangle": [[(0, 0), (20, 0), (0, 20)]], "holed": [[(0, 0), (30, 0), (30, 30), (0, 30)], [(10, 10), (10, 20), (20, 20), (20, 10)]], "turned": [[(-5, -5), (-5, 5), (5, 5), (5, -5)]]}
    rows = [(k, [{"x": float(x), "y": float(y)} for x, y in ring]) for k, rings in shapes.items() for ring in rings]
    edges = planar.ring_edges(spark.createDataFrame(rows, "polygon_id string, ring array<struct<x:double,y:double>>"))
    got = {(r.polygon_id, r.i, r.j): round(r.area, 9) for r in planar.cell_areas(edges, 10.0).collect()}
    assert {k[1:]: v for k, v in got.items() if k[0] == "triangle"} == {(0, 0): 100.0, (1, 0): 50.0, (0, 1): 50.0}
    assert {k[1:]: v for k, v in got.items() if k[0] == "holed"} == {(i, j): 100.0 for i in range(3) for j in range(3) if (i, j) != (1, 1)}
    assert {k[1:]: v for k, v in got.items() if k[0] == "turned"} == {(i, j): 25.0 for i in (-1, 0) for j in (-1, 0)}
    with pytest.raises(ValueError):
        planar.in_bbox(F.lit(1), F.lit(1), 5, 0, 5, 1)


def test_bisected_areas_halve_the_mass(spark):
    places = spark.createDataFrame([(i, float(i), 0.0, 1) for i in range(8)] + [(100, 3.5, 0.5, 8)], "location_id int, x double, y double, mass int")
    got = supply.bisected_areas(places, 1).groupBy("area").agg(F.sum("mass").alias("m")).collect()
    assert {r.area: r.m for r in got} == {0: 12, 1: 4}
    assert supply.bisected_areas(places, 3).groupBy("area").agg(F.sum("mass")).count() <= 8
    assert supply.bisected_areas(places.limit(1), 3).collect()[0].area == 0


def test_catalogue_hashes_ignore_order(spark):
    rows = spark.createDataFrame([(1, "a"), (2, None)], "k int, v string")
    assert supply.catalogue_hash(rows, ["k", "v"]).first() == supply.catalogue_hash(rows.orderBy(F.desc("k")), ["k", "v"]).first()
    assert supply.catalogue_hash(rows, ["k", "v"]).first() != supply.catalogue_hash(rows.where("k = 1"), ["k", "v"]).first()
    twice = rows.unionByName(rows)
    assert supply.catalogue_hash(twice.unionByName(rows), ["k", "v"]).first().hash != supply.catalogue_hash(rows, ["k", "v"]).first().hash
    large = spark.range(100_002).select(F.col("id").alias("k"), F.lit("x").alias("v"))
    for n in (100_000, 100_001):
        own = large.where(F.col("k") < n)
        again, other = (supply.catalogue_hash(t, ["k", "v"]).first() for t in (own.repartition(5), own.unionByName(own.where("k = 3"))))
        assert supply.catalogue_hash(own, ["k", "v"]).first() == again and again != other and len(again.hash) == 64


def test_checks_fail_and_ranges_are_exact(spark):
    twice = spark.createDataFrame([(1,), (1,), (2,)], "k int")
    with pytest.raises(Exception, match="aren't unique"):
        audit.one_to_one(twice, twice, ["k"]).collect()
    status = spark.createDataFrame([("a", True), ("b", True), ("b", False)], "replication_id string, complete boolean")
    with pytest.raises(Exception, match="b is incomplete"):
        audit.required_complete(status, status).collect()
    assert [r.replication_id for r in audit.required_complete(status, status.where("replication_id = 'a'")).collect()] == ["a"]
    assert audit.expanded_range("0", "1", "0.1")[3] == Decimal("0.3") and audit.expanded_range("1", "10", "4", with_high=True) == [1, 5, 9, 10]
    with pytest.raises(ValueError):
        audit.expanded_range("0", "1", "0.00001", limit=10)
    bins = spark.createDataFrame([(0, 0.0, 5.0), (1, 5.0, 10.0), (2, 10.0, 16.0)], "bin int, bin_start double, bin_end double")
    assert [r.bin for r in audit.misaligned_bins(bins, 0.0, 5.0).collect()] == [2]
    names = spark.createDataFrame([("Study",), ("study  2 ",)], "name string")
    assert spark.range(1).select(audit.unused_name(F.lit("Study"), names), audit.unused_name(F.lit("New"), names)).first()[:] == ("Study 3", "New")
    bad = spark.createDataFrame([("r", 1, 1, 5, 3, -1.0)], "replication_id string, fleet_id int, vehicle_id int, cell_id int, bin int, duration double")
    with pytest.raises(Exception, match="out of bounds"):
        audit.read_sparse(bad, bad, bad, 24).collect()


def test_latest_covering(spark):
    made = spark.createDataFrame([("a", 0.0, 10.0, 1), ("b", 0.0, 9.0, 3), ("c", -1.0, 12.0, 2)], "id string, low double, high double, made int")
    assert audit.latest_covering(made, 0.0, 10.0).first().id == "c" and audit.latest_covering(made, 0.0, 99.0).count() == 0


def test_duties_take_what_trying_all_open_ones_takes(spark):
    from fleetlens.operators import normalize

    rng = random.Random(6)
    rows = [(rng.choice("ab"), i, (s := rng.randrange(120)), s + rng.randrange(1, 20), rng.randrange(4), rng.randrange(4)) for i in range(160)]
    got = {r.trip_id: r.duty for r in normalize.chain_duties(spark.createDataFrame(rows, "k string, trip_id int, start int, end int, origin int, destination int"), 2, ["k"]).collect()}
    for key in "ab":
        ends = []
        for _, trip, start, end, origin, destination in sorted((r for r in rows if r[0] == key), key=lambda r: (r[2], r[1])):
            fits = [(int(p != origin), start - e, k) for k, (e, p) in enumerate(ends) if e + 2 * (1 + (p != origin)) <= start]
            k = min(fits)[2] if fits else len(ends)
            ends[k : k + 1] = [(end, destination)]
            assert got[trip] == k


def test_bins_of_any_number_and_width(spark):
    from fleetlens.operators import exposure, intervals

    rng = random.Random(2)
    cuts = sorted(rng.sample(range(-500, 3000), 400))
    bins = [(i, a, b) for i, (a, b) in enumerate(zip(cuts, cuts[1:], strict=False)) if i % 7]
    rows = [(i, (s := rng.randrange(-800, 3200)), s + rng.choice([0, 1, 5, 300])) for i in range(200)]
    got = intervals.join_bins(spark.createDataFrame(rows, "k int, s int, e int"), spark.createDataFrame(bins, "bin int, bin_start int, bin_end int"), "s", "e").collect()
    assert sorted((r.k, r.bin, r.duration) for r in got) == sorted((k, i, min(e, b) - max(s, a)) for k, s, e in rows for i, a, b in bins if e > a and s < b and e > s)
    m = spark.createDataFrame([("r", 1, 1, "x", "e9", 0.0, 5.0, 0.0, 1.0)], "replication_id string, fleet_id int, vehicle_id int, movement_kind string, edge_id string, start_s double, end_s double, edge_start_fraction double, edge_end_fraction double")
    pieces = spark.createDataFrame([("e1", 1, 0.0, 1.0)], "edge_id string, cell_id int, start_fraction double, end_fraction double")
    with pytest.raises(Exception, match="no geometry of edge e9"):
        exposure.allocate_movements(m, pieces, spark.createDataFrame([(0, 0.0, 9.0)], "bin int, bin_start double, bin_end double"), 0.0, 9.0).collect()


def test_tables_are_found_and_verified_by_partition(spark, tmp_path):
    from fleetlens.sources import artifacts
    from fleetlens.sources.paging import LimitExceeded

    root = str(tmp_path / "store")
    df = spark.range(30).withColumn("p", (F.col("id") % 3).cast("string"))
    name = artifacts.publish(df, root, "numbers", {"n": 30}, keys=["id"], partition_by=["p"])
    assert artifacts.located(spark, root, name) == "numbers"
    with pytest.raises(KeyError):
        artifacts.located(spark, root, "numbers_0")
    assert sorted(r.id for r in artifacts.open_verified(spark, root, "numbers", name, only={"p": "1"}).collect()) == list(range(1, 30, 3))
    assert artifacts.open_verified(spark, root, "numbers", name, only={"p": "9"}).count() == 0
    assert artifacts.open_verified(spark, root, "numbers", name, schema=artifacts.schema_hash(df)).count() == 30
    with pytest.raises(ValueError, match="schema"):
        artifacts.open_verified(spark, root, "numbers", name, schema=artifacts.schema_hash(df.select("id")))
    spoilt = next((tmp_path / "store" / "numbers" / name / "data" / "p=2").glob("*.parquet"))
    spoilt.unlink()
    assert artifacts.open_verified(spark, root, "numbers", name, only={"p": "1"}).count() == 10
    with pytest.raises(ValueError, match="files differ"):
        artifacts.open_verified(spark, root, "numbers", name)
    with pytest.raises(ValueError, match="null or repeated"):
        artifacts.publish(df.withColumn("id", F.lit(None).cast("long")), root, "numbers", {"n": 0}, keys=["id"])
    assert not list((tmp_path / "store" / "numbers").glob(".stage*"))
    with pytest.raises(LimitExceeded):
        artifacts.export(df, str(tmp_path / "out"), most_rows=29)
    artifacts.export(df, str(tmp_path / "out"), "csv")
    assert artifacts.read_text_table(spark, str(tmp_path / "out")).count() == 30
    one = spark.range(1).select(F.lit(1.5).alias("x"), F.lit(2.0).alias("y"), F.lit("n").alias("name"))
    assert [r.feature for r in artifacts.feature_rows(one, artifacts.point("x", "y"), ["name"]).collect()] == ['{"type":"Feature","geometry":{"type":"Point","coordinates":[1.5,2.0]},"properties":{"name":"n"}}']
    with pytest.raises(LimitExceeded):
        artifacts.feature_rows(one, artifacts.point("x", "y"), ["name"], most_bytes=10)


def test_queries_from_the_command_line(spark, tmp_path, capsys):
    from fleetlens import __main__ as cli

    cli.main(["list"])
    assert "exposure_sparse  (SQL)" in capsys.readouterr().out.splitlines()
    cli.main(["sql", "replication_names"])
    assert "sha256" in capsys.readouterr().out
    cli.main(["run", "replication_names", "/root/testdata/sf0.001/", str(tmp_path / "out")])
    assert spark.read.parquet(str(tmp_path / "out")).count() == 200
    with pytest.raises(SystemExit):
        cli.main(["run", "nothing", "a", "b"])
