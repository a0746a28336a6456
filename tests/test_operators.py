"""Operators against numbers worked out by hand."""

from __future__ import annotations

import math
import random
import time

import pytest
from pyspark.sql import functions as F

from fleetlens.functions import scalar as K
from fleetlens.operators import exposure, intervals, kernel, normalize, portfolio, routing, spatial, stats
from fleetlens.sources import artifacts, paging


def value(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_utilities(spark):
    assert value(spark, K.utility(F.lit(60.0), "exponential", 300.0)) == pytest.approx(0.6018928294465028)
    assert value(spark, K.utility(F.lit(300.0), "exponential", 300.0)) == pytest.approx(0.99)
    assert value(spark, K.utility(F.lit(900.0), "linear_capped", 300.0)) == 1.0
    assert value(spark, K.utility(F.lit(900.0), "linear", 300.0)) == 3.0
    with pytest.raises(ValueError):
        K.utility(F.lit(1.0), "cubic", 1.0)


def test_scalars(spark):
    assert value(spark, K.quantised(F.lit(0.43233235838169365))) == 432332358382
    assert [value(spark, K.quantised(F.lit(x), 0)) for x in (0.5, 1.5, 2.5)] == [0, 2, 2]
    assert value(spark, K.osm_speed(F.lit("30 mph"))) == pytest.approx(13.4112)
    assert value(spark, K.osm_speed(F.lit("250"))) is None and value(spark, K.osm_speed(F.lit("walk"))) is None
    assert value(spark, K.service_seconds(F.lit("25:10:05"))) == 25 * 3600 + 605
    assert value(spark, K.service_seconds(F.lit("25:70:05"))) is None
    assert value(spark, K.parsed_float(F.lit(" 1e3 "))) == 1000.0 and value(spark, K.parsed_float(F.lit("nan"))) is None
    assert value(spark, K.parsed_float(F.lit("-1"), nonnegative=True)) is None
    assert value(spark, K.one_way(F.lit(" YES "))) is True and value(spark, K.one_way(F.lit("maybe"))) is None
    assert K.stable_id("a", {"x": 1, "b": [2]}) == K.stable_id("a", {"b": [2], "x": 1})


def test_local_times_that_clocks_skip_or_repeat(spark):
    at = lambda t: value(spark, K.local_instant(F.lit(t).cast("timestamp"), "Europe/Zurich"))
    assert at("2026-03-29 02:30:00") is None and at("2026-10-25 02:30:00") is None
    assert at("2026-06-01 12:00:00").hour == 10


def test_expected_overlap(spark):
    args = [F.lit(float(x)) for x in (0, 1, 0, 0, 2)]
    assert value(spark, K.expected_overlap(*args)) == 1.0
    total = sum(value(spark, K.expected_overlap(F.lit(float(h)), F.lit(h + 1.0), F.lit(3.0), F.lit(7.0), F.lit(5.0))) for h in range(0, 14))
    assert total == pytest.approx(5.0)


def test_allocation_by_hand(spark):
    m = spark.createDataFrame([("r1", "a", "v1", "service_pickup", "inside", 0.0, 10.0, 0.0, 1.0), ("r1", "a", "v1", "cruise", "partial", 10.0, 20.0, 0.0, 1.0)], "replication_id string, fleet_id string, vehicle_id string, movement_kind string, edge_id string, start_s double, end_s double, edge_start_fraction double, edge_end_fraction double")
    pieces = spark.createDataFrame([("inside", "a", 0.0, 1.0), ("partial", "b", 0.0, 0.4), ("partial", None, 0.4, 1.0)], "edge_id string, cell_id string, start_fraction double, end_fraction double")
    bins = spark.createDataFrame([(0, 0.0, 12.0), (1, 12.0, 20.0)], "bin long, bin_start double, bin_end double")
    rows = exposure.allocate_movements(m, pieces, bins, 0.0, 20.0)
    got = {(r.cell_id, r.bin): r.duration for r in rows.groupBy("cell_id", "bin").agg(F.sum("duration").alias("duration")).collect()}
    assert got == {("a", 0): 10.0, ("b", 0): 2.0, ("b", 1): 2.0, (None, 1): 6.0}
    active = m.select("vehicle_id", (F.col("end_s") - F.col("start_s")).alias("active"))
    assert exposure.conservation(rows, active, ["vehicle_id"]).first().conserved
    assert exposure.allocate_movements(m, pieces, bins, 0.0, 20.0, {"a": ["cruise"]}).agg(F.sum("duration")).first()[0] == 10.0


def test_stationary_time(spark):
    a = spark.createDataFrame([("f", "v", "service", 0.0, 10.0, "x"), ("f", "v", "idle", 10.0, 50.0, "x"), ("f", "v", "wait", 50.0, 60.0, "d")], "fleet_id string, vehicle_id string, activity_kind string, start_s double, end_s double, location_id string")
    places = spark.createDataFrame([("x", "n1", "c1"), ("d", "n0", "c0")], "location_id string, node_id string, cell_id string")
    depots = spark.createDataFrame([("f", "v", "n0")], "fleet_id string, vehicle_id string, depot_node_id string")
    bins = spark.createDataFrame([(0, 0.0, 100.0)], "bin long, bin_start double, bin_end double")
    got = {r.activity_kind: (r.excluded, r.duration) for r in exposure.allocate_stationary(a, places, depots, bins, 5.0, 100.0, 30.0).collect()}
    assert got == {"service": (None, 5.0), "idle": ("offduty", 40.0), "wait": ("depot", 10.0)}


def test_sparse_moments_are_those_of_the_dense_values(spark):
    rows = spark.createDataFrame([("a", 2.0), ("a", 4.0), ("b", 3.0)], "k string, x double")
    got = {r.k: (r.mean, r.variance) for r in stats.sparse_moments(rows, ["k"], "x", 4).collect()}
    assert got["a"] == (1.5, pytest.approx(11 / 3)) and got["b"] == (0.75, pytest.approx(2.25))
    assert stats.sparse_moments(rows, ["k"], "x", 1).where("variance is not null").count() == 0


def test_coverage_counts_absent_observations(spark):
    sums = spark.createDataFrame([("r1", 1, 5.0), ("r1", 2, 0.0)], "r string, cell_id long, x double")
    axis = spark.createDataFrame([("r1",), ("r2",)], "r string")
    assert {x.r: x.coverage for x in stats.coverage(sums, "r", axis, 4, "x").collect()} == {"r1": 0.25, "r2": 0.0}


def test_frontiers(spark):
    rows = spark.createDataFrame([("A", 1, 0.6, 0.1, 0.3), ("B", 1, 0.6, 0.2, 0.4), ("C", 1, 0.65, 0.05, 0.2), ("D", 1, 0.6, 0.3, 0.4)], "portfolio_id string, cost long, mean double, std double, p05 double")
    budget = spark.createDataFrame([(1,)], "budget long")
    p05 = portfolio.frontier(rows, budget, "mean", "p05", more_risk_is_better=True).where("nondominated").collect()
    assert {r.portfolio_id for r in p05} == {"B", "C", "D"}
    assert len({r.tie_group for r in p05 if r.portfolio_id in "BD"}) == 1
    assert [r.portfolio_id for r in portfolio.frontier(rows, budget, "mean", "std").where("nondominated").collect()] == ["C"]


def test_frontiers_with_unknown_risk_ties_and_one_round(spark):
    kind = "portfolio_id string, cost long, mean double, std double, p05 double"
    budget = spark.createDataFrame([(1,)], "budget long")
    stand = lambda rows, **k: {r.portfolio_id for r in portfolio.frontier(spark.createDataFrame(rows, kind), budget, "mean", k.pop("risk", "std"), **k).collect() if r.nondominated}
    rows = [("a", 1, 1.0, None, None), ("b", 1, 0.5, 0.1, 0.2), ("c", 1, 0.4, 0.2, 0.3)]
    assert stand(rows) == {"a", "b"} and stand(rows, risk="p05", more_risk_is_better=True) == {"a", "b", "c"}
    assert stand([("a", 1, 0.5, None, None), ("b", 1, 0.5, 0.1, None), ("n", 1, 0.9, None, None), ("m", 1, 0.9, None, None)]) == {"b", "n", "m"}
    ties = [("a", 1, 1.0, 1.0, 0.0), ("b", 1, 1.0, 1.0, 0.0), ("c", 1, 0.5, 2.0, 0.0), ("d", 1, 2.0, 2.0, 0.0)]
    assert stand(ties) == {"a", "b", "d"}
    groups = {r.portfolio_id: r.tie_group for r in portfolio.frontier(spark.createDataFrame(ties, kind), budget, "mean", "std").collect()}
    assert groups == {"a": 1, "b": 1, "c": None, "d": 2}
    near = [("a", 1, 1.0, 0.1, 0.0), ("b", 1, 1.0 + 4e-13, 0.1, 0.0), ("c", 1, 1.0 + 4e-12, 0.1 + 4e-13, 0.0)]
    assert stand(near) == {"c"} and stand(near[:2]) == {"a", "b"}
    one = portfolio.frontier(spark.createDataFrame(ties, kind), budget, "mean", "std", rounds=1).collect()
    assert len(one) == 4 and all(r.nondominated is None and r.tie_group is None for r in one)


def test_level_sums_are_those_of_the_selected_vehicles(spark):
    rng = random.Random(5)
    exposure = [(r, f, f"v{f}{v}", c, rng.randrange(1, 99)) for r in "ab" for f in (0, 1) for v in range(6) for c in range(4) if rng.random() < 0.6]
    ordered = [(k, f, i, f"v{f}{v}") for k in range(3) for f in (0, 1) for i, v in enumerate(rng.sample(range(6), 6))]
    chosen = {0: "a", 1: "b", 2: "a"}
    portfolios = portfolio.count_portfolios(spark, {0: [0, 1, 4], 1: [0, 2, 9]}, {0: 1, 1: 1}, 99)
    got = portfolio.sample_matrices(portfolios, spark.createDataFrame(list(chosen.items()), "round_id long, replication_id string"), spark.createDataFrame(ordered, "round_id long, fleet_id int, rank long, vehicle_id string"), spark.createDataFrame(exposure, "replication_id string, fleet_id int, vehicle_id string, cell_id long, duration_us long"))
    want = {}
    for n0 in (0, 1, 4):
        for n1 in (0, 2, 9):
            for k, f, rank, v in ordered:
                for r, f2, v2, c, x in exposure:
                    if r == chosen[k] and (f2, v2) == (f, v) and rank < (n0, n1)[f]:
                        want[f"{n0}-{n1}", k, c] = want.get((f"{n0}-{n1}", k, c), 0) + x
    assert {(r.portfolio_id, r.round_id, r.cell_id): r.d for r in got.collect()} == want


def test_frontiers_against_pairwise_dominance(spark):
    rng = random.Random(710)
    data = [(f"p{i}", rng.randrange(10), float(rng.randrange(6)), float(rng.randrange(6))) for i in range(80)]
    got = portfolio.frontier(spark.createDataFrame(data, "portfolio_id string, cost long, mean double, std double"), spark.createDataFrame([(0,), (3,), (9,)], "budget long"), "mean", "std").collect()
    for r in got:
        beaten = any(c <= r.budget and ((m > r["mean"] and s <= r["std"]) or (m >= r["mean"] and s < r["std"])) for _, c, m, s in data)
        assert r.nondominated == (not beaten)


def test_pieces_partition_each_edge(spark):
    edges = spark.createDataFrame([("e1", 0.0, 5.0, 20.0, 5.0), ("e2", 3.0, 3.0, 3.0, 27.0), ("e3", 1.0, 1.0, 2.0, 2.0), ("e4", 25.0, 25.0, 4.0, 2.0)], "edge_id string, x1 double, y1 double, x2 double, y2 double")
    rows = sorted(spatial.segment_pieces(edges, 10.0).collect(), key=lambda r: (r.edge_id, r.piece_index))
    for e in ("e1", "e2", "e3", "e4"):
        own = [r for r in rows if r.edge_id == e]
        assert own[0].start_fraction == 0.0 and own[-1].end_fraction == 1.0
        assert all(a.end_fraction == b.start_fraction for a, b in zip(own, own[1:]))
    assert [(r.i, r.j) for r in rows if r.edge_id == "e1"] == [(0, 0), (1, 0)]
    assert len([r for r in rows if r.edge_id == "e2"]) == 3


def test_grid_rules_over_all_assignments(spark):
    f = spark.createDataFrame([(c, n, 1.0) for c in range(8) for k, n in enumerate("abc") if c >> k & 1], "cell_id long, feature string, value double")
    cells = spark.range(8).withColumnRenamed("id", "cell_id")
    for rules in range(0, 27, 5):
        kinds = [rules // 3**k % 3 for k in range(3)]
        must, some = [n for n, k in zip("abc", kinds) if k == 1], [n for n, k in zip("abc", kinds) if k == 2]
        has = lambda c, n: c >> "abc".index(n) & 1
        expected = {c for c in range(8) if all(has(c, n) for n in must) and (not some or any(has(c, n) for n in some))}
        assert {r.cell_id for r in spatial.grid_filter(f, cells, must, some).collect()} == expected


def test_islands_and_stock(spark):
    rows = spark.createDataFrame([(1, 0, 5), (1, 5, 7), (1, 6, 9), (1, 12, 13)], "k long, s long, e long")
    assert {(r.s, r.e, r.pieces) for r in intervals.islands(rows, ["k"], "s", "e").collect()} == {(0, 9, 3), (12, 13, 1)}
    stock = spark.createDataFrame([(1, 1, 4, False), (1, 2, -1, False), (1, 3, 9, True), (1, 4, 2, False)], "k long, t long, d long, r boolean")
    assert [r.stock for r in intervals.running_stock(stock, ["k"], ["t"], "d", "r").orderBy("t").collect()] == [4, 3, 0, 2]
    clipped = intervals.fractional_clip(spark.createDataFrame([(0.0, 10.0, 0.0, 1.0)], "s double, e double, f0 double, f1 double"), "s", "e", "f0", "f1", 2.5, 5.0).first()
    assert (clipped.s, clipped.e, clipped.f0, clipped.f1) == (2.5, 5.0, 0.25, 0.5)


def test_routes_take_the_first_of_equal_paths():
    net = routing.Network([("b", "s", "x", 1), ("a", "s", "y", 1), ("c", "x", "t", 1), ("d", "y", "t", 1), ("e", "t", "s", 1), ("z", "t", "q", 1)])
    assert net.paths("s", {"t"})["t"] == (2, ("a", "d"))
    assert "s" not in net.paths("q")


def test_events_of_one_time_keep_their_order(spark):
    t = spark.createDataFrame([("r", "t1", 0.0, 0.0, 10.0, 1.0), ("r", "t2", 10.0, 0.0, 5.0, 1.0), ("r", "t3", 99.0, 0.0, 50.0, 1.0)], "replication_id string, task_id string, release double, place double, duration double, quantity double")
    v = spark.createDataFrame([("r", "v1", 0.0, 10.0, 0.0, 9.0), ("r", "v2", 10.0, 200.0, 0.0, 9.0)], "replication_id string, vehicle_id string, start_s double, end_s double, place double, capacity double")
    events = [(r.time_s, r.event_type) for r in kernel.simulate(t, v, 100.0).orderBy("event_index").collect()]
    assert events == [(0.0, "entry"), (0.0, "release"), (0.0, "assignment"), (10.0, "completion"), (10.0, "exit"), (10.0, "entry"), (10.0, "release"), (10.0, "assignment"), (15.0, "completion"), (99.0, "release"), (99.0, "assignment"), (100.0, "censored_horizon")]
    outcome = {r.task_id: (r.status, r.vehicle_id) for r in kernel.simulate(t, v, 100.0, "outcomes").collect()}
    assert outcome == {"t1": ("completed", "v1"), "t2": ("completed", "v2"), "t3": ("censored_horizon", "v2")}


def test_quarantine_takes_whole_tasks(spark):
    rows = spark.createDataFrame([(0, "001", "5"), (1, "bad", "x"), (2, "001", "6"), (3, "bad", "7")], "source_row long, task_id string, release string")
    issues = normalize.demand_issues(rows, {"INVALID_TASK_ROW": K.parsed_float(F.col("release")).isNotNull()})
    good, bad = normalize.quarantine(rows, issues)
    assert {r.task_id for r in good.collect()} == {"001"} and bad.count() == 2 and issues.count() == 1


def test_tampering_is_found(spark, tmp_path):
    df = spark.range(20).withColumn("p", F.col("id") % 2)
    root = str(tmp_path)
    name = artifacts.publish(df, root, "numbers", {"n": 20}, keys=["id"], partition_by=["p"])
    assert artifacts.publish(df, root, "numbers", {"n": 20}, keys=["id"]) == name
    assert artifacts.open_verified(spark, root, "numbers", name).agg(F.sum("id")).first()[0] == 190
    victim = next((tmp_path / "numbers" / name / "data").rglob("*.parquet"))
    victim.write_bytes(victim.read_bytes()[:-1] + b"x")
    crc = victim.parent / f".{victim.name}.crc"
    crc.unlink(missing_ok=True)
    with pytest.raises(Exception):  # noqa: B017
        artifacts.open_verified(spark, root, "numbers", name)
    with pytest.raises(ValueError):
        artifacts.publish(df.union(df), root, "numbers", {"n": 40}, keys=["id"])


def test_pages_and_limits(spark):
    df = spark.range(50).withColumn("even", F.col("id") % 2 == 0)
    page = paging.table_page(df, key=["id"], filters={"even": "True"}, offset=5, size=3).collect()
    assert [(r.id, r.total) for r in page] == [(10, 25), (12, 25), (14, 25)]
    ask = {"key": ["even", "id"], "filters": {"even": "True"}, "size": 7}
    seen, mark, pages = [], None, 0
    while pages == 0 or mark:
        rows, mark = paging.next_page(df, after=mark, **ask)
        seen, pages = seen + [r.id for r in rows], pages + 1
    assert seen == list(range(0, 50, 2)) and pages == 4
    _, mark = paging.next_page(df, **ask)
    with pytest.raises(ValueError):
        paging.next_page(df, after=mark, **(ask | {"filters": {}}))
    assert paging.next_page(df.limit(0), **ask) == ([], None)
    with pytest.raises(paging.LimitExceeded):
        paging.bounded_rows(df, 10)
    with pytest.raises(KeyError):
        paging.filtered(df, {"missing": "1"})


def test_mixtures_normalise_before_they_restrict(spark):
    f = spark.createDataFrame([(1, "a", 3.0), (2, "a", 1.0), (2, "b", 5.0), (3, "b", 5.0)], "cell_id long, feature string, value double")
    got = {r.cell_id: r.weight for r in spatial.feature_mixture(f, {"a": 1.0, "b": 1.0}, spark.createDataFrame([(1,), (2,)], "cell_id long")).collect()}
    assert got == {1: pytest.approx(0.75 / 1.5), 2: pytest.approx(0.75 / 1.5)}
    assert math.isclose(sum(got.values()), 1.0)


def test_snap_takes_the_exactly_nearest_node(spark):
    """Nodes a rounding error nearer than others win whatever their ids; crowded and lonely points, and many nodes in one place."""
    rng = random.Random(6)
    nodes = [(5, 100.01 - 1e-10, 0.0), (2, 99.99, 0.0), (9, 500.0, 40.0), (7, 500.0, 40.0), (1, 640.0, 40.0)] + [(10 + k, round(rng.uniform(0, 90), 2), round(rng.uniform(0, 9), 2)) for k in range(400)]
    points = [(1, 100.0, 0.0), (2, 500.0, 41.0), (3, 570.0, 40.0), (4, 790.0, 40.0), (5, 790.1, 40.0), (6, None, 1.0)] + [(10 + k, round(rng.uniform(-50, 200), 2), round(rng.uniform(-40, 30), 2)) for k in range(300)]
    rows = lambda x, c: spark.createDataFrame(x, f"{c} long, x double, y double").repartition(3)
    got = {r.point_id: (r.distance, r.node_id) for r in spatial.snap(rows(points, "point_id"), rows(nodes, "node_id"), 150.0).collect()}
    best = {p: min((math.sqrt((x - a) ** 2 + (y - b) ** 2), n) for n, a, b in nodes) for p, x, y in points if x is not None}
    assert got == {p: b for p, b in best.items() if b[0] <= 150.0} and 5 not in got and got[2][1] == 7


def test_one_fleet_serves_every_replication(spark):
    """As with the fleet given to each replication; a replication's run doesn't go on from another's."""
    rng = random.Random(8)
    tasks = [(f"r{k % 5}", f"t{k:03d}", float(rng.randrange(-5, 80)), float(rng.randrange(40)), float(rng.randrange(20)), 1.0) for k in range(200)]
    fleet = [(f"v{k}", float(rng.randrange(40)), float(rng.randrange(50, 120)), float(rng.randrange(40)), float(rng.randrange(1, 9))) for k in range(12)]
    t = spark.createDataFrame(tasks, "replication_id string, task_id string, release double, place double, duration double, quantity double").repartition(3)
    v = spark.createDataFrame(fleet, "vehicle_id string, start_s double, end_s double, place double, capacity double")
    for what in ("events", "outcomes"):
        each, one = (sorted(map(tuple, kernel.simulate(t, x, 90.0, what).collect()), key=repr) for x in (v.crossJoin(t.select("replication_id").distinct()), v))
        assert each == one and len({r[0] for r in one}) == 5


def test_a_crowd_of_vehicles_stays_cheap():
    """A hundred thousand vehicles enter and leave in seconds: each is put in among those of its place alone."""
    fleet = {f"v{k:06d}": kernel.Vehicle(f"v{k:06d}", float(k % 300), float(400 + k % 300), float(k * 37 % 500), 9.0) for k in range(100_000)}
    tasks = {f"t{k}": {"task_id": f"t{k}", "release": float(k % 600), "place": float(k * 7 % 500), "duration": 5.0, "quantity": 1.0} for k in range(3000)}
    run = kernel.Run(1000.0, tasks, fleet)
    begin = time.process_time()
    run.go()
    assert time.process_time() - begin < 5 and sum(e[2] in ("entry", "exit") for e in run.events) == 200_000
