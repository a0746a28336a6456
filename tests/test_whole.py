"""Queries that once took a part of their input, over all of it."""

from __future__ import annotations

import datetime
import random

from fleetlens import registry
from fleetlens.operators import kernel


def all_pairs(tasks, vehicles, horizon):
    """Events and outcomes by forming every free and waiting pair after every time at which something happens."""
    due = [(t["release"], 4, k) for k, t in tasks.items() if t["release"] >= 0] + [(v["start"], 3, k) for k, v in vehicles.items()] + [(v["end"], 2, k) for k, v in vehicles.items()]
    state, used, place, inside, busy, got, out = {k: "waiting" for k, t in tasks.items() if t["release"] < 0}, dict.fromkeys(vehicles, 0.0), {k: v["place"] for k, v in vehicles.items()}, set(), {}, {}, []
    while due and min(due)[:2] <= (horizon, 1):
        now = min(due)[0]
        for e in sorted(x for x in due if x[0] == now):
            if now == horizon and e[1] > 1:
                break
            due.remove(e)
            _, phase, k = e
            if phase == 1 and state[k] != "assigned":
                out.append((now, phase, "stale_completion_ignored", got[k], k))
            elif phase == 1:
                v = got[k]
                state[k], place[v] = "completed", tasks[k]["place"]
                del busy[v]
                out.append((now, phase, "completion", v, k))
            elif phase == 4:
                state[k] = "waiting"
                out.append((now, phase, "release", None, k))
            else:
                (inside.add if phase == 3 else inside.discard)(k)
                if phase == 2 and k in busy:
                    state[busy[k]] = "interrupted_shift"
                    out.append((now, phase, "interrupted_shift", k, busy.pop(k)))
                out.append((now, phase, "entry" if phase == 3 else "exit", k, None))
        if now == horizon:
            break
        pairs = [(abs(place[v] - tasks[t]["place"]), tasks[t]["release"], t, v) for v in inside - set(busy) for t, s in state.items() if s == "waiting" and used[v] + tasks[t]["quantity"] <= vehicles[v]["capacity"]]
        for travel, _, t, v in sorted(pairs):
            if v not in busy and state[t] == "waiting":
                busy[v], got[t], state[t] = t, v, "assigned"
                used[v] += tasks[t]["quantity"]
                out.append((now, 5, "assignment", v, t))
                due.append((now + travel + tasks[t]["duration"], 1, t))
    return out, {t: (state.get(t, "unreleased"), got.get(t)) for t in tasks}


def held(events):
    return [e for e in events if e[1] != kernel.HORIZON]


def test_dispatch_takes_the_pairs_that_all_pairs_give():
    rng = random.Random(4)
    for _ in range(150):
        wide = rng.choice([3, 20, 200])
        tasks = {f"t{i}": {"task_id": f"t{i}", "release": float(rng.randrange(-2, 60)), "place": float(rng.randrange(wide)), "duration": float(rng.randrange(15)), "quantity": float(rng.choice([1, 1, 2, 5]))} for i in range(rng.randrange(1, 40))}
        vehicles = {f"v{i}": {"start": float(rng.randrange(40)), "end": float(rng.randrange(10, 90)), "place": float(rng.randrange(wide)), "capacity": float(rng.randrange(9))} for i in range(rng.randrange(12))}
        run = kernel.Run(70.0, tasks, {k: kernel.Vehicle(k, *v.values()) for k, v in vehicles.items()})
        run.go()
        events, outcome = all_pairs(tasks, vehicles, 70.0)
        assert held(run.events) == events
        named = {"unserved_horizon": "waiting", "censored_horizon": "assigned"}
        assert {k: (named.get(o["status"], o["status"]), o["vehicle_id"]) for k, o in run.outcome.items()} == outcome


def _run(tasks, vehicles, horizon):
    """tasks: release, place, duration; vehicles: start, end, place."""
    run = kernel.Run(horizon, {k: {"task_id": k, "release": r, "place": p, "duration": d, "quantity": 1.0} for k, (r, p, d) in tasks.items()}, {k: kernel.Vehicle(k, *v, 99.0) for k, v in vehicles.items()})
    run.go()
    return run.events, {k: (o["status"], o["terminal_at"]) for k, o in run.outcome.items()}


def test_events_of_one_time_come_in_the_stated_order():
    """Golden: what happens at one time, in whatever order it was put in."""
    events, _ = _run({"new_task": (5.0, 0.0, 0.0), "old_task": (0.0, 0.0, 5.0)}, {"old": (0.0, 5.0, 0.0), "new": (5.0, 20.0, 0.0)}, 20.0)
    assert events == [
        (0.0, 3, "entry", "old", None), (0.0, 4, "release", None, "old_task"), (0.0, 5, "assignment", "old", "old_task"),
        (5.0, 1, "completion", "old", "old_task"), (5.0, 2, "exit", "old", None), (5.0, 3, "entry", "new", None), (5.0, 4, "release", None, "new_task"), (5.0, 5, "assignment", "new", "new_task"), (5.0, 1, "completion", "new", "new_task"),
        (20.0, 7, "exit", "new", None),
    ]


def test_exact_completions_at_the_horizon_count_and_the_rest_is_censored():
    events, state = _run({"a": (0.0, 0.0, 10.0), "b": (0.0, 50.0, 15.0), "c": (9.0, 0.0, 1.0), "d": (10.0, 0.0, 1.0)}, {"va": (0.0, 20.0, 0.0), "vb": (0.0, 20.0, 50.0)}, 10.0)
    assert state == {"a": ("completed", 10.0), "b": ("censored_horizon", 10.0), "c": ("unserved_horizon", 10.0), "d": ("unreleased", None)}
    assert max(e[0] for e in events) <= 10.0


def test_an_exit_interrupts_and_the_late_completion_is_stale():
    events, state = _run({"long": (0.0, 0.0, 10.0)}, {"v": (0.0, 5.0, 0.0)}, 20.0)
    assert state == {"long": ("interrupted_shift", 5.0)}
    assert [e for e in events if e[2] == "stale_completion_ignored"] == [(10.0, 1, "stale_completion_ignored", "v", "long")]


def test_carried_tasks_wait_without_a_release_and_zero_durations_close_at_one_time():
    events, state = _run({"early": (-4.0, 0.0, 0.0), "t1": (0.0, 0.0, 0.0), "t2": (0.0, 0.0, 0.0)}, {"v": (0.0, 10.0, 0.0)}, 10.0)
    assert set(state.values()) == {("completed", 0.0)}
    assert {e[4] for e in events if e[2] == "release"} == {"t1", "t2"} and [e[4] for e in events if e[2] == "assignment"] == ["early", "t1", "t2"]


def test_kernel_queries_simulate_all_orders_and_suppliers(spark, tmp_path):
    days, suppliers = [datetime.date(1995, 1, d) for d in (1, 2, 3)], [1, 7, 11, 190, 400, 1000]
    orders = [(k, 37 * k, days[k % 3]) for k in range(1, 60)]
    spark.createDataFrame(orders, "o_orderkey bigint, o_custkey bigint, o_orderdate date").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(s,) for s in suppliers], "s_suppkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    events = registry.QUERIES["kernel_events"](spark, str(tmp_path)).collect()
    outcomes = registry.QUERIES["kernel_outcomes"](spark, str(tmp_path)).collect()
    assert len(outcomes) == len(orders)
    for day in days:
        tasks = {f"t{k:06d}": {"release": float(k % 3600), "place": float(c % 500), "duration": 60.0 + k % 60, "quantity": 1.0} for k, c, d in orders if d == day}
        vehicles = {f"v{s:03d}": {"start": s % 180 * 10.0, "end": 4000.0 - s % 180 * 10, "place": s * 37 % 500 * 1.0, "capacity": 30.0} for s in suppliers}
        want, state = all_pairs(tasks, vehicles, 3600.0)
        got = sorted((r.event_index, r.time_s, r.phase_order, r.event_type, r.vehicle_id, r.task_id) for r in events if r.replication_id == str(day))
        assert held([r[1:] for r in got]) == want
        assert {r.task_id: r.vehicle_id for r in outcomes if r.replication_id == str(day)} == {k: v for k, (_, v) in state.items()}
        assert {r[4] for r in got if r[3] == "entry"} == set(vehicles)


def test_all_travel_times_against_brute_force(spark):
    keys = range(25)
    least = {(a, b): 0.0 if a == b else float("inf") for a in keys for b in keys}
    for u in keys:
        for v, s in (((u + 1) % 25, 10 + u % 7), ((u * 3 + 1) % 25, 25 + u % 5)):
            least[u, v] = min(least[u, v], float(s))
    for k in keys:
        for a in keys:
            for b in keys:
                least[a, b] = min(least[a, b], least[a, k] + least[k, b])
    got = {(r.source, r.target): r.seconds for r in registry.QUERIES["od_travel_times_all"](spark, "/root/testdata/sf0.001").collect()}
    assert got == {(f"n{a:02d}", f"n{b:02d}"): s for (a, b), s in least.items()}


def test_every_portfolio_has_sensing_statistics(spark):
    sf = "/root/testdata/sf0.001"
    got = {r.portfolio_id for r in registry.QUERIES["portfolio_sensing_statistics_all"](spark, sf).select("portfolio_id").distinct().collect()}
    want = {r.portfolio_id for r in registry.QUERIES["portfolio_statistics"](spark, sf).select("portfolio_id").distinct().collect()}
    assert len(want) > 2 and got == {p for p in want if set(p.split("-")) != {"0"}}


def test_population_counts_every_supplier_and_marks_cells_without(spark, tmp_path):
    spark.createDataFrame([(c, 0) for c in range(4)], "n_nationkey bigint, n_regionkey bigint").write.parquet(f"{tmp_path}/nation.parquet")
    spark.createDataFrame([(1, 0), (2, 0), (3, 0), (4, 1), (5, 3)], "s_suppkey bigint, s_nationkey bigint").write.parquet(f"{tmp_path}/supplier.parquet")
    got = {tuple(r) for r in registry.QUERIES["population_alignment_all"](spark, str(tmp_path)).collect()}
    assert got == {(0, 3.0, True), (1, 1.0, True), (2, 1.0, False), (3, 1.0, True)}
