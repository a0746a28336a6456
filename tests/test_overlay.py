"""Lines cut by arbitrary polygons against plain geometry over random cases."""

from __future__ import annotations

import math
import random

import pytest
from pyspark.errors import PySparkException

from fleetlens.operators import planar
from fleetlens.operators.running import run_up

RINGS = "polygon_id string, ring array<struct<x:double,y:double>>"
SHAPES = {"a": [[(0, 0), (10, 0), (10, 10), (6, 10), (6, 4), (4, 4), (4, 10), (0, 10)]], "b": [[(12, 0), (22, 0), (22, 10), (12, 10)], [(15, 3), (15, 7), (19, 7), (19, 3)]], "c": [[(3, -3), (25, 5), (3, 2)]], "d": [[(10, 0), (12, 0), (12, 10), (10, 10)]]}


def covers(rings, x, y):
    inside = False
    for ring in rings:
        for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True):
            cross = (bx - ax) * (y - ay) - (by - ay) * (x - ax)
            if abs(cross) < 1e-9 and min(ax, bx) - 1e-9 <= x <= max(ax, bx) + 1e-9 and min(ay, by) - 1e-9 <= y <= max(ay, by) + 1e-9:
                return True
            if (ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax:
                inside = not inside
    return inside


def at(line, f):
    lengths = [math.dist(a, b) for a, b in zip(line, line[1:], strict=False)]
    d = f * sum(lengths)
    for (a, b), n in zip(zip(line, line[1:], strict=False), lengths, strict=True):
        if d <= n and n:
            return tuple(p + (q - p) * d / n for p, q in zip(a, b, strict=True))
        d -= n
    return line[-1]


def test_line_pieces(spark):
    rng = random.Random(5)
    lines = {f"e{k:02d}": [(rng.uniform(-5, 27), rng.uniform(-5, 13)) for _ in range(rng.choice([2, 2, 3, 6]))] for k in range(60)}
    lines |= {"along": [(-2.0, 0.0), (25.0, 0.0)], "border": [(10.0, -1.0), (10.0, 11.0)], "corner": [(-1.0, 1.0), (1.0, -1.0)], "inside": [(1.0, 1.0), (2.0, 1.0)], "outside": [(50.0, 50.0), (51.0, 50.0)], "again": [(1.0, 1.0), (1.0, 1.0), (13.0, 5.0), (13.0, 5.0)], "hole": [(16.0, 4.0), (18.0, 6.0)]}
    point = lambda p: {"x": float(p[0]), "y": float(p[1])}
    table = spark.createDataFrame([(k, [point(p) for p in line], "clash") for k, line in lines.items()], "edge_id string, line array<struct<x:double,y:double>>, polygon_id string").repartition(3)
    edges = planar.ring_edges(spark.createDataFrame([(i, [point(p) for p in ring]) for i, rings in SHAPES.items() for ring in rings], RINGS))
    got = {}
    for r in planar.line_pieces(table, edges, 4.0).collect():
        got.setdefault(r.edge_id, []).append((r.piece_index, r.polygon_id, r.start_fraction, r.end_fraction))
    assert set(got) == set(lines)
    for k, line in lines.items():
        pieces = sorted(got[k])
        assert [p[0] for p in pieces] == list(range(len(pieces))) and pieces[0][2] == 0.0 and pieces[-1][3] == 1.0
        assert all(a[3] == b[2] for a, b in zip(pieces, pieces[1:], strict=False)) and all(p[2] < p[3] for p in pieces)
        for _, owner, low, high in pieces:
            for f in (0.5, 0.01, 0.99, rng.random()):  # one owner along the whole piece
                x, y = at(line, low + (high - low) * f)
                assert owner == min((i for i, rings in SHAPES.items() if covers(rings, x, y)), default=None), (k, low, high, f)
    assert [p[1] for p in got["hole"]] == [None] and [p[1] for p in sorted(got["border"])] == [None, "c", "a", "a", None]
    assert planar.line_pieces(table.limit(0), edges, 4.0).count() == 0 and planar.line_pieces(table.where("edge_id = 'inside'"), edges.limit(0), 4.0).first().polygon_id is None


@pytest.mark.parametrize("line", [None, [], [(1.0, 1.0)], [(1.0, 1.0), (1.0, 1.0)], [(0.0, 0.0), (float("inf"), 1.0)]])
def test_lines_without_length_are_refused(spark, line):
    rows = spark.createDataFrame([("e", line and [{"x": x, "y": y} for x, y in line])], "edge_id string, line array<struct<x:double,y:double>>")
    with pytest.raises(PySparkException):
        planar.line_pieces(rows, planar.ring_edges(spark.createDataFrame([], RINGS)), 4.0).collect()


def test_running_sums(spark):
    rng = random.Random(2)
    rows = [(rng.choice("ab"), k, rng.randrange(9)) for k in rng.sample(range(3000), 900)]
    table = spark.createDataFrame(rows, "g string, k long, v long").repartition(7)
    own = {(g, k): sum(v for h, j, v in rows if h == g and j < k) for g, k, _ in rows}
    assert {(r.g, r.k): r.before for r in run_up(table, ["g"], ["k"], "v", "before").collect()} == own
    assert {r.k: r.before for r in run_up(table, [], ["k"], "v", "before").collect()} == {k: sum(v for _, j, v in rows if j < k) for _, k, _ in rows}
    assert run_up(table.limit(0), [], ["k"], "v", "before").count() == 0
