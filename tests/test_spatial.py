"""Position joins against brute force: circles over the date line and poles, polygons with holes, hot cells, plans."""

import math

import numpy as np
import pytest

from zephyrgrid.operators.spatial import near, zone_at


def km(a, b):
    la, lb = math.radians(a[0]), math.radians(b[0])
    h = math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin(math.radians(b[1] - a[1]) / 2) ** 2
    return 2 * 6371.0088 * math.asin(min(1, math.sqrt(h)))


@pytest.mark.parametrize(("radius", "degrees"), [(150.0, None), (900.0, 3.7), (40.0, 0.25)])
def test_near_against_all_pairs(spark, radius, degrees):
    rng = np.random.default_rng(3)
    spots = lambda n: [(float(a), float(b)) for a, b in zip(np.degrees(np.arcsin(rng.uniform(-1, 1, n))), rng.uniform(-180, 180, n))]
    around = [(lat + dy, lon + dx) for lat, lon in [(89.5, 10), (-89.9, -170), (0, 179.95), (10, -179.99), (45, 0)]
              for dy in (-0.3, 0, 0.05) for dx in (-0.2, 0, 0.2) if abs(lat + dy) <= 90]
    around = [(float(a), float((b + 180) % 360 - 180)) for a, b in around] + [(90.0, 0.0), (-90.0, 33.0), (0.0, 180.0), (0.0, -180.0)]
    points, places = spots(60) + around, spots(400) + around + [(45.1, 0.1)] * 300
    left = spark.createDataFrame([(i, *p) for i, p in enumerate(points)] + [(-1, None, 3.0)], "p long, lat double, lon double")
    right = spark.createDataFrame([(i, *p) for i, p in enumerate(places)] + [(-1, 3.0, None)], "q long, lat double, lon double")
    got = {(r["p"], r["q"]) for r in near(left, right, radius, "p", "q", degrees=degrees).collect()}
    want = {(i, j) for i, a in enumerate(points) for j, b in enumerate(places) if km(a, b) <= radius}
    assert got == want and want


def inside(point, polygons):
    def odd(rings):
        hit = False
        for ring in rings:
            for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1]):
                if min(y1, y2) <= point[1] < max(y1, y2) and point[0] < x1 + (point[1] - y1) * (x2 - x1) / (y2 - y1):
                    hit = not hit
        return hit
    return any(odd(rings) for rings in polygons)


def test_zones_with_holes_and_parts(spark):
    box = lambda x, y, a, b: [[x, y], [x + a, y], [x + a, y + b], [x, y + b], [x, y]]
    rng = np.random.default_rng(9)
    star = [[4 * math.cos(t) * r, 4 * math.sin(t) * r] for t, r in zip(np.linspace(0, 2 * math.pi, 40, endpoint=False), rng.uniform(0.3, 1, 40))]
    floats = lambda x: [floats(v) for v in x] if isinstance(x, list) else float(x)
    zones = [("holed", [[box(0, 0, 4, 4), box(1, 1, 2, 2)], [box(1.5, 1.5, 0.5, 0.5)]]), ("star", [[star]]), ("next", [[box(4, 0, 2, 4)]]),
             ("twice", [[box(-9, -9, 1, 1)]]), ("twice", [[box(-9, -9, 1, 1)], [box(-8.5, -9, 2, 1)]]), ("none", []), ("flat", [[[[0, 0], [1, 0]]]])]
    zones = [(name, floats(polygons)) for name, polygons in zones]
    features = spark.createDataFrame(zones, "zone string, coordinates array<array<array<array<double>>>>").repartition(3)
    points = [(float(x), float(y)) for x, y in rng.uniform(-10, 8, (1500, 2))] + [(0.0, 0.0), (4.0, 2.0), (2.0, 4.0), (6.0, 0.0), (1.0, 1.0), (-8.5, -8.5)] + [(0.5, 0.5)] * 200
    frame = spark.createDataFrame([(i, y, x) for i, (x, y) in enumerate(points)] + [(-1, None, 1.0)], "p long, lat double, lon double")
    by_zone = {}
    for name, polygons in zones:
        by_zone.setdefault(name, []).extend([[r for r in rings if len(r) > 2] for rings in polygons])
    want = {(i, name) for i, p in enumerate(points) for name, polygons in by_zone.items() if inside(p, polygons)}
    for degrees in (0.5, 3.0):
        got = [(r["p"], r["zone"]) for r in zone_at(frame, features, "p", degrees=degrees).collect()]
        assert len(got) == len(set(got)) and set(got) == want


def test_no_nested_loops(spark):
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        points = spark.createDataFrame([(1, 1.0, 1.0)], "p long, lat double, lon double")
        features = spark.createDataFrame([("z", [[[[0.0, 0.0], [2.0, 0.0], [2.0, 2.0]]]])], "zone string, coordinates array<array<array<array<double>>>>")
        for df in (zone_at(points, features, "p"), near(points, points.withColumnRenamed("p", "q"), 5.0, "p", "q")):
            plan = df._jdf.queryExecution().executedPlan().toString()
            assert "NestedLoop" not in plan and "Cartesian" not in plan
            assert df.count() == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_hot_cells_are_spread_and_unfolded_cells_never_broadcast(spark):
    rng = np.random.default_rng(5)
    points = [(i, float(y), float(x)) for i, (x, y) in enumerate(rng.uniform(0, 1.2, (700, 2)))]
    frame = spark.createDataFrame(points, "p long, lat double, lon double")
    square = [[0.0, 0.0], [1.0, 0.0], [1.0, 1.0], [0.0, 1.0]]
    features = spark.createDataFrame([("z", [[square]]), (None, [[square]])], "zone string, coordinates array<array<array<array<double>>>>")
    found = zone_at(frame, features, "p", hot=20)
    assert sorted((r["p"], r["zone"]) for r in found.collect()) == [(i, "z") for i, y, x in points if x < 1 and y < 1]
    close = near(frame, frame.withColumnRenamed("p", "q"), 20.0, "p", "q", hot=20)
    want = {(a, b) for a, ya, xa in points for b, yb, xb in points if km((ya, xa), (yb, xb)) <= 20.0}
    assert {(r["p"], r["q"]) for r in close.collect()} == want
    for df in (found, close):
        plan = df._jdf.queryExecution().sparkPlan().toString()
        assert [line for line in plan.splitlines() if "_salt" in line and "SortMergeJoin" in line]
        assert not [line for line in plan.splitlines() if "_salt#" in line and "BroadcastHashJoin" in line]
