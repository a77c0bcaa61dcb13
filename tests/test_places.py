import math
import random
import tempfile
import time
from pathlib import Path

import numpy as np
import pytest
from pyspark.sql import functions as F

from gridmere.operators import clusters, nearest, polygons
from gridmere.session import materialise

R = 6371.0088


def hav(a, b, c, d):
    p = math.sin(math.radians(c - a) / 2) ** 2
    return p + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2


def km(*x):
    return 2 * R * math.asin(math.sqrt(min(1, hav(*x))))


def test_boundary_points_are_outside(spark):
    corners = [(0, 0.0, 0.0), (1, 0.0, 1.0), (2, 1.0, 1.0), (3, 1.0, 0.0)]
    rows = [(k, s, la, lo + k) for k in (0, 1) for s, la, lo in corners]  # two squares share an edge
    areas = polygons.edges_from_vertices(
        spark.createDataFrame(rows, "id int, seq int, lat double, lon double"), "id", "seq"
    )
    on_edge = [(0.5, 0.0), (0.5, 1.0), (0.0, 0.5), (1.0, 0.25), (0.0, 0.0), (1.0, 1.0), (1.0, 2.0), (0.75, 2.0)]
    spots = points(spark, [(i, a, b) for i, (a, b) in enumerate([*on_edge, (0.5, 0.5), (0.5, 1.5), (2.0, 0.5)])])
    got = {r["fid"]: r["id"] for r in polygons.with_containing_area(spots, areas, "id").collect()}
    assert got == {i: None for i in range(8)} | {8: 0, 9: 1, 10: None}


def points(spark, rows, cols="fid long, lat double, lon double"):
    return spark.createDataFrame(rows, cols)


def clumps(rng):
    """A dense town, a far village, a few strays over the pole and the date line."""
    out = [(rng.gauss(-37.8, 0.01), rng.gauss(144.9, 0.01)) for _ in range(300)]
    out += [(rng.gauss(-36.1, 0.002), rng.gauss(146.9, 0.002)) for _ in range(40)]
    out += [(89.5, 10.0), (89.7, -170.0), (-89.9, 0.0), (0.0, 179.99), (0.1, -179.98), (12.0, -60.0)]
    return out


@pytest.mark.parametrize("k", [1, 4])
def test_nearest_is_exact_everywhere(spark, k):
    rng = random.Random(5)
    feats = [(i, a, b) for i, (a, b) in enumerate(clumps(rng))]
    feats += [(1000 + i, feats[0][1], feats[0][2]) for i in range(10)]  # copies
    left = [(rng.uniform(-90, 90), rng.uniform(-180, 180)) for _ in range(60)]
    left += [(rng.gauss(-37.5, 0.5), rng.gauss(145.2, 0.5)) for _ in range(60)]
    left += [(90.0, 0.0), (-90.0, 5.0), (0.0, 180.0), (0.0, -180.0), (feats[0][1], feats[0][2])]
    l = points(spark, [(i, a, b) for i, (a, b) in enumerate(left)], "id long, lat double, lon double")
    got = {}
    for r in nearest.nearest_k(l, points(spark, feats), k).collect():
        got.setdefault((r["lat"], r["lon"]), []).append((r["rank"], r["fid"], r["km"]))
    for a, b in left:
        want = sorted((hav(a, b, c, d), f) for f, c, d in feats)[:k]
        mine = sorted(got[(a, b)])
        assert [m[0] for m in mine] == list(range(1, k + 1))
        assert np.allclose([m[2] for m in mine], [2 * R * math.asin(math.sqrt(min(1, h))) for h, _ in want], atol=1e-6)


def test_nearest_edge_rows(spark):
    l = points(spark, [(1, 0.0, 0.0), (2, None, 0.0), (3, 0.0, 0.0)], "id long, lat double, lon double")
    f = points(spark, [(7, 0.0, 1.0), (3, 0.0, -1.0), (9, None, 0.0)])
    out = {r["id"]: r["d"] for r in nearest.with_nearest_km(l, f, "d").collect()}
    assert out[2] is None and out[1] == out[3] == pytest.approx(km(0, 0, 0, 1))
    assert [r["fid"] for r in nearest.nearest_k(l, f, 5).orderBy("rank").collect()] == [3, 7]
    none = nearest.with_nearest_km(l, f.limit(0), "d")
    assert none.count() == 3 and none.where("d is not null").count() == 0


def test_nearest_by_category(spark):
    f = spark.createDataFrame([(1, "a", 0.0, 1.0), (2, "b", 0.0, 2.0)], "fid long, c string, lat double, lon double")
    l = points(spark, [(1, 0.0, 0.0)], "id long, lat double, lon double")
    r = nearest.with_nearest_km_by(l, f, "c", ["a", "b", "z"]).first()
    assert r["nearest_a_km"] == pytest.approx(km(0, 0, 0, 1)) and r["nearest_b_km"] == pytest.approx(km(0, 0, 0, 2))
    assert r["nearest_z_km"] is None


def square(x, y, s):
    x, y = float(x), float(y)
    return [[x, y], [x + s, y], [x + s, y + s], [x, y + s], [x, y]]


def shapes(spark):
    rings = [
        ("hole", [square(144.0, -38.0, 1.0), square(144.4, -37.6, 0.2)]),
        ("two", [square(146.0, -38.0, 0.1), square(146.5, -38.0, 0.1)]),
        ("tiny", [square(144.1, -37.9, 0.0005)]),
        ("wide", [square(100.0, -60.0, 30.0)]),
    ]
    df = spark.createDataFrame(rings, "k string, rings array<array<array<double>>>")
    return df.select("k", polygons.edges_from_rings(F.col("rings")).alias("edges"))


def test_polygons_with_holes_parts_and_sizes(spark):
    spots = {
        "ring": (-37.9, 144.2, {"hole"}), "in hole": (-37.5, 144.5, set()), "second part": (-37.95, 146.55, {"two"}),
        "between parts": (-37.95, 146.3, set()), "nested": (-37.8999, 144.1001, {"hole", "tiny"}),
        "wide": (-45.0, 110.0, {"wide"}), "outside": (10.0, 10.0, set()), "missing": (None, 1.0, set()),
    }
    pts = spark.createDataFrame([(n, a, b) for n, (a, b, _) in spots.items()], "n string, lat double, lon double")
    got = {}
    for r in polygons.with_containing_area(pts, shapes(spark), "k").collect():
        got.setdefault(r["n"], set()).update({r["k"]} - {None})
    assert got == {n: w for n, (_, _, w) in spots.items()}


def test_counts_and_lots(spark):
    pts = spark.createDataFrame([(1, -37.9, 144.2), (2, -37.9, 144.2), (3, 0.0, 0.0)], "id long, lat double, lon double")
    counts = {r["k"]: r["n"] for r in polygons.point_counts(pts, shapes(spark), "k", "n").collect()}
    assert counts == {"hole": 2, "two": 0, "tiny": 0, "wide": 0}
    lots = spark.createDataFrame(
        [("a", [square(0, 0, 1.0)]), ("a", [square(0, 0, 1.0)]), ("b", [square(0, 0, 4.0)]),
         ("c", [square(9, 9, 1.0)]), ("d", [square(9, 9, 1.004)])],
        "k string, rings array<array<array<double>>>",
    ).select("k", polygons.edges_from_rings(F.col("rings")).alias("edges"))
    where = spark.createDataFrame([(1, 0.5, 0.5), (2, 9.5, 9.5), (3, 3.0, 3.0), (4, 50.0, 50.0)], "id long, lat double, lon double")
    out = polygons.smallest_lot(where, lots, "k", area=polygons.shoelace(F.col("edges")))
    assert {r["id"]: (r["land_m2"], r["land_lot_shared"]) for r in out.collect()} == {
        1: (1.0, 0), 2: (None, 1), 3: (16.0, 0), 4: (None, None)
    }


def test_projected_area_of_a_small_lot(spark):
    """20 m by 30 m near Melbourne, from metres per degree on the ellipsoid."""
    lat = math.radians(-37.8)
    a, e2 = 6378137.0, 0.00669438002290
    w = 1 - e2 * math.sin(lat) ** 2
    north, east = math.radians(1) * a * (1 - e2) / w**1.5, math.radians(1) * a * math.cos(lat) / math.sqrt(w)
    dy, dx = 30 / north, 20 / east
    ring = [[145.0, -37.8], [145.0 + dx, -37.8], [145.0 + dx, -37.8 + dy], [145.0, -37.8 + dy]]
    df = spark.createDataFrame([([ring],)], "rings array<array<array<double>>>")
    got = df.select(polygons.projected_area(polygons.edges_from_rings(F.col("rings")))).first()[0]
    assert got == pytest.approx(600, rel=2e-3)


def test_clusters_equal_brute_force(spark):
    rng = random.Random(2)
    rows = [(i, f"n{i % 3}", -37.8 + rng.uniform(0, 0.02), 144.9 + rng.uniform(0, 0.02)) for i in range(200)]
    rows += [(500 + i, "n0", -37.8, 144.9) for i in range(20)]  # copies
    rows += [(600 + i, "chain", -37.0, 145.0 + 0.002 * i) for i in range(30)]  # one long chain
    rows += [(600, "chain", -37.0, 145.0)]  # the same id twice
    df = spark.createDataFrame(rows, "fid long, name string, lat double, lon double")
    uniq = {r[0]: r for r in reversed(rows)}
    root = {i: i for i in uniq}

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    ids = sorted(uniq)
    for x in ids:
        for y in ids:
            if x < y and uniq[x][1] == uniq[y][1] and km(*uniq[x][2:], *uniq[y][2:]) <= 0.25:
                root[find(y)] = find(x)
    groups = {}
    for i in ids:
        groups.setdefault(find(i), []).append(uniq[i])
    want = sorted((g[0][1], len(g), round(sum(r[2] for r in g) / len(g), 9), round(sum(r[3] for r in g) / len(g), 9)) for g in groups.values())
    got = sorted((r["name"], r["records"], round(r["lat"], 9), round(r["lon"], 9)) for r in clusters.merge_same_name(df, "fid", "name").collect())
    assert got == want


@pytest.mark.parametrize("portion", [20, 250_000])
def test_connected_groups_of_portions(spark, portion, monkeypatch):
    monkeypatch.setattr(clusters, "_EDGES", portion)
    rng = random.Random(3)
    rows = [(f"n{a}", f"n{b}") for a, b in ((rng.randrange(150), rng.randrange(150)) for _ in range(90))]
    least = {x: x for row in rows if row[0] != row[1] for x in row}
    for _ in least:
        for a, b in rows:
            if a != b:
                least[a] = least[b] = min(least[a], least[b])
    edges = spark.createDataFrame([*rows, (None, "n1")], "a string, b string")
    assert {r["node"]: r["group"] for r in clusters.connected_groups(edges).collect()} == least


def test_stage_tables_leave_no_shuffle_files(spark):
    def files():
        return set(Path(spark.conf.get("spark.local.dir", tempfile.gettempdir())).glob("blockmgr-*/*/shuffle_*"))

    before = files()
    table = materialise(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count(), "sums")
    for _ in range(50):
        if not files() - before:
            break
        time.sleep(0.1)
    assert not files() - before
    assert table.count() == 7


def test_connected_groups_long_chain(spark):
    edges = spark.createDataFrame([(i, i + 1) for i in range(64)] + [(100, 101)], "a long, b long")
    out = {r["node"]: r["group"] for r in clusters.connected_groups(edges).collect()}
    assert set(out[i] for i in range(65)) == {0} and out[100] == out[101] == 100


@pytest.mark.parametrize("k", [1, 3])
def test_a_hot_city_and_an_empty_region(spark, k):
    """A block with thousands of points, one of metres with hundreds, and positions far from everything."""
    rng = np.random.default_rng(8)
    city = np.array([-37.8, 144.9]) + rng.normal(0, 0.02, (6000, 2))
    block = np.array([-37.8, 144.9]) + rng.uniform(0, 1e-4, (600, 2))
    feats = np.vstack([city, block, [[-37.8, 144.9]] * 50, [[-20.0, 120.0], [-20.0, 120.1]]])
    f = points(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(feats)]).repartition(5)
    left = np.vstack([city[:40] + 1e-4, block[:40] + 1e-6, rng.uniform([-45, 60], [-10, 179], (60, 2)), [[60.0, -100.0], [-37.8, 144.9]]])
    l = points(spark, [(i, float(a), float(b)) for i, (a, b) in enumerate(left)], "id long, lat double, lon double")
    leaves = nearest.with_leaves(f, "lat", "lon", [])
    assert leaves.count() == len(feats)
    fullest = leaves.where("__v < 26").groupBy("__v", "__cx", "__cy").count().agg(F.max("count")).first()[0]
    assert fullest <= nearest.LEAF
    near = nearest.nearest_k(l, f, k)
    got = {}
    for r in near.collect():
        got.setdefault((r["lat"], r["lon"]), []).append((r["rank"], r["fid"], r["km"]))
    p, q = np.radians(feats), np.radians(left)
    for (a, b), (la, lo) in zip(left.tolist(), q):
        h = np.sin((p[:, 0] - la) / 2) ** 2 + np.cos(la) * np.cos(p[:, 0]) * np.sin((p[:, 1] - lo) / 2) ** 2
        want = 2 * R * np.arcsin(np.sqrt(np.sort(h)[:k]))
        assert np.allclose([x[2] for x in sorted(got[(a, b)])], want, atol=1e-6)
    # positions meet leaves, not the city: few candidates each, also from far away
    positions = l.select("lat", "lon").distinct()
    boxes = leaves.groupBy("__v", "__cx", "__cy").agg(
        F.count(F.lit(1)).alias("__n"), F.min("lat").alias("__south"), F.max("lat").alias("__north"),
        F.min("lon").alias("__west"), F.max("lon").alias("__east"), F.min("__x").alias("__x"), F.min("__y").alias("__y"),
    )
    frontier = nearest._frontier(positions, boxes, [], k).groupBy("lat", "lon").count()
    assert frontier.agg(F.max("count")).first()[0] < 40 and boxes.count() > 500


def test_the_search_is_planned_without_a_job(spark):
    jobs = spark.sparkContext.statusTracker()
    spark.sparkContext.setJobGroup("planning", "")
    f = points(spark, [(1, 0.0, 0.0), (2, 1.0, 1.0)])
    nearest.nearest_k(f, f, 2)
    assert not jobs.getJobIdsForGroup("planning")
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)


def test_routes_take_independent_minima_over_near_stations(spark):
    from gridmere.functions.sphere import coordinate_key
    from gridmere.plans.enrich import with_routes

    spots = spark.createDataFrame([(-37.8, 144.9), (-37.5, 145.5)], "lat double, lon double")
    stations = points(spark, [(1, -37.81, 144.9), (2, -37.82, 144.9), (3, -37.83, 144.9), (4, -37.9, 144.9)])

    def key(a, b):
        return f"{a:.5f},{b:.5f}"

    o = key(-37.8, 144.9)
    routes = spark.createDataFrame(
        [(o, "cbd", 9.0, 20.0), (o, key(-37.81, 144.9), 3.0, 9.0), (o, key(-37.82, 144.9), 4.0, 5.0),
         (o, key(-37.83, 144.9), None, None), (o, key(-37.9, 144.9), 0.1, 0.1)],
        "origin_key string, dest_key string, drive_km double, drive_min double",
    )
    got = {r["lat"]: tuple(r)[2:] for r in with_routes(spots, routes, stations).select(
        "lat", "lon", "cbd_drive_km", "cbd_drive_min", "nearest_train_station_drive_km", "nearest_train_station_drive_min").collect()}
    assert got == {-37.8: (9.0, 20.0, 3.0, 5.0), -37.5: (None, None, None, None)}
    assert spots.select(coordinate_key(F.col("lat"), F.col("lon"))).first()[0] == o
