"""Polygons, pixel shares, outlines and projections on small shapes, against brute force."""

import json
import math
import random

import pytest
from plans import rows_met
from pyspark.sql import functions as F

from sitelens.functions import projection as P
from sitelens.operators import outlines as O
from sitelens.operators import raster as R
from sitelens.operators import zones as Z


def rings(spark, shapes):
    """shapes: {zone: [ring, ...]}, each a list of (x, y)."""
    return spark.createDataFrame([(z, k, n, float(x), float(y)) for z, own in shapes.items() for k, ring in enumerate(own) for n, (x, y) in enumerate(ring)], "zone string, ring int, pos int, x double, y double")


def cast(own, x, y):
    odd = False
    for ring in own:
        for (x1, y1), (x2, y2) in zip(ring, [*ring[1:], ring[0]]):
            if (y1 > y) != (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1):
                odd = not odd
    return odd


SHAPES = {
    "hole": [[(0, 0), (10, 0), (10, 10), (0, 10)], [(3, 3), (3, 7), (7, 7), (7, 3)]],
    "closed": [[(20, 0), (30, 0), (25, 8), (20, 0)]],
    "saw": [[(0, 20), (4, 24), (8, 20), (12, 24), (16, 20), (16, 30), (0, 30)]],
    "bow": [[(-5, -5), (-1, -1), (-1, -5), (-5, -1)]],
    "flat": [[(40, 5), (50, 5), (60, 5)]],
    "far": [[(-100, -100), (100, -99), (101, 100), (-99, 101)]],
    "round": [[(50 + 9 * math.cos(k / 250 * math.pi), 20 + 9 * math.sin(k / 250 * math.pi)) for k in range(500)]],
}


@pytest.mark.parametrize("cell", [0.7, 4.0, 64.0])
def test_points_inside(spark, cell):
    rng = random.Random(1)
    spots = [(rng.randint(-240, 240) / 4, rng.randint(-60, 130) / 4) for _ in range(600)] + [(x, y) for x in range(-5, 31, 5) for y in range(-5, 31)] + [p for own in SHAPES.values() for ring in own for p in ring[:8]]
    points = spark.createDataFrame([(i, float(x), float(y), "k") for i, (x, y) in enumerate(spots)] + [(-1, None, 1.0, "k")], "id long, x double, y double, cx string")
    got = sorted(map(tuple, Z.inside(Z.edges(rings(spark, SHAPES)), points, ["id"], cell).collect()))
    assert got == sorted((z, i) for z, own in SHAPES.items() for i, (x, y) in enumerate(spots) if cast(own, x, y))


def test_cells_without_edges_need_none(spark):
    sides = Z.edges(rings(spark, {"far": SHAPES["far"], "hole": [[(0, 0), (90, 0), (90, 90), (0, 90)], [(20, 20), (60, 20), (60, 60), (20, 60)]]}))
    cells = Z.cover(sides, 5.0).where("zone = 'hole'").collect()
    assert len({(r.cy, r.cx) for r in cells}) == len(cells) and sum(r.whole for r in cells) > len(cells) / 3
    assert all(cast([[(0, 0), (90, 0), (90, 90), (0, 90)], [(20, 20), (60, 20), (60, 60), (20, 60)]], 5 * r.cx + 2.5, 5 * r.cy + 2.5) for r in cells if r.whole)


def test_none(spark):
    none = rings(spark, SHAPES).limit(0)
    points = spark.createDataFrame([(1, 2.0, 3.0)], "id long, x double, y double")
    assert not Z.inside(Z.edges(none), points, ["id"], 1.0).collect() and not Z.weights(Z.edges(none), 1.0).collect()
    assert not Z.inside(Z.edges(rings(spark, SHAPES)), points.limit(0), ["id"], 4.0).collect()


def test_painted_in_order(spark):
    codes = spark.createDataFrame([("hole", 2, 7), ("far", 1, 3)], "zone string, ordem int, code int")
    pixels = spark.createDataFrame([(1.5, 1.5), (5.0, 5.0), (200.0, 0.0), (1.5, 1.5)], "x double, y double")
    got = Z.painted_polygons(Z.edges(rings(spark, SHAPES)), codes, pixels, 4.0).collect()
    assert sorted(map(tuple, got)) == [(1.5, 1.5, 7), (5.0, 5.0, 3)]


@pytest.mark.parametrize("size", [1.0, 3.0])
def test_shares_add_up_to_the_area(spark, size):
    """Whichever way rings run; a plane cut into triangles has shares of 1 for every pixel inside."""
    shapes = {k: SHAPES[k] for k in ("hole", "closed", "saw", "far", "round")} | {"back": [SHAPES["hole"][0][::-1], SHAPES["hole"][1][::-1]]}
    v = rings(spark, shapes)
    got = {r.zone: r.w for r in Z.weights(Z.edges(v), size, v.where("ring > 0").select("zone", "ring")).groupBy("zone").agg(F.sum("weight").alias("w")).collect()}
    area = lambda ring: abs(sum(a * d - c * b for (a, b), (c, d) in zip(ring, [*ring[1:], ring[0]]))) / 2
    for z, own in shapes.items():
        assert math.isclose(got[z] * size * size, area(own[0]) - sum(map(area, own[1:])), rel_tol=1e-9)
    corners = [(0, 0), (7.3, 0), (12, 0), (12, 12), (0, 12), (5.1, 6.2)]
    parts = {f"t{k}": [[corners[i] for i in t]] for k, t in enumerate([(0, 1, 5), (1, 2, 5), (2, 3, 5), (3, 4, 5), (4, 0, 5)])}
    cells = Z.weights(Z.edges(rings(spark, parts)), size).groupBy("row", "col").agg(F.sum("weight").alias("w")).collect()
    assert len(cells) == (12 / size) ** 2 and all(abs(r.w - 1) < 1e-9 for r in cells)


def test_pixel_shares_against_fine_points(spark):
    v = rings(spark, {"hole": SHAPES["hole"], "closed": SHAPES["closed"], "saw": SHAPES["saw"]})
    for r in Z.weights(Z.edges(v), 4.0, v.where("ring > 0").select("zone", "ring")).collect():
        hits = sum(cast(SHAPES[r.zone], 4 * (r.col + (i + 0.5) / 60), 4 * (r.row + (j + 0.5) / 60)) for i in range(60) for j in range(60))
        assert abs(r.weight - hits / 3600) < 0.02


def test_buffer_mean_and_mode(spark):
    """A site's circle: constant values have that mean, a slope has its value in the middle, and the mode is by area."""
    sites = spark.createDataFrame([("s", 20.0, 30.0, 6.5)], "zone string, x double, y double, r double")
    shares = Z.weights(Z.edges(Z.circle(sites, 256)), 1.0)
    pixels = spark.createDataFrame([(r, c, 2.0 * c + r, 5 if c < 19 else 4, None) for r in range(60) for c in range(40)], "row int, col int, v double, code int, none double")
    got = Z.weighted(shares, pixels, "v").first()
    assert math.isclose(got.weight, math.pi * 6.5**2, rel_tol=1e-3) and math.isclose(got.mean_v, 2 * 19.5 + 29.5, abs_tol=0.01)
    assert Z.weighted_mode(shares, pixels, "code").first().moda == 4 and not Z.weighted(shares, pixels, "none").collect()


def outline(spark, texts, least=1):
    rows = [(r, c, int(v), f"s{k}") for k, text in enumerate(texts) for r, line in enumerate(text.split()) for c, v in enumerate(line) if v != "."]
    pixels = spark.createDataFrame(rows, "row int, col int, code int, site string")
    return pixels, *O.dissolved(pixels, ["site"], "code", least)


def test_outlines(spark):
    rng = random.Random(6)
    maps = ["1", "111 1.1 111", "1.1 .1. 1.1", "11. .11 1.1", "11111 1...1 1.1.1 1...1 11111", "1122 1122 2211 2211", "11111 1.1.1 11111", "1111 1..1 11.1 1111 .1.. 11.1"]
    pixels, shapes, corners = outline(spark, [*maps, " ".join("".join(rng.choice("1122.") for _ in range(11)) for _ in range(9))])
    shapes, corners = shapes.collect(), corners.collect()
    size = {r.component: r.n for r in R.labelled(pixels, ["site"], "code").groupBy("component").agg(F.count("*").alias("n")).collect()}
    by_ring: dict = {}
    for c in corners:
        by_ring.setdefault(c.ring, []).append((c.pos, c.x, c.y))
    assert {r.ring for r in shapes} == by_ring.keys()
    total = dict.fromkeys(size, 0)
    for r in shapes:
        ring = [(x, y) for _, x, y in sorted(by_ring[r.ring])]
        turns = list(zip(ring, [*ring[1:], ring[0]]))
        assert all((a == c) != (b == d) for (a, b), (c, d) in turns) and sum(abs(a - c) + abs(b - d) for (a, b), (c, d) in turns) == r.sides
        assert all((a[0] == b[0]) != (b[0] == c[0]) for a, b, c in zip(ring, [*ring[1:], ring[0]], [*ring[2:], *ring[:2]]))
        assert sum(a * d - c * b for (a, b), (c, d) in turns) == 2 * r.pixels
        total[r.component] += r.pixels
    assert total == size and sum(r.pixels > 0 for r in shapes) == len(size)
    holes = {s: sum(r.pixels < 0 for r in shapes if r.site == s) for s in ("s0", "s1", "s4", "s6")}
    assert holes == {"s0": 0, "s1": 1, "s4": 1, "s6": 2}


def test_long_ring_takes_few_rounds(spark, monkeypatch):
    """A ring of 2 x 700 sides and more is in order after a dozen rounds."""
    written = []
    monkeypatch.setattr(O, "settle", lambda df, f=O.settle: (written.append(1), f(df))[1])
    pixels = spark.range(700).select(F.lit(0).alias("row"), F.col("id").cast("int").alias("col"), F.lit(1).alias("code"))
    shapes, corners = O.dissolved(pixels, [], "code")
    assert [tuple(r) for r in shapes.select("pixels", "sides").collect()] == [(700, 1402)] and len(written) < 20
    assert [(r.x, r.y) for r in corners.orderBy("pos").collect()] == [(0, 0), (700, 0), (700, 1), (0, 1)]


def test_geojson_of_classes(spark, tmp_path):
    pixels, _, _ = outline(spark, ["111.2 1.1.. 111.1"])
    place = F.struct((F.col("x") * 2.0).alias("lon"), (-F.col("y") * 2.0).alias("lat"))
    items = O.collections(pixels, ["site"], "code", place, 900.0, F.concat(F.lit("c"), "code"), 1)
    O.write_collections(items, ["site"], f"{tmp_path}/out")
    got = json.loads(spark.read.text(f"{tmp_path}/out/site=s0").first().value)
    one, two = got["features"]
    assert got["type"] == "FeatureCollection" and one["properties"] == {"site": "s0", "classe_id": 1, "classe_nome": "c1", "area_m2": 8100.0}
    assert [len(p) for p in one["geometry"]["coordinates"]] == [2, 1] and two["geometry"]["coordinates"] == [[[[8.0, -0.0], [10.0, -0.0], [10.0, -2.0], [8.0, -2.0], [8.0, -0.0]]]]
    assert [f["properties"]["area_m2"] for f in json.loads(O.collections(pixels, ["site"], "code", place, 900.0, F.lit("x"), 8).first().geojson)["features"]] == [7200.0]


@pytest.mark.parametrize("ellipsoid", ["WGS84", "GRS80"])
def test_there_and_back(spark, ellipsoid):
    rng = random.Random(4)
    rows = [(rng.uniform(-84, 84), rng.uniform(-180, 180)) for _ in range(300)] + [(0.0, 0.0), (0.0, 180.0), (-33.9, 18.4), (84.0, -180.0)]
    df = spark.createDataFrame([(float(a), float(b)) for a, b in rows], "lat double, lon double").withColumn("zone", P.zone(F.col("lon")))
    south = F.col("lat") < 0
    x, y = P.forward(F.col("lat"), F.col("lon"), P.meridian(F.col("zone")), south, ellipsoid)
    lat, lon = P.inverse(x, y, P.meridian(F.col("zone")), south, ellipsoid)
    for r in df.select("lat", "lon", "zone", x.alias("x"), y.alias("y"), lat.alias("a"), lon.alias("b")).collect():
        assert abs(r.a - r.lat) < 1e-9 and min(abs(r.b - r.lon), 360 - abs(r.b - r.lon)) < 1e-9 and 1 <= r.zone <= 60 and 100_000 < r.x < 900_000


def test_known_places(spark):
    """A tower in Toronto, the crossing of equator and meridian, a place far off, southern Norway and Svalbard."""
    df = spark.createDataFrame([(43.64256667, -79.38713889), (0.0, 3.0), (-0.5, 3.0)], "lat double, lon double").withColumn("zone", P.zone(F.col("lon")))
    x, y = P.forward(F.col("lat"), F.col("lon"), P.meridian(F.col("zone")), F.col("lat") < 0)
    got = [(r.zone, round(r.x), round(r.y)) for r in df.select("zone", x.alias("x"), y.alias("y")).collect()]
    assert got[0] == (17, 630084, 4833439) and got[1] == (31, 500000, 0) and got[2][:2] == (31, 500000) and 9_900_000 < got[2][2] < 10_000_000
    wide = spark.createDataFrame([(60.0, 4.0, 32), (60.0, 2.0, 31), (75.0, 8.0, 31), (75.0, 10.0, 33), (75.0, 40.0, 37), (10.0, 180.0, 1)], "lat double, lon double, want int")
    assert wide.where(P.zone(F.col("lon"), F.col("lat")) != F.col("want")).count() == 0
    off = P.forward(F.lit(10.0), F.lit(100.0), F.lit(0.0), F.lit(False))
    assert spark.range(1).select(*off).first()[0] is None


def test_zonal_of_copies_meets_places_once(spark):
    """40 zones and 60 points at each of few places: sums of all rows, from pairs of places."""
    zones = [(40 * k + c, 30.0 + k % 3, -100.0 + k // 3) for k in range(9) for c in range(40)] + [(999, None, 1.0), (1, 80.0, 0.0)]
    points = [(30.1 + k % 3, -100.1 + k // 3, None if c % 5 == 0 else float(k * c % 7) / 4) for k in range(9) for c in range(60)]
    df = R.zonal(spark.createDataFrame(zones, "zone long, lat double, lon double"), spark.createDataFrame(points, "lat double, lon double, v double"), 120.0, "v")
    assert rows_met(df) <= 9 * 9 * 9
    far = lambda a, b, c, d: 12742 * math.asin(math.sqrt(math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2))
    want = {}
    for z, lat, lon in zones:
        if lat is not None and lat < 80:
            own = [v for a, b, v in points if v is not None and far(lat, lon, a, b) <= 120]
            want[z] = (sum(own), len(own))
    assert {r.zone: (r.sum_v, r.n) for r in df.collect()} == want and all(r.mean_v == r.sum_v / r.n for r in df.collect())


def test_points_of_one_place_are_looked_up_once(spark, monkeypatch):
    """300 points at each of three places among 40 zones: joins meet places, and only the last one puts out all pairs."""
    monkeypatch.setattr(Z, "TOGETHER", 64)
    shapes = {f"z{k}": [[(k / 8, 0), (k / 8 + 9, 0), (k / 8 + 9, 9), (k / 8, 9)]] for k in range(40)} | {"off": [[(50, 50), (60, 50), (60, 60)]]}
    spots = [(2.03, 3.03), (5.51, 4.49), (70.0, 70.0)]
    points = spark.createDataFrame([(3 * i + k, x, y) for k, (x, y) in enumerate(spots) for i in range(300)], "id long, x double, y double")
    df = Z.inside(Z.edges(rings(spark, shapes)), points, ["id"], 4.0)
    want = sorted((z, 3 * i + k) for z, own in shapes.items() for k, (x, y) in enumerate(spots) for i in range(300) if cast(own, x, y))
    assert sorted(map(tuple, df.collect())) == want and rows_met(df) == len(want)  # edges met by every point would be more
