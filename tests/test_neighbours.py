"""Nearest neighbours by pivots against all pairs: clusters, copies, ties, nulls, several groups."""

import math

import numpy as np
import pytest
from plans import rows_met
from pyspark.sql import functions as F

from sitelens.operators import match, neighbours


def brute(rows, k):
    out = {}
    for g in {r[1] for r in rows if r[1] is not None}:
        own = [r for r in rows if r[1] == g and not any(x is None or x != x for x in r[2:])]
        x = np.array([r[2:] for r in own], float).reshape(len(own), -1)
        sd = x.std(axis=0)
        z = (x - x.mean(axis=0)) / np.where(sd < 1e-9, 1, sd)
        for i, r in enumerate(own):
            d = np.sqrt(((z - z[i]) ** 2).sum(axis=1))
            out |= {(r[0], n + 1): (own[j][0], d[j]) for n, j in enumerate(sorted((j for j in range(len(own)) if j != i), key=lambda j: (round(d[j], 8), own[j][0]))[:k])}
    return out


def table(kind):
    rng = np.random.default_rng(3)
    n = 600
    x = np.round(rng.normal(size=(n, 3)), {"ties": 0, "clusters": 3, "copies": 2}[kind])
    if kind == "clusters":
        x += rng.integers(0, 9, size=(n, 1)) * 30
    if kind == "copies":
        x[: n // 3] = x[0]
    rows = [(int(i), "a" if i % 4 else "b", *map(float, v)) for i, v in enumerate(x)]
    return rows + [(2000, None, 1.0, 2.0, 3.0), (2001, "a", None, 2.0, 3.0), (2002, "b", 1.0, float("nan"), 3.0), (2003, "alone", 1.0, 2.0, 3.0), (2004, "two", 1.0, 2.0, 3.0), (2005, "two", 1.0, 2.0, 3.0)]


@pytest.mark.parametrize("kind,block", [("ties", 48), ("clusters", 48), ("copies", 48), ("clusters", 2048)])
def test_same_as_all_pairs(spark, monkeypatch, kind, block):
    monkeypatch.setattr(neighbours, "BLOCK", block)
    monkeypatch.setattr(neighbours, "CELL", block // 2)
    monkeypatch.setattr(neighbours, "CHUNK", block)
    rows = table(kind)
    df = spark.createDataFrame(rows, "id long, region string, a double, b double, c double").withColumn("g", F.lit("clash")).withColumn("v", F.lit(1))
    got = {(r.id, r.rn): (r.vizinho, r.dist) for r in match.nearest(df, "id", "region", ["a", "b", "c"], 3).collect()}
    want = brute(rows, 3)
    assert got.keys() == want.keys() and {i for i, _ in got}.isdisjoint({2000, 2001, 2002, 2003}) and got[2004, 1] == (2005, 0.0)
    assert all(abs(got[x][1] - want[x][1]) < 1e-6 and (got[x][0] == want[x][0] or kind == "ties") for x in got)


def test_text_ids_and_empty(spark):
    df = spark.createDataFrame([("x", 1.0), ("y", 2.0), ("z", 4.0)], "name string, a double")
    got = match.nearest(df, "name", None, ["a"], 1).collect()
    assert sorted((r.name, r.vizinho) for r in got) == [("x", "y"), ("y", "x"), ("z", "y")]
    assert not match.nearest(df.limit(0), "name", None, ["a"], 1).collect()


def test_meetings_fall_with_the_bound(spark, monkeypatch):
    """Of 1500 places in 30 clusters, a place meets few of the blocks; without clusters, in many dimensions, it meets most."""
    monkeypatch.setattr(neighbours, "BLOCK", 40)
    monkeypatch.setattr(neighbours, "CELL", 40)
    rng = np.random.default_rng(5)
    near = rng.normal(size=(1500, 4)) * 0.1 + rng.integers(0, 30, size=(1500, 1)) * 10
    for x, most in ((near, 0.15), (rng.normal(size=(1500, 4)), 1.0)):
        df = spark.createDataFrame([(int(i), 1, [float(c) for c in v], True) for i, v in enumerate(x)], "id long, g int, v array<double>, asks boolean")
        blocks, _, met, _ = neighbours.meetings(df, "id", 4)
        pairs = met.agg(F.sum("rows")).first()[0]
        assert pairs <= most * 1500 * 1500


def haversine(a, b):
    (la, oa), (lb, ob) = [[math.radians(x) for x in p] for p in (a, b)]
    return 12742 * math.asin(math.sqrt(min(1, math.sin((lb - la) / 2) ** 2 + math.cos(la) * math.cos(lb) * math.sin((ob - oa) / 2) ** 2)))


def test_pairs_of_one_group_are_shared_out(spark, monkeypatch):
    """A group of 120 rows, copies among them, meets in parts: all pairs once, in more than one task."""
    monkeypatch.setattr(match, "SAME", 4)
    monkeypatch.setattr(match, "PART", 16)
    rows = [(i, "n", 30.0 + i % 11, -100.0 + i % 7) for i in range(100)] + [(100 + i, "n", 1.0, 2.0) for i in range(20)] + [(200, None, 1.0, 2.0), (201, "alone", 1.0, 2.0), (202, "m", None, 2.0), (203, "m", 1.0, 2.0)]
    df = match.spans(spark.createDataFrame(rows, "id long, nation string, lat double, lon double"), "nation")
    got = {(r.a, r.b): r.km for r in df.collect()}
    spots = {i: (lat, lon) for i, _, lat, lon in rows}
    want = {(a, b): haversine(spots[a], spots[b]) for a in range(120) for b in range(a + 1, 120)}
    got.pop((202, 203))  # as in the SQL, least() leaves out what is null
    assert df.count() == len(want) + 1 and got.keys() == want.keys()
    assert all(abs(got[x] - want[x]) < 1e-5 for x in got)
    assert len({r.part for r in df.select(F.spark_partition_id().alias("part")).distinct().collect()}) > 1


def test_azimuths_of_copies(spark):
    """Sites and others with copies, at sites' own places too, with and without the clear radius reaching back to them."""
    sites = [(i, 40.0 + i % 3 * 0.3, -100.0 + i % 4 * 0.4) for i in range(60)] + [(99, None, 1.0), (98, -20.0, 5.0)]
    others = [(7, 40.3, -99.2), (8, 40.6, -100.3), (98, -20.0, 5.0), (None, 40.0, -100.0)] + [(i, 40.45, -99.5) for i in range(20)]
    to = lambda lat, lon, az, km: (lambda p, a, d: (lambda g: (math.degrees(g), lon + math.degrees(math.atan2(math.sin(a) * math.sin(d) * math.cos(p), math.cos(d) - math.sin(p) * math.sin(g)))))(math.asin(math.sin(p) * math.cos(d) + math.cos(p) * math.sin(d) * math.cos(a))))(math.radians(lat), math.radians(az), km / 6371)
    kind = "id long, lat double, lon double"
    for own, km, clear in ((others, 50.0, 40.0), (sites, 30.0, 35.0), (others, 10.0, 25.0)):
        df = match.free_azimuth(spark.createDataFrame(sites, kind), spark.createDataFrame(own, kind), km, clear)
        want = {}
        for i, lat, lon in sites:
            free = [az for az in range(0, 360, 15) if lat is None or not any(o is not None and a is not None and o != i and haversine(to(lat, lon, az, km), (a, b)) < clear for o, a, b in own)]
            want[i] = (free[0], True) if free else (0, False)
        assert {r.id: (r.azimuth, r.found) for r in df.collect()} == want
    # 60 sites at 12 places with 24 points each meet others by places: no join has sites times others
    assert rows_met(match.free_azimuth(spark.createDataFrame(sites, kind), spark.createDataFrame([(i, 40.45, -99.5) for i in range(500)], kind), 50.0, 40.0)) <= 24 * 14


@pytest.mark.parametrize("kind", ["ties", "clusters", "copies"])
def test_many_columns_same_as_all_pairs(spark, monkeypatch, kind):
    """Parts and blocks of a few rows, ties and copies: the same neighbours, and a row moves once for each part, not for each block."""
    monkeypatch.setattr(neighbours, "FEW", 2)
    monkeypatch.setattr(neighbours, "BLOCK", 48)
    monkeypatch.setattr(neighbours, "SQUARE", 128)
    monkeypatch.setattr(neighbours, "meetings", None)
    rows = table(kind)
    df = spark.createDataFrame(rows, "id long, region string, a double, b double, c double")
    got = {(r.id, r.rn): (r.vizinho, r.dist) for r in match.nearest(df, "id", "region", ["a", "b", "c"], 3).collect()}
    want = brute(rows, 3)
    assert got.keys() == want.keys() and got[2004, 1] == (2005, 0.0)
    assert all(abs(got[x][1] - want[x][1]) < 1e-6 and (got[x][0] == want[x][0] or kind == "ties") for x in got)


def test_closest_with_rounding_and_ties(monkeypatch):
    monkeypatch.setattr(neighbours, "BLOCK", 16)
    monkeypatch.setattr(neighbours, "TILE", 8)
    rng = np.random.default_rng(4)
    for x in (rng.integers(0, 3, size=(90, 4)).astype(float), 1e6 + rng.normal(size=(90, 20)) * 1e-3, np.zeros((40, 3))):
        for k in (1, 4, 30):
            q, m, d = neighbours.closest(x, x, k)
            full = np.zeros((len(x), len(x)))
            for c in range(x.shape[1]):
                full += (x[:, None, c] - x[None, :, c]) ** 2
            full = np.sqrt(full)
            order = np.argsort(full, axis=1, kind="stable")[:, :k]
            assert (q.reshape(-1, k) == np.arange(len(x))[:, None]).all() and (m.reshape(-1, k) == order).all()
            assert (d.reshape(-1, k) == np.take_along_axis(full, order, axis=1)).all()


def test_only_rows_within_the_bound_are_sorted(monkeypatch):
    """Places in few columns: the k nearest within bounds, with ties, and no sort over whole blocks."""
    rng = np.random.default_rng(6)
    x = np.concatenate((rng.integers(0, 4, size=(150, 3)), rng.normal(size=(150, 3))))
    full = np.sqrt(((x[:, None] - x[None]) ** 2).cumsum(axis=2)[:, :, -1])
    monkeypatch.setattr(np, "argsort", None)
    for k, bound in ((1, np.full(300, np.inf)), (4, np.where(np.arange(300) % 2, np.inf, 1.0)), (400, np.full(300, np.inf)), (3, np.zeros(300))):
        q, m, d = neighbours.best(x, x, k, bound)
        want = [(i, j) for i in range(300) for j in sorted(np.flatnonzero(full[i] <= bound[i] * (1 + neighbours.SLACK)), key=lambda j: (full[i, j], j))[:k]]
        assert list(zip(q, m)) == want and (d == full[q, m]).all()


def test_two_parts_meet_once(spark, monkeypatch):
    """A row moves once for each part of its group, not once to ask and once to be met, and every two parts meet in one task."""
    monkeypatch.setattr(neighbours, "SQUARE", 50)
    df = spark.createDataFrame([(i, i % 2, [float(i)], True) for i in range(400)], "id long, g int, v array<double>, asks boolean")
    dealt = neighbours.in_parts(df, "id")
    assert dealt.count() == 400 * 4 and dealt.select("g", "i", "j").distinct().count() == 2 * 10
    assert not dealt.where("i > j or (own <> i and own <> j)").count()
    found = neighbours._squares(df, "id", 3)
    assert found._jdf.queryExecution().optimizedPlan().toString().count("FlatMapCoGroups") == 0
