import math
import random

import pytest
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.functions import values as V
from sitelens.operators import graph, impact, match, nested, raster
from sitelens.sources import files
from sitelens.sources.report import Report


def test_baseline_falls_back_to_first_year(spark):
    p = spark.createDataFrame([("a", -3, 1.0), ("a", -1, 2.0), ("a", 2, 9.0), ("b", 1, 5.0), ("b", 4, 6.0)], "site string, h int, v double")
    assert {r.site: (r.base_h, r.base_v) for r in impact.baseline(p, ["v"]).collect()} == {"a": (-1, 2.0), "b": (1, 5.0)}


def test_change_point_equals_brute_force(spark):
    rng = random.Random(3)
    rows = [(e, y, None if rng.random() < 0.15 else round(rng.random(), 3)) for e in range(30) for y in range(2013, 2013 + rng.randint(2, 12))]
    got = {r.e: (r.ano_degrau, r.degrau) for r in impact.change_points(spark.createDataFrame(rows, "e int, y int, v double"), "e", "y", "v", 2, 0.1).collect()}
    for e in range(30):
        own = [(y, v) for k, y, v in rows if k == e and v is not None]
        best = None
        for t in range(2, len(own) - 1):
            d = sum(v for _, v in own[t:]) / (len(own) - t) - sum(v for _, v in own[:t]) / t
            if best is None or d > best[1] + 1e-12:
                best = own[t][0], d
        if best is None:
            assert got[e] == (None, None)
        else:
            assert math.isclose(got[e][1], best[1], abs_tol=1e-9)
            assert got[e][0] == (best[0] if best[1] >= 0.1 else None)


def test_constant_column_has_no_correlation(spark):
    df = spark.createDataFrame([(1.0, 2.0), (2.0, 2.0), (None, 5.0)], "a double, b double")
    assert {(r.a, r.b): r.r for r in impact.correlations(df, ["a", "b"]).collect()}[("a", "b")] is None


def test_components_of_a_long_chain_and_a_cycle(spark):
    edges = [(i, i + 1) for i in range(1, 40)] + [(100, 101), (101, 102), (102, 100)]
    got = {r.id: r.component for r in graph.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert set(got.values()) == {1, 100} and got[40] == 1 and got[102] == 100


@pytest.mark.parametrize("few", [1 << 17, 0])
@pytest.mark.parametrize("kind", ["long", "string"])
def test_components_against_brute_force(spark, monkeypatch, few, kind):
    """By the driver's pass and by stars: chains, cycles, a hub, repeated links, loops, nulls; ids of numbers and of texts."""
    monkeypatch.setattr(graph, "FEW", few)
    rng = random.Random(4)
    edges = [(i, i + 1) for i in range(0, 60)] + [(200 + i, 200 + (i + 1) % 30) for i in range(30)] + [(300, 300 + i) for i in range(50)] + [(rng.randrange(400, 600), rng.randrange(400, 600)) for _ in range(90)] + [(700, 700), (5, 5), (0, 1), (1, 0)]
    ids = (lambda x: x) if kind == "long" else (lambda x: f"n{x:04d}")
    rows = [(ids(a), ids(b)) for a, b in edges] + [(None, ids(1)), (ids(2), None)]
    root = {ids(x): ids(x) for e in edges for x in e}
    for _ in range(len(root)):
        for a, b in rows[:-2]:
            root[a] = root[b] = min(root[a], root[b])
    df = spark.createDataFrame(rows, f"a {kind}, b {kind}").repartition(5)
    got = [tuple(r) for r in graph.components(df).collect()]
    assert len(got) == len(root) and dict(got) == root
    assert graph.components(df.limit(0)).columns == ["id", "component"] and not graph.components(df.limit(0)).collect()


def test_geo_round_trip(spark):
    lat, lon = geo.destination(F.lit(40.0), F.lit(-75.0), F.lit(12.0), F.lit(77.0))
    r = spark.range(1).select(lat.alias("a"), lon.alias("o")).select(geo.haversine(F.lit(40.0), F.lit(-75.0), F.col("a"), F.col("o")).alias("d"), geo.bearing(F.lit(40.0), F.lit(-75.0), F.col("a"), F.col("o")).alias("b"), geo.cell(F.lit(-0.03), 0.02).alias("c")).first()
    assert abs(r.d - 12) < 1e-9 and abs(r.b - 77) < 1e-6 and r.c == -1


def test_thinning_is_greedy(spark):
    df = spark.createDataFrame([(1, 0.0, 0.0), (2, 0.0, 0.1), (3, 0.0, 1.0), (4, 0.0, 1.1)], "id long, lat double, lon double")
    assert [r.id for r in match.thinned(df, F.col("id"), 50.0, 5).orderBy("place").collect()] == [1, 3]


def test_merge_page_and_address(spark):
    df = spark.sql("select named_struct('a', 1, 'b', named_struct('x', 'p', 'y', 'q')) s, named_struct('a', cast(null as int), 'b', named_struct('x', cast(null as string), 'y', 'z')) t")
    m = df.select(nested.deep_merge(F.col("s"), F.col("t"), df.schema["s"].dataType).alias("m")).first().m
    assert (m.a, m.b.x, m.b.y) == (1, "p", "z")
    html = '<script id="__NEXT_DATA__" type="x">{"props":{"pageProps":{"pageId":"rate-limited"}}}</script>'
    got = spark.createDataFrame([(html,), ("<p>",), ('<script id="__NEXT_DATA__">{bad</script>',)], "h string").select(nested.rate_limited(nested.page_props(F.col("h"))).alias("b")).collect()
    assert [r.b for r in got] == [True, False, False]
    parts = spark.sql("select array(named_struct('types', array('locality'), 'long_name', 'L', 'short_name', 'l')) p").select(nested.municipality(F.col("p")).alias("m")).first()
    assert parts.m == "L"


def test_indices_are_null_together(spark):
    rows = [(0.1, 0.2, 0.3, 0.4, 0.5, 0.6), (0.1, 0.2, 0.0, 0.0, 0.5, 0.6), (None, 0.2, 0.3, 0.4, 0.5, 0.6)]
    got = raster.indices(spark.createDataFrame(rows, ", ".join(f"{b} double" for b in raster.BANDS))).collect()
    assert abs(got[0].ndvi - 0.1 / 0.7) < 1e-12 and got[1].ndbi is None and got[2].ndvi is None


def test_indices_are_the_reference_s_seven(spark):
    rows = [(0.1, 0.2, 0.3, 0.4, 0.5, 0.6), (0.24, 0.2, 0.1, 0.3, 0.5, 0.6), (0.2, 0.2, 0.1, 0.4, 0.5, -0.4), (0.4, 0.2, 0.1, 1.6, 0.5, 0.6)]
    got = raster.indices(spark.createDataFrame(rows, ", ".join(f"{b} double" for b in raster.BANDS))).collect()
    assert set(got[0].asDict()) == {*raster.BANDS, "ndvi", "evi", "ndwi", "mndwi", "ndbi", "bsi", "ndmi"}
    assert abs(got[0].evi - 2.5 * 0.1 / 2.45) < 1e-12 and abs(got[0].ndmi + 0.1 / 0.9) < 1e-12
    assert got[2].ndvi is not None and got[3].evi == 2.5
    flat = raster.indices(spark.createDataFrame([((0.4 + 0.6 + 1) / 7.5, 0.2, 0.1, 0.4, 0.5, 0.6)], ", ".join(f"{b} double" for b in raster.BANDS))).first()
    assert flat.evi is None and flat.ndvi is None


def test_snow_and_ice_is_water():
    """The table remaps.dynamic_world of the reference's classes.yml."""
    assert raster.NINE_CLASSES == {0: 5, 1: 1, 2: 2, 3: 5, 4: 2, 5: 2, 6: 4, 7: 3, 8: 5}


def test_values(spark):
    r = spark.range(1).select(V.fold(F.lit("São José")).alias("f"), V.scaled_short(F.lit(0.00025)).alias("s"), V.scaled_short(F.lit(None).cast("double")).alias("n"), V.rgb(F.lit("#0a10ff")).alias("c"), V.pair_quality(F.lit(0.2)).alias("q")).first()
    assert (r.f, r.s, r.n, r.c, r.q) == ("sao jose", 2, -9999, [10, 16, 255], "aceitavel")


def test_files(spark, tmp_path):
    (tmp_path / "a.csv").write_bytes("﻿nome;cidade\nx;São Paulo\n;\n".encode())
    assert [tuple(r) for r in files.row_dicts(spark, str(tmp_path / "a.csv"), ";").collect()] == [("x", "São Paulo"), ("", "")]
    (tmp_path / "b.csv").write_bytes("nome;cidade\nx;São Paulo\n".encode("latin1"))
    assert files.csv(spark, str(tmp_path / "b.csv"), ";", "ISO-8859-1").first().cidade == "São Paulo"
    (tmp_path / "d").mkdir()
    (tmp_path / "d" / "k1.json").write_text('{"status": "ok", "tentativas": 2, "dados": {"x": 1}}')
    (tmp_path / "d" / "k2.json").write_text("{broken")
    got = {r.chave: (r.status, r.dados and r.dados.x) for r in files.documents(spark, str(tmp_path / "d"), "struct<x:int>").collect()}
    assert got == {"k1": ("ok", 1), "k2": (None, None)}
    (tmp_path / "s.json").write_text('{"features": [{"properties": {"site_id": "a", "ativo": true}, "geometry": {"type": "Point", "coordinates": [1.5, 2.5]}}]}')
    r = files.sites(spark, str(tmp_path / "s.json")).first()
    assert (r.lat, r.lon, r.buffer_km) == (2.5, 1.5, 5.0)


def test_report_cuts_tables(spark):
    rep = Report("<t>", rows=2)
    rep.table(spark.range(3))
    assert "First 2 rows" in rep.render() and "&lt;t&gt;" in rep.render()
