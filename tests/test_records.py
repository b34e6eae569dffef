"""Records, connectors, jobs, sinks and sensors on small rows, with their errors."""

import json

import pytest
from pyspark.sql import functions as F

from sitelens.functions import geo, text
from sitelens.operators import raster, records, storage
from sitelens.plans import jobs
from sitelens.sources import collections, connectors, files


def test_catalog_errors(spark):
    kind = "site_id string, sensor string, ano int, modelo_versao string, raster string"
    rows = spark.createDataFrame([("a", "s2", 2020, "v2", "t/1"), ("a", "landsat", 2019, "v2", "t/2"), ("b", "x", 2019, "v3", "t/3")], kind)
    assert [tuple(r) for r in files.catalog(rows, "v2").select("ano", "sensor", "sensor_token").collect()] == [(2019, "landsat", "landsat"), (2020, "sentinel2", "s2")]
    for version, found in (("v1", None), ("v3", None), ("v2", rows.where("ano = 2020").select("raster"))):
        with pytest.raises(ValueError):
            files.catalog(rows, version, rasters=found)


def test_sites_factors_parameters(spark, tmp_path):
    f = {"features": [{"properties": {"site_id": "a", "tier": "3", "ativo": True}, "geometry": {"type": "Point", "coordinates": [-46.0, -23.0]}}, {"properties": {"site_id": None}, "geometry": {"coordinates": [0.0, 0.0]}}]}
    (tmp_path / "s.json").write_text(json.dumps(f))
    with pytest.raises(ValueError, match="site_id"):
        files.sites(spark, str(tmp_path / "s.json"))
    found = files.sites(spark, str(tmp_path / "s.json"), required=())
    assert files.site(found, "a").lat == -23.0
    with pytest.raises(ValueError):
        files.site(found, "z")
    assert files.factors(spark, str(tmp_path / "none.json"), "v").count() == 0
    (tmp_path / "f.json").write_text(json.dumps({"modelo_versao": "v1", "fatores": [{"classe": 3, "tratamento": "b", "fator": 1.2}]}))
    assert files.factors(spark, str(tmp_path / "f.json"), "v1").count() == 1
    with pytest.raises(ValueError):
        files.factors(spark, str(tmp_path / "f.json"), "v2")
    (tmp_path / "p.json").write_text('{"a": 1}')
    assert files.parameters(str(tmp_path / "p.json")) == {"a": 1}
    with pytest.raises(FileNotFoundError, match="none"):
        files.parameters(str(tmp_path / "none.yml"))
    (tmp_path / "o.json").write_text(json.dumps({"elements": [{"geometry": [{"lat": 1.0, "lon": 2.0}], "tags": {"name": "x"}}]}))
    assert files.footprints(spark, str(tmp_path / "o.json")).first().tags == {"name": "x"}


def test_bands_manifest_and_replace(spark, tmp_path):
    rows = spark.createDataFrame([(1, 2, 3.0, 4.0), (1, 3, 5.0, None)], "row int, col int, red double, nir double")
    assert files.bands(rows, ["nir", "red"]).columns == ["row", "col", "nir", "red"]
    with pytest.raises(ValueError):
        files.bands(rows, ["nir", "red", "blue"])
    a, b = (files.manifest(x, ["row"], "v", "c", "t").first() for x in (rows, rows.orderBy(F.desc("col"))))
    assert a.sha256 == b.sha256 and json.loads(a.manifest)["n_linhas"] == 2
    assert files.manifest(rows.withColumn("red", F.lit(0.0)), ["row"], "v", "c", "t").first().sha256 != a.sha256
    path = str(tmp_path / "t")
    rows.write.parquet(path)
    files.replaced(spark.read.parquet(path).withColumn("new", F.lit(1)), path)
    assert spark.read.parquet(path).columns[-1] == "new" and spark.read.parquet(path).count() == 2


def test_connectors(spark):
    waits = []

    def fetch(k, seen={}):
        seen[k] = seen.get(k, 0) + 1
        if k == "bad" or seen[k] < 3:
            raise RuntimeError("Quota exceeded" if k != "no" else "other")
        return k * 2

    once = connectors.with_retries(fetch, 4, 0.5, connectors.over_quota, waits.append)
    assert [once(k) for k in ("a", "bad", "no")] == [("ok", "aa", 3), ("erro", None, 4), ("erro", None, 1)]
    assert waits == [0.5, 1.0, 0.5, 1.0, 2.0]
    keys = spark.createDataFrame([("x",), ("x",), (None,), ("y",)], "k string")
    assert sorted(tuple(r) for r in connectors.fetched(keys, "k", lambda k: k + "!", tries=1).collect()) == [("x", "ok", "x!", 1), ("y", "ok", "y!", 1)]
    c = json.dumps({"result": {"resources": [{"name": "b", "url": "u"}]}})
    r = spark.range(1).select(connectors.resource_url(F.lit(c), F.lit("b")).alias("a"), connectors.resource_url(F.lit(c), F.lit("z")).alias("b")).first()
    assert (r.a, r.b) == ("u", None)
    with pytest.raises(RuntimeError, match="SITELENS_NO_SUCH"):
        connectors.required_env("SITELENS_NO_SUCH")


def test_jobs(spark):
    stages = [("a", lambda x: x + 1), ("b", lambda x: x * 10), ("c", lambda x: x - 3)]
    assert jobs.run_stages(stages, 1) == 17 and jobs.run_stages(stages, 1, only=["b"]) == 10
    assert jobs.run_stages(stages, 1, done=["b"]) == -1 and jobs.run_stages(stages, 1, done=["b"], force=True) == 17
    with pytest.raises(ValueError):
        jobs.run_stages(stages, 1, only=["z"])
    assert jobs.limit_of(5, 3) == 5 and jobs.limit_of(None, 3) == 3 and jobs.limit_of(0, 3) == 0
    rows, code = jobs.each([1, 0], lambda k: 1 / k)
    assert code == 1 and [s for _, s, _ in rows] == ["ok", "erro"]
    df = spark.createDataFrame([(1,), (None,), (3,)], "v int")
    good, bad = jobs.failed_rows(df, F.col("v") > 1, "small")
    assert good.count() == 1 and bad.count() == 2
    assert jobs.dating_job(lambda: df, lambda s: True, lambda s: s.limit(1)).count() == 1
    with pytest.raises(ValueError):
        jobs.dating_job(lambda: df, lambda s: False, lambda s: s)
    assert jobs.label_source("dynamic_world") == ("labels-dw", raster.NINE_CLASSES) and jobs.label_source("mapbiomas")[0] == "labels"
    for args in (("dynamic_world", "vector"), ("other",)):
        with pytest.raises(ValueError):
            jobs.label_source(*args)


def test_records(spark):
    df = spark.createDataFrame([(0, "", False), (2, "x", True), (None, None, None)], "n int, s string, b boolean")
    kinds = {f.name: f.dataType for f in df.schema}
    assert [tuple(r) for r in df.select(*[records.truthy(F.col(c), kinds[c]) for c in df.columns]).collect()] == [(False,) * 3, (True,) * 3, (False,) * 3]
    assert records.column_after(df, "z", F.lit(1), "n").columns == ["n", "z", "s", "b"]
    r = spark.range(1).select(text.biome(F.lit(99)).alias("a"), text.biome(F.lit(None)).alias("b"), text.fips(F.lit("06037"))["condado"].alias("c"), text.padded("us-", F.lit(12345), 4).alias("d"), text.state_of(F.lit("Ohio")).alias("e")).first()
    assert tuple(r) == ("RESOLVE biome 99", None, "037", "us-12345", "OH")


def test_cells_miss_no_pair_anywhere(spark):
    import math
    import random

    rng = random.Random(5)
    spots = [(i, rng.choice([rng.uniform(-90, 90), rng.uniform(80, 90), rng.uniform(-1, 1)]), rng.choice([rng.uniform(-180, 180), rng.uniform(178, 180), rng.uniform(-180, -178)])) for i in range(400)]
    df = spark.createDataFrame(spots, "id long, lat double, lon double")

    def km(a, b):
        f, g, d = math.radians(a[1]), math.radians(b[1]), math.radians(b[2] - a[2])
        return 12742 * math.asin(min(1, math.sqrt(math.sin((g - f) / 2) ** 2 + math.cos(f) * math.cos(g) * math.sin(d / 2) ** 2)))

    for reach in (50.0, 900.0):
        near = geo.around(df, "lat", "lon", reach).join(geo.placed(df.selectExpr("id as b", "lat as y", "lon as x"), "y", "x", reach), ["cy", "cx"]).select("id", "b").collect()
        got = {tuple(r) for r in near}
        assert len(got) == len(near) and {(a[0], b[0]) for a in spots for b in spots if km(a, b) < reach} <= got


def test_numbers_and_series(spark):
    df = spark.createDataFrame([(i * 7 % 50,) for i in range(50)], "k long").repartition(5)
    assert all(r.place == r.k for r in storage.numbered(df, ["k"]).collect())
    assert storage.numbered(df.where("false"), ["k"]).count() == 0
    f = lambda s, y, t, v: tuple(spark.range(1).select(*raster.series_band(F.lit(s), F.lit(y), F.lit(t), F.lit(v).cast("double"))).first())
    assert f("sentinel2", 2010, "b", 1.2) == (1.0, "sentinel2_oficial_2019_2025") and f("landsat", 2020, "b", 1.2) == (1.0, "landsat_overlap_referencia")
    assert f("landsat", 2018, "b", 1.2) == (1.2, "landsat_pre2019_corrigido_sv20") and f("landsat", 2018, "c", 1.2) == (1.0, "landsat_pre2019_nao_corrigido") and f("landsat", 2018, "b", None)[0] == 1.0
    px = spark.createDataFrame([(0.1, 0.2, 0.3, 0.5, 0.4, 0.2), (0.1, 0.2, 0.3, 0.5, None, 0.2)], "blue double, green double, red double, nir double, swir1 double, swir2 double")
    a, b = raster.indices(px).collect()
    assert abs(a.evi - 2.5 * 0.2 / (0.5 + 1.8 - 0.75 + 1)) < 1e-12 and abs(a.ndmi - 0.1 / 0.9) < 1e-12 and b.ndvi is None
    assert collections.exact_or_newest(spark.createDataFrame([("a", 2018, 1), ("a", 2020, 2), ("b", 2017, 3)], "g string, y int, v int"), "g", "y", 2020, ["v"]).count() == 2
