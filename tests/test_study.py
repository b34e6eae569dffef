"""Thinning, joins in time and by name, lookups, and small sources and sinks."""

import datetime as dt
import json
import math
import random

import pytest
from pyspark.sql import functions as F

from sitelens.functions import text as X
from sitelens.functions import values as V
from sitelens.functions.values import pair_key
from sitelens.operators import match, records
from sitelens.plans import registry, table_queries  # noqa: F401
from sitelens.sources import collections as C
from sitelens.sources import files


def km(a, b):
    p, q, l = math.radians(a[0]), math.radians(b[0]), math.radians(b[1] - a[1])
    return 2 * 6371.0 * math.asin(math.sqrt(min(1.0, math.sin((q - p) / 2) ** 2 + math.cos(p) * math.cos(q) * math.sin(l / 2) ** 2)))


def greedy(rows, far, most=None):
    kept = []
    for i, lat, lon in rows:
        if lat is not None and lon is not None and all(km((lat, lon), (a, b)) >= far for _, a, b in kept):
            kept.append((i, lat, lon))
    return [k[0] for k in kept[:most]]


def test_thinning_of_crowds(spark):
    """Half of the rows at one place, others along a line and around a pole and the date line."""
    rng = random.Random(2)
    spots = [(10.0, 20.0)] * 300 + [(rng.uniform(-1, 1), rng.uniform(0, 3)) for _ in range(200)] + [(0.0, 40 + k / 10) for k in range(60)] + [(rng.uniform(86, 90), rng.uniform(-180, 180)) for _ in range(60)] + [(5.0, s * (180 - k / 20)) for k in range(12) for s in (1, -1)] + [(None, 1.0), (1.0, None)]
    rng.shuffle(spots)
    df = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate(spots)], "id long, lat double, lon double")
    for most in (None, 7):
        got = match.thinned(df, F.lit(0), 30.0, most).orderBy("place").collect()
        assert [r.id for r in got] == greedy([(i, a, b) for i, (a, b) in enumerate(spots)], 30.0, most) and [r.place for r in got] == list(range(len(got)))


def test_thinning_takes_few_rounds(spark, monkeypatch):
    written = []
    monkeypatch.setattr(match, "settle", lambda df, f=match.settle: (written.append(1), f(df))[1])
    rng = random.Random(8)
    rows = [(i, rng.uniform(0, 4), rng.uniform(0, 4)) for i in range(1200)]
    got = match.thinned(spark.createDataFrame(rows, "id long, lat double, lon double"), F.lit(1), 20.0).orderBy("place").collect()
    assert [r.id for r in got] == greedy(rows, 20.0) and len(written) <= 1 + 3 * 12
    assert not match.thinned(spark.createDataFrame([], "id long, lat double, lon double"), F.col("id"), 5.0).collect()


def test_nearest_in_time(spark):
    """One key with most rows, equal times, ties on both sides, keys without values, nulls; every row once."""
    rng = random.Random(3)
    day = dt.datetime(2020, 1, 1)
    at = lambda k: day + dt.timedelta(minutes=k)
    rows = [(i, rng.choice("hhhhab"), at(rng.randint(0, 400))) for i in range(400)] + [(500, None, at(3)), (501, "h", None), (502, "none", at(5)), (503, "h", at(7)), (503, "h", at(7))]
    others = [(rng.choice("hhhab"), at(rng.randint(0, 400)), rng.random()) for _ in range(120)] + [("h", at(100), 0.1), ("h", at(100), 0.9), (None, at(1), 0.5), ("h", at(1), None), ("z", at(1), 0.3)]
    left = spark.createDataFrame(rows, "id long, k string, ts timestamp").withColumns({"v": F.lit(1), "part": F.lit("x")}).repartition(5)
    right = spark.createDataFrame(others, "k string, ts timestamp, s double")
    got = C.nearest_in_time(left, right, "k", "ts", "s").collect()
    assert len(got) == len(rows)
    for r in got:
        own = [(abs((r.ts - t).total_seconds()) * 1e6, -s) for k, t, s in others if r.k is not None and r.ts is not None and k == r.k and s is not None]
        assert (r._gap, r._near) == ((min(own)[0], -min(own)[1]) if own else (None, None))
    kept = C.cloud_scored(left, right, "k", "ts", "s", 0.5, 1)
    assert kept.columns == ["id", "k", "ts", "v", "part", "cs_cdf"] and kept.where("id = 503").count() in (0, 2)
    assert not C.nearest_in_time(left.limit(0), right, "k", "ts", "s").collect() and C.nearest_in_time(left, right.limit(0), "k", "ts", "s").where("_near is not null").count() == 0


def test_one_key_makes_no_pairs(spark):
    """4000 rows and 4000 values of one key within an hour: the plan has no join by key, and only rows come out."""
    df = spark.range(4000).select(F.lit("k").alias("k"), F.timestamp_seconds(F.col("id") % 3600).alias("ts"), F.col("id").alias("v"))
    got = C.nearest_in_time(df, df, "k", "ts", "v")
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan and got.count() == 4000 and got.where("_gap <> 0").count() == 0


def test_name_join(spark):
    rows = spark.createDataFrame([(1, "São José", "SC"), (2, "sao jose ", "SP"), (3, "Nowhere", "SP"), (4, None, "SP"), (5, "", "SP"), (6, "São José", None), (1, "São José", "SC")], "id long, nome string, uf string")
    places = spark.createDataFrame([("SAO JOSE", "SC", 10), ("São José", "SP", 20), ("Sao Jose", "SP", 15), (None, "SP", 1), ("", "SP", 2)], "nome string, uf string, codigo int")
    got = sorted((r.id, r.codigo, r.found) for r in records.name_join(rows, places, "nome", "uf", ["codigo"]).collect())
    assert got == [(1, 10, True), (1, 10, True), (2, 15, True), (3, None, False), (4, None, False), (5, None, False), (6, None, False)]


def test_population_and_states(spark):
    df = spark.createDataFrame([("EUA", "9", "5", None), ("EUA", None, "5", "x"), ("EUA", "", "", None), ("Brasil", "9", "7", " Estimativa "), ("Brasil", None, "7", ""), ("Brasil", None, " ", "x"), (None, None, None, None)], "pais string, acs string, pop string, est string")
    pop, label = X.population_source(F.col("pais"), F.col("acs"), F.col("pop"), F.col("est"), 2022)
    assert [tuple(r) for r in df.select(pop, label).collect()] == [("9", "ACS 2022 5-year (condado)"), ("5", ""), ("", ""), ("7", "Estimativa"), ("7", "IBGE (municipio)"), (" ", ""), (None, "")]
    codes = spark.createDataFrame([("36061", "Ohio"), ("99999", "Atlantis"), ("3606", None)], "c string, n string")
    got = codes.select(X.state_of(county=F.col("c")).alias("a"), X.state_of(F.col("n")).alias("b")).withColumn("r", X.census_region(F.col("a"))).collect()
    assert [tuple(r) for r in got] == [("NY", "OH", "Northeast"), ("", "", ""), ("", "", "")]
    assert len(set(X.STATES.values())) == len(X.STATES) == len(X.STATE_NUMBERS) == sum(map(len, X.REGIONS.values())) == 51
    pairs = spark.createDataFrame([("t", ""), ("t", None), ("c", "t")], "site string, com string")
    assert {r[0] for r in pairs.select(pair_key(F.col("com"), F.col("site"))).collect()} == {"t"}


def test_files_by_name_csv_and_documents(spark, tmp_path):
    for name, body in (("lst_a-b_2019.json", "{}"), ("lst_c_2020.json", "[1]\n2"), ("other.txt", "x")):
        (tmp_path / name).write_text(body)
    got = files.keyed_by_name(spark, str(tmp_path), "lst_", "(?:_[0-9]{4})?[.]json").collect()
    assert [tuple(r) for r in got] == [("a-b", 2019, "{}"), ("c", 2020, "[1]\n2")]
    df = spark.createDataFrame([("é;x", 1), (None, 2)], "a string, b int")
    files.write_csv(df, f"{tmp_path}/out", ";")
    assert sorted(map(str, map(tuple, spark.read.option("header", True).option("sep", ";").csv(f"{tmp_path}/out").collect()))) == ["('é;x', '1')", "(None, '2')"]
    old = spark.createDataFrame([("k", "ok", 2, "d"), ("l", "ok", 1, "e")], "chave string, status string, tentativas int, dados string")
    new = spark.createDataFrame([("k", "bloqueado", "f"), ("m", "ok", "g")], "chave string, status string, dados string")
    assert sorted((r.chave, r.status, r.tentativas, r.dados) for r in files.upserted(old, new, "chave").collect()) == [("k", "bloqueado", 3, "f"), ("l", "ok", 1, "e"), ("m", "ok", 1, "g")]
    point = spark.createDataFrame([(1.5, -2.0, "n")], "lat double, lon double, nome string")
    assert json.loads(point.select(files.geojson(point, "lat", "lon")).first()[0]) == {"type": "Feature", "geometry": {"type": "Point", "coordinates": [-2.0, 1.5]}, "properties": {"nome": "n"}}


def test_tabs_of_records(spark):
    rec = spark.createDataFrame([("a",), ("b",), ("c",), (None,)], "chave string")
    docs = spark.createDataFrame([("a", "overview", "ok", "1"), ("a", "specs", "bloqueado", "2"), ("b", "specs", "ok", "3"), ("a", "overview", "erro", "9")], "chave string, aba string, status string, dados string")
    got = sorted(map(str, map(tuple, records.tabs(rec, docs).collect())))
    assert got == sorted(map(str, [("a", "ok", "bloqueado", "1", None), ("b", "ausente", "ok", None, "3"), ("c", "ausente", "ausente", None, None), (None, "ausente", "ausente", None, None)]))


def test_catalog_of_a_sensor_and_year(spark):
    import pytest

    found = spark.createDataFrame([("a", s, y, "v1", f"{s}/{y}.tif", "x") for s in ("s2", "landsat") for y in (2019, 2020)], files.MANIFEST)
    assert [(r.sensor, r.sensor_token, r.ano) for r in files.catalog(found, "v1", sensor="s2").collect()] == [("sentinel2", "s2", 2019), ("sentinel2", "s2", 2020)]
    assert files.catalog(found, "v1", sensor="landsat", year=2020).count() == 1
    with pytest.raises(ValueError, match="unknown sensor s9"):
        files.catalog(found, "v1", sensor="s9")
    with pytest.raises(ValueError, match="no manifest"):
        files.catalog(found, "v1", year=1990)


@pytest.mark.parametrize("sep,encoding,mark", [(",", "UTF-8", ""), (";", "UTF-8", chr(0xFEFF)), (";", "ISO-8859-1", "")])
def test_csv_is_written_in_parts(spark, tmp_path, sep, encoding, mark):
    df = spark.range(40, numPartitions=4).select(F.col("id").alias(f"{mark}id"), F.concat(F.lit("é;,"), "id").alias("t"))
    files.write_csv(df, f"{tmp_path}/out", sep, encoding)
    back = files.csv(spark, f"{tmp_path}/out", sep, encoding)
    assert len(back.inputFiles()) == 4
    assert sorted(map(tuple, back.collect())) == sorted((str(k), f"é;,{k}") for k in range(40))


def test_words_are_folded_without_a_join(spark, tmp_path):
    """Keys equal those of the words folded one by one and joined with the distinct keys, and no row moves."""
    texts = ["Ação  ação ACAO ", " ñandú 日本 x😀y Ünïcode\tß", "", None, "É", "日本 é ", "İK ς Σ. ÀB"]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(f"{tmp_path}/documents.parquet")
    df = registry.queries()["accent_fold_join"](spark, str(tmp_path))
    w = spark.read.parquet(f"{tmp_path}/documents.parquet").select("doc_id", F.explode(F.split("text", " ")).alias("palavra")).withColumn("chave", V.fold(F.col("palavra")))
    want = w.join(w.select("chave").where("chave <> ''").distinct(), "chave").select("chave", "doc_id", "palavra")
    assert sorted(map(tuple, df.collect())) == sorted(map(tuple, want.collect())) != []
    assert "Exchange" not in df._jdf.queryExecution().executedPlan().toString()
