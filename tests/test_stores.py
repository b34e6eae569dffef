"""Raster files, the store of scenes, and the second stage's folds and errors."""

import struct
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from sitelens.operators import effects
from sitelens.sources import rasters as R
from sitelens.sources import store
from sitelens.sources.sink import write_files


def tiff(values, order, planar, deflate, rows, predictor=1, tile=False):
    """A file from an array (bands, height, width), written tag by tag."""
    bands, high, wide = values.shape
    kind = values.dtype.newbyteorder(order)
    strips = []
    for k in range(bands if planar == 2 else 1):
        for first in range(0, high, rows):
            own = values[k : k + 1, first : first + rows] if planar == 2 else values[:, first : first + rows]
            own = np.moveaxis(own, 0, 2).copy()
            if predictor == 2:
                own[:, 1:] -= own[:, :-1].copy()
            raw = own.astype(kind).tobytes()
            strips.append(zlib.compress(raw) if deflate else raw)
    code = {"u": 1, "i": 2, "f": 3}[values.dtype.kind]
    tags = [(256, 3, [wide]), (257, 3, [high]), (258, 3, [8 * values.dtype.itemsize] * bands), (259, 3, [8 if deflate else 1]), (273, 4, [0] * len(strips)), (277, 3, [bands]), (278, 3, [rows]), (279, 4, [len(s) for s in strips]), (284, 3, [planar]), (317, 3, [predictor]), (339, 3, [code] * bands)]
    tags += [(322, 3, [16])] if tile else []
    at = 8 + 2 + 12 * len(tags) + 4
    body, spots = b"", {}
    code_of = {3: "H", 4: "I"}
    for tag, kind_of, v in sorted(tags):
        raw = struct.pack(f"{order}{len(v)}{code_of[kind_of]}", *v)
        if len(raw) > 4:
            spots[tag] = at + len(body)
            body += raw
    starts, here = [], at + len(body)
    for s in strips:
        starts.append(here)
        here += len(s)
    out = struct.pack(f"{order}2sHIH", b"II" if order == "<" else b"MM", 42, 8, len(tags))
    for tag, kind_of, v in sorted(tags):
        v = starts if tag == 273 else v
        raw = struct.pack(f"{order}{len(v)}{code_of[kind_of]}", *v)
        out += struct.pack(f"{order}HHI", tag, kind_of, len(v)) + (struct.pack(f"{order}I", spots[tag]) if tag in spots else raw.ljust(4, b"\0"))
    out += bytes(4)
    for tag, kind_of, v in sorted(tags):
        if tag in spots:
            v = starts if tag == 273 else v
            out += struct.pack(f"{order}{len(v)}{code_of[kind_of]}", *v)
    return out + b"".join(strips)


@pytest.mark.parametrize("order,planar,deflate,kind,predictor", [("<", 1, True, "i2", 2), (">", 2, False, "u1", 1), (">", 1, True, "u2", 2), ("<", 2, True, "f4", 1)])
def test_files_of_other_makers(spark, tmp_path, order, planar, deflate, kind, predictor):
    values = (np.arange(2 * 11 * 7).reshape(2, 11, 7) * 37 % 250).astype(kind)
    (tmp_path / "a.tif").write_bytes(tiff(values, order, planar, deflate, 4, predictor))
    got = {(r.band, r.row, r.col): r.value for r in R.read_rasters(spark, str(tmp_path)).collect()}
    assert got == {(str(b + 1), r, c): float(values[b, r, c]) for b in range(2) for r in range(11) for c in range(7)}
    assert {r.band for r in R.read_rasters(spark, str(tmp_path), ["2"]).collect()} == {"2"}


def test_files_that_are_not_read_are_named(spark, tmp_path):
    (tmp_path / "bad.tif").write_bytes(b"hello there")
    with pytest.raises(Exception, match="bad.tif"):
        R.read_rasters(spark, str(tmp_path)).collect()
    (tmp_path / "bad.tif").write_bytes(tiff(np.zeros((1, 2, 2), "u1"), "<", 1, False, 2, tile=True))
    with pytest.raises(Exception, match="tiles"):
        R.read_rasters(spark, str(tmp_path)).collect()


@pytest.mark.parametrize("kind,nodata", [("<i2", -9999), ("u1", 0), ("<f4", None)])
def test_written_files_read_back(spark, tmp_path, kind, nodata):
    rows = [(s, r, c, (r * 7 + c) % 200 + 1, None if (r + c) % 5 == 0 else (c * 3) % 90 + 1) for s in ("s1", "s2") for r in range(130) for c in range(33) if not 64 <= r < 128 or s == "s1"]
    px = spark.createDataFrame(rows, "site string, row int, col int, a int, b int")
    grid = {"west": 100.0, "north": 900.0, "step": 10.0, "width": 33, "height": 130}
    write_files(R.encoded(px, ["site"], ["a", "b"], grid, 32723, kind, nodata), f"{tmp_path}/out")
    write_files(R.encoded(px, ["site"], ["a", "b"], grid, 32723, kind, nodata), f"{tmp_path}/out")
    got = R.read_rasters(spark, f"{tmp_path}/out").where("value is not null" + ("" if nodata is not None else " and value <> 0"))
    key = lambda p: p.rsplit("/", 1)[1][:-4]
    assert {(key(r.path), r.band, r.row, r.col): r.value for r in got.collect()} == {(s, b, r, c): float(v) for s, r, c, x, y in rows for b, v in (("a", x), ("b", y)) if v is not None}
    about = R.layout((tmp_path / "out" / "s1.tif").read_bytes())
    assert (about["bands"], about["west"], about["north"], about["epsg"], about["nodata"]) == (["a", "b"], 100.0, 900.0, 32723, nodata)
    first = got.where("row = 0 and col = 0").first()
    assert (first.x, first.y) == (105.0, 895.0)


def test_bands_apart_are_not_inflated(spark, tmp_path):
    """Of three bands apart only the wanted one's strips leave the first step."""
    (tmp_path / "a.tif").write_bytes(tiff(np.ones((3, 8, 5), "i2"), "<", 2, True, 4))
    content = (tmp_path / "a.tif").read_bytes()
    import pandas as pd

    cut = pd.concat(R._cut(["3"])(iter([pd.DataFrame({"path": ["p"], "content": [content]})])))
    assert cut["band"].tolist() == [2, 2] and cut["row0"].tolist() == [0, 4]


def test_pixel_beyond_the_grid(spark, tmp_path):
    px = spark.createDataFrame([("s", 5, 0, 1)], "site string, row int, col int, a int")
    with pytest.raises(Exception, match="beyond the grid"):
        R.encoded(px, ["site"], ["a"], {"west": 0.0, "north": 0.0, "step": 1.0, "width": 3, "height": 5}, 4326).collect()


def test_store_writes_what_is_new(spark, tmp_path):
    path = f"{tmp_path}/store"
    rows = [(s, site, y, i, float(i) if i else None) for s in ("s2", "landsat") for site in ("a", "b", None) for y in (2019, 2020) for i in range(3)]
    df = spark.createDataFrame(rows, "sensor string, site string, ano int, row int, v double")
    assert store.save_scenes(df, path).count() == 12
    before = {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")}
    assert store.save_scenes(df.repartition(7).select("v", "row", "ano", "site", "sensor"), path).count() == 0
    assert {p: p.stat().st_mtime_ns for p in (tmp_path / "store").rglob("*.parquet")} == before
    changed = df.withColumn("v", F.when((F.col("site") == "a") & (F.col("ano") == 2020) & (F.col("sensor") == "s2"), 9.0).otherwise(F.col("v")))
    assert [tuple(r)[:4] for r in store.save_scenes(changed, path).collect()] == [("s2", "a", 2020, 3)]
    after = {p for p in (tmp_path / "store").rglob("*.parquet")}
    assert all("site=a" in str(p) and "ano=2020" in str(p) for p in before.keys() - after) and store.save_scenes(changed, path).count() == 0
    assert sorted(map(str, map(tuple, store.read_scenes(spark, path).select(df.columns).collect()))) == sorted(map(str, map(tuple, changed.collect())))
    assert store.save_scenes(df.limit(0), f"{tmp_path}/none").count() == 0


def test_store_reads_only_what_is_wanted(spark, tmp_path):
    path = f"{tmp_path}/store"
    df = spark.range(400).select(F.concat(F.lit("s"), F.col("id") % 4).alias("sensor"), (F.col("id") % 5).cast("int").alias("site"), (F.col("id") % 3 + 2000).cast("int").alias("ano"), "id")
    store.save_scenes(df, path)
    wanted = spark.createDataFrame([("s1", 2001), ("s1", 2002)], "sensor string, ano int")
    got = store.read_scenes(spark, path, wanted)
    rows = got.collect()
    assert sorted(r.id for r in rows) == [i for i in range(400) if i % 4 == 1 and i % 3 in (1, 2)]
    scan = got._jdf.queryExecution().toString()
    assert "PartitionFilters: [" in scan and "PartitionFilters: []" not in scan.split("Physical Plan")[-1].split("Scan parquet")[-1] and "InSet" not in scan.split("DataFilters: [")[-1].split("]")[0]
    assert "sensor" in scan.split("PartitionFilters: [")[-1].split("]")[0] and "ano" in scan.split("PartitionFilters: [")[-1].split("DataFilters")[0]
    assert store.read_scenes(spark, path, wanted.limit(0)).count() == 0


def panel():
    rows = []
    for p in range(9):
        for h in (0, 1, 2):
            rows.append((f"p{p}", h, float(p), "north" if p % 2 else "south", 2.0 * p + h + (0.0 if p % 2 else 30.0)))
    return rows + [("p9", 0, None, None, 5.0), ("p9", 1, 4.0, "west", None), (None, 1, 4.0, "west", 3.0)]


@pytest.mark.parametrize("most", [64, 3])
def test_folds_and_naive_means(spark, most):
    df = spark.createDataFrame(panel(), "pair string, h int, porte double, regiao string, y double").where("y is not null")
    got = effects.naive(effects.folds(df, "pair", most), ["h"], "y").collect()
    place = {p: k for k, p in enumerate(sorted({r[0] for r in panel() if r[0]}))}
    rows = [r for r in panel() if r[0] and r[4] is not None]
    assert len(got) == len(rows)
    for r in got:
        others = [x[4] for x in rows if x[1] == r.h and place[x[0]] % most != r.fold]
        assert r.fold == place[r.pair] % most and abs(r.ingenuo - sum(others) / len(others)) < 1e-9


def test_left_out_pairs_and_repeats(spark):
    df = spark.createDataFrame(panel(), "pair string, h int, porte double, regiao string, y double").withColumn("none", F.lit(None).cast("double"))
    run = lambda: effects.left_out(df, ["h"], ["porte", "none"], ["regiao"], "y", "pair", 4, trees=15)
    one = sorted(map(tuple, run().select("pair", "h", "previsto", "ingenuo").collect()))
    assert one == sorted(map(tuple, run().select("pair", "h", "previsto", "ingenuo").collect())) and len(one) == 28 and all(x[2] is not None for x in one)
    told = {r.h: r for r in effects.errors(run(), ["h"], "y").collect()}
    assert all(told[h].erro < told[h].erro_ingenuo for h in (1, 2)) and {h: r.n for h, r in told.items()} == {0: 10, 1: 9, 2: 9}
    single = effects.left_out(df.where("pair = 'p1'"), ["h"], ["porte"], [], "y", "pair").collect()
    assert [(r.previsto, r.ingenuo) for r in single] == [(None, None)] * 3
