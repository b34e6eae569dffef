"""Raster files (TIFF with geographic tags) as pixel tables, and pixel tables as raster files.

Reading: Spark reads the files' bytes, whatever store they are in; their strips become rows of their own, are dealt out, and each is inflated where it lands. Only the
strips of the bands asked for move where bands lie apart. Writing: each strip of each image is deflated in a task of its own; a file is
put together from its compressed strips, for sink.write_files.

Classic TIFF in strips, 8 to 32 bit whole numbers and 32 or 64 bit floats, either byte order, deflate or none, predictor 1 or 2, bands by pixel or apart. Tiles, other
compressions and 64-bit offsets are errors that name the file.
"""

from __future__ import annotations

import json
import re
import struct
import zlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.operators.storage import workers_find_package

# Numbers of the format's tags and of its types with their sizes and codes.
WIDTH, HEIGHT, BITS, COMPRESSION, PHOTOMETRIC, OFFSETS, SAMPLES, STRIP_ROWS, COUNTS, PLANAR, PREDICTOR, TILES, FORMAT = 256, 257, 258, 259, 262, 273, 277, 278, 279, 284, 317, 322, 339
PIXEL_SCALE, TIEPOINT, GEO_KEYS, METADATA, NODATA = 33550, 33922, 34735, 42112, 42113
TYPES = {1: (1, "B"), 2: (1, "s"), 3: (2, "H"), 4: (4, "I"), 6: (1, "b"), 8: (2, "h"), 9: (4, "i"), 11: (4, "f"), 12: (8, "d")}
KINDS = {1: "u", 2: "i", 3: "f"}
ROWS = 64


def tags(data: bytes) -> tuple[str, dict[int, tuple]]:
    """Byte order and the first image's tags."""
    order = {b"II": "<", b"MM": ">"}.get(data[:2])
    if order is None or struct.unpack(f"{order}H", data[2:4])[0] != 42:
        raise ValueError("no classic TIFF")
    at = struct.unpack(f"{order}I", data[4:8])[0]
    found = {}
    for k in range(struct.unpack(f"{order}H", data[at : at + 2])[0]):
        spot = at + 2 + 12 * k
        tag, kind, n = struct.unpack(f"{order}HHI", data[spot : spot + 8])
        if kind not in TYPES:
            continue
        size, code = TYPES[kind]
        start = spot + 8 if size * n <= 4 else struct.unpack(f"{order}I", data[spot + 8 : spot + 12])[0]
        raw = data[start : start + size * n]
        found[tag] = (raw.rstrip(b"\0").decode("utf-8", "replace"),) if code == "s" else struct.unpack(f"{order}{n}{code}", raw)
    return order, found


def layout(data: bytes) -> dict:
    """What is needed to read an image's strips: size, bands (names), numpy type, no-data value, transform and place of each strip."""
    order, t = tags(data)
    one = lambda tag, default=None: t.get(tag, (default,))[0]
    if TILES in t or one(COMPRESSION, 1) not in (1, 8, 32946) or one(PREDICTOR, 1) not in (1, 2):
        raise ValueError("tiles, or a compression or predictor that is not read")
    n, bits, width, height = one(SAMPLES, 1), one(BITS, 1), one(WIDTH), one(HEIGHT)
    kind = f"{order}{KINDS[one(FORMAT, 1)]}{bits // 8}"
    if bits not in (8, 16, 32, 64) or len(set(t.get(BITS, (bits,)))) > 1:
        raise ValueError("bits that are not read")
    names = dict(re.findall(r'sample="(\d+)" role="description"[^>]*>([^<]*)<', one(METADATA, "") or ""))
    rows = min(one(STRIP_ROWS, height) or height, height)
    per = -(-height // rows)
    apart = one(PLANAR, 1) == 2
    strips = [(k // per if apart else -1, k % per * rows, min(rows, height - k % per * rows), at, size) for k, (at, size) in enumerate(zip(t[OFFSETS], t[COUNTS]))]
    none = one(NODATA)
    scale, tie = t.get(PIXEL_SCALE, (1.0, 1.0, 0.0)), t.get(TIEPOINT, (0.0,) * 6)
    keys = t.get(GEO_KEYS, ())
    epsg = next((keys[k + 3] for k in range(4, len(keys), 4) if keys[k] in (2048, 3072)), None)
    return {"width": width, "height": height, "bands": [names.get(str(k), str(k + 1)) for k in range(n)], "kind": kind, "deflated": one(COMPRESSION, 1) != 1, "predictor": one(PREDICTOR, 1), "nodata": None if none is None else float(none), "west": tie[3] - tie[0] * scale[0], "north": tie[4] + tie[1] * scale[1], "step": scale[0], "epsg": epsg, "strips": strips}


def strip(data: bytes, about: dict, band: int, rows: int) -> np.ndarray:
    """The values of a strip, (rows, width, bands in it)."""
    own = 1 if band >= 0 else len(about["bands"])
    raw = zlib.decompress(data) if about["deflated"] else data
    values = np.frombuffer(raw, about["kind"], rows * about["width"] * own).reshape(rows, about["width"], own)
    return np.cumsum(values, axis=1, dtype=values.dtype) if about["predictor"] == 2 else values


def _cut(bands: list[str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for path, content in zip(batch["path"], batch["content"]):
                try:
                    about = layout(content)
                except (ValueError, KeyError, struct.error, TypeError) as wrong:
                    raise ValueError(f"{path}: {wrong}") from wrong
                wanted = [s for s in about.pop("strips") if bands is None or s[0] < 0 or about["bands"][s[0]] in bands]
                told = json.dumps(about)
                yield pd.DataFrame([(path, told, *s[:3], content[s[3] : s[3] + s[4]]) for s in wanted], columns=["path", "about", "band", "row0", "rows", "data"])

    return run


def _spread(bands: list[str] | None):
    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for s in batch.itertuples():
                about = json.loads(s.about)
                values = strip(s.data, about, s.band, s.rows)
                for k in range(values.shape[2]):
                    name = about["bands"][s.band if s.band >= 0 else k]
                    if bands is None or name in bands:
                        v = values[:, :, k].ravel().astype(float)
                        row, col = np.divmod(np.arange(len(v)), about["width"])
                        yield pd.DataFrame({"path": s.path, "band": name, "row": (row + s.row0).astype(np.int32), "col": col.astype(np.int32), "value": np.where(v == about["nodata"], np.nan, v) if about["nodata"] is not None else v, "x": about["west"] + (col + 0.5) * about["step"], "y": about["north"] - (row + s.row0 + 0.5) * about["step"]})

    return run


def read_rasters(spark: SparkSession, path: str, bands: list[str] | None = None) -> DataFrame:
    """Pixels of all raster files under path: path, band (its description, else its number), row, col, value (null for no data), x and y (of the centre).

    With bands, only those are inflated where they lie apart. A folder without files gives no rows; a file that is no raster is an error that names it.
    """
    workers_find_package(spark)
    files = spark.read.format("binaryFile").option("pathGlobFilter", "*.tif").option("recursiveFileLookup", True).load(path).select("path", "content")
    strips = files.mapInPandas(_cut(bands), "path string, about string, band int, row0 int, rows int, data binary")
    pixels = strips.repartition("path", "band", "row0").mapInPandas(_spread(bands), "path string, band string, row int, col int, value double, x double, y double")
    return pixels.withColumn("value", F.when(~F.isnan("value"), F.col("value")))


def assembled(width: int, height: int, bands: list[str], kind: str, nodata: float | None, west: float, north: float, step: float, epsg: int, strips: list[bytes], rows: int) -> bytes:
    """A file from its deflated strips, band by band."""
    n, code = len(bands), {"u": 1, "i": 2, "f": 3}[np.dtype(kind).kind]
    told = "<GDALMetadata>" + "".join(f'<Item name="DESCRIPTION" sample="{k}" role="description">{b}</Item>' for k, b in enumerate(bands)) + "</GDALMetadata>\0"
    text = lambda s: (2, len(s), s.encode())
    longs = lambda v: (4, len(v), struct.pack(f"<{len(v)}I", *v))
    shorts = lambda *v: (3, len(v), struct.pack(f"<{len(v)}H", *v))
    doubles = lambda *v: (12, len(v), struct.pack(f"<{len(v)}d", *v))
    degrees = 4000 <= epsg < 5000
    own = {
        WIDTH: longs([width]), HEIGHT: longs([height]), BITS: shorts(*[8 * np.dtype(kind).itemsize] * n), COMPRESSION: shorts(8), PHOTOMETRIC: shorts(1), OFFSETS: longs([0] * len(strips)), SAMPLES: shorts(n), STRIP_ROWS: longs([rows]), COUNTS: longs(list(map(len, strips))),
        PLANAR: shorts(2 if n > 1 else 1), PREDICTOR: shorts(2 if code < 3 else 1), FORMAT: shorts(*[code] * n), PIXEL_SCALE: doubles(step, step, 0.0), TIEPOINT: doubles(0.0, 0.0, 0.0, west, north, 0.0),
        GEO_KEYS: shorts(1, 1, 0, 3, 1024, 0, 1, 2 if degrees else 1, 1025, 0, 1, 1, 2048 if degrees else 3072, 0, 1, epsg), METADATA: text(told),
    }
    if nodata is not None:
        own[NODATA] = text(f"{nodata:g}\0")
    at = 8 + 2 + 12 * len(own) + 4
    place = {}
    for tag, (_, _, raw) in sorted(own.items()):
        if len(raw) > 4:
            place[tag] = at
            at += len(raw) + len(raw) % 2
    starts = []
    for s in strips:
        starts.append(at)
        at += len(s)
    own[OFFSETS] = longs(starts)
    out = bytearray(struct.pack("<2sHIH", b"II", 42, 8, len(own)))
    for tag, (kind_of, count, raw) in sorted(own.items()):
        out += struct.pack("<HHI", tag, kind_of, count) + (struct.pack("<I", place[tag]) if tag in place else raw.ljust(4, b"\0"))
    out += bytes(4)
    for tag in sorted(place):
        raw = own[tag][2]
        out += raw + bytes(len(raw) % 2)
    return bytes(out) + b"".join(strips)


def _deflate(by: list[str], bands: list[str], width: int, kind: str, fill: float, last: int):
    def run(rows: pd.DataFrame) -> pd.DataFrame:
        first = int(rows["strip"].iloc[0]) * ROWS
        high = min(ROWS, last - first)
        out = []
        for k, band in enumerate(bands):
            values = np.full((high, width), fill, kind)
            given = rows[band].notna().to_numpy()
            values[rows["row"].to_numpy()[given] - first, rows["col"].to_numpy()[given]] = rows[band].to_numpy()[given].astype(kind)
            if np.dtype(kind).kind != "f":
                values[:, 1:] -= values[:, :-1].copy()
            out.append((*[rows[c].iloc[0] for c in by], k, int(rows["strip"].iloc[0]), zlib.compress(values.tobytes())))
        return pd.DataFrame(out, columns=[*by, "band", "strip", "data"])

    return run


def _assemble(by: list[str], bands: list[str], grid: dict, kind: str, nodata: float | None, epsg: int):
    def run(parts: pd.DataFrame) -> pd.DataFrame:
        known = {(r.band, r.strip): r.data for r in parts.itertuples()}
        strips = []
        for k in range(len(bands)):
            for s in range(-(-grid["height"] // ROWS)):
                empty = np.full((min(ROWS, grid["height"] - s * ROWS), grid["width"]), nodata or 0, kind)
                if (k, s) not in known and np.dtype(kind).kind != "f":
                    empty[:, 1:] = 0
                strips.append(known.get((k, s)) or zlib.compress(empty.tobytes()))
        content = assembled(grid["width"], grid["height"], bands, kind, nodata, grid["west"], grid["north"], grid["step"], epsg, strips, ROWS)
        return pd.DataFrame([("/".join(str(parts[c].iloc[0]) for c in by) + ".tif", content)], columns=["name", "content"])

    return run


def encoded(pixels: DataFrame, by: list[str], bands: list[str], grid: dict, epsg: int, kind: str = "<i2", nodata: float | None = -9999) -> DataFrame:
    """One file for each image (values of `by`): name and content, from pixels (by, row, col, bands) within the grid (west, north, step, width, height).

    Values that are null, and pixels that are missing, are no data (0 where nodata is None). Pixels beyond the grid are an error. Of several rows of a pixel any one counts.
    """
    workers_find_package(pixels.sparkSession)
    sound = F.col("row").between(0, grid["height"] - 1) & F.col("col").between(0, grid["width"] - 1)
    own = pixels.select(*by, F.when(sound, F.col("row")).otherwise(F.raise_error(F.lit("a pixel beyond the grid")).cast("int")).cast("int").alias("row"), F.col("col").cast("int").alias("col"), *[F.col(b).cast("double").alias(b) for b in bands])
    own = own.withColumn("strip", F.floor(F.col("row") / ROWS).cast("int"))
    keys = [own.schema[c] for c in by]
    parts = own.groupBy(*by, "strip").applyInPandas(_deflate(by, bands, grid["width"], kind, nodata or 0, grid["height"]), T.StructType([*keys, T.StructField("band", T.IntegerType()), T.StructField("strip", T.IntegerType()), T.StructField("data", T.BinaryType())]))
    return parts.groupBy(*by).applyInPandas(_assemble(by, bands, grid, kind, nodata, epsg), "name string, content binary")
