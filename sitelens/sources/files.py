"""Reading and writing tables, documents, manifests and sites in the dialects that studies come in."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

MANIFEST = "site_id string, sensor string, ano int, modelo_versao string, raster string, sha256 string"


def csv(spark: SparkSession, path, sep: str = ",", encoding: str = "UTF-8", schema: str | None = None, columns: list[str] | None = None) -> DataFrame:
    """A CSV with header; a byte order mark before the first name is left out; without schema all columns are text."""
    reader = spark.read.option("header", True).option("sep", sep).option("encoding", encoding).option("enforceSchema", False)
    df = (reader.schema(schema) if schema else reader).csv(path)
    if df.columns and df.columns[0].startswith("﻿"):
        df = df.withColumnRenamed(df.columns[0], df.columns[0].lstrip("﻿"))
    return df.select(*columns) if columns else df


def row_dicts(spark: SparkSession, path, sep: str = ",") -> DataFrame:
    """A CSV of text columns in which missing values are empty strings."""
    df = csv(spark, path, sep)
    return df.select(*[F.coalesce(F.col(c), F.lit("")).alias(c) for c in df.columns])


def parquet(spark: SparkSession, *paths: str, columns: list[str] | None = None) -> DataFrame:
    """One or several Parquet tables as one, with the columns asked for."""
    df = spark.read.parquet(*paths)
    return df.select(*columns) if columns else df


def documents(spark: SparkSession, path, data: str) -> DataFrame:
    """Status-wrapped JSON files: chave (file name), status, atualizado_em, tentativas, dados; broken files have all null."""
    schema = f"status string, atualizado_em string, tentativas int, dados {data}, _corrupt_record string"
    df = spark.read.option("multiLine", True).option("mode", "PERMISSIVE").schema(schema).json(path)
    return df.select(F.regexp_extract(F.col("_metadata.file_name"), r"^(.*)\.json$", 1).alias("chave"), "status", "atualizado_em", "tentativas", "dados")


def keyed_by_name(spark: SparkSession, path, prefix: str = "", suffix: str = "") -> DataFrame:
    """Text files by name without prefix and suffix; names ending in _<year> give the year too."""
    df = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_name").alias("name"), F.col("value").alias("content"))
    key = F.regexp_extract("name", f"^{prefix}(.*?){suffix}$", 1)
    return df.select(key.alias("key"), F.expr("try_cast(regexp_extract(name, '_([0-9]{4})[^0-9]*$', 1) as int)").alias("ano"), "content").where("key <> ''").orderBy("key")


#: Path tokens of sensors and their names.
SENSORS = {"s2": "sentinel2", "landsat": "landsat"}


def catalog(found: DataFrame, version: str, site: str | None = None, token: str | None = None, rasters: DataFrame | None = None, sensor: str | None = None, year: int | None = None) -> DataFrame:
    """Rasters of one model version, sorted by site, year and sensor (its name in `sensor`, its token in `sensor_token`).

    An error if none match, if a sensor is unknown (asked for or found), or if a raster is not among `rasters` (raster). `token` is what raster paths start with.
    """
    if sensor is not None and sensor not in SENSORS:
        raise ValueError(f"unknown sensor {sensor}: one of {sorted(SENSORS)}")
    df = found.where(F.col("modelo_versao") == version)
    df = df if sensor is None else df.where(F.col("sensor") == sensor)
    df = df if year is None else df.where(F.col("ano") == year)
    df = df if site is None else df.where(F.col("site_id") == site)
    df = df if token is None else df.where(F.col("raster").startswith(token))
    bad = df.agg(F.count("*").alias("n"), F.min(F.when(~F.coalesce(F.col("sensor").isin(*SENSORS), F.lit(False)), F.coalesce("sensor", F.lit("null")))).alias("sensor")).first()
    if not bad.n:
        raise ValueError(f"no manifest of {version}")
    if bad.sensor is not None:
        raise ValueError(f"unknown sensor {bad.sensor}: one of {sorted(SENSORS)}")
    if rasters is not None and (lost := df.join(rasters.select("raster"), "raster", "left_anti").select("raster").first()):
        raise ValueError(f"raster {lost.raster} is missing")
    named = df.withColumnRenamed("sensor", "sensor_token").withColumn("sensor", F.when(F.col("sensor_token") == "s2", "sentinel2").otherwise(F.col("sensor_token")))
    return named.orderBy("site_id", "ano", "sensor")


def manifests(spark: SparkSession, path, version: str, site: str | None = None, prefix: str | None = None, rasters: DataFrame | None = None) -> DataFrame:
    """The catalog of manifests in JSON files."""
    return catalog(spark.read.option("multiLine", True).schema(MANIFEST).json(path), version, site, prefix, rasters)


def sites(spark: SparkSession, path, buffer_km: float = 5.0, active_only: bool = False, required: tuple[str, ...] = ("site_id",)) -> DataFrame:
    """Sites of a GeoJSON file: properties first, geometry where a coordinate is absent, and a default buffer. A missing required property is an error."""
    schema = "features array<struct<properties:struct<site_id:string,nome:string,lat:double,lon:double,buffer_km:double,ativo:boolean,tier:string>,geometry:struct<type:string,coordinates:array<double>>>>"
    f = spark.read.option("multiLine", True).schema(schema).json(path).select(F.explode("features").alias("f"))
    lacks = [r for r in required if not f.where(F.col(f"f.properties.{r}").isNull()).isEmpty()]
    if lacks:
        raise ValueError(f"sites without {', '.join(lacks)}")
    out = f.select("f.properties.site_id", "f.properties.nome", F.coalesce("f.properties.lat", F.get("f.geometry.coordinates", 1)).alias("lat"), F.coalesce("f.properties.lon", F.get("f.geometry.coordinates", 0)).alias("lon"), F.coalesce("f.properties.buffer_km", F.lit(buffer_km)).alias("buffer_km"), F.expr("try_cast(f.properties.tier as int)").alias("tier"), F.coalesce("f.properties.ativo", F.lit(False)).alias("ativo"))
    return out.where("ativo") if active_only else out


def site(found: DataFrame, ident: str):
    """The site of an id; an error if there is none."""
    row = found.where(F.col("site_id") == ident).first()
    if row is None:
        raise ValueError(f"no site {ident}")
    return row


def _exists(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(path)
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def factors(spark: SparkSession, path: str, version: str) -> DataFrame:
    """Sensor factors (classe, tratamento, fator); none where the file is absent, an error when they were made for another model version."""
    kind = "modelo_versao string, fatores array<struct<classe:int,tratamento:string,fator:double>>"
    if not _exists(spark, path):
        return spark.createDataFrame([], "classe int, tratamento string, fator double")
    df = spark.read.option("multiLine", True).schema(kind).json(path)
    found = [r.modelo_versao for r in df.select("modelo_versao").limit(2).collect()]
    if any(v != version for v in found):
        raise ValueError(f"factors were made for {found}, not {version}")
    return df.select(F.inline("fatores"))


def footprints(spark: SparkSession, path) -> DataFrame:
    """Building outlines of JSON files, one row each: pos, ring (lat, lon) and tags."""
    kind = "elements array<struct<geometry:array<struct<lat:double,lon:double>>, tags:map<string,string>>>"
    return spark.read.option("multiLine", True).schema(kind).json(path).select(F.posexplode("elements").alias("pos", "e")).select("pos", F.col("e.geometry").alias("ring"), F.col("e.tags").alias("tags"))


def parameters(path: str) -> dict:
    """A YAML or JSON file of parameters, read by the driver; an error that names it if it is missing."""
    import json
    import os

    if not os.path.exists(path):
        raise FileNotFoundError(f"no parameters at {path}: make the file, or give its path")
    with open(path, encoding="utf-8") as f:
        text = f.read()
    if path.endswith(".json"):
        return json.loads(text)
    try:
        import yaml
    except ImportError as e:
        raise ImportError("reading YAML needs the package yaml; JSON needs none") from e
    return yaml.safe_load(text)


def bands(rows: DataFrame, wanted: list[str]) -> DataFrame:
    """rows with bands in the wanted order; an error unless the names of all but the key columns are exactly these."""
    have = [c for c in rows.columns if c not in ("site_id", "sensor", "ano", "row", "col")]
    if set(have) != set(wanted):
        raise ValueError(f"bands {sorted(have)}, not {sorted(wanted)}")
    return rows.select(*[c for c in rows.columns if c not in have], *wanted)


def manifest(rows: DataFrame, by: list[str], version: str, commit: str, made: str) -> DataFrame:
    """One JSON text per artefact (by): rows, digest of their content whatever their order, version, commit and time."""
    one = F.sha2(F.to_json(F.struct(*rows.columns)), 256)
    mix = F.sha2(F.array_join(F.array_sort(F.collect_list("_d")), ""), 256)
    part = rows.select(*by, one.alias("_h")).withColumn("_b", F.substring("_h", 1, 2)).groupBy(*by, "_b").agg(F.count("*").alias("_n"), F.bit_xor(F.xxhash64("_h")).alias("_x"))
    part = part.withColumn("_d", F.concat_ws(":", "_b", "_n", "_x"))
    whole = part.groupBy(*by).agg(F.sum("_n").alias("n_linhas"), mix.alias("sha256"))
    body = F.struct(*by, "n_linhas", "sha256", F.lit(version).alias("modelo_versao"), F.lit(commit).alias("git_sha"), F.lit(made).alias("criado_em"))
    return whole.select(*by, "sha256", F.to_json(body).alias("manifest"))


def extraction_log(rows: DataFrame, value: str, low: float, high: float, least: int, count: str) -> DataFrame:
    """One row of totals: rows, rows without value, least and greatest value, rows out of range, and rows from fewer than `least` scenes."""
    return rows.agg(F.count("*").alias("n"), F.count(F.when(F.col(value).isNull(), 1)).alias("sem_valor"), F.min(value).alias("minimo"), F.max(value).alias("maximo"), F.count(F.when(~F.col(value).between(low, high), 1)).alias("fora_da_faixa"), F.count(F.when(F.col(count) < least, 1)).alias("poucas_cenas"))


def discards(rows: DataFrame, reason: str, by: list[str]) -> DataFrame:
    """Rows discarded by group and reason, groups without any left out; the columns are the same if there are none."""
    return rows.where(F.col(reason).isNotNull()).groupBy(*by, reason).agg(F.count("*").alias("n"))


def changes(rows: DataFrame, by: list[str], year: str, value: str, first: int, last: int) -> DataFrame:
    """What a value differs between two years by group; groups that lack either are left out."""
    at = lambda y: F.max(F.when(F.col(year) == y, F.col(value)))
    out = rows.where(F.col(year).isin(first, last)).groupBy(*by).agg(at(first).alias("antes"), at(last).alias("depois"))
    return out.where("antes is not null and depois is not null").withColumn("delta", F.col("depois") - F.col("antes"))


def replaced(df: DataFrame, path: str) -> None:
    """Writes df in place of the Parquet table at path that it may have been read from: beside it first, then swapped."""
    spark = df.sparkSession
    fresh, old = f"{path.rstrip('/')}.new", f"{path.rstrip('/')}.old"
    make = spark._jvm.org.apache.hadoop.fs.Path
    fs = make(path).getFileSystem(spark._jsc.hadoopConfiguration())
    df.write.mode("overwrite").parquet(fresh)
    fs.delete(make(old), True)
    if fs.exists(make(path)):
        fs.rename(make(path), make(old))
    fs.rename(make(fresh), make(path))
    fs.delete(make(old), True)


def write_csv(df: DataFrame, path: str, sep: str = ",", encoding: str = "UTF-8", single: bool = False) -> None:
    """Writes a folder of CSV files with header, one for each part of df; with `single` one file, for which one task works out and writes all rows."""
    (df.coalesce(1) if single else df).write.option("header", True).option("sep", sep).option("encoding", encoding).mode("overwrite").csv(path)


def upserted(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Documents after saving new ones (key, status, dados): attempts go up by one, others stay."""
    before = old.select(key, F.col("tentativas").alias("_t"))
    fresh = new.join(before, key, "left").withColumn("tentativas", F.coalesce("_t", F.lit(0)) + 1).drop("_t")
    return fresh.unionByName(old.join(new.select(key), key, "left_anti"), allowMissingColumns=True)


def geojson(df: DataFrame, lat: str, lon: str) -> Column:
    """A feature's JSON text: all columns but the coordinates are its properties."""
    rest = [c for c in df.columns if c not in (lat, lon)]
    return F.to_json(F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Point").alias("type"), F.array(lon, lat).alias("coordinates")).alias("geometry"), F.struct(*rest).alias("properties")))
