"""Remote services: fetching with retries from executors, and what is made of the answers. The fetch itself is given by the caller."""

from __future__ import annotations

import os
import time
from collections.abc import Callable, Iterator

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.operators.storage import settle, workers_find_package
from sitelens.sources.sink import write_files


def with_retries(fetch: Callable[[str], str], tries: int = 5, first_wait: float = 1.0, again: Callable[[Exception], bool] = lambda e: True, sleep: Callable[[float], None] = time.sleep) -> Callable[[str], tuple[str, str | None, int]]:
    """A fetch that never raises: (status, answer, attempts). Waits double from first_wait; errors that `again` refuses end at once."""

    def run(key: str) -> tuple[str, str | None, int]:
        for k in range(tries):
            try:
                return "ok", fetch(key), k + 1
            except Exception as e:
                if not again(e) or k + 1 == tries:
                    return "erro", None, k + 1
                sleep(first_wait * 2**k)
        return "erro", None, tries

    return run


def over_quota(e: Exception) -> bool:
    """Whether an error says that a quota or rate is used up."""
    text = str(e).lower()
    return any(x in text for x in ("quota", "rate limit", "too many requests", "429"))


def fetched(keys: DataFrame, key: str, fetch: Callable[[str], str], pause: float = 0.0, **retries) -> DataFrame:
    """(key, status, resposta, tentativas) of every distinct key, fetched by the executors, one answer at a time in each task."""
    workers_find_package(keys.sparkSession)
    own = with_retries(fetch, **retries)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            rows = []
            for k in batch[key]:
                rows.append((k, *own(k)))
                if pause:
                    time.sleep(pause)
            yield pd.DataFrame(rows, columns=[key, "status", "resposta", "tentativas"])

    distinct = keys.select(F.col(key).cast("string").alias(key)).where(F.col(key).isNotNull()).distinct()
    return distinct.mapInPandas(run, f"{key} string, status string, resposta string, tentativas int")


_GEOCODE = "status string, results array<struct<formatted_address:string, address_components:array<struct<long_name:string, short_name:string, types:array<string>>>>>"
_CENSUS = "result struct<geographies:struct<Counties:array<struct<NAME:string, STATE:string, COUNTY:string, GEOID:string>>, States:array<struct<NAME:string>>>>"


def geocode_parts(answer: Column) -> Column:
    """Status, address and components of a reverse geocoding answer; nulls where it can't be read."""
    parsed = F.from_json(answer, _GEOCODE)
    first = F.get(parsed["results"], 0)
    return F.struct(F.coalesce(parsed["status"], F.lit("ERRO")).alias("status_geocode"), first["formatted_address"].alias("endereco"), first["address_components"].alias("partes"))


def census_parts(answer: Column) -> Column:
    """County, state and five-digit code of a census geocoder's answer."""
    g = F.from_json(answer, _CENSUS)["result"]["geographies"]
    county, state = F.get(g["Counties"], 0), F.get(g["States"], 0)
    return F.struct(county["NAME"].alias("municipio"), state["NAME"].alias("estado_nome"), F.concat(county["STATE"], county["COUNTY"]).alias("fips"))


def population_answer(answer: Column) -> Column:
    """The population of an answer [[header...], [value, ...]]; null where there is none."""
    rows = F.from_json(answer, "array<array<string>>")
    return F.get(F.get(rows, 1), 0).try_cast("long")


def resource_url(catalog: Column, name: Column) -> Column:
    """The address of a resource by its name in a catalogue's answer; the first one wins, null if none has it."""
    found = F.from_json(catalog, "result struct<resources:array<struct<name:string, url:string>>>")["result"]["resources"]
    return F.get(F.filter(found, lambda r: r["name"] == name), 0)["url"]


def required_env(name: str) -> str:
    """The value of an environment variable; an error that names it where it is unset or blank."""
    value = os.environ.get(name, "").strip()
    if not value:
        raise RuntimeError(f"set the environment variable {name}")
    return value


def downloaded(resources: DataFrame, folder: str, fetch: Callable[[str], str], **retries) -> DataFrame:
    """Resources (name, url) as files below folder, each fetched once: name and status, `cache` where the file was there, else `ok` or `erro` (settled).

    What can't be fetched leaves no file, so the next run tries it again; null names and urls are left out, and of equal names the first url counts.
    """
    spark = resources.sparkSession
    wanted = resources.where("name is not null and url is not null").groupBy("name").agg(F.min("url").alias("url"))
    target = spark._jvm.org.apache.hadoop.fs.Path(folder)
    there = spark.createDataFrame([], "name string")
    if target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target):
        at = F.regexp_extract("path", r"([^/]+)$", 1)
        there = spark.read.format("binaryFile").load(folder).select(at.alias("name"))  # names alone: no file is read
    known = settle(wanted.join(there.distinct().withColumn("_there", F.lit(True)), "name", "left"))
    answers = settle(fetched(known.where("_there is null").select("url"), "url", fetch, **retries))
    fresh = known.where("_there is null").join(answers, "url")
    write_files(fresh.where("status = 'ok'").select("name", F.encode("resposta", "UTF-8").alias("content")), folder)
    return settle(known.where("_there").select("name", F.lit("cache").alias("status")).unionAll(fresh.select("name", "status")))
