"""Queries that write rows of the given tables as files of the studies' kinds, in the shared folder, and read them again."""

from __future__ import annotations

import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators import nested as N
from sitelens.operators import records as D
from sitelens.operators.storage import drop, settle, shared_folder
from sitelens.plans.panel_queries import table
from sitelens.plans.registry import query
from sitelens.sources import connectors as K
from sitelens.sources import files as S
from sitelens.sources.sink import write_files


def _folder(spark: SparkSession) -> str:
    return f"{shared_folder(spark).rstrip('/')}/files-{uuid.uuid4().hex}"


def _written(rows: DataFrame, name: Column, text: Column) -> str:
    """Writes one text file for each row and returns the folder."""
    folder = _folder(rows.sparkSession)
    write_files(rows.select(name.alias("name"), F.encode(text, "UTF-8").alias("content")), folder)
    return folder


_WORD = r"regexp_extract(text, '^[A-Za-zÀ-ÿ]+')"


@query("csv_dialects", f"with d as (select doc_id, lang, source, {_WORD} as palavra, n_chars from documents) select doc_id, lang, source, palavra, n_chars, dialeto from d, (values (','), (';'), ('latin1')) t(dialeto)")
def csv_dialects(spark, sf):
    """The same rows with commas, with semicolons and a byte order mark, and in Latin 1, read with types."""
    mark = chr(0xFEFF)
    d = settle(table(spark, sf, "documents").select("doc_id", "lang", "source", F.regexp_extract("text", r"^[A-Za-zÀ-ÿ]+", 0).alias("palavra"), "n_chars"))
    out = []
    for name, sep, encoding in ((",", ",", "UTF-8"), (";", ";", "UTF-8"), ("latin1", ";", "ISO-8859-1")):
        folder = _folder(spark)
        S.write_csv(d.withColumnRenamed("doc_id", f"{mark}doc_id") if name == ";" else d, folder, sep, encoding)
        back = S.csv(spark, folder, sep, encoding)
        out.append(back.select(F.col("doc_id").cast("long").alias("doc_id"), F.nullif("lang", F.lit("")).alias("lang"), "source", F.coalesce("palavra", F.lit("")).alias("palavra"), F.col("n_chars").cast("long").alias("n_chars"), F.lit(name).alias("dialeto")))
    drop(d)
    return out[0].unionAll(out[1]).unionAll(out[2])


@query("csv_columns", "select s_suppkey, s_name, case when s_suppkey % 5 = 0 then '' else cast(s_nationkey as varchar) end as nacao from supplier")
def csv_columns(spark, sf):
    """Some columns of a wide file as text; missing values are empty."""
    s = table(spark, sf, "supplier").withColumn("nacao", F.when(F.col("s_suppkey") % 5 != 0, F.col("s_nationkey")))
    folder = _folder(spark)
    S.write_csv(s, folder)
    found = S.row_dicts(spark, folder)
    return found.select(F.col("s_suppkey").cast("long").alias("s_suppkey"), "s_name", "nacao")


@query("years_together", "select cast(year(o_orderdate) as int) as ano, count(*) as n, cast(sum(cast(o_totalprice as decimal(28,6))) as double) as total from orders group by 1")
def years_together(spark, sf):
    """A table kept as one Parquet table a year, read as one, with the columns asked for."""
    o = table(spark, sf, "orders").withColumn("ano", F.year("o_orderdate").cast("int"))
    years = sorted(r.ano for r in o.select("ano").distinct().collect())
    folder = _folder(spark)
    o.write.partitionBy("ano").parquet(folder)
    found = S.parquet(spark, *[f"{folder}/ano={y}" for y in years], columns=["o_orderdate", "o_totalprice"])
    return found.groupBy(F.year("o_orderdate").cast("int").alias("ano")).agg(F.count("*").alias("n"), F.sum(F.col("o_totalprice").cast("decimal(28,6)")).cast("double").alias("total"))


_STATE = "case s_suppkey % 4 when 0 then 'bloqueado' when 1 then 'quebrado' else 'ok' end"


@query("cached_documents", f"with d as (select s_suppkey, 's-' || s_suppkey as chave, {_STATE} as e from supplier) select chave, case when e <> 'quebrado' then e end as status, case when e <> 'quebrado' then cast(s_suppkey % 3 as int) end as tentativas, case when e = 'ok' then cast(s_suppkey as bigint) end as n from d")
def cached_documents(spark, sf):
    """One JSON document for each supplier, some blocked, some broken."""
    state = F.when(F.col("s_suppkey") % 4 == 0, "bloqueado").when(F.col("s_suppkey") % 4 == 1, "quebrado").otherwise("ok")
    s = table(spark, sf, "supplier").withColumn("e", state)
    body = F.struct(F.col("e").alias("status"), F.lit("2024-01-01").alias("atualizado_em"), (F.col("s_suppkey") % 3).cast("int").alias("tentativas"), F.when(F.col("e") == "ok", F.struct(F.col("s_suppkey").alias("n"))).alias("dados"))
    folder = _written(s, F.concat(F.lit("s-"), "s_suppkey", F.lit(".json")), F.when(F.col("e") == "quebrado", F.lit("{broken")).otherwise(F.to_json(body)))
    return S.documents(spark, folder, "struct<n:long>").select("chave", "status", "tentativas", F.col("dados.n").alias("n"))


@query("documents_saved_again", "with d as (select c_custkey as chave, cast(1 + case when c_custkey % 3 = 0 then 1 else 0 end as int) as tentativas, case when c_custkey % 3 = 0 then 'novo' else 'velho' end as dados from customer where c_custkey % 2 = 0 or c_custkey % 3 <> 0 union all select c_custkey, 1, 'novo' from customer where c_custkey % 2 = 1 and c_custkey % 3 = 0) select chave, tentativas, dados from d")
def documents_saved_again(spark, sf):
    """Documents of a cache after some are saved anew: their attempts go up, new ones have one."""
    c = table(spark, sf, "customer").select(F.col("c_custkey").alias("chave"))
    old = c.where("chave % 2 = 0 or chave % 3 <> 0").select("chave", F.lit("ok").alias("status"), F.lit(1).alias("tentativas"), F.lit("velho").alias("dados"))
    new = c.where("chave % 3 = 0").select("chave", F.lit("ok").alias("status"), F.lit("novo").alias("dados"))
    return S.upserted(old, new, "chave").select("chave", F.col("tentativas").cast("int").alias("tentativas"), "dados")


@query("files_by_name", "select 'site-' || s_suppkey as key, cast(1990 + s_suppkey % 30 as int) as ano, s_name as content from supplier where s_nationkey % 3 <> 0")
def files_by_name(spark, sf):
    """Files named by site and year, among others; the name gives both."""
    s = table(spark, sf, "supplier")
    name = F.concat(F.when(F.col("s_nationkey") % 3 == 0, "outro_").otherwise("lst_"), F.lit("site-"), "s_suppkey", F.lit("_"), F.lit(1990) + F.col("s_suppkey") % 30, F.lit(".txt"))
    return S.keyed_by_name(spark, _written(s, name, F.col("s_name")), "lst_", "_[0-9]{4}[.]txt")


@query("geojson_sites", "select 'n' || n_nationkey as site_id, n_name as nome, case when n_nationkey % 2 = 0 then cast(n_nationkey as double) else n_nationkey + 0.5 end as lat, cast(-n_nationkey as double) as lon, case when n_nationkey % 3 = 0 then 9e0 else 5e0 end as buffer_km, case when n_nationkey % 5 <> 0 then cast(n_nationkey % 4 as int) end as tier from nation where n_nationkey % 7 <> 0")
def geojson_sites(spark, sf):
    """Sites of a GeoJSON file: their coordinates are properties or, where these lack, the geometry's; active ones only."""
    k = F.col("n_nationkey")
    told = F.struct(F.concat(F.lit("n"), k).alias("site_id"), F.col("n_name").alias("nome"), F.when(k % 2 == 0, k.cast("double")).alias("lat"), F.when(k % 2 == 0, -k.cast("double")).alias("lon"), F.when(k % 3 == 0, F.lit(9.0)).alias("buffer_km"), (k % 7 != 0).alias("ativo"), F.when(k % 5 == 0, "x").otherwise((k % 4).cast("string")).alias("tier"))
    spot = F.struct(F.lit("Point").alias("type"), F.array(-k.cast("double"), k + F.lit(0.5)).alias("coordinates"))
    rows = table(spark, sf, "nation").agg(F.to_json(F.struct(F.collect_list(F.struct(told.alias("properties"), spot.alias("geometry"))).alias("features"))).alias("t"))
    return S.sites(spark, _written(rows, F.lit("sites.geojson"), F.col("t")), active_only=True).drop("ativo")


@query("feature_places", "select c_custkey, cast(c_custkey % 90 as double) as lat, case when c_custkey % 11 <> 0 then cast(c_custkey % 180 as double) end as lon from customer")
def feature_places(spark, sf):
    """Features' properties with the coordinates of their points; nulls where a point has too few."""
    c = table(spark, sf, "customer")
    lon, lat = (F.col("c_custkey") % 180).cast("double"), (F.col("c_custkey") % 90).cast("double")
    point = F.struct(F.when(F.col("c_custkey") % 11 == 0, F.array(F.lit(None).cast("double"), lat)).otherwise(F.array(lon, lat)).alias("coordinates"))
    rows = c.groupBy("c_nationkey").agg(F.struct(F.collect_list(F.struct(F.struct("c_custkey").alias("properties"), point.alias("geometry"))).alias("features")).alias("pagina"))
    return N.features(rows, "pagina").select("c_custkey", "lat", "lon")


@query("footprint_files", "select s_suppkey, cast(s_nationkey as double) + 0.25e0 as lat, cast(s_suppkey as double) + 0.5e0 as lon, s_name as nome from supplier")
def footprint_files(spark, sf):
    """Outlines of one JSON file for each nation: the mean of their corners and a tag."""
    la, lo = F.col("s_nationkey").cast("double"), F.col("s_suppkey").cast("double")
    ring = F.array(*[F.struct((la + a).alias("lat"), (lo + b).alias("lon")) for a, b in ((0.0, 0.0), (0.0, 1.0), (0.5, 1.0), (0.5, 0.0))])
    s = table(spark, sf, "supplier").groupBy("s_nationkey").agg(F.to_json(F.struct(F.collect_list(F.struct(ring.alias("geometry"), F.create_map(F.lit("name"), "s_name", F.lit("id"), F.col("s_suppkey").cast("string")).alias("tags"))).alias("elements"))).alias("t"))
    found = S.footprints(spark, _written(s, F.concat(F.lit("n"), "s_nationkey", F.lit(".json")), F.col("t")))
    mean = lambda c: F.aggregate("ring", F.lit(0.0), lambda a, p: a + p[c]) / F.size("ring")
    return found.select(F.col("tags")["id"].cast("long").alias("s_suppkey"), mean("lat").alias("lat"), mean("lon").alias("lon"), F.col("tags")["name"].alias("nome"))


@query("factor_files", "select cast(n_nationkey % 5 + 1 as int) as classe, case when n_nationkey % 2 = 0 then 'b' else 'c' end as tratamento, n_nationkey / 10e0 as fator from nation")
def factor_files(spark, sf):
    """Sensor factors of the model version they were made for; none from a file that is absent."""
    k = F.col("n_nationkey")
    one = F.struct((k % 5 + 1).cast("int").alias("classe"), F.when(k % 2 == 0, "b").otherwise("c").alias("tratamento"), (k / F.lit(10.0)).alias("fator"))
    rows = table(spark, sf, "nation").agg(F.to_json(F.struct(F.lit("v2").alias("modelo_versao"), F.collect_list(one).alias("fatores"))).alias("t"))
    folder = _written(rows, F.lit("fator.json"), F.col("t"))
    return S.factors(spark, f"{folder}/fator.json", "v2").unionAll(S.factors(spark, f"{folder}/none.json", "v2"))


@query("manifest_rows", "select l_returnflag as sensor, cast(l_linenumber as int) as site, count(*) as n_linhas, 64 as digitos, 'v2' as modelo_versao from lineitem group by 1, 2")
def manifest_rows(spark, sf):
    """Manifests of artefacts as JSON files, read again."""
    rows = table(spark, sf, "lineitem").select(F.col("l_returnflag").alias("sensor"), F.col("l_linenumber").cast("int").alias("site"), "l_orderkey", "l_quantity")
    made = S.manifest(rows, ["sensor", "site"], "v2", "abc", "2024-01-01")
    folder = _written(made, F.concat_ws("_", "sensor", "site", F.lit("m.json")), F.col("manifest"))
    back = spark.read.schema("sensor string, site int, n_linhas long, sha256 string, modelo_versao string").json(folder)
    return back.select("sensor", "site", "n_linhas", F.length("sha256").alias("digitos"), "modelo_versao")


@query("tab_status", "select 'd' || s_suppkey as chave, case s_suppkey % 3 when 0 then 'ok' when 1 then 'bloqueado' else 'ausente' end as status_overview, case when s_suppkey % 2 = 0 then 'ok' else 'ausente' end as status_specs, case when s_suppkey % 3 = 0 then s_name end as nome, case when s_suppkey % 2 = 0 then 's' || s_name end as plano from supplier")
def tab_status(spark, sf):
    """Both tabs of records from a cache; data of a tab counts only where its document is ok."""
    s = table(spark, sf, "supplier").select(F.concat(F.lit("d"), "s_suppkey").alias("chave"), "s_suppkey", "s_name")
    over = s.where("s_suppkey % 3 < 2").select("chave", F.lit("overview").alias("aba"), F.when(F.col("s_suppkey") % 3 == 0, "ok").otherwise("bloqueado").alias("status"), F.col("s_name").alias("dados"))
    specs = s.where("s_suppkey % 2 = 0").select("chave", F.lit("specs").alias("aba"), F.lit("ok").alias("status"), F.concat(F.lit("s"), "s_name").alias("dados"))
    return D.tabs(s.select("chave"), over.unionAll(specs)).withColumnsRenamed({"overview": "nome", "specs": "plano"})


def _service(key: str) -> str:
    """Stands for a remote service: some keys are over quota at all times, some are refused."""
    n = int(key)
    if n % 3 == 0:
        raise RuntimeError("429: quota used up")
    if n % 3 == 2:
        raise RuntimeError("no such place")
    return f"r{n}"


@query("fetched_answers", "select cast(s_suppkey as varchar) as k, case when s_suppkey % 3 = 1 then 'ok' else 'erro' end as status, case when s_suppkey % 3 = 1 then 'r' || s_suppkey end as resposta, cast(case when s_suppkey % 3 = 0 then 3 else 1 end as int) as tentativas from supplier")
def fetched_answers(spark, sf):
    """Answers by key from a service with quotas: only what says that a quota is used up is asked for again."""
    return K.fetched(table(spark, sf, "supplier").select(F.col("s_suppkey").alias("k")), "k", _service, tries=3, first_wait=0.001, again=K.over_quota)


@query("download_cache", "select 'f' || s_suppkey as name, r as rodada, case when s_suppkey % 3 <> 1 then 'erro' when r = 1 then 'ok' else 'cache' end as status from supplier, (values (1), (2)) t(r)")
def download_cache(spark, sf):
    """Resources fetched to a folder twice: the second round finds what the first one wrote, and tries the others again."""
    wanted = table(spark, sf, "supplier").select(F.concat(F.lit("f"), "s_suppkey").alias("name"), F.col("s_suppkey").cast("string").alias("url"))
    folder = _folder(spark)
    rounds = [K.downloaded(wanted, folder, _service, tries=2, first_wait=0.001, again=K.over_quota).select("name", F.lit(k).alias("rodada"), "status") for k in (1, 2)]
    return rounds[0].unionAll(rounds[1])
