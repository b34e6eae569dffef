"""Queries over records, series of sensors, scenes and small columns, each beside SQL written from the definitions alone."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.functions import text as X
from sitelens.functions import values as V
from sitelens.operators import graph as G
from sitelens.operators import match as M
from sitelens.operators import raster as R
from sitelens.operators import records as D
from sitelens.operators.storage import numbered, settle
from sitelens.plans.panel_queries import PANEL, avg, panel, table
from sitelens.plans.registry import query
from sitelens.plans.table_queries import _GRID, _HIST, _KNN, PLACES, classes, knn, places
from sitelens.sources import collections as C
from sitelens.sources import connectors as K
from sitelens.sources import files as S
from sitelens.streaming import incremental as I

SITE = "https://example.org/"


@query("flat_records", "select 'dc ' || c_custkey as nome_datacenter, c_name as operadora, case when c_custkey % 3 <> 0 then c_acctbal end as mw_construido, case when c_custkey % 5 = 0 then 'x, ' || c_mktsegment else '' end as tags, case when c_custkey % 4 <> 0 then 'https://example.org/usa/' || c_nationkey || '/dc-' || c_custkey || '/' end as link_datacenter, cast(null as varchar) as soc1, 'ok' as cache_overview_status from customer")
def flat_records(spark, sf):
    c = table(spark, sf, "customer")
    capacity = F.when(F.col("c_custkey") % 3 != 0, F.struct(F.col("c_acctbal").alias("mw_builtout"), F.lit(None).cast("double").alias("mw_referenced")))
    dc = F.struct(F.concat(F.lit("dc "), "c_custkey").alias("name"), F.struct(F.col("c_name").alias("name")).alias("company"), capacity.alias("meta_capacity"), F.when(F.col("c_custkey") % 5 == 0, F.array(F.lit("x"), "c_mktsegment")).alias("tags"), F.lit("usa").alias("countrylink"), F.when(F.col("c_custkey") % 4 == 0, "").otherwise(F.col("c_nationkey").cast("string")).alias("marketlink"), F.concat(F.lit("dc-"), "c_custkey").alias("link"))
    rows = c.select(dc.alias("dc"), F.lit("ok").alias("status_overview"), F.lit(None).cast("string").alias("status_specs"))
    return D.flattened(rows, SITE).select("nome_datacenter", "operadora", "mw_construido", "tags", "link_datacenter", "soc1", "cache_overview_status")


@query("region_list", "select r_name as regiao, r_name as nome, cast(n as bigint) as qtd_datacenters_informada, 'https://example.org/usa/' || r_name || '/' as url from (select r_name, r_regionkey, count(n_nationkey) as n from region left join nation on n_regionkey = r_regionkey group by 1, 2) x where r_regionkey % 2 = 0")
def region_list(spark, sf):
    r, n = table(spark, sf, "region"), table(spark, sf, "nation")
    per = r.join(n, F.col("n_regionkey") == F.col("r_regionkey"), "left").groupBy("r_regionkey", "r_name").agg(F.count("n_nationkey").alias("n"))
    none = F.lit(None).cast("double")
    geos = per.select(F.struct(F.when(F.col("r_regionkey") % 2 == 0, F.col("r_name")).otherwise("").alias("link"), F.col("r_name").alias("name"), F.col("n").alias("datacenters"), none.alias("latitude"), none.alias("longitude")).alias("g"))
    return D.regions(geos.agg(F.collect_list("g").alias("geos")).withColumn("pais", F.lit("usa")), SITE).drop("latitude", "longitude")


@query("place_links", "with p as (select 's' || (s_suppkey % 40) as slug, cast(s_nationkey as varchar) as regiao, s_suppkey, s_name as nome, 'https://example.org/p/' || s_suppkey as url from supplier where s_nationkey % 7 <> 0) select slug, regiao, nome, url from (select *, row_number() over (partition by slug order by regiao, s_suppkey) as rn from p) x where rn = 1")
def place_links(spark, sf):
    s = table(spark, sf, "supplier")
    dc = F.struct("s_suppkey", F.concat(F.lit("s"), F.col("s_suppkey") % 40).alias("link"), F.col("s_name").alias("name"), F.concat(F.lit("/p/"), "s_suppkey").alias("url"))
    found = s.groupBy(F.col("s_nationkey").cast("string").alias("regiao")).agg(F.array_sort(F.collect_list(dc)).alias("dcs"))
    return D.place_links(found.withColumn("status", F.when(F.col("regiao").cast("int") % 7 == 0, "bloqueado").otherwise("ok")), SITE)


def _pages(spark, sf) -> DataFrame:
    p = table(spark, sf, "pages").select("page_id", F.col("page_id") % 4)
    k = F.col("page_id") % 4
    data = F.when(k == 0, F.concat(F.lit('{"props": {"pageProps": {"dc": {"name": "n'), "page_id", F.lit('"}}}}'))).when(k == 1, F.lit('{"props": {"pageProps": {"pageId": "rate-limited"}}}')).when(k == 2, F.lit('{"props": '))
    html = F.concat(F.lit("<html><script>x</script>"), F.when(k == 3, "").otherwise(F.concat(F.lit('<script id="__NEXT_DATA__" type="application/json">'), data, F.lit("</script>"))), F.lit("</html>"))
    name = F.when(F.col("page_id") % 3 == 0, F.concat(F.lit("regiao_r"), "page_id")).when(F.col("page_id") % 3 == 1, F.concat(F.lit("datacenter_d"), "page_id", F.lit("_specs"))).otherwise(F.concat(F.lit("datacenter_d"), "page_id"))
    return p.select(F.concat(name, F.lit(".html")).alias("name"), html.alias("html"))


_IMPORT = "i as (select case when page_id % 3 = 0 then 'regiao' else 'datacenter' end as tipo, case when page_id % 3 = 0 then 'r' else 'd' end || page_id as chave, case page_id % 3 when 0 then 'regiao' when 1 then 'specs' else 'overview' end as aba, case page_id % 4 when 0 then 'ok' when 1 then 'bloqueado' else 'erro' end as status, case when page_id % 4 = 0 then 'n' || page_id end as nome from pages)"


@query("page_import", f"with {_IMPORT} select * from i")
def page_import(spark, sf):
    return D.imported(_pages(spark, sf)).select("tipo", "chave", "aba", "status", F.try_variant_get("dados", "$.dc.name", "string").alias("nome"))


@query("status_counts", f"with {_IMPORT}, s as (select unnest(['ok', 'bloqueado', 'erro']) as status) select s.status, cast(count(i.status) as bigint) as n from s left join i on s.status = i.status group by 1")
def status_counts(spark, sf):
    return D.status_counts(D.imported(_pages(spark, sf)))


_FOUND = "f as (select n_nationkey as c_nationkey, case when n_nationkey % 3 = 0 then '' else n_name end as municipio, case when n_nationkey % 4 = 0 then 0 else n_nationkey * 1000 end as populacao from nation)"


def _enriched(spark, sf):
    n = F.col("n_nationkey")
    found = table(spark, sf, "nation").select(n.alias("c_nationkey"), F.when(n % 3 == 0, "").otherwise(F.col("n_name")).alias("municipio"), F.when(n % 4 == 0, 0).otherwise(n * 1000).alias("populacao"))
    base = table(spark, sf, "customer").select("c_custkey", "c_nationkey", F.col("c_name").alias("municipio"), F.lit(-1).alias("populacao"))
    return D.enriched(base, found, "c_nationkey", ["municipio", "populacao"], F.col("c_custkey") % 2 == 0)


@query("enriched_base", f"with {_FOUND} select c_custkey, case when c_custkey % 2 = 0 and f.municipio <> '' then f.municipio else c_name end as municipio, cast(case when c_custkey % 2 = 0 and f.populacao <> 0 then f.populacao else -1 end as int) as populacao, case when c_custkey % 2 = 1 then 'IBGE (municipio)' when f.populacao <> 0 then 'ACS 2022 5-year (condado)' else '' end as fonte_populacao from customer c left join f on c.c_nationkey = f.c_nationkey")
def enriched_base(spark, sf):
    out = _enriched(spark, sf)[0]
    country, county = F.when(F.col("c_custkey") % 2 == 0, "EUA").otherwise("Brasil"), F.when(F.col("populacao") != -1, F.col("populacao").cast("string"))
    label = X.population_source(country, county, F.col("populacao").cast("string"), F.lit(None).cast("string"), 2022)[1]
    return D.column_after(out, "fonte_populacao", label, "populacao").drop("c_nationkey")


@query("fill_counts", f"with {_FOUND} select 'municipio' as coluna, cast(sum(case when c_custkey % 2 = 0 and f.municipio <> '' then 1 else 0 end) as bigint) as preenchidos from customer c left join f on c.c_nationkey = f.c_nationkey union all select 'populacao', cast(sum(case when c_custkey % 2 = 0 and f.populacao <> 0 then 1 else 0 end) as bigint) from customer c left join f on c.c_nationkey = f.c_nationkey")
def fill_counts(spark, sf):
    return _enriched(spark, sf)[1]


@query("order_batches", "select o_orderkey, cast(floor((row_number() over (order by o_orderkey) - 1) / 60) as int) as lote from orders")
def order_batches(spark, sf):
    return D.batched(table(spark, sf, "orders").select("o_orderkey"), ["o_orderkey"], 60)


@query("text_columns", "select c_custkey, trim('  ' || c_name || ' ') as aparado, c_name || ' (' || c_mktsegment || ')' as rotulo, 'us-' || lpad(cast(c_custkey as varchar), cast(greatest(4, length(cast(c_custkey as varchar))) as int), '0') as codigo, 'https://example.org/' || c_custkey || '/x' as url, case when c_custkey >= 10000 and c_custkey < 100000 then substr(cast(c_custkey as varchar), 1, 2) end as estado, case when c_custkey >= 10000 and c_custkey < 100000 then substr(cast(c_custkey as varchar), 3, 3) end as condado, case when c_nationkey in (1, 2, 3) then 'norte' when c_nationkey in (3, 4) then 'sul' else '' end as regiao, cast(round_even(c_acctbal, 0) as bigint) as inteiro from customer")
def text_columns(spark, sf):
    c = X.trimmed(table(spark, sf, "customer").withColumn("aparado", F.concat(F.lit("  "), "c_name", F.lit(" "))))
    key = F.col("c_custkey").cast("string")
    return c.select("c_custkey", "aparado", X.label(F.col("c_name"), F.col("c_mktsegment")).alias("rotulo"), X.padded("us-", F.col("c_custkey"), 4).alias("codigo"), X.joined_url(F.lit(SITE), key, F.lit("x")).alias("url"), X.fips(key)["estado"].alias("estado"), X.fips(key)["condado"].alias("condado"), X.region_of(F.col("c_nationkey"), {"norte": (1, 2, 3), "sul": (3, 4)}).alias("regiao"), X.whole(F.col("c_acctbal")).alias("inteiro"))


@query("biome_names", "select s_suppkey, case s_suppkey % 18 when 1 then 'Floresta tropical úmida' when 2 then 'Floresta tropical seca' when 4 then 'Floresta temperada decídua' when 5 then 'Floresta temperada de coníferas' when 6 then 'Taiga' when 7 then 'Savana tropical' when 8 then 'Campos temperados' when 9 then 'Campos alagáveis' when 10 then 'Campos montanos' when 11 then 'Tundra' when 12 then 'Mata mediterrânea' when 13 then 'Deserto e arbustal xérico' when 14 then 'Manguezal' else 'RESOLVE biome ' || (s_suppkey % 18) end as bioma from supplier")
def biome_names(spark, sf):
    return table(spark, sf, "supplier").select("s_suppkey", X.biome(F.col("s_suppkey") % 18).alias("bioma"))


@query("rounding_rules", "select l_orderkey, l_linenumber, floor(l_quantity / 8 * 10 + 0.5) / 10 as meio_acima, round_even(l_quantity / 8, 1) as meio_par, cast(coalesce(round_even(case when l_linenumber <> 3 then l_tax end * 10000, 0), -9999) as smallint) as escala, cast(trunc((l_quantity - 25) / 8) as int) as celula from lineitem")
def rounding_rules(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", V.half_up(q / 8, 1).alias("meio_acima"), V.half_even(q / 8, 1).alias("meio_par"), V.scaled_short(F.when(F.col("l_linenumber") != 3, F.col("l_tax"))).alias("escala"), geo.cell(q - 25, 8.0).alias("celula"))


@query("band_scaling", "select l_orderkey, l_linenumber, l_quantity * 0.0000275e0 - 0.2e0 as landsat, l_quantity / 10000e0 * 0.9765e0 + 0.0009e0 as vermelho, l_quantity / 10000e0 * 0.9983e0 + -0.0001e0 as nir, l_extendedprice * 0.02e0 - 273.15e0 as celsius from lineitem")
def band_scaling(spark, sf):
    q = F.col("l_quantity")
    return table(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", R.landsat_reflectance(q).alias("landsat"), R.harmonized(q, "red").alias("vermelho"), R.harmonized(q, "nir").alias("nir"), R.celsius(F.col("l_extendedprice")).alias("celsius"))


@query("grid_geometry", f"with {PLACES} select id, floor(lon * 1000 / 30) * 30 as origem, cast(ceil((lon * 1000 + 500) / 30) - floor(lon * 1000 / 30) as int) as celulas, lon as oeste, lat + 20 * -0.5e0 as sul, lon + 10 * 0.5e0 as leste, lat as norte, (lat + (lat + 1) + (lat + 1)) / 3 as centro_lat, cast(4 as int) as vertices from places")
def grid_geometry(spark, sf):
    p = places(spark, sf)
    first, cells = geo.snapped(F.col("lon") * 1000, F.col("lon") * 1000 + 500, 30.0)
    box = geo.rectangle(F.array(F.lit(0.5), F.lit(0.0), "lon", F.lit(0.0), F.lit(-0.5), "lat"), F.lit(10), F.lit(20))
    at = lambda d, e: F.struct((F.col("lat") + d).alias("lat"), (F.col("lon") + e).alias("lon"))
    ring = F.array(at(0.0, 0.0), at(1.0, 0.0), at(1.0, 1.0))
    return p.select("id", first.alias("origem"), cells.alias("celulas"), box["oeste"].alias("oeste"), box["sul"].alias("sul"), box["leste"].alias("leste"), box["norte"].alias("norte"), geo.vertex_mean(ring, "lat").alias("centro_lat"), F.size(geo.closed_ring(ring)).alias("vertices"))


@query("seat_points", f"with {PLACES} select id, lat, lon from places")
def seat_points(spark, sf):
    lat, lon = geo.wkt_point(F.col("ponto"))
    return places(spark, sf).select("id", F.concat(F.lit("POINT("), "lon", F.lit(" "), "lat", F.lit(")")).alias("ponto")).select("id", lat.alias("lat"), lon.alias("lon"))


_FACTORS = [(3, "b", 1.25), (4, "c", 0.9), (1, "b", 1.1)]


@query("area_series", f"with {_GRID}, {_HIST}, s as (select *, case when site % 2 = 0 then 'landsat' else 'sentinel2' end as sensor, ano + 22 as anos, case when classe in (3, 1) and site % 3 = 0 then case classe when 3 then 1.25e0 else 1.1e0 end end as f from h), b as (select *, case when sensor = 'sentinel2' then 'sentinel2_oficial_2019_2025' when anos in (2019, 2020, 2021) then 'landsat_overlap_referencia' when f is not null then 'landsat_pre2019_corrigido_sv20' else 'landsat_pre2019_nao_corrigido' end as faixa_serie from s) select site, cast(anos as int) as ano, sensor, cast(classe as int) as classe, cast(n as double) * 900 as area_m2, cast(n as double) * 900 / 10000 as area_ha, case when n_valid > 0 then cast(n as double) * 100 / n_valid end as pct_validos, case when faixa_serie = 'landsat_pre2019_corrigido_sv20' then f else 1e0 end as fator_correcao_sensor, faixa_serie, cast(n as double) * 900 / 10000 * case when faixa_serie = 'landsat_pre2019_corrigido_sv20' then f else 1e0 end as area_ha_corrigida from b")
def area_series(spark, sf):
    counts = classes(spark, sf).select("site", (F.col("ano") + 22).cast("int").alias("ano"), F.when(F.col("site") % 2 == 0, "landsat").otherwise("sentinel2").alias("sensor"), "classe", "n", "n_valid")
    sites = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("site")).where("site % 3 = 0")
    one = F.array(*[F.struct(F.lit(c).alias("classe"), F.lit(t).alias("tratamento"), F.lit(f).alias("fator")) for c, t, f in _FACTORS])
    factors = sites.select("site", F.inline(one))
    return R.area_series(counts, factors, 30.0)


@query("prop_wide", f"with {_GRID}, {_HIST} select site, ano, " + ", ".join(f"max(case when classe = {k} and n_valid > 0 then cast(n as double) / n_valid end) as prop_{n}" for k, n in R.CLASSES.items()) + " from h group by site, ano")
def prop_wide(spark, sf):
    rows = classes(spark, sf).withColumn("p", F.try_divide(F.col("n").cast("double"), F.col("n_valid")))
    return rows.groupBy("site", "ano").agg(*[F.max(F.when(F.col("classe") == k, F.col("p"))).alias(f"prop_{n}") for k, n in R.CLASSES.items()])


@query("class_distribution", "with d as (select l_suppkey, l_linenumber % 4 as codigo, cast(count(*) as bigint) as n from lineitem group by 1, 2), t as (select *, cast(sum(n) over (partition by l_suppkey) as bigint) as n_total, cast(sum(case when codigo <> 0 then n else 0 end) over (partition by l_suppkey) as bigint) as n_valid from d) select l_suppkey, codigo, n, n_total, n_valid, cast(n as double) * 100 / n_total as pct_total, case when codigo <> 0 and n_valid > 0 then cast(n as double) * 100 / n_valid end as pct_validos from t")
def class_distribution(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_linenumber") % 4).alias("codigo"))
    return R.distribution(li, ["l_suppkey"], "codigo")


@query("valid_percent", "select l_suppkey, cast(count(case when l_linenumber <> 2 then 1 end) as double) * 100 / count(*) as pct_valid from lineitem group by 1")
def valid_percent(spark, sf):
    li = table(spark, sf, "lineitem").select("l_suppkey", F.when(F.col("l_linenumber") != 2, F.col("l_tax")).alias("b"))
    return R.valid_percent(li, ["l_suppkey"], "b")


@query("mean_composite", "select l_suppkey, cast(sum(cast(l_extendedprice as decimal(28,6))) as double) / cast(count(l_extendedprice) as double) * 0.02e0 - 273.15e0 as celsius from lineitem group by 1")
def mean_composite(spark, sf):
    return R.mean_celsius(table(spark, sf, "lineitem"), ["l_suppkey"], "l_extendedprice")


@query("zone_classes", "with h as (select l_suppkey as zone, l_linenumber as code, count(*) / 3e0 as n from lineitem group by 1, 2) select zone, cast(classe as int) as classe, cast(sum(round_even(n, 0)) as bigint) as n from (select zone, n, case when code = 3 then 5 when code = 1 then 1 when code in (2, 4, 5) then 2 when code = 6 then 4 when code = 7 then 3 else 0 end as classe from h) x where classe <> 0 group by 1, 2")
def zone_classes(spark, sf):
    h = table(spark, sf, "lineitem").groupBy(F.col("l_suppkey").alias("zone"), F.col("l_linenumber").alias("code")).agg((F.count("*") / F.lit(3.0)).alias("n"))
    return R.zone_classes(h, R.remap_table("dynamic_world"))


@query("vegetation_check", "with b as (select l_suppkey, l_quantity / 50e0 as red, l_extendedprice / 1e4 as nir from lineitem) select l_suppkey, median(red) as red, median(nir) as nir, cast(count(*) as bigint) as n from b where abs(nir + red) >= 1e-6 and greatest(-1e0, least(1e0, (nir - red) / (nir + red))) > 0.5 group by 1")
def vegetation_check(spark, sf):
    b = table(spark, sf, "lineitem").select("l_suppkey", (F.col("l_quantity") / F.lit(50.0)).alias("red"), (F.col("l_extendedprice") / F.lit(1e4)).alias("nir"))
    return R.vegetation_check(b, ["l_suppkey"])


@query("resampled_codes", "with p as (select cast((c_custkey * 53) % 2000 as double) / 100 as x, cast((c_custkey * 17) % 2000 as double) / 100 as y, c_nationkey as codigo from customer), c as (select *, cast(floor((20e0 - y) / 2e0) as int) as \"row\", cast(floor(x / 2e0) as int) as col from p), d as (select *, (x - (col + 0.5e0) * 2e0) * (x - (col + 0.5e0) * 2e0) + ((20e0 - y) - (\"row\" + 0.5e0) * 2e0) * ((20e0 - y) - (\"row\" + 0.5e0) * 2e0) as d from c where \"row\" between 0 and 9 and col between 0 and 9) select \"row\", col, codigo from (select *, row_number() over (partition by \"row\", col order by d, codigo) as rn from d) x where rn = 1")
def resampled_codes(spark, sf):
    spot = lambda m: (F.col("c_custkey") * m % 2000).cast("double") / F.lit(100.0)
    p = table(spark, sf, "customer").select(spot(53).alias("x"), spot(17).alias("y"), F.col("c_nationkey").alias("codigo"))
    return R.resampled(p, (0.0, 20.0, 2.0, 10, 10), "codigo")


_SHARE = lambda w: f"coalesce(cast(sum(case when mes between {6 - w} and {8 + w} and ok then 1 else 0 end) as double) * 100 / nullif(cast(sum(case when mes between {6 - w} and {8 + w} then 1 else 0 end) as double), 0), 0) as p{w}"


@query("better_window", f"with e as (select o_custkey, cast(month(o_orderdate) as int) as mes, o_totalprice > 50000 as ok from orders), s as (select o_custkey, {_SHARE(0)}, {_SHARE(1)} from e group by 1) select o_custkey, case when p0 < 90 and p1 > p0 then 1 else 0 end as width, case when p0 < 90 and p1 > p0 then p1 else p0 end as pct_valid from s")
def better_window(spark, sf):
    o = table(spark, sf, "orders").select("o_custkey", F.month("o_orderdate").cast("int").alias("mes"), (F.col("o_totalprice") > 50000).alias("ok"))
    return R.better_window(o, ["o_custkey"], "mes", "ok", 6, 8)


@query("similar_wide", f"with {_KNN} select e.vec_id, {', '.join(f'max(case when k.rn = {r} then k.vizinho end) as vizinho_{r}, max(case when k.rn = {r} then k.dist end) as dist_{r}' for r in (1, 2, 3))} from embeddings e left join k on e.vec_id = k.vec_id group by e.vec_id")
def similar_wide(spark, sf):
    e = table(spark, sf, "embeddings").select("vec_id", "label", *[F.get("embedding", k - 1).cast("double").alias(f"x{k}") for k in range(1, 65)])
    return M.similar_wide(e, "vec_id", "label", [f"x{k}" for k in range(1, 65)], 3)


_Z = ", ".join(f"({x} - s{x} / n) / coalesce(nullif(sqrt(greatest(0, q{x} / n - s{x} / n * (s{x} / n))), 0), 1) as z{x}" for x in ("lat", "lon"))


@query("similar_in_country", f"with {PLACES}, t as (select cast(count(*) as double) as n, {', '.join(f'cast(sum(cast({x} as decimal(38,10))) as double) as s{x}, cast(sum(cast({x} * {x} as decimal(38,10))) as double) as q{x}' for x in ('lat', 'lon'))} from places), z as (select id, {_Z} from places cross join t), d as (select a.id, b.id as vizinho, sqrt((a.zlat - b.zlat) * (a.zlat - b.zlat) + (a.zlon - b.zlon) * (a.zlon - b.zlon)) as dist from z a join z b on a.id <> b.id) select id, max(case when rn = 1 then vizinho end) as vizinho_1, max(case when rn = 1 then dist end) as dist_1, max(case when rn = 2 then vizinho end) as vizinho_2, max(case when rn = 2 then dist end) as dist_2 from (select *, row_number() over (partition by id order by dist, vizinho) as rn from d) x group by id")
def similar_in_country(spark, sf):
    return M.similar_wide(places(spark, sf), "id", "nation", ["lat", "lon"], 2, "pais")


@query("similar_coordinates", f"with {PLACES}, {_KNN}, p as (select vec_id % 100 + 1 as a, vizinho % 100 + 1 as b, rn, vec_id from k) select p.vec_id, p.rn, x.lat as lat_origem, x.lon as lon_origem, y.lat as lat_similar, y.lon as lon_similar from p left join places x on p.a = x.id left join places y on p.b = y.id")
def similar_coordinates(spark, sf):
    pairs = knn(spark, sf).select("vec_id", "rn", (F.col("vec_id") % 100 + 1).alias("a"), (F.col("vizinho") % 100 + 1).alias("b"))
    return M.similar_coordinates(pairs, places(spark, sf), "a", "b", "id").drop("a", "b")


@query("homonym_join", "select c_custkey, s_suppkey from customer left join supplier on c_name = replace(s_name, 'Supplier', 'Customer')")
def homonym_join(spark, sf):
    c, s = table(spark, sf, "customer").select("c_custkey", "c_name"), table(spark, sf, "supplier").select("s_suppkey", F.replace("s_name", F.lit("Supplier"), F.lit("Customer")).alias("nome_municipio"))
    return c.join(s, F.col("c_name") == F.col("nome_municipio"), "left").select("c_custkey", "s_suppkey")


@query("keyed_columns", "select o_orderkey, o_totalprice, cast(sum(l_linenumber) as bigint) as linhas from orders left join lineitem on l_orderkey = o_orderkey group by 1, 2")
def keyed_columns(spark, sf):
    own = table(spark, sf, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.sum("l_linenumber").alias("linhas"))
    return table(spark, sf, "orders").select("o_orderkey", "o_totalprice").join(own, "o_orderkey", "left")


@query("cloud_scored", "with i as (select event_id, user_id, ts from events where event_type = 'view'), s as (select user_id, ts, value / 350 as s from events where event_type = 'click'), j as (select i.event_id, s, abs(epoch_us(i.ts) - epoch_us(s.ts)) as g from i join s on i.user_id = s.user_id where abs(epoch_us(i.ts) - epoch_us(s.ts)) <= 86400000000) select event_id, s as cs_cdf from (select *, row_number() over (partition by event_id order by g, s desc) as rn from j) x where rn = 1 and s >= 0.1")
def cloud_scored(spark, sf):
    e = table(spark, sf, "events")
    images = e.where("event_type = 'view'").select("event_id", "user_id", "ts")
    scores = e.where("event_type = 'click'").select("user_id", "ts", (F.col("value") / 350).alias("s"))
    return C.cloud_scored(images, scores, "user_id", "ts", "s", 0.1).select("event_id", "cs_cdf")


@query("season_scenes", "select o_orderkey, cast(year(o_orderdate) as int) as ano from orders where month(o_orderdate) between 5 and 12 and o_orderdate >= timestamp '1997-01-01' and o_orderdate < timestamp '1997-12-31'")
def season_scenes(spark, sf):
    o = table(spark, sf, "orders")
    return C.season(o, "o_orderdate", 1997, 5, 12).select("o_orderkey", F.year("o_orderdate").cast("int").alias("ano"))


@query("label_season", "select o_orderkey, least(cast(year(o_orderdate) as int), 1999) as ano_efetivo, cast(year(o_orderdate) as int) - least(cast(year(o_orderdate) as int), 1999) as distancia from orders where year(o_orderdate) = 2000 and month(o_orderdate) between 5 and 9 and o_orderdate < timestamp '2000-09-30'")
def label_season(spark, sf):
    own, off = C.effective_year(F.year("o_orderdate").cast("int"), 1999)
    return C.season(table(spark, sf, "orders"), "o_orderdate", 2000, 5, 9, F.lit(30)).select("o_orderkey", own.alias("ano_efetivo"), off.alias("distancia"))


@query("exact_or_newest", "select o_custkey, ano, o_orderkey from (select o_custkey, cast(year(o_orderdate) as int) as ano, max(o_orderkey) as o_orderkey, row_number() over (partition by o_custkey order by case when year(o_orderdate) = 1998 then 0 else 1 end, year(o_orderdate) desc) as rn from orders group by o_custkey, year(o_orderdate)) x where rn = 1")
def exact_or_newest(spark, sf):
    o = table(spark, sf, "orders").groupBy("o_custkey", F.year("o_orderdate").cast("int").alias("ano")).agg(F.max("o_orderkey").alias("o_orderkey"))
    return C.exact_or_newest(o, "o_custkey", "ano", 1998, ["o_orderkey"])


@query("newest_image", "select o_custkey, o_orderkey from (select *, row_number() over (partition by o_custkey order by o_orderdate desc, o_orderkey desc) as rn from orders) x where rn = 1")
def newest_image(spark, sf):
    return C.newest(table(spark, sf, "orders"), "o_custkey", "o_orderdate", ["o_orderkey"]).select("o_custkey", "o_orderkey")


@query("painted_biomes", "with z as (select n_nationkey as bioma, n_nationkey * 1.5e0 as west, n_nationkey * 1.5e0 + 3 as east, 0e0 as south, 12.5e0 as north from nation), p as (select distinct cast((c_custkey * 53) % 4000 as double) / 100 as x, cast((c_custkey * 17) % 2000 as double) / 100 as y from customer) select x, y, max(bioma) as bioma from p join z on x >= west and x < east and y >= south and y < north group by 1, 2")
def painted_biomes(spark, sf):
    n = F.col("n_nationkey")
    z = table(spark, sf, "nation").select(n.alias("bioma"), n.alias("ordem"), (n * 1.5).alias("west"), (n * 1.5 + 3).alias("east"), F.lit(0.0).alias("south"), F.lit(12.5).alias("north"))
    spot = lambda m, k: (F.col("c_custkey") * m % k).cast("double") / F.lit(100.0)
    p = table(spark, sf, "customer").select(spot(53, 4000).alias("x"), spot(17, 2000).alias("y")).distinct()
    return C.painted(z, p, "bioma", 5.0)


@query("monthly_by_class", "select cast(year(o_orderdate) as int) as ano, cast(month(o_orderdate) as int) as mes, c_mktsegment, r_name, cast(sum(cast(o_totalprice as decimal(28,6))) as double) as valor from orders join customer on o_custkey = c_custkey join nation on c_nationkey = n_nationkey left join region on n_regionkey = r_regionkey where year(o_orderdate) between 1996 and 1999 group by 1, 2, 3, 4")
def monthly_by_class(spark, sf):
    o, c, n, r = (table(spark, sf, t) for t in ("orders", "customer", "nation", "region"))
    j = o.join(c, F.col("o_custkey") == F.col("c_custkey")).join(n, F.col("c_nationkey") == F.col("n_nationkey")).join(r, F.col("n_regionkey") == F.col("r_regionkey"), "left")
    return C.monthly(j, "o_orderdate", ["c_mktsegment", "r_name"], V.exact_sum(F.col("o_totalprice")), 1996, 1999)


@query("sensor_years", "select s_suppkey, y as ano from (select s_suppkey, unnest([2016, 2017, 2018] || case when s_suppkey % 2 = 0 then [2019] else [] end) as y from supplier) x where y >= 2017")
def sensor_years(spark, sf):
    years = F.create_map(F.lit("s2"), F.lit([2022]), F.lit("landsat"), F.when(F.col("s_suppkey") % 2 == 0, F.lit([2016, 2017, 2018, 2019])).otherwise(F.lit([2016, 2017, 2018])))
    return table(spark, sf, "supplier").select("s_suppkey", F.explode(C.sensor_years(years, "landsat")).alias("ano")).where("ano >= 2017")


@query("sort_orders", "select c_custkey, row_number() over (partition by c_nationkey order by b nulls first, c_custkey) as nulos_antes, row_number() over (partition by c_nationkey order by b desc nulls last, c_custkey) as nulos_depois, row_number() over (partition by c_nationkey order by abs(c_acctbal), c_custkey) as modulo, row_number() over (partition by c_nationkey order by c_mktsegment <> 'BUILDING', -c_acctbal, c_custkey) as composta, row_number() over (partition by c_nationkey order by coalesce(nullif(p, ''), c_name), c_custkey) as par, row_number() over (partition by c_nationkey order by c_mktsegment, c_acctbal desc, c_custkey) as mista from (select *, case when c_custkey % 3 <> 0 then c_acctbal end as b, case when c_custkey % 2 = 0 then '' else c_mktsegment end as p from customer) x")
def sort_orders(spark, sf):
    c = table(spark, sf, "customer").withColumn("b", F.when(F.col("c_custkey") % 3 != 0, F.col("c_acctbal"))).withColumn("p", F.when(F.col("c_custkey") % 2 == 0, "").otherwise(F.col("c_mktsegment")))
    at = lambda *o: C.ranked(c, "c_nationkey", *o, F.col("c_custkey"))
    return c.select("c_custkey", at(F.asc_nulls_first("b")).alias("nulos_antes"), at(F.desc_nulls_last("b")).alias("nulos_depois"), at(F.abs("c_acctbal")).alias("modulo"), at(F.col("c_mktsegment") != "BUILDING", -F.col("c_acctbal")).alias("composta"), at(F.coalesce(F.nullif("p", F.lit("")), "c_name")).alias("par"), at(F.col("c_mktsegment"), F.desc("c_acctbal")).alias("mista"))


@query("ranking_bottom10", "select c_nationkey, cast(sum(cast(c_acctbal as decimal(28,6))) as double) / cast(count(c_acctbal) as double) as media from customer group by 1 order by media desc, c_nationkey limit 10")
def ranking_bottom10(spark, sf):
    return table(spark, sf, "customer").groupBy("c_nationkey").agg(V.exact_avg(F.col("c_acctbal")).alias("media")).orderBy(F.desc_nulls_last("media"), "c_nationkey").limit(10)


@query("band_contract", "select conv_id, list_sort(list(distinct role)) = ['assistant', 'user'] as completo from conversations group by 1")
def band_contract(spark, sf):
    return table(spark, sf, "conversations").groupBy("conv_id").agg((F.array_sort(F.collect_set("role")) == F.array(F.lit("assistant"), F.lit("user"))).alias("completo"))


@query("year_range", "select o_orderkey from orders where cast(year(o_orderdate) as int) between 1996 and 1998")
def year_range(spark, sf):
    return table(spark, sf, "orders").where(F.year("o_orderdate").between(1996, 1998)).select("o_orderkey")


@query("manifest_catalog", "select 'site-' || s_suppkey as site_id, cast(2013 + s_suppkey % 12 as int) as ano, case when s_suppkey % 2 = 0 then 'sentinel2' else 'landsat' end as sensor, case when s_suppkey % 2 = 0 then 's2' else 'landsat' end as sensor_token, 'classificado/' || s_suppkey as raster from supplier where s_suppkey % 3 <> 0")
def manifest_catalog(spark, sf):
    k = F.col("s_suppkey")
    found = table(spark, sf, "supplier").select(F.concat(F.lit("site-"), k).alias("site_id"), F.when(k % 2 == 0, "s2").otherwise("landsat").alias("sensor"), (F.lit(2013) + k % 12).cast("int").alias("ano"), F.when(k % 3 == 0, "rf_v1").otherwise("rf_v2").alias("modelo_versao"), F.concat(F.lit("classificado/"), k).alias("raster"))
    return S.catalog(found, "rf_v2", token="classificado", rasters=found.select("raster")).select("site_id", "ano", "sensor", "sensor_token", "raster")


@query("extraction_log", "select cast(count(*) as bigint) as n, cast(sum(case when value > 300 then 1 else 0 end) as bigint) as sem_valor, min(case when value <= 300 then value end) as minimo, max(case when value <= 300 then value end) as maximo, cast(sum(case when value <= 300 and not value between 10 and 50 then 1 else 0 end) as bigint) as fora_da_faixa, cast(sum(case when user_id % 40 < 20 then 1 else 0 end) as bigint) as poucas_cenas from events")
def extraction_log(spark, sf):
    e = table(spark, sf, "events").select(F.when(F.col("value") <= 300, F.col("value")).alias("v"), (F.col("user_id") % 40).alias("c"))
    return S.extraction_log(e, "v", 10, 50, 20, "c")


@query("discard_log", "select o_custkey, 'pequeno' as motivo, cast(count(*) as bigint) as n from orders where o_totalprice < 50000 group by 1")
def discard_log(spark, sf):
    o = table(spark, sf, "orders").withColumn("motivo", F.when(F.col("o_totalprice") < 50000, "pequeno"))
    return S.discards(o, "motivo", ["o_custkey"])


@query("class_changes", f"with {_GRID}, {_HIST} select site, cast(classe as int) as classe, antes, depois, depois - antes as delta from (select site, classe, max(case when ano = 1996 then cast(n as bigint) end) as antes, max(case when ano = 2000 then cast(n as bigint) end) as depois from h where ano in (1996, 2000) group by 1, 2) x where antes is not null and depois is not null")
def class_changes(spark, sf):
    return S.changes(classes(spark, sf), ["site", "classe"], "ano", "n", 1996, 2000)


@query("campus_tags", "with t as (select o_custkey as campus, o_orderkey as pos, unnest(['prioridade', 'estado']) as tag, unnest([case when o_orderkey % 3 = 0 then '' else o_orderpriority end, o_orderstatus]) as valor from orders) select campus, tag, valor from (select *, row_number() over (partition by campus, tag order by pos desc) as rn from t where valor <> '') x where rn = 1")
def campus_tags(spark, sf):
    tags = F.create_map(F.lit("prioridade"), F.when(F.col("o_orderkey") % 3 == 0, "").otherwise(F.col("o_orderpriority")), F.lit("estado"), F.col("o_orderstatus"))
    return G.campus_tags(table(spark, sf, "orders").select(F.col("o_custkey").alias("campus"), F.col("o_orderkey").alias("pos"), tags.alias("tags")))


@query("campus_numbers", f"with recursive {PLACES}, l as (select a.id as a, b.id as b from places a join places b on a.id <> b.id and 12742e0 * asin(sqrt(least(1e0, pow(sin(radians(b.lat - a.lat) / 2e0), 2e0) + cos(radians(a.lat)) * cos(radians(b.lat)) * pow(sin(radians(b.lon - a.lon) / 2e0), 2e0)))) < 60e0), r as (select id, id as o from places union select r.id, l.b from r join l on r.o = l.a), c as (select id, min(o) as campus from r group by id) select id, cast(dense_rank() over (order by campus) as bigint) as numero from c")
def campus_numbers(spark, sf):
    p = places(spark, sf)
    own = p.select("id").join(G.components(G.proximity(p, 60.0)), "id", "left").select("id", F.coalesce("component", "id").alias("campus"))
    names = numbered(own.select("campus").distinct(), ["campus"])
    return own.join(names, "campus").select("id", (F.col("place") + 1).alias("numero"))


@query("mean_centre", f"with {PLACES} select {avg('lat')}, {avg('lon')} from places")
def mean_centre(spark, sf):
    return places(spark, sf).agg(V.exact_avg(F.col("lat")).alias("lat"), V.exact_avg(F.col("lon")).alias("lon"))


@query("years_by_site", "select o_custkey, array_to_string(list_sort(list(distinct cast(year(o_orderdate) as int))), ',') as anos from orders group by 1")
def years_by_site(spark, sf):
    return table(spark, sf, "orders").groupBy("o_custkey").agg(F.array_join(F.array_sort(F.collect_set(F.year("o_orderdate"))), ",").alias("anos"))


@query("l1_before_event", f"with {PANEL}, s as (select site, pair, tipo, h, v_n / (v_n + 100) as s0, 100 / (v_n + 100) as s1 from panel where h < 0), a as (select pair, {', '.join(avg(f'case when tipo = {chr(39)}{t}{chr(39)} then s{k} end', f'{t[0]}{k}') for t in ('tratamento', 'controle') for k in (0, 1))} from s group by pair), l as (select pair, round_even(abs(t0 - c0) + abs(t1 - c1), 6) as l1 from a) select pair, l1, case when l1 <= 0.10 then 'bom' when l1 <= 0.20 then 'aceitavel' else 'ruim' end as qualidade from l where l1 is not null")
def l1_before_event(spark, sf):
    p = panel(spark, sf).withColumns({"s0": F.col("v_n") / (F.col("v_n") + 100), "s1": F.lit(100) / (F.col("v_n") + 100)})
    return M.pair_distance(p, ["s0", "s1"], before=True).withColumn("qualidade", V.pair_quality(F.col("l1")))


@query("geocode_answers", "select s_suppkey, case when s_suppkey % 5 = 0 then 'ERRO' when s_suppkey % 3 = 0 then 'ZERO_RESULTS' else 'OK' end as status_geocode, case when s_suppkey % 5 <> 0 and s_suppkey % 3 <> 0 then s_name end as endereco, case when s_suppkey % 5 <> 0 and s_suppkey % 3 <> 0 then 'cidade ' || s_nationkey end as municipio from supplier")
def geocode_answers(spark, sf):
    from sitelens.operators import nested as N

    k = F.col("s_suppkey")
    good = F.concat(F.lit('{"status": "OK", "results": [{"formatted_address": "'), "s_name", F.lit('", "address_components": [{"long_name": "cidade '), "s_nationkey", F.lit('", "types": ["locality", "political"]}]}]}'))
    answer = F.when(k % 5 == 0, F.lit("<html>")).when(k % 3 == 0, F.lit('{"status": "ZERO_RESULTS", "results": []}')).otherwise(good)
    parts = table(spark, sf, "supplier").select("s_suppkey", K.geocode_parts(answer).alias("g"))
    return parts.select("s_suppkey", "g.status_geocode", "g.endereco", N.municipality(F.col("g.partes")).alias("municipio"))


@query("census_answers", "select s_suppkey, case when s_suppkey % 4 <> 0 then 'condado ' || s_nationkey end as municipio, case when s_suppkey % 4 <> 0 then '06' || lpad(cast(s_nationkey as varchar), 3, '0') end as fips, case when s_suppkey % 4 <> 0 then s_suppkey * 1000 end as populacao from supplier")
def census_answers(spark, sf):
    k = F.col("s_suppkey")
    county = F.concat(F.lit('{"result": {"geographies": {"Counties": [{"NAME": "condado '), "s_nationkey", F.lit('", "STATE": "06", "COUNTY": "'), F.lpad(F.col("s_nationkey").cast("string"), 3, "0"), F.lit('"}], "States": [{"NAME": "California"}]}}}'))
    rows = table(spark, sf, "supplier").select(k, K.census_parts(F.when(k % 4 != 0, county).otherwise("{}")).alias("c"), K.population_answer(F.when(k % 4 != 0, F.concat(F.lit('[["B01003_001E"], ["'), k * 1000, F.lit('"]]'))).otherwise("[]")).alias("populacao"))
    return rows.select("s_suppkey", "c.municipio", "c.fips", "populacao")


@query("changed_inputs", "select o_orderkey from orders where o_orderkey % 3 <> 0 or o_orderkey % 2 = 1")
def changed_inputs(spark, sf):
    o = table(spark, sf, "orders").select("o_orderkey", F.sha2(F.concat_ws("|", "o_orderkey", "o_orderpriority"), 256).alias("sha256"))
    done = o.where("o_orderkey % 3 = 0").withColumn("sha256", F.when(F.col("o_orderkey") % 2 == 0, F.col("sha256")).otherwise("old"))
    return I.changed(o, done, ["o_orderkey"]).select("o_orderkey")


@query("stream_daily_means", "select strftime(ts, '%Y-%m-%d') as dia, event_type, cast(sum(cast(value as decimal(28,6))) as double) / cast(count(value) as double) as mean_v, cast(count(value) as bigint) as n from events group by 1, 2")
def stream_daily_means(spark, sf):
    schema = table(spark, sf, "events").schema
    zone = spark.conf.get("spark.sql.session.timeZone")
    spark.conf.set("spark.sql.session.timeZone", "UTC")  # days are those of the table's local times
    try:
        events = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).option("pathGlobFilter", "events.parquet").parquet(sf)
        found = I.drained(I.daily_means(events), f"daily-{uuid.uuid4().hex}")
        return settle(found.select(F.date_format("window.start", "yyyy-MM-dd").alias("dia"), "event_type", "mean_v", "n"))
    finally:
        spark.conf.set("spark.sql.session.timeZone", zone)
