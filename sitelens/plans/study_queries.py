"""Queries of lookups, joins by name and in time, thinning of whole tables, and the second stage's models."""

from __future__ import annotations

from pyspark.sql import functions as F

from sitelens.functions import text as X
from sitelens.operators import effects as E
from sitelens.operators import impact as I
from sitelens.operators import match as M
from sitelens.operators import records as D
from sitelens.plans.panel_queries import BASE, DELTA, NET, PANEL, VARS, panel, table
from sitelens.plans.registry import query
from sitelens.plans.table_queries import PLACES, _hav, places
from sitelens.sources import collections as C

_MEAN = lambda t, v: f"round(cast(sum(cast(case when tipo = '{t}' then {v} end as decimal(28,6))) as double) / cast(count(case when tipo = '{t}' then {v} end) as double), 3)"


@query("means_by_type_wide", f"with {PANEL} " + " union all ".join(f"select '{v}' as variavel, {_MEAN('tratamento', v)} as tratamento, {_MEAN('controle', v)} as controle from panel" for v in VARS))
def means_by_type_wide(spark, sf):
    return I.transposed(I.means(panel(spark, sf), ["tipo"], VARS), "tipo", VARS, ["tratamento", "controle"], 3)


_STATES = "states as (select * from (values " + ", ".join(f"('{k}', '{v}')" for k, v in X.STATE_NUMBERS.items()) + ") t(numero, uf)), regions as (select * from (values " + ", ".join(f"('{u}', '{r}')" for r, own in X.REGIONS.items() for u in own) + ") t(uf, regiao))"
_COUNTY = "right('0' || cast(s_suppkey % 60 as varchar), 2) || case when s_suppkey % 7 = 0 then '1' else '001' end"


@query("state_regions", f"with {_STATES}, c as (select s_suppkey, {_COUNTY} as codigo from supplier) select s_suppkey, codigo, coalesce(s.uf, '') as uf, coalesce(r.regiao, '') as regiao from c left join states s on length(codigo) = 5 and substr(codigo, 1, 2) = numero left join regions r on r.uf = s.uf")
def state_regions(spark, sf):
    code = F.concat(F.format_string("%02d", F.col("s_suppkey") % 60), F.when(F.col("s_suppkey") % 7 == 0, "1").otherwise("001"))
    c = table(spark, sf, "supplier").select("s_suppkey", code.alias("codigo")).withColumn("uf", X.state_of(county=F.col("codigo")))
    return c.withColumn("regiao", X.census_region(F.col("uf")))


_FOLD = lambda c: f"regexp_replace(lower(strip_accents(trim({c}))), '[^\\x00-\\x7F]', '', 'g')"


@query("name_join", f"""with w as (select doc_id, lang, unnest(string_split(text, ' ')) as nome from documents), p as (select item_id, ['en', 'fr', 'de', 'es'][cast(item_id % 4 + 1 as int)] as lang, unnest(string_split(text, ' ')) as nome from benchmark),
 k as (select {_FOLD('nome')} as n, lang, min(item_id) as item_id from p where lang is not null group by 1, 2), j as (select doc_id, item_id, k.n is not null as found from w left join k on {_FOLD('w.nome')} = k.n and w.lang = k.lang and k.n <> '')
 select doc_id, count(*) filter (where found) as achados, count(*) filter (where not found) as perdidos, cast(sum(item_id) as bigint) as itens from j group by 1""")
def name_join(spark, sf):
    """Words of documents as names, their language as the state; words of the benchmark as places."""
    w = table(spark, sf, "documents").select("doc_id", "lang", F.explode(F.split("text", " ")).alias("nome"))
    p = table(spark, sf, "benchmark").select("item_id", F.element_at(F.array(*map(F.lit, ("en", "fr", "de", "es"))), (F.col("item_id") % 4 + 1).cast("int")).alias("lang"), F.explode(F.split("text", " ")).alias("nome"))
    met = D.name_join(w, p, "nome", "lang", ["item_id"])
    return met.groupBy("doc_id").agg(F.count(F.when(F.col("found"), 1)).alias("achados"), F.count(F.when(~F.col("found"), 1)).alias("perdidos"), F.sum("item_id").alias("itens"))


@query("nearest_click", "with v as (select event_id, user_id, ts from events where event_type = 'view'), c as (select user_id, ts, max(value) as value from events where event_type = 'click' group by 1, 2), j as (select event_id, value, abs(epoch_us(v.ts) - epoch_us(c.ts)) as gap from v join c using (user_id)), b as (select * from (select *, row_number() over (partition by event_id order by gap, value desc) as rn from j) x where rn = 1) select v.event_id, b.value, b.gap from v left join b using (event_id)")
def nearest_click(spark, sf):
    e = table(spark, sf, "events")
    near = C.nearest_in_time(e.where("event_type = 'view'").select("event_id", "user_id", "ts"), e.where("event_type = 'click'"), "user_id", "ts", "value")
    return near.select("event_id", F.col("_near").alias("value"), F.col("_gap").alias("gap"))


@query("thinned_whole", f"""with recursive {PLACES}, o as (select *, row_number() over (order by (id * 7919) % 1009, id) as i from places),
 g as (select cast(0 as bigint) as i, cast([] as struct(id bigint, lat double, lon double)[]) as kept union all
 select o.i, case when len(list_filter(kept, lambda k: {_hav('k.lat', 'k.lon', 'o.lat', 'o.lon')} < 60e0)) = 0 then list_append(kept, struct_pack(id := o.id, lat := o.lat, lon := o.lon)) else kept end from g join o on o.i = g.i + 1),
 f as (select unnest(kept) as k, unnest(range(0, len(kept))) as place from g where i = (select max(i) from o)) select cast(place as int) as place, k.id as id, k.lat as lat, k.lon as lon from f""")
def thinned_whole(spark, sf):
    """All that greedy thinning keeps, without a limit."""
    return M.thinned(places(spark, sf), (F.col("id") * 7919) % 1009, 60.0)


_LEFT_OUT = f"""with {PANEL}, {BASE}, {DELTA}, {NET}, e as (select *, cast(dense_rank() over (order by pair) - 1 as int) as fold from net where h between 0 and 2 and efeito is not null),
 s as (select variavel, h, fold, sum(cast(efeito as decimal(28,6))) as s, count(*) as n from e group by 1, 2, 3), t as (select variavel, h, sum(s) as s, sum(n) as n from s group by 1, 2),
 b as (select s.variavel, s.h, s.fold, case when t.n > s.n then cast(t.s - s.s as double) / cast(t.n - s.n as double) end as ingenuo from s join t using (variavel, h))"""


def effects(spark, sf):
    return I.net_effect(panel(spark, sf), VARS).where(F.col("h").isin(*E.HORIZONS))


@query("effect_folds", f"{_LEFT_OUT} select e.pair, e.h, e.variavel, e.efeito, e.fold, b.ingenuo from e join b using (variavel, h, fold)")
def effect_folds(spark, sf):
    return E.naive(E.folds(effects(spark, sf).where("efeito is not null"), "pair"), ["variavel", "h"], "efeito")


@query("effect_model")
def effect_model(spark, sf):
    """What a forest expects of the pairs it has not seen, by their size and region before the event, beside the mean of the other pairs."""
    p = panel(spark, sf).where("h < 0")
    size = p.where("tipo = 'tratamento'").groupBy("pair").agg(F.avg("v_sum").alias("porte"), F.avg("v_n").alias("pedidos"), F.max(F.col("site") % 5).cast("string").alias("regiao"))
    rows = effects(spark, sf).where("variavel = 'v_avg'").join(size, "pair", "left")
    found = E.left_out(rows, ["variavel", "h"], ["porte", "pedidos", "h"], ["regiao"], "efeito", "pair", trees=20)
    return E.errors(found, ["variavel", "h"], "efeito")



@query("one_collection", "with v as (select event_id, user_id, ts, value from events where event_type = 'view'), c as (select user_id, ts, max(value / 350) as s from events where event_type = 'click' group by 1, 2), j as (select v.event_id, s, abs(epoch_us(v.ts) - epoch_us(c.ts)) as g from v join c using (user_id)), b as (select * from (select *, row_number() over (partition by event_id order by g, s desc) as rn from j) x where rn = 1 and g <= 86400000000 and s >= 0.1) select event_id, 'sentinel2' as sensor, round(value * 10 / 10000e0 * 0.9765e0 + 0.0009e0, 11) as red, round(value * 30 / 10000e0 * 0.9983e0 - 0.0001e0, 11) as nir from v join b using (event_id) union all select event_id, 'landsat', round(value * 10 * 0.0000275e0 - 0.2e0, 11), round(value * 30 * 0.0000275e0 - 0.2e0, 11) from events where event_type not in ('view', 'click') and event_id & 30 = 0 and event_id % 3 = 0")
def one_collection(spark, sf):
    """Views as the newer sensor's images, clicks as cloud scores, other events as the older sensor's images."""
    e = table(spark, sf, "events").withColumns({"red": F.col("value") * 10, "nir": F.col("value") * 30})
    older = e.where("event_type not in ('view', 'click')").withColumns({"qa_pixel": F.col("event_id"), "qa_radsat": F.col("event_id") % 3})
    scores = e.where("event_type = 'click'").select("user_id", "ts", (F.col("value") / 350).alias("s"))
    # each image is named by its own id, and scored by its user's clicks
    newer = C.cloud_scored(e.where("event_type = 'view'"), scores, "user_id", "ts", "s", 0.1).select(F.col("event_id"), "ts", "red", "nir")
    every = newer.select("event_id", "ts", F.lit(1.0).alias("s"))
    out = C.both_sensors(newer, every, older, "event_id", "ts", "s", ["red", "nir"])
    return out.select("event_id", "sensor", F.round("red", 11).alias("red"), F.round("nir", 11).alias("nir"))


@query("label_bands", "with w as (select l_partkey, max(case when year(l_shipdate) = 1997 then l_linenumber end) as a, max(case when year(l_shipdate) = 1998 then l_linenumber end) as b, max(case when year(l_shipdate) = 1999 then l_linenumber end) as c from lineitem group by 1), y as (select unnest([1996, 1997, 1998, 1999, 2000, 2001]) as ano) select l_partkey, cast(ano as int) as ano, cast(case least(ano, 1999) when 1997 then a when 1998 then b when 1999 then c end as int) as codigo from w cross join y")
def label_bands(spark, sf):
    """Labels with one band a year: each year takes its own band, years after the last one the last."""
    at = lambda y: F.max(F.when(F.year("l_shipdate") == y, F.col("l_linenumber"))).cast("int").alias(f"classification_{y}")
    w = table(spark, sf, "lineitem").groupBy("l_partkey").agg(*[at(y) for y in (1997, 1998, 1999)])
    spread = w.withColumn("ano", F.explode(F.sequence(F.lit(1996), F.lit(2001))))
    return spread.select("l_partkey", "ano", C.year_band(w, "classification_", F.col("ano"), 1999).cast("int").alias("codigo"))


@query("null_key_merge", "with c as (select c_custkey, case when c_nationkey % 4 <> 0 then c_nationkey end as k from customer), n as (select n_name, case when n_nationkey > 2 then n_nationkey end as k from nation) select c_custkey, n_name, coalesce(c.k, n.k) as k from c full outer join n on c.k is not distinct from n.k")
def null_key_merge(spark, sf):
    """Customers and nations by a key that both sides sometimes lack: null meets null."""
    c = table(spark, sf, "customer").select("c_custkey", F.when(F.col("c_nationkey") % 4 != 0, F.col("c_nationkey")).alias("k"))
    n = table(spark, sf, "nation").select("n_name", F.when(F.col("n_nationkey") > 2, F.col("n_nationkey")).alias("k"))
    return D.merged(c, n, ["k"], "full").select("c_custkey", "n_name", "k")
