"""Queries over the panel of nations: orders by customer's nation and year around 1998."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.functions import values as V
from sitelens.operators import impact as I
from sitelens.operators import nested as N
from sitelens.plans.registry import query

VARS = ["v_avg", "v_sum", "v_n"]
DELTAS = [f"delta_{v}" for v in VARS]


def table(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def panel(spark: SparkSession, sf: str) -> DataFrame:
    o = table(spark, sf, "orders").select("o_custkey", "o_totalprice", F.year("o_orderdate").cast("int").alias("ano"))
    c = table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("site"))
    price = F.sum(F.col("o_totalprice").cast("decimal(18,2)")).cast("double")
    out = o.join(c, F.col("o_custkey") == F.col("c_custkey")).groupBy("site", "ano").agg(price.alias("v_sum"), F.count("*").cast("double").alias("v_n"))
    out = out.withColumn("v_avg", F.col("v_sum") / F.col("v_n")).withColumn("h", F.col("ano") - 1998)
    out = out.withColumn("tipo", F.when(F.col("site") % 2 == 0, "tratamento").otherwise("controle")).withColumn("pair", F.expr("int(site div 2)"))
    return out.withColumn("fase", V.phase(F.col("h")))


PANEL = """panel as (select *, v_sum / v_n as v_avg, ano - 1998 as h, case when site % 2 = 0 then 'tratamento' else 'controle' end as tipo, cast(floor(site / 2) as int) as pair,
 case when ano < 1998 then 'pre' when ano <= 1999 then 'durante' else 'pos' end as fase
 from (select c_nationkey as site, cast(year(o_orderdate) as int) as ano, cast(sum(cast(o_totalprice as decimal(18,2))) as double) as v_sum, cast(count(*) as double) as v_n from orders join customer on o_custkey = c_custkey group by 1, 2) x)"""
BASE = """base as (select site, h as base_h, v_avg as base_v_avg, v_sum as base_v_sum, v_n as base_v_n from (select *, row_number() over (partition by site order by case when h < 0 then 0 else 1 end, case when h < 0 then -h else h end) as rn from panel) x where rn = 1)"""
DELTA = """delta as (select p.*, v_avg - base_v_avg as delta_v_avg, v_sum - base_v_sum as delta_v_sum, v_n - base_v_n as delta_v_n from panel p join base b on p.site = b.site)"""


def avg(c: str, name: str | None = None) -> str:
    return f"cast(sum(cast({c} as decimal(28,6))) as double) / cast(count({c}) as double) as {name or c}"


AVGS = ", ".join(avg(c) for c in DELTAS)
NET = f"""m as (select pair, h, tipo, {AVGS} from delta group by pair, h, tipo), n as (select t.pair, t.h, t.delta_v_avg - c.delta_v_avg as v_avg, t.delta_v_sum - c.delta_v_sum as v_sum, t.delta_v_n - c.delta_v_n as v_n from m t join m c on t.pair = c.pair and t.h = c.h where t.tipo = 'tratamento' and c.tipo = 'controle'),
 net as (select pair, h, 'v_avg' as variavel, v_avg as efeito from n union all select pair, h, 'v_sum', v_sum from n union all select pair, h, 'v_n', v_n from n)"""
WITH = f"with {PANEL}, {BASE}, {DELTA}"


@query("panel_overview_counts", f"with {PANEL} select tipo, cast(count(*) as bigint) as n_rows, cast(count(distinct site) as bigint) as n_sites, cast(sum(case when fase = 'pre' then 1 else 0 end) as bigint) as pre, cast(sum(case when fase = 'durante' then 1 else 0 end) as bigint) as durante, cast(sum(case when fase = 'pos' then 1 else 0 end) as bigint) as pos from panel group by tipo")
def panel_overview_counts(spark, sf):
    p = panel(spark, sf)
    cross = p.groupBy("tipo").pivot("fase", ["pre", "durante", "pos"]).count().fillna(0)
    return p.groupBy("tipo").agg(F.count("*").alias("n_rows"), F.count_distinct("site").alias("n_sites")).join(cross, "tipo")


_NULL_COLUMNS = ["c_custkey", "c_name", "c_acctbal", "o_orderkey", "o_totalprice", "o_orderdate"]


@query("null_share_by_column", "with j as (select c_custkey, c_name, c_acctbal, o_orderkey, o_totalprice, o_orderdate from customer left join orders on c_custkey = o_custkey) select * from (" + " union all ".join(f"select '{c}' as variavel, cast(sum(case when {c} is null then 1 else 0 end) as double) * 100 / count(*) as pct_null from j" for c in _NULL_COLUMNS) + ") x order by pct_null desc, variavel limit 15")
def null_share_by_column(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    return I.null_shares(c.join(o, F.col("c_custkey") == F.col("o_custkey"), "left").select(*_NULL_COLUMNS))


@query("means_by_type", f"with {PANEL} select tipo, {', '.join(avg(v) for v in VARS)} from panel group by tipo")
def means_by_type(spark, sf):
    return I.means(panel(spark, sf), ["tipo"], VARS)


@query("baseline_by_site", f"with {PANEL}, {BASE} select * from base")
def baseline_by_site(spark, sf):
    return I.baseline(panel(spark, sf), VARS)


@query("panel_deltas", f"{WITH} select site, ano, h, tipo, pair, {', '.join(DELTAS)} from delta")
def panel_deltas(spark, sf):
    return I.deltas(panel(spark, sf), VARS).select("site", "ano", "h", "tipo", "pair", *DELTAS)


@query("event_study", f"{WITH} select h, tipo, {AVGS} from delta group by h, tipo")
def event_study(spark, sf):
    return I.means(I.deltas(panel(spark, sf), VARS), ["h", "tipo"], DELTAS)


@query("placebo_pre", f"{WITH} select tipo, {AVGS} from delta where h < 0 group by tipo")
def placebo_pre(spark, sf):
    return I.means(I.deltas(panel(spark, sf), VARS).where("h < 0"), ["tipo"], DELTAS)


def _did(v: str) -> str:
    cell = lambda t, p: f"cast(sum(case when tipo = '{t}' and fase = '{p}' then cast({v} as decimal(28,6)) end) as double) / cast(count(case when tipo = '{t}' and fase = '{p}' then {v} end) as double)"
    return f"select '{v}' as variavel, ({cell('tratamento', 'pos')} - {cell('tratamento', 'pre')}) - ({cell('controle', 'pos')} - {cell('controle', 'pre')}) as did from panel"


@query("did_2x2", f"with {PANEL} " + " union all ".join(map(_did, VARS)))
def did_2x2(spark, sf):
    return I.did(panel(spark, sf), VARS)


@query("ranking_top10", f"{WITH} select site, {avg('delta_v_avg', 'media')} from delta where tipo = 'tratamento' and fase = 'pos' group by site order by media, site limit 10")
def ranking_top10(spark, sf):
    rows = I.deltas(panel(spark, sf), VARS).where("tipo = 'tratamento' and fase = 'pos'")
    return I.means(rows, ["site"], ["delta_v_avg"]).withColumnRenamed("delta_v_avg", "media").orderBy(F.asc_nulls_last("media"), "site").limit(10)


_NUMBERS = ["l_quantity", "l_extendedprice", "l_discount", "l_tax"]


def _corr(a: str, b: str) -> str:
    d = lambda x: f"cast(sum(cast({x} as decimal(38,6))) as double)"
    n = "cast(count(*) as double)"
    return f"select '{a}' as a, '{b}' as b, ({n} * {d(f'{a} * {b}')} - {d(a)} * {d(b)}) / (sqrt({n} * {d(f'{a} * {a}')} - {d(a)} * {d(a)}) * sqrt({n} * {d(f'{b} * {b}')} - {d(b)} * {d(b)})) as r from lineitem"


@query("corr_matrix", " union all ".join(_corr(a, b) for a in _NUMBERS for b in _NUMBERS))
def corr_matrix(spark, sf):
    return I.correlations(table(spark, sf, "lineitem"), _NUMBERS)


@query("net_effect_pairs", f"{WITH}, {NET} select * from net")
def net_effect_pairs(spark, sf):
    return I.net_effect(panel(spark, sf), VARS)


_SD = "case when count(efeito) > 1 then sqrt(greatest(0, (cast(sum(cast(efeito * efeito as decimal(38,6))) as double) - cast(sum(cast(efeito as decimal(28,6))) as double) * cast(sum(cast(efeito as decimal(28,6))) as double) / cast(count(efeito) as double)) / (cast(count(efeito) as double) - 1))) end"


@query("net_effect_curve", f"{WITH}, {NET} select *, desvio_padrao / sqrt(cast(n_pares as double)) as erro_padrao from (select variavel, h, {avg('efeito', 'media')}, median(efeito) as mediana, {_SD} as desvio_padrao, cast(count(efeito) as bigint) as n_pares from net group by variavel, h) x")
def net_effect_curve(spark, sf):
    return I.curve(I.net_effect(panel(spark, sf), VARS))


@query("net_effect_pre_bias", f"{WITH}, {NET}, c as (select variavel, h, {avg('efeito', 'media')} from net where h < 0 group by variavel, h) select variavel, {avg('media', 'media_pre')} from c group by variavel order by abs(media_pre)")
def net_effect_pre_bias(spark, sf):
    c = I.curve(I.net_effect(panel(spark, sf), VARS)).where("h < 0")
    return c.groupBy("variavel").agg(V.exact_avg(F.col("media")).alias("media_pre")).orderBy(F.abs("media_pre"))


@query("trend_slope", f"with {PANEL}, s as (select site, cast(count(*) as double) as n, cast(sum(cast(h as decimal(38,6))) as double) as sx, cast(sum(cast(v_avg as decimal(38,6))) as double) as sy, cast(sum(cast(h * v_avg as decimal(38,6))) as double) as sxy, cast(sum(cast(h * h as decimal(38,6))) as double) as sxx from panel where h < 0 group by site) select site, case when n * sxx - sx * sx <> 0 then (n * sxy - sx * sy) / (n * sxx - sx * sx) end as slope from s")
def trend_slope(spark, sf):
    return I.slope(panel(spark, sf).where("h < 0"), "site", "h", "v_avg")


def _change(v: str, name: str, least: str) -> str:
    return f"""{name}_r as (select site, ano, row_number() over w as rn, count(*) over (partition by site) as n, sum(cast({v} as decimal(28,6))) over (partition by site order by ano rows between unbounded preceding and 1 preceding) as s, sum(cast({v} as decimal(28,6))) over (partition by site) as t from panel window w as (partition by site order by ano)),
 {name}_d as (select *, cast(t - s as double) / (n - rn + 1) - cast(s as double) / (rn - 1) as step from {name}_r where rn > 2 and n - rn + 1 >= 2), {name}_b as (select * from (select *, row_number() over (partition by site order by step desc, ano) as k from {name}_d) x where k = 1),
 {name} as (select p.site, case when step >= {least} then b.ano end as ano_degrau, step as degrau, case when step >= {least} then 'datado' else 'sem_degrau' end as situacao from (select distinct site from panel) p left join {name}_b b on p.site = b.site)"""


@query("change_point", f"with {PANEL}, {_change('v_avg', 'c', '500')} select * from c")
def change_point(spark, sf):
    return I.change_points(panel(spark, sf), "site", "ano", "v_avg", least=500.0)


@query("dating_validation", f"with {PANEL}, {_change('v_avg', 'c', '0')}, {_change('v_n', 'd', '0')}, e as (select cast(c.ano_degrau - d.ano_degrau as double) as erro from c join d on c.site = d.site) select cast(count(*) as bigint) as comparados, cast(count(erro) as bigint) as datados, median(erro) as erro_mediano, median(abs(erro)) as erro_abs_mediano, cast(sum(case when abs(erro) <= 1 then 1 else 0 end) as double) / count(erro) as ate_1, cast(sum(case when abs(erro) <= 2 then 1 else 0 end) as double) / count(erro) as ate_2 from e")
def dating_validation(spark, sf):
    p = panel(spark, sf)
    a, b = (I.change_points(p, "site", "ano", v).select("site", F.col("ano_degrau").alias(n)) for v, n in (("v_avg", "a"), ("v_n", "b")))
    e = a.join(b, "site").select((F.col("a") - F.col("b")).cast("double").alias("erro"))
    share = lambda k: F.try_divide(F.count(F.when(F.abs("erro") <= k, 1)).cast("double"), F.count("erro"))
    return e.agg(F.count("*").alias("comparados"), F.count("erro").alias("datados"), F.median("erro").alias("erro_mediano"), F.median(F.abs("erro")).alias("erro_abs_mediano"), share(1).alias("ate_1"), share(2).alias("ate_2"))


@query("control_inherits_context", f"with {PANEL}, s as (select site, tipo, pair, max(case when tipo = 'tratamento' then n_name else '' end) as nome from panel join nation on site = n_nationkey group by site, tipo, pair), t as (select pair, max(nome) as n from s where tipo = 'tratamento' group by pair) select s.site, s.tipo, s.pair, case when s.tipo = 'controle' and trim(s.nome) = '' then t.n else s.nome end as nome from s left join t on s.pair = t.pair")
def control_inherits_context(spark, sf):
    p = panel(spark, sf).select("site", "tipo", "pair").distinct().join(table(spark, sf, "nation"), F.col("site") == F.col("n_nationkey"))
    rows = p.select("site", "tipo", "pair", F.when(F.col("tipo") == "tratamento", F.col("n_name")).otherwise("").alias("nome"))
    return I.inherit(rows, "pair", ["nome"])


@query("source_precedence", f"with {PANEL}, {_change('v_avg', 'c', '500')}, {_change('v_n', 'd', '5')} select coalesce(c.site, d.site) as site, coalesce(c.ano_degrau, d.ano_degrau) as ano_degrau, case when c.ano_degrau is not null then 'preco' when d.ano_degrau is not null then 'pedidos' end as fonte from c full outer join d on c.site = d.site")
def source_precedence(spark, sf):
    p = panel(spark, sf)
    return N.precedence(I.change_points(p, "site", "ano", "v_avg", least=500.0), I.change_points(p, "site", "ano", "v_n", least=5.0), "site", "ano_degrau", ("preco", "pedidos"))


@query("l1_pair_quality", f"""with g as (select c_nationkey as site, case when c_nationkey % 2 = 0 then 'tratamento' else 'controle' end as tipo, cast(floor(c_nationkey / 2) as int) as pair, l_linenumber % 3 as k from lineitem join orders on l_orderkey = o_orderkey join customer on o_custkey = c_custkey),
 s as (select site, tipo, pair, cast(sum(case when k = 0 then 1 else 0 end) as double) / count(*) as s0, cast(sum(case when k = 1 then 1 else 0 end) as double) / count(*) as s1, cast(sum(case when k = 2 then 1 else 0 end) as double) / count(*) as s2 from g group by site, tipo, pair),
 a as (select pair, {', '.join(f"cast(sum(case when tipo = '{t}' then cast(s{k} as decimal(28,6)) end) as double) / cast(sum(case when tipo = '{t}' then 1 else 0 end) as double) as {t[0]}{k}" for t in ('tratamento', 'controle') for k in range(3))} from s group by pair having sum(case when tipo = 'tratamento' then 1 else 0 end) > 0 and sum(case when tipo = 'controle' then 1 else 0 end) > 0),
 l as (select pair, abs(t0 - c0) + abs(t1 - c1) + abs(t2 - c2) as l1 from a) select pair, l1, case when l1 <= 0.10 then 'bom' when l1 <= 0.20 then 'aceitavel' else 'ruim' end as qualidade from l""")
def l1_pair_quality(spark, sf):
    from sitelens.operators.match import pair_distance

    li = table(spark, sf, "lineitem").select("l_orderkey", (F.col("l_linenumber") % 3).alias("k"))
    o, c = table(spark, sf, "orders").select("o_orderkey", "o_custkey"), table(spark, sf, "customer").select("c_custkey", F.col("c_nationkey").alias("site"))
    g = li.join(o, F.col("l_orderkey") == F.col("o_orderkey")).join(c, F.col("o_custkey") == F.col("c_custkey"))
    s = g.groupBy("site").agg(*[(F.count(F.when(F.col("k") == k, 1)).cast("double") / F.count("*")).alias(f"s{k}") for k in range(3)])
    s = s.withColumn("tipo", F.when(F.col("site") % 2 == 0, "tratamento").otherwise("controle")).withColumn("pair", F.expr("int(site div 2)"))
    return pair_distance(s, ["s0", "s1", "s2"]).withColumn("qualidade", V.pair_quality(F.col("l1")))
