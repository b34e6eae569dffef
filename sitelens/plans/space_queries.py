"""Queries over polygons, outlines, projections and neighbours made from the given tables."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import projection as P
from sitelens.operators import match as M
from sitelens.operators import outlines as O
from sitelens.operators import zones as Z
from sitelens.operators.storage import shared_folder
from sitelens.plans.panel_queries import table
from sitelens.plans.registry import query
from sitelens.sources import rasters as RF
from sitelens.sources import store as S
from sitelens.sources.sink import write_files

_ADD = lambda x: f"cast(sum(cast({x} as decimal(38,10))) as double)"
_FEATURES = ("saldo", "pedidos", "valor")


@query("similar_customers", f"""with e as (select c_custkey as id, cast(c_acctbal as double) as saldo, cast(count(o_orderkey) as double) as pedidos, coalesce({_ADD('o_totalprice')}, 0) as valor from customer left join orders on o_custkey = c_custkey group by 1, 2),
 t as (select cast(count(*) as double) as n, {', '.join(f'{_ADD(x)} as s{x}, {_ADD(f"{x} * {x}")} as q{x}' for x in _FEATURES)} from e),
 z as (select id, {', '.join(f'({x} - s{x} / n) / coalesce(nullif(sqrt(greatest(0, q{x} / n - s{x} / n * (s{x} / n))), 0), 1) as z{x}' for x in _FEATURES)} from e cross join t),
 d as (select a.id, b.id as vizinho, sqrt({' + '.join(f'(a.z{x} - b.z{x}) * (a.z{x} - b.z{x})' for x in _FEATURES)}) as dist from z a join z b on a.id <> b.id)
 select id, cast(rn as int) as rn, vizinho, round(dist, 6) as dist from (select *, row_number() over (partition by id order by dist, vizinho) as rn from d) x where rn <= 3""")
def similar_customers(spark, sf):
    c, o = table(spark, sf, "customer"), table(spark, sf, "orders")
    own = o.groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.count("o_orderkey").cast("double").alias("pedidos"), F.sum(F.col("o_totalprice").cast("decimal(38,10)")).cast("double").alias("valor"))
    e = c.join(own, "c_custkey", "left").select(F.col("c_custkey").alias("id"), F.col("c_acctbal").cast("double").alias("saldo"), *[F.coalesce(x, F.lit(0.0)).alias(x) for x in ("pedidos", "valor")])
    return M.nearest(e, "id", None, list(_FEATURES), 3).withColumn("dist", F.round("dist", 6))


#: Suppliers' zones on a plane of 200 by 200: eight corners in fixed directions, as far out as keys say, and a square hole.
_CORNERS = [(5, 0), (4, 4), (0, 5), (-4, 4), (-5, 0), (-4, -4), (0, -5), (4, -4)]
_HOLE = [(1, 1), (1, -1), (-1, -1), (-1, 1)]
_SPOT = "cast((s_suppkey * 37) % 181 + 10 as double) as x0, cast((s_suppkey * 91) % 179 + 10 as double) as y0"
_VERTICES = "vertices as (" + " union all ".join([f"select s_suppkey as zone, 0 as ring, {k} as pos, x0 + {dx} * (1 + (s_suppkey * {k + 3}) % 4) / 2e0 as x, y0 + {dy} * (1 + (s_suppkey * {k + 3}) % 4) / 2e0 as y from spots" for k, (dx, dy) in enumerate(_CORNERS)] + [f"select s_suppkey, 1, {k}, x0 + {dx} * 0.75e0, y0 + {dy} * 0.75e0 from spots" for k, (dx, dy) in enumerate(_HOLE)]) + ")"
_EDGES = f"spots as (select s_suppkey, {_SPOT} from supplier), {_VERTICES}, edges as (select zone, ring, x as x1, y as y1, coalesce(lead(x) over w, first_value(x) over w) as x2, coalesce(lead(y) over w, first_value(y) over w) as y2 from vertices window w as (partition by zone, ring order by pos))"
_IN = "sum(case when (y1 > y) <> (y2 > y) and x < x1 + (y - y1) * (x2 - x1) / (y2 - y1) then 1 else 0 end) % 2 = 1"
_AT = "cast((c_custkey * 53) % 2000 as double) / 10e0 as x, cast((c_custkey * 97) % 2000 as double) / 10e0 as y"


def vertices(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier").select("s_suppkey", ((F.col("s_suppkey") * 37) % 181 + 10).cast("double").alias("x0"), ((F.col("s_suppkey") * 91) % 179 + 10).cast("double").alias("y0"))
    corner = lambda ring, pos, far, dx, dy: F.struct(F.lit(ring).alias("ring"), F.lit(pos).alias("pos"), (F.col("x0") + F.lit(dx) * far).alias("x"), (F.col("y0") + F.lit(dy) * far).alias("y"))
    out = [corner(0, k, (F.lit(1) + (F.col("s_suppkey") * (k + 3)) % 4) / F.lit(2.0), dx, dy) for k, (dx, dy) in enumerate(_CORNERS)]
    hole = [corner(1, k, F.lit(0.75), dx, dy) for k, (dx, dy) in enumerate(_HOLE)]
    return s.select(F.col("s_suppkey").alias("zone"), F.explode(F.array(*out, *hole)).alias("v")).select("zone", "v.*")


def _points(spark, sf) -> DataFrame:
    spot = lambda m: (F.col("c_custkey") * m % 2000).cast("double") / F.lit(10.0)
    return table(spark, sf, "customer").select("c_custkey", spot(53).alias("x"), spot(97).alias("y"))


@query("points_in_polygons", f"with {_EDGES}, p as (select c_custkey, {_AT} from customer) select zone, c_custkey from p cross join edges group by zone, c_custkey, x, y having {_IN}")
def points_in_polygons(spark, sf):
    return Z.inside(Z.edges(vertices(spark, sf)), _points(spark, sf), ["c_custkey"], 4.0)


_PIXELS = "px as (select cast(l_orderkey % 200 as int) as row, cast(l_partkey % 200 as int) as col, cast(sum(cast(l_quantity as decimal(28,6))) as double) / cast(count(*) as double) as v, min(l_linenumber) as code from lineitem group by 1, 2)"


def pixels(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 200).cast("int").alias("row"), (F.col("l_partkey") % 200).cast("int").alias("col"), "l_quantity", "l_linenumber")
    return li.groupBy("row", "col").agg((F.sum(F.col("l_quantity").cast("decimal(28,6)")).cast("double") / F.count("*").cast("double")).alias("v"), F.min("l_linenumber").alias("code"))


@query("painted_polygons", f"with {_EDGES}, {_PIXELS}, p as (select col + 0.5e0 as x, row + 0.5e0 as y from px), i as (select zone, x, y from p cross join edges group by zone, x, y having {_IN}) select x, y, max_by(zone % 7, zone) as code from i group by x, y")
def painted_polygons(spark, sf):
    centres = pixels(spark, sf).select((F.col("col") + F.lit(0.5)).alias("x"), (F.col("row") + F.lit(0.5)).alias("y"))
    codes = table(spark, sf, "supplier").select(F.col("s_suppkey").alias("zone"), F.col("s_suppkey").alias("ordem"), (F.col("s_suppkey") % 7).alias("code"))
    return Z.painted_polygons(Z.edges(vertices(spark, sf)), codes, centres, 4.0)


#: The area to the right of an edge in a pixel, as an integral in closed form: another way than by rows and running sums.
_H = lambda t: f"(case when {t} <= col then {t} - col when {t} >= col + 1 then 0.5e0 else ({t} - col) - ({t} - col) * ({t} - col) / 2e0 end)"
_SHARES = f"""{_EDGES}, turned as (select zone, ring, case when sum(x1 * y2 - x2 * y1) >= 0 then -1e0 else 1e0 end * case when ring > 0 then -1e0 else 1e0 end as sign from edges group by 1, 2),
 box as (select zone, unnest(range(cast(floor(min(y1)) as bigint), cast(floor(max(y1)) as bigint) + 1)) as row, min(x1) as lo, max(x1) as hi from edges group by 1),
 cells as (select zone, cast(row as int) as row, cast(unnest(range(cast(floor(lo) as bigint), cast(floor(hi) as bigint) + 1)) as int) as col from box),
 cut as (select zone, row, col, sign, x1, y1, x2, y2, greatest(row, least(row + 1, y1)) as ya, greatest(row, least(row + 1, y2)) as yb from cells join edges using (zone) join turned using (zone, ring) where y1 <> y2 and greatest(y1, y2) > row and least(y1, y2) < row + 1),
 ends as (select *, x1 + (ya - y1) * (x2 - x1) / (y2 - y1) as xa, x1 + (yb - y1) * (x2 - x1) / (y2 - y1) as xb from cut),
 shares as (select zone, row, col, sum(sign * (yb - ya) * case when abs(xa - xb) < 1e-9 then greatest(0e0, least(1e0, col + 1 - xa)) else ({_H('xb')} - {_H('xa')}) / (xb - xa) end) as weight from ends group by 1, 2, 3 having weight > 1e-9)"""


def shares(spark, sf) -> DataFrame:
    rings = vertices(spark, sf)
    return Z.weights(Z.edges(rings), 1.0, rings.where("ring > 0").select("zone", "ring"))


@query("pixel_shares", f"with {_SHARES} select zone, row, col, round(weight, 6) as weight from shares where round(weight, 6) > 0")
def pixel_shares(spark, sf):
    return shares(spark, sf).withColumn("weight", F.round("weight", 6)).where("weight > 0")


@query("weighted_zonal", f"with {_SHARES}, {_PIXELS} select zone, round(sum(weight * v), 8) as sum_v, round(sum(weight), 8) as weight, round(sum(weight * v) / sum(weight), 8) as mean_v from shares join px using (row, col) group by zone")
def weighted_zonal(spark, sf):
    out = Z.weighted(shares(spark, sf), pixels(spark, sf), "v")
    return out.select("zone", *[F.round(c, 8).alias(c) for c in ("sum_v", "weight", "mean_v")])


@query("zonal_mode", f"with {_SHARES}, {_PIXELS}, m as (select zone, code, round(sum(weight), 6) as w from shares join px using (row, col) group by 1, 2) select zone, arg_max(code, row(w, -code)) as moda, round(100e0 * max(w) / sum(w), 4) as pct from m group by zone")
def zonal_mode(spark, sf):
    return Z.weighted_mode(shares(spark, sf), pixels(spark, sf), "code").withColumn("pct", F.round("pct", 4))


#: Classes on a grid of 60 by 60, their 4-connected patches, the sides of these, and rings by walking from side to side.
_GRID60 = "px as (select cast(l_orderkey % 60 as int) as r, cast(l_partkey % 60 as int) as c, min(l_linenumber) % 3 as classe from lineitem group by 1, 2)"
_RINGS = f"""{_GRID60}, n as (select (dense_rank() over (order by classe) - 1) * 4398046511104 + r * 2097152 + c as id, classe from px),
 e as (select a.id as a, b.id as b from n a join n b on b.id in (a.id + 1, a.id - 1, a.id + 2097152, a.id - 2097152)),
 w as (select id, id as o from n union select e.b, w.o from w join e on w.id = e.a where w.o < e.b), m as (select id, min(o) as component from w group by id),
 d as (select * from (values (0, 1, -2097152), (1, 2097152, 1), (2, -1, 2097152), (3, -2097152, -1)) t(d, ahead, across)),
 s as (select m.component, m.id * 4 + d as side, m.id as p, d, ahead, across from m cross join d left join m x on x.id = m.id + across where x.id is null),
 f as (select s.component, s.side, s.d, s.p, coalesce(a.side, b.side, c.side) as next, a.side is null and b.side is not null as straight from s left join s a on a.side = s.p * 4 + (s.d + 1) % 4
  left join s b on b.side = (s.p + s.ahead) * 4 + s.d left join s c on c.side = (s.p + s.ahead + s.across) * 4 + (s.d + 3) % 4),
 walk as (select side as ring, side, 0 as pos from f union all select walk.ring, f.next, pos + 1 from walk join f using (side) where f.next > walk.ring),
 closed as (select distinct walk.ring from walk join f using (side) where f.next = walk.ring),
 placed as (select f.component, walk.ring, walk.side, cast(pos as bigint) as pos, f.d, cast(f.p % 2097152 + case when f.d in (1, 2) then 1 else 0 end as int) as x, cast((f.p // 2097152) % 2097152 + case when f.d in (2, 3) then 1 else 0 end as int) as y from walk join closed using (ring) join f using (side))"""


def grid60(spark, sf) -> DataFrame:
    li = table(spark, sf, "lineitem").select((F.col("l_orderkey") % 60).cast("int").alias("row"), (F.col("l_partkey") % 60).cast("int").alias("col"), "l_linenumber")
    return li.groupBy("row", "col").agg((F.min("l_linenumber") % 3).alias("classe"))


@query("patch_rings", f"with recursive {_RINGS}, k as (select component, count(*) as pixels from m group by 1) select n.classe, p.component, p.ring, cast(sum(case when d = 2 then y when d = 0 then -y else 0 end) as bigint) as pixels, count(*) as sides from placed p join n on n.id = p.component join k on k.component = p.component where k.pixels >= 2 group by 1, 2, 3")
def patch_rings(spark, sf):
    return O.dissolved(grid60(spark, sf), [], "classe", 2)[0]


@query("patch_corners", f"with recursive {_RINGS} select p.component, p.ring, p.pos, p.x, p.y from placed p join f on f.next = p.side where not f.straight")
def patch_corners(spark, sf):
    return O.dissolved(grid60(spark, sf), [], "classe")[1]


#: Two places for each supplier, one in each hemisphere.
_TWO = "two as (select s_suppkey as id, cast(30 as double) + cast((s_suppkey * 37) % 2000 as double) / 100e0 as lat, cast(-120 as double) + cast((s_suppkey * 91) % 5000 as double) / 100e0 as lon from supplier union all select -s_suppkey - 1, -cast((s_suppkey * 53) % 3000 as double) / 100e0 - 0.25e0, cast(-70 as double) + cast((s_suppkey * 29) % 3500 as double) / 100e0 from supplier)"


def two(spark, sf) -> DataFrame:
    s = table(spark, sf, "supplier")
    spot = lambda m, n, start: F.lit(start) + (F.col("s_suppkey") * m % n).cast("double") / F.lit(100.0)
    north = s.select(F.col("s_suppkey").alias("id"), spot(37, 2000, 30.0).alias("lat"), spot(91, 5000, -120.0).alias("lon"))
    return north.unionAll(s.select((-F.col("s_suppkey") - 1).alias("id"), -(F.col("s_suppkey") * 53 % 3000).cast("double") / F.lit(100.0) - F.lit(0.25), spot(29, 3500, -70.0)))


def _plane(ellipsoid: str, centre: str, south: str) -> str:
    """DuckDB's columns x and y of the series, from lat and lon in a table `place`."""
    n = P.third(ellipsoid)
    e, r, a = 2 * n**0.5 / (1 + n), P.SCALE * P.radius(n), P.series(P.ALPHA, n)
    terms = lambda f, g: " + ".join(f"{c!r} * {f}({2.0 * k} * xi) * {g}({2.0 * k} * eta)" for k, c in enumerate(a, 1))
    return f"""t as (select *, {centre} as centre, {south} as south, sinh(atanh(sin(radians(lat))) - {e!r} * atanh({e!r} * sin(radians(lat)))) as t from place), u as (select *, atan2(t, cos(radians(lon - centre))) as xi, atanh(sin(radians(lon - centre)) / sqrt(1 + t * t)) as eta from t),
 plane as (select *, 500000e0 + {r!r} * (eta + {terms('cos', 'sinh')}) as x, case when south then 10000000e0 else 0e0 end + {r!r} * (xi + {terms('sin', 'cosh')}) as y from u)"""


@query("projected", f"with {_TWO}, place as (select *, cast(floor((lon + 180) / 6) + 1 as int) as zone from two), {_plane('WGS84', 'zone * 6e0 - 183e0', 'lat < 0')} select id, zone, case when south then 32700 else 32600 end + zone as epsg, round(x, 4) as x, round(y, 4) as y from plane")
def projected(spark, sf):
    own = two(spark, sf).withColumn("zone", P.zone(F.col("lon")))
    x, y = P.forward(F.col("lat"), F.col("lon"), P.meridian(F.col("zone")), F.col("lat") < 0)
    return own.select("id", "zone", P.epsg(F.col("zone"), F.col("lat") < 0).alias("epsg"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))


@query("unprojected", f"with {_TWO} select id, round(lat, 7) as lat, round(lon, 7) as lon from two")
def unprojected(spark, sf):
    """There and back through a plane of whole tenths of a millimetre."""
    own = two(spark, sf).withColumn("zone", P.zone(F.col("lon")))
    x, y = P.forward(F.col("lat"), F.col("lon"), P.meridian(F.col("zone")), F.col("lat") < 0)
    plane = own.select("id", "zone", (F.col("lat") < 0).alias("south"), F.round(x, 4).alias("x"), F.round(y, 4).alias("y"))
    lat, lon = P.inverse(F.col("x"), F.col("y"), P.meridian(F.col("zone")), F.col("south"))
    return plane.select("id", F.round(lat, 7).alias("lat"), F.round(lon, 7).alias("lon"))


@query("site_grid", f"with {_TWO}, place as (select * from two where id < 0), {_plane('GRS80', '-45e0', 'true')}, g as (select id, x, y, floor((x - 5000) / 30) * 30 as origin_x, ceil((y + 5000) / 30) * 30 as origin_y from plane) select id, origin_x, origin_y, cast(ceil((x + 5000 - origin_x) / 30) as int) as width, cast(ceil((origin_y - (y - 5000)) / 30) as int) as height from g")
def site_grid(spark, sf):
    own = two(spark, sf).where("id < 0")
    return own.select("id", P.site_grid(F.col("lat"), F.col("lon"), F.lit(5000.0), 30, F.lit(-45.0), F.lit(True)).alias("g")).select("id", "g.*")


@query("class_geojson", f"with recursive {_RINGS}, k as (select component from m group by 1 having count(*) >= 3) select n.classe, count(distinct p.component) as poligonos, count(distinct p.ring) as aneis, count(*) filter (where not f.straight) + count(distinct p.ring) as vertices, 900e0 * sum(case when p.d = 2 then y when p.d = 0 then -y else 0 end) as area_m2 from placed p join k using (component) join n on n.id = p.component join f on f.next = p.side group by 1")
def class_geojson(spark, sf):
    """The classes' GeoJSON in degrees, read again."""
    lat, lon = P.inverse(F.lit(300000.0) + F.col("x") * F.lit(30.0), F.lit(7400000.0) - F.col("y") * F.lit(30.0), F.lit(-45.0), F.lit(True), "GRS80")
    items = O.collections(grid60(spark, sf).withColumn("site", F.lit("s1")), ["site"], "classe", F.struct(lat.alias("lat"), lon.alias("lon")), 900.0, F.concat(F.lit("classe "), F.col("classe")), 3)
    read = F.from_json("geojson", "features array<struct<properties:struct<classe_id:int,area_m2:double>,geometry:struct<coordinates:array<array<array<array<double>>>>>>>")
    each = items.select(F.explode(read["features"]).alias("f")).select("f.properties.*", F.col("f.geometry.coordinates").alias("c"))
    rings = F.flatten("c")
    return each.select(F.col("classe_id").alias("classe"), F.size("c").cast("long").alias("poligonos"), F.size(rings).cast("long").alias("aneis"), F.size(F.flatten(rings)).cast("long").alias("vertices"), "area_m2")


@query("raster_round_trip", f"with px as (select cast(l_linenumber as int) as site, cast(l_orderkey % 150 as int) as row, cast(l_partkey % 130 as int) as col, cast(min(l_suppkey) as double) as a, cast(max(l_quantity) as double) as b from lineitem group by 1, 2, 3) select site, 'a' as band, row, col, a as value, 300000e0 + (col + 0.5e0) * 30 as x, 7400000e0 - (row + 0.5e0) * 30 as y from px union all select site, 'b', row, col, case when b < 40 then b end, 300000e0 + (col + 0.5e0) * 30, 7400000e0 - (row + 0.5e0) * 30 from px where b < 40")
def raster_round_trip(spark, sf):
    """Pixels written as one raster file for each site and read again; no data is left out."""
    li = table(spark, sf, "lineitem").select(F.col("l_linenumber").cast("int").alias("site"), (F.col("l_orderkey") % 150).cast("int").alias("row"), (F.col("l_partkey") % 130).cast("int").alias("col"), "l_suppkey", "l_quantity")
    px = li.groupBy("site", "row", "col").agg(F.min("l_suppkey").alias("a"), F.max("l_quantity").alias("b")).withColumn("b", F.when(F.col("b") < 40, F.col("b")))
    grid = {"west": 300000.0, "north": 7400000.0, "step": 30.0, "width": 130, "height": 150}
    folder = f"{shared_folder(spark).rstrip('/')}/rasters-{uuid.uuid4().hex}"
    write_files(RF.encoded(px, ["site"], ["a", "b"], grid, 31983), folder)
    back = RF.read_rasters(spark, folder).where("value is not null")
    return back.select(F.regexp_extract("path", r"(\d+)[.]tif$", 1).cast("int").alias("site"), "band", "row", "col", "value", "x", "y")


@query("scene_store", "with px as (select l_returnflag as sensor, cast(l_linenumber as int) as site, cast(year(l_shipdate) as int) as ano, l_partkey % 100 as row, l_suppkey as col, l_quantity as v from lineitem), w as (select distinct l_returnflag as sensor, cast(year(l_shipdate) as int) as ano from lineitem where l_shipdate < date '1997-01-01') select sensor, site, ano, count(*) as n, cast(sum(cast(v as decimal(28,6))) as double) as v, 0 as de_novo from px join w using (sensor, ano) group by 1, 2, 3")
def scene_store(spark, sf):
    """Lines as pixels, stored by sensor, site and year, and stored again, which writes nothing (de_novo); then the scenes of some sensors and years."""
    li = table(spark, sf, "lineitem")
    keys = [F.col("l_returnflag").alias("sensor"), F.year("l_shipdate").cast("int").alias("ano")]
    px = li.select(keys[0], F.col("l_linenumber").cast("int").alias("site"), keys[1], (F.col("l_partkey") % 100).alias("row"), F.col("l_suppkey").alias("col"), F.col("l_quantity").alias("v"))
    folder = f"{shared_folder(spark).rstrip('/')}/scenes-{uuid.uuid4().hex}"
    S.save_scenes(px, folder)
    again = S.save_scenes(px, folder).count()
    wanted = li.where("l_shipdate < date '1997-01-01'").select(*keys)
    found = S.read_scenes(spark, folder, wanted).groupBy("sensor", "site", "ano")
    return found.agg(F.count("*").alias("n"), F.sum(F.col("v").cast("decimal(28,6)")).cast("double").alias("v"), F.lit(again).cast("int").alias("de_novo"))
