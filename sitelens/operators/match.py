"""Finding controls: nearest neighbours of z-scores, rings of points, free azimuths and spatial thinning."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.functions.values import exact_avg
from sitelens.operators import neighbours
from sitelens.operators.storage import drop, numbered, settle, spread

RING = 6
#: Rows of one place that go together, and rows of a group that meet as many others in one task.
SAME, PART = 256, 1024


def nearest(rows: DataFrame, ident: str, group: str | None, columns: list[str], k: int) -> DataFrame:
    """The k nearest others of each row in its group (without group, of all rows) by Euclidean distance of z-scores; ties by id. See neighbours.nearest."""
    if group is None:
        rows, group = rows.withColumn("_whole", F.lit(1)), "_whole"
    return neighbours.nearest(rows, ident, group, columns, k)


def similar_wide(rows: DataFrame, ident: str, region: str, columns: list[str], k: int, mode: str = "regiao") -> DataFrame:
    """One row per row: vizinho_1 .. vizinho_k and dist_1 .. dist_k, within its region or, by mode `pais`, the whole country.

    Rows alone in their group have nulls; another mode is an error.
    """
    if mode not in ("regiao", "pais"):
        raise ValueError(f"mode {mode}: regiao or pais")
    found = nearest(rows, ident, region if mode == "regiao" else None, columns, k)
    pick = lambda c, r: F.max(F.when(F.col("rn") == r, F.col(c))).alias(f"{c}_{r}")
    wide = found.groupBy(ident).agg(*[pick(c, r) for r in range(1, k + 1) for c in ("vizinho", "dist")])
    return rows.select(ident).join(wide, ident, "left")


def similar_coordinates(pairs: DataFrame, places: DataFrame, left: str, right: str, key: str) -> DataFrame:
    """pairs with lat and lon of both their ends, from one table of places met twice: lat_origem, lon_origem, lat_similar, lon_similar."""
    side = lambda name, suffix: places.select(F.col(key).alias(name), F.col("lat").alias(f"lat_{suffix}"), F.col("lon").alias(f"lon_{suffix}"))
    return pairs.join(side(left, "origem"), left, "left").join(side(right, "similar"), right, "left")


def similarity(dist: Column) -> Column:
    """Percent, 100 at distance 0."""
    return F.exp(-dist / F.lit(2.0)) * F.lit(100.0)


def spans(rows: DataFrame, group: str) -> DataFrame:
    """All pairs a < b of a group's rows (id, lat, lon) with their distance and the bearing from a to b: a, b, km, azimute.

    Rows of one place go together, up to SAME of them, and distance and bearing are worked out once for two places. Places are dealt to parts of about PART rows, and every
    two parts of a group meet on their own, so no task has a whole group.
    """
    place = [F.col(group).alias("g"), "lat", "lon"]
    own = rows.where(F.col(group).isNotNull() & F.col("id").isNotNull()).select("id", *place)
    turn = F.row_number().over(Window.partitionBy("g", "lat", "lon").orderBy("id"))
    spots = own.withColumn("turn", F.floor((turn - 1) / F.lit(SAME))).groupBy("g", "lat", "lon", "turn").agg(F.collect_list("id").alias("ids"))
    size = own.groupBy("g").agg(F.ceil(F.count("*") / PART).cast("int").alias("parts"))
    dealt = spots.join(size, "g").withColumns({"own": F.pmod(F.xxhash64("lat", "lon", "turn"), F.col("parts")).cast("int"), "other": F.explode(F.sequence(F.lit(0), F.col("parts") - 1))})
    left = dealt.select("g", F.col("own").alias("i"), F.col("other").alias("j"), F.col("lat").alias("la"), F.col("lon").alias("oa"), F.col("ids").alias("a"), F.array_min("ids").alias("low"))
    right = dealt.select("g", F.col("other").alias("i"), F.col("own").alias("j"), F.col("lat").alias("lb"), F.col("lon").alias("ob"), F.col("ids").alias("b"), F.array_max("ids").alias("high"))
    met = spread(left, "g", "i", "j").join(spread(right, "g", "i", "j"), ["g", "i", "j"]).where("low < high")
    spot = [F.col(c) for c in ("la", "oa", "lb", "ob")]
    met = met.select("a", "b", F.round(geo.haversine(*spot), 6).alias("km"), F.round(geo.bearing(*spot), 6).alias("azimute"))
    return met.select(F.explode("a").alias("a"), "b", "km", "azimute").select("a", F.explode("b").alias("b"), "km", "azimute").where("a < b")


def ring(rows: DataFrame, lat: str, lon: str, km: Column, start: Column) -> DataFrame:
    """Six points around each place, 60 degrees apart; none for places without coordinates."""
    spread = rows.where(F.col(lat).isNotNull() & F.col(lon).isNotNull()).withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(RING - 1))))
    to_lat, to_lon = geo.destination(F.col(lat), F.col(lon), km, start + F.lit(360.0 / RING) * F.col("k"))
    return spread.withColumn("point_lat", to_lat).withColumn("point_lon", to_lon)


def free_azimuth(sites: DataFrame, others: DataFrame, km: float, clear_km: float, step: int = 15) -> DataFrame:
    """For each site (id, lat, lon) the first azimuth whose point is clear_km from every other; 0 and found = false if none.

    Others are met through grid cells one clear_km or more wide and high, so only neighbours are compared. Sites of one place try its points once, and others of one
    place are met as one, by their least and greatest id: it is another's than a site's own unless both are the site's.
    """
    tries = sites.select(F.col("lat").alias("slat"), F.col("lon").alias("slon")).distinct()
    tries = tries.withColumn("az", F.explode(F.sequence(F.lit(0), F.lit(360 - step), F.lit(step))))
    to_lat, to_lon = geo.destination(F.col("slat"), F.col("slon"), F.lit(km), F.col("az").cast("double"))
    tries = tries.select("slat", "slon", "az", to_lat.alias("plat"), to_lon.alias("plon"))
    spots = others.groupBy(F.col("lat").alias("olat"), F.col("lon").alias("olon")).agg(F.min("id").alias("low"), F.max("id").alias("high"))
    marked = geo.around(spots, "olat", "olon", clear_km)
    hit = geo.placed(tries, "plat", "plon", clear_km).join(marked, ["cy", "cx"]).where(geo.haversine(F.col("plat"), F.col("plon"), F.col("olat"), F.col("olon")) < clear_km)
    hit = hit.groupBy("slat", "slon", "az").agg(F.min("low").alias("low"), F.max("high").alias("high"))
    told = hit.groupBy("slat", "slon").agg(F.collect_list(F.struct("az", "low", "high")).alias("hits"))  # as many as azimuths
    met = sites.select("id", "lat", "lon").join(told, (F.col("lat") == F.col("slat")) & (F.col("lon") == F.col("slon")), "left")
    taken = F.transform(F.filter("hits", lambda h: (h["low"] != F.col("id")) | (h["high"] != F.col("id"))), lambda h: h["az"])
    free = F.array_except(F.sequence(F.lit(0), F.lit(360 - step), F.lit(step)), F.coalesce(taken, F.array().cast("array<int>")))
    return met.select("id", F.get(free, 0).alias("az")).select("id", F.coalesce("az", F.lit(0)).alias("azimuth"), F.col("az").isNotNull().alias("found"))


def thinned(rows: DataFrame, order: Column, km: float, most: int | None = None) -> DataFrame:
    """Greedy thinning of (id, lat, lon): in order, then by id, keep what is km from all kept, up to `most`: place, id, lat, lon.

    In rounds that take many rows at once: a row that comes before all undecided ones within km is kept, and those within km of it go. Of a fine cell, where all
    are within km of each other, only the first row can be next, so a row meets the first ones of the cells around it, never all rows there, and
    thousands of rows at one place meet one. Rounds are few unless the order itself leads from neighbour to neighbour. They end when `most` kept
    rows come before all that is undecided. id tells rows apart; rows without coordinates are left out.
    """
    left = settle(rows.where(F.col("lat").isNotNull() & F.col("lon").isNotNull()).select("id", "lat", "lon", F.struct(order.alias("o"), F.col("id").alias("i")).alias("_o")))
    high = max(km, 1e-3) / 2 / 111.2
    band = F.floor(F.col("lat") / F.lit(high))
    wide = F.lit(high) / F.greatest(F.lit(1e-9), F.cos(F.radians(F.least(F.abs(band), F.abs(band + 1)) * F.lit(high))))
    kept: list[DataFrame] = []
    apart = lambda: geo.haversine(F.col("lat"), F.col("lon"), F.col("alat"), F.col("alon")) < km
    while True:
        first = left.groupBy(band.alias("b"), F.floor(F.col("lon") / wide).alias("w")).agg(F.min(F.struct("_o", "lat", "lon")).alias("f"))
        first = settle(first.select(F.col("f._o").alias("a"), F.col("f.lat").alias("alat"), F.col("f.lon").alias("alon")))
        near = geo.around(first, "alat", "alon", max(km, 1e-3))
        own = geo.placed(left, "lat", "lon", max(km, 1e-3))
        behind = near.join(own, ["cy", "cx"]).where((F.col("_o") < F.col("a")) & apart()).select("a").distinct()
        taken = settle(first.join(behind, "a", "left_anti"))
        kept.append(taken)
        gone = geo.around(taken, "alat", "alon", max(km, 1e-3)).join(own, ["cy", "cx"]).where(apart() | (F.col("_o") == F.col("a"))).select(F.col("_o").alias("g")).distinct()
        after = settle(left.join(gone, F.col("_o") == F.col("g"), "left_anti"))
        drop(left)
        drop(first)
        left = after
        ahead = left.agg(F.min("_o").alias("m")).first().m
        if ahead is None:
            break
        if most is not None:
            limit = left.agg(F.min("_o").alias("m"))
            if sum(k.join(limit, F.col("a") < F.col("m")).limit(most).count() for k in kept) >= most:
                break
    found = reduce(DataFrame.unionAll, kept).select("a", F.col("a.i").alias("id"), F.col("alat").alias("lat"), F.col("alon").alias("lon"))
    if most is None:
        return numbered(found, ["a"]).select(F.col("place").cast("int").alias("place"), "id", "lat", "lon")
    found = found.orderBy("a").limit(most)
    return found.select((F.row_number().over(Window.orderBy("a")) - 1).alias("place"), "id", "lat", "lon")


def pair_distance(shares: DataFrame, classes: list[str], before: bool = False) -> DataFrame:
    """Sum of absolute differences of mean class shares of treated and controls, by pair.

    `before` takes only rows of years before the event (h < 0), and rounds to 6 digits.
    """
    if before:
        return pair_distance(shares.where("h < 0"), classes).withColumn("l1", F.bround("l1", 6))
    means = shares.groupBy("pair").agg(*[exact_avg(F.when(F.col("tipo") == t, F.col(c))).alias(f"{t}_{c}") for t in ("tratamento", "controle") for c in classes])
    return means.select("pair", sum((F.abs(F.col(f"tratamento_{c}") - F.col(f"controle_{c}")) for c in classes), F.lit(0.0)).alias("l1")).where("l1 is not null")
