"""Outlines of pixel patches: sides that no two pixels of a patch share, linked to rings and put in order by pointer jumping.

A ring's sides are rows throughout. Every side knows the next one; in each round a side jumps twice as far as before, and learns
the least side within its jump and how far that is. When no side learns anything new the least one names the ring, and the
distance to it is a side's place. Rounds grow with the logarithm of the longest ring, and no task sees a ring whole.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.operators.raster import labelled
from sitelens.operators.storage import drop, settle

ROW = 1 << 21
#: Directions of a pixel's sides 0 top, 1 right, 2 bottom, 3 left, walked with the pixel at hand: the pixel ahead, and the one across.
AHEAD, ACROSS = (1, ROW, -1, -ROW), (-ROW, 1, ROW, -1)


def _of(side: Column, by: tuple[int, ...]) -> Column:
    return F.element_at(F.array(*[F.lit(x) for x in by]), (side + 1).cast("int"))


def sides(patch: DataFrame) -> DataFrame:
    """(component, side, next, straight) of pixels (id, component): sides that are not shared within the component, each with the one that follows.

    A side is its pixel's id times 4 and its direction. Where a patch touches itself at a corner, the outline stays with the same pixel, so
    rings do not cross; straight says that the next side goes on in the same direction.
    """
    each = patch.select("id", "component", F.explode(F.sequence(F.lit(0), F.lit(3))).alias("d"))
    # The same border from both of its pixels: named by the lower or right one, and whether it lies or stands.
    border = F.when(F.col("d") == 2, F.col("id") + ROW).when(F.col("d") == 1, F.col("id") + 1).otherwise(F.col("id"))
    own = each.groupBy("component", border.alias("border"), (F.col("d") % 2).alias("lies")).agg(F.count("*").alias("n"), F.min(F.col("id") * 4 + F.col("d")).alias("side")).where("n = 1").select("component", "side")
    own = settle(own)
    p, d = F.floor(F.col("side") / 4), F.col("side") % 4
    follow = F.array(
        F.struct(F.lit(0).alias("rank"), (p * 4 + (d + 1) % 4).alias("next")),
        F.struct(F.lit(1).alias("rank"), ((p + _of(d, AHEAD)) * 4 + d).alias("next")),
        F.struct(F.lit(2).alias("rank"), ((p + _of(d, AHEAD) + _of(d, ACROSS)) * 4 + (d + 3) % 4).alias("next")),
    )
    tried = own.select("component", "side", F.explode(follow).alias("f")).select("component", "side", "f.rank", "f.next")
    known = own.select(F.col("component").alias("c"), F.col("side").alias("s"))
    met = tried.join(known, (F.col("component") == F.col("c")) & (F.col("next") == F.col("s"))).groupBy("component", "side").agg(F.min(F.struct("rank", "next")).alias("f"))
    out = settle(met.select("component", "side", "f.next", (F.col("f.rank") == 1).alias("straight")))
    drop(own)
    return out


def rings(linked: DataFrame) -> DataFrame:
    """linked (settled: component, side, next, straight) with ring, its least side, and pos, the sides from that one on: pointer jumping."""
    at = settle(linked.select("side", F.col("next").alias("to"), F.col("side").alias("least"), F.lit(0).cast("long").alias("far")))
    step = 1
    while True:
        ahead = at.select(F.col("side").alias("to"), F.col("to").alias("then"), F.col("least").alias("other"), F.col("far").alias("more"))
        lower = F.col("other") < F.col("least")
        moved = at.join(ahead, "to").select("side", F.col("then").alias("to"), F.when(lower, F.col("other")).otherwise(F.col("least")).alias("least"), F.when(lower, F.col("more") + step).otherwise(F.col("far")).alias("far"), lower.alias("learned"))
        after = settle(moved)
        drop(at)
        at, step = after, step * 2
        if not after.where("learned").limit(1).count():
            break
    size = at.groupBy("least").agg(F.count("*").alias("n"))
    placed = at.join(size, "least").select("side", F.col("least").alias("ring"), F.pmod(F.col("n") - F.col("far"), F.col("n")).alias("pos"))
    return linked.join(placed, "side")


def _corner(side: Column) -> tuple[Column, Column]:
    """Column and row of the grid point that a side starts at."""
    p, d = F.floor(side / 4), side % 4
    return (p % ROW + d.isin(1, 2).cast("int")).cast("int"), (F.floor(p / ROW) % ROW + d.isin(2, 3).cast("int")).cast("int")


def dissolved(pixels: DataFrame, by: list[str], code: str, least: int = 1) -> tuple[DataFrame, DataFrame]:
    """Outlines of 4-connected patches of equal code of at least `least` pixels, as two tables.

    Rings: by, code, component, ring, pixels (area of the ring in pixels, negative for a hole) and sides. Vertices: component, ring, pos, x, y for each
    corner, in order of pos (which counts sides, not corners), x to the right and y downwards on the pixel grid. Areas of a patch's rings add up to its pixels.
    """
    patch = settle(labelled(pixels, by, code, scenes=1 << 19))
    if least > 1:
        patch = settle(patch.join(patch.groupBy("component").agg(F.count("*").alias("_n")).where(F.col("_n") >= least).select("component"), "component"))
    placed = settle(rings(sides(patch.select("id", "component"))))
    x, y = _corner(F.col("side"))
    d = F.col("side") % 4
    area = F.sum(F.when(d == 2, y.cast("long")).when(d == 0, -y.cast("long")).otherwise(0))
    shapes = placed.groupBy("component", "ring").agg(area.alias("pixels"), F.count("*").alias("sides"))
    named = patch.select(*by, code, "component").where(F.col("id") == F.col("component"))
    turns = placed.where(~F.col("straight")).select(F.col("next").alias("side"))
    corners = placed.join(turns, "side", "left_semi").select("component", "ring", "pos", x.alias("x"), y.alias("y"))
    return named.join(shapes, "component").select(*by, code, "component", "ring", "pixels", "sides"), corners


def collections(pixels: DataFrame, by: list[str], code: str, place: Column, area: float, names: Column, least: int = 1) -> DataFrame:
    """GeoJSON texts by item (values of `by`, strings or numbers): geojson, one feature for each code from the least on, a MultiPolygon of its patches.

    place makes the struct (lon, lat) of a corner from its columns x and y and those of `by`; area is a pixel's, names a code's name. Patches below `least` pixels are left
    out one by one, before they are put together. In GeoJSON an item is one value, so its corners meet in one row here, as one image's do.
    """
    shapes, corners = dissolved(pixels, by, code, least)
    spot = corners.join(shapes.select("ring", *by, code, (F.col("pixels") < 0).alias("hole"), "pixels"), "ring").withColumn("p", place)
    line = spot.groupBy(*by, code, "component", "hole", "ring", "pixels").agg(F.transform(F.array_sort(F.collect_list(F.struct("pos", F.array("p.lon", "p.lat").alias("p")))), lambda c: c["p"]).alias("line"))
    closed = line.withColumn("line", F.concat("line", F.slice("line", 1, 1)))
    patch = closed.groupBy(*by, code, "component").agg(F.array_sort(F.collect_list(F.struct("hole", "ring", "line"))).alias("r"), F.sum("pixels").alias("pixels"))
    whole = patch.groupBy(*by, code).agg(F.array_sort(F.collect_list(F.struct("component", F.transform("r", lambda r: r["line"]).alias("p")))).alias("m"), (F.sum("pixels") * F.lit(area)).alias("area_m2"))
    geometry = F.struct(F.lit("MultiPolygon").alias("type"), F.transform("m", lambda m: m["p"]).alias("coordinates"))
    told = F.struct(*by, F.col(code).alias("classe_id"), names.alias("classe_nome"), "area_m2")
    feature = whole.select(*by, F.struct(F.col(code).alias("o"), F.struct(F.lit("Feature").alias("type"), told.alias("properties"), geometry.alias("geometry")).alias("f")).alias("f"))
    out = feature.groupBy(*by).agg(F.transform(F.array_sort(F.collect_list("f")), lambda f: f["f"]).alias("features"))
    return out.select(*by, F.to_json(F.struct(F.lit("FeatureCollection").alias("type"), "features")).alias("geojson"))


def write_collections(items: DataFrame, by: list[str], path: str) -> None:
    """One text file of GeoJSON for each item, in folders named by `by`; items written before stay, those written again are replaced."""
    folders = [F.col(c).alias(c) for c in by]
    items.select(*folders, "geojson").repartition(*by).write.option("partitionOverwriteMode", "dynamic").mode("overwrite").partitionBy(*by).text(path)
