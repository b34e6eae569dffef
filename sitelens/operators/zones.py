"""Polygons and pixels: points in rings with holes, the share of each pixel inside, and statistics weighted by it.

Rings are tables of vertices (zone, ring, pos, x, y), pos from 0 in order; the last vertex is joined to the first, and may repeat it.
No polygon is ever held whole: edges are rows, dealt by scanline.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.operators.storage import spread

#: Cells by which an edge counts as wider than it is, against rounding where it crosses a scanline's border.
MARGIN = 1e-6
EXACT = "decimal(38,15)"
#: Points of one place that meet its zones in one task; more are dealt to several.
TOGETHER = 4096


def circle(zones: DataFrame, corners: int = 64) -> DataFrame:
    """Rings of so many corners around the zones (zone, x, y, r)."""
    at = lambda f: f(F.lit(2 * math.pi / corners) * F.col("pos"))
    spread = zones.withColumn("pos", F.explode(F.sequence(F.lit(0), F.lit(corners - 1))))
    return spread.select("zone", F.lit(0).alias("ring"), "pos", (F.col("x") + F.col("r") * at(F.cos)).alias("x"), (F.col("y") + F.col("r") * at(F.sin)).alias("y"))


def edges(vertices: DataFrame) -> DataFrame:
    """(zone, ring, x1, y1, x2, y2) of all rings, each edge from a vertex to the next; vertices without coordinates are an error of the caller's.

    Neighbours meet by their numbers, so a long ring is spread like any other rows; only its two ends are met apart.
    """
    own = vertices.select("zone", "ring", F.col("pos").cast("long").alias("pos"), F.col("x").cast("double").alias("x"), F.col("y").cast("double").alias("y"))
    after = own.select("zone", "ring", (F.col("pos") - 1).alias("pos"), F.col("x").alias("x2"), F.col("y").alias("y2"))
    along = own.join(after, ["zone", "ring", "pos"]).select("zone", "ring", F.col("x").alias("x1"), F.col("y").alias("y1"), "x2", "y2")
    ends = own.groupBy("zone", "ring").agg(F.max_by(F.struct("x", "y"), "pos").alias("a"), F.min_by(F.struct("x", "y"), "pos").alias("b"))
    return along.unionAll(ends.select("zone", "ring", "a.x", "a.y", F.col("b.x").alias("x2"), F.col("b.y").alias("y2")))


def _clip(c: Column, low: Column, high: Column) -> Column:
    return F.greatest(low, F.least(high, c))


def _bands(sides: DataFrame, cell: float) -> DataFrame:
    """Edges once for each scanline (cy) they have part in, with the part's ends (xa, ya, xb, yb)."""
    at = lambda f: F.floor(f("y1", "y2") / F.lit(cell)).cast("int")
    out = sides.withColumn("cy", F.explode(F.sequence(at(F.least), at(F.greatest))))
    low = F.col("cy") * F.lit(cell)
    out = out.withColumns({"ya": _clip(F.col("y1"), low, low + F.lit(cell)), "yb": _clip(F.col("y2"), low, low + F.lit(cell))})
    cut = lambda y, flat: F.when(F.col("y1") == F.col("y2"), F.col(flat)).when(F.col(y) == F.col("y1"), F.col("x1")).when(F.col(y) == F.col("y2"), F.col("x2")).otherwise(F.col("x1") + (F.col(y) - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    return out.withColumns({"xa": cut("ya", "x1"), "xb": cut("yb", "x2")})


def _crossed(x: Column, y: Column) -> Column:
    """1 where the ray from a place to the right meets an edge; of an edge's ends the lower one counts, so a vertex on the ray is met once or not at all."""
    met = ((F.col("y1") > y) != (F.col("y2") > y)) & (x < F.col("x1") + (y - F.col("y1")) * (F.col("x2") - F.col("x1")) / (F.col("y2") - F.col("y1")))
    return F.coalesce(met, F.lit(False)).cast("int")


def cover(sides: DataFrame, cell: float) -> DataFrame:
    """(zone, cy, cx, whole): the cells that a zone's edges touch (whole is false) and those inside it that none touches.

    Between two touched cells of a scanline all cells are alike, so one probe tells of each such gap.
    """
    bands = _bands(sides, cell)
    at = lambda f, m: F.floor(f("xa", "xb") / F.lit(cell) + F.lit(m)).cast("int")
    touched = bands.select("zone", "cy", F.explode(F.sequence(at(F.least, -MARGIN), at(F.greatest, MARGIN))).alias("cx")).distinct()
    gaps = touched.withColumn("to", F.lead("cx").over(Window.partitionBy("zone", "cy").orderBy("cx")) - 1).withColumn("from", F.col("cx") + 1).where("to >= from")
    middle = lambda c: (F.col(c) + F.lit(0.5)) * F.lit(cell)
    probed = gaps.join(bands.where("y1 <> y2").select("zone", "cy", "x1", "y1", "x2", "y2"), ["zone", "cy"])
    odd = probed.groupBy("zone", "cy", "from", "to").agg((F.sum(_crossed(middle("from"), middle("cy"))) % 2).alias("odd")).where("odd = 1")
    whole = odd.select("zone", "cy", F.explode(F.sequence("from", "to")).alias("cx"), F.lit(True).alias("whole"))
    return touched.withColumn("whole", F.lit(False)).unionAll(whole)


def inside(sides: DataFrame, points: DataFrame, ident: list[str], cell: float) -> DataFrame:
    """(zone, *ident) of points (ident, x, y) inside zones: an odd number of edges lies to their right, so holes are out.

    ident tells points apart. Points meet the cells of zones; those in a cell without edges are in or out with it, and only the others
    meet the edges of their own scanline. On an edge, points of the left and lower side are in, those of the right and upper side out.
    A place with many points is looked up once, and its points meet only the zones it is in. Points without coordinates are in no zone.
    """
    own = points.where(F.col("x").isNotNull() & F.col("y").isNotNull()).select(*ident, F.col("x").cast("double").alias("_x"), F.col("y").cast("double").alias("_y"))
    at = lambda c: F.floor(F.col(c) / F.lit(cell)).cast("int")
    spots = own.groupBy("_x", "_y").agg(F.ceil(F.count("*") / TOGETHER).cast("int").alias("_parts"))
    met = spots.withColumns({"cy": at("_y"), "cx": at("_x")}).join(cover(sides, cell), ["cy", "cx"])
    bands = _bands(sides, cell).where("y1 <> y2").select("zone", "cy", "x1", "y1", "x2", "y2")
    near = met.where(~F.col("whole")).join(bands, ["zone", "cy"]).groupBy("zone", "_x", "_y", "_parts").agg((F.sum(_crossed(F.col("_x"), F.col("_y"))) % 2).alias("odd"))
    found = met.where("whole").select("zone", "_x", "_y", "_parts").unionAll(near.where("odd = 1").select("zone", "_x", "_y", "_parts"))
    found = found.withColumn("_part", F.explode(F.sequence(F.lit(0), F.col("_parts") - 1))).drop("_parts")
    many = spots.where("_parts > 1").withColumnsRenamed({"_x": "_mx", "_y": "_my"})  # one place in TOGETHER rows at most
    own = own.join(F.broadcast(many), (F.col("_x") == F.col("_mx")) & (F.col("_y") == F.col("_my")), "left")
    own = own.withColumn("_part", F.pmod(F.xxhash64(*ident), F.coalesce("_parts", F.lit(1))).cast("int"))
    key = ("_x", "_y", "_part")
    return spread(own, *key).join(spread(found, *key), list(key)).select("zone", *ident)


def painted_polygons(sides: DataFrame, codes: DataFrame, pixels: DataFrame, cell: float) -> DataFrame:
    """Pixels (x, y) with the code of the polygon they are in; of several the last one painted: codes has zone, ordem, code."""
    met = inside(sides, pixels.select("x", "y").distinct(), ["x", "y"], cell).join(codes, "zone")
    return met.groupBy("x", "y").agg(F.max_by("code", "ordem").alias("code"))


def ring_areas(sides: DataFrame) -> DataFrame:
    """(zone, ring, area): positive where the ring runs against the clock (y upward)."""
    part = (F.col("x1") * F.col("y2") - F.col("x2") * F.col("y1")) / F.lit(2.0)
    return sides.groupBy("zone", "ring").agg(F.sum(part.cast(EXACT)).cast("double").alias("area"))


def weights(sides: DataFrame, size: float, holes: DataFrame | None = None) -> DataFrame:
    """(zone, row, col, weight): the share of each pixel, row = floor(y / size) and col = floor(x / size), that is inside a zone; none are 0.

    holes names the rings (zone, ring) that are holes; rings may run either way. An edge's part in a pixel leaves some area of it to its right, and all of the pixels further right in that row, as
    high as the part is; signed and added up along the row, these areas are what is inside. Rings of a zone must not cross.
    """
    turned = ring_areas(sides).withColumn("sign", F.when(F.col("area") >= 0, -1.0).otherwise(1.0))
    if holes is not None:
        turned = turned.join(holes.select("zone", "ring").distinct().withColumn("hole", F.lit(True)), ["zone", "ring"], "left").withColumn("sign", F.when(F.col("hole"), -F.col("sign")).otherwise(F.col("sign")))
    parts = _bands(sides.join(turned.select("zone", "ring", "sign"), ["zone", "ring"]).where("y1 <> y2"), size).where("ya <> yb")
    at = lambda f: F.floor(f("xa", "xb") / F.lit(size)).cast("int")
    parts = parts.withColumn("col", F.explode(F.sequence(at(F.least), at(F.greatest))))
    left = F.col("col") * F.lit(size)
    right = left + F.lit(size)
    xs, xe = _clip(F.col("xa"), left, right), _clip(F.col("xb"), left, right)
    share = F.when(F.col("xa") == F.col("xb"), F.lit(1.0)).otherwise((xe - xs) / (F.col("xb") - F.col("xa")))
    high = F.col("sign") * (F.col("yb") - F.col("ya")) * share
    summed = parts.groupBy("zone", F.col("cy").alias("row"), "col").agg(F.sum(high.cast(EXACT)).alias("high"), F.sum((high * (right - (xs + xe) / F.lit(2.0))).cast(EXACT)).alias("area"))
    row = Window.partitionBy("zone", "row").orderBy("col")
    summed = summed.withColumns({"before": F.coalesce(F.sum("high").over(row.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0).cast(EXACT)), "next": F.lead("col").over(row)})
    edge = summed.select("zone", "row", "col", (F.col("before").cast("double") / F.lit(size) + F.col("area").cast("double") / F.lit(size * size)).alias("weight"))
    full = summed.where("next > col + 1").select("zone", "row", F.explode(F.sequence(F.col("col") + 1, F.col("next") - 1)).alias("col"), ((F.col("before") + F.col("high")).cast("double") / F.lit(size)).alias("weight"))
    return edge.unionAll(full).where(F.col("weight") > 1e-12)


def weighted(shares: DataFrame, pixels: DataFrame, value: str) -> DataFrame:
    """By zone, of pixels (row, col, value): mean_v and sum_v weighted by the pixels' shares inside, weight (their sum) and n (pixels with a value)."""
    met = shares.join(pixels.where(F.col(value).isNotNull()).select("row", "col", F.col(value).cast("double").alias("v")), ["row", "col"])
    add = lambda c: F.sum(c.cast("decimal(38,12)")).cast("double")
    out = met.groupBy("zone").agg(add(F.col("weight") * F.col("v")).alias("sum_v"), add(F.col("weight")).alias("weight"), F.count("*").alias("n"))
    return out.withColumn("mean_v", F.try_divide("sum_v", "weight"))


def weighted_mode(shares: DataFrame, pixels: DataFrame, code: str) -> DataFrame:
    """By zone the code that covers most of it, ties by the least, and its share of what has a code: moda, pct."""
    own = shares.join(pixels.where(F.col(code).isNotNull()).select("row", "col", F.col(code).alias("code")), ["row", "col"])
    sizes = own.groupBy("zone", "code").agg(F.sum(F.col("weight").cast("decimal(38,12)")).alias("w"))
    best = sizes.groupBy("zone").agg(F.max_by("code", F.struct("w", -F.col("code"))).alias("moda"), F.max("w").cast("double").alias("w"), F.sum("w").cast("double").alias("t"))
    return best.select("zone", "moda", (F.lit(100.0) * F.col("w") / F.col("t")).alias("pct"))
