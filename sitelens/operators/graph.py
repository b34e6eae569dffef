"""Proximity links through grid cells, and connected components."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions import geo
from sitelens.operators.storage import drop, settle


def proximity(places: DataFrame, km: float, cell: float | None = None) -> DataFrame:
    """Pairs a < b of places (id, lat, lon) less than km apart, met in the same or neighbouring grid cells.

    With `cell` degrees, cells are truncated toward zero and only the 3 x 3 neighbours are looked at, so far north
    some pairs are missed; without it, cells are as high and, at their latitude, as wide as no pair can exceed, and no pair is.
    """
    if cell is None:
        left = geo.around(places.select(F.col("id").alias("a"), F.col("lat").alias("alat"), F.col("lon").alias("alon")), "alat", "alon", km)
        right = geo.placed(places.select(F.col("id").alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon")), "blat", "blon", km)
    else:
        own = places.withColumn("cy", geo.cell(F.col("lat"), cell)).withColumn("cx", geo.cell(F.col("lon"), cell))
        offsets = [(dy, dx) for dy in (-1, 0, 1) for dx in (-1, 0, 1)]
        around = F.explode(F.array(*[F.struct((F.col("cy") + dy).alias("cy"), (F.col("cx") + dx).alias("cx")) for dy, dx in offsets]))
        left = own.select(F.col("id").alias("a"), F.col("lat").alias("alat"), F.col("lon").alias("alon"), around.alias("c")).select("a", "alat", "alon", "c.cy", "c.cx")
        right = own.select(F.col("id").alias("b"), F.col("lat").alias("blat"), F.col("lon").alias("blon"), "cy", "cx")
    near = left.join(right, ["cy", "cx"]).where(F.col("a") < F.col("b"))
    return near.where(geo.haversine(F.col("alat"), F.col("alon"), F.col("blat"), F.col("blon")) < km).select("a", "b")


#: Links that one numpy pass of the driver joins: rounds of Spark cost more than so few (2 MB of ids) take.
FEW = 1 << 17


def _joined(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """(id, component) of the ids in links: labels spread to the lesser side and jump to their label's label until none changes."""
    ids, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    label = np.arange(len(ids))
    while True:
        low = label.copy()
        np.minimum.at(low, label[x], label[y])
        np.minimum.at(low, label[y], label[x])
        low = low[low[label]]
        if (low == label).all():
            return pa.table({"id": pa.array(ids), "component": pa.array(ids[label])})
        label = low


def components(links: DataFrame) -> DataFrame:
    """(id, component) of all linked ids; component is the least id reached. Links with a null end are left out; an id linked to itself alone is its own component.

    Links are hung on ever fewer stars: in a round every id passes its least neighbour on to its greater ones, then to its lesser ones, so that rounds grow with the logarithm of the
    number of links whatever the length of chains, and each costs one join on the links that are left. Up to FEW links are joined at once by the driver.
    """
    given = links.select("a", "b").where("a is not null and b is not null")
    edge = settle(given.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    if edge.limit(FEW + 1).count() <= FEW:
        found = edge.toArrow()
        drop(edge)
        kind = links.schema["a"].dataType.simpleString()
        out = edge.sparkSession.createDataFrame(_joined(*[found.column(c).to_numpy() for c in "ab"])) if found.num_rows else edge.sparkSession.createDataFrame([], f"id {kind}, component {kind}")
        return out.select(F.col("id").cast(kind).alias("id"), F.col("component").cast(kind).alias("component"))
    alone = settle(edge.where("a = b").select(F.col("a").alias("id")))
    mark = None
    while True:
        own = edge.where("a <> b")
        both = own.unionAll(own.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.first("a")).alias("m"))
        outer = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = outer.groupBy("a").agg(F.min("b").alias("m"))
        inner = outer.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        after = settle(inner.unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        drop(edge)
        edge = after
        told = tuple(edge.agg(F.count("*"), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first())
        if told == mark:
            break
        mark = told
    linked = edge.select(F.col("a").alias("id"), F.col("b").alias("component"))
    roots = edge.select(F.col("b").alias("id"), F.col("b").alias("component")).distinct()
    single = alone.select("id", F.col("id").alias("component")).join(linked.select("id").unionAll(roots.select("id")), "id", "left_anti")
    return linked.unionAll(roots).unionAll(single)


def campuses(places: DataFrame, km: float, cell: float | None = None) -> DataFrame:
    """Components of places by proximity, single ones included: campus (least id), n_predios, lat, lon (means)."""
    named = places.join(components(proximity(places, km, cell)), "id", "left").withColumn("campus", F.coalesce("component", "id"))
    mean = lambda c: F.sum(F.col(c).cast("decimal(28,10)")).cast("double") / F.count(c).cast("double")
    return named.groupBy("campus").agg(F.count("*").alias("n_predios"), mean("lat").alias("lat"), mean("lon").alias("lon"))


def campus_tags(members: DataFrame) -> DataFrame:
    """Of members (campus, pos, tags: map) the last non-empty value of each tag by position: campus, tag, valor."""
    tags = members.select("campus", "pos", F.explode("tags").alias("tag", "valor")).where("valor is not null and valor <> ''")
    return tags.groupBy("campus", "tag").agg(F.max_by("valor", "pos").alias("valor"))
