"""Exact nearest neighbours by pivots: each row meets the blocks of rows that its distances to pivots cannot rule out, and no others.

Rows of a group are dealt to the cell of their nearest pivot and ordered in it by their distance to that pivot, in blocks of
BLOCK rows. A row first meets its own block, which bounds the distance of its k-th neighbour. By the triangle inequality a
row at distance t from a cell's pivot is at least t - r from all rows within r of it, and |t - s| from a row at distance s; so
the row goes on only to cells, and in these to blocks, within its bound. What it has met is cut to its k best before it moves.
Blocks, the queries that meet one and the chunks that are compared with pivots all have a bounded number of rows, whatever a
group's size; a group of up to BLOCK rows is one block.

In more than FEW columns such bounds rule out next to nothing. There rows are dealt to parts of about SQUARE rows, every two parts of a group meet
in a task of their own, and a matrix product tells which rows can be among the nearest; only for these are distances summed. Work is quadratic in
a group, as no bound helps, but a row moves once for each SQUARE rows of its group, and a task holds two parts, whatever the group's size.

Rows at one and the same place stand for each other: the k + 1 least ids of a place are kept to be found (more are in nobody's
neighbours), and a place is searched for once, so thousands of copies cost no more than a few.

Distances are sums over columns in their order, as in SQL, so results do not depend on the way they were found.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from sitelens.operators.storage import drop, numbered, settle, spread, workers_find_package

#: Rows of a block; rows a cell should have; most cells of a group; rows compared with pivots, or with a block, at once.
BLOCK, CELL, PIVOTS, CHUNK = 2048, 1024, 512, 4096
#: Queries of a tile, columns summed before rows are given up. What rounding can add to a bound.
TILE, COLUMNS, SLACK = 256, 8, 1e-9
#: Columns up to which pivots rule rows out; rows of a part beyond that.
FEW, SQUARE = 16, 16384


def standard(rows: DataFrame, ident: str, group: str, columns: list[str]) -> DataFrame:
    """(ident, g, v): population z-scores within each group, from exact sums; a constant column is divided by 1.

    Rows with a null group, or a null or NaN in a column, are left out.
    """
    given = rows.select(F.col(ident), F.col(group).alias("g"), F.array(*[F.col(c).cast("double") for c in columns]).alias("x"))
    given = given.where(F.col("g").isNotNull() & ~F.exists("x", lambda x: x.isNull() | F.isnan(x)))
    each = given.select("g", F.posexplode("x").alias("k", "x"))
    exact = lambda c: F.sum(c.cast("decimal(38,10)")).cast("double")
    n, s, q = F.count("*").cast("double"), exact(F.col("x")), exact(F.col("x") * F.col("x"))
    own = each.groupBy("g", "k").agg((s / n).alias("mean"), (q / n).alias("square"))
    var = F.greatest(F.lit(0.0), F.col("square") - F.col("mean") * F.col("mean"))
    own = own.withColumn("by", F.coalesce(F.nullif(F.sqrt(var), F.lit(0.0)), F.lit(1.0)))
    told = own.groupBy("g").agg(F.array_sort(F.collect_list(F.struct("k", "mean", "by"))).alias("s"))  # as many as columns
    z = F.zip_with("x", "s", lambda x, s: (x - s["mean"]) / s["by"])
    return given.join(told, "g").select(ident, "g", z.alias("v"))


def distances(queries: np.ndarray, members: np.ndarray, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distances of all queries to those members that are within the bound of any of them, and which these are.

    Columns are summed one after the other; after every COLUMNS, members beyond all bounds are given up.
    """
    at = np.arange(len(members))
    total = np.zeros((len(queries), len(members)))
    most = (bound * (1 + SLACK)) ** 2
    for c in range(queries.shape[1]):
        step = queries[:, c, None] - members[None, at, c]
        total += step * step
        if (c + 1) % COLUMNS == 0 and c + 1 < queries.shape[1]:
            stay = (total <= most[:, None]).any(axis=0)
            if stay.mean() < 0.75:
                total, at = total[:, stay], at[stay]
    return np.sqrt(total), at


def _first(q: np.ndarray, m: np.ndarray, d: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of (query, member, distance) each query's k nearest, ties by member, in order."""
    order = np.lexsort((m, d, q))
    q, m, d = q[order], m[order], d[order]
    near = np.arange(len(q)) - np.searchsorted(q, q) < k
    return q[near], m[near], d[near]


def best(queries: np.ndarray, members: np.ndarray, k: int, bound: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest members within the bound of each query (query, member, distance), ties by the place in members. Only those within the bound are sorted."""
    out = [(np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))]
    for first in range(0, len(queries), TILE):
        own = slice(first, first + TILE)
        dist, at = distances(queries[own], members, bound[own])
        most = bound[own] * (1 + SLACK)
        wide = np.isinf(most)
        if wide.any() and dist.shape[1] > k:
            most[wide] = np.partition(dist[wide], k - 1, axis=1)[:, k - 1]
        q, m = np.nonzero(dist <= most[:, None])
        q, m, d = _first(q, m, dist[q, m], k)
        out.append((q + first, at[m], d))
    return tuple(np.concatenate(x) for x in zip(*out))


def closest(queries: np.ndarray, members: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The k nearest members of each query (query, member, distance), in order of query, distance and member.

    A matrix product gives squared distances but for rounding; those that are not beyond a query's k-th so far, with room for that, are summed column by column.
    """
    room = 1e-14 * (queries.shape[1] + 8)
    sizes = (members * members).sum(axis=1)
    out = []
    for first in range(0, len(queries), TILE):
        own = queries[first : first + TILE]
        size = (own * own).sum(axis=1)
        most = np.full(len(own), np.inf)
        q, m, d = np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0)
        for low in range(0, len(members), BLOCK):
            other = members[low : low + BLOCK]
            both = size[:, None] + sizes[None, low : low + BLOCK]
            near = both - 2 * (own @ other.T)
            spare = room * both.max(axis=1)
            if len(other) >= k and not np.isfinite(most).all():
                most = np.minimum(most, np.partition(near, k - 1, axis=1)[:, k - 1] + spare)
            i, j = np.nonzero(near <= (most + spare)[:, None])
            total = np.zeros(len(i))
            for c in range(queries.shape[1]):
                step = own[i, c] - other[j, c]
                total += step * step
            q, m, d = _first(np.concatenate((q, i)), np.concatenate((m, j + low)), np.concatenate((d, np.sqrt(total))), k)
            last = np.flatnonzero(np.arange(len(q)) - np.searchsorted(q, q) == k - 1)
            most[q[last]] = (d[last] * (1 + SLACK)) ** 2
        out.append((q + first, m, d))
    return tuple(np.concatenate(x) for x in zip(*out))


def _met_parts(ident: str, k: int):
    """Of the places that ask in two parts, the k nearest of the other part's rows; of a part that meets itself, of its own."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ident)
        first, same = (rows["own"] == rows["i"]).to_numpy(), rows["i"].iloc[0] == rows["j"].iloc[0]
        v, asks, idents = _matrix(rows["v"]), rows["asks"].to_numpy(bool), rows[ident].to_numpy()
        out = [_tell(ident, idents[:0], idents[:0], _NOTHING)]
        for own in [first] if same else [first, ~first]:
            who, met = own & asks, own if same else ~own
            if who.any() and met.any():
                out.append(_tell(ident, idents[who], idents[met], closest(v[who], v[met], k)))
        return pd.concat(out[1:] or out, ignore_index=True)

    return run


def in_parts(members: DataFrame, ident: str) -> DataFrame:
    """Each group's rows once for each part of it (g, i, j, own, ident, v, asks): parts own and another are i and j, the lesser first."""
    size = members.groupBy("g").agg(F.ceil(F.count("*") / SQUARE).cast("int").alias("parts"))
    own = members.join(F.broadcast(size), "g").withColumn("own", F.pmod(F.xxhash64(F.col(ident)), F.col("parts")).cast("int"))
    own = own.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    return own.select("g", F.least("own", "other").alias("i"), F.greatest("own", "other").alias("j"), "own", ident, "v", "asks")


def _squares(members: DataFrame, ident: str, k: int) -> DataFrame:
    """What the places that ask find in each part of their group; two parts meet once, for both."""
    keys = ("g", "i", "j")
    return spread(in_parts(members, ident), *keys).groupBy(*keys).applyInPandas(_met_parts(ident, k), _found(ident, members.schema[ident].dataType))


def _found(ident: str, kind: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(ident, kind), T.StructField("vizinho", kind), T.StructField("dist", T.DoubleType())])


def _matrix(column: pd.Series) -> np.ndarray:
    return np.stack(column.to_numpy()) if len(column) else np.zeros((0, 0))


def _tell(ident: str, who: np.ndarray, idents: np.ndarray, found: tuple[np.ndarray, np.ndarray, np.ndarray]) -> pd.DataFrame:
    q, m, d = found
    return pd.DataFrame({ident: who[q], "vizinho": idents[m], "dist": d})


_NOTHING = tuple(np.zeros(0, kind) for kind in (np.int64, np.int64, float))


def _own_block(ident: str, k: int):
    """Of a block's places, the k nearest of its rows."""

    def run(rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ident)
        v, asks, idents = _matrix(rows["v"]), rows["asks"].to_numpy(), rows[ident].to_numpy()
        return _tell(ident, idents[asks], idents, best(v[asks], v, k, np.full(asks.sum(), np.inf)) if asks.any() else _NOTHING)

    return run


def _met_block(ident: str, k: int):
    """Of the rows that ask of a block, the k nearest of its rows within their bounds."""

    def run(asks: pd.DataFrame, rows: pd.DataFrame) -> pd.DataFrame:
        rows = rows.sort_values(ident)
        found = best(_matrix(asks["v"]), _matrix(rows["v"]), k, asks["bound"].to_numpy()) if len(asks) and len(rows) else _NOTHING
        return _tell(ident, asks[ident].to_numpy(), rows[ident].to_numpy(), found)

    return run


def _nearest_pivot(rows: pd.DataFrame, pivots: pd.DataFrame) -> pd.DataFrame:
    rows, pivots = rows.drop(columns="chunk"), pivots.sort_values("cell")
    _, m, d = best(_matrix(rows["v"]), _matrix(pivots["v"]), 1, np.full(len(rows), np.inf)) if len(rows) else _NOTHING
    return rows.assign(cell=pivots["cell"].to_numpy()[m], t=d)


def _within_reach(ident: str, k: int):
    """The cells of a group that may have one of a row's k nearest, by its bound or by the cells that have k rows between them."""

    def run(asks: pd.DataFrame, cells: pd.DataFrame) -> pd.DataFrame:
        out = []
        if len(asks):
            cells = cells.sort_values("cell")
            r, n, names = cells["r"].to_numpy(), cells["n"].to_numpy(), cells["cell"].to_numpy()
            v, pivots, bound = _matrix(asks["v"]), _matrix(cells["v"]), asks["bound"].to_numpy()
            for first in range(0, len(asks), TILE):
                own = slice(first, first + TILE)
                t, _ = distances(v[own], pivots, np.full(len(v[own]), np.inf))
                order = np.argsort(t + r, axis=1)
                enough = (np.cumsum(n[order], axis=1) >= k).argmax(axis=1)
                least = np.take_along_axis(t + r, order[np.arange(len(t)), enough][:, None], axis=1)[:, 0]
                most = np.minimum(bound[own], np.where(n.sum() >= k, least, np.inf)) * (1 + SLACK) + SLACK
                q, c = np.nonzero(t - r <= most[:, None])
                out.append(asks.iloc[first + q][[ident, "g", "v", "own", "block"]].assign(cell=names[c], t=t[q, c], bound=most[q]))
        return pd.concat(out, ignore_index=True) if out else pd.DataFrame({c: [] for c in (ident, "g", "v", "own", "block", "cell", "t", "bound")})

    return run


def _anew(df: DataFrame) -> DataFrame:
    """The same columns under ids of their own, for meeting a table that shares some."""
    return df.select(*[F.col(f"`{c}`").alias(c) for c in df.columns])


def _dealt(rows: DataFrame, small: DataFrame, chunk: int) -> tuple[DataFrame, DataFrame]:
    """Groups' rows in chunks, and the small table's rows of the group for each of its chunks."""
    size = rows.groupBy("g").agg(F.ceil(F.count("*") / chunk).cast("int").alias("chunks"))
    own = rows.join(size, "g").withColumn("chunk", F.pmod(F.xxhash64(rows.columns[0]), F.col("chunks")).cast("int")).drop("chunks")
    return own, _anew(small).join(_anew(size), "g").withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1))).drop("chunks")


def meetings(members: DataFrame, ident: str, k: int) -> tuple[DataFrame, DataFrame, DataFrame, list[DataFrame]]:
    """What has to be compared: settled rows in blocks (ident, g, v, asks, cell, t, block), what they find in their own blocks, the meetings
    (ident, v, bound, block) of those that ask with other blocks, and the settled tables to drop in the end.
    """
    workers_find_package(members.sparkSession)
    kind, place = members.schema[ident].dataType, Window.partitionBy("g").orderBy(F.xxhash64(F.col(ident).cast("string")), ident)
    pivots = members.withColumn("cell", F.row_number().over(place) - 1).where(F.col("cell") < PIVOTS)
    size = members.groupBy("g").agg(F.ceil(F.count("*") / CELL).alias("_m"))
    pivots = settle(pivots.join(size, "g").where(F.col("cell") < F.col("_m")).select("g", "cell", "v"))
    in_cells = T.StructType([*members.schema.fields, T.StructField("cell", T.IntegerType()), T.StructField("t", T.DoubleType())])
    rows, beside = _dealt(members, pivots, CHUNK)
    in_cells = rows.groupBy("g", "chunk").cogroup(beside.groupBy("g", "chunk")).applyInPandas(_nearest_pivot, in_cells)
    blocks = numbered(in_cells, ["g", "cell", "t", ident], "place").withColumn("block", F.floor(F.col("place") / BLOCK)).drop("place")
    blocks = settle(blocks)
    found = settle(blocks.groupBy("g", "cell", "block").applyInPandas(_own_block(ident, k), _found(ident, kind)))
    bound = found.groupBy(ident).agg(F.when(F.count("*") >= k, F.max("dist")).otherwise(F.lit(float("inf"))).alias("bound"))
    cells = settle(blocks.groupBy("g", "cell").agg(F.max("t").alias("r"), F.count("*").alias("n")).join(pivots, ["g", "cell"]))
    asks, beside = _dealt(blocks.where("asks").join(bound, ident).select(ident, "g", "v", "block", F.col("cell").alias("own"), "bound"), cells, CHUNK)
    reach = T.StructType([*[members.schema[c] for c in (ident, "g", "v")], T.StructField("own", T.IntegerType()), T.StructField("block", T.LongType()), T.StructField("cell", T.IntegerType()), *[T.StructField(c, T.DoubleType()) for c in ("t", "bound")]])
    reach = asks.groupBy("g", "chunk").cogroup(beside.groupBy("g", "chunk")).applyInPandas(_within_reach(ident, k), reach)
    edges = blocks.groupBy("g", "cell", "block").agg(F.min("t").alias("low"), F.max("t").alias("high"), F.count("*").alias("rows"))
    near = (F.col("x.t") - F.col("x.bound") <= F.col("y.high")) & (F.col("x.t") + F.col("x.bound") >= F.col("y.low")) & ((F.col("x.block") != F.col("y.block")) | (F.col("x.own") != F.col("y.cell")))
    met = reach.alias("x").join(edges.alias("y"), (F.col("x.g") == F.col("y.g")) & (F.col("x.cell") == F.col("y.cell")) & near)
    return blocks, found, met.select(F.col(f"x.{ident}").alias(ident), "x.v", "x.bound", "y.g", "y.cell", "y.block", "y.rows"), [pivots, cells, blocks, found]


def nearest(rows: DataFrame, ident: str, group: str, columns: list[str], k: int) -> DataFrame:
    """The k nearest others of each row in its group by Euclidean distance of z-scores: ident, rn, vizinho, dist; ties by id.

    ident tells rows apart. Rows alone in their group have no neighbours; those with a null group, or a null or NaN in a column, have none and are nobody's. A
    constant column tells nothing. An empty table gives no rows.
    """
    workers_find_package(rows.sparkSession)
    z = settle(standard(rows, ident, group, columns))
    kind = z.schema[ident].dataType
    # k + 1 ids of a place are enough: each row there leaves itself out. Spark cuts them before they move.
    twin = F.row_number().over(Window.partitionBy("g", "v").orderBy(ident))
    members = settle(z.withColumn("twin", twin).where(F.col("twin") <= k + 1).select(ident, "g", "v", (F.col("twin") == 1).alias("asks")))
    most = members.groupBy("g").count().agg(F.max("count")).first()[0] or 0
    used = [z, members]
    if most <= BLOCK:
        found = members.groupBy("g").applyInPandas(_own_block(ident, k + 1), _found(ident, kind))
    elif len(columns) > FEW:
        found = _squares(members, ident, k + 1)
    else:
        blocks, found, met, more = meetings(members, ident, k + 1)
        met = settle(met)  # read twice
        used += [*more, met]
        dealt = met.groupBy("g", "cell", "block").agg(F.ceil(F.count("*") / CHUNK).cast("int").alias("chunks"))
        met = _anew(met)
        asks = met.join(_anew(dealt), ["g", "cell", "block"]).withColumn("chunk", F.pmod(F.xxhash64(ident), F.col("chunks")).cast("int"))
        meet = _anew(blocks).select(ident, "v", "g", "cell", "block").join(_anew(dealt), ["g", "cell", "block"]).withColumn("chunk", F.explode(F.sequence(F.lit(0), F.col("chunks") - 1)))
        keys = ("g", "cell", "block", "chunk")
        other = asks.groupBy(*keys).cogroup(meet.groupBy(*keys)).applyInPandas(_met_block(ident, k + 1), _found(ident, kind))
        found = found.unionAll(other)
    rank = F.row_number().over(Window.partitionBy(ident).orderBy("dist", "vizinho"))
    found = found.withColumn("rn", rank).where(F.col("rn") <= k + 1)
    near = found.groupBy(ident).agg(F.array_sort(F.collect_list(F.struct("dist", "vizinho"))).alias("near"))  # k + 1 at most
    places = members.where("asks").join(near, ident).select("g", "v", "near")
    others = z.join(places, ["g", "v"]).select(F.col(ident), F.slice(F.filter("near", lambda x: x["vizinho"] != F.col(ident)), 1, k).alias("near"))
    out = others.select(ident, F.posexplode("near").alias("rn", "near")).select(ident, (F.col("rn") + 1).alias("rn"), "near.vizinho", "near.dist")
    out._uses = used  # the tables that the plan reads stay until drop_used(), or until the driver ends
    return out


def drop_used(found: DataFrame) -> None:
    """Removes what a result of nearest() read, when it is written."""
    for table in getattr(found, "_uses", []):
        drop(table)
