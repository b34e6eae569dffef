"""Embedding near-duplicates by tiled comparison in the order of principal components.

Unit vectors are rotated so that their leading coordinates carry most of their length. Cells of the first
coordinate, as wide as two vectors at the threshold can differ, cut each label into packs of about
PACK bytes; only packs of the same or neighbouring cells meet, each once, and what moves for that is a pack, not a tile: two packs
meet in tiles of SIDE x SIDE vectors. A tile adds up products by
groups of leading coordinates; what the rest can add is at most the product of the suffix norms, so rows
and columns that cannot reach the threshold any more are left out, and a tile without any ends. Cosines
near the threshold are computed again from the vectors as given, in double precision.

Equal vectors of a label are compared once. A tile returns a link count per vector and links that span its
components, never its pairs.

Cases: null, empty or zero vectors, and ones with null or non-finite components, link with nothing, like
those without label; so do vectors of different lengths. Rows without an id have component null and are kept.
Repeated ids are one node, whose links add up. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import session

#: Bytes of the vectors of a pack, and vectors of a side of a tile.
PACK, SIDE, GROUP, CLOSE = 1 << 22, 1024, 16, 1e-9


def _matrix(column: pa.Array, dim: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(-1, dim)


def _moments(batches):
    total: dict[int, np.ndarray] = {}
    for batch in batches:
        sizes = batch.column(0).value_lengths().to_numpy()
        for dim in np.unique(sizes).tolist():
            m = _matrix(batch.column(0).filter(pa.array(sizes == dim)), dim)
            m /= np.sqrt((m * m).sum(axis=1, keepdims=True))
            total[dim] = total.get(dim, 0) + m.T @ m
    yield pa.RecordBatch.from_arrays([pa.array(list(total), pa.int32()), pa.array([int(x[0, 0] * 1e6) % 64 for x in total.values()], pa.int32()), pa.array([x.tobytes() for x in total.values()], pa.binary())], ["dim", "salt", "m"])


def _add(table: pa.Table) -> pa.Table:
    whole = sum(np.frombuffer(x.as_buffer()) for x in table.column("m"))
    return pa.table({"dim": table.column("dim").slice(0, 1), "m": pa.array([whole.tobytes()], pa.binary())})


def rotations(vectors: DataFrame) -> dict[int, np.ndarray]:
    """For each vector length the orthogonal matrix of principal directions, greatest first.

    The driver gets at most 64 matrices for each length.
    """
    parts = vectors.select("v").mapInArrow(_moments, "dim int, salt int, m binary").groupBy("dim", "salt").applyInArrow(_add, "dim int, m binary").collect()
    whole: dict[int, np.ndarray] = {}
    for r in parts:
        whole[r.dim] = whole.get(r.dim, 0) + np.frombuffer(r.m).reshape(r.dim, r.dim)
    return {d: np.linalg.eigh(m)[1][:, ::-1] for d, m in whole.items()}


def _rotate(shared, width: float):
    def run(batches):
        for batch in batches:
            sizes = batch.column(3).value_lengths().to_numpy()
            for dim in np.unique(sizes).tolist():
                part = batch.filter(pa.array(sizes == dim))
                raw = _matrix(part.column(3), dim)
                unit = raw / np.sqrt((raw * raw).sum(axis=1, keepdims=True)) @ shared.value[dim]
                cell = np.floor(unit[:, 0] / width).astype(np.int32)
                yield pa.RecordBatch.from_arrays([part.column(0), part.column(1), part.column(2), pa.array(np.full(len(raw), dim, np.int32)), pa.array(cell), pa.array([x.tobytes() for x in unit], pa.binary()), pa.array([x.tobytes() for x in raw], pa.binary())], ["label", "id", "c", "dim", "cell", "unit", "raw"])

    return run


def tile(a: np.ndarray, b: np.ndarray, threshold: float) -> np.ndarray:
    """Cosines of unit rows a and b where they may reach the threshold, and -2 where suffix norms rule it out."""
    out = np.full((len(a), len(b)), -2.0)
    rows, cols = np.arange(len(a)), np.arange(len(b))
    so_far = np.zeros(out.shape)
    for at in range(0, a.shape[1], GROUP):
        so_far += a[rows, at : at + GROUP] @ b[cols, at : at + GROUP].T
        rest_a, rest_b = (np.sqrt((x[i, at + GROUP :] ** 2).sum(axis=1)) for x, i in ((a, rows), (b, cols)))
        may = so_far + rest_a[:, None] * rest_b[None, :] >= threshold - CLOSE
        keep_a, keep_b = may.any(axis=1), may.any(axis=0)
        if not keep_a.any():
            return out
        if keep_a.sum() * keep_b.sum() < 0.7 * may.size:
            rows, cols, so_far = rows[keep_a], cols[keep_b], so_far[np.ix_(keep_a, keep_b)]
    out[np.ix_(rows, cols)] = so_far
    return out


def _span(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least node of each node's component among n nodes with edges a, b."""
    root = np.arange(n)
    while True:
        low = root.copy()
        np.minimum.at(low, a, root[b])
        np.minimum.at(low, b, root[a])
        low = low[low]
        if (low == root).all():
            return root
        root = low


def _compare(threshold: float):
    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                sides = [batch.column(i).slice(k, 1).flatten() for i in (1, 2)]
                same = batch.column(0)[k].as_py()
                (ia, ca, ua, ra), (ib, cb, ub, rb) = ((s.field("id").to_numpy(), s.field("c").to_numpy(), *(np.stack([np.frombuffer(x.as_buffer()) for x in s.field(f)]) for f in ("unit", "raw"))) for s in sides)
                ids = np.concatenate((ia, ib))
                count, edges, shift = np.zeros(len(ids), np.int64), [], 0 if same else len(ia)
                for x in range(0, len(ia), SIDE):
                    for y in range(0, len(ib), SIDE):
                        p, q = slice(x, x + SIDE), slice(y, y + SIDE)
                        cos = tile(ua[p], ub[q], threshold)
                        for i, j in np.argwhere(np.abs(cos - threshold) < CLOSE):
                            u, v = ra[x + i], rb[y + j]
                            cos[i, j] = u @ v / (math.sqrt(u @ u) * math.sqrt(v @ v))
                        link = cos >= threshold
                        if same and x == y:
                            np.fill_diagonal(link, False)
                        i, j = np.nonzero(link)
                        count[x : x + link.shape[0]] += link @ cb[q]
                        if not same:
                            count[len(ia) + y : len(ia) + y + link.shape[1]] += ca[p] @ link
                        root = _span(sum(link.shape), i, j + link.shape[0])
                        at = np.flatnonzero(root != np.arange(len(root)))
                        place = np.concatenate((np.arange(x, x + link.shape[0]), np.arange(y, y + link.shape[1]) + shift))
                        edges.append(np.stack((place[at], place[root[at]])))
                root = _span(len(ids), *np.concatenate(edges, axis=1))
                some = np.flatnonzero(count)
                yield pa.RecordBatch.from_arrays([pa.array(ids[some]), pa.array(count[some]), pa.array(ids[root[some]])], ["id", "n", "to"])

    return run


def near_duplicates(rows: DataFrame, threshold: float = 0.93, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label") -> DataFrame:
    """vec_id, n_links, component_id and kept for every row; only vectors of equal labels link."""
    spark = rows.sparkSession
    every = rows.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v"), F.col(label_col).alias("label"))
    sound = every.where("vec_id is not null and label is not null and size(v) > 0 and forall(v, x -> x is not null and not isnan(x) and abs(x) < double('Infinity')) and exists(v, x -> x <> 0)")
    distinct = session.settle(sound.groupBy("label", "v").agg(F.min("vec_id").alias("id"), F.count("*").alias("c")).select("label", "id", "c", "v"))
    shared = spark.sparkContext.broadcast(rotations(distinct))
    width = math.sqrt(2 * (1 - threshold)) + 1e-6
    turned = session.settle(distinct.mapInArrow(_rotate(shared, width), f"label {distinct.schema['label'].dataType.simpleString()}, id long, c long, dim int, cell int, unit binary, raw binary"))
    sizes = turned.groupBy("label", "dim", "cell").agg(F.count("*").alias("m"))
    packed = turned.join(sizes, ["label", "dim", "cell"]).withColumn("pack", F.expr(f"int(pmod(xxhash64(id), ceil(m * dim * 16 / {PACK})))"))
    packs = session.settle(packed.groupBy("label", "dim", "cell", "pack").agg(F.collect_list(F.struct("id", "c", "unit", "raw")).alias("members")))
    x, y = packs.alias("x"), packs.alias("y")
    meet = F.expr("x.label = y.label and x.dim = y.dim and (x.cell = y.cell and x.pack <= y.pack or x.cell + 1 = y.cell)")
    pairs = x.join(y, meet).select(F.expr("x.cell = y.cell and x.pack = y.pack").alias("same"), F.col("x.members").alias("a"), F.col("y.members").alias("b"))
    linked = session.settle(pairs.repartition(F.xxhash64("a.id"), F.xxhash64("b.id")).mapInArrow(_compare(threshold), "id long, n long, to long"))
    counts = linked.groupBy("id").agg(F.sum("n").alias("n"))
    named = session.components(linked.select(F.col("id").alias("a"), F.col("to").alias("b")))
    classes = distinct.join(counts, "id", "left").join(named, "id", "left").select("label", "v", (F.coalesce("n", F.lit(0)) + F.col("c") - 1).alias("n"), F.coalesce("component", "id").alias("component"))
    good = sound.join(classes, ["label", "v"]).groupBy("vec_id").agg(F.sum("n").alias("n"), F.min("component").alias("component"))
    out = every.select("vec_id").join(good, "vec_id", "left").select("vec_id", F.coalesce("n", F.lit(0)).cast("long").alias("n_links"), F.coalesce("component", "vec_id").alias("component_id"))
    return out.withColumn("kept", F.expr("vec_id is null or vec_id = component_id"))


def op8_embedding_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Every vector of `embeddings`, cosine 0.93 or more among equal labels."""
    session.workers_find_package(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/embeddings.parquet"))
