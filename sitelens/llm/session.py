"""Cutting lineage in shared storage, and connected components over link tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder that all executors share: spark.checkpoint.dir, or a temporary one where that is unset and driver and executors are one machine.

    Raises ValueError where it is unset on a cluster: its executors would not find each other's files.
    """
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sitelens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def settle(df: DataFrame) -> DataFrame:
    """Writes df to the shared folder and reads it back: a lost executor costs no recomputation of what came before.

    The table is removed by forget(), or when the driver's Python ends.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/sitelens-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.parquet(path)
    out._settled = path
    return out


def settle_by(df: DataFrame, key: str) -> DataFrame:
    """As settle, in as many buckets of key as the session has shuffle partitions: joins on key do not move the table again."""
    spark = df.sparkSession
    name = f"sitelens_{uuid.uuid4().hex}"
    path = f"{shared_folder(spark).rstrip('/')}/{name}"
    df.write.bucketBy(int(spark.conf.get("spark.sql.shuffle.partitions")), key).option("path", path).format("parquet").saveAsTable(name)
    atexit.register(_unname, spark, name, path)
    out = spark.table(name)
    out._settled, out._name = path, name
    return out


def release(spark: SparkSession) -> None:
    """Has the driver's JVM collect what is finished, so that Spark removes the shuffles of steps whose results are settled."""
    spark._jvm.System.gc()


def forget(df: DataFrame) -> None:
    """Removes a settled table that nothing reads any more."""
    path = getattr(df, "_settled", None)
    if path and getattr(df, "_name", None):
        _unname(df.sparkSession, df._name, path)
    elif path:
        _remove(df.sparkSession, path)


def _unname(spark: SparkSession, name: str, path: str) -> None:
    try:
        spark.sql(f"drop table if exists {name}")
    except Exception:  # the session has ended, and its names with it
        pass
    _remove(spark, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: nothing is left that could remove it
        pass


#: Bytes of an Arrow batch, where the session has Spark's own default: a Python worker holds a few times as much.
BATCH_BYTES = 8 << 20


def workers_find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it, and bounds the batches they get."""
    if spark.conf.get("spark.sql.execution.arrow.maxBytesPerBatch", None) in (None, "67108864b"):
        spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(BATCH_BYTES))
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


#: Bits of sift()'s table for each id, and the most of them (16 MB).
SPARSE, TABLE = 16, 1 << 27


def sift(df: DataFrame, key: str, ids: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The rows of df whose key may be in ids, and those whose key is not for certain; ids is a settled table of one column of longs.

    A table of bits by the keys' hashes is broadcast, so that only the first rows, all that match and a few others, have to move for a join.
    """
    bits = min(max(1 << 15, 1 << (SPARSE * ids.count()).bit_length()), TABLE)
    place = lambda c: F.pmod(F.xxhash64(F.col(f"`{c}`").cast("long")), F.lit(bits).cast("long"))
    part, table, step, may = ("_" * (1 + max(map(len, df.columns))) + c for c in "pbsm")  # longer than any of df's names
    own = ids.select(place(ids.columns[0]).alias(step))
    known = own.groupBy(F.bitmap_bucket_number(step).alias(part)).agg(F.bitmap_construct_agg(F.bitmap_bit_position(step)).alias(table))
    at = F.bitmap_bit_position(place(key))
    byte = F.conv(F.hex(F.substring(table, F.floor(at / 8).cast("int") + 1, F.lit(1))), 16, 10).cast("int")
    held = df.withColumn(part, F.bitmap_bucket_number(place(key))).join(F.broadcast(known), part, "left").withColumn(step, (at % 8).cast("int"))
    held = held.withColumn(may, F.coalesce(F.call_function("shiftright", byte, F.col(step)) % 2 == 1, F.lit(False)))
    columns = [F.col(f"`{c}`") for c in df.columns]
    return held.where(F.col(may)).select(columns), held.where(~F.col(may)).select(columns)


#: Links that the driver joins alone: rounds of Spark cost more than these few take.
FEW_LINKS = 1 << 17


def _least(a: np.ndarray, b: np.ndarray) -> pa.Table:
    """(id, component) of the ids in links (a, b)."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root = list(range(len(nodes)))
    for x, y in zip(at[: len(a)].tolist(), at[len(a) :].tolist()):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        root[max(x, y)] = min(x, y)
    for x in range(len(root)):  # a root is never above its members
        root[x] = root[root[x]]
    return pa.table({"id": nodes, "component": nodes[root] if len(nodes) else nodes})


def components(links: DataFrame) -> DataFrame:
    """(id, component) for every id in links (a, b): component is the smallest id it can reach.

    Up to FEW_LINKS different links are joined by the driver. For more, it
    alternates large-star and small-star steps; each works on the link table with one aggregation and
    one join, and the table is written to shared storage between rounds. Rounds grow with the logarithm
    of the number of links, not with the length of chains. Links to itself and repeated links do no harm; null
    ids are left out; no links give no rows.
    """
    edge = links.select(F.col("a").cast("long").alias("a"), F.col("b").cast("long").alias("b")).where("a is not null and b is not null and a <> b")
    edge = settle(edge.select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    seen = _mark(edge)
    if seen[0] <= FEW_LINKS:
        table = edge.toArrow()
        forget(edge)
        return edge.sparkSession.createDataFrame(_least(*[table.column(c).to_numpy().astype(np.int64) for c in ("a", "b")]))
    while True:
        both = edge.select("a", "b").unionAll(edge.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.least(F.min("b"), F.col("a")).alias("m"))
        star = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b")).distinct()
        low = star.groupBy("a").agg(F.min("b").alias("m"))
        down = star.join(low, "a").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        before, edge = edge, settle(down.unionAll(low.select("a", F.col("m").alias("b"))).where("a <> b").distinct())
        forget(before)
        mark = _mark(edge)
        if mark == seen:
            break
        seen = mark
    roots = edge.select(F.col("b").alias("id"), F.col("b").alias("component"))
    return edge.select(F.col("a").alias("id"), F.col("b").alias("component")).unionAll(roots).distinct()


def _mark(edge: DataFrame) -> tuple:
    """Tells link tables apart by one small aggregate."""
    return tuple(edge.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("a", "b").cast("decimal(38,0)")), F.lit(0))).first())
