"""Tables written to the folder that all executors share, which cut lineage, and ranks over whole tables."""

from __future__ import annotations

import atexit
import os
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a temporary one if driver and executors are one machine, else an error."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        folder = tempfile.mkdtemp(prefix="sitelens-")
        spark.conf.set("spark.checkpoint.dir", folder)
    return folder


def workers_find_package(spark: SparkSession) -> None:
    """Lets Python workers import this package from where the driver has it: to be called before a function is given to Spark."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    known = spark.sparkContext.environment.get("PYTHONPATH", "")
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(x for x in (root, known) if x)


def settle(df: DataFrame) -> DataFrame:
    """Writes df and reads it back; the table goes with drop(), or when the driver's Python ends.

    A written table has a size of its own; estimates carried through checkpoints would multiply from round to round.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark).rstrip('/')}/table-{uuid.uuid4().hex}"
    df.write.parquet(path)
    atexit.register(_remove, spark, path)
    out = spark.read.parquet(path)
    out._settled = path
    return out


def drop(df: DataFrame) -> None:
    """Removes a settled table that nothing reads any more."""
    if path := getattr(df, "_settled", None):
        _remove(df.sparkSession, path)


def _remove(spark: SparkSession, path: str) -> None:
    try:
        target = spark._jvm.org.apache.hadoop.fs.Path(path)
        target.getFileSystem(spark._jsc.hadoopConfiguration()).delete(target, True)
    except Exception:  # the session has ended: nothing is left that could remove it
        pass


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """df dealt by keys to as many parts as spark.sql.shuffle.partitions says, for steps that put out far more than they read: parts merged by what they read would leave these to one task."""
    return df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), *keys)


def numbered(rows: DataFrame, order: list[str], name: str = "place") -> DataFrame:
    """Adds the number from 0 of each row in the order of the columns, which are to tell rows apart.

    Rows are dealt by ranges of the order; a row's number is its place in its part after the sizes of the parts before it, so
    no task sees more than its range, and the driver one size per part.
    """
    ids = settle(rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_id", F.monotonically_increasing_id()))
    part = F.shiftright("_id", 33).cast("int")
    before, starts = 0, []
    for r in sorted(ids.groupBy(part.alias("part")).agg(F.count("*").alias("n")).collect()):
        starts.append((r.part, before))
        before += r.n
    at = rows.sparkSession.createDataFrame(starts, "_part int, _start long")
    out = ids.withColumn("_part", part).join(F.broadcast(at), "_part")
    return out.withColumn(name, F.col("_start") + F.expr("_id & 8589934591L")).drop("_id", "_part", "_start")
