"""A store of scenes in folders by sensor, site and year: what is there already is not written again, and only the folders asked for are read."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sitelens.operators.storage import drop, settle

KEYS = ("sensor", "site", "ano")
#: Spark's readers pass over names that begin so.
MANIFEST = "_manifest"
#: Up to so many wanted scenes are named to the scan itself.
LISTED = 1000


def _known(spark: SparkSession, path: str) -> bool:
    target = spark._jvm.org.apache.hadoop.fs.Path(f"{path.rstrip('/')}/{MANIFEST}")
    return target.getFileSystem(spark._jsc.hadoopConfiguration()).exists(target)


def digests(scenes: DataFrame, by: list[str]) -> DataFrame:
    """by, n rows and digest of each scene's content, whatever the order of its rows or columns: a sum and an exclusive or of two hashes of rows."""
    rest = sorted(c for c in scenes.columns if c not in by)
    told = F.to_json(F.struct(*rest), {"ignoreNullFields": "false"})
    return scenes.groupBy(*by).agg(F.count("*").alias("n"), F.concat_ws(":", F.lpad(F.hex(F.bit_xor(F.xxhash64(told))), 16, "0"), F.sum(F.xxhash64(F.lit(1), told).cast("decimal(38,0)")).cast("string")).alias("digest"))


def save_scenes(scenes: DataFrame, path: str, by: tuple[str, ...] = KEYS) -> DataFrame:
    """Writes the scenes that are new or have changed, and returns which these were (by, n, digest; settled).

    A scene is replaced whole, others stay. Digests are written after the scenes, into folders like theirs, so a run that was broken off is made up for by the
    next one. Scenes whose key is null have a folder of their own. Without rows nothing is written.
    """
    spark, keys = scenes.sparkSession, list(by)
    own = digests(scenes, keys)
    if _known(spark, path):
        before = spark.read.schema(own.schema).parquet(f"{path.rstrip('/')}/{MANIFEST}")
        same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in (*keys, "n", "digest")]
        own = own.alias("a").join(before.alias("b"), same, "left_anti")
    fresh = settle(own)
    if not fresh.limit(1).count():
        return fresh
    wanted = scenes.alias("a").join(fresh.alias("b"), [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in keys], "left_semi")
    put = lambda df, to: df.write.option("partitionOverwriteMode", "dynamic").partitionBy(*keys).mode("overwrite").parquet(to)
    put(wanted.select("a.*").repartition(*keys), path)
    put(fresh.repartition(1), f"{path.rstrip('/')}/{MANIFEST}")
    return fresh


def read_scenes(spark: SparkSession, path: str, wanted: DataFrame | None = None, by: tuple[str, ...] = KEYS) -> DataFrame:
    """The scenes of the store, or those whose keys are in `wanted` (some of `by`; null keys are not looked for).

    The values of up to LISTED wanted scenes go into the scan, so other folders are not even listed; of more, Spark finds out while it runs which it can pass over.
    """
    rows = spark.read.parquet(path)
    if wanted is None:
        return rows
    keys = [c for c in by if c in wanted.columns]
    scenes = wanted.select(*keys).dropna().distinct()
    few = scenes.limit(LISTED + 1).collect()
    if len(few) <= LISTED:
        for c in keys:
            rows = rows.where(F.col(c).isin(*sorted({r[c] for r in few})))
    return rows.join(scenes, keys, "left_semi")


def forget_scenes(found: DataFrame) -> None:
    """Removes what save_scenes returned."""
    drop(found)
