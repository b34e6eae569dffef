"""Incremental work: only what has no sound result yet, in batches or from a stream."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.functions.values import exact_avg
from sitelens.operators.storage import settle, shared_folder


def changed(inputs: DataFrame, done: DataFrame, keys: list[str], digest: str = "sha256") -> DataFrame:
    """Inputs whose key is not among the done ones with the same digest."""
    return inputs.join(done.select(*keys, digest), [*keys, digest], "left_anti")


def daily_means(events: DataFrame, delay: str = "1 day") -> DataFrame:
    """Mean and number of values per type and day; late events count up to the delay."""
    day = F.window(F.col("ts").cast("timestamp"), "1 day")
    return events.withColumn("ts", F.col("ts").cast("timestamp")).withWatermark("ts", delay).groupBy(day, "event_type").agg(exact_avg(F.col("value")).alias("mean_v"), F.count("value").alias("n"))


def drained(stream: DataFrame, name: str) -> DataFrame:
    """What a stream's aggregation comes to over all input that is there now, batch by batch; state and progress are kept in the shared folder.

    Each batch gives the groups that it changed; the last one that gave a group holds.
    """
    spark = stream.sparkSession
    folder = f"{shared_folder(spark).rstrip('/')}/{name}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("append").parquet(f"{folder}/rows")

    stream.writeStream.outputMode("update").option("checkpointLocation", f"{folder}/state").foreachBatch(keep).trigger(availableNow=True).start().awaitTermination()
    rows = spark.read.parquet(f"{folder}/rows")
    keys = [c for c in ("window", "event_type") if c in rows.columns]
    return settle(rows.groupBy(*keys).agg(F.max_by(F.struct(*[c for c in rows.columns if c not in (*keys, "_batch")]), "_batch").alias("b")).select(*keys, "b.*"))
