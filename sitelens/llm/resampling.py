"""Quality classifier by importance resampling: hashed n-gram models of target and raw text, Gumbel top-k.

Words and word pairs are hashed to 2**16 buckets. The raw model counts all texts; the target model counts a
bounded sample of good labelled documents (SAMPLE of them, by least hash of id). A document's log weight is the
mean over its n-grams of log target probability minus log raw probability, divided by a temperature; mean, so that
length alone decides nothing. Each document draws Gumbel noise from a seeded hash of its id, and the k greatest sums of
log weight and noise are kept: a sample without replacement in proportion to the weights.

The driver gets counts per bucket, a few cut points of the sums and counts between them, never rows.

Cases: null and blank texts have weight minus infinity and are never kept; their log_weight is null. Without
good labels all weights are 0. Copies with one id share their noise, and ties at the cut are all kept, so
more than k may be. Null ids draw one common noise. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import session, text

BUCKETS = 1 << 16
SAMPLE = 20_000
TEMPERATURE = 0.01
SHARE = 0.85


def grams(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Buckets and rows of all words and word pairs."""
    hashes, rows, _, _ = text.words(data, offs)
    if not len(hashes):
        return np.zeros(0, np.int64), rows
    same = rows[1:] == rows[:-1]
    pairs = text.mix(hashes[:-1] * np.uint64(3) + hashes[1:])[same]
    return (np.concatenate((hashes, pairs)) >> np.uint64(48)).astype(np.int64), np.concatenate((rows, rows[:-1][same]))


def _count(batches):
    total = np.zeros((2, BUCKETS), np.int64)
    for batch in batches:
        good = batch.column(0).fill_null(False).to_numpy(zero_copy_only=False)
        for at, to, data, offs in text.pieces(batch.column(1)):
            buckets, rows = grams(data, offs)
            total[0] += np.bincount(buckets, minlength=BUCKETS)
            total[1] += np.bincount(buckets[good[at:to][rows]], minlength=BUCKETS)
    for k in (0, 1):
        at = np.flatnonzero(total[k])
        yield pa.RecordBatch.from_arrays([pa.array(np.full(len(at), k, np.int32)), pa.array(at.astype(np.int32)), pa.array(total[k][at])], ["side", "bucket", "n"])


def _weigh(shared):
    def run(batches):
        for batch in batches:
            for at, to, data, offs in text.pieces(batch.column(1)):
                buckets, rows = grams(data, offs)
                n = np.bincount(rows, minlength=to - at)
                total = np.bincount(rows, weights=shared.value[buckets], minlength=to - at)
                mean = pa.array(total / np.maximum(n, 1), mask=n == 0)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), mean, pa.array(n.astype(np.int64))], ["doc_id", "log_ratio", "n_grams"])

    return run


def select(docs: DataFrame, labels: DataFrame, share: float = SHARE, temperature: float = TEMPERATURE, seed: int = 11, sample: int = SAMPLE) -> DataFrame:
    """doc_id, log_ratio (mean per n-gram), n_grams, key (log weight plus noise) and kept, for every row.

    k is `share` of the rows with words. labels: doc_id, quality, toxic; good ones have quality 1 and are not toxic.
    """
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    good = labels.where("quality = 1 and coalesce(toxic, 0) <> 1 and doc_id is not null").select(F.col("doc_id").cast("long").alias("good_id")).distinct()
    good = good.orderBy(F.xxhash64("good_id"), "good_id").limit(sample)
    marked = slim.join(F.broadcast(good), slim.doc_id == good.good_id, "left").select(F.col("good_id").isNotNull().alias("good"), "text")
    rows = marked.mapInArrow(_count, "side int, bucket int, n long").groupBy("side", "bucket").agg(F.sum("n").alias("n")).toArrow()
    table = np.zeros((2, BUCKETS))
    table[rows.column("side").to_numpy(), rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    if not table[1].any():
        table[1] = table[0]
    table = (table + 1) / (table + 1).sum(axis=1, keepdims=True)
    shared = spark.sparkContext.broadcast(np.log(table[1]) - np.log(table[0]))
    told = slim.mapInArrow(_weigh(shared), "doc_id long, log_ratio double, n_grams long")
    even = (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "doc_id"), 11) + F.lit(0.5)) / F.lit(2.0**53)
    told = session.settle(told.withColumn("key", F.col("log_ratio") / temperature - F.log(-F.log(even))))
    cut = _greatest(told, share)
    return told.withColumn("kept", F.coalesce(F.col("key") >= cut, F.lit(False)))


def _greatest(told: DataFrame, share: float) -> float:
    """The k-th greatest key, found by counting between ever closer cut points."""
    n = told.where("key is not null").count()
    k = int(share * n + 0.5)
    if not k:
        return float("inf")
    low, high = told.agg(F.min("key"), F.max("key")).first()
    while low < high:
        step = F.least(F.lit(1023), F.floor((F.col("key") - low) / F.lit(float((high - low) / 1024))).cast("int"))
        counts = {r.s: (r.n, r.a, r.b) for r in told.where(F.col("key").between(float(low), float(high))).groupBy(step.alias("s")).agg(F.count("*").alias("n"), F.min("key").alias("a"), F.max("key").alias("b")).collect()}
        above = told.where(F.col("key") > float(high)).count()
        for s in sorted(counts, reverse=True):
            if above + counts[s][0] >= k:
                if (low, high) == counts[s][1:]:
                    return low
                low, high = counts[s][1:]
                break
            above += counts[s][0]
    return low


def op4_importance_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document of `documents`, by the good documents of `labels`."""
    session.workers_find_package(spark)
    return select(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/labels.parquet"))
