"""Importance resampling toward a target distribution: two Arrow passes over hashed word runs, and the greatest perturbed weights.

Texts are lower-cased (A-Z); words are runs of digits, a to z and characters outside ASCII. Features are all runs of 1 to
`width` consecutive words, joined by one space, repeats counted; a feature's bucket is the crc32 of its UTF-8 bytes modulo
`buckets`. The first pass counts: each partition of a table gives one vector of np.bincount, and treeReduce adds the vectors,
so the driver gets a few of them whatever the number of partitions. A bucket's gain is floor(1000 ln(q / p)) of its
add-one-smoothed shares in the target (q) and in the documents (p). The second pass looks the broadcast gains up and sums them
by document, as weights of np.bincount. A document's score is its weight plus Gumbel noise from a seeded hash of its id; of
the documents with `least` words or more, `percent` in a hundred are drawn, the greatest scores first: a sample without
replacement in proportion to the weights. Ranks come from ranges of the score, so no task sees all documents.

Cases: a null or empty text, or one without words, has weight 0 and is never drawn where least > 0. Ties go to the smaller
doc_id, null ids before all; null ids draw the noise of the empty id. Repeated rows stay and have ranks of their own. A table
without rows gives none; an empty target makes every gain the same function of the bucket's count in the documents. A text
of any length is counted whole, and memory follows the longest one. Columns other than doc_id and text are not looked at.
"""

from __future__ import annotations

import math
import zlib

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import session, text
from sitelens.operators.storage import numbered

BUCKETS = 10_000
SEED = 2024
#: Features of more bytes have their crc32 taken one by one.
LONG = 64


def _steps() -> np.ndarray:
    """What crc32 (reflected, 0xEDB88320) does to each byte."""
    c = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        c = np.where(c & 1, (c >> 1) ^ np.uint32(0xEDB88320), c >> 1).astype(np.uint32)
    return c


_STEPS = _steps()


def crc32(data: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """The crc32 of each span of bytes, all spans a byte further at a time."""
    out = np.full(len(starts), 0xFFFFFFFF, np.uint32)
    sizes = ends - starts
    at = np.flatnonzero((sizes > 0) & (sizes <= LONG))
    k = 0
    while len(at):
        own = out[at]
        out[at] = _STEPS[(own ^ data[starts[at] + k]) & 255] ^ (own >> np.uint32(8))
        k += 1
        at = at[sizes[at] > k]
    out ^= np.uint32(0xFFFFFFFF)
    for i in np.flatnonzero(sizes > LONG).tolist():
        out[i] = zlib.crc32(data[starts[i] : ends[i]].tobytes())
    return out


def features(data: np.ndarray, offs: np.ndarray, width: int, buckets: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every run of 1 to width words, and the number of words of each row."""
    _, rows, starts, ends = text.words(data, offs, text.PLAIN)
    flat, first, last = text.joined(text._LOWER[data], starts, ends)
    found, owners = [], []
    for k in range(width):
        n = max(0, len(rows) - k)
        same = rows[k:] == rows[:n]
        found.append(crc32(flat, first[:n][same], last[k:][same]) % np.uint32(buckets))
        owners.append(rows[:n][same])
    return np.concatenate(found).astype(np.int64), np.concatenate(owners), np.bincount(rows, minlength=len(offs) - 1)


def _count(width: int, buckets: int):
    def run(batches):
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, _, data, offs in text.pieces(batch.column(0)):
                total += np.bincount(features(data, offs, width, buckets)[0], minlength=buckets)
        yield pa.RecordBatch.from_arrays([pa.array([total.tobytes()], pa.binary())], ["counts"])

    return run


def counts(texts: DataFrame, width: int = 1, buckets: int = BUCKETS) -> np.ndarray:
    """How often each bucket occurs in all texts (the only column)."""
    vectors = texts.mapInArrow(_count(width, buckets), "counts binary").rdd.map(lambda r: np.frombuffer(r[0], np.int64))
    none = texts.sparkSession.sparkContext.parallelize([np.zeros(buckets, np.int64)], 1)
    return vectors.union(none).treeReduce(np.add, 2 if vectors.getNumPartitions() < 10_000 else 3)


def gains(target: np.ndarray, raw: np.ndarray) -> np.ndarray:
    """By bucket, 1000 times the log ratio of smoothed shares, rounded down."""
    n, t, s = len(raw), float(target.sum()), float(raw.sum())
    return np.array([math.floor(1000 * math.log((a + 1.0) * (s + n) / ((b + 1.0) * (t + n)))) for a, b in zip(target.tolist(), raw.tolist())], np.float64)


def _weigh(width: int, buckets: int, shared: Broadcast):
    def run(batches):
        for batch in batches:
            for at, to, data, offs in text.pieces(batch.column(1)):
                found, rows, words = features(data, offs, width, buckets)
                weight = np.bincount(rows, weights=shared.value[found], minlength=to - at)
                every = np.bincount(rows, minlength=to - at)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), *[pa.array(x.astype(np.int64)) for x in (words, every, weight)]], ["doc_id", "n_words", "n_features", "weight"])

    return run


def resample(docs: DataFrame, target: DataFrame, width: int = 1, buckets: int = BUCKETS, percent: int = 10, least: int = 20, seed: int = SEED) -> DataFrame:
    """doc_id, n_words, n_features, weight, score and rank (from 1; null where not drawn) of every document, by the texts of target."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    gain = gains(counts(target.select(F.col("text").cast("string")), width, buckets), counts(slim.select("text"), width, buckets))
    told = slim.mapInArrow(_weigh(width, buckets, spark.sparkContext.broadcast(gain)), "doc_id long, n_words long, n_features long, weight long")
    noise = (F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), 256), 1, 8), 16, 10).cast("double") + F.lit(0.5)) / F.lit(4294967296.0)
    told = session.settle(told.withColumn("score", F.col("weight") + F.floor(F.lit(-1000.0) * F.log(-F.log(noise)))))
    may = F.col("n_words") >= least
    ranked = numbered(told.where(may).withColumn("_down", -F.col("score")), ["_down", "doc_id", "weight", "n_features"], "_place")
    drawn = told.where(may).count() * percent // 100
    rank = F.when(F.col("_place") < drawn, F.col("_place") + 1)
    out = [F.col(c) for c in told.columns]
    return ranked.select(*out, rank.alias("rank")).unionAll(told.where(~may).select(*out, F.lit(None).cast("long").alias("rank")))


def op13_target_resampling(spark, sf_dir: str) -> DataFrame:
    """Every document of `documents`, drawn toward the texts of `benchmark`."""
    session.workers_find_package(spark)
    found = resample(spark.read.parquet(f"{sf_dir}/documents.parquet"), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.select("doc_id", "n_features", "weight", "score", "rank")
