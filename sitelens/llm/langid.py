"""Language identification: multinomial naive Bayes over hashed character n-grams.

Letters are lower-cased and every run of other characters becomes one boundary; n-grams of one to three
code points, the boundary included, are hashed to 2**15 buckets. Training counts (language, bucket) on the
executors, so what reaches the driver is bounded by languages x buckets, whatever the corpus. The matrix of
smoothed log-probabilities is broadcast; texts are scored in batches, each as sparse bucket counts.

Cases: a null text, or one without letters, gets `und` and score 0. Without any training row, all texts do.
Ties go to the language first in alphabetical order. Null languages are not learned from. Rows keep their
id, nulls and repeats included; other columns are not looked at, but `predict` puts its own lang_pred and score in the place of
columns of these names. A text of any length is scored whole, and memory follows the longest one. An empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import session, text

BUCKETS = 1 << 15
#: Characters whose n-grams are in memory at once, if no single text has more.
CHUNK = 1 << 18
_LETTER: list[np.ndarray] = []


def _letters() -> np.ndarray:
    """For each code point: its lower case if that is a letter, else 0."""
    if not _LETTER:
        table = np.zeros(0x110000, np.uint32)
        for c in range(0x110000):
            s = chr(c)
            if s.isalpha():
                low = s.lower()
                table[c] = ord(low) if len(low) == 1 else c
        _LETTER.append(table)
    return _LETTER[0]


def grams(texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket and row of every n-gram of the texts, and how many letters each row has."""
    n = len(texts)
    lengths = np.fromiter(map(len, texts), np.int64, n)
    code = np.frombuffer("".join(texts).encode("utf-32-le"), np.uint32)
    rows = np.repeat(np.arange(n), lengths)
    low = _letters()[code]
    count = np.bincount(rows[low > 0], minlength=n)
    size = len(low)
    stay = np.ones(size, bool)
    stay[1:] = (low[1:] > 0) | (low[:-1] > 0) | (rows[1:] != rows[:-1])
    low, rows = low[stay], rows[stay]
    buckets, owners = [], []
    for width in (1, 2, 3):
        m = len(low) - width + 1
        if m <= 0:
            break
        h = np.full(m, width, np.uint32) * np.uint32(0x9E3779B1)
        for k in range(width):
            h = (h ^ low[k : k + m]) * np.uint32(0x85EBCA6B)
            h ^= h >> np.uint32(15)
        good = rows[:m] == rows[width - 1 :]
        good &= (low[:m] > 0) | (low[width - 1 :] > 0)
        buckets.append((h[good] * np.uint32(0xC2B2AE35)) >> np.uint32(17))
        owners.append(rows[:m][good])
    if not buckets:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), count
    return np.concatenate(buckets).astype(np.int64), np.concatenate(owners), count


def _slices(batch: pa.RecordBatch, column: int):
    for at, to, _, _ in text.pieces(batch.column(column), CHUNK):
        yield at, to, [x or "" for x in batch.column(column).slice(at, to - at).to_pylist()]


def _count(batches):
    totals: dict[str, np.ndarray] = {}
    for batch in batches:
        for at, to, texts in _slices(batch, 1):
            langs = batch.column(0).slice(at, to - at).to_pylist()
            buckets, owners, _ = grams(texts)
            for lang in set(langs):
                own = np.array([x == lang for x in langs])
                totals.setdefault(lang, np.zeros(BUCKETS, np.int64))
                totals[lang] += np.bincount(buckets[own[owners]], minlength=BUCKETS)
    for lang, total in totals.items():
        at = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int64()), pa.array(total[at], pa.int64())], ["lang", "bucket", "n"])


def train(labelled: DataFrame, smoothing: float = 0.5) -> tuple[list[str], np.ndarray]:
    """Languages and their log-probabilities, (languages, buckets), from all rows (lang, text)."""
    counted = labelled.where("lang is not null").select("lang", "text").mapInArrow(_count, "lang string, bucket long, n long")
    rows = counted.groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toArrow()
    langs = sorted(set(rows.column("lang").to_pylist()))
    table = np.zeros((len(langs), BUCKETS))
    if langs:
        place = {x: k for k, x in enumerate(langs)}
        table[[place[x] for x in rows.column("lang").to_pylist()], rows.column("bucket").to_numpy()] = rows.column("n").to_numpy()
    table += smoothing
    return langs, np.log(table / table.sum(axis=1, keepdims=True)) if langs else table


def predict(docs: DataFrame, model: tuple[list[str], np.ndarray], text_col: str = "text") -> DataFrame:
    """Adds lang_pred and score: the likeliest language, all equally likely before, and its probability."""
    langs, table = model
    shared = docs.sparkSession.sparkContext.broadcast(np.ascontiguousarray(table.astype(np.float32)))

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        by_lang = shared.value
        for batch in batches:
            parts = []
            texts = [x or "" for x in batch]
            at = 0
            while at < len(texts):
                to, size = at, 0
                while to < len(texts) and (to == at or size + len(texts[to]) <= CHUNK):
                    size += len(texts[to])
                    to += 1
                n = to - at
                buckets, owners, letters = grams(texts[at:to])
                total = np.zeros((n, max(1, len(langs))))
                for k in range(len(langs)):
                    total[:, k] = np.bincount(owners, weights=by_lang[k][buckets], minlength=n)
                best, known = total.argmax(axis=1), (letters > 0) & (len(langs) > 0)
                odds = np.exp(total - total.max(axis=1, keepdims=True)).sum(axis=1)
                names = [langs[b] if ok else "und" for b, ok in zip(best.tolist(), known.tolist())]
                parts.append(pd.DataFrame({"lang_pred": names, "score": np.where(known, 1 / odds, 0.0)}))
                at = to
            yield pd.concat(parts, ignore_index=True) if parts else pd.DataFrame({"lang_pred": pd.Series(dtype=str), "score": pd.Series(dtype=float)})

    found = F.pandas_udf(run, "lang_pred string, score double")(F.col(text_col).cast("string"))
    kept = [c for c in docs.columns if c not in ("lang_pred", "score", "_found")]
    return docs.select(*kept, found.alias("_found")).select(*kept, "_found.lang_pred", "_found.score")


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 1 modulo 3; null ids train."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 3 == 1, F.lit(False))


def identify(docs: DataFrame) -> DataFrame:
    """Learns from the rows that are not held out and predicts all: doc_id, held_out, lang_pred, score."""
    model = train(docs.where(~held_out()).select("lang", "text"))
    return predict(docs.select("doc_id", "text"), model).select("doc_id", held_out().alias("held_out"), "lang_pred", "score")


def op6_language_id(spark, sf_dir: str) -> DataFrame:
    """Every document of `documents`."""
    session.workers_find_package(spark)
    return identify(spark.read.parquet(f"{sf_dir}/documents.parquet"))
