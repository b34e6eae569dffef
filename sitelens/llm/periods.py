"""Periodic runs of words: Lyndon words by a stack from right to left under both orders, extended by rolling-hash LCE.

A run is a longest stretch of words whose smallest period q it holds at least `repeats` times. By the runs theorem, each full
Lyndon rotation of a run's root is the longest Lyndon word that starts there, under the order in which the word that ends
the run is less than the one a period before. So the longest Lyndon word at every place is found from right to left, under the
order of words' hashes and under its reverse: it ends at the next smaller suffix, and suffixes are compared by the length of
their common extension (LCE), which is found word by word for the first few words and then by doubling and binary search over
rolling hashes modulo two primes. Where three roots of one length stand in a row the stretch is extended both ways by LCE.
A run is then compared word by word: the words a period apart, as bytes. Should a hash have called different words equal, the
text is done again with the words themselves numbered. No suffix array is built; time is a text's words times the logarithm of
its longest repeats.

Words are runs of characters other than blank and U+0009 to U+000D; case counts. A word that stands in a run after the run's
first q words repeats what was said: the collapsed text has the other words, joined by one space.

Cases: a null or blank text has no words, no runs and an empty collapsed text. Rows stay as they are, nulls and repeats included;
an empty table gives no rows. A text of any length is searched whole, and memory follows the longest one. Columns other than
doc_id and text are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm import session, text

#: Words compared one by one before rolling hashes are.
NEAR = 8
_PRIMES = ((1 << 31) - 1, (1 << 31) - 19)
_BASES = (1103515245, 1664525)
RUNS = "array<struct<start:long,length:long,period:long>>"


class Extension:
    """How far two places of a sequence agree, to the right and to the left."""

    def __init__(self, letters: list[int]):
        self.letters, self.n, self.sums = letters, len(letters), None

    def _prepare(self) -> None:
        """Sums of letter * base**place, modulo each prime, and the powers."""
        own = np.array(self.letters, np.int64).view(np.uint64)
        self.sums, self.powers = [], []
        for prime, base in zip(_PRIMES, _BASES):
            p = np.uint64(prime)
            powers = np.ones(self.n + 1, np.uint64)
            done = 1
            while done <= self.n:
                more = min(done, self.n + 1 - done)
                powers[done : done + more] = powers[:more] * np.uint64(pow(base, done, prime)) % p
                done += more
            sums = np.zeros(self.n + 1, np.uint64)
            np.cumsum(own % p * powers[:-1] % p, out=sums[1:])  # of less than 2**31 each: no overflow
            self.sums.append(sums.tolist())
            self.powers.append(powers.tolist())

    def _same(self, i: int, j: int, size: int) -> bool:
        """Whether the hashes of size letters from i and from j > i agree."""
        for sums, powers, prime in zip(self.sums, self.powers, _PRIMES):
            if ((sums[i + size] - sums[i]) * powers[j - i] - sums[j + size] + sums[j]) % prime:
                return False
        return True

    def _far(self, most: int, same) -> int:
        """The greatest size up to most that is the same, NEAR being so: by doubling, then by halves."""
        if self.sums is None:
            self._prepare()
        low, high = NEAR, 2 * NEAR
        while high <= most and same(high):
            low, high = high, 2 * high
        high = min(high, most + 1)
        while high - low > 1:
            middle = (low + high) // 2
            if same(middle):
                low = middle
            else:
                high = middle
        return low

    def right(self, i: int, j: int) -> int:
        """Letters from i on that equal those from j > i on."""
        w, most = self.letters, self.n - j
        for k in range(min(NEAR, most)):
            if w[i + k] != w[j + k]:
                return k
        return most if most <= NEAR else self._far(most, lambda size: self._same(i, j, size))

    def left(self, i: int, j: int) -> int:
        """Letters before i that equal those before j > i."""
        w = self.letters
        for k in range(min(NEAR, i)):
            if w[i - 1 - k] != w[j - 1 - k]:
                return k
        return i if i <= NEAR else self._far(i, lambda size: self._same(i - size, j - size, size))


def next_smaller(letters: list[int], sign: int, extension: Extension) -> np.ndarray:
    """Where the longest Lyndon word from each place ends: its next smaller suffix; sign -1 turns the order round. An end is less than any letter."""
    n = len(letters)
    w = letters if sign > 0 else [-x for x in letters]
    ends = [n] * n
    known: dict[int, tuple[int, int]] = {}  # by distance, the last place compared and how far it agreed
    for i in range(n - 2, -1, -1):
        own, j = w[i], i + 1
        while j < n:
            other = w[j]
            if own == other:
                place, k = known.get(j - i, (0, 0))
                k = k + 1 if place == i + 1 else extension.right(i, j)
                known[j - i] = i, k
                if j + k >= n or w[i + k] > w[j + k]:
                    break
            elif own > other:
                break
            j = ends[j]
        ends[i] = j
    return np.array(ends, np.int64)


def runs(letters: list[int], repeats: int = 4, least: int = 6) -> list[tuple[int, int, int]]:
    """(start, period, length) of all runs that hold their smallest period `repeats` (4 or more) times and have `least` letters, in order."""
    if repeats < 4:
        raise ValueError("repeats: 4 or more, or three roots in a row are not certain")
    n, found = len(letters), set()
    if n < max(repeats, least):
        return []
    extension, own = Extension(letters), np.array(letters, np.int64)
    for sign in (1, -1):
        at = np.arange(n)
        size = next_smaller(letters, sign, extension) - at
        at = at[at + 2 * size < n]
        q = size[at]
        alike = (size[at + q] == q) & (size[at + 2 * q] == q) & (own[at + q] == own[at]) & (own[at + 2 * q] == own[at])
        ends: dict[int, int] = {}
        for i in at[alike].tolist():
            q = int(size[i])
            if i + q < ends.get(q, 0):  # both are in the stretch that was looked at
                continue
            start = i - extension.left(i, i + q)
            ends[q] = i + q + extension.right(i, i + q)
            if ends[q] - start >= max(least, repeats * q):
                found.add((start, q, ends[q] - start))
    return sorted(found)


def _verified(letters: np.ndarray, flat: np.ndarray, first: np.ndarray, last: np.ndarray, repeats: int, least: int) -> list[tuple[int, int, int]]:
    """The runs of a text by the hashes of its words, compared as bytes; first and last are the words' places in flat."""
    same = lambda r: flat[first[r[0]] : last[r[0] + r[2] - r[1] - 1]].tobytes() == flat[first[r[0] + r[1]] : last[r[0] + r[2] - 1]].tobytes()
    found = runs(letters.view(np.int64).tolist(), repeats, least)
    if all(map(same, found)):
        return found
    known: dict[bytes, int] = {}
    named = [known.setdefault(flat[i:j].tobytes(), len(known)) for i, j in zip(first.tolist(), last.tolist())]
    return [r for r in runs(named, repeats, least) if same(r)]


def _search(repeats: int, least: int):
    def run(batches):
        for batch in batches:
            for at, to, data, offs in text.pieces(batch.column(1)):
                n = to - at
                hashes, rows, starts, ends = text.words(data, offs, lower=text.AS_IS)
                flat, first, last = text.joined(data, starts, ends)
                bounds = np.searchsorted(rows, np.arange(n + 1)).tolist()
                every, sizes, drop = [], np.zeros(n + 1, np.int64), np.zeros(len(rows) + 1, np.int64)
                for k in range(n):
                    i, j = bounds[k], bounds[k + 1]
                    found = _verified(hashes[i:j], flat, first[i:j], last[i:j], repeats, least)
                    for start, q, length in found:
                        drop[i + start + q] += 1
                        drop[i + start + length] -= 1
                    sizes[k + 1] = len(found)
                    every += found
                keep = np.cumsum(drop[:-1]) == 0
                told = np.array(every, np.int64).reshape(-1, 3)
                spans = pa.StructArray.from_arrays([pa.array(told[:, c]) for c in (0, 2, 1)], ["start", "length", "period"])
                runs_of = pa.ListArray.from_arrays(pa.array(np.cumsum(sizes).astype(np.int32)), spans)
                rest = text.rejoined(data, starts[keep], ends[keep], rows[keep], n)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(np.diff(bounds).astype(np.int64)), runs_of, rest], ["doc_id", "n_words", "runs", "collapsed"])

    return run


def periodic_runs(docs: DataFrame, repeats: int = 4, least: int = 6) -> DataFrame:
    """doc_id, n_words, runs (start, length, period; by start, then period) and the collapsed text of every row (doc_id, text)."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    return slim.mapInArrow(_search(repeats, least), f"doc_id long, n_words long, runs {RUNS}, collapsed string")


def echoed(docs: DataFrame) -> DataFrame:
    """doc_id and text, where the words of one text in ten, by crc32 h of the id as text, repeat from some word on.

    With n words and g = floor(h / 10), each word i from a = g % n on becomes word a + (i - a) % p of the text, p = 1 + floor((n - a) / (3 + g % 8)).
    Texts of null ids stay.
    """
    h = F.crc32(F.col("doc_id").cast("string").cast("binary"))
    chosen = docs.select("doc_id", "text", F.floor(h / 10).alias("_g"), F.when(h % 10 == 0, F.regexp_extract_all("text", F.lit(r"[^\x20\x09-\x0D]+"), F.lit(0))).alias("_w"))
    counted = chosen.withColumn("_n", F.size("_w")).withColumn("_a", F.when(F.col("_n") > 0, (F.col("_g") % F.col("_n")).cast("int")))
    rest = F.col("_n") - F.col("_a")
    counted = counted.withColumn("_p", (F.floor(rest / (F.lit(3) + F.col("_g") % 8)) + 1).cast("int"))
    again = F.flatten(F.array_repeat(F.slice("_w", F.col("_a") + 1, F.col("_p")), F.floor(rest / F.col("_p")).cast("int") + 1))
    told = F.array_join(F.concat(F.slice("_w", F.lit(1), F.col("_a")), F.slice(again, F.lit(1), rest)), " ")
    return counted.select("doc_id", F.when(F.col("_n") > 0, told).otherwise(F.col("text")).alias("text"))


def _stronger(l: Column, r: Column) -> Column:
    """Orders runs by exact length / period falling, then start and period rising."""
    a, b = l["length"] * r["period"], r["length"] * l["period"]
    less = (a > b) | ((a == b) & ((l["start"] < r["start"]) | ((l["start"] == r["start"]) & (l["period"] < r["period"]))))
    return F.when(less, -1).when((l["start"] == r["start"]) & (l["period"] == r["period"]), 0).otherwise(1)


def op11_periodic_runs(spark, sf_dir: str) -> DataFrame:
    """Every document of `documents`, one in ten made to repeat: its runs, the strongest one, and digests of the runs and of the collapsed text."""
    session.workers_find_package(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet").select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found = periodic_runs(echoed(docs))
    top = F.try_element_at(F.array_sort("runs", _stronger), F.lit(1))
    line = lambda r: F.concat(r["start"].cast("string"), F.lit(","), r["length"].cast("string"), F.lit(","), r["period"].cast("string"), F.lit("\n"))
    told = F.sha2(F.array_join(F.transform("runs", line), ""), 256)
    found = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), top.alias("top"), told.alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return found.select("doc_id", "n_runs", "top.start", "top.length", "top.period", F.floor(F.col("top.length") * 1000 / F.col("top.period")).cast("long").alias("exponent_milli"), "runs_sha256", "collapsed_sha256")
