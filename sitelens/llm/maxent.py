"""LM scoring by a hashed maximum-entropy model with a class-factored softmax.

A token is a word or a text's end. The HEAD most frequent tokens are grouped by frequency into classes of
SIDE tokens; all others fall into TAIL classes by a hash of their last two bytes, lower-cased. A token's probability is that of its
class given the context, a softmax over hashed features, times that of the token in its class: a second softmax
for head classes; in tail ones a softmax for each digit (base SIDE) of the token's hash, given the digits before it, down to a
leaf, and (count + 1) / (tokens + types + 1) of the leaf, whose last unit is for unseen words. Digits grow in number with the counted
vocabulary, so that a leaf has LEAF words on average, up to LEAVES leaves.
Features are the previous token and the one before it (a skip), each by its own hash, so every word is a context, and both
together, each a head token or else its tail class (pairs by their own hashes predict held-out texts worse, as most are met once). Digits
look at the previous token alone. Weight tables have BUCKETS and INNER rows, fewer for few training tokens and more for many: a row for every
SPAN tokens, up to GROWN times as many, which is what an executor's memory holds; features that meet in a row share it.

Counts cover all training tokens. The gradient updates go over all training tokens too: in each round every task
starts from the broadcast weights, takes AdaGrad steps over its mini-batches of the round's share of documents, and
returns its changes; each weight row moves by the mean of its changes, weighted by how often tasks met it.
Scoring works on sparse numpy batches. Counts of words that are more than one in 2**21 training tokens are broadcast,
at most 2**21 of them; the counts of all others are joined.

Cases: a null text counts as empty, and has its end as only token. Repeated and null ids are rows like others; a
null id is a training row. Without training rows base is 0 for all. An empty table gives no rows. Other columns are not looked at.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from sitelens.llm import session, text

HEAD, SIDE, TAIL = 128, 16, 24
CLASSES = HEAD // SIDE + TAIL
BUCKETS, INNER = 1 << 17, 1 << 18
#: Training tokens for a row of the first table where it grows, and how many times as many rows as above both have at most.
SPAN, GROWN = 1 << 8, 2
HEAVY = 1 << 21
#: Words a leaf of the tail has on average, and the most leaves.
LEAF, LEAVES = 16, 1 << 21
#: Partitions that one learning task takes, if there are enough for all cores.
JOINED = 8
RATES = (0.2, 0.1, 0.05)
BATCH = 8192
#: Rows of weights that a batch meets up to so many times have their errors added one by one.
FEW = 3
FLUSH = 1 << 20
#: Sums of weights and biases up to which exp() needs no shift by a row's greatest.
REACH = 80.0
END = np.uint64(0x1234567890ABCDEF)
_BITS = SIDE.bit_length() - 1
_OUTER_PARTS, _INNER_PARTS = 16, 16


def tokens(data: np.ndarray, offs: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Hash, row and tail class of every token; each row ends in END."""
    hashes, rows, starts, ends = text.words(data, offs)
    n, docs = len(hashes), len(offs) - 1
    low = text._LOWER[data].astype(np.uint64)  # as the hash has them, so all spellings of a token are in one class
    last = low[ends - 1] * np.uint64(256) + np.where(ends - starts > 1, low[np.maximum(ends - 2, 0)], np.uint64(0)) if n else np.zeros(0, np.uint64)
    tail = (text.mix(last + np.uint64(7)) % np.uint64(TAIL)).astype(np.int64)
    count = np.bincount(rows, minlength=docs)
    at = np.cumsum(count + 1) - 1
    keep = np.ones(n + docs, bool)
    keep[at] = False
    out = np.full(n + docs, END, np.uint64)
    out[keep] = hashes
    tails = np.zeros(n + docs, np.int64)
    tails[keep] = tail
    return out, np.repeat(np.arange(docs), count + 1), tails


def grouped(h: np.ndarray, k: np.ndarray, c: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Each hash once, in order, with its tail class, which any of its tokens tells, and the sum of c or how often it occurs."""
    order = np.argsort(h)
    own = h[order]
    first = np.flatnonzero(np.concatenate((np.ones(min(1, len(own)), bool), own[1:] != own[:-1])))
    total = np.diff(first, append=len(own)) if c is None else np.add.reduceat(c[order], first) if len(first) else c
    return own[first], k[order[first]], total.astype(np.int64)


def _count(batches):
    held: list[tuple[np.ndarray, np.ndarray, np.ndarray]] = []

    def merged():
        h, k, c = (np.concatenate(x) for x in zip(*held))
        return grouped(h, k, c)

    def rows(x):
        return pa.RecordBatch.from_arrays([pa.array(x[0].view(np.int64)), pa.array(x[1].astype(np.int32)), pa.array(x[2])], ["h", "tail", "c"])

    size = 0
    for batch in batches:
        for _, _, data, offs in text.pieces(batch.column(0), text.CACHED):
            h, _, k = tokens(data, offs)
            held.append(grouped(h, k))
            size += len(held[-1][0])
            if size > FLUSH:
                held = [merged()]
                size = len(held[0][0])
                if size > FLUSH // 2:
                    yield rows(held[0])
                    held, size = [], 0
    if held:
        yield rows(merged())


def leaf(h, tail, depth: int):
    """The leaf of each tail token: its class and the first digits of its hash; of numpy arrays or Spark columns."""
    out = tail
    for k in range(depth):
        digit = F.shiftrightunsigned(h, _BITS * k).bitwiseAND(F.lit(SIDE - 1)) if isinstance(h, Column) else ((h >> np.uint64(_BITS * k)) & np.uint64(SIDE - 1)).astype(np.int64)
        out = out * SIDE + digit
    return out


def sizes(total: int) -> tuple[int, int]:
    """Rows of the two weight tables for so many training tokens: powers of two that follow them."""
    rows = 1 << max(12, total.bit_length() - 2)
    times = min(GROWN, max(1, (1 << total.bit_length()) // SPAN // BUCKETS))
    return min(BUCKETS * times, rows), min(INNER * times, 2 * rows)


def _level(bias: np.ndarray) -> np.ndarray:
    """Logarithms whose greatest is 0 in each row: a softmax does not change."""
    return (bias - bias.max(axis=-1, keepdims=True)).astype(np.float32)


class Model:
    """Head tokens, leaf totals and weights; what a task needs to learn or score.

    tail_tokens and tail_types are by leaf, TAIL * SIDE ** depth of them.
    """

    def __init__(self, head: np.ndarray, head_counts: np.ndarray, tail_tokens: np.ndarray, tail_types: np.ndarray, buckets: int = BUCKETS, inner: int = INNER):
        order = np.argsort(head)
        self.head, self.order = head[order], order
        counts = np.zeros(HEAD)
        counts[: len(head)] = head_counts
        own = counts.reshape(-1, SIDE)
        self.bias = _level(np.log(np.concatenate((own.sum(axis=1), tail_tokens.reshape(TAIL, -1).sum(axis=1))) + 1))
        self.depth, levels = 0, [own]
        while TAIL * SIDE**self.depth < len(tail_tokens):
            levels.append(tail_tokens.reshape(TAIL * SIDE**self.depth, SIDE, -1).sum(axis=2))
            self.depth += 1
        self.inner_bias = _level(np.log(np.concatenate(levels) + 1))
        self.tail_log = np.log10(tail_tokens + tail_types + 1)
        self.outer = np.zeros((buckets, CLASSES), np.float32)
        self.inner = np.zeros((inner, SIDE), np.float32)

    def place(self, h: np.ndarray) -> np.ndarray:
        """The number of each head token, -1 for others."""
        at = np.searchsorted(self.head, h)
        at[at == len(self.head)] = 0
        return np.where(self.head[at] == h, self.order[at], -1)

    def features(self, h: np.ndarray, rows: np.ndarray, tail: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Hashed features (tokens x 3), class, and number in the class (-1 in tail classes)."""
        place = self.place(h)
        ident = np.where(place >= 0, place, HEAD + tail).astype(np.uint64) + np.uint64(1)
        back = np.zeros((4, len(h)), np.uint64)
        for k in (1, 2):
            same = rows[k:] == rows[:-k]
            back[k - 1, k:][same] = h[:-k][same]
            back[k + 1, k:][same] = ident[:-k][same]
        one, two, near, far = back
        keys = np.stack((one, text.mix(two + np.uint64(1)), near * np.uint64(1000) + far + np.uint64(1_000_000)), axis=1)
        kind = np.where(place >= 0, place // SIDE, HEAD // SIDE + tail)
        return text.mix(keys), kind, np.where(place >= 0, place % SIDE, -1)

    def leaf(self, h: np.ndarray, tail: np.ndarray) -> np.ndarray:
        """The leaf of each tail token: its class and the digits of its hash."""
        return leaf(h, tail, self.depth)

    def choices(self, f: np.ndarray, kind: np.ndarray, side: np.ndarray, h: np.ndarray | None):
        """The choices that lead from a class to a token, or to its leaf: features that count, place of the token, node (a row of the inner bias), and what is chosen."""
        at = np.flatnonzero(side >= 0)
        yield f[at], at, kind[at], side[at]
        if h is None:
            return
        rest = np.flatnonzero(side < 0)
        node, first = kind[rest] - HEAD // SIDE, HEAD // SIDE
        for k in range(self.depth):
            digit = ((h[rest] >> np.uint64(_BITS * k)) & np.uint64(SIDE - 1)).astype(np.int64)
            yield f[rest, :1], rest, first + node, digit
            first, node = first + TAIL * SIDE**k, node * SIDE + digit

    @staticmethod
    def _soft(x: np.ndarray) -> np.ndarray:
        if x.max(initial=0) > REACH or x.min(initial=0) < -REACH:  # else exp() can neither overflow nor leave a row without a sum
            x -= x.max(axis=1, keepdims=True)
        np.exp(x, out=x)
        x /= (x @ np.ones(x.shape[1], x.dtype))[:, None]
        return x

    def outer_rows(self, f: np.ndarray) -> np.ndarray:
        return (f >> np.uint64(65 - len(self.outer).bit_length())).astype(np.int64)

    def inner_rows(self, f: np.ndarray, kind: np.ndarray) -> np.ndarray:
        return (text.mix(f + kind[:, None].astype(np.uint64)) >> np.uint64(65 - len(self.inner).bit_length())).astype(np.int64)

    def spread(self, table: np.ndarray, at: np.ndarray, bias: np.ndarray) -> np.ndarray:
        x = table.take(at[:, 0], axis=0)
        for k in range(1, at.shape[1]):
            x += table.take(at[:, k], axis=0)
        x += bias
        return self._soft(x)

    def log10(self, f: np.ndarray, kind: np.ndarray, side: np.ndarray, h: np.ndarray | None = None) -> np.ndarray:
        """log10 of each token's class, and token in a head class or, with tokens' hashes, leaf in a tail class, given its features."""
        out = np.empty(len(kind))
        for a in range(0, len(kind), BATCH):
            b = slice(a, a + BATCH)
            p = self.spread(self.outer, self.outer_rows(f[b]), self.bias)
            own = p[np.arange(len(p)), kind[b]].astype(float)
            for g, token, node, to in self.choices(f[b], kind[b], side[b], None if h is None else h[b]):
                q = self.spread(self.inner, self.inner_rows(g, node), self.inner_bias.take(node, axis=0))
                own[token] *= q[np.arange(len(q)), to]
            out[b] = np.log10(np.maximum(own, 1e-30))
        return out


class _Learner:
    """AdaGrad steps on a task's copy of one weight table."""

    def __init__(self, table: np.ndarray, rate: float):
        self.start, self.table, self.rate = table, table.copy(), rate
        self.power, self.met = np.zeros(len(table), np.float32), np.zeros(len(table), np.int32)

    def step(self, at: np.ndarray, error: np.ndarray) -> None:
        n, wide = at.shape
        flat = (at.T.ravel() if wide > 1 else at[:, 0]).astype(np.int32)
        order = np.argsort(flat)
        own = flat.take(order)
        if wide > 1:
            order = np.tile(np.arange(n, dtype=np.int32), wide).take(order)
        new = np.empty(len(own), bool)
        new[:1] = True
        np.not_equal(own[1:], own[:-1], out=new[1:])
        first = np.flatnonzero(new)
        rows, times = own.take(first), np.diff(first, append=len(own)).astype(np.int32)
        slope = error.take(order.take(first), axis=0)
        again, k = np.flatnonzero(times > 1), 1  # most rows are met once, and most others a few times
        while len(again) and k < FEW:
            slope[again] += error.take(order.take(first.take(again) + k), axis=0)
            k += 1
            again = again[times.take(again) > k]
        if len(again):
            left = times.take(again) - k
            ends = np.cumsum(left)
            places = np.arange(ends[-1]) + np.repeat(first.take(again) + k - ends + left, left)
            slope[again] += np.add.reduceat(error.take(order.take(places), axis=0), ends - left, axis=0)
        power = self.power.take(rows) + np.einsum("ij,ij->i", slope, slope) / slope.shape[1]
        self.power[rows] = power
        slope *= (self.rate / np.sqrt(power + 1e-6))[:, None]
        np.subtract(self.table.take(rows, axis=0), slope, out=slope)
        self.table[rows] = slope
        self.met[rows] += times

    def parts(self, name: int, n: int):
        for k, at in enumerate(np.array_split(np.arange(len(self.table)), n)):
            if self.met[at].any():
                yield name, k, self.met[at].astype(np.float32).tobytes(), (self.table[at] - self.start[at]).astype(np.float16).tobytes()


def _learn(shared, rate: float, salts: int):
    def run(batches):
        model = shared.value
        outer, inner = _Learner(model.outer, rate), _Learner(model.inner, rate)
        model.outer, model.inner = outer.table, inner.table
        for batch in batches:
            for _, _, data, offs in text.pieces(batch.column(0), text.CACHED):
                h, rows, tail = tokens(data, offs)
                f, kind, side = model.features(h, rows, tail)
                for a in range(0, len(kind), BATCH):
                    b = slice(a, a + BATCH)
                    at = model.outer_rows(f[b])
                    p = model.spread(model.outer, at, model.bias)
                    p[np.arange(len(p)), kind[b]] -= 1
                    outer.step(at, p)
                    for g, _, node, to in model.choices(f[b], kind[b], side[b], h[b]):
                        if len(node):
                            at = model.inner_rows(g, node)
                            p = model.spread(model.inner, at, model.inner_bias.take(node, axis=0))
                            p[np.arange(len(p)), to] -= 1
                            inner.step(at, p)
        model.outer, model.inner = outer.start, inner.start
        rows = [*outer.parts(0, _OUTER_PARTS), *inner.parts(1, _INNER_PARTS)]
        if rows:
            name, k, met, change = zip(*rows)
            salt = (TaskContext.get().partitionId() if TaskContext.get() else 0) % salts
            yield pa.RecordBatch.from_arrays([pa.array(name, pa.int32()), pa.array(k, pa.int32()), pa.array([salt] * len(rows), pa.int32()), pa.array(met, pa.binary()), pa.array(change, pa.binary())], ["name", "part", "salt", "met", "change"])

    return run


def _sum(table: pa.Table) -> pa.Table:
    """The mean of changes, by how often tasks met their rows."""
    met = change = 0
    for a, b in zip(table.column("met"), table.column("change")):
        own = np.frombuffer(a.as_buffer(), np.float32)
        met, change = met + own, change + np.frombuffer(b.as_buffer(), np.float16).reshape(len(own), -1) * own[:, None]
    change = (change / np.maximum(met, 1)[:, None]).astype(np.float16)
    return table.slice(0, 1).select(["name", "part", "salt"]).append_column("met", pa.array([met.tobytes()], pa.binary())).append_column("change", pa.array([change.tobytes()], pa.binary()))


def train(docs: DataFrame, counts: DataFrame) -> Model:
    """Learns from all texts; the driver gets the head, class totals, and a bounded sum of changes per round."""
    spark = docs.sparkSession
    top = counts.where(F.col("h") != int(END.view(np.int64))).orderBy(F.desc("c"), "h").limit(HEAD - 1).collect()
    end = counts.where(F.col("h") == int(END.view(np.int64))).agg(F.sum("c").alias("c")).first().c or 0
    ranked = sorted([(r.c, r.h) for r in top] + [(end, int(END.view(np.int64)))], key=lambda x: (-x[0], x[1]))
    head = np.array([h for _, h in ranked], np.int64)
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    depth = 0
    while TAIL * SIDE**depth * LEAF < types and TAIL * SIDE ** (depth + 1) <= LEAVES:
        depth += 1
    tail_tokens, tail_types = np.zeros(TAIL * SIDE**depth), np.zeros(TAIL * SIDE**depth)
    found = counts.where(~F.col("h").isin(head.tolist())).groupBy(leaf(F.col("h"), F.col("tail").cast("long"), depth).alias("leaf")).agg(F.sum("c").alias("c"), F.count("*").alias("v")).toArrow()
    at = found.column("leaf").to_numpy()
    tail_tokens[at], tail_types[at] = found.column("c").to_numpy(), found.column("v").to_numpy()
    model = Model(head.view(np.uint64), np.array([c for c, _ in ranked], float), tail_tokens, tail_types, *sizes(int(total)))
    del found, at, tail_tokens, tail_types
    tasks = max(spark.sparkContext.defaultParallelism, docs.rdd.getNumPartitions() // JOINED)
    salts = max(1, tasks // 32)
    schema = "name int, part int, salt int, met binary, change binary"
    for k, rate in enumerate(RATES):
        shared = spark.sparkContext.broadcast(model)
        own = docs.where(F.pmod(F.xxhash64("text"), F.lit(len(RATES))) == k).select("text").coalesce(tasks)
        sums = own.mapInArrow(_learn(shared, rate, salts), schema)
        for names in ([["name", "part", "salt"]] if salts > 1 else []) + [["name", "part"]]:
            sums = sums.groupBy(*names).applyInArrow(_sum, schema)
        for r in sums.select("name", "part", "change").collect():
            table, n = ((model.outer, _OUTER_PARTS), (model.inner, _INNER_PARTS))[r.name]
            at = np.array_split(np.arange(len(table)), n)[r.part]
            table[at] += np.frombuffer(r.change, np.float16).reshape(len(at), -1).astype(np.float32)
        shared.destroy()  # the driver keeps what is only unpersisted
        del own, sums
        session.release(spark)
    return model


def starts(keys: np.ndarray) -> tuple[np.ndarray, int]:
    """Where the keys, risen, that begin with each number of some leading bits start, and by how much a key is shifted for that number: about one key for each."""
    bits = max(1, len(keys).bit_length())
    shift = 64 - bits
    return np.concatenate(([0], np.cumsum(np.bincount((keys >> np.uint64(shift)).astype(np.int64), minlength=1 << bits)))).astype(np.int32), shift


def find(keys: np.ndarray, begin: np.ndarray, shift: int, h: np.ndarray) -> np.ndarray:
    """The place of each hash among the keys, -1 for none: keys with the same leading bits are tried in turn, which are few as hashes are even."""
    first = (h >> np.uint64(shift)).astype(np.int64)
    at, end = begin.take(first), begin.take(first + 1)
    out = np.full(len(h), -1, np.int64)
    left = np.flatnonzero(at < end)
    at = at.take(left)
    while len(left):
        met = keys.take(at) == h.take(left)
        out[left[met]] = at[met]
        stay = ~met & (at + 1 < end.take(left))
        left, at = left[stay], at[stay] + 1
    return out


def _score(shared):
    def run(batches):
        model, heavy, heavy_counts = shared.value
        logs = np.log10(heavy_counts + 1.0)
        begin, shift = starts(heavy)
        task, serial = (TaskContext.get().partitionId() if TaskContext.get() else 0) << 40, 0
        for batch in batches:
            for at, to, data, offs in text.pieces(batch.column(1), text.CACHED):
                n = to - at
                h, rows, tail = tokens(data, offs)
                f, kind, side = model.features(h, rows, tail)
                own = model.log10(f, kind, side, h)
                place = find(heavy, begin, shift, h)
                known = place >= 0
                count_log = np.zeros(len(h))
                count_log[known] = logs[place[known]]
                own += np.where(side >= 0, 0.0, count_log - model.tail_log[model.leaf(h, tail)])
                rare = ~known
                cuts = np.concatenate(([0], np.cumsum(np.bincount(rows[rare], minlength=n)))).astype(np.int32)
                sums = [np.bincount(rows, weights=x, minlength=n) for x in (count_log, own)]
                yield pa.RecordBatch.from_arrays(
                    [batch.column(0).slice(at, n), pa.array(np.arange(serial, serial + n) + task), pa.array(np.bincount(rows, minlength=n).astype(np.int64)), pa.array(np.bincount(rows[known], minlength=n).astype(np.int64)), pa.array(sums[0]), pa.array(sums[1]), pa.ListArray.from_arrays(pa.array(cuts), pa.array(h[rare].view(np.int64)))],
                    ["doc_id", "row", "n_tokens", "n_heavy", "base", "score", "rare"],
                )
                serial += n

    return run


def held_out(doc_id: str = "doc_id"):
    """Whether a document is kept from training: crc32 of its id as text leaves 2 modulo 7."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % 7 == 2, F.lit(False))


def score(docs: DataFrame) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score for every row."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    learned = slim.where(~held_out()).select("text")
    counts = session.settle(learned.mapInArrow(_count, "h long, tail int, c long").groupBy("h").agg(F.first("tail").alias("tail"), F.sum("c").alias("c")))
    total, types = counts.agg(F.coalesce(F.sum("c"), F.lit(0)), F.count("*")).first()
    model = train(learned, counts)
    often = counts.where(F.col("c") * HEAVY > total).select("h", "c")
    own = [int(x) for x in model.head.view(np.int64)]
    table = often.unionAll(counts.where(F.col("h").isin(own)).select("h", "c")).distinct().toArrow()
    h, c = table.column("h").to_numpy().view(np.uint64), table.column("c").to_numpy()
    order = np.argsort(h)
    shared = spark.sparkContext.broadcast((model, h[order], c[order]))
    schema = "doc_id long, row long, n_tokens long, n_heavy long, base double, score double, rare array<long>"
    told = session.settle(slim.mapInArrow(_score(shared), schema))
    rare = told.select("row", F.explode("rare").alias("h"))
    met = rare.join(counts.select("h", F.log10(F.col("c") + F.lit(1.0)).alias("own")), "h").groupBy("row").agg(F.sum("own").alias("own"), F.count("*").alias("n"))
    out = told.drop("rare").join(met, "row", "left")
    more, known = F.coalesce("own", F.lit(0.0)), F.coalesce("n", F.lit(0))
    unit = float(np.log10(total + types + 1))
    return out.select("doc_id", held_out().alias("held_out"), "n_tokens", (F.col("n_heavy") + known).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"), (F.col("base") + more - F.col("n_tokens") * F.lit(unit)).alias("base_score"), (F.col("score") + more).alias("score"))


def op1_lm_scoring(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`."""
    session.workers_find_package(spark)
    return score(spark.read.parquet(f"{sf_dir}/documents.parquet"))
