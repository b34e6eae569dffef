"""MinHash near-duplicates by fast similarity sketching, banding and exact confirmation.

A document's set holds the hashes of its word shingles. The sketch is filled in rounds: round i throws
every element into one of t bins and keeps the least (round, hash) a bin has seen; from round t on, an
element goes to bin i - t, so after 2t rounds no bin is empty. Rounds stop when all bins are filled,
which takes about t ln t / n rounds for n elements, and estimates concentrate as with t independent
hashes. Eight sketch values make a band; two documents that share a band are candidates. At a
similarity of 0.8 a pair shares none of 64 bands with probability 8e-6.

Buckets are met in one pass over rows sorted by bucket and id, dealt by ranges of both, so that a bucket of
any size is spread over as many tasks as its share asks for. After it, what is known of a bucket is one row (or PIVOTS
rows): for the at most HOT buckets that hold more than a share of 1 / HOT of all rows these are broadcast, and the
rows of such a bucket stay where they are; all others are joined.

Sets are written once, in buckets of their id, so no confirmation moves them all, and only texts that share a bucket (and a few that a table of
bits lets through) move for that: a pair moves one of its two sets, and the set that many are compared to is copied once per SALTED of them, so no task meets all of them.

Candidates are confirmed on full sets, without all pairs of a group: each band bucket's smallest
document is compared to the rest and components are formed; documents in other components are compared to a
few drawn members; and only pairs of a bucket that are still in different components are compared after that: as rows in buckets with
few such pairs, else in tiles of two packs, where sets meet as 0/1 matrices and a spanning forest of the components
that link comes out, never the links. Packs are bounded by elements and by members. So components are those of all confirmed candidate pairs.

Cases: null or blank texts have an empty set and link with nothing (component: themselves). Equal sets
are one node until the end, so copies cost nothing. Rows without an id keep component null and kept
true. Repeated ids count as one document, linked if any of their texts is. A text of any length is one set,
and memory follows the longest one. An empty table gives no rows. Other columns of the input are not looked at.
"""

from __future__ import annotations

import functools
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.llm import session, text

BANDS, ROWS = 64, 8
#: Members of a bucket, drawn by hash, that its documents of other components are compared to before all of them are.
PIVOTS = 8
#: A bucket with more open pairs than PAIRS is compared in tiles of two packs, each of about PACK set elements or MEMBERS sets.
PAIRS, PACK, MEMBERS = 256, 1 << 15, 512
#: Rows that one copy of a much-asked set is compared with.
SALTED = 1024
#: At most so many buckets are broadcast: those with more than this part of all rows.
HOT = 1 << 13


def sketch(values: np.ndarray, rows: np.ndarray, n_rows: int, size: int) -> np.ndarray:
    """The sketches, n_rows x size, of sets given as (value, row); rows without values stay all ones."""
    bits = np.uint64(size.bit_length() - 1)
    full = np.uint64(2**64 - 1)
    out = np.full(n_rows * size, full, np.uint64)
    low = np.uint64(2**46 - 1)
    for i in range(2 * size):
        h = text.mix(values ^ text.mix(np.full(1, i + 1, np.uint64)))
        bins = (h >> (np.uint64(64) - bits)).astype(np.int64) if i < size else i - size
        np.minimum.at(out, rows * size + bins, (np.uint64(i) << np.uint64(46)) | (h & low))
        if i < 2 or i % 4 == 0 or len(values) < 1000:
            open_rows = (out.reshape(n_rows, size) == full).any(axis=1)
            keep = open_rows[rows]
            if not keep.any():
                break
            values, rows = values[keep], rows[keep]
    return out.reshape(n_rows, size)


def _describe(width: int, bands: int, rows_per_band: int):
    salt = text.mix(np.arange(1, bands + 1, dtype=np.uint64))

    def run(batches):
        for batch in batches:
            for at, to, data, offs in text.pieces(batch.column(1)):
                n = to - at
                hashes, rows, _, _ = text.words(data, offs)
                values, rows = text.sets(*text.shingles(hashes, rows, width))
                count = np.bincount(rows, minlength=n)
                ends = np.cumsum(count)
                drawn = sketch(values, rows, n, bands * rows_per_band).reshape(n, bands, rows_per_band)
                band = np.zeros((n, bands), np.uint64) + salt
                for k in range(rows_per_band):
                    band = text.mix(band + drawn[:, :, k])
                some = count > 0
                raw = values.tobytes()
                keys = [hashlib.blake2b(raw[8 * (e - c) : 8 * e], digest_size=16).digest() if c else None for c, e in zip(count.tolist(), ends.tolist())]
                lists = pa.ListArray.from_arrays(pa.array(np.concatenate(([0], np.cumsum(some * bands))), pa.int32()), pa.array(band[some].ravel().view(np.int64)))
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, n), pa.array(count, pa.int64()), pa.array(keys, pa.binary()), lists], ["id", "n", "key", "bands"])

    return run


def _full_sets(width: int):
    def run(batches):
        for batch in batches:
            for at, to, data, offs in text.pieces(batch.column(1)):
                hashes, rows, _, _ = text.words(data, offs)
                values, rows = text.sets(*text.shingles(hashes, rows, width))
                ends = np.cumsum(np.bincount(rows, minlength=to - at))
                raw = values.tobytes()
                cuts = [raw[8 * a : 8 * b] for a, b in zip([0, *ends[:-1].tolist()], ends.tolist())]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(at, to - at), pa.array(cuts, pa.binary())], ["id", "values"])

    return run


def _confirm(percent: int):
    def run(batches):
        for batch in batches:
            keep = []
            for x, y in zip(batch.column(2), batch.column(3)):
                a, b = np.frombuffer(x.as_buffer(), np.uint64), np.frombuffer(y.as_buffer(), np.uint64)
                both = np.concatenate((a, b))
                both.sort(kind="stable")
                shared = int((both[1:] == both[:-1]).sum())
                keep.append(100 * shared >= percent * (len(a) + len(b) - shared))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1)], ["a", "b"]).filter(pa.array(keep, pa.bool_()))

    return run


def _spread(batches):
    """Of rows (bucket, id, n) sorted by bucket: those of buckets with another row, and all of a partition's first and last bucket."""

    def rows(*columns):
        return pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["bucket", "id", "n"])

    last, held = None, None
    for batch in batches:
        if not batch.num_rows:
            continue
        cols = [batch.column(k).to_numpy() for k in range(3)]
        go_on = last is None or cols[0][0] == last  # the first bucket here belongs to rows that are out already
        if held is not None:
            cols = [np.concatenate((x, y)) for x, y in zip(held, cols)]
            go_on = False
        bucket = cols[0]
        starts = np.flatnonzero(np.concatenate(([True], bucket[1:] != bucket[:-1])))
        sizes = np.diff(np.concatenate((starts, [len(bucket)])))
        some = sizes > 1
        some[0] |= go_on
        keep = np.repeat(some, sizes)
        held = None if some[-1] else [x[-1:] for x in cols]
        last = bucket[-1]
        yield rows(*[x[keep] for x in cols])
    if held is not None:
        yield rows(*held)


def _forest(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Which of the edges (a, b) make a spanning forest."""
    nodes, at = np.unique(np.concatenate((a, b)), return_inverse=True)
    root, keep = list(range(len(nodes))), np.zeros(len(a), bool)
    for k, (x, y) in enumerate(zip(at[: len(a)].tolist(), at[len(a) :].tolist())):
        while root[x] != x:
            root[x] = x = root[root[x]]
        while root[y] != y:
            root[y] = y = root[root[y]]
        if x != y:
            root[y], keep[k] = x, True
    return keep


def tile(left: tuple, right: tuple, percent: int) -> tuple[np.ndarray, np.ndarray]:
    """Components that links between two packs join: a spanning forest (a, b) of them.

    A pack is (components, sizes, values): one of the first two for each set, and all sets' elements one after another.
    """
    (lc, ln, lv), (rc, rn, rv) = left, right
    common = np.intersect1d(lv, rv)
    shared = np.zeros((len(ln), len(rn)), np.float32)
    for at in range(0, len(common), 2048):
        part = common[at : at + 2048]
        has = []
        for v, n in ((lv, ln), (rv, rn)):
            place = np.searchsorted(part, v)
            place[place == len(part)] = 0
            ok = part[place] == v
            table = np.zeros((len(n), len(part)), np.float32)
            table[np.repeat(np.arange(len(n)), n)[ok], place[ok]] = 1
            has.append(table)
        shared += has[0] @ has[1].T
    edges = []
    for k in range(len(ln)):
        own = shared[k].astype(np.int64)
        hit = np.unique(rc[(100 * own >= percent * (ln[k] + rn - own)) & (rc != lc[k])])
        if len(hit):
            edges.append(np.stack((np.full(len(hit), lc[k]), hit)))
    if not edges:
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    a, b = np.concatenate(edges, axis=1)
    keep = _forest(a, b)
    return np.maximum(a, b)[keep], np.minimum(a, b)[keep]


def _confirm_packs(percent: int):
    def flat(members) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        cuts = [np.frombuffer(x.as_buffer(), np.uint64) for x in members.field("values")]
        return members.field("comp").to_numpy(), np.fromiter(map(len, cuts), np.int64, len(cuts)), np.concatenate(cuts)

    def run(batches):
        for batch in batches:
            for k in range(batch.num_rows):
                a, b = tile(flat(batch.column(0).slice(k, 1).flatten()), flat(batch.column(1).slice(k, 1).flatten()), percent)
                yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])

    return run


def _by_bucket(rows: DataFrame, known: DataFrame) -> DataFrame:
    """rows joined with what is known of their bucket; both say whether it is hot, and of hot ones there are at most HOT."""
    few = rows.where("not hot").join(known.where("not hot").drop("hot"), "bucket")
    return few.unionByName(rows.where("hot").join(F.broadcast(known.where("hot").drop("hot")), "bucket"))


def near_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = 5, percent: int = 80, bands: int = BANDS, rows_per_band: int = ROWS) -> DataFrame:
    """One row per input row: doc_id, n_shingles, component_id, kept (doc_id is its component's smallest).

    Links are pairs with 100 * intersection >= percent * union of their sets of `width`-word shingles.
    """
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    seen = session.settle(slim.mapInArrow(_describe(width, bands, rows_per_band), "id long, n long, key binary, bands array<long>"))
    linked = seen.where("id is not null and n > 0")
    node = linked.groupBy("key").agg(F.min("id").alias("node"), F.count("*").alias("c"))
    reps = linked.groupBy("key").agg(F.min("id").alias("id"), F.first("n").alias("n"), F.first("bands").alias("bands"))
    rows = reps.select(F.explode("bands").alias("bucket"), "id", "n").repartitionByRange("bucket", "id").sortWithinPartitions("bucket", "id")
    rows = session.settle(rows.mapInArrow(_spread, "bucket long, id long, n long"))
    sizes = rows.groupBy("bucket").agg(F.min(F.struct("id", "n")).alias("p"), F.count("*").alias("c")).where("c > 1")
    pivot = session.settle(sizes.withColumn("hot", F.col("c") * HOT > F.lit(rows.count())))
    mark = pivot.where("hot").select("bucket", "hot")
    rows = rows.join(F.broadcast(mark), "bucket", "left").withColumn("hot", F.coalesce("hot", F.lit(False)))
    met = session.settle(_by_bucket(rows, pivot).select("bucket", "id", "n", "hot", F.col("p.id").alias("p"), F.col("p.n").alias("pn")))
    alike = f"100 * least(n, pn) >= {percent} * greatest(n, pn)"
    ids = session.settle(met.select("id").distinct())
    sets = session.settle_by(session.sift(slim, "id", ids)[0].join(ids.hint("merge"), "id", "left_semi").mapInArrow(_full_sets(width), "id long, values binary"), "id")

    def confirmed(pairs: DataFrame) -> DataFrame:
        pairs = session.settle(pairs.distinct())
        n = pairs.count()
        if not n:
            return pairs
        hot = pairs.groupBy("b").agg(F.count("*").alias("c")).where(f"c > {SALTED} and c * {HOT} > {n}")
        hot = session.settle(hot.select("b", F.ceil(F.col("c") / SALTED).cast("int").alias("salts")))
        va, vb = sets.select(F.col("id").alias("a"), F.col("values").alias("va")), sets.select(F.col("id").alias("b"), F.col("values").alias("vb"))
        if hot.isEmpty():
            both = pairs.join(va, "a").join(vb, "b").select("a", "b", "va", "vb")
        else:
            marked = pairs.join(F.broadcast(hot), "b", "left").join(va, "a")
            both = marked.where("salts is null").join(vb, "b").select("a", "b", "va", "vb")
            left = marked.where("salts is not null").select("a", "b", "va", F.pmod(F.xxhash64("a"), "salts").cast("int").alias("salt"))
            right = vb.join(F.broadcast(hot), "b").select("b", "vb", F.explode(F.sequence(F.lit(0), F.col("salts") - 1)).alias("salt"))
            both = both.unionByName(left.join(right, ["b", "salt"]).select("a", "b", "va", "vb"))
        return session.settle(both.mapInArrow(_confirm(percent), "a long, b long"))

    first = met.where(f"id <> p and {alike}").select(F.col("id").alias("a"), F.col("p").alias("b"))
    links = confirmed(first)
    found = session.settle(session.components(links))

    def still_open() -> DataFrame:
        named = met.join(found, "id", "left").select("bucket", "id", "n", "hot", "p", F.coalesce("component", "id").alias("comp"))
        split = named.groupBy("bucket", "hot").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("bucket", "hot")
        return session.settle(_by_bucket(named, split))

    def joined(pairs: DataFrame) -> DataFrame:
        more = confirmed(pairs)
        if more.isEmpty():
            return found
        return session.settle(session.components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more)))

    rows = still_open()
    if not rows.isEmpty():
        drawn = rows.groupBy("bucket", "hot").agg(*[F.min(F.struct(F.xxhash64("id", F.lit(k)).alias("h"), "id", "n", "comp")).alias(f"d{k}") for k in range(PIVOTS)])
        drawn = drawn.select("bucket", "hot", F.explode(F.array_distinct(F.transform(F.array(*[f"d{k}" for k in range(PIVOTS)]), lambda d: d.dropFields("h")))).alias("d"))
        near = _by_bucket(rows, drawn).where(f"comp <> d.comp and 100 * least(n, d.n) >= {percent} * greatest(n, d.n)")
        found = joined(near.select(F.col("id").alias("a"), F.col("d.id").alias("b")))
        rows = still_open()
    last = []
    if not rows.isEmpty():
        size = rows.groupBy("bucket", "hot", "comp").agg(F.count("*").alias("c"), F.sum("n").alias("s"))
        size = size.groupBy("bucket", "hot").agg(F.max_by("comp", F.struct("c", "comp")).alias("big"), F.sum("c").alias("m"), F.max("c").alias("c"), F.sum("s").alias("s"), F.max_by("s", F.struct("c", "comp")).alias("bs"))
        packs = lambda s, m: F.expr(f"int(greatest(1, ceil(({s}) / {PACK}), ceil(({m}) / {MEMBERS})))")
        size = session.settle(size.withColumns({"many": F.expr(f"m * (m - c) > {PAIRS}"), "outer": packs("s - bs", "m - c"), "all": packs("s", "m")}))
        rows = session.settle(_by_bucket(rows, size.select("bucket", "hot", "big", "many", "outer", "all")))
        few = rows.where("not many")
        cross = few.alias("x").join(few.alias("y"), F.expr(f"x.bucket = y.bucket and x.comp < y.comp and x.id <> x.p and y.id <> y.p and 100 * least(x.n, y.n) >= {percent} * greatest(x.n, y.n)"))
        last.append(confirmed(cross.select(F.greatest("x.id", "y.id").alias("a"), F.least("x.id", "y.id").alias("b"))))
        if not size.where("many").isEmpty():
            many = rows.where("many").join(sets, "id")

            def packed(side: DataFrame, count: str, name: str) -> DataFrame:
                own = side.withColumn(name, F.expr(f"int(pmod(xxhash64(id), `{count}`))"))
                return session.settle(own.groupBy("bucket", name).agg(F.collect_list(F.struct("comp", "values")).alias(f"{name}s")))

            left, right = packed(many.where("comp <> big"), "outer", "l"), packed(many, "all", "r")
            tiles = size.where("many").select("bucket", F.explode(F.sequence(F.lit(0), F.col("outer") - 1)).alias("l"), "all").select("bucket", "l", F.explode(F.sequence(F.lit(0), F.col("all") - 1)).alias("r"))
            dense = session.settle(tiles.join(left, ["bucket", "l"]).join(right, ["bucket", "r"]).select("ls", "rs").mapInArrow(_confirm_packs(percent), "a long, b long"))
            last.append(dense.distinct())
    more = functools.reduce(DataFrame.unionAll, last) if last else None
    merged = found if more is None or more.isEmpty() else session.components(found.select(F.col("id").alias("a"), F.col("component").alias("b")).unionAll(more))
    final = node.join(merged, node.node == merged.id, "left").select("key", F.coalesce("component", "node").alias("component"), (F.col("c") * HOT > F.lit(linked.count())).alias("hot"))
    final = session.settle(final)
    out = seen.select("id", "n", "key").join(F.broadcast(final.where("hot").select("key", F.col("component").alias("own"))), "key", "left")
    few = out.where("own is null").join(final.where("not hot").select("key", "component"), "key", "left")
    out = few.select("id", "n", "component").unionByName(out.where("own is not null").select("id", "n", F.col("own").alias("component")))
    component = F.when(F.col("n") > 0, F.col("component")).otherwise(F.col("id"))
    session.forget(sets)
    return out.select(F.col("id").alias("doc_id"), F.col("n").alias("n_shingles"), F.when(F.col("id").isNotNull(), component).alias("component_id")).withColumn("kept", F.expr("doc_id is null or doc_id = component_id"))


def op10_minhash_near_dedup(spark, sf_dir: str) -> DataFrame:
    """Whole `documents`, two-word shingles, similarity 0.8 or more."""
    session.workers_find_package(spark)
    return near_duplicates(spark.read.parquet(f"{sf_dir}/documents.parquet"), width=2)
