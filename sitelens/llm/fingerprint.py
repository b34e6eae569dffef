"""Document fingerprints: bottom-k sketches of word-shingle hashes, as DataFrame expressions only.

A sketch is the array of the k smallest distinct hashes of a text's shingles (five words, A-Z lower-cased).
Sketches of parts merge into that of the whole, and estimate resemblance, containment and the number of
distinct shingles; for texts with fewer than k shingles these are exact.

Cases: a null text counts as empty and has an empty sketch; two empty sketches resemble fully, an empty and
another one not at all. A text shorter than a shingle gives its whole word sequence as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

K = 128
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def sketch(text: str, k: int = K, width: int = 5) -> Column:
    """The sketch of a text column, named in SQL; the column must not be null."""
    words = f"filter(split(translate({text}, '{UPPER}', '{LOWER}'), '[\\\\x20\\\\x09-\\\\x0D]+'), w -> w <> '')"
    hashes = f"transform({words}, w -> xxhash64(w))"
    runs = f"if(size(h) >= {width}, transform(sequence(1, size(h) - {width - 1}), i -> xxhash64(slice(h, i, {width}))), if(size(h) = 0, h, array(xxhash64(h))))"
    return F.expr(f"transform(array({hashes}), h -> slice(array_sort(array_distinct({runs})), 1, {k}))[0]")


def merge(a: str, b: str, k: int = K) -> Column:
    """The sketch of both sketches' texts together."""
    return F.expr(f"slice(array_sort(array_union({a}, {b})), 1, {k})")


def resemblance(a: str, b: str, k: int = K) -> Column:
    """Estimated share of common shingles among all: of the k smallest of both, those that both have."""
    least = f"slice(array_sort(array_union({a}, {b})), 1, {k})"
    return F.expr(f"case when size({a}) = 0 and size({b}) = 0 then 1D when size({a}) = 0 or size({b}) = 0 then 0D else cast(size(array_intersect({least}, array_intersect({a}, {b}))) as double) / size({least}) end")


def distinct_shingles(a: str, k: int = K) -> Column:
    """Estimated number of distinct shingles."""
    share = f"(element_at({a}, {k}) / 18446744073709551616D + 0.5D)"
    return F.expr(f"if(size({a}) < {k}, cast(size({a}) as double), {k - 1} / {share})")


def containment(a: str, b: str, k: int = K) -> Column:
    """Estimated share of a's shingles that b has too: the common ones by resemblance, over a's number."""
    whole = F.transform(F.array(merge(a, b, k)), lambda m: F.when(F.size(m) < k, F.size(m).cast("double")).otherwise((k - 1) / (F.element_at(m, k) / F.lit(2.0**64) + 0.5)))[0]
    return F.when(F.size(a) == 0, F.lit(0.0)).otherwise(F.least(F.lit(1.0), resemblance(a, b, k) * whole / distinct_shingles(a, k)))


def as_text(a: str) -> Column:
    """A sketch as a string of 16 hexadecimal digits for each hash."""
    return F.expr(f"array_join(transform({a}, x -> lpad(hex(x), 16, '0')), '')")


def with_next(docs: DataFrame, columns: list[str], buckets: int | None = None) -> DataFrame:
    """Adds `next`, a struct of `columns` from the row after each by descending id (after the last: the first).

    Rows have columns id and text; ties of id go by text, rows without an id come last. Ranges of ids make buckets, so no task
    sees all rows; the row after a bucket's last is the next bucket's first. The driver gets one id per bucket.
    """
    spark = docs.sparkSession
    n = buckets or 4 * int(spark.conf.get("spark.sql.shuffle.partitions"))
    cuts = docs.agg(F.percentile_approx("id", [i / n for i in range(1, n)], 10 * n).alias("c")).first().c or []
    cuts = sorted(set(cuts))
    bounds = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>") if cuts else F.array().cast("array<bigint>")
    steps = max(1, len(cuts)).bit_length()
    low = "named_struct('lo', 0, 'hi', size(cuts))"
    search = f"aggregate(sequence(1, {steps + 1}), {low}, (r, i) -> if(r.lo >= r.hi, r, if(cuts[int((r.lo + r.hi) / 2)] < id, named_struct('lo', int((r.lo + r.hi) / 2) + 1, 'hi', r.hi), named_struct('lo', r.lo, 'hi', int((r.lo + r.hi) / 2)))), r -> r.lo)"
    placed = docs.withColumn("cuts", bounds).withColumn("bucket", F.expr(f"if(id is null, -1, {search})")).drop("cuts")
    heads = sorted(((r.bucket, r.id) for r in placed.groupBy("bucket").agg(F.max("id").alias("id")).collect()), reverse=True)
    ids = [x for _, x in heads if x is not None]
    first = placed.where(F.col("id").isNull() | F.col("id").isin(ids)).groupBy("bucket").agg(F.max(F.struct("id")).alias("top"), F.min(F.struct(F.negative("id").alias("o"), "text", *[c for c in columns if c != "text"])).alias("head"))
    order = [b for b, _ in heads]
    after = spark.createDataFrame([(b, order[(k + 1) % len(order)]) for k, b in enumerate(order)], "bucket int, follows int")
    ends = after.join(first.select(F.col("bucket").alias("follows"), F.struct(*[f"head.{c}" for c in columns]).alias("head")), "follows").select("bucket", "head")
    w = Window.partitionBy("bucket").orderBy(F.col("id").desc_nulls_last(), "text")
    lead = placed.withColumn("next", F.lead(F.struct(*columns)).over(w))
    return lead.join(ends, "bucket", "left").withColumn("next", F.coalesce("next", "head")).drop("bucket", "head")


def compare_edited(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", k: int = K) -> DataFrame:
    """Fingerprints of every text and of its edited text: the last third replaced by the next text's beginning."""
    slim = docs.select(F.col(id_col).cast("long").alias("id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    told = with_next(slim.withColumn("own", sketch("text", k)), ["text", "own"])
    told = told.withColumn("n_chars", F.char_length("text").cast("long")).withColumn("m", F.expr("int(n_chars div 3)"))
    told = told.withColumn("changed", F.expr("concat(left(text, int(n_chars - m)), left(next.text, m))"))
    told = told.withColumn("edited", sketch("changed", k))
    return told.select(
        F.col("id").alias("doc_id"),
        "n_chars",
        F.sha2("changed", 256).alias("edited_sha256"),
        as_text("own").alias("fingerprint"),
        as_text("edited").alias("edited_fingerprint"),
        resemblance("own", "edited", k).alias("near_edited"),
        resemblance("own", "next.own", k).alias("near_next"),
        distinct_shingles("own", k).alias("n_shingles_est"),
    )


def op5_fingerprints(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`."""
    return compare_edited(spark.read.parquet(f"{sf_dir}/documents.parquet"))
