"""Secret scans: three fixed patterns, and character Markov models for secrets that have no pattern.

Two first-order models over the characters of a token, one of random strings and one of ordinary
identifiers, are counted from labelled samples: random are what the patterns catch in a bounded sample of
documents and strings drawn from digests of a counter over the alphabets that keys are written in; ordinary are the other
tokens of those documents of less than 16 characters, as they are and in capitals, and their words put together by `_`, `-`, `/` and
capitals. A token of 16 characters or more whose log-likelihood ratio reaches
the threshold is added as a span of kind `random`, unless it overlaps a pattern's span. All of it is DataFrame expressions.

Places of matches come from the lengths of the matches and of the gaps between them, in code points, added up in blocks of
about the root of their number, so that nothing is copied along from match to match (an aggregation copies its state at every
step). Spans meet by ranks in sorted lists, and tokens and texts are read in blocks: a token of a megabyte or a text with
100000 matches takes seconds.

Cases: null text counts as empty; without any match counts are 0 and spans is empty. Copies and repeated
ids give a row each; null ids stay. An empty table gives no rows (its models are those of the digests). Matches of two kinds
that start together come in the order of kinds. Other columns are not looked at; `masked` keeps them, whatever their names.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The patterns to find, the group whose length counts, and the least length.
KINDS = (
    ("assign", r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", 2, 12),
    ("access", r"AKIA[A-Z0-9]+", 0, 18),
    ("hex", r"[0-9a-f]{16,}", 0, 16),
)
TOKEN = r"[A-Za-z0-9+/_-]{16,}"
ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-"
#: Alphabets of the random strings drawn for training: base 64 of both kinds, letters and digits, base 36, base 32, hex in capitals.
DRAWN = ("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789_-", "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789", "abcdefghijklmnopqrstuvwxyz0123456789", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567", "0123456789ABCDEF")
#: Documents that the models are fitted on, at most.
SAMPLE_DOCUMENTS = 2000
THRESHOLD = 12.0
#: Code points of a block of text.
BLOCK = 1024

_SPAN = "array<struct<first:bigint,last:bigint,kind:int>>"


def _let(name: str, value: str, body: str) -> str:
    """SQL of body with a name for a value, which is computed once."""
    return f"element_at(transform(array({value}), {name} -> {body}), 1)"


_NONE = "cast(array() as array<bigint>)"


def _before(numbers: str) -> str:
    """SQL for the sum of what is before each of an array of bigint, which is not empty."""
    total = lambda x: f"aggregate({x}, 0L, (s, y) -> s + y)"
    inner = f"transform(blk, (y, i) -> start + {total('slice(blk, 1, i)')})"
    outer = f"flatten(transform(blks, (blk, k) -> {_let('start', total('slice(sums, 1, k)'), inner)}))"
    cut = "transform(sequence(0, int(ceil(size(nums) / width)) - 1), k -> slice(nums, k * width + 1, width))"
    return _let("nums", numbers, _let("width", "int(ceil(sqrt(size(nums))))", _let("blks", cut, _let("sums", f"transform(blks, w -> {total('w')})", outer))))


def _places(found: str, gaps: str, kind: int, keep: str) -> str:
    """SQL for the spans of matches `found` between `gaps`; keep: an array of which matches count."""
    both = f"zip_with({found}, slice({gaps}, 1, size({found})), (m, g) -> named_struct('m', bigint(length(m)), 'g', bigint(length(g))))"
    span = f"cast(named_struct('first', p + z.g, 'last', p + z.g + z.m, 'kind', {kind}) as struct<first:bigint,last:bigint,kind:int>)"
    spans = f"zip_with(both, {_before('transform(both, z -> z.m + z.g)')}, (z, p) -> {span})"
    kept = f"transform(filter(zip_with({_let('both', both, spans)}, {keep}, (x, k) -> named_struct('x', x, 'k', k)), y -> y.k), y -> y.x)"
    return f"if(size({found}) = 0, cast(array() as {_SPAN}), {kept})"


def _base(docs: DataFrame) -> DataFrame:
    """Adds s0, s1, s2: the spans of each pattern in text."""
    out = docs
    for k, (_, pattern, group, least) in enumerate(KINDS):
        p = F.lit(pattern)
        out = out.withColumn(f"m{k}", F.regexp_extract_all("text", p, F.lit(0)))
        some = F.size(f"m{k}") > 0
        none = F.expr("cast(array() as array<string>)")
        out = out.withColumns({f"g{k}": F.when(some, F.split("text", pattern, -1)).otherwise(none), f"v{k}": F.when(some, F.regexp_extract_all("text", p, F.lit(group))).otherwise(none) if group else F.col(f"m{k}")})
        out = out.withColumn(f"s{k}", F.expr(_places(f"m{k}", f"g{k}", k, f"transform(v{k}, x -> length(x) >= {least})"))).drop(f"g{k}", f"m{k}")
    return out


#: All pairs of neighbouring characters of a token, and a token's blocks, which share a character with the next.
_PAIRS, _BLOCKS = "(?=(..))", f"(?=(.{{1,{BLOCK + 1}}})).{{1,{BLOCK}}}"


def train(docs: DataFrame, documents: int = SAMPLE_DOCUMENTS) -> list[float]:
    """The table of log-likelihood ratios, by ASCII codes of two characters, from `documents` documents or all if there are fewer.

    The sample is that of the least hashes of rows, so it does not depend on their order: tasks send hashes alone, rows are
    picked where they are, and rows equal in all columns count once. What reaches the driver is one row per label and character pair.
    """
    spark = docs.sparkSession
    own = docs.select("text", F.xxhash64(*docs.columns).alias("h"))
    last = own.select("h").orderBy("h").limit(documents).agg(F.max("h")).first()[0]
    sample = own.where(F.col("h") <= F.lit(last)).distinct() if last is not None else own
    caught = _base(sample).select("h", "text", F.concat("v0", "v1", "v2").alias("caught"))
    secret = caught.select(F.lit(1).alias("label"), F.explode("caught").alias("token")).where(F.length("token") >= 12)
    rest = F.col("text")
    for _, pattern, *_ in KINDS:
        rest = F.regexp_replace(rest, pattern, " ")
    rest = F.regexp_replace(rest, TOKEN, " ")  # what is long may be random itself: ordinary are short tokens, and words put together
    tokens = lambda text: F.regexp_extract_all(text, F.lit(r"[A-Za-z0-9+/_-]{6,}"), F.lit(0))
    plain = caught.select(F.explode(tokens(rest)).alias("token")).select(F.explode(F.array("token", F.upper("token"), F.initcap("token"))).alias("token"))
    put = caught.where("pmod(h, 8) = 0").select(F.explode(F.array(*[F.translate(rest, " ", x) for x in "_-/"], F.upper(F.translate(rest, " ", "_")), F.translate(F.initcap(rest), " ", ""))).alias("text"))
    plain = plain.unionAll(put.select(F.explode(tokens(F.col("text"))))).select(F.lit(0).alias("label"), "token")
    digest = F.sha2(F.concat_ws(" ", F.col("id"), F.col("k")), 256)
    drawn = spark.range(1000).select("id", F.posexplode(F.array(*[F.lit(x) for x in DRAWN])).alias("k", "a"))
    drawn = drawn.select(F.lit(1).alias("label"), F.col("a"), digest.alias("d")).select("label", F.expr("array_join(transform(sequence(0, 31), i -> substring(a, int(conv(substring(d, 2 * i + 1, 2), 16, 10)) % length(a) + 1, 1)), '')").alias("token"))
    blocks = secret.unionAll(plain).unionAll(drawn).select("label", F.explode(F.regexp_extract_all("token", F.lit(_BLOCKS), F.lit(1))).alias("b"))
    pairs = blocks.select("label", F.explode(F.regexp_extract_all("b", F.lit(_PAIRS), F.lit(1))).alias("pair"))
    size = len(ALPHABET)
    counts = [[1.0] * (size * size), [1.0] * (size * size)]
    place = {c: k for k, c in enumerate(ALPHABET)}
    for r in pairs.groupBy("label", "pair").agg(F.count("*").alias("n")).where(F.col("pair").rlike(r"^[A-Za-z0-9+/_-]{2}$")).collect():
        counts[r.label][place[r.pair[0]] * size + place[r.pair[1]]] += r.n
    totals = [[sum(c[k * size : (k + 1) * size]) for k in range(size)] for c in counts]
    table = [0.0] * (128 * 128)
    for a in ALPHABET:
        for b in ALPHABET:
            at = place[a] * size + place[b]
            table[ord(a) * 128 + ord(b)] = math.log(counts[1][at] / totals[1][place[a]]) - math.log(counts[0][at] / totals[0][place[a]])
    return table


def ratio(token: Column, table: list[float]) -> Column:
    """The log-likelihood ratio of a token of ALPHABET, random over ordinary."""
    ratios = F.split(F.lit(",".join(f"{x:.4f}" for x in table)), ",").cast("array<double>")
    one = lambda p: F.element_at(ratios, (F.ascii(p) * 128 + F.ascii(F.substring(p, 2, 1)) + 1).cast("int"))
    block = lambda b: F.aggregate(F.regexp_extract_all(b, F.lit(_PAIRS), F.lit(1)), F.lit(0.0), lambda acc, p: acc + one(p))
    return F.aggregate(F.regexp_extract_all(token, F.lit(_BLOCKS), F.lit(1)), F.lit(0.0), lambda acc, b: acc + block(b))


def _rank(points: str, ends: str, first: bool) -> str:
    """SQL for how many of `ends` are below each of the sorted `points`, or not above it if `first`."""
    tag = (0, 1) if first else (1, 0)
    rows = f"array_sort(concat(transform({ends}, e -> named_struct('v', e, 't', {tag[0]})), transform({points}, e -> named_struct('v', e, 't', {tag[1]}))))"
    at = f"filter(transform({rows}, (e, i) -> named_struct('t', e.t, 'i', i)), e -> e.t = {tag[1]})"
    return f"transform({at}, (e, j) -> e.i - j)"


#: SQL for the spans of `own`, sorted and apart, that overlap none of `base`: as many of these begin before its end as end by its start.
_ALONE = f"transform(filter(zip_with(own, zip_with({_rank('transform(own, x -> x.last)', 'transform(base, x -> x.first)', False)}, {_rank('transform(own, x -> x.first)', 'transform(base, x -> x.last)', True)}, (a, b) -> a = b), (x, k) -> named_struct('x', x, 'k', k)), y -> y.k), y -> y.x)"


def scan(docs: DataFrame, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """Every row as a struct `row`, its text, and `base` and `spans`: arrays of (first, last, kind), kind 3 being random."""
    kept = [F.col(f"`{c}`") for c in docs.columns]
    slim = docs.select(F.struct(*kept).alias("row"), F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"))
    table = train(docs.select(F.coalesce(F.col(f"`{text_col}`").cast("string"), F.lit("")).alias("text"), *[F.col(f"`{c}`").alias(f"_{k}") for k, (c, t) in enumerate(docs.dtypes) if c != text_col and "map<" not in t and "variant" not in t]))
    out = _base(slim).withColumn("base", F.array_sort(F.concat("s0", "s1", "s2")))
    out = out.withColumn("m3", F.regexp_extract_all("text", F.lit(TOKEN), F.lit(0)))
    out = out.withColumn("r3", F.transform("m3", lambda t: ratio(t, table) >= threshold))
    out = out.withColumn("g3", F.when(F.expr("exists(r3, r -> r)"), F.split("text", TOKEN, -1)))
    out = out.withColumn("own", F.when(F.col("g3").isNotNull(), F.expr(_places("m3", "g3", 3, "r3"))))
    own = F.when(F.col("own").isNotNull(), F.expr(_ALONE)).otherwise(F.expr(f"cast(array() as {_SPAN})"))
    return out.select("row", "text", "base", F.array_sort(F.concat("base", own)).alias("spans"))


def _digest(spans: str) -> Column:
    order = f"array_sort({spans}, (x, y) -> case when x.first <> y.first then int(sign(x.first - y.first)) else x.kind - y.kind end)"
    return F.expr(f"array_join(transform({order}, x -> concat(array('assign', 'access', 'hex', 'random')[x.kind], ':', x.first, ':', x.last)), ',')")


def report(docs: DataFrame) -> DataFrame:
    """doc_id, n_assign, n_access, n_hex, base_sha256, spans."""
    found = scan(docs.select("doc_id", "text"))
    counts = [F.expr(f"cast(size(filter(base, x -> x.kind = {k})) as long)").alias(f"n_{name}") for k, (name, *_) in enumerate(KINDS)]
    return found.select("row.doc_id", *counts, F.sha2(_digest("base"), 256).alias("base_sha256"), _digest("spans").alias("spans"))


def masked(docs: DataFrame, text_col: str = "text", count_col: str = "n_chars") -> DataFrame:
    """The input with [secret] in place of every span (overlapping spans become one) and n_chars made new; null stays null."""
    blocks = f"regexp_extract_all(text, '(?s).{{1,{BLOCK}}}', 0)"
    events = "array_sort(concat(transform(spans, x -> named_struct('at', x.first, 'd', 1L)), transform(spans, x -> named_struct('at', x.last, 'd', -1L))))"
    depth = f"zip_with(ev, {_before('transform(ev, e -> e.d)')}, (e, n) -> named_struct('at', e.at, 'd', e.d, 'n', n))"
    edge = lambda d, n: f"transform(filter(deep, e -> e.d = {d} and e.n = {n}), e -> e.at)"
    between = f"if(t > f, array_join(transform(sequence(f div {BLOCK}, (t - 1) div {BLOCK}), b -> substring(blocks[int(b)], int(greatest(f - b * {BLOCK}, 0)) + 1, int(least(t - b * {BLOCK}, {BLOCK}) - greatest(f - b * {BLOCK}, 0)))), ''), '')"
    rest = f"array_join(zip_with(concat(array(0L), {edge(-1, 1)}), concat({edge(1, 0)}, array(bigint(length(text)))), (f, t) -> {between}), '[secret]')"
    whole = _let("blocks", blocks, _let("ev", events, _let("deep", depth, rest)))
    found = scan(docs, text_col)
    found = found.withColumn("clean", F.when(F.col("row").getField(text_col).isNotNull(), F.when(F.expr("size(spans) = 0"), F.col("text")).otherwise(F.expr(whole))))
    made = {text_col: F.col("clean"), count_col: F.char_length("clean").cast("long")}
    return found.select(*[made.get(c, F.col("row").getField(c)).alias(c) for c in docs.columns])


def op7_secret_scan(spark, sf_dir: str) -> DataFrame:
    """Every whole text of `documents`."""
    return report(spark.read.parquet(f"{sf_dir}/documents.parquet"))
