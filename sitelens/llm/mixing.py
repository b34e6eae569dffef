"""Mixing sources to target weights by hierarchical budgeting over domain, language and source.

A token budget goes down the tree: each node's budget is divided among its children by weight; a child
takes at most what its leaves can give, tokens times the greatest number of epochs, and what it leaves goes
to its siblings by weight. Only what all children of a node together can't take is missing from the node,
and so is divided among the node's own siblings. A leaf's budget is filled by whole epochs and then by the
prefix of one more epoch, in the order of a seeded hash that differs by epoch, as long as the sum of
tokens stays within the budget.

The driver gets a row per leaf (an error beyond max_leaves). Running sums are taken over 4096 ranges of the hash
per leaf and, in the one range where a budget ends, over its rows, so that no task sees a whole leaf; what
is broadcast is one row per leaf.

Cases: null language or source make leaves of their own; a null or blank text has 0 tokens and goes with
the epochs it is in; rows with equal id are taken or left together in a prefix; an empty table gives no rows.
Input columns are kept; the added ones replace any of the same name.
"""

from __future__ import annotations

from collections import defaultdict
from dataclasses import dataclass, field

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from sitelens.llm import session

RANGES = 4096


@dataclass(frozen=True)
class Mix:
    """Weights by path of the tree; a path without one weighs 1. The budget is a share of all tokens, or a number."""

    weights: dict[tuple, float] = field(default_factory=dict)
    share: float = 0.8
    tokens: int | None = None
    epochs: int = 3
    seed: int = 17
    max_leaves: int = 100_000


PRODUCTION = Mix({("web",): 0.6, ("reference",): 0.25, ("forum",): 0.15} | {(d, lang): w for d in ("web", "reference", "forum") for lang, w in (("en", 0.5), ("de", 0.2), ("fr", 0.2), ("es", 0.1))})
#: Domain of a source by the number in its name; other sources are of domain `other`.
DOMAIN = "case when source rlike '^src[0-9]{1,9}$' then case int(substring(source, 4)) % 4 when 0 then 'web' when 1 then 'web' when 2 then 'reference' else 'forum' end else 'other' end"


def divide(budget: float, children: list[tuple[float, float]]) -> list[float]:
    """A budget divided among (weight, capacity) pairs: by weight, with what some can't take given to the others."""
    out, left = [0.0] * len(children), float(budget)
    active = [k for k, (w, c) in enumerate(children) if w > 0 and c > 0]
    while active and left > 0:
        total = sum(children[k][0] for k in active)
        full = [k for k in active if children[k][1] <= left * children[k][0] / total]
        if not full:
            for k in active:
                out[k] = left * children[k][0] / total
            break
        for k in full:
            out[k] = children[k][1]
        left -= sum(out[k] for k in full)
        active = [k for k in active if k not in set(full)]
    return out


def budgets(leaves: dict[tuple, int], mix: Mix) -> dict[tuple, int]:
    """The token budget of every leaf, given the tokens of one epoch of each."""
    total = sum(leaves.values())
    capacity: dict[tuple, float] = defaultdict(float)
    children: dict[tuple, list[tuple]] = defaultdict(list)
    for path, n in sorted(leaves.items(), key=lambda x: tuple(map(str, x[0]))):
        for depth in range(len(path) + 1):
            node = path[:depth]
            capacity[node] += n * mix.epochs
            if depth and node not in children[path[: depth - 1]]:
                children[path[: depth - 1]].append(node)
    out = {(): min(capacity[()], mix.tokens if mix.tokens is not None else mix.share * total)}
    for depth in range(3):
        for node in [x for x in out if len(x) == depth]:
            own = children[node]
            for child, part in zip(own, divide(out[node], [(mix.weights.get(c, 1.0), capacity[c]) for c in own])):
                out[child] = part
    return {path: int(out.get(path, 0) + 1e-6) for path in leaves}


def apply(docs: DataFrame, mix: Mix = PRODUCTION, id_col: str = "doc_id", text_col: str = "text", domain: str = DOMAIN) -> DataFrame:
    """All rows with domain, n_tokens (whitespace words), budget (of the leaf, in tokens) and copies (times to take)."""
    spark = docs.sparkSession
    leaf = ["domain", "mix_lang", "mix_source"]
    row = docs.select(F.struct("*").alias("row"), F.expr(domain).alias("domain"), F.col("lang").alias("mix_lang"), F.col("source").alias("mix_source"), F.coalesce(F.col(id_col).cast("long"), F.lit(-(2**63))).alias("id"))
    tokens = F.coalesce(F.regexp_count(F.col(f"row.{text_col}"), F.lit(r"[^\x20\x09-\x0D]+")), F.lit(0)).cast("long")
    slim = session.settle(row.select(*leaf, "id", tokens.alias("n")))
    sums = slim.groupBy(*leaf).agg(F.sum("n").alias("n")).limit(mix.max_leaves + 1).collect()
    if len(sums) > mix.max_leaves:
        raise ValueError(f"more than {mix.max_leaves} leaves")
    have = {(r.domain, r.mix_lang, r.mix_source): r.n for r in sums}
    want = budgets(have, mix)
    plan = [(*path, want[path], *(divmod(want[path], n) if n else (mix.epochs, 0))) for path, n in have.items()]
    leaves = spark.createDataFrame(plan, "domain string, mix_lang string, mix_source string, budget long, epochs long, rest long")

    def on_leaf(left: DataFrame, right: DataFrame) -> DataFrame:
        named = right.withColumnsRenamed({c: f"leaf_{c}" for c in leaf})
        same = [F.col(c).eqNullSafe(F.col(f"leaf_{c}")) for c in leaf]
        return left.join(F.broadcast(named), same).drop(*[f"leaf_{c}" for c in leaf])

    drawn = on_leaf(slim, leaves).withColumn("h", F.xxhash64(F.lit(mix.seed), "epochs", "id"))
    drawn = drawn.withColumn("span", F.shiftrightunsigned("h", 52).cast("int")).withColumn("h", F.expr("h & 4503599627370495L"))
    spans = drawn.groupBy(*leaf, "span", "rest").agg(F.sum("n").alias("n"))
    upto = F.sum("n").over(Window.partitionBy(*leaf).orderBy("span"))
    edge = spans.withColumn("upto", upto).where("upto > rest").groupBy(*leaf).agg(F.min_by(F.struct("span", (F.col("upto") - F.col("n")).alias("before")), "span").alias("e"))
    edge = edge.select(*leaf, F.col("e.span").alias("edge"), F.col("e.before").alias("before"))
    inside = on_leaf(drawn, edge).where("span = edge")
    run = F.sum("n").over(Window.partitionBy(*leaf).orderBy("h", "id"))
    cut = inside.withColumn("run", F.col("before") + run).where("run <= rest").groupBy(*leaf).agg(F.max(F.struct("h", "id")).alias("cut"))
    names = [*leaf, "edge", "cut"]
    ends = edge.join(cut.withColumnsRenamed({c: f"x_{c}" for c in leaf}), [F.col(c).eqNullSafe(F.col(f"x_{c}")) for c in leaf], "left").select(*names).collect()
    known = {(r.domain, r.mix_lang, r.mix_source): (r.edge, *(r.cut or (-1, 0))) for r in ends}
    full = [(*p, *known.get(p[:3], (RANGES, 0, 0))) for p in plan]
    chosen = spark.createDataFrame(full, "domain string, mix_lang string, mix_source string, budget long, epochs long, rest long, edge int, cut_h long, cut_id long")
    out = on_leaf(row.withColumn("n", tokens), chosen).withColumn("h", F.xxhash64(F.lit(mix.seed), "epochs", "id"))
    out = out.withColumn("span", F.shiftrightunsigned("h", 52).cast("int")).withColumn("h", F.expr("h & 4503599627370495L"))
    more = F.expr("rest > 0 and (span < edge or span = edge and (h < cut_h or h = cut_h and id <= cut_id))")
    added = {"domain": F.col("domain"), "n_tokens": F.col("n"), "budget": F.col("budget"), "copies": (F.col("epochs") + F.when(more, 1).otherwise(0)).cast("int")}
    kept = [F.col("row").getField(c).alias(c) for c in docs.columns if c not in added]
    return out.select(*kept, *[v.alias(k) for k, v in added.items()])


def mixed(docs: DataFrame, mix: Mix = PRODUCTION) -> DataFrame:
    """The chosen documents with the input's columns, each as often as its leaf's epochs take it."""
    return apply(docs, mix).where("copies > 0").withColumn("copy", F.explode(F.sequence(F.lit(1), "copies"))).select(docs.columns)


def op3_mixing(spark, sf_dir: str) -> DataFrame:
    """Every document of `documents` with how often it is taken."""
    return apply(spark.read.parquet(f"{sf_dir}/documents.parquet")).select("doc_id", "domain", "lang", "source", "n_tokens", "budget", "copies")
