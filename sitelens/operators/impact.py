"""Panels of treated and control sites over years: baselines, differences, event studies and net effects.

A panel has site, tipo (tratamento or controle), pair, h (years since the event) and one column per variable.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from sitelens.functions.values import exact_avg


def baseline(panel: DataFrame, variables: list[str]) -> DataFrame:
    """One row per site: that of its last year before the event, or of its first year if there is none."""
    before = F.col("h") < 0
    rank = F.struct(before.cast("int").alias("pre"), F.when(before, F.col("h")).otherwise(-F.col("h")).alias("near"))
    values = F.struct("h", *variables)
    best = panel.where("site is not null").groupBy("site").agg(F.max_by(values, rank).alias("b"))
    return best.select("site", F.col("b.h").alias("base_h"), *[F.col(f"b.{v}").alias(f"base_{v}") for v in variables])


def deltas(panel: DataFrame, variables: list[str]) -> DataFrame:
    """The panel with base_h and delta_<variable>: what each row differs from its site's baseline. One pass over the panel, by site."""
    before = F.col("h") < 0
    rank = F.struct(before.cast("int").alias("pre"), F.when(before, F.col("h")).otherwise(-F.col("h")).alias("near"))
    base = F.max_by(F.struct("h", *variables), rank).over(Window.partitionBy("site"))
    out = panel.where("site is not null").withColumn("_base", base).withColumn("base_h", F.col("_base.h"))
    return out.withColumns({f"delta_{v}": F.col(v) - F.col(f"_base.{v}") for v in variables}).drop("_base")


def means(rows: DataFrame, by: list[str], columns: list[str]) -> DataFrame:
    """Exact means of columns by group; groups of null keys are left out."""
    known = reduce(lambda a, b: a & b, [F.col(k).isNotNull() for k in by])
    return rows.where(known).groupBy(*by).agg(*[exact_avg(F.col(c)).alias(c) for c in columns])


def transposed(rows: DataFrame, by: str, columns: list[str], groups: list[str], digits: int) -> DataFrame:
    """One row for each column, as `variavel`, with its rounded value in each group, as in a report's table; null for a group that is missing. rows has one row for each group."""
    each = rows.select(by, F.explode(F.array(*[F.struct(F.lit(c).alias("variavel"), F.col(c).cast("double").alias("v")) for c in columns])).alias("e"))
    return each.groupBy("e.variavel").agg(*[F.round(F.max(F.when(F.col(by) == g, F.col("e.v"))), digits).alias(g) for g in groups])


def did(rows: DataFrame, variables: list[str]) -> DataFrame:
    """Difference in differences of each variable, (T pos - T pre) - (C pos - C pre); null if a cell is missing."""
    cell = lambda v, t, p: exact_avg(F.when((F.col("tipo") == t) & (F.col("fase") == p), F.col(v)))
    out = [(cell(v, "tratamento", "pos") - cell(v, "tratamento", "pre")) - (cell(v, "controle", "pos") - cell(v, "controle", "pre")) for v in variables]
    return long(rows.agg(*[x.alias(v) for x, v in zip(out, variables)]), [], variables, "did")


def long(rows: DataFrame, keep: list[str], columns: list[str], value: str) -> DataFrame:
    """One row per row and column: keep, variavel and the value."""
    return rows.unpivot([F.col(k) for k in keep], [F.col(c) for c in columns], "variavel", value)


def net_effect(panel: DataFrame, variables: list[str]) -> DataFrame:
    """pair, h, variavel, efeito: delta of the treated minus the mean delta of the pair's controls, where both are."""
    mean = lambda v, t: exact_avg(F.when(F.col("tipo") == t, F.col(f"delta_{v}")))
    some = [F.count(F.when(F.col("tipo") == t, 1)).alias(f"_{t}") for t in ("tratamento", "controle")]
    rows = deltas(panel, variables).where("pair is not null and h is not null").groupBy("pair", "h").agg(*[(mean(v, "tratamento") - mean(v, "controle")).alias(v) for v in variables], *some)
    return long(rows.where("_tratamento > 0 and _controle > 0"), ["pair", "h"], variables, "efeito")


def spread(c: Column) -> Column:
    """Sample standard deviation from exact sums; null for fewer than two values."""
    n, s, q = F.count(c).cast("double"), F.sum(c.cast("decimal(28,6)")).cast("double"), F.sum((c * c).cast("decimal(38,6)")).cast("double")
    return F.when(n > 1, F.sqrt(F.greatest(F.lit(0.0), F.try_divide(q - F.try_divide(s * s, n), n - F.lit(1.0)))))


def curve(effects: DataFrame) -> DataFrame:
    """By variable and horizon: mean, median, sample deviation, number of pairs and standard error."""
    out = effects.groupBy("variavel", "h").agg(exact_avg(F.col("efeito")).alias("media"), F.median("efeito").alias("mediana"), spread(F.col("efeito")).alias("desvio_padrao"), F.count("efeito").alias("n_pares"))
    return out.withColumn("erro_padrao", F.col("desvio_padrao") / F.sqrt(F.nullif("n_pares", F.lit(0)).cast("double")))


def slope(rows: DataFrame, by: str, x: str, y: str) -> DataFrame:
    """Least-squares slope per group from exact sums; null for fewer than two rows or one x."""
    d = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    both = rows.where(F.col(x).isNotNull() & F.col(y).isNotNull())
    sums = both.groupBy(by).agg(F.count("*").cast("double").alias("n"), d(F.col(x)).alias("sx"), d(F.col(y)).alias("sy"), d(F.col(x) * F.col(y)).alias("sxy"), d(F.col(x) * F.col(x)).alias("sxx"))
    return sums.select(by, F.expr("try_divide(n * sxy - sx * sy, n * sxx - sx * sx)").alias("slope"))


def correlations(rows: DataFrame, columns: list[str]) -> DataFrame:
    """a, b, r for all pairs of columns, over rows where both are known; null where one is constant.

    One aggregation: each pair once, and sums that pairs share (those of columns without nulls) once.
    """
    holes = rows.agg(*[F.count(F.when(F.col(c).isNull(), 1)).alias(c) for c in columns]).first()
    known = {c: None if not holes[c] else F.col(c).isNotNull() for c in columns}
    d = lambda c: F.sum(c.cast("decimal(38,6)")).cast("double")
    r = {}
    for k, a in enumerate(columns):
        for b in columns[k:]:
            both = [x for x in {a: known[a], b: known[b]}.values() if x is not None]
            x, y = (F.when(reduce(lambda p, q: p & q, both), F.col(c)) if both else F.col(c) for c in (a, b))
            n = F.count(x).cast("double") if both else F.count("*").cast("double")
            top = n * d(x * y) - d(x) * d(y)
            low = F.sqrt(n * d(x * x) - d(x) * d(x)) * F.sqrt(n * d(y * y) - d(y) * d(y))
            r[a, b] = r[b, a] = F.try_divide(top, low)
    wide = rows.agg(*[r[a, b].alias(f"{k}_{j}") for k, a in enumerate(columns) for j, b in enumerate(columns) if k <= j])
    picks = [F.struct(F.lit(a).alias("a"), F.lit(b).alias("b"), F.col(f"{min(k, j)}_{max(k, j)}").alias("r")) for k, a in enumerate(columns) for j, b in enumerate(columns)]
    return wide.select(F.inline(F.array(*picks)))


def null_shares(rows: DataFrame, top: int = 15) -> DataFrame:
    """Percentage of nulls by column, the greatest first."""
    share = [(F.sum(F.col(c).isNull().cast("int")).cast("double") * F.lit(100.0) / F.count("*")).alias(c) for c in rows.columns]
    return long(rows.agg(*share), [], rows.columns, "pct_null").orderBy(F.desc("pct_null"), "variavel").limit(top)


def change_points(series: DataFrame, entity: str, year: str, value: str, side: int = 2, least: float = 0.0) -> DataFrame:
    """For each entity the first year of the greatest rise of means, with at least `side` years on either side.

    The year is null where the step is below `least`; the step stays. Entities without enough years have both null.
    """
    w = Window.partitionBy(entity).orderBy(year)
    known = series.where(F.col(value).isNotNull()).withColumn("_v", F.col(value).cast("decimal(28,6)"))
    run = known.select(entity, year, F.row_number().over(w).alias("rn"), F.count("*").over(Window.partitionBy(entity)).alias("n"), F.sum("_v").over(w.rowsBetween(Window.unboundedPreceding, -1)).alias("s"), F.sum("_v").over(Window.partitionBy(entity)).alias("t"))
    step = (F.col("t") - F.col("s")).cast("double") / (F.col("n") - F.col("rn") + 1) - F.col("s").cast("double") / (F.col("rn") - 1)
    found = run.where((F.col("rn") > side) & (F.col("n") - F.col("rn") + 1 >= side)).withColumn("step", step)
    best = found.groupBy(entity).agg(F.max_by(F.struct("step", F.col(year).alias("ano")), F.struct("step", (-F.col(year)).alias("o"))).alias("b"))
    out = series.select(entity).distinct().join(best, entity, "left")
    return out.select(entity, F.when(F.col("b.step") >= least, F.col("b.ano")).alias("ano_degrau"), F.col("b.step").alias("degrau")).withColumn("situacao", F.when(F.col("ano_degrau").isNotNull(), "datado").otherwise("sem_degrau"))


def allocate(parts: DataFrame, totals: DataFrame, group: list[str], weight: str, total: str) -> DataFrame:
    """Each part's share of its group's total by weight; shares are of all parts, groups without total are left out."""
    sums = parts.groupBy(*group).agg(F.sum(F.col(weight).cast("decimal(38,6)")).cast("double").alias("_w"))
    joined = parts.join(sums, group).join(totals, group)
    return joined.withColumn("share", F.try_divide(F.col(weight).cast("double"), F.col("_w"))).withColumn("allocated", F.col("share") * F.col(total)).drop("_w")


def majority(rows: DataFrame, by: str, choice: str) -> DataFrame:
    """The most frequent choice of each group; ties go to the least."""
    counts = rows.groupBy(by, choice).agg(F.count("*").alias("n"))
    return counts.groupBy(by).agg(F.min_by(F.struct(choice, "n"), F.struct((-F.col("n")).alias("o"), choice)).alias("b")).select(by, f"b.{choice}", "b.n")


def first_wins(rows: DataFrame, key: str, order: list[str]) -> DataFrame:
    """The first row of each key in the given order."""
    return rows.groupBy(key).agg(F.min_by(F.struct(*[c for c in rows.columns if c != key]), F.struct(*order)).alias("b")).select(key, "b.*")


def inherit(rows: DataFrame, pair: str, columns: list[str]) -> DataFrame:
    """Controls take blank context columns from their pair's treated row."""
    source = rows.where("tipo = 'tratamento'").groupBy(pair).agg(*[F.max(c).alias(f"_t_{c}") for c in columns])
    joined = rows.join(source, pair, "left")
    filled = {c: F.when((F.col("tipo") == "controle") & (F.col(c).isNull() | (F.trim(F.col(c)) == "")), F.col(f"_t_{c}")).otherwise(F.col(c)) for c in columns}
    return joined.withColumns(filled).drop(*[f"_t_{c}" for c in columns])
