"""The second stage: a shallow forest learns net effects by horizon, and is judged on pairs it has not seen, beside the mean of the others."""

from __future__ import annotations

from functools import reduce

from pyspark.ml import Pipeline, PipelineModel
from pyspark.ml.feature import Imputer, OneHotEncoder, StringIndexer, VectorAssembler
from pyspark.ml.regression import RandomForestRegressor
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from sitelens.operators.storage import drop, numbered, settle

# Horizons that are learned, and a forest kept shallow as samples are small.
HORIZONS, DEPTH, LEAF, TREES, SEED = (0, 1, 2), 3, 2, 200, 42
#: Most folds: up to so many pairs each is left out by itself, more are left out in so many groups.
FOLDS = 64


def folds(rows: DataFrame, pair: str, most: int = FOLDS) -> DataFrame:
    """rows with fold: the number of their pair, in order; beyond `most` pairs, numbers start again. All rows of a pair are in one fold; rows without pair are left out."""
    pairs = numbered(rows.where(F.col(pair).isNotNull()).select(F.col(pair).alias("_pair")).distinct(), ["_pair"], "_n")
    return rows.join(pairs.select("_pair", F.pmod("_n", F.lit(most)).cast("int").alias("fold")), F.col(pair) == F.col("_pair")).drop("_pair")


def naive(rows: DataFrame, by: list[str], target: str) -> DataFrame:
    """rows (with fold) and ingenuo: the mean target of the group in all other folds, from exact sums; null where there are none."""
    exact = F.sum(F.col(target).cast("decimal(28,6)"))
    own = rows.groupBy(*by, "fold").agg(exact.alias("_s"), F.count(target).alias("_n"))
    every = own.groupBy(*by).agg(F.sum("_s").alias("_all"), F.sum("_n").alias("_every"))
    rest = own.join(every, by).withColumn("ingenuo", F.try_divide((F.col("_all") - F.coalesce("_s", F.lit(0))).cast("double"), (F.col("_every") - F.col("_n")).cast("double")))
    return rows.join(rest.select(*by, "fold", "ingenuo"), [*by, "fold"])


def pipeline(numbers: list[str], categories: list[str], target: str, trees: int = TREES, depth: int = DEPTH, leaf: int = LEAF, seed: int = SEED) -> Pipeline:
    """Medians for missing numbers, one column for each category (an unknown one has its own), and the forest."""
    steps = [Imputer(strategy="median", inputCols=numbers, outputCols=[f"_{c}" for c in numbers])]
    if categories:
        steps += [StringIndexer(inputCols=categories, outputCols=[f"_i_{c}" for c in categories], handleInvalid="keep"), OneHotEncoder(inputCols=[f"_i_{c}" for c in categories], outputCols=[f"_{c}" for c in categories], dropLast=False)]
    forest = RandomForestRegressor(featuresCol="_features", labelCol=target, predictionCol="previsto", numTrees=trees, maxDepth=depth, minInstancesPerNode=leaf, seed=seed)
    return Pipeline(stages=[*steps, VectorAssembler(inputCols=[f"_{c}" for c in [*numbers, *categories]], outputCol="_features"), forest])


def fitted(rows: DataFrame, numbers: list[str], categories: list[str], target: str, **options) -> PipelineModel:
    """The model of all rows that have a target."""
    return pipeline(numbers, categories, target, **options).fit(rows.where(F.col(target).isNotNull()))


def left_out(rows: DataFrame, by: list[str], numbers: list[str], categories: list[str], target: str, pair: str, most: int = FOLDS, **options) -> DataFrame:
    """rows that have a target, each with what a model of all other folds expects of it (previsto), and the mean of these (ingenuo).

    One forest is grown for each fold, so as many as pairs, up to `most`. The same rows, seed and number of shuffle partitions give the same forests: rows are dealt by a
    hash and sorted. A number that no row of the others has is 0. With fewer than two folds there is nothing to learn from, and previsto is null.
    """
    known = rows.where(F.col(target).isNotNull()).withColumns({c: F.col(c).cast("double") for c in [*numbers, target]} | {c: F.coalesce(F.nullif(F.col(c).cast("string"), F.lit("")), F.lit("sem valor")) for c in categories})
    dealt = naive(folds(known, pair, most), by, target)
    keys = [pair, *by, *numbers, target]
    table = settle(dealt.repartition(*keys).sortWithinPartitions(*keys))
    names = sorted(r.fold for r in table.select("fold").distinct().collect())
    if len(names) < 2:
        return table.withColumn("previsto", F.lit(None).cast("double"))
    out = []
    for fold in names:
        others = table.where(F.col("fold") != fold)
        some = others.agg(*[F.count(c).alias(c) for c in numbers]).first()
        fill = {c: 0.0 for c in numbers if not some[c]}
        model = fitted(others.fillna(fill) if fill else others, numbers, categories, target, **options)
        mine = table.where(F.col("fold") == fold)
        out.append(model.transform(mine.fillna(fill) if fill else mine).select(*table.columns, "previsto"))
    found = settle(reduce(DataFrame.unionAll, out))
    drop(table)
    return found


def errors(found: DataFrame, by: list[str], target: str) -> DataFrame:
    """By group the mean absolute errors of the model and of the naive mean, and the share of rows the model is nearer to."""
    off = lambda c: F.abs(F.col(c) - F.col(target))
    mean = lambda c: F.try_divide(F.sum(c.cast("decimal(28,6)")).cast("double"), F.count(c).cast("double"))
    return found.groupBy(*by).agg(F.count("*").alias("n"), mean(off("previsto")).alias("erro"), mean(off("ingenuo")).alias("erro_ingenuo"), F.avg((off("previsto") < off("ingenuo")).cast("double")).alias("melhor"))
