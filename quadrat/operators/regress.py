"""Boosted regressions of list lengths and of single edits, fitted on a bounded sample of training surveys."""

from __future__ import annotations

from pyspark.ml.feature import VectorAssembler
from pyspark.ml.regression import GBTRegressor
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

#: Training surveys that a regression is fitted on, chosen by hash.
SURVEYS = 4_000


def sampled(surveys: DataFrame, most: int = SURVEYS) -> DataFrame:
    """At most ``most`` of the given survey ids, by hash."""
    return surveys.select("survey").distinct().orderBy(F.xxhash64("survey"), "survey").limit(most)


def fitted(rows: DataFrame, columns: list[str], label: str, weight: str | None = None, trees: int = 20, depth: int = 4):
    """A function that adds ``predicted`` to rows with the same columns; without training rows it adds 0."""
    from quadrat.sources.shared import written

    assembler = VectorAssembler(inputCols=columns, outputCol="_x")
    own = written(assembler.transform(rows).select("_x", F.col(label).cast("double").alias("_y"), (F.col(weight) if weight else F.lit(1.0)).alias("_w")), "regression")
    if own.isEmpty():
        return lambda more: more.withColumn("predicted", F.lit(0.0))
    model = GBTRegressor(featuresCol="_x", labelCol="_y", predictionCol="predicted", weightCol="_w", maxIter=trees, maxDepth=depth, stepSize=0.1, seed=7, minInstancesPerNode=5).fit(own)
    return lambda more: model.transform(assembler.transform(more)).drop("_x")


COUNT_COLUMNS = ["total", "top", "mean", "spread", "sum5", "sum10", "sum20", "sum40", "distance", "lat", "lon", "season"]


def count_columns(ranking: DataFrame, p: str, surveys: DataFrame) -> DataFrame:
    """survey and twelve label-free columns: sums of its ranked probabilities, and its place and season (distance, lat, lon, season)."""
    upto = lambda k: F.sum(F.when(F.col("rank") <= k, F.col(p)).otherwise(0.0))
    best = F.when(F.col("rank") <= 40, F.col(p))
    g = ranking.groupBy("survey").agg(F.sum(p).alias("total"), F.max(p).alias("top"), F.avg(best).alias("mean"), F.stddev_pop(best).alias("spread"), *[upto(k).alias(f"sum{k}") for k in (5, 10, 20, 40)])
    return g.join(surveys.select("survey", "distance", "lat", "lon", "season"), "survey")


def edit_targets(candidates: DataFrame, base: str, truth: DataFrame) -> DataFrame:
    """``candidates`` (survey, species, ``base`` 0/1) with ``target``: 100 times the change of F1 if the candidate alone went in or out, and ``share``, one over the survey's candidates."""
    mine = Window.partitionBy("survey")
    marked = candidates.join(truth.select("survey", "species", F.lit(1).alias("_y")), ["survey", "species"], "left").na.fill(0, ["_y"])
    sizes = truth.groupBy("survey").agg(F.count("*").alias("_truth"))
    full = marked.join(sizes, "survey", "left").na.fill(0, ["_truth"])
    tp, size = F.sum(F.col(base) * F.col("_y")).over(mine), F.sum(base).over(mine) + F.col("_truth")
    change = F.when(F.col(base) == 1, -1).otherwise(1)
    gain = 2 * (tp + change * F.col("_y")) / (size + change) - 2 * tp / size
    return full.withColumn("target", 100 * gain).withColumn("share", 1 / F.count("*").over(mine)).drop("_y", "_truth")
