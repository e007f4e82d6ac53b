"""Multi-label metrics over long truth and predictions, and the reports made of them."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def f1(tp: Column, fp: Column, fn: Column) -> Column:
    return 2 * tp / F.greatest(2 * tp + fp + fn, F.lit(1)).cast("double")


def confusion(truth: DataFrame, predicted: DataFrame, by: str) -> DataFrame:
    """tp, fp, fn of each value of ``by`` (survey or species) that truth or predictions hold."""
    both = truth.select("survey", "species").withColumn("_t", F.lit(1)).join(predicted.select("survey", "species").withColumn("_p", F.lit(1)), ["survey", "species"], "full")
    return both.groupBy(by).agg(
        F.count_if(F.col("_t").isNotNull() & F.col("_p").isNotNull()).alias("tp"),
        F.count_if(F.col("_t").isNull()).alias("fp"),
        F.count_if(F.col("_p").isNull()).alias("fn"),
    )


def survey_f1(surveys: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """tp, fp, fn and f1 of every survey; one without labels and predictions scores 0."""
    c = surveys.select("survey").join(confusion(truth, predicted, "survey"), "survey", "left").na.fill(0, ["tp", "fp", "fn"])
    return c.withColumn("f1", f1(F.col("tp"), F.col("fp"), F.col("fn")))


def summary(surveys: DataFrame, vocabulary: DataFrame, truth: DataFrame, predicted: DataFrame) -> DataFrame:
    """One row: sample, micro and macro F1, micro precision and recall, and how many species are predicted."""
    per_survey = survey_f1(surveys, truth, predicted).agg(F.avg("f1").alias("sample_f1"))
    species = vocabulary.select("species").join(confusion(truth, predicted, "species"), "species", "left").na.fill(0, ["tp", "fp", "fn"])
    tp, fp, fn = (F.sum(c) for c in ("tp", "fp", "fn"))
    total = species.agg(
        f1(tp, fp, fn).alias("micro_f1"),
        (tp / F.greatest(tp + fp, F.lit(1))).alias("precision"),
        (tp / F.greatest(tp + fn, F.lit(1))).alias("recall"),
        F.avg(f1(F.col("tp"), F.col("fp"), F.col("fn"))).alias("macro_f1"),
        F.count_if(F.col("tp") + F.col("fp") > 0).alias("species_predicted"),
    )
    return per_survey.join(F.broadcast(total), F.lit(True))


def frequency_baseline(pairs: DataFrame, in_train: Column) -> DataFrame:
    """Predict the k most frequent training species for every validation survey; k is the mean training cardinality.

    One row of counts and scores.  Macro F1 is the mean over species that validation surveys have; those that are not
    predicted count as 0.
    """
    train, valid = pairs.where(in_train), pairs.where(~in_train)
    sizes = train.groupBy("survey").agg(F.count("*").alias("n"))
    frequency = train.groupBy("species").agg(F.count("*").alias("n"))
    k = sizes.agg(F.avg("n").alias("train_mean_labels"), F.count("*").alias("train_surveys")).join(F.broadcast(frequency.agg(F.count("*").alias("train_species"))), F.lit(True))
    k = k.withColumn("k", F.least(F.greatest(F.rint("train_mean_labels"), F.lit(1.0)), "train_species").cast("int"))
    wanted = k.first()["k"] or 0
    top = frequency.orderBy(F.desc("n"), "species").limit(wanted).select("species", F.lit(1).alias("hit"))
    per = valid.join(top, "species", "left").groupBy("survey").agg(F.count("*").alias("truth"), F.count("hit").alias("hits"))
    report = per.agg(
        F.count("*").alias("validation_surveys"), F.sum("truth").alias("actual"), F.sum("hits").alias("hits"),
        F.avg(2 * F.col("hits") / F.greatest(F.col("truth") + F.lit(wanted), F.lit(1))).alias("sample_f1"),
    )
    seen = valid.groupBy("species").agg(F.count("*").alias("n")).join(top, "species", "left").join(frequency.select("species", F.lit(1).alias("known")), "species", "left")
    macro = seen.join(F.broadcast(report.select("validation_surveys")), F.lit(True)).agg(
        F.count("*").alias("validation_species"), F.count_if(F.col("known").isNull()).alias("unseen_species"),
        F.avg(F.when(F.col("hit") == 1, 2 * F.col("n") / (F.col("validation_surveys") + F.col("n"))).otherwise(0.0)).alias("macro_f1"),
    )
    out = report.join(F.broadcast(k), F.lit(True)).join(F.broadcast(macro), F.lit(True)).withColumn("predicted", F.col("validation_surveys") * F.col("k"))
    over = lambda a, b: F.round(a / F.greatest(b, F.lit(1)), 6)
    return out.select(
        "train_surveys", "validation_surveys", "train_species", "validation_species", "unseen_species", F.round("train_mean_labels", 6).alias("train_mean_labels"), "k",
        over(2 * F.col("hits"), F.col("predicted") + F.col("actual")).alias("micro_f1"), F.round("sample_f1", 6).alias("sample_f1"), F.round("macro_f1", 6).alias("macro_f1"),
        over(F.col("hits"), F.col("predicted")).alias("precision"), over(F.col("hits"), F.col("actual")).alias("recall"), "hits", "predicted", "actual",
    )


def oracle_counts(ranked: DataFrame, low: int, high: int) -> DataFrame:
    """For each survey the list length in low..high with the best F1 along the ranking (survey, rank, hit, truth)."""
    along = Window.partitionBy("survey").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    hits = ranked.withColumn("hits", F.sum("hit").over(along)).where(F.col("rank").between(low, high))
    score = 2 * F.col("hits") / F.greatest(F.col("rank") + F.col("truth"), F.lit(1))
    best = F.max(F.struct(score.alias("f1"), (-F.col("rank")).alias("minus"))).alias("best")
    return hits.groupBy("survey").agg(best).select("survey", (-F.col("best.minus")).alias("k"), F.col("best.f1").alias("f1"))


def block_bootstrap(blocks: DataFrame, iterations: int, seed: int, digits: int | None = 6) -> DataFrame:
    """Mean gain and its 95 % interval, drawing blocks (block, total, n) with replacement by a hash of draw and place.

    ``blocks`` is an aggregate with a row for each block, written once; what grows is draws x blocks, summed before
    anything is gathered.
    """
    from quadrat.operators.labels import dense_index
    from quadrat.operators.stats import draw_place
    from quadrat.sources.shared import written

    blocks = written(blocks, "blocks")
    placed = written(blocks.join(dense_index(blocks, "block", "place"), "block"), "placed")
    size = blocks.agg(F.count("*").alias("size"))
    slots = placed.select("place").join(F.broadcast(size), F.lit(True)).withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    drawn = slots.select("draw", draw_place(F.col("draw").cast("long"), F.col("place"), seed, F.col("size")).alias("place")).join(placed, "place")
    means = drawn.groupBy("draw").agg((F.sum("total") / F.sum("n")).alias("mean"))
    low_high = means.agg(F.percentile("mean", F.array(F.lit(0.025), F.lit(0.975))).alias("q"))
    whole = blocks.agg((F.sum("total") / F.sum("n")).alias("mean"))
    kept = lambda c: F.round(c, digits) if digits is not None else c
    return whole.join(F.broadcast(low_high), F.lit(True)).select(kept(F.col("mean")).alias("mean"), kept(F.col("q")[0]).alias("low"), kept(F.col("q")[1]).alias("high"))
