"""The application of cut policies, the robust choice among policies, checkpoints."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.sources.shared import written


def applied(ranking: DataFrame, policies: DataFrame, p: str = "p", most: int = 50) -> DataFrame:
    """survey, species, rank and the policy's columns: rankings (survey, species, rank, p) cut by each policy of ``policies``.

    The kind decides: the first k, or those that reach the threshold, at least minimum_k and at most maximum_k.  Policies
    are a table of fixed size, and a ranking is not longer than any of them can take.
    """
    top = F.col("rank") <= F.col("k")
    reached = (F.col("rank") <= F.col("minimum_k")) | ((F.col(p) >= F.col("threshold")) & (F.col("rank") <= F.col("maximum_k")))
    return ranking.where(F.col("rank") <= most).join(F.broadcast(policies), F.when(F.col("kind") == "top_k", top).otherwise(reached))


def policy_f1(ranking: DataFrame, truth: DataFrame | None, policies: DataFrame, surveys: DataFrame, by: list[str], p: str = "p", most: int = 50, control: int | None = None) -> DataFrame:
    """survey, ``by`` columns of ``surveys``, place and f1 of every policy, with ``own``, that of ``control``, if it is given.

    A policy's list is a prefix of the ranking, so its length and hits are read off running sums, one pass for all.  Without
    ``truth`` the ranking says itself which members are labels (``hit``) and how many the survey has (``truth``).
    """
    along = Window.partitionBy("survey").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    marked = ranking.where(F.col("rank") <= most)
    if truth is not None:
        marked = marked.join(truth.select("survey", "species", F.lit(1).alias("hit")), ["survey", "species"], "left").na.fill(0, ["hit"])
    size = F.lit(0) if truth is not None else F.max("truth")
    members = F.sort_array(F.collect_list(F.struct("rank", F.col(p).alias("p"), "_hits")))
    lists = marked.withColumn("_hits", F.sum("hit").over(along)).groupBy("survey").agg(members.alias("_l"), size.alias("_truth"))
    rows = surveys.select("survey", *by).join(lists, "survey")
    if truth is not None:
        rows = rows.drop("_truth").join(truth.groupBy("survey").agg(F.count("*").alias("_truth")), "survey", "left").na.fill(0, ["_truth"])

    def f1(kind: Column, k: Column, threshold: Column, least: Column, top: Column) -> Column:
        above = F.size(F.filter("_l", lambda e: e["p"] >= threshold))
        n = F.least(F.when(kind == "top_k", k).otherwise(F.greatest(least, F.least(above, top))), F.size("_l"))
        return 2 * F.coalesce(F.get("_l", n - 1)["_hits"], F.lit(0)) / F.greatest(n + F.col("_truth"), F.lit(1))

    fields = ["kind", "k", "threshold", "minimum_k", "maximum_k"]
    if control is not None:
        own = policies.where(F.col("place") == control).first()
        rows = rows.withColumn("own", f1(*[F.lit(own[c]).cast(policies.schema[c].dataType) for c in fields]))
    each = rows.join(F.broadcast(policies), F.lit(True))
    return each.select("survey", *by, "place", f1(*map(F.col, fields)).alias("f1"), *([] if control is None else ["own"]))


def robust_choice(each: DataFrame, control: int, fold: str, group: str, block: str, least: int = 30, weights: tuple[float, float, float] = (0.5, 0.25, 0.25)) -> DataFrame:
    """One row a policy: gains over the control, robust gain, whether it is allowed, and its place in the choice.

    ``each`` has survey, place, f1 and the fold, group and block of the survey, and may have ``own``, the survey's f1 of the
    control.  Sums by policy, fold, group and block serve all means.  The robust gain weighs the mean over
    surveys, over groups of at least ``least`` and over blocks.  Allowed are the control and what gains in every fold and
    robustly; of equals the policy that comes first is chosen.
    """
    if "own" not in each.columns:
        each = each.join(each.where(F.col("place") == control).select("survey", F.col("f1").alias("own")), "survey")
    sums = each.groupBy("place", *dict.fromkeys([fold, group, block])).agg(F.sum("f1").alias("_f"), F.sum(F.col("f1") - F.col("own")).alias("_g"), F.count("*").alias("_c"))
    delta = written(sums, "gains")  # read for each mean
    mean = lambda c: F.sum(c) / F.sum("_c")
    pooled = delta.groupBy("place").agg(mean("_f").alias("f1"), mean("_g").alias("gain"))
    folds = delta.groupBy("place", fold).agg(mean("_g").alias("_d")).groupBy("place").agg(F.min("_d").alias("worst_fold"))
    groups = delta.groupBy("place", group).agg(mean("_g").alias("_d"), F.sum("_c").alias("_n")).where(F.col("_n") >= least).groupBy("place").agg(F.avg("_d").alias("group_gain"))
    blocks = delta.groupBy("place", block).agg(mean("_g").alias("_d")).groupBy("place").agg(F.avg("_d").alias("block_gain"))
    full = pooled.join(folds, "place").join(groups, "place", "left").join(blocks, "place").na.fill(0.0, ["group_gain"])
    robust = F.round(weights[0] * F.col("gain") + weights[1] * F.col("group_gain") + weights[2] * F.col("block_gain"), 9)
    allowed = (F.col("place") == control) | ((F.round("worst_fold", 9) > 0) & (robust > 0))
    order = Window.orderBy(F.desc("allowed"), F.desc("robust"), "place")  # a row a policy
    return full.withColumn("robust", robust).withColumn("allowed", allowed).withColumn("choice", F.row_number().over(order))


def checkpoint_score(each: DataFrame, group: str, outside: Column, least: int = 30) -> DataFrame:
    """One row: .5 mean f1 + .25 mean over groups of at least ``least`` + .25 mean of the surveys ``outside``.

    A part without groups or surveys is the mean of all.
    """
    pooled = each.agg(F.avg("f1").alias("pooled"), F.avg(F.when(outside, F.col("f1"))).alias("outside"))
    macro = each.groupBy(group).agg(F.avg("f1").alias("f1"), F.count("*").alias("n")).where(F.col("n") >= least).agg(F.avg("f1").alias("macro"))
    full = pooled.join(F.broadcast(macro), F.lit(True)).select("pooled", *[F.coalesce(c, "pooled").alias(c) for c in ("macro", "outside")])
    score = 0.5 * F.col("pooled") + 0.25 * F.col("macro") + 0.25 * F.col("outside")
    return full.select("pooled", "macro", "outside", score.alias("score"))
