"""Rankings, list lengths, fusion and bounded edits of ranked lists.

Ties everywhere go to the smaller species.  A ranking is long: survey, species, score and rank from 1.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def ranked(scored: DataFrame, score: str = "score", most: int | None = None) -> DataFrame:
    """``scored`` with ``rank`` within the survey by (score desc, species), the best ``most`` only if given."""
    out = scored.withColumn("rank", F.row_number().over(Window.partitionBy("survey").orderBy(F.desc(score), "species")))
    return out if most is None else out.where(F.col("rank") <= most)


def ranked_by(scored: DataFrame, *scores: str) -> DataFrame:
    """``scored`` with ``rank_<score>`` for each score: several rankings of a survey over one partitioning."""
    return scored.withColumns({f"rank_{c}": F.row_number().over(Window.partitionBy("survey").orderBy(F.desc(c), "species")) for c in scores})


def compact(scored: DataFrame, score: str, most: int) -> DataFrame:
    """One row a survey: arrays of species and of scores, best first."""
    best = ranked(scored, score, most)
    both = F.sort_array(F.collect_list(F.struct("rank", "species", F.col(score).alias("score"))))
    return best.groupBy("survey").agg(both.alias("b")).select("survey", F.col("b.species").alias("species"), F.col("b.score").alias("scores"))


def thresholded(ranking: DataFrame, score: str, threshold: float, least: int, most: int) -> DataFrame:
    """At least ``least``, at most ``most`` and between them those that reach the threshold."""
    return ranking.where((F.col("rank") <= least) | ((F.col(score) >= threshold) & (F.col("rank") <= most)))


def expected_f1_counts(ranking: DataFrame, p: str, low: int, high: int, scale: float = 1.0) -> DataFrame:
    """For each survey the length k in low..high with the largest 2 S_k / (k + scale * S), first of equals."""
    along = Window.partitionBy("survey").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    total = ranking.groupBy("survey").agg(F.sum(p).alias("_all"))
    upto = ranking.withColumn("_upto", F.sum(p).over(along)).where(F.col("rank").between(low, high)).join(total, "survey")
    value = F.round(2 * F.col("_upto") / (F.col("rank") + scale * F.col("_all")), 9)
    best = F.max(F.struct(value.alias("v"), (-F.col("rank")).alias("minus"))).alias("best")
    return upto.groupBy("survey").agg(best).select("survey", (-F.col("best.minus")).alias("k"), F.col("best.v").alias("expected"))


def adaptive_count(log_richness: Column, factor: float, low: int, high: int) -> Column:
    """clip(round half even(expm1(log richness) * factor), low, high)."""
    return F.least(F.greatest(F.rint(F.expm1(log_richness) * factor), F.lit(float(low))), F.lit(float(high))).cast("int")


def mixed(base: Column, expert: Column, alpha: float, gate: Column) -> Column:
    """(1 - alpha gate) base + alpha gate expert; the base itself where alpha is 0."""
    if not alpha:
        return base
    return (1 - alpha * gate) * base + alpha * gate * expert


def log_ramp(value: Column, full: float) -> Column:
    """log1p(value) / log(full), between 0 and 1."""
    return F.least(F.greatest(F.log1p(value) / F.log(F.lit(full)), F.lit(0.0)), F.lit(1.0))


def fused(rankings: list[tuple[DataFrame, float]], decay: float) -> DataFrame:
    """Sum over rankings of weight / (decay + rank), as survey, species, score; rankings of weight 0 are not read."""
    from functools import reduce

    parts = [r.select("survey", "species", (F.lit(w) / (decay + F.col("rank"))).alias("score")) for r, w in rankings if w]
    return reduce(DataFrame.unionByName, parts).groupBy("survey", "species").agg(F.sum("score").alias("score"))


def fused_ranks(ranks: DataFrame, weights: dict[str, float], decay: float, most: int) -> DataFrame:
    """survey, species, score of rows whose rank columns are known: the sum of weight / (decay + rank) over ranks up to ``most``."""
    from functools import reduce
    from operator import add

    part = [F.when(F.col(c) <= most, w / (decay + F.col(c))).otherwise(0.0) for c, w in weights.items() if w]
    return ranks.where(reduce(lambda a, b: a | b, [F.col(c) <= most for c, w in weights.items() if w])).withColumn("score", reduce(add, part))


def with_quotas(ranking: DataFrame, quotas: dict[str, int], new: str) -> DataFrame:
    """The ranking without new candidates of a class (column -> quota) beyond the class's quota, ranked again.

    Within a class the first ``quota`` new candidates by rank stay, which is what skipping along the ranking gives.
    """
    out = ranking
    for flag, quota in quotas.items():
        own = F.col(flag) & F.col(new)
        seen = F.sum(own.cast("int")).over(Window.partitionBy("survey").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0))
        out = out.withColumn("_seen", seen).where(~own | (F.col("_seen") <= quota)).drop("_seen")
    again = F.row_number().over(Window.partitionBy("survey").orderBy("rank"))
    return out.withColumn("_new_rank", again).drop("rank").withColumnRenamed("_new_rank", "rank")


def residual_edit(base: DataFrame, outsiders: DataFrame, kept_share: float, swaps: int) -> DataFrame:
    """The base list (survey, species, rank, score) after at most ``swaps`` swaps of its tail for better outsiders.

    The first ceil(kept_share * length) stay.  The i-th worst of the tail meets the i-th best outsider; scores of the one
    rise and of the other fall with i, so stopping at the first pair without gain is a filter on pairs.
    """
    size = base.groupBy("survey").agg(F.count("*").alias("_n"))
    tail = base.join(size, "survey").where(F.col("rank") > F.ceil(F.col("_n") * kept_share))
    out_place = F.row_number().over(Window.partitionBy("survey").orderBy("score", F.desc("rank")))
    leaving = tail.select("survey", F.col("species").alias("_out"), F.col("score").alias("_low"), F.col("rank").alias("_rank"), out_place.alias("_i")).where(F.col("_i") <= swaps)
    others = outsiders.join(base.select("survey", "species"), ["survey", "species"], "left_anti")
    in_place = F.row_number().over(Window.partitionBy("survey").orderBy(F.desc("score"), "species"))
    coming = others.select("survey", F.col("species").alias("_in"), F.col("score").alias("_high"), in_place.alias("_i")).where(F.col("_i") <= swaps)
    pairs = leaving.join(coming, ["survey", "_i"]).where(F.col("_high") > F.col("_low"))
    gone = pairs.select("survey", F.col("_out").alias("species"))
    stay = base.join(gone, ["survey", "species"], "left_anti").select("survey", "species", F.lit(0).alias("_turn"), F.col("rank").alias("_at"))
    new = pairs.select("survey", F.col("_in").alias("species"), F.lit(1).alias("_turn"), F.col("_i").alias("_at"))
    order = Window.partitionBy("survey").orderBy("_turn", "_at")
    return stay.unionByName(new).select("survey", "species", F.row_number().over(order).alias("rank"))


def tail_swap(base: DataFrame, additions: DataFrame, risk: DataFrame, swaps: int, margin: float) -> DataFrame:
    """Pairs (survey, i, out, into) of the lower half's worst and the best additions that gain ``margin``, within max(1, ceil(swaps * risk))."""
    size = base.groupBy("survey").agg(F.count("*").alias("_n"))
    lower = base.join(size, "survey").where(F.col("rank") > F.floor(F.col("_n") / 2))
    worst = F.row_number().over(Window.partitionBy("survey").orderBy("score", F.desc("rank")))
    leaving = lower.select("survey", F.col("species").alias("out"), F.col("score").alias("_low"), worst.alias("i"))
    best = F.row_number().over(Window.partitionBy("survey").orderBy(F.desc("score"), "species"))
    coming = additions.join(base.select("survey", "species"), ["survey", "species"], "left_anti")
    coming = coming.select("survey", F.col("species").alias("into"), F.col("score").alias("_high"), best.alias("i"))
    budget = F.greatest(F.lit(1), F.ceil(F.lit(swaps) * F.col("risk")))
    pairs = leaving.join(coming, ["survey", "i"]).join(risk, "survey")
    return pairs.where((F.col("i") <= budget) & (F.col("_high") - F.col("_low") >= margin)).select("survey", "i", "out", "into")


def swaps(ranking: DataFrame, size: int, stay, most: int, gain) -> DataFrame:
    """survey, base (its list in order) and swaps: structs (i, out, into) of a tail with outsiders, worst with best.

    ``ranking`` (survey, species, rank, score) holds all candidates, the list being the first ``size``.  Those of a rank up to
    ``stay(n)`` of a list of n stay.  Pairs are at most ``most`` and such that ``gain(low, high)`` holds.  One grouping by survey.
    """
    inside = F.col("rank") <= size
    both = ranking.groupBy("survey").agg(F.array_sort(F.collect_list(F.when(inside, F.struct("rank", "species", "score")))).alias("_b"), F.sort_array(F.collect_list(F.when(~inside, F.struct((-F.col("score")).alias("minus"), "species")))).alias("_o"))
    tail = F.filter("_b", lambda x: x["rank"] > stay(F.size("_b")))
    out = F.slice(F.sort_array(F.transform(tail, lambda x: F.struct(x["score"].alias("score"), (-x["rank"]).alias("at"), x["species"].alias("species")))), 1, most)
    good = both.select("survey", F.col("_b.species").alias("base"), out.alias("_low"), F.slice("_o", 1, most).alias("_high"))
    shorter = F.least(F.size("_low"), F.size("_high"))
    at = lambda i: (F.get("_low", i - 1), F.get("_high", i - 1))
    pairs = F.transform(F.when(shorter > 0, F.sequence(F.lit(1), shorter)).otherwise(F.array().cast("array<int>")), lambda i: F.struct(i.alias("i"), at(i)[0]["species"].alias("out"), at(i)[1]["species"].alias("into"), at(i)[0]["score"].alias("low"), (-at(i)[1]["minus"]).alias("high")))
    return good.select("survey", "base", F.filter(pairs, lambda x: gain(x["low"], x["high"])).alias("swaps"))
