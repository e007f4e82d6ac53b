"""Validation of stored outputs: means and intervals computed again from a stored frame, and stored comparators bound to today's tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.operators.digests import ordered_digests
from quadrat.operators.stats import draw_place, numbered, quantiles

#: How far a number may lie from the one in the report.
TOLERANCE = 1e-12


def recomputed(frame: DataFrame, own: str, others: list[str], block: str, iterations: int, seed: int) -> DataFrame:
    """name, mean, low, high: the mean of each score, and for every one of ``others`` the mean and the interval of ``own`` less it.

    The interval draws blocks as ``metrics.block_bootstrap`` does, but by how often each block is drawn: the draws are counted
    before they meet the blocks' sums, and a draw is one weighted sum for all scores at once.
    """
    scores = [own, *others]
    means = frame.agg(*[(F.sum(c) / F.count(c)).alias(c) for c in scores]).select(F.explode(F.array(*[F.struct(F.lit(c).alias("name"), F.col(c).alias("mean")) for c in scores])).alias("e")).select("e.*")
    sums = frame.groupBy(block).agg(F.count("*").alias("_n"), *[F.sum(F.col(own) - F.col(c)).alias(f"_{c}") for c in others])
    placed = numbered(sums, [], [block])
    slots = placed.select("place", "total").withColumn("draw", F.explode(F.sequence(F.lit(0), F.lit(iterations - 1))))
    times = slots.groupBy("draw", draw_place(F.col("draw").cast("long"), F.col("place"), seed, F.col("total")).alias("place")).agg(F.count("*").alias("_times"))
    drawn = times.join(placed, "place").groupBy("draw").agg(*[(F.sum(F.col("_times") * F.col(f"_{c}")) / F.sum(F.col("_times") * F.col("_n"))).alias(c) for c in others])
    long = drawn.select(F.explode(F.array(*[F.struct(F.lit(f"{own}-{c}").alias("name"), F.col(c).alias("mean")) for c in others])).alias("e")).select("e.*")
    bounds = quantiles(long, ["name"], "mean", [0.025, 0.975])
    whole = frame.agg(*[(F.sum(F.col(own) - F.col(c)) / F.count("*")).alias(c) for c in others]).select(F.explode(F.array(*[F.struct(F.lit(f"{own}-{c}").alias("name"), F.col(c).alias("mean")) for c in others])).alias("e")).select("e.*")
    none = F.lit(None).cast("double")
    return means.select("name", "mean", none.alias("low"), none.alias("high")).unionByName(whole.join(bounds, "name").select("name", "mean", F.col("q")[0].alias("low"), F.col("q")[1].alias("high")))


def compared(report: DataFrame, again: DataFrame, tolerance: float = TOLERANCE) -> DataFrame:
    """name, mean, low, high of the report and whether all three are those computed again; what either side lacks does not agree."""
    both = report.select("name", F.struct("mean", "low", "high").alias("a")).join(again.select("name", F.struct("mean", "low", "high").alias("b")), "name", "full")
    agrees = F.col("a").isNotNull() & F.col("b").isNotNull()
    for c in ("mean", "low", "high"):
        a, b = F.col(f"a.{c}"), F.col(f"b.{c}")
        agrees = agrees & (a.eqNullSafe(b) | F.coalesce(F.abs(a - b) <= tolerance, F.lit(False)))
    return both.select("name", "a.mean", "a.low", "a.high", agrees.alias("agrees"))


def bindings(rows: DataFrame, labels: DataFrame, species: DataFrame) -> DataFrame:
    """name, digest, n of what a comparator depends on: its surveys by fold and role, all labels, all species."""
    ids = ordered_digests(rows.select("fold", "role", "survey"), ["fold", "role"], ["survey"], F.col("survey").cast("string"))
    named = ids.select(F.concat_ws(":", F.lit("ids"), F.col("fold").cast("string"), "role").alias("name"), "digest", "n")
    pairs = ordered_digests(labels.select("survey", "species"), [], ["survey", "species"], F.concat_ws(":", F.col("survey").cast("string"), F.col("species").cast("string")))
    words = ordered_digests(species.select("species"), [], ["species"], F.col("species").cast("string"))
    for part, name in ((pairs, "labels"), (words, "species")):
        named = named.unionByName(part.select(F.lit(name).alias("name"), "digest", "n"))
    return named


def bound(stored: DataFrame, stored_bindings: DataFrame, rows: DataFrame, labels: DataFrame, species: DataFrame) -> DataFrame:
    """name, holds: whether a stored comparator (fold, role, survey, f1) may be compared with today's tables.

    Its surveys by fold and role, its labels and its species must have the stored digests; its scores must be numbers from 0
    to 1, one a survey, of surveys that are there; every survey of an assessment must have one.
    """
    now = bindings(rows, labels, species)
    same = stored_bindings.select("name", F.col("digest").alias("_a")).join(now.select("name", F.col("digest").alias("_b")), "name", "full")
    checks = [same.select("name", F.coalesce(F.col("_a") == F.col("_b"), F.lit(False)).alias("holds"))]
    each = stored.groupBy("fold", "role", "survey").agg(F.count("*").alias("_n"), F.min(F.coalesce(F.col("f1").between(0, 1), F.lit(False))).alias("_ok"))
    both = rows.select("fold", "role", "survey", F.lit(True).alias("_here")).join(each, ["fold", "role", "survey"], "full")
    all_of = lambda c: F.coalesce(F.min(c), F.lit(True))
    tests: dict[str, Column] = {
        "scores_in_bounds": all_of(F.when(F.col("_n").isNotNull(), F.col("_ok"))),
        "surveys_once": all_of(F.when(F.col("_n").isNotNull(), F.col("_n") == 1)),
        "surveys_known": all_of(F.when(F.col("_n").isNotNull(), F.coalesce("_here", F.lit(False)))),
        "assessment_complete": all_of(F.when(F.coalesce("_here", F.lit(False)) & (F.col("role") == "assessment"), F.col("_n").isNotNull())),
    }
    row = both.agg(*[t.alias(n) for n, t in tests.items()])
    checks.append(row.select(F.explode(F.array(*[F.struct(F.lit(n).alias("name"), F.col(n).alias("holds")) for n in tests])).alias("e")).select("e.*"))
    return checks[0].unionByName(checks[1])
