"""Policy grids, label thresholds, buckets and gates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def distance_bucket(km: Column) -> Column:
    return F.when(km < 20, "0-20").when(km < 50, "20-50").when(km < 100, "50-100").when(km < 200, "100-200").otherwise("200+")


def label_thresholds(rows: DataFrame, label: str, p: str, y: str, grid: list[float], least: int) -> DataFrame:
    """For each label the first threshold of the grid with the best F1; 0.5 for labels with fewer than ``least`` positives.

    One pass: every threshold is a pair of counts of the same aggregate.
    """
    hit = [F.count_if((F.col(p) >= t) & F.col(y)) for t in grid]
    said = [F.count_if(F.col(p) >= t) for t in grid]
    sums = rows.groupBy(label).agg(F.count_if(y).alias("_n"), F.array(*hit).alias("_hit"), F.array(*said).alias("_said"))
    score = F.transform(F.sequence(F.lit(0), F.lit(len(grid) - 1)), lambda i: F.struct(F.round(2 * F.get("_hit", i) / F.greatest(F.get("_said", i) + F.col("_n"), F.lit(1)), 9).alias("f1"), (-i).alias("minus")))
    best = F.array_max(score)["minus"]
    table = F.array(*map(F.lit, grid))
    return sums.select(label, F.when(F.col("_n") < least, 0.5).otherwise(F.get(table, -best)).alias("threshold"))


def search(scores: DataFrame, truth: DataFrame | None, weights: list[float], counts: list[int]) -> DataFrame:
    """F1 of every (weight w of q, list length k), with its place by (f1 desc, w, k): smaller interventions win ties.

    Without ``truth``, scores hold hit, truth and ``_row`` as marked candidates do.  A survey's candidates are gathered once; each weight ranks them once and all lengths are read off the same ranking.
    """
    from quadrat.operators import search as S

    policies = scores.sparkSession.createDataFrame([(i, w, k) for i, (w, k) in enumerate((w, k) for w in weights for k in counts)], "place int, w double, k int")
    rows = S.packed(scores, truth, ["p", "q"]) if truth is not None else scores.withColumn("_x", F.struct("species", "hit", "p", "q")).select("survey", "truth", "_row", "_x")
    each = S.ranked(rows, policies, ["w"], lambda x, k: (1 - k["w"]) * x["p"] + k["w"] * x["q"], lambda p, s: p["k"], given=["p", "q"])
    means = each.groupBy("place").agg(F.round(F.avg("f1"), 6).alias("f1")).join(F.broadcast(policies), "place").select("w", "k", "f1")
    return means.withColumn("place", F.row_number().over(Window.orderBy(F.desc("f1"), "w", "k")))  # a row a policy


def gate(state: DataFrame, conditions: dict[str, Column]) -> DataFrame:
    """The conditions as booleans (missing is false) and their conjunction."""
    safe = {n: F.coalesce(c, F.lit(False)) for n, c in conditions.items()}
    every = F.lit(True)
    for c in safe.values():
        every = every & c
    return state.select(*[c.alias(n) for n, c in safe.items()], every.alias("promoted"))


def judged(metrics: DataFrame, rules: DataFrame) -> DataFrame:
    """gate_set, gate, holds and promoted: every gate of the rules over a long table of metrics (level, name, metric, value).

    A rule meets the rows of its metric and level in one join.  It holds if there are as many rows as it asks for (one at
    least), all are numbers and all compare as it says; of a ``count >`` rule at least ``least`` rows do.  A metric that is
    absent holds nothing.  A set promotes if all its gates hold.
    """
    value, bound = F.col("value"), F.col("bound")
    number = value.isNotNull() & ~F.isnan(value) & (F.abs(value) < float("inf"))
    kinds = {">": value > bound, "count >": value > bound, ">=": value >= bound, "<=": value <= bound, "==": value == bound}
    right = F.lit(False)
    for kind, test in kinds.items():
        right = F.when(F.col("comparison") == kind, number & test).otherwise(right)
    met = F.broadcast(rules).join(metrics, ["metric", "level"], "left").withColumn("_right", F.coalesce(right, F.lit(False)))
    sums = met.groupBy("gate_set", "gate", "comparison", "least").agg(F.count_if("_right").alias("_yes"), F.count_if(F.col("name").isNotNull()).alias("_rows"))
    some = F.coalesce("least", F.lit(1))
    holds = F.when(F.col("comparison") == "count >", F.col("_yes") >= some).otherwise((F.col("_yes") == F.col("_rows")) & (F.col("_rows") >= some))
    own = Window.partitionBy("gate_set")  # a row a gate
    return sums.select("gate_set", "gate", holds.alias("holds")).withColumn("promoted", F.min("holds").over(own))


def registered(policies: DataFrame, grid: DataFrame, columns: list[str]) -> DataFrame:
    """``policies`` if all of them stand in the grid, else an error."""
    foreign = policies.join(grid, columns, "left_anti").count()
    if foreign:
        raise ValueError(f"{foreign} policies are not registered")
    return policies
