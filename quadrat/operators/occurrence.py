"""Presence-only occurrences as weighted pseudo-surveys, and scores of grid cells."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

GROUP = ["row_cell", "col_cell", "publisher", "stratum"]


def pseudo_surveys(occurrences: DataFrame) -> DataFrame:
    """One row for each (cell, publisher, stratum): least survey, distinct species and surveys, raw support.

    Two aggregates, the first by group and species, so that record density changes nothing but ``raw``.
    """
    each = occurrences.groupBy(*GROUP, "species").agg(F.min("survey").alias("survey"), F.count("*").alias("raw"))
    return each.groupBy(*GROUP).agg(F.min("survey").alias("survey"), F.count("*").alias("species"), F.sum("raw").alias("raw"))


def inverse_weights(groups: DataFrame, cells_a_degree: int) -> DataFrame:
    """Weight 1 / (publishers in the cell * strata of the publisher in the cell * sqrt(cells in the 1-degree block))."""
    cell = ["row_cell", "col_cell"]
    publishers = groups.groupBy(*cell).agg(F.count_distinct("publisher").alias("publishers"))
    strata = groups.groupBy(*cell, "publisher").agg(F.count_distinct("stratum").alias("strata"))
    block = [F.floor(F.col(c) / cells_a_degree).alias(f"{c}_block") for c in cell]
    cells = publishers.select(*cell, *block)
    per_block = cells.groupBy("row_cell_block", "col_cell_block").agg(F.count("*").alias("cells"))
    known = cells.join(per_block, ["row_cell_block", "col_cell_block"]).select(*cell, "cells")
    joined = groups.join(publishers, cell).join(strata, [*cell, "publisher"]).join(known, cell)
    return joined.withColumn("weight", 1 / (F.col("publishers") * F.col("strata") * F.sqrt("cells")))


def cap_publishers(weighted: DataFrame, cap: float) -> DataFrame:
    """``weighted`` with weights scaled so that no publisher holds more than ``cap`` of the mass (or 1/n), the other ratios kept.

    A round pins the publishers whose share is above the cap and gives the rest the room that is left; the pinned ones are
    the heaviest, so a round is two sums over the masses and its state is two numbers.  The number of publishers is free.
    """
    from quadrat.sources.shared import written

    masses = written(weighted.groupBy("publisher").agg(F.sum("weight").alias("mass")), "masses")
    n, total = masses.agg(F.count("*"), F.coalesce(F.sum("mass"), F.lit(0.0))).first()
    cap, pinned, free = max(cap, 1 / max(1, n)), 0, total
    share = lambda: F.col("mass") * (1 - cap * pinned) / free
    while free > 0:
        over, held = masses.where(share() > cap + 1e-12).agg(F.count("*"), F.sum("mass")).first()
        if over <= pinned:
            break
        pinned, free = over, total - held
    factor = F.when(share() > cap + 1e-12, cap * total / F.col("mass")).otherwise((1 - cap * pinned) * total / free) if free > 0 else F.lit(1.0)
    return weighted.join(masses.select("publisher", factor.alias("factor")), "publisher").withColumn("weight", F.col("weight") * F.col("factor")).drop("factor")


def damped_scores(counts: DataFrame, cell: list[str], power: float, most: int) -> DataFrame:
    """Top species of each cell by count / total^power, relative to the best: cell, species, score."""
    total = counts.groupBy("species").agg(F.sum("n").alias("total"))
    scored = counts.join(total, "species").withColumn("score", F.round(F.col("n") / F.pow("total", F.lit(power)), 9))
    return top_of(scored, cell, most)


def top_of(scored: DataFrame, group: list[str], most: int) -> DataFrame:
    """The ``most`` best (score desc, species) of each group with scores relative to the best."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), "species")
    kept = scored.withColumn("_rank", F.row_number().over(order)).where(F.col("_rank") <= most)
    best = kept.groupBy(*group).agg(F.max("score").alias("_best"))
    return kept.join(best, group).withColumn("score", F.col("score") / F.col("_best")).select(*group, "species", "score")


def coarser(scored: DataFrame, factor: int, most: int) -> DataFrame:
    """Scores summed over cells ``factor`` times as wide."""
    up = scored.groupBy(F.floor(F.col("x") / factor).alias("x"), F.floor(F.col("y") / factor).alias("y"), "species").agg(F.round(F.sum("score"), 9).alias("score"))
    return top_of(up, ["x", "y"], most)


def mean_of_distinct(rows: DataFrame, group: list[str], key: str, value: Column) -> DataFrame:
    """Mean of a finite value over the distinct keys of each group."""
    own = rows.select(*group, key, value.alias("_v")).distinct()
    return own.groupBy(*group).agg(F.avg(F.when(~F.isnan("_v"), F.col("_v"))).alias("mean"))
