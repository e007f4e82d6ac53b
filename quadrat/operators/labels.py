"""Relational operators over long labels: indexes, alignment, contracts, counts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def dense_index(values: DataFrame, value: str, index: str) -> DataFrame:
    """Distinct values with their place, from 0, in sorted order.

    Values are sorted by ranges and written with the number of their range; rows are numbered within a range, and every
    range is moved on by the sizes of those before it, so no task sorts all and the ranges follow the table's size.
    """
    from quadrat.sources.shared import written

    ranged = values.select(value).na.drop().distinct().orderBy(value).withColumn("_part", F.shiftright(F.monotonically_increasing_id(), 33))
    ranged = written(ranged.withColumn("_inside", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "ranges")
    before = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)  # a row a range
    sizes = ranged.groupBy("_part").agg(F.count("*").alias("_n")).select("_part", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"))
    return ranged.join(F.broadcast(sizes), "_part").select(value, (F.col("_before") + F.col("_inside")).cast("long").alias(index))


def first_rows(rows: DataFrame, key: str, order: str, columns: list[str]) -> DataFrame:
    """For each key the columns of its first row in ``order``."""
    first = F.min_by(F.struct(*columns), order).alias("_first")
    return rows.groupBy(key).agg(first).select(key, *[F.col(f"_first.{c}").alias(c) for c in columns])


def clean(value: Column, sentinel: str) -> Column:
    """Trimmed text, or the sentinel for null, blank and spellings of missing."""
    bare = F.trim(value)
    return F.when(bare.isNull() | F.lower(bare).isin("", "nan", "none", "<na>", "null"), sentinel).otherwise(bare)


def finite(value: Column) -> Column:
    """The number, or null where it is not finite."""
    return F.when(F.isnan(value) | (F.abs(value) == float("inf")), None).otherwise(value)


def aligned(ids: DataFrame, rows: DataFrame, key: str) -> DataFrame:
    """``rows`` for ``ids``, one to one; raises where a key is absent or repeats."""
    joined = ids.join(rows, key, "left")
    found = rows.groupBy(key).agg(F.count("*").alias("_n"))
    state = ids.join(found, key, "left").agg(F.count_if(F.col("_n").isNull()).alias("absent"), F.count_if(F.col("_n") > 1).alias("repeated")).first()
    if state["absent"] or state["repeated"]:
        raise ValueError(f"{state['absent']} keys are absent and {state['repeated']} repeat in {key}")
    return joined


def rejections(rows: DataFrame, rules: dict[str, Column]) -> DataFrame:
    """One row with the number of rows that each rule rejects by itself, and the number that none rejects."""
    from functools import reduce

    every = [F.coalesce(c, F.lit(True)) for c in rules.values()]
    none = ~reduce(lambda a, b: a | b, every)
    return rows.agg(*[F.count_if(c).alias(n) for n, c in zip(rules, every)], F.count_if(none).alias("kept"))


def varying(rows: DataFrame, columns: list[str], fit: Column) -> list[str]:
    """Columns with at least two values among the rows to fit on."""
    own = rows.where(fit)
    low_high = own.agg(*[F.min(c).alias(f"a_{c}") for c in columns], *[F.max(c).alias(f"z_{c}") for c in columns]).first()
    return [c for c in columns if low_high[f"a_{c}"] != low_high[f"z_{c}"]]


def with_missing_flags(rows: DataFrame, columns: list[str], fit: Column | None = None) -> DataFrame:
    """A 0/1 column ``<c>_missing`` for each column that has nulls among the rows to fit on (all columns without)."""
    flagged = columns
    if fit is not None:
        nulls = rows.where(fit).agg(*[F.count_if(F.col(c).isNull()).alias(c) for c in columns]).first()
        flagged = [c for c in columns if nulls[c]]
    return rows.select("*", *[F.col(c).isNull().cast("double").alias(f"{c}_missing") for c in flagged])
