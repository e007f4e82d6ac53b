"""Running totals over whole tables, weighted draws, histograms and calibration."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.sources.shared import written


def mixed32(value: Column) -> Column:
    """A hash of whole numbers to 32 bits in which neighbours have nothing in common; any engine's longs can hold the products."""
    x = value % (1 << 32)
    for shift, factor in MIXES:
        x = x.bitwiseXOR(F.shiftright(x, shift)) * factor % (1 << 32)
    return x.bitwiseXOR(F.shiftright(x, 16))


# Shifts and odd factors below 2^31 of the hash.
MIXES = ((16, 1540483477), (13, 1103515245))


def mixed32_sql(value: str) -> str:
    """The same as SQL."""
    x = f"(({value}) % 4294967296)"
    for shift, factor in MIXES:
        x = f"(xor({x}, {x} >> {shift}) * {factor} % 4294967296)"
    return f"xor({x}, {x} >> 16)"


def draw_place(draw: Column, place: Column, seed: int, size: Column) -> Column:
    """The place in 0..size-1 that a slot of a draw takes."""
    return mixed32(draw * 7919 + place * 104729 + seed * 15485863) % size


def draw_place_sql(draw: str, place: str, seed: int, size: str) -> str:
    return f"{mixed32_sql(f'{draw}::BIGINT * 7919 + {place} * 104729 + {seed} * 15485863')} % {size}"


#: Rows of a range.
RANGE_ROWS = 1 << 20


def ranged(rows: DataFrame, by: list[str], order: list[str], size: int | None = None) -> DataFrame:
    """``rows`` sorted by ``by`` and ``order``, written in ranges of about ``size`` rows, with the range's number ``_part``.

    The number of ranges follows the rows.  Rows that are equal in all these columns lie in one range: aggregate first.
    """
    own = written(rows, "rows")
    parts = max(1, -(-own.count() // (size or RANGE_ROWS)))
    keys = [F.col(c) for c in (*by, *order)]
    return written(own.repartitionByRange(parts, *keys).sortWithinPartitions(*keys).withColumn("_part", F.spark_partition_id()), "ranges")


def running_sums(rows: DataFrame, by: list[str], order: list[str], weight: str, size: int | None = None) -> DataFrame:
    """``rows`` with ``upto``, the sum of the weight of its ``by`` keys up to and with the row, and ``total``.

    Two passes: sums within the ranges of ``ranged``, each moved on by the ranges before it, so no task sees a whole key.
    """
    table = ranged(rows, by, order, size)
    inside = Window.partitionBy(*by, "_part").orderBy(*order).rowsBetween(Window.unboundedPreceding, 0)
    mine = Window.partitionBy(*by)  # one row a range
    sums = table.groupBy(*by, "_part").agg(F.sum(weight).alias("_here"))
    before = F.coalesce(F.sum("_here").over(mine.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = sums.select(*by, "_part", before.alias("_before"), F.sum("_here").over(mine).alias("total"))
    own = table.withColumn("_upto", F.sum(weight).over(inside)).join(sums, [*by, "_part"])
    return own.withColumn("upto", F.col("_before") + F.col("_upto")).drop("_part", "_upto", "_before")


def numbered(rows: DataFrame, by: list[str], order: list[str], size: int | None = None) -> DataFrame:
    """``rows`` with ``place``, from 0 in the order of its keys, and ``total``, the rows of these keys."""
    return running_sums(rows.withColumn("_one", F.lit(1).cast("long")), by, order, "_one", size).withColumn("place", F.col("upto") - 1).drop("upto", "_one")


def with_previous(rows: DataFrame, by: list[str], value: str, size: int | None = None) -> DataFrame:
    """``rows`` with ``previous``, the value before it in the order of values of its keys, null for the first."""
    table = ranged(rows, by, [value], size)
    ends = table.groupBy(*by, "_part").agg(F.max(value).alias("_end"))
    ends = ends.select(*by, "_part", F.lag("_end").over(Window.partitionBy(*by).orderBy("_part")).alias("_end"))  # one row a range
    inside = F.lag(value).over(Window.partitionBy(*by, "_part").orderBy(value))
    return table.withColumn("_lag", inside).join(ends, [*by, "_part"]).withColumn("previous", F.coalesce("_lag", "_end")).drop("_part", "_lag", "_end")


def quantiles(rows: DataFrame, by: list[str], value: str, probabilities: list[float], size: int | None = None) -> DataFrame:
    """by, q: exact quantiles of the values that are not null, linear between the two nearest in order.

    Values are counted, and the running counts of their ranges tell which two values each quantile lies between; nothing
    is gathered by key.  A key without values has no row.
    """
    counts = rows.where(F.col(value).isNotNull()).groupBy(*by, value).agg(F.count("*").alias("_n"))
    sums = running_sums(counts, by, [value], "_n", size)
    covers = lambda rank: (rank >= F.col("upto") - F.col("_n")) & (rank < F.col("upto"))
    places = [F.lit(float(p)) * (F.col("total") - 1) for p in probabilities]
    picks = [f(F.when(covers(r(x)), F.col(value))).alias(f"_{n}{i}") for i, x in enumerate(places) for n, r, f in (("low", F.floor, F.max), ("high", F.ceil, F.max))]
    found = sums.groupBy(*by).agg(F.any_value("total").alias("total"), *picks)
    between = [F.col(f"_low{i}") + (F.col(f"_high{i}") - F.col(f"_low{i}")) * (x - F.floor(x)) for i, x in enumerate(places)]
    exact = [F.when(F.col(f"_low{i}") == F.col(f"_high{i}"), F.col(f"_low{i}")).otherwise(x) for i, x in enumerate(between)]
    return found.select(*by, F.array(*[x.cast("double") for x in exact]).alias("q"))


def running_share(rows: DataFrame, key: str, weight: str, size: int | None = None) -> DataFrame:
    """``rows`` with ``low`` and ``high``, the bounds of each key's share of the weight in key order; keys must differ."""
    own = running_sums(rows, [], [key], weight, size)
    return own.withColumn("high", F.col("upto") / F.col("total")).withColumn("low", (F.col("upto") - F.col(weight)) / F.col("total")).drop("upto", "total")


def draw_weighted(rows: DataFrame, key: str, weight: str, draws: int, seed: int, size: int | None = None) -> DataFrame:
    """``draws`` keys with replacement in proportion to weight, as (draw, key).

    Uniforms are hashes of the draw; draws and shares meet in equal slices of [0, 1), of which there are as many as rows and
    draws ask for, so that a slice holds a few hundred of either.
    """
    shares = written(running_share(rows, key, weight, size), "shares")
    parts = max(16, (shares.count() + draws) >> 8)
    at = lambda x: F.least(F.floor(x * parts), F.lit(parts - 1)).cast("long")
    wide = shares.withColumn("_slice", F.explode(F.sequence(at(F.col("low")), at(F.col("high")))))
    asked = rows.sparkSession.range(draws).select(F.col("id").alias("draw"), (F.shiftrightunsigned(F.xxhash64(F.lit(seed), "id"), 11) / float(1 << 53)).alias("u"))
    asked = asked.withColumn("_slice", at(F.col("u")))
    # The last share ends at 1, whatever the rounding of its sum.
    inside = (F.col("u") >= F.col("low")) & ((F.col("u") < F.col("high")) | (F.col("high") >= 1))
    return asked.join(wide, "_slice").where(inside).select("draw", key)


def logit(p: Column) -> Column:
    q = F.least(F.greatest(p, F.lit(1e-7)), F.lit(1 - 1e-7))
    return F.log(q / (1 - q))


def logit_histogram(rows: DataFrame, p: Column, y: Column, low: float, high: float, bins: int) -> DataFrame:
    """bin, n, positives and the sum of logits, of ``bins`` equal bins of the clipped logit."""
    z = F.least(F.greatest(logit(p), F.lit(low)), F.lit(high))
    at = F.least(F.floor((z - low) / (high - low) * bins), F.lit(bins - 1)).cast("int")
    return rows.groupBy(at.alias("bin")).agg(F.count("*").alias("n"), F.sum(y.cast("long")).alias("positives"), F.sum(z).alias("total"))


def platt_fit(histogram: DataFrame, steps: int = 30) -> tuple[float, float]:
    """Slope and intercept of the logistic fit over the bins' mean logits, by Newton steps over at most a few hundred rows."""
    rows = [(r["total"] / r["n"], r["n"], r["positives"]) for r in histogram.collect()]
    a, b = 1.0, 0.0
    for _ in range(steps):
        g0 = g1 = h00 = h01 = h11 = 0.0
        for z, n, k in rows:
            p = 1 / (1 + math.exp(-(a * z + b)))
            r, w = n * p - k, n * p * (1 - p)
            g0, g1, h00, h01, h11 = g0 + r * z, g1 + r, h00 + w * z * z, h01 + w * z, h11 + w
        h00, h11 = h00 + 1e-6, h11 + 1e-6
        det = h00 * h11 - h01 * h01
        da, db = (h11 * g0 - h01 * g1) / det, (h00 * g1 - h01 * g0) / det
        a, b = min(max(a - da, 0.05), 10.0), b - db
        if abs(da) + abs(db) < 1e-10:
            break
    return a, b


def platt(p: Column, a: float, b: float) -> Column:
    return 1 / (1 + F.exp(-(a * logit(p) + b)))
