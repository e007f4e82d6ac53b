"""Feature builders over columns and arrays."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.operators import search as S


def fourier(lat: Column, lon: Column, octaves: int) -> dict[str, Column]:
    """lat/90, lon/180 and sines and cosines of both at frequencies 1, 2, 4, ..."""
    out = {"lat_unit": lat / 90, "lon_unit": lon / 180}
    for name, value in (("lat", lat), ("lon", lon)):
        for k in range(octaves):
            out[f"sin_{name}_{k}"] = F.sin(F.radians(value) * (1 << k))
            out[f"cos_{name}_{k}"] = F.cos(F.radians(value) * (1 << k))
    return out


def season(month: Column, day: Column) -> tuple[Column, Column]:
    """Sine and cosine of the place in the year."""
    phase = 2 * math.pi * (month - 1 + (day - 1) / F.lit(31.0)) / 12
    return F.sin(phase), F.cos(phase)


def one_hot(value: Column, names: list[str]) -> list[Column]:
    """0/1 for each name, and for any other value."""
    return [*[(value == n).cast("int") for n in names], (~value.isin(*names)).cast("int")]


def standardised(rows: DataFrame, columns: list[str], fit: Column, clip: float) -> DataFrame:
    """Columns less their mean over their deviation among the rows to fit on; clipped, missing values 0."""
    stats = rows.where(fit).agg(*[F.avg(c).alias(f"_m_{c}") for c in columns], *[F.stddev_pop(c).alias(f"_d_{c}") for c in columns])
    out = rows.join(F.broadcast(stats), F.lit(True))
    for c in columns:
        z = (F.col(c) - F.col(f"_m_{c}")) / F.when(F.col(f"_d_{c}") < 1e-6, 1.0).otherwise(F.col(f"_d_{c}"))
        out = out.withColumn(c, F.coalesce(F.least(F.greatest(z, F.lit(-clip)), F.lit(clip)), F.lit(0.0)))
    return out.drop(*[f"_{k}_{c}" for c in columns for k in "md"])


def binned_means(rows: DataFrame, key: str, values: str, bins: int) -> DataFrame:
    """key, bin, mean of an array cut into ``bins`` parts of as equal length as can be."""
    flat = rows.select(key, F.size(values).alias("_n"), F.posexplode(values).alias("_i", "_v"))
    return flat.groupBy(key, F.floor(F.col("_i") * bins / F.col("_n")).cast("int").alias("bin")).agg(F.avg("_v").alias("mean"))


def without_fill(values: Column, limit: float) -> Column:
    """Entries that are not finite or beyond the limit become 0."""
    return F.transform(values, lambda x: F.when(x.isNull() | F.isnan(x) | (F.abs(x) > limit), 0.0).otherwise(x))


def normalised_difference(a: Column, b: Column) -> Column:
    return (a - b) / (a + b + 1e-4)


def enhanced_vegetation(nir: Column, red: Column, blue: Column) -> Column:
    below = nir + 6 * red - 7.5 * blue + 1
    below = F.when(F.abs(below) < 1e-4, 1e-4).otherwise(below)
    return F.least(F.greatest(2.5 * (nir - red) / below, F.lit(-3.0)), F.lit(3.0))


def stretched(rows: DataFrame, group: str, value: str, low: float, high: float) -> DataFrame:
    """The value between two percentiles of its group, as 0 to 1."""
    from quadrat.operators.stats import quantiles

    q = quantiles(rows.select(group, value), [group], value, [low, high]).withColumnRenamed("q", "_q")
    part = (F.col(value) - F.col("_q")[0]) / F.greatest(F.col("_q")[1] - F.col("_q")[0], F.lit(1e-6))
    return rows.join(q, group).withColumn(value, F.least(F.greatest(part, F.lit(0.0)), F.lit(1.0))).drop("_q")


def permuted(values: Column, shape: tuple[int, ...], axes: tuple[int, ...]) -> Column:
    """The flat array of a cube with its axes in another order."""
    strides = [math.prod(shape[i + 1 :]) for i in range(len(shape))]
    new = [shape[a] for a in axes]
    steps = [math.prod(new[i + 1 :]) for i in range(len(new))]

    def source(i: Column) -> Column:
        at = F.lit(0)
        for k, a in enumerate(axes):
            at = at + F.floor(i / steps[k]) % new[k] * strides[a]
        return at.cast("int")

    return F.transform(F.sequence(F.lit(0), F.lit(math.prod(shape) - 1)), lambda i: F.get(values, source(i)))


def flipped(image: Column, width: int, rows: bool, columns: bool) -> Column:
    """A flat square image with its rows, its columns or both in the other order."""

    def source(i: Column) -> Column:
        y, x = F.floor(i / width).cast("int"), (i % width).cast("int")
        return (width - 1 - y if rows else y) * width + (width - 1 - x if columns else x)

    return F.transform(image, lambda v, i: F.get(image, source(i)))


def quarter_turn(image: Column, width: int) -> Column:
    """A flat square image turned by a quarter: cell (y, x) is (x, width - 1 - y) of the first."""
    return F.transform(image, lambda v, i: F.get(image, (i % width).cast("int") * width + (width - 1 - F.floor(i / width).cast("int"))))


def with_flag(always: Column, sometimes: Column, there: Column) -> Column:
    """Two vectors and a flag in one; where the second is not there its values are 0."""
    masked = F.transform(sometimes, lambda x: F.when(there & x.isNotNull() & ~F.isnan(x), x).otherwise(0.0))
    return F.concat(always, masked, F.array(there.cast("double")))


#: Columns of an edit besides survey and species; those of _FLAGS are 0 or 1.
_EDITS = ("inside", "place", "size", "vp", "vq", "kp", "kq", "mp", "mq", "product", "difference", *[f"{n}_{c}" for n in ("inside", "total", "head", "last") for c in "pq"])
_FLAGS = ("inside", "mp", "mq")


def edit_columns(rows: DataFrame, size: int, depth: int) -> DataFrame:
    """Columns of the candidates of an edit of the first ``size`` by p + q, from survey, species, p and q.

    A survey's rows follow each other and are told apart by ``_row``: surveys are ranked by numpy in batches, and no row is shuffled.
    """
    r = lambda v: S.rounded(v, 6)
    places, depths = r(np.append(np.arange(size), 40) / 40.0), r(np.arange(depth + 1) / 128.0)

    def columns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in S._whole(batches, "_row"):
            survey, species, p, q = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("survey", "species", "p", "q"))
            for which, at, own in S._classes(starts, batch.num_rows, species):
                out, rank, of = {}, {}, {}
                shorter = np.minimum(own.sum(axis=1), depth)
                for c, v in (("p", p), ("q", q), ("b", p + q)):
                    order, minus = S._sorted(v, at, own)
                    rank[c] = np.argsort(order, axis=1)  # from 0
                    best = np.where(own, -minus, 0.0)
                    of[f"total_{c}"], of[f"head_{c}"] = best[:, :depth].sum(axis=1) / 40, best[:, :10].sum(axis=1) / 40
                    of[f"last_{c}"] = np.take_along_axis(best, shorter[:, None] - 1, 1)[:, 0]
                inside = own & (rank["b"] < size)
                near = {c: own & (rank[c] < depth) for c in "pq"}
                few = inside | near["p"] | near["q"]
                v = {c: np.where(near[c], x[at], of[f"last_{c}"][:, None] * 0.5) for c, x in (("p", p), ("q", q))}
                of |= {"size": inside.sum(axis=1) / 40.0} | {f"inside_{c}": np.where(inside, v[c], 0.0).sum(axis=1) / 40 for c in "pq"}
                each = np.repeat(np.arange(len(which)), few.sum(axis=1))
                out = {c: r(x)[each] for c, x in of.items() if c in _EDITS}
                out |= {"inside": inside[few], "place": places[np.where(inside, rank["b"], size)[few]], "product": r((v["p"] * v["q"])[few]), "difference": r((v["p"] - v["q"])[few])}
                for c in "pq":
                    out |= {f"v{c}": r(v[c][few]), f"k{c}": depths[np.minimum(rank[c], depth)[few]], f"m{c}": ~near[c][few]}
                yield pa.RecordBatch.from_arrays([pa.array(survey[at[few]]), pa.array(species[at[few]]), *[pa.array(out[c].astype(np.int32) if c in _FLAGS else out[c]) for c in _EDITS]], ["survey", "species", *_EDITS])

    kinds = ", ".join(["survey long", "species long", *[f"{c} {'int' if c in _FLAGS else 'double'}" for c in _EDITS]])
    return rows.select("_row", F.col("survey").cast("long"), F.col("species").cast("long"), "p", "q").mapInArrow(columns, kinds)


def pooled(rows: DataFrame, key: str, values: str, width: int, by: int) -> DataFrame:
    """key, cell, mean of blocks by x by of a flat image of the given width."""
    flat = rows.select(key, F.posexplode(values).alias("_i", "_v"))
    cell = F.floor(F.col("_i") / (width * by)) * (width // by) + F.floor(F.col("_i") % width / by)
    return flat.groupBy(key, cell.cast("int").alias("cell")).agg(F.avg("_v").alias("mean"))


def parsed(text: Column) -> Column:
    """A finite number, or null for spellings of missing and what is no number."""
    bare = F.lower(F.trim(text))
    value = F.when(~bare.isin("", "none", "null", "nan"), bare.try_cast("double"))
    return F.when(~F.isnan(value) & (F.abs(value) != float("inf")), value)


def components(rows: DataFrame, key: str, values: str, k: int, fit: Column) -> DataFrame:
    """key and the length of the row in the space of the k leading components of the rows to fit on."""
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    own = rows.withColumn("_x", array_to_vector(values))
    out = PCA(k=k, inputCol="_x", outputCol="_y").fit(own.where(fit)).transform(own).withColumn("_y", vector_to_array("_y"))
    return out.select(key, F.round(F.sqrt(F.aggregate("_y", F.lit(0.0), lambda a, b: a + b * b)), 6).alias("length"))
