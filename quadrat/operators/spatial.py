"""Spatial joins: pairs within a distance, nearest neighbours, counts, buffers and grid stencils.

Both sides are dealt to cells whose height is the search radius and whose width covers the radius at the cell's
latitude, so that a pair within reach lies in neighbouring cells: an equi-join with exact distances after it, at the
poles and across the antimeridian too.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.functions.geo import EARTH_KM, haversine_km
from quadrat.sources.shared import written

_HALF_WAY = math.pi * EARTH_KM


def _height(radius_km: Column) -> Column:
    """Degrees that a band of cells is high."""
    return F.degrees(radius_km / EARTH_KM) * (1 + 1e-9)


def _cells_of_band(band: Column, radius_km: Column) -> Column:
    """How many cells a band has: as many as are each wide enough for the radius from any neighbouring band."""
    height = _height(radius_km)
    edge = F.least(F.greatest(F.abs((band - 1) * height - 90), F.abs((band + 2) * height - 90)), F.lit(90.0))
    reach = F.sin(F.least(radius_km / EARTH_KM, F.lit(math.pi)) / 2) / F.greatest(F.cos(F.radians(edge)), F.lit(1e-12))
    width = F.degrees(2 * F.asin(F.least(reach, F.lit(1.0)))) * (1 + 1e-9)
    return F.greatest(F.floor(F.lit(360.0) / width), F.lit(1)).cast("long")


def _band(lat: Column, radius_km: Column) -> Column:
    return F.floor((lat + 90) / _height(radius_km)).cast("long")


def _column(lon: Column, cells: Column) -> Column:
    return F.pmod(F.floor(F.pmod(lon + 180, F.lit(360.0)) / 360.0 * cells).cast("long"), cells)


def usable(lat: str, lon: str) -> Column:
    """True for coordinates that are finite."""
    return (F.abs(F.col(lat)) <= 90) & (F.abs(F.col(lon)) < float("inf"))


def within_km(left: DataFrame, right: DataFrame, radius_km: float | str, by: tuple[str, ...] = ()) -> DataFrame:
    """All pairs within ``radius_km`` with their ``km``.  Left has lat, lon; right has rlat, rlon; names must differ.

    The radius may be a column of both sides, which is then a key like those of ``by``: a row meets the rows of the other
    side that have its radius and keys.
    """
    keys = [*by, *([radius_km] if isinstance(radius_km, str) else [])]
    radius = F.col(radius_km) if isinstance(radius_km, str) else F.lit(float(radius_km))
    bands = left.withColumn("_band", F.explode(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: _band(F.col("lat"), radius) + d)))
    bands = bands.withColumn("_cells", _cells_of_band(F.col("_band"), radius)).withColumn("_at", _column(F.col("lon"), F.col("_cells")))
    near = F.array_distinct(F.transform(F.array(F.lit(-1), F.lit(0), F.lit(1)), lambda d: F.pmod(F.col("_at") + d, F.col("_cells"))))
    asked = bands.withColumn("_cell", F.explode(near)).drop("_cells", "_at")
    there = right.withColumn("_band", _band(F.col("rlat"), radius))
    there = there.withColumn("_cell", _column(F.col("rlon"), _cells_of_band(F.col("_band"), radius)))
    km = F.round(haversine_km(F.col("lat"), F.col("lon"), F.col("rlat"), F.col("rlon")), 6)
    return asked.join(there, [*keys, "_band", "_cell"]).withColumn("km", km).where(F.col("km") <= radius).drop("_band", "_cell")


#: Levels of the pyramid below the globe (the last one's cells are 76 m high) and the least radius of a class, in km.
LEVELS, LEAST_KM = 18, 0.0625


def _place(lat: str, lon: str) -> list[Column]:
    """The finest cell of the pyramid that a row lies in; at level l it is that cell's number over 2^(LEVELS - l)."""
    n = 1 << LEVELS
    y = F.least(F.floor((F.col(lat) + 90) / 180 * n), F.lit(n - 1)).cast("long")
    x = F.least(F.floor(F.pmod(F.col(lon) + 180, F.lit(360.0)) / 360 * n), F.lit(n - 1)).cast("long")
    return [y.alias("_y"), x.alias("_x")]


def _at_levels(cells: DataFrame) -> DataFrame:
    """Cells (_y, _x) once for each level, with the number there, _ly and _lx."""
    each = cells.withColumn("_level", F.explode(F.sequence(F.lit(0), F.lit(LEVELS))))
    up = lambda c: F.call_function("shiftright", c, F.lit(LEVELS) - F.col("_level"))
    return each.withColumn("_ly", up(F.col("_y"))).withColumn("_lx", up(F.col("_x")))


def _cell_km(level: Column, y: Column) -> Column:
    """A bound of the distance of any two points of a cell: its height, and its width at the latitude where it is widest."""
    height = F.lit(180.0) / F.pow(F.lit(2.0), level)
    low = F.call_function("shiftright", y, F.lit(LEVELS) - level) * height - 90
    edge = F.when((low < 0) & (low + height > 0), 0.0).otherwise(F.least(F.abs(low), F.abs(low + height)))
    return F.least((F.radians(height) + F.cos(F.radians(edge)) * F.radians(2 * height)) * EARTH_KM, F.lit(_HALF_WAY)) + 1e-5


def nearest(left: DataFrame, right: DataFrame, k: int, right_id: str | list[str], by: tuple[str, ...] = (), most_km: float | None = None) -> DataFrame:
    """The k nearest of ``right`` for each row of ``left`` by (km, id), with ``km`` and ``rank``; within ``most_km`` if given.

    Rows meet references with the same ``by`` keys.  The references are counted by cells of several levels, a quadtree kept as
    a table; each place asked reads off the smallest cell around it that holds k, and so its own radius, rounded up to a
    power of two.  One join then serves all radii: a reference stands once in the cells of each radius that occurs (at
    most 20).  Each distinct place is searched once, and of references at one place only the k first by id take part.

    Rows without finite coordinates take no part on either side.  Where a key has fewer than k references, all are given.
    """
    ids = [right_id] if isinstance(right_id, str) else list(right_id)
    left, right = left.where(usable("lat", "lon")), right.where(usable("rlat", "rlon"))
    here = Window.partitionBy(*by, "rlat", "rlon").orderBy(*ids)
    refs = right.withColumn("_copy", F.row_number().over(here)).where(F.col("_copy") <= k).drop("_copy")
    counts = right.groupBy(*by, *_place("rlat", "rlon")).agg(F.count("*").alias("_n"))
    holding = _at_levels(counts).groupBy(*by, "_level", "_ly", "_lx").agg(F.sum("_n").alias("_n")).where(F.col("_n") >= k).drop("_n")
    places = left.select(*by, "lat", "lon").distinct().select(*by, "lat", "lon", *_place("lat", "lon"))
    levels = _at_levels(places.select(*by, "_y", "_x").distinct()).join(holding, [*by, "_level", "_ly", "_lx"]).groupBy(*by, "_y", "_x").agg(F.max("_level").alias("_level"))
    reach = F.coalesce(_cell_km(F.col("_level"), F.col("_y")), F.lit(_HALF_WAY))
    reach = F.least(reach, F.lit(float(most_km))) if most_km is not None else reach
    steps = F.greatest(F.ceil(F.log2(reach / LEAST_KM)), F.lit(0))
    radius = F.least(LEAST_KM * F.pow(F.lit(2.0), steps), F.lit(_HALF_WAY + 1))
    asked = written(places.join(levels, [*by, "_y", "_x"], "left").select(*by, "lat", "lon", radius.alias("_radius")), "radii")
    radii = asked.agg(F.collect_set("_radius").alias("_radii"))  # one row
    there = refs.join(F.broadcast(radii), F.lit(True)).withColumn("_radius", F.explode("_radii")).drop("_radii")
    order = Window.partitionBy(*by, "lat", "lon").orderBy("km", *ids)
    found = within_km(asked, there, "_radius", by).drop("_radius")
    found = found if most_km is None else found.where(F.col("km") <= most_km)
    best = found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)
    return left.join(best, [*by, "lat", "lon"])


def counts_within(left: DataFrame, right: DataFrame, radii: dict[str, float], left_id: str) -> DataFrame:
    """For each row of ``left`` the number of ``right`` within each radius, 0 included."""
    found = within_km(left, right, max(radii.values()))
    sums = found.groupBy(left_id).agg(*[F.count_if(F.col("km") <= r).alias(n) for n, r in radii.items()])
    return left.join(sums, left_id, "left").na.fill(0, list(radii))


def outside_buffer(left: DataFrame, right: DataFrame, radius_km: float, left_id: str) -> DataFrame:
    """Rows of ``left`` with no row of ``right`` nearer than ``radius_km``."""
    close = within_km(left.select(left_id, "lat", "lon"), right, radius_km).where(F.col("km") < radius_km).select(left_id).distinct()
    return left.join(close, left_id, "left_anti")


def stencil(cells: DataFrame, grid: DataFrame, decay: float = 0.8) -> DataFrame:
    """Scores (x, y, species, score) that a grid of the same form gives to each of some distinct cells (x, y).

    The nine cells around one count with exp(-decay distance).  The short side is spread over its neighbours, so that the
    grid is read once and rows that lie in one cell cost one sum.
    """
    step = F.array(F.lit(-1), F.lit(0), F.lit(1))
    around = cells.select(F.col("x").alias("_x"), F.col("y").alias("_y"), F.explode(step).alias("dx")).withColumn("dy", F.explode(step))
    weight = F.exp(-decay * F.sqrt(F.col("dx") * F.col("dx") + F.col("dy") * F.col("dy")))
    around = around.select("_x", "_y", (F.col("_x") + F.col("dx")).alias("x"), (F.col("_y") + F.col("dy")).alias("y"), weight.alias("_w"))
    sums = around.join(grid, ["x", "y"]).groupBy("_x", "_y", "species").agg(F.round(F.sum(F.col("_w") * F.col("score")), 9).alias("score"))
    return sums.withColumnsRenamed({"_x": "x", "_y": "y"})


def best_of_cells(scored: DataFrame, most: int) -> DataFrame:
    """The ``most`` best species of each cell with ``rank``, scores relative to the best, and ``coverage``, the sum of scores before that."""
    mine = Window.partitionBy("x", "y")
    ranked = scored.withColumn("rank", F.row_number().over(mine.orderBy(F.desc("score"), "species"))).where(F.col("rank") <= most)
    full = ranked.withColumn("coverage", F.sum("score").over(mine)).withColumn("_top", F.max("score").over(mine))
    return full.withColumn("score", F.col("score") / F.col("_top")).drop("_top")


def across_scales(cells: DataFrame, grids: list[tuple[int, float, DataFrame]], most: int, enough: float = 0.25, bonus: float = 0.12) -> DataFrame:
    """Cells (x, y) scored on grids of several widths: (factor, weight, grid whose cells are ``factor`` fine ones wide).

    A grid's scores are relative to its best; a species that reaches ``enough`` on several grids gains ``bonus`` for each
    but the first.  x, y, species, score, rank, coverage, and ``agreement``: the mean share of grids over the first ten.
    """
    from functools import reduce

    parts = []
    for factor, weight, grid in grids:
        up = cells.select("x", "y", F.floor(F.col("x") / factor).alias("cx"), F.floor(F.col("y") / factor).alias("cy"))
        own = stencil(up.select(F.col("cx").alias("x"), F.col("cy").alias("y")).distinct(), grid)
        own = own.withColumn("part", F.round(F.col("score") / F.max("score").over(Window.partitionBy("x", "y")), 9))
        own = own.select(F.col("x").alias("cx"), F.col("y").alias("cy"), "species", "part")
        parts.append(up.join(own, ["cx", "cy"]).select("x", "y", "species", (weight * F.col("part")).alias("value"), (F.col("part") >= enough).cast("int").alias("here")))
    sums = reduce(DataFrame.unionByName, parts).groupBy("x", "y", "species").agg(F.sum("value").alias("value"), F.sum("here").alias("support"))
    lifted = F.round(F.col("value") * (1 + bonus * F.greatest(F.col("support") - 1, F.lit(0))), 9)
    best = best_of_cells(sums.select("x", "y", "species", "support", lifted.alias("score")), most)
    agreement = F.avg(F.when(F.col("rank") <= 10, F.col("support") / len(grids))).over(Window.partitionBy("x", "y"))
    return best.withColumn("agreement", agreement).drop("support")
