"""Nearest vectors by Euclidean distance, and the space in which they are compared."""

from __future__ import annotations

import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quadrat.operators.stats import quantiles
from quadrat.sources.shared import written


def _matrix(column: pa.Array) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).reshape(len(column), -1).astype(np.float64)


def usable(v: Column, size: int) -> Column:
    """True for vectors of the length with finite components only."""
    return (F.size(v) == size) & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))


def _pivots(refs: DataFrame, n: int, sample: int) -> np.ndarray:
    """``n`` vectors far from each other, out of the ``sample`` references that come first by a hash."""
    rows = refs.orderBy(F.xxhash64("ref"), "ref").limit(sample).select("v").collect()
    x = np.array([r.v for r in rows], np.float64)
    chosen = [0]
    far = ((x - x[0]) ** 2).sum(1)
    while len(chosen) < min(n, len(x)) and far.max() > 0:
        chosen.append(int(far.argmax()))
        far = np.minimum(far, ((x - x[chosen[-1]]) ** 2).sum(1))
    return x[chosen]


def _to_pivots(pivots: np.ndarray):
    """An Arrow function from vectors to their distances to all pivots."""

    @F.arrow_udf("array<double>")
    def distances(v: pa.Array) -> pa.Array:
        x = v.flatten().to_numpy(zero_copy_only=False).reshape(len(v), -1)
        d = np.sqrt(np.maximum(((x[:, None, :] - pivots[None, :, :]) ** 2).sum(2), 0)) if len(x) else np.zeros((0, len(pivots)))
        return pa.ListArray.from_arrays(np.arange(len(x) + 1, dtype=np.int32) * len(pivots), d.ravel())

    return distances


def _in_ranges(queries: DataFrame, refs: DataFrame, k: int, pivots: int, rings: int, sample: int) -> tuple[DataFrame, DataFrame]:
    """References (ref, v, range), and queries (query, v, home, met): the range where a query itself lies, and those that may hold one of its k nearest."""
    centres = _pivots(refs, pivots, sample)
    measure = _to_pivots(centres)
    own = refs.select("ref", "v", measure("v").alias("_d")).withColumn("pivot", F.array_position("_d", F.array_min("_d")).cast("int") - 1)
    own = written(own.select("ref", "v", "pivot", F.array_min("_d").alias("d")), "pivoted")
    bounds = {r["pivot"]: r["q"] for r in quantiles(own, ["pivot"], "d", [i / rings for i in range(1, rings)]).collect()}  # a row a pivot
    table = F.array(*[F.array(*[F.lit(float(x)) for x in bounds.get(i, [0.0])]) for i in range(len(centres))])
    place = lambda pivot, d: (pivot * rings + F.size(F.filter(F.get(table, pivot), lambda x: x < d))).cast("int")
    own = own.select("ref", "v", "pivot", "d", place(F.col("pivot"), F.col("d")).alias("range"))
    known = own.groupBy("range", "pivot").agg(F.count("*").alias("n"), F.min("d").alias("low"), F.max("d").alias("high")).orderBy("range").collect()  # a row a range
    ids, of, n, low, high = (np.array([r[c] for r in known]) for c in ("range", "pivot", "n", "low", "high"))
    ids = ids.astype(np.int32)

    @F.arrow_udf("array<int>")
    def met(d: pa.Array) -> pa.Array:
        to = d.flatten().to_numpy(zero_copy_only=False).reshape(len(d), -1)[:, of]
        near, far = np.maximum(np.maximum(to - high, low - to), 0), to + high
        order = np.argsort(far, axis=1, kind="stable")
        enough = np.argmax(np.cumsum(n[order], axis=1) >= min(k, n.sum()), axis=1)
        bound = np.take_along_axis(far, order[np.arange(len(to)), enough][:, None], 1) * (1 + 1e-9) + 2e-6  # and what rounding may tie
        row, col = np.nonzero(near <= bound)
        return pa.ListArray.from_arrays(np.searchsorted(row, np.arange(len(to) + 1)).astype(np.int32), pa.array(ids[col]))

    asked = queries.select("query", "v", measure("v").alias("_d"))
    home = place(F.array_position("_d", F.array_min("_d")).cast("int") - 1, F.array_min("_d"))
    return own.select("ref", "v", "range"), asked.select("query", "v", home.alias("home"), met("_d").alias("met"))


def ranges_met(queries: DataFrame, refs: DataFrame, k: int, pivots: int = 16, rings: int = 16, sample: int = 1024) -> tuple[DataFrame, DataFrame]:
    """References (ref, v, range) in ranges, and queries (query, v, range), a row for each range that may hold one of the k nearest.

    A reference belongs to the nearest of a few pivots and, by its distance from it, to one of the pivot's rings; at most
    pivots x rings ranges are known by their size and their least and greatest distance.  By the triangle inequality a
    query knows from its own distance to a pivot how near and how far a ring's members can be: the ranges that surely lie
    near enough to hold k rows bound the k-th distance, and ranges beyond that bound are not met.  Nothing is lost.
    """
    there, asked = _in_ranges(queries, refs, k, pivots, rings, sample)
    return there, asked.select("query", "v", F.explode("met").alias("range"))


#: Queries and references whose distances are in memory at once.
TILE, STRIP = 256, 8192
#: Blocks of queries at least: tasks that work side by side.
BLOCKS = 24


class _Best:
    """The k nearest so far of a block of queries, by (d, ref); references come in any number of parts."""

    def __init__(self, ids: np.ndarray, x: np.ndarray, k: int):
        self.ids, self.x, self.k, self.size = ids, x, k, (x * x).sum(1)
        self.last = np.full(len(x), np.inf)  # the k-th distance
        none = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))
        self.found = [none for _ in range(0, len(x), TILE)]  # row of the tile, ref and d, in order, a tile of queries

    def meet(self, rid: np.ndarray, y: np.ndarray) -> None:
        for i in range(0, len(y), STRIP):
            part, ids = y[i : i + STRIP], rid[i : i + STRIP]
            size = (part * part).sum(1)
            for tile, a in enumerate(range(0, len(self.x), TILE)):
                self._tile(tile, slice(a, a + TILE), ids, part, size)

    def _tile(self, tile: int, rows: slice, rid: np.ndarray, y: np.ndarray, size: np.ndarray) -> None:
        x, last = self.x[rows], self.last[rows]
        rough = x @ y.T
        rough *= -2
        rough += self.size[rows][:, None]
        rough += size[None, :]
        floor = last * last
        if np.isinf(last).any():
            take = min(self.k, len(y)) - 1
            floor = np.minimum(floor, np.partition(rough, take, 1)[:, take]) if take + 1 == self.k else floor
        slack = 1e-5 * (1 + np.abs(floor)) + 1e-12 * (self.size[rows] + size.max())  # what may tie with the last, and what the rough form loses
        row, col = np.nonzero(rough <= (floor + slack)[:, None])
        if not len(row):
            return
        d = np.empty(len(row))
        for i in range(0, len(row), 65536):
            d[i : i + 65536] = np.round(np.sqrt(((x[row[i : i + 65536]] - y[col[i : i + 65536]]) ** 2).sum(1)), 6)
        good = d <= last[row]
        before = self.found[tile]
        row, ref, d = (np.concatenate([old, new[good]]) for old, new in zip(before, (row, rid[col], d)))
        order = np.lexsort((ref, d, row))
        row, ref, d = row[order], ref[order], d[order]
        keep = np.arange(len(row)) - np.searchsorted(row, row) < self.k
        row, ref, d = self.found[tile] = row[keep], ref[keep], d[keep]
        ends = np.searchsorted(row, np.arange(len(x)), side="right")
        full = np.diff(np.append(0, ends)) == self.k
        last[full] = d[ends[full] - 1]

    def rows(self) -> Iterator[pa.RecordBatch]:
        for tile, (row, ref, d) in enumerate(self.found):
            yield pa.RecordBatch.from_arrays([pa.array(self.ids[tile * TILE + row]), pa.array(ref), pa.array(d)], ["query", "ref", "d"])


def nearest(queries: DataFrame, refs: DataFrame, k: int, block: int = 16384, pivots: int = 16, rings: int = 16) -> DataFrame:
    """query, ref, d and rank of the k nearest of ``refs`` (ref, v) for each of ``queries`` (query, v), by (d, ref); exact.

    Queries are cut into blocks of about ``block`` at most, ``BLOCKS`` at least, those that lie in the same or neighbouring ranges
    next to each other.  A block goes to one task, once, and the ranges that ``ranges_met`` leaves for one of its queries pass
    by; the task holds the block with its k nearest so far and a part of the references, and sends on k rows a query.
    So a query is shuffled once, whatever it meets, and a reference once a block.  Distances are rounded to six digits,
    so that ties are the same wherever a vector lies.  Vectors of another length than most references, or with components
    that are null or not finite, take no part.
    """
    kinds = "query long, ref long, d double, rank int"
    length = refs.where("v is not null").groupBy(F.size("v").alias("size")).count().orderBy(F.desc("count"), "size").first()
    if length is None:
        return refs.sparkSession.createDataFrame([], kinds)
    queries, refs = (x.where(usable(F.col("v"), length["size"])) for x in (queries, refs))
    if refs.isEmpty():
        return refs.sparkSession.createDataFrame([], kinds)
    there, asked = _in_ranges(queries, refs, k, pivots, rings, 1024)
    asked = written(asked, "asked")
    homes = {r["home"]: r["count"] for r in asked.groupBy("home").count().collect()}  # a row a range
    total = sum(homes.values())
    blocks = max(BLOCKS, math.ceil(total / block))
    before = np.cumsum([0, *[homes.get(i, 0) for i in range(pivots * rings)]]).tolist()
    of = lambda values: F.get(F.array(*[F.lit(int(x)).cast("long") for x in values]), F.col("home"))
    place = of(before[:-1]) + F.pmod(F.xxhash64("query"), of([homes.get(i, 1) for i in range(pivots * rings)]))
    asked = asked.withColumn("block", F.floor(place * blocks / max(total, 1)).cast("int"))
    meets = asked.select("block", F.explode("met").alias("range")).groupBy("range").agg(F.collect_set("block").alias("blocks"))  # a row a range
    q = asked.select("block", F.lit(0).alias("side"), F.col("query").alias("id"), "v")
    r = there.join(F.broadcast(meets), "range").select(F.explode("blocks").alias("block"), F.lit(1).alias("side"), F.col("ref").alias("id"), "v")

    def best(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own, block, parts = None, None, []
        for batch in (b for b in batches if b.num_rows):
            mark = batch.column("block").to_numpy().astype(np.int64) * 2 + batch.column("side").to_numpy()
            cuts = [0, *(np.flatnonzero(mark[1:] != mark[:-1]) + 1).tolist(), len(mark)]
            for a, z in zip(cuts, cuts[1:]):
                ids, x = batch.column("id").slice(a, z - a).to_numpy(), _matrix(batch.column("v").slice(a, z - a))
                if mark[a] // 2 != block:
                    yield from own.rows() if own else ()
                    own, block, parts = None, mark[a] // 2, []
                if mark[a] % 2 == 0:
                    parts.append((ids, x))
                    continue
                own = own or _Best(*map(np.concatenate, zip(*parts)), k)
                own.meet(ids, x)
        yield from own.rows() if own else ()

    each = q.unionByName(r).repartitionById(blocks, F.col("block")).sortWithinPartitions("block", "side")
    found = each.mapInArrow(best, "query long, ref long, d double")
    rank = F.row_number().over(Window.partitionBy("query").orderBy("d", "ref"))
    return found.withColumn("rank", rank).where(F.col("rank") <= k)


def softmax_weights(near: DataFrame, local: int, temperature: Column | None = None) -> DataFrame:
    """``near`` with ``weight``: half the softmax of -d / (median d of the query) over its ``local`` nearest, half over all."""
    mine = Window.partitionBy("query")
    t = near.groupBy("query").agg(F.median("d").alias("_t"))  # k rows a query
    w = near.join(t, "query").withColumn("_w", F.exp(-F.col("d") / F.greatest("_t", F.lit(1e-6))))
    close = F.when(F.col("rank") <= local, F.col("_w"))
    share = F.coalesce(close / F.sum(close).over(mine), F.lit(0.0))
    return w.withColumn("weight", 0.5 * share + 0.5 * F.col("_w") / F.sum("_w").over(mine)).drop("_t", "_w")


def latent(rows: DataFrame, key: str, values: str, fit: Column, most: int = 32) -> DataFrame:
    """key and ``v``: leading components of the rows to fit on, each over the fourth root of its variance (at least 0.05).

    Means fill what is not finite, deviations are 0.01 at least and values end at six deviations, all from the rows to
    fit on.  Signs of components are free; distances are not.
    """
    from pyspark.ml.feature import PCA
    from pyspark.ml.functions import array_to_vector, vector_to_array

    size = rows.select(F.max(F.size(values))).first()[0] or 0
    flat = rows.select(key, fit.alias("_fit"), F.posexplode(values).alias("_i", "_x"))
    good = F.when(~F.isnan("_x") & (F.abs("_x") < float("inf")), F.col("_x"))
    own = flat.where("_fit").withColumn("_g", good)
    means = own.groupBy("_i").agg(F.coalesce(F.avg("_g"), F.lit(0.0)).alias("_m"))
    spread = own.join(F.broadcast(means), "_i").groupBy("_i").agg(F.first("_m").alias("_m"), F.greatest(F.stddev_pop(F.coalesce("_g", "_m")), F.lit(0.01)).alias("_d"))
    table = {r["_i"]: (r["_m"], r["_d"]) for r in spread.collect()}  # one row a component of the vectors
    pairs = F.array(*[F.struct(F.lit(float(table.get(i, (0.0, 1.0))[0])).alias("m"), F.lit(float(table.get(i, (0.0, 1.0))[1])).alias("d")) for i in range(size)])

    def scaled(x: Column, p: Column) -> Column:
        fine = F.when(~F.isnan(x) & (F.abs(x) < float("inf")), x).otherwise(p["m"])
        return F.least(F.greatest((fine - p["m"]) / p["d"], F.lit(-6.0)), F.lit(6.0))

    x = rows.where(F.size(values) == size).select(key, fit.alias("_fit"), array_to_vector(F.zip_with(values, pairs, scaled)).alias("_v"))
    k = min(most, size)
    model = PCA(k=k, inputCol="_v", outputCol="_c").fit(x.where("_fit"))
    y = model.transform(x).select(key, "_fit", vector_to_array("_c").alias("_c"))
    spreads = y.where("_fit").agg(*[F.var_samp(F.get("_c", F.lit(i))).alias(str(i)) for i in range(k)]).first()
    centre = y.where("_fit").agg(*[F.avg(F.get("_c", F.lit(i))).alias(str(i)) for i in range(k)]).first()
    by = F.array(*[F.struct(F.lit(float(centre[i] or 0)).alias("m"), F.lit(max(float(spreads[i] or 0), 0.05) ** 0.25).alias("d")) for i in range(k)])
    return y.select(key, F.zip_with("_c", by, lambda c, b: (c - b["m"]) / b["d"]).alias("v"))
