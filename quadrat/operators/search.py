"""Policies that change rankings: every policy of a grid over the same candidates, and the choice among them.

A survey's candidates come together once, by survey.  Policies that rank alike share a ranking, so a survey is ranked once
for each of these and all their lengths are read off the same order; nothing but sums by policy is shuffled after that.
Values are expressions of Spark; batches of surveys are sorted by numpy inside the tasks.  Values are rounded to nine
digits; ties go to the smaller species.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from decimal import ROUND_HALF_UP, Decimal

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, StructField, StructType


def packed(candidates: DataFrame, truth: DataFrame, values: list[str]) -> DataFrame:
    """survey, c: its candidates as structs (species, hit, values), and truth: the number of its labels."""
    marked = candidates.join(truth.select("survey", "species", F.lit(1).alias("hit")), ["survey", "species"], "left").na.fill(0, ["hit"])
    sizes = truth.groupBy("survey").agg(F.count("*").alias("truth"))
    return marked.groupBy("survey").agg(F.collect_list(F.struct("species", "hit", *values)).alias("c")).join(sizes, "survey", "left").na.fill(0, ["truth"])


def _hits(side: Column) -> Column:
    return F.size(F.filter(side, lambda x: x["hit"] == 1))


def _whole(batches: Iterator[pa.RecordBatch], edge: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches that end where a run of equal ``edge`` ends, with the places where runs begin."""
    held: list[pa.RecordBatch] = []
    joined = lambda parts: pa.Table.from_batches(parts).combine_chunks().to_batches()[0]
    for batch in (b for b in batches if b.num_rows):
        key = batch.column(edge).to_numpy(zero_copy_only=False)
        cuts = np.flatnonzero(key[1:] != key[:-1]) + 1
        if held and held[-1].column(edge)[-1].as_py() != key[0]:
            cuts = np.concatenate([[0], cuts])
        if len(cuts):
            own = joined([*held, batch.slice(0, int(cuts[-1]))]) if held or cuts[-1] else None
            if own is not None:
                key = own.column(edge).to_numpy(zero_copy_only=False)
                yield own, np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])
            held = []
            batch = batch.slice(int(cuts[-1]))
        held.append(batch)
    if held:
        own = joined(held)
        key = own.column(edge).to_numpy(zero_copy_only=False)
        yield own, np.concatenate([[0], np.flatnonzero(key[1:] != key[:-1]) + 1])


def rounded(v: np.ndarray, digits: int = 9) -> np.ndarray:
    """So many digits, halves of the shortest decimal form away from zero, as Spark rounds; values close to a half are decided in decimals."""
    unit = 10.0**digits
    scaled = np.abs(v) * unit
    out = np.copysign(np.floor(scaled + 0.5) / unit, v) + 0.0
    for i in np.flatnonzero(np.abs(scaled - np.floor(scaled) - 0.5) < 1e-6 * np.maximum(1, np.abs(v))):
        out[i] = float(Decimal(repr(float(v[i]))).quantize(Decimal(1).scaleb(-digits), ROUND_HALF_UP))
    return out


def _classes(starts: np.ndarray, rows: int, species: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Runs of about one size: which they are, their rows by species as a matrix, and what of it is theirs."""
    sizes = np.diff(np.append(starts, rows))
    wide = -(-sizes // 8) * 8
    for c in np.unique(wide):
        which = np.flatnonzero(wide == c)
        own = np.arange(c) < sizes[which, None]
        at = np.where(own, starts[which, None] + np.arange(c), starts[which, None])
        order = np.argsort(np.where(own, species[at], np.iinfo(np.int64).max), axis=1, kind="stable")
        yield which, np.take_along_axis(at, order, 1), own


def _lists(values: np.ndarray, own: np.ndarray) -> tuple[pa.Array, np.ndarray]:
    return pa.array(np.concatenate([[0], np.cumsum(own.sum(axis=1))]).astype(np.int32)), values[own]


def _sorted(v: np.ndarray, at: np.ndarray, own: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of each row by descending value, the smaller species first, and the values in it."""
    m = np.where(own, -v[at], np.inf)
    order = np.argsort(m, axis=1, kind="stable")
    return order, np.take_along_axis(m, order, 1)


def _ranking(m: np.ndarray, own: np.ndarray) -> pa.Array:
    """A ranking's members: v, the value's negative, and u, the sum of values so far."""
    offsets, v = _lists(m, own)
    sums = _lists(np.cumsum(np.where(own, -m, 0.0), axis=1), own)[1]
    return pa.ListArray.from_arrays(offsets, pa.StructArray.from_arrays([pa.array(v), pa.array(sums)], ["v", "u"]))


_MEMBERS = ArrayType(StructType().add("v", "double").add("u", "double"))


def _shared(rows: DataFrame, policies: DataFrame, keys: list[str]) -> tuple[dict[tuple, int], DataFrame, list[StructField], DataFrame, str]:
    """Numbers of the policies' distinct keys, policies beside these, what is kept of a survey, a row a candidate, and what tells surveys apart."""
    index: dict[tuple, int] = {}
    placed = [(index.setdefault(tuple(r[k] for k in keys), len(index)), *r) for r in policies.collect()]
    table = rows.sparkSession.createDataFrame(placed, StructType([StructField("_key", IntegerType()), *policies.schema.fields]))
    table = table.select("_key", *keys, F.struct(*[c for c in policies.columns if c not in keys]).alias("_p"))
    kept = [f for f in rows.schema if f.name not in ("c", "_x", "_row")]
    flat = rows if "_x" in rows.columns else rows.withColumn("_row", F.monotonically_increasing_id()).select("*", F.explode("c").alias("_x")).drop("c")
    return index, table, kept, flat, "_row" if "_row" in flat.columns else "survey"


def _given(flat: DataFrame, names: list[str]) -> list[Column]:
    """Columns of a candidate or of its survey as numbers, for functions over arrays; what is null is 0."""
    there = flat.schema["_x"].dataType.names
    return [F.coalesce((F.col("_x")[c] if c in there else F.col(c)).cast("double"), F.lit(0.0)).alias(f"_g_{c}") for c in names]


def _arrays(batch: pa.RecordBatch, names: list[str]) -> dict[str, np.ndarray]:
    return {c: batch.column(f"_g_{c}").to_numpy(zero_copy_only=False) for c in names}


def ranked(rows: DataFrame, policies: DataFrame, keys: list[str], value: Callable, length: Callable, by: list[str] | None = None, given: list[str] | None = None) -> DataFrame:
    """survey, ``by`` columns of ``rows``, place, n, hits, truth and f1 of every policy.

    ``rows`` has a row a survey with its candidates ``c``, or a row a candidate (``survey`` and what a survey has, ``_x``: the
    candidate's struct) where a survey's rows follow each other, told apart by ``_row`` if there is one.  ``value(x)`` scores a candidate, from its struct, columns of
    ``rows`` and the ``keys`` of policies; policies with equal keys share a ranking.  ``length(p, s)`` is the length of a
    policy's list from its struct and the ranking, whose members have ``v``, the negative value, and ``u``, the sum of values
    so far; lists are no longer than the ranking.  Policies are a table of fixed size.

    With ``given``, names of a candidate's fields or of columns, ``value(x, k)`` works on arrays instead: x has those, k the
    policy's keys, and whatever the number of rankings no more than these columns leave the JVM.
    """
    index, table, kept, flat, edge = _shared(rows, policies, keys)
    kinds = {f.name: f.dataType for f in policies.schema}
    if given is None:
        for own, i in index.items():
            flat = flat.withColumns({k: F.lit(v).cast(kinds[k]) for k, v in zip(keys, own)}).withColumn(f"_v{i}", value(F.col("_x")).cast("double"))
    scored = [F.col(f"_v{i}") for i in index.values()] if given is None else _given(flat, given)
    over = None if given is None else value  # expressions of Spark stay with the driver
    flat = flat.select(*[f.name for f in kept], *([edge] if edge == "_row" else []), F.col("_x.species").cast("long").alias("_species"), F.col("_x.hit").cast("int").alias("_hit"), *scored)
    scores, names, n = "_s" in str(length(F.col("_p"), F.col("_s"))), [f.name for f in kept], len(index)

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole(batches, edge):
            species, hit = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_species", "_hit"))
            if given is None:
                values = [rounded(batch.column(f"_v{i}").to_numpy(zero_copy_only=False)) for i in range(n)]
            else:
                x = _arrays(batch, given)
                values = [rounded(over(x, dict(zip(keys, own)))) for own in index]
            for which, at, own in _classes(starts, batch.num_rows, species):
                first = pa.array(starts[which])
                columns = [batch.column(c).take(first) for c in names]
                marks = np.where(own, hit[at], 0)  # a run's members come before its padding
                for i, v in enumerate(values):
                    order, m = _sorted(v, at, own)
                    hits = pa.ListArray.from_arrays(*_lists(np.cumsum(np.take_along_axis(marks, order, 1), axis=1).astype(np.int32), own))
                    out = [*columns, pa.array(np.full(len(which), i, np.int32)), hits, *([_ranking(m, own)] if scores else [])]
                    yield pa.RecordBatch.from_arrays(out, [*names, "_key", "_h", *(["_s"] if scores else [])])

    schema = StructType([*kept, StructField("_key", IntegerType()), StructField("_h", ArrayType(IntegerType()))])
    if scores:
        schema = schema.add("_s", _MEMBERS)
    each = flat.mapInArrow(sort, schema).join(F.broadcast(table), "_key")
    s = F.col("_s") if scores else F.lit(None)
    out = each.select("survey", *(by or []), "truth", F.col("_p.place").alias("place"), F.least(length(F.col("_p"), s), F.size("_h")).cast("int").alias("n"), "_h")
    hits = F.when(F.col("n") > 0, F.get("_h", F.col("n") - 1)).when(F.col("n").isNotNull(), 0)
    out = out.select("survey", *(by or []), "truth", "place", "n", hits.alias("hits"))
    return out.withColumn("f1", 2 * F.col("hits") / F.greatest(F.col("n") + F.col("truth"), F.lit(1)))


def gathered(rows: DataFrame, fields: list[str], scores: list[str]) -> DataFrame:
    """A row a survey: its own columns, c with ``fields`` and ``rank_`` of each score as structs, and ``s_`` of each score: that ranking.

    ``rows`` has a row a candidate, and a survey's rows follow each other.  Scores are ranked as they are, ties by species.
    """
    kept, edge = [f for f in rows.schema if f.name not in (*fields, "_row")], "_row" if "_row" in rows.columns else "survey"
    names, kinds = [f.name for f in kept], {f.name: f for f in rows.schema}
    inner = StructType([*[kinds[c] for c in fields], *[StructField(f"rank_{c}", IntegerType()) for c in scores]])

    def gather(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole(batches, edge):
            species = batch.column("species").to_numpy(zero_copy_only=False)
            for which, at, own in _classes(starts, batch.num_rows, species):
                orders = [_sorted(batch.column(c).to_numpy(zero_copy_only=False), at, own) for c in scores]
                flat = pa.array(at[own])
                ranks = [np.argsort(order, axis=1).astype(np.int32)[own] + np.int32(1) for order, _ in orders]
                items = pa.StructArray.from_arrays([*[batch.column(c).take(flat) for c in fields], *map(pa.array, ranks)], inner.names)
                first = pa.array(starts[which])
                out = [*[batch.column(c).take(first) for c in names], pa.ListArray.from_arrays(_lists(own, own)[0], items), *[_ranking(m, own) for _, m in orders]]
                yield pa.RecordBatch.from_arrays(out, [*names, "c", *[f"s_{c}" for c in scores]])

    schema = StructType([*kept, StructField("c", ArrayType(inner))])
    for c in scores:
        schema = schema.add(f"s_{c}", _MEMBERS)
    return rows.mapInArrow(gather, schema)


def reached(s: Column, threshold: Column) -> Column:
    """How many of a ranking's members reach a threshold."""
    return F.size(F.filter(s, lambda x: -x["v"] >= threshold))


def best_length(s: Column, scale: Column, low: int, high: int) -> Column:
    """The length in low..high with the largest 2 S_k / (k + scale * sum of all + 1e-8) along a ranking, the first of equals."""
    total = F.get(s, F.size(s) - 1)["u"]
    each = F.transform(F.sequence(F.lit(low), F.greatest(F.lit(low), F.least(F.lit(high), F.size(s)))), lambda k: F.struct(F.round(2 * F.get(s, F.least(k, F.size(s)) - 1)["u"] / (k + scale * total + 1e-8), 9).alias("v"), (-k).alias("minus")))
    return -F.array_max(each)["minus"]


def placed(rows: DataFrame, scores: list[str], lengths: tuple[str, list[float], int, int] | None = None, reach: tuple[str, list[float]] | None = None) -> DataFrame:
    """``rows`` (a row a candidate, a survey's following each other) with ``size`` of the survey and ``rank_`` of each score, ties by species.

    ``lengths`` (score, scales, low, high) adds ``best``: for each scale the length that ``best_length`` gives; ``reach``
    (score, thresholds) adds how many candidates reach each threshold.  Rows come back by survey, in the order of species.
    """
    edge = "_row" if "_row" in rows.columns else "survey"
    names = rows.columns
    schema = StructType([*rows.schema.fields, StructField("size", IntegerType()), *[StructField(f"rank_{c}", IntegerType()) for c in scores]])
    if lengths:
        schema = schema.add("best", ArrayType(IntegerType()))
    if reach:
        schema = schema.add("reach", ArrayType(IntegerType()))

    def spread(each: np.ndarray, own: np.ndarray) -> pa.Array:
        """A row's list beside each of its candidates."""
        flat = np.repeat(each.astype(np.int32), own.sum(axis=1), axis=0)
        return pa.ListArray.from_arrays(pa.array(np.arange(len(flat) + 1, dtype=np.int32) * each.shape[1]), pa.array(flat.ravel()))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole(batches, edge):
            species = batch.column("species").to_numpy(zero_copy_only=False)
            for _, at, own in _classes(starts, batch.num_rows, species):
                orders = {c: _sorted(batch.column(c).to_numpy(zero_copy_only=False), at, own) for c in scores}
                flat, sizes = pa.array(at[own]), own.sum(axis=1)
                ranks = [pa.array(np.argsort(order, axis=1).astype(np.int32)[own] + np.int32(1)) for order, _ in orders.values()]
                out = [*[x.take(flat) for x in batch.columns], pa.array(np.repeat(sizes.astype(np.int32), sizes)), *ranks]
                if lengths:
                    score, scales, low, high = lengths
                    upto = np.cumsum(np.where(own, -orders[score][1], 0.0), axis=1)
                    total = np.take_along_axis(upto, sizes[:, None] - 1, 1)
                    k = np.arange(low, max(low, high) + 1)
                    u = np.take_along_axis(upto, np.minimum(k, sizes[:, None]) - 1, 1)
                    there = k <= np.maximum(low, np.minimum(high, sizes))[:, None]
                    best = [low + np.where(there, rounded((2 * u / (k + s * total + 1e-8)).ravel()).reshape(u.shape), -np.inf).argmax(axis=1) for s in scales]
                    out.append(spread(np.stack(best, axis=1), own))
                if reach:
                    score, thresholds = reach
                    out.append(spread(np.stack([(own & (-orders[score][1] >= t)).sum(axis=1) for t in thresholds], axis=1), own))
                yield pa.RecordBatch.from_arrays(out, [*names, *schema.names[len(names) :]])

    return rows.mapInArrow(place, schema)


def swapped(rows: DataFrame, policies: DataFrame, base: str, given: list[str], value: Callable, allowed: Callable, gain: Callable, kept: float, most: int, keys: list[str], by: list[str] | None = None) -> DataFrame:
    """As ``ranked``, for policies that swap members of a list for outsiders, at most ``swaps`` of a policy.

    The field ``base`` is the rank in the list, or null.  ``value(x, k)`` and ``allowed(x, k)`` work on arrays as in ``ranked``.
    The first ceil(kept * length) stay.  The i-th worst of the rest by ``value`` meets the i-th best outsider that ``allowed`` lets in; a pair swaps while ``gain(low, high)`` holds, which fails for all
    after the first that fails, since pairs get worse.  ``most`` bounds all policies' swaps.
    """
    index, table, stay, flat, edge = _shared(rows, policies, keys)
    x = F.col("_x")
    flat = flat.select(*[f.name for f in stay], *([edge] if edge == "_row" else []), x["species"].cast("long").alias("_species"), x["hit"].cast("int").alias("_hit"), F.coalesce(x[base], F.lit(0)).cast("int").alias("_base"), *_given(flat, given))
    names = [f.name for f in stay]

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, starts in _whole(batches, edge):
            species, hit, listed = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("_species", "_hit", "_base"))
            each = [(_arrays(batch, given), dict(zip(keys, own))) for own in index]
            values, let = [rounded(value(*e)) for e in each], [allowed(*e) for e in each]
            for which, at, own in _classes(starts, batch.num_rows, species):
                first = pa.array(starts[which])
                columns = [batch.column(c).take(first) for c in names]
                b = np.where(own, listed[at], 0)
                size, marks = (b > 0).sum(axis=1).astype(np.int32), hit[at]
                hits = np.where(b > 0, marks, 0).sum(axis=1).astype(np.int32)
                tail, down = b > np.ceil(size * kept)[:, None], np.argsort(-b, axis=1, kind="stable")
                for i, v in enumerate(values):
                    m = np.where(tail, v[at], np.inf)
                    low = np.take_along_axis(down, np.argsort(np.take_along_axis(m, down, 1), axis=1, kind="stable"), 1)[:, :most]
                    into = own & (b == 0) & let[i][at]
                    w = np.where(into, -v[at], np.inf)
                    high = np.argsort(w, axis=1, kind="stable")[:, :most]
                    there = np.arange(low.shape[1]) < np.minimum(tail.sum(axis=1), into.sum(axis=1))[:, None]
                    more = np.cumsum(np.where(there, np.take_along_axis(marks, high, 1) - np.take_along_axis(marks, low, 1), 0), axis=1).astype(np.int32)
                    offsets, lows = _lists(np.take_along_axis(m, low, 1), there)
                    pairs = pa.StructArray.from_arrays([pa.array(lows), pa.array(-_lists(np.take_along_axis(w, high, 1), there)[1]), pa.array(_lists(more, there)[1])], ["low", "high", "more"])
                    out = [*columns, pa.array(np.full(len(which), i, np.int32)), pa.array(size), pa.array(hits), pa.ListArray.from_arrays(offsets, pairs)]
                    yield pa.RecordBatch.from_arrays(out, [*names, "_key", "_n", "_h", "_s"])

    pairs = ArrayType(StructType().add("low", "double").add("high", "double").add("more", IntegerType()))
    schema = StructType([*stay, StructField("_key", IntegerType()), StructField("_n", IntegerType()), StructField("_h", IntegerType()), StructField("_s", pairs)])
    each = flat.mapInArrow(swap, schema).join(F.broadcast(table), "_key")
    good = F.size(F.filter("_s", lambda p: gain(p["low"], p["high"])))
    more = F.coalesce(F.get("_s", F.least(good, F.col("_p.swaps")) - 1)["more"], F.lit(0))
    done = each.select("survey", *(by or []), "truth", F.col("_p.place").alias("place"), F.col("_n").alias("n"), (F.col("_h") + more).alias("hits"))
    return done.withColumn("f1", 2 * F.col("hits") / F.greatest(F.col("n") + F.col("truth"), F.lit(1)))


def edited(rows: DataFrame, policies: DataFrame, base: Callable, gain: Callable, low: int, high: int, kept: float, most: int) -> DataFrame:
    """As ``ranked``, for policies of paired swaps and then one-sided edits by gains above a margin (swaps, delta, margin)."""
    each = rows.join(F.broadcast(policies.select("place", "swaps", "delta", "margin")), F.lit(True)).withColumn("n0", F.size(F.filter("c", lambda x: base(x).isNotNull())))
    order = lambda side: F.slice(F.sort_array(F.transform(side, lambda x: F.struct(gain(x).alias("gain"), x["species"].alias("species"), x["hit"].alias("hit"))), False), 1, most)
    each = each.withColumn("_out", order(F.filter("c", lambda x: base(x) > F.ceil(F.col("n0") * kept)))).withColumn("_in", order(F.filter("c", lambda x: base(x).isNull())))
    sums = F.zip_with(F.slice("_out", 1, F.col("swaps")), F.slice("_in", 1, F.col("swaps")), lambda o, i: F.round(o["gain"] + i["gain"], 9))
    each = each.withColumn("_s", F.size(F.filter(sums, lambda x: x > F.col("margin"))))  # null beyond the shorter side
    plus, minus = F.get("_in", F.col("_s"))["gain"], F.get("_out", F.col("_s"))["gain"]
    best_in, best_out = F.when((F.col("n0") < high) & (plus > F.col("margin")), plus), F.when((F.col("n0") > low) & (minus > F.col("margin")), minus)
    grow = F.when(best_in.isNotNull() & (best_out.isNull() | (plus >= minus)), 1).when(best_out.isNotNull(), -1).otherwise(0)
    each = each.withColumn("_way", grow)
    room = F.when(F.col("_way") > 0, F.least("delta", high - F.col("n0"))).when(F.col("_way") < 0, F.least("delta", F.col("n0") - low)).otherwise(0)
    each = each.withColumn("_room", room)
    more = lambda side: F.size(F.filter(F.slice(side, F.col("_s") + 1, F.col("_room")), lambda e: e["gain"] > F.col("margin")))
    each = each.withColumn("_i", F.col("_s") + F.when(F.col("_way") > 0, more("_in")).otherwise(0)).withColumn("_o", F.col("_s") + F.when(F.col("_way") < 0, more("_out")).otherwise(0))
    own = F.size(F.filter("c", lambda x: base(x).isNotNull() & (x["hit"] == 1)))
    hits = own + _hits(F.slice("_in", 1, F.col("_i"))) - _hits(F.slice("_out", 1, F.col("_o")))
    done = each.select("survey", "truth", "place", (F.col("n0") + F.col("_i") - F.col("_o")).alias("n"), hits.alias("hits"))
    return done.withColumn("f1", 2 * F.col("hits") / F.greatest(F.col("n") + F.col("truth"), F.lit(1)))


def chosen(each: DataFrame, policies: DataFrame, smaller: list[Column], by: list[str] | None = None) -> DataFrame:
    """A row a policy: place, surveys, f1 and choice; exact ties go to the smaller intervention, then to the earlier policy."""
    means = each.groupBy(*(by or []), "place").agg(F.count("*").alias("surveys"), F.round(F.avg("f1"), 9).alias("f1"))
    order = Window.partitionBy(*(by or [])).orderBy(F.desc("f1"), *smaller, "place")  # a row a policy
    full = means.join(F.broadcast(policies), [*(by or []), "place"])
    return full.select(*(by or []), "place", "surveys", F.round("f1", 6).alias("f1"), F.row_number().over(order).alias("choice"))
