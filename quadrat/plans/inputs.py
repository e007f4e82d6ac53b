"""Queries over model inputs: static columns, availability flags, views of images, label matrices, risk gates, edit features."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import features as E
from quadrat.functions import geo as G
from quadrat.operators import ranking as R
from quadrat.plans.splits import sha
from quadrat.registry import register
from quadrat.sources import tables as T
from quadrat.sources.tables import sql

FREQUENCIES, BUCKETS = (1, 2, 4, 8, 16), 24
_WAVES = [(f, c, k) for k in FREQUENCIES for c in ("lat", "lon") for f in ("sin", "cos")]
_PHASE = "2 * pi() * (month - 1 + (day - 1) / 31::DOUBLE) / 12"


def _waves() -> dict[str, Column]:
    return {f"{f}_{c}_{k}": getattr(F, f)(F.radians(c) * k) for f, c, k in _WAVES}


def _season() -> dict[str, Column]:
    phase = 2 * math.pi * (F.col("month") - 1 + (F.col("day") - 1) / F.lit(31.0)) / 12
    return {"s1": F.sin(phase), "c1": F.cos(phase), "s2": F.sin(2 * phase), "c2": F.cos(2 * phase)}


_WAVES_SQL = ", ".join(f"round({f}(radians({c}) * {k}), 6) AS {f}_{c}_{k}" for f, c, k in _WAVES)


@register("static_columns", sql(f"""
    SELECT survey, lat, lon, year, month, day, round(ln(1 + greatest(coalesce(price, 0), 0)), 6) AS uncertainty, round(ln(1 + 0), 6) AS area, {_WAVES_SQL}, round(sin({_PHASE}), 6) AS s1, round(cos({_PHASE}), 6) AS c1, round(sin(2 * {_PHASE}), 6) AS s2, round(cos(2 * {_PHASE}), 6) AS c2,
        {", ".join(f"({sha("'country:' || country", BUCKETS)} = {i})::INT AS country_{i}" for i in range(BUCKETS))} FROM surveys""", "surveys"))
def static_columns(spark: SparkSession, d: str) -> DataFrame:
    """The 55 static columns: place and date, logs of uncertainty and area (0 where absent), waves of the place, the season, and the country's bucket."""
    s = T.surveys(spark, d).withColumn("bucket", G.sha_bucket(F.concat(F.lit("country:"), F.col("country")), BUCKETS))
    logs = {"uncertainty": F.log1p(F.greatest(F.coalesce("price", F.lit(0.0)), F.lit(0.0))), "area": F.log1p(F.lit(0.0))}
    real = {n: F.round(c, 6) for n, c in {**logs, **_waves(), **_season()}.items()}
    return s.select("survey", "lat", "lon", "year", "month", "day", *[c.alias(n) for n, c in real.items()], *[(F.col("bucket") == i).cast("int").alias(f"country_{i}") for i in range(BUCKETS)])


@register("static_variants", sql(f"""
    SELECT survey, lon, lat, year, round(ln(1 + price), 6) AS log_uncertainty, round(ln(1 + price / 2), 6) AS log_area, {", ".join(f"round({f}(radians({c}) * {k}), 6) AS {f}_{c}_{k}" for f, c, k in _WAVES if k <= 8)},
        {", ".join(f"(country = 'NATION_{i}')::INT AS c{i}" for i in range(4))}, (country NOT IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3'))::INT AS c_other FROM surveys""", "surveys"))
def static_variants(spark: SparkSession, d: str) -> DataFrame:
    """The 21 static columns of the basic form with the country's one-hot; the ecological form is the two logs of them."""
    s = T.surveys(spark, d)
    logs = {"log_uncertainty": F.log1p("price"), "log_area": F.log1p(F.col("price") / 2)}
    real = {n: F.round(c, 6) for n, c in {**logs, **{n: c for n, c in _waves().items() if not n.endswith("_16")}}.items()}
    hot = E.one_hot(F.col("country"), [f"NATION_{i}" for i in range(4)])
    return s.select("survey", "lon", "lat", "year", *[c.alias(n) for n, c in real.items()], *[c.alias(n) for c, n in zip(hot, ["c0", "c1", "c2", "c3", "c_other"])])


@register("reflectance", "SELECT l_orderkey AS survey, l_linenumber AS line, least(greatest(l_extendedprice / 10000, 0), 2)::DOUBLE AS reflectance FROM lineitem")
def reflectance(spark: SparkSession, d: str) -> DataFrame:
    """A fixed scale: x / 10000 between 0 and 2."""
    x = F.least(F.greatest(F.col("l_extendedprice") / 10000, F.lit(0.0)), F.lit(2.0))
    return T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("survey"), F.col("l_linenumber").alias("line"), x.cast("double").alias("reflectance"))


@register("expert_features", sql("""
    WITH e AS (SELECT survey, CASE WHEN survey % 17 = 0 THEN NULL ELSE price END AS price FROM surveys)
    SELECT survey, round(lat / 90, 6) AS f0, round(lon / 180, 6) AS f1, round(coalesce(ln(1 + e.price), 0), 6) AS f2, (e.price IS NOT NULL)::INT::DOUBLE AS f3 FROM surveys JOIN e USING (survey)""", "surveys"))
def expert_features(spark: SparkSession, d: str) -> DataFrame:
    """Geography, environment and a flag in one vector; where the environment is absent its part is 0 and so is the flag."""
    price = F.when(F.col("survey") % 17 != 0, F.col("price"))
    vector = E.with_flag(F.array(F.col("lat") / 90, F.col("lon") / 180), F.array(F.log1p(price)), price.isNotNull())
    return T.surveys(spark, d).select("survey", *[F.round(vector[i], 6).alias(f"f{i}") for i in range(4)])


@register("image_views", """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64), i AS (SELECT i FROM generate_series(0, 63) AS g(i))
    SELECT vec_id, i::INT AS cell, e[i + 1] AS plain, e[i // 8 * 8 + 7 - i % 8 + 1] AS mirrored, e[(7 - i // 8) * 8 + i % 8 + 1] AS upside, e[i % 8 * 8 + 7 - i // 8 + 1] AS turned,
        round((e[i + 1] + e[i // 8 * 8 + 7 - i % 8 + 1] + e[(7 - i // 8) * 8 + i % 8 + 1] + e[63 - i + 1]) / 4, 9) AS mean FROM v CROSS JOIN i""")
def image_views(spark: SparkSession, d: str) -> DataFrame:
    """A flat image of width 8 as it is, mirrored, upside down and turned by a quarter, and the mean of its four flips."""
    e = F.col("e")
    views = {"plain": e, "mirrored": E.flipped(e, 8, False, True), "upside": E.flipped(e, 8, True, False), "turned": E.quarter_turn(e, 8), "both": E.flipped(e, 8, True, True)}
    v = T.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where(F.size("e") == 64)
    cells = v.select("vec_id", *[c.alias(n) for n, c in views.items()]).select("vec_id", F.posexplode(F.arrays_zip(*views)).alias("cell", "z"))
    z = {n: F.col(f"z.{n}") for n in views}
    return cells.select("vec_id", "cell", *[z[n].alias(n) for n in ("plain", "mirrored", "upside", "turned")], F.round((z["plain"] + z["mirrored"] + z["upside"] + z["both"]) / 4, 9).alias("mean"))


@register("label_matrix", sql("""
    WITH r AS (SELECT o_orderkey AS survey, row_number() OVER (ORDER BY o_orderkey) - 1 AS row FROM (SELECT DISTINCT o_orderkey FROM orders))
    SELECT row, col FROM pairs JOIN r USING (survey) JOIN vocabulary USING (species)""", "pairs", "vocabulary"))
def label_matrix(spark: SparkSession, d: str) -> DataFrame:
    """(row, col) of every label; raises where a label's survey or species has no index."""
    from quadrat.operators.labels import dense_index

    rows = dense_index(T.table(spark, d, "orders").select(F.col("o_orderkey").alias("survey")), "survey", "row")
    placed = T.pairs(spark, d).join(rows, "survey", "left").join(T.vocabulary(spark, d), "species", "left")
    lost = placed.agg(F.count_if(F.col("row").isNull() | F.col("col").isNull())).first()[0]
    if lost:
        raise ValueError(f"{lost} labels have no row or column")
    return placed.select("row", "col")


_PARTS = """parts AS (SELECT survey, country, least(greatest(ln(1 + abs(lat - 48) * 111) / ln(201::DOUBLE), 0), 1) AS pa,
        0.5 * (least(greatest(ln(1 + abs(lon - 7) * 75) / ln(101::DOUBLE), 0), 1) + 1 - least(greatest(ln(1 + survey % 64) / ln(65::DOUBLE), 0), 1)) AS po, least(greatest((survey % 100) / 1000::DOUBLE / 0.05, 0), 1) AS dis FROM surveys),
    counts AS (SELECT country, count(*) AS n FROM surveys WHERE survey % 5 <> 0 GROUP BY 1), scale AS (SELECT greatest(quantile_cont(n, 0.75), 1) AS q FROM counts)"""


@register("risk_gates", sql(f"""
    WITH {_PARTS} SELECT survey, round(1.0, 6)::DOUBLE AS uniform, round(pa, 6) AS pa_distance, round(0.6 * pa + 0.4 * po, 6) AS pa_po, round(0.45 * pa + 0.30 * po + 0.25 * dis, 6) AS pa_po_disagreement,
        round(least(greatest((0.55 * pa + 0.45 * (1 - least(greatest(ln(1 + coalesce(n, 0)) / ln(1 + q), 0), 1))) * least(greatest(ln(1 + survey % 64) / ln(25::DOUBLE), 0), 1) * (0.55 + 0.45 * least(greatest((survey % 10) / 10::DOUBLE, 0), 1)), 0), 1), 6) AS shift
    FROM parts LEFT JOIN counts USING (country) CROSS JOIN scale""", "surveys"))
def risk_gates(spark: SparkSession, d: str) -> DataFrame:
    """Three components of the risk of a survey, the four gates over them, and the gate for scarce regions where other evidence agrees.

    The quartile over countries is one of a few hundred counts.
    """
    s = T.surveys(spark, d)
    unit = lambda c: F.least(F.greatest(c, F.lit(0.0)), F.lit(1.0))
    signal = lambda full: unit(F.log1p(F.col("survey") % 64) / math.log(full))
    pa, dis = R.log_ramp(F.abs(F.col("lat") - 48) * 111, 201.0), unit(F.col("survey") % 100 / F.lit(1000.0) / 0.05)
    po = 0.5 * (R.log_ramp(F.abs(F.col("lon") - 7) * 75, 101.0) + 1 - signal(65.0))
    counts = s.where("survey % 5 <> 0").groupBy("country").agg(F.count("*").alias("n"))
    scale = counts.agg(F.greatest(F.percentile("n", 0.75), F.lit(1.0)).alias("q"))
    full = s.join(F.broadcast(counts), "country", "left").na.fill(0, ["n"]).join(F.broadcast(scale), F.lit(True))
    scarce = 1 - unit(F.log1p("n") / F.log1p("q"))
    shift = unit((0.55 * pa + 0.45 * scarce) * signal(25.0) * (0.55 + 0.45 * unit(F.col("survey") % 10 / F.lit(10.0))))
    gates = {"uniform": F.lit(1.0), "pa_distance": pa, "pa_po": 0.6 * pa + 0.4 * po, "pa_po_disagreement": 0.45 * pa + 0.30 * po + 0.25 * dis, "shift": shift}
    return full.select("survey", *[F.round(c, 6).alias(n) for n, c in gates.items()])


_EDIT = """r AS (SELECT survey, species, p, q, row_number() OVER (PARTITION BY survey ORDER BY p DESC, species) AS rp, row_number() OVER (PARTITION BY survey ORDER BY q DESC, species) AS rq, row_number() OVER (PARTITION BY survey ORDER BY p + q DESC, species) AS rb FROM scores),
    l AS (SELECT survey, min(p) FILTER (rp <= 16) AS lp, min(q) FILTER (rq <= 16) AS lq, sum(p) FILTER (rp <= 16) AS tp, sum(q) FILTER (rq <= 16) AS tq, sum(p) FILTER (rp <= 10) AS hp, sum(q) FILTER (rq <= 10) AS hq, count(*) FILTER (rb <= 12) AS n FROM r GROUP BY 1),
    x AS (SELECT survey, species, (rb <= 12)::INT AS inside, CASE WHEN rb <= 12 THEN rb - 1 ELSE 40 END / 40::DOUBLE AS place, n / 40::DOUBLE AS size, CASE WHEN rp <= 16 THEN p ELSE lp * 0.5 END AS vp, CASE WHEN rq <= 16 THEN q ELSE lq * 0.5 END AS vq,
        least(rp - 1, 16) / 128::DOUBLE AS kp, least(rq - 1, 16) / 128::DOUBLE AS kq, (rp > 16)::INT AS mp, (rq > 16)::INT AS mq, tp, tq, hp, hq, lp, lq FROM r JOIN l USING (survey) WHERE rb <= 12 OR rp <= 16 OR rq <= 16)"""


@register("edit_columns", sql(f"""
    WITH {_EDIT} SELECT survey, species, inside, round(place, 6) AS place, round(size, 6) AS size, round(vp, 6) AS vp, round(vq, 6) AS vq, round(kp, 6) AS kp, round(kq, 6) AS kq, mp, mq, round(vp * vq, 6) AS product, round(vp - vq, 6) AS difference,
        round(sum(vp * inside) OVER w / 40, 6) AS inside_p, round(sum(vq * inside) OVER w / 40, 6) AS inside_q, round(tp / 40, 6) AS total_p, round(tq / 40, 6) AS total_q, round(hp / 40, 6) AS head_p, round(hq / 40, 6) AS head_q, round(lp, 6) AS last_p, round(lq, 6) AS last_q FROM x WINDOW w AS (PARTITION BY survey)""", "scores"))
def edit_columns(spark: SparkSession, d: str) -> DataFrame:
    """The 19 label-free columns of every candidate of an edit: the list and what two experts rank first.

    A probability that an expert's list does not hold is half its last one, with a flag; sums are over 40.
    """
    return E.edit_columns(T.marked(spark, d), 12, 16)


@register("richness_counts", sql("SELECT survey, least(greatest(exp(ln(1 + n)) - 1, 12), 32)::DOUBLE AS narrow, least(greatest(exp(ln(1 + n)) - 1, 8), 40)::DOUBLE AS wide FROM (SELECT survey, count(*) * 2 AS n FROM pairs GROUP BY 1)".replace("exp(ln(1 + n)) - 1", "round(exp(ln(1 + n)) - 1, 6)"), "pairs"))
def richness_counts(spark: SparkSession, d: str) -> DataFrame:
    """A predicted log richness as a length, kept within 12..32 and within 8..40."""
    n = T.pairs(spark, d).groupBy("survey").agg((F.count("*") * 2).alias("n"))
    value = F.round(F.expm1(F.log1p("n")), 6)
    return n.select("survey", *[F.least(F.greatest(value, F.lit(a)), F.lit(z)).alias(c) for c, a, z in (("narrow", 12.0, 32.0), ("wide", 8.0, 40.0))])


@register("fold_union", sql("""
    WITH f AS (SELECT survey, survey % 2 AS fold FROM surveys) SELECT fold, count(*) AS n, count(DISTINCT survey) AS distinct_, count(*) = count(DISTINCT survey) AS is_unique FROM f GROUP BY 1
    UNION ALL SELECT -1, count(*), count(DISTINCT survey), count(*) = count(DISTINCT survey) FROM f""", "surveys"))
def fold_union(spark: SparkSession, d: str) -> DataFrame:
    """Frames of folds in one, with the proof that no survey stands in two."""
    s = T.surveys(spark, d)
    frames = [s.where(F.col("survey") % 2 == f).select("survey", F.lit(f).cast("long").alias("fold")) for f in (0, 1)]
    every = frames[0].unionByName(frames[1])
    own = lambda df: df.agg(F.count("*").alias("n"), F.count_distinct("survey").alias("distinct_"))
    out = own(every.groupBy("fold")).unionByName(own(every).select(F.lit(-1).cast("long").alias("fold"), "n", "distinct_"))
    return out.withColumn("is_unique", F.col("n") == F.col("distinct_"))


@register("id_set_equality", """
    WITH a AS (SELECT DISTINCT o_orderkey AS id FROM orders WHERE o_orderkey % 50 <> 0), b AS (SELECT DISTINCT l_orderkey AS id FROM lineitem WHERE l_orderkey % 75 <> 0)
    SELECT (SELECT count(*) FROM a ANTI JOIN b USING (id)) AS absent, (SELECT count(*) FROM b ANTI JOIN a USING (id)) AS "foreign", (SELECT count(*) FROM a ANTI JOIN b USING (id)) + (SELECT count(*) FROM b ANTI JOIN a USING (id)) = 0 AS equal_""")
def id_set_equality(spark: SparkSession, d: str) -> DataFrame:
    """Ids of a template that a submission lacks and ids that the template does not know, from one full join."""
    a = T.table(spark, d, "orders").where("o_orderkey % 50 <> 0").select(F.col("o_orderkey").alias("id"), F.lit(True).alias("a")).distinct()
    b = T.table(spark, d, "lineitem").where("l_orderkey % 75 <> 0").select(F.col("l_orderkey").alias("id"), F.lit(True).alias("b")).distinct()
    both = a.join(b, "id", "full").agg(F.count_if(F.col("b").isNull()).alias("absent"), F.count_if(F.col("a").isNull()).alias("foreign"))
    return both.withColumn("equal_", (F.col("absent") + F.col("foreign")) == 0)
