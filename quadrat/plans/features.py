"""Queries over features: coordinates, seasons, arrays, normalisation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import features as E
from quadrat.functions import text as X
from quadrat.operators.stats import quantiles
from quadrat.registry import register
from quadrat.sources import tables as T
from quadrat.sources.tables import sql

_FOURIER = ", ".join(f"round({f}(radians({c}) * {1 << k}), 6) AS {f}_{c}_{k}" for c in ("lat", "lon") for k in range(4) for f in ("sin", "cos"))


@register("fourier_features", sql(f"SELECT site, round(lat / 90, 6) AS lat, round(lon / 180, 6) AS lon, {_FOURIER} FROM (SELECT site, lat, lon FROM sites)".replace("round(lat / 90, 6) AS lat, round(lon / 180, 6) AS lon", "round(lat / 90, 6) AS lat_unit, round(lon / 180, 6) AS lon_unit"), "sites"))
def fourier_features(spark: SparkSession, d: str) -> DataFrame:
    return T.sites(spark, d).select("site", *[F.round(c, 6).alias(n) for n, c in E.fourier(F.col("lat"), F.col("lon"), 4).items()])


@register("static_features", sql("""
    SELECT survey, round(ln(1 + price), 6) AS log_price, year, round(sin(2 * pi() * (month - 1 + (day - 1) / 31::DOUBLE) / 12), 6) AS season_sin, round(cos(2 * pi() * (month - 1 + (day - 1) / 31::DOUBLE) / 12), 6) AS season_cos FROM surveys""", "surveys"))
def static_features(spark: SparkSession, d: str) -> DataFrame:
    s, c = E.season(F.col("month"), F.col("day"))
    return T.surveys(spark, d).select("survey", F.round(F.log1p("price"), 6).alias("log_price"), "year", F.round(s, 6).alias("season_sin"), F.round(c, 6).alias("season_cos"))


@register("country_one_hot", sql("SELECT site, " + ", ".join(f"(country = 'NATION_{i}')::INT AS c{i}" for i in range(4)) + ", (country NOT IN ('NATION_0', 'NATION_1', 'NATION_2', 'NATION_3'))::INT AS other FROM sites", "sites"))
def country_one_hot(spark: SparkSession, d: str) -> DataFrame:
    names = [f"NATION_{i}" for i in range(4)]
    return T.sites(spark, d).select("site", *[c.alias(n) for c, n in zip(E.one_hot(F.col("country"), names), ["c0", "c1", "c2", "c3", "other"])])


@register("z_scores", """
    WITH x AS (SELECT o_orderkey AS survey, CASE WHEN o_orderkey % 17 = 0 THEN NULL ELSE o_totalprice END AS price FROM orders),
    s AS (SELECT avg(price) AS m, stddev_pop(price) AS sd FROM x WHERE survey % 5 <> 0)
    SELECT survey, round(coalesce(least(greatest((price - m) / CASE WHEN sd < 1e-6 THEN 1 ELSE sd END, -12), 12), 0), 5) AS z FROM x CROSS JOIN s""")
def z_scores(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    x = T.table(spark, d, "orders").select(k.alias("survey"), F.when(k % 17 != 0, F.col("o_totalprice")).alias("price"))
    return E.standardised(x, ["price"], F.col("survey") % 5 != 0, 12.0).select("survey", F.round("price", 5).alias("z"))


_SERIES = "s AS (SELECT user_id, list(value ORDER BY ts, event_id) AS a FROM events GROUP BY 1)"


def _series(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").groupBy("user_id").agg(F.sort_array(F.collect_list(F.struct("ts", "event_id", "value"))).alias("e"))
    return e.select("user_id", F.col("e.value").alias("a"))


@register("channel_summary", """
    SELECT user_id, round(avg(value), 4) AS mean, round(stddev_pop(value), 4) AS dev, min(value) AS low, max(value) AS high,
           round(quantile_cont(value, 0.1), 4) AS q10, round(quantile_cont(value, 0.5), 4) AS q50, round(quantile_cont(value, 0.9), 4) AS q90 FROM events GROUP BY 1""")
def channel_summary(spark: SparkSession, d: str) -> DataFrame:
    e = T.table(spark, d, "events").select("user_id", "value")
    g = e.groupBy("user_id").agg(F.avg("value").alias("mean"), F.stddev_pop("value").alias("dev"), F.min("value").alias("low"), F.max("value").alias("high"))
    return g.join(quantiles(e, ["user_id"], "value", [0.1, 0.5, 0.9]), "user_id").select("user_id", F.round("mean", 4).alias("mean"), F.round("dev", 4).alias("dev"), "low", "high", *[F.round(F.col("q")[i], 4).alias(n) for i, n in enumerate(("q10", "q50", "q90"))])


@register("binned_means", f"""
    WITH {_SERIES}, x AS (SELECT user_id, len(a) AS n, unnest(a) AS v, generate_subscripts(a, 1) - 1 AS i FROM s)
    SELECT user_id, (i * 4 // n)::INT AS bin, round(avg(v), 9) AS mean FROM x GROUP BY ALL""")
def binned_means(spark: SparkSession, d: str) -> DataFrame:
    return E.binned_means(_series(spark, d), "user_id", "a", 4).withColumn("mean", F.round("mean", 9))


@register("fill_values", "SELECT event_id, CASE WHEN event_id % 19 = 0 OR abs(value) > 100 THEN 0 ELSE value END AS value FROM events")
def fill_values(spark: SparkSession, d: str) -> DataFrame:
    dirty = F.when(F.col("event_id") % 19 == 0, float("inf")).otherwise(F.col("value"))
    return T.table(spark, d, "events").select("event_id", E.without_fill(F.array(dirty), 100.0)[0].alias("value"))


@register("band_indices", """
    WITH b AS (SELECT l_orderkey AS survey, l_linenumber AS line, l_quantity AS nir, l_extendedprice / 1000 AS red, l_tax * 100 AS blue, l_discount * 100 AS green FROM lineitem)
    SELECT survey, line, round((nir - red) / (nir + red + 1e-4), 6) AS ndvi, round((green - nir) / (green + nir + 1e-4), 6) AS ndwi,
           round(least(greatest(2.5 * (nir - red) / (CASE WHEN abs(nir + 6 * red - 7.5 * blue + 1) < 1e-4 THEN 1e-4 ELSE nir + 6 * red - 7.5 * blue + 1 END), -3), 3), 6) AS evi FROM b""")
def band_indices(spark: SparkSession, d: str) -> DataFrame:
    b = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("survey"), F.col("l_linenumber").alias("line"), F.col("l_quantity").alias("nir"), (F.col("l_extendedprice") / 1000).alias("red"), (F.col("l_tax") * 100).alias("blue"), (F.col("l_discount") * 100).alias("green"))
    ratio = lambda x, y: F.round(E.normalised_difference(F.col(x), F.col(y)), 6)
    return b.select("survey", "line", ratio("nir", "red").alias("ndvi"), ratio("green", "nir").alias("ndwi"), F.round(E.enhanced_vegetation(F.col("nir"), F.col("red"), F.col("blue")), 6).alias("evi"))


@register("percentile_stretch", """
    WITH q AS (SELECT event_type, quantile_cont(value, 0.02) AS a, quantile_cont(value, 0.98) AS z FROM events GROUP BY 1)
    SELECT event_id, round(least(greatest((value - a) / greatest(z - a, 1e-6), 0), 1), 6) AS value FROM events JOIN q USING (event_type)""")
def percentile_stretch(spark: SparkSession, d: str) -> DataFrame:
    return E.stretched(T.table(spark, d, "events"), "event_type", "value", 0.02, 0.98).select("event_id", F.round("value", 6).alias("value"))


@register("cube_permute", """
    WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings WHERE len(embedding) = 64), i AS (SELECT i FROM generate_series(0, 63) AS g(i))
    SELECT vec_id, i::INT AS cell, e[i % 4 * 16 + i // 4 % 4 * 4 + i // 16 + 1] AS value FROM v CROSS JOIN i""")
def cube_permute(spark: SparkSession, d: str) -> DataFrame:
    """Every cell of the turned cube: element [i, j, k] is [k, j, i] of the first."""
    v = T.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where(F.size("e") == 64)
    return v.select("vec_id", F.posexplode(E.permuted(F.col("e"), (4, 4, 4), (2, 1, 0))).alias("cell", "value"))


@register("block_pooling", """
    SELECT vec_id, cell, round(avg(x), 6) AS mean FROM (SELECT vec_id, unnest(embedding)::DOUBLE AS x, ((generate_subscripts(embedding, 1) - 1) // 16 * 4 + (generate_subscripts(embedding, 1) - 1) % 8 // 2)::INT AS cell FROM embeddings) GROUP BY ALL""")
def block_pooling(spark: SparkSession, d: str) -> DataFrame:
    v = T.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e"))
    return E.pooled(v, "vec_id", "e", 8, 2).withColumn("mean", F.round("mean", 6))


@register("score_parsing", """
    SELECT event_id, CASE WHEN event_id % 4 = 0 THEN NULL WHEN event_id % 4 = 1 THEN NULL ELSE value END AS score FROM events""")
def score_parsing(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("event_id") % 4
    text = F.when(k == 0, F.lit(" None ")).when(k == 1, F.lit("nan")).otherwise(F.col("value").cast("string"))
    return T.table(spark, d, "events").select("event_id", E.parsed(text).alias("score"))


@register("json_fields", """
    SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k, CASE WHEN json_extract(props, '$.k') IS NOT NULL THEN '{"event":' || event_id || ',"k":' || CAST(json_extract(props, '$.k') AS BIGINT) || '}' END AS encoded FROM events""")
def json_fields(spark: SparkSession, d: str) -> DataFrame:
    """A field read from a JSON text, and a record written as one."""
    e = T.table(spark, d, "events").select("event_id", F.from_json("props", "k long")["k"].alias("k"))
    record = F.to_json(F.struct(F.col("event_id").alias("event"), "k"))
    return e.select("event_id", "k", F.when(F.col("k").isNotNull(), record).alias("encoded"))


@register("redacted_urls", "SELECT page_id, regexp_replace(url, '(?i)\\b(ref|page)\\s*[=:]\\s*[^&\\s]+', '\\1=***', 'g') AS url, regexp_matches(url, '(^|/)\\.\\.(/|$)') AS climbs FROM pages")
def redacted_urls(spark: SparkSession, d: str) -> DataFrame:
    """Addresses without the values of some names, and whether they step up."""
    return T.table(spark, d, "pages").select("page_id", X.redact(F.col("url"), ("ref", "page")).alias("url"), X.climbs(F.col("url")).alias("climbs"))


@register("moments", "SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(stddev_pop(value), 6) AS dev FROM events GROUP BY 1")
def moments(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "events").groupBy("event_type").agg(F.count("*").alias("n"), F.round(F.avg("value"), 6).alias("mean"), F.round(F.stddev_pop("value"), 6).alias("dev"))


@register("principal_components")
def principal_components(spark: SparkSession, d: str) -> DataFrame:
    """Whitened leading components; signs are free, so only lengths are reported."""
    v = T.table(spark, d, "embeddings").select("vec_id", F.col("embedding").cast("array<double>").alias("e")).where(F.col("e").isNotNull())
    return E.components(v, "vec_id", "e", 8, F.col("vec_id") % 5 != 0)
