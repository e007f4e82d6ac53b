"""Queries over presence-only occurrences."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.functions import geo as G
from quadrat.operators import occurrence as O
from quadrat.registry import register
from quadrat.sources.shared import shared_folder
from quadrat.sources import tables as T
from quadrat.sources.tables import sql

_KEPT = "o AS (SELECT floor(lat * 20)::BIGINT AS row_cell, floor(lon * 20)::BIGINT AS col_cell, publisher, species % 4 AS stratum, species, survey FROM occurrences WHERE uncertainty <= 1000)"
_GROUPS = f"{_KEPT}, e AS (SELECT row_cell, col_cell, publisher, stratum, species, min(survey) AS survey, count(*) AS raw FROM o GROUP BY ALL EXCLUDE (survey)), g AS (SELECT row_cell, col_cell, publisher, stratum, min(survey) AS survey, count(*) AS species, sum(raw)::BIGINT AS raw FROM e GROUP BY row_cell, col_cell, publisher, stratum)"
_GROUPS = _GROUPS.replace("GROUP BY ALL EXCLUDE (survey)", "GROUP BY row_cell, col_cell, publisher, stratum, species")
_WEIGHTS = f"""{_GROUPS}, p AS (SELECT row_cell, col_cell, count(DISTINCT publisher) AS publishers FROM g GROUP BY ALL),
    s AS (SELECT row_cell, col_cell, publisher, count(DISTINCT stratum) AS strata FROM g GROUP BY ALL),
    b AS (SELECT floor(row_cell / 20::DOUBLE) AS rb, floor(col_cell / 20::DOUBLE) AS cb, count(*) AS cells FROM p GROUP BY ALL),
    w AS (SELECT g.*, 1 / (publishers * strata * sqrt(cells)) AS weight FROM g JOIN p USING (row_cell, col_cell) JOIN s USING (row_cell, col_cell, publisher)
          JOIN b ON rb = floor(row_cell / 20::DOUBLE) AND cb = floor(col_cell / 20::DOUBLE))"""


def _kept(spark: SparkSession, d: str) -> DataFrame:
    o = T.occurrences(spark, d).where("uncertainty is null or uncertainty <= 1000")
    row, col = G.cell(F.col("lat"), 20, -90, 90), G.cell(F.col("lon"), 20, -180, 180)
    return o.select(row.alias("row_cell"), col.alias("col_cell"), "publisher", (F.col("species") % 4).alias("stratum"), "species", "survey")


@register("pseudo_surveys", sql(f"WITH {_GROUPS} SELECT * FROM g", "occurrences"))
def pseudo_surveys(spark: SparkSession, d: str) -> DataFrame:
    return O.pseudo_surveys(_kept(spark, d))


@register("pseudo_survey_weights", sql(f"WITH {_WEIGHTS} SELECT row_cell, col_cell, publisher, stratum, round(weight, 9) AS weight FROM w", "occurrences"))
def pseudo_survey_weights(spark: SparkSession, d: str) -> DataFrame:
    w = O.inverse_weights(O.pseudo_surveys(_kept(spark, d)), 20)
    return w.select(*O.GROUP, F.round("weight", 9).alias("weight"))


@register("publisher_shares", sql(f"WITH {_WEIGHTS} SELECT publisher, round(sum(weight) / (SELECT sum(weight) FROM w), 6) AS share FROM w GROUP BY 1", "occurrences"))
def publisher_shares(spark: SparkSession, d: str) -> DataFrame:
    w = O.inverse_weights(O.pseudo_surveys(_kept(spark, d)), 20)
    by = w.groupBy("publisher").agg(F.sum("weight").alias("mass"))
    total = by.agg(F.sum("mass").alias("total"))
    return by.join(F.broadcast(total), F.lit(True)).select("publisher", F.round(F.col("mass") / F.col("total"), 6).alias("share"))


@register("capped_publisher_shares", sql(f"""
    WITH {_WEIGHTS}, masses AS MATERIALIZED (SELECT publisher, sum(weight) AS mass FROM w GROUP BY 1), t AS (SELECT count(*) AS n, sum(mass) AS total, greatest(1.02 / count(*), 0.01)::DOUBLE AS cap FROM masses),
    ordered AS (SELECT publisher, mass, row_number() OVER (ORDER BY mass DESC, publisher) AS i, sum(mass) OVER (ORDER BY mass DESC, publisher) AS upto FROM masses),
    level AS (SELECT coalesce(max(i), 0) AS pinned, coalesce(max(upto), 0) AS held FROM ordered CROSS JOIN t WHERE mass * (1 - cap * (i - 1)) / (total - (upto - mass)) > cap + 1e-12)
    SELECT publisher, round(CASE WHEN i <= pinned THEN cap ELSE mass / (total - held) * (1 - cap * pinned) END, 6) AS share FROM ordered CROSS JOIN t CROSS JOIN level""", "occurrences"))
def capped_publisher_shares(spark: SparkSession, d: str) -> DataFrame:
    """Shares of all publishers once none holds more than 2 % above the even share."""
    w = O.inverse_weights(O.pseudo_surveys(_kept(spark, d)), 20)
    cap = max(1.02 / max(1, w.select("publisher").distinct().count()), 0.01)
    by = O.cap_publishers(w, cap).groupBy("publisher").agg(F.sum("weight").alias("mass"))
    total = by.agg(F.sum("mass").alias("total"))
    return by.join(F.broadcast(total), F.lit(True)).select("publisher", F.round(F.col("mass") / F.col("total"), 6).alias("share"))


@register("publisher_deviation", sql(f"WITH {_WEIGHTS} SELECT row_cell, col_cell, count(*) AS groups, round(sum(weight), 6) AS mass, max(raw)::BIGINT AS most FROM w GROUP BY ALL", "occurrences"))
def publisher_deviation(spark: SparkSession, d: str) -> DataFrame:
    w = O.inverse_weights(O.pseudo_surveys(_kept(spark, d)), 20)
    return w.groupBy("row_cell", "col_cell").agg(F.count("*").alias("groups"), F.round(F.sum("weight"), 6).alias("mass"), F.max("raw").alias("most"))


@register("group_environment_mean", sql(f"""
    WITH {_KEPT}, x AS (SELECT DISTINCT row_cell, col_cell, publisher, o.survey, CASE WHEN o.survey % 19 = 0 THEN NULL ELSE price END AS price FROM o JOIN surveys s USING (survey))
    SELECT row_cell, col_cell, publisher, round(avg(price), 4) AS mean FROM x GROUP BY ALL""", "occurrences", "surveys"))
def group_environment_mean(spark: SparkSession, d: str) -> DataFrame:
    price = F.when(F.col("survey") % 19 == 0, float("nan")).otherwise(F.col("price"))
    rows = _kept(spark, d).join(T.surveys(spark, d).select("survey", "price"), "survey")
    return O.mean_of_distinct(rows, ["row_cell", "col_cell", "publisher"], "survey", price).withColumn("mean", F.round("mean", 4))


_COUNTS = "oc AS (SELECT floor(lat * 10)::BIGINT AS x, floor(lon * 10)::BIGINT AS y, species, count(*) AS n FROM occurrences GROUP BY ALL)"
FINE = f"""{_COUNTS}, total_ AS (SELECT species, sum(n) AS total FROM oc GROUP BY 1), damped_ AS (SELECT x, y, species, round(n / pow(total, 0.35), 9) AS score FROM oc JOIN total_ USING (species)),
    kept_ AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY score DESC, species) AS r FROM damped_),
    fine AS (SELECT x, y, species, score / max(score) OVER (PARTITION BY x, y) AS score FROM kept_ WHERE r <= 48)"""


def cell_counts(spark: SparkSession, d: str) -> DataFrame:
    return T.occurrences(spark, d).groupBy(F.floor(F.col("lat") * 10).alias("x"), F.floor(F.col("lon") * 10).alias("y"), "species").agg(F.count("*").alias("n"))


@register("damped_cell_scores", sql(f"WITH {FINE} SELECT x, y, species, round(score, 6) AS score FROM fine", "occurrences"))
def damped_cell_scores(spark: SparkSession, d: str) -> DataFrame:
    return O.damped_scores(cell_counts(spark, d), ["x", "y"], 0.35, 48).withColumn("score", F.round("score", 6))


_ROLLED = """u{f} AS (SELECT floor(x / {f}::DOUBLE)::BIGINT AS x, floor(y / {f}::DOUBLE)::BIGINT AS y, species, round(sum(score), 9) AS score FROM fine GROUP BY ALL),
    k{f} AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY score DESC, species) AS r FROM u{f})"""
_ROLL = "SELECT {f} AS factor, x, y, species, round(score / max(score) OVER (PARTITION BY x, y), 6) AS score FROM k{f} WHERE r <= 96"


@register("coarse_cell_scores", sql(f"WITH {FINE}, {_ROLLED.format(f=5)}, {_ROLLED.format(f=20)} {_ROLL.format(f=5)} UNION ALL {_ROLL.format(f=20)}", "occurrences"))
def coarse_cell_scores(spark: SparkSession, d: str) -> DataFrame:
    fine = O.damped_scores(cell_counts(spark, d), ["x", "y"], 0.35, 48)
    each = [O.coarser(fine, f, 96).select(F.lit(f).alias("factor"), "x", "y", "species", F.round("score", 6).alias("score")) for f in (5, 20)]
    return each[0].unionByName(each[1])


@register("weighted_draw")
def weighted_draw(spark: SparkSession, d: str) -> DataFrame:
    """Pseudo-surveys drawn with replacement in proportion to weight: inverse of the running share, hashed uniforms."""
    from quadrat.operators.stats import draw_weighted

    w = O.inverse_weights(O.pseudo_surveys(_kept(spark, d)), 20).withColumn("key", F.concat_ws(":", *O.GROUP))
    return draw_weighted(w.select("key", "weight"), "key", "weight", 1000, 7)


@register("probe_holdout", sql(f"""
    WITH {_GROUPS}, h AS (SELECT survey, row_cell, col_cell, publisher, stratum, sha256(concat_ws(':', row_cell, col_cell, publisher, stratum)) AS h FROM g),
    r AS (SELECT *, row_number() OVER (ORDER BY h) AS place, count(*) OVER () AS n FROM h)
    SELECT row_cell, col_cell, publisher, stratum FROM r WHERE place <= least(10000, greatest(1, n // 20))""", "occurrences"))
def probe_holdout(spark: SparkSession, d: str) -> DataFrame:
    g = O.pseudo_surveys(_kept(spark, d)).withColumn("h", F.sha2(F.concat_ws(":", *O.GROUP), 256))
    n = g.count()
    return g.orderBy("h").limit(min(10000, max(1, n // 20))).select(*O.GROUP)


@register("streamed_cell_counts", sql("""
    SELECT row_cell, col_cell, count(*) AS n FROM (SELECT DISTINCT floor(lat * 20)::BIGINT AS row_cell, floor(lon * 20)::BIGINT AS col_cell, publisher, species FROM occurrences) GROUP BY ALL""", "occurrences"))
def streamed_cell_counts(spark: SparkSession, d: str) -> DataFrame:
    from quadrat.streaming import cells

    schema = spark.read.parquet(f"{d}/lineitem.parquet").schema
    rows = spark.readStream.schema(schema).parquet(f"{d}/lineitem.parque[t]")  # a pattern: the table may be a single file
    row, col = G.cell(F.col("lat"), 20, -90, 90), G.cell(F.col("lon"), 20, -180, 180)
    source = T.occurrences_of(rows).select(row.alias("row_cell"), col.alias("col_cell"), "publisher", "species")
    return cells.run(spark, source, shared_folder(spark))
