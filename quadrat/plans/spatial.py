"""Queries over spatial joins."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.functions import geo as G
from quadrat.operators import spatial as P
from quadrat.operators import splits as S
from quadrat.operators.occurrence import coarser, damped_scores
from quadrat.plans.occurrences import FINE, cell_counts
from quadrat.plans.splits import _ROLE, KM
from quadrat.registry import register
from quadrat.sources import tables as T
from quadrat.sources.shared import written
from quadrat.sources.tables import sql

_ODD = "q AS (SELECT site, lat, lon FROM sites WHERE site % 2 = 1), r AS (SELECT site AS ref, lat, lon, country FROM sites WHERE site % 2 = 0)"
_NEAR = f"n AS (SELECT q.site, r.ref, {KM.format(a='q.', b='r.')} AS km FROM q CROSS JOIN r), k AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY km, ref) AS rank FROM n)"


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = T.sites(spark, d)
    return s.where("site % 2 = 1").select("site", "lat", "lon"), s.where("site % 2 = 0").select(F.col("site").alias("ref"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"))


@register("nearest_reference", sql(f"WITH {_ODD}, {_NEAR} SELECT site, ref, km FROM k WHERE rank = 1", "sites"))
def nearest_reference(spark: SparkSession, d: str) -> DataFrame:
    return P.nearest(*_sides(spark, d), 1, "ref").select("site", "ref", "km")


@register("knn_join", sql(f"WITH {_ODD}, {_NEAR} SELECT site, ref, km, rank::INT AS rank FROM k WHERE rank <= 8", "sites"))
def knn_join(spark: SparkSession, d: str) -> DataFrame:
    return P.nearest(*_sides(spark, d), 8, "ref").select("site", "ref", "km", "rank")


@register("radius_counts", sql(f"WITH {_ODD}, {_NEAR} SELECT site, count(*) FILTER (km <= 20) AS within20, count(*) FILTER (km <= 50) AS within50 FROM n GROUP BY 1", "sites"))
def radius_counts(spark: SparkSession, d: str) -> DataFrame:
    return P.counts_within(*_sides(spark, d), {"within20": 20, "within50": 50}, "site").select("site", "within20", "within50")


@register("distance_buffer", sql(f"WITH {_ODD}, {_NEAR} SELECT site FROM n GROUP BY 1 HAVING min(km) >= 20", "sites"))
def distance_buffer(spark: SparkSession, d: str) -> DataFrame:
    return P.outside_buffer(*_sides(spark, d), 20, "site").select("site")


@register("proximity_exclusion", sql(f"""
    WITH q AS (SELECT DISTINCT lat, lon FROM occurrences), r AS (SELECT DISTINCT lat, lon FROM sites),
    close AS (SELECT DISTINCT q.lat, q.lon FROM q JOIN r ON abs(q.lat - r.lat) < 0.1 AND {KM.format(a='q.', b='r.')} <= 0.1)
    SELECT o.survey, o.line FROM occurrences o ANTI JOIN close USING (lat, lon)""", "occurrences", "sites"))
def proximity_exclusion(spark: SparkSession, d: str) -> DataFrame:
    o = T.occurrences(spark, d).select("survey", "line", "lat", "lon")
    r = T.sites(spark, d).select(F.col("lat").alias("rlat"), F.col("lon").alias("rlon")).distinct()
    close = P.within_km(o.select("lat", "lon").distinct(), r, 0.1).select("lat", "lon").distinct()
    return o.join(close, ["lat", "lon"], "left_anti").select("survey", "line")


_SHARE = "(CASE WHEN abs(a) + abs(b) = 0 THEN 1 WHEN abs(a) + abs(b) = 1 THEN exp(-0.8::DOUBLE) ELSE exp(-0.8::DOUBLE * sqrt(2::DOUBLE)) END)"


def _stencil_sql(grid: str, cells: str) -> str:
    """SQL of x, y, species and the weighted sum over the nine cells of ``grid`` around each of ``cells``."""
    return f"""SELECT q.x, q.y, species, round(sum({_SHARE} * score), 9) AS score FROM (SELECT q.x, q.y, a, b FROM {cells} q CROSS JOIN (VALUES (-1), (0), (1)) AS s(a) CROSS JOIN (VALUES (-1), (0), (1)) AS t(b)) q
        JOIN {grid} g ON g.x = q.x + q.a AND g.y = q.y + q.b GROUP BY ALL"""


_QUERY_CELLS = "q AS (SELECT DISTINCT floor(lat * 10)::BIGINT AS x, floor(lon * 10)::BIGINT AS y FROM sites)"
_ASKED = "SELECT site AS id, floor(lat * 10)::BIGINT AS x, floor(lon * 10)::BIGINT AS y FROM sites"


def _asked(spark: SparkSession, d: str) -> DataFrame:
    return T.sites(spark, d).select(F.col("site").alias("id"), F.floor(F.col("lat") * 10).alias("x"), F.floor(F.col("lon") * 10).alias("y"))


def _fine(spark: SparkSession, d: str) -> DataFrame:
    return damped_scores(cell_counts(spark, d), ["x", "y"], 0.35, 48)


@register("grid_stencil", sql(f"""
    WITH {FINE}, {_QUERY_CELLS}, m AS ({_stencil_sql("fine", "q")}),
    k AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY score DESC, species) AS rank FROM m),
    b AS (SELECT x, y, species, rank, score / max(score) OVER (PARTITION BY x, y) AS score, sum(score) OVER (PARTITION BY x, y) AS coverage FROM k WHERE rank <= 28)
    SELECT id, species, round(score, 6) AS score, rank::INT AS rank, round(coverage, 5) AS coverage FROM ({_ASKED}) JOIN b USING (x, y)""", "occurrences", "sites"))
def grid_stencil(spark: SparkSession, d: str) -> DataFrame:
    q = _asked(spark, d)
    best = P.best_of_cells(P.stencil(q.select("x", "y").distinct(), _fine(spark, d)), 28)
    return q.join(best, ["x", "y"]).select("id", "species", F.round("score", 6).alias("score"), "rank", F.round("coverage", 5).alias("coverage"))


def _coarse_sql(factor: int) -> str:
    return f"""c{factor}k AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY score DESC, species) AS r FROM (SELECT floor(x / {factor}::DOUBLE)::BIGINT AS x, floor(y / {factor}::DOUBLE)::BIGINT AS y, species, round(sum(score), 9) AS score FROM fine GROUP BY ALL)),
    c{factor} AS (SELECT x, y, species, score / max(score) OVER (PARTITION BY x, y) AS score FROM c{factor}k WHERE r <= 96)"""


def _scale_sql(factor: int, weight: float, grid: str) -> str:
    return f"""q{factor} AS (SELECT DISTINCT floor(x / {factor}::DOUBLE)::BIGINT AS x, floor(y / {factor}::DOUBLE)::BIGINT AS y FROM q),
    s{factor} AS ({_stencil_sql(grid, f"q{factor}")}), p{factor} AS (SELECT x AS cx, y AS cy, species, round(score / max(score) OVER (PARTITION BY x, y), 9) AS part FROM s{factor}),
    v{factor} AS (SELECT x, y, species, {weight}::DOUBLE * part AS value, (part >= 0.25)::INT AS here FROM q JOIN p{factor} ON cx = floor(x / {factor}::DOUBLE) AND cy = floor(y / {factor}::DOUBLE))"""


@register("multi_scale_stencil", sql(f"""
    WITH {FINE}, {_coarse_sql(5)}, {_coarse_sql(20)}, {_QUERY_CELLS}, {_scale_sql(1, 0.5, "fine")}, {_scale_sql(5, 0.3, "c5")}, {_scale_sql(20, 0.2, "c20")},
    u AS (SELECT x, y, species, sum(value) AS value, sum(here) AS support FROM (FROM v1 UNION ALL FROM v5 UNION ALL FROM v20) GROUP BY ALL),
    l AS (SELECT x, y, species, support, round(value * (1 + 0.12::DOUBLE * greatest(support::INT - 1, 0)), 9) AS score FROM u),
    k AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY score DESC, species) AS rank FROM l),
    b AS (SELECT x, y, species, rank, score / max(score) OVER w AS score, sum(score) OVER w AS coverage, avg(CASE WHEN rank <= 10 THEN support / 3::DOUBLE END) OVER w AS agreement FROM k WHERE rank <= 48 WINDOW w AS (PARTITION BY x, y))
    SELECT id, species, round(score, 6) AS score, rank::INT AS rank, round(coverage, 5) AS coverage, round(agreement, 6) AS agreement FROM ({_ASKED}) JOIN b USING (x, y)""", "occurrences", "sites"))
def multi_scale_stencil(spark: SparkSession, d: str) -> DataFrame:
    q, fine = _asked(spark, d), _fine(spark, d)
    best = P.across_scales(q.select("x", "y").distinct(), [(1, 0.5, fine), (5, 0.3, coarser(fine, 5, 96)), (20, 0.2, coarser(fine, 20, 96))], 48)
    return q.join(best, ["x", "y"]).select("id", "species", F.round("score", 6).alias("score"), "rank", F.round("coverage", 5).alias("coverage"), F.round("agreement", 6).alias("agreement"))


@register("cell_binning", sql("""
    SELECT survey, line, least(greatest(floor(lat * 20), -1800), 1799)::BIGINT AS row_cell, least(greatest(floor(lon * 20), -3600), 3599)::BIGINT AS col_cell,
           (least(greatest(floor(lat * 20), -1800), 1799) + 0.5) / 20 AS centre FROM occurrences""", "occurrences"))
def cell_binning(spark: SparkSession, d: str) -> DataFrame:
    row, col = G.cell(F.col("lat"), 20, -90, 90), G.cell(F.col("lon"), 20, -180, 180)
    return T.occurrences(spark, d).select("survey", "line", row.alias("row_cell"), col.alias("col_cell"), ((row + F.lit(0.5)) / 20).alias("centre"))


_VOTES = f"""WITH {_ODD}, {_NEAR}, f AS (SELECT * FROM k WHERE rank <= 8),
    labels AS (SELECT DISTINCT site AS ref, species FROM pairs JOIN surveys USING (survey)),"""


def _site_labels(spark: SparkSession, d: str) -> DataFrame:
    """Distinct (ref, species) of the sites' surveys."""
    return T.pairs(spark, d).join(T.surveys(spark, d).select("survey", F.col("site").alias("ref")), "survey").select("ref", "species").distinct()


@register("kernel_label_vote", sql(_VOTES + """
    v AS (SELECT site, species, sum(exp(-km / 12)) AS s, count(*) AS n, min(km) AS d FROM f JOIN labels USING (ref) GROUP BY ALL),
    w AS (SELECT site, species, round(s / max(s) OVER (PARTITION BY site), 6) AS score FROM v WHERE n >= 2 OR d <= 2),
    x AS (SELECT *, row_number() OVER (PARTITION BY site ORDER BY score DESC, species) AS rank FROM w)
    SELECT site, species, score, rank::INT AS rank FROM x WHERE rank <= 28""", "sites", "surveys", "pairs"))
def kernel_label_vote(spark: SparkSession, d: str) -> DataFrame:
    near = P.nearest(*_sides(spark, d), 8, "ref").join(_site_labels(spark, d), "ref")
    v = near.groupBy("site", "species").agg(F.sum(F.exp(-F.col("km") / 12)).alias("s"), F.count("*").alias("n"), F.min("km").alias("d"))
    w = v.where("n >= 2 or d <= 2").withColumn("score", F.round(F.col("s") / F.max("s").over(Window.partitionBy("site")), 6))
    rank = F.row_number().over(Window.partitionBy("site").orderBy(F.desc("score"), "species"))
    return w.withColumn("rank", rank).where("rank <= 28").select("site", "species", "score", "rank")


@register("consensus_vote", sql(_VOTES + """
    n2 AS (SELECT site, count(*) AS neighbours FROM f WHERE km <= 60 GROUP BY 1 HAVING count(*) >= 3)
    SELECT site, species, count(*) AS votes, neighbours FROM f JOIN labels USING (ref) JOIN n2 USING (site) WHERE km <= 60
    GROUP BY site, species, neighbours HAVING count(*) >= ceil(0.5 * neighbours)""", "sites", "surveys", "pairs"))
def consensus_vote(spark: SparkSession, d: str) -> DataFrame:
    near = P.nearest(*_sides(spark, d), 8, "ref").where("km <= 60").withColumn("neighbours", F.count("*").over(Window.partitionBy("site"))).where("neighbours >= 3")
    votes = near.join(_site_labels(spark, d), "ref").groupBy("site", "species", "neighbours").agg(F.count("*").alias("votes"))
    return votes.where(F.col("votes") >= F.ceil(F.col("neighbours") * 0.5)).select("site", "species", "votes", "neighbours")


@register("local_support", sql(f"WITH {_ODD}, {_NEAR}, u AS (SELECT site AS ref, count(*) AS support FROM surveys GROUP BY 1) SELECT site, round(sum(support / (1 + km)), 6) AS support FROM k JOIN u USING (ref) WHERE rank <= 8 GROUP BY 1", "sites", "surveys"))
def local_support(spark: SparkSession, d: str) -> DataFrame:
    support = T.surveys(spark, d).groupBy(F.col("site").alias("ref")).agg(F.count("*").alias("support"))
    near = P.nearest(*_sides(spark, d), 8, "ref").join(support, "ref")
    return near.groupBy("site").agg(F.round(F.sum(F.col("support") / (1 + F.col("km"))), 6).alias("support"))


#: Roles by the salted split: 0 fits, 1 to 3 are calibration, a second calibration and assessment; 4 stands for production.
_SEES = [(1, 0), (2, 0), (3, 0), (4, 0), (4, 1), (4, 2)]
_PA = """
    a AS (SELECT site, lat, lon, role FROM r WHERE role IN (1, 2, 3) UNION ALL SELECT site, lat, lon, 4 FROM r WHERE role = 3),
    sees(role, seen) AS (VALUES """ + ", ".join(map(str, _SEES)) + f"""),
    refs AS (SELECT sees.role, r.site AS ref, lat, lon FROM r JOIN sees ON seen = r.role),
    n AS (SELECT a.site, a.role, refs.ref, {KM.format(a='a.', b='refs.')} AS km FROM a JOIN refs USING (role)),
    k AS (SELECT *, row_number() OVER (PARTITION BY site, role ORDER BY km, ref) AS rank FROM n), near AS (SELECT * FROM k WHERE rank <= 8),
    d AS (SELECT site, role, min(km) AS km FROM near GROUP BY ALL),
    labels AS (SELECT DISTINCT site AS ref, species FROM pairs JOIN surveys USING (survey)),
    v AS (SELECT site, role, species, round(sum(exp(-km / 12)), 9) AS s, count(*) AS n FROM near JOIN labels USING (ref) WHERE km <= 30 GROUP BY ALL),
    w AS (SELECT v.*, row_number() OVER (PARTITION BY site, role ORDER BY s DESC, species) AS rank FROM v JOIN d USING (site, role) WHERE n >= 2 OR km <= 2),
    pa AS (SELECT site, role, species, rank, round(s / max(s) OVER (PARTITION BY site, role), 6) AS score FROM w WHERE rank <= 28)"""


@register("role_components", sql(f"""
    WITH {FINE}, r AS (SELECT site, lat, lon, {_ROLE} AS role FROM sites), {_PA}, {_QUERY_CELLS}, m AS ({_stencil_sql("fine", "q")}),
    mk AS (SELECT *, row_number() OVER (PARTITION BY x, y ORDER BY score DESC, species) AS rank FROM m),
    b AS (SELECT x, y, species, rank, score / max(score) OVER (PARTITION BY x, y) AS score, sum(score) OVER (PARTITION BY x, y) AS coverage FROM mk WHERE rank <= 28),
    po AS (SELECT site, role, species, rank, round(score, 6) AS score, round(coverage, 5) AS coverage FROM a JOIN b ON floor(a.lat * 10)::BIGINT = b.x AND floor(a.lon * 10)::BIGINT = b.y)
    SELECT a.site, a.role, round(d.km, 6) AS pa_km, c.source, c.species, c.rank::INT AS rank, c.score, c.coverage FROM a LEFT JOIN d USING (site, role)
    LEFT JOIN (SELECT site, role, 'pa' AS source, species, rank, score, NULL::DOUBLE AS coverage FROM pa UNION ALL SELECT site, role, 'po', species, rank, score, coverage FROM po) c USING (site, role)""", "occurrences", "sites", "surveys", "pairs"))
def role_components(spark: SparkSession, d: str) -> DataFrame:
    """Spatial and occurrence candidates of every role in one search: distance to what the role may see, and coverage.

    The role is a key of the spatial join: calibration and assessment see the fitting sites, production sees calibration too.
    A site without any candidate has one row without species.
    """
    role = S.by_bucket(G.xor_partition(F.col("lat"), F.col("lon"), 1, 77, 100), [(70, 0), (80, 1), (90, 2), (100, 3)])
    r = T.sites(spark, d).select("site", "lat", "lon", role.alias("role"))
    asked = r.where("role > 0").withColumn("role", F.explode(F.when(F.col("role") == 3, F.array(F.lit(3), F.lit(4))).otherwise(F.array("role"))))
    seen = F.array(*[F.struct(F.lit(b).alias("seen"), F.lit(a).alias("by")) for a, b in _SEES])
    refs = r.select(F.col("site").alias("ref"), F.col("lat").alias("rlat"), F.col("lon").alias("rlon"), F.explode(F.transform(F.filter(seen, lambda s: s["seen"] == F.col("role")), lambda s: s["by"])).alias("role"))
    near = written(P.nearest(asked, refs, 8, "ref", by=("role",)).select("site", "role", "ref", "km"), "near")
    first = near.groupBy("site", "role").agg(F.min("km").alias("pa_km"))
    votes = near.where("km <= 30").join(_site_labels(spark, d), "ref").groupBy("site", "role", "species").agg(F.round(F.sum(F.exp(-F.col("km") / 12)), 9).alias("s"), F.count("*").alias("n"))
    mine = Window.partitionBy("site", "role")
    pa = votes.join(first, ["site", "role"]).where("n >= 2 or pa_km <= 2").withColumn("rank", F.row_number().over(mine.orderBy(F.desc("s"), "species"))).where("rank <= 28")
    pa = pa.select("site", "role", F.lit("pa").alias("source"), "species", "rank", F.round(F.col("s") / F.max("s").over(mine), 6).alias("score"), F.lit(None).cast("double").alias("coverage"))
    cells = asked.select("site", "role", F.floor(F.col("lat") * 10).alias("x"), F.floor(F.col("lon") * 10).alias("y"))
    best = P.best_of_cells(P.stencil(cells.select("x", "y").distinct(), _fine(spark, d)), 28)
    po = cells.join(best, ["x", "y"]).select("site", "role", F.lit("po").alias("source"), "species", "rank", F.round("score", 6).alias("score"), F.round("coverage", 5).alias("coverage"))
    return asked.select("site", "role").join(first, ["site", "role"], "left").join(pa.unionByName(po), ["site", "role"], "left")
