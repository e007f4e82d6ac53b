"""Queries over spatial splits."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import geo as G
from quadrat.operators import splits as S
from quadrat.registry import register
from quadrat.sources import tables as T
from quadrat.sources.tables import sql

#: SQL of distances, blocks and buckets for another engine.
KM = "round(2 * 6371.0088 * asin(sqrt(least(1.0, pow(sin(radians({b}lat - {a}lat) / 2), 2) + cos(radians({a}lat)) * cos(radians({b}lat)) * pow(sin(radians({b}lon - {a}lon) / 2), 2)))), 6)"
BLOCK1 = "printf('%+04d:%+04d', floor(lat)::INT, floor(lon)::INT)"
BLOCK4 = "printf('%+05d:%+05d', floor(lat * 4)::INT, floor(lon * 4)::INT)"


def sha(text: str, n: int) -> str:
    h = f"sha256({text})"
    return "(concat('0x', " + ", ".join(f"substr({h}, {i}, 2)" for i in range(15, 0, -2)) + f")::UBIGINT % {n})::INT"


def xor(scale: str, seed: int, n: int) -> str:
    x = f"xor(xor(floor(lat * {scale})::BIGINT * 73856093, floor(lon * {scale})::BIGINT * 19349663), {seed})"
    return f"((({x} % {n}) + {n}) % {n})"


@register("block_ids", sql(f"SELECT site, {BLOCK1} AS block1, {BLOCK4} AS block4 FROM sites", "sites"))
def block_ids(spark: SparkSession, d: str) -> DataFrame:
    at = F.col("lat"), F.col("lon")
    return T.sites(spark, d).select("site", G.block_id(*at).alias("block1"), G.block_id(*at, 4).alias("block4"))


@register("xor_partition", sql(f"""
    WITH b AS (SELECT site, country, {xor('2', 2026, 100)} AS bucket FROM sites)
    SELECT site, bucket, CASE WHEN country IN ('NATION_3', 'NATION_7') THEN 3 WHEN bucket < 85 THEN 0 WHEN bucket < 90 THEN 1 WHEN bucket < 95 THEN 2 ELSE 3 END AS role FROM b""", "sites"))
def xor_partition(spark: SparkSession, d: str) -> DataFrame:
    b = T.sites(spark, d).withColumn("bucket", G.xor_partition(F.col("lat"), F.col("lon"), 2, 2026, 100))
    role = S.by_bucket(F.col("bucket"), [(85, 0), (90, 1), (95, 2), (100, 3)])
    return b.select("site", "bucket", F.when(F.col("country").isin("NATION_3", "NATION_7"), 3).otherwise(role).alias("role"))


@register("block_calibration", sql(f"SELECT site, {xor('11.119', 0, 10000)} AS bucket, {xor('11.119', 0, 10000)} < 1500 AS calibration FROM sites", "sites"))
def block_calibration(spark: SparkSession, d: str) -> DataFrame:
    bucket = G.xor_partition(F.col("lat"), F.col("lon"), 11.119, 0, 10000)
    return T.sites(spark, d).select("site", bucket.alias("bucket"), (bucket < 1500).alias("calibration"))


@register("sha_bucket", sql(f"SELECT site, {sha('country', 100)} AS bucket FROM sites", "sites"))
def sha_bucket(spark: SparkSession, d: str) -> DataFrame:
    return T.sites(spark, d).select("site", G.sha_bucket(F.col("country"), 100).alias("bucket"))


def _buffer(role: str, km: float, extra: str = "") -> str:
    close = KM.format(a="t.", b="o.")
    return f"""WITH r AS (SELECT site, lat, lon, {role} AS role FROM sites), t AS (SELECT * FROM r WHERE role = 0), o AS (SELECT * FROM r WHERE role <> 0),
        near AS (SELECT DISTINCT t.site FROM t JOIN o ON abs(t.lat - o.lat) < 1 AND {close} < {km})
        SELECT r.site, CASE WHEN n.site IS NOT NULL THEN -1 ELSE role END AS role{extra} FROM r LEFT JOIN near n USING (site)"""


_SALTED = xor("1", 77, 100)
_ROLE = f"CASE WHEN {_SALTED} < 70 THEN 0 WHEN {_SALTED} < 80 THEN 1 WHEN {_SALTED} < 90 THEN 2 ELSE 3 END"


@register("buffered_split", sql(_buffer(_ROLE, 20), "sites"))
def buffered_split(spark: SparkSession, d: str) -> DataFrame:
    bucket = G.xor_partition(F.col("lat"), F.col("lon"), 1, 77, 100)
    role = S.by_bucket(bucket, [(70, 0), (80, 1), (90, 2), (100, 3)])
    return S.buffered(T.sites(spark, d).select("site", "lat", "lon"), role, 20, "site").select("site", "role")


_B4 = sha(f"'v:' || {BLOCK4}", 100)


def _fold(f: int) -> str:
    return f"CASE WHEN {_B4} >= {f * 25} AND {_B4} < {f * 25 + 25} THEN 3 WHEN {_B4} >= 50 AND {_B4} < 60 THEN 1 WHEN {_B4} >= 60 AND {_B4} < 70 THEN 2 ELSE 0 END"


@register("two_fold_split", sql(f"SELECT * FROM ({_buffer(_fold(0), 20, ', 0 AS fold')}) UNION ALL SELECT * FROM ({_buffer(_fold(1), 20, ', 1 AS fold')})", "sites"))
def two_fold_split(spark: SparkSession, d: str) -> DataFrame:
    a, b = S.two_folds(T.sites(spark, d).select("site", "lat", "lon"), "v", 4, 25, 10, 10, 20, "site")
    return a.unionByName(b).select("site", "role", "fold")


_D1 = sha(f"'deploy:' || {BLOCK1}", 100)


@register("deployment_split", sql(_buffer(f"CASE WHEN {_D1} < 8 THEN 1 WHEN {_D1} < 18 THEN 2 ELSE 0 END", 10), "sites"))
def deployment_split(spark: SparkSession, d: str) -> DataFrame:
    bucket = G.sha_bucket(F.concat(F.lit("deploy:"), G.block_id(F.col("lat"), F.col("lon"))), 100)
    return S.buffered(T.sites(spark, d).select("site", "lat", "lon"), S.by_bucket(bucket, [(8, 1), (18, 2), (100, 0)]), 10, "site").select("site", "role")


_SPLITS = {"buffered": _buffer(_ROLE, 20, ", r.lat, r.lon"), "unbuffered": f"SELECT site, {_ROLE} AS role, lat, lon FROM sites", "by_site": "SELECT site, CASE WHEN site * 7919 % 100 < 70 THEN 0 ELSE 1 END AS role, lat, lon FROM sites"}
_APART = """SELECT '{name}' AS split, (SELECT count(DISTINCT site) FROM {t} WHERE role >= 0) AS keys, (SELECT count(*) FROM (SELECT site FROM {t} WHERE role >= 0 GROUP BY 1 HAVING count(DISTINCT role) > 1)) AS shared_keys,
    (SELECT count(DISTINCT """ + BLOCK1 + """) FROM {t} WHERE role >= 0) AS blocks, (SELECT count(*) FROM (SELECT """ + BLOCK1 + """ AS b FROM {t} WHERE role >= 0 GROUP BY 1 HAVING count(DISTINCT role) > 1)) AS shared_blocks,
    (SELECT count(DISTINCT t.site) FROM {t} t JOIN {t} o ON t.role = 0 AND o.role > 0 AND abs(t.lat - o.lat) < 1 AND """ + KM.format(a="t.", b="o.") + """ < 20) AS close"""


@register("split_disjointness", sql("WITH " + ", ".join(f"s_{n} AS MATERIALIZED ({q})" for n, q in _SPLITS.items()) + " " + " UNION ALL ".join(_APART.format(name=n, t=f"s_{n}") for n in _SPLITS), "sites"))
def split_disjointness(spark: SparkSession, d: str) -> DataFrame:
    """Shared sites, shared blocks and broken buffers of three splits; the one by sites shares blocks, the unbuffered one breaks buffers."""
    sites = T.sites(spark, d).select("site", "lat", "lon")
    role = S.by_bucket(G.xor_partition(F.col("lat"), F.col("lon"), 1, 77, 100), [(70, 0), (80, 1), (90, 2), (100, 3)])
    splits = {"buffered": S.buffered(sites, role, 20, "site"), "unbuffered": sites.withColumn("role", role), "by_site": sites.withColumn("role", F.when(F.col("site") * 7919 % 100 < 70, 0).otherwise(1))}
    out = None
    for name, dealt in splits.items():
        row = S.disjointness(dealt.withColumn("block", G.block_id(F.col("lat"), F.col("lon"))), "site", "block", 20).select(F.lit(name).alias("split"), "keys", "shared_keys", "blocks", "shared_blocks", "close")
        out = row if out is None else out.unionByName(row)
    return out


@register("holdout_audit", sql("""
    WITH placed AS (SELECT DISTINCT region, species FROM pairs JOIN surveys USING (survey)),
    spread AS (SELECT species, count(*) AS places FROM placed GROUP BY 1),
    own AS (SELECT region, count(*) AS species, count(*) FILTER (places = 1) AS alone FROM placed JOIN spread USING (species) GROUP BY 1),
    x AS (SELECT region, n, n / (SELECT count(*) FROM surveys)::DOUBLE AS share, coalesce(alone, 0) / greatest(coalesce(species, 0), 1)::DOUBLE AS unseen
          FROM (SELECT region, count(*) AS n FROM surveys GROUP BY 1) LEFT JOIN own USING (region)),
    y AS (SELECT *, share BETWEEN 0.08 AND 0.3 AND unseen <= 0.2 AS eligible FROM x)
    SELECT region, n, round(share, 6) AS share, round(unseen, 6) AS unseen, eligible,
           CASE WHEN eligible THEN row_number() OVER (PARTITION BY eligible ORDER BY abs(share - 0.2), unseen, region) END::INT AS rank FROM y""", "surveys", "pairs"))
def holdout_audit(spark: SparkSession, d: str) -> DataFrame:
    a = S.holdout_audit(T.surveys(spark, d), T.pairs(spark, d), "region", 0.08, 0.3, 0.2, 0.2)
    return a.withColumn("share", F.round("share", 6)).withColumn("unseen", F.round("unseen", 6))


@register("id_halves", "SELECT o_orderkey AS survey, (o_orderkey * 2654435761) % 2 AS half FROM orders")
def id_halves(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "orders").select(F.col("o_orderkey").alias("survey"), F.pmod(F.col("o_orderkey") * 2654435761, F.lit(2)).alias("half"))


@register("hashed_survey_split", """
    WITH o AS (SELECT o_orderkey AS survey, sha256('split:' || o_orderkey) AS h FROM orders),
    r AS (SELECT survey, count(*) OVER () AS n, row_number() OVER (ORDER BY h, survey) AS place FROM o)
    SELECT survey, place <= floor(n * 0.2) AS validation FROM r""")
def hashed_survey_split(spark: SparkSession, d: str) -> DataFrame:
    from quadrat.operators.labels import dense_index

    own = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("survey"), F.sha2(F.concat(F.lit("split:"), F.col("o_orderkey").cast("string")), 256).alias("h"))
    placed = own.join(dense_index(own, "h", "place"), "h")
    size = own.agg(F.count("*").alias("n"))
    return placed.join(F.broadcast(size), F.lit(True)).select("survey", (F.col("place") < F.floor(F.col("n") * 0.2)).alias("validation"))


@register("consumed_ledger", sql(f"""
    WITH c AS (SELECT survey FROM surveys WHERE survey % 13 = 0), b AS (SELECT DISTINCT {BLOCK4} AS block FROM surveys WHERE survey % 13 = 0 AND survey % 7 = 0)
    SELECT survey, {BLOCK4} IN (SELECT block FROM b) AS audit_block FROM surveys s WHERE survey NOT IN (SELECT survey FROM c)""", "surveys"))
def consumed_ledger(spark: SparkSession, d: str) -> DataFrame:
    s = T.surveys(spark, d).withColumn("block", G.block_id(F.col("lat"), F.col("lon"), 4))
    used = s.where("survey % 13 = 0")
    blocks = used.where("survey % 7 = 0").select("block").distinct().withColumn("audit_block", F.lit(True))
    return s.join(used.select("survey"), "survey", "left_anti").join(blocks, "block", "left").select("survey", F.coalesce("audit_block", F.lit(False)).alias("audit_block"))


@register("greedy_block_roles")
def greedy_block_roles(spark: SparkSession, d: str) -> DataFrame:
    blocks = T.surveys(spark, d).groupBy(G.block_id(F.col("lat"), F.col("lon")).alias("block")).agg(F.count("*").alias("n"))
    return blocks.join(S.greedy_roles(blocks, {4: 0.44, 0: 0.18, 1: 0.18, 2: 0.10, 3: 0.10}), "block")
