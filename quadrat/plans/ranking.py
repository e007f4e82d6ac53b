"""Queries over rankings, fusion and edits of lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.functions import text as X
from quadrat.operators import metrics as M
from quadrat.operators import ranking as R
from quadrat.registry import register
from quadrat.sources import tables as T
from quadrat.sources.shared import written
from quadrat.sources.tables import sql

_T = "t AS (SELECT survey, species, p, q, row_number() OVER (PARTITION BY survey ORDER BY p DESC, species) AS rank FROM scores)"
_U = "u AS (SELECT survey, species, q, row_number() OVER (PARTITION BY survey ORDER BY q DESC, species) AS rank FROM scores)"


def _p(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(T.scores(spark, d), "p")


@register("top_k_ranking", sql(f"WITH {_T} SELECT survey, species, rank::INT AS rank FROM t WHERE rank <= 10", "scores"))
def top_k_ranking(spark: SparkSession, d: str) -> DataFrame:
    return R.ranked(T.scores(spark, d), "p", 10).select("survey", "species", "rank")


@register("compact_ranking", sql(f"WITH {_T} SELECT survey, string_agg(species::VARCHAR, ' ' ORDER BY rank) AS species FROM t WHERE rank <= 16 GROUP BY 1", "scores"))
def compact_ranking(spark: SparkSession, d: str) -> DataFrame:
    return R.compact(T.scores(spark, d), "p", 16).select("survey", X.encode_list(F.col("species")).alias("species"))


@register("global_top_k", sql("""
    SELECT species, n FROM prevalence ORDER BY n DESC, species LIMIT (SELECT round_even(avg(n), 0)::INT FROM (SELECT count(*) AS n FROM pairs GROUP BY survey))""", "pairs", "prevalence"))
def global_top_k(spark: SparkSession, d: str) -> DataFrame:
    p = T.pairs(spark, d)
    k = p.groupBy("survey").count().agg(F.rint(F.avg("count")).cast("int")).first()[0] or 0
    return T.prevalence(spark, d).orderBy(F.desc("n"), "species").limit(k)


_HITS = f"{_T}, h AS (SELECT t.*, (l.species IS NOT NULL)::INT AS hit, count(l.species) OVER (PARTITION BY survey) AS truth FROM t LEFT JOIN pairs l USING (survey, species))"


def _hits(spark: SparkSession, d: str) -> DataFrame:
    marked = _p(spark, d).join(T.pairs(spark, d).withColumn("hit", F.lit(1)), ["survey", "species"], "left").na.fill(0, ["hit"])
    return marked.withColumn("truth", F.sum("hit").over(Window.partitionBy("survey")))


@register("cumulative_hits", sql(f"WITH {_HITS} SELECT survey, rank::INT AS rank, sum(hit) OVER (PARTITION BY survey ORDER BY rank)::BIGINT AS hits FROM h", "scores", "pairs"))
def cumulative_hits(spark: SparkSession, d: str) -> DataFrame:
    along = Window.partitionBy("survey").orderBy("rank").rowsBetween(Window.unboundedPreceding, 0)
    return _hits(spark, d).select("survey", "rank", F.sum("hit").over(along).alias("hits"))


@register("oracle_count", sql(f"""
    WITH {_HITS}, c AS (SELECT survey, rank, truth, sum(hit) OVER (PARTITION BY survey ORDER BY rank) AS hits FROM h),
    f AS (SELECT survey, rank, 2 * hits / greatest(rank + truth, 1)::DOUBLE AS f1 FROM c WHERE rank BETWEEN 4 AND 20),
    b AS (SELECT *, row_number() OVER (PARTITION BY survey ORDER BY f1 DESC, rank) AS r FROM f)
    SELECT survey, rank::INT AS k, round(f1, 6) AS f1 FROM b WHERE r = 1""", "scores", "pairs"))
def oracle_count(spark: SparkSession, d: str) -> DataFrame:
    return M.oracle_counts(_hits(spark, d), 4, 20).withColumn("f1", F.round("f1", 6))


@register("expected_f1_count", sql(f"""
    WITH {_T}, c AS (SELECT survey, rank, sum(p) OVER (PARTITION BY survey ORDER BY rank) AS upto, sum(p) OVER (PARTITION BY survey) AS total FROM t),
    f AS (SELECT survey, rank, round(2 * upto / (rank + 0.8::DOUBLE * total), 9) AS v FROM c WHERE rank BETWEEN 4 AND 20),
    b AS (SELECT *, row_number() OVER (PARTITION BY survey ORDER BY v DESC, rank) AS r FROM f)
    SELECT survey, rank::INT AS k, round(v, 6) AS expected FROM b WHERE r = 1""", "scores"))
def expected_f1_count(spark: SparkSession, d: str) -> DataFrame:
    return R.expected_f1_counts(_p(spark, d), "p", 4, 20, 0.8).withColumn("expected", F.round("expected", 6))


@register("threshold_list", sql(f"WITH {_T} SELECT survey, species, rank::INT AS rank FROM t WHERE rank <= 4 OR (p >= 0.7 AND rank <= 12)", "scores"))
def threshold_list(spark: SparkSession, d: str) -> DataFrame:
    return R.thresholded(_p(spark, d), "p", 0.7, 4, 12).select("survey", "species", "rank")


@register("max_normalised", sql("SELECT survey, species, round(p / max(p) OVER (PARTITION BY survey), 6) AS score FROM scores", "scores"))
def max_normalised(spark: SparkSession, d: str) -> DataFrame:
    return T.scores(spark, d).select("survey", "species", F.round(F.col("p") / F.max("p").over(Window.partitionBy("survey")), 6).alias("score"))


@register("adaptive_cardinality", sql("""
    SELECT survey, least(greatest(round_even((exp(ln(1 + n)) - 1) * 1.2, 0), 4), 50)::INT AS k FROM (SELECT survey, count(*) AS n FROM pairs GROUP BY 1)""", "pairs"))
def adaptive_cardinality(spark: SparkSession, d: str) -> DataFrame:
    n = T.pairs(spark, d).groupBy("survey").agg(F.count("*").alias("n"))
    return n.select("survey", R.adaptive_count(F.log1p("n"), 1.2, 4, 50).alias("k"))


@register("probability_blend", sql("SELECT survey, species, round(0.25 * p + 0.75 * (p + q) / 2, 6) AS score FROM scores", "scores"))
def probability_blend(spark: SparkSession, d: str) -> DataFrame:
    return T.scores(spark, d).select("survey", "species", F.round(0.25 * F.col("p") + 0.75 * (F.col("p") + F.col("q")) / 2, 6).alias("score"))


_GATE = "least(greatest(ln(1 + abs(lat - 48) * 111) / ln(201::DOUBLE), 0), 1)"


@register("gated_mix", sql(f"""
    SELECT survey, species, round((1 - 0.2 * g) * p + 0.2 * g * q, 6) AS score, CASE WHEN g < 0.5 THEN 16 ELSE 20 END AS k
    FROM scores JOIN (SELECT survey, {_GATE} AS g FROM surveys) USING (survey)""", "scores", "surveys"))
def gated_mix(spark: SparkSession, d: str) -> DataFrame:
    gate = R.log_ramp(F.abs(F.col("lat") - 48) * 111, 201.0)
    s = T.scores(spark, d).join(T.surveys(spark, d).select("survey", gate.alias("g")), "survey")
    score = F.round(R.mixed(F.col("p"), F.col("q"), 0.2, F.col("g")), 6)
    return s.select("survey", "species", score.alias("score"), F.when(F.col("g") < 0.5, 16).otherwise(20).alias("k"))


@register("risk_components", sql("""
    SELECT site, round(least(greatest(ln(1 + abs(lat - 48) * 111) / ln(51::DOUBLE), 0), 1), 6) AS r51, round(least(greatest(ln(1 + abs(lat - 48) * 111) / ln(301::DOUBLE), 0), 1), 6) AS r301,
           round(1 / (1 + abs(lat - 48) * 111), 6) AS support, round(exp(-abs(lat - 48) * 111 / 10), 6) AS kernel FROM sites""", "sites"))
def risk_components(spark: SparkSession, d: str) -> DataFrame:
    km = F.abs(F.col("lat") - 48) * 111
    return T.sites(spark, d).select("site", F.round(R.log_ramp(km, 51.0), 6).alias("r51"), F.round(R.log_ramp(km, 301.0), 6).alias("r301"), F.round(1 / (1 + km), 6).alias("support"), F.round(F.exp(-km / 10), 6).alias("kernel"))


_FUSED = f"{_T}, {_U}, s AS (SELECT survey, species, 0.7 / (10 + rank) AS score FROM t WHERE rank <= 20 UNION ALL SELECT survey, species, 0.3 / (10 + rank) FROM u WHERE rank <= 20), x AS (SELECT survey, species, round(sum(score), 9) AS score FROM s GROUP BY ALL), y AS (SELECT *, row_number() OVER (PARTITION BY survey ORDER BY score DESC, species) AS rank FROM x)"


def _fused(spark: SparkSession, d: str) -> DataFrame:
    """Fused ranking of both members, with their own ranks: three windows over one partitioning."""
    both = R.fused_ranks(R.ranked_by(T.scores(spark, d), "p", "q"), {"rank_p": 0.7, "rank_q": 0.3}, 10, 20)
    return R.ranked(both.withColumn("score", F.round("score", 9)))


@register("rank_fusion", sql(f"WITH {_FUSED} SELECT survey, species, rank::INT AS rank FROM y WHERE rank <= 12", "scores"))
def rank_fusion(spark: SparkSession, d: str) -> DataFrame:
    return _fused(spark, d).where("rank <= 12").select("survey", "species", "rank")


@register("quota_composer", sql(f"""
    WITH {_FUSED}, z AS (SELECT y.*, coalesce(n, 0) <= 25 AS rare, coalesce(n, 0) <= 18 AS zero, t.rank > 12 AS fresh FROM y LEFT JOIN prevalence USING (species) JOIN t USING (survey, species)),
    a AS (SELECT *, sum((rare AND fresh)::INT) OVER (PARTITION BY survey ORDER BY rank) AS nr FROM z),
    b AS (SELECT *, sum((zero AND fresh)::INT) OVER (PARTITION BY survey ORDER BY rank) AS nz FROM a WHERE NOT (rare AND fresh) OR nr <= 4),
    c AS (SELECT survey, species, row_number() OVER (PARTITION BY survey ORDER BY rank) AS rank FROM b WHERE NOT (zero AND fresh) OR nz <= 2)
    SELECT survey, species, rank::INT AS rank FROM c WHERE rank <= 16""".replace("y.*, coalesce", "y.survey, y.species, y.rank, coalesce"), "scores", "prevalence"))
def quota_composer(spark: SparkSession, d: str) -> DataFrame:
    z = _fused(spark, d).withColumn("fresh", F.col("rank_p") > 12).join(T.prevalence(spark, d), "species", "left").na.fill(0, ["n"])
    z = z.select("survey", "species", "rank", "fresh", (F.col("n") <= 25).alias("rare"), (F.col("n") <= 18).alias("zero"))
    return R.with_quotas(z, {"rare": 4, "zero": 2}, "fresh").where("rank <= 16").select("survey", "species", "rank")


_EDIT = f"""{_T}, {_U}, base AS (SELECT survey, species, t.rank, u.q AS score FROM t JOIN u USING (survey, species) WHERE t.rank <= 12),
    n AS (SELECT survey, count(*) AS n FROM base GROUP BY 1)"""


@register("residual_edit", sql(f"""
    WITH {_EDIT}, o AS (SELECT b.survey, species AS out, score, b.rank, row_number() OVER (PARTITION BY b.survey ORDER BY score, b.rank DESC) AS i FROM base b JOIN n USING (survey) WHERE b.rank > ceil(n * 0.6)),
    c AS (SELECT survey, species AS into_, q AS score, row_number() OVER (PARTITION BY survey ORDER BY q DESC, species) AS i FROM u ANTI JOIN base USING (survey, species)),
    s AS (SELECT o.survey, o.i, out, into_ FROM o JOIN c ON o.survey = c.survey AND o.i = c.i WHERE o.i <= 4 AND c.score > o.score),
    l AS (SELECT b.survey, b.species, 0 AS turn, b.rank AS place FROM base b LEFT JOIN s ON s.survey = b.survey AND s.out = b.species WHERE s.survey IS NULL UNION ALL SELECT survey, into_, 1, i FROM s)
    SELECT survey, species, row_number() OVER (PARTITION BY survey ORDER BY turn, place)::INT AS rank FROM l""", "scores"))
def residual_edit(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d).select("survey", "species", "rank", F.col("q").alias("score"))
    each = R.swaps(p, 12, lambda n: F.ceil(n * 0.6), 4, lambda low, high: high > low)
    rest = F.filter("base", lambda x: ~F.array_contains(F.col("swaps.out"), x))
    rows = each.select("survey", F.posexplode(F.concat(rest, F.col("swaps.into"))).alias("at", "species"))
    return rows.select("survey", "species", (F.col("at") + 1).alias("rank"))


@register("bounded_tail_swap", sql(f"""
    WITH {_EDIT}, r AS (SELECT survey, {_GATE} AS risk FROM surveys),
    o AS (SELECT b.survey, species AS out, score, row_number() OVER (PARTITION BY b.survey ORDER BY score, b.rank DESC) AS i FROM base b JOIN n USING (survey) WHERE b.rank > n // 2),
    c AS (SELECT survey, species AS into_, q AS score, row_number() OVER (PARTITION BY survey ORDER BY q DESC, species) AS i FROM u ANTI JOIN base USING (survey, species))
    SELECT o.survey, o.i::INT AS i, out, into_ AS "into" FROM o JOIN c ON o.survey = c.survey AND o.i = c.i JOIN r ON r.survey = o.survey
    WHERE o.i <= greatest(1, ceil(4 * risk)) AND c.score - o.score >= 0.05""", "scores", "surveys"))
def bounded_tail_swap(spark: SparkSession, d: str) -> DataFrame:
    p = _p(spark, d).select("survey", "species", "rank", F.col("q").alias("score"))
    risk = T.surveys(spark, d).select("survey", R.log_ramp(F.abs(F.col("lat") - 48) * 111, 201.0).alias("risk"))
    each = R.swaps(p, 12, lambda n: F.floor(n / 2), 4, lambda low, high: high - low >= 0.05).where(F.size("swaps") > 0)
    rows = each.join(risk, "survey").select("survey", "risk", F.explode("swaps").alias("x"))
    return rows.where(F.col("x.i") <= F.greatest(F.lit(1), F.ceil(4 * F.col("risk")))).select("survey", "x.i", "x.out", "x.into")


@register("single_edit_utility", sql(f"""
    WITH {_HITS}, b AS (SELECT survey, sum(hit) AS tp, max(truth) AS truth, count(*) AS k FROM h WHERE rank <= 12 GROUP BY 1)
    SELECT survey, round(100 * (2 * (tp + 1) / (k + 1 + truth)::DOUBLE - 2 * tp / (k + truth)::DOUBLE), 6) AS add_hit,
           round(100 * (2 * tp / (k - 1 + truth)::DOUBLE - 2 * tp / (k + truth)::DOUBLE), 6) AS remove_miss FROM b""", "scores", "pairs"))
def single_edit_utility(spark: SparkSession, d: str) -> DataFrame:
    b = _hits(spark, d).where("rank <= 12").groupBy("survey").agg(F.sum("hit").alias("tp"), F.max("truth").alias("truth"), F.count("*").alias("k"))
    f = lambda tp, k: 2 * tp / (k + F.col("truth"))
    tp, k = F.col("tp"), F.col("k")
    return b.select("survey", F.round(100 * (f(tp + 1, k + 1) - f(tp, k)), 6).alias("add_hit"), F.round(100 * (f(tp, k - 1) - f(tp, k)), 6).alias("remove_miss"))


@register("edit_features", sql(f"""
    WITH {_T}, {_U}, a AS (SELECT survey, species, rank FROM t WHERE rank <= 16), b AS (SELECT survey, species, rank FROM u WHERE rank <= 16)
    SELECT survey, species, coalesce(a.rank, 17)::INT AS rank_p, coalesce(b.rank, 17)::INT AS rank_q, round(1 / coalesce(a.rank, 17)::DOUBLE, 6) AS inverse_p,
           a.rank IS NOT NULL AND b.rank IS NOT NULL AS in_both FROM a FULL JOIN b USING (survey, species)""", "scores"))
def edit_features(spark: SparkSession, d: str) -> DataFrame:
    s = T.scores(spark, d)
    a, b = (R.ranked(s, c, 16).select("survey", "species", F.col("rank").alias(f"rank_{c}")) for c in "pq")
    both = a.join(b, ["survey", "species"], "full").withColumn("in_both", F.col("rank_p").isNotNull() & F.col("rank_q").isNotNull()).na.fill(17, ["rank_p", "rank_q"])
    return both.select("survey", "species", "rank_p", "rank_q", F.round(1 / F.col("rank_p"), 6).alias("inverse_p"), "in_both")


_LISTS = f"{_T}, {_U}, l AS (SELECT survey, list(species ORDER BY rank) AS a FROM t WHERE rank <= 12 GROUP BY 1), m AS (SELECT survey, list(species ORDER BY rank) AS b FROM u WHERE rank <= 12 GROUP BY 1)"


@register("list_overlap", sql(f"WITH {_LISTS} SELECT survey, len(list_intersect(a, b))::INT AS shared, round(1 - len(list_intersect(a, b)) / len(list_distinct(a || b))::DOUBLE, 6) AS distance, (len(a) - len(list_intersect(a, b)))::INT AS swaps FROM l JOIN m USING (survey)", "scores"))
def list_overlap(spark: SparkSession, d: str) -> DataFrame:
    s = T.scores(spark, d)
    a, b = (R.compact(s, c, 12).select("survey", F.col("species").alias(n)) for c, n in (("p", "a"), ("q", "b")))
    shared = F.size(F.array_intersect("a", "b"))
    return a.join(b, "survey").select("survey", shared.alias("shared"), F.round(1 - shared / F.size(F.array_union("a", "b")), 6).alias("distance"), (F.size("a") - shared).alias("swaps"))


@register("list_codec", sql(f"WITH {_T}, l AS (SELECT survey, string_agg(species::VARCHAR, ' ' ORDER BY rank) AS predictions, count(*) AS n, sum(species)::BIGINT AS total FROM t WHERE rank <= 8 GROUP BY 1) SELECT survey, predictions, n::INT AS n, total FROM l", "scores"))
def list_codec(spark: SparkSession, d: str) -> DataFrame:
    text = R.compact(T.scores(spark, d), "p", 8).select("survey", X.encode_list(F.col("species")).alias("predictions"))
    back = X.decode_list(F.col("predictions"))
    return text.select("survey", "predictions", F.size(back).alias("n"), F.aggregate(back, F.lit(0).cast("long"), lambda a, b: a + b).alias("total"))


@register("submission_rows", sql(f"WITH {_T}, l AS (SELECT survey, string_agg(species::VARCHAR, ' ' ORDER BY rank) AS predictions FROM t WHERE rank <= 8 GROUP BY 1) SELECT o_orderkey AS survey, coalesce(predictions, '') AS predictions FROM orders LEFT JOIN l ON survey = o_orderkey", "scores"))
def submission_rows(spark: SparkSession, d: str) -> DataFrame:
    from quadrat.sources.sinks import submission

    template = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("survey"))
    return submission(template, R.ranked(T.scores(spark, d), "p", 8))
