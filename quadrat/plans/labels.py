"""Queries over labels: scans, filters, alignment, counts, the frequency baseline."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quadrat.operators import labels as L
from quadrat.operators import metrics as M
from quadrat.registry import register
from quadrat.sources import tables as T
from quadrat.sources.tables import sql


@register("label_pairs", sql("SELECT survey, species FROM pairs", "pairs"))
def label_pairs(spark: SparkSession, d: str) -> DataFrame:
    return T.pairs(spark, d)


@register("survey_dimension", """
    SELECT l_orderkey AS survey, arg_min(l_suppkey, (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey) AS publisher,
           arg_min(l_quantity, (l_linenumber * 1000000 + l_partkey) * 1000 + l_suppkey) AS quantity FROM lineitem GROUP BY 1""")
def survey_dimension(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "lineitem").select(F.col("l_orderkey").alias("survey"), F.col("l_suppkey").alias("publisher"), F.col("l_quantity").alias("quantity"), ((F.col("l_linenumber") * 1000000 + F.col("l_partkey")) * 1000 + F.col("l_suppkey")).alias("place"))
    return L.first_rows(rows, "survey", "place", ["publisher", "quantity"])


@register("vocabulary_index", sql("SELECT species, col FROM vocabulary", "vocabulary"))
def vocabulary_index(spark: SparkSession, d: str) -> DataFrame:
    return T.vocabulary(spark, d)


@register("coercion", """
    SELECT event_id, CASE WHEN event_id % 17 = 0 THEN NULL ELSE TRY_CAST(CASE WHEN event_id % 19 = 0 THEN 'x' ELSE CAST(user_id AS VARCHAR) END AS BIGINT) END AS lenient,
           CAST(CAST(user_id AS VARCHAR) AS BIGINT) AS strict FROM events""")
def coercion(spark: SparkSession, d: str) -> DataFrame:
    text = F.col("user_id").cast("string")
    dirty = F.when(F.col("event_id") % 17 == 0, None).otherwise(F.when(F.col("event_id") % 19 == 0, "x").otherwise(text))
    return T.table(spark, d, "events").select("event_id", dirty.try_cast("long").alias("lenient"), text.cast("long").alias("strict"))


@register("rejection_counters", sql("""
    SELECT count(*) FILTER (NOT (lat BETWEEN 45 AND 90)) AS latitude, count(*) FILTER (NOT (uncertainty IS NULL OR uncertainty <= 1000)) AS uncertainty,
           count(*) FILTER (species IS NULL) AS species,
           count(*) FILTER (lat BETWEEN 45 AND 90 AND (uncertainty IS NULL OR uncertainty <= 1000) AND species IS NOT NULL) AS kept FROM occurrences""", "occurrences"))
def rejection_counters(spark: SparkSession, d: str) -> DataFrame:
    u = F.col("uncertainty")
    return L.rejections(T.occurrences(spark, d), {"latitude": ~F.col("lat").between(45, 90), "uncertainty": u.isNotNull() & (u > 1000), "species": F.col("species").isNull()})


@register("clean_strings", """
    SELECT c_custkey AS site, CASE WHEN c_custkey % 7 = 0 THEN '__missing__' WHEN c_custkey % 11 = 0 THEN '__missing__' ELSE trim(c_mktsegment) END AS segment FROM customer""")
def clean_strings(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey")
    dirty = F.when(k % 7 == 0, F.lit(" nan ")).when(k % 11 == 0, None).otherwise(F.concat(F.lit(" "), "c_mktsegment", F.lit(" ")))
    return T.table(spark, d, "customer").select(k.alias("site"), L.clean(dirty, "__missing__").alias("segment"))


@register("missing_flags", """
    WITH x AS (SELECT o_orderkey AS survey, CASE WHEN o_orderkey % 17 = 0 OR o_orderkey % 19 = 0 THEN NULL ELSE o_totalprice END AS price, 1.0::DOUBLE AS flat FROM orders)
    SELECT survey, price, (price IS NULL)::INT::DOUBLE AS price_missing FROM x""")
def missing_flags(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("o_orderkey")
    dirty = F.when(k % 17 == 0, None).when(k % 19 == 0, float("nan")).otherwise(F.col("o_totalprice"))
    rows = T.table(spark, d, "orders").select(k.alias("survey"), L.finite(dirty).alias("price"), F.lit(1.0).alias("flat"))
    fit = F.col("survey") % 2 == 0
    kept = L.varying(rows, ["price", "flat"], fit)
    return L.with_missing_flags(rows.select("survey", *kept), kept, fit)


@register("hashed_row_cap", """
    SELECT o_orderkey AS survey FROM orders ORDER BY sha256(o_orderkey::VARCHAR || ':2025'), o_orderkey LIMIT 500""")
def hashed_row_cap(spark: SparkSession, d: str) -> DataFrame:
    ids = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("survey"))
    return ids.orderBy(F.sha2(F.concat(F.col("survey").cast("string"), F.lit(":2025")), 256), "survey").limit(500)


@register("modality_completeness", sql("""
    SELECT s.survey, EXISTS (SELECT 1 FROM pairs p WHERE p.survey = s.survey) AS complete FROM surveys s""", "surveys", "pairs"))
def modality_completeness(spark: SparkSession, d: str) -> DataFrame:
    s = T.surveys(spark, d).select("survey")
    have = T.pairs(spark, d).select("survey").distinct().withColumn("complete", F.lit(True))
    return s.join(have, "survey", "left").na.fill(False, ["complete"])


@register("keyed_alignment", sql("SELECT survey, site, country, round(price, 2) AS price FROM surveys", "surveys"))
def keyed_alignment(spark: SparkSession, d: str) -> DataFrame:
    ids = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("survey"))
    return L.aligned(ids, T.surveys(spark, d).select("survey", "site", "country", F.round("price", 2).alias("price")), "survey")


@register("dictionary_encode", sql("""
    SELECT l.survey, l.line, v.col FROM occurrences l LEFT JOIN (SELECT * FROM vocabulary WHERE species % 10 <> 0) v USING (species)""", "occurrences", "vocabulary"))
def dictionary_encode(spark: SparkSession, d: str) -> DataFrame:
    return T.occurrences(spark, d).join(T.vocabulary(spark, d).where("species % 10 <> 0"), "species", "left").select("survey", "line", "col")


@register("overlap_diagnostics", sql("""
    WITH a AS (SELECT DISTINCT species FROM pairs WHERE survey % 5 = 0), b AS (SELECT DISTINCT species FROM pairs WHERE survey % 5 <> 0)
    SELECT (SELECT count(*) FROM a) AS left_only_and_shared, (SELECT count(*) FROM a SEMI JOIN b USING (species)) AS shared,
           (SELECT count(*) FROM a ANTI JOIN b USING (species)) AS unseen""", "pairs"))
def overlap_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    p = T.pairs(spark, d)
    a, b = (p.where(c).select("species").distinct() for c in ("survey % 5 = 0", "survey % 5 <> 0"))
    both = a.join(b.withColumn("there", F.lit(True)), "species", "left")
    return both.agg(F.count("*").alias("left_only_and_shared"), F.count_if("there").alias("shared"), F.count_if(F.col("there").isNull()).alias("unseen"))


@register("metadata_conflicts", """
    SELECT l_orderkey AS survey, count(DISTINCT l_suppkey) AS publishers, count(DISTINCT l_returnflag) AS flags, count(*) AS n FROM lineitem
    GROUP BY 1 HAVING count(DISTINCT l_suppkey) > 1 OR count(DISTINCT l_returnflag) > 1""")
def metadata_conflicts(spark: SparkSession, d: str) -> DataFrame:
    g = T.table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("survey")).agg(F.count_distinct("l_suppkey").alias("publishers"), F.count_distinct("l_returnflag").alias("flags"), F.count("*").alias("n"))
    return g.where("publishers > 1 or flags > 1")


@register("species_prevalence", sql("SELECT v.species, coalesce(n, 0) AS n FROM vocabulary v LEFT JOIN prevalence USING (species)", "vocabulary", "prevalence"))
def species_prevalence(spark: SparkSession, d: str) -> DataFrame:
    return T.vocabulary(spark, d).select("species").join(T.prevalence(spark, d), "species", "left").na.fill(0, ["n"])


@register("survey_cardinality", sql("SELECT o_orderkey AS survey, count(p.species) AS n FROM orders LEFT JOIN pairs p ON survey = o_orderkey GROUP BY 1", "pairs"))
def survey_cardinality(spark: SparkSession, d: str) -> DataFrame:
    ids = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("survey"))
    return ids.join(T.pairs(spark, d), "survey", "left").groupBy("survey").agg(F.count("species").alias("n"))


@register("rare_species_sets", sql("""
    SELECT species, n <= 25 AS rare25, n <= 50 AS rare50, n > 5 AS active,
           n >= 5 AND n / (SELECT count(DISTINCT survey) FROM pairs)::DOUBLE <= 0.005 AS specialist FROM prevalence""", "pairs", "prevalence"))
def rare_species_sets(spark: SparkSession, d: str) -> DataFrame:
    n = F.col("n")
    total = T.pairs(spark, d).agg(F.count_distinct("survey").alias("total"))
    p = T.prevalence(spark, d).join(F.broadcast(total), F.lit(True))
    return p.select("species", (n <= 25).alias("rare25"), (n <= 50).alias("rare50"), (n > 5).alias("active"), ((n >= 5) & (n / F.col("total") <= 0.005)).alias("specialist"))


@register("delta_ids", """
    WITH o AS (SELECT o_orderkey AS survey FROM orders), e AS (SELECT survey, survey - coalesce(lag(survey) OVER (ORDER BY survey), 0) AS delta FROM o)
    SELECT survey, delta, sum(delta) OVER (ORDER BY survey)::BIGINT AS decoded FROM e""")
def delta_ids(spark: SparkSession, d: str) -> DataFrame:
    """The sorted ids as differences, and the ids that running sums of these give back."""
    from quadrat.operators.stats import running_sums, with_previous

    o = T.table(spark, d, "orders").select(F.col("o_orderkey").alias("survey"))
    e = with_previous(o, [], "survey").withColumn("delta", F.col("survey") - F.coalesce("previous", F.lit(0)))
    return running_sums(e.select("survey", "delta"), [], ["survey"], "delta").select("survey", "delta", F.col("upto").alias("decoded"))


@register("raster_paths", """
    SELECT o_orderkey AS survey, 'train/' || lpad((o_orderkey % 100)::VARCHAR, 2, '0') || '/' || lpad((o_orderkey // 100 % 100)::VARCHAR, 2, '0') || '/' || o_orderkey || '.tiff' AS path FROM orders""")
def raster_paths(spark: SparkSession, d: str) -> DataFrame:
    from quadrat.functions.text import raster_path

    return T.table(spark, d, "orders").select(F.col("o_orderkey").alias("survey"), raster_path(F.lit("train"), F.col("o_orderkey")).alias("path"))


@register("frequency_baseline", sql("""
    WITH split AS (SELECT survey, (survey * 2654435761) % 100 < 80 AS train FROM (SELECT DISTINCT survey FROM pairs)),
    tp AS (SELECT p.* FROM pairs p JOIN split s USING (survey) WHERE s.train), vp AS (SELECT p.* FROM pairs p JOIN split s USING (survey) WHERE NOT s.train),
    k AS (SELECT greatest(1, round_even(avg(n), 0)) AS k FROM (SELECT survey, count(*) AS n FROM tp GROUP BY 1)),
    top AS (SELECT species FROM (SELECT species, row_number() OVER (ORDER BY count(*) DESC, species) AS r FROM tp GROUP BY 1) WHERE r <= (SELECT k FROM k)),
    per AS (SELECT v.survey, count(*) AS truth, count(t.species) AS hits FROM vp v LEFT JOIN top t USING (species) GROUP BY 1), n AS (SELECT count(*) AS n FROM top),
    s AS (SELECT count(*) AS validation_surveys, sum(truth)::BIGINT AS actual, sum(hits)::BIGINT AS hits, avg(2 * hits / greatest(truth + (SELECT n FROM n), 1)::DOUBLE) AS f1, count(*) * (SELECT n FROM n) AS predicted FROM per),
    m AS (SELECT count(*) AS validation_species, count(*) FILTER (species NOT IN (SELECT species FROM tp)) AS unseen_species, avg(CASE WHEN species IN (SELECT species FROM top) THEN 2 * c / ((SELECT validation_surveys FROM s) + c)::DOUBLE ELSE 0 END) AS macro FROM (SELECT species, count(*) AS c FROM vp GROUP BY 1))
    SELECT (SELECT count(*) FROM split WHERE train) AS train_surveys, validation_surveys, (SELECT count(DISTINCT species) FROM tp) AS train_species, validation_species, unseen_species,
           round((SELECT avg(n) FROM (SELECT survey, count(*) AS n FROM tp GROUP BY 1)), 6) AS train_mean_labels, (SELECT k FROM k)::INT AS k, round(2 * hits / greatest(predicted + actual, 1)::DOUBLE, 6) AS micro_f1, round(f1, 6) AS sample_f1, round(macro, 6) AS macro_f1,
           round(hits / greatest(predicted, 1)::DOUBLE, 6) AS precision, round(hits / greatest(actual, 1)::DOUBLE, 6) AS recall, hits, predicted, actual FROM s, m""", "pairs"))
def frequency_baseline(spark: SparkSession, d: str) -> DataFrame:
    return M.frequency_baseline(T.pairs(spark, d), F.pmod(F.col("survey") * 2654435761, F.lit(100)) < 80)
