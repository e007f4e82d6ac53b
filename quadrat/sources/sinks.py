"""Sinks: submissions in template order, reports, compact diagnostics, and contracts checked before anything is written."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from quadrat.functions.text import encode_list


def submission(template: DataFrame, ranking: DataFrame) -> DataFrame:
    """survey and predictions (ids joined by spaces, best first) of every template row; the template's columns stay."""
    lists = ranking.groupBy("survey").agg(F.sort_array(F.collect_list(F.struct("rank", "species"))).alias("b"))
    text = lists.select("survey", encode_list(F.col("b.species")).alias("predictions"))
    return template.join(text, "survey", "left").na.fill("", ["predictions"])


def check_submission(rows: DataFrame, template: DataFrame, vocabulary: DataFrame, low: int, high: int) -> None:
    """Raise where a survey is absent, foreign or repeated, or a list repeats, leaves the vocabulary or the bounds."""
    ids = F.split("predictions", " ")
    n = F.when(F.col("predictions") == "", 0).otherwise(F.size(ids))
    repeated = rows.groupBy("survey").count().where("count > 1").count()
    absent = template.select("survey").join(rows, "survey", "left_anti").count()
    foreign = rows.join(template.select("survey"), "survey", "left_anti").count()
    bad = rows.agg(F.count_if((n < low) | (n > high)).alias("length"), F.count_if((n > 0) & (F.size(F.array_distinct(ids)) < F.size(ids))).alias("twice")).first()
    known = vocabulary.select(F.col("species").cast("string").alias("id"))
    unknown = rows.where(F.col("predictions") != "").select(F.explode(ids).alias("id")).join(known, "id", "left_anti").count()
    found = {"repeated": repeated, "absent": absent, "foreign": foreign, "length": bad["length"], "twice": bad["twice"], "unknown": unknown}
    if any(found.values()):
        raise ValueError(f"submission: {found}")


def write_submission(rows: DataFrame, path: str, order: str) -> None:
    """CSV with CRLF line ends in the order of a template column: files in the order of their names, each a range of rows."""
    rows.orderBy(order).select("survey", "predictions").write.option("header", True).option("lineSep", "\r\n").csv(path)


def write_assessment(frame: DataFrame, path: str) -> None:
    """The scores of every survey as CSV, in the order of surveys."""
    frame.orderBy("survey").write.option("header", True).csv(path)


def read_assessment(spark: SparkSession, path: str, schema: StructType) -> DataFrame:
    """A stored assessment; a value that is not of its column's type is an error."""
    return spark.read.schema(schema).option("header", True).option("mode", "FAILFAST").option("enforceSchema", False).csv(path)


def diagnostics(ranking: DataFrame, truth: DataFrame, surveys: DataFrame, score: str, most: int = 64) -> DataFrame:
    """One compact row a survey of ``surveys`` (survey, weight and further columns): its first ``most`` species and scores,
    the mass of all scores, and its labels.  Arrays are bounded by ``most`` and by a survey's own labels."""
    best = F.sort_array(F.collect_list(F.when(F.col("rank") <= most, F.struct("rank", "species", F.col(score).alias("score")))))
    lists = ranking.groupBy("survey").agg(best.alias("_b"), F.sum(score).alias("mass")).select("survey", F.col("_b.species").alias("species"), F.col("_b.score").alias("scores"), "mass")
    labels = truth.groupBy("survey").agg(F.sort_array(F.collect_set("species")).alias("truth"))
    return surveys.join(lists, "survey").join(labels, "survey", "left").withColumn("truth", F.coalesce("truth", F.array().cast("array<bigint>")))


def write_diagnostics(rows: DataFrame, path: str, by: str) -> None:
    """Diagnostics as Parquet, one folder for each value of ``by`` (such as the fold)."""
    rows.write.partitionBy(by).parquet(path)


def report(row: DataFrame) -> str:
    """Sorted JSON of a table of one row."""
    return json.dumps(row.first().asDict(recursive=True), sort_keys=True, default=str)


def publish(candidate: DataFrame, current_digest: str | None, gate: DataFrame, path: str, order: str) -> str:
    """Write the candidate if every boolean of the gate's one row is true and it differs from what is there; else say so."""
    state = gate.first()
    if state is None or not all(v is True for v in state.asDict().values()):
        return "NO_SUBMISSION"
    from quadrat.operators.digests import ordered_digests

    text = F.concat_ws(":", F.col("survey").cast("string"), F.coalesce(F.col("predictions").cast("string"), F.lit("")))
    row = ordered_digests(candidate.select("survey", "predictions", *([order] if order not in ("survey", "predictions") else [])), [], list(dict.fromkeys([order, "survey", "predictions"])), text).first()
    digest = f"{row['digest']}:{row['n']}" if row else ""
    if digest == current_digest:
        return "NO_SUBMISSION"
    write_submission(candidate, path, order)
    return digest
