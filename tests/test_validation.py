"""Stored frames and comparators: what agrees is accepted, every single change is refused; the frequency baseline by hand."""

import uuid

import pytest
from pyspark.sql import functions as F

from quadrat.operators import metrics as M
from quadrat.operators import validation as V
from quadrat.sources.shared import shared_folder
from quadrat.sources.sinks import read_assessment, write_assessment


@pytest.fixture(scope="module")
def frame(spark):
    rows = [(i, f"b{i % 7}", (i * 37 % 101) / 101, (i * 53 % 97) / 97 + 1e-13 * i) for i in range(140)]
    return spark.createDataFrame(rows, "survey long, block string, f1 double, other double")


@pytest.fixture(scope="module")
def report(spark, frame):
    gains = frame.groupBy("block").agg(F.sum(F.col("other") - F.col("f1")).alias("total"), F.count("*").alias("n"))
    rows = [("other-f1", *M.block_bootstrap(gains, 100, 3, digits=None).first())]
    rows += [(c, frame.agg(F.avg(c)).first()[0], None, None) for c in ("f1", "other")]
    return spark.createDataFrame(rows, "name string, mean double, low double, high double")


def stored(spark, frame):
    path = f"{shared_folder(spark)}/assessment-{uuid.uuid4().hex}"
    write_assessment(frame, path)
    return read_assessment(spark, path, frame.schema)


def verdict(report, frame):
    return {r.name: r.agrees for r in V.compared(report, V.recomputed(frame, "other", ["f1"], "block", 100, 3)).collect()}


def test_a_stored_frame_gives_the_report_again(spark, frame, report):
    again = stored(spark, frame)
    assert sorted(again.collect()) == sorted(frame.collect())
    assert verdict(report, again) == {"other-f1": True, "f1": True, "other": True}


@pytest.mark.parametrize("column, refused", [("other", {"other", "other-f1"}), ("f1", {"f1", "other-f1"}), ("block", {"other-f1"})])
def test_one_changed_value_is_refused(spark, frame, report, column, refused):
    new = F.lit("b0") if column == "block" else F.col(column) + 1e-9
    changed = frame.withColumn(column, F.when(F.col("survey") == 71, new).otherwise(F.col(column)))
    assert {n for n, ok in verdict(report, stored(spark, changed)).items() if not ok} == refused


def test_missing_numbers_are_refused(spark, frame, report):
    assert not verdict(report.where("name <> 'f1'"), frame)["f1"]
    assert not verdict(report.unionByName(report.limit(1).withColumn("name", F.lit("more"))), frame)["more"]


def test_a_stored_value_of_another_type_is_an_error(spark, frame):
    path = f"{shared_folder(spark)}/assessment-{uuid.uuid4().hex}"
    write_assessment(frame.withColumn("f1", F.when(F.col("survey") == 5, "lost").otherwise(F.col("f1").cast("string"))), path)
    with pytest.raises(Exception, match="(?i)malformed|parse"):
        read_assessment(spark, path, frame.schema).collect()


@pytest.fixture(scope="module")
def tables(spark):
    rows = spark.createDataFrame([(i, i % 2, "assessment" if i % 3 else "calibration") for i in range(60)], "survey long, fold int, role string")
    labels = spark.createDataFrame([(i, i * k % 11) for i in range(60) for k in (1, 2)], "survey long, species long").distinct()
    species = spark.createDataFrame([(k,) for k in range(11)], "species long")
    scores = rows.withColumn("f1", (F.col("survey") % 10) / 10.0)
    return rows, labels, species, scores, V.bindings(rows, labels, species).cache()


def refusals(tables, **changes):
    rows, labels, species, scores, bindings = tables
    now = {"rows": rows, "labels": labels, "species": species, **changes}
    got = V.bound(changes.get("scores", scores), bindings, now["rows"], now["labels"], now["species"]).collect()
    return {r.name for r in got if not r.holds}


def test_bound_comparator(tables):
    assert refusals(tables) == set()


def test_refusals(spark, tables):
    rows, labels, species, scores, _ = tables
    assert refusals(tables, species=species.where("species <> 4")) == {"species"}
    assert refusals(tables, labels=labels.where("survey <> 7 or species <> 7")) == {"labels"}
    moved = rows.withColumn("role", F.when(F.col("survey") == 9, "assessment").otherwise(F.col("role")))
    assert refusals(tables, rows=moved) == {"ids:1:assessment", "ids:1:calibration", "surveys_known", "assessment_complete"}
    assert refusals(tables, scores=scores.where("survey <> 10")) == {"assessment_complete"}
    assert refusals(tables, scores=scores.where("survey <> 12")) == set()  # a calibration score may lack
    for bad in (1.01, float("nan"), None):
        new = scores.withColumn("f1", F.when(F.col("survey") == 8, F.lit(bad).cast("double")).otherwise(F.col("f1")))
        assert refusals(tables, scores=new) == {"scores_in_bounds"}
    assert refusals(tables, scores=scores.unionByName(scores.where("survey = 4"))) == {"surveys_once"}
    assert refusals(tables, scores=scores.unionByName(scores.where("survey = 4").withColumn("survey", F.lit(999).cast("long")))) == {"surveys_known"}


def test_frequency_baseline_by_hand(spark):
    """Five surveys of two species; the first three teach."""
    pairs = spark.createDataFrame([(1, 10), (1, 11), (2, 10), (2, 12), (3, 10), (3, 13), (4, 14), (4, 15), (5, 10), (5, 16)], "survey long, species long")
    got = M.frequency_baseline(pairs, F.col("survey") <= 3).first().asDict()
    assert got == {
        "train_surveys": 3, "validation_surveys": 2, "train_species": 4, "validation_species": 4, "unseen_species": 3, "train_mean_labels": 2.0, "k": 2, "micro_f1": 0.25, "sample_f1": 0.25,
        "macro_f1": 0.166667, "precision": 0.25, "recall": 0.25, "hits": 1, "predicted": 4, "actual": 4,
    }
