"""Columns of edits: a survey is ranked where its candidates are."""

from compare import DATA

from quadrat.queries import QUERIES


def test_candidates_are_not_sorted_by_spark(spark):
    plan = QUERIES["edit_columns"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" not in plan and "MapInArrow" in plan
