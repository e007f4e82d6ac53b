"""Queries over boosted regressions; the models have no SQL form."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.functions import features as E
from quadrat.operators import metrics as M
from quadrat.operators import ranking as R
from quadrat.operators import regress as G
from quadrat.plans.ranking import _hits
from quadrat.registry import register
from quadrat.sources import tables as T
from quadrat.sources.shared import written


@register("count_regression")
def count_regression(spark: SparkSession, d: str) -> DataFrame:
    """The length of every survey's list, regressed on the best lengths of training surveys, within 4..20."""
    hits = _hits(spark, d)
    phase = F.sin(2 * 3.141592653589793 * F.col("month") / 12)
    places = T.surveys(spark, d).select("survey", "lat", "lon", F.abs(F.col("lat") - 48).alias("distance"), phase.alias("season"))
    columns = written(G.count_columns(R.ranked(T.scores(spark, d), "p"), "p", places), "counts")
    some = G.sampled(columns.where("survey % 5 <> 0"))
    best = M.oracle_counts(hits.join(F.broadcast(some), "survey", "left_semi"), 4, 20)
    predict = G.fitted(columns.join(best.select("survey", "k"), "survey"), G.COUNT_COLUMNS, "k")
    k = F.least(F.greatest(F.rint("predicted"), F.lit(4.0)), F.lit(20.0)).cast("int")
    return predict(columns).select("survey", k.alias("k"))


@register("edit_regression")
def edit_regression(spark: SparkSession, d: str) -> DataFrame:
    """The predicted gain of every single edit, regressed on the true gains of training surveys of equal total weight."""
    table = written(E.edit_columns(T.marked(spark, d), 12, 16), "edits")
    some = G.sampled(table.where("survey % 5 <> 0"), 1_000)
    rows = G.edit_targets(table.join(F.broadcast(some), "survey", "left_semi"), "inside", T.pairs(spark, d))
    predict = G.fitted(rows, [c for c in table.columns if c not in ("survey", "species")], "target", "share")
    return predict(table).select("survey", "species", F.round(F.col("predicted") / 100, 6).alias("gain"))
