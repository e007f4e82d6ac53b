"""Grids, gate sets and checkpoint scores against fixed sizes, closed forms and fixtures that pass and fail."""

import math

import pytest
from pyspark.sql import functions as F

from quadrat.operators import grids as G
from quadrat.operators import policies as Y
from quadrat.operators import search as S
from quadrat.operators.policy import judged, registered

# How many policies each registered grid has.
SIZES = {
    "cut": 76, "challenger": 125, "blend": 60, "gated": 12, "gated_wide": 14, "transition": 96, "bonus": 9, "adaptive": 7, "spatial": 6, "pyramid": 6, "tail": 5,
    "decode": 13, "members": 31, "habitat": 15, "bag": 22, "attention": 25, "graph": 17, "edits": 11, "trio": 15,
}


def test_grids_have_their_sizes(spark):
    table = G.table(spark)
    assert {r.grid: r["count"] for r in table.groupBy("grid").count().collect()} == SIZES
    assert table.select("grid", "place").distinct().count() == sum(SIZES.values())
    wide = table.where("grid = 'transition'")
    assert wide.where("gate = 'uniform' and k <> k_far").count() == 0 and wide.where("transition <> 0.5").count() == 0
    assert registered(wide, table, ["alpha", "gate", "k", "k_far"]).count() == 96
    with pytest.raises(ValueError, match="not registered"):
        registered(wide.withColumn("alpha", F.lit(0.07)), table, ["alpha", "gate", "k", "k_far"])


def test_mixtures_by_hand(spark):
    rows = [(1, s, p, q) for s, p, q in ((10, 0.9, 0.0), (11, 0.5, 0.4), (12, 0.1, 0.8), (13, 0.45, 0.4))]
    cands = spark.createDataFrame(rows, "survey long, species long, p double, q double")
    truth = spark.createDataFrame([(1, 11), (1, 12)], "survey long, species long")
    policies = spark.createDataFrame([(0, 0.0, 1), (1, 0.0, 2), (2, 0.5, 2), (3, 1.0, 1), (4, 1.0, 9)], "place int, alpha double, k int")
    a = F.col("alpha")
    each = S.ranked(S.packed(cands, truth, ["p", "q"]), policies, ["alpha"], lambda x: (1 - a) * x["p"] + a * x["q"], lambda p, s: p["k"])
    got = {r.place: (r.n, r.hits, r.f1) for r in each.collect()}
    assert got == {0: (1, 0, 0.0), 1: (2, 1, 0.5), 2: (2, 1, 0.5), 3: (1, 1, 2 / 3), 4: (4, 2, 2 / 3)}  # ties by species: 0.45 of 10, 11 and 12
    best = S.chosen(each, policies, [a, F.col("k")]).where("choice = 1").first()
    assert (best.place, best.f1) == (3, 0.666667)


GOOD = {
    "gain": 0.01, "ci_low": 0.002, "gain_over_zero": 0.01, "gain_over_base": 0.01, "gain_over_retained": 0.01, "blocks": 9, "iterations": 500, "seed_matches": 1, "length_mae_change": 0.2,
    "rare_f1_ratio": 0.9, "length_changed": 0, "most_swaps": 3, "registered": 1, "alpha": 0.1, "new_policy": 1, "common_f1_change": -0.001, "buffer_km": 21, "macro_gain": 0.01, "rows": 40, "integrity": 1,
}


def fixture(spark, **changes):
    """One long table in which every gate of every set holds, but for ``changes`` (level__metric=value; None leaves it out)."""
    rows = []
    for _, _, metric, level, _, _, least in G.gate_rows():
        names = ["0", "1"] if level in ("fold", "country_100", "country_200") else ["all"]
        for name in names:
            value = changes.get(f"{level}__{metric}__{name}", changes.get(f"{level}__{metric}", GOOD[metric]))
            if value is not None:
                rows.append((level, name, metric, float(value)))
    return spark.createDataFrame(sorted(set(rows)), "level string, name string, metric string, value double")


def promoted(spark, **changes):
    got = judged(fixture(spark, **changes), G.gate_table(spark)).collect()
    return {r.gate_set for r in got if r.promoted}, {(r.gate_set, r.gate) for r in got if not r.holds}


EVERY = {"first_expert", "retained_expert", "single_head", "pyramid", "tail", "residual", "practical"}


def test_every_set_promotes_what_is_good(spark):
    assert promoted(spark) == (EVERY, set())


@pytest.mark.parametrize(
    "changes, fails",
    [
        ({"all__ci_low": 0.0}, EVERY),
        ({"all__ci_low": 0.0002}, {"practical"}),
        ({"all__gain": math.nan}, {"first_expert", "pyramid", "tail", "residual", "practical"}),
        ({"all__gain": 0.0009}, {"practical"}),
        ({"fold__gain__1": -0.1}, EVERY - {"first_expert"}),
        ({"fold__gain__1": None}, EVERY - {"first_expert"}),
        ({"fold__alpha__0": 0}, {"retained_expert", "single_head"}),
        ({"production__alpha": None}, {"retained_expert", "single_head"}),
        ({"policy__registered": 0}, {"first_expert"}),
        ({"all__iterations": 499}, {"first_expert"}),
        ({"all__blocks": 1}, {"first_expert"}),
        ({"check__integrity": 0}, {"first_expert", "retained_expert", "single_head", "practical"}),
        ({"country_200__gain__0": -1}, {"pyramid"}),
        ({"country_100__gain__0": 0}, {"tail"}),
        ({"fold__common_f1_change__0": -0.0021}, {"pyramid"}),
        ({"all__length_mae_change": 0.26}, {"pyramid"}),
        ({"all__rare_f1_ratio": 0.79}, {"pyramid"}),
        ({"all__length_changed": 1}, {"tail"}),
        ({"all__most_swaps": 5}, {"tail"}),
        ({"all__most_swaps": 0}, {"tail"}),
        ({"outside__rows": 29}, {"residual", "practical"}),
        ({"outside__gain": 0.0004}, {"practical"}),
        ({"country_30__macro_gain": 0}, {"residual", "practical"}),
        ({"fold__buffer_km__1": 19.9}, {"residual", "practical"}),
        ({"policy__new_policy": 0}, {"pyramid", "tail", "residual"}),
        ({"all__gain_over_zero": 0}, {"first_expert", "retained_expert", "single_head"}),
        ({"all__gain_over_base": 0}, {"retained_expert"}),
        ({"all__gain_over_retained": -0.1}, {"single_head"}),
    ],
)
def test_one_fault_stops_the_sets_that_ask_for_it(spark, changes, fails):
    sets, gates = promoted(spark, **changes)
    assert EVERY - sets == fails == {s for s, _ in gates}


def test_nothing_promotes_nothing(spark):
    none = spark.createDataFrame([], "level string, name string, metric string, value double")
    got = judged(none, G.gate_table(spark)).collect()
    assert len(got) == len(G.gate_rows()) and not any(r.holds or r.promoted for r in got)


def test_checkpoint_score(spark):
    """A country of 25 surveys is no group of its own; where no survey is outside, or no group is large enough, the mean of all stands in."""
    rows = [(i, "big", 0.2) for i in range(40)] + [(100 + i, "small", 0.8) for i in range(25)]
    each = spark.createDataFrame(rows, "survey long, country string, f1 double")
    pooled = (40 * 0.2 + 25 * 0.8) / 65
    got = Y.checkpoint_score(each, "country", ~F.col("country").isin("big", "small")).first()
    assert got.pooled == pytest.approx(pooled) and got.outside == pytest.approx(pooled) and got.macro == pytest.approx(0.2)
    assert got.score == pytest.approx(0.75 * pooled + 0.25 * 0.2)
    few = Y.checkpoint_score(each.where("country = 'small'"), "country", F.lit(True)).first()
    assert few.macro == few.pooled == few.outside == pytest.approx(0.8)
