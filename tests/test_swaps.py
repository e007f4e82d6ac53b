"""Swaps and lengths that tasks work out over batches of surveys, and lists that a key asks for."""

import math

import pytest
from compare import DATA
from pyspark.sql import functions as F

from quadrat.operators import search as S
from quadrat.sources import tables as T


def _rows(spark):
    rows = [(s, x, (s * 7 + x * 5) % 4 / 4, (s + x * 3) % 7 / 7, int((s + x) % 3 == 0), r if r <= 6 else None) for s in range(1, 14) for r, x in enumerate(range(100, 100 + s * 2), 1)]
    df = spark.createDataFrame(rows, "survey long, species long, p double, q double, hit int, base int").coalesce(1)
    return rows, df


@pytest.mark.parametrize("most", [2, 1000])
def test_swaps_against_sorted_lists(spark, most):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows, df = _rows(spark)
    long = df.select("survey", F.lit(1).alias("truth"), F.struct("species", "hit", "p", "q", "base").alias("_x"))
    policies = spark.createDataFrame([(0, 0.0, 0), (1, 0.5, 2), (2, 0.5, 4), (3, 1.0, 8)], "place int, a double, swaps int")
    try:
        spark.conf.set(key, most)
        each = S.swapped(long, policies, "base", ["p", "q"], lambda x, k: x["p"] + k["a"] * x["q"], lambda x, k: x["q"] >= 0.2, lambda low, high: high > low, 0.5, 3, ["a"])
        assert "NestedLoopJoin" not in each._jdf.queryExecution().executedPlan().toString()
        got = {(r.survey, r.place): (r.n, r.hits) for r in each.collect()}
    finally:
        spark.conf.set(key, before)
    for s in range(1, 14):
        own = [r for r in rows if r[0] == s]
        n = sum(r[5] is not None for r in own)
        for place, w, swaps in ((0, 0.0, 0), (1, 0.5, 2), (2, 0.5, 4), (3, 1.0, 8)):
            value = lambda r: round(r[2] + w * r[3], 9)
            low = sorted((value(r), -r[5], r[4]) for r in own if r[5] is not None and r[5] > math.ceil(n * 0.5))[:3]
            high = sorted((-value(r), r[1], r[4]) for r in own if r[5] is None and r[3] >= 0.2)[:3]
            gains = [h[2] - v[2] for v, h in zip(low, high) if -h[0] > v[0]][:swaps]
            assert got[s, place] == (n, sum(r[4] for r in own if r[5] is not None) + sum(gains))


def test_places_and_lengths(spark):
    rows, df = _rows(spark)
    got = S.placed(df.drop("base"), ["p", "q"], ("q", [0.8, 1.2], 3, 9), ("q", [0.5])).collect()
    lists = {r.survey: r for r in S.gathered(df.drop("base"), ["species", "hit", "p", "q"], ["p", "q"]).withColumn("best", F.array(*[S.best_length(F.col("s_q"), F.lit(c), 3, 9) for c in (0.8, 1.2)])).collect()}
    assert len(got) == len(rows)
    for r in got:
        own = lists[r.survey]
        mine = next(m for m in own.c if m.species == r.species)
        assert (r.size, r.rank_p, r.rank_q, r.best) == (len(own.c), mine.rank_p, mine.rank_q, own.best)
        assert r.reach == [sum(m.q >= 0.5 for m in own.c)]


@pytest.mark.parametrize("size", [1, 5, 200, 20000])
def test_a_key_asks_for_its_places(spark, tmp_path, size):
    """Vocabularies shorter than a walk, of some rows and of many; keys below zero."""
    surveys = [*range(-70, 40), 12345, 999_999_937]
    spark.range(size).select((F.col("id") * 3 + 1).alias("p_partkey")).write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame([(s,) for s in [*surveys, 7, None]], "o_orderkey long").write.parquet(f"{tmp_path}/orders.parquet")
    spark.createDataFrame([(7, 4), (7, 4), (7, None), (None, 4), (5, 10**6)], "l_orderkey long, l_partkey long").write.parquet(f"{tmp_path}/lineitem.parquet")
    counts = spark.createDataFrame([(1, 9)], "species long, n long")
    plain = {r.survey: r for r in T.candidate_lists(spark, str(tmp_path)).collect()}
    counted = {r.survey: r for r in T.candidate_lists(spark, str(tmp_path), counts).collect()}
    assert set(plain) == set(counted) == set(surveys)
    for s in surveys:
        asked = [s * 31 + j * 97 for j in range(24)]
        want = {c % size * 3 + 1 for c in asked if c >= 0 or c % size == 0}
        assert sorted(plain[s].more) == sorted(want)
        assert sorted(tuple(x) for x in counted[s].more) == sorted((x, 9 if x == 1 else 0) for x in want)
    assert plain[7].own == [4] and plain[5].own == [10**6]


def test_a_survey_asks_for_one_row_of_the_vocabulary(spark):
    """What is shuffled of a survey before its lists meet is its key and where it looks, not its places."""
    plan = T.candidate_lists(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    joined = plan.partition("Join Inner, (cell")[2] or plan.partition("Join Inner")[2]
    assert "Generate explode(array_distinct" not in plan and joined
