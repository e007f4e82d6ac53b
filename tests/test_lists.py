"""Candidates as lists by survey, and rankings that tasks sort."""

import numpy as np
import pytest
from compare import DATA
from pyspark.sql import functions as F

from quadrat.operators import ranking as R
from quadrat.operators import search as S
from quadrat.queries import QUERIES
from quadrat.sources import tables as T


def test_no_row_a_candidate_is_shuffled(spark):
    plan = R.ranked_by(T.scores(spark, DATA), "p", "q")._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Generate posexplode")
    assert below and "Exchange" not in above


@pytest.mark.parametrize("name", ["protected_composer", "set_editor"])
def test_composers_meet_by_survey_alone(spark, name):
    plan = QUERIES[name](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("Generate posexplode(concat(own")
    assert below and "Exchange" not in above


def test_gains_are_summed_where_they_arise(spark):
    from quadrat.plans.policies import _each

    plan = _each(spark, DATA)._jdf.queryExecution().executedPlan().toString()
    above = plan.partition("Generate posexplode(concat(own")[0]
    assert "own" in _each(spark, DATA).columns and "hashpartitioning(survey" not in above and "species" not in "".join(x for x in above.splitlines() if "Exchange" in x)


def test_marked_candidates(spark):
    own = T.surveys(spark, DATA).where("survey % 3 = 0").select("survey", "lat")
    got = T.marked(spark, DATA, T.prevalence(spark, DATA), own).select("survey", "species", "n", "hit", "truth").toPandas()
    truth = {(r.survey, r.species) for r in T.pairs(spark, DATA).collect()}
    n, sizes = {}, {}
    for s, x in truth:
        n[x], sizes[s] = n.get(x, 0) + 1, sizes.get(s, 0) + 1
    vocab = {r.col: r.species for r in T.vocabulary(spark, DATA).collect()}
    want = {(s, x) for s, x in truth}
    surveys = [r.survey for r in T.surveys(spark, DATA).collect()]
    want |= {(s, vocab[(s * 31 + j * 97) % len(vocab)]) for s in surveys for j in range(24)}
    want = {(s, x, n.get(x, 0), int((s, x) in truth), sizes.get(s, 0)) for s, x in want if s % 3 == 0 and s in set(surveys)}
    rows = [tuple(map(int, r)) for r in got.itertuples(index=False)]
    assert len(rows) == len(set(rows)) and set(rows) == want


@pytest.mark.parametrize("most", [1, 3, 1000])
def test_surveys_over_several_batches(spark, most):
    key = "spark.sql.execution.arrow.maxRecordsPerBatch"
    before = spark.conf.get(key)
    rows = [(s, x, (s * 7 + x * 5) % 4 / 4, (s + x) % 3 / 3, int((s + x) % 5 == 0)) for s in range(1, 12) for x in range(100, 100 + s * 2)]
    try:
        spark.conf.set(key, most)
        cands = spark.createDataFrame(rows, "survey long, species long, p double, q double, hit int").coalesce(1)
        long = cands.select("survey", F.lit(1).alias("truth"), F.struct("species", "hit", "p", "q").alias("_x"))
        policies = spark.createDataFrame([(0, 0.0, 3), (1, 0.5, 5), (2, 0.5, 40)], "place int, alpha double, k int")
        a = F.col("alpha")
        each = S.ranked(long, policies, ["alpha"], lambda x: (1 - a) * x["p"] + a * x["q"], lambda p, s: p["k"])
        got = {(r.survey, r.place): (r.n, r.hits) for r in each.collect()}
        lists = S.gathered(cands, ["species", "p", "q", "hit"], ["p", "q"]).collect()
    finally:
        spark.conf.set(key, before)
    for s in range(1, 12):
        for place, w, k in ((0, 0.0, 3), (1, 0.5, 5), (2, 0.5, 40)):
            order = sorted((-round((1 - w) * r[2] + w * r[3], 9), r[1], r[4]) for r in rows if r[0] == s)[:k]
            assert got[s, place] == (len(order), sum(h for *_, h in order))
    assert sorted(r.survey for r in lists) == list(range(1, 12))
    for r in lists:
        own = [x for x in rows if x[0] == r.survey]
        order = sorted(own, key=lambda x: (-x[3], x[1]))
        assert [m.species for m in sorted(r.c, key=lambda m: m.rank_q)] == [x[1] for x in order]
        assert [-m.v for m in r.s_q] == [x[3] for x in order] and r.s_q[-1].u == pytest.approx(sum(x[3] for x in own))


def test_rounding_is_that_of_spark(spark):
    rng = np.random.default_rng(1)
    v = np.concatenate([rng.normal(size=2000), rng.integers(-4000, 4000, 500) / 2**10, (rng.integers(-4000, 4000, 500) + 0.5) * 1e-9, [0.0, -1.25, 1e-12]])
    got = spark.createDataFrame([(i, float(x)) for i, x in enumerate(v)], "i long, v double").select("i", F.round("v", 9).alias("v")).orderBy("i").collect()
    assert [r.v for r in got] == S.rounded(v).tolist()
