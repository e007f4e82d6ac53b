"""Prefix sums, quantiles, weighted draws and digests over ranges, against plain Python at several range sizes."""

import hashlib
import random
from collections import defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.operators import stats as Z
from quadrat.operators.digests import ordered_digests

SIZES = [1, 7, 10**6]


def table(spark, n=300):
    r = random.Random(n)
    rows = [(r.choice("aaaab"), k, r.choice([r.gauss(0, 1e-3), r.gauss(0, 1e9), float(r.randint(-3, 3)), None]), r.randint(0, 5)) for k in r.sample(range(10 * n), n)]
    return rows, spark.createDataFrame([*rows, ("empty", -1, None, 0)], "g string, k long, v double, w int")


@pytest.mark.parametrize("size", SIZES)
def test_running_sums(spark, size):
    rows, df = table(spark)
    got = {r.k: (r.upto, r.total) for r in Z.running_sums(df.where("g <> 'empty'"), ["g"], ["k"], "w", size).collect()}
    sums = defaultdict(int)
    for g, k, _, w in sorted(rows):
        sums[g] += w
        assert got[k][0] == sums[g]
    assert {got[k][1] for g, k, _, _ in rows if g == "a"} == {sums["a"]}
    places = {r.k: (r.place, r.total) for r in Z.numbered(df.select("g", "k"), [], ["k"], size).collect()}
    assert [places[k] for k in sorted(places)] == [(i, len(rows) + 1) for i in range(len(rows) + 1)]


@pytest.mark.parametrize("size", SIZES)
def test_previous(spark, size):
    rows, df = table(spark)
    got = {r.k: r.previous for r in Z.with_previous(df.where("g <> 'empty'").select("g", "k"), ["g"], "k", size).collect()}
    last = {}
    for g, k, _, _ in sorted(rows):
        assert got[k] == last.get(g)
        last[g] = k


@pytest.mark.parametrize("size", SIZES)
def test_quantiles(spark, size):
    rows, df = table(spark)
    ps = [0.0, 0.02, 0.5, 0.77, 1.0]
    got = {r.g: r.q for r in Z.quantiles(df, ["g"], "v", ps, size).collect()}
    assert sorted(got) == ["a", "b"]
    for g in got:
        assert np.allclose(got[g], np.quantile([v for h, _, v, _ in rows if h == g and v is not None], ps), rtol=1e-12, atol=1e-15)
    (all_rows,) = Z.quantiles(df, [], "v", ps, size).collect()
    assert np.allclose(all_rows.q, np.quantile([v for _, _, v, _ in rows if v is not None], ps), rtol=1e-12, atol=1e-15)
    assert Z.quantiles(df.where("g = 'empty'"), ["g"], "v", ps).count() == 0


def test_weighted_draw_is_the_inverse_of_the_running_share(spark):
    rows = [(k, float(w)) for k, w in enumerate([1, 5, 0.5, 20, 3, 0.01] * 30)]
    df = spark.createDataFrame(rows, "k long, w double")
    few, many = ({r.draw: r.k for r in Z.draw_weighted(df, "k", "w", 3000, 4, size).collect()} for size in (11, 10**6))
    assert few == many and sorted(few) == list(range(3000))
    heavy = sum(k % 6 == 3 for k in few.values()) / 3000
    assert abs(heavy - 20 / 29.51) < 0.04


@pytest.mark.parametrize("block, n", [(4, 1), (4, 4), (4, 5), (4, 70), (1024, 70)])
def test_ordered_digests(spark, block, n):
    ids = list(range(100, 100 + n))
    df = spark.createDataFrame([(g, i) for i in reversed(ids) for g in "xy"] + [("z", 1)], "g string, i long")
    sha = lambda part: hashlib.sha256(",".join(part).encode()).hexdigest()
    texts = [sha(list(map(str, ids[a : a + block]))) for a in range(0, n, block)]
    while len(texts) > 1:
        parts = [texts[a : a + block] for a in range(0, len(texts), block)]
        texts = [p[0] if len(p) == 1 else sha(p) for p in parts]
    got = {r.g: (r.digest, r.n) for r in ordered_digests(df, ["g"], ["i"], F.col("i").cast("string"), block, 3).collect()}
    assert got["x"] == got["y"] == (texts[0], n)
    assert got["z"] == (sha(["1"]), 1)  # whatever the other keys


def test_digests_of_more_than_two_levels(spark):
    from compare import DATA, duck

    from quadrat.plans.evaluation import _digest_sql
    from quadrat.sources import tables as T

    o = T.table(spark, DATA, "orders").select(F.lit(1).alias("k"), F.col("o_orderkey").alias("survey"))
    got = ordered_digests(o, ["k"], ["survey"], F.col("survey").cast("string"), block=8).select("digest", "n").collect()
    _, want = duck(f"WITH {_digest_sql('o_orderkey::VARCHAR', 'NULL', 'orders', 'o_orderkey', 8)} SELECT digest, n FROM c")
    assert [tuple(r) for r in got] == want and want[0][1] > 8**3
