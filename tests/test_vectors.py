"""Nearest vectors by ranges around pivots: the same as all distances, with most pairs never looked at where vectors cluster."""

import numpy as np
import pytest

from quadrat.operators import vectors as V

KIND = "{} long, v array<double>"


def sides(spark, x, n):
    q = spark.createDataFrame([(i, x[i].tolist()) for i in range(0, len(x), n)], KIND.format("query"))
    r = spark.createDataFrame([(i, x[i].tolist()) for i in range(len(x)) if i % n], KIND.format("ref"))
    return q, r


def brute(x, n, k):
    refs = [j for j in range(len(x)) if j % n]
    out = []
    for i in range(0, len(x), n):
        near = sorted((round(float(np.linalg.norm(x[i] - x[j])), 6), j) for j in refs)[:k]
        out += [(i, rank + 1, j) for rank, (_, j) in enumerate(near)]
    return sorted(out)


@pytest.mark.parametrize("k, block, pivots, rings", [(1, 5, 3, 4), (9, 20, 16, 16), (500, 4096, 4, 2)])
def test_same_as_all_distances(spark, k, block, pivots, rings):
    r = np.random.default_rng(k)
    centres = r.normal(0, 30, (6, 5))
    x = np.vstack([centres[i % 6] + r.normal(0, 0.5, 5) for i in range(240)] + [np.zeros(5)] * 20)
    q, refs = sides(spark, x, 7)
    got = sorted((a.query, a.rank, a.ref) for a in V.nearest(q, refs, k, block, pivots, rings).collect())
    assert got == brute(x, 7, k)


def test_far_ranges_are_not_met(spark):
    r = np.random.default_rng(2)
    centres = r.normal(0, 100, (12, 8))
    x = np.vstack([centres[i % 12] + r.normal(0, 1, 8) for i in range(1200)])
    q, refs = sides(spark, x, 10)
    there, asked = V.ranges_met(q, refs, 5)
    size = {a.range: a["count"] for a in there.groupBy("range").count().collect()}
    looked = sum(size[a.range] for a in asked.select("range").collect())
    assert looked < 0.2 * q.count() * refs.count()
    got = sorted((a.query, a.rank, a.ref) for a in V.nearest(q, refs, 5).collect())
    assert got == brute(x, 10, 5)


def test_odd_vectors_take_no_part(spark):
    rows = [(1, [0.0, 1.0]), (2, [5.0, 5.0]), (3, None), (4, [1.0]), (5, [1.0, None]), (6, [float("nan"), 1.0]), (7, [float("inf"), 0.0])]
    refs = spark.createDataFrame(rows, KIND.format("ref"))
    queries = spark.createDataFrame(rows, KIND.format("query"))
    got = sorted((a.query, a.rank, a.ref) for a in V.nearest(queries, refs, 3).collect())
    assert got == [(1, 1, 1), (1, 2, 2), (2, 1, 2), (2, 2, 1)]
    assert V.nearest(queries, refs.limit(0), 3).count() == 0 and V.nearest(queries.limit(0), refs, 3).count() == 0


def test_a_query_is_sent_once_whatever_it_meets(spark, monkeypatch):
    x = np.random.default_rng(3).normal(0, 1, (600, 16))  # without structure: every range is met
    q, refs = sides(spark, x, 5)
    sizes, write = {}, V.written

    def counted(df, kind):
        out = write(df, kind)
        sizes[kind] = out.count()
        return out

    monkeypatch.setattr(V, "written", counted)
    got = sorted((a.query, a.rank, a.ref) for a in V.nearest(q, refs, 9).collect())
    assert got == brute(x, 5, 9)
    assert sizes["asked"] == q.count()


def test_vectors_far_from_the_origin(spark):
    x = 1e7 + np.random.default_rng(4).normal(0, 1, (200, 6))
    q, refs = sides(spark, x, 4)
    got = sorted((a.query, a.rank, a.ref) for a in V.nearest(q, refs, 5).collect())
    assert got == brute(x, 4, 5)
