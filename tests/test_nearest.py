"""Nearest neighbours by the pyramid of counts against all distances."""

import math
import random
from collections import defaultdict

import pytest

from quadrat.functions.geo import EARTH_KM
from quadrat.operators import spatial as P


def km(a, b, c, d):
    x = math.sin(math.radians(c - a) / 2) ** 2 + math.cos(math.radians(a)) * math.cos(math.radians(c)) * math.sin(math.radians(d - b) / 2) ** 2
    return round(2 * EARTH_KM * math.asin(math.sqrt(min(x, 1))), 6)


def points(r, n):
    """Clusters, exact copies of a place, poles, both sides of the antimeridian, and the whole globe."""
    out = []
    for _ in range(n):
        kind = r.random()
        if kind < 0.3:
            out.append((round(45 + r.gauss(0, 0.01), 4), round(5 + r.gauss(0, 0.01), 4)))
        elif kind < 0.5:
            out.append((10.0, 20.0))
        elif kind < 0.6:
            out.append((r.choice([90.0, -90.0, 89.99, -89.9]), r.uniform(-180, 180)))
        elif kind < 0.75:
            out.append((r.uniform(-1, 1), r.choice([179.99, -179.99, 180.0, -180.0, 181.0])))
        else:
            out.append((math.degrees(math.asin(r.uniform(-1, 1))), r.uniform(-180, 180)))
    return out


@pytest.mark.parametrize("k, n, m, most", [(1, 80, 60, None), (5, 60, 200, None), (7, 40, 5, None), (4, 60, 150, 35.0), (3, 30, 0, None)])
def test_against_all_distances(spark, k, n, m, most):
    r = random.Random(k)
    left = [(i, *p, r.choice("ab")) for i, p in enumerate(points(r, n))] + [(n, None, 1.0, "a"), (n + 1, 95.0, 1.0, "a"), (n + 2, 1.0, float("nan"), "a")]
    right = [(i, *p, r.choice("aab")) for i, p in enumerate(points(r, m))] + [(m, float("nan"), 1.0, "a"), (m + 1, 1.0, None, "b")]
    a = spark.createDataFrame(left, "l long, lat double, lon double, side string")
    b = spark.createDataFrame(right, "r long, rlat double, rlon double, side string")
    for by in ((), ("side",)):
        got = defaultdict(list)
        for x in P.nearest(a, b if by else b.drop("side"), k, "r", by, most).collect():
            got[x.l].append((x.rank, x.km, x.r))
        for i, lat, lon, side in left[:n]:
            all_km = sorted((km(lat, lon, c, d), j) for j, c, d, s in right[:m] if not by or s == side)
            want = [(rank + 1, *x) for rank, x in enumerate(all_km[:k]) if most is None or x[0] <= most]
            have = sorted(got.pop(i, []))
            assert [(x[0], x[2]) for x in have] == [(x[0], x[2]) for x in want] or [round(x[1], 5) for x in have] == [round(x[1], 5) for x in want]
        assert not got


def test_plan_has_no_loop(spark):
    """Two joins with references, whatever the radii: the counts' and the search's."""
    r = random.Random(1)
    a = spark.createDataFrame([(i, *p) for i, p in enumerate(points(r, 50))], "l long, lat double, lon double")
    b = spark.createDataFrame([(i, *p) for i, p in enumerate(points(r, 50))], "r long, rlat double, rlon double")
    plan = P.nearest(a, b, 3, "r")._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("LogicalRDD") <= 3 and "Union" not in plan


def test_a_crowded_place_keeps_k_references(spark):
    """Thousands of references at one place cost k rows of the join."""
    b = spark.createDataFrame([(i, 10.0, 20.0) for i in range(5000)], "r long, rlat double, rlon double")
    a = spark.createDataFrame([(i, 10.0, 20.0) for i in range(300)], "l long, lat double, lon double")
    rows = P.nearest(a, b, 4, ["r"]).collect()
    assert len(rows) == 1200 and {(x.rank, x.r) for x in rows} == {(1, 0), (2, 1), (3, 2), (4, 3)}
