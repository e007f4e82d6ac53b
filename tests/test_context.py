"""Reranking by context: what is shuffled for it, and its rows over odd tables."""

import duckdb
import pytest
from compare import DATA, rows_of
from pyspark.sql import functions as F

from quadrat.operators import graph as H
from quadrat.queries import ORACLES, QUERIES
from quadrat.sources import tables as T


def test_a_candidate_is_never_shuffled(spark):
    """A survey goes once, with its labels, to its row of the vocabulary; before, its candidates went with each anchor to the partners."""
    plan = QUERIES["context_rerank"](spark, DATA)._jdf.queryExecution().executedPlan().toString()
    above, _, below = plan.partition("MapInArrow")
    assert below and "Exchange" not in above and "Window" not in plan and plan.count("hashpartitioning(key") <= 2
    assert not any(f"hashpartitioning({c}#" in plan for c in ("survey", "species", "part"))


def _tables(spark, folder, lines, orders, parts):
    for name, schema, rows in (
        ("lineitem", "l_orderkey long, l_partkey long", lines), ("orders", "o_orderkey long", [(o,) for o in orders]), ("part", "p_partkey long", [(p,) for p in parts]),
    ):
        spark.createDataFrame(rows, schema).write.parquet(f"{folder}/{name}.parquet")
    return str(folder)


def _labels(surveys, size):
    """Labels with two species that a third and a half of the surveys have, strangers, repeats and nulls."""
    own = [(s, 1 + (s * s * k + 13 * k) % size) for s in surveys for k in range(1, 2 + abs(s) % 4)]
    hot = [(s, 5) for s in surveys if s % 3 == 0] + [(s, 6) for s in surveys if s % 2 == 0]
    strange = [(s, 100_000 + s % 3) for s in surveys if s % 11 == 0]
    return own + hot + strange + own[:50] + [(None, 3), (4, None), (None, None)]


@pytest.mark.parametrize("size", [7, 97, 150, 2500])
def test_odd_tables(spark, tmp_path, size):
    """Walks that go round a small vocabulary, frequent species in parts, surveys that only one table has, keys below 0."""
    surveys = [-4, -2, *range(600)]
    orders = [*(s for s in surveys if s % 7), *range(5000, 5020), 1, 2, None]
    d = _tables(spark, tmp_path, _labels(surveys, max(size, 20)), orders, [*range(1, size + 1), *range(1, min(size, 3) + 1), None])
    got = QUERIES["context_rerank"](spark, d)
    c = duckdb.connect()
    for name in ("lineitem", "orders", "part"):
        c.execute(f"create view {name} as select * from '{d}/{name}.parquet/*.parquet'")
    want = c.execute(ORACLES["context_rerank"])
    names = [x[0] for x in want.description]
    assert sorted(got.columns) == sorted(names) and rows_of(got.columns, got.collect()) == rows_of(names, want.fetchall())


@pytest.mark.parametrize("size", [90, 2600])
def test_known_pairs(spark, tmp_path, size):
    """All pairs of candidates seen together in training, but those of a training survey's own labels that were seen once."""
    surveys = range(400)
    d = _tables(spark, tmp_path, _labels(surveys, size), surveys, range(1, size + 1))
    counts = T.pairs(spark, d).where("survey % 5 <> 0").groupBy("species").agg(F.count("*").alias("n"))
    items = T.numbered(spark, d, counts)
    lists = T.numbered_lists(spark, d, items)
    got = {}
    known = H.known_pairs(lists, items.where("id >= 0"), lambda s: T.places(s, size), lambda i: T.places_around(i, size), T.place_cell, "survey % 5 <> 0", 4)
    for r in known.collect():
        assert got.setdefault(r.survey, {}).setdefault((r.i, r.j), r.n) == r.n
    own = {r.survey: {x.id for x in r.own} for r in lists.collect()}
    seen = {}
    for s, ids in own.items():
        for e in ((i, j) for i in ids for j in ids if i < j and s % 5):
            seen[e] = seen.get(e, 0) + 1
    for s, ids in own.items():
        walk = {(s * 31 + 97 * k) % size for k in range(24)}
        want = {(i, j): n for (i, j), n in seen.items() if i in ids | walk and j in ids | walk and (i in ids or j in ids)}
        assert got.get(s, {}) == {(i, j): n for (i, j), n in want.items() if n > 1 or not s % 5 or not {i, j} <= ids}
        assert all(got[None][e] == n for e, n in seen.items() if set(e) <= walk)
