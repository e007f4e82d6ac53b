"""Rounds of pivots: a bucket's members meet what is known of the bucket once a round."""

import re

from quadrat.llm import minhash


def test_members_meet_their_buckets_once_a_round(spark, monkeypatch):
    rows = [(key, bytes([node]), 9) for key in range(3) for node in range(key, 9)]
    members = minhash.written(spark.createDataFrame(rows, "key long, node binary, n long"), "members")
    none = spark.createDataFrame([], "p binary, q binary, j double")
    joins, write = [], minhash.written

    def seen(df, kind):
        joins.extend(re.findall(r"Join Inner, \(+(?:NOT .*)?key#", df._jdf.queryExecution().optimizedPlan().toString()))
        return write(df, kind)

    monkeypatch.setattr(minhash, "written", seen)
    _, left = minhash._rounds(members, None, 2, lambda pairs: none)
    assert len(left.collect()) == len(rows) - 2 * 3  # two pivots a bucket
    assert len(joins) == 2
