"""Several writes to one media archive: appends add up, an overwrite replaces, a failed job leaves nothing."""

import os

import pytest
from pyspark.sql import functions as F

from quadrat.llm import media, shared


def stored(spark, path):
    return sorted((r.doc_id, bytes(r.payload)[: r.n_bytes].decode()) for r in media.read_media(spark, path).collect())


def docs(spark, *ids):
    return spark.createDataFrame([(i, f"text {i}") for i in ids], "doc_id long, text string").repartition(3)


def archives(path):
    return {f for f in os.listdir(path.removeprefix("file:")) if f.endswith(".arc")}


def test_appends_overwrite_and_failure(spark):
    path = shared.new_path(spark, "media")
    media.store_media(docs(spark, 1, 2), path)
    media.store_media(docs(spark, 3), path)
    media.store_media(docs(spark, 1), path)
    assert stored(spark, path) == [(1, "text 1"), (1, "text 1"), (2, "text 2"), (3, "text 3")]
    before = archives(path)
    bad = docs(spark, 8, 9).withColumn("text", F.when(F.col("doc_id") == 9, F.raise_error(F.lit("lost"))).otherwise(F.col("text")))
    with pytest.raises(Exception, match="lost"):
        media.store_media(bad, path)
    assert archives(path) == before and len(stored(spark, path)) == 4
    media.store_media(docs(spark, 5), path, "overwrite")
    assert stored(spark, path) == [(5, "text 5")] and not archives(path) & before
    media.store_media(docs(spark, 6), path)
    assert stored(spark, path) == [(5, "text 5"), (6, "text 6")]


def test_a_manifest_that_was_not_finished_does_not_count(spark):
    path = shared.new_path(spark, "media")
    media.store_media(docs(spark, 1), path)
    open(f"{path.removeprefix('file:')}/{media.MANIFESTS}/000000000002-x.part", "w").write('{"overwr')
    assert stored(spark, path) == [(1, "text 1")]
    media.store_media(docs(spark, 2).limit(0), path)
    assert stored(spark, path) == [(1, "text 1")]
