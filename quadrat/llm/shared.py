"""Where operators cut lineage: the folder that the cluster shares."""

from __future__ import annotations

import tempfile
import uuid

import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def shared_folder(spark: SparkSession) -> str:
    """The folder of spark.checkpoint.dir; where that is unset, a new one, on a local master only."""
    folder = spark.conf.get("spark.checkpoint.dir", None)
    context = spark.sparkContext
    if not folder:
        folder = context.getCheckpointDir()
    if not folder:
        if not context.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        folder = tempfile.mkdtemp(prefix="spark-")
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(folder)
    return folder


def new_path(spark: SparkSession, kind: str) -> str:
    """A folder of its own under the shared one."""
    return f"{shared_folder(spark).rstrip('/')}/{kind}-{uuid.uuid4().hex}"


def opened(path: str) -> tuple[pafs.FileSystem, str]:
    """The store of a path and the path within it."""
    return pafs.FileSystem.from_uri(path if "://" in path else f"file://{path}" if path.startswith("/") else path.replace(":/", ":///", 1))


def written(df: DataFrame, kind: str) -> DataFrame:
    """``df`` as a written table in the shared folder: computed once, safe against lost executors."""
    spark = df.sparkSession
    path = new_path(spark, kind)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def dropped(*tables: DataFrame) -> None:
    """Remove written tables that only fed tables which are written themselves by now."""
    for table in tables:
        for folder in {f.rsplit("/", 1)[0] for f in table.inputFiles()}:
            path = table.sparkSession._jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(table.sparkSession._jsc.hadoopConfiguration()).delete(path, True)


def ranks(places: DataFrame, name: list[str], rank: str = "rank") -> DataFrame:
    """``name`` and ``rank`` of the names that stand at two places or more, written; ranks rise with the name.

    Names are counted before the shuffle and sorted by ranges; a join with the written table can be split where one name
    is very common.
    """
    groups = places.groupBy(*name).agg(F.count("*").alias("n")).where("n > 1").drop("n")
    return written(groups.orderBy(*name).withColumn(rank, F.monotonically_increasing_id()), "ranks")


def doubled(live: DataFrame, row: str, at: str, levels: int) -> DataFrame:
    """Prefix doubling: ``live`` (``row``, ``at``, rank0, ...) with rank1, rank2, ... of 2, 4, ... places from there.

    rank0 names what stands at a place more than once.  A rank is null where its places stand nowhere else, or where one
    of them has no rank0.  Needs a column ``run`` that numbers the stretches of places next to each other in a row.
    """
    run = Window.partitionBy(row, "run").orderBy(at)
    for j in range(1, levels):
        old, new = f"rank{j - 1}", f"rank{j}"
        live = written(live.withColumn("next", F.lead(old, 1 << (j - 1)).over(run)), "suffixes")
        both = live.where(F.col(old).isNotNull() & F.col("next").isNotNull())
        rest = live.where(F.col(old).isNull() | F.col("next").isNull()).withColumn(new, F.lit(None).cast("long"))
        live = both.join(ranks(both, [old, "next"], new), [old, "next"], "left").select(*rest.columns).unionByName(rest).drop("next")
    return live


def numbered(df: DataFrame, tree: str, order: list[str]) -> DataFrame:
    """``df`` with ``place`` (from 0 in its tree, in the given order, nulls first) and ``n``, the rows of the tree.

    Rows are sorted by ranges and written; a window sees one row a range and tree, so no tree needs to fit a task.
    """
    table = written(df.orderBy(tree, *order).withColumn("at", F.monotonically_increasing_id()).withColumn("part", F.shiftright("at", 33)), "ordered")
    parts = table.groupBy(tree, "part").agg(F.min("at").alias("first"), F.count("*").alias("here"))
    all_parts = Window.partitionBy(tree)
    before = F.sum("here").over(all_parts.orderBy("part")) - F.col("here")
    parts = parts.select(tree, "part", "first", before.alias("before"), F.sum("here").over(all_parts).alias("n"))
    return table.join(parts, [tree, "part"]).withColumn("place", F.col("at") - F.col("first") + F.col("before")).drop("at", "part", "first", "before")


def keyed(docs: DataFrame, key: str) -> DataFrame:
    """``docs`` with a long column ``key`` that names each row: doc_id where that is one, else a number.

    Numbers are written down with the rows, so that a task that runs again sees the same ones.
    """
    ids = docs.select(F.col("doc_id").cast("long").alias("id"))
    rows, there, most = ids.groupBy("id").count().agg(F.sum("count"), F.sum(F.when(F.col("id").isNotNull(), 1)), F.max("count")).first()
    if not rows or (most == 1 and there == rows):
        return docs.withColumn(key, F.col("doc_id").cast("long"))
    return written(docs.withColumn(key, F.monotonically_increasing_id()), "keyed")
