"""Digests of long ordered tables: of blocks, then of the blocks' digests."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.operators.stats import numbered
from quadrat.sources.shared import written

#: Rows of a block.
BLOCK = 1024


def ordered_digests(rows: DataFrame, by: list[str], order: list[str], text: Column, block: int = BLOCK, size: int | None = None) -> DataFrame:
    """by, digest, n: a SHA-256 of each key's rows in order, and how many they are.

    Every ``block`` rows in order give the digest of their texts, joined by commas; the digests of ``block`` blocks in order
    give theirs, until one is left; a block that is alone there stands for itself.  No row holds more than ``block`` texts, and any change of a row, of the order or of the
    number of rows gives another digest.  ``order`` has to tell the rows of a key apart.
    """
    placed = numbered(rows.select(*by, *order, text.alias("_text")), by, order, size)
    most = None
    while True:
        member = F.array_sort(F.collect_list(F.struct("place", "_text")))
        joined = F.array_join(F.transform(member, lambda m: m["_text"]), ",")
        text = F.sha2(joined, 256) if most is None else F.when(F.count("*") == 1, F.any_value("_text")).otherwise(F.sha2(joined, 256))
        blocks = placed.groupBy(*by, F.floor(F.col("place") / block).alias("place")).agg(text.alias("_text"), F.any_value("total").alias("total"))
        placed = written(blocks, "digests")
        most = placed.agg(F.max("place")).first()[0] if most is None else most // block
        if not most:
            return placed.select(*by, F.col("_text").alias("digest"), F.col("total").alias("n"))
