"""A stream of occurrences counted by cell: the streaming form of the distinct (cell, publisher, species) counts.

The result does not depend on how files are cut into batches or on repeated records.  Without an event time in the
source there is no watermark, so the state holds every distinct key that was ever seen.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

CELL = ["row_cell", "col_cell"]


def counts(occurrences: DataFrame) -> DataFrame:
    """Distinct (publisher, species) of each cell; for a stream or a table with row_cell, col_cell, publisher, species."""
    return occurrences.dropDuplicates([*CELL, "publisher", "species"]).groupBy(*CELL).agg(F.count("*").alias("n"))


def run(spark: SparkSession, source: DataFrame, folder: str, files_a_batch: int | None = None) -> DataFrame:
    """Run the stream over all that its source holds now and return the last result, written below ``folder``."""
    place = f"{folder.rstrip('/')}/cells-{uuid.uuid4().hex}"

    def keep(batch: DataFrame, number: int) -> None:
        batch.write.mode("overwrite").parquet(f"{place}/result")

    stream = counts(source).writeStream.outputMode("complete").option("checkpointLocation", f"{place}/state").foreachBatch(keep).trigger(availableNow=True).start()
    stream.awaitTermination()
    return spark.read.parquet(f"{place}/result")
