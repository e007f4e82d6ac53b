"""A corpus pipeline of five stages; each works on all that its predecessor kept.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame, which ``run`` writes to the shared folder and reads again
as the next one's ``docs``.  Labels come from the ``labels`` table of ``sf_dir``; labelled documents that an earlier stage
took out no longer teach a later one.

Cases, for all stages but the last: the columns of ``docs`` come back as they are, whatever their names; an empty table
gives no rows; null ids and repeated rows are rows like others, and null texts are empty texts.  What a stage does with
them is in its own text.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from quadrat.llm import linededup, minhash, mixing, packing, quality
from quadrat.llm.queries import tokenizer_path
from quadrat.llm.shared import written


def _labels(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/labels.parquet")


def quality_classifier(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that importance resampling draws; the others go.

    Empty texts weigh 0; equal rows stand or fall together, and ties with the last place stay; without usable labels
    every row stays.
    """
    return quality.resample(docs, _labels(spark, sf_dir))


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Later copies of repeated runs of lines are deleted, and documents that lose every word with them.

    The first copy is that of the least doc_id (null first), then of the first row; empty texts lose nothing and stay.
    """
    return linededup.dedup(docs)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near-duplicates stays: that of the least doc_id, null last; one row of repeated ones.

    Texts without a word are copies of equal texts only.
    """
    return minhash.dedup(docs)


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents as often as the rates say that fit the domains' expected tokens to the targets.

    Empty texts have rate by their posterior and no tokens; equal rows get equal rates; without labels of two domains all
    posteriors are equal.
    """
    return mixing.mix(docs, _labels(spark, sf_dir), weights=mixing.WEIGHTS)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sequences of power-of-two lengths with their token ids; an empty text is the closing id alone."""
    return packing.decompose(docs, tokenizer_path(), 2048)


STAGES = [
    ("quality classifier", quality_classifier),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("mixing sources to target weights", mix_sources),
    ("packing", pack),
]

#: The models and the tokenizer have no SQL form.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents of ``sf_dir``."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = written(stage(spark, docs, sf_dir), name.split()[0].lower())
    return STAGES[-1][1](spark, docs, sf_dir)
