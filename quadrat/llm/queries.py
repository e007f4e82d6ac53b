"""Queries of this subpackage: thin forms of its operators over the whole given tables, with production parameters."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.llm import conversation, frames, licenses, linededup, media, merkle, minhash, mixing, packing, quality, repeats, shared, toxicity, vptree


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_quality_resampling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return quality.scores(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.score(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"))


def op3_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.decompose(_table(spark, sf_dir, "documents"), tokenizer_path(), 2048, with_ids=False).drop("ids")


def op4_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return linededup.report(_table(spark, sf_dir, "documents"))


def op5_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.rates(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "labels"), weights=mixing.WEIGHTS)


def op6_repeats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeats.remove_repeats(_table(spark, sf_dir, "documents"))


def op7_nearest(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = _table(spark, sf_dir, "embeddings")
    return vptree.search(vptree.build_index(vectors), vectors.where(F.col("vec_id") % 20 == 0), 20)


def op8_media(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "media")
    media.store_media(_table(spark, sf_dir, "documents"), path)
    return media.media_features(media.read_media(spark, path))


def op9_licenses(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = licenses.scan(_table(spark, sf_dir, "documents"))
    return found.select("doc_id", "n_sentences", "n_known", F.array_join("licences", ",").alias("licences"))


def op10_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return minhash.classes(_table(spark, sf_dir, "documents"))


def op11_merkle_manifest(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    hit = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 7 == 0
    return merkle.verify(merkle.manifest(docs, now={"n_chars": F.when(hit, F.col("n_chars") + 1).otherwise(F.col("n_chars"))}))


def op12_conversation_repair(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = _table(spark, sf_dir, "conversations")
    return conversation.repair(conversation.damaged(rows), rows)


def op13_token_frames(spark: SparkSession, sf_dir: str) -> DataFrame:
    path = shared.new_path(spark, "ids")
    frames.write(_table(spark, sf_dir, "documents"), path, tokenizer_path())
    return frames.read(spark, path, with_ids=False)


QUERIES = {
    "op1_quality_resampling": op1_quality_resampling,
    "op2_toxicity": op2_toxicity,
    "op3_packing": op3_packing,
    "op4_line_dedup": op4_line_dedup,
    "op5_mixing": op5_mixing,
    "op6_repeats": op6_repeats,
    "op7_nearest": op7_nearest,
    "op8_media": op8_media,
    "op9_licenses": op9_licenses,
    "op10_near_duplicates": op10_near_duplicates,
    "op11_merkle_manifest": op11_merkle_manifest,
    "op12_conversation_repair": op12_conversation_repair,
    "op13_token_frames": op13_token_frames,
}

ORACLES = {
    "op4_line_dedup": linededup.oracle(),
    "op9_licenses": licenses.oracle(),
    "op11_merkle_manifest": merkle.oracle(),
    "op12_conversation_repair": conversation.oracle(),
    "op7_nearest": """
        WITH v AS (SELECT vec_id, embedding::DOUBLE[] AS e FROM embeddings
                   WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
                     AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
                     AND len(list_filter(embedding, lambda x: x <> 0)) > 0),
        q AS (SELECT vec_id, min(e) AS e FROM v WHERE vec_id % 20 = 0 GROUP BY vec_id),
        s AS (SELECT q.vec_id AS query_id, v.vec_id, list_inner_product(q.e, v.e) AS score
              FROM q JOIN v ON v.vec_id <> q.vec_id AND len(v.e) = len(q.e)),
        r AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS rank FROM s)
        SELECT query_id, rank::INT AS rank, vec_id, score FROM r WHERE rank <= 20
    """,
}
