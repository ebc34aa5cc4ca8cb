"""Driver queries of the training-data operators, over whole tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from siltstone.llm import fingerprints, langid, license_scan, mixing, oracles, packing, quality, simhash, toxicity, voronoi_knn, warc_zip

from siltstone.llm.common import held_out


def read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_warc_zip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return warc_zip.round_trip(read(spark, sf_dir, "pages")).select("page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")


def op2_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = held_out(F.col("doc_id"), 5, 0)
    scored = toxicity.score_toxicity(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~apart)
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))


def op3_voronoi_knn(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = voronoi_knn.integer_vectors(read(spark, sf_dir, "embeddings"), "vec_id", "embedding")
    return voronoi_knn.top_k(vectors, F.col("id") % 20 == 0, 20)


def op4_document_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.fingerprint_documents(read(spark, sf_dir, "documents"))


def tokenizer_paths() -> tuple[str, str]:
    """The vocabulary that the contract names, as both libraries read it."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json"), public_tokenizers.path("byte_bpe_50k.tiktoken")


def op5_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    packed = packing.pack_documents(read(spark, sf_dir, "documents"), *tokenizer_paths())
    return packed.select("doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset")


def op6_license_scans(spark: SparkSession, sf_dir: str) -> DataFrame:
    return license_scan.scan_licenses(read(spark, sf_dir, "documents"))


def op7_source_mixing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return mixing.mix_documents(read(spark, sf_dir, "documents")).drop("source")


def op8_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    apart = held_out(F.col("doc_id"), 4, 2)
    scored = quality.score_quality(read(spark, sf_dir, "documents"), read(spark, sf_dir, "labels"), ~apart)
    return scored.select("doc_id", apart.alias("held_out"), "score", (F.col("score") >= quality.THRESHOLD).cast("int").alias("predicted"))


def op9_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read(spark, sf_dir, "documents")
    model = langid.train(docs.where(~held_out(F.col("doc_id"), 4, 2)))
    found = langid.score_table(docs, model, ["doc_id"])
    return found.select("doc_id", held_out(F.col("doc_id"), 4, 2).alias("held_out"), "lang_pred", "score", "cross_entropy", "rejected")


def op10_simhash_golay(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = simhash.near_duplicates(read(spark, sf_dir, "documents"))
    return found.select(F.col("id").alias("doc_id"), F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), F.col("component").alias("component_id"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {
        "op1_warc_zip": op1_warc_zip,
        "op2_toxicity": op2_toxicity,
        "op3_voronoi_knn": op3_voronoi_knn,
        "op4_document_fingerprints": op4_document_fingerprints,
        "op5_best_fit_packing": op5_best_fit_packing,
        "op6_license_scans": op6_license_scans,
        "op7_source_mixing": op7_source_mixing,
        "op8_quality_classifier": op8_quality_classifier,
        "op9_language_id": op9_language_id,
        "op10_simhash_golay": op10_simhash_golay,
    }


def oracle_sql() -> dict[str, str]:
    return dict(oracles.ORACLES)
