"""One query per operator over its whole table, and DuckDB SQL where SQL can express it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryframe.llm import oracles
from quarryframe.llm._base import materialize, new_path
from quarryframe.llm.centroid_clusters import cluster_vectors
from quarryframe.llm.decontaminate import tag_leaks
from quarryframe.llm.html_text import extract_text
from quarryframe.llm.language_id import fit as fit_languages
from quarryframe.llm.language_id import held_out, identify
from quarryframe.llm.line_dedup import line_dedup
from quarryframe.llm.near_dedup import NearConfig, near_dedup
from quarryframe.llm.pieces import PieceConfig, encode_documents
from quarryframe.llm.quality import QualityConfig, fit_references, judge, quality_features
from quarryframe.llm.source_audit import audit_sources
from quarryframe.llm.substring_dedup import repeated_passages
from quarryframe.llm.token_store import StoreConfig, token_digests
from quarryframe.llm.toxicity import fit as fit_toxicity
from quarryframe.llm.toxicity import predict_severity
from quarryframe.llm.warc_archive import archive_round_trip


def _read(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_digests(_read(spark, sf_dir, "documents"), StoreConfig(public_tokenizers.path("byte_bpe_50k.json")))


def op2_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = line_dedup(_read(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.coalesce("text", F.lit("")).cast("binary"), 256).alias("kept_sha256"))


def op3_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    found = identify(docs.select("doc_id", "text"), fit_languages(docs))
    return found.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "lang_pred", "score")


def op4_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit_toxicity(docs, _read(spark, sf_dir, "labels"))
    return predict_severity(docs, model).select("doc_id", "severity", "grade", "toxic")


def op5_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return extract_text(_read(spark, sf_dir, "pages").select("page_id", "url", "html")).select("page_id", "url", "text", "n_chars")


def op6_repeated_passages(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repeated_passages(_read(spark, sf_dir, "documents").select("doc_id", "text"))


def _quality(spark: SparkSession, sf_dir: str, cfg: QualityConfig) -> DataFrame:
    docs = _read(spark, sf_dir, "documents").select("doc_id", "lang", "text")
    features = materialize(quality_features(docs).drop("text"), "quality-features")
    judged = judge(features, fit_references(features, cfg), cfg)
    return judged.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")


def op7_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    """With the absolute word bound only, as its SQL has it."""
    return _quality(spark, sf_dir, QualityConfig(max_word_share=None))


def op7_quality_by_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All rules of the operator, as the pipeline applies them."""
    return _quality(spark, sf_dir, QualityConfig())


def op9_minhash_near_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup(_read(spark, sf_dir, "documents"), NearConfig(shingle_words=3, percent=85))


def op8_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = encode_documents(_read(spark, sf_dir, "documents").select("doc_id", "text"), PieceConfig(public_tokenizers.path("piece_bpe_32k.model")), keep_ids=False)
    return encoded.select("doc_id", "n_ids", "ids_crc32", "round_trip")


def op10_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    tagged = tag_leaks(_read(spark, sf_dir, "documents").select("doc_id", "text"), _read(spark, sf_dir, "benchmark"))
    leaked = tagged.where(F.size("leaks") > 0)
    return leaked.select("doc_id", F.col("leaks.item_id").alias("item_ids"), F.array_min("leaks.distance").alias("least_distance"))


def op11_centroid_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    return cluster_vectors(_read(spark, sf_dir, "embeddings"))[0]


def op12_warc_archive(spark: SparkSession, sf_dir: str) -> DataFrame:
    return archive_round_trip(_read(spark, sf_dir, "pages"), new_path(spark, "archives"))


def op13_source_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit_sources(_read(spark, sf_dir, "documents").select("text", "lang", "source"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_token_store": op1_token_store,
    "op2_line_dedup": op2_line_dedup,
    "op3_language_id": op3_language_id,
    "op4_toxicity": op4_toxicity,
    "op5_html_text": op5_html_text,
    "op6_repeated_passages": op6_repeated_passages,
    "op7_quality_rules": op7_quality_rules,
    "op7_quality_by_share": op7_quality_by_share,
    "op8_sentencepiece": op8_sentencepiece,
    "op9_minhash_near_dedup": op9_minhash_near_dedup,
    "op10_decontamination": op10_decontamination,
    "op11_centroid_clusters": op11_centroid_clusters,
    "op12_warc_archive": op12_warc_archive,
    "op13_source_audit": op13_source_audit,
}

ORACLE_SQL: dict[str, str] = {
    "op2_line_dedup": oracles.line_dedup_sql(),
    "op7_quality_rules": oracles.quality_sql(),
    "op9_minhash_near_dedup": oracles.near_dedup_sql(3, 85),
    "op11_centroid_clusters": oracles.cluster_sql(),
    "op12_warc_archive": oracles.warc_sql(),
    "op13_source_audit": oracles.source_audit_sql(),
}
