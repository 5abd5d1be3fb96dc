"""A corpus pipeline: quality rules, line dedup, near-dedup, decontamination, SentencePiece ids.

Each stage takes (spark, docs, sf_dir), works on all that its predecessor kept and returns a DataFrame;
all but the last return the columns of ``documents``. Other columns of the input are dropped, whatever their names; an empty table gives
an empty table of the same columns. Rows are judged one by one and repeated rows alike; a null doc_id, language or source is a value like any other.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarryframe.llm._base import materialize
from quarryframe.llm.decontaminate import decontaminate
from quarryframe.llm.line_dedup import line_dedup
from quarryframe.llm.near_dedup import NearConfig, near_dedup
from quarryframe.llm.pieces import PieceConfig, encode_documents
from quarryframe.llm.quality import quality_rules

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def quality_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality rules reject go, among them all with a null or empty text, for they have fewer words than the rules ask for."""
    return quality_rules(docs.select(*COLUMNS)).where("kept").select(*COLUMNS)


def line_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeated lines go; a document that has no line left goes too, and n_chars follows the text.

    A null text is one empty line and stays null; lines of a null doc_id count as those of one document.
    """
    kept = line_dedup(docs.select(*COLUMNS)).where("n_dropped < n_lines")
    return kept.withColumn("n_chars", F.when(F.col("n_dropped") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))).select(*COLUMNS)


def near_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8) the smallest doc_id stays.

    Texts that are null or without words are like nothing and stay, and so does a row without a doc_id. Where rows share a doc_id, they go only if none of them is one
    that stays: no text is lost with another row's copy, at the price of that copy.
    """
    docs = docs.select(*COLUMNS)
    judged = near_dedup(docs.select("doc_id", "text"), NearConfig())
    gone = judged.groupBy("doc_id").agg(F.bool_or("kept").alias("kept")).where("not kept").select("doc_id")
    return docs.join(gone, "doc_id", "left_anti").select(*COLUMNS)


def benchmark_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents with a benchmark item go; a null or empty text holds none."""
    return decontaminate(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet")).select(*COLUMNS)


def piece_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The kept documents with their SentencePiece ids; a null or empty text has none."""
    return encode_documents(docs.select(*COLUMNS), PieceConfig(public_tokenizers.path("piece_bpe_32k.model"))).drop("text")


STAGES = [
    ("quality rules", quality_stage),
    ("line dedup", line_stage),
    ("near-duplicate removal", near_stage),
    ("benchmark decontamination", benchmark_stage),
    ("sentencepiece ids", piece_stage),
]

#: SQL has no SentencePiece encoder; the tests compare all stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k + 1 < len(STAGES):
            docs = materialize(docs, f"stage-{k}")
    return docs
