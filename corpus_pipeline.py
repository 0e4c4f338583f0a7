"""A training-data pipeline: quality, line and near duplicates, decontamination, packing.

Each stage takes (spark, docs, sf_dir) and returns the rows that stay, with the columns of documents; the last returns placed pieces.
A row is known by its doc_id and its text (by its 64-bit hash), so rows without a doc_id, or that share one, are judged each for itself. Null texts
fail the quality rules; empty tables give empty tables; columns beside those of documents are passed on.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kindred.llm import decontam, line_dedup, packing, quality, similar_texts
from kindred.llm.texts import text_hash
from kindred.sources.storage import materialize

KEY = ["__nameless", "__id", "__hash"]


def _keyed(rows: DataFrame, hashed) -> DataFrame:
    """``rows`` with the key of each, without nulls, so that joins and groups by it share one exchange."""
    return rows.withColumns({"__nameless": F.col("doc_id").isNull(), "__id": F.coalesce(F.col("doc_id").cast("long"), F.lit(0)), "__hash": hashed})


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows that the base rules and the risk-controlled cutoff of their language keep; repeated rows stay or go together."""
    judged = quality.judge(docs, spark.read.parquet(f"{sf_dir}/labels.parquet")).where("kept")
    kept = _keyed(judged, F.col("text_hash")).select(*KEY, F.col("stratum").alias("__lang")).distinct()
    same = [F.col(f"a.{c}") == F.col(f"b.{c}") for c in KEY] + [F.col("a.lang").eqNullSafe(F.col("b.__lang"))]
    return _keyed(docs, text_hash(F.col("text"))).alias("a").join(kept.alias("b"), same, "left_semi").select(*docs.columns)


def line_windows(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All rows, without the lines that repeat earlier windows of three; n_chars follows the text."""
    out = line_dedup.dedup_lines(docs)
    n = F.when(F.col("n_removed_lines") > 0, F.length("text").cast("long")).otherwise(F.col("n_chars"))
    return out.select(*(n.alias(c) if c == "n_chars" else F.col(c) for c in docs.columns))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each group of texts linked by a Jaccard similarity of 0.8 or more of their five-word shingles: that with the smallest doc_id (one
    without a doc_id only if no other is in the group; of several texts under one id that with the smallest hash; of repeated rows that with the smallest other columns)."""
    names = similar_texts.near_duplicates(docs, shingle=5, least=800)
    kept = materialize(_keyed(names.where("first"), F.col("text_hash")).select(*KEY).distinct())
    rest = F.min(F.struct(*(F.col(c) for c in docs.columns if c != "text"))).alias("__rest")
    single = _keyed(docs, text_hash(F.col("text"))).groupBy(*KEY).agg(F.first("text").alias("text"), rest)
    return single.join(kept, KEY, "left_semi").select(*(F.col(c) if c == "text" else F.col(f"__rest.{c}") for c in docs.columns))


def benchmark_decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Rows in which no benchmark item of MIN_CHARS characters or more was found; shorter ones are words that clean documents hold too."""
    found = decontam.matches(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet")).where(F.col("item_chars") >= decontam.MIN_CHARS)
    found = materialize(_keyed(found, F.col("text_hash")).select(*KEY).distinct())
    return _keyed(docs, text_hash(F.col("text"))).join(found, KEY, "left_anti").select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents' ids with their sequence and place in it."""
    return packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"), end=2, size=4096)


STAGES = [
    ("quality_rules", quality_rules),
    ("line_dedup", line_windows),
    ("simhash_near_dedup", near_duplicates),
    ("benchmark_decontamination", benchmark_decontamination),
    ("packing", pack),
]

#: SimHash components and packing can't be said in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over documents, each written and read again before the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stage(spark, docs, sf_dir)
        if name != STAGES[-1][0]:
            docs = materialize(docs)
    return docs
