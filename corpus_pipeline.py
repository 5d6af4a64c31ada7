"""A training-data pipeline over the documents table, stage by stage.

Each stage takes (spark, docs, sf_dir) and works on all rows the one before it
kept; what it returns is written as Parquet and read again for the next.  All
stages take nulls in any column, repeated rows, very long texts, empty tables
and extra columns of any names; all but the last keep every column of the rows
they keep as it is.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from helixframe.llm import decontaminate, exact_dedup, langid, near_dedup, packing
from helixframe.llm.common import staged, with_row_ids


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents without a language: null texts and texts without a letter."""
    model = langid.fit(langid.training_rows(docs, "doc_id", "text", "lang"))
    return langid.with_language(docs, model)


def drop_exact_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one row of equal texts: that with the smallest doc_id; null identifiers come last, the first row of equal ones stays."""
    rows, row_col = with_row_ids(docs)
    return exact_dedup.drop_copies(rows, row_col).select(*docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps one document of each near-duplicate component: that with the smallest doc_id, chosen as above; texts without words all stay."""
    rows, row_col = with_row_ids(docs)
    return near_dedup.drop_near_copies(rows, row_col).select(*docs.columns)


def drop_benchmark_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops documents that hold a benchmark item or a window of one; null and empty items are nowhere."""
    return decontaminate.without_leaks(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packs what is left into sequences: one row for each piece, with the columns of ``packing.packed`` alone; a null source is the source ""."""
    return packing.packed(docs)


STAGES = [
    ("language_id", identify_language),
    ("exact_dedup", drop_exact_copies),
    ("near_dedup", drop_near_copies),
    ("decontaminate", drop_benchmark_leaks),
    ("pack", pack),
]

#: Learned code lengths, near-duplicate components and tokenisation are not SQL; the stages are tested against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = staged(stage(spark, docs, sf_dir), name)
    return docs
