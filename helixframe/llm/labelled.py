"""Labelled rows that the classifiers learn from."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of

#: Labelled rows a classifier is fitted on: the first this many in order of a hash of their identifier.
MOST_ROWS = 20_000
FOLDS = 5


def sample(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """(doc_id, text, label 0 or 1) of a bounded sample of labelled rows outside the held-out fold.

    The sample is fixed by the identifiers alone.  Labels that are null or
    contradict each other for one identifier teach nothing.  Of several texts of
    one identifier the one with the smallest hash teaches, so there are at most
    ``most_rows`` rows.  At most ``most_rows`` identifiers are broadcast.
    """
    marked = (
        labels.where(F.col(id_col).isNotNull() & F.col(label).isNotNull() & (fold_of(F.col(id_col), FOLDS) != 0))
        .groupBy(F.col(id_col).alias("of"))
        .agg(F.min(label).alias("label"), F.max(label).alias("most"))
        .where("label = most and label in (0, 1)")
        .orderBy(F.xxhash64("of"), "of")
        .limit(most_rows)
        .select("of", F.col("label").cast("int").alias("label"))
    )
    texts = docs.select(F.col(id_col).alias("doc_id"), F.coalesce(F.col(text_col).cast("string"), F.lit("")).alias("text"))
    hit = texts.join(F.broadcast(marked), F.col("doc_id") == F.col("of"))
    return hit.groupBy("doc_id").agg(F.min_by("text", F.struct(F.xxhash64("text"), "text")).alias("text"), F.first("label").alias("label")).select("doc_id", "text", "label")


def held_out(id_col: str):
    return fold_of(F.col(id_col), FOLDS) == 0
