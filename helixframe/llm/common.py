"""Helpers shared by the training-data operators."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.column import Column

from ..staging import staged

__all__ = ["fold_of", "fresh_name", "size_in_partitions", "staged", "whole_text", "with_row_ids"]


def fresh_name(df: DataFrame, wanted: str) -> str:
    """``wanted``, with underscores in front until no column of ``df`` has that name (in any case)."""
    taken = {c.lower() for c in df.columns}
    while wanted.lower() in taken:
        wanted = "_" + wanted
    return wanted


def with_row_ids(df: DataFrame, wanted: str = "row_id") -> tuple[DataFrame, str]:
    """``df`` as a staged table with a column that names each row, and that column's name."""
    name = fresh_name(df, wanted)
    return staged(df.withColumn(name, F.monotonically_increasing_id()), "rows"), name


def whole_text(col: str) -> Column:
    """A text column with null as the empty text."""
    return F.coalesce(F.col(col).cast("string"), F.lit(""))


def fold_of(doc_id: Column, folds: int) -> Column:
    """crc32 of the identifier as text, modulo ``folds``; a null identifier counts as the empty text."""
    return F.crc32(F.coalesce(doc_id.cast("string"), F.lit("")).cast("binary")) % F.lit(folds)


def size_in_partitions(df: DataFrame) -> int:
    return int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
