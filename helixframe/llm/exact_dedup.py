"""Exact duplicates by a tree merge of sorted digest runs, in DataFrame functions only.

Each input partition gives one run: its (digest, smallest identifier, count)
entries, sorted by digest.  In binomial rounds, runs whose numbers share
their upper bits are exchanged and merged (``FAN_IN`` of them at a time); a
merged run keeps, for each digest, the smallest identifier and the count, so
that a text with copies in many partitions shrinks by up to ``FAN_IN`` in
every round before it can become a hot key.  The digest is verified by the
text's length and a second, independent hash: entries merge only where all
three agree.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text

#: Runs merged by one exchange: two binomial rounds.
FAN_IN_BITS = 2
WHITE_SPACE = r"[\x20\x09-\x0D]+"
KEY = ["text_sha256", "n_bytes", "check_hash"]


def digests(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per document: row_id, doc_id, run, text_sha256, n_bytes, check_hash, sorted in each run; staged."""
    norm = F.regexp_replace(whole_text(text_col), WHITE_SPACE, " ")
    rows = docs.select(
        (F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_id"),
        F.col(id_col).alias("doc_id"),
        F.spark_partition_id().alias("run"),
        norm.alias("norm"),
    ).select(
        "row_id", "doc_id", "run",
        F.sha2(F.col("norm").cast("binary"), 256).alias("text_sha256"),
        F.octet_length("norm").cast("long").alias("n_bytes"),
        F.xxhash64("norm").alias("check_hash"),
    )
    return staged(rows.sortWithinPartitions("text_sha256"), "digests")


def merged_runs(runs: DataFrame) -> DataFrame:
    """The tree's root: KEY, keep (struct of the row that stays), group_size."""
    # nulls sort last: a row without an identifier stays only if all its copies have none
    entry = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    level = runs.groupBy("run", *KEY).agg(F.min(entry).alias("keep"), F.count(F.lit(1)).alias("group_size"))
    last = runs.agg(F.max("run")).first()[0] or 0
    while last > 0:
        last >>= FAN_IN_BITS
        level = (
            level.withColumn("run", F.shiftright("run", FAN_IN_BITS))
            .groupBy("run", *KEY)
            .agg(F.min("keep").alias("keep"), F.sum("group_size").alias("group_size"))
            .sortWithinPartitions("run", "text_sha256")
        )
    return level.drop("run")


def exact_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: row_id, doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when identical after each run of ASCII white space is
    replaced by one space; a null text counts as empty, and all empty texts are
    one group.  The row with the smallest identifier stays; null identifiers
    come last; of repeated rows (same identifier, same text) exactly one stays.
    Other columns are not read.  An empty table gives an empty result.
    """
    runs = digests(docs, id_col, text_col, row_col)
    # only groups with copies need the way back; staged, so that both sides of the join are exchanges that can be split
    groups = staged(merged_runs(runs).where("group_size > 1"), "groups")
    keep = groups.select(*KEY, "keep", F.col("group_size").alias("of_group"))
    return runs.join(keep, KEY, "left").select(
        "row_id",
        "doc_id",
        F.when(F.col("of_group").isNull(), F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("of_group", F.lit(1)).cast("long").alias("group_size"),
        (F.col("of_group").isNull() | (F.col("keep.row_id") == F.col("row_id"))).alias("kept"),
        "text_sha256",
    )


def drop_copies(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, with all their columns."""
    found = exact_dedup(docs, id_col, text_col, row_col)
    drop = found.where("not kept").select(F.col("row_id").alias(row_col))
    return docs.join(drop, row_col, "left_anti")
