"""Streams: islands as they close, and call sets taken in batch by batch."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def session_islands(events: DataFrame, key: str, at: str, gap: str, late: str) -> DataFrame:
    """Gap-tolerant islands of a stream: (key, start, stop, n); an island is final once the watermark passes its end."""
    s = F.session_window(at, gap)
    return events.withWatermark(at, late).groupBy(key, s.alias("w")).agg(F.count(F.lit(1)).alias("n"), F.min(at).alias("start"), F.max(at).alias("last")).select(key, "start", F.col("w.end").alias("stop"), "last", "n")


def ingest(records: DataFrame, path: str, key: list[str], checkpoint: str, transform: Callable[[DataFrame], DataFrame] = lambda df: df) -> StreamingQuery:
    """Each batch's new records (by key, once in a batch) appended to a Parquet table partitioned by contig; restarts go on where the checkpoint is."""

    def take(batch: DataFrame, number: int) -> None:
        new = transform(batch).dropDuplicates(key)
        new.withColumn("batch", F.lit(number)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("batch", "contig").parquet(path)

    return records.writeStream.foreachBatch(take).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
