"""Alignments laid out by place, so that a region is read from the files of its bins alone.

Every alignment lies once, in the smallest bin that holds all of it: bins of 2^17
bases, and of eight times as many on each level above.  Bins below ``FOLDER_LEVEL`` share
the folder of the bin of that level around them, so a table has a folder for every 8 million
bases, not for every 131,072, and files of a useful size.  A region overlaps few bins of
each level: the names of their folders are a partition filter, and inside a file rows are in
order of their own bins, so that row groups are skipped by the bins and ends pushed down to them.
"""

from __future__ import annotations

from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Bits of the smallest bins, bits more on each level, and the number of levels (the highest holds 2^29 bases).
SMALLEST, MORE, LEVELS = 17, 3, 5
#: Level of the smallest bins that have a folder of their own.
FOLDER_LEVEL = 2


def bin_of(start: Column, stop: Column) -> Column:
    """level * 2^24 + number of the smallest bin that holds [start, stop); longer ones and rows without an end are in bin -1."""
    last = F.greatest(start, stop - 1)
    out = F.lit(-1)
    for level in reversed(range(LEVELS)):
        bits = SMALLEST + MORE * level
        out = F.when(F.shiftright(start, bits) == F.shiftright(last, bits), F.lit(level << 24) + F.shiftright(start, bits)).otherwise(out)
    return out.cast("int")


def folder_of(place: Column) -> Column:
    """The bin whose folder holds the rows of bin ``place``: itself, or the one of FOLDER_LEVEL around it."""
    number, level = place.bitwiseAND((1 << 24) - 1), F.shiftright(place, 24)
    out = place
    for k in range(FOLDER_LEVEL):
        out = F.when((place >= 0) & (level == k), F.lit(FOLDER_LEVEL << 24) + F.shiftright(number, MORE * (FOLDER_LEVEL - k))).otherwise(out)
    return out.cast("int")


def bin_ranges(start: int, stop: int) -> list[tuple[int, int]]:
    """First and last bin of each level that hold a row overlapping [start, stop)."""
    out = [(-1, -1)]
    for level in range(LEVELS):
        bits = SMALLEST + MORE * level
        out.append(((level << 24) + (start >> bits), (level << 24) + (max(stop - 1, start) >> bits)))
    return out


def bins_of_region(start: int, stop: int) -> list[int]:
    """All bins that hold a row overlapping [start, stop)."""
    return [k for lo, hi in bin_ranges(start, stop) for k in range(lo, hi + 1)]


def write_by_region(alignments: DataFrame, path: str, contig: str = "contig", start: str = "start", stop: str = "stop") -> None:
    """``alignments`` as Parquet by contig and folder; rows of one place are dealt by range, so a deep one is several files."""
    place = F.coalesce(bin_of(F.col(start).cast("long"), F.col(stop).cast("long")), F.lit(-1))
    binned = alignments.withColumns({"_contig": F.col(contig).cast("string"), "_place": place}).withColumn("_bin", folder_of(F.col("_place")))
    order = ["_contig", "_bin", "_place", start, stop]
    binned.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(*order, "_any").drop("_any").sortWithinPartitions(*order).write.partitionBy("_contig", "_bin").parquet(path)


def read_region(spark: SparkSession, path: str, contig: str, start: int, stop: int, names: tuple[str, str] = ("start", "stop")) -> DataFrame:
    """Alignments of a table of ``write_by_region`` that overlap [start, stop) of a contig."""
    ranges = bin_ranges(start, stop)
    folders = [k for lo, hi in [ranges[0], *ranges[1 + FOLDER_LEVEL :]] for k in range(lo, hi + 1)]
    held = reduce(or_, (F.col("_place").between(lo, hi) for lo, hi in ranges))
    rows = spark.read.parquet(path).where((F.col("_contig") == contig) & F.col("_bin").isin(folders))
    return rows.where((F.col(names[0]) < stop) & (F.col(names[1]) > start)).where(held).drop("_contig", "_bin", "_place")
