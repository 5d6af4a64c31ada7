"""Text sinks.  Rows become lines by expressions; a folder of part files in order is written by Spark's own writer."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.vcf import redundant_info

CHROM = ["#CHROM", "POS", "ID", "REF", "ALT", "QUAL", "FILTER", "INFO", "FORMAT"]


def vcf_lines(records: DataFrame, redundant: Column | None = None) -> DataFrame:
    """One ``value`` a record; a null quality is '.', redundant records are marked and lose their calls."""
    calls = F.col("genotypes")
    info = F.col("info")
    if redundant is not None:
        info = redundant_info("info", redundant)
        calls = F.when(redundant, F.transform(calls, lambda _: F.lit("./."))).otherwise(calls)
    qual = F.coalesce(F.regexp_replace(F.col("qual").cast("string"), r"\.0$", ""), F.lit("."))
    fixed = [F.col("contig"), F.col("pos").cast("string"), F.coalesce(F.col("id").cast("string"), F.lit(".")), F.col("ref"), F.col("alt"), qual, F.coalesce("filter", F.lit(".")), info, F.col("format")]
    return records.select("contig", "pos", F.concat_ws("\t", *fixed, F.array_join(calls, "\t")).alias("value"))


def write_vcf(records: DataFrame, path: str, samples: list[str], redundant: Column | None = None, meta: list[str] = []) -> None:  # noqa: B006
    """Sorted by contig and position over part files, the header first in order."""
    spark = records.sparkSession
    head = ["##fileformat=VCFv4.3", *meta, "\t".join([*CHROM, *samples])]
    lines = vcf_lines(records, redundant).select(F.lit(1).alias("_part"), "contig", "pos", "value")
    header = spark.createDataFrame([(0, "", k, h) for k, h in enumerate(head)], "_part int, contig string, pos int, value string")
    header.unionAll(lines).orderBy("_part", "contig", "pos").select("value").write.mode("overwrite").text(path)


def write_bed(df: DataFrame, path: str, columns: list[str] = ["contig", "start", "stop"]) -> None:  # noqa: B006
    df.select(*columns).orderBy(*columns[:3]).write.mode("overwrite").option("sep", "\t").csv(path)


def write_bedgraph(df: DataFrame, path: str) -> None:
    write_bed(df, path, ["contig", "start", "stop", "value"])


def write_csv(df: DataFrame, path: str, by: list[str] = []) -> None:  # noqa: B006
    w = df.write.mode("overwrite").option("header", True)
    (w.partitionBy(*by) if by else w).csv(path)


def write_metric_values(df: DataFrame, path: str) -> None:
    """(tool, metric, value): one sorted value a line, a folder for each tool and metric."""
    lines = df.select("tool", "metric", "value", F.col("value").cast("string").alias("line"))
    lines.repartition("tool", "metric").sortWithinPartitions("tool", "metric", "value").select("tool", "metric", "line").write.mode("overwrite").partitionBy("tool", "metric").text(path)


def fasta_lines(df: DataFrame, name: str = "name", seq: str = "seq") -> DataFrame:
    return df.select(F.concat(F.lit(">"), F.col(name), F.lit("\n"), F.col(seq)).alias("value"))


def deduplicated_fasta(df: DataFrame, by: list[str], seq: str = "seq") -> DataFrame:
    """(by, name, seq): each distinct sequence of a group once, named by rank and count."""
    from pyspark.sql import Window

    n = df.groupBy(*by, seq).agg(F.count(F.lit(1)).alias("n"))
    return n.withColumn("name", F.concat((F.row_number().over(Window.partitionBy(*by).orderBy(seq)) - 1).cast("string"), F.lit("_"), F.col("n").cast("string"))).drop("n")


def fastq_lines(df: DataFrame, name: str = "name", seq: str = "seq", quality: str = "quality", reverse: str = "is_reverse") -> DataFrame:
    """Four-line records; ``quality`` is an array of numbers under 94, others raise."""
    q = F.transform(quality, lambda x: F.when(x.between(0, 93), F.chr(x + 33)).otherwise(F.raise_error(F.lit("quality out of range")).cast("string")))
    strand = F.when(F.col(reverse), " R").otherwise(" F")
    return df.select(F.concat(F.lit("@"), F.col(name), strand, F.lit("\n"), F.col(seq), F.lit("\n+\n"), F.array_join(q, "")).alias("value"))


def gfa_lines(nodes: DataFrame, edges: DataFrame, steps: DataFrame) -> DataFrame:
    """S, L and P lines; a path's line holds all its steps."""
    sign = lambda c: F.when(c, "-").otherwise("+")
    s = nodes.select(F.lit(0).alias("k"), F.concat_ws("\t", F.lit("S"), "node", "seq").alias("value"))
    l = edges.select(F.lit(1).alias("k"), F.concat_ws("\t", F.lit("L"), "edge.a", sign(F.col("edge.a_rev")), "edge.b", sign(F.col("edge.b_rev")), F.lit("0M")).alias("value"))  # noqa: E741
    walk = F.transform(F.array_sort(F.collect_list(F.struct("step", F.concat("node", sign(F.col("rev"))).alias("x")))), lambda x: x["x"])
    p = steps.groupBy("name").agg(F.array_join(walk, ",").alias("w")).select(F.lit(2).alias("k"), F.concat_ws("\t", F.lit("P"), "name", "w", F.lit("*")).alias("value"))
    return s.unionAll(l).unionAll(p).orderBy("k", "value").select("value")


def failed_windows(windows: DataFrame, done: DataFrame) -> DataFrame:
    """Windows without output."""
    return windows.join(done.select("window_id").distinct(), "window_id", "left_anti")


def unpivoted(df: DataFrame, key: str) -> DataFrame:
    """(key, column, value): a wide table as one row a cell, for a file a column."""
    rest = [c for c in df.columns if c != key]
    return df.select(key, *[F.col(c).cast("string").alias(c) for c in rest]).unpivot(key, rest, "column", "value")
