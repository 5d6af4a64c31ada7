"""Text formats as DataFrames.

All are line formats read by ``spark.read.text`` and split by expressions, so
files are split over tasks, and filters and column pruning work on them.
Malformed input raises in the task that meets it.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def _lines(spark: SparkSession, path: str) -> DataFrame:
    raw = spark.read.option("lineSep", "\n").text(path).where("value != ''")
    return raw.withColumn("value", _no_return(F.col("value")))


def _no_return(value: Column) -> Column:
    return F.when(value.contains("\r"), F.raise_error(F.lit("carriage return in input")).cast("string")).otherwise(value)


def _cell(cells: str, k: int) -> Column:
    return F.try_element_at(cells, F.lit(k + 1))


def vcf_samples(spark: SparkSession, path: str) -> list[str]:
    """Sample names of the #CHROM line; it alone reaches the driver."""
    row = spark.read.text(path).where("value like '#CHROM%'").first()
    return row[0].rstrip("\r").split("\t")[9:] if row else []


def vcf(spark: SparkSession, path: str, n_samples: int | None = None) -> DataFrame:
    """contig, pos, id, ref, alt, qual (null for .), filter, info, format, genotypes of all or the first ``n_samples`` samples."""
    rows = _lines(spark, path).where("value not like '#%'").select(F.split("value", "\t").alias("c"))
    calls = F.slice("c", 10, F.greatest(F.size("c") - 9, F.lit(0)))
    if n_samples is not None:
        calls = F.slice(calls, 1, n_samples) if n_samples else F.array().cast("array<string>")
    return rows.select(
        _cell("c", 0).alias("contig"), _cell("c", 1).cast("int").alias("pos"), _cell("c", 2).alias("id"), _cell("c", 3).alias("ref"), _cell("c", 4).alias("alt"),
        _cell("c", 5).try_cast("double").alias("qual"), _cell("c", 6).alias("filter"), _cell("c", 7).alias("info"), _cell("c", 8).alias("format"), calls.alias("genotypes"),
    )


def name_prefix(path: Column) -> Column:
    """A file's name without .gz and .vcf, dots as underscores."""
    return F.replace(F.regexp_replace(F.regexp_replace(F.substring_index(path, "/", -1), "[.]gz$", ""), "[.]vcf$", ""), F.lit("."), F.lit("_"))


def bed(spark: SparkSession, path: str) -> DataFrame:
    """contig, start, stop; further columns are left out."""
    c = _lines(spark, path).select(F.split("value", "\t").alias("c"))
    return c.select(_cell("c", 0).alias("contig"), _cell("c", 1).cast("int").alias("start"), _cell("c", 2).cast("int").alias("stop"))


def fasta(spark: SparkSession, path: str) -> DataFrame:
    """name (up to the first white space) and seq (lines joined); a record is one split of the text at '>'."""
    raw = spark.read.option("lineSep", ">").text(path).where("trim(value) != ''")
    head = F.regexp_extract("value", r"^(\S+)", 1)
    body = F.regexp_replace(F.regexp_replace("value", r"^[^\n]*\n?", ""), r"\n", "")
    return raw.select(_no_return(head).alias("name"), _no_return(body).alias("seq"))


def gaf(spark: SparkSession, path: str) -> DataFrame:
    """The twelve columns of graph alignments, path as array<struct<node,rev>>, tags as a map of TAG:TYPE to value."""
    from ..functions.sequences import graph_path

    c = _lines(spark, path).select(F.split("value", "\t").alias("c"))
    text = _cell("c", 5)
    checked = F.when(text.contains(":"), F.raise_error(F.lit("stable path coordinates are not supported")).cast("string")).otherwise(text)
    tags = F.map_from_entries(F.transform(F.slice("c", 13, F.greatest(F.size("c") - 12, F.lit(0))), lambda t: F.struct(F.substring_index(t, ":", 2).alias("k"), F.regexp_replace(t, "^[^:]*:[^:]*:", "").alias("v"))))
    i = lambda k: _cell("c", k).cast("int")
    out = c.select(
        _cell("c", 0).alias("query"), i(1).alias("query_len"), i(2).alias("query_start"), i(3).alias("query_stop"), _cell("c", 4).alias("strand"), checked.alias("_p"),
        i(6).alias("path_len"), i(7).alias("path_start"), i(8).alias("path_stop"), i(9).alias("n_match"), i(10).alias("block_len"), i(11).alias("mapq"), tags.alias("tags"),
    )
    out = out.withColumn("path", graph_path("_p", F.col("strand") == "-")).drop("_p")
    return out.withColumns({"cigar": F.try_element_at("tags", F.lit("cg:Z")), "is_primary": F.coalesce(F.try_element_at("tags", F.lit("tp:A")), F.lit("P")) == "P"})


def gfa_nodes(spark: SparkSession, path: str) -> DataFrame:
    """node, seq, and node_id by order of the name."""
    c = _lines(spark, path).where("value like 'S\t%'").select(F.split("value", "\t").alias("c"))
    return c.select(_cell("c", 1).alias("node"), _cell("c", 2).alias("seq"))


def gfa_node_ids(nodes: DataFrame) -> DataFrame:
    """Nodes with node_id, their rank by name from 1: counted by range partitions, not in one sort."""
    from ..operators.intervals import chunked

    n = max(1, nodes.count())
    return chunked(nodes, ["node"], n).withColumn("node_id", F.col("chunk") + 1).drop("chunk")


def gfa_edges(spark: SparkSession, path: str) -> DataFrame:
    c = _lines(spark, path).where("value like 'L\t%'").select(F.split("value", "\t").alias("c"))
    return c.select(_cell("c", 1).alias("a"), (_cell("c", 2) == "-").alias("a_rev"), _cell("c", 3).alias("b"), (_cell("c", 4) == "-").alias("b_rev"), _cell("c", 5).alias("overlap"))


def gfa_paths(spark: SparkSession, path: str) -> DataFrame:
    """name, step, node, rev of P lines."""
    c = _lines(spark, path).where("value like 'P\t%'").select(F.split("value", "\t").alias("c"))
    steps = c.select(_cell("c", 1).alias("name"), F.posexplode(F.split(_cell("c", 2), ",")).alias("step", "s"))
    return steps.select("name", "step", F.left("s", F.length("s") - 1).alias("node"), (F.right("s", F.lit(1)) == "-").alias("rev"))


def sam(spark: SparkSession, path: str, mapped_only: bool = True) -> DataFrame:
    """SAM text: qname, flag, contig, ref_start (zero-based), mapq, cigar, seq, qual, tags, is_reverse, is_primary, is_supplementary."""
    c = _lines(spark, path).where("value not like '@%'").select(F.split("value", "\t").alias("c"))
    tags = F.map_from_entries(F.transform(F.slice("c", 12, F.greatest(F.size("c") - 11, F.lit(0))), lambda t: F.struct(F.substring_index(t, ":", 2).alias("k"), F.regexp_replace(t, "^[^:]*:[^:]*:", "").alias("v"))))
    flag = _cell("c", 1).cast("int")
    bit = lambda b: F.col("flag").bitwiseAND(F.lit(b)) != 0
    out = c.select(
        _cell("c", 0).alias("qname"), flag.alias("flag"), _cell("c", 2).alias("contig"), (_cell("c", 3).cast("int") - 1).alias("ref_start"), _cell("c", 4).cast("int").alias("mapq"),
        _cell("c", 5).alias("cigar"), _cell("c", 9).alias("seq"), _cell("c", 10).alias("qual"), tags.alias("tags"),
    ).withColumns({"is_reverse": bit(16), "is_primary": ~bit(256), "is_supplementary": bit(2048)})
    return out.where(~bit(4) & (F.col("contig") != "*")) if mapped_only else out


def csv(spark: SparkSession, path: str, header: bool = True, schema: str | None = None) -> DataFrame:
    """Comma-separated values without quoting."""
    reader = spark.read.option("header", header).option("quote", "")
    return (reader.schema(schema) if schema else reader).csv(path)


def bam_manifest(spark: SparkSession, path: str) -> DataFrame:
    """sample, path; lines of another number of columns raise."""
    c = _lines(spark, path).select(F.split("value", ",").alias("c"))
    ok = F.when(F.size("c") == 2, F.col("c")).otherwise(F.raise_error(F.lit("a manifest line has two columns")).cast("array<string>"))
    return c.select(ok.alias("c")).select(_cell("c", 0).alias("sample"), _cell("c", 1).alias("path"))


SOLVER_SCHEMA = "sample string, read string, read_length int, path string, path_length int, weight double"


def reads_to_paths(spark: SparkSession, path: str, recursive: bool = False) -> DataFrame:
    """Solver input; with ``recursive`` every reads_to_paths.csv below a folder, its folder's name as window."""
    reader = spark.read.option("header", True).option("quote", "").option("mode", "FAILFAST").schema(SOLVER_SCHEMA)
    if not recursive:
        return reader.csv(path)
    found = reader.option("recursiveFileLookup", True).option("pathGlobFilter", "reads_to_paths.csv").csv(path)
    return found.withColumn("window", F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))


def window_files(spark: SparkSession, folder: str, name: str, schema: str) -> DataFrame:
    """The CSV ``name`` of every contig_start-stop folder, with contig, start and stop; windows whose log has a failed stage are left out."""
    from ..functions.sequences import region_of

    def load(file: str, kind: str) -> DataFrame:
        got = spark.read.option("header", True).schema(kind).option("recursiveFileLookup", True).option("pathGlobFilter", file).csv(folder)
        r = region_of(F.element_at(F.split(F.col("_metadata.file_path"), "/"), -2))
        return got.select("*", r["contig"].alias("contig"), r["start"].alias("start"), r["stop"].alias("stop"))

    failed = load("log.csv", "name string, h int, m int, s int, ms int, success int, notes string").where("success != 1").select("contig", "start", "stop").distinct()
    return load(name, schema).join(failed, ["contig", "start", "stop"], "left_anti")


def line_numbers(df: DataFrame, by: list[str], order: list[str]) -> DataFrame:
    return df.withColumn("line", F.row_number().over(Window.partitionBy(*by).orderBy(*order)))
