"""Queries that write a table in a text format and read it back, and small expressions over records, each with SQL."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import vcf as V
from ..sources import readers, writers
from ..staging import shared_folder
from . import tables as T
from .queries import query


def _folder(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/helixframe-{spark.conf.get('spark.app.id')}/{uuid.uuid4().hex}/{name}"


def _rendered(lines: DataFrame, name: str) -> str:
    """The ``value`` column as text files; their folder."""
    path = _folder(lines.sparkSession, name)
    lines.select("value").write.text(path)
    return path


_TAB = "chr(9)"


def _vcf(spark: SparkSession, d: str) -> str:
    path = _folder(spark, "records.vcf")
    writers.write_vcf(T.records(spark, d).withColumns({"format": F.lit("GT:GQ"), "qual": F.when(F.col("id") % 5 > 0, F.floor("qual"))}), path, ["a", "b", "c"])
    return path


@query(f"WITH {T.RECORDS_SQL} SELECT contig, pos, CAST(id AS VARCHAR) AS id, ref, alt, CASE WHEN id % 5 > 0 THEN floor(qual) END::DOUBLE AS qual, filter, info, 'GT:GQ' AS format, array_to_string(genotypes, '+') AS calls FROM rec")
def scanned_vcf(spark: SparkSession, d: str) -> DataFrame:
    return readers.vcf(spark, _vcf(spark, d)).withColumn("calls", F.array_join("genotypes", "+")).drop("genotypes")


@query(f"WITH {T.RECORDS_SQL} SELECT CAST(id AS VARCHAR) AS id, genotypes[1] AS first, 1::BIGINT AS n FROM rec")
def scanned_vcf_first_sample(spark: SparkSession, d: str) -> DataFrame:
    """The first sample's calls alone, of three."""
    return readers.vcf(spark, _vcf(spark, d), n_samples=1).select("id", F.col("genotypes")[0].alias("first"), F.size("genotypes").cast("long").alias("n"))


@query("SELECT c_custkey, 'sample_' || c_custkey || '_' || c_nationkey || CASE WHEN c_custkey % 3 = 2 THEN '_gz_x' ELSE '' END AS prefix FROM customer")
def vcf_name_prefixes(spark: SparkSession, d: str) -> DataFrame:
    tail = F.element_at(F.array(F.lit(".vcf"), F.lit(".vcf.gz"), F.lit(".gz.x.vcf")), (F.col("c_custkey") % 3 + 1).cast("int"))
    path = F.concat(F.lit("gs://bucket/run.1/sample."), F.col("c_custkey").cast("string"), F.lit("."), F.col("c_nationkey").cast("string"), tail)
    return T.table(spark, d, "customer").select("c_custkey", readers.name_prefix(path).alias("prefix"))


@query(f"WITH {T.intervals_sql()} SELECT CAST(contig AS VARCHAR) AS contig, CAST(start AS INT) AS start, CAST(stop AS INT) AS stop FROM iv")
def scanned_bed(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "intervals.bed")
    writers.write_bed(T.intervals(spark, d), path)
    return readers.bed(spark, path)


@query("SELECT 'c' || c_custkey AS name, repeat('ACGTN', CAST(c_custkey % 40 + 1 AS INT)) AS seq FROM customer")
def scanned_fasta(spark: SparkSession, d: str) -> DataFrame:
    """Sequences over several lines, with text behind their names."""
    seq = F.repeat(F.lit("ACGTN"), (F.col("c_custkey") % 40 + 1).cast("int"))
    lines = T.table(spark, d, "customer").select(F.concat(F.lit("c"), F.col("c_custkey").cast("string"), F.lit(" of a nation")).alias("name"), F.regexp_replace(seq, "(.{60})", "$1\n").alias("seq"))
    return readers.fasta(spark, _rendered(writers.fasta_lines(lines), "seqs.fa"))


@query("""SELECT CAST(o_orderkey AS VARCHAR) AS query, CASE WHEN o_orderkey % 3 = 0 THEN '<b' || o_custkey || '<a' ELSE '>a>b' || o_custkey END AS path, CAST(o_orderkey % 61 AS INT) AS mapq, (o_orderkey % 50 + 1) || '=' AS cigar, o_orderkey % 4 <> 1 AS is_primary FROM orders""")
def scanned_gaf(spark: SparkSession, d: str) -> DataFrame:
    """Graph alignments, a third of them of the minus strand, a quarter secondary."""
    k = F.col("o_orderkey")
    strand = F.when(k % 3 == 0, "-").otherwise("+")
    n = (k % 50 + 1).cast("string")
    cells = [k.cast("string"), F.lit("100"), F.lit("0"), n, strand, F.concat(F.lit(">a>b"), F.col("o_custkey").cast("string")), F.lit("200"), F.lit("5"), F.lit("55"), n, n, (k % 61).cast("string"), F.when(k % 4 == 1, "tp:A:S").otherwise("tp:A:P"), F.concat(F.lit("cg:Z:"), n, F.lit("="))]
    found = readers.gaf(spark, _rendered(T.table(spark, d, "orders").select(F.concat_ws("\t", *cells).alias("value")), "reads.gaf"))
    return found.select("query", S.path_text("path").alias("path"), "mapq", "cigar", "is_primary")


def _gfa(spark: SparkSession, d: str) -> str:
    k, c = F.col("o_orderkey").cast("string"), F.col("o_custkey").cast("string")
    rows = T.table(spark, d, "orders").select(F.explode(F.array(
        F.concat_ws("\t", F.lit("S"), k, F.repeat(F.lit("AC"), (F.col("o_orderkey") % 7 + 1).cast("int"))), F.concat_ws("\t", F.lit("L"), k, F.lit("+"), c, F.when(F.col("o_orderkey") % 2 == 0, "-").otherwise("+"), F.lit("0M")),
        F.concat_ws("\t", F.lit("P"), F.concat(F.lit("p"), k), F.concat(k, F.lit("+,"), c, F.lit("-")), F.lit("*")),
    )).alias("value"))
    return _rendered(rows, "graph.gfa")


@query("SELECT CAST(o_orderkey AS VARCHAR) AS node, repeat('AC', CAST(o_orderkey % 7 + 1 AS INT)) AS seq FROM orders")
def scanned_gfa_nodes(spark: SparkSession, d: str) -> DataFrame:
    return readers.gfa_nodes(spark, _gfa(spark, d))


@query("SELECT CAST(o_orderkey AS VARCHAR) AS a, false AS a_rev, CAST(o_custkey AS VARCHAR) AS b, o_orderkey % 2 = 0 AS b_rev, '0M' AS overlap FROM orders")
def scanned_gfa_edges(spark: SparkSession, d: str) -> DataFrame:
    return readers.gfa_edges(spark, _gfa(spark, d))


@query("SELECT 'p' || o_orderkey AS name, CAST(step AS INT) AS step, CAST(CASE step WHEN 0 THEN o_orderkey ELSE o_custkey END AS VARCHAR) AS node, step = 1 AS rev FROM orders, range(2) t(step)")
def scanned_gfa_paths(spark: SparkSession, d: str) -> DataFrame:
    return readers.gfa_paths(spark, _gfa(spark, d))


@query("""SELECT CAST(l_orderkey AS VARCHAR) AS qname, CAST(l_partkey AS INT) AS ref_start, CAST(l_suppkey % 61 AS INT) AS mapq, l_linenumber % 2 = 1 AS is_reverse, l_returnflag <> 'A' AS is_primary, l_linestatus = 'F' AS is_supplementary, CAST(l_linenumber AS VARCHAR) AS nm
    FROM lineitem WHERE l_linenumber <> 7""")
def scanned_sam(spark: SparkSession, d: str) -> DataFrame:
    """Mapped alignments with their flags and a tag; every seventh line is unmapped."""
    n = F.col("l_linenumber")
    flag = F.when(n % 2 == 1, 16).otherwise(0) + F.when(F.col("l_returnflag") == "A", 256).otherwise(0) + F.when(F.col("l_linestatus") == "F", 2048).otherwise(0) + F.when(n == 7, 4).otherwise(0)
    cells = [F.col("l_orderkey").cast("string"), flag.cast("string"), F.lit("chr1"), (F.col("l_partkey") + 1).cast("string"), (F.col("l_suppkey") % 61).cast("string"), F.lit("5M"), F.lit("*"), F.lit("0"), F.lit("0"), F.lit("ACGTA"), F.lit("!!!!!"), F.concat(F.lit("NM:i:"), n.cast("string"))]
    found = readers.sam(spark, _rendered(T.table(spark, d, "lineitem").select(F.concat_ws("\t", *cells).alias("value")), "reads.sam"))
    return found.select("qname", "ref_start", "mapq", "is_reverse", "is_primary", "is_supplementary", F.try_element_at("tags", F.lit("NM:i")).alias("nm"))


@query("SELECT s_suppkey, s_name, CAST(s_nationkey AS INT) AS s_nationkey FROM supplier")
def scanned_csv(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "suppliers.csv")
    writers.write_csv(T.table(spark, d, "supplier").select("s_suppkey", "s_name", "s_nationkey"), path)
    return readers.csv(spark, path, schema="s_suppkey long, s_name string, s_nationkey int")


@query("SELECT 's' || c_custkey AS sample, '/bams/' || c_custkey || '.bam' AS path FROM customer")
def scanned_manifest(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("c_custkey").cast("string")
    return readers.bam_manifest(spark, _rendered(T.table(spark, d, "customer").select(F.concat(F.lit("s"), k, F.lit(",/bams/"), k, F.lit(".bam")).alias("value")), "bams.csv"))


@query("SELECT 's' || o_custkey AS sample, 'r' || o_orderkey AS read, 100 AS read_length, o_orderpriority AS path, 120 AS path_length, CAST(o_orderkey % 9 AS DOUBLE) AS weight FROM orders")
def scanned_solver_table(spark: SparkSession, d: str) -> DataFrame:
    path = _folder(spark, "reads_to_paths.csv")
    text = lambda c, k: F.concat(F.lit(c), F.col(k).cast("string"))
    rows = T.table(spark, d, "orders").select(text("s", "o_custkey").alias("sample"), text("r", "o_orderkey").alias("read"), F.lit(100).alias("read_length"), F.col("o_orderpriority").alias("path"), F.lit(120).alias("path_length"), (F.col("o_orderkey") % 9).cast("double").alias("weight"))
    writers.write_csv(rows, path)
    return readers.reads_to_paths(spark, path)


@query("SELECT l_returnflag AS tool, l_linestatus AS metric, CAST(l_quantity AS INT) AS v, count(*) AS n FROM lineitem GROUP BY ALL")
def written_metric_values(spark: SparkSession, d: str) -> DataFrame:
    """Sorted values of every tool and metric, written a value a line, counted again."""
    path = _folder(spark, "metrics")
    writers.write_metric_values(T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("tool"), F.col("l_linestatus").alias("metric"), F.col("l_quantity").cast("int").alias("value")), path)
    return spark.read.text(path).groupBy("tool", "metric", F.col("value").cast("int").alias("v")).agg(F.count(F.lit(1)).alias("n"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE l_linenumber % 4 WHEN 0 THEN 'T' || b || '.' WHEN 1 THEN '.' || b || 'T' WHEN 2 THEN 'T' || b || '[c:9[' ELSE ']c:9]' || b || 'T' END AS alt, l_linenumber % 4 < 2 AS single, b AS bases, l_partkey % 5 = 0 OR l_linenumber % 4 >= 2 AND l_partkey % 7 = 1 AS telomere
    FROM (SELECT *, repeat('AG', CAST(l_linenumber % 3 AS INT)) AS b FROM lineitem)""")
def breakend_details(spark: SparkSession, d: str) -> DataFrame:
    """Single and paired breakends: their inserted bases, and whether either side is a contig's virtual end."""
    n, b = F.col("l_linenumber"), F.repeat(F.lit("AG"), (F.col("l_linenumber") % 3).cast("int"))
    t = F.lit("T")
    alt = F.when(n % 4 == 0, F.concat(t, b, F.lit("."))).when(n % 4 == 1, F.concat(F.lit("."), b, t)).when(n % 4 == 2, F.concat(t, b, F.lit("[c:9["))).otherwise(F.concat(F.lit("]c:9]"), b, t))
    pos, length, mate = F.col("l_partkey") % 5, F.lit(50), F.when(F.col("l_partkey") % 7 == 1, 8).otherwise(100)
    rows = T.table(spark, d, "lineitem").withColumns({"alt": alt, "pos": pos, "len": length, "mate_len": mate})
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "alt", V.is_single_breakend("alt").alias("single"), V.inserted_sequence("alt").alias("bases"), F.coalesce(V.is_virtual_telomere("pos", "len", "alt", "mate_len"), F.col("pos") == 0).alias("telomere"))


@query("""SELECT l_orderkey, l_linenumber, l_partkey, CASE WHEN l_returnflag = 'A' THEN '<DEL:artificial:' || l_partkey || ':' || l_linenumber || '>' ELSE 'AC' END AS tagged, CASE WHEN l_returnflag = 'A' THEN '<DEL>' ELSE 'AC' END AS untagged,
    CASE l_suppkey % 3 WHEN 0 THEN 'pbsv' WHEN 1 THEN 'sniffles' END AS caller, CASE WHEN l_linenumber + l_suppkey % 3 > 0 THEN round(l_linenumber / (l_linenumber + l_suppkey % 3), 9) END AS identity FROM lineitem""")
def tagged_alts(spark: SparkSession, d: str) -> DataFrame:
    """Symbolic alleles tagged and untagged, callers of identifiers, identities."""
    rows = T.table(spark, d, "lineitem").withColumns({"alt": F.when(F.col("l_returnflag") == "A", "<DEL>").otherwise("AC"), "rid": F.concat(F.element_at(F.array(F.lit("x.PBSV."), F.lit("Sniffles2."), F.lit("other.")), (F.col("l_suppkey") % 3 + 1).cast("int")), F.col("l_orderkey").cast("string"))})
    rows = rows.withColumn("tagged", V.symbolic_tag("alt", "l_partkey", "l_linenumber"))
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "tagged", V.symbolic_untag("tagged").alias("untagged"), V.caller_of("rid", ["pbsv", "sniffles"]).alias("caller"), F.round(S.identity(F.col("l_linenumber"), F.col("l_suppkey") % 3, F.lit(0), F.lit(0)), 9).alias("identity"))


_KIND = "CASE WHEN flag = 'A' AND q % 3 = 0 THEN 1 WHEN flag = 'A' THEN 2 WHEN flag = 'R' AND q % 2 = 0 THEN 5 WHEN flag = 'R' THEN 8 WHEN status = 'O' THEN 4 ELSE 6 END"


@query(f"""WITH {T.RECORDS_SQL}, k AS (SELECT *, {_KIND} AS kind, contig || ':' || pos AS here, pos + q AS e FROM rec),
    o AS (SELECT contig, pos, ref, alt, id AS source FROM k WHERE kind IN (5, 6, 8) OR q < 20
        UNION ALL SELECT 'chr' || regexp_extract(alt, 'CHR([0-9]+):', 1), CAST(regexp_extract(alt, ':([0-9]+)', 1) AS INT), 'N', ']' || here || ']N', id FROM k WHERE kind = 5
        UNION ALL SELECT contig, pos, 'N', 'N[' || contig || ':' || (e + 1) || '[', id FROM k WHERE kind = 2 AND q >= 20 UNION ALL SELECT contig, e + 1, 'N', ']' || here || ']N', id FROM k WHERE kind = 2 AND q >= 20
        UNION ALL SELECT contig, pos + 1, 'N', ']' || contig || ':' || e || ']N', id FROM k WHERE kind = 4 AND q >= 20 UNION ALL SELECT contig, e, 'N', 'N[' || contig || ':' || (pos + 1) || '[', id FROM k WHERE kind = 4 AND q >= 20
        UNION ALL SELECT contig, pos, 'N', 'NCCCCC.', id FROM k WHERE kind = 1 AND q >= 20 UNION ALL SELECT contig, pos + 1, 'N', '.CCCCCN', id FROM k WHERE kind = 1 AND q >= 20)
    SELECT contig, CAST(pos AS INT) AS pos, ref, alt, source FROM o""")
def cleaned_breakends(spark: SparkSession, d: str) -> DataFrame:
    """Mates of breakends, and breakends of long deletions, duplications and insertions; the reference's bases are unknown here."""
    from ..operators import variants

    bases = T.table(spark, d, "region").where("r_regionkey < 0").select(F.col("r_name").alias("contig"), F.lit(0).alias("pos"), F.lit("A").alias("base"))
    return variants.cleaned_breakends(T.records(spark, d), bases, 20, 5).select("contig", "pos", "ref", "alt", "source")
