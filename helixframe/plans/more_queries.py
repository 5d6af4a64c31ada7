"""Queries of graphs, filters, histograms and small operators, each with the SQL that a second engine runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import vcf as V
from ..operators import alignments, assign, bipartite, graph, intervals, metrics, variants
from ..sources import writers
from . import tables as T
from .queries import query

#: Windows are suppliers of 3,000 bases; a line is a record in its supplier's window, a third of them breakends.
_SIZE = 3000
_GRAPH = f"""win AS (SELECT s_suppkey AS window_id, 0 AS start, {_SIZE} AS stop, repeat('ACGTTGCA', {_SIZE // 8}) AS seq FROM supplier),
    rec AS (SELECT l_suppkey AS window_id, CAST(l_orderkey * 8 + l_linenumber AS VARCHAR) AS record, CAST(l_orderkey % 1400 + 100 AS INT) AS first, CAST(l_orderkey % 1400 + 100 + l_quantity AS INT) AS second,
        CAST(l_quantity AS INT) AS q, CASE WHEN l_returnflag = 'A' THEN 2 WHEN l_returnflag = 'R' THEN 4 ELSE 5 END AS sv_type, CAST(l_partkey % 1300 + 1550 AS INT) AS mate, l_linenumber % 4 AS form FROM lineitem),
    bnd AS (SELECT *, form IN (0, 1) AS lft, form IN (1, 3) AS mleft, CASE WHEN form IN (0, 1) THEN first ELSE first - 1 END AS cut, CASE WHEN form IN (1, 3) THEN mate ELSE mate - 1 END AS far FROM rec WHERE sv_type = 5),
    pts AS (SELECT window_id, unnest([start, stop]) AS ats FROM win UNION SELECT window_id, unnest([first, second]) FROM rec WHERE sv_type <> 5 UNION SELECT window_id, unnest([cut, far]) FROM bnd),
    nodes AS (SELECT window_id, 'r' || ats AS node, ats, lead(ats) OVER (PARTITION BY window_id ORDER BY ats) AS until FROM pts QUALIFY until IS NOT NULL)"""


def _windows(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("window_id"), F.lit(0).alias("start"), F.lit(_SIZE).alias("stop"), F.repeat(F.lit("ACGTTGCA"), _SIZE // 8).alias("seq"))


def _records(spark: SparkSession, d: str) -> DataFrame:
    first, q, form = (F.col("l_orderkey") % 1400 + 100).cast("int"), F.col("l_quantity").cast("int"), F.col("l_linenumber") % 4
    place = F.concat(F.lit("c:"), (F.col("l_partkey") % 1300 + 1550).cast("string"))
    alt = F.when(form == 0, F.concat(F.lit("A["), place, F.lit("["))).when(form == 1, F.concat(F.lit("A]"), place, F.lit("]"))).when(form == 2, F.concat(F.lit("["), place, F.lit("[A"))).otherwise(F.concat(F.lit("]"), place, F.lit("]A")))
    kind = F.when(F.col("l_returnflag") == "A", V.TYPES["DEL"]).when(F.col("l_returnflag") == "R", V.TYPES["DUP"]).otherwise(V.TYPES["BND"])
    return T.table(spark, d, "lineitem").select(
        F.col("l_suppkey").alias("window_id"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).cast("string").alias("record"), first.alias("first"), (first + q).alias("second"), first.alias("pos"), q.alias("sv_length"),
        kind.alias("sv_type"), F.when(F.col("l_returnflag") == "A", "<DEL>").when(F.col("l_returnflag") == "R", "<DUP>").otherwise(alt).alias("alt"),
    )


def _nodes(spark: SparkSession, d: str) -> DataFrame:
    win = _windows(spark, d)
    return graph.reference_nodes(graph.breakpoints(_records(spark, d), win, T.spread(T.table(spark, d, "lineitem"))), win)


def _flat(edges: DataFrame, *keep: str) -> DataFrame:
    sign = lambda c: F.when(F.col(c), "<").otherwise(">")
    return edges.select(*keep, F.concat(sign("edge.a_rev"), "edge.a", sign("edge.b_rev"), "edge.b").alias("edge"))


#: An edge of (a, ar, b, br) in its smaller direction, in SQL.
_EDGE = "CASE WHEN (a, ar, b, br) <= (b, NOT br, a, NOT ar) THEN (CASE WHEN ar THEN '<' ELSE '>' END) || a || (CASE WHEN br THEN '<' ELSE '>' END) || b ELSE (CASE WHEN br THEN '>' ELSE '<' END) || b || (CASE WHEN ar THEN '>' ELSE '<' END) || a END"


@query(f"WITH {_GRAPH} SELECT window_id, ats AS \"at\" FROM pts")
def graph_breakpoints(spark: SparkSession, d: str) -> DataFrame:
    return graph.breakpoints(_records(spark, d), _windows(spark, d))


@query(f"WITH {_GRAPH} SELECT window_id, node, ats AS \"at\", until, substr(seq, ats + 1, until - ats) AS seq FROM nodes JOIN win USING (window_id)")
def graph_reference_nodes(spark: SparkSession, d: str) -> DataFrame:
    return _nodes(spark, d)


@query(f"WITH {_GRAPH} SELECT window_id, CASE WHEN node <= 'r' || until THEN '>' || node || '>r' || until ELSE '<r' || until || '<' || node END AS edge FROM nodes WHERE until < {_SIZE}")
def graph_reference_edges(spark: SparkSession, d: str) -> DataFrame:
    return _flat(graph.reference_edges(_nodes(spark, d)), "window_id")


@query(f"""WITH {_GRAPH}, e AS (SELECT window_id, record, p.node AS a, false AS ar, 'r' || second AS b, false AS br FROM rec JOIN nodes p USING (window_id) WHERE sv_type = 2 AND p.until = first
    UNION ALL SELECT window_id, record, u.node, false, 'r' || first, false FROM rec JOIN nodes u USING (window_id) WHERE sv_type = 4 AND u.until = second) SELECT window_id, record, {_EDGE} AS edge FROM e""")
def graph_record_edges(spark: SparkSession, d: str) -> DataFrame:
    r = _records(spark, d).where(F.col("sv_type") != V.TYPES["BND"])
    return _flat(graph.record_edges(r, _nodes(spark, d), graph.alternative_nodes(r)), "window_id", "record")


@query(f"""WITH {_GRAPH}, e AS (SELECT window_id, record, CASE WHEN lft THEN p.node ELSE 'r' || cut END AS a, NOT lft AS ar, CASE WHEN mleft THEN u.node ELSE 'r' || far END AS b, mleft AS br
    FROM bnd JOIN nodes p USING (window_id) JOIN nodes u USING (window_id) WHERE p.until = cut AND u.until = far) SELECT window_id, record, {_EDGE} AS edge FROM e""")
def graph_breakend_edges(spark: SparkSession, d: str) -> DataFrame:
    return _flat(graph.breakend_edges(_records(spark, d), _nodes(spark, d)), "window_id", "record")


@query(f"WITH {_GRAPH} SELECT window_id, node, r % 2 = 1 AS rev, CASE WHEN r % 2 = 1 THEN until ELSE ats END AS r_start, CASE WHEN r % 2 = 1 THEN ats ELSE until END AS r_stop FROM (SELECT *, ats % 2 AS r FROM nodes)")
def graph_node_regions(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return graph.node_regions(nodes.select("window_id", "node", (F.col("at") % 2 == 1).alias("rev")), nodes)


@query(f"WITH {_GRAPH} SELECT window_id, node, ats = 0 AS \"left\", until = {_SIZE} AS \"right\" FROM nodes")
def graph_dangling_ends(spark: SparkSession, d: str) -> DataFrame:
    nodes = _nodes(spark, d)
    return graph.dangling(nodes, graph.reference_edges(nodes), T.spread(T.table(spark, d, "lineitem")))


@query("""WITH e AS (SELECT o_custkey AS path, o_orderkey AS node, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS step FROM orders)
    SELECT path, string_agg(repeat('ACGT', CAST(node % 3 + 1 AS INT)), '' ORDER BY step) AS seq FROM e GROUP BY path""")
def graph_spelled_paths(spark: SparkSession, d: str) -> DataFrame:
    orders = T.table(spark, d, "orders")
    steps = orders.select(F.lit("w").alias("window_id"), F.col("o_custkey").alias("path"), F.col("o_orderkey").alias("node"), F.lit(False).alias("rev"), F.col("o_orderkey").alias("step"))
    nodes = orders.select(F.lit("w").alias("window_id"), F.col("o_orderkey").alias("node"), F.repeat(F.lit("ACGT"), (F.col("o_orderkey") % 3 + 1).cast("int")).alias("seq"))
    return graph.spelled(steps, nodes, ["path"])


@query("SELECT l_orderkey, l_linenumber FROM lineitem WHERE l_linenumber % 3 <> 0")
def uniquely_mapped(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_linenumber") % 3).alias("mapq"))
    return alignments.uniquely_mapped(rows).select("l_orderkey", "l_linenumber")


@query("SELECT o_orderkey FROM orders WHERE o_totalprice <= 2.5 * 40000")
def reads_of_capped_length(spark: SparkSession, d: str) -> DataFrame:
    return alignments.capped_length(T.table(spark, d, "orders"), F.col("o_totalprice"), 40_000).select("o_orderkey")


@query(f"WITH {T.intervals_sql('l_suppkey')}, w AS (SELECT s_suppkey AS contig, k AS window_id, k * 400 AS w0, k * 400 + 300 AS w1 FROM supplier, range(8) t(k)) SELECT w.contig * 8 + window_id AS window_id, count(record_id) AS n_alignments, CAST(coalesce(sum(CASE WHEN start IS NULL THEN 0 ELSE least(stop, w1) - greatest(start, w0) END), 0) AS BIGINT) AS n_bases FROM w LEFT JOIN iv ON iv.contig = w.contig AND start < w1 AND w0 < stop GROUP BY ALL")
def window_coverage(spark: SparkSession, d: str) -> DataFrame:
    wins = T.table(spark, d, "supplier").select(F.col("s_suppkey").alias("contig"), F.explode(F.sequence(F.lit(0), F.lit(7))).alias("k")).select((F.col("contig") * 8 + F.col("k")).alias("window_id"), "contig", (F.col("k") * 400).alias("win_start"), (F.col("k") * 400 + 300).alias("win_stop"))
    return alignments.window_coverage(T.intervals(spark, d, "l_suppkey"), wins, "contig", "start", "stop", 128)


@query("SELECT l_orderkey * 8 + l_linenumber AS id FROM lineitem WHERE l_returnflag IN ('A', 'R') AND l_quantity >= 20")
def records_on_contigs(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.col("l_returnflag").alias("contig"), (-F.col("l_quantity")).alias("sv_length"), F.lit(1).alias("score"))
    return variants.on_contigs(rows, ["A", "R"], 20, score="score").select("id")


@query("SELECT l_orderkey * 8 + l_linenumber AS id FROM lineitem WHERE l_linenumber % 2 = 0 AND l_discount > 0.05")
def records_by_truth(spark: SparkSession, d: str) -> DataFrame:
    info = F.when(F.col("l_linenumber") % 2 == 0, F.concat(F.lit("A=1;HPRC_MAX="), F.col("l_discount").cast("string"))).otherwise("HPRC=1;X_MAX=1")
    return variants.true_records(T.table(spark, d, "lineitem").select((F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), info.alias("info")), "HPRC", 0.05).select("id")


@query("SELECT o_orderkey FROM orders WHERE o_custkey IN (SELECT c_custkey FROM customer ORDER BY c_custkey LIMIT 40)")
def rows_of_first_samples(spark: SparkSession, d: str) -> DataFrame:
    samples = variants.first_samples(T.table(spark, d, "customer").select(F.col("c_custkey").alias("sample")), 40)
    return variants.of_samples(T.table(spark, d, "orders").withColumnRenamed("o_custkey", "sample"), samples).select("o_orderkey")


@query("SELECT l_suppkey AS tool, l_returnflag AS sv_type, count(*) FILTER (l_quantity > 25) AS supported, count(*) FILTER (l_quantity <= 25) AS unsupported FROM lineitem GROUP BY ALL")
def supported_by_type(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "lineitem").select(F.col("l_suppkey").alias("tool"), F.col("l_returnflag").alias("sv_type"), (F.col("l_quantity") > 25).alias("is_supported"))
    return metrics.supported_by_type(rows, ["tool"])


@query("SELECT l_returnflag AS tool, CAST(floor(least(l_quantity, 40) / 7) AS BIGINT) AS bin, count(*) AS n FROM lineitem GROUP BY ALL")
def length_histogram(spark: SparkSession, d: str) -> DataFrame:
    return metrics.length_histogram(T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("tool"), (-F.col("l_quantity")).alias("len")), ["tool"], "len", 7, 40)


@query("SELECT times, count(*) AS n FROM (SELECT l_partkey, l_suppkey, count(*) AS times FROM lineitem GROUP BY ALL) GROUP BY times")
def caller_multiplicities(spark: SparkSession, d: str) -> DataFrame:
    return metrics.multiplicities(T.table(spark, d, "lineitem"), [], ["l_partkey", "l_suppkey"])


@query("SELECT DISTINCT l_returnflag AS tool, l_suppkey AS contig, CAST(l_quantity AS INT) AS start, CAST(l_quantity AS INT) + 9 AS stop FROM lineitem WHERE l_discount > 0.09")
def anomalous_windows(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "lineitem").select(F.col("l_returnflag").alias("tool"), F.col("l_suppkey").alias("contig"), F.col("l_quantity").cast("int").alias("start"), (F.col("l_quantity").cast("int") + 9).alias("stop"), "l_discount")
    return metrics.anomalous_windows(rows, "tool", F.col("l_discount") > 0.09)


@query(f"WITH {T.intervals_sql()}, {T.ISLANDS_SQL.format(gap=-1, source='iv')} SELECT contig, start, stop, n FROM islands")
def merged_flanked_windows(spark: SparkSession, d: str) -> DataFrame:
    return intervals.merged_strict(T.intervals(spark, d), "contig", "start", "stop").select("contig", "start", "stop", "n")


@query(f"WITH {T.intervals_sql('l_suppkey')} SELECT contig, start, stop, row_number() OVER (PARTITION BY contig ORDER BY start, stop) AS rank FROM iv")
def sorted_intervals(spark: SparkSession, d: str) -> DataFrame:
    return intervals.sorted_intervals(T.intervals(spark, d, "l_suppkey"), "contig", "start", "stop").select("contig", "start", "stop", F.col("rank").cast("long").alias("rank"))


@query(f"WITH {T.intervals_sql()}, {T.ISLANDS_SQL.format(gap=0, source='iv')} SELECT n.contig, min(n.start) AS start, max(n.stop) AS stop, array_to_string(list_sort(list(DISTINCT CAST(record_id % 5 AS VARCHAR))), ',') AS labels FROM numbered n GROUP BY n.contig, n.island")
def interval_components(spark: SparkSession, d: str) -> DataFrame:
    iv = T.intervals(spark, d).withColumn("labels", F.array((F.col("record_id") % 5).cast("string")))
    return intervals.components(iv, "contig", "start", "stop", "labels").select("contig", "start", "stop", F.array_join("labels", ",").alias("labels"))


@query("SELECT p_partkey, CASE p_size % 3 WHEN 0 THEN 'ACGT' WHEN 1 THEN '----' ELSE 'ACGA' END AS ref, CASE p_size % 3 WHEN 0 THEN '||||' WHEN 1 THEN '    ' ELSE '||| ' END AS bars, 'ACGT' AS query FROM part")
def aligned_texts(spark: SparkSession, d: str) -> DataFrame:
    k = F.col("p_size") % 3
    t = S.aligned_texts(F.when(k == 0, "=").when(k == 1, "I").otherwise("M"), F.lit(4), F.when(k == 0, "ACGT").when(k == 1, "").otherwise("ACGA"), F.lit("ACGT"))
    return T.table(spark, d, "part").select("p_partkey", t.alias("t")).select("p_partkey", "t.*")


@query(f"""WITH {T.RECORDS_SQL} SELECT concat_ws(chr(9), contig, pos, id, ref, alt, CASE WHEN qual IS NULL THEN '.' ELSE CAST(CAST(floor(qual) AS BIGINT) AS VARCHAR) END, filter, info, 'GT:GQ', array_to_string(genotypes, chr(9))) AS value FROM rec""")
def vcf_whole_lines(spark: SparkSession, d: str) -> DataFrame:
    return writers.vcf_lines(T.records(spark, d).withColumns({"format": F.lit("GT:GQ"), "qual": F.floor("qual")})).select("value")


@query("SELECT '>' || s_name || chr(10) || repeat('ACGT', CAST(s_suppkey % 5 + 1 AS INT)) AS value FROM supplier")
def fasta_records(spark: SparkSession, d: str) -> DataFrame:
    return writers.fasta_lines(T.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.repeat(F.lit("ACGT"), (F.col("s_suppkey") % 5 + 1).cast("int")).alias("seq")))


@query("SELECT '@' || s_name || CASE WHEN s_nationkey % 2 = 0 THEN ' R' ELSE ' F' END || chr(10) || 'ACG' || chr(10) || '+' || chr(10) || chr(CAST(33 + s_suppkey % 40 AS INT)) || '!I' AS value FROM supplier")
def fastq_records(spark: SparkSession, d: str) -> DataFrame:
    rows = T.table(spark, d, "supplier").select(F.col("s_name").alias("name"), F.lit("ACG").alias("seq"), F.array((F.col("s_suppkey") % 40).cast("int"), F.lit(0), F.lit(40)).alias("quality"), (F.col("s_nationkey") % 2 == 0).alias("is_reverse"))
    return writers.fastq_lines(rows)


@query("SELECT o_orderkey, CAST(floor(o_totalprice * 1000 / 3600000) AS BIGINT) AS h, CAST(floor(o_totalprice * 1000 / 60000) % 60 AS BIGINT) AS m FROM (SELECT o_orderkey, floor(o_totalprice) AS o_totalprice FROM orders)")
def duration_parts(spark: SparkSession, d: str) -> DataFrame:
    return T.table(spark, d, "orders").select("o_orderkey", S.duration_parts(F.floor("o_totalprice") * 1000).alias("t")).select("o_orderkey", F.col("t.h").cast("long").alias("h"), F.col("t.m").cast("long").alias("m"))


_WIN = f"{T.EDGES_SQL}, e AS (SELECT sample // 2 AS win, * FROM edges)"


@query(f"""WITH {_WIN}, h AS (SELECT DISTINCT win, sample, hap FROM e), hp AS (SELECT a.win, a.sample, a.hap AS x, b.hap AS y FROM h a JOIN h b ON a.sample = b.sample AND a.hap <= b.hap),
    pc AS (SELECT win, sample, x, y, count(*) AS n, CAST(sum(w) AS BIGINT) AS cost FROM (SELECT hp.win, hp.sample, x, y, read, min(weight) AS w FROM hp JOIN edges g ON g.sample = hp.sample AND (g.hap = x OR g.hap = y) GROUP BY ALL) GROUP BY ALL),
    al AS (SELECT sample, count(DISTINCT read) AS reads FROM edges GROUP BY ALL), ok AS (SELECT pc.* FROM pc JOIN al USING (sample) WHERE n = reads), k AS (SELECT win, min(sample) AS s, max(sample) AS t FROM ok GROUP BY win),
    two AS (SELECT win, min(a.cost + b.cost + 3 * len(list_distinct([a.x, a.y, b.x, b.y]))) AS v FROM k JOIN ok a USING (win) JOIN ok b USING (win) WHERE s < t AND a.sample = s AND b.sample = t GROUP BY win),
    one AS (SELECT win, min(cost + 3 * len(list_distinct([x, y]))) AS v FROM k JOIN ok USING (win) WHERE s = t GROUP BY win)
    SELECT win, CAST(v AS DOUBLE) AS value FROM (SELECT * FROM two UNION ALL SELECT * FROM one)""")
def joint_objective(spark: SparkSession, d: str) -> DataFrame:
    """The least sum of distances and 3 for each haplotype, over windows of two customers that share brands."""
    edges = T.edges(spark, d).withColumn("win", F.floor(F.col("sample") / 2))
    found = assign.joint(edges, ["win"], 1.0, 3.0, normalise=False).where("status = 'OPTIMAL'")
    haps = assign.used_haps(found, ["win"]).groupBy("win").agg(F.count(F.lit(1)).alias("n"))
    return found.groupBy("win").agg(F.sum("cost").alias("c")).join(haps, "win").select("win", (F.col("c") + 3 * F.col("n")).cast("double").alias("value"))


@query(f"WITH {T.EDGES_SQL} SELECT sample, max(weight) >= 49 AS \"large\" FROM edges GROUP BY sample")
def samples_with_large_weight(spark: SparkSession, d: str) -> DataFrame:
    return bipartite.has_large_weight(T.edges(spark, d), 49)


@query(f"WITH {T.EDGES_SQL}, r AS (SELECT sample, read, dense_rank() OVER (PARTITION BY sample ORDER BY read) AS k FROM edges) SELECT DISTINCT sample, read FROM r WHERE k <= 3")
def capped_reads(spark: SparkSession, d: str) -> DataFrame:
    return assign.capped_reads(T.edges(spark, d), 3).select("sample", "read").distinct()


@query(f"""WITH {T.EDGES_SQL}, n AS (SELECT hap, count(DISTINCT sample) AS n FROM edges GROUP BY ALL) SELECT sample, read, hap, weight FROM edges""")
def retangled_haps(spark: SparkSession, d: str) -> DataFrame:
    return bipartite.retangled(bipartite.detangled(T.edges(spark, d))).select("sample", "read", "hap", "weight")


@query(f"""WITH {T.EDGES_SQL} SELECT DISTINCT sample, read, hap FROM edges""")
def decompressed_samples(spark: SparkSession, d: str) -> DataFrame:
    """Samples merged by their signatures and taken apart again hold what they held."""
    small, moved = bipartite.compressed_samples(T.edges(spark, d), quantum=0.0)
    return bipartite.decompressed_samples(small, moved).distinct()
