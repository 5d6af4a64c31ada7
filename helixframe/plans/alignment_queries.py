"""Queries of alignments on windows and graphs, each with the SQL that a second engine runs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..operators import alignments, metrics
from . import tables as T
from .queries import query

#: A line is a read of q + 5 equal bases, some inserted, two replaced and q + 40 equal ones, backwards on odd line numbers.
_READS = """al AS (SELECT row_number() OVER () AS rn, concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice * 100 AS BIGINT)) AS read, l_partkey AS r_at, CAST(l_quantity AS INT) AS q, l_linenumber AS k, l_linenumber % 2 = 1 AS back FROM lineitem),
    o AS (SELECT rn, read, r_at, back, 2 * q + k + 47 AS total, unnest([0, 1, 2, 3]) AS rank, unnest(['=', 'I', 'X', '=']) AS op, unnest([q + 5, k, 2, q + 40]) AS len FROM al),
    c AS (SELECT *, r_at + coalesce(sum(CASE WHEN op <> 'I' THEN len END) OVER w, 0) AS r0, coalesce(sum(len) OVER w, 0) AS p0 FROM o WINDOW w AS (PARTITION BY rn ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    x AS (SELECT rn, read, back, total, op, r0, r0 + CASE WHEN op = 'I' THEN 0 ELSE len END AS r1, CASE WHEN back THEN total - p0 ELSE p0 END AS q0, CASE WHEN back THEN total - p0 - len ELSE p0 + len END AS q1 FROM c),
    w AS (SELECT k * 90 AS w0, k * 90 + 60 AS w1 FROM range(0, 400) t(k)),
    h AS (SELECT *, greatest(r0, w0) AS a, least(r1, w1) AS b, CASE WHEN back THEN -1 ELSE 1 END AS s FROM x JOIN w ON r0 <= w1 AND w0 <= r1),
    on_w AS (SELECT rn, read, back, total, op, w0, w1, a AS r0, b AS r1, CASE WHEN op = 'I' THEN q0 ELSE q0 + s * (a - r0) END AS q0, CASE WHEN op = 'I' THEN q1 ELSE q1 - s * (r1 - b) END AS q1, s FROM h)"""


def _name() -> F.Column:
    return F.concat_ws(".", "l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", F.round(F.col("l_extendedprice") * 100).cast("long"))


def _reads(spark: SparkSession, d: str) -> DataFrame:
    q, k = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    text = F.concat((q + 5).cast("string"), F.lit("="), k.cast("string"), F.lit("I2X"), (q + 40).cast("string"), F.lit("="))
    return T.table(spark, d, "lineitem").select(_name().alias("read"), F.lit("c").alias("contig"), F.col("l_partkey").cast("int").alias("ref_start"), (k % 2 == 1).alias("is_reverse"), text.alias("cigar"), (2 * q + k + 47).alias("read_length"))


def _on_windows(spark: SparkSession, d: str) -> DataFrame:
    """Operations on windows of 60 bases, every 90."""
    wins = spark.range(400).select(F.lit("c").alias("contig"), (F.col("id") * 90).alias("w0"), (F.col("id") * 90 + 60).alias("w1"))
    return alignments.on_windows(alignments.exploded(_reads(spark, d)), wins, "contig", "w0", "w1", 128)


@query(f"""WITH {_READS}, pt AS (SELECT rn, read, back, w0, w1, unnest([r0, r1, CASE WHEN r0 < w0 + 10 AND w0 + 10 < r1 THEN w0 + 10 END, CASE WHEN r0 < w1 - 10 AND w1 - 10 < r1 THEN w1 - 10 END]) AS r,
        unnest([q0, q1, q0 + s * (w0 + 10 - r0), q0 + s * (w1 - 10 - r0)]) AS q FROM on_w),
    near AS (SELECT rn, w0, min(q) FILTER (r = w0 + 10) AS ll, max(q) FILTER (r = w0 + 10) AS lh, min(q) FILTER (r = w1 - 10) AS rl, max(q) FILTER (r = w1 - 10) AS rh FROM pt WHERE r IS NOT NULL GROUP BY ALL),
    outr AS (SELECT rn, read, w0, w1, any_value(back) AS back, min(least(q0, q1)) AS oq0, max(greatest(q0, q1)) AS oq1, min(r0) AS or0, max(r1) AS or1 FROM on_w WHERE r0 = w0 OR r1 = w1 GROUP BY ALL)
    SELECT read, w0, back AS is_reverse, CAST(oq0 AS BIGINT) AS outer_q0, CAST(oq1 AS BIGINT) AS outer_q1, CAST(CASE WHEN back THEN rl ELSE ll END AS BIGINT) AS inner_q0, CAST(CASE WHEN back THEN lh ELSE rh END AS BIGINT) AS inner_q1
    FROM outr JOIN near USING (rn, w0) WHERE or0 = w0 AND or1 = w1 AND ll IS NOT NULL AND rl IS NOT NULL""")
def flank_coordinates(spark: SparkSession, d: str) -> DataFrame:
    """Outer and inner query coordinates of reads on both strands over windows they span."""
    found = alignments.flank_coordinates(_on_windows(spark, d), ["read", "w0"], "w0", "w1", 10)
    return found.select("read", "w0", "is_reverse", *[F.col(c).cast("long").alias(c) for c in ("outer_q0", "outer_q1", "inner_q0", "inner_q1")])


@query(f"""WITH {_READS}, sp AS (SELECT rn, read, total, w0, w1, min(least(q0, q1)) AS qs, max(greatest(q0, q1)) AS qe, min(r0) AS rs, max(r1) AS re FROM on_w GROUP BY ALL)
    SELECT read, w0, CAST(CASE WHEN rs <> w0 THEN greatest(0, qs - 15) ELSE qs END AS BIGINT) AS q_start, CAST(CASE WHEN re <> w1 THEN least(total, qe + 15) ELSE qe END AS BIGINT) AS q_stop FROM sp""")
def spans_with_clips(spark: SparkSession, d: str) -> DataFrame:
    """Query intervals over windows, widened by 15 bases on sides where a read ends inside."""
    spans = alignments.read_spans(_on_windows(spark, d), ["read", "w0", "w1"], "w0", "w1", spanning=False)
    out = alignments.with_clips(spans, _reads(spark, d), ["read"], "w0", "w1", 15)
    return out.select("read", "w0", F.col("q_start").cast("long").alias("q_start"), F.col("q_stop").cast("long").alias("q_stop"))


#: A line is a graph alignment over a node, another one backwards, and the first again.
_GAF = """al AS (SELECT concat_ws('.', l_orderkey, l_linenumber, l_partkey, l_suppkey, CAST(l_extendedprice * 100 AS BIGINT)) AS aln, l_orderkey AS query, 'p' || l_partkey % 7 AS a, 's' || l_suppkey % 5 AS b, CAST(l_quantity AS INT) AS q, l_linenumber AS k FROM lineitem WHERE l_linenumber % 3 <> 0),
    o AS (SELECT aln, query, q, unnest([0, 1, 2, 3, 4]) AS rank, unnest(['=', 'I', 'X', 'D', '=']) AS op, unnest([q, k, 2, 3, 6]) AS len FROM al),
    c AS (SELECT *, 10 + coalesce(sum(CASE WHEN op <> 'I' THEN len END) OVER w, 0) AS r0, 4 + coalesce(sum(CASE WHEN op <> 'D' THEN len END) OVER w, 0) AS q0 FROM o WINDOW w AS (PARTITION BY aln ORDER BY rank ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
    x AS (SELECT aln, query, op, r0, r0 + CASE WHEN op = 'I' THEN 0 ELSE len END AS r1, q0, q0 + CASE WHEN op = 'D' THEN 0 ELSE len END AS q1 FROM c)"""
_COUNTERS = """CAST(sum(CASE WHEN op = '=' THEN e - s ELSE 0 END) AS BIGINT) AS n_match, CAST(sum(CASE WHEN op = 'X' THEN e - s ELSE 0 END) AS BIGINT) AS n_mismatch,
    CAST(sum(CASE WHEN op = 'I' THEN u1 - u0 ELSE 0 END) AS BIGINT) AS n_insert, CAST(sum(CASE WHEN op = 'D' THEN e - s ELSE 0 END) AS BIGINT) AS n_delete, CAST(min(s) AS BIGINT) AS start, CAST(max(e) AS BIGINT) AS stop"""


def _graph_alignments(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    q, k = F.col("l_quantity").cast("int"), F.col("l_linenumber")
    a, b = F.concat(F.lit("p"), (F.col("l_partkey") % 7).cast("string")), F.concat(F.lit("s"), (F.col("l_suppkey") % 5).cast("string"))
    rows = T.table(spark, d, "lineitem").select(
        _name().alias("aln"), F.col("l_orderkey").alias("query"), F.lit(4).alias("query_start"), S.graph_path(F.concat(F.lit(">"), a, F.lit("<"), b, F.lit(">"), a)).alias("path"), F.lit(10).alias("path_start"),
        F.concat(q.cast("string"), F.lit("="), k.cast("string"), F.lit("I2X3D6=")).alias("cigar"), (k % 3).alias("mapq"),
    )
    nodes = T.table(spark, d, "region").select(F.explode(F.array(*[F.struct(F.lit(f"p{i}").alias("node"), F.repeat(F.lit("A"), 30).alias("seq")) for i in range(7)], *[F.struct(F.lit(f"s{i}").alias("node"), F.repeat(F.lit("C"), 20).alias("seq")) for i in range(5)])).alias("n")).select("n.*").distinct()
    return rows, nodes


def _blocks(found: DataFrame, *keys: str) -> DataFrame:
    return found.select(*keys, *[F.col(c).cast("long").alias(c) for c in ("n_match", "n_mismatch", "n_insert", "n_delete", "start", "stop")])


@query(f"""WITH {_GAF}, st AS (SELECT aln, unnest([0, 1, 2]) AS step, unnest([a, b, a]) AS node, unnest([0, 30, 50]) AS n0, unnest([30, 50, 80]) AS n1 FROM al),
    hit AS (SELECT st.aln, node, step + 1 AS run, op, step = 1 AS rev, n1 - n0 AS size, greatest(r0, n0) - n0 AS b0, least(r1, n1) - n0 AS b1, q0 AS u0, q1 AS u1 FROM x JOIN st USING (aln) WHERE least(r1, n1) > greatest(r0, n0) OR (op = 'I' AND r0 > n0 AND r0 <= n1)),
    t AS (SELECT *, CASE WHEN rev THEN size - b1 ELSE b0 END AS s, CASE WHEN rev THEN size - b0 ELSE b1 END AS e FROM hit)
    SELECT node, aln, CAST(run AS BIGINT) AS run, {_COUNTERS} FROM t GROUP BY node, aln, run""")
def graph_node_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of nodes, two for a node that a path meets twice, those of the middle node in its own direction."""
    return _blocks(alignments.gaf_summaries(*_graph_alignments(spark, d), parts=T.spread(T.table(spark, d, "lineitem")))[0], "node", "aln", "run")


@query(f"""WITH {_GAF}, cut AS (SELECT aln, query, op, CASE WHEN op IN ('=', 'X') THEN r0 + greatest(q0, 3) - q0 ELSE r0 END AS s, CASE WHEN op IN ('=', 'X') THEN r1 - q1 + least(q1, 35) ELSE r1 END AS e, greatest(q0, 3) AS u0, least(q1, 35) AS u1 FROM x WHERE q0 <= 35 AND 3 <= q1)
    SELECT query, aln, {_COUNTERS} FROM cut GROUP BY query, aln""")
def graph_query_blocks(spark: SparkSession, d: str) -> DataFrame:
    """Blocks of queries over the part between their flanks (8 to 30), 5 more on each side."""
    rows, nodes = _graph_alignments(spark, d)
    inner = rows.select("query", F.lit(200).alias("query_len"), F.lit(8).alias("q0"), F.lit(30).alias("q1")).distinct()
    return _blocks(alignments.gaf_summaries(rows, nodes, inner, 5)[1], "query", "aln")


#: An order is a haplotype of its window (64 customers): a walk up or down the nodes 0 to 9, with a detour over node 20 on every fifth.
_TRUTH = """h AS (SELECT o_custkey // 64 AS win, o_orderkey AS hap, o_orderkey % 4 AS a, o_orderkey % 4 + o_custkey % 5 AS z, o_orderkey % 3 = 0 AS down, o_orderkey % 5 = 0 AS off FROM orders),
    l AS (SELECT win, hap, down, off, CASE WHEN off THEN list_concat(range(a, z + 1), [20]) ELSE range(a, z + 1) END AS up FROM h),
    p AS (SELECT win, hap, off, len(up) AS n, array_to_string(list_transform(up, lambda x: '>' || x), '') AS f, array_to_string(list_transform(list_reverse(up), lambda x: '<' || x), '') AS b FROM l),
    w AS (SELECT win, hap, off, n, CASE WHEN f <= b THEN f ELSE b END AS walk FROM p)"""


def _haplotype_walks(spark: SparkSession, d: str) -> DataFrame:
    a = F.col("o_orderkey") % 4
    up = F.sequence(a, a + F.col("o_custkey") % 5)
    nodes = F.when(F.col("o_orderkey") % 5 == 0, F.concat(up, F.array(F.lit(20).cast("long")))).otherwise(up)
    steps = F.transform(nodes, lambda x: F.struct(x.cast("string").alias("node"), F.lit(False).alias("rev")))
    path = F.when(F.col("o_orderkey") % 3 == 0, S.flipped(steps)).otherwise(steps)
    return T.table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 64).alias("win"), F.col("o_orderkey").alias("hap"), path.alias("path"))


def _ref_nodes(walks: DataFrame) -> DataFrame:
    return walks.select("win").distinct().select("win", F.explode(F.sequence(F.lit(0), F.lit(9))).alias("node"))


@query(f"WITH {_TRUTH} SELECT win, arg_min(walk, (-n, walk)) AS reference FROM w WHERE NOT off GROUP BY win")
def reference_walks(spark: SparkSession, d: str) -> DataFrame:
    """The longest monotone walk over reference nodes of each window."""
    walks = _haplotype_walks(spark, d)
    return metrics.reference_walks(walks, _ref_nodes(walks), ["win"])


@query(f"""WITH {_TRUTH}, ref AS (SELECT win, arg_min(walk, (-n, walk)) AS reference FROM w WHERE NOT off GROUP BY win), o AS (SELECT w.* FROM w LEFT JOIN ref USING (win) WHERE reference IS NULL OR walk <> reference),
    den AS (SELECT win, count(DISTINCT walk) AS den FROM o GROUP BY win), g AS (SELECT o_custkey // 64 AS win, o_orderkey AS hap, o_orderpriority AS tool, o_totalprice >= 100000 AS good FROM orders),
    num AS (SELECT g.win, tool, count(DISTINCT walk) AS num FROM g JOIN o ON o.win = g.win AND o.hap = g.hap WHERE good GROUP BY ALL)
    SELECT DISTINCT g.win, g.tool, coalesce(num, 0) AS num, coalesce(den, 0) AS den FROM g LEFT JOIN den USING (win) LEFT JOIN num USING (win, tool)""")
def haplotype_recall(spark: SparkSession, d: str) -> DataFrame:
    walks = _haplotype_walks(spark, d)
    price = F.when(F.col("o_totalprice") >= 100000, 0.95).otherwise(0.5)
    haps = T.table(spark, d, "orders").select(F.floor(F.col("o_custkey") / 64).alias("win"), F.col("o_orderpriority").alias("tool"), F.col("o_orderkey").alias("hap"), price.alias("coverage"), F.lit(0.99).alias("identity"))
    return metrics.haplotype_recall(walks, _ref_nodes(walks), haps, ["win"])


@query(f"""WITH {_GAF}, st AS (SELECT aln, unnest([0, 1, 2]) AS step, unnest([a, b, a]) AS node, unnest([0, 30, 50]) AS n0, unnest([30, 50, 80]) AS n1 FROM al),
    hit AS (SELECT st.aln, node, step, op, step = 1 AS rev, n1 - n0 AS size, greatest(r0, n0) - n0 AS b0, least(r1, n1) - n0 AS b1, q0 AS u0, q1 AS u1 FROM x JOIN st USING (aln) WHERE least(r1, n1) > greatest(r0, n0) OR (op = 'I' AND r0 > n0 AND r0 <= n1)),
    t AS (SELECT *, CASE WHEN rev THEN size - b1 ELSE b0 END AS s, CASE WHEN rev THEN size - b0 ELSE b1 END AS e FROM hit),
    blk AS (SELECT node, aln, step, any_value(size) AS size, {_COUNTERS} FROM t GROUP BY node, aln, step),
    gap AS (SELECT *, greatest(0, start - coalesce(max(stop) OVER (PARTITION BY node ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)) AS g FROM blk),
    every AS (SELECT 'p' || i AS node FROM range(7) t(i) UNION ALL SELECT 's' || i FROM range(5) t(i)),
    f AS (SELECT node, (max(stop) - sum(g)) / any_value(size) AS coverage, sum(n_match) / sum(n_match + n_mismatch + n_insert + n_delete) AS identity FROM gap GROUP BY node)
    SELECT node, round(coalesce(coverage, 0), 9) AS coverage, round(coalesce(identity, 0), 9) AS identity FROM every LEFT JOIN f USING (node)""")
def evaluated_nodes(spark: SparkSession, d: str) -> DataFrame:
    """Coverage and identity of all nodes from the blocks of graph alignments."""
    from . import workflows

    rows, nodes = _graph_alignments(spark, d)
    blocks = alignments.gaf_summaries(rows, nodes, parts=T.spread(T.table(spark, d, "lineitem")))[0].select(F.lit("w").alias("window_id"), "node", F.col("start").alias("b0"), F.col("stop").alias("b1"), "n_match", "n_mismatch", "n_insert", "n_delete")
    found = workflows.evaluate(blocks, nodes.select(F.lit("w").alias("window_id"), "node", "seq"))
    return found.select("node", F.round("coverage", 9).alias("coverage"), F.round("identity", 9).alias("identity"))


@query("""WITH h AS (SELECT o_orderpriority AS tool, o_custkey // 64 AS window_id, CASE WHEN o_orderstatus = 'F' THEN 1 ELSE 0 END AS is_ref, (o_orderkey % 101) / 100.0 AS coverage, (o_custkey % 51) / 50.0 AS identity FROM orders),
    s AS (SELECT 'all_windows' AS stratum, * FROM h UNION ALL SELECT 'even', * FROM h WHERE window_id % 2 = 0 UNION ALL SELECT 'fourth', * FROM h WHERE window_id % 4 = 0)
    SELECT stratum, tool, round(avg(coverage), 6) AS coverage, round(avg(identity), 6) AS identity, round(coalesce(avg(coverage) FILTER (is_ref = 0), -1), 6) AS nonref_coverage, round(coalesce(avg(identity) FILTER (is_ref = 0), -1), 6) AS nonref_identity FROM s GROUP BY ALL""")
def analyzed_haplotypes(spark: SparkSession, d: str) -> DataFrame:
    """Means by tool, over all windows and over two strata of them."""
    from . import workflows

    win = F.floor(F.col("o_custkey") / 64)
    haps = T.table(spark, d, "orders").select(F.col("o_orderpriority").alias("tool"), win.alias("window_id"), F.when(F.col("o_orderstatus") == "F", 1).otherwise(0).alias("is_ref"), (F.col("o_orderkey") % 101 / 100).alias("coverage"), (F.col("o_custkey") % 51 / 50).alias("identity"))
    strata = haps.select("window_id").distinct().select("window_id", F.explode(F.filter(F.array(F.when(F.col("window_id") % 2 == 0, "even"), F.when(F.col("window_id") % 4 == 0, "fourth")), lambda x: x.isNotNull())).alias("stratum"))
    out = workflows.analyze(haps, strata)
    return out.select("stratum", "tool", *[F.round(c, 6).alias(c) for c in ("coverage", "identity", "nonref_coverage", "nonref_identity")])
