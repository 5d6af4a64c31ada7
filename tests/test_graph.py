from __future__ import annotations

from helixframe.operators import graph
from pyspark.sql import functions as F

from .conftest import TESTDATA


def test_flanks_jump_over_repeats(spark):
    spans = spark.createDataFrame([("w", 0, 100)], "w string, lo int, hi int")
    tandems = spark.createDataFrame([("w", 20, 40), ("w", 30, 45), ("w", 60, 70)], "w string, t0 int, t1 int")
    free = graph.free_segments(spans, tandems, ["w"])
    assert [(r.start, r.stop, r.before) for r in free.orderBy("start").collect()] == [(0, 20, 0), (45, 60, 20), (70, 100, 35)]
    points = spark.createDataFrame([("w", 50), ("w", 75), ("w", 3), ("w", 98)], "w string, at int")
    got = {r["at"]: (r.left, r.right) for r in graph.tandem_aware_flanks(points, free, ["w"], 10).collect()}
    assert got == {50: (15, 60), 75: (55, 85), 3: (None, 13), 98: (88, None)}


def _placed(spark):
    rows = [("w", "p", k, n, r, a, b) for k, (n, r, a, b) in enumerate([("r0", False, 0, 10), ("ins", False, 10, 13), ("r10", False, 13, 33), ("r30", False, 33, 40)])]
    return spark.createDataFrame(rows, "window_id string, hap string, step int, node string, rev boolean, n0 int, n1 int")


def test_records_on_paths(spark):
    placed, by = _placed(spark), ["window_id", "hap"]
    paths = graph.path_edges(placed, by)
    records = paths.where("place < 2").select("window_id", F.lit("i").alias("record"), F.col("place").alias("rank"), "edge")
    assert [(r.record, r.p0, r.p1) for r in graph.record_spans(paths, records, placed, by, 4).collect()] == [("i", 6, 17)]


def test_repeats_on_paths(spark):
    ref = spark.createDataFrame([("w", "r0", 0, 10), ("w", "r10", 10, 30), ("w", "r30", 30, 37)], "window_id string, node string, at int, until int")
    tandems = spark.createDataFrame([("w", 5, 10), ("w", 25, 32)], "window_id string, t0 int, t1 int")
    got = sorted((r.t0, r.t1) for r in graph.path_tandems(_placed(spark), ref, tandems, ["window_id", "hap"]).collect())
    assert got == [(5, 10), (10, 13), (28, 33), (33, 35)]


def test_ends_and_walks(spark):
    edge = lambda a, b: (a, False, b, False)
    edges = spark.createDataFrame([("w", edge(*e)) for e in [("s", "a"), ("s", "b"), ("a", "t"), ("b", "t")]], "window_id string, edge struct<a:string,a_rev:boolean,b:string,b_rev:boolean>")
    nodes = spark.createDataFrame([("w", n, n.upper()) for n in "sabt"], "window_id string, node string, seq string")
    ends = graph.dangling(nodes, edges)
    assert {(r.node, r.left, r.right) for r in ends.collect()} == {("s", True, False), ("a", False, False), ("b", False, False), ("t", False, True)}
    walks = graph.walks(edges, ends.where("left").select("window_id", "node")).collect()
    assert sorted("".join(s.node for s in r.path) for r in walks) == ["sat", "sbt"]


def test_walks_of_many_steps_are_kept(spark):
    names = ["s", *(f"n{k:02d}" for k in range(68)), "t"]
    edges = spark.createDataFrame([("w", (a, False, b, False)) for a, b in zip(names, names[1:])], "window_id string, edge struct<a:string,a_rev:boolean,b:string,b_rev:boolean>")
    sources = spark.createDataFrame([("w", "s")], "window_id string, node string")
    assert [[s.node for s in r.path] for r in graph.walks(edges, sources).collect()] == [names]


def _breakends(spark):
    """A window of 1,000 bases on chr1, breakends to another contig, within the window, and within it with bases between."""
    windows = spark.createDataFrame([("w", 0, 1000, "ACGT" * 250)], "window_id string, start int, stop int, seq string")
    rows = [("far", "A[chr2:700["), ("near", "A[chr1:700["), ("over", "ATTG[CHR1:500["), ("back", "[chr1:300[CA")]
    records = spark.createDataFrame([("w", n, "chr1", 100, alt, 5, 100, None, None) for n, alt in rows], "window_id string, record string, contig string, pos int, alt string, sv_type int, first int, second int, sv_length int")
    return windows, records


def test_breakends_of_other_contigs_join_nothing_here(spark):
    windows, records = _breakends(spark)
    far = records.where("record = 'far'")
    assert sorted(r["at"] for r in graph.breakpoints(far, windows).collect()) == [0, 100, 1000]
    ref = graph.reference_nodes(graph.breakpoints(far, windows), windows)
    assert graph.breakend_edges(far, ref, graph.breakend_nodes(far)).collect() == []


def test_breakends_of_the_window_with_and_without_bases(spark):
    windows, records = _breakends(spark)
    ref = graph.reference_nodes(graph.breakpoints(records, windows), windows)
    assert sorted(r["at"] for r in ref.collect()) == [0, 99, 100, 299, 499, 699]
    inserted = graph.breakend_nodes(records)
    assert {r.record: r.seq for r in inserted.collect()} == {"over": "TTG", "back": "G"}
    names = {r.record: r.node for r in inserted.collect()}
    found = {}
    for r in graph.breakend_edges(records, ref, inserted).orderBy("record", "rank").collect():
        found.setdefault(r.record, []).append((r.edge.a, r.edge.a_rev, r.edge.b, r.edge.b_rev))
    both = lambda a, ar, b, br: [(a, ar, b, br), (b, not br, a, not ar)]
    assert set(found) == {"near", "over", "back"} and found["near"][0] in both("r99", False, "r699", False)
    assert found["over"][0] in both("r99", False, names["over"], False) and found["over"][1] in both(names["over"], False, "r499", False)
    assert found["back"][0] in both("r99", True, names["back"], False) and found["back"][1] in both(names["back"], False, "r299", False)


def test_paths_are_replacements_and_breakends(spark):
    """Deletion, insertion, replacement, both directions, duplication, inversion, other contigs, single breakends."""
    seq = "ACGTTGCAAC" + "GGATCCATGA" + "TTACGACCTG"
    windows = spark.createDataFrame([("w", 0, seq), ("v", 100, "CCCCCAAAAA")], "window_id string, start int, seq string")
    ref = spark.createDataFrame([("w", "r0", "c", 0, 10), ("w", "r10", "c", 10, 20), ("w", "r20", "c", 20, 30), ("w", "d5", "d", 5, 9)], "window_id string, node string, contig string, at int, until int")
    bases = {"r0": seq[:10], "r10": seq[10:20], "r20": seq[20:], "i": "AAC", "j": "G", "d5": "ACGT"}
    nodes = spark.createDataFrame([("w", n, s) for n, s in bases.items()], "window_id string, node string, seq string")
    paths = {"del": ">r0>r20", "ins": ">r0>i>r10", "rep": ">r0>i<j>r20", "back": "<r20<i<r0", "dup": ">r10>r10", "inv1": ">r0<r10", "inv2": "<r10>r20", "far": ">r0>i>d5", "far2": "<r10<i<d5", "out": ">r0>i>j", "out2": "<r10>i", "in": ">i>j>r10", "in2": ">i<r10", "off": ">i>j"}
    rows = [("w", p, k, s[1:], s[0] == "<") for p, text in paths.items() for k, s in enumerate(__import__("re").findall("[<>][^<>]+", text))]
    steps = spark.createDataFrame(rows, "window_id string, hap string, step int, node string, rev boolean")
    found = {r.hap: (r.contig, r.pos, r.ref, r.alt, r.kind) for r in graph.path_records(steps, nodes, ref, windows, ["window_id", "hap"]).collect()}
    assert found == {
        "del": ("c", 10, "C" + seq[10:20], "C", "replacement"),
        "ins": ("c", 10, "C", "CAAC", "replacement"),
        "rep": ("c", 10, "C" + seq[10:20], "CAACC", "replacement"),
        "back": ("c", 10, "C" + seq[10:20], "CAAC", "replacement"),
        "dup": ("c", 20, "A", "A[c:11[", "breakend"),
        "inv1": ("c", 10, "C", "C]c:20]", "breakend"),
        "inv2": ("c", 11, "G", "[c:21[G", "breakend"),
        "far": ("c", 10, "C", "CAAC[d:6[", "breakend"),
        "far2": ("c", 11, "G", "]d:9]AACG", "breakend"),
        "out": ("c", 10, "C", "CAACG.", "single"),
        "out2": ("c", 11, "G", ".GTTG", "single"),
        "in": ("c", 11, "G", ".AACGG", "single"),
        "in2": ("c", 20, "A", "AGTT.", "single"),
    }


def test_records_that_no_path_supports(spark):
    placed, by = _placed(spark), ["window_id", "hap"]
    paths = graph.path_edges(placed, by)
    has = paths.where("place < 2").select("window_id", F.lit("yes").alias("record"), F.col("place").alias("rank"), "edge")
    lacks = has.unionAll(has.select("window_id", F.lit("no").alias("record"), F.lit(5).alias("rank"), F.col("edge").withField("a", F.lit("z")).alias("edge")))
    assert [(r.window_id, r.record) for r in graph.unsupported_records(paths, lacks, by).collect()] == [("w", "no")]


def test_long_reference_nodes_are_split_at_flanks(spark):
    windows = spark.createDataFrame([("w", 0, 100, "ACGTT" * 20)], "window_id string, start int, stop int, seq string")
    points = spark.createDataFrame([("w", x) for x in (0, 20, 80, 100)], "window_id string, at int")
    free = graph.free_segments(spark.createDataFrame([("w", 0, 100)], "window_id string, lo int, hi int"), spark.createDataFrame([("w", 22, 30)], "window_id string, t0 int, t1 int"), ["window_id"])
    flanks = graph.tandem_aware_flanks(points, free, ["window_id"], 10)
    nodes = graph.reference_nodes(points, windows, 40, flanks)
    assert [(r["at"], r.until, r.seq) for r in nodes.orderBy("at").collect()] == [(a, b, ("ACGTT" * 20)[a:b]) for a, b in ((0, 20), (20, 38), (70, 80), (80, 100))]
    assert {(r.edge.a, r.edge.b) for r in graph.reference_edges(nodes).collect()} == {("r0", "r20"), ("r70", "r80")}
    assert graph.reference_nodes(points, windows, 60, flanks).count() == 4 and graph.reference_nodes(points, windows, 61, flanks).count() == 3


def test_signatures_equal_enumeration(spark):
    bases = {"s": "AC", "a": "G", "b": "G", "t": "TT"}
    pairs = [("s", False, "a", False), ("s", False, "b", False), ("a", False, "t", False), ("b", False, "t", True)]
    nodes = spark.createDataFrame([("w", n, x) for n, x in bases.items()], "window_id string, node string, seq string")
    edges = spark.createDataFrame([("w", e) for e in pairs], "window_id string, edge struct<a:string,a_rev:boolean,b:string,b_rev:boolean>")
    after = {}
    for a, ar, b, br in pairs:
        after.setdefault((a, ar), []).append((b, br))
        after.setdefault((b, not br), []).append((a, not ar))
    spell = lambda n, rev: bases[n].translate(str.maketrans("ACGT", "TGCA"))[::-1] if rev else bases[n]

    def strings(at, left):
        if not left or not after.get(at):
            return [spell(*at)]
        return [spell(*at) + x for to in after[at] for x in strings(to, left - 1)]

    for k in (0, 1, 2, 3):
        want = sorted("".join(x + "," for x in sorted(strings((n, False), k) + strings((n, True), k))) for n in bases)
        assert [r.signature for r in graph.spelled_signatures(nodes, edges, k).collect()] == [want]


def test_records_meet_their_nodes_and_paths_in_few_joins(spark):
    """Each join of rows that carry a record's name is a shuffle of them all."""
    threshold = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        ref = spark.createDataFrame([("w", "r0", 0, 5), ("w", "r5", 5, 9), ("w", "r9", 9, 12)], "window_id string, node string, at int, until int")
        records = spark.createDataFrame([("w", "d", 5, 9, 4, 2)], "window_id string, record string, first int, second int, sv_length int, sv_type int")
        alt = spark.createDataFrame([], "window_id string, record string, node string")
        edges = graph.record_edges(records, ref, alt)
        assert [(r.record, r.edge.a, r.edge.b) for r in edges.collect()] == [("d", "r0", "r9")]
        joins = lambda df: df._jdf.queryExecution().optimizedPlan().toString().count("Join ")
        assert joins(edges) <= 3
        placed = spark.createDataFrame([("w", "p", 0, "r0", False, 0, 5), ("w", "p", 1, "r9", False, 5, 8)], "window_id string, path string, step int, node string, rev boolean, n0 int, n1 int").withColumn("size", F.lit(8))
        by = ["window_id", "path"]
        named = spark.createDataFrame([("w", "d", 0, ("r0", False, "r9", False))], "window_id string, record string, rank int, edge struct<a:string,a_rev:boolean,b:string,b_rev:boolean>")
        spans = graph.record_spans(graph.path_edges(placed, by, ["n1", "size"]), named, None, by, 2)
        assert [tuple(r) for r in spans.collect()] == [("w", "p", "d", 3, 7)]
        assert joins(spans) <= 1
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", threshold)


def test_span_counters_are_those_of_joined_operations(spark):
    from helixframe.functions import sequences as S
    from helixframe.operators import alignments

    rows = spark.createDataFrame([("3=2X4=1I2D5=", 0, 2, 10), ("4=", 0, 4, 9), ("4=2I", 0, 4, 4), ("4=", 0, 6, 9)], "cigar string, at int, p0 int, p1 int")
    got = rows.select("p0", "p1", alignments.span_counters(S.cigar("cigar"), "at", "p0", "p1").alias("c")).select("p0", "p1", "c.*")
    assert [tuple(r) for r in got.collect()] == [(2, 10, 5, 5, 4), (4, 9, 1, 0, 0), (4, 4, 2, 0, 2), (6, 9, 0, 0, 0)]


def test_points_stay_dealt_by_window(spark):
    """With a number of partitions, points, nodes and dangling ends equal those without, in partitions that are not merged."""
    windows = spark.range(40).select(F.col("id").alias("window_id"), F.lit(0).alias("start"), F.lit(100).alias("stop"), F.repeat(F.lit("ACGTA"), 20).alias("seq"))
    records = spark.range(400).select((F.col("id") % 40).alias("window_id"), (F.col("id") % 37 + 1).cast("int").alias("first"), (F.col("id") % 53 + 40).cast("int").alias("second"))
    plain = graph.reference_nodes(graph.breakpoints(records, windows), windows)
    points = graph.breakpoints(records, windows, 7)
    assert points.rdd.getNumPartitions() == 7
    nodes = graph.reference_nodes(points, windows)
    found, want = graph.dangling(nodes, graph.reference_edges(nodes), 7), graph.dangling(plain, graph.reference_edges(plain))
    assert sorted(map(tuple, nodes.collect())) == sorted(map(tuple, plain.collect()))
    assert sorted(map(tuple, found.collect())) == sorted(map(tuple, want.collect()))


def test_path_records_are_dealt_by_window_once(spark):
    """Each look-up of a node used to shuffle all paths, by window and node, and back by path."""
    import re

    from helixframe.plans import graph_queries

    plan = graph_queries.graph_path_records(spark, TESTDATA)._jdf.queryExecution().executedPlan().toString()
    assert {re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)} == {"window_id"}


def test_look_ups_are_left_joins(spark):
    rows = spark.createDataFrame([("w", 1, "x"), ("w", 1, "y"), ("w", 2, "z"), ("v", 1, "x"), ("w", None, "n")], "window_id string, at int, record string")
    table = spark.createDataFrame([("w", 1, "r1"), ("w", 3, "r3"), ("u", 2, "r2")], "window_id string, at int, node string")
    found = graph.looked_up(rows, table, ["window_id", "at"], ["node"])
    want = rows.join(table, ["window_id", "at"], "left")
    assert sorted(map(str, found.select(*want.columns).collect())) == sorted(map(str, want.collect()))


def test_records_of_long_paths(spark):
    """Steps off the reference in order, also of a path with one reference end, and a path of reference nodes only."""
    nodes = spark.createDataFrame([("w", n, s) for n, s in (("r0", "AC"), ("r2", "GT"), ("r4", "CC"), ("x", "TTG"), ("y", "AAC"))], "window_id string, node string, seq string")
    ref = spark.createDataFrame([("w", "r0", "c", 0, 2), ("w", "r2", "c", 2, 4), ("w", "r4", "c", 4, 6)], "window_id string, node string, contig string, at int, until int")
    windows = spark.createDataFrame([("w", 0, "ACGTCC")], "window_id string, start int, seq string")
    paths = {"two": ("r0", "x", "y", "r4"), "one": ("x", "y", "r4"), "plain": ("r0", "r4"), "none": ("x", "y")}
    steps = spark.createDataFrame([("w", h, k, n, False) for h, p in paths.items() for k, n in enumerate(p)], "window_id string, hap string, step int, node string, rev boolean")
    found = {r.hap: (r.pos, r.ref, r.alt, r.kind) for r in graph.path_records(steps, nodes, ref, windows, ["window_id", "hap"]).collect()}
    assert found == {"two": (2, "CGT", "CTTGAAC", "replacement"), "one": (5, "C", ".TTGAACC", "single"), "plain": (2, "CGT", "C", "replacement")}
