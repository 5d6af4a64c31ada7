"""Variation graphs of windows as node, edge and record tables.

Every table carries ``window_id``, so windows are built, joined and aggregated
together; nothing is a per-window object on the driver.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences as S
from ..functions import vcf as V
from ..functions.vcf import TYPES
from ..staging import staged


def breakend_cuts(records: DataFrame) -> DataFrame:
    """Paired breakends with ``cut`` and ``far``, where the reference is cut on either side, and ``left`` and ``far_left``.

    ``left`` says that the record's side joins by what lies left of its cut (a
    node's right end), ``far_left`` the same of the mate.  Of two records
    that name each other only the first by identifier stays, if ``mate`` is a column.
    If ``contig`` is one, ``far`` is null where the mate lies on another contig.
    """
    r = records.where((F.col("sv_type") == TYPES["BND"]) & ~V.is_single_breakend("alt") & V.is_valid_breakend("alt"))
    if "mate" in records.columns:
        r = r.where(F.col("mate").isNull() | (F.col("record") < F.col("mate")))
    left, far_left = V.orientation("alt") == 1, V.mate_orientation("alt") == 1
    cut = lambda at, is_left: F.when(is_left, at).otherwise(at - 1)
    far = cut(V.mate_pos("alt"), far_left)
    if "contig" in records.columns:
        far = F.when(V.mate_contig("alt") == F.col("contig"), far)
    return r.withColumns({"left": left, "far_left": far_left, "cut": cut(F.col("pos"), left), "far": far, "bases": F.upper(F.coalesce(V.inserted_sequence("alt"), F.lit("")))})


def breakpoints(records: DataFrame, windows: DataFrame, parts: int | None = None) -> DataFrame:
    """(window_id, at): window ends and both coordinates of every record in it, of breakends both sides, distinct.

    Breakends count if ``records`` has pos and alt; mates outside the window are left out.
    With ``parts`` points are dealt by window in so many partitions, which adaptive execution
    leaves alone and the steps along a window keep: by compressed bytes it would put tens of millions in one.
    """
    own = windows.select("window_id", F.explode(F.array("start", "stop")).alias("at"))
    other = records.where(F.col("sv_type") != TYPES["BND"]) if "sv_type" in records.columns else records
    of = other.select("window_id", F.explode(F.array("first", "second")).alias("at"))
    if {"sv_type", "pos", "alt"} <= set(records.columns):
        of = of.unionAll(breakend_cuts(records).select("window_id", F.explode(F.array("cut", "far")).alias("at")))
    inside = of.join(windows.select("window_id", "start", "stop"), "window_id").where("at > start and at < stop").select("window_id", "at")
    points = own.unionAll(inside)
    return (points if parts is None else points.repartition(parts, "window_id")).distinct()


def reference_nodes(points: DataFrame, windows: DataFrame, interior_flank_length: int | None = None, flanks: DataFrame | None = None) -> DataFrame:
    """(window_id, node, at, until, seq): the reference between neighbouring breakpoints; nodes are named r<start>.

    ``windows`` carries ``seq``, the window's own bases.  With ``interior_flank_length`` a
    span of so many bases or more is only kept up to the flanks of its two
    breakpoints, ``flanks`` (window_id, at, left, right; see ``tandem_aware_flanks``),
    where these do not meet: two nodes that no edge joins.
    """
    w = Window.partitionBy("window_id").orderBy("at")
    spans = points.withColumn("until", F.lead("at").over(w)).where("until is not null")
    if interior_flank_length is not None and flanks is not None:
        right = flanks.select("window_id", "at", F.col("right").alias("_p"))
        left = flanks.select("window_id", F.col("at").alias("until"), F.col("left").alias("_q"))
        both = spans.join(right, ["window_id", "at"], "left").join(left, ["window_id", "until"], "left")
        cut = (F.col("until") - F.col("at") >= interior_flank_length) & (F.col("_p") <= F.col("_q"))
        part = lambda a, z: F.struct(F.col(a).cast("int").alias("at"), F.col(z).cast("int").alias("until"))
        spans = both.select("window_id", F.explode(F.when(cut, F.array(part("at", "_p"), part("_q", "until"))).otherwise(F.array(part("at", "until")))).alias("s")).select("window_id", "s.at", "s.until")
    spans = spans.join(windows.select("window_id", "start", "seq"), "window_id")
    return spans.select("window_id", F.concat(F.lit("r"), F.col("at").cast("string")).alias("node"), "at", "until", F.substr(F.col("seq"), F.col("at") - F.col("start") + 1, F.col("until") - F.col("at")).alias("seq"))


def trivial_nodes(windows: DataFrame, flank_length: int) -> DataFrame:
    """(window_id, node, at, until, seq) of windows without records: the flanks and what lies between them, if anything does."""
    inner = F.array("start", F.col("start") + flank_length, F.col("stop") - flank_length, "stop")
    points = windows.select("window_id", F.explode(F.array_distinct(inner)).alias("at"))
    return reference_nodes(points, windows)


def alternative_nodes(records: DataFrame, acyclic: bool = False) -> DataFrame:
    """(window_id, node, seq, record): inserted and replaced sequence, equal ones at one place once; copies in acyclic graphs get ``copy_of``."""
    kind = F.col("sv_type")
    spelled = F.when(kind == TYPES["INS"], F.substr(F.col("alt"), F.lit(2))).when(kind.isin(TYPES["SNP"], TYPES["REPLACEMENT"]), F.col("alt"))
    out = records.where(~F.col("alt").rlike("^<")).withColumn("seq", F.upper(spelled)).where("seq is not null and seq != ''")
    name = F.concat(F.lit("a"), F.col("first").cast("string"), F.lit("_"), F.col("second").cast("string"), F.lit("_"), F.sha1("seq"))
    nodes = out.select("window_id", name.alias("node"), "seq", "record", F.lit(None).cast("string").alias("copy_of"))
    if acyclic:
        span = F.concat(F.col("first").cast("string"), F.lit("_"), F.col("second").cast("string"))
        copy = records.where(kind.isin(TYPES["DUP"], TYPES["CNV"], TYPES["INV"]))
        nodes = nodes.unionAll(copy.select("window_id", F.concat(F.when(kind == TYPES["INV"], "i").otherwise("d"), span).alias("node"), F.lit(None).cast("string").alias("seq"), "record", span.alias("copy_of")))
    return nodes


def _edge(a: Column, a_rev: bool, b: Column, b_rev: bool) -> Column:
    return S.canonical_edge(a, F.lit(a_rev), b, F.lit(b_rev))


def reference_edges(nodes: DataFrame) -> DataFrame:
    """(window_id, edge) between reference nodes that touch."""
    w = Window.partitionBy("window_id").orderBy("at")
    return nodes.withColumn("nxt", F.lead("node").over(w)).withColumn("_to", F.lead("at").over(w)).where("nxt is not null and _to = until").select("window_id", _edge(F.col("node"), False, F.col("nxt"), False).alias("edge"))


def looked_up(rows: DataFrame, table: DataFrame, keys: list[str], values: list[str]) -> DataFrame:
    """``rows`` with ``values`` of the row of ``table`` that has their ``keys`` (at most one does); null where there is none.

    A running maximum over both tables, not a join: where both are dealt by some of the keys (a window) in as
    many partitions, nothing is shuffled, while a join would deal both again by all of its keys.
    """
    own = Window.partitionBy(*keys).orderBy("_own").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    both = rows.withColumn("_own", F.lit(1)).unionByName(table.select(*keys, *values).withColumn("_own", F.lit(0)), allowMissingColumns=True)
    return both.withColumns({v: F.max(v).over(own) for v in values}).where("_own = 1").drop("_own")


def _borders(ref: DataFrame, at: str, start: str, end: str) -> DataFrame:
    """(window_id, at, start, end): the reference nodes that start and end at each place, so that one join looks up both."""
    sides = F.array(F.struct(F.col("at").alias("x"), F.col("node").alias("s"), F.lit(None).cast("string").alias("e")), F.struct(F.col("until").alias("x"), F.lit(None).cast("string").alias("s"), F.col("node").alias("e")))
    each = ref.select("window_id", F.explode(sides).alias("_b"))
    return each.groupBy("window_id", F.col("_b.x").alias(at)).agg(F.max("_b.s").alias(start), F.max("_b.e").alias(end))


def record_edges(records: DataFrame, ref: DataFrame, alt: DataFrame | None, min_length: int = 0, acyclic: bool = False) -> DataFrame:
    """(window_id, record, rank, edge) by the recipe of each type; records shorter than ``min_length`` get none.

    Without ``alt`` no record has bases of its own.
    ``s`` and ``t`` are the reference nodes that start at the first and second
    coordinate, ``p`` and ``u`` those that end there.
    """
    r = records.where(F.coalesce("sv_length", F.lit(0)) >= min_length)
    for at, names in (("first", ["s", "p"]), ("second", ["t", "u"])):
        r = looked_up(r, _borders(ref, at, *names), ["window_id", at], names)
    r = r.withColumn("v", F.lit(None).cast("string")) if alt is None else r.join(alt.select("window_id", "record", F.col("node").alias("v")), ["window_id", "record"], "left")
    s, t, p, u, v, kind = (F.col(x) for x in ("s", "t", "p", "u", "v", "sv_type"))
    through = F.array(_edge(p, False, v, False), _edge(v, False, t, False))
    copy = F.array(_edge(p, False, v, False), _edge(v, False, s, False))
    recipe = (
        F.when(kind == TYPES["DEL"], F.array(_edge(p, False, t, False)))
        .when(kind.isin(TYPES["DUP"], TYPES["CNV"]), copy if acyclic else F.array(_edge(u, False, s, False)))
        .when(kind == TYPES["INV"], through if acyclic else F.array(_edge(p, False, u, True), _edge(s, True, t, False)))
        .when(kind == TYPES["INS"], F.array(_edge(p, False, v, False), _edge(v, False, s, False)))
        .when(kind.isin(TYPES["SNP"], TYPES["REPLACEMENT"]), through)
    )
    each = r.select("window_id", "record", F.posexplode(recipe).alias("rank", "edge"))
    return each.where("edge.a is not null and edge.b is not null")


def breakend_nodes(records: DataFrame) -> DataFrame:
    """(window_id, node, seq, record): the bases that breakends insert, read from the record's side to the mate's."""
    r = breakend_cuts(records).where("bases != ''")
    seq = F.when(F.col("left"), F.col("bases")).otherwise(S.reverse_complement("bases"))
    return r.withColumn("seq", seq).select("window_id", F.concat(F.lit("b"), F.col("cut").cast("string"), F.lit("_"), F.col("far").cast("string"), F.lit("_"), F.sha1("seq")).alias("node"), "seq", "record")


def breakend_edges(records: DataFrame, ref: DataFrame, inserted: DataFrame | None = None) -> DataFrame:
    """(window_id, record, rank, edge): one edge of a breakend, two through its inserted bases.

    The record's side leaves its node by the right end if it joins by what is
    left of its cut, else by the left end; the mate's node is entered likewise.
    A breakend whose mate's cut is no node border of the window has none.
    """
    r = breakend_cuts(records).select("window_id", "record", "cut", "far", "left", "far_left", "bases")
    for at, names in (("cut", ["s", "p"]), ("far", ["t", "u"])):
        r = looked_up(r, _borders(ref, at, *names), ["window_id", at], names)
    own, mate = F.when(F.col("left"), F.col("p")).otherwise(F.col("s")), F.when(F.col("far_left"), F.col("u")).otherwise(F.col("t"))
    # a step that ends at a left end is walked backwards
    direct = S.canonical_edge(own, ~F.col("left"), mate, F.col("far_left"))
    recipe = F.when(F.col("bases") == "", F.array(direct))
    if inserted is not None:
        r = r.join(inserted.select("window_id", "record", F.col("node").alias("v")), ["window_id", "record"], "left")
        through = F.array(S.canonical_edge(own, ~F.col("left"), F.col("v"), F.lit(False)), S.canonical_edge(F.col("v"), F.lit(False), mate, F.col("far_left")))
        recipe = recipe.otherwise(F.when(F.col("v").isNotNull(), through))
    return r.select("window_id", "record", F.posexplode(recipe).alias("rank", "edge")).where("edge.a is not null and edge.b is not null")


def node_regions(steps: DataFrame, ref: DataFrame) -> DataFrame:
    """Steps (window_id, node, rev) with ``r_start`` and ``r_stop`` on the reference, swapped where walked backwards; null off the reference."""
    j = steps.join(ref.select("window_id", "node", "at", "until"), ["window_id", "node"], "left")
    return j.withColumns({"r_start": F.when(F.col("rev"), F.col("until")).otherwise(F.col("at")), "r_stop": F.when(F.col("rev"), F.col("at")).otherwise(F.col("until"))}).drop("at", "until")


def path_edges(steps: DataFrame, by: list[str], keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, place, edge) of neighbouring steps (by, step, node, rev) of paths, and the columns ``keep`` of the first of both."""
    w = Window.partitionBy(*by).orderBy("step")
    nxt = steps.withColumn("b", F.lead("node").over(w)).withColumn("b_rev", F.lead("rev").over(w)).where("b is not null")
    return nxt.select(*by, F.col("step").alias("place"), S.canonical_edge(F.col("node"), F.col("rev"), F.col("b"), F.col("b_rev")).alias("edge"), *keep)


def _supported(paths: DataFrame, records: DataFrame, by: list[str], *values: Column) -> DataFrame:
    """(by, window_id, record, lo, values) of ``supported_records``; dealt by ``by`` alone, so what is joined by it needs no other shuffle of these rows."""
    sized = records.withColumn("_n", F.size(F.collect_set("edge").over(Window.partitionBy("window_id", "record"))))
    hit = paths.join(sized, ["window_id", "edge"]).repartition(*by)
    order = Window.partitionBy(*by, "record").orderBy("place")
    step = hit.withColumn("_d", F.col("rank") - F.lag("rank").over(order))
    each = step.groupBy(*dict.fromkeys([*by, "window_id", "record"])).agg(F.count_distinct("edge").alias("have"), F.max("_n").alias("n"), F.min("_d").alias("lo"), F.max("_d").alias("hi"), *values)
    return each.where("have = n and (lo is null or lo > 0 or hi < 0)").drop("have", "n", "hi")


def supported_records(paths: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """(by, record, forward): records all of whose edges a path has, their ranks rising (forward) or falling along it."""
    return _supported(paths, records, by).select(*by, "record", F.coalesce(F.col("lo") > 0, F.lit(True)).alias("forward"))


def dangling(nodes: DataFrame, edges: DataFrame, parts: int | None = None) -> DataFrame:
    """(window_id, node, left, right): whether nothing is joined to a node's left or right end; dealt by node in ``parts`` partitions, if given."""
    dealt = lambda df: df if parts is None else df.repartition(parts, "window_id", "node")
    ends = edges.select("window_id", F.explode(F.array(
        F.struct(F.col("edge.a").alias("node"), F.when(F.col("edge.a_rev"), "left").otherwise("right").alias("side")),
        F.struct(F.col("edge.b").alias("node"), F.when(F.col("edge.b_rev"), "right").otherwise("left").alias("side")),
    )).alias("e")).select("window_id", "e.*")
    deg = dealt(ends).groupBy("window_id", "node").agg(F.count_if(F.col("side") == "left").alias("l"), F.count_if(F.col("side") == "right").alias("r"))
    return dealt(nodes.select("window_id", "node")).join(deg, ["window_id", "node"], "left").select("window_id", "node", (F.coalesce("l", F.lit(0)) == 0).alias("left"), (F.coalesce("r", F.lit(0)) == 0).alias("right"))


def spanning_paths(steps: DataFrame, ends: DataFrame, by: list[str]) -> DataFrame:
    """Paths of two steps or more whose first and last node are dangling."""
    each = steps.groupBy(*by).agg(F.min_by("node", "step").alias("a"), F.max_by("node", "step").alias("z"), F.count(F.lit(1)).alias("n")).where("n > 1")
    tip = ends.where("left or right").select("window_id", "node")
    return each.join(tip.withColumnRenamed("node", "a"), ["window_id", "a"], "left_semi").join(tip.withColumnRenamed("node", "z"), ["window_id", "z"], "left_semi").select(*by)


def spelled(steps: DataFrame, nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, seq): the bases along a path."""
    joined = steps.join(nodes.select("window_id", "node", "seq"), ["window_id", "node"])
    part = F.when(F.col("rev"), S.reverse_complement("seq")).otherwise(F.col("seq"))
    return joined.groupBy(*by).agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", part.alias("p")))), lambda x: x["p"]), "").alias("seq"))


def candidate_haplotypes(steps: DataFrame, nodes: DataFrame, ends: DataFrame, by: list[str], min_coverage: int = 1) -> DataFrame:
    """(window_id, hap, seq, coverage): spanning paths by their sequence, named after the smallest of equal ones."""
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("step", "node", "rev"))), lambda x: F.concat(F.when(x["rev"], "<").otherwise(">"), x["node"])), "")
    names = steps.groupBy(*by).agg(text.alias("name"))
    full = spelled(steps, nodes, by).join(spanning_paths(steps, ends, by), by, "left_semi").join(names, by)
    return full.groupBy("window_id", "seq").agg(F.min("name").alias("hap"), F.count(F.lit(1)).alias("coverage")).where(F.col("coverage") >= min_coverage).select("window_id", "hap", "seq", "coverage")


def walks(edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(window_id, path): all walks from source nodes (forward) to nodes that lead nowhere, each node once; by one join a step.

    Steps end when no walk is open: after as many as the largest window has nodes, at most.
    """
    both = edges.select("window_id", F.explode(F.array(
        F.struct(F.col("edge.a").alias("f"), F.col("edge.a_rev").alias("fr"), F.col("edge.b").alias("t"), F.col("edge.b_rev").alias("tr")),
        F.struct(F.col("edge.b").alias("f"), (~F.col("edge.b_rev")).alias("fr"), F.col("edge.a").alias("t"), (~F.col("edge.a_rev")).alias("tr")),
    )).alias("e")).select("window_id", "e.*").distinct()
    step = lambda n, r: F.struct(n.alias("node"), r.alias("rev"))
    now = sources.select("window_id", F.col("node").alias("f"), F.lit(False).alias("fr"), F.array(step(F.col("node"), F.lit(False))).alias("path"))
    done = None
    while True:
        ended = now.join(both.select("window_id", "f", "fr").distinct(), ["window_id", "f", "fr"], "left_anti").select("window_id", "path")
        done = ended if done is None else done.unionAll(ended)
        now = now.join(both, ["window_id", "f", "fr"]).where(~F.exists("path", lambda x: x["node"] == F.col("t")))
        now = staged(now.select("window_id", F.col("t").alias("f"), F.col("tr").alias("fr"), F.concat("path", F.array(step(F.col("t"), F.col("tr")))).alias("path")), "walks")
        if now.isEmpty():
            break
    return done


def signature(steps: DataFrame, by: list[str], k: int) -> DataFrame:
    """(by, signature): sorted runs of ``k`` neighbouring nodes of a path, the smaller of either direction."""
    w = Window.partitionBy(*by).orderBy("step").rowsBetween(0, k - 1)
    runs = steps.withColumn("r", F.collect_list(F.struct("node", "rev")).over(w)).where(F.size("r") == k)
    return runs.groupBy(*by).agg(F.array_sort(F.collect_list(S.path_text(S.canonical_path("r")))).alias("signature"))


def cross_contig_edges(edges: DataFrame, nodes: DataFrame) -> DataFrame:
    """(window_id, n): edges whose nodes lie on different contigs."""
    a = nodes.select("window_id", F.col("node").alias("a"), F.col("contig").alias("ca"))
    b = nodes.select("window_id", F.col("node").alias("b"), F.col("contig").alias("cb"))
    e = edges.select("window_id", "edge.a", "edge.b")
    return e.join(a, ["window_id", "a"]).join(b, ["window_id", "b"]).where("ca != cb").groupBy("window_id").agg(F.count(F.lit(1)).alias("n"))


def non_trivial(records: DataFrame, windows: DataFrame) -> DataFrame:
    """Windows with a record that changes the graph."""
    return windows.join(records.where("sv_type is not null").select("window_id").distinct(), "window_id", "left_semi")


def path_replacements(haps: DataFrame, ref: DataFrame) -> DataFrame:
    """(window_id, hap, pos, ref, alt): each haplotype as one replacement of its window's reference, shared ends trimmed, one base of anchor kept.

    ``ref`` has (window_id, start, seq).
    """
    j = haps.join(ref.select("window_id", "start", F.col("seq").alias("rs")), "window_id").where("seq != rs")

    def common(df: DataFrame, a: str, b: str, most: Column, name: str) -> DataFrame:
        # the first differing place: a higher-order scan over the characters, stopped by the first difference
        pairs = F.arrays_zip(F.split(a, "").alias("x"), F.split(b, "").alias("y"))
        same = F.transform(pairs, lambda p: F.coalesce(p["x"] == p["y"], F.lit(False)))
        first = F.array_position(same, False)
        return df.withColumn(name, F.least(most, F.when(first == 0, F.size(same)).otherwise(first - 1)).cast("int"))

    j = common(j, "seq", "rs", F.least(F.length("seq"), F.length("rs")) - 1, "_p").withColumn("_p", F.greatest(F.lit(1), F.col("_p")))
    j = common(j.withColumn("_s", F.reverse("seq")).withColumn("_t", F.reverse("rs")), "_s", "_t", F.least(F.length("seq"), F.length("rs")) - F.col("_p"), "_q")
    cut = lambda c: F.substr(F.col(c), F.col("_p"), F.length(c) - F.col("_q") - F.col("_p") + 1)
    return j.select("window_id", "hap", (F.col("start") + F.col("_p")).alias("pos"), cut("rs").alias("ref"), cut("seq").alias("alt"))


def free_segments(spans: DataFrame, tandems: DataFrame, by: list[str]) -> DataFrame:
    """(by, start, stop, before): parts of spans (by, lo, hi) outside tandem repeats (by, t0, t1), and free bases before each."""
    ends = spans.select(*by, F.col("lo").alias("at"), F.lit(0).alias("d"), "lo", "hi").unionAll(spans.select(*by, F.col("hi").alias("at"), F.lit(0).alias("d"), "lo", "hi"))
    held = tandems.join(spans, by).where("t0 < hi and t1 > lo")
    marks = ends.unionAll(held.select(*by, F.greatest("t0", "lo").alias("at"), F.lit(1).alias("d"), "lo", "hi")).unionAll(held.select(*by, F.least("t1", "hi").alias("at"), F.lit(-1).alias("d"), "lo", "hi"))
    points = marks.groupBy(*by, "at").agg(F.sum("d").alias("d"))
    w = Window.partitionBy(*by).orderBy("at")
    depth = points.withColumn("stop", F.lead("at").over(w)).withColumn("depth", F.sum("d").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    free = depth.where("stop is not null and depth = 0").select(*by, F.col("at").alias("start"), "stop")
    before = F.coalesce(F.sum(F.col("stop") - F.col("start")).over(Window.partitionBy(*by).orderBy("start").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    return free.withColumn("before", before)


def tandem_aware_flanks(points: DataFrame, free: DataFrame, by: list[str], flank: int) -> DataFrame:
    """(by, at, left, right): the nearest places with ``flank`` bases outside tandem repeats between them and ``at``; null where there are not so many.

    Jumps over repeats become a lookup in the running count of free bases.
    """
    n = points.join(free, by).groupBy(*by, "at").agg(F.sum(F.least("stop", "at") - F.least("start", "at")).alias("_n"))
    seg = n.join(free, by)
    size = F.col("stop") - F.col("start")
    left, right = F.col("_n") - flank, F.col("_n") + flank
    # the highest place with so many free bases before it on the left, the lowest on the right
    at_left = F.when((left >= F.col("before")) & (left <= F.col("before") + size), F.col("start") + left - F.col("before"))
    at_right = F.when((right > F.col("before")) & (right <= F.col("before") + size), F.col("start") + right - F.col("before"))
    return seg.groupBy(*by, "at").agg(F.max(at_left).alias("left"), F.min(at_right).alias("right"))


def record_spans(paths: DataFrame, records: DataFrame, placed: DataFrame | None, by: list[str], pad: int, keep: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, record, p0, p1): where each supported record lies on a path, padded by ``pad`` bases inside the path; and the path's columns ``keep``.

    ``placed`` has (by, step, n0, n1), the running places of the path's steps.  It is not needed if
    ``paths`` has ``n1``, the place of each edge on the path, and ``size``, the path's length.
    """
    if placed is not None:
        ends = placed.select(*by, F.col("step").alias("place"), "n1", F.max("n1").over(Window.partitionBy(*by)).alias("size"))
        paths = paths.join(ends, [*by, "place"])
    # an edge's place is the end of its first step and the start of its second one
    found = _supported(paths, records, by, F.min("n1").alias("_p0"), F.max("n1").alias("_p1"), F.max("size").alias("_size"), *[F.max(c).alias(c) for c in keep])
    return found.select(*by, "record", F.greatest(F.lit(0), F.col("_p0") - pad).alias("p0"), F.least("_size", F.col("_p1") + pad).alias("p1"), *keep)


def path_tandems(placed: DataFrame, ref: DataFrame, tandems: DataFrame, by: list[str]) -> DataFrame:
    """(by, t0, t1): tandem repeats (window_id, t0, t1 on the reference) in path coordinates.

    ``placed`` has (by, step, node, rev, n0, n1).  Inserted nodes beside a repeat count as repeat.
    """
    on = placed.join(ref.select("window_id", "node", "at", "until"), ["window_id", "node"], "left")
    hit = on.join(tandems.select("window_id", F.col("t0").alias("_t0"), F.col("t1").alias("_t1")), "window_id").where("at is not null and _t0 < until and _t1 > at")
    a, b = F.greatest("_t0", "at") - F.col("at"), F.least("_t1", "until") - F.col("at")
    size = F.col("n1") - F.col("n0")
    lifted = hit.select(*by, "step", (F.col("n0") + F.when(F.col("rev"), size - b).otherwise(a)).alias("t0"), (F.col("n0") + F.when(F.col("rev"), size - a).otherwise(b)).alias("t1"), "n0", "n1")
    touch = lifted.groupBy(*by, "step").agg(F.max((F.col("t0") == F.col("n0")).cast("int")).alias("first"), F.max((F.col("t1") == F.col("n1")).cast("int")).alias("last"))
    w = Window.partitionBy(*by).orderBy("step")
    beside = on.join(touch, [*by, "step"], "left").withColumn("_p", F.lag("last").over(w)).withColumn("_n", F.lead("first").over(w))
    added = beside.where("at is null and (coalesce(_p, 0) = 1 or coalesce(_n, 0) = 1)").select(*by, F.col("n0").alias("t0"), F.col("n1").alias("t1"))
    return lifted.select(*by, "t0", "t1").unionAll(added)


def unsupported_records(paths: DataFrame, records: DataFrame, by: list[str]) -> DataFrame:
    """(window_id, record) of records that no path of their window supports."""
    found = supported_records(paths, records, by).select("window_id", "record").distinct()
    return records.select("window_id", "record").distinct().join(found, ["window_id", "record"], "left_anti")


def path_records(steps: DataFrame, nodes: DataFrame, ref: DataFrame, windows: DataFrame, by: list[str]) -> DataFrame:
    """(by, contig, pos, ref, alt, kind): each path (by, step, node, rev) of two steps or more as one record.

    ``nodes`` has (window_id, node, seq), ``ref`` (window_id, node, contig, at, until) of the
    reference nodes, ``windows`` (window_id, start, seq).  A path between two reference nodes of
    a contig, in order and in one direction, is a replacement of what lies
    between them; between any other two it is a breakend, with the steps off the
    reference as its bases; with one reference end it is a single breakend.  Paths
    with neither are left out.
    """
    ends = steps.groupBy(*by).agg(F.array_sort(F.collect_list(F.struct("step", "node", "rev"))).alias("_path")).where("_path[0].step < _path[size(_path) - 1].step")
    ends = ends.withColumns({"_a": F.col("_path")[0], "_z": F.element_at("_path", -1)})
    for side in ("_a", "_z"):
        place = ref.select("window_id", F.col("node").alias(f"{side}n"), F.struct("contig", "at", "until").alias(f"{side}p"))
        ends = looked_up(ends.withColumn(f"{side}n", F.col(f"{side}.node")), place, ["window_id", f"{side}n"], [f"{side}p"]).drop(f"{side}n")
    known = ends.where("_ap is not null or _zp is not null")
    # the steps between the ends that are on the reference, a row each (a path without such has one without a node), and their bases
    inside = F.filter("_path", lambda x: ((x["step"] > F.col("_a.step")) | F.col("_ap").isNull()) & ((x["step"] < F.col("_z.step")) | F.col("_zp").isNull()))
    inner = known.select(*by, "_a", "_z", "_ap", "_zp", F.explode_outer(inside).alias("_s")).withColumn("node", F.col("_s.node"))
    inner = looked_up(inner, nodes, ["window_id", "node"], ["seq"])
    part = F.when(F.col("seq").isNull(), "").when(F.col("_s.rev"), S.reverse_complement("seq")).otherwise(F.col("seq"))
    bases = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("_s.step", part.alias("p")))), lambda x: x["p"]), "")
    k = inner.groupBy(*by).agg(bases.alias("_in"), *[F.first(c).alias(c) for c in ("_a", "_z", "_ap", "_zp")])
    # the window's bases come last, so no shuffle carries them for each path
    k = k.join(windows.select("window_id", F.col("start").alias("_ws"), F.col("seq").alias("_wq")), "window_id")
    back = F.when(F.col("_in") == "", "").otherwise(S.reverse_complement(F.coalesce(F.nullif("_in", F.lit("")), F.lit("A"))))
    base = lambda at: F.substr(F.col("_wq"), at - F.col("_ws") + 1, F.lit(1))  # noqa: E731  of a place from 0
    between = lambda lo, hi: F.substr(F.col("_wq"), lo - F.col("_ws") + 1, hi - lo)
    a, z, a_rev, z_rev = F.col("_ap"), F.col("_zp"), F.col("_a.rev"), F.col("_z.rev")
    forward = ~a_rev & ~z_rev & (a["at"] < z["at"])
    backward = a_rev & z_rev & (a["at"] > z["at"])
    both = a.isNotNull() & z.isNotNull()
    same = both & (a["contig"] == z["contig"]) & (forward | backward)
    mate = lambda p, rev: F.when(rev, F.concat(F.lit("]"), p["contig"], F.lit(":"), p["until"].cast("string"), F.lit("]"))).otherwise(F.concat(F.lit("["), p["contig"], F.lit(":"), (p["at"] + 1).cast("string"), F.lit("[")))
    # the base at a path's side of its end node: the last one before the path leaves, the first one where it arrives
    out_at = F.when(a_rev, a["at"]).otherwise(a["until"] - 1)
    in_at = F.when(z_rev, z["until"] - 1).otherwise(z["at"])
    low, high = F.when(backward, z["until"]).otherwise(a["until"]), F.when(backward, a["at"]).otherwise(z["at"])
    one = F.struct
    record = (
        F.when(same, one(a["contig"].alias("contig"), low.alias("pos"), F.concat(base(low - 1), between(low, high)).alias("ref"), F.concat(base(low - 1), F.when(backward, back).otherwise(F.col("_in"))).alias("alt"), F.lit("replacement").alias("kind")))
        .when(both, one(a["contig"].alias("contig"), (out_at + 1).alias("pos"), base(out_at).alias("ref"), F.when(a_rev, F.concat(mate(z, z_rev), back, base(out_at))).otherwise(F.concat(base(out_at), F.col("_in"), mate(z, z_rev))).alias("alt"), F.lit("breakend").alias("kind")))
        .when(a.isNotNull(), one(a["contig"].alias("contig"), (out_at + 1).alias("pos"), base(out_at).alias("ref"), F.when(a_rev, F.concat(F.lit("."), back, base(out_at))).otherwise(F.concat(base(out_at), F.col("_in"), F.lit("."))).alias("alt"), F.lit("single").alias("kind")))
        .otherwise(one(z["contig"].alias("contig"), (in_at + 1).alias("pos"), base(in_at).alias("ref"), F.when(z_rev, F.concat(base(in_at), back, F.lit("."))).otherwise(F.concat(F.lit("."), F.col("_in"), base(in_at))).alias("alt"), F.lit("single").alias("kind")))
    )
    return k.select(*by, record.alias("r")).select(*by, "r.*")


def spelled_signatures(nodes: DataFrame, edges: DataFrame, most_steps: int) -> DataFrame:
    """(window_id, signature): of every node the strings spelled from it in both directions over ``most_steps`` edges or to an end, in order, each with a comma behind; and all nodes' lines in order.

    Strings that lead to the same place are one row with their number at each step, so
    the work grows with distinct strings and not with walks.
    """
    both = edges.select("window_id", F.explode(F.array(
        F.struct(F.col("edge.a").alias("f"), F.col("edge.a_rev").alias("fr"), F.col("edge.b").alias("t"), F.col("edge.b_rev").alias("tr")),
        F.struct(F.col("edge.b").alias("f"), (~F.col("edge.b_rev")).alias("fr"), F.col("edge.a").alias("t"), (~F.col("edge.a_rev")).alias("tr")),
    )).alias("e")).select("window_id", "e.*").distinct()
    turned = nodes.select("window_id", "node", F.explode(F.array(F.struct(F.lit(False).alias("rev"), F.col("seq").alias("s")), F.struct(F.lit(True).alias("rev"), S.reverse_complement("seq").alias("s")))).alias("o")).select("window_id", "node", "o.rev", "o.s")
    turned = staged(turned, "oriented_nodes")
    now = turned.select("window_id", F.col("node").alias("origin"), F.col("node").alias("f"), F.col("rev").alias("fr"), F.col("s").alias("text"), F.lit(1).cast("long").alias("n"))
    done, key = None, ["window_id", "f", "fr"]
    for _ in range(most_steps):
        ended = now.join(both.select(*key).distinct(), key, "left_anti").select("window_id", "origin", "text", "n")
        done = ended if done is None else done.unionAll(ended)
        to = turned.select("window_id", F.col("node").alias("t"), F.col("rev").alias("tr"), "s")
        grown = now.join(both, key).join(to, ["window_id", "t", "tr"]).select("window_id", "origin", F.col("t").alias("f"), F.col("tr").alias("fr"), F.concat("text", "s").alias("text"), "n")
        now = staged(grown.groupBy("window_id", "origin", "f", "fr", "text").agg(F.sum("n").alias("n")), "strings")
    last = now.select("window_id", "origin", "text", "n")
    every = (last if done is None else done.unionAll(last)).groupBy("window_id", "origin", "text").agg(F.sum("n").cast("int").alias("n"))
    line = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("text", "n"))), lambda x: F.repeat(F.concat(x["text"], F.lit(",")), x["n"])), "")
    lines = every.groupBy("window_id", "origin").agg(line.alias("line"))
    return lines.groupBy("window_id").agg(F.array_sort(F.collect_list("line")).alias("signature"))
