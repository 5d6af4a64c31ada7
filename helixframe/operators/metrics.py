"""Evaluation metrics: histograms, coverage and identity, ratios, recall, ROC."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import sequences
from ..functions.sequences import identity_bin
from . import intervals


def support_histogram(df: DataFrame, by: list[str], value: str = "identity", spanning: str = "is_spanning", reverse: str = "is_reverse", *more: Column) -> DataFrame:
    """24 counts a group: spanning x reverse x identity bin, as s{0,1}r{0,1}q{0-5}, with the largest identity and ``more`` aggregates; one pass."""
    binned = df.withColumn("_q", identity_bin(value))
    cells = [
        F.count_if((F.col(spanning) == bool(s)) & (F.col(reverse) == bool(r)) & (F.col("_q") == q)).alias(f"s{s}r{r}q{q}")
        for s in (0, 1) for r in (0, 1) for q in range(6)
    ]
    return binned.groupBy(*by).agg(*cells, F.max(value).alias("max_identity"), *more)


def coverage_and_identity(df: DataFrame, by: list[str], start: str, stop: str, length: str, counters: tuple[str, str, str, str]) -> DataFrame:
    """(by, coverage, identity): covered part of ``length`` by the union of intervals, and identity of summed counters; groups without columns or length get 0."""
    w = Window.partitionBy(*by).orderBy(start, stop)
    reach = F.max(stop).over(w.rowsBetween(Window.unboundedPreceding, -1))
    gap = F.greatest(F.lit(0), F.col(start) - F.coalesce(reach, F.lit(0)))
    m, x, i, d = (F.sum(c) for c in counters)
    return (
        df.withColumn("_gap", gap).groupBy(*by)
        .agg(F.sum("_gap").alias("_gaps"), F.max(stop).alias("_last"), F.max(length).alias("_len"), m.alias("_m"), (m + x + i + d).alias("_all"))
        .select(*by, F.coalesce(F.try_divide(F.col("_last") - F.col("_gaps"), F.col("_len")), F.lit(0.0)).alias("coverage"), F.coalesce(F.try_divide(F.col("_m"), F.col("_all")), F.lit(0.0)).alias("identity"))
    )


def node_counters(nodes: DataFrame, by: list[str], full: float = 0.95, small: int = 50) -> DataFrame:
    """Counts of (name, length, is_ref, is_flank, coverage) rows a group: nodes off the reference, those covered fully or partly, and their bases."""
    own = (F.col("is_ref") == 0) & (F.col("is_flank") == 0)
    covered = own & (F.col("coverage") >= full)
    return nodes.groupBy(*by).agg(
        F.count_if(own).alias("nonref_nodes"), F.count_if(covered).alias("covered"), F.count_if(own & (F.col("coverage") > 0) & (F.col("coverage") < full)).alias("partly"),
        F.sum(F.when(own, F.col("length")).otherwise(0)).alias("nonref_bases"), F.sum(F.when(own, F.floor(F.col("coverage") * F.col("length"))).otherwise(0)).alias("covered_bases"),
        F.count_if(covered & (F.col("length") < small)).alias("covered_small"), F.count_if(covered & (F.col("length") >= small)).alias("covered_large"),
    )


def edge_coverage(edges: DataFrame, by: list[str]) -> DataFrame:
    """Counts of (is_ref, n_alignments) edge rows a group."""
    seen = F.col("n_alignments") > 0
    return edges.groupBy(*by).agg(
        F.sum("n_alignments").alias("n_alignments"), F.count(F.lit(1)).alias("n_edges"), F.count_if(seen).alias("n_edges_covered"),
        F.count_if(F.col("is_ref") == 0).alias("n_nonref_edges"), F.count_if((F.col("is_ref") == 0) & seen).alias("n_nonref_edges_covered"),
    )


def averages(haps: DataFrame, by: list[str], cluster: str | None = None) -> DataFrame:
    """Mean coverage and identity a group over all, over non-reference rows, and over clusters' own means; -1 where there is none."""
    none = lambda c: F.coalesce(c, F.lit(-1.0))
    off = F.when(F.col("is_ref") == 0, F.col("coverage")), F.when(F.col("is_ref") == 0, F.col("identity"))
    out = haps.groupBy(*by).agg(none(F.avg("coverage")).alias("coverage"), none(F.avg("identity")).alias("identity"), none(F.avg(off[0])).alias("nonref_coverage"), none(F.avg(off[1])).alias("nonref_identity"))
    if cluster:
        each = haps.groupBy(*by, cluster).agg(F.avg("coverage").alias("c"), F.avg("identity").alias("i"))
        out = out.join(each.groupBy(*by).agg(none(F.avg("c")).alias("cluster_coverage"), none(F.avg("i")).alias("cluster_identity")), by, "left")
    return out


def clusters(alignments: DataFrame, by: list[str], query: str = "query", path: str = "path", spans: str = "spans") -> DataFrame:
    """(by, cluster, queries): queries with one spanning alignment by their path, all others as 'unknown'."""
    each = alignments.groupBy(*by, query).agg(F.count(F.lit(1)).alias("n"), F.max(path).alias("p"), F.min(F.col(spans).cast("int")).alias("s"))
    named = each.withColumn("cluster", F.when((F.col("n") > 1) | (F.col("s") == 0), "unknown").otherwise(F.col("p")))
    return named.groupBy(*by, "cluster").agg(F.array_join(F.array_sort(F.collect_list(query)), " ").alias("queries"))


def ratios(df: DataFrame, by: list[str], num: Column, den: Column) -> DataFrame:
    """(by, num, den, ratio) of summed counts; groups with nothing below the line are left out."""
    return df.groupBy(*by).agg(F.sum(num).alias("num"), F.sum(den).alias("den")).where("den != 0").withColumn("ratio", F.col("num") / F.col("den"))


def recall(truth: DataFrame, found: DataFrame, key: list[str], by: list[str], coverage: float = 0.9, identity: float = 0.9) -> DataFrame:
    """(by, num, den, ratio): distinct truth keys, and those some found row of the group covers well enough; without truth the ratio is null."""
    good = found.where((F.col("coverage") >= coverage) & (F.col("identity") >= identity)).select(*by, *key).distinct().withColumn("_hit", F.lit(1))
    walks = truth.select(*key).distinct()
    groups = found.select(*by).distinct()
    den = walks.agg(F.count(F.lit(1)).alias("den"))
    num = good.join(walks, key, "left_semi").groupBy(*by).agg(F.count(F.lit(1)).alias("n"))
    return groups.join(num, by, "left").crossJoin(F.broadcast(den)).select(*by, F.coalesce("n", F.lit(0)).alias("num"), "den", F.try_divide(F.coalesce("n", F.lit(0)), F.col("den")).alias("ratio"))  # den is one row


def reference_walks(alignments: DataFrame, ref_nodes: DataFrame, by: list[str]) -> DataFrame:
    """(by, reference): of paths over reference nodes alone (by, node) whose numbers rise or fall by one at each step, the longest; in its smaller direction, the first text on a tie.

    ``alignments`` has (by, path), its nodes numbers.  Windows without such a path have no row.
    """
    keyed = alignments.select(*by, "path").withColumn("_t", sequences.path_text(sequences.canonical_path("path")))
    numbers = F.transform("path", lambda s: s["node"].cast("long"))
    steps = F.zip_with(F.slice(numbers, 2, F.size("path")), F.slice(numbers, 1, F.greatest(F.size("path") - 1, F.lit(0))), lambda b, a: b - a)
    even = keyed.where((F.size("path") > 0) & (F.forall(steps, lambda d: d == 1) | F.forall(steps, lambda d: d == -1)))
    each = even.select(*by, "_t", F.size("path").alias("_n"), F.explode(F.array_distinct(F.transform("path", lambda s: s["node"].cast("string")))).alias("node")).distinct()
    on = each.join(ref_nodes.select(*by, F.col("node").cast("string").alias("node")).distinct(), [*by, "node"], "left_semi").groupBy(*by, "_t").agg(F.max("_n").alias("_n"), F.count(F.lit(1)).alias("_on"))
    kinds = each.groupBy(*by, "_t").agg(F.count(F.lit(1)).alias("_all"))
    best = on.join(kinds, [*by, "_t"]).where("_on = _all").groupBy(*by).agg(F.min(F.struct((-F.col("_n")).alias("n"), F.col("_t").alias("t"))).alias("m"))
    return best.select(*by, F.col("m.t").alias("reference"))


def haplotype_recall(truth: DataFrame, ref_nodes: DataFrame, haps: DataFrame, by: list[str], coverage: float = 0.9, identity: float = 0.9) -> DataFrame:
    """(by, tool, num, den): distinct walks that haplotypes off the reference take in the true graph, and those of them that a tool's graph has.

    ``truth`` has (by, hap, path) of the true graph's alignments, ``haps`` (by, tool, hap,
    coverage, identity).  A haplotype is off the reference if its canonical path is
    not the window's ``reference_walks``; with several paths its first one counts.
    Windows of ``haps`` without such haplotypes have zeros.
    """
    paths = truth.select(*by, "hap", sequences.path_text(sequences.canonical_path("path")).alias("walk"))
    off = paths.join(reference_walks(truth, ref_nodes, by), by, "left").where("reference is null or walk != reference").select(*by, "hap", "walk")
    den = off.groupBy(*by).agg(F.count_distinct("walk").alias("den"))
    walk_of = off.groupBy(*by, "hap").agg(F.min("walk").alias("walk"))
    good = haps.where((F.col("coverage") >= coverage) & (F.col("identity") >= identity)).select(*by, "tool", "hap").distinct()
    num = good.join(walk_of, [*by, "hap"]).groupBy(*by, "tool").agg(F.count_distinct("walk").alias("num"))
    every = haps.select(*by, "tool").distinct()
    zero = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("long").alias(c)
    return every.join(den, by, "left").join(num, [*by, "tool"], "left").select(*by, "tool", zero("num"), zero("den"))


def histogram(df: DataFrame, by: list[str], value: str, low: float, high: float, bins: int) -> DataFrame:
    """(by, bin, n, part) over fixed bins; values outside and NaN are left out, the upper end belongs to the last bin."""
    v = F.col(value)
    at = F.least(F.lit(bins - 1), F.floor((v - low) / ((high - low) / bins)))
    n = df.where((v >= low) & (v <= high) & ~F.isnan(v.cast("double"))).groupBy(*by, at.cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"))
    total = F.sum("n").over(Window.partitionBy(*by)) if by else F.sum("n").over(Window.partitionBy(F.lit(0)))
    return n.withColumn("part", F.col("n") / total)


def roc(df: DataFrame, score: str, label: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, score, tp, fp, n_pos, n_neg) at every distinct threshold, largest first.

    Rows are summed by score before any window, so a window holds distinct scores only.
    """
    each = df.groupBy(*by, score).agg(F.sum((F.col(label) == 1).cast("long")).alias("p"), F.sum((F.col(label) != 1).cast("long")).alias("n"))
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    down = part.orderBy(F.col(score).desc()).rowsBetween(Window.unboundedPreceding, 0)
    return each.select(*by, score, F.sum("p").over(down).alias("tp"), F.sum("n").over(down).alias("fp"), F.sum("p").over(part).alias("n_pos"), F.sum("n").over(part).alias("n_neg"))


def auc(df: DataFrame, score: str, label: str, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(by, auc): area under the ROC curve by trapezoids (ties count half); null where a group has one class only."""
    part = Window.partitionBy(*by) if by else Window.partitionBy(F.lit(0))
    points = roc(df, score, label, by).withColumn("p0", F.lag("tp", 1, 0).over(part.orderBy(F.col(score).desc()))).withColumn("f0", F.lag("fp", 1, 0).over(part.orderBy(F.col(score).desc())))
    area = F.try_divide(F.sum((F.col("fp") - F.col("f0")) * (F.col("tp") + F.col("p0")) / 2.0), F.max(F.col("n_pos") * F.col("n_neg")))
    return points.groupBy(*by).agg(area.alias("auc"))


def supported_by_type(records: DataFrame, by: list[str], kind: str = "sv_type", supported: str = "is_supported") -> DataFrame:
    """(by, sv_type, supported, unsupported): records of each type with and without support; a null flag is none."""
    yes = F.coalesce(F.col(supported), F.lit(False))
    return records.groupBy(*by, kind).agg(F.count_if(yes).alias("supported"), F.count_if(~yes).alias("unsupported"))


def length_histogram(df: DataFrame, by: list[str], length: str, width: int, most: int) -> DataFrame:
    """(by, bin, n): lengths by bins of ``width``, all over ``most`` in its bin; null lengths are left out."""
    at = F.floor(F.least(F.abs(F.col(length)), F.lit(most)) / width).cast("long")
    return df.where(F.col(length).isNotNull()).groupBy(*by, at.alias("bin")).agg(F.count(F.lit(1)).alias("n"))


def multiplicities(df: DataFrame, by: list[str], key: list[str]) -> DataFrame:
    """(by, times, n): how many keys stand in so many rows each: callers a record, breakends a position, edges a record."""
    each = df.groupBy(*by, *key).agg(F.count(F.lit(1)).alias("times"))
    return each.groupBy(*by, "times").agg(F.count(F.lit(1)).alias("n"))


def anomalous_windows(df: DataFrame, tool: str, bad: Column) -> DataFrame:
    """(tool, contig, start, stop): windows where ``bad`` holds for some row, each once."""
    return df.where(bad).select(tool, "contig", "start", "stop").distinct()


def l2_normalized(df: DataFrame, columns: list[str], epsilon: float = 1e-12) -> DataFrame:
    """Columns divided by their Euclidean norm over all rows (one row of sums, broadcast)."""
    norms = df.agg(*[F.sqrt(F.sum(F.col(c) * F.col(c))).alias(f"_n_{c}") for c in columns])
    return df.crossJoin(F.broadcast(norms)).withColumns({c: F.col(c) / F.greatest(F.col(f"_n_{c}"), F.lit(epsilon)) + epsilon for c in columns}).drop(*[f"_n_{c}" for c in columns])


def balanced(df: DataFrame, group: str, least: int, order: Column) -> DataFrame:
    """At most max(least, size of the smallest class) rows of every class, the first in ``order``; rows without a class are one.

    Ranks are counted over range partitions, so a class is never one task.
    """
    sizes = df.groupBy(group).agg(F.count(F.lit(1)).alias("n"))
    cap = sizes.agg(F.greatest(F.min("n"), F.lit(least)).alias("_cap"))
    rows = intervals.dealt(df.withColumn("_order", order), group, "_order", "_order")
    ranked = intervals.running(rows, group, ["_order"], F.lit(1), F.sum, lambda a, b: a + F.coalesce(b, F.lit(0)), "_rank", inclusive=True)
    return ranked.crossJoin(F.broadcast(cap)).where("_rank <= _cap").select(*df.columns)  # the cap is one row


def bedgraph(df: DataFrame, region: str, a: str, b: str) -> DataFrame:
    """(contig, start, stop, value): the absolute difference of two tools' numbers on each window."""
    from ..functions.sequences import region_of

    r = region_of(region)
    return df.select(r["contig"].alias("contig"), r["start"].alias("start"), r["stop"].alias("stop"), F.abs(F.col(a) - F.col(b)).alias("value"))


def stage_seconds(logs: DataFrame) -> DataFrame:
    """(name, seconds) of (name, h, m, s, ms) rows."""
    return logs.groupBy("name").agg(F.sum(F.col("h") * 3600 + F.col("m") * 60 + F.col("s") + F.col("ms") / 1000).alias("seconds"))


def window_means(df: DataFrame, by: list[str], values: list[str], only: Column | None = None) -> DataFrame:
    """Means a group over all rows, and over those ``only`` holds for."""
    aggs = [F.avg(v).alias(v) for v in values]
    if only is not None:
        aggs += [F.avg(F.when(only, F.col(v))).alias(f"{v}_only") for v in values]
    return df.groupBy(*by).agg(*aggs)
