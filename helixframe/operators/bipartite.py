"""Samples, reads and candidate haplotypes as a weighted relation.

One table ``edges`` of (sample, read, hap, weight), with window columns in
front where there are windows (``by``).  Weights are costs: smaller is better.
Compression, dominance and pruning are aggregations and equi-joins on small keys.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.sequences import quantized
from ..staging import staged


def by_sample(edges: DataFrame, key: list[str]) -> DataFrame:
    """``edges`` dealt by sample, so that all that follows by sample or by its reads needs no shuffle.

    The number of partitions is one that adaptive execution leaves alone: it would size them by
    compressed bytes, of which edges have few, far more rows than a task's memory should hold.
    """
    return edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def samples_of_hap(edges: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    return edges.select(*by, "hap", "sample").distinct()


def haps_of_sample(edges: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    return edges.select(*by, "sample", "hap").distinct()


def reads_with_two_samples(edges: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Reads that break the rule of one sample a read."""
    return edges.groupBy(*by, "read").agg(F.count_distinct("sample").alias("n")).where("n > 1")


def rescaled(edges: DataFrame, by: list[str] = [], power: float = 1.2, least: float = 0.0, cap: float = 2000.0) -> DataFrame:  # noqa: B006
    """Weights as round((w - best of the read) ** power + 1), at most ``cap``."""
    best = F.min("weight").over(Window.partitionBy(*by, "read"))
    value = F.floor(F.pow(F.col("weight") - best, F.lit(power)) + 1 + 0.5)
    checked = F.when(value < least, F.raise_error(F.lit("rescaled weight under the least one")).cast("double")).otherwise(F.least(value, F.lit(cap)))
    return edges.withColumn("weight", checked)


def read_signatures(edges: DataFrame, by: list[str] = [], quantum: float = 0.0) -> DataFrame:  # noqa: B006
    """(sample, read, signature): the read's haplotypes with quantised weights, in order."""
    pair = F.struct("hap", quantized("weight", quantum).alias("w"))
    return edges.groupBy(*by, "sample", "read").agg(F.array_sort(F.collect_list(pair)).alias("signature"))


def compressed_reads(edges: DataFrame, by: list[str] = [], quantum: float = 0.0) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(edges with one read for each (sample, signature), weights summed; membership read -> kept read)."""
    key = [*by, "sample"]
    known = by_sample(edges, key).dropna(subset=[*key, "read"])
    signature = F.array_sort(F.collect_list(F.struct("hap", quantized("weight", quantum).alias("w")))).alias("signature")
    signed = known.groupBy(*key, "read").agg(signature, F.collect_list(F.struct("hap", "weight")).alias("_fits"))
    members = signed.withColumn("kept", F.min("read").over(Window.partitionBy(*key, "signature")))
    fits = members.select(*key, F.col("kept").alias("read"), F.explode("_fits").alias("_f"))
    return fits.groupBy(*key, "read", F.col("_f.hap").alias("hap")).agg(F.sum("_f.weight").alias("weight")), members.select(*key, "read", "kept")


def sample_signatures(edges: DataFrame, by: list[str] = [], quantum: float = 0.0) -> DataFrame:  # noqa: B006
    """(sample, signature): the multiset of its reads' signatures as sorted (signature, count)."""
    counts = read_signatures(edges, by, quantum).groupBy(*by, "sample", "signature").agg(F.count(F.lit(1)).alias("n"))
    return counts.groupBy(*by, "sample").agg(F.array_sort(F.collect_list(F.struct("signature", "n"))).alias("signature"))


def _ends(steps: DataFrame, node: str, to: str, by: list[str]) -> DataFrame:
    """``steps`` with the last node reached from each; a step leads to a later name, so there are no circles, and each round doubles them."""
    now = staged(steps.select(*by, node, to), "steps")
    while True:
        ahead = now.select(*by, F.col(node).alias(to), F.col(to).alias("_next"))
        nxt = staged(now.join(ahead, [*by, to], "left").select(*by, node, F.coalesce("_next", to).alias(to), F.col("_next").isNotNull().alias("_moved")), "steps")
        now = nxt.select(*by, node, to)
        if nxt.where("_moved").isEmpty():
            return now


def contained_samples(edges: DataFrame, by: list[str] = [], quantum: float = 0.0) -> DataFrame:  # noqa: B006
    """(sample, container): samples whose reads fit one haplotype each and are all among the reads of a later sample.

    The container is the first sample by name, after ``sample``, that has each of its
    read signatures at least as often.  A container has the rarest signature too, so
    candidates are found by that one alone, and then counted over all of them.
    Samples with equal reads contain each other: merge them before.
    """
    key = [*by, "sample"]
    signed = read_signatures(edges, by, quantum)
    counts = staged(signed.groupBy(*key, "signature").agg(F.count(F.lit(1)).alias("n")), "signatures")
    plain = counts.groupBy(*key).agg(F.max(F.size("signature")).alias("most"), F.count(F.lit(1)).alias("kinds")).where("most = 1").select(*key, "kinds")
    rarity = counts.groupBy(*by, "signature").agg(F.count(F.lit(1)).alias("held"))
    rank = Window.partitionBy(*key).orderBy("held", "signature")
    of_plain = staged(counts.join(plain, key).join(rarity, [*by, "signature"]), "plain_signatures")
    rarest = of_plain.withColumn("_r", F.row_number().over(rank)).where("_r = 1").select(*key, "signature", "n", "kinds")
    holders = counts.select(*by, F.col("sample").alias("container"), "signature", F.col("n").alias("m"))
    met = rarest.join(holders, [*by, "signature"]).where("container > sample and m >= n").select(*key, "kinds", "container")
    same = met.join(of_plain.select(*key, "signature", "n"), key).join(holders, [*by, "container", "signature"]).where("m >= n")
    whole = same.groupBy(*key, "container", "kinds").agg(F.count(F.lit(1)).alias("found")).where("found = kinds")
    return whole.groupBy(*key).agg(F.min("container").alias("container"))


def compressed_samples(edges: DataFrame, by: list[str] = [], quantum: float = 0.0, contained: bool = False) -> tuple[DataFrame, DataFrame]:  # noqa: B006
    """(edges of kept samples, weights of merged ones added read by read; membership sample -> kept sample, read -> kept read).

    Samples with the same multiset of read signatures become the first of them.  With
    ``contained``, those of ``contained_samples`` then go into their last container.
    Equal reads of two samples are matched by their rank within the signature.
    """
    groups = sample_signatures(edges, by, quantum)
    members = groups.join(groups.groupBy(*by, "signature").agg(F.min("sample").alias("kept")), [*by, "signature"]).select(*by, "sample", "kept")
    if contained:
        members = staged(members, "members")
        first = edges.join(members.where("sample = kept").select(*by, "sample"), [*by, "sample"], "left_semi")
        last = _ends(contained_samples(first, by, quantum), "sample", "container", by).select(*by, F.col("sample").alias("kept"), "container")
        members = members.join(last, [*by, "kept"], "left").select(*by, "sample", F.coalesce("container", "kept").alias("kept"))
    place = F.row_number().over(Window.partitionBy(*by, "sample", "signature").orderBy("read"))
    ranked = read_signatures(edges, by, quantum).withColumn("k", place)
    kept = ranked.select(*by, F.col("sample").alias("kept"), "signature", "k", F.col("read").alias("into"))
    moved = ranked.join(members, [*by, "sample"]).join(kept, [*by, "kept", "signature", "k"]).select(*by, "sample", "read", "kept", "into")
    out = edges.join(moved, [*by, "sample", "read"]).groupBy(*by, F.col("kept").alias("sample"), F.col("into").alias("read"), "hap").agg(F.sum("weight").alias("weight"))
    return out, moved


def decompressed_samples(solution: DataFrame, moved: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(sample, read, hap) of all samples from that of the kept ones."""
    chosen = solution.select(*by, F.col("sample").alias("kept"), F.col("read").alias("into"), "hap")
    return moved.join(chosen, [*by, "kept", "into"]).select(*by, "sample", "read", "hap")


def mandatory_haps(edges: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(read, hap) of the reads that only one haplotype fits."""
    return edges.groupBy(*by, "read").agg(F.count(F.lit(1)).alias("n"), F.min("hap").alias("hap")).where("n = 1").drop("n")


def _pairs(edges: DataFrame, by: list[str], better: Column) -> DataFrame:
    """(hap, other, n): reads (of ``by``) that both fit and where ``better`` holds."""
    a = edges.select(*by, "read", "hap", F.col("weight").alias("w"))
    b = edges.select(*by, "read", F.col("hap").alias("other"), F.col("weight").alias("v"))
    return a.join(b, [*by, "read"]).where((F.col("hap") != F.col("other")) & better).groupBy(*by, "hap", "other").agg(F.count(F.lit(1)).alias("n"))


def contained_haps(edges: DataFrame, by: list[str] = [], quantum: float = 0.0) -> DataFrame:  # noqa: B006
    """Haplotypes with another one that fits all their reads no worse: (hap, other); of equal ones all but the first."""
    e = edges.withColumn("weight", quantized("weight", quantum))
    deg = e.groupBy(*by, "hap").agg(F.count(F.lit(1)).alias("deg"))
    covered = _pairs(e, by, F.col("v") <= F.col("w")).join(deg, [*by, "hap"]).where("n = deg")
    back = covered.select(*by, F.col("hap").alias("other"), F.col("other").alias("hap"), F.lit(True).alias("both"))
    dominated = covered.join(back, [*by, "hap", "other"], "left").where("both is null or other < hap")
    return dominated.groupBy(*by, "hap").agg(F.min("other").alias("other"))


def locally_dominated(edges: DataFrame, margin: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(sample, hap) with another haplotype that is better by ``margin`` on all its reads of the sample.

    A read counts for each of its haplotypes, and for each other one that is better there.
    """
    key = [*by, "sample"]
    fits = by_sample(edges, key).groupBy(*key, "read").agg(F.collect_list(F.struct("hap", F.col("weight").alias("w"))).alias("_fits"))
    first = fits.select(*key, "read", "_fits", F.explode("_fits").alias("_a"))
    better = F.filter("_fits", lambda x: F.col("read").isNotNull() & (x["hap"] != F.col("_a.hap")) & (x["w"] <= F.col("_a.w") - margin))
    own = F.array(F.lit(None).cast(edges.schema["hap"].dataType))
    each = first.select(*key, F.col("_a.hap").alias("hap"), F.explode(F.concat(own, F.transform(better, lambda x: x["hap"]))).alias("_other"))
    counts = each.groupBy(*key, "hap", "_other").agg(F.count(F.lit(1)).alias("_n"))
    of_hap = counts.groupBy(*key, "hap").agg(F.max(F.when(F.col("_other").isNull(), F.col("_n"))).alias("_deg"), F.collect_set(F.when(F.col("_other").isNotNull(), F.col("_n"))).alias("_better"))
    return of_hap.where(F.array_contains("_better", F.col("_deg"))).dropna(subset=key).select(*key, "hap")


def one_hap_samples(edges: DataFrame, margin: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(sample, hap): one haplotype fits all reads, is nowhere beaten by ``margin``, and beats all others by it somewhere or stands alone."""
    key = [*by, "sample"]
    best = Window.partitionBy(*key, "read").orderBy("weight")
    whole = best.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    ranked = by_sample(edges, key).withColumn("b", F.min("weight").over(whole)).withColumn("first", (F.row_number().over(best) == 1) & F.col("read").isNotNull())
    ranked = ranked.withColumn("n_best", F.min(F.when(F.col("weight") > F.col("b"), F.col("weight"))).over(whole)).withColumn("ties", F.count(F.when(F.col("weight") == F.col("b"), 1)).over(whole))
    ok = F.col("weight") < F.col("b") + margin
    favoured = (F.col("weight") == F.col("b")) & (F.col("ties") == 1) & (F.col("n_best").isNull() | (F.col("n_best") >= F.col("b") + margin))
    fits = ranked.groupBy(*key, "hap").agg(F.count_if(ok).alias("n"), F.max((ok & favoured).cast("int")).alias("favoured"), F.count_if("first").alias("firsts"))
    of_sample = fits.groupBy(*key).agg(F.sum("firsts").alias("reads"), F.collect_list(F.struct("hap", "n", "favoured")).alias("haps")).dropna(subset=key)
    sure = of_sample.withColumn("sure", F.filter("haps", lambda x: (x["n"] == F.col("reads")) & (x["favoured"] == 1))).where("size(sure) > 0")
    return sure.select(*key, F.array_min(F.transform("sure", lambda x: x["hap"])).alias("hap"))


def two_hap_samples(edges: DataFrame, margin: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(sample, hap1, hap2): every read of the sample is favoured by exactly one of two haplotypes."""
    key = [*by, "sample"]
    best = Window.partitionBy(*key, "read").orderBy("weight", "hap")
    first = by_sample(edges, key).withColumn("rank", F.row_number().over(best)).withColumn("next", F.lead("weight").over(best)).where("rank = 1")
    sure = first.groupBy(*key).agg(
        F.min((F.col("next").isNull() | (F.col("next") >= F.col("weight") + margin)).cast("int")).alias("sure"),
        F.count_distinct("hap").alias("haps"), F.min("hap").alias("hap1"), F.max("hap").alias("hap2"),
    )
    return sure.where("sure = 1 and haps = 2").select(*key, "hap1", "hap2")


def has_large_weight(edges: DataFrame, margin: float, by: list[str] = []) -> DataFrame:  # noqa: B006
    return edges.groupBy(*by, "sample").agg((F.max("weight") >= margin).alias("large"))


def least_reached(links: DataFrame) -> DataFrame:
    """(node, least) of links (u, v): the least node that each one reaches, for nodes of a link between different ones.

    Every round each node goes to its least neighbour, and on to the end of that chain; links
    are then asked of these ends alone, once each, so links and nodes shrink round by round and only
    pairs of names are shuffled. The rounds' steps are joined backwards.
    """
    rounds = []
    links = staged(links.where("u != v").select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    while not links.isEmpty():
        least = links.groupBy(F.col("v").alias("node")).agg(F.min("u").alias("to"))
        ends = _ends(least, "node", "to", [])
        rounds.append(ends)
        of_u, of_v = (ends.select(F.col("node").alias(c), F.col("to").alias(f"_{c}")) for c in "uv")
        moved = links.join(of_v, "v").join(of_u, "u", "left").select(F.coalesce("_u", "u").alias("u"), F.col("_v").alias("v")).where("u != v")
        links = staged(moved.select(F.least("u", "v").alias("u"), F.greatest("u", "v").alias("v")).distinct(), "links")
    if not rounds:
        return links.select(F.col("u").alias("node"), F.col("v").alias("least"))
    found = rounds.pop()
    while rounds:
        step = rounds.pop()
        later = found.select(F.col("node").alias("to"), F.col("to").alias("_to"))
        # ends of this round that are not moved on are their own; those moved on are nodes of their own right
        found = staged(step.join(later, "to", "left").select("node", F.coalesce("_to", "to").alias("to")).unionAll(found), "ends")
    roots = found.select(F.col("to").alias("node")).distinct()
    return found.unionAll(roots.select("node", F.col("node").alias("to"))).withColumnRenamed("to", "least")


def linked(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(u, v): each left node with the least one of every right node they share; a right node of one left node links nothing."""
    rows = edges.select(F.col(left).alias("v"), F.col(right).alias("_r")).dropna().distinct()
    return rows.withColumn("u", F.min("v").over(Window.partitionBy("_r"))).where("u != v").select("u", "v")


def components_of_left(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component): the left nodes of a bipartite edge table and the least one of their component."""
    nodes = edges.select(F.col(left).alias("node")).dropna().distinct()
    return nodes.join(least_reached(linked(edges, left, right)), "node", "left").select("node", F.coalesce("least", "node").alias("component"))


def components(edges: DataFrame, left: str, right: str) -> DataFrame:
    """(node, component) of a bipartite edge table; nodes are 'l:' and 'r:' names, a component is its smallest node."""
    links = staged(edges.select(F.col(left).cast("string").alias("l"), F.col(right).cast("string").alias("r")).dropna().distinct(), "links")
    of_left = staged(components_of_left(links, "l", "r"), "components")
    of_right = links.groupBy("r").agg(F.min("l").alias("node")).join(of_left, "node")
    name = F.concat(F.lit("l:"), F.col("component")).alias("component")
    return of_left.select(F.concat(F.lit("l:"), F.col("node")).alias("node"), name).unionAll(of_right.select(F.concat(F.lit("r:"), F.col("r")).alias("node"), name))


def detangled(edges: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Haplotypes of more than one sample get a child for each (``hap``), with their own name as ``parent``."""
    shared = edges.groupBy(*by, "hap").agg(F.count_distinct("sample").alias("n"))
    name = F.when(F.col("n") > 1, F.concat(F.col("hap").cast("string"), F.lit("_"), F.col("sample").cast("string"))).otherwise(F.col("hap").cast("string"))
    return edges.join(shared, [*by, "hap"]).select(*[c for c in edges.columns if c != "hap"], F.col("hap").alias("parent"), name.alias("hap"))


def retangled(edges: DataFrame) -> DataFrame:
    return edges.withColumn("hap", F.coalesce("parent", "hap")).drop("parent")


def phases(solution: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(sample, phase0, phase1): the smallest and largest haplotype of a sample's solution; three or more raise."""
    n = F.count_distinct("hap")
    two = F.when(n > 2, F.raise_error(F.lit("more than two haplotypes in a sample")).cast("int")).otherwise(n)
    return solution.groupBy(*by, "sample").agg(F.min("hap").alias("phase0"), F.max("hap").alias("phase1"), two.alias("n_haps"))


def genotypes(phased: DataFrame, hap_variant: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(variant, sample, gt): a|b from the haplotypes that hold the variant; samples without it have no row."""
    one = phased.join(hap_variant.withColumnRenamed("hap", "phase0"), [*by, "phase0"]).select(*by, "variant", "sample", F.lit(1).alias("a"), F.lit(0).alias("b"))
    two = phased.join(hap_variant.withColumnRenamed("hap", "phase1"), [*by, "phase1"]).select(*by, "variant", "sample", F.lit(0).alias("a"), F.lit(1).alias("b"))
    both = one.unionAll(two).groupBy(*by, "variant", "sample").agg(F.max("a").alias("a"), F.max("b").alias("b"))
    return both.select(*by, "variant", "sample", F.concat_ws("|", "a", "b").alias("gt"))


def divergence(edges: DataFrame, hap_variant: DataFrame | None = None, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(sample, hap, avg_weight, n_reads, variants): how far a sample's reads are from its haplotypes."""
    out = edges.groupBy(*by, "sample", "hap").agg(F.avg("weight").alias("avg_weight"), F.count(F.lit(1)).alias("n_reads"))
    if hap_variant is None:
        return out
    names = hap_variant.groupBy(*by, "hap").agg(F.array_join(F.array_sort(F.collect_set("variant")), " ").alias("variants"))
    return out.join(names, [*by, "hap"], "left")


def same_graph(a: DataFrame, b: DataFrame) -> bool:
    """Whether two edge tables name the same edges."""
    cols = ["sample", "read", "hap"]
    return a.select(cols).exceptAll(b.select(cols)).isEmpty() and b.select(cols).exceptAll(a.select(cols)).isEmpty()


def without(edges: DataFrame, gone: DataFrame, on: list[str]) -> DataFrame:
    return edges.join(gone.select(*on).distinct(), on, "left_anti").hint("merge")
