"""Assigning reads to at most two haplotypes a sample.

For a pair of haplotypes the best cost of a sample is the sum over its reads of
the cheaper one, so feasibility and the least distance are aggregations over
hap pairs of a sample.  Only the joint objective, which couples samples through
the haplotypes they share, is a search; it runs for each connected
component by itself, in an Arrow-backed grouped function.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged
from . import bipartite, clustering, opening


def _dealt(edges: DataFrame, key: list[str]) -> DataFrame:
    """``edges`` by sample, in a number of partitions that adaptive execution leaves alone: it would size them by the edges, and pairs are many times as many."""
    return edges.repartition(int(edges.sparkSession.conf.get("spark.sql.shuffle.partitions")), *key)


def _pairs(edges: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(sample, hap1, hap2, n_reads, cost, all_reads) for hap1 <= hap2: reads that either fits, the sum of the cheaper weights, and all reads of the sample.

    A read counts for each of its haplotypes and, with the dearer weight, against each pair
    of them.  All of it is grouped within a sample, so edges are dealt by sample once and pairs,
    far more than edges, need no shuffle; what follows by sample needs none either.
    """
    key = [*by, "sample"]
    fits = _dealt(edges, key).groupBy(*key, "read").agg(F.array_sort(F.collect_list(F.struct("hap", "weight"))).alias("_fits"))
    fits = fits.withColumn("_all", F.count("read").over(Window.partitionBy(*key)))
    first = fits.select(*key, "_all", "_fits", F.explode("_fits").alias("_a"))
    none = F.struct(F.lit(True).alias("own"), F.lit(None).cast(edges.schema["hap"].dataType).alias("hap"), F.col("_a.weight").alias("w"))
    later = F.transform(F.filter("_fits", lambda x: x["hap"] > F.col("_a.hap")), lambda x: F.struct(F.lit(False).alias("own"), x["hap"].alias("hap"), F.greatest(x["weight"], F.col("_a.weight")).alias("w")))
    each = first.select(*key, "_all", F.col("_a.hap").alias("hap"), F.explode(F.concat(F.array(none), later)).alias("_p"))
    sums = each.groupBy(*key, "hap", F.col("_p.own").alias("own"), F.col("_p.hap").alias("other")).agg(F.count(F.lit(1)).alias("n"), F.sum("_p.w").alias("w"), F.max("_all").alias("_all"))
    own = lambda c: F.max(F.when(F.col("own"), F.col(c)))
    shared = F.map_from_entries(F.collect_list(F.when(~F.col("own"), F.struct("other", F.struct("n", "w")))))
    x = sums.groupBy(*key, F.col("hap").alias("hap1")).agg(own("n").alias("n1"), own("w").alias("s1"), shared.alias("_shared"), F.max("_all").alias("all_reads"))
    y = sums.where("own").select(*key, F.col("hap").alias("hap2"), F.col("n").alias("n2"), F.col("w").alias("s2"))
    pairs = x.join(y.hint("merge"), key).where("hap1 <= hap2").withColumn("_both", F.try_element_at("_shared", "hap2"))
    alone = F.col("hap1") == F.col("hap2")
    total = lambda one, two, both: F.when(alone, F.col(one)).otherwise(F.col(one) + F.col(two) - F.coalesce(F.col(both), F.lit(0)))
    return pairs.select(*key, "hap1", "hap2", total("n1", "n2", "_both.n").alias("n_reads"), total("s1", "s2", "_both.w").alias("cost"), "all_reads")


def pair_costs(edges: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(sample, hap1, hap2, n_reads, cost) for hap1 <= hap2: reads that either fits, and the sum of the cheaper weights."""
    return _pairs(edges, by).drop("all_reads")


def feasible(edges: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(sample, hap1, hap2, n_reads, cost): the pair that keeps most reads; then the cheapest, with fewest haplotypes, first by name."""
    rank = Window.partitionBy(*by, "sample").orderBy(F.col("n_reads").desc(), "cost", (F.col("hap1") != F.col("hap2")).cast("int"), "hap1", "hap2")
    return pair_costs(edges, by).withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r")


def kept_reads(edges: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Edges of the reads that a best pair of their sample keeps; edges are dealt by sample once, for the pairs and for the reads."""
    key = [*by, "sample"]
    best = feasible(edges, by).select(*key, F.col("hap1").alias("_h1"), F.col("hap2").alias("_h2")).hint("merge")
    hit = F.max((F.col("hap") == F.col("_h1")) | (F.col("hap") == F.col("_h2"))).over(Window.partitionBy(*key, "read"))
    kept = _dealt(edges, key).join(best, key).withColumn("_hit", hit).where("_hit and read is not null")
    return kept.select(*edges.columns).hint("merge")  # as large as the edges may be, whatever Spark's estimate


def least_distance(edges: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(sample, hap1, hap2, cost): the cheapest pair among those that fit all reads of a sample."""
    rank = Window.partitionBy(*by, "sample").orderBy("cost", (F.col("hap1") != F.col("hap2")).cast("int"), "hap1", "hap2")
    return _full_pairs(edges, by).withColumn("_r", F.row_number().over(rank)).where("_r = 1").drop("_r", "all_reads", "n_reads")


def used_haps(pairs: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    return pairs.select(*by, F.explode(F.array("hap1", "hap2")).alias("hap")).distinct()


def pruned_to_least_distance(edges: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Edges of haplotypes that some sample's cheapest pair uses."""
    return edges.join(used_haps(least_distance(edges, by), by), [*by, "hap"], "left_semi").hint("merge")


def connected(edges: DataFrame, by: list[str]) -> DataFrame:
    """(by, sample, part) of rows (by, sample, hap): samples of a window that share haplotypes, directly or over others, have the same ``part``."""
    name = lambda c: F.concat_ws("\t", *[F.coalesce(F.col(x).cast("string"), F.lit("\0")) for x in [*by, c]])
    rows = edges.select(*by, "sample", name("sample").alias("_s"), name("hap").alias("_h")).distinct()
    rows = staged(rows, "samples_and_haps")
    parts = bipartite.components(rows, "_s", "_h").where("node like 'l:%'").select(F.substr("node", F.lit(3)).alias("_s"), F.col("component").alias("part"))
    return rows.select(*by, "sample", "_s").distinct().join(parts, "_s").drop("_s")


def _full_pairs(edges: DataFrame, by: list[str]) -> DataFrame:
    """Pairs that fit all reads of their sample; staged, they serve several of the searches below (``full``)."""
    return _pairs(edges, by).where("n_reads = all_reads")


def _arrays(pdf: pd.DataFrame, d_unit: float = 1.0) -> tuple[opening.Choice, list, np.ndarray, list[tuple]]:
    """The pairs of one component as arrays, its samples, which of them each row is of, and the pairs by name."""
    samples, names = pd.factorize(pdf["sample"], sort=True)
    haps = sorted(set(pdf["hap1"]) | set(pdf["hap2"]))
    place = {h: k for k, h in enumerate(haps)}
    pairs = sorted(set(zip(pdf["hap1"], pdf["hap2"])))
    column = {p: k for k, p in enumerate(pairs)}
    cost = np.full((len(names), len(pairs)), np.inf)
    cost[samples, [column[p] for p in zip(pdf["hap1"], pdf["hap2"])]] = pdf["cost"].astype(float) * d_unit
    return opening.Choice(cost, np.array([place[p[0]] for p in pairs]), np.array([place[p[1]] for p in pairs]), len(haps)), list(names), samples, pairs


def _per_component(full: DataFrame, component: list[str], solve: Callable[[opening.Choice, pd.DataFrame], tuple[np.ndarray | None, bool]]) -> DataFrame:
    """``solve`` for each group of pairs; an error in one of them is an error of the job, never a result.

    ``solve`` returns the column of each sample's pair, or None where no choice serves all samples (or the
    deadline came before one did): these get no pair and the status FAILED.
    """
    hap_type, sample_type = full.schema["hap1"].dataType.simpleString(), full.schema["sample"].dataType.simpleString()
    heads = ", ".join(f"{c} {full.schema[c].dataType.simpleString()}" for c in component)
    columns = [*component, "sample", "hap1", "hap2", "cost", "status"]

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        choice, names, _, pairs = _arrays(pdf)
        chosen, proven = solve(choice, pdf)
        if chosen is None:
            return pd.DataFrame([(*key, s, None, None, float("nan"), "FAILED") for s in sorted(set(pdf["sample"]))], columns=columns)
        rows = [(*key, s, *pairs[k], float(choice.cost[i, k]), "OPTIMAL" if proven else "FEASIBLE") for i, (s, k) in enumerate(zip(names, chosen))]
        return pd.DataFrame(rows, columns=columns)

    return full.groupBy(*component).applyInPandas(run, f"{heads}, sample {sample_type}, hap1 {hap_type}, hap2 {hap_type}, cost double, status string")


def units(full: DataFrame, component: list[str]) -> DataFrame:
    """(component, d_min, n_max): the least distance of a window and the haplotypes that its cheapest pairs use; zero counts as one."""
    rank = Window.partitionBy(*component, "sample").orderBy("cost", (F.col("hap1") != F.col("hap2")).cast("int"), "hap1", "hap2")
    best = full.withColumn("_r", F.row_number().over(rank)).where("_r = 1")
    found = best.groupBy(*component).agg(F.sum("cost").cast("double").alias("d_min")).join(used_haps(best, component).groupBy(*component).agg(F.count(F.lit(1)).alias("n_max")), component)
    return found.withColumn("d_min", F.when(F.col("d_min") == 0, 1.0).otherwise(F.col("d_min"))).withColumn("n_max", F.col("n_max").cast("double"))


def joint(edges: DataFrame, component: list[str], d_weight: float = 1.0, n_weight: float = 1.0, deadline: float | None = None, normalise: bool = True) -> DataFrame:
    """(component, sample, hap1, hap2, cost, status) that make the weighted sum of distance and number of haplotypes least.

    With ``normalise``, distance is in units of the least distance of the whole
    ``component`` (a window) and the number in units of the haplotypes used there
    (zero counts as one).

    A pair that costs more than a sample's cheapest one by the price of that one's
    haplotypes is in no best choice and goes.  A sample that shares no haplotype of its
    pairs with another one takes its own least value in Spark.  What is left falls
    into groups of samples that share haplotypes, and each group is a search with proof
    (``opening``).  status is OPTIMAL, or with a deadline that came first FEASIBLE or FAILED.
    """
    full = staged(_full_pairs(edges, component), "pairs")
    if normalise:
        priced = full.join(units(full, component), component).withColumns({"_d": F.lit(d_weight) / F.col("d_min"), "_n": F.lit(n_weight) / F.col("n_max")}).drop("d_min", "n_max")
    else:
        priced = full.withColumns({"_d": F.lit(float(d_weight)), "_n": F.lit(float(n_weight))})
    key = [*component, "sample"]
    two = (F.col("hap1") != F.col("hap2")).cast("int")
    rank = Window.partitionBy(*key).orderBy("cost", two, "hap1", "hap2")
    best = F.first(F.struct(F.col("cost").alias("c"), (two + 1).alias("n"), F.col("hap1").alias("a"), F.col("hap2").alias("b"))).over(rank.rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranked = priced.withColumn("_b", best)
    needed = (F.col("_d") * (F.col("cost") - F.col("_b.c")) < F.col("_n") * F.col("_b.n")) | ((F.col("hap1") == F.col("_b.a")) & (F.col("hap2") == F.col("_b.b")))
    pairs = staged(ranked.where(needed).drop("_b", "n_reads", "all_reads"), "needed_pairs")
    held = pairs.select(*key, F.explode(F.array_distinct(F.array("hap1", "hap2"))).alias("hap")).distinct()
    shared = held.groupBy(*component, "hap").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select(*component, "hap")
    tied = staged(held.join(shared, [*component, "hap"], "left_semi").select(*key).distinct(), "tied_samples")
    value = F.col("_d") * F.col("cost") + F.col("_n") * (two + 1)
    own = Window.partitionBy(*key).orderBy(value, two, "hap1", "hap2")
    alone = pairs.join(tied, key, "left_anti").withColumn("_r", F.row_number().over(own)).where("_r = 1")
    alone = alone.select(*key, "hap1", "hap2", F.col("cost").cast("double").alias("cost"), F.lit("OPTIMAL").alias("status"))
    if tied.isEmpty():
        return alone
    together = pairs.join(tied, key, "left_semi")
    grouped = together.join(connected(held.join(tied, key, "left_semi"), component), key)

    def solve(choice: opening.Choice, pdf: pd.DataFrame) -> tuple[np.ndarray | None, bool]:
        d_unit, n_unit = float(pdf["_d"].iloc[0]), float(pdf["_n"].iloc[0])
        scaled = opening.Choice(choice.cost * d_unit, choice.one, choice.two, choice.n_haps)
        found = opening.Search(scaled, price=n_unit, deadline=deadline).run()
        return found.pairs, found.proven

    return alone.unionByName(_per_component(grouped, [*component, "part"], solve).drop("part"))


#: Haplotypes up to which a window's sets of them are all tried, and numbers that this may hold.
FEW_HAPS, MOST_CELLS = 12, 1 << 22


class Curve:
    """The least distance of a component for each number of haplotypes, each asked for once.

    Few haplotypes have so few sets that trying them all proves the same as a search, in less time.
    """

    def __init__(self, choice: opening.Choice, deadline: float | None = None):
        self.choice, self.known, self.proven, self.deadline = choice, {}, True, deadline
        self.d_min = float(choice.cost.min(1).sum())
        self.sets = None
        if choice.n_haps <= FEW_HAPS and len(choice.cost) << choice.n_haps <= MOST_CELLS:
            self._try_sets()
            return
        fits = np.isfinite(choice.cost)
        self.n_min, self.least = self._fewest(fits)
        self.n_max, cheapest = self._fewest(fits & (choice.cost <= choice.cost.min(1, keepdims=True)))
        if self.n_max is not None:
            self.known[self.n_max] = (self.d_min, cheapest)

    def _try_sets(self) -> None:
        """Costs of all sets: a set of three or more holds each pair in one of the sets without its first, second or third haplotype."""
        c = self.choice
        best = np.full((1 << c.n_haps, len(c.cost)), np.inf)
        own = (1 << c.one) | (1 << c.two)
        for k, s in enumerate(own):
            best[s] = np.minimum(best[s], c.cost[:, k])
        size = np.array([int(s).bit_count() for s in range(1 << c.n_haps)])
        for s in range(1, 1 << c.n_haps):
            left = s
            for _ in range(3):
                low = left & -left
                if low and s != low:
                    np.minimum(best[s], best[s ^ low], out=best[s])
                left ^= low
        self.sets, self.size = best.sum(1), size
        serve = np.flatnonzero(np.isfinite(self.sets))
        cheapest = np.flatnonzero((best == c.cost.min(1)).all(1) & np.isfinite(self.sets))
        self.n_min, self.n_max = (int(size[serve].min()), int(size[cheapest].min())) if len(serve) else (None, None)

    def _best_set(self, n: int) -> tuple[float, np.ndarray]:
        """The cheapest set of ``n`` haplotypes at the most, of equal ones that with fewest, then the first."""
        some = np.flatnonzero(self.size <= n)
        at = some[np.lexsort((self.size[some], self.sets[some]))[0]]
        return float(self.sets[at]), self.choice.served((at >> np.arange(self.choice.n_haps)) & 1 == 1)[1]

    def _fewest(self, allowed: np.ndarray) -> tuple[int | None, np.ndarray | None]:
        """The least number of haplotypes with pairs of ``allowed`` only."""
        c = opening.Choice(np.where(allowed, 0.0, np.inf), self.choice.one, self.choice.two, self.choice.n_haps)
        found = opening.Search(c, price=1.0, deadline=self.deadline).run()
        self.proven &= found.proven
        return (None, None) if found.pairs is None else (round(found.value), found.pairs)

    def at(self, n: int) -> tuple[float, np.ndarray | None]:
        """(least distance with ``n`` haplotypes at the most, pairs); infinite where they do not serve all samples."""
        n = min(n, self.n_max) if self.n_max is not None else n
        if n not in self.known and self.sets is not None:
            self.known[n] = self._best_set(n) if self.n_min is not None and n >= self.n_min else (np.inf, None)
        if n not in self.known:
            found = opening.Search(self.choice, most=n, deadline=self.deadline).run() if self.n_min is not None and n >= self.n_min else None
            self.proven &= found is None or found.proven
            self.known[n] = (np.inf, None) if found is None else (found.value, found.pairs)
        return self.known[n]

    def count_for(self, distance: float) -> int | None:
        """The least number of haplotypes with which the distance is within ``distance``."""
        if self.n_min is None or distance < self.d_min:
            return None
        low, high = self.n_min, self.n_max
        while low < high:
            mid = (low + high) // 2
            low, high = (low, mid) if self.at(mid)[0] <= distance else (mid + 1, high)
        return low


def distance_given_count(edges: DataFrame, component: list[str], most: int, deadline: float | None = None, full: DataFrame | None = None) -> DataFrame:
    """(component, sample, hap1, hap2, cost, status): the least distance of a window with at most ``most`` haplotypes; FAILED where they serve not all samples."""

    def solve(choice: opening.Choice, _: pd.DataFrame) -> tuple[np.ndarray | None, bool]:
        curve = Curve(choice, deadline)
        return curve.at(most)[1], curve.proven

    return _per_component(_full_pairs(edges, component) if full is None else full, component, solve)


def count_given_distance(edges: DataFrame, component: list[str], more: float = 0.0, slack: float = 0.5, deadline: float | None = None, full: DataFrame | None = None) -> DataFrame:
    """(component, sample, hap1, hap2, cost, status): the fewest haplotypes of a window whose distance is within ``more`` and ``slack`` of the least one."""

    def solve(choice: opening.Choice, _: pd.DataFrame) -> tuple[np.ndarray | None, bool]:
        curve = Curve(choice, deadline)
        n = curve.count_for(curve.d_min + more + slack)
        return (None if n is None else curve.at(n)[1]), curve.proven

    return _per_component(_full_pairs(edges, component) if full is None else full, component, solve)


def golden_section(cost: Callable[[int], float], low: int, high: int, most: int = 20) -> int:
    """The place of the least value of a convex function of whole numbers, each asked for once."""
    known: dict[int, float] = {}

    def at(k: int) -> float:
        if k not in known:
            known[k] = cost(k)
        return known[k]

    for _ in range(most):
        if high - low <= 3:
            break
        a, b = round(high - 0.618034 * (high - low)), round(low + 0.618034 * (high - low))
        if a >= b:
            a, b = low + (high - low) // 2, low + (high - low) // 2 + 1
        if at(a) <= at(b):
            high = b
        else:
            low = a
    return min(range(low, high + 1), key=lambda k: (at(k), k))


def utopia(edges: DataFrame, component: list[str], d_weight: float = 1.0, n_weight: float = 1.0, deadline: float | None = None, golden: bool = False, full: DataFrame | None = None) -> DataFrame:
    """Like ``joint``, with the squared distance to (least distance, fewest haplotypes), both scaled to their ranges.

    Each range is from the least value to the one that the other's least value has,
    scaled to 1 to 2, or with ``golden`` to 0 to 1 and with the number of haplotypes
    found by golden-section search, as if the value were convex in it.  Without
    ``golden`` numbers are tried from the least one, as long as their own term
    and that of the least distance are below the best value.  Every least distance for a number
    is a search with proof, done once.  The value is no sum over samples, so a window
    is one group.
    """
    least = 0.0 if golden else 1.0

    def solve(choice: opening.Choice, _: pd.DataFrame) -> tuple[np.ndarray | None, bool]:
        curve = Curve(choice, deadline)
        if curve.n_min is None:
            return None, False
        low, high = curve.n_min, curve.n_max
        n_span, d_span = (high - low) or 1, (curve.at(low)[0] - curve.d_min) or 1.0
        term = lambda n: n_weight * (least + (n - low) / n_span) ** 2
        value = lambda n: d_weight * (least + (curve.at(n)[0] - curve.d_min) / d_span) ** 2 + term(n)
        if golden:
            best = min((golden_section(value, low, high), low, high), key=lambda n: (value(n), n))
        else:
            best = low
            for n in range(low + 1, high + 1):
                if term(n) + d_weight * least**2 >= value(best):
                    break
                best = min(best, n, key=lambda n: (value(n), n))
        return curve.at(best)[1], curve.proven

    return _per_component(_full_pairs(edges, component) if full is None else full, component, solve)


def assigned(edges: DataFrame, pairs: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(sample, read, hap, weight): every read with the cheaper haplotype of its sample's pair, the first on a tie."""
    fit = edges.join(pairs.select(*by, "sample", "hap1", "hap2"), [*by, "sample"]).where("hap = hap1 or hap = hap2")
    rank = Window.partitionBy(*by, "sample", "read").orderBy("weight", "hap")
    return fit.withColumn("_r", F.row_number().over(rank)).where("_r = 1").select(*by, "sample", "read", "hap", "weight")


def compressed(edges: DataFrame, component: list[str], d_weight: float, n_weight: float, quantum: float = 0.0) -> tuple[DataFrame, DataFrame]:
    """(smaller edges, samples and those they went into) for ``joint``.

    A haplotype worth its price goes where another one is better by that on all of a
    sample's reads; samples whose reads are clearly of one or two haplotypes keep
    these; equal reads of a sample become one, and equal and contained samples too.
    The price is in units of weight: n_weight / n_max against d_weight / d_min.
    """
    key = [*component, "sample"]
    edges = staged(edges, "edges")
    price = units(_full_pairs(edges, component), component).withColumn("_price", (F.lit(n_weight) / F.col("n_max")) / (F.lit(d_weight) / F.col("d_min"))).select(*component, "_price")
    in_prices = staged(edges.join(price, component).withColumn("weight", F.col("weight") / F.col("_price")).drop("_price"), "in_prices")
    worse = bipartite.locally_dominated(in_prices, 1.0, component)
    left = staged(bipartite.without(in_prices, worse, [*key, "hap"]), "undominated")
    one = bipartite.one_hap_samples(left, 1.0, component)
    two = bipartite.without(bipartite.two_hap_samples(left, 1.0, component), one, key)
    fixed = one.select(*key, "hap").unionAll(two.select(*key, F.explode(F.array("hap1", "hap2")).alias("hap")))
    fixed = staged(fixed, "easy")
    kept = left.select(*key, "read", "hap").join(fixed.select(*key).distinct(), key, "left_anti").unionByName(left.select(*key, "read", "hap").join(fixed, [*key, "hap"], "left_semi"))
    small, _ = bipartite.compressed_reads(staged(edges.join(kept, [*key, "read", "hap"]), "kept"), component, quantum)
    small, moved = bipartite.compressed_samples(staged(small, "fewer_reads"), component, quantum, contained=True)
    return small, moved.select(*key, "kept").distinct()


def optimize(
    edges: DataFrame, component: list[str], d_weight: float = 1.0, n_weight: float = 1.0, prune: bool = True, compress: bool = False, quantum: float = 0.0, deadline: float | None = None
) -> DataFrame:
    """(sample, read, hap, weight): drop unfit reads, prune to haplotypes of least distance, solve, assign.

    With ``compress``, haplotypes contained in others go first, and samples and reads
    are merged before the joint search; its pairs then go to all merged samples.
    Samples whose solution a ``deadline`` left unproven get no row, and so no call; without one every
    solution is proven, and the job ends with an error where it is not.
    """
    unproven = F.lit(False) if deadline is not None else F.raise_error(F.concat(F.lit("not proven optimal without a deadline: "), F.col("status"))).cast("boolean")
    proven = lambda found: found.where(F.when(F.col("status") == "OPTIMAL", F.lit(True)).otherwise(unproven))
    kept = staged(kept_reads(edges, component), "kept_reads")  # several steps read them, and each would make all pairs again
    small = kept
    if compress:
        gone = bipartite.contained_haps(kept, component, quantum)
        lone = bipartite.mandatory_haps(kept, component)
        small = staged(bipartite.without(kept, gone.join(lone.select(*component, "hap"), [*component, "hap"], "left_anti"), [*component, "hap"]), "fewer_haps")
    if prune:
        small = pruned_to_least_distance(small, component)
    if not compress:
        return assigned(kept, proven(joint(small, component, d_weight, n_weight, deadline)), component)
    small = staged(small, "pruned")
    fewer, members = compressed(small, component, d_weight, n_weight, quantum)
    pairs = proven(joint(fewer, component, d_weight, n_weight, deadline)).withColumnRenamed("sample", "kept")
    back = members.join(pairs, [*component, "kept"]).select(*component, "sample", "hap1", "hap2", "cost", "status")
    return assigned(small, back, component)


def capped_reads(edges: DataFrame, most: int, by: list[str] = []) -> DataFrame:  # noqa: B006
    """Edges of the first ``most`` reads of each sample."""
    reads = edges.select(*by, "sample", "read").distinct()
    rank = F.row_number().over(Window.partitionBy(*by, "sample").orderBy("read"))
    return edges.join(reads.withColumn("_k", rank).where(F.col("_k") <= most).drop("_k"), [*by, "sample", "read"], "left_semi")


def clustered_reads(pairs: DataFrame, group: list[str]) -> DataFrame:
    """(group, read, cluster) by correlation clustering of (group, a, b, cost): a cost under 0 pulls two reads together.

    Of least total cost in any number of reads, with proof; a cluster is named after its first
    read.  Pairs of a group are summed, so each may be given in parts or both ways.
    """
    heads = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in group)
    kind = pairs.schema["a"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        reads = sorted(set(pdf["a"]) | set(pdf["b"]))
        place = {r: k for k, r in enumerate(reads)}
        pull = np.zeros((len(reads), len(reads)))
        a, b = pdf["a"].map(place).to_numpy(), pdf["b"].map(place).to_numpy()
        np.add.at(pull, (a, b), -pdf["cost"].to_numpy(float))
        pull = pull + pull.T
        np.fill_diagonal(pull, 0.0)
        label = clustering.clusters(pull)
        return pd.DataFrame([(*key, r, reads[k]) for r, k in zip(reads, label)], columns=[*group, "read", "cluster"])

    return pairs.groupBy(*group).applyInPandas(run, f"{heads}, read {kind}, cluster {kind}")


def representative_reads(pairs: DataFrame, group: list[str], price: float) -> DataFrame:
    """(group, read, representative, cost) of least total cost, proven: each read is a representative, at ``price``, or goes to one it has a cost with.

    ``pairs`` holds (group, a, b, cost) once or both ways (the cheaper counts); a read goes to the
    cheapest representative, the first on a tie.  The search is that of ``joint``, with reads as
    haplotypes that serve alone.
    """
    heads = ", ".join(f"{c} {pairs.schema[c].dataType.simpleString()}" for c in group)
    kind = pairs.schema["a"].dataType.simpleString()

    def run(key: tuple, pdf: pd.DataFrame) -> pd.DataFrame:
        reads = sorted(set(pdf["a"]) | set(pdf["b"]))
        place = {r: k for k, r in enumerate(reads)}
        cost = np.full((len(reads), len(reads)), np.inf)
        a, b, c = pdf["a"].map(place).to_numpy(), pdf["b"].map(place).to_numpy(), pdf["cost"].to_numpy(float)
        for x, y in ((a, b), (b, a)):
            np.minimum.at(cost, (x, y), c)
        np.fill_diagonal(cost, 0.0)
        every = np.arange(len(reads))
        found = opening.Search(opening.Choice(cost, every, every, len(reads)), price=price).run().pairs
        return pd.DataFrame([(*key, r, reads[k], cost[i, k]) for i, (r, k) in enumerate(zip(reads, found))], columns=[*group, "read", "representative", "cost"])

    return pairs.groupBy(*group).applyInPandas(run, f"{heads}, read {kind}, representative {kind}, cost double")


def centroid_reads(pairs: DataFrame, group: list[str]) -> DataFrame:
    """(group, read, total): the read nearest to all others by summed cost, the first on a tie; ``pairs`` holds a < b once."""
    both = pairs.select(*group, "a", "b", "cost").unionAll(pairs.select(*group, F.col("b").alias("a"), F.col("a").alias("b"), "cost"))
    total = both.groupBy(*group, F.col("a").alias("read")).agg(F.sum("cost").alias("total"))
    return total.groupBy(*group).agg(F.min(F.struct("total", "read")).alias("m")).select(*group, "m.read", "m.total")
