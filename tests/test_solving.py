from __future__ import annotations

import itertools
import random
import time

import numpy as np
import pytest
from helixframe.operators import assign, bipartite, clustering, opening
from helixframe.plans import tables as T
from helixframe.plans.workflows import MergeConfig, solve

from .conftest import TESTDATA

EDGES = "sample string, read string, hap string, weight double"


def _random(seed, samples=3, reads=4, haps=5, full=0.8):
    r = random.Random(seed)
    return [(f"s{s}", f"s{s}r{k}", f"h{h}", float(r.randint(1, 9))) for s in range(samples) for k in range(reads) for h in range(haps) if h == 0 or r.random() < full]


def _pairs(rows, sample):
    w = {}
    for s, r, h, x in rows:
        if s == sample:
            w.setdefault(r, {})[h] = x
    haps = sorted({h for v in w.values() for h in v})
    for a, b in itertools.combinations_with_replacement(haps, 2):
        fit = [min(x for x in (v.get(a), v.get(b)) if x is not None) for v in w.values() if a in v or b in v]
        yield (a, b), len(fit), sum(fit), len(w)


@pytest.mark.parametrize("seed", range(3))
def test_feasibility_and_least_distance(spark, seed):
    rows = _random(seed, full=0.5)
    df = spark.createDataFrame(rows, EDGES)
    best = {r.sample: (r.n_reads, r.cost) for r in assign.feasible(df).collect()}
    least = {r.sample: r.cost for r in assign.least_distance(df).collect()}
    for s in {x[0] for x in rows}:
        every = list(_pairs(rows, s))
        n = max(x[1] for x in every)
        assert best[s] == (n, min(x[2] for x in every if x[1] == n))
        assert least[s] == min(x[2] for x in every if x[1] == x[3])


def test_joint_equals_all_choices(spark):
    seeds = {f"w{seed}": _random(seed, haps=4) for seed in range(4)}
    df = spark.createDataFrame([(w, *x) for w, rows in seeds.items() for x in rows], "window string, " + EDGES)
    found = assign.joint(df, ["window"], 1.0, 3.0, normalise=False).collect()
    assert {r.status for r in found} == {"OPTIMAL"}
    for w, rows in seeds.items():
        got = [r for r in found if r.window == w]
        value = sum(r.cost for r in got) + 3.0 * len({h for r in got for h in (r.hap1, r.hap2)})
        choices = [[(p, c) for p, n, c, every in _pairs(rows, s) if n == every] for s in sorted({x[0] for x in rows})]
        want = min(sum(c for _, c in some) + 3.0 * len({h for p, _ in some for h in p}) for some in itertools.product(*choices))
        assert value == pytest.approx(want)


def _choice(costs: np.ndarray, haps: int) -> opening.Choice:
    one, two = np.array(list(itertools.combinations_with_replacement(range(haps), 2))).T
    return opening.Choice(costs.astype(float), one, two, haps)


def _all_sets(choice: opening.Choice):
    """(haplotypes, cost) of every set of them."""
    for bits in range(1, 2**choice.n_haps):
        open_ = np.array([bits >> k & 1 for k in range(choice.n_haps)], bool)
        yield int(open_.sum()), choice.served(open_)[0]


@pytest.mark.parametrize("seed", range(12))
def test_searches_equal_all_sets(seed):
    r = np.random.default_rng(seed)
    haps, samples = int(r.integers(2, 8)), int(r.integers(1, 12))
    costs = r.integers(0, 40, (samples, haps * (haps + 1) // 2)).astype(float)
    costs[r.random(costs.shape) < 0.2 * (seed % 3)] = np.inf
    costs[:, -1] = np.where(np.isinf(costs).all(1), 50, costs[:, -1])
    choice = _choice(costs, haps)
    sets = list(_all_sets(choice))
    for price in (0.0, 0.5, 7.0, 60.0):
        found = opening.Search(choice, price=price).run()
        assert found.proven and found.value == pytest.approx(min(c + price * n for n, c in sets))
    curve = assign.Curve(choice)
    for n in range(1, haps + 1):
        assert curve.at(n)[0] == pytest.approx(min((c for m, c in sets if m <= n), default=np.inf))
    for distance in (curve.d_min, curve.d_min + 5, curve.d_min + 100):
        assert curve.count_for(distance) == min(m for m, c in sets if c <= distance + 1e-9)


def _cohort(samples: int, haps: int, seed: int, reads: int = 12) -> np.ndarray:
    """Costs of samples with two true haplotypes each, read by noisy reads."""
    r = np.random.default_rng(seed)
    one, two = np.array(list(itertools.combinations_with_replacement(range(haps), 2))).T
    apart = r.integers(5, 60, (haps, haps))
    apart = (apart + apart.T) // 2
    np.fill_diagonal(apart, 0)
    often, out = r.dirichlet(np.ones(haps) * 0.7), []
    for _ in range(samples):
        true = r.choice(haps, 2, p=often)
        w = (1 + np.maximum(0, apart[true[np.arange(reads) % 2]] + r.integers(-3, 4, (reads, haps)))) ** 1.2
        out.append(np.minimum(w[:, one], w[:, two]).sum(0).round())
    return np.array(out)


@pytest.mark.parametrize("samples,haps", [(30, 12), (40, 15), (300, 30), (1074, 12)])
def test_cohorts_are_proven_without_a_deadline(samples, haps):
    began = time.monotonic()
    choice = _choice(_cohort(samples, haps, samples), haps)
    scaled = opening.Choice(choice.cost / choice.cost.min(1).sum(), choice.one, choice.two, haps)
    for price in (0.05, 0.3):
        assert opening.Search(scaled, price=price).run().proven
    curve = assign.Curve(choice)
    ds = [curve.at(n)[0] for n in range(curve.n_min, curve.n_min + 4)]
    assert curve.proven and ds == sorted(ds, reverse=True) and time.monotonic() - began < 60


def test_unproven_solutions_say_so():
    found = opening.Search(_choice(np.random.default_rng(9).integers(1, 99, (60, 300)), 24), price=50.0, deadline=0.0).run()
    assert not found.proven and found.pairs is not None


def test_a_cohort_gets_calls(spark):
    r = random.Random(4)
    true = {s: (r.randrange(6), r.randrange(6)) for s in range(60)}
    rows = [("w", s, f"{s}_{k}", f"h{h}", float(1 + 9 * abs(h - true[s][k % 2]) + r.randint(0, 2))) for s in true for k in range(6) for h in range(10)]
    df = spark.createDataFrame(rows, "window string, sample long, read string, hap string, weight double")
    plain = {(x.sample, x.read): x.hap for x in assign.optimize(df, ["window"], n_weight=0.1).collect()}
    assert len(plain) == 360
    assert sum(plain[s, f"{s}_{k}"] == f"h{true[s][k % 2]}" for s in true for k in range(6)) >= 300
    assert len(assign.optimize(df, ["window"], n_weight=0.1, compress=True).collect()) == 360


def test_distance_and_count_of_windows(spark):
    rows = {f"w{seed}": _random(seed, samples=4, reads=3, haps=5, full=1.0) for seed in range(3)}
    df = spark.createDataFrame([(w, *x) for w, some in rows.items() for x in some], "window string, " + EDGES)
    for n in (1, 2, 3):
        found = assign.distance_given_count(df, ["window"], n).collect()
        for w, some in rows.items():
            costs = [{p: c for p, m, c, every in _pairs(some, s) if m == every} for s in sorted({x[0] for x in some})]
            want = min(sum(min(c for p, c in one.items() if set(p) <= set(haps)) for one in costs) for haps in itertools.combinations([f"h{h}" for h in range(5)], n))
            got = [r for r in found if r.window == w]
            assert sum(r.cost for r in got) == want and {r.status for r in got} == {"OPTIMAL"} and len({h for r in got for h in (r.hap1, r.hap2)}) <= n
    fewest = assign.count_given_distance(df, ["window"], more=2.0).collect()
    for w, some in rows.items():
        costs = [{p: c for p, m, c, every in _pairs(some, s) if m == every} for s in sorted({x[0] for x in some})]
        least = sum(min(one.values()) for one in costs)
        serves = lambda haps: sum(min((c for p, c in one.items() if set(p) <= set(haps)), default=1e9) for one in costs) <= least + 2.5  # noqa: B023, E731
        want = min(n for n in range(1, 6) for haps in itertools.combinations([f"h{h}" for h in range(5)], n) if serves(haps))
        got = [r for r in fewest if r.window == w]
        assert len({h for r in got for h in (r.hap1, r.hap2)}) == want


@pytest.mark.parametrize("golden", [False, True])
def test_utopia_equals_all_sets(spark, golden):
    rows = {f"w{seed}": _random(seed, samples=4, reads=3, haps=5) for seed in range(4)}
    df = spark.createDataFrame([(w, *x) for w, some in rows.items() for x in some], "window string, " + EDGES)
    found = assign.utopia(df, ["window"], 1.0, 2.0, golden=golden).collect()
    for w, some in rows.items():
        costs = [{p: c for p, m, c, every in _pairs(some, s) if m == every} for s in sorted({x[0] for x in some})]
        by_n = {}
        for n in range(1, 6):
            for haps in itertools.combinations([f"h{h}" for h in range(5)], n):
                d = sum(min((c for p, c in one.items() if set(p) <= set(haps)), default=float("inf")) for one in costs)
                by_n[n] = min(by_n.get(n, float("inf")), d)
        ok = [n for n in by_n if by_n[n] < float("inf")]
        low, d_min = min(ok), min(by_n.values())
        high = min(n for n in ok if by_n[n] == d_min)
        off = 0.0 if golden else 1.0
        value = lambda d, n: (off + (d - d_min) / ((by_n[low] - d_min) or 1)) ** 2 + 2 * (off + (n - low) / ((high - low) or 1)) ** 2  # noqa: B023, E731
        got = [r for r in found if r.window == w]
        reached = value(sum(r.cost for r in got), len({h for r in got for h in (r.hap1, r.hap2)}))
        assert reached == pytest.approx(min(value(by_n[n], n) for n in range(low, high + 1)))


def test_contained_samples(spark):
    def reads(sample, *haps):
        return [(sample, f"{sample}{k}", h, w) for k, (h, w) in enumerate(haps)]

    x, y, z = ("x", 1.0), ("y", 2.0), ("z", 3.0)
    rows = reads("a", x, x) + reads("b", x, x, y) + reads("c", x, y) + reads("d", x, x, y, z) + reads("e", x, x, x) + reads("f", y, z)
    rows += [("g", "g1", "x", 1.0), ("g", "g1", "y", 1.0), ("h", "h1", "x", 1.0), ("h", "h1", "y", 1.0), ("h", "h2", "z", 3.0)]
    df = spark.createDataFrame(rows, EDGES)
    found = {r.sample: r.container for r in bipartite.contained_samples(df).collect()}
    assert found == {"a": "b", "b": "d", "c": "d"}  # e has more x, f is after d, g's read fits two haplotypes
    small, moved = bipartite.compressed_samples(df, contained=True)
    assert {(r.sample, r.kept) for r in moved.select("sample", "kept").distinct().collect()} == {("a", "d"), ("b", "d"), ("c", "d"), *((s, s) for s in "defgh")}
    weight = {(r.read, r.hap): r.weight for r in small.where("sample = 'd'").collect()}
    assert weight == {("d0", "x"): 4.0, ("d1", "x"): 3.0, ("d2", "y"): 6.0, ("d3", "z"): 3.0}


def test_three_haps_in_a_sample_lose_a_read(spark):
    rows = [("s", f"r{k}", f"h{k}", 1.0) for k in range(3)]
    assert assign.kept_reads(spark.createDataFrame(rows, EDGES)).count() == 2


def test_golden_section_equals_a_scan():
    r = random.Random(37)
    for _ in range(3000):
        slope, shift, up, n = r.uniform(1, 100), r.uniform(0.1, 5), r.uniform(0.01, 3), r.randint(1, 200)
        cost = lambda k: slope / (k + shift) + up * k  # noqa: B023, E731
        best = min(range(n), key=lambda k: (cost(k), k))  # noqa: B023
        assert cost(assign.golden_section(cost, 0, n - 1)) == pytest.approx(cost(best))


def test_optimize_and_utopia_assign_all_fit_reads(spark):
    df = spark.createDataFrame([("w", *x) for x in _random(5)], "window string, " + EDGES)
    for compress in (False, True):
        out = assign.optimize(df, ["window"], compress=compress).collect()
        assert len({r.read for r in out}) == len(out) == 12
        assert all(len({r.hap for r in out if r.sample == s}) <= 2 for s in ("s0", "s1", "s2"))
    for golden in (False, True):
        assert assign.utopia(df, ["window"], golden=golden).count() == 3


def test_solver_tables(spark):
    rows = [("s", f"r{k}", 10, f"p{h}", 10, float(abs(k % 2 - h) * 5 + 1)) for k in range(4) for h in range(2)]
    df = spark.createDataFrame(rows, "sample string, read string, read_length int, path string, path_length int, weight double")
    got = solve(df, MergeConfig(n_weight=0.01)).collect()
    assert {(r.read, r.hap) for r in got} == {(f"r{k}", f"p{k % 2}") for k in range(4)}
    assert solve(df, MergeConfig(), max_reads=2, quadratic=True).count() == 2


def test_traversals(spark):
    rows = [("HG1", "r1", "a", 2.0), ("HG1", "r1", "b", 1.0), ("HG2", "r2", "b", 1.0), ("HG2", "r2", "c", 2.0), ("HG2", "r3", "b", 1.0)]
    df = spark.createDataFrame(rows, EDGES)
    assert {(r.hap, r.sample) for r in bipartite.samples_of_hap(df).collect()} == {("a", "HG1"), ("b", "HG1"), ("b", "HG2"), ("c", "HG2")}
    assert bipartite.reads_with_two_samples(df).count() == 0
    tangled = bipartite.detangled(df)
    assert {r.hap for r in tangled.collect()} == {"a", "b_HG1", "b_HG2", "c"}
    assert bipartite.same_graph(bipartite.retangled(tangled), df)


def test_components_of_reads_and_haps(spark):
    rows = [("s", f"r{k}", f"h{k // 3}") for k in range(9)] + [("s", f"chain{k}", f"c{j}") for k in range(20) for j in (k, k + 1)]
    df = spark.createDataFrame(rows, "sample string, read string, hap string")
    found = bipartite.components(df, "read", "hap").collect()
    assert len({r.component for r in found}) == 4 and len(found) == 9 + 3 + 20 + 21


def test_compressed_samples_come_back(spark):
    rows = [(s, f"{s}{r}", h, w) for s in ("a", "b") for r, h, w in (("1", "x", 1.0), ("2", "y", 2.0))] + [("c", "c1", "x", 3.0)]
    small, moved = bipartite.compressed_samples(spark.createDataFrame(rows, EDGES))
    assert {(r.sample, r.hap, r.weight) for r in small.collect()} == {("a", "x", 2.0), ("a", "y", 4.0), ("c", "x", 3.0)}
    out = bipartite.decompressed_samples(small, moved).collect()
    assert {(r.sample, r.read, r.hap) for r in out} == {(s, r, h) for s, r, h, _ in rows}


def test_clusters_and_centroids(spark):
    near = [("g", "a", "b", -5.0), ("g", "a", "c", 4.0), ("g", "b", "c", 4.0), ("g", "c", "d", -3.0), ("g", "a", "d", 4.0), ("g", "b", "d", 4.0)]
    df = spark.createDataFrame(near, "grp string, a string, b string, cost double")
    assert {(r.read, r.cluster) for r in assign.clustered_reads(df, ["grp"]).collect()} == {("a", "a"), ("b", "a"), ("c", "c"), ("d", "c")}
    apart = spark.createDataFrame([("g", "a", "b", 1.0), ("g", "b", "c", 1.0), ("g", "a", "c", 2.0)], "grp string, a string, b string, cost double")
    assert [(r.read, r.total) for r in assign.centroid_reads(apart, ["grp"]).collect()] == [("b", 2.0)]


def _partitions(n):
    """All partitions of n reads, as labels of first members."""
    if n == 0:
        yield []
        return
    for rest in _partitions(n - 1):
        for k in sorted(set(rest)):
            yield [*rest, k]
        yield [*rest, n - 1]


@pytest.mark.parametrize("seed", range(8))
def test_clusters_equal_all_partitions(seed):
    r = np.random.default_rng(seed)
    n = 9 if seed == 0 else int(r.integers(2, 8))
    pull = np.triu(r.integers(-9, 10, (n, n)).astype(float), 1) * (r.random((n, n)) < 0.9)
    pull = pull + pull.T
    value = lambda label: sum(pull[a, b] for a in range(n) for b in range(a) if label[a] == label[b])
    label = clustering.clusters(pull)
    assert value(label) == pytest.approx(max(map(value, _partitions(n))))
    assert all(label[k] == min(np.flatnonzero(label == label[k])) for k in range(n))


def test_clusters_of_many_noisy_reads():
    r = np.random.default_rng(5)
    true = r.integers(0, 4, 60)
    pull = np.where(true[:, None] == true[None, :], 5.0, -5.0) * np.where(r.random((60, 60)) < 0.06, -0.4, 1.0)
    pull = np.triu(pull, 1)
    label = clustering.clusters(pull + pull.T)
    assert all((label[a] == label[b]) == (true[a] == true[b]) for a in range(60) for b in range(a))


@pytest.mark.parametrize("seed", range(3))
def test_representatives_equal_all_choices(spark, seed):
    r = random.Random(seed)
    rows = [(g, f"r{a}", f"r{b}", float(r.randint(1, 9))) for g in "xy" for a in range(7) for b in range(a) if r.random() < 0.6]
    df = spark.createDataFrame(rows, "grp string, a string, b string, cost double")
    for price in (0.5, 4.0, 12.0):
        found = assign.representative_reads(df, ["grp"], price).collect()
        for g in "xy":
            cost = {(a, b): c for h, x, y, c in rows if h == g for a, b in ((x, y), (y, x))}
            reads = sorted({a for a, _ in cost})
            value = lambda some: price * len(some) + sum(min([cost.get((a, b), float("inf")) for b in some]) for a in reads if a not in some)  # noqa: B023, E731
            want = min(value(some) for n in range(1, len(reads) + 1) for some in itertools.combinations(reads, n))
            got = [x for x in found if x.grp == g]
            assert sum(x.cost for x in got) + price * len({x.representative for x in got}) == pytest.approx(want)
            assert all(x.cost == (0 if x.read == x.representative else cost[x.read, x.representative]) for x in got)


def test_edges_of_a_cohort_are_not_broadcast(spark):
    """An exploded table and a semi-joined one look as small as the orders to Spark, so the driver held them whole."""
    from helixframe.plans import solver_queries

    edges = solver_queries.cohort(spark, "/root/testdata/sf0.001")
    for of in (edges, assign.kept_reads(edges, ["win"]), assign.pruned_to_least_distance(edges, ["win"])):
        assert "BroadcastHashJoin" not in assign.pair_costs(of, ["win"])._jdf.queryExecution().executedPlan().toString()


def test_pairs_of_a_sample_are_shuffled_as_edges_only(spark):
    edges = spark.createDataFrame([(s, f"{s}{r}", h, r + k) for s in "ab" for r in range(3) for k, h in enumerate("xyz")], "sample string, read string, hap string, weight int")
    best = assign.feasible(edges)
    assert best._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") <= 2  # one each for both sides of a join, the same one
    assert [(r.sample, r.hap1, r.hap2, r.n_reads, r.cost) for r in best.orderBy("sample").collect()] == [("a", "x", "x", 3, 3), ("b", "x", "x", 3, 3)]


def test_edges_stay_dealt(spark):
    """Adaptive execution would make one partition of these."""
    edges = T.edges(spark, TESTDATA)
    assert edges.rdd.getNumPartitions() == T.spread(T.table(spark, TESTDATA, "lineitem")) >= 16
    for found in (bipartite.locally_dominated(edges, 5.0), bipartite.one_hap_samples(edges, 5.0), bipartite.two_hap_samples(edges, 5.0), bipartite.compressed_reads(edges)[0]):
        assert found.rdd.getNumPartitions() == 4


def test_components_shuffle_links_between_left_nodes_only(spark):
    """A right node of one left node links nothing, and chains in the order of names end in a few rounds."""
    rows = [(k, 1000 + k) for k in range(50)] + [(k + 1, 1000 + k) for k in range(49)] + [(100, 5), (200, 6), (300, 6), (200, 6), (300, 7), (150, 7), (None, 6)]
    df = spark.createDataFrame(rows, "a long, b long")
    assert {(r.u, r.v) for r in bipartite.linked(df.where("a >= 100"), "a", "b").collect()} == {(200, 300), (150, 300)}
    found = {r.node: r.component for r in bipartite.components_of_left(df, "a", "b").collect()}
    assert found == {**{k: 0 for k in range(50)}, 100: 100, 150: 150, 200: 150, 300: 150}


def test_components_of_random_links(spark):
    r = random.Random(3)
    rows = [(r.randrange(120), r.randrange(100)) for _ in range(130)]
    least = {a: a for a, _ in rows}
    for _ in rows:
        of = {}
        for a, b in rows:
            of[b] = min(of.get(b, a), least[a])
        for a, b in rows:
            least[a] = min(least[a], of[b])
    found = bipartite.components_of_left(spark.createDataFrame(rows, "a long, b long"), "a", "b").collect()
    assert {x.node: x.component for x in found} == least


def test_curves_of_few_haps_try_all_sets(monkeypatch):
    r = np.random.default_rng(5)
    for k in range(12):
        haps = int(r.integers(2, 6))
        one, two = np.array([(i, j) for i in range(haps) for j in range(i, haps)]).T
        cost = np.where(r.random((5, len(one))) < 0.3, np.inf, r.integers(1, 30, (5, len(one))).astype(float))
        tried = assign.Curve(opening.Choice(cost, one, two, haps))
        assert tried.sets is not None
        with monkeypatch.context() as m:
            m.setattr(assign, "FEW_HAPS", 0)
            searched = assign.Curve(opening.Choice(cost, one, two, haps))
            assert (tried.n_min, tried.n_max) == (searched.n_min, searched.n_max)
            assert [tried.at(n)[0] for n in range(1, haps + 1)] == [searched.at(n)[0] for n in range(1, haps + 1)]


def test_an_error_in_a_component_is_an_error_of_the_job(spark):
    """It used to be rows without pairs, whose windows then went missing from what optimize assigns."""
    from pyspark.errors import PythonException

    df = spark.createDataFrame([(w, *x) for w in "ab" for x in _random(1, haps=3)], "window string, " + EDGES)
    full = assign._full_pairs(df, ["window"])

    def solve(choice, pdf):
        if pdf["window"].iloc[0] == "b":
            raise ValueError("no result for b")
        return opening.Search(choice, price=1.0).run().pairs, True

    with pytest.raises(PythonException, match="no result for b"):
        assign._per_component(full, ["window"], solve).collect()


@pytest.mark.parametrize("compress", [False, True])
def test_optimize_leaves_no_window_out(spark, monkeypatch, compress):
    """Without a deadline a solution that is not proven is an error, not a window less."""
    from pyspark.sql import functions as F

    df = spark.createDataFrame([(w, *x) for w in "ab" for x in _random(1, haps=3)], "window string, " + EDGES)
    joint = assign.joint
    monkeypatch.setattr(assign, "joint", lambda *a, **k: joint(*a, **k).withColumn("status", F.when(F.col("window") == "b", "FAILED").otherwise(F.col("status"))))
    with pytest.raises(Exception, match="not proven optimal"):
        assign.optimize(df, ["window"], compress=compress).collect()
    assert {r.window for r in assign.optimize(df, ["window"], compress=compress, deadline=60.0).collect()} == {"a"}


def test_kept_reads_and_full_pairs_are_dealt_by_sample_alone(spark):
    """Reads were shuffled again to find those that a pair keeps, and to count those of a sample."""
    import re

    rows = [("a", 1, "x", 1), ("a", 1, "y", 2), ("a", 2, "z", 1), ("a", 3, "x", 4), ("b", 1, "x", 1), ("b", 4, "y", 1), ("b", 5, "z", 1)]
    edges = spark.createDataFrame(rows, "sample string, read int, hap string, weight int")
    kept, full = assign.kept_reads(edges), assign._full_pairs(edges, [])
    for found in (kept, full):
        plan = found._jdf.queryExecution().executedPlan().toString()
        assert {re.sub(r"#\d+L?", "", x) for x in re.findall(r"Exchange hashpartitioning\(([^)]*), \d+\)", plan)} == {"sample"}
    assert sorted((r.sample, r.read) for r in kept.select("sample", "read").distinct().collect()) == [("a", 1), ("a", 2), ("a", 3), ("b", 1), ("b", 4)]
    assert [(r.sample, r.hap1, r.hap2, r.cost, r.all_reads) for r in full.collect()] == [("a", "x", "z", 6, 3)]
