from __future__ import annotations

import random

import pytest
from helixframe.operators import intervals
from pyspark.sql import functions as F

from .conftest import TESTDATA

ONE = "contig string, start int, stop int"


def test_components_join_labels(spark):
    rows = [("c", -1, 9, ["a"]), ("c", 0, 10, ["b"]), ("c", 0, 10, ["c"]), ("c", 10, 20, ["d"]), ("c", 11, 20, ["e"]), ("c", 21, 25, ["f"]), ("c", 22, 26, ["g"])]
    out = intervals.components(spark.createDataFrame(rows, ONE + ", l array<string>"), "contig", "start", "stop", "l").collect()
    assert sorted((r.start, r.stop, r.labels) for r in out) == [(-1, 20, ["a", "b", "c", "d", "e"]), (21, 26, ["f", "g"])]


def test_start_after_stop_raises(spark):
    with pytest.raises(Exception, match="start exceeds stop"):
        intervals.components(spark.createDataFrame([("c", 11, 0, ["a"])], ONE + ", l array<string>"), "contig", "start", "stop", "l").collect()


@pytest.mark.parametrize(("rows", "want"), [([(0, 10), (2, 8)], [(0, 2), (2, 8), (8, 10)]), ([(0, 10), (5, 15)], [(0, 5), (5, 10), (10, 15)]), ([(0, 10)], [(0, 10)]), ([(0, 5), (7, 9)], [(0, 5), (7, 9)])])
def test_atomic_segments(spark, rows, want):
    df = spark.createDataFrame([("c", a, b) for a, b in rows], ONE)
    assert sorted((r.seg_start, r.seg_stop) for r in intervals.atomic_segments(df, "contig", "start", "stop").collect()) == want


def test_overlaps_are_averaged(spark):
    df = spark.createDataFrame([("a", 0, 10, 10.0, 0.0), ("a", 5, 15, 0.0, 10.0)], ONE + ", m double, x double")
    out = intervals.averaged_over_segments(df, "contig", "start", "stop", ["m", "x"]).orderBy("seg_start").collect()
    assert [(r.seg_start, r.seg_stop, r.m, r.x) for r in out] == [(0, 5, 5, 0), (5, 10, 2.5, 2.5), (10, 15, 0, 5)]


@pytest.mark.parametrize("closed", [True, False])
@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_interval_join_equals_all_pairs(spark, closed, how):
    r = random.Random(1)
    make = lambda n: [("ab"[r.randrange(2)], a, a + r.randrange(30)) for a in (r.randrange(200) for _ in range(n))]
    left, right = make(60), make(40)
    a = spark.createDataFrame([(i, *x) for i, x in enumerate(left)], "id int, contig string, ls int, le int")
    b = spark.createDataFrame([(i, *x) for i, x in enumerate(right)], "rid int, contig string, rs int, re int")
    hit = lambda x, y: x[0] == y[0] and (max(x[1], y[1]) <= min(x[2], y[2]) if closed else max(x[1], y[1]) < min(x[2], y[2]))
    pairs = [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if hit(x, y)]
    out = intervals.interval_join(a, b, ["contig"], "ls", "le", "rs", "re", closed, 16, how)
    some = {i for i, _ in pairs}
    if how == "inner":
        assert sorted((x.id, x.rid) for x in out.collect()) == sorted(pairs)
    elif how == "left":
        assert sorted((x.id, -1 if x.rid is None else x.rid) for x in out.collect()) == sorted(pairs + [(i, -1) for i in range(60) if i not in some])
    else:
        assert sorted(x.id for x in out.collect()) == sorted(some if how == "left_semi" else set(range(60)) - some)


@pytest.mark.parametrize("how", ["inner", "left"])
@pytest.mark.parametrize("closed", [True, False])
def test_long_and_short_intervals_meet_in_levels(spark, how, closed):
    r = random.Random(9)
    make = lambda n: [(a, a + r.choice([0, 3, 20, 300, 5000])) for a in (r.randrange(6000) for _ in range(n))]
    left, right = make(120), make(90)
    a = spark.createDataFrame([(i, "c", *x) for i, x in enumerate(left)] + [(500, "c", None, None)], "id int, contig string, ls int, le int")
    b = spark.createDataFrame([(i, "c", *x) for i, x in enumerate(right)], "rid int, contig string, rs int, re int")
    want = [(i, j) for i, x in enumerate(left) for j, y in enumerate(right) if (max(x[0], y[0]) <= min(x[1], y[1]) if closed else max(x[0], y[0]) < min(x[1], y[1]))]
    found = intervals.interval_join(a, b, ["contig"], "ls", "le", "rs", "re", closed, 16, how, levels=3)
    got = sorted((x.id, -1 if x.rid is None else x.rid) for x in found.collect())
    alone = [(i, -1) for i in [*range(120), 500] if i not in {i for i, _ in want}] if how == "left" else []
    assert got == sorted(want + alone) and len(found.columns) == 7
    # an interval of 5,000 bases has rows in the bins of the levels it belongs to only
    assert intervals._binned(a.where("le - ls = 5000").limit(1), "ls", "le", 16, levels=4).count() <= 2 + 5000 // (16 * 512)


def test_islands_keep_the_gap_out(spark):
    df = spark.createDataFrame([("c", 0, 5), ("c", 7, 9), ("c", 20, 30), ("c", 1, 40), ("d", 3, 4)], ONE)
    out = sorted((r.contig, r.start, r.stop, r.n) for r in intervals.islands(df.where("start != 1"), "contig", "start", "stop", 2).collect())
    assert out == [("c", 0, 9, 2), ("c", 20, 30, 1), ("d", 3, 4, 1)]


def test_chunks_divide_ranks(spark):
    df = spark.range(103).select(F.col("id").alias("k"))
    got = dict(intervals.chunked(df, ["k"], 10).collect())
    assert got == {k: k // 10 for k in range(103)}


def test_nearest_takes_the_lower_of_equals(spark):
    q = spark.createDataFrame([(0, "c", 5), (1, "c", 6), (2, "c", 100), (3, "x", 1)], "id int, contig string, at int")
    p = spark.createDataFrame([("c", 4), ("c", 8), ("c", 6)], "contig string, p int")
    assert sorted((r.id, r.nearest) for r in intervals.nearest_point(q, p, "contig", "at", "p").collect()) == [(0, 4), (1, 6), (2, 8), (3, None)]


def test_islands_go_on_over_partitions(spark):
    """One contig over many partitions, against a scan."""
    import random

    from helixframe.operators import intervals

    r = random.Random(3)
    rows = sorted((s, s + r.randrange(40)) for s in (r.randrange(9000) for _ in range(900)))
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    got = {(x.start, x.stop, x.n) for x in intervals.islands(spark.createDataFrame([("c", *x) for x in rows], "contig string, start int, stop int"), "contig", "start", "stop", 3).collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    want, now = set(), None
    for s, e in rows:
        if now and s <= now[1] + 3:
            now = (now[0], max(now[1], e), now[2] + 1)
        else:
            want |= {now} if now else set()
            now = (s, e, 1)
    assert got == want | {now}


def test_segments_and_nearest_points_go_on_over_partitions(spark):
    """One contig and a third of another over many partitions, against scans."""
    import random

    r = random.Random(4)
    spans = [("cd"[k % 3 == 0], s, s + 1 + r.randrange(60)) for k, s in ((k, r.randrange(5000)) for k in range(400))]
    asked = [(k, "cde"[k % 3], r.randrange(-50, 5200)) for k in range(300)]
    points = [(c, s) for c, s, _ in spans]
    spark.conf.set("spark.sql.shuffle.partitions", 13)
    segs = {tuple(x) for x in intervals.atomic_segments(spark.createDataFrame(spans, "contig string, start int, stop int"), "contig", "start", "stop").collect()}
    q, p = spark.createDataFrame(asked, "id int, contig string, at int"), spark.createDataFrame(points, "contig string, p int")
    near = {(x.id, x.nearest) for x in intervals.nearest_point(q, p, "contig", "at", "p").collect()}
    spark.conf.set("spark.sql.shuffle.partitions", 4)
    want = set()
    for c in "cd":
        ends = sorted({e for k, s, t in spans if k == c for e in (s, t)})
        for a, b in zip(ends, ends[1:]):
            depth = sum(k == c and s <= a and b <= t for k, s, t in spans)
            want |= {(c, a, b, depth)} if depth else set()
    assert segs == want
    assert near == {(k, min((s for d, s in points if d == c), key=lambda s: (abs(s - at), s), default=None)) for k, c, at in asked}


def test_islands_of_rows_without_a_contig(spark):
    """Over several partitions, where carried totals meet: 3,000 separate intervals stay apart, with and without a contig."""
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        df = spark.range(3000).select(F.when(F.lit(True), F.lit(None).cast("string")).alias("contig"), (F.col("id") * 10).alias("start"), (F.col("id") * 10 + 5).alias("stop"))
        both = df.unionAll(df.withColumn("contig", F.lit("c")))
        found = {r.contig: r.n for r in intervals.islands(both, "contig", "start", "stop").groupBy("contig").agg(F.count(F.lit(1)).alias("n")).collect()}
        assert found == {None: 3000, "c": 3000}
        assert {r.contig: r.m for r in intervals.sorted_intervals(both, "contig", "start", "stop").groupBy("contig").agg(F.max("rank").alias("m")).collect()} == {None: 3000, "c": 3000}
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)


def test_equal_intervals_fall_into_several_partitions(spark):
    df = spark.range(20_000).select(F.lit("c").alias("contig"), F.lit(5).alias("start"), F.lit(9).alias("stop"))
    dealt = intervals.dealt(df.repartition(4), "contig", "start", "stop")
    assert [(r.start, r.stop, r.n) for r in intervals.islands(df, "contig", "start", "stop").collect()] == [(5, 9, 20_000)]
    assert dealt.count() == 20_000


@pytest.mark.parametrize("how", ["inner", "left", "left_semi", "left_anti"])
def test_rows_without_an_interval(spark, how):
    a = spark.createDataFrame([(1, "c", 0, 5), (2, "c", None, None), (3, None, 0, 5), (4, "c", 50, None), (5, "c", 90, 95)], "id int, contig string, ls int, le int")
    b = spark.createDataFrame([(1, "c", 4, 8), (2, "c", None, 3), (3, None, 0, 9)], "rid int, contig string, rs int, re int")
    found = sorted(r.id for r in intervals.interval_join(a, b, ["contig"], "ls", "le", "rs", "re", True, 16, how).collect())
    assert found == {"inner": [1], "left": [1, 2, 3, 4, 5], "left_semi": [1], "left_anti": [2, 3, 4, 5]}[how]


def test_nothing_is_divided_by_zero(spark):
    from helixframe.operators import metrics

    targets = spark.createDataFrame([("c", 5, 5), ("c", 0, 10)], ONE)
    tracks = spark.createDataFrame([("c", 0, 5)], "contig string, t_start int, t_stop int")
    assert sorted((r.start, r.covered) for r in intervals.covered_fraction(targets, tracks, "contig", "start", "stop").collect()) == [(0, 0.5), (5, 0.0)]
    blocks = spark.createDataFrame([("n", 0, 0, 0, 0, 0, 0, 0)], "node string, b0 int, b1 int, length int, m int, x int, i int, d int")
    assert [(r.coverage, r.identity) for r in metrics.coverage_and_identity(blocks, ["node"], "b0", "b1", "length", ("m", "x", "i", "d")).collect()] == [(0.0, 0.0)]
    found = spark.createDataFrame([("t", 1, 0.95, 0.95)], "tool string, k int, coverage double, identity double")
    assert [tuple(r) for r in metrics.recall(spark.createDataFrame([], "k int"), found, ["k"], ["tool"]).collect()] == [("t", 0, 0, None)]


def test_balanced_classes_over_partitions(spark):
    from helixframe.operators import metrics

    df = spark.range(1000).select(F.when(F.col("id") < 900, "a").when(F.col("id") < 960, "b").alias("k"), (F.col("id") * 7919 % 1000).alias("v"))
    found = metrics.balanced(df, "k", 10, F.col("v")).collect()
    want = {k: sorted(x * 7919 % 1000 for x in ids)[:40] for k, ids in (("a", range(900)), ("b", range(900, 960)), (None, range(960, 1000)))}
    assert {k: sorted(r.v for r in found if r.k == k) for k in want} == want


def test_windows_are_counted_without_joining_them_back(spark):
    """What is carried from part to part is broadcast, so rows stay where they are; the one merge join left is that of the intervals."""
    from helixframe.plans import queries

    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        numbered = intervals.numbered_islands(queries.T.intervals(spark, TESTDATA), "contig", "start", "stop", 2)
        assert "SortMergeJoin" not in numbered._jdf.queryExecution().executedPlan().toString()
        counted = queries.windows_with_record_counts(spark, TESTDATA)
        assert counted._jdf.queryExecution().executedPlan().toString().count("SortMergeJoin") == 1
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
