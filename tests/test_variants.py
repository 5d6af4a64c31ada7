from __future__ import annotations

import pytest
from helixframe.functions import sequences as S
from helixframe.functions import vcf as V
from helixframe.operators import alignments, graph, variants
from helixframe.plans import workflows
from pyspark.sql import functions as F

REC = "id string, contig string, pos int, ref string, alt string, info string"


def test_types_and_breakends(spark):
    rows = [("1", "c", 5, "A", "AT", ""), ("2", "c", 5, "AT", "A", ""), ("3", "c", 5, "A", "T", ""), ("4", "c", 5, "AT", "GC", ""), ("5", "c", 5, "A", "<INS:ME>", ""), ("6", "c", 5, "A", "A]chr2:9]", ""), ("7", "c", 5, "A", "<X>", ""), ("8", "c", 5, "A", "*", ""), ("9", "c", 5, "A", "C", "SVTYPE=DUP;SVLEN=-40")]
    df = spark.createDataFrame(rows, REC).withColumn("k", V.sv_type("info", "ref", "alt"))
    out = {r.id: (r.k, r.n) for r in df.withColumn("n", V.sv_length("k", "info", "pos", "ref", "alt")).collect()}
    assert out == {"1": (1, 1), "2": (2, 1), "3": (8, 1), "4": (6, 2), "5": (1, None), "6": (5, None), "7": (None, None), "8": (None, None), "9": (4, 40)}


@pytest.mark.parametrize(("alt", "mate"), [("A[c2:9[", "]c1:5]T"), ("]c2:9]A", "T[c1:5["), ("[c2:9[A", "[c1:5[T"), ("A]c2:9]", "T]c1:5]"), ("AGG[c2:9[", "]c1:5]GGT")])
def test_mates(spark, alt, mate):
    df = spark.createDataFrame([(alt,)], "alt string")
    assert df.select(V.mate_alt(F.lit("c1"), F.lit(5), "alt", F.lit("T"))).first()[0] == mate


def test_cleaned_breakends(spark):
    rows = [("d", "c", 10, "A", "<DEL>", "SVTYPE=DEL;SVLEN=-100"), ("v", "c", 10, "A", "<INV>", "SVTYPE=INV;SVLEN=100"), ("s", "c", 10, "A", "<DEL>", "SVTYPE=DEL;SVLEN=-5"), ("b", "c", 10, "A", "A[e:7[", "SVTYPE=BND"), ("i", "c", 10, "A", "A" + "C" * 60 + "G", "SVTYPE=INS"), ("x", "c", 10, "A", "A[broken", "SVTYPE=BND")]
    bases = spark.createDataFrame([("c", 10, "a"), ("c", 11, "C"), ("c", 110, "G"), ("c", 111, "T"), ("e", 7, "G")], "contig string, pos int, base string")
    out = {}
    for r in variants.cleaned_breakends(spark.createDataFrame(rows, REC), bases, 50, 3).collect():
        out.setdefault(r.source, set()).add((r.contig, r.pos, r.ref, r.alt))
    assert out == {
        "d": {("c", 10, "A", "A[c:111["), ("c", 111, "T", "]c:10]T")},
        "v": {("c", 10, "A", "A]c:110]"), ("c", 110, "G", "G]c:10]"), ("c", 11, "C", "[c:111[C"), ("c", 111, "T", "[c:11[T")},
        "s": {("c", 10, "A", "<DEL>")}, "b": {("c", 10, "A", "A[e:7["), ("e", 7, "G", "]c:10]G")},
        "i": {("c", 10, "A", "ACCC."), ("c", 11, "C", ".CCGC")},
    }


def test_features(spark):
    df = spark.createDataFrame([("pbsv.1", "c", 5, "A", "AT", "STDEV_POS=2", 7.0, "GT:AD:DP", ["1/0:3,4:9"])], REC + ", qual double, format string, genotypes array<string>")
    r = variants.base_features(df).first()
    assert [r[c] for c in variants.FEATURES] == [7, 0, 2, 1, 2, 1, 0, 0, 0, 0, 0, 1, 0]
    assert variants.sample_features(df, "svjedi").first().features == [0, 1, 9, 3, 4, 0]


def _gotoh(a, b, x=4, o=6, e=2):
    inf = 10**9
    m = [[inf] * (len(b) + 1) for _ in range(len(a) + 1)]
    d, i = [r[:] for r in m], [r[:] for r in m]
    m[0][0] = 0
    for p in range(len(a) + 1):
        for q in range(len(b) + 1):
            if p:
                d[p][q] = min(min(m[p - 1][q], i[p - 1][q]) + o + e, d[p - 1][q] + e)
            if q:
                i[p][q] = min(min(m[p][q - 1], d[p][q - 1]) + o + e, i[p][q - 1] + e)
            if p and q:
                m[p][q] = min(m[p - 1][q - 1], d[p - 1][q - 1], i[p - 1][q - 1]) + (0 if a[p - 1] == b[q - 1] else x)
    return min(m[-1][-1], d[-1][-1], i[-1][-1])


def test_gap_affine_equals_a_plain_programme():
    import random

    r = random.Random(3)
    for _ in range(150):
        a, b = ("".join(r.choice("ACGT") for _ in range(r.randrange(14))) for _ in range(2))
        assert alignments.gap_affine(a, b)[0] == _gotoh(a, b)


def test_reads_over_windows(spark):
    rows = [("r", "c", 100, False, "2S10=3I10=", "TT" + "A" * 10 + "GGG" + "C" * 10), ("v", "c", 100, True, "20=", "A" * 5 + "C" * 15)]
    df = spark.createDataFrame(rows, "read string, contig string, ref_start int, is_reverse boolean, cigar string, seq string")
    win = spark.createDataFrame([("c", 105, 115)], "contig string, ws int, we int")
    clipped = alignments.on_windows(alignments.exploded(df), win, "contig", "ws", "we")
    spans = alignments.read_spans(clipped, ["read", "is_reverse", "ws"], "ws", "we")
    got = {r.read: r.sub for r in alignments.sub_sequences(spans, df, ["read"]).collect()}
    assert got == {"r": "AAAAAGGGCCCCC", "v": "GGGGGGGGGG"}
    near = {r.read: r.q_at for r in alignments.inner_coordinates(clipped.withColumn("t", F.lit(110)), ["read"], "t").collect()}
    assert near == {"r": 12, "v": 5}  # both ends are as near: the smaller query place


REFERENCE = "ACGTACGTAA" + "CCCCCGGGGG" + "TTTTTACGTA" + "CGTAGGCCAA"


def _merge_inputs(spark):
    records = workflows.typed_records(spark.createDataFrame([("del", "c", 10, "A" + REFERENCE[10:20], "A", ""), ("ins", "c", 25, "T", "TGAGAGAGA", "")], REC))
    windows = spark.createDataFrame([("c:10-25", "c", 5, 35)], "window_id string, contig string, win_start int, win_stop int")
    reference = spark.createDataFrame([("c", REFERENCE)], "contig string, seq string")
    whole = REFERENCE[5:35]
    cut = REFERENCE[5:10] + REFERENCE[20:35]
    long = REFERENCE[5:25] + "GAGAGAGA" + REFERENCE[25:35]
    reads = [("s1", f"a{k}", whole) for k in range(3)] + [("s1", f"b{k}", cut) for k in range(3)] + [("s2", f"c{k}", long) for k in range(4)]
    return records, windows, spark.createDataFrame([("c:10-25", *x) for x in reads], "window_id string, sample string, read string, seq string"), reference


def test_merge_genotypes_samples(spark):
    records, windows, reads, reference = _merge_inputs(spark)
    config = workflows.MergeConfig(flank_length=5, min_sv_length=2)
    calls = {(r.record, r.sample): r.gt for r in workflows.merge(records, windows, reads, reference, config).collect()}
    assert set(calls) == {("del", "s1"), ("ins", "s2")}
    assert calls["ins", "s2"] == "1|1" and sorted(calls["del", "s1"].split("|")) == ["0", "1"]


def test_windows_of_records(spark):
    records = workflows.typed_records(spark.createDataFrame([("a", "c", 1000, "A", "<DEL>", "SVLEN=-50"), ("b", "c", 1100, "A", "<DEL>", "SVLEN=-50"), ("z", "c", 90_000, "A", "<DEL>", "SVLEN=-50")], REC))
    tandems = spark.createDataFrame([("c", 1120, 1300), ("c", 50_000, 50_100)], "contig string, start int, stop int")
    kept, omitted = workflows.find_windows(records, tandems, workflows.MergeConfig(), spark.createDataFrame([("c", 90_100)], "contig string, length int"))
    assert [(r.start, r.stop) for r in kept.collect()] == [(1000, 1300)]
    assert [(r.start, r.stop) for r in omitted.collect()] == [(90_000, 90_050)]


def test_paths_as_replacements(spark):
    haps = spark.createDataFrame([("w", "h", "AACCGGTT"), ("w", "r", "AACCTT")], "window_id string, hap string, seq string")
    ref = spark.createDataFrame([("w", 100, "AACCTT")], "window_id string, start int, seq string")
    r = graph.path_replacements(haps, ref).collect()
    assert len(r) == 1 and (r[0].hap, r[0].ref, r[0].alt) == ("h", "C", "CGG") and r[0].pos == 104


def test_small_expressions(spark):
    one = spark.range(1)
    row = one.select(
        S.region_of(F.lit("chr1:10-20")).alias("r"), S.path_text(S.canonical_path(S.graph_path(F.lit(">b>a")))).alias("p"), S.duration_parts(F.lit(3_723_004)).alias("d"),
        S.identity(F.lit(0), F.lit(0), F.lit(0), F.lit(0)).alias("i"), V.symbolic_untag(V.symbolic_tag(F.lit("<DEL>"), F.lit(9), F.lit(5))).alias("u"), V.caller_of(F.lit("x.PBSV.1"), ["pav", "pbsv"]).alias("c"),
    ).first()
    assert (row.r.contig, row.r.start, row.p, row.i, row.u, row.c) == ("chr1", 10, "<a<b", None, "<DEL>", "pbsv")
    assert (row.d.h, row.d.m, row.d.s, row.d.ms) == (1, 2, 3, 4)
    with pytest.raises(Exception, match="not a nucleotide"):
        one.select(S.reverse_complement(F.lit("AZ"))).collect()


def test_stream_ingest(spark, tmp_path):
    from helixframe.streaming.windows import ingest

    src = str(tmp_path / "src")
    spark.createDataFrame([("c", 1), ("c", 1), ("d", 2)], "contig string, pos int").write.parquet(src)
    for _ in range(2):
        q = ingest(spark.readStream.schema("contig string, pos int").parquet(src), str(tmp_path / "out"), ["contig", "pos"], str(tmp_path / "ck"))
        q.awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


def test_merge_of_aligned_walks_equals_all_walks(spark):
    records, windows, reads, reference = _merge_inputs(spark)
    config = workflows.MergeConfig(flank_length=5, min_sv_length=2)
    g = workflows.window_graphs(records, windows, reference, config)
    _, steps = workflows.haplotypes(g)
    every = {tuple(r) for r in workflows.merge(records, windows, reads, reference, config, paths=steps).collect()}
    assert {tuple(r) for r in workflows.merge(records, windows, reads, reference, config).collect()} == every
    haps, _ = workflows.aligned_haplotypes(g, reads)
    assert haps.count() == 3 and workflows.aligned_haplotypes(g, reads, min_coverage=4)[0].count() == 1


def test_haplotypes_as_records(spark):
    records, windows, reads, reference = _merge_inputs(spark)
    config = workflows.MergeConfig(flank_length=5, min_sv_length=2)
    g = workflows.window_graphs(records, windows, reference, config)
    haps, steps = workflows.aligned_haplotypes(g, reads)
    name = {r.seq: r.hap for r in haps.collect()}
    whole, cut, long = REFERENCE[5:35], REFERENCE[5:10] + REFERENCE[20:35], REFERENCE[5:25] + "GAGAGAGA" + REFERENCE[25:35]
    solution = spark.createDataFrame([("c:10-25", s, f"{s}{k}", name[x]) for k, (s, x) in enumerate([("s1", whole), ("s1", cut), ("s2", long), ("s2", long)])], "window_id string, sample string, read string, hap string")
    found = workflows.haplotype_records(solution, steps, g, ["s1", "s2", "s3"], 5).collect()
    ids = {h: k for k, h in enumerate(sorted(name.values()))}
    low = ids[name[cut]] < ids[name[whole]]
    assert {(r.contig, r.pos, r.id, r.ref, r.alt, tuple(r.genotypes)) for r in found} == {
        ("c", 10, f"c_10_{ids[name[cut]]}", REFERENCE[9:30], REFERENCE[9:10] + REFERENCE[20:30], ("1|0" if low else "0|1", "0|0", "0|0")),
        ("c", 10, f"c_10_{ids[name[long]]}", REFERENCE[9:30], REFERENCE[9:25] + "GAGAGAGA" + REFERENCE[25:30], ("0|0", "1|1", "0|0")),
    }
    three = solution.unionAll(spark.createDataFrame([("c:10-25", "s1", "x", name[long])], solution.schema))
    with pytest.raises(Exception, match="more than two haplotypes"):
        workflows.haplotype_records(three, steps, g, ["s1"], 5).collect()


def test_solutions_as_records(spark):
    records = spark.createDataFrame([(1, "c"), (2, "c")], "id int, contig string")
    calls = spark.createDataFrame([("1", "a", "0|1"), ("1", "b", "1|1")], "record string, sample string, gt string")
    assert [(r.id, r.genotypes, r.format) for r in workflows.solution_records(records, calls, ["b", "x", "a"]).collect()] == [(1, ["1|1", "0|0", "0|1"], "GT")]
