from __future__ import annotations

import pytest
from helixframe.functions.register import register_functions
from helixframe.sources import readers, writers
from pyspark.sql import functions as F


def _file(folder, name, text):
    path = folder / name
    path.write_text(text)
    return str(path)


VCF = "##fileformat=VCFv4.3\n#CHROM\tPOS\tID\tREF\tALT\tQUAL\tFILTER\tINFO\tFORMAT\ts1\ts2\nchr2\t5\tb\tA\t<DEL>\t.\tPASS\tEND=9\tGT\t0/1\t./.\nchr1\t3\ta\tA\tACC\t10\tPASS\tSVLEN=2\tGT\t1|1\t0/0\n"


def test_vcf_round_trip(spark, tmp_path):
    path = _file(tmp_path, "x.vcf", VCF)
    assert readers.vcf_samples(spark, path) == ["s1", "s2"]
    df = readers.vcf(spark, path)
    assert [(r.contig, r.pos, r.qual, r.genotypes) for r in df.orderBy("contig").collect()] == [("chr1", 3, 10.0, ["1|1", "0/0"]), ("chr2", 5, None, ["0/1", "./."])]
    assert readers.vcf(spark, path, 1).first().genotypes == ["0/1"] and readers.vcf(spark, path, 0).first().genotypes == []
    writers.write_vcf(df, str(tmp_path / "out"), ["s1", "s2"], redundant=F.col("id") == "b")
    lines = [r.value for r in spark.read.text(str(tmp_path / "out")).collect()]
    head, body = [x for x in lines if x[0] == "#"], [x for x in lines if x[0] != "#"]
    assert head[-1].endswith("FORMAT\ts1\ts2")
    assert sorted(body) == ["chr1\t3\ta\tA\tACC\t10\tPASS\tSVLEN=2\tGT\t1|1\t0/0", "chr2\t5\tb\tA\t<DEL>\t.\tPASS\tREDUNDANT=true;END=9\tGT\t./.\t./."]


def test_bed_fasta_manifest(spark, tmp_path):
    bed = readers.bed(spark, _file(tmp_path, "a.bed", "chr1\t1\t100\textra\n\nchr2\t2\t200\n"))
    assert [tuple(r) for r in bed.collect()] == [("chr1", 1, 100), ("chr2", 2, 200)]
    fasta = readers.fasta(spark, _file(tmp_path, "a.fasta", ">a\nAA\nAA\n>c x\nCCCC\nCCCC\n"))
    assert {tuple(r) for r in fasta.collect()} == {("a", "AAAA"), ("c", "CCCCCCCC")}
    assert [tuple(r) for r in readers.bam_manifest(spark, _file(tmp_path, "m.csv", "s1,/x.bam\n")).collect()] == [("s1", "/x.bam")]
    with pytest.raises(Exception, match="two columns"):
        readers.bam_manifest(spark, _file(tmp_path, "n.csv", "s1,/x.bam,3\n")).collect()
    with pytest.raises(Exception, match="carriage return"):
        readers.bed(spark, _file(tmp_path, "b.bed", "chr1\t1\t2\rx\n")).collect()


def test_graph_formats(spark, tmp_path):
    gaf = readers.gaf(spark, _file(tmp_path, "a.gaf", "q\t10\t0\t10\t-\t>a<b\t20\t1\t11\t9\t10\t60\ttp:A:S\tcg:Z:5=1X4=\n")).first()
    assert [(s.node, s.rev) for s in gaf.path] == [("b", False), ("a", True)] and gaf.cigar == "5=1X4=" and not gaf.is_primary
    path = _file(tmp_path, "a.gfa", "S\ta\tAC\nS\tb\tG\nL\ta\t+\tb\t-\t0M\nP\tp\ta+,b-\t*\n")
    nodes, edges, steps = readers.gfa_nodes(spark, path), readers.gfa_edges(spark, path), readers.gfa_paths(spark, path)
    assert {(r.node, r.node_id) for r in readers.gfa_node_ids(nodes).collect()} == {("a", 1), ("b", 2)}
    as_edge = edges.select(F.struct("a", "a_rev", "b", "b_rev").alias("edge"))
    assert [r.value for r in writers.gfa_lines(nodes, as_edge, steps).collect()] == ["S\ta\tAC", "S\tb\tG", "L\ta\t+\tb\t-\t0M", "P\tp\ta+,b-\t*"]


def test_sam_and_fastq(spark, tmp_path):
    path = _file(tmp_path, "a.sam", "@HD\tVN:1\nr1\t16\tchr1\t11\t60\t3M\t*\t0\t0\tACG\tIII\tNM:i:0\nr2\t4\t*\t0\t0\t*\t*\t0\t0\tA\tI\n")
    rows = readers.sam(spark, path).collect()
    assert [(r.qname, r.ref_start, r.is_reverse, r.tags["NM:i"]) for r in rows] == [("r1", 10, True, "0")]
    df = spark.createDataFrame([("r", "AC", [0, 40], True)], "name string, seq string, quality array<int>, is_reverse boolean")
    assert writers.fastq_lines(df).first().value == "@r R\nAC\n+\n!I"


def test_window_folders(spark, tmp_path):
    for name, ok in (("chr1_10-20", 1), ("chr1_30-40", 0)):
        (tmp_path / name).mkdir()
        (tmp_path / name / "log.csv").write_text(f"name,h,m,s,ms,success,notes\nx,0,0,1,0,{ok},\n")
        (tmp_path / name / "haps.csv").write_text("name,length\nh,5\n")
    got = readers.window_files(spark, str(tmp_path), "haps.csv", "name string, length int").collect()
    assert [(r.contig, r.start, r.stop, r.name) for r in got] == [("chr1", 10, 20, "h")]


def test_sql_functions(spark):
    register_functions(spark)
    row = spark.sql("SELECT reverse_complement('AACg') a, info_value('CIEND=1;END=5', 'END') b, mate_contig('A[chr3:7[') c, mate_pos('A[chr3:7[') d, quantized(12D, 5D) e, identity_bin(1D) f, ploidy('chrX') g, length_bin(7) h").first()
    assert tuple(row) == ("cGTT", "5", "chr3", 7, 10.0, 5, 1, 3)


def test_sql_functions_equal_the_column_builders(spark):
    from helixframe.functions import sequences as S
    from helixframe.functions import vcf as V
    from pyspark.sql import functions as F

    register_functions(spark)
    alts = ["A", "<DEL>", "A[chr3:7[", "ATT]CHR1:900]", "[c:5[GA", "]c:5]CCA", ".TA", "TA.", "<INS:ME>", ".", "*", "", None, "x[y"]
    gts = ["0|1:9", "./.", "1/2", "0", "", ".|1", "0/0:3", None, "1|1"]
    infos = ["END=5;PRECISE", "CIEND=1;END=7", "PRECISE", "", None, "A;B=2;C", "IMPRECISE;X=1"]
    paths = [">a<b", "<b>a", ">x", "<10>2", ">a>b>a", None]
    size = max(map(len, (alts, gts, infos, paths)))
    rows = [(k, alts[k % len(alts)], gts[k % len(gts)], infos[k % len(infos)], paths[k % len(paths)], ["chr1", "X", "chrM", None][k % 4], k % 7) for k in range(size * 3)]
    df = spark.createDataFrame(rows, "id int, alt string, genotype string, info string, path string, contig string, n int")
    df.createOrReplaceTempView("cells")
    text = lambda c: S.path_text(S.canonical_path(S.graph_path(c)))
    built = {
        "symbolic": (V.is_symbolic("alt"), "is_symbolic_alt(alt)"), "missing": (V.is_missing_alt("alt"), "is_missing_alt(alt)"), "precise": (V.is_precise("info"), "is_precise(info)"), "end": (V.info_value("info", "END"), "info_value(info, 'END')"),
        "tag": (V.symbolic_tag("alt", "id", "n"), "symbolic_tag(alt, id, n)"), "untag": (V.symbolic_untag(V.symbolic_tag("alt", "id", "n")), "symbolic_untag(symbolic_tag(alt, id, n))"), "ploidy": (V.ploidy("contig"), "ploidy(contig)"),
        "gp": (V.gt("genotype")["ploidy"], "gt_ploidy(genotype)"), "h1": (V.gt("genotype")["hap1"], "gt_allele(genotype, 1)"), "h2": (V.gt("genotype")["hap2"], "gt_allele(genotype, 2)"), "nr": (V.n_calls("genotype")["ref"], "n_ref_calls(genotype)"),
        "na": (V.n_calls("genotype")["alt"], "n_alt_calls(genotype)"), "phased": (V.is_phased("genotype"), "is_phased(genotype)"), "mc": (V.mate_contig("alt"), "mate_contig(alt)"), "mp": (V.mate_pos("alt"), "mate_pos(alt)"),
        "single": (V.is_single_breakend("alt"), "is_single_breakend(alt)"), "valid": (V.is_valid_breakend("alt"), "is_valid_breakend(alt)"), "side": (V.orientation("alt"), "breakend_side(alt)"), "mside": (V.mate_orientation("alt"), "mate_side(alt)"),
        "bases": (V.inserted_sequence("alt"), "breakend_bases(alt)"), "canon": (F.when(F.col("path").isNotNull(), text(F.coalesce("path", F.lit(">z")))), "canonical_path(path)"), "region": (S.region_text("contig", "id", "n"), "region_text(contig, id, n)"),
        "ident": (S.identity(F.col("n"), F.col("id"), F.lit(0), F.lit(0)), "alignment_identity(n, id, 0, 0)"), "pad": (S.padded("n", 4), "zero_padded(n, 4)"), "score": (S.alignment_score(F.col("n") / 10), "alignment_score(n / 10D)"), "lb": (S.length_bin("id"), "length_bin(id)"),
    }
    a = df.select("id", *[c.alias(k) for k, (c, _) in built.items()]).orderBy("id").collect()
    b = spark.sql("SELECT id, " + ", ".join(f"{sql} AS `{k}`" for k, (_, sql) in built.items()) + " FROM cells ORDER BY id").collect()
    for x, y in zip(a, b):
        assert x.asDict() == y.asDict()


def test_table_functions_in_lateral_joins(spark):
    from helixframe.operators import alignments

    register_functions(spark)
    spark.sql("SELECT * FROM VALUES (1, '>a<b>a', 'END=5;FLAG;AF=0.5', '3=2I1X4D', 10), (2, '<z', '', '5S', 0) AS t(id, path, info, cigar, pos)").createOrReplaceTempView("rows")
    steps = spark.sql("SELECT id, s.* FROM rows, LATERAL path_steps(path) s ORDER BY id, step").collect()
    assert [tuple(r) for r in steps] == [(1, 0, "a", False), (1, 1, "b", True), (1, 2, "a", False), (2, 0, "z", True)]
    assert {tuple(r) for r in spark.sql("SELECT id, f.* FROM rows, LATERAL info_fields(info) f").collect()} == {(1, "END", "5"), (1, "AF", "0.5")}
    ops = spark.sql("SELECT id, o.* FROM rows, LATERAL cigar_operations(cigar, pos) o ORDER BY id, op_rank").collect()
    want = alignments.exploded(spark.table("rows"), "cigar", "pos", None).select("id", "op_rank", "op", "op_len", "r0", "r1", "q0", "q1").orderBy("id", "op_rank").collect()
    assert [tuple(r) for r in ops] == [tuple(r) for r in want] and len(ops) == 5
