"""Variant-record expressions: types, lengths, coordinates, genotypes, breakends.

Every function builds a Column from Columns, so Catalyst compiles it with the
rest of the plan.  Unknown values are null; sentinels appear only in writers.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Numbers of the record types, and the INFO / ALT labels of each (fixed values).
TYPES = {"INS": 1, "DEL": 2, "INV": 3, "DUP": 4, "BND": 5, "REPLACEMENT": 6, "CNV": 7, "SNP": 8}
LABELS = {
    "INS": ["INS", "INS:ME", "INS:NOVEL"],
    "DEL": ["DEL", "DEL:ME"],
    "DUP": ["DUP", "DUP:TANDEM", "DUP:INT"],
    "INV": ["INV"],
    "BND": ["BND"],
    "CNV": ["CNV"],
}
BRACKET = r"[\[\]]([^\[\]]*):(\d+)[\[\]]"


def _c(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def info_map(info: Column | str) -> Column:
    """key=value pairs as a map; flags without a value are left out, of repeated keys the first counts."""
    pairs = F.filter(F.split(_c(info), ";"), lambda p: F.instr(p, "=") > 1)
    keys = F.transform(pairs, lambda p: F.substring_index(p, "=", 1))
    first = F.filter(F.transform(pairs, lambda p, i: F.when(F.array_position(keys, F.substring_index(p, "=", 1)) == i + 1, p)), lambda p: p.isNotNull())
    return F.map_from_entries(F.transform(first, lambda p: F.struct(F.substring_index(p, "=", 1).alias("key"), F.substr(p, F.instr(p, "=") + 1).alias("value"))))


def info_value(info: Column | str, key: str) -> Column:
    """The value of one key, by whole-key match; null if missing."""
    found = F.regexp_extract(F.concat(F.lit(";"), _c(info)), f";{key}=([^;]*)", 1)
    return F.nullif(found, F.lit(""))


def is_symbolic(alt: Column | str) -> Column:
    return _c(alt).rlike("^<.*>$")


def is_missing_alt(alt: Column | str) -> Column:
    return _c(alt).isNull() | _c(alt).isin(".", "*", "")


def is_breakend_alt(alt: Column | str) -> Column:
    return _c(alt).rlike(r"[\[\]]") | _c(alt).rlike(r"^\.[A-Za-z]+$") | _c(alt).rlike(r"^[A-Za-z]+\.$")


def _labelled(label: Column) -> Column:
    """The type of a label, which is looked at once."""
    known = [F.lit(x) for t in LABELS for label_ in LABELS[t] for x in (label_, TYPES[t])]
    return F.try_element_at(F.create_map(*known), F.upper(label))


def once(df: DataFrame, **columns: Column) -> DataFrame:
    """``df`` with columns that are computed once a row however often they are used; a projection would be copied into each use."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(name) for name, c in columns.items()]))))


def sv_type(info: Column | str, ref: Column | str, alt: Column | str) -> Column:
    """INFO SVTYPE, else a symbolic ALT, else brackets, else what REF and ALT spell; null if unsupported."""
    ref, alt, told = _c(ref), _c(alt), info_value(info, "SVTYPE")
    same = F.upper(F.left(ref, F.lit(1))) == F.upper(F.left(alt, F.lit(1)))
    r, a = F.length(ref), F.length(alt)
    spelled = (
        F.when((r == 1) & (a == 1), TYPES["SNP"])
        .when((r == 1) & (a > 1) & same, TYPES["INS"])
        .when((a == 1) & (r > 1) & same, TYPES["DEL"])
        .otherwise(TYPES["REPLACEMENT"])
    )
    by_alt = F.when(is_missing_alt(alt), F.lit(None)).when(is_symbolic(alt), _labelled(F.regexp_extract(alt, "^<(.*)>$", 1))).when(is_breakend_alt(alt), TYPES["BND"]).otherwise(spelled)
    return F.when(told.isNotNull(), _labelled(told)).otherwise(by_alt).cast("tinyint")


def sv_length(kind: Column | str, info: Column | str, pos: Column | str, ref: Column | str, alt: Column | str) -> Column:
    """An insertion's spelled length, else |SVLEN|, else END - POS, else what REF and ALT spell; null if unknown."""
    kind, ref, alt = _c(kind), _c(ref), _c(alt)
    told, end = F.abs(info_value(info, "SVLEN").try_cast("int")), info_value(info, "END").try_cast("int") - _c(pos)
    plain = ~is_symbolic(alt) & ~is_breakend_alt(alt)
    return (
        F.when((kind == TYPES["INS"]) & plain, F.length(alt) - 1)
        .when(told > 0, told)
        .when(end > 0, end)
        .when(~plain, F.lit(None))
        .when(kind == TYPES["DEL"], F.length(ref) - 1)
        .when(kind == TYPES["SNP"], 1)
        .when(kind == TYPES["REPLACEMENT"], F.length(ref))
    )


def confidence(info: Column | str, what: str) -> Column:
    """struct<lo,hi> of CIPOS, CILEN or CIEND (``what`` is POS, LEN or END), else three standard deviations, else zero."""
    both = F.split(info_value(info, f"CI{what}"), ",")
    told = F.struct(F.try_element_at(both, F.lit(1)).try_cast("double").alias("lo"), F.try_element_at(both, F.lit(2)).try_cast("double").alias("hi"))
    dev = 3 * info_value(info, f"STDEV_{what}").try_cast("double")
    zero = F.lit(0.0)
    return F.when(told["lo"].isNotNull() & told["hi"].isNotNull(), told).when(dev.isNotNull(), F.struct((-dev).alias("lo"), dev.alias("hi"))).otherwise(F.struct(zero.alias("lo"), zero.alias("hi")))


def is_precise(info: Column | str) -> Column:
    return F.concat(F.lit(";"), _c(info), F.lit(";")).contains(";PRECISE;")


def coordinates(kind: Column | str, pos: Column | str, length: Column | str, info: Column | str | None = None) -> Column:
    """struct<first,second>: the zero-based place on the reference, widened by the confidence interval where ``info`` is given."""
    kind, pos, length = _c(kind), _c(pos), _c(length)
    zero = F.struct(F.lit(0.0).alias("lo"), F.lit(0.0).alias("hi"))
    cp, cl = (zero, zero) if info is None else (confidence(info, "POS"), confidence(info, "LEN"))
    down, up = lambda x, c: F.floor(x + c["lo"]).cast("int"), lambda x, c: F.ceil(x + c["hi"]).cast("int")
    pair = lambda a, b: F.struct(a.cast("int").alias("first"), b.cast("int").alias("second"))
    nothing = F.lit(None).cast("int")
    return (
        F.when(kind == TYPES["INS"], pair(down(pos, cp), up(pos, cp)))
        .when((kind == TYPES["BND"]) & (pos > 0), pair(down(pos - 1, cp), up(pos - 1, cp)))
        .when(kind.isin(TYPES["DEL"], TYPES["INV"], TYPES["DUP"], TYPES["CNV"]), pair(down(pos, cp), F.when(length.isNull(), nothing).otherwise(up(pos + length, cl))))
        .when(kind == TYPES["REPLACEMENT"], pair(pos - 1, pos - 1 + length))
        .when(kind == TYPES["SNP"], pair(pos - 1, pos))
    )


def alleles(genotype: Column | str) -> Column:
    """Allele strings of the GT part of a sample column."""
    return F.split(F.translate(F.substring_index(_c(genotype), ":", 1), "|", "/"), "/")


def gt_of(found: Column | str) -> Column:
    """struct<ploidy,hap1,hap2> of allele strings; missing alleles are null."""
    a = _c(found)
    number = lambda k: F.try_element_at(a, F.lit(k)).try_cast("int")
    return F.struct(F.when(a[0] == "", 0).otherwise(F.size(a)).alias("ploidy"), number(1).alias("hap1"), number(2).alias("hap2"))


def calls_of(found: Column | str) -> Column:
    """struct<ref,alt> of allele strings: haplotypes that carry the reference and another allele."""
    a = _c(found)
    return F.struct(F.size(F.filter(a, lambda x: x == "0")).alias("ref"), F.size(F.filter(a, lambda x: ~x.isin("0", ".", ""))).alias("alt"))


def gt(genotype: Column | str) -> Column:
    return gt_of(alleles(genotype))


def n_calls(genotype: Column | str) -> Column:
    return calls_of(alleles(genotype))


def is_phased(genotype: Column | str) -> Column:
    call = F.substring_index(_c(genotype), ":", 1)
    return ~call.contains("/")


def haplotype_counts(genotypes: Column | str) -> Column:
    """struct<ref,alt> over an array of sample columns."""
    calls = F.transform(_c(genotypes), n_calls)
    total = lambda side: F.aggregate(calls, F.lit(0), lambda s, x: s + x[side])
    return F.struct(total("ref").alias("ref"), total("alt").alias("alt"))


def samples_with_alt(genotypes: Column | str) -> Column:
    """Zero-based places of the samples with an alternative allele."""
    return F.filter(F.transform(_c(genotypes), lambda g, i: F.when(n_calls(g)["alt"] > 0, i)), lambda i: i.isNotNull())


def ploidy(contig: Column | str) -> Column:
    """2 on autosomes, else 1."""
    return F.when(F.upper(F.regexp_replace(_c(contig), "^(chr|CHR|Chr)", "")).isin("X", "Y", "M", "MT"), 1).otherwise(2)


def least_haplotypes(contig: Column | str, n_samples: int, part: float) -> Column:
    return F.ceil(ploidy(contig) * F.lit(n_samples * part))


def passes(kind, length, filt, qual, alt, n_ref, n_alt, contig, *, n_samples=0, min_length=0, max_length=None, pass_only=True, min_qual=None, min_af=0.0, min_nmf=0.0) -> Column:
    """The record predicate: one known, supported ALT, quality, filter, length and haplotype counts."""
    ok = ~is_missing_alt(alt) & ~_c(alt).contains(",") & _c(kind).isNotNull()
    if pass_only:
        ok &= _c(filt).isin("PASS", ".")
    if min_qual is not None:
        ok &= _c(qual) >= min_qual
    if min_length:
        ok &= _c(length).isNull() | (_c(length) >= min_length)
    if max_length is not None:
        ok &= _c(length).isNull() | (_c(length) <= max_length)
    if min_af:
        ok &= _c(n_alt) >= least_haplotypes(contig, n_samples, min_af)
    if min_nmf:
        ok &= (_c(n_ref) + _c(n_alt)) >= least_haplotypes(contig, n_samples, min_nmf)
    return ok


# breakends

def mate_contig(alt: Column | str) -> Column:
    return F.regexp_replace(F.nullif(F.regexp_extract(_c(alt), BRACKET, 1), F.lit("")), "^CHR", "chr")


def mate_pos(alt: Column | str) -> Column:
    return F.regexp_extract(_c(alt), BRACKET, 2).try_cast("int")


def is_single_breakend(alt: Column | str) -> Column:
    return ~_c(alt).rlike(r"[\[\]]") & (_c(alt).startswith(".") | _c(alt).endswith("."))


def is_valid_breakend(alt: Column | str) -> Column:
    return is_single_breakend(alt) | _c(alt).rlike(rf"^([A-Za-z.]*){BRACKET}([A-Za-z.]*)$")


def orientation(alt: Column | str) -> Column:
    """1 if the record's side is left of the break, 2 if right, 0 unknown."""
    alt = _c(alt)
    return F.when(alt.rlike(r"^[A-Za-z]"), 1).when(alt.rlike(r"[A-Za-z]$"), 2).otherwise(0)


def mate_orientation(alt: Column | str) -> Column:
    """1 if the mate's sequence left of its position joins (]), 2 if right of it ([), 0 unknown."""
    alt = _c(alt)
    return F.when(alt.contains("]"), 1).when(alt.contains("["), 2).otherwise(0)


def inserted_sequence(alt: Column | str) -> Column:
    """Bases between the two sides of a break, without the record's own base."""
    bases = F.regexp_replace(_c(alt), r"[\[\]][^\[\]]*[\[\]]|\.", "")
    return F.when(orientation(alt) == 1, F.substr(bases, F.lit(2))).when(orientation(alt) == 2, F.left(bases, F.length(bases) - 1))


def is_virtual_telomere(pos: Column | str, contig_length: Column | str, alt: Column | str, mate_length: Column | str) -> Column:
    return (_c(pos) == 0) | (_c(pos) == _c(contig_length) + 1) | (mate_pos(alt) == 0) | (mate_pos(alt) == _c(mate_length) + 1)


def mate_alt(contig: Column | str, pos: Column | str, alt: Column | str, mate_base: Column | str) -> Column:
    """The ALT of the mate record: t[p[ and ]p]t name each other, [p[t and t]p] themselves; inserted bases are kept."""
    here = F.concat(_c(contig), F.lit(":"), _c(pos).cast("string"))
    base, bases = _c(mate_base), inserted_sequence(alt)
    turned = F.reverse(F.translate(bases, "ACGTNacgtn", "TGCANtgcan"))
    side, mate = orientation(alt), mate_orientation(alt)
    return (
        F.when((side == 1) & (mate == 2), F.concat(F.lit("]"), here, F.lit("]"), bases, base))
        .when((side == 2) & (mate == 1), F.concat(base, bases, F.lit("["), here, F.lit("[")))
        .when((side == 2) & (mate == 2), F.concat(F.lit("["), here, F.lit("["), turned, base))
        .when((side == 1) & (mate == 1), F.concat(base, turned, F.lit("]"), here, F.lit("]")))
    )


def symbolic_tag(alt: Column | str, end: Column | str, length: Column | str) -> Column:
    """<DEL> with its END and SVLEN written into it, so that a merge on ALT keeps different events apart."""
    return F.when(is_symbolic(alt), F.concat(F.regexp_replace(_c(alt), ">$", ""), F.lit(":artificial:"), _c(end).cast("string"), F.lit(":"), _c(length).cast("string"), F.lit(">"))).otherwise(_c(alt))


def symbolic_untag(alt: Column | str) -> Column:
    return F.regexp_replace(_c(alt), ":artificial:[^>]*>$", ">")


def caller_of(record_id: Column | str, callers: list[str]) -> Column:
    """The first caller whose name stands in the record's identifier."""
    return F.coalesce(*[F.when(F.instr(F.lower(_c(record_id)), c.lower()) > 0, c) for c in callers])


def redundant_info(info: Column | str, redundant: Column) -> Column:
    return F.when(redundant, F.concat(F.lit("REDUNDANT=true;"), _c(info))).otherwise(_c(info))
