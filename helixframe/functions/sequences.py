"""Sequence, CIGAR, path, region and score expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .vcf import _c

#: CIGAR letters that consume reference and query bases (fixed values of the format).
ON_REF, ON_QUERY = "MDN=X", "MIS=X"


def reverse_complement(seq: Column | str) -> Column:
    """A, C, G, T and N in either case; any other letter raises."""
    seq = _c(seq)
    return F.when(seq.rlike("[^ACGTNacgtn]"), F.raise_error(F.lit("not a nucleotide")).cast("string")).otherwise(F.reverse(F.translate(seq, "ACGTNacgtn", "TGCANtgcan")))


def region_text(contig: Column | str, start: Column | str, stop: Column | str) -> Column:
    return F.concat(_c(contig), F.lit(":"), _c(start).cast("string"), F.lit("-"), _c(stop).cast("string"))


def region_of(text: Column | str) -> Column:
    """struct<contig,start,stop> of contig:start-stop."""
    pick = lambda k: F.regexp_extract(_c(text), r"^(.*)[:_](\d+)-(\d+)$", k)
    return F.struct(pick(1).alias("contig"), pick(2).try_cast("int").alias("start"), pick(3).try_cast("int").alias("stop"))


def cigar(text: Column | str) -> Column:
    """array<struct<len,op>>; M, I, D, N, S, H, P, = and X."""
    return F.transform(F.regexp_extract_all(_c(text), F.lit(r"(\d+[MIDNSHP=X])"), 1), lambda x: F.struct(F.left(x, F.length(x) - 1).cast("int").alias("len"), F.right(x, F.lit(1)).alias("op")))


def cigar_intervals(ops: Column | str, ref_start: Column | str, reverse: Column | str | None = None) -> Column:
    """array<struct<op,len,ref_start,ref_stop,query_start,query_stop>> by running coordinates; a reverse alignment's query counts down."""
    start = F.struct(
        F.array().cast("array<struct<op:string,len:int,ref_start:int,ref_stop:int,query_start:int,query_stop:int>>").alias("out"),
        _c(ref_start).cast("int").alias("r"), F.lit(0).alias("q"),
    )

    def step(acc: Column, x: Column) -> Column:
        r = acc["r"] + F.when(F.instr(F.lit(ON_REF), x["op"]) > 0, x["len"]).otherwise(0)
        q = acc["q"] + F.when(F.instr(F.lit(ON_QUERY), x["op"]) > 0, x["len"]).otherwise(0)
        one = F.struct(x["op"].alias("op"), x["len"].alias("len"), acc["r"].alias("ref_start"), r.alias("ref_stop"), acc["q"].alias("query_start"), q.alias("query_stop"))
        return F.struct(F.concat(acc["out"], F.array(one)).alias("out"), r.alias("r"), q.alias("q"))

    forward = F.aggregate(_c(ops), start, step, lambda acc: acc["out"])
    if reverse is None:
        return forward
    total = F.aggregate(_c(ops), F.lit(0), lambda s, x: s + F.when(F.instr(F.lit(ON_QUERY), x["op"]) > 0, x["len"]).otherwise(0))
    flip = lambda x: x.withField("query_start", total - x["query_start"]).withField("query_stop", total - x["query_stop"])
    return F.when(_c(reverse), F.transform(forward, flip)).otherwise(forward)


def graph_path(text: Column | str, flip: Column | str | None = None) -> Column:
    """array<struct<node,rev>> of >a<b; flipped (order and orientations) if ``flip``. Raises where the text does not begin with < or >."""
    text = _c(text)
    steps = F.transform(F.regexp_extract_all(text, F.lit("([<>][^<>]+)"), 1), lambda x: F.struct(F.substr(x, F.lit(2)).alias("node"), (F.left(x, F.lit(1)) == "<").alias("rev")))
    steps = F.when(text.rlike("^[<>]"), steps).otherwise(F.raise_error(F.lit("a path begins with < or >")).cast("array<struct<node:string,rev:boolean>>"))
    return steps if flip is None else F.when(_c(flip), flipped(steps)).otherwise(steps)


def flipped(path: Column) -> Column:
    return F.transform(F.reverse(path), lambda x: F.struct(x["node"].alias("node"), (~x["rev"]).alias("rev")))


def path_text(path: Column | str) -> Column:
    return F.array_join(F.transform(_c(path), lambda x: F.concat(F.when(x["rev"], "<").otherwise(">"), x["node"])), "")


def canonical_path(path: Column | str) -> Column:
    """The one of a path and its flip that is smaller as text."""
    back = flipped(_c(path))
    return F.when(path_text(back) < path_text(path), back).otherwise(_c(path))


def canonical_edge(a: Column, a_rev: Column, b: Column, b_rev: Column) -> Column:
    """struct<a,a_rev,b,b_rev>: the smaller of an edge and the same edge walked backwards."""
    make = lambda p, pr, q, qr: F.struct(p.alias("a"), pr.alias("a_rev"), q.alias("b"), qr.alias("b_rev"))
    return F.least(make(a, a_rev, b, b_rev), make(b, ~b_rev, a, ~a_rev))


def quantized(weight: Column | str, quantum: float) -> Column:
    """The nearest multiple of ``quantum``; the weight itself if that is 0."""
    return F.round(_c(weight) / quantum) * quantum if quantum else _c(weight)


def identity(matches: Column | str, mismatches: Column | str, inserts: Column | str, deletes: Column | str) -> Column:
    """Matches over all columns; null where there are none."""
    return F.try_divide(_c(matches).cast("double"), _c(matches) + _c(mismatches) + _c(inserts) + _c(deletes))


def identity_bin(value: Column | str) -> Column:
    """0 to 5: the floor of -log2(1 - identity) - 2 in these bounds; identities over 1 raise."""
    v = _c(value)
    q = F.floor(F.least(F.lit(5.0), F.greatest(F.lit(0.0), -F.log2(F.greatest(F.lit(1e-9), 1 - v)) - 2)))
    return F.when(v > 1, F.raise_error(F.lit("identity over 1")).cast("int")).when(v == 1, 5).otherwise(q.cast("int"))


def alignment_score(unmatched: Column | str) -> Column:
    """round(1000 * unmatched part) + 1, a whole number."""
    return (F.round(_c(unmatched) * 1000) + 1).cast("int")


def normalized_distance(d: Column | str, n: Column | str, d_range: tuple[float, float], n_range: tuple[float, float], d_weight: float = 1.0, n_weight: float = 1.0) -> Column:
    """Distance to the best corner after both ranges are scaled to 0..1; an empty range counts as one."""
    span = lambda r: (r[1] - r[0]) or 1.0
    a, b = (_c(d) - d_range[0]) / span(d_range), (_c(n) - n_range[0]) / span(n_range)
    return F.sqrt(a * a * d_weight + b * b * n_weight)


def length_bin(length: Column | str) -> Column:
    return F.floor(F.log2(_c(length) + 1)).cast("int")


def padded(number: Column | str, width: int) -> Column:
    return F.lpad(_c(number).cast("string"), width, "0")


def duration_parts(ms: Column | str) -> Column:
    """struct<h,m,s,ms> of milliseconds."""
    t = _c(ms).cast("long")
    return F.struct(F.floor(t / 3_600_000).alias("h"), (F.floor(t / 60_000) % 60).alias("m"), (F.floor(t / 1000) % 60).alias("s"), (t % 1000).alias("ms"))


def aligned_texts(op: Column | str, length: Column | str, ref: Column | str, query: Column | str) -> Column:
    """struct<ref,bars,query>: an operation's bases over each other, gaps as '-', bars where they are equal.

    ``ref`` and ``query`` are the bases the operation covers.
    """
    op, n, ref, query = _c(op), _c(length), _c(ref), _c(query)
    on_ref, on_query = op.isin("M", "=", "X", "D", "N"), op.isin("M", "=", "X", "I", "S")
    gap = F.repeat(F.lit("-"), n)
    x, y = F.when(on_ref, ref).otherwise(gap), F.when(on_query, query).otherwise(gap)
    same = F.transform(F.arrays_zip(F.split(x, "").alias("a"), F.split(y, "").alias("b")), lambda p: F.when(p["a"] == p["b"], "|").otherwise(" "))
    return F.struct(x.alias("ref"), F.array_join(same, "").alias("bars"), y.alias("query"))


def comparison(text: str) -> Column:
    """A Column of "A op B", where A and B are column names or numbers and op is one of > < >= <= == !=."""
    import operator
    import re

    ops = {">": operator.gt, "<": operator.lt, ">=": operator.ge, "<=": operator.le, "==": operator.eq, "!=": operator.ne}
    m = re.fullmatch(r"\s*(\S+)\s+(>=|<=|==|!=|>|<)\s+(\S+)\s*", text)
    if not m:
        raise ValueError(f"not a comparison: {text!r}")
    side = lambda x: F.lit(float(x)) if re.fullmatch(r"[-+]?(\d+\.?\d*|\.\d+)([eE][-+]?\d+)?", x) else F.col(x)
    return ops[m[2]](side(m[1]), side(m[3]))
