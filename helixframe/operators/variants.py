"""Operations on whole call sets: splitting, merging, deduplication, breakend cleaning, labels, features."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import vcf as V


def split_multiallelic(records: DataFrame) -> DataFrame:
    """One row for each ALT; in genotypes its number becomes 1, other alternative alleles 0. ``allele`` is the ALT's number."""
    each = records.select("*", F.posexplode(F.split("alt", ",")).alias("_k", "_alt"))
    number = (F.col("_k") + 1).cast("string")

    def call(g: Column) -> Column:
        gt = F.substring_index(g, ":", 1)
        rest = F.substr(g, F.length(gt) + 1)
        sep = F.when(gt.contains("|"), "|").otherwise("/")
        mapped = F.transform(V.alleles(g), lambda a: F.when(a == number, "1").when(a.isin(".", "0"), a).otherwise("0"))
        return F.concat(F.replace(F.array_join(mapped, "\t"), F.lit("\t"), sep), rest)

    out = each.withColumn("alt", F.col("_alt")).withColumn("allele", F.col("_k") + 1)
    if "genotypes" in records.columns:
        out = out.withColumn("genotypes", F.transform("genotypes", call))
    return out.drop("_k", "_alt")


def merged_calls(calls: DataFrame, samples: list[str], missing: str = "./.") -> DataFrame:
    """(contig, pos, ref, alt, genotypes): one record for each allele over all samples, calls in the order of ``samples``."""
    one = calls.groupBy("contig", "pos", "ref", "alt").agg(F.map_from_entries(F.collect_set(F.struct("sample", "gt"))).alias("m"))
    # one expression, however many samples
    return one.select("contig", "pos", "ref", "alt", F.transform(F.lit(samples), lambda s: F.coalesce(F.try_element_at("m", s), F.lit(missing))).alias("genotypes"))


def concatenated(parts: list[DataFrame], key: list[str] = ["contig", "pos", "ref", "alt"]) -> DataFrame:  # noqa: B006
    """The union of call sets, repeated records once (the first by identifier)."""
    both = reduce(lambda a, b: a.unionByName(b), parts)
    rest = [c for c in both.columns if c not in key]
    return both.groupBy(*key).agg(F.min(F.struct(*sorted(rest, key=lambda c: c != "id"))).alias("r")).select(*key, "r.*").select(*both.columns)


def redundant(record_edges: DataFrame, by: list[str] = []) -> DataFrame:  # noqa: B006
    """(record, is_redundant) of (record, rank, a, b) edges: all but the first record with an edge list, read from either end."""
    lists = record_edges.groupBy(*by, "record").agg(F.transform(F.array_sort(F.collect_list(F.struct("rank", "a", "b"))), lambda x: F.struct(x["a"].alias("a"), x["b"].alias("b"))).alias("l"))
    back = F.transform(F.reverse("l"), lambda x: F.struct(x["b"].alias("a"), x["a"].alias("b")))
    same = Window.partitionBy(*by, F.least("l", back)).orderBy("record")
    return lists.select(*by, "record", (F.row_number().over(same) > 1).alias("is_redundant"))


def truth_labels(true_calls: DataFrame, false_calls: DataFrame) -> DataFrame:
    return true_calls.withColumn("label", F.lit(1)).unionByName(false_calls.withColumn("label", F.lit(0)))


def score_filter(records: DataFrame, length: str = "sv_length", score: str = "score", long: int = 2048, least: float = 0.15) -> DataFrame:
    """Long records, and shorter ones with a high enough score."""
    return records.where((F.abs(F.col(length)) >= long) | (F.col(score) >= least))


def on_contigs(records: DataFrame, contigs: list[str], min_length: int = 50, length: str = "sv_length", score: str | None = None) -> DataFrame:
    """Records on the given contigs of at least ``min_length`` bases, with a score if a score column is named."""
    ok = F.col("contig").isin(contigs) & (F.abs(F.col(length)) >= min_length)
    return records.where(ok if score is None else ok & F.col(score).isNotNull())


def true_records(records: DataFrame, label: str, least: float = 0.9) -> DataFrame:
    """Records whose INFO field <label>_MAX is over ``least``; missing and unreadable values are not."""
    return records.where(V.info_value("info", f"{label}_MAX").try_cast("double") > least)


def of_samples(rows: DataFrame, samples: DataFrame, sample: str = "sample") -> DataFrame:
    """Rows whose sample stands in the table ``samples``."""
    return rows.join(samples.select(sample).distinct(), sample, "left_semi")


def first_samples(samples: DataFrame, n: int, sample: str = "sample") -> DataFrame:
    """The first ``n`` samples by name."""
    return samples.select(sample).distinct().orderBy(sample).limit(n)


def cleaned_breakends(records: DataFrame, bases: DataFrame, min_length: int, single_length: int) -> DataFrame:
    """Breakend records of a call set: (contig, pos, ref, alt, source).

    Invalid breakends go.  A paired one gets its mate.  A long deletion becomes
    two breakends, an inversion four, a duplication two, an insertion two single
    ones of ``single_length`` bases; shorter calls stay.  ``bases`` (contig, pos,
    base) gives the reference bases at the ends.
    """
    if min_length < 2 * single_length:
        raise ValueError("min_length must be twice single_length at least")
    r = records.withColumn("kind", V.sv_type("info", "ref", "alt"))
    r = r.withColumn("len", V.sv_length("kind", "info", "pos", "ref", "alt"))
    r = r.where(F.col("kind").isNotNull() & ((F.col("kind") != V.TYPES["BND"]) | V.is_valid_breakend("alt")))
    paired = (F.col("kind") == V.TYPES["BND"]) & ~V.is_single_breakend("alt")
    far = F.when(paired, V.mate_contig("alt")).otherwise(F.col("contig"))
    end = F.when(paired, V.mate_pos("alt")).otherwise(F.col("pos") + F.col("len"))
    at = lambda c: F.when(c.isNotNull(), c)
    r = r.withColumn("far", far).withColumn("end", end).withColumn("next", F.col("pos") + 1).withColumn("after", F.col("end") + 1)
    for place, contig, name in (("pos", "contig", "b0"), ("next", "contig", "b1"), ("end", "far", "e0"), ("after", "far", "e1")):
        r = r.join(bases.select(F.col("contig").alias(contig), F.col("pos").alias(place), F.upper("base").alias(name)), [contig, place], "left")
    b0, b1, e0, e1 = (F.coalesce(at(F.col(x)), F.lit("N")) for x in ("b0", "b1", "e0", "e1"))
    make = lambda contig, pos, ref, alt: F.struct(contig.alias("contig"), pos.cast("int").alias("pos"), ref.alias("ref"), alt.alias("alt"))
    place = lambda contig, pos: F.concat(contig, F.lit(":"), pos.cast("string"))
    c, pos, nxt, e, aft = F.col("contig"), F.col("pos"), F.col("next"), F.col("end"), F.col("after")
    br = lambda left, x, right: F.concat(F.lit(left), x, F.lit(right))
    here, there = place(c, pos), place(c, e)
    long_call = F.col("len") >= min_length
    inserted = F.substr(F.col("alt"), F.lit(2))
    out = (
        F.when(paired, F.array(make(c, pos, F.col("ref"), F.col("alt")), make(F.col("far"), e, e0, V.mate_alt("contig", "pos", "alt", e0))))
        .when((F.col("kind") == V.TYPES["DEL"]) & long_call, F.array(make(c, pos, b0, F.concat(b0, br("[", place(c, aft), "["))), make(c, aft, e1, F.concat(br("]", here, "]"), e1))))
        .when((F.col("kind") == V.TYPES["DUP"]) & long_call, F.array(make(c, nxt, b1, F.concat(br("]", there, "]"), b1)), make(c, e, e0, F.concat(e0, br("[", place(c, nxt), "[")))))
        .when(
            (F.col("kind") == V.TYPES["INV"]) & long_call,
            F.array(make(c, pos, b0, F.concat(b0, br("]", there, "]"))), make(c, e, e0, F.concat(e0, br("]", here, "]"))), make(c, nxt, b1, F.concat(br("[", place(c, aft), "["), b1)), make(c, aft, e1, F.concat(br("[", place(c, nxt), "["), e1))),
        )
        .when(
            (F.col("kind") == V.TYPES["INS"]) & long_call & ~V.is_symbolic("alt"),
            F.array(make(c, pos, b0, F.concat(b0, F.left(inserted, F.lit(single_length)), F.lit("."))), make(c, nxt, b1, F.concat(F.lit("."), F.right(inserted, F.lit(single_length)), b1))),
        )
        .otherwise(F.array(make(c, pos, F.col("ref"), F.col("alt"))))
    )
    return r.select(F.explode(out).alias("r"), F.col("id").alias("source")).select("r.*", "source")


FEATURES = ["q_score", "stdev_len", "stdev_pos", "ref_length", "alt_length", "is_ins", "is_del", "is_dup", "is_inv", "is_other", "by_pav", "by_pbsv", "by_sniffles"]


def base_features(records: DataFrame, callers: tuple[str, str, str] = ("pav", "pbsv", "sniffles")) -> DataFrame:
    """The record with 13 numbers: quality, deviations, allele lengths, a one-hot type and caller support."""
    number = lambda key: F.coalesce(V.info_value("info", key).try_cast("double"), F.lit(0.0))
    r = records.withColumn("_k", V.sv_type("info", "ref", "alt"))
    hot = lambda t: (F.col("_k") == V.TYPES[t]).cast("double")
    other = (F.col("_k").isNull() | ~F.col("_k").isin(*[V.TYPES[t] for t in ("INS", "DEL", "DUP", "INV")])).cast("double")
    support = [F.coalesce(V.info_value("info", c.upper()).try_cast("double"), (F.instr(F.lower(F.col("id").cast("string")), c) > 0).cast("double")) for c in callers]
    values = [F.coalesce(F.col("qual").cast("double"), F.lit(0.0)), number("STDEV_LEN"), number("STDEV_POS"), F.length("ref").cast("double"), F.length("alt").cast("double"), *[F.coalesce(hot(t), F.lit(0.0)) for t in ("INS", "DEL", "DUP", "INV")], other, *support]
    return r.withColumns(dict(zip(FEATURES, values))).drop("_k")


def sample_features(records: DataFrame, kind: str) -> DataFrame:
    """Numbers of the first sample by FORMAT field: alleles and the fields each genotyper writes."""
    fields = {"sniffles": ["GQ", "DR", "DV"], "svjedi": ["DP"], "kanpig": ["DP", "GQ", "SQ"], "cutesv": ["GQ", "DR", "DV"], "lrcaller": []}[kind]
    entries = F.map_from_entries(F.arrays_zip(F.split("format", ":"), F.split(F.col("genotypes")[0], ":")))
    m = records.withColumn("_m", entries)
    get = lambda key: F.try_element_at("_m", F.lit(key))
    lists = {"svjedi": ["AD", "PL"], "kanpig": ["AD"], "cutesv": ["PL"], "lrcaller": [f"{x}{k}" for x in ("AD", "VA", "PL") for k in range(1, 6)]}.get(kind, [])
    calls = ["GT"] if kind != "lrcaller" else [f"GT{k}" for k in range(1, 6)]
    numbers = lambda text: F.transform(F.split(F.coalesce(text, F.lit("0")), "[,/|]"), lambda x: F.coalesce(x.try_cast("double"), F.lit(0.0)))
    parts = [F.array_sort(numbers(get(c))) for c in calls] + [F.array(F.coalesce(get(f).try_cast("double"), F.lit(0.0))) for f in fields] + [numbers(get(f)) for f in lists]
    return m.withColumn("features", F.flatten(F.array(*parts))).drop("_m")
