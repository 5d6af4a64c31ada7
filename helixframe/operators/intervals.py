"""Interval operators: joins, islands, atomic segments, coverage, nearest points.

A range predicate alone would be a nested-loop join.  ``interval_join`` turns it
into an equi-join on (contig, bin): both sides are exploded to the bins they
touch, and a pair is kept only in the later of their two first bins, so no
``distinct`` is needed.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..staging import staged

#: Bases of a bin, and bits by which bins grow from one level to the next.
BIN = 4096
LEVEL_BITS = 3


def _binned(df: DataFrame, start: str, stop: str, width: int, every: bool = False, levels: int = 1) -> DataFrame:
    """A row for each bin an interval touches; with ``every``, rows without an interval stay, in no bin.

    With several levels an interval belongs to the lowest one whose bins are as long as it
    (the highest, if none is), and has a row for each bin it touches of that level and of those above,
    ``_own`` and ``_level``: a few rows, however long it is.
    """
    each = F.explode_outer if every else F.explode
    if levels == 1:
        first = F.floor(F.col(start) / width)
        return df.withColumn("_b0", first).withColumn("_bin", each(F.sequence(first, F.greatest(first, F.floor(F.col(stop) / width)))))
    size = F.col(stop) - F.col(start)
    own = F.lit(levels - 1)
    for k in reversed(range(levels - 1)):
        own = F.when(size <= width << (LEVEL_BITS * k), k).otherwise(own)
    wide = F.lit(width) * F.pow(F.lit(2.0), F.col("_level") * LEVEL_BITS)
    leveled = df.withColumn("_own", own).withColumn("_level", F.explode(F.sequence(F.col("_own"), F.lit(levels - 1))))
    binned = leveled.withColumn("_b0", F.floor(F.col(start) / wide))
    return binned.withColumn("_bin", each(F.sequence(F.col("_b0"), F.greatest("_b0", F.floor(F.col(stop) / wide)))))


def interval_join(
    left: DataFrame, right: DataFrame, on: list[str], l_start: str, l_stop: str, r_start: str, r_stop: str,
    closed: bool = True, width: int = BIN, how: str = "inner", levels: int = 1,
) -> DataFrame:
    """Pairs whose intervals overlap: ``[start, stop]`` if closed, else a positive common length.

    With ``levels`` over 1 long intervals are in few long bins instead of many short
    ones, and a pair meets on the level of the longer of both: for tables with intervals of
    very different lengths.  It is for inner and left joins; a bin that many rows
    share is split by Spark's skew join.

    ``on`` columns are equal; the interval columns of both sides must have
    different names.  ``how`` is inner, left, left_semi or left_anti.  A null end or
    ``on`` column overlaps nothing, so such rows stay in left and left_anti.
    """
    # rows are numbered once: what is joined back must see the same numbers
    if levels > 1 and how not in ("inner", "left"):
        raise ValueError("several levels are for inner and left joins")
    rows = staged(left.withColumn("_l", F.monotonically_increasing_id()), "numbered") if how == "left" else left
    a = _binned(rows, l_start, l_stop, width, levels=levels).withColumnRenamed("_b0", "_lb")
    b = _binned(right, r_start, r_stop, width, levels=levels).withColumnRenamed("_b0", "_rb")
    level = [] if levels == 1 else ["_level"]
    if level:
        a, b = a.withColumnRenamed("_own", "_lo"), b.withColumnRenamed("_own", "_ro")
    low, high = F.greatest(l_start, r_start), F.least(l_stop, r_stop)
    overlap = low <= high if closed else low < high
    if how in ("left_semi", "left_anti"):
        # a record may touch several bins: decide per record
        key = [*left.columns]
        rows = left.withColumn("_l", F.monotonically_increasing_id())
        a = _binned(rows, l_start, l_stop, width, how == "left_anti").withColumnRenamed("_b0", "_lb")
        cond = (a["_bin"] == b["_bin"]) & overlap
        for c in on:
            cond &= a[c] == b[c]
        hit = a.join(b, cond, "left_semi").select("_l", *key).dropDuplicates(["_l"]).drop("_l")
        if how == "left_semi":
            return hit
        found = a.withColumn("_hit", F.lit(0)).join(b.select(*on, "_bin", r_start, r_stop), [*on, "_bin"], "left")
        flag = F.max(F.when(F.col(r_start).isNotNull() & overlap, 1).otherwise(0))
        return found.groupBy("_l", *key).agg(flag.alias("_any")).where("_any = 0").select(*key)
    meets = (F.col("_bin") == F.greatest("_lb", "_rb")) & overlap
    if level:
        meets &= F.col("_level") == F.greatest("_lo", "_ro")
    pairs = a.join(b, [*on, *level, "_bin"]).where(meets).drop("_bin", "_lb", "_rb", "_level", "_lo", "_ro")
    if how == "inner":
        return pairs
    return rows.join(pairs.select("_l", *[c for c in right.columns if c not in on]), "_l", "left").drop("_l")


def dealt(df: DataFrame, contig: str, start: str, stop: str) -> DataFrame:
    """``df`` in range partitions by (contig, start, stop), staged, with the partition (``_p``) and a number of the row (``_k``); equal rows may lie in several."""
    spread = df.withColumn("_any", F.monotonically_increasing_id()).repartitionByRange(contig, start, stop, "_any").drop("_any")
    return staged(spread.withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()), "dealt")


def running(
    rows: DataFrame, contig: str, order: list[str], value: Column, total: Callable[[Column], Column], join: Callable[..., Column], name: str,
    inclusive: bool = False, backward: bool = False,
) -> DataFrame:
    """``rows`` of ``dealt`` with ``name``, the total of ``value`` over the contig's rows before each (after each, if backward; and itself, if inclusive).

    Each partition runs by itself; one row for each (contig, partition) is
    carried to the partitions after it, so a contig is never one task.  Rows without
    a contig are one contig of their own.  Of a partition only the first contig (the last, if
    backward) has something carried to it, so this is one row a partition at most and is broadcast.
    """
    rows = rows.withColumn("_v", value)
    way = (lambda c: F.col(c).desc()) if backward else F.col
    own = Window.partitionBy(contig, "_p").orderBy(*map(way, [*order, "_k"])).rowsBetween(Window.unboundedPreceding, 0 if inclusive else -1)
    parts = rows.groupBy(contig, "_p").agg(total(F.col("_v")).alias("_t"))
    before = Window.partitionBy(contig).orderBy(way("_p")).rowsBetween(Window.unboundedPreceding, -1)
    carried = parts.withColumn("_t", total(F.col("_t")).over(before)).where("_t is not null").select(F.col(contig).alias("_c"), F.col("_p").alias("_q"), "_t")
    totals = rows.withColumn("_o", total(F.col("_v")).over(own))
    return totals.join(F.broadcast(carried), F.col(contig).eqNullSafe(F.col("_c")) & (F.col("_p") == F.col("_q")), "left").withColumn(name, join(F.col("_o"), F.col("_t"))).drop("_o", "_t", "_v", "_c", "_q")


def _plus(a: Column, b: Column) -> Column:
    return F.coalesce(a, F.lit(0)) + F.coalesce(b, F.lit(0))


def numbered_islands(df: DataFrame, contig: str, start: str, stop: str, gap: int, ties: list[str] = []) -> DataFrame:  # noqa: B006
    """``df`` with ``_island``: the number of its island on the contig.

    ``ties`` order rows of equal ends.  Their order changes no island, but columns that all steps read are
    shuffled once for all of them.
    """
    order = [start, stop, *ties]
    rows = running(dealt(df, contig, start, stop), contig, order, F.col(stop), F.max, F.greatest, "_reach")
    new = F.when(F.col("_reach").isNull() | (F.col(start) > F.col("_reach") + F.lit(gap)), 1).otherwise(0)
    return running(rows, contig, order, new, F.sum, _plus, "_island", inclusive=True).drop("_reach", "_p", "_k")


def merged_strict(df: DataFrame, contig: str, start: str, stop: str) -> DataFrame:
    """Flanked windows that overlap by a base or more as one: contig, start, stop, n; those that only touch stay apart."""
    return islands(df, contig, start, stop, -1)


def sorted_intervals(df: DataFrame, contig: str, start: str, stop: str) -> DataFrame:
    """Intervals with ``rank``, their place on the contig by start and stop."""
    rows = running(dealt(df, contig, start, stop), contig, [start, stop], F.lit(1), F.sum, _plus, "rank", inclusive=True)
    return rows.drop("_p", "_k")


def islands(df: DataFrame, contig: str, start: str, stop: str, gap: int = 0, flag: str | None = None) -> DataFrame:
    """Gap-tolerant islands: contig, start, stop, n (members), and any_flag.

    A member joins the island when its start is at most ``gap`` past the
    largest stop so far; an island's own stop leaves the gap out.
    """
    own = [flag] if flag else []
    numbered = numbered_islands(df.select(contig, start, stop, *own), contig, start, stop, gap, own)  # other columns would be staged and shuffled too
    aggs = [F.min(start).alias("start"), F.max(stop).alias("stop"), F.count(F.lit(1)).alias("n")]
    if flag:
        aggs.append(F.max(F.col(flag).cast("int")).cast("boolean").alias("any_flag"))
    return numbered.groupBy(contig, "_island").agg(*aggs).drop("_island")


def windows(df: DataFrame, contig: str, start: str, stop: str, gap: int, is_tandem: str, max_length: int) -> tuple[DataFrame, DataFrame]:
    """(windows, omitted): islands that hold more than tandem repeats, split by the length cap."""
    found = islands(df.withColumn("_keep", ~F.col(is_tandem)), contig, start, stop, gap, "_keep").where("any_flag").drop("any_flag")
    fits = (F.col("stop") - F.col("start")) <= F.lit(max_length)
    return found.where(fits), found.where(~fits)


def components(df: DataFrame, contig: str, start: str, stop: str, labels: str) -> DataFrame:
    """Closed-overlap components with the union of their label arrays; raises where start exceeds stop."""
    checked = df.withColumn(start, F.when(F.col(start) <= F.col(stop), F.col(start)).otherwise(F.raise_error(F.lit("interval start exceeds stop")).cast("int")))
    each = numbered_islands(checked, contig, start, stop, 0).withColumnRenamed("_island", "_c").groupBy(contig, "_c").agg(F.min(start).alias("start"), F.max(stop).alias("stop"), F.array_sort(F.array_distinct(F.flatten(F.collect_list(labels)))).alias("labels"))
    return each.drop("_c")


def atomic_segments(df: DataFrame, contig: str, start: str, stop: str) -> DataFrame:
    """Disjoint segments between neighbouring ends: contig, seg_start, seg_stop, depth (covering intervals, at least one).

    Each interval adds one at its start and takes one at its stop; the sum so far is the depth, the least end after a start its segment's stop.
    """
    ends = df.select(contig, F.explode(F.array(F.struct(F.col(start).alias("at"), F.lit(1).alias("d")), F.struct(F.col(stop).alias("at"), F.lit(-1).alias("d")))).alias("e"))
    at = ends.groupBy(contig, F.col("e.at").alias("seg_start")).agg(F.sum("e.d").alias("d"))
    rows = running(dealt(at, contig, "seg_start", "d"), contig, ["seg_start"], F.col("d"), F.sum, _plus, "depth", inclusive=True)
    segs = running(rows, contig, ["seg_start"], F.col("seg_start"), F.min, F.least, "seg_stop", backward=True)
    return segs.where("seg_stop is not null and depth > 0").select(contig, "seg_start", "seg_stop", "depth")


def averaged_over_segments(df: DataFrame, contig: str, start: str, stop: str, counters: list[str], width: int = BIN) -> DataFrame:
    """Counters of overlapping alignments, each scaled to the segment it covers and averaged over those that cover it."""
    segs = atomic_segments(df, contig, start, stop)
    pairs = interval_join(segs, df, [contig], "seg_start", "seg_stop", start, stop, closed=False, width=width)
    part = (F.col("seg_stop") - F.col("seg_start")) / (F.col(stop) - F.col(start))
    return pairs.groupBy(contig, "seg_start", "seg_stop").agg(*[F.avg(F.col(c) * part).alias(c) for c in counters])


def covered_fraction(targets: DataFrame, tracks: DataFrame, contig: str, start: str, stop: str, width: int = BIN) -> DataFrame:
    """Targets with ``covered``, the part of their length that the union of ``tracks`` (same contig column, t_start, t_stop) covers; 0 for those without a length."""
    merged = islands(tracks, contig, "t_start", "t_stop").select(contig, F.col("start").alias("t_start"), F.col("stop").alias("t_stop"))
    keyed = staged(targets.withColumn("_id", F.monotonically_increasing_id()), "targets")
    hit = interval_join(keyed.select("_id", contig, start, stop), merged, [contig], start, stop, "t_start", "t_stop", closed=False, width=width, levels=4)  # merged tracks may be long
    span = hit.groupBy("_id").agg(F.sum(F.least(stop, "t_stop") - F.greatest(start, "t_start")).alias("_bases"))
    return keyed.join(span, "_id", "left").withColumn("covered", F.coalesce(F.try_divide(F.col("_bases"), F.col(stop) - F.col(start)), F.lit(0.0))).drop("_id", "_bases")


def nearest_point(queries: DataFrame, points: DataFrame, contig: str, at: str, point: str) -> DataFrame:
    """Queries with the nearest point of their contig (``nearest``), the lower one on a tie: the largest point up to each and the least after it."""
    row = F.struct(*queries.columns)
    both = queries.select(contig, F.col(at).alias("_at"), F.lit(1).alias("_is_query"), row.alias("_row"), F.lit(None).cast("long").alias("_point")).unionAll(
        points.select(contig, F.col(point).alias("_at"), F.lit(0).alias("_is_query"), F.lit(None).cast(queries.select(row.alias("r")).schema[0].dataType).alias("_row"), F.col(point).cast("long").alias("_point"))
    )
    order, value = ["_at", "_is_query"], F.col("_point")
    low = running(dealt(both, contig, *order), contig, order, value, F.max, F.greatest, "_lo")
    seen = running(low, contig, order, value, F.min, F.least, "_hi", backward=True).where("_is_query = 1")
    lower = F.col("_hi").isNull() | (F.col("_lo").isNotNull() & (F.col("_at") - F.col("_lo") <= F.col("_hi") - F.col("_at")))
    return seen.select("_row.*", F.when(lower, F.col("_lo")).otherwise(F.col("_hi")).alias("nearest"))


def flanked(df: DataFrame, start: str, stop: str, flank: int, length: Column | None = None) -> DataFrame:
    """Windows with ``flank`` on both sides; those that would leave the contig are dropped."""
    out = df.withColumn(start, F.col(start) - flank).withColumn(stop, F.col(stop) + flank)
    ok = F.col(start) >= 0
    return out.where(ok if length is None else ok & (F.col(stop) <= length))


def records_in_windows(records: DataFrame, wins: DataFrame, contig: str, first: str, second: str, flank: int, width: int = BIN, keep_empty: bool = False) -> DataFrame:
    """Records with every window (window_id, win_start, win_stop; flanked) that holds them inside its flanks; windows without one too, if asked."""
    pairs = interval_join(records, wins, [contig], first, second, "win_start", "win_stop", closed=True, width=width)
    inside = pairs.where((F.col(first) >= F.col("win_start") + flank) & (F.col(second) <= F.col("win_stop") - flank))
    return wins.join(inside.drop("win_start", "win_stop", contig), "window_id", "left") if keep_empty else inside


def chunked(df: DataFrame, order: list[str], n_chunks: int) -> DataFrame:
    """Rows with ``chunk``: their rank divided by max(1, rows // n_chunks); ranks by a two-level count, without one big sort."""
    dealt = staged(df.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("_p", F.spark_partition_id()).withColumn("_k", F.monotonically_increasing_id()), "ranked")
    size = max(1, dealt.count() // n_chunks)
    counts = dealt.groupBy("_p").agg(F.count(F.lit(1)).alias("_n"), F.min("_k").alias("_first"))
    base = counts.withColumn("_base", F.coalesce(F.sum("_n").over(Window.orderBy("_p").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)))
    ranked = dealt.join(F.broadcast(base.select("_p", "_first", "_base")), "_p")
    return ranked.withColumn("chunk", F.floor((F.col("_base") + F.col("_k") - F.col("_first")) / size).cast("long")).drop("_p", "_k", "_first", "_base")
