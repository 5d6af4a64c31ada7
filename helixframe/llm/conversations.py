"""Repair of the role structure of conversations by a scan over min-plus matrices.

A good conversation is ``(s?(ua)+)?`` in the initials of its roles, an automaton of
four states: nothing yet, after the system turn, after a user turn, after an
answer.  A turn is a 4 x 4 matrix: entry (i, k) is the cheapest way to get from
state i to state k by keeping, re-roling or deleting that turn and by
inserting turns behind it.  An element is (cost, audit), audit the initials of the
edits; a sum takes the smaller element, a product adds costs and joins audits.

Products are associative, so a conversation is cut into segments of at most
``SEGMENT`` turns wherever its rows lie, each segment is one product, and the
products of segments are multiplied in a tree, ``FAN`` at a time.  The cheapest
audit is then cut at the segments again and applied there, so that no
conversation is ever one group; only its audit and the digest of its repaired text,
which are values of one row, pass through one task, as a stream.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import size_in_partitions, staged

#: Turns of a segment (as a power of two), and segments multiplied at a time (likewise).
SEGMENT_BITS, FAN_BITS = 12, 5
DELETE, INSERT, REROLE, TRUNCATED = 4, 3, 3, 3
#: States: nothing, system, user, assistant; what may follow each, by initials.
NEXT = ({"s": 1, "u": 2}, {"u": 2}, {"a": 3}, {"u": 2})
ACCEPTED = (0, 3)
ROLES = {"u": "user", "a": "assistant"}
BLANK, DUPLICATE, CUT = 1, 2, 3
#: Keeping a role without an initial, which leaves no turn in the pattern; K to the reader, and in the order of edits of one turn where K is.
KEPT_BARE = "L"
_SPACE = r"\x20\x09-\x0D"

Element = tuple[int, str] | None
Matrix = list[list[Element]]


def _times(a: Element, b: Element) -> Element:
    return None if a is None or b is None else (a[0] + b[0], a[1] + b[1])


def _least(found: Iterable[Element]) -> Element:
    return min((x for x in found if x is not None), default=None)


def product(a: Matrix, b: Matrix) -> Matrix:
    """The min-plus product.  Of equal costs the least audit is kept: two audits over the same turns where one begins the other differ in their insertions, so in cost."""
    return [[_least(_times(a[i][j], b[j][k]) for j in range(4)) for k in range(4)] for i in range(4)]


def _closure() -> Matrix:
    """No insertion, one or two; a third one never leads to a new state."""
    own: Matrix = [[(0, "") if i == k else None for k in range(4)] for i in range(4)]
    one: Matrix = [[(INSERT, "I") if k in [NEXT[i].get(c) for c in ROLES] else None for k in range(4)] for i in range(4)]
    two = product(one, one)
    return [[_least((own[i][k], one[i][k], two[i][k])) for k in range(4)] for i in range(4)]


INSERTED = _closure()


def turn_matrix(initial: str, fault: int) -> Matrix:
    """The ways of one turn, with insertions behind it; a role without an initial adds none when it is kept."""
    more = TRUNCATED if fault == CUT else 0
    out: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        ways: list[tuple[int, Element]] = [(i, (DELETE, "D"))]
        if fault not in (BLANK, DUPLICATE):
            kept = NEXT[i].get(initial) if initial else i
            ways += [(kept, (more, "K" if initial else KEPT_BARE))] if kept is not None else []
            ways += [(NEXT[i][c], (REROLE + more, "R")) for c in ROLES if c in NEXT[i]]
        for k in range(4):
            out[i][k] = _least(way for to, way in ways if to == k)
    return product(out, INSERTED)


def cheapest(matrix: Matrix | None) -> tuple[int, str]:
    """Cost and audit of a whole conversation; without turns nothing is to be done."""
    if matrix is None:
        return 0, ""
    front = product(INSERTED, matrix)
    return _least(front[0][k] for k in ACCEPTED) or (0, "")


def damaged(turns: DataFrame, every: int = 20) -> DataFrame:
    """Rows of conv_id, turn, role and text with faults by crc32(``conv_id:turn``) modulo ``every``; nulls of role and text become a space, as in the key.

    0 drops the row, 1 empties its text, 2 takes ``.``, ``!`` and ``?`` from it, 3
    repeats the row, 4 makes its role user.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    kind = F.crc32(F.concat(said("conv_id"), F.lit(":"), said("turn")).cast("binary")) % F.lit(every)
    rows = turns.select("conv_id", "turn", said("role").alias("role"), said("text").alias("text"), kind.alias("_k")).where("_k != 0")
    text = F.when(F.col("_k") == 1, F.lit("")).when(F.col("_k") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_k") == 4, F.lit("user")).otherwise(F.col("role"))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), F.explode(F.when(F.col("_k") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0)))).alias("_c")).drop("_c")


def _key(col: str) -> F.Column:
    return F.coalesce(F.concat(F.lit("="), F.col(col).cast("string")), F.lit(""))


def in_order(turns: DataFrame) -> DataFrame:
    """(ck, conv, turn, role, text, same, pos, seg) in the shared folder: rows numbered by conversation and turn, nulls first.

    Equal turns are ordered by role and by SHA-256 of the text.  ``pos`` rises with the
    order over all partitions, rows of a segment have the same ``seg``, and ``ck``
    names a conversation, the one without identifier too.
    """
    said = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    rows = turns.select(_key("conv_id").alias("ck"), F.col("conv_id").alias("conv"), F.col("turn").cast("long").alias("turn"), said("role").alias("role"), said("text").alias("text"))
    rows = rows.withColumn("same", F.sha2("text", 256)).withColumn("_any", F.monotonically_increasing_id())  # equal rows may lie in several partitions
    order = ["ck", "turn", "role", "same", "_any"]
    rows = rows.repartitionByRange(size_in_partitions(turns), *order).sortWithinPartitions(*order).drop("_any")
    return staged(rows.withColumn("pos", F.monotonically_increasing_id()).withColumn("seg", F.shiftright("pos", SEGMENT_BITS)), "turns")


def with_faults(ordered: DataFrame) -> DataFrame:
    """(ck, seg, pos, turn, initial, fault): the first fault of each row that holds, blank, duplicate or truncated, else 0."""
    blank = ~F.col("text").rlike(f"[^{_SPACE}]")
    ended = F.col("text").rlike(rf"[.!?][{_SPACE}]*\z")
    rows = ordered.select("ck", "seg", "pos", "turn", "role", "same", F.substr("role", F.lit(1), F.lit(1)).alias("initial"), F.when(blank, BLANK).when(~ended, CUT).otherwise(0).alias("own"))
    # the first row of each text is known by its number, so a text that thousands of rows repeat is one key before the shuffle
    first = rows.where(F.col("own") != BLANK).groupBy("ck", "role", "same").agg(F.min("pos").alias("pos")).select("pos", F.lit(True).alias("first"))
    fault = F.when(F.col("own") == BLANK, BLANK).when(F.col("first").isNull(), DUPLICATE).otherwise(F.col("own"))
    return rows.join(first, "pos", "left").select("ck", "seg", "pos", "turn", "initial", fault.cast("int").alias("fault"))


_PART = pa.schema(
    [("ck", pa.string()), ("seg", pa.int64()), ("n", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("first", pa.string()), ("last", pa.string())]
    + [("low", pa.int64()), ("high", pa.int64()), ("turns", pa.int64()), ("costs", pa.list_(pa.int64())), ("audits", pa.list_(pa.string()))]
)
_SQL_PART = "ck string, seg long, n long, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, costs array<long>, audits array<string>"
_COUNTS = ("n", "blank", "duplicate", "truncated", "illegal")


def _of_turn(row: dict, matrix: Matrix) -> dict:
    """A segment of one turn."""
    counts = {"n": 1, "blank": 0, "duplicate": 0, "truncated": 0, "illegal": 0}
    if row["fault"]:
        counts[("", "blank", "duplicate", "truncated")[row["fault"]]] = 1
    return {**counts, "first": row["initial"], "last": row["initial"], "low": row["turn"], "high": row["turn"], "turns": int(row["turn"] is not None), "matrix": matrix}


def joined(a: dict, b: dict) -> dict:
    """Two neighbouring segments as one; turns are in order, so a turn that both hold is the last of one and the first of the other."""
    out = {c: a[c] + b[c] for c in _COUNTS}
    out["illegal"] += (a["last"] + b["first"]) not in ("su", "ua", "au")
    shared = a["high"] is not None and a["high"] == b["low"]
    out |= {"first": a["first"], "last": b["last"], "turns": a["turns"] + b["turns"] - shared}
    out["low"] = b["low"] if a["low"] is None else a["low"]
    out["high"] = a["high"] if b["high"] is None else b["high"]
    return out | {"matrix": product(a["matrix"], b["matrix"])}


def _multiplied(found: Iterator[tuple[tuple, dict]]) -> Iterator[pa.RecordBatch]:
    """One row for each run of equal keys (conversation, segment); parts come in order."""
    rows: list[dict] = []
    of, held, size = None, None, 0

    def done() -> dict:
        cells = [x for line in held["matrix"] for x in line]
        return {**held, "ck": of[0], "seg": of[1], "costs": [None if x is None else x[0] for x in cells], "audits": [None if x is None else x[1] for x in cells]}

    for key, part in found:
        if key == of:
            held = joined(held, part)
            continue
        if held is not None:
            rows.append(done())
            size += held["n"]
            if size > 20_000:
                yield pa.RecordBatch.from_pylist(rows, _PART)
                rows, size = [], 0
        of, held = key, part
    if held is not None:
        rows.append(done())
        yield pa.RecordBatch.from_pylist(rows, _PART)


def segments(faults: DataFrame) -> DataFrame:
    """The product of every segment, with its counts: the leaves of the tree."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[tuple[str, int], Matrix] = {}

        def turns() -> Iterator[tuple[tuple, dict]]:
            for batch in batches:
                for row in batch.to_pylist():
                    kind = row["initial"], row["fault"]
                    if kind not in known:
                        known[kind] = turn_matrix(*kind)
                    yield (row["ck"], row["seg"]), _of_turn(row, known[kind])

        yield from _multiplied(turns())

    dealt = faults.repartition(size_in_partitions(faults), "ck", "seg").sortWithinPartitions("ck", "seg", "pos")
    return staged(dealt.mapInArrow(fold, _SQL_PART), "segments")


def reduced(leaves: DataFrame) -> DataFrame:
    """One product for each conversation: levels of the tree until no conversation has two segments."""

    def fold(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def parts() -> Iterator[tuple[tuple, dict]]:
            for batch in batches:
                for row in batch.to_pylist():
                    cells = [None if c is None else (c, a) for c, a in zip(row["costs"], row["audits"])]
                    yield (row["ck"], row["up"]), {**{c: row[c] for c in (*_COUNTS, "first", "last", "low", "high", "turns")}, "matrix": [cells[k : k + 4] for k in range(0, 16, 4)]}

        yield from _multiplied(parts())

    now = leaves
    while not now.groupBy("ck").agg(F.count(F.lit(1)).alias("n")).where("n > 1").isEmpty():
        up = now.withColumn("up", F.shiftright("seg", FAN_BITS))
        now = staged(up.repartition(size_in_partitions(leaves), "ck", "up").sortWithinPartitions("ck", "up", "seg").mapInArrow(fold, _SQL_PART), "segments")
    return now


def audits(whole: DataFrame) -> DataFrame:
    """(ck, cost, audit) of the reduced products."""

    def choose(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for costs, said in zip(batch.column("costs").to_pylist(), batch.column("audits").to_pylist()):
                cells = [None if c is None else (c, a) for c, a in zip(costs, said)]
                found.append(cheapest([cells[k : k + 4] for k in range(0, 16, 4)]))
            yield pa.RecordBatch.from_arrays([batch.column("ck"), pa.array([x[0] for x in found], pa.int64()), pa.array([x[1] for x in found], pa.string())], ["ck", "cost", "audit"])

    return whole.select("ck", "costs", "audits").mapInArrow(choose, "ck string, cost long, audit string")


def cut_at(audit: str, sizes: list[int]) -> Iterator[tuple[str, int, bool]]:
    """(part of the audit, turns of the result before it, whether the result begins with a system turn) for segments of so many turns.

    A part begins with its first turn's edit, the first part with what is inserted in front.
    """
    bare = lambda part: len(part) - part.count("D") - part.count(KEPT_BARE)
    odd, at, before = bare(audit) % 2 == 1, 0, 0
    for k, n in enumerate(sizes):
        end, turns = at, 0
        while end < len(audit) and (turns < n or audit[end] == "I" or k + 1 == len(sizes)):
            turns += audit[end] != "I"
            end += 1
        yield audit[at:end], before, odd
        before += bare(audit[at:end])
        at = end


def repaired_turns(ordered: DataFrame, leaves: DataFrame, chosen: DataFrame) -> DataFrame:
    """(ck, pos, sub, edit, role, text): the turns of the repaired conversations, in the order of pos and sub; edit is K, R or I."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [{"ck": r["ck"], "seg": s["seg"], "part": part, "before": before, "odd": odd} for r in batch.to_pylist() for s, (part, before, odd) in zip(r["segs"], cut_at(r["audit"], [s["n"] for s in r["segs"]]))]
            yield pa.RecordBatch.from_pylist(rows, pa.schema([("ck", pa.string()), ("seg", pa.int64()), ("part", pa.string()), ("before", pa.int64()), ("odd", pa.bool_())]))

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        schema = pa.schema([("ck", pa.string()), ("pos", pa.int64()), ("sub", pa.int32()), ("edit", pa.string()), ("role", pa.string()), ("text", pa.string())])
        part, at, j, odd = "", 0, 0, False
        for batch in batches:
            out = []

            def inserted(ck: str, pos: int, sub: int) -> None:
                nonlocal at, j
                while at < len(part) and part[at] == "I":
                    out.append({"ck": ck, "pos": pos, "sub": sub, "edit": "I", "role": ROLES["ua"[(j - odd) % 2]], "text": ""})  # noqa: B023
                    at, j, sub = at + 1, j + 1, sub + 1

            for r in batch.to_pylist():
                if r["part"] is not None:
                    part, at, j, odd = r["part"], 0, r["before"], r["odd"]
                    continue
                if at == 0:
                    inserted(r["ck"], r["pos"], -2)
                edit, at = part[at], at + 1
                if edit != "D":
                    role = ROLES["ua"[(j - odd) % 2]] if edit == "R" else r["role"]
                    out.append({"ck": r["ck"], "pos": r["pos"], "sub": 0, "edit": edit.replace(KEPT_BARE, "K"), "role": role, "text": r["text"]})
                    j += edit != KEPT_BARE
                inserted(r["ck"], r["pos"], 1)
            yield pa.RecordBatch.from_pylist(out, schema)

    of = leaves.groupBy("ck").agg(F.array_sort(F.collect_list(F.struct("seg", "n"))).alias("segs"))  # a row for 4,096 turns
    parts = chosen.join(of, "ck").select("ck", "audit", "segs").mapInArrow(cut, "ck string, seg long, part string, before long, odd boolean")
    none = lambda t: F.lit(None).cast(t)
    edits = parts.select("ck", "seg", F.lit(-1).cast("long").alias("pos"), "part", "before", "odd", none("string").alias("role"), none("string").alias("text"))
    rows = ordered.select("ck", "seg", "pos", none("string").alias("part"), none("long").alias("before"), none("boolean").alias("odd"), "role", "text")
    dealt = edits.unionAll(rows).repartition(size_in_partitions(ordered), "ck", "seg").sortWithinPartitions("ck", "seg", "pos")
    return dealt.mapInArrow(apply, "ck string, pos long, sub int, edit string, role string, text string")


def digests(repaired: DataFrame) -> DataFrame:
    """(ck, repaired_sha256) of each conversation's ``role:text`` lines: a stream in order, a digest at a time."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, state = None, None
        for batch in batches:
            out = []
            for ck, line in zip(batch.column("ck").to_pylist(), batch.column("line").to_pylist()):
                if ck == of:
                    state.update(b"\n")
                else:
                    out += [] if state is None else [(of, state.hexdigest())]
                    of, state = ck, hashlib.sha256()
                state.update(line.encode())
            yield pa.RecordBatch.from_arrays([pa.array([x[k] for x in out], pa.string()) for k in (0, 1)], ["ck", "repaired_sha256"])
        if state is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x], pa.string()) for x in (of, state.hexdigest())], ["ck", "repaired_sha256"])

    lines = repaired.select("ck", "pos", "sub", F.concat("role", F.lit(":"), "text").alias("line"))
    return lines.repartition(size_in_partitions(repaired), "ck").sortWithinPartitions("ck", "pos", "sub").mapInArrow(run, "ck string, repaired_sha256 string")


def repair(turns: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(a row for each conversation, the turns of the repaired conversations) of rows conv_id, turn, role, text.

    The first table has ck, cost, audit, n, gaps, blank, duplicate, truncated, illegal;
    the second one is ``repaired_turns``.  Nulls of role and text are a space, so a
    null text is blank and a null role cannot be kept; null turns come first and
    count in no gap; rows without conv_id are one conversation.  Equal rows are
    duplicates, equal turns of different rows are ordered by role and a hash of the
    text.  Very long texts only pass through; extra columns are not read; an
    empty table gives empty results.
    """
    ordered = in_order(turns)
    leaves = segments(with_faults(ordered))
    whole = reduced(leaves)
    chosen = staged(audits(whole), "audits")
    gaps = F.when(F.col("turns") > 0, F.col("high") - F.col("low") + 1 - F.col("turns")).otherwise(F.lit(0)).cast("long")
    table = whole.select("ck", "n", gaps.alias("gaps"), "blank", "duplicate", "truncated", "illegal").join(chosen.withColumn("audit", F.translate("audit", KEPT_BARE, "K")), "ck")
    return table, repaired_turns(ordered, leaves, chosen)


def conversation_repair(turns: DataFrame, every: int = 20) -> DataFrame:
    """One row for each conv_id of ``turns``: what ``repair`` finds after ``damaged``, and the digest of the repaired text.

    A conversation of which no row is left has zeros, no edits and the digest of
    the empty text.
    """
    table, repaired = repair(damaged(turns, every))
    every_conv = turns.groupBy(_key("conv_id").alias("ck")).agg(F.first("conv_id").alias("conv_id"))
    found = every_conv.join(table, "ck", "left").join(digests(repaired), "ck", "left")
    zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("gaps", "blank", "duplicate", "truncated", "illegal", "cost")]
    return found.select("conv_id", *zero, F.coalesce("audit", F.lit("")).alias("audit"), F.coalesce("repaired_sha256", F.lit(hashlib.sha256(b"").hexdigest())).alias("repaired_sha256"))
