"""MinHash near-duplicates by tensored banding, with links confirmed on full shingle sets.

Two small collections of minhashes, A and B, of ``HALVES`` half keys each
(``ROWS`` minhashes a half key) give HALVES * HALVES tables: the key of table
(i, j) is the pair (A_i, B_j).  2 * HALVES * ROWS minhashes thus serve as
many tables as a plain scheme needs HALVES * HALVES * 2 * ROWS for.  A pair of
similarity s meets in some table unless all half keys of one side differ:

    miss <= 2 * (1 - s ** ROWS) ** HALVES      (about 1e-4 at s = 0.75)

Documents with equal sets are one class first.  A half key A_i that one class
alone has needs no B side, so only shared ones are expanded.  Inside a table
entry nobody is paired with everybody: all members are held against a pivot (the
smallest), links join components, members that stay apart from the pivot are
held against the next pivot, and what is then still in different components
of one entry is compared across them: in blocks of ``BLOCK_ROWS`` members, each
pair in the first table alone that it shares.  A pivot's pairs are dealt over
groups of about ``SALT_ROWS``, so that a pivot that thousands of documents
share is not one task.  Before sets are fetched, a pair's
``SKETCH`` minhashes (4 bits of each) must agree in ``AGREE`` places; a pair of
similarity 0.75 does in all but 3 of 100,000 cases.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import staged, whole_text
from .components import components

WORDS = 5
PERCENT = 75
HALVES, ROWS = 12, 2
SKETCH, AGREE = 384, 261
BLOCK_ROWS = 512
SALT_ROWS = 256
PIVOTS = 2
#: Words whose hashes a task remembers; an idle worker holds none.
REMEMBERED_WORDS = 200_000
#: Shingles that are hashed at a time.
BLOCK = 200_000
_RNG = np.random.default_rng(20240611)
_TIMES = _RNG.integers(0, 2**31, SKETCH, dtype=np.uint32) * np.uint32(2) + np.uint32(1)
_STEP = np.uint64(0x9E3779B97F4A7C15)
_SEEN: dict[bytes, int] = {}


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def shingles(text: str) -> np.ndarray:
    """The sorted distinct hashes (64 bits) of a text's shingles.

    bytes.lower() folds A-Z alone and bytes.split() parts at ASCII white space alone, as the contract has it.
    """
    words = text.encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    if len(_SEEN) > REMEMBERED_WORDS:
        _SEEN.clear()
    try:
        h = np.fromiter(map(_SEEN.__getitem__, words), np.uint64, len(words))
    except KeyError:
        for w in words:
            if w not in _SEEN:
                _SEEN[w] = xxhash.xxh64_intdigest(w)
        h = np.fromiter(map(_SEEN.__getitem__, words), np.uint64, len(words))
    size = min(WORDS, len(words))
    out = np.full(len(words) - size + 1, size, np.uint64)
    for k in range(size):
        out = out * _STEP + h[k : k + len(out)]
        out ^= out >> np.uint64(29)
    return np.unique(_mix(out))


def half_keys(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """[documents, 2 * HALVES] half keys, the first HALVES of side A, and [documents, SKETCH / 16] sketches; the sets must not be empty.

    A minhash is the least product of the shingles' upper 32 bits, which are
    mixed already, with an odd number.
    """
    flat = (np.concatenate(sets) >> np.uint64(32)).astype(np.uint32)
    starts = np.cumsum([0, *map(len, sets)])[:-1]
    keys = np.zeros((len(sets), 2 * HALVES), np.uint64)
    sketch = np.zeros((len(sets), SKETCH // 16), np.uint64)
    for k in range(SKETCH):
        low = np.minimum.reduceat(flat * _TIMES[k], starts).astype(np.uint64)
        if k < 2 * HALVES * ROWS:
            keys[:, k // ROWS] = _mix(keys[:, k // ROWS] * _STEP + low)
        sketch[:, k // 16] |= (_mix(low) >> np.uint64(60)) << np.uint64(4 * (k % 16))
    return keys, sketch


def signatures(docs: DataFrame, id_col: str, text_col: str, row_col: str | None = None) -> DataFrame:
    """row_id, doc_id, text_key, set_id (16 bytes, null without words), n_shingles, a and b (half keys), sketch; staged."""
    kind = docs.schema[id_col].dataType
    rows = docs.select((F.col(row_col) if row_col else F.monotonically_increasing_id()).alias("row_id"), F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    rows = rows.select("row_id", "doc_id", F.xxhash64("text").alias("text_key"), "text")

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        longs = pa.list_(pa.int64())
        for batch in batches:
            texts = batch.column("text")
            at = 0
            while at < batch.num_rows:
                sets, held, start = [], 0, at
                while at < batch.num_rows and held < BLOCK:
                    sets.append(shingles(texts[at].as_py()))
                    held, at = held + len(sets[-1]), at + 1
                full = [x for x in sets if len(x)]
                keys = iter(np.hstack(half_keys(full)).view(np.int64).tolist() if full else [])
                mine = [next(keys) if len(x) else [] for x in sets]
                part = batch.slice(start, at - start)
                yield pa.RecordBatch.from_arrays(
                    [part.column("row_id"), part.column("doc_id"), part.column("text_key"), pa.array([xxhash.xxh3_128_digest(x.tobytes()) if len(x) else None for x in sets], pa.binary()), pa.array(list(map(len, sets)), pa.int64()), pa.array([x[:HALVES] for x in mine], longs), pa.array([x[HALVES : 2 * HALVES] for x in mine], longs), pa.array([x[2 * HALVES :] for x in mine], longs)],
                    ["row_id", "doc_id", "text_key", "set_id", "n_shingles", "a", "b", "sketch"],
                )
        _SEEN.clear()

    return staged(rows.mapInArrow(sign, f"row_id long, doc_id {kind.simpleString()}, text_key long, set_id binary, n_shingles long, a array<long>, b array<long>, sketch array<long>"), "signatures")


def full_sets(docs: DataFrame, wanted: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(node, shingles) of the wanted (node, doc_id, text_key, set_id) rows, made again from the whole texts; staged.

    Texts are found by identifier and hash: rows that share an identifier, or have none, meet their own text's node only.
    """
    texts = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text")).withColumn("own_key", F.xxhash64("text"))
    rows = texts.join(wanted.withColumnRenamed("doc_id", "of"), (F.col("own_key") == F.col("text_key")) & F.col("doc_id").eqNullSafe(F.col("of"))).select("node", "set_id", "text")

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                found = [shingles(x) for x in part.column("text").to_pylist()]
                same = [k for k, (x, i) in enumerate(zip(found, part.column("set_id").to_pylist())) if xxhash.xxh3_128_digest(x.tobytes()) == i]
                yield pa.RecordBatch.from_arrays([part.column("node").take(pa.array(same, pa.int64())), pa.array([found[k].view(np.int64) for k in same], pa.list_(pa.int64()))], ["node", "shingles"])
        _SEEN.clear()

    return staged(rows.mapInArrow(sets, "node long, shingles array<long>").groupBy("node").agg(F.first("shingles").alias("shingles")), "sets")


def agree(x: Column, y: Column) -> Column:
    """Whether two sketches agree in AGREE places or more; in whole-stage code, four bits at a time."""
    apart = F.lit(0)
    for k in range(SKETCH // 16):
        z = x[k].bitwiseXOR(y[k])
        z = z.bitwiseOR(F.shiftrightunsigned(z, 1))
        z = z.bitwiseOR(F.shiftrightunsigned(z, 2)).bitwiseAND(F.lit(0x1111111111111111))
        apart = apart + F.bit_count(z)
    return apart <= SKETCH - AGREE


def _beside(pairs: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """The pairs (u, salt, v) with ``value`` of both nodes as x and y; that of u is copied once for each of its salts."""
    x, y = values.select(F.col("node").alias("u"), F.col(value).alias("x")), values.select(F.col("node").alias("v"), F.col(value).alias("y"))
    heads = pairs.select("u", "salt").distinct().join(x, "u")
    return pairs.join(heads, ["u", "salt"]).join(y, "v")


def sketched(pairs: DataFrame, sketches: DataFrame) -> DataFrame:
    """The pairs (u, salt, v) whose sketches agree."""
    return _beside(pairs, sketches, "sketch").where(agree(F.col("x"), F.col("y"))).select("u", "salt", "v")


def confirmed(pairs: DataFrame, sets: DataFrame) -> DataFrame:
    """The pairs (u, v) of (u, salt, v) whose full sets meet the threshold."""
    both = F.size(F.array_intersect("x", "y"))
    return _beside(pairs, sets, "shingles").where(100 * both >= PERCENT * (F.size("x") + F.size("y") - both)).select("u", "v")


def apart_pairs(mixed: DataFrame, sketches: DataFrame) -> DataFrame:
    """Distinct (u, v) of different components in one entry whose sketches agree.

    An entry's members are dealt over blocks by a hash; every two blocks meet in
    one small group, so no group grows with the entry.  Only pairs that agree
    leave a group.
    """
    size = mixed.groupBy("entry").agg(F.ceil(F.count(F.lit(1)) / BLOCK_ROWS).cast("int").alias("blocks"))
    dealt = mixed.join(size, "entry").withColumn("block", F.pmod(F.xxhash64("node", F.lit(7)), F.col("blocks")).cast("int"))
    met = dealt.withColumn("with", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1))).select(
        "entry", "tab", F.least("block", "with").alias("i"), F.greatest("block", "with").alias("j"), (F.col("block") > F.col("with")).alias("second"), "node", "root", "n_shingles"
    )
    rows = met.join(sketches, "node").repartition("entry", "i", "j").sortWithinPartitions("entry", "i", "j")
    longs, ints = SKETCH // 16, 2 * HALVES

    def pairs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: pa.Table | None = None

        def groups() -> Iterator[pa.Table]:
            nonlocal held
            for batch in batches:
                now = pa.Table.from_batches([batch])
                now = now if held is None else pa.concat_tables([held, now])
                key = np.stack([now[c].to_numpy() for c in ("entry", "i", "j")], 1)
                cuts = [0, *(np.flatnonzero((key[1:] != key[:-1]).any(1)) + 1).tolist()]
                for lo, hi in zip(cuts, cuts[1:]):
                    yield now.slice(lo, hi - lo)
                held = now.slice(cuts[-1])  # the last group may go on in the next batch
            if held is not None and held.num_rows:
                yield held

        flat = lambda t, c, n: t[c].combine_chunks().flatten().to_numpy(zero_copy_only=False).reshape(-1, n)
        for t in groups():
            root, size, node, second = (t[c].to_numpy(zero_copy_only=False) for c in ("root", "n_shingles", "node", "second"))
            if t.num_rows < 2 or (root == root[0]).all():
                continue
            sketch = flat(t, "sketch", longs).astype(np.int64).view(np.uint8)
            sketch = np.concatenate([sketch & 15, sketch >> 4], 1)
            half, tab = flat(t, "halves", ints), int(t["tab"][0].as_py())
            same_block = t["i"][0].as_py() == t["j"][0].as_py()
            us, vs = [], []
            for x in range(t.num_rows):
                if not same_block and second[x]:
                    continue
                y = np.arange(x + 1, t.num_rows) if same_block else np.flatnonzero(second)
                y = y[(root[y] != root[x]) & (100 * np.minimum(size[y], size[x]) >= PERCENT * np.maximum(size[y], size[x]))]
                y = y[(sketch[y] == sketch[x]).sum(1) >= AGREE]
                if len(y):
                    both = half[y] == half[x]
                    # the first table that the two share
                    y = y[(both[:, :HALVES].argmax(1) == tab // HALVES) & (both[:, HALVES:].argmax(1) == tab % HALVES)]
                    us.append(np.minimum(node[y], node[x]))
                    vs.append(np.maximum(node[y], node[x]))
            if us:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(us), pa.int64()), pa.array(np.concatenate(vs), pa.int64())], ["u", "v"])

    return rows.mapInArrow(pairs, "u long, v long").distinct()


def candidates(members: DataFrame, tried: DataFrame | None) -> DataFrame:
    """Distinct (u, salt, v), u the pivot of an entry (of n members) that v is a member of; sizes that cannot meet the threshold are left out."""
    pivot = members.groupBy("entry").agg(F.min(F.struct("node", "n_shingles")).alias("pivot"), F.count(F.lit(1)).alias("n"))
    pairs = (
        members.join(pivot, "entry")
        .where((F.col("node") != F.col("pivot.node")) & (100 * F.least("n_shingles", "pivot.n_shingles") >= PERCENT * F.greatest("n_shingles", "pivot.n_shingles")))
        .groupBy(F.col("pivot.node").alias("u"), F.col("node").alias("v"))
        .agg(F.max("n").alias("n"))
        .select("u", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / SALT_ROWS)).cast("int").alias("salt"), "v")
    )
    return pairs if tried is None else pairs.join(tried, ["u", "v"], "left_anti")


def _labelled(members: DataFrame, links: DataFrame) -> tuple[DataFrame, DataFrame]:
    """The members of entries that hold more than one component still, with their roots; and the components."""
    roots = staged(components(links), "roots")
    rooted = members.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    mixed = rooted.groupBy("entry").agg(F.min("root").alias("lo"), F.max("root").alias("hi")).where("lo != hi").select("entry")
    return rooted.join(mixed, "entry", "left_semi"), roots


def near_dedup(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", row_col: str | None = None) -> DataFrame:
    """One row per input row: row_id, doc_id, n_shingles, component_id, kept.

    Links are pairs with 100 * intersection >= 75 * union of their sets of
    distinct 5-word shingles (a text of fewer words is one shingle).  A text
    that is null, empty or blank has no shingles and stays for itself.
    component_id is the smallest identifier that links lead to; null identifiers
    come last, and of rows with the same identifier the first stays.
    Repeated rows are one class.  Other columns are not read.  An empty table
    gives an empty result.
    """
    signed = signatures(docs, id_col, text_col, row_col)
    entry = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "row_id")
    classes = staged(signed.where("set_id is not null").groupBy("set_id").agg(F.min(entry).alias("first"), F.min_by("text_key", entry).alias("text_key"), F.count(F.lit(1)).alias("copies")), "classes")
    ids = classes.select(F.col("first.row_id").alias("node"))
    reps = signed.join(ids, signed.row_id == ids.node, "left_semi").select(F.col("row_id").alias("node"), "n_shingles", "a", "b", "sketch")

    # half keys of side A that two classes or more share
    side_a = reps.select("node", F.posexplode("a").alias("i", "half"))
    shared = side_a.groupBy("i", "half").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("i", "half")
    met = side_a.join(shared, ["i", "half"]).groupBy("node").agg(F.collect_list(F.struct("i", "half")).alias("met"))  # HALVES at most
    keys = (
        reps.select("node", "n_shingles", "b").join(met, "node")
        .select("node", "n_shingles", "met", F.posexplode("b").alias("j", "other"))
        .select("node", "n_shingles", "j", "other", F.explode("met").alias("m"))
        .withColumn("tab", F.col("m.i") * HALVES + F.col("j"))
        .select("node", "n_shingles", "tab", F.xxhash64("tab", "m.half", "other").alias("entry"))
    )
    keys = staged(keys, "keys")
    full = keys.groupBy("entry").agg(F.count(F.lit(1)).alias("n")).where("n > 1").select("entry")
    members = staged(keys.join(full, "entry", "left_semi"), "members")

    wanted = members.select("node").distinct().join(classes.select(F.col("first.row_id").alias("node"), F.col("first.doc_id").alias("doc_id"), "text_key", "set_id"), "node")
    sets = full_sets(docs, wanted, id_col, text_col)
    sketches = staged(reps.join(members.select("node").distinct(), "node", "left_semi").select("node", "sketch", F.transform(F.concat("a", "b"), lambda x: F.shiftright(x, 32).cast("int")).alias("halves")), "sketches")
    links, tried, roots = None, None, None
    rest = members
    for _ in range(PIVOTS):
        pairs = staged(candidates(rest, tried), "pairs")
        tried = pairs.select("u", "v") if tried is None else tried.unionAll(pairs.select("u", "v"))
        found = staged(confirmed(sketched(pairs, sketches), sets), "links")
        links = found if links is None else links.unionAll(found)
        mixed, roots = _labelled(members, links)
        mixed = staged(mixed, "mixed")
        if mixed.isEmpty():
            break
        # next: members apart from all pivots so far
        apart = mixed.groupBy("entry").agg(F.min(F.struct("node", "root")).alias("p"))
        rest = mixed.join(apart, "entry").where("root != p.root").select("entry", "node", "n_shingles")
    else:
        across = apart_pairs(mixed, sketches)
        left = staged(across.join(tried, ["u", "v"], "left_anti").withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(8)).cast("int")), "across")
        found = staged(confirmed(left, sets), "links")
        if not found.isEmpty():
            roots = staged(components(links.unionAll(found)), "roots")

    # the first row of every component, for the classes that are not their own whole component
    node = classes.select("set_id", "copies", "first", F.col("first.row_id").alias("node"))
    rooted = node.join(roots, "node", "left").withColumn("root", F.coalesce("root", "node"))
    best = rooted.groupBy("root").agg(F.min("first").alias("best"))
    moved = staged(rooted.join(best, "root").where("copies > 1 or best.row_id != node").select("set_id", "best"), "moved")
    return signed.join(moved, "set_id", "left").select(
        "row_id", "doc_id", "n_shingles",
        F.when(F.col("best").isNull(), F.col("doc_id")).otherwise(F.col("best.doc_id")).alias("component_id"),
        (F.col("best").isNull() | (F.col("best.row_id") == F.col("row_id"))).alias("kept"),
    )


def drop_near_copies(docs: DataFrame, row_col: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs`` that stay, one of each component, with all their columns."""
    found = near_dedup(docs, id_col, text_col, row_col)
    return docs.join(found.where("not kept").select(F.col("row_id").alias(row_col)), row_col, "left_anti")
