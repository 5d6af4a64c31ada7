"""Mixture-controlled packing by deficit round-robin over source queues.

Every source is a queue: its documents in order of (file task, row), their
token ids laid end to end.  Windows of ``window_tokens`` tokens take from every
queue its share of the window.  The part of a token that a share leaves over is
the queue's deficit; it is carried to the next window, over partition borders
too, because a quota is the difference of two cumulative sums in whole numbers:

    quota of queue s up to window w = A(s, w) - A(s - 1, w),
    A(s, w) = floor(tokens up to window w * tokens of queues up to s / all tokens)

The sum over the queues is exactly the window, so no window has a hole, and
the place of any token follows from its place in its queue alone.  With target
shares that differ from the queues' own, queues run dry one after another; each
span between two such points is packed by the same rule (``phases``).

Differences of floors can fall by one where a share is under two tokens a
window, so sources of small shares stand in a binary tree (``tail_paths``): a
node with L tokens on its left and R on its right gives floor(x * L / (L + R)) of
its first x tokens to the left, the others to the right.  Both rise with x, so
every source has its own cumulative quota, within one token a level of its
share, and a token's place is again a closed form along its source's path.

What moves is small: ids are written once; the queue sums are one row for
each (file task, source).
"""

from __future__ import annotations

import json
import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged, whole_text
from .token_counts import model_file

SEQUENCE_TOKENS = 2048
#: Tokens of a window: 64 sequences.
WINDOW_TOKENS = 64 * SEQUENCE_TOKENS
#: Sources with a window's share under this many tokens divide one queue by a tree: at most 256 queues, whatever the corpus.
LEAST_SHARE = 512
#: Sums by (file task, source) up to this many rows are broadcast (a few dozen bytes each), beyond it joined by a shuffle.
BROADCAST_ROWS = 200_000
#: Words whose ids a Python worker remembers.
REMEMBERED_WORDS = 600_000
END_ID = 1
_LOADED: dict[str, WordEncoder] = {}


class WordEncoder:
    """Ids of byte-level BPE texts, by words that are remembered.

    A text without runs of white space is cut before each single blank and line
    feed.  The pattern that the vocabulary's pre-tokenizer splits by never
    matches across such a place, so the ids are those of the whole text.  Merging
    by rank gives the merges' ids if each token's bytes, merged by lower ranks
    only, end in the two parts of its own merge; ``tests/llm`` checks this of the
    vocabulary.  Texts with other white space or special strings go to
    ``tokenizers`` itself.
    """

    SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"

    def __init__(self, path: str):
        import tiktoken
        from tokenizers import Tokenizer

        self.exact = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            model = json.load(f)
        special = {x["content"] for x in model["added_tokens"]}
        # the printable stand-ins of byte-level BPE, by their rule
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        stand_in = {chr(b): b for b in plain} | {chr(256 + k): b for k, b in enumerate(x for x in range(256) if x not in set(plain))}
        ranks = {bytes(stand_in[c] for c in w): i for w, i in model["model"]["vocab"].items() if w not in special}
        self.words = tiktoken.Encoding("words", pat_str=self.SPLIT, mergeable_ranks=ranks, special_tokens={})
        self.odd = ["\0", *sorted(special)]
        self.kind = "<u2" if max(*ranks.values(), self.exact.get_vocab_size() - 1, END_ID) < 65536 else "<u4"
        self.code = "H" if self.kind == "<u2" else "I"
        self.seen: dict[str, bytes] = {}

    def encode(self, text: str) -> bytes:
        """The ids, and the end id, as little-endian numbers of ``kind``."""
        end = array(self.code, [END_ID]).tobytes()
        # all white space is single blanks and line feeds between words: as many words as these make, and no other characters beside them
        parts, gaps = text.split(), text.count(" ") + text.count("\n")
        if len(parts) != gaps + 1 or sum(map(len, parts)) + gaps != len(text) or any(x in text for x in self.odd):
            return array(self.code, self.exact.encode(text, add_special_tokens=False).ids).tobytes() + end
        words = text.replace(" ", "\0 ").replace("\n", "\0\n").split("\0")
        seen, encode, code = self.seen, self.words.encode_ordinary, self.code
        if len(seen) > REMEMBERED_WORDS:
            seen.clear()
        for w in [w for w in words if w not in seen]:
            seen[w] = array(code, encode(w)).tobytes()
        return b"".join(map(seen.__getitem__, words)) + end


def encoder(model: str) -> WordEncoder:
    if model not in _LOADED:
        _LOADED[model] = WordEncoder(model_file(model))
    return _LOADED[model]


def tokenized(docs: DataFrame, id_col: str, text_col: str, source_col: str, model: str) -> DataFrame:
    """doc_id, source, task, before (tokens of this source earlier in this task), n_tokens, ids; staged."""
    from pyspark import TaskContext

    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(source_col).alias("source"), whole_text(text_col).alias("text"))
    kind = docs.schema[id_col].dataType

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tool, task, so_far = encoder(model), TaskContext.get().partitionId(), {}
        width = np.dtype(tool.kind).itemsize
        for batch in batches:
            for part in (batch.slice(i, 1024) for i in range(0, batch.num_rows, 1024)):
                sources = part.column("source").to_pylist()
                ids = [tool.encode(x) for x in part.column("text").to_pylist()]
                n, before = [len(x) // width for x in ids], []
                for s, k in zip(sources, n):
                    before.append(so_far.get(s, 0))
                    so_far[s] = before[-1] + k
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id"), part.column("source"), pa.array([task] * len(n), pa.int32()), pa.array(before, pa.int64()), pa.array(n, pa.int64()), pa.array(ids, pa.binary()), pa.array([width] * len(n), pa.int32())],
                    ["doc_id", "source", "task", "before", "n_tokens", "ids", "width"],
                )

    return staged(rows.mapInArrow(encode, f"doc_id {kind.simpleString()}, source string, task int, before long, n_tokens long, ids binary, width int"), "tokens")


def phases(tokens: list[int], shares: list[float], window: int) -> list[dict]:
    """Spans of the packed stream between two points where a queue runs dry.

    Each has ``at``, the stream position it starts at, and for each queue ``lo``
    and ``n``: the part of the queue it takes.  A part of under two tokens a
    window, whose rounded quotas could run backwards, follows as a span of its own.
    """
    left, lo, at, out = list(tokens), [0] * len(tokens), 0, []
    while any(left):
        live = [s for s, n in enumerate(left) if n]
        weight = {s: shares[s] for s in live}
        if not any(weight.values()):
            weight = {s: left[s] for s in live}
        live = [s for s in live if weight[s] > 0]
        dry = min(live, key=lambda s: (left[s] / weight[s], s))
        take = [0] * len(left)
        for s in live:
            take[s] = min(left[s], int(left[dry] * weight[s] / weight[dry]))
        take[dry] = left[dry]
        # the last queue's quotas, what all below it leave, never run backwards
        few = [s for s in live if s != len(left) - 1 and 0 < take[s] * window < 2 * sum(take)]
        alone = [[n if k == s else 0 for k, n in enumerate(take)] for s in few]
        for part in [[0 if k in few else n for k, n in enumerate(take)], *alone]:
            out.append({"at": at, "lo": list(lo), "n": part})
            at += sum(part)
            for s, n in enumerate(part):
                lo[s] += n
                left[s] -= n
    return out


def cut(start: int, length: int, queue: int, plan: list[dict], window: int, sequence: int) -> list[tuple[int, int, int, int]]:
    """Pieces (tokens before it in the document, length, stream position, window) of a document at ``start`` in its queue."""
    out: list[list[int]] = []
    for phase in plan:
        lo, n = max(start, phase["lo"][queue]), min(start + length, phase["lo"][queue] + phase["n"][queue])
        if lo >= n:
            continue
        total, upto = sum(phase["n"]), sum(phase["n"][: queue + 1])
        below = upto - phase["n"][queue]

        def edge(w: int, upto: int = upto, below: int = below, total: int = total) -> tuple[int, int, int]:
            b = min(w * window, total)
            return b, b * below // total, b * upto // total  # stream position, what queues below have had, and with this one

        at, stop = lo - phase["lo"][queue], n - phase["lo"][queue]
        w = max(0, at * total // (phase["n"][queue] * window) - 2)
        while at < stop:
            b0, below0, upto0 = edge(w)
            b1, below1, upto1 = edge(w + 1)
            if (had := upto1 - below1) > at:
                to = min(stop, had)
                pos = phase["at"] + b0 + (below1 - below0) + at - (upto0 - below0)
                while at < to:
                    k = min(to - at, sequence - pos % sequence)
                    before = at + phase["lo"][queue] - start
                    if out and out[-1][0] + out[-1][1] == before and out[-1][2] + out[-1][1] == pos and pos % sequence:
                        out[-1][1] += k
                    else:
                        out.append([before, k, pos, phase["at"] // window + w])
                    at, pos = at + k, pos + k
            w += 1
    return [tuple(x) for x in out]


def _upto(x: int, path: list[tuple[int, int, bool]]) -> tuple[int, int]:
    """Of the first ``x`` tokens of the tree: those of sources before this path's, and of its own; ``path`` from the root on."""
    below = 0
    for left, right, is_right in path:
        n = x * left // (left + right)
        if is_right:
            below, x = below + n, x - n
        else:
            x = n
    return below, x


def _place(i: int, path: list[tuple[int, int, bool]]) -> int:
    """The tree's token that is token ``i`` of the path's source."""
    for left, right, is_right in reversed(path):
        i = i * (left + right) // right if is_right else ((i + 1) * (left + right) - 1) // left
    return i


def cut_tail(start: int, length: int, path: list[tuple[int, int, bool]], queue: int, plan: list[dict], window: int, sequence: int) -> list[tuple[int, int, int, int]]:
    """As ``cut``, of a document at ``start`` in its source, which has a part of the queue by ``path``."""
    out: list[list[int]] = []
    i, stop = start, start + length
    while i < stop:
        x = _place(i, path)
        phase = next(p for p in plan if p["lo"][queue] <= x < p["lo"][queue] + p["n"][queue])
        lo, n, total, upto = phase["lo"][queue], phase["n"][queue], sum(phase["n"]), sum(phase["n"][: queue + 1])
        below, at = upto - n, x - phase["lo"][queue]

        def edge(w: int, upto: int = upto, below: int = below, total: int = total) -> tuple[int, int, int]:
            b = min(w * window, total)
            return b, b * below // total, b * upto // total

        w = max(0, at * total // (n * window) - 2)
        while (e1 := edge(w + 1))[2] - e1[1] <= at:
            w += 1
        b0, below0, upto0 = edge(w)
        # the queue's own tokens of this window, and what of them earlier sources of the tree and this one have
        before0, own0 = _upto(lo + upto0 - below0, path)
        before1, own1 = _upto(lo + e1[2] - e1[1], path)
        pos = phase["at"] + b0 + (e1[1] - below0) + (before1 - before0) + i - own0
        to = min(stop, own1)
        while i < to:
            k = min(to - i, sequence - pos % sequence)
            if out and out[-1][0] + out[-1][1] == i - start and out[-1][2] + out[-1][1] == pos and pos % sequence:
                out[-1][1] += k
            else:
                out.append([i - start, k, pos, phase["at"] // window + w])
            i, pos = i + k, pos + k
    return [tuple(x) for x in out]


def tail_paths(sources: DataFrame) -> DataFrame:
    """(source, path): the tree's nodes from the root to each source of (source, n), as (left, right, is_right).

    Sources are numbered in order of their names; the node of a level above the
    sources is the number without its last bits, so its sums are grouped sums.
    """
    spread = staged(sources.repartitionByRange("source").sortWithinPartitions("source").withColumn("_p", F.spark_partition_id()).withColumn("_i", F.monotonically_increasing_id().bitwiseAND((1 << 33) - 1)), "tail")
    # one row for each partition
    sizes = spread.groupBy("_p").agg(F.count(F.lit(1)).alias("_c")).orderBy("_p").collect()
    starts, levels = [], 0
    for r in sizes:
        starts.append((r["_p"], levels))
        levels += r["_c"]
    levels = max(0, levels - 1).bit_length()
    first = sources.sparkSession.createDataFrame(starts, "_p int, _s long")
    numbered = spread.join(F.broadcast(first), "_p").select("source", "n", (F.col("_s") + F.col("_i")).alias("k"))
    if not levels:
        return numbered.select("source", F.array().cast("array<struct<left:bigint,right:bigint,is_right:boolean>>").alias("path"))
    numbered = staged(numbered, "numbered")
    each = numbered.withColumn("level", F.explode(F.sequence(F.lit(0), F.lit(levels - 1)))).withColumn("node", F.expr("shiftright(k, level)"))
    sums = each.groupBy("level", "node").agg(F.sum("n").alias("s"))
    half = sums.groupBy("level", F.shiftright("node", 1).alias("parent")).agg(
        F.coalesce(F.sum(F.when(F.col("node") % 2 == 0, F.col("s"))), F.lit(0)).alias("left"), F.coalesce(F.sum(F.when(F.col("node") % 2 == 1, F.col("s"))), F.lit(0)).alias("right")
    )
    steps = each.withColumn("parent", F.shiftright("node", 1)).join(half, ["level", "parent"]).where("left > 0 and right > 0")
    paths = steps.groupBy("source").agg(F.array_sort(F.collect_list(F.struct((-F.col("level")).alias("o"), "left", "right", (F.col("node") % 2 == 1).alias("is_right")))).alias("p"))
    return paths.select("source", F.transform("p", lambda x: F.struct(x["left"].alias("left"), x["right"].alias("right"), x["is_right"].alias("is_right"))).alias("path"))


def packed(
    docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", source_col: str = "source", model: str = "byte_bpe_50k.json",
    targets: dict[str, float] | None = None, sequence_tokens: int = SEQUENCE_TOKENS, window_tokens: int = WINDOW_TOKENS, with_ids: bool = False,
) -> DataFrame:
    """Pieces of documents in sequences: doc_id, source, start, length, ids_crc32, doc_tokens, sequence_id, offset, window_id (and ids).

    ``targets`` gives sources their token proportions (by default what the
    corpus has); sources it does not name come last.  A null or empty text is its
    end id alone; a null source is the source "".  Rows with equal or null
    identifiers are packed each for itself.  Each id of each row lies in exactly
    one piece.  Only the last sequence is not full.  Other columns are not read;
    an empty table gives an empty result.
    """
    spark = docs.sparkSession
    tokens = tokenized(docs, id_col, text_col, source_col, model)
    sums = staged(tokens.groupBy("task", "source").agg(F.sum("n_tokens").alias("n")), "sums")
    by_source = sums.groupBy("source").agg(F.sum("n").alias("n")).orderBy("source")
    total = by_source.agg(F.sum("n")).first()[0] or 0
    # at most WINDOW / LEAST_SHARE sources are queues of their own; these few rows are all that reaches the driver
    named = by_source.where((F.col("n") / F.lit(float(max(1, total))) >= LEAST_SHARE / window_tokens) | F.col("source").isin(list(targets or {}))).collect()
    queue = {r["source"]: k for k, r in enumerate(named)}
    n = [int(r["n"]) for r in named]
    rest = total - sum(n)
    shares = [float((targets or {}).get(r["source"], 0.0)) for r in named] if targets else [float(x) for x in n]
    plan = phases([*n, rest], [*shares, 0.0 if targets else float(rest)], window_tokens)
    number = F.coalesce(*[F.when(F.col("source") == s, k) for s, k in queue.items()], F.lit(len(named)))
    queues = sums.withColumn("queue", number.cast("int"))
    # a source's own sums over the file tasks; sources of the tail divide their queue by the tree
    order = Window.partitionBy("source").orderBy("task").rowsBetween(Window.unboundedPreceding, -1)
    base = queues.withColumn("base", F.coalesce(F.sum("n").over(order), F.lit(0))).select("task", "source", "queue", "base")
    if rest:
        tail = queues.where(F.col("queue") == len(named)).groupBy("source").agg(F.sum("n").alias("n"))
        base = base.join(tail_paths(tail), "source", "left")
    else:
        base = base.withColumn("path", F.lit(None).cast("array<struct<left:bigint,right:bigint,is_right:boolean>>"))
    rows = sums.count()
    placed = tokens.join(F.broadcast(base) if rows <= BROADCAST_ROWS else base, ["task", "source"])
    told, last = spark.sparkContext.broadcast(plan), len(named)
    kind = docs.schema[id_col].dataType
    schema = f"doc_id {kind.simpleString()}, source string, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, offset long, window_id long" + ", ids array<int>" * with_ids

    def pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        plan = told.value
        for batch in batches:
            of, found, ids = [], [], []
            cols = [batch.column(c).to_pylist() for c in ("before", "base", "n_tokens", "queue", "ids", "width", "path")]
            for k, (before, at, length, q, raw, width, path) in enumerate(zip(*cols)):
                wide = np.frombuffer(raw, f"<u{width}").astype("<u4")
                if q < last:
                    found_pieces = cut(at + before, length, q, plan, window_tokens, sequence_tokens)
                else:
                    found_pieces = cut_tail(at + before, length, [(x["left"], x["right"], x["is_right"]) for x in path or []], q, plan, window_tokens, sequence_tokens)
                for start, size, pos, w in found_pieces:
                    of.append(k)
                    found.append((start, size, zlib.crc32(wide[start : start + size].tobytes()), length, pos // sequence_tokens, pos % sequence_tokens, w))
                    if with_ids:
                        ids.append(wide[start : start + size].astype(np.int32))
            of = pa.array(of, pa.int32())
            out = [batch.column("doc_id").take(of), batch.column("source").take(of), *(pa.array(x, pa.int64()) for x in (zip(*found) if found else [[]] * 7))]
            names = ["doc_id", "source", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", "window_id"]
            if with_ids:
                out, names = [*out, pa.array(ids, pa.list_(pa.int32()))], [*names, "ids"]
            yield pa.RecordBatch.from_arrays(out, names)

    return placed.select("doc_id", "source", "before", "base", "n_tokens", "queue", "ids", "width", "path").mapInArrow(pieces, schema)


def sequences(pieces: DataFrame) -> DataFrame:
    """Whole sequences from ``packed(..., with_ids=True)``: sequence_id, ids (in order), n_tokens.  A group is one sequence, so it is bounded."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    return pieces.groupBy("sequence_id").agg(F.flatten(F.transform(parts, lambda x: x["ids"])).alias("ids"), F.sum("length").alias("n_tokens"))
