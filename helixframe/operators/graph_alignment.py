"""Reads against window graphs: the best walk of every read, without listing walks.

Costs are those of a global alignment with affine gaps (``alignments.gap_affine``)
between the read and the bases along a walk from a source to a node that leads
nowhere.  One row of numbers over the read's positions passes through the nodes
in topological order; where nodes meet, the cheaper row is taken place by place.

Rows are banded around the places a node can have.  An alignment that leaves a band of
``w`` has a gap of more than ``w`` bases, so a result that costs no more than such a gap
is proven, else the band is doubled.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..staging import staged

#: The lower bits of a number say where its alignment entered the node, the upper ones what it costs.
UNIT = 1 << 26
FAR = np.int64(1) << 61
BAND = 64
#: Steps of walks that a task gathers before it passes them on.
MOST_STEPS = 100_000
_RC = str.maketrans("ACGTNacgtn", "TGCANtgcan")
Step = tuple[str, bool]


class WindowGraph:
    """A window's graph of oriented nodes from its sources on, in topological order; a circle raises."""

    def __init__(self, nodes: dict[str, str], edges: list[tuple[str, bool, str, bool]], sources: list[str]):
        after: dict[Step, set[Step]] = {}
        for a, ar, b, br in edges:
            after.setdefault((a, ar), set()).add((b, br))
            after.setdefault((b, not br), set()).add((a, not ar))
        found, todo = set(), [(s, False) for s in sources]
        while todo:
            step = todo.pop()
            if step not in found:
                found.add(step)
                todo += after.get(step, ())
        left = {s: 0 for s in found}
        for s in found:
            for t in after.get(s, ()):
                left[t] += 1
        starts = {(s, False) for s in sources}
        self.order: list[Step] = []
        ready = sorted((s for s, n in left.items() if n == 0), reverse=True)
        while ready:
            s = ready.pop()
            self.order.append(s)
            for t in sorted(after.get(s, ()), reverse=True):
                left[t] -= 1
                if left[t] == 0:
                    ready.append(t)
        if len(self.order) < len(found):
            raise ValueError("the graph has a circle")
        place = {s: k for k, s in enumerate(self.order)}
        self.before: list[list[int]] = [[] for _ in self.order]
        for s in self.order:
            for t in after.get(s, ()):
                self.before[place[t]].append(place[s])
        self.is_start = [s in starts for s in self.order]
        self.ends = [k for k, s in enumerate(self.order) if not after.get(s)]
        spelled = [nodes[n].translate(_RC)[::-1] if rev else nodes[n] for n, rev in self.order]
        self.spelled = [x.upper().encode("latin-1", "replace") for x in spelled]
        self.bases = [np.frombuffer(x, np.uint8) for x in self.spelled]
        # least and most bases in front of each node
        self.low, self.high = [0] * len(self.order), [0] * len(self.order)
        for k, before in enumerate(self.before):
            lows = [self.low[p] + len(self.bases[p]) for p in before] + [0] * self.is_start[k]
            self.low[k] = min(lows)
            self.high[k] = max([self.high[p] + len(self.bases[p]) for p in before] + [0] * self.is_start[k])

    def best_walk(self, read: str, mismatch: int = 4, gap_open: int = 6, gap_extend: int = 2) -> tuple[int, list[Step]] | None:
        """(cost, steps) of the cheapest walk, or None for a graph without an end."""
        if not self.ends:
            return None
        spelled = read.upper().encode("latin-1", "replace")
        same = self._exact(spelled)
        if same is not None:
            return 0, same
        seq = np.frombuffer(spelled, np.uint8)
        whole = max(len(seq), max(h + len(b) for h, b in zip(self.high, self.bases))) + 1
        band = min(BAND, whole)
        while True:
            cost, steps = self._banded(seq, band, mismatch, gap_open, gap_extend)
            if band >= whole or cost <= gap_open + gap_extend * (band + 1):
                return cost, steps
            band = min(2 * band, whole)

    def _exact(self, read: bytes) -> list[Step] | None:
        """The steps of the one walk that spells the read; None where none does or several do.

        All other alignments cost more than this walk's, which is free, so no numbers are needed.
        """
        # of each node, places of the read where it can end: the node before, or -1; -2 if more than one way leads there
        ends_at: list[dict[int, int]] = []
        for k, bases in enumerate(self.spelled):
            here: dict[int, int] = {}
            for p in [*self.before[k], *([-1] if self.is_start[k] else [])]:
                for at, way in (ends_at[p].items() if p >= 0 else ((0, -1),)):
                    if read.startswith(bases, at):
                        end = at + len(bases)
                        here[end] = -2 if end in here or way == -2 else p
            ends_at.append(here)
        last = [k for k in self.ends if len(read) in ends_at[k]]
        if len(last) != 1 or ends_at[last[0]][len(read)] == -2:
            return None
        steps, k, at = [], last[0], len(read)
        while k >= 0:
            steps.append(self.order[k])
            k, at = ends_at[k][at], at - len(self.spelled[k])
        return steps[::-1]

    def _banded(self, seq: np.ndarray, band: int, mismatch: int, gap_open: int, gap_extend: int) -> tuple[int, list[Step]]:
        n = len(seq)
        ext, opn, sub = gap_extend * UNIT, gap_open * UNIT, mismatch * UNIT
        at = np.arange(n + 1, dtype=np.int64)
        first = opn + ext * at
        first[0] = 0
        rows: list[tuple[np.ndarray, np.ndarray]] = []  # (best, best that ends in a skipped base) at each node's end
        came: list[tuple[np.ndarray, np.ndarray]] = []  # the node before, for both, at each place; -1 for none
        for k, bases in enumerate(self.bases):
            options = [rows[p] for p in self.before[k]] + ([(first, np.full(n + 1, FAR))] if self.is_start[k] else [])
            names = np.array([*self.before[k], *([-1] if self.is_start[k] else [])])
            both = []
            for which in (0, 1):
                every = np.stack([x[which] // UNIT for x in options])
                pick = every.argmin(0)
                both.append((every[pick, at], names[pick]))
            came.append((both[0][1], both[1][1]))
            far = FAR // UNIT
            best = np.where(both[0][0] >= far, FAR, both[0][0] * UNIT + 2 * at)
            skip = np.where(both[1][0] >= far, FAR, both[1][0] * UNIT + 2 * at + 1)
            low, high = max(0, self.low[k] - band), min(n, self.high[k] + band)
            best[:low], best[high + 1 :], skip[:low], skip[high + 1 :] = FAR, FAR, FAR, FAR
            for i, base in enumerate(bases, 1):
                lo, hi = self.low[k] + i - band, min(n, self.high[k] + i + band)
                lo = max(0, lo)
                if lo > hi:
                    best[:], skip[:] = FAR, FAR
                    break
                f = np.minimum(skip[lo : hi + 1] + ext, best[lo : hi + 1] + (opn + ext))
                from_ = max(lo, 1)
                d = best[from_ - 1 : hi] + np.where(seq[from_ - 1 : hi] == base, 0, sub)
                h = f.copy()
                h[from_ - lo :] = np.minimum(h[from_ - lo :], d)
                run = np.minimum.accumulate(h - ext * at[lo : hi + 1])
                h[1:] = np.minimum(h[1:], run[:-1] + (opn + ext * at[lo + 1 : hi + 1]))
                best[lo : hi + 1], skip[lo : hi + 1] = np.minimum(h, FAR), np.minimum(f, FAR)
                if lo:
                    best[lo - 1], skip[lo - 1] = FAR, FAR
            rows.append((best, skip))
        end = min(self.ends, key=lambda k: (rows[k][0][n] // UNIT, k))
        cost = int(rows[end][0][n] // UNIT)
        if cost >= FAR // UNIT:
            return cost, []
        steps, k, j, which = [], end, n, 0
        while k >= 0:
            steps.append(self.order[k])
            entered = int(rows[k][which][j] % UNIT)
            j, which = entered // 2, entered % 2
            k = int(came[k][which][j])
        return cost, steps[::-1]


def best_walks(reads: DataFrame, nodes: DataFrame, edges: DataFrame, sources: DataFrame) -> DataFrame:
    """(window_id, seq, cost, path) of every distinct read sequence (window_id, seq): its cheapest walk through its window's acyclic graph.

    A window's graph is packed into one row, as large as its bases, and meets its
    reads in a join, so reads of one window are dealt over tasks.  Windows
    without a graph and null sequences have no walk.
    """
    packed = nodes.select("window_id", F.struct("node", "seq").alias("n")).distinct().groupBy("window_id").agg(F.array_sort(F.collect_list("n")).alias("nodes"))
    joined = edges.select("window_id", "edge").distinct().groupBy("window_id").agg(F.array_sort(F.collect_list("edge")).alias("edges"))
    starts = sources.select("window_id", "node").distinct().groupBy("window_id").agg(F.array_sort(F.collect_list("node")).alias("sources"))
    graphs = staged(packed.join(starts, "window_id").join(joined, "window_id", "left"), "graphs")
    pairs = reads.where("seq is not null").select("window_id", "seq").distinct().join(graphs, "window_id")
    kind = reads.schema["window_id"].dataType.simpleString()

    step = pa.list_(pa.struct([("node", pa.string()), ("rev", pa.bool_())]))

    def align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        of, graph = None, None
        for batch in batches:
            rows, costs, paths, size = [], [], [], 0
            lists = [batch.column(c) for c in ("nodes", "edges", "sources")]
            # fields of structs as columns: a Python object for each struct would take longer than the walk
            fields = [[x.values.field(f) for f in names] for x, names in zip(lists, (("node", "seq"), ("a", "a_rev", "b", "b_rev")))]
            for row in range(batch.num_rows):  # one graph at a time as Python objects
                key = batch.column("window_id")[row].as_py()
                if graph is None or of != key:
                    spans = [slice(x.offsets[row].as_py(), x.offsets[row + 1].as_py()) for x in lists[:2]]
                    names, edge = ([f[at].to_pylist() for f in of_list] for of_list, at in zip(fields, spans))
                    of, graph = key, WindowGraph(dict(zip(*names)), list(zip(*edge)), lists[2][row].as_py())
                found = graph.best_walk(batch.column("seq")[row].as_py())
                if found is not None:
                    rows.append(row)
                    costs.append(found[0])
                    paths.append([{"node": n, "rev": rev} for n, rev in found[1]])
                    size += len(found[1])
                if rows and (size > MOST_STEPS or row == batch.num_rows - 1):
                    part = batch.select(["window_id", "seq"]).take(pa.array(rows))
                    yield pa.RecordBatch.from_arrays([*part.columns, pa.array(costs, pa.int64()), pa.array(paths, step)], ["window_id", "seq", "cost", "path"])
                    rows, costs, paths, size = [], [], [], 0

    return pairs.sortWithinPartitions("window_id").mapInArrow(align, f"window_id {kind}, seq string, cost long, path array<struct<node:string,rev:boolean>>")
