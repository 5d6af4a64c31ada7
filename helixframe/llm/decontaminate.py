"""Benchmark decontamination by q-gram lemma filtering and banded alignment.

Benchmark items are searched as windows of up to ``WINDOW`` characters (with
half overlaps), each with an edit budget of a tenth of its length, so a run of
WINDOW * 3 / 2 characters holds a whole window.  Windows of ``RUN`` characters,
every RUN / 2, are searched verbatim beside them: any verbatim run of
RUN * 3 / 2 - 1 characters of an item holds one of these.  Items under
``LEAST_CHARS`` are searched verbatim at word borders.  A text
region within ``e`` edits of a window of ``m`` characters shares with it at
least ``m + 1 - Q - Q * e`` q-grams whose diagonals (place in the text minus
place in the window) lie within ``e + 1`` neighbours.  Diagonals are counted
in bands of twice that width that overlap by half, so every such range lies
whole in some band and no region within the budget is missed.  Bands that reach
the bound are verified by a banded alignment of the window against the region.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from .common import whole_text

Q = 8
WINDOW = 120
EDITS_PER_CHAR = 0.1
#: Characters of the windows of longer items that are searched verbatim.
RUN = 40
#: Items shorter than this (normalised) bear no edits; they are searched verbatim, at word borders.
LEAST_CHARS = 24
#: Characters of benchmark text whose index is broadcast at once, of about 120 bytes each (50 MB); a larger benchmark is searched in as many blocks as it takes.
BLOCK_CHARS = 400_000
#: Shared q-grams (place in the text, place in a window) that are counted at once.
MOST_POSTS = 1_000_000
_LOWER = np.array([ord(chr(c).lower()) if len(chr(c).lower()) == 1 else c for c in range(0x2000)], np.uint32)
_SPACE = np.array([chr(c).isspace() for c in range(0x3001)])
_P = [pow(0x9E3779B97F4A7C15, k, 1 << 64) for k in (1, 2, 4)]
_BITS = 22
_TOKEN = re.compile(r"\w+|[^\w\s]")


def normalised(text: str) -> tuple[np.ndarray, np.ndarray]:
    """Code points, lower-case where that is one character and with white-space runs as one blank; and the place of each in the text."""
    c = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    low = np.where(c < 0x2000, _LOWER[np.minimum(c, 0x1FFF)], c)
    space = (c <= 0x3000) & _SPACE[np.minimum(c, 0x3000)]
    if not space.any():
        return low, np.arange(len(c))
    low[space] = 32
    keep = np.ones(len(c), bool)
    keep[1:] = ~(space[1:] & space[:-1])
    place = np.flatnonzero(keep)
    return low[place], place


def _text(codes: np.ndarray) -> str:
    return codes.astype("<u4").tobytes().decode("utf-32-le", "surrogatepass")


def grams(codes: np.ndarray) -> np.ndarray:
    """A hash of the Q code points from each place on."""
    h = codes.astype(np.uint64)
    for step, p in zip((1, 2, 4), _P):
        h = h[:-step] * np.uint64(p) + h[step:]
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


class Index:
    """Windows of benchmark items and where their q-grams stand."""

    def __init__(self, items: list[tuple[int, str]]):
        self.items = [i for i, _ in items]
        self.windows: list[np.ndarray] = []
        self.of: list[list[int]] = []  # the items of each window; equal windows are one
        budget: list[int] = []
        known: dict[tuple[bytes, int], int] = {}

        def add(k: int, codes: np.ndarray, edits: int) -> None:
            w = known.setdefault((codes.tobytes(), edits), len(self.windows))
            if w == len(self.windows):
                self.windows.append(codes)
                self.of.append([])
                budget.append(edits)
            self.of[w].append(k)

        self.short: dict[str, list[int]] = {}  # items by their normalised text
        for k, (_, text) in enumerate(items):
            codes, _ = normalised((text or "").strip())
            if len(codes) < LEAST_CHARS:
                if len(codes):
                    self.short.setdefault(_text(codes), []).append(k)
                continue
            last = max(0, len(codes) - WINDOW)
            for s in sorted({*range(0, last, WINDOW // 2), last}):
                w = codes[s : s + WINDOW]
                add(k, w, min(int(len(w) * EDITS_PER_CHAR), (len(w) - Q) // Q))
            last = len(codes) - RUN
            for s in sorted({*range(0, last, RUN // 2), last}) if last > 0 else ():
                add(k, codes[s : s + RUN], 0)
        self.tokens = sorted({len(_TOKEN.findall(x)) for x in self.short})
        self.raw = [w.tobytes() for w in self.windows]
        self.budget = np.array(budget, np.int64)
        self.size = np.array(list(map(len, self.windows)), np.int64)
        self.bound = self.size + 1 - Q - Q * self.budget
        posts = [grams(w) for w in self.windows]
        key = np.concatenate([*posts, np.empty(0, np.uint64)])
        order = np.argsort(key, kind="stable")
        self.window = np.repeat(np.arange(len(posts)), list(map(len, posts)))[order]
        self.place = np.concatenate([*(np.arange(len(p)) for p in posts), np.empty(0, np.int64)])[order]
        self.keys, self.first, self.count = np.unique(key[order], return_index=True, return_counts=True)
        self.bitmap = np.zeros(1 << _BITS, bool)
        self.bitmap[(self.keys >> np.uint64(64 - _BITS)).astype(np.int64)] = True
        self.least = int(self.bound.min()) if len(posts) else 0
        self.reach = int((self.size + 2 * self.budget).max()) if len(posts) else 0

    def verbatim(self, codes: np.ndarray) -> dict[int, tuple[int, int]]:
        """The first place, start and end, of every short item that the text holds at word borders."""
        text, out = _text(codes), {}
        spans = [m.span() for m in _TOKEN.finditer(text)]
        for n in self.tokens:
            for (start, _), (_, end) in zip(spans, spans[n - 1 :]):
                if end - start < LEAST_CHARS:
                    for k in self.short.get(text[start:end], ()):
                        out.setdefault(k, (start, end))
        return out

    def regions(self, codes: np.ndarray) -> list[tuple[int, int]]:
        """(window, smallest diagonal) of every band of the text that reaches its window's bound."""
        if len(codes) < Q or not self.windows:
            return []
        h = grams(codes)
        hit = np.flatnonzero(self.bitmap[(h >> np.uint64(64 - _BITS)).astype(np.int64)])
        # a region has ``least`` hits or more within ``reach`` places
        if len(hit) < self.least:
            return []
        near = np.searchsorted(hit, hit + self.reach, "right") - np.searchsorted(hit, hit - self.reach)
        hit = hit[near >= self.least]
        row = np.searchsorted(self.keys, h[hit])
        row[row == len(self.keys)] = 0
        real = self.keys[row] == h[hit]
        hit, row = hit[real], row[real]
        if len(hit) < self.least:
            return []
        n = self.count[row]
        wide = int(len(codes) + 2 * WINDOW) // 2 + 2  # over any band number
        held, counts = np.empty(0, np.int64), np.empty(0, np.int64)
        out: list[tuple[int, int]] = []
        cuts = np.unique(np.searchsorted(np.cumsum(n), np.arange(MOST_POSTS, n.sum() + MOST_POSTS, MOST_POSTS), "left") + 1).clip(1, len(hit))
        for lo, hi in zip([0, *cuts.tolist()], cuts.tolist()):
            if lo == hi:
                continue
            k = n[lo:hi]
            post = np.repeat(self.first[row[lo:hi]] - np.cumsum(k) + k, k) + np.arange(k.sum())
            window, diagonal = self.window[post], np.repeat(hit[lo:hi], k) - self.place[post] + WINDOW
            band = self.budget[window] + 1
            key = np.concatenate([held, *((window * 2 + x) * wide + (diagonal + x * band) // (2 * band) for x in (0, 1))])
            held, place = np.unique(key, return_inverse=True)
            counts = np.bincount(place, np.concatenate([counts, np.ones(len(key) - len(counts), np.int64)])).astype(np.int64)
            window = held // wide // 2
            band = self.budget[window] + 1
            low = held % wide * 2 * band - held // wide % 2 * band - WINDOW
            # later hits lie beyond these bands
            closed = low + 2 * band + self.size[window] <= hit[hi] if hi < len(hit) else np.ones(len(held), bool)
            full = closed & (counts >= self.bound[window])
            out += zip(window[full].tolist(), low[full].tolist())
            held, counts = held[~closed], counts[~closed]
        return sorted(out)

    def find(self, texts: list[str]) -> list[list[tuple[int, int, int, int, int]]]:
        """For every text, (item number, window, edits, start, end) of the windows that it holds within their budgets; places are the text's own."""
        out: list[dict[int, tuple]] = [{} for _ in texts]
        places: list[np.ndarray] = []
        todo: dict[tuple[int, int], list[tuple[int, int, int, np.ndarray]]] = {}

        def keep(k: int, w: int, edits: int, end: int) -> None:
            if edits <= self.budget[w]:
                place, start = places[k], max(0, end - int(self.size[w]))
                x = (edits, int(place[start]), int(place[end - 1]) + 1)
                out[k][w] = min(out[k].get(w, x), x)

        def flush(shape: tuple[int, int]) -> None:
            rows = todo.pop(shape, [])
            for (k, w, base, _), (edits, column) in zip(rows, self.aligned([r[1] for r in rows], [r[3] for r in rows])):
                keep(k, w, edits, min(ends[k], max(1, base + shape[0] + column)))

        ends: list[int] = []
        for k, text in enumerate(texts):
            codes, place = normalised(text) if len(text) >= Q or text and self.short else (np.empty(0, np.uint32), None)
            places.append(place)
            ends.append(len(codes))
            if self.short and len(codes):
                for item, (start, end) in self.verbatim(codes).items():
                    out[k][-1 - item] = (0, int(place[start]), int(place[end - 1]) + 1)
            for w, low in self.regions(codes):
                m, e = int(self.size[w]), int(self.budget[w])
                if w in out[k] and out[k][w][0] == 0:
                    continue
                base, width = low - e, m + 4 * e + 3
                part = codes[max(0, base) : max(0, base + width)]
                at = part.tobytes().find(self.raw[w])  # verbatim, the usual case
                if at >= 0 and at % 4 == 0:
                    keep(k, w, 0, max(0, base) + at // 4 + m)
                    continue
                padded = np.full(width, 0xFFFFFFFF, np.uint32)  # matches nothing
                padded[max(0, -base) : max(0, -base) + len(part)] = part
                rows = todo.setdefault((m, e), [])
                rows.append((k, w, base, padded))
                if len(rows) >= 512:
                    flush((m, e))
        for shape in list(todo):
            flush(shape)
        return [sorted((item, w, *x) for w, x in found.items() for item in (self.of[w] if w >= 0 else [-1 - w])) for found in out]

    def aligned(self, ws: list[int], parts: list[np.ndarray]) -> list[tuple[int, int]]:
        """(fewest edits, column) of windows of one length and budget against a part of their text parts, on bands of diagonals."""
        if not ws:
            return []
        p, t = np.stack([self.windows[w] for w in ws]), np.stack(parts)
        m = p.shape[1]
        width = t.shape[1] - m
        idx = np.arange(width, dtype=np.int32)
        d = np.zeros((len(ws), width), np.int32)  # row 0: free start; column c of row j is text place base + j + c
        for j in range(1, m + 1):
            new = d + (t[:, j - 1 : j - 1 + width] != p[:, j - 1 : j])  # match or replace: same diagonal
            new[:, :-1] = np.minimum(new[:, :-1], d[:, 1:] + 1)  # a window character left out
            d = np.minimum.accumulate(new - idx, axis=1) + idx  # text characters put in
        best = d.argmin(1)
        return list(zip(d[np.arange(len(ws)), best].tolist(), best.tolist()))


def indexes(benchmark: DataFrame, item_col: str = "item_id", text_col: str = "text") -> Iterator[Index]:
    """Indexes over the benchmark, each of about BLOCK_CHARS characters at most."""
    items = benchmark.select(F.col(item_col).alias("item"), whole_text(text_col).alias("text"))
    chars = items.agg(F.sum(F.length("text"))).first()[0] or 0
    blocks = -(-chars // BLOCK_CHARS)
    for b in range(blocks):
        yield Index([(r["item"], r["text"]) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(blocks)) == b).orderBy("item", "text").collect()])


def in_parts(index: Index, texts: pa.Array, size: int = 64) -> Iterator[list[tuple[int, int, int, int, int]]]:
    """What each text holds; null texts are empty."""
    for at in range(0, len(texts), size):
        yield from index.find([x or "" for x in texts.slice(at, size).to_pylist()])


def leaks(docs: DataFrame, benchmark: DataFrame, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """One row per (input row, item) found: doc_id, item_id, n_windows, edits (least), start, end (characters of the text).

    Null and empty texts hold nothing, and null and empty items are nowhere.
    Repeated rows and items each give rows; null identifiers are carried.  Texts
    of any length are searched whole; of equally good places of a window the first
    counts.  Other columns are not read.  An empty table on either side gives an
    empty result.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, item_id {benchmark.schema[item_col].dataType.simpleString()}, n_windows int, edits int, start long, end long"
    item_type = to_arrow_type(benchmark.schema[item_col].dataType)
    out = docs.sparkSession.createDataFrame([], schema)
    for index in indexes(benchmark, item_col, item_text_col):
        told = docs.sparkSession.sparkContext.broadcast(index)

        def search(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            index = told.value
            for batch in batches:
                of, found = [], []
                for k, hits in enumerate(in_parts(index, batch.column("text"))):
                    by: dict[int, list] = {}
                    for item, _, edits, start, end in hits:
                        by.setdefault(item, []).append((edits, start, end))
                    for item, hits in by.items():
                        of.append(k)
                        found.append((index.items[item], len(hits), min(x[0] for x in hits), min(x[1] for x in hits), max(x[2] for x in hits)))
                cols = list(zip(*found)) if found else [[]] * 5
                types = [item_type, pa.int32(), pa.int32(), pa.int64(), pa.int64()]
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").take(pa.array(of, pa.int64())), *(pa.array(x, t) for x, t in zip(cols, types))], ["doc_id", "item_id", "n_windows", "edits", "start", "end"])

        out = out.unionAll(rows.mapInArrow(search, schema))
    return out


def without_leaks(docs: DataFrame, benchmark: DataFrame, text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, all columns, whatever their names, whose text holds no benchmark item; null and empty texts stay, repeated rows alike."""
    for index in indexes(benchmark, item_col, item_text_col):
        told = docs.sparkSession.sparkContext.broadcast(index)
        at = docs.columns.index(text_col)

        def clean(batches: Iterator[pa.RecordBatch], told=told, at=at) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield batch.filter(pa.array([not x for x in in_parts(told.value, batch.column(at))], pa.bool_()))

        docs = docs.mapInArrow(clean, docs.schema)
    return docs
