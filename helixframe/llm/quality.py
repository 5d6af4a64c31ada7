"""Quality by a generalised additive model with pairwise interactions.

Texts become ``FEATURES`` numbers; every feature is cut into bins at quantiles
of the sample.  Boosting goes round the features in turn: a shallow tree on one
feature's bins, fitted to the gradients of the log loss, is added to that
feature's lookup table by a small step.  Then the pairs of features whose coarse
grids explain most of what is left get tables of their own in the same way.  A
score is the sigmoid of the intercept and the sum of table entries, so scoring
is bins and vectorised additions, and every feature's part can be read off.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType

from . import labelled
from .common import whole_text

FEATURES = [
    "log_words", "log_bytes", "mean_word", "longest_word", "distinct_words", "top_word", "repeated_neighbours", "longest_repeat",
    "short_words", "letters", "upper", "digits", "symbols", "bars", "stops", "exclamations", "commas", "lines_per_word", "repeated_lines", "words_with_symbols",
]
BINS, COARSE = 32, 8
ROUNDS, STEP, LEAVES, LEAST_HESSIAN = 120, 0.15, 4, 2.0
PAIRS, PAIR_ROUNDS = 8, 60
THRESHOLD = 0.3
_CLASS = np.zeros(256, np.int64)  # 0 other, then letters, upper, digits, symbols, bars, stops, exclamations, commas, line feeds, blanks
for _k, _chars in enumerate((b"abcdefghijklmnopqrstuvwxyz" + bytes(range(128, 256)), b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"0123456789", b"#$%&*+/<=>@\\^_`~{}[]", b"|", b".?", b"!", b",;:", b"\n", b" "), 1):
    _CLASS[list(_chars)] = _k
_SYMBOLS = bytes(32 if _CLASS[b] in (1, 2, 3, 9, 10) else 95 for b in range(256))


def features(text: str) -> list[float]:
    raw = text.encode("utf-8", "surrogatepass")
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    by = np.bincount(_CLASS[np.frombuffer(raw, np.uint8)], minlength=11) / size
    lengths = np.fromiter(map(len, words), np.int64, len(words)) if words else np.zeros(1, np.int64)
    counts = Counter(words)
    same = np.fromiter(map(bytes.__eq__, words[1:], words), bool, max(0, len(words) - 1))
    run = 0
    if same.any():
        edge = np.flatnonzero(np.diff(np.concatenate([[0], same.view(np.int8), [0]])))
        run = int((edge[1::2] - edge[::2]).max())
    lines = [x for x in raw.split(b"\n") if x.strip()]
    return [
        np.log1p(len(words)), np.log1p(len(raw)), lengths.mean(), np.log1p(lengths.max()), len(counts) / n, max(counts.values(), default=0) / n,
        same.sum() / n, np.log1p(run), (lengths <= 2).mean(), by[1] + by[2], by[2], by[3], by[4], by[5], by[6] * size / n, by[7], by[8] * size / n,
        len(lines) / n, 1 - len(set(lines)) / max(1, len(lines)), len(raw.translate(_SYMBOLS).split()) / n,
    ]


def tree(gradient: np.ndarray, hessian: np.ndarray, leaves: int = LEAVES) -> np.ndarray:
    """The values, by bin, of a tree of at most ``leaves`` leaves on neighbouring bins that best lowers the loss."""
    g, h = np.cumsum(gradient), np.cumsum(hessian)
    spans, out = [(0, len(g))], np.zeros(len(g))

    def part(lo: int, hi: int) -> tuple[float, float]:
        return g[hi - 1] - (g[lo - 1] if lo else 0.0), h[hi - 1] - (h[lo - 1] if lo else 0.0)

    def best(lo: int, hi: int) -> tuple[float, int]:
        a, b = part(lo, hi)
        cuts = np.arange(lo + 1, hi)
        if not len(cuts):
            return 0.0, lo
        ga, ha = g[cuts - 1] - (g[lo - 1] if lo else 0.0), h[cuts - 1] - (h[lo - 1] if lo else 0.0)
        gain = ga**2 / (ha + 1) + (a - ga) ** 2 / (b - ha + 1) - a**2 / (b + 1)
        gain[(ha < LEAST_HESSIAN) | (b - ha < LEAST_HESSIAN)] = 0.0
        k = int(gain.argmax())
        return float(gain[k]), int(cuts[k])

    while len(spans) < leaves:
        (gain, cut), at = max((best(*s), -k) for k, s in enumerate(spans))
        if gain <= 1e-9:
            break
        lo, hi = spans[-at]
        spans[-at : -at + 1] = [(lo, cut), (cut, hi)]
    for lo, hi in spans:
        a, b = part(lo, hi)
        out[lo:hi] = -a / (b + 1)
    return out


class Additive:
    """Edges of bins, lookup tables of features and of pairs."""

    def __init__(self, x: np.ndarray, y: np.ndarray):
        self.edges = [np.unique(np.quantile(x[:, f], np.linspace(0, 1, BINS + 1)[1:-1])) if len(x) else np.zeros(0) for f in range(len(FEATURES))]
        # a feature that is mostly one value keeps a bin for it, and for what lies above
        self.tables = [np.zeros(len(e) + 1) for e in self.edges]
        self.pairs: list[tuple[int, int]] = []
        self.pair_tables: list[np.ndarray] = []
        rate = (y.sum() + 0.5) / (len(y) + 1.0)
        self.intercept = float(np.log(rate / (1 - rate)))
        if len(y):
            self._fit(self.bins(x), y.astype(np.float64))

    def bins(self, x: np.ndarray) -> np.ndarray:
        return np.stack([np.searchsorted(e, x[:, f], "left") for f, e in enumerate(self.edges)], 1) if len(x) else np.zeros((0, len(self.edges)), np.int64)

    def _coarse(self, bins: np.ndarray, f: int) -> np.ndarray:
        return bins[:, f] * COARSE // len(self.tables[f])

    def _fit(self, bins: np.ndarray, y: np.ndarray) -> None:
        total = np.full(len(y), self.intercept)

        def slopes() -> tuple[np.ndarray, np.ndarray]:
            p = 1 / (1 + np.exp(-total))
            return p - y, p * (1 - p)

        for _ in range(ROUNDS):
            for f, table in enumerate(self.tables):
                if len(table) > 1:
                    g, h = slopes()
                    add = STEP * tree(np.bincount(bins[:, f], g, len(table)), np.bincount(bins[:, f], h, len(table)))
                    table += add
                    total += add[bins[:, f]]
        g, h = slopes()
        cells = {p: self._coarse(bins, p[0]) * COARSE + self._coarse(bins, p[1]) for p in combinations(range(len(self.tables)), 2)}
        gain = {p: (np.bincount(c, g, COARSE**2) ** 2 / (np.bincount(c, h, COARSE**2) + LEAST_HESSIAN)).sum() for p, c in cells.items()}
        self.pairs = sorted(gain, key=lambda p: (-gain[p], p))[:PAIRS]
        self.pair_tables = [np.zeros(COARSE**2) for _ in self.pairs]
        for _ in range(PAIR_ROUNDS):
            for p, table in zip(self.pairs, self.pair_tables):
                g, h = slopes()
                gs, hs = (np.bincount(cells[p], v, COARSE**2).reshape(COARSE, COARSE) for v in (g, h))
                rows = tree(gs.sum(1), hs.sum(1), 2)  # a cut of one feature, then one of the other on either side
                add = np.zeros((COARSE, COARSE))
                for value in np.unique(rows):
                    side = rows == value
                    add[side] = tree(gs[side].sum(0), hs[side].sum(0), 2)
                table += STEP * add.ravel()
                total += STEP * add.ravel()[cells[p]]

    def scores(self, x: np.ndarray) -> np.ndarray:
        bins = self.bins(x)
        total = np.full(len(x), self.intercept)
        for f, table in enumerate(self.tables):
            total += table[bins[:, f]]
        for (a, b), table in zip(self.pairs, self.pair_tables):
            total += table[self._coarse(bins, a) * COARSE + self._coarse(bins, b)]
        return 1 / (1 + np.exp(-np.clip(total, -40, 40)))


def with_features(rows: DataFrame, keep: list[str]) -> DataFrame:
    """The columns ``keep`` and the array ``x`` of a table with the column text."""

    def measure(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = [features(t.as_py()) for t in batch.column("text")]
            yield pa.RecordBatch.from_arrays([*(batch.column(c) for c in keep), pa.array(x, pa.list_(pa.float64()))], [*keep, "x"])

    return rows.select(*keep, "text").mapInArrow(measure, rows.select(*keep).schema.add("x", ArrayType(DoubleType())))


def fit(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most_rows: int) -> Additive:
    """Fitted on the driver from at most ``most_rows`` rows of len(FEATURES) numbers, in a fixed order."""
    rows = with_features(labelled.sample(docs, labels, label, id_col, text_col, most_rows), ["doc_id", "label"]).orderBy("doc_id", "label", "x").limit(most_rows).collect()
    return Additive(np.array([r["x"] for r in rows], np.float64).reshape(len(rows), len(FEATURES)), np.array([r["label"] for r in rows], np.float64))


def quality(docs: DataFrame, labels: DataFrame, label: str = "quality", id_col: str = "doc_id", text_col: str = "text", most_rows: int = labelled.MOST_ROWS) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted.

    Fitted on at most ``most_rows`` labelled rows whose crc32(id) mod 5 is not
    0.  A null or empty text has the features of no words and gets their
    score.  With no labels every score is 1/2.  Repeated rows and null identifiers
    each give a row; an empty table gives an empty result.  Very long texts are read
    whole; other columns are not read, whatever their names.
    """
    told = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, label, id_col, text_col, most_rows))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = np.array([features(t.as_py()) for t in batch.column("text")], np.float64).reshape(batch.num_rows, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(told.value.scores(x))], ["doc_id", "score"])

    out = rows.mapInArrow(score, f"doc_id {docs.schema[id_col].dataType.simpleString()}, score double")
    return out.select("doc_id", labelled.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
