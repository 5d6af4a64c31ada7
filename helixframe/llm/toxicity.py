"""Toxicity from the nearest labelled examples by exact TF-IDF cosine.

Terms are the words of the labelled examples, all of them.  A term's weight in
a text is (1 + ln times) * idf * relevance: idf comes from all documents,
relevance is the association of the term with a label among the examples, in
standard deviations, and at least one.

The examples stand in an inverted index of block maxima: entries lie in
blocks, every term lists its weights by block and the largest of each block.  A
query bounds every block by the sum of its weights times those maxima, scores
blocks by falling bound and stops when no block left can hold an example nearer
than the K-th, so the neighbours are exact.  An index is cut into shards of
``SHARD_POSTINGS`` postings; a text's nearest of each shard are merged by
Spark.  Votes weigh by squared similarity; isotonic regression over the
leave-one-out votes of the examples turns them into probabilities.
"""

from __future__ import annotations

from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import labelled
from .common import staged, whole_text

#: Labelled rows that stand in the index: the first in order of a hash of their identifier.
MOST_EXAMPLES = 4_000
#: Postings of a shard; more only where a single example has more terms.
SHARD_POSTINGS = 2_000_000
#: Terms of fewer examples have relevance one: their association says nothing yet.
LEAST_EXAMPLES = 5
NEAREST = 32
BLOCK = 32
#: Blocks that are scored before the first bound is drawn.
FIRST_BLOCKS = 4
#: Terms that one example in so many holds have their postings stored with gaps, in so many cells at most.
DENSE_PART, DENSE_CELLS = 16, 2_000_000
#: Texts that are searched together.
TOGETHER = 64
#: Weight of the examples' own rate in a vote.
PRIOR_WEIGHT = 0.01
#: Words counted in a task before they leave it.
HELD_WORDS = 1_000_000
_WORDS = bytes(b + 32 if 65 <= b <= 90 else b if 48 <= b < 58 or 97 <= b < 123 or b >= 128 else 32 for b in range(256))


def words_of(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_WORDS).split()


def example_terms(sample: DataFrame) -> DataFrame:
    """doc_id, label, terms, times of every row of (doc_id, text, label); staged."""
    kind = sample.schema["doc_id"].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [Counter(words_of(x.as_py())) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays(
                [batch.column("doc_id"), batch.column("label"), pa.array([list(c) for c in found], pa.list_(pa.binary())), pa.array([list(c.values()) for c in found], pa.list_(pa.int64()))],
                ["doc_id", "label", "terms", "times"],
            )

    return staged(sample.select("doc_id", "label", "text").mapInArrow(count, f"doc_id {kind}, label int, terms array<binary>, times array<long>"), "examples")


def document_frequencies(docs: DataFrame, text_col: str) -> DataFrame:
    """(term, df): documents that hold each word, over all documents; summed in the tasks before the shuffle."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def told(n: Counter) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(n), pa.binary()), pa.array(list(n.values()), pa.int64())], ["term", "df"])

        n: Counter = Counter()
        for batch in batches:
            for text in batch.column("text"):
                n.update(set(words_of(text.as_py())))
                if len(n) > HELD_WORDS:
                    yield told(n)
                    n = Counter()
        yield told(n)

    return docs.select(whole_text(text_col).alias("text")).mapInArrow(count, "term binary, df long").groupBy("term").agg(F.sum("df").alias("df"))


class BlockMaxIndex:
    """Unit vectors of examples as postings by term, in blocks of entries, with the largest weight of each (term, block).

    ``example``, ``term`` and ``weight`` list the postings; ``terms`` and
    ``factor`` the terms and what their times are multiplied by; ``own`` marks the
    terms that count towards a query's norm in this shard.  The postings of terms
    that many examples hold are stored block by block with their gaps, so that
    a block is one small product for all queries that need it.
    """

    def __init__(self, terms: list[bytes], factor: np.ndarray, own: np.ndarray, example: np.ndarray, term: np.ndarray, weight: np.ndarray):
        self.number = {t: k for k, t in enumerate(terms)}
        self.factor, self.own = factor, own
        self.examples, entry = np.unique(example, return_inverse=True)
        size = len(self.examples)
        weight = weight / np.sqrt(np.bincount(entry, weight * weight, size))[entry]
        # examples with the same heaviest term stand together, so that blocks differ in their maxima
        heavy = np.zeros(size, np.int64)
        order = np.lexsort((term, weight, entry))
        heavy[entry[order]] = term[order]
        order = np.lexsort((np.arange(size), heavy))
        self.examples, self.blocks = self.examples[order], -(-size // BLOCK)
        self.place = {int(e): k for k, e in enumerate(self.examples)}
        entry = np.argsort(order)[entry]
        many = np.bincount(term, minlength=len(terms))
        common = np.argsort(-many, kind="stable")[: DENSE_CELLS // max(1, size)]
        common = common[many[common] * DENSE_PART >= size]
        self.row = np.full(len(terms), -1)
        self.row[common] = np.arange(len(common))
        dense = self.row[term] >= 0
        self.common = np.zeros((len(common), self.blocks * BLOCK))
        self.common[self.row[term[dense]], entry[dense]] = weight[dense]
        self.most = self.common.reshape(len(common), self.blocks, BLOCK).max(2) if size else np.zeros((0, 0))
        order = np.lexsort((entry[~dense], term[~dense]))
        self.entry, self.weight = entry[~dense][order], weight[~dense][order]
        self.first = np.searchsorted(term[~dense][order], np.arange(len(terms) + 1))

    def query(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Numbers and weights of the text's terms."""
        number = self.number
        found = sorted((number[w], n) for w, n in Counter(words_of(text)).items() if w in number)
        terms = np.array([t for t, _ in found], np.int64)
        return terms, (1 + np.log(np.array([n for _, n in found], np.float64))) * self.factor[terms]

    def nearest(self, queries: list[tuple[np.ndarray, np.ndarray]], without: list[int], most: int = NEAREST) -> list[tuple[np.ndarray, np.ndarray]]:
        """Products and examples of each query's ``most`` nearest, by falling product (to nine places); of equal ones the smaller example."""
        n, width = len(queries), self.blocks * BLOCK
        terms, weights = np.concatenate([t for t, _ in queries]), np.concatenate([w for _, w in queries])
        of = np.repeat(np.arange(n), [len(t) for t, _ in queries])
        row = self.row[terms]
        common = np.zeros((n, len(self.common)))
        common[of[row >= 0], row[row >= 0]] = weights[row >= 0]
        terms, weights, of = terms[row < 0], weights[row < 0], of[row < 0]
        size = self.first[terms + 1] - self.first[terms]
        post = np.repeat(self.first[terms] - np.cumsum(size) + size, size) + np.arange(size.sum())
        rare = np.bincount(np.repeat(of * width, size) + self.entry[post], self.weight[post] * np.repeat(weights, size), n * width).reshape(n, width)
        bound = common @ self.most + rare.reshape(n, self.blocks, BLOCK).max(2)
        out = np.array([k for k, e in enumerate(without) if e in self.place], np.int64), np.array([self.place[e] for e in without if e in self.place], np.int64)
        total, least, seen = np.zeros((n, width)), np.zeros(n), np.zeros((n, self.blocks), bool)
        for first in (True, False):
            # the blocks of the highest bounds, then all that may still hold a nearer example than the last
            wanted = (bound > 0) & (bound >= least[:, None] * (1 - 1e-9)) & ~seen
            if first and self.blocks > FIRST_BLOCKS:
                wanted &= bound >= -np.partition(-bound, FIRST_BLOCKS - 1, 1)[:, FIRST_BLOCKS - 1 : FIRST_BLOCKS]
            seen |= wanted
            for b in np.flatnonzero(wanted.any(0)):
                those, at = np.flatnonzero(wanted[:, b]), slice(b * BLOCK, (b + 1) * BLOCK)
                total[those, at] = rare[those, at] + common[those] @ self.common[:, at]
            total[out] = 0
            if width > most:
                least = np.partition(total, width - most, 1)[:, width - most]
        found = []
        for k in range(n):
            hit = np.flatnonzero((total[k] > 0) & (total[k] >= least[k] - 1e-8))
            sums, best = np.round(total[k, hit], 9), self.examples[hit]
            top = np.lexsort((best, -sums))[:most]
            found.append((sums[top], best[top]))
        return found


@dataclass
class Model:
    """The broadcast shards, the examples' identifiers and labels in order of their numbers, their rate and the steps of the calibration."""

    shards: list[Broadcast]
    names: list[str]
    labels: np.ndarray
    rate: float
    votes: np.ndarray = field(default_factory=lambda: np.zeros(1))
    chances: np.ndarray = field(default_factory=lambda: np.zeros(1))

    def vote(self, square: float, sums: np.ndarray, best: np.ndarray) -> float:
        w = sums * sums / max(square, 1e-300)
        return float((w @ self.labels[best] + PRIOR_WEIGHT * self.rate) / (w.sum() + PRIOR_WEIGHT))

    def score(self, vote: float) -> float:
        at = max(0, int(np.searchsorted(self.votes, vote, "right")) - 1)
        return float(min(1.0, max(0.0, self.chances[at])))

    def calibrate(self, points: list[tuple[float, int]]) -> None:
        """Isotonic regression of the labels on (vote, label) of the examples."""
        pools: list[list[float]] = []  # vote, ones, examples
        for v, label in sorted(points):
            pools.append([v, label, 1])
            while len(pools) > 1 and pools[-2][1] * pools[-1][2] >= pools[-1][1] * pools[-2][2]:
                _, a, b = pools.pop()
                pools[-1][1] += a
                pools[-1][2] += b
        if pools:
            self.votes, self.chances = np.array([p[0] for p in pools]), np.array([(p[1] + self.rate) / (p[2] + 1.0) for p in pools])
        else:
            self.chances = np.array([self.rate])


_NEAR = pa.list_(pa.struct([("product", pa.float64()), ("example", pa.int32())]))
_EVIDENCE = pa.list_(pa.struct([("doc_id", pa.string()), ("similarity", pa.float64()), ("label", pa.int32())]))


def voted(rows: DataFrame, model: Model) -> DataFrame:
    """doc_id, skip, vote (null without a term), score and evidence of ``rows`` (doc_id, text, skip); the example ``skip`` (-1: none) does not vote."""
    kind = rows.schema["doc_id"].dataType.simpleString()
    judge = rows.sparkSession.sparkContext.broadcast(model.__class__([], model.names, model.labels, model.rate, model.votes, model.chances))
    out = f"doc_id {kind}, skip int, vote double, score double, evidence array<struct<doc_id:string,similarity:double,label:int>>"

    def judged(batch: pa.RecordBatch, found: list[tuple[float, np.ndarray, np.ndarray]]) -> pa.RecordBatch:
        m, votes, scores, near = judge.value, [], [], []
        for square, sums, best in found:
            votes.append(m.vote(square, sums, best) if len(best) else None)
            scores.append(m.score(votes[-1]) if len(best) else m.rate)
            near.append([{"doc_id": m.names[e], "similarity": float(s / np.sqrt(square)), "label": int(m.labels[e])} for s, e in zip(sums[:3], best[:3])])
        return pa.RecordBatch.from_arrays([batch.column("doc_id"), batch.column("skip"), pa.array(votes, pa.float64()), pa.array(scores, pa.float64()), pa.array(near, _EVIDENCE)], ["doc_id", "skip", "vote", "score", "evidence"])

    def searched(index: BlockMaxIndex, batch: pa.RecordBatch) -> list[tuple[float, np.ndarray, np.ndarray]]:
        found = []
        for at in range(0, batch.num_rows, TOGETHER):
            part = batch.slice(at, TOGETHER)
            queries = [index.query(x.as_py()) for x in part.column("text")]
            squares = [float((w[index.own[t]] ** 2).sum()) for t, w in queries]
            found += [(x, *y) for x, y in zip(squares, index.nearest(queries, part.column("skip").to_pylist()))]
        return found

    if not model.shards:
        return rows.select("doc_id", "skip", F.lit(None).cast("double").alias("vote"), F.lit(model.rate).alias("score"), F.array().cast("array<struct<doc_id:string,similarity:double,label:int>>").alias("evidence"))
    if len(model.shards) == 1:
        told = model.shards[0]

        def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                yield judged(batch, searched(told.value, batch))

        return rows.select("doc_id", "text", "skip").mapInArrow(search, out)

    rows = staged(rows.select("doc_id", "text", "skip").withColumn("row", F.monotonically_increasing_id()), "texts")
    parts = None
    for told in model.shards:

        def part(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                found = searched(told.value, batch)
                near = [[{"product": s, "example": e} for s, e in zip(sums, best)] for _, sums, best in found]
                yield pa.RecordBatch.from_arrays([batch.column("row"), pa.array([x for x, _, _ in found], pa.float64()), pa.array(near, _NEAR)], ["row", "square", "near"])

        of = rows.mapInArrow(part, "row long, square double, near array<struct<product:double,example:int>>")
        parts = of if parts is None else parts.unionAll(of)
    # as many rows of a text as there are shards
    merged = parts.groupBy("row").agg(F.sum("square").alias("square"), F.flatten(F.collect_list("near")).alias("near"))

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = []
            for square, near in zip(batch.column("square").to_pylist(), batch.column("near").to_pylist()):
                top = sorted((-x["product"], x["example"]) for x in near)[:NEAREST]
                found.append((square, np.array([-s for s, _ in top]), np.array([e for _, e in top], np.int64)))
            yield judged(batch, found)

    return rows.drop("text").join(merged, "row").select("doc_id", "skip", "square", "near").mapInArrow(merge, out)


def _shards(sizes: list[int], most: int) -> list[tuple[int, int]]:
    """Ranges of example numbers with at most ``most`` postings together, or one example each."""
    out, lo, held = [], 0, 0
    for k, n in enumerate(sizes):
        if held and held + n > most:
            out.append((lo, k))
            lo, held = k, 0
        held += n
    return [*out, (lo, len(sizes))] if held else out


def fit(docs: DataFrame, labels: DataFrame, label: str, id_col: str, text_col: str, most_rows: int = MOST_EXAMPLES, shard_postings: int = SHARD_POSTINGS) -> Model:
    """The index of at most ``most_rows`` labelled examples and its calibration; one shard at a time reaches the driver."""
    spark = docs.sparkSession
    sample = staged(labelled.sample(docs, labels, label, id_col, text_col, most_rows), "sample")
    examples = example_terms(sample)
    heads = examples.select("doc_id", "label", F.size("terms").alias("n")).orderBy("doc_id").collect()  # most_rows at most
    marks = np.array([r["label"] for r in heads], np.float64)
    rate = (marks.sum() + 0.5) / (len(heads) + 1.0)
    model = Model([], [str(r["doc_id"]) for r in heads], marks, rate)
    if not heads:
        model.calibrate([])
        return model
    kind = docs.schema[id_col].dataType.simpleString()
    numbers = F.broadcast(spark.createDataFrame([(r["doc_id"], k) for k, r in enumerate(heads)], f"doc_id {kind}, ex int"))
    posts = staged(examples.join(numbers, "doc_id").select("ex", "label", F.explode(F.arrays_zip("terms", "times")).alias("p")).select("ex", "label", F.col("p.terms").alias("term"), F.col("p.times").alias("times")), "postings")
    held = posts.groupBy("term").agg(F.count(F.lit(1)).alias("n"), F.sum("label").alias("ones"), F.min("ex").alias("first"))
    z = F.abs(F.col("ones") - F.col("n") * rate) / F.sqrt(F.col("n") * (rate * (1 - rate)))
    relevance = F.when(F.col("n") >= LEAST_EXAMPLES, F.greatest(F.lit(1.0), z)).otherwise(1.0)
    idf = F.log((1.0 + docs.count()) / (1.0 + F.col("df"))) + 1.0
    terms = staged(document_frequencies(docs, text_col).join(held, "term").select("term", "first", (idf * relevance).alias("factor")), "terms")
    for lo, hi in _shards([r["n"] for r in heads], shard_postings):
        of = posts.where(F.col("ex").between(lo, hi - 1)).join(terms, "term").select("ex", "term", "first", "factor", ((1 + F.log("times")) * F.col("factor")).alias("weight")).toArrow()
        words = of["term"].combine_chunks().dictionary_encode()
        number = words.indices.to_numpy().astype(np.int64)
        names, at = words.dictionary.to_pylist(), np.empty(len(words.dictionary), np.int64)
        at[number] = np.arange(len(number))
        rank = np.argsort(np.array(names, object), kind="stable")
        back = np.empty(len(rank), np.int64)
        back[rank] = np.arange(len(rank))
        first, factor = of["first"].to_numpy()[at[rank]], of["factor"].to_numpy()[at[rank]]
        index = BlockMaxIndex([names[k] for k in rank], factor, (first >= lo) & (first < hi), of["ex"].to_numpy().astype(np.int64), back[number], of["weight"].to_numpy())
        model.shards.append(spark.sparkContext.broadcast(index))
    own = voted(sample.join(numbers, "doc_id").select("doc_id", "text", F.col("ex").alias("skip")), model).where("vote is not null").select("vote", "skip").collect()
    model.calibrate([(r["vote"], int(marks[r["skip"]])) for r in own])
    return model


def toxicity(docs: DataFrame, labels: DataFrame, label: str = "toxic", id_col: str = "doc_id", text_col: str = "text", most_rows: int = MOST_EXAMPLES) -> DataFrame:
    """One row per input row: doc_id, held_out, score, predicted, evidence.

    Fitted on at most ``most_rows`` labelled rows whose crc32(id) mod 5 is not
    0.  ``evidence`` names the three nearest examples (identifier, similarity,
    label); of equally near ones the smaller identifier comes first.  A text
    without a word of the examples, a null or empty one among them, gets the
    examples' rate, and so does every text where there are no labels (1/2).
    Repeated rows and null identifiers each give a row; texts are read whole
    at any length; other columns are not read.  An empty table gives an empty result.
    """
    model = fit(docs, labels, label, id_col, text_col, most_rows)
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"), F.lit(-1).alias("skip"))
    return voted(rows, model).select("doc_id", labelled.held_out("doc_id").alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"), "evidence")
