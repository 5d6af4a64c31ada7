"""Language identification by prediction by partial matching over bytes.

Every language has a tree of byte contexts of order 0 to ``ORDER``.  Counts come
from the whole texts of all training rows, are summed by Spark and all of them
are kept.  With the counts frozen, a byte's probability in a context is

    seen in the context n / (T + D)            T: bytes counted, D: distinct ones
    escape              D / (T + D) * p(byte in the next shorter context),
                        divided by what is not excluded there (all seen here)

and a text's code length in a language is the exact sum of its bytes' bits.
The language with the shortest code wins.

A context that a language has not seen costs nothing, so languages do not touch
each other, and all contexts of a byte but the empty one end in the byte before
it.  The counts are therefore cut into shards of whole languages, or of a range
of preceding bytes of one language, of about ``SHARD_GRAMS`` rows; each shard is
exact for its part, and the parts of a text's code length are summed by Spark.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import regex
from pyspark.core.broadcast import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import fold_of, staged, whole_text, with_row_ids

ORDER = 3
#: (language, gram) rows of a shard.  More only where one language has more after one byte, at most 2 ** 24.
SHARD_GRAMS = 1_000_000
LETTER = regex.compile(r"\p{L}")
UNKNOWN = "und"
#: Bytes that are scored at a time.
BLOCK = 1_000_000


def _grams(texts: list[bytes]) -> np.ndarray:
    """Every byte with the ORDER bytes before it, as one number of 32 bits; zero bytes stand before a text."""
    flat = np.frombuffer(b"".join(b"\0" * ORDER + x for x in texts), np.uint8).astype(np.uint32)
    keys = (flat[:-3] << 24) | (flat[1:-2] << 16) | (flat[2:-1] << 8) | flat[3:]
    ends = np.cumsum([ORDER + len(x) for x in texts])[:-1]
    keep = np.ones(len(keys), bool)
    for k in range(ORDER):  # windows that end in the zero bytes before the next text
        keep[ends + k - ORDER] = False
    return keys[keep]


def gram_counts(rows: DataFrame) -> DataFrame:
    """(lang, gram, n) over the whole texts of all ``rows`` (lang, text)."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: dict[str, tuple[np.ndarray, np.ndarray]] = {}

        def add(lang: str, texts: list[bytes]) -> None:
            keys, n = np.unique(_grams(texts), return_counts=True)
            if lang in total:
                keys, n = np.concatenate([total[lang][0], keys]), np.concatenate([total[lang][1], n])
                keys, place = np.unique(keys, return_inverse=True)
                n = np.bincount(place, n, len(keys)).astype(np.int64)
            total[lang] = keys, n

        for batch in batches:
            by: dict[str, list[bytes]] = {}
            held: dict[str, int] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text")):
                by.setdefault(lang, []).append(text.as_py().encode("utf-8", "surrogatepass"))
                held[lang] = held.get(lang, 0) + len(by[lang][-1])
                if held[lang] > 4 * BLOCK:
                    add(lang, by.pop(lang))
                    held[lang] = 0
            for lang, texts in by.items():
                add(lang, texts)
        for lang, (keys, n) in total.items():
            yield pa.RecordBatch.from_arrays([pa.array([lang] * len(keys)), pa.array(keys, pa.int64()), pa.array(n, pa.int64())], ["lang", "gram", "n"])

    return rows.mapInArrow(count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))


class Table:
    """Code lengths of one language: sorted grams of each order with their bits, sorted contexts with the bits of an escape."""

    def __init__(self, gram: np.ndarray, n: np.ndarray, zero: np.ndarray):
        """``zero`` holds the language's counts of all 256 bytes; ``gram`` all grams, or all after some bytes."""
        total, kinds = zero.sum(), (zero > 0).sum()
        low = np.where(zero > 0, zero, kinds / 256 / max(1e-12, 1 - kinds / 256)) / (total + kinds) if total else np.full(256, 1 / 256)
        self.zero = -np.log2(low)
        self.orders: list[tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]] = []
        below = np.arange(256, dtype=np.uint32)
        for k in range(1, ORDER + 1):
            real = (gram >> (8 * k)) & 255 != 0  # a text's start has no longer context
            gram, n = gram[real], n[real]
            keys, place = np.unique((gram & ((1 << 8 * (k + 1)) - 1)).astype(np.uint32), return_inverse=True)
            count = np.bincount(place, n, len(keys))
            contexts, first, distinct = np.unique(keys >> 8, return_index=True, return_counts=True)
            if not len(keys):
                break
            shorter = low[np.searchsorted(below, keys & np.uint32((1 << 8 * k) - 1))]  # what is seen here is seen there
            whole = np.add.reduceat(count, first) + distinct
            free = np.maximum(1e-12, 1 - np.add.reduceat(shorter, first))
            low, below = count / np.repeat(whole, distinct), keys
            self.orders.append((keys, -np.log2(low), contexts, -np.log2(distinct / whole / free)))

    def bits(self, grams: np.ndarray) -> np.ndarray:
        """The bits of each gram's last byte after the others."""
        out, left = np.zeros(len(grams)), np.arange(len(grams))
        for k in range(len(self.orders), 0, -1):
            keys, bits, contexts, escape = self.orders[k - 1]
            key = grams[left] & np.uint32((1 << 8 * (k + 1)) - 1)
            at = np.minimum(np.searchsorted(keys, key), len(keys) - 1)
            hit = keys[at] == key
            out[left[hit]] += bits[at[hit]]
            left, key = left[~hit], key[~hit] >> 8
            at = np.minimum(np.searchsorted(contexts, key), len(contexts) - 1)
            known = contexts[at] == key
            out[left[known]] += escape[at[known]]
        out[left] += self.zero[grams[left] & 255]
        return out


class Model:
    """The tables of some languages, for bytes after any byte or after those from ``first`` to ``last``."""

    def __init__(self, langs: list[str], lang: np.ndarray, gram: np.ndarray, n: np.ndarray, zero: np.ndarray | None = None, first: int = 0, last: int = 255):
        self.langs, self.first, self.last = langs, first, last
        if zero is None:
            zero = np.zeros((len(langs), 256))
            np.add.at(zero, (lang, gram & 255), n)
        order = np.argsort(lang, kind="stable")
        cut = np.searchsorted(lang[order], np.arange(len(langs) + 1))
        parts = [order[a:b] for a, b in zip(cut, cut[1:])]
        self.tables = [Table(gram[x], n[x], z) for x, z in zip(parts, zero)]

    def code_lengths(self, texts: list[bytes]) -> np.ndarray:
        """[texts, languages] bits; no text may be empty."""
        grams, place = np.unique(_grams(texts), return_inverse=True)
        size = np.array([len(x) for x in texts])
        before = (grams >> 8) & 255
        own = (before >= self.first) & (before <= self.last)
        out = np.empty((len(texts), len(self.langs)))
        for k, table in enumerate(self.tables):
            bits = np.zeros(len(grams))
            bits[own] = table.bits(grams[own])
            out[:, k] = np.add.reduceat(bits[place], np.cumsum(size) - size)
        return out


@dataclass
class Models:
    """All languages, in alphabetical order, and the broadcast shards (``Model``) of their tables."""

    langs: list[str]
    shards: list[Broadcast]


def _shards(sizes: dict[str, int], after: dict[str, dict[int, int]], most: int) -> list[tuple[str, str, int, int]]:
    """(first language, last language, first byte before, last byte before) of each shard."""
    out, held = [], most + 1
    for lang in sorted(sizes):
        if lang in after:
            lo, part = 0, 0
            for b in range(256):
                n = after[lang].get(b, 0)
                if part and part + n > most:
                    out.append((lang, lang, lo, b - 1))
                    lo, part = b, 0
                part += n
            out.append((lang, lang, lo, 255))
            held = most + 1
        elif held + sizes[lang] <= most:
            out[-1] = (out[-1][0], lang, 0, 255)
            held += sizes[lang]
        else:
            out.append((lang, lang, 0, 255))
            held = sizes[lang]
    return out


def fit(rows: DataFrame, shard_grams: int = SHARD_GRAMS) -> Models:
    """Models of ``rows`` (lang, text), which may be of any number; one shard of their counts at a time reaches the driver.

    A language is learned if it has a byte of text.
    """
    counts = staged(gram_counts(rows), "grams")
    sizes = {r["lang"]: r["n"] for r in counts.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    large = [x for x, n in sizes.items() if n > shard_grams]
    before, byte = F.shiftright("gram", 8).bitwiseAND(255), F.col("gram").bitwiseAND(255)
    after: dict[str, dict[int, int]] = {}
    if large:
        for r in counts.where(F.col("lang").isin(large)).groupBy("lang", before.alias("b")).agg(F.count(F.lit(1)).alias("n")).collect():
            after.setdefault(r["lang"], {})[r["b"]] = r["n"]
    shards = []
    for a, z, lo, hi in _shards(sizes, after, shard_grams):
        of = counts.where(F.col("lang").between(a, z))
        langs = sorted(x for x in sizes if a <= x <= z)
        number = {x: k for k, x in enumerate(langs)}
        zero = np.zeros((len(langs), 256))
        for r in of.groupBy("lang", byte.alias("b")).agg(F.sum("n").alias("n")).collect():
            zero[number[r["lang"]], r["b"]] = r["n"]
        found = of.where(before.between(lo, hi)).toArrow()
        lang = found["lang"].combine_chunks().dictionary_encode()
        names = np.array([number[x] for x in lang.dictionary.to_pylist()], np.int64)
        model = Model(langs, names[lang.indices.to_numpy()], found["gram"].to_numpy(), found["n"].to_numpy(), zero, lo, hi)
        shards.append(rows.sparkSession.sparkContext.broadcast(model))
    return Models(sorted(sizes), shards)


def _lettered(texts: pa.Array) -> Iterator[tuple[list[int], list[bytes]]]:
    """Places and bytes of the texts that hold a letter, in blocks of BLOCK bytes."""
    of, held, size = [], [], 0
    for k, text in enumerate(texts):
        text = text.as_py() or ""
        if LETTER.search(text):
            of.append(k)
            held.append(text.encode("utf-8", "surrogatepass"))
            size += len(held[-1])
            if size > BLOCK:
                yield of, held
                of, held, size = [], [], 0
    if of:
        yield of, held


def _scores(model: Model, texts: pa.Array) -> tuple[list[str], np.ndarray, np.ndarray]:
    """Language, posterior and bits a byte of every text."""
    names, value, rate = [UNKNOWN] * len(texts), np.zeros(len(texts)), np.zeros(len(texts))
    for of, held in _lettered(texts):
        bits = model.code_lengths(held)
        best = bits.argmin(1)
        chance = 1 / np.exp2(np.maximum(-1000, bits.min(1)[:, None] - bits)).sum(1)
        for k, x, b, c, row in zip(of, held, best, chance, bits):
            names[k], value[k], rate[k] = model.langs[b], c, row[b] / len(x)
    return names, value, rate


def _joined_bits(rows: DataFrame, models: Models) -> DataFrame:
    """row, lang_pred, score and bits_per_byte of the ``rows`` (row, text) that hold a letter, with the models in several shards."""
    parts = None
    for told in models.shards:

        def part(batches: Iterator[pa.RecordBatch], told=told) -> Iterator[pa.RecordBatch]:
            model = told.value
            whole = (model.first, model.last) == (0, 255)
            for batch in batches:
                for of, held in _lettered(batch.column("text")):
                    bits = model.code_lengths(held)
                    best = bits.argmin(1)  # all the shard says of a text: its best language, and the chance of all beside that one's
                    mass = np.exp2(np.maximum(-1000, bits.min(1)[:, None] - bits)).sum(1) if whole else np.ones(len(of))
                    yield pa.RecordBatch.from_arrays(
                        [batch.column("row").take(pa.array(of, pa.int64())), pa.array([model.langs[b] for b in best]), pa.array(bits.min(1)), pa.array(mass), pa.array([len(x) for x in held], pa.int64())],
                        ["row", "lang", "bits", "mass", "size"],
                    )

        of = rows.select("row", "text").mapInArrow(part, "row long, lang string, bits double, mass double, size long")
        parts = of if parts is None else parts.unionAll(of)
    by_lang = parts.groupBy("row", "lang").agg(F.sum("bits").alias("bits"), F.max("mass").alias("mass"), F.max("size").alias("size"))
    found = by_lang.groupBy("row").agg(F.min(F.struct("bits", "lang", "size")).alias("best"), F.collect_list(F.struct("bits", "mass")).alias("all"))
    share = F.aggregate("all", F.lit(0.0), lambda x, y: x + y["mass"] * F.pow(F.lit(2.0), F.greatest(F.lit(-1000.0), F.col("best.bits") - y["bits"])))
    return found.select("row", F.col("best.lang").alias("lang_pred"), (1 / share).alias("score"), (F.col("best.bits") / F.col("best.size")).alias("bits_per_byte"))


def _joined_scores(rows: DataFrame, models: Models) -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte of ``rows`` (doc_id, text), with the models in several shards."""
    rows = staged(rows.withColumn("row", F.monotonically_increasing_id()), "texts")
    found = _joined_bits(rows.select("row", "text"), models)
    return rows.select("doc_id", "row").join(found, "row", "left").select("doc_id", F.coalesce("lang_pred", F.lit(UNKNOWN)).alias("lang_pred"), F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("bits_per_byte", F.lit(0.0)).alias("bits_per_byte"))


def predicted(docs: DataFrame, models: Models, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, lang_pred, score and bits_per_byte of every row.

    ``und`` with score 0 for a null text, one without a letter, or where no
    language was learned; ties go to the first language in alphabetical order.
    score is the posterior probability of lang_pred with languages equally likely before.
    """
    rows = docs.select(F.col(id_col).alias("doc_id"), F.col(text_col).cast("string").alias("text"))
    if not models.shards:
        return rows.select("doc_id", F.lit(UNKNOWN).alias("lang_pred"), F.lit(0.0).alias("score"), F.lit(0.0).alias("bits_per_byte"))
    if len(models.shards) > 1:
        return _joined_scores(rows, models)
    told = models.shards[0]

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, value, rate = _scores(told.value, batch.column("text"))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(names, pa.string()), pa.array(value), pa.array(rate)], ["doc_id", "lang_pred", "score", "bits_per_byte"])

    return rows.mapInArrow(score, f"doc_id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, bits_per_byte double")


def with_language(docs: DataFrame, models: Models, text_col: str = "text") -> DataFrame:
    """The rows, with all their columns, whose language is not ``und``; where no language was learned, all that hold a letter.

    The language is that of the models, in one shard or more.
    """
    if len(models.shards) > 1:
        rows, row = with_row_ids(docs, "row")
        named = _joined_bits(rows.select(F.col(row).alias("row"), F.col(text_col).cast("string").alias("text")), models).where(F.col("lang_pred") != UNKNOWN)
        return rows.join(named.select(F.col("row").alias(row)), row, "left_semi").drop(row)
    told, at = models.shards[0] if models.shards else None, docs.columns.index(text_col)

    def known(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts = batch.column(at)
            keep = [x != UNKNOWN for x in _scores(told.value, texts)[0]] if told else [bool(LETTER.search(x.as_py() or "")) for x in texts]
            yield batch.filter(pa.array(keep, pa.bool_()))

    return docs.mapInArrow(known, docs.schema)


def training_rows(docs: DataFrame, id_col: str, text_col: str, lang_col: str, folds: int = 4, held_out: int = 2) -> DataFrame:
    return docs.where((fold_of(F.col(id_col), folds) != held_out) & F.col(lang_col).isNotNull() & F.col(text_col).isNotNull()).select(F.col(lang_col).cast("string").alias("lang"), whole_text(text_col).alias("text"))


def language_id(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """One row per input row: doc_id, held_out, lang_pred, score, bits_per_byte.

    Learns from the text and language of rows whose crc32(id) mod 4 is not 2 (a
    null id counts as the empty text), scores all rows.  Rows without a language
    or text teach nothing.  Repeated rows each count and each give a row.  Very long
    texts are counted and scored whole, in blocks; other columns are not read, whatever
    their names; an empty table gives an empty result.
    """
    model = fit(training_rows(docs, id_col, text_col, lang_col))
    found = predicted(docs, model, id_col, text_col)
    return found.withColumn("held_out", fold_of(F.col("doc_id"), 4) == 2)
