"""Spelling variants: words of a corpus that differ by one letter, and the form each of them is a variant of.

Two words are near if one inserted, deleted or replaced code point makes one of
the other.  They are found by a rare-first q-gram prefix filter: bigrams are
ordered by their number in all words, and only the three rarest of a word are
looked up.  One edit destroys two bigrams at most, so one of the three rarest
of either word is in the other too, among its three rarest, at the same place
or one further.

The edit is then on one side of that bigram, and in one half of that side, so
all else is equal: the rest of the word on the bigram's other side, and the
other half.  Those equal parts, with the length of the shorter word, are the key
on which words are joined; the pairs that meet are verified.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import staged

#: Letters of a word: fixed values of the contract.
RUNS = "[A-Za-zÀ-ÿ]+"
#: Words counted in a task before they are given to the shuffle.
HELD_WORDS = 300_000
#: Bigrams of a word that are looked up: two destroyed by an edit, and one.
RAREST = 3
_SMALL = bytes.maketrans(b"ABCDEFGHIJKLMNOPQRSTUVWXYZ", b"abcdefghijklmnopqrstuvwxyz")


def word_counts(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int = 0, pattern: str = RUNS) -> DataFrame:
    """(word, n) of all letter runs of all whole texts, with A to Z in lower case.

    With ``typo_every`` a run loses a code point in documents where that number
    divides crc32 of ``<doc_id>:<run>``.  A null text has no words, a null
    identifier counts as the empty text, repeated rows count each.  Other columns
    are not read.  Counts are summed in the task before they are shuffled.
    """
    rows = docs.select(F.coalesce(F.col(id_col).cast("string"), F.lit("")).alias("i"), F.col(text_col).cast("string").alias("t")).where("t is not null")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        find, held = re.compile(pattern).findall, Counter()
        out = lambda: pa.RecordBatch.from_arrays([pa.array(list(held), pa.string()), pa.array(list(held.values()), pa.int64())], ["word", "n"])
        for batch in batches:
            for i, text in zip(batch.column("i").to_pylist(), batch.column("t").to_pylist()):
                runs = Counter(find(text.encode().translate(_SMALL).decode()))
                if typo_every:
                    before = zlib.crc32(f"{i}:".encode())
                    for run in [r for r in runs if zlib.crc32(r.encode(), before) % typo_every == 0]:
                        at = zlib.crc32(run.encode(), before) % len(run)
                        held[run[:at] + run[at + 1 :]] += runs.pop(run)
                held.update(runs)
                if len(held) > HELD_WORDS:
                    yield out()
                    held.clear()
        if held:
            yield out()

    return rows.mapInArrow(count, "word string, n long").where("word != ''").groupBy("word").agg(F.sum("n").alias("n"))


def bigram_ranks(words: DataFrame) -> dict[str, int]:
    """The place of every bigram by rising number of places in the words, ties by code points.

    The table is bounded by the square of the alphabet, not by the corpus.
    """
    places = F.sequence(F.lit(1), F.char_length("word") - 1)
    grams = words.where("char_length(word) >= 2").select(F.explode(F.transform(places, lambda k: F.substr("word", k, F.lit(2)))).alias("g"))
    found = grams.groupBy("g").agg(F.count(F.lit(1)).alias("n")).collect()
    return {r.g: k for k, r in enumerate(sorted(found, key=lambda r: (r.n, r.g)))}


def keys_of(word: str, ranks: dict[str, int]) -> tuple[set[str], set[str]]:
    """The keys of a word as the shorter (or equally long) one of a pair, and as the longer one.

    A key is the length of the shorter word and what two words share in front and
    at the end, for an edit in one half of one side of one of the rarest bigrams.
    """
    size = len(word)
    places = sorted(range(size - 1), key=lambda p: (ranks[word[p : p + 2]], p))[:RAREST]
    both = []
    for longer in (0, 1):
        base, keys = size - longer, set()
        for p in places:
            if p + 2 <= base:  # the edit is to the right of the bigram
                half = (p + 2 + base) // 2
                keys |= {(half, 0), (p + 2, base - half)}
            if p >= longer:  # the edit is to the left of it; in the shorter word it stands at ``s``
                s = p - longer
                keys |= {(0, base - s // 2), (s // 2, base - s)}
        both.append({f"{base}\t{word[:front]}\t{word[size - end :] if end else ''}" for front, end in keys})
    return both[0], both[1]


def near_words(words: DataFrame) -> DataFrame:
    """(word, n, other, other_n) for words of (word, n) that differ by exactly one edit, both ways; ``words`` are distinct.

    Words of fewer than four code points have too few bigrams for the filter and
    raise; a null word or number is no word.  No table of pairs is made but of those
    that agree in a key, and only verified ones leave the join.
    """
    words = staged(words.select("word", "n").where("word is not null and n is not null"), "words")
    if not words.where("char_length(word) < 4").isEmpty():
        raise ValueError("words of fewer than four code points")
    ranks = bigram_ranks(words)

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in (batch.slice(k, 2000) for k in range(0, batch.num_rows, 2000)):
                key, longer, at = [], [], []
                for k, word in enumerate(part.column("word").to_pylist()):
                    for role, keys in enumerate(keys_of(word, ranks)):
                        key += keys
                        longer += [bool(role)] * len(keys)
                        at += [k] * len(keys)
                at = pa.array(at, pa.int64())
                yield pa.RecordBatch.from_arrays([pa.array(key, pa.string()), pa.array(longer, pa.bool_()), part.column("word").take(at), part.column("n").take(at)], ["key", "longer", "word", "n"])

    rows = words.select("word", F.col("n").cast("long").alias("n")).mapInArrow(emit, "key string, longer boolean, word string, n long")
    b = rows.select("key", "longer", F.col("word").alias("other"), F.col("n").alias("other_n"))
    one = (F.col("longer") | (F.col("word") < F.col("other"))) & (F.levenshtein("word", "other", 1) == 1)
    met = rows.where("not longer").drop("longer").join(b, "key").where(one).select("word", "n", "other", "other_n").distinct()
    met = staged(met, "near")
    return met.unionAll(met.select(F.col("other").alias("word"), F.col("other_n").alias("n"), F.col("word").alias("other"), F.col("n").alias("other_n")))


def roots(forms: DataFrame) -> DataFrame:
    """(word, root) for (word, form): the last form reached.

    A form occurs at least twice as often as its word, so there are no circles and
    a chain has at most as many steps as the largest number has binary digits; every
    round doubles the steps taken.
    """
    now = staged(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        ahead = now.select(F.col("word").alias("root"), F.col("root").alias("_next"))
        nxt = staged(now.join(ahead, "root", "left").select("word", F.coalesce("_next", "root").alias("root"), F.col("_next").isNotNull().alias("_moved")), "roots")
        now = nxt.select("word", "root")
        if nxt.where("_moved").isEmpty():
            return now


def variants(words: DataFrame, times: int = 2) -> DataFrame:
    """(word, form, root, n, n_near, form_n) of every word of (word, n), whose words are distinct.

    ``form`` is the near word of largest n (of equal ones the smallest in code-point
    order) if it occurs at least ``times`` as often as the word, which must be 2 or
    more; else null, and the word is its own root.
    """
    if times < 2:
        raise ValueError("a form occurs at least twice as often")
    words = staged(words.select("word", "n").where("word is not null and n is not null"), "words")
    best = near_words(words).groupBy("word").agg(F.count(F.lit(1)).alias("n_near"), F.min(F.struct((-F.col("other_n")).alias("m"), F.col("other").alias("w"))).alias("b"))
    every = words.join(best, "word", "left")
    is_form = -F.col("b.m") >= F.lit(times) * F.col("n")
    rows = staged(every.select("word", "n", F.coalesce("n_near", F.lit(0)).cast("long").alias("n_near"), F.when(is_form, F.col("b.w")).alias("form"), F.when(is_form, -F.col("b.m")).alias("form_n")), "forms")
    ends = roots(rows.where("form is not null"))
    return rows.join(ends, "word", "left").select("word", "form", F.coalesce("root", "word").alias("root"), "n", "n_near", "form_n")


def spelling_variants(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", typo_every: int = 0, least_n: int = 3, least_length: int = 5) -> DataFrame:
    """``variants`` of the words of all texts with ``least_n`` occurrences and ``least_length`` code points or more.

    Null and empty texts have no words; repeated rows, null identifiers, very long
    texts and extra columns are as in ``word_counts``; an empty table gives an empty
    result.
    """
    words = word_counts(docs, id_col, text_col, typo_every).where((F.col("n") >= least_n) & (F.char_length("word") >= least_length))
    return variants(words)
