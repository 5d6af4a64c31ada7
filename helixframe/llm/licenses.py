"""License scans: an exact set-similarity join of text blocks with license templates.

Blocks are the lines of a text, and windows over the words of the whole text,
line breaks ignored, so that notices wrapped over lines are met.  Windows, and
those of a line that is longer, have twice the longest template's span and
overlap by half, so that no run as long as a template's span is torn.  A block meets a template where it holds
``CONTAINED`` of the template's distinct words.  Words are ordered by their
frequency over all documents, rarest first:

    prefix      a block that meets a template has one of its first
                n - ceil(CONTAINED * n) + 1 words
    length      and at least ceil(CONTAINED * n) distinct words
    positional  and, from the first prefix word they share, enough words left
                on both sides of the order

What passes is verified by counting in runs of the template's span, its own number of
words and ``SLACK`` of it more, so that words of a short template that are scattered
over a block are no notice.  The base phrases are consecutive words, found beside
the join wherever they stand.
"""

from __future__ import annotations

import math
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import whole_text

CONTAINED = 0.9
#: Words that a notice may hold beside its template's own, as a part of their number, rounded up.
SLACK = 0.25
#: Templates are broadcast; together they may hold this many words.
MOST_TEMPLATE_WORDS = 200_000
#: A base phrase's words, and its label (fixed values).
PHRASES = {
    "mit license": "mit",
    "apache license": "apache",
    "general public license": "gpl",
}
#: Notices of common licenses, and their labels (fixed values).
TEMPLATES = [
    ("mit", "released under the MIT License"),
    ("mit", "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated documentation files"),
    ("apache", "licensed under the Apache License, Version 2.0"),
    ("apache", "you may not use this file except in compliance with the License. You may obtain a copy of the License at"),
    ("gpl", "licensed under the GNU General Public License, version 3"),
    ("gpl", "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General Public License as published by the Free Software Foundation"),
    ("lgpl", "licensed under the GNU Lesser General Public License"),
    ("agpl", "licensed under the GNU Affero General Public License"),
    ("bsd", "Redistribution and use in source and binary forms, with or without modification, are permitted provided that the following conditions are met"),
    ("isc", "Permission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted"),
    ("mpl", "This Source Code Form is subject to the terms of the Mozilla Public License"),
    ("cc-by", "licensed under CC BY 4.0"),
    ("cc-by-sa", "licensed under CC BY-SA 4.0"),
    ("cc-by-nc", "licensed under CC BY-NC 4.0"),
    ("cc-by-nd", "licensed under CC BY-ND 4.0"),
    ("cc0", "dedicated to the public domain under CC0 1.0 Universal"),
    ("proprietary", "all rights reserved no part of this publication may be reproduced without permission"),
]
#: Bytes of words stay, A-Z are lower-cased, the line feed stays, all others part words.
_TABLE = bytes(b + 32 if 65 <= b <= 90 else b if b in (10, *range(48, 58), *range(97, 123)) or b >= 128 else 32 for b in range(256))


def lines_of(text: str) -> list[list[bytes]]:
    """The words of every line."""
    return [x.split() for x in text.encode("utf-8", "surrogatepass").translate(_TABLE).split(b"\n")]


def span_of(n_words: int) -> int:
    """The words in which a template of so many must be held."""
    return n_words + math.ceil(SLACK * n_words)


class Templates:
    """Templates with their words in global order, rarest first, and the index of their prefixes."""

    def __init__(self, templates: list[tuple[str, str]], frequency: dict[bytes, int]):
        self.labels = [x for x, _ in templates]
        words = [frozenset(w for line in lines_of(t) for w in line) for _, t in templates]
        self.rank = {w: k for k, w in enumerate(sorted({w for x in words for w in x}, key=lambda w: (frequency.get(w, 0), w)))}
        self.sets = words
        self.order = [sorted(map(self.rank.__getitem__, x)) for x in words]
        self.need = [max(1, math.ceil(CONTAINED * len(x) - 1e-9)) for x in words]
        self.prefix: dict[bytes, list[tuple[int, int]]] = {}  # word: templates, and its place in their order
        name = {r: w for w, r in self.rank.items()}
        for t, order in enumerate(self.order):
            for at, r in enumerate(order[: len(order) - self.need[t] + 1]):
                self.prefix.setdefault(name[r], []).append((t, at))
        self.first = frozenset(self.prefix)
        self.span = [span_of(sum(map(len, lines_of(t)))) for _, t in templates]
        self.block = 2 * max([1, *self.span])
        self.phrases = [(tuple(p.encode().split()), label) for p, label in PHRASES.items()]
        self.last = frozenset(p[-1] for p, _ in self.phrases)

    def densest(self, block: list[bytes], t: int) -> int:
        """The most distinct words of a template in a run of its span."""
        words, span = self.sets[t], self.span[t]
        at = [k for k, w in enumerate(block) if w in words]
        if not at or at[-1] - at[0] < span:
            return len({block[k] for k in at})
        held: dict[bytes, int] = {}
        best = first = 0
        for k in at:
            held[block[k]] = held.get(block[k], 0) + 1
            while at[first] <= k - span:
                w = block[at[first]]
                held[w] -= 1
                if not held[w]:
                    del held[w]
                first += 1
            best = max(best, len(held))
        return best

    def meets(self, block: list[bytes]) -> list[tuple[int, int]]:
        """(template, words shared in a run of its span) of every template that the block meets."""
        have = set(block)
        shared = self.first & have
        if not shared:
            return []
        ranks = sorted(self.rank[w] for w in have & self.rank.keys())
        place = {r: k for k, r in enumerate(ranks)}
        out, seen = [], set()
        for w in sorted(shared, key=self.rank.__getitem__):
            for t, at in self.prefix[w]:
                if t in seen:
                    continue
                seen.add(t)  # w is the first word they share in global order
                if len(have) < self.need[t] or min(len(self.order[t]) - at, len(ranks) - place[self.rank[w]]) < self.need[t]:
                    continue
                if len(self.sets[t] & have) >= self.need[t] and (n := self.densest(block, t)) >= self.need[t]:
                    out.append((t, n))
        return out

    def scan(self, text: str) -> tuple:
        """n_words, n_base, first_word, last_word, base_labels, labels, score, matches of a text."""
        lines = lines_of(text)
        words = [w for line in lines for w in line] if len(lines) > 1 else lines[0]
        base, labels = [], set()
        if not self.last.isdisjoint(words):
            for k, w in enumerate(words):
                if w in self.last:
                    for phrase, label in self.phrases:
                        at = k + 1 - len(phrase)
                        if at >= 0 and tuple(words[at : k + 1]) == phrase:
                            base.append(at)
                            labels.add(label)
        base_labels, score, matches = ",".join(sorted(labels)), float(bool(labels)), []
        if not self.first.isdisjoint(words):
            at, half = 0, self.block // 2
            # the lines, and the whole text as one
            for line, whole in [*((x, False) for x in lines), *([(words, True)] if len(lines) > 1 else [])]:
                first = 0 if whole else at
                for s in range(0, max(1, len(line) - half), half):
                    met = self.meets(line[s : s + self.block])
                    for t, n in met:
                        part = n / len(self.sets[t])
                        matches.append({"template": t, "label": self.labels[t], "first_word": first + s, "n_words": len(line[s : s + self.block]), "containment": part})
                        score = max(score, part)
                        # a template that is a part of another one met there (CC BY of CC BY-NC) gives no label of its own
                        if not any(self.sets[t] < self.sets[u] for u, _ in met):
                            labels.add(self.labels[t])
                at += len(line)
        return len(words), len(base), min(base, default=None), max(base, default=None), base_labels, ",".join(sorted(labels)), score, matches


def frequencies(docs: DataFrame, text_col: str, templates: list[tuple[str, str]]) -> dict[bytes, int]:
    """Documents that hold each word of the templates, counted over all documents; as many numbers as the templates have words."""
    vocabulary = frozenset(w for _, t in templates for line in lines_of(t) for w in line)
    if len(vocabulary) > MOST_TEMPLATE_WORDS:
        raise ValueError(f"templates of {len(vocabulary)} words; {MOST_TEMPLATE_WORDS} can be broadcast")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = dict.fromkeys(vocabulary, 0)
        for batch in batches:
            for text in batch.column("text"):
                for w in vocabulary.intersection(text.as_py().encode("utf-8", "surrogatepass").translate(_TABLE).split()):
                    total[w] += 1
        found = {w: n for w, n in total.items() if n}
        yield pa.RecordBatch.from_arrays([pa.array(list(found), pa.binary()), pa.array(list(found.values()), pa.int64())], ["word", "n"])

    rows = docs.select(whole_text(text_col).alias("text")).mapInArrow(count, "word binary, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return {bytes(r["word"]): r["n"] for r in rows.collect()}


def license_scan(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", templates: list[tuple[str, str]] | None = None) -> DataFrame:
    """One row per input row: doc_id, n_words, n_base, first_word, last_word, base_labels, labels, score, matches.

    ``matches`` lists every (block, template) that meets: template number,
    label, the block's first word and its words, and the part of the template held.
    ``labels`` are those of the matches whose template is no proper part of another
    one met in the same block, and the base labels.
    score is the largest such part, or 1 with a base phrase.  A null or empty
    text has no words, no labels (empty strings) and score 0.  Repeated rows and
    null identifiers each give a row; an empty table gives an empty result.  Very long
    texts are read whole, window by window; other columns are not read.
    """
    templates = TEMPLATES if templates is None else templates
    told = docs.sparkSession.sparkContext.broadcast(Templates(templates, frequencies(docs, text_col, templates)))
    rows = docs.select(F.col(id_col).alias("doc_id"), whole_text(text_col).alias("text"))
    match = pa.struct([("template", pa.int32()), ("label", pa.string()), ("first_word", pa.int64()), ("n_words", pa.int64()), ("containment", pa.float64())])
    schema = f"doc_id {docs.schema[id_col].dataType.simpleString()}, n_words long, n_base long, first_word long, last_word long, base_labels string, labels string, score double, matches array<struct<template:int,label:string,first_word:long,n_words:long,containment:double>>"
    types = [pa.int64()] * 4 + [pa.string()] * 2 + [pa.float64(), pa.list_(match)]

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [told.value.scan(x.as_py()) for x in batch.column("text")]
            cols = list(zip(*found)) if found else [[]] * 8
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *(pa.array(x, t) for x, t in zip(cols, types))], ["doc_id", "n_words", "n_base", "first_word", "last_word", "base_labels", "labels", "score", "matches"])

    return rows.mapInArrow(scan, schema)
