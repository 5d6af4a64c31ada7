"""The pipeline, stage by stage, against brute force on a small table."""

from __future__ import annotations

import random

import corpus_pipeline
import pytest
from helixframe.llm import decontaminate, near_dedup, queries
from helixframe.llm.common import staged

from .conftest import words
from .test_operators import _components

COLUMNS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def corpus(spark, tmp_path_factory):
    r = random.Random(20)
    item = " ".join(words(r, 30))
    base = words(r, 90)
    rows = [(0, None), (1, ""), (2, "12 34"), (3, " ".join(base)), (4, "  ".join(base)), (5, " ".join([*base[:50], "changed", *base[51:]])), (6, "lead in " + item + " and out"), (6, "lead in " + item + " and out"), (None, "a text without a name")]
    rows += [(10 + k, " ".join(words(r, 80))) for k in range(40)]
    rows = [(i, t, "en" if k % 4 else None, f"s{k % 3}" if k % 5 else None, None) for k, (i, t) in enumerate(rows)]
    folder = str(tmp_path_factory.mktemp("corpus"))
    spark.createDataFrame(rows, COLUMNS).write.parquet(f"{folder}/documents.parquet")
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(f"{folder}/benchmark.parquet")
    return folder, rows


def test_stages(spark, corpus):
    folder, rows = corpus
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    kept = {}
    for name, stage in corpus_pipeline.STAGES:
        out = staged(stage(spark, docs, folder), name)
        if name != "pack":
            assert out.columns == docs.columns
            kept[name] = sorted((str(x.doc_id), x.text) for x in out.collect())
        docs = out
    own = sorted((str(i), t) for i, t, *_ in rows if t and any(c.isalpha() for c in t))
    assert kept["language_id"] == own
    seen, exact = set(), []
    for i, t in sorted(own, key=lambda x: (x[0] == "None", int(x[0]) if x[0] != "None" else 0)):
        if " ".join(t.split()) not in seen:
            seen.add(" ".join(t.split()))
            exact.append((i, t))
    assert kept["exact_dedup"] == sorted(exact)
    number = lambda i: None if i == "None" else int(i)
    best = {i: c for i, _, c in _components([(number(i), t) for i, t in exact])}
    near = sorted((i, t) for i, t in exact if best[i] == i)
    assert kept["near_dedup"] == near and len(near) < len(exact)
    assert kept["decontaminate"] == [x for x in near if x[0] != "6"]
    packed = docs.groupBy("doc_id").sum("length").count()
    assert packed == len(near) - 1



def test_pipeline_of_nothing(spark, tmp_path):
    spark.createDataFrame([], COLUMNS).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).collect() == []


def test_queries_run(spark):
    assert {q.split("_")[0] for q in queries.QUERIES} == {f"op{k}" for k in range(1, 14)}
    assert decontaminate.Q and near_dedup.WORDS == 5


def test_stages_keep_the_columns_of_odd_tables(spark, odd, tmp_path):
    """Columns named as the operators' own, nulls and repeated rows."""
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    docs = odd
    for name, stage in corpus_pipeline.STAGES:
        before = docs
        docs = staged(stage(spark, docs, str(tmp_path)), name)
        if name != "pack":
            assert docs.schema == before.schema and docs.exceptAll(before).isEmpty()
