"""Every query with SQL against a second engine on the small tables."""

from __future__ import annotations

import __spark_entry__ as entry
import duckdb
import pytest
from helixframe.plans import more_queries  # noqa: F401
from helixframe.plans import queries as plans

from .conftest import TESTDATA

TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


@pytest.fixture(scope="module")
def duck():
    c = duckdb.connect()
    for t in TABLES:
        c.execute(f"create view {t} as select * from '{TESTDATA}/{t}.parquet'")
    return c


def _value(v):
    if isinstance(v, float):
        return round(v, 6)
    return v


@pytest.mark.parametrize("name", sorted(plans.SQL))
def test_query_equals_sql(spark, duck, name):
    df = plans.QUERIES[name](spark, TESTDATA)
    cols = sorted(df.columns)
    got = sorted((tuple(_value(v) for v in r) for r in df.select(*cols).collect()), key=repr)
    rel = duck.sql(plans.SQL[name])
    assert sorted(rel.columns) == cols
    want = sorted((tuple(_value(v) for v in r) for r in rel.project(",".join(f'"{c}"' for c in cols)).fetchall()), key=repr)
    assert got == want


def test_entry(spark):
    assert entry.entry(spark).count() > 0
    assert set(entry.oracle_sql()) <= set(entry.queries())


def test_coverage_of_lines_with_one_key_on_the_same_days(spark, tmp_path):
    """The SQL groups by key, start and stop: such lines are one record with the sum of their parts."""
    import duckdb
    from helixframe.plans import queries as plans

    rows = [(1, 1, 7, 10.0, "N"), (1, 1, 7, 10.0, "N"), (1, 1, 8, 10.0, "A"), (2, 1, 7, 10.0, "N"), (3, 1, 7, 5.0, "R"), (1, 1, 7, 9.0, "N")]
    lines = spark.createDataFrame(rows, "l_orderkey long, l_linenumber int, l_partkey long, l_quantity double, l_returnflag string").selectExpr("*", "timestamp_ntz'1995-01-02' AS l_shipdate")
    lines.write.parquet(f"{tmp_path}/lineitem.parquet")
    got = sorted((r.record_id, r.covered) for r in plans.track_coverage(spark, str(tmp_path)).collect())
    db = duckdb.connect()
    db.execute(f"CREATE VIEW lineitem AS SELECT * FROM '{tmp_path}/lineitem.parquet/*.parquet'")
    assert got == sorted(db.execute(plans.SQL["track_coverage"]).fetchall())
    assert len(got) == 3
