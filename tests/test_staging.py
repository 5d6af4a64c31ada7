from __future__ import annotations

import os
import subprocess
import sys
from pathlib import Path

from helixframe import staging

ROOT = Path(__file__).resolve().parent.parent
PLAIN = """
import __spark_entry__ as entry
from pyspark.sql import SparkSession
from helixframe import staging
spark = SparkSession.builder.master("local[2]").config("spark.ui.enabled", "false").config("spark.sql.shuffle.partitions", "2").getOrCreate()
assert spark.conf.get("spark.checkpoint.dir", None) is None
n = entry.queries()["windows_from_intervals"](spark, "/root/testdata/sf0.001").count()
print("ROWS", n, staging.shared_folder(spark) == staging.shared_folder(spark))
"""


def test_queries_run_without_a_set_folder(tmp_path):
    """A session of its own, without this machine's defaults."""
    env = {**os.environ, "PYTHONPATH": os.pathsep.join([str(ROOT), os.environ.get("PYTHONPATH", "")]), "SPARK_CONF_DIR": str(tmp_path)}
    done = subprocess.run([sys.executable, "-c", PLAIN], capture_output=True, text=True, env=env, cwd=ROOT, timeout=300, check=False)
    said = [x for x in done.stdout.splitlines() if x.startswith("ROWS")]
    assert said, done.stderr[-2000:]
    assert int(said[0].split()[1]) > 0 and said[0].endswith("True")


def test_staged_tables_can_be_forgotten(spark):
    df = staging.staged(spark.range(10), "numbers")
    folder = Path(staging._of_application(spark).removeprefix("file://"))
    assert df.count() == 10 and any(folder.iterdir())
    staging.forget(spark)
    assert not folder.exists()
    staging.forget(spark)  # nothing is left to delete
    assert staging.staged(spark.range(3), "numbers").count() == 3


def test_large_staged_tables_are_not_broadcast(spark):
    """Files of a few hundred kilobytes may hold a hundred times as many bytes of rows."""
    made = lambda n: staging.staged(spark.range(n).selectExpr("id", "repeat('same ', 20) AS s"), "rows")
    joins = lambda n: made(n).join(spark.range(n * 10).repartition(2), "id")._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in joins(100)
    assert "SortMergeJoin" in joins(300_000) and "BroadcastHashJoin" not in joins(300_000)
