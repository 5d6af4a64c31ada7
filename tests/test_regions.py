from __future__ import annotations

import random

import pytest
from helixframe.sources import regions
from pyspark.sql import functions as F


@pytest.fixture(scope="module")
def laid(spark, tmp_path_factory):
    r = random.Random(6)
    rows = [(k, r.choice(["a", "b"]), s, s + r.choice([0, 1, 150, 40_000, 3_000_000])) for k, s in enumerate(r.choice([r.randrange(1 << 18), r.randrange(1 << 26)]) for _ in range(600))]
    rows += [(900, "a", 1 << 28, 1 << 30), (901, "a", 5, None), (902, None, 5, 9), (903, "a", 131_071, 131_073), (904, "a", 131_072, 131_072)]
    path = str(tmp_path_factory.mktemp("laid") / "alignments")
    regions.write_by_region(spark.createDataFrame(rows, "id int, contig string, start long, stop long"), path)
    return rows, path


@pytest.mark.parametrize("region", [("a", 0, 1000), ("a", 131_071, 131_072), ("b", 1_000_000, 9_000_000), ("a", 1 << 29, (1 << 29) + 1), ("none", 0, 10), ("a", 77, 77)])
def test_regions_equal_full_scans(spark, laid, region):
    rows, path = laid
    contig, lo, hi = region
    found = regions.read_region(spark, path, contig, lo, hi)
    assert found.columns == ["id", "contig", "start", "stop"]
    assert sorted(r.id for r in found.collect()) == sorted(k for k, c, a, z in rows if c == contig and z is not None and a < hi and z > lo)


def test_only_files_of_the_bins_are_read(spark, laid):
    _, path = laid
    one = regions.read_region(spark, path, "a", 0, 1000)
    plan = one._jdf.queryExecution().executedPlan().toString()
    assert "PartitionFilters: [" in plan and "_bin#" in plan.split("PartitionFilters: [")[1].split("]")[0] and "LessThan(start,1000)" in plan and "GreaterThan(stop,0)" in plan
    bins = regions.bins_of_region(0, 1000)
    assert len(bins) == regions.LEVELS + 1
    table = spark.read.parquet(path)
    dirs = lambda df: {f.rsplit("/", 1)[0] for (f,) in df.select(F.input_file_name()).distinct().collect()}
    assert len(dirs(table.where((F.col("_contig") == "a") & F.col("_bin").isin(bins)))) <= len(bins) < len(dirs(table))


def test_small_bins_share_a_folder(spark, tmp_path):
    """A row in each of 1,024 small bins: one folder for 64 of them, and a region still reads its own bins' rows alone."""
    rows = spark.range(1 << 10).select("id", F.lit("a").alias("contig"), F.shiftleft("id", 17).alias("start"), (F.shiftleft("id", 17) + 9).alias("stop"))
    path = f"{tmp_path}/alignments"
    regions.write_by_region(rows, path)
    folders = {f.rsplit("/", 1)[0] for (f,) in spark.read.parquet(path).select(F.input_file_name()).collect()}
    assert len(folders) == 16
    found = regions.read_region(spark, path, "a", 5 << 17, (7 << 17) + 1)
    assert sorted(r.id for r in found.collect()) == [5, 6, 7]
    assert "_place" in found._jdf.queryExecution().executedPlan().toString()
