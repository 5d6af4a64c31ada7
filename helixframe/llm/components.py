"""Connected components by alternating large-star and small-star steps on an edge table."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import staged

#: Groups over which the neighbours of one node are dealt.
SALTS = 16


def _small_star(edges: DataFrame) -> DataFrame:
    down = edges.select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).where("u != v")
    low = down.groupBy("u").agg(F.min("v").alias("m"))
    return down.join(low, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).unionAll(low.select("u", F.col("m").alias("v"))).where("u != v").distinct()


def _large_star(edges: DataFrame) -> DataFrame:
    """Every node's larger neighbours are linked to its least one; a hub's neighbours are dealt over SALTS, so that no task holds them all."""
    both = edges.unionAll(edges.select(F.col("v").alias("u"), F.col("u").alias("v"))).withColumn("salt", F.pmod(F.xxhash64("v"), F.lit(SALTS)).cast("int"))
    part = both.groupBy("u", "salt").agg(F.min("v").alias("m"))  # SALTS rows a node at most
    low = part.select("u", "salt", F.least(F.min("m").over(Window.partitionBy("u")), F.col("u")).alias("m"))
    return both.where("v > u").join(low, ["u", "salt"]).select(F.col("v").alias("u"), F.col("m").alias("v")).where("u != v").distinct()


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of an edge, root the component's smallest node.

    ``edges`` has two long columns u and v; loops and repeated edges do no harm.
    Every step is written to the shared folder; a component's rows are never
    gathered, and nothing but two numbers a step reaches the driver.
    """
    now = staged(edges.select("u", "v").where("u != v").distinct(), "edges")
    before = None
    while True:
        state = now.agg(F.count(F.lit(1)), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if tuple(state) == before:
            break
        before = tuple(state)
        now = staged(_small_star(_large_star(now)), "edges")
    # at the fixed point every edge leads from a node to its root
    return now.select(F.col("u").alias("node"), F.col("v").alias("root")).unionAll(now.select(F.col("v").alias("node"), F.col("v").alias("root"))).distinct()
