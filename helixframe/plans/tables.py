"""The driver's star-schema tables in the shapes the operators take."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> int:
    """Partitions to deal a table over: 16 for each part its files are read in, the session's number at least.

    Adaptive execution would size partitions by their compressed bytes, and 64 MB of such narrow rows are some GB in a task's sorts.
    """
    return max(int(rows.sparkSession.conf.get("spark.sql.shuffle.partitions")), 16 * rows.rdd.getNumPartitions())


def edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bipartite map: a sample is a customer, a read an order, a haplotype a brand, the weight the least quantity; dealt by read."""
    line, part, orders = (table(spark, sf_dir, t) for t in ("lineitem", "part", "orders"))
    n = spread(line)
    of_part = line.repartition(n, "l_partkey").join(part.hint("merge"), F.col("l_partkey") == F.col("p_partkey"))
    joined = of_part.repartition(n, "l_orderkey").join(orders.hint("merge"), F.col("l_orderkey") == F.col("o_orderkey"))
    return joined.groupBy(F.col("o_custkey").alias("sample"), F.col("l_orderkey").alias("read"), F.col("p_brand").alias("hap")).agg(F.min(F.col("l_quantity").cast("int")).alias("weight"))


EDGES_SQL = """
    edges AS (
        SELECT o_custkey AS sample, l_orderkey AS read, p_brand AS hap, min(CAST(l_quantity AS INT)) AS weight
        FROM lineitem JOIN part ON l_partkey = p_partkey JOIN orders ON l_orderkey = o_orderkey GROUP BY ALL
    )"""


def intervals(spark: SparkSession, sf_dir: str, contig: str = "l_partkey") -> DataFrame:
    """Intervals of days on a part (or supplier): start, stop, tandem flag and the line's own key."""
    line = table(spark, sf_dir, "lineitem")
    start = F.datediff(F.col("l_shipdate").cast("date"), F.lit("1992-01-01").cast("date"))
    return line.select(
        F.col(contig).alias("contig"), start.alias("start"), (start + F.col("l_quantity").cast("int")).alias("stop"),
        (F.col("l_returnflag") == "R").alias("tandem"), (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("record_id"),
    )


def intervals_sql(contig: str = "l_partkey", name: str = "iv") -> str:
    return f"""
    {name} AS (
        SELECT {contig} AS contig, date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) AS start,
               date_diff('day', DATE '1992-01-01', CAST(l_shipdate AS DATE)) + CAST(l_quantity AS INT) AS stop,
               l_returnflag = 'R' AS tandem, l_orderkey * 8 + l_linenumber AS record_id
        FROM lineitem
    )"""


ISLANDS_SQL = """
    marked AS (
        SELECT *, CASE WHEN start <= max(stop) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) + {gap}
                       THEN 0 ELSE 1 END AS fresh
        FROM {source}
    ), numbered AS (
        SELECT *, sum(fresh) OVER (PARTITION BY contig ORDER BY start, stop ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS island FROM marked
    ), islands AS (
        SELECT contig, min(start) AS start, max(stop) AS stop, count(*) AS n, bool_or(NOT tandem) AS real FROM numbered GROUP BY contig, island
    )"""


def records(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Variant-like records: INFO strings, REF / ALT spellings, genotypes of three samples."""
    line = table(spark, sf_dir, "lineitem")
    q = F.col("l_quantity").cast("int")
    flag, status = F.col("l_returnflag"), F.col("l_linestatus")
    alt = (
        F.when((flag == "A") & (q % 3 == 0), F.concat(F.lit("A"), F.repeat(F.lit("C"), q)))
        .when(flag == "A", "<DEL>").when((flag == "R") & (q % 2 == 0), F.concat(F.lit("A["), F.lit("CHR"), (F.col("l_suppkey") % 22 + 1).cast("string"), F.lit(":"), F.col("l_partkey").cast("string"), F.lit("[")))
        .when(flag == "R", "G").when(status == "O", "<DUP:TANDEM>").otherwise("ATT")
    )
    info = F.when(flag == "A", F.concat(F.lit("END="), (F.col("l_partkey") + q).cast("string"), F.lit(";SVLEN=-"), q.cast("string"), F.lit(";CIPOS=-2,3;PRECISE"))).otherwise(
        F.concat(F.lit("CIEND=1,2;SVLEN="), q.cast("string"), F.lit(";STDEV_POS="), (q % 4).cast("string")))
    call = lambda k: F.when((F.col("l_orderkey") + k) % 5 == 0, "./.").when((F.col("l_orderkey") + F.col("l_linenumber") * k) % 3 == 0, "0|1:9").when((q + k) % 4 == 0, "1/1:3").otherwise("0/0:7")
    return line.select(
        (F.col("l_orderkey") * 8 + F.col("l_linenumber")).alias("id"), F.concat(F.lit("chr"), (F.col("l_suppkey") % 24 + 1).cast("string")).alias("contig"), F.col("l_partkey").cast("int").alias("pos"),
        F.when((flag == "R") & (q % 2 == 1), "A").when(flag == "N", "ACG").otherwise("A").alias("ref"), alt.alias("alt"), F.col("l_extendedprice").alias("qual"),
        F.when(F.col("l_discount") > 0.08, "LOWQ").otherwise("PASS").alias("filter"), info.alias("info"), F.array(call(1), call(2), call(3)).alias("genotypes"),
    )


RECORDS_SQL = """
    rec AS (
        SELECT l_orderkey * 8 + l_linenumber AS id, 'chr' || (l_suppkey % 24 + 1) AS contig, CAST(l_partkey AS INT) AS pos,
               CASE WHEN l_returnflag = 'R' AND q % 2 = 1 THEN 'A' WHEN l_returnflag = 'N' THEN 'ACG' ELSE 'A' END AS ref,
               CASE WHEN l_returnflag = 'A' AND q % 3 = 0 THEN 'A' || repeat('C', q) WHEN l_returnflag = 'A' THEN '<DEL>'
                    WHEN l_returnflag = 'R' AND q % 2 = 0 THEN 'A[CHR' || (l_suppkey % 22 + 1) || ':' || l_partkey || '['
                    WHEN l_returnflag = 'R' THEN 'G' WHEN l_linestatus = 'O' THEN '<DUP:TANDEM>' ELSE 'ATT' END AS alt,
               l_extendedprice AS qual, CASE WHEN l_discount > 0.08 THEN 'LOWQ' ELSE 'PASS' END AS filter,
               CASE WHEN l_returnflag = 'A' THEN 'END=' || (l_partkey + q) || ';SVLEN=-' || q || ';CIPOS=-2,3;PRECISE'
                    ELSE 'CIEND=1,2;SVLEN=' || q || ';STDEV_POS=' || (q % 4) END AS info,
               [CASE WHEN (l_orderkey + k) % 5 = 0 THEN './.' WHEN (l_orderkey + l_linenumber * k) % 3 = 0 THEN '0|1:9' WHEN (q + k) % 4 = 0 THEN '1/1:3' ELSE '0/0:7' END
                FOR k IN [1, 2, 3]] AS genotypes,
               q, l_returnflag AS flag, l_linestatus AS status
        FROM (SELECT *, CAST(l_quantity AS INT) AS q FROM lineitem)
    )"""
