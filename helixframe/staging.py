"""Tables written to the folder that all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

#: Bytes of a staged table's files up to which Spark may broadcast it: they are a small part of the rows' size in memory, so Spark's own estimate is far too low.
BROADCAST_BYTES = 256 << 10

#: Folders made here, by application; spark.checkpoint.dir cannot be set in a running session.
_OWN: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """spark.checkpoint.dir of the session; where it is unset, a new temporary folder in local mode (gone at exit), an error on a cluster."""
    at = spark.conf.get("spark.checkpoint.dir", None)
    if at:
        return at.rstrip("/")
    master = spark.conf.get("spark.master", "local")
    if not master.startswith("local") or master.startswith("local-cluster"):
        raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
    app = spark.conf.get("spark.app.id")
    if app not in _OWN:
        _OWN[app] = tempfile.mkdtemp(prefix="helixframe-")
        atexit.register(shutil.rmtree, _OWN[app], ignore_errors=True)
    return "file://" + _OWN[app]


def _of_application(spark: SparkSession) -> str:
    return f"{shared_folder(spark)}/helixframe-{spark.conf.get('spark.app.id')}"


def staged(df: DataFrame, tag: str) -> DataFrame:
    """``df`` written as Parquet to the shared folder and read back: the lineage is cut and row numbers stay as they are.

    Tables over ``BROADCAST_BYTES`` ask for merge joins, or the driver would hold them whole, many times as large as their files.
    """
    spark = df.sparkSession
    path = f"{_of_application(spark)}/{uuid.uuid4().hex}/{tag}"
    df.write.option("compression", "zstd").parquet(path)
    back = spark.read.schema(df.schema).parquet(path)
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    size = folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).getContentSummary(folder).getLength()
    return back.hint("merge") if size > BROADCAST_BYTES else back


def forget(spark: SparkSession) -> None:
    """Deletes all tables this application has staged; results that were not written or collected before are lost."""
    folder = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(_of_application(spark))
    folder.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).delete(folder, True)
