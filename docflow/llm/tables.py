"""Tables written between steps, in the folder the cluster names in spark.checkpoint.dir.

A written table cuts lineage like a reliable checkpoint does, compressed and columnar, and
survives the loss of any executor. Nothing here touches a machine-local folder on a cluster:
only where the setting is unset (tests) is a temporary folder used.
"""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL: dict[str, str] = {}


def shared_folder(spark: SparkSession) -> str:
    """The folder all executors see; a temporary one only where the cluster names none."""
    named = spark.conf.get("spark.checkpoint.dir", None)
    if named:
        return named.rstrip("/")
    if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
        raise RuntimeError("set spark.checkpoint.dir to a folder that driver and executors share")
    app = spark.sparkContext.applicationId
    if app not in _LOCAL:
        _LOCAL[app] = "file://" + tempfile.mkdtemp(prefix="docflow-")
    return _LOCAL[app]


def written(df: DataFrame, name: str, *by: str) -> tuple[DataFrame, str]:
    """Writes `df` as Parquet, in folders by the columns `by`, and returns the frame that reads it, with its path for `forget`.

    What was shuffled to make it is of no use any more: a collection on the driver lets Spark's
    cleaner delete these files now and not when its heap happens to fill.
    """
    spark = df.sparkSession
    path = f"{shared_folder(spark)}/docflow-{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    (writer.partitionBy(*by) if by else writer).parquet(path)
    spark._jvm.System.gc()
    return spark.read.schema(df.schema).parquet(path), path


def cut(df: DataFrame, name: str) -> DataFrame:
    """`written` where the path is of no interest."""
    return written(df, name)[0]


def forget(spark: SparkSession, *paths: str) -> None:
    """Deletes tables that no later step reads."""
    jvm = spark._jvm
    for p in paths:
        at = jvm.org.apache.hadoop.fs.Path(p)
        at.getFileSystem(spark._jsc.hadoopConfiguration()).delete(at, True)
