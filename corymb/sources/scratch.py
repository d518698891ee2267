"""A folder that driver and executors share, for what a query must write before it goes on."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession


_own: dict[str, str] = {}


def scratch(spark: SparkSession, name: str) -> str:
    """A new path below ``spark.checkpoint.dir``; only a single machine may do without that setting.

    What is there goes when the session's JVM ends.
    """
    top = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not top:
        if spark.sparkContext.master.split("[")[0] != "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        top = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="corymb_")
    path = f"{top.rstrip('/')}/corymb/{name}-{uuid.uuid4().hex}"
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return path


def written(df: DataFrame, name: str) -> DataFrame:
    """``df``, written once and read back: for small tables that a plan reads again and again."""
    path = scratch(df.sparkSession, name)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)
