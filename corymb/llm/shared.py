"""Helpers that every text operator uses: shared storage, column defaults, bounded broadcasts."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


_own: dict[str, str] = {}


def shared_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: the session's ``spark.checkpoint.dir``.

    A cluster must name one.  Where it is unset on a single machine (tests), the application gets a temporary folder.
    """
    found = spark.conf.get("spark.checkpoint.dir", None) or _own.get(spark.sparkContext.applicationId)
    if not found:
        if not spark.sparkContext.master.split("[")[0] == "local":
            raise RuntimeError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        found = _own[spark.sparkContext.applicationId] = "file://" + tempfile.mkdtemp(prefix="corymb_")
    return found


#: Shuffle partitions to a file of a table that is far smaller than what its tasks read.
TASKS_A_FILE = 16


def materialise(df: DataFrame, name: str, few: bool = False) -> DataFrame:
    """Write ``df`` to the shared folder once and read it back, which cuts its lineage.

    A lost executor costs a re-read of a file, not a recomputation of what led to it.  The files go
    when the session's JVM ends.  With ``few``, rows are dealt evenly to a sixteenth of the shuffle partitions first:
    for ids and links, of which a task has so few that its file would cost more than they do.
    """
    spark = df.sparkSession
    if few:
        df = df.repartition(max(1, int(spark.conf.get("spark.sql.shuffle.partitions")) // TASKS_A_FILE))
    path = f"{shared_dir(spark).rstrip('/')}/corymb/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    at = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(path)
    at.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(at)
    return spark.read.schema(df.schema).parquet(path)


#: Rows and bytes of an Arrow batch, so that a batch of long texts fits beside the heap; Spark's defaults are 10 000 and 64 MiB.
BATCH_ROWS, BATCH_BYTES = 2000, 8 << 20


def small_batches(spark: SparkSession) -> None:
    """Bounds the session's Arrow batches where it sets no bounds itself: both sides hold several of them at once."""
    for key, most in (("maxRecordsPerBatch", BATCH_ROWS), ("maxBytesPerBatch", BATCH_BYTES)):
        if spark.conf.get(f"spark.sql.execution.arrow.{key}", None) is None:
            spark.conf.set(f"spark.sql.execution.arrow.{key}", most)


def need(df: DataFrame, **kinds: str) -> DataFrame:
    """Only the named columns, cast to the given types; raises if one is missing."""
    have = {c.lower(): c for c in df.columns}
    if missing := [c for c in kinds if c not in have]:
        raise ValueError(f"no column {', '.join(missing)} among {', '.join(df.columns)}")
    return df.select(*(F.col(f"`{have[c]}`").cast(kind).alias(c) for c, kind in kinds.items()))


def read(spark: SparkSession, sf_dir: str, table: str, **kinds: str) -> DataFrame:
    return need(spark.read.parquet(f"{sf_dir}/{table}.parquet"), **kinds)


def free_name(df: DataFrame, stem: str) -> str:
    """A column name that ``df`` doesn't have."""
    taken = {c.lower() for c in df.columns}
    while stem.lower() in taken:
        stem = "_" + stem
    return stem


def hex_bits(text: Column, digits: int, start: int = 1) -> Column:
    """``digits`` hexadecimal digits of the text's MD5 as an integer: the same in any engine."""
    return F.conv(F.substring(F.md5(text.cast("string").cast("binary")), start, digits), 16, 10).cast("long")


def fits(df: DataFrame, most: int) -> bool:
    """Whether ``df`` has at most so many rows; looks no further than one row beyond."""
    return df.limit(most + 1).count() <= most


def broadcast_rows(spark: SparkSession, row_bytes: int) -> int:
    """Rows of so many bytes that fit the session's own bound of a broadcast; 10 MB where it sets none."""
    bound = spark.conf.get("spark.sql.autoBroadcastJoinThreshold", "10m")
    if bound.lstrip().startswith("-"):  # the session broadcasts nothing
        return 0
    return spark._jvm.org.apache.spark.network.util.JavaUtils.byteStringAsBytes(bound) // row_bytes
