"""A streaming twin of the plant means: running means of events by user, and windowed counts with a watermark.

The reference has no streams; this is an extension.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corymb.sources.scratch import scratch


def event_stream(spark: SparkSession, path: str, files_each: int = 1) -> DataFrame:
    """A table as a stream of its files; times become instants in the session's zone."""
    folder, _, name = path.rstrip("/").rpartition("/")
    d = spark.readStream.schema(spark.read.parquet(path).schema).option("maxFilesPerTrigger", files_each).option("pathGlobFilter", name).parquet(folder)
    return d.withColumn("ts", F.col("ts").cast("timestamp"))


def user_means(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id", "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"))


def windowed(events: DataFrame, late: str = "2 hours", width: str = "1 hour") -> DataFrame:
    """Counts and sums by hour and type; an hour's state is dropped once the watermark has passed it."""
    w = events.withWatermark("ts", late).groupBy(F.window("ts", width), "event_type")
    return w.agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(F.col("window.start").alias("start"), "event_type", "n", "total")


def drained(stream: DataFrame, *keys: str) -> DataFrame:
    """All that a stream of aggregates by ``keys`` yields from what is there now, as a table.

    Each batch's changed rows are written to files, with the query's own checkpoint beside them; the last
    row of each key is the table.  The driver sees no rows, and the state goes as the watermark passes.
    """
    path = scratch(stream.sparkSession, "drained")

    def put(batch: DataFrame, number: int) -> None:
        batch.withColumn("_batch", F.lit(number)).write.mode("overwrite").parquet(f"{path}/rows/{number}")

    q = stream.writeStream.outputMode("update").foreachBatch(put).option("checkpointLocation", f"{path}/checkpoint").trigger(availableNow=True).start()
    q.awaitTermination()
    rows = stream.sparkSession.read.option("recursiveFileLookup", "true").schema(T.StructType([*stream.schema.fields, T.StructField("_batch", T.IntegerType())])).parquet(f"{path}/rows")
    values = [c for c in stream.columns if c not in keys]
    return rows.groupBy(*keys).agg(F.max_by(F.struct(*values), "_batch").alias("_v")).select(*keys, "_v.*")
