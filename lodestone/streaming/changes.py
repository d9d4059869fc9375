"""Change streams: debounced sessions and file changes, as Structured Streaming queries."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..session import checkpoint_dir


def debounce(events: DataFrame, key: list[str], at: str, gap: str, watermark: str = "1 hour") -> DataFrame:
    """Sessions of changes that are no more than ``gap`` apart, on a stream or a batch. Events later than
    the watermark are dropped by a stream in append or update mode."""
    timed = events.withColumn(at, F.col(at).cast("timestamp"))
    if timed.isStreaming:
        timed = timed.withWatermark(at, watermark)
    s = timed.groupBy(*key, F.session_window(at, gap).alias("w")).agg(F.count("*").alias("events"))
    return s.select(*key, F.col("w.start").alias("started"), "events")


def run_to_table(stream: DataFrame, mode: str = "append") -> DataFrame:
    """Runs a stream over what is there now and returns what it has written, in the shared folder. In append
    mode a row is written once the watermark has passed it and its state is dropped; ``complete`` keeps the
    state of all keys and is for results of bounded size."""
    spark = stream.sparkSession
    base = os.path.join(checkpoint_dir(spark), uuid.uuid4().hex)
    got: list[str] = []

    def keep(batch: DataFrame, n: int) -> None:
        path = f"{base}/out/{n}"
        batch.write.mode("overwrite").parquet(path)
        got.append(path)

    q = stream.writeStream.outputMode(mode).option("checkpointLocation", f"{base}/state").trigger(availableNow=True).foreachBatch(keep).start()
    q.awaitTermination()
    if not got:
        return spark.createDataFrame([], stream.schema)
    return spark.read.parquet(got[-1]) if mode == "complete" else spark.read.parquet(*got)


def read_stream(spark: SparkSession, path: str) -> DataFrame:
    """A stream over a Parquet folder or file, with the schema of what is there."""
    schema = spark.read.parquet(path).schema
    folder, name = os.path.split(path.rstrip("/"))
    return spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder) if name.endswith(".parquet") else spark.readStream.schema(schema).parquet(path)


def file_changes(spark: SparkSession, folder: str, glob: str = "*"):
    """A stream of files as they appear: ``path, changed, hash``; with ``debounce`` the watcher of a
    repository, with ``resolve.delta`` against a stored table its change detector."""
    raw = spark.readStream.format("binaryFile").option("pathGlobFilter", glob).option("recursiveFileLookup", "true")
    schema = "path string, modificationTime timestamp, length bigint, content binary"
    return raw.schema(schema).load(folder).select("path", F.col("modificationTime").alias("changed"), F.md5("content").alias("hash"))
