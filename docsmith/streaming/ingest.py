"""Incremental ingest: new files are fingerprinted as they arrive and each hash is taken once."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery


def arrivals(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """A stream of (path, hash, bytes, modified) of files below a path."""
    schema = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(schema).option("recursiveFileLookup", True).option("maxFilesPerTrigger", max_files).load(path)
    return files.select("path", F.sha2("content", 256).alias("hash"), F.col("length").alias("bytes"), F.col("modificationTime").alias("modified"))


def first_of_each(stream: DataFrame, late: str | None = None) -> DataFrame:
    """The first row of every hash.  With a watermark (``late``), hashes are forgotten after that time."""
    if late is None:
        return stream.dropDuplicates(["hash"])
    return stream.withWatermark("modified", late).dropDuplicatesWithinWatermark(["hash"])


def append_new(stream: DataFrame, log: str, checkpoint: str) -> StreamingQuery:
    """Append every new hash to a log table until the input is used up; a second start goes on where the first ended."""

    def write(batch: DataFrame, epoch: int) -> None:
        # a batch that runs again replaces its own part
        batch.write.mode("overwrite").parquet(f"{log}/epoch={epoch}")

    return first_of_each(stream).writeStream.foreachBatch(write).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def windowed_counts(stream: DataFrame, width: str = "10 minutes", late: str = "30 minutes") -> DataFrame:
    """Arrivals and bytes for each stretch of time, for monitoring."""
    return stream.withWatermark("modified", late).groupBy(F.window("modified", width)).agg(F.count("*").alias("files"), F.sum("bytes").alias("bytes"))
