"""Packages as they arrive in a folder, each taken once by its content."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources import package


def incoming(spark: SparkSession, folder: str, most_files: int = 1000) -> DataFrame:
    """A stream of (path, doc_id, content, sha256) of new files; one over the limit has no content and loads as an error."""
    kind = "path string, modificationTime timestamp, length long, content binary"
    files = spark.readStream.format("binaryFile").schema(kind).option("maxFilesPerTrigger", most_files).load(folder)
    content = F.when(F.col("length") <= package.INPUT_BYTES, F.col("content")).alias("content")
    return files.select("path", F.xxhash64("path").alias("doc_id"), content, F.sha2(F.coalesce("content", F.encode("path", "UTF-8")), 256).alias("sha256"), "modificationTime")


def ingest(stream: DataFrame, table: str, checkpoint: str, delay: str = "7 days"):
    """Parts of new packages into a Parquet folder; a file whose bytes came within ``delay`` before is left out."""
    once = stream.withWatermark("modificationTime", delay).dropDuplicatesWithinWatermark(["sha256"])
    out = package.parts(once.select("doc_id", "content"))
    return out.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append").trigger(availableNow=True).start()
