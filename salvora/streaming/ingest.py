"""Documents as they arrive: new files of a folder are decoded once each, by the same decoder as in batch."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from salvora.functions.limits import Limits
from salvora.sources.documents import SUFFIXES, documents

FILE_SCHEMA = "path string, modificationTime timestamp, length bigint, content binary"


def arriving(spark: SparkSession, path: str, limits: Limits | None = None, files_per_batch: int = 1000) -> DataFrame:
    """A stream of documents below path; files above the input limit are not read."""
    limit = (limits or Limits()).input_bytes
    reader = spark.readStream.format("binaryFile").schema(FILE_SCHEMA).option("pathGlobFilter", "*.{" + ",".join(SUFFIXES) + "}").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", files_per_batch)
    return documents(reader.load(path).filter(F.col("length") <= limit).select(F.col("path").alias("doc_id"), "content"), limits)


def ingest(spark: SparkSession, path: str, table: str, checkpoint: str, limits: Limits | None = None) -> None:
    """Decode what has arrived since the last run and append it to a Parquet folder, each file exactly once."""
    arriving(spark, path, limits).writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).trigger(availableNow=True).start().awaitTermination()
