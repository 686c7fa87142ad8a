"""A stream of new Parquet files in a folder, with their footers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..operators import relations as R


def new_files(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """file_path, file_size, modified of files as they appear; contents are not read here."""
    files = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.parquet").option("recursiveFileLookup", "true").option("maxFilesPerTrigger", per_trigger).load(folder)
    return files.select(F.col("path").alias("file_path"), F.col("length").alias("file_size"), F.col("modificationTime").alias("modified"))


def footers(spark: SparkSession, folder: str, per_trigger: int = 1000) -> DataFrame:
    """Footers of new files; one that can't be read is a row with error_class, as a stream shouldn't end at it."""
    return R.footers(spark, new_files(spark, folder, per_trigger).select("file_path", "file_size"), mode="PERMISSIVE")


def catalogue(spark: SparkSession, folder: str, table: str, checkpoint: str, available_now: bool = True) -> StreamingQuery:
    """Appends column chunks of new files to a Parquet folder, each file once."""
    chunks = R.column_chunks(footers(spark, folder)).select("file_path", "row_group", "row_count", "column_id", "column_path", "type", "codec", "num_values", "total_compressed_size", "total_uncompressed_size")
    writer = chunks.writeStream.format("parquet").option("path", table).option("checkpointLocation", checkpoint).outputMode("append")
    return (writer.trigger(availableNow=True) if available_now else writer).start()
