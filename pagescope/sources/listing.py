"""Lists of files as DataFrames, without reading them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Tasks of a listing for each core.
FILES_TASKS_PER_CORE = 1


def listed(spark: SparkSession, paths: str | list[str], recursive: bool = True, tasks: int | None = None) -> DataFrame:
    """file_path, file_size of the Parquet files under paths (files, folders or globs that Spark reads, or http(s)
    URLs). Only names and lengths are read. The rows are dealt out evenly to a fixed number of tasks, as lists are small
    and footers are not: adaptive execution would put a list into one."""
    paths = [paths] if isinstance(paths, str) else list(paths)
    urls = [p for p in paths if p.startswith(("http://", "https://"))]
    found = spark.createDataFrame([(u, None) for u in urls], "file_path string, file_size long") if urls else None
    if own := [p for p in paths if p not in urls]:
        files = spark.read.format("binaryFile").option("recursiveFileLookup", str(recursive).lower()).load(own)
        listing = files.select(F.col("path").alias("file_path"), F.col("length").alias("file_size"))
        found = listing if found is None else found.unionByName(listing)
    if found is None:
        raise ValueError("no paths")
    return found.repartition(tasks or FILES_TASKS_PER_CORE * spark.sparkContext.defaultParallelism)
