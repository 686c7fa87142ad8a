"""Table functions for SQL: SELECT * FROM parquet_pages('path')."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

from pyspark.sql import SparkSession
from pyspark.sql.functions import udtf

from ..operators import relations as R
from ..sources.ranges import Ranges

_PAGES = "row_group int, column_id int, column_path string, page_ordinal int, page_type string, start_offset bigint, header_size int, compressed_page_size bigint, uncompressed_page_size bigint, num_values bigint, encoding string"
_CHUNKS = "row_group int, row_count bigint, column_id int, column_path string, type string, codec string, num_values bigint, total_compressed_size bigint, total_uncompressed_size bigint, data_page_offset bigint, dictionary_page_offset bigint"


def _chunks(ranges: Ranges) -> Iterator[dict[str, Any]]:
    for group in R.read_footer(ranges)["row_groups"]:
        for chunk in group["columns"]:
            yield chunk | {"row_group": group["row_group"], "row_count": group["row_count"]}


def _names(ddl: str) -> list[str]:
    return [f.split()[0] for f in ddl.split(", ")]


class Pages:
    """Pages of one file; many files are the work of `pagescope.operators.relations.pages`."""

    def eval(self, path: str) -> Iterator[tuple]:
        with Ranges(path) as ranges:
            for chunk in _chunks(ranges):
                for i, page in enumerate(R.discover(ranges, chunk)):
                    row = chunk | page | {"page_ordinal": i}
                    yield tuple(row[n] for n in _names(_PAGES))


class Chunks:
    """Column chunks of one file."""

    def eval(self, path: str) -> Iterator[tuple]:
        with Ranges(path) as ranges:
            for chunk in _chunks(ranges):
                yield tuple(chunk[n] for n in _names(_CHUNKS))


def register(spark: SparkSession) -> None:
    """parquet_pages(path) and parquet_chunks(path)."""
    spark.udtf.register("parquet_pages", udtf(Pages, returnType=_PAGES))
    spark.udtf.register("parquet_chunks", udtf(Chunks, returnType=_CHUNKS))
