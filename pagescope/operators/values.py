"""Columns' values with their own Spark types, from pages."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import Unsupported
from ..functions.logical import convert, spark_type
from .relations import BATCH_ROWS, FAULTS, data_pages, decoded_pages, primitive, schema_of, with_faults

_PLACE = "file_path string, row_group int, column_id int, column_path string, page_ordinal int, entry_ordinal bigint, ord bigint, definition_level int, repetition_level int"


def column_kind(rows: DataFrame) -> tuple[str, dict[str, Any] | None]:
    """Physical and logical type that a column's chunks or pages have in all files. Chunks cost footers only."""
    kinds = rows.select("type", "logical_type").distinct().limit(2).collect()
    if len(kinds) != 1:
        raise Unsupported(f"{'nothing' if not kinds else 'several types'}: one column's rows are needed")
    return kinds[0]["type"], kinds[0]["logical_type"] and kinds[0]["logical_type"].asDict()


def column_values(page_rows: DataFrame, kind: tuple[str, dict[str, Any] | None] | None = None, apply_logical: bool = True, compat: bool = False, with_physical: bool = False, mode: str = "FAILFAST", tasks: int | None = None) -> DataFrame:
    """A row for each entry of one column's data pages: place, levels, `value` in the column's own Spark type (null where
    there is none), and `physical` if asked for. ord is an entry's place among the entries of the given pages of its row
    group, from 1; it comes from the page headers, so no values are sorted for it. kind: as column_kind finds it, where it
    is known already. PERMISSIVE adds error_class and error_message; a page that can't be read is one row with these."""
    physical, logical = kind or column_kind(page_rows)
    schema = schema_of(_PLACE).add("value", spark_type(physical, logical, compat, apply_logical))
    if with_physical:
        schema = schema.add("physical", spark_type(physical, None, apply=False))
    arrow = to_arrow_schema(schema)
    with_errors = T.StructType([*schema, *schema_of(FAULTS)])
    with_errors_kind = to_arrow_schema(with_errors)

    def converted(batches: Iterator[pa.RecordBatch], faults: list[dict[str, Any]] | None) -> Iterator[pa.RecordBatch]:
        for page, dl, rl, found in decoded_pages(batches, faults):
            for at in range(0, len(found), BATCH_ROWS):
                part, s = found.slice(at, BATCH_ROWS), slice(at, at + BATCH_ROWS)
                n = len(part)
                columns = [pa.repeat(pa.scalar(page[f.name], f.type), n) for f in list(arrow)[:5]]
                place = np.arange(at, at + n)
                columns += [primitive(x) for x in (place, place + page["first_entry"] + 1, dl[s].astype(np.int32), rl[s].astype(np.int32))]
                columns.append(convert(part, physical, logical, compat, apply_logical).cast(arrow.field("value").type))
                if with_physical:
                    columns.append(convert(part, physical, logical, compat, False).cast(arrow.field("physical").type))
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mode == "FAILFAST":
            yield from converted(batches, None)
        else:
            faults: list[dict[str, Any]] = []
            yield from with_faults(converted(batches, faults), faults, with_errors_kind)

    return data_pages(page_rows, tasks).mapInArrow(run, schema if mode == "FAILFAST" else with_errors)
