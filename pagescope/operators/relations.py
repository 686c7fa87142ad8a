"""Parquet internals as DataFrames with fixed schemas.

    files -> row_groups -> column_chunks -> pages -> page_values

Each stage takes the rows of the one before it, so a filter between stages decides what is read from the files. Only
bytes are decoded in Python, on executors, in Arrow batches; the rest is Catalyst's."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W
from pyspark.sql.pandas.types import to_arrow_schema

from ..errors import CorruptFile, ParquetError, Unsupported, reading
from ..format import footer, pages as page_format, thrift
from ..format.bloom import BLOCK_BYTES
from ..format.records import BOUNDARY_ORDERS, named
from ..sources.listing import listed
from ..sources.ranges import HEADER_GUESS, Ranges

LOGICAL = "struct<name:string,bit_width:int,is_signed:boolean,scale:int,precision:int,unit:string,is_adjusted_to_utc:boolean,algorithm:string>"
STATISTICS = "struct<max:binary,min:binary,null_count:bigint,distinct_count:bigint,max_value:binary,min_value:binary,is_max_value_exact:boolean,is_min_value_exact:boolean>"
SCHEMA_NODE = f"struct<element_id:int,parent_id:int,depth:int,element_type:string,name:string,path:array<string>,full_path:string,type:string,type_length:int,repetition:string,num_children:int,converted_type:string,scale:int,precision:int,field_id:int,logical_type:{LOGICAL},definition_level:int,repetition_level:int,list_semantics:string,start_offset:bigint,byte_length:bigint>"
CHUNK = (
    f"struct<column_id:int,column_path:string,path:array<string>,type:string,type_length:int,max_definition_level:int,max_repetition_level:int,logical_type:{LOGICAL},codec:string,encodings:array<string>,num_values:bigint,total_compressed_size:bigint,total_uncompressed_size:bigint,"
    f"data_page_offset:bigint,index_page_offset:bigint,dictionary_page_offset:bigint,statistics:{STATISTICS},size_statistics:struct<unencoded_byte_array_data_bytes:bigint,repetition_level_histogram:array<bigint>,definition_level_histogram:array<bigint>>,"
    "geospatial_statistics:struct<bbox:struct<xmin:double,xmax:double,ymin:double,ymax:double,zmin:double,zmax:double,mmin:double,mmax:double>,types:array<string>>,encoding_stats:array<struct<page_type:string,encoding:string,count:bigint>>,bloom_filter_offset:bigint,bloom_filter_length:bigint,"
    "offset_index_offset:bigint,offset_index_length:bigint,column_index_offset:bigint,column_index_length:bigint,file_offset:bigint,chunk_file_path:string,key_values:array<struct<key:string,value:binary>>,start_offset:bigint,byte_length:bigint>"
)
GROUP = f"struct<row_group:int,row_count:bigint,total_byte_size:bigint,total_compressed_size:bigint,file_offset:bigint,ordinal:int,sorting_columns:array<struct<column_idx:int,descending:boolean,nulls_first:boolean>>,start_offset:bigint,byte_length:bigint,columns:array<{CHUNK}>>"
FOOTER = (
    "file_path string, file_size bigint, version int, created_by string, num_rows bigint, row_count bigint, row_group_count bigint, column_count bigint, footer_offset bigint, footer_size bigint, column_orders array<string>, error_class string, error_message string, "
    f"key_values array<struct<ordinal:int,key:string,value:binary,start_offset:bigint,byte_length:bigint>>, schema_elements array<{SCHEMA_NODE}>, row_groups array<{GROUP}>"
)
KEYS = "file_path string, row_group int, column_id int, column_path string"
PAGE = (
    f"{KEYS}, page_ordinal int, page_type string, start_offset bigint, header_size int, compressed_page_size bigint, uncompressed_page_size bigint, crc bigint, crc_ok boolean, num_values bigint, num_nulls bigint, num_rows bigint, encoding string, dl_encoding string, rl_encoding string, "
    f"dl_bytes int, rl_bytes int, is_compressed boolean, is_sorted boolean, statistics {STATISTICS}, codec string, type string, type_length int, max_definition_level int, max_repetition_level int, logical_type {LOGICAL}, chunk_offset bigint, file_size bigint, error_class string, error_message string"
)
OFFSET_INDEX = f"{KEYS}, page_ordinal int, offset bigint, compressed_page_size bigint, first_row_index bigint, unencoded_bytes bigint, start_offset bigint, byte_length bigint"
COLUMN_INDEX = f"{KEYS}, page_ordinal int, null_page boolean, min_bytes binary, max_bytes binary, null_count bigint, boundary_order string, repetition_level_histogram array<bigint>, definition_level_histogram array<bigint>, start_offset bigint, byte_length bigint"
BLOOM = f"{KEYS}, type string, start_offset bigint, num_bytes bigint, num_blocks bigint, header_length int, byte_length bigint, bitset binary"
BLOOM_BLOCK = f"{KEYS}, num_blocks bigint, block_index bigint, block binary"
VALUE = "struct<b:boolean,i:int,l:bigint,f:float,d:double,bin:binary>"
DICTIONARY = f"{KEYS}, type string, index bigint, value {VALUE}"
PAGE_VALUES = f"{KEYS}, type string, page_ordinal int, entry_ordinal bigint, definition_level int, repetition_level int, is_null boolean, value {VALUE}"

#: Field of VALUE that a physical type's values are in.
SLOT = {"BOOLEAN": "b", "INT32": "i", "INT64": "l", "FLOAT": "f", "DOUBLE": "d", "INT96": "bin", "BYTE_ARRAY": "bin", "FIXED_LEN_BYTE_ARRAY": "bin"}
#: Rows of one Arrow batch of values.
BATCH_ROWS = 50_000
#: Tasks for each core at least, and bytes of files for one task at most, of stages that read files.
TASKS_PER_CORE, TASK_BYTES = 2, 1 << 30
#: Neighbouring pages that stay together when pages are dealt to tasks.
PAGES_TOGETHER = 8


def schema_of(ddl: str) -> T.StructType:
    return T._parse_datatype_string(ddl)


def _arrow(ddl: str) -> pa.Schema:
    return to_arrow_schema(schema_of(ddl))


def _rows(found: list[dict[str, Any]], kind: pa.Schema) -> pa.RecordBatch:
    names = kind.names
    return pa.RecordBatch.from_pylist([{n: r.get(n) for n in names} for r in found], kind)


def _fault(error: BaseException) -> dict[str, str]:
    return {"error_class": type(error).__name__, "error_message": str(error)[:500]}


FAULTS = "error_class string, error_message string"


def _map(rows: DataFrame, each: Callable[[dict[str, Any]], Iterator[dict[str, Any]]], ddl: str, batch: int = 256, mode: str = "FAILFAST") -> DataFrame:
    """Rows of `ddl` that `each` makes of each row. PERMISSIVE adds error_class and error_message: a row of what can't be
    read has these and its place, and nulls else."""
    schema = schema_of(ddl) if mode == "FAILFAST" or "error_class" in ddl else schema_of(f"{ddl}, {FAULTS}")
    kind = to_arrow_schema(schema)

    def tried(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        try:
            yield from each(row)
        except (ParquetError, OSError) as error:
            if mode == "FAILFAST":
                raise
            yield {k: v for k, v in row.items() if k in kind.names} | _fault(error)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[dict[str, Any]] = []
        for part in batches:
            for row in part.to_pylist():
                for made in tried(row):
                    held.append(made)
                    if len(held) >= batch:
                        yield _rows(held, kind)
                        held = []
        if held:
            yield _rows(held, kind)

    return rows.mapInArrow(run, schema)


def read_footer(ranges: Ranges, columns: list[str] | None = None) -> dict[str, Any]:
    with reading("the file's ends"):
        if ranges.size < footer.LEAST_SIZE:
            raise CorruptFile(f"a file of {ranges.size} bytes is too short")
        at, length = footer.locate(ranges.exactly(ranges.size - 8, 8), ranges.size)
        data = ranges.exactly(at, length)
        if ranges.exactly(0, 4) != footer.MAGIC:
            raise footer.BadMagic("the file doesn't start with the magic bytes")
    return footer.parse(data, at, columns)


def footers(spark: SparkSession, paths: str | list[str] | DataFrame, columns: list[str] | None = None, mode: str = "FAILFAST") -> DataFrame:
    """One row per file with its whole footer nested; the relations below unfold it. A file is read at its ends only.

    columns: chunks of these dotted paths only (their structs are dropped before they cross to Spark); None is all.
    mode: FAILFAST ends the query at a file that can't be read; PERMISSIVE returns its row with error_class and
    error_message, and nulls else."""
    files = paths if isinstance(paths, DataFrame) else listed(spark, paths)

    def each(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        try:
            with Ranges(row["file_path"], row["file_size"]) as ranges:
                yield {"file_path": row["file_path"], "file_size": ranges.size, **read_footer(ranges, columns)}
        except (ParquetError, OSError) as error:
            if mode == "FAILFAST":
                raise type(error)(f"{row['file_path']}: {error}") if type(error).__init__ is ParquetError.__init__ else error  # noqa: B904
            yield {"file_path": row["file_path"], "file_size": row["file_size"], **_fault(error)}

    return _map(files, each, FOOTER, 16)


def files(feet: DataFrame) -> DataFrame:
    return feet.drop("key_values", "schema_elements", "row_groups").withColumn("rows_agree", F.col("num_rows") == F.col("row_count"))


def key_values(feet: DataFrame) -> DataFrame:
    return feet.select("file_path", F.inline("key_values"))


def schema_elements(feet: DataFrame) -> DataFrame:
    return feet.select("file_path", F.inline("schema_elements"))


def row_groups(feet: DataFrame) -> DataFrame:
    return feet.select("file_path", F.inline("row_groups")).withColumn("column_count", F.size("columns")).withColumn("column_names", F.col("columns.column_path")).drop("columns")


def column_chunks(feet: DataFrame) -> DataFrame:
    one = feet.select("file_path", "file_size", F.explode("row_groups").alias("g"))
    return one.select("file_path", "file_size", F.col("g.row_group").alias("row_group"), F.col("g.row_count").alias("row_count"), F.inline("g.columns"))


def encoding_stats(chunks: DataFrame) -> DataFrame:
    return chunks.select("file_path", "row_group", "column_id", "column_path", F.inline("encoding_stats"))


def tasks_for(spark: SparkSession, size: int = 0) -> int:
    """Tasks for a stage that reads files of so many bytes together, as many as keep all cores busy at least."""
    return max(TASKS_PER_CORE * spark.sparkContext.defaultParallelism, -(-size // TASK_BYTES))


def dealt(rows: DataFrame, tasks: int | None = None) -> DataFrame:
    """Rows that say what to read, spread evenly: the unit of work below footers is a chunk, not a file. Such rows are
    tiny, so their number of tasks is a fixed one: adaptive execution would put all of them into one."""
    return rows.repartition(tasks or tasks_for(rows.sparkSession))


def _where(row: dict[str, Any]) -> dict[str, Any]:
    return {k: row[k] for k in ("file_path", "row_group", "column_id", "column_path")}


def _header_at(ranges: Ranges, at: int) -> dict[str, Any]:
    with reading(f"the page header at {at}"):
        return ranges.span(at, page_format.header, HEADER_GUESS)


def walk(ranges: Ranges, start: int, end: int) -> Iterator[dict[str, Any]]:
    """Pages from start on: each starts where the one before it ends."""
    at = start
    while at < end:
        page = _header_at(ranges, at)
        at += page["header_size"] + page["compressed_page_size"]
        if at > end:
            raise CorruptFile(f"the page at {page['start_offset']} ends after its chunk")
        yield page


def chunk_bounds(row: dict[str, Any]) -> tuple[int, int]:
    """First and last byte offsets: a dictionary page, if there is one, may come first."""
    start = min(x for x in (row["data_page_offset"], row["dictionary_page_offset"]) if x is not None)
    return start, start + row["total_compressed_size"]


def discover(ranges: Ranges, row: dict[str, Any]) -> Iterator[dict[str, Any]]:
    """Pages by the offset index, where there is one whose pages, with the dictionary page, leave no gap in the chunk;
    else by walking."""
    start, end = chunk_bounds(row)
    if row["offset_index_offset"] is not None:
        index = _offset_index(ranges, row)
        spans = sorted((p["offset"], p["offset"] + p["compressed_page_size"]) for p in index["page_locations"])
        first = spans[0][0] if spans else end
        before = list(walk(ranges, start, first)) if first > start else []
        joins = all(a[1] == b[0] for a, b in zip(spans[:-1], spans[1:], strict=True))
        if spans and joins and spans[-1][1] == end and all(p["page_type"] == "DICTIONARY_PAGE" for p in before):
            yield from before
            for at, _ in spans:
                yield _header_at(ranges, at)
            return
    yield from walk(ranges, start, end)


def pages(chunks: DataFrame, verify: bool = False, by_index: bool = True, mode: str = "FAILFAST", tasks: int | None = None) -> DataFrame:
    """A row for each page of the given chunks, in file order; filter the chunks first. verify reads the bodies as well
    and compares checksums (crc_ok). by_index=False walks headers even where an offset index lists the pages."""
    fixed_columns = ("codec", "type", "type_length", "max_definition_level", "max_repetition_level", "logical_type")

    def each(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        fixed = _where(row) | {k: row[k] for k in (*fixed_columns, "file_size")} | {"chunk_offset": chunk_bounds(row)[0]}
        with Ranges(row["file_path"], row["file_size"]) as ranges:
            for i, page in enumerate(discover(ranges, row) if by_index else walk(ranges, *chunk_bounds(row))):
                ok = page_format.crc_ok(page, _body(ranges, page)) if verify else None
                yield fixed | page | {"page_ordinal": i, "crc_ok": ok}

    place = ["data_page_offset", "dictionary_page_offset", "total_compressed_size", "offset_index_offset", "offset_index_length"]
    return _map(dealt(chunks.select("file_path", "file_size", "row_group", "column_id", "column_path", *fixed_columns, *place), tasks), each, PAGE, mode=mode)


def tiling(page_rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """file_path, row_group, column_id, column_path, tiles: whether the pages fill their chunk without gap."""
    end = F.col("start_offset") + F.col("header_size") + F.col("compressed_page_size")
    sums = page_rows.groupBy("file_path", "row_group", "column_id", "column_path").agg(F.min("start_offset").alias("first"), F.max(end).alias("last"), F.sum(F.col("header_size") + F.col("compressed_page_size")).alias("bytes"))
    bounds = chunks.select("file_path", "row_group", "column_id", F.least("data_page_offset", "dictionary_page_offset").alias("start"), "total_compressed_size")
    fits = (F.col("first") == F.col("start")) & (F.col("last") - F.col("first") == F.col("bytes")) & (F.col("bytes") == F.col("total_compressed_size"))
    return sums.join(bounds, ["file_path", "row_group", "column_id"]).select("file_path", "row_group", "column_id", "column_path", fits.alias("tiles"))


def _offset_index(ranges: Ranges, row: dict[str, Any]) -> dict[str, Any]:
    with reading("an offset index"):
        return ranges.span(row["offset_index_offset"], lambda data, at: thrift.read("OffsetIndex", data, at)[0], length=row["offset_index_length"])


def offset_index(chunks: DataFrame, mode: str = "FAILFAST", tasks: int | None = None) -> DataFrame:
    """A row for each page that an offset index lists."""

    def each(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        with Ranges(row["file_path"], row["file_size"]) as ranges:
            found = _offset_index(ranges, row)
        sizes = found["unencoded_byte_array_data_bytes"]
        for i, p in enumerate(found["page_locations"]):
            yield _where(row) | {"page_ordinal": i, "offset": p["offset"], "compressed_page_size": p["compressed_page_size"], "first_row_index": p["first_row_index"], "unencoded_bytes": sizes[i] if sizes else None, "start_offset": found["_start"], "byte_length": found["_length"]}

    wanted = chunks.where("offset_index_offset is not null").select("file_path", "file_size", "row_group", "column_id", "column_path", "offset_index_offset", "offset_index_length")
    return _map(dealt(wanted, tasks), each, OFFSET_INDEX, mode=mode)


def column_index(chunks: DataFrame, mode: str = "FAILFAST", tasks: int | None = None) -> DataFrame:
    """A row for each page that a column index describes."""

    def each(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        with Ranges(row["file_path"], row["file_size"]) as ranges, reading("a column index"):
            found = ranges.span(row["column_index_offset"], lambda data, at: thrift.read("ColumnIndex", data, at)[0], length=row["column_index_length"])
            n = len(found["null_pages"])
            if len(found["min_values"]) != n or len(found["max_values"]) != n:
                raise CorruptFile("a column index of lists of unequal lengths")

            def part(name: str, i: int) -> list[int] | None:
                whole = found[name]
                return whole[i * (len(whole) // n) : (i + 1) * (len(whole) // n)] if whole else None

            for i in range(n):
                yield _where(row) | {
                    "page_ordinal": i, "null_page": found["null_pages"][i], "min_bytes": found["min_values"][i], "max_bytes": found["max_values"][i], "null_count": found["null_counts"][i] if found["null_counts"] else None,
                    "boundary_order": named(BOUNDARY_ORDERS, found["boundary_order"], "boundary order"), "repetition_level_histogram": part("repetition_level_histograms", i), "definition_level_histogram": part("definition_level_histograms", i), "start_offset": found["_start"], "byte_length": found["_length"],
                }

    wanted = chunks.where("column_index_offset is not null").select("file_path", "file_size", "row_group", "column_id", "column_path", "column_index_offset", "column_index_length")
    return _map(dealt(wanted, tasks), each, COLUMN_INDEX, mode=mode)


def _bloom_head(ranges: Ranges, row: dict[str, Any]) -> dict[str, Any]:
    at = row["bloom_filter_offset"]
    head, size = ranges.span(at, lambda data, base: thrift.read("BloomFilterHeader", data, base), 256)
    for part, kind in (("algorithm", "BLOCK"), ("hash", "XXHASH"), ("compression", "UNCOMPRESSED")):
        if head[part][kind] is None:
            raise Unsupported(f"a bloom filter with another {part} than {kind}")
    if head["num_bytes"] <= 0 or head["num_bytes"] % BLOCK_BYTES:
        raise CorruptFile(f"a bloom filter of {head['num_bytes']} bytes")
    if row["bloom_filter_length"] is not None and row["bloom_filter_length"] != size + head["num_bytes"]:
        raise CorruptFile("a bloom filter of another length than its chunk says")
    sizes = {"num_bytes": head["num_bytes"], "num_blocks": head["num_bytes"] // BLOCK_BYTES, "header_length": size, "byte_length": size + head["num_bytes"]}
    return _where(row) | {"type": row["type"], "start_offset": at} | sizes


_BLOOM_PLACE = ("file_path", "file_size", "row_group", "column_id", "column_path", "type", "bloom_filter_offset", "bloom_filter_length")


def bloom_filters(chunks: DataFrame, bits: bool = True, mode: str = "FAILFAST", tasks: int | None = None) -> DataFrame:
    """A row for each bloom filter, with its bits unless only headers are wanted."""

    def each(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        with Ranges(row["file_path"], row["file_size"]) as ranges, reading("a bloom filter"):
            head = _bloom_head(ranges, row)
            yield head | ({"bitset": ranges.exactly(head["start_offset"] + head["header_length"], head["num_bytes"])} if bits else {})

    wanted = chunks.where("bloom_filter_offset is not null").select(*_BLOOM_PLACE)
    return _map(dealt(wanted, tasks), each, BLOOM, 8, mode)


def bloom_blocks(chunks: DataFrame, tasks: int | None = None) -> DataFrame:
    """A row for each block of 32 bytes of each bloom filter: what one lookup reads of it."""
    kind = _arrow(BLOOM_BLOCK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                with Ranges(row["file_path"], row["file_size"]) as ranges, reading("a bloom filter"):
                    head = _bloom_head(ranges, row)
                    start, blocks = head["start_offset"] + head["header_length"], head["num_blocks"]
                    for at in range(0, blocks, BATCH_ROWS):
                        n = min(BATCH_ROWS, blocks - at)
                        data = ranges.exactly(start + at * BLOCK_BYTES, n * BLOCK_BYTES)
                        body = pa.Array.from_buffers(pa.binary(BLOCK_BYTES), n, [None, pa.py_buffer(data)]).cast(pa.binary())
                        yield pa.RecordBatch.from_arrays([*_constant(head, kind.names[:5], kind, n), primitive(np.arange(at, at + n)), body], schema=kind)

    wanted = chunks.where("bloom_filter_offset is not null").select(*_BLOOM_PLACE)
    return dealt(wanted, tasks).mapInArrow(run, schema_of(BLOOM_BLOCK))


def _body(ranges: Ranges, page: dict[str, Any]) -> bytes:
    return ranges.exactly(page["start_offset"] + page["header_size"], page["compressed_page_size"])


def _slots(kind: str, found: pa.Array, kinds: pa.StructType) -> pa.Array:
    """Physical values as VALUE, one field filled."""
    n = len(found)
    columns = [found.cast(f.type) if f.name == SLOT[kind] else pa.nulls(n, f.type) for f in kinds]
    return pa.StructArray.from_arrays(columns, fields=list(kinds))


def _constant(batch: dict[str, Any], names: tuple[str, ...], kind: pa.Schema, n: int) -> list[pa.Array]:
    return [pa.repeat(pa.scalar(batch[name], kind.field(name).type), n) for name in names]


_PLACE = ("file_path", "row_group", "column_id", "column_path", "type")


class _Dictionaries:
    """The dictionary of the chunk that a task is at."""

    def __init__(self) -> None:
        self.of, self.held = None, None

    def get(self, ranges: Ranges, page: dict[str, Any]) -> pa.Array | None:
        name = (page["file_path"], page["row_group"], page["column_id"])
        if self.of != name:
            first = _header_at(ranges, page["chunk_offset"])
            self.held = page_format.dictionary(first, _body(ranges, first), page["codec"], page["type"], page["type_length"]) if first["page_type"] == "DICTIONARY_PAGE" else None
            self.of = name
        return self.held


def dictionary_values(page_rows: DataFrame) -> DataFrame:
    """A row for each entry of the given chunks' dictionaries; other pages in page_rows don't matter."""
    kind = _arrow(DICTIONARY)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for page in batch.to_pylist():
                with Ranges(page["file_path"], page["file_size"]) as ranges:
                    found = page_format.dictionary(page, _body(ranges, page), page["codec"], page["type"], page["type_length"])
                for at in range(0, len(found), BATCH_ROWS):
                    part = found.slice(at, BATCH_ROWS)
                    yield pa.RecordBatch.from_arrays([*_constant(page, _PLACE, kind, len(part)), pa.array(np.arange(at, at + len(part))), _slots(page["type"], part, kind.field("value").type)], schema=kind)

    return page_rows.where("page_type = 'DICTIONARY_PAGE'").mapInArrow(run, schema_of(DICTIONARY))


Decoded = tuple[dict[str, Any], np.ndarray, np.ndarray, pa.Array]


def decoded_pages(batches: Iterator[pa.RecordBatch], faults: list[dict[str, Any]] | None = None) -> Iterator[Decoded]:
    """Each data page with its levels and physical values. A task holds one page and one dictionary. faults: where pages
    that can't be read go, with error_class and error_message; without it such a page is an error."""
    dictionaries = _Dictionaries()
    for batch in batches:
        for page in batch.to_pylist():
            try:
                with Ranges(page["file_path"], page["file_size"]) as ranges:
                    words = dictionaries.get(ranges, page) if page["encoding"] in ("PLAIN_DICTIONARY", "RLE_DICTIONARY") else None
                    levels = page["max_definition_level"], page["max_repetition_level"]
                    found = page_format.decode(page, _body(ranges, page), page["codec"], page["type"], page["type_length"], *levels, words)
            except (ParquetError, OSError) as error:
                if faults is None:
                    raise
                faults.append(page | _fault(error))
                continue
            yield (page, *found)


def with_faults(made: Iterator[pa.RecordBatch], faults: list[dict[str, Any]], kind: pa.Schema) -> Iterator[pa.RecordBatch]:
    """Batches whose last two columns, error_class and error_message, are still to come, and a row for each fault."""

    def told() -> Iterator[pa.RecordBatch]:
        if faults:
            yield _rows(faults, kind)
            faults.clear()

    for batch in made:
        yield from told()
        yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.nulls(len(batch), pa.string()) for _ in range(2))], schema=kind)
    yield from told()


def data_pages(page_rows: DataFrame, tasks: int | None = None, together: int = PAGES_TOGETHER) -> DataFrame:
    """Data pages with first_entry, the number of entries in the chunk's pages before them; spread so that a long chunk is
    the work of several tasks, `together` neighbouring pages in each."""
    chunk = ["file_path", "row_group", "column_id"]
    before = W.partitionBy(*chunk).orderBy("page_ordinal").rowsBetween(W.unboundedPreceding, -1)
    data = page_rows.where(F.col("page_type").startswith("DATA_PAGE")).withColumn("first_entry", F.coalesce(F.sum("num_values").over(before), F.lit(0)))
    part = F.floor(F.col("page_ordinal") / together)
    return data.repartition(tasks or tasks_for(page_rows.sparkSession), *chunk, part).sortWithinPartitions(*chunk, "page_ordinal")


def primitive(found: np.ndarray) -> pa.Array:
    """A numpy array as an Arrow one, without a copy."""
    return pa.Array.from_buffers(pa.from_numpy_dtype(found.dtype), len(found), [None, pa.py_buffer(np.ascontiguousarray(found))])


def page_values(page_rows: DataFrame, tasks: int | None = None, keep: tuple[str, ...] | None = None, mode: str = "FAILFAST") -> DataFrame:
    """A row for each entry of the given data pages: levels and the physical value. entry_ordinal counts within the
    page. Filter the pages first. keep: the columns that are wanted, where not all are, as the rest costs time for each
    value. PERMISSIVE adds error_class and error_message; a page that can't be read is one row with these."""
    whole = schema_of(PAGE_VALUES)
    schema = T.StructType([f for f in whole if keep is None or f.name in keep])
    kind = to_arrow_schema(schema)
    with_errors = T.StructType([*schema, *schema_of(FAULTS)])
    with_errors_kind = to_arrow_schema(with_errors)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if mode == "FAILFAST":
            yield from decoded(batches, None)
        else:
            faults: list[dict[str, Any]] = []
            yield from with_faults(decoded(batches, faults), faults, with_errors_kind)

    def decoded(batches: Iterator[pa.RecordBatch], faults: list[dict[str, Any]] | None) -> Iterator[pa.RecordBatch]:
        makers: dict[str, Callable[[int, slice, pa.Array, np.ndarray, np.ndarray, dict[str, Any]], pa.Array]] = {
            "entry_ordinal": lambda at, s, part, dl, rl, page: primitive(np.arange(at, at + len(part))),
            "definition_level": lambda at, s, part, dl, rl, page: primitive(dl[s].astype(np.int32)),
            "repetition_level": lambda at, s, part, dl, rl, page: primitive(rl[s].astype(np.int32)),
            "is_null": lambda at, s, part, dl, rl, page: part.is_null(),
            "value": lambda at, s, part, dl, rl, page: _slots(page["type"], part, kind.field("value").type),
        }
        for page, dl, rl, found in decoded_pages(batches, faults):
            for at in range(0, len(found), BATCH_ROWS):
                part, s = found.slice(at, BATCH_ROWS), slice(at, at + BATCH_ROWS)
                columns = [makers[f.name](at, s, part, dl, rl, page) if f.name in makers else pa.repeat(pa.scalar(page[f.name], f.type), len(part)) for f in kind]
                yield pa.RecordBatch.from_arrays(columns, schema=kind)

    return data_pages(page_rows, tasks).mapInArrow(run, schema if mode == "FAILFAST" else with_errors)


def chunk_filter(columns: list[str] | None = None, groups: list[int] | None = None) -> Column:
    """Condition on chunks: dotted column paths and row group numbers; None is all, an empty list none."""
    wanted = F.lit(True)
    if columns is not None:
        wanted &= F.col("column_path").isin(columns) if columns else F.lit(False)
    if groups is not None:
        wanted &= F.col("row_group").isin(groups) if groups else F.lit(False)
    return wanted
