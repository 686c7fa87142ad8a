"""Lossless JSON of files' structure, and back to relations."""

from __future__ import annotations

import base64
import json
from collections.abc import Iterator
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .. import __name__ as package
from ..errors import CorruptFile
from ..format.schema import effective_logical_type
from ..operators import relations as R
from . import listing
from .ranges import Ranges

#: Versions of the two shapes of dumps.
VERSIONS = {"file": 3, "metadata": 2}
DUMP = "file_path string, json string"


def _b64(raw: bytes | None) -> str | None:
    return None if raw is None else base64.urlsafe_b64encode(raw).decode()


def _raw(text: str | None) -> bytes | None:
    return None if text is None else base64.urlsafe_b64decode(text + "=" * (-len(text) % 4))


def _statistics(s: dict[str, Any] | None, path: str) -> dict[str, Any] | None:
    if s is None:
        return None
    return {"min": _b64(s["min"]), "max": _b64(s["max"]), "null_count": s["null_count"], "distinct_count": s["distinct_count"], "min_value": _b64(s["min_value"]), "max_value": _b64(s["max_value"]), "is_min_value_exact": s["is_min_value_exact"], "is_max_value_exact": s["is_max_value_exact"], "schema_path": path}


_STAT_BYTES = ("min", "max", "min_value", "max_value")


def _statistics_back(s: dict[str, Any] | None) -> dict[str, Any] | None:
    return None if s is None else {k: _raw(s[k]) if k in _STAT_BYTES else s[k] for k in (*_STAT_BYTES, "null_count", "distinct_count", "is_min_value_exact", "is_max_value_exact")}


def compression(compressed: int, uncompressed: int) -> dict[str, Any]:
    share = compressed / uncompressed if uncompressed else 0.0
    return {"total_compressed": compressed, "total_uncompressed": uncompressed, "ratio": share, "space_saved_percent": (1 - share) * 100 if uncompressed else 0.0, "compressed_mb": compressed / (1 << 20), "uncompressed_mb": uncompressed / (1 << 20)}


def _logical(found: dict[str, Any] | None) -> dict[str, Any] | None:
    return found and {"logical_type": found["name"]} | {k: v for k, v in found.items() if k != "name" and v is not None}


def _schema(nodes: list[dict[str, Any]]) -> dict[str, Any]:
    made: dict[int, dict[str, Any]] = {}
    for n in nodes:
        common = {k: n[k] for k in ("element_type", "name", "full_path", "start_offset", "byte_length", "definition_level", "repetition_level", "repetition", "converted_type", "field_id")} | {"logical_type": _logical(n["logical_type"])}
        if n["element_type"] == "column":
            own = common | {k: n[k] for k in ("type", "type_length", "scale", "precision")} | {"list_semantics": n["list_semantics"] and n["list_semantics"].lower()}
        else:
            own = common | {"num_children": n["num_children"], "children": {}}
        made[n["element_id"]] = own
        if n["parent_id"] is not None:
            children, name = made[n["parent_id"]]["children"], n["name"]
            while name in children:
                name += "'"
            children[name] = own
    return made[0]


def _metadata(foot: dict[str, Any]) -> dict[str, Any]:
    groups = []
    for g in foot["row_groups"]:
        chunks = {}
        for c in g["columns"]:
            meta = {k: c[k] for k in ("start_offset", "byte_length", "type", "encodings")} | {"path_in_schema": c["column_path"]} | {k: c[k] for k in ("codec", "num_values", "total_uncompressed_size", "total_compressed_size", "data_page_offset", "index_page_offset", "dictionary_page_offset")}
            meta |= {"statistics": _statistics(c["statistics"], c["column_path"]), "encoding_stats": c["encoding_stats"], "bloom_filter_offset": c["bloom_filter_offset"], "bloom_filter_length": c["bloom_filter_length"], "size_statistics": c["size_statistics"], "geospatial_statistics": c["geospatial_statistics"]}
            name = c["column_path"]
            while name in chunks:  # columns `a.b` and a{b}; "path" tells them apart
                name += "'"
            own = [{"key": p["key"], "value": _b64(p["value"])} for p in c["key_values"] or []]
            chunks[name] = {"path": c["path"], "key_values": own, "file_offset": c["file_offset"], "metadata": meta, "file_path": c["chunk_file_path"]} | {k: c[k] for k in ("offset_index_offset", "offset_index_length", "column_index_offset", "column_index_length")}
        sizes = [sum(c[k] for c in g["columns"]) for k in ("total_compressed_size", "total_uncompressed_size")]
        groups.append({"start_offset": g["start_offset"], "byte_length": g["byte_length"], "column_chunks": chunks, "total_byte_size": g["total_byte_size"], "row_count": g["row_count"], "sorting_columns": g["sorting_columns"] or [], "file_offset": g["file_offset"], "total_compressed_size": g["total_compressed_size"], "ordinal": g["ordinal"], "compression_stats": compression(*sizes)})
    pairs = [{"start_offset": p["start_offset"], "byte_length": p["byte_length"], "key": p["key"], "value": None if p["value"] is None else p["value"].decode("utf-8", "surrogateescape")} for p in foot["key_values"]]
    totals = [sum(g["compression_stats"][k] for g in groups) for k in ("total_compressed", "total_uncompressed")]
    return {"version": foot["version"], "schema_root": _schema(foot["schema_elements"]), "row_groups": groups, "created_by": foot["created_by"], "key_value_metadata": pairs, "start_offset": foot["footer_offset"], "total_byte_size": foot["footer_size"], "compression_stats": compression(*totals), "column_count": foot["column_count"], "row_count": foot["row_count"], "row_group_count": foot["row_group_count"], "num_rows": foot["num_rows"], "column_orders": foot["column_orders"]}


_PAGE = ("page_type", "start_offset", "header_size", "compressed_page_size", "uncompressed_page_size", "crc")


def _page(p: dict[str, Any], path: str) -> dict[str, Any]:
    own = {k: p[k] for k in _PAGE}
    if p["page_type"] == "DICTIONARY_PAGE":
        return own | {"num_values": p["num_values"], "encoding": p["encoding"], "is_sorted": p["is_sorted"]}
    if p["page_type"] == "INDEX_PAGE":
        return own
    own |= {"num_values": p["num_values"], "encoding": p["encoding"], "statistics": _statistics(p["statistics"], path), "schema_path": path}
    if p["page_type"] == "DATA_PAGE":
        return own | {"definition_level_encoding": p["dl_encoding"], "repetition_level_encoding": p["rl_encoding"]}
    return own | {"num_nulls": p["num_nulls"], "num_rows": p["num_rows"], "definition_levels_byte_length": p["dl_bytes"], "repetition_levels_byte_length": p["rl_bytes"], "is_compressed": p["is_compressed"]}


def _physical(ranges: Ranges, chunk: dict[str, Any], group: int) -> dict[str, Any]:
    from ..format import thrift
    from ..format.records import BOUNDARY_ORDERS, named

    path = chunk["column_path"]
    pages = [_page(p, path) for p in R.discover(ranges, chunk)]
    of = lambda *kinds: [p for p in pages if p["page_type"] in kinds]
    column = offset = None
    if chunk["column_index_offset"] is not None:
        c = ranges.span(chunk["column_index_offset"], lambda d, at: thrift.read("ColumnIndex", d, at)[0], length=chunk["column_index_length"])
        column = {"start_offset": c["_start"], "byte_length": c["_length"], "null_pages": c["null_pages"], "min_values": [_b64(x) for x in c["min_values"]], "max_values": [_b64(x) for x in c["max_values"]], "boundary_order": named(BOUNDARY_ORDERS, c["boundary_order"], "boundary order"), "null_counts": c["null_counts"], "repetition_level_histograms": c["repetition_level_histograms"], "definition_level_histograms": c["definition_level_histograms"], "schema_path": path}
    if chunk["offset_index_offset"] is not None:
        o = ranges.span(chunk["offset_index_offset"], lambda d, at: thrift.read("OffsetIndex", d, at)[0], length=chunk["offset_index_length"])
        offset = {"start_offset": o["_start"], "byte_length": o["_length"], "page_locations": [{k: x[k] for k in ("offset", "compressed_page_size", "first_row_index")} for x in o["page_locations"]], "unencoded_byte_array_data_bytes": o["unencoded_byte_array_data_bytes"]}
    return {"path_in_schema": path, "path": chunk["path"], "start_offset": R.chunk_bounds(chunk)[0], "total_byte_size": chunk["total_compressed_size"], "codec": chunk["codec"], "num_values": chunk["num_values"], "data_pages": of("DATA_PAGE", "DATA_PAGE_V2"), "index_pages": of("INDEX_PAGE"), "dictionary_page": next(iter(of("DICTIONARY_PAGE")), None), "column_index": column, "offset_index": offset, "row_group": group}


def dump(files: DataFrame, metadata_only: bool = False, mode: str = "FAILFAST") -> DataFrame:
    """file_path, json: one document per file of a listing. Enumerated values go by name, bytes as URL-safe base64; the
    envelope `_meta` says which shape it is. A file is the work of one task."""

    def each(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        with Ranges(row["file_path"], row["file_size"]) as ranges:
            foot = R.read_footer(ranges)
            whole: dict[str, Any] = {"source": row["file_path"], "filesize": ranges.size}
            if not metadata_only:
                whole["column_chunks"] = [_physical(ranges, c, g["row_group"]) for g in foot["row_groups"] for c in g["columns"]]
            whole["metadata"] = _metadata(foot)
            if not metadata_only:
                whole |= {"magic_header": "PAR1", "magic_footer": "PAR1"}
            model = "metadata" if metadata_only else "file"
            whole["_meta"] = {"model": model, "format_version": VERSIONS[model], "producer": package.split(".")[0]}
        yield {"file_path": row["file_path"], "json": json.dumps(whole)}

    return R._map(files, each, DUMP, 4, mode)


def is_dump(text: str) -> bool:
    """Whether text is such a document, and no Parquet file or other JSON."""
    return text.lstrip()[:1] == "{" and '"_meta"' in text


def holds_dumps(spark: SparkSession, paths: str | list[str]) -> bool:
    """Whether the first bytes of one of the files are a document's, not a Parquet file's."""
    first = listing.listed(spark, paths, tasks=1).orderBy("file_path").limit(1)
    heads = R._map(first, lambda row: iter([{"head": _head(row)}]), "head binary").collect()
    return bool(heads) and bytes(heads[0]["head"]).lstrip()[:1] == b"{"


def _head(row: dict[str, Any]) -> bytes:
    with Ranges(row["file_path"], row["file_size"]) as ranges:
        return ranges.read(0, 64)


def read_dumps(spark: SparkSession, paths: str | list[str]) -> DataFrame:
    """Documents in files of one document each."""
    found = spark.read.text(paths, wholetext=True).select(F.col("_metadata.file_path").alias("file_path"), F.col("value").alias("json"))
    return found.where(F.ltrim("json").startswith("{") & F.contains("json", F.lit('"_meta"')))


def _nodes(root: dict[str, Any]) -> Iterator[dict[str, Any]]:
    count = 0

    def walk(own: dict[str, Any], parent: int | None, path: list[str]) -> Iterator[dict[str, Any]]:
        nonlocal count
        mine, count = count, count + 1
        logical = own.get("logical_type")
        flat = logical and {k: logical.get(k if k != "name" else "logical_type") for k in ("name", "bit_width", "is_signed", "scale", "precision", "unit", "is_adjusted_to_utc", "algorithm")}
        yield {k: own.get(k) for k in ("element_type", "name", "full_path", "type", "type_length", "repetition", "num_children", "converted_type", "scale", "precision", "field_id", "definition_level", "repetition_level", "list_semantics", "start_offset", "byte_length")} | {"element_id": mine, "parent_id": parent, "depth": len(path), "path": path, "logical_type": flat, "list_semantics": (own.get("list_semantics") or "").upper() or None}
        for child in (own.get("children") or {}).values():
            yield from walk(child, mine, [*path, child["name"]])

    yield from walk(root, None, [])


def _document(text: str) -> dict[str, Any]:
    try:
        return json.loads(text)
    except ValueError as error:
        raise CorruptFile(f"a dump that isn't JSON: {error}") from error


def footer_of(document: dict[str, Any]) -> dict[str, Any]:
    """A document's metadata as a row of footers."""
    try:
        meta = document["metadata"]
        nodes = list(_nodes(meta["schema_root"]))
        columns_of = [n for n in nodes if n["element_type"] == "column"]
        leaves = {n["full_path"]: n for n in columns_of} | {tuple(n["path"]): n for n in columns_of}
        groups = []
        for i, g in enumerate(meta["row_groups"]):
            columns = []
            for j, (path, c) in enumerate(g["column_chunks"].items()):
                m, leaf = c["metadata"], leaves[tuple(c["path"]) if "path" in c else path]
                pairs = [{"key": p["key"], "value": _raw(p["value"])} for p in c.get("key_values") or []]
                columns.append(m | {k: c.get(k) for k in ("offset_index_offset", "offset_index_length", "column_index_offset", "column_index_length", "file_offset")} | {
                    "column_id": j, "column_path": ".".join(leaf["path"]), "path": leaf["path"], "type_length": leaf["type_length"], "max_definition_level": leaf["definition_level"], "max_repetition_level": leaf["repetition_level"],
                    "logical_type": effective_logical_type(leaf), "chunk_file_path": c.get("file_path"), "statistics": _statistics_back(m.get("statistics")), "key_values": pairs,
                })
            groups.append({k: g.get(k) for k in ("row_count", "total_byte_size", "total_compressed_size", "file_offset", "ordinal", "sorting_columns", "start_offset", "byte_length")} | {"row_group": i, "columns": columns})
        pairs = [{"ordinal": i, "key": p["key"], "value": None if p["value"] is None else p["value"].encode("utf-8", "surrogateescape"), "start_offset": p["start_offset"], "byte_length": p["byte_length"]} for i, p in enumerate(meta.get("key_value_metadata") or [])]
        rows = sum(g["row_count"] for g in groups)
        return {"file_path": document["source"], "file_size": document["filesize"], "version": meta["version"], "created_by": meta["created_by"], "num_rows": meta.get("num_rows", rows), "column_orders": meta.get("column_orders"), "row_count": rows, "row_group_count": len(groups), "column_count": len(columns_of), "footer_offset": meta["start_offset"], "footer_size": meta["total_byte_size"], "key_values": pairs, "schema_elements": nodes, "row_groups": groups}
    except (KeyError, TypeError, AttributeError) as error:
        raise CorruptFile(f"a dump without {error}") from error


def restore(dumps: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Footers of dumps; the relations over footers follow from them."""

    def each(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        yield footer_of(_document(row["json"]))

    return R._map(dumps, each, R.FOOTER, 8, mode)


def restore_pages(dumps: DataFrame, mode: str = "FAILFAST") -> DataFrame:
    """Pages of full dumps, as `pages` finds them in files."""

    def each(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        document = _document(row["json"])
        if "column_chunks" not in document:
            return
        foot = footer_of(document)
        known = {(g["row_group"], c["column_path"]): c for g in foot["row_groups"] for c in g["columns"]}
        by_path = {(g["row_group"], *c["path"]): c for g in foot["row_groups"] for c in g["columns"]}
        for chunk in document["column_chunks"]:
            if (chunk["row_group"], chunk["path_in_schema"]) not in known:
                raise CorruptFile(f"chunk {chunk['path_in_schema']} isn't in the metadata")
            own = by_path[chunk["row_group"], *chunk["path"]] if "path" in chunk else known[chunk["row_group"], chunk["path_in_schema"]]
            whole = [*([chunk["dictionary_page"]] if chunk["dictionary_page"] else []), *chunk["index_pages"], *chunk["data_pages"]]
            for i, p in enumerate(sorted(whole, key=lambda p: p["start_offset"])):
                yield {k: own[k] for k in ("column_id", "column_path", "codec", "type", "type_length", "max_definition_level", "max_repetition_level", "logical_type")} | {
                    "file_path": foot["file_path"], "file_size": foot["file_size"], "row_group": chunk["row_group"], "page_ordinal": i, "chunk_offset": chunk["start_offset"], **{k: p[k] for k in _PAGE}, **{k: p.get(k) for k in ("num_values", "num_nulls", "num_rows", "encoding", "is_sorted", "is_compressed")},
                    "dl_encoding": p.get("definition_level_encoding"), "rl_encoding": p.get("repetition_level_encoding"), "dl_bytes": p.get("definition_levels_byte_length"), "rl_bytes": p.get("repetition_levels_byte_length"), "statistics": _statistics_back(p.get("statistics")),
                }

    return R._map(dumps, each, R.PAGE, mode=mode)


def metadata_only(dumps: DataFrame) -> DataFrame:
    """Full dumps as dumps of their metadata."""

    def each(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        document = json.loads(row["json"])
        meta = document["_meta"] | {"model": "metadata", "format_version": VERSIONS["metadata"]}
        yield {"file_path": row["file_path"], "json": json.dumps({k: document[k] for k in ("source", "filesize", "metadata")} | {"_meta": meta})}

    return R._map(dumps, each, DUMP, 8)


_STATISTICS = "struct<min:string,max:string,null_count:bigint,distinct_count:bigint,min_value:string,max_value:string,is_min_value_exact:boolean,is_max_value_exact:boolean,schema_path:string>"
_COMPRESSION = "struct<total_compressed:bigint,total_uncompressed:bigint,ratio:double,space_saved_percent:double,compressed_mb:double,uncompressed_mb:double>"
_PLACE = "start_offset:bigint,byte_length:bigint"
_PAGE_TYPE = "page_type:string not null,start_offset:bigint not null,header_size:int,compressed_page_size:bigint,uncompressed_page_size:bigint,crc:bigint"
_INDEXES = "offset_index_offset:bigint,offset_index_length:bigint,column_index_offset:bigint,column_index_length:bigint"
_CHUNK_METADATA = (
    f"struct<{_PLACE},type:string not null,encodings:array<string>,path_in_schema:string not null,codec:string not null,num_values:bigint not null,total_uncompressed_size:bigint,total_compressed_size:bigint,data_page_offset:bigint,index_page_offset:bigint,dictionary_page_offset:bigint,"
    f"statistics:{_STATISTICS},encoding_stats:array<struct<page_type:string,encoding:string,count:bigint>>,bloom_filter_offset:bigint,bloom_filter_length:bigint,size_statistics:struct<unencoded_byte_array_data_bytes:bigint,repetition_level_histogram:array<bigint>,definition_level_histogram:array<bigint>>,"
    "geospatial_statistics:struct<bbox:struct<xmin:double,xmax:double,ymin:double,ymax:double,zmin:double,zmax:double,mmin:double,mmax:double>,types:array<string>>>"
)
_GROUP = (
    f"struct<{_PLACE},column_chunks:map<string,struct<path:array<string>,key_values:array<struct<key:string,value:string>>,file_offset:bigint,metadata:{_CHUNK_METADATA} not null,file_path:string,{_INDEXES}>> not null,total_byte_size:bigint,row_count:bigint not null,"
    f"sorting_columns:array<struct<column_idx:int,descending:boolean,nulls_first:boolean>>,file_offset:bigint,total_compressed_size:bigint,ordinal:int,compression_stats:{_COMPRESSION}>"
)
_DATA_PAGE = f"struct<{_PAGE_TYPE},num_values:bigint,encoding:string,statistics:{_STATISTICS},schema_path:string,definition_level_encoding:string,repetition_level_encoding:string,num_nulls:bigint,num_rows:bigint,definition_levels_byte_length:int,repetition_levels_byte_length:int,is_compressed:boolean>"
_PHYSICAL = (
    f"struct<path_in_schema:string not null,path:array<string>,start_offset:bigint not null,total_byte_size:bigint,codec:string,num_values:bigint,data_pages:array<{_DATA_PAGE}> not null,index_pages:array<struct<{_PAGE_TYPE}>> not null,dictionary_page:struct<{_PAGE_TYPE},num_values:bigint,encoding:string,is_sorted:boolean>,"
    f"column_index:struct<{_PLACE},null_pages:array<boolean>,min_values:array<string>,max_values:array<string>,boundary_order:string,null_counts:array<bigint>,repetition_level_histograms:array<bigint>,definition_level_histograms:array<bigint>,schema_path:string>,"
    f"offset_index:struct<{_PLACE},page_locations:array<struct<offset:bigint,compressed_page_size:bigint,first_row_index:bigint>>,unencoded_byte_array_data_bytes:array<bigint>>,row_group:int not null>"
)
_DOCUMENT = (
    f"source string not null, filesize bigint not null, column_chunks array<{_PHYSICAL}>, metadata struct<version:int,schema_root:string not null,row_groups:array<{_GROUP}> not null,created_by:string,key_value_metadata:array<struct<{_PLACE},key:string,value:string>>,start_offset:bigint not null,total_byte_size:bigint not null,"
    f"compression_stats:{_COMPRESSION},column_count:bigint,row_count:bigint,row_group_count:bigint,num_rows:bigint,column_orders:array<string>> not null, magic_header string, magic_footer string, _meta struct<model:string not null,format_version:int not null,producer:string> not null"
)
_JSON = {T.StringType: str, T.BooleanType: bool, T.IntegerType: int, T.LongType: int, T.DoubleType: (int, float)}


def dump_schema() -> T.StructType:
    """Spark schema of the documents, for from_json. schema_root, a tree of any depth, is a string: its own JSON."""
    return R.schema_of(_DOCUMENT)


def _unlike(value: Any, kind: T.DataType, path: str) -> Iterator[tuple[str, str]]:
    """(path, fault) of what a value has against its type."""
    if path == "metadata.schema_root":
        if not isinstance(value, dict):
            yield path, "not an object"
    elif isinstance(kind, T.StructType):
        if not isinstance(value, dict):
            yield path, "not an object"
            return
        for name in value.keys() - set(kind.names):
            yield f"{path}.{name}".lstrip("."), "unknown"
        for field in kind:
            place = f"{path}.{field.name}".lstrip(".")
            if value.get(field.name) is not None:
                yield from _unlike(value[field.name], field.dataType, place)
            elif not field.nullable:
                yield place, "missing"
    elif isinstance(kind, T.ArrayType):
        if not isinstance(value, list):
            yield path, "not an array"
            return
        for i, x in enumerate(value):
            if x is not None:
                yield from _unlike(x, kind.elementType, f"{path}[{i}]")
    elif isinstance(kind, T.MapType):
        if not isinstance(value, dict):
            yield path, "not an object"
            return
        for name, x in value.items():
            yield from _unlike(x, kind.valueType, f"{path}[{name!r}]")
    elif not isinstance(value, _JSON[type(kind)]) or (isinstance(value, bool) and not isinstance(kind, T.BooleanType)):
        yield path, f"not of type {kind.simpleString()}"


def check(dumps: DataFrame) -> DataFrame:
    """file_path, path, fault: where documents depart from dump_schema; no rows if they don't. One that isn't JSON, or has
    a version of its shape that isn't known here, is one fault."""
    schema = dump_schema()

    def each(row: dict[str, Any]) -> Iterator[dict[str, Any]]:
        try:
            document = _document(row["json"])
        except CorruptFile as error:
            yield {"file_path": row["file_path"], "path": "", "fault": str(error)}
            return
        for path, fault in _unlike(document, schema, ""):
            yield {"file_path": row["file_path"], "path": path, "fault": fault}
        about = document.get("_meta") if isinstance(document, dict) else None
        if isinstance(about, dict) and about.get("format_version") != VERSIONS.get(about.get("model")):
            yield {"file_path": row["file_path"], "path": "_meta.format_version", "fault": f"version {about.get('format_version')} of {about.get('model')} isn't known"}

    return R._map(dumps, each, "file_path string, path string, fault string", 8)
