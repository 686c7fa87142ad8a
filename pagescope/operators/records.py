"""Whole records of row groups, in one task each: pages are decoded column by column and Dremel's levels become Arrow's
lists, structs and masks, some thousand records at a time. No value is shuffled."""

from __future__ import annotations

from collections.abc import Iterator
from typing import Any

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema, to_arrow_type

from ..errors import CorruptFile, ParquetError, reading
from ..format import pages as page_format
from ..format.schema import effective_logical_type
from ..functions.logical import convert, spark_type
from ..sources.ranges import Ranges
from .nesting import children_of, is_element, kind_of, releveled
from .relations import FAULTS, _body, _fault, dealt, discover, schema_of

#: Records and entries of one column that are assembled at a time (a longer record by itself).
RECORDS, ENTRIES = 8192, 1 << 18
#: What a chunk's pages are read by.
_CHUNK = ("column_path", "codec", "type", "type_length", "max_definition_level", "max_repetition_level", "data_page_offset", "dictionary_page_offset", "total_compressed_size", "offset_index_offset", "offset_index_length")

Levels = tuple[np.ndarray, np.ndarray, pa.Array]


class _Stream:
    """The entries of one chunk, page by page; a page more than asked for is held at most."""

    def __init__(self, ranges: Ranges, chunk: dict[str, Any]):
        self.chunk, self.flat, self.ended = chunk, not chunk["max_repetition_level"], False
        self.pages = self._decoded(ranges)
        self.held: list[Levels] = []
        self.entries = 0

    def _decoded(self, ranges: Ranges) -> Iterator[Levels]:
        c, words = self.chunk, None
        for page in discover(ranges, c):
            if page["page_type"] == "DICTIONARY_PAGE":
                words = page_format.dictionary(page, _body(ranges, page), c["codec"], c["type"], c["type_length"])
            elif page["page_type"] != "INDEX_PAGE":
                yield page_format.decode(page, _body(ranges, page), c["codec"], c["type"], c["type_length"], c["max_definition_level"], c["max_repetition_level"], words)

    def _all(self) -> Levels:
        if len(self.held) > 1:
            dl, rl, found = zip(*self.held, strict=True)
            self.held = [(np.concatenate(dl), np.concatenate(rl), pa.concat_arrays(found))]
        return self.held[0]

    def ready(self) -> int:
        """Whole records at hand, of ENTRIES entries together at most, or one; 0 at the end."""
        while not self.ended:
            if self.entries >= ENTRIES or self.flat and self.entries >= RECORDS:
                if self.flat:
                    return self.entries
                starts = np.flatnonzero(self._all()[1] == 0)
                if len(starts) > 1:
                    return max(1, int(np.searchsorted(starts, ENTRIES, side="right")) - 1)
            page = next(self.pages, None)
            if page is None:
                self.ended = True
            elif len(page[0]):
                self.held.append(page)
                self.entries += len(page[0])
        if not self.held:
            return 0
        return self.entries if self.flat else int((self._all()[1] == 0).sum())

    def take(self, records: int) -> Levels:
        dl, rl, found = self._all()
        if len(rl) and rl[0]:
            raise CorruptFile(f"{self.chunk['column_path']}: entries before the first record")
        end = records
        if not self.flat:
            starts = np.flatnonzero(rl == 0)
            end = int(starts[records]) if records < len(starts) else len(rl)
        self.held = [(dl[end:], rl[end:], found.slice(end))] if end < len(rl) else []
        self.entries -= end
        return dl[:end], rl[:end], found.slice(0, end)


class Shape:
    """The tree of the wanted columns, and how its values look in Spark."""

    def __init__(self, nodes: list[dict[str, Any]], wanted: list[str], compat: bool = False, as_stored: tuple[str, ...] = ()):
        self.nodes = releveled(nodes)
        self.children = children_of(self.nodes, set(wanted))
        self.compat, self.as_stored = compat, as_stored
        self.top = self.children.get(0, [])
        if not self.top:
            raise CorruptFile("no column of the schema is wanted")

    def _element(self, node: dict[str, Any]) -> tuple[dict[str, Any], str] | None:
        """For a list or map: its repeated child, and whether an element is a `pair`, the child's only `child`, or the
        child `itself`; None for other groups."""
        children = self.children[node["element_id"]]
        kind, only = kind_of(node), children[0]
        if only["repetition"] != "REPEATED" or len(children) > 1 or kind not in ("LIST", "MAP"):
            return None
        inside = self.children.get(only["element_id"], [])
        if kind == "MAP" and len(inside) > 1:
            return only, "pair"
        return only, "child" if kind == "MAP" and inside or len(inside) == 1 and not is_element(node, only) else "itself"

    def _pair(self, only: dict[str, Any]) -> list[tuple[str, dict[str, Any]]]:
        inside = self.children[only["element_id"]]
        return list(zip(["key", "value", *[c["name"] for c in inside[2:]]], inside, strict=True))

    def _fields(self, node: dict[str, Any]) -> list[tuple[str, dict[str, Any]]]:
        return [(c["name"], c) for c in self.children[node["element_id"]]]

    def _struct(self, fields: list[tuple[str, dict[str, Any]]]) -> T.StructType:
        return T.StructType([T.StructField(name, self.kind(child)) for name, child in fields])

    def kind(self, node: dict[str, Any]) -> T.DataType:
        own = self._own_kind(node)
        return T.ArrayType(own) if node["repetition"] == "REPEATED" else own

    def _own_kind(self, node: dict[str, Any]) -> T.DataType:
        if node["element_type"] == "column":
            return spark_type(node["type"], effective_logical_type(node), self.compat, node["full_path"] not in self.as_stored)
        listed = self._element(node)
        if listed is None:
            return self._struct(self._fields(node))
        only, what = listed
        inside = self._struct(self._pair(only)) if what == "pair" else self.kind(self.children[only["element_id"]][0]) if what == "child" else self._own_kind(only)
        return T.ArrayType(inside)

    def schema(self) -> T.StructType:
        return self._struct([(n["name"], n) for n in self.top])


class _Builder:
    """Arrays of one batch of records. A context (repetition level, definition level) is the innermost list around a node,
    or the record; its instances start at the entries of a leaf that reach both levels."""

    def __init__(self, shape: Shape, levels: dict[str, Levels]):
        self.shape, self.levels = shape, levels

    def _leaf(self, node: dict[str, Any]) -> dict[str, Any]:
        while node["element_type"] != "column":
            node = self.shape.children[node["element_id"]][0]
        return node

    def _starts(self, leaf: dict[str, Any], rl: int, dl: int) -> np.ndarray:
        own_dl, own_rl, _ = self.levels[leaf["full_path"]]
        return np.flatnonzero((own_rl <= rl) & (own_dl >= dl))

    def build(self, node: dict[str, Any], rl: int, dl: int) -> pa.Array:
        if node["repetition"] != "REPEATED":
            return self._own(node, rl, dl)
        return self._list(node, rl, dl, node, self._own(node, node["repetition_level"], node["definition_level"]), None)

    def _list(self, node: dict[str, Any], rl: int, dl: int, only: dict[str, Any], inside: pa.Array, null_below: int | None) -> pa.Array:
        leaf = self._leaf(only)
        around, each = self._starts(leaf, rl, dl), self._starts(leaf, only["repetition_level"], only["definition_level"])
        offsets = np.append(np.searchsorted(each, around), len(each)).astype(np.int32)
        mask = None
        if null_below is not None:
            mask = pa.array((self.levels[leaf["full_path"]][0][around] < null_below).tolist(), pa.bool_())
        return pa.ListArray.from_arrays(pa.array(offsets.tolist(), pa.int32()), inside, type=pa.list_(pa.field("element", inside.type)), mask=mask)

    def _struct(self, fields: list[tuple[str, dict[str, Any]]], rl: int, dl: int, mask: pa.Array | None) -> pa.Array:
        found = [self.build(child, rl, dl) for _, child in fields]
        return pa.StructArray.from_arrays(found, fields=[pa.field(name, a.type) for (name, _), a in zip(fields, found, strict=True)], mask=mask)

    def _own(self, node: dict[str, Any], rl: int, dl: int) -> pa.Array:
        """A node's value in each instance of its context, as if it were not repeated."""
        if node["element_type"] == "column":
            _, _, found = self.levels[node["full_path"]]
            at = self._starts(node, rl, dl)
            plain = found if len(at) == len(found) else found.take(pa.Array.from_buffers(pa.int64(), len(at), [None, pa.py_buffer(at)]))
            apply = node["full_path"] not in self.shape.as_stored
            made = convert(plain, node["type"], effective_logical_type(node), self.shape.compat, apply)
            return made.cast(to_arrow_type(self.shape._own_kind(node)))
        null_below = node["definition_level"] if node["repetition"] == "OPTIONAL" else None
        listed = self.shape._element(node)
        if listed is None:
            mask = None
            if null_below is not None:
                leaf = self._leaf(node)
                mask = pa.array((self.levels[leaf["full_path"]][0][self._starts(leaf, rl, dl)] < null_below).tolist(), pa.bool_())
            return self._struct(self.shape._fields(node), rl, dl, mask)
        only, what = listed
        own = only["repetition_level"], only["definition_level"]
        if what == "pair":
            inside = self._struct(self.shape._pair(only), *own, None)
        else:
            inside = self.build(self.shape.children[only["element_id"]][0], *own) if what == "child" else self._own(only, *own)
        return self._list(node, rl, dl, only, inside, null_below)


def read_records(footers: DataFrame, nodes: list[dict[str, Any]], wanted: list[str], groups: list[int] | None = None, compat: bool = False, as_stored: tuple[str, ...] = (), mode: str = "FAILFAST", tasks: int | None = None) -> DataFrame:
    """file_path, row_group, record (from 1) and a column for each top-level field that holds a wanted leaf.

    nodes: the schema that all files have, as rows of schema_elements; wanted: dotted paths of leaves. as_stored: leaves
    whose values keep their physical type. A row group is the work of one task, which holds a page and a batch of each
    wanted column. Lists become arrays, maps arrays of (key, value) structs in their order with repeated keys kept, maps
    without values arrays of keys; null, empty and filled containers stay apart.

    PERMISSIVE adds error_class and error_message: a row group that can't be read on has a row with these."""
    shape = Shape(nodes, wanted, compat, as_stored)
    own = shape.schema()
    schema = schema_of("file_path string, row_group int, record long")
    schema = T.StructType([*schema, *own, *(schema_of(FAULTS) if mode != "FAILFAST" else [])])
    arrow, paths = to_arrow_schema(schema), set(wanted)
    chunk = F.transform(F.filter("g.columns", lambda c: c["column_path"].isin(wanted)), lambda c: F.struct(*[c[k].alias(k) for k in _CHUNK]))
    rows = footers.select("file_path", "file_size", F.explode("row_groups").alias("g"))
    if groups is not None:
        rows = rows.where(F.col("g.row_group").isin(groups) if groups else F.lit(False))
    rows = rows.select("file_path", "file_size", F.col("g.row_group").alias("row_group"), F.col("g.row_count").alias("row_count"), chunk.alias("chunks"))

    def group(row: dict[str, Any]) -> Iterator[pa.RecordBatch]:
        with Ranges(row["file_path"], row["file_size"]) as ranges, reading(f"row group {row['row_group']}"):
            streams = {c["column_path"]: _Stream(ranges, c) for c in row["chunks"]}
            if set(streams) != paths:
                raise CorruptFile(f"no chunk of {', '.join(sorted(paths - set(streams)))}")
            done = 0
            while done < row["row_count"]:
                n = min(RECORDS, row["row_count"] - done, *(s.ready() for s in streams.values()))
                if not n:
                    raise CorruptFile(f"{done} of {row['row_count']} records in a row group")
                builder = _Builder(shape, {path: s.take(n) for path, s in streams.items()})
                found = [builder.build(node, 0, 0) for node in shape.top]
                if any(len(a) != n for a in found):
                    raise CorruptFile("columns of unequal numbers of records")
                place = [pa.repeat(pa.scalar(row["file_path"]), n), pa.repeat(pa.scalar(row["row_group"], pa.int32()), n), pa.array(range(done + 1, done + n + 1), pa.int64())]
                columns = [a.cast(f.type) for a, f in zip([*place, *found], arrow, strict=False)]
                columns += [pa.nulls(n, f.type) for f in list(arrow)[len(columns) :]]
                yield pa.RecordBatch.from_arrays(columns, schema=arrow)
                done += n

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for row in batch.to_pylist():
                try:
                    yield from group(row)
                except (ParquetError, OSError) as error:
                    if mode == "FAILFAST":
                        raise
                    told = {"file_path": row["file_path"], "row_group": row["row_group"]} | _fault(error)
                    yield pa.RecordBatch.from_pylist([{f.name: told.get(f.name) for f in arrow}], arrow)

    return dealt(rows, tasks).mapInArrow(run, schema)

