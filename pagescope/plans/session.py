"""All relations over a set of files, made when they are asked for."""

from __future__ import annotations

from functools import cached_property
from typing import Any

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..errors import Unsupported
from ..operators import metrics
from ..operators import relations as R
from ..operators.records import read_records
from ..operators.values import column_kind, column_values
from ..sources import dumps, listing

RELATIONS = ("files", "key_values", "schema_elements", "row_groups", "column_chunks", "encoding_stats", "pages", "offset_index", "column_index", "bloom_filters")


class Lens:
    """Parquet files under paths, or JSON dumps of such files, as relations.

    columns and row_groups restrict what relations below footers read. mode is FAILFAST or PERMISSIVE: then what can't be
    read is a row with error_class and error_message, in every relation. Footers are read once if `persist` is set: they
    are small beside the files. from_dumps: None looks at the first bytes of one of the files."""

    def __init__(self, spark: SparkSession, paths: str | list[str], columns: list[str] | None = None, row_groups: list[int] | None = None, mode: str = "FAILFAST", persist: bool = False, from_dumps: bool | None = False):
        self.spark, self.paths, self.columns, self.groups, self.mode, self.persist = spark, paths, columns, row_groups, mode, persist
        self.from_dumps = dumps.holds_dumps(spark, paths) if from_dumps is None else from_dumps

    @cached_property
    def listed(self) -> DataFrame:
        return listing.listed(self.spark, self.paths)

    @cached_property
    def tasks(self) -> int:
        """Tasks of stages that read what the files hold; the listing tells how much that can be."""
        size = self.listed.agg(F.coalesce(F.sum("file_size"), F.lit(0))).first()[0]
        return R.tasks_for(self.spark, size)

    @cached_property
    def dumps(self) -> DataFrame:
        return dumps.read_dumps(self.spark, self.paths)

    @cached_property
    def footers(self) -> DataFrame:
        found = dumps.restore(self.dumps, self.mode) if self.from_dumps else R.footers(self.spark, self.listed, self.columns, self.mode)
        return found.persist() if self.persist else found

    def footers_of(self, columns: list[str]) -> DataFrame:
        """Footers with chunks of these columns only, the others' passed over while they are read."""
        return self.footers if self.persist or self.from_dumps else R.footers(self.spark, self.listed, columns, self.mode)

    @cached_property
    def chunks(self) -> DataFrame:
        return R.column_chunks(self.footers).where(R.chunk_filter(self.columns, self.groups))

    def pages(self, **options: bool) -> DataFrame:
        return dumps.restore_pages(self.dumps, self.mode) if self.from_dumps else R.pages(self.chunks, mode=self.mode, tasks=self.tasks, **options)

    def values(self, column: str, kind: tuple[str, dict[str, Any] | None] | None = None, **options: bool) -> DataFrame:
        """Typed values of a column; kind (physical and logical type) saves a look at the footers where it is known."""
        own = R.column_chunks(self.footers_of([column])).where(R.chunk_filter([column], self.groups))
        found = R.pages(own, mode=self.mode, tasks=self.tasks)
        return column_values(found, kind or column_kind(own), mode=self.mode, tasks=self.tasks, **options)

    def schema_nodes(self) -> list[dict[str, Any]]:
        """The schema that all files have, as rows of schema_elements: one file's come to the driver."""
        shape = F.transform("schema_elements", lambda e: F.struct(*[e[c] for c in ("element_id", "full_path", "type", "repetition", "converted_type")]))
        kinds = self.footers_of([]).where("schema_elements is not null").select(F.xxhash64(shape).alias("shape"), "schema_elements")
        found = kinds.groupBy("shape").agg(F.any_value("schema_elements").alias("nodes")).limit(2).collect()
        if len(found) != 1:
            raise Unsupported(f"{'no files' if not found else 'files of several schemas'}: one schema is needed")
        return [n.asDict(recursive=True) for n in found[0]["nodes"]]

    def records(self, columns: list[str] | None = None, compat: bool = False, as_stored: list[str] | None = None) -> DataFrame:
        """file_path, row_group, record and the top-level fields, decoded and assembled here: for files that the native
        scan refuses, and to see values as they are stored. columns: dotted paths of leaves, or of what holds them;
        as_stored: likewise, where logical types are left out. All files must have one schema."""
        nodes = self.schema_nodes()
        under = lambda n, asked: any(n["full_path"] == c or n["full_path"].startswith(c + ".") for c in asked)
        leaves = [n for n in nodes if n["element_type"] == "column"]
        columns = self.columns if columns is None else columns
        wanted = [n["full_path"] for n in leaves if columns is None or under(n, columns)]
        if len(set(wanted)) < len(wanted):
            raise Unsupported("columns of equal dotted paths")
        if not wanted:
            raise Unsupported(f"no column is, or is in, one of {columns}")
        stored = tuple(n["full_path"] for n in leaves if under(n, as_stored or []))
        return read_records(self.footers_of(wanted), nodes, wanted, self.groups, compat, stored, self.mode, self.tasks)

    def dump(self, metadata_only: bool = False) -> DataFrame:
        return dumps.dump(self.listed, metadata_only, self.mode)

    def relation(self, name: str) -> DataFrame:
        if name == "pages":
            return self.pages()
        if name == "column_chunks":
            return self.chunks
        if name in ("files", "key_values", "schema_elements", "row_groups"):
            return getattr(R, name)(self.footers)
        if name == "encoding_stats":
            return R.encoding_stats(self.chunks)
        if name in RELATIONS:
            return getattr(R, name)(self.chunks, mode=self.mode)
        raise KeyError(name)

    def register(self, prefix: str = "parquet_") -> list[str]:
        """Temporary views of all relations, for spark.sql; their names."""
        for name in RELATIONS:
            self.relation(name).createOrReplaceTempView(prefix + name)
        return [prefix + name for name in RELATIONS]

    def compression(self, *by: str) -> DataFrame:
        return metrics.compression(self.chunks, *by)
