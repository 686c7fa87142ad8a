"""Records from leaf streams with levels, and back: Dremel's assembly and shredding as windows, groups and joins."""

from __future__ import annotations

from typing import Any

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql import Window as W

from ..errors import CorruptFile
from ..format.schema import effective_logical_type

#: What tells streams of different row groups apart.
KEYS = ("file_path", "row_group")


def kind_of(node: dict[str, Any]) -> str | None:
    """Name of a node's logical type."""
    logical = effective_logical_type(node)
    return logical["name"] if logical else None


def is_element(node: dict[str, Any], only: dict[str, Any]) -> bool:
    """Whether the repeated group of a list is the element itself: the format's rules for older files."""
    return kind_of(only) in ("LIST", "MAP") or only["name"] in ("array", f"{node['name']}_tuple")


def children_of(nodes: list[dict[str, Any]], leaves: set[str]) -> dict[int, list[dict[str, Any]]]:
    """Children by their parent's id, of nodes that are, or hold, one of these leaves."""
    found: dict[int, list[dict[str, Any]]] = {}
    for n in nodes:
        path = n["full_path"]
        wanted = path in leaves if n["element_type"] == "column" else any(p.startswith(path + ".") for p in leaves)
        if n["parent_id"] is not None and wanted:
            found.setdefault(n["parent_id"], []).append(n)
    return found


class _Assembly:
    """Frames of (keys, i, dl, rl, val): i numbers the instances of a node's surroundings at their repetition depth, the
    same for all that share them; dl and rl are those of an instance's first entry."""

    def __init__(self, nodes: list[dict[str, Any]], streams: dict[str, DataFrame], keys: tuple[str, ...]):
        self.nodes, self.streams, self.keys = nodes, streams, list(keys)
        self.children = children_of(nodes, set(streams))

    def _leaf(self, node: dict[str, Any]) -> DataFrame:
        levels = self.streams[node["full_path"]]
        value = F.when(F.col("definition_level") >= node["definition_level"], F.col("value"))
        return levels.select(*self.keys, F.col("ord").cast("long").alias("i"), F.col("definition_level").alias("dl"), F.col("repetition_level").alias("rl"), value.alias("val"))

    def _joined(self, children: list[dict[str, Any]], fields: list[str]) -> DataFrame:
        """Siblings side by side: val is a struct of theirs. Decoded streams look small to the engine, as footers are; a side
        that it broadcasts would pass through the driver."""
        first, *rest = [self.frame(c) for c in children]
        whole = first.withColumnRenamed("val", "v0")
        for n, other in enumerate(rest, 1):
            whole = whole.join(other.select(*self.keys, "i", F.col("val").alias(f"v{n}")).hint("merge"), [*self.keys, "i"])
        return whole.select(*self.keys, "i", "dl", "rl", F.struct(*[F.col(f"v{n}").alias(name) for n, name in enumerate(fields)]).alias("val"))

    def _lists(self, frame: DataFrame, depth: int, level: int) -> DataFrame:
        """One row for each list at repetition depth `depth`: val is the array of the elements, of entries that reach
        `level`. Elements are wrapped before they are collected, which keeps null ones."""
        started = frame.withColumn("n", F.sum((F.col("rl") < depth).cast("long")).over(W.partitionBy(*self.keys).orderBy("i").rowsBetween(W.unboundedPreceding, 0)))
        element = F.when(F.col("dl") >= level, F.struct("i", "val"))
        found = started.groupBy(*self.keys, "n").agg(F.min_by("dl", "i").alias("dl"), F.min_by("rl", "i").alias("rl"), F.sort_array(F.collect_list(element)).alias("xs"))
        return found.select(*self.keys, F.col("n").alias("i"), "dl", "rl", F.transform("xs", lambda x: x["val"]).alias("val"))

    def _inner(self, node: dict[str, Any]) -> DataFrame:
        """A node's own value, as if it were required and not repeated."""
        if node["element_type"] == "column":
            return self._leaf(node)
        children = self.children[node["element_id"]]
        kind, only = kind_of(node), children[0]
        if only["repetition"] == "REPEATED" and len(children) == 1 and kind in ("LIST", "MAP"):
            inside = self.children.get(only["element_id"], [])
            if kind == "MAP" and len(inside) > 1:
                whole = self._joined(inside, ["key", "value", *[c["name"] for c in inside[2:]]])
            elif kind == "MAP" and inside or len(inside) == 1 and not is_element(node, only):
                whole = self.frame(inside[0])
            else:
                whole = self._inner(only)
            return self._lists(whole, only["repetition_level"], only["definition_level"])
        return self._joined(children, [c["name"] for c in children])

    def frame(self, node: dict[str, Any]) -> DataFrame:
        found = self._inner(node)
        if node["repetition"] == "REPEATED":
            return self._lists(found, node["repetition_level"], node["definition_level"])
        if node["repetition"] == "OPTIONAL" and node["element_type"] == "group":
            return found.withColumn("val", F.when(F.col("dl") >= node["definition_level"], F.col("val")))
        return found

    def records(self) -> DataFrame:
        top = self.children.get(0, [])
        if not top:
            raise CorruptFile("no streams for any column of the schema")
        whole = self._joined(top, [n["name"] for n in top])
        return whole.select(*self.keys, F.col("i").alias("record"), "val.*")


def assemble(nodes: list[dict[str, Any]], streams: dict[str, DataFrame], keys: tuple[str, ...] = KEYS) -> DataFrame:
    """keys, record (from 1) and a column for each top-level field, of leaf streams by dotted path.

    A stream has the key columns, ord (from 1 in its key), value, definition_level and repetition_level. nodes: the
    schema, as rows of schema_elements; leaves without a stream are left out. Lists become arrays, maps arrays of
    (key, value) structs in their order with repeated keys kept, maps without values arrays of keys; null, empty and
    filled containers stay apart. Levels of groups follow from the repetitions, not from what a schema claims."""
    return _Assembly(releveled(nodes), streams, keys).records()


def releveled(nodes: list[dict[str, Any]]) -> list[dict[str, Any]]:
    by_id: dict[int, dict[str, Any]] = {}
    for n in nodes:
        up = by_id.get(n["parent_id"]) if n["parent_id"] is not None else None
        levels = (0, 0) if up is None else (up["definition_level"] + (n["repetition"] != "REQUIRED"), up["repetition_level"] + (n["repetition"] == "REPEATED"))
        by_id[n["element_id"]] = dict(n) | {"definition_level": levels[0], "repetition_level": levels[1]}
    return list(by_id.values())


def shred(df: DataFrame, column: str, key: str) -> dict[str, DataFrame]:
    """Leaf streams (key, place, value, definition_level, repetition_level) of a nested column, by dotted path with
    `list.element` and `key_value.key` steps; place orders a record's entries. Every level counts as optional, as
    Spark writes it."""
    out: dict[str, DataFrame] = {}

    def walk(rows: DataFrame, kind: T.DataType, path: str, depth: int) -> None:
        # rows: key, place, x, dl (levels reached so far), rl
        there = F.when(F.col("x").isNotNull() & (F.col("dl") == F.col("full")), F.col("dl") + 1).otherwise(F.col("dl"))
        rows = rows.withColumn("dl", there).withColumn("full", F.col("full") + 1)
        if isinstance(kind, T.StructType):
            for f in kind.fields:
                walk(rows.withColumn("x", F.col("x")[f.name]), f.dataType, f"{path}.{f.name}", depth)
        elif isinstance(kind, (T.ArrayType, T.MapType)):
            items = F.map_entries("x") if isinstance(kind, T.MapType) else F.col("x")
            other = [c for c in rows.columns if c != "x"]
            each = rows.select(*other, F.posexplode_outer(items).alias("pos", "y"))
            rl = F.when(F.coalesce("pos", F.lit(0)) > 0, F.lit(depth + 1)).otherwise(F.col("rl"))
            dl = F.when(F.col("pos").isNotNull(), F.col("dl") + 1).otherwise(F.col("dl"))
            each = each.withColumn("rl", rl).withColumn("dl", dl).withColumn("full", F.col("full") + 1).withColumn("place", F.concat("place", F.array(F.coalesce("pos", F.lit(0)))))
            if isinstance(kind, T.MapType):
                keyed = each.withColumn("x", F.col("y")["key"])  # keys are required
                out[f"{path}.key_value.key"] = keyed.select(key, "place", F.when(F.col("dl") == F.col("full"), F.col("x")).alias("value"), F.col("dl").alias("definition_level"), F.col("rl").alias("repetition_level"))
                walk(each.withColumn("x", F.col("y")["value"]).drop("y", "pos"), kind.valueType, f"{path}.key_value.value", depth + 1)
            else:
                walk(each.withColumnRenamed("y", "x").drop("pos"), kind.elementType, f"{path}.list.element", depth + 1)
        else:
            out[path] = rows.select(key, "place", F.col("x").alias("value"), F.col("dl").alias("definition_level"), F.col("rl").alias("repetition_level"))

    start = df.select(key, F.array().cast("array<int>").alias("place"), F.col(column).alias("x"), F.lit(0).alias("dl"), F.lit(0).alias("rl"), F.lit(0).alias("full"))
    walk(start, df.schema[column].dataType, column, 0)
    return out


def level_histogram(levels: DataFrame, *keys: str) -> DataFrame:
    return levels.groupBy(*keys, "repetition_level", "definition_level").agg(F.count("*").alias("n"))


def find_element(elements: DataFrame, path: str) -> DataFrame:
    """Schema rows of the element with this dotted path; the root's is empty."""
    return elements.where(F.col("full_path") == path)


def count_leaves(elements: DataFrame) -> DataFrame:
    return elements.where("element_type = 'column'").groupBy("file_path").agg(F.count("*").alias("leaf_columns"))


def unlinked(rows: DataFrame, elements: DataFrame) -> DataFrame:
    """Rows whose (file_path, column_path) names no leaf of the schema."""
    leaves = elements.where("element_type = 'column'").select("file_path", F.col("full_path").alias("column_path"))
    return rows.join(leaves, ["file_path", "column_path"], "left_anti")

