"""Assembly of records from level streams, and shredding."""

from __future__ import annotations

import pytest
from pyspark.sql import Row
from pyspark.sql import types as T

from pagescope.operators import nesting

REQUIRED, OPTIONAL, REPEATED = "REQUIRED", "OPTIONAL", "REPEATED"


def schema(*fields):
    """Nodes of nested (name, repetition, annotation, children) tuples; a leaf has no children."""
    nodes = []

    def add(name, repetition, annotation, children, parent, path):
        own = {"element_id": len(nodes), "parent_id": parent, "depth": len(path), "element_type": "root" if parent is None else "group" if children else "column", "name": name, "path": path, "full_path": ".".join(path), "repetition": repetition, "converted_type": annotation, "logical_type": None, "scale": None, "precision": None}
        nodes.append(own)
        for c in children:
            add(c[0], c[1], c[2] if len(c) > 2 else None, c[3] if len(c) > 3 else (), own["element_id"], [*path, c[0]])

    add("root", REQUIRED, None, fields, None, [])
    return nodes


def lst(name, element, repetition=OPTIONAL):
    return (name, repetition, "LIST", [("list", REPEATED, None, [element])])


def mp(name, *entries, repetition=OPTIONAL):
    return (name, repetition, "MAP", [("key_value", REPEATED, None, list(entries))])


def plain(v):
    if isinstance(v, Row):
        return tuple(plain(x) for x in v)
    return [plain(x) for x in v] if isinstance(v, list) else v


LEAF = ("element", OPTIONAL)
CASES = {
    "flat": (schema(("x", REQUIRED), ("y", OPTIONAL)), {"x": [(1, 0, 0), (2, 0, 0)], "y": [("a", 1, 0), (None, 0, 0)]}, {"x": [1, 2], "y": ["a", None]}),
    "list": (schema(lst("v", LEAF)), {"v.list.element": [(1, 3, 0), (None, 2, 1), (3, 3, 1), (None, 1, 0), (None, 0, 0)]}, {"v": [[1, None, 3], [], None]}),
    "lists of lists": (schema(lst("m", lst("element", LEAF))), {"m.list.element.list.element": [(1, 5, 0), (2, 5, 2), (3, 5, 1), (None, 2, 1), (None, 3, 1), (None, 1, 0)]}, {"m": [[[1, 2], [3], None, []], []]}),
    "repeated leaf": (schema(("r", REPEATED)), {"r": [(1, 1, 0), (2, 1, 1), (None, 0, 0)]}, {"r": [[1, 2], []]}),
    "repeated group": (schema(("p", OPTIONAL, None, [("q", REPEATED, None, [("n", REQUIRED), ("k", OPTIONAL)])])), {"p.q.n": [(None, 0, 0), (None, 1, 0), (5, 2, 0), (6, 2, 1)], "p.q.k": [(None, 0, 0), (None, 1, 0), ("a", 3, 0), (None, 2, 1)]}, {"p": [None, ([],), ([(5, "a"), (6, None)],)]}),
    "list of structs": (schema(lst("s", ("element", OPTIONAL, None, [("a", OPTIONAL), ("b", OPTIONAL)]))), {"s.list.element.a": [(1, 4, 0), (None, 2, 1), (None, 3, 1)], "s.list.element.b": [(None, 3, 0), (None, 2, 1), (2, 4, 1)]}, {"s": [[(1, None), None, (None, 2)]]}),
    "old list": (schema(("a", OPTIONAL, "LIST", [("array", REPEATED, "LIST", [("array", REPEATED)])])), {"a.array.array": [(1, 3, 0), (2, 3, 2), (3, 3, 1)]}, {"a": [[[1, 2], [3]]]}),
    "tuple list": (schema(("a", OPTIONAL, "LIST", [("a_tuple", REPEATED, None, [("x", REQUIRED)])])), {"a.a_tuple.x": [(1, 2, 0), (2, 2, 1)]}, {"a": [[(1,), (2,)]]}),
    "list of leaves": (schema(("a", OPTIONAL, "LIST", [("element", REPEATED)])), {"a.element": [(1, 2, 0), (2, 2, 1), (None, 0, 0)]}, {"a": [[1, 2], None]}),
    "map": (schema(mp("t", ("key", REQUIRED), ("value", OPTIONAL))), {"t.key_value.key": [("a", 2, 0), ("a", 2, 1), (None, 1, 0), (None, 0, 0)], "t.key_value.value": [(1, 3, 0), (None, 2, 1), (None, 1, 0), (None, 0, 0)]}, {"t": [[("a", 1), ("a", None)], [], None]}),
    "map of keys": (schema(mp("t", ("key", REQUIRED))), {"t.key_value.key": [("a", 2, 0), ("b", 2, 1)]}, {"t": [["a", "b"]]}),
    "map of lists": (schema(mp("t", ("key", REQUIRED), lst("value", LEAF))), {"t.key_value.key": [("a", 2, 0), ("b", 2, 1)], "t.key_value.value.list.element": [(1, 5, 0), (2, 5, 2), (3, 5, 1)]}, {"t": [[("a", [1, 2]), ("b", [3])]]}),
    "map by position": (schema(mp("t", ("name", REQUIRED), ("count", REQUIRED))), {"t.key_value.name": [("a", 2, 0)], "t.key_value.count": [(7, 2, 0)]}, {"t": [[("a", 7)]]}),
    "struct": (schema(("s", OPTIONAL, None, [("t", OPTIONAL, None, [("x", REQUIRED)])])), {"s.t.x": [(1, 2, 0), (None, 1, 0), (None, 0, 0)]}, {"s": [((1,),), (None,), None]}),
}


@pytest.mark.parametrize("name", CASES)
def test_assembly(spark, name):
    nodes, streams, want = CASES[name]
    frames = {}
    for path, entries in streams.items():
        kind = "string" if any(isinstance(v, str) for v, _, _ in entries) else "long"
        frames[path] = spark.createDataFrame([("f", 0, i, *e) for i, e in enumerate(entries, 1)], f"file_path string, row_group int, ord long, value {kind}, definition_level int, repetition_level int")
    rows = nesting.assemble(nodes, frames).orderBy("record").collect()
    assert {c: [plain(r[c]) for r in rows] for c in want} == want


def test_row_groups_are_apart(spark):
    nodes = schema(lst("v", LEAF))
    rows = [("f", g, i, g * 10 + i, 3, int(i > 1)) for g in range(3) for i in (1, 2)]
    frame = spark.createDataFrame(rows, "file_path string, row_group int, ord long, value long, definition_level int, repetition_level int")
    found = nesting.assemble(nodes, {"v.list.element": frame}).orderBy("row_group").collect()
    assert [r.v for r in found] == [[1, 2], [11, 12], [21, 22]]


def test_shredding_and_back(spark):
    kind = T.StructType().add("id", "long").add("x", T.ArrayType(T.StructType().add("a", "long").add("m", T.MapType(T.StringType(), T.ArrayType(T.LongType())))))
    rows = [(1, [(1, {"k": [1, None]}), None, (None, None)]), (2, []), (3, None), (4, [(5, {}), (6, {"l": []})])]
    df = spark.createDataFrame(rows, kind)
    streams = nesting.shred(df, "x", "id")
    assert set(streams) == {"x.list.element.a", "x.list.element.m.key_value.key", "x.list.element.m.key_value.value.list.element"}
    levels = [(r.id, r.definition_level, r.repetition_level, r.value) for r in streams["x.list.element.a"].orderBy("id", "place").collect()]
    assert levels == [(1, 4, 0, 1), (1, 2, 1, None), (1, 3, 1, None), (2, 1, 0, None), (3, 0, 0, None), (4, 4, 0, 5), (4, 4, 1, 6)]
    nodes = schema(lst("x", ("element", OPTIONAL, None, [("a", OPTIONAL), mp("m", ("key", REQUIRED), lst("value", LEAF))])))
    from pyspark.sql import Window as W
    from pyspark.sql import functions as F

    back = {p: s.withColumn("file_path", F.lit("f")).withColumn("row_group", F.lit(0)).withColumn("ord", F.row_number().over(W.orderBy("id", "place"))) for p, s in streams.items()}
    found = [plain(r.x) for r in nesting.assemble(nodes, back).orderBy("record").collect()]
    assert found == [[(1, [("k", [1, None])]), None, (None, None)], [], None, [(5, []), (6, [("l", [])])]]
