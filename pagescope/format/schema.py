"""Schema trees from the flat list in a footer: paths, levels, logical types."""

from __future__ import annotations

from typing import Any

from ..errors import CorruptFile
from .records import CONVERTED_TYPES, EDGE_ALGORITHMS, PHYSICAL_TYPES, REPETITIONS, named

LOGICAL_FIELDS = ("name", "bit_width", "is_signed", "scale", "precision", "unit", "is_adjusted_to_utc", "algorithm")
#: Logical types that converted types stand for: name and parameters. Fixed values.
_OF_CONVERTED: dict[str, dict[str, Any]] = {
    "UTF8": {"name": "STRING"}, "MAP": {"name": "MAP"}, "MAP_KEY_VALUE": {"name": "MAP"}, "LIST": {"name": "LIST"}, "ENUM": {"name": "ENUM"}, "DATE": {"name": "DATE"}, "JSON": {"name": "JSON"}, "BSON": {"name": "BSON"},
    "TIME_MILLIS": {"name": "TIME", "unit": "MILLIS", "is_adjusted_to_utc": True}, "TIME_MICROS": {"name": "TIME", "unit": "MICROS", "is_adjusted_to_utc": True},
    "TIMESTAMP_MILLIS": {"name": "TIMESTAMP", "unit": "MILLIS", "is_adjusted_to_utc": True}, "TIMESTAMP_MICROS": {"name": "TIMESTAMP", "unit": "MICROS", "is_adjusted_to_utc": True},
}


def _only(union: dict[str, Any], what: str) -> str:
    """Name of the field that a union has set; the first of several."""
    for name, value in union.items():
        if value is not None and not name.startswith("_"):
            return name
    raise CorruptFile(f"a {what} of no known kind")


def logical_type(element: dict[str, Any]) -> dict[str, Any] | None:
    """The annotation as one flat record; None where there is none or an unknown one."""
    union = element["logical_type"]
    if union is None:
        return None
    try:
        name = _only(union, "logical type")
    except CorruptFile:
        return None
    own = union[name]
    found = dict.fromkeys(LOGICAL_FIELDS)
    found["name"] = name
    for key in ("bit_width", "is_signed", "scale", "precision", "is_adjusted_to_utc"):
        if own.get(key) is not None:
            found[key] = own[key]
    if own.get("unit") is not None:
        found["unit"] = _only(own["unit"], "time unit")
    if name == "GEOGRAPHY":
        found["algorithm"] = named(EDGE_ALGORITHMS, own["algorithm"] or 0, "edge algorithm")
    return found


def effective_logical_type(node: dict[str, Any]) -> dict[str, Any] | None:
    """The logical type, or else what the converted type stands for."""
    if node["logical_type"] is not None:
        return node["logical_type"]
    converted = node["converted_type"]
    if converted is None:
        return None
    found = dict.fromkeys(LOGICAL_FIELDS)
    if converted == "DECIMAL":
        return found | {"name": "DECIMAL", "scale": node["scale"] or 0, "precision": 10 if node["precision"] is None else node["precision"]}
    if converted.startswith(("INT_", "UINT_")):
        return found | {"name": "INTEGER", "bit_width": int(converted.rpartition("_")[2]), "is_signed": converted.startswith("INT_")}
    return found | _OF_CONVERTED[converted] if converted in _OF_CONVERTED else None


def tree(elements: list[dict[str, Any]]) -> list[dict[str, Any]]:
    """The elements in file order as nodes: ids, parents, depth, kind, path, levels, types."""
    if not elements:
        raise CorruptFile("a schema without a root")
    nodes: list[dict[str, Any]] = []
    open_groups: list[list[int]] = []  # [node, children still to come]
    for i, e in enumerate(elements):
        while open_groups and not open_groups[-1][1]:
            open_groups.pop()
        if bool(open_groups) != (i > 0):
            raise CorruptFile("the schema's numbers of children don't add up")
        parent = nodes[open_groups[-1][0]] if open_groups else None
        repetition = named(REPETITIONS, e["repetition_type"], "repetition") or "REQUIRED"
        physical = named(PHYSICAL_TYPES, e["type"], "physical type")
        group = physical is None
        if group and parent is not None and e["num_children"] is None:
            raise CorruptFile(f"element {e['name']} has neither a type nor children")
        definition = repeated = 0
        if parent is not None:
            open_groups[-1][1] -= 1
            definition = parent["definition_level"] + (repetition != "REQUIRED")
            repeated = parent["repetition_level"] + (repetition == "REPEATED")
        path = [*parent["path"], e["name"]] if parent is not None else []
        node = {
            "element_id": i, "parent_id": parent["element_id"] if parent else None, "depth": len(path), "element_type": "root" if parent is None else "group" if group else "column",
            "name": e["name"], "path": path, "full_path": ".".join(path), "type": physical, "type_length": e["type_length"], "repetition": repetition, "num_children": e["num_children"] if group else None,
            "converted_type": named(CONVERTED_TYPES, e["converted_type"], "converted type"), "scale": e["scale"], "precision": e["precision"], "field_id": e["field_id"], "logical_type": logical_type(e),
            "definition_level": definition, "repetition_level": repeated, "start_offset": e["_start"], "byte_length": e["_length"],
        }
        node["list_semantics"] = None
        nodes.append(node)
        if group and e["num_children"]:
            open_groups.append([i, e["num_children"]])
    if any(left for _, left in open_groups):
        raise CorruptFile("the schema ends before its groups do")
    by_id = {n["element_id"]: n for n in nodes}
    for node in nodes:
        if node["element_type"] == "column" and node["repetition_level"]:
            node["list_semantics"] = _list_semantics(node, by_id)
    return nodes


def _list_semantics(leaf: dict[str, Any], by_id: dict[int, dict[str, Any]]) -> str | None:
    """MODERN_LIST below a group annotated as a list, else LEGACY_REPEATED below a repeated group, else None."""
    above, node = [], leaf
    while node["parent_id"] is not None:
        node = by_id[node["parent_id"]]
        above.append(node)
    if any((kind := effective_logical_type(n)) and kind["name"] == "LIST" for n in above):
        return "MODERN_LIST"
    return "LEGACY_REPEATED" if any(n["repetition"] == "REPEATED" for n in above) else None


def leaves(nodes: list[dict[str, Any]]) -> list[dict[str, Any]]:
    return [n for n in nodes if n["element_type"] == "column"]
