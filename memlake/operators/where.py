"""Compiles filter dictionaries to Columns.

Keys of a dictionary are joined by AND. ``$and`` / ``$or`` take non-empty lists. Comparisons follow SQL's three-valued
logic, so a row without the key is excluded by ``$ne`` and ``$nin`` too. A number compares numerically (text that is no
number gives null), a string as text, so ISO dates order rightly. Unknown operators raise; none is ever dropped.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

SCALARS = (str, int, float, bool)


class UnsupportedFilter(ValueError):
    """A filter that has no meaning here."""


class Metadata:
    """Where fields come from: promoted columns first, then a JSON object in a string column.

    Numbers meet promoted columns that *numeric* names in the column's own type, so such filters reach the scan and no
    digit is lost; everything else is compared through its text.
    """

    def __init__(self, promoted: dict[str, Column] | None = None, json: Column | None = None, numeric: frozenset[str] = frozenset()):
        self.promoted, self.json, self.numeric = promoted or {}, json, numeric

    def number(self, key: str) -> Column:
        return self.promoted[key] if key in self.numeric else self.text(key).try_cast("double")

    def text(self, key: str) -> Column:
        if key in self.promoted:
            return self.promoted[key].cast("string")
        return F.lit(None).cast("string") if self.json is None else F.element_at(self._map(), key)

    def present(self, key: str) -> Column:
        if key in self.promoted:
            return F.lit(True)
        return F.lit(False) if self.json is None else F.map_contains_key(self._map(), key)

    def truth(self, key: str) -> Column:
        """The value if it is a JSON boolean, else null; the string "true" is none."""
        if key in self.promoted or self.json is None:
            return self.text(key).try_cast("boolean")
        kind = F.schema_of_variant(F.try_variant_get(F.try_parse_json(self.json), f"$['{key}']", "variant"))
        return F.when(kind == "BOOLEAN", self.text(key) == "true")

    def _map(self) -> Column:
        return F.from_json(self.json, "map<string,string>")


def compile_where(where: dict | None, where_document: dict | None, fields: Metadata, document: Column) -> Column:
    parts = []
    if where:
        parts.append(_node(where, fields))
    elif where is not None and not isinstance(where, dict):
        raise UnsupportedFilter("where must be a dict")
    if where_document:
        parts.append(_document(where_document, document))
    return reduce(lambda a, b: a & b, parts) if parts else F.lit(True)


def _node(node: dict, fields: Metadata) -> Column:
    if not isinstance(node, dict) or not node:
        raise UnsupportedFilter("a filter must be a dict with entries")
    parts = []
    for key, value in node.items():
        if key in ("$and", "$or"):
            parts.append(_logical(key, value, lambda n: _node(n, fields)))
        elif str(key).startswith("$"):
            raise UnsupportedFilter(f"operator {key} at the level of fields")
        else:
            parts.append(_field(_checked(key), value, fields))
    return reduce(lambda a, b: a & b, parts)


def _logical(op: str, value: object, compiled) -> Column:
    if not isinstance(value, list) or not value:
        raise UnsupportedFilter(f"{op} takes a non-empty list")
    return reduce((lambda a, b: a & b) if op == "$and" else (lambda a, b: a | b), [compiled(v) for v in value])


def _checked(key: object) -> str:
    if not isinstance(key, str) or not key or any(c in key for c in "\0'\"\\"):
        raise UnsupportedFilter(f"bad field name {key!r}")
    return key


def _field(key: str, value: object, fields: Metadata) -> Column:
    if not isinstance(value, dict):
        return _equal(key, value, fields, False)
    if not value:
        raise UnsupportedFilter(f"no operator for {key}")
    return reduce(lambda a, b: a & b, [_operator(key, op, rhs, fields) for op, rhs in value.items()])


def _operator(key: str, op: str, rhs: object, fields: Metadata) -> Column:
    if op in ("$eq", "$ne"):
        return _equal(key, rhs, fields, op == "$ne")
    if op in ("$in", "$nin"):
        return _in(key, rhs, fields, op == "$nin")
    if op in ("$gt", "$gte", "$lt", "$lte"):
        if isinstance(rhs, bool) or not isinstance(rhs, (str, int, float)):
            raise UnsupportedFilter(f"{op} takes a string or a number")
        left = fields.text(key) if isinstance(rhs, str) else fields.number(key)
        return {"$gt": left > rhs, "$gte": left >= rhs, "$lt": left < rhs, "$lte": left <= rhs}[op]
    raise UnsupportedFilter(f"unknown operator {op}")


def _equal(key: str, rhs: object, fields: Metadata, negated: bool) -> Column:
    if rhs is None:
        absent = fields.text(key).isNull()
        return fields.present(key) & (~absent if negated else absent)
    if not isinstance(rhs, SCALARS):
        raise UnsupportedFilter(f"{key} compared with {type(rhs).__name__}")
    if isinstance(rhs, bool):
        left = fields.truth(key)
    else:
        left = fields.text(key) if isinstance(rhs, str) else fields.number(key)
    return left != rhs if negated else left == rhs


def _in(key: str, rhs: object, fields: Metadata, negated: bool) -> Column:
    if not isinstance(rhs, list) or not rhs or any(v is None or not isinstance(v, SCALARS) for v in rhs):
        raise UnsupportedFilter("$in and $nin take a non-empty list of scalars")
    if all(isinstance(v, (int, float)) and not isinstance(v, bool) for v in rhs):
        found = fields.number(key).isin(rhs)
    else:
        found = fields.text(key).isin([str(v).lower() if isinstance(v, bool) else str(v) for v in rhs])
    return ~found if negated else found


def _document(node: dict, document: Column) -> Column:
    if not isinstance(node, dict) or not node:
        raise UnsupportedFilter("where_document must be a dict with entries")
    parts = []
    for key, value in node.items():
        if key in ("$and", "$or"):
            parts.append(_logical(key, value, lambda n: _document(n, document)))
        elif key == "$contains":
            if not isinstance(value, str) or not value:
                raise UnsupportedFilter("$contains takes a non-empty string")
            parts.append(F.contains(document, F.lit(value)))
        else:
            raise UnsupportedFilter(f"unknown operator {key}")
    return reduce(lambda a, b: a & b, parts)


def wing_room(wing: str | None = None, room: str | None = None) -> dict:
    """Filter for a wing and a room, either or none."""
    pairs = [{k: v} for k, v in (("wing", wing), ("room", room)) if v]
    return {"$and": pairs} if len(pairs) == 2 else pairs[0] if pairs else {}
