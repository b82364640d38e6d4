"""Declarative filters: {"op", "args" | "col", "value"} to a Column. Unknown operators and columns are errors, never "match all"."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

MAX_DEPTH, MAX_ARGS, MAX_IN = 6, 16, 512
_COMPARE = {"eq": "__eq__", "ne": "__ne__", "gt": "__gt__", "gte": "__ge__", "lt": "__lt__", "lte": "__le__"}


def build(spec: dict | None, columns: list[str], depth: int = 0) -> Column:
    """None is TRUE. A value {"ref": "self.<col>"} is the probing row's own column, named self_<col>. The root is at depth 0."""
    if spec is None:
        return F.lit(True)
    if depth > MAX_DEPTH:
        raise ValueError("filter is nested too deeply")
    op, args = spec.get("op"), spec.get("args", [])
    if op in ("and", "or"):
        if not 1 <= len(args) <= MAX_ARGS:
            raise ValueError(f"{op} takes 1 to {MAX_ARGS} arguments")
        parts = [build(a, columns, depth + 1) for a in args]
        return reduce((lambda a, b: a & b) if op == "and" else (lambda a, b: a | b), parts)
    if op == "not":
        if len(args) != 1:
            raise ValueError("not takes one argument")
        return ~build(args[0], columns, depth + 1)
    if spec.get("col") not in columns:
        raise ValueError(f"unknown column {spec.get('col')!r}")
    c, value = F.col(spec["col"]), spec.get("value")
    if op == "is_null":
        return c.isNull()
    if op == "not_null":
        return c.isNotNull()
    if op == "in":
        if not isinstance(value, list) or not 1 <= len(value) <= MAX_IN:
            raise ValueError("in takes 1 to 512 literals")
        return c.isin(value)
    if op == "between":
        if not isinstance(value, list) or len(value) != 2:
            raise ValueError("between takes two bounds")
        return c.between(*(_bound(v, columns) for v in value))
    if op not in _COMPARE:
        raise ValueError(f"unknown operator {op!r}")
    return getattr(c, _COMPARE[op])(_bound(value, columns))


def _bound(value, columns: list[str]):
    """A literal, or the probing row's own column."""
    if value is None:
        raise ValueError("a comparison needs a value")
    if not isinstance(value, dict):
        return value
    name = str(value.get("ref", ""))
    if not name.startswith("self.") or name[5:] not in columns:
        raise ValueError(f"unknown reference {value!r}")
    return F.col("self_" + name[5:])
