"""Filters: a JSON filter becomes one column expression.

``{"age": {"$gt": 25}, "name": "Ada"}``: fields are dot paths, all entries must hold.
Operators: $eq $ne $gt $gte $lt $lte $contains $in $exists on fields; $and $or $not.

A missing field fails every operator but ``$exists: false``, and $not is two-valued,
so every leaf is made never null.  Equality is strict about types: a number never
equals a string or a boolean; integers are compared exactly, other numbers as
doubles.  Order and $contains are for numbers and for strings only.
"""

from __future__ import annotations

import json
from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.json import Text, Typed

Source = Text | Typed


def _sure(c: Column) -> Column:
    return F.coalesce(c, F.lit(False))


def _equal(s: Source, field: str, v) -> Column:
    if v is None:
        return s.is_null(field)
    if isinstance(v, bool):
        return s.boolean(field) == F.lit(v)
    if isinstance(v, int):
        if not -(1 << 63) <= v < 1 << 63:
            return s.number(field) == F.lit(float(v))
        whole = s.integer(field) == F.lit(v).cast("bigint")
        if isinstance(s, Typed):
            return whole if s.is_integer(field) else s.number(field) == F.lit(float(v))
        return F.coalesce(whole, s.number(field) == F.lit(float(v)))
    if isinstance(v, float):
        return s.number(field) == F.lit(v)
    if isinstance(v, str):
        return s.string(field) == F.lit(v)
    return F.lit(False)  # lists and objects equal nothing


def _order(compare: Callable[[Column, Column], Column]):
    def build(s: Source, field: str, v) -> Column:
        if isinstance(v, bool) or not isinstance(v, int | float):
            return F.lit(False)
        return compare(s.number(field), F.lit(float(v)))

    return build


def _contains(s: Source, field: str, v) -> Column:
    return F.contains(s.string(field), F.lit(v)) if isinstance(v, str) else F.lit(False)


def _in(s: Source, field: str, v) -> Column:
    return reduce(lambda a, b: a | b, [_equal(s, field, x) for x in v], F.lit(False)) if isinstance(v, list) else F.lit(False)


#: Conditions that may be null where they don't hold.
OPERATORS: dict[str, Callable[[Source, str, object], Column]] = {
    "$eq": _equal,
    "$ne": lambda s, f, v: s.exists(f) & ~_sure(_equal(s, f, v)),
    "$gt": _order(lambda a, b: a > b),
    "$gte": _order(lambda a, b: a >= b),
    "$lt": _order(lambda a, b: a < b),
    "$lte": _order(lambda a, b: a <= b),
    "$contains": _contains,
    "$in": _in,
    "$exists": lambda s, f, v: s.exists(f) if v is not False else ~s.exists(f),
}


def compile_filter(query: dict | str, source: Source, sure: bool = True) -> Column:
    """The condition of a filter.

    Never null, unless ``sure`` is false: then what doesn't hold may be null, which is
    as good in a WHERE, and the plain comparisons can be pushed into a scan.
    """
    query = json.loads(query) if isinstance(query, str) else query
    if not isinstance(query, dict):
        raise ValueError("a filter is an object")
    final = _sure if sure else lambda c: c
    parts = []
    for key, value in query.items():
        if key in ("$and", "$or"):
            if not isinstance(value, list):
                raise ValueError(f"{key} takes a list")
            own = [compile_filter(q, source, sure) for q in value]
            parts.append(reduce(lambda a, b: a & b, own, F.lit(True)) if key == "$and" else reduce(lambda a, b: a | b, own, F.lit(False)))
        elif key == "$not":
            parts.append(~compile_filter(value, source))
        elif key.startswith("$"):
            raise ValueError(f"unknown operator {key}")
        elif isinstance(value, dict) and value and all(k.startswith("$") for k in value):
            for op, v in value.items():
                if op not in OPERATORS:
                    raise ValueError(f"unknown operator {op}")
                parts.append(final(OPERATORS[op](source, key, v)))
        else:
            parts.append(final(_equal(source, key, value)))
    return reduce(lambda a, b: a & b, parts, F.lit(True))


def where(df: DataFrame, query: dict | str, value: str | None = None) -> DataFrame:
    """The rows that pass: of the JSON text in column ``value``, or of the columns themselves."""
    return df.where(compile_filter(query, Text(df[value]) if value else Typed(df), sure=False))
