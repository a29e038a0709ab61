"""Schema inference from values and rows."""

from __future__ import annotations

import datetime as dt
from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.types import CoercionError, Kind, coerce, group, kind_of, listed, mapped, prim


def value_kind(value: object) -> Kind:
    """The logical type of a Python value. A list whose values have no common type keeps the first one's."""
    if value is None:
        return prim("Null")
    if isinstance(value, bool):
        return prim("Bool")
    if isinstance(value, int):
        return prim("I64" if value < 1 << 63 else "U64")
    if isinstance(value, float):
        return prim("F64")
    if isinstance(value, str):
        return prim("Str")
    if isinstance(value, dt.datetime | dt.date):
        return prim("Timestamp")
    if isinstance(value, bytes | bytearray):
        return listed(prim("U8"), False)
    if isinstance(value, dict):
        return group(*((str(k), value_kind(v), True) for k, v in value.items()))
    if isinstance(value, list | tuple):
        kinds, nullable = [value_kind(v) for v in value if v is not None], any(v is None for v in value)
        item = kinds[0] if kinds else prim("Null")
        for k in kinds[1:]:
            try:
                item = coerce(item, k)
            except CoercionError:
                break
        return listed(item, nullable)
    raise TypeError(f"no type for {type(value).__name__}")


def map_kind(value: dict) -> Kind:
    """A dict as a map; an empty one has text keys."""
    keys, values = [value_kind(k) for k in value], [value_kind(v) for v in value.values()]
    return mapped(reduce(coerce, keys) if keys else prim("Str"), reduce(coerce, values) if values else prim("Null"))


def row_schema(row: dict) -> Kind:
    """One row: key order kept, all nullable."""
    return value_kind(row)


def infer_schema(rows: list[dict]) -> Kind:
    """Many rows: columns sorted by name; nullable if null or missing anywhere; types merged by the lattice."""
    seen: dict[str, list[Kind]] = {}
    for r in rows:
        for k, v in r.items():
            seen.setdefault(k, []).append(value_kind(v))
    return group(*((n, reduce(coerce, seen[n]), len(seen[n]) < len(rows) or any(k.name == "Null" for k in seen[n])) for n in sorted(seen)))


def infer_json(df: DataFrame, column: str) -> Kind:
    """The common type of a column of JSON texts, merged on the executors; the driver gets one type. Fields are in order of name."""
    made = df.select(F.schema_of_variant_agg(F.try_parse_json(F.col(f"`{column}`")))).first()[0]
    return kind_of(T._parse_datatype_string(made.replace("OBJECT<", "STRUCT<")))
