"""Types: mapping to Spark, the coercion lattice, equality.

Unsigned integers have no Spark type of their own. They are kept as the next wider signed type and marked in the field's
metadata (``unsigned``), so that the lattice can tell them apart; half floats are kept as float.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Names of primitive types and what holds them in Spark.
PRIMITIVES: dict[str, T.DataType] = {
    "Bool": T.BooleanType(),
    "I8": T.ByteType(),
    "I16": T.ShortType(),
    "I32": T.IntegerType(),
    "I64": T.LongType(),
    "U8": T.ShortType(),
    "U16": T.IntegerType(),
    "U32": T.LongType(),
    "U64": T.DecimalType(20, 0),
    "F16": T.FloatType(),
    "F32": T.FloatType(),
    "F64": T.DoubleType(),
    "Str": T.StringType(),
    "Timestamp": T.TimestampType(),
    "Null": T.NullType(),
}
SIGNED, UNSIGNED, FLOATS = ["I8", "I16", "I32", "I64"], ["U8", "U16", "U32", "U64"], ["F16", "F32", "F64"]
RANGES = {"I8": (-(2**7), 2**7 - 1), "I16": (-(2**15), 2**15 - 1), "I32": (-(2**31), 2**31 - 1), "I64": (-(2**63), 2**63 - 1), "U8": (0, 2**8 - 1), "U16": (0, 2**16 - 1), "U32": (0, 2**32 - 1), "U64": (0, 2**64 - 1)}


class CoercionError(TypeError):
    """Two types without a common one."""


class Kind:
    """A logical type: a primitive name, or List(item, nullable), Fixed(item, n), Group(fields), Map(key, value)."""

    def __init__(self, name: str, *args):
        self.name, self.args = name, args

    def __eq__(self, other) -> bool:
        return isinstance(other, Kind) and (self.name, self.args) == (other.name, other.args)

    def __hash__(self) -> int:
        return hash((self.name, self.args))

    def __repr__(self) -> str:
        return self.name + (f"({', '.join(map(repr, self.args))})" if self.args else "")

    def spark(self) -> T.DataType:
        if self.name == "List":
            return T.ArrayType(self.args[0].spark(), self.args[1])
        if self.name == "Fixed":
            return T.ArrayType(self.args[0].spark(), True)
        if self.name == "Group":
            return T.StructType([T.StructField(n, k.spark(), null) for n, k, null in self.args[0]])
        if self.name == "Map":
            return T.MapType(self.args[0].spark(), self.args[1].spark(), True)
        return PRIMITIVES[self.name]


def prim(name: str) -> Kind:
    return Kind(name)


def listed(item: Kind, nullable: bool = True) -> Kind:
    return Kind("List", item, nullable)


def fixed(item: Kind, n: int) -> Kind:
    return Kind("Fixed", item, n)


def group(*fields: tuple[str, Kind, bool]) -> Kind:
    return Kind("Group", tuple(fields))


def mapped(key: Kind, value: Kind) -> Kind:
    return Kind("Map", key, value)


def kind_of(dtype: T.DataType) -> Kind:
    """The logical type of a Spark type."""
    if isinstance(dtype, T.ArrayType):
        return listed(kind_of(dtype.elementType), dtype.containsNull)
    if isinstance(dtype, T.StructType):
        return group(*((f.name, kind_of(f.dataType), f.nullable) for f in dtype))
    if isinstance(dtype, T.MapType):
        return mapped(kind_of(dtype.keyType), kind_of(dtype.valueType))
    if isinstance(dtype, T.DecimalType):  # a decimal with a fraction, or wider than 64 bits, has no integer type here
        return prim("U64" if dtype.scale == 0 and dtype.precision <= 20 else "F64")
    if isinstance(dtype, T.BinaryType):
        return listed(prim("U8"), False)
    if isinstance(dtype, T.DateType | T.TimestampNTZType):
        return prim("Timestamp")
    names = {"boolean": "Bool", "tinyint": "I8", "smallint": "I16", "int": "I32", "bigint": "I64", "float": "F32", "double": "F64", "string": "Str", "timestamp": "Timestamp", "void": "Null"}
    return prim(names[dtype.simpleString()])


def coerce(a: Kind, b: Kind) -> Kind:
    """The common type. Null widens to anything; signed widens to signed, unsigned to unsigned, floats to floats; any
    integer with F64 is F64; nothing else mixes."""
    if a == b:
        return a
    if "Null" in (a.name, b.name):
        return b if a.name == "Null" else a
    for family in (SIGNED, UNSIGNED, FLOATS):
        if a.name in family and b.name in family:
            return prim(max(a.name, b.name, key=family.index))
    if {a.name, b.name} & {"F64"} and {a.name, b.name} & {*SIGNED, *UNSIGNED}:
        return prim("F64")
    if a.name == b.name == "List":
        return listed(coerce(a.args[0], b.args[0]), a.args[1] or b.args[1])
    if a.name == b.name == "Fixed":
        item = coerce(a.args[0], b.args[0])
        return fixed(item, a.args[1]) if a.args[1] == b.args[1] else listed(item)
    if {a.name, b.name} == {"Fixed", "List"}:
        return listed(coerce(a.args[0], b.args[0]))
    if a.name == b.name == "Group":
        left, right = ({n: k for n, k, _ in x.args[0]} for x in (a, b))
        merged = {n: coerce(left[n], right[n]) if n in left and n in right else left.get(n) or right[n] for n in {**left, **right}}
        return group(*((n, merged[n], True) for n in sorted(merged)))
    if a.name == b.name == "Map":
        return mapped(coerce(a.args[0], b.args[0]), coerce(a.args[1], b.args[1]))
    raise CoercionError(f"{a!r} and {b!r} have no common type")


def coerced_schema(a: T.StructType, b: T.StructType) -> T.StructType:
    return coerce(kind_of(a), kind_of(b)).spark()


def union(a, b):
    """Rows of both frames under the common schema; columns that one lacks are null there."""
    schema = coerced_schema(a.schema, b.schema)
    side = lambda df: df.select(*((F.col(f"`{f.name}`") if f.name in df.columns else F.lit(None)).cast(f.dataType).alias(f.name) for f in schema))
    return side(a).union(side(b))


def equals(a: Column, a_kind: Kind, b: Column, b_kind: Kind) -> Column:
    """Integers compare across widths, floats across widths, an integer never equals a float; timestamps by the second."""
    ints, floats = {*SIGNED, *UNSIGNED}, set(FLOATS)
    if a_kind.name in ints and b_kind.name in ints:
        return a.cast("decimal(20,0)").eqNullSafe(b.cast("decimal(20,0)"))
    if a_kind.name in floats and b_kind.name in floats:
        return a.cast("double").eqNullSafe(b.cast("double"))
    if a_kind.name == b_kind.name == "Timestamp":
        return F.date_trunc("SECOND", a).eqNullSafe(F.date_trunc("SECOND", b))
    return a.eqNullSafe(b) if a_kind == b_kind else F.lit(False)
