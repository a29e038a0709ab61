"""Repair and coercion: columns cast to a declared type with an error column, as Spark expressions.

``repair`` follows strict rules: text is parsed only if it is a plain number or a known boolean word, without trimming;
integers that don't fit are errors; floats become integers by truncation and saturation (NaN: 0). Null passes through.
``mode="coerce"`` accepts any number as boolean. Each result is a struct (value, error); error names what went wrong.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.types import FLOATS, RANGES, SIGNED, UNSIGNED, Kind, kind_of

# Boolean words, in any case.
TRUE_WORDS, FALSE_WORDS = ["true", "1", "yes"], ["false", "0", "no"]
INTEGER = r"^[+-]?[0-9]+$"
NUMBER = r"^[+-]?([0-9]+\.?[0-9]*|\.[0-9]+)([eE][+-]?[0-9]+)?$|^[+-]?([iI][nN][fF]([iI][nN][iI][tT][yY])?|[nN][aA][nN])$"


def _out(value: Column, error: Column | None = None) -> Column:
    return F.struct(value.alias("value"), (F.lit(None).cast("string") if error is None else error).alias("error"))


def _fail(message: str) -> Column:
    return F.lit(message)


def _to_int(c: Column, have: Kind, want: Kind) -> Column:
    low, high = RANGES[want.name]
    kind = want.spark()
    if have.name == "Str":
        wide = F.when(c.rlike(INTEGER if want.name in SIGNED else r"^\+?[0-9]+$"), c.try_cast("decimal(38,0)"))
        fits = wide.isNotNull() & wide.between(F.lit(str(low)).cast("decimal(20,0)"), F.lit(str(high)).cast("decimal(20,0)"))
        return _out(F.when(fits, wide.cast(kind)), F.when(c.isNotNull() & ~F.coalesce(fits, F.lit(False)), _fail("Parse")))
    if have.name == "Bool":
        return _out(c.cast("int").cast(kind))
    if have.name in {*SIGNED, *UNSIGNED}:
        wide = c.cast("decimal(20,0)")
        fits = wide.between(F.lit(str(low)).cast("decimal(20,0)"), F.lit(str(high)).cast("decimal(20,0)"))
        return _out(F.when(fits, wide.cast(kind)), F.when(c.isNotNull() & ~fits, _fail("OutOfBounds")))
    if have.name in FLOATS:
        d = c.cast("double")
        cut = F.when(F.isnan(d), F.lit(0).cast(kind)).when(d >= float(high), F.lit(str(high)).cast("decimal(20,0)").cast(kind)).when(d <= float(low), F.lit(str(low)).cast("decimal(20,0)").cast(kind))
        return _out(F.when(c.isNotNull(), cut.otherwise(d.try_cast("decimal(38,10)").cast("decimal(20,0)").cast(kind) if want.name == "U64" else d.try_cast("bigint").cast(kind))))
    return _out(F.lit(None).cast(kind), F.when(c.isNotNull(), _fail("Cast")))


def _to_float(c: Column, have: Kind, want: Kind) -> Column:
    kind = want.spark()
    if have.name == "Str":
        ok = c.rlike(NUMBER)
        return _out(F.when(ok, c.try_cast(kind)), F.when(c.isNotNull() & ~ok, _fail("Parse")))
    if have.name == "Bool":
        return _out(c.cast("int").cast(kind))
    if have.name in {*SIGNED, *UNSIGNED, *FLOATS}:
        return _out(c.cast(kind))
    return _out(F.lit(None).cast(kind), F.when(c.isNotNull(), _fail("Cast")))


def _to_bool(c: Column, have: Kind, mode: str) -> Column:
    if have.name == "Str":
        word = F.lower(c)
        return _out(F.when(word.isin(TRUE_WORDS), True).when(word.isin(FALSE_WORDS), False), F.when(c.isNotNull() & ~word.isin(TRUE_WORDS + FALSE_WORDS), _fail("Parse")))
    if have.name in ({"I8", "I32", "I64"} if mode == "repair" else {*SIGNED, *UNSIGNED, *FLOATS}):
        return _out(c != 0)
    return _out(F.lit(None).cast("boolean"), F.when(c.isNotNull(), _fail("Cast")))


def display(c: Column, have: Kind) -> Column:
    """Numbers as text without exponent or superfluous `.0`."""
    if have.name in FLOATS:
        d = c.cast("double")
        whole = (d == F.floor(d)) & (F.abs(d) < 1e15)
        return F.when(F.isnan(d), "NaN").when(d == float("inf"), "inf").when(d == float("-inf"), "-inf").when(whole, d.try_cast("bigint").cast("string")).otherwise(F.regexp_replace(c.try_cast("decimal(38,18)").cast("string"), r"0+$", "") if have.name == "F64" else c.cast("string"))
    return c.cast("string")


def _to_str(c: Column, have: Kind) -> Column:
    if have.name == "Bool" or have.name in {*SIGNED, *UNSIGNED, *FLOATS}:
        return _out(display(c, have))
    return _out(F.lit(None).cast("string"), F.when(c.isNotNull(), _fail("Cast")))


def repair(c: Column, have: Kind, want: Kind, mode: str = "repair") -> Column:
    """(value, error) of ``c`` as ``want``."""
    if have.name == "Null":
        return _out(F.lit(None).cast(want.spark()))
    if want.name in ("List", "Fixed"):
        return _to_list(c, have, want, mode)
    if have == want:
        return _out(c)
    if want.name in {*SIGNED, *UNSIGNED}:
        return _to_int(c, have, want)
    if want.name in FLOATS:
        return _to_float(c, have, want)
    if want.name == "Bool":
        return _to_bool(c, have, mode)
    if want.name == "Str":
        return _to_str(c, have)
    if want.name == "Group" and have.name == "Group":
        return _to_group(c, have, want, mode)
    if want.name == "Map" and have.name == "Map":
        keys = F.transform(F.map_keys(c), lambda k: repair(k, have.args[0], want.args[0], mode))
        values = F.transform(F.map_values(c), lambda v: repair(v, have.args[1], want.args[1], mode))
        bad = F.coalesce(F.get(F.filter(F.concat(F.transform(keys, lambda x: x["error"]), F.transform(values, lambda x: x["error"])), lambda e: e.isNotNull()), F.lit(0)), F.lit(None))
        return _out(F.when(bad.isNull(), F.map_from_arrays(F.transform(keys, lambda x: x["value"]), F.transform(values, lambda x: x["value"]))), bad)
    return _out(F.lit(None).cast(want.spark()), F.when(c.isNotNull(), _fail("Cast")))


def _to_list(c: Column, have: Kind, want: Kind, mode: str) -> Column:
    """Elements are repaired, a scalar becomes a list of one, nulls are dropped from lists of primitives, a fixed length is checked."""
    item = want.args[0]
    if have.name in ("List", "Fixed"):
        each = F.transform(c, lambda x: repair(x, have.args[0], item, mode))
    else:
        each = F.when(c.isNotNull(), F.array(repair(c, have, item, mode)))
    error = F.get(F.transform(F.filter(each, lambda x: x["error"].isNotNull()), lambda x: x["error"]), F.lit(0))
    values = F.transform(each, lambda x: x["value"])
    if item.name not in ("List", "Fixed", "Group", "Map"):
        values = F.filter(values, lambda x: x.isNotNull())
    if want.name == "Fixed":
        error = F.coalesce(error, F.when(F.size(values) != want.args[1], F.lit("Length")))
    return _out(F.when(error.isNull(), values), F.when(c.isNotNull(), error))


def _to_group(c: Column, have: Kind, want: Kind, mode: str) -> Column:
    fields = {n: k for n, k, _ in have.args[0]}
    made = {n: repair(c[n], fields[n], k, mode) if n in fields else _out(F.lit(None).cast(k.spark()), None if null else F.lit("Missing")) for n, k, null in want.args[0]}
    error = F.coalesce(*(F.when(x["error"].isNotNull(), F.concat(F.lit(f"{n}: "), x["error"])) for n, x in made.items()))
    return _out(F.when(c.isNotNull() & error.isNull(), F.struct(*(x["value"].alias(n) for n, x in made.items()))), F.when(c.isNotNull(), error))


def project(df: DataFrame, want: Kind) -> DataFrame:
    """Reorder and keep the wanted columns; missing ones are null; recursive in groups; a group against a scalar is an error."""

    def shape(c: Column | None, have: Kind | None, kind: Kind) -> Column:
        if c is None or have is None or have.name == "Null":
            return F.lit(None).cast(kind.spark())
        if (have.name == "Group") != (kind.name == "Group"):
            raise TypeError("a group can't be projected to a scalar, nor a scalar to a group")
        if kind.name != "Group":
            return c
        fields = {n: k for n, k, _ in have.args[0]}
        return F.when(c.isNotNull(), F.struct(*(shape(c[n] if n in fields else None, fields.get(n), k).alias(n) for n, k, _ in kind.args[0])))

    fields = {f.name: kind_of(f.dataType) for f in df.schema}
    return df.select(*(shape(F.col(f"`{n}`") if n in fields else None, fields.get(n), k).alias(n) for n, k, _ in want.args[0]))


def project_repair(df: DataFrame, want: Kind, mode: str = "repair", error: str = "_error") -> DataFrame:
    """Repaired columns and a column that names the first error, null if the row is whole. All in one projection."""
    fields = {f.name: kind_of(f.dataType) for f in df.schema}
    made = []
    for n, k, null in want.args[0]:
        made.append((n, repair(F.col(f"`{n}`"), fields[n], k, mode) if n in fields else _out(F.lit(None).cast(k.spark()), None if null else F.lit("Missing"))))
    stage = df.select(*(x.alias(n) for n, x in made))
    first = F.coalesce(*(F.when(F.col(f"`{n}`.error").isNotNull(), F.concat(F.lit(f"{n}: "), F.col(f"`{n}`.error"))) for n, _ in made))
    return stage.select(*(F.col(f"`{n}`.value").alias(n) for n, _ in made), first.alias(error))


def deep_get(df: DataFrame, path: str) -> Column:
    """The field at a dotted path through groups; null where the path is blocked."""
    kind, c = kind_of(df.schema), None
    for part in path.split("."):
        fields = {n: k for n, k, _ in kind.args[0]} if kind.name == "Group" else {}
        if part not in fields:
            return F.lit(None)
        c, kind = F.col(f"`{part}`") if c is None else c[part], fields[part]
    return c


def extend(a: DataFrame, *columns: Column, names: list[str]) -> DataFrame:
    """Disjoint merge of columns; an overlap is an error."""
    if clash := {n.lower() for n in names} & {c.lower() for c in a.columns}:
        raise ValueError(f"columns exist already: {sorted(clash)}")
    return a.select("*", *(c.alias(n) for c, n in zip(columns, names, strict=True)))


def put(df: DataFrame, name: str, column: Column) -> DataFrame:
    """A column inserted at the end, or replaced where it is."""
    have = {c.lower(): c for c in df.columns}
    if name.lower() not in have:
        return df.select("*", column.alias(name))
    return df.select(*(column.alias(c) if c == have[name.lower()] else F.col(f"`{c}`") for c in df.columns))


def is_null(df: DataFrame, path: str) -> Column:
    """Whether the field at a dotted path is null, or can't be reached."""
    return deep_get(df, path).isNull()


def integers(c: Column, item: Kind, force: bool = False) -> Column:
    """A list's numbers as wide integers. Other items are left out; if forced, floats are truncated, and what can't be a number is null."""
    wide = "decimal(20,0)"
    if item.name in {*SIGNED, *UNSIGNED}:
        return F.transform(c, lambda x: x.cast(wide))
    if not force:
        return F.filter(F.transform(c, lambda x: F.lit(None).cast(wide)), lambda x: x.isNotNull())
    if item.name in FLOATS:
        whole = lambda x: F.when(x < 0, F.ceil(x)).otherwise(F.floor(x))
        return F.transform(c, lambda x: F.when(~F.isnan(x), whole(x.cast("double"))).try_cast(wide))
    return F.transform(c, lambda x: x.cast("int").cast(wide) if item.name == "Bool" else x.try_cast(wide))


def floats(c: Column, item: Kind, force: bool = False) -> Column:
    """A list's numbers as doubles. Integers are taken only if forced, and so is text; what can't be a number is null."""
    if item.name in FLOATS:
        return F.transform(c, lambda x: x.cast("double"))
    if not force:
        return F.filter(F.transform(c, lambda x: F.lit(None).cast("double")), lambda x: x.isNotNull())
    return F.transform(c, lambda x: x.cast("int").cast("double") if item.name == "Bool" else x.try_cast("double"))


def assert_not_null(df: DataFrame, columns: list[str], error: str = "_error") -> DataFrame:
    bad = F.coalesce(*(F.when(F.col(f"`{c}`").isNull(), F.lit(f"{c}: Null")) for c in columns))
    return df.withColumn(error, F.coalesce(F.col(error), bad) if error in df.columns else bad)
