"""SQL over tables: `data` for one table, `pipeline` for inputs joined with outputs by index.

A statement sees its tables as common table expressions, so no view of the caller's session is touched, whatever its name.
Besides SELECT, `data` takes EXPLAIN of a SELECT, DESCRIBE data, SHOW COLUMNS and SHOW TABLES.
"""

from __future__ import annotations

import re
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


class SqlError(ValueError):
    """A statement that isn't allowed."""


def _plan(spark: SparkSession, sql: str):
    try:
        return spark._jsparkSession.sessionState().sqlParser().parsePlan(sql)
    except Exception as e:
        raise SqlError(str(e).splitlines()[0][:300]) from None


def _nodes(plan):
    """A plan's nodes, subqueries and CTE definitions included."""
    yield plan
    children = plan.children()
    for i in range(children.size()):
        yield from _nodes(children.apply(i))
    inner = plan.innerChildren()
    for i in range(inner.size()):
        if hasattr(inner.apply(i), "innerChildren"):
            yield from _nodes(inner.apply(i))


# Plan nodes that only read.
READERS = {"Project", "Filter", "Aggregate", "UnresolvedRelation", "SubqueryAlias", "Sort", "GlobalLimit", "LocalLimit", "Offset", "Distinct", "Deduplicate", "UnresolvedHaving", "WithWindowDefinition", "OneRowRelation", "UnresolvedInlineTable", "Generate", "Union", "Join", "UnresolvedWith", "Intersect", "Except", "LateralJoin", "UnresolvedTableValuedFunction", "UnresolvedSubqueryColumnAliases", "LocalRelation", "Pivot", "Unpivot", "Sample", "UnionLoop", "UnresolvedTVFAliases"}


def _check_reads(plan) -> None:
    for n in _nodes(plan):
        if n.nodeName() not in READERS:
            raise SqlError(f"only SELECT is allowed, not {n.nodeName()}")


def validate_data(spark: SparkSession, sql: str) -> None:
    """One statement, and it only reads."""
    _check_reads(_plan(spark, sql))


def validate_pipeline(spark: SparkSession, sql: str) -> None:
    """One SELECT from the single relation `pipeline` (any case): no joins, set operations, CTEs or other tables, nested ones included."""
    plan = _plan(spark, sql)
    _check_reads(plan)
    names = [n.nodeName() for n in _nodes(plan)]
    for bad in ("Join", "LateralJoin", "Union", "Intersect", "Except", "UnresolvedWith"):
        if bad in names:
            raise SqlError(f"{bad} isn't allowed on pipeline")
    text = re.findall(r"UnresolvedRelation \[([^\]]*)\]", plan.toString())
    if not text or any(t.lower() != "pipeline" for t in text):
        raise SqlError(f"the table must be pipeline, not {text}")


def with_tables(spark: SparkSession, tables: dict[str, DataFrame], sql: str) -> DataFrame:
    """Runs a SELECT in which ``tables`` have those names."""
    held = {name: f"millrace_{uuid.uuid4().hex}" for name in tables}
    for name, df in tables.items():
        df.createOrReplaceTempView(held[name])
    try:
        ctes = ", ".join(f"`{name}` AS (SELECT * FROM {view})" for name, view in held.items())
        own = re.match(r"\s*WITH\b(\s+RECURSIVE\b)?", sql, re.I)
        return spark.sql(f"WITH{(own[1] or '') if own else ''} {ctes}{',' if own else ''} {sql[own.end() :] if own else sql}")
    finally:
        for view in held.values():
            spark.catalog.dropTempView(view)


def query_data(table: DataFrame, sql: str) -> DataFrame:
    spark, text = table.sparkSession, sql.strip().rstrip(";")
    if m := re.match(r"EXPLAIN\b(\s+(EXTENDED|FORMATTED|COST|CODEGEN)\b)?\s*(.*)$", text, re.I | re.S):
        validate_data(spark, m[3])
        mode = (m[2] or "simple").lower()
        plan = with_tables(spark, {"data": table}, m[3])._jdf.queryExecution().explainString(spark._jvm.org.apache.spark.sql.execution.ExplainMode.fromString(mode))
        return spark.createDataFrame([(plan,)], "plan string")
    if re.match(r"(DESC|DESCRIBE)(\s+TABLE)?\s+`?data`?$", text, re.I):
        return spark.createDataFrame([(f.name, f.dataType.simpleString(), f.nullable) for f in table.schema], "col_name string, data_type string, is_nullable boolean")
    if re.match(r"SHOW\s+COLUMNS\s+(IN|FROM)\s+`?data`?$", text, re.I):
        return spark.createDataFrame([(c,) for c in table.columns], "col_name string")
    if re.match(r"SHOW\s+TABLES$", text, re.I):
        return spark.createDataFrame([("data",)], "table_name string")
    validate_data(spark, text)
    return with_tables(spark, {"data": table}, text)


def pipeline_view(tables: list[tuple[DataFrame, str]]) -> DataFrame:
    """1 to 3 tables with the names of their metadata columns, inner-joined by index. A column that is there already comes
    as `__tN_name`; a repeated metadata column is dropped. Inputs whose call failed have no output and so vanish."""
    if not 1 <= len(tables) <= 3:
        raise SqlError("1 to 3 tables are joined")
    for df, prefix in tables:
        if prefix not in df.columns:
            raise SqlError(f"no metadata column {prefix}")
    out, prefix = tables[0]
    key = "__key"
    out = out.withColumn(key, F.col(f"{prefix}.index"))
    for k, (df, p) in enumerate(tables[1:], 1):
        have = {c.lower() for c in out.columns}
        metas = {x for _, x in tables}
        columns = [F.col(f"`{c}`").alias(c if c.lower() not in have else f"__t{k}_{c}") for c in df.columns if not (c.lower() in have and c in metas)]
        side = df.select(*columns, F.col(f"{p}.index").alias(f"__key{k}"))
        out = out.join(side, out[key] == side[f"__key{k}"]).drop(f"__key{k}")
    return out.drop(key)


def query_pipeline(spark: SparkSession, tables: list[tuple[DataFrame, str]], sql: str) -> DataFrame:
    validate_pipeline(spark, sql)
    return with_tables(spark, {"pipeline": pipeline_view(tables)}, sql)
