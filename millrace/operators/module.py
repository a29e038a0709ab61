"""Modules: typed user functions row -> Result<row>, run in Arrow batches with the error of each row kept apart.

A run gives one frame of records: index, input, status, output, error, logs. ``successes``, ``failures`` and ``logs`` are
filters of it; where several of them are wanted, ``run_once`` writes the records, so that the function isn't run again for
each. An exception fails its row only. Isolation is that of Python worker processes; there is no sandbox.
"""

from __future__ import annotations

import inspect
from collections.abc import Callable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_schema

from millrace.operators.capability import Capability, resource
from millrace.operators.repair import project_repair
from millrace.storage import cut
from millrace.types import kind_of


class Failed(Exception):
    """A module's own error result."""


@dataclass(frozen=True)
class Module:
    """``function``: called with the input columns as keywords, and with `log` and `caps` if it has such parameters.

    It returns a dict, or a plain value for a single output column; raising fails the row."""

    name: str
    function: Callable
    inputs: T.StructType
    outputs: T.StructType
    doc: str = ""
    kind: str = "normal"
    capabilities: tuple[Capability, ...] = field(default=())

    def spec(self) -> dict:
        return {"name": self.name, "doc": self.doc, "kind": self.kind, "inputs": self.inputs.jsonValue(), "outputs": self.outputs.jsonValue(), "capabilities": [c.spec() for c in self.capabilities]}


def record_schema(m: Module) -> T.StructType:
    return T.StructType([T.StructField("index", T.LongType()), T.StructField("input", m.inputs), T.StructField("status", T.StringType()), T.StructField("output", m.outputs), T.StructField("error", T.StringType()), T.StructField("logs", T.ArrayType(T.StringType()))])


def caller(m: Module, caps: dict | None = None) -> Callable[[dict], tuple[dict | None, str | None, list[str]]]:
    """A function row -> (output, error, logs); what the module wants is looked up once."""
    wants, fields = inspect.signature(m.function).parameters, [f.name for f in m.outputs]
    with_log, extra = "log" in wants, {"caps": caps or {}} if "caps" in wants else {}

    def call(row: dict) -> tuple[dict | None, str | None, list[str]]:
        logs: list[str] = []
        try:
            made = m.function(**row, **extra, log=logs.append) if with_log else m.function(**row, **extra)
            if not isinstance(made, dict):
                made = {fields[0]: made}
            return {f: made.get(f) for f in fields}, None, logs
        except Exception as e:
            return None, str(e) or type(e).__name__, logs

    return call


def run(df: DataFrame, m: Module, index: str = "index") -> DataFrame:
    """Rows of ``df`` (a column ``index`` and the inputs, repaired to the declared types); a row that can't be repaired fails."""
    want = T.StructType([T.StructField(index, T.LongType()), *m.inputs.fields])
    ready = project_repair(df, kind_of(want))
    schema = record_schema(m)
    arrow = to_arrow_schema(schema)

    names, types = m.inputs.fieldNames(), {f.name: f.type for f in arrow}

    def outputs(made: list, errors: list) -> pa.Array:
        try:
            return pa.array(made, types["output"])
        except (pa.ArrowInvalid, pa.ArrowTypeError):  # one row's output doesn't fit: find it
            for k, x in enumerate(made):
                try:
                    pa.array([x], types["output"])
                except (pa.ArrowInvalid, pa.ArrowTypeError) as e:
                    made[k], errors[k] = None, f"output: {e}"
            return pa.array(made, types["output"])

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        call = caller(m, {c.name: resource(c) for c in m.capabilities})
        for b in batches:
            columns = [b.column(n).cast(f.type) for n, f in zip(names, types["input"], strict=True)]
            values = zip(*(c.to_pylist() for c in columns), strict=True) if columns else ((),) * b.num_rows
            done = [(None, bad, []) if bad else call(dict(zip(names, v, strict=True))) for v, bad in zip(values, b.column("_error").to_pylist(), strict=True)]
            made, errors, logs = ([x[k] for x in done] for k in range(3))
            out = outputs(made, errors)
            inputs = pa.StructArray.from_arrays(columns, fields=list(types["input"])) if columns else pa.array([{}] * b.num_rows, types["input"])
            status = pa.array(["failure" if e else "success" for e in errors], types["status"])
            yield pa.RecordBatch.from_arrays([b.column(index).cast(types["index"]), inputs, status, out, pa.array(errors, types["error"]), pa.array(logs, types["logs"])], schema=arrow)

    return ready.mapInArrow(rows, schema)


def run_once(df: DataFrame, m: Module, index: str = "index") -> DataFrame:
    """The same, written to the shared folder."""
    return cut(run(df, m, index))


def successes(records: DataFrame) -> DataFrame:
    return records.where("status = 'success'").select("index", "output.*")


def failures(records: DataFrame) -> DataFrame:
    """row_index, error, partial_data."""
    return records.where("status = 'failure'").select(F.col("index").alias("row_index"), "error", F.col("input").alias("partial_data"))


def logs(records: DataFrame) -> DataFrame:
    return records.select(F.col("index").alias("row_index"), F.col("logs").alias("module_logs"), F.col("error").alias("failure"))


def assemble(inputs: DataFrame, log: DataFrame, outputs: DataFrame) -> DataFrame:
    """Records joined up by index: a success needs an output; a failure its log entry; with neither, no record is known. A record
    whose input is gone keeps its output or failure."""
    i = inputs.select("index", F.struct(*(c for c in inputs.columns if c != "index")).alias("input"))
    l = log.select(F.col("row_index").alias("l_index"), "module_logs", "failure")  # noqa: E741
    o = outputs.select(F.col("index").alias("o_index"), F.struct(*(c for c in outputs.columns if c != "index")).alias("output"))
    l_o = l.join(o, F.col("l_index") == F.col("o_index"), "full").withColumn("k", F.coalesce("l_index", "o_index"))
    joined = i.join(l_o, F.col("index") == F.col("k"), "full")
    status = F.when(F.col("failure").isNotNull(), "failure").when(F.col("o_index").isNotNull(), "success").otherwise("not_found")
    return joined.select(F.coalesce("index", "k").alias("index"), "input", status.alias("status"), "output", F.col("failure").alias("error"), F.coalesce("module_logs", F.array().cast("array<string>")).alias("logs"))


def tally(records: DataFrame) -> DataFrame:
    return records.agg(F.count("*").alias("n"), F.count_if(F.col("status") == "success").alias("succeeded"), F.count_if(F.col("status") == "failure").alias("failed"))


def compose(df: DataFrame, *modules: Module, index: str = "index") -> DataFrame:
    """Each module runs on its predecessor's successes, under the same row index; the last one's records."""
    out = run(df, modules[0], index)
    for m in modules[1:]:
        out = run(successes(out), m)
    return out
