"""A pipeline: one module, its tables of inputs, outputs and logs, callbacks, and SQL over them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.operators import module as modules
from millrace.operators.module import Failed, Module
from millrace.operators.repair import project
from millrace.plans import sqlview
from millrace.plans.table import NotFound, Table
from millrace.sources import files
from millrace.streaming import replay
from millrace.types import kind_of

LOGS = T.StructType([T.StructField("row_index", T.LongType()), T.StructField("module_logs", T.ArrayType(T.StringType())), T.StructField("failure", T.StringType())])


class Pipeline:
    """``path`` holds the tables `inputs`, `outputs` and `logs`; all three share one index. ``targets``: pipelines that run on
    this one's successes and store them under the same index."""

    def __init__(self, spark: SparkSession, path: str, module: Module, callbacks: list[Callable[[int, dict], None]] | None = None, targets: list[Pipeline] | None = None):
        if module.kind != "normal":
            raise ValueError("sessions run in millrace.streaming.session")
        self.spark, self.module, self.callbacks, self.targets = spark, module, callbacks or [], targets or []
        self.inputs = Table(spark, f"{path}/inputs", module.inputs, "_input_meta")
        self.outputs = Table(spark, f"{path}/outputs", module.outputs, "_output_meta")
        self.logs = Table(spark, f"{path}/logs", LOGS, "_log_meta")

    def run(self, df: DataFrame, order: list | None = None) -> DataFrame:
        """Runs the module over rows and stores inputs, outputs and logs; the new records."""
        first = self.inputs.next_index()
        self.inputs.append(project(df, kind_of(self.module.inputs)) if order is None else df, order)
        new = self.inputs.scan().where(F.col("_input_meta.index") >= first)
        return self._finish(new.select(F.col("_input_meta.index").alias("index"), *(f"`{f.name}`" for f in self.module.inputs)))

    def accept(self, rows: DataFrame) -> DataFrame:
        """Runs the module over rows that have an index already, in a column `index`; the new records."""
        self.inputs.append(rows, index="index")
        return self._finish(rows)

    def _finish(self, ready: DataFrame) -> DataFrame:
        records = modules.run_once(ready, self.module)
        good = modules.successes(records)
        self.outputs.append(good, index="index")
        self.logs.append(modules.logs(records).withColumn("index", F.col("row_index")), index="index")
        if self.callbacks:
            replay.with_callbacks(good, self.callbacks)
        for target in self.targets:
            target.accept(good)
        return records

    def bulk(self, path: str) -> DataFrame:
        """A whole file through the pipeline."""
        return self.run(files.read_any(self.spark, path))

    def one(self, text: str) -> dict:
        """One JSON row; raises Failed with the module's error."""
        r = self.run(files.read_row(self.spark, text)).first()
        if r["status"] == "failure":
            raise Failed(r["error"])
        return r["output"].asDict(recursive=True)

    def stream(self, df: DataFrame, checkpoint: str):
        """Each micro-batch is one commit."""
        return replay.drain(df, lambda b, _: self.run(b) and None, checkpoint)

    def record(self, index: int) -> dict:
        """Success or failure of one index; NotFound if neither output nor log knows it."""
        row = self.inputs.get(index)
        row.pop("_input_meta")
        try:
            log = self.logs.get(index)
        except NotFound:
            log = {"module_logs": [], "failure": None}
        if log["failure"] is not None:
            return {"status": "failure", "input": row, "failure": log["failure"], "logs": log["module_logs"]}
        out = self.outputs.get(index)
        out.pop("_output_meta")
        return {"status": "success", "input": row, "success": out, "logs": log["module_logs"]}

    def sql(self, text: str) -> DataFrame:
        """Over `pipeline`: inputs joined with outputs."""
        return sqlview.query_pipeline(self.spark, [(self.inputs.scan(), "_input_meta"), (self.outputs.scan(), "_output_meta")], text)

    def data(self, text: str) -> DataFrame:
        """Over `data`: the outputs."""
        return sqlview.query_data(self.outputs.scan(), text)

    def lengths(self) -> dict:
        return {"inputs": self.inputs.length(), "outputs": self.outputs.length(), "logs": self.logs.length()}

    def write_results(self, records: DataFrame, folder: str, fmt: str = "jsonl") -> None:
        """success.<fmt> in order of rows, errors as JSON lines (row_index, error, partial_data), logs. The order is a range sort, in parts."""
        good = modules.successes(records).orderBy("index").drop("index")
        files.export(good, f"{folder}/success.{fmt}", fmt)
        files.write_jsonl(modules.failures(records), f"{folder}/errors.jsonl")
        files.write_jsonl(modules.logs(records), f"{folder}/logs")
