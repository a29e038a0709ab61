"""Sessions: keyed state machines over ordered rows, in batch and as a stream.

A session module is ``f(history, row)`` -> Continue(output), End(output) or Terminate(). In the `session` shape the history
is one list, inputs and outputs in turn; in the `session_diff` shape it is ``f(inputs, outputs, row)`` with two lists. After
End, Terminate or an error a session is closed, and further calls are failures. Rows of a session are taken in order; a
task holds the history of one session at a time, whatever its other sessions. ``Sessions`` keeps turns and closed sessions in
tables, so that a session goes on with the rows it had.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StatefulProcessor

from millrace.operators.module import Failed
from millrace.plans.table import NotFound, Table
from millrace.storage import cut
from millrace.streaming.replay import with_callbacks


@dataclass(frozen=True)
class Continue:
    output: str


@dataclass(frozen=True)
class End:
    output: str


@dataclass(frozen=True)
class Terminate:
    pass


STATUS = {Continue: "active", End: "succeeded", Terminate: "succeeded"}
CALLS = "session_id long, turn long, input string, output string, status string, error string, length long"


class Machine:
    """One session's state: history and status."""

    def __init__(self, module: Callable, diff: bool = False, inputs: list[str] | None = None, outputs: list[str | None] | None = None, status: str = "active"):
        self.module, self.diff, self.inputs, self.outputs, self.status = module, diff, inputs or [], outputs or [], status

    @property
    def history(self) -> list:
        """Inputs and outputs in turn; a failed call has no output."""
        return [x for pair in zip(self.inputs, self.outputs + [None] * (len(self.inputs) - len(self.outputs))) for x in pair][: len(self.inputs) + len(self.outputs)]

    def call(self, row: str) -> tuple[str | None, str | None]:
        """(output, error)."""
        if self.status != "active":
            return None, "the session is closed"
        try:
            out = self.module(list(self.inputs), list(self.outputs), row) if self.diff else self.module(self.history, row)
            if not isinstance(out, Continue | End | Terminate):
                raise TypeError("a session module returns Continue, End or Terminate")
            if not isinstance(out, Terminate) and out.output is None:
                raise ValueError("Continue and End carry data")
        except Exception as e:
            self.inputs.append(row)
            self.status = "failed"
            return None, str(e) or type(e).__name__
        self.inputs.append(row)
        self.outputs.append(getattr(out, "output", None))
        self.status = STATUS[type(out)]
        return self.outputs[-1], None


def calls(df: DataFrame, module: Callable, session_id: str = "session_id", turn: str = "turn", row: str = "input", diff: bool = False, prior: DataFrame | None = None) -> DataFrame:
    """One row per call, in order of ``turn`` within its session. ``prior``: earlier rows (session_id, turn, input, output, status,
    error) that a session had before; they are its history and aren't called again."""
    ready = df.select(F.col(session_id).cast("long").alias("session_id"), F.col(turn).cast("long").alias("turn"), F.col(row).cast("string").alias("input"), *(F.lit(None).cast("string").alias(c) for c in ("output", "status", "error")), F.lit(False).alias("known"))
    if prior is not None:
        ready = prior.select("session_id", "turn", "input", "output", "status", "error", F.lit(True).alias("known")).where("error IS NULL OR error <> 'the session is closed'").unionByName(ready)

    def step(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        key, machine = None, Machine(module, diff)
        for b in batches:
            out = []
            for s, t, x, past, state, failed, known in zip(*(b[c].tolist() for c in ("session_id", "turn", "input", "output", "status", "error", "known"))):
                if s != key:
                    key, machine = s, Machine(module, diff)
                if known:
                    machine.inputs.append(x)
                    if failed is None:
                        machine.outputs.append(past)
                    machine.status = state
                    continue
                output, error = machine.call(x)
                out.append((s, t, x, output, "failed" if error else machine.status, error, len(machine.inputs) + len(machine.outputs)))
            yield pd.DataFrame(out, columns=["session_id", "turn", "input", "output", "status", "error", "length"])

    placed = ready.where("session_id IS NOT NULL").repartition("session_id").sortWithinPartitions("session_id", F.col("known").desc(), "turn", "input")
    return placed.mapInPandas(step, CALLS)


def status(made: DataFrame) -> DataFrame:
    """session_id, status, length: as of the last call that the session took."""
    taken = made.where("error IS NULL OR error <> 'the session is closed'")
    return taken.groupBy("session_id").agg(F.max_by("status", F.struct("turn", "length")).alias("status"), F.max("length").alias("length"))


def rollup(made: DataFrame) -> DataFrame:
    """Closed sessions: session_id, session (inputs and outputs in turn), inputs, outputs."""
    taken = made.where("error IS NULL OR error <> 'the session is closed'")
    steps = F.array_sort(F.collect_list(F.struct("turn", "length", "input", "output", "error")))
    rows = taken.groupBy("session_id").agg(steps.alias("steps"), F.max_by("status", F.struct("turn", "length")).alias("status")).where("status <> 'active'")
    both = F.flatten(F.transform("steps", lambda s: F.when(s["error"].isNull(), F.array(s["input"], s["output"])).otherwise(F.array(s["input"]))))
    return rows.select("session_id", "status", both.alias("session"), F.transform("steps", lambda s: s["input"]).alias("inputs"), F.transform(F.filter("steps", lambda s: s["error"].isNull()), lambda s: s["output"]).alias("outputs"))


def split_record(session: str = "session") -> list:
    """By parity: an even list is prior, input, success; an odd one prior, input without output."""
    c = F.col(session)
    even = F.size(c) % 2 == 0
    return [F.slice(c, 1, F.size(c) - F.when(even, 2).otherwise(1)).alias("prior"), F.when(even, F.element_at(c, -2)).otherwise(F.element_at(c, -1)).alias("input"), F.when(even, F.element_at(c, -1)).alias("success")]


def explode_session(df: DataFrame, session: str = "session") -> DataFrame:
    return df.select("session_id", F.posexplode(session).alias("pos", "value"))


def explode_pairs(df: DataFrame) -> DataFrame:
    """The two-list shape as rows: turn, input, output."""
    return df.select("session_id", F.posexplode(F.arrays_zip("inputs", "outputs")).alias("turn", "p")).select("session_id", "turn", "p.inputs", "p.outputs")


class Processor(StatefulProcessor):
    """The same machine over a stream; histories are list states, so idle sessions live in the state store."""

    def __init__(self, module: Callable, diff: bool = False):
        self.module, self.diff = module, diff

    def init(self, handle) -> None:
        text = T.StructType([T.StructField("v", T.StringType())])
        self.inputs, self.outputs = handle.getListState("inputs", text), handle.getListState("outputs", text)
        self.state = handle.getValueState("status", T.StructType([T.StructField("status", T.StringType()), T.StructField("length", T.LongType())]))

    def handleInputRows(self, key, rows, timerValues) -> Iterator[pd.DataFrame]:
        now = self.state.get()
        machine, gone = Machine(self.module, self.diff, [r[0] for r in self.inputs.get()], [r[0] for r in self.outputs.get()], now[0] if now else "active"), 0
        if machine.status != "active":  # closed before: its lists are cleared, its length is known
            gone = now[1]
        have, out = (len(machine.inputs), len(machine.outputs)), []
        for x in pd.concat(list(rows)).sort_values(["turn", "input"]).itertuples():
            output, error = machine.call(x.input)
            out.append((int(key[0]), int(x.turn), x.input, output, "failed" if error else machine.status, error, gone or len(machine.inputs) + len(machine.outputs)))
        if machine.status == "active":
            if new := machine.inputs[have[0] :]:
                self.inputs.appendList([(v,) for v in new])
            if new := machine.outputs[have[1] :]:
                self.outputs.appendList([(v,) for v in new])
        else:  # only that it is closed stays in the state store
            self.inputs.clear()
            self.outputs.clear()
        self.state.update((machine.status, gone or len(machine.inputs) + len(machine.outputs)))
        yield pd.DataFrame(out, columns=["session_id", "turn", "input", "output", "status", "error", "length"])

    def close(self) -> None:
        pass


def stream_calls(df: DataFrame, module: Callable, diff: bool = False) -> DataFrame:
    """``df``: a stream of session_id, turn, input. Needs the RocksDB state store, which this sets."""
    df.sparkSession.conf.set("spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider")
    return df.groupBy("session_id").transformWithStateInPandas(Processor(module, diff), CALLS, "Append", "None")


def next_id(made: DataFrame) -> int:
    """A new session's id."""
    return (made.agg(F.max("session_id")).first()[0] or 0) + 1 if not made.isEmpty() else 0


def newest(made: DataFrame, which: str = "all") -> DataFrame:
    """Sessions newest first; which: all, active, closed or failed."""
    s = status(made)
    wanted = {"all": F.lit(True), "active": F.col("status") == "active", "closed": F.col("status") != "active", "failed": F.col("status") == "failed"}[which]
    return s.where(wanted).orderBy(F.col("session_id").desc())


class Sessions:
    """Session modules over tables: `turns`, one row per call, and `sessions`, one row per closed session. ``callbacks`` get
    (session id, rolled-up row) when a session closes."""

    def __init__(self, spark, path: str, module: Callable, diff: bool = False, callbacks: list[Callable[[int, dict], None]] | None = None):
        kind = lambda text: T._parse_datatype_string(text)
        self.spark, self.module, self.diff, self.callbacks = spark, module, diff, callbacks or []
        self.turns = Table(spark, f"{path}/turns", kind(CALLS), "_turn_meta")
        self.closed = Table(spark, f"{path}/sessions", kind("session_id long, status string, session array<string>, inputs array<string>, outputs array<string>"), "_session_meta")

    def prepare(self, prior: DataFrame) -> None:
        """Stores rows (session_id, turn, input, output) that sessions had elsewhere, but for turns that are known already."""
        known = self.turns.scan().select("session_id", "turn")
        rows = prior.select("session_id", "turn", "input", "output").join(known, ["session_id", "turn"], "left_anti")
        self.turns.append(cut(rows.withColumns({"status": F.lit("active"), "error": F.lit(None).cast("string"), "length": F.lit(None).cast("long")})), ["session_id", "turn"])

    def run(self, df: DataFrame) -> DataFrame:
        """Calls (session_id, turn, input) that go on where their sessions were; the new rows."""
        prior = self.turns.scan().join(df.select("session_id").distinct(), "session_id", "left_semi")
        made = cut(calls(df, self.module, diff=self.diff, prior=prior))
        self.turns.append(made, ["session_id", "turn", "length"])
        ended = made.where("status <> 'active' AND (error IS NULL OR error <> 'the session is closed')").select("session_id").distinct()
        rolled = cut(rollup(self.turns.scan().join(ended, "session_id", "left_semi").drop("_turn_meta")))
        if not rolled.isEmpty():
            self.closed.append(rolled, ["session_id"])
            if self.callbacks:
                with_callbacks(rolled, self.callbacks, "session_id")
        return made

    def call(self, session_id: int, text: str) -> dict:
        """One turn."""
        turn = self.turns.scan().where(F.col("session_id") == session_id).agg(F.coalesce(F.max("turn") + 1, F.lit(0))).first()[0]
        r = self.run(self.spark.createDataFrame([(session_id, turn, text)], "session_id long, turn long, input string")).first()
        if r["error"]:
            raise Failed(r["error"])
        return {"session_id": session_id, "output": r["output"], "status": r["status"]}

    def get(self, session_id: int) -> dict:
        """Status and rows of one session, from the rolled-up table if it is closed, else from its turns; NotFound if there is none."""
        if row := self.closed.scan().where(F.col("session_id") == session_id).first():
            return {"session_id": session_id, "status": row["status"], "session": row["session"]}
        rows = self.turns.scan().where(F.col("session_id") == session_id).orderBy("turn").collect()
        if not rows:
            raise NotFound(session_id)
        return {"session_id": session_id, "status": "active", "session": [x for r in rows for x in ((r["input"],) if r["error"] else (r["input"], r["output"]))]}

    def next_id(self) -> int:
        return next_id(self.turns.scan())
