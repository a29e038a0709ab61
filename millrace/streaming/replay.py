"""Replay of files as a stream, live row streams, callbacks, and log retention."""

from __future__ import annotations

import random
import threading
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.streaming import StreamingQuery


def replay(spark: SparkSession, folder: str, schema: T.StructType, fmt: str = "parquet", files_per_batch: int = 1) -> DataFrame:
    """Files of a folder as a stream, oldest first."""
    reader = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).option("latestFirst", False)
    return reader.option("header", True).csv(folder) if fmt == "csv" else reader.format({"jsonl": "json"}.get(fmt, fmt)).load(folder)


class TimedReplay:
    """One row per interval, in the frame's order, in a thread. The jitter of each row is drawn anew, added or subtracted, and
    never makes a pause negative. Rows come from Spark a partition at a time."""

    def __init__(self, df: DataFrame, each: Callable[[dict], None], seconds: float = 0.0, jitter: float = 0.0, seed: int | None = None):
        self.df, self.each, self.seconds, self.jitter, self.rng = df, each, seconds, jitter, random.Random(seed)
        self.sent = self.failed = 0
        self.error: str | None = None
        self._stop, self._thread = threading.Event(), threading.Thread(target=self._run, daemon=True)

    def _pause(self) -> float:
        return max(0.0, self.seconds + self.rng.uniform(-self.jitter, self.jitter))

    def _run(self) -> None:
        try:
            for row in self.df.toLocalIterator():
                if self._stop.wait(self._pause()):
                    return
                try:
                    self.each(row.asDict(recursive=True))
                except Exception:
                    self.failed += 1
                self.sent += 1
        except Exception as e:
            self.error = str(e)

    def start(self) -> TimedReplay:
        self._thread.start()
        return self

    def stop(self) -> None:
        self._stop.set()
        self._thread.join()

    def join(self, seconds: float | None = None) -> None:
        self._thread.join(seconds)

    def status(self) -> dict:
        return {"active": self._thread.is_alive(), "sent": self.sent, "failed": self.failed, "stopped": self._stop.is_set(), "error": self.error}


def drain(df: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str) -> StreamingQuery:
    """All there is now, in batches, then stop. Restarts go on where the checkpoint says."""
    return df.writeStream.foreachBatch(each).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def parallel(df: DataFrame, in_flight: int, index: str = "index") -> DataFrame:
    """``in_flight`` tasks; a row goes to task index % in_flight."""
    return df.repartitionById(in_flight, F.pmod(F.col(index), F.lit(in_flight)).cast("int"))


def progress(query: StreamingQuery) -> dict:
    p = query.recentProgress  # ``query.stop()`` ends it; a restart goes on from its checkpoint
    return {"active": query.isActive, "batches": len(p), "rows": sum(x["numInputRows"] for x in p), "error": str(query.exception()) if query.exception() else None}


def live(df: DataFrame, name: str) -> StreamingQuery:
    """Rows into an in-memory table, to be polled by its name; for small streams."""
    return df.writeStream.format("memory").queryName(name).outputMode("append").start()


def with_callbacks(rows: DataFrame, callbacks: list[Callable[[int, dict], None]], index: str = "index") -> None:
    """Each callback gets (row index, row) on the executors; what it raises is only logged."""

    def each(part) -> None:
        import logging

        for r in part:
            row = r.asDict(recursive=True)
            i = row.pop(index)
            for f in callbacks:
                try:
                    f(i, row)
                except Exception:
                    logging.getLogger("millrace").exception("callback failed for row %s", i)

    rows.foreachPartition(each)


def http_callback(url: str, post: Callable[[str, dict, dict], None]) -> Callable[[int, dict], None]:
    """``post(url, headers, row)`` is injected."""
    return lambda i, row: post(url, {"X-Row-Index": str(i)}, row)


def keep_logs(log: DataFrame, keep: int, segment: int = 1000) -> DataFrame:
    """Whole segments of ``segment`` indexes are dropped, so that the newest ``keep`` rows stay."""
    top = log.agg(F.max("row_index").alias("top"))
    return log.crossJoin(F.broadcast(top)).where(F.expr(f"row_index div {segment} >= (top + 1 - {keep}) div {segment}")).drop("top")


def windowed(events: DataFrame, every: str = "1 hour", late: str = "10 minutes", ts: str = "ts", key: str = "event_type") -> DataFrame:
    """Tumbling counts with a watermark; for streams and for batches."""
    return events.withWatermark(ts, late).groupBy(F.window(ts, every).alias("w"), key).agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), key, "n")
