"""Append-only log files of framed JSON records, for single writers beside a Spark program.

A frame is length and CRC-32C (4 bytes each, little-endian), then JSON. A segment holds ``capacity`` records and is named by
its first index. Reading stops at the first frame that is cut off or damaged, so a torn tail costs only itself.
"""

from __future__ import annotations

import json
import struct
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions.scalar import crc32c_bytes
from millrace.operators.infer import infer_json
from millrace.sources.files import write_parquet


def frame(record: dict) -> bytes:
    data = json.dumps(record, default=str).encode()
    return struct.pack("<II", len(data), crc32c_bytes(data)) + data


def frames(data: bytes) -> Iterator[dict]:
    at = 0
    while at + 8 <= len(data):
        n, crc = struct.unpack_from("<II", data, at)
        body = data[at + 8 : at + 8 + n]
        if len(body) < n or crc32c_bytes(body) != crc:
            return
        yield json.loads(body)
        at += 8 + n


class LogFile:
    def __init__(self, folder: str, capacity: int = 1000):
        self.folder, self.capacity = Path(folder), capacity
        self.folder.mkdir(parents=True, exist_ok=True)
        last = self._segments()[-1:]
        self.next = int(last[0].stem) + len(list(frames(last[0].read_bytes()))) if last else 0
        if last:  # drop a torn tail before going on
            whole = b"".join(map(frame, frames(last[0].read_bytes())))
            last[0].write_bytes(whole)

    def _segments(self) -> list[Path]:
        return sorted(self.folder.glob("*.log"))

    def append(self, record: dict) -> int:
        """The record's index."""
        with (self.folder / f"{self.next - self.next % self.capacity:012d}.log").open("ab") as f:
            f.write(frame(record))
        self.next += 1
        return self.next - 1

    def get(self, index: int) -> dict | None:
        path = self.folder / f"{index - index % self.capacity:012d}.log"
        found = list(frames(path.read_bytes())) if path.exists() else []
        return found[index % self.capacity] if index % self.capacity < len(found) else None

    def read_all(self) -> Iterator[tuple[int, dict]]:
        for s in self._segments():
            for k, r in enumerate(frames(s.read_bytes())):
                yield int(s.stem) + k, r

    def delete_older_than(self, keep: int) -> int:
        """Drops whole segments that the newest ``keep`` records don't need; how many."""
        gone = [s for s in self._segments() if int(s.stem) + self.capacity <= self.next - keep]
        for s in gone:
            s.unlink()
        return len(gone)


def scan_logs(spark: SparkSession, folder: str) -> DataFrame:
    """index, record (JSON) of all segments of a folder in any file system; segments are read on the executors, a task for each."""

    def rows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, content in zip(b.column(0).to_pylist(), b.column(1), strict=True):
                first, found = int(path.rpartition("/")[2].partition(".")[0]), [json.dumps(r) for r in frames(content.as_buffer().to_pybytes())]
                yield pa.RecordBatch.from_arrays([pa.array(range(first, first + len(found)), pa.int64()), pa.array(found, pa.string())], names=["index", "record"])

    place = folder if "://" in folder else f"file://{Path(folder).resolve()}"
    return spark.read.format("binaryFile").option("pathGlobFilter", "*.log").load(place).select("path", "content").mapInArrow(rows, "index long, record string")


def log_to_frame(spark: SparkSession, folder: str) -> DataFrame:
    """Recovered records in columns, under their common type."""
    logs = scan_logs(spark, folder)
    return logs.select("index", F.from_json("record", infer_json(logs, "record").spark()).alias("r")).orderBy("index").select("r.*")


def log_to_parquet(spark: SparkSession, folder: str, path: str) -> None:
    write_parquet(log_to_frame(spark, folder), path)
