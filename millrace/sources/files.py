"""Files: csv, json, jsonl, parquet, ipc and arrow in; csv, jsonl, parquet and ipc out; sockets and folders."""

from __future__ import annotations

import hashlib
import json
import re
import socket
import uuid
from collections.abc import Iterator
from pathlib import Path

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.storage import cut

FORMATS = ("ipc", "arrow", "parquet", "csv", "json", "jsonl")
# Fixed value: rows that a CSV file's types are inferred from.
SAMPLE_ROWS = 100
DRIVER_BYTES = 1 << 30


class FileError(ValueError):
    """Empty input or an unsupported kind of file."""


def extension(path: str) -> str:
    found = path.rpartition(".")[2].lower()
    if found not in FORMATS:
        raise FileError(f"UnsupportedType: {path}")
    return found


def read_any(spark: SparkSession, path: str, strict: bool = True, schema: T.StructType | None = None) -> DataFrame:
    """Dispatch by extension. ``strict``: no rows is an error."""
    kind = extension(path)
    if kind == "csv":
        df = read_csv(spark, path, schema)
    elif kind in ("json", "jsonl"):
        df = spark.read.schema(schema).json(path) if schema else _json(spark, path)
    elif kind == "parquet":
        df = spark.read.parquet(path)
    else:
        df = read_ipc(spark, path)
    if strict and df.isEmpty():
        raise FileError(f"Empty: {path}")
    return df


def _json(spark: SparkSession, path: str) -> DataFrame:
    """JSON lines, or one JSON array over several lines."""
    head = spark.read.text(path).where(F.trim("value") != "").limit(1).collect()
    return spark.read.option("multiLine", True).json(path) if head and head[0][0].lstrip().startswith("[") else spark.read.json(path)


def read_csv(spark: SparkSession, path: str, schema: T.StructType | None = None, sample: int = SAMPLE_ROWS) -> DataFrame:
    """Header, comma, trimmed names, all nullable. Types come from the first ``sample`` rows; a later value that doesn't fit is an error."""
    reader = spark.read.option("header", True)
    if schema is None:
        head = [r[0] for r in spark.read.text(path).limit(sample + 1).collect()]
        schema = spark.read.option("header", True).option("inferSchema", True).csv(spark.sparkContext.parallelize(head, 1)).schema
        reader = reader.option("mode", "FAILFAST")
    df = reader.schema(schema).csv(path)
    return df.toDF(*(c.strip() for c in df.columns))


def read_ipc(spark: SparkSession, path: str) -> DataFrame:
    """Arrow IPC files, all batches; read on the executors, a task per file. Only the first file's schema comes to the driver."""
    from pyspark.sql.pandas.types import from_arrow_schema

    files = spark.read.format("binaryFile").load(path)

    def schemas(batches):
        for b in batches:
            for content in b.column(0):
                yield pa.RecordBatch.from_pydict({"schema": [pa.ipc.open_file(pa.BufferReader(content.as_buffer())).schema.serialize().to_pybytes()]})

    def rows(batches):
        for b in batches:
            for content in b.column(0):
                reader = pa.ipc.open_file(pa.BufferReader(content.as_buffer()))
                for k in range(reader.num_record_batches):
                    yield reader.get_batch(k)

    first = files.select("content").limit(1).mapInArrow(schemas, "schema binary").collect()
    if not first:
        raise FileError(f"Empty: {path}")
    schema = pa.ipc.read_schema(pa.BufferReader(bytes(first[0][0])))
    return files.select("content").mapInArrow(rows, from_arrow_schema(schema))


def read_folder(spark: SparkSession, path: str) -> list[tuple[str, DataFrame]]:
    """Supported files of a folder, sorted by name; each is read when its turn comes."""
    hadoop = spark._jvm.org.apache.hadoop.fs.Path(path)
    found = hadoop.getFileSystem(spark._jsc.hadoopConfiguration()).listStatus(hadoop)
    names = sorted(str(f.getPath().toString()) for f in found)
    return [(n, read_any(spark, n, strict=False)) for n in names if n.rpartition(".")[2].lower() in FORMATS]


def read_row(spark: SparkSession, text: str, schema: T.StructType | None = None) -> DataFrame:
    """One row from a JSON object, or from the older list of [key, value] pairs."""
    value = json.loads(text)
    if isinstance(value, list):
        value = {k: v for k, v in value}
    lines = spark.createDataFrame([(json.dumps(value),)], "value string")
    if schema is None:
        schema = T._parse_datatype_string(spark.range(1).select(F.schema_of_json(F.lit(json.dumps(value)))).first()[0])
    return lines.select(F.from_json("value", schema).alias("v")).select("v.*")


def serve_socket(port: int = 0, n: int = 1, host: str = "127.0.0.1"):
    """A listening socket, and a function that yields one JSON text per connection, read to its end."""
    server = socket.create_server((host, port))

    def texts():
        with server:
            for _ in range(n):
                peer, _ = server.accept()
                with peer:
                    parts = []
                    while part := peer.recv(1 << 16):
                        parts.append(part)
                yield b"".join(parts).decode()

    return server.getsockname()[1], texts


def write_parquet(df: DataFrame, path: str, files: int | None = None) -> None:
    (df.coalesce(files) if files else df).write.mode("overwrite").parquet(path)


def write_csv(df: DataFrame, path: str, chunk: int | None = None) -> None:
    """Header in each file; at most ``chunk`` rows a file."""
    _chunked(df, chunk).option("header", True).mode("overwrite").csv(path)


def write_jsonl(df: DataFrame, path: str, chunk: int | None = None) -> None:
    _chunked(df, chunk).mode("overwrite").json(path)


def _chunked(df: DataFrame, chunk: int | None):
    if chunk is None:
        return df.write
    if chunk < 1:
        raise FileError("a chunk holds one row at least")
    return df.write.option("maxRecordsPerFile", chunk)


def to_ipc(df: DataFrame) -> bytes:
    """A result as one Arrow file; an empty result keeps its schema. For results that fit the driver: they are written and measured before they come to it."""
    ready = cut(df)
    size = ready.agg(F.coalesce(F.sum(F.octet_length(F.to_json(F.struct(*(F.col(f"`{c}`") for c in ready.columns))))), F.lit(0))).first()[0] if ready.columns else 0
    if size > DRIVER_BYTES:
        raise FileError("the result is too large for one file; write parquet")
    table = ready.toArrow()
    out = pa.BufferOutputStream()
    with pa.ipc.new_file(out, table.schema) as w:
        w.write_table(table.combine_chunks())
    return out.getvalue().to_pybytes()


def rows_of(df: DataFrame) -> Iterator[dict]:
    """Rows one after another, a partition at a time."""
    return (r.asDict(recursive=True) for r in df.toLocalIterator())


def row_of(df: DataFrame, i: int, names: list[str] | None = None) -> dict:
    """The row at place ``i`` of the frame's order, all columns or those named; IndexError beyond its end."""
    found = (df.select(*(f"`{n}`" for n in names)) if names else df).offset(i).limit(1).collect()
    if not found:
        raise IndexError(i)
    return found[0].asDict(recursive=True)


def write_ipc(df: DataFrame, path: str) -> None:
    Path(path).write_bytes(to_ipc(df))


def write_ipc_folder(df: DataFrame, folder: str) -> None:
    """Arrow files below a new folder of any file system, one for each task, written by the executors."""
    from pyarrow import fs
    from pyspark.sql.pandas.types import to_arrow_schema

    kind = to_arrow_schema(df.schema)

    def where():
        return fs.FileSystem.from_uri(re.sub(r"^file:/+", "file:///", folder)) if re.match(r"[a-z][a-z0-9+.-]*:", folder) else (fs.LocalFileSystem(), folder)

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        system, place = where()
        out, writer, n, name = None, None, 0, f"{place}/part-{uuid.uuid4().hex}.arrow"
        for b in batches:
            if writer is None:
                system.create_dir(place, recursive=True)
                out = system.open_output_stream(name)
                writer = pa.ipc.new_file(out, kind)
            writer.write_batch(pa.RecordBatch.from_arrays([c.cast(f.type) for c, f in zip(b.columns, kind, strict=True)], schema=kind))
            n += b.num_rows
        if writer is not None:
            writer.close()
            out.close()
            yield pa.RecordBatch.from_pydict({"name": [name], "n": [n]})

    written = {r["name"].rpartition("/")[2] for r in df.mapInArrow(write, "name string, n long").collect()}  # a row for each file
    system, place = where()
    if not written:
        return
    for f in system.get_file_info(fs.FileSelector(place)):  # what a failed attempt has left
        if f.base_name not in written:
            system.delete_file(f.path)


def ipc_to_json(data: bytes) -> dict:
    """{schema: [{name, type, nullable}], rows: [...]} of an Arrow file."""
    table = pa.ipc.open_file(pa.BufferReader(data)).read_all()
    return {"schema": [{"name": f.name, "type": str(f.type), "nullable": f.nullable} for f in table.schema], "rows": table.to_pylist()}


def content_hash(data: bytes) -> str:
    return hashlib.sha256(data).hexdigest()


def export(df: DataFrame, path: str, fmt: str, chunk: int | None = None) -> None:
    {"csv": write_csv, "jsonl": write_jsonl, "json": write_jsonl}.get(fmt, lambda d, p, _: write_parquet(d, p))(df, path, chunk)


def pretty(df: DataFrame, n: int = 20) -> str:
    """Rows one field per line."""
    return df._jdf.showString(n, 60, True)
