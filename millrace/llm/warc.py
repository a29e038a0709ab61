"""WARC archives: a writer that points repeated payloads at their first record, and a sequential reader.

Of pages with equal payloads of MIN_REVISIT bytes or more, the one with the smallest page_id is written as a response, the
others as revisit records without payload. Each record is a gzip member of its own. The reader decompresses member by
member with zlib in pieces of READ bytes, frames records by their content length and verifies block and payload digests.

Files roll over at FILE_BYTES; the manifest of files is checkpointed, so a lost executor costs a rewrite at most, and readers
only open what the manifest lists, a task for each file.

Edge cases: null html is the empty payload; null page_ids are written and read as null, and are a response only if their
payload has no page_id at all; rows that repeat the smallest page_id are responses too; an empty table writes no file; a long
payload is written and read whole, as one record; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
import uuid
import zlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import cut, new_folder, row_batches, text_values
from millrace.llm.files import open_stream, open_write

MIN_REVISIT = 100
FILE_BYTES = 256 << 20
READ = 1 << 16
DATE = "2026-01-01T00:00:00Z"
PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"


class WarcError(ValueError):
    """A record that is cut off, badly framed or fails its digest."""


def record(headers: list[tuple[str, str]], block: bytes) -> bytes:
    """One record as one gzip member."""
    lines = ["WARC/1.0", *(f"{k}: {v}" for k, v in headers), f"WARC-Block-Digest: sha256:{hashlib.sha256(block).hexdigest()}", f"Content-Length: {len(block)}"]
    press = zlib.compressobj(6, zlib.DEFLATED, 31)
    return press.compress(("\r\n".join(lines) + "\r\n\r\n").encode() + block + b"\r\n\r\n") + press.flush()


def page_record(page_id: int | None, url: str, payload: bytes, size: int, digest: str, first: int | None, date: str = DATE) -> bytes:
    """A response, or if ``first`` is another page's id a revisit of that page's record."""
    name = lambda x: f"<urn:page:{'null' if x is None else x}>"
    revisit = first is not None
    url = "".join(url.split()) or "about:blank"
    headers = [("WARC-Type", "revisit" if revisit else "response"), ("WARC-Record-ID", name(page_id)), ("WARC-Date", date), ("WARC-Target-URI", url), ("WARC-Payload-Digest", f"sha256:{digest}"), ("WARC-Payload-Length", str(size)), ("Content-Type", "application/http; msgtype=response")]
    if revisit:
        headers += [("WARC-Profile", PROFILE), ("WARC-Refers-To", name(first))]
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    return record(headers, http if revisit else http + payload)


def members(source, size: int = READ) -> Iterator[Iterator[bytes]]:
    """The gzip members of a stream, each as an iterator of decompressed pieces; each is to be read to its end."""
    rest = source.read(size)
    while rest:
        state = [rest]

        def pieces() -> Iterator[bytes]:
            unzip, data = zlib.decompressobj(31), state[0]
            while True:
                while data and not unzip.eof:
                    if out := unzip.decompress(data, READ):
                        yield out
                    data = unzip.unconsumed_tail
                if unzip.eof:
                    state[0] = unzip.unused_data
                    return
                if not (data := source.read(size)):
                    raise WarcError("the archive ends within a record")

        yield pieces()
        rest = state[0] or source.read(size)


def parse(pieces: Iterator[bytes]) -> tuple[dict[str, str], bytes]:
    """Header fields (names in lower case) and block of one record; verifies framing and digests."""
    data = bytearray()
    while (at := data.find(b"\r\n\r\n")) < 0:
        piece = next(pieces, None)
        if piece is None:
            raise WarcError("a record without the end of its header")
        data += piece
    version, *lines = data[:at].decode().split("\r\n")
    if not version.startswith("WARC/"):
        raise WarcError(f"not a record: {version[:40]!r}")
    fields = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in lines)}
    if not fields.get("content-length", "").isdigit():
        raise WarcError("a record without content length")
    length = int(fields["content-length"])
    del data[: at + 4]
    for piece in pieces:
        data += piece
    if bytes(data[length:]) != b"\r\n\r\n":
        raise WarcError("content length doesn't fit the record")
    block = bytes(data[:length])
    check(fields.get("warc-block-digest"), block)
    if fields.get("warc-type") == "response":
        check(fields.get("warc-payload-digest"), block.partition(b"\r\n\r\n")[2])
    return fields, block


def check(digest: str | None, data: bytes) -> None:
    """Digests that are missing, or made in another way than sha256 in hex, aren't verified."""
    kind, _, value = (digest or "").partition(":")
    if kind == "sha256" and hashlib.sha256(data).hexdigest() != value:
        raise WarcError("a digest doesn't fit")


def read_records(source) -> Iterator[tuple[dict[str, str], bytes]]:
    for pieces in members(source):
        yield parse(pieces)


def _writer(folder: str):
    schema = pa.schema([("path", pa.string()), ("n_records", pa.int64())])

    def write(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, path, n, size = None, "", 0, 0
        for batch in row_batches(batches):
            payloads = text_values(batch.column(2))
            ids, urls, sizes, digests, firsts = (batch.column(k).to_pylist() for k in (0, 1, 3, 4, 5))
            for row in zip(ids, urls, payloads, sizes, digests, firsts, strict=True):
                if out is None:
                    path = f"{folder}/part-{TaskContext.get().partitionId():06d}-{uuid.uuid4().hex}.warc.gz"
                    out, n, size = open_write(path), 0, 0
                data = page_record(*row)
                out.write(data)
                n, size = n + 1, size + len(data)
                if size >= FILE_BYTES:
                    out.close()
                    out = None
                    yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]}, schema=schema)
        if out is not None:
            out.close()
            yield pa.RecordBatch.from_pydict({"path": [path], "n_records": [n]}, schema=schema)

    return write


def write_pages(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url", html: str = "html") -> DataFrame:
    """Writes archives; the manifest: path, n_records."""
    spark = pages.sparkSession
    text = F.coalesce(F.col(f"`{html}`"), F.lit(""))
    rows = pages.select(F.col(f"`{page_id}`").cast("long").alias("page_id"), F.coalesce(F.col(f"`{url}`"), F.lit("")).alias("url"), text.alias("html"), F.octet_length(text).cast("long").alias("size"), F.sha2(text.cast("binary"), 256).alias("digest"))
    # only payloads that occur twice or more take part in the join; copies are counted before they are shuffled
    firsts = rows.where(F.col("size") >= MIN_REVISIT).groupBy(F.col("digest").alias("d")).agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1").select("d", "first")
    joined = rows.join(firsts, F.col("digest") == F.col("d"), "left")
    again = F.when(~F.col("page_id").eqNullSafe(F.col("first")), F.col("first"))
    typed = joined.select("page_id", "url", F.when(again.isNull(), F.col("html")).otherwise("").alias("html"), "size", "digest", again.alias("first"))
    return cut(typed.mapInArrow(_writer(folder or new_folder(spark, "warc")), "path string, n_records long"))


def _number(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text.lstrip("-").isdigit() else None


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    schema = pa.schema([("page_id", pa.int64()), ("payload_bytes", pa.int64()), ("payload_digest", pa.string()), ("record_type", pa.string()), ("refers_to", pa.int64())])
    rows: list[tuple] = []

    def full() -> pa.RecordBatch:
        out = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
        rows.clear()
        return out

    for batch in row_batches(batches):
        for path in batch.column(0).to_pylist():
            with open_stream(path) as source:
                for fields, block in read_records(source):
                    kind = fields["warc-type"]
                    size = len(block.partition(b"\r\n\r\n")[2]) if kind == "response" else int(fields["warc-payload-length"])
                    rows.append((_number(fields["warc-record-id"]), size, fields["warc-payload-digest"].partition(":")[2], kind, _number(fields.get("warc-refers-to"))))
                    if len(rows) >= 5000:
                        yield full()
    if rows:
        yield full()


def read_pages(manifest: DataFrame) -> DataFrame:
    """Read back from the archives: page_id, payload_bytes, payload_digest, record_type, refers_to."""
    files = manifest.select("path").repartition(max(1, manifest.count()), "path")
    return files.mapInArrow(_read, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long")


ORACLE_SQL = """
WITH p AS (SELECT page_id, encode(coalesce(html, '')) AS b FROM pages),
d AS (SELECT page_id, octet_length(b)::BIGINT AS payload_bytes, sha256(b) AS payload_digest FROM p),
f AS (SELECT *, CASE WHEN payload_bytes >= 100 THEN min(page_id) OVER (PARTITION BY payload_digest) ELSE page_id END AS first FROM d)
SELECT page_id, payload_bytes, payload_digest, CASE WHEN first = page_id THEN 'response' ELSE 'revisit' END AS record_type,
  CASE WHEN first <> page_id THEN first END AS refers_to FROM f
"""
