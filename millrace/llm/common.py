"""Things that several corpus operators share: batching, bitmaps, and vectorised word splitting; storage is the library's."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from millrace.storage import cut, fresh, new_folder, shared_dir

__all__ = ["cut", "fresh", "new_folder", "shared_dir"]

# The white space of the contracts, as a regular-expression class body.
SPACE = r"\x20\x09-\x0D"

BATCH_ROWS = 500

def row_mark(df: DataFrame) -> Column:
    """A hash of the whole row; maps have none."""
    return F.xxhash64(*(F.col(f"`{f.name}`") for f in df.schema if "map<" not in f.dataType.simpleString()))


def bitmap_rows(rows: DataFrame, column: str, bits: int) -> DataFrame:
    """part, bits: a bit for each value of a long column modulo ``bits``, a power of two, in pieces of 4 KB; bits / 8 bytes in all, whatever the number of rows."""
    bit = F.pmod(F.col(column), F.lit(bits)) + 1
    return rows.groupBy(F.bitmap_bucket_number(bit).alias("part")).agg(F.bitmap_construct_agg(F.bitmap_bit_position(bit)).alias("bits"))


def bitmap_of(rows: DataFrame, column: str, bits: int) -> np.ndarray:
    """The same as one array of bytes."""
    out = np.zeros(max(bits // 8, 4096), np.uint8)
    for r in bitmap_rows(rows, column, bits).collect():
        data = np.frombuffer(bytes(r["bits"]), np.uint8)
        out[(r["part"] - 1) * len(data) : r["part"] * len(data)] = data
    return out


def with_bit(df: DataFrame, value: Column, bitmap: DataFrame, bits: int) -> tuple[DataFrame, str]:
    """``df`` with one more column, whose name is returned: whether ``bitmap`` (as ``bitmap_rows`` makes it) has the value's bit. JVM-side; what is broadcast is bits / 8 bytes at most."""
    part, piece, out = (fresh(df.columns, f"__{x}") for x in ("bit_part", "bit_piece", "bit"))
    bit = F.pmod(value, F.lit(bits)) + 1
    side = F.broadcast(bitmap.select(F.col("part").alias(part), F.col("bits").alias(piece)))
    at = F.bitmap_bit_position(bit)
    joined = df.join(side, F.bitmap_bucket_number(bit) == F.col(part), "left")
    byte = F.conv(F.hex(F.substring(piece, (F.shiftright(at, 3) + 1).cast("int"), F.lit(1))), 16, 10).cast("int")
    return joined.withColumn(out, F.coalesce(F.getbit(byte, F.pmod(at, F.lit(8)).cast("int")) == 1, F.lit(False))).drop(part, piece), out


def in_bitmap(bitmap: np.ndarray, values: np.ndarray) -> np.ndarray:
    """Whether each of the unsigned 64-bit ``values`` has its bit set."""
    bit = values & np.uint64(len(bitmap) * 8 - 1)
    return (bitmap[(bit >> np.uint64(3)).astype(np.int64)] >> (bit & np.uint64(7)).astype(np.uint8)) & 1 != 0


def n_space_words(text: Column) -> Column:
    """Number of maximal runs without ASCII white space; null gives 0."""
    text = F.coalesce(text, F.lit(""))
    squeezed = F.length(F.regexp_replace(text, f"[{SPACE}]*[^{SPACE}]+[{SPACE}]*", "x"))
    return F.when(text.rlike(f"[^{SPACE}]"), squeezed).otherwise(0).cast("long")


def text_values(column: pa.Array | pa.ChunkedArray) -> list[bytes]:
    """The UTF-8 bytes of each text, null as empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return pc.fill_null(column, "").cast(pa.large_binary()).to_pylist()


def row_batches(batches: Iterator[pa.RecordBatch], rows: int = BATCH_ROWS) -> Iterator[pa.RecordBatch]:
    """Batches of ``rows`` at most, none empty. Spark bounds a batch's bytes (spark.sql.execution.arrow.maxBytesPerBatch); this bounds what is worked on at once."""
    for batch in batches:
        for k in range(0, batch.num_rows, rows):
            yield batch.slice(k, rows)


def whole_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Batches of numbers as they come, without empty ones."""
    return (batch for batch in batches if batch.num_rows)


# Word bytes of the letter-and-digit words: digits, lower-case letters, and every byte of a non-ASCII code point.
_LETTER = np.zeros(256, bool)
_LETTER[list(range(0x30, 0x3A)) + list(range(0x61, 0x7B)) + list(range(0x80, 0x100))] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[0x41:0x5B] += 32
_NOT_SPACE = np.ones(256, bool)
_NOT_SPACE[[0x20, 9, 10, 11, 12, 13]] = False
_MULT = np.uint64(0x9E3779B97F4A7C15)
_VALUES = (np.arange(1, 257, dtype=np.uint64) * np.uint64(0xD6E8FEB86659FD93)) ^ np.uint64(0xA5A5A5A5A5A5A5A5)
_CHUNK = 1 << 17


def _powers(base: int, n: int) -> np.ndarray:
    """1, base, base^2, ... modulo 2^64."""
    return np.concatenate((np.ones(1, np.uint64), np.cumprod(np.full(n - 1, base, np.uint64), dtype=np.uint64)))


_FORWARD, _BACK = _powers(int(_MULT), 2 * _CHUNK), _powers(pow(int(_MULT), -1, 1 << 64), 2 * _CHUNK)


def mix64(x: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers, so that their order and low bits look random."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> np.uint64(27))
    x = x * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _table_of(raw: np.ndarray, inside: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """A word's hash is the sum of its bytes' values times powers of their places in it: a difference of sums up to its end and
    its start, times the inverse of the power that the start has."""
    edge = np.flatnonzero(inside[1:] != inside[:-1]) + 1
    if len(inside) and inside[0]:
        edge = np.concatenate(([0], edge))
    if len(inside) and inside[-1]:
        edge = np.append(edge, len(inside))
    starts, ends = edge[::2], edge[1::2]
    if not len(starts):
        return starts, ends, np.zeros(0, np.uint64)
    n = len(raw)
    forward, back = (_FORWARD, _BACK) if n < len(_FORWARD) else (_powers(int(_MULT), n + 1), _powers(int(_BACK[1]), n + 1))
    sums = np.zeros(n + 1, np.uint64)
    np.cumsum(_VALUES[raw] * forward[:n], out=sums[1:])
    return starts, ends, mix64((sums[ends] - sums[starts]) * back[starts] + (ends - starts).astype(np.uint64))


def word_table(text: bytes, letters: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and 64-bit hash of each word of ``text``.

    ``letters``: words are letter-and-digit runs of text that is already in lower case; else runs without ASCII white space.
    Equal words have equal hashes; long texts go in pieces cut between words, so memory beyond the result is bounded.
    """
    raw, member = np.frombuffer(text, np.uint8), _LETTER if letters else _NOT_SPACE
    if len(raw) <= _CHUNK:
        return _table_of(raw, member[raw])
    parts, at = [], 0
    while at < len(raw):
        stop = min(at + _CHUNK, len(raw))
        while stop < len(raw) and member[raw[stop - 1]] and member[raw[stop]]:
            stop += 1
        s, e, h = _table_of(raw[at:stop], member[raw[at:stop]])
        parts.append((s + at, e + at, h))
        at = stop
    return tuple(np.concatenate(x) for x in zip(*parts, strict=True))


def lowered(text: bytes) -> bytes:
    """A-Z to lower case, all else unchanged."""
    return text.lower()


def window_hashes(hashes: np.ndarray, width: int) -> np.ndarray:
    """One hash for each run of ``width`` consecutive words."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for k in range(width):
        total = total * _MULT + hashes[k : k + n]
    return mix64(total)
