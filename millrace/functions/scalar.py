"""Scalar functions on columns."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

# Accepted forms of time stamps without a zone, taken as UTC. RFC 3339 is tried first.
NAIVE_FORMS = ["y-M-d'T'H:m:s[.SSSSSS]", "y-M-d H:m:s[.SSSSSS]", "y-M-d'T'H:m", "y-M-d H:m", "y-M-d'T'H", "y-M-d H", "y-M-d"]


def div(a: Column, b: Column) -> Column:
    """Integral division, exact over all of a long."""
    return F.call_function("div", a, b)


def parse_time(c: Column) -> Column:
    """RFC 3339, then naive forms down to a date, as UTC; null if none fits. Fractions of a second have any length, and count to the microsecond."""
    short = F.regexp_replace(c, r"(\.[0-9]{6})[0-9]+", "$1")
    naive = F.concat(short, F.lit("Z"))
    return F.coalesce(F.try_to_timestamp(short, F.lit("yyyy-MM-dd'T'HH:mm:ss[.SSSSSS]XXX")), *(F.try_to_timestamp(naive, F.lit(f"{f}X")) for f in NAIVE_FORMS))


def format_time(c: Column) -> Column:
    """RFC 3339 in UTC."""
    return F.date_format(c, "yyyy-MM-dd'T'HH:mm:ss.SSSSSSxxx")


def from_unit(c: Column, unit: str) -> Column:
    """A time stamp from a count of s, ms, us or ns since the epoch."""
    if unit == "ns":
        n = c.cast("long")
        return F.timestamp_micros(div(n - F.pmod(n, F.lit(1000).cast("long")), F.lit(1000).cast("long")))
    return {"s": F.timestamp_seconds, "ms": F.timestamp_millis, "us": F.timestamp_micros}[unit](c)


def prefix(c: Column, text: str = "Prefixed: ") -> Column:
    return F.concat(F.lit(text), c)


def transform_text(c: Column, before: str = "", after: str = "", upper: bool = False) -> Column:
    """before + text, in upper case if asked for, + after as it is."""
    body = F.concat(F.lit(before), c)
    return F.concat(F.upper(body) if upper else body, F.lit(after))


def transform_texts(c: Column, before: str = "", after: str = "", upper: bool = False) -> Column:
    return F.transform(c, lambda x: transform_text(x, before, after, upper))


def bounded_add(c: Column, step: Column, low: int = 0, high: int = 2**63 - 1) -> Column:
    """Saturating sum."""
    return F.greatest(F.lit(low).cast("decimal(20,0)"), F.least(F.lit(high).cast("decimal(20,0)"), c.cast("decimal(20,0)") + step.cast("decimal(20,0)"))).cast("long")


def parse_unsigned(c: Column) -> Column:
    """Digits only, up to 2^64 - 1; else null."""
    wide = F.when(c.rlike(r"^\+?[0-9]+$"), c.try_cast("decimal(38,0)"))
    return F.when(wide <= F.lit(str(2**64 - 1)).cast("decimal(20,0)"), wide.cast("decimal(20,0)"))


def embedding_text(message: Column, embedding: Column) -> Column:
    return F.format_string("Embedding of %s has %d", message, F.size(embedding))


def preview(c: Column, chars: int = 100) -> Column:
    """The first ``chars`` characters, cut back to a word's end where there is one."""
    cut = F.regexp_extract(c, rf"^(?s)(.{{0,{chars}}})(?=\s|$)", 1)
    return F.when(F.length(c) <= chars, c).when(cut != "", F.rtrim(cut)).otherwise(F.left(c, F.lit(chars)))


def url_allowed(url: Column, patterns: list[str]) -> Column:
    """Equal to a pattern, below it as a path, or if the pattern ends in `/*`, starting with what comes before that."""
    out = F.lit(False)
    for p in patterns:
        out = out | (url == p) | F.startswith(url, F.lit(f"{p}/"))
        if p.endswith("/*"):
            out = out | F.startswith(url, F.lit(p[:-2]))
    return out


def method_allowed(method: Column, methods: list[str]) -> Column:
    return F.upper(method).isin([m.upper() for m in methods])


def gcd_column(a: Column, b: Column) -> Column:
    """Greatest common divisor by a bounded fold of Euclid's steps; JVM-side."""
    start = F.struct(F.abs(a).cast("long").alias("x"), F.abs(b).cast("long").alias("y"))
    step = lambda s, _: F.when(s["y"] == 0, s).otherwise(F.struct(s["y"].alias("x"), F.pmod(s["x"], F.when(s["y"] == 0, 1).otherwise(s["y"])).alias("y")))
    return F.aggregate(F.sequence(F.lit(1), F.lit(92)), start, step, lambda s: s["x"])


def lcm_column(a: Column, b: Column) -> Column:
    g = gcd_column(a, b)
    return F.when(g == 0, F.lit(0).cast("long")).otherwise(div(F.abs(a).cast("long"), F.when(g == 0, F.lit(1).cast("long")).otherwise(g)) * F.abs(b).cast("long"))


def trunc_number(c: Column) -> Column:
    return F.when(c < 0, F.ceil(c)).otherwise(F.floor(c))


def _crc_tables() -> tuple[np.ndarray, np.ndarray]:
    """What one byte does, and what two bytes do."""
    one = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        one = np.where(one & 1, (one >> 1) ^ np.uint32(0x82F63B78), one >> 1)
    two = np.arange(65536, dtype=np.uint32)
    for _ in range(2):
        two = one[two & 255] ^ (two >> 8)
    return one, two


_ONE, _TWO = _crc_tables()


def crc32c_many(data: list[bytes]) -> np.ndarray:
    """CRC-32C of each, all side by side, two bytes a step."""
    sizes = np.array([len(x) for x in data], np.int64)
    order = np.argsort(-sizes, kind="stable")
    sizes, crc = sizes[order], np.full(len(data), 0xFFFFFFFF, np.uint32)
    flat = np.frombuffer(b"".join([data[k] for k in order]), np.uint8)
    starts = np.concatenate(([0], np.cumsum(sizes)[:-1])) if len(data) else sizes
    live = len(data)
    for at in range(0, int(sizes[0]) - 1 if len(data) else 0, 2):
        while live and sizes[live - 1] < at + 2:  # the shortest come last
            live -= 1
        here = starts[:live] + at
        word = flat[here].astype(np.uint32) | flat[here + 1].astype(np.uint32) << np.uint32(8)
        crc[:live] = _TWO[(crc[:live] ^ word) & 0xFFFF] ^ (crc[:live] >> 16)
    odd = np.flatnonzero(sizes % 2)
    crc[odd] = _ONE[(crc[odd] ^ flat[starts[odd] + sizes[odd] - 1]) & 255] ^ (crc[odd] >> 8)
    out = np.empty(len(data), np.uint32)
    out[order] = crc ^ np.uint32(0xFFFFFFFF)
    return out


def crc32c_bytes(data: bytes) -> int:
    return int(crc32c_many([data])[0])


@F.pandas_udf(T.LongType())
def crc32c(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    """CRC-32C of UTF-8 text; Spark has the other polynomial only."""
    for s in parts:
        there = s.notna()
        out = pd.Series(pd.NA, index=s.index, dtype="Int64")
        out[there] = crc32c_many([x.encode() if isinstance(x, str) else bytes(x) for x in s[there]]).astype(np.int64)
        yield out
