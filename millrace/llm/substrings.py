"""Substring dedup by super-k-mer partitioning.

A window is WINDOW consecutive words of one document. Its minimiser is the least hash among its MINIMISER-word grams;
consecutive windows with the same minimiser overlap in one run of words, the super-k-mer, which travels as one packed
string to the minimiser's bucket. There the windows of all packed strings are sorted and compared exactly, so equal windows
meet in one bucket wherever they lie; a word covered by a window that also starts in a smaller doc_id is removed.

Two things keep this small. Minimisers are counted first, as pre-aggregated hashes, and only super-k-mers whose minimiser
is in two documents or more are packed and shuffled. And a minimiser found in many documents is salted: its documents go to
several buckets, each of which settles what it can (equal packed strings once, windows after its own least document) and
passes on one row per distinct window, by a 128-bit digest, to be compared across salts by a pre-aggregated minimum.

Edge cases: null text has no words; texts of fewer than WINDOW words are never changed; rows with equal doc_id are one
document, so they never remove each other's words, and repeated rows fare alike; a null doc_id neither removes nor loses
words; an empty table gives no rows; texts of any length go through whole; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

import hashlib
from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bitmap_of, cut, in_bitmap, mix64, row_batches, text_values, window_hashes, word_table

WINDOW = 50
MINIMISER = 8
SALT_OVER = 256
BITMAP = 1 << 25


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Minimum of each ``width`` consecutive values, by doubling."""
    done, out = 1, x
    while done * 2 <= width:
        out = np.minimum(out[: len(out) - done], out[done:])
        done *= 2
    return np.minimum(out[: len(x) - width + 1], out[width - done : width - done + len(x) - width + 1])


def super_kmers(hashes: np.ndarray, window: int = WINDOW, gram: int = MINIMISER) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Of a document's word hashes: minimiser, first window and number of windows of each super-k-mer."""
    if len(hashes) < window:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    least = sliding_min(mix64(window_hashes(hashes, gram)), window - gram + 1)
    first = np.concatenate(([0], np.flatnonzero(least[1:] != least[:-1]) + 1))
    return least[first], first, np.diff(np.append(first, len(least)))


def _minimisers(window: int, gram: int) -> Callable:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            found = [np.unique(super_kmers(word_table(t, False)[2], window, gram)[0]) for t in text_values(batch.column(2))]
            at = np.repeat(np.arange(len(found)), [len(x) for x in found])
            yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), batch.column(1).take(pa.array(at)), pa.array(np.concatenate(found).view(np.int64))], names=["doc_id", "mark", "mini"])

    return run


def _pack(window: int, gram: int) -> Callable:
    schema = pa.schema([("mini", pa.int64()), ("salt", pa.int32()), ("salted", pa.bool_()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("packed", pa.binary())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            rows: list[tuple] = []
            for doc_id, mark, text, minis, salts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_values(batch.column(2)), batch.column(3).to_pylist(), batch.column(4).to_pylist(), strict=True):
                if not minis:
                    continue
                wanted = dict(zip(minis, salts, strict=True))
                doc_salt = int(mix64(np.array([doc_id], np.int64).view(np.uint64))[0])
                starts, ends, hashes = word_table(text, False)
                mini, first, count = super_kmers(hashes, window, gram)
                for m, s, n in zip(mini.view(np.int64).tolist(), first.tolist(), count.tolist(), strict=True):
                    k = wanted.get(m)
                    if k:
                        packed = b" ".join(text[starts[s] : ends[s + n + window - 2]].split())
                        rows.append((m, doc_salt % k, k > 1, doc_id, mark, s, packed))
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _windows(packed: bytes, window: int) -> Iterator[bytes]:
    lengths = [len(w) + 1 for w in packed.split(b" ")]
    ends = np.cumsum(lengths)
    starts, n = (ends - lengths).tolist(), len(lengths) - window + 1
    return (packed[s:e] for s, e in zip(starts[:n], (ends - 1)[window - 1 :].tolist(), strict=True))


def bucket(rows: list[tuple[int, int, int, bytes]], window: int, salted: bool) -> tuple[list[tuple], list[tuple]]:
    """``rows`` (doc_id, mark, start, packed) of one bucket. Returns covered ranges (doc_id, mark, from, to), and if salted
    what is open: (digest, doc_id, mark, window start) of windows in the bucket's least document that has them."""
    same: dict[bytes, list[tuple[int, int, int]]] = defaultdict(list)
    for doc_id, mark, start, packed in rows:
        same[packed].append((doc_id, mark, start))
    if not salted and len({r[0] for r in rows}) < 2:
        return [], []
    # distinct windows get numbers; each comes with the least document of every packed string that holds it
    number: dict[bytes, int] = {}
    strings = {p: [number.setdefault(w, len(number)) for w in _windows(p, window)] for p in same}
    names = list(number)
    held = sorted((names[k], min(same[p])[0], k) for p, ks in strings.items() for k in set(ks))
    # sorted, equal windows are neighbours, and the first has their least document
    least, digests, previous = [0] * len(names), [b""] * len(names), None
    for w, doc_id, k in held:
        if w != previous:
            previous, least[k] = w, doc_id
            if salted:
                digests[k] = hashlib.blake2b(w, digest_size=16).digest()
    ranges, open_ = [], []
    for p, ks in strings.items():
        for doc_id, mark, start in same[p]:
            run = None
            for i, k in enumerate(ks, start):
                if least[k] < doc_id:
                    if run is not None and i <= run[1]:
                        run[1] = i + window
                    else:
                        if run is not None:
                            ranges.append((doc_id, mark, *run))
                        run = [i, i + window]
                elif salted:
                    open_.append((digests[k], doc_id, mark, i))
            if run is not None:
                ranges.append((doc_id, mark, *run))
    return ranges, open_


def _buckets(window: int) -> Callable:
    schema = pa.schema([("digest", pa.binary()), ("doc_id", pa.int64()), ("mark", pa.int64()), ("start", pa.int64()), ("stop", pa.int64())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key, held, out = None, [], []

        def full() -> pa.RecordBatch:
            made = pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*out, strict=True), schema, strict=True)], schema=schema)
            out.clear()
            return made

        def settle() -> None:
            ranges, open_ = bucket(held, window, key[2])
            out.extend((None, *r) for r in ranges)
            out.extend((d, doc_id, mark, s, s + window) for d, doc_id, mark, s in open_)

        for batch in row_batches(batches):
            for mini, salt, salted, *row in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (mini, salt, salted) != key:
                    if held:
                        settle()
                        if len(out) > 5000:
                            yield full()
                    key, held = (mini, salt, salted), []
                held.append(tuple(row))
        if held:
            settle()
        if out:
            yield full()

    return run


def covered(docs: DataFrame, window: int = WINDOW, gram: int = MINIMISER, salt_over: int = SALT_OVER) -> DataFrame:
    """``docs``: doc_id (long), mark (a hash of the text), text. One row per document that loses words: doc_id, mark, ranges (array of start, stop)."""
    minis = cut(docs.where(F.col("doc_id").isNotNull()).mapInArrow(_minimisers(window, gram), "doc_id long, mark long, mini long"))
    counts = minis.groupBy("mini").agg(F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    shared = counts.select(F.col("mini").alias("m"), F.ceil(F.col("n") / salt_over).cast("int").alias("salts"))
    of_doc = minis.join(shared, F.col("mini") == F.col("m")).groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("k")).agg(F.collect_list(F.struct("mini", "salts")).alias("s"))
    wanted = docs.join(of_doc, (F.col("doc_id") == F.col("d")) & (F.col("mark") == F.col("k")), "left").select("doc_id", "mark", "text", F.col("s.mini").alias("minis"), F.col("s.salts").alias("salts"))
    packed = wanted.mapInArrow(_pack(window, gram), "mini long, salt int, salted boolean, doc_id long, mark long, start long, packed binary")
    sorted_ = packed.repartition("mini", "salt").sortWithinPartitions("mini", "salt")
    found = cut(sorted_.mapInArrow(_buckets(window), "digest binary, doc_id long, mark long, start long, stop long"))
    open_ = found.where(F.col("digest").isNotNull())
    least = open_.groupBy(F.col("digest").alias("g")).agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high").select("g", "low")
    late = open_.join(least, F.col("digest") == F.col("g")).where(F.col("doc_id") > F.col("low"))
    ranges = found.where(F.col("digest").isNull()).select("doc_id", "mark", "start", "stop").union(late.select("doc_id", "mark", "start", "stop"))
    return ranges.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("k")).agg(F.collect_list(F.struct("start", "stop")).alias("ranges"))


def kept_words(text: bytes, ranges: list[dict] | None) -> tuple[int, list[bytes]]:
    """Number of words of ``text``, and those outside the ranges."""
    words = text.split()
    if not ranges:
        return len(words), words
    out, at = [], 0
    for start, stop in sorted((r["start"], r["stop"]) for r in ranges):
        if start > at:
            out.extend(words[at:start])
        at = max(at, stop)
    return len(words), out + words[at:]


def _without(ranges_of: np.ndarray) -> Callable:
    """doc_id, mark, then of texts that surely lose nothing what ``removals`` returns, of others the text."""
    schema = pa.schema([("doc_id", pa.int64()), ("mark", pa.int64()), ("text", pa.string()), ("n_words", pa.int64()), ("kept_sha256", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            open_ = in_bitmap(ranges_of, batch.column(1).to_numpy(zero_copy_only=False).view(np.uint64))
            rows = []
            for doc_id, mark, text, concerned in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_values(batch.column(2)), open_.tolist(), strict=True):
                words = [] if concerned else text.split()
                rows.append((doc_id, mark, text.decode(), None, None) if concerned else (doc_id, mark, None, len(words), hashlib.sha256(b" ".join(words)).hexdigest()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in row_batches(batches):
        rows = []
        for doc_id, text, ranges in zip(batch.column(0).to_pylist(), text_values(batch.column(1)), batch.column(2).to_pylist(), strict=True):
            n, kept = kept_words(text, ranges)
            rows.append((doc_id, n, n - len(kept), hashlib.sha256(b" ".join(kept)).hexdigest()))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string())
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=["doc_id", "n_words", "n_removed", "kept_sha256"])


def _rows(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text}`").alias("mark"), F.col(f"`{text}`").alias("text"))


def removals(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_removed, kept_sha256. A bitmap of the texts that lose words keeps most others from being shuffled."""
    rows = _rows(docs, doc_id, text)
    ranges = cut(covered(rows))
    parts = cut(rows.mapInArrow(_without(bitmap_of(ranges, "k", BITMAP)), "doc_id long, mark long, text string, n_words long, kept_sha256 string"))
    whole = parts.where(F.col("text").isNull()).select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), "kept_sha256")
    open_ = parts.where(F.col("text").isNotNull()).join(ranges, (F.col("doc_id") == F.col("d")) & (F.col("mark") == F.col("k")), "left")
    return whole.unionAll(open_.select("doc_id", "text", "ranges").mapInArrow(_digest, "doc_id long, n_words long, n_removed long, kept_sha256 string"))


def _apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in row_batches(batches):
        texts = [b" ".join(kept_words(t, r)[1]).decode() if r else t.decode() for t, r in zip(text_values(batch.column(1)), batch.column(2).to_pylist(), strict=True)]
        yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts), batch.column(2)], names=["doc_id", "text", "ranges"])


def deduplicated(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, text without the repeated passages (words joined by one space where any was removed), ranges of removed words."""
    rows = _rows(docs, doc_id, text)
    joined = rows.join(cut(covered(rows)), (F.col("doc_id") == F.col("d")) & (F.col("mark") == F.col("k")), "left")
    return joined.select("doc_id", "text", "ranges").mapInArrow(_apply, "doc_id long, text string, ranges array<struct<start:long,stop:long>>")
