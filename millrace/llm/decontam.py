"""Benchmark decontamination by a prefix-filtered set join.

Every benchmark item becomes windows of WINDOW consecutive words (a shorter item is one window), every window a set of
positioned word shingles. Containment must be exact, so one shingle of a window is a necessary prefix: the rarest one, by a
count over all documents. Documents' shingles are joined with those prefixes; the position of the hit in the window and in the
document fixes where the window would start, bounds on that start and on the document's length drop what can't fit, and what
is left is verified word for word.

Both sides are tables, whatever their sizes: no index of the benchmark is built in the driver or in a task. What goes to all
tasks is a bitmap of shingle hashes, BITMAP bits at any size, which keeps all but a few of the documents' shingles from being
shuffled; a fuller bitmap lets more through, and the join decides. A shingle travels with the words around it, so texts aren't
shuffled. Documents are scanned twice, for the counts and for the prefixes, however large the benchmark is.

Edge cases: null or wordless text has no words and isn't contaminated; items without words, with a null id or null text
are no items; items with equal words are all reported; an item_id that occurs twice is reported once; empty tables give
uncontaminated documents or no rows; repeated documents are judged alike; long texts are scanned whole, a piece of their words
at a time; extra columns of ``docs`` pass through ``clean`` unchanged, whatever their names, and are ignored elsewhere.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from millrace.llm.common import bitmap_of, cut, fresh, in_bitmap, lowered, row_batches, text_values, window_hashes, word_table

WINDOW = 10
SHINGLE = 5
BITMAP = 1 << 25
FLUSH = 200_000


def _item_windows(window: int) -> Callable:
    """id, words (of a window, joined), n (their number), shingles (hashes by position) of each distinct window of an item."""
    schema = pa.schema([("id", pa.string()), ("words", pa.string()), ("n", pa.int32()), ("q", pa.int32()), ("shingles", pa.list_(pa.int64()))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in row_batches(batches):
            rows: list[tuple] = []
            for item, text in zip(batch.column(0).to_pylist(), text_values(batch.column(1)), strict=True):
                low = lowered(text)
                starts, ends, hashes = word_table(low, True)
                n = min(window, len(starts))
                q = min(SHINGLE, n)
                grams, seen = window_hashes(hashes, q).view(np.int64) if n else None, set()
                for i in range(len(starts) - n + 1 if n else 0):
                    words = b" ".join(low[a:b] for a, b in zip(starts[i : i + n].tolist(), ends[i : i + n].tolist(), strict=True))
                    if words not in seen:
                        seen.add(words)
                        rows.append((item, words.decode(), n, q, grams[i : i + n - q + 1].tolist()))
                        if len(rows) >= 10_000:
                            yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)
                            rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t.type) for c, t in zip(zip(*rows, strict=True), schema, strict=True)], schema=schema)

    return run


def _counter(bitmap: np.ndarray, widths: list[int]) -> Callable:
    """(hash, n): how often shingles that are in the bitmap occur, summed in each task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def full() -> pa.RecordBatch:
            hashes, n = np.unique(np.concatenate(held), return_counts=True)
            held.clear()
            return pa.RecordBatch.from_arrays([pa.array(hashes.view(np.int64)), pa.array(n.astype(np.int64))], names=["hash", "n"])

        for batch in row_batches(batches):
            for text in text_values(batch.column(0)):
                hashes = word_table(lowered(text), True)[2]
                for q in widths:
                    grams = window_hashes(hashes, q)
                    found = grams[in_bitmap(bitmap, grams)]
                    if len(found):
                        held.append(found)
                        size += len(found)
                if size > FLUSH:
                    yield full()
                    size = 0
        if held:
            yield full()

    return run


def _scanner(bitmap: np.ndarray, widths: list[int], window: int) -> Callable:
    """A row for each document (at is null), and one for each of its shingles in the bitmap, with the words around it."""
    kinds = (pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.int64(), pa.string())
    names = ("doc_id", "mark", "n_words", "at", "hash", "low", "around")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rows: list[tuple] = []

        def full() -> pa.RecordBatch:
            out = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names=names)
            rows.clear()
            return out

        for batch in row_batches(batches):
            for doc_id, mark, text in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), text_values(batch.column(2)), strict=True):
                low = lowered(text)
                starts, ends, hashes = word_table(low, True)
                n = len(starts)
                rows.append((doc_id, mark, n, None, None, None, None))
                for q in widths:
                    grams = window_hashes(hashes, q)
                    for at in np.flatnonzero(in_bitmap(bitmap, grams)).tolist():
                        a, b = max(0, at - window + 1), min(n, at + window)
                        around = b" ".join(low[x:y] for x, y in zip(starts[a:b].tolist(), ends[a:b].tolist(), strict=True))
                        rows.append((doc_id, mark, n, at, int(grams[at : at + 1].view(np.int64)[0]), a, around.decode()))
                        if len(rows) >= 10_000:
                            yield full()
            if rows:
                yield full()

    return run


def item_windows(benchmark: DataFrame, item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """id (as a string), words, n, q, shingles: the windows of all items."""
    items = benchmark.where(F.col(f"`{item_id}`").isNotNull() & F.col(f"`{item_text}`").isNotNull()).select(F.col(f"`{item_id}`").cast("string").alias("id"), F.col(f"`{item_text}`").alias("t"))
    return cut(items.mapInArrow(_item_windows(window), "id string, words string, n int, q int, shingles array<long>").distinct())


def prefixes(rows: DataFrame, windows: DataFrame, widths: list[int]) -> DataFrame:
    """``rows``: doc_id, mark, text. hash, offset, words, n: each distinct window with its rarest shingle, and where that is in the window."""
    shingles = windows.select("words", "n", F.posexplode("shingles").alias("offset", "hash")).distinct()
    counts = rows.select("text").mapInArrow(_counter(bitmap_of(shingles, "hash", BITMAP), widths), "hash long, n long").groupBy("hash").agg(F.sum("n").alias("count"))
    ranked = shingles.join(counts, "hash", "left").groupBy("words", "n").agg(F.min(F.struct(F.coalesce("count", F.lit(0)).alias("count"), "hash", "offset")).alias("least"))
    return cut(ranked.select(F.col("least.hash").alias("hash"), F.col("least.offset").alias("offset"), "words", "n"))


def occurrences(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text", item_id: str = "item_id", item_text: str = "text", window: int = WINDOW) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Three tables: documents (doc_id, mark, n_words); found (doc_id, mark, start, stop, words), each occurrence of a window once for equal documents; windows (id, words)."""
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.xxhash64(f"`{text}`").alias("mark"), F.col(f"`{text}`").alias("text"))
    windows = item_windows(benchmark, item_id, item_text, window)
    widths = sorted(r["q"] for r in windows.select("q").distinct().collect())  # SHINGLE values at most
    first = prefixes(rows, windows, widths)
    scanned = cut(rows.mapInArrow(_scanner(bitmap_of(first, "hash", BITMAP), widths, window), "doc_id long, mark long, n_words long, at long, hash long, low long, around string"))
    met = scanned.where(F.col("at").isNotNull()).join(first, "hash").withColumn("start", F.col("at") - F.col("offset"))
    met = met.where((F.col("start") >= F.col("low")) & (F.col("start") + F.col("n") <= F.col("n_words")))
    there = F.array_join(F.slice(F.split("around", " "), (F.col("start") - F.col("low") + 1).cast("int"), F.col("n")), " ")
    found = met.where(there == F.col("words")).select("doc_id", "mark", "start", (F.col("start") + F.col("n")).alias("stop"), "words")
    return scanned.where(F.col("at").isNull()).select("doc_id", "mark", "n_words"), cut(found.distinct()), windows.select("id", "words")


def contamination(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    documents, found, windows = occurrences(docs, benchmark, doc_id, text)
    spans = found.groupBy(F.col("doc_id").alias("d"), F.col("mark").alias("k")).agg(F.array_sort(F.collect_set(F.struct("start", "stop"))).alias("spans"))
    zero = F.struct(F.lit(0).cast("long").alias("total"), F.lit(0).cast("long").alias("last"))
    covered = F.aggregate("spans", zero, lambda s, x: F.struct((s["total"] + F.greatest(F.lit(0), x["stop"] - F.greatest(x["start"], s["last"]))).alias("total"), F.greatest(s["last"], x["stop"]).alias("last")))
    hit = spans.select("d", "k", covered["total"].alias("n_hit"))
    ids = found.select("doc_id", "mark", "words").distinct().join(windows, "words").groupBy(F.col("doc_id").alias("d2"), F.col("mark").alias("k2")).agg(F.array_sort(F.collect_set("id")).alias("ids"))
    out = documents.join(hit, F.col("doc_id").eqNullSafe(F.col("d")) & (F.col("mark") == F.col("k")), "left").join(ids, F.col("doc_id").eqNullSafe(F.col("d2")) & (F.col("mark") == F.col("k2")), "left")
    ids = F.coalesce("ids", F.array().cast("array<string>"))
    return out.select("doc_id", "n_words", F.coalesce("n_hit", F.lit(0)).cast("long").alias("n_hit"), F.size(ids).cast("long").alias("n_items"), F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"), F.col("n_hit").isNotNull().alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of ``docs`` in which no item window occurs, columns unchanged."""
    d, k = (fresh(docs.columns, f"__{x}") for x in ("d", "k"))
    dirty = cut(occurrences(docs, benchmark, doc_id, text)[1].select(F.col("doc_id").alias(d), F.col("mark").alias(k)).distinct())
    # a written table has a known size: Spark broadcasts it if that is small, else it is a shuffled join
    return docs.join(dirty, F.col(f"`{doc_id}`").cast("long").eqNullSafe(F.col(d)) & (F.xxhash64(f"`{text}`") == F.col(k)), "left_anti")
