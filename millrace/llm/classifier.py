"""Quality classifier by compression.

Two zstandard dictionaries are built, from good and from bad labelled text. A text is cut into pieces of CHUNK bytes, each
compressed with either dictionary; g and b are the summed sizes. The score is logistic in the normalised difference
(g - b) / (g + b) and in the compression ratio min(g, b) / bytes, calibrated on labelled rows that no dictionary has seen,
weighted to the classes' shares among all labelled rows.

Fitting uses a bounded sample: SAMPLE rows of each class at most, those with the smallest hash of doc_id; of those, the
dictionaries see SAMPLE_CHARS characters each, whole pieces of CHUNK characters chosen by hash from the whole text. Calibration
and scoring use whole texts on the executors.

Edge cases: null and empty texts have difference 0 and ratio 1, scored like any other; labels that are null, or of rows in
the held-out fold, are never read; a row labelled twice counts with its lower label; if a class has no labelled text, all
scores are the smoothed share of good labels (0.5 without labels); repeated rows, and rows that tie, are scored alike; long texts
are compressed whole, piece by piece; extra columns pass through ``with_scores`` unchanged, whatever their names.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.llm.common import cut, fresh, row_batches, text_values

SAMPLE = 2000
SAMPLE_CHARS = 8192
DICTIONARY = 112_640
CHUNK = 1024
LEVEL = 3
THRESHOLD = 0.7


def spread(text: Column, key: Column) -> Column:
    """Short texts whole; of longer ones, the SAMPLE_CHARS / CHUNK pieces with the least hash, in the order of the text."""
    n = F.ceil(F.length(text) / CHUNK).cast("int")
    drawn = F.transform(F.sequence(F.lit(0), n - 1), lambda i: F.struct(F.xxhash64(key, i).alias("hash"), i.alias("at")))
    ats = F.array_sort(F.transform(F.slice(F.array_sort(drawn), 1, SAMPLE_CHARS // CHUNK), lambda x: x["at"]))
    return F.when(F.length(text) <= SAMPLE_CHARS, text).otherwise(F.array_join(F.transform(ats, lambda i: F.substring(text, i * CHUNK + 1, F.lit(CHUNK))), ""))


def held_out(doc_id: Column) -> Column:
    """The fold that learning never sees."""
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def dictionary(texts: list[str]) -> bytes:
    """A trained dictionary; where there is too little text to train on, pieces of it at even distances, DICTIONARY bytes at most."""
    raw = [x.encode() for x in texts]
    pieces = [x[k : k + CHUNK] for x in raw for k in range(0, len(x), CHUNK)]
    try:
        return zstandard.train_dictionary(DICTIONARY, pieces).as_bytes()
    except zstandard.ZstdError:
        step = -(-len(pieces) // (DICTIONARY // CHUNK))
        return b"".join(pieces[::step])


class Measure:
    """(normalised difference, ratio) of a text."""

    def __init__(self, good: bytes, bad: bytes):
        self.press = []
        for data in (good, bad):
            d = zstandard.ZstdCompressionDict(data)
            d.precompute_compress(level=LEVEL)
            self.press.append(zstandard.ZstdCompressor(level=LEVEL, dict_data=d, write_content_size=False, write_checksum=False, write_dict_id=False))

    def __call__(self, text: bytes) -> tuple[float, float]:
        if not text:
            return 0.0, 1.0
        pieces = [text[k : k + CHUNK] for k in range(0, len(text), CHUNK)]
        g, b = (sum(len(p.compress(x)) for x in pieces) for p in self.press)
        return (g - b) / (g + b), min(g, b) / len(text)


def _measured(good: bytes, bad: bytes, text_at: int, keep_text: bool) -> Callable:
    """The columns, with or without the text's, then difference and ratio."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        measure = Measure(good, bad)
        for batch in row_batches(batches):
            x = np.array([measure(t) for t in text_values(batch.column(text_at))])
            columns = [*(c for k, c in enumerate(batch.columns) if keep_text or k != text_at), pa.array(x[:, 0]), pa.array(x[:, 1])]
            yield pa.RecordBatch.from_arrays(columns, names=[f"c{k}" for k in range(len(columns))])

    return run


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, rounds: int = 60, ridge: float = 1e-3) -> np.ndarray:
    """Weights of a ridge-regularised logistic regression, by Newton's method."""
    a, w = np.column_stack([np.ones(len(x)), x]), np.zeros(x.shape[1] + 1)
    for _ in range(rounds):
        p = 1 / (1 + np.exp(-np.clip(a @ w, -30, 30)))
        slope = a.T @ ((p - y) * weight) + ridge * w
        curve = (a * (p * (1 - p) * weight)[:, None]).T @ a + ridge * np.eye(len(w))
        step = np.linalg.solve(curve, slope)
        w = w - step
        if np.abs(step).max() < 1e-8:
            break
    return w


class Model:
    """Dictionaries and calibration; small and picklable."""

    def __init__(self, good: bytes = b"", bad: bytes = b"", weights: list[float] | None = None, prior: float = 0.5):
        self.good, self.bad, self.weights, self.prior = good, bad, weights, prior

    def with_scores(self, docs: DataFrame, text: str = "text") -> tuple[DataFrame, str]:
        """``docs`` with one more column, whose name is returned: the score of each row."""
        name = fresh(docs.columns, "score")
        if self.weights is None:
            return docs.withColumn(name, F.lit(self.prior)), name
        d, r = (fresh(docs.columns, f"__{x}") for x in ("difference", "ratio"))
        kinds = [*(f.dataType for f in docs.schema), T.DoubleType(), T.DoubleType()]
        rows = docs.mapInArrow(_measured(self.good, self.bad, docs.columns.index(text), True), T.StructType([T.StructField(f"c{k}", x) for k, x in enumerate(kinds)])).toDF(*docs.columns, d, r)
        w0, w1, w2 = self.weights
        return rows.select(*(F.col(f"`{c}`") for c in docs.columns), (1 / (1 + F.exp(-(w0 + w1 * F.col(d) + w2 * F.col(r))))).alias(name)), name

    def score(self, docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
        """doc_id, score."""
        scored, name = self.with_scores(docs.select(F.col(f"`{doc_id}`").cast("long").alias("doc_id"), F.col(f"`{text}`").alias("text")), "text")
        return scored.select("doc_id", F.col(name).alias("score"))


def fit(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text", label: str = "quality", sample: int = SAMPLE) -> Model:
    """Learns from rows of ``labels`` (doc_id, label) outside the held-out fold."""
    spark = docs.sparkSession
    known = labels.where(F.col("doc_id").isNotNull() & F.col(f"`{label}`").isNotNull() & ~held_out(F.col("doc_id")))
    known = cut(known.groupBy(F.col("doc_id").cast("long").alias("id")).agg(F.least(F.min(f"`{label}`"), F.lit(1)).cast("int").alias("y")))
    shares = {r["y"]: r["n"] for r in known.groupBy("y").agg(F.count("*").alias("n")).collect()}
    good, bad = shares.get(1, 0), sum(n for y, n in shares.items() if y != 1)
    prior = (good + 1) / (good + bad + 2)
    chosen = [r for y in (True, False) for r in known.where((F.col("y") == 1) == y).orderBy(F.xxhash64("id"), "id").limit(sample).collect()]
    if not good or not bad:
        return Model(prior=prior)
    # the sample is bounded by its parameter, so it may be broadcast
    ids = F.broadcast(spark.createDataFrame([(r["id"], int(r["y"] == 1)) for r in chosen], "id long, y int"))
    rows = docs.select(F.col(f"`{doc_id}`").cast("long").alias("id"), F.coalesce(F.col(f"`{text}`"), F.lit("")).alias("text")).join(ids, "id")
    for_dictionary = F.pmod(F.xxhash64("id", F.lit(1)), F.lit(2)) == 0
    seen = rows.where(for_dictionary).select("y", spread(F.col("text"), F.col("id")).alias("t")).limit(2 * sample).collect()
    texts = [sorted(r["t"] for r in seen if r["y"] == y and r["t"]) for y in (1, 0)]
    if not all(texts):
        return Model(prior=prior)
    dictionaries = [dictionary(x) for x in texts]
    table = rows.where(~for_dictionary).select("text", "y").mapInArrow(_measured(*dictionaries, 0, False), "y int, difference double, ratio double").limit(2 * sample).collect()
    x, y = np.array([(r["difference"], r["ratio"]) for r in table]).reshape(-1, 2), np.array([r["y"] for r in table])
    if len(set(y.tolist())) < 2:
        return Model(prior=prior)
    order = np.lexsort((x[:, 1], x[:, 0], y))
    x, y = x[order], y[order]
    weight = np.where(y == 1, good / (y == 1).sum(), bad / (y == 0).sum())
    w = logistic(x * 10, y, weight / weight.mean())
    return Model(*dictionaries, [float(w[0]), *(float(v) * 10 for v in w[1:])], prior)


def classify(docs: DataFrame, labels: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per document: doc_id, held_out, score, predicted."""
    scored = fit(docs, labels, doc_id, text).score(docs, doc_id, text)
    return scored.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))
