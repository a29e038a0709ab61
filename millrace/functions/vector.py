"""Vectors: text embedding, cosine similarity, top-k search."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace.storage import new_folder

DIMENSIONS = 384
BLOCK_BYTES = 8 << 20  # of queries, as doubles
BLOCK_ROWS = 1 << 14
TILE = 1 << 20  # numbers in one array of a worker
MARGIN = 1e-9  # far more than a matrix product's rounding
OUT_ROWS = 1 << 12
TASKS = 4  # for each core


def embed(text: bytes, dimensions: int = DIMENSIONS) -> np.ndarray:
    """Bytes / 255 summed into buckets by position, L2-normalised, in 32-bit floats."""
    raw = np.frombuffer(text, np.uint8).astype(np.float32) / np.float32(255)
    padded = np.pad(raw, (0, -len(raw) % dimensions)).reshape(-1, dimensions)
    out = padded.sum(axis=0, dtype=np.float32)
    norm = np.sqrt((out * out).sum(dtype=np.float32))
    return out / norm if norm > 0 else out


@F.pandas_udf(T.ArrayType(T.FloatType()))
def embed_text(parts: Iterator[pd.Series]) -> Iterator[pd.Series]:
    for s in parts:
        yield s.map(lambda x: None if x is None else embed(x.encode()))


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """0 where a norm is 0."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    return F.when(norms == 0, 0.0).otherwise(dot(a, b) / norms)


def search(items: DataFrame, query: list[float], k: int, vector: str = "embedding", order: str = "vec_id") -> DataFrame:
    """The k items most similar to one vector; ties in item order. A top-k plan: each task keeps k rows."""
    q = F.array(*(F.lit(float(x)) for x in query))
    return items.withColumn("score", cosine(F.col(vector), q)).orderBy(F.col("score").desc(), order).limit(k)


def _doubles(column: pa.Array) -> np.ndarray:
    """Vectors of equal length as rows."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(len(column), -1)


def _squares(x: np.ndarray) -> np.ndarray:
    return _sums(x, x)


def _sums(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Dot products of rows, added up in order: equal vectors give equal sums wherever they stand, unlike a matrix product's."""
    return np.add.accumulate(x * y, axis=1)[:, -1] if x.shape[1] else np.zeros(len(x))


def _unit(x: np.ndarray, squares: np.ndarray) -> np.ndarray:
    norms = np.sqrt(squares)[:, None]
    return np.divide(x, norms, out=np.zeros_like(x), where=norms > 0)


def _firsts(x: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Rows without those that k equal vectors with lesser ids precede."""
    if not x.shape[1]:
        return np.argsort(ids, kind="stable")[:k]
    same = np.unique(np.ascontiguousarray(x).view(f"V{8 * x.shape[1]}").ravel(), return_inverse=True)[1].ravel()
    order = np.lexsort((ids, same))
    starts = np.flatnonzero(np.r_[True, np.diff(same[order]) > 0])
    return order[np.arange(len(order)) - np.repeat(starts, np.diff(np.r_[starts, len(order)])) < k]


class Nearest:
    """The k best items so far for each query of a block. Besides the block it holds TILE scores and the vectors of TILE numbers."""

    def __init__(self, queries: np.ndarray, k: int):
        self.q, self.k, self.squares = queries, k, _squares(queries)
        self.unit = _unit(queries, self.squares)
        self.names, self.scores = np.full((len(queries), k), np.iinfo(np.int64).max), np.full((len(queries), k), -np.inf)
        self.full = np.zeros(len(queries), np.int64)

    def add(self, ids: np.ndarray, x: np.ndarray) -> None:
        """A matrix product sifts; what comes within MARGIN of the k best is scored exactly."""
        kept = _firsts(x, ids, self.k)
        ids, x = ids[kept], x[kept]
        squares = _squares(x)
        unit, step = _unit(x, squares).T, max(1, TILE // max(1, len(x)))
        for s in range(0, len(self.q), step):
            near = self.unit[s : s + step] @ unit
            near[np.isnan(near)] = -np.inf
            least = np.where(self.full[s : s + step] < self.k, -np.inf, self.scores[s : s + step, -1] - MARGIN)
            hits = near >= least[:, None]
            many = np.flatnonzero(hits.sum(axis=1) > 2 * self.k)
            if len(many):
                top = np.partition(near[many], near.shape[1] - self.k, axis=1)[:, near.shape[1] - self.k]
                hits[many] &= near[many] >= top[:, None] - MARGIN
            at, item = np.nonzero(hits)
            pairs = max(1, TILE // max(1, x.shape[1]))
            for p in range(0, len(at), pairs):
                self._merge(at[p : p + pairs] + s, item[p : p + pairs], ids, x, squares)

    def _merge(self, at: np.ndarray, item: np.ndarray, ids: np.ndarray, x: np.ndarray, squares: np.ndarray) -> None:
        a, b = self.squares[at], squares[item]
        with np.errstate(over="ignore", invalid="ignore"):
            scale = np.sqrt(a * b)
            scale = np.where((scale > 0) & np.isfinite(scale), scale, np.sqrt(a) * np.sqrt(b))
            score = np.divide(_sums(x[item], self.q[at]), scale, out=np.zeros(len(at)), where=scale != 0)
        score = np.where(np.isnan(score), -np.inf, np.clip(score, -1, 1))
        who = np.unique(at)
        row, place = np.nonzero(np.arange(self.k) < self.full[who, None])
        at = np.concatenate([at, who[row]])
        names, score = np.concatenate([ids[item], self.names[who[row], place]]), np.concatenate([score, self.scores[who[row], place]])
        order = np.lexsort((names, -score, at))
        at = at[order]
        starts = np.flatnonzero(np.r_[True, np.diff(at) > 0])
        sizes = np.diff(np.r_[starts, len(at)])
        rank = np.arange(len(at)) - np.repeat(starts, sizes)
        best = rank < self.k
        self.names[at[best], rank[best]], self.scores[at[best], rank[best]] = names[order[best]], score[order[best]]
        self.full[who] = np.minimum(sizes, self.k)

    def rows(self, query_ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        for s in range(0, len(self.q), OUT_ROWS):
            row, place = np.nonzero(np.arange(self.k) < self.full[s : s + OUT_ROWS, None])
            score = self.scores[row + s, place]
            yield pa.RecordBatch.from_arrays([pa.array(query_ids[row + s]), pa.array(self.names[row + s, place]), pa.array(np.where(np.isinf(score), np.nan, score))], names=["query_id", "item_id", "score"])


def search_all(items: DataFrame, queries: DataFrame, k: int, vector: str = "embedding", item_id: str = "vec_id", query_id: str = "query_id") -> DataFrame:
    """The k best items for each row of a stated query set, ties in item order. Queries go to the items in blocks of BLOCK_BYTES
    and BLOCK_ROWS at most, one after another; the driver and each worker hold one. A task keeps the k best for each query,
    and tasks are as many as the cores need, so that what is shuffled grows with the queries alone."""
    spark = items.sparkSession
    there = queries.select(F.col(query_id).cast("long").alias("query_id"), F.col(vector).alias("vector")).where(F.col(vector).isNotNull())
    size, n = there.agg(F.coalesce(F.sum(F.size("vector") * 8), F.lit(0)), F.count("*")).first()
    blocks = max(-(-size // BLOCK_BYTES), -(-n // BLOCK_ROWS))
    if not blocks:
        return spark.createDataFrame([], "query_id long, item_id long, score double, rank int")
    rows = items.where(F.col(vector).isNotNull()).select(F.col(item_id).cast("long"), F.col(vector)).coalesce(TASKS * spark.sparkContext.defaultParallelism)
    place = new_folder(spark, "nearest")
    for s in range(blocks):
        part = (there if blocks == 1 else there.where(F.pmod(F.xxhash64("query_id"), F.lit(blocks)) == s)).toArrow().combine_chunks()
        if not len(part):
            continue
        ids, vectors = part["query_id"].to_numpy(), _doubles(part["vector"].combine_chunks())

        def best(batches: Iterator[pa.RecordBatch], ids=ids, vectors=vectors) -> Iterator[pa.RecordBatch]:
            found = Nearest(vectors, k)
            for b in batches:
                step = max(1, TILE // max(1, vectors.shape[1]))
                for p in range(0, len(b), step):
                    x = b.slice(p, step)
                    found.add(x.column(0).to_numpy(), _doubles(x.column(1)))
            yield from found.rows(ids)

        found = rows.mapInArrow(best, "query_id long, item_id long, score double")
        found = found.groupBy("query_id").agg(F.slice(F.sort_array(F.collect_list(F.struct((-F.col("score")).alias("s"), "item_id"))), 1, k).alias("t"))
        if blocks > 1:
            found.write.mode("append").parquet(place)
    if blocks > 1:
        found = spark.read.schema(found.schema).parquet(place)
    return found.select("query_id", F.posexplode("t").alias("rank", "t")).select("query_id", F.col("t.item_id").alias("item_id"), (-F.col("t.s")).alias("score"), (F.col("rank") + 1).alias("rank"))
