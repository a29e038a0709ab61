"""Search of all queries: memory of a worker, ties, blocks of queries."""

import tracemalloc

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from millrace.functions import vector
from millrace.plans import engine_queries


def table(spark, x):
    return spark.createDataFrame([(k, v.tolist()) for k, v in enumerate(x)], "vec_id long, embedding array<float>")


def test_memory_does_not_grow_with_queries_times_items():
    """An Arrow batch of items against many queries; all their scores would take 320 MB at once."""
    x = np.random.default_rng(1).normal(size=(10_000, 16))
    tracemalloc.start()
    try:
        found = vector.Nearest(x[:4000], 5)
        found.add(np.arange(len(x)), x)
        rows = [tuple(r) for b in found.rows(np.arange(4000)) for r in zip(*(c.to_pylist() for c in b.columns))]
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    assert peak < 100 << 20, peak
    assert len(rows) == 20_000 and all(r[0] == r[1] for r in rows[::5])


@pytest.mark.parametrize("blocks", [1, 5])
def test_ties_are_those_of_sql(spark, tmp_path, monkeypatch, blocks):
    """Copies and multiples of vectors, in several partitions: scores are equal or not as SQL's are, and ties go by id."""
    rng = np.random.default_rng(2)
    x = rng.normal(size=(1300, 64)).astype(np.float32)
    x[rng.permutation(1300)[:300]] = x[0]
    x[rng.permutation(1300)[:40]] = x[0] * np.float32(1.7)
    x[rng.permutation(1300)[:9]] = -x[0]
    if blocks > 1:
        monkeypatch.setattr(vector, "BLOCK_ROWS", 3)
    table(spark, x).repartition(7).write.parquet(f"{tmp_path}/embeddings.parquet")
    c = duckdb.connect()
    c.sql(f"create view embeddings as select * from '{tmp_path}/embeddings.parquet/*.parquet'")
    want = c.sql(engine_queries.ORACLE["vector_search_all"])
    got = engine_queries.vector_search_all(spark, str(tmp_path)).select(*want.columns).collect()
    assert sorted(map(tuple, got)) == sorted(want.fetchall()) and len(got) == 65


def test_few_items_nulls_and_zeros(spark):
    items = spark.createDataFrame([(4, [0.0, 0.0]), (2, [1.0, 0.0]), (3, None), (1, [-1.0, 0.0])], "vec_id long, embedding array<double>")
    out = vector.search_all(items, items.select(F.col("vec_id").alias("query_id"), "embedding").where("vec_id > 1"), 5).collect()
    assert sorted((r["query_id"], r["rank"], r["item_id"], r["score"]) for r in out) == [(2, 1, 2, 1.0), (2, 2, 4, 0.0), (2, 3, 1, -1.0), (4, 1, 1, 0.0), (4, 2, 2, 0.0), (4, 3, 4, 0.0)]
