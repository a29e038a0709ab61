"""Queries take every row of their tables: counted against the tables, and against the oracle on small ones."""

import duckdb
from pyspark.sql import functions as F

from millrace.plans import catalogue

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


def both(spark, folder, name, **tables):
    """Rows of the query and of its oracle over ``tables``, frames written to ``folder``."""
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t, df in tables.items():
        df.coalesce(1).write.parquet(f"{folder}/{t}.parquet")
        c.sql(f"create view {t} as select * from '{folder}/{t}.parquet/*.parquet'")
    want = c.sql(ORACLES[name])
    order = lambda rows: sorted(map(tuple, rows), key=str)
    got = order(QUERIES[name](spark, str(folder)).select(*want.columns).collect())
    assert got == order(want.fetchall())
    return got


def test_order_nulls(spark, tmp_path):
    ids = [3, 5, 199, 200, 205, 4001]
    got = both(spark, tmp_path, "order_nulls", events=spark.createDataFrame([(k, -k) for k in ids], "event_id long, user_id long"))
    # multiples of 5 are null: last when ascending, first when descending
    assert got == sorted([(4001, 1, 6), (199, 2, 5), (3, 3, 4), (5, 4, 1), (200, 5, 2), (205, 6, 3)], key=str)


def test_order_nulls_is_not_one_task(spark, tmp_path):
    """Rows are ranked in ranges: no task has them all, whichever way they are ordered."""
    events = spark.range(20_000).select(F.col("id").alias("event_id"), (F.col("id") * 7 % 40).alias("user_id"))
    before = spark.conf.get("spark.sql.adaptive.coalescePartitions.enabled")
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")
    try:
        both(spark, tmp_path, "order_nulls", events=events)
        sizes = [r["count"] for r in QUERIES["order_nulls"](spark, str(tmp_path)).groupBy(F.spark_partition_id()).count().collect()]
    finally:
        spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", before)
    assert sum(sizes) == 20_000 and max(sizes) < 10_000, sizes


def test_unnest(spark, tmp_path):
    data = [(0, [0.5, 1.5, 2.5, 3.5, 4.5]), (50, [6.5]), (51, []), (52, None), (1000, [float(k) for k in range(64)])]
    got = both(spark, tmp_path, "unnest", embeddings=spark.createDataFrame(data, "vec_id long, embedding array<float>"))
    assert got == sorted([(k, pos, x) for k, v in data for pos, x in enumerate(v or [])], key=str)


def test_interval_fn(spark, tmp_path):
    data = [(10, "2024-02-28 00:30:00"), (11, "2024-12-31 23:59:59.25"), (13, "2024-01-01 10:00:00"), (19, None)]
    events = spark.createDataFrame(data, "event_id long, t string").selectExpr("event_id", "CAST(t AS TIMESTAMP_NTZ) AS ts")
    got = both(spark, tmp_path, "interval_fn", events=events)
    assert got == [(10, "2024-02-29 23:30:00"), (11, "2025-01-02 22:59:59.25"), (13, "2024-01-03 09:00:00"), (19, None)]


def test_coerce_union(spark, tmp_path):
    region = spark.createDataFrame([(0, "AFRICA")], "r_regionkey int, r_name string")
    orders = spark.createDataFrame([(1, 1.5), (39, 2.5), (40, 3.5), (70001, 4.5)], "o_orderkey long, o_totalprice double")
    got = both(spark, tmp_path, "coerce_union", region=region, orders=orders)
    assert got == sorted([(0, "AFRICA", None), (1, None, 1.5), (39, None, 2.5), (40, None, 3.5), (70001, None, 4.5)], key=str)


def test_full_outer(spark, tmp_path):
    ids = lambda *x: spark.createDataFrame([(k,) for k in x], "doc_id long")
    got = both(spark, tmp_path, "full_outer", documents=ids(1, 2, 3, 4, 6), labels=ids(2, 3, 5, 9))
    assert got == sorted([(1, None), (2, 2), (3, 3), (4, None), (6, None), (None, 5), (None, 9)], key=str)
