"""Every query of the catalogue against its oracle, on the same tables."""

import duckdb
import pytest

from millrace.plans import catalogue, relational

QUERIES, ORACLES = catalogue.queries(), catalogue.oracle_sql()


@pytest.fixture(scope="module")
def db(sf):
    c = duckdb.connect()
    c.sql("set timezone='UTC'")
    for t in relational.TABLES:
        c.sql(f"create view {t} as select * from '{sf}/{t}.parquet'")
    return c


def normal(rows):
    value = lambda v: round(v, 5) if isinstance(v, float) else list(v) if isinstance(v, list | tuple) else v
    return sorted((tuple(value(v) for v in r) for r in rows), key=lambda r: tuple((v is None, str(v)) for v in r))


@pytest.mark.parametrize("name", QUERIES)
def test_query(spark, db, sf, name):
    got = QUERIES[name](spark, sf)
    columns = sorted(got.columns)
    rows = [tuple(r) for r in got.select(*(f"`{c}`" for c in columns)).collect()]
    if name not in ORACLES:
        assert rows
        return
    want = db.sql(ORACLES[name])
    assert sorted(want.columns) == columns
    assert normal(rows) == normal([tuple(r[want.columns.index(c)] for c in columns) for r in want.fetchall()])


def test_plans_push_down(spark, sf):
    plan = QUERIES["filter_pred"](spark, sf)._jdf.queryExecution().executedPlan().toString()
    assert "PushedFilters: [IsNotNull(o_totalprice)" in plan and "o_custkey" not in plan.split("ReadSchema")[1]


def test_entry_without_corpus_operators(tmp_path):
    """The entry module works without the corpus operators' folders."""
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    repo = Path(__file__).resolve().parent.parent
    shutil.copytree(repo / "millrace", tmp_path / "millrace", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    shutil.copy(repo / "__spark_entry__.py", tmp_path)
    done = subprocess.run([sys.executable, "-c", "import __spark_entry__ as e; print(len(e.queries()), 'pipeline' in e.queries())"], cwd=tmp_path, capture_output=True, text=True)
    assert done.stdout.split() == [str(len(QUERIES)), "False"], done.stderr
