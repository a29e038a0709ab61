"""Typing, files, tables, SQL views, modules, sessions and streams."""

import json
import socket
import sys
import threading

import pytest
from pyspark import cloudpickle
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import __main__ as command
from millrace import types as k
from millrace.functions import scalar, vector
from millrace.operators import capability, infer, module, repair
from millrace.operators.interconnect import Interconnect
from millrace.operators.capability import Capability
from millrace.operators.module import Failed, Module
from millrace.plans import sqlview, table
from millrace.plans.pipeline import Pipeline
from millrace.sources import files, ingress, logfile
from millrace.streaming import replay, session

cloudpickle.register_pickle_by_value(sys.modules[__name__])  # workers can't import this file
p = k.prim
TEXT = T.StructType([T.StructField("input", T.StringType())])


def out(*names):
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


# typing


@pytest.mark.parametrize(
    ("a", "b", "want"),
    [
        ("Null", "Str", "Str"), ("I8", "I32", "I32"), ("U16", "U64", "U64"), ("F16", "F32", "F32"), ("I32", "F64", "F64"), ("U8", "F64", "F64"),
        ("I8", "U8", None), ("I32", "F32", None), ("Str", "I8", None), ("Bool", "I8", None),
    ],
)
def test_lattice(a, b, want):
    for x, y in ((a, b), (b, a)):
        if want is None:
            with pytest.raises(k.CoercionError):
                k.coerce(p(x), p(y))
        else:
            assert k.coerce(p(x), p(y)) == p(want)


def test_lattice_nested():
    assert k.coerce(k.fixed(p("I8"), 3), k.fixed(p("I16"), 3)) == k.fixed(p("I16"), 3)
    assert k.coerce(k.fixed(p("I8"), 3), k.fixed(p("I8"), 4)) == k.listed(p("I8"))
    assert k.coerce(k.listed(p("I8"), False), k.listed(p("I64"), True)) == k.listed(p("I64"), True)
    assert k.coerce(k.group(("b", p("I8"), False)), k.group(("a", p("Str"), False), ("b", p("I32"), False))) == k.group(("a", p("Str"), True), ("b", p("I32"), True))
    assert k.coerce(k.mapped(p("Str"), p("I8")), k.mapped(p("Str"), p("I64"))) == k.mapped(p("Str"), p("I64"))


def test_inference():
    assert infer.infer_schema([{"b": 1, "a": None}, {"b": 2.5}]) == k.group(("a", p("Null"), True), ("b", p("F64"), False))
    assert infer.row_schema({"z": "x", "a": [1, None]}) == k.group(("z", p("Str"), True), ("a", k.listed(p("I64"), True), True))
    assert infer.value_kind([1, "x"]) == k.listed(p("I64"), False)
    assert infer.map_kind({}) == k.mapped(p("Str"), p("Null"))
    with pytest.raises(k.CoercionError):
        infer.infer_schema([{"a": 1}, {"a": "x"}])


CASES = [
    ("Str", "42", "I32", 42, None), ("Str", " 42", "I32", None, "Parse"), ("Str", "300", "I8", None, "Parse"), ("I64", 300, "I8", None, "OutOfBounds"), ("I64", -1, "U8", None, "OutOfBounds"),
    ("F64", 3.9, "I32", 3, None), ("F64", -3.9, "I32", -3, None), ("F64", 1e20, "I32", 2**31 - 1, None), ("F64", float("nan"), "I32", 0, None), ("F64", -1e30, "I64", -(2**63), None), ("Bool", True, "I8", 1, None),
    ("Str", "1.5", "F64", 1.5, None), ("Str", "1d", "F64", None, "Parse"), ("Str", "x", "F64", None, "Parse"), ("I64", 2, "F64", 2.0, None), ("Bool", False, "F64", 0.0, None),
    ("Str", "YES", "Bool", True, None), ("Str", "t", "Bool", None, "Parse"), ("Str", "0", "Bool", False, None), ("I64", 5, "Bool", True, None), ("F64", 1.0, "Bool", None, "Cast"),
    ("F64", 1.0, "Str", "1", None), ("F64", 2.5, "Str", "2.5", None), ("I64", 7, "Str", "7", None), ("Bool", True, "Str", "true", None), ("Str", "2020-01-01", "Timestamp", None, "Cast"),
    ("Str", None, "I32", None, None),
]


def test_repair(spark):
    for have, value, want, result, error in CASES:
        df = spark.createDataFrame([(value,)], T.StructType([T.StructField("v", k.PRIMITIVES[have])]))
        r = df.select(repair.repair(F.col("v"), p(have), p(want)).alias("r")).first()["r"]
        assert (r["value"], r["error"]) == (result, error), (have, value, want)


def test_repair_lists_groups_maps(spark):
    df = spark.sql("SELECT array('1', NULL, '2') AS l, 5 AS s, named_struct('x', '7') AS g, map('1', '2') AS m, array('a') AS bad")
    kinds = {f.name: k.kind_of(f.dataType) for f in df.schema}
    fix = lambda c, want: df.select(repair.repair(F.col(c), kinds[c], want).alias("r")).first()["r"]
    assert fix("l", k.listed(p("I32")))["value"] == [1, 2]
    assert fix("l", k.fixed(p("I32"), 3))["error"] == "Length"
    assert fix("s", k.listed(p("Str")))["value"] == ["5"]
    assert fix("g", k.group(("x", p("I32"), True), ("y", p("Str"), True)))["value"].asDict() == {"x": 7, "y": None}
    assert fix("g", k.group(("y", p("Str"), False)))["error"] == "y: Missing"
    assert fix("m", k.mapped(p("I32"), p("F64")))["value"] == {1: 2.0}
    assert fix("bad", k.listed(p("I32")))["error"] == "Parse"
    assert df.select(repair.repair(F.lit(2.0), p("F64"), p("Bool"), "coerce").alias("r")).first()["r"]["value"] is True


def test_project(spark):
    df = spark.sql("SELECT 1 AS a, named_struct('x', 2, 'y', 3) AS g")
    r = repair.project(df, k.group(("g", k.group(("y", p("I32"), True), ("z", p("Str"), True)), True), ("q", p("Bool"), True))).first()
    assert r["g"].asDict() == {"y": 3, "z": None} and r["q"] is None
    with pytest.raises(TypeError):
        repair.project(df, k.group(("a", k.group(("x", p("I32"), True)), True)))
    with pytest.raises(ValueError):
        repair.extend(df, F.lit(1), names=["A"])
    assert repair.extend(df, F.lit(1), names=["b"]).first()["b"] == 1
    assert repair.assert_not_null(spark.sql("SELECT CAST(NULL AS INT) AS a"), ["a"]).first()["_error"] == "a: Null"


def test_equality(spark):
    df = spark.sql("SELECT CAST(1 AS TINYINT) AS a, 1L AS b, 1.0D AS c, TIMESTAMP'2020-01-01 00:00:00.1' AS t, TIMESTAMP'2020-01-01 00:00:00.9' AS u")
    r = df.select(k.equals(F.col("a"), p("I8"), F.col("b"), p("I64")), k.equals(F.col("a"), p("I8"), F.col("c"), p("F64")), k.equals(F.col("t"), p("Timestamp"), F.col("u"), p("Timestamp"))).first()
    assert tuple(r) == (True, False, True)


def test_time(spark):
    texts = ["2024-03-01T10:20:30Z", "2024-03-01T10:20:30+02:00", "2024-03-01 10:20:30.5", "2024-03-01T10:20", "2024-03-01 10", "2024-03-01", "nonsense"]
    got = [r[0] for r in spark.createDataFrame([(t,) for t in texts], "t string").select(scalar.format_time(scalar.parse_time(F.col("t")))).collect()]
    assert got[0] == "2024-03-01T10:20:30.000000+00:00" and got[1].startswith("2024-03-01T08:20:30") and got[2].startswith("2024-03-01T10:20:30.500") and got[5].startswith("2024-03-01T00:00") and got[6] is None
    assert [r[0] for r in spark.createDataFrame([("2024-01-01T00:00:00.123456789Z",), ("2024/01/02 03:04",)], "t string").select(F.unix_micros(scalar.parse_time(F.col("t")))).collect()] == [1704067200123456, None]
    assert str(spark.range(1).select(scalar.from_unit(F.lit(1_700_000_000_123_456_789), "ns").cast("string")).first()[0]) == "2023-11-14 22:13:20.123456"


def test_scalar_functions(spark):
    assert scalar.crc32c_bytes(b"123456789") == 0xE3069283 and scalar.crc32c_bytes(b"") == 0 and scalar.crc32c_bytes(bytes(32)) == 0x8A9136AA
    many = [b"", b"123456789", b"a", bytes(32), b"123456789" * 1000, b"ab"]
    assert scalar.crc32c_many(many).tolist() == [scalar.crc32c_bytes(x) for x in many]
    assert [r[0] for r in spark.createDataFrame([("123456789",), (None,)], "t string").select(scalar.crc32c("t")).collect()] == [0xE3069283, None]
    assert vector.embed(b"\xff\x00\xff", 2).round(4).tolist() == [1.0, 0.0] and abs(vector.embed(b"\xff\xff\xff", 2) - [0.894427, 0.447214]).max() < 1e-6
    one = lambda c: spark.range(1).select(c).first()[0]
    assert one(scalar.transform_text(F.lit("hello"), "[test] ", "!!!", True)) == "[TEST] HELLO!!!"
    assert one(scalar.embedding_text(F.lit("m"), F.array(F.lit(1), F.lit(2)))) == "Embedding of m has 2"
    assert one(scalar.preview(F.lit("word " * 40))) == ("word " * 20).strip() and one(scalar.preview(F.lit("x" * 150))) == "x" * 100
    assert [one(scalar.url_allowed(F.lit(u), ["http://a/x", "http://b/*"])) for u in ("http://a/x", "http://a/x/y", "http://a/xy", "http://b/q", "http://c")] == [True, True, False, True, False]
    assert [one(scalar.url_allowed(F.lit(u), ["http://a/*"])) for u in ("http://abc", "http://a", "http://a/b", "https://a/b")] == [True, True, True, False]
    assert one(scalar.parse_unsigned(F.lit("18446744073709551615"))) == 2**64 - 1 and one(scalar.parse_unsigned(F.lit("-1"))) is None
    assert abs(float(vector.embed(b"abc").astype("float64") @ vector.embed(b"abc").astype("float64")) - 1) < 1e-6
    assert one(vector.cosine(F.array(F.lit(0.0)), F.array(F.lit(1.0)))) == 0.0


# files


def test_files_round_trip(spark, tmp_path):
    rows = [("hello", "world"), ("foo", "bar"), ("A", "B"), ("C", "D")]
    df = spark.createDataFrame(rows, "input string, target string")
    (tmp_path / "a.csv").write_text(" input , target\nhello,world\nfoo,bar\n")
    (tmp_path / "a.json").write_text(json.dumps([{"input": "alpha", "target": "beta"}]))
    (tmp_path / "b.jsonl").write_text('{"input": "alpha", "target": "beta"}\n{"input": "gamma", "target": "delta"}\n')
    files.write_ipc(df, str(tmp_path / "c.arrow"))
    files.write_parquet(df, f"file://{tmp_path}/d.parquet", 1)
    (tmp_path / "skip.txt").write_text("no")
    at = lambda n: files.read_any(spark, f"file://{tmp_path}/{n}")
    assert [tuple(r) for r in at("a.csv").collect()] == rows[:2] and at("a.csv").columns == ["input", "target"]
    assert [tuple(r) for r in at("a.json").collect()] == [("alpha", "beta")] and at("b.jsonl").count() == 2
    assert sorted(map(tuple, at("c.arrow").collect())) == sorted(rows) == sorted(map(tuple, at("d.parquet").collect()))
    assert [n.rpartition("/")[2] for n, _ in files.read_folder(spark, f"file://{tmp_path}")] == ["a.csv", "a.json", "b.jsonl", "c.arrow", "d.parquet"]
    (tmp_path / "e.csv").write_text("input\n")
    for bad in ("e.csv", "skip.txt"):
        with pytest.raises(files.FileError):
            at(bad)


def test_chunks_and_results(spark, tmp_path):
    df = spark.createDataFrame([(x,) for x in "ABCD"], "v string").coalesce(1)
    files.export(df, f"file://{tmp_path}/out", "csv", 3)
    parts = sorted(tmp_path.glob("out/*.csv"))
    assert [len(x.read_text().split()) for x in parts] == [4, 2]
    with pytest.raises(files.FileError):
        files.write_jsonl(df, f"file://{tmp_path}/x", 0)
    shown = files.ipc_to_json(files.to_ipc(df.limit(0)))
    assert shown["rows"] == [] and shown["schema"][0]["name"] == "v"
    assert len(files.content_hash(files.to_ipc(df))) == 64 and "RECORD 0" in files.pretty(df)
    assert files.read_row(spark, '{"a": 1, "b": {"c": "x"}}').first()["b"]["c"] == "x"
    assert files.read_row(spark, '[["a", 1]]').first()["a"] == 1


def test_socket(spark):
    port, texts = files.serve_socket(n=2)

    def send():
        for v in (1, 2):
            with socket.create_connection(("127.0.0.1", port)) as s:
                s.sendall(json.dumps({"v": v}).encode())

    t = threading.Thread(target=send)
    t.start()
    assert [files.read_row(spark, x).first()["v"] for x in texts()] == [1, 2]
    t.join()


# tables and SQL


def test_table(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType()), T.StructField("name", T.StringType())])
    t = table.Table(spark, f"file://{tmp_path}/t", schema)
    assert t.length() == 0 and t.scan().count() == 0
    with pytest.raises(table.NotFound):
        t.get(0)
    for a in (10, 13, 16):
        t.append(spark.createDataFrame([(i, f"n{i}") for i in range(a, min(a + 3, 17))], schema), ["id"])
    assert t.length() == 7 and [r["id"] for r in t.scan().orderBy("id").collect()] == list(range(10, 17))
    before = t.scan()
    t.compact()
    assert before.count() == 7 and t.length() == 7  # readers of the older snapshot aren't disturbed
    assert [r["id"] for r in t.page(1, 3).collect()] == [11, 12, 13] and t.get(6)["name"] == "n16"
    assert table.Table(spark, f"file://{tmp_path}/t", schema).length() == 7  # restored from its folder
    assert t.retire(0) > 0 and t.scan().count() == 7
    t.append(spark.createDataFrame([], schema))
    assert t.length() == 7


def test_pinned_readers_and_waiting_rows(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType())])
    t = table.Table(spark, f"file://{tmp_path}/t", schema, capacity=3)
    assert [t.put({"id": i}) for i in range(2)] == [0, 1] and t.length() == 2 and t.get(1)["id"] == 1 and t.scan().count() == 2
    assert table.Table(spark, f"file://{tmp_path}/t", schema).length() == 0  # not committed yet
    assert t.put({"id": 2}) == 2 and table.Table(spark, f"file://{tmp_path}/t", schema).length() == 3
    t.append(spark.createDataFrame([(3,)], schema))
    with t.pinned() as old:
        t.compact()
        t.retire(0)
        assert sorted(r["id"] for r in old.collect()) == [0, 1, 2, 3]
    assert t.retire(0) > 0 and [t.get(i)["id"] for i in range(4)] == [0, 1, 2, 3]
    r = t.file_ranges().agg(F.min("low"), F.max("high"), F.sum("n")).first()
    assert tuple(r) == (0, 3, 4)


def test_sql_touches_no_views(spark):
    for name in ("data", "pipeline", "events"):
        spark.range(1).createOrReplaceTempView(name)
    df = spark.range(7).withColumnRenamed("id", "n")
    assert sqlview.query_data(df, "WITH t AS (SELECT n FROM DATA) SELECT count(*) AS c FROM t").first()["c"] == 7
    assert [sqlview.query_data(df, x).count() for x in ("DESCRIBE data", "SHOW COLUMNS FROM data", "SHOW TABLES;", "explain formatted SELECT * FROM data")] == [1, 1, 1, 1]
    for bad in ("EXPLAIN DROP TABLE data", "SHOW FUNCTIONS", "DESCRIBE other", "SET a = b"):
        with pytest.raises(sqlview.SqlError):
            sqlview.query_data(df, bad)
    assert all(spark.table(name).columns == ["id"] for name in ("data", "pipeline", "events"))
    for name in ("data", "pipeline", "events"):
        spark.catalog.dropTempView(name)
    # the word alone isn't a join
    sqlview.validate_pipeline(spark, "SELECT id AS `join` FROM pipeline -- no join here")


def test_rows_and_schemas(spark, tmp_path):
    df = spark.createDataFrame([(1, "a"), (2, "b")], "k int, v string").coalesce(1)
    assert files.row_of(df, 1) == {"k": 2, "v": "b"} and files.row_of(df, 0, ["v"]) == {"v": "a"} and [r["k"] for r in files.rows_of(df)] == [1, 2]
    with pytest.raises(IndexError):
        files.row_of(df, 2)
    texts = spark.createDataFrame([('{"a": 1, "b": [1]}',), ('{"a": 2.5, "c": "x"}',), ("null",)], "j string")
    kind = infer.infer_json(texts, "j")
    assert {n: x.name for n, x, _ in kind.args[0]}.keys() == {"a", "b", "c"}
    assert k.kind_of(T.DecimalType(10, 2)) == p("F64") and k.kind_of(T.DecimalType(20, 0)) == p("U64")
    (tmp_path / "odd.csv").write_text("v\n" + "1\n" * 150 + "x\n")
    with pytest.raises(Exception, match="MALFORMED|FAILED"):
        files.read_any(spark, f"file://{tmp_path}/odd.csv").collect()


def test_orphaned_records(spark):
    inputs = spark.createDataFrame([(0, "a")], "index long, input string")
    log = spark.createDataFrame([(0, [], None), (5, ["l"], "bad")], "row_index long, module_logs array<string>, failure string")
    outputs = spark.createDataFrame([(0, "A"), (7, "Z")], "index long, message string")
    got = {r["index"]: (r["status"], r["output"] and r["output"]["message"]) for r in module.assemble(inputs, log, outputs).collect()}
    assert got == {0: ("success", "A"), 5: ("failure", None), 7: ("success", "Z")}


def test_sparse_index(spark, tmp_path):
    schema = T.StructType([T.StructField("id", T.IntegerType())])
    t = table.Table(spark, f"file://{tmp_path}/s", schema)
    t.append(spark.createDataFrame([(0, 10), (2, 20), (4, 30)], "i long, id int"), index="i")
    assert [t.get(i)["id"] for i in (0, 2, 4)] == [10, 20, 30] and [r["id"] for r in t.page(1, 2).collect()] == [20, 30]
    for i in (1, 3, 5):
        with pytest.raises(table.NotFound):
            t.get(i)


def test_pipeline_sql(spark):
    meta = lambda n: f"named_struct('index', CAST(i AS BIGINT), 'timestamp', now()) AS {n}"
    a = spark.sql(f"SELECT 100 + i AS id, v AS value, {meta('_input_meta')} FROM VALUES (0, 'hello'), (1, 'world'), (2, 'lost') t(i, v)")
    b = spark.sql(f"SELECT v AS result, 1 AS id, {meta('_output_meta')} FROM VALUES (0, 'HELLO'), (1, 'WORLD') t(i, v)")
    both = [(a, "_input_meta"), (b, "_output_meta")]
    rows = sqlview.query_pipeline(spark, both, "SELECT id, value, result, __t1_id FROM Pipeline ORDER BY id").collect()
    assert [tuple(r) for r in rows] == [(100, "hello", "HELLO", 1), (101, "world", "WORLD", 1)]
    for bad in (
        "SELECT 1; SELECT 2", "INSERT INTO pipeline VALUES (1)", "SELECT * FROM other", "SELECT * FROM pipeline a JOIN pipeline b ON true", "SELECT * FROM pipeline UNION SELECT * FROM pipeline",
        "WITH pipeline AS (SELECT 1) SELECT * FROM pipeline", "SELECT * FROM pipeline WHERE id IN (SELECT id FROM other)", "SELECT * FROM pipeline, pipeline", "DROP TABLE pipeline", "SELECT 1",
    ):
        with pytest.raises(sqlview.SqlError):
            sqlview.validate_pipeline(spark, bad)
    with pytest.raises(sqlview.SqlError):
        sqlview.pipeline_view([(a, "_output_meta")])
    assert sqlview.query_data(a, "SELECT max(id) AS m FROM data").first()["m"] == 102
    with pytest.raises(sqlview.SqlError):
        sqlview.query_data(a, "CREATE TABLE x AS SELECT 1 AS a")


# modules


def _error_handling(input):
    if input in ("panic", "error"):
        raise Failed(f"module {input}")
    return {"message": f"Success: {input}"}


def _counter(input, caps, log):
    log("counting")
    return {"message": str(caps["counter"].add(int(input)))}


def test_module_isolates_errors(spark):
    m = Module("errors", _error_handling, TEXT, out("message"))
    df = spark.createDataFrame([(0, "a"), (1, "panic"), (2, "error"), (3, None)], "index long, input string")
    made = module.run(df, m)
    assert [tuple(r) for r in module.successes(made).orderBy("index").collect()] == [(0, "Success: a"), (3, "Success: None")]
    assert [(r["row_index"], r["error"], r["partial_data"]["input"]) for r in module.failures(made).orderBy("row_index").collect()] == [(1, "module panic", "panic"), (2, "module error", "error")]
    assert tuple(module.tally(made).first()) == (4, 2, 2)
    wrong = Module("wrong", lambda input: {"n": "no number" if input == "b" else 5}, TEXT, T.StructType([T.StructField("n", T.LongType())]))
    assert sorted((r["index"], r["status"]) for r in module.run(spark.createDataFrame([(0, "a"), (1, "b")], "index long, input string"), wrong).collect()) == [(0, "success"), (1, "failure")]


def test_capabilities(spark):
    m = Module("count", _counter, TEXT, out("message"), capabilities=(Capability("counter", capability.Counter, {"start": 0}, ("add",)),))
    made = module.run(spark.createDataFrame([(0, "10"), (1, "invalid"), (2, "20")], "index long, input string").coalesce(1), m).orderBy("index").collect()
    assert [r["status"] for r in made] == ["success", "failure", "success"] and [r["output"]["message"] for r in made if r["output"]] == ["10", "30"]
    assert made[0]["logs"] == ["counting"] and m.spec()["capabilities"][0]["name"] == "counter"
    assert capability.Transform({"prefix": "[test] ", "suffix": "!", "uppercase": True}).batch(["a"]) == ["[TEST] A!"]
    http = capability.Http({"urls": ["http://a/*"], "methods": ["get"]})
    assert http.get("http://a/b")["status"] == "offline" and http.allowed("GET", "http://abc") and not http.allowed("GET", "http://b")
    for bad in (lambda: http.post("http://a/b", ""), lambda: http.get("http://c")):
        with pytest.raises(PermissionError):
            bad()
    assert capability.Llm({"system": "s", "client": lambda m: str(len(m))}).generate("p") == "2"
    rag = capability.Rag({"documents": [{"id": 1, "content": "spark engine"}, {"id": 2, "content": "zzz"}], "top_k": 1})
    assert rag.search("spark engine")[0]["id"] == 1 and len(rag.search("q", 5)) == 2
    assert capability.cpu_count(spark) >= 1


def test_pipeline(spark, tmp_path):
    heard = tmp_path / "heard"
    heard.mkdir()

    def callback(i, row):
        (heard / str(i)).write_text(row["message"])

    def broken(i, row):
        raise ValueError("only logged")

    line = Pipeline(spark, f"file://{tmp_path}/p", Module("errors", _error_handling, TEXT, out("message")), [broken, callback])
    (tmp_path / "in.csv").write_text("input\na\nerror\nb\n")
    records = line.bulk(f"file://{tmp_path}/in.csv")
    line.write_results(records, f"file://{tmp_path}/results")
    assert line.lengths() == {"inputs": 3, "outputs": 2, "logs": 3} and sorted(x.name for x in heard.iterdir()) == ["0", "2"]
    assert line.one('{"input": "c"}') == {"message": "Success: c"}
    with pytest.raises(Failed):
        line.one('{"input": "panic"}')
    assert line.record(0)["success"] == {"message": "Success: a"} and line.record(1)["failure"] == "module error" and line.record(4)["status"] == "failure"
    with pytest.raises(table.NotFound):
        line.record(9)
    assert [r["input"] for r in line.sql("SELECT input FROM pipeline ORDER BY input").collect()] == ["a", "b", "c"]
    assert line.data("SELECT count(*) AS n FROM data").first()["n"] == 3


def _greet(history, row):
    if row == "terminate":
        return session.Terminate()
    if row == "bad":
        raise Failed("bad turn")
    turn = len(history) // 2 + 1
    return session.Continue(f"Hello! Turn {turn}") if turn == 1 else session.End(f"Goodbye! Turn {turn}")


def _pairs(inputs, outputs, row):
    return session.Continue(f"{len(inputs)},{len(outputs)},{row}")


SAID = [(1, 0, "Hello!"), (1, 1, "How are you?"), (1, 2, "more"), (2, 0, "Hello!"), (2, 1, "terminate"), (3, 0, "Hello!"), (3, 1, "bad"), (4, 0, "Hello!")]
WANT = {(1, 0): "Hello! Turn 1", (1, 1): "Goodbye! Turn 2", (1, 2): None, (2, 0): "Hello! Turn 1", (2, 1): None, (3, 0): "Hello! Turn 1", (3, 1): None, (4, 0): "Hello! Turn 1"}


def test_sessions(spark):
    df = spark.createDataFrame(SAID, "session_id long, turn long, input string")
    made = session.calls(df, _greet)
    assert {(r["session_id"], r["turn"]): r["output"] for r in made.collect()} == WANT
    assert {r["session_id"]: (r["status"], r["length"]) for r in session.status(made).collect()} == {1: ("succeeded", 4), 2: ("succeeded", 4), 3: ("failed", 3), 4: ("active", 2)}
    rolled = {r["session_id"]: r for r in session.rollup(made).collect()}
    assert rolled[1]["session"] == ["Hello!", "Hello! Turn 1", "How are you?", "Goodbye! Turn 2"] and rolled[2]["session"][-1] is None and len(rolled[3]["session"]) == 3 and 4 not in rolled
    split = {r["session_id"]: r for r in session.rollup(made).select("session_id", *session.split_record()).collect()}
    assert split[1]["success"] == "Goodbye! Turn 2" and split[3]["input"] == "bad" and split[3]["success"] is None
    assert session.explode_pairs(session.rollup(made)).count() == 6
    assert [r["session_id"] for r in session.newest(made, "closed").collect()] == [3, 2, 1] and session.next_id(made) == 5
    assert [r["output"] for r in session.calls(df.where("session_id = 1"), _pairs, diff=True).orderBy("turn").collect()] == ["0,0,Hello!", "1,1,How are you?", "2,2,more"]


def test_session_tables(spark, tmp_path):
    closed = tmp_path / "closed"
    closed.mkdir()

    def callback(i, row):
        (closed / str(i)).write_text(row["status"])

    kept = session.Sessions(spark, f"file://{tmp_path}/s", _greet, callbacks=[callback])
    frame = lambda rows: spark.createDataFrame(rows, "session_id long, turn long, input string")
    assert {(r["session_id"], r["turn"]): r["output"] for r in kept.run(frame(SAID[:1] + SAID[3:4] + SAID[5:6])).collect()} == {k: WANT[k] for k in ((1, 0), (2, 0), (3, 0))}
    assert kept.get(1) == {"session_id": 1, "status": "active", "session": ["Hello!", "Hello! Turn 1"]} and kept.closed.length() == 0
    again = session.Sessions(spark, f"file://{tmp_path}/s", _greet, callbacks=[callback])  # restored from its folder, it goes on
    assert {(r["session_id"], r["turn"]): r["output"] for r in again.run(frame([x for x in SAID if x[1]])).collect()} == {k: v for k, v in WANT.items() if k[1]}
    assert again.get(1)["session"] == ["Hello!", "Hello! Turn 1", "How are you?", "Goodbye! Turn 2"] and again.get(3)["status"] == "failed"
    assert sorted((x.name, x.read_text()) for x in closed.iterdir()) == [("1", "succeeded"), ("2", "succeeded"), ("3", "failed")] and again.closed.length() == 3
    with pytest.raises(table.NotFound):
        again.get(77)
    # rows from elsewhere are history, and are stored once
    before = spark.createDataFrame([(8, 0, "Hello!", "Hello! Turn 1")], "session_id long, turn long, input string, output string")
    for _ in range(2):
        again.prepare(before)
    assert again.call(8, "bye") == {"session_id": 8, "output": "Goodbye! Turn 2", "status": "succeeded"} and again.turns.scan().where("session_id = 8").count() == 2
    with pytest.raises(Failed):
        again.call(8, "more")
    assert again.next_id() == 9


def test_targets_share_the_index(spark, tmp_path):
    second = Pipeline(spark, f"file://{tmp_path}/b", Module("shout", lambda message: {"loud": message.upper()}, out("message"), out("loud")))
    first = Pipeline(spark, f"file://{tmp_path}/a", Module("errors", _error_handling, TEXT, out("message")), targets=[second])
    first.run(spark.createDataFrame([("a",), ("error",), ("c",)], "input string").coalesce(1))
    first.run(spark.createDataFrame([("d",)], "input string"))
    assert second.record(0)["success"] == {"loud": "SUCCESS: A"} and second.record(2)["success"] == {"loud": "SUCCESS: C"} and second.record(3)["success"] == {"loud": "SUCCESS: D"}
    with pytest.raises(table.NotFound):
        second.record(1)


def test_ingress(spark, tmp_path):
    from urllib.error import HTTPError
    from urllib.request import Request, urlopen

    line = Pipeline(spark, f"file://{tmp_path}/p", Module("errors", _error_handling, TEXT, out("message")))
    server = ingress.serve(line, session.Sessions(spark, f"file://{tmp_path}/s", _greet))
    at = f"http://127.0.0.1:{server.server_address[1]}"
    post = lambda path, text: json.loads(urlopen(Request(at + path, text.encode(), method="POST")).read())
    assert post("/", '{"input": "a"}') == {"message": "Success: a"} and json.loads(urlopen(at + "/schema").read())["name"] == "errors"
    assert post("/4", "Hello!")["output"] == "Hello! Turn 1"
    for path, text, code in (("/", '{"input": "panic"}', 422), ("/x", "", 404)):
        with pytest.raises(HTTPError) as e:
            post(path, text)
        assert e.value.code == code
    server.shutdown()
    server.server_close()


def test_interconnect(spark):
    known = Interconnect(Module("errors", _error_handling, TEXT, out("message"), "doc"))
    known.register_session("greet", _greet)
    known.register_session("pairs", _pairs, diff=True)
    assert [(s["name"], s["kind"]) for s in known.specs()] == [("errors", "normal"), ("greet", "session"), ("pairs", "session_diff")] and known.spec("errors")["doc"] == "doc"
    with pytest.raises(KeyError):
        known.call("gone", spark.range(1))
    assert {(r["session_id"], r["turn"]): r["output"] for r in known.call_session("greet", spark.createDataFrame(SAID, "session_id long, turn long, input string")).collect()} == WANT


def test_remote_capability(spark):
    class Client:
        def call(self, method, *args):
            return f"{method}{args}"

    m = Module("remote", lambda input, caps: {"message": caps["far"].ask(input, 1)}, TEXT, out("message"), capabilities=(Capability("far", capability.Remote, {"connect": Client}),))
    assert module.run(spark.createDataFrame([(0, "x")], "index long, input string"), m).first()["output"]["message"] == "ask('x', 1)"


def test_records_are_made_once(spark, tmp_path):
    def mark(input):
        (tmp_path / f"{input}-{len(list(tmp_path.iterdir()))}").write_text("")
        return {"message": input}

    made = module.run_once(spark.createDataFrame([(0, "x")], "index long, input string"), Module("m", mark, TEXT, out("message")))
    assert module.successes(made).count() == 1 and module.failures(made).count() == 0 and len(list(tmp_path.iterdir())) == 1


def test_timed_replay(spark):
    rows, seen = spark.range(30).coalesce(1), []

    def each(row):
        seen.append(row["id"])
        if row["id"] == 3:
            raise ValueError("only counted")

    r = replay.TimedReplay(rows, each, seconds=0.001, jitter=0.005, seed=1).start()
    r.join(60)
    assert seen == list(range(30)) and r.status() == {"active": False, "sent": 30, "failed": 1, "stopped": False, "error": None}
    pauses = [r._pause() for _ in range(50)]
    assert min(pauses) >= 0 and len(set(pauses)) > 10
    slow = replay.TimedReplay(rows, seen.append, seconds=30).start()
    slow.stop()
    assert slow.status()["stopped"] and not slow.status()["active"] and slow.sent == 0


def test_live_rows(spark, tmp_path):
    spark.range(5).write.parquet(f"{tmp_path}/in")
    q = replay.live(replay.replay(spark, f"{tmp_path}/in", spark.range(1).schema), "seen_rows")
    q.processAllAvailable()
    assert spark.table("seen_rows").count() == 5
    q.stop()
    assert not replay.progress(q)["active"]


def test_session_stream(spark, tmp_path):
    for b, rows in enumerate((SAID[:1] + SAID[3:5], SAID[1:3] + SAID[5:])):
        spark.createDataFrame(rows, "session_id long, turn long, input string").coalesce(1).write.mode("append").parquet(f"{tmp_path}/in/b={b}")
    schema = T.StructType([T.StructField("session_id", T.LongType()), T.StructField("turn", T.LongType()), T.StructField("input", T.StringType())])
    got = []
    stream = replay.replay(spark, f"{tmp_path}/in/*", schema)
    q = replay.drain(session.stream_calls(stream, _greet), lambda b, _: got.extend(b.collect()), f"{tmp_path}/ckpt")
    q.awaitTermination(120)
    assert {(r["session_id"], r["turn"]): r["output"] for r in got} == WANT and replay.progress(q)["rows"] == 8


def test_replay_and_windows(spark, sf, tmp_path):
    events = spark.read.parquet(f"{sf}/events.parquet")
    events.repartition(3).write.parquet(f"{tmp_path}/events")
    seen = []
    q = replay.drain(replay.replay(spark, f"{tmp_path}/events", events.schema), lambda b, _: seen.append(b.count()), f"{tmp_path}/c1")
    q.awaitTermination(60)
    assert len(seen) == 3 and sum(seen) == events.count()
    assert replay.windowed(events).agg(F.sum("n")).first()[0] == events.count()
    assert replay.parallel(events, 4, "event_id").rdd.getNumPartitions() == 4
    log = spark.range(10).select(F.col("id").alias("row_index"))
    assert [r[0] for r in replay.keep_logs(log, 4, 3).orderBy("row_index").collect()] == [6, 7, 8, 9]
    sent = []
    replay.http_callback("http://x", lambda *a: sent.append(a))(7, {"a": 1})
    assert sent == [("http://x", {"X-Row-Index": "7"}, {"a": 1})]


def test_log_files(spark, tmp_path):
    log = logfile.LogFile(str(tmp_path / "log"), 3)
    assert [log.append({"i": i, "name": f"n{i}"}) for i in range(8)] == list(range(8))
    assert log.get(4) == {"i": 4, "name": "n4"} and log.get(9) is None and len(list(log.read_all())) == 8
    last = sorted((tmp_path / "log").glob("*.log"))[-1]
    last.write_bytes(last.read_bytes()[:-3])  # a torn tail
    again = logfile.LogFile(str(tmp_path / "log"), 3)
    assert again.next == 7 and again.append({"i": 70, "name": "x"}) == 7 and again.get(7)["i"] == 70
    logfile.log_to_parquet(spark, str(tmp_path / "log"), f"file://{tmp_path}/log.parquet")
    assert spark.read.parquet(f"file://{tmp_path}/log.parquet").count() == 8
    assert again.delete_older_than(4) == 1 and again.get(0) is None and again.get(4)["i"] == 4


def test_command_line(spark, tmp_path, capsys):
    (tmp_path / "c.json").write_text(json.dumps({"module": "millrace.plans.engine_queries:PREFIX", "path": f"file://{tmp_path}/p"}))
    (tmp_path / "in.csv").write_text("input\nhello\nworld\n")
    command.main(["run", str(tmp_path / "c.json"), f"file://{tmp_path}/in.csv", "-o", f"file://{tmp_path}/out"])
    lines = [json.loads(x) for f in sorted(tmp_path.glob("out/success.jsonl/*.json")) for x in f.read_text().splitlines()]
    assert [x["output"] for x in lines] == ["Prefixed: hello", "Prefixed: world"]
    command.main(["row", str(tmp_path / "c.json"), '{"input": "x"}'])
    command.main(["sql", f"file://{tmp_path}/in.csv", "SELECT count(*) AS n FROM data"])
    assert '{"output": "Prefixed: x"}' in capsys.readouterr().out


def test_latest(spark):
    df = spark.createDataFrame([("a", "1.9.0"), ("a", "1.10.0-rc1"), ("a", "1.10.0"), ("b", "0.1.0")], "name string, version string")
    assert {tuple(r) for r in table.latest_version(df, "name", "version").collect()} == {("a", "1.10.0"), ("b", "0.1.0")}
    assert table.latest(df, "name", ["version"]).count() == 2
