"""Queries that run the engine's own operators over the driver's tables."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from millrace import types as kinds
from millrace.functions import scalar, vector
from millrace.operators import module as modules
from millrace.operators import infer, repair
from millrace.operators.module import Failed, Module
from millrace.operators.interconnect import Interconnect
from millrace.plans import sqlview, table
from millrace.plans.pipeline import Pipeline
from millrace.sources import files
from millrace.storage import new_folder
from millrace.streaming import replay, session


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _score(event_type: str, value: float, log=None) -> dict:
    log(f"seen {event_type}")
    if event_type == "error":
        raise Failed("an error event")
    return {"label": event_type.upper(), "doubled": value * 2}


SCORE = Module("score", _score, T.StructType([T.StructField("event_type", T.StringType()), T.StructField("value", T.DoubleType())]), T.StructType([T.StructField("label", T.StringType()), T.StructField("doubled", T.DoubleType())]))
PREFIX = Module("prefix", lambda input: "Prefixed: " + input, T.StructType([T.StructField("input", T.StringType())]), T.StructType([T.StructField("output", T.StringType())]))
HELLO = Module("hello", lambda input: {"input": "Hello: " + input}, T.StructType([T.StructField("input", T.StringType())]), T.StructType([T.StructField("input", T.StringType())]))
CALLER = Module("caller", lambda input: "Caller received: " + input, T.StructType([T.StructField("input", T.StringType())]), T.StructType([T.StructField("message", T.StringType())]))


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.run(read(spark, sf_dir, "events").select(F.col("event_id").alias("index"), "event_type", "value"), SCORE)


def success_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.successes(_scored(spark, sf_dir)).select("index", "label", F.round("doubled", 4).alias("doubled"))


def failure_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.failures(_scored(spark, sf_dir)).select("row_index", "error", F.col("partial_data.event_type").alias("event_type"))


def run_tally(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.tally(_scored(spark, sf_dir))


def log_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.logs(_scored(spark, sf_dir)).select("row_index", F.get("module_logs", F.lit(0)).alias("first_log"), "failure")


def _tables(spark: SparkSession, sf_dir: str) -> list[tuple[DataFrame, str]]:
    e = read(spark, sf_dir, "events")
    stamp = lambda i: F.struct(i.alias("index"), F.lit("2026-01-01").cast("timestamp").alias("timestamp"))
    inputs = e.select("event_id", "event_type", "value", stamp(F.col("event_id")).alias("_input_meta"))
    outputs = e.where("event_type <> 'error'").select(F.upper("event_type").alias("event_type"), (F.col("value") * 2).alias("doubled"), stamp(F.col("event_id")).alias("_output_meta"))
    return [(inputs, "_input_meta"), (outputs, "_output_meta")]


def pipeline_view_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sqlview.query_pipeline(spark, _tables(spark, sf_dir), "SELECT _input_meta.index AS i, event_type, __t1_event_type AS label, round(doubled, 4) AS doubled FROM PIPELINE WHERE value > 10")


def metadata_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    tables = {name: df for name, (df, _) in zip(("inputs", "outputs"), _tables(spark, sf_dir), strict=True)}
    return sqlview.with_tables(spark, tables, "SELECT i._input_meta.index AS i, o.event_type AS label FROM inputs i JOIN outputs o ON i._input_meta.index = o._output_meta.index")


def record_assembly(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    inputs = e.select(F.col("event_id").alias("index"), "event_type")
    log = e.where("event_id % 10 <> 0").select(F.col("event_id").alias("row_index"), F.array(F.lit("l")).alias("module_logs"), F.when(F.col("event_type") == "error", "failed").alias("failure"))
    outputs = e.where("event_type <> 'error'").select(F.col("event_id").alias("index"), F.upper("event_type").alias("label"))
    return modules.assemble(inputs, log, outputs).select("index", "status", F.col("output.label").alias("label"), "error", F.size("logs").cast("long").alias("n_logs"))


def bulk_prefix(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.successes(modules.run(read(spark, sf_dir, "benchmark").select(F.col("item_id").alias("index"), F.col("text").alias("input")), PREFIX))


def compose_playbooks(spark: SparkSession, sf_dir: str) -> DataFrame:
    return modules.successes(modules.compose(read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("index"), F.col("n_name").alias("input")), HELLO, CALLER))


def _event_table(spark: SparkSession, sf_dir: str) -> table.Table:
    """Two commits, compacted: events in order, indexes dense."""
    e = read(spark, sf_dir, "events").select("event_id", "event_type")
    t = table.Table(spark, new_folder(spark, "events"), e.schema)
    t.append(e.where("event_id % 2 = 0"), ["event_id"])
    t.append(e.where("event_id % 2 = 1"), ["event_id"])
    t.compact()
    return t


def page_slice(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_table(spark, sf_dir).page(100, 50).select("event_id", F.col("_output_meta.index").alias("index"))


def point_lookup(spark: SparkSession, sf_dir: str) -> DataFrame:
    row = _event_table(spark, sf_dir).get(7)
    return spark.createDataFrame([(row["event_id"], row["event_type"])], "event_id long, event_type string")


def tier_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _event_table(spark, sf_dir).scan().select("event_id", F.col("_output_meta.index").alias("index"))


def row_index_assign(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table.with_index(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), [F.col("o_totalprice").desc(), "o_orderkey"]).select("o_orderkey", "index")


def repair_int(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.element_at(F.array(*map(F.lit, ["42", " 42", "-7", "+5", "1.5", "x", "300", "", "99999999999"])), (F.col("event_id") % 9 + 1).cast("int"))
    e = read(spark, sf_dir, "events").select("event_id", texts.alias("t"), (F.col("value") * 1000).alias("d"))
    out = repair.project_repair(e, kinds.group(("event_id", kinds.prim("I64"), False), ("t", kinds.prim("I32"), True), ("d", kinds.prim("I16"), True)))
    return out.select("event_id", F.col("t").cast("long").alias("t"), F.col("d").cast("long").alias("d"), F.col("_error").alias("error"))


def repair_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    words = F.element_at(F.array(*map(F.lit, ["TRUE", "no", "1", "t", "0", "Yes", "off"])), (F.col("event_id") % 7 + 1).cast("int"))
    e = read(spark, sf_dir, "events").select("event_id", words.alias("b"))
    return repair.project_repair(e, kinds.group(("event_id", kinds.prim("I64"), False), ("b", kinds.prim("Bool"), True))).select("event_id", "b", F.col("_error").alias("error"))


def repair_list(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.array(F.col("event_id").cast("string"), F.lit(None), F.col("user_id").cast("string")).alias("l"), F.col("user_id").alias("s"))
    out = repair.project_repair(e, kinds.group(("event_id", kinds.prim("I64"), False), ("l", kinds.listed(kinds.prim("I64")), True), ("s", kinds.listed(kinds.prim("I64")), True), ("gone", kinds.prim("Str"), True)))
    return out.select("event_id", F.size("l").cast("long").alias("n"), F.element_at("l", 2).alias("second"), F.element_at("s", 1).alias("one"), "gone", F.col("_error").alias("error"))


def project_columns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair.project(read(spark, sf_dir, "nation"), kinds.group(("n_name", kinds.prim("Str"), True), ("missing", kinds.prim("I64"), True), ("n_nationkey", kinds.prim("I32"), True)))


def coerce_union(spark: SparkSession, sf_dir: str) -> DataFrame:
    a = read(spark, sf_dir, "region").select(F.col("r_regionkey").alias("k"), F.col("r_name").alias("name"))
    b = read(spark, sf_dir, "orders").select(F.col("o_orderkey").alias("k"), F.col("o_totalprice").alias("price"))
    return kinds.union(a, b)


def deep_get(spark: SparkSession, sf_dir: str) -> DataFrame:
    df = read(spark, sf_dir, "nation").select("n_nationkey", F.struct(F.struct(F.col("n_name").alias("c")).alias("b")).alias("a"))
    return df.select("n_nationkey", repair.deep_get(df, "a.b.c").alias("c"), repair.deep_get(df, "a.x.c").cast("string").alias("blocked"))


def time_parse(spark: SparkSession, sf_dir: str) -> DataFrame:
    forms = ["yyyy-MM-dd'T'HH:mm:ss'Z'", "yyyy-MM-dd HH:mm:ss", "yyyy-MM-dd'T'HH:mm", "yyyy-MM-dd HH:mm", "yyyy-MM-dd HH", "yyyy-MM-dd"]
    text = F.element_at(F.array(*(F.date_format("o_orderdate", f) for f in forms)), (F.col("o_orderkey") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "orders").select("o_orderkey", scalar.parse_time(text).cast("timestamp_ntz").alias("t"))


def scalar_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events")
    k, u = F.col("event_id"), F.col("user_id")
    return e.select("event_id", scalar.prefix(F.col("event_type")).alias("p"), scalar.transform_text(F.col("event_type"), "[test] ", "!ab", True).alias("t"), scalar.gcd_column(k, u).alias("g"), scalar.lcm_column(k + 1, u + 1).alias("l"), scalar.bounded_add(k, u, 0, 500).alias("b"), scalar.trunc_number(F.col("value") - 50).cast("long").alias("tr"), scalar.method_allowed(F.col("event_type"), ["Click", "VIEW"]).alias("m"), (k == 0).alias("z"))


def crc32c(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "benchmark").select("item_id", scalar.crc32c("text").alias("crc"))


def cosine(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return v.select("vec_id", F.round(vector.cosine(F.col("embedding"), F.reverse("embedding")), 5).alias("c"))


def vector_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    first = v.where("vec_id = 0").first()
    return vector.search(v, first["embedding"] if first else [0.0], 10).select("vec_id", F.round("score", 5).alias("score"))


def vector_search_all(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = read(spark, sf_dir, "embeddings")
    return vector.search_all(v, v.where("vec_id % 100 = 0").select(F.col("vec_id").alias("query_id"), "embedding"), 5).select("query_id", "item_id", F.round("score", 5).alias("score"), F.col("rank").cast("long").alias("rank"))


def text_embedding(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "documents").select("doc_id", vector.embed_text("text").alias("e")).select("doc_id", F.size("e").cast("long").alias("n"), F.round(F.sqrt(vector.dot(F.col("e"), F.col("e"))), 3).alias("norm"))


def _turns(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "conversations")


def _say(history: list, row: str):
    """Goes on whatever is said, and ends when it is told to."""
    return session.End(row[::-1]) if row.startswith("a") else session.Continue(row[::-1])


def _rolled(spark: SparkSession, sf_dir: str) -> DataFrame:
    turns = _turns(spark, sf_dir).select(F.col("conv_id").alias("session_id"), "turn", F.coalesce("text", F.lit("")).alias("input"))
    last = turns.groupBy("session_id").agg((F.max("turn") + 1).alias("turn")).select("session_id", "turn", F.lit("a end").alias("input"))
    return session.rollup(session.calls(turns.union(last), _say))


def session_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A closed session as one list: inputs and outputs in turn."""
    return _rolled(spark, sf_dir).select("session_id", F.size("session").cast("long").alias("n"), F.md5(F.array_join("session", "|")).alias("h"))


def session_pairs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The same as two lists."""
    return _rolled(spark, sf_dir).select("session_id", F.md5(F.array_join("inputs", "|")).alias("inputs"), F.md5(F.array_join("outputs", "|")).alias("outputs"))


def session_split(spark: SparkSession, sf_dir: str) -> DataFrame:
    parts = _rolled(spark, sf_dir).select("session_id", *session.split_record())
    return parts.select("session_id", F.size("prior").cast("long").alias("prior"), "input", "success")


def session_unpaired(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two lists as rows again."""
    rows = session.explode_pairs(_rolled(spark, sf_dir))
    return rows.select("session_id", F.col("turn").cast("long").alias("turn"), F.md5("inputs").alias("input"), F.md5("outputs").alias("output"))


def _count_pairs(inputs: list, outputs: list, row: str):
    return session.Continue(f"{len(inputs)},{len(outputs)},{len(row)}")


def session_diff(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module that gets inputs and outputs as two lists."""
    turns = _turns(spark, sf_dir).select(F.col("conv_id").alias("session_id"), "turn", F.coalesce("text", F.lit("")).alias("input"))
    return session.calls(turns, _count_pairs, diff=True).select("session_id", "turn", "output", "status")


def turn_number(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module that counts turns by the length of its history."""
    turns = _turns(spark, sf_dir).select(F.col("conv_id").alias("session_id"), "turn", F.coalesce("text", F.lit("")).alias("input"))
    made = session.calls(turns, lambda history, row: session.Continue(str((len(history) + 1) // 2)))
    return made.select("session_id", "turn", F.col("output").cast("long").alias("number"))


def session_goes_on(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions with rows from before: later turns count on from the history that earlier ones left."""
    turns = _turns(spark, sf_dir).select(F.col("conv_id").alias("session_id"), "turn", F.coalesce("text", F.lit("")).alias("input"))
    count = lambda history, row: session.Continue(str(len(history)))
    before = turns.where("turn < 3").withColumns({"output": F.lit("old"), "status": F.lit("active"), "error": F.lit(None).cast("string")})
    return session.calls(turns.where("turn >= 3"), count, prior=before).select("session_id", "turn", F.col("output").cast("long").alias("before"))


def session_next_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.createDataFrame([(session.next_id(_calls(spark, sf_dir)),)], "next long")


def session_newest(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.newest(_calls(spark, sf_dir), "closed").select("session_id", "status")


def _machine(history: list, row: str):
    """Ends with the third call; a very long first input terminates, an empty one fails."""
    turn = len(history) // 2 + 1
    if not row:
        raise Failed("empty")
    if len(row) % 11 == 0:
        return session.Terminate()
    return (session.End if turn >= 3 else session.Continue)(f"turn {turn}")


def _calls(spark: SparkSession, sf_dir: str) -> DataFrame:
    users = _turns(spark, sf_dir).where("role = 'user'").select(F.col("conv_id").alias("session_id"), "turn", F.col("text").alias("input"))
    return session.calls(users, _machine)


def session_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.status(_calls(spark, sf_dir)).select("session_id", "status", "length")


def session_explode(spark: SparkSession, sf_dir: str) -> DataFrame:
    return session.explode_session(session.rollup(_calls(spark, sf_dir))).select("session_id", F.col("pos").cast("long").alias("pos"), F.md5(F.coalesce("value", F.lit("-"))).alias("value"))


def repair_float(spark: SparkSession, sf_dir: str) -> DataFrame:
    texts = F.element_at(F.array(*map(F.lit, ["1.5", " 2", "-.5", "3e2", "x", "7", "1d"])), (F.col("event_id") % 7 + 1).cast("int"))
    e = read(spark, sf_dir, "events").select("event_id", texts.alias("t"), F.col("user_id").alias("u"), (F.col("user_id") % 2 == 0).alias("b"))
    double = kinds.prim("F64")
    out = repair.project_repair(e, kinds.group(("event_id", kinds.prim("I64"), False), ("t", double, True), ("u", double, True), ("b", double, True)))
    return out.select("event_id", "t", "u", "b", F.col("_error").alias("error"))


def repair_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").alias("u"), (F.col("user_id") / 4).alias("q"), (F.col("user_id") % 2 == 0).alias("b"))
    text = kinds.prim("Str")
    return repair.project_repair(e, kinds.group(("event_id", kinds.prim("I64"), False), ("u", text, True), ("q", text, True), ("b", text, True))).select("event_id", "u", "q", "b", F.col("_error").alias("error"))


def repair_timestamp(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Time stamps pass, text doesn't."""
    e = read(spark, sf_dir, "events").select("event_id", F.col("ts").cast("timestamp").alias("t"), F.lit("2024-01-01").alias("s"))
    out = repair.project_repair(e, kinds.group(("event_id", kinds.prim("I64"), False), ("t", kinds.prim("Timestamp"), True), ("s", kinds.prim("Timestamp"), True)))
    return out.select("event_id", F.col("t").cast("timestamp_ntz").alias("t"), F.col("s").isNull().alias("none"), F.col("_error").alias("error"))


def repair_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.struct(F.col("user_id").cast("string").alias("a"), F.lit("x").alias("b"), F.array(F.col("event_id").cast("string")).alias("l")).alias("g"))
    inner = kinds.group(("a", kinds.prim("I32"), True), ("l", kinds.listed(kinds.prim("I64")), True), ("c", kinds.prim("Bool"), True))
    out = repair.project_repair(e, kinds.group(("event_id", kinds.prim("I64"), False), ("g", inner, True)))
    return out.select("event_id", F.col("g.a").cast("long").alias("a"), F.element_at("g.l", 1).alias("l"), F.col("g.c").isNull().alias("c"), F.col("_error").alias("error"))


def repair_map(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.create_map(F.col("event_id").cast("string"), F.col("user_id").cast("string"), F.lit("-1"), F.when(F.col("event_id") % 5 == 0, "x").otherwise("2.5")).alias("m"))
    out = repair.project_repair(e, kinds.group(("event_id", kinds.prim("I64"), False), ("m", kinds.mapped(kinds.prim("I64"), kinds.prim("F64")), True)))
    return out.select("event_id", F.try_element_at("m", F.col("event_id")).alias("own"), F.try_element_at("m", F.lit(-1).cast("long")).alias("other"), F.col("_error").alias("error"))


def coerce_bool(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Any number is a boolean when values are coerced; repair takes integers only."""
    e = read(spark, sf_dir, "events").select("event_id", (F.col("user_id") % 3).cast("double").alias("f"), (F.col("user_id") % 2).cast("short").alias("i"))
    want = kinds.group(("event_id", kinds.prim("I64"), False), ("f", kinds.prim("Bool"), True), ("i", kinds.prim("Bool"), True))
    strict = repair.project_repair(e, want).select(F.col("event_id").alias("e"), F.col("_error").alias("strict"))
    out = repair.project_repair(e, want, mode="coerce").withColumnRenamed("_error", "error")
    return out.join(strict, F.col("event_id") == F.col("e")).select("event_id", "f", "i", "error", "strict")


def data_view(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SQL over one table by the name `data`, a CTE of its own included."""
    return sqlview.query_data(read(spark, sf_dir, "events"), "WITH t AS (SELECT event_type, value FROM data WHERE value > 10) SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM t GROUP BY event_type")


def data_statements(spark: SparkSession, sf_dir: str) -> DataFrame:
    """DESCRIBE, SHOW and EXPLAIN of `data`."""
    e = read(spark, sf_dir, "events")
    described = sqlview.query_data(e, "DESCRIBE data").select(F.lit("describe").alias("what"), F.col("col_name").alias("name"))
    shown = sqlview.query_data(e, "SHOW COLUMNS IN data").select(F.lit("show").alias("what"), F.col("col_name").alias("name"))
    plan = sqlview.query_data(e, "EXPLAIN SELECT event_id FROM data WHERE value > 1").select(F.lit("explain").alias("what"), F.when(F.col("plan").contains("PushedFilters: [IsNotNull(value), GreaterThan(value,1.0)]"), "pushed").otherwise(F.col("plan")).alias("name"))
    return described.union(shown).union(plan)


def table_length(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows of a table with two commits and one row that still waits."""
    t = _event_table(spark, sf_dir)
    t.put({"event_id": -1, "event_type": "waiting"})
    return spark.createDataFrame([(t.length(), t.next_index())], "n long, next long")


def waiting_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A scan sees rows that aren't committed yet."""
    t = _event_table(spark, sf_dir)
    t.put({"event_id": -1, "event_type": "waiting"})
    return t.scan().select("event_id", F.col("_output_meta.index").alias("index"))


def file_index_ranges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The index ranges of files: they don't overlap, and cover all indexes."""
    ranges = _event_table(spark, sf_dir).file_ranges()
    return ranges.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n"), F.sum(F.col("high") - F.col("low") + 1).alias("covered"))


def type_equality(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = read(spark, sf_dir, "events").select("event_id", F.col("user_id").cast("long").alias("a"), (F.col("user_id") % 100).cast("short").alias("b"), F.col("value").alias("f"), F.col("ts").alias("t"))
    p, later = kinds.prim, F.col("t") + F.expr("INTERVAL '0.4' SECOND")
    return e.select("event_id", kinds.equals(F.col("a"), p("I64"), F.col("b"), p("I16")).alias("ints"), kinds.equals(F.col("a"), p("I64"), F.col("a").cast("double"), p("F64")).alias("mixed"), kinds.equals(F.col("f"), p("F64"), F.round("f"), p("F64")).alias("floats"), kinds.equals(F.col("t"), p("Timestamp"), later, p("Timestamp")).alias("times"))


def url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    """URLs that are a pattern, below one, or begin with what comes before `/*`."""
    first = F.regexp_extract("url", "^([a-z]+://[^/]+)", 1)
    made = read(spark, sf_dir, "pages").select("page_id", F.element_at(F.array(F.lit("http://a/x"), F.lit("http://a/x/y"), F.lit("http://a/xy"), F.lit("http://b"), F.lit("http://bc/d"), F.lit("http://c/"), first), (F.col("page_id") % 7 + 1).cast("int")).alias("url"))
    return made.where(scalar.url_allowed(F.col("url"), ["http://a/x", "http://b/*", "http://c/"])).select("page_id", "url")


def adder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module with two inputs and two outputs."""
    longs = lambda *names: T.StructType([T.StructField(n, T.LongType()) for n in names])
    m = Module("adder", lambda a, b: {"sum": a + b, "is_even": (a + b) % 2 == 0}, longs("a", "b"), T.StructType([T.StructField("sum", T.LongType()), T.StructField("is_even", T.BooleanType())]))
    return modules.successes(modules.run(read(spark, sf_dir, "events").select(F.col("event_id").alias("index"), F.col("event_id").alias("a"), F.col("user_id").alias("b")), m))


def list_module(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A module over a list of structs that returns a list."""
    turn = T.StructType([T.StructField("turn", T.LongType()), T.StructField("role", T.StringType())])
    m = Module("roles", lambda turns: {"roles": [t["role"].upper() for t in turns], "n": len(turns)}, T.StructType([T.StructField("turns", T.ArrayType(turn))]), T.StructType([T.StructField("roles", T.ArrayType(T.StringType())), T.StructField("n", T.LongType())]))
    one = F.struct(F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"))
    rows = _turns(spark, sf_dir).groupBy(F.col("conv_id").alias("index")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    return modules.successes(modules.run(rows, m)).select("index", F.array_join("roles", ",").alias("roles"), "n")


def interconnect(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One module called by name on another's successes, and their specifications."""
    known = Interconnect(HELLO, CALLER)
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("index"), F.col("n_name").alias("input"))
    out = modules.successes(known.call("caller", modules.successes(known.call("hello", rows))))
    return out.select("index", "message", F.lit(",".join(s["name"] for s in known.specs())).alias("known"))


def interconnect_session(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A session module called by name, on a module's successes."""
    known = Interconnect(HELLO)
    known.register_session("counter", lambda history, row: session.Continue(f"{len(history)}: {row}"))
    rows = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("index"), F.col("n_name").alias("input"))
    said = modules.successes(known.call("hello", rows)).select((F.col("index") % 4).alias("session_id"), F.col("index").alias("turn"), "input")
    return known.call_session("counter", said).select("session_id", "turn", "output")


def large_scalars(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values beyond what a double holds exactly."""
    k = F.col("event_id").cast("long")
    odd = F.lit(2**53 + 1).cast("long")
    return read(spark, sf_dir, "events").select("event_id", scalar.lcm_column(odd, F.lit(1)).alias("l"), scalar.gcd_column(odd * 7, odd * 14).alias("g"), scalar.lcm_column(k + 3_000_000_000, F.lit(2)).alias("l2"), F.unix_micros(scalar.from_unit(F.lit(1_700_000_000_000_000_999).cast("long") + k * 1_000_003, "ns")).alias("us"), scalar.bounded_add(F.lit(2**63 - 2).cast("long"), k).alias("b"))


def time_forms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fractions of any length, zones, and forms that are no time."""
    forms = ["2024-03-01T10:20:30.123456789Z", "2024-03-01T10:20:30.5", "2024-03-01T10:20:30.25+02:00", "2024/03/01 10:20", "2024-03-01 10", "soon"]
    text = F.element_at(F.array(*map(F.lit, forms)), (F.col("event_id") % 6 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", F.unix_micros(scalar.parse_time(text)).alias("us"))


def list_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Texts of a list transformed, and numbers of lists read as integers and doubles, by force where they are neither."""
    p = kinds.prim
    e = read(spark, sf_dir, "events").select("event_id", F.array(F.col("event_type"), F.lit("b")).alias("t"), F.array("user_id", "event_id").alias("i"), F.array(F.col("value"), F.lit(-1.5)).alias("f"), F.array(F.col("user_id").cast("string"), F.lit("x")).alias("s"))
    join = lambda c: F.array_join(F.transform(c, lambda x: F.coalesce(x.cast("string"), F.lit("-"))), ",")
    return e.select("event_id", F.array_join(scalar.transform_texts(F.col("t"), "<", ">", True), ",").alias("t"), join(repair.integers(F.col("i"), p("I64"))).alias("i"), join(F.slice(repair.integers(F.col("f"), p("F64"), True), 2, 1)).alias("f"), F.size(repair.integers(F.col("f"), p("F64"))).cast("long").alias("none"), join(repair.integers(F.col("s"), p("Str"), True)).alias("s"), F.element_at(repair.floats(F.col("s"), p("Str"), True), 1).alias("d"))


def text_functions(spark: SparkSession, sf_dir: str) -> DataFrame:
    k = F.col("event_id")
    digits = F.element_at(F.array(*map(F.lit, ["12", "-3", "18446744073709551615", "18446744073709551616", "+7", ""])), (k % 6 + 1).cast("int"))
    return read(spark, sf_dir, "events").select("event_id", scalar.parse_unsigned(digits).cast("string").alias("u"), scalar.embedding_text(F.col("event_type"), F.array(k, k)).alias("e"), F.length(scalar.preview(F.repeat(F.concat("event_type", F.lit(" ")), 40))).cast("long").alias("p"), scalar.format_time(F.timestamp_seconds(k)).alias("t"))


def put_column(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A column replaced in place, one inserted, and a deep test for null."""
    df = read(spark, sf_dir, "nation").select("n_nationkey", "n_name", F.struct(F.when(F.col("n_nationkey") % 2 == 0, F.col("n_name")).alias("x")).alias("g"))
    out = repair.put(repair.put(df, "N_NAME", F.lower("n_name")), "more", F.col("n_nationkey") * 2)
    return out.select("n_nationkey", "n_name", F.col("more").cast("long").alias("more"), repair.is_null(out, "g.x").alias("gone"), repair.is_null(out, "g.y").alias("never"))


def file_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A table exported as CSV and JSON lines in chunks, and as Parquet, and read again."""
    n, folder, out = read(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("k"), F.col("n_name").alias("name")), new_folder(spark, "export"), None
    for kind in ("csv", "jsonl", "parquet"):
        files.export(n, f"{folder}/all.{kind}", kind, 10)
        back = files.read_any(spark, f"{folder}/all.{kind}").select(F.lit(kind).alias("kind"), F.col("k").cast("long").alias("k"), "name")
        out = back if out is None else out.union(back)
    return out


def ipc_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A result as an Arrow file, read as a table and as JSON with its schema."""
    data = files.to_ipc(read(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("k"), F.col("r_name").alias("name")))
    shown = files.ipc_to_json(data)
    rows = [(r["k"], r["name"], ",".join(f["name"] for f in shown["schema"]), files.content_hash(b"abc")) for r in shown["rows"]]
    return spark.createDataFrame(rows, "k long, name string, schema string, hash string")


def ipc_folder(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Arrow files of a folder, written from the executors and read there."""
    folder = new_folder(spark, "ipc")
    files.write_ipc_folder(read(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice").repartition(3), folder)
    return files.read_ipc(spark, folder)


def json_row(spark: SparkSession, sf_dir: str) -> DataFrame:
    a, b = files.read_row(spark, '{"a": 7, "b": {"c": "x"}, "l": [1, 2]}'), files.read_row(spark, '[["a", 8], ["b", {"c": "y"}], ["l", [3]]]')
    return a.union(b).select(F.col("a").cast("long").alias("a"), F.col("b.c").alias("c"), F.size("l").cast("long").alias("n"))


def bulk_file(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A whole file through a pipeline and its tables."""
    texts = T.StructType([T.StructField("text", T.StringType())])
    line = Pipeline(spark, new_folder(spark, "pipeline"), Module("prefix", lambda text: {"output": "Prefixed: " + text}, texts, T.StructType([T.StructField("output", T.StringType())])))
    line.bulk(f"{sf_dir}/benchmark.parquet")
    return line.data("SELECT output FROM data")


def chained_pipelines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A pipeline whose successes another one stores under the same index."""
    folder = new_folder(spark, "pipeline")
    second = Pipeline(spark, f"{folder}/b", CALLER)
    first = Pipeline(spark, f"{folder}/a", HELLO, targets=[second])
    first.run(read(spark, sf_dir, "nation").select(F.col("n_name").alias("input")), ["input"])
    return second.data("SELECT _output_meta.index AS index, message FROM data")


def replay_drain(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Events replayed from their file as a stream, each batch a commit of a table."""
    schema, folder = read(spark, sf_dir, "events").schema, new_folder(spark, "replay")
    t = table.Table(spark, f"{folder}/t", T.StructType([f for f in schema if f.name in ("event_id", "event_type")]))
    replay.drain(replay.replay(spark, f"{sf_dir}/events.parque*", schema), lambda b, _: t.append(b.select("event_id", "event_type"), ["event_id"]), f"{folder}/c").awaitTermination()
    return t.scan().groupBy("event_type").agg(F.count("*").alias("n"), F.max("event_id").alias("last"))


def watermark_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return replay.windowed(read(spark, sf_dir, "events")).select("start", "event_type", "n")


def log_retention(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whole segments of 64 rows are dropped, so that the newest 100 stay."""
    return replay.keep_logs(read(spark, sf_dir, "events").select(F.col("event_id").alias("row_index")), 100, 64)


def newest_version(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The greatest semantic version of each name; a pre-release comes before its release."""
    n = F.col("n_nationkey")
    versions = read(spark, sf_dir, "nation").select(F.concat(F.lit("m"), n % 3).alias("name"), F.concat(F.lit("1."), n, F.when(n % 2 == 0, "").otherwise(".0-rc1")).alias("version"))
    return table.latest_version(versions.withColumn("version", F.concat("version", F.when(F.contains("version", F.lit("-")), "").otherwise(".0"))), "name", "version")


def inferred_types(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The common type of JSON texts, found on the executors."""
    kind = infer.infer_json(read(spark, sf_dir, "events"), "props")
    return spark.createDataFrame([(n, repr(k)) for n, k, _ in kind.args[0]], "field string, kind string")


QUERIES = [
    file_round_trip, ipc_round_trip, ipc_folder, json_row, bulk_file, chained_pipelines, replay_drain, watermark_windows, log_retention, newest_version, inferred_types,
    success_split, failure_split, run_tally, log_scan, pipeline_view_join, metadata_join, record_assembly, bulk_prefix, compose_playbooks, page_slice, point_lookup, tier_union, row_index_assign, repair_int, repair_bool,
    repair_list, project_columns, coerce_union, deep_get, time_parse, scalar_functions, crc32c, cosine, vector_topk, vector_search_all, text_embedding, session_fold, session_pairs, session_status, session_explode,
    session_split, session_unpaired, session_diff, turn_number, session_goes_on, session_next_id, session_newest, repair_float, repair_text, repair_timestamp, repair_group, repair_map, coerce_bool, data_view, data_statements,
    table_length, waiting_rows, file_index_ranges, type_equality, url_filter, adder, list_module, interconnect, interconnect_session, large_scalars, time_forms, list_functions, text_functions, put_column,
]

_SESSIONS = """
WITH u AS (SELECT conv_id, turn, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS k FROM conversations WHERE role = 'user'),
s AS (SELECT *, text = '' OR length(text) % 11 = 0 OR k >= 3 AS closes FROM u),
t AS (SELECT *, coalesce(sum(closes::INT) OVER (PARTITION BY conv_id ORDER BY k ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS closed FROM s),
o AS (SELECT *, CASE WHEN text = '' THEN 'failed' WHEN closes THEN 'succeeded' ELSE 'active' END AS status FROM t WHERE closed = 0)
"""

# what _say makes of a conversation: up to the first text that begins with an a, or to the one added at the end
_FOLD = """
WITH a AS (SELECT conv_id AS session_id, turn, coalesce(text, '') AS i FROM conversations WHERE conv_id IS NOT NULL UNION ALL SELECT conv_id, max(turn) + 1, 'a end' FROM conversations WHERE conv_id IS NOT NULL GROUP BY conv_id),
b AS (SELECT *, row_number() OVER (PARTITION BY session_id ORDER BY turn, i) AS k FROM a),
f AS (SELECT session_id, k, i, reverse(i) AS o FROM b WHERE k <= (SELECT min(k) FROM b x WHERE x.session_id = b.session_id AND starts_with(x.i, 'a')))
"""

ORACLE: dict[str, str] = {
    "success_split": "SELECT event_id AS index, upper(event_type) AS label, round(value * 2, 4) AS doubled FROM events WHERE event_type <> 'error'",
    "failure_split": "SELECT event_id AS row_index, 'an error event' AS error, event_type FROM events WHERE event_type = 'error'",
    "run_tally": "SELECT count(*) AS n, count(*) FILTER (WHERE event_type <> 'error') AS succeeded, count(*) FILTER (WHERE event_type = 'error') AS failed FROM events",
    "log_scan": "SELECT event_id AS row_index, 'seen ' || event_type AS first_log, CASE WHEN event_type = 'error' THEN 'an error event' END AS failure FROM events",
    "pipeline_view_join": "SELECT event_id AS i, event_type, upper(event_type) AS label, round(value * 2, 4) AS doubled FROM events WHERE event_type <> 'error' AND value > 10",
    "metadata_join": "SELECT event_id AS i, upper(event_type) AS label FROM events WHERE event_type <> 'error'",
    "record_assembly": "SELECT event_id AS index, CASE WHEN event_type = 'error' AND event_id % 10 <> 0 THEN 'failure' WHEN event_type <> 'error' THEN 'success' ELSE 'not_found' END AS status, CASE WHEN event_type <> 'error' THEN upper(event_type) END AS label, CASE WHEN event_type = 'error' AND event_id % 10 <> 0 THEN 'failed' END AS error, CASE WHEN event_id % 10 <> 0 THEN 1 ELSE 0 END::BIGINT AS n_logs FROM events",
    "bulk_prefix": "SELECT item_id AS index, 'Prefixed: ' || text AS output FROM benchmark",
    "compose_playbooks": "SELECT n_nationkey::BIGINT AS index, 'Caller received: Hello: ' || n_name AS message FROM nation",
    "page_slice": "SELECT event_id, i AS index FROM (SELECT event_id, row_number() OVER (ORDER BY event_id % 2, event_id) - 1 AS i FROM events) WHERE i BETWEEN 100 AND 149",
    "point_lookup": "SELECT event_id, event_type FROM (SELECT *, row_number() OVER (ORDER BY event_id % 2, event_id) - 1 AS i FROM events) WHERE i = 7",
    "tier_union": "SELECT event_id, row_number() OVER (ORDER BY event_id % 2, event_id) - 1 AS index FROM events",
    "row_index_assign": "SELECT o_orderkey, row_number() OVER (ORDER BY o_totalprice DESC, o_orderkey) - 1 AS index FROM orders",
    "repair_int": "WITH t AS (SELECT event_id, (['42', ' 42', '-7', '+5', '1.5', 'x', '300', '', '99999999999'])[event_id % 9 + 1] AS s, value * 1000 AS v FROM events) SELECT event_id, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') AND try_cast(s AS BIGINT) BETWEEN -2147483648 AND 2147483647 THEN try_cast(s AS BIGINT) END AS t, greatest(-32768, least(32767, trunc(v)))::BIGINT AS d, CASE WHEN regexp_full_match(s, '[+-]?[0-9]+') AND try_cast(s AS BIGINT) BETWEEN -2147483648 AND 2147483647 THEN NULL ELSE 't: Parse' END AS error FROM t",
    "repair_bool": "WITH t AS (SELECT event_id, (['TRUE', 'no', '1', 't', '0', 'Yes', 'off'])[event_id % 7 + 1] AS s FROM events) SELECT event_id, CASE WHEN lower(s) IN ('true', '1', 'yes') THEN true WHEN lower(s) IN ('false', '0', 'no') THEN false END AS b, CASE WHEN lower(s) NOT IN ('true', '1', 'yes', 'false', '0', 'no') THEN 'b: Parse' END AS error FROM t",
    "repair_list": "SELECT event_id, 2::BIGINT AS n, user_id AS second, user_id AS one, NULL::VARCHAR AS gone, NULL::VARCHAR AS error FROM events",
    "project_columns": "SELECT n_name, NULL::BIGINT AS missing, n_nationkey FROM nation",
    "coerce_union": "SELECT r_regionkey::BIGINT AS k, r_name AS name, NULL::DOUBLE AS price FROM region UNION ALL SELECT o_orderkey, NULL, o_totalprice FROM orders",
    "deep_get": "SELECT n_nationkey, n_name AS c, NULL::VARCHAR AS blocked FROM nation",
    "time_parse": "SELECT o_orderkey, CASE o_orderkey % 6 WHEN 0 THEN date_trunc('second', o_orderdate) WHEN 1 THEN date_trunc('second', o_orderdate) WHEN 2 THEN date_trunc('minute', o_orderdate) WHEN 3 THEN date_trunc('minute', o_orderdate) WHEN 4 THEN date_trunc('hour', o_orderdate) ELSE date_trunc('day', o_orderdate)::TIMESTAMP END AS t FROM orders",
    "scalar_functions": "SELECT event_id, 'Prefixed: ' || event_type AS p, '[TEST] ' || upper(event_type) || '!ab' AS t, gcd(event_id, user_id)::BIGINT AS g, lcm(event_id + 1, user_id + 1)::BIGINT AS l, least(500, event_id + user_id) AS b, trunc(value - 50)::BIGINT AS tr, event_type IN ('click', 'view') AS m, event_id = 0 AS z FROM events",
    "cosine": "SELECT vec_id, round(coalesce(list_cosine_similarity(embedding::DOUBLE[], list_reverse(embedding::DOUBLE[])), 0), 5) AS c FROM embeddings",
    "vector_topk": "SELECT v.vec_id, round(list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 5) AS score FROM embeddings v, (SELECT embedding FROM embeddings WHERE vec_id = 0) q ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id LIMIT 10",
    "vector_search_all": "SELECT query_id, item_id, round(s, 5) AS score, rank FROM (SELECT q.vec_id AS query_id, v.vec_id AS item_id, list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) AS s, row_number() OVER (PARTITION BY q.vec_id ORDER BY list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]) DESC, v.vec_id) AS rank FROM embeddings v, embeddings q WHERE q.vec_id % 100 = 0) WHERE rank <= 5",
    "file_round_trip": "SELECT unnest(['csv', 'jsonl', 'parquet']) AS kind, n_nationkey::BIGINT AS k, n_name AS name FROM nation",
    "ipc_round_trip": "SELECT r_regionkey::BIGINT AS k, r_name AS name, 'k,name' AS schema, sha256('abc') AS hash FROM region",
    "ipc_folder": "SELECT o_orderkey, o_totalprice FROM orders",
    "json_row": "SELECT * FROM (VALUES (7::BIGINT, 'x', 2::BIGINT), (8, 'y', 1)) t(a, c, n)",
    "bulk_file": "SELECT 'Prefixed: ' || text AS output FROM benchmark",
    "chained_pipelines": "SELECT row_number() OVER (ORDER BY n_name) - 1 AS index, 'Caller received: Hello: ' || n_name AS message FROM nation",
    "replay_drain": "SELECT event_type, count(*) AS n, max(event_id) AS last FROM events GROUP BY event_type",
    "watermark_windows": "SELECT date_trunc('hour', ts) AS start, event_type, count(*) AS n FROM events GROUP BY 1, 2",
    "log_retention": "SELECT event_id AS row_index FROM events WHERE event_id // 64 >= ((SELECT max(event_id) FROM events) + 1 - 100) // 64",
    "newest_version": "SELECT 'm' || (n_nationkey % 3) AS name, '1.' || max(n_nationkey) || CASE WHEN max(n_nationkey) % 2 = 0 THEN '.0' ELSE '.0-rc1' END AS version FROM nation GROUP BY n_nationkey % 3",
    "inferred_types": "SELECT 'k' AS field, 'I64' AS kind",
    "session_fold": _FOLD + "SELECT session_id, 2 * count(*) AS n, md5(string_agg(i || '|' || o, '|' ORDER BY k)) AS h FROM f GROUP BY session_id",
    "session_pairs": _FOLD + "SELECT session_id, md5(string_agg(i, '|' ORDER BY k)) AS inputs, md5(string_agg(o, '|' ORDER BY k)) AS outputs FROM f GROUP BY session_id",
    "session_split": _FOLD + "SELECT session_id, 2 * count(*) - 2 AS prior, arg_max(i, k) AS input, arg_max(o, k) AS success FROM f GROUP BY session_id",
    "session_unpaired": _FOLD + "SELECT session_id, row_number() OVER (PARTITION BY session_id ORDER BY k) - 1 AS turn, md5(i) AS input, md5(o) AS output FROM f",
    "session_diff": "SELECT conv_id AS session_id, turn::BIGINT AS turn, (k - 1) || ',' || (k - 1) || ',' || length(coalesce(text, '')) AS output, 'active' AS status FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS k FROM conversations) WHERE conv_id IS NOT NULL",
    "turn_number": "SELECT conv_id AS session_id, turn::BIGINT AS turn, ((2 * (k - 1) + 1) // 2)::BIGINT AS number FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS k FROM conversations) WHERE conv_id IS NOT NULL",
    "session_goes_on": "SELECT conv_id AS session_id, turn::BIGINT AS turn, (2 * (k - 1))::BIGINT AS before FROM (SELECT *, row_number() OVER (PARTITION BY conv_id ORDER BY turn, coalesce(text, '')) AS k FROM conversations) WHERE turn >= 3 AND conv_id IS NOT NULL",
    "session_next_id": "SELECT max(conv_id) + 1 AS next FROM conversations WHERE role = 'user'",
    "session_newest": _SESSIONS + "SELECT conv_id AS session_id, arg_max(status, k) AS status FROM o GROUP BY conv_id HAVING arg_max(status, k) <> 'active'",
    "repair_float": "WITH t AS (SELECT event_id, user_id, (['1.5', ' 2', '-.5', '3e2', 'x', '7', '1d'])[event_id % 7 + 1] AS s FROM events) SELECT event_id, CASE WHEN s IN ('1.5', '-.5', '3e2', '7') THEN s::DOUBLE END AS t, user_id::DOUBLE AS u, (user_id % 2 = 0)::INT::DOUBLE AS b, CASE WHEN s NOT IN ('1.5', '-.5', '3e2', '7') THEN 't: Parse' END AS error FROM t",
    "repair_text": "SELECT event_id, user_id::VARCHAR AS u, CASE user_id % 4 WHEN 0 THEN (user_id // 4)::VARCHAR WHEN 1 THEN (user_id // 4) || '.25' WHEN 2 THEN (user_id // 4) || '.5' ELSE (user_id // 4) || '.75' END AS q, CASE WHEN user_id % 2 = 0 THEN 'true' ELSE 'false' END AS b, NULL::VARCHAR AS error FROM events",
    "repair_timestamp": "SELECT event_id, ts::TIMESTAMP AS t, true AS none, 's: Cast' AS error FROM events",
    "repair_group": "SELECT event_id, user_id::BIGINT AS a, event_id::BIGINT AS l, true AS c, NULL::VARCHAR AS error FROM events",
    "repair_map": "SELECT event_id, CASE WHEN event_id % 5 <> 0 THEN user_id::DOUBLE END AS own, CASE WHEN event_id % 5 <> 0 THEN 2.5::DOUBLE END AS other, CASE WHEN event_id % 5 = 0 THEN 'm: Parse' END AS error FROM events",
    "coerce_bool": "SELECT event_id, user_id % 3 <> 0 AS f, user_id % 2 <> 0 AS i, NULL::VARCHAR AS error, 'f: Cast' AS strict FROM events",
    "data_view": "SELECT event_type, count(*) AS n, round(sum(value), 2) AS total FROM events WHERE value > 10 GROUP BY event_type",
    "data_statements": "SELECT 'describe' AS what, name FROM (SELECT unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) AS name) UNION ALL SELECT 'show', unnest(['event_id', 'ts', 'user_id', 'event_type', 'value', 'props']) UNION ALL SELECT 'explain', 'pushed'",
    "table_length": "SELECT count(*) + 1 AS n, count(*) + 1 AS next FROM events",
    "waiting_rows": "SELECT event_id, row_number() OVER (ORDER BY event_id % 2, event_id) - 1 AS index FROM events UNION ALL SELECT -1, (SELECT count(*) FROM events)",
    "file_index_ranges": "SELECT 0::BIGINT AS low, count(*) - 1 AS high, count(*) AS n, count(*) AS covered FROM events",
    "type_equality": "SELECT event_id, user_id = user_id % 100 AS ints, false AS mixed, value = round(value) AS floats, date_trunc('second', ts) = date_trunc('second', ts + INTERVAL '400 milliseconds') AS times FROM events",
    "url_filter": "SELECT page_id, u AS url FROM (SELECT page_id, (['http://a/x', 'http://a/x/y', 'http://a/xy', 'http://b', 'http://bc/d', 'http://c/', regexp_extract(url, '^([a-z]+://[^/]+)', 1)])[page_id % 7 + 1] AS u FROM pages) WHERE u = 'http://a/x' OR starts_with(u, 'http://a/x/') OR starts_with(u, 'http://b') OR u = 'http://c/' OR starts_with(u, 'http://c//')",
    "adder": "SELECT event_id AS index, event_id + user_id AS sum, (event_id + user_id) % 2 = 0 AS is_even FROM events",
    "list_module": "SELECT conv_id AS index, string_agg(upper(coalesce(role, '')), ',' ORDER BY turn, coalesce(role, '')) AS roles, count(*) AS n FROM conversations GROUP BY conv_id",
    "interconnect": "SELECT n_nationkey::BIGINT AS index, 'Caller received: Hello: ' || n_name AS message, 'caller,hello' AS known FROM nation",
    "interconnect_session": "SELECT (n_nationkey % 4)::BIGINT AS session_id, n_nationkey::BIGINT AS turn, 2 * (row_number() OVER (PARTITION BY n_nationkey % 4 ORDER BY n_nationkey) - 1) || ': Hello: ' || n_name AS output FROM nation",
    "large_scalars": "SELECT event_id, 9007199254740993 AS l, 63050394783186951 AS g, lcm(event_id + 3000000000, 2)::BIGINT AS l2, ((1700000000000000999 + event_id * 1000003) // 1000)::BIGINT AS us, CASE WHEN event_id > 1 THEN 9223372036854775807 ELSE 9223372036854775806 + event_id END AS b FROM events",
    "time_forms": "SELECT event_id, CASE event_id % 6 WHEN 0 THEN 1709288430123456 WHEN 1 THEN 1709288430500000 WHEN 2 THEN 1709281230250000 WHEN 4 THEN 1709287200000000 END AS us FROM events",
    "list_functions": "SELECT event_id, '<' || upper(event_type) || '>,<B>' AS t, user_id || ',' || event_id AS i, '-1' AS f, 0::BIGINT AS none, user_id || ',-' AS s, user_id::DOUBLE AS d FROM events",
    "text_functions": "SELECT event_id, (['12', NULL, '18446744073709551615', NULL, '7', NULL])[event_id % 6 + 1] AS u, 'Embedding of ' || event_type || ' has 2' AS e, ((100 // (length(event_type) + 1)) * (length(event_type) + 1) - 1 + CASE WHEN 100 % (length(event_type) + 1) = length(event_type) THEN length(event_type) + 1 ELSE 0 END)::BIGINT AS p, strftime(make_timestamp(event_id * 1000000), '%Y-%m-%dT%H:%M:%S.000000+00:00') AS t FROM events",
    "put_column": "SELECT n_nationkey, lower(n_name) AS n_name, 2 * n_nationkey::BIGINT AS more, n_nationkey % 2 <> 0 AS gone, true AS never FROM nation",
    "session_status": _SESSIONS + "SELECT conv_id AS session_id, arg_max(status, k) AS status, sum(CASE WHEN status = 'failed' THEN 1 ELSE 2 END)::BIGINT AS length FROM o GROUP BY conv_id",
    "session_explode": _SESSIONS + ", c AS (SELECT conv_id FROM o GROUP BY conv_id HAVING arg_max(status, k) <> 'active') SELECT conv_id AS session_id, (2 * (k - 1))::BIGINT AS pos, md5(text) AS value FROM o JOIN c USING (conv_id) UNION ALL SELECT conv_id, 2 * (k - 1) + 1, md5(CASE WHEN length(text) % 11 = 0 THEN '-' ELSE 'turn ' || k END) FROM o JOIN c USING (conv_id) WHERE status <> 'failed'",
}


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in QUERIES}


def oracle_sql() -> dict[str, str]:
    return ORACLE
