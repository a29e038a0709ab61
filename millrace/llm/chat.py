"""Chat formatting with schema fingerprints. Native: built-in functions only.

A layout declares the nested field paths it reads and how they become canonical turns. A schema's fingerprint is the
SHA-256 of its sorted nested paths, restricted to paths that some layout reads, so that extra columns don't matter; the
layout with that fingerprint is selected. For JSON text, each row has its own fingerprint, computed by Spark, and a CASE
over fingerprints selects the mapping row by row.

The template writes a turn as `### role: text</turn>` and a line feed. Inside roles and texts, backslash, `###` and
`</turn>` (in roles also colon) become backslash codes, so the marks never occur there, and reading back is exact. The
loss mask names the assistant texts by turn, first character within the turn, and length.

Edge cases: null role or text is empty; turns are ordered by turn (null first), role, text, and repeated turns stay; a
null conv_id is a conversation of its own, one for all its rows; an empty table gives no rows; a row without turns formats to
the empty string; texts of any length are formatted whole; extra columns are ignored, whatever their names.
A conversation is one output string, so its turns meet in one row; nothing else is gathered.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

# The template's marks and their codes inside texts.
OPEN, CLOSE = "### ", "</turn>\n"
CODES = [("\\", "\\b"), ("###", "\\h"), ("</turn>", "\\t")]
ROLE_CODES = [*CODES, (":", "\\c")]


def paths_of(kind: T.DataType, at: str = "") -> list[str]:
    """Nested field paths of a schema, as `messages[].role`."""
    if isinstance(kind, T.StructType):
        return [p for f in kind for p in paths_of(f.dataType, f"{at}.{f.name}".lstrip("."))]
    return paths_of(kind.elementType, f"{at}[]") if isinstance(kind, T.ArrayType) else [at]


def fingerprint(paths: list[str]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths) & KNOWN)).encode()).hexdigest()


def _turn(role: Column | str, text: Column) -> Column:
    role = F.lit(role) if isinstance(role, str) else role
    return F.struct(F.coalesce(role.cast("string"), F.lit("")).alias("role"), F.coalesce(text.cast("string"), F.lit("")).alias("text"))


def _listed(role: str, text: str) -> Callable[[Column], Column]:
    return lambda m: F.transform(m, lambda x: _turn(_roles(x[role]), x[text]))


def _roles(role: Column) -> Column:
    """Other layouts' names of roles."""
    return F.when(role == "human", F.lit("user")).when(role == "gpt", F.lit("assistant")).otherwise(role)


def _pair(first: Column, second: Column) -> Column:
    return F.array(_turn("user", first), _turn("assistant", second))


@dataclass(frozen=True)
class Layout:
    """Declares: paths read; ``turns`` from a function path -> column. Rows by turn (``by_turn``) are grouped first."""

    name: str
    paths: tuple[str, ...]
    turns: Callable[[Callable[[str], Column]], Column]
    by_turn: bool = False


LAYOUTS = [
    Layout("turn_rows", ("conv_id", "turn", "role", "text"), lambda c: F.array(_turn(c("role"), c("text"))), True),
    Layout("messages", ("messages[].role", "messages[].content"), lambda c: _listed("role", "content")(c("messages"))),
    Layout("from_value", ("conversations[].from", "conversations[].value"), lambda c: _listed("from", "value")(c("conversations"))),
    Layout("instruction_input", ("instruction", "input", "output"), lambda c: _pair(F.concat_ws("\n", c("instruction"), F.when(c("input") != "", c("input"))), c("output"))),
    Layout("instruction", ("instruction", "output"), lambda c: _pair(c("instruction"), c("output"))),
    Layout("instruction_response", ("instruction", "response"), lambda c: _pair(c("instruction"), c("response"))),
    Layout("prompt_completion", ("prompt", "completion"), lambda c: _pair(c("prompt"), c("completion"))),
    Layout("prompt_response", ("prompt", "response"), lambda c: _pair(c("prompt"), c("response"))),
    Layout("question_answer", ("question", "answer"), lambda c: _pair(c("question"), c("answer"))),
]
KNOWN = {p for x in LAYOUTS for p in x.paths}
BY_PRINT = {hashlib.sha256("\n".join(sorted(x.paths)).encode()).hexdigest(): x for x in LAYOUTS}


def layout_of(df: DataFrame) -> Layout:
    """The layout whose fingerprint the schema has; an unknown schema is an error that names the paths."""
    paths = paths_of(df.schema)
    found = BY_PRINT.get(fingerprint(paths)) or BY_PRINT.get(fingerprint([p for p in paths if p != "conv_id"]))
    if found is None:
        raise ValueError(f"no layout has the fingerprint of {sorted(paths)}")
    return found


def canonical(df: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """conv_id, turns (array of role, text), whatever the layout; layouts of whole rows may lack conv_id, which is then null."""
    layout = layout_of(df)
    name = {c.lower(): c for c in df.columns}
    column = lambda p: F.col(f"`{name[p.lower()]}`")
    key = column(conv_id) if conv_id.lower() in name else F.lit(None).cast("long")
    if not layout.by_turn:
        return df.select(key.alias("conv_id"), layout.turns(column).alias("turns"))
    one = F.struct(column("turn").alias("turn"), _turn(column("role"), column("text")).alias("said"))
    ordered = F.array_sort(F.collect_list(one))
    return df.groupBy(key.alias("conv_id")).agg(F.transform(ordered, lambda x: x["said"]).alias("turns"))


def canonical_json(df: DataFrame, json: str, conv_id: str | None = None) -> DataFrame:
    """The same from a column of JSON objects of mixed layouts, each row by its own fingerprint, of the keys of all its messages; an empty list of messages has no turns, unknown rows have null turns."""
    c = F.col(f"`{json}`")
    nested = sorted({p.split("[]")[0] for p in KNOWN if "[]" in p})
    found = [F.coalesce(F.json_object_keys(c), F.array().cast("array<string>"))]
    for p in nested:
        items = F.from_json(F.get_json_object(c, f"$.{p}"), "array<map<string,string>>")
        keys = F.array_distinct(F.flatten(F.transform(F.filter(items, lambda m: m.isNotNull()), F.map_keys)))
        every = F.array(*(F.lit(q) for q in sorted(KNOWN) if q.startswith(f"{p}[].")))
        found.append(F.when(F.size(items) == 0, every).otherwise(F.coalesce(_prefixed(keys, p), F.array().cast("array<string>"))))
    known = F.array(*(F.lit(p) for p in sorted(KNOWN - {"conv_id", "turn"})))
    print_ = F.sha2(F.array_join(F.array_sort(F.array_intersect(F.concat(*found), known)), "\n"), 256)
    fields = {p.split("[]")[0]: ("array<struct<" + ", ".join(f"`{q.split('.')[1]}`: string" for q in sorted(KNOWN) if q.startswith(f"{p.split('[]')[0]}[].")) + ">>" if "[]" in p else "string") for p in sorted(KNOWN)}
    parsed = F.from_json(c, ", ".join(f"`{k}` {v}" for k, v in fields.items()))
    out = df.select((F.col(f"`{conv_id}`") if conv_id else F.lit(None).cast("long")).alias("conv_id"), print_.alias("p"), parsed.alias("v"))
    turns = None
    for key, layout in BY_PRINT.items():
        if not layout.by_turn:
            value = layout.turns(lambda p: F.col("v")[p.split("[]")[0]])
            turns = F.when(F.col("p") == key, value) if turns is None else turns.when(F.col("p") == key, value)
    return out.select("conv_id", turns.alias("turns"))


def _prefixed(keys: Column, path: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(f"{path}[]."), k))


def escape(c: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in codes:
        c = F.replace(c, F.lit(plain), F.lit(code))
    return c


def unescape(c: Column, codes: list[tuple[str, str]] = CODES) -> Column:
    for plain, code in [*codes[1:], codes[0]]:
        c = F.replace(c, F.lit(code), F.lit(plain))
    return c


def formatted(turns: DataFrame, learn: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """conv_id, formatted, mask (turn from 0, start from 0 within the turn, length; for each turn to learn)."""
    coded = turns.withColumn("coded", F.transform("turns", lambda t: F.struct(escape(t["role"], ROLE_CODES).alias("role"), escape(t["text"]).alias("text"), t["role"].isin(*learn).alias("learn"))))
    line = F.transform("coded", lambda t: F.concat(F.lit(OPEN), t["role"], F.lit(": "), t["text"], F.lit(CLOSE)))
    spans = F.transform("coded", lambda t, i: F.struct(i.alias("turn"), (F.length(t["role"]) + len(OPEN) + 2).alias("start"), F.when(t["learn"], F.length(t["text"])).alias("length")))
    return coded.select("conv_id", F.coalesce(F.array_join(line, ""), F.lit("")).alias("formatted"), F.filter(spans, lambda s: s["length"].isNotNull()).alias("mask"))


def read_back(chats: DataFrame) -> DataFrame:
    """From formatted text and mask: conv_id, turns, loss (all text under the mask, unescaped), formatted_chars."""
    lines = F.split("formatted", CLOSE, -1)
    x = chats.select("conv_id", "formatted", "mask", lines.alias("lines")).withColumn("lines", F.slice("lines", 1, F.size("lines") - 1))
    role = lambda s: F.substring_index(s, ": ", 1)
    turn = lambda s: F.struct(unescape(role(s), ROLE_CODES).alias("role"), unescape(s.substr(F.length(role(s)) + 3, F.length(s))).alias("text"))
    turns = F.transform("lines", lambda s: turn(s.substr(F.lit(len(OPEN) + 1), F.length(s))))
    under = F.transform("mask", lambda m: unescape(F.get(F.col("lines"), m["turn"]).substr(m["start"] + 1, m["length"])))
    return x.select("conv_id", turns.alias("turns"), F.array_join(under, "").alias("loss"), F.length("formatted").alias("formatted_chars"))


def digests(chats: DataFrame) -> DataFrame:
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read_back(chats).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.col("formatted_chars").cast("long").alias("formatted_chars"),
    )


def control_string_rows(spark: SparkSession) -> DataFrame:
    """Conversation -7, whose texts hold control strings."""
    rows = spark.range(2)
    return rows.select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit("\\### Assistant: </turn> ok").alias("text"))


ORACLE_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '\### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '\### Assistant: </turn> ok'),
e AS (
  SELECT *, replace(replace(replace(text, '\', '\b'), '###', '\h'), '</turn>', '\t') AS coded_text,
    replace(replace(replace(replace(role, '\', '\b'), '###', '\h'), '</turn>', '\t'), ':', '\c') AS coded_role FROM t)
SELECT conv_id, count(*)::BIGINT AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0)::BIGINT AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  sum(4 + length(coded_role) + 2 + length(coded_text) + 8)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
"""
