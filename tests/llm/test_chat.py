"""JSON rows whose messages don't all have the same keys."""

import json

from millrace.llm import chat


def test_json_keys_of_all_messages(spark):
    rows = [
        (1, {"messages": [{"role": "user"}, {"role": "assistant", "content": "b"}]}, [("user", ""), ("assistant", "b")]),
        (2, {"conversations": [{"value": "a"}, None, {"from": "gpt", "value": "b", "x": {"y": 1}}]}, [("", "a"), ("", ""), ("assistant", "b")]),
        (3, {"messages": []}, []),
        (4, {"conversations": [], "id": 7}, []),
        (5, {"messages": [{"role": "user", "content": "a"}]}, [("user", "a")]),
        (6, {"messages": [{"role": "user"}]}, None),
        (7, {"other": []}, None),
        (8, {"messages": None}, None),
    ]
    df = spark.createDataFrame([(k, json.dumps(v)) for k, v, _ in rows], "id long, j string")
    got = {r["conv_id"]: r["turns"] and [tuple(t) for t in r["turns"]] for r in chat.canonical_json(df, "j", "id").collect()}
    assert got == {k: want for k, _, want in rows}
