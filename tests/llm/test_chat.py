import json

from pestle.llm.chat import format_chat

CALL = lambda *calls: json.dumps({"tool_calls": [{"id": i, "name": n, "arguments": a} for i, n, a in calls], "content": "x"})
RESULT = lambda i, c="ok": json.dumps({"content": c, "tool_call_id": i})

ROWS = [
    (1, 0, "user", "hi \"there\"\n"), (1, 1, "assistant", CALL(("a", "add", {"x": 1, "y": 2}), ("b", "add", {"x": "1", "z": 3}))),
    (1, 2, "tool", RESULT("b")), (1, 3, "tool", RESULT("a")), (1, 4, "tool", RESULT("a", "again")), (1, 5, "tool", RESULT("zz")), (1, 6, "assistant", "done"),
    (2, 0, "tool", RESULT("q")), (2, 1, "assistant", CALL(("q", "nope", {}))), (2, 2, "assistant", CALL(("w", "add", "not json"))), (2, 3, "user", None),
    (3, 0, "tool", RESULT("a")), (None, 0, "user", "no conversation"), (3, 1, "assistant", "{broken"), (3, 1, "assistant", "{broken"), (3, None, None, "nothing"), (3, 2, "user", '{"tool_calls": []}'),
]
SCHEMAS = [("add", "x", "integer", True), ("add", "y", "number", True)]


def frames(spark):
    return spark.createDataFrame([(*r, "extra") for r in ROWS], "conv_id long, turn long, role string, text string, row string"), spark.createDataFrame(SCHEMAS, "tool string, param string, type string, required boolean")


def test_linking_order_and_errors(spark):
    df, schemas = frames(spark)
    got = {}
    for r in format_chat(df, schemas).collect():
        got.setdefault((r.conv_id, r.turn), []).append(r)
    assert sum(map(len, got.values())) == len(ROWS)
    one = lambda c, t: got[c, t][0]
    assert [one(1, t).link for t in range(7)] == [None, "answered", "linked", "linked", "repeated", "orphan", None]
    assert [one(1, t).position for t in range(7)] == list(range(7))
    assert one(1, 1).errors == ["x: not of type integer", "y: missing", "z: not in the schema"] and one(1, 1).n_calls == 2
    # the result that comes first moves behind its call
    assert one(2, 1).position == 0 and one(2, 0).position == 1 and one(2, 0).link == "linked" and one(2, 0).call_turn == 1
    assert one(2, 1).errors == ["tool: unknown nope"] and one(2, 2).errors == ["arguments: not an object"] and one(2, 2).link == "open"
    assert one(3, 0).link == "orphan"  # identifiers belong to their conversation
    assert sorted(r.position for rows in got.values() for r in rows if r.conv_id == 3) == list(range(5))
    assert one(None, 0).position == 0


def test_canonical_json(spark):
    df, _ = frames(spark)
    for r in format_chat(df).collect():
        value = json.loads(r.json)
        assert value["role"] == r.role
        if r.n_calls or r.call_id:
            assert set(value) == {"message", "role"}
            assert r.json == json.dumps(value, sort_keys=True, separators=(",", ":"), ensure_ascii=False)
        else:
            assert set(value) == {"content", "role"}
    assert format_chat(df.limit(0)).count() == 0


def test_one_large_conversation(spark):
    df = spark.createDataFrame([(7, i // 2, "user" if i % 2 else "assistant", f"m{i}") for i in range(3000)] + [(8, 0, "user", "x")], "conv_id long, turn long, role string, text string")
    got = sorted((r.position, r.turn, r.role) for r in format_chat(df).filter("conv_id = 7").collect())
    assert [g[0] for g in got] == list(range(3000)) and [g[1:] for g in got] == sorted((i // 2, "user" if i % 2 else "assistant") for i in range(3000))


def test_canonical_numbers_keys_and_long_texts(spark):
    content = {"～": 1, "\U0001f600": 2, "a": "é/\"\\"}
    text = json.dumps({"tool_call_id": "q", "content": content}, ensure_ascii=False).replace('"a"', '"n": [1, 1.0, 1.50, 1e0], "a"')
    df = spark.createDataFrame([(1, 0, "tool", text), (1, 1, "user", "x" * 3_000_000)], "conv_id long, turn long, role string, text string")
    got = [r.json for r in format_chat(df).sort("turn").collect()]
    keys = sorted(["a", "n", "～", "\U0001f600"], key=lambda k: k.encode("utf-16-be"))
    own = {"a": '"é/\\"\\\\"', "n": "[1,1,1.5,1.0]", "～": "1", "\U0001f600": "2"}
    assert got[0] == '{"message":{"content":{' + ",".join(f'"{k}":{own[k]}' for k in keys) + '},"tool_call_id":"q"},"role":"tool"}'
    assert got[1] == '{"content":"' + "x" * 3_000_000 + '","role":"user"}'


def test_query_links_validates_and_moves(spark):
    from pestle.llm.queries import op1_chat_format

    rows = op1_chat_format(spark, "/root/testdata/sf0.001").collect()
    assert {r.link for r in rows} == {None, "answered", "open", "linked", "repeated", "orphan"}
    assert any(r.n_errors == 0 and r.n_calls for r in rows) and len({e for r in rows for e in r.errors}) >= 8
    assert any(r.link == "linked" and r.call_turn > r.turn for r in rows)
