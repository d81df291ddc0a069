import json

from loomline.llm import tool_calls

SCHEMAS = {"add": {"x": ("integer", True), "y": ("number", True), "note": ("string", False)}, "list": {"items": ("array", True), "deep": ("object", False), "on": ("boolean", False)}}


def call(i, name="add", arguments=None, needs=()):
    return {"id": i, "name": name, "arguments": arguments if arguments is not None else {"x": 1, "y": 2.5}, "depends_on": list(needs)}


def linked(spark, messages):
    frame = spark.createDataFrame(messages, "conv_id long, turn long, role string, text string")
    return {(r.conversation, r.call_id): r for r in tool_calls.link_tool_calls(*tool_calls.parse_messages(frame), SCHEMAS).collect()}


def test_links_levels_and_repeats(spark):
    say = lambda *calls: json.dumps({"tool_calls": list(calls)})
    give = lambda i, content="ok": json.dumps({"tool_call_id": i, "content": content})
    out = linked(spark, [
        (1, 0, "user", "plain"), (1, 1, "assistant", say(call("a"), call("b", needs=["a"]), call("c", needs=["a", "b"]))),
        (1, 2, "tool", give("c")), (1, 2, "tool", give("a", "first")), (1, 3, "tool", give("a", "second")), (1, 4, "assistant", say(call("a", arguments={"x": 9}))),
        (1, 5, "tool", give("lost")), (1, 6, "assistant", say(call("d", needs=["e"]), call("e", needs=["d"]), call("f", needs=["f"]), call("g", needs=["nowhere"]), call("h", needs=["c"]))),
        (2, 0, "tool", give("a")), (2, 1, "assistant", say(call("a"))), (2, 2, "assistant", None), (2, 3, "assistant", "{broken"), (None, 0, "assistant", say(call("a"))),
    ])
    assert {k[1]: v.level for k, v in out.items() if k[0] == "1"} == {"a": 0, "b": 1, "c": 2, "h": 3, "d": None, "e": None, "f": None, "g": None, "lost": None}
    a = out["1", "a"]
    assert (a.status, a.n_calls, a.n_results, a.call_turn, a.result_turn) == ("linked", 2, 2, 1, 2)
    assert json.loads(a.json) == {"arguments": {"x": 1, "y": 2.5}, "content": "first", "depends_on": [], "id": "a", "level": 0, "name": "add", "status": "linked"}
    assert out["1", "lost"].status == "no-call" and not out["1", "lost"].valid
    assert out["1", "b"].status == "no-result" and out["2", "a"].status == "early-result"


def test_arguments_against_schemas(spark):
    bad = {
        "m": ({}, "missing:x,missing:y"), "t": ({"x": "1", "y": True}, "type:x,type:y"), "u": ({"x": 1, "y": 1, "z": 0, "b": 0}, "unknown:b,unknown:z"), "n": ({"x": None, "y": 1}, "missing:x"),
        "f": ({"x": 1.5, "y": 1}, "type:x"), "ok": ({"x": 1, "y": 1, "note": "n"}, ""), "arr": ([1], "malformed"),
    }
    calls = [call(k, arguments=a) for k, (a, _) in bad.items()] + [call("l", "list", {"items": [], "deep": {}, "on": True}), call("l2", "list", {"items": {}, "on": 1}), call("v", "void", {})]
    out = linked(spark, [(1, 0, "assistant", json.dumps({"tool_calls": calls}))])
    assert {k: out["1", k].errors for k in bad} == {k: e for k, (_, e) in bad.items()}
    assert out["1", "l"].valid and out["1", "l2"].errors == "type:items,type:on" and out["1", "v"].errors == "unknown-tool"


def test_json_is_canonical(spark):
    text = '{"tool_calls":[{"id":"q","name":"list","arguments":{"z":{"b":1,"a":[{"d":1,"c":"\\u00e9\\n"}]},"items":[2,1]}}]}'
    got = linked(spark, [(1, 0, "assistant", text)])["1", "q"].json
    assert got == json.dumps(json.loads(got), sort_keys=True, separators=(",", ":"), ensure_ascii=False)
    assert '"arguments":{"items":[2,1],"z":{"a":[{"c":"é\\n","d":1}],"b":1}}' in got


def test_dialogue_with_gaps(spark):
    rows = [(1, 0, "system", "s", "x"), (1, 1, "user", None, "x"), (1, 2, "assistant", "r", "x"), (1, 2, "assistant", "r", "x"), (None, 0, "user", "u", "x"), (2, None, "user", "u", "x"), (3, 5, "assistant", "r", "x"), (3, 1, None, None, "x")]
    frame = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string, call_id string")
    out = {(r.conversation, r.call_id): r for r in tool_calls.link_tool_calls(*tool_calls.dialogue_calls(frame), SCHEMAS | {"reply": {"text": ("string", True)}, "context": {}}).collect()}
    assert out["1", "1-1"].n_results == 2 and out["1", "1-1"].level == 1 and "missing:text" in out["1", "1-1"].errors
    assert out["none", "none-0"].level == 0 and ("2", "2-none") in out and out["3", "3-4"].status == "no-call"
    empty = spark.createDataFrame([], "conv_id long, turn long, role string, text string")
    assert tool_calls.link_tool_calls(*tool_calls.dialogue_calls(empty), SCHEMAS).count() == 0
    assert tool_calls.link_tool_calls(*tool_calls.parse_messages(empty), SCHEMAS).count() == 0


def test_the_link_is_a_hash_join(spark, small):
    calls, results = tool_calls.dialogue_calls(spark.read.parquet(f"{small}/conversations.parquet"))
    out = tool_calls.link_tool_calls(calls, results, SCHEMAS)
    out.collect()
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "ShuffledHashJoin [conversation" in plan and "SortMergeJoin" not in plan and "Python" not in plan and "Pandas" not in plan


def test_levels_of_large_conversations(spark):
    """A chain of 10 and a fan of 50 calls, in one row and by rounds; a circle and a missing call have no level."""
    chain = [("1", f"c{k}", [f"c{k - 1}"] if k else []) for k in range(10)]
    fan = [("2", "root", [])] + [("2", f"f{k}", ["root"]) for k in range(50)] + [("2", "end", [f"f{k}" for k in range(50)])]
    bad = [("3", "x", ["y"]), ("3", "y", ["x"]), ("3", "z", ["nowhere", "w"]), ("3", "w", []), ("3", "v", ["w", "w"])]
    calls = spark.createDataFrame(chain + fan + bad, "conversation string, call_id string, depends_on array<string>")
    want = {(c, i): k for k, (c, i, _) in enumerate(chain)} | {(c, i): (0 if i == "root" else 2 if i == "end" else 1) for c, i, _ in fan} | {("3", "w"): 0, ("3", "v"): 1}
    for together in (0, 8, 32, 100):
        got = {(r.conversation, r.call_id): r.level for r in tool_calls.call_levels(calls, together).collect() if r.level is not None}
        assert got == want
