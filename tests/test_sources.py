"""Readers against small transcripts of every format."""
import json

from pyspark.sql import functions as F

from loomtrace.plans.tables import materialize
from loomtrace.sources import antigravity, canonical, codex, cursor, files, gemini, history, opencode, pi


def jl(path, rows):
    path.parent.mkdir(parents=True, exist_ok=True)
    path.write_text("".join((r if isinstance(r, str) else json.dumps(r)) + "\n" for r in rows))
    return str(path)


def events(df, *cols):
    return [tuple(r) for r in df.orderBy("file_path", "ordinal", "sub").select(*cols).collect()]


def test_canonical_jsonl_keeps_order_flags_bad_lines_and_identity(spark, tmp_path):
    p = jl(tmp_path / "s" / "a.jsonl", [
        {"type": "user", "sessionId": "s1", "timestamp": "2026-01-02T03:04:05Z", "message": {"content": "[hi] there"}},
        "", "not json", "[1]",
        {"type": "assistant", "sessionId": "s1", "timestamp": "bad", "isSidechain": "x",
         "message": {"model": "m", "usage": {"input_tokens": "7", "output_tokens": 2.0, "cache_read_input_tokens": None},
                     "content": [{"type": "tool_use", "id": "t1", "name": "Bash", "input": {"command": ["a", "b"]}}, "str",
                                 {"type": "tool_result", "tool_use_id": "t1", "is_error": True}]}}])
    sub = jl(tmp_path / "s" / "subagents" / "b.jsonl", [{"type": "user", "sessionId": "s1", "message": {"content": "x"}}])
    df = canonical.read_jsonl(spark, [p, sub])
    got = events(df, "type", "bad", "is_sidechain", "text", F.col("ts").cast("string"))
    assert got == [("user", False, False, "[hi] there", "2026-01-02 03:04:05"), (None, True, False, None, None),
                   (None, True, False, None, None), ("assistant", False, None, None, None), ("user", False, True, "x", None)]
    a = df.filter("type='assistant'").first()
    assert (a.usage.input, a.usage.output, a.usage.cache_read) == (7, 2, 0)
    assert json.loads(a.content[0].input) == {"command": ["a", "b"]} and a.content[2].is_error is True


def test_line_ordinals_follow_the_file_when_it_is_split(spark, tmp_path):
    p = jl(tmp_path / "big.jsonl", [{"i": i, "pad": "x" * 50} for i in range(4000)])
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "16384")
    try:
        df = files.lines(spark, p)
        assert df.rdd.getNumPartitions() > 4
        got = [r[0] for r in df.orderBy("ordinal").select(F.get_json_object("value", "$.i").cast("int")).collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    assert got == list(range(4000))


def test_window_admits_undated_only_when_open(spark):
    df = spark.createDataFrame([("2026-01-01 00:00:00",), ("2026-02-01 00:00:00",), (None,)], "ts string").withColumn("ts", F.col("ts").cast("timestamp"))
    assert canonical.in_window(df).count() == 3
    assert canonical.in_window(df, "2026-01-01", "2026-02-01").count() == 1


def rollout(tmp_path, name, rows):
    return jl(tmp_path / name, rows)


def tok(ts, i, c, o, r):
    return {"type": "event_msg", "timestamp": ts, "payload": {"type": "token_count", "info": {"total_token_usage": {
        "input_tokens": i, "cached_input_tokens": c, "output_tokens": o, "reasoning_output_tokens": r, "total_tokens": i + o}}}}


def test_rollout_usage_deltas_by_model_and_month(spark, tmp_path):
    p = rollout(tmp_path, "r.jsonl", [
        {"type": "session_meta", "timestamp": "2026-01-30T00:00:00Z", "payload": {"id": "c1", "cwd": "/w"}},
        {"type": "turn_context", "payload": {"model": "A"}},
        {"type": "response_item", "timestamp": "2026-01-30T00:00:01Z", "payload": {"type": "message", "role": "user", "content": [{"type": "input_text", "text": "do it"}]}},
        {"type": "response_item", "timestamp": "2026-01-30T00:00:02Z", "payload": {"type": "message", "role": "user", "content": "<environment_context>x"}},
        tok("2026-01-30T00:00:03Z", 100, 40, 10, 5), tok("2026-01-30T00:00:04Z", 150, 60, 20, 5),
        {"type": "turn_context", "payload": {"model": "B"}},
        tok("2026-01-31T00:00:00Z", 200, 60, 30, 5), tok("2026-02-01T00:00:00Z", 260, 80, 40, 5)])
    df = materialize(codex.read(spark, p, work=str(tmp_path / "w")), str(tmp_path / "out"))
    u = {(r.model, r.ts.strftime("%Y-%m")): (r.usage.input, r.usage.cache_read, r.usage.output) for r in df.filter("is_usage_only").collect()}
    assert u == {("A", "2026-01"): (90, 60, 25), ("B", "2026-01"): (50, 0, 10), ("B", "2026-02"): (40, 20, 10)}
    assert events(df.filter("type='user'"), "text", "session_id", "cwd", "is_sidechain") == [("do it", "c1", "/w", False)]


def test_rollout_tools_results_and_child_links(spark, tmp_path):
    patch = "*** Begin Patch\n*** Update File: a.py\n-x\n+y\n*** Add File: b.py\n+z\n*** End Patch"
    p = rollout(tmp_path, "child.jsonl", [
        {"type": "session_meta", "timestamp": "2026-01-01T00:00:00Z", "payload": {"id": "k", "source": {"subagent": {"thread_spawn": {"parent_thread_id": "par", "agent_path": "ag"}}}}},
        {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "go"}},
        {"type": "turn_context", "timestamp": "2026-01-01T00:00:01Z", "payload": {"model": "gpt-5-mini", "turn_id": "t1"}},
        {"type": "response_item", "payload": {"type": "custom_tool_call", "name": "apply_patch", "input": patch, "call_id": "c0"}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "shell", "arguments": json.dumps({"command": ["ls", "pytest"]}), "call_id": "c1"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c1", "output": json.dumps({"success": False})}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "get_x", "namespace": "mcp__db_bot__", "arguments": "{}", "call_id": "c2"}},
        {"type": "response_item", "payload": {"type": "function_call", "name": "spawn_agent", "arguments": json.dumps({"task_name": "q"}), "call_id": "c3"}},
        {"type": "response_item", "payload": {"type": "function_call_output", "call_id": "c3", "output": {"agent_id": "z9", "submission_id": "s7"}}},
        {"type": "event_msg", "payload": {"type": "task_complete", "turn_id": "t1"}}])
    df = materialize(codex.read(spark, p, work=str(tmp_path / "w")), str(tmp_path / "out"))
    calls = [(r.b.name, json.loads(r.b.input)) for r in df.select("ordinal", "sub", F.explode("content").alias("b")).filter("b.type='tool_use'").orderBy("ordinal", "sub").collect()]
    assert [c[0] for c in calls] == ["Edit", "Edit", "Bash", "mcp__db_bot__get_x", "Agent"]
    assert calls[0][1] == {"file_path": "a.py", "new_string": "y\n", "old_string": "x\n"} and calls[2][1] == {"command": "ls && pytest"}
    assert calls[4][1]["_routing_identity"] == "z9" and calls[4][1]["_routing_turn_id"] == "s7"
    link = df.filter("type='routing_link'").collect()
    assert len(link) == 1
    r = link[0].routing
    assert (r.parent_session, r.child_session, r.turn_id, r.delegation_identity, r.child_model) == ("par", "k", "t1", "ag", "gpt-5-mini")
    assert (r.completed, r.aborted, r.lifecycle_known, r.substantive_calls, r.writes) == (True, False, True, 5, 2)
    errs = df.select(F.explode("content").alias("b")).filter("b.type='tool_result'").select("b.tool_use_id", "b.is_error").collect()
    assert {tuple(e) for e in errs} == {("c1", True), ("c3", None)}
    assert df.filter("not is_sidechain").count() == 0


def test_rollout_without_prompt_is_skipped(spark, tmp_path):
    p = rollout(tmp_path, "seed.jsonl", [{"type": "session_meta", "payload": {"id": "e"}},
                                         {"type": "response_item", "payload": {"type": "message", "role": "user", "content": "whats 2+2?"}}])
    assert codex.read(spark, p, work=str(tmp_path / "w")).count() == 0


def test_document_transcript(spark, tmp_path):
    doc = {"sessionId": "g1", "messages": [
        {"type": "user", "timestamp": "2026-03-01T10:00:00Z", "content": "hello"},
        {"type": "gemini", "timestamp": "2026-03-01T10:00:05Z", "model": "gemini-2.5-pro", "content": "ok",
         "thoughts": [{"subject": "S", "description": "d"}], "tokens": {"input": 5, "output": 2, "thoughts": 3, "cached": 1},
         "toolCalls": [{"name": "run_shell_command", "args": {"command": "ls", "dir_path": "/repo"}, "status": "error"},
                       {"name": "write_file", "args": {"file_path": "/repo/x.py", "content": "a\nb"}, "result": [{"functionResponse": {"response": {"output": "fine"}}}]}]}]}
    p = tmp_path / "g.json"
    p.write_text(json.dumps(doc))
    df = gemini.read(spark, str(p))
    assert events(df, "type", "cwd", F.size("content")) == [("user", "/repo", None), ("assistant", "/repo", 4), ("user", "/repo", 2)]
    a = df.filter("type='assistant'").first()
    assert [b.type for b in a.content] == ["thinking", "text", "tool_use", "tool_use"] and a.content[0].thinking == "S: d"
    assert a.content[2].name == "Bash" and a.content[3].name == "Write" and (a.usage.input, a.usage.output, a.usage.cache_read) == (5, 5, 1)
    res = df.orderBy("ordinal", "sub").collect()[2]
    assert [b.is_error for b in res.content] == [True, False]


def test_header_row_transcript(spark, tmp_path):
    p = jl(tmp_path / "pi.jsonl", [
        {"type": "session", "id": "p1", "cwd": "/p"},
        {"type": "message", "message": {"role": "user", "timestamp": 1767225600000, "content": [{"type": "text", "text": "hey"}]}},
        {"type": "message", "timestamp": "2026-01-01T00:00:01Z", "message": {"role": "assistant", "model": "m1", "content": [
            {"type": "thinking", "thinking": "t"}, {"type": "toolCall", "name": "bash", "arguments": {"cmd": "ls"}}]}},
        {"type": "message", "message": {"role": "toolResult", "isError": True}}])
    q = jl(tmp_path / "broken.jsonl", [{"type": "session", "id": "p2"}, "oops"])
    df = pi.read(spark, [p, q])
    assert events(df, "type", "session_id", "cwd") == [("user", "p1", "/p"), ("assistant", "p1", "/p"), ("user", "p1", "/p")]
    assert df.filter("type='user' and text is not null").first().ts.isoformat() == "2026-01-01T00:00:00"
    tool = df.filter("type='assistant'").first().content[1]
    assert tool.name == "Bash" and json.loads(tool.input)["command"] == "ls"


def test_three_level_store(spark, tmp_path):
    s = tmp_path / "storage"
    def put(rel, obj):
        f = s / rel
        f.parent.mkdir(parents=True, exist_ok=True)
        f.write_text(json.dumps(obj))
    put("session/p/o1.json", {"id": "o1", "directory": "/d", "parentID": "x"})
    put("message/o1/m1.json", {"id": "m1", "role": "user", "time": {"created": 1000}})
    put("message/o1/m2.json", {"id": "m2", "role": "assistant", "modelID": "mm", "time": {"created": 2000}})
    put("part/m1/a.json", {"id": "a", "type": "text", "text": "hi"})
    put("part/m2/b.json", {"id": "b", "type": "tool", "tool": "edit", "time": {"start": 2}, "state": {"status": "error", "input": {"filePath": "f.py", "oldString": "a", "newString": "b"}}})
    put("part/m2/c.json", {"id": "c", "type": "reasoning", "text": "r", "time": {"start": 1}})
    df = opencode.read_json(spark, str(tmp_path))
    rows = df.orderBy("ordinal", "sub").collect()
    assert [(r.type, r.is_sidechain) for r in rows] == [("user", True), ("assistant", True), ("user", True)]
    assert [b.type for b in rows[1].content] == ["thinking", "tool_use"]
    assert json.loads(rows[1].content[1].input)["new_string"] == "b" and rows[2].content[0].is_error is True


def test_editor_copies_complement_each_other(spark, tmp_path):
    base = tmp_path / "proj" / "agent-transcripts"
    p = jl(base / "c1" / "c1.jsonl", [
        {"role": "user", "message": {"content": [{"type": "text", "text": '<user_query>fix it</user_query><manually_attached_skills><s fullPath="/x/skills/tdd/SKILL.md"></manually_attached_skills>'}]}},
        {"role": "assistant", "message": {"content": [{"type": "tool_use", "name": "StrReplace", "input": {"path": "/Users/u/r/a.py", "old_string": "1", "new_string": "2\n3"}}]}}])
    q = jl(base / "c2" / "c2.jsonl", [
        {"role": "user", "message": {"content": "only here"}},
        {"role": "assistant", "message": {"content": [{"type": "tool_use", "name": "plugin-atl-search", "input": {}}, {"type": "tool_use", "name": "Read", "input": {"path": "/Users/u/r/b.py"}}]}},
        {"type": "turn_ended", "status": "error"}])
    sub = jl(base / "c1" / "subagents" / "k.jsonl", [{"role": "user", "message": {"content": "child"}}])
    jsonl = materialize(cursor.read_jsonl(spark, [p, q, sub]), str(tmp_path / "w1"))
    got = events(jsonl.filter("file_path like '%c2.jsonl'"), "type", "synth_ts", "api_error")
    assert got == [("user", False, False), ("assistant", True, False), ("system", True, True)]
    u = jsonl.filter("file_path like '%c1.jsonl' and type='user'").first()
    assert u.text == "fix it" and u.injected_skills == ["tdd"]
    assert jsonl.filter("file_path like '%k.jsonl'").first().session_id == "c1"
    servers = spark.createDataFrame([("local", "plugin-atl", "atl")], "tenant_id string, server_id string, server_name string")
    named = cursor.resolve_servers(jsonl, servers)
    assert [b.name for b in named.filter("file_path like '%c2.jsonl' and type='assistant'").first().content] == ["mcp__atl__search", "Read"]
    kv = spark.createDataFrame([
        ("local", "composerData:c1", json.dumps({"modelConfig": {"modelName": "mx"}, "fullConversationHeadersOnly": [{"bubbleId": "b1", "type": 1}, {"bubbleId": "b2", "type": 2}]})),
        ("local", "bubbleId:c1:b1", json.dumps({"createdAt": "2026-01-05T00:00:00Z", "text": "fix it"})),
        ("local", "bubbleId:c1:b2", json.dumps({"createdAt": "2026-01-05T00:00:09Z", "toolFormerData": {"name": "search_replace", "params": json.dumps({"relativeWorkspacePath": "a.py"}), "status": "error"}, "tokenCount": {"inputTokens": 4, "outputTokens": 1}}))],
        "tenant_id string, key string, value string")
    both = materialize(cursor.prefer_store(jsonl, materialize(cursor.normalize_kv(kv), str(tmp_path / "w2"))), str(tmp_path / "w3"))
    assert both.filter("session_id='c1' and not is_sidechain and file_path like '%jsonl'").count() == 0
    bot = both.filter("session_id='c1' and type='assistant'").first()
    inp = spark.createDataFrame([(bot.content[0].input,)], "j string").select(F.from_json("j", "new_string string, file_path string").alias("s")).first().s
    assert (bot.model, bot.cwd, inp.new_string, inp.file_path) == ("mx", "/Users/u/r", "2\n3", "a.py")
    assert both.filter("session_id='c2'").first().cwd == "/Users/u/r"


def test_landed_steps_and_export(spark, tmp_path):
    cols = "tenant_id string, conversation string, cwd string, idx long, step_type int, ts timestamp, text string, tool_name string, args_json string, model string, input_tokens long, output_tokens long, cache_tokens long"
    steps = spark.createDataFrame([
        ("t", "v", "/c", 0, 14, None, "do", None, None, None, None, None, None),
        ("t", "v", "/c", 1, 15, None, "said", None, None, "gem", 1, 2, 3),
        ("t", "v", "/c", 2, 15, None, None, "view_file", json.dumps({"AbsolutePath": "/a/skills/qa/SKILL.md"}), None, None, None, None),
        ("t", "v", "/c", 3, 17, None, None, None, None, None, None, None, None),
        ("t", "v", "/c", 4, 15, None, None, "db::run", "{}", None, None, None, None),
        ("t", "v", "/c", 5, 98, None, "meta", None, None, None, None, None, None)], cols)
    df = antigravity.normalize_steps(steps)
    assert events(df, "type", "model", "attribution_skill") == [("user", None, None), ("assistant", "gem", None), ("assistant", "gem", "qa"), ("user", None, None), ("assistant", "gem", None)]
    assert df.filter("ordinal=4").first().content[0].name == "mcp__db__run"
    exp = tmp_path / "e.json"
    t = "CORTEX_STEP_TYPE_"
    exp.write_text(json.dumps([{"cascade_id": "i1", "steps": [
        {"type": t + "USER_INPUT", "metadata": {"createdAt": "2026-01-01T00:00:00Z"}, "userInput": {"items": [{"text": "a"}, {"text": "b"}]}},
        {"type": t + "PLANNER_RESPONSE", "plannerResponse": {"thinking": "x", "toolCalls": [1]}},
        {"type": t + "CODE_ACTION", "codeAction": {"actionSpec": {"createFile": {"absoluteUri": "file:///r/n.py", "instruction": "l1\nl2"}}}},
        {"type": t + "RUN_COMMAND", "runCommand": {"commandLine": "pytest", "exitCode": 1, "cwd": "/r"}},
        {"type": t + "MCP_TOOL", "status": "DONE", "mcpTool": {"serverName": "s", "toolCall": {"name": "q", "argumentsJson": "{}"}}}]}]))
    d = antigravity.read_export(spark, str(exp))
    assert events(d, "type", "cwd") == [("user", "/r"), ("assistant", "/r"), ("assistant", "/r"), ("assistant", "/r"), ("user", "/r"), ("assistant", "/r")]
    names = [r.b.name for r in d.select("ordinal", F.explode("content").alias("b")).filter("b.type='tool_use'").orderBy("ordinal").collect()]
    assert names == ["Write", "Bash", "mcp__s__q"]


def test_history_index(spark, tmp_path):
    p = jl(tmp_path / "h.jsonl", [{"sessionId": "a", "timestamp": 1767225600000, "project": "/x"}, {"sessionId": "a", "timestamp": 1767225600, "project": "/x"},
                                  {"sessionId": "b", "timestamp": 1767225600000, "project": "/CodexBar"}, {"timestamp": 1767225600000}])
    assert [tuple(r) for r in history.read(spark, p).collect()] == [("local", "a", "2026-01")]
