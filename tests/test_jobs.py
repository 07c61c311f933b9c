"""Fact tables, links and scores on small hand-made transcripts."""
import datetime as dt
import json
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from loomtrace import dims
from loomtrace.plans import facts as FX, ordered as O, routing as RT, score as SC, stats as ST
from loomtrace.plans.tables import materialize
from loomtrace.schema import EVENTS, canonical

DDL = ", ".join(f"{k} {v}" for k, v in EVENTS.items())


def make(spark, rows):
    """rows: dicts with event columns; content items are (name, input, id) or ('!', error, id)."""
    out = []
    for i, r in enumerate(rows):
        r = dict(r)
        blocks = []
        for c in r.pop("tools", []):
            if c[0] == "!":
                blocks.append({"type": "tool_result", "is_error": c[1], "error_flag": bool(c[1]), "tool_use_id": c[2] if len(c) > 2 else None})
            elif c[0] == "~":
                blocks.append({"type": "thinking", "thinking": "t"})
            else:
                blocks.append({"type": "tool_use", "name": c[0], "input": json.dumps(c[1]), "tool_use_id": c[2] if len(c) > 2 else None})
        e = {"tenant_id": "t", "source": "claude", "file_path": "/f", "ordinal": i, "session_id": "s1", "cwd": "/r", "is_sidechain": False,
             "type": "assistant" if blocks and blocks[0]["type"] != "tool_result" else "user", "timestamp": f"2026-01-10 10:{i:02d}:00", "model": None, **r}
        if blocks:
            e["content"] = blocks
        e["ts"] = e.pop("timestamp")
        out.append({k: e.get(k) for k in EVENTS})
    schema = DDL.replace("ts timestamp", "ts string")
    return canonical(spark.createDataFrame([tuple(r[k] for k in EVENTS) for r in out], schema).withColumn("ts", F.col("ts").cast("timestamp")))


def edit(path, n=1):
    return ("Edit", {"file_path": path, "old_string": "", "new_string": "x\n" * n})


def test_recovery_grounding_and_runs_are_per_file_and_consumed_once(spark):
    b = FX.base(make(spark, [
        {"tools": [("!", True)]}, {"tools": [("!", True)]}, {"tools": [("Read", {"file_path": "a.py"}), ("Read", {})]},
        {"tools": [("mcp__mem0__search", {})]}, {"tools": [edit("a.py"), edit("a.py"), edit("b.py")]},
        {"tools": [("Bash", {"command": "git commit -m x"})]}, {"tools": [edit("a.py")]},
        {"tools": [("!", True)], "file_path": "/g"}, {"tools": [("Read", {})]}]))
    calls, res = FX.tool_calls(b), FX.tool_results(b)
    assert FX.recovered(calls, res).count() == 1                       # two errors in a row, one recovery; /g never recovers
    assert FX.grounded(FX.grounding_rows(b, calls)).count() == 1
    assert sorted((r.edit_path, r.depth) for r in FX.edit_runs(calls).collect()) == [("a.py", 1), ("a.py", 2), ("b.py", 1)]


def test_prompts_and_skill_spans(spark):
    b = FX.base(make(spark, [
        {"text": "please do <system-reminder>z</system-reminder>"}, {"text": "<command-name>/x</command-name>"}, {"text": "hidden", "is_meta": True},
        {"text": "child", "is_sidechain": True}, {"tools": [("Skill", {"skill": "tdd"})], "attribution_skill": "tdd"}, {"tools": [("Read", {})], "attribution_skill": "plan-x"},
        {"tools": [("Read", {})], "attribution_skill": "plan-x"}, {"tools": [("Read", {"file_path": "/h/skills/qa/SKILL.md"})]}]))
    p = FX.prompts(b).collect()
    assert [(r.prompt, r.bare_command, r.polite) for r in sorted(p, key=lambda r: r.ordinal)] == [("please do", False, True), ("", True, False)]
    uses = sorted(r.skill for r in FX.skill_uses(b, FX.tool_calls(b)).collect())
    assert uses == ["plan-x", "qa", "tdd"]


def test_ordered_facts_and_plan_credit(spark, tmp_path):
    todo = ("TodoWrite", {"todos": [{"content": c} for c in ("a", "b", "c")]})
    rows = [
        {"session_id": "p", "tools": [todo]}, {"session_id": "p", "tools": [edit("/r/x.md")]},
        {"session_id": "e1", "tools": [("Read", {"file_path": "q"}), edit("/r/a.py", 50), edit("/r/b.py", 5)]},
        {"session_id": "e1", "tools": [("Bash", {"command": "pytest"}, "t1")]}, {"session_id": "e1", "tools": [("!", False, "t1")]},
        {"session_id": "e2", "tools": [edit("/r/a.py", 90)]}, {"session_id": "e2", "tools": [("Bash", {"command": "pytest"}, "t2")]}, {"session_id": "e2", "tools": [("!", True, "t2")]},
        {"session_id": "e3", "tools": [edit("/r/a.py", 3)]}]
    w = str(tmp_path)
    b = materialize(FX.base(make(spark, rows)), f"{w}/base")
    calls = materialize(FX.tool_calls(b), f"{w}/calls")
    s, art = (materialize(d, f"{w}/facts_{i}") for i, d in enumerate(O.session_facts(calls, FX.outcomes(FX.tool_results(b)))))
    all_sources = lambda d: ST.at_grains(d, None).filter("g_source = '*'")
    out = O.credit_plans(all_sources(s), all_sources(art), ST.GRAIN, w).collect()
    got = {r.session_id: (r.eligible, r.planned, bool(r.evidence_before and r.eligible), r.ran_test) for r in out}
    assert got["e1"] == (True, True, True, True)        # two code files, credited with the plan of p
    assert got["e2"] == (True, False, False, False)     # eligible by churn, plan already used, test failed
    assert got["e3"][0] is False and got["p"][0] is False


def test_agent_attempts_join_invocation_result_and_child(spark):
    meta = lambda **k: {"agent_id": k.get("agent"), "status": k.get("status"), "resolved_model": k.get("model"), "edit_files": k.get("edits", 0), "assistant_uuid": None}
    rows = [{"tools": [("Agent", {}, "a1"), ("Agent", {}, "a2")], "model": "claude-opus-4", "uuid": "u"},
            {"tools": [("!", None, "a1")], "tool_meta": meta(agent="c1", status="completed", edits=2)},
            {"tools": [("!", None, "a2")], "tool_meta": meta(agent="c2", status="async_launched")},
            {"tools": [("Read", {}), edit("z.py")], "is_sidechain": True, "agent_id": "c1", "model": "claude-haiku-4"},
            {"tools": [("Read", {})], "is_sidechain": True, "agent_id": "lost", "model": "claude-haiku-4"}]
    def run(rs):
        b = FX.base(make(spark, rs))
        c = FX.tool_calls(b)
        return RT.attempt_pairs(b, c, FX.tool_results(b), FX.workflow_credits(b))
    pairs, broken = run(rows)
    assert sorted((r.child_model, r.completed, r.substantive_calls, r.writes) for r in pairs.collect() if r.completed) == [("claude-haiku-4", True, 2, 2)]
    assert broken.count() == 1                          # the lost child has no attempt
    pairs, broken = run(rows[:4])
    assert pairs.count() == 2 and broken.count() == 0
    m = RT.routing_measure(pairs, broken, pairs.select("tenant_id", "source").distinct()).filter("g_source = '*'").first()
    assert (m.routing_state, m.routing_eligible, m.routing_successful, m.routing_incomplete) == ("measured", 1, 1, 1)


def test_spawn_links_use_turn_then_identity_once(spark):
    def link(i, turn, ident, known=True):
        return {"source": "codex", "type": "routing_link", "session_id": "kid", "ordinal": 100 + i, "timestamp": f"2026-01-10 11:{i:02d}:00",
                "routing": {"provider": "openai", "parent_session": "par", "child_session": "kid", "turn_id": turn, "delegation_identity": ident, "child_model": "gpt-5-mini",
                            "completed": True, "aborted": False, "lifecycle_known": known, "substantive_calls": 9, "writes": 0}}
    def spawn(i, ident=None, turn=None):
        return {"source": "codex", "session_id": "par", "model": "gpt-5", "tools": [("Agent", {"_routing_identity": ident, "_routing_turn_id": turn})]}
    def run(rs):
        b = FX.base(make(spark, rs))
        p, k = RT.linked_spawns(b, FX.tool_calls(b))
        return sorted((r.lead_model or "") for r in p.collect()), k.count()
    assert run([spawn(0, turn="t1"), spawn(1, "kid"), link(0, "t1", "kid"), link(1, "t2", "kid")]) == (["gpt-5", "gpt-5"], 0)
    assert run([spawn(0, "kid"), spawn(1, "kid"), link(0, "t1", "kid")])[1] == 1          # two candidates: not guessed
    assert run([spawn(0, "kid"), link(0, None, "other")]) == ([""], 1)


BASE = dict(tool_calls=1000, total_sessions=20, prompts=50, thinking_blocks=60, subagent_distinct=4, fanout=2.5, max_session_types=3, agent_calls=5, no_tool_activity=False,
            planning_sessions=3, planning_eligible=20, planning_unmeasured=0, planning_state="measured", planning_share=.15, planning_coverage=1.0, plan_sessions=3,
            eligible=10, planned=2, evidence=3, test_covered=4, orchestratable=5, delegated_orchestratable=2, ordered_state="measured", skill_distinct=10, skill_total=6,
            review_skills=2, compounding=1, process_skills=True, compounding_skills=False, server_distinct=3, cli_distinct=10, planning_ratio=.5, actions_per_prompt=9.0,
            sidechain_label_state="measured", error_recovery_ratio=.8, api_errors=5, cli_total=300, mcp_calls=300, scored_models=2, scored_turns=100, scored_top=80,
            routing="unsupported", routing_successful=0, routing_eligible=0, active_hours=5.0, tool_churn=2500, cat_delegate=10, background=0, quality_skills=10, test_runs=20,
            m_heavy_files=1, m_depth_mean=3.0, m_depth_p90=6, error_rate_per_100=4.0)


def row(spark, source="claude", **over):
    d = {**BASE, **over}
    df = spark.createDataFrame([tuple(d.values())], ", ".join(f"{k} {'string' if isinstance(BASE[k], str) else 'boolean' if isinstance(BASE[k], bool) else 'double' if isinstance(BASE[k], float) else 'bigint'}" for k in d))
    return df.withColumn("id", F.lit(1)).withColumn("caps", F.array(*[F.lit(c) for c in dims.SOURCE_CAPS[source]]))


def axes(df):
    return {a.axis: (a.weight, a.normalized_score) for a in SC.axis_scores(SC.quotient(df, ["id"]), ["id"]).collect()}


def test_quotient_by_hand(spark):
    a = axes(row(spark))
    quality, freq = (.4 * .5 + .4 * .5 + .2 * 1.0), min(1, .4 / .78)
    want = {"Orchestration": .7 * quality + .3 * freq, "Skill fluency": .4 * .25 + .3 * (.006 / .009) + .3, "Tool command (MCP + CLI)": (.4 * .2 + .4 * .25) / .8,
            "Discipline": (.4 * .5 + .2 * .4) / .6, "Verification": .5 * .4 + .5 * .5, "Grounding": .5, "Context Intelligence": .3 / .6, "Compounding": .6 * (.001 / .0018) + .4 * .6,
            "Recovery": .85 * .8 + .15 * (1 - .25), "Model mix": (.35 * 2 / 3 + .35 * min(1, .2 / .3)) / .7, "Token economy": .5 / .7}
    assert set(a) == set(want)                          # Steering is withheld and drops out
    for k, v in want.items():
        assert a[k][1] == pytest.approx(v, abs=1e-12), k
    assert a["Recovery"][0] == 100 and sum(a[k][0] for k in ("Orchestration", "Skill fluency", "Tool command (MCP + CLI)", "Discipline")) == 100


def test_unmeasured_inputs_drop_and_are_not_zero(spark):
    a = axes(row(spark, eligible=4, planning_eligible=4, planning_sessions=1, planning_share=.25))
    assert "Context Intelligence" not in a and "Discipline" not in a and a["Verification"][1] == pytest.approx(.5)
    thin = axes(row(spark, tool_calls=100))
    assert thin["Skill fluency"][1] == pytest.approx((.4 * .25 + .3) / .7)          # 0.9 expected uses are no evidence
    g = axes(row(spark, source="gemini"))
    assert "Orchestration" not in g and "Skill fluency" not in g and "Model mix" in g
    bad = axes(row(spark, planning_share=.9))
    assert bad["Discipline"][1] == pytest.approx(.4)                                # share does not match its counts: refused


def test_scorecard_by_hand(spark):
    r = SC.scorecard(row(spark), ["id"]).first()
    ev = .5
    shrink = lambda x: .5 * (1 - ev) + ev * x
    assert r.execution == round(10 * (.6 * .5 + .4 * (10 / 15)), 1)
    assert r.planning == round(10 * (.3 * .5 / .65 + .3 * .25 + .25 * .5 + .15 * .4), 1)
    assert r.engineering == round(10 * (.3 * shrink(1 - 1 / 8) + .25 * shrink(1 - 3 / 9) + .2 * shrink(1 - .05 / .25) + .15 * .5 + .1 * shrink(.6)), 1)
    idle = SC.scorecard(row(spark, tool_calls=0), ["id"]).first()
    assert idle.execution == 0.0 and idle.engineering == 0.0 and idle.planning > 0
    drag = [x.label for x in SC.breakdown(SC.scorecard(row(spark), ["id"]), ["id"]).filter("axis = 'execution' and is_drag").collect()]
    assert drag == ["Delegation & parallelism"]


def test_stream_appends_once_and_finds_bursts(spark, tmp_path):
    from loomtrace.streaming import live
    src, dst, cp = (str(tmp_path / x) for x in ("in", "out", "cp"))
    make(spark, [{"text": "a"}, {"text": "b"}]).write.parquet(src)
    for _ in range(2):
        live.append_available(live.event_stream(spark, src), dst, cp)
    back = spark.read.parquet(dst)
    assert back.count() == 2
    assert [(r.events, r.active_s) for r in live.session_bursts(back).collect()] == [(2, 60.0)]


def test_stored_payload_replays_to_the_same_score(spark):
    from loomtrace.plans import combine
    from loomtrace.sinks import payloads
    one = row(spark).withColumn("tenant_id", F.lit("t")).withColumn("g_month", F.lit("*"))
    inputs = one.withColumn("g_source", F.lit("claude")).unionByName(one.withColumn("g_source", F.lit("*")))
    names = spark.createDataFrame([("t", "claude", "*", k, n, c, i) for i, (k, n, c) in enumerate([
        ("skill", "writing-plans", 4), ("skill", 'odd "name"', 2), ("model", "a", 80), ("model", "b", 20)])],
        "tenant_id string, g_source string, g_month string, kind string, name string, n long, first_seen int")
    scored = SC.quotient(inputs, ["tenant_id", "g_source", "g_month"])
    doc = payloads.payload_rows(inputs, scored, names, "2026-01-01", "2026-02-01")
    body = json.loads(doc.first().payload)
    window = body["scoring_inputs_by_source"]["claude"]["window"]
    assert body["context"]["window_months"] == 1 and window["stack"]["skills_all"] == [["writing-plans", 4], ['odd "name"', 2]]
    want = SC.quotient(inputs.filter("g_source = 'claude'").withColumn("review_skills", F.lit(0)).withColumn("compounding_skills", F.lit(True)), ["tenant_id"]).first()
    got = combine.replay(doc, ["tenant_id"]).first()
    assert (got.reject_reason, got.exactness, got.quotient, got.tier) == (None, "exact", want.quotient, want.tier)
    keep, big = payloads.split_by_budget(doc)
    assert keep.count() == 1 and big.count() == 0


def _in_order(rows):
    """The rule itself, one parent after the other, all candidates looked at."""
    out = []
    key = lambda r: (r[3] is None, r[3] or 0, r[4])
    for parent in {r[1] for r in rows}:
        spawns = sorted((r for r in rows if r[1] == parent and r[2]), key=key)
        free = [True] * len(spawns)
        for r in sorted((r for r in rows if r[1] == parent and not r[2]), key=key):
            found = [i for i, s in enumerate(spawns) if free[i] and r[9] and s[9] == r[9]]
            found = found or [i for i, s in enumerate(spawns) if free[i] and r[8] and s[8] == r[8] and (s[3] is None or r[3] is None or (s[3], s[4]) <= (r[3], r[4]))]
            if len(found) == 1:
                free[found[0]] = False
            out.append((r[10], spawns[found[0]][10] if len(found) == 1 else None, min(len(found), 2)))
        out += [("spawn", parent)] * any(free)
    return sorted(map(repr, out))


@pytest.mark.parametrize("seed", range(3))
def test_spawn_links_equal_the_rule_in_order(spark, seed, tmp_path):
    rnd, rows = random.Random(seed), []
    for p in range(60):
        turns, idents = rnd.choice([([None], ["a", "b"]), (["t1", "t2", "t3", None], ["a", None, "b"]), ([f"u{i}" for i in range(9)], ["a", "b", "c"]), (["t1", ""], ["a", ""])])
        for i in range(rnd.randint(1, 14)):
            rows.append(("x", f"p{p}", rnd.random() < .5, None if rnd.random() < .1 else float(rnd.randrange(6)), i, "f", 0, 0, rnd.choice(idents), rnd.choice(turns), f"m{p}_{i}", True, True, 1, 0))
    for i in range(300):  # one identity of one parent, in many groups
        rows.append(("x", "big", i % 3 != 1, float(i // 2), i, "f", 0, 0, "k", None, f"big{i}", True, True, 1, 0))
    schema = ("tenant_id string, parent string, spawn boolean, t double, ordinal long, file_path string, sub int, block_pos int, identity string, turn_id string, m string, "
              "completed boolean, known boolean, sub_n bigint, wr_n bigint")
    got, left = [], 0
    for r in RT.match_links(spark.createDataFrame(rows, schema).repartition(3), str(tmp_path)).collect():
        if r.spawn:
            left += 1
        else:
            got.append(repr((r.m, r.lead, min(r.cand, 2))))
    want = _in_order(rows)
    assert sorted(got) == [w for w in want if not w.startswith("('spawn'")]
    assert (left > 0) == any(w.startswith("('spawn'") for w in want)


def test_hot_session_facts_and_plans_in_use(spark, tmp_path):
    """One session over many pieces equals a plain walk; plans in use leave the pool one by one."""
    r = random.Random(5)
    rows = []
    for sid, n, start in (("hot", 900, 300), ("cold", 12, 5), ("none", 40, 10 ** 9), (None, 3, 0)):
        for k in range(n):
            ordinal = k * 1500  # a few calls a piece
            code = k >= start and r.random() < .2
            rows.append(("t", "claude", f"f{k % 3}", ordinal, 0, 0, None if k % 50 == 49 else dt.datetime(2024, 1, 1) + dt.timedelta(seconds=k), sid, f"/repo{k % 2}", "Edit" if code else r.choice(["Read", "TodoWrite", "Bash"]),
                         f"/r/{r.randrange(9)}.py", code, "code" if code else "other", True, "doing", r.randrange(90), False, k == 7, k % 60 == 3, r.random() < .1, f"id{k}", [r.choice("abcd")]))
    schema = ("tenant_id string, source string, file_path string, ordinal bigint, sub int, block_pos int, ts timestamp, session_id string, cwd string, name string, abs_target string, is_write boolean, file_class string, "
              "substantive boolean, category string, loc bigint, knowledge boolean, plan_skill boolean, plan_file boolean, runs_tests boolean, tool_use_id string, steps array<string>")
    calls = spark.createDataFrame(rows, schema).withColumn("is_write", F.col("is_write") | F.col("plan_file"))
    outcomes = calls.select("tenant_id", "source", "session_id", "tool_use_id", F.lit(False).alias("errored"))
    plain, art = O.session_facts(calls, outcomes)
    written, _ = O.session_facts(calls, outcomes, work=str(tmp_path))
    got = {x.session_id: x for x in plain.collect()}
    assert {k: v.asDict(True) for k, v in got.items()} == {x.session_id: x.asDict(True) for x in written.collect()}
    have = Counter((x.session_id, x.cwd, x.t) for x in art.collect())
    want = Counter()
    for sid in ("hot", "cold", "none"):
        at = lambda x: (x[6] is None, x[6] or dt.datetime.max, x[3], x[2])
        mine = sorted((x for x in rows if x[7] == sid), key=at)
        cut = next((i for i, x in enumerate(mine) if x[11] and x[12] == "code"), len(mine))
        early, t = mine[:cut], lambda x: float("inf") if x[6] is None else x[6].timestamp()
        skilled = any(x[17] for x in early)
        assert bool(got[sid].plan_skill) == skilled and got[sid].code_writes == sum(x[11] and x[12] == "code" for x in mine)
        assert got[sid].first_write == (t(mine[cut]) if cut < len(mine) else None) and got[sid].first_cwd == (mine[cut][8] if cut < len(mine) else None)
        assert got[sid].ran_test == any(x[19] for x in mine[cut + 1:])
        for x in early:
            if x[18] and (x[15] >= O.C["PLAN_MIN_LINES"] or skilled):
                want[sid, x[8], t(x)] += 1
        steps = []
        for x in early:
            if x[9] == "TodoWrite" and x[21][0] not in steps:
                steps.append(x[21][0])
                if len(steps) == O.C["PLAN_MIN_STEPS"]:
                    want[sid, x[8], t(x)] += 1
        mine = [k for k in want if k[0] == sid]
        assert (got[sid].own_plan is None) == (not mine) and (not mine or (got[sid].own_plan.t, got[sid].own_plan.cwd) == min((k[2], k[1]) for k in mine))
    assert have == want


def test_rows_of_all_grains_stay_where_they_are_made(spark, tmp_path):
    """Buckets and sessions are dealt out as single rows; nothing is shuffled by session after it went to four grains."""
    b = materialize(FX.base(make(spark, [{"tools": [edit("/r/a.py")]}, {"tools": [("Read", {})], "session_id": "s2"}])), f"{tmp_path}/base")
    calls, res = FX.tool_calls(b), FX.tool_results(b)
    ground = FX.grounding_rows(b, calls)
    sm = materialize(ST.session_months(b, FX.prompts(b), calls, res, FX.grounded(ground), ground, FX.recovered(calls, res), FX.workflow_credits(b)), f"{tmp_path}/sm")
    plan = lambda d: d._jdf.queryExecution().executedPlan().toString().splitlines()
    for d in (ST.activity(b), ST.counters(sm, ST.late_credits(b, calls, sm, str(tmp_path)))):
        assert not [x for x in plan(d) if "Exchange hashpartitioning" in x and "session_id" in x and "g_source" in x]


def test_late_marks_credit_sessions_that_were_eligible_before(spark, tmp_path):
    plan, read = [("TodoWrite", {}), ("ExitPlanMode", {})], [("Read", {})]
    rows = [{"session_id": "after", "tools": read}, {"session_id": "after", "tools": plan, "synth_ts": True},
            {"session_id": "before", "tools": plan, "synth_ts": True}, {"session_id": "before", "tools": read},
            {"session_id": "both", "tools": plan}, {"session_id": "both", "tools": plan, "synth_ts": True},
            {"session_id": "only", "tools": plan, "synth_ts": True}, {"session_id": "none", "tools": read},
            {"session_id": "next", "tools": read, "timestamp": "2026-02-01 10:00:00"}, {"session_id": "next", "tools": plan, "synth_ts": True}]
    b = materialize(FX.base(make(spark, [{"source": "codex", **r} for r in rows])), f"{tmp_path}/base")
    calls, res = materialize(FX.tool_calls(b), f"{tmp_path}/calls"), FX.tool_results(b)
    ground = FX.grounding_rows(b, calls)
    sm = materialize(ST.session_months(b, FX.prompts(b), calls, res, FX.grounded(ground), ground, FX.recovered(calls, res), FX.workflow_credits(b)), f"{tmp_path}/sm")
    c = {(r.g_source, r.g_month): (r.planning_sessions, r.planning_eligible) for r in ST.counters(sm, ST.late_credits(b, calls, sm, f"{tmp_path}/w")).collect()}
    assert c[("*", "*")] == c[("codex", "*")] == (3, 5)             # after, both and next
    assert c[("*", "2026-01")] == (2, 4) and c[("*", "2026-02")] == (0, 1)


def test_derived_transcripts_are_dealt_out_and_parsed_once(spark, tmp_path):
    from loomtrace.catalog.registry import Tables
    from loomtrace.catalog.transcripts import transcripts
    rows = [(i, dt.datetime(2026, 1, 1, 0, i), i % 7, ["click", "view", "purchase", "signup", "error", None][i % 6], '{"k": %d}' % i) for i in range(40)]
    spark.createDataFrame(rows, "event_id bigint, ts timestamp_ntz, user_id bigint, event_type string, props string").write.parquet(f"{tmp_path}/events.parquet")
    t = transcripts(Tables(spark, str(tmp_path)))
    plan = t.select("model", "usage", "content")._jdf.queryExecution().optimizedPlan().toString()
    assert "RepartitionByExpression [event_id" in plan and plan.count("get_json_object") == 1
    called = {r.ordinal: r for r in t.collect()}
    assert len(called) == 40 and all((r.model is None) == (not r.content or r.content[0].type != "tool_use") for r in called.values())
