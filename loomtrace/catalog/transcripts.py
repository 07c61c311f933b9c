"""Whole jobs over transcripts that are derived from the event table.

The given tables hold no transcripts, so each event becomes one transcript event: clicks
read files, plan or run commands, views query a knowledge server, purchases edit a file,
sign-ups prompt or dispatch an agent, errors are failed tool results.
"""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomtrace.catalog.registry import Tables, query
from loomtrace.operators import aggregates as A
from loomtrace.plans import audit as AU, facts as FX, ordered as O, report as RP, score as SC, stats as ST
from loomtrace.plans.tables import materialize, work_dir
from loomtrace.schema import BLOCK, canonical, result_block, tool_block

SOURCES = ["claude", "codex", "cursor", "gemini"]
MODELS = ["claude-opus-4-7", "claude-sonnet-4-5", "gpt-5.4", "gpt-5-mini"]


def transcripts(t: Tables) -> DataFrame:
    """One transcript event per row of the event table. A file has few row groups: its rows are dealt out before text is built."""
    k, et, u = F.col("k"), F.col("event_type"), F.col("user_id")
    pick = lambda vals, i: F.element_at(F.array(*[F.lit(v) for v in vals]), (i % len(vals) + 1).cast("int"))
    src = pick(SOURCES, u)
    path = F.concat(F.lit("src/m"), (k % 20).cast("string"), F.lit(".py"))
    js = lambda **kw: F.to_json(F.struct(*[c.alias(n) for n, c in kw.items()]))
    read = tool_block(F.lit("Read"), js(file_path=path))
    test = tool_block(F.lit("Bash"), js(command=F.lit("pytest -q && git commit -m x")))
    todo = tool_block(F.lit("TodoWrite"), js(todos=F.array(*[F.struct(F.concat(F.lit(f"step {i} "), k.cast("string")).alias("content")) for i in range(3)])))
    ask = tool_block(F.lit("mcp__memory__search_notes"), js(query=path))
    edit = tool_block(F.lit("Edit"), js(file_path=path, old_string=F.lit("a"), new_string=F.repeat(F.lit("x\n"), k % 40 + 1)))
    agent = tool_block(F.lit("Agent"), js(subagent_type=F.when(k % 8 == 0, "planner").otherwise("worker")))
    click = F.when(k % 10 == 0, test).when(k % 10 == 1, todo).otherwise(read)
    dispatch = (et == "signup") & (k % 4 == 0)
    tool = F.when(et == "click", click).when(et == "view", ask).when(et == "purchase", edit).when(dispatch, agent)
    is_error, called = et == "error", et.isin("click", "view", "purchase") | dispatch  # a tool block is built where it is written only
    content = F.when(is_error, F.array(result_block(F.lit(True)))).when(called, F.array(tool))
    # a third of the users each live one and two months later, so months differ
    events = t.events.select("event_id", "user_id", "event_type", F.expr("ts + make_ym_interval(0, cast(user_id % 3 as int))").alias("ts"),
                             F.get_json_object("props", "$.k").cast("int").alias("k")).repartition("event_id")
    used = F.struct(k.cast("bigint").alias("input"), F.lit(1).cast("bigint").alias("output"), (k % 7).cast("bigint").alias("cache_read"), F.lit(0).cast("bigint").alias("cache_creation"))
    return canonical(events.select(
        F.concat(F.lit("dev"), (u % 5).cast("string")).alias("tenant_id"), src.alias("source"),
        F.concat(F.lit("/t/"), src, F.lit("/u"), u.cast("string"), F.lit(".jsonl")).alias("file_path"), F.col("event_id").alias("ordinal"),
        F.col("ts").cast("timestamp").alias("ts"), F.concat(F.lit("u"), u.cast("string"), F.lit("-"), F.date_format("ts", "yyyyMMdd")).alias("session_id"),
        F.concat(F.lit("/repo"), (u % 3).cast("string")).alias("cwd"), F.lit(False).alias("is_sidechain"),
        F.when(is_error | ((et == "signup") & ~dispatch), "user").otherwise("assistant").alias("type"),
        F.when(called, pick(MODELS, k)).alias("model"), F.when(called, used).alias("usage"),
        F.when((et == "signup") & ~dispatch, F.concat(F.lit("please build item "), k.cast("string"))).alias("text"), content.cast(f"array<{BLOCK}>").alias("content")))


# the same mapping for SQL
T = """
WITH t AS (SELECT event_id AS o, ts, strftime(ts, '%Y-%m') AS month, 'dev' || (user_id % 5) AS tenant_id, user_id AS u,
    ['claude','codex','cursor','gemini'][CAST(user_id % 4 + 1 AS INT)] AS source, 'u' || user_id || '-' || strftime(ts, '%Y%m%d') AS session_id,
    CAST(json_extract(props, '$.k') AS INT) AS k, event_type AS et FROM (SELECT * REPLACE (ts + INTERVAL 1 MONTH * (user_id % 3) AS ts) FROM events)),
 c AS (SELECT *, CASE WHEN et = 'click' THEN CASE WHEN k % 10 = 0 THEN 'Bash' WHEN k % 10 = 1 THEN 'TodoWrite' ELSE 'Read' END
    WHEN et = 'view' THEN 'mcp' WHEN et = 'purchase' THEN 'Edit' WHEN et = 'signup' AND k % 4 = 0 THEN 'Agent' WHEN et = 'error' THEN 'error' ELSE 'prompt' END AS tool FROM t)"""


def prepared(t: Tables, facts: list[str] | None = None):
    """Events as they are derived (never written again) and the call facts (all, or the named ones), written once."""
    w = work_dir(t.spark)
    b = FX.base(transcripts(t))
    calls = FX.tool_calls(b)
    return b, materialize(calls.select(*facts) if facts else calls, f"{w}/tool_calls"), FX.tool_results(b)


@query("monthly_habits", T + """,
 p AS (SELECT *, lag(tool) OVER (PARTITION BY u, session_id ORDER BY o) AS prev FROM c WHERE tool <> 'prompt')
SELECT month, CAST(count(*) FILTER (tool NOT IN ('error', 'prompt')) AS BIGINT) AS tool_calls,
  CAST(count(*) FILTER (tool = 'prompt') AS BIGINT) AS prompts,
  round(count(*) FILTER (tool IN ('Read', 'mcp')) / (count(*) FILTER (tool IN ('Bash', 'Edit', 'Agent')) - count(*) FILTER (tool = 'Agent' AND k % 8 = 0)), 6) AS explore_to_doing,
  round((SELECT count(*) FROM p WHERE p.month = c.month AND prev = 'error' AND tool <> 'error') / count(*) FILTER (tool = 'error'), 6) AS error_recovery
FROM c GROUP BY 1""")
def _(t: Tables):
    b, calls, results = prepared(t, [*FX.THREAD, *FX.ORDER, "month", "category", "plan_dispatch"])
    rec = FX.recovered(calls, results)
    n = lambda **kw: [kw.get(c, F.lit(0)).cast("bigint").alias(c) for c in ("calls", "explore", "raw", "dispatch", "prompts", "errors", "recovered")]
    one, cat = F.lit(1), F.col("category")
    parts = (calls.select("month", *n(calls=one, explore=(cat == "explore").cast("int"), raw=cat.isin("produce", "execute", "delegate").cast("int"),
                                      dispatch=F.col("plan_dispatch").cast("int")))
             .unionByName(FX.prompts(b).filter("not bare_command").select("month", *n(prompts=one)))
             .unionByName(results.filter("error_flag").select("month", *n(errors=one)))
             .unionByName(rec.select("month", *n(recovered=one))))
    s = parts.groupBy("month").agg(*[F.sum(c).alias(c) for c in ("calls", "explore", "raw", "dispatch", "prompts", "errors", "recovered")])
    from loomtrace.operators.joins import adjusted_doing
    return s.select("month", F.col("calls").alias("tool_calls"), "prompts",
                    F.round(F.col("explore") / adjusted_doing(F.col("raw"), F.col("dispatch")), 6).alias("explore_to_doing"),
                    F.round(F.col("recovered") / F.col("errors"), 6).alias("error_recovery"))


@query("session_eligibility", T + """,
 w AS (SELECT *, CASE WHEN tool = 'Edit' THEN k % 40 + 2 ELSE 0 END AS loc, min(CASE WHEN tool = 'Edit' THEN o END) OVER (PARTITION BY tenant_id, source, session_id) AS cut FROM c),
 s AS (SELECT tenant_id, source, session_id, count(DISTINCT CASE WHEN tool = 'Edit' THEN k % 20 END) AS files, sum(loc) AS churn,
    count(DISTINCT CASE WHEN tool = 'Read' THEN k % 20 END) + count(*) FILTER (tool IN ('Edit', 'mcp', 'Bash', 'Agent')) AS substantive,
    count(DISTINCT CASE WHEN tool = 'Read' THEN k % 20 END) + count(*) FILTER (tool IN ('Edit', 'mcp', 'Bash')) AS own,
    coalesce(bool_or((cut IS NULL OR o < cut) AND tool IN ('Read', 'mcp')), false) AS ev,
    coalesce(bool_or((cut IS NULL OR o < cut) AND (tool = 'TodoWrite' OR (tool = 'Agent' AND k % 8 = 0))), false) AS planned FROM w GROUP BY 1, 2, 3)
SELECT tenant_id, source, CAST(count(*) FILTER (files > 0 AND (files >= 2 OR churn >= 80 OR substantive >= 10)) AS BIGINT) AS eligible,
  CAST(count(*) FILTER (files > 0 AND (files >= 2 OR churn >= 80 OR substantive >= 10) AND ev) AS BIGINT) AS evidence,
  CAST(count(*) FILTER (files > 0 AND (files >= 2 OR churn >= 80 OR substantive >= 10) AND planned) AS BIGINT) AS planned_intra,
  CAST(count(*) FILTER (files > 0 AND (files >= 3 OR own >= 20)) AS BIGINT) AS orchestratable
FROM s GROUP BY 1, 2""")
def _(t: Tables):
    b, calls, results = prepared(t)
    s, _ = O.session_facts(calls, FX.outcomes(results), work=work_dir(t.spark))
    return s.groupBy("tenant_id", "source").agg(
        A.count_if(F.col("eligible")).alias("eligible"), A.count_if(F.col("eligible") & F.col("evidence_before")).alias("evidence"),
        A.count_if(F.col("eligible") & F.col("planned_intra")).alias("planned_intra"), A.count_if(F.col("orchestratable")).alias("orchestratable"))


@query("iteration_runs", T + """,
 e AS (SELECT *, sum(CASE WHEN tool = 'Bash' THEN 1 ELSE 0 END) OVER (PARTITION BY u, session_id ORDER BY o) AS ep FROM c),
 r AS (SELECT tenant_id, u, session_id, ep, k % 20 AS p, count(*) AS depth, arg_max(month, o) AS month FROM e WHERE tool = 'Edit' GROUP BY ALL)
SELECT tenant_id, month, depth, CAST(count(*) AS BIGINT) AS runs FROM r GROUP BY ALL""")
def _(t: Tables):
    r = FX.edit_runs(FX.tool_calls(FX.base(transcripts(t))))
    return r.groupBy("tenant_id", "month", "depth").agg(F.count(F.lit(1)).alias("runs"))


@query("grounded_sessions", T + """,
 g AS (SELECT *, lag(tool) OVER (PARTITION BY u, session_id ORDER BY o) AS prev FROM c WHERE tool IN ('mcp', 'Edit'))
SELECT tenant_id, source, CAST(count(DISTINCT session_id) FILTER (tool = 'Edit') AS BIGINT) AS write_sessions,
  CAST(count(DISTINCT session_id) FILTER (tool = 'Edit' AND prev = 'mcp') AS BIGINT) AS grounded FROM g GROUP BY 1, 2""")
def _(t: Tables):
    b, calls, _ = prepared(t)
    rows = FX.grounding_rows(b, calls)
    hit = FX.grounded(rows).select("tenant_id", "source", "session_id", F.lit(0).alias("w"), F.lit(1).alias("g"))
    per = (rows.filter("write or arm").select("tenant_id", "source", "session_id", F.col("write").cast("int").alias("w"), F.lit(0).alias("g")).unionByName(hit)
           .groupBy("tenant_id", "source", "session_id").agg(F.max("w").alias("w"), F.max("g").alias("g")))
    return per.groupBy("tenant_id", "source").agg(F.sum("w").cast("bigint").alias("write_sessions"), F.sum("g").cast("bigint").alias("grounded"))


@query("name_usage", T + """,
 n AS (SELECT tenant_id, source, month, o, CASE tool WHEN 'mcp' THEN 'mcp__memory__search_notes' ELSE tool END AS name FROM c WHERE tool NOT IN ('error', 'prompt')),
 g AS (SELECT tenant_id, name, count(*) AS n, min(o) AS f FROM n GROUP BY 1, 2)
SELECT tenant_id, name, n, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY n DESC, name) AS INTEGER) AS rank FROM g""")
def _(t: Tables):
    b = FX.base(transcripts(t))
    calls = FX.tool_calls(b)
    names = ST.name_counts(b, calls, FX.skill_uses(b, calls)).filter("kind = 'tool'")
    g = names.groupBy("tenant_id", "name").agg(F.sum("n").alias("n"))
    return A.rank_counts(g, ["tenant_id"], 100, "n", ["name"])


INPUT_COLUMNS = ["total_sessions", "prompts", "tool_calls", "assistant_turns", "tool_errors", "recovered", "cat_explore", "cat_produce", "cat_execute", "cat_delegate",
                 "cat_plan", "planning_dispatch", "mcp_calls", "lines_added", "lines_removed", "test_runs", "commits", "tool_distinct", "model_distinct", "server_distinct",
                 "delegating_sessions", "plan_sessions", "planning_eligible", "active_days", "polite_prompts"]


@query("scoring_input_counters", T + f""",
 x AS (SELECT c.*, lag(tool) OVER (PARTITION BY u, session_id ORDER BY o) AS prev_any FROM c),
 p AS (SELECT o, lag(tool) OVER (PARTITION BY u, session_id ORDER BY o) AS prev FROM c WHERE tool <> 'prompt'),
 y AS (SELECT x.*, p.prev, unnest([1, 2, 3, 4]) AS g FROM x LEFT JOIN p ON p.o = x.o),
 z AS (SELECT *, CASE WHEN g IN (1, 3) THEN '*' ELSE source END AS g_source, CASE WHEN g IN (1, 2) THEN '*' ELSE month END AS g_month FROM y)
SELECT tenant_id, g_source, g_month, CAST(count(DISTINCT session_id) AS BIGINT) AS total_sessions, count(*) FILTER (tool = 'prompt') AS prompts,
 count(*) FILTER (tool NOT IN ('error', 'prompt')) AS tool_calls, count(*) FILTER (tool NOT IN ('error', 'prompt')) AS assistant_turns, count(*) FILTER (tool = 'error') AS tool_errors,
 count(*) FILTER (tool NOT IN ('error', 'prompt') AND prev = 'error') AS recovered, count(*) FILTER (tool IN ('Read', 'mcp')) AS cat_explore, count(*) FILTER (tool = 'Edit') AS cat_produce,
 count(*) FILTER (tool = 'Bash') AS cat_execute, count(*) FILTER (tool = 'Agent') AS cat_delegate, count(*) FILTER (tool = 'TodoWrite') AS cat_plan,
 count(*) FILTER (tool = 'Agent' AND k % 8 = 0) AS planning_dispatch, count(*) FILTER (tool = 'mcp') AS mcp_calls,
 CAST(coalesce(sum(k % 40 + 1) FILTER (tool = 'Edit'), 0) AS BIGINT) AS lines_added, count(*) FILTER (tool = 'Edit') AS lines_removed,
 count(*) FILTER (tool = 'Bash') AS test_runs, count(*) FILTER (tool = 'Bash') AS commits, count(DISTINCT tool) FILTER (tool NOT IN ('error', 'prompt')) AS tool_distinct,
 count(DISTINCT k % 4) FILTER (tool NOT IN ('error', 'prompt')) AS model_distinct, count(DISTINCT 1) FILTER (tool = 'mcp') AS server_distinct,
 count(DISTINCT session_id) FILTER (tool = 'Agent') AS delegating_sessions, count(DISTINCT session_id) FILTER (tool = 'TodoWrite' OR (tool = 'Agent' AND k % 8 = 0)) AS plan_sessions,
 count(DISTINCT session_id) FILTER (source <> 'gemini') AS planning_eligible, count(DISTINCT CAST(ts AS DATE)) AS active_days, count(*) FILTER (tool = 'prompt') AS polite_prompts
FROM z GROUP BY 1, 2, 3""")
def _(t: Tables):
    wide = ST.scoring_inputs(transcripts(t), work_dir(t.spark))
    return wide.select("tenant_id", "g_source", "g_month", *[F.col(c).cast("bigint").alias(c) for c in INPUT_COLUMNS])


def thinking(b: DataFrame, owner: list[str]) -> DataFrame:
    n = F.coalesce(F.size(F.filter("content", lambda c: c["type"] == "thinking")), F.lit(0))
    return b.groupBy(*owner).agg(F.sum(n).cast("bigint").alias("thinking_blocks"))


@query("audit_fingerprint", T + """
SELECT tenant_id, count(*) AS tool_calls, CAST(count(DISTINCT session_id) AS BIGINT) AS sessions, 0.0::DOUBLE AS sidechain_share
FROM c WHERE tool NOT IN ('error', 'prompt') GROUP BY 1""")
def _(t: Tables):
    calls = FX.tool_calls(FX.base(transcripts(t)))
    return AU.corpus_fingerprint(calls, ["tenant_id"], F.col("ordinal"))[0]


@query("audit_cli_mcp", T + """
SELECT tenant_id, CAST(CASE WHEN count(*) FILTER (tool = 'Bash') > 0 THEN 2 ELSE 0 END AS BIGINT) AS clis_distinct,
 CAST(CASE WHEN count(*) FILTER (tool = 'mcp') > 0 THEN 1 ELSE 0 END AS BIGINT) AS servers_distinct, 2 * count(*) FILTER (tool = 'Bash') AS cli_calls,
 count(*) FILTER (tool = 'mcp') AS mcp_calls, round(2 * count(*) FILTER (tool = 'Bash') / (2 * count(*) FILTER (tool = 'Bash') + count(*) FILTER (tool = 'mcp')), 9) AS cli_share FROM c GROUP BY 1""")
def _(t: Tables):
    r = AU.cli_mcp_recount(FX.tool_calls(FX.base(transcripts(t))), ["tenant_id"])
    return r.withColumn("cli_share", F.round("cli_share", 9))


@query("audit_profile", T + """
SELECT tenant_id, count(*) AS tool_calls, CAST(count(DISTINCT u % 3) AS BIGINT) AS project_roots, round(count(*) FILTER (tool IN ('Read', 'mcp')) / count(*), 9) AS explore_share,
 round(count(*) FILTER (tool IN ('Read', 'mcp')) / count(*) FILTER (tool IN ('Edit', 'Bash', 'Agent')), 9) AS explore_to_doing FROM c WHERE tool NOT IN ('error', 'prompt') GROUP BY 1""")
def _(t: Tables):
    b = FX.base(transcripts(t))
    r = AU.comparison_profile(FX.tool_calls(b), thinking(b, ["tenant_id"]), ["tenant_id"])
    return r.select("tenant_id", "tool_calls", "project_roots", F.round("explore_share", 9).alias("explore_share"), F.round("explore_to_doing", 9).alias("explore_to_doing"))


@query("audit_task_tools", T + " SELECT tenant_id, 'TodoWrite' AS name, count(*) AS n FROM c WHERE tool = 'TodoWrite' GROUP BY 1")
def _(t: Tables):
    return AU.task_tools(FX.tool_calls(FX.base(transcripts(t))), ["tenant_id"])


@query("test_outcomes", T + """,
 e AS (SELECT *, min(CASE WHEN tool = 'Edit' THEN o END) OVER (PARTITION BY tenant_id, source, session_id) AS cut FROM c)
SELECT tenant_id, CAST(count(DISTINCT source || session_id) FILTER (tool = 'Bash' AND o > cut) AS BIGINT) AS tested_later,
 CAST(count(DISTINCT source || session_id) FILTER (tool = 'Bash') AS BIGINT) AS tested FROM e GROUP BY 1""")
def _(t: Tables):
    calls = FX.tool_calls(FX.base(transcripts(t))).select(*FX.SESSION, "ordinal", "is_write", "file_class", "runs_tests")
    cut = calls.groupBy(*FX.SESSION).agg(F.min(F.when(F.col("is_write") & (F.col("file_class") == "code"), F.col("ordinal"))).alias("cut"),
                                         F.max(F.when(F.col("runs_tests"), F.col("ordinal"))).alias("last_test"))
    return cut.groupBy("tenant_id").agg(A.count_if(F.col("last_test") > F.col("cut")).alias("tested_later"), A.count_if(F.col("last_test").isNotNull()).alias("tested"))


@query("developer_scores")
def _(t: Tables):
    """The whole job: transcripts to facts, scoring inputs and scores at every grain."""
    w = work_dir(t.spark)
    wide = ST.scoring_inputs(transcripts(t), w)
    keep = ST.GRAIN
    q = materialize(SC.quotient(wide, keep), f"{w}/quotient")
    card = SC.scorecard(wide, keep).select(*keep, "execution", "planning", "engineering")
    return q.join(card, keep).select(*keep, "quotient", "tier", "execution", "planning", "engineering", F.transform("pillars", lambda p: p["score"]).alias("pillar_scores"))


@query("report_tokens", T + """
SELECT tenant_id, ['claude-opus-4-7', 'claude-sonnet-4-5', 'gpt-5.4', 'gpt-5-mini'][k % 4 + 1] AS model, month, count(*) AS turns, CAST(sum(k) AS BIGINT) AS input, count(*) AS output,
  CAST(sum(k % 7) AS BIGINT) AS cache_read, CAST(0 AS BIGINT) AS cache_creation FROM c WHERE tool NOT IN ('error', 'prompt') GROUP BY 1, 2, 3""")
def _(t: Tables):
    return RP.token_totals(FX.base(transcripts(t)), ["tenant_id", "model", "month"])


@query("report_models", T + """,
 g AS (SELECT tenant_id, ['claude-opus-4-7', 'claude-sonnet-4-5', 'gpt-5.4', 'gpt-5-mini'][k % 4 + 1] AS model, count(*) AS turns, CAST(sum(k + 1 + k % 7) AS BIGINT) AS tokens FROM c WHERE tool NOT IN ('error', 'prompt') GROUP BY 1, 2)
SELECT tenant_id, model, CAST(row_number() OVER (PARTITION BY tenant_id ORDER BY turns DESC, model) AS INTEGER) AS rank, turns, tokens, round_even(turns / sum(turns) OVER (PARTITION BY tenant_id), 3) AS share FROM g""")
def _(t: Tables):
    return RP.model_usage(FX.base(transcripts(t)), ["tenant_id"])


@query("report_rhythm", T + """
SELECT tenant_id, CAST(hour(ts) AS INTEGER) AS hour, ['Mon', 'Tue', 'Wed', 'Thu', 'Fri', 'Sat', 'Sun'][isodow(ts)] AS day, count(*) AS prompts FROM c WHERE tool = 'prompt' GROUP BY 1, 2, 3""")
def _(t: Tables):
    return RP.rhythm(FX.base(transcripts(t)), ["tenant_id"])


@query("report_months", T + """
SELECT tenant_id, month, count(*) FILTER (tool = 'prompt') AS prompts, count(*) FILTER (tool NOT IN ('error', 'prompt')) AS calls,
  CAST(coalesce(sum(k % 40 + 1) FILTER (tool = 'Edit'), 0) AS BIGINT) AS added, count(*) FILTER (tool = 'Edit') AS removed,
  CAST(coalesce(sum(k) FILTER (tool NOT IN ('error', 'prompt')), 0) AS BIGINT) AS input, count(*) FILTER (tool NOT IN ('error', 'prompt')) AS output,
  count(DISTINCT CAST(ts AS DATE)) AS active_days, count(DISTINCT source || session_id) AS sessions FROM c GROUP BY 1, 2""")
def _(t: Tables):
    b = FX.base(transcripts(t))
    return RP.months(b, FX.tool_calls(b), ["tenant_id"])


@query("report_projects", T + """
SELECT tenant_id, 'repo' || (u % 3) AS project, count(*) AS events, count(DISTINCT source || session_id) AS sessions, count(*) FILTER (tool NOT IN ('error', 'prompt')) AS calls FROM c GROUP BY 1, 2""")
def _(t: Tables):
    b = FX.base(transcripts(t))
    return RP.projects(b, FX.tool_calls(b), ["tenant_id"])


@query("report_sources", T + """,
 g AS (SELECT tenant_id, source, count(DISTINCT session_id) AS sessions, count(*) FILTER (tool = 'prompt') AS prompts, count(*) FILTER (tool NOT IN ('error', 'prompt')) AS calls FROM c GROUP BY 1, 2)
SELECT *, round_even(sessions / sum(sessions) OVER w, 3) AS sessions_share, round_even(prompts / sum(prompts) OVER w, 3) AS prompts_share, round_even(calls / sum(calls) OVER w, 3) AS calls_share FROM g WINDOW w AS (PARTITION BY tenant_id)""")
def _(t: Tables):
    b = FX.base(transcripts(t))
    return RP.sources(b, FX.tool_calls(b), ["tenant_id"]).drop("hours", "hours_share")
