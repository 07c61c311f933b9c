"""Fact tables from canonical events: prompts, tool calls, results, skills, sessions."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace import dims
from loomtrace.functions import paths as P, text as X, tools as T
from loomtrace.operators import aggregates as A, joins as J, sequence as S
from loomtrace.schema import TOOL_INPUT
from loomtrace.sources.files import chunk, first_of, non_empty

KEY = ["tenant_id", "source", "file_path", "ordinal", "sub"]
ORDER = ["ordinal", "sub", "block_pos"]
THREAD = ["tenant_id", "source", "file_path", "session_id"]
SESSION = ["tenant_id", "source", "session_id"]


def base(events: DataFrame) -> DataFrame:
    """Readable events with month and the planning eligibility of each event."""
    e = events.filter(~F.col("bad"))
    scope = T.planning_scope_measured(F.col("source"))
    candidate = (F.col("session_id").isNotNull() & F.col("ts").isNotNull() & ~F.col("synth_ts")
                 & ~F.col("is_usage_only") & (F.coalesce("type", F.lit("")) != "routing_link"))
    root = F.coalesce(F.col("is_sidechain") == F.lit(False), F.lit(False))
    real = (F.col("session_id").isNotNull() & F.col("ts").isNotNull() & ~F.col("is_usage_only")
            & (F.coalesce("type", F.lit("")) != "routing_link"))
    return e.select(
        "*", F.date_format("ts", "yyyy-MM").alias("month"),
        (candidate & scope & root).alias("plan_eligible"),
        (candidate & (~scope | F.col("is_sidechain").isNull())).alias("plan_unmeasured"),
        # a synthetic time may credit a session that a real event has made eligible, never create one
        (real & scope & root).alias("plan_creditable"))


def prompts(b: DataFrame) -> DataFrame:
    """Human instructions: cleaned text, or a bare command without text."""
    human = ((F.col("type") == "user") & ~F.col("is_meta") & ~F.col("is_compact") & ~F.col("is_transcript_only")
             & ~F.coalesce("is_sidechain", F.lit(False)))
    texts = F.filter("content", lambda c: c["type"] == "text")
    raw = F.coalesce(F.col("text"), F.when(F.size(texts) > 0, F.array_join(
        F.transform(texts, lambda c: F.coalesce(c["text"], F.lit(""))), "\n")))
    p = b.filter(human).select(*KEY, "ts", "month", "session_id", "cwd", raw.alias("raw")).filter("raw is not null")
    p = p.withColumn("prompt", X.strip_injections(F.col("raw"))).withColumn("is_command", X.is_command_text(F.col("raw"))).drop("raw")
    p = p.filter((F.col("prompt") != "") | F.col("is_command"))
    return p.withColumn("bare_command", F.col("prompt") == "").withColumn(
        "polite", ~F.col("bare_command") & X.is_polite(F.col("prompt"))).withColumn("n_chars", F.length("prompt"))


def tool_calls(b: DataFrame) -> DataFrame:
    """One classified row per tool call."""
    t = b.filter("type = 'assistant'").select(
        *KEY, "ts", "month", "session_id", "agent_id", "uuid", "cwd", "is_sidechain", "model", "attribution_skill", "plan_creditable", "synth_ts",
        F.posexplode("content").alias("block_pos", "c")).filter("c.type = 'tool_use'")
    t = t.select(*[c for c in t.columns if c != "c"], F.coalesce("c.name", F.lit("?")).alias("name"), F.col("c.tool_use_id").alias("tool_use_id"),
                 F.from_json(F.coalesce("c.input", F.lit("{}")), TOOL_INPUT).alias("i"))
    name, i = F.col("name"), F.col("i")
    shell = name.isin(dims.SHELL_TOOLS)
    target = P.forward(F.coalesce(first_of(*[i[k] for k in ("file_path", "notebook_path", "path", "pattern", "query")]), F.lit("")))
    plan = first_of(*[F.when(i[k] != "[]", i[k]) for k in ("todos", "items", "tasks", "plan")])
    t = t.select("*", F.when(shell, X.argv_command(i["command"])).otherwise("").alias("cmd"), target.alias("target"),
                 T.classify(name).alias("category"), T.is_mcp(name).alias("is_mcp"), T.mcp_server(name).alias("server"), T.mcp_tool(name).alias("mcp_tool"),
                 T.is_substantive(name).alias("substantive"), name.isin(dims.DELEGATE_TOOLS).alias("dispatch"),
                 F.coalesce(non_empty(i["subagent_type"]), F.when(i["subagent_type"].isNull(), "general-purpose"), F.lit("")).alias("subagent_type"),
                 F.from_json(plan, "array<string>").alias("raw_steps"))
    cmd, cat = F.col("cmd"), F.col("category")
    is_bash = name == "Bash"
    old, new = X.line_count(i["old_string"]), X.line_count(i["new_string"])
    edits = lambda side: F.aggregate(F.transform(F.coalesce(i["edits"], F.array().cast("array<struct<old_string:string,new_string:string>>")),
                                                 lambda e: X.line_count(e[side])), F.lit(0).cast("bigint"), lambda a, x: a + x)
    zero = F.lit(0).cast("bigint")
    added = (F.when(name == "Edit", new).when(name == "Write", X.line_count(i["content"])).when(name == "MultiEdit", edits("new_string"))
             .when(name == "NotebookEdit", X.line_count(i["new_source"])).otherwise(zero))
    removed = F.when(name == "Edit", old).when(name == "MultiEdit", edits("old_string")).otherwise(zero)
    step = lambda x: X.strip_blank(F.coalesce(F.when(x.startswith("{"), first_of(F.get_json_object(x, "$.content"), F.get_json_object(x, "$.step"))).otherwise(x), F.lit("")))
    persist = first_of(*[i[k] for k in ("memory_id", "topic_key", "id", "entity", "name")])
    t = t.select(
        "*", F.when(F.col("server").isNotNull(), T.mcp_subcategory(F.col("server"), F.col("mcp_tool"))).alias("subcategory"), added.alias("added"), removed.alias("removed"),
        P.join_cwd(F.col("cwd"), F.col("target")).alias("abs_target"), (is_bash & X.runs_tests(cmd)).alias("runs_tests"),
        (is_bash & X.runs_knowledge(cmd)).alias("runs_knowledge"), (is_bash & X.writes_file(cmd)).alias("shell_write"),
        (is_bash & cmd.contains("git commit")).alias("is_commit"), F.when(shell, X.cli_heads(cmd)).alias("clis"),
        name.isin(dims.WRITE_TOOLS).alias("is_write"),
        F.filter(F.transform("raw_steps", step), lambda s: s != "").alias("steps"),
        F.when(name.isin("Edit", "Write", "MultiEdit"), P.forward(non_empty(i["file_path"]))).when(
            name == "NotebookEdit", P.forward(non_empty(i["notebook_path"]))).alias("edit_path"),
        F.when(is_bash, P.skills_in_command(cmd)).alias("shell_skills"),
        F.when(name == "Skill", non_empty(i["skill"])).when(name == "Read", P.skill_of_path(i["file_path"])).alias("own_skill"),
        F.coalesce(persist, F.concat("server", F.lit(":"), F.lower("mcp_tool"))).alias("persist_id"))
    sub = F.col("subcategory")
    has_server = F.col("server").isNotNull()
    knowledge_mcp = has_server & T.grounds_context(sub, cat)
    agent_type = F.when(name == "Agent", F.col("subagent_type"))
    discrete = F.concat(F.filter(F.array("own_skill"), lambda s: s.isNotNull()),
                        F.when(F.col("source") != "claude", F.coalesce("shell_skills", F.array().cast("array<string>"))).otherwise(F.array().cast("array<string>")))
    t = t.select(
        "*", F.when(F.col("abs_target") == "", "other").otherwise(P.change_target(F.col("abs_target"))).alias("file_class"), discrete.alias("discrete_skills"),
        (knowledge_mcp | F.col("runs_knowledge")).alias("knowledge"),
        (F.coalesce(T.is_plan_skill(F.when(name == "Skill", i["skill"])), F.lit(False)) | F.coalesce(T.is_plan_skill(agent_type), F.lit(False))
         ).alias("plan_dispatch"),
        F.coalesce(T.is_knowledge_write(F.col("server"), F.col("mcp_tool"), sub), F.lit(False)).alias("knowledge_write"),
        (F.col("is_write") & P.is_compounding(F.col("edit_path"))).alias("compounding"))
    skill_arm = F.exists("discrete_skills", lambda s: T.is_knowledge_skill(s)) | (F.col("dispatch") & T.is_knowledge_skill(F.col("subagent_type")))
    plan_any = (F.col("plan_dispatch") | F.coalesce(T.is_plan_skill(F.col("attribution_skill")), F.lit(False))
                | F.exists(F.coalesce("shell_skills", F.array().cast("array<string>")), lambda s: T.is_plan_skill(s)))
    plan_signal = (F.exists("discrete_skills", lambda s: T.is_plan_skill(s)) | (F.col("dispatch") & T.is_plan_skill(F.col("subagent_type"))))
    return t.select(
        *KEY, "block_pos", "ts", "month", "session_id", "agent_id", "uuid", "cwd", "is_sidechain", "model", "name", "tool_use_id", "category",
        "substantive", "is_mcp", "server", "subcategory", "target", "abs_target", "file_class", "is_write", "added", "removed", "dispatch",
        "subagent_type", "plan_dispatch", "runs_tests", "is_commit", "clis", "shell_write", "cmd", "knowledge", "knowledge_write", "persist_id",
        "compounding", "edit_path", "discrete_skills", "steps", "plan_creditable", "synth_ts",
        F.when(F.col("is_write"), F.col("added") + F.col("removed")).alias("loc"),
        ((F.col("file_class") != "other") & P.is_plan_file(F.col("abs_target"))).alias("plan_file"),
        plan_any.alias("plan_skill"), (F.col("knowledge") | skill_arm).alias("arms"),
        (plan_signal | name.isin(dims.PLAN_SIGNAL_TOOLS)).alias("plan_signal"), (plan_signal | name.isin(dims.PLAN_MODE_TOOLS)).alias("plan_strong"),
        F.coalesce(~i["run_in_background"].isin("", "false", "0", "null"), F.lit(False)).alias("background"),
        X.newline_count(cmd).alias("cmd_newlines"), i["_routing_identity"].alias("routing_identity"), i["_routing_turn_id"].alias("routing_turn_id"))


def tool_results(b: DataFrame) -> DataFrame:
    r = b.filter("type = 'user'").select(*KEY, "ts", "month", "session_id", "uuid", "tool_meta", F.posexplode("content").alias("block_pos", "c"))
    return r.filter("c.type = 'tool_result'").select(
        *KEY, "block_pos", "ts", "month", "session_id", "tool_meta", F.col("c.tool_use_id").alias("tool_use_id"),
        F.col("c.is_error").alias("is_error"), F.coalesce("c.error_flag", F.lit(False)).alias("error_flag"))


def recovered(calls: DataFrame, results: DataFrame) -> DataFrame:
    """Tool calls that come right after an unrecovered error of the same file and session."""
    cols = [*THREAD, "month", "ordinal", "sub", "block_pos"]
    err = results.filter("error_flag and session_id is not null").select(*cols, F.lit(True).alias("err"))
    use = calls.filter("session_id is not null").select(*cols, F.lit(False).alias("err"))
    return S.fires_after(err.unionByName(use), THREAD, ORDER, chunk(), F.col("err"), ~F.col("err"))


def grounding_rows(b: DataFrame, calls: DataFrame) -> DataFrame:
    """Rows that arm grounding and writes that consume it, per file and session."""
    cols = [*THREAD, "month", "ordinal", "sub", "block_pos"]
    turn_arm = F.exists(F.coalesce("injected_skills", F.array().cast("array<string>")), lambda s: T.is_knowledge_skill(s)) | (
        (F.col("type") == "assistant") & F.coalesce(T.is_knowledge_skill(F.col("attribution_skill")), F.lit(False)))
    turns = b.filter(turn_arm & F.col("session_id").isNotNull()).select(
        *THREAD, "month", "ordinal", "sub", F.lit(-1).alias("block_pos"), F.lit(True).alias("arm"), F.lit(False).alias("write"))
    use = calls.filter("(arms or is_write) and session_id is not null").select(*cols, F.col("arms").alias("arm"), F.col("is_write").alias("write"))
    return turns.unionByName(use)


def grounded(rows: DataFrame) -> DataFrame:
    return S.fires_after(rows, THREAD, ORDER, chunk(), F.col("arm"), F.col("write")).select(*SESSION, "month")


def edit_runs(calls: DataFrame) -> DataFrame:
    """Edits of one path between two commits of a file's session: (…, depth, month)."""
    rows = calls.filter("session_id is not null and (edit_path is not null or is_commit)")
    return S.edit_runs(rows.select(*THREAD, *ORDER, "month", "edit_path", "is_commit"), THREAD, ORDER, chunk(), F.col("is_commit"), "edit_path", "month")


def skill_uses(b: DataFrame, calls: DataFrame) -> DataFrame:
    """Credited skill uses: discrete sites each, attributed spans once when nothing claims them."""
    cols = ["tenant_id", "source", "span", "skill", "month", "at"]
    span = F.coalesce(F.when(F.col("session_id") != "", F.col("session_id")), F.col("file_path")).alias("span")
    at = F.struct("file_path", "ordinal").alias("at")
    d1 = calls.select("tenant_id", "source", span, F.explode("discrete_skills").alias("skill"), "month", at)
    d2 = b.filter("injected_skills is not null").select("tenant_id", "source", span, F.explode("injected_skills").alias("skill"), "month", at).filter("skill <> ''")
    turn = b.filter("type = 'assistant' and attribution_skill is not null").select("tenant_id", "source", span, F.col("attribution_skill").alias("skill"), "month", at)
    return A.span_dedup(d1.select(*cols).unionByName(d2.select(*cols)), turn.select(*cols), ["tenant_id", "source"], ["span"], "skill", F.col("at"), ["month", "at"])


def workflow_credits(b: DataFrame) -> DataFrame:
    """One dispatch per (parent session, child) with at least one event, in its first month."""
    parent, agent = P.workflow_parent(F.col("file_path")), P.workflow_agent(F.col("file_path"))
    w = b.withColumn("parent", parent).filter("parent is not null").withColumn("child", F.coalesce(non_empty(F.col("agent_id")), agent))
    return w.groupBy("tenant_id", "source", "parent", "child").agg(
        F.min_by("month", F.struct("file_path", "ordinal", "sub")).alias("month")).withColumnRenamed("parent", "session_id")


def outcomes(results: DataFrame) -> DataFrame:
    return J.sticky_outcomes(results.filter("tool_use_id is not null"), [*SESSION, "tool_use_id"], "is_error")
