"""Scoring inputs: one wide row per (tenant, source or all, month or window)."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace import dims
from loomtrace.functions import tools as T
from loomtrace.operators import aggregates as A, sequence as S
from loomtrace.plans import facts as FX, ordered as O, routing as RT
from loomtrace.plans.tables import materialize

GRAIN = ["tenant_id", "g_source", "g_month"]
CATEGORIES = ["produce", "plan", "explore", "execute", "delegate", "ask", "mcp", "other"]


def at_grains(df: DataFrame, month: str | None = "month") -> DataFrame:
    """Every row at the four grains it belongs to; '*' stands for all sources or the window.

    Apply to pre-aggregated rows only: it multiplies them by four.
    """
    star = F.lit("*")
    grains = [F.struct(star.alias("s"), star.alias("m")), F.struct(F.col("source").alias("s"), star.alias("m"))]
    if month:
        grains += [F.struct(star.alias("s"), F.col(month).alias("m")), F.struct(F.col("source").alias("s"), F.col(month).alias("m"))]
    return (df.withColumn("__g", F.explode(F.array(*grains))).withColumn("g_source", F.col("__g.s")).withColumn("g_month", F.col("__g.m"))
            .drop("__g").filter("g_month is not null"))


def _plan_event() -> Column:
    """The event names a planning skill: by its attribution or by an injected skill."""
    turn = T.is_plan_skill(F.col("attribution_skill")) & (F.col("type") == "assistant")
    injected = F.exists(F.coalesce("injected_skills", F.array().cast("array<string>")), lambda s: T.is_plan_skill(s))
    return F.coalesce(turn | injected, F.lit(False))


def session_months(b: DataFrame, prompts: DataFrame, calls: DataFrame, results: DataFrame, grounded: DataFrame,
                   grounding: DataFrame, recovered: DataFrame, credits: DataFrame) -> DataFrame:
    """Additive counters per (tenant, source, session, month), built by one union.

    Every contribution is partially aggregated where it is read, so a hot session or tenant
    sends a handful of rows into the shuffle, not its events. All columns are plain sums: they are
    aggregated by hash, no wide row is sorted (positions of plan credits: `late_credits`).
    """
    key = ["tenant_id", "source", "session_id", "month"]
    n = lambda c: A.count_if(c)
    blocks = lambda kind: F.coalesce(F.size(F.filter("content", lambda x: x["type"] == kind)), F.lit(0))
    assistant = F.col("type") == "assistant"
    errors = F.coalesce(F.size(F.filter("content", lambda x: (x["type"] == "tool_result") & F.coalesce(x["error_flag"], F.lit(False)))), F.lit(0))
    dispatches = F.coalesce(F.size(F.filter("content", lambda x: (x["type"] == "tool_use") & x["name"].isin(dims.DELEGATE_TOOLS))), F.lit(0))
    plan_event = _plan_event()
    ev = b.groupBy(*key).agg(
        F.count(F.lit(1)).alias("events"), n(assistant & ~F.col("is_usage_only")).alias("assistant_turns"),
        F.sum(F.when(assistant, blocks("thinking")).otherwise(0)).alias("thinking_blocks"),
        F.sum(F.when(F.col("type") == "user", errors).otherwise(0)).alias("tool_errors"),
        F.sum(F.col("api_error").cast("int") + F.col("retry").cast("int")).alias("api_errors"),
        n(assistant & (dispatches >= 2)).alias("parallel_turns"),
        n(F.col("ts").isNotNull()).alias("dated"), n(F.col("ts").isNotNull() & ~F.col("synth_ts")).alias("dated_real"),
        n(F.col("plan_eligible")).alias("plan_eligible"), n(F.col("plan_unmeasured")).alias("plan_unmeasured"),
        n(plan_event).alias("plan_marks"), n(plan_event & F.col("plan_creditable") & ~F.col("synth_ts")).alias("plan_credit"))
    pr = prompts.groupBy(*key).agg(n(~F.col("bare_command")).alias("prompts"), n(F.col("bare_command")).alias("commands_only"),
                                   n(F.col("is_command")).alias("commands"), n(F.col("polite")).alias("polite_prompts"))
    cl = calls.groupBy(*key).agg(
        F.count(F.lit(1)).alias("tool_calls"), n(F.coalesce("is_sidechain", F.lit(False))).alias("sidechain_calls"),
        *[n(F.col("category") == c).alias(f"cat_{c}") for c in CATEGORIES], n(F.col("plan_dispatch")).alias("planning_dispatch"),
        n(F.col("is_mcp")).alias("mcp_calls"), F.sum("added").alias("lines_added"), F.sum("removed").alias("lines_removed"),
        F.sum(F.when(F.col("name") != "NotebookEdit", F.col("added") + F.col("removed")).otherwise(0)).alias("churn_no_notebook"),
        n(F.col("shell_write")).alias("shell_writes"), F.sum(F.when(F.col("shell_write"), F.col("cmd_newlines")).otherwise(0)).alias("shell_lines"),
        n(F.col("runs_tests")).alias("test_runs"), n(F.col("is_commit")).alias("commits"), n(F.col("compounding")).alias("compounding"),
        n(F.col("name").isin(dims.ASK_TOOLS)).alias("questions"), n(F.col("background")).alias("background"),
        n(F.col("name").isin(dims.SCHEDULE_TOOLS)).alias("scheduled"), n(F.col("is_write")).alias("writes"),
        n(F.col("dispatch") & ~F.col("name").isin(dims.TRANSCRIPT_FANOUT_TOOLS)).alias("dispatches"),
        n((F.col("category") == "delegate") & T.cannot_label(F.col("source"))).alias("unlabelled"), n(F.col("ts").isNull()).alias("undated_calls"),
        n(F.col("plan_signal")).alias("plan_marks"), n(F.col("plan_strong") & F.col("plan_creditable") & ~F.col("synth_ts")).alias("plan_credit"))
    gr = grounded.groupBy(*key).agg(F.count(F.lit(1)).alias("grounded"))
    rc = recovered.groupBy(*key).agg(F.count(F.lit(1)).alias("recovered"))
    wf = credits.groupBy(*key).agg(F.count(F.lit(1)).alias("dispatches"))
    kw = (calls.filter("knowledge_write and session_id is not null").groupBy("tenant_id", "source", "session_id", "persist_id")
          .agg(F.min_by("month", F.struct("file_path", "ordinal", "sub", "block_pos")).alias("month"))
          .groupBy(*key).agg(F.count(F.lit(1)).alias("compounding")))
    parts = [ev, pr, cl, gr, rc, wf, kw]
    names: dict[str, str] = {}
    for p in parts:
        for c in p.columns:
            if c not in key:
                names.setdefault(c, c)
    union = reduce(lambda a, c: a.unionByName(c, allowMissingColumns=True), parts)
    return union.groupBy(*key).agg(*[F.coalesce(F.sum(c), F.lit(0)).cast("bigint").alias(c) for c in names])


def late_credits(b: DataFrame, calls: DataFrame, sm: DataFrame, work: str) -> DataFrame:
    """Eligible sessions per grain that only a plan mark with a synthetic time credits: one after the first eligible event.

    Marks with synthetic times are written first; positions are compared in their sessions alone.
    """
    key = ["tenant_id", "source", "session_id", "month"]
    at = F.struct("file_path", "ordinal")
    synth = F.col("plan_creditable") & F.col("synth_ts") & F.col("session_id").isNotNull()
    marks = b.filter(_plan_event() & synth).select(*key, at.alias("mark")).unionByName(calls.filter(F.col("plan_strong") & synth).select(*key, at.alias("mark")))
    marks = materialize(marks.groupBy(*key).agg(F.max("mark").alias("mark")), f"{work}/late_marks")
    owners = marks.select(*FX.SESSION).distinct()
    first = S.join_keys(b.filter("plan_eligible").select(*key, at.alias("first")), owners, FX.SESSION, "left_semi")
    credit = S.join_keys(sm.select(*key, "plan_credit"), owners, FX.SESSION, "left_semi")
    rows = marks.unionByName(first, True).unionByName(credit, True)
    per = rows.groupBy(*key).agg(F.max("mark").alias("mark"), F.min("first").alias("first"), F.sum("plan_credit").alias("plan_credit"))
    p = at_grains(per.repartition("tenant_id", "session_id")).groupBy(*GRAIN, "source", "session_id").agg(F.max("mark").alias("mark"), F.min("first").alias("first"), F.sum("plan_credit").alias("c"))
    return p.filter("coalesce(c, 0) = 0 and mark > first").groupBy(*GRAIN).agg(F.count(F.lit(1)).alias("late_sessions"))


SUMS = (["events", "assistant_turns", "thinking_blocks", "tool_errors", "recovered", "api_errors", "parallel_turns", "prompts", "commands_only", "commands",
         "polite_prompts", "tool_calls", "sidechain_calls", "planning_dispatch", "mcp_calls", "lines_added", "lines_removed", "churn_no_notebook",
         "shell_writes", "shell_lines", "test_runs", "commits", "compounding", "questions", "background", "scheduled", "unlabelled", "undated_calls"]
        + [f"cat_{c}" for c in CATEGORIES])


def counters(sm: DataFrame, late: DataFrame) -> DataFrame:
    """Sums, session counts and planning sets at every grain; `late` are the rows of `late_credits`.

    Sums are taken per (tenant, source, month) before they go to the grains. Sessions are dealt out by
    (tenant, session) once, as single rows: the rows of all four grains stay where they are made.
    """
    per = sm.groupBy("tenant_id", "source", "month").agg(*[F.sum(c).cast("bigint").alias(c) for c in SUMS])
    sums = at_grains(per).groupBy(*GRAIN).agg(*[F.sum(c).cast("bigint").alias(c) for c in SUMS], F.sort_array(F.collect_set("source")).alias("sources"))
    held = ["dated", "dated_real", "plan_marks", "grounded", "writes", "dispatches", "plan_eligible", "plan_unmeasured", "plan_credit"]
    own = sm.filter("session_id is not null").select("tenant_id", "source", "session_id", "month", *held)
    g = at_grains(own.repartition("tenant_id", "session_id"))
    # planning sets are keyed by (source, session)
    p = g.groupBy(*GRAIN, "source", "session_id").agg(*[F.sum(c).alias(c) for c in held])
    plan = p.groupBy(*GRAIN).agg(A.count_if((F.col("plan_eligible") > 0) & (F.col("plan_credit") > 0)).alias("planning_sessions"),
                                 A.count_if(F.col("plan_eligible") > 0).alias("planning_eligible"),
                                 A.count_if((F.col("plan_unmeasured") > 0) & (F.col("plan_eligible") == 0)).alias("planning_unmeasured"))
    plan = S.join_keys(plan, late, GRAIN).withColumn("planning_sessions", F.col("planning_sessions") + F.coalesce("late_sessions", F.lit(0))).drop("late_sessions")
    # sets of bare session ids
    s = p.groupBy(*GRAIN, "session_id").agg(*[F.sum(c).alias(c) for c in held[:6]])
    window = F.col("g_month") == "*"
    counted = F.when(window, F.col("dated_real") > 0).otherwise(F.col("dated") > 0)
    s = s.withColumn("counted", counted)
    sess = s.groupBy(*GRAIN).agg(
        A.count_if(F.col("counted")).alias("n_counted"), F.count(F.lit(1)).alias("n_files"),
        *[A.count_if(F.col("counted") & (F.col(c) > 0)).alias(f"c_{c}") for c in ("plan_marks", "grounded", "writes")],
        *[A.count_if(F.col(c) > 0).alias(f"a_{c}") for c in ("plan_marks", "grounded", "writes")])
    fallback = window & (F.col("n_counted") == 0)
    pick = lambda c, out: F.when(fallback, F.least(f"a_{c}", "n_files")).otherwise(F.col(f"c_{c}")).alias(out)
    sess = sess.select(*GRAIN, F.when(fallback, F.col("n_files")).otherwise(F.col("n_counted")).alias("total_sessions"),
                       pick("plan_marks", "plan_sessions"), pick("grounded", "grounded_sessions"), pick("writes", "write_sessions"),
                       fallback.alias("plan_sessions_degraded"))
    fan = A.fanout_stats(s.filter("dispatches > 0"), GRAIN, ["session_id"], F.col("dispatches"))
    out = sums
    for part in (sess, fan, plan):
        out = S.join_keys(out, part, GRAIN)
    return out


def name_counts(b: DataFrame, calls: DataFrame, skills: DataFrame) -> DataFrame:
    """Uses per (tenant, source, month, kind, name) with first appearance; one shuffle for all kinds."""
    at = F.struct("file_path", "ordinal", "sub", "block_pos")
    pair = lambda k, c: F.struct(F.lit(k).alias("kind"), c.cast("string").alias("name"))
    item = F.concat(
        F.array(pair("tool", F.col("name")), pair("subagent", F.when(F.col("dispatch"), F.col("subagent_type"))), pair("server", F.col("server")),
                pair("subcategory", F.when(F.col("server").isNotNull(), F.col("subcategory"))),
                pair("knowledge_server", F.when(F.col("subcategory") == "knowledge", F.col("server")))),
        F.transform(F.coalesce("clis", F.array().cast("array<string>")), lambda c: F.struct(F.lit("cli").alias("kind"), c.alias("name"))))
    use = calls.select("tenant_id", "source", "month", F.explode(item).alias("x"), at.alias("at"))
    models = b.filter("type = 'assistant' and model is not null and not is_usage_only").select(
        "tenant_id", "source", "month", pair("model", F.col("model")).alias("x"), F.struct("file_path", "ordinal", "sub", F.lit(0).alias("block_pos")).alias("at"))
    projects = b.filter("cwd <> ''").select("tenant_id", "source", "month", pair("project", F.col("cwd")).alias("x"),
                                            F.struct("file_path", "ordinal", "sub", F.lit(0).alias("block_pos")).alias("at"))
    sk = skills.select("tenant_id", "source", "month", pair("skill", F.col("skill")).alias("x"),
                       F.struct(F.col("at.file_path"), F.col("at.ordinal"), F.lit(0).alias("sub"), F.lit(0).alias("block_pos")).alias("at"))
    rows = use.unionByName(models).unionByName(projects).unionByName(sk).filter("x.name is not null")
    return rows.groupBy("tenant_id", "source", "month", F.col("x.kind").alias("kind"), F.col("x.name").alias("name")).agg(
        F.count(F.lit(1)).alias("n"), F.min("at").alias("first_seen"))


def names_at_grains(names: DataFrame) -> DataFrame:
    return at_grains(names).groupBy(*GRAIN, "kind", "name").agg(F.sum("n").alias("n"), F.min("first_seen").alias("first_seen"))


def name_measures(ng: DataFrame) -> DataFrame:
    """Distinct names, entropy, mixes and needle counts per grain."""
    k = lambda kind: F.col("kind") == kind
    nlogn = F.col("n") * F.log2(F.col("n").cast("double"))
    n, low = F.col("n"), F.lower("name")
    skill_n = lambda cond: F.coalesce(F.sum(F.when(k("skill") & cond, n)), F.lit(0)).cast("bigint")
    model_ok = k("model")
    g = ng.groupBy(*GRAIN).agg(
        *[A.count_if(k(kind)).alias(f"{kind}_distinct") for kind in ("tool", "skill", "subagent", "server", "cli", "model", "knowledge_server")],
        *[F.coalesce(F.sum(F.when(k(kind), n)), F.lit(0)).cast("bigint").alias(f"{kind}_total") for kind in ("skill", "cli", "model", "tool")],
        F.sum(F.when(k("tool"), nlogn)).alias("nlogn"), F.coalesce(F.max(F.when(model_ok, n)), F.lit(0)).cast("bigint").alias("model_top"),
        *[F.coalesce(F.sum(F.when(k("tool") & (F.col("name") == t), n)), F.lit(0)).cast("bigint").alias(c)
          for t, c in (("ToolSearch", "toolsearch_calls"), ("TaskCreate", "task_create"), ("TaskUpdate", "task_update"), ("Agent", "agent_calls"))],
        F.coalesce(F.sum(F.when(k("subcategory") & (F.col("name") == "knowledge"), n)), F.lit(0)).cast("bigint").alias("knowledge_calls"),
        skill_n(T.is_review_skill(F.col("name"))).alias("review_skills"), skill_n(T.contains_any(low, dims.QUALITY_SKILL_NEEDLES)).alias("quality_skills"),
        skill_n(T.contains_any(low, ["test", "tdd", "qa"])).alias("test_skills"), skill_n(T.contains_any(low, ["qa", "investigate", "retro"])).alias("back_skills"),
        skill_n(T.is_task_skill(F.col("name"))).alias("task_skills"),
        (skill_n(T.contains_any(low, dims.PROCESS_SKILL_NEEDLES)) > 0).alias("process_skills"),
        (skill_n(T.contains_any(low, dims.COMPOUNDING_SKILL_NEEDLES)) > 0).alias("compounding_skills"),
        F.min_by(F.when(k("tool"), F.col("name")), F.when(k("tool"), F.struct((-n).alias("n"), "first_seen"))).alias("top_tool"))  # equal counts: first seen
    h = F.log2(F.col("tool_total").cast("double")) - F.col("nlogn") / F.col("tool_total")
    return g.withColumn("tool_entropy", F.when(F.col("tool_distinct") > 1, h / F.log2(F.col("tool_distinct").cast("double"))).otherwise(0.0)).withColumn(
        "task_tool_calls", F.col("task_create") + F.col("task_update")).drop("nlogn", "task_create", "task_update")


def scoreable_models(names: DataFrame) -> DataFrame:
    """Models from sources where the choice of model is scoreable: distinct, total, most used."""
    ok = names.filter("kind = 'model'").filter(F.array_contains(T.source_caps(F.col("source")), "model"))
    m = names_at_grains(ok)
    return m.groupBy(*GRAIN).agg(F.count(F.lit(1)).alias("scored_models"), F.sum("n").alias("scored_turns"), F.max("n").alias("scored_top"))


def session_types(calls: DataFrame) -> DataFrame:
    """Most distinct subagent types of one session, per grain."""
    d = calls.filter("dispatch and session_id is not null").select("tenant_id", "source", "session_id", "month", "subagent_type").distinct()
    g = at_grains(d).select(*GRAIN, "session_id", "subagent_type").distinct().groupBy(*GRAIN, "session_id").agg(F.count(F.lit(1)).alias("n"))
    return g.groupBy(*GRAIN).agg(F.max("n").alias("max_session_types"))


def activity(b: DataFrame) -> DataFrame:
    """Active hours, longest run, mean and median session minutes per grain."""
    real = b.filter("ts is not null and not synth_ts and session_id is not null")
    base = S.activity_buckets(real, ["tenant_id", "source", "month", "session_id"], "ts", dims.GAP_CAP_S)
    # dealt out once, as single rows: a session's buckets at all grains are merged and walked in one place
    g = S.merge_buckets(at_grains(base.repartition("tenant_id", "session_id")), GRAIN + ["session_id"])
    union = S.union_of_buckets(g, GRAIN, ["session_id"], dims.GAP_CAP_S).select(*GRAIN, (F.col("active_s") / 3600.0).alias("active_hours"))
    burst = S.burst_of_buckets(g, GRAIN, ["session_id"], dims.BURST_GAP_S).select(*GRAIN, (F.col("longest_s") / 60.0).alias("longest_run_min"))
    per = S.duration_of_buckets(g.filter("g_month = '*'"), GRAIN + ["session_id"], dims.GAP_CAP_S)
    # the median comes from a histogram of microseconds: no task holds all sessions of a grain
    hist = per.filter("active_s is not null").groupBy(*GRAIN, F.round(F.col("active_s") * 1e6).cast("bigint").alias("us")).agg(F.count(F.lit(1)).alias("n"), F.sum("active_s").alias("s"))
    mins = A.depth_histogram_stats(hist, GRAIN, "us", "n").select(*GRAIN, (F.col("median") / 60e6).alias("median_session_min"))
    mins = S.join_keys(hist.groupBy(*GRAIN).agg((F.sum("s") / F.sum("n") / 60).alias("avg_session_min")), mins, GRAIN)
    return S.join_keys(S.join_keys(union, burst, GRAIN), mins, GRAIN)


def depths(runs: DataFrame) -> DataFrame:
    hist = at_grains(runs.groupBy("tenant_id", "source", "month", "depth").agg(F.count(F.lit(1)).alias("n"))).groupBy(*GRAIN, "depth").agg(F.sum("n").alias("n"))
    d = A.depth_histogram_stats(hist, GRAIN, "depth", "n")
    return d.select(*GRAIN, F.col("mean").alias("depth_mean"), F.col("median").alias("depth_median"), F.col("p90").alias("depth_p90"),
                    F.col("max").alias("depth_max"), F.col("heavy").alias("heavy_files"))


def prompt_lengths(prompts: DataFrame) -> DataFrame:
    p = prompts.filter("not bare_command").groupBy("tenant_id", "source", "month", "n_chars").agg(F.count(F.lit(1)).alias("n"))
    hist = at_grains(p).groupBy(*GRAIN, "n_chars").agg(F.sum("n").alias("n"))
    d = A.depth_histogram_stats(hist, GRAIN, "n_chars", "n")
    return d.select(*GRAIN, F.col("mean").alias("prompt_len_mean"), F.col("median").alias("prompt_len_median"))


def days(b: DataFrame) -> DataFrame:
    d = b.filter("ts is not null").groupBy("tenant_id", "source", "month", F.to_date("ts").alias("day")).agg(
        F.min("ts").alias("lo"), F.max("ts").alias("hi"))
    g = at_grains(d).groupBy(*GRAIN, "day").agg(F.min("lo").alias("lo"), F.max("hi").alias("hi"))
    span = F.floor((F.unix_micros(F.max("hi")) - F.unix_micros(F.min("lo"))) / F.lit(86_400 * S.US)) + 1
    return g.groupBy(*GRAIN).agg(F.count(F.lit(1)).alias("active_days"), F.min("lo").alias("first_ts"), F.max("hi").alias("last_ts"), span.cast("bigint").alias("span_days"))


def ordered_counts(calls: DataFrame, results: DataFrame, sm: DataFrame, work: str) -> DataFrame:
    """Eligible, planned, evidence, tested and orchestratable sessions per grain.

    Month grains use only that month's calls of a session, so they are derived on their own
    and are not a roll-up of the window facts.
    """
    out = FX.outcomes(results)
    win, art = (materialize(d, f"{work}/ordered_window_{i}") for i, d in enumerate(O.session_facts(calls, out, work=work)))
    mon, mart = (materialize(d, f"{work}/ordered_month_{i}") for i, d in enumerate(O.session_facts(calls, out, ["month"], work)))
    none = F.lit(None).cast("string").alias("month")

    def grains(w: DataFrame, m: DataFrame) -> DataFrame:
        a = at_grains(w.select("*", none), None).drop("month")
        b = at_grains(m, "month").filter("g_month <> '*'").drop("month")
        return a.unionByName(b)

    s = materialize(grains(win, mon), f"{work}/ordered_sessions")
    s = materialize(O.credit_plans(s, grains(art, mart), GRAIN, work), f"{work}/ordered_credited")
    disp = at_grains(sm.filter("dispatches > 0 and session_id is not null").select("tenant_id", "source", "month", "session_id")).select(
        *GRAIN, "session_id").distinct().withColumn("delegated", F.lit(True))
    base = s.groupBy(*GRAIN).agg(
        A.count_if(F.col("eligible")).alias("eligible"), A.count_if(F.col("planned")).alias("planned"),
        A.count_if(F.col("eligible") & F.col("evidence_before")).alias("evidence"), A.count_if(F.col("eligible") & F.col("ran_test")).alias("test_covered"),
        A.count_if(F.col("orchestratable")).alias("orchestratable"))
    # delegation is matched on bare session ids
    o = s.filter("orchestratable").select(*GRAIN, "session_id").distinct()
    o = S.join_keys(o, disp, GRAIN + ["session_id"]).groupBy(*GRAIN).agg(F.count("delegated").alias("delegated_orchestratable"))
    return S.join_keys(base, o, GRAIN)


def git_at_grains(repos: DataFrame) -> DataFrame:
    """Repository totals (tenant_id, repos_seen, …) join the window grain of all sources."""
    return repos.select("tenant_id", F.lit("*").alias("g_source"), F.lit("*").alias("g_month"),
                        *[F.col(c).alias(f"git_{c}") for c in ("repos_seen", "repos_with_commits", "insertions", "deletions", "churn", "commits")])


def scoring_inputs(events: DataFrame, work: str, git: DataFrame | None = None) -> DataFrame:
    """The wide table of everything the scores read, unrounded; fact tables are written below `work`."""
    b = materialize(FX.base(events), f"{work}/base")
    calls = materialize(FX.tool_calls(b), f"{work}/tool_calls")
    results = materialize(FX.tool_results(b), f"{work}/tool_results")
    prompts = materialize(FX.prompts(b), f"{work}/prompts")
    ground = FX.grounding_rows(b, calls)
    credits = FX.workflow_credits(b)
    sm = materialize(session_months(b, prompts, calls, results, FX.grounded(ground), ground, FX.recovered(calls, results), credits), f"{work}/session_months")
    names = materialize(name_counts(b, calls, FX.skill_uses(b, calls)), f"{work}/name_counts")
    p1, k1 = RT.attempt_pairs(b, calls, results, credits)
    p2, k2 = RT.linked_spawns(b, calls, work)
    routing = RT.routing_measure(p1.unionByName(p2), k1.unionByName(k2), sm.select("tenant_id", "source").distinct()).withColumn("g_month", F.lit("*"))
    parts = [counters(sm, late_credits(b, calls, sm, work)), name_measures(names_at_grains(names)), scoreable_models(names), session_types(calls), activity(b),
             depths(FX.edit_runs(calls)), prompt_lengths(prompts), days(b), ordered_counts(calls, results, sm, work), routing]
    if git is not None:
        parts.append(git_at_grains(git))
    written = [materialize(p, f"{work}/part_{i}") for i, p in enumerate(parts)]
    wide = written[0]
    for p in written[1:]:
        wide = S.join_keys(wide, p, GRAIN)
    return materialize(finish(wide), f"{work}/scoring_inputs")


ZERO_WHEN_ABSENT = [
    "tool_distinct", "skill_distinct", "subagent_distinct", "server_distinct", "cli_distinct", "model_distinct", "knowledge_server_distinct", "skill_total", "cli_total",
    "model_total", "model_top", "toolsearch_calls", "agent_calls", "task_tool_calls", "knowledge_calls", "review_skills", "quality_skills", "test_skills", "back_skills",
    "task_skills", "tool_entropy", "scored_models", "scored_turns", "scored_top", "max_session_types", "active_hours", "longest_run_min", "eligible", "planned", "evidence",
    "test_covered", "orchestratable", "delegated_orchestratable", "delegating_sessions", "max_session_fanout", "parallel_session_share", "planning_sessions",
    "planning_eligible", "planning_unmeasured", "total_sessions", "plan_sessions", "grounded_sessions", "write_sessions", "active_days", "prompt_len_mean", "prompt_len_median"]


def finish(wide: DataFrame) -> DataFrame:
    """Ratios and states on top of the counts; NULL means unmeasured, 0 a measured zero."""
    w = wide.select(*[F.coalesce(c, F.lit(0)).alias(c) if c in ZERO_WHEN_ABSENT else F.col(c) for c in wide.columns])
    w = w.select(*[F.coalesce(c, F.lit(False)).alias(c) if c in ("process_skills", "compounding_skills") else F.col(c) for c in w.columns])
    no_tool = F.col("tool_calls") == 0
    no_agents = F.forall("sources", lambda s: s.isin(dims.NO_AGENT_SOURCES))
    measured = lambda c: F.when(~no_tool, c)
    instr = F.col("prompts") + F.col("commands_only")
    raw = F.col("cat_produce") + F.col("cat_execute") + F.col("cat_delegate")
    doing = F.when(raw - F.col("planning_dispatch") > 0, raw - F.col("planning_dispatch")).otherwise(raw)
    explore = F.col("cat_explore") + F.col("thinking_blocks")
    div = lambda a, c: F.when(c > 0, a.cast("double") / c).otherwise(0.0)
    e, u = F.col("planning_eligible"), F.col("planning_unmeasured")
    state = F.when((e > 0) & (u == 0), "measured").when(e > 0, "partial").otherwise("unmeasured")
    window = F.col("g_month") == "*"
    w = w.select(
        "*", no_tool.alias("no_tool_activity"), T.union_caps(F.col("sources")).alias("caps"), instr.alias("instructions"), explore.alias("explore_actions"),
        doing.alias("doing_actions"), div(explore, doing).alias("planning_ratio"), div(F.col("tool_calls") - F.col("sidechain_calls"), instr).alias("actions_per_prompt"),
        measured(div(F.col("recovered"), F.col("tool_errors"))).alias("error_recovery_ratio"),
        measured(div(F.col("tool_errors") * 100, F.col("tool_calls"))).alias("error_rate_per_100"),
        F.when(no_tool | (no_agents & (F.col("delegating_sessions") == 0)), None).otherwise(F.coalesce("fanout_median", F.lit(0.0))).alias("fanout"),
        *[measured(F.coalesce(c, F.lit(0))).alias(f"m_{c}") for c in ("depth_mean", "depth_median", "depth_p90", "depth_max", "heavy_files")],
        F.when(window, F.col("lines_added") + F.col("lines_removed")).otherwise(F.col("churn_no_notebook")).alias("tool_churn"),
        state.alias("planning_state"), F.when(state != "unmeasured", F.col("planning_sessions") / e).alias("planning_share"),
        F.when(state != "unmeasured", e / (e + u)).alias("planning_coverage"),
        F.when((F.col("tool_calls") > 0) & (~window | (F.col("undated_calls") == 0)), "measured").otherwise("unmeasured").alias("ordered_state"),
        F.when(window & (F.col("unlabelled") > 0), "unmeasured").otherwise("measured").alias("sidechain_label_state"),
        F.when(window & (F.col("routing_state").isNotNull()), F.col("routing_state")).otherwise("unsupported").alias("routing"),
        (F.col("assistant_turns") > 0).alias("__turns"))
    hours = F.col("active_hours")
    return w.select(*[c for c in w.columns if c not in ("__turns", "fanout_median", "routing_state", "depth_mean", "depth_median", "depth_p90", "depth_max", "heavy_files")],
                    (F.col("__turns") & (F.col("model_distinct") == 0)).alias("model_signal_missing"),
                    F.when(hours > 0, F.col("tool_churn") / hours).otherwise(0.0).alias("lines_per_hour"))
