"""Scores combined over sources and over time, and replay of stored payloads."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace import dims
from loomtrace.functions.numbers import tier
from loomtrace.operators.aggregates import weighted_mean
from loomtrace.plans import score as SC


def united(per_source: DataFrame, names: DataFrame, owner: list[str], kind: str, count: str) -> DataFrame:
    """Distinct names of a kind per owner: a name that several sources share counts once.

    names: owner, g_source, kind, name. A source that lists no name adds its bare `count`, which
    cannot be compared with names. Names meet as distinct (owner, name) pairs, so an owner of any
    size is spread over its names.
    """
    named = names.filter((F.col("kind") == kind) & (F.col("name") != "")).select(*owner, "g_source", "name")
    union = named.select(*owner, "name").distinct().select(*owner, F.lit(1).cast("bigint").alias("n"))
    listed = named.select(*owner, "g_source", F.lit(True).alias("listed"), F.lit(0).cast("bigint").alias("n"))
    given = per_source.select(*owner, "g_source", F.lit(False).alias("listed"), F.coalesce(F.col(count), F.lit(0)).cast("bigint").alias("n"))
    bare = listed.unionByName(given).groupBy(*owner, "g_source").agg(F.max("listed").alias("listed"), F.sum("n").alias("n")).filter("not listed")
    return union.unionByName(bare.select(*owner, "n")).groupBy(*owner).agg(F.sum("n").alias(count))


def pooled_inputs(per_source: DataFrame, owner: list[str], names: DataFrame | None = None) -> DataFrame:
    """One synthetic row per owner from its sources.

    With `names` the knowledge servers of all sources are united by name instead.

    Counts add up, distinct counts take the largest source, ratios are weighted by tool
    calls, actions per prompt by its own denominator.  Planning is pooled over sources with
    sessions and is only valid when every one of them is valid.
    """
    w = F.col("tool_calls")
    live = F.col("total_sessions") > 0
    pe_ok = F.coalesce((F.col("planning_sessions") >= 0) & (F.col("planning_sessions") <= F.col("planning_eligible")), F.lit(False))
    sums = ["prompts", "instructions", "tool_calls", "tool_churn", "shell_lines", "active_hours", "questions", "cat_delegate", "background", "test_runs", "plan_sessions",
            "parallel_turns", "delegating_sessions", "m_heavy_files", "api_errors", "orchestratable", "delegated_orchestratable", "compounding", "skill_distinct", "skill_total",
            "cli_total", "mcp_calls", "toolsearch_calls", "knowledge_calls", "review_skills", "quality_skills", "test_skills", "back_skills", "agent_calls"]
    maxes = ["max_session_fanout", "m_depth_max", "subagent_distinct", "max_session_types", "server_distinct", "cli_distinct", "tool_distinct", "knowledge_server_distinct"]
    means = ["planning_ratio", "fanout", "parallel_session_share", "m_depth_mean", "m_depth_p90", "error_rate_per_100", "error_recovery_ratio", "tool_entropy"]
    g = per_source.groupBy(*owner).agg(
        *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in sums], *[F.coalesce(F.max(c), F.lit(0)).alias(c) for c in maxes],
        *[F.coalesce(weighted_mean(w, F.col(c)), F.lit(0.0)).alias(c) for c in means],
        F.coalesce(weighted_mean(F.col("instructions"), F.col("actions_per_prompt")), F.lit(0.0)).alias("actions_per_prompt"),
        *[F.coalesce(F.sum(F.when(live, F.col(c))), F.lit(0)).alias(c) for c in (
            "total_sessions", "thinking_blocks", "eligible", "planned", "evidence", "test_covered", "planning_sessions", "planning_eligible", "planning_unmeasured")],
        F.coalesce(F.min(F.when(live, pe_ok)), F.lit(False)).alias("__pe_ok"),
        F.when(F.coalesce(F.min(F.when(live, F.col("ordered_state") == "measured")), F.lit(False)), "measured").otherwise("unmeasured").alias("ordered_state"),
        F.when(F.max(F.col("sidechain_label_state") != "measured"), "unmeasured").otherwise("measured").alias("sidechain_label_state"),
        F.max("process_skills").alias("process_skills"), F.max("compounding_skills").alias("compounding_skills"), F.max_by("top_tool", w).alias("top_tool"),
        F.array_distinct(F.flatten(F.collect_list(F.when(live, F.col("caps"))))).alias("caps"), F.min("no_tool_activity").alias("no_tool_activity"),
        F.coalesce(F.sum("scored_models"), F.lit(0)).alias("scored_models"), F.sum("scored_turns").alias("scored_turns"), F.max("scored_top").alias("scored_top"),
        F.sum("routing_successful").alias("routing_successful"), F.sum("routing_eligible").alias("routing_eligible"), F.lit("unsupported").alias("routing"))
    for c in ("planning_sessions", "planning_eligible", "planning_unmeasured"):
        g = g.withColumn(c, F.when(F.col("__pe_ok"), F.col(c)).otherwise(0))
    if names is not None:
        g = g.drop("knowledge_server_distinct").join(united(per_source, names, owner, "knowledge", "knowledge_server_distinct"), owner, "left").fillna(0, ["knowledge_server_distinct"])
    e, u = F.col("planning_eligible"), F.col("planning_unmeasured")
    state = F.when((e > 0) & (u == 0), "measured").when(e > 0, "partial").otherwise("unmeasured")
    return g.withColumn("planning_state", state).withColumn("planning_share", F.when(e > 0, F.col("planning_sessions") / e)).withColumn(
        "planning_coverage", F.when(e > 0, e / (e + u))).drop("__pe_ok")


def aggregate_profile(per_source: DataFrame, owner: list[str]) -> DataFrame:
    """Owner score as tool-volume weighted mean of source scores; Planning is recomputed from
    the pooled row."""
    key = owner + ["g_source"]
    q = SC.quotient(per_source, key + ["tool_calls"])
    card = SC.scorecard(per_source, key + ["tool_calls"])
    w = F.col("tool_calls")
    total = q.groupBy(*owner).agg(F.bround(weighted_mean(w, F.col("quotient").cast("double")), 0).cast("int").alias("quotient"))
    pillars = q.select(*owner, "tool_calls", F.explode("pillars").alias("p")).groupBy(*owner, F.col("p.pillar").alias("pillar")).agg(
        F.bround(weighted_mean(w, F.col("p.score")), 1).alias("score")).groupBy(*owner).agg(
        F.map_from_entries(F.array_sort(F.collect_list(F.struct("pillar", "score")))).alias("pillar_scores"))
    axes = card.groupBy(*owner).agg(F.bround(weighted_mean(w, F.col("execution")), 1).alias("execution"), F.bround(weighted_mean(w, F.col("engineering")), 1).alias("engineering"))
    plan = SC.scorecard(pooled_inputs(per_source, owner), owner).select(*owner, "planning")
    out = reduce(lambda a, b: a.join(b, owner), [total, pillars, axes, plan])
    return out.withColumn("tier", tier(F.col("quotient"), dims.TIERS))


def blend(axes: DataFrame, owner: list[str]) -> DataFrame:
    """Blend weighted components of one owner axis by axis.

    axes: owner, component, configured_weight, pillar, pillar_weight, axis, axis_order,
    base_weight, normalized_score, and for the model axis distinct_models, offload_share,
    routing_state, routing_score.  A missing axis drops out of its own mean; an unmeasured
    routing term is left out, never read as zero.
    """
    w = F.col("configured_weight").cast("double")
    C = SC.C
    is_mix = F.col("axis") == "Model mix"
    routed = (F.col("routing_state") == "measured") & F.col("routing_score").isNotNull()
    a = axes.filter(F.col("configured_weight") > 0)
    g = a.groupBy(*owner, "pillar", "pillar_weight", "axis").agg(
        F.min("axis_order").alias("axis_order"), F.max_by("base_weight", F.struct(w, -F.col("component_order"))).alias("base_weight"),
        (F.sum(w * F.col("normalized_score")) / F.sum(w)).alias("mean"),
        (F.sum(w * F.least(F.lit(1.0), F.col("distinct_models") / float(C["MODELS_DISTINCT_CEILING"]))) / F.sum(w)).alias("d"),
        (F.sum(w * F.least(F.lit(1.0), F.col("offload_share") / C["OFFLOAD_SHARE_TARGET"])) / F.sum(w)).alias("o"),
        (F.sum(F.when(routed, w * F.col("routing_score"))) / F.sum(F.when(routed, w))).alias("r"),
        F.when(F.max(F.col("weight_scored").isNotNull()), F.bround(F.sum(w * F.coalesce("weight_scored", F.lit(1.0))) / F.sum(w), 4)).alias("weight_scored"))
    mix = F.when(F.col("r").isNull(), F.col("d") * .5 + F.col("o") * .5).otherwise(F.col("d") * .35 + F.col("o") * .35 + F.col("r") * .30)
    g = g.withColumn("value", F.greatest(F.lit(0.0), F.least(F.lit(1.0), F.when(is_mix, mix).otherwise(F.col("mean")))))
    # at most a dozen axes per owner, so one array per pillar is small by construction
    p = g.groupBy(*owner, "pillar", "pillar_weight").agg(F.array_sort(F.collect_list(F.struct(
        "axis_order", "pillar", "axis", F.col("base_weight").cast("int").alias("base_weight"), "value",
        F.lit(None).cast("struct<scored:int,total:int,weight_scored:double>").alias("partial_terms"), "weight_scored"))).alias("axes"))
    p = p.withColumn("weighed", SC.weigh(F.col("axes")))
    p = p.withColumn("score", F.bround(F.aggregate("weighed", F.lit(0.0), lambda s, x: s + x["score"]), 1))
    t = p.groupBy(*owner).agg(F.bround(F.sum(F.col("pillar_weight") / 100.0 * F.col("score")), 0).cast("int").alias("quotient"),
                              F.sort_array(F.collect_list(F.struct("pillar", "score"))).alias("pillar_scores"))
    return t.withColumn("tier", tier(F.col("quotient"), dims.TIERS))


# ---- replay ------------------------------------------------------------------------
def reject_reason(version: Column, version_kind: Column, features: Column, window: Column, window_kind: Column, known_sources: Column,
                  sources: Column) -> Column:
    """Why a stored payload must not be scored again, NULL when it may.

    Kinds are JSON types: a boolean or fractional version or window is refused, as is an
    absent one.  Formula versions are not compared, counter versions are.
    """
    integer = lambda kind: F.coalesce(kind.isin("BIGINT", "INT", "SMALLINT", "TINYINT"), F.lit(False))
    months = dims.QUOTIENT_CONSTANTS["DEFAULT_SCORING_WINDOW_MONTHS"]
    return (F.when(~F.coalesce(features, F.lit(False)), "no_payload_features")
            .when(~integer(version_kind), "inputs_version_unusable")
            .when(version < dims.SKILL_DEDUP_VERSION, "inputs_version_before_dedup")
            .when(version > dims.INPUTS_VERSION, "inputs_version_newer")
            .when(version < dims.TOP_LEVEL_VERSION, "actions_basis_older")
            .when(window_kind.isNull(), "window_undeclared").when(~integer(window_kind), "window_not_integer").when(window != months, "window_differs")
            .when(F.coalesce(F.size(sources), F.lit(0)) == 0, "no_sources").when(~F.coalesce(known_sources, F.lit(False)), "unknown_source"))


def gate(payloads: DataFrame, payload: str = "payload") -> DataFrame:
    """Stored payload documents with the reject reason and the exactness of a replay."""
    v = F.col("v")
    d = payloads.withColumn("v", F.try_parse_json(payload))
    k = lambda path: F.schema_of_variant(F.try_variant_get(v, path, "variant"))
    blocks = F.try_variant_get(v, "$.scoring_inputs_by_source", "map<string,variant>")
    d = d.withColumn("blocks", blocks)

    def claimed(b: Column) -> Column:
        named = F.map_keys(F.try_variant_get(b, "$.window.corpus.sources", "map<string,variant>"))
        return F.when(F.size(named) > 0, named).otherwise(F.split(F.coalesce(F.try_variant_get(b, "$.window.source", "string"), F.lit("")), ","))

    known = F.forall(F.map_values("blocks"), lambda b: F.arrays_overlap(claimed(b), F.array(*[F.lit(s) for s in dims.SOURCES])))
    sessions = lambda b: F.coalesce(F.try_variant_get(b, "$.window.volume.total_sessions", "bigint"), F.lit(0))
    active = F.filter(F.map_entries("blocks"), lambda e: sessions(e["value"]) > 0)
    names = F.when(F.size(active) > 0, F.transform(active, lambda e: e["key"])).otherwise(F.map_keys("blocks"))
    feats = F.try_variant_get(v, "$.payload_features", "string")
    reason = reject_reason(F.try_variant_get(v, "$.scoring_inputs_version", "bigint"), k("$.scoring_inputs_version"), feats.isNotNull() & ~feats.isin("", "{}", "null", "[]", "false", "0"),
                           F.try_variant_get(v, "$.context.window_months", "bigint"), k("$.context.window_months"), known, F.map_keys("blocks"))
    d = d.withColumn("active_sources", names).withColumn("reject_reason", reason)
    return d.withColumn("exactness", F.when(F.col("reject_reason").isNull(), F.when(
        F.size("active_sources") == 1, "exact").otherwise("approximate_weighted_mean_unblended")))


REPLAY_FIELDS = {  # column -> path in a stored scoring-input block
    "total_sessions": "volume.total_sessions", "prompts": "volume.total_prompts", "instructions": "volume.total_instructions", "tool_calls": "volume.tool_calls_total",
    "thinking_blocks": "volume.thinking_blocks", "active_hours": "velocity.active_hours", "tool_churn": "velocity.tool_churn_edit_write", "shell_lines": "velocity.shell_authored_lines_est",
    "planning_ratio": "behavior.planning_ratio_explore_to_doing", "actions_per_prompt": "behavior.actions_per_prompt", "questions": "behavior.questions_asked",
    "error_recovery_ratio": "behavior.error_recovery_ratio", "error_rate_per_100": "behavior.error_rate_per_100_tools", "api_errors": "behavior.api_errors_retries",
    "fanout": "behavior.fanout_median", "max_session_fanout": "behavior.max_session_fanout", "parallel_turns": "behavior.parallel_dispatch_turns",
    "delegating_sessions": "behavior.delegating_sessions", "parallel_session_share": "behavior.parallel_session_share", "test_runs": "behavior.shell_test_runs",
    "plan_sessions": "behavior.plan_sessions", "planning_sessions": "behavior.planning_skill_sessions", "planning_eligible": "behavior.planning_skill_eligible_sessions",
    "planning_unmeasured": "behavior.planning_skill_unmeasured_sessions", "planning_share": "behavior.planning_skill_session_share",
    "planning_coverage": "behavior.planning_skill_session_coverage", "eligible": "behavior.eligible_change_sessions", "test_covered": "behavior.test_covered_change_sessions",
    "planned": "behavior.planned_eligible_sessions", "evidence": "behavior.evidence_eligible_sessions", "cat_delegate": "behavior.delegate_actions",
    "background": "behavior.background_tasks", "m_depth_mean": "behavior.iteration_depth_mean", "m_depth_p90": "behavior.iteration_depth_p90",
    "m_depth_max": "behavior.iteration_depth_max", "m_heavy_files": "behavior.files_hammered_over_15x", "orchestratable": "behavior.orchestratable_sessions",
    "delegated_orchestratable": "behavior.delegated_orchestratable_sessions", "skill_distinct": "stack.skills_distinct", "skill_total": "stack.skills_total",
    "compounding": "stack.compounding_writes", "subagent_distinct": "stack.subagent_types_distinct", "max_session_types": "stack.max_session_subagent_types",
    "agent_calls": "tools.agent_calls", "server_distinct": "tools.mcp_servers_distinct", "cli_distinct": "tools.clis_distinct", "toolsearch_calls": "tools.toolsearch_calls",
    "task_tool_calls": "tools.task_tool_calls", "cli_total": "tools.cli_calls", "mcp_calls": "tools.mcp_calls", "tool_distinct": "tools.tool_diversity",
    "tool_entropy": "tools.tool_entropy_normalized", "knowledge_calls": "tools.mcp_knowledge_calls", "knowledge_server_distinct": "tools.mcp_knowledge_servers",
}
NULLABLE = {"error_recovery_ratio", "error_rate_per_100", "fanout", "planning_share", "planning_coverage", "test_covered", "planning_eligible", "planning_unmeasured",
            "m_depth_mean", "m_depth_p90", "m_depth_max"}


def inputs_of_payloads(gated: DataFrame, owner: list[str]) -> DataFrame:
    """Scoring-input rows of accepted payloads, one per source block, read back from JSON."""
    from loomtrace.functions import tools as T
    d = gated.filter("reject_reason is null").select(*owner, "active_sources", F.explode("blocks").alias("g_source", "b"))
    d = d.select(*owner, "g_source", F.try_variant_get("b", "$.window", "variant").alias("b"))
    b = F.col("b")
    num = lambda p: F.try_variant_get(b, f"$.{p}", "double")
    pairs = lambda p: F.coalesce(F.transform(F.try_variant_get(b, f"$.{p}", "array<variant>"), lambda x: F.struct(
        F.try_variant_get(x, "$[0]", "string").alias("k"), F.coalesce(F.try_variant_get(x, "$[1]", "bigint"), F.lit(0)).alias("n"))),
        F.array().cast("array<struct<k:string,n:bigint>>"))
    cols = [(num(p) if c in NULLABLE else F.coalesce(num(p), F.lit(0.0))).alias(c) for c, p in REPLAY_FIELDS.items()]
    d = d.select(*owner, "g_source", *cols, pairs("stack.skills_all").alias("skills"), pairs("stack.models").alias("models"),
                 F.coalesce(F.try_variant_get(b, "$.behavior.ordered_facts_state", "string"), F.lit("unmeasured")).alias("ordered_state"),
                 F.coalesce(F.try_variant_get(b, "$.behavior.sidechain_label_state", "string"), F.lit("measured")).alias("sidechain_label_state"),
                 F.coalesce(F.try_variant_get(b, "$.behavior.planning_skill_session_scope_state", "string"), F.lit("unmeasured")).alias("planning_state"),
                 F.coalesce(F.try_variant_get(b, "$.behavior.no_tool_activity", "boolean"), F.lit(False)).alias("no_tool_activity"),
                 F.try_variant_get(b, "$.behavior.planning_skill_eligible_sessions", "double").isNull().alias("legacy_planning"),
                 F.array("g_source").alias("sources"))
    sk = lambda cond: F.aggregate(F.filter("skills", lambda s: cond(s["k"])), F.lit(0).cast("bigint"), lambda a, s: a + s["n"])
    has = lambda needles: F.exists("skills", lambda s: T.contains_any(F.lower(s["k"]), needles))
    ok_model = F.array_contains(T.source_caps(F.col("g_source")), "model")
    turns = F.transform("models", lambda m: m["n"])
    return d.select("*", T.union_caps(F.col("sources")).alias("caps"), sk(T.is_review_skill).alias("review_skills"),
                    sk(lambda k: T.contains_any(F.lower(k), dims.QUALITY_SKILL_NEEDLES)).alias("quality_skills"),
                    sk(lambda k: T.contains_any(F.lower(k), ["test", "tdd", "qa"])).alias("test_skills"),
                    sk(lambda k: T.contains_any(F.lower(k), ["qa", "investigate", "retro"])).alias("back_skills"),
                    has(dims.PROCESS_SKILL_NEEDLES).alias("process_skills"), has(dims.COMPOUNDING_SKILL_NEEDLES).alias("compounding_skills"),
                    F.when(ok_model, F.size("models")).otherwise(0).alias("scored_models"),
                    F.when(ok_model, F.aggregate(turns, F.lit(0).cast("bigint"), lambda a, x: a + x)).otherwise(0).alias("scored_turns"),
                    F.when(ok_model, F.coalesce(F.array_max(turns), F.lit(0))).otherwise(0).alias("scored_top"),
                    F.lit("unsupported").alias("routing"), F.lit(0).alias("routing_successful"), F.lit(0).alias("routing_eligible"), F.lit(None).cast("string").alias("top_tool"))


def replay(payloads: DataFrame, owner: list[str], payload: str = "payload") -> DataFrame:
    """Scores of accepted payloads: exact with one active source, else the weighted mean."""
    g = gate(payloads, payload)
    rows = inputs_of_payloads(g, owner)
    q = SC.quotient(rows, owner + ["g_source", "tool_calls"])
    status = g.select(*owner, "reject_reason", "exactness", "active_sources")
    j = q.join(status, owner)
    keep = j.filter((F.size("active_sources") > 1) | F.array_contains("active_sources", F.col("g_source")))
    total = keep.groupBy(*owner).agg(F.bround(weighted_mean(F.col("tool_calls"), F.col("quotient").cast("double")), 0).cast("int").alias("quotient"))
    out = status.drop("active_sources").join(total, owner, "left")
    return out.withColumn("tier", F.when(F.col("quotient").isNotNull(), tier(F.col("quotient"), dims.TIERS)))
