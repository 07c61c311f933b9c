"""Scores as expressions over one scoring-input row: no shuffle, no collected state.

`quotient` gives the four-pillar 0-100 score, `scorecard` the three 0-10 axes.  Both read
the columns of `stats.scoring_inputs`; a NULL input means unmeasured and drops its term.
"""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace import dims
from loomtrace.functions.numbers import clamp01, let, ratio, rate, sat, tier, wsum, wsum_disclosure

C = dims.QUOTIENT_CONSTANTS
G = dims.SCORECARD_CONSTANTS
MIN = C["MIN_ELIGIBLE_SESSIONS"]


def cap(name: str) -> Column:
    return F.array_contains("caps", name)


def _per_call(x: Column, target: float) -> Column:
    return rate(x, F.col("tool_calls"), target, C["RATE_MIN_EXPECTED_AT_TARGET"])


def ordered_share(n: str) -> Column:
    """Share of eligible sessions, NULL below the session floor or when unmeasured."""
    e = F.col("eligible")
    return F.when((F.col("ordered_state") == "measured") & (e >= MIN), F.col(n).cast("double") / e)


def planning_evidence(df: DataFrame) -> DataFrame:
    """Planning practice share, coverage and effective weight, validated against the counts.

    Rows with only legacy fields (legacy_planning) use plan sessions over all sessions.
    """
    n, e, u = (F.col(c) for c in ("planning_sessions", "planning_eligible", "planning_unmeasured"))
    legacy = F.col("legacy_planning") if "legacy_planning" in df.columns else F.lit(False)
    good = (n >= 0) & (e >= 0) & (u >= 0) & (n <= e)
    expected = F.when((e > 0) & (u == 0), "measured").when(e > 0, "partial").otherwise("unmeasured")
    close = lambda a, b: F.abs(a - b) <= F.greatest(F.lit(1e-6), F.lit(1e-6) * F.greatest(F.abs(a), F.abs(b)))
    honest = (F.col("planning_state") == expected) & F.when(
        expected == "unmeasured", F.col("planning_share").isNull() & F.col("planning_coverage").isNull()).otherwise(
        close(F.col("planning_share"), n / e) & close(F.col("planning_coverage"), e / (e + u)))
    sess = F.greatest(F.col("total_sessions"), F.lit(1))
    usable = F.coalesce(good & honest & (expected != "unmeasured"), F.lit(False))
    old_ok = F.col("plan_sessions") <= sess
    share = F.when(legacy, F.when(old_ok, F.col("plan_sessions") / sess)).when(usable, n / e)
    coverage = F.when(legacy, F.when(old_ok, F.lit(1.0))).when(usable, e / (e + u))
    return df.withColumn("pe_legacy", legacy).withColumn("pe_share", share).withColumn("pe_coverage", coverage).withColumn(
        "pe_eligible", F.when(legacy, sess).when(F.coalesce(good & honest, F.lit(False)), e)).withColumn(
        "pe_weight", F.coalesce(F.col("pe_coverage") * dims.PLANNING_BASE_WEIGHT, F.lit(0.0))).withColumn(
        "pe_state", F.when(legacy, "legacy").when(F.coalesce(good & honest, F.lit(False)), expected).otherwise("unmeasured"))


def axis_terms(df: DataFrame) -> dict[str, list]:
    """Terms (weight, value, capability) of the axes that are plain weighted means."""
    types, fan = F.col("subagent_distinct"), F.col("fanout")
    mx = F.col("max_session_types")
    harness = (F.when(F.col("no_tool_activity") | mx.isNull(), None)
               .when(mx >= C["HARNESS_TEAM_SESSION_TYPES"], 1.0).when(mx >= 1, C["HARNESS_BELOW_TEAM_CREDIT"])
               .when(F.col("agent_calls").isNull() | (F.col("agent_calls") > 0) | (types > 0), None).otherwise(0.0))
    practice = F.when(F.col("pe_eligible") >= MIN, sat(F.col("pe_share"), C["PLANNING_PRACTICE_TARGET"]))
    planning_cap = F.when(F.col("pe_legacy"), cap("skills")).otherwise(cap("planning_signal"))
    routing_rate = ratio(F.col("routing_successful"), F.col("routing_eligible"))
    routing = F.when(F.col("routing") == "measured", sat(routing_rate, C["LINKED_ROUTING_SUCCESS_RATE_TARGET"]))
    offload = F.when(F.col("scored_turns") > 0, 1 - F.col("scored_top") / F.col("scored_turns")).otherwise(0.0)
    return {
        "Orchestration": [(.40, sat(types, C["SUBAGENT_TYPES_DISTINCT_CEILING"]), None), (.40, sat(fan, C["FANOUT_CEILING"]), None), (.20, harness, None)],
        "Skill fluency": [(.40, sat(F.col("skill_distinct"), C["SKILLS_DISTINCT_CEILING"]), None),
                          (.30, _per_call(F.col("skill_total"), C["SKILLS_TOTAL_PER_CALL_TARGET"]), None),
                          (.30, F.when(F.col("process_skills"), 1.0).otherwise(0.6), None)],
        "Tool command (MCP + CLI)": [(.40, sat(F.col("server_distinct"), C["MCP_SERVERS_DISTINCT_CEILING"]), None),
                                     (.40, sat(F.col("cli_distinct"), C["CLIS_DISTINCT_CEILING"]), None)],
        "Discipline": [(.40, practice, planning_cap), (.20, sat(ordered_share("planned"), C["PLANNING_TARGET"]), None)],
        "Verification": [(.5, clamp01(ordered_share("test_covered")), None),
                         (.5, _per_call(F.col("review_skills"), C["REVIEW_SKILLS_PER_CALL_TARGET"]), cap("skill_reads"))],
        "Compounding": [(.6, _per_call(F.col("compounding"), C["COMPOUNDING_WRITES_PER_CALL_TARGET"]), None),
                        (.4, F.when(F.col("compounding_skills"), 1.0).otherwise(0.6), cap("skill_reads"))],
        "Model mix": [(.35, sat(F.col("scored_models"), C["MODELS_DISTINCT_CEILING"]), None), (.35, sat(offload, C["OFFLOAD_SHARE_TARGET"]), None),
                      (.30, routing, None)],
    }


def axis_values(df: DataFrame) -> DataFrame:
    """One struct per axis: value (NULL = not scored), capability, dropped-term disclosure."""
    d = planning_evidence(df)
    terms = axis_terms(d)
    quality = wsum(terms["Orchestration"])
    orch = F.coalesce("orchestratable", F.lit(0))
    freq = F.when(orch > 0, sat(F.col("delegated_orchestratable") / orch, C["ORCHESTRATION_FREQUENCY_TARGET"]))
    d = d.withColumn("o_quality", quality).withColumn("o_frequency", freq).withColumn(
        "o_weight", F.least(orch / float(C["ORCHESTRATION_FULL_CONFIDENCE_SESSIONS"]), F.lit(1.0)) * 0.30)
    q, f, w = F.col("o_quality"), F.col("o_frequency"), F.col("o_weight")
    band_on = bool(C["STEERING_LEVERAGE_BAND_VALIDATED"])
    app, lo, hi = F.col("actions_per_prompt"), C["STEERING_LEVERAGE_BAND_MIN"], C["STEERING_LEVERAGE_BAND_MAX"]
    lever = (F.when(F.lit(not band_on) | (F.col("sidechain_label_state") != "measured"), None).when(app <= 0, 0.0).when(app < lo, app / lo)
             .when(app <= hi, 1.0).otherwise(F.greatest(F.lit(0.0), 1 - (app - hi) / C["STEERING_LEVERAGE_DECAY_SPAN"])))
    api = F.when(F.col("tool_calls") > 0, F.col("api_errors") * 100.0 / F.col("tool_calls")).otherwise(0.0)
    recovery = sat(F.coalesce("error_recovery_ratio", F.lit(0.0)), 1.0) * .85 + (1 - sat(api, C["API_RETRIES_PER_100_TOOLS_TARGET"])) * .15
    cli, mcp = F.col("cli_total"), F.col("mcp_calls")
    context = F.when(~F.col("no_tool_activity"), sat(ordered_share("evidence"), C["CONTEXT_INTELLIGENCE_TARGET"]))
    values = {
        "Orchestration": F.coalesce((1 - w) * q + w * f, q, f), "Skill fluency": wsum(terms["Skill fluency"]),
        "Tool command (MCP + CLI)": wsum(terms["Tool command (MCP + CLI)"]), "Discipline": wsum(terms["Discipline"]),
        "Verification": wsum(terms["Verification"]), "Grounding": sat(F.col("planning_ratio"), 1.0), "Context Intelligence": context,
        "Compounding": wsum(terms["Compounding"]), "Steering leverage": lever, "Recovery": recovery, "Model mix": wsum(terms["Model mix"]),
        "Token economy": sat(F.when(cli + mcp > 0, cli / (cli + mcp)).otherwise(0.0), C["CLI_SHARE_TARGET"]),
    }
    allowed = {"Orchestration": cap("delegate"), "Skill fluency": cap("skills") | cap("skill_reads"), "Model mix": cap("model")}
    no_partial = F.lit(None).cast("struct<scored:int,total:int,weight_scored:double>")
    axes = []
    for pillar, name, base in dims.QUOTIENT_AXES:
        v = values[name].cast("double")
        if name in allowed:
            v = F.when(allowed[name], v)
        axes.append(F.struct(F.lit(pillar).alias("pillar"), F.lit(name).alias("axis"), F.lit(base).alias("base_weight"), v.alias("value"),
                             (wsum_disclosure(terms[name]) if name in terms else no_partial).cast("struct<scored:int,total:int,weight_scored:double>").alias("partial_terms")))
    return d.withColumn("axes", F.array(*axes))


def weigh(axes: Column) -> Column:
    """Live axes of one pillar with weights rescaled to 100; the last live axis takes the remainder."""
    def scaled(live: Column) -> Column:
        total = F.aggregate(live, F.lit(0), lambda s, a: s + a["base_weight"])
        rounded = let(total, lambda t: F.transform(live, lambda a: F.bround(a["base_weight"] * F.lit(100.0) / t, 0).cast("int")))
        return let(rounded, lambda r: F.transform(live, lambda a, i: out(a, F.get(r, i) + F.when(
            i == F.size(live) - 1, F.lit(100) - F.aggregate(r, F.lit(0), lambda s, x: s + x)).otherwise(0))))

    def out(a: Column, weight: Column) -> Column:
        return let(weight, lambda w: F.struct(
            a["pillar"].alias("pillar"), a["axis"].alias("axis"), a["base_weight"].alias("base_weight"), w.alias("weight"),
            a["value"].alias("normalized_score"), F.bround(w * a["value"], 1).alias("score"), a["partial_terms"].alias("partial_terms")))

    return let(F.filter(axes, lambda a: a["value"].isNotNull()), scaled)


def pillars_of(axes: Column) -> Column:
    """Pillars with weighed axes, score and the names of the axes that do not apply."""
    def one(axs: Column, name: str, weight: int) -> Column:
        mine = F.filter(axs, lambda a: a["pillar"] == name)
        return let(F.struct(weigh(mine).alias("w"), F.transform(F.filter(mine, lambda a: a["value"].isNull()), lambda a: a["axis"]).alias("na")), lambda x: F.struct(
            F.lit(name).alias("pillar"), F.lit(weight).alias("weight"),
            F.bround(F.aggregate(x["w"], F.lit(0.0), lambda s, a: s + a["score"]), 1).alias("score"), x["w"].alias("axes"), x["na"].alias("not_applicable")))
    return let(axes, lambda axs: F.array(*[one(axs, n, w) for n, w in dims.PILLAR_WEIGHTS.items()]))


def quotient(inputs: DataFrame, keep: list[str]) -> DataFrame:
    """keep + axes, pillars, total and tier of every row."""
    d = axis_values(inputs)
    steering = F.when(F.col("sidechain_label_state") != "measured", "unmeasured_sidechain_labels").when(
        F.lit(not C["STEERING_LEVERAGE_BAND_VALIDATED"]), "withheld_unvalidated_band").otherwise("scored")

    def total(ps: Column) -> Column:
        return F.struct(ps.alias("pillars"), F.bround(F.aggregate(
            ps, F.lit(0.0), lambda s, p: s + p["weight"] / F.lit(100.0) * p["score"]), 0).cast("int").alias("quotient"))

    d = d.select(*keep, steering.alias("steering_state"), let(pillars_of(F.col("axes")), total).alias("__q"))
    return d.select(*keep, "steering_state", F.col("__q.pillars").alias("pillars"), F.col("__q.quotient").alias("quotient"),
                    tier(F.col("__q.quotient"), dims.TIERS).alias("tier"), F.lit(dims.CONTRACT_ID).alias("score_contract_id"))


def axis_scores(scored: DataFrame, keep: list[str]) -> DataFrame:
    """Long form: one row per scored axis."""
    return scored.select(*keep, F.explode("pillars").alias("p")).select(*keep, F.explode("p.axes").alias("a")).select(*keep, "a.*")


# ---- scorecard ---------------------------------------------------------------------
def shrink(credit: Column, evidence: Column) -> Column:
    """Pull a reward for the absence of a bad signal towards 0.5 when there is little activity."""
    return (1 - evidence) * 0.5 + evidence * credit


SCORECARD_SUBS = [  # axis, label, unit direction
    ("Execution", "Tool output rate", "higher"), ("Execution", "Delegation & parallelism", "higher"),
    ("Planning", "Explore-before-build", "higher"), ("Planning", "Reasoning depth", "higher"), ("Planning", "Planning practice", "higher"),
    ("Planning", "Ordered planning readiness", "higher"),
    ("Engineering", "Low rework", "lower"), ("Engineering", "Clean iteration", "lower"), ("Engineering", "Focus", "lower"),
    ("Engineering", "Quality ceremony", "higher"), ("Engineering", "Low errors", "lower")]


def scorecard_subs(df: DataFrame) -> dict[str, list[tuple]]:
    """axis -> [(label, weight, fraction, capability, own value, target)] in display order."""
    sess = F.greatest(F.col("total_sessions"), F.lit(1)).cast("double")
    prompts = F.greatest(F.col("prompts"), F.lit(1)).cast("double")
    hours = F.greatest(F.col("active_hours"), F.lit(0.1))
    ev = clamp01(F.col("tool_calls") / F.lit(float(G["EVIDENCE_SATURATION_TOOL_CALLS"])))
    z = lambda c: F.coalesce(c, F.lit(0.0))
    out = F.col("tool_churn") / hours
    runs = F.col("cat_delegate") + F.col("background")
    deleg = runs / F.greatest(prompts * G["DELEGATION_RUNS_PER_PROMPT_TARGET"], F.lit(1.0))
    think = F.col("thinking_blocks") / sess
    quality = (F.col("quality_skills") + F.col("test_runs")) / sess
    heavy = z(F.col("m_heavy_files")) / sess
    mean, p90, err = z(F.col("m_depth_mean")), z(F.col("m_depth_p90")), z(F.col("error_rate_per_100"))
    planned = ordered_share("planned")
    pcap = F.when(F.col("pe_legacy"), cap("skills")).otherwise(cap("planning_signal"))
    inv = lambda v, t, span: shrink(1 - clamp01((v - t) / span), ev)
    return {
        "Execution": [("Tool output rate", .60, clamp01(out / G["EXECUTION_OUTPUT_LINES_PER_HOUR_TARGET"]), None, out, G["EXECUTION_OUTPUT_LINES_PER_HOUR_TARGET"]),
                      ("Delegation & parallelism", .40, clamp01(deleg), cap("delegate"), runs / prompts, G["DELEGATION_RUNS_PER_PROMPT_TARGET"])],
        "Planning": [("Explore-before-build", .30, clamp01(F.col("planning_ratio") / G["PLANNING_EXPLORE_RATIO_TARGET"]), None, F.col("planning_ratio"), G["PLANNING_EXPLORE_RATIO_TARGET"]),
                     ("Reasoning depth", .30, clamp01(think / G["THINKING_BLOCKS_PER_SESSION_TARGET"]), cap("thinking"), think, G["THINKING_BLOCKS_PER_SESSION_TARGET"]),
                     ("Planning practice", F.col("pe_weight"), F.when(F.col("pe_share").isNotNull(), clamp01(F.col("pe_share") / C["PLANNING_PRACTICE_TARGET"])), pcap, F.col("pe_share"), C["PLANNING_PRACTICE_TARGET"]),
                     ("Ordered planning readiness", .15, F.when(planned.isNotNull(), clamp01(planned / C["PLANNING_TARGET"])), None, planned, C["PLANNING_TARGET"])],
        "Engineering": [("Low rework", .30, inv(mean, G["ITERATION_DEPTH_MEAN_TARGET"], G["ITERATION_DEPTH_MEAN_DECAY_SPAN"]), None, mean, G["ITERATION_DEPTH_MEAN_TARGET"]),
                        ("Clean iteration", .25, inv(p90, G["ITERATION_DEPTH_P90_TARGET"], G["ITERATION_DEPTH_P90_DECAY_SPAN"]), None, p90, G["ITERATION_DEPTH_P90_TARGET"]),
                        ("Focus", .20, shrink(1 - clamp01(heavy / G["FILES_HAMMERED_PER_SESSION_TARGET"]), ev), None, heavy, G["FILES_HAMMERED_PER_SESSION_TARGET"]),
                        ("Quality ceremony", .15, clamp01(quality / G["QUALITY_CEREMONY_PER_SESSION_TARGET"]), None, quality, G["QUALITY_CEREMONY_PER_SESSION_TARGET"]),
                        ("Low errors", .10, shrink(1 - clamp01(err / G["ERROR_RATE_PER_100_TOOLS_TARGET"]), ev), None, err, G["ERROR_RATE_PER_100_TOOLS_TARGET"])]}


def scorecard(inputs: DataFrame, keep: list[str]) -> DataFrame:
    """keep + execution, planning, engineering (0-10) and the subs of each axis with the drag marked."""
    d = planning_evidence(inputs)
    idle = F.col("tool_calls") == 0
    guard = (F.col("total_sessions") == 0) | (idle & (F.col("pe_share").isNull() | F.col("pe_legacy")))
    subs = scorecard_subs(d)
    direction = {label: dr for _, label, dr in SCORECARD_SUBS}
    cols = []
    for axis, rows in subs.items():
        value = F.coalesce(wsum([(w, v, c) for _, w, v, c, _, _ in rows]), F.lit(0.0)) * 10
        value = F.when(guard, 0.0).otherwise(F.bround(value, 1))
        if axis != "Planning":
            value = F.when(idle, 0.0).otherwise(value)
        cols.append(value.alias(axis.lower()))
        cols.append(F.array(*[F.struct(
            F.lit(axis).alias("axis"), F.lit(label).alias("label"), (F.col("pe_weight") if isinstance(w, Column) else F.lit(float(w))).alias("weight"),
            F.when(F.coalesce(c, F.lit(True)) if c is not None else F.lit(True), v).cast("double").alias("pct"), own.cast("double").alias("own_value"),
            F.lit(float(target)).alias("target"), F.lit(direction[label]).alias("direction"),
            (c if c is not None else F.lit(True)).alias("kept")) for label, w, v, c, own, target in rows]).alias(f"{axis.lower()}_subs"))
    return d.select(*keep, *cols)


def verdict(pct: Column) -> Column:
    return F.when(pct.isNull(), "unavailable").when(pct >= .9, "excellent").when(pct >= .7, "good").when(pct >= .5, "adequate").when(pct >= .3, "weak").otherwise("poor")


def axis_verdict(v: Column) -> Column:
    return F.when(v >= 8, "excellent").when(v >= 6.5, "good").when(v >= 5, "adequate").when(v >= 3, "weak").otherwise("poor")


def breakdown(card: DataFrame, keep: list[str]) -> DataFrame:
    """One row per sub with rescaled weight, verdict and drag flag (smallest weight x fraction below target)."""
    out = None
    for axis in ("execution", "planning", "engineering"):
        subs = F.filter(f"{axis}_subs", lambda s: s["kept"] & ((s["label"] != "Ordered planning readiness") | s["pct"].isNotNull()))
        d = card.select(*keep, F.col(axis).alias("axis_value"), subs.alias("s"))
        total = F.aggregate("s", F.lit(0.0), lambda a, s: a + F.when(s["pct"].isNotNull(), s["weight"]).otherwise(0.0))
        d = d.withColumn("total", total)
        low = F.array_min(F.transform(F.filter("s", lambda s: s["pct"] < 1.0), lambda s: F.bround(s["weight"] / F.col("total"), 4) * s["pct"]))
        d = d.withColumn("low", low).select(*keep, "axis_value", "total", "low", F.posexplode("s").alias("i", "s"))
        w = F.when(F.col("s.pct").isNotNull() & (F.col("total") > 0), F.bround(F.col("s.weight") / F.col("total"), 4)).otherwise(0.0)
        d = d.select(*keep, F.lit(axis).alias("axis"), axis_verdict(F.col("axis_value")).alias("axis_verdict"), "axis_value", "i", F.col("s.label").alias("label"),
                     w.alias("weight"), F.col("s.pct").alias("pct"), F.col("s.own_value").alias("own_value"), F.col("s.target").alias("target"),
                     verdict(F.col("s.pct")).alias("verdict"), F.bround(F.col("s.pct") * 100, 0).cast("int").alias("score_pct"),
                     F.coalesce((F.col("s.pct") < 1.0) & (w * F.col("s.pct") == F.col("low")), F.lit(False)).alias("is_drag"))
        out = d if out is None else out.unionByName(d)
    return out


# ---- descriptive labels --------------------------------------------------------------
def fingerprint() -> Column:
    """16 hex digits over the sorted name=value list of the calibration constants."""
    own = [f"{k}={v!r}" for k, v in dims.QUOTIENT_CONSTANTS.items()]
    card = [f"scorecard.{k}={v!r}" for k, v in dims.SCORECARD_CONSTANTS.items()]
    blend = [f"blend.{k}={v!r}" for k, v in dims.BLEND_WEIGHTS.items()]
    rows = F.array_sort(F.array(*[F.lit(x) for x in own + card + blend]))
    return F.substring(F.sha2(F.array_join(rows, "\n"), 256), 1, 16)


def tool_rate_diagnostic(inputs: DataFrame, keep: list[str]) -> DataFrame:
    """Count, rate per call and percent of target for the signals with a target."""
    calls = F.col("tool_calls")
    rows = [("skills_total", "skill_total", C["SKILLS_TOTAL_PER_CALL_TARGET"], True), ("review_skills", "review_skills", C["REVIEW_SKILLS_PER_CALL_TARGET"], True),
            ("compounding_writes", "compounding", C["COMPOUNDING_WRITES_PER_CALL_TARGET"], True), ("orchestratable", "orchestratable", 1.0, False),
            ("knowledge_calls", "knowledge_calls", 200.0, False), ("toolsearch_calls", "toolsearch_calls", None, False), ("task_tool_calls", "task_tool_calls", None, False)]
    structs = []
    for label, c, target, is_rate in rows:
        per = F.when(calls > 0, F.col(c) / calls).otherwise(0.0)
        pct = F.lit(None).cast("int") if target is None else F.least(F.lit(100), F.bround((per if is_rate else F.col(c).cast("double")) * 100 / target, 0)).cast("int")
        structs.append(F.struct(F.lit(label).alias("metric"), F.col(c).cast("bigint").alias("count"), F.bround(per, 6).alias("per_call"),
                                F.lit(target).cast("double").alias("target"), pct.alias("pct")))
    return inputs.select(*keep, F.explode(F.array(*structs)).alias("d")).select(*keep, "d.*")


def persona(rhythm: DataFrame, keep: list[str], peak: str, weekend: str, weekday: str, avg_len: str, median_len: str, polite: str, prompts: str, questions: str) -> DataFrame:
    """Labels for time of day, weekends, prompt shape, politeness and stance."""
    p = F.col(peak)
    n = F.greatest(F.col(prompts), F.lit(1)).cast("double")
    rate_ = F.col(polite) / n
    mean = F.when(F.col(weekday) == 0, 1.0).otherwise(F.col(weekday) / 5.0)
    return rhythm.select(
        *keep, F.when((p >= 22) | (p <= 4), "night").when(p <= 11, "morning").when(p <= 16, "afternoon").otherwise("evening").alias("time_of_day"),
        F.when(F.col(weekend) / 2.0 >= mean * 0.6, "every_day").otherwise("weekdays").alias("week_shape"),
        F.when(F.col(avg_len) > F.col(median_len) * 2, "two_gears").otherwise("steady").alias("prompt_shape"),
        F.when(rate_ >= .12, "very_polite").when(rate_ >= .04, "polite").otherwise("business").alias("politeness"),
        F.when((rate_ >= .05) | (F.col(questions) / n >= .04), "teammate").otherwise("tool").alias("stance"))


def insights(inputs: DataFrame, scored: DataFrame, card: DataFrame, keep: list[str]) -> DataFrame:
    """Rule codes with strength or priority: signature moves (top 5), growth edges (top 3), leash label."""
    j = inputs.join(scored.select(*keep, "pillars", "quotient", "tier"), keep).join(card.select(*keep, "execution", "planning", "engineering"), keep)
    sess, prompts = F.greatest(F.col("total_sessions"), F.lit(1)).cast("double"), F.greatest(F.col("prompts"), F.lit(1)).cast("double")
    rev, deleg = F.col("review_skills"), F.col("cat_delegate") + F.col("background")
    depth = F.coalesce("m_depth_max", F.lit(0))
    plan = F.least(F.col("plan_sessions").cast("double"), sess)
    move = lambda code, cond, strength: F.when(F.coalesce(cond, F.lit(False)), F.struct(clamp01(strength).alias("strength"), F.lit(code).alias("code")))
    shell = F.col("top_tool") == "Bash"
    moves = [move("review", (rev >= 50) & (rev >= sess * .5), rev / (sess * 2)),
             move("plan_wide_grind_narrow", (F.col("planning_ratio") >= .55) & (depth >= 40), depth / 100.0),
             move("run_a_team", (deleg >= 100) & (deleg >= prompts * .3), deleg / (prompts * .8)),
             move("think_first", F.col("thinking_blocks") / sess >= 8, F.col("thinking_blocks") / sess / 30.0),
             move("plan_before_code", (plan >= 3) & (plan >= sess * .35), plan / sess),
             move("direct", (F.col("questions") / prompts < .03) & (F.col("prompts") > 200), F.lit(.45)),
             move("live_in_shell", (F.col("shell_lines") >= 20000) & shell, F.col("shell_lines") / 80000.0),
             move("research_first", (F.col("knowledge_calls") >= 100) & (F.col("knowledge_server_distinct") >= 2), F.col("knowledge_calls") / 500.0)]
    ordered = F.transform(F.filter(F.array(*moves), lambda m: m.isNotNull()), lambda m, i: F.struct((-m["strength"]).alias("k"), i.alias("i"), m["code"].alias("code"), m["strength"].alias("strength")))
    top = F.transform(F.slice(F.array_sort(ordered), 1, 5), lambda m: F.struct(m["code"].alias("code"), m["strength"].alias("strength")))
    tdd = F.col("test_skills") + F.col("test_runs")
    err = F.coalesce("error_rate_per_100", F.lit(0.0))
    edge = lambda code, cond, pr: F.when(F.coalesce(cond, F.lit(False)), F.struct(pr.cast("double").alias("priority"), F.lit(code).alias("code")))
    eng_skills = F.col("review_skills") + F.col("back_skills")
    edges = [edge("test_reflex", (rev >= 50) & (tdd < F.greatest(rev * .1, F.lit(5.0))), F.lit(1.5)),
             edge("stop_the_grind", ((depth >= 40) | (F.coalesce("m_heavy_files", F.lit(0)) >= 10)) & (err >= 5), F.lit(2.0)),
             edge("plan_first", F.col("planning") < 6, F.col("planning")),
             edge("quality_pass", (F.col("engineering") < 6) & (eng_skills < sess * .3), F.col("engineering") + .1)]
    thin = F.flatten(F.transform("pillars", lambda p: p["axes"]))
    thin = F.filter(thin, lambda a: (a["score"] / a["weight"] < .45) & a["axis"].isin("Orchestration", "Tool command (MCP + CLI)", "Model mix", "Token economy", "Grounding"))
    thin = F.transform(thin, lambda a: F.struct((a["score"] / a["weight"] * 5 + 2.5).alias("priority"), F.concat(F.lit("axis:"), a["axis"]).alias("code")))
    raw = F.concat(F.filter(F.array(*edges), lambda e: e.isNotNull()), thin)
    card3 = F.array(*[F.struct(F.col(c).alias("v"), F.lit(i).alias("i"), F.lit(c).alias("c")) for i, c in enumerate(("execution", "planning", "engineering"))])
    worst = F.array_min(card3)
    fallback = F.when(worst["v"] < 6.5, F.struct(F.lit(8.5).alias("priority"), F.concat(F.lit("softest:"), worst["c"]).alias("code"))).otherwise(
        F.struct(F.lit(9.0).alias("priority"), F.lit("go_deeper").alias("code")))
    raw = F.when(F.size(raw) > 0, raw).otherwise(F.array(fallback))
    sorted_edges = F.array_sort(F.transform(raw, lambda e, i: F.struct(e["priority"].alias("p"), i.alias("i"), e["code"].alias("code"))))
    picked = F.transform(F.slice(sorted_edges, 1, 3), lambda e: F.struct(
        e["code"].alias("code"), e["p"].alias("priority"), F.when(e["p"] < 2, "high").when(e["p"] < 5, "medium").otherwise("low").alias("severity")))
    apr = F.col("actions_per_prompt")
    thinnest = F.array_min(F.transform("pillars", lambda p, i: F.struct(p["score"].alias("s"), i.alias("i"), p["pillar"].alias("p"))))["p"]
    return j.select(*keep, top.alias("moves"), picked.alias("edges"), F.when(apr >= 12, "long").when(apr >= 6, "medium").otherwise("short").alias("leash"),
                    "tier", thinnest.alias("thinnest_pillar"))
