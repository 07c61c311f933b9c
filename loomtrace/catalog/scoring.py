"""Scoring queries.  Signals are aggregates of orders and line items per developer (customer
group) and source, so every scored row grows with the given tables."""
from __future__ import annotations

import re

from pyspark.sql import DataFrame, functions as F

from loomtrace import dims
from loomtrace.catalog.registry import Tables, query
from loomtrace.functions import tools as T
from loomtrace.operators import planning as P
from loomtrace.plans import audit as AU, combine as CB, score as SC

# signal -> aggregate over line items of the owner's orders (valid in Spark SQL and DuckDB)
SIGNALS = {
    "tool_calls": "count(*)", "prompts": "count(*) FILTER (WHERE l_linenumber = 1)", "total_sessions": "count(DISTINCT o_orderkey)",
    "thinking_blocks": "count(*) FILTER (WHERE l_quantity > 25)", "subagent_distinct": "count(DISTINCT l_suppkey % 11)", "max_session_types": "max(l_linenumber) - 4",
    "agent_calls": "count(*) FILTER (WHERE l_returnflag = 'A')", "delegating": "count(*) FILTER (WHERE l_tax > 0.05)",
    "planning_sessions": "count(DISTINCT o_orderkey) FILTER (WHERE o_orderpriority = '1-URGENT')",
    "planning_eligible": "count(DISTINCT o_orderkey) FILTER (WHERE o_orderpriority <> '5-LOW')",
    "planning_unmeasured": "count(DISTINCT o_orderkey) FILTER (WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'P')",
    "eligible": "count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus <> 'O')",
    "planned": "count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'F' AND l_quantity > 45)",
    "test_covered": "count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus = 'F' AND l_quantity < 10)",
    "evidence": "count(DISTINCT o_orderkey) FILTER (WHERE o_orderstatus <> 'O' AND l_discount > 0.05)",
    "orchestratable": "count(DISTINCT o_orderkey) FILTER (WHERE l_linenumber >= 5)",
    "delegated_orchestratable": "count(DISTINCT o_orderkey) FILTER (WHERE l_linenumber >= 6)",
    "skill_distinct": "count(DISTINCT l_partkey % 53)", "skill_total": "count(*) FILTER (WHERE l_quantity = 7)", "review_skills": "count(*) FILTER (WHERE l_quantity = 9 AND l_tax > 0.03)",
    "compounding": "count(*) FILTER (WHERE l_quantity = 11 AND l_tax > 0.06)", "server_distinct": "count(DISTINCT l_suppkey % 19)", "cli_distinct": "count(DISTINCT l_partkey % 47)",
    "cli_total": "count(*) FILTER (WHERE l_quantity > 20)", "mcp_calls": "count(*) FILTER (WHERE l_quantity <= 20)", "api_errors": "count(*) FILTER (WHERE l_quantity = 50)",
    "tool_errors": "count(*) FILTER (WHERE l_returnflag = 'R')", "recovered": "count(*) FILTER (WHERE l_returnflag = 'R' AND l_linestatus = 'F')",
    "explore": "count(*) FILTER (WHERE l_linestatus = 'O')", "doing": "count(*) FILTER (WHERE l_linestatus = 'F')", "sidechain": "count(*) FILTER (WHERE l_tax = 0)",
    "scored_models": "count(DISTINCT l_returnflag)", "scored_turns": "count(*)", "scored_top": "count(*) FILTER (WHERE l_returnflag = 'N')",
    "cat_delegate": "count(*) FILTER (WHERE l_discount = 0.1)", "background": "count(*) FILTER (WHERE l_discount = 0)", "test_runs": "count(*) FILTER (WHERE l_quantity = 3)",
    "quality_skills": "count(*) FILTER (WHERE l_quantity = 5)", "m_heavy_files": "count(*) FILTER (WHERE l_linenumber = 7 AND l_quantity > 48)",
    "tool_churn": "CAST(sum(l_quantity) AS BIGINT) * 40", "minutes": "CAST(sum(l_linenumber) AS BIGINT) * 3", "m_depth_p90": "max(l_linenumber)",
    "questions": "count(*) FILTER (WHERE l_quantity = 1)", "routing_eligible": "count(*) FILTER (WHERE l_quantity = 33)",
    "routing_successful": "count(*) FILTER (WHERE l_quantity = 33 AND l_tax > 0.04)",
}
OWNER = "o_custkey % 150"
SOURCE_SQL = "[" + ", ".join(f"'{s}'" for s in dims.SOURCES) + "][CAST(o_custkey % 8 + 1 AS INT)]"


def per_order(expr: str) -> tuple[str, str]:
    """A signal as an aggregate of one order's lines, and the aggregate of those ({} stands for it).

    Distinct orders become one flag per order, distinct small residues one bit each, so no row is
    multiplied for a distinct count.
    """
    if m := re.fullmatch(r"count\(DISTINCT o_orderkey\)(?: FILTER \(WHERE (.*)\))?", expr):
        return f"max(CASE WHEN {m[1] or 'true'} THEN 1 ELSE 0 END)", "sum({})"
    if m := re.fullmatch(r"count\(DISTINCT (.+ % \d+)\)", expr):
        return f"bit_or(shiftleft(1L, CAST({m[1]} AS INT)))", "CAST(bit_count(bit_or({})) AS BIGINT)"
    if m := re.fullmatch(r"count\(DISTINCT (l_returnflag)\)", expr):
        return f"bit_or(shiftleft(1L, ascii({m[1]}) % 64))", "CAST(bit_count(bit_or({})) AS BIGINT)"
    if m := re.fullmatch(r"(max\(.+?\))(.*)", expr):
        return m[1], "max({})" + m[2]
    if m := re.fullmatch(r"CAST\((sum\(.+?\)) AS BIGINT\)(.*)", expr):
        return m[1], "CAST(sum({}) AS BIGINT)" + m[2]
    return expr, "sum({})"


def inputs(t: Tables) -> DataFrame:
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey"))
    src = F.element_at(F.array(*[F.lit(s) for s in dims.SOURCES]), (F.col("o_custkey") % 8 + 1).cast("int"))
    two = {c: per_order(e) for c, e in SIGNALS.items()}
    orders = j.groupBy("l_orderkey", F.expr(OWNER).alias("owner"), src.alias("g_source")).agg(*[F.expr(e).alias(c) for c, (e, _) in two.items()])
    return finish(orders.groupBy("owner", "g_source").agg(*[F.expr(e.format(f"`{c}`")).alias(c) for c, (_, e) in two.items()]))


def finish(g: DataFrame) -> DataFrame:
    div = lambda a, b: F.when(F.col(b) > 0, F.col(a) / F.col(b)).otherwise(0.0)
    e, u = F.col("planning_eligible"), F.col("planning_unmeasured")
    state = F.when((e > 0) & (u == 0), "measured").when(e > 0, "partial").otherwise("unmeasured")
    return g.select(
        "*", F.array("g_source").alias("sources"), T.source_caps(F.col("g_source")).alias("caps"), F.lit(False).alias("no_tool_activity"), F.lit("measured").alias("ordered_state"),
        F.lit("measured").alias("sidechain_label_state"), state.alias("planning_state"), F.when(e > 0, F.col("planning_sessions") / e).alias("planning_share"),
        F.when(e > 0, e / (e + u)).alias("planning_coverage"), F.col("planning_sessions").alias("plan_sessions"), (F.col("delegating") / F.greatest("total_sessions", F.lit(1))).alias("fanout"),
        (F.col("skill_total") > 5).alias("process_skills"), (F.col("compounding") > 0).alias("compounding_skills"), div("explore", "doing").alias("planning_ratio"),
        ((F.col("tool_calls") - F.col("sidechain")) / F.greatest("prompts", F.lit(1))).alias("actions_per_prompt"), F.col("prompts").alias("instructions"),
        div("recovered", "tool_errors").alias("error_recovery_ratio"), (div("tool_errors", "tool_calls") * 100 / 4).alias("error_rate_per_100"),
        F.when(F.col("routing_eligible") > 0, "measured").otherwise("unsupported").alias("routing"), (F.col("minutes") / 60.0).alias("active_hours"),
        (F.col("tool_calls") / F.greatest("total_sessions", F.lit(1))).alias("m_depth_mean"))


CAPS_SQL = "CASE source " + " ".join(
    f"WHEN '{s}' THEN [" + ", ".join(f"'{c}'" for c in caps) + "]" for s, caps in dims.SOURCE_CAPS.items()) + " END"
INPUTS_SQL = f"""
WITH g AS (SELECT {OWNER} AS owner, {SOURCE_SQL} AS source, {', '.join(f'{e} AS {c}' for c, e in SIGNALS.items())}
           FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2),
 i AS (SELECT *, {CAPS_SQL} AS caps, delegating / greatest(total_sessions, 1) AS fanout FROM g)"""

_rate = lambda x, t: f"CASE WHEN tool_calls * {t}::DOUBLE > 1 THEN least(1.0, {x} / tool_calls / {t}::DOUBLE) END"


def _mean(*terms: tuple[str, str]) -> str:
    """Weighted mean over non-null terms in SQL."""
    num = " + ".join(f"coalesce({w}::DOUBLE * ({v}), 0)" for w, v in terms)
    den = " + ".join(f"CASE WHEN ({v}) IS NULL THEN 0 ELSE {w}::DOUBLE END" for w, v in terms)
    return f"(({num}) / nullif({den}, 0))"


_HAS = lambda c: f"list_contains(caps, '{c}')"
AXES_SQL = INPUTS_SQL + f""",
 q AS (SELECT *, {_mean(('0.4', 'least(1.0, subagent_distinct / 8)'), ('0.4', 'least(1.0, fanout / 5)'), ('0.2', "CASE WHEN max_session_types >= 3 THEN 1.0 WHEN max_session_types >= 1 THEN 0.6 WHEN agent_calls > 0 OR subagent_distinct > 0 THEN NULL ELSE 0.0 END"))} AS oq,
    CASE WHEN orchestratable > 0 THEN least(1.0, delegated_orchestratable / orchestratable / 0.78::DOUBLE) END AS ofr, 0.3::DOUBLE * least(1.0, orchestratable / 5) AS ow FROM i),
 a AS (SELECT owner, source, unnest([
  {{'axis': 'Orchestration', 'v': CASE WHEN {_HAS('delegate')} THEN coalesce((1 - ow) * oq + ow * ofr, oq, ofr) END}},
  {{'axis': 'Skill fluency', 'v': CASE WHEN {_HAS('skills')} OR {_HAS('skill_reads')} THEN {_mean(('0.4', 'least(1.0, skill_distinct / 40)'), ('0.3', _rate('skill_total', '0.009')), ('0.3', 'CASE WHEN skill_total > 5 THEN 1.0 ELSE 0.6 END'))} END}},
  {{'axis': 'Tool command (MCP + CLI)', 'v': {_mean(('0.4', 'least(1.0, server_distinct / 15)'), ('0.4', 'least(1.0, cli_distinct / 40)'))}}},
  {{'axis': 'Discipline', 'v': {_mean(('0.4', f"CASE WHEN {_HAS('planning_signal')} AND planning_eligible >= 5 THEN least(1.0, planning_sessions / planning_eligible / 0.3::DOUBLE) END"), ('0.2', 'CASE WHEN eligible >= 5 THEN least(1.0, planned / eligible / 0.5::DOUBLE) END'))}}},
  {{'axis': 'Verification', 'v': {_mean(('0.5', "CASE WHEN eligible >= 5 THEN least(1.0, test_covered / eligible) END"), ('0.5', f"CASE WHEN {_HAS('skill_reads')} THEN {_rate('review_skills', '0.004')} END"))}}},
  {{'axis': 'Grounding', 'v': least(1.0, CASE WHEN doing > 0 THEN explore / doing ELSE 0.0 END)}},
  {{'axis': 'Context Intelligence', 'v': CASE WHEN eligible >= 5 THEN least(1.0, evidence / eligible / 0.6::DOUBLE) END}},
  {{'axis': 'Compounding', 'v': {_mean(('0.6', _rate('compounding', '0.0018')), ('0.4', f"CASE WHEN {_HAS('skill_reads')} THEN CASE WHEN compounding > 0 THEN 1.0 ELSE 0.6 END END"))}}},
  {{'axis': 'Recovery', 'v': 0.85::DOUBLE * CASE WHEN tool_errors > 0 THEN recovered / tool_errors ELSE 0.0 END + 0.15::DOUBLE * (1 - least(1.0, api_errors * 100.0::DOUBLE / tool_calls / 2))}},
  {{'axis': 'Model mix', 'v': CASE WHEN {_HAS('model')} THEN {_mean(('0.35', 'least(1.0, scored_models / 3)'), ('0.35', 'least(1.0, (1 - scored_top / scored_turns) / 0.3::DOUBLE)'), ('0.3', 'CASE WHEN routing_eligible > 0 THEN least(1.0, routing_successful / routing_eligible / 0.4::DOUBLE) END'))} END}},
  {{'axis': 'Token economy', 'v': least(1.0, cli_total / (cli_total + mcp_calls) / 0.7::DOUBLE)}}]) AS x FROM q)"""


@query("axis_values", AXES_SQL + " SELECT owner, source, x.axis AS axis, round(x.v, 9) AS value FROM a WHERE x.v IS NOT NULL")
def _(t: Tables):
    d = SC.axis_values(inputs(t)).select("owner", F.col("g_source").alias("source"), F.explode("axes").alias("a"))
    return d.filter("a.value is not null").select("owner", "source", F.col("a.axis").alias("axis"), F.round("a.value", 9).alias("value"))


_PILLARS = "CASE x.axis " + " ".join(f"WHEN '{a}' THEN '{p}'" for p, a, _ in dims.QUOTIENT_AXES) + " END"
_BASE = "CASE x.axis " + " ".join(f"WHEN '{a}' THEN {w}" for _, a, w in dims.QUOTIENT_AXES) + " END"
_ORD = "CASE x.axis " + " ".join(f"WHEN '{a}' THEN {i}" for i, (_, a, _w) in enumerate(dims.QUOTIENT_AXES)) + " END"
WEIGHTS_SQL = AXES_SQL + f""",
 l AS (SELECT owner, source, x.axis AS axis, {_PILLARS} AS pillar, {_BASE} AS base, {_ORD} AS ord, x.v AS v FROM a WHERE x.v IS NOT NULL),
 r AS (SELECT *, CAST(round_even(base * 100.0::DOUBLE / sum(base) OVER (PARTITION BY owner, source, pillar), 0) AS INT) AS w0,
       row_number() OVER (PARTITION BY owner, source, pillar ORDER BY ord DESC) AS last FROM l),
 w AS (SELECT *, CAST(w0 + CASE WHEN last = 1 THEN 100 - sum(w0) OVER (PARTITION BY owner, source, pillar) ELSE 0 END AS INT) AS weight FROM r)"""


@query("pillar_rescale", WEIGHTS_SQL + " SELECT owner, source, pillar, axis, weight, round(weight * v, 8) AS points FROM w")
def _(t: Tables):
    s = SC.quotient(inputs(t), ["owner", "g_source"])
    a = SC.axis_scores(s, ["owner", "g_source"])
    return a.select("owner", F.col("g_source").alias("source"), "pillar", "axis", "weight", F.round(F.col("weight") * F.col("normalized_score"), 8).alias("points"))


@query("quotient_scores")
def _(t: Tables):
    s = SC.quotient(inputs(t), ["owner", "g_source"])
    return s.select("owner", "g_source", "quotient", "tier", F.transform("pillars", lambda p: p["score"]).alias("pillar_scores"),
                    F.flatten(F.transform("pillars", lambda p: p["not_applicable"])).alias("not_applicable"))


_EV = "least(1.0, tool_calls / 2000)"
_SHRINK = lambda x: f"(0.5::DOUBLE * (1 - {_EV}) + {_EV} * (1 - greatest(0.0, least(1.0, {x}))))"
CARD_SQL = INPUTS_SQL + f""",
 s AS (SELECT owner, source, greatest(total_sessions, 1) AS sess, *,
   {_mean(('0.6', 'least(1.0, tool_churn / greatest(minutes / 60.0::DOUBLE, 0.1) / 1000)'), ('0.4', f"CASE WHEN {_HAS('delegate')} THEN least(1.0, (cat_delegate + background) / greatest(0.3::DOUBLE * greatest(prompts, 1), 1)) END"))} AS ex,
   planning_eligible / nullif(planning_eligible + planning_unmeasured, 0) AS cov FROM i),
 p AS (SELECT *, {_mean(('0.3', 'least(1.0, CASE WHEN doing > 0 THEN explore / doing ELSE 0 END / 0.65::DOUBLE)'), ('0.3', f"CASE WHEN {_HAS('thinking')} THEN least(1.0, thinking_blocks / sess / 12) END"),
      ('(0.25::DOUBLE * coalesce(cov, 0))', f"CASE WHEN {_HAS('planning_signal')} AND planning_eligible > 0 THEN least(1.0, planning_sessions / planning_eligible / 0.3::DOUBLE) END"), ('0.15', 'CASE WHEN eligible >= 5 THEN least(1.0, planned / eligible / 0.5::DOUBLE) END'))} AS pl,
   0.3::DOUBLE * {_SHRINK('(tool_calls / sess - 2) / 8')} + 0.25::DOUBLE * {_SHRINK('(m_depth_p90 - 3) / 9')} + 0.2::DOUBLE * {_SHRINK('m_heavy_files / sess / 0.25::DOUBLE')}
   + 0.15::DOUBLE * least(1.0, (quality_skills + test_runs) / sess / 3) + 0.1::DOUBLE * {_SHRINK('tool_errors / tool_calls * 100 / 4 / 10')} AS en FROM s)"""


@query("scorecard_axes", CARD_SQL + " SELECT owner, source, round(ex, 5) AS execution, round(pl, 5) AS planning, round(en, 5) AS engineering FROM p")
def _(t: Tables):
    from loomtrace.functions.numbers import wsum
    d = SC.planning_evidence(inputs(t))
    subs = SC.scorecard_subs(d)
    return d.select("owner", F.col("g_source").alias("source"), *[
        F.round(wsum([(w, v, c) for _, w, v, c, _, _ in rows]), 5).alias(axis.lower()) for axis, rows in subs.items()])


@query("scorecard_breakdown")
def _(t: Tables):
    card = SC.scorecard(inputs(t), ["owner", "g_source"])
    return SC.breakdown(card, ["owner", "g_source"])


@query("combined_profile")
def _(t: Tables):
    i = with_rest(inputs(t))
    return CB.aggregate_profile(i, ["owner"]).withColumn("pillar_scores", F.map_values("pillar_scores"))


def with_rest(i: DataFrame) -> DataFrame:
    """Columns of the full scoring row that these signals do not cover."""
    have = set(i.columns)
    zero = ["shell_lines", "parallel_turns", "delegating_sessions", "toolsearch_calls", "knowledge_calls", "test_skills", "back_skills", "max_session_fanout", "m_depth_max",
            "tool_distinct", "knowledge_server_distinct", "parallel_session_share", "tool_entropy", "task_tool_calls"]
    return i.select("*", *[F.lit(0).alias(c) for c in zero if c not in have], F.lit("Bash").alias("top_tool"))


@query("pooled_planning", INPUTS_SQL + """
SELECT owner, CAST(sum(planning_sessions) AS BIGINT) AS planning_sessions, CAST(sum(planning_eligible) AS BIGINT) AS planning_eligible,
  CAST(sum(planning_unmeasured) AS BIGINT) AS planning_unmeasured, CASE WHEN sum(planning_eligible) > 0 THEN round(sum(planning_eligible) / (sum(planning_eligible) + sum(planning_unmeasured)), 6) END AS coverage,
  round(sum(tool_calls * CASE WHEN doing > 0 THEN explore / doing ELSE 0.0 END) / sum(tool_calls), 6) AS planning_ratio,
  round(CASE WHEN sum(prompts) > 0 THEN sum(CASE WHEN prompts > 0 THEN tool_calls - sidechain ELSE 0 END) / sum(prompts) ELSE avg((tool_calls - sidechain) / greatest(prompts, 1)) END, 6) AS actions_per_prompt FROM i GROUP BY 1""")
def _(t: Tables):
    p = CB.pooled_inputs(with_rest(inputs(t)), ["owner"])
    return p.select("owner", *[F.col(c).cast("bigint").alias(c) for c in ("planning_sessions", "planning_eligible", "planning_unmeasured")],
                    F.round("planning_coverage", 6).alias("coverage"), F.round("planning_ratio", 6).alias("planning_ratio"), F.round("actions_per_prompt", 6).alias("actions_per_prompt"))


@query("blended_scores")
def _(t: Tables):
    i = with_rest(inputs(t))
    s = SC.quotient(i, ["owner", "g_source", "scored_models", "scored_turns", "scored_top", "routing"])
    a = s.select("owner", F.col("g_source").alias("component"), "scored_models", "scored_turns", "scored_top", "routing", F.posexplode("pillars").alias("pi", "p"))
    a = a.select("owner", "component", F.when(F.col("component").isin("claude", "codex"), .65).otherwise(.35).alias("configured_weight"), F.col("p.pillar").alias("pillar"),
                 F.col("p.weight").alias("pillar_weight"), F.col("scored_models").alias("distinct_models"), (1 - F.col("scored_top") / F.col("scored_turns")).alias("offload_share"),
                 F.col("routing").alias("routing_state"), F.lit(None).cast("double").alias("routing_score"), F.lit(None).cast("double").alias("weight_scored"),
                 F.xxhash64("component").alias("component_order"), F.posexplode("p.axes").alias("axis_order", "x"))
    a = a.select("*", F.col("x.axis").alias("axis"), F.col("x.base_weight").alias("base_weight"), F.col("x.normalized_score").alias("normalized_score")).drop("x")
    return CB.blend(a, ["owner"])


@query("tool_rate_diagnostic", INPUTS_SQL + """
SELECT owner, source, m.metric AS metric, CAST(m.c AS BIGINT) AS count, round_even(m.c / tool_calls, 6) AS per_call, CAST(least(100, round_even(m.c / tool_calls * 100 / m.t, 0)) AS INTEGER) AS pct
FROM (SELECT *, unnest([{'metric': 'skills_total', 'c': skill_total, 't': 0.009::DOUBLE}, {'metric': 'review_skills', 'c': review_skills, 't': 0.004::DOUBLE}, {'metric': 'compounding_writes', 'c': compounding, 't': 0.0018::DOUBLE}]) AS m FROM i)
UNION ALL SELECT owner, source, 'orchestratable', orchestratable, round_even(orchestratable / tool_calls, 6), CAST(least(100, orchestratable * 100) AS INTEGER) FROM i
UNION ALL SELECT owner, source, k, 0, 0.0, CASE WHEN k = 'knowledge_calls' THEN 0 END FROM i, (VALUES ('knowledge_calls'), ('toolsearch_calls'), ('task_tool_calls')) AS v(k)""")
def _(t: Tables):
    d = SC.tool_rate_diagnostic(with_rest(inputs(t)), ["owner", "g_source"])
    return d.select("owner", F.col("g_source").alias("source"), "metric", "count", "per_call", "pct")


@query("insight_codes")
def _(t: Tables):
    keep = ["owner", "g_source"]
    i = with_rest(inputs(t))
    r = SC.insights(i, SC.quotient(i, keep), SC.scorecard(i, keep), keep)
    return r.select(*keep, F.transform("moves", lambda m: m["code"]).alias("moves"), F.transform("edges", lambda e: F.concat_ws(":", e["code"], e["severity"])).alias("edges"),
                    "leash", "tier", "thinnest_pillar")


@query("persona_labels", """
WITH h AS (SELECT user_id, hour(ts) AS h, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2),
 p AS (SELECT user_id, arg_max(h, (n, -f)) AS peak FROM h GROUP BY 1),
 d AS (SELECT user_id, count(*) FILTER (isodow(ts) >= 6) AS we, count(*) FILTER (isodow(ts) < 6) AS wd, avg(value) AS av, median(value) AS md,
       count(*) FILTER (event_type = 'signup') AS polite, count(*) AS prompts, count(*) FILTER (event_type = 'error' AND value > 100) AS q FROM events GROUP BY 1)
SELECT user_id, CASE WHEN peak >= 22 OR peak <= 4 THEN 'night' WHEN peak <= 11 THEN 'morning' WHEN peak <= 16 THEN 'afternoon' ELSE 'evening' END AS time_of_day,
 CASE WHEN we / 2 >= CASE WHEN wd = 0 THEN 1.0 ELSE wd / 5 END * 0.6::DOUBLE THEN 'every_day' ELSE 'weekdays' END AS week_shape, CASE WHEN av > md * 2 THEN 'two_gears' ELSE 'steady' END AS prompt_shape,
 CASE WHEN polite / prompts >= 0.12::DOUBLE THEN 'very_polite' WHEN polite / prompts >= 0.04::DOUBLE THEN 'polite' ELSE 'business' END AS politeness,
 CASE WHEN polite / prompts >= 0.05::DOUBLE OR q / prompts >= 0.04::DOUBLE THEN 'teammate' ELSE 'tool' END AS stance FROM d JOIN p USING (user_id)""")
def _(t: Tables):
    h = t.events.groupBy("user_id", F.hour("ts").alias("h")).agg(F.count(F.lit(1)).alias("n"), F.min("event_id").alias("f"))
    p = h.groupBy("user_id").agg(F.max_by("h", F.struct("n", (-F.col("f")).alias("f"))).alias("peak"))
    wd = F.weekday("ts")
    from loomtrace.operators.aggregates import count_if
    d = t.events.groupBy("user_id").agg(count_if(wd >= 5).alias("we"), count_if(wd < 5).alias("wd"), F.avg("value").alias("av"),
                                        count_if(F.col("event_type") == "signup").alias("polite"), F.count(F.lit(1)).alias("prompts"),
                                        count_if((F.col("event_type") == "error") & (F.col("value") > 100)).alias("q"))
    from loomtrace.operators.aggregates import depth_stats
    # the median comes from a histogram of values
    md = depth_stats(t.events.filter("value is not null").select("user_id", "value"), ["user_id"], "value").select("user_id", F.col("median").alias("md"))
    return SC.persona(d.join(p, "user_id").join(md, "user_id"), ["user_id"], "peak", "we", "wd", "av", "md", "polite", "prompts", "q")


def payloads(t: Tables) -> DataFrame:
    """Stored payload documents built from the scored signals, some of them not acceptable."""
    i = inputs(t)
    block = F.struct(
        F.col("g_source").alias("source"), F.struct("total_sessions", F.col("prompts").alias("total_prompts"), F.col("tool_calls").alias("tool_calls_total"), "thinking_blocks").alias("volume"),
        F.struct("active_hours", F.col("tool_churn").alias("tool_churn_edit_write")).alias("velocity"),
        F.struct(F.col("planning_ratio").alias("planning_ratio_explore_to_doing"), "error_recovery_ratio", F.col("api_errors").alias("api_errors_retries"), F.col("fanout").alias("fanout_median"),
                 F.col("planning_sessions").alias("planning_skill_sessions"), F.col("planning_eligible").alias("planning_skill_eligible_sessions"),
                 F.col("planning_unmeasured").alias("planning_skill_unmeasured_sessions"), F.col("planning_state").alias("planning_skill_session_scope_state"),
                 F.col("planning_share").alias("planning_skill_session_share"), F.col("planning_coverage").alias("planning_skill_session_coverage"),
                 F.col("eligible").alias("eligible_change_sessions"), F.col("test_covered").alias("test_covered_change_sessions"), F.col("planned").alias("planned_eligible_sessions"),
                 F.col("evidence").alias("evidence_eligible_sessions"), F.col("ordered_state").alias("ordered_facts_state")).alias("behavior"),
        F.struct(F.col("skill_distinct").alias("skills_distinct"), F.col("skill_total").alias("skills_total")).alias("stack"),
        F.struct(F.col("server_distinct").alias("mcp_servers_distinct"), F.col("cli_distinct").alias("clis_distinct"), F.col("cli_total").alias("cli_calls"), "mcp_calls").alias("tools"))
    entry = F.struct(F.col("g_source").alias("k"), F.struct(block.alias("window")).alias("v"))
    g = i.groupBy("owner").agg(F.map_from_entries(F.array_sort(F.collect_list(entry))).alias("scoring_inputs_by_source"))   # at most eight sources
    o = F.col("owner")
    text = lambda c: F.when(c.isNull(), F.lit("")).otherwise(c)
    head = F.concat(
        F.lit('{"scoring_inputs_version":'), F.when(o % 11 == 0, "7").when(o % 11 == 1, "true").when(o % 11 == 2, "20").when(o % 11 == 3, "10").otherwise("19"),
        F.lit(',"context":{'), F.when(o % 7 == 0, "").when(o % 7 == 1, '"window_months":null').when(o % 7 == 2, '"window_months":6').otherwise('"window_months":1'),
        F.lit('},'), F.when(o % 13 == 0, "").otherwise('"payload_features":{"version":1},'), F.lit('"scoring_inputs_by_source":'))
    return g.select("owner", F.concat(head, text(F.to_json("scoring_inputs_by_source")), F.lit("}")).alias("payload"))


@query("replay_gates", f"""
WITH o AS (SELECT DISTINCT {OWNER} AS owner FROM orders JOIN lineitem ON o_orderkey = l_orderkey)
SELECT owner, CASE WHEN owner % 13 = 0 THEN 'no_payload_features' WHEN owner % 11 = 1 THEN 'inputs_version_unusable' WHEN owner % 11 = 0 THEN 'inputs_version_before_dedup'
 WHEN owner % 11 = 2 THEN 'inputs_version_newer' WHEN owner % 11 = 3 THEN 'actions_basis_older' WHEN owner % 7 = 0 THEN 'window_undeclared' WHEN owner % 7 = 1 THEN 'window_not_integer'
 WHEN owner % 7 = 2 THEN 'window_differs' END AS reject_reason FROM o""")
def _(t: Tables):
    return CB.gate(payloads(t)).select("owner", "reject_reason")


@query("replayed_scores")
def _(t: Tables):
    return CB.replay(payloads(t), ["owner"])


@query("payload_sizes")
def _(t: Tables):
    p = payloads(t)
    return p.select("owner", F.octet_length("payload").alias("bytes"), P.over_budget(F.col("payload")).alias("rejected"))


@query("calibration_fingerprint")
def _(t: Tables):
    """Every scored row carries the fingerprint of the constants it was scored with."""
    return inputs(t).groupBy("g_source").agg(F.count(F.lit(1)).alias("rows")).withColumn("fingerprint", SC.fingerprint())


@query("score_disclosures")
def _(t: Tables):
    keep = ["owner", "g_source"]
    return AU.disclosures(SC.quotient(inputs(t), keep), keep)


@query("unscored_axes", AXES_SQL + """
SELECT owner, source, x.axis AS axis FROM a WHERE x.v IS NULL UNION ALL SELECT owner, source, 'Steering leverage' FROM i""")
def _(t: Tables):
    u = AU.unscored_axes(SC.quotient(inputs(t), ["owner", "g_source"]), ["owner", "g_source"])
    return u.withColumnRenamed("g_source", "source")


@query("saturation_points")
def _(t: Tables):
    i = inputs(t)
    return AU.saturation_threshold(i, ["owner", "g_source"], "cli_total")


@query("pooled_names", f"""
WITH j AS (SELECT {OWNER} AS owner, {SOURCE_SQL} AS g_source, 's' || (l_suppkey % 19) AS name, l_quantity < 40 AND o_custkey % 8 <> 3 AS named
           FROM lineitem JOIN orders ON o_orderkey = l_orderkey WHERE l_tax > 0.04),
     b AS (SELECT owner, g_source, count(DISTINCT name) AS n, bool_or(named) AS listed FROM j GROUP BY 1, 2),
     u AS (SELECT owner, count(DISTINCT name) FILTER (WHERE named) AS n FROM j GROUP BY 1)
SELECT u.owner, CAST(u.n + coalesce(sum(b.n) FILTER (WHERE NOT b.listed), 0) AS BIGINT) AS servers FROM u JOIN b USING (owner) GROUP BY u.owner, u.n""")
def _(t: Tables):
    """Servers by name over all sources of a developer; one source gives counts only."""
    src = F.element_at(F.array(*[F.lit(s) for s in dims.SOURCES]), (F.col("o_custkey") % 8 + 1).cast("int"))
    j = t.lineitem.filter("l_tax > 0.04").join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.expr(OWNER).alias("owner"), src.alias("g_source"), F.concat(F.lit("s"), F.col("l_suppkey") % 19).alias("name"), F.expr("l_quantity < 40 and o_custkey % 8 <> 3").alias("named"))
    per = j.groupBy("owner", "g_source", "name").agg(F.max("named").alias("named"))
    counts = per.groupBy("owner", "g_source").agg(F.count(F.lit(1)).alias("servers"))
    names = per.filter("named").select("owner", "g_source", F.lit("knowledge").alias("kind"), "name")
    return CB.united(counts, names, ["owner"], "knowledge", "servers")
