"""Tool-call classifiers."""
from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from loomtrace import dims


def contains_any(c: Column, needles: list[str]) -> Column:
    """True when any needle occurs anywhere in the text (substring match on purpose)."""
    return F.coalesce(c.rlike("|".join(re.escape(n) for n in needles)), F.lit(False))


def lookup(key: Column, table: dict[str, str], default: Column) -> Column:
    """Fixed alias table as a constant map; the key is evaluated once."""
    pairs = [F.lit(x) for kv in table.items() for x in kv]
    return F.coalesce(F.try_element_at(F.create_map(*pairs), key), default)


# ---- names -------------------------------------------------------------------------
def leaf(name: Column) -> Column:
    return F.lower(F.element_at(F.split(name, "__"), -1))


def is_mcp(name: Column) -> Column:
    return F.coalesce(name.startswith("mcp__"), F.lit(False))


def classify(name: Column) -> Column:
    """produce / plan / explore / execute / delegate / ask / other of a tool name."""
    return (
        F.when(name.isin(dims.WRITE_TOOLS), "produce")
        .when(name.isin(dims.PLAN_TOOLS), "plan")
        .when(name.isin(dims.READ_TOOLS + dims.DISCOVER_TOOLS), "explore")
        .when(name.isin(dims.EXEC_TOOLS), "execute")
        .when(name.isin(dims.DELEGATE_TOOLS), "delegate")
        .when(name.isin(dims.SKILL_TOOLS + dims.SCHEDULE_TOOLS), "execute")
        .when(name.isin(dims.ASK_TOOLS), "ask")
        .when(is_mcp(name), F.when(contains_any(leaf(name), dims.MCP_INSPECT_HINTS), "explore").otherwise("produce"))
        .otherwise("other")
    )


def is_substantive(name: Column) -> Column:
    l = F.replace(leaf(name), F.lit("-"), F.lit("_"))
    ceremony = name.isin(dims.PLAN_TOOLS + dims.SCHEDULE_TOOLS + dims.ASK_TOOLS + dims.PASSIVE_TOOLS)
    polling = l.isin(dims.POLL_LEAVES) | l.endswith("_status")
    work = classify(name).isin("produce", "explore", "execute", "delegate")
    return F.coalesce(~ceremony & ~polling & work, F.lit(False))


def canonical(name: Column) -> Column:
    """Lower-case and dotted names of other agents mapped to the common vocabulary."""
    n = F.when(F.coalesce(name, F.lit("")) == "", F.lit("tool")).otherwise(name)
    key = F.replace(F.lower(n), F.lit("-"), F.lit("_"))
    tail = F.element_at(F.split(key, r"\."), -1)
    return F.when(tail.isin(dims.AGENT_LEAVES), "Agent").otherwise(
        lookup(key, dims.TOOL_ALIASES, lookup(tail, dims.TOOL_ALIASES, n)))


# ---- MCP ---------------------------------------------------------------------------
def mcp_server_raw(name: Column) -> Column:
    """Second part of mcp__server__tool, NULL when absent or empty."""
    s = F.get(F.split(name, "__"), F.lit(1))
    return F.when(is_mcp(name) & (s != ""), s)


def mcp_tool(name: Column) -> Column:
    parts = F.split(name, "__")
    return F.when(F.size(parts) > 2, F.element_at(parts, -1)).otherwise(F.lit(""))


def canonical_server(server: Column, tool: Column) -> Column:
    """Plugin-wrapped servers collapse to the vendor named in the tool part."""
    t = F.lower(F.coalesce(tool, F.lit("")))
    doubled = F.regexp_extract(t, r"^([a-z][a-z0-9-]*)_\1(?:_|$)", 1)
    lead = F.regexp_extract(t, r"^([a-z][a-z0-9-]+?)_", 1)
    vendor = F.when(doubled != "", doubled).when(
        (lead != "") & ~lead.isin("plugin", "tool", "get", "list", "search"), lead).otherwise(server)
    return F.when(F.lower(server) == "plugin", vendor).otherwise(server)


def mcp_server(name: Column) -> Column:
    return canonical_server(mcp_server_raw(name), mcp_tool(name))


def mcp_subcategory(server: Column, tool: Column) -> Column:
    s, t = F.lower(F.coalesce(server, F.lit(""))), F.lower(F.coalesce(tool, F.lit("")))
    expr = F
    for cat, needles in dims.MCP_SERVER_HINTS.items():
        expr = expr.when(contains_any(s, needles), cat)
    for cat, needles in dims.MCP_TOOL_HINTS.items():
        expr = expr.when(contains_any(t, needles), cat)
    return expr.otherwise("other")


def is_knowledge_write(server: Column, tool: Column, subcategory: Column | None = None) -> Column:
    t = F.lower(F.coalesce(tool, F.lit("")))
    return (
        ((mcp_subcategory(server, tool) if subcategory is None else subcategory) == "knowledge")
        & ~contains_any(F.lower(server), dims.MCP_FETCH_ONLY_SERVERS)
        & ~contains_any(t, dims.MCP_INSPECT_HINTS)
        & contains_any(t, dims.MCP_WRITE_HINTS)
    )


def grounds_context(subcategory: Column, category: Column) -> Column:
    """Knowledge servers always arm grounding; project/data/design only on read calls."""
    return F.coalesce(
        (subcategory == "knowledge")
        | (subcategory.isin(dims.CONTEXT_SUBCATEGORIES) & (category == "explore")), F.lit(False))


# ---- skills ------------------------------------------------------------------------
def is_plan_skill(name: Column, extra: list[str] | None = None) -> Column:
    return contains_any(F.lower(name), dims.PLAN_SKILL_NEEDLES + [n.lower() for n in extra or []])


def is_knowledge_skill(name: Column, extra: list[str] | None = None) -> Column:
    return contains_any(F.lower(name), dims.KNOWLEDGE_SKILL_NEEDLES + [n.lower() for n in extra or []])


def skill_tail(name: Column) -> Column:
    after_colon = F.element_at(F.split(F.lower(name), ":"), -1)
    return F.element_at(F.split(after_colon, "/"), -1)


def is_review_skill(name: Column) -> Column:
    tail = skill_tail(name)
    named = contains_any(F.lower(name), dims.REVIEW_NEEDLES)
    planning = tail.isin(dims.PLANNING_REVIEW_TAILS) | tail.startswith("plan")
    reviewing = (
        tail.startswith("review-") | tail.startswith("judgment") | tail.startswith("jd-judge")
        | (tail == "review") | tail.endswith("-review")
        | tail.startswith("verif") | tail.endswith("-verify")
    )
    return F.coalesce(named | (~planning & reviewing), F.lit(False))


def is_task_skill(name: Column) -> Column:
    return F.coalesce(skill_tail(name).isin(dims.TASK_SKILLS), F.lit(False))


# ---- capabilities ------------------------------------------------------------------
def source_caps(source: Column) -> Column:
    """Capabilities of one source; unknown sources fail open to all of them."""
    s = F.lower(source)
    expr = F
    for name, caps in dims.SOURCE_CAPS.items():
        expr = expr.when(s == name, F.array(*[F.lit(c) for c in caps]))
    return expr.otherwise(F.array(*[F.lit(c) for c in dims.ALL_CAPS]))


def union_caps(sources: Column) -> Column:
    """Union of capabilities over an array of sources; no source means all."""
    merged = F.array_distinct(F.flatten(F.transform(sources, source_caps)))
    everything = F.array(*[F.lit(c) for c in dims.ALL_CAPS])
    return F.when(sources.isNull() | (F.size(sources) == 0), everything).otherwise(merged)


def planning_scope_measured(source: Column) -> Column:
    return F.coalesce(F.lower(source).isin(dims.IDENTITY_SOURCES), F.lit(False))


def cannot_label(source: Column) -> Column:
    """The source can dispatch agents but cannot tell their calls from the human's own."""
    return ~planning_scope_measured(source) & F.array_contains(source_caps(source), "delegate")
