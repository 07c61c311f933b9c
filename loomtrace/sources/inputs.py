"""Tool calls of other agents brought to the common names and argument names.

Calls sit in arrays, so the work is laid out as a chain of array transforms: every step
puts what later steps need several times (parsed arguments, resolved name) into a struct,
which keeps each piece evaluated once per call.
"""
from __future__ import annotations

from pyspark.sql import Column, functions as F

from loomtrace.schema import block, tool_block
from loomtrace.sources import files as R

ARGS = ", ".join(f"`{k}` string" for k in (
    "command", "cmd", "script", "file_path", "filePath", "path", "targetFile", "relativeWorkspacePath",
    "content", "contents", "text", "code", "codeEdit", "old_string", "oldString", "old",
    "new_string", "newString", "new", "edits", "subagent_type", "subagentType", "agent_type",
    "target_mode_id", "targetModeId", "server", "toolName", "tool_name"))


def parse(obj: Column) -> Column:
    return F.from_json(obj, ARGS)


def with_fields(obj: Column, fields: dict[str, Column]) -> Column:
    """JSON object text with extra fields appended; NULL fields are left out.

    The typed reader of tool inputs takes the last key, so an appended field wins.
    """
    extra = F.to_json(F.struct(*[v.cast("string").alias(k) for k, v in fields.items()]))
    inner = F.transform(F.array(obj, extra), lambda t: F.regexp_replace(t, r"^\s*\{|\}\s*$", ""))
    return F.concat(F.lit("{"), F.array_join(F.filter(inner, lambda t: t != ""), ","), F.lit("}"))


def canonical_input(name: Column, obj: Column, j: Column) -> Column:
    """Common argument names for shell, file and agent tools; other inputs unchanged."""
    g = lambda *ks: R.first_of(*[j[k] for k in ks])
    empty = F.lit("")
    is_file = name.isin("Read", "Write", "Edit", "MultiEdit")
    agent = F.coalesce(g("subagent_type", "subagentType", "agent_type"), F.lit("general-purpose"))
    fields = {
        "command": F.when((name == "Bash") & j["command"].isNull(), F.coalesce(g("cmd", "script"), empty)),
        "file_path": F.when(is_file & j["file_path"].isNull(), g("filePath", "path")),
        "content": F.when((name == "Write") & j["content"].isNull(), F.coalesce(g("text"), empty)),
        "old_string": F.when((name == "Edit") & j["old_string"].isNull(), F.coalesce(g("oldString", "old"), empty)),
        "new_string": F.when((name == "Edit") & j["new_string"].isNull(), F.coalesce(g("newString", "new", "content"), empty)),
        "subagent_type": F.when(name == "Agent", F.when(agent.isin("generalPurpose", "unspecified"), "general-purpose").otherwise(agent)),
    }
    return F.when(is_file | name.isin("Bash", "Agent"), with_fields(obj, fields)).otherwise(obj)


def call_blocks(calls: Column) -> Column:
    """array<struct<name, obj>> to tool blocks."""
    parsed = F.transform(calls, lambda c: F.struct(c["name"].alias("name"), c["obj"].alias("obj"), parse(c["obj"]).alias("j")))
    return F.transform(parsed, lambda c: tool_block(c["name"], canonical_input(c["name"], c["obj"], c["j"])))


def content_blocks(v: Column, path: str, resolve) -> Column:
    """Message content (text or list of parts) to blocks.

    `resolve` turns array<struct<…, raw_name, raw, kind>> into the same array with the
    final `name` and `input` of tool calls.
    """
    def facts(b: Column) -> Column:
        args = F.when(R.truthy(b, "$.input"), F.struct(R.get(b, "$.input").alias("raw"), R.kind(b, "$.input").alias("kind"))).when(
            R.truthy(b, "$.arguments"), F.struct(R.get(b, "$.arguments").alias("raw"), R.kind(b, "$.arguments").alias("kind"))).otherwise(
            F.struct(F.lit("{}").alias("raw"), F.lit("OBJECT<>").alias("kind")))
        return F.struct(
            R.get(b, "$.type").alias("type"), R.non_empty(R.get(b, "$.text")).alias("text"),
            R.first_of(R.get(b, "$.thinking"), R.get(b, "$.text")).alias("thinking"), R.get(b, "$.name").alias("raw_name"),
            args.alias("args"), (R.truthy(b, "$.is_error") | R.truthy(b, "$.isError")).alias("failed"))

    parts = F.transform(F.coalesce(F.try_variant_get(v, path, "array<variant>"), F.array().cast("array<variant>")), facts)
    kept = F.filter(parts, lambda b: ((b["type"] == "text") & b["text"].isNotNull()) | b["type"].isin("thinking", "toolCall", "tool_use", "tool_result"))

    def finish(b: Column) -> Column:
        typ = b["type"]
        is_call = typ.isin("toolCall", "tool_use")
        out = F.when(is_call, "tool_use").otherwise(typ)
        is_result = typ == "tool_result"
        return block(type=out, text=F.when(typ == "text", b["text"]).when(is_call, b["raw_name"]),
                     thinking=F.when(typ == "thinking", F.coalesce(b["thinking"], F.lit(""))),
                     name=F.when(is_call, b["name"]), input=F.when(is_call, b["input"]),
                     is_error=F.when(is_result, b["failed"]), error_flag=F.when(is_result, b["failed"]))

    listed = F.transform(resolve(kept), finish)
    plain = F.filter(F.array(block(type=F.lit("text"), text=R.non_empty(R.get(v, path)))), lambda x: x["text"].isNotNull())
    return F.when(R.kind(v, path) == "STRING", plain).otherwise(listed)


def _plus(b: Column, **more: Column) -> Column:
    for k, c in more.items():
        b = b.withField(k, c)
    return b


def resolve_common(parts: Column) -> Column:
    from loomtrace.functions import tools as T
    s = F.transform(parts, lambda b: _plus(b, name=T.canonical(b["raw_name"]), obj=F.when(
        b["args"]["kind"].startswith("OBJECT"), b["args"]["raw"]).otherwise("{}")))
    s = F.transform(s, lambda b: _plus(b, j=parse(b["obj"])))
    return F.transform(s, lambda b: _plus(b, input=canonical_input(b["name"], b["obj"], b["j"])))
