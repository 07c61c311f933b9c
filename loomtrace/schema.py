"""Canonical tables."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

BLOCK = ("struct<type:string,text:string,thinking:string,tool_use_id:string,name:string,"
         "input:string,is_error:boolean,error_flag:boolean>")
USAGE = "struct<input:bigint,output:bigint,cache_read:bigint,cache_creation:bigint>"
TOOL_META = "struct<agent_id:string,status:string,resolved_model:string,edit_files:bigint,assistant_uuid:string>"
ROUTING = ("struct<provider:string,parent_session:string,child_session:string,turn_id:string,"
           "delegation_identity:string,child_model:string,completed:boolean,aborted:boolean,"
           "lifecycle_known:boolean,substantive_calls:bigint,writes:bigint>")

EVENTS = {
    "tenant_id": "string", "source": "string", "file_path": "string",
    "ordinal": "bigint", "sub": "int",    # row of the file, event of the row
    "ts": "timestamp", "synth_ts": "boolean", "session_id": "string", "agent_id": "string",
    "uuid": "string", "cwd": "string", "type": "string",
    "is_sidechain": "boolean",            # NULL = identity unknown
    "is_meta": "boolean", "is_compact": "boolean", "is_transcript_only": "boolean",
    "api_error": "boolean", "retry": "boolean", "is_usage_only": "boolean",
    "attribution_skill": "string", "injected_skills": "array<string>", "origin_kind": "string",
    "message_id": "string", "model": "string", "usage": USAGE,
    "text": "string",                     # string-valued message content
    "content": f"array<{BLOCK}>",         # list-valued message content
    "tool_meta": TOOL_META, "routing": ROUTING, "bad": "boolean",
}
FLAGS = ["synth_ts", "is_meta", "is_compact", "is_transcript_only", "api_error", "retry", "is_usage_only", "bad"]

# tool input keys that operators read; everything else stays in the JSON text
TOOL_INPUT = ", ".join(f"{k} string" for k in (
    "file_path", "notebook_path", "path", "pattern", "query", "todos", "items", "tasks", "plan",
    "command", "skill", "subagent_type", "run_in_background", "url", "new_string", "old_string",
    "content", "new_source", "memory_id", "topic_key", "id", "entity", "name",
    "_routing_identity", "_routing_turn_id")) + ", edits array<struct<old_string: string, new_string: string>>"


def canonical(df: DataFrame) -> DataFrame:
    """Bring a reader's output to the canonical columns, filling what it does not carry."""
    have = set(df.columns)
    out = []
    for name, typ in EVENTS.items():
        c = F.col(name).cast(typ) if name in have else F.lit(None).cast(typ)
        if name in FLAGS:
            c = F.coalesce(c, F.lit(False))
        elif name == "sub":
            c = F.coalesce(c, F.lit(0))
        out.append(c.alias(name))
    return df.select(*out)


def block(**parts) -> "F.Column":
    """A content block; parts not given are NULL."""
    types = {"type": "string", "text": "string", "thinking": "string", "tool_use_id": "string", "name": "string",
             "input": "string", "is_error": "boolean", "error_flag": "boolean"}
    return F.struct(*[(parts[k] if k in parts else F.lit(None)).cast(t).alias(k) for k, t in types.items()])


def text_block(c):
    return block(type=F.lit("text"), text=c)


def thinking_block(c):
    return block(type=F.lit("thinking"), thinking=c)


def tool_block(name, input_json, tool_use_id=None):
    return block(type=F.lit("tool_use"), name=name, input=input_json,
                 **({"tool_use_id": tool_use_id} if tool_use_id is not None else {}))


def result_block(is_error, tool_use_id=None):
    return block(type=F.lit("tool_result"), is_error=is_error, error_flag=F.coalesce(is_error, F.lit(False)),
                 **({"tool_use_id": tool_use_id} if tool_use_id is not None else {}))


def emit(df: DataFrame, keep: list, *choices: tuple) -> DataFrame:
    """One pass from rows to events: every choice (condition, columns) that holds makes one event.

    The input is read and parsed once however many kinds of events a row can produce.
    """
    names = [n for n in EVENTS if any(n in cols for _, cols in choices)]
    options = [F.when(F.coalesce(cond, F.lit(False)), F.struct(*[
        (cols[n] if n in cols else F.lit(None)).cast(EVENTS[n]).alias(n) for n in names])) for cond, cols in choices]
    # not `F.filter` over the array: its argument would be evaluated without compiled code
    return df.select(*keep, F.explode(F.array(*options)).alias("__e")).filter("__e is not null").select("*", "__e.*").drop("__e")
