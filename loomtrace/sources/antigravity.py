"""Landed conversation steps, and exports of IDE conversations."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomtrace import dims
from loomtrace.functions import paths as P, tools as T
from loomtrace.operators import sequence as S
from loomtrace.schema import BLOCK, canonical, emit, result_block, text_block, thinking_block, tool_block
from loomtrace.sources import files as R
from loomtrace.sources.inputs import canonical_input, parse, with_fields

def aliased_args(obj: Column) -> Column:
    """Argument JSON with the common key names added where they are missing."""
    j = F.from_json(obj, "AbsolutePath string, TargetFile string, CommandLine string, CodeContent string, Query string, "
                         "file_path string, command string, content string")
    has_query = F.get_json_object(obj, "$.query").isNotNull()
    return with_fields(obj, {
        "file_path": F.when(j["file_path"].isNull(), F.coalesce(j["AbsolutePath"], j["TargetFile"])),
        "command": F.when(j["command"].isNull(), j["CommandLine"]),
        "content": F.when(j["content"].isNull(), j["CodeContent"]),
        "query": F.when(~has_query, j["Query"])})


def json_object(raw: Column) -> Column:
    return F.when(F.coalesce(R.kind(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False)), raw).otherwise(F.lit("{}"))


def mcp_name(name: Column) -> Column:
    """server::tool to mcp__server__tool."""
    server = F.substring_index(name, "::", 1)
    tool = F.regexp_replace(name, r"^.*?::", "")
    return F.when(name.contains("::") & (server != ""), F.concat(F.lit("mcp__"), server, F.lit("__"), tool)).otherwise(name)


def loaded_skill(path: Column) -> Column:
    vendored = P.forward(path).rlike(r"/node_modules/|/vendor/|/\.git/")
    return F.when(~vendored, P.skill_of_path(path))


def normalize_steps(steps: DataFrame, source: str = "antigravity") -> DataFrame:
    """Decoded steps (tenant_id, conversation, cwd, idx, step_type, ts, text, tool_name,
    args_json, model, input_tokens, output_tokens, cache_tokens) to events."""
    conv = ["tenant_id", "conversation"]
    s = S.carry_forward(steps.withColumn("__m", R.non_empty(F.col("model"))).drop("model"), conv, ["idx"],
                        F.shiftright(F.col("idx").cast("bigint"), 16), "__m", "model").drop("__m")
    raw = R.non_empty(F.col("tool_name"))
    mcp = mcp_name(raw)
    name = F.when(mcp.startswith("mcp__"), mcp).otherwise(T.lookup(raw, dims.ANTIGRAVITY_TOOLS, T.canonical(raw)))
    s = s.withColumn("name", F.when(raw.isNotNull(), name)).withColumn("obj", json_object(F.col("args_json")))
    s = s.withColumn("obj", aliased_args(F.col("obj")))
    s = s.withColumn("input", canonical_input(F.col("name"), F.col("obj"), parse(F.col("obj"))))
    txt = R.non_empty(F.col("text"))
    used = F.coalesce("input_tokens", F.lit(0)) + F.coalesce("output_tokens", F.lit(0)) + F.coalesce("cache_tokens", F.lit(0)) > 0
    usage = F.when(used, F.struct(*[F.coalesce(c, F.lit(0)).cast("bigint").alias(a) for c, a in (
        ("input_tokens", "input"), ("output_tokens", "output"), ("cache_tokens", "cache_read"))], F.lit(0).cast("bigint").alias("cache_creation")))
    content = F.concat(F.when(txt.isNotNull(), F.array(text_block(txt))).otherwise(F.array().cast(f"array<{BLOCK}>")),
                       F.when(raw.isNotNull(), F.array(tool_block(F.col("name"), F.col("input")))).otherwise(F.array().cast(f"array<{BLOCK}>")))
    keep = ["tenant_id", F.lit(source).alias("source"), F.col("conversation").alias("file_path"), F.col("conversation").alias("session_id"),
            "cwd", F.col("idx").cast("bigint").alias("ordinal"), "ts"]
    typ = F.col("step_type")
    skill = F.when(F.col("name") == "Read", loaded_skill(F.from_json("input", "file_path string")["file_path"]))
    return canonical(emit(
        s, keep,
        ((typ == 14) & txt.isNotNull(), {"type": F.lit("user"), "text": F.col("text")}),
        ((typ == 15) & ((F.size(content) > 0) | used), {"type": F.lit("assistant"), "model": F.col("model"), "content": content,
                                                       "usage": usage, "attribution_skill": skill}),
        ((typ == 17) | typ.isin(dims.ANTIGRAVITY_RESULT_STEPS), {"type": F.lit("user"), "content": F.array(result_block(typ == 17))})))


# ---- IDE export --------------------------------------------------------------------
STEP = "CORTEX_STEP_TYPE_"


def uri_path(c: Column) -> Column:
    return F.coalesce(F.regexp_replace(c, "^file://", ""), F.lit(""))


def normalize_export(docs: DataFrame, tenant: Column, source: str = "antigravity-ide") -> DataFrame:
    """[{cascade_id, steps}] documents to events; planner tool calls are ignored because the
    execution steps carry them."""
    convs = F.coalesce(F.try_variant_get(F.try_parse_json("value"), "$", "array<variant>"), F.array().cast("array<variant>"))
    c = docs.select(tenant.alias("tenant_id"), "file_path", F.posexplode(convs).alias("ci", "c")).filter(R.kind(F.col("c")).startswith("OBJECT"))
    conv = F.col("c")
    steps = F.coalesce(F.try_variant_get(conv, "$.steps", "array<variant>"), F.array().cast("array<variant>"))

    def hints(s: Column) -> Column:
        spec = F.map_values(F.coalesce(F.try_variant_get(s, "$.codeAction.actionSpec", "map<string,variant>"), F.create_map().cast("map<string,variant>")))
        blocks = F.concat(F.array(F.try_variant_get(s, "$.viewFile", "variant"), F.try_variant_get(s, "$.runCommand", "variant")), spec)

        def one(b: Column) -> Column:
            cwd = R.non_empty(R.get(b, "$.cwd"))
            cand = P.forward(F.coalesce(cwd, uri_path(R.first_of(R.get(b, "$.absolutePathUri"), R.get(b, "$.absoluteUri")))))
            return F.when((cand != "") & ~cand.contains("/.gemini/"), F.when(cwd.isNotNull(), cand).otherwise(P.dirname(cand)))
        return F.transform(blocks, one)

    found = F.filter(F.flatten(F.transform(steps, hints)), lambda x: x.isNotNull())
    e = c.select("tenant_id", "file_path", "ci", F.coalesce(R.non_empty(R.get(conv, "$.cascade_id")), F.lit("antigravity-ide")).alias("session_id"),
                 F.get(found, F.lit(0)).alias("cwd"), F.posexplode(steps).alias("si", "s"))
    s = F.col("s")
    t = F.regexp_replace(R.get(s, "$.type"), "^" + STEP, "")
    e = e.withColumn("margs", json_object(R.get(s, "$.mcpTool.toolCall.argumentsJson"))).withColumn("t", t).withColumn("ts", R.iso(R.get(s, "$.metadata.createdAt"))).withColumn(
        "ordinal", F.shiftleft(F.col("ci").cast("bigint"), 32) + F.col("si"))
    keep = ["tenant_id", F.lit(source).alias("source"), "file_path", "session_id", "cwd", "ordinal", "ts"]
    items = F.coalesce(F.try_variant_get(s, "$.userInput.items", "array<variant>"), F.array().cast("array<variant>"))
    prompt = F.array_join(F.filter(F.transform(items, lambda i: R.non_empty(R.get(i, "$.text"))), lambda x: x.isNotNull()), "\n")

    spec = F.try_variant_get(s, "$.codeAction.actionSpec", "map<string,variant>")
    inner = F.coalesce(F.try_variant_get(s, "$.codeAction.actionSpec.createFile", "variant"),
                       F.try_variant_get(s, "$.codeAction.actionSpec.editFile", "variant"), F.get(F.map_values(spec), F.lit(0)))
    created = R.kind(s, "$.codeAction.actionSpec.createFile").isNotNull()
    path = uri_path(R.first_of(R.get(inner, "$.absolutePathUri"), R.get(inner, "$.absoluteUri")))
    body = F.coalesce(R.first_of(R.get(inner, "$.instruction"), R.get(inner, "$.codeContent"), R.get(inner, "$.content")), F.lit(""))
    edit_in = F.when(created, F.to_json(F.struct(path.alias("file_path"), body.alias("content")))).otherwise(
        F.to_json(F.struct(path.alias("file_path"), body.alias("new_string"), F.lit("").alias("old_string"))))
    command = F.coalesce(R.first_of(R.get(s, "$.runCommand.commandLine"), R.get(s, "$.runCommand.proposedCommandLine")), F.lit(""))
    view = F.coalesce(*[F.try_variant_get(s, f"$.{k}", "variant") for k in ("viewFile", "viewFileOutline", "viewCodeItem")])
    seen = uri_path(R.first_of(R.get(view, "$.absolutePathUri"), R.get(view, "$.absoluteUri")))
    server, tool = F.coalesce(R.get(s, "$.mcpTool.serverName"), F.lit("")), F.coalesce(R.get(s, "$.mcpTool.toolCall.name"), F.lit(""))
    mcp = F.when(server != "", F.concat(F.lit("mcp__"), server, F.lit("__"), tool)).otherwise(mcp_name(tool))
    query = F.coalesce(R.first_of(*[R.get(s, f"$.{a}.{b}") for a in ("grepSearch", "find") for b in ("query", "pattern")]), F.lit(""))
    js = lambda k, c_: F.to_json(F.struct(c_.alias(k)))
    is_view = F.col("t").isin("VIEW_FILE", "VIEW_FILE_OUTLINE", "VIEW_CODE_ITEM")
    block = (F.when((F.col("t") == "PLANNER_RESPONSE") & R.truthy(s, "$.plannerResponse.thinking"), thinking_block(R.get(s, "$.plannerResponse.thinking")))
             .when((F.col("t") == "NOTIFY_USER") & R.truthy(s, "$.notifyUser.notificationContent"), text_block(R.get(s, "$.notifyUser.notificationContent")))
             .when(F.col("t") == "CODE_ACTION", tool_block(F.when(created, "Write").otherwise("Edit"), edit_in))
             .when(F.col("t") == "RUN_COMMAND", tool_block(F.lit("Bash"), js("command", command)))
             .when(is_view, tool_block(F.lit("Read"), js("file_path", seen)))
             .when(F.col("t") == "MCP_TOOL", tool_block(mcp, aliased_args(F.col("margs"))))
             .when(F.col("t") == "LIST_DIRECTORY", tool_block(F.lit("Glob"), F.lit("{}")))
             .when(F.col("t").isin("GREP_SEARCH", "FIND"), tool_block(F.lit("Grep"), js("query", query))))
    code = R.get(s, "$.runCommand.exitCode").try_cast("bigint")
    failed = ((F.col("t") == "RUN_COMMAND") & F.coalesce(code != 0, F.lit(False))) | (
        (F.col("t") == "MCP_TOOL") & F.coalesce(R.get(s, "$.status").contains("ERROR"), F.lit(False))) | (F.col("t") == "ERROR_MESSAGE")
    e = e.withColumn("b", block)
    return canonical(emit(
        e, keep,
        ((F.col("t") == "USER_INPUT") & (F.trim(prompt) != ""), {"type": F.lit("user"), "text": prompt}),
        (F.col("b").isNotNull(), {"type": F.lit("assistant"), "content": F.array("b"), "attribution_skill": F.when(is_view, loaded_skill(seen))}),
        (failed, {"sub": F.lit(1), "type": F.lit("user"), "content": F.array(result_block(F.lit(True)))})))


def index_summary(index: DataFrame, first: str, last: str, since: str | None = None, until: str | None = None) -> DataFrame:
    """Conversations whose [first, last] overlaps the window: count and bounds per tenant."""
    keep = F.lit(True)
    if until:
        keep = keep & (F.col(first).isNull() | (F.col(first) < F.lit(until).cast("timestamp")))
    if since:
        keep = keep & (F.col(last).isNull() | (F.col(last) >= F.lit(since).cast("timestamp")))
    return index.filter(keep).groupBy("tenant_id").agg(
        F.count(F.lit(1)).alias("conversations"), F.min(first).alias("first"), F.max(last).alias("last"))


def read_export(spark: SparkSession, paths, tenant: str = "local", since: str | None = None) -> DataFrame:
    return normalize_export(R.documents(spark, paths, since), F.lit(tenant))
