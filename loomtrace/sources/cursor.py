"""Editor transcripts: JSONL copies, the key-value store, and how the two complement each other."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomtrace import dims
from loomtrace.functions import text as X, tools as T
from loomtrace.operators import joins as J, sequence as S
from loomtrace.schema import BLOCK, canonical, emit, result_block, text_block, thinking_block, tool_block
from loomtrace.sources import files as R
from loomtrace.sources.inputs import canonical_input, content_blocks, parse, with_fields

FILE = ["tenant_id", "source", "file_path"]
BLOCKS = f"array<{BLOCK}>"
CHURN_TOOLS = ["Edit", "Write", "MultiEdit"]


# ---- prompts -----------------------------------------------------------------------
def clean_prompt(raw: Column) -> Column:
    """Only the typed query when it is marked, otherwise the text without injected wrappers."""
    found = F.regexp_extract_all(raw, F.lit(r"(?si)<user_query>(.*?)</user_query>"), F.lit(1))
    bare = F.regexp_replace(raw, r"(?si)<(" + "|".join(dims.CURSOR_WRAPPERS) + r")>.*?</\1>", "")
    return X.strip_injections(F.when(F.size(found) > 0, F.array_join(found, "\n")).otherwise(bare))


def attached_skills(raw: Column) -> Column:
    lists = F.regexp_extract_all(raw, F.lit(r"(?si)<manually_attached_skills>(.*?)</manually_attached_skills>"), F.lit(1))
    names = F.transform(lists, lambda s: F.regexp_extract_all(
        s, F.lit(r'(?i)(?:fullPath|path)="[^"]*skills/([A-Za-z0-9_.-]+)/SKILL\.md"'), F.lit(1)))
    return F.array_distinct(F.flatten(names))


# ---- tools -------------------------------------------------------------------------
def tool_key(name: Column) -> Column:
    n = F.coalesce(R.non_empty(name), F.lit("tool"))
    return F.replace(F.lower(F.regexp_replace(n, r"(?<=[a-z0-9])(?=[A-Z])", "_")), F.lit("-"), F.lit("_"))


def flat_mcp(key: Column) -> Column:
    """mcp_server_tool keys: the first part is the server, the rest the tool."""
    parts = F.filter(F.split(F.regexp_replace(key, "^mcp_*", ""), "_"), lambda p: p != "")
    tool = F.array_join(F.slice(parts, 2, F.size(parts)), "_")
    head = F.coalesce(F.get(parts, F.lit(0)), F.lit("tool"))
    return F.when(F.size(parts) >= 2, F.concat(F.lit("mcp__"), T.canonical_server(head, tool), F.lit("__"), tool)).otherwise(
        F.concat(F.lit("mcp__cursor__"), head))


def tool_name(raw: Column, key: Column, j: Column) -> Column:
    mode = F.lower(F.coalesce(R.first_of(j["target_mode_id"], j["targetModeId"]), F.lit("")))
    server = F.coalesce(R.non_empty(j["server"]), F.lit("server"))
    tool = F.coalesce(R.first_of(j["toolName"], j["tool_name"]), F.lit("tool"))
    return (F.when((key == "switch_mode") & (mode == "plan"), "EnterPlanMode")
            .when(key == "call_mcp_tool", F.concat(F.lit("mcp__"), T.canonical_server(server, tool), F.lit("__"), tool))
            .when(F.coalesce(raw.startswith("mcp__"), F.lit(False)), raw)
            .when((key == "mcp") | key.startswith("mcp_"), flat_mcp(key))
            .otherwise(T.lookup(key, dims.CURSOR_TOOLS, T.canonical(key))))


def argument_object(key: Column, raw: Column, kind: Column) -> Column:
    """Arguments as JSON object text; a patch given as text is kept whole as added text."""
    path = F.trim(F.regexp_extract(raw, r"(?m)^\*{3}\s*(?:Update|Add|Create|Delete)\s+File:\s*(.+)$", 1))
    patch = F.to_json(F.struct(raw.alias("new_string"), F.lit("").alias("old_string"), path.alias("file_path")))
    parsed = F.coalesce(R.kind(F.try_parse_json(raw)).startswith("OBJECT"), F.lit(False))
    return F.when((kind == "STRING") & (key == "apply_patch"), patch).when(parsed, raw).otherwise(F.lit("{}"))


def tool_input(name: Column, obj: Column, j: Column) -> Column:
    g = lambda *ks: R.first_of(*[j[k] for k in ks])
    empty = F.lit("")
    file_fields = {
        "file_path": g("targetFile", "file_path", "path", "filePath", "relativeWorkspacePath"),
        "new_string": F.when((name == "Edit") & j["new_string"].isNull(), F.coalesce(g("codeEdit", "code", "content"), empty)),
        "old_string": F.when((name == "Edit") & j["old_string"].isNull(), F.coalesce(g("oldString"), empty)),
        "content": F.when((name == "Write") & j["content"].isNull(), F.coalesce(g("contents", "code"), empty))}
    return F.when(name.isin("Read", "Write", "Edit", "MultiEdit"), with_fields(obj, file_fields)).otherwise(canonical_input(name, obj, j))


def resolve(parts: Column) -> Column:
    """Name and input of tool calls, one array pass per dependency."""
    s = F.transform(parts, lambda b: b.withField("key", tool_key(b["raw_name"])))
    s = F.transform(s, lambda b: b.withField("obj", argument_object(b["key"], b["args"]["raw"], b["args"]["kind"])))
    s = F.transform(s, lambda b: b.withField("j", parse(b["obj"])))
    s = F.transform(s, lambda b: b.withField("name", tool_name(b["raw_name"], b["key"], b["j"])))
    return F.transform(s, lambda b: b.withField("input", tool_input(b["name"], b["obj"], b["j"])))


# ---- JSONL -------------------------------------------------------------------------
def path_session(path: Column) -> Column:
    """Session id from the path; subagent files belong to the parent session."""
    p = F.replace(path, F.lit("\\"), F.lit("/"))
    own = F.regexp_replace(F.element_at(F.split(p, "/"), -1), r"\.[^.]*$", "")
    parent = F.regexp_extract(p, r"/agent-transcripts/([^/]+)/", 1)
    return F.when(p.contains("/subagents/") & (parent != ""), parent).otherwise(own)


def normalize_jsonl(lines: DataFrame, tenant: Column, source: Column | None = None) -> DataFrame:
    """Events of JSONL copies.  Rows carry no time: the first event takes the file time, later
    ones the same instant marked as synthetic."""
    source = F.lit("cursor") if source is None else source
    v = F.col("v")
    r = lines.select(tenant.alias("tenant_id"), source.alias("source"), "file_path", "ordinal", "mtime", F.try_parse_json("value").alias("v"))
    is_obj = F.coalesce(R.kind(v).startswith("OBJECT"), F.lit(False))
    role = R.get(v, "$.role")
    # which row speaks first is decided from the part types alone, so this second reading is cheap
    parts = F.coalesce(F.try_variant_get(v, "$.message.content", "array<variant>"), F.array().cast("array<variant>"))
    visible = (F.exists(parts, lambda b: R.get(b, "$.type").isin("thinking", "toolCall", "tool_use") | (
        (R.get(b, "$.type") == "text") & R.truthy(b, "$.text"))) | ((R.kind(v, "$.message.content") == "STRING") & R.truthy(v, "$.message.content")))
    r = r.select("*", is_obj.alias("ok"), role.alias("role"), R.joined_texts(v, "$.message.content").alias("raw"), visible.alias("visible"))
    r = r.withColumn("prompt", F.when(F.col("role") == "user", clean_prompt(F.col("raw")))).withColumn(
        "skills", F.when(F.col("role") == "user", attached_skills(F.col("raw"))))
    is_user = (F.col("role") == "user") & ((F.col("prompt") != "") | (F.size("skills") > 0))
    first = r.filter(is_user | ((F.col("role") == "assistant") & F.col("visible"))).groupBy(*FILE).agg(F.min("ordinal").alias("first"))
    r = S.join_keys(r, first, FILE)
    r = r.withColumn("blocks", F.when(F.col("role") == "assistant", content_blocks(v, "$.message.content", resolve)))
    said = F.filter("blocks", lambda b: b["type"] != "tool_result")
    results = F.filter("blocks", lambda b: b["type"] == "tool_result")
    own_ts = R.iso(F.coalesce(R.get(v, "$.timestamp"), R.get(v, "$.message.timestamp")))
    side = F.replace("file_path", F.lit("\\"), F.lit("/")).contains("/subagents/")
    late = F.coalesce(F.col("ordinal") > F.col("first"), F.lit(False))
    keep = [*FILE, "ordinal", path_session(F.col("file_path")).alias("session_id"), side.alias("is_sidechain")]
    stamp = {"ts": F.coalesce(own_ts, F.col("mtime")), "synth_ts": own_ts.isNull() & late}
    ended = F.col("role").isNull() & (R.get(v, "$.type") == "turn_ended") & F.lower(R.get(v, "$.status")).isin("error", "failed")
    ev = emit(
        r, keep,
        (is_user, {**stamp, "type": F.lit("user"), "text": F.col("prompt"), "injected_skills": F.col("skills")}),
        (F.size(said) > 0, {**stamp, "type": F.lit("assistant"), "model": R.non_empty(R.get(v, "$.message.model")), "content": said}),
        (F.size(results) > 0, {**stamp, "sub": F.lit(1), "type": F.lit("user"), "content": results}),
        (ended, {**stamp, "type": F.lit("system"), "api_error": F.lit(True)}),
        (~F.col("ok"), {"bad": F.lit(True)}))
    return canonical(ev)


# ---- key-value store ---------------------------------------------------------------
def normalize_kv(kv: DataFrame, source: str = "cursor") -> DataFrame:
    """Landed rows (tenant_id, key, value): session headers joined to their bubbles."""
    v = F.col("v")
    comp = kv.filter(F.col("key").startswith("composerData:")).select(
        "tenant_id", F.regexp_replace("key", "^[^:]*:", "").alias("session_id"), F.try_parse_json("value").alias("v"))
    heads = comp.select("tenant_id", "session_id", R.non_empty(R.get(v, "$.modelConfig.modelName")).alias("model"),
                        F.posexplode(F.try_variant_get(v, "$.fullConversationHeadersOnly", "array<variant>")).alias("ordinal", "h"))
    h = F.col("h")
    heads = heads.withColumn("bubble", R.non_empty(R.get(h, "$.bubbleId"))).filter("bubble is not null").withColumn(
        "key", F.concat(F.lit("bubbleId:"), "session_id", F.lit(":"), "bubble"))
    bubbles = kv.filter(F.col("key").startswith("bubbleId:")).select("tenant_id", "key", F.try_parse_json("value").alias("v"))
    b = heads.join(bubbles, ["tenant_id", "key"]).filter(R.kind(v).startswith("OBJECT"))

    def think(x: Column) -> Column:
        return F.when(R.kind(x) == "STRING", R.get(x, "$")).otherwise(R.first_of(R.get(x, "$.text"), R.get(x, "$.thinking")))

    thoughts = F.concat(F.array(think(F.try_variant_get(v, "$.thinking", "variant"))),
                        F.transform(F.coalesce(F.try_variant_get(v, "$.allThinkingBlocks", "array<variant>"), F.array().cast("array<variant>")), think))
    thoughts = F.array_distinct(F.filter(thoughts, lambda x: x.isNotNull() & (x != "")))
    text = R.non_empty(R.get(v, "$.text"))
    raw = R.non_empty(R.get(v, "$.toolFormerData.name"))
    call = F.struct(raw.alias("raw_name"), F.struct(
        F.coalesce(R.get(v, "$.toolFormerData.params"), F.lit("{}")).alias("raw"),
        F.coalesce(R.kind(v, "$.toolFormerData.params"), F.lit("OBJECT<>")).alias("kind")).alias("args"))
    calls = F.transform(resolve(F.array(call)), lambda c: tool_block(c["name"], c["input"]))
    none = F.array().cast(BLOCKS)
    content = F.concat(F.transform(thoughts, thinking_block), F.when(text.isNotNull(), F.array(text_block(text))).otherwise(none),
                       F.when(raw.isNotNull(), calls).otherwise(none))
    status = F.lower(F.coalesce(R.non_empty(R.get(v, "$.toolFormerData.status")), F.lit("completed")))
    failed = F.when(raw.isNotNull(), F.when(status.isin("error", "failed"), F.lit(True)).when(status.isin("completed", "success", "done"), F.lit(False)))
    tin, tout = R.count_int(R.get(v, "$.tokenCount.inputTokens")), R.count_int(R.get(v, "$.tokenCount.outputTokens"))
    has_tok = (tin > 0) | (tout > 0)
    b = b.withColumn("content", content).withColumn("failed", failed).withColumn(
        "btype", F.coalesce(R.get(h, "$.type"), R.get(v, "$.type"))).withColumn("ts", R.iso(R.get(v, "$.createdAt")))
    raw_text = F.coalesce(R.non_empty(F.array_join(F.filter(F.transform("content", lambda x: x["text"]), lambda x: x.isNotNull()), "\n")), text, F.lit(""))
    keep = ["tenant_id", F.lit(source).alias("source"), F.concat(F.lit("kv:"), "session_id").alias("file_path"), "session_id",
            F.col("ordinal").cast("bigint").alias("ordinal"), "ts", F.lit(False).alias("is_sidechain")]
    usage = F.when(has_tok, F.struct(tin.alias("input"), tout.alias("output"), F.lit(0).cast("bigint").alias("cache_read"), F.lit(0).cast("bigint").alias("cache_creation")))
    b = b.withColumn("raw_text", F.when(F.col("btype") == "1", raw_text)).withColumn("prompt", clean_prompt(F.col("raw_text"))).withColumn(
        "skills", attached_skills(F.col("raw_text"))).withColumn("has_tok", has_tok)
    bot = F.col("btype") == "2"
    return canonical(emit(
        b, keep,
        ((F.col("btype") == "1") & ((F.col("prompt") != "") | (F.size("skills") > 0)), {"type": F.lit("user"), "text": F.col("prompt"), "injected_skills": F.col("skills")}),
        (bot & ((F.size("content") > 0) | F.col("has_tok")), {"type": F.lit("assistant"), "model": F.coalesce("model", F.when(F.col("has_tok"), "cursor")),
                                                             "content": F.col("content"), "usage": usage}),
        (bot & F.col("failed").isNotNull(), {"sub": F.lit(1), "type": F.lit("user"), "content": F.array(result_block(F.col("failed")))})))


# ---- the two copies ----------------------------------------------------------------
def workspaces(events: DataFrame, keys: list[str]) -> DataFrame:
    """Most-touched directory per key, ties to the deeper one; tool and temp paths left out."""
    blocks = events.select(*keys, F.explode("content").alias("b")).filter("b.type = 'tool_use'")
    inp = F.col("b.input")
    g = [F.get_json_object(inp, f"$.{k}") for k in ("path", "file_path", "targetFile", "filePath", "relativeWorkspacePath")]
    in_cmd = F.regexp_extract_all(F.coalesce(F.get_json_object(inp, "$.command"), F.lit("")), F.lit(r"""(/(?:Users|home)/[^\s"'`:]+)"""), F.lit(1))
    paths = F.concat(F.array_distinct(F.filter(F.array(*g), lambda p: p.isNotNull())), in_cmd)
    p = F.col("p")
    touched = blocks.select(*keys, F.explode(paths).alias("p")).filter(p.startswith("/") & ~p.rlike(dims.CURSOR_NOISE_PATTERN))
    base = F.element_at(F.split(p, "/"), -1)
    d = F.when(base.contains("."), F.regexp_replace(p, "/[^/]*$", "")).otherwise(p)
    n = touched.select(*keys, d.alias("d")).filter(F.col("d").startswith("/") & (F.col("d") != "/")).groupBy(*keys, "d").agg(F.count(F.lit(1)).alias("n"))
    depth = F.length("d") - F.length(F.replace("d", F.lit("/"), F.lit("")))
    return n.groupBy(*keys).agg(F.max_by("d", F.struct("n", depth, "d")).alias("workspace"))


def _rebuild(events: DataFrame, picked: Column, change) -> DataFrame:
    """Change tool blocks of the picked events as rows and put the events together again."""
    key = ["tenant_id", "source", "file_path", "ordinal", "sub"]
    e = events.withColumn("__pick", F.coalesce(picked, F.lit(False)))
    rows = e.filter("__pick").select(*key, "session_id", F.posexplode("content").alias("pos", "b"))
    done = change(rows).groupBy(*key).agg(F.array_sort(F.collect_list(F.struct("pos", "b"))).alias("__c"))
    back = e.filter("__pick").drop("content", "__pick").join(done, key).withColumn("content", F.transform("__c", lambda x: x["b"])).drop("__c")
    return canonical(e.filter("not __pick").drop("__pick").unionByName(canonical(back)))


def resolve_servers(events: DataFrame, servers: DataFrame) -> DataFrame:
    """Flat names such as server-tool become mcp__server__tool by longest known prefix.

    servers: (tenant_id, server_id, server_name); identifiers and friendly names both match.
    """
    known = servers.select("tenant_id", F.col("server_id").alias("prefix"), F.col("server_name").alias("label")).unionByName(
        servers.select("tenant_id", F.col("server_name").alias("prefix"), F.col("server_name").alias("label"))).filter("prefix <> ''").distinct()
    # tool blocks keep the recorded name in `text`
    is_flat = lambda b: (b["type"] == "tool_use") & b["text"].rlike("[-_]") & ~b["text"].startswith("mcp__") & (
        tool_key(b["text"]) != "call_mcp_tool") & (b["name"] != "EnterPlanMode")

    def change(rows: DataFrame) -> DataFrame:
        named = rows.withColumn("name", F.when(is_flat(F.col("b")), F.col("b.text")))
        m = J.longest_prefix(named.filter("name is not null").select("tenant_id", "name").distinct(), known, ["tenant_id"], "name", "prefix", "label")
        m = m.filter("server is not null").withColumn("tool", F.coalesce(R.non_empty(F.col("tool")), F.lit("tool")))
        full = F.concat(F.lit("mcp__"), T.canonical_server(F.col("server"), F.col("tool")), F.lit("__"), F.col("tool"))
        j = named.join(m.select("tenant_id", "name", full.alias("full")), ["tenant_id", "name"], "left")
        return j.withColumn("b", F.when(F.col("full").isNotNull(), F.col("b").withField("name", F.col("full"))).otherwise(F.col("b")))

    return _rebuild(events, F.exists("content", is_flat), change)


def prefer_store(jsonl: DataFrame, kv: DataFrame) -> DataFrame:
    """Union of both copies: the store wins, its sessions take workspace and edit texts from
    the JSONL twin; subagent files exist only as JSONL and are kept.

    Both inputs are read several times here; pass written tables, not unread transcripts."""
    ids = kv.select("tenant_id", "session_id").distinct()
    root = F.col("is_sidechain") == F.lit(False)
    twins = jsonl.filter(root).join(ids, ["tenant_id", "session_id"], "left_semi")
    rest = jsonl.filter(F.coalesce(~root, F.lit(True))).unionByName(jsonl.filter(root).join(ids, ["tenant_id", "session_id"], "left_anti"))
    kv = backfill_edits(kv, twins)
    ws = workspaces(twins, ["tenant_id", "session_id"])
    kv = kv.join(ws, ["tenant_id", "session_id"], "left").withColumn("cwd", F.coalesce("cwd", "workspace")).drop("workspace")
    own = workspaces(rest, FILE)
    rest = S.join_keys(rest, own, FILE).withColumn("cwd", F.coalesce("cwd", "workspace")).drop("workspace")
    return canonical(kv).unionByName(canonical(rest))


def backfill_edits(kv: DataFrame, twins: DataFrame) -> DataFrame:
    """The nth edit without text in the store takes the text of the nth edit of the twin."""
    keys = ["tenant_id", "session_id", "name"]
    text = lambda b, k: R.non_empty(F.get_json_object(b["input"], f"$.{k}"))
    blank = lambda b: b["name"].isin(CHURN_TOOLS) & text(b, "new_string").isNull() & text(b, "content").isNull() & text(b, "edits").isNull()
    source = (twins.select("tenant_id", "session_id", "file_path", "ordinal", "sub", F.posexplode("content").alias("pos", "b"))
              .filter(F.col("b.name").isin(CHURN_TOOLS))
              .select("tenant_id", "session_id", F.col("b.name").alias("name"), "file_path", "ordinal", "sub", "pos", F.col("b.input").alias("twin")))

    def change(rows: DataFrame) -> DataFrame:
        need = rows.filter(blank(F.col("b"))).withColumn("name", F.col("b.name"))
        order = ["file_path", "ordinal", "sub", "pos"]
        paired = S.nth_pairs(need, source.select(*keys, *[F.col(c).alias(f"t_{c}") for c in order], "twin"), keys, order, [f"t_{c}" for c in order],
                             R.chunk(), F.struct("t_file_path", R.chunk("t_ordinal")))
        b, twin = F.col("b"), F.col("twin")
        fields = {k: F.when(text(b, k).isNull(), F.get_json_object(twin, f"$.{k}")) for k in ("file_path", "new_string", "old_string", "content")}
        merged = with_fields(F.col("b.input"), fields)
        edits = F.get_json_object(twin, "$.edits")
        merged = F.when(edits.isNotNull() & text(b, "edits").isNull(), F.concat(
            F.substring(merged, F.lit(1), F.length(merged) - 1), F.when(merged == "{}", "").otherwise(","), F.lit('"edits":'), edits, F.lit("}"))).otherwise(merged)
        filled = paired.withColumn("b", F.when(twin.isNotNull(), b.withField("input", merged)).otherwise(b)).select(*rows.columns)
        return filled.unionByName(rows.filter(~F.coalesce(blank(F.col("b")), F.lit(False))))

    return _rebuild(kv, F.exists("content", blank), change)


def read_jsonl(spark: SparkSession, paths, tenant: str = "local", since: str | None = None) -> DataFrame:
    return normalize_jsonl(R.lines(spark, paths, since), F.lit(tenant))
