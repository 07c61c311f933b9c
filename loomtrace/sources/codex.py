"""Rollout files: typed rows with cumulative token counts, turns and spawned children."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomtrace import dims
from loomtrace.functions import text as X, tools as T
from loomtrace.operators import sequence as S
from loomtrace.plans.tables import materialize
from loomtrace.schema import canonical, emit, result_block, text_block, thinking_block, tool_block
from loomtrace.sources import files as R
from loomtrace.sources.inputs import with_fields

TOKEN_FIELDS = ["input_tokens", "cached_input_tokens", "output_tokens", "reasoning_output_tokens"]
USAGE_SUB, LINK_SUB = 1_000_002, 1_000_001     # derived events sort after the row they come from
CALL_TYPES = ["function_call", "local_shell_call", "custom_tool_call", "web_search_call"]


def patch_sections(patch: Column) -> Column:
    """Per-file (file_path, new_string, old_string) of a patch text.

    The text is cut at its file directives, so one pass over each section suffices and
    nothing is shuffled.
    """
    text = F.replace(patch, F.lit("\r"), F.lit(""))
    body = F.when(text.rlike(r"(?s)(?:^|\n)\*\*\* Begin Patch\n"), F.element_at(
        F.split(F.element_at(F.split(text, r"(?:^|\n)\*\*\* Begin Patch\n", 2), 2), r"(?:^|\n)\*\*\* End Patch(?:\n|$)", 2), 1))
    cuts = F.split(body, r"(?m)^\*\*\* (?=(?:Update|Add|Delete) File: )")
    cuts = F.filter(cuts, lambda s: s.rlike(r"^(?:Update|Add|Delete) File: "))

    def section(s: Column) -> Column:
        rows = F.split(s, "\n")
        moved = F.element_at(F.regexp_extract_all(s, F.lit(r"(?m)^\*\*\* Move to: (.*)$"), F.lit(1)), -1)
        moves = F.regexp_count(s, F.lit(r"(?m)^\*\*\* Move to: "))
        path = F.regexp_extract(s, r"^(?:Update|Add|Delete) File: ([^\n]*)", 1)

        def side(mark: str) -> Column:
            # added or removed lines, without file headers and hunk marks
            kept = F.filter(F.slice(rows, F.lit(2), F.greatest(F.size(rows), F.lit(1))),
                            lambda l: l.startswith(mark) & ~l.startswith(mark * 3))
            return F.when(F.size(kept) > 0, F.concat(F.array_join(
                F.transform(kept, lambda l: F.substring(l, F.lit(2), F.length(l))), "\n"), F.lit("\n"))).otherwise("")
        return F.struct(F.when(moves > 0, moved).otherwise(path).alias("file_path"),
                        side("+").alias("new_string"), side("-").alias("old_string"))

    return F.coalesce(F.transform(cuts, section), F.array().cast(
        "array<struct<file_path:string,new_string:string,old_string:string>>"))


def namespaced_name(namespace: Column, tool: Column) -> Column:
    """mcp__server__tool from a namespace such as mcp__server__ and a short name."""
    body = F.regexp_replace(F.regexp_replace(namespace, "^mcp__", ""), "_+$", "")
    server = F.array_join(F.filter(F.split(body, "__"), lambda s: s != ""), "__")
    t = F.coalesce(R.non_empty(F.regexp_replace(tool, "^_+", "")), F.lit("tool"))
    return F.when(server != "", F.concat(F.lit("mcp__"), server, F.lit("__"), t)).otherwise(F.concat(F.lit("mcp__"), t))


def call_name(p: Column, args: Column) -> Column:
    typ, raw = R.get(p, "$.type"), R.get(p, "$.name")
    name = R.first_of(raw, typ, F.lit("tool"))
    ns = R.get(p, "$.namespace")
    leaf = F.element_at(F.split(F.replace(F.lower(name), F.lit("-"), F.lit("_")), r"\."), -1)
    return (F.when(typ == "web_search_call", "WebSearch")
            .when((typ == "custom_tool_call") & (name == "exec"), "exec")
            .when(name.startswith("mcp__"), name)
            .when(F.coalesce(ns.startswith("mcp__"), F.lit(False)), namespaced_name(ns, name))
            .when(leaf.isin(dims.CODEX_AGENT_LEAVES), "Agent")
            .when((typ == "local_shell_call") | name.isin(dims.CODEX_SHELL_NAMES), "Bash")
            .when(name.isin(dims.CODEX_EDIT_NAMES), "Edit")
            .when(name == "update_plan", "TodoWrite").when(name == "write_stdin", "BashOutput").otherwise(name))


PAYLOAD_ROWS = ["response_item", "session_meta"]


def rows_of(lines: DataFrame, tenant: Column, source: Column) -> DataFrame:
    """Decodable object rows; everything else is dropped silently.

    Marks and counters become columns; the payload `p` stays with items and session heads only.
    """
    v, p, rtype = F.col("v"), F.col("p"), F.col("rtype")
    r = lines.select("file_path", "ordinal", F.explode(R.object_of(F.col("value"))).alias("v")).select(
        "file_path", "ordinal", R.get(v, "$.type").alias("rtype"), R.get(v, "$.timestamp").alias("raw_ts"), F.try_variant_get(v, "$.payload", "variant").alias("p"))
    total = "$.info.total_token_usage"
    is_turn, is_event = rtype == "turn_context", rtype == "event_msg"
    spent = is_event & (R.get(p, "$.type") == "token_count") & R.truthy(p, f"{total}.total_tokens")
    return r.select(
        tenant.alias("tenant_id"), source.alias("source"), "file_path", "ordinal", "rtype", "raw_ts", R.iso(F.col("raw_ts")).alias("ts"),
        F.when(rtype.isin(PAYLOAD_ROWS), p).alias("p"), F.when(is_event, R.get(p, "$.type")).alias("event"),
        F.when(is_turn, R.non_empty(R.get(p, "$.model"))).alias("turn_model"), F.when(is_turn | is_event, R.non_empty(R.get(p, "$.turn_id"))).alias("turn_id"),
        F.when(spent, F.struct(*[R.count_int(R.get(p, f"{total}.{f}")).alias(f) for f in TOKEN_FIELDS])).alias("spent"))


def file_meta(rows: DataFrame) -> DataFrame:
    """Session id, working directory, parent thread and last model, one row per file."""
    p, o = F.col("p"), F.col("ordinal")
    meta = F.col("rtype") == "session_meta"
    has_sub = meta & R.kind(p, "$.source.subagent").isNotNull()
    thread = R.get(p, "$.source.subagent.thread_spawn.parent_thread_id")
    is_call = (F.col("rtype") == "response_item") & (R.get(p, "$.type") == "function_call")
    # narrow columns first: the payloads do not travel
    n = rows.select(
        "tenant_id", "source", "file_path", "ordinal", "turn_model", R.non_empty(F.col("raw_ts")).alias("raw_ts"),
        F.when(meta, R.non_empty(R.get(p, "$.id"))).alias("sid"), F.when(meta, R.non_empty(R.get(p, "$.cwd"))).alias("meta_cwd"),
        F.when(is_call, R.non_empty(R.get(F.try_parse_json(R.get(p, "$.arguments")), "$.workdir"))).alias("workdir"),
        F.when(has_sub & (F.trim(thread) != ""), thread).alias("parent"),
        F.when(has_sub & (F.trim(thread) != ""), R.non_empty(R.get(p, "$.source.subagent.thread_spawn.agent_path"))).alias("agent_path"),
        F.when(has_sub & F.coalesce(F.trim(thread) == "", F.lit(True)), F.coalesce(R.get(p, "$.source.subagent.other") == "guardian", F.lit(False))).alias("guardian"))

    def at(c: str, pick=F.max_by) -> Column:
        return pick(c, F.when(F.col(c).isNotNull(), o)).alias(c)

    g = n.groupBy("tenant_id", "source", "file_path").agg(
        at("sid"), at("meta_cwd"), at("workdir", F.min_by), at("parent"), at("agent_path"), F.coalesce(F.max("guardian"), F.lit(False)).alias("guardian"),
        F.coalesce(~F.min("guardian"), F.lit(False)).alias("invalid"), at("raw_ts", F.min_by), at("turn_model"))
    return g.select(
        "tenant_id", "source", "file_path", F.coalesce("sid", R.base_id(F.col("file_path"))).alias("session_id"),
        F.coalesce("meta_cwd", "workdir").alias("cwd"), "parent", "agent_path", F.col("raw_ts").alias("child_ts"), F.col("turn_model").alias("last_model"),
        F.when(~F.col("invalid"), F.col("parent").isNotNull() | F.col("guardian")).alias("is_sidechain"))


FILE = ["tenant_id", "source", "file_path"]


def with_model(rows: DataFrame, work: str | None = None) -> DataFrame:
    """Active model of every row: the last turn context before it."""
    return S.carry_forward(rows, FILE, ["ordinal"], R.chunk(), "turn_model", "model", work)


def usage_events(rows: DataFrame, meta: DataFrame, work: str | None = None) -> DataFrame:
    """Cumulative totals to deltas per (model, month), one usage-only event each.

    A total is settled when the model or the calendar month changes, and at the end; the
    delta is taken against the previously settled total and never negative.
    """
    snap = rows.filter("spent is not null").select(*FILE, "ordinal", "ts", "model", F.date_format("ts", "yyyy-MM").alias("month"), "spent.*")
    back = snap.withColumn("neg", -F.col("ordinal")).withColumn("__nx", F.struct("model", "month"))
    nx = S.previous_value(back, FILE, ["neg"], -R.chunk(), "__nx", "nxt", work and f"{work}/usage_next").drop("__nx", "neg")
    # a file's last model matters where its last total has none yet
    late = F.col("nxt").isNull() & F.col("model").isNull()
    nx = nx.filter(~late).withColumn("last_model", F.lit(None).cast("string")).unionByName(S.join_keys(nx.filter(late), meta.select(*FILE, "last_model"), FILE))
    is_last = F.col("nxt").isNull()
    moved = ~F.col("nxt.month").eqNullSafe(F.col("month"))
    switched = F.col("model").isNotNull() & ~F.col("nxt.model").eqNullSafe(F.col("model"))
    owner = F.when(F.col("model").isNotNull(), F.col("model")).when(is_last, F.col("last_model")).otherwise(F.col("nxt.model"))
    settled = nx.withColumn("owner", owner).filter((is_last | moved | switched) & F.col("owner").isNotNull())
    settled = settled.withColumn("__t", F.struct(*TOKEN_FIELDS))
    d = S.previous_value(settled, FILE, ["ordinal"], R.chunk(), "__t", "base", work and f"{work}/usage_settled")
    delta = [F.greatest(F.col(f) - F.coalesce(F.col(f"base.{f}"), F.lit(0)), F.lit(0)).alias(f) for f in TOKEN_FIELDS]
    g = d.select(*FILE, "ordinal", "ts", "month", "owner", *delta).groupBy(*FILE, "owner", "month").agg(
        *[F.sum(f).alias(f) for f in TOKEN_FIELDS], F.max_by("ts", "ordinal").alias("ts"), F.max("ordinal").alias("last"))
    g = g.filter(" + ".join(TOKEN_FIELDS) + " > 0")
    cached = F.col("cached_input_tokens")
    return g.select(
        *FILE, F.col("last").alias("ordinal"), F.lit(USAGE_SUB).alias("sub"), "ts", F.lit("assistant").alias("type"), F.lit(True).alias("is_usage_only"),
        F.col("owner").alias("model"), F.struct(
            F.greatest(F.col("input_tokens") - cached, F.lit(0)).alias("input"),
            (F.col("output_tokens") + F.col("reasoning_output_tokens")).alias("output"),
            cached.alias("cache_read"), F.lit(0).cast("bigint").alias("cache_creation")).alias("usage"))


def routing_links(rows: DataFrame, meta: DataFrame, calls: DataFrame) -> DataFrame:
    """One link per turn of a spawned child, plus one unknown link when a turn has no id."""
    is_turn = F.col("rtype") == "turn_context"
    life = (F.col("rtype") == "event_msg") & F.col("event").isin("task_complete", "turn_aborted")
    narrow = rows.filter(is_turn | life).select(*FILE, "ordinal", "raw_ts", "rtype", "event", "turn_id", "turn_model")
    child = S.join_keys(narrow, meta.filter("parent is not null").select(*FILE, "session_id", "parent", "agent_path", "child_ts"), FILE, "inner")
    tid = F.col("turn_id")
    marks = child.select(
        *FILE, "ordinal", "raw_ts", "turn_id", F.col("turn_model").alias("m"),
        F.when(life, F.when(F.col("event") == "task_complete", "completed").otherwise("aborted")).alias("life"),
        F.lit(0).cast("bigint").alias("sub"), F.lit(0).cast("bigint").alias("wr"))
    # calls belong to the turn context in force, which may carry no id
    seq = child.filter(is_turn).select(*FILE, "ordinal", F.struct(tid.alias("t")).alias("__turn"), F.lit(None).cast("string").alias("name"))
    use = calls.select(*FILE, "ordinal", F.lit(None).cast("struct<t:string>").alias("__turn"), "name")
    cur = S.carry_forward(seq.unionByName(use), FILE, ["ordinal"], R.chunk(), "__turn", "cur")
    used = cur.filter(F.col("name").isNotNull() & F.col("cur.t").isNotNull()).select(
        *FILE, "ordinal", F.lit(None).cast("string").alias("raw_ts"), F.col("cur.t").alias("turn_id"),
        F.lit(None).cast("string").alias("m"), F.lit(None).cast("string").alias("life"),
        T.is_substantive(F.col("name")).cast("bigint").alias("sub"), F.col("name").isin(dims.WRITE_TOOLS).cast("bigint").alias("wr"))
    allm = marks.unionByName(used)
    g = allm.groupBy(*FILE, "turn_id").agg(
        F.max_by("m", F.when(F.col("m").isNotNull(), F.col("ordinal"))).alias("child_model"),
        F.min_by("raw_ts", F.when(F.col("raw_ts").isNotNull(), F.col("ordinal"))).alias("raw_ts"),
        F.sum("sub").alias("sub"), F.sum("wr").alias("wr"),
        F.max(F.when(F.col("life") == "completed", 1).otherwise(0)).alias("done"),
        F.max(F.when(F.col("life") == "aborted", 1).otherwise(0)).alias("abort"), F.max("ordinal").alias("last"))
    info = meta.filter("parent is not null").select(*FILE, "session_id", "parent", "agent_path", "child_ts")
    known = S.join_keys(g.filter("turn_id is not null"), info, FILE, "inner")
    one = F.col("done") + F.col("abort") == 1

    def link(df: DataFrame, turn, model, done, abort, life_known, sub, wr, ts, ordinal) -> DataFrame:
        return df.select(
            *FILE, ordinal.alias("ordinal"), F.lit(LINK_SUB).alias("sub"), R.iso(ts).alias("ts"), F.lit("routing_link").alias("type"), F.struct(
                F.lit("openai").alias("provider"), F.col("parent").alias("parent_session"), F.col("session_id").alias("child_session"),
                turn.cast("string").alias("turn_id"), F.coalesce("agent_path", "session_id").alias("delegation_identity"),
                model.cast("string").alias("child_model"), done.alias("completed"), abort.alias("aborted"),
                life_known.alias("lifecycle_known"), sub.cast("bigint").alias("substantive_calls"), wr.cast("bigint").alias("writes")).alias("routing"))

    links = link(known, F.col("turn_id"), F.col("child_model"), one & (F.col("done") == 1), one & (F.col("abort") == 1), one,
                 F.col("sub"), F.col("wr"), F.coalesce("raw_ts", "child_ts"), F.col("last"))
    # a file without any identified turn, or with an unidentified mark, leaves one unknown link
    state = S.join_keys(info, g.groupBy(*FILE).agg(
        F.max(F.col("turn_id").isNull()).alias("gap"), F.max(F.col("turn_id").isNotNull()).alias("any")), FILE)
    lost = state.filter(F.coalesce("gap", F.lit(False)) | ~F.coalesce("any", F.lit(False)))
    no, zero = F.lit(False), F.lit(0)
    return links.unionByName(link(lost, F.lit(None), F.lit(None), no, no, no, zero, zero, F.col("child_ts"), F.lit(0).cast("bigint")))


def calls_of(rows: DataFrame) -> DataFrame:
    """Tool calls: name, input JSON and call id; a patch becomes one edit per file."""
    p = F.col("p")
    c = rows.filter((F.col("rtype") == "response_item") & R.get(p, "$.type").isin(CALL_TYPES))
    is_patch = (R.get(p, "$.type") == "custom_tool_call") & (R.get(p, "$.name") == "apply_patch")
    args = F.when(R.kind(F.try_parse_json(R.get(p, "$.arguments"))).startswith("OBJECT"), F.try_parse_json(R.get(p, "$.arguments")))
    c = c.withColumn("a", args).withColumn("name", F.when(is_patch, F.lit("Edit")).otherwise(call_name(p, F.col("a"))))
    a = F.col("a")
    raw_cmd = F.coalesce(R.non_empty(R.get(a, "$.cmd")), R.non_empty(R.get(a, "$.command")), R.get(p, "$.action"), F.lit(""))
    command = F.to_json(F.struct(X.argv_command(raw_cmd).alias("command")))
    edit = F.to_json(F.struct(R.first_of(R.get(a, "$.patch"), R.get(a, "$.content"), F.lit("")).alias("new_string"), F.lit("").alias("old_string"),
                              F.coalesce(R.first_of(R.get(a, "$.path"), R.get(a, "$.file")), F.lit("")).alias("file_path")))
    is_mcp = F.col("name").startswith("mcp__")
    plain = F.coalesce(F.to_json(a), F.lit("{}"))
    inp = (F.when(is_mcp, plain).when(F.col("name") == "Bash", command).when(F.col("name") == "Edit", edit)
           .when(F.col("name").isin("BashOutput", "WebSearch", "exec"), "{}").otherwise(plain))
    sections = F.when(is_patch, patch_sections(R.get(p, "$.input"))).otherwise(
        F.array(F.lit(None).cast("struct<file_path:string,new_string:string,old_string:string>")))
    c = c.withColumn("input", inp).withColumn("call_id", R.get(p, "$.call_id"))
    c = c.select("*", F.posexplode(sections).alias("part", "sec"))
    return c.withColumn("input", F.when(F.col("sec").isNotNull(), F.to_json("sec")).otherwise(F.col("input"))).withColumn(
        "call_id", F.when(F.col("sec").isNull(), F.col("call_id"))).drop("sec", "a")


def normalize(lines: DataFrame, tenant: Column, source: Column | None = None, work: str | None = None) -> DataFrame:
    """Rollout lines to events.

    Model, usage, links and calls each read the parsed rows; with a work folder the rows
    are parsed once, written with the model in force, and read back by column, and so is a row for each file.
    """
    source = F.lit("codex") if source is None else source
    rows = with_model(rows_of(lines, tenant, source), work and f"{work}/rollout_rows")
    meta = file_meta(rows)
    if work:
        meta = materialize(meta, f"{work}/rollout_files")
    p = F.col("p")
    item = rows.filter("rtype = 'response_item'").withColumn("pt", R.get(p, "$.type"))
    # the output of a call is an object or the JSON text of one
    item = item.withColumn("o", F.when(F.col("pt") == "function_call_output", F.coalesce(
        F.when(R.kind(p, "$.output") == "STRING", F.try_parse_json(R.get(p, "$.output"))), F.try_variant_get(p, "$.output", "variant"))))
    pt, o, call_id = F.col("pt"), F.col("o"), R.get(p, "$.call_id")
    said = item.withColumn("txt", F.when(pt.isin("message", "reasoning"), R.joined_texts(p, "$.content"))).withColumn("role", R.get(p, "$.role"))
    txt, role = F.col("txt"), F.col("role")
    success = F.when(R.kind(o, "$.success") == "BOOLEAN", ~R.get(o, "$.success", "boolean"))
    model = {"type": F.lit("assistant"), "model": F.col("model")}
    plain = emit(
        said, [*FILE, "ordinal", "ts"],
        ((pt == "message") & (role == "user") & (txt != "") & ~X.is_codex_injected(txt), {"type": F.lit("user"), "text": txt}),
        ((pt == "message") & (role == "assistant"), {**model, "content": F.filter(
            F.array(text_block(R.non_empty(txt))), lambda b: b["text"].isNotNull())}),
        (pt == "reasoning", {**model, "content": F.array(thinking_block(F.coalesce(R.non_empty(txt), R.get(p, "$.summary"), F.lit(""))))}),
        (pt == "function_call_output", {"type": F.lit("user"), "content": F.array(result_block(success, call_id))}))
    calls = calls_of(rows)
    # identities of spawned agents come from the matching call output
    outputs = item.filter("pt = 'function_call_output'").withColumn("call_id", call_id)
    ident = outputs.filter(R.kind(o).startswith("OBJECT") & F.col("call_id").isNotNull()).groupBy(*FILE, "call_id").agg(
        F.max_by(F.struct(R.first_of(R.get(o, "$.agent_id"), R.get(o, "$.task_name")).alias("identity"),
                          R.non_empty(R.get(o, "$.submission_id")).alias("submission")), "ordinal").alias("out"))
    direct = calls.filter("name <> 'Agent'")
    agent = S.join_keys(calls.filter("name = 'Agent'"), ident, FILE + ["call_id"])
    inp = F.try_parse_json("input")
    identity = F.coalesce(F.col("out.identity"), R.first_of(R.get(inp, "$.target"), R.get(inp, "$.task_name")))
    merged = with_fields(F.col("input"), {"_routing_identity": identity, "_routing_turn_id": F.col("out.submission")})
    agent = agent.withColumn("input", merged).drop("out")
    used = direct.unionByName(agent).select(
        *FILE, "ordinal", F.col("part").alias("sub"), "ts",
        F.lit("assistant").alias("type"), "model", F.array(tool_block(F.col("name"), F.col("input"), F.col("call_id"))).alias("content"))
    ev = plain
    for part in (used, usage_events(rows, meta, work), routing_links(rows, meta, calls)):
        ev = ev.unionByName(part, allowMissingColumns=True)
    # a file without a human prompt is an empty seed and contributes nothing
    seeded = plain.filter("type = 'user' and trim(text) <> ''").select(*FILE).distinct()
    ev = ev.join(seeded, FILE, "left_semi")
    ev = S.join_keys(ev, meta.select(*FILE, "session_id", "cwd", "is_sidechain"), FILE)
    return canonical(ev)


def read(spark: SparkSession, paths, tenant: str = "local", since: str | None = None, work: str | None = None) -> DataFrame:
    return normalize(R.lines(spark, paths, since), F.lit(tenant), work=work)
