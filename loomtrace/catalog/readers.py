"""Queries that run the transcript readers on lines built from whole given tables.

Every line is written as its format writes it (to_json) and goes through the real reader; the SQL
works on the tables and never sees a line.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace.catalog.registry import Tables, query
from loomtrace.operators import aggregates as A
from loomtrace.plans import tables
from loomtrace.sources import antigravity, canonical, codex, cursor, gemini, opencode, pi

def obj(**parts) -> Column:
    return F.struct(*[v.alias(k) for k, v in parts.items()])


def stamp(seconds: Column) -> Column:
    """ISO text of a second count."""
    return F.date_format(F.timestamp_seconds(seconds), "yyyy-MM-dd'T'HH:mm:ss'Z'")


def as_lines(df: DataFrame, path: Column, ordinal: Column, value: Column) -> DataFrame:
    return df.select(path.alias("file_path"), ordinal.cast("bigint").alias("ordinal"), value.alias("value"))


def text_chars(blocks: Column) -> Column:
    return F.coalesce(F.aggregate(blocks, F.lit(0).cast("bigint"), lambda n, b: n + F.coalesce(F.length(b["text"]), F.lit(0)).cast("bigint")), F.lit(0).cast("bigint"))


@query("reader_canonical", """
SELECT CAST(conv_id AS VARCHAR) AS session_id, count(*) FILTER (role = 'user') AS prompts, CAST(coalesce(sum(length(text)) FILTER (role = 'user'), 0) AS BIGINT) AS prompt_chars,
  count(*) FILTER (role = 'assistant') AS replies, CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS reply_chars,
  count(*) FILTER (role = 'assistant' AND turn % 3 = 0) AS failed, CAST(coalesce(sum(turn) FILTER (role = 'assistant'), 0) AS BIGINT) AS input_tokens,
  count(*) FILTER (role NOT IN ('user', 'assistant')) AS bad, count(*) FILTER (role = 'assistant' AND turn % 5 = 0) AS sidechain
FROM conversations GROUP BY 1""")
def _(t: Tables):
    c = t.conversations
    user = F.to_json(obj(type=F.lit("user"), sessionId=F.col("conv_id").cast("string"), message=obj(role=F.lit("user"), content=F.col("text"))))
    block = F.array(obj(type=F.lit("text"), text=F.col("text"), is_error=F.lit(None).cast("boolean")), obj(type=F.lit("tool_result"), text=F.lit(None).cast("string"), is_error=F.col("turn") % 3 == 0))
    reply = F.to_json(obj(type=F.lit("assistant"), sessionId=F.col("conv_id").cast("string"), isSidechain=F.col("turn") % 5 == 0,
                          message=obj(role=F.lit("assistant"), model=F.lit("m-1"), usage=obj(input_tokens=F.col("turn"), output_tokens=F.lit(2)), content=block)))
    # other roles are written as lines that are no JSON; their session comes from the path
    value = F.when(F.col("role") == "user", user).when(F.col("role") == "assistant", reply).otherwise(F.concat(F.lit("{"), "text"))
    e = canonical.normalize_jsonl(as_lines(c, F.concat(F.lit("/p/"), F.col("conv_id").cast("string")), F.col("turn"), value), F.lit("local"), F.lit("claude"))
    sid = F.coalesce("session_id", F.element_at(F.split("file_path", "/"), -1))
    said = F.col("type") == "assistant"
    n = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    return e.groupBy(sid.alias("session_id")).agg(
        A.count_if((F.col("type") == "user") & F.col("text").isNotNull()).alias("prompts"), n(F.when(F.col("type") == "user", F.length("text"))).alias("prompt_chars"),
        A.count_if(said).alias("replies"), n(F.when(said, text_chars(F.col("content")))).alias("reply_chars"),
        A.count_if(said & F.exists("content", lambda b: F.coalesce(b["is_error"], F.lit(False)))).alias("failed"), n(F.when(said, F.col("usage.input"))).alias("input_tokens"),
        A.count_if(F.col("bad")).alias("bad"), A.count_if(said & F.col("is_sidechain")).alias("sidechain"))


@query("reader_pi", """
SELECT 'u' || user_id AS session_id, count(*) FILTER (event_type IN ('view', 'signup')) AS prompts, count(*) FILTER (event_type IN ('click', 'purchase')) AS tool_calls,
  count(*) FILTER (event_type = 'error' AND value > 50) AS failed, count(*) FILTER (event_type = 'error') AS results, '/w/' || user_id AS cwd,
  strftime(max(ts) FILTER (event_type <> 'error'), '%Y-%m-%d %H:%M:%S') AS last_ts
FROM events GROUP BY user_id""")
def _(t: Tables):
    e = t.events
    path = F.concat(F.lit("/pi/"), F.col("user_id").cast("string"), F.lit(".jsonl"))
    kind = F.col("event_type")
    when = F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSSSSS'Z'")
    said = F.when(kind.isin("view", "signup"), F.to_json(obj(type=F.lit("message"), timestamp=when, message=obj(role=F.lit("user"), content=F.col("props")))))
    call = F.to_json(obj(type=F.lit("message"), timestamp=when, message=obj(role=F.lit("assistant"), model=F.lit("m"), content=F.array(
        obj(type=F.lit("toolCall"), name=F.lit("bash"), arguments=obj(command=F.col("props")))))))
    result = F.to_json(obj(type=F.lit("message"), timestamp=when, message=obj(role=F.lit("toolResult"), isError=F.col("value") > 50)))
    rows = as_lines(e, path, F.col("event_id") + 1, F.coalesce(said, F.when(kind.isin("click", "purchase"), call).otherwise(result)))
    users = e.select("user_id").distinct()
    heads = as_lines(users, path, F.lit(0), F.to_json(obj(type=F.lit("session"), id=F.concat(F.lit("u"), F.col("user_id").cast("string")), cwd=F.concat(F.lit("/w/"), F.col("user_id").cast("string")))))
    ev = pi.normalize(rows.unionByName(heads), F.lit("local"))
    user, bot = F.col("type") == "user", F.col("type") == "assistant"
    result_of = F.get(F.filter("content", lambda b: b["type"] == "tool_result"), F.lit(0))
    return ev.groupBy("session_id").agg(
        A.count_if(user & F.col("text").isNotNull()).alias("prompts"), A.count_if(bot & F.exists("content", lambda b: (b["type"] == "tool_use") & (b["name"] == "Bash"))).alias("tool_calls"),
        A.count_if(user & F.coalesce(result_of["is_error"], F.lit(False))).alias("failed"), A.count_if(user & result_of.isNotNull()).alias("results"), F.max("cwd").alias("cwd"),
        F.date_format(F.max(F.when(bot | F.col("text").isNotNull(), F.col("ts"))), "yyyy-MM-dd HH:mm:ss").alias("last_ts"))


@query("reader_gemini", """
WITH l AS (SELECT doc_id, lang, unnest(string_split(text, chr(10))) AS line, unnest(range(len(string_split(text, chr(10))))) AS i FROM documents)
SELECT 'd' || doc_id AS session_id, count(*) FILTER (i % 2 = 0 AND line <> '') AS prompts, count(*) FILTER (i % 2 = 1) AS replies, CAST(sum(i) FILTER (i % 2 = 1) AS BIGINT) AS input_tokens,
  count(*) FILTER (i % 2 = 1 AND i % 3 = 0) AS failed, CAST(coalesce(sum(length(line)) FILTER (i % 2 = 1), 0) AS BIGINT) AS reply_chars,
  CASE WHEN max(i) >= 1 THEN '/src/' || min(lang) END AS cwd FROM l GROUP BY doc_id""")
def _(t: Tables):
    lines = F.transform(F.split("text", "\n"), lambda line, i: obj(
        type=F.when(i % 2 == 0, "user").otherwise("gemini"), timestamp=stamp(i + 1_750_000_000), content=line, model=F.lit("g-2"), tokens=obj(input=i, output=F.lit(1)),
        toolCalls=F.when(i % 2 == 1, F.array(obj(name=F.lit("read_file"), status=F.when(i % 3 == 0, "error").otherwise("success"),
                                                 args=obj(file_path=F.concat(F.lit("/src/"), F.col("lang"), F.lit("/a.py"))))))))
    # texts are dealt out before they are parsed: a file may hold few row groups
    docs = t.documents.select("doc_id", "lang", "text").repartition("doc_id").select(F.concat(F.lit("/g/"), F.col("doc_id").cast("string")).alias("file_path"), F.to_json(obj(sessionId=F.concat(F.lit("d"), F.col("doc_id").cast("string")), messages=lines)).alias("value"))
    ev = gemini.normalize(docs, F.lit("local"))
    user, bot = (F.col("type") == "user") & F.col("text").isNotNull(), F.col("type") == "assistant"
    # a session without a reply has no tool call to learn its folder from
    return ev.groupBy("session_id").agg(
        A.count_if(user).alias("prompts"), A.count_if(bot).alias("replies"), F.sum(F.when(bot, F.col("usage.input"))).cast("bigint").alias("input_tokens"),
        A.count_if(F.exists("content", lambda b: (b["type"] == "tool_result") & F.coalesce(b["is_error"], F.lit(False)))).alias("failed"),
        F.coalesce(F.sum(F.when(bot, text_chars(F.filter("content", lambda b: b["type"] == "text")))), F.lit(0)).cast("bigint").alias("reply_chars"), F.max("cwd").alias("cwd"))


@query("reader_codex_usage", """
WITH l AS (SELECT l_orderkey AS k, 'm-' || l_returnflag AS model, strftime(o_orderdate + INTERVAL 1 DAY * (20 * i), '%Y-%m') AS month, i, q,
             sum(q) OVER (PARTITION BY l_orderkey, i >= 4 ORDER BY i) AS total
           FROM (SELECT l_orderkey, l_returnflag, CAST(l_quantity AS BIGINT) AS q, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem)
           JOIN orders ON o_orderkey = l_orderkey),
 n AS (SELECT *, lead(model) OVER w AS next_model, lead(month) OVER w AS next_month FROM l WINDOW w AS (PARTITION BY k ORDER BY i)),
 s AS (SELECT * FROM n WHERE next_model IS NULL OR next_model <> model OR next_month <> month),
 d AS (SELECT k, model, month, greatest(total - coalesce(lag(total) OVER (PARTITION BY k ORDER BY i), 0), 0) AS delta FROM s),
 g AS (SELECT k, model, month, sum(delta) AS delta FROM d GROUP BY 1, 2, 3 HAVING sum(delta) > 0)
SELECT model, month, CAST(sum(delta) AS BIGINT) AS output, count(*) AS events FROM g JOIN orders ON o_orderkey = k GROUP BY 1, 2""")
def _(t: Tables):
    """Cumulative totals that start again at the fourth line of an order: a delta is never negative."""
    parts = F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice", "l_returnflag", F.col("l_quantity").cast("bigint").alias("q"))))
    orders = t.lineitem.groupBy("l_orderkey").agg(parts.alias("ps")).join(t.orders.select(F.col("o_orderkey").alias("l_orderkey"), "o_orderdate"), "l_orderkey")
    rows = orders.select("l_orderkey", "o_orderdate", "ps", F.posexplode("ps").alias("n", "p"))
    n = F.col("n")
    # the counter of a line: quantities since the last start, at most seven lines an order
    start = F.when(n >= 3, 4).otherwise(1)
    total = F.aggregate(F.slice("ps", start, n - start + 2), F.lit(0).cast("bigint"), lambda s, x: s + x["q"])
    when = F.date_format(F.col("o_orderdate").cast("timestamp") + F.make_dt_interval((n + 1) * 20), "yyyy-MM-dd'T'HH:mm:ss'Z'")
    rows = rows.select("l_orderkey", "n", "p", total.alias("total"), when.alias("when"))
    when, total = F.col("when"), F.col("total")
    turn = F.to_json(obj(type=F.lit("turn_context"), timestamp=when, payload=obj(model=F.concat(F.lit("m-"), F.col("p.l_returnflag")))))
    count = F.to_json(obj(type=F.lit("event_msg"), timestamp=when, payload=obj(type=F.lit("token_count"), info=obj(
        total_token_usage=obj(output_tokens=total, total_tokens=total)))))
    head = F.to_json(obj(type=F.lit("session_meta"), payload=obj(id=F.col("l_orderkey").cast("string"), cwd=F.lit("/r"))))
    ask = F.to_json(obj(type=F.lit("response_item"), payload=obj(type=F.lit("message"), role=F.lit("user"), content=F.array(obj(type=F.lit("input_text"), text=F.lit("go"))))))
    # an order's head and request stand before its first line
    line = lambda ordinal, value: obj(ordinal=ordinal.cast("bigint"), value=value)
    own = [line(n * 2 + 2, turn), line(n * 2 + 3, count)]
    parts = F.when(n == 0, F.array(line(F.lit(0), head), line(F.lit(1), ask), *own)).otherwise(F.array(*own))
    lines = rows.select("l_orderkey", F.explode(parts).alias("x"))
    lines = as_lines(lines, F.concat(F.lit("/c/"), F.col("l_orderkey").cast("string")), F.col("x.ordinal"), F.col("x.value"))
    ev = codex.normalize(lines, F.lit("local"), work=tables.work_dir(t.spark))
    return ev.filter("is_usage_only").groupBy("model", F.date_format("ts", "yyyy-MM").alias("month")).agg(F.sum("usage.output").cast("bigint").alias("output"), F.count(F.lit(1)).alias("events"))


@query("reader_opencode", """
WITH m AS (SELECT conv_id, turn, role, text, tenant FROM conversations, (VALUES ('a'), ('b')) AS v(tenant)),
 u AS (SELECT *, row_number() OVER (PARTITION BY tenant, conv_id ORDER BY turn // 2, turn) AS n FROM m WHERE role = 'assistant' OR (role = 'user' AND text <> ''))
SELECT tenant AS tenant_id, CAST(conv_id AS VARCHAR) AS session_id, CAST(n AS INTEGER) AS n, CASE WHEN role = 'user' THEN 'user' ELSE 'assistant' END AS type,
  CAST(CASE WHEN tenant = 'b' THEN length(text) + 1 ELSE length(text) END AS BIGINT) AS chars, conv_id % 2 = 1 AS is_sidechain FROM u""")
def _(t: Tables):
    """Two tenants with equal ids; two messages share each creation time."""
    both = t.conversations.select("*", F.explode(F.array(F.lit("a"), F.lit("b"))).alias("tenant"))
    cid = F.col("conv_id").cast("string")
    mid = F.concat(cid, F.lit("-"), F.lpad(F.col("turn").cast("string"), 9, "0"))
    ev = None
    for who in ("a", "b"):
        rows, tenant = both.filter(F.col("tenant") == who), F.lit(who)
        sessions = rows.select("conv_id").distinct().select(cid.alias("id"), F.lit("/r").alias("directory"), F.when(F.col("conv_id") % 2 == 1, "p").alias("parent_id"))
        made = F.floor(F.col("turn") / 2) + 1
        messages = rows.select(mid.alias("id"), cid.alias("session_id"), made.alias("time_created"), F.to_json(obj(id=mid, role=F.col("role"), time=obj(created=made))).alias("data"))
        text = F.when(F.lit(who == "b") & (F.col("text") != ""), F.concat("text", F.lit("!"))).otherwise(F.col("text"))
        parts = rows.select(mid.alias("message_id"), F.concat(F.lit("p"), mid).alias("id"), F.to_json(obj(id=F.concat(F.lit("p"), mid), type=F.lit("text"), text=text)).alias("data"))
        one = opencode.assemble(opencode.sessions_from_table(sessions, tenant, "db"), opencode.messages_from_table(messages, tenant, "db"), opencode.parts_from_table(parts, tenant, "db"))
        ev = one if ev is None else ev.unionByName(one)
    from pyspark.sql import Window
    n = F.row_number().over(Window.partitionBy("tenant_id", "session_id").orderBy("ordinal", "sub"))
    chars = F.when(F.col("type") == "user", F.length("text").cast("bigint")).otherwise(text_chars(F.col("content")))
    return ev.select("tenant_id", "session_id", n.alias("n"), "type", chars.alias("chars"), "is_sidechain")


@query("reader_antigravity", """
WITH o AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS i FROM events)
SELECT 'c' || user_id AS session_id, count(*) FILTER (event_type IN ('view', 'signup')) AS prompts, count(*) FILTER (event_type IN ('click', 'purchase')) AS replies,
  count(*) FILTER (event_type = 'error') AS failed, CAST(coalesce(sum(i) FILTER (event_type IN ('click', 'purchase')), 0) AS BIGINT) AS input_tokens,
  count(*) FILTER (event_type = 'click') AS reads, count(*) FILTER (event_type = 'purchase') AS edits FROM o GROUP BY user_id""")
def _(t: Tables):
    from pyspark.sql import Window
    kind = F.col("event_type")
    i = F.row_number().over(Window.partitionBy("user_id").orderBy("ts", "event_id"))
    bot = kind.isin("click", "purchase")
    steps = t.events.withColumn("idx", i).select(
        F.lit("t").alias("tenant_id"), F.concat(F.lit("c"), F.col("user_id").cast("string")).alias("conversation"), F.lit("/r").alias("cwd"), "idx",
        F.when(kind.isin("view", "signup"), 14).when(bot, 15).otherwise(17).alias("step_type"), "ts", F.when(kind.isin("view", "signup"), F.col("props")).alias("text"),
        F.when(kind == "click", "view_file").when(kind == "purchase", "replace_file_content").alias("tool_name"), F.to_json(obj(AbsolutePath=F.lit("/r/a.py"))).alias("args_json"),
        F.lit("g-3").alias("model"), F.when(bot, F.col("idx")).alias("input_tokens"), F.lit(0).alias("output_tokens"), F.lit(0).alias("cache_tokens"))
    ev = antigravity.normalize_steps(steps)
    named = lambda n: A.count_if((F.col("type") == "assistant") & F.exists("content", lambda b: (b["type"] == "tool_use") & (b["name"] == n)))
    return ev.groupBy("session_id").agg(
        A.count_if((F.col("type") == "user") & F.col("text").isNotNull()).alias("prompts"), A.count_if(F.col("type") == "assistant").alias("replies"),
        A.count_if((F.col("type") == "user") & F.exists("content", lambda b: F.coalesce(b["is_error"], F.lit(False)))).alias("failed"),
        F.coalesce(F.sum(F.when(F.col("type") == "assistant", F.col("usage.input"))), F.lit(0)).cast("bigint").alias("input_tokens"), named("Read").alias("reads"), named("Edit").alias("edits"))


@query("reader_cursor_store", """
SELECT 's' || (p_partkey % 97) AS session_id, count(*) FILTER (p_size % 3 = 0) AS prompts, count(*) FILTER (p_size % 3 <> 0) AS replies, count(*) FILTER (p_size % 3 = 1) AS reads,
  count(*) FILTER (p_size % 3 = 1 AND p_size % 2 = 0) AS failed, CAST(coalesce(sum(p_size) FILTER (p_size % 3 <> 0), 0) AS BIGINT) AS input_tokens,
  CAST(coalesce(sum(length(p_name)) FILTER (p_size % 3 = 0), 0) AS BIGINT) AS prompt_chars FROM part GROUP BY p_partkey % 97""")
def _(t: Tables):
    p = t.part.select("*", F.concat(F.lit("s"), (F.col("p_partkey") % 97).cast("string")).alias("sid"), F.concat(F.lit("b"), F.col("p_partkey").cast("string")).alias("bid"))
    kind = F.when(F.col("p_size") % 3 == 0, 1).otherwise(2)
    heads = p.groupBy("sid").agg(F.array_sort(F.collect_list(F.struct(F.col("bid").alias("bubbleId"), kind.alias("type")))).alias("h"))
    comp = heads.select(F.lit("t").alias("tenant_id"), F.concat(F.lit("composerData:"), "sid").alias("key"), F.to_json(obj(modelConfig=obj(modelName=F.lit("x-1")), fullConversationHeadersOnly=F.col("h"))).alias("value"))
    tool = F.when(F.col("p_size") % 3 == 1, obj(name=F.lit("read_file_v2"), params=F.to_json(obj(targetFile=F.lit("/r/a.py"))), status=F.when(F.col("p_size") % 2 == 0, "error").otherwise("completed")))
    bubble = obj(createdAt=F.lit("2026-01-02T03:04:05Z"), type=kind, text=F.col("p_name"), toolFormerData=tool, tokenCount=F.when(kind == 2, obj(inputTokens=F.col("p_size"), outputTokens=F.lit(0))))
    rows = p.select(F.lit("t").alias("tenant_id"), F.concat(F.lit("bubbleId:"), "sid", F.lit(":"), "bid").alias("key"), F.to_json(bubble).alias("value"))
    ev = cursor.normalize_kv(comp.unionByName(rows))
    user, bot = (F.col("type") == "user") & F.col("text").isNotNull(), F.col("type") == "assistant"
    return ev.groupBy("session_id").agg(
        A.count_if(user).alias("prompts"), A.count_if(bot).alias("replies"), A.count_if(bot & F.exists("content", lambda b: (b["type"] == "tool_use") & (b["name"] == "Read"))).alias("reads"),
        A.count_if((F.col("type") == "user") & F.exists("content", lambda b: F.coalesce(b["is_error"], F.lit(False)))).alias("failed"),
        F.coalesce(F.sum(F.when(bot, F.col("usage.input"))), F.lit(0)).cast("bigint").alias("input_tokens"), F.coalesce(F.sum(F.when(user, F.length("text"))), F.lit(0)).cast("bigint").alias("prompt_chars"))
