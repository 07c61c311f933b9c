"""Single-document transcripts: a messages array with thoughts and tool calls."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomtrace.functions import tools as T
from loomtrace.schema import BLOCK, canonical, emit, result_block, text_block, thinking_block
from loomtrace.sources import files as R
from loomtrace.sources.inputs import call_blocks


def _cwd_hint(tc: Column) -> Column:
    """Directory a tool call reveals: its directory, its file's directory, or a listing."""
    d = F.when(R.kind(tc, "$.args.dir_path") == "STRING", R.get(tc, "$.args.dir_path"))
    f = F.when(R.kind(tc, "$.args.file_path") == "STRING", R.get(tc, "$.args.file_path"))
    out = R.get(tc, "$.result[0].functionResponse.response.output")
    listed = F.trim(F.regexp_extract(F.coalesce(out, F.lit("")), r"(?m)^Directory:[ \t]*(/[^\r\n]*)", 1))
    return (F.when(d.startswith("/"), d)
            .when(f.startswith("/"), F.coalesce(R.non_empty(F.regexp_replace(f, "/[^/]*$", "")), F.lit("/")))
            .when(listed != "", listed))


def normalize(docs: DataFrame, tenant: Column, source: Column | None = None) -> DataFrame:
    source = F.lit("gemini") if source is None else source
    d = docs.select("file_path", F.explode(R.object_of(F.col("value"))).alias("v"))
    v = F.col("v")
    msgs = F.coalesce(F.try_variant_get(v, "$.messages", "array<variant>"), F.array().cast("array<variant>"))
    calls = lambda m: F.coalesce(F.try_variant_get(m, "$.toolCalls", "array<variant>"), F.array().cast("array<variant>"))
    hints = F.filter(F.transform(F.flatten(F.transform(msgs, calls)), _cwd_hint), lambda c: c.isNotNull())
    base = d.select(
        tenant.alias("tenant_id"), source.alias("source"), "file_path",
        R.first_of(R.get(v, "$.sessionId"), F.element_at(F.split("file_path", "/"), -1)).alias("session_id"),
        F.get(hints, F.lit(0)).alias("cwd"), F.posexplode(msgs).alias("ordinal", "m"))
    m = F.col("m")
    e = base.withColumn("ts", R.iso(R.get(m, "$.timestamp"))).withColumn(
        "role", R.first_of(R.get(m, "$.type"), R.get(m, "$.role"))).withColumn("txt", R.joined_texts(m, "$.content"))
    keep = ["tenant_id", "source", "file_path", "session_id", "cwd", "ordinal", "ts"]
    is_user = (F.col("role") == "user") & (F.col("txt") != "")
    is_bot = F.col("role").isin("gemini", "model", "assistant")

    def thought(t: Column) -> Column:
        s, desc = F.coalesce(R.get(t, "$.subject"), F.lit("")), F.coalesce(R.get(t, "$.description"), F.lit(""))
        return F.when(s != "", F.regexp_replace(F.concat(s, F.lit(": "), desc), r"^[: ]+|[: ]+$", "")).otherwise(desc)

    thoughts = F.filter(F.transform(F.coalesce(F.try_variant_get(m, "$.thoughts", "array<variant>"), F.array().cast("array<variant>")), thought),
                        lambda t: t != "")
    # a message's calls, and the raw name of each, are read once: nothing inside a lambda is shared
    e = e.withColumn("all_calls", calls(m)).withColumn("objects", F.filter("all_calls", lambda c: R.is_object(c, "$")))
    objects = F.col("objects")
    raw = F.transform(objects, lambda c: F.struct(R.first_of(R.get(c, "$.name"), F.lit("tool")).alias("name"), R.object_json(c, "$.args").alias("obj")))
    named = F.transform(raw, lambda c: F.struct(T.canonical(c["name"]).alias("name"), c["obj"].alias("obj")))
    content = F.concat(F.transform(thoughts, thinking_block),
                       F.when(F.col("txt") != "", F.array(text_block(F.col("txt")))).otherwise(
                           F.array().cast(f"array<{BLOCK}>")),
                       call_blocks(named))
    n = lambda k: R.count_int(R.get(m, f"$.tokens.{k}"))
    usage = F.struct(n("input").alias("input"), (n("output") + n("thoughts")).alias("output"), n("cached").alias("cache_read"),
                     F.lit(0).cast("bigint").alias("cache_creation"))

    def failed(c: Column) -> Column:
        return (F.lower(F.coalesce(R.get(c, "$.status"), F.lit(""))) == "error") | R.truthy(c, "$.result[0].functionResponse.response.error")

    results = F.transform(objects, lambda c: result_block(failed(c)))
    return canonical(emit(
        e, keep,
        (is_user, {"type": F.lit("user"), "text": F.col("txt")}),
        (is_bot, {"type": F.lit("assistant"), "model": R.non_empty(R.get(m, "$.model")), "content": content, "usage": usage}),
        (is_bot & (F.size("all_calls") > 0), {"sub": F.lit(1), "type": F.lit("user"), "content": results})))


def read(spark: SparkSession, paths, tenant: str = "local", since: str | None = None) -> DataFrame:
    return normalize(R.documents(spark, paths, since), F.lit(tenant))
