"""Session / message / part stores, as JSON files or as landed tables."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from loomtrace.functions import tools as T
from loomtrace.schema import canonical, emit, result_block, text_block, thinking_block, tool_block
from loomtrace.sources import files as R
from loomtrace.sources.inputs import canonical_input, parse


# ids are unique inside one store of one tenant only
STORE = ["tenant_id", "store"]


def store_of() -> Column:
    """The store a file belongs to: the path in front of its storage folder."""
    return F.regexp_extract("file_path", "^(.*)/storage/", 1)


def parent_identity(v: Column, path: str, missing: Column) -> Column:
    """True for a child session, False for a root, NULL when the parent id is malformed."""
    kind = R.kind(v, path)
    return (F.when(kind.isNull(), missing).when(kind == "VOID", F.lit(False))
            .when((kind == "STRING") & (F.trim(R.get(v, path)) != ""), F.lit(True)))


def sessions_from_json(docs: DataFrame, tenant: Column) -> DataFrame:
    v = F.col("v")
    d = docs.withColumn("v", F.try_parse_json("value")).filter(R.kind(v).startswith("OBJECT"))
    return d.select(tenant.alias("tenant_id"), store_of().alias("store"), "file_path", F.coalesce(R.non_empty(R.get(v, "$.id")), R.base_id(F.col("file_path"))).alias("session_id"),
                    R.get(v, "$.directory").alias("cwd"), parent_identity(v, "$.parentID", F.lit(False)).alias("is_sidechain"))


def sessions_from_table(t: DataFrame, tenant: Column, store: str) -> DataFrame:
    """Landed session rows (id, directory, parent_id when the store has that column)."""
    if "parent_id" in t.columns:
        side = F.when(F.col("parent_id").isNull(), F.lit(False)).when(F.trim("parent_id") != "", F.lit(True))
    else:
        side = F.lit(None).cast("boolean")
    return t.select(tenant.alias("tenant_id"), F.lit(store).alias("store"), F.lit(store).alias("file_path"), F.col("id").alias("session_id"),
                    F.col("directory").alias("cwd"), side.alias("is_sidechain"))


def messages_from_json(docs: DataFrame, tenant: Column) -> DataFrame:
    """storage/message/<session>/<id>.json; path order tells messages of one time apart."""
    v = F.col("v")
    d = docs.withColumn("v", F.try_parse_json("value")).filter(R.kind(v).startswith("OBJECT"))
    return d.select(tenant.alias("tenant_id"), store_of().alias("store"), F.element_at(F.split("file_path", "/"), -2).alias("session_id"), R.get(v, "$.id").alias("message_id"), "v",
                    F.struct(F.lit(0.0).alias("t"), F.col("file_path").alias("id")).alias("tie"))


def messages_from_table(t: DataFrame, tenant: Column, store: str) -> DataFrame:
    """Landed message rows; (time_created, id) tells messages of one time apart."""
    v = F.try_parse_json("data")
    return t.withColumn("v", v).filter(R.kind(F.col("v")).startswith("OBJECT")).select(
        tenant.alias("tenant_id"), F.lit(store).alias("store"), "session_id", F.coalesce(R.get(F.col("v"), "$.id"), F.col("id").cast("string")).alias("message_id"), "v",
        F.struct(F.col("time_created").cast("double").alias("t"), F.col("id").cast("string").alias("id")).alias("tie"))


def parts_from_json(docs: DataFrame, tenant: Column) -> DataFrame:
    """storage/part/<message>/<id>.json"""
    v = F.col("v")
    d = docs.withColumn("v", F.try_parse_json("value")).filter(R.kind(v).startswith("OBJECT"))
    return d.select(tenant.alias("tenant_id"), store_of().alias("store"), F.element_at(F.split("file_path", "/"), -2).alias("message_id"), R.get(v, "$.id").alias("id"), "v")


def parts_from_table(t: DataFrame, tenant: Column, store: str) -> DataFrame:
    v = F.try_parse_json("data")
    return t.withColumn("v", v).filter(R.kind(F.col("v")).startswith("OBJECT")).select(
        tenant.alias("tenant_id"), F.lit(store).alias("store"), F.col("message_id").cast("string").alias("message_id"), F.coalesce(R.get(F.col("v"), "$.id"), F.col("id").cast("string")).alias("id"), "v")


def without_migrated(legacy: DataFrame, landed: DataFrame) -> DataFrame:
    """Legacy sessions that also exist in the landed store are dropped."""
    return legacy.join(landed.select("tenant_id", "session_id"), ["tenant_id", "session_id"], "left_anti")


def assemble(sessions: DataFrame, messages: DataFrame, parts: DataFrame, source: str = "opencode") -> DataFrame:
    p = F.col("v")
    typ = R.get(p, "$.type")
    status = R.get(p, "$.state.status")
    parts = parts.withColumn("name", T.canonical(R.get(p, "$.tool"))).withColumn("obj", R.object_json(p, "$.state.input"))
    parts = parts.withColumn("input", canonical_input(F.col("name"), F.col("obj"), parse(F.col("obj"))))
    row = parts.select(
        *STORE, "message_id", F.coalesce(R.get(p, "$.time.start").try_cast("double"), F.lit(0.0)).alias("start"),
        F.coalesce("id", F.lit("")).alias("id"),
        F.when(typ == "text", R.non_empty(R.get(p, "$.text"))).alias("txt"),
        F.when((typ == "text") & R.non_empty(R.get(p, "$.text")).isNotNull(), text_block(R.get(p, "$.text")))
         .when(typ == "reasoning", thinking_block(F.coalesce(R.get(p, "$.text"), F.lit(""))))
         .when(typ == "tool", tool_block(F.col("name"), F.col("input"))).alias("block"),
        F.when(typ == "tool", result_block(
            F.coalesce(~status.isin("completed"), F.lit(False)) | R.truthy(p, "$.state.error"))).alias("result"))
    # the parts of one message travel together: a message is one event
    per = row.groupBy(*STORE, "message_id").agg(F.array_sort(F.collect_list(F.struct("start", "id", "txt", "block", "result"))).alias("ps"))
    m = messages.join(per, [*STORE, "message_id"], "left").join(sessions, [*STORE, "session_id"])
    v, ps = F.col("v"), F.coalesce(F.col("ps"), F.array().cast(dict(per.dtypes)["ps"]))
    created = R.get(v, "$.time.created")
    m = m.withColumn("created", F.coalesce(created.try_cast("double"), F.lit(0.0))).withColumn("ts", R.millis(created))
    # order of messages inside a session: creation time, then store order; equal times are numbered
    same = Window.partitionBy(*STORE, "session_id", F.col("created").cast("bigint")).orderBy("tie.t", "tie.id")
    m = m.withColumn("nth", F.row_number().over(same) - 1)
    keep = ["tenant_id", F.lit(source).alias("source"), "file_path", "session_id", "cwd", "is_sidechain",
            F.col("created").cast("bigint").alias("ordinal"), "ts", "nth"]
    texts = F.filter(F.transform(ps, lambda x: x["txt"]), lambda t: t.isNotNull())
    summary = F.filter(F.array(R.non_empty(R.get(v, "$.summary.title")), R.non_empty(R.get(v, "$.summary.body"))), lambda t: t.isNotNull())
    prompt = F.array_join(F.when(F.size(texts) > 0, texts).otherwise(summary), "\n")
    role = R.get(v, "$.role")
    blocks = F.filter(F.transform(ps, lambda x: x["block"]), lambda b: b.isNotNull())
    results = F.filter(F.transform(ps, lambda x: x["result"]), lambda b: b.isNotNull())
    ev = emit(
        m, keep,
        ((role == "user") & (prompt != ""), {"sub": F.lit(0), "type": F.lit("user"), "text": prompt}),
        (role == "assistant", {"sub": F.lit(0), "type": F.lit("assistant"), "model": R.non_empty(R.get(v, "$.modelID")), "content": blocks}),
        ((role == "assistant") & (F.size(results) > 0), {"sub": F.lit(1), "type": F.lit("user"), "content": results}))
    return canonical(ev.withColumn("sub", (F.col("nth") * 2 + F.col("sub")).cast("int")))


def read_json(spark: SparkSession, root: str, tenant: str = "local", since: str | None = None) -> DataFrame:
    who = F.lit(tenant)
    s = sessions_from_json(R.documents(spark, f"{root}/storage/session/*/*.json", since), who)
    return assemble(s, messages_from_json(R.documents(spark, f"{root}/storage/message/*/*.json", since), who),
                    parts_from_json(R.documents(spark, f"{root}/storage/part/*/*.json", since), who))
