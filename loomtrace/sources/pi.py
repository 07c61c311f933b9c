"""JSONL transcripts with a session header row followed by message rows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomtrace.operators import sequence as S
from loomtrace.schema import canonical, emit, result_block
from loomtrace.sources import files as R
from loomtrace.sources.inputs import content_blocks, resolve_common

FILE = ["tenant_id", "source", "file_path"]


def normalize(lines: DataFrame, tenant: Column, source: Column | None = None) -> DataFrame:
    source = F.lit("pi") if source is None else source
    v = F.col("v")
    rows = lines.select(tenant.alias("tenant_id"), source.alias("source"), "file_path", "ordinal", F.try_parse_json("value").alias("v"))
    # one unreadable line makes the file unreadable
    broken = rows.filter(v.isNull()).select(*FILE).distinct()
    rows = rows.join(broken, FILE, "left_anti").withColumn("rtype", R.get(v, "$.type"))
    head = rows.filter("rtype = 'session'").groupBy(*FILE).agg(
        F.min_by(F.struct(R.non_empty(R.get(v, "$.id")).alias("id"), R.non_empty(R.get(v, "$.cwd")).alias("cwd")), "ordinal").alias("h"))
    m = rows.filter("rtype = 'message'").withColumn("role", R.get(v, "$.message.role")).withColumn(
        "ts", F.coalesce(R.iso(R.get(v, "$.timestamp")), R.millis(R.get(v, "$.message.timestamp"))))
    text = R.joined_texts(v, "$.message.content")
    keep = [*FILE, "ordinal", "ts"]
    role = F.col("role")
    ev = emit(
        m, keep,
        ((role == "user") & (text != ""), {"type": F.lit("user"), "text": text}),
        (role == "assistant", {"type": F.lit("assistant"), "model": R.non_empty(R.get(v, "$.message.model")),
                               "content": content_blocks(v, "$.message.content", resolve_common)}),
        (role == "toolResult", {"type": F.lit("user"), "content": F.array(result_block(R.truthy(v, "$.message.isError")))}))
    ev = S.join_keys(ev, head, FILE)
    return canonical(ev.withColumn("session_id", F.coalesce("h.id", R.base_id(F.col("file_path")))).withColumn("cwd", F.col("h.cwd")))


def read(spark: SparkSession, paths, tenant: str = "local", since: str | None = None) -> DataFrame:
    return normalize(R.lines(spark, paths, since), F.lit(tenant))
