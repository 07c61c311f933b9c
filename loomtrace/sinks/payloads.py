"""Payload documents and partitioned results."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from loomtrace import dims
from loomtrace.operators.aggregates import rank_counts
from loomtrace.operators.planning import declared_months, over_budget
from loomtrace.plans.combine import REPLAY_FIELDS


def write_months(df: DataFrame, path: str) -> None:
    """Restate only the (tenant, month) partitions present in the data."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("tenant_id", "g_month").parquet(path)


def top_pairs(names: DataFrame, kind: str, k: int, out: str) -> DataFrame:
    """[[name, n], …] of the k most used names of one kind, per tenant and source (window)."""
    rows = names.filter((F.col("kind") == kind) & (F.col("g_month") == "*") & (F.col("g_source") != "*"))
    top = rank_counts(rows.select("tenant_id", "g_source", "name", "n", "first_seen"), ["tenant_id", "g_source"], k, "n", ["first_seen"])
    pairs = F.transform(F.array_sort(F.collect_list(F.struct("rank", "name", "n"))), lambda r: F.concat(
        F.lit("["), F.to_json(F.struct(r["name"].alias("x"))).substr(F.lit(6), F.length(F.to_json(F.struct(r["name"].alias("x")))) - 6), F.lit(","), r["n"].cast("string"), F.lit("]")))
    return top.groupBy("tenant_id", "g_source").agg(F.concat(F.lit("["), F.array_join(pairs, ","), F.lit("]")).alias(out))


def source_blocks(inputs: DataFrame, names: DataFrame | None = None) -> DataFrame:
    """(tenant_id, g_source, block): the stored scoring-input document of one source."""
    w = inputs.filter("g_month = '*' and g_source <> '*'")
    for kind, k, out in (("skill", 200, "skills_all"), ("model", 200, "models")):
        w = w.join(top_pairs(names, kind, k, out), ["tenant_id", "g_source"], "left") if names is not None else w.withColumn(out, F.lit("[]"))
    sections: dict[str, list] = {}
    for col, path in REPLAY_FIELDS.items():
        section, field = path.split(".")
        if col in w.columns:
            sections.setdefault(section, []).append(F.col(col).alias(field))
    sections["behavior"] += [F.col("ordered_state").alias("ordered_facts_state"), "sidechain_label_state", "no_tool_activity",
                             F.col("planning_state").alias("planning_skill_session_scope_state")]
    body = F.to_json(F.struct(F.col("g_source").alias("source"), *[F.struct(*v).alias(k) for k, v in sections.items() if k != "stack"]))
    stack = F.to_json(F.struct(*sections["stack"]))
    cut = lambda c: F.substring(c, F.lit(1), F.length(c) - 1)
    doc = F.concat(cut(body), F.lit(',"stack":'), cut(stack), F.lit(',"skills_all":'), F.coalesce("skills_all", F.lit("[]")), F.lit(',"models":'),
                   F.coalesce("models", F.lit("[]")), F.lit("}}"))
    return w.select("tenant_id", "g_source", doc.alias("block"))


def payload_rows(inputs: DataFrame, scored: DataFrame, names: DataFrame | None = None, since: str | None = None, until: str | None = None) -> DataFrame:
    """One JSON document per tenant: window scores with the inputs of every source.

    A tenant has at most as many source rows as there are source kinds, so the per-tenant
    array is small by construction.
    """
    months = (declared_months(F.lit(since).cast("timestamp"), F.lit(until).cast("timestamp")) if since and until else F.lit(None)).cast("int")
    per = source_blocks(inputs, names).groupBy("tenant_id").agg(F.array_sort(F.collect_list(F.struct("g_source", "block"))).alias("blocks"))
    top = scored.filter("g_month = '*' and g_source = '*'").select("tenant_id", F.to_json(F.struct("quotient", "tier", "pillars", "score_contract_id")).alias("profile"))
    entries = F.transform("blocks", lambda e: F.concat(F.lit('"'), e["g_source"], F.lit('":{"window":'), e["block"], F.lit("}")))
    doc = F.concat(F.lit('{"scoring_inputs_version":'), F.lit(str(dims.INPUTS_VERSION)), F.lit(',"payload_features":{"version":1},"context":{"window_months":'),
                   F.coalesce(months.cast("string"), F.lit("null")), F.lit('},"profile":'), F.col("profile"), F.lit(',"scoring_inputs_by_source":{'),
                   F.array_join(entries, ","), F.lit("}}"))
    return top.join(per, "tenant_id").select("tenant_id", doc.alias("payload"))


def split_by_budget(payloads: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(accepted, rejected): a document at the limit is rejected whole, never truncated."""
    big = over_budget(F.col("payload"))
    return payloads.filter(~big), payloads.filter(big).select("tenant_id", F.octet_length("payload").alias("bytes"))
