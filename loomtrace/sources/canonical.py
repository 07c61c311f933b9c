"""JSONL transcripts that already use the common event shape, and event windows."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from loomtrace import dims
from loomtrace.functions import paths as P
from loomtrace.schema import block, canonical
from loomtrace.sources import files as R


def read_jsonl(spark: SparkSession, paths, tenant: str = "local", source: str = "claude",
               since: str | None = None) -> DataFrame:
    return normalize_jsonl(R.lines(spark, paths, since), F.lit(tenant), F.lit(source))


def normalize_jsonl(rows: DataFrame, tenant: Column, source: Column) -> DataFrame:
    """Rows (file_path, ordinal, value) to events; unparseable or non-object lines are bad."""
    v = F.col("v")
    r = rows.withColumn("v", F.try_parse_json("value"))
    ok = F.coalesce(R.kind(v).startswith("OBJECT"), F.lit(False))
    own = R.kind(v, "$.isSidechain")
    blocks = F.transform(F.try_variant_get(v, "$.message.content", "array<variant>"), lambda b: block(
        type=R.get(b, "$.type"), text=R.get(b, "$.text"), thinking=R.get(b, "$.thinking"),
        tool_use_id=F.coalesce(R.get(b, "$.tool_use_id"), R.get(b, "$.id")),
        name=F.coalesce(R.get(b, "$.name"), F.lit("?")), input=R.object_json(b, "$.input"),
        is_error=F.when(R.kind(b, "$.is_error") == "BOOLEAN", R.get(b, "$.is_error", "boolean")),
        error_flag=R.truthy(b, "$.is_error")))
    has_message = R.is_object(v, "$.message")
    use = lambda k: R.count_int(R.get(v, f"$.message.usage.{k}"))
    out = r.select(
        tenant.alias("tenant_id"), source.alias("source"), "file_path", "ordinal",
        R.iso(R.get(v, "$.timestamp")).alias("ts"), R.truthy(v, "$.__synth_ts__").alias("synth_ts"),
        R.get(v, "$.sessionId").alias("session_id"), R.get(v, "$.agentId").alias("agent_id"),
        R.get(v, "$.uuid").alias("uuid"), R.get(v, "$.cwd").alias("cwd"), R.get(v, "$.type").alias("type"),
        F.when(own.isNull(), P.is_subagent_path(F.col("file_path")))
         .when(own == "BOOLEAN", R.get(v, "$.isSidechain", "boolean")).alias("is_sidechain"),
        R.truthy(v, "$.isMeta").alias("is_meta"), R.truthy(v, "$.isCompactSummary").alias("is_compact"),
        R.truthy(v, "$.isVisibleInTranscriptOnly").alias("is_transcript_only"),
        (R.truthy(v, "$.isApiErrorMessage") | R.truthy(v, "$.apiErrorStatus")).alias("api_error"),
        ((R.get(v, "$.type") == "system") & R.truthy(v, "$.retryAttempt")).alias("retry"),
        R.truthy(v, "$.__codex_usage__").alias("is_usage_only"),
        R.non_empty(R.get(v, "$.attributionSkill")).alias("attribution_skill"),
        F.try_variant_get(v, "$.injectedSkills", "array<string>").alias("injected_skills"),
        R.get(v, "$.origin.kind").alias("origin_kind"), R.get(v, "$.message.id").alias("message_id"),
        R.non_empty(R.get(v, "$.message.model")).alias("model"),
        F.when(has_message, F.struct(
            use("input_tokens").alias("input"), use("output_tokens").alias("output"),
            use("cache_read_input_tokens").alias("cache_read"),
            use("cache_creation_input_tokens").alias("cache_creation"))).alias("usage"),
        F.when(R.kind(v, "$.message.content") == "STRING", R.get(v, "$.message.content")).alias("text"),
        F.when(has_message, blocks).alias("content"),
        F.when(R.is_object(v, "$.toolUseResult"), F.struct(
            R.non_empty(R.get(v, "$.toolUseResult.agentId")).alias("agent_id"),
            R.non_empty(R.get(v, "$.toolUseResult.status")).alias("status"),
            R.non_empty(R.get(v, "$.toolUseResult.resolvedModel")).alias("resolved_model"),
            R.count_int(R.get(v, "$.toolUseResult.toolStats.editFileCount")).alias("edit_files"),
            R.get(v, "$.sourceToolAssistantUUID").alias("assistant_uuid"))).alias("tool_meta"),
        F.when(R.is_object(v, "$.routing"), F.struct(
            *[R.get(v, f"$.routing.{k}").alias(k) for k in (
                "provider", "parent_session", "child_session", "turn_id", "delegation_identity", "child_model")],
            *[R.truthy(v, f"$.routing.{k}").alias(k) for k in ("completed", "aborted", "lifecycle_known")],
            *[R.count_int(R.get(v, f"$.routing.{k}")).alias(k) for k in ("substantive_calls", "writes")])).alias("routing"),
        (~ok).alias("bad"))
    return canonical(out)


# ---- windows -----------------------------------------------------------------------
def in_window(events: DataFrame, since: str | None = None, until: str | None = None, ts: str = "ts") -> DataFrame:
    """since <= ts < until; undated events pass only when both bounds are open."""
    if since is None and until is None:
        return events
    cond = F.col(ts).isNotNull()
    if since is not None:
        cond = cond & (F.col(ts) >= F.lit(since).cast("timestamp"))
    if until is not None:
        cond = cond & (F.col(ts) < F.lit(until).cast("timestamp"))
    return events.filter(cond)


def window_bounds(since: str | None = None, until: str | None = None, last: str | None = None,
                  now: str | None = None) -> tuple[Column | None, Column | None]:
    """Day literals to bounds: until is an inclusive day; last=N[d|w|m] overrides both."""
    if last:
        n, unit = (last[:-1], last[-1]) if last[-1] in "dwm" else (last, "d")
        days = int(n) * {"d": 1, "w": 7, "m": 30}[unit]
        end = F.lit(now).cast("timestamp") if now else F.current_timestamp()
        return end - F.make_dt_interval(F.lit(days)), None
    lo = F.lit(since).cast("date").cast("timestamp") if since else None
    hi = F.date_add(F.lit(until).cast("date"), 1).cast("timestamp") if until else None
    return lo, hi


def admitted(events: DataFrame, minimum: int = dims.LOW_VOLUME_SESSIONS, include_low_volume: bool = False) -> DataFrame:
    """Events of sources with enough distinct sessions in the window."""
    from loomtrace.operators.aggregates import admitted_sources
    keep = admitted_sources(events.filter(~F.col("bad")), ["tenant_id"], "source", "session_id",
                            1 if include_low_volume else minimum)
    return events.join(keep.select("tenant_id", "source"), ["tenant_id", "source"], "left_semi")
