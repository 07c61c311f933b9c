"""Report tables over canonical events: tokens, rhythm, months, projects, sources, evidence."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace import dims
from loomtrace.operators import aggregates as A
from loomtrace.plans import facts as FX

TOKENS = ("input", "output", "cache_read", "cache_creation")


def token_totals(b: DataFrame, by: list[str | Column]) -> DataFrame:
    """Tokens of assistant events per owner columns (model, month or both) and the turns that carry them.

    Usage-only events hold tokens of turns that are counted elsewhere, so they add no turn.
    """
    u = b.filter("type = 'assistant' and usage is not null")
    return u.groupBy(*by).agg(
        A.count_if(~F.col("is_usage_only")).alias("turns"),
        *[F.coalesce(F.sum(f"usage.{k}"), F.lit(0)).cast("bigint").alias(k) for k in TOKENS])


def model_usage(b: DataFrame, owner: list[str], k: int = 12) -> DataFrame:
    """Most used models of an owner: turns, all tokens and the share of turns, equal turns by name."""
    t = token_totals(b.filter("model is not null"), [*owner, "model"]).withColumn("tokens", F.col("input") + F.col("output") + F.col("cache_read") + F.col("cache_creation"))
    whole = t.groupBy(*owner).agg(F.sum("turns").alias("all_turns"))
    ranked = A.rank_counts(t.join(whole, owner), owner, k, "turns", ["model"])
    return ranked.select(*owner, "model", "rank", "turns", "tokens", F.when(F.col("all_turns") > 0, F.bround(F.col("turns") / F.col("all_turns"), 3)).otherwise(0.0).alias("share"))


def rhythm(b: DataFrame, owner: list[str]) -> DataFrame:
    """Prompts per hour of day and weekday (Mon … Sun); events with a made-up time are left out."""
    p = FX.prompts(b).filter("not bare_command and ts is not null")
    day = F.element_at(F.array(*[F.lit(d) for d in dims.DAY_NAMES]), F.weekday("ts") + 1)
    return p.groupBy(*owner, F.hour("ts").alias("hour"), day.alias("day")).agg(F.count(F.lit(1)).alias("prompts"))


def months(b: DataFrame, calls: DataFrame, owner: list[str]) -> DataFrame:
    """One row per owner and month: prompts, sessions, active days, tool calls, lines and tokens."""
    zero = lambda **kw: [kw.get(c, F.lit(0)).cast("bigint").alias(c) for c in ("prompts", "calls", "added", "removed", "input", "output")]
    key = [*owner, "month"]
    usage = b.filter("type = 'assistant' and usage is not null")
    parts = (FX.prompts(b).filter("not bare_command").select(*key, *zero(prompts=F.lit(1)))
             .unionByName(calls.select(*key, *zero(calls=F.lit(1), added=F.coalesce("added", F.lit(0)), removed=F.coalesce("removed", F.lit(0)))))
             .unionByName(usage.select(*key, *zero(input=F.col("usage.input"), output=F.col("usage.output")))))
    sums = parts.groupBy(*key).agg(*[F.sum(c).alias(c) for c in ("prompts", "calls", "added", "removed", "input", "output")])
    # sessions and days first become distinct rows, so no task holds the set of an owner
    seen = b.filter("ts is not null and not synth_ts")
    days = seen.select(*key, F.to_date("ts").alias("d")).distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("active_days"))
    sessions = b.filter("session_id is not null").select(*key, "source", "session_id").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("sessions"))
    return FX.S.join_keys(FX.S.join_keys(sums, days, key), sessions, key).fillna(0, ["active_days", "sessions"])


def projects(b: DataFrame, calls: DataFrame, owner: list[str]) -> DataFrame:
    """Events, tool calls and sessions per project, named by the last part of its folder."""
    name = F.element_at(F.split(F.regexp_replace("cwd", r"[/\\]+$", ""), r"[/\\]"), -1)
    e = b.filter("cwd <> ''").withColumn("project", name)
    n = e.groupBy(*owner, "project").agg(F.count(F.lit(1)).alias("events"))
    s = e.filter("session_id is not null").select(*owner, "project", "source", "session_id").distinct().groupBy(*owner, "project").agg(F.count(F.lit(1)).alias("sessions"))
    c = calls.filter("cwd <> ''").withColumn("project", name).groupBy(*owner, "project").agg(F.count(F.lit(1)).alias("calls"))
    return FX.S.join_keys(FX.S.join_keys(n, s, [*owner, "project"]), c, [*owner, "project"]).fillna(0, ["sessions", "calls"])


def sources(b: DataFrame, calls: DataFrame, owner: list[str]) -> DataFrame:
    """Sessions, prompts, tool calls and active hours per source, and the share of each."""
    key = [*owner, "source"]
    s = b.filter("session_id is not null").select(*key, "session_id").distinct().groupBy(*key).agg(F.count(F.lit(1)).alias("sessions"))
    p = FX.prompts(b).filter("not bare_command").groupBy(*key).agg(F.count(F.lit(1)).alias("prompts"))
    c = calls.groupBy(*key).agg(F.count(F.lit(1)).alias("calls"))
    real = b.filter("ts is not null and not synth_ts and session_id is not null")
    h = FX.S.union_of_buckets(FX.S.activity_buckets(real, [*key, "session_id"], "ts", dims.GAP_CAP_S), key, ["session_id"], dims.GAP_CAP_S).select(*key, (F.col("active_s") / 3600.0).alias("hours"))
    every = s
    for part in (p, c, h):
        every = FX.S.join_keys(every, part, key)
    every = every.fillna(0, ["prompts", "calls", "hours"])
    names = ("sessions", "prompts", "calls", "hours")
    whole = every.groupBy(*owner).agg(*[F.sum(n).alias(f"all_{n}") for n in names])
    share = [F.when(F.col(f"all_{n}") > 0, F.bround(F.col(n) / F.col(f"all_{n}"), 3)).otherwise(0.0).alias(f"{n}_share") for n in names]
    return every.join(whole, owner).select(*key, *names, *share)


def evidence_months(monthly: DataFrame, owner: list[str], today: str, n: int = dims.SELF_HEAL_MONTHS) -> DataFrame:
    """The last n calendar months of an owner; months without a row are present and marked missing."""
    from loomtrace.operators.planning import month_labels
    spine = monthly.select(*owner).distinct().select(*owner, F.explode(month_labels(today, n)).alias("month"))
    have = monthly.withColumn("present", F.lit(True))
    return FX.S.join_keys(spine, have, [*owner, "month"]).withColumn("present", F.coalesce("present", F.lit(False)))
