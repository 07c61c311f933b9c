"""Independent re-measurement of published numbers from the fact tables."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace import dims
from loomtrace.functions import paths, tools
from loomtrace.operators import aggregates as A


def hidden_branch(normalized: Column, known: list[tuple[float, Column]], weight: float,
                  branches: tuple[float, ...] = (1.0, 0.6), tolerance: float = 0.005) -> Column:
    """Value of an undisclosed term, recovered from the axis score and the other terms."""
    total = weight + sum(w for w, _ in known)
    rest = reduce(lambda a, b: a + b, [F.lit(w) * v for w, v in known])
    x = (normalized * F.lit(total) - rest) / F.lit(weight)
    expr = F.lit(None).cast("double")
    for b in reversed(branches):
        expr = F.when(F.abs(x - F.lit(b)) < tolerance, F.lit(b)).otherwise(expr)
    return expr


def corpus_fingerprint(calls: DataFrame, owner: list[str], first_seen: Column, k: int = 15) -> tuple[DataFrame, DataFrame]:
    """Calls, sessions and sidechain share per owner, and the k most used tools."""
    per = calls.groupBy(*owner, "session_id").agg(F.count(F.lit(1)).alias("n"), A.count_if(F.coalesce("is_sidechain", F.lit(False))).alias("side"))
    head = per.groupBy(*owner).agg(F.sum("n").cast("bigint").alias("tool_calls"), F.count("session_id").alias("sessions"),
                                   (F.sum("side") / F.sum("n")).alias("sidechain_share"))
    return head, A.top_k(calls, owner, "name", k, first_seen)


def comparison_profile(calls: DataFrame, thinking: DataFrame, owner: list[str]) -> DataFrame:
    """Category shares, distinct roots and the explore ratio with and without reasoning blocks.

    `thinking` carries one row per owner with the number of reasoning blocks.
    """
    per = calls.groupBy(*owner, "category").agg(F.count(F.lit(1)).alias("n"))
    n = lambda *c: F.coalesce(F.sum(F.when(F.col("category").isin(*c), F.col("n"))), F.lit(0))
    roots = calls.filter("cwd <> ''").select(*owner, "cwd").distinct().groupBy(*owner).agg(F.count(F.lit(1)).alias("project_roots"))
    g = per.groupBy(*owner).agg(F.sum("n").alias("tool_calls"), n("explore").alias("explore"), n("produce", "execute", "delegate").alias("doing"),
                                *[n(c).alias(f"n_{c}") for c in ("produce", "plan", "execute", "delegate", "ask")])
    j = g.join(roots, owner, "left").join(thinking, owner, "left").fillna(0, ["project_roots", "thinking_blocks"])
    return j.select(*owner, "tool_calls", "project_roots", *[(F.col(f"n_{c}") / F.col("tool_calls")).alias(f"{c}_share") for c in ("produce", "plan", "execute", "delegate", "ask")],
                    (F.col("explore") / F.col("tool_calls")).alias("explore_share"),
                    F.when(F.col("doing") > 0, (F.col("explore") + F.col("thinking_blocks")) / F.col("doing")).alias("explore_to_doing"),
                    F.when(F.col("doing") > 0, F.col("explore") / F.col("doing")).alias("explore_to_doing_without_thinking"),
                    F.when(F.col("explore") + F.col("thinking_blocks") > 0, F.col("thinking_blocks") / (F.col("explore") + F.col("thinking_blocks"))).alias("thinking_share"))


def grounding_recount(calls: DataFrame, thinking: DataFrame, published: DataFrame, owner: list[str], tolerance: float = 0.02) -> DataFrame:
    """Explore ratio counted again from the calls against the published one."""
    p = calls.groupBy(*owner).agg(A.count_if(F.col("category") == "explore").alias("explore"), A.count_if(F.col("plan_dispatch")).alias("dispatch"),
                                  A.count_if(F.col("category").isin("produce", "execute", "delegate")).alias("raw"))
    j = p.join(thinking, owner, "left").fillna(0, ["thinking_blocks"]).join(published.select(*owner, F.col("planning_ratio").alias("published")), owner, "left")
    doing = F.when(F.col("raw") - F.col("dispatch") > 0, F.col("raw") - F.col("dispatch")).otherwise(F.col("raw"))
    own = F.when(doing > 0, (F.col("explore") + F.col("thinking_blocks")) / doing).otherwise(0.0)
    return j.select(*owner, own.alias("recounted"), "published", F.coalesce(F.abs(own - F.col("published")) < tolerance, F.lit(False)).alias("faithful"))


def cli_mcp_recount(calls: DataFrame, owner: list[str]) -> DataFrame:
    """Command heads and MCP servers counted again from the calls."""
    c = calls.select(*owner, F.explode_outer("clis").alias("cli"), F.lit(None).cast("string").alias("server")).filter("cli is not null")
    m = calls.filter("is_mcp").select(*owner, F.lit(None).cast("string").alias("cli"), F.coalesce("server", F.lit("")).alias("server"))
    per = c.unionByName(m).groupBy(*owner, "cli", "server").agg(F.count(F.lit(1)).alias("n"))
    g = per.groupBy(*owner).agg(F.count("cli").alias("clis_distinct"), A.count_if(F.col("server") != "").alias("servers_distinct"),
                                F.coalesce(F.sum(F.when(F.col("cli").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("cli_calls"),
                                F.coalesce(F.sum(F.when(F.col("server").isNotNull(), F.col("n"))), F.lit(0)).cast("bigint").alias("mcp_calls"))
    both = F.col("cli_calls") + F.col("mcp_calls")
    return g.withColumn("cli_share", F.when(both > 0, F.col("cli_calls") / both).otherwise(0.0))


def compounding_composition(calls: DataFrame, owner: list[str]) -> DataFrame:
    """File writes against memory-server writes, per event and per distinct target."""
    kind = F.when(F.col("compounding"), "file_write").when(F.col("knowledge_write"), "server_write")
    target = F.when(F.col("compounding"), F.col("edit_path")).otherwise(F.col("persist_id"))
    per = calls.withColumn("kind", kind).withColumn("what", target).filter("kind is not null").groupBy(*owner, "kind", "session_id", "what").agg(F.count(F.lit(1)).alias("n"))
    return per.groupBy(*owner, "kind").agg(F.sum("n").cast("bigint").alias("acts"), F.count(F.lit(1)).alias("distinct_targets"))


def task_tools(calls: DataFrame, owner: list[str]) -> DataFrame:
    t = calls.filter(F.col("name").startswith("Task") | F.col("name").isin("TodoWrite", "TodoRead"))
    return t.groupBy(*owner, "name").agg(F.count(F.lit(1)).alias("n"))


def disclosures(scored: DataFrame, keep: list[str]) -> DataFrame:
    """Dropped axes, axes with a dropped term, and axes that took over a sibling's weight."""
    p = scored.select(*keep, F.explode("pillars").alias("p"))
    dropped = p.select(*keep, F.explode("p.not_applicable").alias("axis")).select(*keep, "axis", F.lit("dropped").alias("disclosure"))
    axes = p.select(*keep, F.explode("p.axes").alias("a"))
    partial = axes.filter("a.partial_terms is not null").select(*keep, F.col("a.axis").alias("axis"), F.lit("partial").alias("disclosure"))
    moved = axes.filter("a.weight <> a.base_weight").select(*keep, F.col("a.axis").alias("axis"), F.lit("reweighted").alias("disclosure"))
    return dropped.unionByName(partial).unionByName(moved)


def unscored_axes(scored: DataFrame, keep: list[str]) -> DataFrame:
    """Declared axes that a row did not score (declared minus scored, per row)."""
    declared = F.array(*[F.lit(a) for _, a, _ in dims.QUOTIENT_AXES])
    have = F.flatten(F.transform("pillars", lambda p: F.transform(p["axes"], lambda a: a["axis"])))
    return scored.select(*keep, F.explode(F.array_except(declared, have)).alias("axis"))


def saturation_threshold(inputs: DataFrame, keep: list[str], signal: str, steps: int = 256, rounds: int = 6) -> DataFrame:
    """Smallest fraction of a signal that still scores what the full signal scores, to 1 / steps^rounds.

    Scores rise with the signal, so each round keeps the one interval in which the full score is
    reached and cuts it again; the defaults end at 3.6e-15. The points of a round are a literal
    array per row: one pass and no join. Rounds are written tables, so plans stay small.
    """
    from loomtrace.plans.score import quotient
    from loomtrace.plans.tables import materialize, work_dir
    work = work_dir(inputs.sparkSession)
    points = F.transform(F.flatten(F.transform("pillars", lambda p: p["axes"])), lambda a: F.bround(a["normalized_score"], 6))
    spans = inputs.select(*keep).distinct().withColumn("low", F.lit(0.0)).withColumn("high", F.lit(1.0))
    for k in range(rounds):
        cuts = F.transform(F.sequence(F.lit(0), F.lit(steps)), lambda i: F.when(i == steps, F.col("high")).otherwise(F.col("low") + (F.col("high") - F.col("low")) * (i / F.lit(float(steps)))))
        arms = inputs.join(spans, keep).select("*", F.explode(F.array_distinct(cuts)).alias("fraction")).drop("low", "high")
        scored = quotient(arms.withColumn(signal, F.col(signal) * F.col("fraction")), [*keep, "fraction"]).select(*keep, "fraction", points.alias("points"))
        g = scored.groupBy(*keep).agg(F.max_by("points", "fraction").alias("full"), F.collect_list(F.struct("fraction", "points")).alias("arms"))
        high = F.array_min(F.transform(F.filter("arms", lambda a: a["points"] == F.col("full")), lambda a: a["fraction"]))
        g = g.withColumn("high", high).withColumn("low", F.coalesce(F.array_max(F.transform(F.filter("arms", lambda a: a["fraction"] < F.col("high")), lambda a: a["fraction"])), F.col("high")))
        spans = materialize(g.select(*keep, "low", "high"), f"{work}/round_{k}")
    return spans.select(*keep, F.col("high").alias("saturated_at"))
