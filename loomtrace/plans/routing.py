"""Delegation links: which parent call started which child, with which models."""
from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from loomtrace import dims
from loomtrace.functions import text as X
from loomtrace.operators import sequence as S
from loomtrace.operators.aggregates import count_if
from loomtrace.operators.components import components
from loomtrace.plans.tables import materialize, work_dir
from loomtrace.sources.files import non_empty

PAIR = ["tenant_id", "source", "provider", "lead_model", "child_model", "completed", "substantive_calls", "writes"]


def child_facts(b: DataFrame, calls: DataFrame) -> DataFrame:
    """Models, substantive calls and writes of sidechain transcripts per agent id."""
    m = b.filter("source = 'claude' and is_sidechain and agent_id <> ''").groupBy("tenant_id", "agent_id").agg(
        F.count_distinct("model").alias("n_models"), F.max("model").alias("model"), F.min("month").alias("month"))
    c = calls.filter("source = 'claude' and is_sidechain and agent_id <> ''").groupBy("tenant_id", "agent_id").agg(
        count_if(F.col("substantive")).alias("sub"), count_if(F.col("is_write")).alias("wr"))
    return S.join_keys(m, c, ["tenant_id", "agent_id"]).select(
        "tenant_id", "agent_id", F.when(F.col("n_models") == 1, F.col("model")).alias("child_only_model"),
        F.coalesce("sub", F.lit(0)).alias("child_sub"), F.coalesce("wr", F.lit(0)).alias("child_writes"))


def attempt_pairs(b: DataFrame, calls: DataFrame, results: DataFrame, credits: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Agent attempts: invocation, result, notification and child transcript joined by id.

    Every contribution is one row of the same shape, reduced by a single aggregation; two
    different values of one attribute make the attempt ambiguous.
    Returns (pairs, one row per tenant with `incomplete`).
    """
    key = ["tenant_id", "tool_use_id"]
    inv = calls.filter("source = 'claude' and dispatch and tool_use_id <> ''").select(
        *key, F.struct(F.col("session_id").alias("s"), F.col("model").alias("m"), F.col("uuid").alias("u")).alias("inv"))
    res = results.filter("source = 'claude' and tool_use_id <> '' and tool_meta is not null").select(
        *key, F.struct("file_path", "ordinal", "sub").alias("at"), F.col("session_id").alias("r_session"), F.col("tool_meta.agent_id").alias("agent"),
        F.col("tool_meta.status").alias("status"), F.col("tool_meta.resolved_model").alias("resolved"), F.col("tool_meta.edit_files").alias("edits"),
        F.col("tool_meta.assistant_uuid").alias("r_uuid"), F.lit(True).alias("is_result"))
    note = b.filter("source = 'claude' and type = 'user' and origin_kind = 'task-notification' and text is not null").select(
        "tenant_id", X.tag_text(F.col("text"), "tool-use-id").alias("tool_use_id"), F.struct("file_path", "ordinal", "sub").alias("at"),
        non_empty(X.tag_text(F.col("text"), "task-id")).alias("agent"), non_empty(X.tag_text(F.col("text"), "status")).alias("status")).filter("tool_use_id <> ''")
    rows = inv.unionByName(res, True).unionByName(note, True)
    final = F.col("status").isNotNull() & (F.col("status") != "async_launched")
    a = rows.groupBy(*key).agg(
        F.count_distinct("inv").alias("n_inv"), F.max("inv").alias("inv"), F.max(F.coalesce("is_result", F.lit(False))).alias("result_seen"),
        F.count_distinct("agent").alias("n_agent"), F.max("agent").alias("agent_id"),
        F.count_distinct(F.when(final, F.col("status"))).alias("n_status"), F.max(F.when(final, F.col("status"))).alias("done_status"),
        F.max(F.col("status") == "async_launched").alias("launched"), F.max_by("resolved", F.when(F.col("resolved").isNotNull(), F.col("at"))).alias("resolved"),
        F.max(F.coalesce("edits", F.lit(0))).alias("edits"), F.count_distinct("r_session").alias("n_rs"), F.max("r_session").alias("r_session"),
        F.count_distinct("r_uuid").alias("n_ru"), F.max("r_uuid").alias("r_uuid"), F.max(F.col("agent").isNotNull()).alias("has_agent"))
    # metadata on ordinary tool results is not an attempt: it needs an invocation or an agent id
    a = a.filter((F.col("n_inv") > 0) | F.col("has_agent"))
    status = F.coalesce("done_status", F.when(F.col("launched"), "async_launched"))
    clash = ((F.col("n_inv") > 1) | (F.col("n_agent") > 1) | (F.col("n_status") > 1) | (F.col("n_rs") > 1) | (F.col("n_ru") > 1)
             | ((F.col("n_inv") == 1) & F.col("r_session").isNotNull() & (F.col("r_session") != F.col("inv.s")))
             | ((F.col("n_inv") == 1) & F.col("r_uuid").isNotNull() & F.col("inv.u").isNotNull() & (F.col("r_uuid") != F.col("inv.u"))))
    a = a.withColumn("status", status).withColumn("ambiguous", F.coalesce(clash, F.lit(False)))
    child = child_facts(b, calls)
    a = S.join_keys(a, child, ["tenant_id", "agent_id"])
    seen, lead = F.col("n_inv") > 0, F.col("inv.m")
    model = F.coalesce("resolved", "child_only_model")
    known = status.isNotNull() & (status != "async_launched")
    aborted = F.col("status").isin("killed", "cancelled", "stopped") & seen & F.col("result_seen") & ~F.col("ambiguous") & lead.isNotNull()
    waiting = (F.col("status") == "async_launched") & seen & ~F.col("ambiguous") & lead.isNotNull()
    valid = seen & ~F.col("ambiguous") & F.col("agent_id").isNotNull() & known & lead.isNotNull() & model.isNotNull() & F.col("child_sub").isNotNull()
    flag = lambda c: F.coalesce(c, F.lit(False))
    a = a.select(*key, "agent_id", lead.alias("lead_model"), model.alias("child_model"), flag(aborted).alias("aborted"), flag(waiting).alias("waiting"), flag(valid).alias("valid"),
                 "status", "edits", "child_sub", "child_writes")
    usable = F.col("aborted") | F.col("waiting") | F.col("valid")
    live = ~(F.col("aborted") | F.col("waiting"))
    pairs = a.filter(usable).select(
        "tenant_id", F.lit("claude").alias("source"), F.lit("anthropic").alias("provider"), "lead_model", "child_model",
        (live & (F.col("status") == "completed")).alias("completed"), F.when(live, F.col("child_sub")).otherwise(0).cast("bigint").alias("substantive_calls"),
        F.when(live, F.greatest("edits", "child_writes")).otherwise(0).cast("bigint").alias("writes"))
    referenced = a.filter(usable & F.col("agent_id").isNotNull()).select("tenant_id", "agent_id").unionByName(
        credits.select("tenant_id", F.col("child").alias("agent_id")))
    orphans = child.select("tenant_id", "agent_id").join(referenced, ["tenant_id", "agent_id"], "left_anti")
    broken = a.filter(~usable).select("tenant_id").unionByName(orphans.select("tenant_id")).distinct().withColumn("incomplete", F.lit(True))
    return pairs, broken.select("tenant_id", F.lit("claude").alias("source"), "incomplete")


PARENT = ["tenant_id", "parent"]
_LINK = ["m", "completed", "known", "sub_n", "wr_n"]
_MATCHED = "tenant_id string, lead string, cand int, m string, completed boolean, known boolean, sub_n bigint, wr_n bigint, spawn boolean"


def linked_spawns(b: DataFrame, calls: DataFrame, work: str | None = None) -> tuple[DataFrame, DataFrame]:
    """Child turns matched to the parent calls that started them, one call per turn: (pairs, incomplete tenants)."""
    order = F.when(F.col("ts").isNotNull(), F.unix_micros("ts") / 1e6)
    spawns = calls.filter("source = 'codex' and dispatch and session_id is not null").select(
        "tenant_id", F.col("session_id").alias("parent"), F.lit(True).alias("spawn"), order.alias("t"), "ordinal", "sub", "block_pos", "file_path",
        F.col("routing_identity").alias("identity"), F.col("routing_turn_id").alias("turn_id"), F.col("model").alias("m"))
    links = b.filter("type = 'routing_link' and source = 'codex'").select(
        "tenant_id", F.col("routing.parent_session").alias("parent"), F.lit(False).alias("spawn"), order.alias("t"), "ordinal", "sub", F.lit(0).alias("block_pos"), "file_path",
        F.col("routing.delegation_identity").alias("identity"), F.col("routing.turn_id").alias("turn_id"), F.col("routing.child_model").alias("m"),
        F.col("routing.completed").alias("completed"), F.col("routing.lifecycle_known").alias("known"),
        F.col("routing.substantive_calls").alias("sub_n"), F.col("routing.writes").alias("wr_n"))
    done = match_links(links.unionByName(spawns, True), work or work_dir(b.sparkSession))
    flag = lambda c: F.coalesce(c, F.lit(False))
    no_lead = F.coalesce(F.col("lead"), F.lit("")) == ""
    bad = F.col("spawn") | (F.col("cand") > 1) | ~flag(F.col("known")) | (flag(F.col("completed")) & no_lead)
    pairs = done.filter(~F.col("spawn")).select(
        "tenant_id", F.lit("codex").alias("source"), F.lit("openai").alias("provider"), F.col("lead").alias("lead_model"), F.col("m").alias("child_model"),
        flag(F.col("completed")).alias("completed"), F.coalesce("sub_n", F.lit(0)).cast("bigint").alias("substantive_calls"), F.coalesce("wr_n", F.lit(0)).cast("bigint").alias("writes"))
    broken = done.filter(bad).select("tenant_id").distinct().select("tenant_id", F.lit("codex").alias("source"), F.lit(True).alias("incomplete"))
    return pairs, broken


def match_links(rows: DataFrame, work: str) -> DataFrame:
    """Links (spawn = false) matched one-to-one to spawns of their parent; columns of `_MATCHED`.

    In order, a link takes the one free spawn of its turn id; without a free one of its turn, the one free spawn of
    its identity that is not later. Several candidates (`cand` > 1) are never guessed between. Every link
    comes out once with its lead model, and a row with `spawn` for spawns that no link took.

    No parent is one task. A turn with one spawn and one link is a join, unless a link without such a turn
    could take the spawn by identity first. Where an identity has no spawn or link with a shared turn, only the number of free
    spawns counts - none, one or several - and a run of rows maps these three states to each other: maps
    compose, so `tree_scan` replays the identity in many tasks. What is left, identities and turns that depend on each
    other, is cut into the components of these ties and each is matched in order.
    """
    text = lambda c: F.when(F.col(c) != "", F.col(c)).alias(c)
    facts = ["completed", "known", "sub_n", "wr_n"]
    rows = rows.select(*PARENT, "spawn", "t", "ordinal", "sub", "block_pos", "file_path", text("identity"), text("turn_id"), "m", *facts)
    n = lambda c: F.count(F.when(c, 1))
    turns = rows.filter("turn_id is not null").groupBy(*PARENT, "turn_id").agg(
        n(F.col("spawn")).alias("t_spawns"), n(~F.col("spawn")).alias("t_links"), F.max(F.when(F.col("spawn"), F.col("identity"))).alias("t_identity"))
    rows = S.join_keys(rows, turns, [*PARENT, "turn_id"]).na.fill(0, ["t_spawns", "t_links"])
    shared = (F.col("t_spawns") > 0) & (F.col("t_links") > 0)
    clean = (F.col("t_spawns") == 1) & (F.col("t_links") == 1)
    rows = rows.withColumn("shared", shared).withColumn("clean", clean)
    # links that may look for their identity: without a turn of their own, or if another link takes the spawn of another identity
    loose = ~F.col("spawn") & (~F.col("clean") | (F.coalesce("t_identity", "identity") != F.col("identity")))
    ids = rows.filter("identity is not null").groupBy(*PARENT, "identity").agg(
        n(F.col("spawn")).alias("i_spawns"), F.max(loose).alias("contested"), F.max("shared").alias("i_shared"))
    rows = S.join_keys(rows, ids, [*PARENT, "identity"]).na.fill(0, ["i_spawns"]).na.fill(False, ["contested", "i_shared"])
    of_turn = rows.filter("clean and spawn").select(*PARENT, "turn_id", F.col("m").alias("turn_lead"), F.col("contested").alias("turn_contested"))
    rows = materialize(S.join_keys(rows, of_turn, [*PARENT, "turn_id"]), f"{work}/spawn_links")
    sure = F.col("clean") & ~F.col("turn_contested")
    alone = F.when(F.col("spawn"), ~F.col("shared") & ~F.col("contested")).otherwise(~F.col("shared") & (F.col("i_spawns") == 0))
    # an identity whose links never find a spawn by turn, nor its spawns a link
    counted = F.col("contested") & ~F.col("i_shared") & ~alone
    kind = F.when(sure, "sure").when(alone, "alone").when(counted, "counted").otherwise("tied")
    rows = rows.withColumn("how", F.coalesce(kind, F.lit("tied")))
    lead = F.when(F.col("how") == "sure", F.col("turn_lead"))
    simple = rows.filter("how = 'alone' or (how = 'sure' and not spawn)").select("tenant_id", lead.alias("lead"), F.when(F.col("how") == "sure", 1).otherwise(0).alias("cand"), *_LINK, "spawn")
    for how, rest in (("counted", _counted), ("tied", _tied)):
        some = rows.filter(F.col("how") == how)
        if not some.isEmpty():
            simple = simple.unionByName(rest(some, work))
    return simple


def _counted(rows: DataFrame, work: str) -> DataFrame:
    """Identities by the number of free spawns; the free one of one is the last spawn."""
    keys = [*PARENT, "identity"]
    undated = F.col("t").isNull()
    phase = F.when(undated & F.col("spawn"), 0).when(undated, 2).otherwise(1)  # undated spawns are open to all links, undated links see all spawns
    order = ["phase", "t", "ordinal", "late", "file_path", "sub", "block_pos"]
    seq = S.in_ranges(rows.withColumn("phase", phase).withColumn("late", ~F.col("spawn")), keys, order, f"{work}/spawn_rows")
    upto = Window.partitionBy(*keys, "__cut").orderBy(*order)
    before = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = seq.groupBy(*keys, "__cut").agg(F.count("*").alias("c")).select(*keys, "__cut", F.coalesce(F.sum("c").over(before), F.lit(0)).alias("c0"))
    seq = S.join_keys(seq.withColumn("nth", F.row_number().over(upto)), sums, [*keys, "__cut"]).withColumn("nth", F.col("nth") + F.col("c0"))
    to = lambda a, b: F.when(F.col("spawn"), a).otherwise(b)
    seq = seq.withColumns({"s0": to(1, 0), "s1": to(2, 0), "s2": F.lit(2), "seen": F.col("spawn")})
    pick = lambda f, s: F.when(s == 0, f["s0"]).when(s == 1, f["s1"]).otherwise(f["s2"])
    model = lambda held, f: F.when(f["seen"], f["m"]).otherwise(held)

    def compose(acc, f):
        return F.struct(*[pick(f, acc[s]).alias(s) for s in ("s0", "s1", "s2")], (acc["seen"] | f["seen"]).alias("seen"), model(acc["m"], f).alias("m"))

    unit = F.struct(F.lit(0).alias("s0"), F.lit(1).alias("s1"), F.lit(2).alias("s2"), F.lit(False).alias("seen"), F.lit(None).cast("string").alias("m"))
    start = F.struct(F.lit(0).alias("free"), F.lit(None).cast("string").alias("m"))
    moved = lambda state, f: F.struct(pick(f, state["free"]).alias("free"), model(state["m"], f).alias("m"))
    step = lambda state, x: (moved(state, x), F.struct(state["free"].alias("cand"), F.when(state["free"] == 1, state["m"]).alias("lead")))
    done = S.tree_scan(seq, keys, "nth", ["s0", "s1", "s2", "seen", "spawn", *_LINK], unit, compose, start, moved, step, "found", f"{work}/spawn_scan")
    links = done.filter(~F.col("spawn")).select("tenant_id", F.col("found.lead").alias("lead"), F.col("found.cand").alias("cand"), *_LINK, "spawn")
    left = done.groupBy(*keys).agg(F.count(F.when(F.col("spawn"), 1)).alias("n"), F.count(F.when(~F.col("spawn") & (F.col("found.cand") == 1), 1)).alias("taken")).filter("n > taken")
    return links.unionByName(left.select("tenant_id", *[F.lit(None).cast(t).alias(c) for c, t in _TYPES.items()], F.lit(True).alias("spawn")))


_TYPES = {"lead": "string", "cand": "int", "m": "string", "completed": "boolean", "known": "boolean", "sub_n": "bigint", "wr_n": "bigint"}


def _tied(rows: DataFrame, work: str) -> DataFrame:
    """The rest, one task for each component of turns and identities that share rows."""
    key = lambda kind, c: F.concat_ws("\x00", "tenant_id", "parent", F.lit(kind), c)
    rows = rows.withColumn("by_turn", F.when(F.col("shared"), key("turn", "turn_id"))).withColumn("by_id", F.when(F.col("identity").isNotNull(), key("identity", "identity")))
    rows = materialize(rows, f"{work}/spawn_tied")
    labels = components(rows.filter("by_turn is not null and by_id is not null").select(F.col("by_turn").alias("u"), F.col("by_id").alias("v")), f"{work}/spawn_ties")
    named = rows.withColumn("node", F.coalesce("by_id", "by_turn", key("none", "file_path"))).join(labels, "node", "left").withColumn("part", F.coalesce("label", "node"))
    columns = ["tenant_id", "part", "spawn", "t", "ordinal", "file_path", "sub", "block_pos", "identity", "turn_id", *_LINK]

    def match(pdf):
        import pandas as pd
        far = float("inf")
        pdf = pdf.assign(undated=pdf.t.isna(), t=pdf.t.fillna(far)).sort_values(["undated", "t", "ordinal", "file_path", "sub", "block_pos"])
        spawns = [r for r in pdf.itertuples() if r.spawn]
        free, of_turn, of_id, out = [True] * len(spawns), {}, {}, []
        for i, s in enumerate(spawns):
            for name, places in ((s.turn_id, of_turn), (s.identity, of_id)):
                if isinstance(name, str):
                    places.setdefault(name, []).append(i)

        def two(places: list[int] | None, late=None) -> list[int]:
            """Up to two free spawns; taken ones at the front are forgotten."""
            found = []
            while places and not free[places[0]]:
                places.pop(0)
            for i in places or ():
                s = spawns[i]
                if late is not None and not late.undated and not s.undated and (s.t, s.ordinal) > (late.t, late.ordinal):
                    continue
                if free[i]:
                    found.append(i)
                    if len(found) == 2:
                        break
            return found

        for r in pdf.itertuples():
            if r.spawn:
                continue
            found = two(of_turn.get(r.turn_id)) or two(of_id.get(r.identity), r)
            if len(found) == 1:
                free[found[0]] = False
            out.append((r.tenant_id, spawns[found[0]].m if len(found) == 1 else None, len(found), r.m, r.completed, r.known, r.sub_n, r.wr_n, False))
        if any(free):
            out.append((pdf.tenant_id.iloc[0], None, None, None, None, None, None, None, True))
        return pd.DataFrame(out, columns=[c.split()[0] for c in _MATCHED.split(", ")])

    return named.select(*columns).groupBy("part").applyInPandas(match, _MATCHED)


def routing_measure(pairs: DataFrame, broken: DataFrame, sources: DataFrame) -> DataFrame:
    """Routing state and counts per (tenant, source) and per tenant ('*').

    A completed pair with known tiers and real work counts; the share whose child runs a
    lower tier is scored elsewhere.  Any incomplete link makes the tenant unmeasured.
    """
    from loomtrace.functions import models as M
    lead, child = M.tier(F.col("provider"), F.col("lead_model")), M.tier(F.col("provider"), F.col("child_model"))
    reason = (F.when(~F.col("completed"), "incomplete").when(lead.isNull() | child.isNull(), "unknown_model")
              .when(~((F.col("writes") > 0) | (F.col("substantive_calls") >= 5)), "not_substantive"))
    p = pairs.withColumn("reason", reason).withColumn("lower", child < lead)
    g = F.explode(F.array(F.lit("*"), F.col("source")))
    c = p.withColumn("g_source", g).groupBy("tenant_id", "g_source").agg(
        count_if(F.col("reason").isNull()).alias("routing_eligible"), count_if(F.col("reason").isNull() & F.col("lower")).alias("routing_successful"),
        *[count_if(F.col("reason") == r).alias(f"routing_{r}") for r in ("incomplete", "unknown_model", "not_substantive")])
    bad = broken.withColumn("g_source", g).groupBy("tenant_id", "g_source").agg(F.max("incomplete").alias("incomplete"))
    have = sources.withColumn("g_source", g).groupBy("tenant_id", "g_source").agg(
        F.max(F.col("source").isin("claude", "codex")).alias("supported"))
    j = S.join_keys(S.join_keys(have, c, ["tenant_id", "g_source"]), bad, ["tenant_id", "g_source"])
    zero = [F.coalesce(k, F.lit(0)).alias(k) for k in ("routing_eligible", "routing_successful", "routing_incomplete", "routing_unknown_model", "routing_not_substantive")]
    excluded = F.coalesce(F.col("routing_incomplete") + F.col("routing_unknown_model") + F.col("routing_not_substantive"), F.lit(0))
    state = (F.when(~F.col("supported"), "unsupported").when(F.coalesce("incomplete", F.lit(False)), "unmeasured")
             .when((excluded > 0) & (F.coalesce("routing_eligible", F.lit(0)) == 0), "unmeasured").otherwise("measured"))
    return j.select("tenant_id", "g_source", state.alias("routing_state"), *zero)
