"""Ordered session facts: what happened before and after the first code write."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace import dims
from loomtrace.functions import paths as P
from loomtrace.operators import sequence as S
from loomtrace.operators.aggregates import count_if
from loomtrace.plans.facts import SESSION
from loomtrace.plans.tables import materialize

C = dims.QUOTIENT_CONSTANTS
PIECE_BITS = 12  # lines of a file that share a piece, as a power of two
EVIDENCE = ["Read", "Grep", "Glob", "NotebookRead"]


def _far() -> Column:
    return F.lit(float("inf"))


def session_facts(calls: DataFrame, outcomes: DataFrame, extra: list[str] | None = None, work: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(session rows, plan artifacts).

    `extra` adds a scope column to the session key (the month, for month-scoped facts).
    Order is (time, file position); undated calls come last.  The first code write is a
    minimum, everything else a conditional aggregate against it, so no session is sorted.
    A session is cut into pieces of some thousand lines of a file: each piece has its first write,
    the minimum over the pieces of a session is one row a piece, and calls meet it by piece.
    With a work folder the calls (a few narrow columns) are written once before and once after they
    are marked; without one each reduction derives them again.
    """
    key = SESSION + (extra or [])
    t = F.when(F.col("ts").isNotNull(), F.unix_micros("ts") / 1e6).otherwise(_far())
    c = calls.filter("session_id is not null")
    for k in extra or []:
        c = c.filter(F.col(k).isNotNull())
    code = F.col("is_write") & (F.col("file_class") == "code")
    c = c.withColumn("t", t).withColumn("pos", F.struct("t", "ordinal", "file_path", "sub", "block_pos")).withColumn("code", code).withColumn(
        "path", P.normalize(F.col("abs_target"))).withColumn("evidence", F.col("name").isin(EVIDENCE))
    c = c.withColumn("piece", F.xxhash64("file_path", F.shiftright("ordinal", PIECE_BITS))).select(
        *SESSION, *(extra or []), "piece", "path", "pos", "t", "cwd", "code", "substantive", "evidence", "category", "loc", "knowledge", "plan_skill",
        "is_write", "plan_file", "runs_tests", "tool_use_id", F.when(F.col("name").isin(dims.STEP_TOOLS), F.col("steps")).alias("steps"))
    if work:
        c = materialize(c, f"{work}/calls_{'_'.join(extra or ['all'])}")
    # the piece leads: it is a hash, the other keys are strings that mostly agree
    pieces = c.groupBy("piece", *key).agg(F.min(F.when(F.col("code"), F.struct("pos", "cwd"))).alias("write"), F.min(F.when(F.col("plan_skill"), F.col("pos"))).alias("skill"))
    whole = S.led(key)  # one row a piece
    seen = pieces.select(*key, "piece", F.min("write").over(whole)["pos"].alias("cut"), F.min("skill").over(whole).alias("skill"))
    first = pieces.groupBy(*key).agg(F.min("write").alias("write"))
    j = S.join_keys(c, seen, ["piece", *key])
    # outcomes matter for calls that ran tests only
    checked = S.join_keys(j.filter("runs_tests"), outcomes.withColumnRenamed("errored", "__err"), [*SESSION, "tool_use_id"])
    j = checked.unionByName(j.filter("not coalesce(runs_tests, false)").withColumn("__err", F.lit(None).cast("boolean")))
    before_cut = lambda pos: F.col("cut").isNull() | (F.col(pos) < F.col("cut"))
    j = j.select(*key, "path", "pos", "t", "cwd", "code", "substantive", "evidence", "category", "loc", "knowledge", "plan_skill", "is_write", "plan_file", "steps",
                 before_cut("pos").alias("before"), (F.col("skill").isNotNull() & before_cut("skill")).alias("skilled"),
                 F.coalesce(F.col("runs_tests") & (F.col("pos") > F.col("cut")) & (F.col("__err") == F.lit(False)), F.lit(False)).alias("tested"))
    if work:
        j = materialize(j, f"{work}/marked_calls_{'_'.join(extra or ['all'])}")
    before = F.col("before")
    # targets are counted once each: reduce to one row per (session, path) first
    by_path = j.groupBy(*key, "path").agg(
        count_if(F.col("code")).alias("code_n"), F.max(F.col("substantive") & F.col("evidence")).alias("read"),
        count_if(F.col("substantive") & ~F.col("evidence")).alias("sub_n"),
        count_if(F.col("substantive") & ~F.col("evidence") & (F.col("category") != "delegate")).alias("own_n"),
        F.sum(F.when(F.col("code"), F.coalesce("loc", F.lit(0))).otherwise(0)).alias("churn"),
        F.max(before & (F.col("evidence") | F.col("knowledge"))).alias("ev"), F.max(before & F.col("plan_skill")).alias("plan_skill"),
        F.max("tested").alias("tested"))
    s = by_path.groupBy(*key).agg(
        count_if((F.col("code_n") > 0) & (F.col("path") != "")).alias("code_files"), F.sum("code_n").alias("code_writes"), F.sum("churn").alias("code_churn"),
        (F.sum("sub_n") + count_if(F.col("read"))).alias("substantive"), (F.sum("own_n") + count_if(F.col("read"))).alias("own_substantive"),
        F.max("ev").alias("evidence_before"), F.max("plan_skill").alias("plan_skill"), F.max("tested").alias("ran_test"))
    s = S.join_keys(s, first.select(*key, F.col("write.pos.t").alias("first_write"), F.col("write.cwd").alias("first_cwd")), key)
    # third distinct step before the first code write
    steps = (j.filter(before & F.col("steps").isNotNull()).select(*key, "pos", "cwd", F.explode("steps").alias("step"))
             .groupBy(*key, "step").agg(F.min(F.struct("pos", "cwd")).alias("p")))
    w = S.led(key).orderBy("p", "step")
    third = (steps.withColumn("n", F.row_number().over(w)).filter(F.col("n") == C["PLAN_MIN_STEPS"])
             .select(*key, F.col("p.cwd").alias("cwd"), F.col("p.pos.t").alias("t")))
    files = j.filter(before & F.col("is_write") & F.col("plan_file")).filter(
        F.col("loc").isNull() | (F.col("loc") >= C["PLAN_MIN_LINES"]) | F.col("skilled")).select(*key, "cwd", "t")
    artifacts = third.unionByName(files)
    planned = artifacts.groupBy(*key).agg(F.count(F.lit(1)).alias("n_artifacts"), F.min(F.struct("t", "cwd")).alias("own_plan"))
    s = S.join_keys(s, planned, key)
    has_code = F.col("code_files") > 0
    eligible = has_code & ((F.col("code_files") >= 2) | (F.col("code_churn") >= C["CHURN_MIN"]) | (F.col("substantive") >= dims.ELIGIBLE_SUBSTANTIVE))
    orchestratable = has_code & ((F.col("code_files") >= C["ORCHESTRATABLE_CODE_FILES"]) | (F.col("own_substantive") >= C["ORCHESTRATABLE_SUBSTANTIVE"]))
    s = s.withColumn("eligible", eligible).withColumn("orchestratable", orchestratable).withColumn(
        "planned_intra", (F.coalesce("n_artifacts", F.lit(0)) > 0) | F.col("plan_skill"))
    return s, artifacts


def credit_plans(sessions: DataFrame, artifacts: DataFrame, scope: list[str], work: str | None = None) -> DataFrame:
    """Planned flag per session: own plan, or the earliest unused plan of the same directory
    within the look-back window.

    `scope` says within which rows plans are shared (tenant, or tenant and source, …).  A
    planned eligible session uses up its own earliest plan first.
    """
    key = scope + ["source", "session_id"]
    # plans are counted by directory and time, and those in use taken off: no session's plans are numbered
    place = [*scope, "cwd", "t"]
    used = sessions.filter("eligible and planned_intra and n_artifacts > 0").select(*scope, F.col("own_plan.cwd").alias("cwd"), F.col("own_plan.t").alias("t"), F.lit(-1).alias("n"))
    pool = artifacts.select(*place, F.lit(1).alias("n")).unionByName(used).groupBy(*place).agg(F.sum("n").alias("n")).filter("n > 0")
    pool = pool.select(*place, F.explode(F.sequence(F.lit(1).cast("bigint"), "n")).alias("nth"))
    pending = sessions.filter("eligible and not planned_intra and first_write is not null")
    credit = S.consume_once(
        pool.select(*scope, "cwd", "t"),
        pending.select(*scope, F.col("first_cwd").alias("cwd"), "source", "session_id", F.col("first_write").alias("t")),
        scope + ["cwd"], ["source", "session_id"], "t", float(C["WINDOW"]), work=work)
    out = S.join_keys(sessions, credit.drop("cwd"), key)
    return out.withColumn("planned", F.col("eligible") & (F.col("planned_intra") | F.coalesce("credited", F.lit(False)))).drop("credited")
