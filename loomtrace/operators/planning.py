"""Planner and gate operators: coverage, backfill, budgets, counterfactual arms."""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from loomtrace import dims


def month_starts(today: str, n: int) -> Column:
    """The last n calendar months up to today's, as an array of first-of-month dates."""
    first = F.trunc(F.lit(today).cast("date"), "MM")
    return F.sequence(F.add_months(first, F.lit(-(n - 1))), first, F.expr("interval 1 month"))


def month_labels(today: str, n: int) -> Column:
    return F.transform(month_starts(today, n), lambda d: F.date_format(d, "yyyy-MM"))


def month_spine(spark, today: str, n: int) -> DataFrame:
    return (spark.range(1).select(F.explode(month_starts(today, n)).alias("month_start"))
            .withColumn("month", F.date_format("month_start", "yyyy-MM")))


def trailing_window(spine: DataFrame, today: str, months: int = 1, month_start: str = "month_start") -> DataFrame:
    """[since, until) per anchor month; the running single month is a trailing 30 days."""
    now = F.lit(today).cast("date")
    running = F.lit(months == 1) & (F.trunc(now, "MM") == F.col(month_start))
    return (spine.withColumn("since", F.when(running, F.date_sub(now, 30)).otherwise(
                F.add_months(F.col(month_start), F.lit(-(months - 1)))))
            .withColumn("until", F.when(running, F.date_add(now, 1)).otherwise(
                F.add_months(F.col(month_start), F.lit(1)))))


def declared_months(since: Column, until: Column) -> Column:
    """Whole calendar months between two bounds, NULL when they are not month starts."""
    def month_start(c: Column) -> Column:
        return c == F.date_trunc("month", c)
    months = (F.year(until) * 12 + F.month(until)) - (F.year(since) * 12 + F.month(since))
    return F.when(month_start(since) & month_start(until) & (months >= 1), months)


def backfill_plan(stored: DataFrame, owner: list[str], today: str, force: bool = False,
                  months: int = 12, contract: str = dims.CONTRACT_ID) -> DataFrame:
    """Months to compute per owner, with the reason.

    `stored` has one row per owner and known owner-month: month (NULL for an owner without
    stored months), score_contract_id, stored_rank, producible_rank.
    """
    now = F.trunc(F.lit(today).cast("date"), "MM")
    current, previous = F.date_format(now, "yyyy-MM"), F.date_format(F.add_months(now, F.lit(-1)), "yyyy-MM")
    prev = F.col("month") == previous
    per = stored.groupBy(*owner).agg(
        F.count("month").alias("known"),
        F.max(F.when(prev, F.lit(True))).alias("has_prev"),
        F.max(F.when(prev, F.col("score_contract_id"))).alias("contract"),
        F.max(F.when(prev, F.col("stored_rank"))).alias("stored_rank"),
        F.max("producible_rank").alias("producible_rank"))
    rank, have = F.col("producible_rank"), F.col("stored_rank")
    prev_reason = (F.when(F.coalesce("has_prev", F.lit(False)) == F.lit(False), "gap")
                   .when((F.coalesce("contract", F.lit("")) != contract) & rank.isNotNull(), "contract-upgrade")
                   .when(have.isNotNull() & rank.isNotNull() & (rank > have), "refresh"))
    full = F.lit(True) if force else F.col("known") == 0
    plan = per.withColumn("plan", F.when(
        full, F.transform(month_labels(today, months), lambda m: F.struct(m.alias("month"), F.lit("force" if force else "initial").alias("reason"))))
        .otherwise(F.filter(F.array(F.struct(previous.alias("month"), prev_reason.alias("reason")),
                                    F.struct(current.alias("month"), F.lit("current").alias("reason"))),
                            lambda p: p["reason"].isNotNull())))
    return plan.select(*owner, F.explode("plan").alias("p")).select(*owner, "p.month", "p.reason")


def gap_months(stored: DataFrame, owner: list[str], month: str, today: str, months: int = 12) -> DataFrame:
    """Months between an owner's latest stored month and the current one, plus the current one."""
    labels = month_labels(today, months)
    cur = F.element_at(labels, -1)
    last = stored.groupBy(*owner).agg(F.max(month).alias("__last"))
    wanted = F.filter(labels, lambda m: (m > F.col("__last")) | (m == cur))
    return last.select(*owner, F.explode(wanted).alias(month)).withColumn(
        "reason", F.when(F.col(month) == cur, "current").otherwise("gap"))


def over_budget(payload_json: Column, limit: int = dims.PAYLOAD_LIMIT_BYTES) -> Column:
    """Documents at or above the byte limit are rejected whole, never cut."""
    return F.octet_length(payload_json) >= limit


def saturation_arms(rows: DataFrame, id_cols: list[str], signals: dict[str, tuple[str, Column, float]],
                    fractions: list[float]) -> DataFrame:
    """Cut each saturated signal to a fraction of its threshold and score it again.

    signals: name -> (value column, threshold column, weight).  The arm grid is a literal
    array, so every row fans out by a fixed factor and no join is involved.
    """
    cases = F.array(*[F.lit(f) for f in fractions])
    armed = rows.withColumn("arm", F.explode(cases))
    total = None
    cut_count = None
    for _, (value, threshold, weight) in signals.items():
        v = F.col(value).cast("double")
        cut = (v > threshold * F.col("arm")) & (threshold > 0)
        kept = F.when(cut, threshold * F.col("arm")).otherwise(v)
        term = F.when(threshold > 0, F.least(F.lit(1.0), kept / threshold)).otherwise(F.lit(0.0)) * weight
        total = term if total is None else total + term
        c = F.when(cut, 1).otherwise(0)
        cut_count = c if cut_count is None else cut_count + c
    wsum = sum(w for _, _, w in signals.values())
    return armed.select(*id_cols, "arm", (total / wsum).alias("score"), cut_count.cast("bigint").alias("cut"))
