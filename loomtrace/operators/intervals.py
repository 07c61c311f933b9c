"""Spans against windows, without a range predicate on one key."""
from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

DAY = 86_400_000_000


def overlaps(spans: DataFrame, windows: DataFrame, owner: list[str], window: list[str], first: str = "first",
             last: str = "last", width_us: int = DAY) -> DataFrame:
    """Per owner and window, the spans [first, last] that overlap [since, until): count and bounds.

    spans: owner, first, last (a missing end is open). windows: owner, window, since, until (a missing
    end is open too). A span whose last lies before its first is read as the moment `first`. Windows
    that nothing overlaps keep a row with count 0; an empty window (until <= since) has none.

    Owners are never NULL. Equal windows of one owner are one row.

    A span meets a window in exactly one way: it starts inside it, or it has started when the window
    starts. Both are equi-joins on (owner, bucket of time): a start lies in one bucket and windows are
    laid over the buckets they cover, or a window's start lies in one bucket and spans are laid over
    those of their buckets in which a window starts. Spans are cut to the range of their owner's
    windows first, so open ends stay finite. Equal spans are counted before they meet a window.
    """
    us = F.unix_micros
    w = windows.select(*owner, *window, us("since").alias("__since"), us("until").alias("__until")).distinct().withColumn("__id", F.struct(*window))
    real = w.filter(F.coalesce(F.col("__until") > F.col("__since"), F.lit(True)))
    s = spans.select(*owner, us(first).alias("__first"), F.when(F.col(last) < F.col(first), us(first)).otherwise(us(last)).alias("__last"))
    s = s.groupBy(*owner, "__first", "__last").agg(F.count(F.lit(1)).alias("__n"))
    # finite ends: one below and one above every bound of the owner
    bounds = real.groupBy(*owner).agg(F.min(F.least("__since", "__until")).alias("__lo"), F.max(F.greatest("__since", "__until")).alias("__hi"))
    bounds = bounds.withColumn("__lo", F.coalesce("__lo", F.lit(0)) - 1).withColumn("__hi", F.coalesce("__hi", F.lit(0)) + 1)
    cut = lambda c, missing: F.greatest(F.least(F.coalesce(F.col(c), F.col(missing)), F.col("__hi")), F.col("__lo"))
    bucket = lambda c: F.floor(c / F.lit(width_us)).cast("bigint")
    covered = lambda a, b: F.explode(F.sequence(bucket(a), bucket(b))).alias("__b")
    win = _same(real, bounds, owner).withColumn("__from", F.coalesce("__since", "__lo")).withColumn("__to", F.coalesce("__until", F.col("__hi") + 1))
    span = (_same(s, bounds, owner).withColumn("__at", cut("__first", "__lo")).withColumn("__end", cut("__last", "__hi")))
    meet = [*owner, "__b"]
    # started inside: [__from, __to) holds the start
    laid = win.select(*owner, "__id", "__from", "__to", covered(F.col("__from"), F.col("__to") - 1))
    inside = _same(span.withColumn("__b", bucket(F.col("__at"))), laid, meet).filter("__at >= __from and __at < __to")
    # started before, and not over yet when the window starts
    starts = win.select(*owner, "__id", "__from", bucket(F.col("__from")).alias("__b"))
    busy = starts.groupBy(*owner).agg(F.array_sort(F.collect_set("__b")).alias("__busy"))
    spread = _same(span, busy, owner).select(*span.columns, F.explode(F.filter(
        "__busy", lambda b: (b >= bucket(F.col("__at"))) & (b <= bucket(F.col("__end"))))).alias("__b"))
    before = _same(spread, starts, meet).filter("__at < __from and __end >= __from")
    cols = [*owner, "__id", "__n", "__first", "__last"]
    found = inside.select(*cols).unionByName(before.select(*cols)).groupBy(*owner, "__id").agg(
        F.sum("__n").alias("n"), F.min("__first").alias("__first"), F.max("__last").alias("__last"))
    every = _same(real.select(*owner, "__id"), found, [*owner, "__id"], "left")
    return every.select(*owner, *[F.col("__id")[c].alias(c) for c in window], F.coalesce("n", F.lit(0)).alias("spans"),
                        F.timestamp_micros("__first").alias("first"), F.timestamp_micros("__last").alias("last"))


def _same(left: DataFrame, right: DataFrame, keys: list[str], how: str = "inner") -> DataFrame:
    """Equi-join that keeps one copy of the keys."""
    return left.join(right, keys, how)
