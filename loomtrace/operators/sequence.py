"""Ordered operators that do not put one key's whole history into one task.

A plain ``Window.partitionBy(session)`` sorts a session in a single task; one session can
hold a third of all rows.  The operators here split every key into *chunks* (a column that
grows with the order, e.g. ``ordinal >> 16`` or a calendar day), work inside a chunk, and
pass only one summary row per chunk from chunk to chunk.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtrace.plans.tables import materialize, work_dir

US = 1_000_000


def null_safe(left: DataFrame, right: DataFrame, keys: list[str]) -> Column:
    cond = None
    for k in keys:
        c = left[k].eqNullSafe(right[k])
        cond = c if cond is None else cond & c
    return cond


#: Key columns that every event has: plain equality lets a join reuse the partitioning below it.
NEVER_NULL = {"tenant_id", "source", "g_source", "file_path", "store", "kind"}


def join_keys(left: DataFrame, right: DataFrame, keys: list[str], how: str = "left") -> DataFrame:
    """Join on keys where NULL equals NULL, keeping the left copy of the keys."""
    renamed = right.select(*[F.col(k).alias(f"__r_{k}") for k in keys],
                           *[c for c in right.columns if c not in keys])
    cond = None
    for k in keys:
        c = F.col(k) == F.col(f"__r_{k}") if k in NEVER_NULL else F.col(k).eqNullSafe(F.col(f"__r_{k}"))
        cond = c if cond is None else cond & c
    return left.join(renamed, cond, how).drop(*[f"__r_{k}" for k in keys])


def led(keys: list[str], *more: str):
    """Window over the keys. A hash of them leads, so the sort below compares one number, not strings that mostly agree."""
    return Window.partitionBy(F.xxhash64(*keys), *keys, *more)


def fires_after(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                armed: Column, firing: Column) -> DataFrame:
    """Rows of `firing` whose previous armed-or-firing row of the same key is `armed`.

    This is the arm / consume-once rule: arming twice counts once, and only the first
    firing row after an arming row consumes it.
    """
    seq = (df.withColumn("__arm", F.coalesce(armed, F.lit(False)))
             .withColumn("__fire", F.coalesce(firing, F.lit(False)))
             .filter("__arm or __fire")
             .withColumn("__chunk", chunk))
    local = led(keys, "__chunk").orderBy(*order)
    seq = (seq.withColumn("__prev", F.lag("__arm").over(local))
              .withColumn("__next", F.lead("__arm").over(local)))
    inside = seq.filter("__fire and __prev")
    # first and last row of every chunk: at most two rows per chunk cross to the next stage
    across = led(keys).orderBy("__chunk", *order)
    edges = seq.filter("__prev is null or __next is null")
    edge_hits = (edges.withColumn("__carry", F.lag("__arm").over(across))
                 .filter("__fire and __prev is null and __carry").drop("__carry"))
    return inside.unionByName(edge_hits).drop("__arm", "__fire", "__prev", "__next", "__chunk")


def _chunk_state(df: DataFrame, keys: list[str], order: list[str], value: str,
                 ignore_nulls: bool) -> DataFrame:
    """Value carried into every chunk from the chunks before it."""
    src = df.filter(F.col(value).isNotNull()) if ignore_nulls else df
    last = (src.groupBy(*keys, "__chunk")
            .agg(F.max_by(F.struct(F.col(value).alias("v")), F.struct(*order)).alias("__last")))
    if ignore_nulls:
        chunks = df.select(*keys, "__chunk").distinct()
        last = join_keys(chunks, last, keys + ["__chunk"])
    w = Window.partitionBy(*keys).orderBy("__chunk")
    if ignore_nulls:
        before = F.last("__last", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, -1))
    else:
        before = F.lag("__last").over(w)
    return last.select(*keys, "__chunk", before["v"].alias("__in"))


def _across(d: DataFrame, keys: list[str], order: list[str], value: str, ignore_nulls: bool, work: str) -> DataFrame:
    """States of `_chunk_state` for keys that reach beyond chunk 0, written: other keys have one chunk and nothing to carry."""
    beyond = materialize(d.filter("__chunk <> 0 or __chunk is null").select(*keys).distinct(), f"{work}/beyond")
    narrow = d.select(*dict.fromkeys([*keys, *order, "__chunk", value]))
    return materialize(_chunk_state(join_keys(narrow, beyond, keys, "left_semi"), keys, order, value, ignore_nulls), f"{work}/states")


def carry_forward(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                  value: str, out: str, work: str | None = None) -> DataFrame:
    """Last non-null value so far, per key.

    With a work folder the rows are written once, after the step inside the chunks, and the states that cross chunks
    beside them: with short keys those are few, and no row is sorted again to meet them.
    """
    d = df.withColumn("__chunk", chunk)
    w = (Window.partitionBy(*keys, "__chunk").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("__loc", F.last(value, ignorenulls=True).over(w))
    if work:
        d = materialize(d, f"{work}/rows")
    state = _across(d, keys, order, value, True, work) if work else _chunk_state(df.withColumn("__chunk", chunk), keys, order, value, True)
    j = join_keys(d, state, keys + ["__chunk"])
    return j.withColumn(out, F.coalesce("__loc", "__in")).drop("__loc", "__in", "__chunk")


def previous_value(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                   value: str, out: str, work: str | None = None) -> DataFrame:
    """Value of the previous row, per key (NULL on the first row). `work` as in `carry_forward`."""
    d = df.withColumn("__chunk", chunk)
    w = Window.partitionBy(*keys, "__chunk").orderBy(*order)
    d = d.withColumn("__loc", F.lag(F.struct(F.col(value).alias("v"))).over(w))
    if work:
        d = materialize(d, f"{work}/rows")
    state = _across(d, keys, order, value, False, work) if work else _chunk_state(df.withColumn("__chunk", chunk), keys, order, value, False)
    j = join_keys(d, state, keys + ["__chunk"])
    return (j.withColumn(out, F.when(F.col("__loc").isNotNull(), F.col("__loc.v")).otherwise(F.col("__in")))
            .drop("__loc", "__in", "__chunk"))


def running_sum(df: DataFrame, keys: list[str], order: list[str], chunk: Column,
                value: Column, out: str) -> DataFrame:
    """Running total including the current row, per key."""
    d = df.withColumn("__chunk", chunk).withColumn("__val", value)
    w = (Window.partitionBy(*keys, "__chunk").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    local = d.withColumn("__loc", F.sum("__val").over(w))
    per_chunk = d.groupBy(*keys, "__chunk").agg(F.sum("__val").alias("__tot"))
    before = Window.partitionBy(*keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = per_chunk.select(*keys, "__chunk", F.coalesce(F.sum("__tot").over(before), F.lit(0)).alias("__off"))
    j = join_keys(local, offset, keys + ["__chunk"])
    return j.withColumn(out, F.col("__loc") + F.col("__off")).drop("__val", "__loc", "__off", "__chunk")


def row_numbers(df: DataFrame, keys: list[str], order: list[str], chunk: Column, out: str) -> DataFrame:
    """row_number() per key without sorting a whole key in one task."""
    return running_sum(df, keys, order, chunk, F.lit(1), out)


def edit_runs(df: DataFrame, keys: list[str], order: list[str], chunk: Column, cut: Column,
              item: str, month: str | None = None) -> DataFrame:
    """Lengths of edit runs: how often an item occurs between two cuts of the same key.

    Rows are counted inside a chunk first, so only (chunk, epoch, item) totals travel.
    The month of a run is the month of its last dated edit.
    """
    d = df.withColumn("__chunk", chunk).withColumn("__cut", F.coalesce(cut, F.lit(False)).cast("int"))
    w = (led(keys, "__chunk").orderBy(*order)
         .rowsBetween(Window.unboundedPreceding, Window.currentRow))
    d = d.withColumn("__ep", F.sum("__cut").over(w))
    dated = F.max(F.when(F.col(month).isNotNull(), F.struct(F.struct("__chunk", *order).alias("o"),
                                                           F.col(month).alias("m")))).alias("__m") \
        if month else F.lit(None).cast("string").alias("__m")
    counts = (d.filter((F.col("__cut") == 0) & F.col(item).isNotNull())
              .groupBy(*keys, "__chunk", "__ep", item).agg(F.count(F.lit(1)).alias("__n"), dated))
    cuts = d.groupBy(*keys, "__chunk").agg(F.sum("__cut").alias("__c"))
    before = led(keys).orderBy("__chunk").rowsBetween(Window.unboundedPreceding, -1)
    offset = cuts.select(*keys, "__chunk", F.coalesce(F.sum("__c").over(before), F.lit(0)).alias("__off"))
    j = join_keys(counts, offset, keys + ["__chunk"])
    month_out = F.max("__m")["m"].alias("month") if month else F.lit(None).cast("string").alias("month")
    return (j.withColumn("__ep", F.col("__ep") + F.col("__off"))
            .groupBy(*keys, "__ep", item).agg(F.sum("__n").cast("bigint").alias("depth"), month_out)
            .drop("__ep"))


# ---- active time -------------------------------------------------------------------
def activity_buckets(df: DataFrame, keys: list[str], ts: str, width_s: int) -> DataFrame:
    """First and last instant per key and time bucket.

    Gaps inside a bucket are shorter than the bucket, so with a bucket no wider than the
    gap cap the active time inside it is exactly last - first: the rows of a hot session
    are reduced by map-side partial aggregation before anything is sorted.
    """
    us = F.unix_micros(F.col(ts).cast("timestamp"))
    return (df.filter(F.col(ts).isNotNull())
            .groupBy(*keys, F.floor(us / F.lit(width_s * US)).alias("__b"))
            .agg(F.min(us).alias("__lo"), F.max(us).alias("__hi")))


def merge_buckets(buckets: DataFrame, keys: list[str]) -> DataFrame:
    """Bring buckets to a coarser key (e.g. from source and month up to the tenant)."""
    return buckets.groupBy(*keys, "__b").agg(F.min("__lo").alias("__lo"), F.max("__hi").alias("__hi"))


def with_tail(buckets: DataFrame, keys: list[str], cap_s: int) -> DataFrame:
    """Active time after each bucket: the capped gap to the key's next bucket, 0 after the last.

    (`least` skips NULL, so the last bucket needs its own case.)
    """
    w = led(keys).orderBy("__b")
    gap = F.lead("__lo").over(w) - F.col("__hi")
    return buckets.withColumn("__tail", F.when(gap.isNull(), 0).otherwise(F.least(gap, F.lit(cap_s * US))))


def capped_duration(df: DataFrame, keys: list[str], ts: str, cap_s: int = 600) -> DataFrame:
    """Seconds of activity per key: consecutive gaps, each capped."""
    return duration_of_buckets(activity_buckets(df, keys, ts, cap_s), keys, cap_s)


def duration_of_buckets(buckets: DataFrame, keys: list[str], cap_s: int = 600) -> DataFrame:
    return with_tail(buckets, keys, cap_s).groupBy(*keys).agg(
        (F.sum(F.col("__hi") - F.col("__lo") + F.col("__tail")) / F.lit(float(US))).alias("active_s"))


def active_union(df: DataFrame, owner: list[str], session: list[str], ts: str,
                 cap_s: int = 600) -> DataFrame:
    """Seconds covered by the union of all sessions' active intervals, per owner."""
    return union_of_buckets(activity_buckets(df, owner + session, ts, cap_s), owner, session, cap_s)


def union_of_buckets(buckets: DataFrame, owner: list[str], session: list[str], cap_s: int = 600) -> DataFrame:
    """An interval is shorter than two caps, so it is cut at fixed slot borders and the union
    is taken per (owner, slot); the sum over slots is exactly the global union."""
    slot = cap_s * US
    iv = (with_tail(buckets, owner + session, cap_s)
          .select(*owner, F.col("__lo").alias("s"), (F.col("__hi") + F.col("__tail")).alias("e")))
    cut = (iv.withColumn("slot", F.explode(F.sequence(F.floor(F.col("s") / F.lit(slot)),
                                                      F.floor(F.col("e") / F.lit(slot)))))
           .select(*owner, "slot", F.greatest("s", F.col("slot") * slot).alias("s"),
                   F.least("e", (F.col("slot") + 1) * slot).alias("e"))
           .groupBy(*owner, "slot", "s").agg(F.max("e").alias("e")))
    w = (led([*owner, "slot"]).orderBy("s")
         .rowsBetween(Window.unboundedPreceding, -1))
    covered = F.coalesce(F.max("e").over(w), F.col("s"))
    piece = F.greatest(F.col("e") - F.greatest("s", covered), F.lit(0))
    return (cut.withColumn("__p", piece).groupBy(*owner)
            .agg((F.sum("__p") / F.lit(float(US))).alias("active_s")))


def longest_burst(df: DataFrame, owner: list[str], session: list[str], ts: str,
                  gap_s: int = 1800, cap_s: int = 600) -> DataFrame:
    """Longest stretch of one session without a gap above `gap_s`, in seconds, per owner."""
    return burst_of_buckets(activity_buckets(df, owner + session, ts, min(gap_s, cap_s)), owner, session, gap_s)


def burst_of_buckets(buckets: DataFrame, owner: list[str], session: list[str], gap_s: int = 1800) -> DataFrame:
    keys = owner + session
    w = led(keys).orderBy("__b")
    # the start of a run goes along with its buckets, so runs need no grouping of their own
    last = F.lag("__hi").over(w)
    b = buckets.withColumn("__start", F.when(last.isNull() | (F.col("__lo") - last > gap_s * US), F.col("__lo")))
    b = b.withColumn("__start", F.last("__start", ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return b.groupBy(*owner).agg((F.max(F.col("__hi") - F.col("__start")) / F.lit(float(US))).alias("longest_s"))


# ---- pairing -----------------------------------------------------------------------
def nth_pairs(left: DataFrame, right: DataFrame, keys: list[str], left_order: list[str],
              right_order: list[str], left_chunk: Column, right_chunk: Column) -> DataFrame:
    """The nth row of the left pairs with the nth row of the right of the same key."""
    l = row_numbers(left, keys, left_order, left_chunk, "__n")
    r = row_numbers(right, keys, right_order, right_chunk, "__n")
    return join_keys(l, r, keys + ["__n"]).drop("__n")


def tree_scan(rows: DataFrame, keys: list[str], n: str, payload: list[str], unit: Column, compose, state: Column, apply, step, result: str,
              work: str, group_rows: int = 512) -> DataFrame:
    """Replay a recurrence over the rows 1, 2, … (`n`) of each key, in groups that many tasks share.

    The rows' transitions compose: `compose(acc, row)` extends the composition `acc` (it starts as `unit`) by a
    row, or by the composition of a lower level. Groups of at most `group_rows` rows are composed, then
    groups of groups; a key's top list is one element for `group_rows`^2 rows. From the top, every level
    turns its entry state into those of the level below with `apply(state, composition)`. Last, each group runs
    `step(state, row)` -> (new state, value) from its own entry.

    Returns keys, payload and `result`.
    """
    item = F.struct(F.col(n).alias("n"), *payload)
    base = rows.withColumn("__g", F.floor((F.col(n) - 1) / group_rows).cast("bigint"))
    groups = base.groupBy(*keys, "__g").agg(F.array_sort(F.collect_list(item)).alias("__rows"))
    groups = materialize(groups.withColumn("__f", F.aggregate("__rows", unit, compose)), f"{work}/scan_groups")
    above = groups.withColumn("__h", F.floor(F.col("__g") / group_rows).cast("bigint")).groupBy(*keys, "__h").agg(F.array_sort(F.collect_list(F.struct("__g", "__f"))).alias("__list"))
    above = materialize(above.withColumn("__f", F.aggregate("__list", unit, lambda acc, x: compose(acc, x["__f"]))), f"{work}/scan_above")

    def entries(parent: DataFrame, ids: str) -> DataFrame:
        """Entry states of the elements of `__list`, from the list's own `__state`."""
        none = F.array().cast(f"array<struct<i:bigint,s:{dict(parent.dtypes)['__state']}>>")
        first = F.struct(F.col("__state").alias("at"), none.alias("out"))
        walk = F.aggregate("__list", first, lambda acc, x: F.struct(apply(acc["at"], x["__f"]).alias("at"), F.array_append(acc["out"], F.struct(x[ids].alias("i"), acc["at"].alias("s"))).alias("out")))
        return parent.select(*keys, F.explode(walk["out"]).alias("e")).select(*keys, F.col("e.i").alias(ids), F.col("e.s").alias("__state"))

    top = above.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("__h", "__f"))).alias("__list")).withColumn("__state", state)
    middle = join_keys(above, entries(top, "__h"), [*keys, "__h"])
    inside = join_keys(groups, entries(middle, "__g"), [*keys, "__g"])
    kind = inside.select(step(F.col("__state"), F.col("__rows")[0])[1].alias("v")).dtypes[0][1]
    blank = F.struct(F.col("__state").alias("at"), F.array().cast(f"array<{kind}>").alias("out"))

    def one(acc: Column, x: Column) -> Column:
        to, value = step(acc["at"], x)
        return F.struct(to.alias("at"), F.array_append(acc["out"], value).alias("out"))
    played = inside.select(*keys, F.explode(F.arrays_zip("__rows", F.aggregate("__rows", blank, one)["out"].alias("v"))).alias("e"))
    return played.select(*keys, *[F.col(f"e.__rows.{c}").alias(c) for c in payload], F.col("e.v").alias(result))


def in_ranges(df: DataFrame, keys: list[str], order: list[str], path: str) -> DataFrame:
    """`df` written in ranges of bounded size by (keys, order); `__cut` numbers them, so it grows with the order of each key.

    Ranges follow the density of the rows: neither a key, nor a day, nor undated rows make one large range.
    """
    return materialize(df.repartitionByRange(*keys, *order).withColumn("__cut", F.spark_partition_id()), path)


def consume_once(artifacts: DataFrame, executions: DataFrame, keys: list[str], exec_id: list[str],
                 t: str, window_s: float, group_rows: int = 512, work: str | None = None) -> DataFrame:
    """Credit executions with the earliest unused artifact of the last `window_s` seconds.

    Executions claim in time order and an artifact credits one execution.  With artifacts
    numbered by time, an execution at T sees artifacts [L, R): L counts those before
    T - window, R those up to T.  The next free artifact after execution n is

        h(n) = min(max(h(n-1), L) + 1, R)

    and k(n) = h(n) - n makes that k(n) = min(max(k(n-1), L + 1 - n), R - n): a clamp.
    Clamps compose into clamps, so `tree_scan` replays a key in many tasks. Artifacts and
    executions are counted in ranges of rows, whatever day they fall on.
    """
    work = f"{work or work_dir(artifacts.sparkSession)}/credit"
    eid = F.struct(*[F.col(c) for c in exec_id])
    art = artifacts.select(*keys, F.col(t).cast("double").alias("__t"), F.lit(0).alias("__kind"),
                           F.lit(None).cast(executions.select(eid.alias("x")).schema["x"].dataType).alias("__id"))
    hi = executions.select(*keys, F.col(t).cast("double").alias("__t"), F.lit(1).alias("__kind"), eid.alias("__id"))
    lo = executions.select(*keys, (F.col(t).cast("double") - F.lit(float(window_s))).alias("__t"),
                           F.lit(-1).alias("__kind"), eid.alias("__id"))
    order = ["__t", "__kind", "__id"]
    seq = in_ranges(art.unionByName(hi).unionByName(lo), keys, order, f"{work}/rows")
    part = Window.partitionBy(*keys, "__cut")
    upto = part.orderBy(*order).rowsBetween(Window.unboundedPreceding, Window.currentRow)
    is_art, is_hi = (F.when(F.col("__kind") == k, 1).otherwise(0) for k in (0, 1))
    before = Window.partitionBy(*keys).orderBy("__cut").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = seq.groupBy(*keys, "__cut").agg(F.sum(is_art).alias("a"), F.sum(is_hi).alias("e"))
    sums = sums.select(*keys, "__cut", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"{c}0") for c in "ae"])
    seen = join_keys(seq.withColumn("__a", F.sum(is_art).over(upto)).withColumn("__e", F.sum(is_hi).over(upto)), sums, [*keys, "__cut"])
    arts = F.col("__a") + F.col("a0")
    ex = seen.filter("__kind <> 0").groupBy(*keys, "__id").agg(
        F.max(F.when(F.col("__kind") == 1, arts)).alias("R"), F.max(F.when(F.col("__kind") == -1, arts)).alias("L"),
        F.max(F.when(F.col("__kind") == 1, F.col("__e") + F.col("e0"))).alias("n"))
    ex = materialize(ex, f"{work}/bounds")

    def clamp(v: Column, low: Column, high: Column) -> Column:
        return F.least(F.greatest(v, low), high)

    def step(k: Column, x: Column) -> tuple[Column, Column]:
        h = F.greatest(k + x["n"] - 1, x["L"])
        return F.least(h + 1, x["R"]) - x["n"], h < x["R"]

    far = 1 << 60
    unit = F.struct(F.lit(-far).cast("bigint").alias("a"), F.lit(far).cast("bigint").alias("b"))
    rows = ex.withColumn("a", F.col("L") + 1 - F.col("n")).withColumn("b", F.col("R") - F.col("n"))
    done = tree_scan(rows, keys, "n", ["a", "b", "L", "R", "__id"], unit, lambda acc, x: F.struct(clamp(acc["a"], x["a"], x["b"]).alias("a"), clamp(acc["b"], x["a"], x["b"]).alias("b")),
                     F.lit(0).cast("bigint"), lambda k, f: clamp(k, f["a"], f["b"]), step, "credited", work, group_rows)
    return done.select(*keys, *[F.col(f"__id.{c}").alias(c) for c in exec_id], "credited")
