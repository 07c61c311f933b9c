"""Arm / consume-once rules over a stream: error recovery and grounding while sessions run.

Rows may arrive in any order inside the watermark. A key holds the rows that the watermark has not
passed yet, and one flag for everything before them. Rows leave in event time order as soon as no
earlier row can arrive, so what is emitted never changes and equals the batch rule.
"""
from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout

from loomtrace.plans.facts import ORDER, THREAD


def fires_live(marks: DataFrame, keys: list[str], order: list[str], late: str = "1 hour") -> DataFrame:
    """Rows of `fire` whose previous armed-or-firing row of the same key is armed.

    marks: keys, ts, the order columns (integers, ties of ts), and the flags arm and fire. Rows
    without a time are outside of event time and dropped; a row behind the watermark is dropped by
    Spark. Equal to `operators.sequence.fires_after` ordered by ts and `order`, for all rows that the
    watermark has passed. The state of a key is bounded by what arrives within `late`, so a long
    history should be read in steps (`event_stream(files_per_trigger=…)`).
    """
    rows = (marks.filter((F.coalesce("arm", F.lit(False)) | F.coalesce("fire", F.lit(False))) & F.col("ts").isNotNull())
            .select(*keys, "ts", F.unix_micros("ts").alias("us"), *[F.col(c).cast("bigint").alias(c) for c in order],
                    F.coalesce("arm", F.lit(False)).alias("arm"), F.coalesce("fire", F.lit(False)).alias("fire"))
            .withWatermark("ts", late))
    at = ["us", *order]
    types = dict(rows.dtypes)
    held = "armed boolean, " + ", ".join(f"`{c}` array<bigint>" for c in at) + ", arm array<boolean>, fire array<boolean>"
    out = ", ".join([*[f"`{k}` {types[k]}" for k in keys], *[f"`{c}` bigint" for c in at]])

    def step(key: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        armed, *columns = state.get if state.exists else (False, *[[] for _ in range(len(at) + 2)])
        waiting = list(zip(*columns))
        for f in frames:
            waiting += zip(*[f[c].tolist() for c in (*at, "arm", "fire")])
        waiting.sort()
        mark = state.getCurrentWatermarkMs()
        hits, done = [], 0
        while done < len(waiting) and waiting[done][0] <= 1000 * mark:
            *place, arm, fire = waiting[done]
            if fire and armed:
                hits.append(place)
            armed, done = arm, done + 1
        waiting = waiting[done:]
        state.update((bool(armed), *[[int(w[k]) for w in waiting] for k in range(len(at))], *[[bool(w[k]) for w in waiting] for k in (-2, -1)]))
        if waiting:
            state.setTimeoutTimestamp(max(mark + 1, waiting[0][0] // 1000))
        if hits:
            found = pd.DataFrame(hits, columns=at)
            for i, k in enumerate(keys):
                found.insert(i, k, pd.Series([None if pd.isna(key[i]) else key[i]] * len(found), dtype=object))
            yield found

    hits = rows.groupBy(*keys).applyInPandasWithState(step, out, held, "append", GroupStateTimeout.EventTimeTimeout)
    return hits.select(*keys, F.timestamp_micros("us").alias("ts"), *order)


def recoveries(calls: DataFrame, results: DataFrame, late: str = "1 hour") -> DataFrame:
    """Tool calls right after an unrecovered error of the same file and session, as they happen."""
    cols = [*THREAD, "ts", *ORDER]
    err = results.filter("error_flag and session_id is not null").select(*cols, F.lit(True).alias("arm"), F.lit(False).alias("fire"))
    use = calls.filter("session_id is not null").select(*cols, F.lit(False).alias("arm"), F.lit(True).alias("fire"))
    return fires_live(err.unionByName(use), THREAD, ORDER, late)


def grounded_writes(calls: DataFrame, late: str = "1 hour") -> DataFrame:
    """Writes that use up a look at knowledge of the same file and session, as they happen."""
    rows = calls.filter("(arms or is_write) and session_id is not null")
    return fires_live(rows.select(*THREAD, "ts", *ORDER, F.col("arms").alias("arm"), F.col("is_write").alias("fire")), THREAD, ORDER, late)
