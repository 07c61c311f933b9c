"""Streams against their batch rules."""
import datetime as dt
import os
import random

import pytest
from pyspark.sql import functions as F

from loomtrace.operators import sequence as S
from loomtrace.streaming import ordered as O

SCHEMA = "k string, ts timestamp, ordinal bigint, arm boolean, fire boolean"


def _rows(seed):
    r, start = random.Random(seed), dt.datetime(2024, 3, 1)
    rows = []
    for n in range(700):
        arm = r.random() < .4
        rows.append((r.choice(["a", "a", "a", "b", None]), start + dt.timedelta(seconds=r.randrange(0, 40_000, 50), microseconds=r.choice([0, 1, 999_999])), n, arm, not arm and r.random() < .8))
    return rows


@pytest.mark.parametrize("seed", [1, 2])
def test_live_rule_equals_batch_in_any_arrival_order(spark, tmp_path, seed):
    """Rows come up to an hour late, over nine files; two last rows move the watermark past all."""
    r, rows, src = random.Random(seed), _rows(seed), tmp_path / "in"
    arrival = sorted(rows, key=lambda x: x[1] + dt.timedelta(seconds=r.uniform(0, 3500)))
    end = dt.datetime(2024, 3, 3)
    files = [arrival[k:k + 90] for k in range(0, len(arrival), 90)] + [[("z", end, 0, True, False)], [("z", end + dt.timedelta(days=1), 1, True, False)]]
    for k, part in enumerate(files):
        spark.createDataFrame(part, SCHEMA).coalesce(1).write.parquet(str(src / f"p{k:02}"))
        for name in os.listdir(src / f"p{k:02}"):
            os.utime(src / f"p{k:02}" / name, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(SCHEMA).option("maxFilesPerTrigger", 1).parquet(str(src / "*"))
    out = str(tmp_path / "out")
    q = (O.fires_live(stream, ["k"], ["ordinal"], "1 hour").writeStream.format("parquet").option("path", out)
         .option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start())
    q.awaitTermination()
    got = sorted((x.k or "", x.ts, x.ordinal) for x in spark.read.parquet(out).collect())
    want = S.fires_after(spark.createDataFrame(rows, SCHEMA), ["k"], ["ts", "ordinal"], F.date_trunc("hour", "ts"), F.col("arm"), F.col("fire"))
    assert got == sorted((x.k or "", x.ts, x.ordinal) for x in want.collect()) and len(got) > 100


def test_live_recovery_and_grounding_read_call_facts(spark, tmp_path):
    at = lambda s: dt.datetime(2024, 3, 1) + dt.timedelta(seconds=s)
    key = ("t", "claude", "f", "s")
    calls = "tenant_id string, source string, file_path string, session_id string, ts timestamp, ordinal bigint, sub int, block_pos int, error_flag boolean, arms boolean, is_write boolean"
    rows = [(*key, at(s), s, 0, 0, e, a, w) for s, e, a, w in ((0, False, True, False), (1, False, False, True), (2, True, False, False), (3, False, False, True))]
    late = [("t", "claude", "g", "s2", at(10 ** 6 * k), 0, 0, 0, False, True, False) for k in (1, 2)]
    for k, part in enumerate([rows, late[:1], late[1:]]):
        spark.createDataFrame(part, calls).coalesce(1).write.parquet(str(tmp_path / f"p{k}"))
        for name in os.listdir(tmp_path / f"p{k}"):
            os.utime(tmp_path / f"p{k}" / name, (1_700_000_000 + k, 1_700_000_000 + k))
    stream = spark.readStream.schema(calls).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "p*"))
    for name, made, want in (("r", O.recoveries(stream.filter("not error_flag"), stream), [3]), ("g", O.grounded_writes(stream), [1])):
        q = made.writeStream.format("memory").queryName(f"live_{name}").trigger(availableNow=True).start()
        q.awaitTermination()
        assert [x.ordinal for x in spark.table(f"live_{name}").collect() if x.file_path == "f"] == want
