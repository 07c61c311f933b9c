"""Ordered operators against brute force, with chunk borders inside the data and hot keys."""
import random
import statistics

import pytest
from pyspark.sql import functions as F

from loomtrace.plans import tables
from loomtrace.operators import aggregates as A, joins as J, planning as P, sequence as S


def rows(seed, n=400, keys="ab"):
    rnd = random.Random(seed)
    out = []
    for i in range(n):
        out.append((rnd.choice(keys + "aaa"), i, rnd.choice(["arm", "fire", "cut", "x"]), rnd.choice([None, 1, 2, 3])))
    return out


@pytest.mark.parametrize("seed,width", [(1, 3), (2, 7), (3, 1000)])
def test_chunks_do_not_change_results(spark, seed, width):
    data = rows(seed)
    df = spark.createDataFrame(data, "k string, o long, kind string, v int")
    chunk = F.floor(F.col("o") / width)
    fired = {(r.k, r.o) for r in S.fires_after(df, ["k"], ["o"], chunk, F.col("kind") == "arm", F.col("kind") == "fire").collect()}
    carried = {(r.k, r.o): r.c for r in S.carry_forward(df, ["k"], ["o"], chunk, "v", "c").collect()}
    prev = {(r.k, r.o): r.p for r in S.previous_value(df, ["k"], ["o"], chunk, "v", "p").collect()}
    num = {(r.k, r.o): r.n for r in S.row_numbers(df, ["k"], ["o"], chunk, "n").collect()}
    runs = sorted((r.k, r.kind, r.depth) for r in S.edit_runs(df, ["k"], ["o"], chunk, F.col("kind") == "cut", "kind").collect())
    want_fire, want_runs = set(), []
    for k in {d[0] for d in data}:
        armed, last, before, n, cur = False, None, None, 0, {}
        for _, o, kind, v in (d for d in data if d[0] == k):
            if kind == "fire" and armed:
                want_fire.add((k, o))
            armed = True if kind == "arm" else False if kind == "fire" else armed
            n += 1
            assert num[(k, o)] == n and prev[(k, o)] == before
            before, last = v, v if v is not None else last
            assert carried[(k, o)] == last
            if kind == "cut":
                want_runs += [(k, i, c) for i, c in cur.items()]
                cur = {}
            else:
                cur[kind] = cur.get(kind, 0) + 1
        want_runs += [(k, i, c) for i, c in cur.items()]
    assert fired == want_fire and runs == sorted(want_runs)


@pytest.mark.parametrize("seed", [1, 2])
def test_active_time_matches_event_level_rules(spark, seed):
    rnd = random.Random(seed)
    data = [("t", rnd.choice("abc"), rnd.randrange(0, 60000) / 1.0) for _ in range(250)]
    df = spark.createDataFrame(data, "o string, s string, e double").withColumn("ts", F.timestamp_micros((F.col("e") * 1e6).cast("bigint")))
    iv, burst, dur = [], 0.0, {}
    for s in "abc":
        t = sorted(e for _, x, e in data if x == s)
        gaps = [min(b - a, 600) for a, b in zip(t, t[1:])]
        dur[s] = sum(gaps)
        iv += [(a, a + g) for a, g in zip(t, gaps)]
        start = t[0]
        for a, b in zip(t, t[1:]):
            if b - a > 1800:
                burst, start = max(burst, a - start), b
        burst = max(burst, t[-1] - start)
    total, end = 0.0, -1.0
    for a, b in sorted(iv):
        total += max(0.0, b - max(a, end))
        end = max(end, b)
    assert abs(S.active_union(df, ["o"], ["s"], "ts").first().active_s - total) < 1e-6
    assert abs(S.longest_burst(df, ["o"], ["s"], "ts").first().longest_s - burst) < 1e-6
    assert {r.s: round(r.active_s, 6) for r in S.capped_duration(df, ["s"], "ts").collect()} == {k: round(v, 6) for k, v in dur.items()}


def test_one_plan_credits_one_execution(spark):
    rnd = random.Random(3)
    arts = [(rnd.choice(["a", "b", None]), rnd.randrange(0, 3000) * 100.0) for _ in range(120)]
    ex = [(rnd.choice(["a", "b", None]), i, rnd.randrange(0, 3000) * 100.0) for i in range(120)]
    got = {r.id: r.credited for r in S.consume_once(spark.createDataFrame(arts, "k string, t double"), spark.createDataFrame(ex, "k string, id long, t double"),
                                                    ["k"], ["id"], "t", 2000.0, group_rows=8).collect()}
    want = {}
    for k in ("a", "b", None):
        free = sorted(t for x, t in arts if x == k)
        for _, i, t in sorted((e for e in ex if e[0] == k), key=lambda e: (e[2], e[1])):
            c = [a for a in free if t - 2000 <= a <= t]
            want[i] = bool(c)
            if c:
                free.remove(c[0])
    assert got == want


def test_plan_credit_spreads_one_hot_day(spark):
    """One directory, one second: groups of groups, and no range that holds the whole key."""
    rnd = random.Random(5)
    arts = [("a", float(rnd.randrange(40)) if rnd.random() < .9 else float("inf")) for _ in range(400)]
    ex = [("a", i, float(rnd.randrange(40)) if rnd.random() < .9 else float("inf")) for i in range(500)]
    got = {r.id: r.credited for r in S.consume_once(spark.createDataFrame(arts, "k string, t double"), spark.createDataFrame(ex, "k string, id long, t double"),
                                                    ["k"], ["id"], "t", 7.0, group_rows=4).collect()}
    free, want = sorted(t for _, t in arts), {}
    for _, i, t in sorted(ex, key=lambda e: (e[2], e[1])):
        c = [a for a in free if t - 7.0 <= a <= t]
        want[i] = bool(c)
        if c:
            free.remove(c[0])
    assert got == want
    spark.conf.set("spark.sql.adaptive.coalescePartitions.enabled", "false")  # small ranges stay apart
    cut = S.in_ranges(spark.createDataFrame(ex, "k string, id long, t double"), ["k"], ["t", "id"], tables.work_dir(spark))
    spark.conf.unset("spark.sql.adaptive.coalescePartitions.enabled")
    sizes = [r["count"] for r in cut.groupBy("__cut").count().collect()]
    assert len(sizes) >= 3 and max(sizes) < 300


def test_nearest_rank_statistics(spark):
    rnd = random.Random(5)
    vals = [rnd.randrange(1, 30) for _ in range(101)]
    r = A.depth_stats(spark.createDataFrame([("o", v) for v in vals], "o string, d int"), ["o"], "d").first()
    s = sorted(vals)
    assert abs(r["mean"] - statistics.mean(s)) < 1e-9 and r["median"] == statistics.median(s) and r["max"] == max(s)
    assert r["p90"] == s[int(round(0.9 * (len(s) - 1)))] and r["heavy"] == sum(v > 15 for v in s)


def test_recovery_classes_partition(spark):
    rnd = random.Random(7)
    data = [("s" + str(rnd.randrange(3)), i, rnd.choice("xyz"), rnd.random() > .4) for i in range(60)]
    got = {r.o: r.outcome for r in J.recovery_classes(spark.createDataFrame(data, "s string, o int, tool string, ok boolean"), ["s"], "tool", "ok", ["o"]).collect()}
    for s, o, tool, ok in data:
        if ok:
            assert o not in got
            continue
        later = [d for d in data if d[0] == s and d[1] > o]
        same = [d for d in later if d[2] == tool]
        want = "nothing_after" if not later else "retried_ok" if any(d[3] for d in same) else "retried_failing" if same else "other_only"
        assert got[o] == want


def test_longest_prefix_wins(spark):
    names = spark.createDataFrame([("plugin-atl-atl-search",), ("atl_get",), ("Read",)], "name string")
    servers = spark.createDataFrame([("plugin-atl", "p"), ("plugin-atl-atl", "q"), ("atl", "r")], "prefix string, label string")
    got = {r.name: (r.server, r.tool) for r in J.longest_prefix(names, servers, [], "name", "prefix", "label").collect()}
    assert got == {"plugin-atl-atl-search": ("q", "search"), "atl_get": ("r", "get"), "Read": (None, None)}


def test_clones_count_once(spark):
    d = spark.createDataFrame([(["s2", "s1"], "", "/a", "me", "me", False, "c1", 3, 1), (["s1", "s2"], "", "/b", "me", "me", False, "c1", 3, 1),
                               (["s1", "s2"], "", "/a", "me", "you", False, "c2", 9, 9), (["s1", "s2"], "", "/a", "me", "me", True, "c3", 9, 9)],
                              "repo_root_shas array<string>, remote string, top string, user_email string, author_email string, is_merge boolean, commit_id string, added long, deleted long"
                              ).withColumn("commit_ts", F.lit("2026-01-01").cast("timestamp"))
    r = J.churn_totals(J.repo_churn(d, []), []).first()
    assert (r.repos_seen, r.insertions, r.deletions, r.commits) == (1, 3, 1, 1)


def test_month_windows(spark):
    w = {r.month: (str(r.since), str(r.until)) for r in P.trailing_window(P.month_spine(spark, "2026-03-15", 3), "2026-03-15").collect()}
    assert w == {"2026-01": ("2026-01-01", "2026-02-01"), "2026-02": ("2026-02-01", "2026-03-01"), "2026-03": ("2026-02-13", "2026-03-16")}


def test_written_chunks_carry_across(spark, tmp_path):
    """With a work folder only keys beyond chunk 0 have states; results are those without one."""
    rows = [("a", 1, None), ("a", 2, "x"), ("a", 12, None), ("a", 25, None), ("a", 31, "y"), ("b", 3, "z"), ("b", 4, None), ("c", 17, None), ("c", 18, "w"), (None, 5, "n"), (None, 41, None)]
    df = spark.createDataFrame(rows, "k string, o bigint, v string")
    chunk = F.floor(F.col("o") / 10)
    for f, out in ((S.carry_forward, "c"), (S.previous_value, "c")):
        want = {(r.k, r.o): r.c for r in f(df, ["k"], ["o"], chunk, "v", out).collect()}
        work = str(tmp_path / f.__name__)
        got = {(r.k, r.o): r.c for r in f(df, ["k"], ["o"], chunk, "v", out, work).collect()}
        assert got == want and len(got) == len(rows)
        assert {r.k for r in spark.read.parquet(f"{work}/states").collect()} == {"a", "c", None}
