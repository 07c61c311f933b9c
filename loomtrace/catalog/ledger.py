"""Queries over the order ledger: months, depth, fan-out, mixes, credit, coverage."""
from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.catalog.registry import Tables, query
from loomtrace.functions import models, numbers as N
from loomtrace.operators import aggregates as A, joins as J, planning as P, sequence as S

TODAY = "2001-06-15"


@query("monthly_progression", """
SELECT strftime(o_orderdate, '%Y-%m') AS month, CAST(count(*) AS BIGINT) AS prompts,
       CAST(count(DISTINCT o_custkey) AS BIGINT) AS sessions,
       CAST(count(DISTINCT CAST(o_orderdate AS DATE)) AS BIGINT) AS active_days,
       round(sum(o_totalprice), 2) AS churn, mode_status.top_status
FROM orders JOIN (
  SELECT m, arg_max(o_orderstatus, (n, -ascii(o_orderstatus))) AS top_status FROM (
    SELECT strftime(o_orderdate, '%Y-%m') AS m, o_orderstatus, count(*) AS n FROM orders GROUP BY 1, 2) GROUP BY 1
) AS mode_status ON mode_status.m = strftime(o_orderdate, '%Y-%m')
GROUP BY 1, mode_status.top_status""")
def _(t: Tables):
    o = t.orders.withColumn("month", F.date_format("o_orderdate", "yyyy-MM"))
    base = o.groupBy("month").agg(
        F.count(F.lit(1)).alias("prompts"), F.count_distinct("o_custkey").alias("sessions"),
        F.count_distinct(F.to_date("o_orderdate")).alias("active_days"), F.round(F.sum("o_totalprice"), 2).alias("churn"))
    top = A.top_k(o, ["month"], "o_orderstatus", 1, F.ascii("o_orderstatus"))
    return base.join(top.select("month", F.col("o_orderstatus").alias("top_status")), "month")


@query("depth_stats_nearest_rank", """
WITH d AS (SELECT l_orderkey, count(*) AS depth FROM lineitem GROUP BY 1),
     s AS (SELECT o_custkey % 20 AS owner, depth FROM d JOIN orders ON o_orderkey = l_orderkey),
     r AS (SELECT owner, depth, row_number() OVER (PARTITION BY owner ORDER BY depth) - 1 AS i,
                  count(*) OVER (PARTITION BY owner) AS n FROM s)
SELECT owner, CAST(any_value(n) AS BIGINT) AS runs, round(avg(depth), 6) AS mean, median(depth) AS median,
       CAST(max(depth) FILTER (i = CAST(round_even(0.9 * (n - 1), 0) AS BIGINT)) AS BIGINT) AS p90,
       CAST(max(depth) AS BIGINT) AS max, CAST(count(*) FILTER (depth > 6) AS BIGINT) AS heavy
FROM r GROUP BY 1""")
def _(t: Tables):
    d = t.lineitem.groupBy("l_orderkey").agg(F.count(F.lit(1)).alias("depth"))
    s = d.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select((F.col("o_custkey") % 20).alias("owner"), "depth")
    out = A.depth_stats(s, ["owner"], "depth", heavy=6)
    return out.withColumn("mean", F.round("mean", 6))


@query("fanout_stats", """
WITH d AS (SELECT o_custkey % 20 AS owner, l_orderkey, count(*) FILTER (l_returnflag = 'A') AS n
           FROM lineitem JOIN orders ON o_orderkey = l_orderkey GROUP BY 1, 2)
SELECT owner, median(n) FILTER (n > 0) AS fanout_median, CAST(max(n) AS BIGINT) AS max_session_fanout,
       CAST(count(*) FILTER (n > 0) AS BIGINT) AS delegating_sessions,
       round_even(count(*) FILTER (n >= 2) / count(*) FILTER (n > 0), 3) AS parallel_session_share
FROM d GROUP BY 1 HAVING count(*) FILTER (n > 0) > 0""")
def _(t: Tables):
    j = t.lineitem.join(t.orders, F.col("o_orderkey") == F.col("l_orderkey")).select(
        (F.col("o_custkey") % 20).alias("owner"), "l_orderkey", (F.col("l_returnflag") == "A").cast("int").alias("d"))
    return A.fanout_stats(j, ["owner"], ["l_orderkey"], F.col("d"))


@query("model_mix_offload", """
WITH c AS (SELECT l_suppkey, l_returnflag, count(*) AS n FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, CAST(count(*) AS BIGINT) AS names, CAST(sum(n) AS BIGINT) AS total,
       round(1 - max(n) / sum(n), 6) AS offload FROM c GROUP BY 1""")
def _(t: Tables):
    return A.mix(t.lineitem, ["l_suppkey"], "l_returnflag").withColumn("offload", F.round("offload", 6))


@query("tokens_by_model_month", """
SELECT l_returnflag AS model, strftime(l_shipdate, '%Y-%m') AS month, CAST(sum(l_quantity) AS BIGINT) AS input,
       CAST(sum(l_linenumber) AS BIGINT) AS output FROM lineitem GROUP BY 1, 2""")
def _(t: Tables):
    return t.lineitem.groupBy(F.col("l_returnflag").alias("model"), F.date_format("l_shipdate", "yyyy-MM").alias("month")).agg(
        F.sum("l_quantity").cast("bigint").alias("input"), F.sum("l_linenumber").cast("bigint").alias("output"))


@query("model_usage_top", """
WITH c AS (SELECT p_brand AS model, count(*) AS turns, sum(l_quantity) AS tokens FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
     r AS (SELECT *, row_number() OVER (ORDER BY turns DESC, model) AS rank, sum(turns) OVER () AS total FROM c)
SELECT model, CAST(turns AS BIGINT) AS turns, CAST(tokens AS BIGINT) AS tokens, CAST(rank AS INTEGER) AS rank,
       round(turns / total, 3) AS pct FROM r WHERE rank <= 12""")
def _(t: Tables):
    j = t.lineitem.join(t.part, F.col("p_partkey") == F.col("l_partkey"))
    c = j.groupBy(F.lit(1).alias("owner"), F.col("p_brand").alias("model")).agg(
        F.count(F.lit(1)).alias("turns"), F.sum("l_quantity").cast("bigint").alias("tokens"))
    s = c.join(c.groupBy("owner").agg(F.sum("turns").alias("total")), "owner")
    r = A.rank_counts(s, ["owner"], 12, "turns", ["model"])
    return r.select("model", "turns", "tokens", "rank", F.round(F.col("turns") / F.col("total"), 3).alias("pct"))


@query("cumulative_to_delta", """
WITH c AS (SELECT l_orderkey, l_returnflag, l_linenumber, l_partkey,
                  sum(l_quantity) OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS cum,
                  row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i FROM lineitem),
     d AS (SELECT *, greatest(cum - coalesce(lag(cum) OVER (PARTITION BY l_orderkey ORDER BY i), 0), 0) AS delta FROM c)
SELECT l_returnflag, CAST(sum(delta) AS BIGINT) AS total, CAST(count(*) AS BIGINT) AS snapshots FROM d GROUP BY 1""")
def _(t: Tables):
    order = ["l_linenumber", "l_partkey", "l_suppkey", "l_extendedprice"]
    li = t.lineitem.select("l_orderkey", "l_returnflag", "l_quantity", *order)
    chunk = F.floor(F.col("l_linenumber") / 65536)
    cum = S.running_sum(li, ["l_orderkey"], order, chunk, F.col("l_quantity"), "cum")
    d = S.previous_value(cum, ["l_orderkey"], order, chunk, "cum", "prev")
    delta = F.greatest(F.col("cum") - F.coalesce("prev", F.lit(0.0)), F.lit(0.0))
    return d.groupBy("l_returnflag").agg(F.sum(delta).cast("bigint").alias("total"), F.count(F.lit(1)).alias("snapshots"))


@query("plan_credit", """
WITH RECURSIVE
 a AS (SELECT o_custkey % 50 AS cwd, epoch(o_orderdate) + o_orderkey % 97 AS t FROM orders WHERE o_orderstatus <> 'F'),
 e AS (SELECT o_custkey % 50 AS cwd, o_orderkey AS id, epoch(o_orderdate) + o_orderkey % 89 AS t FROM orders WHERE o_orderstatus = 'F'),
 b AS (SELECT e.cwd, e.id, row_number() OVER (PARTITION BY e.cwd ORDER BY e.t, e.id) AS n,
        (SELECT count(*) FROM a WHERE a.cwd = e.cwd AND a.t < e.t - 259200) AS lo,
        (SELECT count(*) FROM a WHERE a.cwd = e.cwd AND a.t <= e.t) AS hi FROM e),
 w(cwd, n, id, h, ok) AS (
   SELECT cwd, n, id, least(greatest(0, lo) + 1, hi), greatest(0, lo) < hi FROM b WHERE n = 1
   UNION ALL
   SELECT b.cwd, b.n, b.id, least(greatest(w.h, b.lo) + 1, b.hi), greatest(w.h, b.lo) < b.hi
   FROM w JOIN b ON b.cwd = w.cwd AND b.n = w.n + 1)
SELECT id, ok AS credited FROM w""")
def _(t: Tables):
    o = t.orders.select((F.col("o_custkey") % 50).alias("cwd"), F.col("o_orderkey").alias("id"), "o_orderstatus",
                        F.unix_seconds(F.col("o_orderdate").cast("timestamp")).alias("s"))
    a = o.filter("o_orderstatus <> 'F'").select("cwd", (F.col("s") + F.col("id") % 97).alias("t"))
    e = o.filter("o_orderstatus = 'F'").select("cwd", "id", (F.col("s") + F.col("id") % 89).alias("t"))
    return S.consume_once(a, e, ["cwd"], ["id"], "t", 72 * 3600).select("id", "credited")


@query("low_volume_sources", """
SELECT source, CAST(count(DISTINCT doc_id) AS BIGINT) AS sessions FROM documents
GROUP BY 1 HAVING count(DISTINCT doc_id) >= 10""")
def _(t: Tables):
    return A.admitted_sources(t.documents.select("source", "doc_id"), [], "source", "doc_id", 10)


@query("usage_shares", """
WITH s AS (SELECT source, lang, count(*) AS prompts, sum(n_chars) AS chars FROM documents GROUP BY 1, 2),
     t AS (SELECT lang, sum(prompts) AS p, sum(chars) AS c FROM s GROUP BY 1)
SELECT lang, source, CAST(prompts AS BIGINT) AS prompts, CAST(chars AS BIGINT) AS chars,
       round_even(prompts / p, 3) AS prompts_pct, round_even(chars / c, 3) AS chars_pct FROM s JOIN t USING (lang)""")
def _(t: Tables):
    return A.share_of_total(t.documents, ["lang"], "source",
                            {"prompts": F.count(F.lit(1)), "chars": F.sum("n_chars")})


@query("per_message_accounting", """
WITH m AS (SELECT l_suppkey, l_orderkey, count(*) AS lines, sum(l_linenumber) AS s, max(l_linenumber) AS mx, sum(l_quantity) AS q
           FROM lineitem GROUP BY 1, 2)
SELECT l_suppkey, CAST(count(*) AS BIGINT) AS messages, CAST(count(*) FILTER (lines >= 2) AS BIGINT) AS spanning,
       CAST(sum(s) AS BIGINT) AS input_per_line, CAST(sum(q) AS BIGINT) AS output_per_line,
       CAST(sum(mx) AS BIGINT) AS input_per_message, CAST(sum(q) AS BIGINT) AS output_per_message FROM m GROUP BY 1""")
def _(t: Tables):
    li = t.lineitem.select("l_suppkey", "l_orderkey", F.col("l_linenumber").cast("bigint").alias("input"),
                           F.col("l_quantity").cast("bigint").alias("output"))
    return A.per_message_totals(li, ["l_suppkey"], "l_orderkey", ["input"], ["output"])


@query("coverage_months", """
WITH x AS (SELECT DISTINCT strftime(l_shipdate, '%Y-%m') AS month, l_orderkey AS sid FROM lineitem),
     i AS (SELECT DISTINCT strftime(o_orderdate, '%Y-%m') AS month, o_orderkey AS sid FROM orders),
     b AS (SELECT coalesce(x.month, i.month) AS month, count(x.sid) AS available, count(i.sid) AS indexed,
                  count(CASE WHEN x.sid IS NOT NULL AND i.sid IS NOT NULL THEN 1 END) AS overlap
           FROM x FULL JOIN i ON x.month = i.month AND x.sid = i.sid GROUP BY 1)
SELECT month, CASE WHEN indexed = 0 THEN 'unknown' WHEN available = 0 THEN 'insufficient'
       WHEN available < indexed THEN 'partial' ELSE 'complete' END AS flag,
       CASE WHEN indexed > 0 THEN CAST(indexed AS BIGINT) END AS indexed, CAST(available AS BIGINT) AS available,
       CASE WHEN indexed > 0 THEN round_even(available / indexed, 3) END AS coverage,
       CAST(available - CASE WHEN indexed > 0 THEN overlap ELSE 0 END AS BIGINT) AS transcript_only FROM b""")
def _(t: Tables):
    x = t.lineitem.select(
        F.date_format("l_shipdate", "yyyy-MM").alias("month"), F.col("l_orderkey").alias("sid"))
    i = t.orders.select(F.date_format("o_orderdate", "yyyy-MM").alias("month"), F.col("o_orderkey").alias("sid"))
    return A.month_coverage(x, i, [], "month", "sid")


@query("backfill_plan", f"""
WITH s AS (SELECT o_custkey % 200 AS owner, CASE WHEN o_custkey % 200 % 7 <> 0 AND (o_custkey % 200 % 3 <> 0 OR o_orderdate < TIMESTAMP '2001-05-01') THEN strftime(o_orderdate, '%Y-%m') END AS month, count(*) AS n FROM orders GROUP BY 1, 2),
     o AS (SELECT DISTINCT o_custkey % 200 AS owner FROM orders),
     p AS (SELECT owner, max(CASE WHEN month = '2001-05' THEN n END) AS pn, count(month) AS known FROM s GROUP BY 1),
     q AS (SELECT o.owner, coalesce(known, 0) AS known, pn, CASE WHEN o.owner % 2 = 0 THEN o.owner % 3 END AS producible FROM o LEFT JOIN p USING (owner))
SELECT owner, strftime(m, '%Y-%m') AS month, 'initial' AS reason FROM q, (SELECT unnest(generate_series(TIMESTAMP '2000-07-01', TIMESTAMP '2001-06-01', INTERVAL 1 MONTH)) AS m) WHERE known = 0
UNION ALL SELECT owner, '2001-06', 'current' FROM q WHERE known > 0
UNION ALL SELECT owner, '2001-05', CASE WHEN pn IS NULL THEN 'gap'
     WHEN pn % 2 = 1 AND producible IS NOT NULL THEN 'contract-upgrade' ELSE 'refresh' END
  FROM q WHERE known > 0 AND (pn IS NULL OR (pn % 2 = 1 AND producible IS NOT NULL) OR (producible IS NOT NULL AND producible > pn % 3))""")
def _(t: Tables):
    o = t.orders.select((F.col("o_custkey") % 200).alias("owner"), "o_orderdate", "o_custkey")
    own, d = F.col("owner"), F.col("o_orderdate")
    # some owners have no stored month, some none of the last ones; every order counts
    month = F.when((own % 7 != 0) & ((own % 3 != 0) | (d < F.lit("2001-05-01").cast("timestamp"))), F.date_format(d, "yyyy-MM"))
    s = o.groupBy("owner", month.alias("month")).agg(F.count(F.lit(1)).alias("n"))
    stored = s.select(
        "owner", "month", F.when(F.col("n") % 2 == 0, "19:19:19").otherwise("18:18:18").alias("score_contract_id"),
        (F.col("n") % 3).alias("stored_rank"), F.when(own % 2 == 0, own % 3).alias("producible_rank"))
    return P.backfill_plan(stored, ["owner"], TODAY)


@query("gap_months", f"""
WITH l AS (SELECT o_custkey AS owner, strftime(max(o_orderdate), '%Y-%m') AS last FROM orders GROUP BY 1),
     m AS (SELECT strftime(unnest(generate_series(TIMESTAMP '2000-07-01', TIMESTAMP '2001-06-01', INTERVAL 1 MONTH)), '%Y-%m') AS month)
SELECT owner, month, CASE WHEN month = '2001-06' THEN 'current' ELSE 'gap' END AS reason FROM l, m WHERE month > last OR month = '2001-06'""")
def _(t: Tables):
    s = t.orders.select(
        F.col("o_custkey").alias("owner"), F.date_format("o_orderdate", "yyyy-MM").alias("month"))
    return P.gap_months(s, ["owner"], "month", TODAY)


@query("trailing_month_counts", """
WITH m AS (SELECT unnest(generate_series(TIMESTAMP '2000-07-01', TIMESTAMP '2001-06-01', INTERVAL 1 MONTH)) AS a),
     w AS (SELECT strftime(a, '%Y-%m') AS month, CASE WHEN a = TIMESTAMP '2001-06-01' THEN TIMESTAMP '2001-05-16' ELSE a END AS lo,
                  CASE WHEN a = TIMESTAMP '2001-06-01' THEN TIMESTAMP '2001-06-16' ELSE a + INTERVAL 1 MONTH END AS hi FROM m)
SELECT month, CAST(count(*) AS BIGINT) AS n FROM w JOIN orders ON o_orderdate >= lo AND o_orderdate < hi GROUP BY 1""")
def _(t: Tables):
    # windows may overlap: an order carries the few windows its date can fall into
    w = P.trailing_window(P.month_spine(t.spark, TODAY, 12), TODAY)
    days = w.select("month", F.explode(F.sequence("since", F.date_sub("until", 1))).alias("d"))   # 12 x 31 rows
    per_day = t.orders.groupBy(F.to_date("o_orderdate").alias("d")).agg(F.count(F.lit(1)).alias("n"))
    return per_day.join(days, "d").groupBy("month").agg(F.sum("n").cast("bigint").alias("n"))


@query("declared_window_months", """
SELECT o_orderkey, CASE WHEN day(s) = 1 AND day(u) = 1 AND (year(u) - year(s)) * 12 + month(u) - month(s) >= 1
       THEN CAST((year(u) - year(s)) * 12 + month(u) - month(s) AS INTEGER) END AS months
FROM (SELECT o_orderkey, CASE WHEN o_orderkey % 3 = 0 THEN date_trunc('month', o_orderdate) ELSE o_orderdate END AS s,
             date_trunc('month', o_orderdate) + to_months(CAST(o_orderkey % 4 AS INTEGER)) AS u FROM orders)""")
def _(t: Tables):
    o = t.orders.withColumn("d", F.col("o_orderdate").cast("timestamp"))
    s = F.when(F.col("o_orderkey") % 3 == 0, F.date_trunc("month", "d")).otherwise(F.col("d"))
    u = F.add_months(F.trunc("d", "MM"), (F.col("o_orderkey") % 4).cast("int")).cast("timestamp")
    return o.select("o_orderkey", P.declared_months(s, u).cast("int").alias("months"))


@query("nested_coverage", """
WITH s AS (SELECT o_orderkey, CAST(o_orderdate AS DATE) AS d, c_nationkey AS repo,
       count(*) FILTER (l_returnflag = 'A' AND l_quantity > 40) AS tests, count(*) FILTER (l_returnflag = 'R' AND l_quantity > 45) AS pushes,
       count(*) FILTER (l_tax > 0.07) AS tf, count(*) FILTER (l_quantity > 30) AS code
       FROM lineitem JOIN orders ON o_orderkey = l_orderkey JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2, 3),
     k AS (SELECT d, repo, sum(tests + pushes) AS other FROM s GROUP BY 1, 2)
SELECT s.repo, CAST(count(*) AS BIGINT) AS sessions, CAST(count(*) FILTER (tests > 0) AS BIGINT) AS ran_tests,
       CAST(count(*) FILTER (tests > 0 OR pushes > 0) AS BIGINT) AS or_pushed,
       CAST(count(*) FILTER (tests > 0 OR pushes > 0 OR tf > 0) AS BIGINT) AS or_test_file,
       CAST(count(*) FILTER (tests > 0 OR pushes > 0 OR tf > 0 OR other > 0) AS BIGINT) AS or_same_day
FROM s JOIN k ON k.d = s.d AND k.repo = s.repo WHERE code > 0 GROUP BY 1""")
def _(t: Tables):
    per = t.lineitem.groupBy("l_orderkey").agg(
        A.count_if((F.col("l_returnflag") == "A") & (F.col("l_quantity") > 40)).alias("tests"),
        A.count_if((F.col("l_returnflag") == "R") & (F.col("l_quantity") > 45)).alias("pushes"),
        A.count_if(F.col("l_tax") > 0.07).alias("tf"), A.count_if(F.col("l_quantity") > 30).alias("code"))
    o = t.orders.join(t.customer, F.col("c_custkey") == F.col("o_custkey"))
    s = per.join(o, F.col("o_orderkey") == F.col("l_orderkey")).select(
        F.to_date("o_orderdate").alias("d"), F.col("c_nationkey").alias("repo"), "tests", "pushes", "tf", "code")
    return J.nested_coverage(s, "repo", "d", "tests", "pushes", "tf", "code")


@query("tool_outcomes", """
WITH r AS (SELECT l_orderkey AS k, bool_or(l_returnflag = 'R') AS errored FROM lineitem WHERE l_returnflag <> 'N' GROUP BY 1)
SELECT o_orderstatus, CASE WHEN errored IS NULL THEN 'unresolved' WHEN errored THEN 'error' ELSE 'ok' END AS outcome,
       CAST(count(*) AS BIGINT) AS n FROM orders LEFT JOIN r ON k = o_orderkey GROUP BY 1, 2""")
def _(t: Tables):
    results = t.lineitem.select(F.col("l_orderkey").alias("k"), F.when(F.col("l_returnflag") != "N", F.col("l_returnflag") == "R").alias("is_error"))
    calls = t.orders.select(F.col("o_orderkey").alias("k"), "o_orderstatus")
    j = J.call_outcomes(calls, results, ["k"], "is_error")
    outcome = F.when(F.col("errored").isNull(), "unresolved").when(F.col("errored"), "error").otherwise("ok")
    return j.groupBy("o_orderstatus", outcome.alias("outcome")).agg(F.count(F.lit(1)).alias("n"))


@query("delegated_sessions", """
SELECT c_nationkey, CAST(count(*) AS BIGINT) AS orchestratable,
       CAST(count(*) FILTER (EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderpriority = '1-URGENT')) AS BIGINT) AS delegated
FROM customer GROUP BY 1""")
def _(t: Tables):
    c = t.customer.select("c_custkey", "c_nationkey")
    d = t.orders.filter("o_orderpriority = '1-URGENT'").select(F.col("o_custkey").alias("c_custkey"))
    hit = c.join(d, "c_custkey", "left_semi").withColumn("d", F.lit(1)).select("c_custkey", "d")
    return c.join(hit, "c_custkey", "left").groupBy("c_nationkey").agg(
        F.count(F.lit(1)).alias("orchestratable"), F.count("d").alias("delegated"))


@query("set_change", """
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-06-01'),
     b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-06-01')
SELECT o_custkey, 'new' AS change FROM b WHERE o_custkey NOT IN (SELECT * FROM a)
UNION ALL SELECT o_custkey, 'closed' FROM a WHERE o_custkey NOT IN (SELECT * FROM b)""")
def _(t: Tables):
    o, d = t.orders, F.col("o_orderdate")
    cut = F.lit("1998-06-01").cast("timestamp")
    return J.set_change(o.filter(d < cut), o.filter(d >= cut), ["o_custkey"])


@query("nth_pairs", """
WITH a AS (SELECT o_custkey, o_orderkey AS x, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus <> 'F'),
     b AS (SELECT o_custkey, o_orderkey AS y, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderkey) AS n FROM orders WHERE o_orderstatus = 'F')
SELECT a.o_custkey, x, y FROM a LEFT JOIN b ON a.o_custkey = b.o_custkey AND a.n = b.n""")
def _(t: Tables):
    o = t.orders
    a = o.filter("o_orderstatus <> 'F'").select("o_custkey", F.col("o_orderkey").alias("x"))
    b = o.filter("o_orderstatus = 'F'").select("o_custkey", F.col("o_orderkey").alias("y"))
    chunk = 4096
    return S.nth_pairs(a, b, ["o_custkey"], ["x"], ["y"], F.floor(F.col("x") / chunk), F.floor(F.col("y") / chunk))


@query("colocated_tests", """
WITH p AS (SELECT p_partkey, 'src/' || lower(p_type) || '/' AS d, split_part(p_name, ' ', 1) || p_size AS s, p_size % 3 AS kind FROM part),
     t AS (SELECT DISTINCT d, s FROM p WHERE kind = 0)
SELECT lower(d) AS dir, CAST(count(*) AS BIGINT) AS files,
       CAST(count(*) FILTER (EXISTS (SELECT 1 FROM t WHERE t.d = p.d AND t.s = p.s)) AS BIGINT) AS covered
FROM p WHERE kind <> 0 GROUP BY 1""")
def _(t: Tables):
    p = t.part.withColumn("d", F.concat(F.lit("src/"), F.lower("p_type"), F.lit("/"))).withColumn(
        "s", F.concat(F.element_at(F.split("p_name", " "), 1), F.col("p_size").cast("string")))
    tests = p.filter("p_size % 3 = 0").select(F.concat("d", F.lit("__tests__/"), "s", F.lit(".test.ts")).alias("path"))
    code = p.filter("p_size % 3 <> 0").select("p_partkey", "d", F.concat("d", "s", F.lit(".ts")).alias("path"))
    c = J.colocated_tests(code, tests, [], "path")
    return c.groupBy(F.col("d").alias("dir")).agg(F.count(F.lit(1)).alias("files"), A.count_if(F.col("has_test")).alias("covered"))


@query("server_prefix_names", """
WITH s AS (SELECT DISTINCT lower(p_type) AS base FROM part UNION SELECT DISTINCT lower(p_type) || '-plus' FROM part),
     n AS (SELECT p_partkey, lower(p_type) || CASE WHEN p_size % 2 = 0 THEN '-plus' ELSE '' END || '_' || split_part(p_name, ' ', 1) || '-x' AS name FROM part),
     m AS (SELECT n.p_partkey, name, max_by(base, length(base)) AS server FROM n LEFT JOIN s
           ON starts_with(name, base || '-') OR starts_with(name, base || '_') GROUP BY 1, 2)
SELECT p_partkey, server, substr(name, length(server) + 2) AS tool FROM m""")
def _(t: Tables):
    p = t.part
    base = F.lower("p_type")
    servers = p.select(base.alias("base")).distinct()
    servers = servers.unionByName(servers.select(F.concat("base", F.lit("-plus")).alias("base")))
    names = p.select("p_partkey", F.concat(base, F.when(F.col("p_size") % 2 == 0, "-plus").otherwise(""), F.lit("_"),
                                           F.element_at(F.split("p_name", " "), 1), F.lit("-x")).alias("name"))
    m = J.longest_prefix(names, servers.withColumn("label", F.col("base")), [], "name", "base", "label")
    return m.select("p_partkey", "server", "tool")


@query("repo_churn", """
WITH n AS (SELECT l_suppkey % 40 AS repo, l_orderkey AS c, sum(CAST(l_quantity AS BIGINT)) AS i, sum(l_linenumber) AS x
           FROM lineitem WHERE l_linestatus = 'F' AND l_shipdate >= TIMESTAMP '1998-01-01' AND l_shipdate < TIMESTAMP '2000-01-01' GROUP BY 1, 2)
SELECT repo, CAST(sum(i) AS BIGINT) AS insertions, CAST(sum(x) AS BIGINT) AS deletions, CAST(count(*) AS BIGINT) AS commits FROM n
GROUP BY 1""")
def _(t: Tables):
    li = t.lineitem.select(
        F.array(F.concat(F.lit("sha"), (F.col("l_suppkey") % 40).cast("string"))).alias("repo_root_shas"), F.lit("").alias("remote"),
        F.concat(F.lit("/w/"), (F.col("l_suppkey") % 40).cast("string")).alias("top"),
        F.lit("me").alias("user_email"), F.lit("me").alias("author_email"), (F.col("l_linestatus") != "F").alias("is_merge"),
        F.col("l_orderkey").alias("commit_id"), F.col("l_shipdate").cast("timestamp").alias("commit_ts"),
        F.col("l_quantity").cast("bigint").alias("added"), F.col("l_linenumber").cast("bigint").alias("deleted"))
    r = J.repo_churn(li, [], "1998-01-01", "2000-01-01")
    return r.filter("commits > 0").select(F.col("repo").cast("bigint").alias("repo"), "insertions", "deletions", "commits")


@query("model_names", """
SELECT DISTINCT lower(p_brand) AS raw, 'Brand#' || substr(p_brand, 7) AS shown FROM part""")
def _(t: Tables):
    b = t.part.select(F.lower("p_brand").alias("raw")).distinct()
    return b.select("raw", models.pretty(F.col("raw")).alias("shown"))


@query("sat_rate_wsum", """
WITH c AS (SELECT o_custkey, count(*) AS calls, count(DISTINCT o_orderpriority) AS kinds, count(*) FILTER (o_orderstatus = 'P') AS hits,
                  sum(o_totalprice) AS spend FROM orders GROUP BY 1),
     v AS (SELECT o_custkey, least(1.0, kinds / 4.0) AS a,
                  CASE WHEN calls * 0.09 > 1.0 THEN least(1.0, (hits / calls) / 0.09) END AS b,
                  CASE WHEN spend > 2000000 THEN 1.0 ELSE 0.6 END AS d FROM c)
SELECT o_custkey, round((0.4 * a + CASE WHEN b IS NULL THEN 0 ELSE 0.3 * b END + 0.3 * d)
       / (0.7 + CASE WHEN b IS NULL THEN 0 ELSE 0.3 END), 6) AS score, CASE WHEN b IS NULL THEN 2 ELSE 3 END AS scored FROM v""")
def _(t: Tables):
    c = t.orders.groupBy("o_custkey").agg(
        F.count(F.lit(1)).alias("calls"), F.count_distinct("o_orderpriority").alias("kinds"),
        A.count_if(F.col("o_orderstatus") == "P").alias("hits"), F.sum("o_totalprice").alias("spend"))
    terms = [(.4, N.sat(F.col("kinds"), 4), None), (.3, N.rate(F.col("hits"), F.col("calls"), .09), None),
             (.3, F.when(F.col("spend") > 2000000, 1.0).otherwise(0.6), None)]
    return c.select("o_custkey", F.round(N.wsum(terms), 6).alias("score"),
                    F.coalesce(N.wsum_disclosure(terms)["scored"], F.lit(3)).alias("scored"))


@query("weighted_aggregate", """
SELECT l_suppkey, round(sum(l_quantity * l_discount) / sum(l_quantity), 6) AS score FROM lineitem GROUP BY 1""")
def _(t: Tables):
    return t.lineitem.groupBy("l_suppkey").agg(F.round(A.weighted_mean(F.col("l_quantity"), F.col("l_discount")), 6).alias("score"))


@query("saturation_arms", """
WITH c AS (SELECT o_custkey, count(*) AS orders, count(DISTINCT o_orderpriority) AS kinds, sum(o_totalprice) AS spend FROM orders GROUP BY 1),
     a AS (SELECT *, unnest([1.0, 0.66, 0.33]) AS arm FROM c),
     k AS (SELECT o_custkey, CAST(arm AS DOUBLE) AS arm, CASE WHEN orders > 8 * arm THEN 8.0 * arm ELSE orders END / 8.0 AS x,
        CASE WHEN kinds > 4 * arm THEN 4.0 * arm ELSE kinds END / 4.0 AS y, CASE WHEN spend > 2e6 * arm THEN 2e6 * arm ELSE spend END / 2e6 AS z,
        CAST(orders > 8 * arm AS INT) + CAST(kinds > 4 * arm AS INT) + CAST(spend > 2e6 * arm AS INT) AS cut FROM a)
SELECT o_custkey, arm, round(0.4 * least(1, x) + 0.4 * least(1, y) + 0.2 * least(1, z), 5) AS score, CAST(cut AS BIGINT) AS cut FROM k""")
def _(t: Tables):
    c = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("orders"), F.count_distinct("o_orderpriority").alias("kinds"),
                                          F.sum("o_totalprice").alias("spend"))
    arms = P.saturation_arms(c, ["o_custkey"], {
        "orders": ("orders", F.lit(8.0), .4), "kinds": ("kinds", F.lit(4.0), .4), "spend": ("spend", F.lit(2e6), .2)}, [1.0, .66, .33])
    return arms.withColumn("score", F.round("score", 5))


@query("term_recovery", """
WITH c AS (SELECT o_custkey, count(*) AS n, count(DISTINCT o_orderpriority) AS k, max(o_totalprice) > 400000 AS hit FROM orders GROUP BY 1)
SELECT o_custkey, CASE WHEN hit THEN 1.0 ELSE 0.6 END AS branch FROM c""")
def _(t: Tables):
    from loomtrace.plans import audit
    c = t.orders.groupBy("o_custkey").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("o_orderpriority").alias("k"),
                                          (F.max("o_totalprice") > 400000).alias("hit"))
    a, b = N.sat(F.col("k"), 40), N.sat(F.col("n"), 30)
    c = c.withColumn("norm", N.wsum([(.4, a, None), (.3, b, None), (.3, F.when(F.col("hit"), 1.0).otherwise(.6), None)]))
    return c.select("o_custkey", audit.hidden_branch(F.col("norm"), [(.4, a), (.3, b)], .3).alias("branch"))
