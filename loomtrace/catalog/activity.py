"""Event-stream queries: windows, recovery, grounding, active time, rhythm."""
from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace.catalog.registry import Tables, query
from loomtrace.operators import aggregates as A, intervals as I, joins as J, sequence as S


def day():
    return F.to_date("ts")


def key():
    return F.get_json_object("props", "$.k").cast("bigint")


def hour_chunk():
    return F.date_trunc("hour", F.col("ts"))


MONTH_SQL = "strftime(ts, '%Y-%m')"


@query("event_window", """
SELECT event_id, user_id, event_type FROM events
WHERE ts >= TIMESTAMP '2024-01-05 00:00:00' AND ts < TIMESTAMP '2024-01-20 00:00:00'""")
def _(t: Tables):
    lo, hi = F.lit("2024-01-05 00:00:00").cast("timestamp"), F.lit("2024-01-20 00:00:00").cast("timestamp")
    ev = t.events
    return ev.filter((F.col("ts") >= lo) & (F.col("ts") < hi)).select("event_id", "user_id", "event_type")


@query("tool_entropy", """
WITH c AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY 1, 2),
     t AS (SELECT user_id, sum(n) AS total, count(*) AS names FROM c GROUP BY 1)
SELECT c.user_id, CAST(any_value(t.names) AS BIGINT) AS names, CAST(any_value(t.total) AS BIGINT) AS total,
       round(CASE WHEN any_value(t.names) > 1
             THEN -sum((n / t.total) * (ln(n / t.total) / ln(2.0))) / (ln(any_value(t.names)) / ln(2.0))
             ELSE 0.0 END, 6) AS entropy
FROM c JOIN t USING (user_id) GROUP BY c.user_id""")
def _(t: Tables):
    e = A.entropy(t.events, ["user_id"], "event_type")
    return e.select("user_id", "names", "total", F.round("entropy", 6).alias("entropy"))


@query("explore_doing_ratio", """
WITH c AS (SELECT user_id, count(*) FILTER (event_type IN ('view', 'click')) AS explore,
                  count(*) FILTER (event_type IN ('purchase', 'signup')) AS doing,
                  count(*) FILTER (event_type = 'signup' AND value > 40) AS dispatch
           FROM events GROUP BY 1)
SELECT user_id, explore, CASE WHEN doing - dispatch > 0 THEN doing - dispatch ELSE doing END AS doing,
       round(CASE WHEN doing = 0 THEN 0.0
             ELSE explore / (CASE WHEN doing - dispatch > 0 THEN doing - dispatch ELSE doing END) END, 6) AS ratio
FROM c""")
def _(t: Tables):
    et = F.col("event_type")
    c = t.events.groupBy("user_id").agg(
        A.count_if(et.isin("view", "click")).alias("explore"),
        A.count_if(et.isin("purchase", "signup")).alias("raw"),
        A.count_if((et == "signup") & (F.col("value") > 40)).alias("dispatch"))
    doing = J.adjusted_doing(F.col("raw"), F.col("dispatch"))
    return c.select("user_id", "explore", doing.alias("doing"),
                    F.round(F.when(F.col("raw") == 0, 0.0).otherwise(F.col("explore") / doing), 6).alias("ratio"))


@query("category_counts_grouping_sets", f"""
SELECT user_id, event_type, month, CAST(count(*) AS BIGINT) AS n, round(sum(value), 2) AS total,
       CAST(grouping(event_type) AS INTEGER) AS all_sources, CAST(grouping(month) AS INTEGER) AS all_months
FROM (SELECT *, {MONTH_SQL} AS month FROM events)
GROUP BY GROUPING SETS ((user_id), (user_id, event_type), (user_id, month), (user_id, event_type, month))""")
def _(t: Tables):
    ev = t.events.withColumn("month", F.date_format("ts", "yyyy-MM"))
    g = A.grouping_counts(ev, "user_id", "event_type", "month",
                          {"n": F.count(F.lit(1)), "total": F.sum("value")})
    return g.withColumn("total", F.round("total", 2))


_GAPS = """
WITH g AS (SELECT user_id, ts, lead(ts) OVER (PARTITION BY user_id ORDER BY ts) AS nxt FROM events),
     d AS (SELECT user_id, epoch_us(ts) AS s,
                  CASE WHEN nxt IS NOT NULL THEN epoch_us(ts) + least(epoch_us(nxt) - epoch_us(ts), 600000000) END AS e FROM g)"""


@query("capped_gap_durations", _GAPS + """
SELECT user_id, round(coalesce(sum(e - s), 0) / 1000000.0, 3) AS active_s FROM d GROUP BY 1""")
def _(t: Tables):
    d = S.capped_duration(t.events, ["user_id"], "ts", 600)
    return d.select("user_id", F.round("active_s", 3).alias("active_s"))


@query("active_time_union", _GAPS + """,
     o AS (SELECT user_id % 7 AS owner, s, e FROM d WHERE e IS NOT NULL),
     m AS (SELECT owner, s, e, max(e) OVER (PARTITION BY owner ORDER BY s, e
                 ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS upto FROM o)
SELECT owner, round(sum(greatest(e - greatest(s, coalesce(upto, s)), 0)) / 1000000.0, 3) AS active_s
FROM m GROUP BY 1""")
def _(t: Tables):
    ev = t.events.withColumn("owner", F.col("user_id") % 7)
    return S.active_union(ev, ["owner"], ["user_id"], "ts", 600).select(
        "owner", F.round("active_s", 3).alias("active_s"))


@query("longest_burst", """
WITH g AS (SELECT user_id, epoch_us(ts) AS u, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS p FROM events),
     r AS (SELECT user_id, u, sum(CASE WHEN u - p > 1800000000 THEN 1 ELSE 0 END)
                  OVER (PARTITION BY user_id ORDER BY u) AS run FROM g),
     b AS (SELECT user_id, run, max(u) - min(u) AS len FROM r GROUP BY 1, 2)
SELECT user_id % 7 AS owner, round(max(len) / 1000000.0, 3) AS longest_s FROM b GROUP BY 1""")
def _(t: Tables):
    ev = t.events.withColumn("owner", F.col("user_id") % 7)
    return S.longest_burst(ev, ["owner"], ["user_id"], "ts").select(
        "owner", F.round("longest_s", 3).alias("longest_s"))


@query("error_recovery", """
WITH p AS (SELECT user_id, event_type, lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev FROM events)
SELECT user_id, CAST(count(*) FILTER (event_type = 'error') AS BIGINT) AS errors,
       CAST(count(*) FILTER (event_type <> 'error' AND prev = 'error') AS BIGINT) AS recovered
FROM p GROUP BY 1""")
def _(t: Tables):
    ev = t.events
    is_error = F.col("event_type") == "error"
    hits = S.fires_after(ev.select("user_id", "event_type", "ts", "event_id"), ["user_id"], ["ts", "event_id"],
                         hour_chunk(), is_error, ~is_error)
    marks = (ev.select("user_id", is_error.cast("int").alias("e"), F.lit(0).alias("r"))
             .unionByName(hits.select("user_id", F.lit(0).alias("e"), F.lit(1).alias("r"))))
    return marks.groupBy("user_id").agg(F.sum("e").cast("bigint").alias("errors"),
                                        F.sum("r").cast("bigint").alias("recovered"))


@query("grounded_writes", f"""
WITH s AS (SELECT user_id, {MONTH_SQL} AS month, event_type,
                  lag(event_type) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS prev
           FROM events WHERE event_type IN ('view', 'purchase'))
SELECT month, CAST(count(DISTINCT user_id) FILTER (event_type = 'purchase') AS BIGINT) AS write_sessions,
       CAST(count(DISTINCT user_id) FILTER (event_type = 'purchase' AND prev = 'view') AS BIGINT) AS grounded_sessions,
       CAST(count(*) FILTER (event_type = 'purchase' AND prev = 'view') AS BIGINT) AS consumed
FROM s GROUP BY 1""")
def _(t: Tables):
    ev = t.events.select("user_id", "event_type", "ts", "event_id", F.date_format("ts", "yyyy-MM").alias("month"))
    et = F.col("event_type")
    hits = S.fires_after(ev, ["user_id"], ["ts", "event_id"], hour_chunk(), et == "view", et == "purchase")
    per = (ev.filter(et.isin("purchase", "view")).select("month", "user_id", (et == "purchase").cast("int").alias("w"), F.lit(0).alias("g"))
           .unionByName(hits.select("month", "user_id", F.lit(0).alias("w"), F.lit(1).alias("g")))
           .groupBy("month", "user_id").agg(F.max("w").alias("w"), F.sum("g").alias("g")))
    return per.groupBy("month").agg(
        F.sum("w").cast("bigint").alias("write_sessions"), A.count_if(F.col("g") > 0).alias("grounded_sessions"),
        F.sum("g").cast("bigint").alias("consumed"))


@query("strict_recovery_classes", """
WITH e AS (SELECT user_id, ts, event_id, CAST(json_extract(props, '$.k') AS BIGINT) % 5 AS tool,
                  event_type <> 'error' AS ok FROM events),
     f AS (SELECT user_id, ok,
       count(*) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS later,
       count(*) OVER (PARTITION BY user_id, tool ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS same_later,
       count(*) FILTER (ok) OVER (PARTITION BY user_id, tool ORDER BY ts, event_id ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING) AS ok_later
       FROM e)
SELECT CASE WHEN later = 0 THEN 'nothing_after' WHEN ok_later > 0 THEN 'retried_ok'
            WHEN same_later > 0 THEN 'retried_failing' ELSE 'other_only' END AS outcome,
       CAST(count(*) AS BIGINT) AS n
FROM f WHERE NOT ok GROUP BY 1""")
def _(t: Tables):
    e = t.events.select("user_id", "ts", "event_id", (key() % 5).alias("tool"),
                        (F.col("event_type") != "error").alias("ok"))
    c = J.recovery_classes(e, ["user_id"], "tool", "ok", ["ts", "event_id"])
    return c.groupBy("outcome").agg(F.count(F.lit(1)).alias("n"))


@query("edit_run_depth", """
WITH e AS (SELECT user_id, ts, event_id, event_type, CAST(json_extract(props, '$.k') AS BIGINT) % 6 AS path,
       sum(CASE WHEN event_type = 'purchase' THEN 1 ELSE 0 END) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS epoch
       FROM events),
     r AS (SELECT user_id, epoch, path, count(*) AS depth FROM e WHERE event_type <> 'purchase' GROUP BY 1, 2, 3)
SELECT depth, CAST(count(*) AS BIGINT) AS runs FROM r GROUP BY 1""")
def _(t: Tables):
    e = t.events.select("user_id", "ts", "event_id", "event_type", (key() % 6).alias("path"))
    runs = S.edit_runs(e, ["user_id"], ["ts", "event_id"], hour_chunk(), F.col("event_type") == "purchase", "path")
    return runs.groupBy("depth").agg(F.count(F.lit(1)).alias("runs"))


@query("peak_hours", """
WITH c AS (SELECT user_id, hour(ts) AS bucket, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rank FROM c)
SELECT user_id, CAST(bucket AS INTEGER) AS bucket, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def _(t: Tables):
    return A.busiest(t.events, ["user_id"], F.hour("ts"), F.col("event_id"))


@query("preferred_days", """
WITH c AS (SELECT user_id, isodow(ts) - 1 AS bucket, count(*) AS n, min(event_id) AS f FROM events GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY n DESC, f) AS rank FROM c)
SELECT user_id, CAST(bucket AS INTEGER) AS bucket, n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 3""")
def _(t: Tables):
    return A.busiest(t.events, ["user_id"], A.weekday(F.col("ts")), F.col("event_id"))


@query("carry_forward", """
SELECT event_id, user_id, round(last_value(CASE WHEN event_type = 'purchase' THEN value END IGNORE NULLS)
  OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW), 2) AS carried
FROM events""")
def _(t: Tables):
    e = t.events.select("event_id", "user_id", "ts", F.when(F.col("event_type") == "purchase", F.col("value")).alias("p"))
    c = S.carry_forward(e, ["user_id"], ["ts", "event_id"], hour_chunk(), "p", "carried")
    return c.select("event_id", "user_id", F.round("carried", 2).alias("carried"))


@query("opening_events", """
SELECT user_id, min_by(event_type, (ts, event_id)) AS first_type, min(event_id) AS first_id FROM events GROUP BY 1""")
def _(t: Tables):
    return t.events.groupBy("user_id").agg(
        F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.min("event_id").alias("first_id"))


@query("timeline_sample", """
WITH o AS (SELECT user_id, CAST(ts AS DATE) AS d, min_by(event_id, (ts, event_id)) AS event_id,
                  min(ts) AS ts FROM events GROUP BY user_id, CAST(ts AS DATE)),
     r AS (SELECT user_id % 4 AS owner, event_id,
                  row_number() OVER (PARTITION BY user_id % 4 ORDER BY ts, event_id) - 1 AS i,
                  count(*) OVER (PARTITION BY user_id % 4) AS n FROM o)
SELECT owner, event_id FROM r WHERE i % greatest(1, n // 60) = 0 AND i // greatest(1, n // 60) < 60""")
def _(t: Tables):
    first = (t.events.groupBy("user_id", day().alias("d"))
             .agg(F.min_by("event_id", F.struct("ts", "event_id")).alias("event_id"), F.min("ts").alias("ts"))
             .select((F.col("user_id") % 4).alias("owner"), "event_id", "ts"))
    return J.timeline_sample(first, ["owner"], ["ts", "event_id"], F.to_date("ts")).select("owner", "event_id")


@query("grounding_position", """
WITH c AS (SELECT user_id, event_type, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS pos FROM events),
     k AS (SELECT user_id, min(pos) FILTER (event_type = 'view') AS first_k,
                  max(pos) FILTER (event_type = 'purchase') AS last_w FROM c GROUP BY 1)
SELECT CAST(least(first_k, 11) AS BIGINT) AS position, CAST(count(*) AS BIGINT) AS sessions
FROM k WHERE last_w > first_k GROUP BY 1""")
def _(t: Tables):
    e = t.events.select("user_id", "ts", "event_id", "event_type")
    et = F.col("event_type")
    g = J.grounding_positions(e, ["user_id"], ["ts", "event_id"], hour_chunk(), et == "view", et == "purchase", et)
    return g.groupBy(F.least("position", F.lit(11)).cast("bigint").alias("position")).agg(
        F.count(F.lit(1)).alias("sessions"))


@query("parallel_turns", """
WITH e AS (SELECT user_id, date_trunc('hour', ts) AS turn, count(*) FILTER (event_type = 'signup') AS n FROM events GROUP BY 1, 2)
SELECT user_id, CAST(count(*) FILTER (n >= 2) AS BIGINT) AS parallel_turns FROM e GROUP BY 1""")
def _(t: Tables):
    per = t.events.groupBy("user_id", hour_chunk().alias("turn")).agg(A.count_if(F.col("event_type") == "signup").alias("n"))
    return per.groupBy("user_id").agg(A.count_if(F.col("n") >= 2).alias("parallel_turns"))


@query("active_span", """
SELECT user_id, CAST(count(DISTINCT CAST(ts AS DATE)) AS BIGINT) AS active_days,
       CAST(floor((epoch_us(max(ts)) - epoch_us(min(ts))) / 86400000000.0) + 1 AS BIGINT) AS span_days
FROM events GROUP BY 1""")
def _(t: Tables):
    return J.active_span(t.events, ["user_id"], "ts")


@query("project_activity", """
WITH c AS (SELECT user_id % 5 AS owner, CAST(json_extract(props, '$.k') AS BIGINT) AS project,
                  count(*) AS n, count(DISTINCT user_id) AS sessions, min(event_id) AS f FROM events GROUP BY 1, 2),
     r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY n DESC, f) AS rank FROM c)
SELECT owner, project, n, CAST(sessions AS BIGINT) AS sessions, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 12""")
def _(t: Tables):
    e = t.events.select((F.col("user_id") % 5).alias("owner"), key().alias("project"), "user_id", "event_id")
    per = e.groupBy("owner", "project", "user_id").agg(F.count(F.lit(1)).alias("c"), F.min("event_id").alias("f"))
    agg = per.groupBy("owner", "project").agg(F.sum("c").alias("n"), F.count(F.lit(1)).alias("sessions"), F.min("f").alias("f"))
    return A.rank_counts(agg, ["owner"], 12, "n", ["f"]).drop("f")


@query("autonomy_components", """
WITH a AS (SELECT user_id, count(*) FILTER (event_type IN ('click', 'view', 'purchase')) AS calls,
       count(*) FILTER (event_type = 'error') AS prompts, count(*) FILTER (event_type = 'signup') AS delegate,
       count(DISTINCT CAST(ts AS DATE)) AS sessions, count(*) FILTER (value > 120) AS sched,
       count(*) FILTER (value < 1) AS questions FROM events GROUP BY 1)
SELECT user_id, round(45 * least(CASE WHEN prompts > 0 THEN calls / prompts ELSE 0 END / 25.0, 1)
     + 20 * least(delegate / greatest(sessions, 1) / 1.5, 1) + 15 * least(sched / greatest(sessions, 1), 1)
     + 20 * (1 - least(6.0 * questions / greatest(prompts, 1), 1)), 4) AS autonomy FROM a""")
def _(t: Tables):
    et = F.col("event_type")
    a = t.events.groupBy("user_id", day().alias("d")).agg(
        A.count_if(et.isin("click", "view", "purchase")).alias("calls"), A.count_if(et == "error").alias("prompts"),
        A.count_if(et == "signup").alias("delegate"), A.count_if(F.col("value") > 120).alias("sched"),
        A.count_if(F.col("value") < 1).alias("questions"))
    a = a.groupBy("user_id").agg(*[F.sum(c).alias(c) for c in ("calls", "prompts", "delegate", "sched", "questions")],
                                 F.count(F.lit(1)).alias("sessions"))
    score = J.autonomy(F.col("calls"), F.col("prompts"), F.col("prompts"), F.col("delegate"), F.col("sessions"),
                       F.col("sched"), F.col("questions"))
    return a.select("user_id", F.round(score, 4).alias("autonomy"))


@query("window_overlap", """
WITH s AS (SELECT user_id % 7 AS owner, CASE WHEN event_type <> 'view' THEN min(ts) END AS first, CASE WHEN event_type <> 'signup' THEN max(ts) END AS last
           FROM events GROUP BY user_id, event_type, epoch_us(ts) // 259200000000),
     w AS (SELECT DISTINCT user_id % 7 AS owner, 'month' AS kind, date_trunc('month', ts) AS since, CAST(date_trunc('month', ts) + INTERVAL 1 MONTH AS TIMESTAMP) AS until FROM events
           UNION SELECT DISTINCT user_id % 7, 'week', date_trunc('week', ts), CAST(date_trunc('week', ts) + INTERVAL 7 DAY AS TIMESTAMP) FROM events
           UNION SELECT DISTINCT user_id % 7, 'from', date_trunc('month', ts), CAST(NULL AS TIMESTAMP) FROM events)
SELECT w.owner, w.kind, epoch_us(w.since) AS since, count(s.owner) AS spans, epoch_us(min(s.first)) AS first, epoch_us(max(s.last)) AS last
FROM w LEFT JOIN s ON s.owner = w.owner AND coalesce(s.first < w.until, true) AND coalesce(s.last >= w.since, true) GROUP BY ALL""")
def _(t: Tables):
    """Spells of three days per user and kind of event, some without a start or an end, against all weeks and months."""
    ev = t.events.withColumn("owner", F.col("user_id") % 7).withColumn("ts", F.col("ts").cast("timestamp"))
    s = ev.groupBy("owner", "user_id", "event_type", F.expr("unix_micros(ts) div 259200000000").alias("spell")).agg(F.min("ts").alias("a"), F.max("ts").alias("b"))
    s = s.select("owner", F.when(F.col("event_type") != "view", F.col("a")).alias("first"), F.when(F.col("event_type") != "signup", F.col("b")).alias("last"))
    month, week = F.date_trunc("month", "ts"), F.date_trunc("week", "ts")
    days = ev.select("owner", F.date_trunc("day", "ts").alias("ts")).distinct()
    w = days.select("owner", F.explode(F.array(*[F.struct(F.lit(k).alias("kind"), a.alias("since"), b.cast("timestamp").alias("until")) for k, a, b in (
        ("month", month, month + F.expr("INTERVAL 1 MONTH")), ("week", week, week + F.expr("INTERVAL 7 DAYS")), ("from", month, F.lit(None)))])).alias("w")).select("owner", "w.*").distinct()
    out = I.overlaps(s, w, ["owner"], ["kind", "since"])
    return out.select("owner", "kind", F.unix_micros("since").alias("since"), "spans", F.unix_micros("first").alias("first"), F.unix_micros("last").alias("last"))
