"""Join operators and the small measures built on them."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from loomtrace.operators import sequence as S
from loomtrace.operators.aggregates import count_if


def adjusted_doing(raw: Column, dispatches: Column) -> Column:
    """Doing count without planning dispatches, never emptied by the subtraction."""
    return F.when(raw - dispatches > 0, raw - dispatches).otherwise(raw)


def sticky_outcomes(results: DataFrame, keys: list[str], is_error: str) -> DataFrame:
    """One outcome per call: an error anywhere sticks, non-boolean results do not count."""
    return (results.filter(F.col(is_error).isNotNull())
            .groupBy(*keys).agg(F.bool_or(is_error).alias("errored")))


def call_outcomes(calls: DataFrame, results: DataFrame, keys: list[str], is_error: str) -> DataFrame:
    """Calls with their outcome; no result at all stays NULL (unresolved)."""
    return S.join_keys(calls, sticky_outcomes(results, keys, is_error), keys)


def recovery_classes(calls: DataFrame, session: list[str], tool: str, ok: str, order: list[str]) -> DataFrame:
    """What happened after each failed call: exactly one of four classes.

    "Is there a later row" is a comparison with the last position, so three maxima replace
    the reverse-frame windows and no session is sorted.
    """
    pos = F.struct(*order)
    per_tool = calls.groupBy(*session, tool).agg(
        F.max(pos).alias("__tool_last"), F.max(F.when(F.col(ok), pos)).alias("__ok_last"))
    per_session = per_tool.groupBy(*session).agg(F.max("__tool_last").alias("__last"))
    failed = calls.filter(~F.col(ok))
    j = S.join_keys(S.join_keys(failed, per_tool, session + [tool]), per_session, session)
    outcome = (F.when(F.col("__last") <= pos, "nothing_after")
               .when(F.col("__ok_last") > pos, "retried_ok")
               .when(F.col("__tool_last") > pos, "retried_failing").otherwise("other_only"))
    return j.withColumn("outcome", outcome).drop("__tool_last", "__ok_last", "__last")


def grounding_positions(calls: DataFrame, session: list[str], order: list[str], chunk: Column,
                        knowledge: Column, write: Column, name: Column) -> DataFrame:
    """Position of the first knowledge call of sessions that write after it."""
    numbered = S.row_numbers(calls, session, order, chunk, "__pos")
    g = numbered.groupBy(*session).agg(
        F.min(F.when(knowledge, F.col("__pos"))).alias("position"),
        F.max(F.when(write, F.col("__pos"))).alias("__w"),
        F.min_by(F.when(knowledge, name), F.when(knowledge, F.col("__pos"))).alias("first_tool"))
    return g.filter(F.col("__w") > F.col("position")).drop("__w")


def timeline_sample(rows: DataFrame, owner: list[str], order: list[str], chunk: Column, size: int = 60) -> DataFrame:
    """Every k-th row of an owner's timeline, k chosen so that `size` rows are kept."""
    n = rows.groupBy(*owner).agg(F.count(F.lit(1)).alias("__n"))
    r = S.join_keys(S.row_numbers(rows, owner, order, chunk, "__i"), n, owner)
    i, step = F.col("__i") - 1, F.greatest(F.lit(1), F.floor(F.col("__n") / size))
    return r.filter((i % step == 0) & (F.floor(i / step) < size)).drop("__i", "__n")


def active_span(events: DataFrame, owner: list[str], ts: str) -> DataFrame:
    """Distinct active dates and whole days spanned."""
    per_day = events.filter(F.col(ts).isNotNull()).groupBy(*owner, F.to_date(ts).alias("__d")).agg(
        F.min(F.unix_micros(F.col(ts).cast("timestamp"))).alias("lo"),
        F.max(F.unix_micros(F.col(ts).cast("timestamp"))).alias("hi"))
    day_us = 86_400 * S.US
    return per_day.groupBy(*owner).agg(
        F.count(F.lit(1)).alias("active_days"),
        (F.floor((F.max("hi") - F.min("lo")) / F.lit(day_us)) + 1).cast("bigint").alias("span_days"))


def autonomy_parts(calls: Column, instructions: Column, prompts: Column, delegate: Column, sessions: Column,
                   scheduled: Column, questions: Column) -> list[Column]:
    s = F.greatest(sessions, F.lit(1)).cast("double")
    app = F.when(instructions > 0, calls / instructions.cast("double")).otherwise(0.0)
    one = F.lit(1.0)
    return [F.least(app / 25.0, one) * 45, F.least(delegate / s / 1.5, one) * 20, F.least(scheduled / s, one) * 15,
            (one - F.least(questions * 6.0 / F.greatest(prompts, F.lit(1)), one)) * 20]


def autonomy(*args: Column) -> Column:
    return reduce(lambda a, b: a + b, autonomy_parts(*args))


def longest_prefix(names: DataFrame, servers: DataFrame, keys: list[str], name: str, prefix: str, label: str) -> DataFrame:
    """Longest-prefix match as an equi-join.

    A prefix ends at '-' or '_', so a name has as many prefixes as separators; exploding
    them turns the prefix test into a hash join that needs no broadcast of the server list.
    """
    uniq = names.select(*keys, name).distinct()
    cuts = F.expr(f"filter(sequence(1, greatest(length(`{name}`), 1)), i -> substr(`{name}`, i, 1) in ('-', '_'))")
    heads = uniq.withColumn("__cut", F.explode(cuts)).withColumn(
        "__p", F.substring(F.col(name), F.lit(1), F.col("__cut")))
    table = servers.select(*keys, F.explode(F.array(F.concat(prefix, F.lit("-")), F.concat(prefix, F.lit("_")))).alias("__p"),
                           F.col(label).alias("__label")).groupBy(*keys, "__p").agg(F.min("__label").alias("__label"))
    best = (heads.join(table, keys + ["__p"]).groupBy(*keys, name)
            .agg(F.max(F.struct(F.length("__p").alias("l"), F.col("__label").alias("s"), F.col("__p").alias("p"))).alias("__b"))
            .select(*keys, name, F.col("__b.s").alias("server"), F.expr(f"substr(`{name}`, __b.l + 1)").alias("tool")))
    return names.join(best, keys + [name], "left")


def colocated_tests(code: DataFrame, tests: DataFrame, keys: list[str], path: str) -> DataFrame:
    """Code files with a test of the same stem in the same directory or one below.

    A test file is reachable from its own directory and from its parent, so it emits those
    two (stem, directory) keys and the directory predicate becomes a semi-join.
    """
    def parent(c: Column) -> Column:
        return F.when(c.contains("/"), F.regexp_replace(c, "/[^/]*$", "")).otherwise(F.lit(""))
    d = parent(F.col(path))
    t = tests.select(*keys, stem(F.col(path)).alias("__s"), F.explode(F.array(d, parent(d))).alias("__d")).distinct()
    anywhere = t.select(*keys, F.col("__s").alias("__any")).distinct()
    c = code.withColumn("__s", stem(F.col(path))).withColumn("__d", d)
    hit = c.join(t.withColumn("has_test", F.lit(True)), keys + ["__s", "__d"], "left")
    hit = hit.join(anywhere.withColumn("elsewhere", F.lit(True)).withColumnRenamed("__any", "__s"), keys + ["__s"], "left")
    has = F.coalesce("has_test", F.lit(False))
    return hit.withColumn("elsewhere", F.coalesce("elsewhere", F.lit(False)) & ~has).withColumn("has_test", has).drop("__s", "__d")


def stem(path: Column) -> Column:
    """File stem without extension and test/spec markers."""
    base = F.element_at(F.split(path, "/"), -1)
    base = F.when(base.contains("."), F.regexp_replace(base, r"\.[^.]*$", "")).otherwise(base)
    marker = r"(?i)^(?:test_)+|(?:[._-](?:test|spec))+$|^(?:test|spec)$"
    for _ in range(2):
        base = F.regexp_replace(F.regexp_replace(base, marker, ""), r"^[._-]+|[._-]+$", "")
    return base


def set_change(before: DataFrame, after: DataFrame, keys: list[str]) -> DataFrame:
    """Keys that are new or closed between two runs (anti-joins in both directions)."""
    new = after.select(*keys).distinct().join(before.select(*keys), keys, "left_anti").withColumn("change", F.lit("new"))
    gone = before.select(*keys).distinct().join(after.select(*keys), keys, "left_anti").withColumn("change", F.lit("closed"))
    return new.unionByName(gone)


def nested_coverage(sessions: DataFrame, repo: str, day: str, tests: str, pushes: str, testfiles: str, code: str) -> DataFrame:
    """Sessions that changed code, with four widening numerators per repository."""
    same_day = sessions.groupBy(day, repo).agg(F.sum(F.col(tests) + F.col(pushes)).alias("__other"))
    s = sessions.filter(F.col(code) > 0).join(same_day, [day, repo], "left")
    n1 = F.col(tests) > 0
    n2 = n1 | (F.col(pushes) > 0)
    n3 = n2 | (F.col(testfiles) > 0)
    n4 = n3 | (F.coalesce(F.col("__other"), F.lit(0)) > 0)
    return s.groupBy(repo).agg(F.count(F.lit(1)).alias("sessions"), count_if(n1).alias("ran_tests"),
                               count_if(n2).alias("or_pushed"), count_if(n3).alias("or_test_file"),
                               count_if(n4).alias("or_same_day"))


def repo_churn(numstat: DataFrame, tenant: list[str], since: str | None = None, until: str | None = None) -> DataFrame:
    """Insertions, deletions and commits per repository identity.

    Clones share root commits: identity is the sorted root list, else the remote, else the
    path; only one clone (the first path) counts.  Merges and other authors are left out.
    """
    roots = F.concat(F.lit("root:"), F.array_join(F.array_sort("repo_root_shas"), ","))
    ident = (F.when(F.size("repo_root_shas") > 0, roots)
             .when(F.coalesce("remote", F.lit("")) != "", F.concat(F.lit("remote:"), "remote"))
             .otherwise(F.concat(F.lit("path:"), "top")))
    d = numstat.withColumn("ident", ident)
    chosen = d.groupBy(*tenant, "ident").agg(F.min("top").alias("top"))
    rows = d.join(chosen, tenant + ["ident", "top"])
    mine = ~F.col("is_merge") & ((F.coalesce("user_email", F.lit("")) == "") | (F.col("author_email") == F.col("user_email")))
    if since:
        mine = mine & (F.col("commit_ts") >= F.lit(since).cast("timestamp"))
    if until:
        mine = mine & (F.col("commit_ts") < F.lit(until).cast("timestamp"))
    # one row per commit first, so the distinct commit count is a plain sum
    per = rows.filter(mine).groupBy(*tenant, "ident", "top", "commit_id").agg(
        F.coalesce(F.sum("added"), F.lit(0)).alias("i"), F.coalesce(F.sum("deleted"), F.lit(0)).alias("x"))
    repo = per.groupBy(*tenant, "ident", "top").agg(
        F.sum("i").alias("insertions"), F.sum("x").alias("deletions"), F.count(F.lit(1)).alias("commits"))
    return S.join_keys(chosen, repo.drop("top"), tenant + ["ident"]).select(
        *tenant, "ident", F.element_at(F.split("top", "/"), -1).alias("repo"),
        *[F.coalesce(c, F.lit(0)).cast("bigint").alias(c) for c in ("insertions", "deletions", "commits")])


def top_repos(repos: DataFrame, tenant: list[str], top: int = 12) -> DataFrame:
    """The report's list: per tenant the repositories with most changed lines. Totals come from all of them."""
    order = Window.partitionBy(*tenant).orderBy(F.desc(F.col("insertions") + F.col("deletions")), F.desc("commits"), "repo", "ident")
    changed = repos.filter((F.col("insertions") > 0) | (F.col("deletions") > 0) | (F.col("commits") > 0))
    return changed.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def churn_totals(repos: DataFrame, tenant: list[str]) -> DataFrame:
    return repos.groupBy(*tenant).agg(
        F.count(F.lit(1)).alias("repos_seen"),
        count_if((F.col("insertions") + F.col("deletions") + F.col("commits")) > 0).alias("repos_with_commits"),
        F.sum("insertions").cast("bigint").alias("insertions"), F.sum("deletions").cast("bigint").alias("deletions"),
        F.sum(F.col("insertions") + F.col("deletions")).cast("bigint").alias("churn"),
        F.sum("commits").cast("bigint").alias("commits"))
