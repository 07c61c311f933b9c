"""Truth tables of the column expressions."""
import pytest
from pyspark.sql import functions as F

from loomtrace.functions import models, numbers as N, paths as P, quotes as Q, text as X, tools as T


def values(spark, fn, *rows):
    df = spark.createDataFrame([(i, r) for i, r in enumerate(rows)], "i int, c string")
    return [r.x for r in df.select("i", fn(F.col("c")).alias("x")).orderBy("i").collect()]


def test_classify(spark):
    names = ["Edit", "TodoWrite", "Read", "ToolSearch", "PowerShell", "Agent", "Skill", "CronList", "AskUserQuestion", "mcp__x__list_y", "mcp__x__send", "zzz"]
    assert values(spark, T.classify, *names) == ["produce", "plan", "explore", "explore", "execute", "delegate", "execute", "execute", "ask", "explore", "produce", "other"]


def test_substantive(spark):
    assert values(spark, T.is_substantive, "Read", "TodoWrite", "BashOutput", "mcp__a__get_status", "mcp__a__poll", "mcp__a__send", "zzz") == [True, False, False, False, False, True, False]


def test_canonical_names_and_servers(spark):
    assert values(spark, T.canonical, "bash", "functions.read_file", "x.spawn_agent", "Custom", "") == ["Bash", "Read", "Agent", "Custom", "tool"]
    assert values(spark, T.mcp_server, "mcp__github__get", "mcp__plugin__atl_atl_get", "mcp__plugin__jira_get", "mcp__plugin__get_x", "mcp__", "Read") == ["github", "atl", "jira", "plugin", None, None]


def test_change_targets(spark):
    rows = ["src/a.py", "src/a.test.ts", "tests/x.py", "package-lock.json", "README", "docs/x.md", "a/Dockerfile", "c.yaml", "/tmp/scratchpad/a.py", "/tmp/repo/a.py", "C:\\r\\a.go", "x.bin", ""]
    assert values(spark, P.change_target, *rows) == ["code", "test", "test", "lockfile", "doc", "doc", "config", "config", "other", "code", "code", "other", "other"]


def test_plan_files_and_compounding(spark):
    assert values(spark, P.is_plan_file, "docs/plans/1.md", ".cursor/plans/x", ".context/my-plan-2", "plans/a/b.md") == [True, True, True, False]
    assert values(spark, P.is_compounding, "a/CLAUDE.md", "x/memory/y", "src/a.py", "") == [True, True, False, False]


def test_normalize(spark):
    assert values(spark, P.normalize, "/a/./b/../c//d/", "a/..", "../x", "/..", "//n/x", "") == ["/a/c/d", ".", "../x", "/", "//n/x", ""]


@pytest.mark.parametrize("cmd,want", [("pytest -q", True), ("./venv/bin/pytest", True), ("npm run test:unit", True), ("gradlew :app:testDebugUnitTest", True), ("gradlew testClasses", False), ("gradle check", True),
                                      ("cat ava.json", False), ("rm -rf pytest_cache", False), ("go test ./...", True), ("echo latest", False)])
def test_test_commands(spark, cmd, want):
    assert values(spark, X.runs_tests, cmd) == [want]


def test_shell_writes_and_heads(spark):
    assert values(spark, X.writes_file, "echo a > f", "ls 2>/dev/null", "ls > /dev/null", "x 2>&1", "cat <<EOF", "cat <<< x", "sed -i s/a/b/", "a | tee f", "a | tee >(b)") == [True, False, False, False, True, True, True, True, True]
    assert values(spark, X.cli_heads, "A=1 git st && /usr/bin/npm i | grep x; then rm y; foo", "") == [["git", "npm", "grep", "rm"], []]
    assert values(spark, X.argv_command, '["a","b c"]', "ls", None) == ["a && b c", "ls", ""]


def test_prompt_cleaning(spark):
    assert values(spark, X.strip_injections, " a <system-reminder>x\ny</system-reminder>b ", "<command-name>/x</command-name>") == ["a b", ""]
    assert values(spark, X.line_count, "", "a", "a\n", "a\nb") == [0, 1, 1, 2]
    assert values(spark, X.is_polite, "Please fix", "unpleased", "well done!") == [True, False, True]


def test_review_skills(spark):
    rows = ["code-review", "x:verify-frontend", "email-verify-flow", "plan-eng-review", "ceo-review", "a/security-review", "review-risk", "judgment-day", "sdd-verify"]
    assert values(spark, T.is_review_skill, *rows) == [True, True, False, False, False, True, True, True, True]


def test_pretty_models(spark):
    rows = ["claude-opus-4-7", "claude-3-5-sonnet-20241022", "gpt-5.4", "gpt-5-codex", "gemini-2.5-pro", "default", "composer-1", ""]
    assert values(spark, models.pretty, *rows) == ["Opus 4.7", "Sonnet 3.5", "GPT 5.4", "GPT 5 Codex", "Gemini 2.5 Pro", "Cursor Auto", "Cursor Composer 1", "?"]


def test_quotes(spark):
    assert values(spark, Q.safe_quote, "fix it", "mail me a@b.co", "sk-" + "a" * 20, "x" * 33, "U0123ABCD", "call 123456", "[Image #1]") == [True] + [False] * 6
    assert values(spark, Q.typo_score, "teh loool b4 strng ok fine") == [5]
    assert round(values(spark, lambda c: Q.heat_score(c, F.lit(3)), "NO STOP!!")[0], 6) == 9.8
    assert round(values(spark, Q.cryptic_score, "im worried im unemploybale :(")[0], 6) == 6.25


def test_counts_from_json_text(spark):
    assert values(spark, N.count_value, "3", "3.0", "3.5", "-1", "true", "1e2", "nan") == [3, 3, None, None, None, 100, None]


def test_weighted_means_drop_and_renormalise(spark):
    df = spark.createDataFrame([(1.0, None, 10), (0.5, 0.2, 10), (None, None, 10)], "a double, b double, calls int")
    terms = [(.4, F.col("a"), None), (.6, F.col("b"), None)]
    rows = df.select(N.wsum(terms).alias("w"), N.wsum_disclosure(terms).alias("d")).collect()
    assert rows[0].w == 1.0 and rows[0].d.weight_scored == 0.4 and abs(rows[1].w - 0.32) < 1e-12 and rows[1].d is None and rows[2].w is None
    r = df.select(N.rate(F.lit(1), F.lit(100), .009).alias("thin"), N.rate(F.lit(9), F.lit(1000), .009).alias("full"), N.rate(F.lit(0), F.lit(0), .009).alias("zero"),
                  N.rate(F.lit(1), F.lit(None).cast("int"), .009).alias("absent")).first()
    assert (r.thin, r.full, r.zero, r.absent) == (None, 1.0, 0.0, None)


def test_long_names_and_commands_are_read_whole(spark):
    """No part of a name is cut, and long commands do not overflow the matcher."""
    from loomtrace.functions import models as M, text as X
    from loomtrace.sources import cursor
    long_word, parts = "x" * 3000, [f"p{i}" for i in range(301)]
    calls = ["node " + "word " * 20000 + "--test", "node " + "word " * 20000, "gradle " + "a " * 20000 + ":m:sub:test", "sbt " + "b " * 20000 + "it:testOnly", "gradle :test", "gradle compileTestJava", "mvn " + "-q " * 20000 + "verify; ls",
             "node a; b --test", "A=1 " * 20000 + "git status", "A=1 " * 5000]
    df = spark.createDataFrame([(long_word + "-opus", "mcp_" + "_".join(parts), c) for c in calls], "m string, k string, c string")
    rows = df.select(M.pretty(df.m).alias("m"), cursor.flat_mcp(df.k).alias("k"), X.runs_tests(df.c).alias("t"), X.cli_heads(df.c).alias("h")).collect()
    assert rows[0].m == "X" + "x" * 2999 + " Opus" and rows[0].k == "mcp__p0__" + "_".join(parts[1:])
    assert [r.t for r in rows] == [True, False, True, True, False, False, True, False, False, False]
    assert rows[8].h == ["git"] and rows[9].h == []


def test_line_order_holds_for_any_split_size(spark, tmp_path):
    from loomtrace.sources import files
    for n in range(6):
        (tmp_path / f"{n}.txt").write_text("\n\n\n" * n + "".join(f"{i}\n\n" for i in range(700 + 37 * n)))
    for size in ("64", "1000", "7000", "100000"):
        spark.conf.set("spark.sql.files.maxPartitionBytes", size)
        spark.conf.set("spark.sql.files.openCostInBytes", "0")
        try:
            rows = files.lines(spark, str(tmp_path)).orderBy("file_path", "ordinal").collect()
        finally:
            spark.conf.unset("spark.sql.files.maxPartitionBytes")
            spark.conf.unset("spark.sql.files.openCostInBytes")
        assert [int(r.value) for r in rows] == [i for n in range(6) for i in range(700 + 37 * n)]
        assert len({(r.file_path, r.ordinal) for r in rows}) == len(rows)
