"""Prompt and text queries: classifiers over whole texts."""
from __future__ import annotations

from pyspark.sql import functions as F

from loomtrace import dims
from loomtrace.catalog.registry import Tables, query
from loomtrace.functions import text as X
from loomtrace.functions import paths as P, quotes as Q, text as X, tools as T
from loomtrace.operators import aggregates as A, planning

# SQL spellings of the fixed vocabularies (RE2 has no Unicode word border and no look-around)
B, E = r"(^|[^\p{L}\p{N}\p{M}_])", r"($|[^\p{L}\p{N}\p{M}_])"


def q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def lst(words) -> str:
    return "[" + ", ".join(q(w) for w in words) + "]"


def uword(words) -> str:
    return "|".join(w.replace(r"\w", r"[\p{L}\p{N}\p{M}_]") for w in words)


POLITE = "(?i)" + B + "(" + uword(dims.POLITE_WORDS) + ")" + E
WS = r"[\s\x{00A0}\x{0085}\x{2000}-\x{200A}\x{2028}\x{2029}\x{3000}]"
CLEAN = "text"
for _tag in dims.INJECTED_TAGS:
    CLEAN = f"regexp_replace({CLEAN}, '(?s)<{_tag}>.*?</{_tag}>', '', 'g')"
CLEAN = f"regexp_replace(regexp_replace({CLEAN}, '^{WS}+', ''), '{WS}+$', '')"
TOKENS = f"list_filter(regexp_split_to_array(c, '{WS}+'), lambda x: x <> '')"


def prompts(t: Tables):
    """Cleaned user prompts; every third text carries an injected wrapper, as transcripts do."""
    wrapped = F.when(F.col("conv_id") % 3 == 0, F.concat(
        F.lit("<system-reminder>x\ny</system-reminder> "), F.col("text"), F.lit(" <command-args>z</command-args>\n")))
    c = t.conversations.filter("role = 'user'").withColumn("text", wrapped.otherwise(F.col("text")))
    return c.withColumn("c", X.strip_injections(F.col("text"))).filter("c <> ''")


PROMPTS_SQL = f"""
WITH u AS (SELECT conv_id, turn, role, CASE WHEN conv_id % 3 = 0 THEN '<system-reminder>x' || chr(10) || 'y</system-reminder> ' || text || ' <command-args>z</command-args>' || chr(10) ELSE text END AS text
           FROM conversations WHERE role = 'user'),
     p AS (SELECT conv_id, turn, {CLEAN} AS c FROM u), v AS (SELECT * FROM p WHERE c <> '')"""


@query("human_prompts", PROMPTS_SQL + " SELECT conv_id, turn, c AS prompt FROM v")
def _(t: Tables):
    return prompts(t).select("conv_id", "turn", F.col("c").alias("prompt"))


@query("prompt_lengths", PROMPTS_SQL + """
SELECT conv_id % 10 AS owner, CAST(count(*) AS BIGINT) AS prompts, round(avg(length(c)), 1) AS avg_len, median(length(c)) AS median_len FROM v GROUP BY 1""")
def _(t: Tables):
    p = prompts(t).withColumn("owner", F.col("conv_id") % 10).withColumn("n", F.length("c").cast("bigint"))
    s = A.depth_stats(p, ["owner"], "n")
    return s.select("owner", F.col("runs").alias("prompts"), F.round("mean", 1).alias("avg_len"), F.col("median").alias("median_len"))


@query("polite_prompts", PROMPTS_SQL + f"""
SELECT conv_id % 10 AS owner, CAST(count(*) FILTER (regexp_matches(c || CASE WHEN turn % 4 = 0 THEN ' Thanks!' ELSE '' END, {q(POLITE)})) AS BIGINT) AS polite FROM v GROUP BY 1""")
def _(t: Tables):
    p = prompts(t).withColumn("c", F.concat("c", F.when(F.col("turn") % 4 == 0, " Thanks!").otherwise("")))
    return p.groupBy((F.col("conv_id") % 10).alias("owner")).agg(A.count_if(X.is_polite(F.col("c"))).alias("polite"))


_SECRET = dims.SECRET_PATTERN
_CONTACT = (r"[\p{L}\p{N}\p{M}_.+-]+@[\p{L}\p{N}\p{M}_-]+\.[a-z]{2,}|" + B + r"\p{Nd}{3}[\s.\-]?\p{Nd}{3}[\s.\-]?\p{Nd}{4}" + E + "|" + B + r"\p{Nd}{6,}" + E)
_MARKERS = "|".join(m.replace(r"\b", E) for m in dims.SYSTEM_MARKERS)
SAFE = f"""(c <> '' AND length(c) <= 140 AND NOT regexp_matches(c, {q('(?i)' + _MARKERS)}) AND NOT regexp_matches(c, {q('(?i)' + _SECRET)})
  AND len(list_filter({TOKENS}, lambda x: length(x) > 32)) = 0
  AND NOT (len({TOKENS}) = 1 AND regexp_matches({TOKENS}[1], '^[A-Z0-9]*[0-9][A-Z0-9]*$') AND length({TOKENS}[1]) >= 7)
  AND NOT regexp_matches(c, {q('(?i)' + _CONTACT)}))"""


def lines(t: Tables):
    """Every line of every document as a short text (whole documents, no prefix)."""
    d = t.documents.select("doc_id", "source", F.posexplode(F.split("text", "\n")).alias("line", "c"))
    return d.withColumn("c", X.strip_blank(F.col("c"))).filter("c <> ''")


LINES_SQL = f"""
WITH l AS (SELECT doc_id, source, unnest(string_split(text, chr(10))) AS raw, unnest(range(len(string_split(text, chr(10))))) AS line FROM documents),
     v AS (SELECT * FROM (SELECT doc_id, source, line, regexp_replace(regexp_replace(raw, '^{WS}+', ''), '{WS}+$', '') AS c FROM l) WHERE c <> '')"""


@query("safe_quotes", LINES_SQL + f" SELECT source, CAST(count(*) FILTER (length(c) <= 140) AS BIGINT) AS short_lines, CAST(count(*) FILTER ({SAFE}) AS BIGINT) AS safe FROM v GROUP BY 1")
def _(t: Tables):
    return lines(t).groupBy("source").agg(A.count_if(F.length("c") <= 140).alias("short_lines"),
                                          A.count_if(Q.safe_quote(F.col("c"))).alias("safe"))


TRIPLE = "|".join(f"{ch}{{3}}" for ch in "abcdefghijklmnopqrstuvwxyz0123456789") + "|'''"
TYPO = f"""len(list_filter(regexp_extract_all(lower(c), '[a-z0-9'']+'), lambda x: list_contains({lst(dims.TYPO_WORDS)}, x)
   OR (length(x) >= 4 AND NOT regexp_matches(x, '[aeiou]')) OR regexp_matches(x, {q(TRIPLE)}) OR regexp_matches(x, '[a-z][0-9]|[0-9][a-z]')))"""


@query("typo_scores", PROMPTS_SQL + f" SELECT conv_id, turn, CAST({TYPO} AS BIGINT) AS typos FROM v")
def _(t: Tables):
    return prompts(t).select("conv_id", "turn", Q.typo_score(F.col("c")).alias("typos"))


# every separator twice: neighbouring words then each have their own borders to consume
DOUBLED = r"regexp_replace(c, '([^\p{L}\p{N}\p{M}_])', '\1\1', 'g')"


def times(words) -> str:
    """How often one of the words occurs."""
    spelled = uword(words).replace(" ?", "(?:  )?").replace(" ", "  ").replace("(?:    )?", "(?:  )?")
    return f"len(regexp_extract_all({DOUBLED}, {q('(?i)' + B + '(' + spelled + ')' + E)}))"


WORDS = f"len({TOKENS})"
LETTERS = r"len(regexp_extract_all(c, '\p{L}'))"
CAPS = rf"CASE WHEN {LETTERS} = 0 THEN 0.0::DOUBLE ELSE len(regexp_extract_all(c, '\p{{Lu}}'))::DOUBLE / {LETTERS} END"
BANGS = "len(regexp_extract_all(c, '[!?]'))"
SHOUTS = f"len(regexp_extract_all({DOUBLED}, {q(B + '[A-Z]{3,}' + E)}))"
HEAT = (f"({CAPS} * 2.5::DOUBLE + greatest(0, 9 - {WORDS}) * 0.5::DOUBLE + least({SHOUTS}, 4) * 0.4::DOUBLE + least({times(dims.RAGE_WORDS)}, 3) * 0.5::DOUBLE"
        f" + least({BANGS}, 5) * 0.3::DOUBLE)")
CRYPTIC = (f"({TYPO} * 1.0::DOUBLE + {times(dims.VAGUE_WORDS)} * 0.55::DOUBLE + CASE WHEN c = lower(c) THEN 0.5::DOUBLE ELSE 0 END"
           f" + CASE WHEN regexp_matches(c, '[.?!]') THEN 0 ELSE 0.35::DOUBLE END + greatest(0, 7 - {WORDS}) * 0.25::DOUBLE"
           f" + CASE WHEN regexp_matches(c, {q('(?i)' + dims.EMOTICON_PATTERN)}) THEN 1.6::DOUBLE ELSE 0 END + CASE WHEN {times(dims.FEELING_WORDS)} > 0 THEN 1.3::DOUBLE ELSE 0 END)")


@query("prompt_heat", PROMPTS_SQL + f""" SELECT conv_id, turn, round({HEAT} + CASE WHEN turn % 24 BETWEEN 2 AND 5 THEN 1.8::DOUBLE ELSE 0 END, 6) AS heat,
  {SAFE} AND {LETTERS} >= 6 AND {WORDS} <= 16 AND ({times(dims.RAGE_WORDS)} > 0 OR {BANGS} >= 2) AND {HEAT} >= 2 AS candidate FROM v""")
def _(t: Tables):
    p = prompts(t)
    return p.select("conv_id", "turn", F.round(Q.heat_score(F.col("c"), (F.col("turn") % 24).cast("int")), 6).alias("heat"),
                    Q.heat_candidate(F.col("c")).alias("candidate"))


@query("caps_and_bangs", PROMPTS_SQL + r"""
SELECT conv_id, turn, round(CASE WHEN len(regexp_extract_all(c, '\p{L}')) = 0 THEN 0.0 ELSE len(regexp_extract_all(c, '\p{Lu}')) / len(regexp_extract_all(c, '\p{L}')) END, 6) AS caps,
       CAST(len(regexp_extract_all(c, '[!?]')) AS INTEGER) AS bangs FROM v""")
def _(t: Tables):
    c = F.col("c")
    return prompts(t).select("conv_id", "turn", F.round(Q.caps_ratio(c), 6).alias("caps"), Q.bang_count(c).alias("bangs"))


@query("prompt_cryptic", PROMPTS_SQL + f""" SELECT conv_id, turn, round({CRYPTIC}, 6) AS score, {SAFE} AND {WORDS} BETWEEN 3 AND 14
  AND len(regexp_extract_all(lower(c), '[a-z'']+')) > 0 AND len(list_filter(regexp_extract_all(lower(c), '[a-z'']+'), lambda x: NOT list_contains({lst(dims.FILLER_WORDS)}, x))) > 0
  AND {CRYPTIC} >= 1.8 AS candidate FROM v""")
def _(t: Tables):
    return prompts(t).select("conv_id", "turn", F.round(Q.cryptic_score(F.col("c")), 6).alias("score"),
                             Q.cryptic_candidate(F.col("c")).alias("candidate"))


@query("longest_prompts", PROMPTS_SQL + """,
 r AS (SELECT conv_id % 5 AS owner, conv_id, turn, length(c) AS n, row_number() OVER (PARTITION BY conv_id % 5 ORDER BY length(c) DESC, conv_id, turn) AS rank FROM v)
SELECT owner, conv_id, turn, CAST(n AS INTEGER) AS n, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 20""")
def _(t: Tables):
    p = prompts(t).select((F.col("conv_id") % 5).alias("owner"), "conv_id", "turn", F.length("c").alias("n"))
    return A.rank_counts(p, ["owner"], 20, "n", ["conv_id", "turn"])


@query("dedup_rank", LINES_SQL + """,
 s AS (SELECT doc_id % 4 AS owner, c, length(c) % 50 AS score, doc_id * 1000000 + line AS o, lower(c) AS k FROM v),
 b AS (SELECT owner, k, arg_max(c, (score, -o)) AS c, max(score) AS score FROM s GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY score DESC, c) AS rank, max(score) OVER (PARTITION BY owner) AS top FROM b)
SELECT owner, c, CAST(score AS INTEGER) AS score, CAST(rank AS INTEGER) AS rank FROM r WHERE rank <= 6 AND score >= top * 0.5""")
def _(t: Tables):
    l = lines(t).select(
        (F.col("doc_id") % 4).alias("owner"), "c", (F.length("c") % 50).cast("int").alias("score"),
        (F.col("doc_id") * 1000000 + F.col("line")).alias("o"))
    return A.dedup_rank(l, ["owner"], "c", "score", F.col("o"))


PHRASE = f"regexp_replace(regexp_replace(regexp_replace(lower(c), '{WS}+', ' ', 'g'), '^[?.!, ]+', ''), '[?.!, ]+$', '')"


@query("goto_phrase", LINES_SQL + f""",
 s AS (SELECT doc_id % 4 AS owner, {PHRASE} AS ph, c, doc_id, doc_id * 1000000 + line AS o FROM v WHERE len({TOKENS}) <= 6),
 g AS (SELECT owner, ph, count(*) AS uses, count(DISTINCT doc_id) AS sessions, arg_min(c, o) AS c, min(o) AS f FROM s WHERE length(ph) >= 2 GROUP BY 1, 2),
 r AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY uses DESC, f) AS rank FROM g),
 k AS (SELECT *, row_number() OVER (PARTITION BY owner ORDER BY rank) AS i FROM r WHERE rank <= 25 AND uses >= 3 AND sessions >= 2)
SELECT owner, ph, c, CAST(uses AS BIGINT) AS uses, CAST(sessions AS BIGINT) AS sessions FROM k WHERE i = 1""")
def _(t: Tables):
    l = lines(t).filter(X.word_count(F.col("c")) <= 6).select(
        (F.col("doc_id") % 4).alias("owner"), Q.phrase_key(F.col("c")).alias("ph"), "c", "doc_id",
        (F.col("doc_id") * 1000000 + F.col("line")).alias("o")).filter(F.length("ph") >= 2)
    return A.goto_phrase(l, ["owner"], "ph", "c", "doc_id", F.col("o"))


EXTS = ["py", "test.ts", "md", "json", "lock", "go", "txt", "rs", "toml", "ipynb", "sql", "yaml"]
DIRS = ["src", "tests", "docs/plans", ".claude/plans", "/tmp/scratchpad", "memory", "app/spec", "lib"]


def target_paths(t: Tables):
    """Write targets derived from the part and page tables."""
    p = t.part.select(F.concat(
        F.element_at(F.array(*[F.lit(d) for d in DIRS]), (F.col("p_partkey") % 8 + 1).cast("int")), F.lit("/"), F.lower("p_type"), F.lit("/"),
        F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("."),
        F.element_at(F.array(*[F.lit(e) for e in EXTS]), (F.col("p_size") % 12 + 1).cast("int"))).alias("path"))
    return p.unionByName(t.pages.select(F.col("url").alias("path")))


PATHS_SQL = f"""
WITH p AS (SELECT {lst(DIRS)}[CAST(p_partkey % 8 + 1 AS INT)] || '/' || lower(p_type) || '/' || replace(p_name, ' ', '_') || '.' || {lst(EXTS)}[CAST(p_size % 12 + 1 AS INT)] AS path FROM part
           UNION ALL SELECT url FROM pages),
     n AS (SELECT path, lower(split_part(path, '/', -1)) AS name FROM p),
     x AS (SELECT path, name, CASE WHEN contains(name, '.') THEN split_part(name, '.', -1) ELSE '' END AS ext, split_part(name, '.', 1) AS stem FROM n)"""


@query("classify_targets", PATHS_SQL + f"""
SELECT path, CASE WHEN regexp_matches(path, {q('(?i)' + dims.SCRATCH_PATTERN)}) THEN 'other' WHEN list_contains({lst(dims.LOCKFILES)}, name) THEN 'lockfile'
  WHEN regexp_matches(path, {q('(?i)' + dims.TEST_PATH_PATTERN)}) THEN 'test' WHEN list_contains({lst(dims.CODE_EXTS)}, ext) THEN 'code'
  WHEN list_contains({lst(dims.DOC_EXTS)}, ext) OR list_contains({lst(dims.DOC_NAMES)}, stem) THEN 'doc'
  WHEN list_contains({lst(dims.CONFIG_EXTS)}, ext) OR list_contains({lst(dims.CONFIG_NAMES)}, name) THEN 'config' ELSE 'other' END AS kind,
  regexp_matches(path, {q('(?i)' + dims.PLAN_FILE_PATTERN)}) AS plan_file, regexp_matches(path, {q('(?i)' + dims.COMPOUNDING_PATTERN)}) AS compounding FROM x""")
def _(t: Tables):
    p = F.col("path")
    return target_paths(t).select("path", P.change_target(p).alias("kind"), P.is_plan_file(p).alias("plan_file"),
                                  P.is_compounding(p).alias("compounding"))


@query("normalized_paths", """
SELECT p_partkey, 'r/' || lower(p_type) || '/' || replace(p_name, ' ', '_') AS path FROM part""")
def _(t: Tables):
    messy = F.concat(F.lit("r//x/../"), F.lower("p_type"), F.lit("/./"), F.replace("p_name", F.lit(" "), F.lit("_")), F.lit("/"))
    return t.part.select("p_partkey", P.normalize(messy).alias("path"))


def commands(t: Tables):
    """Shell commands derived from the documents: whole texts with a command head in front."""
    heads = ["git status && ", "FOO=1 npm test; ", "cat x | ", "pytest -q; ", "echo 2>/dev/null; ", "tee out.txt; ", "sed -i s/a/b/ f; ", "gh pr view 3; "]
    return t.documents.select("doc_id", F.concat(
        F.element_at(F.array(*[F.lit(h) for h in heads]), (F.col("doc_id") % 8 + 1).cast("int")), F.col("text")).alias("cmd"))


COMMANDS_SQL = "WITH c AS (SELECT doc_id, ['git status && ', 'FOO=1 npm test; ', 'cat x | ', 'pytest -q; ', 'echo 2>/dev/null; ', 'tee out.txt; ', 'sed -i s/a/b/ f; ', 'gh pr view 3; '][CAST(doc_id % 8 + 1 AS INT)] || text AS cmd FROM documents)"
# \b is ASCII in both engines here, as in the shell patterns themselves
PARTS = f"regexp_split_to_array(cmd, {q(dims.SHELL_SPLIT_PATTERN)})"


@query("cli_heads", COMMANDS_SQL + rf""",
 p AS (SELECT doc_id, unnest({PARTS}) AS part FROM c),
 h AS (SELECT doc_id, split_part(regexp_extract(list_filter(regexp_split_to_array(part, '\s+'), lambda x: x <> '' AND NOT (contains(x, '=') AND NOT starts_with(x, '-')))[1], '\S+'), '/', -1) AS cli FROM p)
SELECT cli, CAST(count(*) AS BIGINT) AS n FROM h WHERE list_contains({lst(dims.KNOWN_CLIS)}, cli) GROUP BY 1""")
def _(t: Tables):
    return commands(t).select(F.explode(X.cli_heads(F.col("cmd"))).alias("cli")).groupBy("cli").agg(F.count(F.lit(1)).alias("n"))


# no lookahead in SQL; the group after the command may take its character there
_RUN, _KNOW = (p.replace("(?=", "(?:") for p in (dims.TEST_COMMAND, dims.KNOWLEDGE_COMMAND))


@query("shell_tests", COMMANDS_SQL + f" SELECT doc_id, regexp_matches(cmd, {q(_RUN)}) AS tests, regexp_matches(cmd, {q(_KNOW)}) AS knowledge FROM c")
def _(t: Tables):
    c = F.col("cmd")
    return commands(t).select("doc_id", X.runs_tests(c).alias("tests"), X.runs_knowledge(c).alias("knowledge"))


@query("shell_writes", COMMANDS_SQL + r"""
 SELECT doc_id, (regexp_matches(cmd, '<<($|[^<])') OR regexp_matches(cmd, '\bsed\s+-i') OR regexp_matches(cmd, '\btee\s*\s([^>|]|$)')
   OR len(list_filter(regexp_extract_all(' ' || cmd, '([^2>]>{1,2}\s*(?:/dev/null|&\d)?[^>]?)'), lambda x: NOT regexp_matches(x, '>\s*(/dev/null|&\d)'))) > 0) AS writes,
   CAST(length(cmd) - length(replace(cmd, chr(10), '')) AS BIGINT) AS authored FROM c""")
def _(t: Tables):
    c = F.col("cmd")
    return commands(t).select("doc_id", X.writes_file(c).alias("writes"), X.newline_count(c).alias("authored"))


@query("line_counts", """
SELECT doc_id, CAST(CASE WHEN text = '' THEN 0 ELSE length(text) - length(replace(text, chr(10), '')) + CASE WHEN ends_with(text, chr(10)) THEN 0 ELSE 1 END END AS BIGINT) AS lines FROM documents""")
def _(t: Tables):
    return t.documents.select("doc_id", X.line_count(F.col("text")).alias("lines"))


@query("span_dedup", """
WITH d AS (SELECT conv_id, role, turn FROM conversations WHERE turn % 3 = 0),
     a AS (SELECT conv_id, role, turn FROM conversations WHERE turn % 3 <> 0),
     f AS (SELECT conv_id, role, min(turn) AS turn FROM a WHERE NOT EXISTS (SELECT 1 FROM d WHERE d.conv_id = a.conv_id AND d.role = a.role) GROUP BY 1, 2)
SELECT role, turn, CAST(count(*) AS BIGINT) AS n FROM (SELECT * FROM d UNION ALL SELECT * FROM f) GROUP BY 1, 2""")
def _(t: Tables):
    c = t.conversations.select("conv_id", "role", "turn")
    credited = A.span_dedup(c.filter("turn % 3 = 0"), c.filter("turn % 3 <> 0"), [], ["conv_id"], "role", F.col("turn"), ["turn"])
    return credited.groupBy("role", "turn").agg(F.count(F.lit(1)).alias("n"))


def tool_names(t: Tables):
    """MCP-style tool names derived from the part table."""
    servers = ["github", "plugin", "mem0", "figma", "context7", "postgres", "slack", "custom"]
    verbs = ["get_issue", "atlassian_atlassian_search", "add_memory", "list_frames", "write_docs", "run_sql", "send_message", "deploy"]
    pick = lambda vals, e: F.element_at(F.array(*[F.lit(v) for v in vals]), e.cast("int"))
    return t.part.select("p_partkey", F.concat(F.lit("mcp__"), pick(servers, F.col("p_partkey") % 8 + 1), F.lit("__"),
                                               pick(verbs, F.col("p_size") % 8 + 1)).alias("name"))


def _case(col: str, table) -> str:
    return " ".join("WHEN " + " OR ".join(f"contains({col}, {q(n)})" for n in ns) + f" THEN {q(c)}" for c, ns in table.items())


@query("tool_servers", f"""
WITH n AS (SELECT p_partkey, ['github', 'plugin', 'mem0', 'figma', 'context7', 'postgres', 'slack', 'custom'][CAST(p_partkey % 8 + 1 AS INT)] AS raw,
   ['get_issue', 'atlassian_atlassian_search', 'add_memory', 'list_frames', 'write_docs', 'run_sql', 'send_message', 'deploy'][CAST(p_size % 8 + 1 AS INT)] AS tool FROM part),
 s AS (SELECT *, CASE WHEN raw <> 'plugin' THEN raw WHEN tool = 'atlassian_atlassian_search' THEN 'atlassian' WHEN NOT contains(tool, '_') THEN raw
    WHEN list_contains(['plugin', 'tool', 'get', 'list', 'search'], split_part(tool, '_', 1)) THEN raw ELSE split_part(tool, '_', 1) END AS server FROM n),
 k AS (SELECT *, CASE {_case('server', dims.MCP_SERVER_HINTS)} {_case('tool', dims.MCP_TOOL_HINTS)} ELSE 'other' END AS sub,
    len(list_filter({lst(dims.MCP_INSPECT_HINTS)}, lambda h: contains(tool, h))) > 0 AS reads,
    len(list_filter({lst(dims.MCP_WRITE_HINTS)}, lambda h: contains(tool, h))) > 0 AS puts FROM s)
SELECT server, sub, CASE WHEN reads THEN 'explore' ELSE 'produce' END AS category,
   sub = 'knowledge' AND NOT contains(server, 'context7') AND NOT contains(server, 'exa') AND NOT reads AND puts AS knowledge_write, CAST(count(*) AS BIGINT) AS calls
FROM k GROUP BY ALL""")
def _(t: Tables):
    n = tool_names(t)
    name = F.col("name")
    n = n.select(T.mcp_server(name).alias("server"), T.mcp_tool(name).alias("tool"), T.classify(name).alias("category"))
    sub = T.mcp_subcategory(F.col("server"), F.col("tool"))
    return n.select("server", sub.alias("sub"), "category", T.is_knowledge_write(F.col("server"), F.col("tool")).alias("knowledge_write")) \
        .groupBy("server", "sub", "category", "knowledge_write").agg(F.count(F.lit(1)).alias("calls"))


@query("payload_budget", """
WITH d AS (SELECT strlen(json_object('doc_id', doc_id, 'text', text, 'lang', lang, 'source', source)::VARCHAR) AS n FROM documents)
SELECT n >= 8192 AS rejected, count(*) AS documents, CAST(max(n) AS INTEGER) AS largest FROM d GROUP BY 1""")
def _(t: Tables):
    j = F.to_json(F.struct("doc_id", "text", "lang", "source"))
    d = t.documents.select("doc_id", F.octet_length(j).alias("bytes"), planning.over_budget(j, 8192).alias("rejected"))
    return d.groupBy("rejected").agg(F.count(F.lit(1)).alias("documents"), F.max("bytes").alias("largest"))


@query("prompt_markers", """
WITH c AS (SELECT role, turn, coalesce(text, '') AS text FROM conversations),
     w AS (SELECT role, text, CASE turn % 5 WHEN 0 THEN '<command-name>' || text || '</command-name>' WHEN 1 THEN '  <local-command-stdout>' || text
                  WHEN 2 THEN 'see http://LOCALHOST:80/ ' || text WHEN 3 THEN '<task> ' || text || ' </task><task>x</task>' ELSE text END AS t FROM c)
SELECT role, count(*) AS turns, count(*) FILTER (WHERE contains(t, '<command-name>') OR starts_with(ltrim(t), '<local-command')) AS commands,
       count(*) FILTER (WHERE regexp_matches(lower(t), 'localhost|127\\.0\\.0\\.1|0\\.0\\.0\\.0|\\[::1\\]')) AS local_urls,
       count(*) FILTER (WHERE contains(t, '<task>')) AS tasks,
       CAST(coalesce(sum(length(trim(regexp_extract(t, '(?s)<task>(.*?)</task>', 1)))), 0) AS BIGINT) AS task_chars,
       CAST(sum(length(replace(text, ' ', ' && '))) AS BIGINT) AS argv_chars
FROM w GROUP BY role""")
def _(t: Tables):
    """Command echoes, local addresses, tagged text and commands given as lists, in turns marked by their number."""
    text = F.coalesce("text", F.lit(""))
    n = F.col("turn") % 5
    marked = (F.when(n == 0, F.concat(F.lit("<command-name>"), text, F.lit("</command-name>"))).when(n == 1, F.concat(F.lit("  <local-command-stdout>"), text))
              .when(n == 2, F.concat(F.lit("see http://LOCALHOST:80/ "), text)).when(n == 3, F.concat(F.lit("<task> "), text, F.lit(" </task><task>x</task>"))).otherwise(text))
    c = t.conversations.select("role", text.alias("text"), marked.alias("t"))
    task = X.tag_text(F.col("t"), "task")
    some = lambda b: F.sum(F.when(b, 1).otherwise(0)).cast("bigint")
    return c.groupBy("role").agg(
        F.count(F.lit(1)).alias("turns"), some(X.is_command_text(F.col("t"))).alias("commands"), some(X.is_local_url(F.col("t"))).alias("local_urls"),
        some(task.isNotNull()).alias("tasks"), F.coalesce(F.sum(F.length(task)), F.lit(0)).cast("bigint").alias("task_chars"),
        F.sum(F.length(X.argv_command(F.to_json(F.split("text", " "))))).cast("bigint").alias("argv_chars"))
