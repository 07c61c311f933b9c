"""URL allow and block rules with redirect equivalence.

A rule (host, path) fits a url whose host is the rule's or below it and whose path starts with the
rule's; the longest rule wins. Aliases are urls tied by redirects (meta
refresh) or canonical links of pages. A node is an address: host, path and query, without scheme and
fragment, so one address has one rule and sharing it never changes a verdict. Connected components over
the ties are found on written edge tables; a component with a blocked url blocks its urls that no rule
names. An url's own allow
rule takes precedence over what reaches it from aliases, and its own block rule holds anyway.

Everything is DataFrame functions. Hosts are matched by an equi-join on their suffixes. Rules are
broadcast only while they are at most `BROADCAST_RULES`; beyond that the join shuffles.

Attributes are read one after the other, in double quotes, single quotes or none; `rel` is a list of
words; the entities of ENTITIES are decoded; of repeated attributes the first counts. The quotes around
a refresh target go.

Defined results: a NULL url, or one without `://`, has an empty host and path, no rule and no
aliases and is allowed; a NULL page has no links; equal rows get equal results.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import base, components

RULES = [("allow", "org", "/"), ("block", "example.org", "/es/"), ("block", "example.org", "/en/1"), ("allow", "com", "/fr/"), ("block", "com", "/de/")]
BROADCAST_RULES = 10_000
#: Entities that occur in urls; & is decoded last, so nothing is decoded twice.
ENTITIES = [("&lt;", "<"), ("&gt;", ">"), ("&quot;", '"'), ("&#34;", '"'), ("&apos;", "'"), ("&#39;", "'"), ("&#x27;", "'"), ("&#47;", "/"), ("&#x2F;", "/"), ("&#61;", "="), ("&#38;", "&"), ("&#x26;", "&"), ("&amp;", "&")]
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def _rest(url: Column) -> Column:
    """What follows the first ://, NULL without one."""
    at = F.locate("://", url)
    return F.when(at > 0, F.substring(url, at + 3, F.length(url)))


def host_of(url: Column) -> Column:
    return F.coalesce(F.translate(F.regexp_extract(_rest(url), r"^([^/?#]*)", 1), _UPPER, _LOWER), F.lit(""))


def path_of(url: Column) -> Column:
    return F.coalesce(F.regexp_extract(_rest(url), r"^[^/?#]*([^?#]*)", 1), F.lit(""))


def address(url: Column) -> Column:
    """Host, path and query; NULL for a NULL url or one without ://."""
    return F.when(_rest(url).isNotNull(), F.concat(host_of(url), F.regexp_extract(_rest(url), r"^[^/?#]*([^#]*)", 1)))


_SPACE = r"[\t\n\f\r ]"


def _attributes(tag: Column) -> Column:
    """Array of (name, value) in the order of a tag."""
    pieces = F.regexp_extract_all(tag, F.lit(rf"""[^\t\n\f\r "'<>/=]+{_SPACE}*={_SPACE}*(?:"[^"]*"|'[^']*'|[^\t\n\f\r "'>]+)"""), F.lit(0))

    def split(piece: Column) -> Column:
        raw = F.regexp_extract(piece, rf"(?s)^[^=]*={_SPACE}*(.*)$", 1)
        value = F.when(raw.startswith('"') | raw.startswith("'"), F.substring(raw, F.lit(2), F.length(raw) - 2)).otherwise(raw)
        for entity, char in ENTITIES:
            value = F.replace(value, F.lit(entity), F.lit(char))
        return F.struct(F.translate(F.regexp_extract(piece, r"^[^\t\n\f\r =]+", 0), _UPPER, _LOWER).alias("name"), value.alias("value"))
    return F.transform(pieces, split)


def links(pages: DataFrame) -> DataFrame:
    """(url, target) of redirects and canonical links in pages (url, html); relative targets are resolved."""
    # possessive: the matcher does not recurse, however long a tag is
    tags = F.regexp_extract_all("html", F.lit(r"""(?i)<(?:link|meta)[\t\n\f\r /](?:[^>"']++|"[^"]*+"|'[^']*+')*+>"""), F.lit(0))
    tag = pages.filter("url is not null").select("url", F.explode(tags).alias("tag")).select("url", _attributes(F.col("tag")).alias("all"))
    value = lambda name: F.get(F.filter("all", lambda a: a["name"] == name), F.lit(0))["value"]
    tag = tag.select("url", *[value(n).alias(k) for n, k in (("rel", "rel"), ("href", "href"), ("http-equiv", "equiv"), ("content", "content"))])
    canonical = F.when(F.array_contains(F.split(F.translate("rel", _UPPER, _LOWER), _SPACE), "canonical"), F.trim("href"))
    asked = F.regexp_extract("content", rf"(?is)^[^;]*;{_SPACE}*url{_SPACE}*={_SPACE}*(.*?){_SPACE}*$", 1)
    quoted = F.when(asked.startswith("'"), F.regexp_extract(asked, "^'([^']*)", 1)).when(asked.startswith('"'), F.regexp_extract(asked, '^"([^"]*)', 1)).otherwise(asked)
    refresh = F.when(F.translate("equiv", _UPPER, _LOWER) == "refresh", F.trim(quoted))
    found = tag.select("url", F.coalesce(canonical, refresh).alias("to")).filter("to <> ''")
    scheme, origin = F.substring_index("url", "://", 1), F.regexp_extract("url", r"^([\s\S]*?://[^/?#]*)", 1)
    folder = F.regexp_replace(path_of(F.col("url")), r"[^/]*$", "")
    to = F.col("to")
    target = (F.when(to.rlike(r"^[A-Za-z][A-Za-z0-9+.-]*://"), to).when(to.startswith("//"), F.concat(scheme, F.lit(":"), to)).when(to.startswith("/"), F.concat(origin, to))
              .otherwise(F.concat(origin, F.when(folder == "", F.lit("/")).otherwise(folder), to)))
    return found.select("url", target.alias("target"))


def _ruled(urls: DataFrame, rules: list[tuple[str, str, str]] | DataFrame) -> DataFrame:
    """urls (host, path; distinct) with rule and decision (NULL: none)."""
    spark = urls.sparkSession
    table = rules if isinstance(rules, DataFrame) else spark.createDataFrame(rules, "decision string, rule_host string, rule_path string")
    table = table.select("decision", F.lower("rule_host").alias("suffix"), "rule_path")
    if table.count() <= BROADCAST_RULES:
        table = F.broadcast(table)
    parts = F.split("host", r"\.")
    below = urls.select("host", "path", F.explode(F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, -i, i), "."))).alias("suffix"))
    fits = below.join(table, "suffix").filter(F.col("path").startswith(F.col("rule_path")))
    rule = F.concat("suffix", "rule_path")
    best = fits.groupBy("host", "path").agg(F.max(F.struct(F.length(rule).alias("n"), F.length("suffix").alias("m"), rule.alias("rule"), "decision")).alias("best"))
    return urls.join(best.hint("merge"), ["host", "path"], "left").select("host", "path", "best.rule", "best.decision")


def judge(pages: DataFrame, rules: list[tuple[str, str, str]] | DataFrame = RULES) -> DataFrame:
    """page_id, host, path, rule, verdict, component (smallest address of the aliases) of pages (page_id, url, html)."""
    spark = pages.sparkSession
    work = base.new_work(spark)
    tied = base.materialize(links(pages), f"{work}/links")
    own = pages.select("page_id", "url")
    urls = own.select("url").unionByName(tied.select(F.col("target").alias("url"))).filter("url is not null").distinct()
    urls = urls.select("url", host_of(F.col("url")).alias("host"), path_of(F.col("url")).alias("path"), address(F.col("url")).alias("node"))
    urls = base.materialize(urls, f"{work}/urls")
    ruled = base.materialize(_ruled(urls.select("host", "path").distinct(), rules), f"{work}/ruled")
    edges = tied.select(address(F.col("url")).alias("u"), address(F.col("target")).alias("v")).filter("u is not null and v is not null")
    labels = components.label(edges, f"{work}/components")
    nodes = urls.filter("node is not null").join(ruled.hint("merge"), ["host", "path"]).groupBy("node").agg(F.max(F.col("decision") == "block").alias("blocked"))
    nodes = nodes.join(labels.hint("merge"), "node", "left").withColumn("component", F.coalesce("label", "node"))
    hit = nodes.groupBy("component").agg(F.coalesce(F.max("blocked"), F.lit(False)).alias("reached"))
    # a decision per url, then one join of the pages: a url that a third of the pages share is one row here
    # all of these grow with the pages and none is broadcast, however small the planner takes them to be
    decided = urls.join(ruled.hint("merge"), ["host", "path"]).join(nodes.select("node", "component").hint("merge"), "node", "left").join(hit.hint("merge"), "component", "left")
    decided = decided.select("url", "host", "path", "rule", F.coalesce("decision", F.when(F.coalesce("reached", F.lit(False)), "block").otherwise("allow")).alias("verdict"), "component")
    out = own.join(decided.hint("merge"), "url", "left")
    return out.select("page_id", F.coalesce("host", F.lit("")).alias("host"), F.coalesce("path", F.lit("")).alias("path"), "rule", F.coalesce("verdict", F.lit("allow")).alias("verdict"), "component")


def _sql_form(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN {_sql_host(url)} || regexp_extract(substr({url}, strpos({url}, '://') + 3), '^[^/?#]*([^#]*)', 1) END"


def _sql_host(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN translate(regexp_extract(substr({url}, strpos({url}, '://') + 3), '^([^/?#]*)', 1), '{_UPPER}', '{_LOWER}') ELSE '' END"


def _sql_path(url: str) -> str:
    return f"CASE WHEN strpos({url}, '://') > 0 THEN regexp_extract(substr({url}, strpos({url}, '://') + 3), '^[^/?#]*([^?#]*)', 1) ELSE '' END"


def _sql_value(name: str) -> str:
    """First attribute of a name: its piece of the tag without quotes, entities decoded."""
    piece = f"list_filter(pieces, lambda p: lower(regexp_extract(p, '^[^\\t\\n\\f\\r =]+')) = '{name}')[1]"
    raw = f"regexp_replace({piece}, '^[^=]*={_SPACE}*', '')"
    out = f"CASE WHEN left({raw}, 1) IN (chr(34), chr(39)) THEN substr({raw}, 2, len({raw}) - 2) ELSE {raw} END"
    for entity, char in ENTITIES:
        out = f"replace({out}, '{entity}', chr({ord(char)}))"
    return out


#: The same results in SQL.
SQL = rf"""
WITH RECURSIVE tag AS (SELECT url, unnest(regexp_extract_all(html, '(?i)<(?:link|meta)[\t\n\f\r /](?:"[^"]*"|''[^'']*''|[^>"''])*>')) AS tag FROM pages WHERE url IS NOT NULL),
piece AS (SELECT url, regexp_extract_all(tag, '[^\t\n\f\r "''<>/=]+{_SPACE}*={_SPACE}*(?:"[^"]*"|''[^'']*''|[^\t\n\f\r "''>]+)') AS pieces FROM tag),
v AS (SELECT url, {_sql_value("rel")} AS rel, trim({_sql_value("href")}) AS href, lower({_sql_value("http-equiv")}) AS equiv, {_sql_value("content")} AS content FROM piece),
w AS (SELECT *, regexp_extract(content, '(?is)^[^;]*;{_SPACE}*url{_SPACE}*={_SPACE}*(.*?){_SPACE}*$', 1) AS asked FROM v),
a AS (SELECT url, CASE WHEN regexp_matches(lower(rel), '(^|{_SPACE})canonical($|{_SPACE})') THEN href
        WHEN equiv = 'refresh' THEN trim(CASE left(asked, 1) WHEN chr(34) THEN string_split(asked, chr(34))[2] WHEN chr(39) THEN string_split(asked, chr(39))[2] ELSE asked END) END AS target FROM w),
f AS (SELECT url, target, regexp_extract(url, '^((?:.|\n)*?://[^/?#]*)', 1) AS origin, regexp_replace({_sql_path("url")}, '[^/]*$', '') AS folder FROM a WHERE target <> ''),
tied AS (SELECT url, CASE WHEN regexp_matches(target, '^[A-Za-z][A-Za-z0-9+.-]*://') THEN target WHEN target LIKE '//%' THEN string_split(url, '://')[1] || ':' || target
        WHEN target LIKE '/%' THEN origin || target ELSE origin || CASE WHEN folder = '' THEN '/' ELSE folder END || target END AS target FROM f),
urls AS (SELECT url, {_sql_host("url")} AS host, {_sql_path("url")} AS path, {_sql_form("url")} AS node FROM (SELECT url FROM pages WHERE url IS NOT NULL UNION SELECT target FROM tied)),
rules(decision, h, p) AS (VALUES {", ".join(f"('{d}', '{h}', '{p}')" for d, h, p in RULES)}),
ruled AS (SELECT url, max_by(h || p, len(h || p)) AS rule, max_by(decision, len(h || p)) AS decision FROM urls JOIN rules ON (host = h OR ends_with(host, '.' || h)) AND starts_with(path, p) GROUP BY url),
e AS (SELECT {_sql_form("url")} AS u, {_sql_form("target")} AS v FROM tied),
edges AS (SELECT u, v FROM e WHERE u <> v UNION SELECT v, u FROM e WHERE u <> v),
reach(node, other) AS (SELECT u, u FROM edges UNION SELECT reach.node, edges.v FROM reach JOIN edges ON reach.other = edges.u),
labels AS (SELECT node, min(other) AS label FROM reach GROUP BY node),
n AS (SELECT urls.*, rule, decision, coalesce(label, node) AS component FROM urls LEFT JOIN ruled USING (url) LEFT JOIN labels USING (node)),
hit AS (SELECT component, max(decision = 'block') AS reached FROM n GROUP BY component)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule, coalesce(decision, CASE WHEN reached THEN 'block' ELSE 'allow' END) AS verdict, component
FROM pages LEFT JOIN n USING (url) LEFT JOIN hit USING (component)
"""
