"""Prompt text expressions: injected wrappers, commands, line counts, shell commands."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from loomtrace import dims


def strip_blank(c: Column) -> Column:
    """Trim every kind of white space (Spark's trim removes spaces only)."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def any_word(words: list[str]) -> str:
    return r"(?iU)\b(" + "|".join(words) + r")\b"


def strip_injections(c: Column) -> Column:
    cleaned = reduce(
        lambda acc, tag: F.regexp_replace(acc, f"(?s)<{tag}>.*?</{tag}>", ""),
        dims.INJECTED_TAGS, c)
    return strip_blank(cleaned)


def is_command_text(c: Column) -> Column:
    return c.contains("<command-name>") | F.regexp_replace(c, r"(?U)^\s+", "").startswith("<local-command")


def line_count(c: Column) -> Column:
    """Lines of a text: newlines, plus one when the last line is not terminated."""
    newlines = F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))
    return F.when(c.isNull() | (c == ""), F.lit(0)).otherwise(
        newlines + F.when(c.endswith("\n"), 0).otherwise(1)).cast("bigint")


def newline_count(c: Column) -> Column:
    return (F.length(c) - F.length(F.replace(c, F.lit("\n"), F.lit("")))).cast("bigint")


def word_count(c: Column) -> Column:
    return F.size(F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")).cast("bigint")


def is_polite(c: Column) -> Column:
    return c.rlike(any_word(dims.POLITE_WORDS))


def tag_text(c: Column, tag: str) -> Column:
    """Trimmed text of the first <tag>…</tag>, NULL when absent."""
    pattern = f"(?s)<{tag}>(.*?)</{tag}>"
    return F.when(c.rlike(pattern), strip_blank(F.regexp_extract(c, pattern, 1)))


# ---- shell commands ----------------------------------------------------------------
def argv_command(c: Column) -> Column:
    """A command given as a JSON list is joined with ' && ' so both spellings read alike."""
    as_list = F.from_json(c, "array<string>")
    return F.when(c.isNull(), F.lit("")).when(
        c.startswith("[") & as_list.isNotNull(), F.array_join(as_list, " && ")).otherwise(c)


def runs_tests(c: Column) -> Column:
    return F.coalesce(c.rlike(dims.TEST_COMMAND), F.lit(False))


def runs_knowledge(c: Column) -> Column:
    return F.coalesce(c.rlike(dims.KNOWLEDGE_COMMAND), F.lit(False))


def writes_file(c: Column) -> Column:
    return F.coalesce(reduce(lambda a, b: a | b, [c.rlike(p) for p in dims.SHELL_WRITE_PATTERNS]), F.lit(False))


def cli_heads(c: Column) -> Column:
    """Known command heads, one per pipeline part, leading VAR=value tokens skipped."""
    parts = F.split(c, dims.SHELL_SPLIT_PATTERN)

    def head(part: Column) -> Column:
        # the first token that is no assignment; nothing but assignments: none
        tokens = F.filter(F.split(part, r"\s+"), lambda t: (t != "") & (~t.contains("=") | t.startswith("-")))
        return F.coalesce(F.element_at(F.split(F.get(tokens, F.lit(0)), "/"), -1), F.lit(""))

    heads = F.transform(parts, head)
    return F.filter(heads, lambda h: h.isin(dims.KNOWN_CLIS))


# ---- codex prompt filter -----------------------------------------------------------
def is_codex_injected(c: Column) -> Column:
    lead = F.regexp_replace(c, r"(?U)^\s+", "")
    starts = reduce(lambda a, b: a | b, [lead.startswith(p) for p in dims.CODEX_INJECTED_PREFIXES])
    return F.coalesce(
        starts | lead.startswith(dims.CODEX_INJECTED_DOC)
        | F.lower(strip_blank(c)).isin(dims.CODEX_PROBES), F.lit(False))


def is_local_url(c: Column) -> Column:
    return F.coalesce(
        reduce(lambda a, b: a | b, [F.lower(c).contains(h) for h in dims.LOCAL_URL_HINTS]), F.lit(False))
