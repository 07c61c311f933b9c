"""Prompt quote expressions: safe to show, typo density, heat, cryptic score."""
from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, functions as F

from loomtrace import dims
from loomtrace.functions.text import any_word, strip_blank, word_count


def tokens(c: Column) -> Column:
    return F.filter(F.split(c, r"(?U)\s+"), lambda t: t != "")


def safe_quote(c: Column) -> Column:
    """Short, no system marker, no secret, no over-long token, no contact data."""
    toks = tokens(c)
    lone_id = (F.size(toks) == 1) & F.exists(
        toks, lambda t: t.rlike(r"^[A-Z0-9]*[0-9][A-Z0-9]*$") & (F.length(t) >= 7))
    return F.coalesce(
        (c != "") & (F.length(c) <= 140)
        & ~c.rlike("(?iU)" + "|".join(dims.SYSTEM_MARKERS))
        & ~c.rlike("(?i)" + dims.SECRET_PATTERN)
        & ~F.exists(toks, lambda t: F.length(t) > 32)
        & ~lone_id
        & ~c.rlike("(?iU)" + dims.CONTACT_PATTERN), F.lit(False))


def typo_score(c: Column) -> Column:
    """Number of tokens that look mistyped or texted, each token counted once."""
    toks = F.regexp_extract_all(F.lower(c), F.lit("[a-z0-9']+"), F.lit(0))

    def odd(t: Column) -> Column:
        return (
            t.isin(dims.TYPO_WORDS)
            | ((F.length(t) >= 4) & ~t.rlike("[aeiou]"))
            | t.rlike(r"(.)\1\1")
            | t.rlike(r"[a-z][0-9]|[0-9][a-z]")
        )

    return F.size(F.filter(toks, odd)).cast("bigint")


def caps_ratio(c: Column) -> Column:
    letters = F.regexp_count(c, F.lit(r"\p{L}"))
    upper = F.regexp_count(c, F.lit(r"\p{Lu}"))
    return F.when(letters > 0, upper.cast("double") / letters).otherwise(F.lit(0.0))


def has_rage(c: Column) -> Column:
    return c.rlike(any_word(dims.RAGE_WORDS))


def bang_count(c: Column) -> Column:
    return F.regexp_count(c, F.lit("[!?]"))


def heat_score(c: Column, hour: Column | None = None) -> Column:
    """How heated a prompt reads: capitals, brevity, shouting, frustration, night hours."""
    shouted = F.least(F.regexp_count(c, F.lit(r"(?U)\b[A-Z]{3,}\b")), F.lit(4))
    rage = F.least(F.regexp_count(c, F.lit(any_word(dims.RAGE_WORDS))), F.lit(3))
    bangs = F.least(bang_count(c), F.lit(5))
    brevity = F.greatest(F.lit(0), F.lit(9) - word_count(c)) * F.lit(0.5)
    night = F.lit(0.0) if hour is None else F.when((hour >= 2) & (hour < 6), 1.8).otherwise(0.0)
    return (caps_ratio(c) * 2.5 + brevity + shouted * F.lit(0.4) + rage * F.lit(0.5)
            + bangs * F.lit(0.3) + night)


def cryptic_score(c: Column) -> Column:
    """How terse, vague and mistyped a prompt reads."""
    vague = F.regexp_count(c, F.lit(any_word(dims.VAGUE_WORDS)))
    lower = F.when(c == F.lower(c), 1).otherwise(0)
    unpunctuated = F.when(strip_blank(c).rlike("[.?!]"), 0).otherwise(1)
    short = F.greatest(F.lit(0), F.lit(7) - word_count(c)) * F.lit(0.25)
    emoticon = F.when(c.rlike("(?i)" + dims.EMOTICON_PATTERN), 1.6).otherwise(0.0)
    feeling = F.when(c.rlike(any_word(dims.FEELING_WORDS)), 1.3).otherwise(0.0)
    return (typo_score(c) * F.lit(1.0) + vague * F.lit(0.55) + lower * F.lit(0.5)
            + unpunctuated * F.lit(0.35) + short + emoticon + feeling)


def cryptic_candidate(c: Column) -> Column:
    """3-14 words, not all filler, score at least 1.8, safe to show."""
    words = F.regexp_extract_all(F.lower(c), F.lit("[a-z']+"), F.lit(0))
    wc = word_count(c)
    return (safe_quote(c) & wc.between(3, 14) & (F.size(words) > 0)
            & ~F.forall(words, lambda w: w.isin(dims.FILLER_WORDS))
            & (cryptic_score(c) >= 1.8))


def heat_candidate(c: Column, hour: Column | None = None) -> Column:
    """At least 6 letters, at most 16 words, negative or shouting, score at least 2.0."""
    return (safe_quote(c) & (F.regexp_count(c, F.lit(r"\p{L}")) >= 6) & (word_count(c) <= 16)
            & (has_rage(c) | (bang_count(c) >= 2)) & (heat_score(c, hour) >= 2.0))


def phrase_key(c: Column) -> Column:
    """Normal form of a short prompt for repetition counts."""
    squeezed = F.regexp_replace(F.lower(strip_blank(c)), r"(?U)\s+", " ")
    return F.regexp_replace(squeezed, r"^[?.!, ]+|[?.!, ]+$", "")
