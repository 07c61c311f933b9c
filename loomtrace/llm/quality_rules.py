"""Line-first cleaning: rules judge single lines, failing lines go, and a document that loses too
much of its words goes as a whole.

Words are runs of `[^\\x20\\x09-\\x0D]`. A line is judged if it has a word; it fails by
punctuation (neither of its last two words
ends with a closing mark), navigation (separators as a fifth or more of the words,
three at least), symbols (more than half as many of `#*$%&|<>` as words), shouting (a third or
more of three or more words end with `!!`), stutter (more than half the words repeat the one
before) or stock phrases (a fifth or more of its words, so that prose may mention one). Lines
without a word stay as they are and are never counted.

Defined results: a NULL or empty text has no words and fails the base rule; equal rows get equal
results; every column but doc_id and text is passed through untouched.
"""
from __future__ import annotations

import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import base

MIN_WORDS = 50
MAX_REPEAT_PERCENT = 50
MAX_LOST_PERCENT = 30
SEPARATORS = ("|", "»", "›", "·", "•", ">", "::")
PHRASES = ("all rights reserved", "enable javascript", "javascript is disabled", "cookie policy", "uses cookies", "privacy policy", "terms of use", "terms of service",
           "sign up for our newsletter", "subscribe to our", "click here to", "lorem ipsum", "share on facebook", "powered by wordpress", "skip to content")
#: Marks that end a sentence, of scripts beside Latin too (Armenian, Arabic, Urdu, Devanagari, Burmese, Ethiopic, Khmer, CJK).
MARKS = (".", "!", "?", "…", "։", "؟", "۔", "।", "॥", "။", "።", "፧", "។", "。", "．", "！", "？", "｡")
_END = re.compile(f"(?:{'|'.join(map(re.escape, MARKS))})(?:[\"')\\]]|”|’|»)*(?:[\\x20\\x09-\\x0D]+[^\\x20\\x09-\\x0D]+)?[\\x20\\x09-\\x0D]*\\Z".encode())
_SEPARATORS = frozenset(s.encode() for s in SEPARATORS)
_PHRASES = re.compile("|".join(PHRASES).encode())
_SYMBOLS = np.frombuffer(b"#*$%&|<>", np.uint8)
_SYMBOL_BYTES = re.compile(rb"[#*$%&|<>]")
_SPACES = np.array([9, 10, 11, 12, 13, 32])


def line_fails(line: bytes, words: list[bytes]) -> bool:
    n = len(words)
    if not _END.search(line):
        return True
    cut = sum(w in _SEPARATORS for w in words)
    if cut >= 3 and 5 * cut >= n:
        return True
    if 2 * len(_SYMBOL_BYTES.findall(line)) > n:
        return True
    if n >= 3 and 3 * sum(w.endswith(b"!!") for w in words) >= n:
        return True
    if 2 * sum(map(bytes.__eq__, words, words[1:])) > n:
        return True
    return 5 * sum(len(p.split()) for p in _PHRASES.findall(line.lower())) >= n


def clean(text: bytes) -> tuple[bytes, int]:
    """The text without its failing lines, and the number of words lost."""
    kept, lost = [], 0
    for line in text.split(b"\n"):
        words = line.split()
        if words and line_fails(line, words):
            lost += len(words)
        else:
            kept.append(line)
    return b"\n".join(kept), lost


def measures(text: bytes, memo: base.WordHashes) -> tuple[int, int, int, int, int]:
    """n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words."""
    words = text.split()
    seen = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    chars = int(seen.sum() - seen[128:192].sum() - seen[_SPACES].sum())
    lines = [x for x in text.split(b"\n") if x.strip()]
    h = base.rolling(memo.of(words), 3)
    repeated = 0
    if len(h):
        order = np.argsort(h)
        first = base.runs(h[order])
        size = base.run_lengths(first, len(h))
        twice = order[np.repeat(size > 1, size)]
        covered = np.zeros(len(words), bool)
        for k in range(3):
            covered[twice + k] = True
        repeated = int(covered.sum())
    return len(words), chars, int(seen[_SYMBOLS].sum()), len(lines) - len(set(lines)), repeated


def verdict(n_words: int, n_repeat_words: int, lost: int) -> tuple[bool, bool]:
    """base_failed, kept."""
    failed = n_words < MIN_WORDS or 100 * n_repeat_words > MAX_REPEAT_PERCENT * n_words
    return failed, not failed and 100 * lost <= MAX_LOST_PERCENT * n_words


_DIGEST = "doc_id long, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long, n_lost long, base_failed boolean, kept boolean"


def digest(docs: DataFrame) -> DataFrame:
    """Per row: the measures, the words lost to line rules, base_failed and kept."""
    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        memo = base.WordHashes()

        def rows() -> Iterator[dict]:
            for doc_id, text in base.rows_of(batches, "doc_id", "text"):
                text = text or b""
                n, chars, symbols, dup, rep = measures(text, memo)
                lost = clean(text)[1]
                failed, kept = verdict(n, rep, lost)
                yield {"doc_id": doc_id, "n_words": n, "word_chars": chars, "n_symbols": symbols, "n_dup_lines": dup, "n_repeat_words": rep, "n_lost": lost, "base_failed": failed, "kept": kept}

        kinds = {"long": pa.int64(), "boolean": pa.bool_()}
        return base.batched(rows(), pa.schema([(n, kinds[k]) for n, k in (c.split() for c in _DIGEST.split(", "))]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(judge, _DIGEST)


def filter_documents(docs: DataFrame) -> DataFrame:
    """Kept documents with all their columns; failing lines are gone from `text`. No shuffle."""
    base.small_batches(docs.sparkSession)

    @F.arrow_udf("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        memo, out = base.WordHashes(), []
        for t in base.text_bytes(texts):
            t = t or b""
            n, _, _, _, rep = measures(t, memo)
            left, lost = clean(t)
            out.append(left.decode() if verdict(n, rep, lost)[1] else None)
        return pa.array(out, pa.string())

    new = base.fresh(docs, "cleaned")
    # taken as not deterministic: else the filter gets a second evaluation of its own
    judged = docs.withColumn(new, cleaned.asNondeterministic()("text")).filter(F.col(new).isNotNull())
    return judged.select(*[F.col(new).alias(c) if c == "text" else F.col(c) for c in docs.columns])


_WORDS = base.SQL_WORDS
#: The same results in SQL.
SQL = rf"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text, row_number() OVER () AS r FROM documents),
w AS (SELECT r, doc_id, text, {_WORDS.format("text")} AS ws FROM d),
g AS (SELECT r, p, [ws[p], ws[p + 1], ws[p + 2]] AS k FROM (SELECT r, ws, unnest(range(1, len(ws) - 1)) AS p FROM w)),
t AS (SELECT r, unnest([p, p + 1, p + 2]) AS p FROM (SELECT r, p, count(*) OVER (PARTITION BY r, k) AS n FROM g) WHERE n > 1),
rep AS (SELECT r, count(DISTINCT p) AS n FROM t GROUP BY r),
l AS (SELECT r, l, {_WORDS.format("l")} AS ws FROM (SELECT r, unnest(string_split(text, chr(10))) AS l FROM d)),
lw AS (SELECT r, l, ws, len(ws) AS n, len(list_filter(ws, lambda x: x IN ({", ".join(f"'{s}'" for s in SEPARATORS)}))) AS cut FROM l WHERE len(ws) > 0),
f AS (SELECT r, l, n, NOT regexp_matches(l, '[{"".join(MARKS)}]["''”’)\]»]*([\x20\x09-\x0D]+[^\x20\x09-\x0D]+)?[\x20\x09-\x0D]*\z')
        OR cut >= 3 AND 5 * cut >= n
        OR 2 * len(regexp_extract_all(l, '[#*$%&|<>]')) > n
        OR n >= 3 AND 3 * len(list_filter(ws, lambda x: ends_with(x, '!!'))) >= n
        OR 2 * len(list_filter(range(1, n), lambda i: ws[i] = ws[i + 1])) > n
        OR 5 * coalesce(list_sum(list_transform(regexp_extract_all(translate(l, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{"|".join(PHRASES)}'), lambda x: len(string_split(x, ' ')))), 0) >= n AS bad FROM lw),
ln AS (SELECT r, count(*) - count(DISTINCT l) AS dup, coalesce(sum(n) FILTER (WHERE bad), 0)::BIGINT AS lost FROM f GROUP BY r),
m AS (SELECT doc_id, len(ws)::BIGINT AS n_words, length(array_to_string(ws, ''))::BIGINT AS word_chars, len(regexp_extract_all(text, '[#*$%&|<>]'))::BIGINT AS n_symbols,
        coalesce(dup, 0)::BIGINT AS n_dup_lines, coalesce(rep.n, 0)::BIGINT AS n_repeat_words, coalesce(lost, 0)::BIGINT AS n_lost
      FROM w LEFT JOIN ln USING (r) LEFT JOIN rep USING (r))
SELECT *, n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words AS base_failed,
       NOT (n_words < {MIN_WORDS} OR 100 * n_repeat_words > {MAX_REPEAT_PERCENT} * n_words) AND 100 * n_lost <= {MAX_LOST_PERCENT} * n_words AS kept FROM m
"""
