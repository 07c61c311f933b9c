"""Repair of conversation structure by aligning turns to the grammar of roles.

A repaired conversation's role initials are nothing, or an optional `s` and then one `ua` or more. Turns
have a first fault: blank (no word), duplicate (role and text seen earlier in the conversation) or
truncated (does not end in `.`, `!` or `?`). Blank and duplicate turns have to go.

Edits: Keep 0, Rerole to user or assistant 2, Delete 3, Insert an empty user or assistant turn 2; a
truncated turn that stays adds 1. The cheapest edits are found by Wagner-Fischer tables, one for each
feasible length of the grammar string: lengths come in the order of their lower bounds, a table is
cut to the Ukkonen band that the best cost so far allows, and lengths that cannot reach it are left out. Each
table is traced for its ASCII-least audit (D < I < K < R), and the audits of equal cost are compared.
Conversations beyond `LONG` turns use the same table folded by the period of the grammar: what is
still to pay depends on the place in the target only through the role expected there.

Only one byte a turn goes into an alignment. Texts are read in sorted streams, turn by turn, and are never
gathered: the audit of a conversation comes first and its turns are edited as they pass. A
conversation is one stream of one task, since its audit and its hash are one sequence each.

Defined results: turns are ordered by turn (NULL first), role, a hash of role and text; equal turns are
interchangeable; NULL role or text is one space; NULL conv_id is a conversation like others; without turns
a conversation has zeros, an empty audit and no repaired turns.
"""
from __future__ import annotations

import hashlib
from array import array
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm import base

RETAG, DELETE, INSERT, CUT = 2, 3, 2, 1
LONG = 256
_ROLES = {"s": 0, "u": 1, "a": 2}
_OTHER, _GONE, _SHORT = 3, 4, 8  # code of a turn: role, must be deleted, truncated
_FAR = 1 << 60
_MOST = (1 << 63) - 1


def _pay(shift: int) -> int:
    """Least cost of coming `shift` places ahead of the turns in the target."""
    return INSERT * shift if shift > 0 else -DELETE * shift


def _target(length: int) -> list[int]:
    return [0] * (length % 2) + [1, 2] * (length // 2)


def _align(codes: bytes, length: int, most: int) -> tuple[int, str] | None:
    """Cheapest edits to the grammar string of `length` and their ASCII-least audit, if they cost `most` or less."""
    n, target = len(codes), _target(length)
    if _pay(length - n) > most:
        return None
    low = high = max(0, length - n) if length > n else 0
    while _pay(low - 1) + _pay(length - n - low + 1) <= most and low - 1 >= -n:
        low -= 1
    while _pay(high + 1) + _pay(length - n - high - 1) <= most and high + 1 <= length:
        high += 1
    width = high - low + 1
    left = [[_FAR] * (width + 2) for _ in range(n + 1)]  # left[i][j - i - low]: still to pay; borders are out of reach
    for i in range(n, -1, -1):
        row, after = left[i], left[i + 1] if i < n else None
        code = codes[i] if i < n else 0
        for k in range(width - 1, -1, -1):
            j = i + low + k
            if not 0 <= j <= length:
                continue
            best = 0 if i == n and j == length else _FAR
            if i < n:
                if k:
                    best = min(best, DELETE + after[k - 1])
                if j < length and not code & _GONE:
                    best = min(best, _stay(code, target[j]) + after[k])
            if j < length and target[j] and k + 1 < width:
                best = min(best, INSERT + row[k + 1])
            row[k] = best
    cost = left[0][-low] if low <= 0 <= high else _FAR
    if cost > most:
        return None
    out, i, j = [], 0, 0
    while i < n or j < length:
        k = j - i - low
        now = left[i][k]
        if i < n and k and DELETE + left[i + 1][k - 1] == now:
            out.append("D")
            i += 1
        elif j < length and target[j] and k + 1 < width and INSERT + left[i][k + 1] == now:
            out.append("I")
            j += 1
        else:
            out.append("K" if codes[i] & 3 == target[j] else "R")
            i, j = i + 1, j + 1
    return cost, "".join(out)


def _stay(code: int, wanted: int) -> int:
    """Cost of a turn that stays in a place of the target."""
    if code & 3 == wanted:
        return CUT if code & _SHORT else 0
    return _FAR if not wanted else RETAG + (CUT if code & _SHORT else 0)


def _folded(codes: bytes) -> tuple[int, str]:
    """The same over all lengths at once: places 0 (nothing yet), 1 (after s), 2 (after u), 3 (after a)."""
    n = len(codes)
    left = [array("q", [_FAR]) * (n + 1) for _ in range(4)]
    for place in (0, 3):
        left[place][n] = 0
    steps = {0: ((0, 1), (1, 2)), 1: ((1, 2),), 2: ((2, 3),), 3: ((1, 2),)}  # place -> (role, next place)
    for i in range(n, -1, -1):
        if i < n:
            code = codes[i]
            for place in range(4):
                best = DELETE + left[place][i + 1]
                if not code & _GONE:
                    for role, to in steps[place]:
                        best = min(best, _stay(code, role) + left[to][i + 1])
                left[place][i] = min(best, _FAR)
        for place, to in ((2, 3), (3, 2), (2, 3), (0, 2), (1, 2)):
            left[place][i] = min(left[place][i], INSERT + left[to][i])
    out, i, place = [], 0, 0
    while i < n or left[place][i]:
        now, to = left[place][i], 3 if place == 2 else 2
        if i < n and DELETE + left[place][i + 1] == now:
            out.append("D")
            i += 1
        elif INSERT + left[to][i] == now:
            out.append("I")
            place = to
        else:
            for role, to in steps[place]:
                if _stay(codes[i], role) + left[to][i + 1] == now:
                    out.append("K" if codes[i] & 3 == role else "R")
                    i, place = i + 1, to
                    break
    return left[0][0], "".join(out)


@lru_cache(maxsize=20_000)
def _cheapest(codes: bytes) -> tuple[int, str]:
    n = len(codes)
    stay = n - sum(bool(c & _GONE) for c in codes)
    least = DELETE * (n - stay)
    best = (DELETE * n, "D" * n)
    lengths = [m for m in range(2, 2 * n + 4)]
    for bound, m in sorted((least + _pay(m - stay), m) for m in lengths):
        if bound > best[0]:
            break
        found = _align(codes, m, best[0])
        if found and found < best:
            best = found
    return best


def cheapest(codes: bytes) -> tuple[int, str]:
    """Cost and audit of the cheapest edits of turns given by their codes."""
    return _cheapest(codes) if len(codes) <= LONG else _folded(codes)


def _spaced(column: str) -> F.Column:
    return F.coalesce(F.col(column).cast("string"), F.lit(" "))


def _same() -> F.Column:
    return F.sha2(F.concat(F.octet_length("role").cast("string"), F.lit(":"), F.col("role"), F.col("text")), 256)


def given(conversations: DataFrame) -> DataFrame:
    """conv_id, turn, role, text; NULL role or text is one space."""
    return conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), _spaced("role").alias("role"), _spaced("text").alias("text"))


def damage(turns: DataFrame) -> DataFrame:
    """`given` turns with faults put in by crc32 of `conv_id:turn` modulo 20, and `there`: false for a turn that is dropped."""
    kind = F.crc32(F.encode(F.concat(_spaced("conv_id"), F.lit(":"), _spaced("turn")), "UTF-8")) % 20
    hit = turns.withColumn("kind", kind)
    text = F.when(F.col("kind") == 1, "").when(F.col("kind") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    times = F.explode(F.when(F.col("kind") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return hit.select("conv_id", "turn", F.when(F.col("kind") == 4, "user").otherwise(F.col("role")).alias("role"), text.alias("text"), (F.col("kind") != 0).alias("there"), times.alias("time")).drop("time")


_ORDER = ["turn", "role", "same"]  # NULL turns first
_FACTS = [("gaps", pa.int64()), ("blank", pa.int64()), ("duplicate", pa.int64()), ("truncated", pa.int64()), ("illegal", pa.int64()), ("cost", pa.int64()), ("audit", pa.string())]
_FACTS_ARROW = pa.schema([("conv_id", pa.int64()), *_FACTS])
_FACTS_SQL = "conv_id long, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string"


def _facts(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Conversations of a sorted stream: faults, and the cheapest edits."""
    def done(conv: int | None, turns: list, codes: bytearray, counts: list[int]) -> dict:
        cost, audit = cheapest(bytes(codes))
        low, high, distinct = turns
        gaps = min(high - low + 1 - distinct, _MOST) if distinct else 0
        return {"conv_id": conv, "gaps": gaps, "blank": counts[0], "duplicate": counts[1], "truncated": counts[2], "illegal": counts[3], "cost": cost, "audit": audit}

    def rows() -> Iterator[dict]:
        state, conv = None, None
        for conv_id, turn, role, there, blank, nth, ends in base.rows_of(batches, "conv_id", "turn", "initial", "there", "blank", "nth", "ends"):
            if state is None or conv_id != conv:
                if state is not None:
                    yield done(conv, *state)
                conv, turns, codes, counts, before = conv_id, [None, None, 0], bytearray(), [0, 0, 0, 0], None
                state = (turns, codes, counts)
            if not there:
                continue
            if turn is not None and turn != turns[1]:
                turns[0] = turn if turns[0] is None else turns[0]
                turns[1], turns[2] = turn, turns[2] + 1
            fault = 0 if blank else 1 if nth > 1 else 2 if not ends else None
            if fault is not None:
                counts[fault] += 1
            role = role.decode()
            if before is not None and before + role not in ("su", "ua", "au"):
                counts[3] += 1
            before = role
            codes.append(_ROLES.get(role, _OTHER) | (_GONE if fault in (0, 1) else _SHORT if fault == 2 else 0))
        if state is not None:
            yield done(conv, *state)
    return base.batched(rows(), _FACTS_ARROW)


def plan(turns: DataFrame) -> DataFrame:
    """Per conversation of turns (conv_id, turn, role, text, there): faults, cost and audit."""
    small = turns.select("conv_id", "turn", "role", _same().alias("same"), "there", F.substring("role", 1, 1).alias("initial"), (~F.col("text").rlike(r"[^\x20\x09-\x0D]")).alias("blank"), F.col("text").rlike(r"[.!?][\x20\x09-\x0D]*\z").alias("ends"))
    seen = Window.partitionBy("conv_id", "there", "same").orderBy("turn")
    ranked = small.repartition("conv_id").withColumn("nth", F.row_number().over(seen))
    return ranked.sortWithinPartitions("conv_id", *_ORDER, "nth").mapInArrow(_facts, _FACTS_SQL)


def _edit(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    """From a stream with each conversation's audit before its turns: (conv_id, facts or None, role, text, edit), facts at its start."""
    conv, audit, at, role = None, "", 0, "assistant"

    def inserted() -> Iterator[tuple]:
        nonlocal at, role
        while at < len(audit) and audit[at] == "I":
            at, role = at + 1, "assistant" if role == "user" else "user"
            yield conv, None, role, b"", "I"

    for row in base.rows_of(batches, "conv_id", "kind", "role", "text", *(name for name, _ in _FACTS)):
        if row[1] == 0:
            yield from inserted()
            conv, audit, at, role = row[0], row[-1].decode(), 0, "assistant"
            yield conv, row[4:], None, None, None
            continue
        yield from inserted()
        edit = audit[at]
        at += 1
        if edit != "D":
            own = row[2].decode()
            role = own if edit == "K" else "assistant" if role[:1] == "u" else "user"
            yield conv, None, role, row[3], edit
            role = {"u": "user", "a": "assistant"}.get(role[:1], role)
    yield from inserted()


def _stream(turns: DataFrame, plans: DataFrame) -> DataFrame:
    names = [name for name, _ in _FACTS]
    rows = turns.filter("there").select("conv_id", F.lit(1).alias("kind"), "turn", "role", _same().alias("same"), "text", *[F.lit(None).cast("string" if n == "audit" else "long").alias(n) for n in names])
    heads = plans.select("conv_id", F.lit(0).alias("kind"), F.lit(None).cast("long").alias("turn"), F.lit("").alias("role"), F.lit("").alias("same"), F.lit("").alias("text"), *names)
    return rows.unionByName(heads).repartition("conv_id").sortWithinPartitions("conv_id", "kind", *_ORDER).drop("turn", "same")


def _digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        head, hashed = None, None
        for conv_id, facts, role, text, _edit_made in _edit(batches):
            if facts is not None:
                if head:
                    yield head | {"repaired_sha256": hashed.hexdigest()}
                values = [v.decode() if isinstance(v, bytes) else v for v in facts]
                head, hashed, first = {"conv_id": conv_id, **dict(zip((n for n, _ in _FACTS), values, strict=True))}, hashlib.sha256(), True
                continue
            hashed.update((b"" if first else b"\n") + role.encode() + b":" + text)
            first = False
        if head:
            yield head | {"repaired_sha256": hashed.hexdigest()}
    return base.batched(rows(), pa.schema([*_FACTS_ARROW, ("repaired_sha256", pa.string())]))


def _turns(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    def rows() -> Iterator[dict]:
        place = 0
        for conv_id, facts, role, text, edit in _edit(batches):
            place = 0 if facts is not None else place + 1
            if facts is None:
                yield {"conv_id": conv_id, "place": place - 1, "role": role, "text": text.decode(), "edit": edit}
    return base.batched(rows(), pa.schema([("conv_id", pa.int64()), ("place", pa.int64()), ("role", pa.string()), ("text", pa.string()), ("edit", pa.string())]))


def _planned(turns: DataFrame) -> DataFrame:
    work = base.new_work(turns.sparkSession)
    return base.materialize(plan(turns), f"{work}/plans")


def repair(conversations: DataFrame) -> DataFrame:
    """The repaired turns: conv_id, place, role, text, edit (K, R or I)."""
    turns = given(conversations).withColumn("there", F.lit(True))
    return _stream(turns, _planned(turns)).mapInArrow(_turns, "conv_id long, place long, role string, text string, edit string")


def digest(conversations: DataFrame) -> DataFrame:
    """Damaged conversations after repair: faults, cost, audit and a hash of the repaired turns."""
    base.small_batches(conversations.sparkSession)
    turns = damage(given(conversations))
    return _stream(turns, _planned(turns)).mapInArrow(_digest, _FACTS_SQL + ", repaired_sha256 string")


def _sql_least(*options: str) -> str:
    return f"list_min([{', '.join(options)}])"


def _sql_edit(state: str, cost: str, audit: str, piece: str) -> str:
    return f"{{'c': {state}.c + {cost}, 'a': {state}.a || {audit}, 'r': {state}.r || {piece}}}"


def _sql_insert(state: str, role: str) -> str:
    return _sql_edit(state, str(INSERT), "'I'", rf"chr(10) || '{role}:'")


def _sql_stay(state: str, initial: str) -> str:
    role = {"s": "x.role", "u": "'user'", "a": "'assistant'"}[initial]
    price = f"CASE WHEN x.must THEN 1000000000 WHEN x.i1 = '{initial}' THEN 0 ELSE {RETAG if initial != 's' else 1000000000} END + CASE WHEN x.short THEN {CUT} ELSE 0 END"
    same = f"x.i1 = '{initial}'"
    return _sql_edit(state, f"({price})", f"CASE WHEN {same} THEN 'K' ELSE 'R' END", f"chr(10) || CASE WHEN {same} THEN x.role ELSE {role} END || ':' || x.text")


#: digest() in SQL: one row of a conversation a step, the cheapest edits so far for each place of the grammar.
SQL = rf"""
WITH RECURSIVE bits AS (SELECT list_transform(range(256), lambda b: list_reduce(list_prepend(b, range(8)), lambda c, i: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END)) AS tab),
g AS (SELECT conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text,
  xor(list_reduce(list_prepend(4294967295::BIGINT, list_transform(regexp_extract_all(hex(encode(coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' '))), '..'), lambda x: ('0x' || x)::BIGINT)), lambda c, b: xor(c // 256, tab[xor(c % 256, b) + 1])), 4294967295) % 20 AS kind FROM conversations, bits),
d AS (SELECT conv_id, turn, CASE WHEN kind = 4 THEN 'user' ELSE role END AS role, CASE kind WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(range(CASE kind WHEN 0 THEN 0 WHEN 3 THEN 2 ELSE 1 END)) AS time FROM g),
n AS (SELECT *, row_number() OVER (PARTITION BY conv_id, role, text ORDER BY turn NULLS FIRST) AS nth, sha256(octet_length(encode(role)) || ':' || role || text) AS same, trim(text, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS bare FROM d),
f AS (SELECT conv_id, turn, role, text, left(role, 1) AS i1, bare = '' AS blank, bare <> '' AND nth > 1 AS twice, bare <> '' AND nth = 1 AND right(bare, 1) NOT IN ('.', '!', '?') AS short,
  row_number() OVER w AS i, lag(left(role, 1)) OVER w AS i0 FROM n WINDOW w AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, same, nth)),
m AS (SELECT conv_id, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (blank) AS blank, count(*) FILTER (twice) AS duplicate, count(*) FILTER (short) AS truncated,
  count(*) FILTER (i > 1 AND (i0 || i1) NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY conv_id),
x AS (SELECT conv_id, i, role, text, i1, short, blank OR twice AS must FROM f),
step AS (
  SELECT conv_id, 0 AS i, {{'c': 0, 'a': '', 'r': ''}} AS s0, {{'c': 1000000000, 'a': '', 'r': ''}} AS s1, {{'c': {INSERT}, 'a': 'I', 'r': chr(10) || 'user:'}} AS s2, {{'c': {2 * INSERT}, 'a': 'II', 'r': chr(10) || 'user:' || chr(10) || 'assistant:'}} AS s3 FROM (SELECT DISTINCT conv_id FROM conversations)
  UNION ALL
  SELECT conv_id, i, s0, s1, {_sql_least("t2", _sql_insert("t3", "user"))} AS s2, t3 AS s3 FROM (
    SELECT conv_id, i, s0, s1, t2, {_sql_least("s3", _sql_insert("t2", "assistant"))} AS t3 FROM (
      SELECT conv_id, i, s0, s1, s3, {_sql_least("s2", _sql_insert("s0", "user"), _sql_insert("s1", "user"), _sql_insert("s3", "user"))} AS t2 FROM (
        SELECT x.conv_id, x.i, {_sql_edit("b.s0", str(DELETE), "'D'", "''")} AS s0, {_sql_least(_sql_edit("b.s1", str(DELETE), "'D'", "''"), _sql_stay("b.s0", "s"))} AS s1,
          {_sql_least(_sql_edit("b.s2", str(DELETE), "'D'", "''"), *[_sql_stay(f"b.{s}", "u") for s in ("s0", "s1", "s3")])} AS s2, {_sql_least(_sql_edit("b.s3", str(DELETE), "'D'", "''"), _sql_stay("b.s2", "a"))} AS s3
        FROM step b JOIN x ON x.conv_id IS NOT DISTINCT FROM b.conv_id AND x.i = b.i + 1)))),
e AS (SELECT conv_id, {_sql_least("s0", "s3")} AS best, row_number() OVER (PARTITION BY conv_id ORDER BY i DESC) AS back FROM step)
SELECT e.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0)::BIGINT AS blank, coalesce(duplicate, 0)::BIGINT AS duplicate, coalesce(truncated, 0)::BIGINT AS truncated, coalesce(illegal, 0)::BIGINT AS illegal,
  best.c::BIGINT AS cost, best.a AS audit, sha256(best.r[2:]) AS repaired_sha256 FROM e LEFT JOIN m ON e.conv_id IS NOT DISTINCT FROM m.conv_id WHERE back = 1
"""
