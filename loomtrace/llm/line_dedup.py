"""Line dedup by pairwise alignment.

Documents overlap if they share a line of five words or more, or a run of adjacent lines, as many as reach ten
words. Each document is paired with the earliest holder of each line or run that it shares, whatever the
number of holders, so there are at most as many pairs as shared lines. A pair is aligned by patience diff, and the
aligned common blocks go from the later document (greater doc_id). A shared line
or run that the later document has once and the diff leaves out, since it was moved or the other repeats it, is a
block of its own and goes as well. Documents with equal line sequences are not paired: of each such class only the earliest takes
part, and the others lose all their lines to it.

An earliest holder is sent once to each task that aligns with it, not once to each of its pairs; a holder that
very many documents meet is dealt over tasks.

Lines are compared without white space at their ends; lines without a word are never aligned, and
go with the removed lines around them only if nothing of the document is left.

Defined results: NULL or empty texts have no lines and stay as they are; rows without doc_id
stay as they are; equal rows get equal results and do not delete each other; rows of one doc_id are
never paired with each other.
"""
from __future__ import annotations

import bisect
import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import base

LINE_WORDS, PAIR_WORDS = 5, 10
PER_TASK = 4096  # pairs that meet one copy of their earliest holder
_LINES = "doc_id long, key long, n_lines long, s1 long, s2 long, lines binary, words binary, shared array<long>"


def split_lines(text: bytes) -> list[bytes]:
    return text.split(b"\n")


def _line_hash(line: bytes) -> int:
    return int.from_bytes(hashlib.blake2b(line, digest_size=8).digest(), "little") | 1


def _runs(f: np.ndarray, w: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start places, hashes and lines of the shortest runs of two lines or more that reach `PAIR_WORDS`."""
    h, total, reach = f.copy(), w.astype(np.int64), np.ones(len(f), np.int64)
    for k in range(1, min(PAIR_WORDS, len(f))):  # every line has a word
        on = np.flatnonzero((total[:len(f) - k] < PAIR_WORDS) | (k == 1))
        h[on] = base.mix(h[on], f[on + k])
        total[on] += w[on + k]
        reach[on] += 1
    at = np.flatnonzero((total >= PAIR_WORDS) & (reach > 1))
    return at, h[at], reach[at]


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Hashes of the lines with a word; 0 stands for a line without one."""
    def rows() -> Iterator[dict]:
        for doc_id, key, text in base.rows_of(batches, "doc_id", "key", "text"):
            row = {"doc_id": doc_id, "key": key, "n_lines": 0, "s1": None, "s2": None, "lines": b"", "words": b"", "shared": []}
            stripped = [x.strip() for x in split_lines(text or b"")]
            words = np.array([len(x.split()) for x in stripped])
            h = np.array([_line_hash(x) if x else 0 for x in stripped], np.uint64)
            full = np.flatnonzero(h)
            if len(full) and doc_id is not None:
                f, w = h[full], words[full]
                pairs = _runs(f, w)[1]
                digest = hashlib.blake2b(f.tobytes(), digest_size=16).digest()
                row |= {"n_lines": len(full), "s1": int.from_bytes(digest[:8], "little", signed=True), "s2": int.from_bytes(digest[8:], "little", signed=True), "lines": h.tobytes(), "words": words.astype("<u4").tobytes(),
                        "shared": np.unique(np.concatenate([f[w >= LINE_WORDS], pairs])).view(np.int64).tolist()}
            yield row

    schema = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_lines", pa.int64()), ("s1", pa.int64()), ("s2", pa.int64()), ("lines", pa.binary()), ("words", pa.binary()), ("shared", pa.list_(pa.int64()))])
    return base.batched(rows(), schema, 2000)


def patience(a: list[int], b: list[int]) -> list[tuple[int, int]]:
    """Aligned places of two line sequences: equal heads and tails, then lines unique on both sides in their longest rising order, and so on between them."""
    out, open_ = [], [(0, len(a), 0, len(b))]
    while open_:
        i, i_end, j, j_end = open_.pop()
        while i < i_end and j < j_end and a[i] == b[j]:
            out.append((i, j))
            i, j = i + 1, j + 1
        while i < i_end and j < j_end and a[i_end - 1] == b[j_end - 1]:
            i_end, j_end = i_end - 1, j_end - 1
            out.append((i_end, j_end))
        if i == i_end or j == j_end:
            continue
        once = Counter(b[j:j_end])
        at = {x: k for k, x in enumerate(b[j:j_end], j) if once[x] == 1}
        seen = Counter(a[i:i_end])
        common = [(k, at[x]) for k, x in enumerate(a[i:i_end], i) if seen[x] == 1 and x in at]
        if not common:
            continue
        tops, top_of, back = [], [], [-1] * len(common)
        for n, (_, place) in enumerate(common):
            pile = bisect.bisect_left(tops, place)
            if pile:
                back[n] = top_of[pile - 1]
            tops[pile:pile + 1], top_of[pile:pile + 1] = [place], [n]
        chain, n = [], top_of[-1]
        while n >= 0:
            chain.append(common[n])
            n = back[n]
        bounds = [(i - 1, j - 1), *reversed(chain), (i_end, j_end)]
        out += chain
        open_ += [(p + 1, q, r + 1, t) for (p, r), (q, t) in zip(bounds, bounds[1:], strict=False)]
    return out


class _Early:
    """Lines of an earliest holder, by value."""

    def __init__(self, lines: bytes):
        f = np.frombuffer(lines, np.uint64)
        self.lines = f[f != 0]
        self.order = np.argsort(self.lines, kind="stable")
        self.sorted = self.lines[self.order]

    def among(self, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Places of its lines that are among `values` (distinct), in order, and which values it holds."""
        low, high = np.searchsorted(self.sorted, values), np.searchsorted(self.sorted, values, "right")
        n = high - low
        at = np.repeat(low - np.cumsum(n) + n, n) + np.arange(n.sum())
        return np.sort(self.order[at]), n > 0


def _shortened(lines: np.ndarray, places: np.ndarray, gap: int) -> tuple[list[int], list[int]]:
    """The lines at `places` and where they are; other lines between them become one line that nobody shares."""
    out, at, last = [], [], -1
    for p, x in zip([*places.tolist(), len(lines)], [*lines[places].tolist(), None], strict=True):
        if p > last + 1:
            gap -= 1
            out.append(gap)
            at.append(-1)
        if x is not None:
            out.append(x)
            at.append(p)
        last = p
    return out, at


def aligned(early: _Early, lines: np.ndarray, words: np.ndarray, shared: np.ndarray) -> np.ndarray:
    """Places of a later document's lines (all with a word) that go: aligned ones, and the lines and runs it has once and has `shared` with this holder."""
    values, of, times = np.unique(lines, return_inverse=True, return_counts=True)
    places, has = early.among(values)
    theirs, _ = _shortened(early.lines, places, 0)
    own, at_own = _shortened(lines, np.flatnonzero(has[of]), -1 << 62)
    gone = np.isin(lines, shared) & (times[of] == 1)
    at, run, reach = _runs(lines, words)
    _, of_run, times = np.unique(run, return_inverse=True, return_counts=True)
    for k in np.flatnonzero(np.isin(run, shared) & (times[of_run] == 1)):
        gone[at[k]:at[k] + reach[k]] = True
    gone[[at_own[j] for _, j in patience(theirs, own)]] = True
    return np.flatnonzero(gone)


def _align(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """A stream in which each holder comes before its pairs: places to delete from the later documents."""
    def rows() -> Iterator[dict]:
        early = None
        for doc_id, key, lines, words, shared in base.rows_of(batches, "late", "late_key", "lines", "words", "shared"):
            if doc_id is None:
                early = _Early(lines)
                continue
            h = np.frombuffer(lines, np.uint64)
            full = np.flatnonzero(h)
            gone = aligned(early, h[full], np.frombuffer(words, "<u4")[full], np.array(shared, np.int64).view(np.uint64))
            yield {"doc_id": doc_id, "key": key, "gone": full[gone].astype("<u4").tobytes()}
    return base.batched(rows(), pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("gone", pa.binary())]))


def deletions(docs: DataFrame) -> DataFrame:
    """doc_id, key (xxhash64 of the text), gone: arrays of line places to delete; NULL array: all lines."""
    work = base.new_work(docs.sparkSession)
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    read = base.materialize(docs.mapInArrow(_read, _LINES).filter("n_lines > 0"), f"{work}/lines")
    classes = read.groupBy("s1", "s2").agg(F.min(F.struct("doc_id", "key")).alias("first"))
    firsts = classes.select(F.col("first.doc_id").alias("doc_id"), F.col("first.key").alias("key"), "s1", "s2")
    copies = read.join(firsts.select("s1", "s2", F.col("doc_id").alias("first_id")), ["s1", "s2"]).filter("doc_id > first_id").select("doc_id", "key", F.lit(None).cast("binary").alias("gone")).distinct()
    reps = base.materialize(read.join(firsts, ["doc_id", "key", "s1", "s2"]).dropDuplicates(["doc_id", "key"]).select("doc_id", "key", "lines", "words", "shared"), f"{work}/reps")
    held = reps.select("doc_id", "key", F.explode("shared").alias("h"))
    early = held.groupBy("h").agg(F.min(F.struct("doc_id", "key")).alias("e"), F.count("*").alias("holders")).filter("holders > 1").select("h", "e")
    pairs = held.join(early, "h").filter("doc_id > e.doc_id").groupBy(F.col("doc_id").alias("late"), F.col("key").alias("late_key"), "e").agg(F.collect_list("h").alias("shared"))  # at most the lines of one document
    pairs = base.materialize(pairs.select("late", "late_key", F.col("e.doc_id").alias("early"), F.col("e.key").alias("early_key"), "shared"), f"{work}/pairs")
    tasks = base.materialize(pairs.groupBy("early", "early_key").agg(F.ceil(F.count("*") / PER_TASK).cast("int").alias("tasks")), f"{work}/tasks")
    many = tasks.filter("tasks > 1")
    part = F.when(F.col("tasks").isNull(), 0).otherwise(F.pmod(F.xxhash64("late", "late_key"), "tasks")).cast("int")
    names = ["early", "early_key", "part", "late", "late_key", "lines", "words", "shared"]
    late = pairs.join(many, ["early", "early_key"], "left").withColumn("part", part).join(reps.select(F.col("doc_id").alias("late"), F.col("key").alias("late_key"), "lines", "words"), ["late", "late_key"]).select(*names)
    none = F.lit(None).cast("long")
    first = tasks.join(reps.select(F.col("doc_id").alias("early"), F.col("key").alias("early_key"), "lines", "words"), ["early", "early_key"])
    first = first.withColumn("part", F.explode(F.sequence(F.lit(0), F.col("tasks") - 1))).withColumns({"late": none, "late_key": none, "shared": F.array().cast("array<long>")}).select(*names)
    met = late.unionByName(first).repartition("early", "early_key", "part").sortWithinPartitions("early", "early_key", "part", F.asc_nulls_first("late"))
    found = met.select("late", "late_key", "lines", "words", "shared").mapInArrow(_align, "doc_id long, key long, gone binary")
    return found.unionByName(copies).groupBy("doc_id", "key").agg(F.when(F.bool_or(F.col("gone").isNotNull()), F.collect_set("gone")).alias("gone"))


def without(text: bytes, gone: list[bytes] | None) -> tuple[bytes, int, int]:
    """The text without its deleted lines, its lines with words, and how many of them went."""
    lines = split_lines(text)
    full = sum(bool(x.strip()) for x in lines)
    drop = set(range(len(lines))) if gone is None else set(np.frombuffer(b"".join(gone), "<u4").tolist())
    kept = [x for i, x in enumerate(lines) if i not in drop]
    left = sum(bool(x.strip()) for x in kept)
    return b"\n".join(kept) if left else b"", full, full - left


def _joined(docs: DataFrame) -> tuple[DataFrame, str, str]:
    """docs with the places to delete (column names that docs does not have)."""
    found, gone = base.fresh(docs, "line_found"), base.fresh(docs, "line_gone")
    d, k = base.fresh(docs, "line_doc"), base.fresh(docs, "line_key")
    cut = deletions(docs).select(F.col("doc_id").alias(d), F.col("key").alias(k), F.lit(True).alias(found), F.col("gone").alias(gone))
    return docs.join(cut, (F.col("doc_id").cast("long") == F.col(d)) & (F.xxhash64("text") == F.col(k)), "left"), found, gone


def digest(docs: DataFrame) -> DataFrame:
    """Per row: doc_id, n_lines, n_removed, kept_sha256 (of the text that is left)."""
    joined, found, gone = _joined(docs.select("doc_id", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for doc_id, text, hit, places in base.rows_of(batches, "doc_id", "text", found, gone):
                text = text or b""
                kept, full, lost = without(text, places) if hit else (text, sum(bool(x.strip()) for x in split_lines(text)), 0)
                yield {"doc_id": doc_id, "n_lines": full, "n_removed": lost, "kept_sha256": hashlib.sha256(kept).hexdigest()}
        return base.batched(rows(), pa.schema([("doc_id", pa.int64()), ("n_lines", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))

    return joined.select(F.col("doc_id").cast("long").alias("doc_id"), "text", found, gone).mapInArrow(run, "doc_id long, n_lines long, n_removed long, kept_sha256 string")


def remove(docs: DataFrame) -> DataFrame:
    """`docs` with all columns, deleted lines gone from `text`; documents that lose all their lines go."""
    joined, found, gone = _joined(docs)

    @F.arrow_udf("string")
    def shorten(texts: pa.Array, hits: pa.Array, places: pa.Array) -> pa.Array:
        rows = zip(base.text_bytes(texts), hits.to_pylist(), places.to_pylist(), strict=True)
        return pa.array([without(t, p)[0].decode() if h and t is not None else None for t, h, p in rows], pa.string())

    new = base.fresh(docs, "line_text")
    cut = joined.withColumn(new, F.when(F.col(found), shorten("text", F.coalesce(F.col(found), F.lit(False)), gone)).otherwise(F.col("text")))
    return cut.filter(F.col(found).isNull() | (F.col(new) != "")).select(*[F.col(new).alias(c) if c == "text" else F.col(c) for c in docs.columns])
