"""Exact repeated passages across documents: fixed-block anchors.

A passage of W words that also occurs in another document holds, there, one aligned block of
B = W // 2 words whatever its alignment. So the non-overlapping blocks of every document are the
index, and every rolling window of B words of every document probes it:

1. *Anchors.* Documents are read in batches of some hundred thousand words. A batch sends each bucket of
   the hash space one packed row: four bytes per window, its place as a difference, a bit for
   "aligned block" and a bit for "next document". Windows that a batch holds in several documents
   are settled inside the batch and sent once, so a passage of a third of all rows costs one
   entry per batch. A bucket marks all windows equal to a block of another document.
2. *Extension.* Around a mark, all W-word windows that contain it are candidates. Their 96-bit
   hashes are compared in the same bucketed manner, keeping the smallest doc_id per window. Runs
   of confirmed windows are the maximal exact repeats.

Marks are a superset (short fingerprints); only step 2 decides. No pairs of documents are formed.

Defined results: a NULL text has no words; a NULL doc_id is neither earlier nor later than others,
so such rows keep everything; equal rows get the same result, and rows of one doc_id with other
texts are told apart by a hash of the text; documents below W words keep everything.
"""
from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import base

WINDOW = 50
BATCH_WORDS, BUCKET_WORDS = 600_000, 1_000_000
_SENT = "grp int, batch long, kind int, blob binary"
_SENT_ARROW = pa.schema([("grp", pa.int32()), ("batch", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
_BACK = "batch long, kind int, blob binary"
_BACK_ARROW = pa.schema([("batch", pa.int64()), ("kind", pa.int32()), ("blob", pa.binary())])
_ENTRIES, _DOCS = 0, 1


class _Batch:
    """Words of consecutive documents in one array."""

    def __init__(self, hashes: list[np.ndarray]):
        self.x = np.concatenate(hashes) if hashes else np.empty(0, np.uint64)
        self.lens = np.array([len(h) for h in hashes], np.int64)
        self.starts = np.cumsum(self.lens) - self.lens
        self.doc = np.repeat(np.arange(len(hashes)), self.lens)
        self.pos = np.arange(len(self.x)) - self.starts[self.doc]

    def windows(self, width: int) -> np.ndarray:
        """Places at which a window of one document starts."""
        return np.flatnonzero(self.pos + width <= self.lens[self.doc])


def _slices(bucket: np.ndarray, n: int) -> Iterator[tuple[int, slice]]:
    edges = np.searchsorted(bucket, np.arange(n + 1))
    return ((b, slice(edges[b], edges[b + 1])) for b in np.flatnonzero(np.diff(edges)))


def _bits(flags: np.ndarray) -> np.ndarray:
    return np.packbits(flags.astype(bool))


def _unbits(bits: np.ndarray, n: int) -> np.ndarray:
    return np.unpackbits(bits, count=n).astype(bool)


def _probe(window: int, buckets: int):
    """Map side of step 1: packed windows per bucket, and one row of document facts per batch."""
    width = window // 2

    def flush(rows: list[tuple], hashes: list[np.ndarray], batch: int) -> Iterator[dict]:
        b = _Batch(hashes)
        usable = np.array([r[0] is not None and len(h) >= window for r, h in zip(rows, hashes, strict=True)])
        at = b.windows(width)
        at = at[usable[b.doc[at]]]
        direct = np.empty(0, np.int64)
        if len(at):
            h = base.rolling(b.x, width)[at]
            order = np.argsort(h, kind="stable")
            at, h = at[order], h[order]
            block = b.pos[at] % width == 0
            first = base.runs(h)
            size = base.run_lengths(first, len(h))
            many = b.doc[at[first]] != b.doc[at[first + size - 1]]
            block[first] = np.logical_or.reduceat(block, first)
            inside = np.repeat(many, size)
            direct = np.sort(at[inside])
            send = ~inside
            send[first] = True
            at, h, block = at[send], h[send], block[send]
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((at, bucket))
            at, h, block, bucket = at[order], h[order].astype("<u4"), block[order], bucket[order]
            for k, s in _slices(bucket, buckets):
                docs = b.doc[at[s]]
                yield {"grp": int(k), "batch": batch, "kind": _ENTRIES, "blob": base.pack(base.to_planes(at[s]), h[s], _bits(block[s]), _bits(np.diff(docs, prepend=-1) != 0))}
        ids = np.array([r[0] if r[0] is not None else 0 for r in rows], np.int64)
        nulls = np.array([r[0] is None for r in rows], np.uint8)
        keys = np.array([r[1] for r in rows], np.int64)
        digests = np.frombuffer(b"".join(r[2] for r in rows), np.uint8)
        yield {"grp": batch % buckets, "batch": batch, "kind": _DOCS, "blob": base.pack(ids, nulls, keys, b.lens, digests, direct)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[dict]:
            memo, batch = base.WordHashes(), TaskContext.get().partitionId() << 24
            rows, hashes, n = [], [], 0
            for doc_id, key, text in base.rows_of(batches, "doc_id", "key", "text"):
                words = text.split() if text else []
                rows.append((doc_id, key, hashlib.sha256(b" ".join(words)).digest()))
                hashes.append(memo.of(words))
                n += len(words) + 1
                if n >= BATCH_WORDS:
                    yield from flush(rows, hashes, batch)
                    rows, hashes, n, batch = [], [], 0, batch + 1
            if rows:
                yield from flush(rows, hashes, batch)
        return base.batched(sent(), _SENT_ARROW)

    return scan


def _by_batch(marks: dict[int, list[np.ndarray]], table: pa.Table) -> pa.Table:
    """Marks per batch, and the document rows as they came."""
    rows = [{"batch": k, "kind": _ENTRIES, "blob": base.pack(np.concatenate(v).astype("<u4"))} for k, v in marks.items()]
    rows += [r for r in table.select(["batch", "kind", "blob"]).to_pylist() if r["kind"] == _DOCS]
    return pa.Table.from_pylist(rows, _BACK_ARROW)


def _match_blocks(table: pa.Table) -> pa.Table:
    """One bucket of step 1: windows equal to an aligned block and seen in two documents."""
    at, prints, block, doc, batch, seen = [], [], [], [], [], 0
    for b, kind, blob in zip(*(table.column(c).to_pylist() for c in ("batch", "kind", "blob")), strict=True):
        if kind == _ENTRIES:
            planes, h, is_block, new = base.unpack(blob)
            at.append(base.from_planes(planes))
            prints.append(h)
            block.append(_unbits(is_block, len(h)))
            doc.append(seen + np.cumsum(_unbits(new, len(h))))
            batch.append(np.full(len(h), b))
            seen = int(doc[-1][-1])
    if not at:
        return _by_batch({}, table)
    prints, block = np.concatenate(prints), np.concatenate(block)
    index = np.unique(prints[block])
    if not len(index):
        return _by_batch({}, table)
    hit = np.flatnonzero(index[np.minimum(np.searchsorted(index, prints), len(index) - 1)] == prints)
    at, doc, batch = np.concatenate(at)[hit], np.concatenate(doc)[hit], np.concatenate(batch)[hit]
    order = np.argsort(prints[hit], kind="stable")
    h = prints[hit][order]
    first = base.runs(h)
    size = base.run_lengths(first, len(h))
    many = doc[order[first]] != doc[order[first + size - 1]]
    marked = np.sort(order[np.repeat(many, size)])
    return _by_batch(_split(batch[marked], at[marked]), table)


def _split(batch: np.ndarray, at: np.ndarray) -> dict[int, list[np.ndarray]]:
    order = np.argsort(batch, kind="stable")
    batch, at = batch[order], at[order]
    first = base.runs(batch)
    return {int(batch[i]): [at[i:i + n]] for i, n in zip(first, base.run_lengths(first, len(batch)), strict=True)}


_FACTS = "doc_id long, key long, n_words long, sha256 string, marks binary"
_FACTS_ARROW = pa.schema([("doc_id", pa.int64()), ("key", pa.int64()), ("n_words", pa.int64()), ("sha256", pa.string()), ("marks", pa.binary())])


def _gather(table: pa.Table) -> pa.Table:
    """One batch: its documents, each with the places that any bucket marked (NULL: none)."""
    facts, marks = None, []
    for kind, blob in zip(table.column("kind").to_pylist(), table.column("blob").to_pylist(), strict=True):
        if kind == _DOCS:
            facts = base.unpack(blob)
        else:
            marks += base.unpack(blob)
    if facts is None:
        raise ValueError("a batch lost its documents: the input changed between attempts")
    ids, nulls, keys, lens, digests, direct = facts
    at = np.unique(np.concatenate([direct, *marks]).astype(np.int64))
    starts = np.cumsum(lens) - lens
    edges = np.searchsorted(at, np.append(starts, lens.sum()))
    digests = digests.tobytes()
    out = [{"doc_id": None if nulls[i] else int(ids[i]), "key": int(keys[i]), "n_words": int(lens[i]), "sha256": digests[32 * i:32 * i + 32].hex() if digests else None,
            "marks": (at[edges[i]:edges[i + 1]] - starts[i]).astype("<u4").tobytes() or None} for i in range(len(ids))]
    return pa.Table.from_pylist(out, _FACTS_ARROW)


def _marks(parts: list[bytes]) -> np.ndarray:
    return np.unique(np.frombuffer(b"".join(parts), "<u4")).astype(np.int64)


def _extend(window: int, buckets: int):
    """Map side of step 2: W-word windows around the marks."""
    width = window // 2

    def flush(rows: list[tuple], hashes: list[np.ndarray], batch: int) -> Iterator[dict]:
        order = sorted(range(len(rows)), key=lambda i: rows[i][:2])
        rows, b = [rows[i] for i in order], _Batch([hashes[i] for i in order])
        ids = np.array([r[0] for r in rows], np.int64)
        edge = np.zeros(len(b.x) + 1, np.int64)
        for start, n, row in zip(b.starts, b.lens, rows, strict=True):
            m = _marks(row[2])
            lo, hi = np.maximum(m - (window - width), 0), np.minimum(m, n - window)
            ok = lo <= hi
            np.add.at(edge, start + lo[ok], 1)
            np.add.at(edge, start + hi[ok] + 1, -1)
        at = np.flatnonzero(np.cumsum(edge[:-1]) > 0)
        direct = np.empty(0, np.int64)
        if len(at):
            h, h2 = base.rolling(b.x, window)[at], base.rolling(base.mix(b.x, b.x), window)[at].astype("<u4")
            order = np.lexsort((at, h2, h))
            at, h, h2 = at[order], h[order], h2[order]
            first = base.runs(h, h2)
            later = ids[b.doc[at]] > np.repeat(ids[b.doc[at[first]]], base.run_lengths(first, len(h)))
            direct = np.sort(at[later])
            at, h, h2 = at[~later], h[~later], h2[~later]
            bucket = ((h >> np.uint64(32)) % np.uint64(buckets)).astype(np.int64)
            order = np.lexsort((at, bucket))
            at, h, h2, bucket = at[order], h[order], h2[order], bucket[order]
            for k, s in _slices(bucket, buckets):
                docs = b.doc[at[s]]
                new = np.diff(docs, prepend=-1) != 0
                yield {"grp": int(k), "batch": batch, "kind": _ENTRIES, "blob": base.pack(base.to_planes(at[s]), h[s], h2[s], _bits(new), ids[docs[new]])}
        keys = np.array([r[1] for r in rows], np.int64)
        yield {"grp": batch % buckets, "batch": batch, "kind": _DOCS, "blob": base.pack(ids, np.zeros(len(ids), np.uint8), keys, b.lens, np.empty(0, np.uint8), direct)}

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def sent() -> Iterator[dict]:
            memo, batch = base.WordHashes(), TaskContext.get().partitionId() << 24
            rows, hashes, n = [], [], 0
            for doc_id, key, text, marks in base.rows_of(batches, "doc_id", "key", "text", "marks"):
                rows.append((doc_id, key, marks))
                hashes.append(memo.of(text.split()))
                n += len(hashes[-1])
                if n >= BATCH_WORDS:
                    yield from flush(rows, hashes, batch)
                    rows, hashes, n, batch = [], [], 0, batch + 1
            if rows:
                yield from flush(rows, hashes, batch)
        return base.batched(sent(), _SENT_ARROW)

    return scan


def _match_windows(table: pa.Table) -> pa.Table:
    """One bucket of step 2: windows that also start in a document with a smaller doc_id."""
    at, h, h2, ids, batch = [], [], [], [], []
    for b, kind, blob in zip(*(table.column(c).to_pylist() for c in ("batch", "kind", "blob")), strict=True):
        if kind == _ENTRIES:
            planes, one, two, new, docs = base.unpack(blob)
            at.append(base.from_planes(planes))
            h.append(one)
            h2.append(two)
            ids.append(docs[np.cumsum(_unbits(new, len(one))) - 1])
            batch.append(np.full(len(one), b))
    if not at:
        return _by_batch({}, table)
    at, h, h2, ids, batch = map(np.concatenate, (at, h, h2, ids, batch))
    order = np.lexsort((ids, h2, h))
    first = base.runs(h[order], h2[order])
    least = np.repeat(ids[order][first], base.run_lengths(first, len(order)))
    later = np.sort(order[ids[order] > least])
    return _by_batch(_split(batch[later], at[later]), table)


def find(docs: DataFrame, window: int = WINDOW, work: str | None = None) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Repeats of `docs` (doc_id, text). Returns three tables keyed by (doc_id, key), key = xxhash64(text):

    facts: every row with n_words, sha256 of its words joined by one space, and marks (NULL: no anchor);
    marked: doc_id, key, text of the rows with anchors;
    cuts: doc_id, key, starts: the word places (unsigned 32-bit) where a repeated window starts.
    """
    spark = docs.sparkSession
    work = base.new_work(spark, work)
    buckets = max(4 * base.partitions(spark), base.text_size(docs) // (6 * BUCKET_WORDS))
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64("text").alias("key"), "text")
    sent = docs.mapInArrow(_probe(window, buckets), _SENT)
    back = sent.groupBy("grp").applyInArrow(_match_blocks, _BACK)
    facts = base.materialize(back.groupBy("batch").applyInArrow(_gather, _FACTS), f"{work}/facts")
    marks = facts.filter("marks is not null and doc_id is not null").groupBy("doc_id", "key").agg(F.collect_set("marks").alias("marks"))
    marked = base.materialize(docs.join(marks, ["doc_id", "key"]), f"{work}/marked")
    back = marked.mapInArrow(_extend(window, buckets), _SENT).groupBy("grp").applyInArrow(_match_windows, _BACK)
    cuts = (back.groupBy("batch").applyInArrow(_gather, _FACTS).filter("marks is not null")
            .groupBy("doc_id", "key").agg(F.collect_set("marks").alias("starts")))
    return facts, marked, cuts


def removed_words(n_words: int, starts: list[bytes] | None, window: int) -> np.ndarray:
    """Flags of the words that some repeated window covers."""
    edge = np.zeros(n_words + 1, np.int64)
    if starts:
        at = _marks(starts)
        np.add.at(edge, at, 1)
        np.add.at(edge, at + window, -1)
    return np.cumsum(edge[:-1]) > 0


def digest(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """Per row of `docs`: doc_id, n_words, n_removed, kept_sha256."""
    facts, marked, cuts = find(docs, window)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for doc_id, text, starts in base.rows_of(batches, "doc_id", "text", "starts"):
                words = text.split()
                gone = removed_words(len(words), starts, window)
                left = [words[i] for i in np.flatnonzero(~gone)]
                yield {"doc_id": doc_id, "n_words": len(words), "n_removed": int(gone.sum()), "kept_sha256": hashlib.sha256(b" ".join(left)).hexdigest()}
        return base.batched(rows(), pa.schema([("doc_id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept_sha256", pa.string())]))

    schema = "doc_id long, n_words long, n_removed long, kept_sha256 string"
    ids = facts.filter("marks is not null").select("doc_id", "key").distinct().withColumn("held", F.lit(True))  # equal rows may be marked in one batch only
    plain = facts.join(ids, ["doc_id", "key"], "left_anti").select("doc_id", "n_words", F.lit(0).cast("long").alias("n_removed"), F.col("sha256").alias("kept_sha256"))
    return plain.unionByName(marked.join(cuts, ["doc_id", "key"], "left").mapInArrow(kept, schema))


_WORD = re.compile(rb"[^\x20\x09-\x0D]+")


def cut_text(text: bytes, starts: list[bytes], window: int) -> bytes:
    """The runs of kept words as they stand in the text, joined by one space."""
    spans = [m.span() for m in _WORD.finditer(text)]
    keep = np.flatnonzero(~removed_words(len(spans), starts, window))
    breaks = np.flatnonzero(np.diff(keep) != 1)
    firsts, lasts = keep[np.append(0, breaks + 1)] if len(keep) else [], keep[np.append(breaks, len(keep) - 1)] if len(keep) else []
    return b" ".join(text[spans[i][0]:spans[j][1]] for i, j in zip(firsts, lasts, strict=True))


def remove(docs: DataFrame, window: int = WINDOW) -> DataFrame:
    """`docs` with all its columns, repeated passages cut from `text`; texts without one are unchanged."""
    _, _, cuts = find(docs, window)
    key, starts = base.fresh(docs, "cut_key"), base.fresh(docs, "cut_starts")
    cuts = cuts.select(F.col("doc_id").alias(base.fresh(docs, "cut_doc")), F.col("key").alias(key), F.col("starts").alias(starts))

    @F.arrow_udf("string")
    def shorten(texts: pa.Array, places: pa.Array) -> pa.Array:
        rows = zip(base.text_bytes(texts), places.to_pylist(), strict=True)
        return pa.array([None if p is None or t is None else cut_text(t, p, window).decode() for t, p in rows], pa.string())

    joined = docs.join(cuts, (F.col("doc_id").cast("long") == cuts[cuts.columns[0]]) & (F.xxhash64("text") == cuts[key]), "left")
    cut = F.when(F.col(starts).isNotNull(), shorten("text", starts)).otherwise(F.col("text"))
    return joined.withColumn("text", cut).select(*docs.columns)


#: digest() in SQL.
SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, {base.SQL_WORDS.format("coalesce(text, '')")} AS ws FROM documents),
k AS (SELECT r, doc_id, p, md5(array_to_string(ws[p:p + {WINDOW - 1}], ' ')) AS k FROM (SELECT r, doc_id, ws, unnest(range(1, len(ws) - {WINDOW - 2})) AS p FROM d)),
f AS (SELECT k, min(doc_id) AS first FROM k GROUP BY k),
hit AS (SELECT r, p FROM k JOIN f USING (k) WHERE first < doc_id),
gone AS (SELECT r, list(DISTINCT q) AS qs FROM (SELECT r, unnest(range(p, p + {WINDOW})) AS q FROM hit) GROUP BY r)
SELECT doc_id, len(ws)::BIGINT AS n_words, coalesce(len(qs), 0)::BIGINT AS n_removed,
  sha256(array_to_string(CASE WHEN qs IS NULL THEN ws ELSE list_filter(ws, lambda x, i: NOT list_contains(qs, i)) END, ' ')) AS kept_sha256
FROM d LEFT JOIN gone USING (r)
"""
