"""Best-fit packing planned on the histogram of lengths.

A document is its token ids and an end id; longer ones than a sequence are cut into full pieces and
a rest. The plan needs only how many pieces have each length (at most `capacity` numbers): lengths
fall from long to short, all pieces of one length at once take the fullest open sequences that
still hold them, or new ones. It is a list of runs - length, first rank, last rank, first sequence,
place in the sequence - whose number depends on the capacity alone. Pieces then get a rank within
their length and find their slot by a join on it. Ranks are counted in hashed chunks of each length
plus a prefix sum over the chunks, so a length that many pieces share is not one task's work.

Defined results: a NULL or empty text is one piece holding the end id; equal rows are packed each;
no rows give no pieces; a NULL doc_id is kept as it is.
"""
from __future__ import annotations

import bisect
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from loomtrace.llm import base, tokens

CAPACITY = 2048
END = 0
_PIECES = "doc_id long, piece int, start long, length long, ids_crc32 long"


def pieces(docs: DataFrame, capacity: int = CAPACITY, end: int = END, vocabulary: str | None = None, with_ids: bool = False) -> DataFrame:
    """Pieces of all documents; with_ids adds the ids as little-endian unsigned 32-bit integers."""
    vocabulary = vocabulary or tokens.vocabulary_path()
    names = [("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + [("ids", pa.binary())] * with_ids

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = tokens.Encoder(vocabulary)

        def encoded() -> Iterator[tuple]:
            for batch in batches:
                ids, bounds = encoder.batch(batch.column("text"), end)
                for doc_id, a, b in zip(batch.column("doc_id").to_pylist(), bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    yield doc_id, ids[a:b]

        def rows() -> Iterator[dict]:
            for doc_id, ids in encoded():
                for k, start in enumerate(range(0, len(ids), capacity)):
                    part = ids[start:start + capacity]
                    row = {"doc_id": doc_id, "piece": k, "start": start, "length": len(part), "ids_crc32": tokens.crc32(part)}
                    yield row | {"ids": part.astype("<u4").tobytes()} if with_ids else row
        return base.batched(rows(), pa.schema(names))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(cut, _PIECES + ", ids binary" * with_ids)


def plan(counts: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, int, int, int, int]]:
    """Best-fit decreasing over counts: runs (length, rank_from, rank_to, first_sequence, offset), rank_to excluded."""
    free: dict[int, list[tuple[int, int]]] = {}  # room left: intervals (first sequence, how many)
    rooms: list[int] = []
    out, opened = [], 0

    def leave(room: int, first: int, n: int) -> None:
        if room and n:
            if room not in free:
                bisect.insort(rooms, room)
            free.setdefault(room, []).append((first, n))

    for length in sorted(counts, reverse=True):
        rank, left = 0, counts[length]
        while left:
            i = bisect.bisect_left(rooms, length)
            if i == len(rooms):
                break
            room = rooms[i]
            first, n = free[room].pop()
            if not free[room]:
                del free[room], rooms[i]
            k = min(n, left)
            out.append((length, rank, rank + k, first, capacity - room))
            leave(room - length, first, k)
            leave(room, first + k, n - k)
            rank, left = rank + k, left - k
        each = capacity // length
        for items in (each, left % each):  # sequences opened full of this length, then one with the rest
            n = left // each if items == each else 1
            for j in range(items if n else 0):
                out.append((length, rank, rank + n, opened, j * length))
                rank += n
            if items and n:
                leave(capacity - items * length, opened, n)
                opened += n
                left -= n * items
            if not left:
                break
    return out


def pack(docs: DataFrame, capacity: int = CAPACITY, end: int = END, with_ids: bool = False) -> DataFrame:
    """All pieces with sequence_id and offset, gapless from 0 within each sequence."""
    spark = docs.sparkSession
    work = base.new_work(spark)
    cut = base.materialize(pieces(docs, capacity, end, with_ids=with_ids), f"{work}/pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    per_chunk = min(50_000, max(256, sum(counts.values()) // (8 * base.partitions(spark))))
    chunks = spark.createDataFrame([(k, -(-n // per_chunk)) for k, n in counts.items()], "length long, chunks long")
    runs = spark.createDataFrame(plan(counts, capacity), "length long, rank_from long, rank_to long, first long, offset long")
    placed = cut.join(F.broadcast(chunks), "length").withColumn("chunk", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), "chunks"))  # one row per length
    per = placed.groupBy("length", "chunk").agg(F.count("*").alias("n"))
    before = per.withColumn("before", F.coalesce(F.sum("n").over(Window.partitionBy("length").orderBy("chunk").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))).drop("n")
    order = Window.partitionBy("length", "chunk").orderBy("doc_id", "piece", "ids_crc32")
    ranked = placed.withColumn("nth", F.row_number().over(order) - 1).join(before, ["length", "chunk"]).withColumn("rank", F.col("before") + F.col("nth"))
    slots = F.broadcast(runs.withColumnRenamed("length", "run_length"))  # its rows depend on the capacity, not on the data
    found = ranked.join(slots, (F.col("length") == F.col("run_length")) & (F.col("rank") >= F.col("rank_from")) & (F.col("rank") < F.col("rank_to")))
    return found.select(*cut.columns, (F.col("first") + F.col("rank") - F.col("rank_from")).alias("sequence_id"), "offset")
