"""Flat files of unsigned token ids with 64-bit document offsets.

Documents are range-partitioned and sorted by doc_id, so part files in order are the whole
sequence. Each part is one file of ids (16 bits where the vocabulary allows, else 32, little
endian). A prefix sum over the parts' lengths gives every part its base; then an offsets file per
part holds the place of each document in the whole sequence and, last, the place after the part.
Readers map the files into memory where they lie on a file system, and read them elsewhere.

A part is written under the attempt's own name and then renamed, so a second attempt or a lost
executor leaves one complete file. The folder must be shared: spark.checkpoint.dir by default.

Defined results: a NULL or empty text gives only its end id; NULL doc_ids sort first; equal doc_ids
follow the order of a hash of their texts; no rows give no files.
"""
from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyarrow import fs
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from loomtrace.llm import base, tokens

END = 2
_FACTS = "part int, doc_id long, place long, local long, size long, bits int"
_FACTS_ARROW = pa.schema([("part", pa.int32()), ("doc_id", pa.int64()), ("place", pa.int64()), ("local", pa.int64()), ("size", pa.int64()), ("bits", pa.int32())])


def _place(folder: str) -> tuple[fs.FileSystem, str]:
    if "://" not in folder and not folder.startswith("file:"):
        return fs.LocalFileSystem(), folder
    return fs.FileSystem.from_uri(folder)


def _save(folder: str, name: str, chunks: Iterator[bytes]) -> None:
    """One complete file, whatever attempts ran before or beside this one."""
    store, root = _place(folder)
    store.create_dir(root, recursive=True)
    own = f"{root}/.{name}-{uuid.uuid4().hex}"
    with store.open_output_stream(own) as out:
        for c in chunks:
            out.write(c)
    if store.get_file_info(f"{root}/{name}").type == fs.FileType.NotFound:
        store.move(own, f"{root}/{name}")
    else:  # another attempt of the same part was first
        store.delete_file(own)


def _load(folder: str, name: str, kind: np.dtype) -> np.ndarray:
    store, root = _place(folder)
    if isinstance(store, fs.LocalFileSystem):
        source = pa.memory_map(f"{root}/{name}")
        return np.frombuffer(source.read_buffer(), kind)
    with store.open_input_file(f"{root}/{name}") as f:
        return np.frombuffer(f.read(), kind)


def write(docs: DataFrame, folder: str, vocabulary: str | None = None, end: int = END, parts: int | None = None) -> DataFrame:
    """Write doc_id, text as token files below `folder`. Returns the manifest: part, base, n_tokens, n_docs, bits."""
    spark = docs.sparkSession
    vocabulary = vocabulary or tokens.vocabulary_path()

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, part = tokens.Encoder(vocabulary), TaskContext.get().partitionId()
        ids, starts, at = [], [], 0

        def chunks() -> Iterator[bytes]:
            nonlocal at
            for batch in batches:
                out, bounds = encoder.batch(batch.column("text"), end)
                ids.extend(batch.column("doc_id").to_pylist())
                starts.extend((bounds[:-1] + at).tolist())
                at += len(out)
                yield out.tobytes()

        _save(folder, f"ids-{part:06d}.bin", chunks())
        sizes = np.diff(np.array([*starts, at], np.int64)).tolist()
        rows = ({"part": part, "doc_id": ids[i], "place": i, "local": starts[i], "size": sizes[i], "bits": 8 * encoder.kind.itemsize} for i in range(len(ids)))
        yield from base.batched(rows, _FACTS_ARROW)

    parts = parts or base.partitions(spark)
    ordered = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").repartitionByRange(parts, "doc_id", F.xxhash64("text")).sortWithinPartitions("doc_id", F.xxhash64("text"), "text")
    facts = base.materialize(ordered.mapInArrow(encode, _FACTS), f"{folder}/facts")
    sizes = facts.groupBy("part").agg(F.sum("size").alias("n_tokens"), F.count("*").alias("n_docs"), F.max("bits").alias("bits"))
    before = Window.orderBy("part").rowsBetween(Window.unboundedPreceding, -1)
    manifest = base.materialize(sizes.withColumn("base", F.coalesce(F.sum("n_tokens").over(before), F.lit(0))), f"{folder}/manifest")

    def offsets(key: tuple, rows: pa.Table) -> pa.Table:
        rows = rows.sort_by("place")
        local, first, size = (rows.column(c).to_numpy() for c in ("local", "base", "size"))
        starts = first + local
        _save(folder, f"offsets-{key[0].as_py():06d}.bin", iter([np.append(starts, starts[-1] + size[-1]).astype("<u8").tobytes()]))
        return pa.table({"part": pa.array([key[0].as_py()], pa.int32()), "n": pa.array([len(rows)], pa.int64())})

    placed = facts.join(F.broadcast(manifest.select("part", "base")), "part")  # one row per part file
    base.materialize(placed.groupBy("part").applyInArrow(offsets, "part int, n long"), f"{folder}/offsets_written")
    return manifest


def read(spark: SparkSession, folder: str) -> DataFrame:
    """Documents of the files in order: part, place, start, n_tokens, ids_crc32, from the mapped files alone."""
    manifest = spark.read.parquet(f"{folder}/manifest").select("part", "bits")

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def rows() -> Iterator[dict]:
            for part, bits in base.rows_of(batches, "part", "bits"):
                places = _load(folder, f"offsets-{part:06d}.bin", np.dtype("<u8")).astype(np.int64)
                ids = _load(folder, f"ids-{part:06d}.bin", np.dtype(f"<u{bits // 8}"))
                for i, (a, b) in enumerate(zip(places[:-1], places[1:], strict=True)):
                    yield {"part": part, "place": i, "start": int(a), "n_tokens": int(b - a), "ids_crc32": tokens.crc32(ids[a - places[0]:b - places[0]])}
        return base.batched(rows(), pa.schema([("part", pa.int32()), ("place", pa.int64()), ("start", pa.int64()), ("n_tokens", pa.int64()), ("ids_crc32", pa.int64())]))

    # one part per task: parts of one size are dealt round robin
    return manifest.repartition(max(1, base.partitions(spark))).mapInArrow(scan, "part int, place long, start long, n_tokens long, ids_crc32 long")


def digest(docs: DataFrame, folder: str | None = None) -> DataFrame:
    """Write `docs`, read the files back: doc_id, start, n_tokens, ids_crc32."""
    spark = docs.sparkSession
    folder = base.new_work(spark, folder)
    write(docs, folder)
    names = spark.read.parquet(f"{folder}/facts").select("part", "place", "doc_id")
    # the planner would take the rows read for as few as the files and broadcast them
    return read(spark, folder).hint("merge").join(names, ["part", "place"]).select("doc_id", "start", "n_tokens", "ids_crc32")
