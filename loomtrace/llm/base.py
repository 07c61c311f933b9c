"""Helpers shared by the corpus operators: words, word hashes, rolling hashes, Arrow batches."""
from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomtrace.plans.tables import materialize, work_dir  # noqa: F401  (re-used by the operators)

_M1, _M2 = np.uint64(0xBF58476D1CE4E5B9), np.uint64(0x94D049BB133111EB)
_S27, _S31, _S33 = np.uint64(27), np.uint64(31), np.uint64(33)


class Memo:
    """What was computed for the most recent keys: two generations of bounded size, so frequent keys stay."""

    def __init__(self, limit: int):
        self.new, self.old, self.limit = {}, {}, limit

    def missing(self, keys: set) -> list:
        """Keys to compute and put into `new`; all others of `keys` are there afterwards."""
        if len(self.new) >= self.limit:
            self.new, self.old = {}, self.new
        todo = []
        for k in keys.difference(self.new):
            v = self.old.get(k)
            if v is None:
                todo.append(k)
            else:
                self.new[k] = v
        return todo


class WordHashes(dict):
    """Word bytes to 64-bit hash; two generations of bounded size."""

    limit = 150_000

    def __init__(self):
        super().__init__()
        self.old: dict[bytes, int] = {}

    def __missing__(self, word: bytes) -> int:
        if len(self) >= self.limit:
            self.old = dict(self)
            self.clear()
        h = self.old.get(word)
        if h is None:
            h = int.from_bytes(hashlib.blake2b(word, digest_size=8).digest(), "little")
        self[word] = h
        return h

    def of(self, words: list[bytes]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), np.uint64, len(words))


def mix(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Order-sensitive 64-bit combination of two hash arrays."""
    x = (a ^ (a >> _S33)) * _M1
    x += b
    x ^= x >> _S27
    x *= _M2
    x ^= x >> _S31
    return x


def rolling(x: np.ndarray, width: int) -> np.ndarray:
    """Hash of every run of `width` elements, by doubling; empty if there is no full run."""
    n = len(x) - width + 1
    if n <= 0:
        return np.empty(0, np.uint64)
    out, at, power, step = None, 0, x, 1
    while True:
        if width & step:
            part = power[at:at + n]
            out = part if out is None else mix(out, part)
            at += step
        if step * 2 > width:
            return mix(out, np.full(n, width, np.uint64))
        power = mix(power[:-step], power[step:])
        step *= 2


def text_bytes(column) -> list[bytes | None]:
    """An Arrow string column as bytes."""
    return column.cast(pa.binary()).to_pylist()


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as tuples; strings as bytes. Some hundred rows are held as Python values at a time."""
    for whole in batches:
        for i in range(0, whole.num_rows, 256):
            batch, columns = whole.slice(i, 256), []
            for name in names:
                c = batch.column(name)
                columns.append(text_bytes(c) if pa.types.is_string(c.type) or pa.types.is_large_string(c.type) else c.to_pylist())
            yield from zip(*columns, strict=True)


def whole_groups(batches: Iterator[pa.RecordBatch], *keys: str) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of a stream sorted by integer keys, cut between groups, and the first row of each group. A group is held whole."""
    held = None
    for batch in batches:
        if held is not None:
            batch = pa.concat_batches([held, batch])
        first = runs(*(batch.column(k).to_numpy(zero_copy_only=False) for k in keys)) if batch.num_rows else np.empty(0, np.int64)
        if len(first) > 1:
            yield batch.slice(0, first[-1]), first[:-1]
            batch = batch.slice(first[-1])
        held = batch
    if held is not None and held.num_rows:
        yield held, np.zeros(1, np.int64)


def batched(rows: Iterator[dict], schema: pa.Schema, most: int = 4096, most_bytes: int = 8 << 20) -> Iterator[pa.RecordBatch]:
    """Dicts to Arrow batches of bounded rows and bytes of binary values."""
    held, size = [], 0
    for row in rows:
        held.append(row)
        size += sum(len(v) for v in row.values() if isinstance(v, bytes | str))
        if len(held) >= most or size >= most_bytes:
            yield pa.RecordBatch.from_pylist(held, schema)
            held, size = [], 0
    if held:
        yield pa.RecordBatch.from_pylist(held, schema)


#: DuckDB expression: words of a text.
SQL_WORDS = r"list_filter(string_split_regex({}, '[\x20\x09-\x0D]+'), lambda x: x <> '')"


def small_batches(spark: SparkSession) -> None:
    """Bound what one task exchanges with Python at a time, whatever the length of texts."""
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "1000")
    spark.conf.set("spark.sql.execution.arrow.maxBytesPerBatch", str(4 << 20))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def text_size(docs: DataFrame) -> int:
    """UTF-8 bytes of all texts: sizes buckets and chunks, never what is computed."""
    return docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0


def new_work(spark: SparkSession, folder: str | None = None) -> str:
    """A folder for an operator's written tables; batches to Python are bounded from here on."""
    small_batches(spark)
    return work_dir(spark, folder)


def documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    small_batches(spark)
    return table(spark, sf_dir, "documents")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def fresh(df: DataFrame, name: str) -> str:
    """A column name that `df` does not have."""
    taken = {c.lower() for c in df.columns}
    while name.lower() in taken:
        name += "_"
    return name


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays as one binary value: per array its type, its length and its bytes."""
    parts = []
    for a in arrays:
        a = np.ascontiguousarray(a)
        parts += [a.dtype.str[1:].encode(), len(a).to_bytes(6, "little"), a.tobytes()]
    return b"".join(parts)


def unpack(blob: bytes) -> list[np.ndarray]:
    out, at = [], 0
    while at < len(blob):
        kind, n = np.dtype("<" + blob[at:at + 2].decode()), int.from_bytes(blob[at + 2:at + 8], "little")
        out.append(np.frombuffer(blob, kind, n, at + 8))
        at += 8 + n * kind.itemsize
    return out


def to_planes(values: np.ndarray) -> np.ndarray:
    """Ascending numbers below 2^32 as differences, byte plane by byte plane: high planes compress to nothing."""
    return np.diff(values, prepend=0).astype("<u4").view(np.uint8).reshape(-1, 4).T.ravel()


def from_planes(planes: np.ndarray) -> np.ndarray:
    return np.cumsum(np.ascontiguousarray(planes.reshape(4, -1).T).view("<u4").ravel(), dtype=np.int64)


def runs(sorted_values: np.ndarray, *more: np.ndarray) -> np.ndarray:
    """First index of each run of equal values in sorted arrays."""
    n = len(sorted_values)
    new = np.ones(n, bool)
    if n:
        new[1:] = sorted_values[1:] != sorted_values[:-1]
        for a in more:
            new[1:] |= a[1:] != a[:-1]
    return np.flatnonzero(new)


def run_lengths(first: np.ndarray, n: int) -> np.ndarray:
    return np.diff(first, append=n)
