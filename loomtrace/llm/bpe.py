"""Byte-level BPE with word ends, over a contiguous array of ranks.

A short word keeps its parts (by id) and, for each boundary between two of them, the rank of joining
them, in two plain lists. The smallest rank is found by a scan, its boundary deleted, and the ranks
of the boundaries beside it looked up anew.
Words beyond `SHORT` parts, where repeated scans would be quadratic, take the same merges from a
heap. Ranks, vocabulary and added tokens come from the vocabulary file.

Text is normalised as the file says (composition, white space to one blank, lower case per
character) and split into contractions, letter runs, single numbers and other runs; bytes become
the file's printable characters and the last one carries the word end.

Defined results: a NULL text is empty and gives no ids; texts of any length are encoded whole;
equal rows give equal results.
"""
from __future__ import annotations

import hashlib
import heapq
import json
import unicodedata
from array import array
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from loomtrace.llm import base, tokens

SHORT = 200
_NONE = 1 << 60


class RankArrayBPE:
    limit = 80_000

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        vocab, self.end = model["vocab"], model["end_of_word_suffix"]
        self.added = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.names = {i: t for t, i in {**vocab, **self.added}.items()}
        self.shift = max(self.names).bit_length()
        self.ranks = {vocab[a] << self.shift | vocab[b]: r for r, (a, b) in enumerate(model["merges"])}
        self.joined = [vocab[a + b] for a, b in model["merges"]]  # by rank
        self.special = regex.compile("(" + "|".join(regex.escape(t) for t in sorted(self.added, key=len, reverse=True)) + ")")
        self.pieces = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\p{White_Space}\p{L}\p{N}]+")  # fixed value: the file's own pattern
        self.blank = regex.compile(r"\p{White_Space}+")
        letters = tokens.printed_bytes()
        self.inner, self.last = [vocab[c] for c in letters], [vocab[c + self.end] for c in letters]
        self.chunks, self.words = base.Memo(self.limit), base.Memo(self.limit)

    def merge(self, parts: list[int]) -> list[int]:
        return self._scan(parts) if len(parts) <= SHORT else self._heap(parts)

    def _scan(self, parts: list[int]) -> list[int]:
        rank, shift, parts = self.ranks.get, self.shift, list(parts)
        ranks = [rank(a << shift | b, _NONE) for a, b in zip(parts, parts[1:], strict=False)]
        while ranks and (least := min(ranks)) < _NONE:
            i = ranks.index(least)
            parts[i] = self.joined[least]
            del parts[i + 1], ranks[i]
            if i < len(ranks):
                ranks[i] = rank(parts[i] << shift | parts[i + 1], _NONE)
            if i:
                ranks[i - 1] = rank(parts[i - 1] << shift | parts[i], _NONE)
        return parts

    def _heap(self, parts: list[int]) -> list[int]:
        parts, n = list(parts), len(parts)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap: list[tuple[int, int, int, int]] = []

        def offer(i: int) -> None:
            if i >= 0 and after[i] < n and (r := self.ranks.get(parts[i] << self.shift | parts[after[i]])) is not None:
                heapq.heappush(heap, (r, i, parts[i], parts[after[i]]))

        for i in range(n - 1):
            offer(i)
        while heap:
            r, i, a, b = heapq.heappop(heap)
            j = after[i]
            if parts[i] != a or j >= n or parts[j] != b:  # one of them was merged meanwhile
                continue
            parts[i], parts[j] = self.joined[r], -1
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            offer(before[i])
            offer(i)
        return [p for p in parts if p >= 0]

    def _word(self, word: str) -> bytes:
        """One split-off word, remembered."""
        if self.words.missing({word}):
            raw = word.encode()
            self.words.new[word] = array("I", self.merge([*map(self.inner.__getitem__, raw[:-1]), self.last[raw[-1]]])).tobytes()
        return self.words.new[word]

    def _chunk(self, chunk: bytes) -> bytes:
        if chunk.isalpha():  # ASCII letters are one word in lower case
            return self._word(chunk.lower().decode())
        ids: list[bytes] = []
        for part in self.special.split(chunk.decode()):
            if part in self.added:
                ids.append(np.array([self.added[part]], "<u4").tobytes())
                continue
            if not part.isascii():
                part = self.blank.sub(" ", unicodedata.normalize("NFC", part))
            lower = part.lower() if part.isascii() else "".join(c.lower() for c in part)
            ids += map(self._word, self.pieces.findall(lower))
        return b"".join(ids)

    def encode(self, text: bytes | None) -> np.ndarray:
        """Ids of one whole text. Chunks between ASCII white space are independent and remembered."""
        chunks, out = (text or b"").split(), []
        for i in range(0, len(chunks), 50_000):
            part = chunks[i:i + 50_000]
            for c in self.chunks.missing(set(part)):
                self.chunks.new[c] = self._chunk(c)
            out.append(b"".join(map(self.chunks.new.__getitem__, part)))
        return np.frombuffer(b"".join(out), "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The file names no decoder: tokens are joined by a blank."""
        return " ".join(map(self.names.__getitem__, ids.tolist()))


@lru_cache(maxsize=2)
def codec(path: str) -> RankArrayBPE:
    """Each worker process reads the vocabulary file once."""
    return RankArrayBPE(path)


def encode_documents(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and ids of every text."""
    path = vocabulary or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            ids = [bpe.encode(t).astype(np.int32) for t in base.text_bytes(batch.column("text"))]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(ids, pa.list_(pa.int32()))], ["doc_id", "ids"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, ids array<int>")


def decode_documents(encoded: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id and text of rows with doc_id, ids (NULL ids: NULL text)."""
    path = vocabulary or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = codec(path)
        for batch in batches:
            texts = [None if x is None else bpe.decode(np.array(x, np.int64)) for x in batch.column("ids").to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(texts, pa.string())], ["doc_id", "text"])

    return encoded.select("doc_id", "ids").mapInArrow(run, "doc_id long, text string")


def digest(docs: DataFrame, vocabulary: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 in one pass over the texts."""
    path = vocabulary or tokens.vocabulary_path()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe, sha = codec(path), hashlib.sha256
        decimal = {i: str(i) for i in bpe.names}

        def rows() -> Iterator[dict]:
            for doc_id, text in base.rows_of(batches, "doc_id", "text"):
                ids = bpe.encode(text)
                yield {"doc_id": doc_id, "n_tokens": len(ids), "ids_sha256": sha(" ".join(map(decimal.__getitem__, ids.tolist())).encode()).hexdigest(), "decoded_sha256": sha(bpe.decode(ids).encode()).hexdigest()}
        return base.batched(rows(), pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())]))

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(run, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")
