"""Token ids of whole texts by the tokenizers library, one call per distinct chunk of a batch.

The word-level BPE's normalizer and splitter never join characters across ASCII white space, and
added tokens hold none, so a text's ids are the ids of its white-space chunks one after another
(tests hold this against whole-text encoding). Arrow splits the texts of a batch and numbers their distinct
chunks; ids are found once for each of these and put together by number. Plain words are remembered, the most
recent ones up to a fixed number.
"""
from __future__ import annotations

import sys
import zlib
from array import array
from functools import lru_cache

import numpy as np
import public_tokenizers
import pyarrow as pa
import pyarrow.compute as pc
from tokenizers import Tokenizer

from loomtrace.llm import base

VOCABULARY = "word_bpe_49k.json"


@lru_cache(maxsize=2)
def tokenizer(path: str) -> Tokenizer:
    """Each worker process reads the vocabulary file once."""
    return Tokenizer.from_file(path)


def vocabulary_path(name: str = VOCABULARY) -> str:
    return public_tokenizers.path(name)


#: A run of letters that are one code point each in either case and in NFC, and the closing marks behind it:
#: the splitter keeps the letters whole and cuts off the marks.
_WORD = "^[A-Za-z\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u00ff]+[.,!?;:]*$"
_CLOSING = ".,!?;:"


def printed_bytes() -> list[str]:
    """One printable character per byte: itself where printable, else the next free one from 256."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = iter(range(256, 512))
    return [chr(b) if b in plain else chr(next(spare)) for b in range(256)]


_PRINTED = dict(enumerate(printed_bytes()))
assert sys.byteorder == "little"  # ids are kept as they lie in files


def _runs(flat: np.ndarray, start: np.ndarray, length: np.ndarray) -> np.ndarray:
    """Stretches of `flat`, one after another."""
    ends = np.cumsum(length)
    return flat[np.repeat(start - ends + length, length) + np.arange(ends[-1] if len(ends) else 0)]


class Encoder:
    """Texts to arrays of token ids."""

    limit = 120_000

    def __init__(self, path: str):
        self.tokens = tokenizer(path)
        self.tokens.no_truncation()
        self.tokens.no_padding()
        self.kind = np.dtype("<u2" if self.tokens.get_vocab_size() <= 1 << 16 else "<u4")
        self.words = base.Memo(self.limit)

    def _of_words(self, words: list[str]) -> list[bytes]:
        """Ids of lower-case runs of letters."""
        code, tokenize = self.kind.char, self.tokens.model.tokenize
        for w in self.words.missing(set(words)):
            self.words.new[w] = array(code, [t.id for t in tokenize(w if w.isascii() else w.encode().decode("latin-1").translate(_PRINTED))]).tobytes()
        return [self.words.new[w] for w in words]

    def _of_others(self, chunks: list[str]) -> list[bytes]:
        code = self.kind.char
        return [array(code, e.ids).tobytes() for e in self.tokens.encode_batch_fast(chunks, add_special_tokens=False)]

    def _flat(self, parts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of all parts together, and where each starts and how long it is."""
        length = np.fromiter(map(len, parts), np.int64, len(parts)) // self.kind.itemsize
        return np.frombuffer(b"".join(parts), self.kind), np.cumsum(length) - length, length

    def _distinct(self, chunks: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Ids of distinct chunks."""
        plain = pc.match_substring_regex(chunks, _WORD).to_numpy(zero_copy_only=False)
        lower = pc.utf8_lower(chunks.filter(pa.array(plain)))
        word = pc.utf8_rtrim(lower, characters=_CLOSING)
        mark = pc.utf8_slice_codeunits(pc.replace_substring_regex(lower, "^[^.,!?;:]+", " "), 1).dictionary_encode()
        word = word.dictionary_encode()
        others = chunks.filter(pa.array(~plain)).to_pylist()
        words, marks = word.dictionary.to_pylist(), mark.dictionary.to_pylist()
        flat, start, length = self._flat([*self._of_words(words), *self._of_others([*marks, *others])])
        first, second = np.empty(len(chunks), np.int64), np.full(len(chunks), -1)
        first[plain], second[plain] = word.indices.to_numpy(), mark.indices.to_numpy() + len(words)
        first[~plain] = np.arange(len(others)) + len(words) + len(marks)
        pairs = np.stack([first, second], axis=1).ravel()
        sizes = np.where(pairs < 0, 0, length[pairs])
        whole = sizes.reshape(-1, 2).sum(axis=1)
        return _runs(flat, start[pairs], sizes), np.cumsum(whole) - whole, whole

    def batch(self, texts: pa.Array, end: int | None = None) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the texts of a string column one after another, each with `end`, and their bounds."""
        split = pc.ascii_split_whitespace(pc.fill_null(texts, "").cast(pa.large_string()))
        bounds = split.offsets.to_numpy() - split.offsets[0].as_py()
        coded = split.flatten().dictionary_encode()
        flat, start, length = self._distinct(coded.dictionary.cast(pa.large_string()))
        at = coded.indices.to_numpy()
        if end is not None:  # one more chunk at the end of each text
            flat, start, length = np.append(flat, np.array([end], self.kind)), np.append(start, len(flat)), np.append(length, 1)
            at = np.insert(at.astype(np.int64), bounds[1:], len(start) - 1)
            bounds = bounds + np.arange(len(bounds))
        size = length[at]
        return _runs(flat, start[at], size), np.concatenate([[0], np.cumsum(size)])[bounds]

    def ids(self, text: bytes | None, end: int | None = None) -> np.ndarray:
        """Ids of one whole text, then `end`."""
        return self.batch(pa.array([text], pa.binary()).cast(pa.string()), end)[0]


def crc32(ids: np.ndarray) -> int:
    """Of the ids as little-endian unsigned 32-bit integers."""
    return zlib.crc32(ids.astype("<u4").tobytes())
