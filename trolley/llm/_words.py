"""Words of many texts at once, as numpy arrays over their UTF-8 bytes.

A word is a run of bytes other than space and TAB..CR; A-Z count as a-z where texts are compared.  All of
these are single bytes in UTF-8, so no decoding is needed.  Texts are taken in chunks of a few megabytes,
which bounds memory whatever the size of an Arrow batch; a text is never cut.
"""

from __future__ import annotations

import ctypes
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK_BYTES = 1 << 19
CHUNK_TEXTS = 4096

_BYTES = np.arange(256, dtype=np.uint8)
IS_SPACE = (_BYTES == 0x20) | ((_BYTES >= 0x09) & (_BYTES <= 0x0D))
LOWER = np.where((_BYTES >= 65) & (_BYTES <= 90), _BYTES + 32, _BYTES).astype(np.uint8)
_BYTE_CODE = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.uint64(1)
_LOWER_CODE = _BYTE_CODE[LOWER]
_BASE = 0x9E3779B97F4A7C15 | 5
_INVERSE = pow(_BASE, -1, 1 << 64)
_POWERS = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS[0]) < n:
        size = max(n, CHUNK_BYTES * 2)
        for k, base in enumerate((_BASE, _INVERSE)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[k] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS[0], _POWERS[1]


def mix(x: np.ndarray) -> np.ndarray:
    """Scramble 64-bit numbers, one to one."""
    x = x ^ (x >> np.uint64(30))
    x = x * np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


@dataclass
class Words:
    """Words of a chunk of texts; ``first[i]:first[i + 1]`` are those of text i."""

    buffer: np.ndarray  # bytes of all texts, a line feed after each
    offsets: np.ndarray  # where text i starts in the buffer; one more for the end
    starts: np.ndarray
    ends: np.ndarray
    doc: np.ndarray
    first: np.ndarray

    @classmethod
    def of(cls, texts: list[bytes]) -> Words:
        lengths = np.fromiter((len(t) + 1 for t in texts), np.int64, len(texts))
        offsets = np.concatenate(([0], np.cumsum(lengths)))
        buffer = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)[: offsets[-1]]
        inside = np.zeros(len(buffer) + 2, np.int8)
        inside[1:-1] = ~IS_SPACE[buffer]
        edges = np.flatnonzero(inside[1:] != inside[:-1])
        starts, ends = edges[0::2], edges[1::2]
        first = np.searchsorted(starts, offsets)
        doc = np.repeat(np.arange(len(texts)), np.diff(first))
        return cls(buffer, offsets, starts, ends, doc, first)

    def hashes(self, lower: bool = True) -> np.ndarray:
        """A 64-bit hash of each word, the same wherever the word stands."""
        up, down = _powers(len(self.buffer) + 1)
        code = (_LOWER_CODE if lower else _BYTE_CODE)[self.buffer]
        code *= up[: len(code)]
        total = np.zeros(len(code) + 1, np.uint64)
        np.cumsum(code, out=total[1:])
        return mix((total[self.ends] - total[self.starts]) * down[self.starts])

    def ngrams(self, words: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
        """Hashes of all n-word windows and the text of each."""
        count = len(words) - n + 1
        if count <= 0:
            return np.zeros(0, np.uint64), np.zeros(0, np.int64)
        inside = self.doc[:count] == self.doc[n - 1 :]
        at = np.flatnonzero(inside)
        return fold([words[at + k] for k in range(n)]), self.doc[at]

    def counts(self) -> np.ndarray:
        return np.diff(self.first)


def fold(parts: list[np.ndarray]) -> np.ndarray:
    """One hash from an ordered list of hashes."""
    total = np.zeros_like(parts[0])
    for part in parts:
        total = mix(total * np.uint64(0xD6E8FEB86659FD93) + part + np.uint64(0x632BE59BD9B4E019))
    return total


def texts_of(batch: pa.RecordBatch, column: int) -> list[bytes]:
    """UTF-8 bytes of a text column, null as empty."""
    return [t or b"" for t in batch.column(column).cast(pa.binary()).to_pylist()]


_trim = getattr(ctypes.CDLL(None), "malloc_trim", None)  # of the GNU C library alone


def give_back() -> None:
    """Return freed memory to the system: a worker lives on through all later stages, and each would add its own leavings."""
    pa.default_memory_pool().release_unused()
    if _trim:
        _trim(0)


def chunks(
    batches: Iterator[pa.RecordBatch], text: int, limit: int = CHUNK_BYTES
) -> Iterator[tuple[pa.RecordBatch, list[bytes]]]:
    """Slices of the batches with at most ``limit`` bytes of text and CHUNK_TEXTS texts, or one longer text.

    After each batch the memory that it took is given back.
    """
    for batch in batches:
        if not batch.num_rows:
            continue
        sizes = pc.binary_length(batch.column(text)).fill_null(0).to_numpy(zero_copy_only=False)
        total, start = 0, 0
        for i, size in enumerate(sizes):
            if i > start and (total + size > limit or i - start >= CHUNK_TEXTS):
                part = batch.slice(start, i - start)
                yield part, texts_of(part, text)
                start, total = i, 0
            total += size + 1
        part = batch.slice(start)
        yield part, texts_of(part, text)
        del part, batch
        give_back()


_ASCII_MARK = (_BYTES < 128) & ~np.array([chr(b).isalnum() for b in range(256)])
_PLAIN = np.where(_ASCII_MARK, 32, LOWER).astype(np.uint8).tobytes()


def plain_words(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """Words as runs of letters, digits and non-ASCII bytes, A-Z read as a-z, and their hashes."""
    words = Words.of([t.translate(_PLAIN) for t in texts])
    return words, words.hashes(lower=False)


def look_up(table: np.ndarray, keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions of the keys that stand in a sorted table, and where they stand in it."""
    if not len(table) or not len(keys):
        return np.zeros(0, np.int64), np.zeros(0, np.int64)
    at = np.minimum(np.searchsorted(table, keys), len(table) - 1)
    hit = np.flatnonzero(table[at] == keys)
    return hit, at[hit]
