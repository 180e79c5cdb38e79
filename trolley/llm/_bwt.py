"""Burrows-Wheeler transforms of small collections of byte strings, and their merging without sorting suffixes again.

Symbols are ``STEP`` bytes wide: the symbol of a suffix is a 64-bit hash of its first STEP bytes, the suffix after it
begins STEP bytes on, and symbols are ordered by their hashes.  So a transform has one entry per byte of the
strings and one for each string's end: the symbol before each suffix, in the order of the suffixes.  A suffix of
less than STEP bytes begins with a terminator of its own, which is below all symbols and equal to nothing.

Merging (interleave refinement).  The merged order of the suffixes of several transforms is given by an interleave:
which transform the next suffix comes from.  Start with all suffixes in one block, transform after transform.  One round
reads the symbols before the suffixes in the present order and puts each entry stably into the bucket of its symbol:
if the suffixes were ordered by their first h bytes, they are now ordered by their first h + STEP.  Where neighbours come from
different buckets or different blocks, a block boundary appears, at a place that never moves again, and their common
prefix is known to a multiple of STEP.  Blocks left after DEPTH / STEP rounds are the repeated intervals.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

from trolley.llm._words import _powers, mix

STEP = 100

_CODE = np.random.default_rng(20251204).integers(1, 1 << 63, (2, 256), dtype=np.uint64) * np.uint64(2) + np.uint64(1)


class Hashes:
    """Hashes of substrings of a buffer, the same wherever a substring stands."""

    def __init__(self, buffer: np.ndarray, which: int = 0) -> None:
        self._up, self._down = _powers(len(buffer) + 1)
        self._total = np.zeros(len(buffer) + 1, np.uint64)
        np.cumsum(_CODE[which][buffer] * self._up[: len(buffer)], out=self._total[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self._total[end] - self._total[start]) * self._down[start] + (end - start).astype(np.uint64))

    def every(self, size: int) -> np.ndarray:
        """Another hash, of all substrings of one size; its high bits are the better ones."""
        n = max(len(self._total) - size, 0)
        found = self._total[size:] - self._total[:n]
        found *= self._down[:n]
        return found


#: A suffix of a transform, its rank and the rank after it are packed into one number, so it has at most 2 ** 21 of them.
_LOW, _HIGH, _PLACE = np.uint64(21), np.uint64(42), np.uint64((1 << 21) - 1)


@dataclass
class Transform:
    """Symbols before the suffixes of some strings, in suffix order, and which suffix each entry is.

    Suffix p of string k is number ``starts[k] + p`` with ``starts`` counting len + 1 for each string.
    """

    before: np.ndarray  # 0 before the suffixes that have no whole symbol before them
    suffix: np.ndarray

    @classmethod
    def of(cls, strings: list[bytes]) -> Transform:
        sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
        first = np.repeat(np.cumsum(sizes) - sizes, sizes)
        last = first + np.repeat(sizes, sizes) - 1
        at = np.arange(len(first))
        buffer = np.frombuffer(b"\0".join(strings) + b"\0", np.uint8)
        whole = at + STEP <= last
        symbol = np.zeros(len(at), np.uint64)
        symbol[: max(len(at) - STEP + 1, 0)] = Hashes(buffer).every(STEP) | np.uint64(1)
        symbol[~whole] = 0
        # ranks of suffixes by one symbol, then two, four, ... until they are ranked by all of their bytes
        ends, others = np.flatnonzero(~whole), np.flatnonzero(whole)
        order = np.concatenate((ends, others[np.argsort(symbol[others])]))
        new = np.ones(len(at), bool)
        new[len(ends) + 1 :] = np.diff(symbol[order[len(ends) :]]) != 0  # terminators differ
        rank = np.empty(len(at), np.uint64)
        rank[order] = np.cumsum(new) - 1
        place, after, width = at.astype(np.uint64), np.empty(len(at), np.uint64), STEP
        while width < sizes.max(initial=0) and not new.all():
            after[:] = 0
            after[: max(len(at) - width, 0)] = rank[width:]  # past an end: that suffix is alone already
            packed = np.sort((rank << _HIGH) | (after << _LOW) | place)
            order = (packed & _PLACE).astype(np.int64)
            new[1:] = np.diff(packed >> _LOW) != 0
            rank[order] = np.cumsum(new) - 1
            width *= 2
        suffix = order
        before = np.zeros(len(at), np.uint64)
        inside = suffix - STEP >= first[suffix]
        before[inside] = symbol[suffix[inside] - STEP]
        return cls(before, suffix)


def merge(transforms: list[Transform], depth: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The interleave of the suffixes ordered by their first ``depth`` bytes, the entry of each, and the bytes, in
    whole steps, that each shares with the one before it (``depth`` where that is as much or more)."""
    sizes = [len(t.before) for t in transforms]
    before = np.concatenate([t.before for t in transforms])
    ends = int(np.count_nonzero(before == 0))
    order = np.argsort(before)
    symbol = np.empty(len(before), np.uint64)
    symbol[order] = np.cumsum(np.diff(before[order], prepend=before[order[:1]]) != 0).astype(np.uint64) << np.uint64(32)
    narrow = np.uint8 if len(sizes) <= 256 else np.uint16
    source = np.repeat(np.arange(len(sizes), dtype=narrow), sizes)
    n = len(source)
    place = np.arange(n, dtype=np.uint64)
    block, common = np.zeros(n, np.int32), np.full(n, depth, np.int32)
    common[:1] = 0
    own = np.empty(n, np.uint64)
    for done in range(0, depth, STEP):
        own[np.argsort(source, kind="stable")] = symbol  # each transform's entries, in its order
        moved = np.sort(own | place)  # stable: by symbol, then by present place
        to = moved.astype(np.uint32)
        bucket = (moved >> np.uint64(32)).astype(np.uint32)
        source, block = source[to], block[to]
        new = np.ones(n, bool)
        new[1:] = (bucket[1:] != bucket[:-1]) | (block[1:] != block[:-1])
        new[:ends] = True  # terminators are alone
        common[new & (common == depth)] = done
        block = np.cumsum(new, dtype=np.int32)
    entry = np.empty(n, np.int64)
    entry[np.argsort(source, kind="stable")] = np.concatenate([np.arange(s) for s in sizes])
    return source, entry, common
