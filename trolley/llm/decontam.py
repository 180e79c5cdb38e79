"""Benchmark decontamination: n-gram seeds that no alignment avoids, then Smith-Waterman alignment.

Words are runs of letters, digits and non-ASCII bytes, A-Z read as a-z; in scripts written without spaces (Chinese,
Japanese, Thai, Lao, Burmese, Khmer) every character is a word, and ideographic punctuation none.  An alignment that reaches LEAST_SHARE
keeps at least ``least_grams`` of the item's word pairs whole, so that many less one places of an item can be left
out and each such alignment still holds one of the others: these are the seeds.  Left out are the places that would
bring the most candidates; how often each n-gram of the benchmark occurs in all documents is counted first.  Where a
document holds a seed, the words around it, as far as such an alignment can reach, are a candidate.  Those that hold
``least_grams`` of the item's n-grams are aligned with the whole item; the best local alignment, as a share of the
item's perfect score, decides.  So the result is that of aligning all pairs.

Documents are not shuffled: the benchmark goes to the tasks in blocks of at most BLOCK_ITEMS items, one pass for
each block.  Items with fewer than MIN_WORDS words, two characters of the scripts above counted as one, are too
short for a share to tell: only their whole word sequence is searched, with share 1.  Null and empty texts hold
nothing, and items without a word stand nowhere.  Repeated documents and repeated items each give their own rows; empty tables give none; other
columns are passed on or not read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trolley.llm._store import small_batches
from trolley.llm._words import Words, chunks, fold, look_up, plain_words

#: With longer n-grams an item whose every third word is replaced (share 0.5) would hold none.
N = 2
MIN_WORDS = 8
#: Items in one block, and bytes of their texts beyond which a block is cut smaller.
BLOCK_ITEMS = 20_000
BLOCK_BYTES = 32_000_000
MATCH, MISMATCH, GAP = 2, -1, -2
#: Least share of the perfect score.
LEAST_SHARE = 0.4
#: Cells of one batch of alignments, which bounds its memory.
BATCH_CELLS = 1 << 21
#: Seed hits and words of candidates that are looked at together, which bounds their memory.
BATCH_HITS = 1 << 17


#: UTF-8 bytes of the scripts without spaces: Thai, Lao; Burmese, Khmer; kana, ideographs in three places.
_LONE = re.compile(
    rb"(?:\xe0[\xb8-\xbb]|\xe1[\x80-\x82\x9e\x9f]|\xe3[\x81-\xbf]|[\xe4-\xe9][\x80-\xbf]|\xef[\xa4-\xab]"
    rb"|\xf0[\xa0-\xb3][\x80-\xbf])[\x80-\xbf]")
#: Ideographic punctuation (U+3000 to U+3020 without the marks 3005 to 3007), and the wide forms of ASCII marks.
_WIDE_MARK = re.compile(
    rb"\xe3\x80[\x80-\x84\x88-\xa0]|\xef\xbc[\x81-\x8f\x9a-\xa0\xbb-\xbf]|\xef\xbd[\x80\x9b-\xa5]")
_HIGH = re.compile(rb"[\xe0-\xf0]")


def _words(texts: list[bytes]) -> tuple[Words, np.ndarray]:
    """The words of the texts and their hashes."""
    return plain_words([_LONE.sub(rb" \g<0> ", _WIDE_MARK.sub(b" ", t)) if _HIGH.search(t) else t for t in texts])


def least_grams(length: np.ndarray) -> np.ndarray:
    """N-grams (word pairs) of an item of so many words that any alignment reaching LEAST_SHARE keeps whole.

    Each edit breaks one pair of neighbouring matches at most.  Fewest pairs are left by replaced words, which cost
    least: ``kept`` words match, the others are replaced.  At least 1 for MIN_WORDS words.
    """
    kept = length * (MATCH * LEAST_SHARE - MISMATCH) / (MATCH - MISMATCH)
    return np.maximum(np.ceil(2 * kept - length - 1 - 1e-9).astype(np.int64), 1)


def _ranges(starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The numbers from each start on, as many as its size says, and the range each belongs to."""
    which = np.repeat(np.arange(len(sizes)), sizes)
    return np.arange(len(which)) + (starts - np.cumsum(sizes) + sizes)[which], which


def _portions(sizes: np.ndarray, limit: int) -> Iterator[slice]:
    """Consecutive slices whose sizes sum up to ``limit`` at most, or hold one larger entry."""
    ends = np.cumsum(sizes)
    start = 0
    while start < len(sizes):
        stop = max(int(np.searchsorted(ends, (ends[start - 1] if start else 0) + limit, "right")), start + 1)
        yield slice(start, stop)
        start = stop


@dataclass
class Benchmark:
    """A block of items as word hashes, its n-grams as a sorted table, and where they are seeds."""

    ids: list  # those of the items, then those of the short ones
    items: list[np.ndarray]
    short: dict[int, tuple[np.ndarray, np.ndarray]]  # by words: sorted hashes of short items and their places in ids
    lengths: np.ndarray
    grams: np.ndarray  # sorted distinct n-gram hashes
    codes: np.ndarray  # the n-grams of all items, one item after the other, as positions in grams
    begins: np.ndarray  # those of item k are codes[begins[k]:begins[k + 1]]
    first: np.ndarray  # grams[i] is a seed at entries first[i]:first[i + 1]
    item: np.ndarray
    place: np.ndarray

    @classmethod
    def of(cls, ids: list, texts: list[bytes]) -> Benchmark:
        words, hashes = _words(texts)
        counts = words.counts()
        worth = counts - np.array([len(_LONE.findall(t)) for t in texts], np.int64) // 2
        long = (worth >= MIN_WORDS) & (counts >= MIN_WORDS)
        kept = np.flatnonzero(long)
        few = np.flatnonzero(~long & (counts > 0))
        short = {}
        for n in np.unique(counts[few]).tolist():
            own = np.flatnonzero(counts[few] == n)
            whole = fold([hashes[words.first[few[own]] + j] for j in range(n)])
            order = np.argsort(whole, kind="stable")
            short[n] = whole[order], len(kept) + own[order]
        at, which = _ranges(words.first[kept], counts[kept] - N + 1)
        grams, codes = np.unique(fold([hashes[at + j] for j in range(N)]), return_inverse=True)
        begins = np.concatenate(([0], np.cumsum(counts[kept] - N + 1)))
        items = [hashes[words.first[i] : words.first[i + 1]] for i in kept]
        whole = cls([ids[i] for i in [*kept, *few]], items, short, counts[kept], grams, codes, begins, *[np.zeros(0, np.int64)] * 3)
        return whole._with(np.arange(len(codes)), which)

    def _with(self, entries: np.ndarray, which: np.ndarray) -> Benchmark:
        """The same with seeds at these entries of ``codes``; ``which`` has the item of every entry."""
        entries = entries[np.argsort(self.codes[entries], kind="stable")]
        first = np.searchsorted(self.codes[entries], np.arange(len(self.grams) + 1))
        item = which[entries]
        return replace(self, first=first, item=item, place=entries - self.begins[item])

    def seeds(self, counts: np.ndarray) -> Benchmark:
        """Without the costliest n-grams as seeds; ``counts`` are those of ``grams`` in the documents."""
        cost = (counts * np.bincount(self.codes, minlength=len(self.grams)))[self.codes]
        which = np.repeat(np.arange(len(self.items)), np.diff(self.begins))
        order = np.lexsort((-cost, which))
        rank = np.arange(len(order)) - self.begins[which]
        return self._with(order[rank >= least_grams(self.lengths)[which] - 1], which)


def _align(items: list[np.ndarray], windows: list[np.ndarray]) -> np.ndarray:
    """Best local alignment score of each pair; all pairs advance together, an item's word at a time."""
    rows, width = max(map(len, items)), max(map(len, windows))
    item = np.zeros((len(items), rows), np.uint64)
    window = np.ones((len(items), width), np.uint64)
    valid = np.zeros((len(items), rows), bool)
    for k, (a, b) in enumerate(zip(items, windows)):
        item[k, : len(a)], valid[k, : len(a)] = a, True
        window[k, : len(b)] = b
    slope = -GAP * np.arange(width, dtype=np.int32)
    above = np.zeros((len(items), width), np.int32)
    best = np.zeros(len(items), np.int32)
    for i in range(rows):
        same = (window == item[:, i, None]) & valid[:, i, None]
        here = np.where(same, MATCH, MISMATCH).astype(np.int32)
        here[:, 1:] += above[:, :-1]
        np.maximum(here, above + GAP, out=here)
        np.maximum(here, 0, out=here)
        here += slope  # a gap along the row costs the same per word, so a running maximum carries it
        np.maximum.accumulate(here, axis=1, out=here)
        here -= slope
        np.maximum(best, here.max(axis=1), out=best)
        above = here
    return best


def _enough(
    bench: Benchmark, code: np.ndarray, item: np.ndarray, low: np.ndarray, high: np.ndarray
) -> np.ndarray:
    """Which candidates hold ``least_grams`` of their item's n-grams; ``code`` has the n-gram at each word, or -1."""
    need = least_grams(bench.lengths)[item]
    inside, own = np.maximum(high - low - N + 1, 0), np.diff(bench.begins)[item]
    out = np.zeros(len(item), bool)
    for part in _portions(inside + own, BATCH_HITS):
        at, which = _ranges(low[part], inside[part])
        here = np.flatnonzero(code[at] >= 0)
        there = np.unique(which[here] * len(bench.grams) + code[at[here]])
        entry, which = _ranges(bench.begins[item[part]], own[part])
        hit, _ = look_up(there, which * len(bench.grams) + bench.codes[entry])
        out[part] = np.bincount(which[hit], minlength=len(own[part])) >= need[part]
    return out


def _found_short(words: Words, hashes: np.ndarray, bench: Benchmark) -> list[tuple[int, int, float]]:
    """(text, item, 1) of every pair of a text and a short item whose words stand in it one after the other."""
    pairs = set()
    for n, (table, item) in bench.short.items():
        sequences, doc = words.ngrams(hashes, n)
        left, right = (np.searchsorted(table, sequences, side) for side in ("left", "right"))
        entry, which = _ranges(left, right - left)
        pairs.update(zip(doc[which].tolist(), item[entry].tolist()))
    return [(d, k, 1.0) for d, k in sorted(pairs)]


def _found(texts: list[bytes], bench: Benchmark) -> list[tuple[int, int, float]]:
    """(text, item, share) of every pair that reaches LEAST_SHARE."""
    words, hashes = _words(texts)
    out = _found_short(words, hashes, bench)
    if len(hashes) < N or not bench.items:
        return out
    windows = fold([hashes[j : len(hashes) - N + 1 + j] for j in range(N)])
    hit, gram = look_up(bench.grams, windows)
    inside = words.doc[hit] == words.doc[hit + N - 1]
    hit, gram = hit[inside], gram[inside]
    code = np.full(len(windows), -1, np.int64)
    code[hit] = gram
    many = np.diff(bench.first)[gram]
    keys = [np.zeros(0, np.int64)]
    cells = 4 * len(hashes) + 4  # from -2 per word on
    for part in _portions(many, BATCH_HITS):
        entry, which = _ranges(bench.first[gram[part]], many[part])
        at, item = hit[part][which], bench.item[entry]
        # hits of one pair whose items would begin within half an item of each other share a window
        cell = np.floor_divide(at - bench.place[entry] - words.first[words.doc[at]], bench.lengths[item] // 2)
        keys.append(np.unique((words.doc[at] * len(bench.items) + item) * cells + cell + cells // 2))
    pair, cell = np.divmod(np.unique(np.concatenate(keys)), cells)
    doc, item = np.divmod(pair, len(bench.items))
    length, half = bench.lengths[item], bench.lengths[item] // 2
    reach = ((1 - LEAST_SHARE) * length + 1e-9).astype(np.int64)  # more words inserted cost too much
    begin = (cell - cells // 2) * half + words.first[doc]
    low = np.maximum(begin - reach, words.first[doc])
    high = np.minimum(begin + half + length + reach, words.first[doc + 1])
    kept = _enough(bench, code, item, low, high)
    doc, item, low, high = doc[kept], item[kept], low[kept], high[kept]
    half = bench.lengths[item] // 2
    order = np.argsort(half, kind="stable")
    scores = np.zeros(len(order))
    start = 0
    while start < len(order):
        stop = start + 1
        while stop < len(order) and (stop - start + 1) * (6 * half[order[stop]] + 2) <= BATCH_CELLS // 8:
            stop += 1
        own = order[start:stop]
        pairs = [bench.items[item[k]] for k in own]
        score = _align(pairs, [hashes[low[k] : high[k]] for k in own])
        scores[own] = score / (MATCH * np.array([len(p) for p in pairs]))
        start = stop
    best: dict[tuple[int, int], float] = {}
    for d, k, s in zip(doc.tolist(), item.tolist(), scores.tolist()):
        if s >= LEAST_SHARE:
            best[d, k] = max(s, best.get((d, k), 0.0))
    return out + [(d, k, s) for (d, k), s in sorted(best.items())]


def _counted(docs: DataFrame, bench: Benchmark, text_column: str) -> np.ndarray:
    """Occurrences of each benchmark n-gram in all documents."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(len(bench.grams), np.int64)
        for _, texts in chunks(batches, 0):
            words, hashes = _words(texts)
            grams, _ = words.ngrams(hashes, N)
            _, which = look_up(bench.grams, grams)
            total += np.bincount(which, minlength=len(total))
        some = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(total[some])], names=["gram", "n"])

    rows = docs.select(docs[text_column].alias("text")).mapInArrow(run, "gram long, n long")
    counts = np.zeros(len(bench.grams), np.int64)
    for r in rows.groupBy("gram").agg(F.sum("n").alias("n")).collect():  # one row for each gram of the block at most
        counts[r["gram"]] = r["n"]
    return counts


def index(
    docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id",
    item_text: str = "text",
) -> list[Benchmark]:
    """The benchmark in blocks, each with its seeds chosen by counts over all ``docs``."""
    small_batches(docs.sparkSession)
    items = benchmark.select(benchmark[item_column].alias("id"), benchmark[item_text].alias("text"))
    items = items.filter(F.col("text").isNotNull())
    size = items.agg(F.count("*").alias("n"), F.sum(F.octet_length("text")).alias("b")).first()
    blocks = max(1, -(-size["n"] // BLOCK_ITEMS), -(-(size["b"] or 0) // BLOCK_BYTES))
    out = []
    for k in range(blocks):
        part = items.filter(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == k).orderBy("id", "text").collect()
        bench = Benchmark.of([r["id"] for r in part], [r["text"].encode() for r in part])
        out.append(bench.seeds(_counted(docs, bench, text_column)) if bench.items else bench)
    return out


def contaminated(
    docs: DataFrame, blocks: list[Benchmark], id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """One row for each document row and item found in it: ``id_column``, item_id and share of the perfect score."""
    small_batches(docs.sparkSession)
    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()

    def search(bench: Benchmark):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in chunks(batches, 1):
                found = _found(texts, bench)
                ids = part.column(0).take(pa.array([d for d, _, _ in found], pa.int64()))
                items = pa.array([bench.ids[k] for _, k, _ in found], pa.int64())
                shares = pa.array([s for *_, s in found], pa.float64())
                yield pa.RecordBatch.from_arrays([ids, items, shares], names=["id", "item_id", "share"])

        return rows.mapInArrow(run, f"id {kind}, item_id long, share double")

    out = search(blocks[0])
    for bench in blocks[1:]:
        out = out.unionAll(search(bench))
    return out.withColumnRenamed("id", id_column)


def clean(docs: DataFrame, blocks: list[Benchmark], text_column: str = "text") -> DataFrame:
    """The rows that hold no item, with all their columns."""
    small_batches(docs.sparkSession)
    text = docs.columns.index(text_column)

    def drop(bench: Benchmark):
        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for part, texts in chunks(batches, text):
                keep = np.ones(len(texts), bool)
                keep[[d for d, _, _ in _found(texts, bench)]] = False
                yield part.filter(pa.array(keep))

        return run

    for bench in blocks:
        docs = docs.mapInArrow(drop(bench), docs.schema)
    return docs
