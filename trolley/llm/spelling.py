"""Spelling variants: words that one inserted, deleted or replaced letter turns into a much more frequent one.

Words are runs of letters (A-Z, a-z, U+00C0 to U+00FF), A-Z read as a-z, counted over all whole texts.

PartEnum.  The letters of a word with their repeats are a set: ("a", 0), ("a", 1), ("b", 0) ...  One edit changes at
most two members, so the sets of near words, as binary vectors, have Hamming distance two at most.  The members are
dealt to ``PARTS`` parts.  Two members lie in at most two parts, so near words agree on all parts but some two: each word
sends one signature for every two parts left out, a hash of the members of all others.  Words that share a
signature meet by an equi-join on it.  This loses no pair.  Within a signature, words are compared if they
agree on their first or their second half too, as one edit leaves one half alone, and each pair is then verified letter by
letter.  A pair is counted under one signature only: that whose two parts left out are those of the changed members.

Size.  Texts are counted in their tasks first, so a word in a third of all rows sends one row per portion of texts.
What meets in a signature are distinct words, one row each: no copy of a text or a row adds to a group, and a
word has no more near words than its length and the alphabet allow.  Tasks take their signatures in order, in portions of
whole signatures.  Words have ids in code-point order, so that ties need no text.  Following forms to the last one
takes a few joins: each step goes to a word that is ``RATIO`` times as frequent, and steps are doubled each time.

Rows.  Null and empty texts have no word.  Deletion of letters (``spoil``) reads the document's id as text, null as "".
Words of any length are taken; those above 64 letters are verified one pair at a time.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trolley.llm._store import stored
from trolley.llm._words import LOWER, _powers, chunks, mix

PARTS = 5
#: A form is this many times as frequent as its variant.
RATIO = 10
#: Words with fewer code points or occurrences are left out.
MIN_LETTERS = 7
MIN_COUNT = 2
#: Rows of signatures that a task compares at a time, and distinct words that it counts at a time.
PORTION = 100_000
COUNTED = 200_000

_RUN = re.compile("[a-zÀ-ÿ]{%d,}" % MIN_LETTERS)  # shorter runs cannot give a word
_LOWER = LOWER.tobytes()
_WIDE = 64

_LEFT_OUT = list(combinations(range(PARTS), 2))
_OWNER = np.zeros((PARTS, PARTS), np.int64)  # the signature under which a change in these parts is counted
for _a in range(PARTS):
    for _b in range(PARTS):
        _own = (min(_a, _b), max(_a, _b)) if _a != _b else (0, _a) if _a else (0, 1)
        _OWNER[_a, _b] = _LEFT_OUT.index(_own)


def spoil(run: str, crc: int) -> str:
    """The run without one letter, if 31 divides the checksum."""
    if crc % 31:
        return run
    at = crc % len(run)
    return run[:at] + run[at + 1 :]


def count_words(docs: DataFrame) -> DataFrame:
    """(word, n) of all words of ``docs`` (doc_id, text) that are long and frequent enough."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total: Counter[str] = Counter()

        def rows() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(
                [pa.array(total.keys(), pa.string()), pa.array(total.values(), pa.int64())], ["word", "n"])

        for part, texts in chunks(batches, 1):
            for name, text in zip(part.column(0).to_pylist(), texts):
                prefix = zlib.crc32(f"{name or ''}:".encode())
                for run, n in Counter(_RUN.findall(text.translate(_LOWER).decode())).items():
                    word = spoil(run, zlib.crc32(run.encode(), prefix))
                    if len(word) >= MIN_LETTERS:
                        total[word] += n
            if len(total) >= COUNTED:
                yield rows()
                total.clear()
        yield rows()

    texts = docs.select(F.col("doc_id").cast("string"), "text")
    counted = texts.mapInArrow(count, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))
    return counted.filter(F.col("n") >= MIN_COUNT)


class _Letters:
    """Words as Latin-1 bytes behind one another."""

    def __init__(self, words: list[str]) -> None:
        coded = [w.encode("latin-1") for w in words]
        self.buffer = np.frombuffer(b"".join(coded), np.uint8)
        self.size = np.fromiter(map(len, coded), np.int64, len(coded))
        self.start = np.cumsum(self.size) - self.size
        self.word = np.repeat(np.arange(len(coded)), self.size)

    def table(self, widest: int) -> np.ndarray:
        """A row of letters per word, zero behind its end; letters after ``widest`` are left out."""
        width = min(widest, int(self.size.max(initial=0))) + 1
        rows = np.zeros((len(self.size), width), np.uint8)
        at = np.arange(len(self.buffer)) - self.start[self.word]
        inside = at < width - 1
        rows[self.word[inside], at[inside]] = self.buffer[inside]
        return rows

    def pieces(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """A hash of the letters from start to end of each word."""
        up, down = _powers(len(self.buffer) + 1)
        total = np.zeros(len(self.buffer) + 1, np.uint64)
        np.cumsum(mix(self.buffer.astype(np.uint64) + np.uint64(1)) * up[: len(self.buffer)], out=total[1:])
        return mix((total[self.start + end] - total[self.start + start]) * down[self.start + start])


def _member(letter: np.ndarray, nth: np.ndarray) -> np.ndarray:
    """A hash of the nth occurrence of a letter as a member of the set."""
    return mix(mix(letter.astype(np.uint64) + np.uint64(1)) + nth.astype(np.uint64))


def _part(member: np.ndarray) -> np.ndarray:
    return ((member >> np.uint64(32)) % np.uint64(PARTS)).astype(np.int64)


def signatures_of(words: list[str]) -> np.ndarray:
    """One row per word, one signature per two parts left out."""
    letters = _Letters(words)
    order = np.lexsort((letters.buffer, letters.word))
    word, letter = letters.word[order], letters.buffer[order]
    first = np.flatnonzero((np.diff(word, prepend=-1) != 0) | (np.diff(letter.astype(np.int64), prepend=-1) != 0))
    nth = np.arange(len(word)) - np.repeat(first, np.diff(np.append(first, len(word))))
    member = _member(letter, nth)
    sums = np.zeros((len(words), PARTS), np.uint64)
    np.add.at(sums, (word, _part(member)), mix(member))
    whole = sums.sum(axis=1, dtype=np.uint64)
    return np.stack([mix(mix(whole - sums[:, a] - sums[:, b]) + np.uint64(k)) for k, (a, b) in enumerate(_LEFT_OUT)], axis=1)


def _signed(words: DataFrame) -> DataFrame:
    """A row per word and signature."""

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            some = signatures_of(batch.column(1).to_pylist())
            rows = np.repeat(np.arange(batch.num_rows), len(_LEFT_OUT))
            which = np.tile(np.arange(len(_LEFT_OUT), dtype=np.int32), batch.num_rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(some.ravel().view(np.int64)), pa.array(which), *(c.take(pa.array(rows)) for c in batch.columns)],
                ["signature", "left_out", "id", "word", "n"])

    return words.select("id", "word", "n").mapInArrow(
        sign, "signature long, left_out int, id long, word string, n long")


def _one_edit(a: str, b: str) -> tuple[str, ...] | None:
    """The letters in which two words differ if they differ by exactly one edit; ``a`` is not the longer."""
    p = next((k for k in range(len(a)) if a[k] != b[k]), len(a))
    if len(a) == len(b):
        return (a[p], b[p]) if p < len(a) and a[p + 1 :] == b[p + 1 :] else None
    return (b[p],) if a[p:] == b[p + 1 :] else None


def near_pairs(group: np.ndarray, left_out: np.ndarray, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Pairs of rows of one group whose words are one edit apart and are counted under this group's signature."""
    letters = _Letters(words)
    table = letters.table(_WIDE)
    size, zero = letters.size, np.zeros(len(words), np.int64)
    half, less = size // 2, (size - 1) // 2
    keys, rows = [], []
    # a word as the shorter of two or one of equal length, then as the longer one: its first half, its second half
    sides = [(size, zero, half, 0), (size, half, size, 1), (size - 1, zero, less, 0), (size - 1, less + 1, size, 1)]
    for length, start, end, side in sides:
        code = mix(group.astype(np.uint64)) + (length * 2 + side).astype(np.uint64)
        keys.append(mix(mix(code) + letters.pieces(start, end)))
        rows.append(np.arange(len(words)))
    key, row = np.concatenate(keys), np.concatenate(rows)
    order = np.argsort(key, kind="stable")
    key, row = key[order], row[order]
    found_a, found_b = [np.zeros(0, np.int64)], [np.zeros(0, np.int64)]
    at, step = np.arange(len(key) - 1), 1
    while len(at):
        at = at[at + step < len(key)]
        at = at[key[at] == key[at + step]]
        a, b = row[at], row[at + step]
        swap = size[a] > size[b]
        a, b = np.where(swap, b, a), np.where(swap, a, b)
        near = _verified(table, letters.size, words, left_out, a, b)
        found_a.append(a[near])
        found_b.append(b[near])
        step += 1
    pairs = np.unique(np.stack([np.concatenate(found_a), np.concatenate(found_b)]), axis=1)
    return pairs[0], pairs[1]


def _verified(
    table: np.ndarray, size: np.ndarray, words: list[str], left_out: np.ndarray, a: np.ndarray, b: np.ndarray
) -> np.ndarray:
    """Which pairs (the first not the longer) are one edit apart and belong to their signature."""
    close = (a != b) & (size[b] - size[a] <= 1)
    short = np.flatnonzero(close & (size[b] <= _WIDE))
    good = [short[_verified_short(table, size, left_out, a[short], b[short])]]
    for k in np.flatnonzero(close & (size[b] > _WIDE)).tolist():
        x, y = words[a[k]], words[b[k]]
        changed = _one_edit(x, y)
        if changed:
            parts = [_part(_member(np.array([ord(c)]), np.array([max(x.count(c), y.count(c)) - 1])))[0] for c in changed]
            if _OWNER[parts[0], parts[-1]] == left_out[a[k]]:
                good.append(np.array([k]))
    return np.concatenate(good)


def _verified_short(table: np.ndarray, size: np.ndarray, left_out: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    x, y = table[a], table[b]
    differs = x != y
    p = differs.argmax(axis=1)
    same_size = size[a] == size[b]
    shifted = x[:, :-1] != y[:, 1:]
    behind = np.where(shifted.any(axis=1), table.shape[1] - 2 - shifted[:, ::-1].argmax(axis=1), -1)
    near = np.flatnonzero(np.where(same_size, np.count_nonzero(differs, axis=1) == 1, behind < p))
    x, y, p, same_size = x[near], y[near], p[near], same_size[near]
    pair = np.arange(len(near))
    own, other = y[pair, p], x[pair, p]
    part_b = _part(_member(own, np.count_nonzero(y == own[:, None], axis=1) - 1))
    nth = np.maximum(np.count_nonzero(x == other[:, None], axis=1) - 1, 0)
    part_a = np.where(same_size, _part(_member(other, nth)), part_b)
    return near[_OWNER[part_a, part_b] == left_out[a[near]]]


def near_words(words: DataFrame) -> DataFrame:
    """(id, n_near, n, near): how many near words a word has, and the most frequent, the first in order of these."""

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []

        def pairs(some: pa.Table) -> Iterator[pa.RecordBatch]:
            signature = some.column("signature").to_numpy()
            group = np.cumsum(np.diff(signature, prepend=signature[:1]) != 0)
            alone = np.bincount(group)[group] == 1
            some, group = some.filter(pa.array(~alone)), group[~alone]
            left_out = some.column("left_out").to_numpy()
            a, b = near_pairs(group, left_out, some.column("word").to_pylist())
            name, n = some.column("id").to_numpy(), some.column("n").to_numpy()
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.concatenate(c)) for c in ((name[a], name[b]), (n[b], n[a]), (name[b], name[a]))],
                ["id", "n", "near"])

        for batch in batches:
            rest.append(batch)
            if sum(r.num_rows for r in rest) >= PORTION:
                some = pa.Table.from_batches(rest).combine_chunks()
                signature = some.column("signature").to_numpy()
                end = int(np.searchsorted(signature, signature[-1]))  # the last signature may go on
                if end:
                    yield from pairs(some.slice(0, end))
                rest = some.slice(end).to_batches()
        if rest:
            yield from pairs(pa.Table.from_batches(rest).combine_chunks())

    together = _signed(words).repartition("signature").sortWithinPartitions("signature")
    pairs = together.mapInArrow(compare, "id long, n long, near long")
    best = F.struct((-F.col("n")).alias("n"), F.col("near").alias("near"))
    found = pairs.groupBy("id").agg(F.count("*").alias("n_near"), F.min(best).alias("best"))
    return found.select("id", "n_near", (-F.col("best.n")).alias("n"), F.col("best.near").alias("near"))


def _roots(forms: DataFrame) -> DataFrame:
    """(id, root) of each word with a form: steps are doubled until none leads on."""
    roots = stored(forms.select("id", F.col("form_id").alias("root")), "roots")
    while True:
        onward = roots.select(F.col("id").alias("root"), F.col("root").alias("next"))
        moved = stored(
            roots.join(onward, "root", "left").select("id", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")),
            "roots")
        if not moved.filter("moved").take(1):
            return roots
        roots = moved.select("id", "root")


def variants(docs: DataFrame) -> DataFrame:
    """Every word of ``docs`` (doc_id, text) with its form, the last form of its chain and its near words."""
    counted = stored(count_words(docs), "words")
    words = stored(counted.orderBy("word").withColumn("id", F.monotonically_increasing_id()), "words")
    near = near_words(words).select("id", "n_near", F.col("n").alias("near_n"), "near")
    linked = stored(words.join(near, "id", "left"), "near")
    is_form = F.col("near_n") >= RATIO * F.col("n")
    forms = linked.filter(is_form).select("id", F.col("near").alias("form_id"))
    roots = _roots(forms)
    text = words.select(F.col("id").alias("of"), F.col("word").alias("name"))
    ends = roots.join(text, F.col("root") == F.col("of")).select("id", F.col("name").alias("root"))
    chosen = linked.filter(is_form).join(text, F.col("near") == F.col("of")).select("id", F.col("name").alias("form"))
    named = linked.join(chosen, "id", "left").join(ends, "id", "left")
    return named.select(
        "word", "form", F.coalesce("root", "word").alias("root"), "n",
        F.coalesce("n_near", F.lit(0)).alias("n_near"), F.when(is_form, F.col("near_n")).alias("form_n"))
