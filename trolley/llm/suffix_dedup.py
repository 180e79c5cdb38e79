"""Repeated passages: every byte covered by a string of ``DEPTH`` bytes that also starts elsewhere, exactly.

A window is DEPTH bytes of a text.  Windows that are equal must meet in one task without any task holding all texts:

1. Anchors.  The anchor of a window is its KMER-byte piece of least hash, the first of these.  Equal windows have equal anchors,
   at the same place.  Consecutive windows with one anchor form a segment: 1 to DEPTH - KMER + 1 windows.
2. Classes.  Equal segments are one string with a count, found by 128-bit hashes, which alone are shuffled; consecutive
   equal segments (a period) are one row.  A class of two or more is repeated as a whole.  A segment whose
   anchor stands in no other class is alone.  What is left are anchors with several classes, such as near copies.
3. Transforms.  The bytes of one segment of each such class go to the task of their anchor.  There they come in shards; a
   Burrows-Wheeler transform is built for each shard, and the transforms are merged by interleave refinement
   (``_bwt``), which gives common prefixes and repeated intervals: blocks of windows with one prefix of DEPTH bytes.
4. A window that has company in its block, or a count above one, is repeated.  Texts meet their repeated windows again, and
   the bytes that these cover are removed.

Size.  Anchors are about one in 185 bytes, each a row of fixed width.  Texts are shuffled twice, to where their segments
are cut out and to where bytes are removed.  A task takes whole anchors until they have BATCH bytes, in shards of SHARD bytes.
An anchor with more than ``CLASSES`` classes (a passage that many texts share, at its two ends) does not go to
one task.  Its segments are cut by the distance of their windows to the anchor, NARROW distances to a piece; all
windows of a piece share DEPTH - NARROW + 1 bytes, whose hash is the piece's anchor, and pieces go the same way as segments: equal ones
are a class, others meet by that anchor.  Where even that one has more than CLASSES classes, which differ in a few bytes at their
ends, the windows are spread by their own 128-bit hashes and counted.  Nothing is collected.

Rows.  Null is empty; rows that repeat an id, or a whole text, are texts of their own.  Texts of any length are taken whole.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trolley.llm._bwt import Hashes, Transform, merge
from trolley.llm._store import stored
from trolley.llm._words import chunks, mix

DEPTH = 400
KMER = 32
#: Classes of an anchor beyond which its segments are cut into pieces, and the windows of such a piece.
CLASSES = 1000
NARROW = 32
#: Bytes of segments whose transforms are merged at once, and of one transform.
BATCH = 1 << 19
SHARD = 1 << 17

_CLASS = ["anchor", "digest_a", "digest_b"]
_PLACE = np.uint64(0xFFFFFFFF)


def _sliding_least(values: np.ndarray, width: int) -> np.ndarray:
    """The least of each ``width`` neighbours, by windows that double."""
    n, size = len(values) - width + 1, 1
    while size * 2 <= width:
        values = np.minimum(values[: len(values) - size], values[size:])
        size *= 2
    return np.minimum(values[:n], values[width - size :][:n])


def segments_of(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The segments of some texts: text, place in it, number of windows, how often they follow one another, and class."""
    sizes = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(sizes) - sizes
    buffer = np.frombuffer(b"".join(texts), np.uint8)
    windows = np.maximum(sizes - DEPTH + 1, 0)
    none = np.zeros(0, np.int64)
    if not windows.any():
        return {c: none for c in ("text", "at", "windows", "times", *_CLASS)}
    hashes = Hashes(buffer)
    pieces = hashes.every(KMER)
    least = _sliding_least((pieces & ~_PLACE) | np.arange(len(pieces), dtype=np.uint64), DEPTH - KMER + 1)
    edge = np.zeros(len(buffer) + 1, np.int8)
    full = np.flatnonzero(windows)
    edge[starts[full]] += 1
    edge[starts[full] + windows[full]] -= 1
    start = np.flatnonzero(np.cumsum(edge[:-1], dtype=np.int8))
    anchor = least[start].astype(np.uint32)
    new = np.ones(len(start), bool)
    new[1:] = (anchor[1:] != anchor[:-1]) | (start[1:] != start[:-1] + 1)
    first = np.flatnonzero(new)
    count = np.diff(np.append(first, len(start)))
    begin = start[first]
    end = begin + count - 1 + DEPTH
    text = full[np.searchsorted(starts[full], begin, "right") - 1]
    at = begin - starts[text]
    key, a, b = mix(pieces[anchor[first]]), hashes.of(begin, end), Hashes(buffer, 1).of(begin, end)
    # a period gives equal segments one after the other
    same = np.zeros(len(first), bool)
    same[1:] = (text[1:] == text[:-1]) & (key[1:] == key[:-1]) & (a[1:] == a[:-1]) & (b[1:] == b[:-1])
    one = np.flatnonzero(~same)
    return {
        "text": text[one], "at": at[one], "windows": count[one],
        "times": np.diff(np.append(one, len(first))),
        "anchor": key[one].view(np.int64), "digest_a": a[one].view(np.int64), "digest_b": b[one].view(np.int64),
    }


def _segments(texts: DataFrame) -> DataFrame:
    """One row per segment (or run of equal ones) of the texts (row, text)."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in chunks(batches, 1):
            found = segments_of(some)
            row = part.column(0).take(pa.array(found["text"]))
            rest = [pa.array(found[c].astype(np.int32)) for c in ("at", "windows", "times")]
            yield pa.RecordBatch.from_arrays(
                [*(pa.array(found[c]) for c in _CLASS), row, *rest], [*_CLASS, "row", "at", "windows", "times"])

    return texts.select("row", "text").mapInArrow(
        cut, "anchor long, digest_a long, digest_b long, row long, at int, windows int, times int")


_WANTED = "anchor long, digest_a long, digest_b long, copies long, windows int"


def _bytes_of(wanted: DataFrame, texts: DataFrame) -> DataFrame:
    """The wanted classes with the bytes of one segment of each."""
    kept = ["at", "windows", *_CLASS, "copies"]
    by_row = wanted.groupBy("row").agg(F.collect_list(F.struct(*kept)).alias("wanted"))

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in chunks(batches, 0):
            lists = part.column(1)
            fields = dict(zip(kept, lists.flatten().flatten()))
            at, windows = (fields[c].to_numpy() for c in ("at", "windows"))
            text = np.repeat(np.arange(len(some)), lists.value_lengths().to_numpy(zero_copy_only=False))
            pieces = [some[t][a : a + n - 1 + DEPTH] for t, a, n in zip(text.tolist(), at.tolist(), windows.tolist())]
            for k in range(0, len(pieces), 2000):
                yield pa.RecordBatch.from_arrays(
                    [*(fields[c].slice(k, 2000) for c in (*_CLASS, "copies", "windows")), pa.array(pieces[k : k + 2000], pa.binary())],
                    [*_CLASS, "copies", "windows", "bytes"])

    return texts.join(by_row, "row").select("text", "wanted").mapInArrow(cut, f"{_WANTED}, bytes binary")


def repeated_windows(strings: list[bytes], windows: np.ndarray, copies: np.ndarray) -> np.ndarray:
    """For the windows that each string counts for, string after string: does the window occur more than once?"""
    first, size = [0], 0
    for k, s in enumerate(strings):
        if size and size + len(s) > SHARD:
            first.append(k)
            size = 0
        size += len(s)
    first.append(len(strings))
    shards = [Transform.of(strings[a:b]) for a, b in zip(first, first[1:])]
    source, entry, common = merge(shards, DEPTH)
    sizes = np.fromiter(map(len, strings), np.int64, len(strings)) + 1
    starts = np.cumsum(sizes) - sizes
    shift = np.append(starts, sizes.sum())[first[:-1]]
    offsets = np.cumsum([0] + [len(s.suffix) for s in shards])
    suffix = np.concatenate([s.suffix for s in shards])[offsets[source] + entry] + shift[source]
    string = np.repeat(np.arange(len(strings)), sizes)[suffix]
    counts_for = suffix - starts[string] < windows[string]
    block = np.cumsum(common < DEPTH) - 1
    total = np.bincount(block, np.where(counts_for, copies[string], 0))
    found = counts_for & (total[block] >= 2)
    owned = np.zeros(int(sizes.sum()), bool)
    owned[suffix[found]] = True
    inside = np.arange(len(owned)) - np.repeat(starts, sizes) < np.repeat(windows, sizes)
    return owned[inside]


def _runs(repeated: np.ndarray, windows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Runs of repeated windows: their string, first window and number."""
    string = np.repeat(np.arange(len(windows)), windows)
    at = np.arange(len(string)) - np.repeat(np.cumsum(windows) - windows, windows)
    before = np.concatenate(([False], repeated[:-1])) & (at > 0)
    after = np.concatenate((repeated[1:], [False])) & np.concatenate((at[1:] > 0, [False]))
    first, last = np.flatnonzero(repeated & ~before), np.flatnonzero(repeated & ~after)
    return string[first], at[first], last - first + 1


_RUNS = "anchor long, digest_a long, digest_b long, first int, number int"


def _merged(segments: DataFrame) -> DataFrame:
    """Runs of repeated windows of each class, from merged transforms of the segments of an anchor."""

    def found(some: pa.Table) -> Iterator[pa.RecordBatch]:
        windows = some.column("windows").to_numpy().astype(np.int64)
        repeated = repeated_windows(some.column("bytes").to_pylist(), windows, some.column("copies").to_numpy())
        string, first, number = _runs(repeated, windows)
        classes = [some.column(c).combine_chunks().take(pa.array(string)) for c in _CLASS]
        yield pa.RecordBatch.from_arrays(
            [*classes, pa.array(first.astype(np.int32)), pa.array(number.astype(np.int32))], [*_CLASS, "first", "number"])

    def weight(batch: pa.RecordBatch) -> int:
        return int(batch.column("windows").to_numpy().sum()) + batch.num_rows * DEPTH

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        rest: list[pa.RecordBatch] = []
        for batch in batches:
            for at in range(0, batch.num_rows, 500):
                rest.append(batch.slice(at, 500))
                if sum(map(weight, rest)) < BATCH:
                    continue
                some = pa.Table.from_batches(rest)
                anchor = some.column("anchor").to_numpy()
                end = int(np.searchsorted(anchor, anchor[-1]))  # the last anchor may go on
                if end:
                    yield from found(some.slice(0, end))
                rest = some.slice(end).to_batches()
        if rest:
            yield from found(pa.Table.from_batches(rest))

    together = segments.repartition("anchor").sortWithinPartitions("anchor")
    return together.mapInArrow(search, _RUNS)


def _starts(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """The bytes of some segments behind one another; the segment, number and place of each of their windows."""
    windows = batch.column("windows").to_numpy().astype(np.int64)
    sizes = windows - 1 + DEPTH
    segment = np.repeat(np.arange(len(windows)), windows)
    nth = np.arange(len(segment)) - np.repeat(np.cumsum(windows) - windows, windows)
    buffer = np.frombuffer(b"".join(batch.column("bytes").to_pylist()), np.uint8)
    return buffer, segment, nth, (np.cumsum(sizes) - sizes)[segment] + nth


def _pieces(segments: DataFrame) -> DataFrame:
    """Segments cut by the distance of their windows to the anchor, each piece with the class of its segment."""

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                buffer, segment, nth, start = _starts(some)
                place = np.arange(max(len(buffer) - KMER + 1, 0), dtype=np.uint64)
                least = _sliding_least((Hashes(buffer).every(KMER) & ~_PLACE) | place, DEPTH - KMER + 1)
                distance = (least[start] & _PLACE).astype(np.int64) - start
                part = distance // NARROW
                new = np.ones(len(start), bool)
                new[1:] = (segment[1:] != segment[:-1]) | (part[1:] != part[:-1])
                first = np.flatnonzero(new)
                windows = np.diff(np.append(first, len(start)))
                begin = start[first]
                end = begin + windows - 1 + DEPTH
                core = begin + distance[first] - part[first] * NARROW  # the last window that such a piece can have
                key = mix(Hashes(buffer).of(core, core - NARROW + 1 + DEPTH) + part[first].astype(np.uint64))
                digests = [pa.array(Hashes(buffer, w).of(begin, end).view(np.int64)) for w in (0, 1)]
                own = [some.column(c).take(pa.array(segment[first])) for c in (*_CLASS, "copies")]
                pieces = [buffer[x:y].tobytes() for x, y in zip(begin.tolist(), end.tolist())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(key.view(np.int64)), *digests, *own, pa.array(nth[first].astype(np.int32)),
                     pa.array(windows.astype(np.int32)), pa.array(pieces, pa.binary())],
                    [*_CLASS, *_OWN, "copies", "offset", "windows", "bytes"])

    kind = ", ".join(f"{c} long" for c in (*_CLASS, *_OWN, "copies")) + ", offset int, windows int, bytes binary"
    return segments.mapInArrow(cut, kind)


_OWN = ["own_anchor", "own_a", "own_b"]


def _counted(segments: DataFrame) -> DataFrame:
    """The repeated windows of each class, from counts of single windows that are spread by their hashes."""

    def spread(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for k in range(0, batch.num_rows, 500):
                some = batch.slice(k, 500)
                buffer, segment, nth, start = _starts(some)
                hashes = [pa.array(Hashes(buffer, w).of(start, start + DEPTH).view(np.int64)) for w in (0, 1)]
                own = [some.column(c).take(pa.array(segment)) for c in (*_CLASS, "copies")]
                yield pa.RecordBatch.from_arrays(
                    [*hashes, *own, pa.array(nth.astype(np.int32))], ["window_a", "window_b", *_CLASS, "copies", "first"])

    kind = "window_a long, window_b long, anchor long, digest_a long, digest_b long, copies long, first int"
    windows = stored(segments.mapInArrow(spread, kind), "windows")
    several = windows.groupBy("window_a", "window_b").agg(F.sum("copies").alias("n")).filter("n > 1").drop("n")
    found = windows.join(several, ["window_a", "window_b"], "left_semi")
    return found.select(*_CLASS, "first", F.lit(1).alias("number"))


def _whole(classes: DataFrame) -> DataFrame:
    """The windows of classes of two or more, which are all repeated."""
    return classes.filter("copies > 1").select(*_CLASS, F.lit(0).alias("first"), F.col("windows").alias("number"))


def _several(classes: DataFrame) -> DataFrame:
    """The classes whose anchor has others, with their number."""
    number = classes.groupBy("anchor").agg(F.count("*").alias("classes")).filter("classes > 1")
    return classes.join(number, "anchor")


def _by_pieces(segments: DataFrame) -> DataFrame:
    """Runs of repeated windows of the segments of very frequent anchors."""
    pieces = stored(_pieces(segments), "pieces")
    first = [F.first("windows").alias("windows"), F.first("bytes").alias("bytes")]
    classes = stored(pieces.groupBy(*_CLASS).agg(F.sum("copies").alias("copies"), *first), "pieces")
    several = stored(_several(classes), "pieces")
    runs = _whole(classes)
    runs = runs.unionByName(_merged(several.filter(F.col("classes") <= CLASSES)).join(_whole(classes), _CLASS, "left_anti"))
    runs = runs.unionByName(_counted(several.filter(F.col("classes") > CLASSES)).join(_whole(classes), _CLASS, "left_anti"))
    found = pieces.drop("bytes").join(stored(runs, "runs"), _CLASS)
    named = [F.col(own).alias(c) for own, c in zip(_OWN, _CLASS)]
    return found.select(*named, (F.col("offset") + F.col("first")).alias("first"), "number")


def _repeated(texts: DataFrame, segments: DataFrame) -> DataFrame:
    """Runs of repeated windows of every class that has any."""
    one = [F.min_by("at", "row").alias("at"), F.min("row").alias("row"), F.max("windows").alias("windows")]
    classes = stored(segments.groupBy(*_CLASS).agg(F.sum("times").alias("copies"), *one), "classes")
    wanted = stored(_several(classes), "wanted")
    narrow = stored(_bytes_of(wanted.filter(F.col("classes") <= CLASSES), texts), "bytes")
    runs = _whole(classes).unionByName(_merged(narrow).join(_whole(classes), _CLASS, "left_anti"))
    frequent = wanted.filter(F.col("classes") > CLASSES)
    if not frequent.isEmpty():
        runs = runs.unionByName(_by_pieces(_bytes_of(frequent, texts)).join(_whole(classes), _CLASS, "left_anti"))
    each = stored(runs, "runs").groupBy(*_CLASS)
    return stored(each.agg(F.collect_list(F.struct("first", "number")).alias("runs")), "runs")


def _kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Texts without the bytes that their repeated windows cover."""
    for part, texts in chunks(batches, 1):
        runs, rows = part.column(2), []
        for k, text in enumerate(texts):
            edge = np.zeros(len(text) + 1, np.int32)
            for segment in runs[k].as_py() or ():
                # a run of equal segments repeats its windows; each covers DEPTH bytes from its start
                for run in segment["runs"]:
                    start = segment["at"] + run["first"] + segment["windows"] * np.arange(segment["times"])
                    np.add.at(edge, start, 1)
                    np.add.at(edge, start + run["number"] - 1 + DEPTH, -1)
            covered = np.cumsum(edge[:-1]) > 0
            kept = np.frombuffer(text, np.uint8)[~covered].tobytes()
            spans = int(np.count_nonzero(covered[1:] & ~covered[:-1])) + int(covered[:1].sum())
            rows.append((len(text), int(covered.sum()), spans, hashlib.sha256(kept).hexdigest(), kept))
        kinds = (pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.binary())
        yield pa.RecordBatch.from_arrays(
            [part.column(0), *(pa.array(column, kind) for column, kind in zip(zip(*rows), kinds))],
            ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256", "kept"])


def dedup(docs: DataFrame, with_bytes: bool = False) -> DataFrame:
    """One row per row of ``docs`` (doc_id, text): sizes, removed spans and a digest of the bytes that are kept.

    ``with_bytes`` adds the bytes themselves (``kept``), which may end within a character.
    """
    keyed = docs.select(F.monotonically_increasing_id().alias("row"), "doc_id", F.coalesce("text", F.lit("")).alias("text"))
    texts = stored(keyed, "texts")
    segments = stored(_segments(texts), "segments")
    found = segments.join(_repeated(texts, segments), _CLASS)
    by_row = found.groupBy("row").agg(F.collect_list(F.struct("at", "windows", "times", "runs")).alias("segments"))
    joined = texts.join(by_row, "row", "left").select("doc_id", "text", "segments")
    kind = f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, n_bytes long, n_removed long, n_spans long, kept_sha256 string, kept binary"
    result = joined.mapInArrow(_kept, kind)
    return result if with_bytes else result.drop("kept")
