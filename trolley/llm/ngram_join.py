"""N-gram Jaccard join: documents whose sets of word n-grams are alike, and the components they form.

The join is exact.  Two sets of sizes a and b reach the similarity N / D when they differ in at most
H = (a + b) (D - N) / (D + N) elements.  Documents are taken by bands of sizes.  In a band all n-grams are hashed
into m = H + 1 segments, H being the most of any pair whose larger set lies in the band, so two alike sets agree
wholly in one segment at least.  Every document enters its segments into the index, in its own band and in those
above that a larger partner may lie in.

Segments without n-grams agree in unrelated documents.  The cost of entering them (the documents of the band
times the chance of an empty segment, each read whole) is weighed against that of doing without; where it is
higher they are left out and paid for by one-deletion neighbourhoods:  if two alike sets agree in z empty segments alone, then at
most z - 1 of the others hold more than one of the H differences.  So a document with z empty segments enters,
besides its segments, all one-deletions of its first segments, until z of at least two n-grams are covered; one
of these differs by a single n-gram.  A document whose n-grams lie so close together that there may be too few of
them (see ``_crowded``) enters its empty segments after all.

Equal sets are one class from the start.  Within a segment's group the members are tied to the smallest one,
first in the task that reads them and then among tasks, so no group is gathered whole.  The tie with most shared
segments is verified first, on the whole texts; groups whose members then stand in one component are done.  While
the others hold many pairs across components, their members are tied to further centres, one a turn, and verified;
so a large group of near copies grows together without its pairs being formed.  At last every pair that still stands
across components is verified, unless size, parity bits or sketches prove it unlike.

Documents are known by id.  Rows that repeat an id are versions of one document, which has the links of each of
them.  Rows with a null id come back with their set size and a null component.  Null texts, empty ones and those
without words have no n-grams and no links; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trolley.llm._store import by_ids, stored
from trolley.llm._words import Words, chunks, fold, give_back, mix

#: Upper ends of size bands grow by this factor.
BAND_RATIO = 1.3
#: Partners verified against one copy of a document.
BLOCK = 128
#: Words of 64 parity bits kept for each document.
PARITY = 8
#: Bits of a document's sketch for each element that an alike set of its size may differ in, rounded up to a power of two.
SKETCH_BITS = 8
#: Groups are tied to new centres as long as they hold more open pairs for each member than this, and each turn
#: leaves no more than half of them open.
MANY_PAIRS = 4
#: A task ties its own entries once this many have come together (16 bytes each).
TASK_ENTRIES = 250_000

_U = np.uint64


def _bands() -> list[int]:
    ends = [1]
    while ends[-1] < 1 << 40:
        ends.append(max(ends[-1] + 1, int(ends[-1] * BAND_RATIO)))
    return ends


BANDS = np.array(_bands(), np.int64)  # band k holds sizes BANDS[k] <= s < BANDS[k + 1]


def band_of(size: np.ndarray) -> np.ndarray:
    return np.searchsorted(BANDS, size, "right") - 1


class Threshold:
    """Similarity num / den on sets of n-word shingles."""

    def __init__(self, n: int, num: int, den: int) -> None:
        self.n, self.num, self.den = n, num, den

    def differences(self, total: np.ndarray | int):
        """Most differing elements of two alike sets with ``total`` elements between them."""
        return total * (self.den - self.num) // (self.den + self.num)

    def largest(self, size: np.ndarray) -> np.ndarray:
        return size * self.den // self.num

    def segments(self, band: np.ndarray) -> np.ndarray:
        return self.differences(2 * (BANDS[band + 1] - 1)) + 1


def shingle_sets(texts: list[bytes], n: int) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct n-gram hashes of all texts, and where each text's begin (one more for the end).

    A text with fewer words has its whole sequence as its one n-gram; without words it has none.
    """
    words = Words.of(texts)
    hashes = words.hashes()
    grams, doc = words.ngrams(hashes, n)
    short = np.flatnonzero((words.counts() > 0) & (words.counts() < n))
    if len(short):
        parts = [[hashes[j : j + 1] for j in range(words.first[i], words.first[i + 1])] for i in short]
        grams = np.concatenate([grams, *(fold(p) ^ _U(0x5851F42D) for p in parts)])
        doc = np.concatenate([doc, short])
    order = np.lexsort((grams, doc))
    grams, doc = grams[order], doc[order]
    keep = np.ones(len(grams), bool)
    keep[1:] = (grams[1:] != grams[:-1]) | (doc[1:] != doc[:-1])
    grams, doc = grams[keep], doc[keep]
    return grams, np.searchsorted(doc, np.arange(len(texts) + 1))


def _sums(values: np.ndarray, group: np.ndarray, groups: int) -> np.ndarray:
    """Sums by group, modulo 2**64; exact, since halves of 32 bits are added up in 53."""
    low = np.bincount(group, (values & _U(0xFFFFFFFF)).astype(np.float64), groups)
    high = np.bincount(group, (values >> _U(32)).astype(np.float64), groups)
    return low.astype(np.uint64) + (high.astype(np.uint64) << _U(32))


def _crowded(sizes: np.ndarray, empty: int) -> bool:
    """Whether z - 1 segments may hold all but 2 m elements.

    If a pair agrees in z empty segments alone and one of its sets has fewer than z segments of two or more
    elements, all but m of that set's elements lie in z - 1 segments, and all but 2 m of its partner's.
    """
    if empty < 2:
        return False
    top = np.sort(sizes)[len(sizes) - (empty - 1) :].sum()
    return bool(top >= sizes.sum() - 2 * len(sizes))


def entries(
    grams: np.ndarray, first: np.ndarray, rule: Threshold, crowd: dict[int, int]
) -> tuple[np.ndarray, np.ndarray]:
    """Index entries of each set: 64-bit keys, and the set of each.

    ``crowd`` has the number of documents in each band, which decides how empty segments are treated.
    """
    size = np.diff(first)
    keys, owners = [], []
    low, high = band_of(np.maximum(size, 1)), band_of(np.maximum(rule.largest(size), 1))
    for up in range(int((high - low).max(initial=0)) + 1):
        doc = np.flatnonzero((size > 0) & (low + up <= high))
        band = low[doc] + up
        m = rule.segments(band)
        doc, band, m = doc[m > 1], band[m > 1], m[m > 1]  # one segment: only equal sets are alike
        if not len(doc):
            continue
        base = np.concatenate(([0], np.cumsum(m)))
        own = np.repeat(np.arange(len(doc)), size[doc])
        token = grams[np.arange(len(own)) + np.repeat(first[doc] - np.concatenate(([0], np.cumsum(size[doc])[:-1])), size[doc])]
        segment = (mix(token ^ _U(0xA0761D6478BD642F)) >> _U(11)) % m[own].astype(np.uint64)
        flat = base[own] + segment.astype(np.int64)
        value = mix(token + _U(0xE7037ED1A0B428DB))
        total = _sums(value, flat, int(base[-1]))
        count = np.bincount(flat, minlength=int(base[-1]))
        slot_doc = np.repeat(np.arange(len(doc)), m)
        place = np.arange(int(base[-1])) - base[slot_doc]
        label = mix(place.astype(np.uint64) + (band[slot_doc].astype(np.uint64) << _U(40)) + _U(1))
        skip = np.array([_skips_empty(b, k, crowd) for b, k in zip(band.tolist(), m.tolist())], bool)
        entered = (count > 0) | ~skip[slot_doc]
        empty = np.bincount(slot_doc[count == 0], minlength=len(doc))
        reach = np.zeros(len(doc), np.int64)
        for d in np.flatnonzero(skip & (empty > 0)):
            sizes = count[base[d] : base[d + 1]]
            several = np.flatnonzero(sizes >= 2)
            reach[d] = several[empty[d] - 1] + 1 if len(several) >= empty[d] else m[d]
            if _crowded(sizes, int(empty[d])):
                entered[base[d] : base[d + 1]] = True
        keys.append(mix(total[entered] ^ label[entered]))
        owners.append(doc[slot_doc[entered]])
        cut = np.flatnonzero((place[flat] < reach[own]) & (count[flat] >= 2))
        keys.append(mix((total[flat[cut]] - value[cut]) ^ label[flat[cut]]))
        owners.append(doc[own[cut]])
    if not keys:
        return np.zeros(0, np.uint64), np.zeros(0, np.int64)
    return np.concatenate(keys), np.concatenate(owners)


def _skips_empty(band: int, m: int, crowd: dict[int, int]) -> bool:
    """Whether meeting all other empty segments costs more than the one-deletions of a segment.

    An entry is the unit of cost.  A document met without cause is read whole, which costs its size.
    """
    load = BANDS[band] / m
    return crowd.get(band, 0) * np.exp(-load) * BANDS[band] > load + 1


_BITS = [f"p{k}" for k in range(PARITY)]


def _sketches(grams: np.ndarray, doc: np.ndarray, size: np.ndarray, rule: Threshold) -> pa.ListArray:
    """Per set its parity bits in a power of two of 64-bit words; halves of a longer sketch fold onto a shorter one."""
    words = np.maximum(rule.differences(2 * size) * SKETCH_BITS, 64) / 64
    words = 1 << np.ceil(np.log2(words)).astype(np.int64)
    ends = np.concatenate(([0], np.cumsum(words)))
    spot = mix(grams ^ _U(0x9FB21C651E98DF25)) & (64 * words[doc] - 1).astype(np.uint64)
    odd = np.bincount(64 * ends[doc] + spot.astype(np.int64), minlength=64 * int(ends[-1])).astype(np.uint8) & 1
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(np.packbits(odd).view(np.int64)))


def _measured(docs: DataFrame, rule: Threshold) -> DataFrame:
    """Per row the id, set size, band, a 128-bit digest of the set, its parity bits and its sketch.

    Both say of each bit whether an odd number of elements fall on it, so two sets differ in at least as many elements
    as bits.  Eight words tell small sets apart; the sketch grows with the set.
    """
    names = ["id", "n_shingles", "band", "d1", "d2", *_BITS]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, texts in chunks(batches, 1):
            grams, first = shingle_sets(texts, rule.n)
            size = np.diff(first)
            doc = np.repeat(np.arange(len(texts)), size)
            digests = [_sums(mix(grams ^ _U(salt)), doc, len(texts)) for salt in (0x1B873593CC9E2D51, 0x85EBCA6BC2B2AE35)]
            bit = (mix(grams + _U(0x2545F4914F6CDD1D)) >> _U(7)).astype(np.int64) % (64 * PARITY)
            odd = (np.bincount(doc * 64 * PARITY + bit, minlength=len(texts) * 64 * PARITY) & 1).astype(np.uint8)
            parity = np.packbits(odd.reshape(len(texts), -1), axis=1).view("<i8")
            columns = [size, band_of(np.maximum(size, 1)), *(d.view(np.int64) for d in digests), *np.ascontiguousarray(parity.T)]
            sketch = _sketches(grams, doc, size, rule)
            yield pa.RecordBatch.from_arrays([rows.column(0), *map(pa.array, columns), sketch], names=[*names, "sketch"])

    shape = ", ".join(["id long", *[f"{c} long" for c in names[1:]], "sketch array<long>"])
    return docs.mapInArrow(run, shape)


def _tied(key: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Sorted keys with their documents, and for each the position of its group's smallest document."""
    order = np.lexsort((doc, key))
    key, doc = key[order], doc[order]
    new = np.ones(len(key), bool)
    new[1:] = key[1:] != key[:-1]
    begin = np.maximum.accumulate(np.where(new, np.arange(len(key)), 0))
    return key, doc, begin


def _index(docs: DataFrame, rule: Threshold, crowd: dict[int, int]) -> DataFrame:
    """Ties (key, a, b), a < b: each member b of a segment's group and a smaller one that it is tied to.

    A task ties its own members first and sends one entry for each key; its ties are dealt out by key and member,
    so that a frequent segment costs a partition no more than one row for each task.
    """
    names = ["deal", "key", "a", "b"]

    def batch(deal: np.ndarray, key: np.ndarray, a: np.ndarray, b: np.ndarray) -> pa.RecordBatch:
        return pa.RecordBatch.from_arrays([pa.array(x.view(np.int64)) for x in (deal, key, a, b)], names=names)

    def enter(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[tuple[np.ndarray, np.ndarray]] = []

        def flush() -> Iterator[pa.RecordBatch]:
            key, doc, begin = _tied(np.concatenate([k for k, _ in held]), np.concatenate([d for _, d in held]))
            head = begin == np.arange(len(key))
            first = doc[begin]
            more = ~head & (doc != first)
            deal = np.where(head, key, mix(key + mix(doc.view(np.uint64))))
            for part in np.array_split(np.flatnonzero(head | more), max(1, len(key) // 200_000)):
                b = np.where(head[part], -1, doc[part])
                yield batch(deal[part], key[part], np.where(head[part], doc[part], first[part]), b)
            held.clear()

        total = 0
        for rows, texts in chunks(batches, 1):
            key, owner = entries(*shingle_sets(texts, rule.n), rule, crowd)
            ids = rows.column(0).to_numpy(zero_copy_only=False)
            held.append((key, ids[owner].astype(np.int64)))
            total += len(key)
            if total >= TASK_ENTRIES:
                yield from flush()
                total = 0
        if held:
            yield from flush()

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, docs_ = [], []
        for rows in batches:
            key, a, b = (rows.column(k).to_numpy().copy() for k in (1, 2, 3))
            tie = b >= 0
            if tie.any():
                yield pa.RecordBatch.from_arrays([pa.array(x[tie]) for x in (key, a, b)], names=names[1:])
            keys.append(key[~tie])
            docs_.append(a[~tie])
        if keys:
            key, doc, begin = _tied(np.concatenate(keys), np.concatenate(docs_))
            more = doc != doc[begin]
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key[more], doc[begin][more], doc[more])], names=names[1:])
            del key, doc, begin, more, keys, docs_
            give_back()

    entered = docs.mapInArrow(enter, "deal long, key long, a long, b long")
    return entered.repartition("deal").mapInArrow(meet, "key long, a long, b long")


def _verified(docs: DataFrame, pairs: DataFrame, rule: Threshold) -> DataFrame:
    """The pairs (a, b) that are alike, tested on the whole texts.

    Pairs of one ``a`` are dealt into blocks of about BLOCK partners; a block gets the text of ``a`` once and streams
    past it.  Versions of a document (rows that repeat an id) are all tested.
    """
    blocks = pairs.groupBy("a").agg(F.ceil(F.count("*") / BLOCK).alias("blocks"))
    dealt = pairs.join(blocks, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("blocks")).alias("block"))
    dealt = stored(dealt, "pairs")
    ids = stored(dealt.select("a").union(dealt.select("b")).distinct(), "ids")
    texts = by_ids(docs, ids, "id", "left_semi")
    centres = dealt.select("a", "block").distinct().join(texts, F.col("a") == F.col("id"))
    partners = dealt.join(texts, F.col("b") == F.col("id"))
    rows = centres.select("a", "block", F.lit(-1).cast("long").alias("b"), "text").unionAll(
        partners.select("a", "block", "b", "text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        here, centre = None, []
        for rows, texts in chunks(batches, 3):
            grams, first = shingle_sets(texts, rule.n)
            found = []
            a, block, b = (rows.column(k).to_pylist() for k in range(3))
            for k in range(len(texts)):
                own = grams[first[k] : first[k + 1]]
                if (a[k], block[k]) != here:
                    here, centre = (a[k], block[k]), []
                if b[k] < 0:
                    centre.append(own.copy())
                elif any(_alike(own, other, rule) for other in centre):
                    found.append((a[k], b[k]))
            columns = zip(*found) if found else ([], [])
            yield pa.RecordBatch.from_arrays([pa.array(list(c), pa.int64()) for c in columns], names=["a", "b"])

    ordered = rows.repartition("a", "block").sortWithinPartitions("a", "block", "b")
    return ordered.mapInArrow(run, "a long, b long")


def _verified_in_portions(docs: DataFrame, pairs: DataFrame, rule: Threshold, facts: DataFrame) -> DataFrame:
    """The alike ones of all stored ``pairs``, in portions that each move about twice as much text as there is."""
    sizes = facts.groupBy("id").agg(F.max("n_shingles").alias("n"))
    ends = pairs.select(F.explode(F.array("a", "b")).alias("id"))
    moved = ends.join(sizes, "id").agg(F.sum("n")).first()[0] or 0
    whole = sizes.agg(F.sum("n")).first()[0] or 1
    portions = max(1, -(-moved // (2 * whole)))
    portion = F.pmod(F.xxhash64("a", "b"), F.lit(portions))
    alike = [stored(_verified(docs, pairs.filter(portion == k), rule), "alike") for k in range(portions)]
    return reduce(DataFrame.unionAll, alike)


def _alike(x: np.ndarray, y: np.ndarray, rule: Threshold) -> bool:
    if not len(x) or not len(y) or rule.den * min(len(x), len(y)) < rule.num * max(len(x), len(y)):
        return False
    both = np.concatenate([x, y])
    both.sort()
    common = int((both[1:] == both[:-1]).sum())
    return rule.den * common >= rule.num * (len(x) + len(y) - common)


def components(links: DataFrame) -> DataFrame:
    """(id, root): every linked id and the smallest id that it is joined to by links (a, b).

    The smallest label spreads over the links and then along the labels themselves, so the rounds grow with the
    logarithm of a component's length.  Each round is written to the shared folder.
    """
    links = stored(links.select("a", "b").filter("a <> b").distinct(), "links")
    both = links.select("a", "b").unionAll(links.select(F.col("b").alias("a"), F.col("a").alias("b")))
    labels = stored(both.groupBy(F.col("a").alias("id")).agg(F.min(F.least("a", "b")).alias("root")), "labels")
    while True:
        seen = both.join(labels, F.col("a") == F.col("id")).groupBy("b").agg(F.min("root").alias("seen"))
        nearer = labels.join(seen, F.col("id") == F.col("b")).select(
            "id", F.least("root", "seen").alias("root"), F.col("root").alias("old"))
        further = labels.select(F.col("id").alias("at"), F.col("root").alias("next"))
        new = nearer.join(further, F.col("root") == F.col("at")).select(
            "id", F.least("root", "next").alias("root"), (F.least("root", "next") != F.col("old")).alias("moved"))
        new = stored(new, "labels")
        labels = new.select("id", "root")
        if new.filter("moved").isEmpty():
            return labels


def _labelled(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """The pairs with the components la and lb of their ends (an id without a label is its own)."""
    for end, name in (("a", "la"), ("b", "lb")):
        named = labels.select(F.col("id").alias("_id"), F.col("root").alias("_root"))
        pairs = pairs.join(named, F.col(end) == F.col("_id"), "left").withColumn(
            name, F.coalesce("_root", end)).drop("_id", "_root")
    return pairs


def _once(members: DataFrame) -> DataFrame:
    """The members (key, a) of one of all groups that have the same ones.

    Alike documents share most of their segments, so most groups say the same as others.  A set of members is known
    by their number, the least and the greatest, and 128 bits of their hashes.
    """
    sets = members.groupBy("key").agg(
        F.count("*").alias("n"), F.min("a").alias("least"), F.max("a").alias("most"),
        F.bit_xor(F.xxhash64("a")).alias("d1"), F.bit_xor(F.xxhash64("a", F.lit(1))).alias("d2"))
    one = sets.groupBy("n", "least", "most", "d1", "d2").agg(F.min("key").alias("key")).select("key")
    return members.join(one, "key", "left_semi")


def _members(ties: DataFrame, pairs: DataFrame, labels: DataFrame, facts: DataFrame) -> DataFrame:
    """Members (key, a, label, size, parity) of the segments' groups that span several components, of equal groups one."""
    open_pairs = _labelled(pairs.select("a", "b"), labels).filter("la <> lb").select("a", "b")
    keys = ties.join(open_pairs, ["a", "b"], "left_semi").select("key").distinct()
    members = ties.join(keys, "key", "left_semi")
    members = stored(members.select("key", F.explode(F.array("a", "b")).alias("a")).distinct(), "open")
    members = _once(members).withColumn("b", F.col("a"))
    members = _labelled(members, labels).select("key", "a", F.col("la").alias("label"))
    return stored(members.join(facts, F.col("a") == F.col("id")).select("key", "a", "label", "n_shingles", *_BITS, "sketch"), "members")


def _sides(members: DataFrame) -> list[DataFrame]:
    return [members.select("key", *[F.col(c).alias(f"{side}_{c}") for c in members.columns if c != "key"]) for side in "xy"]


def _apart(x: str, y: str):
    """Number of bits that two sketches differ in, the longer one folded if it has twice the words of the other."""
    def folded(s):
        half = (F.size(s) / 2).cast("int")
        return F.zip_with(F.slice(s, F.lit(1), half), F.slice(s, half + 1, half), lambda p, q: p.bitwiseXOR(q))

    def bits(p, q):
        return F.aggregate(F.zip_with(p, q, lambda a, b: F.bit_count(a.bitwiseXOR(b))), F.lit(0), lambda n, k: n + k)

    x, y = F.col(x), F.col(y)
    return (F.when(F.size(x) == F.size(y), bits(x, y)).when(F.size(x) == 2 * F.size(y), bits(folded(x), y))
            .when(2 * F.size(x) == F.size(y), bits(x, folded(y))).otherwise(0))


def _may_link(rule: Threshold):
    """Whether members x and y stand in different components and may be alike by size, parity and sketches."""
    total = F.col("x_n_shingles") + F.col("y_n_shingles")
    most = F.floor(total * (rule.den - rule.num) / (rule.den + rule.num))
    apart = sum((F.bit_count(F.col(f"x_{p}").bitwiseXOR(F.col(f"y_{p}"))) for p in _BITS), F.lit(0))
    near = F.greatest("x_n_shingles", "y_n_shingles") * rule.num <= F.least("x_n_shingles", "y_n_shingles") * rule.den
    return (F.col("x_label") != F.col("y_label")) & near & (apart <= most) & (_apart("x_sketch", "y_sketch") <= most)


def _across(members: DataFrame, rule: Threshold) -> DataFrame:
    """All pairs of one group that may link two components."""
    left, right = _sides(members)
    met = left.join(right, (left["key"] == right["key"]) & (F.col("x_a") < F.col("y_a")) & _may_link(rule))
    return met.select(F.col("x_a").alias("a"), F.col("y_a").alias("b")).distinct()


def _to_new_centres(members: DataFrame, rule: Threshold, turn: int) -> DataFrame:
    """For each member the one of its groups' centres, another in each turn, with which it shares most groups."""
    draw = F.struct(F.xxhash64("a", F.lit(turn)).alias("draw"), F.struct(*[c for c in members.columns if c != "key"]).alias("m"))
    centres = members.groupBy("key").agg(F.min(draw).alias("c"))
    centres = centres.select(F.col("key").alias("_key"), *[F.col(f"c.m.{c}").alias(f"y_{c}") for c in members.columns if c != "key"])
    left, _ = _sides(members)
    met = left.join(centres, (F.col("key") == F.col("_key")) & _may_link(rule))
    shared = met.groupBy("x_a", "y_a").agg(F.count("*").alias("shared"))
    closest = Window.partitionBy("x_a").orderBy(F.desc("shared"), "y_a")
    one = shared.withColumn("nth", F.row_number().over(closest)).filter("nth = 1")
    return one.select(F.least("x_a", "y_a").alias("a"), F.greatest("x_a", "y_a").alias("b")).distinct()


def _open_pairs(members: DataFrame) -> tuple[int, int]:
    """Number of members, and of pairs across components, in all groups."""
    by_label = members.groupBy("key", "label").agg(F.count("*").cast("double").alias("n"))
    by_key = by_label.groupBy("key").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
    row = by_key.agg(F.sum("n").alias("n"), F.sum((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs")).first()
    return int(row["n"] or 0), int(row["pairs"] or 0)


def join(
    docs: DataFrame, n: int = 5, num: int = 80, den: int = 100, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Per row of ``docs``: ``id_column`` (a long), n_shingles and component_id.

    Two documents are linked when den * |intersection| >= num * |union| of their sets of n-word shingles.
    """
    rule = Threshold(n, num, den)
    rows = docs.select(docs[id_column].cast("long").alias("id"), docs[text_column].alias("text"))
    measured = stored(_measured(rows, rule), "sets")
    own = measured.filter("id is not null and n_shingles > 0")
    classes = stored(own.groupBy("n_shingles", "d1", "d2").agg(F.min("id").alias("rep"), F.count("*").alias("copies")), "classes")
    named = stored(own.join(classes, ["n_shingles", "d1", "d2"]).select(
        "id", "rep", "n_shingles", "band", *_BITS, "sketch"), "named")

    facts = named.filter("id = rep").dropDuplicates(["id", "n_shingles", "p0", "p1"])
    crowd = {r["band"]: r["count"] for r in facts.groupBy("band").count().collect()}  # a few dozen rows
    versions = stored(named.groupBy("id").agg(
        F.min("rep").alias("first"), F.max("rep").alias("last"), F.max(F.col("id") == F.col("rep")).alias("leads")), "versions")
    copies = versions.filter("not leads").select("id")
    several = versions.filter("first <> last").select("id", "first")
    known = rows.filter("id is not null")
    distinct = by_ids(known, copies, "id", "left_anti")
    ties = stored(_index(distinct, rule, crowd), "ties")

    pairs = stored(ties.groupBy("a", "b").agg(F.count("*").alias("shared")), "shared")
    closest = Window.partitionBy("b").orderBy(F.desc("shared"), "a")
    best = pairs.withColumn("nth", F.row_number().over(closest)).filter("nth = 1").select("a", "b")
    alike = stored(_verified(known, best, rule), "alike")
    same_id = named.join(several, "id").select(F.col("first").alias("a"), F.col("rep").alias("b")).filter("a <> b")
    links = alike.unionAll(same_id)
    labels = components(links)
    members, turn, before = _members(ties, pairs, labels, facts), 0, float("inf")
    while True:
        size, open_ = _open_pairs(members)
        if open_ <= MANY_PAIRS * size or open_ > before / 2:
            break
        turn, before = turn + 1, open_
        tried = stored(_to_new_centres(members, rule, turn), "tried")
        links = links.unionAll(stored(_verified(known, tried, rule), "more"))
        labels = components(links)
        members = _members(ties, pairs, labels, facts)
    left = stored(_across(members, rule).join(best, ["a", "b"], "left_anti"), "across")
    if not left.isEmpty():
        labels = components(links.unionAll(_verified_in_portions(known, left, rule, facts)))
    found = measured.join(classes, ["n_shingles", "d1", "d2"], "left")
    found = found.join(labels.withColumnRenamed("id", "_id"), F.col("rep") == F.col("_id"), "left")
    component = F.when(F.col("id").isNotNull(), F.coalesce("root", "rep", "id"))
    return found.select(F.col("id").alias(id_column), "n_shingles", component.alias("component_id"))
