"""Ranked lexical search of whole texts: the best documents of each query, exactly.

Terms are runs of letters, digits and non-ASCII characters, A-Z read as a-z.  Statistics come from all documents:
how many hold a term at all (N), their terms with repeats (L), and for each query term the documents that hold it.
A term's weight and a document's score are the integers described at ``weight`` and ``part``.

Presence masks.  The documents of a block are kept as one bitmap for each query term.  For a query the bitmaps of its
terms, read across, give every document a mask of the terms it holds, and equal masks are one group.  A group's
score is at most the sum of its terms' best parts in the block.  Groups are scored by descending bound, and as soon as
the next bound lies below the query's last place no later group can enter: the result is that of scoring all.  A
task keeps the places of the blocks it has seen, so later blocks open fewer groups.

Size.  Queries are the stated query set and go to the tasks in blocks of ``QUERY_TERMS`` (query, term) pairs; each
block reads all documents once and keeps postings of its terms alone.  Tasks return at most ``top`` places for each
query, which are ranked within 32 shares and then together.  No document leaves its task.

Rows.  A null text has no term; a document or query without terms has no place.  Documents without an id rank after
equal scores with one; documents that repeat an id are ranked each.  Rows that repeat a query's id are one query.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from trolley.llm._store import stored
from trolley.llm._words import chunks, look_up, plain_words

#: (query, term) pairs that go to the tasks at once; a single longer query is a block of its own.
QUERY_TERMS = 500_000
#: Documents of a block, and how many of them are scored at a time.
BLOCK = 4096
STEP = 64

_NO_ID = np.iinfo(np.int64).max
_POSTINGS = "doc_id long, n_terms long, terms array<long>, counts array<int>"


def weight(n_docs: int, holding: np.ndarray) -> np.ndarray:
    """floor(1000 * ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * n_docs + 2) / (2 * int(d) + 1))) for d in holding], np.int64)


def part(count: np.ndarray, length: np.ndarray) -> np.ndarray:
    """What a term that stands ``count`` times in a document of relative length ``length`` adds, for weight 1."""
    return (1_000_000_000 * count) // (1000 * count + 8 * length)


def _signed(hashes: np.ndarray) -> np.ndarray:
    return hashes.view(np.int64)


def _lists(values: np.ndarray, first: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(first, pa.int32()), pa.array(values, kind))


def _term_sets(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Terms with repeats of each text, and (text, term, count) of its distinct terms in the order of texts."""
    words, hashes = plain_words(texts)
    order = np.lexsort((hashes, words.doc))
    doc, term = words.doc[order], hashes[order]
    new = np.ones(len(doc), bool)
    new[1:] = (doc[1:] != doc[:-1]) | (term[1:] != term[:-1])
    at = np.flatnonzero(new)
    return words.counts(), doc[at], term[at], np.diff(np.append(at, len(doc)))


def query_terms(queries: DataFrame, query_id: str, text: str) -> DataFrame:
    """One row per query: its id and the hashes of its distinct terms."""

    def terms(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part_, texts in chunks(batches, 1):
            _, doc, term, _ = _term_sets(texts)
            first = np.searchsorted(doc, np.arange(part_.num_rows + 1))
            yield pa.RecordBatch.from_arrays([part_.column(0), _lists(_signed(term), first, pa.int64())], ["query", "terms"])

    keyed = queries.select(F.col(query_id).alias("query"), F.col(text).cast("string").alias("text"))
    each = keyed.mapInArrow(terms, f"query {keyed.schema['query'].dataType.simpleString()}, terms array<bigint>")
    once = each.groupBy("query").agg(F.array_distinct(F.flatten(F.collect_list("terms"))).alias("terms"))
    return once.filter(F.size("terms") > 0)


def _blocks(queries: DataFrame) -> Iterator[list]:
    """Queries in blocks of at most QUERY_TERMS terms; the driver holds one block."""
    block, total = [], 0
    for row in queries.toLocalIterator():
        if block and total + len(row["terms"]) > QUERY_TERMS:
            yield block
            block, total = [], 0
        block.append(row)
        total += len(row["terms"])
    if block:
        yield block


def _postings(docs: DataFrame, vocabulary: np.ndarray) -> DataFrame:
    """Each document with terms: its id, its terms with repeats, and those of the vocabulary with their counts."""

    def look(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part_, texts in chunks(batches, 1):
            n, doc, term, count = _term_sets(texts)
            hit, which = look_up(vocabulary, term)
            kept = np.flatnonzero(n)
            first = np.searchsorted(doc[hit], np.append(kept, len(n)))
            yield pa.RecordBatch.from_arrays([
                part_.column(0).take(pa.array(kept)), pa.array(n[kept], pa.int64()),
                _lists(which, first, pa.int64()), _lists(count[hit], first, pa.int32()),
            ], ["doc_id", "n_terms", "terms", "counts"])

    return docs.select("doc_id", "text").mapInArrow(look, _POSTINGS)


def _holders(postings: DataFrame) -> DataFrame:
    """How many documents hold each term, counted in the tasks first."""

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            which, n = np.unique(batch.column(0).flatten().to_numpy(zero_copy_only=False), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(which, pa.int64()), pa.array(n, pa.int64())], ["term", "n"])

    return postings.select("terms").mapInArrow(count, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))


@dataclass
class _Block:
    """Some documents as bitmaps over the terms of the queries."""

    ids: np.ndarray  # doc ids, _NO_ID where null
    term: np.ndarray  # postings by term, then document
    doc: np.ndarray
    value: np.ndarray  # weight times part of each posting
    first: dict[int, tuple[int, int]]  # postings of a term
    best: dict[int, int]  # the largest value of a term
    bitmap: dict[int, np.ndarray]  # one bit per document

    @classmethod
    def of(cls, batch: pa.RecordBatch, weights: np.ndarray, n_docs: int, total: int) -> _Block:
        ids = batch.column(0).fill_null(_NO_ID).to_numpy(zero_copy_only=False)
        n = batch.column(1).to_numpy(zero_copy_only=False)
        length = 100 - 90 + (90 * n * n_docs) // total
        lists = batch.column(2)
        doc = np.repeat(np.arange(len(ids)), lists.value_lengths().to_numpy(zero_copy_only=False))
        term = lists.flatten().to_numpy(zero_copy_only=False)
        count = batch.column(3).flatten().to_numpy(zero_copy_only=False).astype(np.int64)
        value = weights[term] * part(count, length[doc])
        order = np.lexsort((doc, term))
        doc, term, value = doc[order], term[order], value[order]
        starts = np.flatnonzero(np.diff(term, prepend=-1))
        ends = np.append(starts[1:], len(term))
        tops = np.maximum.reduceat(value, starts) if len(starts) else value
        bits = np.zeros(len(ids), bool)
        first, best, bitmap = {}, {}, {}
        for t, a, b, top in zip(term[starts].tolist(), starts.tolist(), ends.tolist(), tops.tolist()):
            bits[:] = False
            bits[doc[a:b]] = True
            first[t], best[t], bitmap[t] = (a, b), top, np.packbits(bits)
        return cls(ids, term, doc, value, first, best, bitmap)

    def places(self, terms: np.ndarray, top: int, seen: list[tuple[int, int]]) -> list[tuple[int, int]]:
        """The best (-score, id) of these documents and of those seen before."""
        own = [t for t in terms.tolist() if t in self.first]
        if not own:
            return seen
        size = len(self.ids)
        held = np.unpackbits(np.stack([self.bitmap[t] for t in own]), axis=1, count=size)
        masks = np.ascontiguousarray(np.packbits(held, axis=0).T)
        keys = masks.view(np.dtype((np.void, masks.shape[1]))).ravel()
        _, one, group = np.unique(keys, return_index=True, return_inverse=True)
        bounds = held[:, one].T.astype(np.int64) @ np.array([self.best[t] for t in own], np.int64)
        opened = np.argsort(-bounds, kind="stable")
        members = np.argsort(group, kind="stable")
        starts = np.searchsorted(group[members], np.arange(len(one) + 1))
        at = 0
        while at < len(opened):
            last = -seen[-1][0] if len(seen) == top else 1
            if bounds[opened[at]] < last:
                break
            docs, n = [], 0
            while at < len(opened) and n < STEP and bounds[opened[at]] >= last:
                mask = opened[at]
                docs.append(members[starts[mask] : starts[mask + 1]])
                n += len(docs[-1])
                at += 1
            seen = self._scored(own, np.sort(np.concatenate(docs)), top, seen)
        return seen

    def _scored(self, terms: list[int], docs: np.ndarray, top: int, seen: list[tuple[int, int]]) -> list[tuple[int, int]]:
        scores = np.zeros(len(docs), np.int64)
        for t in terms:
            a, b = self.first[t]
            where, which = look_up(self.doc[a:b], docs)
            scores[where] += self.value[a:b][which]
        best = np.lexsort((self.ids[docs], -scores))[:top]
        found = [(-int(s), int(i)) for s, i in zip(scores[best], self.ids[docs[best]]) if s > 0]
        return sorted(seen + found)[:top]


def _places(postings: DataFrame, block: list, vocabulary: np.ndarray, weights: np.ndarray, n_docs: int, total: int, top: int) -> DataFrame:
    """The best documents of each task for each query of a block."""
    terms = [np.searchsorted(vocabulary, np.array(r["terms"], np.int64).view(np.uint64)) for r in block]

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        places: list[list[tuple[int, int]]] = [[] for _ in terms]
        for batch in batches:
            for at in range(0, batch.num_rows, BLOCK):
                some = _Block.of(batch.slice(at, BLOCK), weights, n_docs, total)
                for q, own in enumerate(terms):
                    places[q] = some.places(own, top, places[q])
        rows = [(q, None if i == _NO_ID else i, -s) for q, found in enumerate(places) for s, i in found]
        for at in range(0, len(rows), 10_000):
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, pa.int64()) for c in zip(*rows[at : at + 10_000])], ["nth", "doc_id", "score"])

    return postings.mapInArrow(search, "nth long, doc_id long, score long")


def _best(places: DataFrame, by: list, top: int) -> DataFrame:
    order = Window.partitionBy(*by).orderBy(F.desc("score"), F.asc_nulls_last("doc_id"))
    return places.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= top)


def search(docs: DataFrame, queries: DataFrame, query_id: str = "item_id", text: str = "text", top: int = 10) -> DataFrame:
    """(query id, rank, doc_id, score) of the ``top`` best documents of each query."""
    spark = docs.sparkSession
    wanted = stored(query_terms(queries, query_id, text), "queries")
    results = []
    for block in _blocks(wanted):
        vocabulary = np.unique(np.concatenate([np.array(r["terms"], np.int64) for r in block]).view(np.uint64))
        postings = stored(_postings(docs, vocabulary), "postings")
        n_docs, total = postings.agg(F.count("*"), F.coalesce(F.sum("n_terms"), F.lit(0))).first()
        if not n_docs:
            continue
        holding = np.zeros(len(vocabulary), np.int64)
        for row in _holders(postings).toLocalIterator():
            holding[row["term"]] = row["n"]
        weights = weight(n_docs, holding)
        found = _places(postings, block, vocabulary, weights, n_docs, total, top)
        shares = _best(found.withColumn("share", F.pmod(F.hash("doc_id"), F.lit(32))), ["nth", "share"], top)
        ranked = _best(shares.drop("rank"), ["nth"], top)
        names = spark.createDataFrame(
            [(n, r["query"]) for n, r in enumerate(block)], f"nth long, query {wanted.schema['query'].dataType.simpleString()}")
        results.append(ranked.join(names, "nth").select(F.col("query").alias(query_id), "rank", "doc_id", "score"))
    if not results:
        kind = wanted.schema["query"].dataType.simpleString()
        return spark.createDataFrame([], f"{query_id} {kind}, rank int, doc_id long, score long")
    return stored(reduce(DataFrame.unionByName, results), "places")
