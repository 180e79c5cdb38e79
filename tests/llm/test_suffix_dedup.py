"""Repeated passages against plain Python, and the merged transforms against sorted suffixes."""

import hashlib
import random
from collections import Counter, defaultdict

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.helpers import docs_of
from trolley.llm import _bwt, suffix_dedup


def plain(rows, depth=400):
    texts = [(i, (t or "").encode()) for i, t in rows]
    windows = Counter(t[k : k + depth] for _, t in texts for k in range(len(t) - depth + 1))
    result = []
    for i, t in texts:
        covered = [False] * len(t)
        last = 0
        for k in range(len(t) - depth + 1):
            if windows[t[k : k + depth]] > 1:
                for p in range(max(k, last), k + depth):
                    covered[p] = True
                last = k + depth
        spans = sum(c and (p == 0 or not covered[p - 1]) for p, c in enumerate(covered))
        kept = bytes(b for b, c in zip(t, covered) if not c)
        result.append((i, len(t), sum(covered), spans, hashlib.sha256(kept).hexdigest()))
    return sorted(result, key=str)


def found(df):
    return sorted(map(tuple, df.select("doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256").collect()), key=str)


def prose(deal, n):
    return " ".join("".join(deal.choices("abcdeé", k=deal.randint(1, 6))) for _ in range(n))


def some_rows():
    deal = random.Random(3)
    passage, other = prose(deal, 300), prose(deal, 110)
    rows = [(k, f"{prose(deal, deal.randint(0, 60))} {passage} {prose(deal, deal.randint(0, 60))}") for k in range(25)]
    rows += [(30 + k, prose(deal, 40) + other[deal.randint(0, 40) :] + prose(deal, 40)) for k in range(25)]
    rows += [(60, passage[:399]), (61, passage[:400]), (62, passage[57:457]), (63, prose(deal, 500))]
    base = prose(deal, 400)
    rows += [(70 + k, base[: 90 * k] + "X" + base[90 * k + 1 :]) for k in range(12)]  # near copies
    rows += [(90, base + base[200:900] + "!" + base), (91, "é" * 900), (92, "xé" * 2000), (93, "abc" * 150), (94, "z" * 399), (94, "z" * 400)]
    period = prose(deal, 60)[:300]
    rows += [(95, period * 9), (96, "-" * 300_000 + prose(deal, 30)), (97, ("-" * 500 + "\n") * 4)]
    return rows + [(98, None), (99, ""), (None, passage), (60, passage[:399]), (100, "copied whole " * 60), (100, "copied whole " * 60)]


def test_equals_counting_all_windows(spark):
    rows = some_rows()
    assert found(suffix_dedup.dedup(docs_of(spark, *rows).repartition(7))) == plain(rows)


def test_frequent_anchors_are_spread(spark, monkeypatch):
    """Every anchor with several classes counted by its windows: the same result."""
    rows = some_rows()
    monkeypatch.setattr(suffix_dedup, "CLASSES", 1)
    assert found(suffix_dedup.dedup(docs_of(spark, *rows))) == plain(rows)
    monkeypatch.setattr(suffix_dedup, "CLASSES", 8)
    assert found(suffix_dedup.dedup(docs_of(spark, *rows))) == plain(rows)


def test_any_portion_gives_the_same(spark, monkeypatch):
    rows = some_rows()
    monkeypatch.setattr(suffix_dedup, "BATCH", 5000)
    monkeypatch.setattr(suffix_dedup, "SHARD", 900)
    assert found(suffix_dedup.dedup(docs_of(spark, *rows))) == plain(rows)


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "short")]])
def test_nothing_to_remove(spark, rows):
    docs = docs_of(spark, *rows) if rows else docs_of(spark, (1, "")).limit(0)
    assert found(suffix_dedup.dedup(docs)) == plain(rows)


def test_kept_bytes(spark):
    rows = [(1, "é" * 300 + "tail"), (2, "é" * 300)]
    kept = {r.doc_id: bytes(r.kept) for r in suffix_dedup.dedup(docs_of(spark, *rows), with_bytes=True).collect()}
    assert kept == {1: b"tail", 2: b""}


def test_many_texts_share_a_passage_at_other_places(spark):
    """A passage in two thirds of all texts, each with its own surroundings: the windows over its ends are alone."""
    deal = random.Random(5)
    passage = prose(deal, 200)
    rows = [(k, f"{prose(deal, 30)}{k} {passage} {k}{prose(deal, 30)}" if k % 3 else prose(deal, 90)) for k in range(300)]
    assert found(suffix_dedup.dedup(docs_of(spark, *rows))) == plain(rows)


def _suffixes(strings):
    return [(k, p) for k, s in enumerate(strings) for p in range(len(s) + 1)]


@settings(max_examples=80, deadline=None)
@given(st.lists(st.lists(st.text("ab", max_size=14), min_size=1, max_size=4), min_size=1, max_size=5), st.integers(1, 3))
def test_merged_blocks_are_equal_prefixes(shards, step):
    """Neighbours share as many whole steps as their strings do, whatever the shards."""
    old, _bwt.STEP = _bwt.STEP, step
    try:
        shards = [[s.encode() for s in shard] for shard in shards]
        depth = 3 * step
        transforms = [_bwt.Transform.of(shard) for shard in shards]
        source, entry, common = _bwt.merge(transforms, depth)
        named = [[(n, k, p) for k, p in _suffixes(shard)] for n, shard in enumerate(shards)]
        order = [named[s][transforms[s].suffix[e]] for s, e in zip(source, entry)]
        assert sorted(order) == sorted(x for shard in named for x in shard)
        heads = [shards[n][k][p : p + depth] for n, k, p in order]
        for (a, b), shared in zip(zip(heads, heads[1:]), common[1:]):
            whole = 0
            while whole < depth and len(a) >= whole + step and a[: whole + step] == b[: whole + step]:
                whole += step
            assert shared == whole
        blocks = defaultdict(set)
        for head, block in zip(heads, np.cumsum(common < depth)):
            if len(head) == depth:
                blocks[head].add(block)
        assert all(len(b) == 1 for b in blocks.values())
    finally:
        _bwt.STEP = old
