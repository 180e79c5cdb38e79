"""Ranked search against plain Python that scores all documents."""

import math
import random
import re
from collections import Counter

import pytest

from tests.llm.helpers import docs_of
from trolley.llm import ranked_search


def terms(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def plain(docs, items, top=10):
    held = [(i, Counter(terms(t))) for i, t in docs if terms(t)]
    size, total = len(held), sum(sum(c.values()) for _, c in held)
    holding = Counter(t for _, c in held for t in c)
    wanted = {}
    for i, text in items:
        wanted.setdefault(i, set()).update(terms(text))
    rows = []
    for item, own in wanted.items():
        scores = []
        for name, c in held:
            m = 100 - 90 + (90 * sum(c.values()) * size) // total
            score = sum(math.floor(1000 * math.log((2 * size + 2) / (2 * holding[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m))
                        for t in own if t in c)
            if score > 0:
                scores.append((-score, float("inf") if name is None else name))
        rows += [(item, k, None if i == float("inf") else i, -s) for k, (s, i) in enumerate(sorted(scores)[:top], 1)]
    return sorted(rows, key=str)


def found(spark, docs, items, **more):
    queries = spark.createDataFrame(items, "item_id long, text string") if items else spark.createDataFrame([], "item_id long, text string")
    result = ranked_search.search(docs, queries, **more)
    return sorted(map(tuple, result.select("item_id", "rank", "doc_id", "score").collect()), key=str)


ITEMS = [
    (1, "Alpha beta GAMMA"), (2, "alpha, alpha; alpha!"), (3, None), (4, "..."), (5, "zzz"), (6, "naïve 東京 x_y 7"),
    (7, "the"), (8, "Alpha beta"), (8, "delta"), (9, " ".join(f"w{k}" for k in range(90)))]


def some_docs(n=400):
    deal = random.Random(7)
    words = ["alpha", "beta", "Gamma", "delta", "the", "naïve", "東京", "x", "y", "7"] + [f"w{k}" for k in range(90)]
    rows = [(k, " ".join(deal.choices(words[: deal.choice([5, 10, 100])], k=deal.choice([1, 3, 30, 200])))) for k in range(n)]
    rows += [(n + k, "alpha beta") for k in range(30)]  # ties, above and below the last place
    return rows + [(3, rows[3][1]), (None, "alpha beta gamma delta"), (9001, None), (9002, ""), (9003, "!?"), (9004, "the " * 50_000)]


def test_equals_scoring_all(spark):
    rows = some_docs()
    assert found(spark, docs_of(spark, *rows).repartition(5), ITEMS) == plain(rows, ITEMS)


def test_any_block_and_any_number_of_places(spark, monkeypatch):
    rows = some_docs(150)
    monkeypatch.setattr(ranked_search, "BLOCK", 16)
    monkeypatch.setattr(ranked_search, "STEP", 1)
    monkeypatch.setattr(ranked_search, "QUERY_TERMS", 4)  # several blocks of queries, one longer than a block
    for top in (1, 3, 200):
        assert found(spark, docs_of(spark, *rows), ITEMS, top=top) == plain(rows, ITEMS, top)


def test_late_groups_are_not_scored(spark, monkeypatch):
    """Documents of low groups stay unopened once the places are safe."""
    import numpy as np
    import pyarrow as pa

    docs = [(k, "rare common" if k < 20 else "common") for k in range(2000)]
    vocabulary = {"rare": 0, "common": 1}
    held = [(i, [vocabulary[w] for w in t.split()]) for i, t in docs]
    batch = pa.RecordBatch.from_arrays(
        [pa.array([i for i, _ in held]), pa.array([len(w) for _, w in held]),
         pa.array([w for _, w in held], pa.list_(pa.int64())), pa.array([[1] * len(w) for _, w in held], pa.list_(pa.int32()))],
        ["doc_id", "n_terms", "terms", "counts"])
    weights = ranked_search.weight(2000, np.array([20, 2000]))
    block = ranked_search._Block.of(batch, weights, 2000, 2020)
    scored = []
    monkeypatch.setattr(ranked_search._Block, "_scored", lambda self, own, at, top, seen, real=ranked_search._Block._scored: (
        scored.extend(at.tolist()), real(self, own, at, top, seen))[1])
    assert [i for _, i in block.places(np.array([0, 1]), 10, [])] == list(range(10))
    assert 20 <= len(scored) <= 20 + ranked_search.STEP or len(scored) == 2000 and weights[1] > 0
    scored.clear()
    block.places(np.array([0, 1]), 10, [(-(10**12), -1)] * 10)
    assert scored == []


@pytest.mark.parametrize("rows", [[], [(1, None), (2, "?")]])
def test_nothing_to_rank(spark, rows):
    docs = docs_of(spark, *rows) if rows else docs_of(spark, (1, "")).limit(0)
    assert found(spark, docs, ITEMS) == []
    assert found(spark, docs_of(spark, (1, "alpha")), []) == []


def test_queries_with_text_ids(spark):
    queries = spark.createDataFrame([("a", "alpha"), (None, "alpha")], "item_id string, text string")
    result = ranked_search.search(docs_of(spark, (1, "alpha"), (2, "beta")), queries)
    assert sorted((r.item_id or "", r["rank"], r.doc_id) for r in result.collect()) == [("", 1, 1), ("a", 1, 1)]
