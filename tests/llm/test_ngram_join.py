import random

import numpy as np
import pytest

from tests.llm.helpers import DATA, docs_of, joined
from trolley.llm import ngram_join
from trolley.llm.ngram_join import Threshold, components, entries, join


@pytest.mark.parametrize("crowd", [{}, {b: 10**9 for b in range(80)}], ids=["empty entered", "empty skipped"])
@pytest.mark.parametrize("num", [80, 90])
def test_alike_sets_share_an_entry(num, crowd):
    random.seed(num + len(crowd))
    rule = Threshold(3, num, 100)
    for size in [3, 4, 5, 6, 8, 9, 10, 11, 14, 18, 20, 27, 40, 90, 260] * 4:
        base = [random.getrandbits(60) for _ in range(size)]
        sets = []
        for _ in range(25):
            own = set(base)
            for _ in range(random.randint(0, 1 + size // 7)):
                if random.random() < 0.5 and len(own) > 1:
                    own.remove(random.choice(sorted(own)))
                else:
                    own.add(random.getrandbits(60))
            sets.append(np.array(sorted(own), np.uint64))
        first = np.concatenate(([0], np.cumsum([len(s) for s in sets])))
        keys, owner = entries(np.concatenate(sets), first, rule, crowd)
        of = [set(keys[owner == k].tolist()) for k in range(len(sets))]
        for a in range(len(sets)):
            for b in range(a):
                if ngram_join._alike(sets[a], sets[b], rule) and not np.array_equal(sets[a], sets[b]):
                    assert of[a] & of[b]


@pytest.fixture(scope="module")
def odd():
    random.seed(4)
    vocabulary = [f"w{k}" for k in range(400)]
    long = [random.choice(vocabulary) for _ in range(3000)]
    near = [" ".join(long[:150] + [random.choice(vocabulary) for _ in range(2)]) for _ in range(40)]
    shared = [" ".join(long[200:260] + [random.choice(vocabulary) for _ in range(40)]) for _ in range(40)]
    texts = [None, "", " \n", "one two", "ONE  Two", " ".join(long), " ".join(long) + " x", *near, *shared, near[0].upper()]
    rows = list(enumerate(texts, 10))
    return rows + [(11, "a b c d e f"), (11, "a b c d e f"), (5000, near[1]), (5000, shared[1] + " q"), (None, near[0]), (None, None)]


@pytest.mark.parametrize("n, num", [(3, 90), (5, 80)])
def test_equals_comparing_all(spark, odd, n, num):
    found = sorted(map(tuple, join(docs_of(spark, *odd), n, num, 100).collect()), key=str)
    assert found == joined(odd, n, num, 100)


def test_equals_comparing_all_on_data(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    rows = [(r.doc_id, r.text) for r in docs.collect()]
    assert sorted(map(tuple, join(docs).collect()), key=str) == joined(rows, 5, 80, 100)


def test_all_pairs_across_components_are_tried(spark, monkeypatch):
    """Where the first ties lead nowhere, the other pairs of a segment's group must."""
    monkeypatch.setattr(ngram_join, "BLOCK", 2)
    random.seed(9)
    words = [f"t{k}" for k in range(120)]
    rows = []
    for k in range(30):  # a chain: neighbours are alike, the ends are not
        rows.append((k, " ".join(words[k : k + 60])))
    assert sorted(map(tuple, join(docs_of(spark, *rows), 3, 80, 100).collect()), key=str) == joined(rows, 3, 80, 100)


def test_components_of_a_long_chain(spark):
    links = spark.createDataFrame([(k, k + 1) for k in range(0, 60)] + [(200, 100), (7, 7)], "a long, b long")
    found = {r.id: r.root for r in components(links).collect()}
    assert found == {k: 0 for k in range(61)} | {100: 100, 200: 100}


def test_empty_table(spark):
    out = join(docs_of(spark, (1, "a")).limit(0))
    assert out.columns == ["doc_id", "n_shingles", "component_id"] and out.collect() == []


def test_sketches_never_rule_out_alike_sets(spark):
    """Bits that differ are at most the elements that do, also between sketches of two lengths; unlike sets show more."""
    random.seed(12)
    rule = Threshold(5, 80, 100)
    sets, rows = [], []
    for size, change in [(1, 1), (40, 6), (300, 30), (600, 60), (1150, 100), (1200, 120), (1150, 900), (5000, 4000)]:
        base = [random.getrandbits(60) for _ in range(size)]
        more = [random.getrandbits(60) for _ in range(change)]
        sets += [sorted(base), sorted(base + more)]
    size = np.array([len(s) for s in sets])
    grams = np.array([g for s in sets for g in s], np.uint64)
    sketches = ngram_join._sketches(grams, np.repeat(np.arange(len(sets)), size), size, rule).to_pylist()
    for k in range(0, len(sets), 2):
        for x, y in ((k, k + 1), (k + 1, k)):
            rows.append((x, y, sketches[x], sketches[y], int(abs(size[x] - size[y])), int(rule.differences(size[x] + size[y]))))
    assert {len(a) == len(b) for _, _, a, b, _, _ in rows} == {True, False}
    table = spark.createDataFrame(rows, "x int, y int, x_sketch array<long>, y_sketch array<long>, apart int, most int")
    for row in table.withColumn("bits", ngram_join._apart("x_sketch", "y_sketch")).collect():
        assert row.bits <= row.apart
        if row.apart > 2 * row.most and len(row.x_sketch) == len(row.y_sketch):
            assert row.bits > row.most
