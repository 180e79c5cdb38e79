import random

import numpy as np

from tests.llm.helpers import docs_of
from trolley.llm import decontam

random.seed(6)
VOCABULARY = [f"word{k}" for k in range(3000)]


def some(n):
    return [random.choice(VOCABULARY) for _ in range(n)]


ITEMS = [(k, " ".join(some(40))) for k in range(30)] + [(100, None), (101, "too short"), (102, "")]


def local(a, b):
    """Smith-Waterman score by the textbook recurrence."""
    h = np.zeros((len(a) + 1, len(b) + 1), int)
    for i in range(1, len(a) + 1):
        for j in range(1, len(b) + 1):
            step = decontam.MATCH if a[i - 1] == b[j - 1] else decontam.MISMATCH
            h[i, j] = max(0, h[i - 1, j - 1] + step, h[i - 1, j] + decontam.GAP, h[i, j - 1] + decontam.GAP)
    return int(h.max())


def test_alignment_equals_the_recurrence():
    rng = np.random.default_rng(1)
    pairs = [(rng.integers(5, 12, rng.integers(1, 30)).astype(np.uint64), rng.integers(5, 12, rng.integers(1, 60)).astype(np.uint64)) for _ in range(60)]
    found = decontam._align([a for a, _ in pairs], [b for _, b in pairs])
    assert found.tolist() == [local(a, b) for a, b in pairs]


def edited(text, every):
    words = text.split()
    for k in range(every - 1, len(words), every):
        words[k] = random.choice([random.choice(VOCABULARY), words[k] + " " + random.choice(VOCABULARY), ""])
    return " ".join(words)


def rows():
    out = [(k, " ".join(some(200))) for k in range(20)]
    out += [(100 + k, " ".join(some(150)) + " " + ITEMS[k][1].upper() + ". " + " ".join(some(50))) for k in range(10)]
    out += [(200 + k, " ".join(some(100)) + " " + edited(ITEMS[k][1], 6) + " " + " ".join(some(100))) for k in range(30)]
    out += [(300, ITEMS[3][1]), (300, ITEMS[3][1]), (301, None), (302, ""), (None, ITEMS[4][1])]
    return out


def test_copies_and_edited_copies_are_found_and_others_not(spark):
    docs = docs_of(spark, *rows())
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, decontam.index(docs, bench)).collect()]
    want = [(100 + k, k) for k in range(10)] + [(200 + k, k) for k in range(30)] + [(300, 3), (300, 3), (None, 4)]
    assert sorted(found, key=str) == sorted(want, key=str)


def test_equals_aligning_all_pairs(spark):
    rng = random.Random(66)
    common = [f"w{k}" for k in range(40)]  # few words, so that pairs of them stand in many documents
    items = [(k, " ".join(rng.choices(common if k % 2 else VOCABULARY, k=rng.choice([8, 9, 20, 25])))) for k in range(16)]
    out = []
    for _, text in items:
        for every in (2, 3, 4, 5):
            for shift in range(2):
                words = text.split()
                for at in range(every - 1 - shift, len(words), every):
                    words[at] = rng.choice(common) if shift else f"other{at}"
                out.append(words)
            out.append([x for at, w in enumerate(text.split()) for x in ([w, f"more{at}"] if at % every == every - 1 else [w])])
    rows = [(k, " ".join(rng.choices(common, k=rng.randint(0, 30)) + words + rng.choices(common, k=9))) for k, words in enumerate(out)]
    docs, bench = docs_of(spark, *rows), spark.createDataFrame(items, "item_id long, text string")
    found = {(r.doc_id, r.item_id): r.share for r in decontam.contaminated(docs, decontam.index(docs, bench)).collect()}
    shares = {(d, k): local(item.split(), text.split()) / (decontam.MATCH * len(item.split())) for d, text in rows for k, item in items}
    want = {pair: share for pair, share in shares.items() if share >= decontam.LEAST_SHARE}
    assert found == want and {d // 3 % 4 for d, _ in want} == {0, 1, 2, 3}


def test_short_items_and_items_without_spaces(spark):
    chinese = "床前明月光，疑是地上霜。举头望明月，低头思故乡。白日依山尽，黄河入海流。"
    thai = "ภาษาไทยเป็นภาษาที่มีระดับเสียงของคำแน่นอน"
    items = [(1, "What is two plus two?"), (2, "solitary"), (3, "明月几时有"), (4, chinese), (5, thai), (6, "What is two plus two?"), (7, "...")]
    noise = " ".join(some(30))
    rows = [(1, noise + " what IS two, plus two " + noise), (2, "what is two plus three"), (3, "solitary"), (4, "solitaryness"),
            (5, "把酒问青天明月几时有不知"), (6, "明月几时没有"), (7, noise + "他说：「" + chinese.replace("，", "").replace("地上", "天下") + "」"),
            (8, chinese[:5] + "，不知天上宫阙，今夕是何年"), (9, noise + thai[2:] + "ครับ"), (10, None), (11, "")]
    docs, bench = docs_of(spark, *rows), spark.createDataFrame(items, "item_id long, text string")
    found = [(r.doc_id, r.item_id) for r in decontam.contaminated(docs, decontam.index(docs, bench)).collect()]
    assert sorted(found) == [(1, 1), (1, 6), (3, 2), (5, 3), (7, 4), (9, 5)]
    brief = spark.createDataFrame(items[:3], "item_id long, text string")
    assert sorted(r.doc_id for r in decontam.clean(docs, decontam.index(docs, brief)).collect()) == [2, 4, 6, 7, 8, 9, 10, 11]


def test_clean_rows_keep_their_columns(spark):
    docs = docs_of(spark, *rows())
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    kept = decontam.clean(docs, decontam.index(docs, bench))
    assert kept.columns == docs.columns
    assert sorted(r.doc_id for r in kept.collect()) == [*range(20), 301, 302]


def test_many_blocks_give_the_same(spark, monkeypatch):
    docs = docs_of(spark, *rows())
    bench = spark.createDataFrame(ITEMS, "item_id long, text string")
    one = sorted(map(tuple, decontam.contaminated(docs, decontam.index(docs, bench)).collect()), key=str)
    monkeypatch.setattr(decontam, "BLOCK_ITEMS", 7)
    blocks = decontam.index(docs, bench)
    assert len(blocks) > 3
    assert sorted(map(tuple, decontam.contaminated(docs, blocks).collect()), key=str) == one


def test_empty_tables(spark):
    docs, bench = docs_of(spark, *rows()), spark.createDataFrame(ITEMS, "item_id long, text string")
    assert decontam.contaminated(docs.limit(0), decontam.index(docs.limit(0), bench)).collect() == []
    assert decontam.contaminated(docs, decontam.index(docs, bench.limit(0))).collect() == []
