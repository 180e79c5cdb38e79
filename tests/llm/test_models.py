"""The trained operators: exact parts against plain Python, verdicts on held-out rows."""

import math
import random
import zlib
from collections import Counter

import numpy as np
import pytest
from pyspark.sql import functions as F

from tests.llm.helpers import docs_of, words_of
from trolley.llm import language_id, lm_score, quality, toxicity

random.seed(12)
STEMS = {"aa": "the ing tion er of and with ly".split(), "bb": "der ung keit schen und mit zu ich".split()}


def text_in(lang, n):
    return " ".join("".join(random.choice(STEMS[lang]) for _ in range(random.randint(1, 3))) for _ in range(n))


# language identification

def lang_rows(n=160):
    rows = [(k, text_in(("aa", "bb")[k % 2], random.randint(3, 60)), ("aa", "bb")[k % 2]) for k in range(n)]
    return rows + [(1000, None, "aa"), (1001, "", "bb"), (1002, "123 !!", "aa"), (1003, text_in("bb", 30), None), (1003, "x", None), (None, text_in("aa", 20), None)]


def learn_from():
    return F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 != 2


def test_languages_of_held_out_texts(spark):
    rows = lang_rows()
    docs = docs_of(spark, *rows)
    model = language_id.fit(docs, learn_from())
    found = language_id.predict(docs, model).collect()
    assert len(found) == len(rows)
    by_id = {r.doc_id: r for r in found if r.doc_id != 1003}
    held = [(i, lang) for i, _, lang in rows if i is not None and i < 1000 and zlib.crc32(str(i).encode()) % 4 == 2]
    assert np.mean([by_id[i].lang_pred == lang for i, lang in held]) > 0.95
    for i in (1000, 1001, 1002):
        assert (by_id[i].lang_pred, by_id[i].score, by_id[i].rejected) == ("und", 0.0, True)
    assert all(0 <= r.score <= 1 for r in found) and by_id[None].lang_pred == "aa"


def test_labels_and_sources_are_no_inputs(spark):
    docs = docs_of(spark, *lang_rows())
    model = language_id.fit(docs, learn_from())
    other = docs.withColumn("lang", F.lit("zz")).withColumn("source", F.lit(None).cast("string"))
    assert sorted(map(str, language_id.predict(docs, model).collect())) == sorted(map(str, language_id.predict(other, model).collect()))


def test_accepted_rows_keep_their_columns(spark):
    docs = docs_of(spark, *lang_rows())
    model = language_id.fit(docs, learn_from())
    kept = language_id.accepted(docs, model)
    rejected = {r.doc_id for r in language_id.predict(docs, model).filter("rejected").collect()}
    assert kept.columns == docs.columns and {1000, 1001, 1002} <= rejected
    assert {r.doc_id for r in kept.collect()} == {i for i, *_ in lang_rows()} - rejected


def test_no_labels_and_no_rows(spark):
    docs = docs_of(spark, (1, "text", None), (2, None, None))
    model = language_id.fit(docs, F.lit(True))
    assert {(r.lang_pred, r.score, r.rejected) for r in language_id.predict(docs, model).collect()} == {("und", 0.0, True)}
    assert language_id.predict(docs.limit(0), language_id.fit(docs.limit(0), F.lit(True))).collect() == []


def test_long_texts_and_batches_give_the_same_sums(monkeypatch):
    texts = [text_in("aa", n).encode() for n in (1, 5, 50)] + [b"", b"a", "é".encode()]
    model = language_id.train([text_in(k, 30).encode() for k in ("aa", "bb") * 20], ["aa", "bb"] * 20)
    together = model.logits(texts)
    assert np.allclose(together, [model.logits([t])[0] for t in texts])
    monkeypatch.setattr(language_id, "LONG_TEXT", 3)
    assert np.allclose(together, model.logits(texts), atol=1e-5)


# quality

def plain_counts(text):
    text = text or ""
    words, lines = words_of(text, lower=False), [x for x in text.split("\n") if words_of(x)]
    windows = [tuple(words[k : k + 5]) for k in range(len(words) - 4)]
    often = Counter(windows)
    marked = {k + j for k, w in enumerate(windows) if often[w] > 1 for j in range(5)}
    symbols = sum(text.count(c) for c in "#*$%&|<>")
    return len(words), sum(map(len, words)), symbols, len(lines) - len(set(lines)), len(marked)


def test_statistics_equal_plain_python():
    random.seed(3)
    texts = [None, "", "\n \n", "a\na\n a\na", "x x x x x x", "é日 #|<\n" * 4, "p q r s t p q r s t u"]
    texts += ["".join(random.choice(["a", "B", " ", "\n", "#", "é", "\t"]) for _ in range(random.randint(0, 300))) for _ in range(100)]
    found = quality.statistics([(t or "").encode() for t in texts])
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    assert list(zip(*(found[c].tolist() for c in names))) == [plain_counts(t) for t in texts]


def test_trees_are_monotonic_and_flattened_trees_agree():
    rng = np.random.default_rng(2)
    x = rng.random((1500, 3))
    y = ((x[:, 0] + 0.3 * rng.random(1500) < 0.7) & (x[:, 1] > 0.2)).astype(float)
    model = quality.boost(x, y, [-1, 1, 0])
    assert (model.chance(x[y == 1]) > 0.5).mean() > 0.85 and (model.chance(x[y == 0]) < 0.5).mean() > 0.8
    grid = rng.random((200, 3))
    for feature, direction in ((0, -1), (1, 1)):
        steps = []
        for value in np.linspace(0, 1, 30):
            moved = grid.copy()
            moved[:, feature] = value
            steps.append(model.chance(moved))
        assert (direction * np.diff(np.array(steps), axis=0) >= -1e-12).all()

    def walk(tree, row):
        node = 0
        while node < model.feature.shape[1]:
            node = 2 * node + 1 + int(row[model.feature[tree, node]] > model.limit[tree, node])
        return model.value[tree, node - model.feature.shape[1]]

    by_hand = [model.start + sum(walk(t, row) for t in range(len(model.value))) for row in grid]
    assert np.allclose(model.chance(grid), 1 / (1 + np.exp(-np.array(by_hand))))


def test_quality_verdicts(spark):
    good = [(k, text_in("aa", 60)) for k in range(80)]
    bad = [(100 + k, text_in("aa", 60).replace(" ", "### ")) for k in range(80)]
    odd = [(500, None), (501, "few words"), (502, "a b c d e f g " * 5), (3, good[3][1]), (None, good[5][1])]
    docs = docs_of(spark, *good, *bad, *odd)
    labels = spark.createDataFrame([(k, int(k < 100)) for k, _ in good[:60] + bad[:60]] + [(7, None), (None, 1), (9999, 0)], "doc_id long, quality int")
    found = quality.judge(docs, quality.fit(docs, labels)).collect()
    by_id = {r.doc_id: r for r in found}
    assert len(found) == 165 and all(by_id[k].kept for k in range(80)) and by_id[None].kept
    assert not any(by_id[100 + k].kept for k in range(80))
    assert all(by_id[k].base_failed and not by_id[k].kept for k in (500, 501, 502))
    none = quality.judge(docs, quality.fit(docs, labels.filter("quality = 1")))
    assert {r.kept == (not r.base_failed) and r.chance is None for r in none.collect()} == {True}
    assert quality.judge(docs.limit(0), quality.fit(docs.limit(0), labels)).collect() == []


# toxicity

def test_toxic_words_and_beginnings_are_learnt(spark):
    def toxic(k):
        words = text_in("aa", 60).split()
        for _ in range(4):
            words.insert(random.randrange(len(words)), random.choice(["idiot", "scum"] if k % 2 else ["pathetic", "grobian" + random.choice(STEMS["bb"])]))
        return " ".join(words)

    clean = [(k, text_in("aa", 60)) for k in range(160)]
    bad = [(1000 + k, toxic(k)) for k in range(120)]
    odd = [(5000, None), (5001, ""), (5, clean[5][1]), (None, bad[1][1])]
    docs = docs_of(spark, *clean, *bad, *odd).withColumn("toxic", F.lit("clash"))
    labels = spark.createDataFrame([(k, int(k >= 1000)) for k, _ in clean[:110] + bad[:80]] + [(None, 1), (3, None)], "doc_id long, toxic int")
    chain = toxicity.fit(docs, labels)
    found = toxicity.predict(docs, chain).collect()
    assert len(found) == len(clean) + len(bad) + 4
    assert not [r.doc_id for r in found if r.doc_id is not None and r.doc_id < 1000 and r.toxic]
    assert np.mean([r.toxic for r in found if r.doc_id is None or 1000 <= r.doc_id < 5000]) > 0.95
    by_id = {r.doc_id: r for r in found}
    assert not by_id[5000].toxic and by_id[5000].p_toxic == by_id[5001].p_toxic
    insults = [r.p_insult for r in found if r.doc_id is not None and 1000 <= r.doc_id < 5000 and r.doc_id % 2]
    others = [r.p_insult for r in found if r.doc_id is not None and 1000 <= r.doc_id < 5000 and not r.doc_id % 2]
    assert np.mean(insults) > 0.7 > 0.3 > np.mean(others)
    assert toxicity.fit(docs, labels.filter("toxic = 0")) is None
    assert not any(r.toxic for r in toxicity.predict(docs, None).collect())
    assert toxicity.predict(docs.limit(0), chain).collect() == []


def test_later_models_see_out_of_fold_predictions():
    rng = np.random.default_rng(1)
    x = (rng.random((400, 6)) < 0.3).astype(np.float32)
    first = (x[:, 0] > 0).astype(int)
    chain = toxicity.train(x, {"insult": first, "toxic": first}, np.arange(6, dtype=np.uint64))
    assert [len(w) for w in chain.weights] == [6, 7] and chain.weights[1][6] > 0


def test_long_texts_leave_every_language_its_sample(spark):
    rows = [(k, text_in(("aa", "bb")[k % 2], 30), ("aa", "bb")[k % 2]) for k in range(200)]
    rows += [(1000, text_in("aa", 20) + " " + text_in("aa", 40) * 2000, "aa"), (1001, "zyx wvu tsr " * 3000, "cc")]
    rows += [(2000 + k, "the same text", "bb") for k in range(50)]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    model = language_id.fit(docs, F.lit(True), max_bytes=60_000)
    assert list(model.languages) == ["aa", "bb", "cc"]
    found = language_id.predict(docs.filter("doc_id < 200"), model).collect()
    assert sum(r.lang_pred == ("aa", "bb")[r.doc_id % 2] for r in found) >= 195


# language-model scores

def lm_rows():
    return [(k, text_in(("aa", "bb")[k % 2], random.randint(1, 80))) for k in range(150)] + [
        (900, None), (901, ""), (902, " \n "), (903, "never seen befores never"), (4, "doubled id"), (None, "the null id"), (904, "The THE the")]


@pytest.mark.parametrize("head", [1 << 19, 20])
def test_counts_and_base_scores(spark, monkeypatch, head):
    monkeypatch.setattr(lm_score, "HEAD", head)
    random.seed(1)
    rows = lm_rows()

    def held(i):
        return i is not None and zlib.crc32(str(i).encode()) % 10 == 0

    docs = docs_of(spark, *rows)
    out = lm_score.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).collect()
    counts = Counter()
    for i, text in rows:
        if not held(i):
            counts.update([*words_of(text), ""])
    total, types = sum(counts.values()), len(counts)
    want = []
    for i, text in rows:
        tokens = [*words_of(text), ""]
        base = sum(math.log10((counts[w] + 0.1) / (total + 0.1 * (types + 1))) for w in tokens)
        want.append((i, held(i), len(tokens), sum(counts[w] > 0 for w in tokens), total, round(base, 6)))
    found = [(r.doc_id, r.held_out, r.n_tokens, r.n_known, r.train_tokens, round(r.base_score, 6)) for r in out]
    assert sorted(found, key=str) == sorted(want, key=str)
    own = [r for r in out if r.held_out]
    assert sum(r.score for r in own) > sum(r.base_score for r in own)  # word order and language help


def test_probabilities_sum_to_one():
    random.seed(2)
    texts = [text_in("aa", 30).encode() for _ in range(20)]
    tokens, _, position = lm_score._tokens(texts)
    words, counts = np.unique(tokens, return_counts=True)
    place = np.full(len(words), -1)
    place[np.argsort(-counts)[:20]] = np.arange(20)
    rest = float(counts[place < 0].sum() + lm_score.SMOOTH * ((place < 0).sum() + 1))
    v = lm_score.Vocabulary(words, counts, place, int(counts.sum()), len(words), rest)
    learner = lm_score._Learner(lm_score.Model.of(v))
    learner.learn(lm_score._places(v, tokens)[0], lm_score._contexts(tokens, position))
    for at in (0, 7, 100):
        ctx = np.repeat(lm_score._contexts(tokens, position)[:, at : at + 1], len(words), axis=1)
        p = np.exp(lm_score.log_chances(learner.model, place, ctx))
        p[place < 0] *= (counts[place < 0] + lm_score.SMOOTH) / rest
        unknown = p[place < 0][0] / (counts[place < 0][0] + lm_score.SMOOTH) * lm_score.SMOOTH
        assert abs(p.sum() + unknown - 1) < 1e-4


def test_tree_is_huffmans():
    rng = np.random.default_rng(3)
    for n in (1, 2, 8, 9, 700):
        mass = np.sort(rng.pareto(1, n) + 0.1)[::-1]
        tree = lm_score.Tree.of(mass)
        depth, node, child = tree.path(np.arange(n))
        own = np.repeat(np.arange(n), depth)
        share = np.exp(np.bincount(own, tree.bias[node, child], n))
        assert np.allclose(share, mass / mass.sum(), rtol=1e-4)  # the untrained model is the unigram model
        heap = [*mass.tolist(), *[0.0] * (-(n - 1) % (lm_score.WIDTH - 1))]
        cost = 0.0
        while len(heap) > 1:
            heap.sort()
            least, heap = sum(heap[: lm_score.WIDTH]), heap[lm_score.WIDTH :]
            heap.append(least)
            cost += least
        assert math.isclose((mass * depth).sum(), cost, rel_tol=1e-9)


def test_order_of_words_is_learnt(spark, monkeypatch):
    monkeypatch.setattr(lm_score, "HEAD", 1 << 19)
    random.seed(5)
    names = [f"w{k}" for k in range(2500)]  # more words than a table of a fixed thousand would hold
    texts = []
    for _ in range(1500):
        at = random.randrange(2500)
        texts.append(" ".join(names[(at + k * 7) % 2500] for k in range(40)))
    docs = docs_of(spark, *enumerate(texts))
    out = lm_score.score(docs, F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0).filter("held_out").collect()
    gain = sum(r.score - r.base_score for r in out) / sum(r.n_tokens for r in out)
    assert gain > 0.5


def test_no_training_and_no_rows(spark):
    docs = docs_of(spark, (1, "a b"), (2, None))
    out = lm_score.score(docs, F.lit(True)).collect()
    assert {(r.n_known, r.train_tokens, r.base_score) for r in out} == {(0, 0, 0.0)} and all(abs(r.score) < 1e-6 for r in out)
    assert lm_score.score(docs.limit(0), F.lit(False)).collect() == []
