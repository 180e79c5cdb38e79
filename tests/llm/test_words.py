import random

import numpy as np

from tests.llm.helpers import words_of
from trolley.llm._words import Words, fold, look_up, mix, plain_words


def test_words_and_hashes_are_those_of_the_texts():
    random.seed(1)
    alphabet = ["A", "b", "é", "日", " ", "\n", "\t", "\r", "\x0b", " ", "9", "-"]
    texts = ["".join(random.choice(alphabet) for _ in range(random.randint(0, 40))) for _ in range(200)]
    words = Words.of([t.encode() for t in texts])
    hashes, seen = words.hashes(), {}
    for k, text in enumerate(texts):
        own = hashes[words.first[k] : words.first[k + 1]]
        assert len(own) == len(words_of(text))
        for word, h in zip(words_of(text), own.tolist()):
            assert seen.setdefault(word, h) == h
    assert len(set(seen.values())) == len(seen)


def test_ngrams_stay_inside_a_text():
    words = Words.of([b"a b c", b"", b"a b", b"a b c d"])
    grams, doc = words.ngrams(words.hashes(), 3)
    assert doc.tolist() == [0, 3, 3] and grams[0] == grams[1] != grams[2]
    assert len(words.ngrams(words.hashes(), 20)[0]) == 0


def test_mix_is_one_to_one_and_fold_ordered():
    x = np.arange(10_000, dtype=np.uint64)
    assert len(np.unique(mix(x))) == len(x)
    assert (fold([x, x + np.uint64(1)]) != fold([x + np.uint64(1), x])).all()


def test_plain_words_and_look_up():
    _, hashes = plain_words(["Don't STOP, don_t stop été".encode()])
    assert hashes[2] == hashes[5] and hashes[0] == hashes[3] and hashes[1] == hashes[4] and len(hashes) == 7
    hit, at = look_up(np.array([2, 5], np.uint64), np.array([5, 1, 2, 5, 9], np.uint64))
    assert hit.tolist() == [0, 2, 3] and at.tolist() == [1, 0, 1]
    assert not len(look_up(np.zeros(0, np.uint64), np.ones(2, np.uint64))[0])
