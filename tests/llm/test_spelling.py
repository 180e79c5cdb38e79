"""Spelling variants against plain Python that compares all words."""

import re
import zlib
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings, strategies as st

from tests.llm.helpers import docs_of
from trolley.llm import spelling


def one_edit(a, b):
    a, b = sorted((a, b), key=len)
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(b) == len(a) + 1 and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain(rows):
    n = Counter()
    for name, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = re.sub("[A-Z]", lambda m: m[0].lower(), run)
            h = zlib.crc32(f"{'' if name is None else name}:{run}".encode())
            n[run[: h % len(run)] + run[h % len(run) + 1 :] if h % 31 == 0 else run] += 1
    n = {w: c for w, c in n.items() if len(w) >= 7 and c >= 2}
    near = {w: [v for v in n if one_edit(w, v)] for w in n}
    form = {}
    for w in n:
        best = min(near[w], key=lambda v: (-n[v], v), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None
    rows = []
    for w in n:
        root = w
        while form[root]:
            root = form[root]
        rows.append((w, form[w], root, n[w], len(near[w]), n.get(form[w])))
    return sorted(rows, key=str)


def found(df):
    return sorted(map(tuple, df.select("word", "form", "root", "n", "n_near", "form_n").collect()), key=str)


def test_equals_comparing_all(spark):
    long = "ab" * 60
    rows = [
        (1, " ".join(["letters"] * 200 + ["leters"] * 3 + ["lettters"] * 2 + ["leteters", "lettesr", "Lettres"] * 2)),
        (2, " ".join(["letters"] * 300 + ["lettters"] * 30 + ["letttters"] * 3)),  # a chain of forms
        (3, "xétters Xétters XÉTTERS l×tters l×tters, don't aaaaaaa aaaaaaa aaaaaaaa aaaaaaaa"),
        (4, f"{long} {long} {long}c {long}c {long[:-1]} {long[:-1]} {'a' * 5000} {'a' * 5000} {'a' * 4999} {'a' * 4999}"),
        (5, None), (6, ""), (None, "nameless nameless namelest namelest"), (7, "same words twice same words twice"),
        (7, "same words twice same words twice"),
    ]
    rows += [(10 + k, " ".join(["tionally", "tionaly", "tionalli"] * (k % 3 + 1))) for k in range(300)]
    result = found(spelling.variants(docs_of(spark, *rows)))
    assert result == plain(rows)
    assert any(form and form != root for _, form, root, *_ in result)


def test_ties_and_single_rows(spark):
    rows = [(1, "aaaaaab aaaaaab aaaaaac aaaaaac aaaaaad aaaaaad")]
    assert found(spelling.variants(docs_of(spark, *rows))) == plain(rows)
    twenty = [(1, " ".join(["aaaaaab"] * 20 + ["aaaaaac"] * 20 + ["aaaaaad"] * 2))]
    assert ("aaaaaad", "aaaaaab", "aaaaaab", 2, 2, 20) in found(spelling.variants(docs_of(spark, *twenty)))


@pytest.mark.parametrize("rows", [[], [(1, None)], [(1, "short words")]])
def test_nothing_to_compare(spark, rows):
    assert found(spelling.variants(docs_of(spark, *rows) if rows else docs_of(spark, (1, "")).limit(0))) == []


@settings(max_examples=60, deadline=None)
@given(st.sets(st.text("abé", min_size=1, max_size=7), min_size=2, max_size=60))
def test_no_near_pair_is_lost(words):
    words = sorted(words)
    some = spelling.signatures_of(words)
    pairs = []
    for k in range(some.shape[1]):
        _, group = np.unique(some[:, k], return_inverse=True)
        a, b = spelling.near_pairs(group, np.full(len(words), k), words)
        pairs += [tuple(sorted((words[i], words[j]))) for i, j in zip(a, b)]
    assert sorted(pairs) == [(v, w) for v in words for w in words if v < w and one_edit(v, w)]  # each exactly once


def test_signatures_go_in_portions(spark, monkeypatch):
    rows = [(k, " ".join(f"{a}{b}tional" for a in "abcdefgh" for b in "abcdefgh")) for k in range(3)]
    whole = found(spelling.variants(docs_of(spark, *rows)))
    monkeypatch.setattr(spelling, "PORTION", 7)
    assert found(spelling.variants(docs_of(spark, *rows))) == whole == plain(rows)
