"""Tables for the operator tests."""

import re
from collections import defaultdict

from pyspark.sql import DataFrame, functions as F

DATA = "/root/testdata/sf0.001"
DOCS = "doc_id long, text string, lang string, source string, n_chars long"


def docs_of(spark, *rows) -> DataFrame:
    """Documents from (doc_id, text) or (doc_id, text, lang), with columns that clash with the operators' own."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else None, "s", len(r[1] or "")) for r in rows]
    return spark.createDataFrame(full, DOCS).withColumns(
        {c: F.lit("clash") for c in ("id", "row", "key", "words", "a", "n_tokens", "component_id", "label", "base", "tested")})


def words_of(text, lower=True):
    text = text or ""
    if lower:
        text = re.sub("[A-Z]", lambda m: m[0].lower(), text)
    return re.findall(r"[^\x20\x09-\x0D]+", text)


def shingles(text, n):
    w = words_of(text)
    if len(w) < n:
        return frozenset([tuple(w)] if w else [])
    return frozenset(tuple(w[k : k + n]) for k in range(len(w) - n + 1))


def joined(rows, n, num, den):
    """(doc_id, set size, component) of each row, by comparing all sets that share an n-gram."""
    parent = {i: i for i, _ in rows if i is not None}

    def root(x):
        while parent[x] != x:
            x = parent[x]
        return x

    sets, holders = [shingles(t, n) for _, t in rows], defaultdict(list)
    for k, own in enumerate(sets):
        if rows[k][0] is None:
            continue
        common = defaultdict(int)
        for g in own:
            for j in holders[g]:
                common[j] += 1
            holders[g].append(k)
        for j, c in common.items():
            if den * c >= num * (len(own) + len(sets[j]) - c):
                a, b = sorted((root(rows[k][0]), root(rows[j][0])))
                parent[b] = a
    return sorted(((i, len(s), None if i is None else root(i)) for (i, _), s in zip(rows, sets)), key=str)
