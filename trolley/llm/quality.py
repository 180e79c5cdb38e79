"""Quality rules: fixed limits on document statistics, then gradient-boosted trees over them.

Statistics come from one pass over the bytes of whole texts.  The trees are grown in numpy on a bounded
sample of labelled documents, with monotonic constraints on chosen statistics, and are flattened into node
arrays so that a batch of documents is scored level by level.

Null texts count as empty: all statistics are 0, the rules fail them.  Without labels of both kinds the rules
alone decide.  Repeated rows get equal results, empty tables empty ones, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trolley.llm._words import IS_SPACE, Words, chunks, mix

MIN_WORDS = 10
REPEAT_PERCENT = 20
WINDOW = 5
SYMBOLS = b"#*$%&|<>"

#: Counts taken by the pass, each a long.
COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "n_lines", "n_distinct_words", "n_chars"]
#: Statistics that the trees see, in order, with the direction in which the verdict may move (0: free).
FEATURES = {
    "log_words": 0, "word_length": 0, "symbol_share": -1, "dup_line_share": -1, "repeat_share": -1,
    "words_per_line": 0, "distinct_share": 0, "digit_share": 0, "capital_share": 0, "mark_share": 0, "stop_share": 0,
}

_TABLE = np.arange(256)
_IS_SYMBOL = np.isin(_TABLE, list(SYMBOLS))
_IS_START = (_TABLE & 0xC0) != 0x80  # first byte of a character
_CLASS = {
    "n_digits": (_TABLE >= 48) & (_TABLE <= 57),
    "n_capitals": (_TABLE >= 65) & (_TABLE <= 90),
    "n_marks": (_TABLE > 32) & (_TABLE < 127) & ~np.isin(_TABLE, [ord(c) for c in map(chr, range(128)) if c.isalnum()]),
    "n_stops": np.isin(_TABLE, list(b".!?")),
}


def _per_text(flags: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    total = np.zeros(len(flags) + 1, np.int64)
    np.cumsum(flags, out=total[1:])
    return total[offsets[1:]] - total[offsets[:-1]]


def _repeats(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Marks keys that stand more than once in their text, and the second and later ones of each."""
    own = mix(keys + doc.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    order = np.argsort(own, kind="stable")
    ranked = own[order]
    same = ranked[1:] == ranked[:-1]
    later = np.zeros(len(own), bool)
    later[order[1:]] = same
    several = later.copy()
    several[order[:-1]] |= same
    return several, later


def statistics(texts: list[bytes]) -> dict[str, np.ndarray]:
    """The counts of each text."""
    words = Words.of(texts)
    buffer, offsets, n = words.buffer, words.offsets, len(texts)
    hashes = words.hashes(lower=False)
    out = {"n_words": words.counts()}
    filled = ~IS_SPACE[buffer]
    out["word_chars"] = _per_text(filled & _IS_START[buffer], offsets)
    out["n_symbols"] = _per_text(_IS_SYMBOL[buffer], offsets)
    # lines end at a line feed; one stands after each text, too
    ends = np.flatnonzero(buffer == 10)
    starts = np.concatenate(([0], ends[:-1] + 1)) if len(ends) else ends
    before = np.zeros(len(buffer) + 1, np.int64)
    np.cumsum(filled, out=before[1:])
    has_word = before[ends] > before[starts]
    lines = Words(buffer, offsets, starts[has_word], ends[has_word], words.doc, words.first)
    line_doc = np.searchsorted(offsets, lines.starts, "right") - 1
    _, later = _repeats(lines.hashes(lower=False), line_doc)
    out["n_dup_lines"] = np.bincount(line_doc[later], minlength=n)
    out["n_lines"] = np.bincount(line_doc, minlength=n)
    windows, window_doc = words.ngrams(hashes, WINDOW)
    several, _ = _repeats(windows, window_doc)
    at = np.flatnonzero(words.doc[: len(hashes) - WINDOW + 1] == words.doc[WINDOW - 1 :]) if len(windows) else np.zeros(0, int)
    cover = np.zeros(len(hashes) + 1, np.int64)
    np.add.at(cover, at[several], 1)
    np.add.at(cover, at[several] + WINDOW, -1)
    repeated = np.cumsum(cover[:-1]) > 0
    out["n_repeat_words"] = np.bincount(words.doc[repeated], minlength=n)
    _, again = _repeats(hashes, words.doc)
    out["n_distinct_words"] = out["n_words"] - np.bincount(words.doc[again], minlength=n)
    out["n_chars"] = _per_text(_IS_START[buffer], offsets) - 1
    for name, table in _CLASS.items():
        out[name] = _per_text(table[buffer], offsets)
    return out


def rule_failed(s: dict[str, np.ndarray]) -> np.ndarray:
    return (s["n_words"] < MIN_WORDS) | (100 * s["n_repeat_words"] > REPEAT_PERCENT * s["n_words"])


def features(s: dict[str, np.ndarray]) -> np.ndarray:
    words, chars = np.maximum(s["n_words"], 1), np.maximum(s["n_chars"], 1)
    lines = np.maximum(s["n_lines"], 1)
    columns = [
        np.log1p(s["n_words"]), s["word_chars"] / words, s["n_symbols"] / chars, s["n_dup_lines"] / lines,
        s["n_repeat_words"] / words, s["n_words"] / lines, s["n_distinct_words"] / words,
        s["n_digits"] / chars, s["n_capitals"] / chars, s["n_marks"] / chars, s["n_stops"] / words,
    ]
    return np.stack(columns, 1)


@dataclass
class TreeModel:
    """Trees of one depth as arrays [tree, node]; the children of node i are 2 i + 1 and 2 i + 2."""

    start: float
    feature: np.ndarray
    limit: np.ndarray
    value: np.ndarray  # [tree, leaf]
    threshold: float = 0.5

    def chance(self, x: np.ndarray) -> np.ndarray:
        """Probability of the good label for each row."""
        rows = np.arange(len(x))
        total = np.full(len(x), self.start)
        inner = self.feature.shape[1]
        for feature, limit, value in zip(self.feature, self.limit, self.value):
            node = np.zeros(len(x), np.int64)
            while len(node) and node[0] < inner:  # all rows stand on one level
                node = 2 * node + 1 + (x[rows, feature[node]] > limit[node])
            total += value[node - inner]
        return 1 / (1 + np.exp(-total))


def boost(
    x: np.ndarray, y: np.ndarray, directions: list[int], trees: int = 60, depth: int = 3, rate: float = 0.15,
    bins: int = 48, smooth: float = 5.0, least: int = 20,
) -> TreeModel:
    """Grow trees on logistic loss over binned features.

    A split on a constrained feature is taken only if its sides stand in the right order, and the midpoint of
    the two bounds what either side's descendants may say, so the whole model is monotonic in that feature.
    """
    start = float(np.log(max(y.mean(), 1e-6) / max(1 - y.mean(), 1e-6)))
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column, "left") for c, column in zip(cuts, x.T)], 1)
    inner, leaves = 2**depth - 1, 2**depth
    feature = np.zeros((trees, inner), np.int64)
    limit = np.full((trees, inner), np.inf)
    value = np.zeros((trees, leaves))
    score = np.full(len(y), start)
    for t in range(trees):
        chance = 1 / (1 + np.exp(-score))
        slope, bend = y - chance, chance * (1 - chance)
        node = np.zeros(len(y), np.int64)
        low, high = {0: -np.inf}, {0: np.inf}
        for i in range(inner):
            rows = np.flatnonzero(node == i)
            best = (1e-6, -1, 0, 0.0)
            g, h = slope[rows].sum(), bend[rows].sum()
            for f, direction in enumerate(directions):
                if len(rows) < 2 * least or not len(cuts[f]):
                    continue
                size = len(cuts[f]) + 1
                left_g = np.bincount(binned[rows, f], slope[rows], size).cumsum()[:-1]
                left_h = np.bincount(binned[rows, f], bend[rows], size).cumsum()[:-1]
                left_n = np.bincount(binned[rows, f], minlength=size).cumsum()[:-1]
                left, right = left_g / (left_h + smooth), (g - left_g) / (h - left_h + smooth)
                gain = left_g**2 / (left_h + smooth) + (g - left_g) ** 2 / (h - left_h + smooth) - g**2 / (h + smooth)
                allowed = (left_n >= least) & (len(rows) - left_n >= least)
                if direction:
                    allowed &= direction * (right - left) >= 0
                gain = np.where(allowed, gain, -np.inf)
                k = int(gain.argmax())
                if gain[k] > best[0]:
                    middle = float(np.clip((left[k] + right[k]) / 2, low[i], high[i]))
                    best = (float(gain[k]), f, k, middle)
            _, f, k, middle = best
            a, b = 2 * i + 1, 2 * i + 2
            low[a], low[b], high[a], high[b] = low[i], low[i], high[i], high[i]
            if f < 0:
                node[rows] = a
                continue
            feature[t, i], limit[t, i] = f, cuts[f][k]
            if directions[f]:
                upper, lower = (b, a) if directions[f] > 0 else (a, b)
                low[upper], high[lower] = middle, middle
            node[rows] = np.where(binned[rows, f] > k, b, a)
        for leaf in range(leaves):
            rows = node == inner + leaf
            step = slope[rows].sum() / (bend[rows].sum() + smooth)
            value[t, leaf] = rate * np.clip(step, low[inner + leaf], high[inner + leaf])
        score += value[t, node - inner]
    return TreeModel(start, feature, limit, value)


def _measured(batches: Iterator[pa.RecordBatch], text: int):
    for rows, texts in chunks(batches, text):
        yield rows, statistics(texts)


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = "quality", sample: int = 20_000, lost: float = 0.002,
) -> TreeModel | None:
    """Trees fitted on at most ``sample`` labelled documents, chosen by a hash of the id.

    The limit of the verdict is set so that at most the share ``lost`` of the documents labelled good that
    pass the rules fall below it, and never above one half.  None without labels of both kinds.
    """
    labelled = labels.select(labels[id_column].alias("key"), labels[label_column].cast("double").alias("label"))
    labelled = labelled.filter(F.col("key").isNotNull() & F.col("label").isin(0.0, 1.0))
    count = labelled.count()
    draw = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(5)), F.lit(1 << 30))
    chosen = labelled.filter(draw < int((1 << 30) * min(1.0, 1.2 * sample / max(count, 1))))
    chosen = chosen.orderBy(draw, "key", "label").limit(sample)
    wide = [f"f{k}" for k in range(len(FEATURES))]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, s in _measured(batches, 1):
            x = features(s)[~rule_failed(s)]
            label = rows.column(0).filter(pa.array(~rule_failed(s)))
            yield pa.RecordBatch.from_arrays([label, *map(pa.array, x.T)], names=["label", *wide])

    texts = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    joined = texts.join(F.broadcast(chosen), F.col("id") == F.col("key")).select("label", "text")
    table = joined.mapInArrow(run, "label double, " + ", ".join(f"{w} double" for w in wide)).toPandas()
    table = table.sort_values(["label", *wide]).to_numpy()
    if not len(table) or len(set(table[:, 0])) < 2:
        return None
    x, y = table[:, 1:], table[:, 0]
    model = boost(x, y, list(FEATURES.values()))
    model.threshold = float(min(0.5, np.quantile(model.chance(x[y == 1]), lost)))
    return model


def judge(docs: DataFrame, model: TreeModel | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row the counts, base_failed, chance (of good quality; null without a model) and kept."""
    names = ["id", *COUNTS, "base_failed", "chance", "kept"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, s in _measured(batches, 1):
            failed = rule_failed(s)
            chance = model.chance(features(s)) if model else np.full(len(failed), np.nan)
            kept = ~failed & (np.isnan(chance) | (chance >= (model.threshold if model else 0)))
            columns = [pa.array(s[c].astype(np.int64)) for c in COUNTS]
            columns += [pa.array(failed), pa.array(chance, from_pandas=True), pa.array(kept)]
            yield pa.RecordBatch.from_arrays([rows.column(0), *columns], names=names)

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    longs = ", ".join(f"{c} long" for c in COUNTS)
    shape = f"id {kind}, {longs}, base_failed boolean, chance double, kept boolean"
    return rows.mapInArrow(run, shape).withColumnRenamed("id", id_column)
