"""Toxicity by a classifier chain.

The categories are predicted one after the other.  Each has a linear model over the counts of selected words and
word beginnings (so that inflected and derived forms count together) and the probabilities of all earlier categories; in training those are out-of-fold predictions, so a later
model sees earlier ones as unsure as they will be.  The last category is the label of the table; the earlier ones
are kinds of it, taken for present in documents that are labelled toxic and hold a word of the kind.

Words are runs of letters, digits and non-ASCII bytes, A-Z read as a-z.  Null and empty texts hold none and get the
probabilities of a text without words.  Without labels of both kinds every probability is 0 and nothing is toxic.
Repeated rows get equal results, empty tables empty ones, other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from trolley.llm._words import Words, chunks, look_up, mix, plain_words

# Words that tell the kinds of toxic documents apart; the models learn further words themselves.
KINDS = {
    "insult": "bitch clown dumb dumbass fool freak idiot imbecile loser moron pig scum stupid".split(),
    "contempt": "disgusting filth garbage gross pathetic shame trash useless vile vermin worthless".split(),
    "threat": "beat burn destroy die hang hate hurt kill murder punch rape shoot stab".split(),
}
LABEL = "toxic"

#: Words and beginnings selected for the models, by the strength of their association with the label.
SELECTED = 256
#: Bytes of the word beginnings that count besides whole words.
BEGINNINGS = (4, 5, 6, 7, 8, 9)
FOLDS = 3
#: Least number of documents a category needs among those fitted; with fewer it is taken for absent.
LEAST_CASES = 20


@dataclass
class Chain:
    """Selected word hashes (sorted) and, for each category, weights over words and earlier categories, and a bias."""

    categories: list[str]
    words: np.ndarray
    weights: list[np.ndarray]
    biases: list[float]
    threshold: float = 0.5

    def chances(self, x: np.ndarray) -> np.ndarray:
        """Probability of each category for rows of features."""
        out = np.zeros((len(x), 0))
        for weight, bias in zip(self.weights, self.biases):
            p = _sigmoid(np.concatenate([x, out], axis=1) @ weight + bias)
            out = np.concatenate([out, p[:, None]], axis=1)
        return out


def _sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def _parts(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of all words and word beginnings, and the text of each."""
    words, hashes = plain_words(texts)
    keys, docs = [hashes], [words.doc]
    for k in BEGINNINGS:
        long = np.flatnonzero(words.ends - words.starts > k)
        start = words.starts[long]
        begun = Words(words.buffer, words.offsets, start, start + k, words.doc[long], words.first)
        keys.append(mix(begun.hashes(lower=False) + np.uint64(k)))
        docs.append(words.doc[long])
    return np.concatenate(keys), np.concatenate(docs)


def features(texts: list[bytes], selected: np.ndarray) -> np.ndarray:
    """log(1 + count) of the selected words and beginnings in each text."""
    keys, doc = _parts(texts)
    hit, which = look_up(selected, keys)
    counts = np.bincount(doc[hit] * len(selected) + which, minlength=len(texts) * len(selected))
    return np.log1p(counts.reshape(len(texts), len(selected))).astype(np.float32)


def _holds(texts: list[bytes], words: np.ndarray) -> np.ndarray:
    """Whether a text holds one of the words."""
    found, hashes = plain_words(texts)
    hit, _ = look_up(np.sort(words), hashes)
    return np.bincount(found.doc[hit], minlength=len(texts)) > 0


def _linear(x: np.ndarray, y: np.ndarray, penalty: float = 3e-4, rounds: int = 250) -> tuple[np.ndarray, float]:
    """Logistic regression with both labels of equal weight, by accelerated gradient steps."""
    weight = np.zeros(x.shape[1], np.float32)
    if not 0 < y.sum() < len(y):
        return weight, 30.0 if y.all() else -30.0
    balance = (np.where(y > 0, 0.5 / y.mean(), 0.5 / (1 - y.mean())) / len(y)).astype(np.float32)
    rate = np.float32(4 / (1 + float((balance * (x * x).sum(axis=1)).sum())))
    ahead, bias, ahead_bias = weight, 0.0, 0.0
    for k in range(rounds):
        error = balance * (_sigmoid(x @ ahead + np.float32(ahead_bias)) - y)
        new = ahead - rate * (error @ x + np.float32(penalty) * ahead)
        new_bias = ahead_bias - float(rate * error.sum())
        pull = k / (k + 3)
        ahead, ahead_bias = new + np.float32(pull) * (new - weight), new_bias + pull * (new_bias - bias)
        weight, bias = new, new_bias
    return weight, bias


def train(x: np.ndarray, targets: dict[str, np.ndarray], words: np.ndarray, seed: int = 3) -> Chain:
    """Train the chain; the threshold is the best F1 on the out-of-fold predictions of the last category."""
    fold = np.random.default_rng(seed).permutation(len(x)) % FOLDS
    earlier = np.zeros((len(x), 0), np.float32)
    chain = Chain(list(targets), words, [], [])
    for name, y in targets.items():
        y = (y if y.sum() >= LEAST_CASES or name == LABEL else 0 * y).astype(np.float32)
        full = np.concatenate([x, earlier], axis=1)
        apart = np.zeros(len(x), np.float32)
        for k in range(FOLDS):
            weight, bias = _linear(full[fold != k], y[fold != k])
            apart[fold == k] = _sigmoid(full[fold == k] @ weight + bias)
        weight, bias = _linear(full, y)
        chain.weights.append(weight)
        chain.biases.append(bias)
        earlier = np.concatenate([earlier, apart[:, None]], axis=1)
    y, apart = targets[LABEL], earlier[:, -1]
    cuts = np.linspace(0.3, 0.9, 25)
    scores = [2 * (y[apart >= c]).sum() / max(1, (apart >= c).sum() + y.sum()) for c in cuts]
    chain.threshold = float(np.mean(cuts[np.array(scores) >= max(scores) - 1e-9]))
    return chain


def fit(
    docs: DataFrame, labels: DataFrame, id_column: str = "doc_id", text_column: str = "text",
    label_column: str = LABEL, sample: int = 8_000,
) -> Chain | None:
    """Fit on at most ``sample`` labelled documents, chosen by a hash of the id; None without both labels.

    The documents' words are counted by label in their tasks and summed by Spark; the driver gets the selected
    ones, and then their counts in the sampled documents.
    """
    known = labels.select(labels[id_column].alias("key"), labels[label_column].cast("int").alias("label"))
    known = known.filter(F.col("key").isNotNull() & F.col("label").isin(0, 1))
    size = known.count()
    draw = F.pmod(F.xxhash64(F.col("key").cast("string"), F.lit(9)), F.lit(1 << 30))
    chosen = known.filter(draw < int((1 << 30) * min(1.0, 1.2 * sample / max(size, 1))))
    chosen = chosen.orderBy(draw, "key", "label").limit(sample)
    texts = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    rows = texts.join(F.broadcast(chosen), F.col("id") == F.col("key")).select("label", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in chunks(batches, 1):
            keys, doc = _parts(some)
            order = np.lexsort((doc, keys))
            keys, doc = keys[order], doc[order]
            once = np.ones(len(keys), bool)
            once[1:] = (keys[1:] != keys[:-1]) | (doc[1:] != doc[:-1])
            word, at = np.unique(keys[once], return_inverse=True)
            label = part.column(0).to_numpy(zero_copy_only=False)[doc[once]]
            toxic = np.bincount(at, label.astype(float), len(word)).astype(np.int64)
            columns = [word.view(np.int64), toxic, np.bincount(at, minlength=len(word))]
            yield pa.RecordBatch.from_arrays(list(map(pa.array, columns)), names=["word", "toxic", "n"])

    total = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum("label"), F.lit(0)).alias("toxic")).first()
    if not 0 < total["toxic"] < total["n"]:
        return None
    words = rows.mapInArrow(count, "word long, toxic long, n long").groupBy("word").agg(
        F.sum("toxic").alias("toxic"), F.sum("n").alias("n"))
    expected = F.col("n") * total["toxic"] / total["n"]
    spread = expected * (1 - F.col("n") / (total["n"] + 1)) + 1
    strength = (F.col("toxic") - expected) / F.sqrt(spread)  # only words that speak for the label
    picked = words.filter(F.col("n") >= 5).orderBy(F.desc(strength), "word").limit(SELECTED).collect()
    selected = np.sort(np.array([r["word"] for r in picked], np.int64).view(np.uint64))
    kinds = {k: plain_words([" ".join(w).encode()])[1] for k, w in KINDS.items()}

    def show(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, some in chunks(batches, 1):
            x = features(some, selected)
            held = [_holds(some, h) for h in kinds.values()]
            at = [np.flatnonzero(r).tolist() for r in x]
            columns = [part.column(0), pa.array(at, pa.list_(pa.int32()))]
            columns.append(pa.array([r[i].tolist() for r, i in zip(x, at)], pa.list_(pa.float32())))
            yield pa.RecordBatch.from_arrays([*columns, *map(pa.array, held)], names=["label", "at", "value", *kinds])

    shape = "label int, at array<int>, value array<float>, " + ", ".join(f"{k} boolean" for k in kinds)
    table = sorted(map(tuple, rows.mapInArrow(show, shape).collect()))
    x = np.zeros((len(table), len(selected)), np.float32)
    for k, row in enumerate(table):
        x[k, row[1]] = row[2]
    y = np.array([row[0] for row in table])
    targets = {k: y * np.array([row[3 + i] for row in table]) for i, k in enumerate(kinds)} | {LABEL: y}
    return train(x, targets, selected)


def predict(docs: DataFrame, chain: Chain | None, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Per row p_insult, p_contempt, p_threat, p_toxic and the verdict toxic; one pass, no shuffle."""
    names = [*KINDS, LABEL]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, 1):
            p = chain.chances(features(texts, chain.words)) if chain else np.zeros((len(texts), len(names)))
            verdict = p[:, -1] >= (chain.threshold if chain else 1.0)
            columns = [part.column(0), *map(pa.array, np.ascontiguousarray(p.T)), pa.array(verdict)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", *[f"p_{n}" for n in names], "toxic"])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, " + ", ".join(f"p_{n} double" for n in names) + ", toxic boolean"
    return rows.mapInArrow(run, shape).withColumnRenamed("id", id_column)
