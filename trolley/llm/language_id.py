"""Language identification: averaged hashed subword embeddings under a linear softmax.

A text is the average of the embeddings of its hashed 2- to 4-byte windows (ASCII case folded, everything in
ASCII that is no letter read as a space, one space around the text).  Embeddings and softmax are trained
together by stochastic gradient descent in numpy; for scoring both are multiplied out into one row of
language weights per bucket.  A temperature fitted on set-aside examples calibrates the probabilities, and a
threshold on the calibrated probability says which texts are rejected.

Null texts and texts without a letter are ``und`` with score 0 and rejected.  Without any labelled text
every text is ``und``.  Repeated rows count as often as they stand in the table and get equal results; empty
tables give empty results; other columns are passed on or not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window, functions as F

from trolley.llm._store import small_batches
from trolley.llm._words import CHUNK_BYTES, LOWER, chunks

UNKNOWN = "und"
BUCKET_BITS = 16
SIZES = (2, 3, 4)
#: A longer text is summed by bucket counts instead of window by window.
LONG_TEXT = 1 << 18

_LETTER = np.where((LOWER >= 97) & (LOWER <= 122) | (np.arange(256) >= 128), LOWER, 32).astype(np.uint32)
_ODD = np.array([0x9E3779B1, 0x85EBCA77, 0xC2B2AE3D, 0x27D4EB2F], np.uint32)


def _buckets(data: bytes, n: int) -> np.ndarray:
    """Bucket of the n-byte window that starts at each byte."""
    code = _LETTER[np.frombuffer(data, np.uint8)]
    size = len(code) - n + 1
    total = np.full(max(size, 0), n * 0x165667B1 & 0xFFFFFFFF, np.uint32)
    for k in range(n):
        total += code[k : k + size] * _ODD[k]
        total ^= total >> np.uint32(15)
        total *= np.uint32(0x2C1B3C6D)
    return total >> np.uint32(32 - BUCKET_BITS)


@dataclass
class LanguageModel:
    """Language weights per bucket, and the calibration.  Its size depends on the parameters alone."""

    languages: list[str]
    weights: np.ndarray  # buckets x languages, float32
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0

    def logits(self, texts: list[bytes]) -> np.ndarray:
        out = np.zeros((len(texts), len(self.languages)))
        short = [i for i, t in enumerate(texts) if len(t) <= LONG_TEXT]
        if short:
            out[short] = self._sums([texts[i] for i in short])
        for i, t in enumerate(texts):
            if len(t) > LONG_TEXT:
                data = b" " + t + b" "
                counts = sum(np.bincount(_buckets(data, n), minlength=1 << BUCKET_BITS) for n in SIZES)
                out[i] = counts @ self.weights / counts.sum()
        return out + self.bias

    def _sums(self, texts: list[bytes]) -> np.ndarray:
        data = b" " + b" ".join(texts) + b" "
        lengths = np.fromiter(map(len, texts), np.int64, len(texts))
        start = np.concatenate(([0], np.cumsum(lengths + 1)[:-1]))
        total = np.zeros((len(texts), len(self.languages)))
        count = np.zeros(len(texts))
        for n in SIZES:
            buckets = _buckets(data, n)
            if not len(buckets):
                continue
            windows = np.maximum(lengths + 3 - n, 0)
            edges = np.minimum(np.stack([start, start + windows], 1).ravel(), len(buckets) - 1)
            own = windows > 0
            # a last sum may end one window early where the edge was clipped
            sums = np.add.reduceat(self.weights[buckets], edges, axis=0, dtype=np.float64)[::2]
            clipped = own & (start + windows == len(buckets))
            if clipped.any():
                i = int(np.flatnonzero(clipped)[-1])
                sums[i] = self.weights[buckets[start[i] :]].sum(axis=0, dtype=np.float64)
            total += np.where(own[:, None], sums, 0)
            count += windows
        return total / np.maximum(count, 1)[:, None]

    def predict(self, texts: list[bytes], lettered: np.ndarray) -> tuple[list[str], np.ndarray, np.ndarray]:
        """Language, calibrated probability and rejection of each text."""
        if not self.languages or not texts:
            return [UNKNOWN] * len(texts), np.zeros(len(texts)), np.ones(len(texts), bool)
        chance = _softmax(self.logits(texts) / self.temperature)
        best = chance.argmax(axis=1)
        score = np.where(lettered, np.clip(chance.max(axis=1), 0, 1), 0.0)
        names = [self.languages[b] if ok else UNKNOWN for b, ok in zip(best, lettered)]
        return names, score, ~lettered | (score < self.threshold)


def _softmax(logits: np.ndarray) -> np.ndarray:
    e = np.exp(logits - logits.max(axis=-1, keepdims=True))
    return e / e.sum(axis=-1, keepdims=True)


def train(
    texts: list[bytes], labels: list[str], dimensions: int = 16, epochs: int = 3, rate: float = 40.0, seed: int = 7
) -> LanguageModel:
    """Train on labelled texts.

    Each text is seen whole and as one short piece of itself, so that short texts are known too.  A fifth of
    the texts is set aside to fit the temperature and the threshold: at most 0.1 % of the right answers on
    it, short pieces included, and none that scores 0.4 or more, are rejected.
    """
    languages = sorted(set(labels))
    rng = np.random.default_rng(seed)
    emb = rng.normal(0, 0.1, (1 << BUCKET_BITS, dimensions)).astype(np.float32)
    out = np.zeros((dimensions, len(languages)), np.float32)
    bias = np.zeros(len(languages), np.float32)
    if len(languages) < 2:
        return LanguageModel(languages, np.zeros((1 << BUCKET_BITS, len(languages)), np.float32), bias)

    def bag(text: bytes) -> tuple[np.ndarray, np.ndarray]:
        data = b" " + text + b" "
        ids, counts = np.unique(np.concatenate([_buckets(data, n) for n in SIZES]), return_counts=True)
        return ids, (counts / counts.sum()).astype(np.float32)

    def piece(text: bytes) -> bytes:
        if len(text) <= 60:
            return text
        at = int(rng.integers(0, len(text) - 40))
        return text[at : at + int(rng.integers(20, 60))]

    order = rng.permutation(len(texts))
    aside = order[: len(texts) // 5]
    learn = order[len(aside) :]
    target = {name: k for k, name in enumerate(languages)}
    examples = [(bag(t), target[labels[i]]) for i in learn for t in (texts[i], piece(texts[i]))]
    steps, done = epochs * len(examples), 0
    for _ in range(epochs):
        for k in rng.permutation(len(examples)):
            (ids, share), label = examples[k]
            step = rate * (1 - done / steps)
            done += 1
            rows = emb[ids]
            mean = share @ rows
            error = _softmax(mean @ out + bias)
            error[label] -= 1
            back = out @ error
            back /= max(1.0, float(np.abs(back).max()))  # bounds a step whatever the weights have become
            out -= np.float32(step * 0.02) * np.outer(mean, error)
            bias -= np.float32(step * 0.001) * error
            emb[ids] = rows - np.float32(step) * np.outer(share, back)
    model = LanguageModel(languages, (emb @ out).astype(np.float32), bias)
    held = [(t, labels[i]) for i in aside for t in (texts[i], piece(texts[i]))]
    if held:
        logits = model.logits([t for t, _ in held])
        truth = np.array([target[name] for _, name in held])
        rows = np.arange(len(held))
        grid = np.geomspace(0.1, 10, 60)
        loss = [-np.log(np.maximum(_softmax(logits / g)[rows, truth], 1e-12)).mean() for g in grid]
        model.temperature = float(grid[int(np.argmin(loss))])
        chance = _softmax(logits / model.temperature)
        right = chance.max(axis=1)[chance.argmax(axis=1) == truth]
        if len(right):
            model.threshold = float(min(0.4, np.quantile(right, 0.001)))
    return model


def fit(
    docs: DataFrame,
    learn_from: Column,
    text_column: str = "text",
    label_column: str = "lang",
    key_column: str = "doc_id",
    per_language: int = 600,
    max_bytes: int = 24_000_000,
) -> LanguageModel:
    """Fit on a bounded sample of the labelled rows that satisfy ``learn_from``.

    Of every language texts are taken by a hash of the key, at most ``per_language`` and at most its equal share of
    ``max_bytes`` in all, and brought to the driver whole.  A text longer than the share is passed over, unless its language
    has no shorter one; then the shortest is taken.  So no language is left out for another one's long texts.
    """
    rows = docs.filter(learn_from).select(
        docs[text_column].alias("text"), docs[label_column].alias("label"),
        F.pmod(F.xxhash64(docs[key_column].cast("string"), F.lit(11)), F.lit(1 << 30)).alias("draw"),
    ).filter(F.col("label").isNotNull() & F.col("text").isNotNull() & F.col("text").rlike("\\p{L}"))
    rows = rows.withColumn("digest", F.xxhash64("text")).withColumn("bytes", F.octet_length("text").cast("long"))
    key = ["label", "draw", "digest"]
    found = rows.groupBy("label", F.floor(F.log2("bytes")).alias("band")).agg(
        F.count("*").alias("n"), F.min(F.struct("bytes", "draw", "digest")).alias("least")).collect()  # some of each language
    if not found:
        return train([], [])
    least = {label: min(r["least"] for r in found if r["label"] == label) for label in {r["label"] for r in found}}
    share = max_bytes // len(least)
    room = {label: max(share, r["bytes"]) for label, r in least.items()}
    fitting = {label: sum(r["n"] for r in found if r["label"] == label and r["least"]["bytes"] <= room[label]) for label in least}
    sizes = F.broadcast(docs.sparkSession.createDataFrame(  # one row of each language, all of them here already
        [(label, room[label], 2.0 * per_language / fitting[label] * (1 << 30)) for label in least],
        "label string, room long, below double"))
    drawn = rows.drop("text").join(sizes, "label").filter("bytes <= room and draw < below")  # numbers, of about 2 per_language rows
    order = Window.partitionBy("label").orderBy("draw", "digest")
    drawn = drawn.withColumn("nth", F.row_number().over(order)).withColumn(
        "total", F.sum("bytes").over(order.rowsBetween(Window.unboundedPreceding, 0)))
    chosen = [tuple(r) for r in drawn.filter((F.col("nth") <= per_language) & (F.col("total") <= F.col("room"))).select(*key).collect()]
    chosen += [(label, r["draw"], r["digest"]) for label, r in least.items() if label not in {c[0] for c in chosen}]
    chosen = F.broadcast(docs.sparkSession.createDataFrame(chosen, "label string, draw long, digest long"))  # per_language each
    sample = rows.join(chosen, key, "left_semi").dropDuplicates(key).select("text", "label").collect()
    sample.sort(key=lambda r: (r["label"], r["text"]))
    return train([r["text"].encode() for r in sample], [r["label"] for r in sample])


def _scored(model: LanguageModel, text: int):
    """Chunks of rows with their texts' predictions."""
    limit = max(1 << 16, CHUNK_BYTES * 4 // max(4, len(model.languages)))

    def run(batches: Iterator[pa.RecordBatch]):
        for rows, texts in chunks(batches, text, limit):
            lettered = pc.match_substring_regex(rows.column(text), "\\p{L}").fill_null(False)
            yield rows, *model.predict(texts, lettered.to_numpy(zero_copy_only=False))

    return run


def predict(docs: DataFrame, model: LanguageModel, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column``, lang_pred, score and rejected for every row; one pass, no shuffle."""
    small_batches(docs.sparkSession)
    scored = _scored(model, 1)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, names, score, rejected in scored(batches):
            columns = [rows.column(0), pa.array(names, pa.string()), pa.array(score), pa.array(rejected)]
            yield pa.RecordBatch.from_arrays(columns, names=["id", "lang_pred", "score", "rejected"])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    shape = f"id {kind}, lang_pred string, score double, rejected boolean"
    return rows.mapInArrow(run, shape).withColumnRenamed("id", id_column)


def accepted(docs: DataFrame, model: LanguageModel, text_column: str = "text") -> DataFrame:
    """The rows that are not rejected, with all their columns."""
    small_batches(docs.sparkSession)
    scored = _scored(model, docs.columns.index(text_column))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, _, _, rejected in scored(batches):
            yield rows.filter(pa.array(~rejected))

    return docs.mapInArrow(run, docs.schema)
