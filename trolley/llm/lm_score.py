"""Language-model scores: a hashed maximum-entropy model with a class-factored softmax, beside a unigram model.

Tokens are words (A-Z read as a-z) and one end for each text.  Words are known by 64-bit hashes.  Their counts
cover all training texts.  The most frequent ones (at most HEAD) go to every task, whose size is so bounded;
the others are looked up by a join, over the few tokens that they make up.

The maximum-entropy model predicts a token from hashed features of the words before it: the last word, and, skipping
that, the second last.  All words of the head are modelled; all others together, and unknown ones, are one more
outcome, within which they have their smoothed unigram probabilities.  The softmax is factored by classes within classes:
the outcomes are the leaves of a tree (Huffman's, with WIDTH children, so that frequent words take few steps), and a token's
probability is the product of those of the children on its path, each a softmax of WIDTH.  Such a softmax starts at the
unigram shares of the children and adds one row of weights for each feature, found in a table by the hash of context and
class.  So the probabilities of all words and one unknown sum up to one, as in the unigram model.

Training is distributed: in each round every task makes gradient updates on its own texts.  The next round's model takes
each row's average over the tasks, by the squared gradients that the row met in each, so a context that one task alone has
seen keeps what was learnt.  Each round takes its own share of the training texts.  The table grows with the number of
words, up to 2 ** MOST_BITS rows, the bound of what goes to every task.

Null and empty texts are a lone end.  Without training texts all probabilities are those of one unknown word.
Repeated rows count each time; empty tables give empty results; other columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trolley.llm._store import stored
from trolley.llm._words import Words, chunks, look_up, mix

SMOOTH = 0.1
#: Words that every task holds with their counts.
HEAD = 1 << 19
#: Children of a class.
WIDTH_BITS = 3
WIDTH = 1 << WIDTH_BITS
#: The table of weights has 2 ** bits rows, one or two for each modelled word within these bounds.
LEAST_BITS, MOST_BITS = 12, 19
ROUNDS = 2
#: Tokens of one gradient update, and of one batch of scores.
BATCH = 1024
RATE = 0.4
#: Squared gradients that a row starts with.
SEEN = 2.0
#: An update is dealt in PARTS, each added up in PARTIAL_SUMS tasks if there are more than so many, then in one.
PARTIAL_SUMS = 8
PARTS = 16
#: Tokens that a task learns from at least, if there are more tasks than cores: its update is as large whatever it learns.
TASK_TOKENS = 4_000_000

_U = np.uint64
END = _U(0x5D5E0F4B3C2A1907)
_CHILDREN = np.arange(WIDTH)
_ONES = np.ones(WIDTH, np.float32)
_START = _U(0x1B56C4E9A7D3F281)
_FEATURES = 2
_NODE = _U(0x9E3779B97F4A7C15)
_SLOT = _U(0xD6E8FEB86659FD93)


@dataclass
class Vocabulary:
    """Counts of the most frequent words, sorted by hash, and the sums over all words."""

    words: np.ndarray
    counts: np.ndarray
    place: np.ndarray  # rank by count of the modelled ones, else -1
    tokens: int
    types: int
    rest: float  # smoothed mass of all words that are not modelled, and of one unknown word

    @property
    def mass(self) -> float:
        return self.tokens + SMOOTH * (self.types + 1)


def _depths(mass: np.ndarray) -> np.ndarray:
    """Depths of the leaves of Huffman's tree of WIDTH children over ``mass``, which falls and fills up the last class."""
    n, inner_nodes = len(mass), (len(mass) - 1) // (WIDTH - 1)
    weight = np.concatenate((mass[::-1], np.full(inner_nodes, np.inf))).tolist()  # leaves from the lightest on, then classes
    parent = [0] * len(weight)
    leaf, inner = 0, n
    for new in range(n, len(weight)):
        total = 0.0
        for _ in range(WIDTH):
            if leaf < n and (inner >= new or weight[leaf] <= weight[inner]):
                at, leaf = leaf, leaf + 1
            else:
                at, inner = inner, inner + 1
            parent[at] = new
            total += weight[at]
        weight[new] = total
    depth = [0] * len(weight)
    for at in range(len(weight) - 2, -1, -1):
        depth[at] = depth[parent[at]] + 1
    return np.array(depth[:n][::-1], np.int64)


@dataclass
class Tree:
    """Classes within classes.  A leaf's code names the children that lead to it, from the root on.

    At every depth the leaves have the lowest codes, so a class is numbered by its depth and the code that leads to it.
    """

    depth: np.ndarray
    code: np.ndarray
    shift: np.ndarray  # what a class's code at each depth lacks to its number
    bias: np.ndarray  # [class, child]: log share of each child

    @classmethod
    def of(cls, mass: np.ndarray) -> Tree:
        """The tree over leaves of falling ``mass``."""
        mass = np.append(mass, np.zeros(-(len(mass) - 1) % (WIDTH - 1)))
        depth = _depths(mass)
        order = np.argsort(depth, kind="stable")
        deepest = int(depth.max())
        leaves = np.bincount(depth, minlength=deepest + 1)
        code, shift = np.zeros(len(mass), np.int64), np.zeros(deepest + 1, np.int64)
        classes, low, at, number = [], 0, 0, 0
        for d in range(deepest + 1):
            own = order[at : at + leaves[d]]
            code[own] = low + np.arange(len(own))
            at, low = at + len(own), low + len(own)
            classes.append((1 << d * WIDTH_BITS) - low)
            shift[d] = number - low
            number, low = number + classes[-1], low << WIDTH_BITS
        bias, inner = np.zeros((number, WIDTH)), np.zeros(0)
        for d in range(deepest, 0, -1):
            at -= leaves[d]
            children = np.concatenate((mass[order[at : at + leaves[d]]], inner)).reshape(-1, WIDTH)
            inner = children.sum(axis=1)
            number -= classes[d]
            bias[number - classes[d - 1] : number] = np.log(np.maximum(children / inner[:, None], 1e-300))
        return cls(depth, code, shift, bias.astype(np.float32))

    def path(self, leaf: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Depth of each leaf; then, for all steps to all leaves, the class and which child it goes on in."""
        depth = self.depth[leaf]
        rest = np.repeat(np.cumsum(depth), depth) - np.arange(int(depth.sum()))
        code = np.repeat(self.code[leaf], depth) >> (rest - 1) * WIDTH_BITS
        step = np.repeat(depth, depth) - rest
        return depth, (code >> WIDTH_BITS) + self.shift[step], code & (WIDTH - 1)


@dataclass
class Model:
    tree: Tree  # its leaves: the modelled words by falling count, and all others where they fall among them
    leaf: np.ndarray  # leaf of each place; the last one is that of all other words
    weights: np.ndarray  # [row, child]
    seen: np.ndarray  # squared gradients that each row has met

    @classmethod
    def of(cls, v: Vocabulary) -> Model:
        """The model without context: unigram probabilities."""
        known = v.place >= 0
        mass = np.zeros(int(known.sum()) + 1)
        mass[v.place[known]] = v.counts[known] + SMOOTH
        mass[-1] = v.rest
        order = np.argsort(-mass, kind="stable")
        leaf = np.empty(len(mass), np.int64)
        leaf[order] = np.arange(len(mass))
        rows = 1 << min(max(len(mass).bit_length(), LEAST_BITS), MOST_BITS)
        return cls(Tree.of(mass[order]), leaf, np.zeros((rows, WIDTH), np.float32), np.full(rows, SEEN, np.float32))

    def rows(self, contexts: np.ndarray, depth: np.ndarray, node: np.ndarray) -> np.ndarray:
        """Rows of the table of weights, [feature, step]."""
        shift = _U(65 - len(self.weights).bit_length())
        key = node.astype(np.uint64) * _NODE
        out = np.empty((_FEATURES, len(node)), np.int64)
        for k in range(_FEATURES):
            mixed = np.repeat(contexts[k], depth)
            mixed ^= key
            mixed *= _SLOT
            mixed >>= shift
            out[k] = mixed
        return out

    def odds(self, node: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Logits of the children, [step, child], their exponentials and the sums of these.

        Logits stay small, since they start at log shares, whose exponentials add up to one.
        """
        logits = np.take(self.tree.bias, node, axis=0, mode="clip")
        for own in rows:
            logits += np.take(self.weights, own, axis=0, mode="clip")
        powers = np.exp(logits)
        return logits, powers, powers @ _ONES


def _tokens(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All tokens, the text of each, and its position in the text."""
    words = Words.of(texts)
    counts = words.counts()
    starts = np.concatenate(([0], np.cumsum(counts + 1)))
    out = np.full(starts[-1], END, np.uint64)
    doc = np.repeat(np.arange(len(texts)), counts + 1)
    out[np.arange(len(words.doc)) + words.doc] = words.hashes()
    return out, doc, np.arange(len(out)) - starts[doc]


def _contexts(tokens: np.ndarray, position: np.ndarray) -> np.ndarray:
    """Hashes of the features of each token, [feature, token]."""
    back = []
    for k in (1, 2):
        before = np.full(len(tokens), _START + _U(k), np.uint64)
        before[k:] = np.where(position[k:] >= k, tokens[:-k], before[k:])
        back.append(before)
    one, two = back
    return np.stack([mix(one), mix(two + _U(0x2F))])


def log_chances(model: Model, place: np.ndarray, contexts: np.ndarray) -> np.ndarray:
    """Natural log probability of each token; of all other words together where it is not modelled (place -1)."""
    out = np.zeros(len(place))
    for start in range(0, len(place), BATCH):
        here, ctx = place[start : start + BATCH], contexts[:, start : start + BATCH]
        depth, node, child = model.tree.path(model.leaf[here])
        logits, _, total = model.odds(node, model.rows(ctx, depth, node))
        chance = logits[np.arange(len(child)), child] - np.log(total)
        own = np.repeat(np.arange(len(here)), depth)
        out[start : start + BATCH] = np.bincount(own, chance, len(here))
    return out


class _Learner:
    """A task's copy of the model, updated batch by batch with steps that shrink row by row."""

    def __init__(self, model: Model) -> None:
        self.model = Model(model.tree, model.leaf, model.weights.copy(), model.seen.copy())
        self._start = model
        self.tokens = 0

    def learn(self, place: np.ndarray, contexts: np.ndarray) -> None:
        m = self.model
        flat = m.weights.reshape(-1)
        for start in range(0, len(place), BATCH):
            here, ctx = place[start : start + BATCH], contexts[:, start : start + BATCH]
            depth, node, child = m.tree.path(m.leaf[here])
            rows = m.rows(ctx, depth, node)
            _, error, total = m.odds(node, rows)
            error /= total[:, None]
            error[np.arange(len(child)), child] -= 1
            squares = (error * error) @ _ONES
            for own in rows:
                np.add.at(m.seen, own, squares)
                step = error * (np.float32(-RATE) / np.sqrt(m.seen[own]))[:, None]
                np.add.at(flat, ((own * WIDTH)[:, None] + _CHILDREN).ravel(), step.ravel())
            self.tokens += len(here)

    def update(self, own: slice) -> np.ndarray:
        """Squared gradients that each row of a part met, and what was learnt times these: [row, 1 + child]."""
        met = (self.model.seen[own] - self._start.seen[own])[:, None]
        return np.hstack([met, (self.model.weights[own] - self._start.weights[own]) * met])


def _places(v: Vocabulary, tokens: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Place and count of each token; count 0 for those not in the head."""
    hit, at = look_up(v.words, tokens)
    place, count = np.full(len(tokens), -1, np.int64), np.zeros(len(tokens), np.int64)
    place[hit], count[hit] = v.place[at], v.counts[at]
    return place, count


def count_words(rows: DataFrame) -> DataFrame:
    """(word, n) over the texts of ``rows`` (column text), counted in the tasks first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[np.ndarray] = []
        size = 0

        def flush() -> Iterator[pa.RecordBatch]:
            word, n = np.unique(np.concatenate(held), return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(word.view(np.int64)), pa.array(n)], names=["word", "n"])
            held.clear()

        for _, texts in chunks(batches, 0):
            held.append(_tokens(texts)[0])
            size += len(held[-1])
            if size >= 3_000_000:  # 24 MB
                yield from flush()
                size = 0
        if held:
            yield from flush()

    return rows.mapInArrow(run, "word long, n long").groupBy("word").agg(F.sum("n").alias("n"))


def vocabulary(counts: DataFrame) -> Vocabulary:
    """The head of the stored ``counts``: all words with at least the count that leaves no more than HEAD."""
    step = F.floor(F.log2("n") * 16)
    steps = counts.groupBy(step.alias("step")).agg(
        F.count("*").alias("words"), F.sum("n").alias("n"), F.min("n").alias("least")).collect()  # below 1,100 rows
    types, tokens, least, held = sum(r["words"] for r in steps), sum(r["n"] for r in steps), None, 0
    for r in sorted(steps, key=lambda r: -r["step"]):
        held += r["words"]
        if held > HEAD:
            break
        least = r["least"]
    head = counts.filter(F.col("n") >= least).toPandas() if least is not None else None
    words = head["word"].to_numpy().view(np.uint64) if head is not None else np.zeros(0, np.uint64)
    n = head["n"].to_numpy() if head is not None else np.zeros(0, np.int64)
    order = np.argsort(words)
    words, n = words[order], n[order]
    place = np.full(len(words), -1, np.int64)
    top = np.lexsort((words, -n))
    place[top] = np.arange(len(top))
    rest = tokens - int(n[top].sum()) + SMOOTH * (types - len(top) + 1)
    return Vocabulary(words, n, place, tokens, types, rest)


def train(rows: DataFrame, v: Vocabulary) -> Model:
    """Averaged gradient updates over all texts of ``rows`` (columns key, text)."""
    model = Model.of(v)
    tasks = max(rows.sparkSession.sparkContext.defaultParallelism, v.tokens // (ROUNDS * TASK_TOKENS))
    shape = "part long, met binary"
    for turn in range(ROUNDS):
        start = model

        def learn(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            learner = _Learner(start)
            for part, texts in chunks(batches, 1):
                tokens, _, position = _tokens(texts)
                learner.learn(_places(v, tokens)[0], _contexts(tokens, position))
            if learner.tokens:
                for k, own in enumerate(_parts(start)):
                    yield _piece(k, learner.update(own))

        def add_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            sums: dict[int, np.ndarray] = {}
            for batch in batches:
                for k, piece in zip(*(c.to_pylist() for c in batch.columns[:2])):
                    sums[k] = sums.get(k, 0) + np.frombuffer(piece, np.float32)
            for k, piece in sums.items():
                yield _piece(k, piece)

        own = rows.filter(F.pmod(F.xxhash64("key", F.lit(2)), F.lit(ROUNDS)) == turn).select("key", "text")
        pieces = own.coalesce(int(tasks)).mapInArrow(learn, shape).withColumn(
            "salt", F.pmod(F.spark_partition_id(), F.lit(PARTIAL_SUMS)))
        if tasks > PARTIAL_SUMS:
            pieces = pieces.repartition(PARTS * PARTIAL_SUMS, "part", "salt").mapInArrow(add_up, shape)
        whole = stored(pieces.repartition(PARTS, "part").mapInArrow(add_up, shape), "update").collect()  # one model
        if whole:
            model = Model(start.tree, start.leaf, start.weights.copy(), start.seen.copy())
            for k, own in enumerate(_parts(start)):
                for r in whole:
                    if r["part"] == k:
                        met = np.frombuffer(r["met"], np.float32).reshape(-1, 1 + WIDTH)
                        model.weights[own] += met[:, 1:] / np.maximum(met[:, :1], 1e-12)
                        model.seen[own] += met[:, 0] / tasks
    return model


def _parts(model: Model) -> list[slice]:
    size = -(-len(model.weights) // PARTS)
    return [slice(k * size, (k + 1) * size) for k in range(PARTS)]


def _piece(part: int, met: np.ndarray) -> pa.RecordBatch:
    columns = [pa.array([part], pa.int64()), pa.array([met.tobytes()], pa.binary())]
    return pa.RecordBatch.from_arrays(columns, names=["part", "met"])


def score(
    docs: DataFrame, held_out: Column, id_column: str = "doc_id", text_column: str = "text"
) -> DataFrame:
    """Scores of every row, learnt from those where ``held_out`` is false.

    Columns: ``id_column``, held_out, n_tokens, n_known, train_tokens, base_score (unigram) and score (model), both
    log10 probabilities of the whole text.
    """
    rows = docs.select(
        docs[id_column].alias("key"), docs[text_column].alias("text"), F.coalesce(held_out, F.lit(False)).alias("held_out"))
    learnt = rows.filter("not held_out")
    counts = stored(count_words(learnt.select("text")), "counts")
    v = vocabulary(counts)
    model = train(learnt, v)
    log_mass, log_rest = np.log10(v.mass), np.log10(v.rest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for part, texts in chunks(batches, 1):
            tokens, doc, position = _tokens(texts)
            place, count = _places(v, tokens)
            lone = np.where(count > 0, np.log10(count + SMOOTH), 0.0)  # words outside the head are added later
            base = np.bincount(doc, lone - log_mass, len(texts))
            full = log_chances(model, place, _contexts(tokens, position)) / np.log(10)
            full += np.where(place < 0, lone - log_rest, 0.0)
            tail = np.flatnonzero(count == 0)
            order = np.lexsort((tokens[tail], doc[tail]))
            tail = tail[order]
            new = np.ones(len(tail), bool)
            new[1:] = (tokens[tail][1:] != tokens[tail][:-1]) | (doc[tail][1:] != doc[tail][:-1])
            first = np.flatnonzero(new)
            times = np.diff(np.append(first, len(tail)))
            offsets = pa.array(np.searchsorted(doc[tail[first]], np.arange(len(texts) + 1)), pa.int32())
            columns = [
                part.column(0), part.column(2), pa.array(np.bincount(doc, minlength=len(texts))),
                pa.array(np.bincount(doc[count > 0], minlength=len(texts))), pa.array(base),
                pa.array(np.bincount(doc, full, len(texts))),
                pa.ListArray.from_arrays(offsets, pa.array(tokens[tail[first]].view(np.int64))),
                pa.ListArray.from_arrays(offsets, pa.array(times.astype(np.int32))),
            ]
            yield pa.RecordBatch.from_arrays(columns, names=names)

    names = ["key", "held_out", "n_tokens", "known", "base", "full", "words", "times"]
    kind = rows.schema["key"].dataType.simpleString()
    shape = f"key {kind}, held_out boolean, n_tokens long, known long, base double, full double, words array<long>, times array<int>"
    head = rows.mapInArrow(run, shape).withColumn("row", F.monotonically_increasing_id())
    head = stored(head, "scores")  # the row numbers hold from here on
    # a word outside the head has a small count, so none of them makes a large group
    tail = head.select("row", F.explode(F.arrays_zip("words", "times")).alias("w")).select("row", "w.words", "w.times")
    joined = tail.join(counts, F.col("words") == F.col("word"), "left")
    n = F.coalesce(F.col("n"), F.lit(0))
    sums = joined.groupBy("row").agg(
        F.sum(F.col("times") * F.log10(n + SMOOTH)).alias("more"),
        F.sum(F.when(n > 0, F.col("times")).otherwise(0)).alias("more_known"))
    out = head.drop("words", "times").join(sums, "row", "left")
    more = F.coalesce("more", F.lit(0.0))
    return out.select(
        F.col("key").alias(id_column), "held_out", "n_tokens",
        (F.col("known") + F.coalesce("more_known", F.lit(0))).alias("n_known"), F.lit(v.tokens).cast("long").alias("train_tokens"),
        (F.col("base") + more).alias("base_score"), (F.col("full") + more).alias("score"))
