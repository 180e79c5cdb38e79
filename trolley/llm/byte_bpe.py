"""Byte-level BPE encoding and decoding by a sentencepiece BPE model built from a rank file.

Every byte stands for one printable character, so every token is a piece of such characters.  The model is
written down directly: the pieces in rank order, each scored by its negative rank, and identity
normalisation.  A sentencepiece BPE merges the adjacent pair whose union scores highest, leftmost first,
which is the pair of lowest rank; so each pre-token gets the ids that byte-level BPE gives it.  A pre-token
that is a token itself gets that token.

Rows that cannot be encoded do not exist: null and empty texts have no ids, any other text has at least one
for every pre-token.  Repeated rows give repeated results, empty tables empty ones; other columns are not read.
"""

from __future__ import annotations

import base64
import hashlib
import struct
from collections.abc import Iterator
from itertools import accumulate, chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from trolley.llm._store import small_batches
from trolley.llm._words import chunks, give_back

#: Distinct pre-tokens, and pieces, that a task remembers between chunks; beyond it they are met anew.
REMEMBERED = 100_000
#: Longer pre-tokens are not remembered.
LONGEST_REMEMBERED = 64

_FIRST_CHARACTER = 0x4E00  # byte b is the character _FIRST_CHARACTER + b: letters, no spaces, no case
_BYTE_TEXT = [chr(_FIRST_CHARACTER + b) for b in range(256)]
_MAPPED = {b: _FIRST_CHARACTER + b for b in range(256)}


def read_ranks(path: str) -> list[bytes]:
    """Tokens of a rank file in rank order; the ranks must be 0, 1, 2, ..."""
    with open(path, "rb") as lines:
        pairs = [line.split() for line in lines if line.strip()]
    ranked = sorted((int(rank), base64.b64decode(token)) for token, rank in pairs)
    if [rank for rank, _ in ranked] != list(range(len(ranked))):
        raise ValueError(f"the ranks of {path} have gaps")
    return [token for _, token in ranked]


def _varint(n: int) -> bytes:
    out = bytearray()
    while n > 127:
        out.append(n & 127 | 128)
        n >>= 7
    out.append(n)
    return bytes(out)


def _bytes_field(number: int, data: bytes) -> bytes:
    return _varint(number << 3 | 2) + _varint(len(data)) + data


def _int_field(number: int, value: int) -> bytes:
    return _varint(number << 3) + _varint(value)


def _mapped(data: bytes) -> str:
    return data.decode("latin-1").translate(_MAPPED)


def model_proto(tokens: list[bytes]) -> bytes:
    """A serialised sentencepiece model: piece i is token i, and one unknown piece stands last.

    Fixed values, from the public message definition: pieces are field 1 (text 1, score 2 as float32,
    type 3 with unknown = 2), the trainer's settings field 2 (model type 3 with BPE = 2, unknown id 40, and
    start, end and padding ids 41 to 43, here none), normalisation field 3 (name 1, add dummy prefix 3,
    remove extra spaces 4, escape spaces 5).
    """
    pieces = [
        _bytes_field(1, _bytes_field(1, _mapped(token).encode()) + _varint(2 << 3 | 5) + struct.pack("<f", -rank))
        for rank, token in enumerate(tokens)
    ]
    unknown = _bytes_field(1, _bytes_field(1, b"<unk>") + _int_field(3, 2))
    none = (1 << 64) - 1  # -1
    trainer = (
        _int_field(3, 2) + _int_field(40, len(tokens))
        + _int_field(41, none) + _int_field(42, none) + _int_field(43, none)
    )
    identity = _bytes_field(1, b"identity") + _int_field(3, 0) + _int_field(4, 0) + _int_field(5, 0)
    return b"".join(pieces) + unknown + _bytes_field(2, trainer) + _bytes_field(3, identity)


class ByteBpe:
    """Encoder and decoder of one task; ids travel as little-endian unsigned 32-bit integers."""

    def __init__(self, tokens: list[bytes], pattern: str, proto: bytes) -> None:
        import regex
        import sentencepiece

        self.tokens = tokens
        self._find = regex.compile(pattern).findall
        self._model = sentencepiece.SentencePieceProcessor(model_proto=proto)
        self._whole = {}
        for rank, token in enumerate(tokens):
            try:
                self._whole[token.decode()] = struct.pack("<I", rank)
            except UnicodeDecodeError:
                pass  # no pre-token is a broken character
        self._known = dict(self._whole)
        self._pieces: dict[str, bytes] = {}

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of a chunk of texts.

        A single space between two other characters always begins a pre-token, so the pieces between such
        spaces are encoded once and then looked up; texts with other white space beside a space are
        searched whole.
        """
        packed: list[bytes] = [b""] * len(texts)
        pieces = [t.split(" ") for t in texts]
        heads = [(i, p[0]) for i, p in enumerate(pieces) if p[0]]
        new = list(set().union(*(p[1:] for p in pieces)).difference(self._pieces))
        new = [p for p in new if p and not p[0].isspace() and not p[-1].isspace()]
        if new:
            parts = self._find(" " + " ".join(new))  # a pre-token with a leading space begins each piece
            ids = self._ids(parts)
            ends = list(accumulate(map(len, ids), initial=0))
            begin = [e for e, p in zip(ends, parts) if p[0] == " "] + [ends[-1]]
            flat = b"".join(ids)
            self._pieces.update((p, flat[a:b]) for p, a, b in zip(new, begin, begin[1:]))
        known, odd = self._pieces.__getitem__, []
        for i, p in enumerate(pieces):
            try:
                if p[0][-1:].isspace():
                    odd.append(i)
                else:
                    packed[i] = b"".join(map(known, p[1:]))
            except KeyError:
                odd.append(i)
        whole = set(odd)
        heads = [(i, h) for i, h in heads if i not in whole]
        for (i, _), ids in zip(heads, self._search([h for _, h in heads])):
            packed[i] = ids + packed[i]
        for i, ids in zip(odd, self._search([texts[i] for i in odd])):
            packed[i] = ids
        if len(self._pieces) > REMEMBERED:
            self._pieces.clear()
        if len(self._known) > REMEMBERED + len(self._whole):
            self._known = dict(self._whole)
        return packed

    def _search(self, texts: list[str]) -> list[bytes]:
        split = [self._find(t) for t in texts]
        ids = self._ids(list(chain.from_iterable(split)))
        ends = accumulate(map(len, split), initial=0)
        return [b"".join(ids[a : a + len(p)]) for a, p in zip(ends, split)]

    def _ids(self, parts: list[str]) -> list[bytes]:
        """Ids of pre-tokens; each one not met before is merged once."""
        new = list(set(parts).difference(self._known))
        if new:
            ids = self._model.encode([_mapped(p.encode()) for p in new], out_type=int, num_threads=1)
            counts = [len(i) for i in ids]
            flat = np.fromiter(chain.from_iterable(ids), "<u4", sum(counts)).tobytes()
            ends = list(accumulate((4 * c for c in counts), initial=0))
            self._known.update((p, flat[a:b]) for p, a, b in zip(new, ends, ends[1:]))
        packed = list(map(self._known.__getitem__, parts))
        for p in new:
            if len(p) > LONGEST_REMEMBERED:
                del self._known[p]
        return packed

    def decode(self, ids: bytes) -> bytes:
        return b"".join(map(self.tokens.__getitem__, np.frombuffer(ids, "<u4").tolist()))


def _tool(path: str, pattern: str) -> tuple[list[bytes], str, bytes]:
    """What a task needs to build its encoder: small, of fixed size."""
    tokens = read_ranks(path)
    return tokens, pattern, model_proto(tokens)


def _id_lists(packed: list[bytes]) -> pa.Array:
    offsets = np.cumsum([0, *(len(p) // 4 for p in packed)])
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(np.frombuffer(b"".join(packed), "<i4")))


def encode(docs: DataFrame, path: str, pattern: str, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """``id_column`` and the ids of each whole text (array of int; empty for null and empty texts).

    ``path`` names a rank file, read once by the driver; ``pattern`` splits texts into pre-tokens.
    """
    small_batches(docs.sparkSession)
    parts = _tool(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(*parts)
        for rows, texts in chunks(batches, 1):
            packed = bpe.encode([t.decode() for t in texts])
            yield pa.RecordBatch.from_arrays([rows.column(0), _id_lists(packed)], names=["id", "ids"])

    rows = docs.select(docs[id_column].alias("id"), docs[text_column].alias("text"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, ids array<int>").withColumnRenamed("id", id_column)


def decode(encoded: DataFrame, path: str, pattern: str, id_column: str = "doc_id", ids_column: str = "ids") -> DataFrame:
    """``id_column`` and the bytes that each list of ids stands for (null ids: no bytes)."""
    small_batches(encoded.sparkSession)
    tokens, _, _ = _tool(path, pattern)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            lists = batch.column(1).to_pylist()
            data = [b"".join(map(tokens.__getitem__, ids or ())) for ids in lists]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(data, pa.binary())], names=["id", "data"])

    rows = encoded.select(encoded[id_column].alias("id"), encoded[ids_column].alias("ids"))
    kind = rows.schema["id"].dataType.simpleString()
    return rows.mapInArrow(run, f"id {kind}, data binary").withColumnRenamed("id", id_column)


def round_trip(
    docs: DataFrame, path: str, pattern: str, keep: list[str] | None = None, text_column: str = "text",
    with_ids: bool = False,
) -> DataFrame:
    """Per row: the columns ``keep``, number of ids, digest of the ids and digest of the bytes they decode to.

    One pass over the texts; decoded bytes never leave the task, ids only where ``with_ids`` asks for them.
    Columns: ``keep`` (doc_id), n_tokens, ids_sha256 (of the ids as little-endian unsigned 32-bit integers),
    decoded_sha256 and, if asked for, ids.
    """
    small_batches(docs.sparkSession)
    parts = _tool(path, pattern)
    keep = keep or ["doc_id"]
    rows = docs.select(docs[text_column].alias("_llm_text"), *[docs[c] for c in keep])
    names = [*keep, "n_tokens", "ids_sha256", "decoded_sha256", *(["ids"] if with_ids else [])]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bpe = ByteBpe(*parts)
        for part, texts in chunks(batches, 0):
            packed = bpe.encode([t.decode() for t in texts])
            columns = [
                *part.columns[1:],
                pa.array([len(p) // 4 for p in packed], pa.int64()),
                pa.array([hashlib.sha256(p).hexdigest() for p in packed], pa.string()),
                pa.array([hashlib.sha256(bpe.decode(p)).hexdigest() for p in packed], pa.string()),
            ]
            if with_ids:
                columns.append(_id_lists(packed))
            yield pa.RecordBatch.from_arrays(columns, names=names)
        del bpe
        give_back()

    kept = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in rows.schema.fields[1:])
    shape = f"{kept}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return rows.mapInArrow(run, shape)
