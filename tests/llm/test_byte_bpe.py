import hashlib
import random

import numpy as np
import public_tokenizers
import pytest
import tiktoken

from tests.llm.helpers import DATA, docs_of
from trolley.llm import byte_bpe

PATH, PATTERN = public_tokenizers.path("byte_bpe_multi_50k.tiktoken"), public_tokenizers.PATTERN
TOKENS = byte_bpe.read_ranks(PATH)


@pytest.fixture(scope="module")
def known():
    return tiktoken.Encoding(
        "test", pat_str=PATTERN, mergeable_ranks={t: k for k, t in enumerate(TOKENS)}, special_tokens={})


ODD = [
    None, "", " ", "\n\n  x", "a  b\tc \n d ", "don't we'll I'm", "x" * 4000 + " " * 500 + "y", "日本語 한국어 العربية ไทย",
    "😀😀 e\u0301 \u2581 \u3000 \x00\x01", "<|endoftext|>", "1234567 12 3.4", " lead", "trail ", "\u00a0no\u00a0break a\u00a0 b",
]


def test_equals_tiktoken(spark, known):
    texts = ODD + [r.text for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()]
    rows = [*enumerate(texts), (3, "\n\n  x"), (None, "null id")]
    found = byte_bpe.round_trip(docs_of(spark, *rows), PATH, PATTERN).collect()
    want = []
    for i, text in rows:
        ids = known.encode_ordinary(text or "")
        digest = hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest()
        want.append((i, len(ids), digest, hashlib.sha256((text or "").encode()).hexdigest()))
    assert sorted(map(tuple, found), key=str) == sorted(want, key=str)


def test_random_token_sequences(known):
    random.seed(8)
    bpe = byte_bpe.ByteBpe(TOKENS, PATTERN, byte_bpe.model_proto(TOKENS))
    texts = [b"".join(random.choice(TOKENS) for _ in range(6)).decode("utf-8", "ignore") for _ in range(3000)]
    for text, ids in zip(texts, bpe.encode(texts)):
        assert np.frombuffer(ids, "<u4").tolist() == known.encode_ordinary(text)
        assert bpe.decode(ids) == text.encode()


def test_forgetting_changes_nothing(monkeypatch, known):
    monkeypatch.setattr(byte_bpe, "REMEMBERED", 3)
    bpe = byte_bpe.ByteBpe(TOKENS, PATTERN, byte_bpe.model_proto(TOKENS))
    for _ in range(3):
        for text in ODD[1:]:
            assert np.frombuffer(bpe.encode([text])[0], "<u4").tolist() == known.encode_ordinary(text)


def test_encode_and_decode(spark):
    docs = docs_of(spark, *enumerate(ODD))
    ids = byte_bpe.encode(docs, PATH, PATTERN)
    back = {r.doc_id: bytes(r.data) for r in byte_bpe.decode(ids, PATH, PATTERN).collect()}
    assert back == {k: (t or "").encode() for k, t in enumerate(ODD)}
    assert byte_bpe.encode(docs.limit(0), PATH, PATTERN).collect() == []


def test_gaps_in_ranks_are_refused(tmp_path):
    (tmp_path / "ranks").write_text("YQ== 0\nYg== 2\n")
    with pytest.raises(ValueError):
        byte_bpe.read_ranks(str(tmp_path / "ranks"))
