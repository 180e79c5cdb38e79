import hashlib

import numpy as np
import public_tokenizers

import corpus_pipeline
from tests.llm.helpers import DATA, joined
from trolley.llm import byte_bpe, queries

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def test_stages_on_data(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    words = docs.filter("lang = 'en' and n_chars > 800").orderBy("doc_id").first().text.split()
    leak = " ".join(reversed(words)) + " password=abcdef123456 end"
    docs = docs.unionAll(spark.createDataFrame([(80001, leak, "en", "x", len(leak))], docs.schema))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "near_duplicates", "decontamination", "secrets", "tokens"]
    results = []
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), "test")
        results.append(docs)
    assert all(r.columns == COLUMNS for r in results[:-1])
    texts = [{r.doc_id: r.text for r in d.collect()} for d in results[:-1]]
    first = joined(sorted(texts[0].items()), 5, 80, 100)
    assert set(texts[1]) == {i for i, _, c in first if i == c}
    assert set(texts[2]) < set(texts[1]) and set(texts[3]) == set(texts[2])
    changed = [i for i in texts[3] if texts[3][i] != texts[2][i]]
    assert 80001 in changed and all("[SECRET]" in texts[3][i] for i in changed)
    assert all(r.n_chars == len(r.text) for r in results[3].collect())
    bpe = byte_bpe.ByteBpe(tokens := byte_bpe.read_ranks(public_tokenizers.path("byte_bpe_multi_50k.tiktoken")),
                           public_tokenizers.PATTERN, byte_bpe.model_proto(tokens))
    final = {r.doc_id: r for r in results[4].collect()}
    assert set(final) == set(texts[3])
    for i, r in final.items():
        assert bpe.decode(np.array(r.ids, "<u4").tobytes()).decode() == texts[3][i]
        assert r.decoded_sha256 == hashlib.sha256(texts[3][i].encode()).hexdigest()


def test_odd_rows(spark):
    base = spark.read.parquet(f"{DATA}/documents.parquet").limit(60)
    some = base.filter("lang = 'en'").orderBy("doc_id").first()
    odd = [(some.doc_id, some.text, "en", "x", 1), (some.doc_id, some.text, "en", "x", 1), (None, some.text, None, None, None),
           (90001, None, None, None, None), (90002, "", "en", None, 0)]
    docs = base.unionAll(spark.createDataFrame(odd, base.schema))
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), "test")
    ids = [r.doc_id for r in docs.collect()]
    assert 90001 not in ids and 90002 not in ids and len(ids) == len(set(ids))


def test_empty_documents(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    for _, stage in corpus_pipeline.STAGES:
        docs = corpus_pipeline.stored(stage(spark, docs, DATA), "test")
    assert docs.collect() == []


def test_every_operator_has_one_query():
    assert sorted(n for n in queries.QUERIES if n.startswith("op")) == sorted(
        n for n in queries.QUERIES if n[2:].split("_")[0] in {str(k) for k in range(1, 14)})
    assert len(queries.QUERIES) == 14 and queries.QUERIES["pipeline"] is corpus_pipeline.run
