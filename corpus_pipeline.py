"""A training corpus from raw documents, in five stages.

Each stage takes (spark, docs, sf_dir) and returns the rows that go on; ``run`` writes each result as Parquet in the
shared folder and reads it again for the next.  All but the last stage return the columns of their input.

1. language_id: rows whose language the model rejects go.
2. near_duplicates: of each group of documents joined by shared 5-word shingles (similarity 0.8 or more) the one
   with the smallest id stays; rows that repeat an id are one document.  Rows without an id stay.
3. decontamination: rows that hold a benchmark item go.
4. secrets: secrets found in a text are masked; n_chars follows the text.
5. tokens: texts become token ids, with digests of the ids and of what they decode to.

Null and empty texts have no language and go in the first stage.
"""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from trolley.llm import byte_bpe, decontam, language_id, ngram_join, secret_scan
from trolley.llm._store import by_ids, stored


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    return language_id.accepted(docs, language_id.fit(docs, F.coalesce(remainder != 2, F.lit(True))))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    found = stored(ngram_join.join(docs, n=5, num=80, den=100), "groups")
    by_id = found.groupBy("doc_id").agg(F.min("component_id").alias("component_id"), F.count("*").alias("rows"))
    copies = stored(by_id.filter("doc_id <> component_id").select("doc_id"), "copies")
    kept = by_ids(docs, copies, "doc_id", "left_anti")
    repeated = stored(by_id.filter("doc_id = component_id and rows > 1").select("doc_id"), "repeated")
    if repeated.isEmpty():
        return kept
    order = Window.partitionBy("doc_id").orderBy(*[F.col(c) for c in docs.columns if c != "doc_id"])
    several = by_ids(kept, repeated, "doc_id", "left_semi").withColumn("_llm_nth", F.row_number().over(order))
    once = several.filter("_llm_nth = 1").select(*docs.columns)
    return by_ids(kept, repeated, "doc_id", "left_anti").unionByName(once)


def drop_contaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    benchmark = spark.read.parquet(f"{sf_dir}/benchmark.parquet")
    return decontam.clean(docs, decontam.index(docs, benchmark))


def mask_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    text = F.coalesce(docs["text"], F.lit(""))
    accepted = secret_scan.limits(docs.select(secret_scan.candidates(text).alias("tested")))
    masked = secret_scan.redact(docs, accepted)
    return masked.withColumn("n_chars", F.when(F.col("n_chars").isNotNull(), F.length("text").cast("long")))


def to_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(
        docs, path, public_tokenizers.PATTERN, keep=["doc_id", "lang", "source"], with_ids=True)


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("language_id", identify_language),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_contaminated),
    ("secrets", mask_secrets),
    ("tokens", to_tokens),
]

#: The trained and the searching stages cannot be stated in SQL; tests compare them with plain Python.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = stored(stage(spark, docs, sf_dir), name)
    return docs
