"""One query per operator over a whole table, and the SQL that states its result where SQL can."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

import corpus_pipeline
from trolley.llm import (
    byte_bpe, decontam, html_text, language_id, lm_score, ngram_join, quality, ranked_search, secret_scan, spelling, suffix_dedup, toxicity,
    url_filter,
)
from trolley.llm._store import stored


def _table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return secret_scan.scan(stored(secret_scan.measure(docs, ["doc_id"]), "secrets"))


def op2_ngram_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ngram_join.join(_table(spark, sf_dir, "documents"), n=3, num=90, den=100)


def op3_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 10 == 0
    return lm_score.score(_table(spark, sf_dir, "documents"), held_out)


URL_RULES = [
    (url_filter.ALLOW, "com/"),
    (url_filter.BLOCK, "example.com/en/"),
    (url_filter.ALLOW, "www.example.com/en/"),
    (url_filter.BLOCK, "net/es/"),
    (url_filter.BLOCK, "net/fr/"),
]


def op4_url_filter(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    return url_filter.judge(pages, url_filter.fit(pages, URL_RULES), URL_RULES)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return toxicity.predict(docs, toxicity.fit(docs, _table(spark, sf_dir, "labels")))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    return decontam.contaminated(docs, decontam.index(docs, _table(spark, sf_dir, "benchmark")))


def op7_byte_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    path = public_tokenizers.path("byte_bpe_multi_50k.tiktoken")
    return byte_bpe.round_trip(_table(spark, sf_dir, "documents"), path, public_tokenizers.PATTERN)


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    remainder = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4
    model = language_id.fit(docs, remainder != 2)
    found = language_id.predict(docs, model)
    return found.select("doc_id", F.coalesce(remainder == 2, F.lit(False)).alias("held_out"), "lang_pred", "score", "rejected")


def op9_html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    pages = _table(spark, sf_dir, "pages")
    # the url rides along as part of the id, so no join is needed
    keyed = pages.select(F.struct("page_id", "url").alias("page"), "html")
    text = html_text.extract(keyed, "page")
    return text.select("page.page_id", "page.url", "text", F.length("text").cast("long").alias("n_chars"), "n_blocks")


def op10_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = _table(spark, sf_dir, "documents")
    model = quality.fit(docs, _table(spark, sf_dir, "labels"))
    columns = ["doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept"]
    return quality.judge(docs, model).select(*columns, "chance")


def op11_spelling_variants(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spelling.variants(_table(spark, sf_dir, "documents"))


def op12_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return suffix_dedup.dedup(_table(spark, sf_dir, "documents"))


def op13_ranked_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked_search.search(_table(spark, sf_dir, "documents"), _table(spark, sf_dir, "benchmark"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    "op1_secret_scan": op1_secret_scan,
    "op2_ngram_join": op2_ngram_join,
    "op3_lm_score": op3_lm_score,
    "op4_url_filter": op4_url_filter,
    "op5_toxicity": op5_toxicity,
    "op6_decontamination": op6_decontamination,
    "op7_byte_bpe": op7_byte_bpe,
    "op8_language_id": op8_language_id,
    "op9_html_text": op9_html_text,
    "op10_quality": op10_quality,
    "op11_spelling_variants": op11_spelling_variants,
    "op12_suffix_dedup": op12_suffix_dedup,
    "op13_ranked_search": op13_ranked_search,
    "pipeline": corpus_pipeline.run,
}

ORACLE_SQL: dict[str, str] = {
    "op2_ngram_join": """
        WITH RECURSIVE tokens AS (
            SELECT doc_id, regexp_extract_all(
                       translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x20\\x09-\\x0D]+') AS w
            FROM documents),
        sets AS (
            SELECT doc_id,
                   CASE WHEN len(w) = 0 THEN []::VARCHAR[] WHEN len(w) < 3 THEN [array_to_string(w, ' ')]
                        ELSE list_distinct([w[i] || ' ' || w[i + 1] || ' ' || w[i + 2] FOR i IN range(1, len(w) - 1)])
                   END AS s
            FROM tokens),
        grams AS (SELECT doc_id, len(s) AS n, unnest(s) AS g FROM sets),
        links AS (
            SELECT a.doc_id AS a, b.doc_id AS b
            FROM grams a JOIN grams b ON a.g = b.g AND a.doc_id <> b.doc_id
            GROUP BY a.doc_id, b.doc_id, a.n, b.n
            HAVING 100 * count(*) >= 90 * (a.n + b.n - count(*))),
        reach AS (
            SELECT doc_id AS a, doc_id AS b FROM documents
            UNION SELECT r.a, l.b FROM reach r JOIN links l ON l.a = r.b)
        SELECT s.doc_id, CAST(len(s) AS BIGINT) AS n_shingles, m.component_id
        FROM sets s JOIN (SELECT a, min(b) AS component_id FROM reach GROUP BY a) m ON m.a = s.doc_id""",
    "op11_spelling_variants": """
        WITH RECURSIVE crc_table AS (
            SELECT list_transform(range(256), lambda v: list_reduce(range(8),
                       lambda c, k: CASE WHEN c % 2 = 1 THEN xor(c // 2, 3988292384) ELSE c // 2 END, v)) AS t),
        runs AS (
            SELECT doc_id, run, count(*) AS n
            FROM (SELECT doc_id, unnest(regexp_extract_all(
                             translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                             '[A-Za-z\u00C0-\u00FF]+')) AS run
                  FROM documents)
            WHERE length(run) >= 7 GROUP BY doc_id, run),
        coded AS (
            SELECT run, n, hex(encode(coalesce(CAST(doc_id AS VARCHAR), '') || ':' || run)) AS bytes FROM runs),
        summed AS (
            SELECT run, n, xor(4294967295, list_reduce(
                       list_transform(range(length(bytes) // 2), lambda i: CAST('0x' || substr(bytes, 2 * i + 1, 2) AS BIGINT)),
                       lambda c, b: xor(t[xor(c, b) % 256 + 1], c // 256), 4294967295)) AS h
            FROM coded, crc_table),
        spoiled AS (
            SELECT CASE WHEN h % 31 = 0 THEN substr(run, 1, CAST(h % length(run) AS BIGINT)) || substr(run, CAST(h % length(run) AS BIGINT) + 2)
                        ELSE run END AS word, n
            FROM summed),
        words AS (
            SELECT word, CAST(sum(n) AS BIGINT) AS n FROM spoiled WHERE length(word) >= 7 GROUP BY word HAVING sum(n) >= 2),
        holes AS (
            SELECT word, n, i, substr(word, 1, i - 1) AS head, substr(word, i + 1) AS tail
            FROM (SELECT word, n, unnest(range(1, length(word) + 1)) AS i FROM words)),
        near AS (
            SELECT a.word, b.word AS other, b.n AS other_n
            FROM holes a JOIN holes b ON a.i = b.i AND a.head = b.head AND a.tail = b.tail AND a.word <> b.word
            UNION SELECT a.word, b.word, b.n FROM holes a JOIN words b ON b.word = a.head || a.tail
            UNION SELECT b.word, a.word, a.n FROM holes a JOIN words b ON b.word = a.head || a.tail),
        best AS (
            SELECT word, count(*) AS n_near, max(other_n) AS form_n, min(other) FILTER (WHERE other_n = m) AS form
            FROM (SELECT *, max(other_n) OVER (PARTITION BY word) AS m FROM near) GROUP BY word),
        formed AS (
            SELECT w.word, w.n, CAST(coalesce(n_near, 0) AS BIGINT) AS n_near,
                   CASE WHEN form_n >= 10 * w.n THEN form END AS form, CASE WHEN form_n >= 10 * w.n THEN form_n END AS form_n
            FROM words w LEFT JOIN best b ON b.word = w.word),
        steps AS (
            SELECT word, word AS root, form AS next FROM formed
            UNION ALL SELECT s.word, f.word, f.form FROM steps s JOIN formed f ON f.word = s.next)
        SELECT f.word, f.form, s.root, f.n, f.n_near, f.form_n
        FROM formed f JOIN steps s ON s.word = f.word AND s.next IS NULL""",
    "op12_suffix_dedup": """
        WITH texts AS (
            SELECT row_number() OVER () AS r, doc_id, hex(encode(coalesce(text, ''))) AS digits FROM documents),
        windows AS (
            SELECT r, start + pos AS pos, md5_number(substr(piece, 2 * pos + 1, 800)) AS w
            FROM (SELECT r, start, piece, unnest(range(length(piece) // 2 - 399)) AS pos
                  FROM (SELECT r, start, substr(digits, 2 * start + 1, 1798) AS piece
                        FROM (SELECT r, digits, unnest(range(0, length(digits) // 2 - 399, 500)) AS start FROM texts)))),
        repeated AS (
            SELECT r, pos FROM windows WHERE w IN (SELECT w FROM windows GROUP BY w HAVING count(*) > 1)),
        islands AS (
            SELECT r, pos, sum(new) OVER (PARTITION BY r ORDER BY pos) AS island
            FROM (SELECT r, pos, CASE WHEN pos <= lag(pos) OVER (PARTITION BY r ORDER BY pos) + 400 THEN 0 ELSE 1 END AS new
                  FROM repeated)),
        spans AS (
            SELECT r, min(pos) AS first, max(pos) + 400 AS past FROM islands GROUP BY r, island),
        gaps AS (
            SELECT r, past AS first, lead(first) OVER (PARTITION BY r ORDER BY first) AS past FROM spans
            UNION ALL SELECT r, 0, min(first) FROM spans GROUP BY r
            UNION ALL SELECT r, 0, NULL FROM texts WHERE r NOT IN (SELECT r FROM spans)),
        kept AS (
            SELECT t.r, string_agg(substr(digits, 2 * first + 1, 2 * (coalesce(past, length(digits) // 2) - first)), '' ORDER BY first) AS digits
            FROM texts t JOIN gaps g ON g.r = t.r GROUP BY t.r)
        SELECT t.doc_id, CAST(length(t.digits) // 2 AS BIGINT) AS n_bytes,
               CAST((length(t.digits) - length(k.digits)) // 2 AS BIGINT) AS n_removed,
               CAST(coalesce(s.n, 0) AS BIGINT) AS n_spans, sha256(unhex(k.digits)) AS kept_sha256
        FROM texts t JOIN kept k ON k.r = t.r LEFT JOIN (SELECT r, count(*) AS n FROM spans GROUP BY r) s ON s.r = t.r""",
    "op13_ranked_search": """
        WITH words AS (
            SELECT doc_id, regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+') AS w
            FROM documents),
        held AS (SELECT doc_id, CAST(len(w) AS BIGINT) AS n, w FROM words WHERE len(w) > 0),
        size AS (SELECT count(*) AS docs, CAST(sum(n) AS BIGINT) AS total FROM held),
        asked AS (
            SELECT DISTINCT item_id, unnest(regexp_extract_all(
                       translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                       '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+')) AS t
            FROM benchmark),
        counted AS (
            SELECT doc_id, n, t, count(*) AS tf
            FROM (SELECT doc_id, n, unnest(w) AS t FROM held)
            WHERE t IN (SELECT t FROM asked) GROUP BY doc_id, n, t),
        weights AS (
            SELECT t, CAST(floor(1000 * ln(CAST(2 * docs + 2 AS DOUBLE) / CAST(2 * count(*) + 1 AS DOUBLE))) AS BIGINT) AS w
            FROM counted, size GROUP BY t, docs),
        scored AS (
            SELECT item_id, doc_id,
                   CAST(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * (100 - 90 + (90 * n * docs) // total)))) AS BIGINT) AS score
            FROM asked JOIN counted USING (t) JOIN weights USING (t), size GROUP BY item_id, doc_id),
        ranked AS (
            SELECT *, CAST(row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id) AS INTEGER) AS rank
            FROM scored WHERE score > 0)
        SELECT item_id, rank, doc_id, score FROM ranked WHERE rank <= 10""",
}
if corpus_pipeline.ORACLE_SQL:
    ORACLE_SQL["pipeline"] = corpus_pipeline.ORACLE_SQL
