"""URL filters: rules by host and path, else host word segmentation and naive Bayes.

A unigram model of words, counted over the labels and path parts of all given urls, splits concatenated names
(Viterbi: the split of largest probability).  Multinomial naive Bayes over the segmented words of host and path
then gives the verdict of a url that no rule fits.  It learns from two documented sources: fixed seed words of
either kind, and the urls decided by rules on whole hosts, whose words are counted once for each host.  A rule on
a path speaks of a section, not of the words of its site, so its urls teach nothing.  Both kinds are compared by
shares of their own evidence, however much there is of either: a table of more hosts with the same mixture gives the
same weights, and a word that only allowed hosts hold never speaks for block.

All of it is counted, split and joined by Spark over all names: a name's substrings are joined with the words, and what
comes back is split in the task that has it, so no vocabulary has to fit anywhere and none is cut.  Runs of more
than NAME_LETTERS letters are taken as several names.

A null url, or one without ``://``, has an empty host and path; no rule fits it and the model sees no words,
so the verdict is the one favoured beforehand, allow.  Repeated rows get equal results, empty tables empty ones,
other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from trolley.llm._store import stored

ALLOW, BLOCK = "allow", "block"

# Words that mark a url as unwanted or as ordinary before any url has been seen.
BLOCK_WORDS = (
    "ads adult advert affiliate bet bets betting bonus casino cheap click clicks coupon credit discount escort farm free "
    "gambling jackpot loan loans lottery nude payday pharma pharmacy pill pills poker porn prize replica sex slots "
    "spam track tracker tracking viagra warez win winner xxx"
).split()
ALLOW_WORDS = (
    "about academy archive article articles blog book books city college docs edu education forum gov guide health "
    "help history home journal learn library magazine museum music news online paper press public research review "
    "school science shop sport state store story team tech times university weather wiki world"
).split()
#: Host labels that say nothing of a site.
PLAIN_LABELS = frozenset("www m mobile example com org net edu gov info co uk de fr es io html htm php index".split())

#: Letters of a name at most, those of the longest host.
NAME_LETTERS = 253
#: Shorter words (language codes, single letters) say nothing to the naive Bayes model.
SHORTEST_WORD = 3
#: Counts that the seed words bring along to the unigram model.
SEED_COUNT = 50
#: A seed word's part of the mass of what has been seen of its kind, and the part of a kind that each word has unseen.
SEED_SHARE = 0.05
UNSEEN_SHARE = 0.0004


def host_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "(?s)^.*?://", ""))
    host = F.regexp_extract(rest, r"(?s)^[^/?#]*", 0)
    return F.coalesce(F.translate(host, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"), F.lit(""))


def path_of(url: Column) -> Column:
    rest = F.when(F.instr(url, "://") > 0, F.regexp_replace(url, "(?s)^.*?://", ""))
    return F.coalesce(F.regexp_extract(F.regexp_replace(rest, "(?s)^[^/?#]*", ""), r"(?s)^[^?#]*", 0), F.lit(""))


def rule_of(host: Column, path: Column, rules: list[tuple[str, str]]) -> tuple[Column, Column]:
    """The longest rule that fits and its verdict (null if none does).

    ``rules`` are (verdict, text); a text is a host, then a path from its first ``/``.  It fits its host and
    all subdomains where the path starts with the rule's.
    """
    verdict = name = F.lit(None).cast("string")
    for verdict_, text in sorted(rules, key=lambda r: (len(r[1]), r[1])):
        rule_host, rule_path = text.split("/", 1)
        fits = ((host == rule_host) | F.endswith(host, F.lit(f".{rule_host}"))) & F.startswith(path, F.lit(f"/{rule_path}"))
        name = F.when(fits, F.lit(text)).otherwise(name)
        verdict = F.when(fits, F.lit(verdict_)).otherwise(verdict)
    return name, verdict


def _names(host: Column, path: Column) -> Column:
    """Runs of letters in the host without its plain labels, and in the path."""
    labels = F.filter(F.split(host, "\\."), lambda x: ~x.isin(*sorted(PLAIN_LABELS)))
    text = F.lower(F.concat_ws(" ", F.array_join(labels, " "), path))
    found = F.regexp_extract_all(text, F.lit(f"[a-z]{{1,{NAME_LETTERS}}}"), F.lit(0))
    return F.filter(found, lambda x: ~x.isin(*sorted(PLAIN_LABELS)))


def viterbi(name: str, counts: dict[str, int], total: int) -> list[str]:
    """The split of least cost, by word ``counts`` out of ``total``.

    A string of letters that is no word costs more with each letter.
    """
    best, start = [0.0] + [math.inf] * len(name), [0] * (len(name) + 1)
    for end in range(1, len(name) + 1):
        for begin in range(end):
            n = counts.get(name[begin:end])
            cost = best[begin] + (math.log(total) + 2.5 * (end - begin) if n is None else math.log(total / (n + 1)))
            if cost < best[end] - 1e-12:
                best[end], start[end] = cost, begin
    words, end = [], len(name)
    while end:
        words.append(name[start[end] : end])
        end = start[end]
    return words[::-1]


def fewest(name: str, words: set[str]) -> list[str] | None:
    """The fewest of ``words`` that make up ``name``, of equal ones the one whose last word is longest; None if none do."""
    best: list[list[str] | None] = [[]] + [None] * len(name)
    for end in range(1, len(name) + 1):
        for begin in range(end):
            head = best[begin]
            if head is not None and name[begin:end] in words and (best[end] is None or len(head) + 1 < len(best[end])):
                best[end] = [*head, name[begin:end]]
    return best[-1]


def _substrings(name: Column, least: int = 1) -> Column:
    letters = F.length(name)
    starts = F.sequence(F.lit(1), letters - least + 1)
    ends = lambda at: F.transform(F.sequence(F.lit(least), letters - at + 1), lambda n: F.substring(name, at, n))
    return F.when(letters >= least, F.array_distinct(F.flatten(F.transform(starts, ends))))


def _mapped(rows: DataFrame, split) -> DataFrame:
    """(name, words) of ``rows`` (name, found), where ``split`` makes the words of both."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, found = (batch.column(k).to_pylist() for k in (0, 1))
            words = pa.array([split(n, f) for n, f in zip(names, found)], pa.list_(pa.string()))
            yield pa.RecordBatch.from_arrays([batch.column(0), words], names=["name", "words"])

    return rows.mapInArrow(run, "name string, words array<string>")


def vocabulary(counts: DataFrame) -> DataFrame:
    """(word, n) of the stored ``counts`` (word, n) without those words that are put together from others.

    A name that stands in the urls in one piece is counted like a word.  It is a compound if it can be split into words
    of SHORTEST_WORD letters or more, each at least as frequent; its count goes to the fewest of these that are
    no compounds themselves.  There always are some, since a compound's parts are as frequent as it is.
    """
    part = counts.select(F.col("word").alias("part"), F.col("n").alias("part_n"))
    parts = counts.select("word", "n", F.explode(_substrings(F.col("word"), SHORTEST_WORD)).alias("part"))
    parts = stored(parts.filter("part <> word").join(part, "part").filter("part_n >= n").select("word", "n", "part"), "parts")

    def split(rows: DataFrame) -> DataFrame:
        found = rows.groupBy(F.col("word").alias("name")).agg(F.collect_set("part").alias("found"))  # of one word
        return _mapped(found, lambda name, found: fewest(name, set(found))).filter("words is not null")

    compounds = stored(split(parts).select("name"), "compounds")
    plain = parts.join(compounds, parts["part"] == compounds["name"], "left_anti")
    given = split(plain.join(compounds, plain["word"] == compounds["name"], "left_semi"))
    given = given.join(counts, given["name"] == counts["word"]).select(F.explode("words").alias("word"), "n")
    simple = counts.join(compounds, counts["word"] == compounds["name"], "left_anti")
    return simple.select("word", "n").unionAll(given).groupBy("word").agg(F.sum("n").alias("n"))


@dataclass
class UrlModel:
    """Stored tables: ``words`` (word, n) with the sum of their n + 1, and ``weights`` (word, weight: log odds of block)."""

    words: DataFrame
    total: int
    weights: DataFrame | None
    prior: float

    def split(self, names: DataFrame) -> DataFrame:
        """(name, words) of distinct ``names`` (name)."""
        total = self.total
        found = names.select("name", F.explode(_substrings(F.col("name"))).alias("word")).join(self.words, "word")
        found = found.groupBy("name").agg(F.collect_list(F.struct("word", "n")).alias("found"))  # substrings of one name
        found = names.join(found, "name", "left")
        return _mapped(found, lambda name, found: viterbi(name, {f["word"]: f["n"] for f in found or []}, total))

    def log_odds(self, names: DataFrame) -> DataFrame:
        """(name, words, odds) of distinct ``names``; above 0 speaks for block.  A word counts each time it stands there."""
        split = stored(self.split(names), "splits")
        words = split.select("name", F.explode("words").alias("word")).filter(F.length("word") >= SHORTEST_WORD)
        odds = words.join(self.weights, "word").groupBy("name").agg(F.sum("weight").alias("odds"))
        return split.join(odds, "name", "left").select("name", "words", F.coalesce("odds", F.lit(0.0)).alias("odds"))


def weights(seen: DataFrame) -> DataFrame:
    """(word, weight): log odds of block against allow of each word, from its counts (word, allow, block) and the seed words."""
    kinds = (ALLOW, BLOCK)
    sums = seen.agg(*[F.sum(k).alias(k) for k in kinds]).first()
    seeds = {ALLOW: ALLOW_WORDS, BLOCK: BLOCK_WORDS}
    more = seen.sparkSession.createDataFrame([(w, 0, 0) for w in [*ALLOW_WORDS, *BLOCK_WORDS]], "word string, allow long, block long")
    seen = seen.unionByName(more).groupBy("word").agg(*[F.sum(k).alias(k) for k in kinds])
    share = {k: F.col(k) / F.lit(float(sums[k] or 1)) for k in kinds}
    mass = seen.select("word", *[
        # worth as much as what has been seen of either kind, so that rules cannot drown them
        (share[k] + F.when(F.col("word").isin(*seeds[k]), F.greatest(F.lit(SEED_SHARE), 4 * share[o])).otherwise(0.0)).alias(k)
        for k, o in (kinds, kinds[::-1])])
    mass = stored(mass, "mass")
    whole = mass.agg(*[F.sum(k).alias(k) for k in kinds]).first()
    # the unseen shares of all words add the same to both totals
    part = {k: F.col(k) / F.lit(whole[k]) + UNSEEN_SHARE for k in kinds}
    return mass.select("word", F.log(part[BLOCK] / part[ALLOW]).alias("weight"))


def fit(pages: DataFrame, rules: list[tuple[str, str]], url_column: str = "url") -> UrlModel:
    """Count words over all urls, and words by verdict over all hosts that rules without a path decide."""
    url = pages[url_column]
    host, path = host_of(url), path_of(url)
    _, verdict = rule_of(host, path, [r for r in rules if r[1].endswith("/") and r[1].count("/") == 1])
    names = pages.select(_names(host, path).alias("names"), host.alias("host"), verdict.alias("verdict"))
    seeds = pages.sparkSession.createDataFrame([(w, SEED_COUNT) for w in [*BLOCK_WORDS, *ALLOW_WORDS]], "word string, n long")
    found = names.select(F.explode("names").alias("word")).groupBy("word").agg(F.count("*").alias("n"))
    counts = stored(found.unionByName(seeds).groupBy("word").agg(F.sum("n").alias("n")), "counts")
    words = stored(vocabulary(counts), "words")
    total = words.agg(F.sum(F.col("n") + 1)).first()[0] + 1
    model = UrlModel(words, total, None, math.log(0.2 / 0.8))
    decided = names.filter(F.col("verdict").isNotNull()).select("host", "verdict", F.explode("names").alias("name")).distinct()
    by_name = stored(decided.groupBy("name").agg(
        *[F.sum(F.when(F.col("verdict") == k, 1).otherwise(0)).alias(k) for k in (ALLOW, BLOCK)]), "evidence")
    split = model.split(by_name.select("name")).select("name", F.explode("words").alias("word"))
    seen = by_name.join(split.filter(F.length("word") >= SHORTEST_WORD), "name")
    seen = seen.groupBy("word").agg(*[F.sum(k).alias(k) for k in (ALLOW, BLOCK)])
    model.weights = stored(weights(stored(seen, "seen")), "weights")
    return model


def judge(
    pages: DataFrame, model: UrlModel, rules: list[tuple[str, str]], id_column: str = "page_id", url_column: str = "url"
) -> DataFrame:
    """Per row host, path, rule (null if none fits), verdict, log_odds and words (segmented, space-joined)."""

    url = pages[url_column]
    host, path = host_of(url), path_of(url)
    rule, verdict = rule_of(host, path, rules)
    rows = pages.select(
        pages[id_column].alias("id"), host.alias("host"), path.alias("path"), rule.alias("rule"),
        verdict.alias("verdict"), _names(host, path).alias("names"))
    rows = stored(rows.withColumn("row", F.monotonically_increasing_id()), "urls")  # the row numbers hold from here on
    names = rows.select("row", F.posexplode("names").alias("at", "name"))
    known = stored(model.log_odds(names.select("name").distinct()), "names")
    of_row = names.join(known, "name").groupBy("row").agg(  # the names of one url
        F.sum("odds").alias("odds"), F.array_sort(F.collect_list(F.struct("at", "words"))).alias("split"))
    odds = F.lit(model.prior) + F.coalesce("odds", F.lit(0.0))
    words = F.flatten(F.transform(F.coalesce("split", F.array()), lambda x: x["words"]))
    return rows.join(of_row, "row", "left").select(
        F.col("id").alias(id_column), "host", "path", "rule",
        F.coalesce("verdict", F.when(odds > 0, BLOCK).otherwise(ALLOW)).alias("verdict"),
        odds.alias("log_odds"), F.array_join(words, " ").alias("words"))
