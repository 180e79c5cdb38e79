import math
import random
import re
from collections import Counter

from pyspark.sql import functions as F

from trolley.llm import url_filter
from trolley.llm.queries import URL_RULES
from trolley.llm.url_filter import fewest, fit, judge, viterbi

URLS = [
    None, "", "nothing", "http://", "HTTPS://User.EXAMPLE.com?q=://a/b", "a://b://C.net/fr/x#y", "http://www.example.com/en/x",
    "http://m.www.example.com/en/x", "http://example.com/en", "http://example.com/en/", "http://xexample.com/en/1",
    "http://site.net/es/1?x", "http://site.net/esp", "http://net/fr/", "http://cheappills.example.org/1",
    "http://free-bets.example.org/en", "http://universitylibrary.example.org/about", "http://cheappills.example.org/1",
    "http://x.org/a\nb?c", "http://" + "a" * 5000 + ".org/", "http://x.org/" + "xyzabc" * 2000,
]


def rule_by_hand(host, path):
    best = None
    for verdict, text in URL_RULES:
        h, p = text.split("/", 1)
        if (host == h or host.endswith("." + h)) and path.startswith("/" + p) and (best is None or len(text) > len(best[1])):
            best = (verdict, text)
    return best


def parts_by_hand(url):
    if not url or "://" not in url:
        return "", ""
    rest = url.split("://", 1)[1]
    end = min([rest.find(c) for c in "/?#" if c in rest] or [len(rest)])
    host, rest = rest[:end], rest[end:]
    stop = min([rest.find(c) for c in "?#" if c in rest] or [len(rest)])
    return "".join(c.lower() if c.isascii() else c for c in host), rest[:stop]


def test_rules_and_verdicts(spark):
    rows = [(k, u, "clash", "clash") for k, u in enumerate(URLS)]
    pages = spark.createDataFrame(rows, "page_id long, url string, host string, rule string").withColumn("id", F.lit(0))
    found = {r.page_id: r for r in judge(pages, fit(pages, URL_RULES), URL_RULES).collect()}
    assert len(found) == len(URLS)
    for k, url in enumerate(URLS):
        host, path = parts_by_hand(url)
        assert (found[k].host, found[k].path) == (host, path)
        rule = rule_by_hand(host, path)
        assert found[k].rule == (rule and rule[1])
        if rule:
            assert found[k].verdict == rule[0]
    by_model = {URLS[k]: r.verdict for k, r in found.items() if r.rule is None}
    assert by_model["http://cheappills.example.org/1"] == by_model["http://free-bets.example.org/en"] == "block"
    assert by_model["http://universitylibrary.example.org/about"] == by_model[None] == by_model["nothing"] == "allow"
    assert judge(pages.limit(0), fit(pages.limit(0), URL_RULES), URL_RULES).collect() == []


def splits(name):
    yield [name]
    for k in range(1, len(name)):
        yield from ([name[:k], *rest] for rest in splits(name[k:]))


def cost(words, counts, total):
    return sum(math.log(total / (counts[w] + 1)) if w in counts else math.log(total) + 2.5 * len(w) for w in words)


def test_viterbi_equals_trying_all_splits():
    counts = {"cheap": 40, "pills": 30, "pill": 35, "s": 2, "che": 5, "ap": 4, "cheappi": 1}
    total = sum(counts.values()) + len(counts) + 1
    for name in ["cheappills", "pillscheap", "xcheapx", "sss", "a"]:
        best = min(cost(w, counts, total) for w in splits(name))
        assert math.isclose(cost(viterbi(name, counts, total), counts, total), best)
        whole = [w for w in splits(name) if all(x in counts for x in w)]
        assert len(fewest(name, set(counts)) or []) == min(map(len, whole), default=0)
    assert viterbi("cheappills", counts, total) == ["cheap", "pills"]


def plain_words(names):
    """Words and counts, in plain Python."""
    counts = Counter(names)
    for w in [*url_filter.BLOCK_WORDS, *url_filter.ALLOW_WORDS]:
        counts[w] += url_filter.SEED_COUNT

    def parts(name, words):
        return fewest(name, {w for w in words if w != name and len(w) >= url_filter.SHORTEST_WORD and counts[w] >= counts[name]})

    compounds = {w for w in counts if parts(w, counts)}
    out = Counter({w: n for w, n in counts.items() if w not in compounds})
    for w in compounds:
        out.update({p: k * counts[w] for p, k in Counter(parts(w, set(counts) - compounds)).items()})
    return out


def test_model_equals_plain_python(spark):
    random.seed(4)
    stems = ["garden", "river", "stone", "bet", "free", "win", "news", "ab", "x"]
    names = ["".join(random.choices(stems, k=random.randint(1, 3))) for _ in range(120)]
    rules = [("allow", "com/"), ("block", "biz/")]
    urls = [f"http://{n}.{random.choice(['com', 'biz', 'xy'])}/{random.choice(names)}" for n in names] * 2
    pages = spark.createDataFrame(list(enumerate(urls)), "page_id long, url string")
    model = fit(pages, rules)
    host_names = [re.findall("[a-z]+", u[7:]) for u in urls]
    host_names = [[x for x in n if x not in url_filter.PLAIN_LABELS] for n in host_names]
    words = plain_words(x for n in host_names for x in n)
    assert {r.word: r.n for r in model.words.collect()} == dict(words)
    total = sum(words.values()) + len(words) + 1
    assert model.total == total
    seen = {"allow": Counter(), "block": Counter()}
    for host, verdict, name in {(u[7:].split("/")[0], {"com": "allow", "biz": "block"}[u[7:].split("/")[0][-3:]], x)
                                for u, n in zip(urls, host_names) if not u[7:].split("/")[0].endswith("xy") for x in n}:
        seen[verdict].update(w for w in viterbi(name, words, total) if len(w) >= url_filter.SHORTEST_WORD)
    share = {k: {w: n / c.total() for w, n in c.items()} for k, c in seen.items()}
    mass = {k: dict(t) for k, t in share.items()}
    for k, other, seeds in (("block", "allow", url_filter.BLOCK_WORDS), ("allow", "block", url_filter.ALLOW_WORDS)):
        for w in seeds:
            mass[k][w] = mass[k].get(w, 0) + max(url_filter.SEED_SHARE, 4 * share[other].get(w, 0))
    want = {}
    for w in mass["allow"].keys() | mass["block"].keys():
        b, a = (mass[k].get(w, 0) / sum(mass[k].values()) + url_filter.UNSEEN_SHARE for k in ("block", "allow"))
        want[w] = math.log(b / a)
    found = {r.word: r.weight for r in model.weights.collect()}
    assert found.keys() == want.keys() and all(math.isclose(found[w], want[w], abs_tol=1e-9) for w in want)
    for r in judge(pages, model, rules).collect():
        split = [w for x in host_names[r.page_id] for w in viterbi(x, words, total)]
        odds = math.log(0.25) + sum(want.get(w, 0) for w in split if len(w) >= url_filter.SHORTEST_WORD)
        assert r.words == " ".join(split) and math.isclose(r.log_odds, odds, abs_tol=1e-9)
        assert r.verdict == {"com": "allow", "biz": "block"}.get(r.host[-3:], "block" if odds > 0 else "allow")


def test_weights_do_not_depend_on_the_amount_of_evidence(spark):
    once = {"garden": 3, "river": 1, "free": 2, "common": 94}
    found = []
    for times in (1, 10**6):
        seen = spark.createDataFrame([(w, n * times, 0) for w, n in once.items()], "word string, allow long, block long")
        found.append({r.word: r.weight for r in url_filter.weights(seen).collect()})
    assert found[0].keys() == found[1].keys() and all(math.isclose(found[0][w], found[1][w]) for w in found[0])
    assert all(found[1][w] < 0 for w in ("garden", "river", "common", "library")) and found[1]["free"] > 0


def test_verdicts_stay_when_the_table_grows_by_new_hosts(spark):
    ask = ["http://rareword.example.org/p", "http://gardenriver.example.org/p", "http://cheappills.example.org/1",
           "http://gardenlibrary.example.org/p", "http://cheapgarden.example.org/p"]
    asked = spark.createDataFrame(list(enumerate(ask)), "page_id long, url string")

    def verdicts(times):
        hosts = [f"{w}.n{chr(97 + k % 26)}{k}.com" for k in range(times) for w in ("garden", "river", "stone", "water")]
        rows = list(enumerate(f"http://{h}/garden" for h in [*hosts, "rareword.com"]))
        pages = spark.createDataFrame(rows, "page_id long, url string")
        return {r.page_id: r.verdict for r in judge(asked, fit(pages.unionByName(asked), URL_RULES), URL_RULES).collect()}

    few = verdicts(4)
    assert few == verdicts(4000) == {0: "allow", 1: "allow", 2: "block", 3: "allow", 4: few[4]}
