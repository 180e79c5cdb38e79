"""Secret scans in DataFrame functions alone: fixed patterns, and a randomness test battery.

Three fixed patterns give the base spans.  Beyond them every long run of code characters with a digit is a
candidate.  Its encoding is inferred from the characters it uses, and the battery tests it over that
alphabet: Pearson's chi-squared for uniform symbols, the runs of the lower and upper half of the alphabet, and
the serial correlation of neighbours.  A candidate that fails one of the three is no random string.  One that
passes all must still stand out from text: the p-value of its changes between small letters, capitals and
digits, as many as that in words and names of its length, goes through the Benjamini-Hochberg procedure,
separately for each band of lengths and over the candidates of all documents.

Spans count code points, the end excluded.  Null and empty texts have none.  Repeated rows count as candidates
each time and get equal results; empty tables give empty results; other columns are passed on or not read.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

# The base patterns, with the least length of the whole match or of the value.
_EITHER = {w: "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token")}
ASSIGN = (
    f"(?:{'|'.join(_EITHER.values())}|[Aa][Pp][Ii]_?[Kk][Ee][Yy])"
    "[\"']?\\x20*[:=]\\x20*[\"']?([A-Za-z0-9+/_.=-]+)"
)
ASSIGN_VALUE = 6
# a run that is too short holds no longer one, so the least length can stand in these two patterns
ACCESS = "AKIA[A-Z0-9]{16,}"
HEX = "[0-9a-f]{24,}"
KINDS = ["assign", "access", "hex", "random"]

CANDIDATE = "(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])[A-Za-z0-9+/_-]{20,}"
#: Least lengths of the bands within which false discoveries are controlled.
BANDS = [20, 24, 32, 48, 64, 128]
#: Share of false discoveries accepted among the candidates taken for text-unlike.
FALSE_SHARE = 0.01
#: Two-sided normal quantile beyond which a test of the battery rejects randomness (three tests, 1 % in all).
REJECT_Z = 2.94
#: Words and names of n characters change their character class 1 + n / WORD_SPAN times on average.
WORD_SPAN = 8.0
_BINS_PER_DECADE = 4

_LOWER = "abcdefghijklmnopqrstuvwxyz"
_DIGITS = "0123456789"
_ENCODINGS = {
    "hex": _DIGITS + "abcdef",
    "HEX": _DIGITS + "ABCDEF",
    "base32": _LOWER.upper() + "234567",
    "base36": _DIGITS + _LOWER,
    "base64": _LOWER.upper() + _LOWER + _DIGITS + "+/",
}

_BLOCK = 256


def _running(lengths: Column) -> Column:
    """Sums of the first 0, 1, ... entries; in blocks, so that long lists take no quadratic time."""
    def grow(sums: Column, x: Column) -> Column:
        return F.concat(sums, F.array(F.element_at(sums, -1) + x))

    zero = F.array(F.lit(0))
    starts = F.transform(F.sequence(F.lit(0), F.floor(F.size(lengths) / _BLOCK).cast("int")), lambda b: b * _BLOCK + 1)
    blocks = F.transform(starts, lambda s: F.aggregate(F.slice(lengths, s, _BLOCK), zero, grow))
    offsets = F.aggregate(F.transform(blocks, lambda b: F.element_at(b, -1)), zero, grow)
    shifted = F.zip_with(blocks, F.slice(offsets, F.lit(1), F.size(blocks)), lambda b, o: F.transform(
        F.slice(b, F.lit(1), F.size(b) - 1), lambda v: v + o))
    return F.flatten(shifted)


def _matches(text: Column, pattern: str) -> Column:
    """Leftmost non-overlapping matches as structs (start, match), null where there are none."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    gaps = F.slice(F.split(text, pattern, -1), F.lit(1), F.size(found))
    both = F.zip_with(gaps, found, lambda g, m: F.length(g) + F.length(m))
    ends = _running(F.concat(both, F.array(F.lit(0))))  # where match i - 1 ended
    starts = F.zip_with(F.slice(ends, F.lit(1), F.size(found)), gaps, lambda e, g: e + F.length(g))
    pairs = F.zip_with(starts, found, lambda s, m: F.struct(s.alias("start"), m.alias("match")))
    return F.when(text.rlike(pattern), pairs)


def _spans(matches: Column, kind: str) -> Column:
    rank = KINDS.index(kind)
    spans = F.transform(matches, lambda m: F.struct(
        m["start"].alias("start"), F.lit(rank).alias("rank"), (m["start"] + F.length(m["match"])).alias("end")))
    return F.coalesce(spans, F.array().cast("array<struct<start:int,rank:int,end:int>>"))


def base_spans(text: Column) -> list[Column]:
    """Spans of each base pattern: structs (start, rank, end), in order."""
    assigned = F.filter(
        _matches(text, ASSIGN), lambda m: F.length(F.regexp_extract(m["match"], ASSIGN, 1)) >= ASSIGN_VALUE)
    access = F.when(F.contains(text, F.lit("AKIA")), _matches(text, ACCESS))
    return [_spans(assigned, "assign"), _spans(access, "access"), _spans(_matches(text, HEX), "hex")]


def _tail(z: Column) -> Column:
    """About the normal upper tail beyond z >= 0 (a published exponential approximation); 1/2 below 0."""
    z = F.greatest(z, F.lit(0.0))
    return 0.5 * F.exp(-0.717 * z - 0.416 * z * z)


def _alphabet(token: Column) -> Column:
    """The alphabet of the narrowest encoding that fits; null where letters or digits are missing."""
    plain = F.translate(token, "_-", "/+")
    chosen = F.coalesce(*[
        F.when(F.length(F.translate(plain, letters, "")) == 0, F.lit(letters)) for letters in _ENCODINGS.values()
    ])
    return F.when(token.rlike("[0-9]") & token.rlike("[A-Za-z]"), chosen)


def _passes_battery(token: Column, alphabet: Column) -> Column:
    """Whether none of the three tests rejects random symbols of the alphabet."""
    plain = F.translate(token, "_-", "/+")
    n = F.length(token).cast("double")
    k = F.length(alphabet).cast("double")
    squares = F.aggregate(
        F.transform(F.split(alphabet, ""), lambda a: (n - F.length(F.replace(plain, a, F.lit(""))))),
        F.lit(0.0), lambda s, c: s + c * c)
    chi = squares * k / n - n
    chi_z = (chi - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)

    at = F.transform(F.split(plain, ""), lambda c: F.instr(alphabet, c).cast("double"))
    mean, spread = (k + 1) / 2, (k * k - 1) / 12
    products = F.zip_with(at, F.slice(at, F.lit(2), F.size(at)), lambda a, b: (a - mean) * (b - mean))
    serial = F.aggregate(products, F.lit(0.0), lambda s, x: s + F.coalesce(x, F.lit(0.0)))
    serial_z = serial / (spread * F.sqrt(n - 1))

    halves = F.array_join(F.transform(at, lambda a: F.when(a > mean, "1").otherwise("0")), "")
    changes = sum((n - F.length(F.replace(halves, F.lit(p), F.lit("")))) / 2 for p in ("01", "10"))
    ones = n - F.length(F.replace(halves, F.lit("1"), F.lit("")))
    expected = 2 * ones * (n - ones) / n
    deviation = F.sqrt(F.greatest(expected * (expected - 1) / (n - 1), F.lit(1e-9)))
    runs_z = (changes - expected) / deviation
    return (F.abs(chi_z) < REJECT_Z) & (F.abs(serial_z) < REJECT_Z) & (F.abs(runs_z) < REJECT_Z)


def _text_bin(token: Column) -> Column:
    """Decimal order, in fractions, of the p-value of the token's class changes among words and names."""
    classes = F.regexp_replace(F.regexp_replace(F.regexp_replace(token, "[0-9]+", "0"), "[a-z]+", "1"), "[A-Z]+", "2")
    expected = 1 + F.length(token) / WORD_SPAN
    p = _tail((F.length(classes) - 0.5 - expected) / F.sqrt(expected))
    return F.least(F.floor(-F.log10(p) * _BINS_PER_DECADE), F.lit(400)).cast("int")


def _band(token: Column) -> Column:
    n = F.length(token)
    return sum((n >= least).cast("int") for least in BANDS[1:])


def candidates(text: Column) -> Column:
    """Tested candidates as structs (start, end, band, bin); bin is -1 where the battery rejects."""
    def test(m: Column) -> Column:
        token = m["match"]
        alphabet = _alphabet(token)
        random = alphabet.isNotNull() & F.coalesce(_passes_battery(token, alphabet), F.lit(False))
        return F.struct(
            m["start"].alias("start"), (m["start"] + F.length(token)).alias("end"),
            _band(token).alias("band"), F.when(random, _text_bin(token)).otherwise(-1).alias("bin"))

    return F.coalesce(
        F.transform(_matches(text, CANDIDATE), test),
        F.array().cast("array<struct<start:int,end:int,band:int,bin:int>>"))


def limits(tested: DataFrame, column: str = "tested") -> dict[int, int]:
    """Least bin of each band that the Benjamini-Hochberg procedure accepts.

    One counting aggregate over all candidates; the driver gets a row for each band and bin at most.
    """
    each = tested.select(F.explode(column).alias("c")).groupBy("c.band", "c.bin").count().collect()
    out = {}
    for band in {r["band"] for r in each}:
        own = {r["bin"]: r["count"] for r in each if r["band"] == band}
        total, found = sum(own.values()), 0
        for b in sorted((b for b in own if b >= 0), reverse=True):
            found += own[b]
            if 10 ** (-b / _BINS_PER_DECADE) * total <= FALSE_SHARE * found:
                out[band] = b
    return out


def _discovered(tested: Column, base: Column, accepted: dict[int, int]) -> Column:
    if not accepted:
        return F.array().cast("array<struct<start:int,rank:int,end:int>>")

    def keep(c: Column) -> Column:
        least = F.coalesce(*[F.when(c["band"] == band, F.lit(b)) for band, b in sorted(accepted.items())], F.lit(1 << 20))
        free = ~F.exists(base, lambda s: (s["start"] < c["end"]) & (c["start"] < s["end"]))
        return (c["bin"] >= least) & free

    rank = KINDS.index("random")
    return F.transform(F.filter(tested, keep), lambda c: F.struct(
        c["start"].alias("start"), F.lit(rank).alias("rank"), c["end"].alias("end")))


def _written(spans: Column) -> Column:
    names = F.array(*map(F.lit, KINDS))
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(
        ":", names[s["rank"]], s["start"].cast("string"), s["end"].cast("string"))), ",")


def measure(docs: DataFrame, columns: list[str], text_column: str = "text") -> DataFrame:
    """``columns`` and, from one pass over the whole texts, assign, access, hex and tested."""
    text = F.coalesce(docs[text_column], F.lit(""))
    assign, access, hexes = base_spans(text)
    return docs.select(
        *columns, assign.alias("assign"), access.alias("access"), hexes.alias("hex"), candidates(text).alias("tested"))


def scan(measured: DataFrame, id_column: str = "doc_id") -> DataFrame:
    """Counts and spans per row of a measured table (store it first: it is read twice).

    Columns: ``id_column``, n_assign, n_access, n_hex, n_random, base_sha256 and spans.
    """
    base = F.array_sort(F.concat("assign", "access", "hex"))
    accepted = limits(measured)
    with_base = measured.withColumn("base", base)
    with_random = with_base.withColumn("random", _discovered(F.col("tested"), F.col("base"), accepted))
    size = {k: F.size(k).cast("long").alias(f"n_{k}") for k in KINDS}
    return with_random.select(
        id_column, *size.values(), F.sha2(_written(F.col("base")), 256).alias("base_sha256"),
        _written(F.array_sort(F.concat("base", "random"))).alias("spans"))


def redact(docs: DataFrame, accepted: dict[int, int], text_column: str = "text", mask: str = "[SECRET]") -> DataFrame:
    """The rows with every span replaced by ``mask``, overlapping spans by one; other columns unchanged.

    ``accepted`` comes from ``limits`` over the same rows.
    """
    text = F.coalesce(docs[text_column], F.lit(""))
    base = F.concat(*base_spans(text))
    spans = F.array_sort(F.concat(base, _discovered(candidates(text), base, accepted)))

    def cut(state: Column, s: Column) -> Column:
        beyond = s["start"] >= state["at"]
        piece = F.concat(F.substring(text, state["at"] + 1, s["start"] - state["at"]), F.lit(mask))
        return F.struct(
            F.when(beyond, F.concat(state["out"], piece)).otherwise(state["out"]).alias("out"),
            F.greatest(state["at"], s["end"]).alias("at"))

    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    masked = F.aggregate(spans, start, cut, lambda s: F.concat(
        s["out"], F.substring(text, s["at"] + 1, F.length(text))))
    return docs.withColumn(text_column, F.when(docs[text_column].isNotNull(), F.when(F.size(spans) > 0, masked).otherwise(text)))
