r"""Secret scan [native]: fixed patterns plus a randomness test battery.

Every step is a built-in expression; no Python runs on the executors.

*Positions.* ``regexp_extract_all`` gives the matches of a pattern and ``split``
the pieces between them; running sums of both lengths (code points) are the
starts and ends.

*Battery.* A candidate is a run of 20+ characters of the base64/url alphabets.
Its encoding is inferred (hex, base32 and base36 of one letter case, base62,
base64), each character becomes its index in that alphabet, and three tests ask whether the indexes look like
uniform draws: chi-squared over the alphabet, runs above/below the middle, and
lag-1 serial correlation, each as a z score with exact finite-length moments.

*Length-aware false-discovery control.* Two hypotheses are tested for each
candidate, and Benjamini-Hochberg at ``FDR`` runs for both in each length band
over all candidates of the corpus, counted by the integer part of -log10 p.

"This is written text" is tested by a likelihood ratio of uniform draws in the
inferred encoding against text: text changes between letter cases and digits at
a rate of at most ``TEXT_CHANGE`` (the encoding at its own rate), and holds each letter
as often as the likeliest language of ``LETTER_RATES`` (the encoding each of its
letters and digits equally often). Signs tell nothing. One over the ratio is a
valid p value under that model (Markov's inequality; a fifth of the ratio
counts, as one of five encodings is chosen), and gets smaller with length.

"These are uniform draws" is tested by the battery: the largest of the three z
scores has the p value 3 exp(-z^2 / 2), which bounds the normal tails of all three.

A candidate is reported where the first hypothesis is discovered false and the
second is not.

*Long texts.* Each stage of the battery is bound once and works on counts of the
alphabet's characters, so a token costs time in proportion to its length. Running
sums and maxima go through blocks of ``BLOCK`` finds.

Defined cases: null and empty texts have no spans; repeated rows are judged row
by row (and count as often in the bands); texts and tokens of any length are
read whole; an empty table gives an empty result; other columns are not read.
The spans of the method that overlap a base span are dropped, base spans stay.
"""

from __future__ import annotations

import math
from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, free_name, read_table, spans_digest, whole_text

KINDS = ("assign", "access", "hex", "random")
ASSIGN = r"""((?i:password|passwd|secret|token|api_?key))["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"(?<![0-9a-f])[0-9a-f]{24,}"
CANDIDATE = r"(?<![A-Za-z0-9+/_-])[A-Za-z0-9+/_-]{20,}={0,2}"
LONG_RUN = "[A-Za-z0-9+/_-]{20}"
#: Plain substrings, one of which each key of ASSIGN holds: a byte search that spares most texts the pattern.
KEY_PARTS = ("password", "passwd", "secret", "token", "api")

TEXT_CHANGE = 0.1
#: Letters a to z in English, German, French and Spanish text, a thousand letters (rounded, at least 5; fixed values).
LETTER_RATES = (
    (82, 15, 28, 43, 127, 22, 20, 61, 70, 5, 8, 40, 24, 67, 75, 19, 5, 60, 63, 91, 28, 10, 24, 5, 20, 5),
    (65, 19, 30, 51, 170, 17, 30, 48, 76, 5, 13, 34, 25, 98, 25, 8, 5, 70, 73, 62, 43, 8, 19, 5, 5, 11),
    (78, 9, 33, 37, 160, 11, 9, 7, 75, 6, 5, 55, 30, 71, 58, 28, 13, 67, 79, 72, 63, 18, 5, 5, 5, 5),
    (125, 18, 42, 58, 137, 7, 12, 8, 65, 5, 5, 52, 30, 68, 88, 25, 9, 68, 79, 46, 39, 11, 5, 5, 10, 5),
)
FDR = 0.01
BANDS = (32, 48, 80)
#: Bins of -log10 p that are told apart; smaller p values count as this one.
MAX_BIN = 60
#: Finds or characters that one step of a running sum or cut goes through.
BLOCK = 512

LETTERS = "abcdefghijklmnopqrstuvwxyz"
HEX_ALPHABET = "0123456789abcdef"
B32_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"
B36_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789"
B62_ALPHABET = "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789"
SPAN = "array<struct<s:int,k:int,e:int,kind:string>>"


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once."""
    return F.transform(F.array(value), body)[0]


def running(values: Column, op=lambda a, x: a + x) -> Column:
    """For each integer of an array the fold of those before it, from 0."""

    def grown(xs: Column, first: Column) -> Column:
        return F.aggregate(xs, F.array(first), lambda acc, x: F.concat(acc, F.array(op(F.element_at(acc, -1), x))))

    def made(v: Column) -> Column:
        blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(v) - 1) / BLOCK).cast("int")), lambda i: F.slice(v, i * BLOCK + 1, BLOCK))
        inside = lambda b, heads: F.flatten(F.transform(b, lambda x, i: F.slice(grown(x, heads[i]), 1, F.size(x))))
        return let(blocks, lambda b: let(grown(F.transform(b, lambda x: F.aggregate(x, F.lit(0), lambda a, y: op(a, y))), F.lit(0)), lambda heads: inside(b, heads)))

    return let(values, lambda v: F.when(F.size(v) == 0, F.array().cast("array<int>")).otherwise(made(v)))


def _located(text: Column, pattern: str, k: int, keep=None, group: int | None = None) -> Column:
    """array<struct<s,k,e,kind>> of the leftmost non-overlapping matches for which ``keep(match, group)`` holds."""
    found = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    inner = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else found
    gaps = F.transform(F.split(text, pattern, -1), F.char_length)
    rows = F.arrays_zip(gaps.alias("gap"), found.alias("hit"), inner.alias("part"))

    def spans(rows: Column) -> Column:
        before = running(F.transform(rows, lambda x: x["gap"] + F.coalesce(F.char_length(x["hit"]), F.lit(0))))
        placed = F.filter(F.arrays_zip(rows.alias("x"), before.alias("at")), lambda y: y["x"]["hit"].isNotNull() & (keep(y["x"]["hit"], y["x"]["part"]) if keep else F.lit(True)))
        span = lambda s, n: F.struct(s.alias("s"), F.lit(k).alias("k"), (s + n).alias("e"), F.lit(KINDS[k]).alias("kind"))
        return F.transform(placed, lambda y: span(y["at"] + y["x"]["gap"], F.char_length(y["x"]["hit"]))).cast(SPAN)

    return let(rows, spans)


def base_spans(text: Column) -> Column:
    none = F.array().cast(SPAN)
    low = F.lower(text)
    keyed = F.contains(low, F.lit(KEY_PARTS[0]))
    for part in KEY_PARTS[1:]:
        keyed = keyed | F.contains(low, F.lit(part))
    parts = [
        F.when(keyed, _located(text, ASSIGN, 0, lambda m, g: F.char_length(g) >= 6, 2)).otherwise(none),
        F.when(F.contains(text, F.lit("AKIA")), _located(text, ACCESS, 1, lambda m, g: F.char_length(m) >= 20)).otherwise(none),
        F.when(text.rlike(HEX), _located(text, HEX, 2)).otherwise(none),
    ]
    return F.array_sort(F.concat(*parts))


def _battery(token: Column) -> Column:
    """struct<n, bin, odd, mixed> of one candidate: length, floor(-log10 p) of "written text" and of "uniform draws", letters and digits."""
    change = lambda *sizes: 1 - sum((x / sum(sizes)) ** 2 for x in sizes)
    fold = lambda xs, f: F.aggregate(xs, F.lit(0.0), lambda a, x: a + f(x))
    rarity = [F.array(*[F.lit(-math.log10(p / sum(rates))) for p in rates]) for rates in LETTER_RATES]
    count = lambda t, c: (F.char_length(t) - F.char_length(F.replace(t, c))).cast("double")  # noqa: E731  c: one character
    total = lambda xs, of: F.aggregate(F.arrays_zip(xs.alias("n"), of.alias("w")), F.lit(0.0), lambda a, x: a + x["n"] * x["w"])

    def encoded(t: Column) -> Column:
        hexed, b32, b36 = t.rlike("^(?:[0-9a-f]+|[0-9A-F]+)$"), t.rlike("^(?:[A-Z2-7]+|[a-z2-7]+)$"), t.rlike("^(?:[A-Z0-9]+|[a-z0-9]+)$")
        by = lambda of: F.when(hexed, of(6, 10, change(6, 10))).when(b32, of(26, 6, change(26, 6))).when(b36, of(26, 10, change(26, 10))).otherwise(of(26, 10, change(26, 26, 10)))
        wide = F.when(~t.rlike("[+/_-]"), B62_ALPHABET).when(t.rlike("[_-]"), B62_ALPHABET + "-_").otherwise(B62_ALPHABET + "+/")
        # classes of characters: a, A, 0 and - for signs
        sorts = F.translate(t, LETTERS + LETTERS.upper() + "0123456789+/_-", "a" * 26 + "A" * 26 + "0" * 10 + "-" * 4)
        return F.struct(
            F.when(hexed, F.lower(t)).when(b36, F.upper(t)).otherwise(t).alias("text"), F.when(hexed, HEX_ALPHABET).when(b32, B32_ALPHABET).when(b36, B36_ALPHABET).otherwise(wide).alias("alphabet"),
            sorts.alias("sorts"), F.transform(F.split(F.lit(LETTERS), ""), lambda c: count(F.lower(t), c)).alias("letters"), count(sorts, F.lit("0")).alias("digits"),
            by(lambda l, d, r: F.lit(math.log10(r / TEXT_CHANGE))).alias("move"), by(lambda l, d, r: F.lit(math.log10((1 - r) / (1 - TEXT_CHANGE)))).alias("stay"),
            by(lambda l, d, r: F.lit(math.log10(1 / l))).alias("letter"), by(lambda l, d, r: F.lit(math.log10(10 / d))).alias("digit"),
        )

    def counted(e: Column) -> Column:
        size = F.char_length(e["alphabet"])
        counts = F.transform(F.split(e["alphabet"], ""), lambda c: count(e["text"], c))
        places = F.transform(F.sequence(F.lit(0), size - 1), lambda i: i.cast("double"))
        half = F.floor(size / 2).cast("int")
        sides = F.call_function("translate", e["text"], e["alphabet"], F.concat(F.repeat(F.lit("L"), half), F.repeat(F.lit("H"), half)))
        at = F.transform(F.split(e["text"], ""), lambda c: F.instr(e["alphabet"], c).cast("double") - 1)
        products = let(at, lambda v: fold(F.zip_with(v, F.slice(v, 2, F.size(v)), lambda x, y: x * F.coalesce(y, F.lit(0.0))), lambda x: x))
        alike = F.char_length(F.regexp_replace(e["sorts"], "-", "")) - F.regexp_count(e["sorts"], F.lit("a+|A+|0+"))
        return F.struct(
            e.alias("e"), F.char_length(e["text"]).cast("double").alias("n"), size.cast("double").alias("k"), counts.alias("counts"), fold(counts, lambda c: c * c).alias("sq"),
            total(counts, places).alias("sx"), total(counts, F.transform(places, lambda i: i * i)).alias("sxx"), products.alias("sxy"),
            count(sides, F.lit("H")).alias("hi"), F.regexp_count(sides, F.lit("L+|H+")).cast("double").alias("runs"),
            alike.alias("stays"), F.regexp_count(e["sorts"], F.lit("(?<=a)[A0]|(?<=A)[a0]|(?<=0)[aA]")).alias("moves"), F.aggregate(e["letters"], F.lit(0.0), lambda a, x: a + x).alias("letters"),
        )

    def judged(v: Column) -> Column:
        n, k, e = v["n"], v["k"], v["e"]
        chi = (k / n * v["sq"] - n - (k - 1)) / F.sqrt(2 * (k - 1) * (n - 1) / n)
        mean = 1 + 2 * (n - v["hi"]) * v["hi"] / n
        runs = (v["runs"] - mean) / F.sqrt(F.greatest((mean - 1) * (mean - 2) / (n - 1), F.lit(1e-9)))
        var = F.greatest(n * v["sxx"] - v["sx"] * v["sx"], F.lit(1e-9))
        serial = ((n * v["sxy"] - v["sx"] * v["sx"]) / var + 1 / (n - 1)) / F.sqrt(n * n / ((n - 1) * (n - 1) * (n - 2)))
        z = F.greatest(F.abs(chi), F.abs(runs), F.abs(serial))
        rare = F.least(*[total(e["letters"], r) for r in rarity])
        ratio = v["moves"] * e["move"] + v["stays"] * e["stay"] + rare + v["letters"] * e["letter"] + e["digits"] * e["digit"] - math.log10(5)
        binned = lambda x: F.least(F.greatest(F.floor(x), F.lit(0)), F.lit(MAX_BIN)).cast("int")
        return F.struct(n.cast("int").alias("n"), binned(ratio).alias("bin"), binned(z * z / 2 / math.log(10) - math.log10(3)).alias("odd"), ((v["letters"] > 0) & (e["digits"] > 0)).alias("mixed"))

    return let(F.regexp_replace(token, "=+$", ""), lambda t: let(encoded(t), lambda e: let(counted(e), judged)))


def band(n: Column) -> Column:
    out = F.lit(0)
    for i, b in enumerate(BANDS):
        out = F.when(n >= b, i + 1).otherwise(out)
    return out


def rejected_from(counts: dict[int, int], fdr: float) -> int | None:
    """Benjamini-Hochberg over bins of -log10 p: the least bin whose candidates are rejected."""
    total, above, out = sum(counts.values()), 0, None
    for k in range(MAX_BIN, 0, -1):
        above += counts.get(k, 0)
        if above and total * 10.0**-k <= fdr * above:
            out = k
    return out


def fit_thresholds(docs: DataFrame, fdr: float = FDR) -> dict[int, tuple[int, int]]:
    """For each length band the least bin discovered not to be text, and the least one discovered not to be uniform.

    What comes to the driver is one count for each (band, bin, bin): at most
    ``(len(BANDS) + 1) * (MAX_BIN + 1) ** 2`` rows.
    """
    tokens = F.regexp_extract_all(F.col("text"), F.lit(CANDIDATE), F.lit(0))
    text = doc_texts(docs).select("text").where(F.col("text").rlike(LONG_RUN))
    judged = text.select(F.explode(tokens).alias("t")).select(_battery(F.col("t")).alias("j"))
    rows = judged.groupBy(band(F.col("j.n")).alias("band"), F.col("j.bin").alias("bin"), F.col("j.odd").alias("odd")).count().collect()
    out: dict[int, tuple[int, int]] = {}
    for b in range(len(BANDS) + 1):
        text_bins, odd_bins = Counter(), Counter()
        for r in rows:
            if r["band"] == b:
                text_bins[r["bin"]] += r["count"]
                odd_bins[r["odd"]] += r["count"]
        if (k := rejected_from(text_bins, fdr)) is not None:
            out[b] = k, rejected_from(odd_bins, fdr) or MAX_BIN + 1
    return out


def random_spans(text: Column, thresholds: dict[int, tuple[int, int]]) -> Column:
    none = F.array().cast(SPAN)
    if not thresholds:
        return none

    def keep(token: Column, _: Column) -> Column:
        def found(j: Column) -> Column:
            here = band(j["n"])
            good = F.lit(False)
            for b, (text_bin, odd_bin) in thresholds.items():
                good = F.when(here == b, (j["bin"] >= text_bin) & (j["odd"] < odd_bin)).otherwise(good)
            return j["mixed"] & good

        return let(_battery(token), found)

    return F.when(text.rlike(LONG_RUN), _located(text, CANDIDATE, 3, keep)).otherwise(none)


def _apart_from(spans: Column, base: Column) -> Column:
    """The ``spans`` that overlap none of ``base``: at the end of each, no base span that began before has ended after its start."""
    ends = F.transform(base, lambda b: F.struct(b["s"].alias("at"), F.lit(1).alias("sort"), b["e"].alias("end"), b.alias("span")))
    asks = F.transform(spans, lambda r: F.struct(r["e"].alias("at"), F.lit(0).alias("sort"), F.lit(0).alias("end"), r.alias("span")))

    def kept(events: Column) -> Column:
        latest = running(F.transform(events, lambda x: x["end"]), F.greatest)
        return F.transform(F.filter(F.arrays_zip(events.alias("x"), latest.alias("end")), lambda y: (y["x"]["sort"] == 0) & (y["end"] <= y["x"]["span"]["s"])), lambda y: y["x"]["span"])

    return let(spans, lambda r: F.when(F.size(r) == 0, r).otherwise(let(F.array_sort(F.concat(ends, asks)), kept)))


def with_spans(docs: DataFrame, thresholds: dict[int, tuple[int, int]], text: str, base: str, spans: str) -> DataFrame:
    """Add ``base`` and ``spans`` (base and method, sorted) to documents whose whole text is in column ``text``."""
    added = _apart_from(random_spans(F.col(text), thresholds), F.col(base))
    return docs.withColumn(base, base_spans(F.col(text))).withColumn(spans, F.array_sort(F.concat(F.col(base), added)))


def scan(docs: DataFrame, thresholds: dict[int, tuple[int, int]] | None = None) -> DataFrame:
    """``doc_id, text, base, spans`` of every document; thresholds are fitted on the same documents unless given."""
    limits = fit_thresholds(docs) if thresholds is None else thresholds
    return with_spans(doc_texts(docs), limits, "text", "base", "spans")


def redact(text: Column, spans: Column, mark: str = "[SECRET]") -> Column:
    """The text with each maximal run of spans replaced by ``mark``."""

    def cut(pieces: Column, s: Column, e: Column) -> Column:
        """Characters ``s`` to ``e`` of a text in pieces of ``BLOCK``."""
        first = F.floor(s / BLOCK).cast("int")
        near = F.array_join(F.slice(pieces, first + 1, F.ceil(e / BLOCK).cast("int") - first), "")
        return F.when(e > s, F.substring(near, s - first * BLOCK + 1, e - s)).otherwise("")

    def rest(rows: Column, pieces: Column) -> Column:
        # a row stands for the text before its span, from where earlier spans end, and its mark
        fresh = F.filter(rows, lambda y: y["x"]["s"] >= y["end"])
        before = F.array_join(F.transform(fresh, lambda y: F.concat(cut(pieces, y["end"], y["x"]["s"]), F.lit(mark))), "")
        last = F.element_at(rows, -1)
        return F.concat(before, cut(pieces, F.greatest(last["end"], last["x"]["e"]), F.char_length(text)))

    rows = F.arrays_zip(spans.alias("x"), running(F.transform(spans, lambda x: x["e"]), F.greatest).alias("end"))
    pieces = F.regexp_extract_all(text, F.lit("(?s).{1,%d}" % BLOCK), F.lit(0))
    return F.when(F.size(spans) == 0, text).otherwise(let(rows, lambda r: let(pieces, lambda p: rest(r, p))))


def redact_documents(docs: DataFrame) -> DataFrame:
    """The documents, same columns and rows, secrets replaced in ``text``; a null text stays null."""
    limits = fit_thresholds(docs)
    text, base, spans = (free_name(docs, f"secret_{x}") for x in ("text", "base", "spans"))
    found = with_spans(docs.withColumn(text, whole_text()), limits, text, base, spans)
    return found.select(*[F.when(F.size(spans) == 0, F.col("text")).otherwise(redact(F.col(text), F.col(spans))).alias(c) if c.lower() == "text" else F.col(f"`{c}`") for c in docs.columns])


def op1_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """doc_id, counts of base spans by kind, their digest, all spans as text, over every document."""
    found = scan(read_table(spark, sf_dir, "documents"))
    count = lambda k: F.size(F.filter("base", lambda x: x["k"] == k)).cast("long").alias(f"n_{KINDS[k]}")
    return found.select(
        "doc_id", count(0), count(1), count(2),
        F.sha2(spans_digest(F.col("base")).cast("binary"), 256).alias("base_sha256"),
        spans_digest(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["k"] == 3)).cast("long").alias("n_random"),
    )
