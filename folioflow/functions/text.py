"""Text functions: Column in, Column out, all of them built-in expressions.

Python's ``re`` and ``str`` rules decide in the compared results, so patterns
carry the flags that make Java agree: (?U) for Unicode classes, (?d) so that "."
stops at "\\n" alone. Null in, null out, unless said otherwise.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab

#: Line ends of ``str.splitlines``.
LINE_END = "\r\n|[\n\r\x0b\x0c\x1c-\x1e\x85\u2028\u2029]"


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body(value)`` with the value computed once."""
    return F.transform(F.array(value), body)[0]


def strip(c: Column, chars: str | None = None) -> Column:
    """``str.strip``: Unicode white space, or the given characters."""
    if chars is None:
        return F.regexp_replace(c, r"(?U)^[\s\x1c-\x1f]+|[\s\x1c-\x1f]+$", "")
    return F.trim(c, F.lit(chars))


def lines(text: Column) -> Column:
    """``str.splitlines``: no empty last line."""
    return let(F.split(text, LINE_END, -1), lambda a: F.when(F.element_at(a, -1) == "", F.slice(a, 1, F.size(a) - 1)).otherwise(a))


def words(text: Column) -> Column:
    """``str.split()``: runs of non-blanks."""
    return F.regexp_extract_all(text, F.lit(r"(?U)\S+"), F.lit(0))


def tokens(text: Column) -> Column:
    """Lower-case tokens of three or more characters that are no stopwords, in order, repeats kept."""
    found = F.regexp_extract_all(F.lower(text), F.lit(vocab.TOKEN), F.lit(0))
    return F.filter(found, lambda t: (F.length(t) > 2) & ~t.isin(vocab.STOPWORDS))


def ngrams(text: Column, n: int = 2) -> Column:
    """Lower-case word n-grams; none if there are fewer than n words."""
    return let(words(F.lower(text)), lambda w: F.when(F.size(w) >= n, F.transform(F.sequence(F.lit(1), F.greatest(F.size(w) - n + 1, F.lit(1))), lambda i: F.array_join(F.slice(w, i, n), " "))).otherwise(F.array().cast("array<string>")))


def metrics(text: Column) -> Column:
    """Quantities of a text: what each pattern's group holds (often the empty string), distinct in order."""
    return F.array_distinct(F.concat(*[F.regexp_extract_all(text, F.lit(f"(?idU){p}"), F.lit(g)) for p, g in vocab.METRICS]))


def confidence(found: Column) -> Column:
    """From the metrics column: two or more high, one medium, none low."""
    return F.when(F.size(found) >= 2, "high").when(F.size(found) == 1, "medium").otherwise("low")


def tools(text: Column) -> Column:
    """Names of the tool vocabulary that occur as substrings, in the vocabulary's order."""
    names = F.array(*[F.struct(F.lit(t).alias("name"), F.lit(t.lower()).alias("low")) for t in vocab.TOOLS])
    return let(F.lower(text), lambda low: F.transform(F.filter(names, lambda t: F.contains(low, t["low"])), lambda t: t["name"]))


def occurrences(text: Column, word: Column) -> Column:
    """Non-overlapping occurrences of a word."""
    return ((F.length(text) - F.length(F.replace(text, word, F.lit("")))) / F.length(word)).cast("int")


def date_range(text: Column) -> Column:
    """struct<start, end>: split at the first separator of the list that occurs anywhere, once."""
    out = F.struct(strip(text).alias("start"), F.lit("").alias("end"))
    for sep in reversed(vocab.DATE_SEPARATORS):
        at = F.instr(text, sep)
        cut = F.struct(strip(F.substring(text, F.lit(1), at - 1)).alias("start"), strip(F.substring(text, at + len(sep), F.length(text))).alias("end"))
        out = F.when(F.contains(text, F.lit(sep)), cut).otherwise(out)
    return out


def _chain(text: Column, steps: list[tuple[str, str]]) -> Column:
    for pattern, to in steps:
        text = F.regexp_replace(text, pattern, to)
    return text


def clean_latex(text: Column) -> Column:
    """Readable text of LaTeX source: formatting unwrapped, commands dropped, blanks collapsed."""
    out = _chain(text, vocab.LATEX_CLEAN)
    for old, new in vocab.LATEX_MARKS_READ:
        out = F.replace(out, F.lit(old), F.lit(new))
    return strip(F.regexp_replace(out, r"(?U)[\s\x1c-\x1f]+", " "))


def escape_latex(text: Column) -> Column:
    """LaTeX specials escaped in one pass, so nothing is escaped twice: a special is a piece of its own, what lies between is one."""
    table = F.create_map(*[F.lit(x) for kv in vocab.LATEX_ESCAPES.items() for x in kv])
    pieces = F.transform(F.regexp_extract_all(text, F.lit(r"[&%$#_{}~^\\]|[^&%$#_{}~^\\]+"), F.lit(0)), lambda c: F.coalesce(F.try_element_at(table, c), c))
    return F.when(text.rlike(r"[&%$#_{}~^\\]"), F.array_join(pieces, "")).otherwise(text)


def apply_ot1(text: Column) -> Column:
    for a, b in vocab.OT1:
        text = F.replace(text, F.lit(a), F.lit(b))
    return text


def normalise_ot1_lines(text: Column) -> Column:
    """Lines that are a lone glyph go; a glyph that opens a line is its bullet."""
    kept = F.filter(lines(text), lambda x: ~x.rlike(r"(?U)^(ffi|j)\s*$"))
    return F.array_join(F.transform(kept, lambda x: F.regexp_replace(x, r"(?U)^(ffi|j)\s+", "• ")), "\n")


def merge_split_years(text: Column) -> Column:
    """``202 4`` is 2024: a digit that extraction has split off a two- or three-digit number joins it."""
    return F.regexp_replace(text, r"(?U)(?<!\d)(\d{2,3}) (\d)(?!\d)", "$1$2")


def dash_for_t(text: Column) -> Column:
    """``2024 t Present`` is a range."""
    return F.regexp_replace(text, rf"(?iU)(\d{{4}})\s+t\s+({vocab.MONTH}|Present|Current|Now)", "$1 – $2")


def title_label(name: Column) -> Column:
    return F.initcap(F.replace(name, F.lit("_"), F.lit(" ")))


def display_url(url: Column) -> Column:
    return F.replace(url, F.lit("https://"), F.lit(""))


def month_key(ts: Column) -> Column:
    return F.date_format(ts, "yyyy-MM")


def split_list(text: Column, pattern: str = "[,;]") -> Column:
    return F.filter(F.transform(F.split(text, pattern), lambda x: strip(x)), lambda x: x != "")


def detect_format(text: Column) -> Column:
    """latex, markdown or blob, by content; LaTeX marks win."""
    latex = F.lit(False)
    for mark in vocab.LATEX_MARKS:
        latex = latex | F.contains(text, F.lit(mark))
    return F.when(latex, "latex").when(text.rlike(r"(?mdU)^#{1,3}\s+\w"), "markdown").otherwise("blob")


def format_of_extension(path: Column) -> Column:
    table = F.create_map(*[F.lit(x) for kv in vocab.EXTENSIONS.items() for x in kv])
    return F.coalesce(F.try_element_at(table, F.lower(F.regexp_extract(path, r"\.([^./]+)$", 1))), F.lit("blob"))


def is_bullet(line: Column) -> Column:
    return line.rlike(r"(?U)^(?:[•\-–*·○▪]|(?:x|ffi|j)\s+\S)")


def is_title_like(line: Column) -> Column:
    return line.rlike(r"^\p{Lu}") & (F.size(words(line)) <= 8) & (F.length(line) <= 80) & ~is_bullet(line)


def has_date(line: Column) -> Column:
    return line.rlike(f"(?iuU){vocab.DATE}")


def section_of(line: Column) -> Column:
    """Section that a header line opens, or null: an alias, else a short mostly alphabetic line that holds one."""
    clean = strip(F.rtrim(F.lower(strip(line)), F.lit(":")))

    def found(c: Column) -> Column:
        exact, inside = F.lit(None).cast("string"), F.lit(None).cast("string")
        for name, aliases in reversed(vocab.SECTIONS.items()):
            exact = F.when(c.isin(aliases), name).otherwise(exact)
            holds = F.contains(c, F.lit(aliases[0]))
            for a in aliases[1:]:
                holds = holds | F.contains(c, F.lit(a))
            inside = F.when(holds, name).otherwise(inside)
        plain = F.length(F.regexp_replace(c, r"[^\p{L} ]", "")) / F.greatest(F.length(c), F.lit(1))
        return F.coalesce(exact, F.when((F.length(c) < 50) & (plain > 0.85), inside))

    return let(clean, found)


def word_limit(text: Column, limit: int = 20) -> Column:
    """At most ``limit`` words: back to a full stop within three words, else "..."."""

    def cut(w: Column) -> Column:
        out = F.concat(F.array_join(F.slice(w, 1, limit), " "), F.lit("..."))
        for back in (2, 1, 0):
            k = limit - back
            out = F.when(F.try_element_at(w, F.lit(k)).rlike("[.!?;]$"), F.array_join(F.slice(w, 1, k), " ")).otherwise(out)
        return F.when(F.size(w) <= limit, text).otherwise(out)

    return let(words(text), cut)


#: Verbs that open a bullet with an action. Chosen here, not given by any contract.
ACTION_VERBS = "built led designed created launched reduced increased improved migrated automated delivered developed implemented managed optimized owned shipped drove cut scaled architected".split()


def star_score(text: Column, found: Column) -> Column:
    """struct<has_action, has_result, word_count, star_score, passes, violations>; at most 20 words pass."""
    action = F.lower(F.regexp_extract(text, r"^\W*(\w+)", 1)).isin(ACTION_VERBS)
    result = F.size(found) > 0
    n = F.size(words(text))
    score = action.cast("int") + result.cast("int")
    violations = F.filter(F.array(F.when(~action, "missing action verb"), F.when(~result, "missing result metric"), F.when(n > 20, "too long")), lambda v: v.isNotNull())
    return F.struct(action.alias("has_action"), result.alias("has_result"), n.alias("word_count"), score.alias("star_score"), ((score == 2) & (n <= 20)).alias("passes"), violations.alias("violations"))


def bullet_quality(found: Column, named: Column, sure: Column) -> Column:
    """0 to 1 from metrics, tools and confidence. The weights (0.4, 0.2, 0.4) are this engine's."""
    level = F.when(sure == "high", 1.0).when(sure == "medium", 0.5).otherwise(0.0)
    return F.bround(0.4 * F.least(F.size(found), F.lit(2)) / 2 + 0.2 * F.least(F.size(named), F.lit(2)) / 2 + 0.4 * level, 4)


def enforce_star(bullets: Column, found: Callable[[Column], Column] | None = None) -> Column:
    """Bullets (an array of structs with ``text``) with ``star_score, star_passes, star_violations`` added; other fields stay."""

    def add(b: Column) -> Column:
        return let(star_score(b["text"], (found or metrics)(b["text"])), lambda s: b.withField("star_score", s["star_score"]).withField("star_passes", s["passes"]).withField("star_violations", s["violations"]))

    return F.transform(bullets, add)


def sentence_limit(text: Column, limit: int = 250) -> Column:
    """At most ``limit`` words, back to the end of the last whole sentence among them; without one, "..." follows."""

    def cut(w: Column) -> Column:
        head = F.slice(w, 1, limit)
        last = F.aggregate(F.transform(head, lambda x, i: F.when(x.rlike("[.!?]$"), i + 1).otherwise(0)), F.lit(0), lambda a, x: F.greatest(a, x))
        short = let(last, lambda n: F.when(n > 0, F.array_join(F.slice(head, 1, n), " ")).otherwise(F.concat(F.array_join(head, " "), F.lit("..."))))
        return F.when(F.size(w) <= limit, text).otherwise(short)

    return let(words(text), cut)


def path_format(argument: Column) -> Column:
    """struct<path, format> of ``PATH:FORMAT``: split at the last colon; without one the format is "blob"."""
    at = F.length(argument) - F.length(F.substring_index(argument, ":", -1))
    return F.struct(F.when(at > 0, F.substring(argument, F.lit(1), at - 1)).otherwise(argument).alias("path"), F.when(at > 0, F.substring_index(argument, ":", -1)).otherwise("blob").alias("format"))
