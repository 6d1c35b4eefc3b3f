"""Ordered lines: reading with lookahead, headers of several lines, education entries, balanced brackets.

A parser that looks ahead and uses up lines is a jump from line to line. The
jumps are told by each line and its next two (windows), and folded only where
they could collide; so a long text is a few short folds, not one long one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab

#: The most lines that one header uses up.
MOST = 3


def with_read(rows: DataFrame, key: str, at: str, takes: str) -> DataFrame:
    """Add ``read``: whether a reader that starts at each key's first row, and goes on by ``takes`` rows (1 to ``MOST``), stops at the row.

    A row that no row before it can reach over is read in any case. Between such
    rows the reader's state is how many rows are still used up, folded over an
    array of a few numbers.
    """
    order = Window.partitionBy(key).orderBy(at)
    takes_ = F.least(F.greatest(F.coalesce(F.col(takes), F.lit(1)), F.lit(1)), F.lit(MOST)).cast("int")
    told = rows.withColumn("_takes", takes_)
    sure = F.lit(True)
    for back in range(1, MOST):
        sure = sure & (F.coalesce(F.lag("_takes", back).over(order), F.lit(1)) <= back)
    told = told.withColumn("_run", F.sum(F.when(sure, 1).otherwise(0)).over(order))
    run = Window.partitionBy(key, "_run").orderBy(at)
    whole = run.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    told = told.withColumn("_place", F.row_number().over(run)).withColumn("_all", F.collect_list("_takes").over(whole))
    used = F.aggregate(
        F.slice("_all", 1, F.col("_place") - 1),
        F.lit(0),
        lambda left, n: F.when(left > 0, left - 1).otherwise(n - 1),
    )
    return told.withColumn("read", used == 0).drop("_takes", "_run", "_place", "_all")


def role_headers(lines: DataFrame, key: str = "doc_id", at: str = "at", line: str = "line") -> DataFrame:
    """``key, at, shape, used, title, company, location, dates`` of every role header among the lines of experience.

    Shapes, the first that fits: ``dated`` (dates on the line; the next line is
    the company where none is named), ``two`` (a title, then a line with dates),
    ``three`` (title, company, dates). Lines that a header uses up are not read again. Blank
    lines and section headings are to be left out, and end a header's view.
    """
    order = Window.partitionBy(key).orderBy(at)
    flags = lines.withColumn("_s", X.strip(F.col(line)))
    flags = flags.withColumn("_dates", F.regexp_extract("_s", f"(?iuU)({vocab.DATE})", 1)).withColumn("_titled", X.is_title_like(F.col("_s"))).withColumn("_section", X.section_of(F.col("_s"))).withColumn("_bullet", X.is_bullet(F.col("_s")))
    for n in (1, 2):
        for c in ("_s", "_dates", "_titled", "_section", "_bullet"):
            flags = flags.withColumn(f"{c}{n}", F.lead(c, n).over(order))
    dated = lambda c: F.coalesce(F.col(c) != "", F.lit(False))
    titled = lambda c: F.coalesce(F.col(c), F.lit(False))
    before = X.strip(F.call_function("substring_index", F.col("_s"), F.col("_dates"), F.lit(1)), " |·–—-")
    head = F.when(dated("_dates"), before).otherwise(F.col("_s"))
    parts = named_parts(head)
    rows = flags.withColumn("_p", parts)
    shape = (
        F.when(F.col("_section").isNotNull(), None)
        .when(dated("_dates"), "dated")
        .when(dated("_dates1") & titled("_titled"), "two")
        .when(dated("_dates2") & F.col("_section1").isNull() & titled("_titled") & titled("_titled1"), "three")
    )
    rows = rows.withColumn("shape", shape)
    borrows = (F.col("shape") == "dated") & (F.col("_p.company") == "") & F.coalesce(F.col("_s1") != "", F.lit(False)) & F.col("_section1").isNull() & ~dated("_dates1") & ~F.coalesce(F.col("_bullet1"), F.lit(False))
    rows = rows.withColumn("_borrows", F.coalesce(borrows, F.lit(False)))
    used = F.when(F.col("shape") == "three", 3).when((F.col("shape") == "two") | F.col("_borrows"), 2).otherwise(1)
    rows = with_read(rows.withColumn("used", used), key, at, "used").where(F.col("read") & F.col("shape").isNotNull())
    next_parts = F.split(F.col("_s1"), r"\s{2,}", -1)
    company = F.when(F.col("_borrows"), X.strip(next_parts[0])).when(F.col("shape") == "three", F.col("_s1")).otherwise(F.col("_p.company"))
    location = F.when(F.col("_borrows"), F.coalesce(X.strip(F.try_element_at(next_parts, F.lit(2))), F.lit(""))).when(F.col("shape") == "three", "").otherwise(F.col("_p.location"))
    title = F.when(F.col("shape") == "three", F.col("_s")).otherwise(F.col("_p.title"))
    dates = F.when(F.col("shape") == "dated", F.col("_dates")).when(F.col("shape") == "two", F.col("_dates1")).otherwise(F.col("_dates2"))
    return rows.select(key, at, "shape", "used", title.alias("title"), company.alias("company"), location.alias("location"), dates.alias("dates"))


def named_parts(head: Column) -> Column:
    """``struct<title, company, location>`` of a header: "Title: Company, Location", or parts between wide blanks, bars, dots or dashes."""
    colon = F.regexp_extract(head, r"^(.+?)\s*:\s*(.+)$", 1)
    rest = X.strip(F.regexp_extract(head, r"^(.+?)\s*:\s*(.+)$", 2))
    comma = F.regexp_extract(rest, r"^([^,]+?)\s*,\s*(.+)$", 1)
    parts = F.split(head, r"\s{2,}|\s*[|·–]\s*", -1)
    has_colon = colon != ""
    return F.struct(
        F.when(has_colon, X.strip(colon)).otherwise(X.strip(parts[0])).alias("title"),
        F.when(has_colon, F.when(comma != "", X.strip(comma)).otherwise(rest)).otherwise(F.coalesce(X.strip(F.try_element_at(parts, F.lit(2))), F.lit(""))).alias("company"),
        F.when(has_colon & (comma != ""), X.strip(F.regexp_extract(rest, r"^([^,]+?)\s*,\s*(.+)$", 2))).otherwise("").alias("location"),
    )


#: Words of degrees and of schools (fixed values).
DEGREES = ("master", "bachelor", "phd", "b.s", "m.s", "b.e", "m.e", "mba", "doctor", "associate")
SCHOOLS = ("university", "college", "institute", "school", "tech", "polytechnic")


def education_entries(lines: DataFrame, key: str = "doc_id", at: str = "at", line: str = "line", degrees: tuple[str, ...] = DEGREES, schools: tuple[str, ...] = SCHOOLS) -> DataFrame:
    """``key, entry, institution, degree, dates`` from the lines of education sections.

    A school (or, before any entry, a line with dates) opens an entry. A line
    with dates and no school gives the open entry its dates, the last one stays.
    A degree goes to the open entry, or opens one itself where that has a degree.
    So of the degree lines after an opening line every second opens an entry: no
    state is carried but counts over the lines.
    """
    order = Window.partitionBy(key).orderBy(at)
    s = X.strip(F.col(line))
    holds = lambda words: F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(F.lower(s), w))
    rows = lines.where(~s.rlike("^[•-]")).select(key, at, s.alias("_s"), X.has_date(s).alias("_dated"), holds(degrees).alias("_degree"), holds(schools).alias("_school"))
    rows = rows.withColumn("_opened", F.coalesce(F.max(F.col("_school") | F.col("_dated")).over(order.rowsBetween(Window.unboundedPreceding, -1)), F.lit(False)))
    kind = (
        F.when(F.col("_opened") & F.col("_dated") & ~F.col("_school"), "dates")
        .when(F.col("_opened") & F.col("_degree"), "degree")
        .when(F.col("_school") | F.col("_dated"), "open")
    )
    rows = rows.withColumn("_kind", kind).where(F.col("_kind").isNotNull())
    rows = rows.withColumn("_span", F.sum((F.col("_kind") == "open").cast("int")).over(order))
    nth = F.sum((F.col("_kind") == "degree").cast("int")).over(Window.partitionBy(key, "_span").orderBy(at))
    rows = rows.withColumn("_nth", nth)
    opens = (F.col("_kind") == "open") | (F.col("_kind") == "degree") & (F.col("_nth") % 2 == 0)
    rows = rows.withColumn("_opens", opens).withColumn("entry", F.sum(opens.cast("int")).over(order))
    last = lambda which: F.max_by("_s", F.when(which, F.col(at)))
    found = rows.groupBy(key, "entry").agg(
        last(F.col("_opens")).alias("institution"),
        last((F.col("_kind") == "degree") & ~F.col("_opens")).alias("degree"),
        last(F.col("_kind") == "dates").alias("dates"),
    )
    return found.select(key, "entry", "institution", F.coalesce("degree", F.lit("")).alias("degree"), F.coalesce("dates", F.lit("")).alias("dates"))


def brace_groups(texts: DataFrame, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, open, close, level, run, nth``: every balanced pair of braces, by the positions (from 0) of its ends.

    The depth behind each brace is a running sum. At one level pairs don't nest,
    so the brace after an opening one is its closing one. ``run`` counts pairs
    that follow each other with nothing but blanks between them, ``nth`` is a
    pair's place in its run. What is never closed is no pair.
    """
    pieces = texts.select(key, F.posexplode(F.split(text, r"(?=[{}])", -1)).alias("_k", "_piece"))
    order = Window.partitionBy(key).orderBy("_k")
    rows = pieces.withColumn("_pos", F.sum(F.char_length("_piece")).over(order) - F.char_length("_piece")).where(F.col("_piece").rlike("^[{}]"))
    opens = F.startswith("_piece", F.lit("{"))
    rows = rows.withColumn("_opens", opens).withColumn("_tight", F.col("_piece").rlike(r"^\}[ \t\n\r]*$")).drop("_piece")
    rows = rows.withColumn("_depth", F.sum(F.when(F.col("_opens"), 1).otherwise(-1)).over(order))
    rows = rows.withColumn("level", F.when(F.col("_opens"), F.col("_depth")).otherwise(F.col("_depth") + 1))
    at_level = Window.partitionBy(key, "level").orderBy("_k")
    follows = F.lag("_tight").over(at_level) & (F.lag("_k").over(at_level) == F.col("_k") - 1)
    rows = rows.withColumn("_starts", F.when(F.col("_opens") & ~F.coalesce(follows, F.lit(False)), 1).otherwise(0))
    rows = rows.withColumn("close", F.lead("_pos").over(at_level)).withColumn("run", F.sum("_starts").over(at_level))
    pairs = rows.where(F.col("_opens") & F.col("close").isNotNull())
    nth = F.row_number().over(Window.partitionBy(key, "level", "run").orderBy("_k"))
    return pairs.withColumn("nth", nth.cast("long")).select(key, F.col("_pos").alias("open"), "close", "level", "run", "nth")


def brace_args(texts: DataFrame, n: int, key: str = "doc_id", text: str = "text", starts: DataFrame | None = None) -> DataFrame:
    """``key, at, args array<string>``: up to ``n`` brace groups that begin at each opening brace (or at those of ``starts``: ``key, at``).

    Groups follow each other with blanks at most; the first that is not closed ends the list.
    """
    pairs = brace_groups(texts, key, text)
    within = Window.partitionBy(key, "level", "run").orderBy("nth").rowsBetween(0, n - 1)
    ends = pairs.select(key, F.col("open").alias("at"), F.collect_list(F.struct("open", "close")).over(within).alias("_ends"))
    if starts is not None:
        ends = ends.join(starts.select(key, "at").distinct(), [key, "at"])
    args = F.transform("_ends", lambda e: F.substring(F.col(text), (e["open"] + 2).cast("int"), (e["close"] - e["open"] - 1).cast("int")))
    return ends.join(texts.select(key, text), key).select(key, "at", args.alias("args"))


def macro_args(texts: DataFrame, macro: str, n: int, key: str = "doc_id", text: str = "text") -> DataFrame:
    """:func:`brace_args` behind every ``macro`` (a literal, such as ``\\item``), blanks before the first brace allowed."""
    parts = texts.select(key, F.posexplode(F.split(text, F.lit(f"(?={_quoted(macro)}[ \\t\\n\\r]*\\{{)"), -1)).alias("_k", "_piece"))
    begin = F.sum(F.char_length("_piece")).over(Window.partitionBy(key).orderBy("_k")) - F.char_length("_piece")
    lead = F.char_length(F.regexp_extract("_piece", f"^({_quoted(macro)}[ \\t\\n\\r]*)\\{{", 1))
    starts = parts.withColumn("at", begin + lead).where(lead > 0).select(key, "at")
    return brace_args(texts, n, key, text, starts)


def _quoted(literal: str) -> str:
    return "".join(c if c.isalnum() else f"\\{c}" for c in literal)
