"""Queries of the engine and the SQL that checks them, by name.

Each query runs over its whole tables. ``documents`` stand in for résumés,
``benchmark`` for job descriptions, ``events`` for the usage log, ``embeddings``
for stored vectors and ``conversations`` for ordered lines. Parsers and scores
whose SQL reads a small inline relation are registered twice: under their name
over that relation, and as ``name_documents`` (``name_benchmark``) over the
whole table united with it, its ids negated.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab
from ..operators import extras, gap, metering, parse_arrow, profile, render, store, vector

_QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
_ORACLES: dict[str, str] = {}


def _query(sql: str | None = None):
    def add(f):
        _QUERIES[f.__name__] = f
        if sql:
            _ORACLES[f.__name__] = sql
        return f

    return add


def _query_both(sql: str, rows: list[tuple], names: str = "id, text", table: str = "documents", check: bool = True):
    """Register a function of a frame over inline rows, and over a whole table united with them.

    The SQL of the second is that of the first with the union as its source, left out where ``check`` is off.
    """
    key, table_key = names.split(", ")[0], {"documents": "doc_id", "benchmark": "item_id"}[table]
    schema = f"{key} long, text string"

    def add(f):
        def inline(spark, d):
            return f(spark.createDataFrame(rows, schema)).withColumn(key, F.col(key).cast("int"))

        def whole(spark, d):
            found = _t(spark, d, table).select(F.col(table_key).alias(key), "text")
            return f(found.unionByName(spark.createDataFrame([(-i, t) for i, t in rows], schema)))

        name = f.__name__
        _QUERIES[name], _QUERIES[f"{name}_{table}"] = inline, whole
        _ORACLES[name] = sql
        if check:
            source = _values(rows, names)
            assert source in sql
            _ORACLES[f"{name}_{table}"] = sql.replace(source, f"(SELECT {table_key} AS {key}, text FROM {table} UNION ALL SELECT -{key} AS {key}, text FROM {source})")
        return f

    return add


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _docs(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "documents").select("doc_id", "text")


def _jds(spark: SparkSession, d: str) -> DataFrame:
    return _t(spark, d, "benchmark").select(F.col("item_id").alias("jd_id"), "text")


# --- SQL fragments -----------------------------------------------------------


def _q(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def _list(words: list[str]) -> str:
    return "[" + ", ".join(map(_q, words)) + "]"


def _values(rows: list[tuple], names: str) -> str:
    cell = lambda v: _q(v) if isinstance(v, str) else "NULL" if v is None else str(v)
    return f"(SELECT * FROM (VALUES {', '.join('(' + ', '.join(map(cell, r)) + ')' for r in rows)}) AS t({names}))"


_TOKENS = f"list_filter(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-/+.#]*'), lambda t: length(t) > 2 AND NOT list_contains({_list(vocab.STOPWORDS)}, t))"
_WORDS = "list_filter(string_split_regex(lower(text), '\\s+'), lambda w: w <> '')"
_TAXONOMY = _values(vocab.taxonomy_rows(), "cat_ord, category, kw_ord, keyword")
#: Frequent benchmark tokens dealt to ten categories: the same shape as the taxonomy, but with hits in the driver's texts.
_DERIVED = f"""(SELECT CAST((rn - 1) % 10 AS INTEGER) AS cat_ord, 'group_' || CAST((rn - 1) % 10 AS VARCHAR) AS category, CAST((rn - 1) // 10 AS INTEGER) AS kw_ord, term AS keyword
  FROM (SELECT term, row_number() OVER (ORDER BY n DESC, term) AS rn FROM (SELECT term, count(*) AS n FROM (SELECT unnest({_TOKENS}) AS term FROM benchmark) GROUP BY term)) WHERE rn <= 100)"""


#: The same from the documents themselves, two thousand words.
_WIDE = _DERIVED.replace("FROM benchmark", "FROM documents").replace("rn <= 100", "rn <= 2000")


def derived_taxonomy(jds: DataFrame, size: int = 100) -> dict[str, list[str]]:
    """The ``size`` most frequent tokens dealt to ten categories. The vocabulary is a parameter of the gap operators; this one is made of data."""
    terms = jds.select(F.explode(X.tokens(F.col("text"))).alias("term")).groupBy("term").count().orderBy(F.desc("count"), "term").limit(size).collect()
    out: dict[str, list[str]] = {f"group_{i}": [] for i in range(10)}
    for i, r in enumerate(terms):
        out[f"group_{i % 10}"].append(r["term"])
    return {k: v for k, v in out.items() if v}


def _hits(source: str, key: str, taxonomy: str) -> str:
    return f"""(SELECT {key}, cat_ord, category, kw_ord, keyword, CAST((length(low) - length(replace(low, keyword, ''))) // length(keyword) AS BIGINT) AS n
  FROM (SELECT {key}, lower(text) AS low FROM {source}) d, {taxonomy} v WHERE contains(low, keyword))"""


def _coverage(taxonomy: str) -> str:
    return f"""WITH jh AS {_hits("(SELECT item_id AS jd_id, text FROM benchmark)", "jd_id", taxonomy)}, dh AS {_hits("documents", "doc_id", taxonomy)},
jc AS (SELECT jd_id, cat_ord, category, count(*) AS wanted, CAST(sum(n) AS BIGINT) AS frequency FROM jh GROUP BY ALL),
sh AS (SELECT jd_id, dh.doc_id, jh.cat_ord, count(*) AS shared FROM jh JOIN dh ON jh.cat_ord = dh.cat_ord AND jh.kw_ord = dh.kw_ord GROUP BY ALL),
cov AS (SELECT jc.jd_id, d.doc_id, jc.cat_ord, jc.category, jc.frequency, CAST(coalesce(sh.shared, 0) AS INTEGER) AS shared, round_even(coalesce(sh.shared, 0) / jc.wanted, 2) AS coverage
  FROM documents d CROSS JOIN jc LEFT JOIN sh ON sh.jd_id = jc.jd_id AND sh.doc_id = d.doc_id AND sh.cat_ord = jc.cat_ord),
sig AS (SELECT *, CASE WHEN coverage < 0.3 AND frequency >= 2 THEN 'high' WHEN coverage < 0.6 AND frequency >= 1 THEN 'medium' ELSE 'low' END AS priority FROM cov),
top AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY jd_id, doc_id ORDER BY CASE priority WHEN 'high' THEN 0 ELSE 1 END, frequency DESC, cat_ord) AS rank FROM sig WHERE priority <> 'low') WHERE rank <= 5),
jt AS (SELECT DISTINCT item_id AS jd_id, unnest({_TOKENS}) AS term FROM benchmark),
dt AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents),
js AS (SELECT b.item_id AS jd_id, count(jt.term) AS jd_tokens FROM benchmark b LEFT JOIN jt ON jt.jd_id = b.item_id GROUP BY ALL),
ov AS (SELECT jd_id, doc_id, count(*) AS shared FROM jt JOIN dt USING (term) GROUP BY ALL),
cs AS (SELECT jd_id, doc_id, sum(CAST(round_even(coverage * 100, 0) AS BIGINT)) AS cents, count(*) AS cats FROM cov GROUP BY ALL),
parts AS (SELECT js.jd_id, d.doc_id, coalesce(ov.shared, 0) / greatest(js.jd_tokens, 1) AS overlap, coalesce(CAST(cs.cents AS DOUBLE) / cs.cats / 100, 0.0) AS category_mean
  FROM documents d CROSS JOIN js LEFT JOIN ov ON ov.jd_id = js.jd_id AND ov.doc_id = d.doc_id LEFT JOIN cs ON cs.jd_id = js.jd_id AND cs.doc_id = d.doc_id),
scores AS (SELECT jd_id, doc_id, overlap, category_mean, least(CAST(trunc((0.5 * overlap + 0.5 * category_mean) * 100) AS INTEGER), 100) AS score FROM parts)"""


_FIXED, _OWN = _coverage(_TAXONOMY), _coverage(_DERIVED)


# --- text --------------------------------------------------------------------


@_query(f"SELECT doc_id, CAST(len({_TOKENS}) AS BIGINT) AS n_tokens, CAST(len(list_distinct({_TOKENS})) AS BIGINT) AS n_distinct FROM documents")
def tokenize_count(spark, d):
    t = X.tokens(F.col("text"))
    return _docs(spark, d).select("doc_id", F.size(t).cast("long").alias("n_tokens"), F.size(F.array_distinct(t)).cast("long").alias("n_distinct"))


@_query(f"SELECT doc_id, term, count(*) AS freq, CAST(min(pos) AS INTEGER) AS first_pos FROM (SELECT doc_id, unnest(t) AS term, generate_subscripts(t, 1) - 1 AS pos FROM (SELECT doc_id, {_TOKENS} AS t FROM documents)) GROUP BY ALL")
def term_frequency(spark, d):
    return gap.doc_terms(_docs(spark, d), "doc_id")


@_query(f"SELECT item_id, CAST(len(regexp_extract_all(lower(text), '[a-z][a-z0-9\\-/+.#]*')) AS INTEGER) AS n_raw, CAST(len({_TOKENS}) AS INTEGER) AS n_kept FROM benchmark")
def stopword_filter(spark, d):
    raw = F.regexp_extract_all(F.lower("text"), F.lit(vocab.TOKEN), F.lit(0))
    return _t(spark, d, "benchmark").select("item_id", F.size(raw).alias("n_raw"), F.size(X.tokens(F.col("text"))).alias("n_kept"))


def _ngram_sql(n: int) -> str:
    return f"SELECT item_id, gram, count(*) AS freq FROM (SELECT item_id, unnest(list_transform(range(1, greatest(len(w) - {n - 1}, 0) + 1), lambda i: array_to_string(w[i:i + {n - 1}], ' '))) AS gram FROM (SELECT item_id, {_WORDS} AS w FROM benchmark)) GROUP BY ALL"


def _ngrams(spark, d, n):
    return _t(spark, d, "benchmark").select("item_id", F.explode(X.ngrams(F.col("text"), n)).alias("gram")).groupBy("item_id", "gram").agg(F.count("*").alias("freq"))


@_query(_ngram_sql(2))
def bigrams(spark, d):
    return _ngrams(spark, d, 2)


@_query(_ngram_sql(3))
def trigrams(spark, d):
    return _ngrams(spark, d, 3)


_TRAPS = [(1, "cut costs by 68% and 12.5 % more"), (2, "68% saving $4,100"), (3, "from 8 weeks to 6 days and eliminating manual handoff steps"), (4, "45 min to 3x and 200k users in 5 days"), (5, "nothing to count"), (6, "2x faster, 10x cheaper, 99.9% uptime, $1.5m saved"), (7, ""), (8, "postgresql javascript storage on AWS with CI/CD")]
_METRICS_SQL = "list_sort(list_distinct(" + " || ".join(f"list_transform(regexp_extract_all(text, {_q('(?i)' + p)}, {g}), lambda x: coalesce(x, ''))" for p, g in vocab.METRICS) + "))"


@_query_both(f"SELECT id, array_to_string({_METRICS_SQL}, '|') AS found, CAST(len({_METRICS_SQL}) AS INTEGER) AS n, CASE WHEN len({_METRICS_SQL}) >= 2 THEN 'high' WHEN len({_METRICS_SQL}) = 1 THEN 'medium' ELSE 'low' END AS confidence FROM {_values(_TRAPS, 'id, text')}", _TRAPS)
def metric_extract(rows):
    found = rows.withColumn("m", X.metrics(F.col("text")))
    return found.select("id", F.array_join(F.sort_array("m"), "|").alias("found"), F.size("m").alias("n"), X.confidence(F.col("m")).alias("confidence"))


@_query(f"SELECT CASE WHEN n >= 2 THEN 'high' WHEN n = 1 THEN 'medium' ELSE 'low' END AS confidence, count(*) AS docs FROM (SELECT len({_METRICS_SQL}) AS n FROM documents) GROUP BY ALL")
def confidence_hist(spark, d):
    return _docs(spark, d).select(X.confidence(X.metrics(F.col("text"))).alias("confidence")).groupBy("confidence").agg(F.count("*").alias("docs"))


_TOOLS_SQL = f"array_to_string(list_filter({_list(vocab.TOOLS)}, lambda t: contains(lower(text), lower(t))), '|')"


@_query(f"SELECT doc_id, {_TOOLS_SQL} AS tools FROM documents UNION ALL SELECT -id AS doc_id, {_TOOLS_SQL} AS tools FROM {_values(_TRAPS, 'id, text')}")
def tool_extract(spark, d):
    both = _docs(spark, d).unionByName(spark.createDataFrame([(-i, t) for i, t in _TRAPS], "doc_id long, text string"))
    return both.select("doc_id", F.array_join(X.tools(F.col("text")), "|").alias("tools"))


_FORMATS = [(1, "\\documentclass{article}\n## x"), (2, "intro\n## Skills\nx"), (3, "plain text # not a heading"), (4, "\\resumeItem{a}"), (5, "####  deep"), (6, "# \n"), (7, "###\tTabbed")]


@_query_both(f"SELECT id, CASE WHEN contains(text, '\\documentclass') OR contains(text, '\\resumeSubheading') OR contains(text, '\\resumeItem') THEN 'latex' WHEN regexp_matches(text, '(?m)^#{{1,3}}\\s+\\w') THEN 'markdown' ELSE 'blob' END AS format FROM {_values(_FORMATS, 'id, text')}".replace("'intro\n", "'intro\n"), _FORMATS)
def format_detect(rows):
    return rows.select("id", X.detect_format(F.col("text")).alias("format"))


_DATES = [(1, "Jan 2022 – Present"), (2, "July 2024 -- Present"), (3, "2019 - 2021"), (4, "May2020–Jun2021"), (5, "2020"), (6, "a — b – c"), (7, " x--y "), (8, "2019-2020")]
_START = "CASE " + " ".join(f"WHEN contains(text, {_q(s)}) THEN trim(text[:instr(text, {_q(s)}) - 1])" for s in vocab.DATE_SEPARATORS) + " ELSE trim(text) END"
_END = "CASE " + " ".join(f"WHEN contains(text, {_q(s)}) THEN trim(text[instr(text, {_q(s)}) + {len(s)}:])" for s in vocab.DATE_SEPARATORS) + " ELSE '' END"


@_query_both(f'SELECT id, {_START} AS "start", {_END} AS "end" FROM {_values(_DATES, "id, text")}', _DATES)
def date_split(rows):
    return rows.select("id", X.date_range(F.col("text")).alias("r")).select("id", "r.start", "r.end")


_LATEX = [(1, "\\textbf{A \\emph{b}} -- 5\\% \\& more"), (2, "\\href{http://x}{label} \\url{y}"), (3, "\\foo{bar} \\baz qux --- end"), (4, "a\n\n b\t c"), (5, "\\textbf{\\textit{\\small{deep}}}")]


def _clean_sql(c: str) -> str:
    unwrap = r"\\(?:textbf|textit|emph|underline|small|large|tiny|huge|scshape)\{([^{}]*)\}"
    for p, to in [(unwrap, r"\1")] * 4 + [(r"\\href\{[^{}]*\}\{([^{}]*)\}", r"\1"), (r"\\url\{([^{}]*)\}", r"(\1)"), (r"\\[a-zA-Z]+\{([^{}]*)\}", r"\1"), (r"\\[a-zA-Z@]+\*?", " ")]:
        c = f"regexp_replace({c}, {_q(p)}, {_q(to)}, 'g')"
    for m in "%$_&#~":
        c = f"replace({c}, {_q(chr(92) + m)}, {_q(m)})"
    c = f"replace(replace({c}, '---', '—'), '--', '–')"
    return f"trim(regexp_replace({c}, '\\s+', ' ', 'g'))"


@_query_both(f"SELECT id, {_clean_sql('text')} AS clean FROM {_values(_LATEX, 'id, text')}", _LATEX)
def latex_clean(rows):
    return rows.select("id", X.clean_latex(F.col("text")).alias("clean"))


def _escape_sql(c: str) -> str:
    cases = " ".join(f"WHEN {_q(k)} THEN {_q(v)}" for k, v in vocab.LATEX_ESCAPES.items())
    return f"coalesce(array_to_string(list_transform(string_split({c}, ''), lambda c: CASE c {cases} ELSE c END), ''), '')"


@_query(f"SELECT doc_id, md5({_escape_sql('text')}) AS escaped FROM documents")
def latex_escape(spark, d):
    return _docs(spark, d).select("doc_id", F.md5(X.escape_latex(F.col("text")).cast("binary")).alias("escaped"))


@_query("SELECT page_id, replace(url, 'https://', '') AS shown, CASE lower(regexp_extract(url, '\\.([^./]+)$', 1)) WHEN 'pdf' THEN 'pdf' WHEN 'docx' THEN 'docx' WHEN 'doc' THEN 'docx' WHEN 'tex' THEN 'latex' WHEN 'md' THEN 'markdown' ELSE 'blob' END AS format FROM pages")
def url_display(spark, d):
    return _t(spark, d, "pages").select("page_id", X.display_url(F.col("url")).alias("shown"), X.format_of_extension(F.col("url")).alias("format"))


@_query("SELECT word, replace(word, '_', ' ') AS spaced, " + "array_to_string(list_transform(string_split(replace(word, '_', ' '), ' '), lambda w: upper(w[1]) || lower(w[2:])), ' ') AS label FROM " + _values([(c,) for c in vocab.TAXONOMY], "word"))
def category_labels(spark, d):
    rows = spark.createDataFrame([(c,) for c in vocab.TAXONOMY], "word string")
    return rows.select("word", F.replace("word", F.lit("_"), F.lit(" ")).alias("spaced"), X.title_label(F.col("word")).alias("label"))


_HEADS = [(1, "PROFESSIONAL EXPERIENCE"), (2, "Technical Skills:"), (3, "Foo Technologies"), (4, "I have ten years of experience in very many fields of work and study"), (5, "Awards"), (6, "1234 5678"), (7, "Education")]


# --- gap analysis ------------------------------------------------------------


@_query(f"SELECT doc_id, category, count(*) AS n_keywords, CAST(sum(n) AS BIGINT) AS frequency FROM {_hits('documents', 'doc_id', _TAXONOMY)} GROUP BY ALL")
def kw_frequency(spark, d):
    return gap.keyword_frequency(_docs(spark, d), "doc_id", vocab.taxonomy_rows())


@_query(f"SELECT doc_id, CAST(cat_ord AS INTEGER) AS cat_ord, count(*) AS n_keywords, CAST(sum(n) AS BIGINT) AS frequency FROM {_hits('documents', 'doc_id', _WIDE)} GROUP BY doc_id, cat_ord")
def vocabulary_frequency(spark, d):
    """Two thousand words, many of them prefixes of others, in one reading of each text."""
    words = vocab.taxonomy_rows(derived_taxonomy(_docs(spark, d), 2000))
    hits = gap.vocabulary_counts(_docs(spark, d), "doc_id", words)
    return hits.groupBy("doc_id", "cat_ord").agg(F.count("*").alias("n_keywords"), F.sum("n").alias("frequency"))


def _coverage_rows(df: DataFrame) -> DataFrame:
    return df.select("jd_id", "doc_id", "category", "frequency", "shared", "coverage")


@_query(f"{_FIXED} SELECT jd_id, doc_id, category, frequency, shared, coverage FROM cov")
def category_coverage(spark, d):
    return _coverage_rows(gap.category_coverage(_jds(spark, d), _docs(spark, d), named=False))


@_query(f"{_OWN} SELECT jd_id, doc_id, category, frequency, shared, coverage FROM cov")
def category_coverage_derived(spark, d):
    return _coverage_rows(gap.category_coverage(_jds(spark, d), _docs(spark, d), derived_taxonomy(_jds(spark, d)), named=False))


@_query(f"{_OWN} SELECT jd_id, doc_id, CAST(rank AS INTEGER) AS rank, category, priority, frequency, coverage FROM top")
def gap_signals_topn(spark, d):
    rows = gap.pair_signals(_jds(spark, d), _docs(spark, d), taxonomy=derived_taxonomy(_jds(spark, d)), named=False)
    return rows.select("jd_id", "doc_id", "rank", "category", "priority", "frequency", "coverage")


_ANGLES = _values([(c, i, a) for c, xs in vocab.ANGLES.items() for i, a in enumerate(xs)], "category, ord, angle")


@_query(f"{_FIXED} SELECT jd_id, doc_id, CAST(rank AS INTEGER) AS rank, top.category, (SELECT string_agg(angle, '|' ORDER BY ord) FROM {_ANGLES} a WHERE a.category = top.category) AS angles FROM top")
def signal_angles(spark, d):
    rows = gap.pair_signals(_jds(spark, d), _docs(spark, d), named=False)
    return rows.select("jd_id", "doc_id", "rank", "category", F.array_join("angles", "|").alias("angles"))


@_query(f"""WITH jt AS (SELECT jd_id, term, count(*) AS freq, min(pos) AS first_pos FROM (SELECT item_id AS jd_id, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT item_id, {_TOKENS} AS t FROM benchmark)) GROUP BY ALL),
w AS (SELECT * FROM jt WHERE freq >= 2 AND length(term) > 3), dt AS (SELECT DISTINCT doc_id, unnest({_TOKENS}) AS term FROM documents)
SELECT jd_id, doc_id, CAST(rn AS INTEGER) AS rank, term, freq FROM (SELECT w.jd_id, d.doc_id, w.term, w.freq, row_number() OVER (PARTITION BY w.jd_id, d.doc_id ORDER BY w.freq DESC, w.first_pos) AS rn
  FROM documents d CROSS JOIN w LEFT JOIN dt ON dt.doc_id = d.doc_id AND dt.term = w.term WHERE dt.term IS NULL) WHERE rn <= 10""")
def keyword_gaps(spark, d):
    return gap.keyword_gaps(_jds(spark, d), _docs(spark, d))


@_query(f"{_FIXED} SELECT jd_id, doc_id, shared, jd_tokens FROM ov JOIN js USING (jd_id)")
def keyword_overlap(spark, d):
    return gap.token_overlap(_jds(spark, d), _docs(spark, d)).select("jd_id", "doc_id", "shared", "jd_tokens")


@_query(f"{_FIXED} SELECT jd_id, doc_id, round(overlap, 9) AS overlap, round(category_mean, 9) AS category_mean, score FROM scores")
def ats_score(spark, d):
    return gap.match_scores(_jds(spark, d), _docs(spark, d)).select("jd_id", "doc_id", F.round("overlap", 9).alias("overlap"), F.round("category_mean", 9).alias("category_mean"), "score")


@_query(f"{_OWN} SELECT doc_id, CAST(rn AS INTEGER) AS rank, jd_id, score FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY score DESC, jd_id) AS rn FROM scores) WHERE rn <= 3")
def best_descriptions(spark, d):
    return gap.best_descriptions(_jds(spark, d), _docs(spark, d), 3, derived_taxonomy(_jds(spark, d)))


@_query(f"{_OWN} SELECT CASE WHEN score >= 80 THEN 'strong' WHEN score >= 60 THEN 'moderate' WHEN score >= 50 THEN 'weak' ELSE 'decline' END AS band, count(*) AS pairs, CAST(sum(score) AS BIGINT) AS total FROM scores GROUP BY ALL")
def score_bands(spark, d):
    s = gap.score_counts(_jds(spark, d), _docs(spark, d), derived_taxonomy(_jds(spark, d)))
    return s.groupBy(gap.band(F.col("score")).alias("band")).agg(F.sum("pairs").alias("pairs"), F.sum(F.col("score") * F.col("pairs")).alias("total"))


@_query(f"""{_FIXED}, fl AS (SELECT jd_id, doc_id, bool_or(category = 'testing_ci_cd') AS t, bool_or(category = 'data_quality_observability') AS q FROM top GROUP BY ALL)
SELECT jd_id, doc_id, score, coalesce(nullif(array_to_string(list_filter([CASE WHEN score < 50 THEN {_q(vocab.ADVICE["critical"])} END, CASE WHEN t THEN {_q(vocab.ADVICE["testing"])} END, CASE WHEN q THEN {_q(vocab.ADVICE["quality"])} END], lambda x: x IS NOT NULL), '|'), ''), {_q(vocab.ADVICE["good"])}) AS advice FROM scores LEFT JOIN fl USING (jd_id, doc_id)""")
def recommendations(spark, d):
    jds, docs = _jds(spark, d), _docs(spark, d)
    rows = gap.recommendations(jds, docs)
    return rows.select("jd_id", "doc_id", "score", F.array_join("advice", "|").alias("advice"))


_TOLD = f"""{_FIXED} SELECT jd_id, doc_id, string_agg(concat_ws(':', rank, priority, frequency, CAST(round_even(coverage * 100, 0) AS INTEGER), coalesce((SELECT string_agg(angle, '|' ORDER BY ord) FROM {_ANGLES} a WHERE a.category = top.category), '')), ';' ORDER BY rank) AS signals FROM top GROUP BY ALL"""


@_query(f"""SELECT jd_id, doc_id, score, advice, coalesce(signals, '') AS signals, coalesce(gaps, '') AS gaps FROM ({_ORACLES["recommendations"]}) r LEFT JOIN ({_TOLD}) t USING (jd_id, doc_id)
LEFT JOIN (SELECT jd_id, doc_id, string_agg(concat_ws(':', rank, term, freq), ';' ORDER BY rank) AS gaps FROM ({_ORACLES["keyword_gaps"]}) GROUP BY ALL) g USING (jd_id, doc_id)""")
def full_report(spark, d):
    """The nested report of each pair, its lists written as texts."""
    cents = lambda x: F.bround(x["coverage"] * 100).cast("int")
    signal = lambda x: F.concat_ws(":", x["rank"], x["priority"], x["frequency"], cents(x), F.coalesce(F.array_join(x["angles"], "|"), F.lit("")))
    text = lambda name, one: F.coalesce(F.array_join(F.transform(name, one), ";"), F.lit("")).alias(name)
    rows = gap.full_report(_jds(spark, d), _docs(spark, d))
    return rows.select("jd_id", "doc_id", "score", F.array_join("advice", "|").alias("advice"), text("signals", signal), text("gaps", lambda x: F.concat_ws(":", x["rank"], x["term"], x["freq"])))


_SETS = f"WITH a AS (SELECT DISTINCT unnest({_TOKENS}) AS term FROM benchmark), b AS (SELECT DISTINCT unnest({_TOKENS}) AS term FROM documents) "


def _token_sets(spark, d) -> tuple[DataFrame, DataFrame]:
    one = lambda df: df.select(F.explode(X.tokens(F.col("text"))).alias("term")).distinct()
    return one(_t(spark, d, "benchmark")), one(_docs(spark, d))


@_query(_SETS + "SELECT term FROM a WHERE term IN (SELECT term FROM b)")
def semi_tokens(spark, d):
    a, b = _token_sets(spark, d)
    return a.join(b, "term", "left_semi")


@_query(_SETS + "SELECT term FROM b WHERE term NOT IN (SELECT term FROM a)")
def anti_tokens(spark, d):
    a, b = _token_sets(spark, d)
    return b.join(a, "term", "left_anti")


@_query(_SETS + "SELECT term FROM a INTERSECT SELECT term FROM b")
def intersect_tokens(spark, d):
    a, b = _token_sets(spark, d)
    return a.intersect(b)


@_query(_SETS + "SELECT term FROM b EXCEPT SELECT term FROM a")
def except_tokens(spark, d):
    a, b = _token_sets(spark, d)
    return b.subtract(a)


# --- vectors -----------------------------------------------------------------


@_query(f"SELECT doc_id, CAST(('0x' || right(md5(w), 2))::INT % 128 AS INTEGER) AS bucket, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) GROUP BY ALL")
def hash_embed_buckets(spark, d):
    return vector.hashed_counts(_docs(spark, d))


@_query(f"""WITH c AS (SELECT doc_id, CAST(('0x' || right(md5(w), 2))::INT % 128 AS INTEGER) AS b, count(*) AS n FROM (SELECT doc_id, unnest({_WORDS}) AS w FROM documents) GROUP BY ALL)
SELECT doc_id, CAST(sum(n * n) AS BIGINT) AS squared, round(sum(n * b / sqrt(t)), 6) AS weighted FROM (SELECT *, CAST(sum(n * n) OVER (PARTITION BY doc_id) AS DOUBLE) AS t FROM c) GROUP BY doc_id""")
def hash_embedding(spark, d):
    """The dense vector of every text, reduced to two figures."""
    rows = _docs(spark, d).select("doc_id", vector.dense_counts(F.col("text")).alias("n"))
    rows = rows.withColumn("v", X.let(vector.norm(F.col("n")), lambda n: F.transform("n", lambda x: x / n)))
    fold = lambda xs: F.aggregate(xs, F.lit(0.0), lambda a, x: a + x)
    squared = fold(F.transform("n", lambda x: x * x)).cast("long")
    return rows.select("doc_id", squared.alias("squared"), F.round(fold(F.transform("v", lambda x, i: x * i)), 6).alias("weighted")).where("squared > 0")


_COS = "list_sum(list_transform(list_zip(a.v, b.v), lambda z: coalesce(z[1], 0) * coalesce(z[2], 0))) / (CASE WHEN sqrt(list_sum(list_transform(a.v, lambda x: x * x))) = 0 THEN 1 ELSE sqrt(list_sum(list_transform(a.v, lambda x: x * x))) END * CASE WHEN sqrt(list_sum(list_transform(b.v, lambda x: x * x))) = 0 THEN 1 ELSE sqrt(list_sum(list_transform(b.v, lambda x: x * x))) END)"


@_query(f"""WITH v AS (SELECT vec_id, label, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings),
r AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id DESC) AS recency FROM v) WHERE recency <= 50),
q AS (SELECT label, v FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) AS rn FROM v) WHERE rn = 1),
s AS (SELECT a.label AS user_id, b.vec_id, b.recency, {_COS} AS score FROM q a JOIN r b ON a.label = b.label)
SELECT user_id, vec_id, CAST(rn AS INTEGER) AS rank, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY score DESC, recency) AS rn FROM s) WHERE rn <= 3""")
def recent50_then_topk(spark, d):
    """Each user's oldest vector asks for the best three of the user's fifty latest."""
    v = _t(spark, d, "embeddings").select(F.col("label").alias("user_id"), F.col("vec_id").alias("id"), F.col("vec_id").alias("stored_at"), F.col("embedding").cast("array<double>").alias("embedding"))
    asks = v.groupBy("user_id").agg(F.min_by("embedding", "id").alias("q")).withColumn("query_id", F.col("user_id"))
    return vector.top_k(v, asks).select("user_id", F.col("id").alias("vec_id"), "rank", F.round("score", 6).alias("score"))


@_query(f"""WITH a AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings), b AS (SELECT vec_id, list_transform(embedding[1:32], lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings)
SELECT a.vec_id, round({_COS}, 6) AS score FROM a JOIN b USING (vec_id)""")
def cosine_trunc(spark, d):
    """Cosine of each vector with its own first half: the dot product stops at the shorter, norms do not."""
    e = F.col("embedding").cast("array<double>")
    return _t(spark, d, "embeddings").select("vec_id", F.round(vector.cosine(e, F.slice(e, 1, 32)), 6).alias("score"))


# --- metering and stores -------------------------------------------------------


def _events(spark, d) -> DataFrame:
    return _t(spark, d, "events").select("event_id", "ts", "user_id", "event_type")


@_query("SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS resume_count FROM events GROUP BY ALL")
def usage_monthly(spark, d):
    return metering.monthly_usage(_events(spark, d))


@_query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS INTEGER) AS place, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) <= 5 AS allowed FROM events")
def usage_admission(spark, d):
    return metering.admitted(_events(spark, d)).select("event_id", "user_id", "place", "allowed")


_TYPES = "WITH t AS (SELECT min(event_type) AS up, max(event_type) AS down FROM events), p AS (SELECT user_id, arg_max(CASE WHEN event_type = up THEN 'pro' ELSE 'free' END, (ts, event_id)) AS plan FROM events, t WHERE event_type IN (up, down) GROUP BY user_id) "


def _plans(spark, d) -> DataFrame:
    kinds = _events(spark, d).agg(F.min("event_type").alias("up"), F.max("event_type").alias("down")).first()
    return metering.latest_plans(_events(spark, d), kinds["up"], kinds["down"])


@_query(_TYPES + "SELECT user_id, plan FROM p")
def plan_latest(spark, d):
    return _plans(spark, d)


@_query(_TYPES + ", u AS (SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS resume_count FROM events GROUP BY ALL) SELECT user_id, month, resume_count, coalesce(plan, 'free') AS plan, CASE WHEN coalesce(plan, 'free') <> 'pro' THEN 5 END AS usage_limit, coalesce(plan, 'free') = 'pro' OR resume_count < 5 AS allowed FROM u LEFT JOIN p USING (user_id)")
def usage_info(spark, d):
    return metering.usage_info(metering.monthly_usage(_events(spark, d)), _plans(spark, d)).select("user_id", "month", "resume_count", "plan", "usage_limit", "allowed")


@_query("SELECT user_id, arg_max(event_type, event_id) AS plan, arg_max(CASE WHEN event_id % 3 = 0 THEN 'c' || event_id END, event_id) FILTER (WHERE event_id % 3 = 0) AS customer_id FROM events GROUP BY user_id")
def plan_upsert(spark, d):
    rows = _events(spark, d).select("user_id", F.col("event_id").alias("seq"), F.col("event_type").alias("plan"), F.when(F.col("event_id") % 3 == 0, F.concat(F.lit("c"), F.col("event_id").cast("string"))).alias("customer_id"))
    return metering.upsert_plans(rows)


@_query("SELECT user_id, event_id, event_type FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id DESC) AS rn FROM events) WHERE rn = 1")
def upsert_latest(spark, d):
    return store.latest(_events(spark, d).select("user_id", "event_id", "event_type"), "user_id", "event_id")


@_query("WITH pl AS (SELECT c_custkey AS user_id, c_mktsegment AS customer_id, 'pro' AS plan FROM customer) SELECT user_id, customer_id, CASE WHEN customer_id IN (SELECT c_mktsegment FROM customer GROUP BY 1 HAVING avg(c_acctbal) < (SELECT avg(c_acctbal) FROM customer)) THEN 'free' ELSE plan END AS plan FROM pl")
def customer_revert(spark, d):
    c = _t(spark, d, "customer")
    plans = c.select(F.col("c_custkey").alias("user_id"), F.col("c_mktsegment").alias("customer_id"), F.lit("pro").alias("plan"))
    below = c.groupBy(F.col("c_mktsegment").alias("customer_id")).agg(F.avg("c_acctbal").alias("m")).join(F.broadcast(c.agg(F.avg("c_acctbal").alias("all"))), F.col("m") < F.col("all"))
    return metering.customer_of(plans, below)


@_query("SELECT DISTINCT user_id FROM events")
def distinct_users(spark, d):
    return _events(spark, d).select("user_id").distinct()


@_query("SELECT event_id, user_id FROM events WHERE user_id NOT IN (SELECT c_custkey FROM customer WHERE c_acctbal < 0)")
def delete_users(spark, d):
    gone = _t(spark, d, "customer").where("c_acctbal < 0").select(F.col("c_custkey").alias("user_id"))
    return store.without_users(_events(spark, d), gone).select("event_id", "user_id")


@_query("SELECT event_id, user_id, in_window FROM (SELECT event_id, user_id, count(*) OVER (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL 1 DAY PRECEDING AND CURRENT ROW) AS in_window FROM events) WHERE in_window > 2")
def bot_rate(spark, d):
    """Events that are more than two of a user's within a day."""
    return metering.busy_hours(_events(spark, d), 86400, 2).select("event_id", "user_id", "in_window")


@_query("WITH s AS (SELECT DISTINCT lower(c_mktsegment) AS k FROM customer WHERE c_nationkey < 3) SELECT p_partkey AS id, p_brand AS name FROM part WHERE lower(p_brand) NOT IN (SELECT lower(p_brand) FROM part WHERE p_size < 3) UNION ALL SELECT p_partkey, p_brand FROM part WHERE p_size < 3")
def merge_new_names(spark, d):
    p = _t(spark, d, "part").select(F.col("p_partkey").alias("id"), F.col("p_brand").alias("name"), "p_size")
    return store.merge_new(p.where("p_size < 3").drop("p_size"), p.drop("p_size"))


# --- ordered lines -------------------------------------------------------------


def _turns(spark, d) -> DataFrame:
    return _t(spark, d, "conversations").select("conv_id", "turn", "role", "text")


@_query("SELECT conv_id, turn, CAST(sum(CASE WHEN role = 'user' THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS BIGINT) AS role_id FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def role_running_id(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    return _turns(spark, d).select("conv_id", "turn", "role").distinct().select("conv_id", "turn", F.sum((F.col("role") == "user").cast("long")).over(w).alias("role_id"))


@_query("SELECT conv_id, turn, last_value(CASE WHEN turn % 3 = 0 THEN role || turn END IGNORE NULLS) OVER (PARTITION BY conv_id ORDER BY turn ROWS UNBOUNDED PRECEDING) AS section FROM (SELECT DISTINCT conv_id, turn, role FROM conversations)")
def section_ffill(spark, d):
    w = Window.partitionBy("conv_id").orderBy("turn").rowsBetween(Window.unboundedPreceding, 0)
    head = F.when(F.col("turn") % 3 == 0, F.concat("role", F.col("turn").cast("string")))
    return _turns(spark, d).select("conv_id", "turn", "role").distinct().select("conv_id", "turn", F.last(head, ignorenulls=True).over(w).alias("section"))


@_query("WITH u AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role = 'user'), b AS (SELECT DISTINCT conv_id, turn FROM conversations WHERE role <> 'user') SELECT b.conv_id, b.turn, u.turn AS head FROM b ASOF JOIN u ON b.conv_id = u.conv_id AND b.turn >= u.turn")
def asof_bullets(spark, d):
    """Each line with the last heading at or before it."""
    w = Window.partitionBy("conv_id").orderBy("turn", F.desc("heads")).rowsBetween(Window.unboundedPreceding, 0)
    rows = _turns(spark, d).select("conv_id", "turn", (F.col("role") == "user").alias("heads")).distinct()
    return rows.withColumn("head", F.last(F.when(F.col("heads"), F.col("turn")), ignorenulls=True).over(w)).where(~F.col("heads") & F.col("head").isNotNull()).select("conv_id", "turn", "head")


@_query(f"SELECT conv_id, string_agg(term, ' ' ORDER BY turn, pos) AS skills FROM (SELECT conv_id, term, turn, pos, row_number() OVER (PARTITION BY conv_id, term ORDER BY turn, pos) AS rn FROM (SELECT conv_id, turn, unnest(t) AS term, generate_subscripts(t, 1) AS pos FROM (SELECT DISTINCT conv_id, turn, {_TOKENS} AS t FROM conversations))) WHERE rn = 1 GROUP BY conv_id")
def merge_profiles_skills(spark, d):
    """Skills of all turns of a conversation, first occurrence first."""
    rows = _turns(spark, d).select("conv_id", "turn", X.tokens(F.col("text")).alias("t")).distinct()
    one = rows.groupBy("conv_id").agg(F.array_distinct(F.flatten(F.transform(F.array_sort(F.collect_list(F.struct("turn", "t"))), lambda x: x["t"]))).alias("s"))
    return one.where(F.size("s") > 0).select("conv_id", F.array_join("s", " ").alias("skills"))


_BLOB = """Company: Acme Data
Title: Engineer
Dates: January 2020 to March 2021
- Cut costs by 40% with Spark
* Built 3 pipelines in Python
Organization: Beta
role: Lead
- Reduced latency from 90 ms to 10 ms for users
orphan line
Employer: Gamma"""
_BLOBS = [(1, _BLOB), (2, "- orphan bullet\nTitle: none"), (3, "")]
_BLOB_SQL = f"""WITH l AS (SELECT doc_id, pos, trim(line) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {_values(_BLOBS, "doc_id, text")})),
k AS (SELECT *, regexp_matches(s, '(?i)^(company|employer|org(anization)?)[:\\s]+.+') AS opens FROM l),
k2 AS (SELECT *, NOT opens AND regexp_matches(s, '(?i)^(title|position|role)[:\\s]+.+') AS titled FROM k),
k3 AS (SELECT *, NOT opens AND NOT titled AND regexp_matches(s, '(?i)^(dates?|period|tenure)[:\\s]+(.+?)\\s*(–|-|to)\\s*(.+)') AS dated FROM k2),
r AS (SELECT *, sum(CASE WHEN opens THEN 1 ELSE 0 END) OVER (PARTITION BY doc_id ORDER BY pos) AS role FROM k3)
SELECT doc_id, CAST(role AS INTEGER) AS role,
  max(CASE WHEN opens THEN trim(regexp_extract(s, '(?i)^(?:company|employer|org(?:anization)?)[:\\s]+(.+)', 1)) END) AS company,
  coalesce(arg_max(CASE WHEN titled THEN trim(regexp_extract(s, '(?i)^(?:title|position|role)[:\\s]+(.+)', 1)) END, pos) FILTER (WHERE titled), '') AS title,
  coalesce(arg_max(regexp_extract(s, '(?i)^(?:dates?|period|tenure)[:\\s]+(.+?)\\s*(?:–|-|to)\\s*(.+)', 1), pos) FILTER (WHERE dated), '') AS "start",
  CAST(count(*) FILTER (WHERE NOT opens AND NOT titled AND NOT dated AND (starts_with(s, '- ') OR starts_with(s, '* '))) AS INTEGER) AS n_bullets
FROM r WHERE role > 0 GROUP BY ALL"""


@_query_both(_BLOB_SQL, _BLOBS, "doc_id, text")
def blob_parse(rows):
    p = profile.parse_blob(rows)
    return p.select("doc_id", F.posexplode("profile.experience").alias("at", "r")).select("doc_id", (F.col("at") + 1).alias("role"), "r.company", "r.title", "r.start", F.size("r.bullets").alias("n_bullets"))


_MARKDOWN = [(1, "## Experience\n**Engineer** | Acme | 2020 - 2021\n- Built it with Spark\n- Shipped 5 things\n## Skills\nPython, SQL | Spark\n- Kafka\n## Education\nx"), (2, "## Frameworks & Skills\n**Lead** @ Beta @ 2022\n* Led"), (3, "no sections")]


@_query_both(f"""WITH l AS (SELECT doc_id, pos, trim(line) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {_values(_MARKDOWN, "doc_id, text")})),
x AS (SELECT *, last_value(CASE WHEN starts_with(s, '## ') THEN lower(s[4:]) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT doc_id, trim(regexp_extract(s, '^\\*\\*(.+?)\\*\\*\\s*[|@]\\s*(.+?)\\s*[|@]\\s*(.+)', 1)) AS title, trim(regexp_extract(s, '^\\*\\*(.+?)\\*\\*\\s*[|@]\\s*(.+?)\\s*[|@]\\s*(.+)', 2)) AS company, trim(regexp_extract(s, '^\\*\\*(.+?)\\*\\*\\s*[|@]\\s*(.+?)\\s*[|@]\\s*(.+)', 3)) AS "start"
FROM x WHERE (contains(section, 'experience') OR contains(section, 'work')) AND regexp_matches(s, '^\\*\\*(.+?)\\*\\*\\s*[|@]\\s*(.+?)\\s*[|@]\\s*(.+)')""", _MARKDOWN, "doc_id, text")
def markdown_parse(rows):
    p = profile.parse_markdown(rows)
    return p.select("doc_id", F.explode("profile.experience").alias("r")).select("doc_id", "r.title", "r.company", "r.start")


@_query_both(f"""WITH l AS (SELECT doc_id, pos, trim(line) AS s FROM (SELECT doc_id, unnest(string_split(text, chr(10))) AS line, generate_subscripts(string_split(text, chr(10)), 1) AS pos FROM {_values(_MARKDOWN, "doc_id, text")})),
x AS (SELECT *, last_value(CASE WHEN starts_with(s, '## ') THEN lower(s[4:]) END IGNORE NULLS) OVER (PARTITION BY doc_id ORDER BY pos ROWS UNBOUNDED PRECEDING) AS section FROM l)
SELECT doc_id, skill, count(*) AS n FROM (SELECT doc_id, unnest(list_filter(list_transform(string_split_regex(s, '[,|•]'), lambda k: trim(k, ' -*')), lambda k: k <> '')) AS skill FROM x WHERE contains(section, 'skill') AND NOT contains(section, 'experience') AND NOT contains(section, 'work') AND NOT starts_with(s, '## ') AND s <> '') GROUP BY ALL""", _MARKDOWN, "doc_id, text")
def markdown_skills(rows):
    p = profile.parse_markdown(rows)
    return p.select("doc_id", F.explode("profile.skills").alias("skill")).groupBy("doc_id", "skill").agg(F.count("*").alias("n"))


@_query()
def latex_parse(spark, d):
    tex = "\\section{Experience}\n\\resumeSubheading{Engineer}{Jan 2020 -- Present}{Acme}{Berlin}\n\\resumeItemListStart\n\\resumeItem{Cut cost by \\textbf{40\\%} with \\href{u}{Spark}}\n\\section{Education}\n\\resumeSubheading{Uni}{City}{MSc}{2019}\n\\section{Technical Skills}\n\\textbf{Languages}{: Python, SQL}"
    return parse_arrow.parse_latex(_docs(spark, d).unionByName(spark.createDataFrame([(-1, tex)], "doc_id long, text string")))


@_query()
def plain_parse(spark, d):
    return parse_arrow.parse_plain(_docs(spark, d))


_TEMPLATE = "Dear {{NAME}}, {{BODY}} {{MISSING_KEY}} {{name}}"


@_query("SELECT c_custkey, replace(replace('Dear {{NAME}}, {{BODY}} {{MISSING_KEY}} {{name}}', '{{NAME}}', c_name), '{{BODY}}', 'segment ' || c_mktsegment) AS filled, '{{MISSING_KEY}}' AS unfilled FROM customer")
def template_fill(spark, d):
    rows = _t(spark, d, "customer").select("c_custkey", render.fill(F.lit(_TEMPLATE), {"NAME": F.col("c_name"), "BODY": F.concat(F.lit("segment "), "c_mktsegment")}).alias("filled"))
    return rows.withColumn("unfilled", F.array_join(render.unfilled(F.col("filled")), ","))


@_query(f"""SELECT doc_id, md5('\\section{{Certifications}}' || chr(10) || ' \\begin{{itemize}}[leftmargin=0.15in, label={{}}]' || chr(10) || '    \\small{{\\item{{ ' || array_to_string(list_transform({_WORDS}[1:3], lambda w: {_escape_sql("w")}), ' $|$ ') || ' }}}}' || chr(10) || ' \\end{{itemize}}') AS block FROM documents WHERE len({_WORDS}) > 0""")
def render_certifications(spark, d):
    rows = _docs(spark, d).withColumn("w", F.slice(X.words(F.lower("text")), 1, 3)).where(F.size("w") > 0)
    return rows.select("doc_id", F.md5(render.certifications(F.col("w")).cast("binary")).alias("block"))


@_query()
def render_profile(spark, d):
    """Each blob résumé as a whole LaTeX document."""
    p = profile.parse_blob(_docs(spark, d).unionByName(spark.createDataFrame([(-i, t) for i, t in _BLOBS], "doc_id long, text string")))
    return p.select("doc_id", render.build(F.col("profile"), F.lit("{{NAME}}\n{{EXPERIENCE_SECTION}}\n{{SKILLS_SECTION}}\n{{EDUCATION_SECTION}}"), {"NAME": F.lit("A & B")}).alias("tex"))


_STAR = f"list_contains({_list(X.ACTION_VERBS)}, lower(regexp_extract(text, '^[^0-9A-Za-z_]*([0-9A-Za-z_]+)', 1)))"


@_query_both(f"SELECT id, {_STAR} AS has_action, len({_METRICS_SQL}) > 0 AS has_result, CAST(len(list_filter(string_split_regex(text, '\\s+'), lambda w: w <> '')) AS INTEGER) AS word_count, CAST({_STAR} AS INTEGER) + CAST(len({_METRICS_SQL}) > 0 AS INTEGER) AS star_score FROM {_values(_TRAPS, 'id, text')}", _TRAPS)
def star_score(rows):
    s = X.star_score(F.col("text"), X.metrics(F.col("text")))
    return rows.select("id", s.alias("s")).select("id", "s.has_action", "s.has_result", "s.word_count", "s.star_score")


@_query_both(f"""SELECT id, round(0.4 * least(m, 2) / 2 + 0.2 * least(t, 2) / 2 + 0.4 * CASE WHEN m >= 2 THEN 1.0 WHEN m = 1 THEN 0.5 ELSE 0.0 END, 4) AS quality FROM (SELECT id, len({_METRICS_SQL}) AS m, len(list_filter({_list(vocab.TOOLS)}, lambda t: contains(lower(text), lower(t)))) AS t FROM {_values(_TRAPS, 'id, text')})""", _TRAPS)
def bullet_quality(rows):
    m = X.metrics(F.col("text"))
    return rows.select("id", X.bullet_quality(m, X.tools(F.col("text")), X.confidence(m)).alias("quality"))


_COMPANIES = [(1, "Come and join Acme Data. We hire."), (2, "Beta Labs is growing"), (3, "an engineer at Gamma & Co needs SQL"), (4, "nothing here"), (5, "")]
_NAME = r"([A-Z][A-Za-z0-9&.]*(?: [A-Z][A-Za-z0-9&.]*){0,3})"


@_query_both(f"SELECT id, rtrim(CASE WHEN regexp_extract(text, {_q(chr(92) + 'b(?:at|At|join|Join) ' + _NAME)}, 1) <> '' THEN regexp_extract(text, {_q(chr(92) + 'b(?:at|At|join|Join) ' + _NAME)}, 1) ELSE regexp_extract(text, {_q('(?m)^' + _NAME + ' is' + chr(92) + 'b')}, 1) END, '.') AS company FROM {_values(_COMPANIES, 'id, text')}", _COMPANIES, table="benchmark")
def company_from_jd(rows):
    return rows.select("id", extras.company_of(F.col("text")).alias("company"))


_READMES = [(1, "# T\n- short\n- a bullet that is long enough\n-- no\n- another one that is long\n- third of the long bullets\n- a fourth long bullet line"), (2, ""), (3, "no dashes at all here")]


@_query_both(f"SELECT id, coalesce(array_to_string(list_filter(list_transform(list_filter(string_split(text, chr(10)), lambda l: starts_with(trim(l), '- ')), lambda l: trim(trim(l)[3:])), lambda l: length(l) > 15)[1:3], '|'), '') AS bullets FROM {_values(_READMES, 'id, text')}", _READMES)
def readme_bullets(rows):
    return rows.select("id", F.array_join(extras.readme_bullets(F.col("text")), "|").alias("bullets"))


@_query("SELECT p_brand, p_partkey, p_name FROM (SELECT p_brand, p_partkey, p_name, row_number() OVER (PARTITION BY p_brand ORDER BY p_retailprice DESC, p_name) AS rn FROM part WHERE NOT (p_size % 2 = 0)) WHERE rn <= 3")
def own_repositories(spark, d):
    """Parts stand in for repositories: the brand owns them, even sizes are forks, the price is the date."""
    rows = _t(spark, d, "part").select(F.col("p_brand").alias("user"), F.col("p_name").alias("name"), (F.col("p_size") % 2 == 0).alias("is_fork"), F.col("p_retailprice").alias("updated"), "p_partkey")
    return extras.own_repositories(rows, 3).select(F.col("user").alias("p_brand"), "p_partkey", F.col("name").alias("p_name"))


@_query("SELECT user_id, filename FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY filename DESC) AS rn FROM (SELECT DISTINCT user_id, CASE WHEN event_id % 2 = 0 THEN event_id || '.tex' ELSE event_id || '.meta.json' END AS filename FROM events) WHERE filename LIKE '%.tex') WHERE rn <= 2")
def version_listing(spark, d):
    name = F.concat(F.col("event_id").cast("string"), F.when(F.col("event_id") % 2 == 0, ".tex").otherwise(".meta.json"))
    return extras.versions(_events(spark, d).select("user_id", name.alias("filename")).distinct(), 2).select("user_id", "filename")


@_query(f"{_FIXED} SELECT jd_id, doc_id, score AS formula, score AS model FROM scores")
def score_compare(spark, d):
    return extras.compare(_jds(spark, d), _docs(spark, d))


def _buckets(table: str, key: str) -> str:
    return f"(SELECT {key}, b, count(*) AS n FROM (SELECT {key}, CAST(('0x' || right(md5(unnest({_WORDS})), 2))::INT % 128 AS INTEGER) AS b FROM {table}) GROUP BY ALL)"


@_query(f"""WITH a AS {_buckets("documents", "doc_id")}, b AS {_buckets("benchmark", "item_id")}, na AS (SELECT doc_id, sum(n * n) AS s FROM a GROUP BY ALL), nb AS (SELECT item_id, sum(n * n) AS s FROM b GROUP BY ALL),
dots AS (SELECT item_id, doc_id, sum(a.n * b.n) AS dot FROM a JOIN b USING (b) GROUP BY ALL)
SELECT j.item_id AS jd_id, d.doc_id, CAST(least(floor(coalesce(dot / (sqrt(na.s) * sqrt(nb.s)), 0) * 100 + 1e-9), 100) AS INTEGER) AS score, 'embedding (tfidf fallback)' AS method_used
FROM benchmark j CROSS JOIN documents d LEFT JOIN na ON na.doc_id = d.doc_id LEFT JOIN nb ON nb.item_id = j.item_id LEFT JOIN dots ON dots.doc_id = d.doc_id AND dots.item_id = j.item_id""")
def embedding_score(spark, d):
    return extras.score(_jds(spark, d), _docs(spark, d), "embedding")


@_query("SELECT c_custkey, 'Dear hiring team, I would like to join ' || c_mktsegment || '. My work includes SQL, Spark. Sincerely, ' || c_name AS txt FROM customer")
def cover_letter(spark, d):
    letter = extras.cover_letter(F.col("c_name"), F.col("c_mktsegment"), F.array(F.lit("SQL"), F.lit("Spark")))
    return _t(spark, d, "customer").select("c_custkey", letter.alias("l")).select("c_custkey", "l.txt")


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    from . import more_queries, order_queries, source_queries  # noqa: F401  register their own

    return dict(_QUERIES)


def oracles() -> dict[str, str]:
    from . import more_queries, order_queries, source_queries  # noqa: F401

    return dict(_ORACLES)


