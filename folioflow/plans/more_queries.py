"""Further queries: line flags, normalisers, profiles, rendering, layout and metering, each with its SQL over whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab
from ..operators import extras, layout, metering, profile, render
from .catalog import _HEADS, _docs, _events, _list, _q, _query, _t, _turns, _values

_STRIP = "regexp_replace({0}, '^\\s+|\\s+$', '', 'g')".format
_TOOL_LIST = f"list_filter({_list(vocab.TOOLS)}, lambda x: contains(lower(b), lower(x)))"


def _digest(column: str) -> Column:
    return F.sha2(F.col(column).cast("binary"), 256)


# --- lines -------------------------------------------------------------------

_BULLET = "regexp_matches(line, '^(?:[•–*·○▪-]|(?:x|ffi|j)\\s+\\S)')"
_CLEAN = _STRIP(f"rtrim(lower({_STRIP('line')}), ':')")
_EXACT = "CASE " + " ".join(f"WHEN c IN ({', '.join(map(_q, a))}) THEN {_q(n)}" for n, a in vocab.SECTIONS.items()) + " END"
_INSIDE = "CASE " + " ".join(f"WHEN {' OR '.join(f'contains(c, {_q(x)})' for x in a)} THEN {_q(n)}" for n, a in vocab.SECTIONS.items()) + " END"
_LINES = f"(SELECT doc_id AS id, CAST(generate_subscripts(l, 1) - 1 AS INTEGER) AS \"at\", unnest(l) AS line FROM (SELECT doc_id, string_split(text, chr(10)) AS l FROM documents) UNION ALL SELECT -id, 0, line FROM {_values(_HEADS, 'id, line')})"


def _flagged(spark, d) -> DataFrame:
    lines = _docs(spark, d).select(F.col("doc_id").alias("id"), F.posexplode(F.split("text", "\n", -1)).alias("at", "line"))
    return lines.unionByName(spark.createDataFrame([(-i, 0, x) for i, x in _HEADS], "id long, at int, line string"))


@_query(f"""SELECT id, "at", coalesce({_EXACT}, CASE WHEN length(c) < 50 AND length(regexp_replace(c, '[^\\p{{L}} ]', '', 'g')) / greatest(length(c), 1) > 0.85 THEN {_INSIDE} END) AS section,
  regexp_matches(line, '^\\p{{Lu}}') AND len(regexp_extract_all(line, '\\S+')) <= 8 AND length(line) <= 80 AND NOT {_BULLET} AS titled, {_BULLET} AS bullet FROM (SELECT *, {_CLEAN} AS c FROM {_LINES})""")
def section_headers(spark, d):
    """Every line of the documents, and the inline lines under negated ids."""
    return _flagged(spark, d).select("id", "at", X.section_of(F.col("line")).alias("section"), X.is_title_like(F.col("line")).alias("titled"), X.is_bullet(F.col("line")).alias("bullet"))


_DATE_ROWS = [(1, "Engineer, Jan 2020 – Present"), (2, "2019-2021 work"), (3, "Q3 2020"), (4, "since 2020"), (5, "may 20"), (6, "1999 - Now")]


@_query(f"SELECT id, regexp_matches(text, '(?i)(?:{vocab.DATE})') AS dated FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -id, text FROM {_values(_DATE_ROWS, 'id, text')})")
def date_pattern(spark, d):
    rows = _docs(spark, d).select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame([(-i, t) for i, t in _DATE_ROWS], "id long, text string"))
    return rows.select("id", X.has_date(F.col("text")).alias("dated"))


_T_ROWS = [(1, "Jan 2020 t Present"), (2, "2019 t Mar 2021 and 2020  t now"), (3, "2019 to 2020"), (4, "12345 t May")]


@_query(f"SELECT id, sha256(regexp_replace(text, '(?i)([0-9]{{4}})\\s+t\\s+({vocab.MONTH}|Present|Current|Now)', '\\1 – \\2', 'g')) AS fixed FROM (SELECT doc_id AS id, text FROM documents UNION ALL SELECT -id, text FROM {_values(_T_ROWS, 'id, text')})")
def dash_for_t(spark, d):
    rows = _docs(spark, d).select(F.col("doc_id").alias("id"), "text").unionByName(spark.createDataFrame([(-i, t) for i, t in _T_ROWS], "id long, text string"))
    return rows.withColumn("out", X.dash_for_t(F.col("text"))).select("id", _digest("out").alias("fixed"))


def _ot1_sql(c: str) -> str:
    for a, b in vocab.OT1:
        c = f"replace({c}, {' || '.join(f'chr({ord(x)})' for x in a)}, {_q(b)})"
    return c


@_query(f"SELECT doc_id, sha256({_ot1_sql('text || chr(12) || chr(14) || chr(123)')}) AS mapped FROM documents")
def ot1_map(spark, d):
    """Each text with three glyphs of the font behind it."""
    rows = _docs(spark, d).withColumn("out", X.apply_ot1(F.concat("text", F.lit("\x0c\x0e{"))))
    return rows.select("doc_id", _digest("out").alias("mapped"))


@_query("SELECT p_partkey, array_to_string(list_filter(list_transform(string_split_regex(replace(p_name, ' ', ' ,; '), '[,;]'), lambda x: trim(x)), lambda x: x <> ''), '|') AS parts FROM part")
def tech_split(spark, d):
    return _t(spark, d, "part").select("p_partkey", F.array_join(X.split_list(F.replace("p_name", F.lit(" "), F.lit(" ,; "))), "|").alias("parts"))


@_query("SELECT p_partkey, p_name AS path, CASE WHEN p_size % 2 = 0 THEN lower(p_brand) ELSE 'blob' END AS format FROM part")
def path_format(spark, d):
    given = F.when(F.col("p_size") % 2 == 0, F.concat("p_name", F.lit(":"), F.lower("p_brand"))).otherwise(F.col("p_name"))
    return _t(spark, d, "part").select("p_partkey", X.path_format(given).alias("x")).select("p_partkey", "x.path", "x.format")


# --- profiles ----------------------------------------------------------------


def _of_customers(spark, d) -> DataFrame:
    """A profile of each customer, read from JSON: one role with a rich, a plain and a blank bullet, a project, repeated skills."""
    bullets = F.array(*[F.struct(t.alias("text")) for t in (F.concat(F.lit("Cut cost by 40 ms with Spark for "), "c_name"), F.lit("Wrote "), F.lit("  "))])
    role = F.struct(F.col("c_mktsegment").alias("title"), F.col("c_name").alias("company"), F.lit("2020").alias("start"), F.lit("").alias("end"), bullets.alias("bullets"))
    project = F.struct(F.concat(F.lit("Tool of "), "c_name").alias("name"), F.array(F.lit("SQL"), F.lit("dbt")).alias("tech"), bullets.alias("bullets"), F.lit("2021").alias("date"))
    school = F.struct(F.col("c_name").alias("institution"), F.lit("MSc").alias("degree"), F.lit("2019").alias("dates"), F.lit("A & B").alias("location"))
    whole = F.struct(F.array(role).alias("experience"), F.array(project).alias("projects"), F.array("c_mktsegment", F.lit("SQL"), "c_mktsegment").alias("skills"), F.array(school).alias("education"), F.array(F.lit("Cert 1")).alias("certifications"))
    return _t(spark, d, "customer").select("c_custkey", profile.from_json(F.to_json(whole)).alias("profile"))


_BULLETS = "'Cut cost by 40 ms with Spark for ' || c_name || ' Wrote'"


@_query(f"SELECT c_custkey, c_mktsegment || ' at ' || c_name || ' ' || {_BULLETS} || ' Tool of ' || c_name || ' ' || {_BULLETS} || ' ' || c_mktsegment || ' SQL Cert 1' AS flat FROM customer")
def profile_flatten(spark, d):
    return _of_customers(spark, d).select("c_custkey", profile.flatten(F.col("profile")).alias("flat"))


@_query("SELECT c_custkey, 1 AS roles, 2 AS bullets, 2 AS skills, 1 AS projects, 1 AS enriched FROM customer")
def profile_counts(spark, d):
    return _of_customers(spark, d).select("c_custkey", profile.counts(F.col("profile")).alias("n")).select("c_custkey", "n.*")


@_query("SELECT c_nationkey, count(*) AS roles, CAST(count(*) AS BIGINT) AS projects, (SELECT string_agg(s, '|' ORDER BY f) FROM (SELECT s, min(f) AS f FROM (SELECT c_mktsegment AS s, c_custkey * 10 AS f, c_nationkey AS k FROM customer UNION ALL SELECT 'SQL', c_custkey * 10 + 1, c_nationkey FROM customer) WHERE k = c.c_nationkey GROUP BY s)) AS skills FROM customer c GROUP BY c_nationkey")
def merge_profiles(spark, d):
    """One profile for all customers of a nation."""
    rows = _of_customers(spark, d).join(_t(spark, d, "customer").select("c_custkey", "c_nationkey"), "c_custkey")
    merged = profile.merge(rows, "c_nationkey", "c_custkey")
    return merged.select("c_nationkey", F.size("profile.experience").cast("long").alias("roles"), F.size("profile.projects").cast("long").alias("projects"), F.array_join("profile.skills", "|").alias("skills"))


_STAR_ROWS = "SELECT conv_id, turn, text FROM conversations"


@_query(f"SELECT conv_id, turn, coalesce(text, '') = '' AS blank, n, sum(1) AS rows FROM (SELECT conv_id, turn, text, len(regexp_extract_all(coalesce(text, ''), '\\S+')) > 20 AS n FROM ({_STAR_ROWS})) GROUP BY ALL")
def enforce_star(spark, d):
    """Which turns are too long for a bullet, as the checked bullets say."""
    rows = _t(spark, d, "conversations").select("conv_id", "turn", F.coalesce("text", F.lit("")).alias("text"))
    rows = rows.select("conv_id", "turn", X.enforce_star(F.array(F.struct("text", F.lit("kept").alias("source"))))[0].alias("b")).where("b.source = 'kept' AND b.star_score BETWEEN 0 AND 2")
    return rows.groupBy("conv_id", "turn", (F.col("b.text") == "").alias("blank"), F.array_contains("b.star_violations", "too long").alias("n")).agg(F.count("*").alias("rows"))


_LIMIT = 12
_W = "regexp_extract_all(text, '\\S+')"


@_query(f"""SELECT doc_id, sha256(CASE WHEN len(w) <= {_LIMIT} THEN text WHEN k > 0 THEN array_to_string(w[1:k], ' ') ELSE array_to_string(w[1:{_LIMIT}], ' ') || '...' END) AS cut
FROM (SELECT doc_id, text, w, coalesce(list_max(list_filter(list_transform(range(1, {_LIMIT} + 1), lambda i: CASE WHEN regexp_matches(w[i], '[.!?]$') THEN i ELSE 0 END), lambda x: x IS NOT NULL)), 0) AS k FROM (SELECT doc_id, text, {_W} AS w FROM documents WHERE text IS NOT NULL))""")
def sentence_limit(spark, d):
    rows = _docs(spark, d).where("text IS NOT NULL").withColumn("out", X.sentence_limit(F.col("text"), _LIMIT))
    return rows.select("doc_id", _digest("out").alias("cut"))


# --- rendering ---------------------------------------------------------------

_ESC = "replace(c_name, '#', '\\#')"
_ITEMS = f"'    \\resumeItemListStart' || chr(10) || '      \\resumeItem{{Cut cost by 40 ms with Spark for ' || {_ESC} || '}}' || chr(10) || '      \\resumeItem{{Wrote}}' || chr(10) || '    \\resumeItemListEnd'"
_NL = " || chr(10) || "
_EXPERIENCE = _NL.join(["'\\section{Experience}'", "'  \\resumeSubHeadingListStart'", "''", "'    \\resumeSubheading'", f"'      {{' || c_mktsegment || '}}{{2020 -- }}'", f"'      {{' || {_ESC} || '}}{{}}'", _ITEMS, "''", "'  \\resumeSubHeadingListEnd'"])
_PROJECTS = _NL.join(["'\\section{Projects}'", "'    \\resumeSubHeadingListStart'", "''", "'      \\resumeProjectHeading'", f"'          {{\\textbf{{Tool of ' || {_ESC} || '}} $|$ \\emph{{SQL, dbt}}}}{{2021}}'", _ITEMS, "''", "'    \\resumeSubHeadingListEnd'"])
_EDUCATION = _NL.join(["'\\section{Education}'", "'  \\resumeSubHeadingListStart'", "'    \\resumeSubheading'", f"'      {{' || {_ESC} || '}}{{A \\& B}}'", "'      {MSc}{2019}'", "'  \\resumeSubHeadingListEnd'"])


@_query(f"SELECT c_custkey, {_EXPERIENCE} AS experience, {_PROJECTS} AS projects, {_EDUCATION} AS education FROM customer")
def render_sections(spark, d):
    """A generator makes the three of a customer from one profile; columns apart would each read its JSON again."""
    return _of_customers(spark, d).select("c_custkey", F.inline(F.array(render.sections(F.col("profile")))))


@_query("SELECT c_custkey, unnest(['high', 'medium']) AS priority, unnest([c_name, c_mktsegment]) AS category, unnest(['a, b', '']) AS missing FROM customer")
def summary_rows(spark, d):
    said = F.concat(F.lit("Report\n1. [high] "), "c_name", F.lit("\n   Missing: a, b\n2. [medium] "), "c_mktsegment", F.lit("\n"))
    return _t(spark, d, "customer").select("c_custkey", F.explode(render.summary_rows(said)).alias("x")).select("c_custkey", "x.*")


@_query("SELECT p_partkey, p_name AS name, CASE WHEN p_brand = p_type THEN p_brand ELSE p_brand || '|' || p_type END AS tech, p_type || CASE WHEN p_size >= 10 THEN '|Earned ' || p_size || ' stars' ELSE '' END AS bullets FROM part")
def repository_projects(spark, d):
    """Parts stand in for repositories: the brand is the language, the type topic and description, the size the stars."""
    one = extras.repo_project(F.col("p_name"), F.col("p_type"), F.col("p_brand"), F.array("p_type"), F.col("p_size"), F.lit(None).cast("string"))
    return _t(spark, d, "part").select("p_partkey", one.alias("x")).select("p_partkey", "x.name", F.array_join("x.tech", "|").alias("tech"), F.array_join("x.bullets", "|").alias("bullets"))


# --- layout ------------------------------------------------------------------


@_query("SELECT s_suppkey, CAST(row_number() OVER (PARTITION BY s_nationkey ORDER BY s_acctbal DESC, s_suppkey) AS INTEGER) AS place FROM supplier")
def box_order(spark, d):
    """Suppliers stand in for text boxes: the nation is the page, the balance the height."""
    return layout.box_order(_t(spark, d, "supplier"), "s_nationkey", "s_acctbal", "s_suppkey").select("s_suppkey", "place")


@_query("""SELECT conv_id, CAST(part AS BIGINT) AS part, sha256(string_agg(text, ' ' ORDER BY turn)) AS joined FROM (SELECT conv_id, turn, text, sum(CASE WHEN ends_with(before, '.') AND regexp_matches(text, '^\\p{Lu}') THEN 1 ELSE 0 END) OVER (PARTITION BY conv_id ORDER BY turn) AS part
FROM (SELECT *, lag(text) OVER (PARTITION BY conv_id ORDER BY turn) AS before FROM (SELECT conv_id, turn, min(coalesce(text, '')) AS text FROM conversations GROUP BY ALL))) GROUP BY ALL""")
def merged_sentences(spark, d):
    """Turns stand in for lines."""
    rows = _t(spark, d, "conversations").groupBy("conv_id", "turn").agg(F.min(F.coalesce("text", F.lit(""))).alias("text"))
    return layout.merged_sentences(rows, "conv_id", "turn", "text").select("conv_id", "part", _digest("text").alias("joined"))


# --- metering ----------------------------------------------------------------


@_query("SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n FROM events WHERE hour(ts) < 6 GROUP BY ALL HAVING count(*) > 2")
def night_bulk(spark, d):
    return metering.night_bulk(_events(spark, d), limit=2)


@_query("SELECT event_id FROM (SELECT event_id, count(*) OVER (PARTITION BY user_id, event_type ORDER BY epoch_us(ts) RANGE BETWEEN 864000000000 PRECEDING AND CURRENT ROW) AS n FROM events) WHERE n > 10")
def repeated_requests(spark, d):
    """The type stands in for the description; ten days, as events are far apart here."""
    return metering.repeated_requests(_events(spark, d), "event_type", seconds=864_000, limit=10).select("event_id")


@_query("SELECT event_id, strftime(date_trunc('month', ts) - INTERVAL 28 DAY, '%Y-%m') AS back_1, strftime(date_trunc('month', ts) - INTERVAL 56 DAY, '%Y-%m') AS back_2 FROM events")
def seed_months(spark, d):
    return _events(spark, d).select("event_id", metering.seed_month(F.col("ts"), 1).alias("back_1"), metering.seed_month(F.col("ts"), 2).alias("back_2"))


@_query("SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS resume_count, 'free' AS plan, CAST(NULL AS VARCHAR) AS customer_id FROM events GROUP BY ALL")
def usage_schema_evolution(spark, d):
    return metering.with_plan_columns(metering.monthly_usage(_events(spark, d)))
