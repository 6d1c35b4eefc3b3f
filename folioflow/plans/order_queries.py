"""Queries whose result hangs on an order: lines and columns of a page, lookahead, brackets, as-of joins, keyed tables."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import keyed_table, layout, lines, profile, temporal, vector_index
from ..session import scratch_folder
from ..streaming import usage as stream_usage
from .catalog import _COS, _TYPES, _docs, _events, _query, _t, _values
from .more_queries import _digest
from .source_queries import event_stream

# --- lines and columns of a page -----------------------------------------------

#: Customers stand in for text pieces: the nation is the page, the balance the height.
_PIECES = "SELECT c_nationkey AS page, c_acctbal / 40 AS y, CAST((c_custkey * 37) % 600 AS DOUBLE) AS x, c_name AS text FROM customer"
#: Two clusters of starts, apart by more the greater the page's number; some pieces are marks without letters.
_CLUSTERS = "SELECT c_nationkey AS page, c_acctbal / 40 AS y, CAST((c_custkey * 7) % 40 + (c_custkey % 2) * (30 + 2 * c_nationkey) AS DOUBLE) AS x, CASE WHEN c_custkey % 3 = 0 THEN '-' ELSE c_name END AS text FROM customer"


def _lines_sql(pieces: str, keys: str) -> str:
    """The lines of pieces, each line's first height found from the one before it by recursion."""
    on = " AND ".join(f"a.{k} = p.{k}" for k in keys.split(", "))
    a_keys = ", ".join(f"a.{k}" for k in keys.split(", "))
    p_keys = ", ".join(f"p.{k}" for k in keys.split(", "))
    return f"""p AS (SELECT * FROM ({pieces})),
a AS (SELECT {keys}, max(y) AS y, 1 AS line FROM p GROUP BY {keys}
  UNION ALL SELECT {a_keys}, max(p.y), a.line + 1 FROM a JOIN p ON {on} AND a.y - p.y > 3 GROUP BY {a_keys}, a.line),
n AS (SELECT {p_keys}, p.x, p.text, max(a.line) AS line FROM p JOIN a ON {on} AND a.y >= p.y GROUP BY {p_keys}, p.x, p.y, p.text),
s AS (SELECT *, CASE WHEN x - lag(x) OVER w > CAST(length(lag(text) OVER w) AS DOUBLE) * CAST(4.0 AS DOUBLE) * CAST(1.1 AS DOUBLE) THEN ' ' ELSE '' END AS sep FROM n WINDOW w AS (PARTITION BY {keys}, line ORDER BY x, text)),
l AS (SELECT {keys}, line, string_agg(sep || text, '' ORDER BY x, text) AS text FROM s GROUP BY {keys}, line)"""


@_query(f"WITH RECURSIVE {_lines_sql(_PIECES, 'page')} SELECT page, CAST(line AS INTEGER) AS line, text FROM l")
def page_lines(spark, d):
    pieces = _t(spark, d, "customer").select(F.col("c_nationkey").alias("page"), (F.col("c_acctbal") / 40).alias("y"), ((F.col("c_custkey") * 37) % 600).cast("double").alias("x"), F.col("c_name").alias("text"))
    return layout.page_lines(pieces)


_GAPS = f"""c AS (SELECT page, x, count(*) AS n FROM ({_CLUSTERS}) GROUP BY page, x),
g AS (SELECT page, x, n, lag(x) OVER (PARTITION BY page ORDER BY x) AS before FROM c),
b AS (SELECT page, sum(n) AS n, max(x - before) AS wide, arg_max((x + before) / 2, (x - before, -x)) FILTER (WHERE before IS NOT NULL) AS split FROM g GROUP BY page),
q AS (SELECT k.*, CASE WHEN b.wide >= 18 AND b.n > 4 AND k.x >= b.split THEN 2 ELSE 1 END AS col FROM ({_CLUSTERS}) k JOIN b ON b.page = k.page)"""


@_query(f"""WITH RECURSIVE {_GAPS}, {_lines_sql("SELECT * FROM q", "page, col")}
SELECT page, col AS "column", CAST(line AS INTEGER) AS line, text FROM l
WHERE length(text) >= 2 AND (length(regexp_replace(text, '[^\\p{{L}}]', '', 'g')) / length(text) >= 0.25 OR regexp_matches(text, '\\p{{Nd}}'))""")
def column_lines(spark, d):
    key = F.col("c_custkey")
    pieces = _t(spark, d, "customer").select(
        F.col("c_nationkey").alias("page"),
        (F.col("c_acctbal") / 40).alias("y"),
        ((key * 7) % 40 + (key % 2) * (30 + 2 * F.col("c_nationkey"))).cast("double").alias("x"),
        F.when(key % 3 == 0, "-").otherwise(F.col("c_name")).alias("text"),
    )
    return layout.column_lines(pieces)


_BOX_TEXT = "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN c_name || '.' || chr(10) || c_mktsegment WHEN 2 THEN ' ' || c_name || chr(10) || ' ' || chr(10) || c_mktsegment ELSE c_name || chr(10) || lower(c_mktsegment) END"
_BOX_LINES = "CASE c_custkey % 4 WHEN 0 THEN c_name WHEN 1 THEN '• ' || c_name || '.' || chr(10) || '• ' || c_mktsegment WHEN 2 THEN '• ' || c_name || chr(10) || '• ' || c_mktsegment ELSE c_name || chr(10) || lower(c_mktsegment) END"
_BOX_X = "(c_custkey * 11) % 50 + 0.5 + (c_custkey % 3) * (8 * c_nationkey)"


@_query(f"""WITH b AS (SELECT c_nationkey AS page, CAST({_BOX_X} AS DOUBLE) AS x, c_acctbal AS y, c_custkey, {_BOX_LINES} AS body FROM customer),
s AS (SELECT DISTINCT page, round_even(x, 0) AS r FROM b), g AS (SELECT page, r, lag(r) OVER (PARTITION BY page ORDER BY r) AS before FROM s),
t AS (SELECT page, max(r - before) AS wide, arg_max((r + before) / 2, (r - before, -r)) AS split FROM g WHERE before IS NOT NULL AND r <= 306 GROUP BY page),
o AS (SELECT b.*, coalesce(t.wide > 15 AND b.x >= t.split, false) AS "right" FROM b LEFT JOIN t ON t.page = b.page)
SELECT page, sha256(coalesce(string_agg(body, chr(10) ORDER BY y DESC, x) FILTER (WHERE "right") || chr(10) || chr(10), '') || string_agg(body, chr(10) ORDER BY y DESC, x) FILTER (WHERE NOT "right")) AS text FROM o GROUP BY page""")
def page_text(spark, d):
    """Text boxes in reading order, the right column first, with their sentences as bullets; boxes of one place in the order of their keys."""
    boxes = _t(spark, d, "customer").select("c_custkey", F.col("c_nationkey").alias("page"), F.expr(f"CAST({_BOX_X} AS DOUBLE)").alias("x0"), F.col("c_acctbal").alias("y1"), F.expr(_BOX_TEXT.replace("chr(10)", "char(10)")).alias("text"))
    return layout.page_text(boxes, at="c_custkey").select("page", _digest("text").alias("text"))


# --- lookahead -------------------------------------------------------------------

#: Lines by kind: what they say, whether they have dates, what their head names, whether they are title-like or bullets.
_KINDS = [
    (0, "Jan 2020 – Mar 2021", "Jan 2020 – Mar 2021", "", "", "", True, False),
    (1, "Senior Engineer: Acme, Rome", "", "Senior Engineer", "Acme", "Rome", True, False),
    (2, "Data Lead | Beta Corp", "", "Data Lead", "Beta Corp", "", True, False),
    (3, "Analyst  Gamma  2019-2021", "2019-2021", "Analyst", "Gamma", "", True, False),
    (4, "Manager Jan 2022 – Present", "Jan 2022 – Present", "Manager", "", "", True, False),
    (5, "- did things", "", "- did things", "", "", False, True),
    (6, "Delta Works  Oslo", "", "Delta Works", "Oslo", "", True, False),
]
_TURNS_SQL = "SELECT DISTINCT conv_id, turn, CAST((conv_id * 5 + turn * 3 + length(role)) % 7 AS INTEGER) AS k FROM conversations"


def _turn_lines(spark, d, kind: str, kinds: list[tuple]) -> DataFrame:
    """Turns of conversations as lines of a few kinds."""
    said = F.create_map(*[F.lit(x) for k in kinds for x in (k[0], k[1])])
    rows = _t(spark, d, "conversations").selectExpr("conv_id", "turn", f"CAST({kind} AS INT) AS k").distinct()
    # a turn that two roles share is two lines
    return rows.select("conv_id", (F.col("turn") * 10 + F.col("k")).alias("at"), F.element_at(said, F.col("k")).alias("line"))


_NAMED = f"{_values(_KINDS, 'k, line, dates, title, company, location, titled, bullet')}"


@_query(f"""WITH RECURSIVE v AS {_NAMED}, t AS ({_TURNS_SQL}),
r AS (SELECT t.conv_id, turn * 10 + t.k AS "at", row_number() OVER w AS rn, v.*, lead(t.k, 1) OVER w AS k1, lead(t.k, 2) OVER w AS k2 FROM t JOIN v ON v.k = t.k WINDOW w AS (PARTITION BY conv_id ORDER BY turn, t.k)),
f AS (SELECT r.*, n.line AS line1, n.dates AS dates1, n.titled AS titled1, n.bullet AS bullet1, m.dates AS dates2,
  CASE WHEN r.dates <> '' THEN 'dated' WHEN n.dates <> '' AND r.titled THEN 'two' WHEN m.dates <> '' AND r.titled AND n.titled THEN 'three' END AS shape FROM r LEFT JOIN v n ON n.k = r.k1 LEFT JOIN v m ON m.k = r.k2),
b AS (SELECT *, coalesce(shape = 'dated' AND company = '' AND line1 IS NOT NULL AND dates1 = '' AND NOT bullet1, false) AS borrows FROM f),
u AS (SELECT *, CASE WHEN shape = 'three' THEN 3 WHEN shape = 'two' OR borrows THEN 2 ELSE 1 END AS used FROM b),
w AS (SELECT conv_id, CAST(1 AS BIGINT) AS rn FROM (SELECT DISTINCT conv_id FROM t) UNION ALL SELECT w.conv_id, w.rn + u.used FROM w JOIN u ON u.conv_id = w.conv_id AND u.rn = w.rn)
SELECT u.conv_id, u."at", shape, CAST(used AS INTEGER) AS used, CASE WHEN shape = 'three' THEN line ELSE title END AS title,
  CASE WHEN borrows THEN trim(string_split_regex(line1, '\\s{{2,}}')[1]) WHEN shape = 'three' THEN line1 ELSE company END AS company,
  CASE WHEN borrows THEN coalesce(trim(string_split_regex(line1, '\\s{{2,}}')[2]), '') WHEN shape = 'three' THEN '' ELSE location END AS location,
  CASE shape WHEN 'dated' THEN dates WHEN 'two' THEN dates1 ELSE dates2 END AS dates
FROM u JOIN w ON w.conv_id = u.conv_id AND w.rn = u.rn WHERE shape IS NOT NULL""")
def role_headers(spark, d):
    """Role headers of one to three lines among the turns; lines that one uses up open none of their own."""
    return lines.role_headers(_turn_lines(spark, d, "(conv_id * 5 + turn * 3 + length(role)) % 7", _KINDS), "conv_id", "at")


_SCHOOLS = [(0, "Test University", False, False, True), (1, "Master of Things", False, True, False), (2, "2019 - 2021", True, False, False), (3, "other words", False, False, False), (4, "Bachelor of Arts, Some College", False, True, True), (5, "- bullet 2019 - 2021", True, False, False), (6, "MBA 2019 - 2020", True, True, False)]


@_query(f"""WITH RECURSIVE v AS {_values(_SCHOOLS, 'k, line, dated, degree, school')},
t AS (SELECT DISTINCT conv_id, turn, CAST((conv_id * 3 + turn * 5 + length(role)) % 7 AS INTEGER) AS k FROM conversations),
r AS (SELECT conv_id, row_number() OVER (PARTITION BY conv_id ORDER BY turn, t.k) AS rn, v.* FROM t JOIN v ON v.k = t.k WHERE t.k <> 5),
s AS (SELECT conv_id, CAST(0 AS BIGINT) AS rn, CAST(0 AS BIGINT) AS entry, false AS has, '' AS act, '' AS line FROM (SELECT DISTINCT conv_id FROM r)
  UNION ALL SELECT r.conv_id, r.rn,
    CASE WHEN s.entry > 0 AND r.dated AND NOT r.school THEN s.entry WHEN s.entry > 0 AND r.degree THEN s.entry + CAST(s.has AS BIGINT) WHEN r.school OR r.dated THEN s.entry + 1 ELSE s.entry END,
    CASE WHEN s.entry > 0 AND r.dated AND NOT r.school THEN s.has WHEN s.entry > 0 AND r.degree THEN NOT s.has WHEN r.school OR r.dated THEN false ELSE s.has END,
    CASE WHEN s.entry > 0 AND r.dated AND NOT r.school THEN 'dates' WHEN s.entry > 0 AND r.degree THEN CASE WHEN s.has THEN 'open' ELSE 'degree' END WHEN r.school OR r.dated THEN 'open' ELSE '' END, r.line
  FROM s JOIN r ON r.conv_id = s.conv_id AND r.rn = s.rn + 1)
SELECT conv_id, entry, max(line) FILTER (WHERE act = 'open') AS institution, coalesce(max(line) FILTER (WHERE act = 'degree'), '') AS degree, coalesce(arg_max(line, rn) FILTER (WHERE act = 'dates'), '') AS dates
FROM s WHERE entry > 0 AND act <> '' GROUP BY conv_id, entry""")
def education_entries(spark, d):
    """Entries of schools from the turns; the SQL steps through the lines with the open entry as its state."""
    return lines.education_entries(_turn_lines(spark, d, "(conv_id * 3 + turn * 5 + length(role)) % 7", _SCHOOLS), "conv_id", "at")


# --- brackets --------------------------------------------------------------------

#: Nested and unbalanced braces beside the documents, whose commas open and full stops close.
_NESTED = [(1, "\\item{a{b}{c}}{d} {e}\n{f}x{g}"), (2, "}}{a{b}"), (3, "{{{}}}{}"), (4, ""), (5, "{a} \t{b"), (6, "é{ü{ö}}{日}")]
_BRACED = f"(SELECT doc_id, translate(text, ',.', '{{}}') AS text FROM documents UNION ALL SELECT -id, text FROM {_values(_NESTED, 'id, text')})"
_BRACE_SQL = f"""WITH d AS (SELECT doc_id, text FROM {_BRACED}),
x AS (SELECT doc_id, unnest(c) AS ch, generate_subscripts(c, 1) AS pos FROM (SELECT doc_id, string_split(text, '') AS c FROM d)),
z AS (SELECT doc_id, pos, ch = '{{' AS opens, sum(CASE WHEN ch = '{{' THEN 1 ELSE -1 END) OVER (PARTITION BY doc_id ORDER BY pos) AS depth FROM x WHERE ch IN ('{{', '}}')),
g AS (SELECT o.doc_id, o.pos AS a, o.depth AS level, k.pos AS b FROM (SELECT * FROM z WHERE opens) o ASOF JOIN (SELECT * FROM z WHERE NOT opens) k ON o.doc_id = k.doc_id AND o.depth = k.depth + 1 AND o.pos < k.pos)"""


def _braced(spark, d) -> DataFrame:
    return _docs(spark, d).withColumn("text", F.translate("text", ",.", "{}")).unionByName(spark.createDataFrame([(-i, t) for i, t in _NESTED], "doc_id long, text string"))


@_query(f"{_BRACE_SQL} SELECT g.doc_id, a - 1 AS open, b - 1 AS close, CAST(level AS BIGINT) AS level, sha256(substr(text, a + 1, b - a - 1)) AS inside FROM g JOIN d ON d.doc_id = g.doc_id")
def brace_groups(spark, d):
    texts = _braced(spark, d)
    found = lines.brace_groups(texts).join(texts, "doc_id")
    inside = F.substring(F.col("text"), (F.col("open") + 2).cast("int"), (F.col("close") - F.col("open") - 1).cast("int"))
    return found.select("doc_id", "open", "close", "level", F.sha2(inside.cast("binary"), 256).alias("inside"))


@_query(f"""{_BRACE_SQL}, n AS (SELECT g.*, k.pos AS next FROM g ASOF LEFT JOIN (SELECT * FROM x WHERE ch NOT IN (' ', chr(9), chr(10), chr(13))) k ON g.doc_id = k.doc_id AND g.b < k.pos)
SELECT n.doc_id, n.a - 1 AS "at", CASE WHEN m.a IS NULL THEN 1 ELSE 2 END AS n, sha256(substr(text, n.a + 1, n.b - n.a - 1) || coalesce('|' || substr(text, m.a + 1, m.b - m.a - 1), '')) AS args
FROM n JOIN d ON d.doc_id = n.doc_id LEFT JOIN g m ON m.doc_id = n.doc_id AND m.a = n.next""")
def brace_args(spark, d):
    """Two groups at most from every opening brace on."""
    return lines.brace_args(_braced(spark, d), 2).select("doc_id", "at", F.size("args").alias("n"), F.sha2(F.array_join("args", "|").cast("binary"), 256).alias("args"))


# --- as-of joins and counts along time ------------------------------------------------


@_query(_TYPES + ", c AS (SELECT user_id, ts, event_id AS changed_by, CASE WHEN event_type = up THEN 'pro' ELSE 'free' END AS plan FROM events, t WHERE event_type IN (up, down)) SELECT e.event_id, c.plan, c.changed_by FROM events e ASOF LEFT JOIN c ON e.user_id = c.user_id AND e.ts >= c.ts")
def plan_asof(spark, d):
    """Each event with the plan its user had then; a user's rows are spread over buckets of a week."""
    rows = _events(spark, d)
    kinds = rows.agg(F.min("event_type").alias("up"), F.max("event_type").alias("down")).first()
    changes = rows.where(F.col("event_type").isin(*kinds)).select("user_id", "ts", F.col("event_id").alias("changed_by"), F.when(F.col("event_type") == kinds["up"], "pro").otherwise("free").alias("plan"))
    return temporal.asof(rows, changes, "user_id", "ts", ["plan", "changed_by"], width=7 * 86_400_000_000, tie="changed_by").select("event_id", "plan", "changed_by")


# --- keyed table, stream ---------------------------------------------------------------


@_query("SELECT c_custkey AS id, CASE WHEN c_custkey % 10 = 3 THEN 'changed' ELSE c_name END AS name, CASE WHEN c_custkey % 10 = 3 THEN 2 ELSE 1 END AS seq FROM customer WHERE c_acctbal >= 0")
def keyed_upsert_delete(spark, d):
    """Customers written to a bucketed table, a tenth upserted (an older and a newer row each), those in debt deleted."""
    c = _t(spark, d, "customer")
    table = keyed_table.KeyedTable(spark, scratch_folder(spark, "keyed"), "id", "id long, name string, seq int", buckets=16)
    table.upsert(c.select(F.col("c_custkey").alias("id"), F.col("c_name").alias("name"), F.lit(1).alias("seq")), "seq")
    some = c.where("c_custkey % 10 = 3").select(F.col("c_custkey").alias("id"))
    table.upsert(some.select("id", F.lit("changed").alias("name"), F.lit(2).alias("seq")).unionByName(some.select("id", F.lit("older").alias("name"), F.lit(1).alias("seq"))), "seq")
    table.delete(c.where("c_acctbal < 0").select(F.col("c_custkey").alias("id")))
    return table.read()


@_query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) AS INTEGER) AS place, row_number() OVER (PARTITION BY user_id, strftime(ts, '%Y-%m') ORDER BY ts, event_id) <= 5 AS allowed FROM events")
def stream_admission(spark, d):
    """The events as a stream: each is told its place in its user's month, from state that ends with the month."""
    folder = scratch_folder(spark, "admission")
    stream_usage.run_admissions(event_stream(spark, d), f"{folder}/out", f"{folder}/checkpoint")
    return spark.read.parquet(f"{folder}/out").select("event_id", "user_id", "place", "allowed")


@_query("SELECT event_id, user_id, CAST(row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) AS INTEGER) AS place FROM events")
def event_places(spark, d):
    """Each event's place among all of its user's; places are counted within weeks and carried over."""
    return temporal.running_place(_events(spark, d), [F.col("user_id")], "ts", "event_id", 7 * 86_400_000_000).select("event_id", "user_id", "place")


# --- loosely typed JSON ------------------------------------------------------------------

#: JSON with values of odd kinds, a third within a code fence, a fifth cut off. The same expression in both dialects.
_LOOSE = """CASE WHEN c_custkey % 3 = 1 THEN '```json' || chr(10) ELSE '' END || '{"experience": [{"title": ' || CASE WHEN c_custkey % 4 = 0 THEN '7' WHEN c_custkey % 4 = 1 THEN '{"x": 1}' ELSE '"' || c_mktsegment || '"' END
 || ', "company": "' || c_name || '", "end": null, "bullets": ["Cut cost by ' || CAST(c_custkey AS STRING) || ' ms", ' || CAST(c_custkey AS STRING) || ', null, {"y": [1]}, "  ", {"text": " of an object "}, true, "Wrote"]}, 5, "no role"], "skills": ["SQL", 3, "SQL", null, "' || c_mktsegment
 || '", ["dbt"]], "projects": {"not": "a list"}, "education": [{"' || CASE WHEN c_custkey % 2 = 0 THEN 'school' ELSE 'institution' END || '": "' || c_name || '", "date": 2019}, null]' || CASE WHEN c_custkey % 5 = 2 THEN '' ELSE '}' END || CASE WHEN c_custkey % 3 = 1 THEN chr(10) || '```' ELSE '' END"""


@_query(f"""WITH t AS (SELECT c_custkey, regexp_replace(regexp_replace({_LOOSE}, '^```[a-z]*\n?', ''), '\n?```$', '') AS body FROM customer),
j AS (SELECT c_custkey, CASE WHEN json_valid(body) THEN body::JSON END AS j FROM t),
b AS (SELECT c_custkey, j, list_filter(list_transform(json_extract(j, '$.experience[0].bullets[*]'), lambda x: CASE json_type(x) WHEN 'VARCHAR' THEN x->>'$' WHEN 'OBJECT' THEN trim(coalesce(x->>'$.text', '')) ELSE '' END), lambda x: trim(x) <> '') AS bullets FROM j)
SELECT c_custkey, CASE WHEN j IS NOT NULL THEN CASE WHEN json_type(j, '$.experience[0].title') = 'OBJECT' THEN '' ELSE j->>'$.experience[0].title' END END AS title,
  CASE WHEN j IS NOT NULL THEN array_to_string(bullets, '|') END AS bullets,
  CASE WHEN j IS NOT NULL THEN CASE WHEN c_mktsegment = 'SQL' THEN 'SQL' ELSE 'SQL|' || c_mktsegment END END AS skills,
  CASE WHEN j IS NOT NULL THEN coalesce(j->>'$.education[0].school', j->>'$.education[0].institution') || ' ' || (j->>'$.education[0].date') END AS school,
  CASE WHEN j IS NOT NULL THEN CAST(1 AS INTEGER) END AS roles
FROM b JOIN customer USING (c_custkey)""".replace("AS STRING", "AS VARCHAR"))
def loose_json_profiles(spark, d):
    """JSON of each customer with numbers, nulls and objects where texts are due: only the odd values are left out."""
    p = profile.from_loose_json(F.expr(_LOOSE.replace("chr(10)", "char(10)")))
    rows = _t(spark, d, "customer").select("c_custkey", p.alias("p"))
    role, school = F.get("p.experience", F.lit(0)), F.get("p.education", F.lit(0))
    return rows.select(
        "c_custkey",
        role["title"].alias("title"),
        F.array_join(F.transform(role["bullets"], lambda b: b["text"]), "|").alias("bullets"),
        F.array_join("p.skills", "|").alias("skills"),
        F.concat(school["institution"], F.lit(" "), school["dates"]).alias("school"),
        F.when(F.col("p").isNotNull(), F.size("p.experience")).alias("roles"),
    )


@_query(f"""WITH v AS (SELECT vec_id, list_transform(CASE WHEN vec_id % 11 = 5 THEN list_reverse(embedding) ELSE embedding END, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 7 <> 3),
q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS v FROM embeddings WHERE vec_id % 20 = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id AS id, {_COS} AS score FROM q a, v b)
SELECT query_id, CAST(rn AS INTEGER) AS rank, id, round(score, 6) AS score FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, id) AS rn FROM s) WHERE rn <= 10""")
def vector_index_exact(spark, d):
    """All vectors indexed, some replaced, some deleted; the exact way asks every cell."""
    e = _t(spark, d, "embeddings").select(F.col("vec_id").alias("id"), F.col("embedding").cast("array<double>").alias("embedding"))
    index = vector_index.VectorIndex(spark, scratch_folder(spark, "vectors"), cells=16)
    index.build(e)
    index.upsert(e.where("id % 11 = 5").select("id", F.reverse("embedding").alias("embedding")))
    index.delete(e.where("id % 7 = 3"))
    asks = e.where("id % 20 = 0").select(F.col("id").alias("query_id"), F.col("embedding").alias("q"))
    return index.search(asks, 10, None).select("query_id", "rank", "id", F.round("score", 6).alias("score"))
