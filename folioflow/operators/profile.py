"""Profiles: the nested row, native parsers, enrichment, flattening and merging.

A parser turns ``doc_id, text`` into ``doc_id, profile``. Line formats are
parsed by windows over exploded lines: one Exchange on the document, whole-stage
code, no Python.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X

BULLET = "struct<text:string,metrics:array<string>,tools:array<string>,evidence_source:string,confidence:string>"
ROLE = f"struct<title:string,company:string,start:string,`end`:string,location:string,bullets:array<{BULLET}>>"
PROJECT = f"struct<name:string,tech:array<string>,bullets:array<{BULLET}>,date:string>"
EDUCATION = "struct<institution:string,degree:string,dates:string,location:string>"
PROFILE = f"struct<experience:array<{ROLE}>,projects:array<{PROJECT}>,skills:array<string>,education:array<{EDUCATION}>,certifications:array<string>>"


def bullet(text: Column, source: str) -> Column:
    """A bullet with what its text says: metrics, tools, confidence."""
    return X.let(X.metrics(text), lambda m: F.struct(text.alias("text"), m.alias("metrics"), X.tools(text).alias("tools"), F.lit(source).alias("evidence_source"), X.confidence(m).alias("confidence")))


def _lines(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", F.posexplode_outer(X.lines(F.col("text"))).alias("pos", "raw")).withColumn("s", X.strip(F.coalesce("raw", F.lit(""))))


def _empty(kind: str) -> Column:
    return F.array().cast(f"array<{kind}>")


def _in_order(values: Column) -> Column:
    """Collected structs (pos, v) as the values in document order."""
    return F.transform(F.array_sort(F.collect_list(values)), lambda x: x["v"])


def _roles(lines: DataFrame, title: Column, company: Column, start: Column, end: Column, source: str) -> DataFrame:
    """Roles from lines with ``doc_id, pos, opens, item``; the four columns aggregate over a role's lines."""
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    placed = lines.withColumn("role", F.sum(F.col("opens").cast("int")).over(w)).where("role > 0")
    found = F.when(F.col("item").isNotNull(), F.struct("pos", bullet(F.col("item"), source).alias("v")))
    one = placed.groupBy("doc_id", "role").agg(title.alias("title"), company.alias("company"), start.alias("start"), end.alias("end"), _in_order(found).alias("bullets"))
    blank = lambda c: F.coalesce(c, F.lit(""))
    role = F.struct(blank("title").alias("title"), blank("company").alias("company"), blank("start").alias("start"), blank("end").alias("end"), F.lit("").alias("location"), "bullets")
    return one.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("role", role.alias("v")))), lambda x: x["v"]).alias("experience"))


def _profile(docs: DataFrame, roles: DataFrame, skills: DataFrame | None = None) -> DataFrame:
    rows = docs.select("doc_id").join(roles, "doc_id", "left")
    rows = rows.join(skills, "doc_id", "left") if skills is not None else rows.withColumn("skills", F.lit(None).cast("array<string>"))
    whole = F.struct(F.coalesce("experience", _empty(ROLE)).alias("experience"), _empty(PROJECT).alias("projects"), F.coalesce("skills", _empty("string")).alias("skills"), _empty(EDUCATION).alias("education"), _empty("string").alias("certifications"))
    return rows.select("doc_id", whole.cast(PROFILE).alias("profile"))


def parse_blob(docs: DataFrame, source: str = "blob") -> DataFrame:
    """Header lines (company, title, dates, tried in this order) and bullets; a company line opens a role."""
    opens = r"(?idU)^(?:company|employer|org(?:anization)?)[:\s]+(.+)"
    title = r"(?idU)^(?:title|position|role)[:\s]+(.+)"
    dates = r"(?idU)^(?:dates?|period|tenure)[:\s]+(.+?)[\s]*(?:–|-|to)[\s]*(.+)"
    s = F.col("s")
    got = lambda p, g: X.strip(F.regexp_extract(s, p, g))
    rows = _lines(docs).withColumn("opens", s.rlike(opens)).withColumn("titled", ~F.col("opens") & s.rlike(title)).withColumn("dated", ~F.col("opens") & ~F.col("titled") & s.rlike(dates))
    item = F.when(~F.col("opens") & ~F.col("titled") & ~F.col("dated") & s.rlike(r"^[-*] "), X.strip(F.substring(s, F.lit(3), F.length(s))))
    rows = rows.withColumn("item", item)
    at = lambda flag: F.when(F.col(flag), F.col("pos"))
    # the last title and date line of a role decide
    roles = _roles(rows, F.max_by(got(title, 1), at("titled")), F.max_by(got(opens, 1), at("opens")), F.max_by(got(dates, 1), at("dated")), F.max_by(got(dates, 2), at("dated")), source)
    return _profile(docs, roles)


def parse_linkedin(docs: DataFrame) -> DataFrame:
    return parse_blob(docs, "linkedin_pdf")


def parse_markdown(docs: DataFrame, source: str = "markdown_resume") -> DataFrame:
    """"## " switches the section; roles are ``**Title** | Company | Dates``; skills are split, repeats kept."""
    role = r"(?dU)^\*\*(.+?)\*\*\s*[|@]\s*(.+?)\s*[|@]\s*(.+)"
    s = F.col("s")
    w = Window.partitionBy("doc_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, 0)
    rows = _lines(docs).withColumn("heads", F.startswith(s, F.lit("## ")))
    rows = rows.withColumn("section", F.last(F.when(F.col("heads"), F.lower(F.substring(s, F.lit(4), F.length(s)))), ignorenulls=True).over(w)).where(~F.col("heads") & (s != ""))
    works = F.contains("section", F.lit("experience")) | F.contains("section", F.lit("work"))
    inside = rows.where(works).withColumn("opens", s.rlike(role)).withColumn("item", F.when(s.rlike(r"^[-*] ") & ~s.rlike(role), X.strip(F.substring(s, F.lit(3), F.length(s)))))
    got = lambda g: F.max_by(X.strip(F.regexp_extract(s, role, g)), F.when(F.col("opens"), F.col("pos")))
    roles = _roles(inside, got(1), got(2), got(3), F.lit(""), source)
    named = rows.where(~works & F.contains("section", F.lit("skill")))
    parts = F.filter(F.transform(F.split(s, r"[,|•]"), lambda x: X.strip(x, " -*")), lambda x: x != "")
    skills = named.groupBy("doc_id").agg(F.flatten(_in_order(F.struct("pos", parts.alias("v")))).alias("skills"))
    return _profile(docs, roles, skills)


def flatten(profile: Column) -> Column:
    """Title and company, bullets, project names and bullets, skills, certifications as one text."""
    bullets = lambda xs: F.transform(xs, lambda b: b["text"])
    roles = F.transform(profile["experience"], lambda r: F.concat(F.array(F.concat(r["title"], F.lit(" at "), r["company"])), bullets(r["bullets"])))
    projects = F.transform(profile["projects"], lambda p: F.concat(F.array(p["name"]), bullets(p["bullets"])))
    return F.array_join(F.concat(F.flatten(roles), F.flatten(projects), profile["skills"], profile["certifications"]), " ")


def merge(profiles: DataFrame, key: str = "user_id", order: str = "doc_id") -> DataFrame:
    """One profile per key: lists one after the other, skills distinct in order. A single profile passes as it is but for that."""
    all_of = F.array_sort(F.collect_list(F.struct(F.col(order).alias("o"), F.col("profile").alias("v"))))
    one = profiles.groupBy(key).agg(F.transform(all_of, lambda x: x["v"]).alias("all"))
    part = lambda name: F.flatten(F.transform("all", lambda p: p[name]))
    whole = F.struct(part("experience").alias("experience"), part("projects").alias("projects"), F.array_distinct(part("skills")).alias("skills"), part("education").alias("education"), part("certifications").alias("certifications"))
    return one.select(key, whole.alias("profile"))


def from_json(text: Column) -> Column:
    """JSON to a profile; blank bullets go, skills are distinct, bullets are enriched; null for what is no JSON object."""
    good = lambda xs: F.transform(F.filter(F.coalesce(xs, _empty(BULLET)), lambda b: X.strip(b["text"]) != ""), lambda b: bullet(X.strip(b["text"]), "llm"))
    nn = lambda c: F.coalesce(c, F.lit(""))

    def whole(p: Column) -> Column:
        roles = F.transform(F.coalesce(p["experience"], _empty(ROLE)), lambda r: F.struct(nn(r["title"]).alias("title"), nn(r["company"]).alias("company"), nn(r["start"]).alias("start"), nn(r["end"]).alias("end"), nn(r["location"]).alias("location"), good(r["bullets"]).alias("bullets")))
        projects = F.transform(F.coalesce(p["projects"], _empty(PROJECT)), lambda r: F.struct(nn(r["name"]).alias("name"), F.coalesce(r["tech"], _empty("string")).alias("tech"), good(r["bullets"]).alias("bullets"), nn(r["date"]).alias("date")))
        return F.struct(roles.alias("experience"), projects.alias("projects"), F.array_distinct(F.coalesce(p["skills"], _empty("string"))).alias("skills"), F.coalesce(p["education"], _empty(EDUCATION)).alias("education"), F.coalesce(p["certifications"], _empty("string")).alias("certifications"))

    # from_json gives a struct of nulls for malformed texts; the whole document as a path is null for them
    return F.when(F.startswith(F.get_json_object(text, "$"), F.lit("{")), X.let(F.from_json(text, PROFILE), lambda p: whole(p).cast(PROFILE)))


def from_loose_json(text: Column, source: str = "llm") -> Column:
    """JSON as a language model writes it to a profile; null for what is no JSON object.

    A code fence around the object goes. The text becomes a variant, so a value of an
    unexpected kind costs itself and nothing beside it: bullets, skills and
    certifications that are no texts (bullets may also be objects with a ``text``), or blank
    bullets, are skipped one by one; roles, projects and schools that are no
    objects too; names that are numbers are read as texts, other odd ones as empty. ``school`` and ``date`` of
    an education entry go before ``institution`` and behind ``dates``.
    """
    bare = F.regexp_replace(F.regexp_replace(X.strip(text), r"^```[a-z]*\n?", ""), r"\n?```$", "")
    is_text = lambda v: F.schema_of_variant(v) == "STRING"
    is_object = lambda v: F.startswith(F.schema_of_variant(v), F.lit("OBJECT"))
    items = lambda v, path: F.filter(F.coalesce(F.try_variant_get(v, path, "array<variant>"), _empty("variant")), lambda x: x.isNotNull())
    said = lambda v, path: F.coalesce(F.try_variant_get(v, path, "string"), F.lit(""))
    scalar = lambda v, path: X.let(F.try_variant_get(v, path, "variant"), lambda x: F.when(F.schema_of_variant(x).rlike("^(OBJECT|ARRAY)"), "").otherwise(said(x, "$")))
    texts = lambda v, path: F.transform(F.filter(items(v, path), is_text), lambda x: said(x, "$"))
    objects = lambda v, path: F.filter(items(v, path), is_object)
    told = lambda x: F.when(is_text(x), said(x, "$")).when(is_object(x), X.strip(said(x, "$.text"))).otherwise("")
    bullets = lambda v: F.transform(F.filter(F.transform(items(v, "$.bullets"), told), lambda t: X.strip(t) != ""), lambda t: bullet(t, source))
    role = lambda r: F.struct(*[scalar(r, f"$.{c}").alias(c) for c in ("title", "company", "start", "end", "location")], bullets(r).alias("bullets"))
    project = lambda p: F.struct(scalar(p, "$.name").alias("name"), texts(p, "$.tech").alias("tech"), bullets(p).alias("bullets"), scalar(p, "$.date").alias("date"))
    first = lambda e, a, b: F.when(F.try_variant_get(e, f"$.{a}", "variant").isNotNull(), scalar(e, f"$.{a}")).otherwise(scalar(e, f"$.{b}"))
    school = lambda e: F.struct(first(e, "school", "institution").alias("institution"), scalar(e, "$.degree").alias("degree"), first(e, "dates", "date").alias("dates"), scalar(e, "$.location").alias("location"))

    def whole(v: Column) -> Column:
        return F.struct(
            F.transform(objects(v, "$.experience"), role).alias("experience"),
            F.transform(objects(v, "$.projects"), project).alias("projects"),
            F.array_distinct(texts(v, "$.skills")).alias("skills"),
            F.transform(objects(v, "$.education"), school).alias("education"),
            texts(v, "$.certifications").alias("certifications"),
        ).cast(PROFILE)

    return X.let(F.try_parse_json(bare), lambda v: F.when(is_object(v), whole(v)))


def counts(profile: Column) -> Column:
    n = lambda f: F.aggregate(profile["experience"], F.lit(0), f)
    rich = lambda b: (F.size(b["metrics"]) > 0) | (F.size(b["tools"]) > 0)
    return F.struct(F.size(profile["experience"]).alias("roles"), n(lambda a, r: a + F.size(r["bullets"])).alias("bullets"), F.size(profile["skills"]).alias("skills"), F.size(profile["projects"]).alias("projects"), n(lambda a, r: a + F.size(F.filter(r["bullets"], rich))).alias("enriched"))
