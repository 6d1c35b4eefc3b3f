"""LaTeX blocks and template filling, as expressions over a profile column."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from ..functions.text import escape_latex as esc
from ..functions.text import let

MAX_BULLETS = 6


def _join(parts: list[Column | str], sep: str = "") -> Column:
    return F.concat_ws(sep, *[F.lit(p) if isinstance(p, str) else p for p in parts])


def _lines(blocks: Column) -> Column:
    """Array of blocks, each already ended, as one text."""
    return F.array_join(blocks, "\n")


def bullets(items: Column) -> Column:
    """At most six items."""
    inner = F.transform(F.slice(items, 1, MAX_BULLETS), lambda b: _join(["      \\resumeItem{", esc(b["text"]), "}"]))
    return _lines(F.concat(F.array(F.lit("    \\resumeItemListStart")), inner, F.array(F.lit("    \\resumeItemListEnd"))))


def _with_bullets(head: Column, items: Column) -> Column:
    none = F.array().cast("array<string>")
    return F.concat(F.array(head), F.when(F.size(items) > 0, F.array(bullets(items))).otherwise(none), F.array(F.lit("")))


def experience(roles: Column) -> Column:
    """An empty ``end`` stays empty ("start -- "), a null one is Present."""

    def one(r: Column) -> Column:
        end = esc(F.coalesce(r["end"], F.lit("Present")))
        span = F.when(r["start"] != "", _join([esc(r["start"]), " -- ", end])).otherwise(end)
        return _with_bullets(_join(["    \\resumeSubheading\n      {", esc(r["title"]), "}{", span, "}\n      {", esc(r["company"]), "}{", esc(r["location"]), "}"]), r["bullets"])

    head = F.array(F.lit("\\section{Experience}"), F.lit("  \\resumeSubHeadingListStart"), F.lit(""))
    return _lines(F.concat(head, F.flatten(F.transform(roles, one)), F.array(F.lit("  \\resumeSubHeadingListEnd"))))


def projects(items: Column) -> Column:
    def one(p: Column) -> Column:
        return _with_bullets(_join(["      \\resumeProjectHeading\n          {\\textbf{", esc(p["name"]), "} $|$ \\emph{", esc(F.array_join(p["tech"], ", ")), "}}{", esc(p["date"]), "}"]), p["bullets"])

    head = F.array(F.lit("\\section{Projects}"), F.lit("    \\resumeSubHeadingListStart"), F.lit(""))
    return F.when(F.size(items) == 0, "").otherwise(_lines(F.concat(head, F.flatten(F.transform(items, one)), F.array(F.lit("    \\resumeSubHeadingListEnd")))))


_SKILLS_HEAD = "\\section{Technical Skills}\n \\begin{itemize}[leftmargin=0.15in, label={}]\n    \\small{\\item{\n"
_SKILLS_TAIL = "\n    }}\n \\end{itemize}"


def skills(names: Column) -> Column:
    return _join([_SKILLS_HEAD + "     \\textbf{Skills}{: ", esc(F.array_join(names, ", ")), "}" + _SKILLS_TAIL])


def skills_by_category(groups: Column) -> Column:
    """``map<string, array<string>>``, one line per category."""
    one = lambda e: _join(["     \\textbf{", esc(e["key"]), "}{: ", esc(F.array_join(e["value"], ", ")), "}"])
    return _join([_SKILLS_HEAD, F.array_join(F.transform(F.map_entries(groups), one), " \\\\\n"), _SKILLS_TAIL])


def education(items: Column) -> Column:
    one = lambda e: _join(["    \\resumeSubheading\n      {", esc(e["institution"]), "}{", esc(e["location"]), "}\n      {", esc(e["degree"]), "}{", esc(e["dates"]), "}"])
    return _lines(F.concat(F.array(F.lit("\\section{Education}"), F.lit("  \\resumeSubHeadingListStart")), F.transform(items, one), F.array(F.lit("  \\resumeSubHeadingListEnd"))))


def certifications(names: Column) -> Column:
    body = F.array_join(F.transform(names, esc), " $|$ ")
    return F.when(F.size(names) == 0, "").otherwise(_join(["\\section{Certifications}\n \\begin{itemize}[leftmargin=0.15in, label={}]\n    \\small{\\item{ ", body, " }}\n \\end{itemize}"]))


def sections(profile: Column) -> Column:
    """struct<experience, projects, education> of a profile that is built once, however it is made; take it apart by ``inline`` of an array of it."""
    return let(profile, lambda p: F.struct(experience(p["experience"]).alias("experience"), projects(p["projects"]).alias("projects"), education(p["education"]).alias("education")))


def fill(template: Column, values: dict[str, Column]) -> Column:
    """Each ``{{KEY}}`` replaced, in the order given; a value that holds a later key's mark is filled too."""
    for key, value in values.items():
        template = F.replace(template, F.lit("{{" + key + "}}"), value)
    return template


def unfilled(text: Column) -> Column:
    return F.regexp_extract_all(text, F.lit(r"\{\{[A-Z_]+\}\}"), F.lit(0))


def build(profile: Column, template: Column, header: dict[str, Column]) -> Column:
    """The whole document: header values, then sections. Name, phone and summary are escaped, addresses are not."""
    values = {k: esc(v) if k in ("NAME", "PHONE", "SUMMARY") else v for k, v in header.items()}
    values |= {"EXPERIENCE_SECTION": experience(profile["experience"]), "PROJECTS_SECTION": projects(profile["projects"]), "SKILLS_SECTION": skills(profile["skills"]), "EDUCATION_SECTION": education(profile["education"]), "CERTIFICATIONS_SECTION": certifications(profile["certifications"])}
    return fill(template, values)


def summary_rows(summary: Column) -> Column:
    """array<struct<priority, category, missing>> of a report's numbered lines and the "Missing:" line that follows each."""
    found = F.regexp_extract_all(summary, F.lit(r"(?m)^\s*\d+\.\s+\[(\w+)\]\s+[^\n]+(?:\n\s*Missing:[^\n]*)?"), F.lit(0))
    return F.transform(found, lambda x: F.struct(F.regexp_extract(x, r"\[(\w+)\]", 1).alias("priority"), F.trim(F.regexp_extract(x, r"\]\s+([^\n]+)", 1)).alias("category"), F.trim(F.regexp_extract(x, r"\n\s*Missing:([^\n]*)", 1)).alias("missing")))
