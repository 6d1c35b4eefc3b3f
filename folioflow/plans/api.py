"""Batch counterparts of the four calls: extract, analyse, render, run all.

Invalid rows never end a job: they carry an ``error`` instead of a result.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.functions import udtf

from ..functions import text as X
from ..operators import gap, parse_arrow, profile, render

PARSERS = {"blob": profile.parse_blob, "markdown": profile.parse_markdown, "latex": parse_arrow.parse_latex, "linkedin": profile.parse_linkedin, "plain": parse_arrow.parse_plain}


def extract_profiles(docs: DataFrame, strict: bool = True) -> DataFrame:
    """``doc_id, text, format`` -> ``doc_id, profile, error``.

    A null format is detected from the content. Blank texts and, if ``strict``,
    unknown formats have an error; otherwise unknown formats are read as blobs.
    """
    known = F.coalesce(F.lower("format"), X.detect_format(F.coalesce("text", F.lit(""))))
    blank = X.strip(F.coalesce("text", F.lit(""))) == ""
    odd = ~known.isin(list(PARSERS))
    error = F.when(blank, "text is empty").when(odd & F.lit(strict), F.concat(F.lit("unknown format: "), known))
    rows = docs.withColumn("kind", F.when(odd, "blob").otherwise(known)).withColumn("error", error)
    out = rows.where(F.col("error").isNotNull()).select("doc_id", F.lit(None).cast(profile.PROFILE).alias("profile"), "error")
    good = rows.where(F.col("error").isNull())
    for name, parser in PARSERS.items():
        parsed = parser(good.where(F.col("kind") == name).select("doc_id", "text"))
        out = out.unionByName(parsed.select("doc_id", "profile", F.lit(None).cast("string").alias("error")))
    return out


def analyze_gaps(jds: DataFrame, profiles: DataFrame, top_n: int = 5) -> DataFrame:
    """Reports of all pairs on the flat projection of the profiles."""
    docs = profiles.where(F.col("profile").isNotNull()).select("doc_id", profile.flatten(F.col("profile")).alias("text"))
    return gap.full_report(jds, docs, top_n)


def render_profiles(profiles: DataFrame, template: str, header: dict[str, str]) -> DataFrame:
    """``doc_id, tex, unfilled``: the filled template and the marks that no value filled."""
    rows = profiles.where(F.col("profile").isNotNull()).select("doc_id", render.build(F.col("profile"), F.lit(template), {k: F.lit(v) for k, v in header.items()}).alias("tex"))
    return rows.withColumn("unfilled", render.unfilled(F.col("tex")))


def run_all(jds: DataFrame, docs: DataFrame, template: str, header: dict[str, str], top_n: int = 5) -> DataFrame:
    """Artifacts of the same user merge into one profile: ``doc_id, user_id, text, format`` -> report and document per description."""
    parsed = extract_profiles(docs, strict=False).join(docs.select("doc_id", "user_id"), "doc_id").where(F.col("profile").isNotNull())
    merged = profile.merge(parsed).withColumnRenamed("user_id", "doc_id")
    return analyze_gaps(jds, merged, top_n).join(render_profiles(merged, template, header), "doc_id")


def register(spark: SparkSession) -> None:
    """SQL names: the table function ``parse_resume(text, format)`` for LATERAL use, one row per role."""

    @udtf(returnType="title string, company string, start string, finish string, bullets array<string>")
    class ParseResume:
        def eval(self, text: str, format: str):  # noqa: A002
            parser = parse_arrow.latex if format == "latex" else parse_arrow.plain_text
            for r in parser(text or "")["experience"]:
                yield r["title"], r["company"], r["start"], r["end"], r["bullets"]

    spark.udtf.register("parse_resume", ParseResume)
