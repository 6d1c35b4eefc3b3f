"""Operators that are only described by what they must satisfy; constants are chosen here and named.

Repository and version listings, README bullets, company names, the score
facade with its comparison, and cover letters.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from . import gap, vector

STAR_COUNT = 10
README_BULLETS, README_LENGTH = 3, 15
LETTER_WORDS = 250


def company_of(jd: Column) -> Column:
    """Capitalised name after "at" or "join", or at a line's start before "is"; empty if there is none."""
    name = r"([A-Z][A-Za-z0-9&.]*(?: [A-Z][A-Za-z0-9&.]*){0,3})"
    after, opening = F.regexp_extract(jd, rf"\b(?:at|At|join|Join) {name}", 1), F.regexp_extract(jd, rf"(?m)^{name} is\b", 1)
    return F.rtrim(F.when(after != "", after).otherwise(opening), F.lit("."))


def readme_bullets(text: Column) -> Column:
    """The first three dash lines of more than fifteen characters."""
    found = F.transform(F.filter(X.lines(text), lambda x: F.startswith(X.strip(x), F.lit("- "))), lambda x: X.strip(F.substring(X.strip(x), F.lit(3), F.length(x))))
    return F.slice(F.filter(found, lambda x: F.length(x) > README_LENGTH), 1, README_BULLETS)


def own_repositories(repos: DataFrame, limit: int, forks: bool = False) -> DataFrame:
    """Each user's newest ``limit`` repositories, forks left out: ``user, name, is_fork, updated``."""
    rows = repos if forks else repos.where(~F.coalesce("is_fork", F.lit(False)))
    w = Window.partitionBy("user").orderBy(F.desc("updated"), "name")
    return rows.withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit).drop("turn")


def repo_project(name: Column, description: Column, language: Column, topics: Column, stars: Column, readme: Column) -> Column:
    """struct<name, tech, bullets>: language and topics, then description, README and (from ten stars) star bullets."""
    some = lambda c: F.when(F.coalesce(c, F.lit("")) != "", F.array(c)).otherwise(F.array().cast("array<string>"))
    tech = F.array_distinct(F.concat(some(language), F.coalesce(topics, F.array().cast("array<string>"))))
    liked = F.when(stars >= STAR_COUNT, F.array(F.concat(F.lit("Earned "), stars.cast("string"), F.lit(" stars")))).otherwise(F.array().cast("array<string>"))
    return F.struct(name.alias("name"), tech.alias("tech"), F.concat(some(description), readme_bullets(F.coalesce(readme, F.lit(""))), liked).alias("bullets"))


def versions(files: DataFrame, limit: int) -> DataFrame:
    """Each user's last ``limit`` ``.tex`` files by name, descending."""
    w = Window.partitionBy("user_id").orderBy(F.desc("filename"))
    return files.where(F.endswith("filename", F.lit(".tex"))).withColumn("turn", F.row_number().over(w)).where(F.col("turn") <= limit)


def version_rows(rows: DataFrame) -> DataFrame:
    """``user_id, company, role, first_name, tex, meta`` with each version's tag, branch, file name and score; ``meta`` is JSON.

    The tag leaves out a first name that is not given.
    """
    blank = lambda c: F.when(F.trim(c) != "", F.trim(c))
    tag = F.concat_ws("_", blank(F.col("first_name")), F.col("company"), F.col("role"))
    out = rows.withColumn("version_tag", tag).withColumn("branch", F.concat(F.lit("vault/"), "user_id"))
    return out.withColumn("filename", F.concat("version_tag", F.lit(".tex"))).withColumn("ats_score", F.get_json_object("meta", "$.ats_score").cast("int"))


def score(jds: DataFrame, docs: DataFrame, method: str = "formula") -> DataFrame:
    """``jd_id, doc_id, score, method_used``: the formula, or cosine of hashed embeddings; a language model falls back to the formula."""
    kind = method.lower()
    if kind in ("formula", "claude"):
        label = "formula" if kind == "formula" else "formula (fallback)"
        return gap.pairs(jds, docs, figures=("score",)).select("jd_id", "doc_id", "score", F.lit(label).alias("method_used"))
    if kind != "embedding":
        raise ValueError(f"unknown scoring method {method!r}")
    left = docs.select("doc_id", vector.dense_counts(F.col("text")).alias("counts"))
    right = jds.select("jd_id", vector.dense_counts(F.col("text")).alias("asked"))

    def tell(some: dict, block: dict, kept: dict) -> Iterator[pa.RecordBatch]:
        a, b = (x.flatten().to_numpy().reshape(len(x), -1) for x in (some["counts"], block["asked"]))
        norm = lambda v: np.sqrt(np.maximum((v * v).sum(axis=1), 1))
        for at in range(0, len(a), step := max(1, gap.PAIRS // len(b))):
            part, ids = a[at : at + step], some["doc_id"].slice(at, step)
            # counts are whole, so their product is exact in any order
            cosine = (part @ b.T) / (norm(part)[:, None] * norm(b)[None, :])
            scores = np.clip(np.floor(cosine * 100 + 1e-9), 0, 100).astype(np.int32)
            made = [block["jd_id"].take(pa.array(np.tile(np.arange(len(b)), len(ids)))), ids.take(pa.array(np.repeat(np.arange(len(ids)), len(b)))), pa.array(scores.ravel())]
            yield pa.RecordBatch.from_arrays(made, ["jd_id", "doc_id", "score"])

    return gap.packed_meeting(left, right, tell, f"{gap._ids(jds, docs)}, score int").withColumn("method_used", F.lit("embedding (tfidf fallback)"))


def compare(jds: DataFrame, docs: DataFrame) -> DataFrame:
    """The formula beside the language model's score, which offline is the formula."""
    return gap.pairs(jds, docs, figures=("score",)).select("jd_id", "doc_id", F.col("score").alias("formula"), F.col("score").alias("model"))


def cover_letter(name: Column, company: Column, skills: Column) -> Column:
    """struct<txt, word_count>: plain text of at most 250 words, also from empty inputs."""
    who = F.when(F.coalesce(company, F.lit("")) == "", "your team").otherwise(company)
    known = F.when(F.size(F.coalesce(skills, F.array().cast("array<string>"))) > 0, F.concat(F.lit("My work includes "), F.array_join(skills, ", "), F.lit(". "))).otherwise("")
    txt = X.word_limit(F.concat(F.lit("Dear hiring team, I would like to join "), who, F.lit(". "), known, F.lit("Sincerely, "), F.coalesce(name, F.lit(""))), LETTER_WORDS)
    return F.struct(txt.alias("txt"), F.size(X.words(txt)).alias("word_count"))
