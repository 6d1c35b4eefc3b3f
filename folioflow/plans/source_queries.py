"""Queries of the file extractors, the batch calls and the streaming operators, each with its SQL over whole tables.

The extractors take frames of bytes. Here the bytes are made from table rows, in
the shape that files have, so no file is written and every row is extracted.
"""

from __future__ import annotations

import io
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.sax.saxutils import escape

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..operators import extras, profile
from ..sources import files
from ..session import scratch_folder
from ..streaming import usage
from . import api
from .catalog import _docs, _events, _q, _query, _t
from .more_queries import _BULLETS, _digest, _of_customers


def _as_files(rows: DataFrame, writer: Callable[..., bytes]) -> DataFrame:
    """``path, content``: the first column names the file, the others are what ``writer`` makes its bytes from."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in files.slices(batches):
            path, *fields = (c.to_pylist() for c in b.columns)
            made = [writer(*x) for x in zip(*fields, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(map(str, path), pa.string()), pa.array(made, pa.binary())], ["path", "content"])

    return rows.mapInArrow(run, "path string, content binary")


# --- bytes -------------------------------------------------------------------


@_query("SELECT doc_id, sha256(coalesce(text, '') || chr(65533) || 'A') AS decoded FROM documents")
def lossy_bytes(spark, d):
    """Each text with a byte behind it that is no UTF-8."""
    content = F.concat(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), F.unhex(F.lit("FF41")))
    return _docs(spark, d).withColumn("text", files.lossy(content)).select("doc_id", _digest("text").alias("decoded"))


_FLAT = f"c_mktsegment || ' at ' || c_name || ' ' || {_BULLETS} || ' Tool of ' || c_name || ' ' || {_BULLETS} || ' ' || c_mktsegment || ' SQL Cert 1'"


@_query(f"SELECT c_custkey, CASE c_custkey % 3 WHEN 0 THEN {_FLAT} WHEN 1 THEN c_name ELSE '{{' || c_name END AS text FROM customer")
def json_or_text(spark, d):
    """A profile as JSON, a plain text, and a text that only begins like JSON."""
    rows = _of_customers(spark, d).join(_t(spark, d, "customer").select("c_custkey", "c_name"), "c_custkey")
    kind = F.col("c_custkey") % 3
    given = F.when(kind == 0, F.to_json("profile")).when(kind == 1, F.col("c_name")).otherwise(F.concat(F.lit("{"), "c_name"))
    return rows.select("c_custkey", files.json_or_text(given).alias("text"))


# --- DOCX --------------------------------------------------------------------

#: Characters that XML can't hold.
_NO_XML = "[\\x00-\\x08\\x0b-\\x1f\\x{FFFE}\\x{FFFF}]"


def _docx(text: str) -> bytes:
    lines = "".join(f"<w:p><w:r><w:t>{escape(x)}</w:t></w:r></w:p>" for x in text.split("\n"))
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", zipfile.ZIP_DEFLATED) as z:
        z.writestr("word/document.xml", f'<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:body>{lines}</w:body></w:document>')
    return out.getvalue()


_DOCX_LINES = f"list_filter(list_transform(string_split(regexp_replace(coalesce(text, ''), {_q(_NO_XML)}, '', 'g'), chr(10)), lambda x: regexp_replace(x, '^[\\s\\p{{Z}}]+|[\\s\\p{{Z}}]+$', '', 'g')), lambda x: x <> '')"


@_query(f"SELECT doc_id, sha256(array_to_string({_DOCX_LINES}, chr(10))) AS extracted, len({_DOCX_LINES}) = 0 AS failed FROM documents")
def docx_text(spark, d):
    """Each document packed as a file, a paragraph for each line."""
    rows = _docs(spark, d).select("doc_id", F.regexp_replace(F.coalesce("text", F.lit("")), _NO_XML, "").alias("text"))
    found = files.extract(_as_files(rows, _docx), files.docx_text)
    return found.select(F.col("path").cast("long").alias("doc_id"), _digest("text").alias("extracted"), F.col("error").isNotNull().alias("failed"))


# --- PDF ---------------------------------------------------------------------


def _pdf(content: str, packed: bool) -> bytes:
    body = content.encode("latin-1", "replace")
    return b"%PDF-1.4\nstream\n" + (zlib.compress(body) if packed else body) + b"\nendstream"


def _show(text: str) -> str:
    return "(" + text.replace("\\", "\\\\").replace("(", "\\(").replace(")", "\\)") + ") Tj"


def _two_lines(name: str, brand: str, key: int) -> bytes:
    """The name in two runs of one word, then the brand in a block of its own or behind a line break, with a piece beside it."""
    first = f"BT /F1 12 Tf 1 0 0 1 72 700 Tm {_show(name[:3])} {_show(name[3:])}"
    second = f"ET BT 72 680 Td {_show(brand)}" if key % 3 else f"-20 TL T* [{_show(brand)[:-3]} -200 (x)] TJ"
    return _pdf(f"{first} {second} ET BT 200 681 Td (beside) Tj ET", key % 2 == 0)


@_query("SELECT p_partkey, p_name || chr(10) || p_brand || CASE WHEN p_partkey % 3 = 0 THEN ' x' ELSE '' END || ' beside' AS extracted FROM part")
def pdf_text(spark, d):
    """Two lines of each part, every other file with a compressed stream."""
    rows = _t(spark, d, "part").select("p_partkey", "p_name", "p_brand", F.col("p_partkey").alias("key"))
    return files.extract(_as_files(rows, _two_lines), files.pdf_text).select(F.col("path").cast("long").alias("p_partkey"), F.col("text").alias("extracted"))


def _two_columns(name: str) -> bytes:
    marks = [(x, y, f"{side} {what}") for side, x in (("left", 72), ("right", 330)) for y, what in ((700, "first"), (680, "second"), (660, name))]
    return _pdf(" ".join(f"BT 1 0 0 1 {x} {y} Tm {_show(t)} ET" for x, y, t in sorted(marks, key=lambda m: -m[1])), True)


@_query("SELECT s_suppkey, array_to_string(['left first', 'left second', 'left ' || s_name, 'right first', 'right second', 'right ' || s_name], chr(10)) AS extracted FROM supplier")
def pdf_columns(spark, d):
    """Two columns, written line by line: the left one is read first."""
    rows = _t(spark, d, "supplier").select("s_suppkey", "s_name")
    return files.extract(_as_files(rows, _two_columns), files.pdf_text).select(F.col("path").cast("long").alias("s_suppkey"), F.col("text").alias("extracted"))


# --- batch calls -------------------------------------------------------------

_FORMATS = ["blob", "markdown", "latex", "linkedin", "plain", "xml"]


@_query(f"SELECT p_partkey, CASE WHEN p_partkey % 7 = 0 THEN 'text is empty' WHEN p_partkey % 6 = 5 THEN 'unknown format: xml' END AS error, NOT (p_partkey % 7 = 0 OR p_partkey % 6 = 5) AS parsed FROM part")
def batch_extract(spark, d):
    """Parts stand in for artifacts: every seventh is blank, every sixth has a format that nobody knows."""
    key = F.col("p_partkey")
    text = F.when(key % 7 == 0, " \n").otherwise(F.col("p_name"))
    kind = F.element_at(F.array(*map(F.lit, _FORMATS)), (key % 6).cast("int") + 1)
    rows = _t(spark, d, "part").select(key.alias("doc_id"), text.alias("text"), kind.alias("format"))
    return api.extract_profiles(rows).select(F.col("doc_id").alias("p_partkey"), "error", F.col("profile").isNotNull().alias("parsed"))


@_query("SELECT c_custkey, 1 AS roles, 2 AS bullets FROM customer WHERE c_custkey % 2 = 0 UNION ALL SELECT c_custkey, NULL, NULL FROM customer WHERE c_custkey % 2 = 1")
def json_profiles(spark, d):
    """Profiles written as JSON and read with the fixed schema; what is no JSON object has none."""
    given = F.when(F.col("c_custkey") % 2 == 0, F.to_json("profile")).otherwise("no profile")
    rows = _of_customers(spark, d).select("c_custkey", profile.from_json(given).alias("p"))
    n = profile.counts(F.col("p"))
    return rows.select("c_custkey", F.when(F.col("p").isNotNull(), n["roles"]).alias("roles"), F.when(F.col("p").isNotNull(), n["bullets"]).alias("bullets"))


@_query("""SELECT c_custkey, CASE WHEN c_custkey % 2 = 0 THEN c_name || '_' ELSE '' END || c_mktsegment || '_Engineer' AS version_tag, 'vault/' || c_custkey AS branch,
  CASE WHEN c_custkey % 2 = 0 THEN c_name || '_' ELSE '' END || c_mktsegment || '_Engineer.tex' AS filename, CASE WHEN c_custkey % 3 <> 0 THEN CAST(c_custkey % 100 AS INTEGER) END AS ats_score FROM customer""")
def vault_versions(spark, d):
    """A version of each customer, every other one with a first name, every third without a score."""
    key = F.col("c_custkey")
    meta = F.when(key % 3 != 0, F.to_json(F.struct((key % 100).alias("ats_score")))).otherwise("{}")
    rows = _t(spark, d, "customer").select("c_custkey", key.cast("string").alias("user_id"), F.col("c_mktsegment").alias("company"), F.lit("Engineer").alias("role"), F.when(key % 2 == 0, F.col("c_name")).otherwise(" ").alias("first_name"), F.lit("x").alias("tex"), meta.alias("meta"))
    return extras.version_rows(rows).select("c_custkey", "version_tag", "branch", "filename", "ats_score")


# --- streams -----------------------------------------------------------------
# The operators are the same plan over a table and over a stream; here the table is read at once.


def event_stream(spark, d) -> DataFrame:
    """The events table as a stream; by a pattern, as the source takes no path of one file."""
    return spark.readStream.schema(_events(spark, d).schema).parquet(f"{d}/events.parque[t]")


def _counted(spark, counts: DataFrame, keys: list[str], value: str) -> DataFrame:
    folder = scratch_folder(spark, "stream")
    return usage.run_counts(counts, keys, value, f"{folder}/out", f"{folder}/checkpoint")


@_query("SELECT user_id, strftime(ts, '%Y-%m') AS month, count(*) AS resume_count FROM events GROUP BY ALL")
def stream_monthly(spark, d):
    """The events as a stream, counted by user and month."""
    return _counted(spark, usage.monthly_counts(event_stream(spark, d)), ["user_id", "month"], "resume_count")


@_query("""SELECT user_id, strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (
SELECT user_id, unnest(list_transform(range(0, 12), lambda k: time_bucket(INTERVAL 5 MINUTE, ts) - k * INTERVAL 5 MINUTE)) AS start FROM (SELECT user_id, CAST(ts AS TIMESTAMP) AS ts FROM events)) GROUP BY ALL HAVING count(*) > 1""")
def stream_rate_alarms(spark, d):
    """More than one event within an hour, as events are far apart here; a stream of slices with a watermark, then their windows."""
    found = usage.alarms_of(_counted(spark, usage.slice_counts(event_stream(spark, d)), ["user_id", "slice"], "n"), limit=1)
    return found.select("user_id", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")


@_query("SELECT text_hash, strftime(start, '%Y-%m-%d %H:%M') AS start, count(*) AS n FROM (SELECT event_type AS text_hash, time_bucket(INTERVAL 5 MINUTE, CAST(ts AS TIMESTAMP)) AS start FROM events) GROUP BY ALL HAVING count(*) > 1")
def stream_repeated_requests(spark, d):
    """The type stands in for the description."""
    rows = event_stream(spark, d).select("ts", F.col("event_type").alias("text_hash"))
    found = _counted(spark, usage.repeated_requests(rows, limit=1), ["text_hash", "start"], "n")
    return found.select("text_hash", F.date_format("start", "yyyy-MM-dd HH:mm").alias("start"), "n")
