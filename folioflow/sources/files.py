"""File sources: whole texts, lossy bytes, JSON profiles, PDF and DOCX.

Binary formats are read by Spark's ``binaryFile`` source, so paths may be in
any store that Spark reads; the extractors work on Arrow batches of bytes.
"""

from __future__ import annotations

import io
import re
import zipfile
import zlib
from collections.abc import Callable, Iterator
from xml.etree import ElementTree

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab
from ..operators.profile import PROFILE


def read_texts(spark: SparkSession, path: str) -> DataFrame:
    """``path, text``: one row per file."""
    return spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.col("value").alias("text"))


def read_bytes(spark: SparkSession, path: str) -> DataFrame:
    """``path, content, format`` by the extension."""
    rows = spark.read.format("binaryFile").load(path).select("path", "content")
    return rows.withColumn("format", X.format_of_extension(F.col("path")))


def lossy(data: Column) -> Column:
    """Text of any bytes; what is no UTF-8 becomes U+FFFD, one for each part that could have gone on."""
    return F.make_valid_utf8(data.cast("string"))


def read_lossy(spark: SparkSession, path: str) -> DataFrame:
    """``path, text, error``, without Python workers."""
    rows = read_bytes(spark, path).select("path", F.coalesce(lossy(F.col("content")), F.lit("")).alias("text"))
    return rows.withColumn("error", F.when(X.strip(F.col("text")) == "", "no text could be extracted"))


def read_profiles(spark: SparkSession, path: str) -> DataFrame:
    """One JSON object per file, with the fixed profile schema."""
    rows = spark.read.text(path, wholetext=True).select(F.input_file_name().alias("path"), F.from_json("value", PROFILE).alias("profile"))
    return rows


def json_or_text(text):
    """Column: the flattened profile of a JSON object, else the text itself."""
    from ..operators.profile import flatten, from_json

    return X.let(from_json(text), lambda p: F.when(p.isNotNull(), flatten(p)).otherwise(text))


#: Files that are opened at once.
FILES = 128


def slices(batches: Iterator[pa.RecordBatch], size: int = FILES) -> Iterator[pa.RecordBatch]:
    """The batches in smaller ones, so that few values are Python objects at a time."""
    for b in batches:
        for at in range(0, b.num_rows, size):
            yield b.slice(at, size)


def extract(rows: DataFrame, reader: Callable[[bytes], str]) -> DataFrame:
    """``path, text, error``: a file from which no text comes has an error instead of ending the job."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in slices(batches):
            texts = [reader(x or b"") for x in b.column(1).to_pylist()]
            errors = [None if t.strip() else "no text could be extracted" for t in texts]
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts, pa.string()), pa.array(errors, pa.string())], ["path", "text", "error"])

    return rows.select("path", "content").mapInArrow(run, "path string, text string, error string")


_W = "{http://schemas.openxmlformats.org/wordprocessingml/2006/main}"


def docx_text(data: bytes) -> str:
    """Paragraphs of word/document.xml, blank ones dropped; no text for what is no such archive."""
    try:
        with zipfile.ZipFile(io.BytesIO(data)) as z:
            root = ElementTree.fromstring(z.read("word/document.xml"))
    except (zipfile.BadZipFile, KeyError, ElementTree.ParseError):
        return ""
    paragraphs = ("".join(t.text or "" for t in p.iter(f"{_W}t")).strip() for p in root.iter(f"{_W}p"))
    return "\n".join(p for p in paragraphs if p)


_PDF_TOKEN = re.compile(rb"\s+|%[^\r\n]*|(?P<num>[+-]?(?:\d+\.?\d*|\.\d+))|(?P<str>\()|<(?P<hex>[0-9A-Fa-f\s]*)>|(?P<open>\[)|(?P<close>\])|/[^\s()<>\[\]/]*|(?P<op>[A-Za-z'\"*]+)|.", re.S)
_ESCAPE = re.compile(r"\\([0-7]{1,3}|\r\n|.)", re.S)
_CONTROL = {"n": "\n", "r": "\r", "t": "\t", "b": "\b", "f": "\f", "\n": "", "\r": "", "\r\n": ""}
# Kerning that is a blank, heights of one line, gap between columns, pieces that make none, leading, move within a line, width of a character.
_KERN_SPACE = -150
_LINE_Y, _COLUMN_GAP, _FEW_PIECES = 3.0, 18.0, 4
_LEADING, _SAME_LINE = 12.0, 0.5
_CHAR_WIDTH, _WIDTH_SLACK = 4.0, 1.1


def _literal(data: bytes, at: int) -> tuple[str, int]:
    """Content of a balanced literal string and the position behind it."""
    depth, start = 1, at
    while at < len(data) and depth:
        c = data[at]
        if c == 0x5C:
            at += 1
        elif c == 0x28:
            depth += 1
        elif c == 0x29:
            depth -= 1
        at += 1
    raw = data[start : at - 1 if not depth else at].decode("latin-1")
    return _ESCAPE.sub(lambda m: chr(int(m[1], 8) % 128) if m[1][0] in "01234567" else _CONTROL.get(m[1], m[1]), raw), at


def pdf_hex(text: str) -> str:
    """UTF-16 where three quarters of it are printable ASCII, else Latin-1."""
    text = "".join(text.split())
    raw = bytes.fromhex(text + "0" * (len(text) % 2))
    if len(raw) >= 2 and len(raw) % 2 == 0:
        wide = raw.decode("utf-16-be", "replace")
        if "�" not in wide and sum(" " <= c <= "~" for c in wide) >= 0.75 * len(wide):
            return wide
    return "".join(c for c in raw.decode("latin-1") if c.isprintable())


def _pieces(content: bytes) -> Iterator[tuple[float, float, str]]:
    """(x, y, text) of each text run of a content stream, in stream order: what is shown until the line changes is one run."""
    stack: list = []
    array: list | None = None
    shown: list[str] = []
    x = y = lead = 0.0
    inside, at = False, 0

    def ended() -> Iterator[tuple[float, float, str]]:
        run = "".join(shown)
        shown.clear()
        if run.strip():
            yield x, y, run

    while at < len(content) and (m := _PDF_TOKEN.match(content, at)):
        at = m.end()
        target = stack if array is None else array
        if m["str"]:
            value, at = _literal(content, at)
            target.append(value)
        elif m["hex"] is not None:
            target.append(pdf_hex(m["hex"].decode()))
        elif m["num"]:
            target.append(float(m["num"]))
        elif m["open"]:
            array = []
        elif m["close"]:
            stack.append(array or [])
            array = None
        elif op := m["op"]:
            numbers = [v for v in stack if isinstance(v, float)]
            if op == b"BT":
                inside, x, y, lead = True, 0.0, 0.0, _LEADING
            elif op == b"ET":
                yield from ended()
                inside = False
            elif op == b"Tm" and len(numbers) >= 6:
                yield from ended()
                x, y = numbers[-2:]
            elif op == b"TL" and numbers:
                lead = abs(numbers[-1])
            elif op in (b"Td", b"TD") and len(numbers) >= 2:
                if abs(numbers[-1]) > _SAME_LINE:
                    yield from ended()
                x, y = x + numbers[-2], y + numbers[-1]
            elif op in (b"T*", b"'", b'"'):
                yield from ended()
                y -= lead
            if inside and op in (b"Tj", b"'", b'"') and stack and isinstance(stack[-1], str):
                shown.append(stack[-1])
            elif inside and op == b"TJ" and stack and isinstance(stack[-1], list):
                shown.append("".join(v if isinstance(v, str) else " " if v < _KERN_SPACE else "" for v in stack[-1]))
            stack.clear()
    yield from ended()


def _joined(line: list[tuple[float, str]]) -> str:
    """Pieces of a line from left to right; one that begins where the one before it ends belongs to the same word."""
    out, before = "", None
    for x, t in sorted(line, key=lambda p: p[0]):
        if before and x - before[0] > len(before[1]) * _CHAR_WIDTH * _WIDTH_SLACK:
            out += " "
        out, before = out + t, (x, t)
    return out


def _grouped(pieces: list[tuple[float, float, str]]) -> list[str]:
    """Lines by height: pieces within three units of a line's first piece belong to it."""
    out: list[tuple[float, list]] = []
    for x, y, t in sorted(pieces, key=lambda p: (-p[1], p[0])):
        if out and abs(out[-1][0] - y) <= _LINE_Y:
            out[-1][1].append((x, t))
        else:
            out.append((y, [(x, t)]))
    return [_joined(line) for _, line in out]


def _useful(line: str) -> bool:
    letters = sum(c.isalpha() for c in line)
    return len(line) >= 2 and (letters / len(line) >= 0.25 or any(c.isdigit() for c in line))


def pdf_text(data: bytes) -> str:
    """Text of a PDF's content streams: positions, two columns (left first), clean-up of glyph artefacts."""
    streams = re.findall(rb"stream\r?\n(.*?)\r?\n?endstream", data, re.S)
    bodies = []
    for s in streams:
        try:
            bodies.append(zlib.decompressobj().decompress(s))  # the checksum's last byte may read as the line end before the keyword
        except zlib.error:
            bodies.append(s)
    pieces = [p for body in bodies or [data] for p in _pieces(body)]
    cleaned = []
    for x, y, t in pieces:
        for a, b in vocab.OT1:
            t = t.replace(a, b)
        t = "".join(c for c in t if c.isprintable())
        cleaned.append((x, y, t if t.strip() else " "))
    if not cleaned:
        return ""
    starts = sorted(p[0] for p in cleaned)
    # the first of equal gaps
    gap, split = max(((b - a, (a + b) / 2) for a, b in zip(starts, starts[1:], strict=False)), key=lambda g: g[0], default=(0.0, 0.0))
    if len(cleaned) > _FEW_PIECES and gap >= _COLUMN_GAP:
        lines = _grouped([p for p in cleaned if p[0] < split]) + _grouped([p for p in cleaned if p[0] >= split])
    else:
        lines = _grouped(cleaned)
    text = "\n".join(x for x in lines if _useful(x))
    text = re.sub(rf"(\d{{4}})\s+t\s+({vocab.MONTH}|Present|Current|Now)", r"\1 – \2", text, flags=re.I)
    text = re.sub(r"(?<!\d)(\d{2,3}) (\d)(?!\d)", r"\1\2", text)
    text = re.sub(r"(?<!\d)(\d{2}) (\d{2})(?!\d)", r"\1\2", text)
    out = []
    for line in re.sub(r"[ \t]+", " ", text).splitlines():
        if not re.match(r"^(ffi|j)\s*$", line):
            out.append(re.sub(r"^(ffi|j)\s+", "• ", line.strip()))
    return "\n".join(out)


def read_pdf(spark: SparkSession, path: str) -> DataFrame:
    return extract(read_bytes(spark, path), pdf_text)


def read_docx(spark: SparkSession, path: str) -> DataFrame:
    return extract(read_bytes(spark, path), docx_text)


def write_documents(rows: DataFrame, path: str, name: str = "doc_id", body: str = "tex") -> None:
    """One Parquet table of rendered documents with their Base64 form (null stays null)."""
    rows.select(name, body, F.base64(F.col(body).cast("binary")).alias("base64")).write.mode("overwrite").parquet(path)


def write_tex(rows: DataFrame, path: str, name: str = "doc_id", body: str = "tex") -> None:
    """Each document as a text file of its own, in the folder ``name=value``; documents without a body are left out."""
    texts = rows.where(F.col(body).isNotNull()).select(F.col(name), F.col(body).alias("value"))
    texts.repartition(F.col(name), F.xxhash64("value")).sortWithinPartitions(name).write.mode("overwrite").partitionBy(name).text(path)


def write_profiles(rows: DataFrame, path: str, profile: str = "profile") -> None:
    """One JSON object a line; ``read_json_lines`` and any JSON reader take it back."""
    rows.select(F.to_json(profile).alias("value")).write.mode("overwrite").text(path)


def read_json_lines(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.text(path).select(F.from_json("value", PROFILE).alias("profile"))
