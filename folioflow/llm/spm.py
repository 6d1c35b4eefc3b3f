"""SentencePiece encoding and decoding on the ``tokenizers`` library.

The model protobuf is parsed (:func:`folioflow.llm.tokens.load_model`) and its
parts are rebuilt: the normaliser (the precompiled character map where the
model has one, the leading mark, spaces to marks), the word mark, the scores
(unigram log probabilities, or the merge order of a BPE model) and the byte
fallback. Whole batches are encoded by the library's own threads.

Pieces of marks only share one score; SentencePiece then merges from the left,
which is the order given to their merges here.

*Units.* Where the normaliser does no more than set marks and no piece holds a
mark or a line break behind another character, no token crosses the border
between two units (a run of marks with what follows it). The library then
encodes each unit that a worker has not seen lately, those of a BPE model as the lines of
one text; the ids of a text are those of its units. Units are found on the bytes of many
texts at once. Other models get whole texts.

*Parity.* Each row is also encoded as a whole with the ``sentencepiece`` library;
``parity`` says for each row that the ids are equal. The ids given out are those
of ``tokenizers``, always (two splits of exactly equal unigram score may be told
apart by rounding: such a row has parity false). ``round_trip`` says that decoding gives back the text:
pieces are taken from a table of their bytes, which is what the library's decoder
gives for valid UTF-8; anything else goes through that decoder.

Defined cases: null and empty texts have no tokens and decode to the empty
text; very long texts are encoded whole; repeated rows are encoded each;
an empty table gives an empty result; other columns pass through
:func:`encode_documents` untouched.
"""

from __future__ import annotations

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import free_name, read_table, whole_text
from .tokens import BYTE, MARK, NORMAL, UNKNOWN, load_model, model_path

#: Characters handed to the library at once: bounds what a worker holds in tokens.
BATCH_CHARS = 1 << 20
#: Units that one worker keeps, and the length beyond which it keeps none (memory only, never results).
CACHE_UNITS = 400_000
LONG_UNIT = 64
#: Units encoded as the lines of one text.
LINES = 64


@lru_cache(maxsize=2)
def build(path: str):
    """A ``tokenizers.Tokenizer`` equal to the SentencePiece model in ``path``."""
    from tokenizers import Regex, Tokenizer, decoders, models, normalizers

    m = load_model(path)
    pieces = m["pieces"]
    ids = {p: i for i, (p, _, _) in enumerate(pieces)}
    unk = next(i for i, p in enumerate(pieces) if p[2] == UNKNOWN)
    steps = []
    if m["charsmap"]:
        steps.append(normalizers.Precompiled(m["charsmap"]))
    if m["squeeze"]:
        steps += [normalizers.Strip(), normalizers.Replace(Regex(" {2,}"), " ")]
    if m["dummy_prefix"]:
        steps.append(normalizers.Prepend(MARK))
    steps.append(normalizers.Replace(" ", MARK))
    if m["bpe"]:
        tok = Tokenizer(models.BPE(vocab=ids, merges=merge_order(pieces), unk_token=pieces[unk][0], fuse_unk=True, byte_fallback=m["byte_fallback"]))
    else:
        tok = Tokenizer(models.Unigram([(p, s) for p, s, _ in pieces], unk, m["byte_fallback"]))
    tok.normalizer = normalizers.Sequence(steps)
    tail = [decoders.ByteFallback(), decoders.Fuse()] + ([decoders.Strip(" ", 1, 0)] if m["dummy_prefix"] else [])
    tok.decoder = decoders.Sequence([decoders.Replace(MARK, " "), *tail])
    return tok


def merge_order(pieces: list[tuple[str, float, int]]) -> list[tuple[str, str]]:
    """The merges of a BPE model, best first: every split of a piece into two pieces ranks by the score of the whole."""
    known = {p: s for p, s, kind in pieces if kind == NORMAL}
    out, marks = [], []
    for at, (p, s, kind) in enumerate(pieces):
        if kind != NORMAL or len(p) < 2:
            continue
        if not p.strip(MARK):
            # of equal scores the leftmost pair goes first, so the run that has grown longest grows on
            marks += [(-s, -len(p), -i, p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in known and p[i:] in known]
            continue
        out += [(-s, at, p[:i], p[i:]) for i in range(1, len(p)) if p[:i] in known and p[i:] in known]
    return [(a, b) for _, _, a, b in sorted(out)] + [(a, b) for *_, a, b in sorted(marks)]


@lru_cache(maxsize=2)
def oracle(path: str):
    import sentencepiece

    return sentencepiece.SentencePieceProcessor(model_file=path)


@lru_cache(maxsize=2)
def build_marked(path: str):
    """The tokenizer without its normaliser, for texts marked before, or None where there is more to normalise."""
    from tokenizers import Tokenizer

    m = load_model(path)
    if m["charsmap"] or m["squeeze"] or not m["dummy_prefix"]:
        return None
    tok = Tokenizer.from_str(build(path).to_str())
    tok.normalizer = None
    return tok


def encode_batch(texts: list[str], path: str, threads: int) -> list[list[int]]:
    """The ids of every text, encoded as a whole."""
    os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
    os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
    tok = build_marked(path)
    if tok is None:
        tok = build(path)
    else:
        texts = [MARK + t.replace(" ", MARK) if t else t for t in texts]
    return [e.ids for e in tok.encode_batch_fast(texts, add_special_tokens=False)]


class Units:
    """Packed ids (32-bit, little-endian) of texts, by their units."""

    def __init__(self, path: str):
        self.path, self.known = path, {}
        joined = any(MARK in p.lstrip(MARK) or ("\n" in p and len(p) > 1) for p, _, _ in load_model(path)["pieces"])
        self.whole = joined or build_marked(path) is None
        self.line = None if self.whole else self.line_id()

    def encode(self, texts: list[str], threads: int) -> list[bytes]:
        if self.whole:
            return [packed(x) for x in encode_batch(texts, self.path, threads)]
        known = self.known
        if len(known) > CACHE_UNITS:
            known.clear()
        units, bounds = self.units(texts)
        coded = units.dictionary_encode()
        told = coded.dictionary.to_pylist()
        new = [u for u in told if u not in known]
        if new:
            os.environ["TOKENIZERS_PARALLELISM"] = "true" if threads > 1 else "false"
            os.environ.setdefault("RAYON_NUM_THREADS", str(threads))
            known.update(zip(new, self.encode_units([u.replace(" ", MARK) for u in new]), strict=True))
        ids = pa.array([known[u] for u in told], pa.large_binary()).take(coded.indices)
        data, ends = memoryview(ids.buffers()[2] or b""), np.frombuffer(ids.buffers()[1], np.int64)[bounds] if len(ids) else bounds
        for u in new:
            if len(u) > LONG_UNIT:  # met once, as a rule
                del known[u]
        return [bytes(data[a:b]) for a, b in zip(ends[:-1].tolist(), ends[1:].tolist(), strict=True)]

    def line_id(self) -> int | None:
        """The id of a line break where units can be encoded as lines of one text: a BPE model's merges don't cross it, and nothing else has its id."""
        m, ids = load_model(self.path), build_marked(self.path).encode("\n", add_special_tokens=False).ids
        return ids[0] if m["bpe"] and len(ids) == 1 and m["pieces"][ids[0]][2] in (NORMAL, BYTE) else None

    def encode_units(self, units: list[str]) -> list[bytes]:
        """The packed ids of marked units, each encoded on its own or as a line among others."""
        encode = lambda texts: build_marked(self.path).encode_batch_fast(texts, add_special_tokens=False)
        if self.line is None:
            return [packed(e.ids) for e in encode(units)]
        out = []
        # a unit with a line break is the line break alone
        parts = [units[at : at + LINES] for at in range(0, len(units), LINES)]
        for part, e in zip(parts, encode(["\n".join("" if u == "\n" else u for u in part) for part in parts]), strict=True):
            ids = np.array(e.ids, "<i4")
            cuts, raw = np.flatnonzero(ids == self.line).tolist(), ids.tobytes()
            out += [packed([self.line]) if u == "\n" else raw[4 * a : 4 * b] for u, a, b in zip(part, [0, *[c + 1 for c in cuts]], [*cuts, len(ids)], strict=True)]
        return out

    @staticmethod
    def units(texts: list[str]) -> tuple[pa.Array, np.ndarray]:
        """(the units of all texts as slices of their bytes, marks as blanks; where the units of each text begin and end among them)."""
        coded = [f" {t.replace(MARK, ' ')}".encode() if t else b"" for t in texts]
        data, cuts = np.frombuffer(b"".join(coded), np.uint8), np.cumsum([0, *map(len, coded)])
        blank, line = data == 32, data == 10
        begins = line | blank
        begins[1:] &= ~(blank[1:] & blank[:-1])
        begins[1:] |= line[:-1]
        begins[cuts[:-1][cuts[:-1] < len(data)]] = True
        starts = np.append(np.flatnonzero(begins), len(data))
        return pa.Array.from_buffers(pa.large_string(), len(starts) - 1, [None, pa.py_buffer(starts.astype(np.int64)), pa.py_buffer(data)]), np.searchsorted(starts, cuts)


def packed(ids: list[int]) -> bytes:
    return np.array(ids, "<i4").tobytes()


@lru_cache(maxsize=2)
def units_of(path: str) -> Units:
    return Units(path)


def parity(ids: list[bytes], texts: list[str], path: str, threads: int) -> list[bool]:
    """For every text, whether the reference library gives the same ids for it as a whole."""
    want = oracle(path).encode_as_numpy(texts, num_threads=threads)
    return [x == y.astype("<i4", copy=False).tobytes() for x, y in zip(ids, want, strict=True)]


@lru_cache(maxsize=2)
def piece_bytes(path: str) -> pa.Array:
    """What each id stands for."""
    m = load_model(path)
    return pa.array([bytes([int(p[1:-1], 16)]) if kind == BYTE else p.replace(MARK, " ").encode() for p, _, kind in m["pieces"]], pa.binary())


def decode_batch(ids: list[list[int]], path: str) -> list[str]:
    """The texts of ids, by the library's decoder."""
    return build(path).decode_batch(ids, skip_special_tokens=False)


def decode_packed(ids: list[bytes], path: str) -> list[str]:
    """The texts of packed ids."""
    flat = np.frombuffer(b"".join(ids), "<i4")
    taken = piece_bytes(path).take(pa.array(flat))
    data, ends = memoryview(taken.buffers()[2] or b""), np.frombuffer(taken.buffers()[1], np.int32) if len(flat) else np.zeros(1, np.int32)
    out, at, strip = [], 0, load_model(path)["dummy_prefix"]
    for x in ids:
        to = at + len(x) // 4
        raw = bytes(data[ends[at] : ends[to]])
        try:
            out.append(raw.decode()[strip and raw[:1] == b" " :])
        except UnicodeDecodeError:
            out += decode_batch([flat[at:to].tolist()], path)
        at = to
    return out


def blocks(texts: list[str]) -> Iterator[list[str]]:
    """The texts in order, in lists of about ``BATCH_CHARS`` characters."""
    out, n = [], 0
    for t in texts:
        out.append(t)
        n += len(t)
        if n >= BATCH_CHARS:
            yield out
            out, n = [], 0
    if out:
        yield out


def encode_documents(docs: DataFrame, path: str | None = None, threads: int = 2, verify: bool = True, keep_ids: bool = True) -> DataFrame:
    """Add ``n_tokens, ids_crc32, parity, round_trip`` (and ``token_ids``) to every row; one narrow pass, no shuffle.

    ``ids_crc32`` is the CRC-32 of the ids as little-endian 32-bit integers.
    Columns of ``docs`` that have one of these names are replaced.
    """
    path = path or model_path()
    new = T.StructType().add("n_tokens", "long").add("ids_crc32", "long").add("parity", "boolean").add("round_trip", "boolean")
    if keep_ids:
        new = new.add("token_ids", T.ArrayType(T.IntegerType()))
    made = {f.name for f in new}
    kept = docs.select(*[F.col(f"`{c}`") for c in docs.columns if c.lower() not in made])
    text = free_name(kept, "spm_text")
    source = kept.withColumn(text, whole_text())
    names = [*kept.columns, *[f.name for f in new]]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at = 0
            for part in blocks(b.column(b.num_columns - 1).to_pylist()):
                ids = units_of(path).encode(part, threads)
                same = parity(ids, part, path, threads) if verify else [None] * len(part)
                back = [x == y for x, y in zip(decode_packed(ids, path), part, strict=True)]
                sizes = [len(x) // 4 for x in ids]
                columns = [
                    *b.slice(at, len(part)).columns[:-1],
                    pa.array(sizes, pa.int64()),
                    pa.array([zlib.crc32(x) for x in ids], pa.int64()),
                    pa.array(same, pa.bool_()),
                    pa.array(back, pa.bool_()),
                ]
                if keep_ids:
                    ends = pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32())
                    columns.append(pa.ListArray.from_arrays(ends, pa.array(np.frombuffer(b"".join(ids), "<i4"), pa.int32())))
                at += len(part)
                yield pa.RecordBatch.from_arrays(columns, names)

    return source.mapInArrow(run, T.StructType([*kept.schema.fields, *new.fields]))


def op5_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every document's token count, digest of its ids, parity with the reference library and round trip."""
    docs = read_table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    return encode_documents(docs, keep_ids=False).drop("text")
