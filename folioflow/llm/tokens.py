"""Token counts by a compiled finite-state transducer.

The tokenizer is a BPE SentencePiece model whose pieces hold the word mark
only at their start. The text is therefore read as units (a run of marks with
the characters after it, ended by the next mark or line break) that never
share a piece, and the transducer is back in its start state at each unit.

*Transducer.* Its state keeps, for every position from which a vocabulary piece
could still be going on, the text since then, the piece that ends there and the
tokens emitted up to there, counted against the present position. Reading a
character finds the one piece that ends here and is compatible with the piece
before it (two pieces are compatible if merging their joint text gives back
exactly these two), so every transition is deterministic and carries the change
of the token count. States are compiled on demand, numbered and kept; a unit
seen before is one lookup of its composed transitions.

*Chunks.* A chunk of text maps the state before it to the state after it and a
count. Behind the chunk's first unit border neither depends on the state before:
the map is (head before that border, tokens from there on, state at the end). The
head is the part that still waits for a state; without a border the whole chunk
is head. Maps compose associatively by running a waiting head from the state
that the map before ends in, no text is read twice, and :meth:`CountTransducer.scan_maps` does the
prefix scan over the chunks of long texts, so that no chunk border changes a count.

Defined cases: a null text counts as empty, an empty text has no tokens, very
long texts are read in chunks of ``CHUNK`` characters, repeated rows are
counted each on its own, an empty table gives an empty result.
"""

from __future__ import annotations

import re
import struct
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, read_table

MARK = "▁"
CHUNK = 1 << 16
LIMIT = 4096
#: Units and states that one worker keeps; beyond it compiles them anew (memory only, never results).
CACHE_UNITS = 800_000
CACHE_STATES = 300_000
#: The state at a unit border.
START = (("", "", 0),)
UNIT = re.compile(rf"{MARK}+[^{MARK}\n]*|[^{MARK}\n]+|\n")


def model_path(name: str = "piece_bpe_32k.model") -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


def _varint(b: bytes, i: int) -> tuple[int, int]:
    out = shift = 0
    while True:
        c = b[i]
        i += 1
        out |= (c & 127) << shift
        shift += 7
        if c < 128:
            return out, i


def proto_fields(b: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(field number, value) of a protobuf message; nested messages and strings come as bytes."""
    i = 0
    while i < len(b):
        key, i = _varint(b, i)
        wire = key & 7
        if wire == 0:
            value, i = _varint(b, i)
        elif wire == 2:
            n, i = _varint(b, i)
            value, i = b[i : i + n], i + n
        elif wire in (1, 5):
            n = 8 if wire == 1 else 4
            value, i = b[i : i + n], i + n
        else:
            raise ValueError(f"wire type {wire}")
        yield key >> 3, value


#: Piece types of the SentencePiece model format (fixed values).
NORMAL, UNKNOWN, CONTROL, USER, UNUSED, BYTE = 1, 2, 3, 4, 5, 6


@lru_cache(maxsize=4)
def load_model(path: str) -> dict:
    """pieces [(text, score, type)], trainer and normaliser settings of a SentencePiece model file."""
    pieces, trainer, normaliser = [], {}, {}
    with open(path, "rb") as f:
        data = f.read()
    for n, value in proto_fields(data):
        if n == 1:
            d = dict(proto_fields(value))
            pieces.append((d[1].decode(), struct.unpack("<f", d[2])[0] if 2 in d else 0.0, d.get(3, NORMAL)))
        elif n == 2:
            trainer = dict(proto_fields(value))
        elif n == 3:
            normaliser = dict(proto_fields(value))
    return {
        "pieces": pieces,
        "bpe": trainer.get(3, 1) == 2,
        "byte_fallback": bool(trainer.get(35, 0)),
        "dummy_prefix": bool(normaliser.get(3, 1)),
        "squeeze": bool(normaliser.get(4, 1)),
        "charsmap": normaliser.get(2, b""),
    }


class CountTransducer:
    """Deterministic transducer from characters to changes of the token count."""

    def __init__(self, pieces: dict[str, float]):
        if any(MARK in p.lstrip(MARK) for p in pieces):
            raise ValueError("a piece holds the word mark inside: units would not be independent")
        self.scores = pieces
        self.prefixes = {p[:i] for p in pieces for i in range(1, len(p))}
        self.pairs: dict[tuple[str, str], bool] = {}
        self.units: dict[str, int] = {}
        self._reset()

    def _reset(self) -> None:
        # a state: tuple of (text since the position, piece ending at the position, tokens emitted there - tokens now)
        self.states: list[tuple] = [START]
        self.numbers = {self.states[0]: 0}
        self.moves: list[dict[str, tuple[int, int]]] = [{}]

    def merge(self, text: str) -> list[str]:
        """Plain BPE: of all neighbours whose joint text is a piece, the best score first, leftmost among equals."""
        parts = list(text)
        while True:
            best, at = None, -1
            for i in range(len(parts) - 1):
                score = self.scores.get(parts[i] + parts[i + 1])
                if score is not None and (best is None or score > best):
                    best, at = score, i
            if at < 0:
                return parts
            parts[at : at + 2] = [parts[at] + parts[at + 1]]

    def compatible(self, a: str, b: str) -> bool:
        if not a:
            return self.merge(b) == [b] if len(b) > 1 else True
        out = self.pairs.get((a, b))
        if out is None:
            if len(self.pairs) > CACHE_UNITS:
                self.pairs.clear()
            out = self.pairs[a, b] = self.merge(a + b) == [a, b]
        return out

    def _compile(self, state: int, c: str) -> tuple[int, int]:
        """The transition of a state under a character: (next state, change of the count)."""
        found, grown = None, []
        for text, piece, count in self.states[state]:
            t = text + c
            if (len(t) == 1 or t in self.scores) and found is None and self.compatible(piece, t):
                # a character that is no piece falls back to its bytes and merges with nothing
                found = (t, count + (1 if t in self.scores else len(c.encode())))
            if t in self.prefixes:
                grown.append((t, piece, count))
        last, change = found
        nxt = tuple((t, p, k - change) for t, p, k in grown) + (("", last, 0),)
        number = self.number(nxt)
        self.moves[state][c] = number, change
        return number, change

    def number(self, state: tuple) -> int:
        """The number of a state, which holds until the compiled states are dropped."""
        n = self.numbers.get(state)
        if n is None:
            n = self.numbers[state] = len(self.states)
            self.states.append(state)
            self.moves.append({})
        return n

    def run(self, text: str, state: int = 0) -> tuple[int, int]:
        """(state, tokens) after ``text``."""
        total, moves = 0, self.moves
        for c in text:
            move = moves[state].get(c)
            if move is None:
                if len(self.states) > CACHE_STATES:  # one unit can be longer than the cache holds states
                    here = self.states[state]
                    self._reset()
                    state, moves = self.number(here), self.moves
                move = self._compile(state, c)
            state = move[0]
            total += move[1]
        return state, total

    def unit(self, text: str) -> int:
        n = self.units.get(text)
        if n is None:
            if len(self.states) > CACHE_STATES:
                self._reset()
            if len(self.units) > CACHE_UNITS:
                self.units.clear()
            n = self.run(text)[1]
            if len(text) <= 64:
                self.units[text] = n
        return n

    def chunk_map(self, chunk: str) -> tuple[str, int, tuple | None]:
        """(head, tokens behind it, state at the end) of a chunk of marked text; no state: all of it is head."""
        cuts = [i for i in (chunk.find(MARK), chunk.find("\n")) if i >= 0]
        if not cuts:
            return chunk, 0, None
        first = min(cuts)
        last = chunk.rfind(MARK)
        while last > 0 and chunk[last - 1] == MARK:
            last -= 1
        last = max(last, chunk.rfind("\n"))
        total = self.body(chunk[first:last])
        # behind a line break the next character begins a unit
        tail = chunk[last:]
        if tail[0] == "\n":
            total, tail = total + self.unit("\n"), tail[1:]
        state, n = self.run(tail)
        return chunk[:first], total + n, self.states[state]

    def body(self, text: str) -> int:
        """Tokens of marked text that ends at a unit border."""
        if not text:
            return 0
        units, total = self.units, 0
        if MARK + MARK in text:
            for u in UNIT.findall(text):
                n = units.get(u)
                total += self.unit(u) if n is None else n
            return total
        for k, line in enumerate(text.split("\n")):
            if k:
                total += self.unit("\n")
            words = line.split(MARK)
            if words[0]:
                total += self.unit(words[0])
            for w in words[1:]:
                w = MARK + w
                n = units.get(w)
                total += self.unit(w) if n is None else n
        return total

    def compose(self, a: tuple, b: tuple) -> tuple:
        """The map of chunk ``a`` followed by chunk ``b``; associative."""
        if a[2] is None:
            return a[0] + b[0], b[1], b[2]
        state, n = self.run(b[0], self.number(a[2]))
        return a[0], a[1] + n + b[1], self.states[state] if b[2] is None else b[2]

    def scan_maps(self, text: str) -> int:
        """Tokens of a whole marked text: chunk maps, then the prefix scan from the start state."""
        maps, i = [("", 0, START)], 0
        while i < len(text):
            j = min(len(text), i + CHUNK)
            while j < len(text) and text[j] == MARK:  # a run of marks stays in one chunk
                j += 1
            maps.append(self.chunk_map(text[i:j]))
            i = j
        while len(maps) > 1:
            maps = [self.compose(*maps[k : k + 2]) if k + 1 < len(maps) else maps[k] for k in range(0, len(maps), 2)]
        return maps[0][1]

    def count(self, text: str) -> int:
        """Tokens of a raw text."""
        if not text:
            return 0
        marked = MARK + text.replace(" ", MARK)
        return self.body(marked) if len(marked) <= CHUNK else self.scan_maps(marked)


@lru_cache(maxsize=2)
def transducer(path: str) -> CountTransducer:
    model = load_model(path)
    if not (model["bpe"] and model["byte_fallback"] and model["dummy_prefix"]) or model["squeeze"] or model["charsmap"]:
        raise ValueError("the transducer is built for BPE with byte fallback, a leading mark and no normalisation")
    return CountTransducer({p: s for p, s, kind in model["pieces"] if kind == NORMAL})


def token_counts(docs: DataFrame, path: str | None = None, limit: int = LIMIT) -> DataFrame:
    """``doc_id, n_bytes, n_tokens, over_limit`` of every whole text; one narrow pass, no shuffle."""
    path = path or model_path()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fst = transducer(path)
        for b in batches:
            tokens = pa.array([fst.count(t) for t in b.column(1).to_pylist()], pa.int64())
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), tokens], ["doc_id", "n_bytes", "n_tokens"])

    texts = doc_texts(docs).withColumn("n_bytes", F.octet_length("text").cast("long"))
    out = texts.mapInArrow(count, "doc_id long, n_bytes long, n_tokens long")
    return out.withColumn("over_limit", F.col("n_tokens") > limit)


def op9_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(read_table(spark, sf_dir, "documents"))
