"""Document fingerprints from prefix polynomial hashes.

``prefix_hashes`` keeps H[i] = sum of code[j] * B**(i-1-j) modulo the prime
2**61 - 1 for every prefix, so the hash of any span is H[e] - H[s] * B**(e-s):
spans of one or of two texts are compared in constant time, and
``longest_common_extension`` is a binary search over span equality.

A fingerprint holds two samples of that array. The first is the prefix hashes
at the multiples of a power-of-two stride (the least that needs at most
``POINTS``) and at the end, with the length. The second is chosen by content:
of the hashes of all spans of ``SPAN`` characters, each with the number of its
occurrence in the text, mixed, the ``SAMPLE`` least, with the cell of the stride
where each begins. Texts of at most ``POINTS`` characters keep their whole array
instead, from which their spans follow.

``likeness`` compares two fingerprints and nothing else: the common prefix by
binary search over the kept prefix hashes; behind it, the sampled spans below
the lesser of both samples' bounds, at whatever offsets, tell which share of
the rest both texts hold. It is the shared length over the longer length: 1 for
equal fingerprints, 0 for texts that share nothing; its standard error is at
most 0.06 (all of a long text shared by half and nowhere a common prefix), and
two texts of at most ``POINTS`` characters are compared exactly. Equal texts
have equal fingerprints; different texts of equal length and hash have
probability below n / 2**61. ``near_edited`` and ``near_next`` are the
likenesses of the fingerprints returned.

``whole_edited`` and ``whole_next`` are made from the whole prefix arrays beside
them (``alike``): the common prefix is the longest common extension of both
starts; behind it, the hash of every span of ``SPAN`` characters of one text (a
quarter of the shorter text, where that is less), two entries of its array, is
looked up among those of the other, at any offset; a span that occurs more
often in one text counts as often as in the other, first ones first. The edited
text's array continues that of its text by that of the next. The value is the length that such spans and the common prefix cover, the lesser of both
texts, over the longer length. Common spans shorter than that are not counted,
and the order of long spans does not matter.

Defined cases: null and empty texts have length 0 and fingerprint ``0:1::``; two
empty texts are alike (1), an empty and a non-empty one are not (0). The next
document is that with the next greater doc_id (null first; rows that share a
doc_id are ordered by text), the last one's is the first; a single row is its
own next. Repeated rows stay; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, materialise, read_table

PRIME = (1 << 61) - 1
BASE = 1_000_003_579
POINTS = 64
#: Spans that a fingerprint keeps.
SAMPLE = 64
#: Characters of the spans that two texts are compared by.
SPAN = 32
#: Characters whose prefixes are made together; the tables of powers are as long.
BLOCK = 1 << 16


def codes(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def _mulmod(a: np.ndarray, b: int | np.ndarray) -> np.ndarray:
    """a * b modulo 2**61 - 1 for a, b < 2**61, in 64-bit arithmetic."""
    a, b = a.astype(np.uint64, copy=False), np.asarray(b, np.uint64)
    bh, bl = b >> np.uint64(31), b & np.uint64(0x7FFFFFFF)
    ah, al = a >> np.uint64(31), a & np.uint64(0x7FFFFFFF)
    mid = al * bh + ah * bl
    midh, midl = mid >> np.uint64(30), mid & np.uint64(0x3FFFFFFF)
    out = ah * bh * np.uint64(2) + midh + (midl << np.uint64(31)) + al * bl
    return _mod(out)


def _mod(x: np.ndarray) -> np.ndarray:
    p = np.uint64(PRIME)
    x = (x & p) + (x >> np.uint64(61))
    return np.minimum(x, x - p)  # below p the difference wraps to a greater value


@lru_cache(maxsize=1)
def _tables() -> tuple[np.ndarray, np.ndarray]:
    """Powers 0 to ``BLOCK`` of the base and of its inverse."""

    def table(b: int) -> np.ndarray:
        out = np.ones(1, np.uint64)
        while len(out) <= BLOCK:
            out = np.concatenate([out, _mulmod(out, pow(b, len(out), PRIME))])
        return out[: BLOCK + 1]

    return table(BASE), table(pow(BASE, -1, PRIME))


def prefix_hashes(text: str | np.ndarray) -> np.ndarray:
    """H[0..n], H[0] = 0: the modular polynomial hash of every prefix, in O(n).

    H[i] is B**(i-1) times the sum of code[j] * B**-j. The terms lie below
    2**61; their high and low bits are summed apart, which can't overflow, so
    no character waits for the one before it. Blocks carry their total on.
    """
    c = codes(text) if isinstance(text, str) else text
    up, down = _tables()
    out = np.zeros(len(c) + 1, np.uint64)
    for s in range(0, len(c), BLOCK):
        part = c[s : s + BLOCK].astype(np.uint64) + np.uint64(1)
        k = len(part)
        terms = _mulmod(part, down[:k])
        high = _mod(np.cumsum(terms >> np.uint64(32)))
        low = np.cumsum(terms & np.uint64(0xFFFFFFFF))
        # high * 2**32 modulo 2**61 - 1 is a rotation of 61 bits
        total = _mod(((high << np.uint64(32)) & np.uint64(PRIME)) + (high >> np.uint64(29)) + low)
        out[s + 1 : s + k + 1] = _mulmod(total, up[:k])
        if s:
            out[s + 1 : s + k + 1] = _mod(out[s + 1 : s + k + 1] + _mulmod(up[1 : k + 1], int(out[s])))
    return out


def appended(h: np.ndarray, g: np.ndarray) -> np.ndarray:
    """Prefix array of two texts in a row, from theirs."""
    up, last, out = _tables()[0], int(h[-1]), [h]
    for s in range(1, len(g), BLOCK):
        part = g[s : s + BLOCK]
        out.append(_mod(part + _mulmod(up[1 : len(part) + 1], last * power(s - 1) % PRIME)))
    return np.concatenate(out)


def span_hash(h: np.ndarray, s: int, e: int) -> int:
    return (int(h[e]) - int(h[s]) * power(e - s)) % PRIME


def longest_common_extension(a: np.ndarray, i: int, b: np.ndarray, j: int) -> int:
    """Length of the longest common span that starts at ``i`` in a and ``j`` in b (prefix arrays)."""
    lo, hi = 0, min(len(a) - 1 - i, len(b) - 1 - j)
    while lo < hi:
        mid = (lo + hi + 1) // 2
        if span_hash(a, i, i + mid) == span_hash(b, j, j + mid):
            lo = mid
        else:
            hi = mid - 1
    return lo


def stride_of(n: int) -> int:
    stride = 1
    while n > stride * POINTS:
        stride *= 2
    return stride


@lru_cache(maxsize=4096)
def power(k: int) -> int:
    return pow(BASE, k, PRIME)


@dataclass
class Print:
    """A fingerprint: length, stride, sampled prefix hashes, sampled spans (mixed hash, 8 bits of cell) in ascending order."""

    n: int
    stride: int
    points: list[int]
    spans: np.ndarray

    def __str__(self) -> str:
        return f"{self.n}:{self.stride}:" + ".".join(format(x, "x") for x in self.points) + ":" + ".".join(format(x, "x") for x in self.spans.tolist())

    def __eq__(self, other: object) -> bool:
        return isinstance(other, Print) and (self.n, self.points) == (other.n, other.points)

    def at(self, stride: int) -> tuple[list[int], list[int]]:
        """Offsets and prefix hashes on a coarser stride, both ends included."""
        at = list(range(stride, self.n, stride))
        return [0, *at, self.n], [0, *[self.points[p // self.stride - 1] for p in at], self.points[-1]]

    def sampled(self) -> np.ndarray:
        if self.n > POINTS:
            return self.spans
        return sample(window_hashes(self.array(), SPAN), 1)

    def array(self) -> np.ndarray:
        """The whole prefix array of a text of at most ``POINTS`` characters."""
        return np.array([0, *self.points], np.uint64)


def sample(hashes: np.ndarray, stride: int) -> np.ndarray:
    """The ``SAMPLE`` least mixed hashes (40 bits) of spans, with the cell of each (8 bits)."""
    ranks = np.zeros(len(hashes), np.uint64)
    in_order = np.sort(hashes)
    if (in_order[1:] == in_order[:-1]).any():  # the k-th occurrence of a span is another one than its first
        order = np.argsort(hashes, kind="stable")
        place = np.arange(len(hashes))
        first = np.concatenate([[True], in_order[1:] != in_order[:-1]])
        ranks[order] = place - np.maximum.accumulate(np.where(first, place, 0))
    x = hashes + ranks * np.uint64(0x9E3779B97F4A7C15)
    x = (x ^ (x >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    at = np.arange(len(x)) if len(x) <= SAMPLE else np.argpartition(x, SAMPLE - 1)[:SAMPLE]
    return np.sort((x[at] >> np.uint64(24) << np.uint64(8)) | (at // stride).astype(np.uint64))


def printed(h: np.ndarray, hashes: np.ndarray | None = None) -> Print:
    """Fingerprint from a text's prefix array (and the hashes of its spans, where they are there already)."""
    n = len(h) - 1
    stride = stride_of(n)
    points = [*h[stride:n:stride].tolist(), *h[n:].tolist()] if n else []
    if n <= POINTS:
        return Print(n, stride, points, np.zeros(0, np.uint64))
    return Print(n, stride, points, sample(window_hashes(h, SPAN) if hashes is None else hashes, stride))


def fingerprint(h: np.ndarray) -> str:
    """``length:stride:``, the sampled prefix hashes and the sampled spans in hex, from a text's prefix array."""
    return str(printed(h))


def parse(text: str) -> Print:
    n, stride, points, spans = text.split(":")
    return Print(int(n), int(stride), [int(x, 16) for x in points.split(".")] if points else [], np.array([int(x, 16) for x in spans.split(".")] if spans else [], np.uint64))


def likeness(a: str | Print, b: str | Print) -> float:
    """Shared length over the longer length, 0 to 1, from two fingerprints alone."""
    a, b = (parse(x) if isinstance(x, str) else x for x in (a, b))
    if a == b:
        return 1.0
    n, m = a.n, b.n
    if not n or not m:
        return 0.0
    if max(n, m) <= POINTS:
        return alike(Spans(a.array()), Spans(b.array()))
    stride = max(a.stride, b.stride)
    (px, hx), (py, hy) = a.at(stride), b.at(stride)
    lo, hi = 0, min(len(px), len(py)) - 1
    while lo < hi:  # the common prefix: equality of prefixes is monotone
        mid = (lo + hi + 1) // 2
        if px[mid] == py[mid] and hx[mid] == hy[mid]:
            lo = mid
        else:
            hi = mid - 1
    prefix = px[lo]
    sides, bound = [], 1 << 40
    for p in (a, b):
        spans = p.sampled()
        values = spans >> np.uint64(8)
        sides.append(values[(spans & np.uint64(255)) * np.uint64(p.stride) >= np.uint64(prefix)])
        if p.n - SPAN + 1 > SAMPLE:  # below its greatest value a sample is whole
            bound = min(bound, int(values[-1]))
    x, y = (set(rest[rest <= np.uint64(bound)].tolist()) for rest in sides)
    shared = len(x & y)
    if not shared:
        return prefix / max(n, m)
    spans = (max(0, n - SPAN + 1 - prefix) + max(0, m - SPAN + 1 - prefix)) * shared / (len(x) + len(y))
    return min(prefix + spans + SPAN - 1, n, m) / max(n, m)


def window_hashes(h: np.ndarray, width: int) -> np.ndarray:
    """``span_hash`` of every span of ``width`` characters of a prefix array."""
    if len(h) <= width:
        return np.zeros(0, np.uint64)
    return _mod(h[width:] + np.uint64(PRIME) - _mulmod(h[:-width], power(width)))


class Spans:
    """A text's prefix array, and the hashes of all its spans of one width once asked for."""

    def __init__(self, prefixes: np.ndarray):
        self.prefixes, self._width, self._hashes = prefixes, 0, None

    def __len__(self) -> int:
        return len(self.prefixes) - 1

    def hashes(self, width: int, start: int) -> np.ndarray:
        """Hashes of the spans from ``start`` on."""
        if width != self._width:
            if self._width or start:
                return window_hashes(self.prefixes[start:], width)
            self._width, self._hashes = width, window_hashes(self.prefixes, width)
        return self._hashes[start:]


def _matches(x: np.ndarray, y: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions in x and in y of the values that both hold, each value as often as in both, first ones first."""
    mask = np.uint64((1 << max(10, (8 * max(len(x), len(y))).bit_length())) - 1)
    low_x, low_y = (x & mask).astype(np.int64), (y & mask).astype(np.int64)
    table = np.zeros(int(mask) + 1, bool)  # spares the sort what the other side can't hold
    table[low_y] = True
    at_x = np.flatnonzero(table[low_x])
    table[:] = False
    table[low_x[at_x]] = True
    at_y = np.flatnonzero(table[low_y])
    if not len(at_x) or not len(at_y):
        return at_x[:0], at_y[:0]
    values = np.concatenate([x[at_x], y[at_y]])
    order = np.argsort(values, kind="stable")  # of equal values those of x first, by position
    values, of_x = values[order], order < len(at_x)
    starts = np.flatnonzero(np.concatenate([[True], values[1:] != values[:-1]]))
    sizes = np.diff(np.append(starts, len(values)))
    in_x = np.add.reduceat(of_x.astype(np.int64), starts)
    least = np.repeat(np.minimum(in_x, sizes - in_x), sizes)
    rank = np.arange(len(values)) - np.repeat(starts, sizes) - np.where(of_x, 0, np.repeat(in_x, sizes))
    kept = rank < least
    return np.sort(at_x[order[kept & of_x]]), np.sort(at_y[order[kept & ~of_x] - len(at_x)])


def alike(a: Spans, b: Spans) -> float:
    """Shared length over the longer length, 0 to 1, from two whole texts, whatever the offsets of the shared spans."""
    n, m = len(a), len(b)
    if not n or not m:
        return float(n == m)
    prefix = longest_common_extension(a.prefixes, 0, b.prefixes, 0)
    if prefix == n == m:
        return 1.0
    width = min(SPAN, max(1, min(n, m) // 4))
    start = max(0, prefix - width + 1)  # spans within the common prefix match each other

    def covered(at: np.ndarray) -> int:
        ends = at + start + width
        return prefix + int(np.minimum(width, ends - np.concatenate([[prefix], ends])[:-1]).sum())

    return min(map(covered, _matches(a.hashes(width, start), b.hashes(width, start)))) / max(n, m)


def edited(text: str, following: str) -> str:
    """The last floor(n / 4) characters replaced by the first as many (or all) of the next text."""
    cut = len(text) // 4
    return text[: len(text) - cut] + following[:cut]


def edited_prefixes(h: np.ndarray, following: np.ndarray) -> np.ndarray:
    """Prefix array of the edited text, from those of the text and the next one."""
    cut = (len(h) - 1) // 4
    return appended(h[: len(h) - cut], following[: cut + 1])


class Text(Spans):
    """A text's prefix array, the hashes of its spans and its fingerprint."""

    def __init__(self, prefixes: np.ndarray):
        super().__init__(prefixes)
        self.print = printed(prefixes, self.hashes(SPAN, 0))


def _row(text: str, following: str, own: Text | None = None) -> tuple[tuple, Text]:
    own, following_text = own or Text(prefix_hashes(text)), Text(prefix_hashes(following))
    new = Text(edited_prefixes(own.prefixes, following_text.prefixes))
    near = likeness(own.print, new.print), likeness(own.print, following_text.print)
    whole = alike(own, new), alike(own, following_text)
    return (hashlib.sha256(edited(text, following).encode()).hexdigest(), str(own.print), str(new.print), *near, *whole), following_text


OUT = "doc_id long, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double, whole_edited double, whole_next double"
SCHEMA = pa.schema([("doc_id", pa.int64()), ("n_chars", pa.int64()), ("edited_sha256", pa.string()), ("fingerprint", pa.string()), ("edited_fingerprint", pa.string()), ("near_edited", pa.float64()), ("near_next", pa.float64()), ("whole_edited", pa.float64()), ("whole_next", pa.float64())])


def with_neighbours(docs: DataFrame, partitions: int | None = None) -> DataFrame:
    """Fingerprints of every text and its edited text.

    The ids are cut into ranges at quantiles. The first text of each range (a
    map-side minimum: one row per range) is added to the range before it as a
    last row, so one shuffle of the texts brings every row together with the
    next one, also where ranges meet.
    """
    spark = docs.sparkSession
    n = partitions or max(8, int(spark.conf.get("spark.sql.shuffle.partitions")))
    rows = doc_texts(docs)
    cuts = sorted(set(rows.approxQuantile("doc_id", [k / n for k in range(1, n)], 0.2 / n))) if n > 1 else []
    cuts = F.array(*[F.lit(int(c)) for c in cuts]).cast("array<long>")
    rows = rows.withColumn("part", F.when(F.col("doc_id").isNull(), 0).otherwise(F.size(F.filter(cuts, lambda c: c < F.col("doc_id")))))
    first = F.min(F.struct(F.col("doc_id").isNotNull().alias("known"), "doc_id", "text"))
    heads = materialise(rows.groupBy("part").agg(first.alias("x")).select("part", "x.text"), "heads")
    # the ranges that hold rows, in order: one integer for each range
    order = [r[0] for r in heads.select("part").orderBy("part").collect()]
    before = [(p, order[i - 1]) for i, p in enumerate(order)] or [(-1, -1)]
    moved = F.broadcast(spark.createDataFrame(before, "part int, last_of int"))
    tails = heads.join(moved, "part").select(F.lit(None).cast("long").alias("doc_id"), "text", F.col("last_of").alias("part"), F.lit(True).alias("tail"))
    both = rows.withColumn("tail", F.lit(False)).unionByName(tails)
    both = both.repartitionById(n, "part").sortWithinPartitions("part", "tail", "doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = own = None
        for b in batches:
            out = []
            for doc_id, text, _, tail in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if held is not None:
                    found, own = _row(held[1], text, own)
                    out.append((held[0], len(held[1]), *found))
                if tail:
                    held = own = None
                else:
                    held = (doc_id, text)
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c, f.type) for c, f in zip(zip(*out, strict=True), SCHEMA, strict=True)], schema=SCHEMA)

    return both.select("doc_id", "text", "part", "tail").mapInArrow(run, OUT)


def op8_prefix_fingerprints(spark: SparkSession, sf_dir: str) -> DataFrame:
    return with_neighbours(read_table(spark, sf_dir, "documents"))
