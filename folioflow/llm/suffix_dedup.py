"""Removal of repeated byte strings by external induced suffix sorting.

A byte goes if a string of ``LENGTH`` bytes that covers it also starts anywhere
else in the corpus. Sorting every suffix of the corpus would take many times its
size on disk; only suffixes that decide something are sorted here.

1. *Sampling.* Each window of ``LENGTH`` bytes has an anchor: its ``GRAM``-byte
   string of least hash, the leftmost of equals. It depends on the window's
   content alone, so equal windows have equal anchors at equal offsets. An anchor
   stands for the windows ``lo..hi`` that chose it, about one per 190 bytes, and
   its context is the bytes these windows cover.
2. *Naming.* Contexts are named by a 128-bit hash and counted in the whole corpus
   (pre-aggregated in each document, then map-side). All windows of a context
   that occurs twice are repeated; one occurrence goes on as representative.
3. *Induction.* Among representatives with the same anchor string, the suffixes
   from the anchor on are sorted with their common-prefix values: runs in memory,
   merged from a mapped file that holds the contexts. From the order of the
   suffixes ``r`` bytes left of the anchors, the order ``r + 1`` bytes left is
   induced: the tuples (byte in front, suffix, common prefix) stream block by
   block from one priority queue into the next, each of which spills sorted runs
   to disk; the new common-prefix value is one more than the least one since the
   last tuple with the same byte in front. A window is repeated exactly if a
   neighbour's common prefix reaches ``LENGTH``. Tuples that cannot reach it any
   more leave the queue. A task holds ``QUEUE`` tuples of a queue and a few
   numbers for each context in memory, the rest in Spark's own local folders: a
   lost executor repeats the task.
4. *Hot anchors.* Anchor strings with more than ``HOT`` different contexts are not
   gathered in one task: their windows are hashed (128 bits) and counted.

Defined cases: texts are UTF-8 bytes; null and empty texts have none; texts
shorter than ``LENGTH`` lose nothing; long texts are read whole, in segments
that overlap by a window; matches never cross documents; rows that repeat are
documents of their own, so they repeat each other; an empty table gives an
empty result.
"""

from __future__ import annotations

import hashlib
import heapq
import os
import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import discard, doc_texts, materialise, read_table

LENGTH = 400
GRAM = 32
#: Contexts of one anchor string that one task sorts; beyond it, the windows are counted by hash.
HOT = 50_000
#: Bytes of contexts after which a task sorts what it has, at the next anchor string.
SHARD = 1 << 26
#: Tuples that the priority queue holds before it writes a sorted run.
QUEUE = 1 << 14
POSITION_BITS = 25
SEGMENT = 1 << 24

_U = np.uint64
_BASE = 0x9E3779B97F4A7C15 | 1
_INVERSE = pow(_BASE, -1, 1 << 64)
_tables: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64."""
    size = 1 << max(12, (n - 1).bit_length())
    if size not in _tables:
        _tables.clear()

        def table(b: int) -> np.ndarray:
            steps = np.full(size, b, _U)
            steps[0] = 1
            return np.multiply.accumulate(steps)

        _tables[size] = table(_BASE), table(_INVERSE)
    return _tables[size]


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> _U(30))) * _U(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> _U(27))) * _U(0x94D049BB133111EB)
    return x ^ (x >> _U(31))


def gram_hashes(data: np.ndarray, gram: int) -> np.ndarray:
    """64-bit hash of each ``gram``-byte string."""
    up, down = _powers(len(data) + 1)
    sums = np.zeros(len(data) + 1, _U)
    np.cumsum((data.astype(_U) + _U(1)) * down[: len(data)], out=sums[1:])
    n = len(data) - gram + 1
    return _mix((sums[gram:] - sums[:n]) * up[:n])


def sliding_min(x: np.ndarray, width: int) -> np.ndarray:
    """Least value of each run of ``width`` values, in linear time: block minima from both ends."""
    n = len(x) - width + 1
    rows = -(-len(x) // width)
    pad = np.full(rows * width, np.iinfo(x.dtype).max, x.dtype)
    pad[: len(x)] = x
    grid = pad.reshape(rows, width)
    ahead = np.minimum.accumulate(grid, axis=1).reshape(-1)
    back = np.minimum.accumulate(grid[:, ::-1], axis=1)[:, ::-1].reshape(-1)
    return np.minimum(back[:n], ahead[width - 1 : width - 1 + n])


def anchors(data: np.ndarray, length: int = LENGTH, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(anchor position, first window, last window, hash of the anchor string), in order; one segment."""
    if len(data) < length:
        none = np.zeros(0, np.int64)
        return none, none, none, none.astype(_U)
    h = gram_hashes(data, gram)
    low = _U((1 << POSITION_BITS) - 1)
    at = (sliding_min((h & ~low) | np.arange(len(h), dtype=_U), length - gram + 1) & low).astype(np.int64)
    first = np.flatnonzero(np.concatenate([[True], at[1:] != at[:-1]]))
    last = np.concatenate([first[1:] - 1, [len(at) - 1]])
    return at[first], first, last, h[at[first]]


def merge_runs(runs: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Half-open intervals, sorted and joined where they touch."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(runs):
        if out and s <= out[-1][1]:
            out[-1] = (out[-1][0], max(out[-1][1], e))
        else:
            out.append((s, e))
    return out


def document_contexts(text: bytes, length: int = LENGTH) -> tuple[list[tuple], list[tuple[int, int]]]:
    """Contexts of a document: (gram hash, c1, c2, lo, hi, anchor - lo, count up to 2), and window runs repeated inside it."""
    found: dict[bytes, list] = {}
    again: list[tuple[int, int]] = []
    view = memoryview(text)
    for base in range(0, max(1, len(text) - length + 1), SEGMENT):
        data = np.frombuffer(text, np.uint8)[base : base + SEGMENT + length - 1]
        for p, lo, hi, h in zip(*(x.tolist() for x in anchors(data, length)), strict=True):
            lo, hi, p = lo + base, hi + base, p + base
            c = hashlib.blake2b(view[lo : hi + length], digest_size=16, key=(p - lo).to_bytes(4, "little")).digest()
            if c in found:
                if found[c][6] == 1:
                    again.append((found[c][3], found[c][4] + 1))
                    found[c][6] = 2
                again.append((lo, hi + 1))
            else:
                found[c] = [h - (1 << 64) if h >> 63 else h, int.from_bytes(c[:8], "little", signed=True), int.from_bytes(c[8:], "little", signed=True), lo, hi, p - lo, 1]
    return [tuple(x) for x in found.values()], merge_runs(again)


def spill_folder() -> str | None:
    """Where a task spills: the folder that Spark itself spills to and clears (None outside of a task: the system's)."""
    return os.environ.get("SPARK_LOCAL_DIRS", "").split(",")[0] or None


class SpillQueue:
    """Priority queue of (key, payload columns) with sorted runs on disk beyond ``limit`` tuples.

    All pushes come before the pops of a level. Runs lie in a folder of the
    task and go with it: a lost executor repeats the task.
    """

    def __init__(self, limit: int = QUEUE):
        self.limit, self.parts, self.held, self.files, self.folder = limit, [], 0, [], None

    def __bool__(self) -> bool:
        return bool(self.parts or self.files)

    def push(self, rows: np.ndarray) -> None:
        """``rows``: int64 matrix whose first column is the key; equal keys keep the order of their pushes."""
        self.parts.append(rows)
        self.held += len(rows)
        if self.held > self.limit:
            self._spill()

    def _sorted(self) -> np.ndarray:
        rows = np.concatenate(self.parts) if len(self.parts) > 1 else self.parts[0]
        return rows[np.argsort(rows[:, 0], kind="stable")]

    def _spill(self) -> None:
        self.folder = self.folder or tempfile.mkdtemp(prefix="induce-", dir=spill_folder())
        path = os.path.join(self.folder, f"run{len(self.files)}")
        rows = self._sorted()
        rows.tofile(path)
        self.files.append((path, rows.shape[1]))
        self.parts, self.held = [], 0

    def pop_all(self) -> Iterator[np.ndarray]:
        """All tuples in order of (key, push), as blocks."""
        if not self.files:
            if self.parts:
                yield self._sorted()
            return
        if self.parts:
            self._spill()
        step = max(1024, self.limit // (len(self.files) + 1))
        runs = [np.memmap(p, np.int64, "r").reshape(-1, w) for p, w in self.files]
        at = [0] * len(runs)
        pending: list[np.ndarray] = [run[:0] for run in runs]
        more = True
        while more:
            for j, run in enumerate(runs):
                if len(pending[j]) < step and at[j] < len(run):
                    new = run[at[j] : at[j] + step]
                    pending[j] = np.concatenate([pending[j], new])
                    at[j] += len(new)
            # everything up to the least (block end, run) of the runs with rows to read is final: later runs keep their ties of that key
            ends = [(int(pending[j][-1, 0]), j) for j in range(len(runs)) if at[j] < len(runs[j])]
            more = bool(ends)
            block = []
            for j, have in enumerate(pending):
                cut = len(have)
                if ends:
                    end, k = min(ends)
                    cut = int(np.searchsorted(have[:, 0], end, "right" if j <= k else "left"))
                block.append(have[:cut])
                pending[j] = have[cut:]
            rows = np.concatenate(block)
            if len(rows):
                yield rows[np.argsort(rows[:, 0], kind="stable")]
        del runs, pending
        for p, _ in self.files:
            os.unlink(p)
        os.rmdir(self.folder)


class Shard:
    """Contexts that are sorted together: their bytes in a mapped file of the task, three numbers each in memory."""

    def __init__(self):
        self._file = tempfile.TemporaryFile(prefix="contexts-", dir=spill_folder())
        self.size, self._starts, self._offsets, self._lasts = 0, [], [], []

    def __len__(self) -> int:
        return len(self._starts)

    def add(self, context: bytes, offset: int, last: int) -> None:
        """``offset``: the anchor's position in the context, which is also the most bytes to go left; ``last``: the last window."""
        self._file.write(context)
        self._starts.append(self.size)
        self._offsets.append(offset)
        self._lasts.append(last)
        self.size += len(context)

    def seal(self) -> None:
        self._file.flush()
        self.data = np.memmap(self._file, np.uint8, "r") if self.size else np.zeros(0, np.uint8)
        self.offsets, self.lasts = np.array(self._offsets, np.int64), np.array(self._lasts, np.int64)
        self.starts, self.ends = np.array(self._starts, np.int64), np.array([*self._starts[1:], self.size], np.int64)
        self.anchors = self.starts + self.offsets

    def from_anchor(self, k: int) -> bytes:
        return self.data[self.anchors[k] : self.ends[k]].tobytes()


Blocks = Iterator[tuple[np.ndarray, np.ndarray]]


def _right_order(shard: Shard, limit: int) -> Blocks:
    """Suffixes that start at the anchors, in order, and each one's common prefix with the one before it."""
    runs = [sorted(range(s, min(s + limit, len(shard))), key=shard.from_anchor) for s in range(0, len(shard), limit)]
    item, common, before = [], [], b""
    for k in heapq.merge(*runs, key=shard.from_anchor) if len(runs) > 1 else runs[0]:
        key = shard.from_anchor(k)
        n = min(len(before), len(key))
        if before[:n] != key[:n]:
            n = int((np.frombuffer(before, np.uint8, n) != np.frombuffer(key, np.uint8, n)).argmax())
        item.append(k)
        common.append(n)
        before = key
        if len(item) >= limit:
            yield np.array(item, np.int64), np.array(common, np.int64)
            item, common = [], []
    if item:
        yield np.array(item, np.int64), np.array(common, np.int64)


def _with_next(blocks: Blocks) -> Iterator[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """Each block with the common prefix of every tuple and the next one, also across blocks."""
    held = None
    for item, common in blocks:
        if held:
            yield *held, np.append(held[1][1:], common[0])
        held = item, common
    if held:
        yield *held, np.append(held[1][1:], 0)


_NO_BOUND = np.iinfo(np.int64).max


def _induced_common(common: np.ndarray, kept: np.ndarray, front: np.ndarray, carry: np.ndarray) -> np.ndarray:
    """Common prefix of each kept tuple, its byte in front included, with the last one that has the same byte in front.

    ``carry``: for each byte the least common prefix since its last tuple in the
    blocks before (-1: none yet); brought up to the end of this block.
    """
    order = np.argsort(front, kind="stable")
    at, byte = kept[order], front[order]
    first = np.concatenate([[True], byte[1:] != byte[:-1]])
    ahead = np.minimum.accumulate(common)
    behind = np.append(np.minimum.accumulate(common[::-1])[::-1], _NO_BOUND)
    least = np.minimum(carry[byte], ahead[at])
    k = np.flatnonzero(~first)
    if len(k):
        between = np.stack([at[k - 1] + 1, at[k] + 1], 1).reshape(-1)
        least[k] = np.minimum.reduceat(np.append(common, _NO_BOUND), between)[::2]
    np.minimum(carry, ahead[-1], out=carry)
    last = np.append(first[1:], True)
    carry[byte[last]] = behind[at[last] + 1]
    out = np.empty_like(least)
    out[order] = least + 1
    return out


def induce(shard: Shard, length: int = LENGTH, limit: int = QUEUE) -> list[list[tuple[int, int]]]:
    """For each context of a shard the runs of its windows (relative, half-open) that occur in another context as well."""
    out: list[list[tuple[int, int]]] = [[] for _ in range(len(shard))]
    if len(shard) < 2:
        return out
    shard.seal()
    offsets, blocks, r = shard.offsets, _right_order(shard, limit), 0
    while True:
        queue, carry = SpillQueue(limit), np.full(256, -1, np.int64)
        for item, common, after in _with_next(blocks):
            best = np.maximum(common, after)
            hit = item[(best >= length) & (offsets[item] - r <= shard.lasts[item])]
            for k, w in zip(hit.tolist(), (offsets[hit] - r).tolist(), strict=True):
                if out[k] and out[k][-1][0] == w + 1:
                    out[k][-1] = (w, out[k][-1][1])
                else:
                    out[k].append((w, w + 1))
            # a tuple goes on if it can go left and its best neighbour can still give a whole window
            kept = np.flatnonzero((offsets[item] > r) & (best - r + offsets[item] >= length))
            if not len(kept):
                np.minimum(carry, common.min(), out=carry)
                continue
            on = item[kept]
            front = shard.data[shard.anchors[on] - r - 1].astype(np.int64)
            queue.push(np.stack([front, on, _induced_common(common, kept, front, carry)], 1))
        if not queue:
            return out
        blocks = ((rows[:, 1], rows[:, 2]) for rows in queue.pop_all())
        r += 1


CONTEXT = "doc_id long, thash long, gram long, c1 long, c2 long, lo int, hi int, off int, n int"
RUNS = "doc_id long, thash long, lo int, hi int"


def _texts(docs: DataFrame) -> DataFrame:
    rows = doc_texts(docs)
    return rows.select("doc_id", F.xxhash64("text").alias("thash"), F.col("text").cast("binary").alias("bytes"))


def _contexts(rows: DataFrame, length: int) -> DataFrame:
    """Contexts of all documents; rows with ``gram`` null are window runs repeated inside their document."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 5 + [pa.int32()] * 4
        names = [c.split()[0] for c in CONTEXT.split(", ")]
        for b in batches:
            made: list[tuple] = []
            for doc_id, thash, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if len(text) < length:
                    continue
                found, again = document_contexts(text, length)
                made += [(doc_id, thash, *x) for x in found]
                made += [(doc_id, thash, None, None, None, s, e - 1, None, None) for s, e in again]
                if len(made) > 50_000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)
                    made = []
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)

    return rows.where(F.octet_length("bytes") >= length).mapInArrow(run, CONTEXT)


def _cut(rows: DataFrame, reps: DataFrame, length: int) -> DataFrame:
    """The bytes of the representatives: one row per context, cut from their documents."""
    one = reps.groupBy("doc_id", "thash").agg(F.collect_list(F.struct("gram", "lo", "hi", "off", "known", "hot")).alias("cuts"))
    same = rows["doc_id"].eqNullSafe(one["doc_id"]) & (rows["thash"] == one["thash"])
    joined = rows.join(one, same).select(rows["doc_id"], rows["thash"], "bytes", "cuts")
    # rows that repeat hold the same bytes; one of them is enough
    schema = "doc_id long, thash long, gram long, lo int, hi int, off int, known boolean, hot boolean, context binary"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        types = [pa.int64()] * 3 + [pa.int32()] * 3 + [pa.bool_(), pa.bool_(), pa.binary()]
        names = [c.split()[0] for c in schema.split(", ")]
        for b in batches:
            made, size = [], 0
            for doc_id, thash, text, cuts in zip(*(c.to_pylist() for c in b.columns), strict=True):
                for c in cuts:
                    made.append((doc_id, thash, c["gram"], c["lo"], c["hi"], c["off"], c["known"], c["hot"], text[c["lo"] : c["hi"] + length]))
                    size += length
                if size > 1 << 23:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)
                    made, size = [], 0
            if made:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True), types, strict=True)], names)

    return joined.mapInArrow(run, schema)


def _sorted_runs(cut: DataFrame, length: int) -> DataFrame:
    """Window runs found by induction; anchor strings lie together, each task goes through its own in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def solve() -> pa.RecordBatch:
            made = [(doc_id, thash, lo + s, lo + e - 1) for (doc_id, thash, lo, known), runs in zip(held, induce(shard, length), strict=True) if not known for s, e in runs]
            columns = zip(*made, strict=True) if made else [[], [], [], []]
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, [pa.int64(), pa.int64(), pa.int32(), pa.int32()], strict=True)], ["doc_id", "thash", "lo", "hi"])

        held, shard, seen, gram = [], Shard(), set(), None
        for b in batches:
            for g, doc_id, thash, lo, hi, off, known, context in zip(*(c.to_pylist() for c in b.columns), strict=True):
                if g != gram:
                    if shard.size >= SHARD:
                        yield solve()
                        held, shard = [], Shard()
                    gram, seen = g, set()
                if (doc_id, thash, lo, off) in seen:  # rows of repeated documents come twice
                    continue
                seen.add((doc_id, thash, lo, off))
                held.append((doc_id, thash, lo, known))
                shard.add(context, off, hi - lo)
        if held:
            yield solve()

    rows = cut.where("not hot").select("gram", "doc_id", "thash", "lo", "hi", "off", "known", "context")
    return rows.repartition("gram").sortWithinPartitions("gram").mapInArrow(run, RUNS)


def _counted_windows(cut: DataFrame, length: int) -> DataFrame:
    """Repeated windows of hot anchor strings, by counting 128-bit hashes of single windows."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for doc_id, thash, lo, hi, known, context in zip(*(c.to_pylist() for c in b.columns), strict=True):
                view = memoryview(context)
                keys = [hashlib.blake2b(view[i : i + length], digest_size=16).digest() for i in range(hi - lo + 1)]
                n = len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([doc_id] * n, pa.int64()), pa.array([thash] * n, pa.int64()), pa.array(range(lo, hi + 1), pa.int32()), pa.array([known] * n, pa.bool_()), pa.array(keys, pa.binary())], ["doc_id", "thash", "at", "known", "w"])

    rows = cut.where("hot").select("doc_id", "thash", "lo", "hi", "known", "context").distinct()
    windows = materialise(rows.mapInArrow(run, "doc_id long, thash long, at int, known boolean, w binary"), "windows")
    often = windows.groupBy("w").agg(F.sum(F.when(F.col("known"), 2).otherwise(1)).alias("n")).where("n > 1").select("w")
    return windows.where("not known").join(often, "w").select("doc_id", "thash", F.col("at").alias("lo"), F.col("at").alias("hi"))


def repeated_windows(docs: DataFrame, length: int = LENGTH, hot: int = HOT) -> DataFrame:
    """``doc_id, thash, lo, hi``: runs of window starts whose ``length`` bytes occur elsewhere too."""
    rows = _texts(docs)
    every = materialise(_contexts(rows, length), "contexts")
    inside = every.where(F.col("gram").isNull()).select("doc_id", "thash", "lo", "hi")
    placed = every.where(F.col("gram").isNotNull())
    named = placed.groupBy("gram", "c1", "c2").agg(F.sum("n").alias("n"), F.min(F.struct("doc_id", "thash", "lo", "hi", "off")).alias("rep"))
    named = materialise(named, "named")
    grams = named.groupBy("gram").agg(F.count("*").alias("d")).where("d > 1")
    reps = named.join(grams, "gram").select("gram", "rep.*", (F.col("n") > 1).alias("known"), (F.col("d") > hot).alias("hot"))
    cut = materialise(_cut(rows, reps, length), "cut")
    twice = named.where("n > 1").select("gram", "c1", "c2")
    copies = placed.join(twice, ["gram", "c1", "c2"]).select("doc_id", "thash", "lo", "hi")
    found = inside.unionByName(copies).unionByName(_sorted_runs(cut, length))
    if not cut.where("hot").isEmpty():
        found = found.unionByName(_counted_windows(cut, length))
    one = found.groupBy("doc_id", "thash").agg(F.collect_list(F.struct("lo", "hi")).alias("runs"))
    out = materialise(one, "runs")
    for used in (every, named, cut):
        discard(used)
    return out


def remove_repeats(docs: DataFrame, length: int = LENGTH, hot: int = HOT, keep: bool = False) -> DataFrame:
    """``doc_id, n_bytes, n_removed, n_spans, kept_sha256`` (and the bytes ``kept``) of every document."""
    runs = repeated_windows(docs, length, hot)
    rows = _texts(docs)
    same = rows["doc_id"].eqNullSafe(runs["doc_id"]) & (rows["thash"] == runs["thash"])
    joined = rows.join(runs, same, "left").select(rows["doc_id"], "bytes", "runs")
    schema = "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string" + (", kept binary" if keep else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            made = []
            for doc_id, text, found in zip(*(c.to_pylist() for c in b.columns), strict=True):
                spans = merge_runs([(x["lo"], x["hi"] + length) for x in found or ()])
                at, parts = 0, []
                for s, e in spans:
                    parts.append(text[at:s])
                    at = e
                parts.append(text[at:])
                rest = b"".join(parts)
                made.append((doc_id, len(text), len(text) - len(rest), len(spans), hashlib.sha256(rest).hexdigest()) + ((rest,) if keep else ()))
            types = [pa.int64()] * 4 + [pa.string()] + ([pa.binary()] if keep else [])
            names = [c.split()[0] for c in schema.split(", ")]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*made, strict=True) if made else [[]] * len(types), types, strict=True)], names)

    return joined.mapInArrow(run, schema)


def op3_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(read_table(spark, sf_dir, "documents"))
