"""Alignment of two tokenizers' tokens, and how often their ids are linked.

*Groups.* The byte ranges of the tokens of A and B over one text are the two
sides of a bipartite graph; overlapping ranges are its edges. Union-find joins
them, and the components are the smallest stretches at whose ends tokens of
both end. Each A token of a component is linked with each of its B tokens.

*Segments.* A text is cut where neither tokenizer lets a token cross: before a
space or line break behind a character that is no white space, behind a
line break that stands alone or first of two, and between a Latin letter or digit and a stop. No component crosses such a cut, so a worker
aligns each segment once, keeps the result and adds up the segments of a text
as arrays. Both tokenizers are checked for what the cuts rest on.

*Counts.* Each text's distinct linked id pairs are packed, sorted arrays of
numbers (A id times 2^15 plus B id). Tasks count documents per pair before
anything is shuffled; the sums are gathered by A id, which bounds a group by
the size of B's vocabulary. For the corpus-wide figures of a document, the pair counts are cut into
blocks of A ids, a document's array into a slice for each block, and slices meet
their block in cells (:func:`folioflow.llm.common.in_cells`): nothing is
broadcast or collected, and no pair becomes a row beside a document's.

Defined cases: texts that are null, empty or hold the word mark of B (whose
bytes B does not give back) have no tokens and zeros; special strings inside
texts are plain text; very long texts are aligned whole; each row is a document of
its own, also where rows repeat an id or a text; rows with a null id keep it;
an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache
from itertools import chain

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, in_cells, materialise, read_table
from .spm import build_marked, oracle, piece_bytes
from .tokens import MARK, NORMAL, load_model, model_path

#: Pieces of text that both tokenizers may be given alone.
STOPS, WORD = ".,;:!?*$%&#", "0-9A-Za-zÀ-ÖØ-öø-ɏ"
SEGMENT = re.compile(rf"\n(?=\n?\S)|\s*[{WORD}]++(?=[{STOPS}])|\s*\S+(?:[^\S \n]\s*\S*)*|\s+")
#: Bits of a B id within a pair's number.
B_BITS = 15
#: Characters aligned at once, rows read at once, and what one worker keeps of segments (memory only, never results).
BATCH_CHARS, ROWS = 1 << 19, 512
CACHE_SEGMENTS = 160_000
CACHE_LINKS = 1_000_000
#: Segments encoded as one running text, and links of a component beyond which they are multiplied as counts (the result is the same).
RUN = 512
LISTED = 4096
#: Pair counts that one task gathers before it passes them on.
HELD_PAIRS = 500_000
#: Pair counts in a block, and bytes of packed pairs in a cell.
BLOCK_PAIRS = 4_000_000
CELL_BYTES = 16 << 20


def byte_level() -> dict[str, int]:
    """Byte-level alphabet: printable bytes stand for themselves, the others follow from code point 256 on."""
    shown = [*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)]
    hidden = [b for b in range(256) if b not in set(shown)]
    return {chr(b): b for b in shown} | {chr(256 + i): b for i, b in enumerate(hidden)}


@lru_cache(maxsize=2)
def tokenizer_a(path: str):
    """(tokenizer, bytes of each id)."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    alphabet = byte_level()
    vocab = tok.get_vocab(with_added_tokens=False)
    table = [b""] * (max(vocab.values()) + 1)
    for piece, i in vocab.items():
        table[i] = bytes(alphabet[c] for c in piece)
    pre = tok.pre_tokenizer
    probe = [[x for x, _ in pre.pre_tokenize_str(s)] for s in (" a b", "a  b", "a\n\nb", "a\n \nb", "a\tb", "a\n")]
    # a pre-token takes one leading blank, white space before it stands alone, and nothing is put in front
    if tok.normalizer is not None or probe != [["Ġa", "Ġb"], ["a", "Ġ", "Ġb"], ["a", "Ċ", "Ċ", "b"], ["a", "ĊĠ", "Ċ", "b"], ["a", "ĉ", "b"], ["a", "Ċ"]]:
        raise ValueError("segments need a byte-level tokenizer that keeps one blank before a word and adds none")
    return tok, table


@lru_cache(maxsize=2)
def tokenizer_b(path: str):
    """(tokenizer for marked text, the reference library, bytes of each id)."""
    m = load_model(path)
    tok = build_marked(path)
    crossing = re.compile(rf"[^{MARK}].*{MARK}|\n.|.\n|[{WORD}][{STOPS}]", re.DOTALL)
    if tok is None or len(m["pieces"]) > 1 << B_BITS or any(kind == NORMAL and crossing.search(p) for p, _, kind in m["pieces"]):
        raise ValueError("segments need a model without normalisation none of whose pieces crosses a cut")
    return tok, oracle(path), piece_bytes(path).to_pylist()


def overlaps(starts_a: np.ndarray, ends_a: np.ndarray, starts_b: np.ndarray, ends_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The edges: numbers of the A and B tokens whose ranges share a byte; at most as many as there are tokens."""
    first = np.searchsorted(ends_b, starts_a, "right")
    n = np.searchsorted(starts_b, ends_a, "left") - first
    return np.repeat(np.arange(len(starts_a)), n), np.repeat(first - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))


def components(u: np.ndarray, v: np.ndarray, nodes: int) -> np.ndarray:
    """Union-find over whole arrays: the least node of each node's component.

    Each round hooks the greater root of every open edge under the least of its
    neighbours and then shortens all paths to their roots; rounds grow with the
    logarithm of the longest component.
    """
    parent = np.arange(nodes)
    while True:
        x, y = parent[u], parent[v]
        if not (apart := x != y).any():
            return parent
        u, v, x, y = u[apart], v[apart], x[apart], y[apart]
        np.minimum.at(parent, np.maximum(x, y), np.minimum(x, y))
        while (shorter := parent[parent]).tobytes() != parent.tobytes():
            parent = shorter


def product_counts(ids_a: np.ndarray, ids_b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Pairs and occurrences of one component by counts of its ids: its links are never listed."""
    (x, n), (y, m) = (np.unique(ids, return_counts=True) for ids in (ids_a, ids_b))
    return (x[:, None] << B_BITS | y[None, :]).ravel(), (n[:, None] * m[None, :]).ravel()


def link_pairs(ids_a: np.ndarray, ids_b: np.ndarray, root: np.ndarray, segment: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(segment, pair, occurrences), each pair once in a segment; ``root`` has the component of A tokens, then of B tokens."""
    root_a, root_b = root[: len(ids_a)], root[len(ids_a) :]
    n_b = np.bincount(root_b, minlength=len(ids_a))
    first_b = np.cumsum(n_b) - n_b
    n_a = np.bincount(root_a, minlength=len(ids_a))
    wide = n_a * n_b > LISTED
    listed = ~wide[root_a]
    own, n = root_a[listed], n_b[root_a[listed]]
    b = np.repeat(first_b[own] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
    keys = [np.repeat(segment[listed], n) << 32 | np.repeat(ids_a[listed], n) << B_BITS | ids_b[b]]
    times = [np.ones(len(keys[0]), np.int64)]
    for r in np.flatnonzero(wide):
        code, count = product_counts(ids_a[r : r + n_a[r]], ids_b[first_b[r] : first_b[r] + n_b[r]])
        keys.append(segment[r] << 32 | code)
        times.append(count)
    key, count = summed(np.concatenate(keys), np.concatenate(times))
    return key >> 32, key & 0xFFFFFFFF, count


def summed(key: np.ndarray, value: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct keys in order, with their sums."""
    if not len(key):
        return key, value
    order = np.argsort(key)
    key, value = key[order], value[order]
    begins = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    return key[begins], np.add.reduceat(value, begins)


class Segments:
    """What a worker knows of segments, as arrays by their number."""

    def __init__(self, path_a: str, path_b: str):
        self.a, self.bytes_a = tokenizer_a(path_a)
        self.marked, self.library, self.bytes_b = tokenizer_b(path_b)
        self.length_a, self.length_b = (np.array([len(x) for x in t], np.int64) for t in (self.bytes_a, self.bytes_b))
        self.wide = max(len(self.bytes_a), len(self.bytes_b))
        #: an id as it is printed at the start of a segment, of a group, of a group's B ids, and elsewhere
        self.texts = np.array([f"{mark}{i}" for mark in ("", ";", "|", ",") for i in range(self.wide)], object)
        self.clear()

    def clear(self) -> None:
        self.number: dict[str, int] = {}
        self.printed: list[str] = []
        #: tokens of A (-1: the bytes differ) and B, groups, links
        self.sizes = np.zeros((0, 4), np.int64)
        self.starts = np.zeros(1, np.int64)
        self.codes, self.times = np.zeros(0, np.int64), np.zeros(0, np.int64)

    def encode(self, chained: list[str], alone: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of A and of B over all segments in order; those that may follow each other are encoded as running text."""
        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")
        runs = ["".join(chained[k : k + RUN]) for k in range(0, len(chained), RUN)]
        a = [e.ids for e in self.a.encode_batch_fast(runs + alone, add_special_tokens=False)]
        b = [np.asarray(x) for x in self.library.encode_as_numpy([r[1:] for r in runs], num_threads=1)] if runs else []  # the library adds the blank
        b += [e.ids for e in self.marked.encode_batch_fast([s.replace(" ", MARK) for s in alone], add_special_tokens=False)]
        return tuple(np.concatenate([np.zeros(0, np.int64), *map(np.array, x)]).astype(np.int64) for x in (a, b))

    def learn(self, new: list[str]) -> None:
        differ = [s for s in new if MARK in s]
        chained, alone = [], []
        for s in new:
            if MARK not in s:
                (chained if s[0] == " " and not s[-1].isspace() else alone).append(s)
        told = chained + alone
        raw = [s.encode() for s in told]
        borders = np.cumsum([len(x) for x in raw], dtype=np.int64)
        ids_a, ids_b = self.encode(chained, alone)
        whole = b"".join(raw)
        if any(b"".join([t[i] for i in ids.tolist()]) != whole for t, ids in ((self.bytes_a, ids_a), (self.bytes_b, ids_b))):
            raise ValueError("a tokenizer does not give back the bytes of texts without the word mark")
        n = len(told)
        ends_a, ends_b = np.cumsum(self.length_a[ids_a]), np.cumsum(self.length_b[ids_b])
        u, v = overlaps(ends_a - self.length_a[ids_a], ends_a, ends_b - self.length_b[ids_b], ends_b)
        root = components(u, v + len(ids_a), len(ids_a) + len(ids_b))
        segment_a, segment_b = (np.searchsorted(borders, e, "left") for e in (ends_a, ends_b))
        root_a, root_b = root[: len(ids_a)], root[len(ids_a) :]
        count_a, count_b = (np.bincount(x, minlength=len(ids_a)) for x in (root_a, root_b))
        leads = np.flatnonzero(count_a)  # first A tokens of components
        # places in print: a group's A ids, then its B ids
        place_a = np.arange(len(ids_a)) + (np.cumsum(count_b) - count_b)[root_a]
        place_b = np.arange(len(ids_b)) + np.cumsum(count_a)[root_b]
        flat = np.empty(len(ids_a) + len(ids_b), object)
        opens = np.full(len(ids_a), 3)
        opens[leads] = 1
        opens[np.flatnonzero(np.diff(segment_a, prepend=-1))] = 0
        flat[place_a] = self.texts[opens * self.wide + ids_a]
        flat[place_b] = self.texts[np.where(np.diff(root_b, prepend=-1) != 0, 2, 3) * self.wide + ids_b]
        n_a, n_b = np.bincount(segment_a, minlength=n), np.bincount(segment_b, minlength=n)
        pieces, at = flat.tolist(), 0
        for end in np.cumsum(n_a + n_b).tolist():
            self.printed.append("".join(pieces[at:end]))
            at = end
        segment, code, times = link_pairs(ids_a, ids_b, root, segment_a)
        n_links = np.bincount(segment_a[leads], minlength=n).astype(np.int64) * 0
        np.add.at(n_links, segment_a[leads], count_a[leads] * count_b[leads])
        sizes = np.stack([n_a, n_b, np.bincount(segment_a[leads], minlength=n), n_links], axis=1)
        lengths = np.bincount(segment, minlength=n)
        if differ:
            self.printed += [""] * len(differ)
            sizes = np.concatenate([sizes, np.array([[-1, 0, 0, 0]] * len(differ))])
            lengths = np.concatenate([lengths, np.zeros(len(differ), np.int64)])
        base = len(self.number)
        self.number.update((s, base + k) for k, s in enumerate(told + differ))
        self.sizes = np.concatenate([self.sizes, sizes.astype(np.int64)])
        self.starts = np.concatenate([self.starts, self.starts[-1] + np.cumsum(lengths, dtype=np.int64)])
        self.codes = np.concatenate([self.codes, code])
        self.times = np.concatenate([self.times, times])

    def documents(self, texts: list[str]) -> tuple[np.ndarray, list[str], list[np.ndarray], list[np.ndarray]]:
        """For each text: its sizes (A, B, groups, links), the digest of its groups, its distinct pairs and their occurrences."""
        if len(self.number) > CACHE_SEGMENTS or len(self.codes) > CACHE_LINKS:
            self.clear()
        cut = [SEGMENT.findall(" " + t) if t else [] for t in texts]
        new = set(chain.from_iterable(cut)).difference(self.number)
        if new:
            self.learn(list(new))
        ends = np.cumsum([len(c) for c in cut], dtype=np.int64)
        at = np.fromiter(map(self.number.__getitem__, chain.from_iterable(cut)), np.int64, int(ends[-1]) if len(ends) else 0)
        doc = np.repeat(np.arange(len(texts)), np.diff(ends, prepend=0))
        differs = np.zeros(len(texts), bool)
        differs[doc[self.sizes[at, 0] < 0]] = True
        totals = np.concatenate([np.zeros((1, 4), np.int64), np.cumsum(self.sizes[at], axis=0)])
        sizes = totals[ends] - totals[np.concatenate([[0], ends[:-1]]).astype(np.int64)]
        sizes[differs] = 0
        numbers, digests, start = at.tolist(), [], 0
        for k, end in enumerate(ends.tolist()):
            digests.append("" if end == start or differs[k] else hashlib.sha256(";".join([self.printed[i] for i in numbers[start:end]]).encode()).hexdigest())
            start = end
        keep = ~differs[doc]
        known = max(1, len(self.printed))
        held, count = summed(doc[keep] * known + at[keep], np.ones(int(keep.sum()), np.int64))
        which, segment = held // known, held % known
        n = self.starts[segment + 1] - self.starts[segment]
        place = np.repeat(self.starts[segment] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        key, weight = summed(np.repeat(which, n) << 32 | self.codes[place], self.times[place] * np.repeat(count, n))
        borders = np.searchsorted(key, np.arange(1, len(texts)) << 32)
        return sizes, digests, np.split((key & 0xFFFFFFFF).astype("<u4"), borders), np.split(weight.astype("<u8"), borders)


@lru_cache(maxsize=2)
def segments_of(path_a: str, path_b: str) -> Segments:
    return Segments(path_a, path_b)


class PairCounts:
    """Documents per pair, as sorted arrays that take in more from time to time."""

    def __init__(self):
        self.codes, self.counts, self.waiting, self.size = np.zeros(0, np.int64), np.zeros(0, np.int64), [], 0

    def add(self, codes: list[np.ndarray]) -> None:
        self.waiting += codes
        self.size += sum(map(len, codes))
        if self.size > HELD_PAIRS:
            self.settle()

    def settle(self) -> None:
        fresh = np.concatenate([np.zeros(0, "<u4"), *self.waiting]).astype(np.int64)
        self.codes, self.counts = summed(np.concatenate([self.codes, fresh]), np.concatenate([self.counts, np.ones(len(fresh), np.int64)]))
        self.waiting, self.size = [], 0


ALIGNED = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, codes binary, times binary, code long, n long"
ALIGNED_FIELDS = [pa.field(n, t) for n, t in (("row", pa.int64()), ("doc_id", pa.int64()), ("n_a", pa.int64()), ("n_b", pa.int64()), ("n_groups", pa.int64()), ("n_links", pa.int64()), ("groups_sha256", pa.string()), ("codes", pa.binary()), ("times", pa.binary()), ("code", pa.int64()), ("n", pa.int64()))]


def aligned(docs: DataFrame, path_a: str, path_b: str) -> DataFrame:
    """A row for each document (``code`` null) and, of each task, rows ``code, n``: documents of the task that hold a pair."""
    schema = pa.schema(ALIGNED_FIELDS)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        segments, counts = segments_of(path_a, path_b), PairCounts()

        def counted() -> Iterator[pa.RecordBatch]:
            counts.settle()
            for k in range(0, len(counts.codes), 1 << 16):
                codes, n = counts.codes[k : k + (1 << 16)], counts.counts[k : k + (1 << 16)]
                yield pa.RecordBatch.from_arrays([*[pa.nulls(len(codes), f.type) for f in ALIGNED_FIELDS[:-2]], pa.array(codes), pa.array(n)], schema=schema)
            counts.codes, counts.counts = counts.codes[:0], counts.counts[:0]

        def documents(rows: list, ids: list, texts: list[str]) -> pa.RecordBatch:
            sizes, digests, codes, times = segments.documents(texts)
            counts.add(codes)
            packed = [pa.array([x.tobytes() for x in xs], pa.binary()) for xs in (codes, times)]
            nothing = [pa.nulls(len(texts), pa.int64())] * 2
            return pa.RecordBatch.from_arrays([pa.array(rows, pa.int64()), pa.array(ids, pa.int64()), *[pa.array(sizes[:, k]) for k in range(4)], pa.array(digests), *packed, *nothing], schema=schema)

        for b in (part for whole in batches for part in (whole.slice(k, ROWS) for k in range(0, whole.num_rows, ROWS))):
            rows, ids, texts, n = [], [], [], 0
            for row, doc_id, text in zip(*(c.to_pylist() for c in b.columns), strict=True):
                rows.append(row)
                ids.append(doc_id)
                texts.append(text)
                n += len(text)
                if n >= BATCH_CHARS:
                    yield documents(rows, ids, texts)
                    rows, ids, texts, n = [], [], [], 0
            if texts:
                yield documents(rows, ids, texts)
            if len(counts.codes) > HELD_PAIRS:
                yield from counted()
        yield from counted()

    numbered = doc_texts(docs).select(F.monotonically_increasing_id().alias("row"), "doc_id", "text")
    return numbered.mapInArrow(run, ALIGNED)


def link_counts(table: DataFrame) -> DataFrame:
    """``a, codes array<long>, counts array<long>``: for each A id its pairs and the documents that hold them."""
    pairs = table.where(F.col("code").isNotNull()).groupBy("code").agg(F.sum("n").alias("n"))
    rows = pairs.groupBy(F.shiftright("code", B_BITS).alias("a")).agg(F.sort_array(F.collect_list(F.struct("code", "n"))).alias("x"))
    return rows.select("a", F.col("x.code").alias("codes"), F.col("x.n").alias("counts"))


DIGEST = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"]


def _slices(documents: DataFrame, blocks: int) -> DataFrame:
    """A document's packed pairs cut by block; every document has a slice of block 0, the others only where they hold something."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            block, taken, codes, times = [], [], [], []
            for k, (c, t) in enumerate(zip(b.column("codes").to_pylist(), b.column("times").to_pylist(), strict=True)):
                c, t = np.frombuffer(c, "<u4"), np.frombuffer(t, "<u8")
                of = (c >> B_BITS) % blocks
                for x in sorted({0, *np.unique(of).tolist()}):
                    block.append(x)
                    taken.append(k)
                    codes.append(c[of == x].tobytes())
                    times.append(t[of == x].tobytes())
            rest = b.select(["row", *DIGEST]).take(pa.array(taken, pa.int64()))
            yield pa.RecordBatch.from_arrays([*rest.columns, pa.array(codes, pa.binary()), pa.array(times, pa.binary()), pa.array(block, pa.int32())], ["row", *DIGEST, "codes", "times", "block"])

    head = "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string"
    return documents.select("row", *DIGEST, "codes", "times").mapInArrow(run, f"{head}, codes binary, times binary, block int")


def _looked_up(cells: DataFrame) -> DataFrame:
    """Each slice with ``n_best, count_sum`` over its links, from the pair counts of its cell."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        parts: list[tuple] = []
        codes = counts = best = None
        for b in batches:
            is_slice = np.array(b.column("is_slice").to_pylist(), bool)
            cut = int(np.argmax(is_slice)) if is_slice.any() else len(is_slice)  # a cell's table comes first
            for c, n in zip(b.column("pair_codes").slice(0, cut).to_pylist(), b.column("pair_counts").slice(0, cut).to_pylist(), strict=True):
                n = np.array(n, np.int64)
                parts.append((np.array(c, np.int64), n, n == n.max()))
            if cut == len(is_slice):
                continue
            if parts:
                codes, counts, best = (np.concatenate(x) for x in zip(*parts, strict=True))
                order = np.argsort(codes, kind="stable")
                codes, counts, best, parts = codes[order], counts[order], best[order], []
            b = b.slice(cut)
            packed = b.column("codes").to_pylist()
            ends = np.cumsum([len(x) // 4 for x in packed], dtype=np.int64)
            sums = [np.zeros(len(packed), np.int64)] * 2
            if ends[-1]:
                at = np.searchsorted(codes, np.frombuffer(b"".join(packed), "<u4").astype(np.int64))
                times = np.frombuffer(b"".join(b.column("times").to_pylist()), "<u8").astype(np.int64)
                for k, value in enumerate((times * best[at], times * counts[at])):
                    running = np.concatenate([[0], np.cumsum(value)])
                    sums[k] = running[ends] - running[np.concatenate([[0], ends[:-1]])]
            yield pa.RecordBatch.from_arrays([b.column("row"), *[b.column(c) for c in DIGEST], *map(pa.array, sums)], ["row", *DIGEST, "n_best", "count_sum"])

    return cells.mapInArrow(run, "row long, doc_id long, n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, n_best long, count_sum long")


def align_documents(docs: DataFrame, path_a: str | None = None, path_b: str | None = None) -> tuple[DataFrame, DataFrame]:
    """(documents with their figures, pair counts by A id); both rest on written tables."""
    path_a, path_b = path_a or model_path("byte_bpe_50k.json"), path_b or model_path()
    table = materialise(aligned(docs, path_a, path_b), "aligned")
    counts = materialise(link_counts(table), "link_counts")
    documents = table.where(F.col("code").isNull())
    pairs = counts.agg(F.sum(F.size("codes").cast("long"))).first()[0] or 0
    size = documents.agg(F.sum(F.octet_length("codes").cast("long"))).first()[0] or 0
    blocks = max(1, -(-pairs // BLOCK_PAIRS))
    salts = [max(1, -(-size // (blocks * CELL_BYTES)))] * blocks
    slices = _slices(documents, blocks).withColumn("pair_codes", F.lit(None).cast("array<long>")).withColumn("pair_counts", F.lit(None).cast("array<long>"))
    empty = [F.lit(None).cast(t).alias(c) for c, t in slices.drop("block", "pair_codes", "pair_counts").dtypes]
    blocked = counts.select(*empty, F.pmod("a", F.lit(blocks)).cast("int").alias("block"), F.col("codes").alias("pair_codes"), F.col("counts").alias("pair_counts"))
    found = _looked_up(in_cells(blocked, slices, salts, "row"))
    out = found.groupBy("row").agg(*[F.any_value(c).alias(c) for c in DIGEST], F.sum("n_best").alias("n_best"), F.sum("count_sum").alias("count_sum"))
    return out.select("doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256"), counts


def op13_token_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    return align_documents(read_table(spark, sf_dir, "documents"))[0]
