"""Ranked lexical search: the best documents for each item, by integer scores.

*Items in blocks.* The items are the stated queries. They are read as a stream
and cut into blocks of at most ``BLOCK_BYTES`` of text (and one item); a block's
terms get numbers, and every document is read once for a block.

*Postings.* A task counts the terms of each whole text and keeps the numbers and
frequencies of those that the block asks for. They are written once; the sizes
of the corpus (documents with terms, terms, documents per asked term) are sums
over the same rows, so no figure rests on a part of the corpus.

*Accumulation by sorting.* Postings are dealt to ranges of doc_id. A task takes
its documents in runs, concatenates one (item, document, impact) entry for each
match of an item's term, sorts them by the packed key of item and document with
a radix sort of 16-bit digits, and sums equal keys with ``reduceat``. A heap for
each item keeps the best of the task; its worst entry screens whole arrays
before a score reaches the heap. The best of all ranges remain.

Defined cases: texts that are null, empty or without terms take no part, also
not in the counts; items without terms have no answer; each row of either table
stands for itself, also where ids repeat; a null doc_id ranks behind other ids
of the same score, a null item_id is kept; texts of any length are read whole;
empty tables give an empty result; further columns are not read.
"""

from __future__ import annotations

import heapq
import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import materialise, read_table, whole_text

TERM = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")
TOP = 10
#: Text of the items in a block.
BLOCK_BYTES = 8 << 20
#: Raw terms that one worker keeps with their numbers (memory only, never results).
CACHE_TERMS = 500_000
#: Matches sorted at once, about.
RUN_MATCHES = 1 << 20
NO_ID = 1 << 63


def folded(term: str) -> str:
    """A-Z lowered, nothing else."""
    return term.encode().lower().decode()


class Block:
    """The terms of a block of items by number, and for each term the items that hold it with their repeats."""

    def __init__(self, texts: list[str]):
        self.items = len(texts)
        self.terms: dict[str, int] = {}
        by_term: list[list[tuple[int, int]]] = []
        for item, text in enumerate(texts):
            for term, n in Counter(map(folded, TERM.findall(text))).items():
                number = self.terms.setdefault(term, len(by_term))
                if number == len(by_term):
                    by_term.append([])
                by_term[number].append((item, n))
        sizes = [len(x) for x in by_term]
        self.starts = np.concatenate([[0], np.cumsum(sizes)]).astype(np.int64)
        self.held = np.array([i for x in by_term for i, _ in x], np.int64)
        self.repeats = np.array([n for x in by_term for _, n in x], np.int64)


def blocks(items: DataFrame) -> Iterator[list[tuple[int | None, str]]]:
    """The items ``item_id, text`` as a stream of bounded lists."""
    out, size = [], 0
    for item_id, text in items.select(F.col("item_id").cast("long"), whole_text()).toLocalIterator():
        out.append((item_id, text))
        size += len(text.encode()) + 16
        if size >= BLOCK_BYTES:
            yield out
            out, size = [], 0
    if out:
        yield out


def radix_order(keys: np.ndarray) -> np.ndarray:
    """The order that sorts non-negative integers: stable passes over 16-bit digits, lowest first."""
    order = np.argsort((keys & 0xFFFF).astype(np.uint16), kind="stable")  # a radix sort for 16-bit integers
    shift = 16
    while len(keys) and int(keys.max()) >> shift:
        digit = ((keys >> shift) & 0xFFFF).astype(np.uint16)
        order = order[np.argsort(digit[order], kind="stable")]
        shift += 16
    return order


def postings(docs: DataFrame, terms: dict[str, int]) -> DataFrame:
    """``doc_id, n, terms, tfs`` of documents with terms: their length and, packed, the asked terms with frequencies."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[str, int] = {}
        for b in batches:
            ids, sizes, packed, tfs = [], [], [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                found = TERM.findall(text)
                if not found:
                    continue
                counts = Counter(found)
                if len(known) > CACHE_TERMS:
                    known.clear()
                for t in counts:
                    if t not in known:
                        known[t] = terms.get(folded(t), -1)
                asked = np.fromiter(map(known.__getitem__, counts), np.int64, len(counts))
                n = np.fromiter(counts.values(), np.int64, len(counts))
                n, asked = n[asked >= 0], asked[asked >= 0]
                order = np.argsort(asked, kind="stable")
                n, asked = n[order], asked[order]
                # raw terms that fold to one term are one
                begins = np.flatnonzero(np.diff(asked, prepend=-1))
                ids.append(doc_id)
                sizes.append(len(found))
                packed.append(asked[begins].astype("<u4").tobytes())
                tfs.append((np.add.reduceat(n, begins) if len(n) else n).astype("<u4").tobytes())
            yield pa.RecordBatch.from_arrays([pa.array(ids, pa.int64()), pa.array(sizes, pa.int64()), pa.array(packed, pa.binary()), pa.array(tfs, pa.binary())], ["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), whole_text().alias("text"))
    return texts.mapInArrow(run, "doc_id long, n long, terms binary, tfs binary")


def corpus_counts(rows: DataFrame, terms: int) -> tuple[int, int, np.ndarray]:
    """(documents, terms with repeats, documents of each asked term) over all postings; one number a term reaches the driver."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df, docs, length = np.zeros(terms, np.int64), 0, 0
        for b in batches:
            docs += b.num_rows
            length += sum(b.column(0).to_pylist())
            df += np.bincount(np.frombuffer(b"".join(b.column(1).to_pylist()), "<u4"), minlength=terms)
        at = np.flatnonzero(df)
        yield pa.RecordBatch.from_arrays([pa.array([-1, -2, *at.tolist()], pa.int64()), pa.array([docs, length, *df[at].tolist()], pa.int64())], ["term", "n"])

    summed = rows.select("n", "terms").mapInArrow(run, "term long, n long").groupBy("term").agg(F.sum("n").alias("n"))
    got = dict(summed.collect())
    df = np.zeros(terms, np.int64)
    for t, n in got.items():
        if t >= 0:
            df[t] = n
    return got.get(-1, 0), got.get(-2, 0), df


def weights(documents: int, df: np.ndarray) -> np.ndarray:
    """floor(1000 ln((2 N + 2) / (2 df + 1))) of each term."""
    return np.array([math.floor(1000 * math.log((2 * documents + 2) / (2 * int(d) + 1))) for d in df], np.int64)


class Best:
    """The ``top`` best documents of each item: higher scores first, then smaller ids."""

    def __init__(self, items: int, top: int):
        self.top, self.heaps = top, [[] for _ in range(items)]
        #: what a score must reach (and, at that score, which id it must go below)
        self.score, self.id = np.zeros(items, np.int64), np.full(items, np.iinfo(np.int64).min)

    def take(self, item: np.ndarray, doc: np.ndarray, score: np.ndarray, null: np.ndarray) -> None:
        worst = self.score[item]
        may = np.flatnonzero((score > worst) | (score == worst) & (doc < self.id[item]) & ~null)
        for i, d, s, missing in zip(item[may].tolist(), doc[may].tolist(), score[may].tolist(), null[may].tolist(), strict=True):
            heap, entry = self.heaps[i], (s, -(NO_ID if missing else d))
            if len(heap) < self.top:
                heapq.heappush(heap, entry)
            elif entry > heap[0]:
                heapq.heapreplace(heap, entry)
            if len(heap) == self.top:
                s, d = heap[0]
                # behind a null id any id of the same score comes first
                self.score[i], self.id[i] = s, min(-d, NO_ID - 1)


def accumulated(rows: DataFrame, block: Block, weight: np.ndarray, mean: tuple[int, int], top: int) -> DataFrame:
    """``item, doc_id, score``: the best of each task, summed over matches by sorting."""
    documents, total = mean

    def scores(ids: list, sizes: np.ndarray, terms: np.ndarray, tfs: np.ndarray, ends: np.ndarray, best: Best) -> None:
        doc = np.repeat(np.arange(len(ids)), np.diff(ends, prepend=0))
        m = 25 + (75 * sizes * documents) // total
        impact = weight[terms] * ((1_000_000_000 * tfs) // (1000 * tfs + 8 * m[doc]))
        n = block.starts[terms + 1] - block.starts[terms]
        at = np.repeat(block.starts[terms] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        key = block.held[at] * len(ids) + np.repeat(doc, n)
        value = block.repeats[at] * np.repeat(impact, n)
        if not len(key):
            return
        order = radix_order(key)
        key, value = key[order], value[order]
        begins = np.flatnonzero(np.diff(key, prepend=-1))
        total_score, key = np.add.reduceat(value, begins), key[begins]
        which = key % len(ids)
        null = np.array([x is None for x in ids], bool)
        best.take(key // len(ids), np.array([x or 0 for x in ids], np.int64)[which], total_score, null[which])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        best = Best(block.items, top)
        per_term = np.diff(block.starts)
        for b in batches:
            ids, sizes = b.column("doc_id").to_pylist(), np.array(b.column("n").to_pylist(), np.int64)
            packed, tfs = b.column("terms").to_pylist(), b.column("tfs").to_pylist()
            terms = np.frombuffer(b"".join(packed), "<u4").astype(np.int64)
            counts = np.frombuffer(b"".join(tfs), "<u4").astype(np.int64)
            ends = np.cumsum([len(x) // 4 for x in packed], dtype=np.int64)
            matches = np.concatenate([[0], np.cumsum(per_term[terms])])[ends]
            # a run's keys fit in one digit where they can; its matches are bounded but for one document's
            span, k = max(1, (1 << 16) // block.items), 0
            while k < len(ids):
                before, start = (int(matches[k - 1]), int(ends[k - 1])) if k else (0, 0)
                to = min(len(ids), k + span, max(k + 1, int(np.searchsorted(matches, before + RUN_MATCHES))))
                scores(ids[k:to], sizes[k:to], terms[start : ends[to - 1]], counts[start : ends[to - 1]], ends[k:to] - start, best)
                k = to
        out = [(i, None if d == -NO_ID else -d, s) for i, heap in enumerate(best.heaps) for s, d in heap]
        columns = list(zip(*out, strict=True)) or [(), (), ()]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int32(), pa.int64(), pa.int64()), strict=True)], ["item", "doc_id", "score"])

    return rows.mapInArrow(run, "item int, doc_id long, score long")


def ranked(docs: DataFrame, items: DataFrame, top: int = TOP) -> DataFrame:
    """``item_id, rank, doc_id, score``: the ``top`` best documents with a score above 0 of each item."""
    spark = docs.sparkSession
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    out = spark.createDataFrame([], "item_id long, rank int, doc_id long, score long")
    for some in blocks(items):
        block = Block([text for _, text in some])
        if not block.terms:
            continue
        rows = materialise(postings(docs, block.terms), "postings")
        documents, total, df = corpus_counts(rows, len(block.terms))
        if not documents:
            continue
        dealt = rows.where(F.octet_length("terms") > 0).repartitionByRange(parts, "doc_id", F.xxhash64("terms", "tfs"))
        found = accumulated(dealt, block, weights(documents, df), (documents, total), top)
        order = [F.desc("score"), F.col("doc_id").asc_nulls_last()]
        # first within each range, then over the ranges: no task reads more than a few of an item's rows per task before it
        last = Window.partitionBy("item").orderBy(*order)
        kept = found.withColumn("rank", F.row_number().over(last)).where(F.col("rank") <= top)
        names = F.broadcast(spark.createDataFrame([(k, item_id) for k, (item_id, _) in enumerate(some)], "item int, item_id long"))
        out = out.unionByName(kept.join(names, "item").select("item_id", "rank", "doc_id", "score"))
    return out


def op11_lexical_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    return ranked(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))


#: The same ranking by joins.
ORACLE = r"""
WITH terms AS (
  SELECT row, doc_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term
  FROM (SELECT *, row_number() OVER () AS row FROM documents)),
asked AS (
  SELECT item_id, term, count(*)::BIGINT AS c
  FROM (SELECT item_id, translate(unnest(regexp_extract_all(text, '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS term FROM benchmark)
  GROUP BY item_id, term),
sizes AS (SELECT row, doc_id, count(*)::BIGINT AS n FROM terms GROUP BY row, doc_id),
total AS (SELECT count(*)::BIGINT AS big_n, sum(n)::BIGINT AS big_l FROM sizes),
tf AS (SELECT row, doc_id, term, count(*)::BIGINT AS tf FROM terms WHERE term IN (SELECT term FROM asked) GROUP BY row, doc_id, term),
df AS (SELECT term, count(*)::BIGINT AS df FROM tf GROUP BY term),
scored AS (
  SELECT a.item_id, tf.row, tf.doc_id,
    sum(a.c * floor(1000 * ln((2 * big_n + 2)::DOUBLE / (2 * df.df + 1)::DOUBLE))::BIGINT * ((1000000000 * tf.tf) // (1000 * tf.tf + 8 * (25 + (75 * s.n * big_n) // big_l))))::BIGINT AS score
  FROM tf JOIN asked a USING (term) JOIN df USING (term) JOIN sizes s ON s.row = tf.row, total
  GROUP BY a.item_id, tf.row, tf.doc_id)
SELECT item_id, row_number() OVER (PARTITION BY item_id ORDER BY score DESC, doc_id)::INTEGER AS rank, doc_id, score
FROM scored WHERE score > 0 QUALIFY rank <= 10
"""
