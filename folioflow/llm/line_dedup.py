"""Incremental, reversible removal of lines that many documents share.

A line's key is the line stripped of ``[\\x20\\x09-\\x0D]`` at both ends with A-Z
lowered, as the first 128 bits of its SHA-256. A :class:`LineStore` keeps, in the
shared folder, three tables under one committed generation:

* ``refs``: for every key the number of documents that hold it (exact);
* ``filters``: for each shard of the keys a cuckoo filter of those that at least
  ``min_docs`` documents hold;
* ``docs``: how often each document (id and text) is in the store.

Inserting documents adds to the counts, deleting them takes away what they had
added, and both move keys into and out of the filters as they cross ``min_docs``.
So a line that was dropped comes back when enough of its documents are deleted.

:meth:`LineStore.dedup` deals each document's keys to the shards. A shard's
filter is asked first; only what it lets pass is looked up in the shard's exact
counts, so a false positive costs a lookup and never a line. A shard is dealt to
as many cells as its keys need, by document, so a line that a third of all
documents hold is no task's work (:func:`folioflow.llm.common.in_cells`).

Defined cases: null and empty texts have one empty line, which has no key and
stays; a line repeated within a document counts once; each row is a document of
its own, also where rows repeat id and text; documents that the store does not
hold are not deleted, those that it holds n times at most n times; very long
texts are read whole; an empty table changes nothing and gives an empty result.
"""

from __future__ import annotations

import hashlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import doc_texts, in_cells, materialise, owned, read_table, scratch_dir

MIN_DOCS = 10
#: Bytes of a key.
WIDTH = 16
#: Shards of a new store; a filter and the exact counts of one shard fit in a task's memory.
SHARDS = 8
#: Keys of documents in a cell.
CELL_KEYS = 250_000
#: Counts that one task gathers before it passes them on.
HELD_KEYS = 500_000
SLOTS = 4
KICKS = 500


def line_key(line: bytes) -> bytes:
    """The key of a line, empty where nothing is left of it."""
    line = line.strip().lower()  # of bytes: white space and letters of ASCII only
    return hashlib.sha256(line).digest()[:WIDTH] if line else b""


def keyed(docs: DataFrame) -> DataFrame:
    """``rk, doc_id, keys``: a digest of id and text, and the distinct keys of the text's lines, packed in order."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rks, packed = [], []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                raw = text.encode()
                rks.append(row_digest(doc_id, raw))
                packed.append(b"".join(sorted({line_key(x) for x in raw.split(b"\n")} - {b""})))
            yield pa.RecordBatch.from_arrays([pa.array(rks, pa.binary()), b.column(0), pa.array(packed, pa.binary())], ["rk", "doc_id", "keys"])

    return doc_texts(docs).mapInArrow(run, "rk binary, doc_id long, keys binary")


def row_digest(doc_id: int | None, raw: bytes) -> bytes:
    h = hashlib.sha256(f"{doc_id}\n".encode())
    h.update(raw)
    return h.digest()[:WIDTH]


def split_keys(packed: bytes) -> list[bytes]:
    return [packed[i : i + WIDTH] for i in range(0, len(packed), WIDTH)]


def key_counts(rows: DataFrame) -> DataFrame:
    """``key, n`` summed over ``keys, n`` (packed keys, each with the row's n); tasks add up before anything is shuffled."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: Counter = Counter()

        def out() -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays([pa.array(list(held), pa.binary()), pa.array(list(held.values()), pa.int64())], ["key", "n"])

        for b in batches:
            for packed, n in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                for key in split_keys(packed):
                    held[key] += n
                if len(held) > HELD_KEYS:
                    yield out()
                    held.clear()
        yield out()

    return rows.select("keys", "n").mapInArrow(run, "key binary, n long").groupBy("key").agg(F.sum("n").alias("n"))


def key_words(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Two 64-bit words of each key."""
    words = np.frombuffer(b"".join(keys), "<u8").reshape(-1, 2)
    return words[:, 0].copy(), words[:, 1].copy()


class CuckooFilter:
    """Fingerprints of 16 bits in buckets of four, each key in one of two buckets; deletes what was inserted, and nothing else."""

    def __init__(self, capacity: int):
        self.buckets = 1 << max(2, (int(capacity / SLOTS / 0.9)).bit_length())
        self.table = np.zeros((self.buckets, SLOTS), np.uint16)

    @classmethod
    def of_keys(cls, keys: list[bytes], capacity: int = 0) -> CuckooFilter:
        """A filter of distinct keys with room for ``capacity`` of them; it grows until all are in."""
        keys = list(dict.fromkeys(keys))
        capacity = max(capacity, len(keys))
        while True:
            out = cls(capacity)
            if all(map(out.insert, keys)):
                return out
            capacity = out.buckets * SLOTS  # twice the buckets

    def _places(self, low: np.ndarray, high: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        mark = (high >> np.uint64(48)).astype(np.uint16)
        mark[mark == 0] = 1  # 0 is an empty slot
        first = ((low >> np.uint64(16)) & np.uint64(self.buckets - 1)).astype(np.int64)  # the first two bytes tell the shard
        return mark, first, self._other(first, mark)

    def _other(self, bucket, mark):
        """The second bucket of a fingerprint; it leads back to the first."""
        spread = (np.asarray(mark).astype(np.uint64) * np.uint64(0x5BD1E995)) >> np.uint64(7)
        return np.asarray(bucket) ^ (spread & np.uint64(self.buckets - 1)).astype(np.int64)

    def _one(self, key: bytes) -> tuple[int, int, int]:
        mark, first, second = self._places(*key_words([key]))
        return int(mark[0]), int(first[0]), int(second[0])

    def insert(self, key: bytes) -> bool:
        """Whether there was room; without room nothing is lost but the filter holds another key's place, so it must be made anew."""
        mark, first, second = self._one(key)
        for bucket in (first, second):
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        bucket = second
        for kick in range(KICKS):
            slot = (kick * 7 + mark) % SLOTS
            mark, self.table[bucket, slot] = int(self.table[bucket, slot]), mark
            bucket = int(self._other(bucket, np.uint16(mark)))
            free = np.flatnonzero(self.table[bucket] == 0)
            if len(free):
                self.table[bucket, free[0]] = mark
                return True
        return False

    def delete(self, key: bytes) -> bool:
        """Take out a key that was inserted."""
        mark, first, second = self._one(key)
        for bucket in (first, second):
            at = np.flatnonzero(self.table[bucket] == mark)
            if len(at):
                self.table[bucket, at[0]] = 0
                return True
        return False

    def contains(self, keys: list[bytes]) -> np.ndarray:
        """For each key whether it may be in; never False for one that is."""
        if not keys:
            return np.zeros(0, bool)
        mark, first, second = self._places(*key_words(keys))
        return ((self.table[first] == mark[:, None]) | (self.table[second] == mark[:, None])).any(axis=1)

    def tobytes(self) -> bytes:
        return self.table.tobytes()

    @classmethod
    def frombytes(cls, raw: bytes) -> CuckooFilter:
        out = cls.__new__(cls)
        out.table = np.frombuffer(raw, np.uint16).reshape(-1, SLOTS).copy()
        out.buckets = len(out.table)
        return out


def moved(old: CuckooFilter | None, ups: list[bytes], downs: list[bytes], common: list[bytes]) -> CuckooFilter:
    """The filter after keys came and went; made anew from all its keys where there is none or no room."""
    if old is not None and all(map(old.delete, downs)) and all(map(old.insert, ups)):
        return old
    return CuckooFilter.of_keys(common, len(common) * 3 // 2 + 256)


def shard_of(key: bytes, shards: int) -> int:
    return (key[0] << 8 | key[1]) % shards


def _shard(shards: int):
    """The same for a column ``key``."""
    return F.pmod(F.conv(F.hex(F.substring("key", 1, 2)), 16, 10).cast("int"), F.lit(shards))


class LineStore:
    """Counts and filters of lines in the folder ``path``, which driver and executors share."""

    REFS, FILTERS, DOCS = "shard int, key binary, refs long", "shard int, filter binary", "rk binary, n long"

    def __init__(self, spark: SparkSession, path: str, shards: int = SHARDS, min_docs: int = MIN_DOCS):
        self.spark, self.path, self.shards, self.min_docs = spark, path.rstrip("/"), shards, min_docs

    def _fs(self):
        jvm = self.spark.sparkContext._jvm
        p = jvm.org.apache.hadoop.fs.Path
        return p(self.path).getFileSystem(self.spark.sparkContext._jsc.hadoopConfiguration()), p

    def generation(self) -> int:
        """The latest committed generation, 0 for a new store."""
        fs, p = self._fs()
        found = fs.globStatus(p(f"{self.path}/gen=*/COMMITTED")) or []
        return max([0, *[int(x.getPath().getParent().getName()[4:]) for x in found]])

    def table(self, name: str) -> DataFrame:
        schema = {"refs": self.REFS, "filters": self.FILTERS, "docs": self.DOCS}[name]
        gen = self.generation()
        return self.spark.read.schema(schema).parquet(f"{self.path}/gen={gen}/{name}") if gen else self.spark.createDataFrame([], schema)

    def insert(self, docs: DataFrame) -> None:
        """Add every row of ``docs``."""
        self.insert_keyed(materialise(keyed(docs), "line_keys"))

    def insert_keyed(self, rows: DataFrame) -> None:
        batch = rows.groupBy("rk").agg(F.count("*").alias("n"), F.any_value("keys").alias("keys"))
        self._commit(batch)

    def delete(self, docs: DataFrame) -> None:
        """Take away every row of ``docs`` that the store holds, as often as it holds it at most."""
        rows = materialise(keyed(docs), "line_keys")
        asked = rows.groupBy("rk").agg(F.count("*").alias("asked"), F.any_value("keys").alias("keys"))
        batch = asked.join(self.table("docs"), "rk").select("rk", (-F.least("asked", "n")).alias("n"), "keys")
        self._commit(batch)

    def _commit(self, batch: DataFrame) -> None:
        """Apply ``rk, n, keys`` (n below 0 takes away) as a new generation; one file, written last, makes it valid."""
        gen = self.generation()
        at = f"{self.path}/gen={gen + 1}"
        batch = materialise(batch, "line_batch")
        both = self.table("docs").unionByName(batch.select("rk", "n")).groupBy("rk").agg(F.sum("n").alias("n"))
        both.where("n > 0").write.mode("overwrite").parquet(f"{at}/docs")
        change = key_counts(batch).select("key", F.col("n").alias("change"))
        if gen:
            old = self.table("refs").select("key", "refs")
            change = change.join(old, "key", "full").withColumn("refs", F.coalesce("refs", F.lit(0))).withColumn("change", F.coalesce("change", F.lit(0)))
        else:
            change = change.withColumn("refs", F.lit(0).cast("long"))
        refs = change.select(_shard(self.shards).alias("shard"), "key", (F.col("refs") + F.col("change")).alias("refs"), F.col("refs").alias("before"))
        refs.write.mode("overwrite").parquet(f"{at}/counted")
        counted = self.spark.read.schema(f"{self.REFS}, before long").parquet(f"{at}/counted")
        counted.where("refs > 0").select("shard", "key", "refs").write.mode("overwrite").parquet(f"{at}/refs")
        self._filters(counted).write.mode("overwrite").parquet(f"{at}/filters")
        fs, p = self._fs()
        fs.delete(p(f"{at}/counted"), True)
        fs.create(p(f"{at}/COMMITTED"), True).close()
        for stale in range(max(0, gen - 1), gen):
            fs.delete(p(f"{self.path}/gen={stale}"), True)

    def _filters(self, counted: DataFrame) -> DataFrame:
        """``shard, filter`` after the change, from the filters before and the keys that are or were common."""
        least = self.min_docs
        keys = counted.where((F.col("refs") >= least) | (F.col("before") >= least)).select("shard", "key", "refs", "before", F.lit(None).cast("binary").alias("filter"))
        old = self.table("filters").select("shard", F.lit(None).cast("binary").alias("key"), F.lit(None).cast("long").alias("refs"), F.lit(None).cast("long").alias("before"), "filter")
        every = self.spark.range(self.shards).select(F.col("id").cast("int").alias("shard"), *[F.lit(None).cast(t).alias(c) for c, t in (("key", "binary"), ("refs", "long"), ("before", "long"), ("filter", "binary"))])
        rows = keys.unionByName(old).unionByName(every).repartitionById(self.shards, "shard")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            shard, old, ups, downs, common = None, None, [], [], []
            for b in batches:
                for s, key, refs, before, raw in zip(*(c.to_pylist() for c in b.columns), strict=True):
                    shard = s
                    if raw is not None:
                        old = CuckooFilter.frombytes(raw)
                    elif key is not None:
                        if refs >= least:
                            common.append(key)
                            if before < least:
                                ups.append(key)
                        else:
                            downs.append(key)
            if shard is not None:
                made = moved(old, ups, downs, common)
                yield pa.RecordBatch.from_arrays([pa.array([shard], pa.int32()), pa.array([made.tobytes()], pa.binary())], ["shard", "filter"])

        return rows.mapInArrow(run, "shard int, filter binary")

    def common_lines(self, rows: DataFrame) -> DataFrame:
        """``rk, dropped``: of documents ``rk, keys`` the packed keys that at least ``min_docs`` documents of the store hold."""
        shards, least = self.shards, self.min_docs

        def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                out: list[tuple] = []
                for rk, packed in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                    by: dict[int, list[bytes]] = {}
                    for key in split_keys(packed):
                        by.setdefault(shard_of(key, shards), []).append(key)
                    out += [(rk, b"".join(keys), s) for s, keys in by.items()]
                columns = list(zip(*out, strict=True)) or [(), (), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.binary(), pa.binary(), pa.int32()), strict=True)], ["rk", "keys", "block"])

        slices = rows.select("rk", "keys").mapInArrow(cut, "rk binary, keys binary, block int")
        # one number for each shard: how many keys of documents it is asked for
        asked = dict(slices.groupBy("block").agg(F.sum(F.octet_length("keys")).alias("n")).collect())
        salts = [max(1, -(-(asked.get(s) or 0) // (WIDTH * CELL_KEYS))) for s in range(shards)]
        nothing = F.lit(None).cast("binary")
        filters = self.table("filters").select(nothing.alias("rk"), nothing.alias("keys"), F.col("shard").alias("block"), "filter")
        exact = self.table("refs").where(F.col("refs") >= least).select(nothing.alias("rk"), F.col("key").alias("keys"), F.col("shard").alias("block"), nothing.alias("filter"))
        cells = in_cells(filters.unionByName(exact), slices.withColumn("filter", nothing), salts, "rk")

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            screen, common = CuckooFilter.of_keys([]), set()
            for b in batches:
                held, sizes = [], []
                for rk, packed, raw in zip(*(b.column(c).to_pylist() for c in ("rk", "keys", "filter")), strict=True):
                    if raw is not None:
                        screen = CuckooFilter.frombytes(raw)
                    elif rk is None:
                        common.add(packed)
                    else:
                        held.append((rk, split_keys(packed)))
                        sizes.append(len(held[-1][1]))
                passed = screen.contains([k for _, keys in held for k in keys])
                out, at = [], 0
                for (rk, keys), n in zip(held, sizes, strict=True):
                    gone = b"".join([keys[i] for i in np.flatnonzero(passed[at : at + n]) if keys[i] in common])
                    at += n
                    if gone:
                        out.append((rk, gone))
                columns = list(zip(*out, strict=True)) or [(), ()]
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.binary()) for c in columns], ["rk", "dropped"])

        found = cells.select("rk", "keys", "filter").mapInArrow(run, "rk binary, dropped binary")
        # rows that repeat id and text have equal slices, so at most one for each shard remains
        return found.groupBy("rk").agg(F.collect_set("dropped").alias("dropped"))

    def dedup(self, docs: DataFrame, rows: DataFrame | None = None) -> DataFrame:
        """``doc_id, text, n_lines, n_dropped`` of every row of ``docs`` without the lines that are common in the store."""
        rows = materialise(keyed(docs), "line_keys") if rows is None else rows
        gone = materialise(self.common_lines(rows), "line_drops")

        def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                rks = [row_digest(i, t.encode()) for i, t in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True)]
                yield pa.RecordBatch.from_arrays([pa.array(rks, pa.binary()), *b.columns], ["rk", "doc_id", "text"])

        def rebuild(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for b in batches:
                texts, lines, drops = [], [], []
                for text, dropped in zip(b.column(1).to_pylist(), b.column(2).to_pylist(), strict=True):
                    parts = text.encode().split(b"\n")
                    bad = {k for x in dropped or [] for k in split_keys(x)}
                    kept = [x for x in parts if line_key(x) not in bad] if bad else parts
                    texts.append(b"\n".join(kept).decode())
                    lines.append(len(parts))
                    drops.append(len(parts) - len(kept))
                yield pa.RecordBatch.from_arrays([b.column(0), pa.array(texts), pa.array(lines, pa.int64()), pa.array(drops, pa.int64())], ["doc_id", "text", "n_lines", "n_dropped"])

        texts = doc_texts(docs).mapInArrow(digests, "rk binary, doc_id long, text string")
        met = texts.join(gone.hint("shuffle_hash"), "rk", "left").select("doc_id", "text", "dropped")
        return met.mapInArrow(rebuild, "doc_id long, text string, n_lines long, n_dropped long")


def op12_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Insert all documents into a new store, then drop what is common in it from every document."""
    docs = read_table(spark, sf_dir, "documents")
    rows = materialise(keyed(docs), "line_keys")
    store = LineStore(spark, new_store_path(spark))
    store.insert_keyed(rows)
    out = store.dedup(docs, rows)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text").cast("binary"), 256).alias("kept_sha256"))


def new_store_path(spark: SparkSession) -> str:
    """A fresh folder below the shared one; it goes when the driver's Python ends."""
    return owned(spark, f"{scratch_dir(spark).rstrip('/')}/stores/lines")


#: What DuckDB gives for the same: lines stripped of ASCII white space, letters of ASCII lowered.
ORACLE = """
WITH lines AS (
  SELECT doc_id, row, ord, line, translate(trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key
  FROM (SELECT doc_id, row, unnest(parts) AS line, generate_subscripts(parts, 1) AS ord
        FROM (SELECT doc_id, row_number() OVER () AS row, string_split(coalesce(text, ''), chr(10)) AS parts FROM documents))),
common AS (SELECT key FROM lines WHERE key <> '' GROUP BY key HAVING count(DISTINCT row) >= 10),
marked AS (SELECT l.*, l.key IN (SELECT key FROM common) AS gone FROM lines l)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
  sha256(coalesce(string_agg(line, chr(10) ORDER BY ord) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM marked GROUP BY doc_id, row
"""
