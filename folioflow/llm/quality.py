"""Quality classifier: a factorisation machine over hashed words, structure and size.

A text becomes a sparse vector: hashed words with log counts, scaled to unit
length, plus one-hot bins of structure statistics (letter case, symbols, digits,
word and line shapes, repetition) and of its size. The machine scores

    w0 + sum w_i x_i + 1/2 sum_f [(sum_i v_if x_i)^2 - sum_i v_if^2 x_i^2]

that is all pairwise interactions at rank ``RANK`` in time linear in the
non-zeros, by the sum-of-squares identity.

*Learning.* Labelled rows whose ``crc32(doc_id as text) mod 5`` is not 0, at most
``MAX_TRAIN`` of them (the least by a hash of the id: a bounded sample whatever
the corpus size), are turned into vectors on the executors and fitted on the
driver by Adagrad. *Scoring* is one narrow pass; the model has a fixed size
(``BUCKETS`` x (``RANK`` + 1) floats) and is broadcast.

Defined cases: a null text counts as empty, an empty text has the bias and its
size bins; very long texts are read whole; a document labelled more than once
counts with its least label; null labels and labels without a document are
ignored; without any training row every score is 0.5; repeated rows are scored
each; an empty table gives an empty result. Labels, lang, source and doc_id are
never inputs of a score.
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import doc_texts, free_name, read_table, whole_text

BUCKETS = 1 << 14
RANK = 8
#: The most labelled rows that a model is fitted on.
MAX_TRAIN = 6000
EPOCHS = 8
RATE = 0.05
L2 = 1e-4
THRESHOLD = 0.3
FOLDS = 5
SEED = 7

WORD = re.compile(r"\w+")
#: Bin borders of the structure statistics, each with its name.
SHAPES: dict[str, tuple[float, ...]] = {
    "upper": (0.01, 0.03, 0.06, 0.15, 0.4, 0.8),
    "digit": (0.002, 0.01, 0.03, 0.1, 0.3),
    "symbol": (0.002, 0.01, 0.03, 0.08, 0.2, 0.4),
    "stops": (0.01, 0.03, 0.05, 0.08, 0.12, 0.2),
    "bangs": (0.001, 0.004, 0.01, 0.03, 0.1),
    "pipes": (0.001, 0.004, 0.01, 0.03, 0.1),
    "space": (0.1, 0.13, 0.15, 0.17, 0.2, 0.3),
    "word": (3.0, 4.0, 4.6, 5.2, 6.0, 7.5),
    "variety": (0.1, 0.2, 0.35, 0.5, 0.65, 0.8),
    "top": (0.02, 0.04, 0.06, 0.1, 0.2),
    "lines": (0.2, 0.4, 0.6, 0.8, 0.95),
    "line": (20, 60, 120, 240, 480),
    "marks": (0.02, 0.06, 0.1, 0.2, 0.4),
    "size": (50, 200, 500, 1000, 2000, 4000, 8000, 16000, 40000),
}
SLOTS = {name: i * 16 for i, name in enumerate(SHAPES)}
FIRST_WORD = 16 * len(SHAPES)


def shapes(text: str, counts: Counter) -> dict[str, float]:
    n, words = max(len(text), 1), sum(counts.values())
    lines = [x for x in text.split("\n") if x.strip()]
    ends = sum(x.rstrip()[-1] in ".!?:;" for x in lines)
    raw = text.split()
    upper = sum(map(str.isupper, raw)) / max(len(raw), 1)
    return {
        "upper": upper,
        "digit": sum(text.count(d) for d in "0123456789") / n,
        "symbol": sum(text.count(c) for c in "#$%&*@^~=<>{}[]\\/_") / n,
        "stops": text.count(".") / max(len(raw), 1),
        "bangs": text.count("!") / n,
        "pipes": text.count("|") / n,
        "space": (text.count(" ") + text.count("\n")) / n,
        "word": sum(map(len, raw)) / max(len(raw), 1),
        "variety": len(counts) / max(words, 1),
        "top": max(counts.values(), default=0) / max(words, 1),
        "lines": len(set(lines)) / max(len(lines), 1),
        "line": n / max(len(lines), 1),
        "marks": ends / max(len(lines), 1),
        "size": len(text),
    }


class Hasher:
    """Word -> bucket, kept for words seen before (memory only: the hash is fixed)."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, word: str) -> int:
        at = self.known.get(word)
        if at is None:
            if len(self.known) > 300_000:
                self.known.clear()
            at = self.known[word] = FIRST_WORD + zlib.crc32(word.encode()) % (BUCKETS - FIRST_WORD)
        return at


def vector(text: str, hasher: Hasher) -> tuple[np.ndarray, np.ndarray]:
    """(ascending indexes, values) of a whole text."""
    counts = Counter(WORD.findall(text.lower()))
    at = np.fromiter(map(hasher, counts), np.int64, len(counts))
    x = np.log1p(np.fromiter(counts.values(), np.float64, len(counts)))
    if len(at):
        at, inverse = np.unique(at, return_inverse=True)
        x = np.bincount(inverse, x)
        x /= np.sqrt((x * x).sum())
    found = shapes(text, counts)
    slots = [SLOTS[k] + int(np.searchsorted(SHAPES[k], v, "right")) for k, v in found.items()]
    # structure carries as much weight as the words together
    return np.concatenate([slots, at]).astype(np.int32), np.concatenate([np.full(len(slots), 0.5), x]).astype(np.float32)


def held_out(doc_id: str = "doc_id") -> Column:
    return F.crc32(F.col(doc_id).cast("string").cast("binary")) % FOLDS == 0


def training_rows(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> DataFrame:
    """``doc_id, text, quality`` of the bounded training sample; of rows that repeat an id the text of the least hash counts."""
    marked = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality"))
    marked = marked.where(F.col("doc_id").isNotNull() & F.col("quality").isin(0, 1)).where(~held_out())
    marked = marked.groupBy("doc_id").agg(F.min("quality").alias("quality"))
    texts = doc_texts(docs)
    known = marked.join(texts.select("doc_id").distinct(), "doc_id", "left_semi")
    sample = known.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most)
    one = texts.join(F.broadcast(sample), "doc_id").groupBy("doc_id", "quality").agg(F.min(F.struct(F.xxhash64("text").alias("h"), "text")).alias("x"))
    return one.select("doc_id", F.col("x.text").alias("text"), "quality")


def collect_vectors(rows: DataFrame, most: int) -> tuple[list[np.ndarray], list[np.ndarray], np.ndarray]:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        hasher = Hasher()
        for b in batches:
            made = [vector(t, hasher) for t in b.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(2), pa.array([a for a, _ in made], pa.list_(pa.int32())), pa.array([x for _, x in made], pa.list_(pa.float32()))], ["doc_id", "quality", "at", "x"])

    got = rows.mapInArrow(run, "doc_id long, quality int, at array<int>, x array<float>").limit(most).toArrow()
    order = np.argsort(got["doc_id"].to_numpy(), kind="stable") if got.num_rows else np.zeros(0, np.int64)
    at, x = got["at"].combine_chunks(), got["x"].combine_chunks()
    return [at[int(i)].values.to_numpy() for i in order], [x[int(i)].values.to_numpy() for i in order], got["quality"].to_numpy()[order].astype(np.float64) if got.num_rows else np.zeros(0)


class FactorisationMachine:
    def __init__(self, w0: float, w: np.ndarray, v: np.ndarray):
        self.w0, self.w, self.v = w0, w, v

    def logit(self, at: np.ndarray, x: np.ndarray) -> float:
        v, x = self.v[at], x.astype(np.float64)
        s = x @ v
        return float(self.w0 + x @ self.w[at] + 0.5 * ((s * s).sum() - ((x * x) @ (v * v)).sum()))

    def score(self, at: np.ndarray, x: np.ndarray) -> float:
        return float(1 / (1 + np.exp(-np.clip(self.logit(at, x), -35, 35))))


def fit(ats: list[np.ndarray], xs: list[np.ndarray], y: np.ndarray, epochs: int = EPOCHS, batch: int = 64) -> FactorisationMachine:
    """Adagrad on the logistic loss, in a fixed order of seeded epochs: the same rows give the same model."""
    rng = np.random.default_rng(SEED)
    w, v = np.zeros(BUCKETS), rng.normal(0, 0.02, (BUCKETS, RANK))
    if not len(y):
        return FactorisationMachine(0.0, w, np.zeros((BUCKETS, RANK)))
    share = np.clip(y.mean(), 0.02, 0.98)
    w0 = float(np.log(share / (1 - share)))
    g0, gw, gv = 1e-8, np.full(BUCKETS, 1e-4), np.full((BUCKETS, RANK), 1e-4)
    for _ in range(epochs):
        order = rng.permutation(len(y))
        for s in range(0, len(order), batch):
            rows = order[s : s + batch]
            n = np.array([len(ats[i]) for i in rows])
            at, x = np.concatenate([ats[i] for i in rows]), np.concatenate([xs[i] for i in rows]).astype(np.float64)
            starts = np.concatenate([[0], np.cumsum(n)[:-1]])
            row = np.repeat(np.arange(len(rows)), n)
            va = v[at]
            xv = x[:, None] * va
            total = np.add.reduceat(xv, starts)
            z = w0 + np.add.reduceat(x * w[at], starts) + 0.5 * ((total**2).sum(1) - np.add.reduceat((xv**2).sum(1), starts))
            d = (1 / (1 + np.exp(-np.clip(z, -35, 35))) - y[rows]) / len(rows)
            used, inverse = np.unique(at, return_inverse=True)
            dr = d[row]
            dw = np.bincount(inverse, dr * x, len(used)) + L2 * w[used]
            grad = (dr * x)[:, None] * (total[row] - xv)
            dv = np.stack([np.bincount(inverse, grad[:, f], len(used)) for f in range(RANK)], 1) + L2 * v[used]
            g0 += d.sum() ** 2
            gw[used] += dw**2
            gv[used] += dv**2
            w0 -= RATE * d.sum() / np.sqrt(g0)
            w[used] -= RATE * dw / np.sqrt(gw[used])
            v[used] -= RATE * dv / np.sqrt(gv[used])
    return FactorisationMachine(float(w0), w.astype(np.float32).astype(np.float64), v.astype(np.float32).astype(np.float64))


def train(docs: DataFrame, labels: DataFrame, most: int = MAX_TRAIN) -> FactorisationMachine:
    return fit(*collect_vectors(training_rows(docs, labels, most), most))


def with_score(rows: DataFrame, model: FactorisationMachine, score: str) -> DataFrame:
    """Add ``score`` to rows; their whole text is in a column ``text``, every column stays as it is."""
    text = free_name(rows, "quality_text")
    parts = rows.sparkSession.sparkContext.broadcast((model.w0, model.w.astype(np.float32), model.v.astype(np.float32)))

    names = [*rows.columns, score]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        w0, w, v = parts.value
        machine, hasher = FactorisationMachine(w0, w.astype(np.float64), v.astype(np.float64)), Hasher()
        for b in batches:
            scores = [machine.score(*vector(t, hasher)) for t in b.column(b.num_columns - 1).to_pylist()]
            yield pa.RecordBatch.from_arrays([*b.columns[:-1], pa.array(scores, pa.float64())], names)

    return rows.withColumn(text, whole_text()).mapInArrow(run, T.StructType([*rows.schema.fields, T.StructField(score, T.DoubleType())]))


def classify(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """``doc_id, held_out, score, predicted`` of every document."""
    model = train(docs, labels)
    scored = with_score(doc_texts(docs), model, "score")
    return scored.select("doc_id", F.coalesce(held_out(), F.lit(False)).alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


def keep_good(docs: DataFrame, labels: DataFrame, labelled: DataFrame | None = None) -> DataFrame:
    """The documents that the classifier accepts, same columns; it learns from the texts of ``labelled`` (``docs`` unless given)."""
    score = free_name(docs, "quality_score")
    kept = with_score(docs, train(docs if labelled is None else labelled, labels), score)
    return kept.where(F.col(score) >= THRESHOLD).drop(score)


def op2_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    return classify(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "labels"))
