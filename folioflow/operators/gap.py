"""Gap analysis between job descriptions and résumés, for all pairs of two tables.

Inputs are frames ``jd_id, text`` and ``doc_id, text``. Vocabulary work is done
once per text, never per pair: keywords are found by one pattern, tokens become
numbers. Both sides are packed, some hundred texts a row, and each row of one meets
each row of the other; what the pairs of two rows share is then one
product of matrices (:class:`_Side`). Scores, signals and gaps of a pair come from these
counts, so nothing is shuffled behind the meeting. The description side is broadcast
while its counted bytes allow, else it is dealt in blocks.
"""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions import text as X
from ..functions import vocab

#: A side of up to this many bytes, as counted, is broadcast.
BROADCAST_BYTES = 64 << 20
#: Texts in one packed row of either side, pairs that are told at once, and cells of a matrix.
PACK = 256
PAIRS = 1 << 16
CELLS = 1 << 23
#: Positions of texts that are walked side by side, and bytes of texts that are searched at a time.
STEP = 1 << 18
TEXT_BYTES = 1 << 22
#: Terms of descriptions of up to this many bytes, as counted, go to the tasks as they are.
TERM_BYTES = 16 << 20

def _bytes(df: DataFrame) -> int:
    """Bytes of the values of ``df``: 8 a number, text and arrays by their own size."""
    return df.select(F.sum(F.octet_length(F.to_json(F.struct("*"))).cast("long"))).first()[0] or 0


def _small(side: DataFrame) -> DataFrame:
    """A side to join, broadcast where its counted bytes allow."""
    return F.broadcast(side) if _bytes(side) <= BROADCAST_BYTES else side


def _meet(docs: DataFrame, side: DataFrame) -> DataFrame:
    """Every row of ``docs`` beside every row of ``side``, an output of all pairs by contract.

    ``side`` goes out whole while its bytes allow; beyond that both are dealt to
    blocks, and each block of ``side`` meets ``docs`` in tasks of its own.
    """
    size = _bytes(side)
    if size <= BROADCAST_BYTES:
        return docs.crossJoin(F.broadcast(side))
    blocks = -(-size // BROADCAST_BYTES) * 4
    dealt = side.withColumn("_block", F.pmod(F.xxhash64(*side.columns[:1]), F.lit(blocks)))
    spread = docs.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1))).cast("long"))
    return spread.join(dealt.hint("shuffle_hash"), "_block").drop("_block")


def _packed(rows: DataFrame, size: int = PACK) -> DataFrame:
    """``rows`` with up to ``size`` of them in one: each column is an array. Nothing is shuffled."""
    names = rows.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cuts = pa.array([*range(0, b.num_rows, size), b.num_rows], pa.int32())
            yield pa.RecordBatch.from_arrays([pa.ListArray.from_arrays(cuts, c) for c in b.columns], names)

    return rows.mapInArrow(run, ", ".join(f"`{c}` array<{t}>" for c, t in rows.dtypes))


def packed_meeting(docs: DataFrame, side: DataFrame, tell: Callable[[dict, dict, dict], Iterator[pa.RecordBatch]], schema: str) -> DataFrame:
    """Every row of ``docs`` with every row of ``side``: ``tell`` gets the columns of a packed row of each (Arrow arrays) and a store for what it keeps of the latter."""
    few = side.repartition(max(1, -(-side.count() // PACK)))
    met = _meet(_packed(docs), _packed(few))
    left, right = docs.columns, side.columns

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        before, kept = None, {}
        for b in batches:
            for i in range(b.num_rows):
                one = lambda names, i=i, b=b: {c: b.column(c)[i].values for c in names}
                block = one(right)
                if before is None or any(not block[c].equals(before[c]) for c in right):
                    before, kept = block, {}
                yield from tell(one(left), block, kept)

    return met.select(*left, *right).mapInArrow(run, schema)


def _lists(column: pa.ListArray) -> tuple[pa.Array, np.ndarray]:
    """(values of all lists, length of each); null lists are empty."""
    return column.flatten(), pc.fill_null(pc.list_value_length(column), 0).to_numpy(zero_copy_only=False)


def _holds(column: pa.ListArray, known: np.ndarray) -> np.ndarray:
    """A row for each list and a column for each of the ascending ``known`` numbers: 1 where the list holds it."""
    values, sizes = _lists(column)
    values = values.to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), len(known)), np.float32)
    if len(known) and len(values):
        at = np.minimum(np.searchsorted(known, values), len(known) - 1)
        told = known[at] == values
        out[np.repeat(np.arange(len(sizes)), sizes)[told], at[told]] = 1
    return out


class _Side:
    """A block of descriptions as matrices. Their categories and wanted terms lie one behind the other, in order of description, then of rank."""

    def __init__(self, block: dict):
        n = self.n = len(block["jd_id"])
        self.tokens = pc.fill_null(block["jd_tokens"], 0).to_numpy(zero_copy_only=False)
        terms, sizes = _lists(block["jd_terms"])
        self.terms, at = np.unique(terms.to_numpy(zero_copy_only=False), return_inverse=True)
        self.by_term = np.zeros((len(self.terms), n), np.float32)
        self.by_term[at, np.repeat(np.arange(n), sizes)] = 1
        cats, self.n_cats = _lists(block["cats"])
        jd = np.repeat(np.arange(n), self.n_cats)
        order = np.lexsort((cats.field("cat_ord").to_numpy(), -cats.field("frequency").to_numpy(), jd))
        cats = cats.take(pa.array(order))
        self.jd, self.cat, self.frequency, self.asked = jd, cats.field("cat_ord"), cats.field("frequency").to_numpy(), cats.field("asked")
        self.starts = np.cumsum(self.n_cats) - self.n_cats
        self.slot = np.arange(len(jd)) - self.starts[jd]
        asked, self.sizes = _lists(self.asked)
        self.words, self.asked_at = np.unique(asked.to_numpy(zero_copy_only=False), return_inverse=True)
        self.by_word = np.zeros((len(self.words), len(jd)), np.float32)
        self.by_word[self.asked_at, np.repeat(np.arange(len(jd)), self.sizes)] = 1
        # coverage in hundredths, halves to even, by the number of shared keywords
        shared, size = 100 * np.arange(self.sizes.max(initial=0) + 1), self.sizes[:, None]
        low, rest = shared // size, shared % size
        self.cents = (low + ((2 * rest > size) | ((2 * rest == size) & (low % 2 == 1)))).astype(np.int16)
        want, self.n_want = _lists(block["want"])
        self.want_jd, self.want_term, self.want_freq = np.repeat(np.arange(n), self.n_want), want.field("term"), -want.field("nf").to_numpy(zero_copy_only=False)
        self.want_at = np.searchsorted(self.terms, want.field("n").to_numpy(zero_copy_only=False))

    def steps(self, docs: dict) -> Iterator[tuple[pa.Array, np.ndarray, np.ndarray, np.ndarray]]:
        """(ids, terms, keywords, shared keywords by category) of some of the documents at a time; a few pairs and cells each."""
        step = max(1, min(PAIRS // max(1, self.n), CELLS // max(1, len(self.terms), len(self.words), len(self.jd))))
        for at in range(0, len(docs["doc_id"]), step):
            some = {c: x.slice(at, step) for c, x in docs.items()}
            holds, knows = _holds(some["have"], self.terms), _holds(some["keywords"], self.words)
            yield some["doc_id"], holds, knows, (knows @ self.by_word).astype(np.int64)

    def coverage(self, met: np.ndarray) -> np.ndarray:
        return self.cents.ravel().take(met + np.arange(len(self.jd)) * self.cents.shape[1])

    def scores(self, holds: np.ndarray, cents: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(shared, overlap, category_mean, score), a row for each document and a column for each description."""
        shared = (holds @ self.by_term).astype(np.int64)
        overlap = shared / np.maximum(self.tokens, 1)
        total, some = np.zeros((len(cents), self.n), np.int64), np.flatnonzero(self.n_cats)
        if len(some):
            total[:, some] = np.add.reduceat(cents, self.starts[some], axis=1, dtype=np.int64)
        mean = total / np.maximum(self.n_cats, 1) / 100
        return shared, overlap, mean, np.minimum(np.floor((0.5 * overlap + 0.5 * mean) * 100), 100).astype(np.int32)

    def signals(self, cents: np.ndarray, top_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        """(pair, category entry, whether it is medium, rank) of the ``top_n`` signals of each pair: high ones first, then by frequency and the vocabulary's order."""
        width = int(self.n_cats.max(initial=0))
        keys = np.full((len(cents), self.n, width), 2 * width, np.int32)
        high = (cents < 30) & (self.frequency >= 2)
        medium = ~high & (cents < 60) & (self.frequency >= 1)
        keys[:, self.jd, self.slot] = np.where(high, self.slot, np.where(medium, self.slot + width, 2 * width))
        keys = np.sort(keys, axis=2)[:, :, :top_n].reshape(len(cents) * self.n, -1)
        pair, rank = np.nonzero(keys < 2 * width)
        key = keys[pair, rank]
        return pair, self.starts[pair % self.n] + key % width if width else key, key >= width, rank + 1

    def gaps(self, holds: np.ndarray, top_n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(pair, wanted entry, rank) of the first ``top_n`` wanted terms that a document lacks."""
        lacks = holds[:, self.want_at] == 0
        seen = np.concatenate([np.zeros((len(lacks), 1), np.int64), np.cumsum(lacks, axis=1)], axis=1)
        rank = seen[:, 1:] - seen[:, (np.cumsum(self.n_want) - self.n_want)[self.want_jd]]
        doc, entry = np.nonzero(lacks & (rank <= top_n))
        return doc * self.n + self.want_jd[entry], entry, rank[doc, entry]


def _grouped(pair: np.ndarray, pairs: int, values: pa.Array) -> pa.ListArray:
    """A list for each pair of the values that are told in order of pairs."""
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(np.bincount(pair, minlength=pairs))]).astype(np.int32)), values)


def _trie(words: list[str]) -> str:
    """A pattern for the longest of ``words`` that begins at a position: one branch a character, an end optional where words go on."""
    root: dict = {}
    for w in words:
        node = root
        for c in w:
            node = node.setdefault(c, {})
        node[""] = {}

    def pattern(node: dict) -> str:
        branches = [(re.escape(c) if c.isascii() else c) + pattern(n) for c, n in sorted(node.items()) if c]
        if not branches:
            return ""
        body = branches[0] if len(branches) == 1 and "" not in node else f"(?:{'|'.join(branches)})"
        return body + "?" * ("" in node)

    return pattern(root)


def _overlaps_itself(word: str) -> bool:
    return any(word.startswith(word[k:]) for k in range(1, len(word)))


def _keyword_table(words: list[tuple[int, str, int, str]]):
    """(pattern, map from a longest keyword to the rows of all keywords that begin it, map from a row to its word and the longest ones it begins)."""
    texts = sorted({w for *_, w in words})
    begins = {w: [i for i, (*_, x) in enumerate(words) if w.startswith(x)] for w in texts}
    rows = F.create_map(*[c for w in texts for c in (F.lit(w), F.array(*map(F.lit, begins[w])))])
    entry = lambda c, k, w: F.struct(
        F.lit(c).alias("cat_ord"), F.lit(k).alias("kw_ord"), F.lit(w).alias("word"), F.lit(_overlaps_itself(w)).alias("folds"), F.array(*[F.lit(x) for x in texts if x.startswith(w)]).alias("longest")
    )
    return f"(?=({_trie(texts)}))", rows, F.array(*[entry(c, k, w) for c, _, k, w in words])


def hits_of(text: Column, words: list[tuple[int, str, int, str]]) -> Column:
    """array<struct<cat_ord, kw_ord, n>>: keywords that occur in a text, in order, with their occurrences that don't overlap.

    The vocabulary is one pattern that tells the longest keyword at each
    position; all others that begin there are its prefixes. A keyword that can't
    overlap itself occurs as often as it is told, the few that can are counted in the text. A null text has none.
    """
    none = F.array().cast("array<struct<cat_ord:int,kw_ord:int,n:int>>")
    if not words:
        return none
    pattern, rows, table = _keyword_table(words)

    def counted(low: Column, found: Column) -> Column:
        present = F.array_sort(F.array_distinct(F.flatten(F.transform(F.array_distinct(found), lambda f: F.element_at(rows, f)))))
        told = lambda w: F.size(F.filter(found, lambda f: F.array_contains(w["longest"], f)))
        one = lambda w: F.struct(w["cat_ord"].alias("cat_ord"), w["kw_ord"].alias("kw_ord"), F.when(w["folds"], X.occurrences(low, w["word"])).otherwise(told(w)).alias("n"))
        return F.transform(present, lambda i: one(F.get(table, i)))

    low = F.lower(text)
    return F.coalesce(X.let(F.struct(low.alias("low"), F.regexp_extract_all(low, F.lit(pattern), F.lit(1)).alias("found")), lambda x: counted(x["low"], x["found"])), none)


def keyword_hits(texts: DataFrame, key: str, words: list[tuple[int, str, int, str]]) -> DataFrame:
    """``key, hits`` (:func:`hits_of`) of every text."""
    return texts.select(key, hits_of(F.col("text"), words).alias("hits"))


class _Automaton:
    """Finds all of ``words`` at all positions of many texts at once: a trie over bytes, walked from every position side by side.

    Positions that no word goes on at leave, so the work is about a few steps a byte, whatever the number of words.
    """

    def __init__(self, words: list[str]):
        coded = [w.encode() for w in words]
        alphabet = sorted({b for w in coded for b in w})
        # class 0 is any other byte, node 0 is dead, node 1 the root
        self.kind = np.zeros(256, np.uint8 if len(alphabet) < 256 else np.uint16)
        self.kind[alphabet] = np.arange(1, len(alphabet) + 1)
        steps, ends = [{}, {}], [-1, -1]
        for i, w in enumerate(coded):
            at = 1
            for b in w:
                if b not in steps[at]:
                    steps[at][b] = len(steps)
                    steps.append({})
                    ends.append(-1)
                at = steps[at][b]
            ends[at] = i
        self.width, self.ends = len(alphabet) + 1, np.array(ends, np.int32)
        self.next = np.zeros(len(steps) * self.width, np.int32)
        for at, known in enumerate(steps):
            for b, to in known.items():
                self.next[at * self.width + int(self.kind[b])] = to
        first = self.next[self.width : 2 * self.width]
        self.pair = self.next.reshape(-1, self.width)[first].ravel()
        self.single = self.ends[first]
        self.length = np.array([len(w) for w in coded], np.int64)
        self.folds = np.array([_overlaps_itself(w) for w in words], bool)

    def _found(self, kinds: np.ndarray, at: int, to: int) -> tuple[np.ndarray, np.ndarray]:
        """(position, word) of all words that begin from ``at`` up to ``to``; ``kinds`` ends with a 0."""
        places = []
        if (self.single >= 0).any():
            word = self.single[kinds[at:to]]
            ended = np.flatnonzero(word >= 0)
            places.append((ended + at, word[ended]))
        else:
            places.append((np.zeros(0, np.int64), np.zeros(0, np.int32)))
        # the first two bytes are one step; the last position has no second one
        state = self.pair[kinds[at : min(to, len(kinds) - 1)].astype(np.int32) * self.width + kinds[at + 1 : to + 1]]
        spot = np.flatnonzero(state)
        state, spot = state[spot], spot + at + 1
        while len(spot):
            word = self.ends[state]
            ended = np.flatnonzero(word >= 0)
            places.append((spot[ended], word[ended]))
            spot = spot + 1
            state = self.next[state * self.width + kinds[spot]]
            on = np.flatnonzero(state)
            spot, state = spot[on], state[on]
        # a word of k bytes was told at its last one
        places = [(x - depth, w) for depth, (x, w) in enumerate(places)]
        return np.concatenate([x for x, _ in places]), np.concatenate([w for _, w in places])

    def present(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, word) of the words that each text holds, once each; ``data`` is the texts' bytes, ``ends`` where each text ends."""
        kinds, words, told = np.append(self.kind[data], 0).astype(self.kind.dtype), len(self.length), []
        for at in range(0, len(data), STEP):
            spot, word = self._found(kinds, at, min(at + STEP, len(data)))
            row = np.searchsorted(ends, spot, "right")
            told.append(np.unique((row * words + word)[spot + self.length[word] <= ends[row]]))
        keys = np.unique(np.concatenate(told)) if told else np.zeros(0, np.int64)
        return keys // words, keys % words

    def counts(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(row, word, occurrences that don't overlap) of the words of each text, as ``str.count`` has them."""
        coded = [t.encode("utf-8", "surrogatepass") if t else b"" for t in texts.to_pylist()]
        starts = np.cumsum([0, *(len(t) + 1 for t in coded)])
        kinds = self.kind[np.frombuffer(b"\0".join(coded) + b"\0", np.uint8)]
        kinds[starts[1:] - 1] = 0
        words, told, again = len(self.ends), [], []
        for at in range(0, len(kinds), STEP):
            spot, word = self._found(kinds, at, min(at + STEP, len(kinds)))
            key = (np.searchsorted(starts, spot, "right") - 1) * words + word
            folds = self.folds[word]
            told.append(np.unique(key[~folds], return_counts=True))
            again.append((key[folds], spot[folds]))
        keys, n = (np.concatenate(x) for x in zip(*told, strict=True))
        key, spot = (np.concatenate(x) for x in zip(*again, strict=True))
        kept = key[self._apart(key, spot, words)]
        keys, n = np.concatenate([keys, kept]), np.concatenate([n, np.ones(len(kept), np.int64)])
        keys, place = np.unique(keys, return_inverse=True)
        return keys // words, keys % words, np.bincount(place, n, len(keys)).astype(np.int64)

    def _apart(self, key: np.ndarray, spot: np.ndarray, words: int) -> np.ndarray:
        """Which of the hits of words that can overlap themselves count, from the left."""
        order = np.lexsort((spot, key))
        key, spot = key[order], spot[order]
        length = self.length[key % words]
        close = np.flatnonzero((key[1:] == key[:-1]) & (spot[1:] - spot[:-1] < length[1:])) + 1
        kept = np.ones(len(key), bool)
        last, end = -1, 0
        for i in close.tolist():
            # the first of a run of hits that are close counts
            if i - 1 != last:
                end = spot[i - 1] + length[i]
            last = i
            if spot[i] < end:
                kept[i] = False
            else:
                end = spot[i] + length[i]
        return order[kept]


def vocabulary_counts(texts: DataFrame, key: str, words: list[tuple[int, str, int, str]]) -> DataFrame:
    """``key, cat_ord, kw_ord, n``: the same hits as rows, for vocabularies of thousands of words.

    Each text is read once (:class:`_Automaton`), where it lies; nothing is shuffled. A row with its key repeated has rows of its own.
    """
    known = sorted({w for *_, w in words})
    ids: dict[str, list[tuple[int, int]]] = {}
    for c, _, k, w in words:
        ids.setdefault(w, []).append((c, k))
    names = [key, "cat_ord", "kw_ord", "n"]
    entries = [ids[w] for w in known]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        finder = _Automaton(known)
        sizes = np.array([len(e) for e in entries], np.int64)
        first = np.cumsum(sizes) - sizes
        ords = np.array([x for e in entries for x in e], np.int32).reshape(-1, 2)
        for b in batches:
            for at in range(0, b.num_rows, PACK):
                keys, column = (c.slice(at, PACK) for c in b.columns)
                row, word, n = finder.counts(column)
                # a word that is several keywords counts for each
                times = sizes[word]
                place = np.repeat(np.arange(len(row)), times)
                entry = first[word][place] + np.arange(len(place)) - (np.cumsum(times) - times)[place]
                made = [keys.take(pa.array(row[place])), pa.array(ords[entry, 0]), pa.array(ords[entry, 1]), pa.array(n[place])]
                yield pa.RecordBatch.from_arrays(made, names)

    return texts.select(key, F.lower("text").alias("low")).mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, cat_ord int, kw_ord int, n long")


def keyword_frequency(texts: DataFrame, key: str, words: list[tuple[int, str, int, str]]) -> DataFrame:
    names = F.create_map(*[F.lit(x) for c, name, _, _ in dict.fromkeys((c, n, 0, "") for c, n, _, _ in words) for x in (c, name)])
    rows = keyword_hits(texts, key, words).select(key, F.explode("hits").alias("h")).groupBy(key, F.col("h.cat_ord").alias("cat_ord")).agg(F.count("*").alias("n_keywords"), F.sum("h.n").cast("long").alias("frequency"))
    return rows.select(key, F.element_at(names, F.col("cat_ord")).alias("category"), "n_keywords", "frequency")


class _Finder:
    """Finds the keywords and the terms (as :func:`folioflow.functions.text.tokens` cuts them) of many lower-case texts at once, on their bytes."""

    LETTER, GOES_ON = (np.array([re.fullmatch(p, chr(b)) is not None for b in range(256)]) for p in (r"[a-zA-Z]", r"[a-zA-Z0-9\-/+.#]"))

    def __init__(self, words: list[tuple[int, str, int, str]], terms: pa.Array | None):
        numbers: dict[str, list[int]] = {}
        for c, _, k, w in words:
            numbers.setdefault(w, []).append(c * 1000 + k)
        self.everywhere = numbers.pop("", [])
        self.keywords = [np.array(x, np.int32) for x in numbers.values()]
        self.automaton = _Automaton(list(numbers)) if numbers else None
        self.terms = terms

    @staticmethod
    def blocks(column: pa.Array) -> Iterator[tuple[int, int]]:
        """(first row, rows) of some of the texts at a time, about ``TEXT_BYTES`` of them."""
        ends = np.cumsum(pc.fill_null(pc.binary_length(column), 0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(ends):
            to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + TEXT_BYTES, "right")))
            yield at, to - at
            at = to

    def find(self, texts: pa.Array) -> tuple[pa.ListArray, pa.ListArray | None]:
        """(numbers of the keywords, places of the terms among all terms) that each text holds; a null text has none."""
        there = texts.is_valid().to_numpy(zero_copy_only=False)
        sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
        data, ends = np.frombuffer(b"".join(pc.fill_null(texts, "").cast(pa.binary()).to_pylist()), np.uint8), np.cumsum(sizes)
        rows, told = [np.repeat(np.flatnonzero(there), len(self.everywhere))], [np.tile(np.array(self.everywhere, np.int32), int(there.sum()))]
        if self.automaton and len(data):
            row, word = self.automaton.present(data, ends)
            times = np.array([len(x) for x in self.keywords])[word]
            rows.append(np.repeat(row, times))
            told.append(np.concatenate([np.zeros(0, np.int32), *[self.keywords[w] for w in word.tolist()]]))
        row, told = np.concatenate(rows), np.concatenate(told)
        order = np.argsort(row, kind="stable")
        keywords = _grouped(row[order], len(sizes), pa.array(told[order]))
        if self.terms is None:
            return keywords, None
        row, place = self._terms(data, ends)
        return keywords, _grouped(row, len(sizes), pa.array(place))

    def _terms(self, data: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(row, place among the terms) of the terms of each text, once each."""
        if not len(data) or not len(self.terms):
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        on = self.GOES_ON[data]
        begins = on.copy()
        begins[1:] &= ~on[:-1]
        cuts = ends[:-1][ends[:-1] < len(data)]  # a run ends with its text
        begins[cuts] = on[cuts]
        # a token is a run from its first letter on
        run = np.cumsum(begins, dtype=np.int32)
        letters = np.flatnonzero(self.LETTER[data])
        of = run[letters]
        first = np.ones(len(letters), bool)
        first[1:] = of[1:] != of[:-1]
        start, of = letters[first], of[first]
        starts = np.flatnonzero(begins)
        stops = np.append(starts[1:], len(data))  # the next run's start; the run itself ends at the first byte that doesn't go on
        off = np.append(np.flatnonzero(~on), len(data))
        stop = np.minimum(stops[of - 1], off[np.searchsorted(off, start)])
        long = stop - start > 2
        start, stop = start[long], stop[long]
        # tokens and what lies between them, as slices of the bytes
        bounds = np.empty(2 * len(start) + 1, np.int32)
        bounds[0], bounds[1::2], bounds[2::2] = 0, start, stop
        slices = pa.Array.from_buffers(pa.binary(), len(bounds) - 1, [None, pa.py_buffer(bounds), pa.py_buffer(data)])
        place = pc.fill_null(pc.index_in(slices, value_set=self.terms), -1).to_numpy(zero_copy_only=False)[1::2].astype(np.int64)
        known = np.flatnonzero(place >= 0)
        keys = np.unique(np.searchsorted(ends, start[known], "right") * len(self.terms) + place[known])
        return keys // len(self.terms), keys % len(self.terms)


def _doc_side(docs: DataFrame, words: list[tuple[int, str, int, str]], terms: pa.Table | None = None) -> DataFrame:
    """``doc_id, keywords, have``: the numbers of the keywords of a text, 1000 to a category, and of those of ``terms`` (``term, n``) that it holds.

    A text is read once, where it lies; nothing is shuffled.
    """
    names = ["doc_id", "keywords", "have"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        asked = None if terms is None else terms["term"].combine_chunks().cast(pa.binary())
        number = None if terms is None else terms["n"].combine_chunks()
        finder = _Finder(words, asked)
        for b in batches:
            for at, n in finder.blocks(b.column(1)):
                keywords, places = finder.find(b.column(1).slice(at, n))
                if places is None:
                    have = pa.ListArray.from_arrays(pa.array(np.zeros(n + 1, np.int32)), pa.array([], pa.int64()))
                else:
                    have = pa.ListArray.from_arrays(places.offsets, number.take(places.values))
                yield pa.RecordBatch.from_arrays([b.column(0).slice(at, n), keywords, have], names)

    return docs.select("doc_id", F.lower("text").alias("low")).mapInArrow(run, f"doc_id {dict(docs.dtypes)['doc_id']}, keywords array<int>, have array<long>")


def _asked(text: Column, words: list[tuple[int, str, int, str]]) -> Column:
    """``array<struct<cat_ord, frequency, asked>>`` of the categories that a text names."""
    keyword = lambda h: h["cat_ord"] * 1000 + h["kw_ord"]
    of_category = lambda hits, c: F.filter(hits, lambda h: h["cat_ord"] == c)
    category = lambda hits: lambda c: X.let(of_category(hits, c), lambda hs: F.struct(c.alias("cat_ord"), F.aggregate(hs, F.lit(0).cast("long"), lambda a, h: a + h["n"]).alias("frequency"), F.transform(hs, keyword).alias("asked")))
    ords = F.array(*[F.lit(c) for c in dict.fromkeys(c for c, *_ in words)]) if words else F.array().cast("array<int>")
    return X.let(hits_of(text, words), lambda hits: F.filter(F.transform(ords, category(hits)), lambda c: F.size(c["asked"]) > 0))


def _keyword_sides(jds: DataFrame, docs: DataFrame, words: list[tuple[int, str, int, str]]) -> tuple[DataFrame, DataFrame]:
    """:func:`_sides` without terms: nothing is shuffled before the meeting either."""
    none = F.array().cast("array<long>")
    unwanted = F.lit(None).cast("array<struct<nf:long,first_pos:int,term:string,n:long>>")
    side = jds.select("jd_id", F.lit(0).alias("jd_tokens"), none.alias("jd_terms"), _asked(F.col("text"), words).alias("cats"), unwanted.alias("want"))
    return _doc_side(docs, words), side


def category_coverage(jds: DataFrame, docs: DataFrame, taxonomy: dict[str, list[str]] | None = None, named: bool = True) -> DataFrame:
    """``jd_id, doc_id, cat_ord, category, jd_keywords, frequency, shared, coverage, missing`` for categories that the description names.

    Coverage is shared / description keywords, rounded half-even to hundredths. Unless ``named``, the lists of keywords are left out.
    """
    words = vocab.taxonomy_rows(taxonomy)
    spine, side = _keyword_sides(jds, docs, words)
    names = ["jd_id", "doc_id", "cat_ord", "frequency", "shared", "coverage", *(["asked", "lacks"] if named else [])]

    def tell(some: dict, block: dict, kept: dict) -> Iterator[pa.RecordBatch]:
        side = kept["side"] = kept.get("side") or _Side(block)
        jd_of, n = block["jd_id"].take(pa.array(side.jd)), len(side.jd)
        for ids, _, knows, met in side.steps(some):
            entry, doc = np.tile(np.arange(n), len(ids)), np.repeat(np.arange(len(ids)), n)
            at = pa.array(entry)
            made = [jd_of.take(at), ids.take(pa.array(doc)), side.cat.take(at), pa.array(side.frequency[entry]), pa.array(met.ravel().astype(np.int32)), pa.array(side.coverage(met).ravel() / 100)]
            if named:
                owner = np.repeat(np.arange(n), side.sizes)
                row, lacking = np.nonzero(knows[:, side.asked_at] == 0)
                made += [side.asked.take(at), _grouped(row * n + owner[lacking], len(entry), pa.array(side.words[side.asked_at[lacking]].astype(np.int32)))]
            yield pa.RecordBatch.from_arrays(made, names)

    kinds = ["cat_ord int, frequency long, shared int, coverage double", *(["asked array<int>, lacks array<int>"] if named else [])]
    rows = packed_meeting(spine, side, tell, ", ".join([_ids(jds, docs), *kinds]))
    name = F.create_map(*[F.lit(x) for c, n in dict.fromkeys((c, n) for c, n, _, _ in words) for x in (c, n)])
    rows = rows.withColumn("category", F.element_at(name, F.col("cat_ord")))
    if not named:
        return rows.select("jd_id", "doc_id", "cat_ord", "category", "frequency", "shared", "coverage")
    word = F.create_map(*[F.lit(x) for c, _, k, w in words for x in (c * 1000 + k, w)])
    said = lambda numbers: F.transform(numbers, lambda k: F.element_at(word, k))
    return rows.select("jd_id", "doc_id", "cat_ord", "category", said("asked").alias("jd_keywords"), "frequency", "shared", "coverage", said("lacks").alias("missing"))


def _ids(jds: DataFrame, docs: DataFrame) -> str:
    return f"jd_id {dict(jds.dtypes)['jd_id']}, doc_id {dict(docs.dtypes)['doc_id']}"


def priority(coverage: Column, frequency: Column) -> Column:
    return F.when((coverage < 0.3) & (frequency >= 2), "high").when((coverage < 0.6) & (frequency >= 1), "medium").otherwise("low")


def gap_signals(coverage: DataFrame, top_n: int = 5) -> DataFrame:
    """The ``top_n`` high or medium signals of each pair of a coverage table: high first, then frequency, then the vocabulary's order.

    For signals straight from texts, :func:`pair_signals` needs no shuffle.
    """
    rows = coverage.withColumn("priority", priority(F.col("coverage"), F.col("frequency"))).where("priority <> 'low'")
    order = Window.partitionBy("jd_id", "doc_id").orderBy(F.when(F.col("priority") == "high", 0).otherwise(1), F.desc("frequency"), "cat_ord")
    return rows.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top_n).withColumn("label", X.title_label(F.col("category")))


def with_angles(signals: DataFrame) -> DataFrame:
    """Add the suggested angles of the category (a constant map; categories without any get the empty array)."""
    table = F.create_map(*[x for name, angles in vocab.ANGLES.items() for x in (F.lit(name), F.array(*map(F.lit, angles)))])
    return signals.withColumn("angles", F.coalesce(F.try_element_at(table, F.col("category")), F.array().cast("array<string>")))


def _term_rows(texts: DataFrame, key: str) -> DataFrame:
    return texts.select(key, F.posexplode(X.tokens(F.col("text"))).alias("pos", "term")).groupBy(key, "term").agg(F.count("*").alias("freq"), F.min("pos").alias("first_pos"))


def doc_terms(texts: DataFrame, key: str) -> DataFrame:
    """``key, term, freq, first_pos``: term frequencies with the first position as tie-break.

    The terms of one row are counted where it is read; only rows whose key occurs several times are shuffled to be counted together.
    """
    names = [key, "term", "freq", "first_pos"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for at in range(0, b.num_rows, PACK):
                keys, column = (c.slice(at, PACK) for c in b.columns)
                tokens, sizes = _lists(column)
                coded = tokens.dictionary_encode()
                row, words = np.repeat(np.arange(len(sizes)), sizes), max(1, len(coded.dictionary))
                told, first, n = np.unique(row * words + coded.indices.to_numpy(), return_index=True, return_counts=True)
                place = first - (np.cumsum(sizes) - sizes)[told // words]
                made = [keys.take(pa.array(told // words)), coded.dictionary.take(pa.array(told % words)), pa.array(n.astype(np.int64)), pa.array(place.astype(np.int32))]
                yield pa.RecordBatch.from_arrays(made, names)

    again = _small(texts.groupBy(F.col(key).alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1").select("_again"))
    same = F.col(key).eqNullSafe(F.col("_again"))
    once = texts.join(again, same, "left_anti").select(key, X.tokens(F.col("text")).alias("tokens"))
    counted = once.mapInArrow(run, f"{key} {dict(texts.dtypes)[key]}, term string, freq long, first_pos int")
    return counted.unionByName(_term_rows(texts.join(again, same, "left_semi"), key))


def _numbers(terms: DataFrame):
    """A function from a term to a number that tells the distinct ``terms`` apart, and their bytes; one action."""

    def seeded(seed: int):
        return lambda term: F.xxhash64(F.lit(seed), term)

    for number in map(seeded, range(64)):
        n, told, size = terms.agg(F.count("*"), F.count_distinct(number(F.col("term"))), F.sum(F.octet_length("term") + 8)).first()
        if n == told:
            return number, size or 0
    raise ValueError("no seed tells the terms apart")


def _sides(jds: DataFrame, docs: DataFrame, words: list[tuple[int, str, int, str]], min_freq: int = 2) -> tuple[DataFrame, DataFrame]:
    """``doc_id, keywords, have`` and ``jd_id, jd_tokens, jd_terms, cats, want``.

    ``have`` holds the numbers of those of the descriptions' terms that the document
    holds; ``cats`` a description's categories, ``want`` its frequent terms by frequency, then first occurrence.
    Keywords are numbers, 1000 to a category; so are the descriptions' terms. A document meets the terms by name, once.
    """
    tokens = F.array_distinct(X.tokens(F.col("text")))
    none = F.array().cast("array<long>")
    asked_terms = jds.select(F.explode(tokens).alias("term")).distinct()
    number, size = _numbers(asked_terms)
    frequent = _term_rows(jds, "jd_id").where((F.col("freq") >= min_freq) & (F.length("term") > 3))
    wanted = frequent.groupBy("jd_id").agg(F.sort_array(F.collect_list(F.struct((-F.col("freq")).alias("nf"), "first_pos", "term", number(F.col("term")).alias("n")))).alias("want"))
    side = jds.select("jd_id", F.size(tokens).alias("jd_tokens"), F.coalesce(F.transform(tokens, number), none).alias("jd_terms"), _asked(F.col("text"), words).alias("cats")).join(wanted, "jd_id", "left")
    terms = asked_terms.select("term", number(F.col("term")).alias("n"))
    if size <= TERM_BYTES:
        return _held_side(docs, words, terms.toArrow()), side
    terms = F.broadcast(terms) if size <= BROADCAST_BYTES else terms
    held = docs.select("doc_id", F.explode(tokens).alias("term")).join(terms, "term").groupBy("doc_id").agg(F.collect_list("n").alias("have"))
    spine = _doc_side(docs, words).drop("have").join(held, "doc_id", "left").withColumn("have", F.coalesce("have", none))
    return spine.select("doc_id", "keywords", "have"), side


def _held_side(docs: DataFrame, words: list[tuple[int, str, int, str]], terms: pa.Table) -> DataFrame:
    """:func:`_doc_side` where rows of one ``doc_id`` hold the terms of all of them, and rows without one none. Only rows of repeated ids are shuffled."""
    none = F.array().cast("array<long>")
    again = _small(docs.groupBy(F.col("doc_id").alias("_again")).agg(F.count("*").alias("_n")).where("_n > 1 AND _again IS NOT NULL").select("_again"))
    same = F.col("doc_id") == F.col("_again")
    once = _doc_side(docs.join(again, same, "left_anti"), words, terms).withColumn("have", F.when(F.col("doc_id").isNull(), none).otherwise(F.col("have")))
    more = _doc_side(docs.join(again, same, "left_semi"), words, terms)
    held = more.select("doc_id", F.explode("have").alias("n")).distinct().groupBy("doc_id").agg(F.collect_list("n").alias("have"))
    return once.unionByName(more.drop("have").join(held, "doc_id", "left").withColumn("have", F.coalesce("have", none)))


SIGNAL = "struct<low: boolean, less: long, cat_ord: int, coverage: double, asked: array<int>>"


#: Figures of a pair, in their order.
FIGURES = {"jd_tokens": "int", "shared": "long", "overlap": "double", "category_mean": "double", "score": "int"}


def pairs(jds: DataFrame, docs: DataFrame, taxonomy: dict[str, list[str]] | None = None, min_freq: int = 2, signals: int | None = None, gaps: int | None = None, figures: tuple[str, ...] = tuple(FIGURES)) -> DataFrame:
    """Every pair as one row: ``jd_id, doc_id, jd_tokens, shared, overlap, category_mean, score``, or only some of these ``figures``.

    ``shared`` counts the distinct tokens of both. The score is half token overlap, half mean coverage of the
    description's categories, times 100, truncated. Coverage is summed in whole hundredths, so
    the sum is exact in any order. With ``signals`` also ``kept``, the pair's first signals as
    ``array<struct<low, less, cat_ord, coverage, asked>>``; with ``gaps`` also ``gaps``, the first wanted terms that the
    document lacks as ``array<struct<rank, term, freq>>`` (null if none).
    """
    spine, side = _sides(jds, docs, vocab.taxonomy_rows(taxonomy), min_freq)
    names = ["jd_id", "doc_id", *figures, *(["kept"] if signals else []), *(["gaps"] if gaps else [])]

    def tell(some: dict, block: dict, kept: dict) -> Iterator[pa.RecordBatch]:
        side = kept["side"] = kept.get("side") or _Side(block)
        for ids, holds, _, met in side.steps(some):
            cents, n = side.coverage(met), len(ids) * side.n
            at = pa.array(np.tile(np.arange(side.n), len(ids)))
            numbers = dict(zip(["shared", "overlap", "category_mean", "score"], side.scores(holds, cents), strict=True))
            made = [block["jd_id"].take(at), ids.take(pa.array(np.repeat(np.arange(len(ids)), side.n)))]
            made += [block[c].take(at) if c == "jd_tokens" else pa.array(numbers[c].ravel()) for c in figures]
            if signals:
                pair, entry, medium, _ = side.signals(cents, signals)
                e = pa.array(entry)
                fields = [pa.array(medium), pa.array(-side.frequency[entry]), side.cat.take(e), pa.array(cents[pair // side.n, entry] / 100), side.asked.take(e)]
                made.append(_grouped(pair, n, pa.StructArray.from_arrays(fields, ["low", "less", "cat_ord", "coverage", "asked"])))
            if gaps:
                pair, entry, rank = side.gaps(holds, gaps)
                fields = [pa.array(rank.astype(np.int32)), side.want_term.take(pa.array(entry)), pa.array(side.want_freq[entry])]
                made.append(_grouped(pair, n, pa.StructArray.from_arrays(fields, ["rank", "term", "freq"])))
            yield pa.RecordBatch.from_arrays(made, names)

    kinds = [_ids(jds, docs), *[f"{c} {FIGURES[c]}" for c in figures], *([f"kept array<{SIGNAL}>"] if signals else []), *(["gaps array<struct<rank: int, term: string, freq: long>>"] if gaps else [])]
    rows = packed_meeting(spine, side, tell, ", ".join(kinds))
    return rows.withColumn("gaps", F.when(F.size("gaps") > 0, F.col("gaps"))) if gaps else rows


def keyword_gaps(jds: DataFrame, docs: DataFrame, min_freq: int = 2, top_n: int = 10) -> DataFrame:
    """``jd_id, doc_id, rank, term, freq``: terms of a description that a résumé lacks, by frequency, then first occurrence."""
    rows = pairs(jds, docs, {}, min_freq, gaps=top_n, figures=())
    return rows.select("jd_id", "doc_id", F.explode("gaps").alias("g")).select("jd_id", "doc_id", "g.rank", "g.term", "g.freq")


def token_overlap(jds: DataFrame, docs: DataFrame) -> DataFrame:
    """``jd_id, doc_id, shared, jd_tokens``: distinct tokens that both have, for pairs that share any."""
    return pairs(jds, docs, {}, figures=("jd_tokens", "shared")).where("shared > 0").select("jd_id", "doc_id", "shared", "jd_tokens")


def match_scores(jds: DataFrame, docs: DataFrame, taxonomy: dict[str, list[str]] | None = None) -> DataFrame:
    """``jd_id, doc_id, overlap, category_mean, score`` of every pair."""
    return pairs(jds, docs, taxonomy, figures=("overlap", "category_mean", "score"))


def score_counts(jds: DataFrame, docs: DataFrame, taxonomy: dict[str, list[str]] | None = None) -> DataFrame:
    """``score, pairs``: how many of all pairs have each score.

    Pairs are counted where they are made; only the counts of each meeting of two packed rows are shuffled.
    """
    spine, side = _sides(jds, docs, vocab.taxonomy_rows(taxonomy))

    def tell(some: dict, block: dict, kept: dict) -> Iterator[pa.RecordBatch]:
        side = kept["side"] = kept.get("side") or _Side(block)
        for _, holds, _, met in side.steps(some):
            score, n = np.unique(side.scores(holds, side.coverage(met))[-1], return_counts=True)
            yield pa.RecordBatch.from_arrays([pa.array(score), pa.array(n.astype(np.int64))], ["score", "n"])

    return packed_meeting(spine, side, tell, "score int, n long").groupBy("score").agg(F.sum("n").alias("pairs"))


def best_descriptions(jds: DataFrame, docs: DataFrame, k: int = 3, taxonomy: dict[str, list[str]] | None = None) -> DataFrame:
    """``doc_id, rank, jd_id, score``: the ``k`` best descriptions of each document, the smaller id first among equals.

    Pairs are ranked where they are made; only ``k`` of a document are shuffled from a task.
    """
    w = Window.partitionBy("doc_id").orderBy(F.desc("score"), "jd_id")
    rows = pairs(jds, docs, taxonomy, figures=("score",)).withColumn("rank", F.row_number().over(w))
    return rows.where(F.col("rank") <= k).select("doc_id", "rank", "jd_id", "score")


def band(score: Column) -> Column:
    return F.when(score >= 80, "strong").when(score >= 60, "moderate").when(score >= 50, "weak").otherwise("decline")


def _told(words: list[tuple[int, str, int, str]]) -> Column:
    """``kept`` of :func:`pairs` with names: ``array<struct<rank, category, label, jd_keywords, frequency, coverage, priority, angles>>``, null if none."""
    word = F.create_map(*[F.lit(x) for c, _, k, w in words for x in (c * 1000 + k, w)])
    category = F.create_map(*[x for c, n in dict.fromkeys((c, n) for c, n, *_ in words) for x in (F.lit(c), F.struct(F.lit(n).alias("category"), X.title_label(F.lit(n)).alias("label"), F.array(*map(F.lit, vocab.ANGLES.get(n, []))).cast("array<string>").alias("angles")))])
    one = lambda x, i: X.let(F.element_at(category, x["cat_ord"]), lambda c: F.struct(
        (i + 1).alias("rank"), c["category"].alias("category"), c["label"].alias("label"), F.transform(x["asked"], lambda k: F.element_at(word, k)).alias("jd_keywords"),
        (-x["less"]).alias("frequency"), x["coverage"].alias("coverage"), F.when(x["low"], "medium").otherwise("high").alias("priority"), c["angles"].alias("angles"),
    ))
    return F.when(F.size("kept") > 0, F.transform("kept", one))


def pair_signals(jds: DataFrame, docs: DataFrame, top_n: int = 5, taxonomy: dict[str, list[str]] | None = None, named: bool = True) -> DataFrame:
    """``jd_id, doc_id, rank, category, label, jd_keywords, frequency, coverage, priority, angles`` of every pair's ``top_n`` signals; ``jd_keywords`` only where ``named``."""
    words = vocab.taxonomy_rows(taxonomy)
    spine, side = _keyword_sides(jds, docs, words)
    names = ["jd_id", "doc_id", "rank", "cat_ord", "frequency", "coverage", "medium", *(["asked"] if named else [])]

    def tell(some: dict, block: dict, kept: dict) -> Iterator[pa.RecordBatch]:
        side = kept["side"] = kept.get("side") or _Side(block)
        for ids, _, _, met in side.steps(some):
            cents = side.coverage(met)
            pair, entry, medium, rank = side.signals(cents, top_n)
            doc, e = pair // side.n, pa.array(entry)
            made = [block["jd_id"].take(pa.array(pair % side.n)), ids.take(pa.array(doc)), pa.array(rank.astype(np.int32)), side.cat.take(e), pa.array(side.frequency[entry]), pa.array(cents[doc, entry] / 100), pa.array(medium)]
            yield pa.RecordBatch.from_arrays([*made, side.asked.take(e)] if named else made, names)

    rows = packed_meeting(spine, side, tell, f"{_ids(jds, docs)}, rank int, cat_ord int, frequency long, coverage double, medium boolean" + ", asked array<int>" * named)
    known = dict.fromkeys((c, n) for c, n, *_ in words)
    table = F.create_map(*[x for c, n in known for x in (F.lit(c), F.struct(F.lit(n).alias("category"), X.title_label(F.lit(n)).alias("label"), F.array(*map(F.lit, vocab.ANGLES.get(n, []))).cast("array<string>").alias("angles")))])
    told = lambda name: F.element_at(table, F.col("cat_ord"))[name].alias(name)
    word = F.create_map(*[F.lit(x) for c, _, k, w in words for x in (c * 1000 + k, w)])
    asked = [F.transform("asked", lambda k: F.element_at(word, k)).alias("jd_keywords")] if named else []
    return rows.select("jd_id", "doc_id", "rank", told("category"), told("label"), *asked, "frequency", "coverage", F.when(F.col("medium"), "medium").otherwise("high").alias("priority"), told("angles"))


def _advised(rows: DataFrame) -> DataFrame:
    """``advice`` of pairs, from their score and the categories of their signals."""
    ords = {name: c for c, name in enumerate(vocab.TAXONOMY)}
    holds = lambda name: F.exists("kept", lambda x: x["cat_ord"] == ords[name])
    given = F.filter(F.array(F.when(F.col("score") < 50, vocab.ADVICE["critical"]), F.when(holds("testing_ci_cd"), vocab.ADVICE["testing"]), F.when(holds("data_quality_observability"), vocab.ADVICE["quality"])), lambda a: a.isNotNull())
    return rows.withColumn("advice", X.let(given, lambda g: F.when(F.size(g) == 0, F.array(F.lit(vocab.ADVICE["good"]))).otherwise(g)))


def recommendations(jds: DataFrame, docs: DataFrame, top_n: int = 5) -> DataFrame:
    """``jd_id, doc_id, score, advice array<string>`` of every pair; depends on the ``top_n`` signals."""
    return _advised(pairs(jds, docs, signals=top_n, figures=("score",))).select("jd_id", "doc_id", "score", "advice")


def full_report(jds: DataFrame, docs: DataFrame, top_n: int = 5) -> DataFrame:
    """One nested row per pair: score, recommendations, signals and keyword gaps, all of one row of the pair."""
    rows = _advised(pairs(jds, docs, signals=top_n, gaps=10, figures=("score",)))
    return rows.select("jd_id", "doc_id", "score", "advice", _told(vocab.taxonomy_rows()).alias("signals"), "gaps")
