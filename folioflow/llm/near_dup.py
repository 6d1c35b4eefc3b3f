r"""Near-duplicate documents by BagMinHash.

*Bag.* A text is the multiset of its five-word shingles (lower-case ``\w+``
words; a text without such words is read as its blank-separated parts; one with
fewer than five words has one shingle of them all).

*Signature.* For a shingle x with count w, the weight axis [0, w) is cut into the
dyadic intervals [0,1), [1,2), [2,4), ... Each (x, interval) owns a Poisson
process of points (time, position, component) with its interval's length as
rate, the same in every document; a document keeps the points whose position is
below its own w (the last interval is thinned). Component j of the signature is
the first time over all kept points, so two documents agree on it with
probability sum(min w) / sum(max w): the weighted Jaccard similarity, unbiased.
Points come in order of time, and a process is left as soon as its next point is
later than the latest component, so the work is about words + m log m.

*Candidates.* ``BANDS`` bands of ``ROWS`` components. Texts of equal bags are one
node from the start. In each bucket the leader is the node that meets the most
others in all its buckets: near copies of one text meet their least edited
member most. The others are verified against it, and verified pairs are linked.

*What is left of a bucket.* A pair x, y of a bucket in different components is
similar only if their difference is at most (size x + size y) / 9. Seen from the
leader c the difference is at least

    |in(x) - in(y)| + own(x) + own(y) + |out(x) - out(y)|

where ``in`` is the mass on shingles of c, ``own`` the mass on shingles that no
other node verified against c has, ``out`` the rest. These are a few numbers a
node. As two nodes may lack different shingles of c, each side is also bounded by its
cells: shingles are dealt to cells by hash, and where one node's mass in a cell is odd and the other's
even, they differ there by one at least. So most pairs are proven apart without a look at their texts. Members outside
the leader's component ask the remaining ones of other components: first those
of a hash-chosen few, then 256 times as many a round, until all are asked or the
asker is linked. Components only grow, so in the end no pair of a bucket is left
that is neither tested, nor proven apart, nor inside one component.

*Verification.* The exact overlap sum(min) / sum(max) of both bags, ``SIMILARITY``
or more. Askers' texts go out once for each ``CHUNK`` of their partners. Classes
are the connected components of verified pairs.

Defined cases: null and empty texts have the empty bag and are copies of each
other; very long texts are read whole; repeated rows are copies, each has its
row in the result; rows without doc_id take part; an empty table gives an empty
result; the class id is the least doc_id of the class.
"""

from __future__ import annotations

import hashlib
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import discard, doc_texts, free_name, materialise, read_table, spread_by, whole_text
from .components import components, joined_roots

SHINGLE = 5
SIMILARITY = 0.8
#: Similar pairs differ by at most this part of the sum of their sizes: (1 - 0.8) / (1 + 0.8).
DIFFERENCE = (1, 9)
#: A pair at 0.8 shares no band with probability (1 - 0.8**5)**25 = 5e-5.
BANDS, ROWS = 25, 5
SIZE = BANDS * ROWS

WORD = re.compile(r"\w+")
_U = np.uint64
_GOLD, _M1, _M2, _ODD = _U(0x9E3779B97F4A7C15), _U(0xBF58476D1CE4E5B9), _U(0x94D049BB133111EB), _U(0xD6E8FEB86659FD93)


#: Odd multipliers of the places in a shingle.
_POWERS = [_U(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64)) for i in range(SHINGLE)]


def mix64(x: np.ndarray) -> np.ndarray:
    x = (x + _GOLD).astype(_U)
    x = (x ^ (x >> _U(30))) * _M1
    x = (x ^ (x >> _U(27))) * _M2
    return x ^ (x >> _U(31))


def unit(x: np.ndarray) -> np.ndarray:
    """Uniform in (0, 1] from 64 random bits."""
    return ((x >> _U(11)).astype(np.float64) + 1.0) * 2.0**-53


class Words:
    """64-bit hash of a word, kept for words seen before."""

    def __init__(self) -> None:
        self.known: dict[str, int] = {}

    def __call__(self, word: str) -> int:
        h = self.known.get(word)
        if h is None:
            if len(self.known) > 400_000:
                self.known.clear()
            h = self.known[word] = xxhash.xxh64_intdigest(word)
        return h


def bag(text: str, words: Words) -> tuple[np.ndarray, np.ndarray]:
    """(ascending shingle hashes, counts)."""
    found = WORD.findall(text.lower()) or text.split()
    if not found:
        return np.zeros(0, _U), np.zeros(0, np.int64)
    h = np.fromiter(map(words, found), _U, len(found))
    k = min(SHINGLE, len(h))
    n = len(h) - k + 1
    out = h[:n] * _POWERS[0]
    for i in range(1, k):
        out += h[i : i + n] * _POWERS[i]
    return np.unique(mix64(out + _U(k)), return_counts=True)


def bag_key(hashes: np.ndarray, counts: np.ndarray) -> bytes:
    return hashlib.blake2b(hashes.tobytes() + counts.astype(np.int64).tobytes(), digest_size=16).digest()


def signatures(bags: list[tuple[np.ndarray, np.ndarray]], size: int = SIZE) -> np.ndarray:
    """First times of the components, one row per bag; infinite for the empty bag.

    Many bags go through the processes side by side: each point is a lane, and
    lanes whose next point comes too late for their document leave.
    """
    best = np.full(len(bags) * size, np.inf)
    if not bags or not any(len(h) for h, _ in bags):
        return best.reshape(len(bags), size)
    hashes, counts = np.concatenate([h for h, _ in bags]), np.concatenate([c for _, c in bags])
    owner = np.repeat(np.arange(len(bags)), [len(h) for h, _ in bags])
    seeds, owners, lows, tops = [hashes], [owner], [np.zeros(len(hashes))], [counts]
    low, more = 1, np.flatnonzero(counts > 1)
    while len(more):
        seeds.append(mix64(hashes[more] ^ mix64(np.full(len(more), low, _U))))
        owners.append(owner[more])
        lows.append(np.full(len(more), float(low)))
        tops.append(counts[more])
        low *= 2
        more = more[counts[more] > low]
    state, owner, base, top = map(np.concatenate, (seeds, owners, lows, tops))
    span = np.maximum(base, 1.0)
    thin = top < base + span
    rate, t = span * size, np.zeros(len(state))
    while len(state):
        state = mix64(state)
        t = t - np.log(unit(state)) / rate
        other = mix64(state ^ _ODD)
        cell = owner * size + (other % _U(size)).astype(np.int64)
        if thin.any():
            k = np.flatnonzero(thin)
            late = base[k] + span[k] * unit(mix64(other[k])) > top[k]
            kept = np.ones(len(state), bool)
            kept[k[late]] = False
            np.minimum.at(best, cell[kept], t[kept])
        else:
            np.minimum.at(best, cell, t)
        on = t < best.reshape(-1, size).max(axis=1)[owner]
        state, t, rate, owner, base, span, top, thin = (x[on] for x in (state, t, rate, owner, base, span, top, thin))
    return best.reshape(len(bags), size)


def signature(hashes: np.ndarray, counts: np.ndarray, size: int = SIZE) -> np.ndarray:
    return signatures([(hashes, counts)], size)[0]


def band_keys(sig: np.ndarray) -> np.ndarray:
    """One 64-bit key per band; the band's number is part of it."""
    bits = sig.view(_U).reshape(BANDS, ROWS)
    out = mix64(np.arange(BANDS, dtype=_U))
    for r in range(ROWS):
        out = mix64(out * _ODD + bits[:, r])
    return out.view(np.int64)


def overlap(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> float:
    """Exact multiset similarity sum(min) / sum(max); two empty bags are equal."""
    total = int(a[1].sum() + b[1].sum())
    if not total:
        return 1.0
    hit, at = _meeting(a, b)
    shared = int(np.minimum(a[1][hit], b[1][at[hit]]).sum())
    return shared / (total - shared)


def _meeting(a: tuple[np.ndarray, np.ndarray], b: tuple[np.ndarray, np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Which shingles of ``a`` are in ``b``, and where."""
    if not len(b[0]):
        return np.zeros(len(a[0]), bool), np.zeros(len(a[0]), np.int64)
    at = np.searchsorted(b[0], a[0])
    at[at == len(b[0])] = 0
    return b[0][at] == a[0], at


#: Shingles whose processes run side by side.
LANES = 1 << 16
#: Partners for which a text is sent once.
CHUNK = 256
#: Cells by the hash of a shingle, a bit each: whether the mass in it is odd. Bits that differ are mass that differs.
CELLS = 512
#: Partners asked in the first round, and how many times as many in each that follows.
FIRST_ASKS, MORE_ASKS = 16, 256


def with_bands(rows: DataFrame) -> DataFrame:
    """``doc_id, thash, text`` -> ``doc_id, thash, bag, bands``; one narrow pass."""
    fields = "doc_id long, thash long, bag binary, bands array<long>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = Words()

        def keys(bags: list) -> list:
            return [band_keys(s) if len(h) else np.zeros(0, np.int64) for s, (h, _) in zip(signatures(bags), bags, strict=True)]

        for b in batches:
            names, made, held, lanes = [], [], [], 0
            for t in b.column(2).to_pylist():
                h, c = bag(t, words)
                names.append(bag_key(h, c))
                held.append((h, c))
                lanes += len(h)
                if lanes > LANES:
                    made += keys(held)
                    held, lanes = [], 0
            made += keys(held)
            yield pa.RecordBatch.from_arrays([b.column(0), b.column(1), pa.array(names, pa.binary()), pa.array(made, pa.list_(pa.int64()))], ["doc_id", "thash", "bag", "bands"])

    return rows.select("doc_id", "thash", "text").mapInArrow(run, fields)


VERIFIED = "a long, b long, linked boolean, size_a long, size_b long, inside long, rest array<long>, weight array<long>, odd array<long>"


def _odd_cells(hashes: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The cells of odd mass, 64 to a number."""
    odd = np.bincount((hashes[counts % 2 == 1] % _U(CELLS)).astype(np.int64), minlength=CELLS) % 2
    return np.packbits(odd.astype(bool)).view(np.int64)


def _verified(pairs: DataFrame, texts: DataFrame, rest: bool = False) -> DataFrame:
    """``a, b, linked, size_a, size_b`` of the written ``pairs`` by their texts (``node, text``).

    With ``rest`` also ``inside``, the mass of b on shingles of a, the
    shingles of b outside a with their counts, and ``odd``, the cells of odd mass inside and outside a.
    """
    parts = pairs.groupBy("a").agg(F.ceil(F.count("*") / CHUNK).alias("parts"))
    dealt = pairs.join(parts, "a").select("a", "b", F.pmod(F.xxhash64("b"), "parts").alias("part"))
    second = dealt.join(texts.withColumnRenamed("node", "b"), "b").select("a", "part", "b", "text")
    first = dealt.select("a", "part").distinct().join(texts.withColumnRenamed("node", "a"), "a").select("a", "part", F.lit(None).cast("long").alias("b"), "text")
    dealt = second.unionByName(first).repartition("a", "part").sortWithinPartitions("a", "part", F.col("b").asc_nulls_first())
    names = [c.split()[0] for c in VERIFIED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.bool_(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.int64())]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, held, size = Words(), None, 0
        for batch in batches:
            made: list[tuple] = []
            for a, b, text in zip(*(batch.column(i).to_pylist() for i in (0, 2, 3)), strict=True):
                this = bag(text, words)
                if b is None:  # the partners of a follow
                    held, size = this, int(this[1].sum())
                    continue
                linked = overlap(held, this) >= SIMILARITY
                more = (None, None, None, None)
                if rest:
                    inside, _ = _meeting(this, held)
                    odd = [_odd_cells(this[0][x], this[1][x]) for x in (inside, ~inside)]
                    more = int(this[1][inside].sum()), this[0][~inside].view(np.int64), this[1][~inside], np.concatenate(odd)
                made.append((a, b, linked, size, int(this[1].sum()), *more))
            columns = zip(*made, strict=True) if made else [[]] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names)

    return dealt.mapInArrow(run, VERIFIED)


def _led_buckets(nodes: DataFrame) -> DataFrame:
    """``key, node, m, lead``: the nodes of each bucket of two or more, its size and its leader: that of the most meetings, the greatest of equals, so buckets with the same members share one."""
    keyed = nodes.select("node", F.explode("bands").alias("key"))
    shared = spread_by(keyed, "key", F.count("*").alias("m")).where("m > 1")
    buckets = materialise(keyed.join(shared, "key"), "buckets")
    meetings = buckets.groupBy("node").agg(F.sum(F.col("m") - 1).alias("meetings"))
    leads = spread_by(buckets.join(meetings, "node"), "key", F.max_by("node", F.struct("meetings", "node")).alias("lead"))
    led = materialise(buckets.join(leads, "key"), "led")
    discard(buckets)
    return led


def _with_root(rows: DataFrame, roots: DataFrame, node: str, name: str) -> DataFrame:
    known = roots.select(F.col("node").alias(node), F.col("root").alias("_root"))
    return rows.join(known, node, "left").withColumn(name, F.coalesce("_root", node)).drop("_root")


def _open_buckets(led: DataFrame, roots: DataFrame, first: DataFrame) -> DataFrame:
    """The buckets of more than one component: ``key, node, spot, size, inside, own, outside, odd, lead``.

    ``spot`` is a hash-chosen place of the node among the members of its bucket. The leader itself, which all have met, has no ``odd``.
    """
    rooted = _with_root(led, roots, "node", "root")
    several = spread_by(rooted, "key", F.min("root").alias("x"), F.max("root").alias("y")).where("x <> y").select("key")
    rows = led.join(several, "key")
    leads = rows.select(F.col("lead").alias("a")).distinct()
    seen = first.join(leads, "a")
    strange = seen.select("a", "b", F.explode(F.arrays_zip("rest", "weight")).alias("x")).select("a", "b", F.col("x.rest").alias("h"), F.col("x.weight").alias("w"))
    alone = strange.groupBy("a", "h").agg(F.count("*").alias("n"), F.max("b").alias("b"), F.sum("w").alias("w")).where("n = 1")
    own = alone.groupBy("a", "b").agg(F.sum("w").alias("own"))
    marks = seen.join(own, ["a", "b"], "left").select("a", "b", F.col("size_b").alias("size"), "inside", F.coalesce("own", F.lit(0)).alias("own"), "odd")
    marks = marks.unionByName(seen.groupBy("a").agg(F.max("size_a").alias("size")).select("a", F.col("a").alias("b"), "size", F.col("size").alias("inside"), F.lit(0).alias("own"), F.lit(None).cast("array<long>").alias("odd")))
    marks = marks.select(F.col("a").alias("lead"), F.col("b").alias("node"), "size", "inside", "own", "odd", (F.col("size") - F.col("inside") - F.col("own")).alias("outside"))
    spot = F.floor(F.pmod(F.xxhash64("node"), F.lit(1 << 20)) * F.col("m") / (1 << 20))
    return rows.join(marks, ["lead", "node"]).select("key", "node", "lead", spot.alias("spot"), "size", "inside", "own", "outside", "odd")


def _asked_pairs(rows: DataFrame, roots: DataFrame, low: int, high: int) -> DataFrame:
    """``a, b``: members outside the leader's component with those of other components at spots ``low`` to ``high`` that are not proven apart."""
    one, nine = DIFFERENCE
    slack = one * F.col("size") - nine * F.col("own")
    at = _with_root(_with_root(rows, roots, "node", "root"), roots, "lead", "main").select("key", "node", "root", "main", "spot", "size", "inside", "own", "outside", "odd", slack.alias("slack"))
    # no member of the bucket is near enough to an asker outside these bounds
    ends = spread_by(at, "key", F.max(F.col("slack") + nine * F.col("inside")).alias("top"), F.max(F.col("slack") - nine * F.col("inside")).alias("bottom"))
    asks = at.where("root <> main").join(ends, "key").where((F.col("top") >= nine * F.col("inside") - F.col("slack")) & (F.col("bottom") >= -nine * F.col("inside") - F.col("slack")))
    asks = asks.select("key", *[F.col(c).alias(f"{c}_x") for c in ("node", "root", "size", "inside", "own", "outside", "odd")])
    told = at.where(F.col("odd").isNotNull() & (F.col("spot") >= low) & (F.col("spot") < high))
    within = one * (F.col("size") + F.col("size_x"))
    mass = F.abs(F.col("inside") - F.col("inside_x")), F.abs(F.col("outside") - F.col("outside_x")) + F.col("own") + F.col("own_x")
    unlike = [F.bit_count(F.get("odd", F.lit(i)).bitwiseXOR(F.get("odd_x", F.lit(i)))) for i in range(CELLS // 32)]
    cells = sum(unlike[: CELLS // 64], F.lit(0)), sum(unlike[CELLS // 64 :], F.lit(0))
    near = (F.col("root") != F.col("root_x")) & (nine * (mass[0] + mass[1]) <= within) & (nine * (F.greatest(mass[0], cells[0]) + F.greatest(mass[1], cells[1])) <= within)
    return asks.join(told, (asks["key"] == told["key"]) & near).select(F.least("node", "node_x").alias("a"), F.greatest("node", "node_x").alias("b")).distinct()


def _links(tested: DataFrame, roots: DataFrame | None = None) -> DataFrame:
    """``u, v``: linked pairs, or the components they join."""
    links = tested.where("linked").select(F.col("a").alias("u"), F.col("b").alias("v"))
    if roots is None:
        return links
    return _with_root(_with_root(links, roots, "u", "p"), roots, "v", "q").where("p <> q").select(F.col("p").alias("u"), F.col("q").alias("v"))


def near_classes(docs: DataFrame) -> DataFrame:
    """``doc_id, thash, class_key``: one row per row of ``docs``; equal class keys are one near-duplicate class."""
    rows = doc_texts(docs).withColumn("thash", F.xxhash64("text"))
    bagged = materialise(with_bands(rows), "bags")
    nodes = bagged.groupBy("bag").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash", "bands")).alias("x"))
    nodes = materialise(nodes.select(F.monotonically_increasing_id().alias("node"), "bag", "x.doc_id", "x.thash", "x.bands"), "nodes")
    led = _led_buckets(nodes)
    # the text of each node in a bucket, by its representative row
    reps = nodes.select("node", F.col("doc_id").alias("rep_id"), F.col("thash").alias("rep_hash")).join(led.select("node").distinct(), "node")
    same = rows["doc_id"].eqNullSafe(reps["rep_id"]) & (rows["thash"] == reps["rep_hash"])
    texts = materialise(rows.join(reps, same).groupBy("node").agg(F.min("text").alias("text")), "texts")
    pairs = materialise(led.where("lead <> node").select(F.col("lead").alias("a"), F.col("node").alias("b")).distinct(), "pairs")
    first = materialise(_verified(pairs, texts, rest=True), "first")
    discard(pairs)
    roots = components(_links(first))
    rows = materialise(_open_buckets(led, roots, first), "open")
    tested = [materialise(first.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")), "tested")]
    last = rows.agg(F.max("spot")).first()[0]
    discard(first)
    discard(led)
    low, high = 0, FIRST_ASKS
    while last is not None and low <= last:
        pairs = _asked_pairs(rows, roots, low, high)
        for done in tested:
            pairs = pairs.join(done, ["a", "b"], "left_anti")
        pairs = materialise(pairs, "pairs")
        low, high = high, high * MORE_ASKS
        if pairs.isEmpty():
            discard(pairs)
            continue
        tested.append(pairs)
        more = materialise(_links(_verified(pairs, texts), roots), "more")
        if not more.isEmpty():
            found = joined_roots(roots, components(more))
            discard(roots)
            roots = found
        discard(more)
    for used in (rows, texts, *tested):
        discard(used)
    slim = nodes.select("bag", "node")
    classes = bagged.select("doc_id", "thash", "bag").join(slim, "bag")
    return _with_root(classes, roots, "node", "class_key").select("doc_id", "thash", "class_key")


def near_duplicates(docs: DataFrame) -> DataFrame:
    """``doc_id, class_id, class_size`` of every row."""
    rows = materialise(near_classes(docs), "classes")
    classes = spread_by(rows, "class_key", F.min("doc_id").alias("class_id"), F.count("*").alias("class_size"))
    return rows.join(classes, "class_key").select("doc_id", "class_id", "class_size")


def one_of_each(docs: DataFrame) -> DataFrame:
    """The documents with one row of each class: that of the least doc_id; of rows that repeat it, one."""
    rows = near_classes(docs)
    keep = rows.groupBy("class_key").agg(F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "thash")).alias("x"))
    keep = keep.select(F.col("x.doc_id").alias("keep_id"), F.col("x.thash").alias("keep_hash"))
    own, turn = free_name(docs, "near_hash"), free_name(docs, "near_turn")
    hashed = docs.withColumn(own, F.xxhash64(whole_text()))
    kept = hashed.join(keep, F.col("doc_id").cast("long").eqNullSafe(F.col("keep_id")) & (F.col(own) == F.col("keep_hash")), "left_semi")
    order = Window.partitionBy(F.col("doc_id").cast("long"), own).orderBy(F.col("text"))
    return kept.withColumn(turn, F.row_number().over(order)).where(F.col(turn) == 1).select(*[F.col(f"`{c}`") for c in docs.columns])


def op7_near_duplicates(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(read_table(spark, sf_dir, "documents"))


#: All pairs by exact multiset overlap, then the transitive closure of links: what the operator finds without looking at all pairs.
ORACLE = r"""WITH RECURSIVE w AS (SELECT doc_id, CASE WHEN len(a) > 0 THEN a ELSE list_filter(string_split_regex(coalesce(text, ''), '\s+'), lambda x: x <> '') END AS ws
    FROM (SELECT doc_id, text, regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]+') AS a FROM documents)),
  s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 5 THEN [array_to_string(ws, ' ')] ELSE list_transform(range(1, len(ws) - 3), lambda i: array_to_string(ws[i:i + 4], ' ')) END AS x FROM w),
  g AS (SELECT doc_id, sh, count(*) AS n FROM (SELECT doc_id, unnest(x) AS sh FROM s) GROUP BY ALL),
  z AS (SELECT doc_id, sum(n) AS t FROM g GROUP BY doc_id),
  p AS (SELECT a.doc_id AS x, b.doc_id AS y, sum(least(a.n, b.n)) AS m FROM g a JOIN g b ON a.sh = b.sh AND a.doc_id < b.doc_id GROUP BY ALL),
  e AS (SELECT x, y FROM p JOIN z zx ON zx.doc_id = x JOIN z zy ON zy.doc_id = y WHERE CAST(m AS DOUBLE) / CAST(zx.t + zy.t - m AS DOUBLE) >= 0.8
    UNION ALL SELECT min(doc_id) OVER (), doc_id FROM s WHERE len(x) = 0),
  l AS (SELECT x, y FROM e UNION SELECT y, x FROM e),
  r AS (SELECT x, y FROM l UNION SELECT r.x, l.y FROM r JOIN l ON r.y = l.x),
  c AS (SELECT doc_id, least(doc_id, coalesce((SELECT min(y) FROM r WHERE r.x = doc_id), doc_id)) AS class_id FROM documents)
SELECT doc_id, class_id, count(*) OVER (PARTITION BY class_id) AS class_size FROM c"""
