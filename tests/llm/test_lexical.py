"""Ranked search against a plain version."""

import math
import random
import re
from collections import Counter

import numpy as np

from folioflow.llm import lexical

PATTERN = re.compile("[^\x00-\x2f\x3a-\x40\x5b-\x60\x7b-\x7f]+")
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def terms(text):
    return PATTERN.findall((text or "").translate(LOWER))


def plain(docs, items, top=10):
    read = [(d, Counter(terms(t))) for d, t in docs]
    read = [(d, c, sum(c.values())) for d, c in read if c]
    n_docs, length = len(read), sum(n for *_, n in read)
    df = Counter(t for _, c, _ in read for t in c)
    out = []
    for item_id, text in items:
        scored = []
        for d, c, n in read:
            m = 25 + (75 * n * n_docs) // length
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((10**9 * c[t]) // (1000 * c[t] + 8 * m)) for t in terms(text) if t in c)
            if s > 0:
                scored.append((-s, d is None, d or 0))
        out += [(item_id, k + 1, None if null else d, -s) for k, (s, null, d) in enumerate(sorted(scored)[:top])]
    return sorted(out, key=repr)


def frames(spark, docs, items, parts=3):
    return spark.createDataFrame(docs, "doc_id long, text string").repartition(parts), spark.createDataFrame(items, "item_id long, text string")


def found(df):
    return sorted(map(tuple, df.select("item_id", "rank", "doc_id", "score").collect()), key=repr)


def some(seed, n, words=40, ids=10**6):
    rng = random.Random(seed)
    stock = [f"{c}{i}" for c in ("w", "W", "é", "É", "日本", "x_") for i in range(words)]
    seps = [" ", ", ", "\n", "-", "'", " ", "\x7f"]
    return [(rng.randint(-5, ids), "".join(rng.choice(stock) + rng.choice(seps) for _ in range(rng.randint(0, 50)))) for _ in range(n)]


def test_contract_on_random_texts(spark, monkeypatch):
    docs, items = some(1, 300), some(2, 40)
    docs += [(None, docs[0][1]), (7, docs[0][1]), (7, docs[0][1]), (3, None), (4, ""), (5, "-- ,"), (6, "w1 " * 5000)]
    items += [(1, None), (2, "?"), (3, "w1 w1 W1 x_3"), (3, "unheard of"), (None, "w2")]
    want = plain(docs, items)
    assert found(lexical.ranked(*frames(spark, docs, items))) == want
    monkeypatch.setattr(lexical, "BLOCK_BYTES", 700)
    monkeypatch.setattr(lexical, "RUN_MATCHES", 30)
    monkeypatch.setattr(lexical, "CACHE_TERMS", 10)
    assert found(lexical.ranked(*frames(spark, docs, items[:25]))) == plain(docs, items[:25])


def test_ties_go_to_the_smaller_id_and_repeated_rows_stay(spark):
    docs = [(d, "same text") for d in (9, 4, 4, 11, 2, 30, 31, 32, 33, 34, 35, 1, None)] + [(100, "other")] * 20
    assert found(lexical.ranked(*frames(spark, docs, [(1, "same")]))) == plain(docs, [(1, "same")])


def test_many_items_need_more_than_one_digit(spark):
    docs, items = some(3, 20), [(i, f"w{i % 40} é{i % 7}") for i in range(9000)]
    assert found(lexical.ranked(*frames(spark, docs, items, 1))) == plain(docs, items)


def test_empty_tables_and_further_columns(spark):
    docs, items = frames(spark, [], [(1, "a")])
    assert found(lexical.ranked(docs, items)) == []
    docs, items = frames(spark, [(1, "a")], [])
    assert found(lexical.ranked(docs, items)) == []
    docs = spark.createDataFrame([(1, "a b", 3, "x")], "doc_id long, text string, n int, terms string")
    items = spark.createDataFrame([(1, "a", 3)], "item_id long, text string, item int")
    assert found(lexical.ranked(docs, items)) == plain([(1, "a b")], [(1, "a")])


def test_radix_order():
    rng = np.random.default_rng(1)
    for top in (1, 1 << 10, 1 << 20, 1 << 40):
        keys = rng.integers(0, top, 5000)
        assert (lexical.radix_order(keys) == np.argsort(keys, kind="stable")).all()
    assert len(lexical.radix_order(np.zeros(0, np.int64))) == 0
