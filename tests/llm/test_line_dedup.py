"""Line dedup against a plain version, and the store through inserts and deletions."""

import hashlib
import random
from collections import Counter

import pytest

from folioflow.llm import line_dedup as L

SPACE = " \t\n\v\f\r"
LOWER = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def key(line):
    return line.strip(SPACE).translate(LOWER)


def common(texts, least):
    return {k for k, n in Counter(k for t in texts for k in {key(x) for x in (t or "").split("\n")} if k).items() if n >= least}


def plain(rows, stored, least):
    bad, out = common([t for _, t in stored], least), []
    for doc_id, text in rows:
        parts = (text or "").split("\n")
        kept = [x for x in parts if key(x) not in bad]
        out.append((doc_id, len(parts), len(parts) - len(kept), "\n".join(kept)))
    return sorted(out, key=repr)


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(df):
    return sorted(((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in df.collect()), key=repr)


ODD = [
    (1, None), (2, ""), (3, "\n"), (4, "a\n\nb"), (5, " A \n\tB\r\nc\n"), (None, "a\nx"), (None, "a\nx"), (6, "a\na\na"), (7, "É\né "), (8, "é\nÉ"), (9, "\x1ca\n a"), (9, "\x1ca\n a"),
    (10, "long " * 20000 + "\na"), (11, "a"),
]


@pytest.fixture
def store(spark, tmp_path):
    return lambda least=3, shards=3: L.LineStore(spark, str(tmp_path / "lines"), shards, least)


def test_contract_on_odd_texts(spark, store):
    s = store()
    s.insert(frame(spark, ODD))
    assert found(s.dedup(frame(spark, ODD))) == plain(ODD, ODD, 3)


def random_rows(seed, n, start=0):
    rng = random.Random(seed)
    stock = ["alpha", " Alpha ", "beta", "BETA", "gamma delta", "", "  ", "ö", "Ö", "common\r", *[f"w{i}" for i in range(300)]]
    weights = [20] * 10 + [1] * 300
    return [(start + i, "\n".join(rng.choices(stock, weights, k=rng.randint(0, 12)))) for i in range(n)]


def test_insert_and_delete_are_exact_and_reversible(spark, store, monkeypatch):
    monkeypatch.setattr(L, "CELL_KEYS", 50)
    monkeypatch.setattr(L, "HELD_KEYS", 20)
    first, second = random_rows(1, 120), random_rows(2, 90, 1000)
    s = store(least=5)
    s.insert(frame(spark, first).repartition(3))
    before = found(s.dedup(frame(spark, second)))
    assert before == plain(second, first, 5)
    s.insert(frame(spark, second))
    assert found(s.dedup(frame(spark, first))) == plain(first, first + second, 5)
    s.delete(frame(spark, second))
    assert found(s.dedup(frame(spark, second))) == before
    s.delete(frame(spark, first))
    assert s.table("refs").count() == 0 and s.table("docs").count() == 0
    assert found(s.dedup(frame(spark, first))) == plain(first, [], 5)


def test_only_what_is_held_is_deleted(spark, store):
    rows = [(1, "a\nb"), (1, "a\nb"), (2, "a")]
    s = store(least=2)
    s.insert(frame(spark, rows))
    s.delete(frame(spark, [(9, "a\nb"), (2, "b"), (1, "a\nb")]))
    held = dict(s.table("refs").select("key", "refs").collect())
    assert {bytes(k): n for k, n in held.items()} == {L.line_key(b"a"): 2, L.line_key(b"b"): 1}
    s.delete(frame(spark, [(1, "a\nb")] * 5))
    assert [r.refs for r in s.table("refs").collect()] == [1]


def test_a_generation_without_its_mark_does_not_count(spark, store, tmp_path):
    s = store(least=1)
    s.insert(frame(spark, [(1, "a")]))
    (tmp_path / "lines" / "gen=2" / "refs").mkdir(parents=True)
    assert s.generation() == 1
    s.insert(frame(spark, [(2, "b")]))
    assert s.generation() == 2 and s.table("refs").count() == 2


def test_empty_table_and_further_columns(spark, store):
    s = store()
    assert found(s.dedup(frame(spark, [(1, "a")]))) == [(1, 1, 0, "a")]
    s.insert(frame(spark, []))
    assert found(s.dedup(frame(spark, []))) == []
    odd = spark.createDataFrame([(1, "a", "x", 3)], "doc_id long, text string, keys string, rk int")
    s.insert(odd)
    assert found(s.dedup(odd)) == [(1, 1, 0, "a")]


def test_cuckoo_filter():
    keys = [hashlib.sha256(str(i).encode()).digest()[:16] for i in range(6000)]
    f = L.CuckooFilter.of_keys(keys[:3000])
    assert f.contains(keys[:3000]).all()
    assert f.contains(keys[3000:]).mean() < 0.01
    for k in keys[:1500]:
        assert f.delete(k)
    f = L.CuckooFilter.frombytes(f.tobytes())
    assert f.contains(keys[1500:3000]).all() and f.contains(keys[:1500]).mean() < 0.01
    grown = L.moved(f, keys[3000:], keys[1500:1600], keys[1600:])
    assert grown.contains(keys[1600:]).all() and grown.contains(keys[:1600]).mean() < 0.01
    same = L.CuckooFilter.of_keys(keys[:1] * 20)
    assert same.contains(keys[:1]).all()
