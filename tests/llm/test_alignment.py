"""Token alignment against a plain version that reads whole texts with the reference libraries."""

import hashlib
import random
from collections import Counter

import numpy as np
import pytest

from folioflow.llm import alignment
from folioflow.llm.tokens import model_path


@pytest.fixture(scope="module")
def libraries():
    import sentencepiece
    from tokenizers import Tokenizer

    a = Tokenizer.from_file(model_path("byte_bpe_50k.json"))
    a.encode_special_tokens = True
    b = sentencepiece.SentencePieceProcessor(model_file=model_path())
    return a, b, alignment.tokenizer_a(model_path("byte_bpe_50k.json"))[1], alignment.tokenizer_b(model_path())[2]


def plain(rows, libraries):
    """What the contract asks for, row by row, on whole texts."""
    a, b, bytes_a, bytes_b = libraries
    read, seen = [], Counter()
    for doc_id, text in rows:
        text = text or ""
        whole = (" " + text).encode()
        x = a.encode(" " + text, add_special_tokens=False).ids if text else []
        y = b.encode(text) if text else []
        if b"".join(bytes_a[i] for i in x) != whole or b"".join(bytes_b[i] for i in y) != whole:
            x, y = [], []
        groups, i, j, end_a, end_b = [([], [])], 0, 0, 0, 0
        while i < len(x) or j < len(y):
            if end_a <= end_b and i < len(x):
                groups[-1][0].append(x[i])
                end_a += len(bytes_a[x[i]])
                i += 1
            else:
                groups[-1][1].append(y[j])
                end_b += len(bytes_b[y[j]])
                j += 1
            if end_a == end_b:
                groups.append(([], []))
        groups.pop()
        pairs = Counter((p, q) for g in groups for p in g[0] for q in g[1])
        seen.update(pairs.keys())
        read.append((doc_id, len(x), len(y), groups, pairs))
    best = {}
    for (p, _), n in seen.items():
        best[p] = max(best.get(p, 0), n)
    out = []
    for doc_id, n_a, n_b, groups, pairs in read:
        printed = ";".join(",".join(map(str, p)) + "|" + ",".join(map(str, q)) for p, q in groups)
        out.append((
            doc_id, n_a, n_b, len(groups), sum(pairs.values()),
            sum(n for k, n in pairs.items() if seen[k] == best[k[0]]), sum(n * seen[k] for k, n in pairs.items()),
            hashlib.sha256(printed.encode()).hexdigest() if groups else "",
        ))
    return sorted(out, key=repr)


ODD = [
    (1, None), (2, ""), (3, " "), (4, "\n"), (5, "a"), (None, "no id"), (6, "a  b\n\n c\t d\n \n e"), (6, "the same id"), (7, "x▁y z"), (8, "<|endoftext|> <s> </s> <unk> <0x41>"),
    (9, "日本語のテキスト。漢字かな混じり文、長い。"), (10, "😀😀 🏳️‍🌈 naïve café  　 x\x1c y\x85 z"), (11, "-" * 301 + "=" * 97 + " " * 40 + "."), (12, "\u0000\u0001 \r\n\r\n\tq"), (13, "don't we'll I'm 'tis"),
    (14, "word " * 3000), (15, "w" * 5000), (16, "word\nword\n\nword\n\n\nword"), (16, "word\nword\n\nword\n\n\nword"), (17, "  lead"), (18, "trail  \n "), (19, "日本 語\n本 日本"),
]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string")


def found(df):
    return sorted(map(tuple, df.collect()), key=repr)


def test_contract_on_odd_texts(spark, libraries):
    assert found(alignment.align_documents(frame(spark, ODD))[0]) == plain(ODD, libraries)


def test_contract_on_random_texts_and_small_blocks(spark, libraries, monkeypatch):
    rng = random.Random(5)
    stock = [" ", "  ", "\n", "\n\n", "\t", "the", "ing", "ß", "é", "語", "😀", "'s", "12", "3.", ",", "a,", "b.;", "x_:", " ", "\x1d", "Z", "zz", "-", "--", "​", "▁"]
    weights = [9, 2, 3, 1, 1] + [4] * 20 + [0.05]
    rows = [(i % 90, "".join(rng.choices(stock, weights, k=rng.randint(0, 120)))) for i in range(400)]
    want = plain(rows, libraries)
    monkeypatch.setattr(alignment, "BLOCK_PAIRS", 40)
    monkeypatch.setattr(alignment, "CELL_BYTES", 256)
    assert found(alignment.align_documents(frame(spark, rows).repartition(3))[0]) == want


def test_components_are_the_smallest_groups():
    rng = random.Random(1)
    for _ in range(300):
        total = rng.randint(1, 40)
        ends_a, ends_b = (np.array(sorted({*rng.sample(range(1, total + 1), rng.randint(0, total)), total})) for _ in "ab")
        u, v = alignment.overlaps(np.concatenate([[0], ends_a[:-1]]), ends_a, np.concatenate([[0], ends_b[:-1]]), ends_b)
        assert len(u) < len(ends_a) + len(ends_b)
        root = alignment.components(u, v + len(ends_a), len(ends_a) + len(ends_b))
        common, want = sorted(set(ends_a.tolist()) & set(ends_b.tolist())), []
        for s, e in zip([0, *common], common, strict=False):
            want.append((int(((s < ends_a) & (ends_a <= e)).sum()), int(((s < ends_b) & (ends_b <= e)).sum())))
        got = [(int((root[: len(ends_a)] == r).sum()), int((root[len(ends_a) :] == r).sum())) for r in np.unique(root)]
        assert got == want


def test_links_of_a_large_component_are_counts():
    a, b = np.array([1] * 40_000 + [2]), np.array([3] * 40_001)
    got = alignment.link_pairs(a, b, np.zeros(80_002, np.int64), np.zeros(40_001, np.int64))
    assert [x.tolist() for x in got[1:]] == [[(1 << 15) | 3, (2 << 15) | 3], [40_000 * 40_001, 40_001]]


def test_empty_table_and_further_columns(spark):
    assert found(alignment.align_documents(frame(spark, []))[0]) == []
    odd = spark.createDataFrame([(1, "a b", "x", 3)], "doc_id long, text string, row string, n_a int")
    assert alignment.align_documents(odd)[0].count() == 1


def test_cache_limits_change_nothing(spark, libraries, monkeypatch):
    monkeypatch.setattr(alignment, "BATCH_CHARS", 50)
    segments = alignment.Segments(model_path("byte_bpe_50k.json"), model_path())
    monkeypatch.setattr(alignment, "CACHE_SEGMENTS", 3)
    texts = [t for _, t in ODD if t]
    for t in texts:
        again = alignment.Segments(model_path("byte_bpe_50k.json"), model_path()).documents([t])
        assert segments.documents([t])[1] == again[1]
