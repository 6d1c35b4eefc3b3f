"""Ordered operators against plain versions: lines, columns, lookahead, brackets, as-of joins, sliding counts, keyed tables, streams."""

import bisect
import math
import random
from datetime import datetime, timedelta

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from folioflow.operators import gap, keyed_table, layout, lines, metering, profile, temporal, vector_index
from folioflow.sources import files
from folioflow.streaming import usage

DAY = 86_400_000_000


def rows_of(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


# --- lines and columns -----------------------------------------------------------


def plain_lines(pieces):
    """(x, y, text) of one page: greedy groups by the first height, then joined."""
    groups = []
    for x, y, t in sorted(pieces, key=lambda p: (-p[1], p[0], p[2])):
        if groups and groups[-1][0] - y <= 3.0:
            groups[-1][1].append((x, t))
        else:
            groups.append((y, [(x, t)]))
    out = []
    for _, group in groups:
        group.sort()
        text = group[0][1]
        for (px, pt), (cx, ct) in zip(group, group[1:], strict=False):
            text += ct if cx - px <= len(pt) * 4.0 * 1.1 else " " + ct
        out.append(text)
    return out


def plain_split(xs, least, middle=None):
    best, at = 0.0, None
    for a, b in zip(xs, xs[1:], strict=False):
        if middle is not None and b > middle:
            break
        if b - a > best:
            best, at = b - a, (a + b) / 2
    return at if best >= least else None


def random_pieces(seed, pages=12, n=40):
    rng = random.Random(seed)
    return [(p, float(rng.choice([rng.randint(0, 40), rng.randint(60, 90)])), rng.randint(0, 120) / 2, rng.choice(["ab", "x", "longer text", "-", "é"])) for p in range(pages) for _ in range(rng.randint(1, n))]


def test_lines_are_measured_from_their_first_piece(spark):
    # islands by gap would make one line of these
    got = layout.page_lines(spark.createDataFrame([(1, 0.0, y, f"t{i}") for i, y in enumerate([10.0, 8.0, 6.0, 4.0])], "page int, x double, y double, text string"))
    assert rows_of(got, "line", "text") == [(1, "t0t1"), (2, "t2t3")]


def test_page_lines_random(spark):
    pieces = random_pieces(3)
    df = spark.createDataFrame(pieces, "page int, x double, y double, text string").repartition(4)
    want = [(p, i + 1, t) for p in range(12) for i, t in enumerate(plain_lines([x[1:] for x in pieces if x[0] == p]))]
    assert rows_of(layout.page_lines(df), "page", "line", "text") == sorted(want, key=repr)


def test_column_lines_random(spark):
    pieces = random_pieces(4)
    df = spark.createDataFrame(pieces, "page int, x double, y double, text string")
    want = []
    for p in range(12):
        page = [x[1:] for x in pieces if x[0] == p]
        split = plain_split(sorted(x[0] for x in page), 18.0) if len(page) > 4 else None
        for c, part in ((1, [x for x in page if split is None or x[0] < split]), (2, [x for x in page if split is not None and x[0] >= split])):
            for i, t in enumerate(plain_lines(part)):
                letters = sum(ch.isalpha() for ch in t)
                if len(t) >= 2 and (letters / len(t) >= 0.25 or any(ch.isdigit() for ch in t)):
                    want.append((p, c, i + 1, t))
    assert rows_of(layout.column_lines(df), "page", "column", "line", "text") == sorted(want, key=repr)


def test_columns_of_unequal_length_and_first_of_equal_gaps(spark):
    left = [(1, 72.0, y, f"left {i}") for i, y in enumerate([700.0, 680.0, 660.0])]
    right = [(1, 330.0, y, f"right {i}") for i, y in enumerate([700.0, 670.0])]
    got = layout.column_lines(spark.createDataFrame(left + right, "page int, x double, y double, text string"))
    assert [r.text for r in got.orderBy("column", "line").collect()] == ["left 0", "left 1", "left 2", "right 0", "right 1"]
    even = spark.createDataFrame([(1, float(x), 0.0, "t") for x in (0, 20, 40, 40, 40)], "page int, x double, y double, text string")
    assert layout.column_split(even, "page", "x", F.col("wide") >= 18.0).first().split == 10.0


BOX = "page int, x0 double, y1 double, text string"


def test_boxes_right_column_first(spark):
    boxes = [(1, 30.2, 700.0, "Summary"), (1, 30.0, 650.0, "Skills"), (1, 248.0, 690.0, "Built A.\nCut B\nby half.\nLed C"), (1, 446.0, 690.0, "2020"), (2, 50.0, 10.0, "one"), (3, 10.0, 5.0, " \n "), (4, 10.0, 9.0, "a"), (4, 25.0, 8.0, "b"), (4, 40.0, 9.0, "c")]
    got = {r.page: r.text for r in layout.page_text(spark.createDataFrame(boxes, BOX)).collect()}
    assert got == {1: "• Built A.\n• Cut B by half.\n• Led C\n2020\n\nSummary\nSkills", 2: "one", 4: "a\nc\nb"}


def test_gaps_right_of_the_middle_do_not_count(spark):
    boxes = spark.createDataFrame([(1, 10.0, 1.0, "a"), (1, 20.0, 1.0, "b"), (1, 500.0, 1.0, "c")], BOX)
    assert [r.right for r in layout.columns(boxes).collect()] == [False] * 3


def test_bullets_of_a_box(spark):
    cases = ["one line", "Ends.\nNext", "ends.\nnext", "a\n\nB", "", "A.\nB.\nC", " x \n y "]
    want = [["one line"], ["• Ends.", "• Next"], ["ends.", "next"], ["• a", "• B"], [], ["• A.", "• B.", "• C"], ["x", "y"]]
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", layout.box_lines(F.col("t")).alias("l"))
    assert [r.l for r in df.orderBy("i").collect()] == want


# --- lookahead and brackets --------------------------------------------------------


def test_reader_uses_up_rows(spark):
    rng = random.Random(2)
    takes = {k: [rng.choice([1, 1, 2, 3, None, 9]) for _ in range(rng.randint(0, 60))] for k in range(20)}
    df = spark.createDataFrame([(k, i, t) for k, ts in takes.items() for i, t in enumerate(ts)], "k int, at int, takes int")
    want = []
    for k, ts in takes.items():
        i, read = 0, set()
        while i < len(ts):
            read.add(i)
            i += min(max(ts[i] or 1, 1), 3)
        want += [(k, j, j in read) for j in range(len(ts))]
    assert rows_of(lines.with_read(df, "k", "at", "takes"), "k", "at", "read") == sorted(want, key=repr)


def test_headers_of_one_to_three_lines(spark):
    said = ["Engineer: Acme, Rome", "Jan 2020 – Present", "Lead", "Big Corp", "2019 - 2021", "Manager 2018 - 2019", "Gamma  Oslo", "• bullet of work"]
    got = lines.role_headers(spark.createDataFrame([(1, i, s) for i, s in enumerate(said)], "doc_id int, at int, line string"))
    assert rows_of(got, "at", "shape", "used", "title", "company", "location", "dates") == [
        (0, "two", 2, "Engineer", "Acme", "Rome", "Jan 2020 – Present"),
        (2, "three", 3, "Lead", "Big Corp", "", "2019 - 2021"),
        (5, "dated", 2, "Manager", "Gamma", "Oslo", "2018 - 2019"),
    ]


def test_education_random(spark):
    rng = random.Random(9)
    stock = ["Test University", "Master of A", "Bachelor of B", "2019 - 2021", "other", "MBA 2015 - 2016", "BE at Some College", "- skip University"]
    said = {k: [rng.choice(stock) for _ in range(rng.randint(0, 15))] for k in range(30)}
    want = []
    for k, ls in said.items():
        entries = []
        for s in ls:
            if s.startswith(("•", "-")):
                continue
            dated = any(c.isdigit() for c in s)
            degree = any(w in s.lower() for w in lines.DEGREES)
            school = any(w in s.lower() for w in lines.SCHOOLS)
            if dated and not school and entries:
                entries[-1][2] = s
            elif degree and entries:
                if not entries[-1][1]:
                    entries[-1][1] = s
                else:
                    entries.append([s, "", ""])
            elif school or dated:
                entries.append([s, "", ""])
        want += [(k, i + 1, *e) for i, e in enumerate(entries)]
    df = spark.createDataFrame([(k, i, s) for k, ls in said.items() for i, s in enumerate(ls)], "doc_id int, at int, line string")
    assert rows_of(lines.education_entries(df), "doc_id", "entry", "institution", "degree", "dates") == sorted(want, key=repr)


def plain_args(text, at, n):
    args, i = [], at
    while len(args) < n:
        while i < len(text) and text[i] in " \t\n\r":
            i += 1
        if i >= len(text) or text[i] != "{":
            break
        depth, start = 0, i
        while i < len(text):
            depth += (text[i] == "{") - (text[i] == "}")
            i += 1
            if not depth:
                break
        if depth:
            break
        args.append(text[start + 1 : i - 1])
    return args


def test_brace_args_random(spark):
    rng = random.Random(4)
    texts = {k: "".join(rng.choices(["{", "}", "a", "é", " ", "\n", "}{"], k=rng.randint(0, 60))) for k in range(120)}
    df = spark.createDataFrame(list(texts.items()), "doc_id int, text string")
    for n in (1, 3):
        want = sorted((k, i, tuple(a)) for k, t in texts.items() for i, c in enumerate(t) if c == "{" and (a := plain_args(t, i, n)))
        assert sorted((r.doc_id, r.at, tuple(r.args)) for r in lines.brace_args(df, n).collect()) == want


def test_macro_args(spark):
    df = spark.createDataFrame([(1, "x \\sub {a{b}}\n {c} \\sub{d} \\sub \\subx{e}"), (2, "")], "doc_id int, text string")
    assert rows_of(lines.macro_args(df, "\\sub", 2), "doc_id", "args") == [(1, ["a{b}", "c"]), (1, ["d"])]


# --- time ----------------------------------------------------------------------------

START = datetime(2024, 1, 1)


def log(seed, n, users=4, minutes=60 * 24 * 50):
    """Events of which one user has about half."""
    rng = random.Random(seed)
    return [(i, 0 if rng.random() < 0.5 else rng.randrange(1, users), START + timedelta(minutes=rng.randrange(minutes))) for i in range(n)]


def frame(spark, rows):
    return spark.createDataFrame(rows, "event_id long, user_id long, ts timestamp")


@pytest.mark.parametrize("width", [None, DAY, 10 * DAY])
def test_asof(spark, width):
    left, right = log(1, 400), log(2, 120)
    right += [(1000 + i, u, t) for i, u, t in right[:20]]  # ties in time: the greater id counts
    want = []
    for i, u, t in left:
        found = max(((t2, i2) for i2, u2, t2 in right if u2 == u and t2 <= t), default=(None, None))
        want.append((i, found[1]))
    want += [(5000, None), (5001, None)]
    l_df = frame(spark, left + [(5000, None, START), (5001, 1, None)])
    r_df = frame(spark, right + [(9000, None, START), (9001, 2, None)]).withColumnRenamed("event_id", "change")
    got = temporal.asof(l_df, r_df, "user_id", "ts", ["change"], width, tie="change")
    assert got.columns == ["event_id", "user_id", "ts", "change"]
    assert rows_of(got, "event_id", "change") == sorted(want, key=repr)


def test_asof_keeps_clashing_names_apart_and_takes_numbers(spark):
    left = spark.createDataFrame([(1, 5, "l"), (1, 1, "m")], "k int, at int, v string")
    right = spark.createDataFrame([(1, 2, "r")], "k int, at int, v string")
    assert rows_of(temporal.asof(left, right, "k", "at", ["v"], width=2), "at", "v", "v_right") == [(1, "m", None), (5, "l", "r")]


def test_trailing_counts_and_places(spark):
    events = log(5, 600) + [(10_000, 1, None), (10_001, None, START), (10_002, None, START)]
    df = frame(spark, events)
    got = rows_of(temporal.trailing_count(df, ["user_id"], "ts", 86_400), "event_id", "in_window")
    by = {}
    for _, u, t in events:
        if t:
            by.setdefault(u, []).append(t)
    for ts in by.values():
        ts.sort()
    want = [(i, None if t is None else bisect.bisect_right(by[u], t) - bisect.bisect_left(by[u], t - timedelta(days=1))) for i, u, t in events]
    assert got == sorted(want, key=repr)
    placed = rows_of(temporal.running_place(df, [F.col("user_id")], "ts", "event_id", DAY), "event_id", "place")
    ranks = {}
    for i, u, _ in sorted(events, key=lambda e: (e[2] or datetime(1, 1, 1), e[0])):
        ranks.setdefault(u, []).append(i)
    assert placed == sorted(((i, n + 1) for ids in ranks.values() for n, i in enumerate(ids)), key=repr)


def test_admission_of_a_hot_user_in_a_month(spark):
    events = log(6, 300, minutes=60 * 24 * 70)
    got = {r.event_id: (r.place, r.allowed) for r in metering.admitted(frame(spark, events)).collect()}
    seen = {}
    for i, u, t in sorted(events, key=lambda e: (e[2], e[0])):
        n = seen[u, t.month] = seen.get((u, t.month), 0) + 1
        assert got[i] == (n, n <= 5)


def test_stream_admission_over_files_and_a_restart(spark, tmp_path):
    events = sorted(log(7, 240, minutes=60 * 24 * 100), key=lambda e: e[2])
    folder, out, cp = (str(tmp_path / x) for x in ("in", "out", "checkpoint"))

    def arrive(part, n):
        frame(spark, part).coalesce(1).write.parquet(f"{folder}/{n}")

    def run():
        stream = spark.readStream.schema("event_id long, user_id long, ts timestamp").option("maxFilesPerTrigger", 1).parquet(f"{folder}/*")
        usage.run_admissions(stream, out, cp)

    arrive(events[:60], 0)
    arrive(events[60:130], 1)
    run()
    arrive(events[130:], 2)
    run()  # from the checkpoint: places go on where they were
    got = rows_of(spark.read.parquet(out), "event_id", "place", "allowed")
    assert got == rows_of(metering.admitted(frame(spark, events)), "event_id", "place", "allowed")


# --- keyed table -----------------------------------------------------------------------


def table(spark, tmp_path, buckets=8):
    return keyed_table.KeyedTable(spark, str(tmp_path / "t"), "id", "id long, v string, seq int", buckets)


def some(spark, rows):
    return spark.createDataFrame(rows, "id long, v string, seq int")


def test_upsert_and_delete_touch_their_buckets_only(spark, tmp_path):
    t = table(spark, tmp_path)
    assert t.read().count() == 0 and t.manifest()["version"] == 0
    t.upsert(some(spark, [(i, "a", 1) for i in range(200)]), "seq")
    before = t.manifest()["folders"]
    t.upsert(some(spark, [(7, "b", 2), (7, "c", 3), (7, "d", None)]), "seq")
    after = t.manifest()["folders"]
    assert sum(before[b] != after[b] for b in before) == 1
    assert rows_of(t.lookup(7), "v", "seq") == [("c", 3)]
    t.delete(some(spark, [(9, "", 0), (5000, "", 0)]))
    gone = t.manifest()["folders"]
    assert sum(after[b] != gone[b] for b in after) == 1
    assert rows_of(t.read(), "id") == [(i,) for i in sorted(range(200), key=lambda x: repr((x,))) if i != 9]
    assert t.read(1).where("v = 'a'").count() == 200
    version = t.manifest()["version"]
    assert t.delete(some(spark, [(5000, "", 0)])) == version and t.upsert(some(spark, [])) == version


def test_null_keys_and_repeated_appends(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(some(spark, [(None, "n", 1), (1, "x", 1)]))
    t.append(some(spark, [(1, "y", 2)]))
    assert rows_of(t.read(), "id", "v") == [(1, "x"), (1, "y"), (None, "n")]
    t.delete(some(spark, [(None, "", 0)]))
    assert rows_of(t.read(), "id", "v") == [(1, "x"), (1, "y")]
    t.upsert(some(spark, [(1, "z", 3)]))
    assert rows_of(t.read(), "id", "v") == [(1, "z")]


def test_a_killed_writer_leaves_the_old_state(spark, tmp_path, monkeypatch):
    t = table(spark, tmp_path)
    t.upsert(some(spark, [(i, "a", 1) for i in range(20)]))

    def dies(*_):
        raise KeyboardInterrupt

    with monkeypatch.context() as m:
        m.setattr(t, "_commit", dies)
        with pytest.raises(KeyboardInterrupt):
            t.delete(some(spark, [(3, "", 0)]))
    assert t.read().count() == 20
    t.vacuum()
    assert t.read().count() == 20
    assert len(list((tmp_path / "t" / "data").iterdir())) == 1


def test_of_two_writers_one_is_told(spark, tmp_path):
    t = table(spark, tmp_path)
    t.append(some(spark, [(1, "a", 1)]))
    seen = t.manifest()
    t.append(some(spark, [(2, "b", 1)]))
    with pytest.raises(keyed_table.Conflict):
        t._commit(seen, {})
    assert t.read().count() == 2


# --- keywords -----------------------------------------------------------------------------


def test_keywords_nested_and_overlapping_themselves(spark):
    words = [(0, "c", 0, "test"), (0, "c", 1, "testing"), (0, "c", 2, "unit test"), (1, "d", 0, "aa"), (1, "d", 1, "test"), (1, "d", 2, "c++"), (1, "d", 3, "é"), (1, "d", 4, "testing tool")]
    texts = ["testing a unit testest", "aaaaa aa", "Testing TOOLs testing tool", "", None, "c+++ É", "test" * 5, "untested"]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id int, text string")
    got = {r.doc_id: r.hits for r in gap.keyword_hits(df, "doc_id", words).collect()}
    for i, t in enumerate(texts):
        want = [(c, k, t.lower().count(w)) for c, _, k, w in words if w in t.lower()] if t else []
        assert [tuple(h) for h in got[i]] == want
    rows = sorted((r.doc_id, r.cat_ord, r.kw_ord, r.n) for r in gap.vocabulary_counts(df, "doc_id", words).collect())
    assert rows == sorted((i, *h) for i, hits in got.items() if hits for h in map(tuple, hits))


def test_pairs_shuffle_nothing_behind_their_meeting(spark):
    jd = spark.createDataFrame([(1, "python airflow kafka testing")], "jd_id long, text string")
    doc = spark.createDataFrame([(1, "python pipelines with kafka"), (2, None)], "doc_id long, text string")
    plan = gap.full_report(jd, doc)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("BroadcastNestedLoopJoin") == 1
    above = plan.split("BroadcastNestedLoopJoin")[0]
    assert "Exchange" not in above and "Window" not in above


def test_vocabulary_counts_are_those_of_str_count(spark, monkeypatch):
    monkeypatch.setattr(gap, "STEP", 37)
    rng = random.Random(6)
    known = ["".join(rng.choice("abé") for _ in range(rng.randint(1, 4))) for _ in range(40)] + ["aaa", "test", "ab\0a"]
    words = [(i % 3, "c", i, w) for i, w in enumerate(known)]
    texts = ["".join(rng.choice("aaabé \0") for _ in range(rng.randint(0, 90))) for _ in range(40)] + ["a" * 500, None, "", "testest ab\0ab\0a"]
    df = spark.createDataFrame([(i // 2, t) for i, t in enumerate(texts)], "doc_id int, text string")
    plan = gap.vocabulary_counts(df, "doc_id", words)
    got = sorted(map(tuple, plan.collect()))
    assert got == sorted((i // 2, c, k, t.lower().count(w)) for i, t in enumerate(texts) if t for c, _, k, w in words if w in t.lower())
    assert "Exchange" not in plan._jdf.queryExecution().executedPlan().toString()


# --- loose JSON and vectors ---------------------------------------------------------------


def test_loose_json_skips_odd_values_one_by_one(spark):
    good = '{"experience": [{"title": "Dev", "company": 7, "start": null, "bullets": ["Ran 5x", 3, null, {"a": 1}, " ", ["x"], {"text": " of an object "}]}, "no role", null], "skills": ["a", "a", 1, null], "projects": [{"name": "P", "tech": ["t", 2]}], "education": [{"school": "S", "institution": "I", "date": "2019"}], "certifications": "none"}'
    cases = [good, "```json\n" + good + "\n```", "[1]", "5", "{", "", None, "{}", '{"experience": 5}']
    df = spark.createDataFrame(list(enumerate(cases)), "i int, t string").select("i", profile.from_loose_json(F.col("t")).alias("p"))
    got = {r.i: r.p for r in df.collect()}
    for i in (0, 1):
        p = got[i]
        assert len(p.experience) == 1
        r = p.experience[0]
        assert (r.title, r.company, r.start, r.end, [b.text for b in r.bullets]) == ("Dev", "7", "", "", ["Ran 5x", "of an object"])
        assert p.skills == ["a"] and p.certifications == []
        assert (p.projects[0].name, p.projects[0].tech) == ("P", ["t"])
        assert (p.education[0].institution, p.education[0].dates) == ("S", "2019")
    assert all(got[i] is None for i in (2, 3, 4, 5, 6))
    assert got[7].experience == [] and got[8].experience == []


def test_vector_index_recall_and_changes(spark, tmp_path):
    rng = random.Random(3)
    centres = [[rng.gauss(0, 1) for _ in range(16)] for _ in range(30)]
    rows = [(i, [x + rng.gauss(0, 0.4) for x in centres[i % 30]]) for i in range(1500)]
    df = spark.createDataFrame(rows + [(5000, None), (5001, [1.0, None]), (5002, [float("nan")] * 16), (None, [1.0] * 16)], "id long, embedding array<double>")
    index = vector_index.VectorIndex(spark, str(tmp_path / "v"), cells=20)
    index.build(df)
    assert index.rows.read().count() == 1500
    asks = spark.createDataFrame([(i, rows[i * 20][1]) for i in range(60)], "query_id long, q array<double>")
    assert index.recall(asks, 10, 6) >= 0.9
    best = {r.query_id: r.id for r in index.search(asks, 1, None).collect()}
    assert best == {i: i * 20 for i in range(60)}
    before = index.rows.manifest()["folders"]
    index.delete(spark.createDataFrame([(0,), (99_999,)], "id long"))
    after = index.rows.manifest()["folders"]
    assert sum(before[b] != after.get(b) for b in before) == 1
    index.upsert(spark.createDataFrame([(20, rows[0][1]), (20, None)], "id long, embedding array<double>"))
    found = {r.query_id: r.id for r in index.search(asks, 1, None).collect()}
    assert found[0] == 20 and found[1] != 20 and index.rows.read().count() == 1499


# --- sources --------------------------------------------------------------------------------


def test_lossy_bytes_as_python_reads_them(spark):
    rng = random.Random(8)
    parts = [b"a", "é".encode(), "日".encode(), "😀".encode(), "日".encode()[:2], "😀".encode()[:3], "😀".encode()[:1], b"\xff", b"\xc0\xaf", b"\xed\xa0\x80", b"\xf5", b"\xe0\x80", b"\x80", b"\xf4\x90\x80\x80"]
    cases = [b"".join(rng.choices(parts, k=rng.randint(0, 8))) for _ in range(500)]
    df = spark.createDataFrame([(i, bytearray(c)) for i, c in enumerate(cases)], "i int, b binary")
    got = {r.i: r.t for r in df.select("i", files.lossy(F.col("b")).alias("t")).collect()}
    assert [got[i] for i in range(500)] == [c.decode("utf-8", "replace") for c in cases]


def pdf(pieces):
    shown = "".join(f"BT 1 0 0 1 {x} {y} Tm ({t}) Tj ET\n" for x, y, t in pieces)
    return b"%PDF\nstream\n" + shown.encode("latin-1") + b"\nendstream"


def test_pdf_columns_of_unequal_height():
    left = [(72, y, f"left {n}") for n, y in zip(("one", "two", "three"), (700, 680, 660), strict=True)]
    right = [(330, y, f"right {n}") for n, y in zip(("one", "two"), (700, 670), strict=True)]
    assert files.pdf_text(pdf(left + right)).split("\n") == ["left one", "left two", "left three", "right one", "right two"]
    # four pieces have no columns
    assert files.pdf_text(pdf(left[:2] + right)).split("\n") == ["left one right one", "left two", "right two"]
    # the first of equal gaps parts the columns
    even = [(72, 700, "a1"), (172, 700, "b1"), (272, 700, "c1"), (72, 680, "a2"), (172, 680, "b2")]
    assert files.pdf_text(pdf(even)).split("\n") == ["a1", "a2", "b1 c1", "b2"]


def test_tex_files(spark, tmp_path):
    rows = spark.createDataFrame([(1, "a\nb"), (2, "c"), (3, None)], "doc_id long, tex string")
    files.write_tex(rows, str(tmp_path / "tex"))
    got = {r.doc_id: r.value for r in spark.read.text(str(tmp_path / "tex"), wholetext=True).collect()}
    assert got == {1: "a\nb\n", 2: "c\n"}


# --- ties and repeats ---------------------------------------------------------------------


def test_exact_search_of_repeated_queries_and_equal_vectors(spark, tmp_path):
    rng = random.Random(9)
    rows = [(i, [rng.gauss(0, 1) for _ in range(5)]) for i in range(60)]
    rows += [(100 + i, rows[7][1]) for i in range(20)] + [(200, [0.0] * 5)]
    index = vector_index.VectorIndex(spark, str(tmp_path / "v"), cells=4)
    index.build(spark.createDataFrame(rows, "id long, embedding array<double>"))
    asks = [(1, rows[7][1]), (1, rows[3][1]), (2, [0.0] * 5), (3, [1e200] * 5), (4, [1.0, None, 0.0, 0.0, 0.0])]
    got = {(r.query_id, r["rank"]): r.id for r in index.search(spark.createDataFrame(asks, "query_id long, q array<double>"), 21, None).collect()}
    norm = lambda v: math.sqrt(sum(x * x for x in v)) or 1.0
    both = [(-sum(a * b for a, b in zip(q, v, strict=True)) / (norm(q) * norm(v)), i) for q in (rows[7][1], rows[3][1]) for i, v in rows]
    assert [got[1, k + 1] for k in range(21)] == [i for _, i in sorted(both)][:21]
    assert [got[2, k + 1] for k in range(21)] == list(range(21))
    assert [got[4, k + 1] for k in range(21)] == list(range(21))
    assert len({got[3, k + 1] for k in range(21)}) == 21


def test_a_text_printed_twice_at_one_place_is_one_piece(spark):
    pieces = [(1, 10.0, 5.0, "-")] * 2 + [(1, 20.0, 5.0, "word 1")]
    df = spark.createDataFrame(pieces, "page int, x double, y double, text string")
    assert [r.text for r in layout.column_lines(df).collect()] == ["- word 1"]
    assert [r.text for r in layout.page_lines(df).collect()] == ["- word 1"]


def test_boxes_of_one_place_keep_the_given_order(spark):
    boxes = [(1, 10.0, 5.0, f"box {i}", i) for i in (3, 1, 2, 0)]
    df = spark.createDataFrame(boxes, f"{BOX}, at int")
    assert layout.page_text(df, at="at").first().text == "box 0\nbox 1\nbox 2\nbox 3"


# --- packed pairs -------------------------------------------------------------------------


def test_packed_pairs_are_told_as_pair_by_pair(spark, monkeypatch):
    monkeypatch.setattr(gap, "PACK", 3)  # several blocks of both sides
    rng = random.Random(11)
    taxonomy = {"a": ["alpha", "beta", "gamma"], "b": ["delta", "alph", "omega ray", "kappa", "sigma", "theta", "zeta", "iota"], "c": ["none"]}
    say = lambda: " ".join(rng.choices(["alpha", "beta", "gamma", "delta", "omega ray", "kappa", "sigma", "theta", "zeta", "iota", "words", "tests"], k=rng.randint(0, 9)))
    jds, docs = [(i, say()) for i in range(7)] + [(7, None)], [(i, say()) for i in range(10)] + [(3, "alpha"), (10, None), (None, "beta beta")]
    jd, doc = spark.createDataFrame(jds, "jd_id long, text string"), spark.createDataFrame(docs, "doc_id long, text string").repartition(2)
    want, signals = [], []
    for j, jt in jds:
        for d, dt in docs:
            for c, name in enumerate(taxonomy):
                asked = [w for w in taxonomy[name] if w in (jt or "")]
                if asked:
                    n, freq = sum(w in (dt or "") for w in asked), sum(jt.count(w) for w in asked)
                    want.append((j, d, c, freq, n, round(n / len(asked), 2), tuple(w for w in asked if w not in (dt or ""))))
    got = [(r.jd_id, r.doc_id, r.cat_ord, r.frequency, r.shared, r.coverage, tuple(r.missing)) for r in gap.category_coverage(jd, doc, taxonomy).collect()]
    assert sorted(got, key=repr) == sorted(want, key=repr)
    one = {}
    for j, d, c, freq, n, share, lacks in want:
        level = 0 if share < 0.3 and freq >= 2 else 1 if share < 0.6 else 2
        if level < 2:
            one.setdefault((j, d, lacks if d == 3 else None), []).append((level, -freq, c))
    signals = [(r.jd_id, r.doc_id, r["rank"], r.cat_ord if "cat_ord" in r else r.category, r.priority, r.frequency) for r in gap.pair_signals(jd, doc, 1, taxonomy).where("doc_id <> 3").collect()]
    firsts = [(j, d, 1, "abc"[c], ["high", "medium"][level], -less) for (j, d, _), found in one.items() if d not in (3, None) for level, less, c in [min(found)]]
    assert sorted(signals) == sorted(firsts)


def test_pairs_send_no_row_of_pairs_through_expressions(spark):
    jd = spark.createDataFrame([(1, "python airflow kafka testing")], "jd_id long, text string")
    doc = spark.createDataFrame([(1, "python pipelines with kafka")], "doc_id long, text string")
    for rows in (gap.match_scores(jd, doc), gap.pair_signals(jd, doc), gap.category_coverage(jd, doc)):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "MapInArrow" in plan.split("BroadcastNestedLoopJoin")[0]


# --- read once ----------------------------------------------------------------------------


def test_json_is_read_once(spark):
    plan = spark.createDataFrame([("{}",)], "t string").select(files.json_or_text(F.col("t")).alias("x"))._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("from_json") == 1


def test_extractors_open_few_files_at_once(spark, monkeypatch):
    batch = pa.RecordBatch.from_arrays([pa.array(range(1000))], ["x"])
    parts = list(files.slices(iter([batch, batch.slice(0, 0)])))
    assert max(p.num_rows for p in parts) <= files.FILES and sum(p.num_rows for p in parts) == 1000


def test_terms_of_keys_that_occur_once_are_not_shuffled(spark):
    texts = [(1, "one two one"), (2, None), (None, "nix nix"), (3, "two two"), (3, "one two"), (None, "nix"), (4, ""), (5, "the café python")]
    df = spark.createDataFrame(texts, "doc_id long, text string")
    got = sorted(((r.doc_id, r.term, r.freq, r.first_pos) for r in gap.doc_terms(df, "doc_id").collect()), key=repr)
    assert got == sorted(((r.doc_id, r.term, r.freq, r.first_pos) for r in gap._term_rows(df, "doc_id").collect()), key=repr)
    assert (3, "two", 3, 0) in got and (None, "nix", 3, 0) in got
    plan = gap.doc_terms(df, "doc_id")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan


# --- alarms of slices -----------------------------------------------------------------------


def test_alarms_from_slices_are_those_of_all_windows(spark):
    rng = random.Random(3)
    times = [rng.randrange(0, 6 * 3600) for _ in range(150)] + [7200] * 5
    rows = [(i % 3 if i % 10 else None, t if i != 7 else None) for i, t in enumerate(times)]
    events = spark.createDataFrame(rows, "user_id int, s long").select("user_id", F.timestamp_seconds("s").alias("ts"))
    slices = usage.slice_counts(events)
    assert slices.agg(F.sum("n")).first()[0] == len(rows) - 1
    for limit in (1, 8, 12):
        want = usage.rate_alarms(events, limit=limit).collect()
        got = usage.alarms_of(slices, limit=limit).collect()
        assert sorted(map(str, got)) == sorted(map(str, want))


def test_escaping_reads_pieces_not_characters(spark):
    from folioflow.functions import text as X
    from folioflow.functions import vocab

    texts = ["", None, "plain", "a & b_c\n100% \\x{y}~^", "##", "é😀#é"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts)], "i int, t string").select("i", X.escape_latex(F.col("t")).alias("e"))
    want = [t if t is None else "".join(vocab.LATEX_ESCAPES.get(c, c) for c in t) for t in texts]
    assert [r.e for r in df.orderBy("i").collect()] == want
    assert "split(" not in df._jdf.queryExecution().optimizedPlan().toString()


# --- documents are read once ----------------------------------------------------------------


def test_finder_finds_what_the_patterns_find(monkeypatch):
    import re

    from folioflow.functions import vocab

    rng = random.Random(8)
    texts = ["".join(rng.choice("ab3-./+# é\n_") for _ in range(rng.randint(0, 60))) for _ in range(200)]
    texts += [None, "", "abb", "abb", "-abb", "3a.b", "é", "ab", "a" * 300, "abb\0aba", "x" * 5000]
    tokens = [{x for x in re.findall(vocab.TOKEN, t or "") if len(x) > 2} for t in texts]
    terms = sorted(set().union(*tokens))[::2]
    words = [(0, "g", k, w) for k, w in enumerate(["a", "ab", "abb", "b3", "é", ". ", "aa", ""])] + [(1, "h", 0, "ab")]
    for step, size in ((7, 40), (1 << 18, 1 << 22)):
        monkeypatch.setattr(gap, "STEP", step)
        monkeypatch.setattr(gap, "TEXT_BYTES", size)
        finder, column = gap._Finder(words, pa.array(terms).cast(pa.binary())), pa.array(texts)
        keywords, places = [], []
        for at, n in finder.blocks(column):
            k, p = finder.find(column.slice(at, n))
            keywords += k.to_pylist()
            places += p.to_pylist()
        assert [sorted(x) for x in keywords] == [sorted(c * 1000 + k for c, _, k, w in words if t is not None and w in t) for t in texts]
        assert [[terms[i] for i in x] for x in places] == [sorted(x & set(terms)) for x in tokens]


def test_scores_do_not_depend_on_how_documents_meet_the_terms(spark, monkeypatch):
    rng = random.Random(4)
    say = lambda n: " ".join(rng.choices(["python", "airflow", "c++", "spark/sql", "etl-jobs", "kafka", "the", "Go"], k=n))
    jd = spark.createDataFrame([(i, say(6)) for i in range(5)] + [(5, None)], "jd_id long, text string")
    docs = [(i, say(rng.randint(0, 5))) for i in range(20)] + [(3, "c++"), (3, None), (None, "python"), (None, "kafka airflow"), (20, None)]
    doc = spark.createDataFrame(docs, "doc_id long, text string")
    figures = lambda: sorted(map(repr, gap.pairs(jd, doc, gaps=3).collect()))
    got = figures()
    counts = {r.score: r.pairs for r in gap.score_counts(jd, doc).collect()}
    assert counts == {r.score: r.n for r in gap.match_scores(jd, doc).groupBy("score").agg(F.count("*").alias("n")).collect()}
    monkeypatch.setattr(gap, "TERM_BYTES", -1)  # the terms stay a table
    assert figures() == got


def test_scores_shuffle_no_terms_of_documents(spark):
    jd = spark.createDataFrame([(1, "python airflow kafka testing")], "jd_id long, text string")
    doc = spark.createDataFrame([(1, "python pipelines with kafka"), (2, None)], "doc_id long, text string")
    spine, _ = gap._sides(jd, doc, [(0, "g", 0, "kafka")])
    plan = spine._jdf.queryExecution().optimizedPlan().toString()
    assert "regexp_extract_all" not in plan and "MapInArrow" in plan


def test_compare_tells_the_score_of_a_pair_alone(spark):
    from folioflow.operators import extras

    jd = spark.createDataFrame([(1, "python airflow kafka testing"), (2, None), (3, "kafka spark spark")], "jd_id long, text string")
    doc = spark.createDataFrame([(1, "python pipelines with kafka"), (2, None), (3, ""), (3, "spark"), (None, "airflow")], "doc_id long, text string")
    got, want = extras.compare(jd, doc), rows_of(gap.match_scores(jd, doc), "jd_id", "doc_id", "score")
    assert rows_of(got, "jd_id", "doc_id", "formula") == rows_of(got, "jd_id", "doc_id", "model") == want and len(want) == 15
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert not [c for c in ("overlap", "category_mean") if c in plan]
