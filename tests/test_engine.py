import io
import zipfile
import zlib

import pytest
from pyspark.sql import functions as F

from folioflow.operators import extras, gap, metering, parse_arrow, profile, render, store, vector
from folioflow.sources import files


def texts(spark, rows, key):
    return spark.createDataFrame(rows, f"{key} long, text string")


def test_coverage_rounding_and_priority(spark):
    jd = texts(spark, [(1, "airflow dagster prefect dag workflow scheduling backfill retry")], "jd_id")
    doc = texts(spark, [(1, "airflow"), (2, "")], "doc_id")
    rows = {r.doc_id: r for r in gap.category_coverage(jd, doc).where("category = 'orchestration'").collect()}
    assert rows[1].coverage == 0.12
    assert rows[2].coverage == 0.0
    assert rows[2].frequency == 9  # "dag" counts inside "dagster" too
    assert gap.gap_signals(gap.category_coverage(jd, doc)).first().priority == "high"


def test_keyword_gaps_keep_first_occurrence_order(spark):
    jd = texts(spark, [(1, "zebra zebra apple apple apple banana banana abc abc")], "jd_id")
    doc = texts(spark, [(1, "apple"), (2, None)], "doc_id")
    got = [(r.doc_id, r.term, r.freq) for r in gap.keyword_gaps(jd, doc).orderBy("doc_id", "rank").collect()]
    assert got == [(1, "zebra", 2), (1, "banana", 2), (2, "apple", 3), (2, "zebra", 2), (2, "banana", 2)]


def test_scores_are_bounded_and_self_match_is_best(spark):
    jd = texts(spark, [(1, "python airflow kafka streaming pipeline"), (2, "")], "jd_id")
    doc = texts(spark, [(1, "python airflow kafka streaming pipeline"), (2, "gardening")], "doc_id")
    rows = {(r.jd_id, r.doc_id): r.score for r in gap.match_scores(jd, doc).collect()}
    assert rows[1, 1] == 100
    assert rows[1, 2] == 0
    assert rows[2, 1] == 0
    advice = {r.doc_id: r.advice for r in gap.recommendations(jd, doc).where("jd_id = 1").collect()}
    assert advice[1][0].startswith("Good")
    assert advice[2][0].startswith("Critical")


def test_embedding(spark):
    rows = {r.doc_id: r.embedding for r in vector.embed(texts(spark, [(1, ""), (2, "spark"), (3, "a b a")], "doc_id")).collect()}
    assert rows[1] == [0.0] * 128
    assert rows[2][101] == 1.0
    assert abs(sum(x * x for x in rows[3]) - 1) < 1e-9


def test_cosine_stops_at_the_shorter_vector(spark):
    df = spark.createDataFrame([([1.0, 0.0, 1.0], [1.0])], "a array<double>, b array<double>")
    assert abs(df.select(vector.cosine(F.col("a"), F.col("b")).alias("x")).first().x - 2**-0.5) < 1e-12


def test_store(spark, tmp_path):
    s = store.ProfileStore(spark, str(tmp_path / "profiles"))
    assert s.users().count() == 0
    rows = [("u1", "{}", "spark airflow", 1.0), ("u1", "{}", "gardening roses", 2.0), ("u2", "{}", "spark", 3.0)]
    s.store(spark.createDataFrame(rows, "user_id string, profile_json string, text string, stored_at double"))
    asks = spark.createDataFrame([(1, "u1", "spark")], "query_id long, user_id string, text string")
    best = s.query(asks, 1).first()
    assert (best.rank, round(best.score, 6)) == (1, round(2**-0.5, 6))
    s.delete(spark.createDataFrame([("u1",), ("nobody",)], "user_id string"))
    assert [r.user_id for r in s.users().collect()] == ["u2"]
    assert s.for_caller("u1").count() == 0


def test_metering(spark):
    rows = [(i, f"2024-01-{i + 1:02d} 00:00:00", 1, "call") for i in range(7)] + [(9, "2024-02-01 00:00:00", 1, "call")]
    ev = spark.createDataFrame(rows, "event_id long, ts string, user_id long, event_type string").withColumn("ts", F.to_timestamp("ts"))
    assert sorted((r.month, r.resume_count) for r in metering.monthly_usage(ev).collect()) == [("2024-01", 7), ("2024-02", 1)]
    assert metering.admitted(ev).where("allowed").count() == 6
    plans = spark.createDataFrame([(1, "pro")], "user_id long, plan string")
    assert all(r.allowed and r.usage_limit is None for r in metering.usage_info(metering.monthly_usage(ev), plans).collect())


def test_blob(spark):
    text = "Company: Acme\nTitle: Engineer\nDates: October 2021 – Present\n- Cut cost by 68% with Spark\nCompany growth\n* x\n"
    p = profile.parse_blob(texts(spark, [(1, text), (2, "- orphan"), (3, None)], "doc_id"))
    rows = {r.doc_id: r.profile for r in p.collect()}
    assert [(r.company, r.title, r.start, len(r.bullets)) for r in rows[1].experience] == [("Acme", "Engineer", "Oc", 1), ("growth", "", "", 1)]
    b = rows[1].experience[0].bullets[0]
    assert (b.metrics, b.tools, b.confidence) == ([""], ["Spark"], "medium")
    assert rows[2].experience == []
    assert rows[3].experience == []


def test_markdown_section_order_and_repeated_skills(spark):
    text = "## Experience\n**T** | C | 2020 - 2021\n- did it\n## Skills\nA, B | A\n"
    p = profile.parse_markdown(texts(spark, [(1, text)], "doc_id")).first().profile
    assert [(r.title, r.company, r.start, r.end) for r in p.experience] == [("T", "C", "2020 - 2021", "")]
    assert p.skills == ["A", "B", "A"]


def test_latex():
    tex = "\\section{Experience}\\resumeSubheading{Eng}{Jan 2020 -- Now}{Acme}{X}\\resumeItem{By \\textbf{5\\%} \\href{u}{Spark}}\\section{Projects}\\resumeProjectHeading{\\textbf{P} $|$ A, B}{2020}\\resumeItem{made}\\section{Education}\\resumeSubheading{U}{City}{MSc}{2019}\\section{Skills}\\textbf{L}{: Python, SQL}"
    p = parse_arrow.latex(tex)
    assert p["experience"][0] | {"bullets": []} == {"title": "Eng", "company": "Acme", "start": "Jan 2020", "end": "Now", "location": "X", "bullets": []}
    assert p["experience"][0]["bullets"] == ["By 5% Spark"]
    assert (p["projects"][0]["name"], p["projects"][0]["tech"], p["projects"][0]["bullets"]) == ("P", ["A", "B"], ["made"])
    assert p["education"][0]["dates"] == "City"
    assert p["skills"] == ["Python", "SQL"]
    assert parse_arrow.brace_args(" {a{b}}\n{c} x{d}", 0, 3) == ["a{b}", "c"]


def test_plain_text():
    text = "EXPERIENCE\nEngineer  Acme  Jan 2020 – Present\n• Built a large pipeline in Spark\nLead Developer\nBeta Corp\nMar 2018 - Dec 2019\nEDUCATION\nState University\nMaster of Science\n2015 - 2017\nSKILLS\nLanguages: Python SQL\nxgboost, R2\nPROJECTS\n• Spark thing\nIt did many things well\n"
    p = parse_arrow.plain_text(text)
    assert [(r["title"], r["company"], r["start"]) for r in p["experience"]] == [("Engineer", "Acme", "Jan 2020"), ("Lead Developer", "Beta Corp", "Mar 2018")]
    assert p["experience"][0]["bullets"] == ["Built a large pipeline in Spark"]
    assert p["education"] == [{"institution": "State University", "degree": "Master of Science", "dates": "2015 - 2017", "location": ""}]
    assert p["skills"] == ["Python", "SQL", "xgboost", "R2"]
    assert (p["projects"][0]["tech"], p["projects"][0]["bullets"]) == (["Spark"], ["It did many things well"])


def test_arrow_parsers_enrich_natively(spark):
    p = parse_arrow.parse_plain(texts(spark, [(1, "Engineer  Acme  Jan 2020 – Present\n• Cut the cost by 40% with Spark"), (2, None)], "doc_id"))
    rows = {r.doc_id: r.profile for r in p.collect()}
    assert rows[1].experience[0].bullets[0].tools == ["Spark"]
    assert rows[2].experience == []


def test_merge_flatten_and_json(spark):
    p = profile.parse_markdown(texts(spark, [(1, "## Skills\nA, B"), (2, "## Skills\nB, C")], "doc_id")).withColumn("user_id", F.lit(7))
    m = profile.merge(p)
    assert m.first().profile.skills == ["A", "B", "C"]
    assert m.select(profile.flatten(F.col("profile")).alias("x")).first().x == "A B C"
    j = texts(spark, [(1, '{"experience": [{"title": "T", "bullets": [{"text": " "}, {"text": "Ran 5x"}]}], "skills": ["a", "a"]}'), (2, "no json")], "doc_id")
    rows = {r.doc_id: r for r in j.select("doc_id", profile.from_json(F.col("text")).alias("p"), files.json_or_text(F.col("text")).alias("t")).collect()}
    assert [b.text for b in rows[1].p.experience[0].bullets] == ["Ran 5x"]
    assert rows[1].p.skills == ["a"]
    assert rows[2].t == "no json"


def test_render(spark):
    p = profile.parse_blob(texts(spark, [(1, "Company: A & B\nDates: 2020 to \n" + "\n".join(f"- item {i}" for i in range(9)))], "doc_id"))
    tex = p.select(render.experience(F.col("profile.experience")).alias("x")).first().x
    assert tex.count("\\resumeItem{") == 6
    assert "A \\& B" in tex
    row = spark.range(1).select(render.fill(F.lit("{{A}} {{B}} {{C_D}}"), {"A": F.lit("{{B}}"), "B": F.lit("x")}).alias("t"))
    assert row.select("t", render.unfilled(F.col("t")).alias("u")).first()[:] == ("x x {{C_D}}", ["{{C_D}}"])
    s = spark.createDataFrame([("Missing: X\n1. [HIGH] Cat A\n   Missing: a, b\n2. [MEDIUM] B",)], "s string")
    assert [tuple(r) for r in s.select(render.summary_rows(F.col("s")).alias("r")).first().r] == [("HIGH", "Cat A", "a, b"), ("MEDIUM", "B", "")]


def test_pdf():
    body = b"BT 1 0 0 1 50 700 Tm (Hello) Tj 0 -20 Td [(Wor) -20 (ld) -200 (again)] TJ ET BT 1 0 0 1 50 660 Tm <48690021> Tj (x\\(y\\)) ' ET"
    pdf = b"%PDF-1.4\nstream\n" + body + b"\nendstream"
    assert files.pdf_text(pdf).splitlines()[:2] == ["Hello", "World again"]
    assert "x(y)" in files.pdf_text(pdf)
    shown = lambda body: files.pdf_text(b"stream\n" + body + b"\nendstream").splitlines()
    assert shown(b"BT (EXPERIENCE) Tj T* (Data) Tj ( Engineer) Tj 0 -14 Td (Senior) Tj 5 0 Td (ity) Tj ET") == ["EXPERIENCE", "Data Engineer", "Seniority"]
    assert shown(b"BT 1 0 0 1 50 700 Tm (Mi) Tj ET BT 1 0 0 1 58 700 Tm (ssouri) Tj ET BT 1 0 0 1 120 700 Tm (State) Tj ET") == ["Missouri State"]
    # a packed stream whose checksum ends in a line break
    texts = (f"BT (text {'a' * i}) Tj ET" for i in range(256))
    packed = next(z for t in texts if (z := zlib.compress(t.encode())).endswith(b"\n"))
    assert shown(packed)[0].startswith("text ")
    assert files.pdf_hex("00480069") == "Hi"
    assert files.pdf_hex("5458") == "TX"
    assert files.pdf_text(b"") == ""


def test_docx_and_file_sources(spark, tmp_path):
    buf = io.BytesIO()
    with zipfile.ZipFile(buf, "w") as z:
        z.writestr("word/document.xml", '<w:document xmlns:w="http://schemas.openxmlformats.org/wordprocessingml/2006/main"><w:p><w:t>Hel</w:t><w:t>lo</w:t></w:p><w:p/><w:p><w:t>World</w:t></w:p></w:document>')
    (tmp_path / "a.docx").write_bytes(buf.getvalue())
    (tmp_path / "b.docx").write_bytes(b"broken")
    rows = {r.path.rsplit("/", 1)[1]: r for r in files.read_docx(spark, str(tmp_path)).collect()}
    assert rows["a.docx"].text == "Hello\nWorld"
    assert rows["b.docx"].error
    (tmp_path / "t").mkdir()
    (tmp_path / "t" / "x.txt").write_bytes(b"a\xffb\nc")
    assert files.read_lossy(spark, str(tmp_path / "t")).first().text == "a�b\nc"


def test_stream_counts_equal_batch(spark, tmp_path):
    from folioflow.streaming import usage

    ev = spark.createDataFrame([(i, 1 + i % 2, f"2024-01-0{1 + i % 5} 00:00:00") for i in range(20)], "event_id long, user_id long, ts string").withColumn("ts", F.to_timestamp("ts"))
    ev.write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(ev.schema).parquet(str(tmp_path / "in"))
    q = usage.monthly_counts(stream).writeStream.outputMode("update").format("memory").queryName("months").option("checkpointLocation", str(tmp_path / "cp")).start()
    q.processAllAvailable()
    q.stop()
    want = sorted(tuple(r) for r in metering.monthly_usage(ev).collect())
    assert sorted(tuple(r) for r in spark.table("months").collect()) == want


def test_merge_new_and_latest(spark):
    a = spark.createDataFrame([(1, "X")], "id int, name string")
    b = spark.createDataFrame([(2, "x"), (3, "y")], "id int, name string")
    assert sorted(r.id for r in store.merge_new(a, b).collect()) == [1, 3]
    rows = spark.createDataFrame([(1, 1, "a"), (1, 2, "b")], "k int, seq int, v string")
    assert store.latest(rows, "k", "seq").first().v == "b"


def test_entry(spark):
    import __spark_entry__ as e

    assert set(e.oracle_sql()) <= set(e.queries())
    assert e.entry(spark).count() > 0


@pytest.mark.parametrize("name", ["usage_admission", "gap_signals_topn", "recent50_then_topk", "blob_parse"])
def test_oracles(spark, name):
    import duckdb

    from folioflow.plans import catalog
    from verify import plain

    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("events", "benchmark", "documents", "embeddings"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    df = catalog.queries()[name](spark, d)
    rel = db.sql(catalog.oracles()[name])
    at = {c: i for i, c in enumerate(rel.columns)}
    cols = sorted(df.columns)
    assert sorted(at) == cols
    assert sorted(str(tuple(plain(r[c]) for c in cols)) for r in df.collect()) == sorted(str(tuple(plain(r[at[c]]) for c in cols)) for r in rel.fetchall())


def test_parsers_and_scores_cover_whole_tables(spark):
    """Each query that has inline rows also runs over its whole table with them."""
    import duckdb

    from folioflow.plans import catalog
    from verify import plain

    d = "/root/testdata/sf0.001"
    db = duckdb.connect()
    for t in ("benchmark", "documents"):
        db.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{d}/{t}.parquet')")
    n = {t: db.sql(f"SELECT count(*) FROM {t}").fetchall()[0][0] for t in ("benchmark", "documents")}
    more = {"metric_extract_documents": 8, "star_score_documents": 8, "bullet_quality_documents": 8, "format_detect_documents": 7, "date_split_documents": 8, "latex_clean_documents": 5, "readme_bullets_documents": 3, "company_from_jd_benchmark": 5}
    for name, rows in more.items():
        df = catalog.queries()[name](spark, d)
        cols = sorted(df.columns)
        got = sorted(str(tuple(plain(r[c]) for c in cols)) for r in df.collect())
        assert len(got) == n[name.rsplit("_", 1)[1]] + rows, name
        rel = db.sql(catalog.oracles()[name])
        at = {c: i for i, c in enumerate(rel.columns)}
        assert got == sorted(str(tuple(plain(r[at[c]]) for c in cols)) for r in rel.fetchall()), name
    assert catalog.queries()["latex_parse"](spark, d).count() == n["documents"] + 1
    assert catalog.queries()["section_headers"](spark, d).count() > n["documents"]


def test_sinks_and_backends(spark, tmp_path):
    rows = spark.createDataFrame([("u1", "Acme", "SRE", "Jane", "x", '{"ats_score": 82}'), ("u2", "Acme", "SRE", None, "y", "{}")], "user_id string, company string, role string, first_name string, tex string, meta string")
    for _ in range(2):
        store.append_versions(extras.version_rows(rows), str(tmp_path / "versions"))
    kept = spark.read.parquet(str(tmp_path / "versions"))
    assert sorted((r.branch, r.version_tag, r.ats_score) for r in kept.collect()) == 2 * [("vault/u1", "Jane_Acme_SRE", 82)] + 2 * [("vault/u2", "Acme_SRE", None)]
    parsed = profile.parse_blob(texts(spark, [(1, "Built a thing with Spark\n- cut cost by 40%")], "doc_id"))
    files.write_profiles(parsed, str(tmp_path / "profiles"))
    assert files.read_json_lines(spark, str(tmp_path / "profiles")).first().profile == parsed.first().profile
    given = spark.createDataFrame([(1, "a", [1.0, 2.0])], "doc_id long, text string, embedding array<float>")
    assert vector.embedder("given")(given).first().embedding == [1.0, 2.0]
    assert vector.embedder()(given).first().embedding == vector.embed(given).first().embedding
    with pytest.raises(ValueError):
        vector.embedder("remote")
