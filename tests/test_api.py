import pytest

from folioflow.operators import extras
from folioflow.plans import api

ROWS = [(1, "u", "Company: Acme\nTitle: Engineer\n- Built 5 pipelines with Spark", "blob"), (2, "u", "## Skills\nSQL, Spark", None), (3, "v", " ", "blob"), (4, "v", "x", "rtf")]


def docs(spark):
    return spark.createDataFrame(ROWS, "doc_id long, user_id string, text string, format string")


def test_extract_has_errors_instead_of_failures(spark):
    rows = {r.doc_id: r for r in api.extract_profiles(docs(spark)).collect()}
    assert len(rows) == 4
    assert rows[1].profile.experience[0].company == "Acme"
    assert rows[2].profile.skills == ["SQL", "Spark"]
    assert (rows[3].error, rows[4].error) == ("text is empty", "unknown format: rtf")


def test_run_all_merges_a_users_artifacts(spark):
    jds = spark.createDataFrame([(1, "spark pipelines engineer")], "jd_id long, text string")
    out = {r.doc_id: r for r in api.run_all(jds, docs(spark), "{{NAME}} {{SKILLS_SECTION}} {{X}}", {"NAME": "A"}).collect()}
    assert set(out) == {"u", "v"}
    assert "SQL, Spark" in out["u"].tex
    assert out["u"].unfilled == ["{{X}}"]
    assert out["u"].score > out["v"].score


def test_table_function(spark):
    api.register(spark)
    text = "Engineer  Acme  Jan 2020 – Present"
    row = spark.sql(f"SELECT r.* FROM VALUES ('{text}') AS t(x), LATERAL parse_resume(x, 'plain') r").first()
    assert (row.title, row.company, row.finish) == ("Engineer", "Acme", "Present")


def test_score_methods(spark):
    jds = spark.createDataFrame([(1, "spark sql")], "jd_id long, text string")
    d = spark.createDataFrame([(1, "spark sql")], "doc_id long, text string")
    assert extras.score(jds, d, "Embedding").first().score == 100
    assert extras.score(jds, d, "claude").first().method_used == "formula (fallback)"
    with pytest.raises(ValueError):
        extras.score(jds, d, "other")
