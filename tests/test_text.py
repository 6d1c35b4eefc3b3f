import pytest
from pyspark.sql import functions as F

from folioflow.functions import text as X
from folioflow.functions import vocab


def one(spark, value, column):
    return spark.createDataFrame([(value,)], "t string").select(column(F.col("t")).alias("x")).first().x


@pytest.mark.parametrize(
    ("text", "want"),
    [("cut costs by 68% and 12.5 % more", ["", ".5"]), ("68% saving $4,100", [""]), ("45 min", ["min"]), ("nothing", []), ("3x", ["3x"])],
)
def test_metrics(spark, text, want):
    assert one(spark, text, X.metrics) == want


def test_tools_are_substrings_in_order(spark):
    assert one(spark, "postgresql javascript storage", X.tools) == ["SQL", "Java", "PostgreSQL", "RAG"]


def test_tokens(spark):
    assert one(spark, "CI/CD end-to-end python. C++ the of", X.tokens) == ["ci/cd", "end-to-end", "python.", "c++"]


def test_ngrams(spark):
    assert one(spark, "python", X.ngrams) == []
    assert one(spark, "a  b c", X.ngrams) == ["a b", "b c"]


@pytest.mark.parametrize(("text", "want"), [("Jan 2022 -- Present", ("Jan 2022", "Present")), ("a — b – c", ("a — b", "c")), ("2020", ("2020", "")), ("2019-2020", ("2019-2020", ""))])
def test_date_range(spark, text, want):
    assert tuple(one(spark, text, X.date_range)) == want


def test_latex(spark):
    assert one(spark, "\\textbf{A \\emph{b}} -- 5\\% \n x", X.clean_latex) == "A b – 5% x"
    assert one(spark, "a&b_{c}\\", X.escape_latex) == "a\\&b\\_\\{c\\}\\textbackslash{}"


def test_lines_and_strip(spark):
    assert one(spark, "a\r\nb\x0bc\n", X.lines) == "a\r\nb\x0bc\n".splitlines()
    assert one(spark, "", X.lines) == []
    assert one(spark, "\u00a0 x \t", X.strip) == "x"


def test_sections(spark):
    assert one(spark, "PROFESSIONAL EXPERIENCE", X.section_of) == "experience"
    assert one(spark, "Foo Technologies", X.section_of) == "skills"
    assert one(spark, "plain words", X.section_of) is None


def test_format(spark):
    assert one(spark, "\\resumeItem{x}\n## y", X.detect_format) == "latex"
    assert one(spark, "x\n## y", X.detect_format) == "markdown"
    assert one(spark, "x # y", X.detect_format) == "blob"


def test_split_years_and_dashes(spark):
    assert one(spark, "202 4", X.merge_split_years) == "2024"
    assert one(spark, "2024 t Present", X.dash_for_t) == "2024 – Present"


def test_word_limit(spark):
    long = " ".join(["word"] * 25)
    assert one(spark, long, X.word_limit).endswith("...")
    assert one(spark, "short", X.word_limit) == "short"


def test_vocabulary():
    assert len(vocab.taxonomy_rows()) == 125
    assert len(vocab.TOOLS) == 43
    assert len(vocab.STOPWORDS) == 64
    assert set(vocab.ANGLES) == set(vocab.TAXONOMY)
