"""The corpus pipeline: documents to tokens, five stages, each on all rows that its predecessor kept.

Each stage takes ``(spark, docs, sf_dir)`` and returns a frame. All but the last
return the columns of ``docs``. Between stages rows are written as Parquet to
the shared folder and read back, so a lost executor never repeats a whole stage.

1. quality: documents that the classifier rejects go.
2. near duplicates: one document of each class stays (that of the least doc_id).
3. secrets: each secret in a text is replaced by ``[SECRET]``; ``n_chars`` follows.
4. mixing: the rows that the mix takes, each at most once (one epoch).
5. tokens: SentencePiece ids of each document, with parity and round trip.

Defined cases, all stages: a null text is read as empty and stays null; a null
``doc_id``, ``lang`` or ``source`` is a value like any other; texts of any length
are read whole; an empty table gives an empty table; further columns pass
untouched, whatever their names. Ties and repeated rows:

1. each row is judged alone, so equal texts of equal size share one fate;
2. of rows that are copies, one stays (least doc_id, a null one last); of rows
   that repeat its doc_id and text, one;
3. rows are redacted alone; repeated rows count as often in the thresholds;
4. rows of one doc_id and leaf are ordered by the seed and then by text;
5. each row is encoded; columns with the names of the new ones are replaced.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from folioflow.llm import mixing, near_dup, quality, secrets, spm
from folioflow.llm.common import materialise, read_table

#: Nine tenths of the tokens that are left, every document at most once.
MIX = mixing.Recipe(share=900, max_epochs=1)


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return quality.keep_good(docs, read_table(spark, sf_dir, "labels"), read_table(spark, sf_dir, "documents"))


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return near_dup.one_of_each(docs)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    out = secrets.redact_documents(docs)
    if "n_chars" in out.columns:
        length = F.coalesce(F.char_length("text").cast(out.schema["n_chars"].dataType), F.col("n_chars"))
        out = out.select(*[length.alias(c) if c == "n_chars" else F.col(f"`{c}`") for c in out.columns])
    return out


def mix_sources(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return mixing.mixed_documents(docs, MIX)


def encode_tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return spm.encode_documents(docs)


STAGES = [
    ("quality_classifier", keep_quality),
    ("near_duplicates", drop_near_duplicates),
    ("secret_scan", redact_secrets),
    ("source_mixing", mix_sources),
    ("sentencepiece", encode_tokens),
]
#: A trained classifier and signatures can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialise(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
