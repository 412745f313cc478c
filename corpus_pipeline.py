"""A corpus pipeline over ``documents``, in stages that each call one operator.

Each stage takes (spark, docs, sf_dir) and returns a DataFrame, which is written as
Parquet and read again as the next one's ``docs``. All but the last return the columns
of ``documents``.

Defined results: null texts and texts without a letter go in the first stage; nothing else goes there, also
where no language can be learned. Without labels of both kinds nothing is rejected as toxic. A row without a
doc_id is never a near duplicate of another. Rows that repeat a doc_id and its text count as
copies, of which the one with the least other columns stays; different texts under one doc_id all stay.
Tables may be empty, and may have more columns, which are left out.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from colligate import ship
from colligate.llm import jaccard, language, packing, secrets, toxicity
from colligate.llm.common import shared_path

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def identify_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents whose language can be told; those without a letter go, and so
    do null texts. The profiles are learned from the documents that aren't held out."""
    profiles = language.learned(spark, sf_dir)
    if not profiles.languages:  # whoever has a letter has a language, only not a known one
        return docs.filter(F.col("text").rlike(r"\p{L}")).select(*COLUMNS)
    found = language.identify(docs, profiles, keep=["text", "lang", "source", "n_chars"])
    return found.filter(F.col("lang_pred") != language.UNDETERMINED).select(*COLUMNS)


def reject_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps documents that aren't predicted to be toxic."""
    scored = toxicity.score(docs, toxicity.learned(spark, sf_dir), keep={c: F.col(c) for c in COLUMNS})
    return scored.filter("predicted = 0").select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keeps the document with the smallest id of each group that is linked by sharing
    80 % or more of their five-word shingles."""
    docs = docs.select(*COLUMNS)
    kept = jaccard.link(docs, width=5, percent=80).filter("doc_id = component_id").select("doc_id")
    named = docs.join(kept, "doc_id", "left_semi").select(*COLUMNS)
    again = kept.groupBy("doc_id").agg(F.count("*").alias("n")).filter("n > 1").select("doc_id")
    if not again.isEmpty():
        rows = named.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct("lang", "source", "n_chars")).alias("r"))
        named = named.join(again, "doc_id", "left_anti").select(*COLUMNS).union(rows.select("doc_id", "text", "r.lang", "r.source", "r.n_chars"))
    return named.union(docs.filter("doc_id is null"))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces every secret by its kind; keeps every document."""
    hidden = secrets.redact(docs.select(*COLUMNS))
    return hidden.withColumn("n_chars", F.length("text").cast("long")).select(*COLUMNS)


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their sequence and place in it."""
    return packing.pack(docs.select("doc_id", "text"))


STAGES = [
    ("language", identify_language),
    ("toxicity", reject_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("secrets", redact_secrets),
    ("packing", pack_sequences),
]

#: Models, merges and a search decide the rows; tests/llm/test_pipeline.py holds the stages against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The stages applied to ``documents``, each one's rows written and read again."""
    ship(spark)
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        out, path = stage(spark, docs, sf_dir), shared_path(spark, f"stage-{name}")
        out.write.parquet(path)
        docs = spark.read.schema(out.schema).parquet(path)
    return docs
