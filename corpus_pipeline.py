"""From raw documents to packed training sequences, in five stages.

Every stage takes the rows its predecessor kept, whole texts of any length, and
gives no rows for an empty table. Null ids, languages, sources and counts are
carried like any other value; columns other than those of ``documents`` are kept
by all stages but the last.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from finsieve.llm import exact_dedup, jaccard_join, language_id, packing, secret_scan
from finsieve.session import scratch_path


def identify_languages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Writes the predicted language to ``lang``; documents without one (null or empty text, no letter) go.

    The model learns from the labelled rows of ``docs``; without any no language is
    predicted and all rows go. Repeated rows are judged alike.
    """
    model = language_id.fit_language_model(docs)
    found = language_id.identify(docs, model)
    return found.filter(F.col("lang_pred") != language_id.UNKNOWN).withColumn("lang", F.col("lang_pred")).select(*docs.columns)


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents that are equal but for white space the one with the most characters stays, then the smallest id (null last).

    Of rows that tie in both any one stays. Null and empty texts are equal to each other.
    """
    return exact_dedup.exact_dedup(docs).kept_documents()


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of documents linked by shared five-word shingles (similarity 0.8 or more) the one with the smallest id stays.

    Null ids are last; of repeated rows exactly one stays. Texts without words link with nothing and stay.
    """
    return jaccard_join.one_of_each_group(docs, jaccard_join.Similarity(words=5, percent=80))


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Replaces secrets inside texts and counts ``n_chars`` again; every row stays, repeated, null and empty ones too."""
    return secret_scan.redact(docs, secret_scan.fit_forest(secret_scan.labelled_by_rule(spark)))


def pack_sequences(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all rows with their places in sequences of 2048 tokens; a null or empty text is its end mark alone, repeated rows are packed each."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", identify_languages),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("secret scans", redact_secrets),
    ("best-fit packing", pack_sequences),
]

#: The models and the tokenizer are beyond SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each stage's result is stored and read again as the next one's input."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        path = scratch_path(spark, name.replace(" ", "-").lower())
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs
