"""Corpus pipeline: quality, near-duplicates, benchmark leaks, personal data, mixing.

Every stage takes (spark, docs, sf_dir) and works on all the documents that the one before it kept; the
frame it returns is written as Parquet and read again as the next one's ``docs``. All but the last return
the columns of ``documents``.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidemark.llm import cnn_quality, decontaminate, mixing, near_dedup, pii
from tidemark.llm.tables import table, unused
from tidemark.plans.staging import stage


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the quality classifier does not reject; it learns from the labelled ones among ``docs``."""
    return cnn_quality.keep_good(docs, cnn_quality.train(docs, table(spark, sf_dir, "labels")))


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates: five-word shingles, similarity 0.8 or more."""
    return near_dedup.dedup(docs)


def keep_untainted(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that hold no benchmark item."""
    return decontaminate.drop_leaks(docs, table(spark, sf_dir, "benchmark"))


def hide_personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, personal data in their texts replaced by its kind and n_chars told anew."""
    return pii.redact(docs, pii.train(docs)).withColumn("n_chars", F.length("text").cast("long"))


def mix_to_weights(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the mix takes, with their columns, ``n_words`` and ``copies`` (1 to 3).

    Where ``docs`` has a column of one of these names, the mix's own gets an underscore behind it.
    """
    size, belongs = mixing.word_count(F.col("text")), F.array(F.col("source"))
    sized = stage(docs.select("doc_id", "source", size.alias("n_words")))
    plan, _ = mixing.plan_mix(sized, belongs, F.col("n_words"))
    names = tuple(unused(name, docs) for name in ("_sources", "n_words", "copies"))
    return mixing.apply_mix(docs, plan, belongs, size, names=names).where(F.col(names[2]) > 0).drop(names[0])


STAGES: list[tuple[str, Callable[[SparkSession, DataFrame, str], DataFrame]]] = [
    ("quality classifier", keep_quality),
    ("near-duplicates", keep_one_of_each),
    ("benchmark decontamination", keep_untainted),
    ("personal data", hide_personal_data),
    ("mixing sources", mix_to_weights),
]
#: No stage but the last can be said in SQL; tests hold each one against a plain version.
ORACLE_SQL: str | None = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, apply in STAGES[:-1]:
        docs = stage(apply(spark, docs, sf_dir))
    return STAGES[-1][1](spark, docs, sf_dir)
