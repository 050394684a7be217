"""Registered queries of the operators on licences, mixing, token files, personal data and benchmark leaks."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidemark.llm import decontaminate, licenses, mixing, pii, token_counts
from tidemark.llm.tables import query, table
from tidemark.plans.staging import stage


@query("op6_mix_sources")
def op6_mix_sources(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    sized = stage(documents.select("doc_id", "source", mixing.word_count(F.col("text")).alias("n")))
    belongs, size = F.array(F.col("source")), F.col("n")
    plan, sources = mixing.plan_mix(sized, belongs, size)
    mixed = mixing.apply_mix(sized, plan, belongs, size)
    return mixed.join(sources, F.col("source").eqNullSafe(F.col("_source")), "left").select(
        "doc_id", F.col("_size").alias("size"), F.round("source_size").cast("long").alias("source_size"), "target",
        (F.col("_copies") * F.col("_size")).alias("taken"))


@query("op10_decontaminate")
def op10_decontaminate(spark, sf_dir):
    return decontaminate.leaks(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


@query("op8_personal_data")
def op8_personal_data(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return pii.find(documents, pii.train(documents))


@query("op5_license_scan")
def op5_license_scan(spark, sf_dir):
    documents = table(spark, sf_dir, "documents")
    return licenses.scan(documents, licenses.train(documents))


@query("op7_token_counts")
def op7_token_counts(spark, sf_dir):
    import public_tokenizers as public

    vocabulary = public.path("byte_bpe_50k.tiktoken")
    return token_counts.document_tokens(table(spark, sf_dir, "documents"), vocabulary, public.PATTERN)
