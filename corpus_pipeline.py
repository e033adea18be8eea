"""Corpus preparation: language, near-duplicates, repeated passages, source mix, packing.

run() applies STAGES in order to the documents of a data folder. Each stage reads what its predecessor wrote. All but
the last return the columns of documents; the last returns a row for each packed piece.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from loomspark.llm import langid, mixing, packing, paragraph_dedup, simhash_mih
from loomspark.llm.common import materialize, ready, table


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drops what has no language: null texts and texts without a letter. Learns from the labelled rows at hand."""
    ready(spark)
    model = langid.train(docs.where(~langid.held_out("doc_id") & F.col("lang").isNotNull()).select("lang", "text"))
    judged = langid.identify(docs, model, keep=docs.columns)
    return judged.where(F.col("lang_pred") != langid.UNKNOWN).select(*docs.columns)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of SimHash near-duplicates the document with the least doc_id stays."""
    return simhash_mih.simhash_dedup(docs).select(*docs.columns)


def repeated_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Cuts paragraphs and passages that an earlier document has out of the texts; n_chars follows."""
    got = paragraph_dedup.dedup_paragraphs(docs)
    if "n_chars" in docs.columns:
        got = got.withColumn("n_chars", F.coalesce(F.length("text"), F.lit(0)).cast(docs.schema["n_chars"].dataType))
    return got.select(*docs.columns)


def source_mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Repeats and drops documents so that the sources' words come near their target shares."""
    return mixing.mixed_documents(docs).select(*docs.columns)


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token sequences of at most 4096 ids."""
    return packing.pack_documents(docs)


STAGES = [
    ("language ID", language),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_passages),
    ("source mix", source_mix),
    ("best-fit packing", packing_stage),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = materialize(stage(spark, docs, sf_dir), name.replace(" ", "-").lower())
    return STAGES[-1][1](spark, docs, sf_dir)


#: The language model, fingerprints and tokenizer have no SQL form; tests compare with brute force.
ORACLE_SQL = None
