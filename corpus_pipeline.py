"""A training corpus from the documents table: known language, not toxic, one of each near-duplicate group, pseudonyms, packed.

Each stage takes (spark, docs, sf_dir) and works on all that the stage before it kept. All but the last return the columns of
``docs`` (extra columns stay); the last returns the pieces of the packed sequences. Null and empty texts have no language
and go in the first stage; an empty table passes through every stage.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.llm import language, near_dedup, packing, pii, toxicity
from corpusflow.llm.tables import bound_batches, stored, table
from corpusflow.llm.vocab import public_path

ORACLE_SQL = None  # trained models, hashing and tokenizers can't be said in SQL


def keep_known_language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is known; learned from the table's own labels."""
    bound_batches(spark)
    return language.known_language(docs)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that aren't toxic; learned from the labels table."""
    return toxicity.not_toxic(docs, table(spark, sf_dir, "labels"))


def keep_one_of_each_group(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates (five-word shingles, similarity of at least 0.8)."""
    return near_dedup.one_of_each_group(docs, "doc_id", "text")


def pseudonyms(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced; the character count follows the text."""
    out = pii.pseudonymise(docs, "text")
    if "n_chars" in docs.columns:
        out = out.withColumn("n_chars", F.char_length("text").cast(docs.schema["n_chars"].dataType))
    return out.select(*docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of sequences of 2048 ids."""
    bound_batches(spark)
    return packing.pack(docs, "doc_id", "text", public_path("byte_bpe_50k.json"), 1)


STAGES = [
    ("language", keep_known_language),
    ("toxicity", drop_toxic),
    ("near_dedup", keep_one_of_each_group),
    ("pii", pseudonyms),
    ("packing", pack),
]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table; each but the last is written and read again."""
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), f"pipeline-{name}")
    return STAGES[-1][1](spark, docs, sf_dir)
