"""The dealt operators as queries over whole tables, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

from corpusflow.llm import bpe, fingerprints, language, matroska, merkle, near_dedup, packing, passages, periods, pii, toxicity, twins, urls, wavelet
from corpusflow.llm.tables import table
from corpusflow.llm.vocab import public_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(spark, sf_dir) -> DataFrame`` under ``name``."""

    def add(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return add


@query("op1_min_bin_slack_packing")
def op1(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(table(spark, sf_dir, "documents"), "doc_id", "text", public_path("byte_bpe_50k.json"), 1)


@query("op3_pair_index_bpe")
def op3(spark: SparkSession, sf_dir: str) -> DataFrame:
    return bpe.round_trip(table(spark, sf_dir, "documents"), "doc_id", "text", public_path("word_bpe_49k.json"))


@query("op7_wavelet_shards")
def op7(spark: SparkSession, sf_dir: str) -> DataFrame:
    return wavelet.shards(table(spark, sf_dir, "documents"), "doc_id", "text", public_path("word_bpe_49k.json"), 2)


@query("op8_host_reputation", urls.oracle())
def op8(spark: SparkSession, sf_dir: str) -> DataFrame:
    return urls.judge(table(spark, sf_dir, "pages"), urls.bad_documents(table(spark, sf_dir, "labels")), "page_id", "url")


@query("op10_matroska_packets")
def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matroska.stored_media(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op5_language_id")
def op5(spark: SparkSession, sf_dir: str) -> DataFrame:
    return language.identify(table(spark, sf_dir, "documents"))


@query("op9_severity_grades")
def op9(spark: SparkSession, sf_dir: str) -> DataFrame:
    return toxicity.judge(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))


@query("op4_bottom_k_fingerprints")
def op4(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints.edited_fingerprints(table(spark, sf_dir, "documents"))


@query("op6_feistel_pseudonyms")
def op6(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii.protect(table(spark, sf_dir, "documents"))


@query("op2_bayes_minhash_dedup")
def op2(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_dedup.near_duplicates(table(spark, sf_dir, "documents"), "doc_id", "text")


@query("op13_block_convolution_runs", twins.PERIODS)
def op13(spark: SparkSession, sf_dir: str) -> DataFrame:
    return periods.periodic_runs(table(spark, sf_dir, "documents"), "doc_id", "text", altered=periods.repeated_tail)


@query("op11_superblock_manifest", twins.MANIFEST)
def op11(spark: SparkSession, sf_dir: str) -> DataFrame:
    return merkle.manifest(table(spark, sf_dir, "documents"), altered=merkle.one_more_character())


@query("op12_suffix_automata_passages", twins.PASSAGES)
def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    return passages.without_repeats(table(spark, sf_dir, "documents"), "doc_id", "text")
