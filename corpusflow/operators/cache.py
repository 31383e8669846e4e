"""Answer cache: exact and semantic hits of a batch of questions, eviction, statistics."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.operators import dense


def key(c: Column) -> Column:
    return F.sha1(tx.cache_key_text(c))


def live(cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    return cache.where(now.cast("double") - F.col("created_at").cast("double") <= ttl_seconds)


def exact_hits(queries: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int) -> DataFrame:
    """(query_id, entry_id, answer): the newest live entry with the same key.

    The cache is cut to one entry per key before the join, so repeated entries never multiply rows.
    """
    c = live(cache, now, ttl_seconds).groupBy("query_hash").agg(F.max(F.struct("created_at", "entry_id", "answer")).alias("e"))
    return queries.select("query_id", key(F.col("text")).alias("query_hash")).join(c, "query_hash").select(
        "query_id", "e.entry_id", "e.answer")


def semantic_hits(queries: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int, threshold: float = rules.CACHE_THRESHOLD) -> DataFrame:
    """(query_id, entry_id, similarity): the most similar live entry at or above the threshold."""
    best = dense.exact_top_k(queries, live(cache, now, ttl_seconds), 1, "query_id", "entry_id", "embedding", metric="cosine")
    return best.where(F.col("score") >= threshold).select("query_id", F.col("chunk_id").alias("entry_id"), F.col("score").alias("similarity"))


def lookup(queries: DataFrame, cache: DataFrame, now: Column, ttl_seconds: int, threshold: float = rules.CACHE_THRESHOLD) -> DataFrame:
    """Every question with its hit kind: exact, semantic (only tried without exact hit) or miss."""
    ex = exact_hits(queries, cache, now, ttl_seconds)
    rest = queries.join(ex.select("query_id"), "query_id", "left_anti")
    se = semantic_hits(rest, cache, now, ttl_seconds, threshold)
    a = ex.select("query_id", "entry_id", F.lit("exact").alias("cache_type"), F.lit(1.0).alias("similarity")).unionByName(
        se.select("query_id", "entry_id", F.lit("semantic").alias("cache_type"), F.round("similarity", 4).alias("similarity")))
    return queries.select("query_id").join(a, "query_id", "left").withColumn("cache_type", F.coalesce("cache_type", F.lit("miss")))


def stats(hits: DataFrame) -> DataFrame:
    return hits.groupBy("cache_type").agg(F.count("*").alias("n"))


def evict(cache: DataFrame, now: Column, ttl_seconds: int, max_entries: int, created: str = "created_at", entry_id: str = "entry_id") -> DataFrame:
    """Live entries, at most the newest ``max_entries``; a distributed top-n, no sort of all rows."""
    at = F.col(created)
    if not isinstance(cache.schema[created].dataType, T.NumericType):
        at = at.cast("timestamp")
    kept = cache.where(now.cast("double") - at.cast("double") <= ttl_seconds)
    return kept.orderBy(F.desc(entry_id)).limit(max_entries)
