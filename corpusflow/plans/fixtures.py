"""How the driver tables stand for chunks, queries, papers and so on."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text
from corpusflow.operators import chunking, lexical, neighbours, sparse
from corpusflow.operators.lexical import LexicalIndex
from corpusflow.plans.registry import table, texts
from corpusflow.sources.indexes import lasting


def chunks(spark: SparkSession, d: str) -> DataFrame:
    """Leaf chunks (windows of 500 characters) of all documents, with parent and root ids; cut once per table."""
    return lasting(spark, "windows", (chunking,), f"{d}/documents.parquet")(lambda: _chunks(spark, d), "chunks")


def document_index(spark: SparkSession, d: str) -> LexicalIndex:
    """The lasting term index over whole documents."""
    return LexicalIndex(texts(spark, d), "doc_id", keep=lasting(spark, "documents", (lexical, sparse, text), f"{d}/documents.parquet"))


def chunk_index(spark: SparkSession, d: str) -> LexicalIndex:
    """The lasting term index over leaf chunks."""
    return LexicalIndex(chunks(spark, d), "chunk_id", keep=lasting(spark, "windows", (chunking, lexical, sparse, text), f"{d}/documents.parquet"))


def vector_index(spark: SparkSession, d: str) -> DataFrame:
    """The lasting neighbour graphs of the embeddings."""
    keep = lasting(spark, "embeddings", (neighbours,), f"{d}/embeddings.parquet")
    return keep(lambda: neighbours.build(table(spark, d, "embeddings"), "vec_id"), "graphs")


def _chunks(spark: SparkSession, d: str) -> DataFrame:
    docs = texts(spark, d).select("doc_id", "source", "text")
    w = chunking.fixed_windows(docs, "doc_id", 500, 60)
    f = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    p = F.lit(0)
    return w.select(
        "doc_id", "source", "chunk_idx", f.alias("filename"),
        chunking.chunk_id(f, p, 3, F.col("chunk_idx")).alias("chunk_id"),
        chunking.chunk_id(f, p, 2, F.floor(F.col("chunk_idx") / 2)).alias("parent_chunk_id"),
        chunking.chunk_id(f, p, 1, F.floor(F.col("chunk_idx") / 4)).alias("root_chunk_id"),
        "start_index", "text")


def tree(spark: SparkSession, d: str) -> DataFrame:
    """Chunks of all three levels with their texts, stored once: a parent covers two children, a root four leaves."""
    return lasting(spark, "windows", (chunking,), f"{d}/documents.parquet")(lambda: _tree(spark, d), "tree")


def _tree(spark: SparkSession, d: str) -> DataFrame:
    names = ["doc_id", "source", "chunk_id", "parent_chunk_id", "text"]
    out = _chunks(spark, d).select(*names, F.lit(3).alias("chunk_level"))
    return out.unionByName(_upper(spark, d, 2)).unionByName(_upper(spark, d, 1))


def _upper(spark: SparkSession, d: str, level: int) -> DataFrame:
    leaves = {2: 2, 1: 4}[level]
    docs = texts(spark, d).where(F.length("text") > 0).select("doc_id", "source", "text")
    name = F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt"))
    last = F.greatest(F.lit(0), F.ceil((F.length("text") - 500) / 440)).cast("int")
    rows = docs.select("*", F.explode(F.sequence(F.lit(0), F.floor(last / leaves).cast("int"))).alias("i"))
    parent = chunking.chunk_id(name, F.lit(0), 1, F.floor(F.col("i") / 2)) if level == 2 else F.lit("")
    text_ = F.substring(F.col("text"), F.col("i") * (440 * leaves) + 1, F.lit(440 * leaves + 60))
    return rows.select("doc_id", "source", chunking.chunk_id(name, F.lit(0), level, F.col("i")).alias("chunk_id"), parent.alias("parent_chunk_id"),
                       text_.alias("text"), F.lit(level).alias("chunk_level"))


def roots(spark: SparkSession, d: str) -> DataFrame:
    """The root chunks of :func:`tree`, made in place: who needs no more than them doesn't have to store the other levels."""
    return _upper(spark, d, 1)


def tree_index(spark: SparkSession, d: str) -> LexicalIndex:
    """The lasting term index over chunks of all levels."""
    return LexicalIndex(tree(spark, d), "chunk_id", keep=lasting(spark, "tree", (chunking, lexical, sparse, text), f"{d}/documents.parquet"))


def parents(chunk_table: DataFrame) -> DataFrame:
    """Parent rows of both upper levels."""
    l2 = chunk_table.select(F.col("parent_chunk_id").alias("chunk_id"), F.col("root_chunk_id").alias("parent_chunk_id")).distinct()
    l1 = chunk_table.select(F.col("root_chunk_id").alias("chunk_id")).distinct().withColumn("parent_chunk_id", F.lit(""))
    return l2.unionByName(l1)


def queries(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "benchmark").select(F.col("item_id").alias("query_id"), "text")


def query_vectors(spark: SparkSession, d: str) -> DataFrame:
    """Queries with the vector of the same id."""
    e = table(spark, d, "embeddings").select(F.col("vec_id").alias("query_id"), "embedding")
    return queries(spark, d).join(e, "query_id")
