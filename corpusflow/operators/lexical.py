"""BM25: corpus-wide statistics, term weights and top-k for many queries at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.functions.skew import salted_join, top_k
from corpusflow.operators.sparse import sparse_top_k, term_vectors
from corpusflow.session import materialize


def vectors(docs: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, dl, terms, tfs): the term counts of every document, made in place."""
    return term_vectors(docs, id_col, text_col, tx.index_words, tx.index_pieces)


def postings(vec: DataFrame, id_col: str) -> DataFrame:
    """(id, dl, term, tf): the same as rows."""
    long = vec.select(id_col, "dl", F.inline(F.arrays_zip(F.col("terms").alias("term"), F.col("tfs").alias("tf"))))
    return long.toDF(id_col, "dl", "term", "tf")


def corpus_stats(vec: DataFrame) -> DataFrame:
    """One row: number of documents and mean length, documents without terms included."""
    return vec.agg(F.count("*").alias("n_docs"), F.coalesce(F.avg("dl"), F.lit(1.0)).alias("avg_dl"))


def document_frequency(post: DataFrame) -> DataFrame:
    return post.groupBy("term").agg(F.count("*").alias("df"))


def idf(df: Column, n: Column) -> Column:
    seen = F.log((n - df + 0.5) / (df + 0.5) + 1)
    return F.when(F.coalesce(df, F.lit(0)) == 0, F.log(n + 1)).otherwise(seen)


def bm25(tf: Column, dl: Column, idf_: Column, avg_dl: Column) -> Column:
    k1, b = rules.BM25_K1, rules.BM25_B
    norm = tf + k1 * (1 - b + b * dl / F.greatest(avg_dl, F.lit(1.0)))
    return idf_ * (tf * (k1 + 1)) / norm


def _scalars(stats: DataFrame) -> tuple[Column, Column]:
    return stats.select("n_docs").scalar(), stats.select("avg_dl").scalar()


def document_weights(post: DataFrame, df: DataFrame, stats: DataFrame, id_col: str) -> DataFrame:
    """(id, term, weight) with positive BM25 weights. Frequent terms are salted over tasks."""
    n, avg = _scalars(stats)
    scored = salted_join(post, df, "term", "df", F.xxhash64(id_col))
    out = scored.select(id_col, "term", bm25(F.col("tf"), F.col("dl"), idf(F.col("df"), n), avg).alias("weight"))
    return out.where("weight > 0")


def query_weights(queries: DataFrame, df: DataFrame, stats: DataFrame, id_col: str, text_col: str = "text") -> DataFrame:
    """(id, term, weight, df): BM25 weights of query terms against the corpus statistics; unseen terms get the highest idf."""
    n, avg = _scalars(stats)
    q = postings(vectors(queries, id_col, text_col), id_col)
    # the query side may repeat a term often, the frequency table holds it once
    used = df.join(q.groupBy("term").agg(F.count("*").alias("_qn")), "term", "right")
    j = salted_join(q, used, "term", "_qn", F.xxhash64(id_col))
    return j.select(id_col, "term", bm25(F.col("tf"), F.col("dl"), idf(F.col("df"), n), avg).alias("weight"), "df").where("weight > 0")


class LexicalIndex:
    """The tables of an index over one text column.

    Term vectors are written once to the shared work folder; texts are tokenized once, without a shuffle, and
    statistics and searches read the compact table. ``keep(make, label)`` may name a lasting place for it
    (:func:`corpusflow.sources.indexes.lasting`), so that later searches start from it.
    """

    def __init__(self, docs: DataFrame, id_col: str, text_col: str = "text", keep=None):
        self.id_col = id_col
        keep = keep or (lambda make, label: materialize(make(), label))
        self.vec = keep(lambda: vectors(docs, id_col, text_col), "vectors")
        self.post = postings(self.vec, id_col)
        self.df = keep(lambda: document_frequency(self.post), "frequencies")
        self.stats = keep(lambda: corpus_stats(self.vec), "statistics")

    def weights(self) -> DataFrame:
        """(id, term, weight) of all documents."""
        return document_weights(self.post, self.df, self.stats, self.id_col)

    def scaled(self, only: Column | None = None) -> DataFrame:
        """Vectors with the document part of BM25, everything but the idf."""
        avg = self.stats.select("avg_dl").scalar()
        w = F.transform("tfs", lambda tf: bm25(tf.cast("double"), F.col("dl"), F.lit(1.0), F.col("_avg")))
        v = self.vec.withColumn("_avg", avg)
        v = v.withColumnRenamed(self.id_col, "chunk_id")
        return (v if only is None else v.where(only)).select("chunk_id", "dl", "terms", w.alias("weights"))

    def search(self, queries: DataFrame, query_id: str, k: int, text_col: str = "text", only: Column | None = None) -> DataFrame:
        """Inner product of query and document weights, best ``k`` per query.

        ``only`` is a condition on ``chunk_id``: other documents count in the statistics, but are left behind at the scan.
        """
        n, avg = _scalars(self.stats)
        q = postings(vectors(queries, query_id, text_col), query_id)
        # terms without a document cannot score, so the small side may be sent to the frequency table
        i = idf(F.col("df"), n)
        e = q.join(self.df, "term").select(
            F.col(query_id).alias("query_id"), "term", (bm25(F.col("tf"), F.col("dl"), i, avg) * i).alias("w"), F.lit(0).alias("qlen")).where("w > 0")
        return sparse_top_k(self.scaled(only), materialize(e, "query-terms"), k)

    def match(self, queries: DataFrame, query_id: str, k: int, boost: float = 1.0, text_col: str = "text", only: Column | None = None) -> DataFrame:
        """Document weights of the distinct query terms added up."""
        n = self.stats.select("n_docs").scalar()
        t = queries.select(F.col(query_id).alias("query_id"), F.explode_outer(F.array_distinct(tx.index_terms(F.col(text_col)))).alias("term")).where("term is not null")
        e = t.join(self.df, "term").select("query_id", "term", (idf(F.col("df"), n) * boost).alias("w"), F.lit(0).alias("qlen"))
        return sparse_top_k(self.scaled(only), materialize(e, "query-terms"), k)


def text_match(docs: DataFrame, queries: DataFrame, id_col: str, query_id: str, k: int = 10) -> DataFrame:
    """Match query texts against one field: every query term counts once, the idf once."""
    return LexicalIndex(docs, id_col).match(queries, query_id, k)


def field_scores(
    fields: dict[str, float], docs: DataFrame, queries: DataFrame, id_col: str, query_id: str, k: int, only: Column | None = None
) -> DataFrame:
    """Best-field score: BM25 per field times its weight, the highest field counts per document.

    A document among the ``k`` best is among the ``k`` best of the field that gives its score, so the
    best of every field are enough. ``only`` is a condition on ``chunk_id``, such as a filter by level.
    """
    legs = None
    for name, boost in fields.items():
        s = LexicalIndex(docs.where(F.col(name) != ""), id_col, name).match(queries, query_id, k, boost, only=only).drop("rank")
        legs = s if legs is None else legs.unionByName(s)
    best = legs.groupBy("query_id", "chunk_id").agg(F.max("score").alias("score"))
    return top_k(best, ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)
