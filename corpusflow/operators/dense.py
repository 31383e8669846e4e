"""Vector search: exact top-k by block products, cosine, recall. For approximate search see ``neighbours``."""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from corpusflow.functions.skew import top_k
from corpusflow.operators.sparse import Best, ids_of

BLOCK_ROWS = 4096
BROADCAST_VALUES = 16_000_000  # 128 MB of doubles
DIGITS = 9


def check_dimension(vectors: DataFrame, column: str, expected: int) -> DataFrame:
    """One row with the vector lengths found; ``ok`` is false on any mismatch."""
    return vectors.agg(
        F.count("*").alias("n"), F.min(F.size(column)).alias("min_dim"), F.max(F.size(column)).alias("max_dim")
    ).withColumn("ok", (F.col("min_dim") == expected) & (F.col("max_dim") == expected))


def require_dimension(vectors: DataFrame, column: str, expected: int) -> None:
    row = check_dimension(vectors, column, expected).first()
    if row["n"] and not row["ok"]:
        raise ValueError(f"vector length {row['min_dim']}..{row['max_dim']} found, {expected} expected")


def dot(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double"))
    return F.aggregate(pairs, F.lit(0.0), lambda s, x: s + x)


def cosine(a: Column, b: Column) -> Column:
    """Cosine; zero when a vector is missing, empty, zero or of another length."""
    norms = F.sqrt(dot(a, a)) * F.sqrt(dot(b, b))
    bad = a.isNull() | b.isNull() | (F.size(a) != F.size(b)) | (F.size(a) == 0)
    return F.when(bad, 0.0).otherwise(F.coalesce(F.try_divide(dot(a, b), norms), F.lit(0.0)))


def _matrix(col: pd.Series) -> np.ndarray:
    return np.array(col.tolist(), dtype=np.float64)


def _unit(m: np.ndarray) -> np.ndarray:
    n = np.linalg.norm(m, axis=1, keepdims=True)
    return np.divide(m, n, out=np.zeros_like(m), where=n > 0)


def _add_block(best: Best, first: int, qm: np.ndarray, cid: np.ndarray, cm: np.ndarray) -> None:
    """Add the products of a block of queries with a block of chunks to the running best."""
    s = np.round(qm @ cm.T, DIGITS) + 0.0
    edge = best.edge[first:first + len(qm)]
    if len(cid) > best.k:
        kth = np.partition(s, len(cid) - best.k, axis=1)[:, len(cid) - best.k]
        edge = np.maximum(edge, kth)
    q, c = np.nonzero(s >= edge[:, None])
    best.add(q + first, s[q, c], cid[c])


def _scan_block(best: Best, qm: np.ndarray, cid: np.ndarray, cm: np.ndarray) -> None:
    step = max(1, BLOCK_ROWS * 1024 // max(1, len(cid)))
    for i in range(0, len(qm), step):
        _add_block(best, i, qm[i:i + step], cid, cm)


def _frame(best: Best, qid: np.ndarray) -> pd.DataFrame:
    ids = best.i if best.i is not None else np.zeros(0, np.int64)
    return pd.DataFrame({"query_id": qid[best.q], "chunk_id": ids, "score": best.s})


def exact_top_k(
    queries: DataFrame,
    chunks: DataFrame,
    k: int,
    query_id: str,
    chunk_id: str,
    vector: str = "embedding",
    metric: str = "ip",
) -> DataFrame:
    """(query_id, chunk_id, score, rank): exact top-k by inner product or cosine.

    Scores are matrix products inside tasks and each task keeps ``k`` rows per query, so the pairs never become rows.
    Queries are cut into batches of at most ``BROADCAST_VALUES`` numbers, one batch as a rule. A batch goes to every
    task, and the chunks are scanned in place, without a shuffle, once for each batch.
    """
    q = queries.select(F.col(query_id).alias("query_id"), F.col(vector).alias("v")).where("v is not null")
    c = chunks.select(F.col(chunk_id).alias("chunk_id"), F.col(vector).alias("v")).where("v is not null")
    qt, ct = q.schema["query_id"].dataType.simpleString(), c.schema["chunk_id"].dataType.simpleString()
    schema = f"query_id {qt}, chunk_id {ct}, score double"
    unit = metric == "cosine"
    size = q.agg(F.count("*").alias("n"), F.coalesce(F.sum(F.size("v")), F.lit(0)).alias("values")).first()
    batches = max(1, -(-size["values"] // BROADCAST_VALUES))
    batch_of = F.pmod(F.xxhash64("query_id"), F.lit(batches))

    def best_of(number: int) -> DataFrame:
        pdf = q.where(batch_of == number).toPandas()
        qm = _matrix(pdf["v"]) if len(pdf) else np.zeros((0, 1))
        shared = q.sparkSession.sparkContext.broadcast((ids_of(pdf["query_id"]), _unit(qm) if unit else qm))

        def scan(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            qid, qm = shared.value
            best = Best(len(qid), k)
            for b in batches:
                if len(b) and len(qid):
                    cm = _matrix(b["v"])
                    _scan_block(best, qm, ids_of(b["chunk_id"]), _unit(cm) if unit else cm)
            yield _frame(best, qid)

        return c.mapInPandas(scan, schema)

    return top_k(reduce(DataFrame.unionAll, map(best_of, range(batches))), ["query_id"], [F.desc("score"), F.asc("chunk_id")], k)


def recall(found: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of the true top-k that was found, over all queries."""
    hit = truth.join(found.select("query_id", "chunk_id", F.lit(1).alias("_hit")), ["query_id", "chunk_id"], "left")
    return hit.agg(F.count("*").alias("n_true"), F.round(F.avg(F.coalesce("_hit", F.lit(0))), 4).alias("recall"))
