"""Fusion, reranking and merging of ranked hits; every table is keyed by ``query_id``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.functions.skew import first_per_key, top_k


def rrf(primary: DataFrame, secondary: DataFrame, k: int = rules.RRF_K, limit: int | None = None) -> DataFrame:
    """Reciprocal rank fusion of two ranked lists (query_id, chunk_id, rank from 1).

    Score is the sum of 1/(k + rank - 1); ties go to more hits, then to the primary list's
    order, then the secondary's. A query found in one list only keeps that list's own
    order and score.
    """
    a = primary.select("query_id", "chunk_id", F.col("rank").alias("_r0"), F.col("score").alias("_s0"))
    b = secondary.select("query_id", "chunk_id", F.col("rank").alias("_r1"), F.col("score").alias("_s1"))
    j = a.join(b, ["query_id", "chunk_id"], "full")
    w = W.partitionBy("query_id")
    both = (F.count("_r0").over(w) > 0) & (F.count("_r1").over(w) > 0)
    part = [F.coalesce(1 / (F.lit(float(k)) + F.col(r) - 1), F.lit(0.0)) for r in ("_r0", "_r1")]
    s = j.withColumn("_both", both).select(
        "query_id", "chunk_id", "_r0", "_r1",
        F.when(F.col("_both"), F.round(part[0] + part[1], 9)).otherwise(F.coalesce("_s0", "_s1")).alias("score"),
        (F.col("_r0").isNotNull().cast("int") + F.col("_r1").isNotNull().cast("int")).alias("hits"),
        F.when(~F.col("_both"), F.coalesce("_r0", "_r1")).alias("_given"),
    )
    order = [F.asc_nulls_last("_given"), F.desc("score"), F.desc("hits"), F.asc_nulls_last("_r0"), F.asc_nulls_last("_r1")]
    n = limit if limit is not None else 2**31 - 1
    return top_k(s, ["query_id"], order, n).select("query_id", "chunk_id", "score", "hits", "rank")


def score_of(rerank: Column, score: Column) -> Column:
    """Rerank score if present, else score; anything that is no number counts as zero."""
    return F.coalesce(F.coalesce(rerank.cast("string"), score.cast("string")).try_cast("double"), F.lit(0.0))


def identity_of(chunk_id: Column, filename: Column, page: Column, text: Column) -> Column:
    named = F.when(chunk_id != "", chunk_id)
    return F.coalesce(named, F.sha2(F.concat_ws("\x1f", filename, page.cast("string"), text), 256))


def apply_rerank(hits: DataFrame, scores: DataFrame, k: int) -> DataFrame:
    """Reorder hits (query_id, chunk_id, rank, score) by external scores (query_id, index, relevance, pos).

    ``index`` counts from zero in the old order, out-of-range entries are ignored and ``pos``
    is the new order. Queries without any usable score keep their order.
    """
    old = hits.withColumn("_i", F.col("rank") - 1)
    hit = old.join(scores.select("query_id", F.col("index").alias("_i"), "relevance", "pos"), ["query_id", "_i"], "left")
    any_ = hit.groupBy("query_id").agg((F.count("pos") > 0).alias("rerank_applied"))
    m = hit.join(any_, "query_id").where("pos is not null or not rerank_applied")
    m = m.withColumn("_ord", F.when(F.col("rerank_applied"), F.col("pos")).otherwise(F.col("_i")))
    out = m.select(
        "query_id", "chunk_id", F.when(F.col("rerank_applied"), F.col("rank")).alias("rrf_rank"),
        F.col("relevance").alias("rerank_score"), "score", "rerank_applied", "_ord")
    return top_k(out, ["query_id"], [F.asc("_ord"), F.asc("chunk_id")], k).drop("_ord")


def merge_parents(hits: DataFrame, parents: DataFrame, threshold: int = 2, counter: str = "replaced") -> DataFrame:
    """Replace children by their parent when at least ``threshold`` of them were found.

    ``hits``: query_id, chunk_id, parent_chunk_id, score, rank (a bounded list per query).
    ``parents``: chunk_id, parent_chunk_id. The parent takes the best child's score and the first
    child's place; a parent that was itself among the hits stays a single row. ``counter`` is
    the number of children merged in this pass; counters of earlier passes are added up.
    """
    earlier = [c for c in hits.columns if c.startswith("replaced")]
    g = W.partitionBy("query_id", "_p")
    h = hits.withColumn("_p", F.when(F.trim("parent_chunk_id") != "", F.trim("parent_chunk_id")))
    h = h.withColumns({
        "_n": F.count("_p").over(g), "_best": F.max("score").over(g), "_first": F.min("rank").over(g),
        **{f"_sum_{c}": F.sum(c).over(g) for c in earlier},
    }).withColumn("_p", F.when(F.col("_n") >= threshold, F.col("_p")))
    j = h.join(parents.select(F.col("chunk_id").alias("_p"), F.col("parent_chunk_id").alias("_pp")), "_p", "left")
    merged = F.col("_pp").isNotNull()
    pick = lambda new, old: F.when(merged, F.col(new)).otherwise(F.col(old))
    rows = j.select(
        "query_id", pick("_p", "chunk_id").alias("chunk_id"), pick("_pp", "parent_chunk_id").alias("parent_chunk_id"),
        pick("_best", "score").alias("score"), pick("_first", "rank").alias("rank"),
        *[pick(f"_sum_{c}", c).alias(c) for c in earlier],
        F.when(merged, F.col("_n")).otherwise(F.lit(0).cast("long")).alias(counter))
    one = W.partitionBy("query_id", "chunk_id")
    rows = rows.withColumns({
        "_rn": F.row_number().over(one.orderBy("rank", F.desc(counter))),
        **{c: F.max(c).over(one) for c in [*earlier, counter]},
    })
    return rows.where("_rn = 1").drop("_rn")


def _two_passes(hits: DataFrame, parents: DataFrame, threshold: int) -> DataFrame:
    return merge_parents(merge_parents(hits, parents, threshold, "replaced_1"), parents, threshold, "replaced_2")


def auto_merge(hits: DataFrame, parents: DataFrame, k: int, threshold: int = 2) -> DataFrame:
    """Two merge passes (leaf to middle to root), best scores first, ``k`` per query."""
    rows = _two_passes(hits, parents, threshold).withColumnRenamed("rank", "_r")
    return top_k(rows, ["query_id"], [F.desc("score"), F.asc("_r"), F.asc("chunk_id")], k).drop("_r")


def auto_merge_meta(hits: DataFrame, parents: DataFrame, threshold: int = 2) -> DataFrame:
    """Per query: children replaced over both passes and passes that replaced any."""
    m = _two_passes(hits, parents, threshold).groupBy("query_id").agg(
        F.sum("replaced_1").alias("n1"), F.sum("replaced_2").alias("n2"))
    total = F.col("n1") + F.col("n2")
    return m.select("query_id", (total > 0).alias("applied"), total.alias("replaced_chunks"),
                    ((F.col("n1") > 0).cast("int") + (F.col("n2") > 0).cast("int")).alias("steps"))


def merge_image_hits(hits: DataFrame, images: DataFrame) -> DataFrame:
    """Attach image hits to the chunk of the same id; every other image hit becomes a row of its own.

    ``hits``: query_id, chunk_id, text, score. ``images``: query_id, chunk_id, image_url, caption, image_placeholder,
    image_score and, if they don't come by falling score, their ``rank``. A chunk takes the distinct urls in that order and
    the score of the last hit. Image rows without caption and placeholder are dropped.
    """
    if "rank" not in images.columns:
        images = images.withColumn("rank", -F.col("image_score"))
    cap, ph = F.coalesce("caption", F.lit("")), F.coalesce("image_placeholder", F.lit(""))
    url = F.when(F.col("image_url") != "", F.col("image_url"))
    grouped = images.groupBy("query_id", "chunk_id").agg(
        F.array_sort(F.collect_list(F.struct("rank", url.alias("u")))).alias("_u"), F.max_by("image_score", "rank").alias("image_score"))
    urls = F.coalesce(F.array_distinct(F.array_compact(F.transform("_u", lambda x: x["u"]))), F.array().cast("array<string>"))
    own = hits.join(grouped, ["query_id", "chunk_id"], "left").select(
        "query_id", "chunk_id", "text", "score", urls.alias("image_urls"), "image_score", F.lit("text").alias("chunk_type"))
    body = F.when(ph != "", F.concat(ph, F.lit("\n图片说明："), cap)).otherwise(cap)
    new = images.join(hits.select("query_id", "chunk_id").distinct(), ["query_id", "chunk_id"], "left_anti").where((ph != "") | (cap != ""))
    return own.unionByName(new.select(
        "query_id", "chunk_id", body.alias("text"), F.col("image_score").alias("score"),
        F.array_compact(F.array(url)).alias("image_urls"), "image_score", F.lit("image").alias("chunk_type")))


def with_mode(hybrid: DataFrame, dense: DataFrame, queries: DataFrame) -> DataFrame:
    """Hybrid hits where a query has any, else dense ones, else one ``failed`` row."""
    cols = ["query_id", "chunk_id", "score", "rank"]
    a = hybrid.select(*cols, F.lit("hybrid").alias("retrieval_mode"))
    has = hybrid.select("query_id").distinct()
    b = dense.join(has, "query_id", "left_anti").select(*cols, F.lit("dense_fallback").alias("retrieval_mode"))
    rest = queries.select("query_id").join(has, "query_id", "left_anti").join(dense.select("query_id").distinct(), "query_id", "left_anti")
    out = a.unionByName(b)
    return out.unionByName(rest.withColumn("retrieval_mode", F.lit("failed")), allowMissingColumns=True)


def source_list(hits: DataFrame, n_preview: int = 240) -> DataFrame:
    """Display rows: preview, rounded score, kind; one row per chunk (or file, page and preview).

    ``hits``: query_id, rank, chunk_id, filename, page_number, text, score.
    """
    p = tx.preview(tx.strip(F.col("text")), n_preview)
    rows = hits.select(
        "query_id", "rank", F.coalesce("chunk_id", F.lit("")).alias("chunk_id"), "filename", "page_number",
        F.round("score", 4).alias("score"), p.alias("preview"),
        F.when(p.rlike(rules.IMAGE_PLACEHOLDER), "image").otherwise("text").alias("chunk_type"))
    key = F.coalesce(F.when(F.col("chunk_id") != "", F.col("chunk_id")),
                     F.concat_ws(":", "filename", F.col("page_number").cast("string"), "preview"))
    return first_per_key(rows, [F.col("query_id").alias("_q"), key.alias("_k")], ["rank"])


def reference_block(hits: DataFrame) -> DataFrame:
    """One text per query: its (top-k) hits as numbered references in rank order."""
    head = F.concat_ws(" > ", *[F.when(F.trim(c) != "", F.trim(c)) for c in ("h1", "h2", "h3")])
    lines = F.concat_ws(
        "\n",
        F.concat(F.lit("【参考资料 "), F.col("rank").cast("string"), F.lit("】")),
        F.concat(F.lit("来源: "), F.col("filename")),
        F.concat(F.lit("页码: "), F.col("page_number").cast("string")),
        F.when(head != "", F.concat(F.lit("标题: "), head)),
        F.concat(F.lit("内容:\n"), F.col("text")),
    )
    parts = hits.select("query_id", F.struct(F.col("rank"), lines.alias("t")).alias("s"))
    return parts.groupBy("query_id").agg(
        F.array_join(F.transform(F.sort_array(F.collect_list("s")), lambda s: s["t"]), "\n\n").alias("reference_text"))
