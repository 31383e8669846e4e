"""Intent, routing and boosted ranking. Rule tables are constants and compile to expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import Window as W

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.functions.skew import top_k


def intent(c: Column) -> Column:
    """The first intent whose pattern occurs in the question; ``general`` otherwise."""
    blank = F.coalesce(tx.strip(c), F.lit("")) == ""
    return tx.first_match([(blank, "general"), *[(c.rlike("(?i)(" + p + ")"), n) for n, p in rules.INTENT_PATTERNS]], "general")


def search_params(intent_: Column) -> list[Column]:
    top = tx.first_match([(intent_ == n, k) for n, (k, _) in rules.INTENT_PARAMS.items()], 8)
    recent = intent_.isin([n for n, (_, r) in rules.INTENT_PARAMS.items() if r])
    return [top.alias("top_k"), F.lit(True).alias("source_boost"), recent.alias("recency_bias")]


def source_boost(slug: Column, weights: dict[str, float] | None = None) -> Column:
    """Weight of the longest matching prefix, else one."""
    weights = rules.SOURCE_BOOSTS if weights is None else weights
    by_len = sorted(weights, key=len, reverse=True)
    return tx.first_match([(F.startswith(slug, F.lit(p)), float(weights[p])) for p in by_len], F.lit(1.0))


def keyword_boost(query: Column, weights: dict[str, float] | None = None) -> Column:
    """The highest boost among the contained keywords, at least one."""
    weights = rules.KEYWORD_BOOSTS if weights is None else weights
    q = F.lower(query)
    return F.greatest(F.lit(1.0), F.lit(1.0), *[F.when(F.contains(q, F.lit(k.lower())), float(b)).otherwise(1.0) for k, b in weights.items()])


def hard_excluded(slug: Column, prefixes=rules.HARD_EXCLUDES) -> Column:
    out = F.lit(False)
    for p in prefixes:
        out = out | F.startswith(slug, F.lit(p))
    return out


def query_entity_factor(queries: DataFrame, boosts: DataFrame) -> DataFrame:
    """(query_id, entity_factor): product over the query's terms of 1 + 0.3 (boost - 1).

    ``boosts``: slug, boost per keyword entity. Terms meet entities in an equi-join.
    """
    t = queries.select("query_id", F.explode(tx.keyword_terms(F.col("text"))).alias("_t"))
    t = t.select("query_id", F.concat(F.lit("keyword/"), F.col("_t")).alias("slug"))
    f = t.join(boosts.where("boost > 1").select("slug", "boost"), "slug").groupBy("query_id").agg(
        F.exp(F.sum(F.log(1 + (F.col("boost") - 1) * 0.3))).alias("entity_factor"))
    return queries.select("query_id").join(f, "query_id", "left").select(
        "query_id", F.coalesce("entity_factor", F.lit(1.0)).alias("entity_factor"))


def apply_boosts(
    hits: DataFrame, queries: DataFrame, entity_factor: DataFrame | None = None, k: int = 25, drop_excluded: bool = False
) -> DataFrame:
    """Final score = score x source x keyword x entity factor; ranked again per query.

    ``hits``: query_id, chunk_id, score, source, rank, a list bounded by the search limit.
    Excluded sources only lose the source boost unless ``drop_excluded``.
    """
    q = queries.select("query_id", keyword_boost(F.col("text")).alias("_kw"), intent(F.col("text")).alias("intent"))
    if entity_factor is not None:
        q = q.join(entity_factor, "query_id", "left")
        ent = F.coalesce("entity_factor", F.lit(1.0))
    else:
        ent = F.lit(1.0)
    src = F.coalesce("source", F.lit(""))
    boost = F.when((src != "") & ~hard_excluded(src), source_boost(src)).otherwise(1.0)
    rows = hits.where(~hard_excluded(src)) if drop_excluded else hits
    scored = rows.join(q, "query_id").withColumn("final_score", F.round(F.coalesce("score", F.lit(0.5)) * boost * F.col("_kw") * ent, 9))
    scored = scored.withColumnRenamed("rank", "_r").drop("_kw", "entity_factor")
    return top_k(scored, ["query_id"], [F.desc("final_score"), F.asc("_r")], k).drop("_r")


def paper_base_score(citations: Column) -> Column:
    """Citations over 100, at most one; no citations count 0.3."""
    s = F.least(F.lit(1.0), F.coalesce(citations, F.lit(0)) / 100)
    return F.when(s == 0, 0.3).otherwise(s)


def rank_papers(papers: DataFrame, queries: DataFrame, entity_factor: DataFrame | None = None, k: int = 25) -> DataFrame:
    """``papers``: query_id, paper_id, citation_count, source, rank."""
    hits = papers.withColumns({
        "chunk_id": F.col("paper_id"), "score": paper_base_score(F.col("citation_count")),
        "source": F.concat(F.lit("papers/"), F.coalesce("source", F.lit("unknown")))})
    return apply_boosts(hits, queries, entity_factor, k)


def prefer_recent(papers: DataFrame, k: int, min_year: int | None = None, key: str = "query_id") -> DataFrame:
    """Newest, then most cited papers per query. ``min_year`` is dropped where it would leave nothing."""
    y = F.coalesce(F.left(F.col("year").cast("string"), F.lit(4)).try_cast("int"), F.lit(-1))
    rows = papers.withColumn("_y", y)
    if min_year is not None:
        rows = rows.withColumn("_ok", F.col("_y") >= min_year)
        # the best k by (fits, year, citations) hold all that is needed to decide
        order = [F.desc("_ok"), F.desc("_y"), F.desc("citation_count"), F.asc("paper_id")]
        best = top_k(rows, [key], order, k)
        any_ok = F.max("_ok").over(W.partitionBy(key))
        return best.withColumn("_any", any_ok).where("_ok or not _any").drop("_y", "_ok", "_any")
    return top_k(rows, [key], [F.desc("_y"), F.desc("citation_count"), F.asc("paper_id")], k).drop("_y")


def route(c: Column) -> list[Column]:
    """Small model or not, with the reason."""
    t = tx.strip(F.coalesce(c, F.lit("")))
    i, n = intent(t), F.length(t)
    ns = n.cast("string")
    hint = t.rlike("(?i)(" + rules.COMPLEX_HINT + ")")
    cases = [
        (t == "", True, F.lit("empty")),
        ((i == "entity") & (n <= 18), True, F.concat(F.lit("intent=entity,len="), ns)),
        (i.isin("temporal", "literature"), False, F.concat(F.lit("intent="), i)),
        (hint, False, F.lit("complex_hint")),
        (n <= 14, True, F.concat(F.lit("short_general(len="), ns, F.lit(")"))),
    ]
    return [
        tx.first_match([(c_, s) for c_, s, _ in cases], False).alias("is_simple"),
        tx.first_match([(c_, r) for c_, _, r in cases], F.concat(F.lit("long_general(len="), ns, F.lit(")"))).alias("reason"),
    ]


def snippet(c: Column, n: int = 60) -> Column:
    return F.left(tx.collapse(c), F.lit(n))


def topic_class(c: Column) -> Column:
    return F.when(tx.contains_any(F.lower(c), rules.ACADEMIC_TERMS), "academic_technical").otherwise("general_presentation")


def by_trigger(texts: DataFrame, id_col: str, triggers: dict[str, list[str]]) -> DataFrame:
    """(id, label) for every label with a trigger keyword in the text."""
    t = F.lower("text")
    labels = F.array_compact(F.array(*[F.when(tx.contains_any(t, [k.lower() for k in kws]), F.lit(n)) for n, kws in triggers.items()]))
    return texts.select(id_col, F.explode_outer(labels).alias("label")).where("label is not null")


def by_tag(tag: str, tags: dict[str, list[str]]) -> list[str]:
    """Labels that carry the tag, whatever its case."""
    return [n for n, ts in tags.items() if tag.lower() in (t.lower() for t in ts)]


def labels_by_tag(texts: DataFrame, id_col: str, tag_col: str, tags: dict[str, list[str]]) -> DataFrame:
    """(id, label) for every label that carries the tag of a row, whatever its case."""
    known = sorted({t.lower() for ts in tags.values() for t in ts})
    found = F.create_map(*(F.array(*map(F.lit, by_tag(t, tags))) if i else F.lit(t) for t in known for i in (0, 1)))
    return texts.select(id_col, F.explode(F.try_element_at(found, F.lower(tag_col))).alias("label"))


def is_ambiguous(c: Column) -> Column:
    t = F.lower(tx.strip(F.coalesce(c, F.lit(""))))
    return (F.length(t) <= 20) | tx.contains_any(t, rules.BROAD_MARKERS)
