"""Entity graph: extraction of authors, keywords and citations; entity and link tables; graph queries."""

from __future__ import annotations

import unicodedata
from collections import Counter
from collections.abc import Iterator

import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.functions.skew import distinct_top_k, first_per_key, salted_join, top_k

GRAM = 3  # characters of an index entry for substring search


@F.pandas_udf(T.StringType())
def _ascii(s: pd.Series) -> pd.Series:
    """Compatibility decomposition, ASCII only (no built-in does this)."""
    return s.map(lambda t: None if t is None else unicodedata.normalize("NFKD", t).encode("ascii", "ignore").decode())


def _dashes(c: Column) -> Column:
    c = F.regexp_replace(c, r"[ /\\]", "-")
    c = F.regexp_replace(c, r"[,'\"()\[\]:;]", "")
    c = F.regexp_replace(c, "-+", "-")
    cut = F.regexp_replace(c, "^-+|-+$", "")
    return F.when(cut == "", c).otherwise(cut)


def slug(c: Column) -> Column:
    """Lower-case name for keys: Latin to ASCII, pure CJK kept, punctuation dropped, blanks to dashes."""
    t = F.lower(tx.strip(c))
    a = _ascii(t)
    cjk = _dashes(F.regexp_replace(t, r"[^\p{L}\p{N}_.\-]", ""))
    return F.when(F.trim(a) == "", cjk).otherwise(_dashes(a))


# ---- extraction ----------------------------------------------------------------

_PAIR = r"([A-Z][a-zÀ-ɏ]+(?:\s+[A-Z][a-zÀ-ɏ]+)*),\s*((?:[A-Z]\.\s*)+)"


def author_names(raw: Column) -> Column:
    """Names in an author string, as an array in order."""
    segs = F.split(F.regexp_replace(tx.strip(raw), r"\s+(?:and|&)\s+", ";"), r"\s*;\s*")

    def names(seg):
        seg = tx.strip(seg)
        pairs = F.regexp_extract_all(seg, F.lit(_PAIR), F.lit(0))
        pairs = F.transform(pairs, lambda p: tx.strip(F.regexp_replace(p, r",\s*", ", ")))
        rest = tx.strip(F.regexp_replace(F.regexp_replace(seg, _PAIR, ""), r"\([^)]*\)", ""))
        rest = tx.strip(F.btrim(rest, F.lit(",")))
        parts = F.split(seg, ",")
        several = (F.size(parts) > 1) & F.exists(parts, lambda p: F.contains(tx.strip(p), F.lit(" ")))
        listed = F.filter(F.transform(parts, tx.strip), lambda p: F.length(p) >= 2)
        return F.when(seg == "", F.array().cast("array<string>")).when(
            F.size(pairs) > 0, F.concat(pairs, F.when(F.length(rest) >= 2, F.array(rest)).otherwise(F.array().cast("array<string>")))
        ).when(several, listed).otherwise(F.array(seg))

    return F.flatten(F.transform(segs, names))


def _affiliation_patterns() -> tuple[str, str]:
    w = "|".join(rules.AFFILIATION_WORDS)
    return rf"(?i)\(([^)]*(?:{w})[^)]*)\)", rf"(?i)^([^,]*?(?:{w})[^,]*?)(?:,|$)"


def authors(papers: DataFrame, paper: str = "paper_slug", raw: str = "authors") -> DataFrame:
    """(paper, position, slug, display_name, affiliation): distinct authors per paper in order."""
    n = papers.select(F.col(paper).alias("paper_slug"), F.posexplode_outer(author_names(F.col(raw))).alias("position", "name"))
    n = n.where(F.length("name") >= 2)
    p1, p2 = _affiliation_patterns()
    hit1, hit2 = F.col("name").rlike(p1), F.col("name").rlike(p2)
    cut = lambda c: F.rtrim(tx.strip(c), F.lit(".,;"))
    aff = F.when(hit1, cut(F.regexp_extract("name", p1, 1))).when(hit2, cut(F.regexp_extract("name", p2, 1))).otherwise("")
    name = F.when(hit1, cut(F.regexp_replace("name", p1, ""))).when(hit2, cut(F.regexp_replace("name", p2, ""))).otherwise(F.col("name"))
    rows = n.select("paper_slug", "position", name.alias("display_name"), aff.alias("affiliation"))
    rows = rows.withColumn("slug", F.concat(F.lit("author/"), slug(F.col("display_name"))))
    return first_per_key(rows, ["paper_slug", "slug"], ["position"])


def institutions(author_rows: DataFrame) -> DataFrame:
    """(slug, institution_slug, display_name) per author with an affiliation hint."""
    a = author_rows.where("affiliation <> ''")
    return a.select("slug", F.concat(F.lit("institution/"), slug(F.col("affiliation"))).alias("institution_slug"),
                    F.col("affiliation").alias("display_name"))


def keywords(papers: DataFrame, paper: str, text: str, k: int = 10) -> DataFrame:
    """(paper, term, tf, rank): most frequent terms, ties by first place; numbers drop out of the best 2k.

    The words of a text are counted where it is read, so no word leaves its row. Papers of several rows, if there are any,
    are one paper each and counted by a grouping.
    """
    repeated = papers.groupBy(F.col(paper).alias("_paper")).count().where("count > 1").select("_paper")
    if repeated.isEmpty():
        return _keywords_in_place(papers, paper, text, k)
    same = F.col(paper).eqNullSafe(F.col("_paper"))
    one, several = papers.join(repeated, same, "left_anti"), papers.join(repeated, same, "left_semi")
    return _keywords_in_place(one, paper, text, k).unionByName(_keywords_of_rows(several, paper, text, k))


def _keywords_in_place(papers: DataFrame, paper: str, text: str, k: int) -> DataFrame:
    kind = papers.schema[paper].dataType.simpleString()

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            at, terms, tfs, ranks = [], [], [], []
            for i, words in enumerate(b.column(1).to_pylist()):
                # most_common leaves terms of the same count in the order of their first places
                best = [(t, n) for t, n in Counter((words or "").split()).most_common(2 * k) if not (t.isascii() and t.isdigit())][:k]
                at.extend([i] * len(best))
                terms.extend(t for t, _ in best)
                tfs.extend(n for _, n in best)
                ranks.extend(range(1, len(best) + 1))
            yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(at, pa.int64())), pa.array(terms, pa.string()), pa.array(tfs, pa.int64()), pa.array(ranks, pa.int32())],
                                             names=[paper, "term", "tf", "rank"])

    words = papers.select(paper, tx.keyword_text(F.col(text)).alias("_words"))
    return words.mapInArrow(count, f"`{paper}` {kind}, term string, tf long, rank int")


def _keywords_of_rows(papers: DataFrame, paper: str, text: str, k: int) -> DataFrame:
    t = papers.select(F.col(paper), F.posexplode_outer(tx.keyword_terms(F.col(text))).alias("pos", "term")).where("term is not null")
    g = t.groupBy(paper, "term").agg(F.count("*").alias("tf"), F.min("pos").alias("first"))
    best = top_k(g, [paper], [F.desc("tf"), F.asc("first")], 2 * k, "_r").where(~F.col("term").rlike(r"^\d+(\.\d+)?$"))
    return top_k(best, [paper], [F.asc("_r")], k).select(paper, "term", "tf", "rank")


def co_occurrence(kw: DataFrame, paper: str) -> DataFrame:
    """(paper, from, to) for keyword pairs in rank order; at most ten keywords meet per paper."""
    per = kw.groupBy(paper).agg(F.sort_array(F.collect_list(F.struct("rank", "term"))).alias("l"))
    t = F.transform("l", lambda s: s["term"])
    per = per.select(paper, t.alias("t"))
    pairs = F.flatten(F.transform("t", lambda a, i: F.transform(
        F.slice(F.col("t"), i + 2, F.size("t")), lambda b: F.struct(a.alias("from_term"), b.alias("to_term")))))
    return per.select(paper, F.inline_outer(pairs)).where("from_term is not null")


def citations(papers: DataFrame, paper: str, text: str) -> DataFrame:
    """(paper, target, cite_format): numbered, parenthesis and inline citations, distinct per paper."""
    c = F.col(text)
    nums = F.flatten(F.transform(F.regexp_extract_all(c, F.lit(rules.CITE_BRACKET), F.lit(1)), lambda m: F.split(m, r"[,，]\s*")))
    bracket = F.transform(nums, lambda n: F.struct(F.lit(0).alias("o"), F.concat(F.lit("ref-"), F.trim(n)).alias("name"), F.lit("").alias("year"), F.lit("bracket").alias("f")))

    def named(pattern, o, fmt, tail):
        return F.transform(F.regexp_extract_all(c, F.lit(pattern), F.lit(0)), lambda m: F.struct(
            F.lit(o).alias("o"), F.concat(F.regexp_extract(m, pattern, 1), F.lit(tail)).alias("name"),
            F.concat(F.lit("-"), F.regexp_extract(m, pattern, 2)).alias("year"), F.lit(fmt).alias("f")))

    all_ = F.concat(bracket, named(rules.CITE_PAREN, 1, "paren", ""), named(rules.CITE_INLINE, 2, "inline", " et al"))
    rows = papers.select(paper, F.inline_outer(all_)).where("name is not null")
    # the patterns only let ASCII names through, so the slug needs no decomposition
    target = F.concat(F.lit("paper/"), _dashes(F.lower(tx.strip(F.col("name")))), F.col("year"))
    rows = rows.select(paper, target.alias("target"), "o", F.col("f").alias("cite_format"))
    return rows.groupBy(paper, "target").agg(F.min_by("cite_format", "o").alias("cite_format"))


def paper_slug(title: Column, doi: Column, url: Column) -> Column:
    """Slug of the first of title, DOI and URL that is given, else a hash."""
    best = F.coalesce(*[F.nullif(tx.strip(c), F.lit("")) for c in (title, doi, url)])
    return F.concat(F.lit("paper/"), F.coalesce(slug(best), F.concat(F.lit("unknown-"), F.xxhash64(title, doi, url).cast("string"))))


# ---- tables --------------------------------------------------------------------


def upsert_entities(mentions: DataFrame) -> DataFrame:
    """Entities from mentions (slug, display_name, type, mention_count, seq): counts add, the first name stays.

    Mentions of one name are added up first: that is done by hash, while texts kept by an aggregate make Spark sort its whole input.
    """
    named = mentions.groupBy("slug", "display_name", "type").agg(F.sum("mention_count").alias("mention_count"), F.min("seq").alias("seq"))
    return named.groupBy("slug").agg(
        F.min_by("display_name", "seq").alias("display_name"), F.min_by("type", "seq").alias("type"),
        F.sum("mention_count").alias("mention_count"))


def merge_metadata(rows: DataFrame, keys: list[str], metadata: str = "metadata", seq: str = "seq") -> DataFrame:
    """Maps merged per key, the latest value wins. Works key by key, so a hot entity is combined early."""
    kv = rows.select(*keys, F.col(seq), F.explode(metadata).alias("k", "v"))
    last = kv.groupBy(*keys, "k").agg(F.max_by("v", seq).alias("v"))
    return last.groupBy(*keys).agg(F.map_from_entries(F.collect_list(F.struct("k", "v"))).alias(metadata))


LINK_KEY = ["from_entity", "to_entity", "relation"]


def upsert_links(links: DataFrame) -> DataFrame:
    """One row per (from, to, relation). Equal links are dropped by hash; the rest is dealt out first, as types are texts, which Spark compares in a sort."""
    once = links.select(*LINK_KEY, "from_type", "to_type").distinct().repartition(*LINK_KEY)
    return once.groupBy(*LINK_KEY).agg(F.min("from_type").alias("from_type"), F.min("to_type").alias("to_type"))


def paper_links(pairs: DataFrame, from_: Column, to: Column, relation: str, from_type: str, to_type: str) -> DataFrame:
    return pairs.select(from_.alias("from_entity"), to.alias("to_entity"), F.lit(relation).alias("relation"),
                        F.lit(from_type).alias("from_type"), F.lit(to_type).alias("to_type"))


def backlink_counts(links: DataFrame) -> DataFrame:
    return links.groupBy(F.col("to_entity").alias("slug")).agg(F.count("*").alias("backlinks"))


def outgoing(links: DataFrame, slugs: DataFrame, relation: str | None = None) -> DataFrame:
    rows = links if relation is None else links.where(F.col("relation") == relation)
    return rows.join(slugs.select(F.col("slug").alias("from_entity")), "from_entity", "left_semi")


def entity_boost(entities: DataFrame, links: DataFrame) -> DataFrame:
    """1 + 0.1 mentions (up to 10) + 0.05 backlinks (up to 20)."""
    b = entities.join(backlink_counts(links), "slug", "left")
    boost = 1 + 0.1 * F.least("mention_count", F.lit(10)) + 0.05 * F.least(F.coalesce("backlinks", F.lit(0)), F.lit(20))
    return b.select("slug", boost.alias("boost"))


def _grams(c: Column, *sizes: int) -> Column:
    """The distinct runs of so many characters of a text."""
    def runs(k: int) -> Column:
        starts = F.sequence(F.lit(1), F.length(c) - k + 1)
        return F.when(F.length(c) >= k, F.transform(starts, lambda i: F.substr(c, i, F.lit(k)))).otherwise(F.array().cast("array<string>"))

    return F.array_distinct(F.concat(*map(runs, sizes)))


def gram_index(entities: DataFrame) -> DataFrame:
    """(gram, slug): the runs of one to ``GRAM`` characters in the name or slug of each entity."""
    hay = F.concat_ws("\n", F.lower("display_name"), F.col("slug"))
    return entities.select("slug", F.explode(_grams(hay, *range(1, GRAM + 1))).alias("gram"))


def search_entities(entities: DataFrame, queries: DataFrame, k: int = 5, type_: str | None = None, index: DataFrame | None = None) -> DataFrame:
    """(query_id, slug, mention_count, rank): entities whose name or slug contains the query text, by mentions.

    A query text, whatever the number of its queries, is looked up once in ``index`` (:func:`gram_index`, which may be stored) by the rarest of its grams, one shorter
    than a gram by itself; what is found there is verified on the names. Nothing passes through the driver; a frequent gram's rows are split by adaptive execution.
    """
    e = entities if type_ is None else entities.where(F.col("type") == type_)
    grams = gram_index(e) if index is None else index
    q = queries.select("query_id", F.lower(tx.strip(F.col("text"))).alias("q")).where("q <> ''").distinct()
    size = F.least(F.length("q"), F.lit(GRAM))
    asked = q.select("q").distinct().select("q", F.explode(F.element_at(F.array(*(_grams(F.col("q"), n) for n in range(1, GRAM + 1))), size)).alias("gram"))
    number = grams.join(asked.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("n"))
    # a gram that no entity has leaves nothing to look up
    rarest = asked.join(number, "gram", "left").groupBy("q").agg(F.min(F.struct(F.coalesce("n", F.lit(0)).alias("n"), "gram")).alias("m")).where("m.n > 0")
    found = rarest.select("q", "m.gram").join(grams, "gram").select("q", "slug")
    names = e.select("slug", F.col("mention_count").cast("long").alias("mention_count"), F.concat_ws("\n", F.lower("display_name"), F.col("slug")).alias("hay"))
    hits = found.join(names, "slug").where(F.contains("hay", F.col("q"))).select("q", "slug", "mention_count")
    best = top_k(hits, ["q"], [F.desc("mention_count"), F.asc("slug")], k)
    return q.join(best, "q").select("query_id", "slug", "mention_count", "rank")


def related_papers(links: DataFrame, k: int = 5) -> DataFrame:
    """(slug, paper, rank): papers linked to an entity, in or out, or through one co-occurrence hop.

    The ``k`` first papers of a union are among the ``k`` first of its parts, so every hub sends on
    no more than ``k`` papers before the hop is joined, and hops to hot hubs aren't shuffled by their hub.
    """
    into = links.where("from_type = 'paper'").select(F.col("to_entity").alias("slug"), F.col("from_entity").alias("paper"))
    out = links.where("to_type = 'paper'").select(F.col("from_entity").alias("slug"), F.col("to_entity").alias("paper"))
    first = distinct_top_k(into, ["slug"], "paper", k).drop("rank")
    hops = links.where("relation = 'co_occurs'").select(F.col("from_entity").alias("slug"), F.col("to_entity").alias("_via"))
    hubs = first.groupBy(F.col("slug").alias("_via")).agg(F.collect_list("paper").alias("_papers"))  # k at most
    hubs = hubs.join(hops.groupBy("_via").agg(F.count("*").alias("_hops")), "_via")
    hop = salted_join(hops, hubs, "_via", "_hops", F.xxhash64("slug")).select("slug", F.explode("_papers").alias("paper"))
    return distinct_top_k(first.unionByName(out).unionByName(hop), ["slug"], "paper", k)


def graph_stats(entities: DataFrame, links: DataFrame) -> DataFrame:
    a = entities.groupBy(F.lit("entity").alias("kind"), F.col("type").alias("name")).agg(F.count("*").alias("n"))
    b = links.groupBy(F.lit("link").alias("kind"), F.col("relation").alias("name")).agg(F.count("*").alias("n"))
    return a.unionByName(b)


def entity_detail(entities: DataFrame, links: DataFrame) -> DataFrame:
    """Links and backlinks of entities as rows (direction, relation, other), whatever their number."""
    o = links.select(F.col("from_entity").alias("slug"), F.lit("out").alias("direction"), "relation", F.col("to_entity").alias("other"))
    i = links.select(F.col("to_entity").alias("slug"), F.lit("in").alias("direction"), "relation", F.col("from_entity").alias("other"))
    return entities.select("slug", "display_name", "mention_count").join(o.unionByName(i), "slug")


def enrich(queries: DataFrame, entities: DataFrame, links: DataFrame, seen_titles: DataFrame, index: DataFrame | None = None) -> DataFrame:
    """Related papers of a query's best matching entities whose titles were not seen yet; ``index`` as in :func:`search_entities`."""
    found = search_entities(entities, queries, 5, index=index)
    rel = found.select("query_id", "slug", F.col("rank").alias("_er")).join(
        related_papers(links, 3).withColumnRenamed("rank", "_pr"), "slug")
    papers = entities.where("type = 'paper'").select(F.col("slug").alias("paper"), F.col("display_name").alias("title"))
    rows = rel.join(papers, "paper").withColumn("_t", F.lower(tx.strip(F.col("title"))))
    new = rows.join(seen_titles.select(F.lower(tx.strip(F.col("title"))).alias("_t")), "_t", "left_anti")
    return first_per_key(new.select("_er", "_pr", "query_id", "_t", "paper", "title"), ["_t"], ["query_id", "_er", "_pr"]).select("query_id", "paper", "title")
