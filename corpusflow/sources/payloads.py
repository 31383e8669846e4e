"""Landed search responses as paper, repository and web tables; one input row is one response item in JSON or XML."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow.operators import papers

PAPER_COLUMNS = ["title", "abstract", "authors", "venue", "year", "citation_count", "url", "doi", "source"]


def _clean(c: Column) -> Column:
    return tx.strip(F.replace(F.coalesce(c.cast("string"), F.lit("")), F.lit("\x00"), F.lit("")))


def _names(people: Column, get, sep: str = ", ") -> Column:
    return F.array_join(F.filter(F.transform(F.coalesce(people, F.array()), lambda p: _clean(get(p))), lambda n: n != ""), sep)


def _paper(df: DataFrame, keep: list[str], **cols) -> DataFrame:
    return df.select(*keep, *[cols[c].alias(c) for c in PAPER_COLUMNS])


def works(raw: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Responses with an inverted abstract index, nested locations and authorships."""
    schema = ("struct<title:string,abstract:string,abstract_inverted_index:map<string,array<int>>,publication_year:string,cited_by_count:bigint,id:string,doi:string,"
              "authorships:array<struct<author:struct<display_name:string>>>,primary_location:struct<landing_page_url:string,source:struct<display_name:string>>>")
    w = raw.select(*keep, F.from_json(payload, schema).alias("w"))
    g = lambda p: F.col(f"w.{p}")
    text = F.coalesce(F.nullif(g("abstract"), F.lit("")), papers.abstract_from_index(g("abstract_inverted_index")))
    return _paper(w, keep, title=_clean(g("title")), abstract=_clean(text), authors=_names(g("authorships"), lambda a: a["author"]["display_name"]),
                  venue=_clean(g("primary_location.source.display_name")), year=F.coalesce(g("publication_year"), F.lit("")), citation_count=F.coalesce(g("cited_by_count"), F.lit(0).cast("long")),
                  url=F.coalesce(F.nullif(g("primary_location.landing_page_url"), F.lit("")), g("id"), F.lit("")), doi=F.coalesce(g("doi"), F.lit("")), source=F.lit("openalex"))


def flat_papers(raw: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Flat responses with a list of author names."""
    schema = "struct<title:string,abstract:string,venue:string,year:string,citationCount:bigint,url:string,authors:array<struct<name:string>>>"
    w = raw.select(*keep, F.from_json(payload, schema).alias("w"))
    g = lambda p: F.col(f"w.{p}")
    return _paper(w, keep, title=_clean(g("title")), abstract=_clean(g("abstract")), authors=_names(g("authors"), lambda a: a["name"]), venue=_clean(g("venue")),
                  year=F.coalesce(g("year"), F.lit("")), citation_count=F.coalesce(g("citationCount"), F.lit(0).cast("long")), url=F.coalesce(g("url"), F.lit("")),
                  doi=F.lit(""), source=F.lit("semanticscholar"))


ENTRY_SCHEMA = "title string, summary string, id string, published string, author array<struct<name:string>>"


def read_feed(spark: SparkSession, path: str) -> DataFrame:
    """Entries of Atom feed files."""
    return spark.read.format("xml").option("rowTag", "entry").schema(ENTRY_SCHEMA).load(path)


def feed_papers(entries: DataFrame, keep: list[str] | None = None) -> DataFrame:
    """Atom entries as papers; the DOI follows from the entry's address."""
    keep = keep or []
    c = F.col
    return _paper(entries, keep, title=_clean(c("title")), abstract=_clean(c("summary")), authors=_names(c("author"), lambda a: a["name"]), venue=F.lit("arXiv"),
                  year=F.left(F.coalesce("published", F.lit("")), F.lit(4)), citation_count=F.lit(0).cast("long"), url=F.coalesce("id", F.lit("")),
                  doi=papers.doi_from_url(F.coalesce("id", F.lit(""))), source=F.lit("arxiv"))


def repositories(raw: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Repository search items; descriptions of at most 200 characters."""
    schema = "struct<full_name:string,description:string,stargazers_count:bigint,html_url:string,language:string,topics:array<string>>"
    w = raw.select(*keep, F.from_json(payload, schema).alias("w"))
    g = lambda p: F.col(f"w.{p}")
    d = tx.collapse(F.coalesce(g("description"), F.lit("")))
    short = F.when(F.length(d) <= 200, d).otherwise(F.concat(tx.rstrip(F.left(d, F.lit(200))), F.lit("...")))
    return w.select(*keep, F.coalesce(g("full_name"), F.lit("")).alias("repo_name"), short.alias("description"), F.coalesce(g("stargazers_count"), F.lit(0).cast("long")).alias("stars"),
                    F.coalesce(g("html_url"), F.lit("")).alias("url"), F.coalesce(g("language"), F.lit("")).alias("language"), F.coalesce(g("topics"), F.array().cast("array<string>")).alias("topics"))


def full_texts(raw: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Full-text aggregator items: date or year, authors joined by ``and``, full-text or download address."""
    schema = "struct<id:string,title:string,abstract:string,publishedDate:string,yearPublished:string,downloadUrl:string,sourceFulltextUrls:string,authors:array<struct<name:string>>>"
    w = raw.select(*keep, F.from_json(payload, schema).alias("w"))
    s = lambda *ps: F.coalesce(*[F.nullif(F.col(f"w.{p}"), F.lit("")) for p in ps], F.lit(""))
    return w.select(*keep, s("id").alias("id"), s("title").alias("title"), s("publishedDate", "yearPublished").alias("published"),
                    _names(F.col("w.authors"), lambda a: a["name"], " and ").alias("authors"), s("abstract").alias("abstract"), s("sourceFulltextUrls", "downloadUrl").alias("url"))


def web_results(raw: DataFrame, payload: str, keep: list[str]) -> DataFrame:
    """Items of web search responses, whatever key holds the list and whatever the fields are called."""
    item = "array<struct<title:string,name:string,url:string,link:string,snippet:string,content:string,summary:string,source:string,site_name:string>>"
    lists = [F.filter(F.from_json(F.get_json_object(payload, f"$.{k}"), item), lambda x: x.isNotNull()) for k in ("data", "results", "items", "documents")]
    first = F.coalesce(*[F.when(F.size(l) > 0, l) for l in lists])
    w = raw.select(*keep, F.posexplode_outer(first).alias("pos", "i")).where("i is not null")
    g = lambda *ps: F.coalesce(*[F.col(f"i.{p}") for p in ps[:-1]], F.lit(ps[-1]))
    return w.select(*keep, "pos", g("title", "name", "").alias("title"), g("url", "link", "").alias("url"), g("snippet", "content", "summary", "").alias("snippet"),
                    g("source", "site_name", "web").alias("source"))


def fallback_chain(*ranked: DataFrame, key: str = "query_id") -> DataFrame:
    """Rows of the first source that has any, per query. Sources are given in order of preference."""
    out, seen = None, None
    for i, df in enumerate(ranked):
        part = df if seen is None else df.join(seen, key, "left_anti")
        part = part.withColumn("priority", F.lit(i))
        out = part if out is None else out.unionByName(part, allowMissingColumns=True)
        keys = df.select(key).distinct()
        seen = keys if seen is None else seen.unionByName(keys).distinct()
    return out


def branch_sources(branches: DataFrame, academic: DataFrame, repos: DataFrame, web: DataFrame) -> DataFrame:
    """Sources of all kinds per branch. Academic rows carry a branch, the others a query and go to each of its branches."""
    b = branches.select("query_id", "branch_id", "branch_query")
    a = academic.join(b, ["query_id", "branch_id"]).select("query_id", "branch_id", "branch_query", "title", "venue", "url", "abstract", F.lit("academic").alias("kind"))
    r = repos.join(b, "query_id").select("query_id", "branch_id", "branch_query", F.col("repo_name").alias("title"), F.lit("GitHub").alias("venue"), "url",
                                         F.col("description").alias("abstract"), F.lit("repository").alias("kind"))
    w = web.join(b, "query_id").select("query_id", "branch_id", "branch_query", "title", F.col("source").alias("venue"), "url", F.col("snippet").alias("abstract"), F.lit("web").alias("kind"))
    return a.unionByName(r).unionByName(w)
