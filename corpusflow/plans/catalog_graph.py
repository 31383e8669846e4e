"""Ranking, intent and the entity graph."""

import sys

from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions import skew
from corpusflow.functions import text as tx
from corpusflow.functions.skew import top_k
from corpusflow.operators import dense, graph, ranking
from corpusflow.plans import fixtures as fx
from corpusflow.plans import sqlkit as sq
from corpusflow.plans.registry import query, table, texts
from corpusflow.sources.indexes import lasting


def _turns(spark, d):
    return table(spark, d, "conversations")


def _intent_sql(c):
    cases = " ".join(f"when regexp_matches({c}, '(?i)({p})') then '{n}'" for n, p in rules.INTENT_PATTERNS)
    return f"case when {sq.strip(c)} = '' then 'general' {cases} else 'general' end"


@query("r01_intent", f"select conv_id, turn, {_intent_sql('text')} as intent from conversations")
def _(spark, d):
    return _turns(spark, d).select("conv_id", "turn", ranking.intent(F.col("text")).alias("intent"))


@query("r02_search_params", f"""with i as (select conv_id, turn, {_intent_sql('text')} as intent from conversations)
select conv_id, turn, case intent when 'entity' then 5 when 'temporal' then 12 when 'literature' then 15 else 8 end as top_k,
 true as source_boost, intent = 'temporal' as recency_bias from i""")
def _(spark, d):
    return _turns(spark, d).select("conv_id", "turn", *ranking.search_params(ranking.intent(F.col("text"))))


PREFIXES = ("papers/", "papers/arxiv/", "notes/", "tmp/", "concepts/", "")
SLUG_SQL = "case doc_id % 6 " + " ".join(f"when {i} then '{p}'" for i, p in enumerate(PREFIXES)) + " end || source"


def _slug():
    return F.concat(tx.first_match([(F.col("doc_id") % 6 == i, p) for i, p in enumerate(PREFIXES)], ""), F.col("source"))


BOOST_SQL = ("(select coalesce(arg_max(b, length(p)), 1.0::double) from (values "
             + ", ".join(f"('{p}', {b}::double)" for p, b in rules.SOURCE_BOOSTS.items()) + ") v(p, b) where starts_with(x.slug, p))")


@query("r03_source_boost", f"select doc_id, slug, {BOOST_SQL} as boost from (select doc_id, {SLUG_SQL} as slug from documents) x")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", _slug().alias("slug")).withColumn("boost", ranking.source_boost(F.col("slug")))


KW = {"that": 1.2, "RE": 1.1, "tion": 1.3}


@query("r04_keyword_boost", "select conv_id, turn, greatest(1.0::double, " + ", ".join(
    f"case when contains(lower(text), '{k.lower()}') then {b}::double else 1.0::double end" for k, b in KW.items()) + ") as boost from conversations")
def _(spark, d):
    return _turns(spark, d).select("conv_id", "turn", ranking.keyword_boost(F.col("text"), KW).alias("boost"))


@query("r05_hard_exclude", f"select doc_id, regexp_matches(slug, '^(tmp|debug|archive|test)/') as excluded from (select doc_id, {SLUG_SQL} as slug from documents)")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", ranking.hard_excluded(_slug()).alias("excluded"))


# ---- graph tables ----------------------------------------------------------

KEYWORD_TERMS = (r"list_filter(string_split(trim(regexp_replace(lower(regexp_replace(regexp_replace(text, '(^|[^0-9A-Za-z_])10\.\d{4,9}/[^\s\"<>]*[0-9A-Za-z_]', '\1 ', 'g'),"
                 r" 'https?://\S+', ' ', 'g')), '[^\p{L}\p{N}_]+', ' ', 'g')), ' '), lambda x: length(x) >= 2 and not list_contains(" + sq.lit(rules.KEYWORD_STOP_WORDS) + ", x))")
KEYWORDS = f"""ktok as (select doc_id, unnest(t) as term, generate_subscripts(t, 1) as pos from (select doc_id, {KEYWORD_TERMS} as t from documents)),
kg as (select doc_id, term, count(*) as tf, min(pos) as first from ktok group by all),
k20 as (select *, row_number() over (partition by doc_id order by tf desc, first) as r from kg),
kw as (select doc_id, term, tf, row_number() over (partition by doc_id order by r) as rank from k20 where r <= 20 and not regexp_full_match(term, '\\d+(\\.\\d+)?')),
kw10 as (select * from kw where rank <= 10)"""
PAIRS = "kpair as (select a.doc_id, a.term as from_term, b.term as to_term from kw10 a join kw10 b on a.doc_id = b.doc_id and a.rank < b.rank)"
GRAPH = f"""{KEYWORDS}, {PAIRS},
ents as (select 'keyword/' || term as slug, term as display_name, 'keyword' as type, sum(tf)::bigint as mention_count from kw10 group by term
 union all select 'paper/' || doc_id, 'Paper ' || doc_id, 'paper', 1 from documents),
links as (select 'paper/' || doc_id as from_entity, 'keyword/' || term as to_entity, 'has_keyword' as relation, 'paper' as from_type, 'keyword' as to_type from kw10
 union all select distinct 'keyword/' || from_term, 'keyword/' || to_term, 'co_occurs', 'keyword', 'keyword' from kpair)"""


def _keywords(spark, d):
    return graph.keywords(texts(spark, d), "doc_id", "text")


def _tables(spark, d):
    """The lasting entity and link tables of all documents."""
    return _stored_entities(spark, d), _stored_links(spark, d)


def _stored_entities(spark, d):
    return _keep(spark, d)(lambda: _entities(spark, d), "entities")


def _stored_links(spark, d):
    return _keep(spark, d)(lambda: _links(spark, d), "links")


def _keep(spark, d):
    return lasting(spark, "graph", (graph, rules, skew, tx, sys.modules[__name__]), f"{d}/documents.parquet")


def _stored_keywords(spark, d):
    return _keep(spark, d)(lambda: _keywords(spark, d), "keywords")


def _grams(spark, d):
    """The lasting gram index of the entities."""
    return _keep(spark, d)(lambda: graph.gram_index(_stored_entities(spark, d)), "grams")


def _entities(spark, d):
    kw = _stored_keywords(spark, d)
    i = F.col("doc_id").cast("string")
    slug = F.concat(F.lit("keyword/"), F.col("term"))
    mentions = kw.select(slug.alias("slug"), F.col("term").alias("display_name"), F.lit("keyword").alias("type"),
                         F.col("tf").alias("mention_count"), F.col("doc_id").alias("seq"))
    papers = table(spark, d, "documents").select(
        F.concat(F.lit("paper/"), i).alias("slug"), F.concat(F.lit("Paper "), i).alias("display_name"), F.lit("paper").alias("type"),
        F.lit(1).cast("long").alias("mention_count"), F.col("doc_id").alias("seq"))
    return graph.upsert_entities(mentions.unionByName(papers))


def _links(spark, d):
    kw = _stored_keywords(spark, d)
    i, slug = F.col("doc_id").cast("string"), F.concat(F.lit("keyword/"), F.col("term"))
    co = graph.co_occurrence(kw, "doc_id")
    k = lambda c: F.concat(F.lit("keyword/"), F.col(c))
    links = graph.paper_links(kw, F.concat(F.lit("paper/"), i), slug, "has_keyword", "paper", "keyword").unionByName(
        graph.paper_links(co.select("from_term", "to_term").distinct(), k("from_term"), k("to_term"), "co_occurs", "keyword", "keyword"))
    return graph.upsert_links(links)


@query("r06_apply_boosts", f"""with {GRAPH}, bl as (select to_entity as slug, count(*) as b from links group by 1),
boost as (select slug, 1 + 0.1::double * least(mention_count, 10) + 0.05::double * least(coalesce(b, 0), 20) as boost from ents left join bl using (slug)),
qf as (select item_id, exp(sum(ln(1 + (boost - 1) * 0.3::double))) as f from (select item_id, 'keyword/' || unnest({KEYWORD_TERMS}) as slug from benchmark) join boost using (slug) group by 1),
qv as (select item_id as query_id, embedding::double[] as v, text from benchmark join embeddings on item_id = vec_id),
raw as (select query_id, vec_id as chunk_id, round(list_inner_product(v, embedding::double[]), 9) as score from qv, embeddings),
{sq.ranked('raw', 25, 'h')},
x as (select h.*, {SLUG_SQL.replace('doc_id', 'd.doc_id')} as slug, q.text from h join documents d on d.doc_id = h.chunk_id join qv q using (query_id)),
y as (select query_id, chunk_id, rank as r0, {_intent_sql('text')} as intent, round(score * (case when regexp_matches(slug, '^(tmp|debug|archive|test)/') then 1.0::double else {BOOST_SQL} end)
 * greatest(1.0::double, case when contains(lower(text), 'attention') then 1.2::double end, case when contains(lower(text), 'transformer') then 1.2::double end, case when contains(lower(text), 'rag') then 1.3::double end)
 * coalesce(f, 1.0::double), 9) as final_score from x left join qf on item_id = query_id)
select query_id, chunk_id, intent, round(final_score, 5) as final_score, row_number() over (partition by query_id order by final_score desc, r0) as rank from y""")
def _(spark, d):
    ents, links = _tables(spark, d)
    q = fx.queries(spark, d)
    emb = table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")
    hits = dense.exact_top_k(fx.query_vectors(spark, d), emb, 25, "query_id", "chunk_id")
    src = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), _slug().alias("source"))
    f = ranking.query_entity_factor(q, graph.entity_boost(ents, links))
    b = ranking.apply_boosts(hits.join(src, "chunk_id"), q, f)
    return b.select("query_id", "chunk_id", "intent", F.round("final_score", 5).alias("final_score"), "rank")


@query("r07_rank_papers", f"""with p as (select source, doc_id, n_chars % 150 as c, case doc_id % 2 when 0 then 'openalex' else 'arxiv' end as s,
 row_number() over (partition by source order by doc_id) as r0 from documents), x as (select *, 'papers/' || s as slug from p),
y as (select source as query_id, doc_id as paper_id, r0, round(case when c = 0 then 0.3::double else least(1.0::double, c / 100.0::double) end * {BOOST_SQL}, 9) as final_score from x),
z as (select *, row_number() over (partition by query_id order by final_score desc, r0) as rank from y)
select query_id, paper_id, final_score, rank from z where rank <= 25""")
def _(spark, d):
    t = table(spark, d, "documents")
    p = t.select(F.col("source").alias("query_id"), F.col("doc_id").alias("paper_id"), (F.col("n_chars") % 150).alias("citation_count"),
                 F.when(F.col("doc_id") % 2 == 0, "openalex").otherwise("arxiv").alias("source"), F.col("doc_id").alias("rank"))
    q = t.select(F.col("source").alias("query_id")).distinct().withColumn("text", F.lit("x"))
    return ranking.rank_papers(p, q).select("query_id", "paper_id", "final_score", "rank")


@query("r08_prefer_recent", """with p as (select source as query_id, doc_id as paper_id, 2000 + n_chars % 25 as y, n_chars % 150 as c from documents),
o as (select *, max(y >= 2020 and query_id <> 'src3') over (partition by query_id) as any_ok from p),
z as (select query_id, paper_id, y, row_number() over (partition by query_id order by y desc, c desc, paper_id) as rank from o
 where case when query_id = 'src3' then true else not any_ok or y >= 2020 end)
select query_id, paper_id, y::varchar || '-01' as year, rank from z where rank <= 5""")
def _(spark, d):
    # one source has no paper of the wanted years, so its filter is dropped
    p = table(spark, d, "documents").select(
        F.col("source").alias("query_id"), F.col("doc_id").alias("paper_id"), (F.col("n_chars") % 150).alias("citation_count"),
        F.concat((2000 + F.col("n_chars") % 25).cast("string"), F.lit("-01")).alias("year"))
    a = ranking.prefer_recent(p.where("query_id <> 'src3'"), 5, 2020)
    b = ranking.prefer_recent(p.where("query_id = 'src3'"), 5, 2100)
    return a.unionByName(b).select("query_id", "paper_id", "year", "rank")


@query("r09_model_route", f"""with t as (select conv_id, turn, {sq.strip('text')} as t from conversations), i as (select *, {_intent_sql('t')} as i, length(t) as n,
 regexp_matches(t, '(?i)({rules.COMPLEX_HINT})') as h from t)
select conv_id, turn, case when t = '' then true when i = 'entity' and n <= 18 then true when i in ('temporal', 'literature') then false when h then false else n <= 14 end as is_simple,
 case when t = '' then 'empty' when i = 'entity' and n <= 18 then 'intent=entity,len=' || n when i in ('temporal', 'literature') then 'intent=' || i when h then 'complex_hint'
 when n <= 14 then 'short_general(len=' || n || ')' else 'long_general(len=' || n || ')' end as reason from i""")
def _(spark, d):
    return _turns(spark, d).select("conv_id", "turn", *ranking.route(F.col("text")))


@query("r10_turn_number", """select conv_id, turn, sum((role = 'user')::int) over (partition by conv_id order by turn)::bigint as turn_number
from conversations where role = 'user' """.replace("from conversations where role = 'user' ", "from conversations qualify role = 'user'"))
def _(spark, d):
    from corpusflow.operators import conversation

    return conversation.turn_numbers(_turns(spark, d), "conv_id", "turn").select("conv_id", "turn", "turn_number")


@query("r11_question_snippet", r"select conv_id, turn, left(trim(regexp_replace(text, '\s+', ' ', 'g')), 60) as snippet from conversations where role = 'user'")
def _(spark, d):
    return _turns(spark, d).where("role = 'user'").select("conv_id", "turn", ranking.snippet(F.col("text")).alias("snippet"))


@query("r12_topic_class", "select doc_id, case when regexp_matches(lower(text), 'paper|research|survey|rag|method|model') then 'academic_technical' else 'general_presentation' end as category from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", ranking.topic_class(F.col("text")).alias("category"))


TRIGGERS = {"analysis": ["the", "reti"], "report": ["QUE "], "slides": ["zzz", "para"]}


@query("r13_trigger_labels", " union all ".join(
    f"select doc_id, '{n}' as label from documents where " + " or ".join(f"contains(lower(text), '{k.lower()}')" for k in ks) for n, ks in TRIGGERS.items()))
def _(spark, d):
    return ranking.by_trigger(table(spark, d, "documents"), "doc_id", TRIGGERS)


TAGS = {"romance": ["FR", "es"], "germanic": ["de", "EN"], "iberian": ["ES"]}


@query("r13_labels_by_tag", " union all ".join(f"select doc_id, '{n}' as label from documents where lower(lang) in ({', '.join(repr(t.lower()) for t in ts)})" for n, ts in TAGS.items()))
def _(spark, d):
    return ranking.labels_by_tag(table(spark, d, "documents"), "doc_id", "lang", TAGS)


@query("r14_ambiguous", f"""select conv_id, turn, length(t) <= 20 or {' or '.join(f"contains(t, '{m}')" for m in rules.BROAD_MARKERS)} as ambiguous
from (select *, lower({sq.strip('text')}) as t from conversations)""")
def _(spark, d):
    return _turns(spark, d).select("conv_id", "turn", ranking.is_ambiguous(F.col("text")).alias("ambiguous"))


SLUG = r"""regexp_replace(regexp_replace(regexp_replace(regexp_replace(regexp_replace(strip_accents(lower({c})), '[^\x00-\x7f]', '', 'g'), '[ /\\]', '-', 'g'), '[,''"()\[\]:;]', '', 'g'), '-+', '-', 'g'), '^-+|-+$', '', 'g')"""


@query("e01_slug", "select doc_id, " + SLUG.replace("{c}", sq.strip("text")) + " as slug from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", graph.slug(F.col("text")).alias("slug"))


@query("e02_keyword_terms", f"select doc_id, array_to_string({KEYWORD_TERMS}, ' ') as terms from documents")
def _(spark, d):
    return texts(spark, d).select("doc_id", F.array_join(tx.keyword_terms(F.col("text")), " ").alias("terms"))


AUTHORS = "upper(left(lang, 1)) || substr(lang, 2)"


def _author_papers(spark, d):
    n = F.initcap("lang")
    raw = F.concat(n, F.lit("son, "), F.upper(F.left("source", F.lit(1))), F.lit(". J., "), n, F.lit("berg, Q. and "), n,
                   F.lit(" Miller ("), F.col("source"), F.lit(" University); "), n, F.lit("son, S. J."))
    return table(spark, d, "documents").select(F.concat(F.lit("paper/"), F.col("doc_id").cast("string")).alias("paper_slug"), raw.alias("authors"))


NAMES_SQL = f"""(select doc_id, source, {AUTHORS} as n from documents)"""


@query("e03_author_names", f"select doc_id, n || 'son, S. J.|' || n || 'berg, Q.|' || n || ' Miller (' || source || ' University)|' || n || 'son, S. J.' as names from {NAMES_SQL}")
def _(spark, d):
    p = _author_papers(spark, d)
    return p.select(F.regexp_extract("paper_slug", r"(\d+)", 1).cast("long").alias("doc_id"), F.array_join(graph.author_names(F.col("authors")), "|").alias("names"))


@query("e04_authors", f"""select 'paper/' || doc_id as paper_slug, 'author/' || lower(n) || 'son-s.-j.' as slug, n || 'son, S. J.' as display_name, '' as affiliation from {NAMES_SQL}
union all select 'paper/' || doc_id, 'author/' || lower(n) || 'berg-q.', n || 'berg, Q.', '' from {NAMES_SQL}
union all select 'paper/' || doc_id, 'author/' || lower(n) || '-miller', n || ' Miller', source || ' University' from {NAMES_SQL}""")
def _(spark, d):
    return graph.authors(_author_papers(spark, d)).select("paper_slug", "slug", "display_name", "affiliation")


@query("e05_institutions", f"select 'author/' || lower(n) || '-miller' as slug, 'institution/' || source || '-university' as institution_slug, count(*) as n_papers from {NAMES_SQL} group by all")
def _(spark, d):
    return graph.institutions(graph.authors(_author_papers(spark, d))).groupBy("slug", "institution_slug").agg(F.count("*").alias("n_papers"))


@query("e06_keywords", f"with {KEYWORDS} select doc_id, term, tf, rank from kw10")
def _(spark, d):
    return _keywords(spark, d)


@query("e07_co_occurrence", f"with {KEYWORDS}, {PAIRS} select * from kpair")
def _(spark, d):
    return graph.co_occurrence(_keywords(spark, d), "doc_id")


CITED = "text || ' [' || (doc_id % 7) || ', ' || (doc_id % 3) || '] (Smith & Lee, 20' || (10 + doc_id % 9) || ') Wang et al. (2021a)'"


@query("e08_citations", rf"""with t as (select doc_id, {CITED} as t from documents),
b0 as (select doc_id, unnest(regexp_extract_all(t, '\[(\d+(?:[,，]\s*\d+)*)\]', 1)) as m from t),
b as (select distinct doc_id, 'paper/ref-' || trim(n) as target, 'bracket' as cite_format from (select doc_id, unnest(string_split(m, ',')) as n from b0)),
p as (select distinct doc_id, 'paper/' || regexp_replace(regexp_replace(lower(trim(regexp_extract(m, '\(([^,]+), *(\d{{4}}[a-z]?)\)', 1))), '[ /\\]', '-', 'g'), '-+', '-', 'g') || '-' || regexp_extract(m, '(\d{{4}}[a-z]?)\)', 1) as target, 'paren' as cite_format
 from (select doc_id, unnest(regexp_extract_all(t, '\([A-Z][a-z]+(?:\s+(?:&|and)\s+[A-Z][a-z]+)?,\s*\d{{4}}[a-z]?\)')) as m from t)),
i as (select distinct doc_id, 'paper/' || lower(regexp_extract(m, '^([A-Z][a-z]+)', 1)) || '-et-al-' || regexp_extract(m, '\((\d{{4}}[a-z]?)\)', 1) as target, 'inline' as cite_format
 from (select doc_id, unnest(regexp_extract_all(t, '[A-Z][a-z]+\s+et\s+al\.?\s*\(\d{{4}}[a-z]?\)')) as m from t))
select * from b union all select * from p union all select * from i""")
def _(spark, d):
    i = F.col("doc_id")
    t = F.concat("text", F.lit(" ["), (i % 7).cast("string"), F.lit(", "), (i % 3).cast("string"), F.lit("] (Smith & Lee, 20"),
                 (10 + i % 9).cast("string"), F.lit(") Wang et al. (2021a)"))
    return graph.citations(table(spark, d, "documents").select("doc_id", t.alias("t")), "doc_id", "t")


@query("e09_paper_slug", """select doc_id, 'paper/' || case when doc_id % 3 = 0 then source || '-paper-' || doc_id when doc_id % 3 = 1 then '10.1000-' || doc_id
 else 'https-x.org-' || doc_id end as slug from documents""")
def _(spark, d):
    i, s = F.col("doc_id"), F.col("doc_id").cast("string")
    title = F.when(i % 3 == 0, F.concat(F.col("source"), F.lit(" Paper: "), s)).otherwise("")
    doi = F.when(i % 3 == 1, F.concat(F.lit("10.1000/"), s))
    return table(spark, d, "documents").select("doc_id", graph.paper_slug(title, doi, F.concat(F.lit("https://x.org/"), s)).alias("slug"))


@query("e10_entities", f"with {GRAPH} select slug, display_name, type, mention_count from ents")
def _(spark, d):
    return _stored_entities(spark, d)


@query("e10_entity_metadata", """with m as (select source, unnest(['year', case when doc_id % 2 = 0 then 'venue' else 'lang' end]) as k, unnest([n_chars::varchar, lang]) as v, doc_id from documents)
select source as slug, k, arg_max(v, doc_id) as v from m group by all""")
def _(spark, d):
    i = F.col("doc_id")
    rows = table(spark, d, "documents").select(F.col("source").alias("slug"), i.alias("seq"), F.create_map(
        F.lit("year"), F.col("n_chars").cast("string"), F.when(i % 2 == 0, "venue").otherwise("lang"), F.col("lang")).alias("metadata"))
    return graph.merge_metadata(rows, ["slug"]).select("slug", F.explode("metadata").alias("k", "v"))


@query("e11_links", f"with {GRAPH} select from_entity, to_entity, relation from links")
def _(spark, d):
    return _stored_links(spark, d).select(*graph.LINK_KEY)


@query("e12_entity_boost", f"""with {GRAPH}, bl as (select to_entity as slug, count(*) as b from links group by 1)
select slug, round(1 + 0.1::double * least(mention_count, 10) + 0.05::double * least(coalesce(b, 0), 20), 6) as boost from ents left join bl using (slug)""")
def _(spark, d):
    return graph.entity_boost(*_tables(spark, d)).withColumn("boost", F.round("boost", 6))


WORD = r"\p{L}+"


def _word_queries(spark, d):
    """Every word of a text is a query of its own."""
    w = F.explode(F.array_distinct(F.regexp_extract_all(F.lower("text"), F.lit(WORD), F.lit(0))))
    q = table(spark, d, "benchmark").select("item_id", w.alias("text"))
    return q.select(F.concat(F.col("item_id").cast("string"), F.lit("/"), "text").alias("query_id"), "text")


FOUND = f"""ql as (select distinct item_id::varchar || '/' || q as query_id, q from (select item_id, unnest(regexp_extract_all(lower(text), '{WORD}')) as q from benchmark)),
fw as (select q, slug, mention_count, row_number() over (partition by q order by mention_count desc, slug) as rank
 from (select distinct q from ql) join ents on contains(lower(display_name), q) or contains(slug, q)),
found as (select query_id, slug, mention_count, rank from ql join fw using (q) where rank <= 5)"""


@query("e13_entity_search", f"with {GRAPH}, {FOUND} select * from found")
def _(spark, d):
    return graph.search_entities(_stored_entities(spark, d), _word_queries(spark, d), 5, index=_grams(spark, d))


@query("e14_backlinks", f"with {GRAPH} select to_entity as slug, relation, count(*) as n from links group by all")
def _(spark, d):
    links = _stored_links(spark, d)
    return links.groupBy(F.col("to_entity").alias("slug"), "relation").agg(F.count("*").alias("n"))


@query("e14_outgoing", f"with {GRAPH} select from_entity, to_entity from links where relation = 'co_occurs' and from_entity in (select slug from ents where mention_count >= 5)")
def _(spark, d):
    ents, links = _tables(spark, d)
    return graph.outgoing(links, ents.where("mention_count >= 5"), "co_occurs").select("from_entity", "to_entity")


def _related_sql(k, out):
    return f"""{out}u as (select to_entity as slug, from_entity as paper from links where from_type = 'paper'
 union select from_entity, to_entity from links where to_type = 'paper'
 union select a.from_entity, b.from_entity from links a join links b on a.relation = 'co_occurs' and b.to_entity = a.to_entity and b.from_type = 'paper'),
{out} as (select * from (select slug, paper, row_number() over (partition by slug order by paper) as rank from {out}u) where rank <= {k})"""


@query("e15_related_papers", f"with {GRAPH}, {_related_sql(5, 'rp')} select * from rp")
def _(spark, d):
    return graph.related_papers(_stored_links(spark, d), 5)


@query("e16_graph_stats", f"with {GRAPH} select 'entity' as kind, type as name, count(*) as n from ents group by all union all select 'link', relation, count(*) from links group by all")
def _(spark, d):
    return graph.graph_stats(*_tables(spark, d))


@query("e16_entity_detail", f"""with {GRAPH} select slug, direction, count(*) as n, sum(mention_count)::bigint as mentions from (
 select slug, mention_count, 'out' as direction from ents join links on from_entity = slug union all
 select slug, mention_count, 'in' from ents join links on to_entity = slug) group by all""")
def _(spark, d):
    return graph.entity_detail(*_tables(spark, d)).groupBy("slug", "direction").agg(F.count("*").alias("n"), F.sum("mention_count").alias("mentions"))


@query("e17_graph_enrichment", f"""with {GRAPH}, {FOUND}, {_related_sql(3, 'rp')},
x as (select query_id, f.rank as er, rp.rank as pr, paper, e.display_name as title from found f join rp using (slug) join ents e on e.slug = paper and e.type = 'paper'
 where e.display_name not in (select 'Paper ' || doc_id from documents where doc_id % 2 = 0))
select query_id, paper, title from (select *, row_number() over (partition by title order by query_id, er, pr) as rn from x) where rn = 1""")
def _(spark, d):
    ents, links = _tables(spark, d)
    seen = table(spark, d, "documents").where("doc_id % 2 = 0").select(F.concat(F.lit("Paper "), F.col("doc_id").cast("string")).alias("title"))
    return graph.enrich(_word_queries(spark, d), ents, links, seen, _grams(spark, d))
