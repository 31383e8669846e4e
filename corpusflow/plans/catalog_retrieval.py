"""Lexical, dense and hybrid retrieval; fusion and merging."""

from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.operators import dense, fusion, lexical, neighbours, ranking
from corpusflow.plans import fixtures as fx
from corpusflow.plans import sqlkit as sq
from corpusflow.plans.registry import query, table, texts
from corpusflow.session import materialize

K = 10


@query("t01_index_terms", f"select doc_id, len(t) as n_terms, array_to_string(t, ' ') as terms from (select doc_id, {sq.terms('text')} as t from documents)")
def _(spark, d):
    t = texts(spark, d).select("doc_id", tx.index_terms(F.col("text")).alias("t"))
    return t.select("doc_id", F.size("t").cast("long").alias("n_terms"), F.array_join("t", " ").alias("terms"))


@query("t02_corpus_stats", f"with {sq.lexical('documents', 'doc_id')} select term, df, n as n_docs, round(avg_dl, 6) as avg_dl from dfreq, stats")
def _(spark, d):
    idx = lexical.LexicalIndex(texts(spark, d), "doc_id")
    return idx.df.select("term", "df", idx.stats.select("n_docs").scalar().alias("n_docs"),
                         F.round(idx.stats.select("avg_dl").scalar(), 6).alias("avg_dl"))


@query("t03_bm25_weights", f"with {sq.lexical('documents', 'doc_id')} select id as doc_id, term, round(w, 6) as weight from dw where w > 0")
def _(spark, d):
    w = lexical.LexicalIndex(texts(spark, d), "doc_id").weights()
    return w.select("doc_id", "term", F.round("weight", 6).alias("weight"))


SPARSE = f"""{sq.lexical('documents', 'doc_id')}, {sq.lexical_queries('benchmark', 'item_id')},
sraw as (select qid as query_id, id as chunk_id, round(sum(qw.w * dw.w), 9) as score from qw join dw using (term) where qw.w > 0 group by all)"""
OUT = "query_id, chunk_id, round(score, 6) as score, rank"


def _sparse(spark, d, k):
    return fx.document_index(spark, d).search(fx.queries(spark, d), "query_id", k)


def _out(df):
    return df.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank")


@query("t04_sparse_top_k", f"with {SPARSE}, {sq.ranked('sraw', K, 's')} select {OUT} from s")
def _(spark, d):
    return _out(_sparse(spark, d, K))


def _dense_sql(queries, out, k, metric="list_inner_product(q.v, c.v)"):
    return f"""qv as ({queries}), cv as (select vec_id as chunk_id, embedding::double[] as v from embeddings),
{out}raw as (select query_id, chunk_id, round({metric}, 9) as score from qv q, cv c), {sq.ranked(out + 'raw', k, out)}"""


ALL_VECTORS = "select vec_id as query_id, embedding::double[] as v from embeddings where vec_id % 50 = 0"
QUERY_VECTORS = "select item_id as query_id, embedding::double[] as v from benchmark join embeddings on item_id = vec_id"


def _vectors(spark, d):
    return table(spark, d, "embeddings").select(F.col("vec_id").alias("chunk_id"), "embedding")


def _batch(v):
    """Every fiftieth vector asks all vectors."""
    return v.where("chunk_id % 50 = 0").withColumnRenamed("chunk_id", "query_id")


@query("t05_dense_top_k", f"with {_dense_sql(ALL_VECTORS, 'dn', K)} select {OUT} from dn")
def _(spark, d):
    v = _vectors(spark, d)
    return _out(dense.exact_top_k(_batch(v), v, K, "query_id", "chunk_id"))


def _near(spark, d):
    return materialize(neighbours.search(fx.vector_index(spark, d), _batch(_vectors(spark, d)), "query_id", K), "near")


@query("t06_approximate_top_k")
def _(spark, d):
    return _out(neighbours.best(_near(spark, d), K))


@query("t06_recall", f"with {_dense_sql(ALL_VECTORS, 'dn', K)} select count(*) as n_true, count(distinct query_id) as queries, true as enough from dn")
def _(spark, d):
    # measured against the exact search
    v, found = _vectors(spark, d), _near(spark, d)
    r = dense.recall(neighbours.best(found, K), dense.exact_top_k(_batch(v), v, K, "query_id", "chunk_id", metric="cosine"))
    return r.join(neighbours.effort(found)).select("n_true", "queries", (F.col("recall") >= 0.95).alias("enough"))


@query("t06_effort")
def _(spark, d):
    # recall, and vectors compared as a share of those that the exact search compares
    v, found = _vectors(spark, d), _near(spark, d)
    r = dense.recall(neighbours.best(found, K), dense.exact_top_k(_batch(v), v, K, "query_id", "chunk_id", metric="cosine"))
    share = F.round(F.col("visits") / (F.col("queries") * v.agg(F.count("*").alias("n")).scalar()), 4)
    return r.join(neighbours.effort(found)).select("queries", "recall", "visits", share.alias("compared_share"))


def _hybrid(spark, d, k):
    q = fx.query_vectors(spark, d)
    dn = dense.exact_top_k(q, _vectors(spark, d), 2 * k, "query_id", "chunk_id")
    return fusion.rrf(dn, _sparse(spark, d, 2 * k), limit=k)


def _rrf_sql(a, b, out, limit=None):
    """RRF of two ranked CTEs where every query is in both."""
    return f"""{out}f as (select query_id, chunk_id, min(case when leg = 0 then rank end) as r0, min(case when leg = 1 then rank end) as r1
 from (select *, 0 as leg from {a} union all select *, 1 as leg from {b}) group by all),
{out}s as (select query_id, chunk_id, r0, r1, round(coalesce(1 / (60.0::double + r0 - 1), 0) + coalesce(1 / (60.0::double + r1 - 1), 0), 9) as score,
 (r0 is not null)::int + (r1 is not null)::int as hits from {out}f),
{out} as (select * from (select query_id, chunk_id, score, hits, row_number() over (partition by query_id order by score desc, hits desc,
 r0 nulls last, r1 nulls last) as rank from {out}s) {f'where rank <= {limit}' if limit else ''})"""


HYBRID = f"""{SPARSE}, {sq.ranked('sraw', 2 * K, 'sp')}, {_dense_sql(QUERY_VECTORS, 'dn', 2 * K)}, {_rrf_sql('dn', 'sp', 'hy', K)}"""


@query("t07_hybrid_retrieve", f"with {HYBRID} select query_id, chunk_id, round(score, 6) as score, hits, rank from hy")
def _(spark, d):
    return _hybrid(spark, d, K).select("query_id", "chunk_id", F.round("score", 6).alias("score"), "hits", "rank")


def _fields(spark, d):
    docs = texts(spark, d)
    lines = F.split("text", "\n")
    return docs.select("doc_id", "text", F.coalesce(F.get(lines, F.lit(0)), F.lit("")).alias("h1"),
                       F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("h2"), F.coalesce(F.get(lines, F.lit(2)), F.lit("")).alias("h3"))


def _field_sql(name, boost):
    p = f"f_{name}_"
    return f"""{sq.lexical(f"(select * from fields where {name} <> '')", 'doc_id', name, p)},
{p}s as (select query_id, id as chunk_id, sum(w) * {boost} as s from {p}dw join qterms using (term) group by all)"""


@query("t08_multi_field_search", f"""
with fields as (select doc_id, text, coalesce(string_split(text, chr(10))[1], '') as h1, coalesce(string_split(text, chr(10))[2], '') as h2,
 coalesce(string_split(text, chr(10))[3], '') as h3 from documents),
qterms as (select distinct item_id as query_id, unnest({sq.terms('text')}) as term from benchmark),
{_field_sql('text', 2.0)}, {_field_sql('h1', 3.0)}, {_field_sql('h2', 2.0)}, {_field_sql('h3', 1.0)},
b as (select query_id, chunk_id, round(max(s), 9) as score from (select * from f_text_s union all select * from f_h1_s union all select * from f_h2_s union all select * from f_h3_s) where chunk_id % 3 <> 0 group by all),
{sq.ranked('b', K, 'o')} select {OUT} from o""")
def _(spark, d):
    # documents stand for chunks of three levels by their numbers; two levels are searched
    return _out(lexical.field_scores(rules.FIELD_WEIGHTS, _fields(spark, d), fx.queries(spark, d), "doc_id", "query_id", K, F.col("chunk_id") % 3 != 0))


@query("t09_rrf_fusion", f"""with {SPARSE}, {sq.ranked('sraw', 30, 'sp')}, {_dense_sql(QUERY_VECTORS, 'dn', 30)}, {_rrf_sql('sp', 'dn', 'hy')}
select query_id, chunk_id, round(score, 6) as score, hits, rank from hy""")
def _(spark, d):
    dn = dense.exact_top_k(fx.query_vectors(spark, d), _vectors(spark, d), 30, "query_id", "chunk_id")
    f = fusion.rrf(_sparse(spark, d, 30), dn)
    return f.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "hits", "rank")


# ---- chunk level -----------------------------------------------------------

CHUNK_HITS = f"""{sq.CHUNKS}, {sq.lexical('chunks', 'chunk_id')}, {sq.lexical_queries('benchmark', 'item_id')},
sraw as (select qid as query_id, id as chunk_id, round(sum(qw.w * dw.w), 9) as score from qw join dw using (term) where qw.w > 0 group by all),
{sq.ranked('sraw', 15, 's15')}"""


def _chunk_hits(spark, d, k=15):
    c = fx.chunks(spark, d)
    return c, fx.chunk_index(spark, d).search(fx.queries(spark, d), "query_id", k)


@query("t10_leaf_candidates", f"with {CHUNK_HITS} select query_id, chunk_id, round(score, 6) as score, rank from s15")
def _(spark, d):
    return _out(_chunk_hits(spark, d, max(3 * 5, 5))[1])


@query("t12_image_vector_top_k", f"""with {_dense_sql(QUERY_VECTORS, 'dn', 5)}
select query_id, chunk_id, round(score, 6) as score, rank, doc_id is not null as has_caption, coalesce(source, '') as caption
from dn left join documents on doc_id = chunk_id""")
def _(spark, d):
    hits = dense.exact_top_k(fx.query_vectors(spark, d), _vectors(spark, d), 5, "query_id", "chunk_id")
    cap = table(spark, d, "documents").select(F.col("doc_id").alias("chunk_id"), F.col("source").alias("caption"))
    return _out_with(hits.join(cap, "chunk_id", "left"))


def _out_with(j):
    return j.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank",
                    F.col("caption").isNotNull().alias("has_caption"), F.coalesce("caption", F.lit("")).alias("caption"))


# two image hits for each of the nearest vectors; half of the ids are those of chunks
IMAGES = """img as (select query_id, case when rank % 2 = 0 then chunk_id else 100000000 + chunk_id // 4 end as chunk_id, rank * 2 + c as rank,
 '/file/image/' || case when rank % 3 = 1 then 0 else chunk_id end || '_' || c as image_url, case when rank % 3 = 0 then '' else 'cap' || chunk_id end as caption,
 case when c = 1 and rank % 3 = 2 then '<<IMAGE:0000abcd>>' else '' end as placeholder, score - c * 0.125::double as image_score from dn, (select unnest([0, 1]) as c))"""


@query("t11_image_hit_merge", f"""with {SPARSE}, {sq.ranked('sraw', K, 'sp')}, {_dense_sql(QUERY_VECTORS, 'dn', 5)}, {IMAGES}
select s.query_id, s.chunk_id, 'text' as chunk_type, 't' as text, round(s.score, 6) as score, coalesce(array_to_string(u, ','), '') as urls, round(image_score, 6) as image_score
from sp s left join (select query_id, chunk_id, list(image_url order by rank) as u, arg_max(image_score, rank) as image_score from img group by all) i using (query_id, chunk_id)
union all select query_id, chunk_id, 'image', case when placeholder <> '' then placeholder || chr(10) || '图片说明：' || caption else caption end, round(image_score, 6), image_url, round(image_score, 6)
from img where (caption <> '' or placeholder <> '') and (query_id, chunk_id) not in (select (query_id, chunk_id) from sp)""")
def _(spark, d):
    hits = _sparse(spark, d, K).withColumn("text", F.lit("t"))
    dn = dense.exact_top_k(fx.query_vectors(spark, d), _vectors(spark, d), 5, "query_id", "chunk_id")
    i, r = F.col("chunk_id"), F.col("rank")
    img = dn.withColumn("c", F.explode(F.array(F.lit(0), F.lit(1)))).select(
        "query_id", F.when(r % 2 == 0, i).otherwise(F.floor(i / 4) + 100000000).alias("chunk_id"), (r * 2 + F.col("c")).alias("rank"),
        F.concat(F.lit("/file/image/"), F.when(r % 3 == 1, 0).otherwise(i).cast("string"), F.lit("_"), F.col("c").cast("string")).alias("image_url"),
        F.when(r % 3 == 0, "").otherwise(F.concat(F.lit("cap"), i.cast("string"))).alias("caption"),
        F.when((F.col("c") == 1) & (r % 3 == 2), "<<IMAGE:0000abcd>>").otherwise("").alias("image_placeholder"), (F.col("score") - F.col("c") * 0.125).alias("image_score"))
    m = fusion.merge_image_hits(hits, img)
    return m.select("query_id", "chunk_id", "chunk_type", "text", F.round("score", 6).alias("score"),
                    F.array_join("image_urls", ",").alias("urls"), F.round("image_score", 6).alias("image_score"))


@query("t13_apply_rerank", f"""with {SPARSE}, {sq.ranked('sraw', K, 'sp')}, {_dense_sql(QUERY_VECTORS, 'dn', 12)},
sc as (select query_id, rank - 1 as idx, score as relevance, 13 - rank as pos from dn where query_id % 3 <> 0),
j as (select sp.*, relevance, pos, count(pos) over (partition by sp.query_id) > 0 as applied from sp left join sc on sc.query_id = sp.query_id and idx = rank - 1),
o as (select *, row_number() over (partition by query_id order by case when applied then pos else rank end, chunk_id) as rn from j where pos is not null or not applied)
select query_id, chunk_id, case when applied then rank end as rrf_rank, round(relevance, 6) as rerank_score, applied as rerank_applied, rn as rank from o where rn <= 5""")
def _(spark, d):
    dn = dense.exact_top_k(fx.query_vectors(spark, d), _vectors(spark, d), 12, "query_id", "chunk_id")
    sc = dn.where("query_id % 3 <> 0").select("query_id", (F.col("rank") - 1).alias("index"), F.col("score").alias("relevance"), (13 - F.col("rank")).alias("pos"))
    r = fusion.apply_rerank(_sparse(spark, d, K), sc, 5)
    return r.select("query_id", "chunk_id", "rrf_rank", F.round("rerank_score", 6).alias("rerank_score"), "rerank_applied", "rank")


def _merge_sql(src, out):
    return f"""{out}g as (select query_id, parent_chunk_id as p, count(*) as n, max(score) as best, min(rank) as fr from {src}
 where parent_chunk_id <> '' group by all having count(*) >= 2),
{out}m as (select query_id, p as chunk_id, pa.parent_chunk_id, best as score, fr as rank, n as replaced from {out}g join parents pa on pa.chunk_id = p),
{out}a as (select query_id, chunk_id, parent_chunk_id, score, rank, replaced from {src} h where not exists
 (select 1 from {out}m m where m.query_id = h.query_id and m.chunk_id = h.parent_chunk_id) union all select * from {out}m),
{out} as (select * exclude (rn) from (select *, row_number() over (partition by query_id, chunk_id order by rank) as rn from {out}a) where rn = 1)"""


MERGE = f"""{CHUNK_HITS}, h0 as (select query_id, chunk_id, parent_chunk_id, score, rank, 0 as replaced from s15 join chunks using (chunk_id)),
{_merge_sql('h0', 'm1')}"""


def _with_parent(spark, d):
    c, hits = _chunk_hits(spark, d)
    return c, hits.join(c.select("chunk_id", "parent_chunk_id"), "chunk_id")


@query("t14_parent_merge", f"with {MERGE} select query_id, chunk_id, parent_chunk_id, round(score, 6) as score, rank, replaced from m1")
def _(spark, d):
    c, h = _with_parent(spark, d)
    return fusion.merge_parents(h, fx.parents(c)).withColumn("score", F.round("score", 6))


@query("t15_auto_merge", f"""with {MERGE}, {_merge_sql('m1', 'm2')},
o as (select query_id, chunk_id, round(score, 6) as score, row_number() over (partition by query_id order by score desc, rank, chunk_id) as rank from m2)
select * from o where rank <= 5""")
def _(spark, d):
    c, h = _with_parent(spark, d)
    return _out(fusion.auto_merge(h, fx.parents(c), 5))


@query("t15_auto_merge_meta", f"""with {MERGE}, {_merge_sql('m1', 'm2')},
a as (select query_id, sum(replaced) as n1 from m1 m where not exists (select 1 from h0 h where h.query_id = m.query_id and h.chunk_id = m.chunk_id) group by 1),
b as (select query_id, sum(replaced) as n2 from m2 m where not exists (select 1 from m1 h where h.query_id = m.query_id and h.chunk_id = m.chunk_id) group by 1)
select query_id, coalesce(n1, 0) + coalesce(n2, 0) > 0 as applied, (coalesce(n1, 0) + coalesce(n2, 0))::bigint as replaced_chunks,
 (coalesce(n1, 0) > 0)::int + (coalesce(n2, 0) > 0)::int as steps
from (select distinct query_id from h0) left join a using (query_id) left join b using (query_id)""")
def _(spark, d):
    c, h = _with_parent(spark, d)
    return fusion.auto_merge_meta(h, fx.parents(c))


TREE_HITS = f"""{sq.TREE}, {sq.lexical('tree', 'chunk_id')}, {sq.lexical_queries('benchmark', 'item_id')},
sraw as (select qid as query_id, id as chunk_id, round(sum(qw.w * dw.w), 9) as score from qw join dw using (term) where qw.w > 0 and contains(id, '::l3::') group by all),
{sq.ranked('sraw', 15, 'sp')}"""


def _leaf():
    return F.contains(F.col("chunk_id"), F.lit("::l3::"))


@query("t10_level_filter", f"with {TREE_HITS} select {OUT} from sp")
def _(spark, d):
    # leaves of an index over chunks of all levels
    return _out(fx.tree_index(spark, d).search(fx.queries(spark, d), "query_id", 15, only=_leaf()))


SLUGS = "case doc_id % 3 when 0 then 'papers/arxiv/' || doc_id when 1 then 'concepts/' || doc_id else 'tmp/' || doc_id end"
READ = f"""{TREE_HITS}, qv as ({QUERY_VECTORS}), cv as (select distinct chunk_id, embedding::double[] as v from tree join embeddings on chunk_id = 'doc' || vec_id || '.txt::p0::l3::0'),
dnraw as (select query_id, chunk_id, round(list_inner_product(q.v, c.v), 9) as score from qv q, cv c), {sq.ranked('dnraw', 15, 'dn')}, {_rrf_sql('dn', 'sp', 'hy', 15)},
rr as (select query_id, chunk_id, score, rank, query_id % 3 <> 0 as applied, (rank * 5 + query_id) % 17 as pos from hy),
rk as (select *, row_number() over (partition by query_id order by case when applied then pos else rank - 1 end, chunk_id) as place from rr),
h0 as (select query_id, chunk_id, parent_chunk_id, case when applied then 1 - pos / 20.0::double else score end as score, place as rank, 0 as replaced from rk join tree using (chunk_id) where place <= 12),
{_merge_sql('h0', 'm1')}, {_merge_sql('m1', 'm2')},
mo as (select *, row_number() over (partition by query_id order by score desc, rank, chunk_id) as r0 from m2),
fin as (select mo.query_id, chunk_id, lvl, length(tree.text) as n_chars, r0, round(score * case when doc_id % 3 = 0 then 1.4::double when doc_id % 3 = 1 then 1.2::double else 1.0::double end
 * greatest(1.0::double, case when contains(lower(b.text), 'attention') then 1.2::double end, case when contains(lower(b.text), 'transformer') then 1.2::double end, case when contains(lower(b.text), 'rag') then 1.3::double end), 9) as final_score
 from mo join tree using (chunk_id) join benchmark b on item_id = mo.query_id where r0 <= 8)"""


@query("t15_read_path", f"""with {READ} select query_id, chunk_id, lvl as chunk_level, n_chars, round(final_score, 6) as final_score,
 row_number() over (partition by query_id order by final_score desc, r0) as rank from fin""")
def _(spark, d):
    """From questions to boosted hits on the stored chunks of three levels, as one plan."""
    t = fx.tree(spark, d)
    q = fx.queries(spark, d)
    vectors = _vectors(spark, d).withColumn("chunk_id", F.concat(F.lit("doc"), F.col("chunk_id").cast("string"), F.lit(".txt::p0::l3::0")))
    vectors = vectors.join(t.where("chunk_level = 3").select("chunk_id"), "chunk_id", "left_semi")
    sparse_ = fx.tree_index(spark, d).search(q, "query_id", 15, only=_leaf())
    hits = materialize(fusion.rrf(dense.exact_top_k(fx.query_vectors(spark, d), vectors, 15, "query_id", "chunk_id"), sparse_, limit=15), "fused")
    pos = (F.col("rank") * 5 + F.col("query_id")) % 17  # an external reranker's order
    scores = hits.where("query_id % 3 <> 0").select("query_id", (F.col("rank") - 1).alias("index"), (1 - pos / 20.0).alias("relevance"), pos.alias("pos"))
    ranked = fusion.apply_rerank(hits, scores, 12).withColumn("score", fusion.score_of(F.col("rerank_score"), F.col("score")))
    nodes = t.select("chunk_id", "parent_chunk_id")
    merged = fusion.auto_merge(ranked.select("query_id", "chunk_id", "score", "rank").join(nodes, "chunk_id"), t.where("chunk_level < 3").select("chunk_id", "parent_chunk_id"), 8)
    i = F.col("doc_id")
    slug = F.concat(F.when(i % 3 == 0, "papers/arxiv/").when(i % 3 == 1, "concepts/").otherwise("tmp/"), i.cast("string"))
    full = merged.select("query_id", "chunk_id", "score", "rank").join(t.select("chunk_id", "chunk_level", F.length("text").cast("long").alias("n_chars"), slug.alias("source")), "chunk_id")
    out = ranking.apply_boosts(full, q, None, 8)
    return out.select("query_id", "chunk_id", "chunk_level", "n_chars", F.round("final_score", 6).alias("final_score"), "rank")


@query("t16_score_pick", "select doc_id, case when doc_id % 3 = 0 then coalesce(try_cast(source as double), 0.0) else n_chars::double end as score from documents")
def _(spark, d):
    t = table(spark, d, "documents")
    rr = F.when(F.col("doc_id") % 3 == 0, F.col("source"))
    return t.select("doc_id", fusion.score_of(rr, F.col("n_chars")).alias("score"))


@query("t17_row_identity", """select case when doc_id % 2 = 0 then 'c' || doc_id else sha256(source || chr(31) || '0' || chr(31) || text) end as identity,
 count(*) as n from documents group by 1""")
def _(spark, d):
    cid = F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit("c"), F.col("doc_id").cast("string")))
    t = table(spark, d, "documents").select(fusion.identity_of(cid, F.col("source"), F.lit(0), F.col("text")).alias("identity"))
    return t.groupBy("identity").agg(F.count("*").alias("n"))


@query("t18_mode_fallback", f"""with {_dense_sql(QUERY_VECTORS, 'dn', 5)}, {SPARSE}, {sq.ranked('sraw', 5, 'sp')},
hy as (select * from sp where query_id % 2 = 0), de as (select * from dn where query_id % 3 = 0)
select query_id, chunk_id, round(score, 6) as score, rank, 'hybrid' as retrieval_mode from hy
union all select query_id, chunk_id, round(score, 6), rank, 'dense_fallback' from de where query_id not in (select query_id from hy)
union all select item_id, null, null, null, 'failed' from benchmark where item_id not in (select query_id from hy) and item_id not in (select query_id from de)""")
def _(spark, d):
    dn = dense.exact_top_k(fx.query_vectors(spark, d), _vectors(spark, d), 5, "query_id", "chunk_id").where("query_id % 3 = 0")
    m = fusion.with_mode(_sparse(spark, d, 5).where("query_id % 2 = 0"), dn, fx.queries(spark, d))
    return m.select("query_id", "chunk_id", F.round("score", 6).alias("score"), "rank", "retrieval_mode")


HITS_FULL = f"{CHUNK_HITS}, hf as (select s15.*, c.filename, c.text, c.source, c.doc_id, c.parent_chunk_id from s15 join chunks c using (chunk_id))"


def _hits_full(spark, d):
    c, hits = _chunk_hits(spark, d)
    return hits.join(c.select("chunk_id", "filename", "text", "source", "doc_id", "parent_chunk_id"), "chunk_id").withColumn("page_number", F.lit(0))


@query("t19_source_list", f"""with {HITS_FULL} select query_id, rank, chunk_id, filename, 0 as page_number, round(score, 4) as score,
 case when length(t) > 240 then rtrim(substr(t, 1, 240), {sq.BLANKS}) || '...' else t end as preview, 'text' as chunk_type
from (select *, {sq.strip('text')} as t from hf)""")
def _(spark, d):
    return fusion.source_list(_hits_full(spark, d))


@query("t20_reference_block", f"""with {HITS_FULL}, l as (select query_id, rank, '【参考资料 ' || rank || '】' || chr(10) || '来源: ' || filename || chr(10) || '页码: 0' || chr(10)
 || '标题: ' || source || ' > ' || doc_id || chr(10) || '内容:' || chr(10) || text as t from hf)
select query_id, string_agg(t, chr(10) || chr(10) order by rank) as reference_text from l group by query_id""")
def _(spark, d):
    h = _hits_full(spark, d).withColumns({"h1": F.col("source"), "h2": F.lit(""), "h3": F.col("doc_id").cast("string")})
    return fusion.reference_block(h)


@query("t21_text_match", f"""with {sq.lexical('documents', 'doc_id')},
qt as (select distinct item_id as query_id, unnest({sq.terms('text')}) as term from benchmark),
b as (select query_id, id as chunk_id, round(sum(w), 9) as score from dw join qt using (term) group by all), {sq.ranked('b', K, 'o')} select {OUT} from o""")
def _(spark, d):
    return _out(fx.document_index(spark, d).match(fx.queries(spark, d), "query_id", K))


@query("t22_dimension_check", "select count(*) as n, min(len(embedding))::int as min_dim, max(len(embedding))::int as max_dim, min(len(embedding)) = 64 and max(len(embedding)) = 64 as ok from embeddings")
def _(spark, d):
    return dense.check_dimension(table(spark, d, "embeddings"), "embedding", 64)
