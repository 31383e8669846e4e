"""Context assembly over conversations and retrieved documents."""

from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.operators import context
from corpusflow.plans import fixtures as fx
from corpusflow.plans import sqlkit as sq
from corpusflow.plans.catalog_retrieval import SPARSE
from corpusflow.plans.registry import query, table, texts
from corpusflow.session import materialize

# questions are the benchmark items; conversation of the same id is their session
HIST = """hist as (select conv_id as query_id, turn as pos, case when role = 'user' then 'user' else 'assistant' end as role, text as content,
 row_number() over (partition by conv_id order by turn desc) as r from conversations)"""
GATHER = f"""{SPARSE}, {sq.ranked('sraw', 8, 'kn')}, {HIST},
cand as (select query_id, 'history' as source, pos, role || ': ' || content as content, 0.0::double as score from hist where r <= 12 and {sq.strip('content')} <> ''
 union all select query_id, 'knowledge', 1099511627776 + rank, text, score from kn join documents on doc_id = chunk_id
 union all select query_id, 'parent_chunk', 2199023255552 + rank, substr(text, 1, 1820), score from kn join documents on doc_id = chunk_id where length(text) > 0
 union all select conv_id, 'note', 3298534883328 + turn, 'sys: ' || text, 0.5::double from conversations where role = 'system'
 union all select conv_id, 'memory', 4398046511104 + turn, '[Memory:project] ' || split_part(text, chr(10), 1) || ': ' || text, 0.9::double from conversations where role = 'assistant' and turn % 4 = 1)"""


def _history(spark, d):
    h = context.last_history(table(spark, d, "conversations"), "conv_id", "turn")
    return h.select(F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), "role", "content")


def _candidates(spark, d):
    docs = texts(spark, d)
    hits = fx.document_index(spark, d).search(fx.queries(spark, d), "query_id", 8)
    kn = hits.join(docs.select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content")), "chunk_id").withColumnRenamed("rank", "pos")
    notes = table(spark, d, "conversations").where("role = 'system'").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.lit("sys").alias("title"), F.col("text").alias("content"), F.lit(0.5).alias("importance"))
    # the first root chunk of each hit, and what earlier answers left as memories
    roots = fx.roots(spark, d).where("endswith(chunk_id, '::l1::0')").select(F.col("doc_id").alias("chunk_id"), F.col("text").alias("content"))
    up = hits.join(roots, "chunk_id").withColumnRenamed("rank", "pos")
    memories = table(spark, d, "conversations").where("role = 'assistant' and turn % 4 = 1").select(
        F.col("conv_id").alias("query_id"), F.col("turn").alias("pos"), F.lit("project").alias("kind"), tx.first_line(F.col("text")).alias("title"), F.col("text").alias("content"),
        F.lit(None).cast("double").alias("importance"))
    return materialize(context.gather(_history(spark, d), kn, up, notes, memories), "candidates")


def _questions(spark, d):
    return fx.queries(spark, d).select("query_id", F.col("query_id").alias("session_id"), F.col("text").alias("question"))


@query("c01_gather", f"with {GATHER} select query_id, source, pos, content, round(score, 6) as score from cand")
def _(spark, d):
    return _candidates(spark, d).withColumn("score", F.round("score", 6))


@query("c02_last_history", f"with {HIST} select query_id, pos, role, content from hist where r <= 12 and {sq.strip('content')} <> ''")
def _(spark, d):
    return _history(spark, d)


@query("c03_candidate_score", """select doc_id, coalesce(try_cast(case when doc_id % 4 = 0 then lang end as double), case when doc_id % 3 = 0 then n_chars::double end,
 case when doc_id % 7 > 0 then 1.0::double / (doc_id % 7) end, 0.25::double) as score from documents""")
def _(spark, d):
    i = F.col("doc_id")
    null = F.lit(None).cast("string")
    s = context.candidate_score(F.when(i % 4 == 0, F.col("lang")), F.when(i % 3 == 0, F.col("n_chars")), null, i % 7, F.lit(0.25))
    return table(spark, d, "documents").select("doc_id", s.alias("score"))


WS = r"list_distinct(list_filter(string_split(trim(regexp_replace(lower({c}), '\s+', ' ', 'g')), ' '), lambda x: x <> ''))"
OVER = f"len(list_intersect({WS.format(c='question')}, {WS.format(c='content')}))"
SCORE = f"round(case when len({WS.format(c='question')}) = 0 or len({WS.format(c='content')}) = 0 then 0.0::double else {OVER} + {OVER}::double / greatest(len({WS.format(c='question')}), 1) end, 9)"


@query("c04_overlap_score", f"with {GATHER} select query_id, pos, {SCORE} as score from (select c.*, b.text as question from cand c join benchmark b on item_id = query_id)")
def _(spark, d):
    j = _candidates(spark, d).join(_questions(spark, d), "query_id")
    return j.select("query_id", "pos", F.round(context.overlap_score(F.col("question"), F.col("content")), 9).alias("score"))


EVID = f"""{GATHER}, ev0 as (select query_id, source, pos, content, case when score > 0 then round(score, 9) else {SCORE} end as score, case when score > 0 then 'rerank_or_metadata' else 'heuristic' end as score_source
 from (select c.*, b.text as question from cand c join benchmark b on item_id = query_id)),
ev as (select * from (select *, row_number() over (partition by query_id order by score desc, pos) as selected_rank from ev0) where selected_rank <= 6)"""


@query("c05_select_evidence", f"with {EVID} select query_id, source, pos, round(score, 6) as score, score_source, selected_rank from ev")
def _(spark, d):
    e = context.select_evidence(_candidates(spark, d), _questions(spark, d))
    return e.select("query_id", "source", "pos", F.round("score", 6).alias("score"), "score_source", "selected_rank")


@query("c06_select_reranked", f"""with {GATHER}, o as (select query_id, pos, score, row_number() over (partition by query_id order by pos) as rn, count(*) over (partition by query_id) as n from cand),
r as (select *, row_number() over (partition by query_id order by rn desc) as sr from o)
select query_id, pos, 1.0::double / rn as score, sr as selected_rank from r where sr <= 4""")
def _(spark, d):
    c = _candidates(spark, d)
    from pyspark.sql import Window as W

    rk = c.select("query_id", (F.row_number().over(W.partitionBy("query_id").orderBy("pos")) - 1).alias("index"))
    rk = rk.select("query_id", "index", (1 / (F.col("index") + 1)).alias("relevance"), (-F.col("index")).alias("pos"))
    return context.select_reranked(c, rk, 4)


@query("c07_rough_tokens", "select doc_id, case when length(text) = 0 then 0 else greatest(1, length(text) // 2) end as tokens from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.rough_tokens(F.col("text")).alias("tokens"))


HT = f"""ht as (select query_id, string_agg('- ' || role || ': ' || {sq.strip('content')}, chr(10) order by pos) as content from
 (select *, row_number() over (partition by query_id order by pos desc) as r2 from hist where r <= 12 and {sq.strip('content')} <> '') where r2 <= 6 group by 1)"""
TOK = "case when length(content) = 0 then 0 else greatest(1, length(content) // 2) end"
PACK = f"""{EVID}, {HT}, pk0 as (select item_id as query_id, 0 as ordinal, 'user_question' as kind, 'question' as source, text as content, 1.0::double as relevance from benchmark
 union all select query_id, 1, 'conversation_history', 'history', content, 0.6::double from ht where query_id in (select item_id from benchmark)
 union all select query_id, 1 + selected_rank, 'evidence', 'evidence:' || source, {sq.strip('content')}, score from ev where score >= 0.1::double
 union all select query_id, 100, 'candidate_summary', 'candidate_summary', string_agg(n || '. [' || source || '] ' || {sq.strip('content')}, chr(10) order by n), 0.35::double
  from (select *, row_number() over (partition by query_id order by pos) as n from cand where query_id in (select item_id from benchmark)) where n <= 3 and {sq.strip('content')} <> '' group by 1
 union all select item_id, 101, 'mode_hint', 'mode_hint', '{rules.MODE_HINTS['deep']}', 0.95::double from benchmark),
pk as (select *, {TOK} as tokens from pk0)"""


def _packets(spark, d):
    q, c = _questions(spark, d), _candidates(spark, d)
    ev = context.select_evidence(c, q)
    return context.structure(q, _history(spark, d), ev, c)


@query("c08_structure", f"with {PACK} select query_id, ordinal, kind, source, content, tokens, round(relevance, 6) as relevance from pk")
def _(spark, d):
    return _packets(spark, d).withColumn("relevance", F.round("relevance", 6))


LINES = f"list_filter(list_transform(string_split(text, chr(10)), lambda x: {sq.strip('x')}), lambda x: x <> '')"


@query("c09_compress_lines", f"""with l as (select doc_id, list_filter({LINES}, lambda x, i: not list_contains(({LINES})[1:i - 1], x)) as c from documents)
select doc_id, array_to_string(case when len(c) <= 6 then c else list_concat(list_concat(c[1:2], ['...']), c[len(c) - 2:len(c)]) end, chr(10)) as lines from l""")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", F.array_join(context.compress_lines(F.split("text", "\n")), "\n").alias("lines"))


HL = LINES.replace("text", "content")
DIG = f"""{PACK}, dg0 as (select *, list_filter({HL}, lambda x, i: not list_contains(({HL})[1:i - 1], x)) as c, {sq.strip("replace(content, chr(10), ' ')")} as flat from pk),
dg1 as (select query_id, ordinal, case kind when 'conversation_history' then 'history_digest' when 'candidate_summary' then 'compressed_tail' else kind end as kind,
 case kind when 'conversation_history' then 'history_digest' when 'candidate_summary' then 'compressed_tail' else source end as source,
 case kind when 'conversation_history' then '最近会话摘要：' || chr(10) || array_to_string(list_transform(case when len(c) <= 6 then c else list_concat(list_concat(c[1:2], ['...']), c[len(c) - 2:len(c)]) end, lambda x: '- ' || x), chr(10))
  when 'candidate_summary' then '其余相关内容摘要：' || chr(10) || '- [candidate_summary] ' || case when length(flat) > 72 then left(flat, 69) || '...' else flat end else content end as content,
 case kind when 'conversation_history' then greatest(0.6::double, relevance) when 'candidate_summary' then greatest(0.3::double, relevance * 0.7::double) else relevance end as relevance from dg0),
dg as (select *, {TOK} as tokens from dg1)"""


@query("c10_digests", f"with {DIG} select query_id, kind, source, content, tokens, round(relevance, 6) as relevance from dg where kind in ('history_digest', 'compressed_tail')")
def _(spark, d):
    g = context.digests(_packets(spark, d)).where("kind in ('history_digest', 'compressed_tail')")
    return g.select("query_id", "kind", "source", "content", "tokens", F.round("relevance", 6).alias("relevance"))


FIT = f"""{DIG}, f0 as (select *, case kind when 'user_question' then 0 when 'mode_hint' then 1 when 'history_digest' then 2 when 'evidence' then 3 else 4 end as prio,
 case when kind = 'evidence' then relevance else 0 end as rel from dg),
f1 as (select *, coalesce(sum(tokens) over (partition by query_id order by prio, rel desc, ordinal desc rows between unbounded preceding and 1 preceding), 0)::bigint as b,
 row_number() over (partition by query_id order by prio, rel desc, ordinal desc) as position from f0),
ft as (select query_id, position, kind, source, tokens > 2400 - b as was_cut, case when tokens <= 2400 - b then content else left(content, greatest(1, (2400 - b) * 2 - 3)) || '...' end as content from f1 where b < 2400)"""


@query("c11_fit_budget", f"with {FIT} select *, {TOK} as tokens from ft")
def _(spark, d):
    f = context.fit_budget(context.digests(_packets(spark, d)))
    return f.select("query_id", "position", "kind", "source", "was_cut", "content", "tokens")


FINAL = f"""{FIT}, ee as (select query_id, count(*) as evidence_count, string_agg(selected_rank || '. [' || source || '] ' || {sq.strip('content')}, chr(10) order by selected_rank) as e from ev where {sq.strip('content')} <> '' group by 1),
pp as (select query_id, count(*) as packet_count, bool_or(kind = 'history_digest') as dgst, string_agg(position || '. [' || source || '] ' || {sq.strip('content')}, chr(10) order by position) as p from ft group by 1),
nn as (select query_id, count(*) filter (source = 'note') as note_count from cand group by 1), hn as (select query_id, least(6, count(*)) as history_used from hist where r <= 12 and {sq.strip('content')} <> '' group by 1),
tt as (select item_id as query_id, {sq.strip(f'''concat_ws(chr(10), '【模式】deep', '【会话ID】' || item_id, '【用户问题】' || text, '', '【会话历史】',
 case when dgst then '已压缩为结构化摘要，请直接查看下方【结构化上下文】中的 history_digest。' else '无' end, '', '【关键证据】', coalesce(e, '无'), '', '【结构化上下文】', coalesce(p, '无'), '', '【处理要求】', '{rules.MODE_DEMANDS['deep']}')''')} as t,
 coalesce(history_used, 0) as history_used, coalesce(evidence_count, 0) as evidence_count, coalesce(packet_count, 0) as packet_count, coalesce(note_count, 0) as note_count
 from benchmark left join ee on ee.query_id = item_id left join pp on pp.query_id = item_id left join nn on nn.query_id = item_id left join hn on hn.query_id = item_id)
select query_id, case when length(t) <= 12000 then t else left(t, 11997) || '...' end as final_context, least(length(t), 12000) as final_chars, history_used, evidence_count, packet_count, note_count from tt"""


@query("c12_assemble", f"with {FINAL}")
def _(spark, d):
    q, h, c = _questions(spark, d), _history(spark, d), _candidates(spark, d)
    ev = context.select_evidence(c, q)
    p = context.fit_budget(context.digests(context.structure(q, h, ev, c)))
    return context.assemble(q, h, ev, p, c)


@query("c13_context_build", f"with {FINAL}")
def _(spark, d):
    return context.build(_questions(spark, d), _history(spark, d), _candidates(spark, d))
