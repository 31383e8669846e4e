"""Paper and report tables."""

from pyspark.sql import functions as F

from corpusflow.functions import text as tx
from corpusflow import rules
from corpusflow.operators import papers
from corpusflow.plans import sqlkit as sq
from corpusflow.plans.registry import query, table, texts


def _docs(spark, d):
    return texts(spark, d)


@query("p01_abstract_from_index", r"select doc_id, trim(regexp_replace(text, '\s+', ' ', 'g')) as abstract from documents")
def _(spark, d):
    idx = papers.inverted_index(_docs(spark, d).select("doc_id", "text"), "doc_id", "text")
    return idx.select("doc_id", papers.abstract_from_index(F.col("index")).alias("abstract"))


@query("p02_doi_from_url", """select page_id, case page_id % 3 when 0 then '10.48550/arXiv.2101.' || page_id when 1 then '10.1234/abc.' || page_id else '' end as doi from pages""")
def _(spark, d):
    i, s = F.col("page_id"), F.col("page_id").cast("string")
    url = F.when(i % 3 == 0, F.concat(F.lit("https://arxiv.org/pdf/2101."), s, F.lit("v2.pdf"))).when(
        i % 3 == 1, F.concat(F.lit("https://doi.org/10.1234/abc."), s, F.lit(").,"))).otherwise(F.col("url"))
    return table(spark, d, "pages").select("page_id", papers.doi_from_url(url).alias("doi"))


TITLE = "case when doc_id % 17 = 0 then '' else split_part(text, chr(10), 1) end"


def _titled(spark, d):
    i = F.col("doc_id")
    title = F.when(i % 17 == 0, "").otherwise(tx.first_line(F.col("text")))
    return _docs(spark, d).select(F.col("lang").alias("session_id"), "doc_id", title.alias("title"))


def _key(c):
    return f"lower({sq.strip(c)})"


@query("p03_title_dedup", f"""with t as (select lang as session_id, doc_id, {TITLE} as title from documents)
select session_id, min(doc_id) as doc_id from t where {_key('title')} <> '' group by session_id, {_key('title')}
union all select session_id, doc_id from t where {_key('title')} = ''""")
def _(spark, d):
    return papers.dedup_titles(_titled(spark, d), "session_id", ["doc_id"]).select("session_id", "doc_id")


@query("p04_citation_pool", f"""with t as (select source as session_id, doc_id, {TITLE} as title from documents),
f as (select *, row_number() over (partition by session_id order by doc_id) as rn from t)
select session_id, min(doc_id) as doc_id from f where rn <= 10 and {_key('title')} <> '' group by session_id, {_key('title')}""")
def _(spark, d):
    i = F.col("doc_id")
    title = F.when(i % 17 == 0, "").otherwise(tx.first_line(F.col("text")))
    rows = _docs(spark, d).select(F.col("source").alias("session_id"), "doc_id", title.alias("title"))
    return papers.citation_pool(rows, "session_id", "doc_id", 30).select("session_id", "doc_id")


WORDS = ("Abstract", "Background", "algorithm", "results", "Discussion", "[12]", "ablation")


def _paper_text(spark, d):
    """Texts with some section words appended by a fixed rule."""
    i = F.col("doc_id")
    extra = [F.when(i % (n + 2) == 0, w) for n, w in enumerate(WORDS)]
    return _docs(spark, d).select("doc_id", F.concat_ws(" ", "text", *extra).alias("text"))


PTEXT = "ptext as (select doc_id, concat_ws(' ', text, " + ", ".join(f"case when doc_id % {n + 2} = 0 then '{w}' end" for n, w in enumerate(WORDS)) + ") as text from documents)"


def _has(ws):
    return "(" + " or ".join(f"contains(lower(t), '{w}')" for w in ws) + ")"


SIG = {n: _has(ws) for n, ws in rules.SECTION_SIGNALS.items()}
SIG["references"] = f"({SIG['references']} or regexp_matches(t, '\\[[0-9]{{1,3}}\\]'))"
QUALITY = f"""{PTEXT}, s as (select doc_id, t, length(t) >= 80 as ok, {', '.join(f'{c} as s_{n}' for n, c in SIG.items())} from (select doc_id, {sq.strip('text')} as t from ptext)),
q as (select *, round(least(10.0::double, 4.0::double + {' + '.join(f's_{n}::int * 0.8::double' for n in SIG)} + (length(t) > 2500)::int * 0.5::double + {_has(rules.ABLATION_WORDS)}::int * 0.5::double), 1) as score from s)"""


@query("p05_paper_quality", f"with {QUALITY} select doc_id, ok, case when ok then score end as score from q")
def _(spark, d):
    return papers.paper_quality(_paper_text(spark, d), "doc_id").select("doc_id", "ok", "score")


def _band(s):
    return f"case when {s} >= 8 then '较强' when {s} >= 6 then '中等' else '偏弱' end"


def _names(cond, names):
    return "array_to_string(list_filter([" + ", ".join(f"case when {cond} s_{n} then '{n}' end" for n in names) + "], lambda x: x is not null), ',')"


THREE = ("method", "experiment", "references")


@query("p06_review_arrays", f"""with {QUALITY} select doc_id, {_names('not', SIG)} as missing_sections, {_names('', THREE)} as strengths, {_names('not', THREE)} as weaknesses,
 {_band('score')} as novelty, {_band('(score - (not s_experiment)::int)')} as soundness from q""")
def _(spark, d):
    return papers.paper_quality(_paper_text(spark, d), "doc_id").drop("ok", "score")


SOURCES = """src as (select source as session_id, lang as branch_id, doc_id as pos, case when doc_id % 4 = 0 then '' when doc_id % 4 = 1 then 'GitHub' else 'Web' end as venue,
 split_part(text, chr(10), 1) as title, case when doc_id % 5 = 0 then '' else text end as abstract, case when doc_id % 3 = 0 then '' else 'http://x/' || doc_id end as url from documents)"""


def _sources(spark, d):
    i = F.col("doc_id")
    return _docs(spark, d).select(
        F.col("source").alias("session_id"), F.col("lang").alias("branch_id"), i.alias("pos"),
        F.when(i % 4 == 0, "").when(i % 4 == 1, "GitHub").otherwise("Web").alias("venue"), tx.first_line(F.col("text")).alias("title"),
        F.when(i % 5 == 0, "").otherwise(F.col("text")).alias("abstract"),
        F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("http://x/"), i.cast("string"))).alias("url"))


LEARN = f"""{SOURCES}, c as (select *, {sq.strip('venue')} as v, coalesce(nullif({sq.strip('title')}, ''), '来源') as t, {sq.strip('abstract')} as a0, {sq.strip('url')} as u from src),
l0 as (select *, case when length(a0) > 120 then rtrim(left(a0, 120), {sq.BLANKS}) || '...' else a0 end as a from c),
l as (select session_id, branch_id, pos, abstract, concat_ws(': ', case when v <> '' then '[' || v || '] ' else '' end || t, nullif(a, ''), nullif(u, '')) as learning from l0)"""


@query("p07_source_learning", f"with {LEARN} select pos as doc_id, learning from l")
def _(spark, d):
    c = [F.col(x) for x in ("venue", "title", "abstract", "url")]
    return _sources(spark, d).select(F.col("pos").alias("doc_id"), papers.source_learning(*c).alias("learning"))


BRANCHES = """br as (select distinct source as session_id, lang as branch_id, 'goal ' || lang as goal from documents union all select distinct source, 'zz', 'goal zz' from documents)"""
BLEARN = f"""{LEARN}, {BRANCHES}, ld as (select session_id, branch_id, {_key("coalesce(nullif(abstract, ''), learning)")} as k, min(pos) as pos from l group by all),
lr as (select *, row_number() over (partition by session_id, branch_id order by pos) as rank from ld join l using (session_id, branch_id, pos)),
bl as (select session_id, branch_id, coalesce(rank, 1) as rank, coalesce(learning, goal || '：暂无可用来源，需要继续检索。') as learning from br left join (select * from lr where rank <= 5) using (session_id, branch_id))"""


def _branches(spark, d):
    t = _docs(spark, d)
    g = lambda c: F.concat(F.lit("goal "), c)
    a = t.select(F.col("source").alias("session_id"), F.col("lang").alias("branch_id"), g(F.col("lang")).alias("goal")).distinct()
    return a.unionByName(t.select(F.col("source").alias("session_id")).distinct().select("session_id", F.lit("zz").alias("branch_id"), F.lit("goal zz").alias("goal")))


def _learnings(spark, d):
    return papers.branch_learnings(_branches(spark, d), _sources(spark, d))


@query("p08_branch_learnings", f"with {BLEARN} select * from bl")
def _(spark, d):
    return _learnings(spark, d)


GLOB = f"""{BLEARN}, gl as (select session_id, branch_id, rank, learning from (select *, row_number() over (partition by session_id, {_key('learning')} order by branch_id, rank) as rn from bl) where rn = 1)"""


@query("p09_global_learnings", f"with {GLOB} select * from gl")
def _(spark, d):
    return papers.global_learnings(_learnings(spark, d)).select("session_id", "branch_id", "rank", "learning")


@query("p10_report_counts", f"""with {GLOB} select session_id, (select count(*) from br b where b.session_id = s.session_id) as branch_count,
 (select count(*) from src b where b.session_id = s.session_id) as source_count, (select count(*) from gl b where b.session_id = s.session_id) as learning_count
from (select distinct source as session_id from documents) s""")
def _(spark, d):
    return papers.report_counts(_branches(spark, d), _sources(spark, d), papers.global_learnings(_learnings(spark, d)))


@query("p11_report_quality", f"""with {SOURCES}, s as (select distinct lang || '/' || source as session_id, source from documents),
k as (select source, count(*) as n, count(*) filter (venue = 'GitHub') as gh, count(*) filter (venue not in ('', 'GitHub') and url like 'http%') as web from (select *, session_id as source from src where pos in (select doc_id from labels where toxic = 1)) group by 1),
rp as (select source, min(doc_id) as i from documents group by 1),
j as (select session_id, coalesce(n, 0) as n, coalesce(gh, 0) as gh, coalesce(web, 0) as web, length({sq.strip('text')}) as rl from s left join k using (source) left join rp using (source) left join documents on doc_id = i)
select session_id, n > 0 and rl > 0 as passed, concat_ws(',', case when n = 0 then 'no_sources' end, case when rl = 0 then 'empty_report' end) as issues,
 concat_ws(',', case when n between 1 and 2 then 'few_sources' end, case when rl between 1 and 199 then 'short_report' end, case when gh = 0 then 'no_repositories' end, case when web = 0 then 'no_web_results' end) as warnings,
 n as source_count, rl as report_length from j""")
def _(spark, d):
    t = _docs(spark, d)
    s = t.select(F.concat_ws("/", "lang", "source").alias("session_id"), "source").distinct()
    of = lambda df: s.join(df.withColumnRenamed("session_id", "source"), "source").drop("source")
    rep = t.groupBy("source").agg(F.min_by("text", "doc_id").alias("report"))
    flagged = table(spark, d, "labels").where("toxic = 1").select(F.col("doc_id").alias("pos"))
    src = _sources(spark, d).join(flagged, "pos", "left_semi")
    br = s.select("session_id")
    q = papers.report_quality(s.select("session_id"), br, of(src), br, s.join(rep, "source").select("session_id", "report"))
    return q.drop("branch_count", "learning_count")


REFS = f"""rf as (select session_id, branch_id, pos, title, url, row_number() over (partition by session_id order by branch_id, pos) as number from
 (select *, row_number() over (partition by session_id, {_key('title')} order by branch_id, pos) as rn from src where {_key('title')} <> '') where rn = 1)"""


@query("p12_report_markdown", f"""with {GLOB}, {REFS},
g as (select session_id, string_agg('- ' || learning, chr(10) order by branch_id, rank) as g from gl group by 1),
r as (select session_id, string_agg('[' || number || '] ' || {sq.strip('title')} || case when url <> '' then chr(10) || '    ' || url else '' end, chr(10) order by number) as r from rf group by 1)
select session_id, '# T ' || session_id || chr(10) || chr(10) || '## 核心发现' || chr(10) || g || chr(10) || chr(10) || '## 研究结论' || chr(10) || 'done' || chr(10) || chr(10)
 || '## 参考文献' || chr(10) || chr(10) || r || chr(10) as report from g join r using (session_id)""")
def _(spark, d):
    return papers.report_markdown(*_report_inputs(spark, d))


@query("p12_report_lines", f"""with {GLOB}, {REFS},
g as (select session_id, learning, row_number() over (partition by session_id order by branch_id, rank) as n from gl),
ln as (select 2 as section, n as ordinal, '- ' || learning as line, session_id from g
 union all select 5, number, '[' || number || '] ' || {sq.strip('title')} || case when url <> '' then chr(10) || '    ' || url else '' end, session_id from rf),
hd as (select * from (values (1, 1, '## 核心发现', 2), (3, 0, '', 2), (4, 1, '', 5), (4, 2, '## 参考文献', 5), (4, 3, '', 5)) v(section, ordinal, line, needs)),
ss as (select distinct source as session_id from documents)
select session_id, section, ordinal::bigint as ordinal, line from ln
union all select distinct ln.session_id, hd.section, hd.ordinal, hd.line from hd join ln on ln.section = hd.needs
union all select session_id, 0, 1, '# T ' || session_id from ss union all select session_id, 0, 2, '' from ss
union all select session_id, 3, 1, '## 研究结论' from ss union all select session_id, 3, 2, 'done' from ss""")
def _(spark, d):
    return papers.report_lines(*_report_inputs(spark, d))


def _report_inputs(spark, d):
    s = _docs(spark, d).select(F.col("source").alias("session_id")).distinct()
    s = s.select("session_id", F.concat(F.lit("T "), F.col("session_id")).alias("title"), F.lit("done").alias("answer"))
    return s, _learnings(spark, d), _sources(spark, d).withColumns({"authors": F.lit(""), "year": F.lit(""), "source": F.lit("academic")})


def _ranked_papers(spark, d):
    from corpusflow.functions.skew import top_k

    i = F.col("doc_id")
    p = _docs(spark, d).select(F.col("source").alias("query_id"), i, tx.first_line(F.col("text")).alias("title"), F.col("lang").alias("authors"), F.lit("V").alias("venue"),
                               (2000 + F.col("n_chars") % 25).alias("year"), (F.col("n_chars") % 150).alias("citation_count"),
                               F.when(i % 3 == 0, "").otherwise("http://x").alias("url"), F.col("text").alias("abstract"))
    return top_k(p, ["query_id"], [F.desc("citation_count"), F.asc("doc_id")], 5)


RANKED = """rp as (select * from (select source as query_id, *, row_number() over (partition by source order by n_chars % 150 desc, doc_id) as rank from documents) where rank <= 5)"""


@query("p13_paper_list", f"""with {RANKED} select query_id, string_agg(rank || '. ' || split_part(text, chr(10), 1) || chr(10) || 'Authors: ' || lang || chr(10) || 'Venue/Year: V ' || (2000 + n_chars % 25) || chr(10)
 || 'Citations: ' || (n_chars % 150) || case when doc_id % 3 = 0 then '' else chr(10) || 'URL: http://x' end || case when text = '' then '' else chr(10) || 'Abstract: ' || case when length(text) > 1600 then left(text, 1600) || '...' else text end end,
 chr(10) || chr(10) order by rank) as paper_list from rp group by 1""")
def _(spark, d):
    return papers.paper_list(_ranked_papers(spark, d), "query_id", 5)


@query("p13_compact_payload", rf"""with {RANKED}, a as (select *, trim(regexp_replace(text, '\s+', ' ', 'g')) as a from rp where rank <= 3)
select query_id, rank, split_part(text, chr(10), 1) as title, 2000 + n_chars % 25 as year, n_chars % 150 as citation_count, case when length(a) <= 280 then a else rtrim(left(a, 280), {sq.BLANKS}) || '...' end as abstract from a""")
def _(spark, d):
    return papers.compact_payload(_ranked_papers(spark, d), "query_id")


NOISE = " or ".join(f"contains(lower(item), '{w}')" for w in rules.SLIDE_PLACEHOLDERS)


@query("p14_outline_items", rf"""with r as (select source as query_id, doc_id, trim(regexp_replace(case when doc_id % 3 = 0 then replace(text, '.', '。') when doc_id % 3 = 1 then replace(text, ',', ';') else source end, '\s+', ' ', 'g')) as t from documents),
p as (select query_id, doc_id, unnest(x) as item, generate_subscripts(x, 1) as n from (select *, list_filter(list_transform(string_split_regex(t, '[。\n\r;；]+'), lambda x: {sq.strip('x')}), lambda x: x <> '') as x from r)),
k as (select *, row_number() over (partition by query_id, item order by doc_id, n) as rn from p where not regexp_matches(item, '^[{{}}\[]') and not ({NOISE}))
select query_id, doc_id, n - 1 as part, item from k where rn = 1""")
def _(spark, d):
    i = F.col("doc_id")
    e = _docs(spark, d).select(
        F.col("source").alias("query_id"), i, F.when(i % 3 == 0, F.replace("text", F.lit("."), F.lit("。"))).alias("snippet"),
        F.when(i % 3 == 1, F.replace("text", F.lit(","), F.lit(";"))).otherwise(" ").alias("summary"), F.col("source").alias("title"))
    return papers.outline_items(e, "query_id", "doc_id")


@query("p15_report_sections", r"""with l as (select doc_id, unnest(x) as line, generate_subscripts(x, 1) as i from (select doc_id, string_split(regexp_replace(text, '\n([A-M])', chr(10) || '## \1', 'g'), chr(10)) as x from documents)),
c as (select doc_id, i, trim(regexp_replace(line, '\s+', ' ', 'g')) as t from l), s as (select *, sum((t like '## %')::int) over (partition by doc_id order by i)::bigint as sec from c),
h as (select doc_id, sec, trim(substr(t, 4)) as title from s where t like '## %'),
b as (select doc_id, sec, row_number() over (partition by doc_id, sec order by i) - 1 as bullet, regexp_replace(t, '^- ', '') as text from s where sec > 0 and t <> '' and not starts_with(t, '#'))
select doc_id, sec - 1 as section, title, bullet, text from h left join b using (doc_id, sec) where title <> ''""")
def _(spark, d):
    t = F.regexp_replace("text", r"\n([A-M])", "\n## $1")
    return papers.report_sections(_docs(spark, d).select("doc_id", t.alias("text")), "doc_id")


@query("p16_page_layout", """with p as (select conv_id, turn, case turn % 4 when 0 then 'overview' when 1 then '总结' else 'x' end as purpose, length(text) % 6 as n_items, (length(text) % 5 = 0)::int as n_images, length(text) as tl,
 turn = min(turn) over w as f, turn = max(turn) over w as l from conversations window w as (partition by conv_id))
select conv_id, turn, case when f then 'cover' when l and purpose = '总结' then 'closing' when n_images > 0 and n_items <= 3 then 'image_text' when n_items >= 4 or (n_items >= 2 and tl >= 110) then 'two_column'
 when purpose = 'overview' then 'overview' else 'single_column_text' end as layout from p""")
def _(spark, d):
    n = F.length("text")
    p = table(spark, d, "conversations").select(
        "conv_id", "turn", F.when(F.col("turn") % 4 == 0, "overview").when(F.col("turn") % 4 == 1, "总结").otherwise("x").alias("purpose"),
        (n % 6).alias("n_items"), F.when(n % 5 == 0, 1).otherwise(0).alias("n_images"), n.alias("text_length"))
    return papers.page_layouts(p, "conv_id", "turn").select("conv_id", "turn", "layout")


def _any(ws):
    return "(" + " or ".join(f"contains(lower(t), '{w}')" for w in ws) + ")"


@query("p17_text_quality", rf"""with l as (select doc_id, n, case n % 3 when 1 then 'title' when 2 then 'bullet' else 'manuscript' end as part, trim(regexp_replace(x, '\s+', ' ', 'g')) as t
 from (select doc_id, unnest(s) as x, generate_subscripts(s, 1) as n from (select doc_id, string_split(text, chr(10)) as s from documents))),
c as (select doc_id, n as line, part, length(t) as length, unnest([
 case when part = 'manuscript' and {_any((*rules.SLIDE_PLACEHOLDERS, *rules.MANUSCRIPT_PLACEHOLDERS))} then 'internal_text' end,
 case when part <> 'manuscript' and {_any(rules.SLIDE_PLACEHOLDERS)} then 'placeholder_text' end, case when part = 'bullet' and length(t) > 160 then 'long_bullet' end,
 case when part = 'title' and length(t) > 80 then 'long_title' end, case when part = 'manuscript' and length(t) > 220 then 'long_line' end,
 case when part = 'manuscript' and (contains(t, '{{"') or contains(t, '"}}') or contains(lower(t), '{{debug')) then 'structured_text' end]) as code from l where t <> '')
select *, case when code in ('placeholder_text', 'long_bullet') then 'issue' else 'warning' end as severity from c where code is not null""")
def _(spark, d):
    l = _docs(spark, d).select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("p", "text"))
    n = F.col("p") + 1
    l = l.select("doc_id", n.alias("line"), F.when(n % 3 == 1, "title").when(n % 3 == 2, "bullet").otherwise("manuscript").alias("part"), "text")
    return papers.text_quality(l, ["doc_id", "line"])


@query("p17_page_alignment", "select conv_id, max(turn) + 1 = count(*) or max(turn) < 0 as aligned from conversations group by 1")
def _(spark, d):
    c = table(spark, d, "conversations").groupBy("conv_id").agg((F.max("turn") + 1).alias("outline"), F.count("*").alias("layout"))
    return papers.page_count_alignment(c, "conv_id", ["outline", "layout"])
