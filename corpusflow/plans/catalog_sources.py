"""Sources, sinks and streams. Files and payloads are written or built by Spark from the tables first."""

from datetime import timedelta

from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions.skew import running
from corpusflow.operators import chunking, conversation, ingest, traces
from corpusflow.plans import fixtures as fx
from corpusflow.plans import sqlkit as sq
from corpusflow.plans.catalog_dialog import MSG, _messages
from corpusflow.plans.catalog_eval import FAIL, RES, SPANS, SUMMARY, _classified, _results, _spans
from corpusflow.plans.registry import query, table
from corpusflow.session import materialize, work_dir
from corpusflow.sources import files, payloads, tables
from corpusflow.streaming import jobs, state


def _docs(spark, d):
    return table(spark, d, "documents")


def _text_files(spark, d):
    """Every conversation as a text file of its own, a line or more per turn."""
    path = work_dir(spark, "texts")
    t = table(spark, d, "conversations").select("conv_id", "turn", "text")
    t.repartition("conv_id").sortWithinPartitions("conv_id", "turn").drop("turn").write.partitionBy("conv_id").text(path)
    return path


def _conv_id():
    return F.regexp_extract("path", r"conv_id=(\d+)", 1).cast("long").alias("conv_id")


@query("s01_text_files", "select conv_id, string_agg(text, chr(10) order by turn) as text from conversations group by 1")
def _(spark, d):
    f = files.text_files(spark, _text_files(spark, d))
    # the writer ends each row with a line break
    return f.where(files.allowed(F.col("path"))).select(_conv_id(), F.substring(F.col("raw"), F.lit(1), F.length("raw") - 1).alias("text"))


@query("s02_listing", "select conv_id, sum(octet_length(encode(text)) + 1)::bigint as size, true as dated from conversations group by 1")
def _(spark, d):
    f = files.listing(spark, _text_files(spark, d), "*.txt")
    return f.select(_conv_id(), "size", F.col("mtime").isNotNull().alias("dated"))


@query("s03_csv_tables", "select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by 1")
def _(spark, d):
    base = work_dir(spark, "csv")
    for n in ("orders", "customer"):
        table(spark, d, n).write.option("header", True).csv(f"{base}/{n}")
    names = tables.register(spark, tables.read_csv(spark, [f"{base}/orders", f"{base}/customer"]))
    return tables.run_sql(spark, "select c_mktsegment, count(*) as n, round(sum(o_totalprice), 2) as total from orders join customer on o_custkey = c_custkey group by 1", names)


@query("s04_table_names", r"""with b as (select p_partkey, case when regexp_matches(n, '^[0-9]') then 't_' || n else n end as base from (select p_partkey, regexp_replace(p_size || ' ' || p_type, '[^\p{L}\p{N}_]', '_', 'g') as n from part)),
r as (select *, row_number() over (partition by base order by p_partkey) as rn from b) select p_partkey, base || case when rn > 1 then '_' || (rn - 1) else '' end as name from r""")
def _(spark, d):
    b = table(spark, d, "part").select("p_partkey", tables.safe_name_column(F.concat_ws(" ", F.col("p_size").cast("string"), "p_type")).alias("base"))
    r = running(b, ["base"], F.floor(F.col("p_partkey") / 4096), ["p_partkey"], {"rn": F.lit(1)})
    return r.select("p_partkey", F.concat("base", F.when(F.col("rn") > 1, F.concat(F.lit("_"), (F.col("rn") - 1).cast("string"))).otherwise("")).alias("name"))


@query("s05_markdown_export", "select '| ' || o_orderkey || ' | ' || replace(o_orderstatus || '|' || o_orderpriority, '|', '\\|') || ' | ' || strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') || ' |' as value from orders")
def _(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", F.concat_ws("|", "o_orderstatus", "o_orderpriority").alias("s"), "o_orderdate")
    path = work_dir(spark, "export")
    tables.export(o, path, "md")
    return spark.read.text(f"{path}/part=1-rows")


def _exported(spark, d, fmt):
    o = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 7 != 0, F.concat_ws('", ', "o_orderstatus", "o_orderpriority")).alias("s"), "o_orderdate")
    path = work_dir(spark, "export")
    tables.export(o, path, fmt)
    return path


EXPORTED = """select o_orderkey, case when o_orderkey % 7 <> 0 then o_orderstatus || '", ' || o_orderpriority end as s, strftime(o_orderdate, '%Y-%m-%dT%H:%M:%S') as o_orderdate from orders"""


@query("s05_csv_export", EXPORTED)
def _(spark, d):
    return spark.read.option("header", True).option("escape", '"').schema("o_orderkey long, s string, o_orderdate string").csv(_exported(spark, d, "csv"))


@query("s05_json_export", EXPORTED)
def _(spark, d):
    return spark.read.schema("o_orderkey long, s string, o_orderdate string").json(_exported(spark, d, "json"))


def _json(df, spark, label):
    path = work_dir(spark, label)
    df.write.option("ignoreNullFields", True).json(path)
    return path


@query("s06_evaluation_cases", """select 'c' || item_id as id, trim(text) as question, case when item_id % 2 = 0 then 'quick' else 'deep' end as mode, 'medium' as difficulty, case when item_id % 3 = 0 then 2 else 0 end as n_include,
 case when item_id % 3 = 0 then 'a b' else '' end as must_include from benchmark""")
def _(spark, d):
    i = F.col("item_id")
    c = table(spark, d, "benchmark").select(F.concat(F.lit(" c"), i.cast("string")).alias("id"), F.col("text").alias("question"), F.when(i % 2 == 0, "quick").alias("mode"),
                                            F.when(i % 3 == 0, F.array(F.lit("a"), F.lit("b"))).alias("must_include"), F.lit("x").alias("unknown_key"))
    e = files.evaluation_cases(spark, _json(c, spark, "cases"))
    return e.select("id", "question", "mode", "difficulty", F.size("must_include").alias("n_include"), F.array_join("must_include", " ").alias("must_include"))


@query("s07_tool_cases", "select 't' || item_id as id, 'search' as tool_name, item_id % 3 <> 0 as expect_ok, case when item_id % 3 = 0 then 'E' else '' end as expected_error_code, case when item_id % 2 = 0 then 'v' || item_id end as q from benchmark")
def _(spark, d):
    i, s = F.col("item_id"), F.col("item_id").cast("string")
    c = table(spark, d, "benchmark").select(
        F.concat(F.lit("t"), s).alias("id"), F.lit("search").alias("tool_name"), F.when(i % 3 == 0, False).alias("expect_ok"), F.when(i % 3 == 0, "E").alias("expected_error_code"),
        F.when(i % 2 == 0, F.create_map(F.lit("q"), F.concat(F.lit("v"), s))).alias("args"))
    return files.tool_cases(spark, _json(c, spark, "tool-cases")).select("id", "tool_name", "expect_ok", "expected_error_code", F.try_element_at("args", F.lit("q")).alias("q"))


@query("s08_run_scan", "select 'r' || event_id as run_id, 's' || user_id as session_id, event_type as status, 1 as n_steps from events where event_type <> 'error'")
def _(spark, d):
    e = table(spark, d, "events")
    s = lambda c: F.col(c).cast("string")
    step = F.struct(F.lit("a").alias("step_name"), F.col("value").alias("latency_ms"))
    line = F.to_json(F.struct(F.concat(F.lit("r"), s("event_id")).alias("run_id"), F.concat(F.lit("s"), s("user_id")).alias("session_id"), F.col("event_type").alias("status"),
                              F.date_format("ts", "yyyy-MM-dd'T'HH:mm:ss.SSS").alias("started_at"), F.array(step).alias("steps")))
    # runs of one kind are cut off in the middle
    broken = F.when(F.col("event_type") == "error", F.left(line, F.length(line) - 9)).otherwise(line)
    path = work_dir(spark, "runs")
    b = files.session_bucket(F.concat(F.lit("s"), s("user_id")))
    e.select(broken.alias("value"), b.alias("bucket")).repartition("bucket").write.partitionBy("bucket").text(path)
    return files.runs(spark, path).select("run_id", "session_id", "status", F.size("steps").alias("n_steps"))


@query("s09_history_append", f"""with {MSG} select session_id, seq, content from msg union all
select session_id, (select max(seq) from msg m where m.session_id = n.session_id) + row_number() over (partition by session_id order by seq), 'again ' || content from msg n where role = 'user'""")
def _(spark, d):
    h = _messages(spark, d)
    new = h.where("role = 'user'").withColumn("pos", F.col("seq")).drop("seq").withColumn("content", F.concat(F.lit("again "), F.col("content")))
    return conversation.append_messages(h, new).select("session_id", "seq", "content")


FLAT = r"trim(regexp_replace(text, '\s+', ' ', 'g'))"


@query("s10_works", f"""select doc_id, left({sq.strip('text')}, 30) as title, {FLAT} as abstract, 'A ' || lang || ', B' as authors, source as venue, '20' || (10 + doc_id % 10) as year, n_chars as citation_count, 'http://x/' || doc_id as url, 'openalex' as source from documents""".replace("left(" + sq.strip('text') + ", 30)", "'T ' || doc_id"))
def _(spark, d):
    from corpusflow.operators import papers

    t = _docs(spark, d)
    s = F.col("doc_id").cast("string")
    author = lambda n: F.struct(F.struct(n.alias("display_name")).alias("author"))
    j = papers.inverted_index(t, "doc_id", "text").select("doc_id", F.to_json(F.struct(
        F.concat(F.lit(" T "), s).alias("title"), F.col("index").alias("abstract_inverted_index"), F.concat(F.lit("20"), (10 + F.col("doc_id") % 10).cast("string")).alias("publication_year"),
        F.col("n_chars").alias("cited_by_count"), F.concat(F.lit("http://x/"), s).alias("id"), F.array(author(F.concat(F.lit("A "), F.col("lang"))), author(F.lit("")), author(F.lit("B"))).alias("authorships"),
        F.struct(F.struct(F.col("source").alias("display_name")).alias("source")).alias("primary_location"))).alias("payload"))
    return payloads.works(j, "payload", ["doc_id"]).drop("doi")


@query("s11_flat_papers", f"select doc_id, 'T' as title, {sq.strip('text')} as abstract, lang as authors, source as venue, '' as year, n_chars as citation_count, '' as url, '' as doi, 'semanticscholar' as source from documents")
def _(spark, d):
    j = _docs(spark, d).select("doc_id", F.to_json(F.struct(F.lit("T ").alias("title"), F.col("text").alias("abstract"), F.col("source").alias("venue"), F.col("n_chars").alias("citationCount"),
                                                           F.array(F.struct(F.col("lang").alias("name")), F.struct(F.lit("").alias("name"))).alias("authors"))).alias("payload"))
    return payloads.flat_papers(j, "payload", ["doc_id"])


@query("s12_feed_papers", f"""select 'http://arxiv.org/abs/24.' || doc_id || 'v1' as url, 'T' || doc_id as title, {FLAT} as abstract, lang || ', Z' as authors, '2024' as year, '10.48550/arXiv.24.' || doc_id as doi from documents""")
def _(spark, d):
    s = F.col("doc_id").cast("string")
    e = _docs(spark, d).select(
        F.concat(F.lit("http://arxiv.org/abs/24."), s, F.lit("v1")).alias("id"), F.concat(F.lit(" T"), s).alias("title"), F.trim(F.regexp_replace("text", r"\s+", " ")).alias("summary"),
        F.lit("2024-05-01T00:00:00Z").alias("published"), F.array(F.struct(F.col("lang").alias("name")), F.struct(F.lit("Z").alias("name"))).alias("author"))
    path = work_dir(spark, "feed")
    e.write.format("xml").option("rootTag", "feed").option("rowTag", "entry").save(path)
    return payloads.feed_papers(payloads.read_feed(spark, path)).select("url", "title", "abstract", "authors", "year", "doi")


@query("s13_repositories", f"select page_id, 'o/r' || page_id as repo_name, case when length(h) <= 200 then h else rtrim(left(h, 200), {sq.BLANKS}) || '...' end as description, page_id * 2 as stars, url, '' as language, 'a,b' as topics from (select *, {FLAT.replace('text', 'html')} as h from pages)")
def _(spark, d):
    s = F.col("page_id").cast("string")
    j = table(spark, d, "pages").select("page_id", F.to_json(F.struct(F.concat(F.lit("o/r"), s).alias("full_name"), F.col("html").alias("description"), (F.col("page_id") * 2).alias("stargazers_count"),
                                                                     F.col("url").alias("html_url"), F.array(F.lit("a"), F.lit("b")).alias("topics"))).alias("payload"))
    return payloads.repositories(j, "payload", ["page_id"]).withColumn("topics", F.array_join("topics", ","))


@query("s14_full_texts", "select page_id, page_id::varchar as id, 'T' as title, case when page_id % 2 = 0 then '2024-01-0' || (page_id % 9) else '2020' end as published, 'X and Y' as authors, html as abstract, url from pages")
def _(spark, d):
    i = F.col("page_id")
    j = table(spark, d, "pages").select("page_id", F.to_json(F.struct(
        i.cast("string").alias("id"), F.lit("T").alias("title"), F.col("html").alias("abstract"), F.when(i % 2 == 0, F.concat(F.lit("2024-01-0"), (i % 9).cast("string"))).alias("publishedDate"),
        F.lit("2020").alias("yearPublished"), F.when(i % 3 == 0, F.col("url")).alias("sourceFulltextUrls"), F.col("url").alias("downloadUrl"),
        F.array(F.struct(F.lit("X").alias("name")), F.struct(F.lit("Y").alias("name"))).alias("authors"))).alias("payload"))
    return payloads.full_texts(j, "payload", ["page_id"])


@query("s15_web_results", """select page_id, p - 1 as pos, case when p = 1 then 'A' else '' end as title, url, case p when 1 then html else 'c' end as snippet, case when p = 1 then 'site' else 'web' end as source from pages, (values (1), (2)) v(p)""")
def _(spark, d):
    f = lambda **k: F.struct(*[v.alias(n) for n, v in k.items()])
    a = F.array(F.to_json(f(name=F.lit("A"), link=F.col("url"), summary=F.col("html"), site_name=F.lit("site"))), F.to_json(f(url=F.col("url"), content=F.lit("c"))))
    key = F.when(F.col("page_id") % 3 == 0, "results").when(F.col("page_id") % 3 == 1, "documents").otherwise("data")
    p = F.concat(F.lit('{"items": [], "'), key, F.lit('": ['), F.array_join(a, ","), F.lit("]}"))
    return payloads.web_results(table(spark, d, "pages").select("page_id", p.alias("payload")), "payload", ["page_id"])


@query("s16_fallback_chain", """with a as (select source as query_id, doc_id from documents where lang = 'es' and n_chars > 3000), b as (select source as query_id, doc_id from documents where lang = 'de' and n_chars > 3000), c as (select source as query_id, doc_id from documents where lang = 'fr')
select *, 0 as priority from a union all select *, 1 from b where query_id not in (select query_id from a) union all select *, 2 from c where query_id not in (select query_id from a) and query_id not in (select query_id from b)""")
def _(spark, d):
    t = _docs(spark, d).select(F.col("source").alias("query_id"), "doc_id", "lang", "n_chars")
    pick = lambda cond: t.where(cond).select("query_id", "doc_id")
    return payloads.fallback_chain(pick("lang = 'es' and n_chars > 3000"), pick("lang = 'de' and n_chars > 3000"), pick("lang = 'fr'"))


def _branch_sql(i, t, g):
    return f"select item_id as query_id, 'branch_{i + 1}' as branch_id, trim(text) || ' {t}' as branch_query, '{g}。优先近三年（2024-2026）文献' as branch_goal, 2024 as min_year from benchmark"


BRANCHES = " union all ".join(_branch_sql(i, t, g) for i, (t, g) in enumerate(rules.BRANCH_TEMPLATES))


@query("s17_branch_sources", f"""with b as ({BRANCHES}), n as (select count(*) as n from benchmark)
select query_id, branch_id, branch_query, 'T' || doc_id as title, 'academic' as kind from documents, n join b on b.query_id = doc_id % n.n and branch_id = 'branch_' || (doc_id % 3 + 1)
union all select query_id, branch_id, branch_query, 'R' || page_id, 'repository' from pages, n join b on b.query_id = page_id % n.n where page_id % 2 = 0
union all select query_id, branch_id, branch_query, 'W' || page_id, 'web' from pages, n join b on b.query_id = page_id % n.n where page_id % 2 = 1""".replace("documents, n join b on b.query_id = doc_id % n.n and", "(select * from documents, n) join b on b.query_id = doc_id % n and").replace("pages, n join b on b.query_id = page_id % n.n", "(select * from pages, n) join b on b.query_id = page_id % n"))
def _(spark, d):
    n = table(spark, d, "benchmark").agg(F.count("*").alias("n")).scalar()
    lab = lambda p, c: F.concat(F.lit(p), F.col(c).cast("string"))
    b = files.research_branches(fx.queries(spark, d), 2026)
    a = _docs(spark, d).select((F.col("doc_id") % n).alias("query_id"), F.concat(F.lit("branch_"), (F.col("doc_id") % 3 + 1).cast("string")).alias("branch_id"),
                               lab("T", "doc_id").alias("title"), F.lit("V").alias("venue"), F.lit("").alias("url"), F.lit("").alias("abstract"))
    p = table(spark, d, "pages").select("page_id", (F.col("page_id") % n).alias("query_id"), "url")
    r = p.where("page_id % 2 = 0").select("query_id", lab("R", "page_id").alias("repo_name"), "url", F.lit("").alias("description"))
    w = p.where("page_id % 2 = 1").select("query_id", lab("W", "page_id").alias("title"), F.lit("s").alias("source"), "url", F.lit("").alias("snippet"))
    return payloads.branch_sources(b, a, r, w).select("query_id", "branch_id", "branch_query", "title", "kind")


NEW_CHUNKS = f"{sq.CHUNKS}, nw as (select chunk_id, source, 'new' as v from chunks where source in ('src1', 'src2') and chunk_idx % 2 = 0)"


@query("s18_replace_by_source", f"with {NEW_CHUNKS} select chunk_id, source, 'old' as v from chunks where source not in (select source from nw) union all select * from nw")
def _(spark, d):
    c = fx.chunks(spark, d).select("chunk_id", "source", "chunk_idx")
    path = work_dir(spark, "chunks")
    ingest.write_replacing(c.select("chunk_id", "source", F.lit("old").alias("v")), path, "source", 16)
    new = c.where("source in ('src1', 'src2') and chunk_idx % 2 = 0").select("chunk_id", "source", F.lit("new").alias("v"))
    ingest.write_replacing(new, path, "source", 16)
    return spark.read.parquet(path).select("chunk_id", "source", "v")


@query("s19_chunks_by_id", f"with {sq.CHUNKS} select chunk_id, start_index from chunks where doc_id in (select item_id from benchmark) and chunk_idx = 1")
def _(spark, d):
    c = fx.chunks(spark, d)
    ids = table(spark, d, "benchmark").select(F.concat(F.lit("doc"), F.col("item_id").cast("string"), F.lit(".txt::p0::l3::1")).alias("chunk_id"))
    return c.join(ids, "chunk_id", "left_semi").select("chunk_id", "start_index")


@query("s20_scalar_filter", f"with {sq.CHUNKS} select chunk_id, source, text from chunks where source = 'src3' and chunk_idx >= 2 order by chunk_id limit 50")
def _(spark, d):
    c = fx.chunks(spark, d).where("source = 'src3' and chunk_idx >= 2")
    return c.select("chunk_id", "source", "text").orderBy("chunk_id").limit(50)


REPORT = f"""with {FAIL}, s as ({SUMMARY}), h as (select unnest(['# Evaluation Report', '', '## Summary', '', '## Failure Categories', '', '## Failed Cases']) as line)
select line from h union all select unnest(['- Total Cases: ' || total_cases, '- Passed Cases: ' || passed_cases, '- Route Accuracy: ' || route_accuracy, '- Tool Accuracy: ' || tool_accuracy,
 '- Keyword Hit Rate: ' || keyword_hit_rate, '- Evidence Hit Rate: ' || evidence_hit_rate, '- Avg Latency(ms): ' || avg_latency_ms, '- Avg Score: ' || avg_score]) from s
union all select '- ' || failure_category || ': ' || count(*) from fc where score < 0.75 group by failure_category
union all select '- `' || doc_id || '` | score=' || score || ' | category=' || failure_category || ' | reason=' || failure_reason from fc where score < 0.75"""


def _report(spark, d):
    from corpusflow.operators import evaluate

    c = materialize(_classified(spark, d), "classified")
    failed = c.where(f"score < {rules.PASS_SCORE}").withColumnRenamed("doc_id", "case_id")
    return evaluate.summarize(_results(spark, d)), evaluate.failure_counts(c), failed


@query("s21_report_lines", REPORT)
def _(spark, d):
    return files.report_lines(*_report(spark, d)).select("line")


@query("s21_report_files", f"""with {FAIL}, s as ({SUMMARY}), l as ({REPORT.replace('with ' + FAIL + ', s as (' + SUMMARY + '), ', 'with ')})
select 'summary' as part, null::bigint as case_id, total_cases || '|' || passed_cases || '|' || route_accuracy || '|' || tool_accuracy || '|' || tool_args_accuracy || '|' || keyword_hit_rate || '|' || evidence_hit_rate || '|' || avg_latency_ms || '|' || avg_score as value from s
union all select 'failed', doc_id, score || '|' || failure_category || '|' || failure_reason from fc where score < 0.75 union all select 'markdown', null, line from l""")
def _(spark, d):
    # the JSON and the Markdown as they were written, read back
    path = work_dir(spark, "report")
    summary, counts, failed = _report(spark, d)
    files.write_report(summary, counts, failed, path)
    j = lambda part, df: spark.read.schema(df.schema).json(f"{path}/{part}")
    row = lambda part, i, *c: [F.lit(part).alias("part"), i.cast("long").alias("case_id"), F.concat_ws("|", *(F.col(x).cast("string") for x in c)).alias("value")]
    none = F.lit(None)
    out = j("summary", summary).select(*row("summary", none, *summary.columns))
    out = out.unionByName(j("failed_cases", failed).select(*row("failed", F.col("case_id"), "score", "failure_category", "failure_reason")))
    return out.unionByName(spark.read.text(f"{path}/markdown").select(*row("markdown", none, "value")))


@query("s22_report_catalogue", "select 'k' || (n_chars % 7) as k, count(*) as n from documents group by 1 having count(*) > 0")
def _(spark, d):
    path = work_dir(spark, "reports")
    g = _docs(spark, d).groupBy(F.concat(F.lit("k"), (F.col("n_chars") % 7).cast("string")).alias("k")).agg(F.count("*").alias("n"))
    g.select("k", F.to_json(F.struct(F.create_map(F.lit("k"), F.col("k"), F.lit("n"), F.col("n").cast("string")).alias("summary"))).alias("value")).repartition("k").write.partitionBy("k").text(path)
    r = files.reports(spark, path, "*.txt")
    return r.select(F.try_element_at("summary", F.lit("k")).alias("k"), F.try_element_at("summary", F.lit("n")).cast("long").alias("n"))


@query("s23_trajectory_cases", """select 'c' || item_id as source_case_id, text as input, '{"steps":[{"type":"tool_call","tool_name":"search","tool_args":{"q":"v' || item_id || '"}},{"type":"final","content":"' || case when item_id % 2 = 0 then 'a b' else 'kw' end || '"}],"success":true}' as reference_answer,
 case when item_id % 3 = 0 then '' else 'deep,' end || 'quick,c' || item_id as tags from benchmark""")
def _(spark, d):
    i, s = F.col("item_id"), F.col("item_id").cast("string")
    c = table(spark, d, "benchmark").select(
        F.concat(F.lit("c"), s).alias("id"), F.col("text").alias("question"), F.when(i % 3 != 0, "deep").alias("mode"), F.lit("quick").alias("expected_route"), F.array(F.lit("search")).alias("expected_tools"),
        F.create_map(F.lit("search"), F.create_map(F.lit("q"), F.concat(F.lit("v"), s))).alias("expected_tool_args"),
        F.when(i % 2 == 0, F.array(F.lit("a"), F.lit("b"))).otherwise(F.array().cast("array<string>")).alias("must_include"), F.array(F.lit("kw")).alias("expected_keywords"), F.lit("easy").alias("difficulty"))
    return files.trajectory_cases(c).select("source_case_id", "input", "reference_answer", F.array_join("tags", ",").alias("tags"))


@query("s24_material_rows", """select page_id as session_id, case when page_id % 2 = 0 then 'web' else 'paste' end as source_type, case when page_id % 3 = 0 then 'T' else url end as title, url, case page_id % 3 when 0 then 'a,b' when 1 then 'single' else '' end as tags from pages""")
def _(spark, d):
    i = F.col("page_id")
    e = F.create_map(F.lit("sourceType"), F.when(i % 2 == 0, "web"), F.lit("title"), F.when(i % 3 == 0, " T ").otherwise(" "), F.lit("url"), F.col("url"),
                     F.lit("tags"), F.when(i % 3 == 0, '["a ", "", "b"]').when(i % 3 == 1, "single"))
    m = files.material_rows(table(spark, d, "pages").select(i.alias("session_id"), e.alias("entry")))
    return m.select("session_id", "source_type", "title", "url", F.array_join("tags", ",").alias("tags"))


@query("s25_query_fan_out", BRANCHES)
def _(spark, d):
    return files.research_branches(fx.queries(spark, d), 2026)


# ---- streams -------------------------------------------------------------------


def _arriving(spark, df, label):
    """The rows as five files that arrive one after the other, in no order."""
    path = work_dir(spark, label)
    df.repartition(5).write.parquet(path)
    return jobs.read_stream(spark, path, "*.parquet", df.schema, 1)


@query("w01_sync_stream", f"with {sq.CHUNKS} select source, count(*) as n_chunks, sum(length(text))::bigint as n_chars from chunks group by 1")
def _(spark, d):
    s = _arriving(spark, _docs(spark, d).select("doc_id", "source", "text"), "arriving")
    target = work_dir(spark, "synced")
    jobs.sync_documents(s, lambda b: chunking.fixed_windows(b, "doc_id", 500, 60), target, work_dir(spark, "synced-checkpoint"), "doc_id", 16)
    return spark.read.parquet(target).groupBy("source").agg(F.count("*").alias("n_chunks"), F.sum(F.length("text")).alias("n_chars"))


STREAM = """ev as (select conv_id as run_id, turn as seq, case when turn = 5 then 'complete' when role = 'assistant' then 'content' when role = 'user' then 'tool_call' else 'debug' end as type, text as data from conversations),
en as (select run_id, min(seq) as e from ev where type = 'complete' group by 1), kp as (select ev.* from ev left join en using (run_id) where e is null or seq <= e),
ans as (select run_id, """ + sq.strip("coalesce(string_agg(data, '' order by seq) filter (type = 'content'), '')") + """ as answer, count(*) as event_count, count(*) filter (type = 'tool_call') as tool_event_count from kp group by 1)"""


def _stream_events(t):
    ty = F.when(F.col("turn") == 5, "complete").when(F.col("role") == "assistant", "content").when(F.col("role") == "user", "tool_call").otherwise("debug")
    return t.select(F.col("conv_id").alias("run_id"), F.col("turn").alias("seq"), ty.alias("type"), F.col("text").alias("data"))


@query("w02_assemble_batch", f"with {STREAM} select * from ans")
def _(spark, d):
    return traces.assemble_stream(_stream_events(table(spark, d, "conversations")))


@query("w02_assemble_stream", f"with {STREAM} select * from ans")
def _(spark, d):
    s = _stream_events(_arriving(spark, table(spark, d, "conversations"), "arriving"))
    return traces.assemble_stream(jobs.store_events(s, work_dir(spark, "answers"), work_dir(spark, "answers-checkpoint")))


@query("w02_answer_parts", f"with {STREAM} select run_id, row_number() over (partition by run_id order by seq) as ordinal, coalesce(data, '') as part from kp where type = 'content'")
def _(spark, d):
    s = _stream_events(_arriving(spark, table(spark, d, "conversations"), "arriving"))
    return jobs.answer_parts(jobs.store_events(s, work_dir(spark, "answers"), work_dir(spark, "answers-checkpoint")))


ROLL = f"""with {SPANS.replace('as output from events', 'as output, ts from events')} select run_id, strftime(date_trunc('day', ts), '%Y-%m-%d') as day, count(*) as steps, count(*) filter (status = 'failed') as failed, round(sum(latency_ms), 4) as latency_ms from sp group by all"""


def _roll(df):
    return df.select("run_id", F.date_format("window_start", "yyyy-MM-dd").alias("day"), "steps", "failed", F.round("latency_ms", 4).alias("latency_ms"))


@query("w03_rollup_batch", ROLL)
def _(spark, d):
    return _roll(jobs.span_rollup(_spans(spark, d)))


@query("w03_rollup_stream", ROLL)
def _(spark, d):
    ty = F.col("event_type")
    s = _arriving(spark, table(spark, d, "events"), "arriving")
    s = s.select(F.col("user_id").alias("run_id"), F.when(ty == "error", "failed").otherwise("completed").alias("status"), F.col("value").alias("latency_ms"), "ts")
    return _roll(jobs.rollup_stream(s, work_dir(spark, "rollup"), work_dir(spark, "rollup-checkpoint")))


@query("w04_first_seen_stream", "select user_id, event_type, day, count(*) as n from (select distinct user_id, event_type, date_trunc('day', ts)::date::varchar as day from events) group by all")
def _(spark, d):
    e = _arriving(spark, table(spark, d, "events").withColumn("day", F.date_format("ts", "yyyy-MM-dd")), "arriving")
    out = jobs.first_seen(e, ["user_id", "event_type", "day"], "2 days", work_dir(spark, "first-seen"), work_dir(spark, "first-seen-checkpoint"))
    return out.groupBy("user_id", "event_type", "day").agg(F.count("*").alias("n"))


@query("w04_first_seen_spaced", """with recursive kept as (select user_id, event_type, min(ts) as ts from events group by all
union all select e.user_id, e.event_type, min(e.ts) from kept k join events e on e.user_id is not distinct from k.user_id and e.event_type is not distinct from k.event_type and e.ts > k.ts + interval 2 days group by e.user_id, e.event_type)
select user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts from kept""")
def _(spark, d):
    e = _arriving(spark, table(spark, d, "events").select("user_id", "event_type", "ts"), "arriving")
    out = jobs.first_seen(e, ["user_id", "event_type"], "2 days", work_dir(spark, "first-seen"), work_dir(spark, "first-seen-checkpoint"))
    return out.select("user_id", "event_type", F.date_format("ts", "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))


LATENESS = timedelta(days=10)
DECIDED = "epoch_us(ts) // 1000 < (select max(epoch_us(ts)) // 1000 - 864000000 from {0})"


def _arriving_late(spark, df, label):
    """The rows (with ``ts``) as files that arrive one after the other, every row up to five days after its time.

    The number of batches follows the time they span, not the rows or the splits of the table.
    """
    path, files = work_dir(spark, label), spark.sparkContext.defaultParallelism
    days = F.unix_micros(F.col("ts").cast("timestamp")) / 86_400_000_000 + F.pmod(F.xxhash64(*df.columns), F.lit(5))
    parts = df.withColumn("_part", F.floor(days / 5))
    for (n,) in sorted(parts.select("_part").distinct().collect()):  # one for each five days
        parts.where(F.col("_part") == n).drop("_part").repartition(files).write.mode("append").parquet(path)
    return jobs.read_stream(spark, path, "*.parquet", df.schema, 3 * files)


@query("w02_answer_rows", f"""with ev as (select *, timestamp '2024-01-01' + to_hours(conv_id * 37 % 720) + to_minutes(turn) as ts from conversations),
de as (select conv_id as run_id, turn as seq, role, text from ev where {DECIDED.format('ev')}),
kp as (select * from de where seq < 5)
select run_id, row_number() over (partition by run_id order by seq) as ordinal, coalesce(text, '') as part from kp where role = 'assistant'""")
def _(spark, d):
    t = table(spark, d, "conversations")
    after = F.make_dt_interval(hours=F.pmod(F.col("run_id") * 37, F.lit(720)).cast("int"), mins=F.col("seq").cast("int"))
    e = _stream_events(t).withColumn("ts", F.lit("2024-01-01").cast("timestamp") + after)
    out = jobs.run_to_table(state.answer_rows(_arriving_late(spark, e, "arriving"), LATENESS, timedelta(days=1)), "answer-rows", mode="append")
    return state.split_late(out, ["run_id"])[0].drop("_at")


@query("w04_spaced_state", f"""with recursive de as (select user_id, event_type, ts from events where {DECIDED.format('events')}),
kept as (select user_id, event_type, min(ts) as ts from de group by all
union all select e.user_id, e.event_type, min(e.ts) from kept k join de e on e.user_id is not distinct from k.user_id and e.event_type is not distinct from k.event_type and e.ts > k.ts + interval 2 days group by e.user_id, e.event_type)
select user_id, event_type, strftime(ts, '%Y-%m-%d %H:%M:%S.%f') as ts from kept""")
def _(spark, d):
    e = _arriving_late(spark, table(spark, d, "events").select("user_id", "event_type", "ts"), "arriving")
    out = jobs.run_to_table(state.spaced_rows(e, ["user_id", "event_type"], timedelta(days=2), LATENESS), "spaced", mode="append")
    kept = state.split_late(out, ["user_id", "event_type"])[0]
    return kept.select("user_id", "event_type", F.date_format(F.timestamp_micros("_at"), "yyyy-MM-dd HH:mm:ss.SSSSSS").alias("ts"))
