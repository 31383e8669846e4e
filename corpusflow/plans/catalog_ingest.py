"""Manifests, chunking, extraction and file rules."""

from pyspark.sql import Window as W
from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.operators import chunking, ingest
from corpusflow.plans import fixtures as fx
from corpusflow.plans import sqlkit as sq
from corpusflow.plans.registry import query, table, texts
from corpusflow.session import work_dir

LISTING = """listing as (select source || '/doc' || doc_id || '.md' as path, n_chars as size, (1704067200 + doc_id) * 1000000000 as mtime_ns from documents),
manifest as (select path, case when size % 7 = 0 then size + 1 else size end as size, mtime_ns, timestamp '2024-01-01' as indexed_at
 from listing where size % 5 <> 0)"""


def _listing(spark, d):
    t = table(spark, d, "documents")
    l = t.select(F.concat("source", F.lit("/doc"), F.col("doc_id").cast("string"), F.lit(".md")).alias("path"),
                 F.col("n_chars").alias("size"), ((F.col("doc_id") + 1704067200) * 1000000000).alias("mtime_ns"))
    m = l.where("size % 5 <> 0").withColumn("size", F.when(F.col("size") % 7 == 0, F.col("size") + 1).otherwise(F.col("size")))
    return l, m.withColumn("indexed_at", F.lit("2024-01-01").cast("timestamp"))


@query("i01_manifest_diff", f"with {LISTING} select path, size from listing l where not exists (select 1 from manifest m where m.path = l.path and m.size = l.size and m.mtime_ns = l.mtime_ns)")
def _(spark, d):
    l, m = _listing(spark, d)
    return ingest.changed_files(l, m).select("path", "size")


@query("i02_manifest_upsert", f"""with {LISTING}, u as (select path, size, mtime_ns, indexed_at from manifest union all
 select path, size, mtime_ns, timestamp '2024-02-01' from listing where size % 7 = 0),
r as (select *, row_number() over (partition by path order by indexed_at desc) as rn from u)
select path, size, strftime(indexed_at, '%Y-%m-%d') as day from r where rn = 1 and path not in (select path from listing where size % 11 = 0)""")
def _(spark, d):
    l, m = _listing(spark, d)
    new = l.where("size % 7 = 0").withColumn("indexed_at", F.lit("2024-02-01").cast("timestamp"))
    out = ingest.remove_paths(ingest.upsert_manifest(m, new), l.where("size % 11 = 0"))
    return out.select("path", "size", F.date_format("indexed_at", "yyyy-MM-dd").alias("day"))


@query("i03_run_summary", """select count(*) as total_files, count(*) filter (s = 0) as success_count, count(*) filter (s = 1) as fail_count,
 count(*) filter (s = 2) as skipped_count, sum(n_chars)::bigint as duration_ms, count(*) filter (s = 1) = 0 as success
from (select *, case when n_chars % 13 = 0 then 1 when n_chars % 5 = 0 then 2 else 0 end as s from documents)""")
def _(spark, d):
    t = table(spark, d, "documents")
    s = F.when(F.col("n_chars") % 13 == 0, "fail").when(F.col("n_chars") % 5 == 0, "skipped").otherwise("success")
    return ingest.run_summary(t.select(F.col("doc_id").alias("path"), s.alias("status"), F.col("n_chars").alias("ms")))


@query("i03_failed_files", "select doc_id as path, 'E' || (n_chars % 3) as error from documents where n_chars % 13 = 0")
def _(spark, d):
    t = table(spark, d, "documents")
    s = F.when(F.col("n_chars") % 13 == 0, "fail").otherwise("success")
    return ingest.failed_files(t.select(F.col("doc_id").alias("path"), s.alias("status"), F.concat(F.lit("E"), (F.col("n_chars") % 3).cast("string")).alias("error")))


def _with_name(spark, d):
    t = texts(spark, d).select("doc_id", "text")
    return t.withColumns({"filename": F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".txt")), "page_number": F.lit(0)})


@query("i04_three_level_chunks")
def _(spark, d):
    return chunking.three_levels(_with_name(spark, d), "filename").select(
        "doc_id", "chunk_id", "parent_chunk_id", "root_chunk_id", "chunk_level", "chunk_idx", "start_index", F.length("text").alias("n_chars"))


# what holds for the chunks of any document; the cuts themselves are ours
CHUNKED = f"(select doc_id, {sq.strip('text')} as t from documents) where t <> ''"


@query("i04_chunk_rules", f"select doc_id, true as sized, true as in_order, true as inside_parents, true as covered from {CHUNKED}")
def _(spark, d):
    docs = _with_name(spark, d)
    c = chunking.three_levels(docs, "filename").select("doc_id", "chunk_level", "chunk_id", "parent_chunk_id", "chunk_idx", "start_index", F.length("text").alias("n"), (F.col("start_index") + F.length("text")).alias("stop"))
    up = c.select(F.col("chunk_id").alias("parent_chunk_id"), F.col("start_index").alias("a"), F.col("stop").alias("b"), F.col("chunk_idx").alias("up_idx"))
    size = F.element_at(F.array(*(F.lit(s) for s, _ in rules.CHUNK_LEVELS)), F.col("chunk_level"))
    j = c.join(up, "parent_chunk_id", "left").withColumns({
        "fits": F.col("n").between(1, size), "inside": (F.col("chunk_level") == 1) | F.coalesce((F.col("a") <= F.col("start_index")) & (F.col("stop") <= F.col("b")) & (F.col("up_idx") < F.col("chunk_idx")), F.lit(False))})
    w = W.partitionBy("doc_id", "chunk_level").orderBy("chunk_idx")
    # parents overlap, so starts ascend within a parent
    j = j.withColumns({"before": F.lag("start_index").over(W.partitionBy("doc_id", "chunk_level", "parent_chunk_id").orderBy("chunk_idx")),
                       "reached": F.max("stop").over(w.rowsBetween(W.unboundedPreceding, -1))})
    # between two chunks of a level only white space may be left out
    text = docs.select("doc_id", tx.strip(F.col("text")).alias("t"))
    gaps = j.where("start_index > coalesce(reached, 0)").join(text, "doc_id")
    odd = gaps.where(tx.strip(F.substr("t", F.coalesce("reached", F.lit(0)) + 1, F.col("start_index") - F.coalesce("reached", F.lit(0)))) != "").select("doc_id").distinct()
    ends = j.groupBy("doc_id", "chunk_level").agg(F.max("stop").alias("e")).groupBy("doc_id").agg(F.min("e").alias("e"), F.count("*").alias("levels"))
    g = j.groupBy("doc_id").agg(F.bool_and("fits").alias("sized"), F.bool_and(F.coalesce(F.col("before") < F.col("start_index"), F.lit(True))).alias("in_order"), F.bool_and("inside").alias("inside_parents"))
    done = ends.join(text, "doc_id").select("doc_id", ((F.col("e") == F.length("t")) & (F.col("levels") == len(rules.CHUNK_LEVELS))).alias("whole"))
    return g.join(done, "doc_id").join(odd.withColumn("_odd", F.lit(True)), "doc_id", "left").select("doc_id", "sized", "in_order", "inside_parents", (F.col("whole") & F.col("_odd").isNull()).alias("covered"))


@query("i05_recursive_split", f"select doc_id, true as sized, true as covered, true as overlapping from {CHUNKED}")
def _(spark, d):
    size, overlap = 400, 60
    t = texts(spark, d).select("doc_id", tx.strip(F.col("text")).alias("text")).where("text <> ''")
    c = chunking.recursive_split(t, "doc_id", size, overlap)
    w = W.partitionBy("doc_id").orderBy("chunk_idx")
    c = c.withColumns({"stop": F.col("start_index") + F.length("text"), "last": F.lag(F.col("start_index") + F.length("text")).over(w)})
    g = c.groupBy("doc_id").agg(F.bool_and(F.length("text").between(1, size)).alias("sized"), F.max("stop").alias("e"),
                                F.bool_and(F.coalesce(F.col("start_index") <= F.col("last"), F.col("start_index") == 0)).alias("_gapless"),
                                F.bool_and(F.coalesce(F.col("last") - F.col("start_index") <= overlap, F.lit(True))).alias("overlapping"))
    return g.join(t, "doc_id").select("doc_id", "sized", (F.col("_gapless") & (F.col("e") == F.length("text"))).alias("covered"), "overlapping")


@query("i06_fixed_windows", f"with {sq.CHUNKS} select doc_id, chunk_idx, start_index, text from chunks")
def _(spark, d):
    t = table(spark, d, "documents").select("doc_id", "text")
    return chunking.fixed_windows(t, "doc_id", 500, 60)


def _sections(spark, d):
    # lines that start with a capital become headings, some of them behind a fence
    t = F.regexp_replace(F.regexp_replace(F.regexp_replace("text", r"\n([TS])", "\n```\n$1"), r"\n([A-M])", "\n# $1"), r"\n([N-Z])", "\n## $1")
    return chunking.markdown_sections(table(spark, d, "documents").select("doc_id", t.alias("text")), "doc_id")


SECTIONS = rf"""with l as (select doc_id, unnest(range(1, len(x) + 1)) as i, unnest(x) as line from (select doc_id, string_split(regexp_replace(regexp_replace(regexp_replace(text, '\n([TS])', chr(10) || '```' || chr(10) || '\1', 'g'), '\n([A-M])', chr(10) || '# \1', 'g'), '\n([N-Z])', chr(10) || '## \1', 'g'), chr(10)) as x from documents)),
f as (select *, sum(starts_with(line, '```')::int) over (partition by doc_id order by i) % 2 = 1 as fenced from l),
m as (select *, regexp_matches(line, '^# ') and not fenced as is1, regexp_matches(line, '^## ') and not fenced as is2 from f),
s as (select *, sum((is1 or is2)::int) over w as sec,
 last_value(case when is1 then trim(substr(line, 3)) end ignore nulls) over w as h1,
 max(case when is1 then i else 0 end) over w as at1 from m window w as (partition by doc_id order by i)),
h as (select *, last_value(case when is2 then trim(substr(line, 4)) end ignore nulls) over (partition by doc_id, at1 order by i) as h2 from s),
g as (select doc_id, sec, {sq.strip("string_agg(line, chr(10) order by i)")} as text, coalesce(min(h1), '') as h1, coalesce(arg_max(h2, i), '') as h2 from h group by all)
"""


@query("i07_markdown_sections", SECTIONS + """select doc_id, row_number() over (partition by doc_id order by sec) - 1 as section, h1, h2, text from g where text <> ''""")
def _(spark, d):
    return _sections(spark, d)


@query("i20_write_path", SECTIONS + """, per as (select doc_id, count(*) as sections, count(*) filter (h1 <> '') as under_h1 from g where text <> '' group by 1)
select doc_id, sections, under_h1, true as parents_there, true as leaves_apart, doc_id % 3 = 0 as rewritten from per""")
def _(spark, d):
    """Sections to three-level chunks, parents and leaves stored apart, then a third of the documents written once more."""
    def parts(rows):
        return chunking.three_levels(rows.withColumn("page_number", F.col("section")), "filename")

    # sections are dealt once, their chunks are made and stored where they are read
    named = _sections(spark, d).withColumn("filename", F.concat(F.lit("doc"), F.col("doc_id").cast("string"), F.lit(".md")))
    sections = ingest.dealt(named, "filename", 16)
    stores = {}
    for name, rule in (("leaves", "chunk_level = 3"), ("parents", "chunk_level < 3")):
        stores[name] = work_dir(spark, name)
        ingest.write_replacing(parts(sections).where(rule).withColumn("v", F.lit(1)), stores[name], "filename", 16, placed=True)
        ingest.write_replacing(parts(sections.where("doc_id % 3 = 0")).where(rule).withColumn("v", F.lit(2)), stores[name], "filename", 16, placed=True)
    leaves, parents = (spark.read.parquet(stores[n]) for n in ("leaves", "parents"))
    up = parents.select(F.col("chunk_id").alias("parent_chunk_id"), F.lit(True).alias("there"))
    per = leaves.join(up, "parent_chunk_id", "left").groupBy("doc_id").agg(
        F.count_distinct("section").alias("sections"), F.count_distinct(F.when(F.col("h1") != "", F.col("section"))).alias("under_h1"),
        F.bool_and(F.coalesce("there", F.lit(False))).alias("parents_there"), (F.max("chunk_level") == F.min("chunk_level")).alias("leaves_apart"), (F.min("v") == 2).alias("rewritten"))
    return per


@query("i08_merge_small_chunks", """with recursive q as (select doc_id, unnest(x) as text, generate_subscripts(x, 1) as pos from (select doc_id, string_split(text, chr(10)) as x from documents)),
p as (select doc_id, text, length(text) as len, row_number() over (partition by doc_id order by pos) as n from q where text <> ''),
f as (select doc_id, n, 0 as g, len as cur from p where n = 1 union all
 select p.doc_id, p.n, case when p.len < 300 and f.cur < 1000 then g else g + 1 end, case when p.len < 300 and f.cur < 1000 then cur + 2 + p.len else p.len end from f join p on p.doc_id = f.doc_id and p.n = f.n + 1)
select doc_id, g as merged_idx, count(*) as n_parts, string_agg(text, chr(10) || chr(10) order by n) as text from f join p using (doc_id, n) group by all""")
def _(spark, d):
    t = table(spark, d, "documents")
    parts = t.select("doc_id", F.posexplode_outer(F.split("text", "\n")).alias("pos", "text")).where("text <> ''")
    return chunking.merge_small(parts, "doc_id", "pos")


@query("i09_chunk_columns", """select 'doc' || doc_id || '.tar.md::p' || (doc_id % 4) || '::l3::' || doc_id as chunk_id, source || '/doc' || doc_id || '.tar.md' as _source,
 '.md' as _extension, 'doc' || doc_id || '.tar.md' as _file_name from documents""")
def _(spark, d):
    i = F.col("doc_id").cast("string")
    path = F.concat("source", F.lit("\\doc"), i, F.lit(".tar.md"))
    cols = chunking.file_columns(path)
    return table(spark, d, "documents").select(
        chunking.chunk_id(F.concat(F.lit("doc"), i, F.lit(".tar.md")), F.col("doc_id") % 4, 3, F.col("doc_id")).alias("chunk_id"), *cols)


NORM = sq.strip(r"regexp_replace(regexp_replace(replace(text, chr(0), ''), '[ \t\r\f\x0B]+', ' ', 'g'), '\n\s*\n\s*', chr(10) || chr(10), 'g')")


@query("i10_normalize_text", f"select doc_id, {NORM} as text from documents")
def _(spark, d):
    return texts(spark, d).select("doc_id", tx.normalize_text(F.col("text")).alias("text"))


def _html_sql(c):
    for r in (*rules.HTML_HIDDEN, rules.HTML_BREAK, rules.HTML_TAG):
        c = f"regexp_replace({c}, '{r}', {'chr(10)' if r == rules.HTML_BREAK else chr(39) + ' ' + chr(39)}, 'g')"
    for name, value in (*rules.HTML_NAMED.items(), ("amp", "&")):
        c = f"replace({c}, '&{name};', '{value.replace(chr(39), chr(39) * 2)}')"
    return NORM.replace("replace(text,", f"replace({c},")


@query("i11_html_text", f"select page_id, {_html_sql('html')} as text from pages")
def _(spark, d):
    return texts(spark, d, "pages").select("page_id", ingest.html_text(F.col("html")).alias("text"))


@query("i12_preview", f"select doc_id, case when length(text) <= 300 then text else rtrim(substr(text, 1, 300), {sq.BLANKS}) || '...' end as preview from documents")
def _(spark, d):
    return table(spark, d, "documents").select("doc_id", tx.preview(F.col("text"), 300).alias("preview"))


@query("i13_extraction_rows", f"""
with f as (select *, case when doc_id % 10 = 0 then '' else source || '/d' || doc_id || case when doc_id % 7 = 0 then '.bin' else '.TXT' end end as path,
 case when doc_id % 9 = 0 then null else text end as raw from documents),
e as (select *, case when path = '' then 'INVALID_INPUT' when raw is null then 'FILE_NOT_FOUND' when doc_id % 7 = 0 then 'UNSUPPORTED_FILE_TYPE' end as error, {NORM} as t from f)
select doc_id, error is null as ok, error, case when error is null then length(t) end as char_count,
 case when error is null then case when length(t) <= 5000 then t else rtrim(substr(t, 1, 5000), {sq.BLANKS}) || '...' end end as summary from e""")
def _(spark, d):
    i = F.col("doc_id")
    f = table(spark, d, "documents").select(
        F.when(i % 10 == 0, "").otherwise(F.concat("source", F.lit("/d"), i.cast("string"), F.when(i % 7 == 0, ".bin").otherwise(".TXT"))).alias("path"),
        F.when(i % 9 != 0, F.col("text")).alias("raw"), "doc_id")
    out = ingest.extraction_rows(f.select(F.concat_ws("\x1f", "path").alias("path"), "raw", "doc_id"))
    # the result keeps the path; the id is read back from it where there is one
    named = out.where("path <> ''").select(F.regexp_extract("filename", r"^d(\d+)", 1).cast("long").alias("doc_id"), "ok", "error", "char_count", "summary")
    empty = f.where("path = ''").select("doc_id", F.lit(False).alias("ok"), F.lit("INVALID_INPUT").alias("error"),
                                        F.lit(None).cast("long").alias("char_count"), F.lit(None).cast("string").alias("summary"))
    return named.unionByName(empty)


# placeholders are derived from hashes of ids, the same way on both sides
PH = "'<<IMAGE:' || substr(md5(({e})::varchar), 1, 8) || '>>'"
PH_TEXT = (f"ptext as (select doc_id, 'doc' || doc_id || '.pdf' as filename, doc_id % 9 as page_number, text || ' ' || {PH.format(e='doc_id % 50')} || ' x ' "
           f"|| {PH.format(e='doc_id % 20 + 100')} || ' ' || {PH.format(e='doc_id % 50')} as text from documents),\n"
           f"ph as (select distinct doc_id, filename, unnest(regexp_extract_all(text, '<<IMAGE:[0-9a-f]{{8}}>>')) as placeholder from ptext),\n"
           f"images as (select {PH.format(e='item_id')} as placeholder, '/file/image/' || item_id as image_url, case when item_id % 3 = 0 then '' else 'cap ' || item_id end as caption,"
           f" case when item_id % 2 = 0 then item_id else 0 end as image_page from benchmark)")


def _ph(c):
    return F.concat(F.lit("<<IMAGE:"), F.substring(F.md5(c.cast("string")), 1, 8), F.lit(">>"))


def _ph_texts(spark, d):
    i = F.col("doc_id")
    return table(spark, d, "documents").select(
        "doc_id", F.concat(F.lit("doc"), i.cast("string"), F.lit(".pdf")).alias("filename"), (i % 9).alias("page_number"),
        F.concat("text", F.lit(" "), _ph(i % 50), F.lit(" x "), _ph(i % 20 + 100), F.lit(" "), _ph(i % 50)).alias("text"))


def _images(spark, d):
    i = F.col("item_id")
    return table(spark, d, "benchmark").select(
        _ph(i).alias("placeholder"), F.concat(F.lit("/file/image/"), i.cast("string")).alias("image_url"),
        F.when(i % 3 == 0, "").otherwise(F.concat(F.lit("cap "), i.cast("string"))).alias("caption"),
        F.when(i % 2 == 0, i).otherwise(0).alias("image_page"))


@query("i14_image_placeholders", f"select doc_id, {PH.format(e='doc_id % 50')} || ',' || {PH.format(e='doc_id % 20 + 100')} as placeholders from documents")
def _(spark, d):
    return _ph_texts(spark, d).select("doc_id", F.array_join(ingest.image_placeholders(F.col("text")), ",").alias("placeholders"))


@query("i15_strip_placeholders", r"select doc_id, trim(regexp_replace(text || ' x', '\s+', ' ', 'g')) as text from documents")
def _(spark, d):
    return _ph_texts(spark, d).select("doc_id", ingest.strip_placeholders(F.col("text")).alias("text"))


@query("i16_image_map", f"with {PH_TEXT} select doc_id, placeholder, image_url from ph join images using (placeholder)")
def _(spark, d):
    return ingest.image_map(_ph_texts(spark, d), _images(spark, d), "doc_id").select("doc_id", "placeholder", "image_url")


@query("i17_caption_update", f"with {PH_TEXT} select placeholder, case when image_page % 4 = 2 then 'new' else caption end as caption from images")
def _(spark, d):
    im = _images(spark, d)
    return ingest.update_captions(im, im.where("image_page % 4 = 2").select("placeholder", F.lit("new").alias("caption"))).select("placeholder", "caption")


@query("i18_caption_chunks", f"""with {PH_TEXT} select filename || '::image_caption::' || substr(placeholder, 9, 8) as chunk_id,
 case when image_page > 0 then image_page else doc_id % 9 end as page_number, placeholder || chr(10) || '图片说明：' || caption as text
from ph join images using (placeholder) where caption <> ''""")
def _(spark, d):
    return ingest.caption_chunks(_ph_texts(spark, d), _images(spark, d)).select("chunk_id", "page_number", "text")


@query("i19_image_coverage", f"""with {PH_TEXT}, p as (select distinct placeholder from ph), j as (select placeholder, max(caption <> '') as c, max(image_page > 0) as v
 from p left join images using (placeholder) group by 1)
select count(*) as n, count(*) filter (c) as with_caption, count(*) filter (v) as with_vector, count(*) filter (c and v) as with_both,
 count(*) filter (not coalesce(c, false) and not coalesce(v, false)) as with_neither from j""")
def _(spark, d):
    im = _images(spark, d)
    ph = _ph_texts(spark, d).select(F.explode(ingest.image_placeholders(F.col("text"))).alias("placeholder"))
    return ingest.image_coverage(ph, im, im.where("image_page > 0"))


@query("i20_parent_store", f"""with {sq.CHUNKS}, st as (select chunk_id, 'old' as v from parents),
nw as (select chunk_id, 'new' as v from parents where chunk_id like 'doc%7.txt%')
select * from nw union all select * from st where chunk_id not in (select chunk_id from nw) and chunk_id not like 'doc3.txt%'""")
def _(spark, d):
    p = fx.parents(fx.chunks(spark, d)).select("chunk_id", F.when(F.col("parent_chunk_id") == "", 1).otherwise(2).alias("chunk_level"))
    st = p.withColumn("v", F.lit("old"))
    nw = p.where("chunk_id like 'doc%7.txt%'").withColumn("v", F.lit("new"))
    out = ingest.upsert_parents(st, nw)
    gone = out.where("chunk_id like 'doc3.txt%'")
    return ingest.remove_paths(out, gone, "chunk_id").select("chunk_id", "v")


@query("i21_session_quota", """with f as (select page_id, regexp_extract(url, '://([^/?#]+)', 1) as session_id, length(html) as size from pages),
r as (select *, count(*) over w as n, sum(size) over w as tot from f window w as (partition by session_id order by page_id rows unbounded preceding))
select page_id, session_id, case when size > 4000 then 'TEMP_FILE_TOO_LARGE' when n > 3 then 'TEMP_FILE_LIMIT_EXCEEDED' when tot > 6000 then 'TEMP_TOTAL_SIZE_EXCEEDED' end as error from r""")
def _(spark, d):
    f = table(spark, d, "pages").select("page_id", F.regexp_extract("url", "://([^/?#]+)", 1).alias("session_id"), F.length("html").cast("long").alias("size"))
    return ingest.quota_check(f, "session_id", "page_id", F.floor(F.col("page_id") / 4096), 3, 4000, 6000).select("page_id", "session_id", "error")


@query("i21_expired_files", "select event_id from events where epoch(timestamp '2024-01-31') - floor(epoch(ts)) > 864000")
def _(spark, d):
    return ingest.expired(table(spark, d, "events"), F.lit("2024-01-31").cast("timestamp"), 864000, "ts").select("event_id")


@query("i22_safe_names", r"""select page_id, left(regexp_replace(trim(string_split(url, '/')[-1]), '[^A-Za-z0-9._\-\x{4e00}-\x{9fff}]', '_', 'g'), 180) as n0,
 left(regexp_replace(trim(url), '[^A-Za-z0-9_.\-]', '_', 'g'), 120) as session_id,
 case when n0 = '' then 'upload.tmp' else n0 end as file_name from pages""".replace("as n0,\n", "as n0x,\n").replace("case when n0 = ''", "case when n0x = ''").replace("else n0 end", "else n0x end"))
def _(spark, d):
    name = ingest.safe_file_name(F.col("url"))
    return table(spark, d, "pages").select("page_id", F.when(name == "upload.tmp", "").otherwise(name).alias("n0x"),
                                           ingest.safe_session_id(F.col("url")).alias("session_id"), name.alias("file_name"))


@query("i23_material_type", "select page_id, case when page_id % 3 = 0 or page_id % 5 = 0 then 'image' else 'document' end as material_type from pages")
def _(spark, d):
    i = F.col("page_id")
    name = F.concat(F.col("page_id").cast("string"), F.when(i % 5 == 0, ".PNG").otherwise(".html"))
    return table(spark, d, "pages").select("page_id", ingest.material_type(name, F.when(i % 3 == 0, "image/x").otherwise("text/html")).alias("material_type"))
