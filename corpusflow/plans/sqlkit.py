"""Building blocks of the DuckDB twins."""

from corpusflow import rules

BLANKS = "' ' || chr(9) || chr(10) || chr(13) || chr(12) || chr(11)"


def strip(c: str) -> str:
    return f"trim({c}, {BLANKS})"


def lit(values) -> str:
    return "[" + ", ".join("'" + str(v).replace("'", "''") + "'" for v in values) + "]"


def terms(c: str) -> str:
    """Index terms of a text as a list (for texts without CJK)."""
    t = f"lower({strip(c)})"
    for p in rules.BM25_PHRASES:
        t = f"replace({t}, '{p}', '{p.replace(' ', '_')}')"
    t = rf"string_split(regexp_replace({t}, '[^\x{{4e00}}-\x{{9fff}}a-z0-9_\-.]+', ' ', 'g'), ' ')"
    t = rf"list_transform({t}, lambda x: trim(regexp_replace(x, '[_\-.]{{2,}}', '_', 'g'), '_.-'))"
    return f"list_filter({t}, lambda x: x <> '' and not list_contains({lit(rules.BM25_STOP_WORDS)}, x) and not regexp_full_match(x, '[a-z]'))"


def idf(df: str, n: str) -> str:
    return f"case when coalesce({df}, 0) = 0 then ln({n} + 1) else ln(({n} - {df} + 0.5) / ({df} + 0.5) + 1) end"


def bm25(tf: str, dl: str, idf_: str, avg: str) -> str:
    return f"({idf_}) * ({tf} * 2.5) / ({tf} + 1.5 * (1 - 0.75 + 0.75 * {dl} / greatest({avg}, 1.0)))"


def lexical(docs: str, doc_id: str, text: str = "text", p: str = "") -> str:
    """CTEs ``post``, ``dfreq``, ``stats``, ``dw`` over one text column, names prefixed by ``p``."""
    return f"""
{p}tok as (select {doc_id} as id, {terms(text)} as terms from {docs}),
{p}post as (select id, dl, term, count(*) as tf from (select id, len(terms) as dl, unnest(terms) as term from {p}tok) group by all),
{p}dfreq as (select term, count(*) as df from {p}post group by term),
{p}stats as (select count(*) as n, avg(len(terms)) as avg_dl from {p}tok),
{p}dw as (select id, term, {bm25('tf', 'dl', idf('df', 'n'), 'avg_dl')} as w from {p}post join {p}dfreq using (term), {p}stats)"""


def lexical_queries(queries: str, query_id: str, text: str = "text", p: str = "") -> str:
    """CTEs ``qtok``, ``qpost``, ``qw``: query weights against the statistics of :func:`lexical`."""
    return f"""
{p}qtok as (select {query_id} as qid, {terms(text)} as terms from {queries}),
{p}qpost as (select qid, dl, term, count(*) as tf from (select qid, len(terms) as dl, unnest(terms) as term from {p}qtok) group by all),
{p}qw as (select qid, term, {bm25('tf', 'dl', idf('df', 'n'), 'avg_dl')} as w from {p}qpost left join {p}dfreq using (term), {p}stats)"""


def ranked(scores: str, k: int, out: str, p: str = "") -> str:
    return f"""
{out} as (select * from (select query_id, chunk_id, score, row_number() over (partition by query_id order by score desc, chunk_id) as rank
 from {scores}) where rank <= {k})"""


CHUNKS = """
chunks as (select doc_id, source, i as chunk_idx, 'doc' || doc_id || '.txt' as filename,
 'doc' || doc_id || '.txt::p0::l3::' || i as chunk_id, 'doc' || doc_id || '.txt::p0::l2::' || (i // 2) as parent_chunk_id,
 'doc' || doc_id || '.txt::p0::l1::' || (i // 4) as root_chunk_id, i * 440 as start_index, substr(text, (i * 440 + 1)::bigint, 500) as text
 from (select *, unnest(range(0, greatest(0, ceil((length(text) - 500) / 440.0))::int + 1)) as i from documents where length(text) > 0)),
parents as (select distinct parent_chunk_id as chunk_id, root_chunk_id as parent_chunk_id from chunks
 union all select distinct root_chunk_id, '' from chunks)"""


def _upper(level: int, leaves: int, parent: str) -> str:
    return f"""select doc_id, source, 'doc' || doc_id || '.txt::p0::l{level}::' || i as chunk_id, {parent} as parent_chunk_id, substr(text, (i * {440 * leaves} + 1)::bigint, {440 * leaves + 60}) as text, {level} as lvl
 from (select *, unnest(range(0, greatest(0, ceil((length(text) - 500) / 440.0))::int // {leaves} + 1)) as i from documents where length(text) > 0)"""


# chunks of three levels with texts
TREE = f"""{CHUNKS},
tree as (select doc_id, source, chunk_id, parent_chunk_id, text, 3 as lvl from chunks
 union all {_upper(2, 2, "'doc' || doc_id || '.txt::p0::l1::' || (i // 2)")} union all {_upper(1, 4, "''")})"""
