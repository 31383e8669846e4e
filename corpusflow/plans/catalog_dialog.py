"""Conversations, memories, notes and the answer cache."""

from pyspark.sql import functions as F

from corpusflow import rules
from corpusflow.functions import text as tx
from corpusflow.operators import cache, conversation, dense, memory
from corpusflow.plans import fixtures as fx
from corpusflow.plans import sqlkit as sq
from corpusflow.plans.registry import query, table, texts
from corpusflow.session import materialize

# assistant messages alternate between a tool call (turn % 4 = 1) and a tool result (turn % 4 = 3)
MSG = """msg as (select conv_id as session_id, turn as seq, case when role = 'assistant' and turn % 4 = 3 then 'tool' else role end as role, text as content,
 case when role = 'assistant' and turn % 4 = 3 then 'search' else '' end as tool_name, case when role = 'assistant' and turn % 4 = 3 then 'c' || conv_id || '_' || (turn - 2) else '' end as tool_call_id,
 case when role = 'assistant' and turn % 4 = 1 then 'c' || conv_id || '_' || turn else '' end as call_id, case when role = 'assistant' and turn % 4 = 1 then text else '' end as args from conversations)"""
RT = "case when length({c}) = 0 then 0 else greatest(1, length({c}) // 2) end"
MTOK = f"({RT.format(c='content')} + case when call_id <> '' then {RT.format(c='args')} + 3 else 0 end)"


def _messages(spark, d):
    t = table(spark, d, "conversations")
    tool = (F.col("role") == "assistant") & (F.col("turn") % 4 == 3)
    call = (F.col("role") == "assistant") & (F.col("turn") % 4 == 1)
    cid = lambda n: F.concat(F.lit("c"), F.col("conv_id").cast("string"), F.lit("_"), n.cast("string"))
    one = F.array(F.struct(cid(F.col("turn")).alias("id"), F.lit("search").alias("name"), F.col("text").alias("args")))
    return t.select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("seq"), F.when(tool, "tool").otherwise(F.col("role")).alias("role"), F.col("text").alias("content"),
        F.when(tool, "search").otherwise("").alias("tool_name"), F.when(tool, cid(F.col("turn") - 2)).otherwise("").alias("tool_call_id"),
        F.when(call, one).otherwise(F.array().cast("array<struct<id:string,name:string,args:string>>")).alias("tool_calls"))


@query("m01_session_tokens", f"with {MSG} select session_id, sum({MTOK})::bigint as tokens, count(*) as n_messages, sum({MTOK}) >= 500 as triggered from msg group by 1")
def _(spark, d):
    return conversation.session_tokens(_messages(spark, d), 1000, 0.5)


SUMM = f"""'[' || tool_name || '] ' || case when regexp_matches(lower(content), 'error|exception') then 'ERROR' when regexp_matches(lower(content), 'failed|timeout') then 'FAILED' else 'ok' end
 || ' | ' || length(content) || ' chars | ' || {sq.strip("replace(left(content, 80), chr(10), ' ')")} || case when length(content) > 80 then '...' else '' end"""


@query("m02_tool_summary", f"with {MSG} select session_id, seq, {SUMM} as summary from msg where role = 'tool'")
def _(spark, d):
    m = _messages(spark, d).where("role = 'tool'")
    return m.select("session_id", "seq", conversation.tool_summary().alias("summary"))


@query("m03_prune_tools", f"""with {MSG}, la as (select session_id, max(seq) as last, arg_max(call_id, seq) as id from msg where call_id <> '' group by 1),
j as (select msg.*, last, id, role = 'tool' and last is not null and tool_call_id <> id as old from msg left join la using (session_id)),
k as (select *, row_number() over (partition by session_id, old, case when old then md5(content) else seq::varchar end order by seq) as rn from j)
select session_id, seq, role, case when old then {SUMM} else content end as content, case when call_id = '' then '' when seq < last and length(args) > 120 then left(args, 117) || '...' else args end as args
from k where not old or rn = 1""")
def _(spark, d):
    p = conversation.prune_tools(_messages(spark, d))
    return p.select("session_id", "seq", "role", "content", F.coalesce(F.get(F.col("tool_calls"), F.lit(0))["args"], F.lit("")).alias("args"))


ZONES = f"""{MSG}, z0 as (select *, {MTOK} as tokens, row_number() over (partition by session_id order by seq) as no, row_number() over (partition by session_id order by seq desc) as rno,
 sum({MTOK}) over (partition by session_id order by seq desc) as back from msg),
z as (select *, case when no <= 3 then 'head' when back <= 150 or rno = 1 then 'tail' else 'middle' end as zone from z0)"""


def _zones(spark, d):
    return materialize(conversation.zones(_messages(spark, d), 3, 150), "zones")


@query("m04_zones", f"with {ZONES} select session_id, seq, tokens, zone from z")
def _(spark, d):
    return _zones(spark, d).select("session_id", "seq", "tokens", "zone")


ALIGN = f"""{ZONES}, fa as (select session_id, arg_min(role, seq) filter (zone = 'tail') as t_role, arg_min(tool_call_id, seq) filter (zone = 'tail') as t_id,
 arg_max(call_id, seq) filter (zone = 'head') as h_id, max(seq) filter (zone = 'middle' and call_id <> '') as m1 from z group by 1),
al as (select z.* exclude (zone), case when t_role = 'tool' and m1 = seq and not exists (select 1 from z y where y.session_id = z.session_id and y.zone = 'tail' and y.call_id = t_id) then 'tail'
 when zone = 'middle' and role = 'tool' and tool_call_id = h_id then 'head' else zone end as zone from z join fa using (session_id))"""


@query("m05_align_pairs", f"with {ALIGN} select session_id, seq, zone from al")
def _(spark, d):
    return conversation.align_pairs(_zones(spark, d)).select("session_id", "seq", "zone")


T200 = f"left({sq.strip('content')}, 200)"
SUMMARY = f"""{ALIGN}, sf as (select session_id, arg_max({T200}, seq) filter (role = 'user' and {T200} <> '') as lu, arg_min({T200}, seq) filter (role = 'user' and {T200} <> '') as fu,
 count(*) filter (role = 'user' and {T200} <> '') as nu, arg_max({T200}, seq) filter (role = 'assistant' and {T200} <> '') as la, max(call_id) <> '' as has_call from al where zone = 'middle' group by 1),
su as (select session_id, concat_ws(chr(10), '{conversation.HANDOFF}', '## Active Task', coalesce(lu, '(none)'), '', '## Goal / Constraints', case when nu > 1 then fu else '(none)' end, '', '## Completed Actions',
 case when has_call then '- Called tool: search' else '(none)' end, '', '## In Progress / Blocked', '(none)', '', '## Key Decisions', '(none)', '', '## Resolved Questions', coalesce(la, '(none)'), '',
 '## Pending User Asks', coalesce(lu, '(none)'), '', '## Relevant Files / Remaining Work', '(none)') as summary from sf)"""


def _summary(spark, d):
    z = materialize(conversation.align_pairs(_zones(spark, d)), "zones")
    return z, conversation.middle_summary(z)


@query("m06_middle_summary", f"with {SUMMARY} select * from su")
def _(spark, d):
    return _summary(spark, d)[1]


@query("m07_remove_orphans", f"""with {MSG}, t as (select * from msg where seq % 7 <> 1 and seq % 5 <> 3)
select session_id, seq, role, case when exists (select 1 from t y where y.session_id = t.session_id and y.tool_call_id = t.call_id and t.call_id <> '') then 1 else 0 end as n_calls from t
where (role <> 'tool' and (call_id = '' or content <> '')) or (role = 'tool' and exists (select 1 from t y where y.session_id = t.session_id and y.call_id = t.tool_call_id))""")
def _(spark, d):
    # some calls and some results are lost
    m = _messages(spark, d).where("seq % 7 <> 1 and seq % 5 <> 3")
    return conversation.remove_orphans(m).select("session_id", "seq", "role", F.size("tool_calls").alias("n_calls"))


SAVE = f"""{SUMMARY}, sv as (select session_id, sum(tokens)::bigint as before, (sum(case when zone <> 'middle' then tokens else 0 end) + coalesce(max(length(summary) // 2), 0))::bigint as after
 from al left join su using (session_id) group by 1), sr as (select *, 1 - after / before as savings from sv)"""


@query("m08_savings", f"with {SAVE} select session_id, before, after, round(savings, 6) as savings from sr")
def _(spark, d):
    return conversation.savings(*_summary(spark, d)).withColumn("savings", F.round("savings", 6))


@query("m09_thrash_flags", """with e as (select user_id, event_id, value < 10 as low from events), i as (select *, sum((not low)::int) over (partition by user_id order by event_id) as isl from e),
s as (select user_id, event_id, case when low then sum(low::int) over (partition by user_id, isl order by event_id) else 0 end as streak from i)
select user_id, event_id, streak::bigint as streak, streak >= 2 as thrashing from s""")
def _(spark, d):
    e = table(spark, d, "events").select("user_id", "event_id", "value")
    return conversation.thrash_flags(e, "user_id", "event_id", F.floor(F.col("event_id") / 4096), "value", 10).select("user_id", "event_id", "streak", "thrashing")


@query("m10_preservation", f"with {SUMMARY} select session_id, t as term, contains(lower(summary), lower(t)) as kept from (select session_id, unnest(['the', 'tion', 'Zzz']) as t from su) join su using (session_id)")
def _(spark, d):
    s = _summary(spark, d)[1].withColumnRenamed("summary", "text")
    terms = s.select("session_id", F.explode(F.array(*[F.lit(t) for t in ("the", "tion", "Zzz")])).alias("term"))
    return conversation.preservation(s, terms)


# ---- memory ------------------------------------------------------------------

NORM = rf"regexp_replace(lower({{c}}), '\s+', ' ', 'g')".replace("lower({c})", "lower(" + sq.strip("{c}") + ")")
WB = memory._whole_words
LOWV = f"(length({NORM.format(c='{c}')}) < 10 or regexp_matches({NORM.format(c='{c}')}, '{WB(rules.LOW_VALUE)}'))"
DERIV = "regexp_matches(lower({c}), '" + "|".join(rules.DERIVABLE) + "')"


def _turn_rows(spark, d):
    return table(spark, d, "conversations")


# short fillers are derived from some turns, so that the gate has something to reject
FILL = "case when turn % 6 = 2 and turn % 4 = 0 then 'ok' when turn % 6 = 2 then 'ok, thanks: ' || text else text end"


def _filled():
    return F.when((F.col("turn") % 6 == 2) & (F.col("turn") % 4 == 0), "ok").when(F.col("turn") % 6 == 2, F.concat(F.lit("ok, thanks: "), F.col("text"))).otherwise(F.col("text"))


@query("n01_low_value", f"select conv_id, turn, {LOWV.format(c='t')} as low_value from (select *, {FILL} as t from conversations)")
def _(spark, d):
    return _turn_rows(spark, d).select("conv_id", "turn", memory.is_low_value(_filled()).alias("low_value"))


@query("n02_derivable", f"select conv_id, turn, {DERIV.format(c='t')} as derivable from (select *, case when turn % 5 = 1 then text || ' git log' else text end as t from conversations)")
def _(spark, d):
    t = F.when(F.col("turn") % 5 == 1, F.concat("text", F.lit(" git log"))).otherwise(F.col("text"))
    return _turn_rows(spark, d).select("conv_id", "turn", memory.is_derivable(t).alias("derivable"))


def _type_sql(c):
    return "case " + " ".join("when " + " or ".join(f"contains({c}, '{w.lower().replace(chr(39), chr(39) * 2)}')" for w in ws) + f" then '{n}'" for n, ws in rules.MEMORY_TYPES) + " else 'project' end"


HINTED = "case turn % 5 when 0 then text || ' I prefer this' when 1 then text || ' instead of that' when 2 then text || ' Check the url' else text end"


def _hinted():
    t = F.col("turn") % 5
    return F.concat("text", tx.first_match([(t == 0, " I prefer this"), (t == 1, " instead of that"), (t == 2, " Check the url")], ""))


@query("n03_memory_type", f"select conv_id, turn, {_type_sql('lower(t)')} as type from (select *, {HINTED} || ' x' as t from conversations)")
def _(spark, d):
    return _turn_rows(spark, d).select("conv_id", "turn", memory.memory_type(_hinted(), F.lit("x")).alias("type"))


SHORT = "case when length({c}) > {n} then left({c}, {m}) || '...' else {c} end"
CLEAN = rf"trim(regexp_replace({sq.strip('{c}')}, '\s+', ' ', 'g'))"
ADVICE = "case type " + " ".join(f"when '{n}' then '{a}'" for n, a in rules.MEMORY_ADVICE.items()) + " end"


def _texts(c):
    cl = CLEAN.format(c=c)
    return f"""{SHORT.format(c=cl, n=60, m=57)} as title, '[' || type || '] ' || {SHORT.format(c=cl, n=100, m=97)} as description,
 {sq.strip(c)} || chr(10) || chr(10) || '**Why:** Extracted from conversation on 2024-01-31' || chr(10) || {ADVICE} as content"""


@query("n04_entry_texts", f"select conv_id, turn, {_texts('text')} from (select *, {_type_sql('lower(t)')} as type from (select *, {HINTED} || ' x' as t from conversations))")
def _(spark, d):
    ty = memory.memory_type(_hinted(), F.lit("x"))
    t = _turn_rows(spark, d).withColumn("type", ty)
    return t.select("conv_id", "turn", *memory.entry_texts(F.col("text"), F.col("type"), "2024-01-31"))


@query("n05_duplicates", f"""with r as (select doc_id, {NORM.format(c='t')} as t, {NORM.format(c='c')} as c from (select doc_id, lang || (doc_id % 3) as t, text as c from documents)),
s as (select doc_id, t, c, list_distinct(list_filter(string_split(c, ''), lambda x: x <> '')) as s from r)
select distinct b.doc_id from s a join s b on a.t = b.t and a.doc_id < b.doc_id and (a.c = b.c or len(list_intersect(a.s, b.s)) / len(list_distinct(list_concat(a.s, b.s))) > 0.8)""")
def _(spark, d):
    title = F.concat("lang", (F.col("doc_id") % 3).cast("string"))
    return memory.duplicates(table(spark, d, "documents").select("doc_id", title.alias("title"), F.col("text").alias("content")), "doc_id")


TURNS = f"""tn as (select u.conv_id, u.turn, u.text as user_message, a.text as assistant_response from conversations u join conversations a on a.conv_id = u.conv_id and a.turn = u.turn + 1
 and u.role = 'user' and a.role = 'assistant')"""


@query("n06_memories_from_turns", f"""with {TURNS}, ty as (select *, {_type_sql("lower(user_message || ' ' || assistant_response)")} as type from tn
 where not {LOWV.format(c='user_message')} and not {DERIV.format(c="user_message || ' ' || assistant_response")})
select conv_id, turn, type, {_texts('user_message')} from ty""")
def _(spark, d):
    m = memory.memories_from_turns(memory.turns(_turn_rows(spark, d), "conv_id", "turn"), "2024-01-31")
    return m.select("conv_id", "turn", "type", "title", "description", "content")


@query("n07_memory_upsert", f"""with a as (select {NORM.format(c="' ' || lang || ' ' || (doc_id % 9)")} as k, ' ' || lang || ' ' || (doc_id % 9) as name, source as description, text as content, doc_id as updated_at from documents)
select k, arg_min(description, updated_at) as description, arg_max(content, updated_at) as content, max(updated_at) as updated_at from a group by 1""")
def _(spark, d):
    m = table(spark, d, "documents").select(
        F.concat(F.lit(" "), "lang", F.lit(" "), (F.col("doc_id") % 9).cast("string")).alias("name"), F.col("source").alias("description"), F.lit("user").alias("type"),
        F.col("text").alias("content"), F.col("doc_id").alias("updated_at"))
    u = memory.upsert_memories(m.where("content < 'M'"), m.where("not content < 'M'"))
    return u.select(tx.cache_key_text(F.col("name")).alias("k"), "description", "content", "updated_at")


@query("n08_index_limits", """with l as (select lang as owner, doc_id, '- [' || split_part(text, chr(10), 1) || '](m' || doc_id || '.md) — ' || text as line from documents),
r as (select *, row_number() over (partition by owner order by doc_id desc) as rank, count(*) over (partition by owner) as n from l),
b as (select *, sum(octet_length(encode(line)) + 1) over (partition by owner order by rank)::bigint as bytes from r where rank <= 200),
k as (select owner, doc_id, rank, line, bytes from b where bytes <= 15000)
select t.owner, doc_id, rank, line, bytes, t.n - count(rank) over (partition by t.owner) as omitted from (select lang as owner, count(*) as n from documents group by 1) t left join k using (owner)""")
def _(spark, d):
    t = table(spark, d, "documents").select(F.col("lang").alias("owner"), "doc_id", tx.first_line(F.col("text")).alias("title"),
                                            F.concat(F.lit("m"), F.col("doc_id").cast("string"), F.lit(".md")).alias("filename"), F.col("text").alias("description"))
    return memory.index_lines(t, "owner", "doc_id", max_bytes=15000)


MW = r"list_distinct(regexp_extract_all(lower({c}), '[\p{{L}}\p{{N}}_]+'))"
RECALL = f"""mw as (select doc_id as chunk_id, {MW.format(c="split_part(text, chr(10), 1) || ' ' || text")} as w from documents), qw0 as (select item_id as query_id, {MW.format(c='text')} as w from benchmark),
rs as (select query_id, chunk_id, round(len(list_intersect(m.w, q.w)) / len(list_distinct(list_concat(m.w, q.w))) * 10.0::double, 9) as score from mw m, qw0 q where len(list_intersect(m.w, q.w)) > 0)"""


def _recall(spark, d, k):
    m = texts(spark, d).select(F.col("doc_id").alias("memory_id"), tx.first_line(F.col("text")).alias("title"), F.col("text").alias("description"))
    return memory.recall(m, fx.queries(spark, d), k)


@query("n09_memory_recall", f"with {RECALL}, {sq.ranked('rs', 5, 'o')} select query_id, chunk_id, round(score, 6) as score, rank from o")
def _(spark, d):
    return _recall(spark, d, 5).withColumn("score", F.round("score", 6))


KINDS = "case turn % 4 when 0 then 'decision' when 1 then 'note' when 2 then 'summary' else 'chat' end"
NOTE_ROWS = f"nt as (select conv_id as session_id, turn as note_id, {KINDS} as kind, (length(text) % 10) / 10.0::double as importance, turn as updated_at, split_part(text, chr(10), 1) as title, text as content from conversations)"


def _notes(spark, d):
    t = F.col("turn") % 4
    return table(spark, d, "conversations").select(
        F.col("conv_id").alias("session_id"), F.col("turn").alias("note_id"), tx.first_match([(t == 0, "decision"), (t == 1, "note"), (t == 2, "summary")], "chat").alias("kind"),
        ((F.length("text") % 10) / 10.0).alias("importance"), F.col("turn").alias("updated_at"), tx.first_line(F.col("text")).alias("title"), F.col("text").alias("content"))


@query("n10_filter_notes", f"""with {NOTE_ROWS} select * from (select session_id, note_id, kind, importance, row_number() over (partition by session_id order by importance desc, updated_at desc, note_id) as rank
 from nt where kind in ('decision', 'note', 'summary') and importance >= 0.2::double) where rank <= 3""")
def _(spark, d):
    return memory.filter_notes(_notes(spark, d), "session_id", ("decision", "note", "summary"), 0.2, 3).select("session_id", "note_id", "kind", "importance", "rank")


def _any(c, ws):
    return "(" + " or ".join(f"contains({c}, '{w}')" for w in ws) + ")"


@query("n11_high_value_note", f"""with {NOTE_ROWS}, x as (select *, {sq.strip('content')} as c, {NORM.format(c="title || ' ' || content")} as b, importance + 0.3::double as imp from nt)
select session_id, note_id, case when {sq.strip('title')} = '' and c = '' then false when note_id % 7 = 6 then true when {_any('b', rules.LOW_VALUE_NOTES)} then false
 when kind in ('decision', 'summary') then imp >= 0.55::double or length(c) >= 24 when imp < 0.65::double then false when {_any('b', rules.HIGH_VALUE_HINTS)} then true
 when length(c) >= 80 and imp >= 0.8::double then true else kind = 'note' end as keep from x""")
def _(spark, d):
    n = _notes(spark, d)
    tags = F.when(F.col("kind") == "note", F.array(F.lit("Key"))).otherwise(F.array(F.lit("z")))
    k = memory.is_high_value_note(F.col("title"), F.col("content"), F.col("kind"), F.col("importance") + 0.3, tags, F.col("note_id") % 7 == 6)
    return n.select("session_id", "note_id", k.alias("keep"))


@query("n12_distinct_notes", f"""select min(doc_id) as doc_id from documents group by {NORM.format(c='lang')}, {NORM.format(c='split_part(text, chr(10), 1)')}, {NORM.format(c='text')}""")
def _(spark, d):
    n = table(spark, d, "documents").select("doc_id", F.upper("lang").alias("kind"), tx.first_line(F.col("text")).alias("title"), F.col("text").alias("content"))
    return memory.distinct_notes(n, "doc_id").select("doc_id")


def _q(w):
    return w.replace("'", "''")


NR = "case " + " ".join("when " + " or ".join(f"contains(low, '{_q(w)}')" for w in ws) + f" then '{n}'" for n, _, ws in rules.NOTE_RULES)
NI = "case " + " ".join("when " + " or ".join(f"contains(low, '{_q(w)}')" for w in ws) + f" then {i}::double" for _, i, ws in rules.NOTE_RULES)
NLONG = "when length(a) >= 220 and (" + " or ".join(f"contains(low, '{w}')" for w in rules.NOTE_SUMMARY_WORDS) + ")"
SH = "case when length({c}) > {n} then rtrim(left({c}, {m}), " + sq.BLANKS + ") || '...' else {c} end"
HINT2 = "case turn % 6 when 0 then ' always prefer' when 2 then ' some issue' when 4 then ' overall' else '' end"


@query("n13_note_from_turn", f"""with {TURNS}, x as (select conv_id, turn, {CLEAN.format(c='user_message')} as q, {CLEAN.format(c=f"(assistant_response || {HINT2})")} as a from tn),
y as (select *, lower(q || ' ' || a) as low from x), k as (select *, {NR} {NLONG} then 'summary' end as kind, {NI} {NLONG} then 0.7::double end as importance from y where a <> '')
select conv_id, turn, kind, importance, kind || ': ' || {SH.format(c="coalesce(nullif(q, ''), a)", n=72, m=69)} as title,
 {SH.format(c="('Question: ' || q || chr(10) || 'Answer: ' || a)", n=1200, m=1197)} as content from k where kind is not null""")
def _(spark, d):
    t = memory.turns(_turn_rows(spark, d), "conv_id", "turn")
    m = F.col("turn") % 6
    t = t.withColumn("assistant_response", F.concat("assistant_response", tx.first_match([(m == 0, " always prefer"), (m == 2, " some issue"), (m == 4, " overall")], "")))
    return memory.note_from_turn(t).select("conv_id", "turn", "kind", "importance", "title", "content")


@query("n14_kind_to_type", f"select conv_id, turn, case (length(text) + turn) % 8 when 1 then 'feedback' when 3 then 'user' when 5 then 'reference' else 'project' end as type from conversations")
def _(spark, d):
    kinds = F.array(*map(F.lit, ("decision", "constraint", "summary", "preference", "blocker", "memory", "note", "chat")))
    kind = F.get(kinds, ((F.length("text") + F.col("turn")) % 8).cast("int"))
    return table(spark, d, "conversations").select("conv_id", "turn", memory.kind_to_type(kind).alias("type"))


@query("n15_note_replay", """with l as (select user_id as note_id, event_id as seq, case event_type when 'error' then 'delete' when 'signup' then 'add' else 'update' end as op,
 case when event_type = 'view' then null else 'v' || value end as title, props as content from events)
select note_id, arg_max(title, seq) filter (title is not null) as title, arg_max(content, seq) as content, max(seq) as version from l group by 1 having arg_max(op, seq) <> 'delete'""".replace("'v' || value", "'v' || event_id"))
def _(spark, d):
    e = F.col("event_type")
    log = table(spark, d, "events").select(
        F.col("user_id").alias("note_id"), F.col("event_id").alias("seq"), F.when(e == "error", "delete").when(e == "signup", "add").otherwise("update").alias("op"),
        F.when(e != "view", F.concat(F.lit("v"), F.col("event_id").cast("string"))).alias("title"), F.col("props").alias("content"), F.col("ts").alias("created_at"))
    return memory.replay_notes(log).select("note_id", "title", "content", "version")


@query("n16_frontmatter", f"""select doc_id, 'N ' || doc_id as name, 'D: ' || lang as description, case doc_id % 3 when 0 then 'user' else 'project' end as type, {sq.strip('text')} as content
from documents where doc_id % 3 < 2 and doc_id % 10 <> 4""")
def _(spark, d):
    i = F.col("doc_id")
    ty = F.when(i % 3 == 0, "User").when(i % 3 == 1, "project").otherwise("other")
    raw = F.concat(F.when(i % 10 == 4, "--").otherwise("---"), F.lit("\nname: N "), i.cast("string"), F.lit("\n description : D: "), F.col("lang"), F.lit("\ntype: "), ty, F.lit("\n---\n\n"), F.col("text"))
    return memory.parse_frontmatter(table(spark, d, "documents").select("doc_id", raw.alias("raw")))


# ---- cache -------------------------------------------------------------------

NOW = 1706659200  # 2024-01-31
CACHE = f"""ca as (select conv_id * 1000 + turn as entry_id, sha1({NORM.format(c='text')}) as query_hash, 'a' || conv_id || '_' || turn as answer, {NOW} - (conv_id * 1000 + turn) * 5 as created_at
 from conversations where role = 'user')"""


def _cache(spark, d):
    t = table(spark, d, "conversations").where("role = 'user'")
    e = F.col("conv_id") * 1000 + F.col("turn")
    return t.select(e.alias("entry_id"), cache.key(F.col("text")).alias("query_hash"),
                    F.concat(F.lit("a"), F.col("conv_id").cast("string"), F.lit("_"), F.col("turn").cast("string")).alias("answer"), (NOW - e * 5).alias("created_at"))


@query("a01_cache_key", f"select conv_id, turn, {NORM.format(c='text')} as text, sha1({NORM.format(c='text')}) as query_hash from conversations")
def _(spark, d):
    return _turn_rows(spark, d).select("conv_id", "turn", tx.cache_key_text(F.col("text")).alias("text"), cache.key(F.col("text")).alias("query_hash"))


def _cache_queries(spark, d):
    return table(spark, d, "conversations").select((F.col("conv_id") * 1000 + F.col("turn")).alias("query_id"), F.concat(F.lit("  "), F.replace("text", F.lit(" "), F.lit(" \n ")), F.lit("\n")).alias("text"))


@query("a02_exact_hits", f"""with {CACHE}, lv as (select * from ca where {NOW} - created_at <= (select max({NOW} - created_at) * 0.75 from ca)), b as (select query_hash, arg_max(entry_id, created_at) as entry_id, arg_max(answer, created_at) as answer from lv group by 1)
select conv_id * 1000 + turn as query_id, entry_id, answer from conversations join b on query_hash = sha1({NORM.format(c='text')})""")
def _(spark, d):
    c = _cache(spark, d)
    oldest = c.agg(F.max(NOW - F.col("created_at"))).first()[0]
    return cache.exact_hits(_cache_queries(spark, d), c, F.lit(NOW), oldest * 0.75)


# questions carry a disturbed copy of the cached vectors
SHIFT = "list_concat([v[1] + (vec_id % 4) * 0.25::double], v[2:])"
VEC = f"""ev as (select vec_id, embedding::double[] as v from embeddings), qv as (select vec_id as query_id, {SHIFT} as v from ev),
cs as (select query_id, vec_id as entry_id, round(list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v))), 9) as s from qv q, ev e where vec_id * 5 <= (select 2.5 * max(vec_id) from ev)),
best as (select query_id, entry_id, s from (select *, row_number() over (partition by query_id order by s desc, entry_id) as rn from cs) where rn = 1 and s >= 0.92)"""


def _shifted():
    e = F.transform("embedding", lambda x: x.cast("double"))
    first = F.get(e, F.lit(0)) + (F.col("vec_id") % 4) * 0.25
    return F.concat(F.array(first), F.slice(e, F.lit(2), F.size(e)))


def _vec_tables(spark, d):
    t = table(spark, d, "embeddings")
    q = t.select(F.col("vec_id").alias("query_id"), _shifted().alias("embedding"))
    c = t.select(F.col("vec_id").alias("entry_id"), F.transform("embedding", lambda x: x.cast("double")).alias("embedding"), (NOW - F.col("vec_id") * 5).alias("created_at"))
    return q, c


def _half(c):
    """An age that half of the entries exceed, so the share of live ones doesn't change with the table."""
    return c.agg(F.expr("2.5 * max(entry_id)")).first()[0]


@query("a03_semantic_hits", f"with {VEC} select query_id, entry_id, round(s, 6) as similarity from best")
def _(spark, d):
    q, c = _vec_tables(spark, d)
    return cache.semantic_hits(q, c, F.lit(NOW), _half(c)).withColumn("similarity", F.round("similarity", 6))


@query("a04_cosine", f"with {VEC} select vec_id, case when vec_id % 9 = 0 then 0.0::double else round(list_inner_product(q.v, e.v) / (sqrt(list_inner_product(q.v, q.v)) * sqrt(list_inner_product(e.v, e.v))), 6) end as cosine from ev e join qv q on query_id = vec_id")
def _(spark, d):
    other = F.when(F.col("vec_id") % 9 == 0, F.slice("embedding", 1, 3)).otherwise(_shifted())
    return table(spark, d, "embeddings").select("vec_id", F.round(dense.cosine(F.col("embedding"), other), 6).alias("cosine"))


@query("a05_evict", "select event_id from events where epoch(timestamp '2024-01-31') - epoch(ts) <= 1728000 order by event_id desc limit 1000")
def _(spark, d):
    e = table(spark, d, "events")
    return cache.evict(e, F.lit("2024-01-31").cast("timestamp"), 1728000, 1000, "ts", "event_id").select("event_id")


@query("a06_cache_stats", f"""with {VEC}, ex as (select vec_id as query_id from ev where vec_id % 3 = 0 and vec_id * 5 <= (select 2.5 * max(vec_id) from ev))
select case when e.query_id is not null then 'exact' when b.query_id is not null then 'semantic' else 'miss' end as cache_type, count(*) as n
from qv left join ex e using (query_id) left join best b using (query_id) group by 1""")
def _(spark, d):
    q, c = _vec_tables(spark, d)
    word = F.concat(F.lit("Q "), F.col("query_id").cast("string"), F.when(F.col("query_id") % 3 == 0, "").otherwise(" changed"))
    q = q.withColumn("text", word)
    c = c.withColumns({"query_hash": cache.key(F.concat(F.lit("q "), F.col("entry_id").cast("string"))), "answer": F.lit("x")})
    return cache.stats(cache.lookup(q, c, F.lit(NOW), _half(c)))
