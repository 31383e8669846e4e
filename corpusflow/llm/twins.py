"""DuckDB twins of the operators that SQL can express."""

# CRC-32 of a text by its table of 256 values: ``crc_table`` goes into the WITH clause, ``crc`` is the expression.
CRC_TABLE = """crc_table as (select list(v order by i) as t from (select i, list_reduce(list_concat([i::bigint], range(8)),
 lambda c, k: case when c % 2 = 1 then xor(c // 2, 3988292384) else c // 2 end) as v from range(256) r(i)))"""


def crc(c: str) -> str:
    """Unsigned CRC-32 of an ASCII text; ``crc_table`` has to be among the joined tables."""
    return (f"xor(list_reduce(list_concat([4294967295], list_transform(string_split({c}, ''), lambda x: ord(x)::bigint)), "
            "lambda a, b: xor(a // 256, t[xor(a, b) % 256 + 1])), 4294967295)")


WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

# Runs: places whose next six words occur again p words later, joined on those six words (no run has fewer equal places), give
# stretches of equal words; of stretches with the same place the smallest distance is the period.
PERIODS = f"""with {CRC_TABLE},
d as (select row_number() over () as k, doc_id, w, len(w) as n, case when doc_id is not null then {crc('doc_id::varchar')} end as h from (select doc_id, {WORDS} as w from documents), crc_table),
x as (select *, (h // 10) % n as a, 1 + (n - (h // 10) % n) // (3 + (h // 10) % 8) as p from d where n > 0),
v as (select k, i, case when h % 10 = 0 and i >= a then w[a + (i - a) % p + 1] else w[i + 1] end as word from (select *, unnest(range(n)) as i from x)),
g as (select k, i, word, concat_ws(' ', word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o, lead(word, 5) over o) as six,
 lead(word, 5) over o is not null as whole from v window o as (partition by k order by i)),
m as (select x.k, x.i, y.i - x.i as q from g x join g y on x.k = y.k and x.six = y.six and x.i < y.i where x.whole and y.whole),
s as (select k, q, min(i) as a, count(*) + 5 as same from (select *, i - row_number() over (partition by k, q order by i) as island from m) group by k, q, island),
u as (select k, start, length, period from (select k, a as start, same + q as length, q as period, row_number() over (partition by k, a, same + q order by q) as place from s where same >= q and same + q >= 12) where place = 1),
best as (select k, count(*) as n_runs, arg_min(struct_pack(s := start, l := length, p := period), (-length, start, period)) as b,
 string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as lines from u group by k),
cut as (select distinct k, unnest(range(start + period, start + length)) as i from u),
kept as (select k, string_agg(word, ' ' order by i) as text from v anti join cut using (k, i) group by k)
select doc_id, coalesce(n_runs, 0) as n_runs, b.s as start, b.l as length, b.p as period, 1000 * b.l // b.p as exponent_milli,
 sha256(coalesce(lines, '')) as runs_sha256, sha256(coalesce(kept.text, '')) as collapsed_sha256, n as n_words
from d left join best using (k) left join kept using (k)"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


def _leaf(n_chars: str) -> str:
    return f"sha256({' || '.join(_field(c) for c in ('doc_id', 'source', 'lang', n_chars, 'text'))})"


def _climb(name: str, first: str) -> str:
    """All nodes of the trees in ``first`` (tree, pos, n, h), level by level."""
    return f"""{name} as (select 0 as lvl, tree, pos, n, h from {first}
 union all select lvl + 1, tree, pos // 2, (n + 1) // 2, sha256(string_agg(h, '' order by pos)) from {name} where n > 1 group by lvl, tree, pos // 2, n)"""


def _fold(name: str, first: str, nodes: str) -> str:
    """The way up of every row of ``first`` (k, tree, pos, n, h, proof)."""
    return f"""{name} as (select 0 as lvl, * from {first}
 union all select f.lvl + 1, f.k, f.tree, f.pos // 2, (f.n + 1) // 2, sha256(case when f.pos % 2 = 1 then s.h || f.h else f.h || coalesce(s.h, '') end), f.proof || coalesce(s.h, '')
 from {name} f left join {nodes} s on s.lvl = f.lvl and s.tree is not distinct from f.tree and s.pos = xor(f.pos, 1) where f.n > 1)"""


MANIFEST = f"""with recursive {CRC_TABLE},
d as (select row_number() over () as k, doc_id, lang, {_leaf('n_chars')} as leaf,
 case when {crc('doc_id::varchar')} % 7 = 0 then {_leaf('(n_chars::hugeint + 1)')} else {_leaf('n_chars')} end as seen from documents, crc_table),
p as (select *, row_number() over (partition by lang order by doc_id nulls first, leaf) - 1 as pos, count(*) over (partition by lang) as n from d),
l0 as (select lang as tree, pos, n, leaf as h from p), {_climb('nodes', 'l0')},
tops as (select tree as lang, h as subroot, row_number() over (order by tree nulls first) - 1 as pos, count(*) over () as n from nodes where n = 1),
t0 as (select 0 as tree, pos, n, subroot as h from tops), {_climb('above', 't0')},
f0 as (select k, lang as tree, pos, n, seen as h, '' as proof from p), {_fold('low', 'f0', 'nodes')},
g0 as (select k, 0 as tree, tops.pos, tops.n, h, proof from low join tops on tops.lang is not distinct from low.tree where low.n = 1), {_fold('high', 'g0', 'above')}
select doc_id, leaf, subroot, root, sha256(proof) as proof_sha256, h as folded_root, h = root as verified
from p join (select k, h, proof from high where n = 1) using (k) join tops on tops.lang is not distinct from p.lang, (select h as root from above where n = 1)"""

# Windows as texts; a word goes if a window over it stands in a document with a smaller id.
PASSAGES = f"""with d as (select row_number() over () as k, doc_id, {WORDS} as w from documents),
v as (select k, doc_id, i, w[i + 1] as word, case when i + 13 <= len(w) then array_to_string(w[i + 1:i + 13], ' ') end as win from (select *, unnest(range(len(w))) as i from d)),
f as (select win, min(doc_id) as low from v where win is not null group by win),
g as (select distinct k, unnest(range(i, i + 13)) as i from v join f using (win) where low < doc_id),
kept as (select k, count(*) as n, string_agg(word, ' ' order by i) as text from v anti join g using (k, i) group by k)
select doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept.text, '')) as kept_sha256 from d left join kept using (k)"""
