"""DuckDB SQL of the operators that SQL can express, over the driver's tables."""

from __future__ import annotations

_WORDS = r"regexp_extract_all(t, '[^\x20\x09-\x0D]+')"
_DOCS = f"d as (select row_number() over () as r, doc_id, source, t, {_WORDS} as ws from (select *, coalesce(text, '') as t from documents))"

_RATE = """(select {rule!r} as rule, source, count(*) as n, sum(({fails})::bigint) as k from f where source is not null group by source)"""
_RULES = {"short": "n_words < 10", "repeats": "100 * n_repeat_words > 20 * n_words", "symbols": "10 * n_symbols > word_chars", "lines": "30 * n_dup_lines > n_words"}

HOST_RULES = rf"""
with {_DOCS},
win as (select r, i, array_to_string(ws[i:i + 4], ' ') as s from (select r, ws, unnest(range(1, len(ws) - 3)) as i from d)),
hit as (select r, count(distinct p) as n from (select r, unnest(range(i, i + 5)) as p from (select r, i, count(*) over (partition by r, s) as c from win) where c > 1) group by r),
l as (select r, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\x20\x09-\x0D]')) as ls from d),
f as (select d.doc_id, d.source, len(d.ws)::bigint as n_words, coalesce(list_sum(list_transform(d.ws, lambda x: length(x))), 0)::bigint as word_chars,
  (length(d.t) - length(regexp_replace(d.t, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols, (len(l.ls) - len(list_distinct(l.ls)))::bigint as n_dup_lines, coalesce(hit.n, 0)::bigint as n_repeat_words
  from d join l using (r) left join hit using (r)),
h as ({" union all ".join(_RATE.format(rule=r, fails=x) for r, x in _RULES.items())}),
m as (select rule, sum(k)::double / sum(n) as m, sum(n)::double as total, count(*) as hosts, sum(n::double * n) as n2 from h group by rule),
v as (select rule, m, m * (1 - m) as noise, case when total > n2 / total then (spread - m * (1 - m) * (hosts - 1)) / (total - n2 / total) else 0 end as between_
  from (select m.*, (select sum(h.n * (h.k::double / h.n - m.m) * (h.k::double / h.n - m.m)) from h where h.rule = m.rule) as spread from m)),
s as (select rule, m, case when between_ > 0 then least(greatest(noise / between_ - 1, 1.0), 1e6) when noise > 0 then 1e6 else 1.0 end as s from v),
rate as (select h.source, h.rule, (h.k + s.m * s.s) / (h.n + s.s) as rate from h join s using (rule)),
hosts as (select source, {", ".join(f"max(rate) filter (rule = '{r}') as rate_{r}" for r in _RULES)}, max(rate) > 0.5 as host_rejected from rate group by source)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and not coalesce(host_rejected, false) as kept, {", ".join(f"round(rate_{r}, 6) as rate_{r}" for r in _RULES)}, host_rejected
from f left join hosts using (source)"""

# The kinds of base spans in their order, with pattern and validity of a match s (digits: its digits).
_KINDS = [
    ("email", r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", "true"),
    ("ip", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", "coalesce(list_bool_and(list_transform(string_split(s, '.'), lambda x: coalesce(try_cast(x as hugeint) <= 255, false))), false)"),
    ("card", r"[0-9]([\x20-]?[0-9])+", "length(digits) between 13 and 19 and list_sum(list_transform(range(1, length(digits) + 1), lambda i: (case when (length(digits) - i) % 2 = 0 then digits[i]::int when digits[i]::int > 4 then 2 * digits[i]::int - 9 else 2 * digits[i]::int end))) % 10 = 0"),
    ("phone", r"\+[0-9][\x20().0-9-]+[0-9]", "length(digits) between 9 and 15"),
]


def _located(pattern: str, rows: str) -> str:
    """(r, k, s, start, last) of the matches of a pattern in the texts t of `rows` (r, t)."""
    return rf"""(select r, k, s, gap + sum(gap0 + length(s)) over (partition by r order by k) - gap0 - length(s) as start, gap + sum(gap0 + length(s)) over (partition by r order by k) - gap0 as last from
(select r, k, m[k] as s, length(g[k]) as gap0, length(g[k]) as gap from (select r, m, g, unnest(range(1, len(m) + 1)) as k from (select r, regexp_extract_all(t, '{pattern}') as m, regexp_split_to_array(t, '{pattern}') as g from {rows}))))"""


_FOUND = " union all ".join(f"select r, '{kind}' as kind, {n} as ord, s, start, last from (select *, regexp_replace(s, '[^0-9]', '', 'g') as digits from {_located(p, 'd')}) where {ok}" for n, (kind, p, ok) in enumerate(_KINDS))

PII = rf"""
with d as (select row_number() over () as r, doc_id, coalesce(text, '') as t from documents),
b as ({_FOUND}),
base as (select r, string_agg(kind || ':' || start || ':' || last, ',' order by ord, start) as spans, {", ".join(f"count(*) filter (kind = '{k}') as n_{k}" for k, _, _ in _KINDS)} from b group by r),
u as (select distinct t from d),
e as (select distinct d.t, unnest(['value ' || s, 'group ' || kind || ' ' || case kind when 'email' then lower(regexp_extract(s, '[^@]*$')) when 'ip' then split_part(s, '.', 1) || '.' || split_part(s, '.', 2)
  when 'card' then substr(regexp_replace(s, '[^0-9]', '', 'g'), 1, 6) else substr(regexp_replace(s, '[^0-9]', '', 'g'), 1, 4) end, 'kind ' || kind]) as entity from b join d using (r)),
w as (select t, unnest(list_distinct(regexp_extract_all(lower(t), '\p{{L}}{{2,}}'))) as term from u),
ne as (select entity, count(*) as n_e from e group by 1 having count(*) >= 2),
nt as (select term, count(*) as n_t from w group by 1 having count(*) >= 2),
ew as (select w.t, w.term, n_t from w join nt using (term) where w.t in (select t from e)),
p as (select entity, term, n_e, n_t, count(*) as n_te from e join ne using (entity) join ew using (t) group by all having count(*) >= 2),
sh as (select entity, term, log2(n::double * n_te / (n_t::double * n_e)) / greatest(log2(n::double / n_e), 1e-9) as share from p, (select greatest(count(*), 1) as n from u)),
rv as (select t, term, min(case when share >= 0.95 then 'removed' else 'term' end) as kind from sh join e using (entity) join ew using (t, term) where share >= 0.8 group by all),
hold as (select * from d where t in (select t from rv)),
x as (select l.r, kind, start, last from {_located(r"\p{L}{2,}", "hold")} l join hold using (r) join rv on rv.t = hold.t and rv.term = lower(l.s)),
y as (select r, string_agg(kind || ':' || start || ':' || last, ',' order by kind, start) as spans from x where not exists (select 1 from b where b.r = x.r and b.start < x.last and x.start < b.last) group by r)
select doc_id, {", ".join(f"coalesce(n_{k}, 0)::bigint as n_{k}" for k, _, _ in _KINDS)}, sha256(coalesce(base.spans, '')) as base_sha256, concat_ws(',', base.spans, y.spans) as spans from d left join base using (r) left join y using (r)"""

MIXING = rf"""
with {_DOCS},
x as (select doc_id, source, len(ws)::bigint as size, ('0x' || substr(md5('17|' || coalesce(doc_id::varchar, '') || '|' || md5(t)), 1, 15))::bigint as key from d),
s as (select source, sum(size)::bigint as source_size from x group by source),
w as (select *, 3.0 * source_size as cap, [5.0, 2.0, 1.0][(row_number() over (order by source nulls last) - 1) % 3 + 1] as w from s),
o as (select *, cap / w as ratio, row_number() over (order by cap / w, source nulls last) as rn, (sum(source_size) over () - coalesce(sum(cap) over (order by cap / w, source nulls last rows between unbounded preceding and 1 preceding), 0))::double
  / sum(w) over (order by cap / w, source nulls last rows between current row and unbounded following) as level from w),
t as (select source, source_size, round(least(cap::double, w::double * coalesce((select level from o where ratio >= level order by rn limit 1), 1e300)), 6) as target from o),
b as (select *, case when source_size > 0 then floor(target)::bigint // source_size else 0 end as epochs from t),
u as (select source, key, sum(size) as words, count(*) as n from x group by source, key),
p as (select *, sum(words) over (partition by source order by key) - words as before from u)
select x.doc_id, x.size, b.source_size, b.target, (epochs * x.size + case when before + words <= floor(target)::bigint - epochs * b.source_size then x.size
when before < floor(target)::bigint - epochs * b.source_size then least(x.size, (floor(target)::bigint - epochs * b.source_size - before) // p.n) else 0 end)::bigint as taken
from x join b on x.source is not distinct from b.source join p on p.source is not distinct from x.source and p.key = x.key"""

NEAR_COPIES = rf"""
with recursive {_DOCS},
s as (select distinct r, case when len(ws) < 5 then array_to_string(ws, ' ') else array_to_string(ws[i:i + 4], ' ') end as s from (select r, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from d where len(ws) > 0)),
n as (select r, count(*) as n from s group by r),
c as (select a.r as a, b.r as b, count(*) as c from s a join s b using (s) where a.r <> b.r group by all),
l as (select a, b from c join n x on x.r = a join n y on y.r = b where 9 * c >= 4 * (x.n + y.n) union all select a.r, b.r from d a join d b on len(a.ws) = 0 and len(b.ws) = 0 and a.r <> b.r),
k(r, root) as (select r, r from d union select l.b, k.root from k join l on l.a = k.r),
root as (select r, min(root) as root from k group by r),
first as (select root, min(coalesce(doc_id, 9223372036854775807)) as class_id from root join d using (r) group by root)
select doc_id, class_id::bigint as class_id, coalesce(links, 0)::bigint as n_links from d join root using (r) join first using (root) left join (select a as r, count(*) as links from l group by a) using (r)"""

SQL = {"op4_host_rules": HOST_RULES, "op5_pii": PII, "op6_mixing": MIXING, "op7_near_copies": NEAR_COPIES}
