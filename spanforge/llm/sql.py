"""DuckDB statements that give the same rows as the queries of ``queries.py``."""

OP2 = r"""
with rows as (select distinct conv_id, turn, coalesce(role, 'unknown') speaker, coalesce(text, '') text from conversations),
numbered as (select *, row_number() over (partition by conv_id order by turn nulls first, md5(speaker || chr(31) || text), speaker, text) - 1 as pos from rows),
people as (select distinct conv_id, speaker as perspective from rows where speaker <> 'system'),
views as (
  select n.conv_id, p.perspective, n.pos // 64 as piece, n.pos, n.speaker = p.perspective as own, n.text,
    case when n.speaker = p.perspective then '<|assistant|>' || chr(10) when n.speaker = 'system' then '<|system|>' || chr(10) else '<|user name=' || n.speaker || '|>' || chr(10) end as head
  from numbered n join people p on n.conv_id is not distinct from p.conv_id),
parts as (select *, head || text || chr(10) || '<|end|>' || chr(10) as part from views),
placed as (
  select *, coalesce(sum(length(part)) over (partition by conv_id, perspective order by pos rows between unbounded preceding and 1 preceding), 0)::bigint as place from parts)
select conv_id, perspective, piece, min(place) as start, count(*) as n_turns, string_agg(part, '' order by pos) as text,
  coalesce(string_agg(case when own and length(text) > 0 then (place + length(head)) || '-' || (place + length(head) + length(text)) end, ',' order by pos), '') as mask
from placed group by conv_id, perspective, piece
"""

OP5 = r"""
with d as (select row_number() over () as r, doc_id, source, text from documents),
l as (select r, source, text, generate_subscripts(string_split(text, chr(10)), 1) as i, unnest(string_split(text, chr(10))) as line from d),
b as (select *, trim(line, ' ' || chr(9) || chr(13)) as bare from l),
c as (select source, bare, count(distinct text) as n from b where bare <> '' group by all),
h as (select source, count(distinct text) as pages from d group by 1),
bad as (select c.source, c.bare from c join h on c.source is not distinct from h.source where n >= 5 and n > 0.01 * pages),
m as (select b.*, bad.bare is not null as drop_it from b left join bad on b.source is not distinct from bad.source and b.bare = bad.bare),
s as (select r, count(*) filter (bare <> '') as n_lines, count(*) filter (drop_it) as n_bad, coalesce(string_agg(line, chr(10) order by i) filter (not drop_it), '') as kept from m group by r)
select d.doc_id, d.source, case when d.text is null then null else s.kept end as text, coalesce(s.n_lines, 0)::bigint as n_lines, coalesce(s.n_bad, 0)::bigint as n_dropped
from d left join s on d.r = s.r
"""

OP7 = r"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
k as (select doc_id, case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
  else list_distinct(list_transform(range(1, len(w) - 3), lambda i: array_to_string(w[i:i+4], ' '))) end as s from d),
n as (select doc_id, len(s) as n from k),
e as (select doc_id, unnest(s) as g from k),
f as (select g from e group by g having count(*) > 1),
p as (select x.doc_id as a, y.doc_id as b, count(*) as c from e x join e y on x.g = y.g and x.doc_id < y.doc_id where x.g in (select g from f) group by all),
l as (select a, b from p join n na on na.doc_id = a join n nb on nb.doc_id = b where 100 * c >= 85 * (na.n + nb.n - c)),
u as (select a, b from l union all select b, a from l),
r(doc_id, root) as (select doc_id, doc_id from n union select u.b, r.root from r join u on u.a = r.doc_id where r.root < u.b)
select n.doc_id, n.n::bigint as n_shingles, min(r.root) as component_id, n.doc_id = min(r.root) as kept from n join r on r.doc_id = n.doc_id group by n.doc_id, n.n
"""

OP10 = r"""
with b as (select item_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from benchmark where item_id is not null),
i as (select distinct item_id, least(len(w), 5) as width, unnest(case when len(w) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')] else list_distinct(list_transform(range(1, len(w) - 3), lambda k: array_to_string(w[k:k+4], ' '))) end) as g from b),
t as (select item_id, count(*) as n_item from i group by 1),
d as (select doc_id, list_filter(string_split_regex(lower(text), '[\x20\x09-\x0D]+'), lambda x: x <> '') as w from documents),
u as (select distinct width from i),
s as (select doc_id, width, unnest(case when len(w) < width then [] else list_distinct(list_transform(range(1, len(w) - width + 2), lambda k: array_to_string(w[k:k+width-1], ' '))) end) as g from d join u on true),
c as (select s.doc_id, i.item_id, count(*) as n_shared from s join i on s.g = i.g and s.width = i.width group by all)
select doc_id, item_id, n_shared, n_item, n_shared / n_item as containment from c join t using (item_id) where 100 * n_shared >= 80 * n_item
"""

OP8 = r"""
with d as (select row_number() over () as r, doc_id, lang, source, coalesce(text, '') as t from documents),
w as (select *, list_filter(string_split_regex(t, '[\x20\x09-\x0D]+'), lambda x: x <> '') as ws from d),
u as (select r, unnest(ws) as word, generate_subscripts(ws, 1) as pos from w),
g as (select r, pos, case when lead(word, 4) over o is not null then concat_ws(' ', word, lead(word, 1) over o, lead(word, 2) over o, lead(word, 3) over o, lead(word, 4) over o) end as gram from u window o as (partition by r order by pos)),
c as (select r, gram from g where gram is not null group by all having count(*) > 1),
f as (select g.r, max(case when c.gram is not null then 1 else 0 end) over (partition by g.r order by g.pos rows between 4 preceding and current row) as hit from g left join c on c.r = g.r and c.gram = g.gram),
rp as (select r, sum(hit)::bigint as n_repeat_words from f group by 1),
ln as (select r, unnest(string_split(t, chr(10))) as line from d),
dl as (select r, count(*) - count(distinct line) as n_dup_lines from ln where regexp_matches(line, '[^\x20\x09-\x0D]') group by 1),
m as (select w.r, doc_id, lang, source, len(ws)::bigint as n_words, length(array_to_string(ws, ''))::bigint as word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint as n_symbols,
  coalesce(n_dup_lines, 0) as n_dup_lines, coalesce(n_repeat_words, 0) as n_repeat_words, length(regexp_replace(t, '[^A-Z]', '', 'g'))::bigint as n_capitals from w left join rp using (r) left join dl using (r)),
x as (select r, lang, source, unnest([{'i': 1, 'rate': 'symbol_rate', 'v': 1000 * n_symbols // greatest(word_chars, 1)}, {'i': 2, 'rate': 'dup_line_rate', 'v': 1000 * n_dup_lines // greatest(n_words, 1)}, {'i': 3, 'rate': 'repeat_rate', 'v': 1000 * n_repeat_words // greatest(n_words, 1)},
  {'i': 4, 'rate': 'capital_rate', 'v': 1000 * n_capitals // greatest(word_chars, 1)}, {'i': 5, 'rate': 'word_length', 'v': 100 * word_chars // greatest(n_words, 1)}]) as e from m),
s as (select lang, source, e.rate as rate, greatest(length(bin(e.v)) - 6, 0) * 64 + (e.v >> greatest(length(bin(e.v)) - 6, 0)) as bucket, count(*) as n from x group by all),
al as (select rate, bucket, 200000 * sum(n)::bigint // (sum(sum(n)) over (partition by rate))::bigint as w from s group by rate, bucket),
la as (select lang, rate, bucket, 200000 * sum(n)::bigint // (sum(sum(n)) over (partition by lang, rate))::bigint as w from s group by lang, rate, bucket),
mx as (select p.lang, p.source, p.rate, al.bucket, ((al.bucket % 64 + 1) << (al.bucket // 64)::int) - 1 as top, 1000 * coalesce(s.n, 0) + coalesce(la.w, 0) + al.w as w
  from (select distinct lang, source, rate from s) p join al on al.rate = p.rate
  left join la on la.lang is not distinct from p.lang and la.rate = p.rate and la.bucket = al.bucket
  left join s on s.lang is not distinct from p.lang and s.source is not distinct from p.source and s.rate = p.rate and s.bucket = al.bucket),
cu as (select *, (sum(w) over (partition by lang, source, rate order by bucket))::bigint as upto, (sum(w) over (partition by lang, source, rate))::bigint as total, case when top = 0 then 0 else length(bin(top)) end as oc from mx),
qu as (select lang, source, rate, max(total) as total, min(top) filter (4 * upto >= 3 * total) as q75, min(top) filter (1000 * upto >= 999 * total) as q999 from cu group by all),
oc as (select cu.lang, cu.source, cu.rate, k, min(cu.total) as total, coalesce(sum(w) filter (oc in (k, k + 1)), 0) as low, coalesce(sum(w) filter (oc > k + 1), 0)::bigint as far
  from cu join (select unnest(range(1, 11)) as k) on true where cu.rate in ('symbol_rate', 'capital_rate') group by all),
va as (select o.lang, o.source, o.rate, arg_min(far, k) as far from oc o join qu on qu.lang is not distinct from o.lang and qu.source is not distinct from o.source and qu.rate = o.rate
  where k > case when q75 = 0 then 0 else length(bin(q75)) end and 1000 * low < o.total and 200 * far >= o.total group by all),
cl as (select cu.lang, cu.source, cu.rate, min(top) as mid from cu join va on va.lang is not distinct from cu.lang and va.source is not distinct from cu.source and va.rate = cu.rate where 2 * upto >= 2 * total - far group by all),
fs as (select qu.lang, qu.source, qu.rate, case when cl.mid is not null then floor(sqrt((q75 + 1) * (cl.mid + 1)))::bigint else q999 end as fence
  from qu left join cl on cl.lang is not distinct from qu.lang and cl.source is not distinct from qu.source and cl.rate = qu.rate),
ev as (select m.r, lang, source, unnest([{'i': 1, 'rate': 'symbol_rate', 'c': n_symbols, 'n': word_chars, 'u': 1000}, {'i': 2, 'rate': 'dup_line_rate', 'c': n_dup_lines, 'n': n_words, 'u': 1000},
  {'i': 3, 'rate': 'repeat_rate', 'c': n_repeat_words, 'n': n_words, 'u': 1000}, {'i': 4, 'rate': 'capital_rate', 'c': n_capitals, 'n': word_chars, 'u': 1000}, {'i': 5, 'rate': 'word_length', 'c': word_chars, 'n': n_words, 'u': 100}]) as e from m),
fl as (select r, coalesce(string_agg(e.rate, ',' order by e.i) filter (e.c - 2 * sqrt(e.c) > fs.fence * e.n / e.u), '') as failed_rates, string_agg(fs.fence, ',' order by e.i) as fences
  from ev join fs on fs.lang is not distinct from ev.lang and fs.source is not distinct from ev.source and fs.rate = ev.e.rate group by 1)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words as base_failed, failed_rates, fences,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and failed_rates = '' as kept from m join fl using (r)
"""

ORACLES: dict[str, str] = {
    "op2_perspective_rotation": OP2,
    "op5_line_dedup": OP5,
    "op7_signature_coordinate_join": OP7,
    "op8_adaptive_thresholds": OP8,
    "op10_minhash_containment": OP10,
}
