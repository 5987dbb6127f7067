"""DuckDB SQL for the queries that SQL can express."""

ALPHABET = "'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'"
WORDS = rf"regexp_extract_all(translate(coalesce(text, ''), {ALPHABET}), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

OP3 = rf"""
with d as materialized (select doc_id, {WORDS} as w from documents),
b as materialized (select cast(item_id as varchar) as item, {WORDS} as w from benchmark),
win as (
  select distinct item, w[i:i + least(len(w), 13) - 1] as g
  from (select item, w, unnest(range(1, greatest(len(w) - 12, 1) + 1)) as i from b where len(w) > 0)),
sizes as (select distinct len(g) as k from win),
grams as (select doc_id, k, p, w[p:p + k - 1] as g
  from (select doc_id, w, k, unnest(range(1, len(w) - k + 2)) as p from d cross join sizes where len(w) >= k)),
hits as materialized (select doc_id, p, k, item from grams join win using (g)),
cover as (select doc_id, count(distinct q) as n_hit
  from (select doc_id, unnest(range(p, p + k)) as q from (select distinct doc_id, p, k from hits)) group by doc_id),
found as (select doc_id, count(distinct item) as n_items, string_agg(distinct item, ',' order by item) as items from hits group by doc_id)
select doc_id, cast(len(w) as bigint) as n_words, cast(coalesce(n_hit, 0) as bigint) as n_hit,
  cast(coalesce(n_items, 0) as bigint) as n_items, sha256(coalesce(items, '')) as items_sha256,
  coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(w) as contaminated
from d left join cover using (doc_id) left join found using (doc_id)
"""

MIX = """
n as (select source, count(*) as n from {docs} group by source),
t as (select sum(n) as all_n, sum(pow(n, 0.5)) as all_w from n),
rates as materialized (select source, n, pow(n, 0.5) / all_w * all_n / n as rate from n, t),
steps as (select source, rate, unnest(range(0, cast(ceil(rate + 12 * sqrt(rate) + 25) as bigint) + 1)) as k from rates),
cdf as materialized (select source, k, sum(exp(-rate + k * ln(rate) - lgamma(k + 1))) over (partition by source order by k) as c from steps),
u as (select doc_id, source, cast(concat('0x', substr(md5(concat('mix-1:', cast(doc_id as varchar))), 1, 13)) as bigint) / pow(2.0, 52) as u from {docs}),
copies as (select doc_id, u.source, count(*) as copies from u join cdf on u.source is not distinct from cdf.source and c <= u group by doc_id, u.source),
mixed as (select doc_id, source, copies, unnest(range(1, copies + 1)) as copy from copies)
"""

OP8 = (
    "with "
    + MIX.format(docs="documents")
    + """select doc_id, mixed.source, round(rate, 9) as rate, copies, copy,
  md5(concat('mix-1:order:', cast(doc_id as varchar), ':', cast(copy as varchar))) as shuffle_key
from mixed join rates on mixed.source is not distinct from rates.source"""
)

OP10 = rf"""
with recursive w as materialized (select doc_id, regexp_extract_all(translate(coalesce(text, ''), {ALPHABET}), '[^\x20\x09-\x0D]+') as w from documents),
s as materialized (select doc_id, g from (select doc_id, unnest(list_distinct(list_transform(range(1, greatest(len(w) - 3, 1) + 1), lambda i: w[i:i + 3]))) as g from w where len(w) > 0)),
n as materialized (select doc_id, count(*) as n from s group by doc_id),
pairs as (select a.doc_id as a, b.doc_id as b, count(*) as k from s a join s b on a.g = b.g and a.doc_id < b.doc_id group by all),
link as materialized (select a, b from pairs join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 80 * (x.n + y.n - k)),
edge as materialized (select a, b from link union select b, a from link),
reach as (select a as node, a as seen from (select distinct a from edge) union select reach.node, edge.b from reach join edge on edge.a = reach.seen),
comp as (select node, min(seen) as component_id from reach group by node)
select w.doc_id, cast(coalesce(n, 0) as bigint) as n_shingles, coalesce(component_id, w.doc_id) as component_id, coalesce(component_id, w.doc_id) = w.doc_id as kept
from w left join n on n.doc_id = w.doc_id left join comp on comp.node = w.doc_id
"""

OP9 = """
with d as materialized (select doc_id, hex(encode(coalesce(text, ''))) as h from documents),
w as (select doc_id, p, md5_number(substr(h, 2 * p + 1, 200)) as k from (select doc_id, h, unnest(range(0, length(h) // 2 - 99)) as p from d where length(h) >= 200)),
dup as materialized (select doc_id, p from (select doc_id, p, row_number() over (partition by k order by doc_id, p) as n from w) where n > 1),
mark as (select doc_id, p, case when p > lag(p) over (partition by doc_id order by p) + 100 then 1 else 0 end as fresh from dup),
numbered as (select doc_id, p, sum(fresh) over (partition by doc_id order by p) as g from mark),
span as (select doc_id, g, min(p) as s, max(p) + 100 as e from numbered group by all),
piece as (select span.doc_id, s, e, substr(h, 2 * coalesce(lag(e) over (partition by span.doc_id order by s), 0) + 1, 2 * (s - coalesce(lag(e) over (partition by span.doc_id order by s), 0))) as x from span join d using (doc_id)),
per as (select doc_id, count(*) as n_spans, sum(e - s) as n_removed, max(e) as last, string_agg(x, '' order by s) as x from piece group by doc_id)
select doc_id, length(h) // 2 as n_bytes, cast(coalesce(n_removed, 0) as bigint) as n_removed, coalesce(n_spans, 0) as n_spans,
  sha256(unhex(case when last is null then h else concat(x, substr(h, 2 * last + 1)) end)) as kept_sha256
from d left join per using (doc_id)
"""

OP13 = rf"""
with pieces as (select coalesce(lang, 'und') as lang, unnest(regexp_split_to_array(translate(coalesce(text, ''), {ALPHABET}), '[.,;:!?\x0A-\x0D]')) as piece from documents),
w as materialized (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
n as materialized (select lang, sum(len(w)) as n from w group by lang),
f as materialized (
  select lang, k, array_to_string(w[i:i + k - 1], ' ') as phrase, count(*) as f
  from (select lang, w, k, unnest(range(1, len(w) - k + 2)) as i from w, range(1, 6) t(k) where len(w) >= k)
  group by all having count(*) >= 100),
c as materialized (select lang, k as size, phrase, f, string_split(phrase, ' ') as w from f where k > 1),
inner_phrases as (select lang, array_to_string(w[i:i + k - 1], ' ') as phrase, max(f) as most
  from (select lang, w, f, k, unnest(range(1, size - k + 2)) as i from (select *, unnest(range(2, size)) as k from c)) group by all),
kept as (select c.* from c left join inner_phrases using (lang, phrase) where most is null or 100 * most < 100 * f),
cuts as (select lang, phrase, f as a, k, array_to_string(w[1:k], ' ') as x, array_to_string(w[k + 1:], ' ') as y from (select *, unnest(range(1, size)) as k from kept)),
scored as (select cuts.lang, cuts.phrase, a, cuts.k, p.f as l, q.f as r, n, cast(1000::hugeint * a * n // (p.f::hugeint * q.f) as bigint) as score
  from cuts join f p on p.lang = cuts.lang and p.phrase = x join f q on q.lang = cuts.lang and q.phrase = y join n on n.lang = cuts.lang),
lowest as (select * from scored qualify row_number() over (partition by lang, phrase order by score, k) = 1),
ranked as (select *, row_number() over (partition by lang order by score desc, a desc, encode(phrase)) as rank from lowest)
select lang, rank, phrase, a, l, r, cast(n as bigint) as n, score from ranked where rank <= 2000
"""
