"""SQL for DuckDB that the queries' results are compared with, where SQL can express them."""

from __future__ import annotations

TOP_K = """
with v as (select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
s as (select q.vec_id as query_id, d.vec_id, list_inner_product(q.v, d.v)::bigint as score from v q join v d on q.vec_id != d.vec_id where q.vec_id % 20 = 0),
r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, rank::int as rank, vec_id, score from r where rank <= 20"""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

SUBSTRINGS = f"""
with w as (select doc_id, {WORDS} as w from documents),
p as (select doc_id, unnest(range(1, len(w) - 48)) as i, w from w where len(w) >= 50),
k as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as k from p),
f as (select k, min(doc_id) as first from k group by k),
g as (select distinct k.doc_id, unnest(range(k.i, k.i + 50)) as i from k join f using (k) where f.first < k.doc_id),
r as (select doc_id, list(i) as gone from g group by doc_id)
select w.doc_id, len(w)::bigint as n_words, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(array_to_string(list_transform(list_filter(range(1, len(w) + 1), lambda i: gone is null or not list_contains(gone, i)), lambda i: w[i]), ' ')) as kept_sha256
from w left join r using (doc_id)"""

LINES = """
with l as (select doc_id, string_split(text, chr(10)) as l, list_transform(string_split(text, chr(10)), lambda x: ('0x' || substr(md5(x), 1, 7))::bigint) as h from documents where text is not null),
c as (select doc_id, l, list_filter(range(1, len(l)), lambda i: ((case when i >= 2 then h[i - 1] else 0 end) * 31 + h[i]) % 4 = 0) as cuts from l),
b as (select doc_id, l, unnest(list_concat([0], cuts)) as s, unnest(list_concat(cuts, [len(l)])) as e from c),
t as (select doc_id, s, e, array_to_string(l[s + 1:e], chr(10)) as chunk from b where e - s >= 2),
o as (select doc_id, s, e, row_number() over (partition by chunk order by doc_id, s) as k from t),
g as (select doc_id, unnest(range(s, e)) as i from o where k > 1),
r as (select doc_id, list(i) as gone from g group by doc_id)
select d.doc_id, coalesce(len(l), 0)::bigint as n_lines, coalesce(len(gone), 0)::bigint as n_removed,
  sha256(coalesce(array_to_string(list_transform(list_filter(range(0, len(l)), lambda i: gone is null or not list_contains(gone, i)), lambda i: l[i + 1]), chr(10)), '')) as kept_sha256
from documents d left join l using (doc_id) left join r using (doc_id)"""

_A, _Z = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
URLS = f"""
with u as (select page_id, case when strpos(url, '://') > 0 then substr(url, strpos(url, '://') + 3) end as rest from pages),
p as (select row_number() over () as n, page_id, translate(coalesce(regexp_extract(rest, '^([^/?#]*)', 1), ''), '{_A}', '{_Z}') as host, coalesce(regexp_extract(rest, '^[^/?#]*([^?#]*)', 1), '') as path from u),
rules(verdict, rule, rh, rp) as (values ('block', 'net/', 'net', '/'), ('allow', 'example.net/en/', 'example.net', '/en/'), ('block', 'example.com/de/', 'example.com', '/de/'), ('allow', 'org/fr/', 'org', '/fr/')),
m as (select n, rule, verdict, row_number() over (partition by n order by length(rule) desc) as k from p join rules on (host = rh or ends_with(host, '.' || rh)) and starts_with(path, rp))
select page_id, host, path, rule, coalesce(verdict, 'allow') as verdict from p left join (select * from m where k = 1) m using (n)"""

MIXTURE = f"""
with s as (select doc_id, source, len({WORDS})::bigint as size from documents),
d as (select *, ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '|' || size), 1, 10))::bigint as h from s),
src as (select source, sum(size)::bigint as source_size from d group by source),
w0 as (select *, ([3, 1, 2])[(row_number() over (order by source nulls last) - 1) % 3 + 1]::double as w, source_size::double * 2 as cap from src),
w1 as (select *, cap / w as c, sum(source_size) over () * 1.5::double as t from w0),
w2 as (select *, sum(cap) over (order by c range between unbounded preceding and current row) as a, sum(cap) over (partition by c) as own, sum(w) over (order by c range between current row and unbounded following) as ww, sum(w) over (partition by c) as own_w from w1),
lv as (select (t - (a - own)) / ww as level from w2 where a + c * (ww - own_w) >= t order by c limit 1),
tg as (select source, source_size, least(w * level, cap) as target from w1 cross join lv),
b as (select *, case when source_size > 0 then floor(target / source_size) else 0 end as whole from tg),
x as (select d.*, b.source_size, b.target, b.whole, b.target - b.whole * b.source_size as budget from d join b on d.source is not distinct from b.source),
x1 as (select *, sum(size) over (partition by source order by h) as cum, sum(size) over (partition by source, h) as own from x where size > 0),
x2 as (select *, cum <= budget or (cum - own <= budget and (budget - (cum - own)) * 2 >= own) as t1, cum > budget and cum - own <= budget as edge from x1),
e as (select source, max(case when edge then h end) as lim, max(case when edge then (case when t1 then 0.0::double else budget - (cum - own) end) end) as remains from x2 group by source),
y as (select x2.*, e.lim, e.remains from x2 join e on x2.source is not distinct from e.source),
f0 as (select *, sum(size) over (partition by source order by h) as cum2, sum(size) over (partition by source, h) as own2 from y where not t1 and remains > 0 and h > lim and size <= remains * 0.25),
f as (select doc_id, source, h, cum2 <= remains or (cum2 - own2 <= remains and (remains - (cum2 - own2)) * 2 >= own2) as t2 from f0),
z as (select y.doc_id, y.source, y.size, least(whole + (case when budget > 0 and (t1 or coalesce(f.t2, false)) then 1 else 0 end), 2) as copies from y left join f on y.doc_id = f.doc_id)
select x.doc_id, x.size, x.source_size, x.target, (x.size * coalesce(z.copies, 0))::bigint as taken from x left join z on x.doc_id = z.doc_id"""


HARD_NEGATIVES = """
with e as (select vec_id, label::bigint as label, list_transform(embedding, lambda x: floor(256 * x::double)) as v from embeddings
  where vec_id is not null and label is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or isnan(x) or isinf(x))) = 0),
r as (select row_number() over (order by vec_id) as n, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label, v from e),
a as (select vec_id, label, v from r where vec_id % 50 = 0 qualify row_number() over (partition by vec_id order by label, v) = 1),
s as (select a.vec_id as anchor_id, n, r.vec_id, a.label = r.label as same, list_inner_product(a.v, r.v)::bigint as score from a join r on a.vec_id != r.vec_id and len(a.v) = len(r.v)),
p as (select anchor_id, vec_id as positive_id, score as positive_score, row_number() over (partition by anchor_id order by score desc, vec_id) as slot from s where same qualify slot <= 5),
h as (select p.*, s.vec_id as negative_id, s.score as negative_score, row_number() over (partition by anchor_id, slot order by s.score desc, s.vec_id) as rank
  from p join s using (anchor_id) where not s.same and 50 * p.positive_score <= 100 * s.score and 100 * s.score <= 95 * p.positive_score qualify rank <= 3)
select anchor_id, positive_id, rank::int as rank, negative_id, positive_score, negative_score from h"""


def oracle_sql() -> dict[str, str]:
    return {"op1_cover_tree": TOP_K, "op5_substring_dedup": SUBSTRINGS, "op6_line_chunks": LINES, "op7_url_filter": URLS, "op8_mixture": MIXTURE, "op12_hard_negatives": HARD_NEGATIVES}
