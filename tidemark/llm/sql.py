"""SQL (DuckDB) for those queries of this subpackage that SQL can express."""

from __future__ import annotations

import string

_LOWER = f"translate(coalesce(text, ''), '{string.ascii_uppercase}', '{string.ascii_lowercase}')"
_SPACED = r"[^\x20\x09-\x0D]+"
_ALNUM = r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+"

NEIGHBOURS = """
with e as (
  select vec_id, embedding::double[] as v from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0 and len(list_filter(embedding, lambda x: x <> 0)) > 0)
select q.vec_id as query_id, cast(row_number() over (partition by q.vec_id order by list_distance(q.v, c.v), c.vec_id) as int) as rank, c.vec_id, list_distance(q.v, c.v) as score
from e q join e c on c.vec_id <> q.vec_id where q.vec_id % 100 = 0 qualify rank <= 10
"""

JACCARD = f"""
with recursive d as (select doc_id, regexp_extract_all({_LOWER}, '{_SPACED}') as w from documents),
s as (select doc_id, case when len(w) = 0 then [] when len(w) < 4 then [array_to_string(w, ' ')]
                          else list_distinct(list_transform(range(1, len(w) - 2), lambda i: array_to_string(w[i:i + 3], ' '))) end as g from d),
e as (select doc_id, len(g) as n, unnest(g) as g from s),
p as (select a.doc_id as x, b.doc_id as y, max(a.n) as nx, max(b.n) as ny, count(*) as c from e a join e b on a.g = b.g and a.doc_id < b.doc_id group by 1, 2),
l as (select x, y from p where 100 * c >= 85 * (nx + ny - c)),
k as (select x, y from l union all select y, x from l),
r(doc_id, c) as (select doc_id, doc_id from d union select k.y, r.c from r join k on k.x = r.doc_id where r.c < k.y)
select s.doc_id, len(s.g) as n_shingles, min(r.c) as component_id from s join r on r.doc_id = s.doc_id group by s.doc_id, s.g
"""

SUBSTRING = f"""
with d as (select doc_id, regexp_extract_all(coalesce(text, ''), '{_SPACED}') as w from documents),
win as (select doc_id, i, array_to_string(w[i:i + 49], ' ') as g from (select doc_id, w, unnest(range(1, len(w) - 48)) as i from d)),
f as (select g, min(doc_id) as m from win group by g),
gone as (select distinct doc_id, unnest(range(i, i + 50)) as j from win join f using (g) where m < doc_id),
word as (select doc_id, unnest(w) as x, unnest(range(1, len(w) + 1)) as j from d),
left_over as (select word.doc_id, count(gone.j) as n_removed, string_agg(x, ' ' order by word.j) filter (gone.j is null) as kept from word left join gone on gone.doc_id = word.doc_id and gone.j = word.j group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_removed, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join left_over using (doc_id)
"""

DECONTAMINATION = f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from documents),
t as (select item_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from benchmark),
item as (select item_id, least(len(w), 10) as n, array_to_string(w[i:i + 9], ' ') as g from (select item_id, w, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from t where len(w) > 0)),
size as (select distinct n from item),
win as (select doc_id, n, i, array_to_string(w[i:i + n - 1], ' ') as g from (select doc_id, n, w, unnest(range(1, len(w) - n + 2)) as i from d, size)),
hit as (select doc_id, win.n, i, item_id from win join item on item.g = win.g and item.n = win.n),
word as (select doc_id, count(distinct j) as n_hit from (select doc_id, unnest(range(i, i + n)) as j from hit) group by 1),
who as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as items from (select distinct doc_id, cast(item_id as varchar) as item from hit) group by 1)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items, sha256(coalesce(items, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join word using (doc_id) left join who using (doc_id)
"""


PRODUCTS = """
with e as (
  select vec_id, list_transform(embedding, lambda x: floor(64 * x::double)) as v from embeddings
  where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0)
select q.vec_id as query_id, cast(row_number() over (partition by q.vec_id order by list_inner_product(q.v, c.v) desc, c.vec_id) as int) as rank, c.vec_id, cast(list_inner_product(q.v, c.v) as bigint) as score
from e q join e c on c.vec_id <> q.vec_id where q.vec_id % 20 = 0 qualify rank <= 20
"""

RANKING = f"""
with d as (select doc_id, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from documents),
total as (select count(*) filter (len(w) > 0) as n, cast(sum(len(w)) as bigint) as l from d),
each as (select doc_id, len(w) as size, unnest(w) as term from d),
tf as (select doc_id, size, term, count(*) as tf from each group by all),
df as (select term, count(*) as df from tf group by 1),
item as (select distinct item_id, unnest(regexp_extract_all({_LOWER}, '{_ALNUM}')) as term from benchmark),
weight as (select term, cast(floor(1000 * ln((2 * n + 2)::double / (2 * df + 1)::double)) as bigint) as weight from df, total),
scored as (
  select item_id, doc_id, cast(sum(weight * ((1000000000 * tf) // (1000 * tf + 8 * (10 + (90 * size * n) // l)))) as bigint) as score
  from item join tf using (term) join weight using (term), total group by 1, 2)
select item_id, cast(row_number() over (partition by item_id order by score desc, doc_id) as int) as rank, doc_id, score from scored where score > 0 qualify rank <= 10
"""

#: CRC-32 in SQL: the table of remainders from its rule, then each distinct feature byte by byte.
RESAMPLING = f"""
with bits as (select i, list_reduce(list_prepend(i, range(8)), lambda c, k: case when c & 1 = 1 then xor(c >> 1, 3988292384) else c >> 1 end) as r from range(256) t(i)),
crc as (select list(r order by i) as remainder from bits),
text as (select doc_id, false as wanted, regexp_extract_all({_LOWER}, '{_ALNUM}') as w from documents union all select null, true, regexp_extract_all({_LOWER}, '{_ALNUM}') from benchmark),
feature as (select doc_id, wanted, unnest(w || list_transform(range(1, len(w)), lambda i: w[i] || ' ' || w[i + 1])) as f from text),
bucket as (
  select f, xor(list_reduce(list_prepend(4294967295, list_transform(range(1, 2 * strlen(f), 2), lambda i: ('0x' || hex(f)[i:i + 1])::bigint)),
                            lambda c, b: xor(remainder[(xor(c, b) & 255) + 1], c >> 8)), 4294967295) % 10000 as b
  from (select distinct f from feature), crc),
placed as (select doc_id, wanted, b from feature join bucket using (f)),
counts as (select i as b, count(*) filter (not wanted) as s, count(*) filter (wanted) as t from range(10000) r(i) left join placed on b = i group by 1),
gain as (select b, cast(floor(1000 * ln(((t + 1) * ((sum(s) over ())::bigint + 10000))::double / ((s + 1) * ((sum(t) over ())::bigint + 10000))::double)) as bigint) as gain from counts),
weighed as (select doc_id, cast(floor(sum(gain) / count(*)::double) as bigint) as weight from placed join gain using (b) where not wanted group by 1),
scored as (
  select d.doc_id, len(w) as n_words, cast(len(w) + greatest(len(w) - 1, 0) as bigint) as n_features, coalesce(weight, 0) as weight,
         coalesce(weight, 0) + cast(floor(-1000 * ln(-ln((('0x' || sha256('7:' || d.doc_id)[1:8])::bigint + 0.5) / 4294967296))) as bigint) as score
  from text d left join weighed on weighed.doc_id = d.doc_id where not wanted),
placed_all as (select doc_id, row_number() over (order by score desc, doc_id) as place, 25 * count(*) over () // 100 as drawn from scored where n_words >= 20)
select doc_id, n_features, weight, score, case when place <= drawn then place end as rank from scored left join placed_all using (doc_id)
"""


def oracle_sql() -> dict[str, str]:
    return {"op2_neighbours": NEIGHBOURS, "op6_jaccard": JACCARD, "op7_substring": SUBSTRING, "op10_decontamination": DECONTAMINATION, "op11_products": PRODUCTS, "op12_ranking": RANKING, "op13_resampling": RESAMPLING}
