"""DuckDB SQL of the queries that SQL can express."""

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

LEVEL_WISE_DOUBLING = rf"""
with d as (select doc_id, {WORDS} as ws from documents),
w as (
  select doc_id, i, array_to_string(ws[i:i + 12], ' ') as win
  from (select doc_id, ws, unnest(range(1, len(ws) - 11)) as i from d where len(ws) >= 13)),
f as (select win, min(doc_id) as low from w group by win having count(distinct doc_id) > 1),
c as (
  select distinct doc_id, i + k as j
  from (select w.doc_id, w.i from w join f using (win) where f.low < w.doc_id),
       (select unnest(range(13)) as k)),
k as (
  select e.doc_id, count(c.j) as n_removed,
         string_agg(case when c.j is null then e.w end, ' ' order by e.j) as kept
  from (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as j from d) e
  left join c on c.doc_id = e.doc_id and c.j = e.j
  group by e.doc_id)
select d.doc_id, len(d.ws)::bigint as n_words, coalesce(k.n_removed, 0)::bigint as n_removed,
       sha256(coalesce(k.kept, '')) as kept_sha256
from d left join k using (doc_id)
"""

CHOSEN_PATH = rf"""
with recursive d as (select doc_id, {WORDS} as ws from documents),
s as (
  select distinct doc_id, array_to_string(ws[i:i + 4], ' ') as g
  from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 2))) as i from d where len(ws) > 0)),
n as (select doc_id, count(*) as n from s group by doc_id),
p as (
  select a.doc_id as x, b.doc_id as y, count(*) as c
  from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by 1, 2),
e as (
  select p.x, p.y from p join n a on a.doc_id = p.x join n b on b.doc_id = p.y
  where p.c >= 0.8 * (a.n + b.n - p.c) - 1e-9),
r as (select doc_id as x, doc_id as y from d union select r.x, e.y from r join e on e.x = r.y),
m as (select x as doc_id, min(y) as component_id from r group by x),
l as (select x as doc_id, count(*) as n_links from e group by x)
select m.doc_id, m.component_id, coalesce(l.n_links, 0)::bigint as n_links,
       m.doc_id = m.component_id as kept
from m left join l using (doc_id)
"""

VANTAGE_POINTS = """
with v as (select vec_id, cast(embedding as double[]) as e from embeddings),
n as (
  select vec_id, e from v
  where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0),
p as (
  select a.vec_id as query_id, b.vec_id, list_inner_product(a.e, b.e) as score
  from n a, n b where a.vec_id % 20 = 0 and a.vec_id <> b.vec_id),
r as (
  select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from p)
select query_id, rank::integer as rank, vec_id, score from r where rank <= 20
"""

MULTI_INDEX = """
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings),
n as (
  select vec_id, e, sqrt(list_inner_product(e, e)) as size from v
  where e is not null and len(list_filter(e, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(e, lambda x: x <> 0)) > 0),
l as (
  select a.vec_id as x, b.vec_id as y from n a, n b
  where a.vec_id <> b.vec_id and list_inner_product(a.e, b.e) / (a.size * b.size) >= 0.9),
r as (select vec_id as x, vec_id as y from v union select r.x, l.y from r join l on l.x = r.y),
c as (select x as vec_id, min(y) as component_id from r group by x),
k as (select x as vec_id, count(*) as n_links from l group by x)
select c.vec_id, coalesce(k.n_links, 0)::bigint as n_links, c.component_id,
       c.vec_id = c.component_id as kept
from c left join k using (vec_id)
"""

#: CRC-32 of the decimal number of conv_id, bit by bit.
CRC = """
xor(list_reduce(
  list_transform(string_split(conv_id::varchar, ''), lambda x: ascii(x)::bigint),
  lambda crc, byte: list_reduce(range(8), lambda v, i: case when v % 2 = 1
                    then xor(v >> 1, 3988292384) else v >> 1 end, xor(crc, byte)),
  4294967295::bigint), 4294967295::bigint)"""

DOUBLE_ARRAY_TRIE = f"""
with t as (
  select conv_id, turn, coalesce(role, '') as role, coalesce(text, '') as text
  from conversations where conv_id is not null),
o as (
  select conv_id, list({{'role': role, 'text': text}} order by turn nulls first,
    md5(concat(length(role), ':', role, text))) as turns
  from t group by conv_id),
h as (select conv_id, turns, {CRC} % 9 as h from o),
r as (
  select h.conv_id, list_concat(coalesce(b.turns[1:h.h], []), h.turns[h.h + 1:]) as turns
  from h left join o b on b.conv_id = h.conv_id - h.conv_id % 5),
p as (
  select conv_id, d as depth, turns[1:d] as prefix, len(turns) as size
  from (select conv_id, turns, unnest(range(len(turns) + 1)) as d from r)),
n as (
  select depth, prefix, min(conv_id) as conv_id, count(*) as n_convs,
         string_agg(case when size = depth then conv_id end, ',' order by conv_id) as ends,
         case when depth = 0 then 0 else octet_length(encode(prefix[depth].text)) end as bytes
  from p group by depth, prefix),
c as (
  select a.depth, a.prefix, count(*) as n_children from n a
  join n b on b.depth = a.depth + 1 and b.prefix[1:a.depth] = a.prefix group by 1, 2),
s as (
  select a.depth, a.prefix, sum((b.n_convs - 1) * b.bytes) as saved,
         count(*) filter (where c.n_children is null) as leaves
  from n a join n b on b.depth >= a.depth and b.prefix[1:a.depth] = a.prefix
  left join c on c.depth = b.depth and c.prefix = b.prefix group by 1, 2)
select n.conv_id, n.depth::bigint as depth, u.conv_id as parent_conv_id, n.n_convs,
       coalesce(c.n_children, 0)::bigint as n_children, s.leaves::bigint as n_leaves,
       s.saved::bigint as saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from n join s on s.depth = n.depth and s.prefix = n.prefix
left join c on c.depth = n.depth and c.prefix = n.prefix
left join n u on u.depth = n.depth - 1 and u.prefix = n.prefix[1:u.depth]
"""

LEHMER_RANK_AUDIT = rf"""
with recursive d as (
  select doc_id, coalesce(source, '') as part, coalesce(text, '') as t, {WORDS} as ws from documents),
g as (select doc_id, bool_or(quality = 1) as good, bool_or(toxic = 1) as toxic from labels group by doc_id),
f as (
  select d.part, coalesce(g.good, false) as good, coalesce(g.toxic, false) as toxic,
    concat(case when len(ws) < 50 then 'A' else '' end,
      case when 100 * len(list_distinct(ws)) < 65 * len(ws) then 'B' else '' end,
      case when 100 * len(regexp_extract_all(t, '[A-Z]')) > 5 * length(t) then 'C' else '' end,
      case when regexp_matches(t, '[#$%&*|]') then 'D' else '' end,
      case when d.doc_id > min(d.doc_id) over (partition by t) then 'E' else '' end) as mask
  from d left join g on g.doc_id = d.doc_id),
m as (
  select part, mask, count(*) as n, count(*) filter (where good) as good,
         count(*) filter (where toxic) as toxic from f group by 1, 2),
o as (
  select '' as filter_order union all
  select o.filter_order || x.x from o, (select unnest(['A', 'B', 'C', 'D', 'E']) as x) x
  where not contains(o.filter_order, x.x)),
s as (
  select part, filter_order, step, filter_order[step] as f
  from (select distinct part from m), o, (select unnest(range(1, 6)) as step)
  where length(filter_order) = 5),
r as (
  select s.part, s.filter_order, s.step, s.f,
    sum(case when not regexp_matches(m.mask, '[x' || s.filter_order[1:s.step] || ']') then n else 0 end) as kept,
    sum(case when contains(m.mask, s.f) and (s.step = 1 or not regexp_matches(m.mask, '[x' || s.filter_order[1:s.step - 1] || ']')) then n else 0 end) as removed,
    sum(case when contains(m.mask, s.f) then n else 0 end) as fails,
    sum(case when m.mask = s.f then n else 0 end) as unique_fails,
    sum(case when contains(m.mask, s.f) and (s.step = 1 or not regexp_matches(m.mask, '[x' || s.filter_order[1:s.step - 1] || ']')) then good else 0 end) as good_lost,
    sum(case when contains(m.mask, s.f) and (s.step = 1 or not regexp_matches(m.mask, '[x' || s.filter_order[1:s.step - 1] || ']')) then toxic else 0 end) as toxic_lost
  from s join m on m.part = s.part group by 1, 2, 3, 4)
select part, filter_order, step::integer as step, kept::bigint as kept, removed::bigint as removed,
       (fails - removed)::bigint as redundant, unique_fails::bigint as unique_fails,
       good_lost::bigint as good_lost, toxic_lost::bigint as toxic_lost,
       (sum(removed) over (partition by part, f))::bigint as shapley
from r
"""

ORACLES = {"op3_level_wise_doubling": LEVEL_WISE_DOUBLING, "op4_chosen_path_join": CHOSEN_PATH,
           "op6_vantage_point_search": VANTAGE_POINTS,
           "op7_inverted_multi_index": MULTI_INDEX,
           "op12_double_array_trie": DOUBLE_ARRAY_TRIE, "op13_lehmer_rank_audit": LEHMER_RANK_AUDIT}
