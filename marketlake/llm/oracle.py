"""SQL for the queries that it can express: query -> DuckDB SQL."""

OP2 = r"""
with flat as (
  select doc_id, regexp_replace(coalesce(text, ''), '[\x20\x09-\x0D]+', ' ', 'g') as t from documents
)
select doc_id, min(doc_id) over w as keep_id, count(*) over w as group_size,
  doc_id is not distinct from min(doc_id) over w as kept, sha256(t) as text_sha256
from flat window w as (partition by t)
"""

OP10 = r"""
with rest as (
  select page_id, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as r from pages
), parts as (
  select page_id, translate(regexp_extract(r, '^[^/?#]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host,
    regexp_extract(r, '^[^/?#]*([^?#]*)', 1) as path
  from rest
), rules(rule, verdict) as (values
  ('com/', 'allow'), ('example.com/en/', 'block'), ('www.example.com/en/', 'allow'), ('net/es/', 'block'), ('net/fr/', 'block')
), fitting as (
  select page_id, max_by(rule, length(rule)) as rule, max_by(verdict, length(rule)) as verdict
  from parts join rules on ends_with('.' || host, '.' || split_part(rule, '/', 1))
    and starts_with(path, substr(rule, instr(rule, '/')))
  group by page_id
)
select p.page_id, p.host, p.path, f.rule, coalesce(f.verdict, case
  when host like '%spam%' or '.' || host like '%.casino%' or '.' || host like '%.xxx'
    or path like '%/wp-login.php%' or path like '%/cart/%' or path like '%.exe'
    or '.' || host like '%.ads_.%' or ('.' || host like '%.tracker%.%' and path like '/pixel%')
  then 'block' else 'allow' end) as verdict
from parts p left join fitting f using (page_id)
"""

#: Terms are cut from lower-cased text; only A-Z change.
OP11 = r"""
with words as (
  select row_number() over () as r, doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents
), totals as (
  select cast(count(*) as bigint) as nd, cast(sum(len(ws)) as bigint) as l from words where len(ws) > 0
), postings as (
  select r, t, cast(count(*) as bigint) as tf from (select r, unnest(ws) as t from words) group by r, t
), weights as (
  select t, cast(floor(1000 * ln(cast(2 * nd + 2 as double) / cast(2 * count(*) + 1 as double))) as bigint) as w
  from postings, totals group by t, nd
), docs as (
  select r, doc_id, 100 - 90 + ((90 * len(ws) * nd) // l) as m from words, totals where len(ws) > 0
), asked as (
  select row_number() over () as q, item_id, list_distinct(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
    'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+')) as ts from benchmark
), scores as (
  select q, any_value(item_id) as item_id, r, any_value(doc_id) as doc_id,
    cast(sum(w * ((1000000000 * tf) // (1000 * tf + 8 * m))) as bigint) as score
  from (select q, item_id, unnest(ts) as t from asked) join weights using (t) join postings using (t) join docs using (r)
  group by q, r having score > 0
)
select item_id, cast(rank as integer) as rank, doc_id, score from (
  select *, row_number() over (partition by q order by score desc, doc_id nulls last, r) as rank from scores
) where rank <= 10
"""

OP12 = """
with rows as (
  select row_number() over () as u, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
    [cast(floor(256 * cast(x as double)) as double) for x in embedding] as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and len([x for x in embedding if x is null or not isfinite(x)]) = 0
), pairs as (
  select a.u as au, a.vec_id as anchor_id, b.u as bu, b.vec_id as other_id, a.label = b.label as same,
    cast(list_inner_product(a.v, b.v) as bigint) as score
  from rows a join rows b on a.u <> b.u where a.vec_id % 100 = 0
), positives as (
  select * from pairs where same qualify row_number() over (partition by au order by score desc, other_id, bu) <= 5
)
select p.anchor_id, p.other_id as positive_id,
  cast(row_number() over (partition by p.au, p.bu order by n.score desc, n.other_id, n.bu) as integer) as rank,
  n.other_id as negative_id, p.score as positive_score, n.score as negative_score
from positives p join pairs n on p.au = n.au and not n.same and 30 * p.score <= 100 * n.score and 100 * n.score <= 90 * p.score
qualify rank <= 10
"""

ORACLE = {"op2_exact_dedup": OP2, "op10_url_filter": OP10, "op11_ranked_search": OP11, "op12_hard_negatives": OP12}
