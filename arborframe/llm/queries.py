"""The operators' queries over the driver's tables, and their SQL where SQL can express them."""

from __future__ import annotations

from arborframe.llm import decontaminate, language, lines, mixing, secret_scan, simhash, suffix_tree, templates, topk, toxicity

QUERIES = {
    "op1_norm_bucket_topk": topk.op1,
    "op2_template_removal": templates.op2,
    "op3_suffix_tree_lm": suffix_tree.op3,
    "op4_source_mix": mixing.op4,
    "op5_line_dedup": lines.op5,
    "op6_benchmark_decontamination": decontaminate.op6,
    "op7_simhash_pigeonring": simhash.op7,
    "op8_secret_ledger": secret_scan.op8,
    "op9_bigru_language": language.op9,
    "op10_toxicity_ftrl": toxicity.op10,
}

_LOW = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

SQL = {
    "op1_norm_bucket_topk": r"""
with v as (select vec_id, list_transform(embedding, lambda x: floor(256 * x::double)) as q from embeddings
           where vec_id is not null and embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
s as (select a.vec_id as query_id, b.vec_id, list_inner_product(a.q, b.q)::bigint as score
      from v a join v b on a.vec_id <> b.vec_id where a.vec_id % 50 = 0)
select query_id, rank, vec_id, score
from (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from s) where rank <= 5
""",
    "op4_source_mix": r"""
with d as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+'))::bigint as size,
         ('0x' || substr(md5(coalesce(doc_id::varchar, '') || '|' || coalesce(text, '')), 1, 15))::bigint as place
  from documents),
s as (
  select source, source_size, n, (n % 3 + 1)::double as weight, 3.0 * source_size::double as cap
  from (select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as n from d group by source)),
l as (
  select *, ((select sum(source_size) from s)::double - coalesce(sum(cap) over (order by cap / weight, n rows between unbounded preceding and 1 preceding), 0))
          / ((select sum(weight) from s) - coalesce(sum(weight) over (order by cap / weight, n rows between unbounded preceding and 1 preceding), 0)) as level
  from s),
t as (select *, least(cap, (select max(level) from l) * weight) as target from l),
h as (
  select *, case when n = (select max(n) from t) then 4294967296
            else floor(sum(target) over (order by n) / greatest((select sum(target) from t), 1e-300) * 4294967296)::bigint end as high
  from t),
b as (
  select source, n, source_size, target, coalesce(lag(high) over (order by n), 0) as low, high,
         greatest(1, least(4096, (select sum(source_size) from s) // 262144))::bigint as block from h),
k as (
  select b.n, count(*) as slots
  from (select (i * 2654435769::bigint) % 4294967296 as p from (select max(block) as block from b), unnest(range(0, ceil((select sum(source_size) from s) / block)::bigint)) u(i)) x
  join b on b.low <= p and p < b.high group by b.n),
p as (
  select d.doc_id, d.size, b.source_size, b.target, b.block, coalesce(k.slots, 0) as slots,
         ceil(b.source_size / b.block)::bigint as blocks,
         coalesce(sum(d.size) over (partition by b.n order by d.place, d.doc_id rows between unbounded preceding and 1 preceding), 0)::bigint as a
  from d join b on d.source is not distinct from b.source left join k on k.n = b.n)
select doc_id, size, source_size, target,
       (case when size = 0 then 0
             when slots >= 3 * blocks then 3 * size
             else (slots // blocks) * size + greatest(0, least(a + size, (slots % blocks) * block) - a) end)::bigint as taken
from p
""",
    "op6_benchmark_decontamination": rf"""
with d as (select doc_id, row_number() over () as r, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from documents),
i as (select item_id, regexp_extract_all({_LOW}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as w from benchmark),
p as (select distinct item_id, least(len(w), 8) as m, array_to_string(w[k : k + 7], ' ') as g
      from i, unnest(range(1, greatest(len(w) - 6, 2))) u(k) where len(w) > 0),
x as (select r, k, m, array_to_string(w[k : k + m - 1], ' ') as g
      from d, (select distinct m from p), unnest(range(1, len(w) - m + 2)) u(k)),
f as (select x.r, x.k, x.m, p.item_id from x join p using (m, g)),
c as (select r, count(distinct pos) as n_hit from (select r, unnest(range(k, k + m)) as pos from f) group by r),
n as (select r, count(*) as n_items, string_agg(item_id, ',' order by item_id) as ids
      from (select distinct r, item_id::varchar as item_id from f where item_id is not null) group by r)
select doc_id, len(w)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(ids, '')) as items_sha256, coalesce(n_items, 0) >= 2 as contaminated
from d left join c using (r) left join n using (r)
""",
}
