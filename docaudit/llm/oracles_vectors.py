"""Check SQL of importance resampling and of the operators on embeddings, for DuckDB."""

from __future__ import annotations

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = (
    f"list_filter(string_split_regex({_LOWER.format("coalesce(text, '')")}, '[\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+'), lambda x: x <> '')"
)

# CRC-32 has no function in DuckDB: a table of 256 entries from the polynomial, then byte by byte.
OP11 = f"""
with recursive steps(b, k, v) as (
  select b, 0, b from (select unnest(range(256)) b)
  union all
  select b, k + 1, case when v % 2 = 1 then xor(v >> 1, 3988292384) else v >> 1 end from steps where k < 8),
crc_table as materialized (select list(v order by b) t from steps where k = 8),
dw as materialized (select doc_id, unnest({_WORDS}) w from documents),
bw as materialized (select unnest({_WORDS}) w from benchmark),
vocabulary as (select distinct w from (select w from dw union all select w from bw)),
coded as (select w, hex(encode(w)) x from vocabulary),
bytes as (
  select w, list_transform(range(1, cast(length(x) as bigint), 2),
                           lambda i: cast('0x' || substr(x, i, 2) as bigint)) b from coded),
hashed as materialized (
  select w, xor(list_reduce(list_prepend(4294967295::bigint, b),
                            lambda c, y: xor(c >> 8, t[xor(c, y) % 256 + 1])), 4294967295) % 10000 bucket
  from bytes, crc_table),
s as (select bucket, count(*) s from dw join hashed using (w) group by bucket),
t as (select bucket, count(*) t from bw join hashed using (w) group by bucket),
totals as (select (select count(*) from dw) all_s, (select count(*) from bw) all_t),
gains as materialized (
  select bucket, cast(floor(1000 * ln(((coalesce(t, 0) + 1)::double * (all_s + 10000)) / ((coalesce(s, 0) + 1)::double * (all_t + 10000)))) as bigint) gain
  from (select distinct bucket from hashed) left join s using (bucket) left join t using (bucket), totals),
d as (select doc_id, count(*) n_features, cast(sum(gain) as bigint) weight from dw join hashed using (w) join gains using (bucket) group by doc_id),
noise as (
  select doc_id, coalesce(n_features, 0) n_features, coalesce(weight, 0) weight,
         cast('0x' || substr(sha256('2024:' || doc_id), 1, 8) as bigint) h
  from documents left join d using (doc_id)),
scored as (
  select *, weight + cast(floor(-1000 * ln(-ln((h + 0.5::double) / 4294967296))) as bigint) score from noise),
placed as (
  select *, row_number() over (partition by n_features >= 20 order by score desc, doc_id) place,
         count(*) filter (n_features >= 20) over () n from scored)
select doc_id, n_features, weight, score,
       case when n_features >= 20 and place <= n * 10 // 100 then place end rank
from placed
"""

_START = """
with v as materialized (
  select vec_id, label, list_transform(embedding, lambda x: cast(floor(4096 * x) as bigint)) z
  from embeddings where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0),
p as materialized (
  select vec_id, q, list_slice(z, q * len(z) // 8 + 1, (q + 1) * len(z) // 8) y from v, (select unnest(range(8)) q)),
f as (select vec_id, row_number() over (order by vec_id) - 1 e from v qualify e < 16),
c0 as materialized (select q, e, y c from p join f using (vec_id))"""
_ASSIGNED = """
a{0} as materialized (
  select vec_id, q, min(d * 64 + e) k
  from (select vec_id, q, e, cast(list_sum(list_transform(list_zip(y, c), lambda x: (x[1] - x[2]) * (x[1] - x[2]))) as bigint) d
        from p join c{0} using (q))
  group by vec_id, q)"""
_MOVED = """
c{1} as materialized (
  select q, e, coalesce(m, c) c
  from c{0} left join (
    select q, e, list(x order by i) m
    from (select q, e, i, cast(floor(cast(sum(y) as double) / count(*)) as bigint) x
          from (select q, k % 64 e, unnest(y) y, generate_subscripts(y, 1) i from p join a{0} using (vec_id, q))
          group by q, e, i)
    group by q, e) using (q, e))"""
OP13 = (
    ",".join([_START, *[x for r in range(6) for x in (_ASSIGNED.format(r), _MOVED.format(r, r + 1))], _ASSIGNED.format(6)])
    + """,
coded as (
  select vec_id, string_agg(printf('%02x', k % 64), '' order by q) code, cast(sum(k // 64) as bigint) error from a6 group by vec_id),
books as (
  select sha256(string_agg(cast(x as varchar), ',' order by q, e, i)) s
  from (select q, e, unnest(c) x, generate_subscripts(c, 1) i from c6))
select vec_id, code, error, cast(sum(error) over (partition by label) as bigint) label_error, s codebooks_sha256
from v join coded using (vec_id), books
"""
)

OP12 = """
with recursive v as materialized (
  select vec_id, list_transform(embedding, lambda x: cast(x as double)) z from embeddings
  where embedding is not null and len(list_filter(embedding, lambda x: x is null or not isfinite(x))) = 0
    and len(list_filter(embedding, lambda x: x <> 0)) > 0),
l as materialized (
  select a.vec_id x, b.vec_id y from v a join v b on a.vec_id <> b.vec_id and len(a.z) = len(b.z)
  where list_dot_product(a.z, b.z) / sqrt(list_dot_product(a.z, a.z)) / sqrt(list_dot_product(b.z, b.z)) >= 0.9),
r(vec_id, m) as (
  select vec_id, vec_id from embeddings
  union
  select y, m from r join l on x = r.vec_id),
n as (select x vec_id, count(*) n from l group by x)
select vec_id, coalesce(n, 0) n_links, component_id, vec_id = component_id kept
from embeddings left join n using (vec_id) join (select vec_id, min(m) component_id from r group by vec_id) using (vec_id)
"""

SQL: dict[str, str] = {"op11_importance_resampling": OP11, "op12_lattice_dedup": OP12, "op13_vector_codes": OP13}
