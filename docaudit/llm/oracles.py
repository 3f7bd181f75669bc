"""Check SQL of the registered queries, for DuckDB."""

from __future__ import annotations

from docaudit.llm.license_templates import TEMPLATES

_ASCII = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"

OP1 = rf"""
with recursive w as (
  select doc_id, list_filter(string_split_regex({_ASCII.format("coalesce(text, '')")}, '[\x20\x09-\x0D]+'), lambda x: x <> '') w
  from documents),
s as (
  select distinct doc_id, array_to_string(list_slice(w, i, i + 2), ' ') g
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 2, 1))) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by doc_id),
p as (
  select a.doc_id x, b.doc_id y, count(*) c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
l as (
  select x, y from p join n nx on nx.doc_id = x join n ny on ny.doc_id = y where 100 * c >= 90 * (nx.n + ny.n - c)),
r(doc_id, m) as (
  select doc_id, doc_id from documents
  union
  select y, m from r join l on x = r.doc_id)
select d.doc_id, coalesce(n, 0) n_shingles, component_id
from documents d left join n using (doc_id) join (select doc_id, min(m) component_id from r group by doc_id) using (doc_id)
"""

OP2 = rf"""
with dw as (
  select doc_id, list_filter(string_split_regex({_ASCII.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
                             lambda x: x <> '') w
  from documents),
iw as (
  select item_id, list_filter(string_split_regex({_ASCII.format("coalesce(text, '')")}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'),
                              lambda x: x <> '') w
  from benchmark),
ig as (
  select distinct item_id, n, array_to_string(list_slice(w, i, i + n - 1), ' ') g
  from (select item_id, w, least(len(w), 10) n, unnest(generate_series(1, len(w) - least(len(w), 10) + 1)) i
        from iw where len(w) > 0)),
dg as (
  select doc_id, n, i, array_to_string(list_slice(w, i, i + n - 1), ' ') g
  from (select doc_id, w, n, unnest(generate_series(1, len(w) - n + 1)) i
        from dw, (select distinct n from ig) where len(w) >= n)),
hits as (select doc_id, item_id, n, i from dg join ig using (n, g)),
words as (select doc_id, count(distinct p) n_hit
          from (select doc_id, unnest(generate_series(i, i + n - 1)) p from hits) group by doc_id),
items as (select doc_id, count(*) n_items, string_agg(s, ',' order by s) s
          from (select distinct doc_id, cast(item_id as varchar) s from hits) group by doc_id)
select doc_id, cast(len(w) as bigint) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items,
       sha256(coalesce(s, '')) items_sha256, n_hit is not null contaminated
from dw left join words using (doc_id) left join items using (doc_id)
"""

OP3 = rf"""
with l as (
  select doc_id, n, line, {_ASCII.format("trim(line, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))")} k
  from (select doc_id, unnest(string_split(coalesce(text, ''), chr(10))) line,
               generate_subscripts(string_split(coalesce(text, ''), chr(10)), 1) n from documents)),
c as (select k, max(doc_id) top from l where length(k) >= 40 group by k having count(distinct doc_id) >= 5)
select doc_id, count(*) n_lines, count(*) filter (top is not null and top <> doc_id) n_dropped,
       sha256(coalesce(string_agg(line, chr(10) order by n) filter (top is null or top = doc_id), '')) kept_sha256
from l left join c using (k) group by doc_id
"""

OP9 = r"""
with d as (
  select doc_id, source, coalesce(text, '') t,
         list_filter(string_split_regex(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '') w,
         list_filter(string_split(coalesce(text, ''), chr(10)),
                     lambda x: trim(x, chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) <> '') l
  from documents),
g as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 2), ' ') g
  from (select doc_id, w, unnest(generate_series(1, len(w) - 2)) i from d where len(w) >= 3)),
r as (
  select doc_id, count(distinct p) n
  from (select doc_id, unnest([i, i + 1, i + 2]) p
        from (select doc_id, i, count(*) over (partition by doc_id, g) c from g) where c >= 2)
  group by doc_id),
base as (
  select d.doc_id, source, t, l, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars,
         cast(length(t) - length(regexp_replace(t, '[#*$%&|<>]', '', 'g')) as bigint) n_symbols,
         cast(len(l) - len(list_distinct(l)) as bigint) n_dup_lines, coalesce(n, 0) n_repeat_words
  from d left join r using (doc_id)),
f as (select *, n_words < 50 or 100 * n_repeat_words > 50 * n_words base_failed from base),
x as (
  select distinct doc_id, source, t, base_failed, k from (
    select doc_id, source, t, base_failed,
           lower(trim(unnest(l), chr(32) || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))) k from f)),
b as (
  select source, k, min(doc_id) filter (not base_failed) first, true common
  from x group by source, k having count(distinct t) > 20),
s as (
  select doc_id, sum(length(k)) total, coalesce(sum(length(k)) filter (common and first is distinct from doc_id), 0) gone
  from x left join b using (source, k) group by doc_id)
select f.doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed,
       not base_failed and total > 0 and 1 - gone / total >= 0.2 kept
from f left join s using (doc_id)
"""

OP7 = """
with p as (
  select page_id, coalesce(html, '') h, min(page_id) over (partition by coalesce(html, '')) first from pages),
b as (
  select *, array_to_string(list_transform(range(1, 41), lambda j: substr(
      '0000000100100011010001010110011110001001101010111100110111101111',
      1 + 4 * (strpos('0123456789abcdef', substr(sha1(h), j, 1)) - 1), 4)), '') bits
  from p)
select page_id, cast(strlen(h) as bigint) payload_bytes,
       array_to_string(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
           1 + 16 * cast(substr(bits, 5 * i + 1, 1) as int) + 8 * cast(substr(bits, 5 * i + 2, 1) as int)
             + 4 * cast(substr(bits, 5 * i + 3, 1) as int) + 2 * cast(substr(bits, 5 * i + 4, 1) as int)
             + cast(substr(bits, 5 * i + 5, 1) as int), 1)), '') payload_digest,
       case when page_id = first then 'response' else 'revisit' end record_type,
       case when page_id <> first then first end refers_to
from b
"""

_TEMPLATE_ROWS = ", ".join("('{}', '{}')".format(n, t.replace("'", "''")) for n, t in TEMPLATES.items())
_ALNUM = r"list_filter(string_split_regex({0}, '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda x: x <> '')"

OP10 = f"""
with t(name, text) as (values {_TEMPLATE_ROWS}),
tw as (select name, {_ALNUM.format(_ASCII.format("text"))} w from t),
ts as (
  select distinct name, array_to_string(list_slice(w, i, i + 4), ' ') g
  from (select name, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) i from tw)),
tn as (select name, count(*) n from ts group by name),
dw as (select doc_id, {_ALNUM.format(_ASCII.format("coalesce(text, '')"))} w from documents),
ds as (
  select doc_id, i, array_to_string(list_slice(w, i, i + 4), ' ') g
  from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) i from dw where len(w) > 0)),
m as (select doc_id, name, n, i, g from ds join ts using (g) join tn using (name)),
c as (
  select a.doc_id, a.name, a.i, count(distinct b.g) / a.n share
  from m a join m b on b.doc_id = a.doc_id and b.name = a.name and b.i between a.i and a.i + 2 * a.n - 1
  group by a.doc_id, a.name, a.i, a.n),
f as (select doc_id, name, max(share) share from c where share >= 0.8 group by doc_id, name),
r as (select doc_id, count(*) n, string_agg(name, ',' order by name) s, max(share) b from f group by doc_id)
select doc_id, coalesce(n, 0) n_licenses, coalesce(s, '') licenses, cast(coalesce(b, 0) as double) best_share
from documents left join r using (doc_id)
"""

SQL: dict[str, str] = {
    "op1_ngram_join": OP1, "op2_decontaminate": OP2, "op3_line_dedup": OP3, "op7_warc": OP7, "op9_quality_rules": OP9,
    "op10_license_scan": OP10,
}
