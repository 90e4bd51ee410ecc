"""DuckDB SQL for ops 1, 6 and 10 over documents whose doc_ids are distinct, with the operators' fixed values."""

from __future__ import annotations

from .secrets import ACCESS, ASSIGN, HEX, LONG, MOST_DOCS

SUBSTRING = r"""
with p as (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) i from (select doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') ws from documents)),
g as (select doc_id, i, list(w) over (partition by doc_id order by i rows between current row and 12 following) g from p),
m as (select doc_id, i, min(doc_id) over (partition by g) least from g where len(g) = 13),
r as (select distinct doc_id, i + k i from m, range(13) z(k) where least < doc_id),
o as (select p.doc_id, p.i, p.w, r.i is not null gone from p left join r on p.doc_id = r.doc_id and p.i = r.i),
b as (select *, gone and not lag(gone, 1, false) over (partition by doc_id order by i) opens from o),
a as (select doc_id, count(*) n, count(*) filter (gone) n_gone, count(*) filter (opens) n_open, string_agg(w, ' ' order by i) filter (not gone) kept from b group by 1)
select d.doc_id, coalesce(n, 0) n_words, coalesce(n_gone, 0) n_removed, sha256(coalesce(kept, '')) kept_sha256, coalesce(n_open, 0) n_intervals from documents d left join a using (doc_id)
"""

_LOW = "regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+')"
DECONTAMINATE = f"""
with ip as (select item_id, unnest(ws) w, generate_subscripts(ws, 1) i, len(ws) n from (select item_id, {_LOW} ws from benchmark)),
ig as (select item_id, i, n, list(w) over (partition by item_id order by i rows between current row and 9 following) g from ip),
win as (select distinct item_id, g from ig where len(g) = least(n, 10)),
dp as (select doc_id, unnest(ws) w, generate_subscripts(ws, 1) i from (select doc_id, {_LOW} ws from documents)),
dg as (select doc_id, i, list(w) over (partition by doc_id order by i rows between current row and 9 following) g from dp),
sized as (select doc_id, i, s, g[1:s] g from dg, (select distinct len(g) s from win) where len(g) >= s),
hit as (select doc_id, i, s, item_id from sized join win using (g)),
h as (select doc_id, count(distinct i + k) n from hit, range(10) z(k) where k < s group by 1),
it as (select doc_id, count(item) n, string_agg(item, ',' order by item) l from (select distinct doc_id, item_id::varchar item from hit) group by 1),
c as (select doc_id, count(*) n from dp group by 1)
select d.doc_id, coalesce(c.n, 0) n_words, coalesce(h.n, 0) n_hit, coalesce(it.n, 0) n_items, sha256(coalesce(it.l, '')) items_sha256, coalesce(h.n, 0) > 0 contaminated
from documents d left join c on d.doc_id = c.doc_id left join h on d.doc_id = h.doc_id left join it on d.doc_id = it.doc_id
"""


def _matches(kind: int, pattern: str) -> str:
    r = "'" + pattern.replace("'", "''") + "'"
    return f"""
  select doc_id, source, {kind} kind, m, (sum(length(gap)) over w + sum(length(m)) over w - length(m))::bigint a from (
    select doc_id, source, unnest(regexp_extract_all(t, {r})) m, unnest(string_split_regex(t, {r})[:-2]) gap, generate_subscripts(regexp_extract_all(t, {r}), 1) i from t)
  window w as (partition by doc_id order by i)"""


_VALUE = ASSIGN.replace("'", "''")
SECRETS = f"""
with t as (select doc_id, source, coalesce(text, '') t from documents),
f as ({" union all ".join(_matches(k, p) for k, p in enumerate((ASSIGN, ACCESS, HEX, LONG)))}),
v as (select *, a + length(m) z, case when kind = 0 then regexp_extract(m, '{_VALUE}', 2) else m end val from f),
ok as (select * from v where case kind when 0 then length(val) >= 6 when 1 then length(val) >= 20 when 2 then true else regexp_matches(val, '[0-9]') and regexp_matches(val, '[a-z]') and regexp_matches(val, '[A-Z]') end),
cand as (select distinct doc_id, source, z - length(val) a, z, val from ok),
own as (select val, count(distinct coalesce(source, chr(0))) > 1 or count(distinct coalesce(doc_id::varchar, '')) > {MOST_DOCS} copied from cand group by 1),
base as (select doc_id, a, kind, z, ['assign', 'access', 'hex'][kind + 1] || ':' || a || ':' || z s from ok where kind < 3),
live as (select doc_id, a, 3 kind, z, 'live:' || a || ':' || z s from cand join own using (val) where not copied),
b as (select doc_id, count(*) filter (kind = 0) n0, count(*) filter (kind = 1) n1, count(*) filter (kind = 2) n2, string_agg(s, ',' order by a, kind) s from base group by 1),
l as (select doc_id, string_agg(s, ',' order by a, kind, z) s, count(*) filter (kind = 3) n from (select * from base union all select * from live) group by 1),
c as (select doc_id, count(*) n from cand join own using (val) where copied group by 1)
select t.doc_id, coalesce(n0, 0) n_assign, coalesce(n1, 0) n_access, coalesce(n2, 0) n_hex, sha256(coalesce(b.s, '')) base_sha256, coalesce(l.s, '') spans, coalesce(l.n, 0) n_live, coalesce(c.n, 0) n_copied
from t left join b on t.doc_id = b.doc_id left join l on t.doc_id = l.doc_id left join c on t.doc_id = c.doc_id
"""
