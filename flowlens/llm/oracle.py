"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .host_reputation import RULES
from .mixing import GRID, MixParams
from .quality import QualityParams

WORD = r"[^\x20\x09-\x0D]+"


def op1() -> str:
    q = QualityParams()
    lengths = [3, *q.gram_share]
    flags = ", ".join(f"max(d{n}) over (partition by doc_id order by pos rows between {n - 1} preceding and current row) as r{n}" for n in lengths)
    grams = ", ".join(f"case when pos + {n} - 1 <= n and count(*) over (partition by doc_id, pos + {n} - 1 <= n, " + ", ".join(f"w{j}" for j in range(n)) + f") > 1 then 1 else 0 end as d{n}" for n in lengths)
    leads = ", ".join(["w as w0", *(f"lead(w, {j}) over (partition by doc_id order by pos) as w{j}" for j in range(1, max(lengths)))])
    sums = ", ".join(f"sum(case when r{n} = 1 then length(w) else 0 end)::bigint as dup_chars_{n}" for n in q.gram_share)
    bad = " or ".join(f"dup_chars_{n} > {s} * word_chars" for n, s in q.gram_share.items())
    return rf"""
with t as (select doc_id, coalesce(text, '') as text, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
w as (select doc_id, unnest(ws) as w, unnest(range(1, len(ws) + 1)) as pos, len(ws) as n from t),
l as (select *, {leads} from w),
g as (select doc_id, w, pos, n, {grams} from l),
c as (select doc_id, w, {flags} from g),
m as (select doc_id, count(*) as n_words, sum(length(w))::bigint as word_chars, sum(r3)::bigint as n_repeat_words, {sums} from c group by doc_id),
li as (select doc_id, unnest(string_split(text, chr(10))) as line, unnest(range(1, len(string_split(text, chr(10))) + 1)) as pos from t),
lw as (select doc_id, list_sum(list_transform(regexp_extract_all(line, '{WORD}'), lambda x: length(x))) as chars,
       row_number() over (partition by doc_id, line order by pos) as k from li where regexp_matches(line, '{WORD}')),
ld as (select doc_id, count(*) as n_dup_lines, sum(chars)::bigint as dup_line_chars from lw where k > 1 group by doc_id),
a as (select t.doc_id, coalesce(n_words, 0)::bigint as n_words, coalesce(word_chars, 0)::bigint as word_chars,
        (length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')))::bigint as n_symbols,
        coalesce(n_dup_lines, 0)::bigint as n_dup_lines, coalesce(n_repeat_words, 0)::bigint as n_repeat_words,
        {", ".join(f"coalesce(dup_chars_{n}, 0)::bigint as dup_chars_{n}" for n in q.gram_share)},
        coalesce(dup_line_chars, 0)::bigint as dup_line_chars
      from t left join m using (doc_id) left join ld using (doc_id)),
b as (select *, n_words < {q.min_words} or 100 * n_repeat_words > {q.repeat_percent} * n_words as base_failed from a)
select *, not base_failed and not (dup_line_chars > {q.line_share} * word_chars or n_symbols > {q.symbols_per_word} * n_words or {bad}) as kept from b
"""


OP4 = r"""
with dw as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws from documents),
iw as (select distinct cast(item_id as varchar) as item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') as ws
       from benchmark where item_id is not null and text is not null),
win as (select distinct item, least(10, len(ws)) as k, array_to_string(ws[p : p + least(10, len(ws)) - 1], ' ') as g
        from (select item, ws, unnest(range(1, len(ws) - least(10, len(ws)) + 2)) as p from iw where len(ws) > 0)),
ks as (select distinct k from win),
dg as (select doc_id, k, p, array_to_string(ws[p : p + k - 1], ' ') as g
       from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as p from dw, ks where len(ws) >= k)),
hit as (select doc_id, item, p, dg.k from dg join win on dg.k = win.k and dg.g = win.g),
cov as (select doc_id, count(distinct q) as n_hit from (select doc_id, unnest(range(p, p + k)) as q from (select distinct doc_id, p, k from hit)) group by doc_id),
its as (select doc_id, count(*) as n_items, string_agg(item, ',' order by item) as s from (select distinct doc_id, item from hit) group by doc_id)
select dw.doc_id, len(ws)::bigint as n_words, coalesce(n_hit, 0)::bigint as n_hit, coalesce(n_items, 0)::bigint as n_items,
       sha256(coalesce(s, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from dw left join cov using (doc_id) left join its using (doc_id)
"""

OP5 = rf"""
with recursive t as (select doc_id, regexp_extract_all(coalesce(text, ''), '{WORD}') as ws from documents),
s as (select distinct doc_id, g from (select doc_id, array_to_string(ws[p : p + 4], ' ') as g
      from (select doc_id, ws, unnest(range(1, greatest(1, len(ws) - 4) + 1)) as p from t where len(ws) > 0))),
n as (select doc_id, count(*) as n from s group by doc_id),
i as (select a.doc_id as a, b.doc_id as b, count(*) as c from s a join s b on a.g = b.g and a.doc_id <> b.doc_id group by all),
e as (select a, b from i join n x on x.doc_id = a join n y on y.doc_id = b where 5 * c >= 4 * (x.n + y.n - c)),
r as (select a as node, a as root from e union select r.node, e.b from r join e on e.a = r.root),
k as (select node, min(root) as class_id from r group by node),
d as (select a, count(*) as n_links from e group by a)
select t.doc_id, coalesce(class_id, t.doc_id)::bigint as class_id, coalesce(n_links, 0)::bigint as n_links
from t left join k on k.node = t.doc_id left join d on d.a = t.doc_id
"""


def op6() -> str:
    p = MixParams()
    return rf"""
with t as (select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}'))::bigint as n_tokens from documents),
s as (select source, sum(n_tokens)::bigint as tokens from t group by source),
b as (select sum(tokens)::double as total, count(*) as cnt from s where tokens > 0),
ks as (select unnest(range(0, {GRID} + 1)) as k),
z as (select k, sum(pow(q, k / {GRID}.0::double)) as z, sum(pow(q, k / {GRID}.0::double) * ln(q)) as zl, max(pow(q, k / {GRID}.0::double) / q) as top
      from (select tokens / total as q from s, b where tokens > 0), ks group by k),
e as (select coalesce(max(k), 0) as k from z, b where ln(z) - k / {GRID}.0::double * zl / z >= {p.entropy_share}::double * ln(cnt)),
f as (select coalesce(min(z.k), {GRID}) as k from z, e where z.k >= e.k and top / z <= {p.max_repeat}),
pl as (select source, tokens, case when tokens > 0 then round(pow(tokens / total, f.k / {GRID}.0::double) / z.z * total)::bigint else 0 end as budget
       from s, b, f join z on z.k = f.k),
m as (select *, case when tokens > 0 then budget // tokens else 1 end as epochs, case when tokens > 0 then budget % tokens else 0 end as rest from pl),
ep as (select t.*, m.tokens, m.budget, m.epochs, m.rest, unnest(range(0, epochs + 1)) as epoch from t join m on t.source is not distinct from m.source),
h as (select *, ('0x' || substr(md5('{p.seed}|' || epoch || '|' || coalesce(cast(doc_id as varchar), '')), 1, 8))::bigint as h from ep),
c as (select *, sum(n_tokens) over (partition by source, epoch order by h, doc_id) as upto from h)
select doc_id, source, epoch::int as epoch, n_tokens,
       round(case when budget > 0 then (epoch + h / 4294967296.0::double) * tokens / budget else h / 4294967296.0::double end, 9) as place
from c where epoch < epochs or rest > 0 and upto <= rest
"""


def op2() -> str:
    cases = " ".join(f"when (host = '{r.split('/')[0]}' or ends_with(host, '.{r.split('/')[0]}')) and starts_with(path, '{r[r.index('/'):]}') then '{r}'"
                     for r, _ in sorted(RULES, key=lambda x: (-len(x[0]), x[0])))
    says = " ".join(f"when rule = '{r}' then '{v}'" for r, v in RULES)
    host = "translate(regexp_extract(coalesce(url, ''), '(?s)^.*?://([^/?#]*)', 1), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    rho = "1 / least(0.5, greatest(0.001, case when pairs > 0 then (spread - chance) / pairs else 0.001 end)) - 1"
    kappa = lambda child, parent, on: (f"(select {rho} from (select sum(c.n * (c.bad / c.n - p.bad / p.n) ** 2) as spread, sum(p.bad / p.n * (1 - p.bad / p.n)) as chance, "  # noqa: E731
                                       f"sum(p.bad / p.n * (1 - p.bad / p.n) * (c.n - 1)) as pairs from {child} c join {parent} p on {on} where c.n > 0))")
    return rf"""
with u as (select page_id, url, {host} as host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) as path from pages),
r as (select *, case {cases} else null end as rule from u),
o as (select host, (1 - quality)::bigint as bad from (select host, regexp_extract(path, '/([0-9]{{1,18}})(\.html)?/?$', 1) as x from u) v
      join labels on x <> '' and doc_id = try_cast(x as bigint) where quality is not null),
hs as (select host, count(bad)::double as n, coalesce(sum(bad), 0)::double as bad from (select host, null as bad from u union all select host, bad from o) group by host),
hd as (select *, regexp_replace(host, '^.*@|:[0-9]*$', '') as bare from hs),
hh as (select host, n, bad, case when regexp_matches(bare, '^[0-9]+(\.[0-9]+){{3}}$') then bare else array_to_string(string_split(bare, '.')[-2:], '.') end as domain from hd),
h as (select *, string_split(domain, '.')[-1] as suffix from hh),
d as (select domain, suffix, sum(n) as n, sum(bad) as bad from h group by all),
s as (select suffix, sum(n) as n, sum(bad) as bad from d group by all),
a as (select sum(n) as n, sum(bad) as bad from s),
k as (select {kappa('s', 'a', 'true')} as ks, {kappa('d', 's', 'c.suffix = p.suffix')} as kd, {kappa('h', 'd', 'c.domain = p.domain')} as kh),
sm as (select suffix, (s.bad + ks * (a.bad + 1) / (a.n + 2)) / (s.n + ks) as m from s, a, k),
dm as (select domain, (d.bad + kd * sm.m) / (d.n + kd) as m from d join sm using (suffix), k),
hm as (select host, (h.bad + kh * dm.m) / (h.n + kh) as m, h.n + kh as total from h join dm using (domain), k),
f as (select host, round(m, 6) as bad_mean, round(m - 1.645 * sqrt(m * (1 - m) / (total + 1)), 6) as bad_bound from hm)
select page_id, host, path, rule, coalesce(case {says} else null end, case when bad_bound > 0.3 then 'block' else 'allow' end) as verdict, bad_mean, bad_bound
from r left join f using (host)
"""


OP8 = r"""
with p as (select page_id, coalesce(html, '') as b from pages),
x as (select page_id, strlen(b)::bigint as payload_bytes, sha1(b) as hex, min(page_id) over (partition by b) as first from p),
bits as (select *, list_reduce(list_transform(range(1, 41), lambda i: lpad(bin(('0x' || substr(hex, i::int, 1))::int), 4, '0')), lambda a, c: a || c) as s from x)
select page_id, payload_bytes,
       list_reduce(list_transform(range(0, 32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567',
         list_sum(list_transform(range(0, 5), lambda j: (substr(s, (5 * i + j + 1)::int, 1)::int * (16 >> j::int))))::int + 1, 1)), lambda a, c: a || c) as payload_digest,
       case when page_id = first then 'response' else 'revisit' end as record_type,
       case when page_id = first then null else first end as refers_to
from bits
"""


OP11 = r"""
with t as (select coalesce(lang, '') as lang, coalesce(source, '') as source, row_number() over () as d,
             regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+') as ws from documents),
w as (select lang, source, term, count(*)::bigint as c, count(distinct d) as docs from (select lang, source, d, unnest(ws) as term from t) group by all),
kept as (select lang, term, sum(c)::bigint as c from w group by all having sum(docs) >= 10),
ls as (select lang, count(*)::bigint as v, sum(c)::bigint as n from kept group by lang),
own as (select w.lang, w.source, sum(w.c)::bigint as n from w join kept using (lang, term) group by all),
g as (select lang, source, coalesce(v, 0) as v, coalesce(own.n, 0) as n from (select distinct lang, source from t) left join ls using (lang) left join own using (lang, source)),
dense as (select g.lang, g.source, k.term, coalesce(w.c, 0) as c,
            (1 + 1000000000::hugeint * (coalesce(w.c, 0) + 2) // (g.n + 2 * g.v))::bigint as p, (1 + 1000000000::hugeint * (k.c + 2) // (ls.n + 2 * ls.v))::bigint as q
          from g join kept k on k.lang = g.lang join ls on ls.lang = g.lang left join w on w.lang = g.lang and w.source = g.source and w.term = k.term),
sums as (select a.lang, a.source, b.source as item, sum((a.p - b.p) * (a.p - b.p) // (a.p + b.p))::bigint as value
         from dense a join dense b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
pairs as (select a.lang, a.source, b.source as item, coalesce(value, 0)::bigint as value from g a join g b on a.lang = b.lang and a.source <> b.source
          left join sums s on s.lang = a.lang and s.source = a.source and s.item = b.source),
terms as (select lang, source, term as item, ((p - q) * (p - q) // (p + q))::bigint as value from dense where c > 0 and p > q),
ranked as (select lang, source, 'pair' as part, item, value, row_number() over (partition by lang, source order by value desc, item)::int as rank from pairs
  union all select lang, source, 'term', item, value, row_number() over (partition by lang, source order by value desc, item)::int from terms)
select * from ranked where part = 'pair' or rank <= 10
"""


def oracle_sql() -> dict[str, str]:
    return {"op1_quality_rules": op1(), "op2_url_filters": op2(), "op4_decontamination": OP4, "op5_jaccard_join": OP5,
            "op6_source_mixing": op6(), "op8_warc_archive": OP8, "op11_source_divergence": OP11}
