"""SQL of queries whose definition takes more than a line or two."""

from __future__ import annotations

SQL: dict[str, str] = {}

#: White space and token characters as Python's and Java's Unicode classes see them.
_WS = r"\t-\r\x1c-\x20\x{85}\x{A0}\x{1680}\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}"


def _spans(pattern: str, text: str = "text", key: str = "doc_id", rel: str = "documents") -> str:
    """(doc, i, str, start, end) of what a pattern of one or more characters of
    a class matches: gaps and matches alternate, so places are running sums."""
    return f"""(select doc, i - 1 as i, toks[i] as str, gap_sum + coalesce(tok_sum, 0) as start, gap_sum + coalesce(tok_sum, 0) + length(toks[i]) as end from (
  select doc, toks, i, sum(length(gaps[i])) over w as gap_sum, sum(length(toks[i])) over (partition by doc order by i rows between unbounded preceding and 1 preceding) as tok_sum from (
    select {key} as doc, regexp_extract_all({text}, '{pattern}') as toks, regexp_split_to_array({text}, '{pattern}') as gaps, unnest(range(1, len(regexp_extract_all({text}, '{pattern}')) + 1)) as i from {rel})
  window w as (partition by doc order by i)))"""


_SPACED = _spans(f"[^{_WS}]+")
SQL["space_spans"] = f'select doc, i::int as i, str, start::int as start, "end"::int as "end" from {_SPACED}'
SQL["token_locations"] = f'select doc, i::int as i, str, start::int as start, "end"::int as "end" from {_spans("[\\p{L}\\p{N}_]{2,}", "lower(text)")}'
SQL["left_modifiers"] = f"with t as (select *, lag(str) over (partition by doc order by i) as modifier from {_SPACED}) select doc, i::int as annot, modifier from t where length(str) > 8"

SQL["annotation_alignment"] = f"""with t as (select doc, i, start as ts, "end" as te from {_SPACED}), a as (select doc, i as annot, start + 1 as s, "end" + 3 as e from {_SPACED} where length(str) >= 3),
f as (select a.doc, annot, s, e, min(i) as first from a join t on a.doc = t.doc and (ts = s or (ts < s and s < te)) group by 1, 2, 3, 4),
l as (select f.doc, annot, first, min(i) as last from f left join t on f.doc = t.doc and i >= first and (te = e or e < te) group by 1, 2, 3),
m as (select doc, max(i) as m from t group by 1)
select l.doc, annot::int as annot, unnest(range(first, coalesce(last, m) + 1))::int as i from l join m on l.doc = m.doc"""

_PLACES = _spans(r"[\p{L}\p{N}_''-]+")


def _dictionary(tbl: str, key: str, text: str, rel: str, doc: str) -> str:
    return f"""select '{tbl}' as tbl, {doc} as doc, id, start::int as start, "end"::int as "end", substr(full_text, start::bigint + 1, ("end" - start)::bigint) as text from (
  select h.*, max(n) over (partition by doc, start) as longest from (
    select w.doc, w.start, w.ends[w.i + d.n - 1] as "end", d.n, d.id, w.full_text from (
      select t.*, l.n from (
        select doc, full_text, i, start, words, ends from (
          select doc, list(lower(str) order by i) as words, list("end" order by i) as ends, list(start order by i) as starts from {_spans(r"[\p{L}\p{N}_''-]+", text, key, rel)} group by 1)
          join (select {key} as doc, {text} as full_text from {rel}) using (doc), lateral (select unnest(range(1, len(words) + 1)) as i), lateral (select starts[i] as start)) t
      join (select words[1] as first, n from dict group by 1, 2) l on t.words[t.i] = l.first and t.i + l.n - 1 <= len(t.words)) w
    join dict d on d.n = w.n and d.words = w.words[w.i:w.i + d.n - 1]) h) where n = longest"""


SQL["dictionary_match"] = f"""with dict as (select distinct id, words, len(words) as n from (select node_id as id, list_filter(regexp_split_to_array(lower(trim(lb)), '\\s+'), lambda w: w <> '') as words from concepts where lb is not null and trim(lb) <> '') where len(words) > 0),
lit as (select row_number() over () as k, o from triples where o_is_literal)
{_dictionary('documents', 'doc_id', 'text', 'documents', 'doc')} union all {_dictionary('triples', 'k', 'o', 'lit', 'null::bigint')}"""

SQL["clean_passage"] = r"""with a as (select doc_id, regexp_replace(text, '^(?:null)+', '') as x from documents), b as (select doc_id, regexp_replace(regexp_replace(x, '[\t\r\n]+', ' ', 'g'), '[^\x00-\x7F]+', ' ', 'g') as x from a),
c as (select doc_id, trim(regexp_replace(regexp_replace(x, '^'' | '' ', ' ', 'g'), ' ''s\b', '''s', 'g'), ' ') as x from b) select doc_id, case when length(x) > 2 then x end as v from c"""
SQL["normal_form"] = r"select doc_id, regexp_replace(nfc_normalize(text), '[^\x00-\x7F]', ' ', 'g') as v from documents"

_PRED = "p as (select case when l_returnflag = 'R' then 1 else 0 end as t, l_discount * 100 + l_tax as s, l_linestatus as g from lineitem)"
SQL["macro_roc"] = f"""with {_PRED}, pts as (select g, s, sum(t) as p, sum(1 - t) as n from p group by 1, 2),
curve as (select g, sum(n) over w::double / sum(n) over (partition by g) as fpr, sum(p) over w::double / sum(p) over (partition by g) as tpr from pts window w as (partition by g order by s desc)),
best as (select g, fpr as x, max(tpr) as y from curve group by 1, 2), knots as (select * from best union all select g, 0.0, 0.0 from (select distinct g from best) where g not in (select g from best where x = 0) union all select g, 1.0, 1.0 from (select distinct g from best) where g not in (select g from best where x = 1)),
grid as (select distinct g, k, k / 99.0::double as x from best, (select unnest(range(100)) as k)),
v as (select grid.g, k, x, (select max(b.x) from knots b where b.g = grid.g and b.x <= grid.x) as x0, (select min(b.x) from knots b where b.g = grid.g and b.x >= grid.x) as x1 from grid),
w as (select v.*, a.y as y0, b.y as y1 from v join knots a on a.g = v.g and a.x = v.x0 join knots b on b.g = v.g and b.x = v.x1)
select round(x, 6) as fpr, round(avg(case when x1 > x0 then y0 + (y1 - y0) * (x - x0) / (x1 - x0) else y0 end), 6) as tpr from w group by k, x"""

SQL["model_overlaps"] = """with b as (select [(l_discount > 0.05)::int, (l_tax > 0.04)::int, (l_quantity > 25)::int] as m, (l_returnflag = 'R')::int as t from lineitem),
s as (select unnest([{'subset': 'm1', 'ins': [1], 'outs': [2, 3]}, {'subset': 'm2', 'ins': [2], 'outs': [1, 3]}, {'subset': 'm1&m2', 'ins': [1, 2], 'outs': [3]}, {'subset': 'm3', 'ins': [3], 'outs': [1, 2]}, {'subset': 'm1&m3', 'ins': [1, 3], 'outs': [2]}, {'subset': 'm2&m3', 'ins': [2, 3], 'outs': [1]}, {'subset': 'm1&m2&m3', 'ins': [1, 2, 3], 'outs': []::int[]}]) as x),
e as (select x.subset as subset, m, t, x.ins as ins, coalesce(list_sum(list_transform(x.ins, lambda i: m[i])), 0) as si, coalesce(list_sum(list_transform(x.outs, lambda i: m[i])), 0) as so, len(x.ins) as ni, len(x.outs) as no from b, s)
select subset, count(*) as n, sum((m[ins[1]] = t)::int)::bigint as n_right from e where si in (0, ni) and so in (0, no) and si + so in (ni, no) group by 1"""

_MD5 = "('0x' || substr(md5({k} || ':0'), 1, 8))::bigint"
SQL["rebalance"] = f"""with x as (select event_id, case when value > 95 then 1 else 0 end as y from events), n as (select count(*) as n, sum(y) as p from x),
pos as (select event_id, row_number() over (order by event_id) - 1 as i from x where y = 1), d as (select distinct {_MD5.format(k='k')} % (select p from n) as i from (select unnest(range(((select n - p from n) / 3.0)::int)) as k))
select event_id, y from x where y = 0 or (select p / n >= 0.25 from n) union all select event_id, 1 from pos where i in (select i from d) and (select p / n < 0.25 from n)"""

SQL["heap_order"] = """with recursive h(idx, path) as (select 0::bigint, '' union all select 2 * idx + 1 + k, path || k from h, (select unnest([0, 1]) as k) where 2 * idx + 1 + k <= (select max(n_nationkey) from nation))
select idx::int as idx, row_number() over (order by path || '2') as rank from h where idx in (select n_nationkey from nation)"""

SQL["tree_merge_pairs"] = """with recursive l(level, width, base) as (select 0, (select count(*) from supplier), 0::bigint union all select level + 1, (width + 1) // 2, base + width from l where width > 1)
select base + p as id, case when width > 1 then base + width + p // 2 end as parent, level from (select *, unnest(range(width)) as p from l)"""

_STEM = "case when length(w) >= 4 then regexp_replace(w, '(?:ing|s|e|able)$', '') else w end"
_TOK = r"regexp_extract_all(lower(coalesce(text, '')), '[\p{L}\p{N}_]{2,}')"
SQL["analyzed_tokens"] = f"with t as (select doc_id, {_TOK} as t, list_transform({_TOK}, lambda w: {_STEM}) as n from documents) select doc_id, array_to_string(list_concat(t, list_filter(n, lambda w, i: not list_contains(t, w) and not list_contains(n[1:i - 1], w))), ' ') as v from t"

SQL["enriched_texts"] = """with toks as (select doc, term, i from (select doc_id as doc, regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}') as t, unnest(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')) as term, unnest(range(len(regexp_extract_all(lower(text), '[\\p{L}\\p{N}_]{2,}')))) as i from documents)),
near as (select lower(word) as term, min_by(word, idx) || '_near' as word, (min(idx) % 3)::int as rank from w2v_cache where word is not null group by 1),
x as (select doc, 0 as part, i, 0 as rank, term as w from toks union all select doc, 1, i, rank, word from toks join near using (term))
select doc, string_agg(w, ' ' order by part, i, rank, w) as text from x group by 1"""

SQL["annotation_values"] = """with lb as (select distinct s as id, o as label from triples where p = 'lb' and s is not null and o is not null)
select distinct t.s as id, t.o as value, lb.label from triples t join lb on t.s = lb.id where t.p = 'ref'"""

_E = "e0 as (select s as a, o as b from triples where p in ('rc', 'co') and s is not null and o is not null and s <> o), e as (select a, b from e0 union select b, a from e0)"
SQL["components"] = f"""with recursive {_E}, c(id, root) using key (id) as (select distinct a, a from e union select e.b, min(c.root) from c join e on e.a = c.id join recurring.c as r on r.id = e.b where c.root < r.root group by e.b) select id, root from c"""

_D2 = "list_sum(list_transform(list_zip(a.embedding, b.embedding), lambda z: (z[1]::double - z[2]::double) * (z[1]::double - z[2]::double)))"
_KNN = f"""near as (select i, j, d from (select i, j, d, row_number() over (partition by i order by d, j) as r from (select a.vec_id as i, b.vec_id as j, sqrt({_D2}) as d from embeddings a, embeddings b where a.vec_id <> b.vec_id)) where r <= 4),
edges as (select distinct least(i, j) as a, greatest(i, j) as b, d as w from near), ranked as (select *, row_number() over (order by w, a, b) as r from edges)"""
_FOREST = f"""{_KNN}, both_ways as (select a, b, r from ranked union all select b, a, r from ranked),
reach(r, v) as (select r, a from ranked union select reach.r, o.b from reach join both_ways o on o.a = reach.v and o.r < reach.r),
forest as (select a, b, w from ranked k where not exists (select 1 from reach where reach.r = k.r and reach.v = k.b))"""
SQL["spanning_forest"] = f"with recursive {_FOREST} select a, b, round(w, 5) as w from forest"
SQL["blended_pairs"] = f"""with pairs as (select a.vec_id as i, b.vec_id as j, sqrt({_D2}) as d, list_transform(list_zip(a.embedding[1:4], b.embedding[1:4]), lambda z: z[1]::double - z[2]::double) as x from embeddings a join embeddings b on a.vec_id < b.vec_id),
f as (select vec_id, k, embedding[k]::double as v from embeddings, (select unnest([1, 2, 3, 4]) as k)), cov as (select p.k as f, q.k as g, covar_samp(p.v, q.v) as c from f p join f q using (vec_id) group by 1, 2),
w as (select list(w order by f, g) as w from (select f, g, case when c < 0 then exp(-10 * c) else 1.0 end as w from cov)),
con as (select i, j, d, abs(list_sum(list_transform(range(16), lambda t: x[t // 4 + 1] * w.w[t + 1] * x[t % 4 + 1]))) as c from pairs, w),
s as (select i, j, 0.5 * (d - min(d) over ()) / (max(d) over () - min(d) over ()) + 0.5 * (c - min(c) over ()) / (max(c) over () - min(c) over ()) as d from con)
select i, r as rank, j, round(d, 5) as d from (select i, j, d, row_number() over (partition by i order by d, j) as r from s) where r <= 3"""

SQL["tree_clusters"] = f"""with recursive {_FOREST}, cutoff as (select *, row_number() over (order by w, a, b) - 1 as r, count(*) over () as n from forest), kept as (select a, b, w from cutoff where r <= 0.9 * greatest(n - 1, 1)),
least_of as (select v, min(w) as m from (select a as v, w from kept union all select b, w from kept) group by 1),
fine as (select k.a, k.b from kept k join least_of x on x.v = k.a join least_of y on y.v = k.b where not ((coalesce((k.w - x.m) / nullif(x.m, 0), 0) > 1 and y.m < k.w) or (coalesce((k.w - y.m) / nullif(y.m, 0), 0) > 1 and x.m < k.w))),
fe as (select a, b from fine union select b, a from fine), c(src, v) as (select distinct a, a from fe union select c.src, fe.b from c join fe on fe.a = c.v), roots as (select src as id, min(v) as cluster from c group by 1)
select vec_id as id, coalesce(cluster, -1) as cluster from embeddings left join roots on id = vec_id"""

SQL["place_tree"] = """select 'R:' || r_regionkey as node, 'R:' || r_regionkey as root, 0::bigint as depth from region where r_regionkey in (select n_regionkey from nation)
union all select 'N:' || n_nationkey, 'R:' || n_regionkey, 1 from nation union all select 'C:' || c_custkey, 'R:' || n_regionkey, 2 from customer join nation on c_nationkey = n_nationkey"""


def _fuzzy_rounds(rounds: int) -> str:
    """Memberships and centres of every round as common table expressions."""
    parts = []
    for r in range(rounds + 1):
        dist = f"select v.doc, c.k, greatest(sum((v.x - c.x) * (v.x - c.x)), 1e-12) as d from v join c{r} c using (i) group by 1, 2"
        parts.append(f"u{r} as (select doc, k, (1 / d) / sum(1 / d) over (partition by doc) as u from ({dist}))")
        parts.append(f"c{r + 1} as (select k, i, sum(u * u * x) / sum(u * u) as x from u{r} join v using (doc) group by 1, 2)")
    return ", ".join(parts)


SQL["fuzzy_means"] = f"""with v as (select vec_id as doc, unnest(embedding)::double as x, unnest(range(len(embedding))) as i from embeddings),
s as (select vec_id as doc, row_number() over (order by {_MD5.format(k='vec_id')}, vec_id) - 1 as k from embeddings), c0 as (select k, i, x from v join s using (doc) where k < 4), {_fuzzy_rounds(5)}
select doc, k::int as cluster, round(u, 6) as u from u5"""
