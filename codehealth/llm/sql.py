"""SQL for the operators that SQL can express, over the same tables."""

from __future__ import annotations

from codehealth.llm.secret_ledger import BASE_RULES, RULES

WORD = "[^\\x20\\x09-\\x0D]+"
WORDS = f"regexp_extract_all(coalesce(text, ''), '{WORD}')"


def quoted(pattern: str) -> str:
    return "'" + pattern.replace("'", "''") + "'"


OP1 = f"""with recursive w as (select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{WORD}') w from documents),
s as (select distinct doc_id, array_to_string(w[i:i + 4], ' ') s from (select doc_id, w, unnest(generate_series(1, greatest(len(w) - 4, 1))) i from w where len(w) > 0)),
n as (select doc_id, count(*) n from s group by 1),
p as (select a.doc_id a, b.doc_id b, count(*) c from s a join s b on a.s = b.s and a.doc_id < b.doc_id group by 1, 2),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * c >= 85 * (x.n + y.n - c)),
d as (select a, b from e union all select b, a from e),
r(a, b) as (select a, b from d union select r.a, d.b from r join d on r.b = d.a),
m as (select a, least(a, min(b)) m from r group by a)
select d.doc_id, coalesce(n.n, 0) as n_shingles, coalesce(m.m, d.doc_id) as component_id, coalesce(m.m, d.doc_id) = d.doc_id as kept from documents d left join n on n.doc_id = d.doc_id left join m on m.a = d.doc_id"""

# A token with a digit is variable; parts of the tokens after the third are variable as a whole.
_TEMPLATE = """case k when 0 then concat_ws(chr(1), cast(n as varchar), 'all', array_to_string(t, chr(2)))
  else concat_ws(chr(1), cast(n as varchar), array_to_string(t[1:3], chr(2)), cast(k as varchar), array_to_string(t[4:3 + (n - 3) * (k - 1) // 4], chr(2)), array_to_string(t[4 + (n - 3) * k // 4:], chr(2))) end"""
OP3 = f"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
t as (select doc_id, i, list_transform(regexp_extract_all(line, '{WORD}'), lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) t from l),
k as (select doc_id, i, t, len(t) n, unnest(case when len(t) >= 11 then [0, 1, 2, 3, 4] else [0] end) k from t where len(t) >= 3),
p as (select doc_id, i, {_TEMPLATE} p from k),
h as (select p, min(doc_id) f from (select distinct p, doc_id from p) group by p having count(*) >= 10),
g as (select distinct doc_id, i from p join h using (p) where doc_id <> f)
select l.doc_id, count(*) as n_lines, count(g.i) as n_dropped, sha256(coalesce(string_agg(case when g.i is null then line end, chr(10) order by l.i), '')) as kept_sha256 from l left join g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id"""

# The same templates, and -1 for all tokens as they are, which recur from 2 documents on.
OP3_EXACT = f"""with l as (select doc_id, unnest(string_split(text, chr(10))) line, generate_subscripts(string_split(text, chr(10)), 1) i from documents),
w as (select doc_id, i, regexp_extract_all(line, '{WORD}') w from l),
t as (select doc_id, i, w, list_transform(w, lambda x: case when regexp_matches(x, '[0-9]') then '<*>' else x end) t from w),
k as (select doc_id, i, w, t, len(t) n, unnest(case when len(t) >= 11 then [-1, 0, 1, 2, 3, 4] else [-1, 0] end) k from t where len(t) >= 3),
p as (select doc_id, i, k, case when k < 0 then array_to_string(w, chr(2)) else {_TEMPLATE} end p from k),
h as (select k, p, min(doc_id) f from (select distinct k, p, doc_id from p) group by all having count(*) >= case when k < 0 then 2 else 10 end),
g as (select distinct doc_id, i from p join h using (k, p) where doc_id <> f)
select l.doc_id, count(*) as n_lines, count(g.i) as n_dropped, sha256(coalesce(string_agg(case when g.i is null then line end, chr(10) order by l.i), '')) as kept_sha256 from l left join g on g.doc_id = l.doc_id and g.i = l.i group by l.doc_id"""

_HEX = "sha1(encode(coalesce(html, '')))"
_BASE32 = f"list_reduce(list_transform(generate_series(0, 31), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', cast(((('0x' || substr({_HEX}, cast(i // 4 * 5 + 1 as int), 5))::bigint) >> (15 - (i % 4) * 5)) & 31 as int) + 1, 1)), lambda a, b: a || b)"
OP4 = f"""with p as (select page_id, octet_length(encode(coalesce(html, ''))) payload_bytes, {_BASE32} payload_digest, max(page_id) over (partition by coalesce(html, '')) top from pages)
select page_id, payload_bytes, payload_digest, case when page_id = top then 'response' else 'revisit' end as record_type, case when page_id <> top then top end as refers_to from p"""


def _found(rank: int, rule) -> str:
    """Spans of one rule: what is between the matches and the matches themselves, both in order, give the places."""
    p = quoted(rule.pattern)
    return f"""select doc_id, {rank} as rank, '{rule.kind}' as kind, cast(list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0) as bigint) s, length(m[i]) n, length(p[i]) own
  from (select doc_id, string_split_regex(text, {p}) g, regexp_extract_all(text, {p}) m, regexp_extract_all(text, {p}, {rule.group}) p, unnest(generate_series(1, len(regexp_extract_all(text, {p})))) i from documents where regexp_matches(text, {p})) where own >= {rule.at_least}"""


_KINDS = [r.kind for r in BASE_RULES]
_BASE = ", ".join(f"'{k}'" for k in _KINDS)
OP7 = (
    "with f as ("
    + " union all ".join(_found(k, r) for k, r in enumerate(RULES))
    + "), a as (select doc_id, "
    + ", ".join(f"count(*) filter (kind = '{k}') n_{k}" for k in _KINDS)
    + f", string_agg(concat_ws(':', kind, s, s + n), ',' order by s, rank) filter (kind in ({_BASE})) b, string_agg(concat_ws(':', kind, s, s + n), ',' order by s, rank) spans from f group by 1) select d.doc_id, "
    + ", ".join(f"coalesce(n_{k}, 0) as n_{k}" for k in _KINDS)
    + ", sha256(coalesce(b, '')) as base_sha256, coalesce(spans, '') as spans from documents d left join a using (doc_id)"
)

OP9 = f"""with w as (select doc_id, {WORDS} w from documents),
p as (select doc_id, i, md5(array_to_string(w[i:i + 34], ' ')) h from (select doc_id, w, unnest(generate_series(1, len(w) - 34)) i from w where len(w) >= 35)),
r as (select doc_id, i from p where h in (select h from p group by h having count(*) > 1)),
g as (select distinct doc_id, unnest(generate_series(i, i + 34)) i from r),
t as (select doc_id, unnest(w) x, generate_subscripts(w, 1) i from w),
k as (select t.doc_id, count(*) n, count(g.i) lost, string_agg(case when g.i is null then x end, ' ' order by t.i) kept from t left join g on g.doc_id = t.doc_id and g.i = t.i group by 1)
select d.doc_id, coalesce(n, 0) as n_words, coalesce(lost, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from documents d left join k using (doc_id)"""

OP10 = """with b as (select doc_id, hex(encode(coalesce(text, ''))) x from documents),
p as (select doc_id, i, md5(substr(x, 2 * i + 1, 200)) h from (select doc_id, x, unnest(generate_series(0, length(x) // 2 - 100)) i from b where length(x) >= 200)),
o as (select doc_id, i from (select doc_id, i, row_number() over (partition by h order by doc_id, i) r from p) where r > 1),
m as (select doc_id, i, max(i + 100) over (partition by doc_id order by i rows between unbounded preceding and 1 preceding) e from o),
s as (select doc_id, i, sum(case when e is null or i > e then 1 else 0 end) over (partition by doc_id order by i) k from m),
u as (select doc_id, k, min(i) a, max(i) + 100 z from s group by 1, 2),
q as (select doc_id, a, z, lag(z, 1, 0) over (partition by doc_id order by a) y from u),
c as (select q.doc_id, count(*) n_spans, sum(z - a) n_removed, string_agg(substr(x, cast(2 * y + 1 as bigint), cast(2 * (a - y) as bigint)), '' order by a) head, max(z) last from q join b on b.doc_id = q.doc_id group by 1)
select b.doc_id, length(x) // 2 as n_bytes, coalesce(cast(n_removed as bigint), 0) as n_removed, coalesce(n_spans, 0) as n_spans, sha256(unhex(coalesce(head || substr(x, 2 * last + 1), x))) as kept_sha256 from b left join c on c.doc_id = b.doc_id"""

_TERMS = "unnest(regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\\x00-\\x2F\\x3A-\\x40\\x5B-\\x60\\x7B-\\x7F]+'))"
OP11 = f"""with t as (select doc_id, w, count(*) tf from (select doc_id, {_TERMS} w from documents) group by 1, 2),
n as (select doc_id, sum(tf)::bigint n from t group by 1),
a as (select count(*) big_n, sum(n)::bigint big_l from n),
f as (select w, count(*) df from t group by 1),
i as (select item_id, w, count(*) c from (select item_id, {_TERMS} w from benchmark) group by 1, 2),
s as (select item_id, doc_id, sum(c * floor(1000 * ln((2 * big_n + 2) / (2 * df + 1)))::bigint * ((1000000000 * tf) // (1000 * tf + 12 * (75 + (25 * n * big_n) // big_l))))::bigint score
  from i join t using (w) join f using (w) join n using (doc_id) cross join a group by 1, 2)
select item_id, row_number() over (partition by item_id order by score desc, doc_id)::int as rank, doc_id, score from s where score > 0 qualify row_number() over (partition by item_id order by score desc, doc_id) <= 20"""

SQL = {
    "op1_near_dups": OP1,
    "op3_line_templates": OP3,
    "op3_recurring_lines": OP3_EXACT,
    "op4_warc": OP4,
    "op7_secret_scan": OP7,
    "op9_block_anchors": OP9,
    "op10_suffix_index": OP10,
    "op11_best_positions": OP11,
}
