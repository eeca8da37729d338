"""SQL for the queries that SQL can express. Written for small tables: plain joins, no care for scale."""

from __future__ import annotations

from tidemark.llm import line_rules, mixing
from tidemark.llm.url_filter import RULES

_WORDS = r"regexp_extract_all({}, '[^\x20\x09-\x0D]+')"
_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

OP1 = f"""
with d as (select doc_id, {_WORDS.format("coalesce(text, '')")} w from documents),
win as (select doc_id, p, array_to_string(w[p:p + 12], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 11)) p from d where len(w) >= 13)),
first_ as (select k, min(doc_id) f from win group by k),
cov as (select distinct doc_id, p + s.s pos from win join first_ using (k) cross join (select unnest(range(0, 13)) s) s where f < doc_id),
word as (select doc_id, unnest(w) x, unnest(range(1, len(w) + 1)) pos from d),
kept as (select doc_id, string_agg(x, ' ' order by pos) t from word where (doc_id, pos) not in (select (doc_id, pos) from cov) group by 1),
gone as (select doc_id, count(*) n from cov group by 1)
select d.doc_id, cast(len(w) as bigint) n_words, coalesce(gone.n, 0) n_removed, sha256(coalesce(kept.t, '')) kept_sha256
from d left join kept using (doc_id) left join gone using (doc_id)
"""

#: Sets of units: (u, w) -> (u, k), 5-word shingles, of fewer words the whole.
_SETS = "sets as (select distinct u, k from (select u, array_to_string(w[p:p + 4], ' ') k from (select u, w, unnest(range(1, len(w) - 3)) p from units where len(w) >= 5) union all select u, array_to_string(w, ' ') from units where len(w) between 1 and 4))"
_PAIRS = "n as (select u, count(*) n from sets group by 1), pairs as (select a.u a, b.u b, count(*) c from sets a join sets b on a.k = b.k and a.u < b.u group by 1, 2), linked as (select p.a, p.b from pairs p join n x on x.u = p.a join n y on y.u = p.b where 100 * c >= 75 * (x.n + y.n - c))"

OP6 = f"""
with recursive units as (select doc_id u, {_WORDS.format(f"translate(coalesce(text, ''), '{_UP}', '{_LOW}')")} w from documents),
{_SETS}, {_PAIRS},
both_ as (select a, b from linked union select b, a from linked),
reach(a, b) as (select a, a from both_ union select r.a, e.b from reach r join both_ e on e.a = r.b),
least as (select a, min(b) c from reach group by 1),
same as (select u, min(u) over (partition by h) c from (select u, md5(string_agg(k, '|' order by k)) h from sets group by 1)),
deg as (select a, count(*) c from both_ group by 1)
select units.u doc_id, coalesce(n.n, 0) n_shingles, coalesce(same.c, units.u) class_id, coalesce(least.c, units.u) component_id, coalesce(deg.c, 0) n_links
from units left join n using (u) left join least on least.a = units.u left join same on same.u = units.u left join deg on deg.a = units.u
"""

OP3 = f"""
with line as (select doc_id, text is null none, unnest(string_split(coalesce(text, ''), chr(10))) l, unnest(range(len(string_split(coalesce(text, ''), chr(10))))) i from documents),
units as (select row_number() over (order by doc_id, i) u, doc_id, i, {_WORDS.format(f"translate(l, '{_UP}', '{_LOW}')")} w from line),
{_SETS}, {_PAIRS},
gone as (select distinct b u from linked),
kept as (select doc_id, count(*) filter (len(w) > 0) n_lines, count(*) filter (g.u is not null) n_removed, string_agg(case when g.u is null then l end, chr(10) order by i) t
  from units join line using (doc_id, i) left join gone g using (u) group by 1)
select doc_id, n_lines, n_removed, sha256(coalesce(t, '')) kept_sha256 from kept
"""


def _node(url: str) -> str:
    """As url_filter.node_of."""
    head = f"translate(regexp_extract({url}, '(?s)^(.*?://[^/?#]*)', 1), '{_UP}', '{_LOW}')"
    head = f"regexp_replace(regexp_replace({head}, '^(http://.*):(?:80)?$', '{chr(92)}1'), '^(https://.*):(?:443)?$', '{chr(92)}1')"
    tail = f"regexp_extract({url}, '(?s)^.*?://[^/?#]*([^#]*)', 1)"
    return f"case when regexp_matches({url}, '(?s)^.*?://[^/?#]') then {head} || case when starts_with({tail}, '/') then {tail} else '/' || {tail} end end"


def _host(url: str) -> str:
    return f"translate(regexp_extract(coalesce({url}, ''), '(?s)^.*?://([^/?#]*)', 1), '{_UP}', '{_LOW}')"


def _op5() -> str:
    order = sorted(range(len(RULES)), key=lambda i: (-len(RULES[i][0] + RULES[i][1]), RULES[i]))
    fits = lambda h, p: f"((host = '{h}' or ends_with(host, '.{h}')) and starts_with(path, '{p}'))"
    case = lambda k: "case " + " ".join(f"when {fits(*RULES[i][:2])} then '{k(RULES[i])}'" for i in order) + " end"
    link = lambda tag, has, to: rf"""regexp_extract(list_filter(regexp_extract_all(html, '(?is)<{tag}\b[^>]*'), lambda x: regexp_matches(x, '(?is)\b{has}\b') and regexp_matches(x, '(?is)\b{to}\s*=\s*["'']?[^"''\s>]'))[1], '(?is)\b{to}\s*=\s*["'']?([^"''\s>]+)', 1)"""
    scheme, folder = "regexp_extract(url, '^([A-Za-z][A-Za-z0-9+.-]*)://', 1)", "regexp_replace(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '[^/]*$', '')"
    root = f"{scheme} || '://' || {_host('url')}"
    return rf"""
with recursive p as (select page_id, {_host("url")} host, regexp_extract(coalesce(url, ''), '(?s)^.*?://[^/?#]*([^?#]*)', 1) path, {_node("url")} node from pages),
r as (select page_id, host, path, {case(lambda x: x[0] + x[1])} as rule, {case(lambda x: x[2])} own, node from p),
l as (select url, unnest([{link("link", "rel" + chr(92) + "s*=" + chr(92) + "s*[" + chr(34) + chr(39) * 2 + "]?canonical", "href")}, {link("meta", "http-equiv" + chr(92) + "s*=" + chr(92) + "s*[" + chr(34) + chr(39) * 2 + "]?refresh", "url")}]) t from pages where url is not null),
ab as (select url, case when regexp_matches(t, '^[A-Za-z][A-Za-z0-9+.-]*://') then t when starts_with(t, '//') then {scheme} || ':' || t when starts_with(t, '/') then {root} || t
  else {root} || case when {folder} = '' then '/' else {folder} end || t end a from l where t <> ''),
ed as (select {_node("url")} u, {_node("a")} v from ab),
both_ as (select u, v from ed where u <> v union select v, u from ed where u <> v),
reach(a, b) as (select u, u from both_ union select r.a, e.v from reach r join both_ e on e.u = r.b),
comp as (select a node, min(b) c from reach group by 1),
n as (select coalesce(c, r.node) c from r left join comp using (node) where r.node is not null group by 1 having bool_or(coalesce(own = 'block', false)) and not bool_or(coalesce(own = 'allow', false)))
select page_id, host, path, rule, coalesce(own, case when n.c is not null then 'block' end, 'allow') verdict, own is null and n.c is not null alias
from r left join comp using (node) left join n on n.c = coalesce(comp.c, r.node)
"""


def _op7() -> str:
    phrases = " or ".join(f"contains(plain, '{p}')" for p in line_rules.BOILERPLATE)
    marks = " + ".join(f"(length(l) - length(replace(l, '{s}', '')))" for s in line_rules.SEPARATORS)
    return rf"""
with d as (select doc_id, coalesce(text, '') text, {_WORDS.format("coalesce(text, '')")} w from documents),
five as (select doc_id, p, array_to_string(w[p:p + 4], ' ') k from (select doc_id, w, unnest(range(1, len(w) - 3)) p from d where len(w) >= 5)),
twice as (select doc_id, p from five join (select doc_id, k from five group by all having count(*) > 1) using (doc_id, k)),
rep as (select doc_id, count(distinct p + s.s) n from twice cross join (select unnest(range(5)) s) s group by 1),
line as (select doc_id, l, lower(regexp_replace(l, '[ \t\n\x0B\f\r]+', ' ', 'g')) plain from (select doc_id, unnest(string_split(text, chr(10))) l from d) where regexp_matches(l, '[^\x20\x09-\x0D]')),
judged as (select doc_id, l, not regexp_matches(l, '[.!?:;…。！？]["''”’»)\]]*[\x20\x09-\x0D]*$')
  or length(regexp_replace(l, '[^#*$%&|<>]', '', 'g')) > 0.1 * length(l)
  or len(regexp_extract_all(l, '(?:[!?*]{{2,}}|[A-Z]{{4,}}!)(?:[\x20\x09-\x0D]|$)')) > 0.5 * len({_WORDS.format("l")})
  or (length(l) - length(replace(l, '!!', ''))) / 2 + (length(l) - length(replace(l, '??', ''))) / 2 > 0.5 * len(string_split(trim(l), ' '))
  or {marks} >= 3 or {phrases} fails from line),
lines as (select doc_id, count(*) n, count(distinct l) nd, count(*) filter (fails) nf, sum(length(l)) c, sum(case when fails then 0 else length(l) end) g from judged group by 1),
a as (select d.doc_id, cast(len(w) as bigint) n_words, cast(length(array_to_string(w, '')) as bigint) word_chars, cast(length(regexp_replace(text, '[^#*$%&|<>]', '', 'g')) as bigint) n_symbols,
  coalesce(lines.n - nd, 0) n_dup_lines, coalesce(rep.n, 0) n_repeat_words, coalesce(lines.n, 0) n_lines, coalesce(nf, 0) n_failed_lines, coalesce(g >= 0.5 * c, true) stays
  from d left join rep using (doc_id) left join (select doc_id, n, nd, nf, c, g from lines) lines using (doc_id))
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed,
  not (n_words < 10 or 100 * n_repeat_words > 20 * n_words) and stays kept, n_lines, n_failed_lines from a
"""


ORACLE_SQL = {
    "op1_substring_dedup": OP1, "op3_line_dedup": OP3, "op5_url_filter": _op5(), "op6_jaccard_join": OP6, "op7_quality_rules": _op7(), "op10_mixing": mixing.OP10_SQL,
}
