"""DuckDB SQL for the queries of this subpackage that SQL can express."""

from __future__ import annotations

from mapweave.llm import quality as Q
from mapweave.llm.urls import LISTED, MIRROR_PATHS, MIRRORS, NAMES, RULES, TOPS

_WORDS = r"list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda x: x <> '')"

DECONTAMINATE = f"""
with items as (select item_id, {_WORDS} as ws from benchmark),
texts as (select doc_id, {_WORDS} as ws from documents),
lengths as (select distinct least(len(ws), 5) as k from items where len(ws) > 0),
b as (select distinct item_id, k, array_to_string(ws[i:i + k - 1], ' ') as s from (select item_id, ws, least(len(ws), 5) as k, unnest(range(1, len(ws) - least(len(ws), 5) + 2)) as i from items where len(ws) > 0)),
d as (select distinct doc_id, k, array_to_string(ws[i:i + k - 1], ' ') as s from (select doc_id, ws, k, unnest(range(1, len(ws) - k + 2)) as i from texts, lengths)),
sizes as (select item_id, count(*) as n from b group by item_id)
select doc_id, item_id, count(*) as n_shared, any_value(n) as n_shingles from d join b using (k, s) join sizes using (item_id) group by doc_id, item_id having count(*) * 100 >= 80 * any_value(n)"""

SUBSTRINGS = f"""
with texts as (select doc_id, {_WORDS} as ws from documents),
words as (select doc_id, unnest(ws) as word, generate_subscripts(ws, 1) as j, ws from texts),
windows as (select doc_id, j, case when j + 12 <= len(ws) then array_to_string(ws[j:j + 12], ' ') end as k, word from words),
first as (select k, min(doc_id) as low from windows where k is not null group by k),
marked as (select doc_id, j, word, max(case when low < doc_id then 1 else 0 end) over (partition by doc_id order by j rows between 12 preceding and current row) as gone from windows left join first using (k)),
kept as (select doc_id, sum(gone) as n_removed, string_agg(word, ' ' order by j) filter (gone = 0) as kept from marked group by doc_id)
select doc_id, len(ws)::bigint as n_words, coalesce(n_removed, 0)::bigint as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from texts left join kept using (doc_id)"""

_FITS = [(what, host + path, f"((host = '{host}' or ends_with(host, '.{host}')) and starts_with(path, '{path}'))") for what, host, path in sorted(RULES, key=lambda r: -len(r[1] + r[2]))]
_SITES = ", ".join(f"'{x.split('//')[1].rstrip('/')}'" for x in LISTED)
_PATHS = ", ".join(f"'{x}'" for x in MIRROR_PATHS)
URLS = f"""
with mirrors as (select name || '-' || k || '.example.' || top || '/' || [{_PATHS}][1 + k % {len(MIRROR_PATHS)}] || '/' || k || '/' as listed
  from (select unnest([{", ".join(f"'{x}'" for x in NAMES)}]) as name), (select unnest([{", ".join(f"'{x}'" for x in TOPS)}]) as top), (select unnest(range({MIRRORS})) as k)),
split as (select page_id, url, case when instr(url, '://') > 0 then substr(url, instr(url, '://') + 3) else '' end as rest from pages),
hosts as (select page_id, rest, regexp_extract(rest, '^[^/?#]*') as raw from split),
parts as (select page_id, translate(raw, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') as host, regexp_extract(substr(rest, len(raw) + 1), '^[^?#]*') as path from hosts)
select page_id, host, path, case {" ".join(f"when {fits} then '{rule}'" for _, rule, fits in _FITS)} end as rule,
  case {" ".join(f"when {fits} then '{what}'" for what, _, fits in _FITS)} when len(list_filter([{_SITES}], lambda s: host = s or ends_with(host, '.' || s))) > 0
  or regexp_replace(host, '^www[.]', '') || regexp_replace(path, '/+$', '') || '/' in (select listed from mirrors) then 'block' else 'allow' end as verdict from parts"""

JACCARD = f"""
with recursive texts as (select doc_id, {_WORDS} as ws from documents),
s as (select distinct doc_id, k from (
  select doc_id, array_to_string(ws[i:i + 4], ' ') as k from (select doc_id, ws, unnest(range(1, len(ws) - 3)) as i from texts)
  union all select doc_id, array_to_string(ws, ' ') from texts where len(ws) between 1 and 4)),
sizes as (select doc_id, count(*) as n from s group by doc_id),
links as (select a.doc_id as a, b.doc_id as b from s a join s b on a.k = b.k and a.doc_id <> b.doc_id join sizes x on x.doc_id = a.doc_id join sizes y on y.doc_id = b.doc_id
  group by a.doc_id, b.doc_id having count(*) * 100 >= 80 * (any_value(x.n) + any_value(y.n) - count(*))),
reach as (select doc_id as a, doc_id as b from documents union select reach.a, links.b from reach join links on reach.b = links.a),
class as (select a as doc_id, min(b) as class_id from reach group by a)
select doc_id, class_id, (select count(*) from links where links.a = class.doc_id) as n_links from class"""

_SHARE = "case when {whole} > 0 then 1000 * {part} // {whole} else 0 end"
_SHARES = {"symbols": ("n_symbols", "word_chars"), "repeats": ("n_repeat_words", "n_words"), "dup_lines": ("n_dup_lines", "n_lines")}
_BAR = "((v >> greatest(len(bin(v)) - 6, 0)) << greatest(len(bin(v)) - 6, 0))"
_FENCES = " ".join(f"when '{k}' then {v}" for k, v in Q.FENCED.items())


def _quantile(percent: int) -> str:
    return f"min(bar) filter (100 * seen >= {percent} * docs)"


QUALITY = f"""
with texts as (select doc_id, lang, source, coalesce(text, '') as text, {_WORDS} as ws from documents),
words as (select doc_id, unnest(range(1, len(ws) + 1)) as j, ws from texts),
windows as (select doc_id, j, case when j + 2 <= len(ws) then array_to_string(ws[j:j + 2], ' ') end as k from words),
counted as (select doc_id, j, case when k is not null and count(*) over (partition by doc_id, k) > 1 then 1 else 0 end as twice from windows),
covered as (select doc_id, max(twice) over (partition by doc_id order by j rows between 2 preceding and current row) as c from counted),
repeats as (select doc_id, sum(c)::bigint as n from covered group by doc_id),
lines as (select doc_id, list_filter(string_split(text, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) as ls from texts),
stats as (select doc_id, lang, source, len(ws)::bigint as n_words, len(array_to_string(ws, ''))::bigint as word_chars, (len(text) - len(translate(text, '{Q.SYMBOLS}', '')))::bigint as n_symbols,
  (len(ls) - len(list_distinct(ls)))::bigint as n_dup_lines, coalesce(n, 0)::bigint as n_repeat_words, len(ls)::bigint as n_lines from texts join lines using (doc_id) left join repeats using (doc_id)),
vals as (select lang, source, stat, v, {_BAR} as bar from ({" union all ".join(f"select lang, source, '{k}' as stat, {_SHARE.format(part=p, whole=w)} as v from stats" for k, (p, w) in _SHARES.items())})),
levels as (select 2 as level, lang, source, stat, bar from vals union all select 1, lang, null, stat, bar from vals union all select 0, null, null, stat, bar from vals),
bars as (select level, lang, source, stat, bar, count(*) as n from levels group by all),
sums as (select *, sum(n) over (partition by level, lang, source, stat order by bar) as seen, sum(n) over (partition by level, lang, source, stat) as docs from bars),
fences as (select level, lang, source, stat, any_value(docs) as docs, {_quantile(75)} + {Q.SPREAD} * greatest({_quantile(75)} - {_quantile(25)}, case stat {_FENCES} end) as fence from sums group by level, lang, source, stat),
judged as (select stats.*, {", ".join(f"{_SHARE.format(part=p, whole=w)} <= case when own_{k}.docs >= {Q.LEAST_DOCS} then own_{k}.fence when lang_{k}.docs >= {Q.LEAST_DOCS} then lang_{k}.fence else all_{k}.fence end as ok_{k}" for k, (p, w) in _SHARES.items())}
  from stats {" ".join(f"left join fences own_{k} on own_{k}.level = 2 and own_{k}.stat = '{k}' and own_{k}.lang is not distinct from stats.lang and own_{k}.source is not distinct from stats.source left join fences lang_{k} on lang_{k}.level = 1 and lang_{k}.stat = '{k}' and lang_{k}.lang is not distinct from stats.lang left join fences all_{k} on all_{k}.level = 0 and all_{k}.stat = '{k}'" for k in _SHARES)})
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, n_lines, n_words < {Q.LEAST_WORDS} or 100 * n_repeat_words > {Q.REPEATED_PERCENT} * n_words as base_failed,
  not (n_words < {Q.LEAST_WORDS} or 100 * n_repeat_words > {Q.REPEATED_PERCENT} * n_words) and ok_symbols and ok_repeats and ok_dup_lines as kept from judged"""
