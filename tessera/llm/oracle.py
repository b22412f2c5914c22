"""DuckDB SQL for the queries that SQL can express."""

from __future__ import annotations

from .quality_rules import RULES, STOP_WORDS

_BLANK = r"[\x20\x09-\x0D]"
_STOP = ", ".join(f"'{w}'" for w in dict.fromkeys(STOP_WORDS))
_RULES = " ".join(
    f"case when coalesce({' or '.join(f'{r.metric} {sign} {bound}::double' for sign, bound in (('<', r.low), ('>', r.high)) if bound is not None)}, false) then '{r.name}' end,"
    for r in RULES
)

QUALITY = f"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select *, list_filter(string_split_regex(t, '{_BLANK}+'), lambda x: x <> '') words, list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) lines from d),
windows as (select doc_id, i, array_to_string(words[i:i + 4], ' ') s from (select doc_id, words, unnest(generate_series(1, len(words) - 4)) i from w where len(words) >= 5)),
often as (select doc_id, i from (select doc_id, i, count(*) over (partition by doc_id, s) c from windows) where c > 1),
covered as (select doc_id, count(distinct i + j) n from often, (select unnest([0, 1, 2, 3, 4]) j) group by 1),
c as (
  select doc_id, len(words) n_words, length(regexp_replace(t, '{_BLANK}', '', 'g')) word_chars, length(regexp_replace(t, '[^#*$%&|<>]', '', 'g')) n_symbols, len(lines) - len(list_distinct(lines)) n_dup_lines, coalesce(n, 0) n_repeat_words, len(lines) n_lines,
    len(list_filter(words, lambda x: lower(translate(x, '.,;:!?', '')) in ({_STOP}))) n_stop, length(regexp_replace(t, '[^\\p{{Lu}}]', '', 'g')) n_capitals
  from w left join covered using (doc_id)),
m as (
  select *, nullif(n_words, 0)::double nw, word_chars / nullif(n_words, 0)::double mean_word_chars, n_symbols / nullif(n_words, 0)::double symbol_ratio, n_stop / nullif(n_words, 0)::double stop_ratio, n_dup_lines / nullif(n_lines, 0)::double dup_line_ratio,
    n_repeat_words / nullif(n_words, 0)::double repeat_ratio, n_capitals / nullif(word_chars, 0)::double capital_ratio from c),
f as (select *, n_words < 10 or 100 * n_repeat_words > 20 * n_words base_failed, concat_ws(',', {_RULES.rstrip(',')}) failed_rules from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, not base_failed and failed_rules = '' kept, failed_rules from f
"""

_LOWER = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_WORDS = rf"regexp_extract_all({_LOWER}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"

CONTAMINATION = f"""
with items as (select item_id, words, least(13, len(words)) n from (select item_id, {_WORDS} words from benchmark where item_id is not null) where len(words) > 0),
targets as (select distinct item_id, n, array_to_string(words[i:i + n - 1], ' ') s from (select *, unnest(generate_series(1, len(words) - n + 1)) i from items)),
docs as (select doc_id, {_WORDS} words from documents),
windows as (select doc_id, n, i, array_to_string(words[i:i + n - 1], ' ') s from (select doc_id, words, n, unnest(generate_series(1, len(words) - n + 1)) i from docs, (select distinct n from targets) where len(words) >= n)),
found as (select doc_id, i, windows.n, item_id from windows join targets on windows.n = targets.n and windows.s = targets.s),
hit as (select doc_id, count(distinct p) n_hit from (select doc_id, unnest(generate_series(i, i + n - 1)) p from found) group by 1),
which as (select doc_id, count(distinct item_id) n_items, string_agg(distinct cast(item_id as varchar), ',' order by cast(item_id as varchar)) names from found group by 1)
select doc_id, len(words) n_words, coalesce(n_hit, 0) n_hit, coalesce(n_items, 0) n_items, sha256(coalesce(names, '')) items_sha256, coalesce(n_hit, 0) > 0 and 20 * coalesce(n_hit, 0) >= len(words) contaminated
from docs left join hit using (doc_id) left join which using (doc_id)
"""


def _level(name: str, j: int) -> str:
    """Level j of trees (tree, idx, cnt, h) as name_j+1, and each node's siblings to the left and right as name_s_j."""
    return f"""
{name}_{j + 1} as (select tree, idx // 8 idx, any_value((cnt + 7) // 8) cnt, case when any_value(cnt) > 1 then sha256(string_agg(h, '' order by idx)) else any_value(h) end h from {name}_{j} group by tree, idx // 8),
{name}_s_{j} as (select a.tree, a.idx, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx < a.idx), '') l, coalesce(string_agg(b.h, '' order by b.idx) filter (where b.idx > a.idx), '') r
  from {name}_{j} a join {name}_{j} b on a.tree = b.tree and a.idx // 8 = b.idx // 8 where a.cnt > 1 group by a.tree, a.idx)"""


def _fold(name: str, j: int, source: str, target: str, index: str) -> str:
    return f"""
{target} as (select f.* exclude (proof, fold), proof || coalesce(l || r, '') proof, case when l is null then fold else sha256(l || fold || r) end fold from {source} f left join {name}_s_{j} s on f.{name}_tree = s.tree and f.{index} // {8**j} = s.idx)"""


def _field(c: str) -> str:
    return f"coalesce(strlen({c}::varchar) || ':' || {c}::varchar, '-')"


#: Eight steps a byte of the check sum, the first of which takes the byte in.
_CRC32 = "xor(list_reduce(list_concat([4294967295], flatten(list_transform(string_split({x}, ''), lambda c: [ascii(c), 0, 0, 0, 0, 0, 0, 0]))), lambda a, b: xor(xor(a, b) >> 1, (xor(a, b) & 1) * 3988292384)), 4294967295)"
_LOWERED = "translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_LEAF = "sha256(" + " || ".join(map(_field, ("doc_id", "source", "lang", "n_chars"))) + " || {text})"
#: Up to 8 ** 7 rows a language and 8 ** 3 languages.
_DEPTH, _TOP = 7, 3

MANIFEST = (
    f"""
with d as (select doc_id, coalesce('1' || lang, '0') tree, {_LEAF.format(text=_field("text"))} h, {_LEAF.format(text=_field(_LOWERED))} low, coalesce({_CRC32.format(x="doc_id::varchar")} % 3 = 0, false) chosen from documents),
n_0 as (select tree, row_number() over (partition by tree order by doc_id nulls first, h) - 1 idx, count(*) over (partition by tree) cnt, h, doc_id, low, chosen from d),"""
    + ",".join(_level("n", j) for j in range(_DEPTH))
    + f""",
t_0 as (select '' tree, row_number() over (order by tree) - 1 idx, count(*) over () cnt, h, tree name from n_{_DEPTH}),"""
    + ",".join(_level("t", j) for j in range(_TOP))
    + f""",
f_0 as (select n.doc_id, n.h leaf, n.tree n_tree, n.idx n_idx, '' t_tree, t.idx t_idx, t.h subroot, '' proof, case when chosen then low else n.h end fold from n_0 n join t_0 t on n.tree = t.name),"""
    + ",".join(_fold("n", j, f"f_{j}", f"f_{j + 1}", "n_idx") for j in range(_DEPTH))
    + ","
    + ",".join(_fold("t", j, f"f_{_DEPTH + j}", f"f_{_DEPTH + j + 1}", "t_idx") for j in range(_TOP))
    + f"""
select doc_id, leaf, subroot, root, sha256(proof) proof_sha256, fold folded_root, fold = root verified from f_{_DEPTH + _TOP}, (select h root from t_{_TOP})
"""
)

DIVERGENCE = f"""
with d as (select row_number() over () id, coalesce(lang, '') lang, coalesce(source, '') source, regexp_extract_all({_LOWER}, '[^\\x00-\\x40\\x5B-\\x60\\x7B-\\x7F]+') words from documents),
t as (select id, lang, source, unnest(words) term from d),
k as (select lang, term, count(*) n from t group by lang, term having count(distinct id) >= 30),
c as (select t.lang, t.source, t.term, count(*) n from t join k on t.lang = k.lang and t.term = k.term group by all),
v as (select lang, count(*) terms, sum(n) total from k group by lang),
s as (select lang, source, sum(n) total from c group by lang, source),
g as (select x.lang, x.source, coalesce(s.total, 0) + 5 * v.terms whole, v.total + 5 * v.terms lang_whole from (select distinct lang, source from d) x left join s on x.lang = s.lang and x.source = s.source left join v on x.lang = v.lang),
p as (select g.lang, g.source, k.term, coalesce(c.n, 0) n, 1 + (1000000000::hugeint * (coalesce(c.n, 0) + 5)) // whole p, 1 + (1000000000::hugeint * (k.n + 5)) // lang_whole q
  from g join k on g.lang = k.lang left join c on c.lang = g.lang and c.source = g.source and c.term = k.term),
apart as (select a.lang, a.source, b.source item, sum(abs(a.p - b.p)) value from p a join p b on a.lang = b.lang and a.term = b.term and a.source <> b.source group by all),
r as (
  select a.lang, a.source, 'pair' part, b.source item, coalesce(value, 0)::bigint value from g a join g b on a.lang = b.lang and a.source <> b.source left join apart x on x.lang = a.lang and x.source = a.source and x.item = b.source
  union all select lang, source, 'term', term, (p - q)::bigint from p where n > 0 and p > q)
select * from (select *, cast(row_number() over (partition by lang, source, part order by value desc, item) as integer) rank from r) where part = 'pair' or rank <= 50
"""
