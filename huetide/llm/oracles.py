"""DuckDB SQL for the rows of those queries that SQL can express."""

_LOWER = "translate({0}, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
_ALNUM = r"regexp_extract_all(" + _LOWER + r", '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
_SPACED = r"regexp_extract_all({0}, '[^\x20\x09-\x0D]+')"

DECONTAMINATION = rf"""
with d as (select doc_id, coalesce({_ALNUM.format("text")}, []) as w from documents),
b as (select cast(item_id as varchar) as item_id, {_ALNUM.format("text")} as w from benchmark where item_id is not null and text is not null),
items as (
    select distinct item_id, least(len(w), 10) as n, array_to_string(w[i : i + least(len(w), 10) - 1], ' ') as said
    from (select *, unnest(range(1, greatest(len(w) - 9, 1) + 1)) as i from b where len(w) > 0)
),
sizes as (select distinct n from items),
places as (select doc_id, n, i, array_to_string(w[i : i + n - 1], ' ') as said from (select *, unnest(range(1, len(w) - n + 2)) as i from d, sizes where len(w) >= n)),
found as (select doc_id, i, n, item_id from places join items using (n, said)),
hits as (select doc_id, count(distinct p) as n_hit from (select doc_id, unnest(range(i, i + n)) as p from (select distinct doc_id, i, n from found)) group by all),
named as (select doc_id, count(*) as n_items, string_agg(item_id, ',' order by item_id) as listed from (select distinct doc_id, item_id from found) group by all)
select d.doc_id, len(w) as n_words, coalesce(n_hit, 0) as n_hit, coalesce(n_items, 0) as n_items,
    sha256(coalesce(listed, '')) as items_sha256, coalesce(n_hit, 0) > 0 as contaminated
from d left join hits using (doc_id) left join named using (doc_id)
"""

REPEATS = rf"""
with d as (select doc_id, coalesce({_SPACED.format("text")}, []) as w from documents),
windows as (select doc_id, i, array_to_string(w[i : i + 19], ' ') as said from (select *, unnest(range(1, len(w) - 18)) as i from d where len(w) >= 20)),
ranked as (select doc_id, i, row_number() over (partition by said order by doc_id, i) as r from windows),
gone as (select distinct doc_id, unnest(range(i, i + 20)) as p from ranked where r > 1),
words as (select doc_id, unnest(range(1, len(w) + 1)) as p, unnest(w) as word from d),
stays as (select doc_id, count(*) as n, string_agg(word, ' ' order by p) as kept from words anti join gone using (doc_id, p) group by all)
select d.doc_id, len(w) as n_words, len(w) - coalesce(n, 0) as n_removed, sha256(coalesce(kept, '')) as kept_sha256 from d left join stays using (doc_id)
"""

SECRETS = r"""
with recursive d as (select doc_id, coalesce(text, '') as text from documents),
kinds(kind, k, pattern, least, part) as (values
    ('assign', 0, '(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?[A-Za-z0-9+/_.=-]+', 6, '[A-Za-z0-9+/_.=-]+$'),
    ('access', 1, 'AKIA[A-Z0-9]+', 20, '.*'),
    ('hex', 2, '[0-9a-f]+', 24, '.*')),
listed as (select doc_id, kind, k, least, part, pattern, text, regexp_extract_all(text, pattern) as found from d, kinds),
each as (select *, unnest(range(1, len(found) + 1)) as i from listed where len(found) > 0),
placed as (
    select doc_id, kind, k, least, found, text, 1 as i, cast(instr(text, found[1]) as bigint) as p from listed where len(found) > 0
    union all
    select doc_id, kind, k, least, found, text, i + 1, p + length(found[i]) + instr(substr(text, p + length(found[i])), found[i + 1]) - 1
    from placed where i < len(found)
),
kept as (
    select doc_id, kind, k, p - 1 as a, p - 1 + length(found[i]) as b from placed
    where case when kind = 'assign' then length(regexp_extract(found[i], '^(?i:password|passwd|secret|token|api_?key)["'']?\x20*[:=]\x20*["'']?([A-Za-z0-9+/_.=-]+)$', 1)) else length(found[i]) end >= least
)
select d.doc_id, count(*) filter (kind = 'assign') as n_assign, count(*) filter (kind = 'access') as n_access, count(*) filter (kind = 'hex') as n_hex,
    sha256(coalesce(string_agg(kind || ':' || a || ':' || b, ',' order by a, k), '')) as base_sha256
from d left join kept using (doc_id) group by d.doc_id
"""

COMPONENTS = rf"""
with recursive d as (select doc_id, coalesce({_SPACED.format(_LOWER.format("text"))}, []) as w from documents),
grams as (
    select distinct doc_id, array_to_string(w[i : i + 4], ' ') as said from (select *, unnest(range(1, greatest(len(w) - 4, 1) + 1)) as i from d where len(w) > 0)
),
sizes as (select doc_id, count(*) as n, md5(string_agg(said, chr(10) order by said)) as name from grams group by all),
stands as (select *, min(doc_id) over (partition by name) as one from sizes),
own as (select said, doc_id from grams semi join (select one as doc_id from stands) using (doc_id)),
common as (select a.doc_id as x, b.doc_id as y, count(*) as c from own a join own b on a.said = b.said and a.doc_id < b.doc_id group by all),
links as (select x, y from common join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
edges as (select x, y from links union all select y, x from links),
reach as (select x, x as y from edges union select r.x, b.y from reach r join edges b on r.y = b.x),
least as (select x as one, min(y) as component_id from reach group by all)
select d.doc_id, coalesce(s.n, 0) as n_shingles, coalesce(l.component_id, s.one, d.doc_id) as component_id
from d left join stands s using (doc_id) left join least l using (one)
"""

_PHRASES = {"cc-by": "cc by", "gpl": "general public license", "reserved": "all rights reserved"}
_PLACES = " union all ".join(
    f"select doc_id, '{label}' as label, i from each where w[i + 1 : i + {len(words.split())}] = {words.split()!r}" for label, words in _PHRASES.items()
)
LICENSES = rf"""
with d as (select doc_id, coalesce({_ALNUM.format("text")}, []) as w from documents),
each as (select doc_id, w, unnest(range(0, len(w))) as i from d),
places as ({_PLACES})
select d.doc_id, any_value(len(w)) as n_words, count(label) as n_base, min(i) as first_word, max(i) as last_word,
    coalesce(string_agg(distinct label, ',' order by label), '') as base_labels
from d left join places using (doc_id) group by d.doc_id
"""

#: CRC-32 by its table of 256 entries, which the first two queries make; the second text takes the bytes of one string.
_CRC_TABLE = """
table_steps(n, c, k) as (
    select i, i, 0 from (select unnest(range(0::bigint, 256)) as i)
    union all
    select n, case when c % 2 = 1 then xor(c >> 1, 3988292384) else c >> 1 end, k + 1 from table_steps where k < 8
),
crc_table as (select list(c order by n) as crc from table_steps where k = 8)
"""
_CRC = (
    "xor(coalesce(list_reduce(list_transform(regexp_extract_all(hex(encode({0})), '..'), lambda x: ('0x' || x)::bigint), "
    "lambda c, b: xor(c >> 8, crc[xor(c, b) % 256 + 1]), 4294967295::bigint), 4294967295), 4294967295)"
)

SHARDS = rf"""
with recursive {_CRC_TABLE},
d as (select doc_id, coalesce(text, '') as text from documents),
keyed as (
    select doc_id, strlen(text) + 8 as size, {_CRC.format("text")} as text_crc32,
        left(md5(text), 15) || lpad(lower(to_hex((doc_id::hugeint + 9223372036854775808)::ubigint)), 16, '0') as key
    from d, crc_table
),
levels(chars) as (values (3), (6), (9), (12), (15), (18), (21), (24), (27), (30), (31)),
bins as (select chars, left(key, chars) as bin, sum(size)::bigint as size from keyed, levels group by all),
edges as (
    select chars, (sum(size) over (partition by chars order by bin))::bigint as below from bins
    union all
    select chars, 0 from levels
),
wanted as (select k, total from (select sum(size)::bigint as total from keyed), (select unnest(range(1, 24)) as k)),
near as (
    select k, chars, below, abs(below * 24 - k * total) as miss, total from edges, wanted
    qualify row_number() over (partition by k, chars order by miss, below) = 1
),
cuts as (select k, below from near where miss * 1000 <= total or chars = 31 qualify row_number() over (partition by k order by chars) = 1),
placed as (select *, coalesce(sum(size) over (order by key rows between unbounded preceding and 1 preceding), 0) as before from keyed),
dealt as (select *, (select count(*) from cuts where below <= before)::int as shard from placed)
select doc_id, size, text_crc32, 'bytes' as law, shard, row_number() over (partition by shard order by key) - 1 as slot, null::int as grown_shard from dealt
"""

#: Level k names grams of 2**k words; neighbouring equal grams at a distance from 2**(k-1) to below 2**k lie in a stretch of that period.
_LEVELS = 15  # texts of up to 2**17 words
_NAMES = ",\n".join(
    f"g{k} as (select doc_id, i, dense_rank() over (order by x, y) as x from (select doc_id, i, x, lead(x, {2 ** (k - 1)}) over (partition by doc_id order by i) as y from g{k - 1}) where y is not null)"
    for k in range(1, _LEVELS + 1)
)
_PAIRS = "\nunion all ".join(
    f"select doc_id, i, q, {2**k} as gram from (select doc_id, i, lead(i) over (partition by doc_id, x order by i) - i as q from g{k}) where q >= {2 ** (k - 1)} and q < {2**k}"
    for k in range(1, _LEVELS + 1)
)
RUNS = rf"""
with recursive {_CRC_TABLE},
d as (select doc_id, coalesce({_SPACED.format("text")}, []) as w, {_CRC.format("doc_id::varchar")} as h from documents, crc_table),
g as (select *, h // 10 as g, len(w) as n from d),
ap as (select *, case when n > 0 then g % n end as a from g),
pp as (select *, 1 + (n - a) // (3 + g % 8) as p from ap),
planted as (
    select doc_id, case when h % 10 = 0 and n > 0 then list_transform(range(0, n), lambda i: w[case when i < a then i else a + (i - a) % p end + 1]) else w end as w from pp
),
words as (select doc_id, unnest(range(0, len(w))) as i, unnest(w) as word from planted),
g0 as (select doc_id, i, dense_rank() over (order by word) as x from words),
{_NAMES},
pairs as ({_PAIRS}),
grouped as (select *, i - row_number() over (partition by doc_id, gram, q order by i) as island from pairs),
stretches as (select doc_id, min(i) as start, max(i) - min(i) + q + gram as length, q as period from grouped group by doc_id, gram, q, island),
runs as (select * from stretches where length >= greatest(6, 4 * period)),
listed as (
    select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || period || chr(10), '' order by start, period) as said from runs group by doc_id
),
best as (
    select * from runs qualify row_number() over (partition by doc_id order by length::double / period desc, start, period) = 1
),
gone as (select distinct doc_id, unnest(range(start + period, start + length)) as i from runs),
stays as (select doc_id, string_agg(word, ' ' order by i) as said from words anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(n_runs, 0) as n_runs, start, length, period, 1000 * length // period as exponent_milli,
    sha256(coalesce(l.said, '')) as runs_sha256, sha256(coalesce(s.said, '')) as collapsed_sha256
from d left join listed l using (doc_id) left join best using (doc_id) left join stays s using (doc_id)
"""

TRIE = rf"""
with recursive {_CRC_TABLE},
turns as (
    select conv_id, {{'role': coalesce(role, ''), 'text': coalesce(text, '')}} as said,
        row_number() over (partition by conv_id order by turn nulls first, coalesce(role, ''), coalesce(text, '')) as i
    from conversations where conv_id is not null
),
own as (select conv_id, list(said order by i) as said from turns group by all),
heads as (select *, {_CRC.format("conv_id::varchar")} % 9 as h from own, crc_table),
rebuilt as (
    select a.conv_id, list_concat(coalesce(b.said, [])[1 : a.h], a.said[a.h + 1 : len(a.said)]) as said
    from heads a left join own b on b.conv_id = a.conv_id - a.conv_id % 5
),
prefixes as (select conv_id, depth, said[1:depth] as path, len(said) as n from (select *, unnest(range(0, len(said) + 1)) as depth from rebuilt)),
nodes as (
    select path, depth, min(conv_id) as conv_id, count(*) as n_convs, string_agg(conv_id::varchar, ',' order by conv_id) filter (n = depth) as ends
    from prefixes group by path, depth
),
children as (select path[1 : depth - 1] as path, count(*) as n_children from nodes where depth > 0 group by 1),
full_nodes as (
    select n.*, coalesce(n_children, 0) as n_children, (n_convs - 1) * case when depth > 0 then strlen(path[depth].text) else 0 end as saved
    from nodes n left join children using (path)
),
sums as (
    select path[1:k] as path, count(*) filter (n_children = 0) as n_leaves, sum(saved)::bigint as saved_tokens
    from (select *, unnest(range(0, depth + 1)) as k from full_nodes) group by 1
)
select n.conv_id, n.depth, p.conv_id as parent_conv_id, n.n_convs, n.n_children, n_leaves, saved_tokens, sha256(coalesce(n.ends, '')) as ends_sha256
from full_nodes n join sums using (path) left join nodes p on n.depth > 0 and p.path = n.path[1 : n.depth - 1]
"""

ORACLES = {
    "op2_suffix_decontamination": DECONTAMINATION,
    "op4_substring_doubling": REPEATS,
    "op8_jaccard_components": COMPONENTS,
    "op11_conversation_trie": TRIE,
    "op12_periodic_runs": RUNS,
    "op13_histogram_shards": SHARDS,
    "secrets_base_columns": SECRETS,
    "licenses_base_columns": LICENSES,
}
