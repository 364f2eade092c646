"""DuckDB SQL of the queries, written from the contracts."""

from __future__ import annotations

WORDS = r"regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')"

QUALITY = rf"""
with docs as (
  select row_number() over () as r, doc_id, source, coalesce(text, '') as text,
         {WORDS} as w
  from documents),
lines as (
  select r, count(*) as n_lines, count(distinct line) as different
  from (select r, unnest(string_split(text, chr(10))) as line from docs)
  where regexp_matches(line, '[^\x20\x09-\x0D]') group by r),
windows as (
  select r, i, array_to_string(w[i:i + 4], ' ') as five
  from (select r, w, unnest(range(1, len(w) - 3)) as i from docs where len(w) >= 5)),
twice as (
  select r, i from (select r, i, count(*) over (partition by r, five) as c from windows)
  where c >= 2),
covered as (
  select r, count(distinct i + k) as n from twice, range(0, 5) as t(k) group by r),
measured as (
  select docs.r, doc_id, source, len(w) as n_words,
         length(array_to_string(w, '')) as word_chars,
         length(regexp_replace(text, '[^#*$%&|<>]+', '', 'g')) as n_symbols,
         coalesce(n_lines, 0) as n_lines,
         coalesce(n_lines - different, 0) as n_dup_lines,
         coalesce(covered.n, 0) as n_repeat_words
  from docs left join lines on lines.r = docs.r left join covered on covered.r = docs.r),
rules as (
  select source as host, unnest(['few', 'repeats', 'symbols', 'lines', 'length']) as rule,
         unnest([n_words < 10, 100 * n_repeat_words > 20 * n_words,
                 10 * n_symbols > n_words, 10 * n_dup_lines > 3 * n_lines,
                 word_chars < 2 * n_words or word_chars > 15 * n_words]) as failed
  from measured where source is not null),
hosts as (
  select host, rule, count(*)::double as n, count(*) filter (failed)::double as f
  from rules group by host, rule),
spread as (
  select rule, count(*) as k, sum(n) as n, sum(f) / sum(n) as mean,
         sum(f * f / n) - sum(f) * sum(f) / sum(n) as spread,
         sum(n) - sum(n * n) / sum(n) as room
  from hosts group by rule),
prior as (
  select rule, mean, case
           when room <= 0 or spread <= (k - 1) * mean * (1 - mean) then 1e6
           else round(least(greatest(mean * (1 - mean) * room
                / (spread - (k - 1) * mean * (1 - mean)) - 1, 1.0), 1e6), 6) end as strength
  from spread),
bad as (
  select distinct host from hosts join prior using (rule)
  where (f + mean * strength) / (n + strength) > 0.5)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars,
       n_symbols::bigint as n_symbols, n_lines::bigint as n_lines,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       (n_words < 10 or 100 * n_repeat_words > 20 * n_words) as base_failed,
       not (n_words < 10 or 100 * n_repeat_words > 20 * n_words)
         and not exists (select 1 from bad where bad.host = measured.source) as kept
from measured
"""

EXACT_DEDUP = """
select doc_id, max(doc_id) over same as keep_id, count(*) over same as group_size,
       doc_id = max(doc_id) over same as kept,
       sha256(coalesce(text, '')) as text_sha256
from documents
window same as (partition by coalesce(text, ''))
"""

MIXING = rf"""
with docs as (
  select row_number() over () as r, doc_id, source, len({WORDS})::bigint as size,
         (('0x' || substr(md5(coalesce(doc_id::varchar, 'null|' || coalesce(text, ''))),
                          1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as draw
  from documents),
leaning as (
  select *, 1000 * size // (size + 200) as lean from docs),
sources as (
  select source, sum(size)::bigint as source_size, sum(lean * size)::bigint as leaning,
         [5, 2, 1][(row_number() over (order by source nulls last) - 1) % 3 + 1] as weight
  from leaning group by source),
levels as (
  select *, (sum(source_size) over () - coalesce(sum(3 * source_size) over before, 0))::double
            / (sum(weight) over () - coalesce(sum(weight) over before, 0))::double as level
  from sources
  window before as (order by 3.0 * source_size / weight, source nulls last
                    rows between unbounded preceding and 1 preceding)),
level as (
  select max(level) as level from levels where level * weight <= 3 * source_size),
targets as (
  select source, source_size, leaning,
         case when weight * level > 3 * source_size then (3 * source_size)::double
              else weight * level end as target
  from sources, level),
rates as (
  select *, case when source_size > 0 then target / source_size else 0 end as rate,
         case when source_size > 0 then leaning::double / source_size::double / 1000.0::double
              else 0 end as mean
  from targets),
parts as (
  select *, floor(rate)::bigint as copies, rate - floor(rate) as f,
         target - floor(rate) * source_size as filled
  from rates),
chances as (
  select r, doc_id, size, parts.source, source_size, target, copies, f, filled, draw,
         f + f * (1 - f) * (lean::double / 1000.0::double - mean) as chance
  from leaning join parts on parts.source is not distinct from leaning.source),
places as (
  select *, case when f > 0 then (draw / (1 - draw)) / (chance / (1 - chance)) end as odds
  from chances),
ordered as (
  select *, coalesce(sum(size) over (partition by source order by odds / (1 + odds), r
                     rows between unbounded preceding and 1 preceding), 0) as before
  from places)
select doc_id, size, source_size, target,
       (size * (copies + case when f > 0 and before + size / 2.0 <= filled
                              then 1 else 0 end))::bigint as taken
from ordered
"""

SUBSTRING_DEDUP = rf"""
with docs as (
  select row_number() over () as r, doc_id, {WORDS} as w from documents),
windows as (
  select r, doc_id, i, md5(array_to_string(w[i:i + 49], ' ')) as h
  from (select r, doc_id, w, unnest(range(1, len(w) - 48)) as i from docs
        where len(w) >= 50)),
firsts as (select h, min(doc_id) as first from windows group by h),
starts as (
  select r, i from windows join firsts using (h) where first < doc_id),
gone as (select distinct r, i + k as place from starts, range(0, 50) as t(k)),
words as (
  select r, unnest(w) as word, generate_subscripts(w, 1) as place from docs),
kept as (
  select r, string_agg(word, ' ' order by place) as text
  from words anti join gone using (r, place) group by r),
lost as (select r, count(*) as n from gone group by r)
select doc_id, len(w)::bigint as n_words, coalesce(lost.n, 0)::bigint as n_removed,
       sha256(coalesce(kept.text, '')) as kept_sha256
from docs left join kept on kept.r = docs.r left join lost on lost.r = docs.r
"""

COLLOCATIONS = r"""
with docs as (
  select coalesce(lang, 'und') as lang,
         translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ',
                   'abcdefghijklmnopqrstuvwxyz') as text
  from documents),
pieces as (
  select lang, unnest(regexp_split_to_array(text, '[.,;:!?\x0A-\x0D]')) as piece from docs),
words as (select lang, regexp_extract_all(piece, '[^\x20\x09]+') as w from pieces),
places as (
  select lang, w, unnest(range(1, len(w) + 1)) as i from words where len(w) > 0),
grams as materialized (
  select lang, s, array_to_string(w[i:i + s - 1], ' ') as p, count(*) as n
  from places, range(1, 4) as t(s) where i + s - 1 <= len(w) group by all),
totals as (select lang, sum(n) as total from grams where s = 1 group by lang),
often as materialized (select * from grams where n >= 10),
candidates as (
  select lang, s, p, n as a, string_split(p, ' ') as w from often where s >= 2),
parted as materialized (
  select lang, s, p, a, k, array_to_string(w[1:k], ' ') as lp,
         array_to_string(w[k + 1:s], ' ') as rp
  from (select *, unnest(range(1, s)) as k from candidates)),
cuts as (
  select c.*, l.n as l, r.n as r,
         (1000000::hugeint * c.a * c.a) // (l.n::hugeint * r.n) as score
  from parted c join often l on l.lang = c.lang and l.p = c.lp
       join often r on r.lang = c.lang and r.p = c.rp),
lowest as (
  select * from cuts qualify row_number() over (partition by lang, p order by score, k) = 1),
inner_parts as (
  select lang, array_to_string(w[i:i + 1], ' ') as p, max(a) as longer
  from candidates, range(1, 3) as t(i) where s = 3 group by all),
kept as (
  select lowest.* from lowest left join inner_parts using (lang, p)
  where coalesce(100 * longer < 50 * a, true)),
numbered as (
  select *, row_number() over (partition by lang order by score desc, a desc, p) as rank
  from kept)
select lang, rank, p as phrase, a::bigint as a, l::bigint as l, r::bigint as r,
       total::bigint as n, score::bigint as score
from numbered join totals using (lang) where rank <= 2000
"""

PREFIX_TRIE = """
with crc_table as materialized (
  select list(list_reduce([n, 0, 0, 0, 0, 0, 0, 0, 0],
                          lambda c, x: xor(c >> 1, 3988292384 * (c & 1))) order by n) as tab
  from range(256) as t(n)),
convs as materialized (
  select conv_id, count(*) as own,
         xor(list_reduce(list_prepend(4294967295::bigint, list_transform(
           string_split(conv_id::varchar, ''), lambda d: ascii(d)::bigint)),
           lambda c, b: xor(c >> 8, tab[xor(c & 255, b) + 1])), 4294967295) % 9 as h
  from conversations, crc_table where conv_id is not null group by conv_id, tab),
placed as materialized (
  select conv_id, coalesce(role, '') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first) as place
  from conversations where conv_id is not null),
taking as (
  select c.conv_id, c.h, c.conv_id - c.conv_id % 5 as base, least(c.h, coalesce(b.own, 0)) as taken
  from convs c left join convs b on b.conv_id = c.conv_id - c.conv_id % 5),
turns as materialized (
  select t.conv_id, place as depth, role, text
  from taking t join placed p on p.conv_id = t.base where place <= taken
  union all
  select t.conv_id, place - h + taken, role, text
  from taking t join placed p using (conv_id) where place > h),
paths as materialized (
  select conv_id, 0::bigint as depth, '' as path, 0::bigint as bytes from convs
  union all
  select conv_id, depth, string_agg(sha256(concat(length(role), role, text)), '') over (
           partition by conv_id order by depth), strlen(text)
  from turns),
lengths as (select conv_id, max(depth) as n from paths group by conv_id),
nodes as materialized (
  select depth, path, min(p.conv_id) as conv_id, count(*) as n_convs, max(bytes) as bytes,
         string_agg(p.conv_id::varchar, ',' order by p.conv_id)
           filter (depth = n) as ends
  from paths p join lengths using (conv_id) group by depth, path),
children as (
  select c.depth - 1 as depth, left(c.path, 64 * (c.depth::int - 1)) as path, count(*) as n
  from nodes c where c.depth > 0 group by all),
shaped as materialized (
  select nodes.*, coalesce(children.n, 0) as n_children
  from nodes left join children using (depth, path)),
sums as (
  select p.depth, p.path, count(*) filter (n_children = 0) as n_leaves,
         sum((s.n_convs - 1) * s.bytes) as saved
  from shaped s join paths p on p.conv_id = s.conv_id and p.depth <= s.depth
  group by all)
select s.conv_id, s.depth::bigint as depth, u.conv_id as parent_conv_id, s.n_convs,
       s.n_children::bigint as n_children, n_leaves::bigint as n_leaves,
       saved::bigint as saved_tokens, sha256(coalesce(s.ends, '')) as ends_sha256
from shaped s join sums using (depth, path)
     left join nodes u on u.depth = s.depth - 1 and u.path = left(s.path, 64 * u.depth::int)
"""

ORACLES = {
    "op12_prefix_trie": PREFIX_TRIE,
    "op11_collocations": COLLOCATIONS,
    "op7_substring_dedup": SUBSTRING_DEDUP,
    "op5_mixing": MIXING,
    "op6_exact_dedup": EXACT_DEDUP,
    "op10_quality": QUALITY,
}
