"""DuckDB SQL of the queries that SQL can express."""

WORD = r"[^\x20\x09-\x0D]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

# All token combinations of the labelled URLs are counted outright; a URL meets the rules by its own combinations.
OP1 = rf"""
with parts as (
  select page_id, url, translate(coalesce(regexp_extract(url, '(?s)^.*?://([^/?#]*)', 1), ''), '{UPPER}', '{LOWER}') as host,
         coalesce(regexp_extract(url, '(?s)^.*?://[^/?#]*([^?#]*)', 1), '') as path,
         coalesce(regexp_extract(url, '(?s)^[^?#]*\?([^#]*)', 1), '') as query
  from pages),
tokened as (
  select *, list_sort(list_distinct(
    ['host=' || x for x in string_split(replace(host, '&', '%26'), '.') if x <> '']
    || ['path=' || x for x in string_split(replace(regexp_replace(path, '[0-9]+', '#', 'g'), '&', '%26'), '/') if x <> '']
    || ['query=' || split_part(x, '=', 1) for x in string_split(query, '&') if x <> ''])) as tokens
  from parts),
lab as (select doc_id, min(quality) as q from labels where quality is not null and doc_id is not null group by doc_id),
known as (
  select t.tokens, case when l.q = 0 then 'block' else 'allow' end as label
  from tokened t join lab l on l.doc_id = try_cast(nullif(regexp_extract(t.path, '/([0-9]{{1,18}})', 1), '') as bigint)
  where t.url is not null),
n as (select count(*) as n from known),
base as (select label, count(*) as labelled from known group by label),
combos as (
  select label, array_to_string([tokens[i] for i in range(1, len(tokens) + 1) if (m >> (i - 1)) & 1 = 1], '&') as name
  from known, range(1, (1 << len(tokens))::bigint) r(m)),
counted as (select name, count(*) as c, count(*) filter (label = 'allow') as allow, count(*) filter (label = 'block') as block
            from combos group by name),
sides as (select name, c, 'allow' as verdict, allow as k from counted union all select name, c, 'block', block from counted),
rules as (
  select name, verdict, k::double / c as confidence, k::double / n.n as support
  from sides join base b on b.label = verdict, n
  where k >= ceil(0.005::double * n.n) and k > 0 and k::double / c >= 0.6::double
    and (k::double / c) / (b.labelled::double / n.n) >= 1.1::double),
urls as (select distinct url, tokens from tokened where url is not null),
hits as (
  select u.url, r.* from (
    select url, array_to_string([tokens[i] for i in range(1, len(tokens) + 1) if (m >> (i - 1)) & 1 = 1], '&') as name
    from urls, range(1, (1 << len(tokens))::bigint) q(m)) u join rules r using (name)),
best as (select * from (select *, row_number() over (partition by url order by confidence desc, support desc, name, verdict) as rn
                        from hits) h where rn = 1),
listed(verdict, rule, rhost, rpath) as (values
  ('allow', 'com/', 'com', '/'), ('block', 'example.com/en/', 'example.com', '/en/'),
  ('allow', 'www.example.com/en/', 'www.example.com', '/en/'), ('block', 'net/es/', 'net', '/es/'), ('block', 'net/fr/', 'net', '/fr/')),
fit as (
  select page_id, url, host, path, l.verdict, l.rule from tokened t
  left join listed l on (t.host = l.rhost or ends_with(t.host, '.' || l.rhost)) and starts_with(t.path, l.rpath)),
one as (select * from (select *, row_number() over (partition by page_id order by length(rule) desc nulls last) as rn from fit) f where rn = 1)
select o.page_id, o.host, o.path, o.rule, coalesce(o.verdict, b.verdict, 'allow') as verdict, b.name as mined_rule, b.confidence
from one o left join best b on b.url = o.url
"""

# Exact: all pairs that share a shingle, then the transitive closure.
OP4 = rf"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(text, '{UPPER}', '{LOWER}'), '{WORD}') as w from documents),
sets as (
  select doc_id, case when coalesce(len(w), 0) = 0 then [] when len(w) < 5 then [array_to_string(w, ' ')]
                      else list_distinct([array_to_string(w[i:i + 4], ' ') for i in range(1, len(w) - 3)]) end as s
  from words),
long as (select doc_id, unnest(s) as h from sets),
sizes as (select doc_id, len(s) as n from sets),
pairs as (select a.doc_id as x, b.doc_id as y, count(*) as c from long a join long b on a.h = b.h and a.doc_id < b.doc_id group by 1, 2),
links as (select x, y from pairs join sizes p on p.doc_id = x join sizes q on q.doc_id = y where 100 * c >= 75 * (p.n + q.n - c)),
sym as (select x, y from links union all select y, x from links),
reach(x, y) as (select x, y from sym union select r.x, s.y from reach r join sym s on s.x = r.y),
least_of as (select x as doc_id, min(y) as m from reach group by x)
select s.doc_id, s.n::bigint as n_shingles, least(s.doc_id, coalesce(l.m, s.doc_id)) as component_id,
       s.doc_id = least(s.doc_id, coalesce(l.m, s.doc_id)) as kept
from sizes s left join least_of l using (doc_id)
"""

OP5 = """
with p as (select page_id, coalesce(html, '') as html, octet_length(encode(coalesce(html, ''))) as n from pages),
most as (select html, max(page_id) as m from p where n >= 1000 group by html)
select p.page_id, p.n::bigint as payload_bytes, sha1(p.html) as payload_digest,
       case when m is null or m = p.page_id then 'response' else 'revisit' end as record_type,
       case when m is null or m = p.page_id then null else m end as refers_to
from p left join most on p.n >= 1000 and most.html = p.html
"""

OP10 = rf"""
with d as (select doc_id, source, coalesce(len(regexp_extract_all(text, '{WORD}')), 0)::bigint as size from documents),
per as (select source, sum(size)::bigint as source_size, sum(size)::double / count(*) as mean from d group by source),
tilted as (select d.*, per.mean, per.source_size as words,
                  case when per.source_size > 0 then d.size / (d.size + per.mean) else 0.0::double end as h
           from d join per on per.source is not distinct from d.source),
centres as (select source, case when words > 0 then round(sum(size * h) / words, 9) else 0.0::double end as centre from tilted group by source, words),
placed as (
  select *, 2.0::double * source_size as most,
         list_extract([3.0::double, 1.0::double, 2.0::double], (row_number() over (order by source is null, encode(source)) - 1) % 3 + 1) as weight
  from per),
ordered as (
  select *, row_number() over (order by most / weight, source is null, source) as rn,
         sum(most) over (order by most / weight, source is null, source) - most as fixed,
         sum(weight) over () - (sum(weight) over (order by most / weight, source is null, source) - weight) as open_weight,
         1.5::double * sum(source_size) over () as total
  from placed),
-- the level with the sources before this one capped; the first that is not above its cap ends the sharing
levels as (select *, (total - fixed) / open_weight as level from ordered),
level as (select coalesce(arg_min(level, rn) filter (most > level * weight), arg_max(level, rn)) as level from levels),
tgt as (select source, source_size, least(most, level.level * weight) as target from placed, level),
split as (
  select *, case when source_size > 0 then target / source_size else 0.0 end as copies from tgt),
need as (select *, floor(copies) as whole, copies - floor(copies) as f, target - floor(copies) * source_size as need from split),
drawn as (
  select d.doc_id, d.source, d.size, n.source_size, n.target, n.whole, n.need,
         (('0x' || substr(md5('17:' || coalesce(d.doc_id::varchar, 'null') || ':' || d.size), 1, 13))::bigint + 0.5::double) / 4503599627370496.0::double as u,
         case when n.f > 0 then n.f + least(n.f, 1 - n.f) * (d.h - c.centre) else 0.5::double end as p
  from tilted d join need n on n.source is not distinct from d.source join centres c on c.source is not distinct from d.source),
ranked as (select *, u * (1 - p) / (u * (1 - p) + p * (1 - u)) as v from drawn),
run as (
  select *, coalesce(sum(size) over (partition by source order by v, doc_id, size rows between unbounded preceding and 1 preceding), 0) as before
  from ranked)
select doc_id, size, source_size, target, ((whole + case when before + size / 2.0 <= need then 1 else 0 end) * size)::bigint as taken
from run
"""

# CRC-32 (reflected, 0xEDB88320) of the ASCII text x, bit by bit.
_CRC = """xor(4294967295::bigint, list_reduce([4294967295::bigint] || [ascii(ch)::bigint for ch in string_split({x}, '')],
  lambda c, b: list_reduce([xor(c, b)] || [0::bigint for z in range(8)],
                           lambda v, z: case when v & 1 = 1 then xor(v >> 1, 3988292384::bigint) else v >> 1 end)))"""

# The damage, then faults and counts; the cheapest edits from the last row to the first: v holds for each state of
# (s?(ua)+)? (nothing yet, after s, after u, after a) the cost, the audit and the rows left from here on.
OP12 = rf"""
with recursive given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         {_CRC.format(x="(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '))")} % 20 as fault
  from conversations),
damaged as (
  select conv_id, turn, case when fault = 4 then 'user' else role end as role,
         case when fault = 1 then '' when fault = 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text,
         unnest(case when fault = 3 then [0, 1] else [0] end) as copy
  from given where fault <> 0),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, md5(text), copy) as i,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as again,
         regexp_extract_all(text, '{WORD}') as w
  from damaged),
marked as (
  select *, case when len(w) = 0 then 'blank' when again > 1 then 'duplicate'
                 when right(w[-1], 1) not in ('.', '!', '?') then 'truncated' else 'ok' end as fault,
         left(lag(role) over (partition by conv_id order by i), 1) || left(role, 1) as pair
  from placed),
counts as (
  select conv_id, count(*) as n, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps,
         count(*) filter (fault = 'blank') as blank, count(*) filter (fault = 'duplicate') as duplicate,
         count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (i > 1 and coalesce(pair, '') not in ('su', 'ua', 'au')) as illegal
  from marked group by conv_id),
fold(conv_id, i, v) as (
  select conv_id, n + 1, [{{'c': 0::bigint, 'a': '', 't': []::varchar[]}}, {{'c': 6::bigint, 'a': 'II', 't': ['user:', 'assistant:']}},
                          {{'c': 3::bigint, 'a': 'I', 't': ['assistant:']}}, {{'c': 0::bigint, 'a': '', 't': []::varchar[]}}]
  from counts
  union all
  select conv_id, i, [list_min([o[1], {{'c': u.c + 3, 'a': 'I' || u.a, 't': ['user:'] || u.t}}]),
                      list_min([o[2], {{'c': u.c + 3, 'a': 'I' || u.a, 't': ['user:'] || u.t}}]), u,
                      list_min([o[4], {{'c': u.c + 3, 'a': 'I' || u.a, 't': ['user:'] || u.t}}])]
  from (
    select conv_id, i, o, list_min([o[3], {{'c': o[4].c + 3, 'a': 'I' || o[4].a, 't': ['assistant:'] || o[4].t}}]) as u
    from (
      select f.conv_id, m.i,
             [list_min([{{'c': v[p].c + 4, 'a': 'D' || v[p].a, 't': v[p].t}},
                        case when m.fault in ('ok', 'truncated') and left(m.role, 1) = 's' and p = 1
                             then {{'c': v[2].c + m.more, 'a': 'K' || v[2].a, 't': [m.line] || v[2].t}} end,
                        case when m.fault in ('ok', 'truncated') and left(m.role, 1) = (case when p = 3 then 'a' else 'u' end)
                             then {{'c': v[q].c + m.more, 'a': 'K' || v[q].a, 't': [m.line] || v[q].t}} end,
                        case when m.fault in ('ok', 'truncated')
                             then {{'c': v[q].c + m.more + 3, 'a': 'R' || v[q].a,
                                    't': [(case when p = 3 then 'assistant:' else 'user:' end) || m.text] || v[q].t}} end])
              for q, p in [3, 3, 4, 3]] as o
      from fold f join (select *, role || ':' || text as line, case when fault = 'truncated' then 3 else 0 end as more from marked) m
        on m.conv_id is not distinct from f.conv_id and m.i = f.i - 1) x) y)
select c.conv_id, coalesce(k.gaps, 0)::bigint as gaps, coalesce(k.blank, 0)::bigint as blank, coalesce(k.duplicate, 0)::bigint as duplicate,
       coalesce(k.truncated, 0)::bigint as truncated, coalesce(k.illegal, 0)::bigint as illegal, coalesce(f.v[1].c, 0)::bigint as cost,
       coalesce(f.v[1].a, '') as audit, sha256(array_to_string(coalesce(f.v[1].t, []), chr(10))) as repaired_sha256
from (select distinct conv_id from conversations) c
left join counts k on k.conv_id is not distinct from c.conv_id
left join fold f on f.conv_id is not distinct from c.conv_id and f.i = 1
"""

# Stretches of equal pairs at every lag, from equal 16-grams; a run whose words have a smaller period lies in a stretch of a smaller lag.
OP13 = rf"""
with given as (
  select doc_id, coalesce(regexp_extract_all(text, '{WORD}'), []) as w, {_CRC.format(x="doc_id::varchar")} as h from documents),
parts as (select *, len(w) as n, h // 10 as g from given),
cut as (select *, case when n > 0 then g % n end as a from parts),
made as (
  select doc_id, n, case when h % 10 = 0 and n > 0
    then [w[(case when i < a then i else a + (i - a) % (1 + (n - a) // (3 + g % 8)) end) + 1] for i in range(n)] else w end as w
  from cut),
words as (select doc_id, n, unnest(w) as word, unnest(range(n)) as i from made),
grams as (select doc_id, n, i, unnest_gram as gram from (
  select doc_id, n, unnest(range(n - 15)) as i, unnest([md5(array_to_string(w[j + 1:j + 16], ' ')) for j in range(n - 15)]) as unnest_gram
  from made where n >= 24) x),
pairs as (select x.doc_id, x.i, y.i - x.i as q from grams x join grams y on x.doc_id = y.doc_id and x.gram = y.gram and y.i > x.i
          where 3 * (y.i - x.i) <= x.n),
stretches as (
  select doc_id, q, min(i) as start, count(*) + 15 + q as length
  from (select *, i - row_number() over (partition by doc_id, q order by i) as island from pairs) p group by doc_id, q, island),
runs as (
  select * from stretches r where length >= greatest(24, 3 * q) and not exists (
    select 1 from stretches s where s.doc_id = r.doc_id and s.q < r.q and s.start <= r.start and s.start + s.length >= r.start + r.length)),
best as (select * from (select *, row_number() over (partition by doc_id order by length::double / q desc, start, q) as rn from runs) b where rn = 1),
listed as (select doc_id, count(*) as n_runs, string_agg(start || ',' || length || ',' || q || chr(10), '' order by start, q) as lines
           from runs group by doc_id),
gone as (select distinct doc_id, unnest(range(start + q, start + length)) as i from runs),
kept as (select doc_id, string_agg(word, ' ' order by i) as text from words anti join gone using (doc_id, i) group by doc_id)
select d.doc_id, coalesce(l.n_runs, 0)::bigint as n_runs, b.start::bigint as start, b.length::bigint as length, b.q::bigint as period,
       (1000 * b.length // b.q)::bigint as exponent_milli, sha256(coalesce(l.lines, '')) as runs_sha256,
       sha256(coalesce(k.text, '')) as collapsed_sha256
from documents d left join listed l using (doc_id) left join best b using (doc_id) left join kept k using (doc_id)
"""

ORACLE: dict[str, str] = {"op1_url_filter": OP1, "op4_near_dedup": OP4, "op5_warc": OP5, "op10_mixing": OP10,
                          "op12_conversations": OP12, "op13_periodic_runs": OP13}
