"""SQL twins for DuckDB, one per query that SQL can express."""

from moneytrail.llm.rules import STOP_WORDS

ORACLE = {
    "op3_line_dedup": r"""
with texts as (select distinct coalesce(cast(doc_id as varchar), 'none') as id, text from documents where text is not null),
split as (select id, text, unnest(string_split(text, chr(10))) as line, generate_subscripts(string_split(text, chr(10)), 1) as place from texts),
spaced as (select *, trim(translate(line, chr(9) || chr(11) || chr(12) || chr(13), '    '), ' ') as t from split),
masked as (
  select id, text, line, place,
         [case when regexp_matches(w, '[0-9]') then '<*>' else w end for w in (case when t = '' then [] else string_split_regex(t, ' +') end)] as ws
  from spaced),
sizes as (select id, text, sum(len(ws)) as n_words from masked group by id, text),
held as (select id, text, ws, ws[1:3] as lead, sum(len(ws)) as words from masked where len(ws) > 3 group by id, text, ws),
variants as (select ws, lead, count(*) as docs from held group by ws, lead),
crowded as (select len(ws) as n, lead from variants group by len(ws), lead having sum(docs) >= 5),
places as (
  select ws, v.lead, docs, unnest(ws) as token, generate_subscripts(ws, 1) as place
  from variants v join crowded c on c.n = len(ws) and c.lead = v.lead),
fixed as (select len(ws) as n, lead, place, token from places where token <> '<*>' group by len(ws), lead, place, token having sum(docs) >= 5),
templates as (
  select ws, a.lead, list(coalesce(f.token, '<*>') order by a.place) as shape
  from places a left join fixed f on f.n = len(ws) and f.lead = a.lead and f.place = a.place and f.token = a.token
  group by ws, a.lead having count(f.token) / count(*) >= 0.7),
placed as (select id, text, words, t.lead, shape from held h join templates t on t.ws = h.ws),
recurring as (select lead, shape from (select distinct lead, shape, id, text from placed) z group by lead, shape having count(*) >= 5),
again as (select p.* from placed p join recurring r on r.lead = p.lead and r.shape = p.shape),
pages as (
  select a.id, a.text from again a join sizes s on s.id = a.id and s.text = a.text
  group by a.id, a.text, n_words having sum(words) < 0.5 * n_words),
dropped as (
  select lead, shape from (
    select distinct lead, shape, a.id, a.text from again a join pages p on p.id = a.id and p.text = a.text) z
  group by lead, shape having count(*) >= 5),
gone as (select ws from templates t join dropped d on d.lead = t.lead and d.shape = t.shape),
freed as (
  select id, m.text, coalesce(string_agg(line, chr(10) order by place) filter (g.ws is null), '') as free,
         count(*) as n_lines, count(g.ws) as n_dropped
  from masked m left join gone g on g.ws = m.ws group by id, m.text)
select doc_id, free as text, coalesce(n_lines, 0) as n_lines, coalesce(n_dropped, 0) as n_dropped
from documents d left join freed f on f.id = coalesce(cast(doc_id as varchar), 'none') and f.text = d.text""",
    "op4_mixing": r"""
with sized as (
  select doc_id, source, len(regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+')) as size,
         md5('mix:' || coalesce(cast(doc_id as varchar), 'null')) as key
  from documents),
sources as (
  select source, sum(size)::bigint as source_size, row_number() over (order by source nulls last) - 1 as place
  from sized group by source),
weighed as (select *, case place % 3 when 0 then 3 when 1 then 1 else 2 end as weight, 2 * source_size as cap from sources),
ratios as (select *, cap / weight as ratio, sum(source_size) over () * 1.5::double as total from weighed),
rates as (
  select *, total - (sum(cap) over (order by ratio, place) - cap) as left_over,
         sum(weight) over (order by ratio, place rows between current row and unbounded following) as open
  from ratios),
aims as (select source, source_size, least(cap::double, max(left_over / open) over () * weight) as target from rates),
placed as (
  select s.doc_id, s.size, a.source_size, a.target, floor(a.target)::bigint as budget,
         (sum(s.size) over (partition by s.source order by s.key, s.doc_id, s.size rows unbounded preceding) - s.size)::bigint as before
  from sized s join aims a on s.source is not distinct from a.source),
cut as (select *, case when source_size > 0 then budget // source_size else 0 end as epochs from placed)
select doc_id, size::bigint as size, source_size, target,
       (epochs * size + greatest(0, least(size, budget - epochs * source_size - before)))::bigint as taken
from cut""",
    "op6_impact_topk": """
with rows as (
  select vec_id, [floor(1024 * x::double) for x in embedding] as v from embeddings
  where vec_id is not null and embedding is not null and coalesce(list_bool_and([x is not null and isfinite(x) for x in embedding]), true)),
scored as (
  select q.vec_id as query_id, r.vec_id, list_dot_product(q.v, r.v)::bigint as score
  from rows q join rows r on q.vec_id % 100 = 0 and q.vec_id <> r.vec_id and len(q.v) = len(r.v)),
ranked as (select *, row_number() over (partition by query_id order by score desc, vec_id)::int as rank from scored)
select query_id, rank, vec_id, score from ranked where rank <= 10""",
    "op10_chat": r"""
with turns as (
  select conv_id, turn, coalesce(role, 'unknown') as role, coalesce(text, '') as text,
         row_number() over (partition by conv_id order by turn nulls first, role, text) as n
  from conversations where conv_id is not null),
shown as (select *, '<|im_start|>' || role || chr(10) || text || '<|im_end|>' || chr(10) as piece from turns),
prefixes as (
  select *, string_agg(piece, '') over (partition by conv_id order by n) as so_far,
         sum(length(piece)) over (partition by conv_id order by n) as upto, n = max(n) over (partition by conv_id) as last
  from shown),
whole as (select n, so_far, min(conv_id) as conv_id, count(*) as n_logged from prefixes where last group by n, so_far),
kept as (select * from whole w where not exists (select 1 from prefixes p where not p.last and p.n = w.n and p.so_far = w.so_far)),
spans as (
  select conv_id, string_agg((upto - 11 - length(text))::bigint || ':' || (upto - 11)::bigint, ',' order by n) as loss_spans
  from prefixes where role = 'assistant' group by conv_id)
select k.conv_id, k.n as n_turns, n_logged, so_far as text, coalesce(loss_spans, '') as loss_spans
from kept k left join spans s on s.conv_id = k.conv_id""",
    "op11_rules": r"""
with texts as (select row_number() over () as rid, doc_id, coalesce(text, '') as text from documents),
split as (
  select *, regexp_extract_all(text, '[^\x20\x09-\x0D]+') as words,
         list_filter(string_split(text, chr(10)), lambda l: regexp_matches(l, '[^\x20\x09-\x0D]')) as ls
  from texts),
grams as (
  select rid, list_transform(range(1, len(words) - 3), lambda i: array_to_string(words[i:i + 4], ' ')) as g from split where len(words) > 4),
windows as (select rid, unnest(g) as g, generate_subscripts(g, 1) as i from grams),
again as (select rid, i from (select rid, i, count(*) over (partition by rid, g) as n from windows) w where n > 1),
covered as (select rid, count(distinct p) as n from (select rid, unnest(range(i, i + 5)) as p from again) c group by rid),
measured as (
  select doc_id, len(words) as n_words, coalesce(n, 0) as n_repeat_words, len(ls) as n_lines,
         length(regexp_replace(text, '[\x20\x09-\x0D]', '', 'g')) as word_chars,
         length(text) - length(regexp_replace(text, '[#*$%&|<>]', '', 'g')) as n_symbols,
         len(ls) - len(list_distinct(ls)) as n_dup_lines,
         len(regexp_extract_all(text, '[^\x20\x09-\x0D]*\p{L}[^\x20\x09-\x0D]*')) as letters,
         len(list_filter(words, lambda w: w[-2:] = '!!')) as shouted,
         len(list_filter(words, lambda w: lower(rtrim(w, '.,;:!?')) in (@STOP_WORDS@))) as stops,
         len(list_filter(ls, lambda l: regexp_matches(l, '^[\x20\x09]*[-*•]'))) as bullets,
         len(list_filter(ls, lambda l: regexp_matches(l, '(\.\.\.|…)[\x20\x09-\x0D]*$'))) as dotted
  from split s left join covered c on c.rid = s.rid),
judged as (
  select *, [
    case when n_words < 10 then 'few_words' end,
    case when 100 * n_repeat_words > 20 * n_words then 'repeated_words' end,
    case when n_words > 0 and not word_chars between 2 * n_words and 15 * n_words then 'word_length' end,
    case when n_words > 0 and 10 * n_symbols > n_words then 'symbols' end,
    case when n_words >= 30 and 10 * letters < 7 * n_words then 'words_with_letters' end,
    case when n_words >= 30 and 25 * stops < n_words then 'stop_words' end,
    case when n_words > 0 and 10 * shouted > 3 * n_words then 'shouting' end,
    case when n_lines >= 4 and 2 * n_dup_lines > n_lines then 'repeated_lines' end,
    case when n_lines >= 4 and 10 * bullets > 9 * n_lines then 'bullet_lines' end,
    case when n_lines >= 4 and 10 * dotted > 3 * n_lines then 'ellipsis_lines' end] as b
  from measured)
select doc_id, n_words::bigint as n_words, word_chars::bigint as word_chars, n_symbols::bigint as n_symbols,
       n_dup_lines::bigint as n_dup_lines, n_repeat_words::bigint as n_repeat_words,
       b[1] is not null or b[2] is not null as base_failed, len(list_filter(b, lambda x: x is not null)) = 0 as kept,
       array_to_string(list_filter(b, lambda x: x is not null), ',') as broken
from judged""".replace("@STOP_WORDS@", ", ".join(f"'{w}'" for w in STOP_WORDS)),
    "op12_repair": r"""
with recursive
given as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
         coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' ') as key
  from conversations),
coded as (
  -- crc32, bit by bit: every byte is followed by eight steps
  select *, xor(list_reduce(list_prepend(4294967295::bigint, flatten([[ascii(c)::bigint, -1, -1, -1, -1, -1, -1, -1, -1] for c in string_split(key, '')])),
         lambda a, b: case when b >= 0 then xor(a, b) when a % 2 = 1 then xor(a // 2, 3988292384) else a // 2 end), 4294967295) % 20 as kind
  from given),
damaged as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
         case kind when 1 then '' when 2 then translate(text, '.!?', '') else text end as text,
         unnest(case kind when 0 then [] when 3 then [1, 2] else [1] end) as copy
  from coded),
placed as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text[:64], sha256(text), copy) as n,
         row_number() over (partition by conv_id, role, text order by turn nulls first, copy) as said
  from damaged),
judged as (
  select *, role[:1] as i,
         case when not regexp_matches(text, '[^\x20\x09-\x0D]') then 'blank' when said > 1 then 'duplicate'
              when not regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') then 'truncated' else '' end as fault,
         lag(role[:1]) over (partition by conv_id order by n) as before
  from placed),
steps(p, i, q) as (values (0, 's', 1), (0, 'u', 2), (1, 'u', 2), (3, 'u', 2), (2, 'a', 3)),
inserted(p, q, c, a) as (values
  (0, 0, 0, ''), (0, 2, 3, 'I'), (0, 3, 6, 'II'), (1, 1, 0, ''), (1, 2, 3, 'I'), (1, 3, 6, 'II'),
  (2, 2, 0, ''), (2, 3, 3, 'I'), (3, 3, 0, ''), (3, 2, 3, 'I')),
edits as (
  select conv_id, n, p, p as q, 4 as c, 'D' as a from judged, (values (0), (1), (2), (3)) s(p)
  union all
  select conv_id, n, p, q, (case when j.i = s.i then 0 else 3 end) + (case when fault = 'truncated' then 3 else 0 end),
         case when j.i = s.i then 'K' else 'R' end
  from judged j, steps s where fault not in ('blank', 'duplicate') and (j.i = s.i or s.i <> 's')),
moves as (
  select conv_id, n, e.p, t.q, min({'c': e.c + t.c, 'a': e.a || t.a}) as w
  from edits e join inserted t on t.p = e.q group by conv_id, n, e.p, t.q),
walk as (
  select conv_id, 0::bigint as n, q, {'c': c, 'a': a} as w from (select distinct conv_id from judged) k, inserted where p = 0
  union all
  select k.conv_id, m.n, m.q, min({'c': k.w.c + m.w.c, 'a': k.w.a || m.w.a})
  from walk k join moves m on m.conv_id is not distinct from k.conv_id and m.n = k.n + 1 and m.p = k.q
  group by k.conv_id, m.n, m.q),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (fault = 'blank') as blank,
         count(*) filter (fault = 'duplicate') as duplicate, count(*) filter (fault = 'truncated') as truncated,
         count(*) filter (before is not null and before || i not in ('su', 'ua', 'au')) as illegal, max(n) as rows
  from judged group by conv_id),
best as (
  select c.conv_id, min(w) as w from counts c join walk k on k.conv_id is not distinct from c.conv_id and k.n = c.rows
  where k.q in (0, 3) group by c.conv_id),
-- the repaired turns: every letter of the audit with the rows and the undeleted turns before it
letters as (
  select conv_id, w.a as audit, unnest(range(1, len(w.a) + 1)) as spot from best),
edited as (
  select *, audit[spot:spot] as e, len(replace(audit[1:spot], 'I', '')) as n, len(replace(audit[1:spot], 'D', '')) as place from letters),
spoken as (
  select e.conv_id, spot, case when e.e = 'K' then j.role || ':' || j.text else
           (case when (place - (case when left(replace(audit, 'D', ''), 1) = 'K' and f.i = 's' then 1 else 0 end)) % 2 = 1 then 'user:' else 'assistant:' end)
           || case when e = 'R' then j.text else '' end end as said
  from edited e
  left join judged j on j.conv_id is not distinct from e.conv_id and j.n = e.n and e <> 'I'
  left join judged f on f.conv_id is not distinct from e.conv_id and f.n = len(audit) - len(ltrim(audit, 'D')) + 1
  where e <> 'D'),
digests as (select conv_id, sha256(string_agg(said, chr(10) order by spot)) as h from spoken group by conv_id)
select g.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
       coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(w.c, 0)::bigint as cost,
       coalesce(w.a, '') as audit, coalesce(h, sha256('')) as repaired_sha256
from (select distinct conv_id from conversations) g
left join counts c on c.conv_id is not distinct from g.conv_id
left join best b on b.conv_id is not distinct from g.conv_id
left join digests d on d.conv_id is not distinct from g.conv_id""",
    "op13_negatives": """
with rows as (
  select row_number() over () as rid, vec_id, case when vec_id % 7 = 0 then (label + 1) % 10 else label end as label,
         [floor(256 * x::double) for x in embedding] as v
  from embeddings
  where vec_id is not null and label is not null and embedding is not null
    and coalesce(list_bool_and([x is not null and isfinite(x) for x in embedding]), true)),
anchors as (select vec_id, label, v, min(rid) as anchor from rows where vec_id % 100 = 0 group by vec_id, label, v),
scored as (
  select anchor, a.vec_id as anchor_id, r.rid, r.vec_id, a.label = r.label as same, coalesce(list_dot_product(a.v, r.v), 0)::bigint as score
  from anchors a join rows r on a.vec_id <> r.vec_id and len(a.v) = len(r.v)),
positives as (
  select *, row_number() over (partition by anchor order by score desc, vec_id, rid) as positive_rank from scored where same
  qualify positive_rank <= 5),
negatives as (
  select p.anchor_id, p.vec_id as positive_id, positive_rank::int as positive_rank, p.score as positive_score, n.vec_id as negative_id,
         n.score as negative_score, row_number() over (partition by p.anchor, positive_rank order by n.score desc, n.vec_id, n.rid)::int as rank
  from positives p join scored n on n.anchor = p.anchor and not n.same and 80 * p.score <= 100 * n.score and 100 * n.score <= 100 * p.score)
select anchor_id, positive_id, positive_rank, rank, negative_id, positive_score, negative_score from negatives where rank <= 5""",
}
