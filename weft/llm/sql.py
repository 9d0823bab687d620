"""DuckDB SQL for the operators that SQL can express."""

W = "[\\x20\\x09-\\x0D]+"

OP2 = f"""
with d as (select doc_id, coalesce(text, '') t from documents),
w as (select doc_id, t, list_filter(string_split_regex(t, '{W}'), lambda x: x <> '') ws,
        list_filter(string_split(t, chr(10)), lambda x: regexp_matches(x, '[^\\x20\\x09-\\x0D]')) ls from d),
g as (select doc_id, i, ws[i] || ' ' || ws[i + 1] || ' ' || ws[i + 2] g from (select doc_id, ws, unnest(range(1, len(ws) - 1)) i from w)),
r as (select doc_id, i, count(*) over (partition by doc_id, g) n from g),
p as (select doc_id, i, coalesce(lead(i) over (partition by doc_id order by i), i + 3) - i gap from r where n > 1),
c as (select doc_id, sum(least(gap, 3))::bigint n from p group by doc_id),
m as (select w.doc_id, len(ws)::bigint n_words, length(regexp_replace(t, '{W}', '', 'g'))::bigint word_chars,
        length(regexp_replace(t, '[^#*$%&|<>]', '', 'g'))::bigint n_symbols, (len(ls) - len(list_distinct(ls)))::bigint n_dup_lines,
        coalesce(c.n, 0)::bigint n_repeat_words, len(ls)::bigint n_lines, length(regexp_replace(t, '[^!]', '', 'g'))::bigint n_exclaims
      from w left join c on w.doc_id = c.doc_id),
f as (select *, (case when n_words < 50 then 1 else 0 end + case when 100 * n_repeat_words > 50 * n_words then 2 else 0 end
        + case when 10 * n_symbols > n_words then 4 else 0 end + case when n_lines >= 5 and 100 * n_dup_lines > 30 * n_lines then 8 else 0 end
        + case when n_words > 0 and (word_chars < 3 * n_words or word_chars > 12 * n_words) then 16 else 0 end
        + case when 10 * n_exclaims > 3 * n_words then 32 else 0 end)::bigint fail_bits from m)
select doc_id, n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, (fail_bits & 3) <> 0 base_failed, fail_bits = 0 kept, fail_bits, n_lines, n_exclaims from f
"""

OP6 = """
with c as (select conv_id, turn, coalesce(role, '') r, coalesce(text, '') t from conversations
  union all select -7, i, r, '</s>[INST] ok [/INST]' from (values (0, 'user'), (1, 'assistant')) v(i, r)),
o as (select *, lag(r) over w as before, row_number() over w - 1 as pos, count(*) over (partition by conv_id) as n from c window w as (partition by conv_id order by turn, r, t)),
f as (select *, (coalesce(before, 'start') || '>' || r) not in ('start>system', 'start>user', 'system>user', 'user>assistant', 'assistant>user') as bad,
  length(r) + length(t) + 10 + 4 * (length(r || t) - length(replace(r || t, '&', ''))) + 3 * (length(r || t) - length(replace(replace(replace(replace(r || t, '<', ''), '>', ''), '[', ''), ']', ''))) as chars from o)
select conv_id, count(*)::bigint n_turns, sha256(string_agg(r || chr(10) || t || chr(10), '' order by turn, r, t)) turns_sha256,
  length(coalesce(string_agg(t, '' order by turn, r, t) filter (where r = 'assistant'), ''))::bigint loss_chars,
  sha256(coalesce(string_agg(t, '' order by turn, r, t) filter (where r = 'assistant'), '')) loss_sha256,
  sum(chars)::bigint formatted_chars,
  coalesce(min(pos) filter (where bad), min(n) filter (where pos = n - 1 and r <> 'assistant')) is null as valid,
  coalesce(min(pos) filter (where bad), min(n) filter (where pos = n - 1 and r <> 'assistant'))::bigint as bad_turn
from f group by conv_id
"""

OP1 = f"""
with d as (select row_number() over () k, doc_id, list_filter(string_split_regex(coalesce(text, ''), '{W}'), lambda x: x <> '') ws from documents),
g as (select k, i, array_to_string(ws[i:i + 34], ' ') g from (select k, ws, unnest(range(1, len(ws) - 33)) i from d)),
r as (select k, i from (select k, i, count(*) over (partition by g) n from g) where n > 1),
j as (select d.k, d.doc_id, x.j, x.w from d, unnest(list_zip(range(1, len(ws) + 1), ws)) t(x2), lateral (select x2[1] j, x2[2] w) x),
m as (select j.*, max(r.i) over (partition by j.k order by j.j rows between 34 preceding and current row) is not null gone from j left join r on j.k = r.k and j.j = r.i)
select d.doc_id, len(d.ws)::bigint n_words, coalesce(a.n_removed, 0)::bigint n_removed, sha256(coalesce(a.kept, '')) kept_sha256
from d left join (select k, count(*) filter (where gone) n_removed, string_agg(w, ' ' order by j) filter (where not gone) kept from m group by k) a on d.k = a.k
"""

OP7 = f"""
with recursive d as (select doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '{W}'), lambda x: x <> '') ws from documents),
s as (select distinct doc_id, array_to_string(ws[i:i + 3], ' ') g from (select doc_id, ws, unnest(range(1, greatest(len(ws) - 3, 1) + 1)) i from d where len(ws) > 0)),
n as (select doc_id, count(*)::bigint n from s group by doc_id),
p as (select x.doc_id a, y.doc_id b, count(*) k from s x join s y on x.g = y.g and x.doc_id <> y.doc_id group by all),
e as (select a, b from p join n x on x.doc_id = a join n y on y.doc_id = b where 100 * k >= 85 * (x.n + y.n - k)),
w using key (a) as (select a, min(least(a, b)) c from e group by a union select e.a, min(w.c) c from w join e on e.b = w.a join recurring.w as m on m.a = e.a where w.c < m.c group by e.a)
select d.doc_id, coalesce(n.n, 0) n_shingles, coalesce(w.c, d.doc_id) component_id from d left join n on n.doc_id = d.doc_id left join w on w.a = d.doc_id
"""

OP10 = """
with d as (select page_id, strlen(coalesce(html, ''))::bigint payload_bytes, sha1(coalesce(html, '')) x, min(page_id) over (partition by coalesce(html, '')) least_id from pages)
select page_id, payload_bytes,
  array_to_string(list_transform(range(32), lambda i: substr('ABCDEFGHIJKLMNOPQRSTUVWXYZ234567', (((('0x' || substr(x, 5 * (i // 4) + 1, 5))::bigint >> (15 - 5 * (i % 4))) & 31) + 1)::int, 1)), '') payload_digest,
  case when page_id = least_id then 'response' else 'revisit' end record_type, case when page_id <> least_id then least_id end refers_to from d
"""


def crc32(data: str) -> str:
    """DuckDB expression: crc32 of an ASCII string; needs the one-row table `crc` (column t, the table of 256 entries)."""
    return f"xor(list_reduce(list_transform(string_split({data}, ''), lambda x: ascii(x)::bigint), lambda a, b: xor(a >> 8, t[(xor(a, b) & 255) + 1]), 4294967295::bigint), 4294967295)"


CRC = "crc as (select list(v order by i) t from (select i, list_reduce(range(8), lambda a, b: case when a & 1 = 1 then xor(a >> 1, 3988292384) else a >> 1 end, i) v from range(256) r(i)))"

OP11 = """
select doc_id, max(doc_id) over w keep_id, count(*) over w group_size, doc_id = max(doc_id) over w kept, sha256(coalesce(text, '')) text_sha256
from documents window w as (partition by coalesce(text, ''))
"""

OP13 = f"""
with recursive {CRC},
j as (select *, unnest(range(0, click_id % 3 + 1)) j from clicks where click_id >= 0 and arrived_at is not null),
c as (select j.*, {crc32("(click_id || ':' || j)")} c from j, crc),
h as (select *, epoch_us(arrived_at) // 3600000000 + 6 * j * (c % 10) as hour from c),
l as (select *, hour + (c // 10) % 200 l from h),
b as (select *, ((l - min(l) over ()) * 10 // (max(l) over () - min(l) over () + 1)) batch,
  sha256(concat_ws('|', coalesce(client_id::varchar, ''), coalesce(kind, ''), coalesce(floor(100 * value + 0.5)::bigint::varchar, ''), coalesce(epoch_us(ts)::varchar, ''), coalesce(props, ''), c % 3)) hash from l),
m as (select k, (select max(hour) from b where batch < k) m from range(11) t(k)),
p as (select hour, coalesce((select min(k) from m where k between 1 and 9 and hour + 48 < m - 24) - 1, 9) past from (select distinct hour from b)),
r as (select b.click_id, b.hour, b.batch, b.hash, p.past, row_number() over (partition by b.click_id order by b.batch, b.hour, b.hash) rn
  from b join m on m.k = b.batch join p on p.hour = b.hour where b.batch = 0 or b.hour >= m.m - 24),
w as (select click_id, rn, rn as opener, hour as start_hour, past, batch from r where rn = 1 union all
  select r.click_id, r.rn, case when w.past < r.batch or r.hour > w.start_hour + 48 then r.rn else w.opener end,
    case when w.past < r.batch or r.hour > w.start_hour + 48 then r.hour else w.start_hour end, case when w.past < r.batch or r.hour > w.start_hour + 48 then r.past else w.past end, r.batch
  from w join r on r.click_id = w.click_id and r.rn = w.rn + 1),
f as (select w.click_id, w.opener, any_value(w.start_hour) start_hour, any_value(w.past) past, max(w.rn) last, count(*) - 1 n_repeats, count(*) filter (where r.hash <> o.hash) n_conflicts,
    list(r.hash) filter (where r.hash <> o.hash) others, any_value(o.hash) hash
  from w join r on r.click_id = w.click_id and r.rn = w.rn join r o on o.click_id = w.click_id and o.rn = w.opener group by w.click_id, w.opener)
select f.click_id, f.start_hour, least(f.past, n.batch)::bigint closed_batch, n_repeats::bigint n_repeats, n_conflicts::bigint n_conflicts,
  coalesce(list_sum(list_transform(others, lambda x: {crc32("x")})), 0)::bigint conflict_crc, f.hash
from f left join r n on n.click_id = f.click_id and n.rn = f.last + 1, crc
"""
