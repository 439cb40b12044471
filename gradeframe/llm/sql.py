"""SQL of corpus queries that is made of repeated parts."""

from __future__ import annotations

_ANSWERS = (2, 2, 3, 2)  # where an inserted or renamed turn leads from each state


def _led(weight: str, letter: str, cost: str) -> str:
    """A letter in front of an audit; a weight is the cost in twelve digits and the letters."""
    return f"lpad((left({weight}, 12)::bigint + {cost})::varchar, 12, '0') || '{letter}' || substr({weight}, 13)"


def _inserted(rows: str, keys: str) -> str:
    """Weights w0 to w3 from b0 to b3, with up to two inserted turns first."""
    once = ", ".join(f"least(b{s}, {_led(f'b{t}', 'I', '2')}) as o{s}" for s, t in enumerate(_ANSWERS))
    twice = ", ".join(f"least(b{s}, {_led(f'o{t}', 'I', '2')}) as w{s}" for s, t in enumerate(_ANSWERS))
    return f"select {keys}, {twice} from (select *, {once} from ({rows}))"


def _row(s: int) -> str:
    keeps = {0: {"s": 1, "u": 2}, 1: {"u": 2}, 2: {"a": 3}, 3: {"u": 2}}[s]
    kept = " ".join(f"when '{c}' then {_led(f'w{t}', 'K', 'cut')}" for c, t in keeps.items())
    kept = f"coalesce(case left(role, 1) {kept} end, 'x')"
    edited = f"least({_led(f'w{_ANSWERS[s]}', 'R', '2 + cut')}, {kept})"
    return f"least({_led(f'w{s}', 'D', '3')}, case when fault in ('blank', 'duplicate') then 'x' else {edited} end) as b{s}"


_STEP = f"select v.conv_id, v.i - 1 as i, {', '.join(map(_row, range(4)))} from v join f on v.conv_id is not distinct from f.conv_id and f.i = v.i - 1"
_ENDS = "select conv_id, max(i) + 1 as i, '000000000000' as b0, '900000000000' as b1, '900000000000' as b2, '000000000000' as b3 from f group by conv_id"

OP11 = rf"""
with recursive bit as (
  select i, 0 as n, i as x from range(256) as t(i)
  union all
  select i, n + 1, case when x & 1 = 1 then xor(x >> 1, 3988292384) else x >> 1 end from bit where n < 8),
crc as (select list(x order by i) as t from bit where n = 8),
k as (
  select conv_id, turn, coalesce(role, ' ') as role, coalesce(text, ' ') as text,
    [ascii(c) for c in string_split(coalesce(conv_id::varchar, ' ') || ':' || coalesce(turn::varchar, ' '), '')] as bytes
  from conversations),
d as (
  select conv_id, turn, role, text, xor(list_reduce(bytes, lambda c, b: xor(c >> 8, t[xor(c, b) % 256 + 1]), 4294967295), 4294967295) % 20 as kind
  from k, crc),
r as (
  select conv_id, turn, case when kind = 4 then 'user' else role end as role,
    case kind when 1 then '' when 2 then regexp_replace(text, '[.!?]', '', 'g') else text end as text
  from d, range(2) as c(copy) where kind <> 0 and (copy = 0 or kind = 3)),
n as (
  select *, row_number() over (partition by conv_id order by turn nulls first, role, text) as i,
    regexp_extract(text, '([^\x20\x09-\x0D])[\x20\x09-\x0D]*$', 1) as tail
  from r),
f as (
  select *, (fault = 'truncated')::int as cut from (
    select *, case when tail = '' then 'blank' when row_number() over (partition by conv_id, role, text order by i) > 1 then 'duplicate'
      when tail not in ('.', '!', '?') then 'truncated' else '' end as fault,
      lag(left(role, 1)) over (partition by conv_id order by i) as before
    from n)),
v as (
  {_inserted(_ENDS, 'conv_id, i')}
  union all
  {_inserted(_STEP, 'conv_id, i')}),
best as (select conv_id, left(w0, 12)::bigint as cost, substr(w0, 13) as audit from v where i = 1),
letter as (
  select conv_id, unnest(string_split(audit, '')) as letter, generate_subscripts(string_split(audit, ''), 1) as pos from best where audit <> ''),
placed as (
  select *, sum((letter <> 'I')::int) over (partition by conv_id order by pos) as i,
    sum((letter <> 'D')::int) over (partition by conv_id order by pos) as shown
  from letter),
turns as (
  select p.*, f.role, f.text,
    max((shown = 1 and letter = 'K' and left(role, 1) = 's')::int) over (partition by p.conv_id) as led
  from placed p left join f on p.conv_id is not distinct from f.conv_id and p.i = f.i and letter <> 'I'),
repaired as (
  select conv_id, string_agg(case when letter = 'K' then role else case when (shown - led) % 2 = 1 then 'user' else 'assistant' end end
    || ':' || coalesce(text, ''), chr(10) order by pos) as text
  from turns where letter <> 'D' group by conv_id),
counts as (
  select conv_id, coalesce(max(turn) - min(turn) + 1 - count(distinct turn), 0) as gaps, count(*) filter (where fault = 'blank') as blank,
    count(*) filter (where fault = 'duplicate') as duplicate, count(*) filter (where fault = 'truncated') as truncated,
    count(*) filter (where before is not null and before || left(role, 1) not in ('su', 'ua', 'au')) as illegal
  from f group by conv_id)
select a.conv_id, coalesce(gaps, 0)::bigint as gaps, coalesce(blank, 0)::bigint as blank, coalesce(duplicate, 0)::bigint as duplicate,
  coalesce(truncated, 0)::bigint as truncated, coalesce(illegal, 0)::bigint as illegal, coalesce(cost, 0)::bigint as cost,
  coalesce(audit, '') as audit, sha256(coalesce(repaired.text, '')) as repaired_sha256
from (select distinct conv_id from conversations) a
left join counts on a.conv_id is not distinct from counts.conv_id
left join best on a.conv_id is not distinct from best.conv_id
left join repaired on a.conv_id is not distinct from repaired.conv_id
"""
