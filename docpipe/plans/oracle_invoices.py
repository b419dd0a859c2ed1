"""DuckDB SQL for whole invoices: items cleaned, matched to rows in turn, repaired by their row's prices, and totalled.

Amounts are whole cents, tax rates hundredths of a percent, scores thousandths. Unit prices and quantities of this input
never need a repair (discounts are at most a tenth), so those two steps, which have queries of their own, are left out.
"""

from __future__ import annotations

from docpipe.operators.matching import SUMMARY
from docpipe.plans import inputs

RATES = (0, 500, 1800, 2700)


def off(net: str, gross: str, rate: str | int) -> str:
    return f"abs(sign({net})::bigint * ((abs({net}) * (10000 + {rate}) + 5000) // 10000) - {gross})"


def least_off(net: str, gross: str) -> str:
    return f"least({', '.join(off(net, gross, r) for r in RATES)})"


def score(u: str, n: str, g: str, q: str, rate: str | None) -> str:
    """The triple's score; null where impossible."""
    possible = f"(least({u}, {n}, {g}) >= 0 or greatest({u}, {n}, {g}) <= 0) and case when least({u}, {n}, {g}) < -1 then {u} >= {n} - 1 and {n} >= {g} - 1 else {u} <= {n} + 1 and {n} <= {g} + 1 end"
    best = least_off(n, g)
    unknown = f"case when {best} <= 50 then -30000 else {best} * 100 end"
    taxed = unknown if rate is None else f"case when {rate} is null then {unknown} when {off(n, g, rate)} <= 50 then -50000 else {off(n, g, rate)} * 200 end"
    return f"case when {possible} then case when {q} <> 1 then 0 when {u} = {n} then -100000 else abs({u} - {n}) * 100 end + {taxed} + ({g} - {u}) end"


cents = lambda c: f"case when {c} = '' then 0 else (try_cast({c} as decimal(18, 2)) * 100)::bigint end"
near = lambda v: f"len(list_filter(p, lambda x: abs(x - {v}) <= 51)) > 0"
number = lambda c: f"try_cast({c} as double)"

#: Items with net and gross in order.
ORDERED = f"""
select doc_id, item_no, name, quantity, unit_price, case when swap then gross else net end as net, case when swap then net else gross end as gross
from (select *, coalesce({number('gross')} < {number('net')} and {number('gross')} > 0, false) as swap from ({inputs.ITEMS}) x) y"""

MATCHED = rf"""
lines0 as (select doc_id, line, row_number() over (partition by doc_id order by line_no) - 1 as line_idx, regexp_extract(line, '(\d+)[,.]?(\d*)\s*(?:\d+)?\s*%', ['a', 'b']) as v from ({inputs.TABLE_LINES}) x),
lines1 as (select *, case when v.a <> '' then (concat(v.a, case when v.b <> '' then '.' || v.b else '' end)::decimal(18, 4) * 100)::bigint end as rate from lines0),
lines2 as materialized (select *, lower(line) as folded, list_filter(list_transform(regexp_extract_all(line, '-?\d+[.,]\d+'), lambda x: (replace(x, ',', '.')::decimal(18, 2) * 100)::bigint), lambda x: rate is null or x <> rate) as p from lines1),
items1 as materialized (select *, list_filter([{number('unit_price')}, {number('net')}, {number('gross')}], lambda x: x is not null and x <> 0) as amounts, list_filter(regexp_extract_all(lower(name), '[a-z0-9]+'), lambda t: length(t) >= 3) as tokens from ({ORDERED}) x),
pairs as materialized (select doc_id, item_no, line_idx, 5.0::double * len(list_filter(amounts, lambda a: len(list_filter(p, lambda b: abs(abs(b) / 100 - abs(a)) <= 1)) > 0)) + 1.5::double * len(list_filter(tokens, lambda t: contains(folded, t)))
  + case when len(list_filter(p, lambda b: abs(abs(b) / 100 - quantity::double) <= 0.01::double)) > 0 then 1 else 0 end - case when regexp_matches(folded, '{SUMMARY}') then 3 else 0 end as s from items1 join lines2 using (doc_id)),
ends as (select doc_id, max(item_no) as last from pairs group by doc_id),
turn(doc_id, pos, used, line_idx) as (
  select doc_id, 0, []::bigint[], null::bigint from ends
  union all
  select f.doc_id, f.pos + 1, case when max(b.best) > 0 then list_append(any_value(f.used), arg_max(b.line_idx, (b.best, -b.line_idx))) else any_value(f.used) end, case when max(b.best) > 0 then arg_max(b.line_idx, (b.best, -b.line_idx)) end
  from turn f join ends e on e.doc_id = f.doc_id and f.pos < e.last
  join lateral (select line_idx, s - case when list_contains(f.used, line_idx) then 0.5 else 0 end as best from pairs x where x.doc_id = f.doc_id and x.item_no = f.pos + 1) b on true
  group by f.doc_id, f.pos),
own as materialized (select i.*, i.quantity::bigint as q, {cents('i.unit_price')} as u, {cents('i.net')} as n, {cents('i.gross')} as g, coalesce(l.p, []) as p, l.rate, l.line is not null as has_row
  from items1 i join turn t on t.doc_id = i.doc_id and t.pos = i.item_no left join lines2 l on l.doc_id = t.doc_id and l.line_idx = t.line_idx)"""

REPAIRED = f"""
judged as (select *, {score('u', 'n', 'g', 'q', None)} as score, case when n > 0 and g > 0 then {least_off('n', 'g')} end as error, u = n and n = g as repeated, u is not null and n is not null and g is not null as readable from own),
doubtful as (select *, list_filter(range(1, len(p) + 1), lambda i: abs(p[i]) >= 10000 and abs(p[i]) < 100000 and list_max(list_transform(p, lambda x: abs(x))) >= 90000) as amb from judged
  where readable and has_row and len(p) >= 3 and (repeated or error is null or error > greatest(500, abs(g) * 0.05))),
options as (select *, unnest(range(1, len(p) + 1)) as i from doubtful),
alt as (select doc_id, item_no, q, rate, i, p[i] as v, 0 as w from options union all select doc_id, item_no, q, rate, i, p[i] + 100000 * sign(p[i])::bigint, 1 << (len(amb) - list_position(amb, i)) from options where list_contains(amb, i)),
triples as (select a.doc_id, a.item_no, a.q, a.rate, a.i, b.i as j, c.i as k, a.v as va, b.v as vb, c.v as vc, a.w + case when b.i = a.i then 0 else b.w end + case when c.i in (a.i, b.i) then 0 else c.w end as s
  from alt a join alt b on a.doc_id = b.doc_id and a.item_no = b.item_no and (a.i < b.i or a.i = b.i and a.w = b.w) join alt c on a.doc_id = c.doc_id and a.item_no = c.item_no and (b.i < c.i or b.i = c.i and b.w = c.w)),
split as (select doc_id, item_no, q, rate, s, i, j, k, unnest([(va, vb, vc), (va, vc, vb), (vb, va, vc), (vb, vc, va), (vc, va, vb), (vc, vb, va)]) as o from triples),
scored as (select *, o[1] as bu, o[2] as bn, o[3] as bg, {score('o[1]', 'o[2]', 'o[3]', 'q', 'rate')} as new_score from split),
best as (select doc_id, item_no, bu, bn, bg, new_score, case when bn > 0 and bg > 0 then {least_off('bn', 'bg')} end as new_error from scored where new_score is not null
  qualify row_number() over (partition by doc_id, item_no order by new_score, s, i, j, k, bu, bn, bg) = 1),
chosen as (select d.*, bn, bg, coalesce(bu is not null and not (bu = bn and bn = bg) and (
  repeated and {near('bu')} and {near('bn')} and {near('bg')} and coalesce({off('bn', 'bg', 'rate')} <= 50, false)
  or coalesce(error - new_error > greatest(200, error * 0.5), false)
  or case when score is null then new_score is not null else score - new_score > 20000 end and case when error is null then true else coalesce(new_error <= error, false) end), false) as changed
  from judged d left join best b on b.doc_id = d.doc_id and b.item_no = d.item_no),
final as (select doc_id, case when changed then bn else n end as n, case when changed then bg else g end as g, not changed and net <> '' and n is null as bad_net, not changed and gross <> '' and g is null as bad_gross from chosen)"""


def oracle(headers: str) -> str:
    """headers: SQL of doc_id, invoice_number, issue_date, currency, parse_error."""
    return f"""
with recursive {MATCHED}, {REPAIRED},
sums as (select doc_id, count(*)::int as n_items, sum(n) as net, sum(case when not bad_net then g end) as gross, count(*) filter (bad_net or bad_gross or g < n and g > 0 and n > 0)::int as n_warnings from final group by doc_id)
select h.doc_id as id, invoice_number, issue_date, case when currency = '' then 'HUF' else currency end as currency, coalesce(n_items, 0)::int as n_items, coalesce(net, 0)::double / 100 as total_net, coalesce(gross, 0)::double / 100 as total_gross,
  coalesce(n_warnings, 0)::int as n_warnings, parse_error from ({headers}) h left join sums s on s.doc_id = h.doc_id"""
