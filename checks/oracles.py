"""Independent SQL of the registered queries, over the same base tables."""

from __future__ import annotations

# --- shared steps as named subqueries -------------------------------------------------------------

_PACKETS = """
o as (
  select o_orderkey k, o_custkey c,
         epoch_us(o_orderdate) + (o_orderkey % 86000) * 1000000 as t0,
         o_orderkey * 100000 % 2000000000 as isn
  from orders),
li as (
  select l_orderkey, l_linenumber, max(l_quantity) as l_quantity
  from lineitem group by l_orderkey, l_linenumber),
raw as (
  select k, c, 1 as n, t0 as t, 1 as c2s, 2 as tcp_flags, isn as seq, cast(0 as bigint) as ack,
         0 as pld_len from o where k % 13 <> 0
  union all
  select k, c, 2, t0 + 100, 0, 18, isn + 50000, isn + 1, 0 from o where k % 11 <> 0
  union all
  select k, c, 3, t0 + 200, 1, 16, isn + 1, isn + 50001, 0 from o
  union all
  select o.k, o.c, 3 + l_linenumber,
         o.t0 + 1000 * l_linenumber + l_linenumber * l_linenumber * 37, l_linenumber % 2,
         case when l_linenumber % 3 = 0 then 24 else 16 end, o.isn + 1 + 1000 * l_linenumber,
         o.isn + 50001 + 1000 * l_linenumber, cast(l_quantity as int) * 10
  from o join li on l_orderkey = o.k
  union all
  select k, c, 101, t0 + 100000, 1, case when k % 7 = 0 then 20 else 17 end,
         isn + 30000, isn + 80000, 0 from o where k % 5 <> 0
  union all
  select k, c, 102, t0 + 100100, 0, 17, isn + 80000, isn + 30001, 0
  from o where k % 5 <> 0 and k % 7 <> 0
  union all
  select k, c, 103, t0 + 100200, 1, 16, isn + 30001, isn + 80001, 0
  from o where k % 5 <> 0 and k % 7 <> 0),
plain as (
  select k * 1000 + n as rowkey, t, 6 as pr,
    case when c2s = 1 then 167772160 + c else 2886729728 + c % 7 end as si,
    case when c2s = 1 then 1024 + c % 60000 else 80 + c % 3 end as sp,
    case when c2s = 1 then 2886729728 + c % 7 else 167772160 + c end as di,
    case when c2s = 1 then 80 + c % 3 else 1024 + c % 60000 end as dp,
    tcp_flags, seq, ack, pld_len, 54 + pld_len as pkt_len
  from raw),
ends as (
  select *, si * 65536 + sp - case when si >= 2147483648 then 281474976710656 else 0 end as src,
            di * 65536 + dp - case when di >= 2147483648 then 281474976710656 else 0 end as dst
  from plain),
packets as (
  select *, least(src, dst) as lo, greatest(src, dst) as hi, src <= dst as src_lo from ends)
"""


def _six(x: str) -> str:
    """A signed 48-bit number as twelve hex digits."""
    bits = f"case when {x} < 0 then {x} + 281474976710656 else {x} end"
    return f"lower(lpad(to_hex(cast({bits} as bigint)), 12, '0'))"


_FM = f"{_six('lo')} || {_six('hi')} || lpad(lower(to_hex(pr)), 2, '0')"
_SID = f"{_FM} || lower(lpad(to_hex(sid_ts), 16, '0'))"
_SID_KEY = f"md5(unhex({_SID}))"

_HANDSHAKES = """
cand as (
  select lo, hi, pr, t, rowkey, tcp_flags,
         case when tcp_flags = 18 then dst else src end as client,
         case when tcp_flags = 18 then src else dst end as server,
         case tcp_flags when 2 then seq when 18 then ack - 1 end as isn,
         case tcp_flags when 18 then ack when 16 then seq end as cnext,
         case tcp_flags when 18 then seq when 16 then ack - 1 end as sisn
  from packets where tcp_flags in (18, 16) or (tcp_flags = 2 and ack = 0)),
pass1 as (
  select *, last_value(case when tcp_flags = 2 then t end ignore nulls) over (
    partition by lo, hi, pr, client, server, isn order by t, rowkey
    rows between unbounded preceding and current row) as syn_ts
  from cand where tcp_flags in (2, 18)),
pass2 as (
  select lo, hi, pr, t, rowkey, tcp_flags, client, server, cnext, sisn, syn_ts
  from pass1 where tcp_flags = 18 and syn_ts is not null
  union all
  select lo, hi, pr, t, rowkey, tcp_flags, client, server, cnext, sisn, null
  from cand where tcp_flags = 16),
acked as (
  select *, last_value(syn_ts ignore nulls) over (
    partition by lo, hi, pr, client, server, cnext, sisn order by t, rowkey
    rows between unbounded preceding and current row) as start_ts
  from pass2),
starts as (
  select distinct lo, hi, pr, start_ts from acked where tcp_flags = 16 and start_ts is not null)
"""

_TAGGED = """
markers as (
  select lo, hi, pr, ts, max(kind) as kind from (
    select lo, hi, pr, start_ts as ts, 0 as kind from starts
    union all
    select lo, hi, pr, t, 1 from packets where tcp_flags & 5 <> 0)
  group by lo, hi, pr, ts),
tagged as (
  select p.*, m.ts as sid_ts
  from packets p asof join markers m
    on p.lo = m.lo and p.hi = m.hi and p.pr = m.pr and p.t >= m.ts
  where m.kind = 0)
"""

_BY_SESSION = "partition by lo, hi, pr, sid_ts order by t, rowkey"

_ORIENTED = f"""
oriented as (
  select *, t - lag(t) over ({_BY_SESSION}) as iat,
    t - lag(t) over (partition by lo, hi, pr, sid_ts, src_lo order by t, rowkey) as side_iat,
    first_value(src_lo) over ({_BY_SESSION}) as first_lo,
    first_value(dst) over ({_BY_SESSION}) as server,
    first_value(src) over ({_BY_SESSION}) as client
  from tagged)
"""


def _exact(total: str) -> str:
    """An exact integer sum as the nearest double."""
    return f"cast(cast({total} as varchar) as double)"


def _stats(prefix: str, gap: str, payload_when: str, length_variance: str) -> str:
    def d(x: str) -> str:
        return f"coalesce(cast({x} as double), 0)"

    def var(x: str, mean: str, n: str) -> str:
        return d(f"{_exact(f'sum(({x} - {mean})::hugeint * ({x} - {mean}))')} / nullif({n}, 0)")

    pld = f"case when {payload_when} then pld_len end"
    return f"""
      {d('max(mean_len)')} as {prefix}avg_pkt_len, {d('min(pkt_len)')} as {prefix}min_pkt_len,
      {d('max(pkt_len)')} as {prefix}max_pkt_len, {length_variance} as {prefix}var_pkt_len,
      {d('max(mean_gap)')} as {prefix}avg_ts_IAT, {d(f'min({gap})')} as {prefix}min_ts_IAT,
      {d(f'max({gap})')} as {prefix}max_ts_IAT,
      {var(gap, 'mean_gap', f'count({gap})')} as {prefix}var_ts_IAT,
      {d('max(mean_pld)')} as {prefix}avg_pld_len, {d(f'min({pld})')} as {prefix}min_pld_len,
      {d(f'max({pld})')} as {prefix}max_pld_len,
      {var(f'({pld})', 'mean_pld', f'count({pld})')} as {prefix}var_pld_len,
      cast(sum(pkt_len) as double) as {prefix}total_bytes"""


def _features(corrected: bool = False) -> str:
    square = _exact("sum((pkt_len - mean_len)::hugeint * (pkt_len - mean_len))")
    whole = f"{square} / {'count(*)' if corrected else 'max(mean_len)'}"
    side = (
        f"{square} / count(*)"
        if corrected
        else f"{_exact('sum(xor(cast(pkt_len - mean_len as bigint), cast(2 as bigint)))')} / count(*)"
    )
    return f"""
whole_means as (
  select lo, hi, pr, sid_ts, sum(pkt_len) // count(*) as mean_len,
    coalesce(sum(iat) // nullif(count(iat), 0), 0) as mean_gap,
    sum(pld_len) // count(*) as mean_pld
  from oriented group by all),
whole as (
  select lo, hi, pr, sid_ts, {_stats('', 'iat', 'true', whole)},
    cast(max(t) - min(t) as double) as sessn_dur, cast(count(*) as double) as pkts_cnt,
    cast(count(*) filter (tcp_flags & 8 <> 0) as double) as psh_cnt
  from oriented join whole_means using (lo, hi, pr, sid_ts) group by lo, hi, pr, sid_ts),
side_means as (
  select lo, hi, pr, sid_ts, src_lo, sum(pkt_len) // count(*) as mean_len,
    coalesce(sum(side_iat) // nullif(count(side_iat), 0), 0) as mean_gap,
    coalesce(sum(pld_len) filter (pld_len > 0) // nullif(count(*) filter (pld_len > 0), 0), 0)
      as mean_pld
  from oriented group by all),
sides as (
  select lo, hi, pr, sid_ts, case when src_lo = first_lo then 'cs' else 'sc' end as side,
    {_stats('', 'side_iat', 'pld_len > 0', side)}, cast(count(*) as double) as pkt_cnt
  from oriented join side_means using (lo, hi, pr, sid_ts, src_lo)
  group by lo, hi, pr, sid_ts, src_lo, first_lo)
"""


_MEASURES = ("pkt_len", "ts_IAT", "pld_len")
_STATISTICS = [f"{s}_{m}" for m in _MEASURES for s in ("avg", "min", "max", "var")]
_SIDE = [*_STATISTICS, "total_bytes", "pkt_cnt"]
_WHOLE = [*_STATISTICS, "total_bytes", "sessn_dur", "pkts_cnt", "psh_cnt"]
_NAMES = [*_WHOLE, *(f"sc_{n}" for n in _SIDE), *(f"cs_{n}" for n in _SIDE)]

_SIDE_COLUMNS = ", ".join(
    f"coalesce(max({n}) filter (side = '{s}'), 0) as {s}_{n}" for s in ("sc", "cs") for n in _SIDE
)
_WIDE = f"""
flat as (select lo, hi, pr, sid_ts, {_SIDE_COLUMNS} from sides group by lo, hi, pr, sid_ts),
wide as (select * from whole join flat using (lo, hi, pr, sid_ts))
"""

_KEYS = f"""
session_keys as (
  select lo, hi, pr, sid_ts, max(client) as client, max(server) as server,
    {_SID_KEY} as rowkey, {_six('max(server)')} || '06' as m
  from oriented group by lo, hi, pr, sid_ts)
"""

_NAME_LIST = "[" + ", ".join(f"'{n}'" for n in _NAMES) + "]"
_VALUE_LIST = "[" + ", ".join(_NAMES) + "]"
_LONG = f"""
vectors as (
  select rowkey, m, {_VALUE_LIST} as v from wide join session_keys using (lo, hi, pr, sid_ts)),
long as (
  select rowkey, m, cast(unnest(range(44)) as int) as pos, unnest({_NAME_LIST}) as name,
         unnest(v) as value
  from vectors)
"""


def _sig(x: str) -> str:
    return f"cast(printf('%.8e', {x}) as double)"


_PROFILES = """
moments as (
  select m, pos, count(*) as n, avg(value) as a, stddev_pop(value) as d from long group by m, pos),
profile as (
  select m, pos, name, count(*) filter (near) / max(n) as frac, avg(value) filter (near) as mean
  from (select l.*, n, abs(value - a) <= 0.5 * d + 1e-9 * greatest(abs(a), 1.0) as near
        from long l join moments using (m, pos))
  group by m, pos, name)
"""

_TOP = """
top as (
  select * from (
    select *, row_number() over (partition by m order by frac desc, pos desc) as rank from profile)
  where rank <= 10)
"""

_SPLIT = """
placed as (
  select distinct m, md5(unhex(m)) as rowkey,
    cast('0x' || substr(m, 7, 2) as int) * 3 + cast('0x' || substr(m, 9, 4) as int) - 80 as place
  from profile),
known as (
  select m, 'WX' || lpad(cast(place // 2 as varchar), 3, '0') as id from placed
  where place % 2 = 0),
candidate as (select m, rowkey from placed where place % 2 = 1)
"""


def _ratio(a: str, b: str) -> str:
    return (
        f"case when {a} is null or {b} is null then 1.0 when {a} = 0 and {b} = 0 then 1.0 "
        f"when {b} = 0 then 0.0 else {a} / {b} end"
    )


_MATCHED = f"""
matched as (
  select c.rowkey, min(h.id) as id
  from candidate c left join (
    select p.m, k.id
    from known k join top t on t.m = k.m join profile p on p.pos = t.pos
    where {_ratio('p.mean', 't.mean')} between 0.4 and 2.09
    group by p.m, k.id having count(*) >= 8) h on h.m = c.m
  group by c.rowkey)
"""

_NEW = """
fresh as (
  select rowkey, 'WX' || lpad(cast(
      row_number() over (order by rowkey) - 1
      + (select max(cast(substr(id, 3) as int)) + 1 from known) as varchar), 3, '0') as id
  from matched where id is null)
"""

_CLUSTERS = f"""
node as (select distinct m, md5(unhex(m)) as rowkey from profile),
edge as (
  select t.m as a, p.m as b
  from top t join profile p on p.pos = t.pos and p.m <> t.m
  where {_ratio('p.mean', 't.mean')} between 0.4 and 2.08
  group by t.m, p.m having count(*) >= 8),
link as (select a, b from edge union select b, a from edge),
reach(a, b) as (
  select m, m from node union select r.a, l.b from reach r join link l on l.a = r.b),
component as (
  select n.rowkey, min(o.rowkey) as root
  from node n join reach r on r.a = n.m join node o on o.m = r.b group by n.rowkey),
clusters as (
  select rowkey, cast(dense_rank() over (order by root) - 1 as bigint) as cluster_id
  from component)
"""

#: Nodes in the order of their digests; each is a pivot unless linked to one before it.
_PIVOTS = f"""
{_CLUSTERS[: _CLUSTERS.index("reach(a, b)")]}
ranked as (select m, rowkey, row_number() over (order by md5('42|' || rowkey)) as k from node),
near as (
  select r.k, coalesce(list(o.k) filter (o.k is not null), []::bigint[]) as ks
  from ranked r left join link on link.a = r.m left join ranked o on o.m = link.b group by r.k),
greedy(k, pivots) as (
  select 0::bigint, []::bigint[]
  union all
  select near.k, case when list_has_any(pivots, ks) then pivots else list_append(pivots, near.k) end
  from greedy join near on near.k = greedy.k + 1),
last as (select max_by(pivots, k) as pivots from greedy),
of_pivot as (
  select near.k, case when list_contains(pivots, near.k) then near.k
                      else list_min(list_intersect(ks, pivots)) end as p
  from near, last)
"""

_UDP = """
udp as (select event_id as rowkey, epoch_us(ts) as t, user_id as fm from events)
"""


def _udp_tag(gap: int) -> str:
    order = "partition by fm order by t, rowkey"
    return f"""{_UDP},
spaced as (select *, lag(t) over ({order}) as prev, first_value(t) over ({order}) as first_t
           from udp),
udp_tagged as (
  select rowkey, fm, t, coalesce(last_value(case when t - prev > {gap} then prev end ignore nulls)
    over ({order} rows between unbounded preceding and current row), first_t) as sid_ts
  from spaced)
"""


_PAYLOADS = """
body as (
  select source as m, doc_id as sid, case when doc_id % 2 = 0 then 'forward' else 'back' end
    as direction, hex(encode(text)) as h
  from documents where length(text) > 0),
payloads as (
  select m, sid, direction, substr(h, i + 1, 200) as p
  from (select m, sid, direction, h, unnest(range(0, length(h), 200)) as i from body))
"""

_SHARES = """
plds as (select m, sid, direction, count(*) as plds from payloads group by all),
grams as (
  select m, sid, direction, substr(p, 2 * i + 1, 6) as item
  from (select *, unnest(range(0, length(p) // 2 - 3)) as i from payloads)),
shares as (
  select m, sid, direction, item, count(*) / max(plds) as share
  from grams join plds using (m, sid, direction)
  group by m, sid, direction, item having count(*) / max(plds) between 0.5 and 1.0)
"""

_SETS = """
sizes as (
  select m, direction, ceil(0.2 * count(distinct sid)) as least from payloads group by m, direction),
singles as (
  select m, direction, item, list(sid) as sids, max(least) as least
  from shares join sizes using (m, direction)
  group by m, direction, item having count(*) >= max(least)),
grown as (
  select m, direction, [item] as items, item as last, sids, least from singles
  union all
  select a.m, a.direction, list_append(a.items, b.item), b.item, list_intersect(a.sids, b.sids), a.least
  from grown a join singles b on a.m = b.m and a.direction = b.direction and b.item > a.last
  where len(list_intersect(a.sids, b.sids)) >= a.least),
sets as (select m, direction, items, len(items) as size, len(sids) as freq from grown)
"""


def _with(*steps: str, recursive: bool = False) -> str:
    return f"with {'recursive ' if recursive else ''}" + ",".join(steps) + "\n"


#: The frames of the mixed fixture that decode: TCP packets by rowkey % 12, and all UDP packets.
_MIXED = """
mixed as (
  select rowkey, t, si, sp, di, dp, pr, tcp_flags, seq, ack, pld_len,
    pkt_len + case rowkey % 12 when 1 then 4 when 2 then 8 when 3 then 4 when 4 then 4
                               when 5 then 6 else 0 end as pkt_len,
    case when pld_len > 0 then repeat(lower(lpad(to_hex(rowkey % 251), 2, '0')), pld_len) end as payload
  from packets where rowkey % 12 < 6),
mixed_udp as (
  select -1 - event_id as rowkey, epoch_us(ts) as t, 167772160 + user_id as si, 1024 + user_id as sp,
    2886729729 as di, 53 as dp, 17 as pr from events),
mixed_all as (
  select rowkey, t, si, sp, di, dp, pr, pkt_len, payload from mixed
  union all select *, 50, null from mixed_udp)
"""

_P = (_PACKETS,)
_J3 = (*_P, _HANDSHAKES)
_J4 = (*_J3, _TAGGED)
_W3 = (*_J4, _ORIENTED)
_A1 = (*_W3, _features(), _WIDE)
_S = (*_A1, _KEYS)
_L = (*_S, _LONG)
_A3 = (*_L, _PROFILES)
_T1 = (*_A3, _TOP)
_T2 = (*_T1, _SPLIT, _MATCHED)
_T5 = (*_T1, _CLUSTERS)
_K = (_PAYLOADS, _SHARES)

_DECODED = "t, si, sp, di, dp, pr, tcp_flags, seq, ack, pkt_len, pld_len"

_FRAME_HEX = """
  '0200000000010200000000020800' || '4500' || lower(lpad(to_hex(40 + pld_len), 4, '0'))
  || '000040004006' || '0000' || lower(lpad(to_hex(si), 8, '0')) || lower(lpad(to_hex(di), 8, '0'))
  || lower(lpad(to_hex(sp), 4, '0')) || lower(lpad(to_hex(dp), 4, '0'))
  || lower(lpad(to_hex(seq), 8, '0')) || lower(lpad(to_hex(ack), 8, '0')) || '50'
  || lower(lpad(to_hex(tcp_flags), 2, '0')) || 'ffff00000000'
  || repeat(lower(lpad(to_hex(rowkey % 251), 2, '0')), pld_len)"""


def _spaced(h: str, n: str) -> str:
    byte = f"substr({h}, 2 * i + 1, 2)"
    short = f"case when {byte} like '0%' then substr({byte}, 2) else {byte} end"
    return (
        f"array_to_string(list_transform(range({n}), lambda i: {short}), ' ')"
    )


_IDENTIFY = f"""
identified as (
  select s.rowkey, min(h.id) as id
  from session_keys s left join (
    select l.rowkey, k.id
    from known k join top t on t.m = k.m join long l on l.pos = t.pos
    where {_ratio('t.mean', 'l.value')} between 0.4 and 2.08
    group by l.rowkey, k.id having count(*) >= 8) h on h.rowkey = s.rowkey
  group by s.rowkey)
"""

#: Profiles of clients instead of servers; models are those of customers that are no candidates.
_CLIENTS = (*_A1, _KEYS.replace(_six("max(server)"), _six("max(client)")), _LONG, _PROFILES, _TOP)


def _client_split(candidates: str) -> str:
    return f"""
placed as (
  select distinct m, md5(unhex(m)) as rowkey, cast('0x' || substr(m, 1, 8) as bigint) - 167772160 as c
  from profile),
known as (
  select m, 'WX' || case when c < 1000 then lpad(cast(c as varchar), 3, '0') else cast(c as varchar) end as id
  from placed where not ({candidates})),
candidate as (select m, rowkey from placed where {candidates})
"""


_VECTORS = f"""
profile as (
  select lpad(lower(to_hex(vec_id)), 14, '0') as m, cast(i as int) as pos,
         1.0::double / (1 + (i + vec_id) % 5) as frac, embedding[i + 1]::double as mean
  from (select *, unnest(range(44)) as i from embeddings)),
{_TOP},
placed as (select distinct m, md5(unhex(m)) as rowkey from profile),
known as (
  select m, printf('WX%03d', row_number() over (order by rowkey) - 1) as id
  from placed where substr(rowkey, 1, 1) < '4'),
candidate as (select m, rowkey from placed where substr(rowkey, 1, 1) >= '4')
"""

_VECTOR_NEW = """
fresh as (
  select rowkey, printf('WX%03d', row_number() over (order by rowkey) - 1
      + (select max(cast(substr(id, 3) as bigint)) + 1 from known)) as id
  from matched where id is null)
"""

# Every profile of the split against the known models, for the training job.
_TRAINED = f"""
every as (
  select c.rowkey, min(h.id) as id
  from placed c left join (
    select p.m, k.id
    from known k join top t on t.m = k.m join profile p on p.pos = t.pos
    where {_ratio('p.mean', 't.mean')} between 0.4 and 2.09
    group by p.m, k.id having count(*) >= 8) h on h.m = c.m
  group by c.rowkey),
opened as (
  select rowkey, 'WX' || lpad(cast(
      row_number() over (order by rowkey) - 1
      + (select max(cast(substr(id, 3) as int)) + 1 from known) as varchar), 3, '0') as id
  from every where id is null)
"""

_BEST = """
ranked as (
  select m, direction, items, row_number() over (
    partition by m, direction order by freq desc, size desc, items) as place from sets),
chosen as (
  select distinct m, direction, unnest(items) as item from ranked where place <= 10)
"""

_STARTS_ANY = """
any_starts as (
  select distinct s.lo, s.hi, s.pr, s.t as start_ts
  from packets s
  join packets a on a.lo = s.lo and a.hi = s.hi and a.pr = s.pr and a.src = s.dst and a.dst = s.src
    and a.tcp_flags = 18 and a.ack = s.seq + 1 and a.t >= s.t
  join packets k on k.lo = s.lo and k.hi = s.hi and k.pr = s.pr and k.src = s.src and k.dst = s.dst
    and k.tcp_flags = 16 and k.ack = a.seq + 1 and k.seq = a.ack and k.t >= a.t
  where s.tcp_flags = 2)
"""

_SESSIONS = "(select lo, hi, pr, sid_ts, count(*) as packets from tagged group by all)"


def _label(lo: str, hi: str) -> str:
    def show(x: str) -> str:
        bits = f"(case when {x} < 0 then {x} + 281474976710656 else {x} end)"
        return " || ".join(
            [f"(({bits} >> {s}) & 255)::varchar || '{sep}'"
             for s, sep in ((40, "."), (32, "."), (24, "."), (16, ":"))]
            + [f"({bits} & 65535)::varchar"]
        )

    return f"{show(hi)} || '-' || {show(lo)}"


def _endpoint(x: str) -> str:
    return _label(x, x).split(" || '-' || ")[0] + " || '-' || pr::varchar"


_SESSION_COLUMNS = ", ".join(["lo", "hi", "pr", "sid_ts", *_NAMES])
_T8 = "lo, hi, pr, sid_ts"

ORACLES: dict[str, str] = {
    "s1_scan_project": "select c_custkey, c_name from customer",
    "s2_capture_ingest": _with(*_P) + f"select {_DECODED} from packets",
    "s4_table_write": _with(*_P) + "select rowkey, t, pkt_len from packets",
    "s5_catalog_write": """select cast(c_custkey as varchar) as key, c_name as r, '01' as p
        from customer""",
    "s7_preview": _with(*_P)
    + f"""select {_spaced("lpad(lower(to_hex(rowkey)), 16, '0')", "8")} as rowkey,
        {_spaced("h", "length(h) // 2")} as r
      from (select rowkey, {_FRAME_HEX} as h from packets order by rowkey limit 2)""",
    "p1_five_tuple": _with(*_P, _MIXED) + "select rowkey, t, si, sp, di, dp, pr from mixed_all",
    "x1_decode_succeeded": _with(*_P, _MIXED) + "select rowkey, t, pkt_len as n_bytes from mixed_all",
    "p2_canonical_mark": _with(*_P) + f"select rowkey, {_FM} as fm from packets",
    "p3_packet_features": _with(*_P, _MIXED)
    + """select rowkey, dp as dport, sp as sport, pr as proto, tcp_flags, seq, ack, pkt_len, pld_len,
        coalesce(payload, '00') as payload from mixed""",
    "p4_packet_direction": _with(*_P)
    + """select rowkey, si as sip, sp as sport, di as dip, dp as dport, pr as proto from packets""",
    "p5_tcp_payload": _with(*_P, _MIXED) + "select rowkey, payload as tcp_payload from mixed_all",
    "p6_literal": "select c_custkey, '01' as p from customer",
    "p7_features_long": _with(*_L) + "select rowkey, pos, name, value from long",
    "p8_feature_columns": _with(*_L)
    + f"""select m, pos, name, count(*) as n, {_sig('sum(value)')} as total
        from long group by m, pos, name""",
    "x2_udp_only": f"with {_UDP} select rowkey, t, 17 as pr from udp",
    "x3_handshake_candidates": _with(*_P)
    + "select rowkey, tcp_flags from packets where tcp_flags in (2, 18, 16)",
    "x4_stop_packets": _with(*_P)
    + "select rowkey, t, tcp_flags from packets where tcp_flags & 5 <> 0",
    "x5_non_null": _with(*_J4) + "select rowkey, sid_ts from tagged",
    "x6_key_filter": "select c_custkey, c_name from customer where c_custkey = 42",
    "x6_session_lookup": _with(*_W3, _KEYS)
    + """select rowkey, cast(client & 65535 as int) as sport, cast(server & 65535 as int) as dport, sid_ts
      from session_keys where least(client & 65535, server & 65535) % 2 = 0
        and greatest(client & 65535, server & 65535) % 50 = 0""",
    "x7_prefix_filter": "select p_partkey, p_type from part where starts_with(p_type, 'S')",
    "x8_range": _with(*_P)
    + """select rowkey, pld_len::double / pkt_len as ratio from packets
        where pld_len::double / pkt_len between 0.5 and 1.0""",
    "j1_handshake_join": _with(*_P, _STARTS_ANY) + "select lo, hi, pr, start_ts from any_starts",
    "j2_asof_tag": _with(*_P, _STARTS_ANY)
    + """select p.rowkey, s.start_ts as sid_ts from packets p asof join any_starts s
        on p.lo = s.lo and p.hi = s.hi and p.pr = s.pr and p.t >= s.start_ts""",
    "j3_tcp_handshakes": _with(*_J3) + "select lo, hi, pr, start_ts from starts",
    "j4_tcp_sessions": _with(*_J4) + f"select rowkey, sid_ts, {_SID} as sid from tagged",
    "j6_key_merge": _with(*_J4)
    + """select p.rowkey, p.t, p.pkt_len, g.sid_ts
        from packets p left join tagged g using (rowkey)""",
    "j6_keyed_upsert": _with(*_P)
    + """select rowkey, case when rowkey % 3 <> 1 then t + 1 else t end as t,
          case when rowkey % 3 <> 0 then pkt_len end as pkt_len,
          case when rowkey % 3 <> 1 and pld_len <> 0 then pld_len end as pld_len,
          case when rowkey % 3 <> 1 then tcp_flags end as tcp_flags
        from packets""",
    "j6_bucketed_merge": _with(*_J4)
    + """select p.rowkey, p.t, p.pkt_len, g.sid_ts
        from packets p left join tagged g using (rowkey)""",
    "u1_union_assignments": _with(*_T2, _NEW)
    + """select rowkey, id from fresh
        union all select rowkey, id from matched where id is not null""",
    "u2_markers": _with(*_J3)
    + """select lo, hi, pr, 0 as kind, start_ts as t from starts
        union all select lo, hi, pr, 1, t from packets where tcp_flags & 5 <> 0""",
    "u3_distinct": _with(*_J4) + "select distinct lo, hi, pr, sid_ts from tagged",
    "w1_udp_sessions": f"with {_udp_tag(21600000000)} select rowkey, fm, sid_ts from udp_tagged",
    "w1_udp_sessions_60us": f"with {_udp_tag(60)} select rowkey, fm, sid_ts from udp_tagged",
    "w2_interarrival": _with(*_W3) + "select rowkey, iat from oriented",
    "w3_direction": _with(*_W3)
    + f"""select rowkey, case when src_lo = first_lo then 'forward' else 'back' end as direction,
        {_six('server')} || '06' as m from oriented""",
    "w4_client_side": _with(*_W3) + "select rowkey, src_lo = first_lo as client_sent from oriented",
    "w5_duration": _with(*_J4)
    + "select lo, hi, pr, sid_ts, max(t) - min(t) as sessn_dur from tagged group by all",
    "a1_session_features": _with(*_A1) + f"select {_SESSION_COLUMNS} from wide",
    "a1_session_features_corrected": _with(*_W3, _features(corrected=True), _WIDE)
    + """select lo, hi, pr, sid_ts, var_pkt_len, sc_var_pkt_len, cs_var_pkt_len from wide""",
    "a1_session_table": _with(*_W3, _KEYS)
    + f"""select rowkey, cast(client & 65535 as int) as sport, cast(server & 65535 as int) as dport,
        {_six('client')} || {_six('server')} || '06' as direction, m, 44 as names,
        '{",".join(_NAMES)}' as features_name
      from session_keys""",
    "a2_direction_stats": _with(*_W3, _features())
    + f"select lo, hi, pr, sid_ts, side, {', '.join(_SIDE)} from sides",
    "a3_profiles": _with(*_A3)
    + f"select m, pos, name, frac, {_sig('mean')} as mean from profile",
    "t1_top_features": _with(*_T1)
    + f"select m, rank, pos, name, frac, {_sig('mean')} as mean from top",
    "t2_model_match": _with(*_T2) + "select rowkey, id from matched",
    "t2_model_match_large": _with(*_CLIENTS, _client_split("c % 10 = 0"), _MATCHED)
    + "select rowkey, id from matched",
    "t3_new_models": _with(*_CLIENTS, _client_split("c % 50 <> 0"), _MATCHED, _VECTOR_NEW)
    + "select rowkey, id from fresh",
    "t4_identify": _with(*_T1, _SPLIT, _IDENTIFY) + "select rowkey, id from identified",
    "t4_identify_large": _with(*_CLIENTS, _client_split("c % 10 <> 0"), _IDENTIFY)
    + "select rowkey, id from identified",
    "t5_profile_clusters": _with(*_T5, recursive=True) + "select rowkey, cluster_id from clusters",
    "t2_vector_match": _with(_VECTORS, _MATCHED) + "select rowkey, id from matched",
    "t3_vector_models": _with(_VECTORS, _MATCHED, _VECTOR_NEW) + "select rowkey, id from fresh",
    "t5_vector_clusters": _with(_VECTORS, _CLUSTERS, recursive=True)
    + "select rowkey, cluster_id from clusters",
    "t5_pivot_clusters": _with(_VECTORS, _PIVOTS, recursive=True)
    + """select r.rowkey, o.rowkey as pivot, cast(dense_rank() over (order by o.rowkey) - 1 as bigint) as cluster_id
      from of_pivot join ranked r using (k) join ranked o on o.k = of_pivot.p""",
    "a11_cluster_sizes": _with(_VECTORS, _CLUSTERS, recursive=True)
    + "select cluster_id, rowkey, count(*) over (partition by cluster_id) as members from clusters",
    "train_job": _with(*_T1, _SPLIT, _TRAINED)
    + """select rowkey, id from opened
        union all select rowkey, id from every where id is not null""",
    "a4_session_report": _with(*_J4)
    + f"""select
        (select count(*) from packets) as packets,
        (select count(*) from (select distinct lo, hi, pr from packets)) as flows,
        count(*) as sessions, cast(sum(packets) as bigint) as tagged_packets,
        count(*) / count(distinct (lo, hi, pr)) as sessions_per_flow,
        (select max(n) from (select count(*) as n from {_SESSIONS} group by lo, hi, pr))
          as max_sessions_per_flow,
        min(packets) as min_packets_per_session, max(packets) as max_packets_per_session
      from {_SESSIONS}""",
    "t8_extreme_sessions": _with(*_J4)
    + f"""select kind, {_label('lo', 'hi')} || '_' || sid_ts as session, packets from (
        (select 'longest' as kind, * from {_SESSIONS} order by packets desc, {_T8} limit 1)
        union all
        (select 'shortest', * from {_SESSIONS} order by packets, {_T8} limit 1))""",
    "a5_udp_report": f"with {_udp_tag(21600000000)}"
    + """select count(*) as packets, count(distinct fm) as flows,
        count(distinct (fm, sid_ts)) as sessions, count(sid_ts) as tagged_packets
      from udp_tagged""",
    "a6_sessions_per_endpoint": _with(*_W3, _KEYS)
    + f"""select {_endpoint('server')} as endpoint, count(*) as sessions
        from session_keys group by server, pr""",
    "a7_distinct_endpoints": _with(*_W3, _KEYS) + "select distinct m from session_keys",
    "a7_endpoint_digest": _with(*_W3, _KEYS)
    + """select distinct cast(server & 65535 as int) as port, md5(unhex(m)) as digest
        from session_keys""",
    "a8_endpoint_directions": f"with {_PAYLOADS} select distinct m, direction from payloads",
    "a9_keyword_share": _with(*_K) + "select m, sid, direction, item, share from shares",
    "a10_counters": _with(*_J4)
    + """select count(*) as packets, count(*) filter (tcp_flags = 2) as syn,
        count(*) filter (tcp_flags = 18) as syn_ack, count(*) filter (tcp_flags = 16) as ack,
        (select count(*) from starts) as handshakes, (select count(*) from tagged) as tagged_packets
      from packets""",
    "a10_job_counters": _with(*_J4)
    + """select count(*) as packets, count(*) filter (tcp_flags = 2) as syn,
        count(*) filter (tcp_flags = 18) as syn_ack, count(*) filter (tcp_flags = 16) as ack,
        (select count(*) from starts) as handshakes, (select count(*) from tagged) as tagged_packets
      from packets""",
    "t7_first_rows": _with(*_P)
    + "select rowkey, t, pkt_len from packets order by rowkey limit 10",
    "n1_frequent_sets": _with(*_K, _SETS, recursive=True)
    + "select m, direction, array_to_string(items, ',') as items, size, freq from sets",
    "n1_fpgrowth_full": _with(*_K, _SETS, recursive=True)
    + "select m, direction, array_to_string(items, ',') as items, size, freq from sets",
    "n1_level_sets": _with(*_K, _SETS, recursive=True)
    + "select m, direction, array_to_string(items, ',') as items, size, freq from sets where size <= 3",
    "n1_closed_sets": _with(*_K, _SETS, recursive=True)
    + """select m, direction, array_to_string(max_by(items, len(items)), ',') as items,
        max(len(items)) as size, len(any_value(sids)) as freq
      from grown group by m, direction, list_sort(sids)""",
    "n2_sample": _with(*_K)
    + """select distinct m, sid, direction from payloads
      where ('0x' || substr(md5('42|' || m || '|' || sid || '|' || direction), 1, 8))::bigint
            % 1000000 < 50000""",
    "n3_keywords": _with(*_K, _SETS, _BEST, recursive=True)
    + """select md5(m) as rowkey, m, direction,
        array_to_string(list_transform(list_sort(list(item)), lambda x: base64(unhex(x))), ',')
          as keywords
      from chosen group by m, direction""",
    "f_hash": _with(*_P)
    + f"""select rowkey, md5(unhex(fm)) as digest, base64(unhex(fm)) as b64, fm as back
        from (select rowkey, {_FM} as fm from packets)""",
    "f_bytes": _with(*_P)
    + f"""select rowkey, substr(fm, 9, 4) as port_slice, lower(lpad(to_hex(t), 16, '0')) as t8,
        {_spaced('fm', '13')} as spaced,
        array_to_string(list_transform(range(13), lambda i:
          case when cast('0x' || substr(fm, 2 * i + 1, 2) as int) between 32 and 126
               then chr(cast('0x' || substr(fm, 2 * i + 1, 2) as int))
               else '\\x' || substr(fm, 2 * i + 1, 2) end), '') as shown,
        si * 65536 + sp as source_unsigned, src as source_signed, t as t_again
      from (select *, {_FM} as fm from packets)""",
    "f_labels": _with(*_P)
    + f"""select rowkey, (si >> 24) || '.' || ((si >> 16) & 255) || '.' || ((si >> 8) & 255)
        || '.' || (si & 255) as sip, {_endpoint('dst')} as endpoint,
        'WX' || case when sp % 2000 < 1000 then lpad(cast(sp % 2000 as varchar), 3, '0')
                     else cast(sp % 2000 as varchar) end as id
      from packets""",
    "f_ratio": _with(*_P)
    + f"""select rowkey, {_ratio('a', 'b')} as ratio, t // pkt_len as truncated,
        sqrt(pow(a, 2)) as root, xor(pkt_len, 2) as flipped
      from (select *, pld_len::double as a,
              case when tcp_flags <> 2 then (pkt_len - 154)::double end as b from packets)""",
    "f11_trigrams": _with(*_K)
    + "select m, item, count(*) as n from grams group by m, item",
    "f12_byte_slices": f"with {_PAYLOADS}"
    + """select substr(p, 2 * i + 1, 4) as item, count(*) as n
        from (select p, unnest(range(0, length(p) // 2 - 1)) as i from payloads) group by 1""",
    "sql_endpoints": _with(*_W3, _KEYS)
    + f"""select {_endpoint('server')} as endpoint, count(*) as sessions
        from session_keys group by server, pr""",
    "sql_flow_ratios": _with(*_P)
    + f"""select rowkey, (si >> 24) || '.' || ((si >> 16) & 255) || '.' || ((si >> 8) & 255)
          || '.' || (si & 255) as sip, {_FM} as fm, {_ratio('pld_len::double', '(pkt_len - 154)::double')} as ratio
        from packets where pld_len > 0""",
    "k1_stream_ingest": _with(*_P)
    + """select md5(unhex(lpad(to_hex(t), 16, '0'))) || '00000000'
          || lower(lpad(to_hex(rowkey), 16, '0')) as rowkey, t, pkt_len
        from packets""",
    "k3_keyed_stream": _with(*_P)
    + """select md5(unhex(lpad(to_hex(t), 16, '0'))) || '00000000'
          || lower(lpad(to_hex(rowkey), 16, '0')) as rowkey, t, pkt_len
        from packets""",
    "preprocess_job": _with(*_W3)
    + f"""select p.rowkey, p.fm, g.sid, g.direction, g.m
      from (select rowkey, {_FM} as fm from packets) p left join (
        select rowkey, {_SID} as sid, {_six('server')} || '06' as m,
          case when src_lo = first_lo then 'forward' else 'back' end as direction
        from oriented) g using (rowkey)""",
}
