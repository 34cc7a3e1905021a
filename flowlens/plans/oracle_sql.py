"""DuckDB SQL for every SQL-expressible registered query.

Written independently of the Spark code (e.g. the first packet of a flow is
found with ``row_number()`` here, with ``min_by`` in Spark) so that the two
cross-check each other. Tables are the pre-registered views of the driver.
"""

from __future__ import annotations

from flowlens import constants as K

# -- stand-in views (FIXTURES.md §3) -------------------------------------------

PACKETS_CTE = """
pk_b as (select event_id, ts, user_id, event_type,
                cast(round(value*10) as bigint)+40 as bytes,
                cast(json_extract_string(props,'$.k') as int) k from events),
pk_e as (select *,
  case event_type when 'signup' then 'udp' when 'error' then 'icmp' else 'tcp' end proto,
  '10.0.0.'||(user_id%3) c_ip, '10.0.1.'||(k%3) s_ip,
  case when event_type='error' then 0 else 40000+(user_id%3) end c_port,
  case when event_type='error' then 0 else
    case k%4 when 0 then 80 when 1 then 21 when 2 then 53 else 8080 end end s_port from pk_b),
packets as (select event_id, ts, proto, bytes,
  case when event_id%3=0 then s_ip else c_ip end ip_src,
  case when event_id%3=0 then c_ip else s_ip end ip_dst,
  cast(case when event_id%3=0 then s_port else c_port end as int) port_src,
  cast(case when event_id%3=0 then c_port else s_port end as int) port_dst,
  case when proto='tcp' then case event_id%6 when 0 then 'SA' when 1 then 'S' when 2 then 'A'
       when 3 then 'PA' when 4 then 'R' else 'FA' end else '' end tcp_flags,
  case when k<10 then '530 Login incorrect' when k<15 then 'USER anonymous' else 'x' end payload
from pk_e)
"""


DENSE_PACKETS_CTE = """
packets as (select cast(((l_orderkey*8+l_linenumber)*1000000+l_partkey)*10000+l_suppkey as bigint) event_id,
  timestamp '2024-03-01 00:00:00' + to_seconds((l_orderkey%20)*86400 + (l_partkey+l_suppkey)%86400) ts,
  case l_suppkey%10 when 0 then 'udp' when 1 then 'icmp' else 'tcp' end proto,
  cast(trunc(l_quantity) as bigint) bytes,
  '10.0.1.'||(l_suppkey%7) ip_src, '10.0.1.'||(l_orderkey%3) ip_dst,
  cast(case when l_suppkey%10=1 then 0 else 1024+l_partkey%60000 end as int) port_src,
  cast(case when l_suppkey%10=1 then 0 else case l_linenumber%3 when 0 then 22 when 1 then 80 else 443 end end as int) port_dst,
  case when l_suppkey%10 in (0, 1) then '' else
    case l_linenumber when 1 then 'S' when 2 then 'R' when 3 then 'SA' else 'FA' end end tcp_flags,
  case l_partkey%40 when 0 then '401 Unauthorized' when 1 then 'guest login ok' else 'x' end payload
from lineitem)
"""


def _svc_case(port: str, proto: str) -> str:
    whens = " ".join(f"when {p} then '{s}'" for p, s in K.PORT_SERVICE.items())
    return (f"case when {proto}='icmp' then '{K.ICMP_SERVICE}' else "
            f"case {port} {whens} else '{K.DEFAULT_SERVICE}' end end")


def _any_marker(text: str, markers) -> str:
    return "(" + " or ".join(f"contains({text}, '{m}')" for m in markers) + ")"


def _window_expr(window: str) -> str:
    """DuckDB window start: ``date_trunc`` for calendar units, ``time_bucket``
    for an interval such as '4 seconds' (its default origin, 2000-01-03, is a
    whole number of such buckets after the epoch, as Spark's windows are)."""
    if " " in window:
        return f"time_bucket(interval '{window}', ts)"
    return f"date_trunc('{window}', ts)"


def _flows_body(window: str = "day", packets: str = PACKETS_CTE) -> str:
    """CTEs ``packets``, ``flows`` and ``flow_feat`` (window counters by
    window functions, the plain formulation)."""
    return packets + f""",
pk_k as (select *, {_window_expr(window)} as window_start,
   least(ip_src||':'||port_src, ip_dst||':'||port_dst) ep_lo,
   greatest(ip_src||':'||port_src, ip_dst||':'||port_dst) ep_hi,
   lower(payload) ptxt from packets),
pk_r as (select *, row_number() over (partition by window_start, ep_lo, ep_hi, proto
                                       order by event_id) rn,
                   row_number() over (partition by window_start, ep_lo, ep_hi, proto
                                       order by event_id desc) rn_last from pk_k),
pk_first as (select window_start, ep_lo, ep_hi, proto, ip_src f_src, ip_dst f_dst,
                    port_src f_sport, port_dst f_dport, ts f_ts from pk_r where rn = 1),
pk_last as (select window_start, ep_lo, ep_hi, proto, ts l_ts from pk_r where rn_last = 1),
flows as (
  select p.window_start, min(p.event_id) as flow_seq, any_value(h.f_ts) start_time, any_value(l.l_ts) end_time,
    count(*) n_packets,
    p.proto as protocol_type,
    {_svc_case('h.f_dport', 'p.proto')} as service,
    h.f_src as ip_src, h.f_dst as ip_dst, h.f_sport as port_src, h.f_dport as port_dst,
    cast(sum(case when p.ip_src = h.f_src then p.bytes else 0 end) as bigint) as src_bytes,
    cast(sum(case when p.ip_src = h.f_src then 0 else p.bytes end) as bigint) as dst_bytes,
    case when p.proto <> 'tcp' then 'SF'
         when bool_or(contains(p.tcp_flags,'S')) and bool_or(contains(p.tcp_flags,'F')) then 'SF'
         when bool_or(contains(p.tcp_flags,'S')) and bool_or(contains(p.tcp_flags,'R')) then 'REJ'
         when bool_or(contains(p.tcp_flags,'S')) and not bool_or(contains(p.tcp_flags,'A'))
              and not bool_or(contains(p.tcp_flags,'F'))
              and not bool_or(contains(p.tcp_flags,'R')) then 'S0'
         when bool_or(contains(p.tcp_flags,'R')) then 'RSTR' else 'SF' end as flag,
    cast(sum(case when {_any_marker('p.ptxt', K.FAILED_LOGIN_MARKERS)} then 1 else 0 end) as bigint)
      as num_failed_logins,
    cast(max(case when {_any_marker('p.ptxt', K.GUEST_LOGIN_MARKERS)} then 1 else 0 end) as int)
      as is_guest_login
  from pk_k p join pk_first h on h.window_start = p.window_start and h.ep_lo = p.ep_lo
                   and h.ep_hi = p.ep_hi and h.proto = p.proto
              join pk_last l on l.window_start = p.window_start and l.ep_lo = p.ep_lo
                   and l.ep_hi = p.ep_hi and l.proto = p.proto
  group by p.window_start, p.ep_lo, p.ep_hi, p.proto, h.f_src, h.f_dst, h.f_sport, h.f_dport
),
flow_feat as (
  select f.*,
    count(*) over (partition by window_start, ip_dst) as cnt,
    count(*) over (partition by window_start, ip_dst, service) as srv,
    sum(case when flag='S0' then 1 else 0 end) over (partition by window_start, ip_dst) as s0,
    sum(case when flag='REJ' then 1 else 0 end) over (partition by window_start, ip_dst) as rej
  from flows f
)
"""


FLOWS_COLUMNS = ["window_start", "flow_seq", "start_time", "end_time", "n_packets", "protocol_type",
                 "service", "ip_src", "ip_dst", "port_src", "port_dst", "src_bytes",
                 "dst_bytes", "flag", "num_failed_logins", "is_guest_login"]


def flows_sql(window: str = "day", packets: str = PACKETS_CTE) -> str:
    return "with " + _flows_body(window, packets) + f"select {', '.join(FLOWS_COLUMNS)} from flows"


def _record_select() -> str:
    d = "greatest(1.0::double, cnt::double)"
    ser = f"(s0::double / {d})"
    rer = f"(rej::double / {d})"
    ss = f"(srv::double / {d})"
    v = {
        "duration": "greatest(0.0::double, (epoch_us(end_time) - epoch_us(start_time)) / 1e6::double)",
        "protocol_type": "protocol_type", "service": "service", "flag": "flag",
        "src_bytes": "src_bytes::double", "dst_bytes": "dst_bytes::double",
        "land": "case when ip_src = ip_dst then 1.0::double else 0.0::double end",
        "num_failed_logins": "num_failed_logins::double",
        "is_guest_login": "is_guest_login::double",
        "count": f"least({K.COUNT_CAP}::double, cnt::double)",
        "srv_count": f"least({K.COUNT_CAP}::double, srv::double)",
        "serror_rate": ser, "srv_serror_rate": ser,
        "rerror_rate": rer, "srv_rerror_rate": rer,
        "same_srv_rate": ss, "diff_srv_rate": f"(1.0::double - {ss})",
        "dst_host_count": f"least({K.DST_HOST_COUNT_CAP}::double, cnt::double)",
        "dst_host_srv_count": f"least({K.DST_HOST_COUNT_CAP}::double, srv::double)",
        "dst_host_same_srv_rate": ss, "dst_host_diff_srv_rate": f"(1.0::double - {ss})",
        "dst_host_same_src_port_rate": f"(1.0::double / {d})",
        "dst_host_srv_diff_host_rate": "0.0::double",
        "dst_host_serror_rate": ser, "dst_host_srv_serror_rate": ser,
        "dst_host_rerror_rate": rer, "dst_host_srv_rerror_rate": rer,
    }
    cols = [f"{v.get(c, '0.0::double')} as {c}" for c in K.ATTRIBUTE_COLUMNS]
    return "window_start, flow_seq, ip_src as src_ip, ip_dst as dst_ip, " + ", ".join(cols)


def flow_records_sql(window: str = "day", packets: str = PACKETS_CTE) -> str:
    return "with " + _flows_body(window, packets) + f"select {_record_select()} from flow_feat"
