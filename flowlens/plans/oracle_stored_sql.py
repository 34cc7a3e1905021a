"""DuckDB oracle SQL for what is written and read back (plans/stored.py)."""

from __future__ import annotations

from flowlens import constants as K
from flowlens.plans import oracle_alert_sql as OA
from flowlens.plans import oracle_prep_sql as OP
from flowlens.plans import oracle_sql as O
from flowlens.plans import stored as ST
from flowlens.plans.alerting import DEFAULT_NODE_IP
from flowlens.sources.records import ROW_KEY


def csv_records_sql() -> str:
    return "with " + OP.RECORDS_CTE + f"select {', '.join(K.ATTRIBUTE_COLUMNS)}, label from lab"


def processed_table_sql() -> str:
    def column(c: str) -> str:
        if c in K.NUMERIC_COLUMNS:
            return c
        return f"case when coalesce(contains(',' || onehot_active || ',', ',{c},'), false) then 1.0 else 0.0 end::double"

    cols = ", ".join(f"{column(c)} as f{i}" for i, c in enumerate(ST.READ_BACK))
    return "with " + OP.ENCODED_CTE + f"select {cols}, 0.0::double as f{len(ST.READ_BACK)}, label from enc where is_test"


def linear_attribution_sql() -> str:
    means = ", ".join(f"avg({c}) as m_{c}" for c in ST.COEFFICIENTS)
    base = " + ".join([str(ST.INTERCEPT), *(f"{k} * m_{c}" for c, k in ST.COEFFICIENTS.items())])
    margin = " + ".join([str(ST.INTERCEPT), *(f"{k} * {c}" for c, k in ST.COEFFICIENTS.items())])
    rows = " union all ".join(f"select {', '.join(ROW_KEY)}, '{c}' as feature, round({k}::double * ({c} - m_{c}), 6) + 0.0 as impact, round(({base})::double, 6) as base, "
                              f"round(({margin})::double, 6) as margin from sp, mean where is_test" for c, k in ST.COEFFICIENTS.items())
    return "with " + OP.RECORDS_CTE + f", mean as (select {means} from tr) " + rows


def stored_alerts_sql() -> str:
    return OA._cte() + f"select * from alerts where ts > timestamp '{ST.CLEARED_AT}'"


def request_records_sql() -> str:
    return ("with " + O._flows_body("day") + f", rec as (select {O._record_select()} from flow_feat) select '{DEFAULT_NODE_IP}' as node_ip, src_ip, dst_ip, "
            f"strftime(window_start, '%Y-%m-%d %H:%M:%S') as timestamp, {', '.join(K.ATTRIBUTE_COLUMNS)} from rec")


NORMALIZED_PACKETS = """
with raw as (select event_id, ts, event_id % 4 = 0 as t, event_id % 6 = 1 as u, event_id % 3 = 2 as i, user_id, event_type from events where event_id % 7 <> 0)
select event_id, ts, case when t then 'tcp' when u then 'udp' when i then 'icmp' else 'other' end as proto, (event_id % 1500 + 40)::bigint as bytes,
       '10.0.0.' || (user_id % 250)::varchar as ip_src, '10.0.1.1' as ip_dst, case when t or u then event_id % 60000 else 0 end::int as port_src,
       case when t or u then 80 else 0 end::int as port_dst, case when t and event_id % 8 <> 0 then 'S' else '' end as tcp_flags, event_type as payload from raw
"""


def request_stream_sql() -> str:
    return "with " + O._flows_body("day") + "select window_start, count(*) as n, count(*) as n_holds from flow_feat group by window_start"


def capture_packets_sql() -> str:
    return "with " + O.PACKETS_CTE + "select ts, proto, bytes, ip_src, ip_dst, port_src, port_dst, tcp_flags, payload from packets"
