"""DuckDB oracle SQL for the alert views (rule-scored flow records)."""

from __future__ import annotations

from flowlens import constants as K
from flowlens.plans import fixed_forest as FF
from flowlens.plans import oracle_explain_sql as OX
from flowlens.plans import oracle_sql as O
from flowlens.plans.alerting import DEFAULT_NODE_IP
from flowlens.plans.oracle_prep_sql import RULE_SQL

_THREAT = "lower(prediction) not in ('normal', '0')"
_TS = "strftime(alert_ts, '%Y-%m-%d %H:%M:%S')"


def _cte(window: str = "day", span: str = "1 day", node: str = f"'{DEFAULT_NODE_IP}'") -> str:
    return "with " + O._flows_body(window) + f""",
rec as (select {O._record_select()} from flow_feat),
scored as (select window_start as batch, flow_seq as seq, window_start + interval '{span}' as alert_ts,
                  {node} as node_ip, src_ip, dst_ip, {RULE_SQL} as prediction,
                  same_srv_rate as confidence from rec),
firsts as (select batch, min(seq) as fs from scored group by batch),
gated as (select s.* from scored s join firsts f using (batch) where {_THREAT} or s.seq = f.fs),
alerts as (select substr(sha256(concat_ws('|', node_ip, {_TS}, cast(seq as varchar))), 1, 8) as id,
                  node_ip, src_ip, dst_ip, {_TS} as timestamp, alert_ts as ts, seq, prediction, confidence
           from gated)
"""


def alerts_sql() -> str:
    return _cte() + "select * from alerts"


def buffer_sql(n: int = K.ALERT_BUFFER_SIZE) -> str:
    return _cte() + f"select * from alerts order by ts desc, seq desc limit {n}"


def _dash(n: int, cleared_at: str | None = None) -> str:
    where = f"where ts > timestamp '{cleared_at}'" if cleared_at else ""
    return f"""dash as (select id, timestamp, node_ip, src_ip, dst_ip, prediction, confidence,
    case when {_THREAT} then 'MALICIOUS' else 'NORMAL' end as threat_class,
    case when {_THREAT} and confidence > {K.HIGH_CONFIDENCE} then 'red'
         when {_THREAT} then 'yellow' else 'green' end as severity,
    case when {_THREAT} then 'DETECTED: ' || upper(prediction) else 'NORMAL_TRAFFIC' end as display_label,
    printf('%.1f', confidence * 100.0) as confidence_pct,
    concat_ws(' ', src_ip, dst_ip, node_ip) as ips
  from (select * from alerts {where} order by ts desc, seq desc limit {n}))"""


def dashboard_sql(n: int = K.DASHBOARD_ROWS) -> str:
    return _cte() + ", " + _dash(n) + " select * from dash"


def dashboard_filtered_sql(threat_class: str, ip_query: str, n: int = K.DASHBOARD_ROWS) -> str:
    return (_cte() + ", " + _dash(n) +
            f" select * from dash where threat_class = '{threat_class}' "
            f"and contains(lower(ips), '{ip_query.lower()}')")


def kpis_sql(cleared_at: str | None = None) -> str:
    where = f"where ts > timestamp '{cleared_at}'" if cleared_at else ""
    return _kpis(_cte(), where)


def _kpis(cte: str, where: str = "") -> str:
    return cte + (f"select count(*) as total_alerts, count(*) filter (where {_THREAT}) as threats, "
                     f"count(distinct node_ip) as nodes from alerts {where}")


def _sensors() -> str:
    return _cte("4 seconds", "4 seconds", "'192.0.2.' || string_split(src_ip, '.')[-1]")


def sensor_kpis_sql() -> str:
    return _kpis(_sensors())


def sensor_status_sql() -> str:
    return node_status_sql(_sensors())


def node_status_sql(cte: str | None = None) -> str:
    return (cte or _cte()) + f""", last as (select node_ip, max(ts) as last_seen from alerts group by node_ip),
aged as (select *, cast(floor((epoch_us(max(last_seen) over ()) - epoch_us(last_seen)) / 1e6) as bigint)
                as age_seconds from last)
select node_ip, last_seen, age_seconds,
       case when age_seconds < {K.ONLINE_SECONDS} then 'ONLINE' else 'AWAY' end as status from aged"""


def batch_summary_sql() -> str:
    return _cte() + (f"select batch, count(*) as n_flows, count(*) filter (where {_THREAT}) as n_threats "
                     "from scored group by batch")


def verdicts_sql() -> str:
    return _cte() + "select batch, seq, src_ip, dst_ip, prediction from scored"


# -- scored and explained by the fixed forest -----------------------------------

def _forest_cte(text: str) -> str:
    """``alerts`` with ``features_text``: the three largest impacts, each as
    ``text`` (SQL over phi), largest first."""
    return "with " + O._flows_body("day") + f""",
rec as (select {O._record_select()} from flow_feat),
fx as (select window_start as batch, flow_seq as seq, window_start + interval 1 day as alert_ts,
              '{DEFAULT_NODE_IP}' as node_ip, src_ip, dst_ip, {", ".join(FF.FEATURES)} from rec),
{OX.explain_ctes("fx")},
firsts as (select batch, min(seq) as fs from vp group by batch),
gated as (select vp.* from vp join firsts using (batch) where {_THREAT} or seq = fs),
tops as (select rid, string_agg(feature || ':' || {text}, ' ' order by step) as features_text
         from imp where step <= {K.TOP_IMPACTS} group by rid),
alerts as (select substr(sha256(concat_ws('|', node_ip, {_TS}, cast(seq as varchar))), 1, 8) as id,
                  node_ip, src_ip, dst_ip, {_TS} as timestamp, alert_ts as ts, seq, prediction,
                  round(confidence, {FF.DIGITS}) as confidence, features_text from gated join tops using (rid))
"""


def forest_alerts_sql() -> str:
    return _forest_cte("cast(cast(round(phi, 6) as decimal(9, 6)) as varchar)") + "select * from alerts"


def forest_dashboard_sql(n: int = K.DASHBOARD_ROWS) -> str:
    body = _forest_cte("printf('%.2f', phi)") + ", " + _dash(n)
    return body.replace("as ips\n", "as ips, features_text\n") + " select * from dash"
