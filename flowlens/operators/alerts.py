"""Alert gating, alert records, alert buffer, dashboard views and KPIs.

Input: scored rows with ``batch`` (window start), ``seq`` (capture order in
the batch), node/src/dst IPs, ``prediction`` and ``confidence``.

* P19 "threat, or the first row of its batch": the smallest ``seq`` of each
  batch, an aggregation with map-side combine that moves one number per batch
  and task, is joined back on (batch, seq).
* T3/T4 keep the newest N alerts: ``orderBy(...).limit(N)`` is a per-partition
  top-N then a merge of N·partitions rows — the limit is the feature.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import scalar as S


def gate(scored: DataFrame, batch_col: str = "batch", seq_col: str = "seq") -> DataFrame:
    """P18 + P19: add ``is_threat`` and ``is_first``; keep threats and the first
    row of each batch. Only (batch, smallest seq) is aggregated, and joined back
    on both, which no two rows share: no batch is one task."""
    first = scored.groupBy(batch_col).agg(F.min(seq_col).alias(seq_col)).withColumn("is_first", F.lit(True))
    marked = scored.withColumn("is_threat", F.coalesce(S.is_threat("prediction"), F.lit(False)))
    joined = marked.join(first, [batch_col, seq_col], "left").withColumn("is_first", F.coalesce("is_first", F.lit(False)))
    return joined.where("is_threat or is_first").select(*marked.columns, "is_first")


def alert_records(gated: DataFrame, ts_col: str = "alert_ts", seq_col: str = "seq",
                  features_col: str | None = None) -> DataFrame:
    """Alert rows (id, node_ip, src_ip, dst_ip, timestamp,
    prediction, confidence[, features])."""
    ts_text = S.timestamp_text(ts_col)
    cols = [
        S.alert_id("node_ip", ts_text, seq_col).alias("id"),
        "node_ip", "src_ip", "dst_ip",
        ts_text.alias("timestamp"),
        F.col(ts_col).alias("ts"),
        F.col(seq_col).alias("seq"),
        "prediction", "confidence",
    ]
    if features_col:
        cols.append(F.col(features_col).alias("features"))
    return gated.select(*cols)


def newest(alerts: DataFrame, n: int = K.ALERT_BUFFER_SIZE) -> DataFrame:
    """The newest n alerts (ties: later capture first)."""
    return alerts.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(n)


def replay(buffer: DataFrame) -> DataFrame:
    """The buffer oldest-first, as sent to a new viewer."""
    return buffer.orderBy(F.col("ts").asc(), F.col("seq").asc())


def dashboard_rows(alerts: DataFrame, n: int = K.DASHBOARD_ROWS,
                   cleared_at: str | None = None) -> DataFrame:
    """T4 + P20–P24 (+T7): newest-first table rows with their display fields."""
    if cleared_at is not None:
        alerts = alerts.filter(F.col("ts") > F.to_timestamp_ntz(F.lit(cleared_at)))
    top = alerts.orderBy(F.col("ts").desc(), F.col("seq").desc()).limit(n)
    extra = []
    if "features" in alerts.columns:
        # P24: "feature:impact" with two decimals, in the map's order
        extra.append(F.array_join(F.transform(F.map_entries("features"), lambda e: F.concat(
            e["key"], F.lit(":"), S.impact_text(e["value"]))), " ").alias("features_text"))
    return top.select(*extra,
        "id", "timestamp", "node_ip", "src_ip", "dst_ip", "prediction", "confidence",
        S.threat_class("prediction").alias("threat_class"),
        S.severity("prediction", "confidence").alias("severity"),
        S.display_label("prediction").alias("display_label"),
        S.percent_text("confidence").alias("confidence_pct"),
        S.ip_search_text("src_ip", "dst_ip", "node_ip").alias("ips"))


def filter_rows(rows: DataFrame, threat_class: str = "ALL", ip_query: str = "") -> DataFrame:
    """P22 + P23: class filter ALL / MALICIOUS / NORMAL and a case-insensitive
    substring filter over ``src dst node``."""
    cond: Column = S.ip_matches("src_ip", "dst_ip", "node_ip", ip_query)
    if threat_class != "ALL":
        cond = cond & (S.threat_class("prediction") == F.lit(threat_class))
    return rows.filter(cond)


def kpis(alerts: DataFrame, cleared_at: str | None = None) -> DataFrame:
    """A11 (+T7): total alerts, threats, distinct nodes since ``cleared_at``."""
    if cleared_at is not None:
        alerts = alerts.filter(F.col("ts") > F.to_timestamp_ntz(F.lit(cleared_at)))
    return alerts.agg(F.count(F.lit(1)).alias("total_alerts"),
                      F.count_if(S.is_threat("prediction")).alias("threats"),
                      F.countDistinct("node_ip").alias("nodes"))


def node_status(alerts: DataFrame, now: str | None = None) -> DataFrame:
    """Last alert time per node; ONLINE when the floor of its age in
    seconds is below 10, else AWAY. ``now`` defaults to the newest alert
    (a scalar aggregate)."""
    last = alerts.groupBy("node_ip").agg(F.max("ts").alias("last_seen"))
    at = F.to_timestamp_ntz(F.lit(now)) if now is not None else alerts.select(F.max("ts")).scalar()
    last = last.withColumn("_now", at)
    age = F.floor(S.micros_between("last_seen", "_now") / F.lit(1e6))
    return last.select("node_ip", "last_seen", age.cast("long").alias("age_seconds"),
                       F.when(age < K.ONLINE_SECONDS, "ONLINE").otherwise("AWAY").alias("status"))


def batch_summary(scored: DataFrame, batch_col: str = "batch") -> DataFrame:
    """Rows per batch and how many are threats."""
    return scored.groupBy(batch_col).agg(F.count(F.lit(1)).alias("n_flows"),
                                         F.count_if(S.is_threat("prediction")).alias("n_threats"))


def verdicts(scored: DataFrame, batch_col: str = "batch", seq_col: str = "seq") -> DataFrame:
    """(src_ip, dst_ip, prediction) for every scored row of a batch."""
    return scored.select(batch_col, seq_col, "src_ip", "dst_ip", "prediction")
