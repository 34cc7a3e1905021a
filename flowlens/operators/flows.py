"""Packets -> bidirectional flows -> per-window host features -> 41-attribute records.

Plan shape (batch):

1. ``aggregate_flows`` (A1): one ``groupBy(window, flow key)`` whose
   aggregates are all algebraic (min/max/sum/bool_or/min_by), so Spark runs a
   partial aggregation before the shuffle. A flow key holding a third of all
   packets collapses to one row per map task before it is shuffled.
   Direction needs the first packet, which is only known after aggregation, so
   bytes are summed per endpoint IP of the key (there are at most two) and
   assigned to src/dst once the first packet is known.
2. ``host_features`` (A2, W1, W2): the source compared every flow with every
   other in its batch (O(n²)). Here: per (window, ip_dst, service) counts with
   partial aggregation, rolled up to (window, ip_dst), and joined back to the
   flows on (window, ip_dst, service). The count tables hold one row per key;
   keys with very many flows are salted for the join-back. No window function
   is used: a ``count() over (partition by ip_dst)`` would put a hot host's
   flows in a single task.
3. ``assemble_records`` (P11–P15): column expressions only.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from flowlens import constants as K
from flowlens.functions import scalar as S
from flowlens.session import write_scratch


def window_start(ts_col: str, duration: str) -> Column:
    """Start of the tumbling batch window (ST1); keeps the input's timestamp type."""
    return F.window(F.col(ts_col), duration).start


def packet_indicators(packets: DataFrame) -> DataFrame:
    """Direction-free key (P8) as its two endpoints, plus per-packet
    indicators. Keeps ``ts``; adds no window."""
    ep_src = S.endpoint("ip_src", "port_src")
    ep_dst = S.endpoint("ip_dst", "port_dst")
    src_lo = ep_src <= ep_dst          # string order, as the key sorts "ip:port" texts
    tcp = F.col("proto") == "tcp"
    flags = F.coalesce(F.col("tcp_flags"), F.lit(""))
    pick = lambda lo, a, b: F.when(lo, F.col(a)).otherwise(F.col(b))
    return packets.select(
        "event_id", "ts", "proto", "bytes", "ip_src",
        pick(src_lo, "ip_src", "ip_dst").alias("lo_ip"),
        pick(src_lo, "port_src", "port_dst").alias("lo_port"),
        pick(src_lo, "ip_dst", "ip_src").alias("hi_ip"),
        pick(src_lo, "port_dst", "port_src").alias("hi_port"),
        src_lo.alias("src_is_lo"),
        (tcp & flags.contains("S")).alias("f_s"),
        (tcp & flags.contains("F")).alias("f_f"),
        (tcp & flags.contains("R")).alias("f_r"),
        (tcp & flags.contains("A")).alias("f_a"),
        S.failed_login_hit("payload").alias("failed_hit"),
        S.guest_login_hit("payload").alias("guest_hit"),
    )


def with_flow_keys(packets: DataFrame, window_duration: str = "1 day",
                   batch_start: Column | None = None) -> DataFrame:
    """Window start (ST1), key and indicators. ``batch_start`` replaces the
    event-time window by a given batch start (capture batches)."""
    w = batch_start if batch_start is not None else window_start("ts", window_duration)
    return packet_indicators(packets).withColumn("window_start", w)


KEY_NO_WINDOW = ["proto", "lo_ip", "lo_port", "hi_ip", "hi_port"]
FLOW_KEY = ["window_start"] + KEY_NO_WINDOW


def flow_aggregates() -> list[Column]:
    """A1 aggregate expressions. Packets are ordered by capture sequence
    (``event_id``), as the capture loop sees them: the first packet fixes
    direction and start time, the last one the end time. Every buffer is
    fixed-width, so Spark uses a hash aggregation with a map-side partial step
    (and, in streaming, a compact state row per open flow)."""
    from_lo_ip = F.col("ip_src") == F.col("lo_ip")
    return [
        F.min("event_id").alias("flow_seq"),
        F.min_by("src_is_lo", "event_id").alias("first_src_is_lo"),
        F.min_by("ts", "event_id").alias("start_time"),
        F.max_by("ts", "event_id").alias("end_time"),
        F.count(F.lit(1)).alias("n_packets"),
        F.sum(F.when(from_lo_ip, F.col("bytes")).otherwise(F.lit(0))).alias("bytes_lo_ip"),
        F.sum(F.when(from_lo_ip, F.lit(0)).otherwise(F.col("bytes"))).alias("bytes_other_ip"),
        F.bool_or("f_s").alias("has_s"), F.bool_or("f_f").alias("has_f"),
        F.bool_or("f_r").alias("has_r"), F.bool_or("f_a").alias("has_a"),
        F.sum("failed_hit").alias("num_failed_logins"),
        F.max("guest_hit").alias("is_guest_login"),
    ]


def flow_partials(packets: DataFrame, window_duration: str = "1 day",
                  batch_start: Column | None = None) -> DataFrame:
    """A1, aggregation step: one row per (window, direction-free key, protocol)."""
    return (with_flow_keys(packets, window_duration, batch_start)
            .groupBy(*FLOW_KEY).agg(*flow_aggregates()))


def finish_flows(agg: DataFrame) -> DataFrame:
    """A1, projection step: direction from the first packet, bytes each way by
    matching the first packet's source IP (all bytes are src_bytes when both
    ends share one IP), service (P6) and flag class (P10)."""
    lo = F.col("first_src_is_lo")
    ip_src = F.when(lo, F.col("lo_ip")).otherwise(F.col("hi_ip"))
    ip_dst = F.when(lo, F.col("hi_ip")).otherwise(F.col("lo_ip"))
    port_src = F.when(lo, F.col("lo_port")).otherwise(F.col("hi_port"))
    port_dst = F.when(lo, F.col("hi_port")).otherwise(F.col("lo_port"))
    src_is_lo_ip = ip_src == F.col("lo_ip")
    return agg.select(
        "window_start", "flow_seq", "start_time", "end_time", "n_packets",
        F.col("proto").alias("protocol_type"),
        S.service_of_port(port_dst, F.col("proto")).alias("service"),
        ip_src.alias("ip_src"), ip_dst.alias("ip_dst"),
        port_src.alias("port_src"), port_dst.alias("port_dst"),
        F.when(src_is_lo_ip, F.col("bytes_lo_ip")).otherwise(F.col("bytes_other_ip")).alias("src_bytes"),
        F.when(src_is_lo_ip, F.col("bytes_other_ip")).otherwise(F.col("bytes_lo_ip")).alias("dst_bytes"),
        S.tcp_flag_class("proto", "has_s", "has_f", "has_r", "has_a").alias("flag"),
        F.col("num_failed_logins").cast("long").alias("num_failed_logins"),
        F.col("is_guest_login").cast("int").alias("is_guest_login"),
    )


def aggregate_flows(packets: DataFrame, window_duration: str = "1 day",
                    batch_start: Column | None = None) -> DataFrame:
    """A1: bidirectional flows. Output: window_start, flow_seq (capture
    sequence of the first packet), start_time, end_time,
    n_packets, protocol_type, service, ip_src, ip_dst, port_src, port_dst,
    src_bytes, dst_bytes, flag, num_failed_logins, is_guest_login."""
    return finish_flows(flow_partials(packets, window_duration, batch_start))


def service_counts(flows: DataFrame) -> DataFrame:
    """Per (window, ip_dst, service): flows, and per (window, ip_dst) totals.

    Output columns: window_start, ip_dst, service, srv_count, count, s0_count, rej_count.
    """
    srv = flows.groupBy("window_start", "ip_dst", "service").agg(
        F.count(F.lit(1)).alias("srv_count"),
        F.sum(F.when(F.col("flag") == "S0", 1).otherwise(0)).alias("srv_s0"),
        F.sum(F.when(F.col("flag") == "REJ", 1).otherwise(0)).alias("srv_rej"),
    )
    dst = srv.groupBy("window_start", "ip_dst").agg(
        F.sum("srv_count").alias("count"),
        F.sum("srv_s0").alias("s0_count"),
        F.sum("srv_rej").alias("rej_count"),
    )
    return srv.join(dst, ["window_start", "ip_dst"]).select(
        "window_start", "ip_dst", "service", "srv_count", "count", "s0_count", "rej_count")


def host_features(flows: DataFrame, salt_threshold: int = 1 << 20, salts: int = 32,
                  materialize: bool = False, max_hot: int = 100_000) -> DataFrame:
    """Window counters for each flow (same destination host,
    same service), joined back on (window, ip_dst, service).

    Hot keys are salted: a key with more than ``salt_threshold`` flows has its
    one counter row replicated over ``salts`` salt values and its flows spread
    over them by capture sequence, so no single task joins all of a hot
    host's flows. There are at most total_flows / ``salt_threshold`` hot keys,
    so that key list is broadcast after a count of it; with no hot key every
    salt is 0. A list of more than ``max_hot`` keys is joined without a
    broadcast (and its skew left to AQE's skew join); every hot key is salted
    either way. With ``materialize`` the counter table (one row per key) is
    written once, as it is read twice."""
    keys = ["window_start", "ip_dst", "service"]
    counts = service_counts(flows)
    if materialize:
        counts = write_scratch(counts, "host-counts")
    is_hot = F.col("srv_count") > F.lit(salt_threshold)
    hot = counts.filter(is_hot)
    listed = hot.select(*keys).withColumn("_hot", F.lit(True))
    f = (flows.join(F.broadcast(listed) if hot.count() <= max_hot else listed, keys, "left")
              .withColumn("_salt", F.when(F.col("_hot"), F.pmod(F.col("flow_seq"), F.lit(salts)))
                                    .otherwise(F.lit(0)))
              .drop("_hot"))
    c = counts.withColumn("_salt", F.explode(
        F.when(is_hot, F.sequence(F.lit(0), F.lit(salts - 1))).otherwise(F.array(F.lit(0)))))
    return f.join(c, keys + ["_salt"], "inner").drop("_salt")


def assemble_records(feat: DataFrame) -> DataFrame:
    """The 41 attributes in file order (unset ones 0.0), keyed by
    window_start and flow_seq, with src_ip and dst_ip."""
    cnt = F.col("count").cast("double")
    srv = F.col("srv_count").cast("double")
    denom = F.greatest(F.lit(1.0), cnt)
    serror = F.col("s0_count") / denom
    rerror = F.col("rej_count") / denom
    same_srv = srv / denom
    values = {
        "duration": F.greatest(F.lit(0.0), S.micros_between("start_time", "end_time") / F.lit(1e6)),
        "protocol_type": F.col("protocol_type"),
        "service": F.col("service"),
        "flag": F.col("flag"),
        "src_bytes": F.col("src_bytes").cast("double"),
        "dst_bytes": F.col("dst_bytes").cast("double"),
        "land": F.when(F.col("ip_src") == F.col("ip_dst"), 1.0).otherwise(0.0),
        "num_failed_logins": F.col("num_failed_logins").cast("double"),
        "is_guest_login": F.col("is_guest_login").cast("double"),
        "count": F.least(F.lit(K.COUNT_CAP), cnt),
        "srv_count": F.least(F.lit(K.COUNT_CAP), srv),
        "serror_rate": serror,
        "srv_serror_rate": serror,
        "rerror_rate": rerror,
        "srv_rerror_rate": rerror,
        "same_srv_rate": same_srv,
        "diff_srv_rate": F.lit(1.0) - same_srv,
        "dst_host_count": F.least(F.lit(K.DST_HOST_COUNT_CAP), cnt),
        "dst_host_srv_count": F.least(F.lit(K.DST_HOST_COUNT_CAP), srv),
        "dst_host_same_srv_rate": same_srv,
        "dst_host_diff_srv_rate": F.lit(1.0) - same_srv,
        # uses the uncapped count
        "dst_host_same_src_port_rate": F.lit(1.0) / denom,
        "dst_host_srv_diff_host_rate": F.lit(0.0),
        "dst_host_serror_rate": serror,
        "dst_host_srv_serror_rate": serror,
        "dst_host_rerror_rate": rerror,
        "dst_host_srv_rerror_rate": rerror,
    }
    attrs = [values.get(c, F.lit(0.0)).alias(c) for c in K.ATTRIBUTE_COLUMNS]
    return feat.select(
        "window_start", "flow_seq",
        F.col("ip_src").alias("src_ip"), F.col("ip_dst").alias("dst_ip"),
        *attrs)


def flow_records(packets: DataFrame, window_duration: str = "1 day",
                 materialize: bool = True) -> DataFrame:
    """Packets -> 41-attribute flow records per window (the agent's batch path).

    Flows feed both the counters and the join back to them; with
    ``materialize`` they are written once to the shared checkpoint folder so
    the packet table is scanned and shuffled once, not once per branch.
    """
    flows = aggregate_flows(packets, window_duration)
    if materialize:
        flows = write_scratch(flows, "flows")
    return assemble_records(host_features(flows, materialize=materialize))
