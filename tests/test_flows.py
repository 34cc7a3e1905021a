"""Flow aggregation and window features on hand-made packets (FIXTURES.md §4)."""

import datetime as dt

import pytest

from flowlens.operators import flows as FL
from flowlens.sources.packets import PACKET_SCHEMA

T0 = dt.datetime(2024, 1, 1, 10, 0, 0)


def pk(seq, sec, proto, nbytes, src, dst, sport, dport, flags="", payload="x"):
    return (seq, T0 + dt.timedelta(seconds=sec), proto, nbytes, src, dst, sport, dport, flags, payload)


def _flows(spark, rows, window="1 day"):
    df = spark.createDataFrame(rows, PACKET_SCHEMA)
    return {r.flow_seq: r for r in FL.aggregate_flows(df, window).collect()}


def test_bidirectional_flow_direction_and_bytes(spark):
    rows = [pk(1, 0, "tcp", 60, "10.0.0.1", "10.0.0.2", 40000, 80, "S"),
            pk(2, 1, "tcp", 40, "10.0.0.2", "10.0.0.1", 80, 40000, "SA"),
            pk(3, 2, "tcp", 100, "10.0.0.1", "10.0.0.2", 40000, 80, "FA")]
    f = _flows(spark, rows)[1]
    assert (f.ip_src, f.ip_dst, f.port_dst, f.service) == ("10.0.0.1", "10.0.0.2", 80, "http")
    assert (f.src_bytes, f.dst_bytes, f.n_packets, f.flag) == (160, 40, 3, "SF")


def test_same_ip_both_ends_all_bytes_are_src(spark):
    rows = [pk(1, 0, "udp", 10, "10.0.0.9", "10.0.0.9", 5000, 53),
            pk(2, 1, "udp", 20, "10.0.0.9", "10.0.0.9", 53, 5000)]
    f = _flows(spark, rows)[1]
    assert (f.src_bytes, f.dst_bytes, f.service) == (30, 0, "domain_u")
    rec = FL.assemble_records(FL.host_features(FL.aggregate_flows(
        spark.createDataFrame(rows, PACKET_SCHEMA)))).first()
    assert rec.land == 1.0


def test_two_packets_same_timestamp_capture_order(spark):
    # the first captured packet fixes the direction even at an equal timestamp
    rows = [pk(7, 0, "tcp", 10, "10.0.0.2", "10.0.0.1", 80, 40000, "SA"),
            pk(8, 0, "tcp", 10, "10.0.0.1", "10.0.0.2", 40000, 80, "S")]
    f = _flows(spark, rows)[7]
    assert (f.ip_src, f.port_dst, f.service) == ("10.0.0.2", 40000, "other")
    assert f.start_time == f.end_time


def test_key_uses_string_order_of_endpoints(spark):
    # "10.0.0.1:80" > "10.0.0.1:8080" as text; both directions still one flow
    rows = [pk(1, 0, "tcp", 10, "10.0.0.1", "10.0.0.1", 8080, 80, "S"),
            pk(2, 1, "tcp", 10, "10.0.0.1", "10.0.0.1", 80, 8080, "R")]
    flows = _flows(spark, rows)
    assert len(flows) == 1 and flows[1].flag == "REJ"


def test_protocol_other_and_payload_counts(spark):
    rows = [pk(1, 0, "other", 10, "1.1.1.1", "2.2.2.2", 0, 0, "", "530 login incorrect"),
            pk(2, 1, "other", 10, "1.1.1.1", "2.2.2.2", 0, 0, "", "530 LOGIN INCORRECT 401 unauthorized"),
            pk(3, 2, "other", 10, "1.1.1.1", "2.2.2.2", 0, 0, "", "guest login")]
    f = _flows(spark, rows)[1]
    assert (f.protocol_type, f.service, f.flag, f.num_failed_logins, f.is_guest_login) == \
        ("other", "other", "SF", 2, 1)


def test_duration_never_negative(spark):
    rows = [pk(1, 5, "tcp", 10, "1.1.1.1", "2.2.2.2", 1, 2, "S"),
            pk(2, 1, "tcp", 10, "1.1.1.1", "2.2.2.2", 1, 2, "S")]
    rec = FL.assemble_records(FL.host_features(FL.aggregate_flows(
        spark.createDataFrame(rows, PACKET_SCHEMA)))).first()
    assert rec.duration == 0.0


@pytest.mark.parametrize("n", [600])
def test_host_counter_caps(spark, n):
    rows = [pk(i, i % 3, "tcp", 10, f"10.1.{i // 250}.{i % 250}", "10.9.9.9", 40000, 80, "S")
            for i in range(n)]
    recs = FL.assemble_records(FL.host_features(FL.aggregate_flows(
        spark.createDataFrame(rows, PACKET_SCHEMA)))).collect()
    assert len(recs) == n
    r = recs[0]
    assert (r["count"], r["srv_count"], r.dst_host_count, r.dst_host_srv_count) == (511.0, 511.0, 255.0, 255.0)
    assert r.dst_host_same_src_port_rate == pytest.approx(1 / 600)
    assert r.serror_rate == 1.0 and r.same_srv_rate == 1.0 and r.diff_srv_rate == 0.0


def test_windows_split_flows(spark):
    rows = [pk(1, 0, "tcp", 10, "1.1.1.1", "2.2.2.2", 1, 2, "S"),
            pk(2, 5, "tcp", 10, "1.1.1.1", "2.2.2.2", 1, 2, "S")]
    flows = _flows(spark, rows, window="4 seconds")
    assert len(flows) == 2


def test_hot_host_skew_join_path_matches(spark):
    """One destination host with a third of all flows: the salted sort-merge
    path gives the same records as the plain (broadcast) path."""
    rows = []
    for i in range(3000):
        dst = "10.9.9.9" if i % 3 == 0 else f"10.8.{i % 40}.{i % 7}"
        rows.append(pk(i, i % 50, "tcp", 10 + i % 5, f"10.1.{i // 250}.{i % 250}", dst, 40000 + i % 9,
                       80 if i % 2 else 21, "S" if i % 4 else "SA"))
    df = spark.createDataFrame(rows, PACKET_SCHEMA)
    want = FL.flow_records(df, "1 day", materialize=False).collect()
    keys = {"spark.sql.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
            "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "1k",
            "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "1",
            "spark.sql.adaptive.advisoryPartitionSizeInBytes": "1k"}
    old = {k: spark.conf.get(k, None) for k in keys}
    try:
        for k, v in keys.items():
            spark.conf.set(k, v)
        flows = FL.aggregate_flows(df, "1 day")
        got_df = FL.assemble_records(FL.host_features(flows, salt_threshold=100, salts=8))
        got = got_df.collect()
        # more hot keys than the broadcast limit: joined without a broadcast
        capped = FL.assemble_records(FL.host_features(flows, salt_threshold=10, salts=4, max_hot=1)).collect()
        plan = got_df._jdf.queryExecution().executedPlan().toString()
    finally:
        for k, v in old.items():
            spark.conf.unset(k) if v is None else spark.conf.set(k, v)
    assert "SortMergeJoin" in plan
    assert sorted(map(tuple, got)) == sorted(map(tuple, want))
    assert sorted(map(tuple, capped)) == sorted(map(tuple, want))



def test_normalize_raw_packets(spark):
    from flowlens.sources.packets import RAW_PACKET_SCHEMA, normalize_packets
    raw = spark.createDataFrame([
        (1, T0, True, True, False, False, 60, "1.1.1.1", "2.2.2.2", 4000, 80, "S", b"x"),
        (2, T0, True, False, True, False, 60, "1.1.1.1", "2.2.2.2", 5000, 53, "S", b"x"),
        (3, T0, True, False, False, True, 60, "1.1.1.1", "2.2.2.2", 7, 9, "S", b"x"),
        (4, T0, True, False, False, False, 60, "1.1.1.1", "2.2.2.2", 7, 9, None, b"x"),
        (5, T0, False, True, False, False, 60, None, None, 1, 2, "S", b"x")], RAW_PACKET_SCHEMA)
    got = [(r.proto, r.port_src, r.port_dst, r.tcp_flags) for r in normalize_packets(raw).orderBy("event_id").collect()]
    assert got == [("tcp", 4000, 80, "S"), ("udp", 5000, 53, ""), ("icmp", 0, 0, ""), ("other", 0, 0, "")]
    flows = FL.aggregate_flows(normalize_packets(raw)).collect()
    assert sorted(f.service for f in flows) == ["domain_u", "eco_i", "http", "other"]



def test_duration_ignores_session_time_zone_and_dst(spark):
    old = spark.conf.get("spark.sql.session.timeZone")
    rows = [(1, dt.datetime(2024, 3, 10, 1, 30), "tcp", 10, "1.1.1.1", "2.2.2.2", 1, 2, "S", "x"),
            (2, dt.datetime(2024, 3, 10, 3, 30), "tcp", 10, "1.1.1.1", "2.2.2.2", 1, 2, "S", "x")]
    try:
        spark.conf.set("spark.sql.session.timeZone", "America/New_York")
        rec = FL.assemble_records(FL.host_features(FL.aggregate_flows(
            spark.createDataFrame(rows, PACKET_SCHEMA)))).first()
    finally:
        spark.conf.set("spark.sql.session.timeZone", old)
    assert rec.duration == 7200.0
