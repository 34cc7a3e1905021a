"""Scalar functions: FIXTURES.md §4 hand-made edge cases."""

from pyspark.sql import functions as F

from flowlens.functions import scalar as S


def _one(spark, expr, rows, schema):
    return [r[0] for r in spark.createDataFrame(rows, schema).select(expr).collect()]


def test_label_clean_and_category(spark):
    got = _one(spark, S.label_category("label"),
               [("normal.",), (".smurf.",), ("mystery",), (None,), ("neptune",), ("rootkit.",)],
               "label string")
    assert got == ["normal", "dos", "unknown", "unknown", "dos", "u2r"]


def test_service_of_port(spark):
    rows = [(80, "tcp"), (443, "tcp"), (8080, "tcp"), (53, "udp"), (0, "icmp"), (0, "other"), (3306, "tcp")]
    got = _one(spark, S.service_of_port("p", "proto"), rows, "p int, proto string")
    assert got == ["http", "http_443", "other", "domain_u", "eco_i", "other", "sql_net"]


def test_flag_class_sets(spark):
    # (S, F, R, A) seen -> class; ordered rules
    cases = {
        "S,SA,FA": "SF", "S,RA": "REJ", "S": "S0", "R": "RSTR", "A": "SF", "S,SA,A": "SF",
    }
    rows = []
    for flags, _ in cases.items():
        txt = "".join(flags.split(","))
        rows.append(("tcp", "S" in txt, "F" in txt, "R" in txt, "A" in txt))
    rows.append(("udp", True, False, True, False))
    got = _one(spark, S.tcp_flag_class("proto", "s", "f", "r", "a"), rows,
               "proto string, s boolean, f boolean, r boolean, a boolean")
    assert got == list(cases.values()) + ["SF"]


def test_payload_markers(spark):
    rows = [(b"530 Login incorrect",), (b"\xff530 LOGIN INCORRECT\xfe",), (b"530 lo\xffgin incorrect",),
            (b"USER anonymous and 401 Unauthorized",), (b"401 unauthorized 530 login incorrect",), (b"x",)]
    df = spark.createDataFrame(rows, "p binary")
    got = df.select(S.failed_login_hit("p").alias("f"), S.guest_login_hit("p").alias("g")).collect()
    assert [(r.f, r.g) for r in got] == [(1, 0), (1, 0), (1, 0), (1, 1), (1, 0), (0, 0)]


def test_threat_severity_display(spark):
    rows = [("dos", 0.95), ("dos", 0.9), ("normal", 0.99), ("0", 0.99), ("NORMAL", 0.5), ("Probe", 0.91)]
    df = spark.createDataFrame(rows, "p string, c double")
    got = df.select(S.is_threat("p"), S.severity("p", "c"), S.display_label("p"), S.percent_text("c")).collect()
    assert [tuple(r) for r in got] == [
        (True, "red", "DETECTED: DOS", "95.0"), (True, "yellow", "DETECTED: DOS", "90.0"),
        (False, "green", "NORMAL_TRAFFIC", "99.0"), (False, "green", "NORMAL_TRAFFIC", "99.0"),
        (False, "green", "NORMAL_TRAFFIC", "50.0"), (True, "red", "DETECTED: PROBE", "91.0")]


def test_ip_filter(spark):
    df = spark.createDataFrame([("10.0.0.1", "10.0.1.2", "192.168.1.5"), ("10.0.0.3", "8.8.8.8", "X")],
                               "src_ip string, dst_ip string, node_ip string")
    assert df.filter(S.ip_matches("src_ip", "dst_ip", "node_ip", "0.1.2")).count() == 1
    assert df.filter(S.ip_matches("src_ip", "dst_ip", "node_ip", "x")).count() == 1
    assert df.filter(S.ip_matches("src_ip", "dst_ip", "node_ip", "")).count() == 2


def test_alert_id_is_deterministic(spark):
    df = spark.createDataFrame([("n", "2024-01-01 00:00:00", 5)], "a string, b string, c long")
    a = df.select(S.alert_id("a", "b", "c")).first()[0]
    b = df.select(S.alert_id("a", "b", "c")).first()[0]
    assert a == b and len(a) == 8 and all(ch in "0123456789abcdef" for ch in a)
    assert df.select(S.timestamp_text(F.to_timestamp_ntz(F.col("b")))).first()[0] == "2024-01-01 00:00:00"



def test_sized_conf():
    from flowlens.session import sized_conf
    c = sized_conf(100 * 1024 ** 4, 8000)
    assert int(c["spark.sql.shuffle.partitions"]) == 819200
    assert sized_conf(10, 8)["spark.sql.shuffle.partitions"] == "16"
