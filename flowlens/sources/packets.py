"""Packet tables.

A packet row is ``(event_id, ts, proto, bytes, ip_src, ip_dst, port_src,
port_dst, tcp_flags, payload)``. ``event_id`` is the capture sequence number
and breaks ties between packets with the same timestamp.

``packets_from_events`` builds packet rows from the ``events`` test table
(the ``packets_v`` view of FIXTURES.md). It only maps columns into the packet
schema; all flow work happens in ``flowlens.operators.flows``.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from flowlens.session import spread

PACKET_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("proto", T.StringType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("ip_src", T.StringType()),
    T.StructField("ip_dst", T.StringType()),
    T.StructField("port_src", T.IntegerType()),
    T.StructField("port_dst", T.IntegerType()),
    T.StructField("tcp_flags", T.StringType()),
    T.StructField("payload", T.StringType()),
])

EVENTS_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("user_id", T.LongType()),
    T.StructField("event_type", T.StringType()),
    T.StructField("value", T.DoubleType()),
    T.StructField("props", T.StringType()),
])


def packets_from_events(events: DataFrame) -> DataFrame:
    """Map ``events`` rows onto the packet schema (FIXTURES.md ``packets_v``)."""
    b = events.select(
        "event_id", "ts", "user_id", "event_type",
        (F.round(F.col("value") * 10).cast("bigint") + 40).alias("bytes"),
        F.get_json_object("props", "$.k").cast("int").alias("k"),
    )
    e = b.select(
        "*",
        F.when(F.col("event_type") == "signup", "udp")
         .when(F.col("event_type") == "error", "icmp").otherwise("tcp").alias("proto"),
        F.concat(F.lit("10.0.0."), (F.col("user_id") % 3).cast("string")).alias("c_ip"),
        F.concat(F.lit("10.0.1."), (F.col("k") % 3).cast("string")).alias("s_ip"),
        F.when(F.col("event_type") == "error", 0)
         .otherwise(40000 + (F.col("user_id") % 3)).cast("int").alias("c_port"),
        F.when(F.col("event_type") == "error", 0).otherwise(
            F.when(F.col("k") % 4 == 0, 80).when(F.col("k") % 4 == 1, 21)
             .when(F.col("k") % 4 == 2, 53).otherwise(8080)).cast("int").alias("s_port"),
    )
    rev = (F.col("event_id") % 3) == 0
    flags = (F.when(F.col("event_id") % 6 == 0, "SA").when(F.col("event_id") % 6 == 1, "S")
             .when(F.col("event_id") % 6 == 2, "A").when(F.col("event_id") % 6 == 3, "PA")
             .when(F.col("event_id") % 6 == 4, "R").otherwise("FA"))
    return e.select(
        "event_id", "ts", "proto", "bytes",
        F.when(rev, F.col("s_ip")).otherwise(F.col("c_ip")).alias("ip_src"),
        F.when(rev, F.col("c_ip")).otherwise(F.col("s_ip")).alias("ip_dst"),
        F.when(rev, F.col("s_port")).otherwise(F.col("c_port")).alias("port_src"),
        F.when(rev, F.col("c_port")).otherwise(F.col("s_port")).alias("port_dst"),
        F.when(F.col("proto") == "tcp", flags).otherwise("").alias("tcp_flags"),
        F.when(F.col("k") < 10, "530 Login incorrect")
         .when(F.col("k") < 15, "USER anonymous").otherwise("x").alias("payload"),
    )


def packets_from_lineitems(items: DataFrame) -> DataFrame:
    """Map ``lineitem`` rows onto the packet schema (FIXTURES.md ``packets_w``):
    many clients and ports on few servers and days, so that a host sees many
    flows in a window; a client may have its server's address."""
    p, s, o, n = F.col("l_partkey"), F.col("l_suppkey"), F.col("l_orderkey"), F.col("l_linenumber")
    at = F.timestamp_add("SECOND", (o % 20) * 86400 + (p + s) % 86400, F.lit("2024-03-01 00:00:00").cast("timestamp_ntz"))
    proto = F.when(s % 10 == 0, "udp").when(s % 10 == 1, "icmp").otherwise("tcp")
    icmp = s % 10 == 1
    flags = F.when(n == 1, "S").when(n == 2, "R").when(n == 3, "SA").otherwise("FA")
    return items.select(
        (((o * 8 + n) * 1000000 + p) * 10000 + s).cast("long").alias("event_id"), at.alias("ts"), proto.alias("proto"),
        F.col("l_quantity").cast("long").alias("bytes"),
        F.concat(F.lit("10.0.1."), (s % 7).cast("string")).alias("ip_src"),
        F.concat(F.lit("10.0.1."), (o % 3).cast("string")).alias("ip_dst"),
        F.when(icmp, 0).otherwise(1024 + p % 60000).cast("int").alias("port_src"),
        F.when(icmp, 0).when(n % 3 == 0, 22).when(n % 3 == 1, 80).otherwise(443).cast("int").alias("port_dst"),
        F.when(proto == "tcp", flags).otherwise("").alias("tcp_flags"),
        F.when(p % 40 == 0, "401 Unauthorized").when(p % 40 == 1, "guest login ok").otherwise("x").alias("payload"))


RAW_PACKET_SCHEMA = T.StructType([
    T.StructField("event_id", T.LongType()),
    T.StructField("ts", T.TimestampNTZType()),
    T.StructField("has_ip", T.BooleanType()),
    T.StructField("has_tcp", T.BooleanType()),
    T.StructField("has_udp", T.BooleanType()),
    T.StructField("has_icmp", T.BooleanType()),
    T.StructField("bytes", T.LongType()),
    T.StructField("ip_src", T.StringType()),
    T.StructField("ip_dst", T.StringType()),
    T.StructField("port_src", T.IntegerType()),
    T.StructField("port_dst", T.IntegerType()),
    T.StructField("tcp_flags", T.StringType()),
    T.StructField("payload", T.BinaryType()),
])


def normalize_packets(raw: DataFrame) -> DataFrame:
    """Decoded capture rows → packet schema. Non-IP packets are dropped;
    the protocol is tcp, udp, icmp or other (in that order); ports are 0
    unless TCP or UDP; flags are kept for TCP only. The payload stays bytes."""
    from flowlens.functions.scalar import protocol_tag
    proto = protocol_tag("has_tcp", "has_udp", "has_icmp")
    tcp_or_udp = F.col("has_tcp") | F.col("has_udp")
    return raw.filter(F.col("has_ip")).select(
        "event_id", "ts", proto.alias("proto"), "bytes", "ip_src", "ip_dst",
        F.when(tcp_or_udp, F.col("port_src")).otherwise(0).cast("int").alias("port_src"),
        F.when(tcp_or_udp, F.col("port_dst")).otherwise(0).cast("int").alias("port_dst"),
        F.when(F.col("has_tcp"), F.coalesce(F.col("tcp_flags"), F.lit(""))).otherwise("").alias("tcp_flags"),
        "payload")


def read_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet table derived from ``events`` under ``sf_dir``."""
    events = spread(spark.read.parquet(f"{sf_dir}/events.parquet"))
    return packets_from_events(events)


def read_dense_packets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Packet table derived from ``lineitem`` under ``sf_dir``."""
    return packets_from_lineitems(spread(spark.read.parquet(f"{sf_dir}/lineitem.parquet")))


def read_packet_table(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """A packet table already stored in the packet schema (S6, batch form)."""
    return spark.read.format(fmt).schema(PACKET_SCHEMA).load(path)
