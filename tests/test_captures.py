"""Capture files: both byte orders, cut frames, VLAN tags, other protocols."""

import struct

import pytest
from pyspark.sql import functions as F

from flowlens.session import scratch_path
from flowlens.sources import captures as CA
from flowlens.sources.packets import PACKET_SCHEMA, read_packets

from .conftest import SF_SMALL


def capture(frames, order="<", magic=0xA1B2C3D4, per=1):
    out = struct.pack(f"{order}IHHiIII", magic, 2, 4, 0, 0, 1 << 18, 1)
    for i, f in enumerate(frames):
        out += struct.pack(f"{order}IIII", 1_700_000_000 + i // 3, 250_000 * per, len(f), len(f) + 7) + f
    return out


def test_frames_become_packets():
    tcp = CA.frame("tcp", "10.0.0.1", "10.0.0.2", 40000, 80, "SA", b"hello")
    vlan = tcp[:12] + b"\x81\x00\x00\x05" + tcp[12:]
    padded = CA.frame("udp", "1.2.3.4", "5.6.7.8", 53, 5353, "", b"dns\xff") + bytes(20)  # Ethernet padding is no payload
    frames = [tcp, CA.frame(None, "", "", 0, 0, "", b""), padded, CA.frame("icmp", "1.1.1.1", "2.2.2.2", 0, 0, "", b"ping"), CA.frame("gre", "1.1.1.1", "2.2.2.2", 9, 9, "", b"x"), vlan, tcp[:30], b"", tcp[:40]]
    for order, magic, per in (("<", 0xA1B2C3D4, 1), (">", 0xA1B2C3D4, 1), ("<", 0xA1B23C4D, 1000), (">", 0xA1B23C4D, 1000)):
        data = capture(frames, order, magic, per)
        got = CA.packets_of(data, "x").to_pylist()
        assert [(r["proto"], r["ip_src"], r["port_src"], r["port_dst"], r["tcp_flags"], r["payload"]) for r in got] == [
            ("tcp", "10.0.0.1", 40000, 80, "SA", "hello"), ("udp", "1.2.3.4", 53, 5353, "", "dns"), ("icmp", "1.1.1.1", 0, 0, "", "ping"), ("other", "1.1.1.1", 0, 0, "", "x"),
            ("tcp", "10.0.0.1", 40000, 80, "SA", "hello"), ("tcp", "10.0.0.1", 0, 0, "", "")]
        assert got[0]["bytes"] == len(tcp) + 7 and got[0]["ts"].microsecond == 250_000
        assert [r["event_id"] for r in got] == sorted({r["event_id"] for r in got})
        assert len(CA.packets_of(data[:-20], "x")) == 5 and len(CA.packets_of(data[:24], "x")) == 0
    assert len(CA.packets_of(b"", "x")) == 0
    with pytest.raises(ValueError, match="bad.pcap"):
        CA.packets_of(b"no capture at all, but long enough", "bad.pcap")


def test_round_trip_batch_and_stream(spark):
    packets = read_packets(spark, SF_SMALL)
    path, out = scratch_path(spark, "pcap"), scratch_path(spark, "out")
    assert CA.write_captures(packets, path, files=5).count() == 5
    columns = PACKET_SCHEMA.names[1:]
    back = CA.read_captures(spark, path)
    assert back.schema == PACKET_SCHEMA
    assert back.select(columns).exceptAll(packets.select(columns)).count() == 0 and back.count() == packets.count()
    assert back.select(F.countDistinct("event_id")).first()[0] == back.count()

    def run():
        CA.capture_stream(spark, path, 2).writeStream.format("parquet").option("path", out).option("checkpointLocation", f"{out}-ckpt").trigger(availableNow=True).start().awaitTermination()
        return spark.read.parquet(out)

    assert run().select(columns).exceptAll(packets.select(columns)).count() == 0
    CA.write_captures(packets.limit(10), path, files=1).collect()  # a later file; a restart reads it alone
    assert run().count() == packets.count() + 10
