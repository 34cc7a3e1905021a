"""Packet capture files (S6, P7): Ethernet frames in the classic pcap format.

A capture file is a header of 24 bytes and, for each frame, a header of 16
bytes (seconds, fraction, captured and original length) with the captured
bytes. Files are read whole by Spark's ``binaryFile`` source, so they may lie
in any store that Spark reads, and a folder of them is a stream whose offsets
Spark keeps; a capture is rotated into files of bounded size. In a task the
record headers are followed once, and all fields of a file's frames are taken
by numpy at computed offsets.

Frames without IPv4 are dropped; the protocol is tcp, udp, icmp or other; ports
are 0 unless TCP or UDP; ``bytes`` is the original length. ``event_id`` orders
frames as captured: microseconds since 1970 times 4096, plus the number among
those of a file with the same time.

Edge cases: an empty file has no frames; a last frame that is cut short, and
frames too short for their headers, are dropped; both byte orders, fractions in
micro- and nanoseconds and one VLAN tag are read; any other file is an error that
names it.
"""

from __future__ import annotations

import struct
import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.functions import scalar as S
from flowlens.session import ship_package
from flowlens.sources.packets import PACKET_SCHEMA

# fixed values of the formats
MAGIC = {b"\xd4\xc3\xb2\xa1": ("<", 1), b"\xa1\xb2\xc3\xd4": (">", 1), b"\x4d\x3c\xb2\xa1": ("<", 1000), b"\xa1\xb2\x3c\x4d": (">", 1000)}
ETHERNET, IPV4, VLAN, ARP = 1, 0x0800, 0x8100, 0x0806
PROTOCOL = {"icmp": 1, "tcp": 6, "udp": 17}
FLAGS = "FSRPAU"  # from the lowest bit
SEQUENCE = 4096  # frames of a file in one microsecond that keep their order


def frames(data: bytes, name: str) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """(offset, captured length, original length, microseconds) of each frame."""
    if not data:
        return tuple(np.zeros(0, np.int64) for _ in range(4))
    if data[:4] not in MAGIC or len(data) < 24:
        raise ValueError(f"{name}: not a capture file")
    order, per_micro = MAGIC[data[:4]]
    if struct.unpack_from(f"{order}I", data, 20)[0] & 0xFFFF != ETHERNET:
        raise ValueError(f"{name}: not a capture of Ethernet frames")
    read, at, end, out = struct.Struct(f"{order}IIII").unpack_from, 24, len(data), []
    while at + 16 <= end:
        sec, part, held, size = read(data, at)
        at += 16
        if at + held > end:
            break
        out.append((at, held, size, sec * 1_000_000 + part // per_micro))
        at += held
    return tuple(np.array(out, np.int64).reshape(-1, 4).T)


def packets_of(data: bytes, name: str) -> pa.RecordBatch:
    """The IPv4 packets of a capture file, in the packet schema."""
    at, held, size, micros = frames(data, name)
    raw = np.frombuffer(data, np.uint8)
    byte = lambda i: raw[np.minimum(i, max(0, len(raw) - 1))].astype(np.int64)
    two = lambda i: byte(i) << 8 | byte(i + 1)
    order = np.arange(len(at))
    first = np.searchsorted(micros, micros, "left") if len(at) and (np.diff(micros) >= 0).all() else np.zeros(len(at), np.int64)
    event = micros * SEQUENCE + (order - first) % SEQUENCE
    ip = at + 14 + 4 * (two(at + 12) == VLAN)
    ok = (two(ip - 2) == IPV4) & (held >= ip - at + 20) & (byte(ip) >> 4 == 4)
    at, held, size, micros, event, ip = (x[ok] for x in (at, held, size, micros, event, ip))
    body = ip + 4 * (byte(ip) & 15)
    end = np.minimum(at + held, ip + np.maximum(two(ip + 2), 20))
    number = byte(ip + 9)
    tcp, udp = ((number == PROTOCOL[p]) & (end >= body + n) for p, n in (("tcp", 20), ("udp", 8)))
    proto = np.where(number == PROTOCOL["tcp"], "tcp", np.where(number == PROTOCOL["udp"], "udp", np.where(number == PROTOCOL["icmp"], "icmp", "other")))
    ports = [np.where(tcp | udp, two(body + i), 0).astype(np.int32) for i in (0, 2)]
    bits = np.where(tcp, byte(body + 13), 0)
    names = np.array(["".join(f for j, f in enumerate(FLAGS) if i >> j & 1) for i in range(1 << len(FLAGS))])
    cut = ((number == PROTOCOL["tcp"]) & ~tcp) | ((number == PROTOCOL["udp"]) & ~udp)  # without its whole header: no payload
    start = np.where(tcp, body + 4 * (byte(body + 12) >> 4), np.where(udp, body + 8, np.where(number == PROTOCOL["icmp"], body + 8, np.where(cut, end, body))))
    address = [[f"{a}.{b}.{c}.{d}" for a, b, c, d in zip(*(byte(ip + i + j).tolist() for j in range(4)), strict=True)] for i in (12, 16)]
    payload = [data[a:b].decode("utf-8", "ignore") for a, b in zip(np.minimum(start, end).tolist(), end.tolist(), strict=True)]
    return pa.RecordBatch.from_arrays(
        [pa.array(event), pa.array(micros, pa.timestamp("us")), pa.array(proto.tolist(), pa.string()), pa.array(size), pa.array(address[0], pa.string()), pa.array(address[1], pa.string()),
         pa.array(ports[0]), pa.array(ports[1]), pa.array(names[bits & 63].tolist(), pa.string()), pa.array(payload, pa.string())], names=PACKET_SCHEMA.names)


def _parsed(files: DataFrame) -> DataFrame:
    ship_package(files.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for path, data in zip(b.column(0), b.column(1), strict=True):
                out = packets_of(data.as_py(), path.as_py())
                for i in range(0, out.num_rows, 10_000):
                    yield out.slice(i, 10_000)

    return files.select("path", "content").mapInArrow(run, PACKET_SCHEMA)


def read_captures(spark: SparkSession, path: str) -> DataFrame:
    """The packets of the capture files in a folder."""
    return _parsed(spark.read.format("binaryFile").option("pathGlobFilter", "*.pcap").load(path))


def capture_stream(spark: SparkSession, path: str, max_files_per_trigger: int | None = None) -> DataFrame:
    """The packets of capture files as they land."""
    r = spark.readStream.format("binaryFile").schema("path string, modificationTime timestamp, length long, content binary").option("pathGlobFilter", "*.pcap")
    if max_files_per_trigger is not None:
        r = r.option("maxFilesPerTrigger", max_files_per_trigger)
    return _parsed(r.load(path))


def frame(proto: str | None, src: str, dst: str, sport: int, dport: int, flags: str, payload: bytes) -> bytes:
    """An Ethernet frame; without a protocol, one that isn't IP."""
    if proto is None:
        return bytes(12) + struct.pack(">H", ARP) + bytes(28)
    mask = sum(1 << FLAGS.index(f) for f in flags)
    head = {"tcp": struct.pack(">HHIIBBHHH", sport, dport, 0, 0, 5 << 4, mask, 0, 0, 0), "udp": struct.pack(">HHHH", sport, dport, 8 + len(payload), 0), "icmp": bytes(8)}.get(proto, b"")
    address = b"".join(bytes(map(int, ip.split("."))) for ip in (src, dst))
    ip = struct.pack(">BBHHHBBH", 0x45, 0, 20 + len(head) + len(payload), 0, 0, 64, PROTOCOL.get(proto, 47), 0)
    return bytes(12) + struct.pack(">H", IPV4) + ip + address + head + payload


def write_captures(packets: DataFrame, path: str, files: int = 8) -> DataFrame:
    """Write packets (a null ``proto`` is a frame without IP) as capture files
    of consecutive times in the shared folder ``path``; returns their names."""
    ship_package(packets.sparkSession)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyarrow import fs as pafs

        out, name = None, f"{uuid.uuid4().hex}.pcap"
        store, base = pafs.FileSystem.from_uri(path if ":" in path else f"file://{path}")
        for b in batches:
            if out is None:
                store.create_dir(base, recursive=True)
                out = store.open_output_stream(f"{base}/_{name}")  # not a capture's name before it is whole
                out.write(struct.pack("<IHHiIII", 0xA1B2C3D4, 2, 4, 0, 0, 1 << 18, ETHERNET))
            for r in b.to_pylist():
                data = frame(r["proto"], r["ip_src"], r["ip_dst"], r["port_src"], r["port_dst"], r["tcp_flags"], r["payload"].encode())
                sec, micros = divmod(r["micros"], 1_000_000)
                out.write(struct.pack("<IIII", sec, micros, len(data), r["bytes"]) + data)
        if out is not None:
            out.close()
            store.move(f"{base}/_{name}", f"{base}/{name}")
            yield pa.RecordBatch.from_pydict({"name": [name]})

    rows = packets.select("event_id", F.unix_micros(S.ntz_to_event_time("ts")).alias("micros"), *PACKET_SCHEMA.names[2:])
    rows = rows.repartitionByRange(files, "micros").sortWithinPartitions("micros", "event_id")
    return rows.mapInArrow(run, "name string")
