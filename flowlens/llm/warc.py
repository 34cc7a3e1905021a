"""Content-addressed WARC archive.

An archive is a folder with two tables: ``payloads`` holds each distinct
payload once under its SHA-256, ``records`` the exact bytes of every record
that stand before its payload, and the payload's SHA-256. A record's original
bytes are its header, its payload (found by a join; checked against its
digest) and the closing line ends. Of equal payloads of at least ``min_bytes``
the record with the smallest page id is the response, the others are revisits
that refer to it and have an empty block; smaller payloads are all responses.

Hot payloads: digests are grouped with map-side partial aggregation, the
payload of a group crosses a shuffle once, and revisits join without carrying
it. Task output is Spark's own (tables), so lost executors cost a retry only.

Edge cases: a null payload is an empty one; rows that repeat are records of
their own, the first of them the response; records without page id come after
all others and refer or are referred to as "null"; an empty table gives an
empty archive; payloads are kept whole.
"""

from __future__ import annotations

import base64
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import scratch_path, write_scratch

from . import common as C

REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"  # fixed value of the format


def base32_sha1(hex_digest: str) -> str:
    return base64.b32encode(bytes.fromhex(hex_digest)).decode()


def record_id(page_id: int | None, row_id: int) -> str:
    return f"<urn:x-page:{'null' if page_id is None else page_id}:{row_id}>"


def record_header(page_id, row_id, url, kind, sha1, n_bytes, first_id, first_row, date) -> bytes:
    """Everything of a record that stands before its payload."""
    uri = "".join(c if 0x20 < ord(c) < 0x7F else "".join(f"%{x:02X}" for x in c.encode("utf-8", "replace")) for c in url or "")
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {record_id(page_id, row_id)}", f"WARC-Date: {date}",
             f"WARC-Target-URI: {uri}", f"WARC-Payload-Digest: sha1:{base32_sha1(sha1)}"]
    http = ""
    if kind == "response":
        http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {n_bytes}\r\n\r\n"
        lines.append("Content-Type: application/http; msgtype=response")
    else:
        lines += [f"WARC-Profile: {REVISIT}", f"WARC-Refers-To: {record_id(first_id, first_row)}"]
    lines.append(f"Content-Length: {len(http) + (n_bytes if kind == 'response' else 0)}")
    return ("\r\n".join(lines) + "\r\n\r\n" + http).encode()


def write_archive(pages: DataFrame, out_dir: str, min_bytes: int = 0, page_id: str = "page_id", url: str = "url",
                  payload: str = "html", date: str = "2024-01-01T00:00:00Z") -> None:
    spark = pages.sparkSession
    body = F.coalesce(pages[payload].cast("binary"), F.lit(b""))
    raw = pages.select(pages[page_id].cast("long").alias("page_id"), pages[url].cast("string").alias("url"), body.alias("payload"))
    key = F.unhex(F.sha2("payload", 256)).alias("sha256")
    (raw.select(key, "payload").groupBy("sha256").agg(F.first("payload").alias("payload"))
     .write.mode("overwrite").option("compression", "zstd").parquet(f"{out_dir}/payloads"))

    rows = write_scratch(C.with_row_id(raw.select("page_id", "url", key, F.sha1("payload").alias("sha1"),
                                                  F.octet_length("payload").cast("long").alias("n"))), "warc-rows")
    first = rows.groupBy("sha256").agg(F.min(F.struct(F.col("page_id").isNull().alias("none"), "page_id", "row_id")).alias("f"))
    typed = (rows.join(first, "sha256")
             .withColumn("kind", F.when((F.col("n") < min_bytes) | (F.col("f.row_id") == F.col("row_id")), "response").otherwise("revisit"))
             .select("page_id", "row_id", "url", "kind", "sha1", "n", F.col("f.page_id").alias("first_id"),
                     F.col("f.row_id").alias("first_row"), "sha256"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            cols = [c.to_pylist() for c in b.columns[:8]]
            heads = [record_header(*r, date) for r in zip(*cols, strict=True)]
            yield pa.RecordBatch.from_arrays([b.column(3), b.column(8), pa.array(heads, pa.binary())], names=["kind", "sha256", "header"])

    C.map_batches(typed, run, "kind string, sha256 binary, header binary").write.mode("overwrite").parquet(f"{out_dir}/records")


def read_records(spark: SparkSession, in_dir: str) -> DataFrame:
    """Every record: its original bytes (``record``), and of its full payload,
    revisits included, the size and SHA-1 (``n``, ``sha1``). A payload that
    differs from its digest fails the read."""
    stored = spark.read.parquet(f"{in_dir}/payloads")
    good = F.unhex(F.sha2("payload", 256)) == F.col("sha256")
    stored = stored.select("sha256", F.when(good, F.col("payload")).otherwise(F.raise_error(F.lit("payload differs from its digest"))).alias("payload"))
    stored = stored.select("sha256", "payload", F.octet_length("payload").cast("long").alias("n"), F.sha1("payload").alias("sha1"))
    records = spark.read.parquet(f"{in_dir}/records")
    own = F.when(F.col("kind") == "response", F.col("payload")).otherwise(F.lit(b""))
    return records.join(stored, "sha256").select(F.concat("header", own, F.lit(b"\r\n\r\n")).alias("record"), "n", "sha1")


def parse_record(record: bytes) -> tuple[dict[str, str], bytes]:
    """(named fields, block) of a record; checks its length and ends."""
    head, _, rest = record.partition(b"\r\n\r\n")
    lines = head.decode().split("\r\n")
    fields = dict(x.split(": ", 1) for x in lines[1:] if ": " in x) | {"version": lines[0]}
    block, end = rest[: int(fields["Content-Length"])], rest[int(fields["Content-Length"]) :]
    if end != b"\r\n\r\n" or fields["version"] != "WARC/1.1":
        raise ValueError(f"broken record {fields.get('WARC-Record-ID')}")
    return fields, block


def index_archive(spark: SparkSession, in_dir: str) -> DataFrame:
    """page_id, payload_bytes, payload_digest, record_type, refers_to of every
    record, parsed from its reconstructed bytes."""
    schema = "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long"

    def page(urn: str | None) -> int | None:
        name = urn.split(":")[2] if urn else "null"
        return None if name == "null" else int(name)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            out: dict[str, list] = {c.split(" ")[0]: [] for c in schema.split(", ")}
            for record, n, sha1 in zip(*(c.to_pylist() for c in b.columns), strict=True):
                fields, block = parse_record(record)
                label = fields["WARC-Payload-Digest"].removeprefix("sha1:")
                if label != base32_sha1(sha1) or fields["WARC-Type"] == "response" and len(block.partition(b"\r\n\r\n")[2]) != n:
                    raise ValueError(f"{fields['WARC-Record-ID']}: payload differs from its header")
                for c, v in zip(out, (page(fields["WARC-Record-ID"]), n, label, fields["WARC-Type"], page(fields.get("WARC-Refers-To"))), strict=True):
                    out[c].append(v)
            types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(v, t) for v, t in zip(out.values(), types, strict=True)], names=list(out))

    return C.map_batches(read_records(spark, in_dir), run, schema)


def archive_round_trip(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Writes ``pages`` as an archive in the shared scratch folder and reads it back."""
    out_dir = scratch_path(pages.sparkSession, "warc")
    write_archive(pages, out_dir, min_bytes)
    return index_archive(pages.sparkSession, out_dir)
