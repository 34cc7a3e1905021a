"""Helpers shared by the operators: Arrow text columns as byte arrays, word
spans and 64-bit hashes over them (numpy, whole chunks at once), and reading
sorted groups from an Arrow batch stream."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from flowlens.session import ship_package

U64 = np.uint64
#: Bytes of text that are hashed at once; bounds the working arrays (about ten
#: times eight bytes for each byte of text). A longer text is a chunk of its own.
CHUNK_BYTES = 1 << 20

_P = 0x9E3779B97F4A7C15 | 1
_P_INV = pow(_P, -1, 1 << 64)
_powers = {"p": np.ones(1, U64), "inv": np.ones(1, U64)}


def byte_class(separators: bytes) -> np.ndarray:
    """Lookup table: True for bytes that belong to words."""
    t = np.ones(256, bool)
    t[list(separators)] = False
    return t


#: Words are runs of anything but ASCII white space.
SPACED = byte_class(bytes([0x20, *range(0x09, 0x0E)]))
#: Words are runs of digits, lower-case ASCII letters and non-ASCII characters.
ALNUM = byte_class(bytes([*range(0x00, 0x30), *range(0x3A, 0x61), *range(0x7B, 0x80)]))
#: Maps A-Z to a-z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 0x20


def mix64(x: np.ndarray) -> np.ndarray:
    """Finaliser of splitmix64: every output bit depends on every input bit."""
    x = x ^ (x >> U64(30))
    x = x * U64(0xBF58476D1CE4E5B9)
    x = x ^ (x >> U64(27))
    x = x * U64(0x94D049BB133111EB)
    return x ^ (x >> U64(31))


def mix_int(x: int) -> int:
    return int(mix64(np.array([x & (2**64 - 1)], U64))[0])


def powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    """p^i and p^-i modulo 2^64 for i < n."""
    if len(_powers["p"]) < n:
        size = max(n, CHUNK_BYTES + 2)
        for key, base in (("p", _P), ("inv", _P_INV)):
            f = np.full(size, base, U64)
            f[0] = 1
            _powers[key] = np.multiply.accumulate(f)
    return _powers["p"][:n], _powers["inv"][:n]


def text_bytes(col: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of an Arrow string column without copying the text;
    null is empty."""
    n = len(col)
    wide = pa.types.is_large_string(col.type) or pa.types.is_large_binary(col.type)
    bufs = col.buffers()
    offs = np.frombuffer(bufs[1], np.int64 if wide else np.int32)[col.offset : col.offset + n + 1].astype(np.int64) if n else np.zeros(1, np.int64)
    data = np.frombuffer(bufs[2], np.uint8) if bufs[2] is not None and bufs[2].size else np.zeros(0, np.uint8)
    if col.null_count:
        lens = np.where(np.asarray(col.is_valid()), np.diff(offs), 0)
        if (lens != np.diff(offs)).any():  # bytes behind a null: copy without them
            keep = [data[offs[i] : offs[i] + lens[i]] for i in range(n)]
            return np.concatenate([*keep, np.zeros(0, np.uint8)]), np.concatenate([[0], np.cumsum(lens)])
    return data[offs[0] : offs[-1]], offs - offs[0]


def chunks(offs: np.ndarray, size: int = CHUNK_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges of about ``size`` bytes of text each, one row at least."""
    a, n = 0, len(offs) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(offs, offs[a] + size, "right")) - 1)
        yield a, b
        a = b


class Words:
    """Words of a chunk of texts: byte spans, owning row, hash."""

    def __init__(self, data: np.ndarray, offs: np.ndarray, table: np.ndarray):
        self.data, self.offs, self.rows = data, offs, len(offs) - 1
        first = np.zeros(len(data) + 1, bool)
        first[offs] = True  # a word never crosses from one text into the next
        w = table[data] if len(data) else np.zeros(0, bool)
        prev = np.concatenate([[False], w[:-1]]) if len(w) else w
        nxt = np.concatenate([w[1:], [False]]) if len(w) else w
        self.start = np.flatnonzero(w & (~prev | first[:-1])) if len(w) else np.zeros(0, np.int64)
        self.end = np.flatnonzero(w & (~nxt | first[1:])) + 1 if len(w) else np.zeros(0, np.int64)
        self.first = np.searchsorted(self.start, offs)  # index of each row's first word, and the end
        self.row = np.repeat(np.arange(self.rows), np.diff(self.first))
        self._sums: np.ndarray | None = None

    def span_hash(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans, from one prefix sum over the chunk."""
        if self._sums is None:
            p, _ = powers(max(1, len(self.data)))
            self._sums = np.concatenate([np.zeros(1, U64), np.cumsum((self.data.astype(U64) + U64(1)) * p[: len(self.data)], dtype=U64)])
        _, inv = powers(len(self.data) + 1)
        h = (self._sums[end] - self._sums[start]) * inv[start]
        return mix64(h + (end - start).astype(U64) * U64(0xD6E8FEB86659FD93))

    def hash(self) -> np.ndarray:
        return self.span_hash(self.start, self.end)

    def code_points(self) -> np.ndarray:
        """Code points before each byte."""
        return np.concatenate([[0], np.cumsum((self.data & 0xC0) != 0x80)])


def gram_hash(h: np.ndarray, n: int) -> np.ndarray:
    """Rolling hashes of n consecutive word hashes: g[i] covers h[i:i+n]."""
    m = len(h) - n + 1
    if m <= 0:
        return np.zeros(0, U64)
    g = h[:m].copy()
    for j in range(1, n):
        g = g * U64(0x100000001B3) + h[j : m + j]
    return mix64(g + U64(n))


def per_row(rows: int, row: np.ndarray, weight: np.ndarray | None = None) -> np.ndarray:
    """Sums (or counts) by row, as int64."""
    return np.bincount(row, weights=weight, minlength=rows).astype(np.int64)


def map_batches(df: DataFrame, fn, schema: str) -> DataFrame:
    """``mapInArrow`` with the package shipped to the workers."""
    ship_package(df.sparkSession)
    return df.mapInArrow(fn, schema)


def sorted_groups(batches: Iterator[pa.RecordBatch], n_keys: int) -> Iterator[tuple[tuple, pa.Table]]:
    """Groups of rows with equal leading key columns out of a stream that is
    sorted by them; a group may span batches. Holds one group and one batch."""
    held_key, held = None, []
    for b in batches:
        if not b.num_rows:
            continue
        keys = [np.asarray(b.column(i).to_numpy(zero_copy_only=False)) for i in range(n_keys)]
        new = np.zeros(b.num_rows, bool)
        new[0] = True
        for k in keys:
            new[1:] |= k[1:] != k[:-1]
        at = [*np.flatnonzero(new), b.num_rows]
        for s, e in zip(at[:-1], at[1:], strict=True):
            key = tuple(k[s] for k in keys)
            if key != held_key and held:
                yield held_key, pa.Table.from_batches(held)
                held = []
            held_key = key
            held.append(b.slice(s, e - s))
    if held:
        yield held_key, pa.Table.from_batches(held)


def with_row_id(df: DataFrame, name: str = "row_id") -> DataFrame:
    """Adds an id for each row. Only meaningful once the result is written."""
    return df.withColumn(name, F.monotonically_increasing_id())


def input_partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))
